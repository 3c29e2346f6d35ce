"""Vector search, near-duplicate vectors and url filters against brute force."""
import random

import numpy as np
import pytest

from wardline.llm import neardup, search, urls
from wardline.llm.common import ready


@pytest.fixture(scope="module")
def vectors(spark):
    ready(spark)
    rng = np.random.RandomState(2)
    x = rng.standard_normal((300, 16))
    x = np.concatenate([x, x[:40] + 0.02 * rng.standard_normal((40, 16)), np.repeat(x[:1], 60, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    rows += [(500, None, 0, 1), (550, [0.0] * 16, 0, 1), (600, [float("nan")] * 16, 0, 1), (650, [None] * 16, 0, 1),
             (700, [float("inf")] * 16, 0, 1), (None, x[3].tolist(), 0, 1), rows[5]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id int").repartition(3), rows


def usable(v, zero):
    return v is not None and None not in v and np.isfinite(np.array(v, float)).all() and (zero or any(v))


def test_top_k(vectors, monkeypatch):
    df, rows = vectors
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, *_ in rows if i is not None and usable(v, True)]
    want = []
    for i, q in {i: q for i, q in good if i % 50 == 0}.items():
        order = sorted((-int(q @ v), j) for j, v in good if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    for cell in ((1024, 8192), (3, 50)):
        monkeypatch.setattr(search, "CELL", cell)
        assert sorted(map(tuple, search.top_k(df.where("vec_id % 50 = 0"), df).collect())) == sorted(want)
    none = df.where("label > 0")
    assert search.top_k(none, df).count() == search.top_k(df, none).count() == 0
    few = df.where("vec_id < 3")
    assert search.top_k(few.where("vec_id = 0"), few).count() == 2


def test_near_vectors(vectors, monkeypatch):
    df, rows = vectors
    u = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v, False) else None for _, v, *_ in rows]
    n = len(rows)
    links = [[b for b in range(n) if b != a and u[a] is not None and u[b] is not None and u[a] @ u[b] >= 0.95] for a in range(n)]
    comp = list(range(n))
    for a in range(n):
        for b in links[a]:
            old, new = comp[a], comp[b]
            comp = [new if c == old else c for c in comp]
    least = {}
    for (i, *_), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(str((i, len(links[k]), least.get(comp[k]), i == least.get(comp[k]))) for k, (i, *_) in enumerate(rows))
    for cell in ((2048, 8192), (3, 7)):
        monkeypatch.setattr(neardup, "CELL", cell)
        assert sorted(str(tuple(r)) for r in neardup.near_vectors(df).collect()) == want
    assert neardup.near_vectors(df.where("label > 0")).count() == 0


def _tree(rows, rules):
    """Verdicts by a tree of dictionaries: one node at a time, from the host down."""
    import math
    import re

    def rule(host, path):
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    urls_ = [(i, h, p, rule(h, p), ["*" if re.search(urls._VARIABLE, x) else x for x in p.split("/") if x]) for i, h, p in rows]
    out = {i: r or "allow" for i, _, _, r, _ in urls_}

    def split(of, k):
        kids = {}
        for u in of:
            if len(u[4]) > k:
                kids.setdefault(u[4][k], []).append(u)
        total = sum(map(len, kids.values()))
        merged = {}
        for s, us in kids.items():
            known = [u[3] for u in us if u[3]]
            if s != "*" and len(us) < max(5, total * 0.02):
                s = "*" if not known else "*blocked" if 2 * known.count("block") >= len(known) else "*allowed"
            merged.setdefault(s, []).extend(us)
        rated = []
        for s, us in merged.items():
            known = [u[3] for u in us if u[3]]
            if known:
                rated.append(((known.count("block") + 1) / (len(known) + 2), s, len(known), us))
        classes = []
        for rate, s, n, us in sorted(rated, key=lambda x: x[:2]):
            if classes:
                rate0, n0 = classes[-1][0]
                both = (rate * n + rate0 * n0) / (n + n0)
            if not classes or rate - rate0 > 1.96 * math.sqrt(both * (1 - both) * (1 / n + 1 / n0)):
                classes.append([None, []])
            classes[-1][0] = (rate, n)
            classes[-1][1] += us
        for _, us in classes:
            known = [u[3] for u in us if u[3]]
            bad = known.count("block")
            for i, _, _, r, _ in us:
                out[i] = r or ("block" if (bad + 1) / (len(known) + 2) >= 0.7 else "allow")
            if 0 < bad < len(known):
                split(us, k + 1)

    for host in {u[1] for u in urls_}:
        split([u for u in urls_ if u[1] == host], 0)
    return out


def test_templates_of_any_depth(spark):
    ready(spark)
    rng, rows = random.Random(4), []
    rules = [("block", "h.org", "/a/b/c/bad/x"), ("allow", "h.org", "/a/b/c/good/x"), ("block", "k.org", "/q/w/e/r/t/y/bad/"),
             ("allow", "k.org", "/q/w/e/r/t/y/"), ("block", "k.org", "/q/w/e/r/u/")]
    for k in range(15):
        rows += [("h.org", f"/a/b/c/bad/x{k}")] + [("h.org", f"/a/b/c/good/x{k}")] * (k < 12)
    rows += [("h.org", "/a/b/c/bad/zz"), ("h.org", "/a/b/c/good/zz"), ("h.org", "/a/b/c"), ("h.org", "/a//b/c/bad/")]
    for _ in range(600):
        n = rng.randint(0, 12)
        rows.append(("k.org", "/" + "/".join(["q", "w", "e", "r", rng.choice("tu"), "y", rng.choice(["bad", "good", "n1", "rare%s" % rng.choice("abcdefgh")]),
                                               *[rng.choice(["i", "j", "2026", "v"]) for _ in range(3)]][:n])))
    rows += [("k.org", "//q/w/e/r/t/y/bad/i")] * 3 + [("k.org", "/q//w/e/r/t/y/good")] * 3 + [("k.org", "/" + "a/" * 300)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p in rows], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(df, rules).collect()}
    assert got == _tree(rows, rules)
    by_path = {p: got[i] for i, _, p in rows}
    assert by_path["/a/b/c/bad/zz"] == "block" and by_path["/a/b/c/good/zz"] == "allow"


def test_url_rules_and_templates(spark):
    pages = [(1, "http://A.Com/x?y"), (2, "https://www.example.com/en/1"), (3, "https://shop.example.com/en/1#t"), (4, None),
             (5, "no scheme"), (6, "ftp://b.net/es"), (7, "ftp://b.net/en/1"), (8, "http://b.org"), (9, "http://b.org?a/b"), (10, ""),
             (11, "x://y.net://z/fr/"), (12, "http://com/"), (13, "http://a.com"), (1, "http://A.Com/x?y")]
    pages += [(100 + k, f"http://b.net/es/{k}.html") for k in range(9)] + [(200 + k, f"http://b.net/en/{k}") for k in range(9)]
    ready(spark)
    df = spark.createDataFrame([(*p, "h", 1, 2) for p in pages], "page_id long, url string, host string, n int, t0 int")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.url_verdicts(df).collect()}
    assert urls.url_verdicts(df).count() == len(pages)
    assert got[1] == ("a.com", "/x", "com/", "allow")
    assert got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3] == ("shop.example.com", "/en/1", "example.com/en/", "block")
    assert got[4] == got[5] == got[10] == ("", "", None, "allow")
    assert got[6] == ("b.net", "/es", None, "block")  # its branch is blocked by nine labels
    assert got[7] == ("b.net", "/en/1", None, "allow")
    assert got[8] == got[9] == ("b.org", "", None, "allow")
    assert got[11] == ("y.net:", "//z/fr/", None, "allow")
    assert got[12][2:] == ("com/", "allow") and got[13] == ("a.com", "", None, "allow")
    assert urls.url_verdicts(df.where("n > 1")).count() == 0


def test_walks_reach_every_partner_along_few_directions():
    rng = np.random.RandomState(4)
    x = np.zeros((4000, 64))
    x[:, 0], x[:, 32] = 1, 1
    x[:, [1, 33]] = rng.uniform(-1, 1, (4000, 2))  # the codebooks split these alone
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = neardup.Grid(x, 16, 0.95)
    met = np.zeros((4000, grid.codes ** 2), bool)
    homes = []
    for row, cell, home in grid.walk(x):
        met[row, cell] = True
        homes.append(home)
    a, b = np.nonzero(x @ x.T >= 0.95)
    assert met[a, np.concatenate(homes)[b]].all()


@pytest.mark.parametrize("shape", ["isotropic", "few directions", "one residue"])
def test_recall_is_measured_and_links_are_symmetric(spark, shape):
    """20,000 vectors with partners planted at similarities of 0.94 to 0.96 and closer."""
    rng = np.random.RandomState(3)
    n, dims, pairs = 20_000, 32, 1500
    x = rng.standard_normal((n, dims))
    if shape == "few directions":
        x[:, 4:] *= 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, dims))
    if shape == "few directions":
        side[:, 4:] = 0
    side -= (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = np.concatenate([rng.uniform(0.94, 0.96, pairs // 2), rng.uniform(0.96, 1, pairs - pairs // 2)])[:, None]
    x[n - pairs:] = c * x[:pairs] + np.sqrt(1 - c ** 2) * side
    x = x.astype(np.float32)
    by = 64 if shape == "one residue" else 1
    ready(spark)
    df = spark.createDataFrame([(k * by, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = {r["vec_id"] // by: r for r in neardup.near_vectors(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    deg = np.zeros(n, int)
    for lo in range(0, n, 1000):
        deg[lo:lo + 1000] = (u[lo:lo + 1000] @ u.T >= 0.95).sum(1) - 1
    found = np.array([got[k]["n_links"] for k in range(n)])
    assert (found <= deg).all() and found.sum() % 2 == 0
    assert found.sum() >= 0.99 * deg.sum() > 0
