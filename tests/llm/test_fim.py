"""Fill-in-middle against string slicing, in windows of any size."""
import hashlib
import random

import numpy as np
import pytest

from wardline.llm import fim

ODD = ["", None, "a", "é", "🙂", "日本🙂é x", "<", "<P", "P>", "<<S>", "x<M>y", "<P>", "<S", ">", "a\nb\r\n\tc", "\x00\x01", "é" * 9, " " * 50]


def brute(doc_id, text):
    text, key = text or "", "1:" + ("" if doc_id is None else str(doc_id))
    h = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(3)
    out = [*texts, *((1000 + k, t) for k, t in enumerate(ODD * 6))]
    out += [(2000 + k, "".join(rng.choice("<>PSM é🙂") for _ in range(rng.randint(1, 30)))) for k in range(300)]
    return out + [(-7, "negative"), (3000, "é🙂x" * 100_000)]


def test_fim(spark, rows):
    extra = [f"h{k}" for k in range(1, 5)] + ["n", "form", "output", "restored"]  # names used inside
    df = spark.createDataFrame([(i, t, *[3] * len(extra)) for i, t in rows],
                               "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra)).repartition(3)
    got = fim.digest(fim.transform(df)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute(*r)) for r in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.digest(fim.transform(df.where("doc_id < -100"))).count() == 0


@pytest.mark.parametrize("window", [1, 3, 7, 64])
def test_windows(monkeypatch, window):
    """Shifts carried over windows that cut code points, marks and empty runs."""
    monkeypatch.setattr(fim, "WINDOW", window)
    rng = random.Random(window)
    texts = ["".join(rng.choice("ab<é🙂") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    cut = np.array([rng.random() < 0.7 for _ in texts])
    spm = cut & np.array([rng.random() < 0.5 for _ in texts])
    a = np.array([rng.randint(0, len(t)) if c else 0 for t, c in zip(texts, cut)])
    b = np.array([rng.randint(x, len(t)) if c else 0 for x, t, c in zip(a, texts, cut)])
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    p, m = fim.byte_cuts(raw, off, np.stack([a, b]))
    out, out_off = fim.scatter(raw, off, p, m, cut, spm)
    for k, t in enumerate(texts):
        got = out[out_off[k]:out_off[k + 1]].tobytes().decode()
        x, y, z = t[:a[k]], t[a[k]:b[k]], t[b[k]:]
        assert got == (t if not cut[k] else f"<S>{z}<P>{x}<M>{y}" if spm[k] else f"<P>{x}<S>{z}<M>{y}")
    back, back_off = fim.gather(out, out_off, cut, spm)
    assert back.tobytes() == raw.tobytes() and (back_off == off).all()
