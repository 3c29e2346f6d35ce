"""Operators on documents against brute force, on copies, short, empty, null and long texts."""
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import jaccard, katz, packing, quality, repeats, spm, token_counts, unigram, words
from wardline.llm.common import ready


def rows_by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def split(text):
    return (text or "").encode().lower().split()


def test_word_hashes_do_not_depend_on_place_or_batch():
    import pyarrow as pa

    column = pa.array(["One two", None, "", "two  ONE\x0bthree", "É é"])
    h, first, end, row = words.words(*words.text_bytes(column))
    assert row.tolist() == [0, 0, 3, 3, 3, 4, 4]
    assert h[0] == h[3] == words.word_hash("one") and h[1] == h[2] and len(set(h.tolist())) == 5
    long = "q" * (3 << 20)
    assert words.word_hash(long) == words.word_hash(long.upper()) != words.word_hash(long[1:])
    h2, *_ = words.words(*words.text_bytes(pa.array(["pad " * 200_000 + "one"])))
    assert h2[-1] == h[0]


def test_packing_holds_every_id_once(docs, texts):
    whole = packing._whole("byte_bpe_50k")
    got = packing.pack(docs, capacity=256, grain=4).toPandas()
    want = Counter()
    for i, t in texts:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 256):
            want[(-1 if i is None else i, s, min(256, len(ids) - s), zlib.crc32(ids[s:s + 256].tobytes()), len(ids))] += 1
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert Counter(got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 256 and used.sum() / (256 * len(used)) > 0.93


def needed(demand):
    """A lower bound of the bins for sizes 1..24 in bins of 24: what large, middle and small items leave each other."""
    size = np.arange(1, 25)
    out = 0
    for k in range(1, 13):
        large, middle, small = size > 24 - k, (size > 12) & (size <= 24 - k), (size >= k) & (size <= 12)
        room = demand[middle].sum() * 24 - demand[middle] @ size[middle]
        out = max(out, demand[large | middle].sum() + max(0, -(-(demand[small] @ size[small] - room) // 24)))
    return out


def test_patterns_cover_the_demand_and_price_like_brute_force():
    rng = np.random.RandomState(1)
    for _ in range(20):
        demand = rng.randint(0, 40, 24) * (rng.rand(24) < 0.5)
        patterns, times = packing.patterns_of(demand)
        assert (times @ patterns == demand).all() and (patterns @ np.arange(1, 25) <= 24).all()
        assert times.sum() <= needed(demand) + 12
        value = rng.rand(24)
        best = [0.0] * 25
        for w in range(1, 25):
            best[w] = max([best[w - 1]] + [best[w - s] + value[s - 1] for s in range(1, w + 1)])
        assert packing.price(value, 24) @ value == pytest.approx(best[24])


def near_brute(texts, n=5):
    def shingle(t):
        w = split(t)
        return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])
    sets = [(i, shingle(t)) for i, t in texts]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y) and comp[a] != comp[b]:
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {}
    for (i, s), c in zip(sets, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return Counter((i, len(s), least.get(c) if s else i) for (i, s), c in zip(sets, comp))


def test_jaccard_groups(docs, texts, monkeypatch):
    want = near_brute(texts)
    assert Counter(map(tuple, jaccard.near_groups(docs).collect())) == want
    monkeypatch.setattr(jaccard, "CELL", (200, 300))  # many cells
    assert Counter(map(tuple, jaccard.near_groups(docs.repartition(7)).collect())) == want
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    # one row per group, of its least id; the group of the row without an id holds no other; wordless rows stay
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter(
        {i: n if size == 0 else 1 for (i, size, c), n in want.items() if i is not None and i == c} | {None: 2})


def test_rows_of_one_id_keep_their_own_texts(spark):
    """Ids shared by different texts: each row is a document; columns named as inner ones pass through."""
    ready(spark)
    rng = np.random.RandomState(5)

    def noise(n):
        return " ".join("".join(map(chr, rng.randint(97, 123, 7))) for _ in range(n))
    base, other = noise(60), noise(60)
    # 1: a copy of 0 beside a text of its own; 2: equal rows beside another; 3: three texts that share a passage
    rows = [(0, base), (1, base), (1, other), (2, noise(40)), (2, noise(5) + base[:150]), (3, noise(9) + other), (3, other + noise(9)), (3, noise(30)),
            (None, base), (None, noise(8)), (4, ""), (4, None), (2**62 - 1, noise(20)), (2**62 - 1, base[50:300] + noise(4))]
    rows += [rows[3]]
    df = spark.createDataFrame([(i, t, k, k, k, k, k) for k, (i, t) in enumerate(rows)],
                               "doc_id long, text string, _doc int, _left int, doc int, key int, place_id int").repartition(3)
    for low in (False, True):  # ids that can be moved up, and such that must be numbered first
        if low:
            df, rows = df.where("doc_id is null or doc_id < 100"), [r for r in rows if r[0] is None or r[0] < 100]
        order = sorted({(i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows})
        seen, want = set(), {}
        for none, i, _, t in order:
            gone = [False] * len(t)
            for p in range(len(t) - 99):
                if t[p:p + 100] in seen:
                    gone[p:p + 100] = [True] * 100
                seen.add(t[p:p + 100])
            want[None if none else i, t] = "".join(c for c, g in zip(t, gone) if not g)
        got = repeats.without_repeats(df)
        assert got.columns == df.columns
        left = {r["_left"]: r for r in got.collect()}
        of = {r["_left"]: (r["doc_id"], r["text"] or "") for r in df.collect()}
        assert {k: (r["doc_id"], r["text"] or "") for k, r in left.items()} == {k: (i, want[i, t]) for k, (i, t) in of.items()}
        assert Counter(r["kept_sha256"] for r in repeats.repeats(df).collect()) == Counter(hashlib.sha256(want[k].encode()).hexdigest() for k in of.values())
    kept = jaccard.keep_one(df)
    texts = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == df.columns
    assert texts[0, base] == 1 and texts[1, base] == texts[None, base] == 0  # copies of one text
    assert texts[rows[3]] == 1 and texts[rows[4]] == 1  # equal rows are one, the other text stays
    assert sum(n for (_, t), n in texts.items() if t and other in t) == 1  # the three near copies
    assert texts[3, rows[7][1]] == texts[4, ""] == texts[4, None] == 1 and texts[rows[9]] == 1
    packed = packing.pack(repeats.without_repeats(kept))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} >= {0, 2, 3, 4}


def test_suffix_dedup(docs, texts, monkeypatch):
    seen, want = set(), {}
    for i, t in sorted({(i, t) for i, t in texts if i is not None}) + [(None, t) for i, t in texts if i is None]:
        b = (t or "").encode()
        kept, at, stop, spans = [], 0, -1, 0
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                if p > stop:
                    spans += 1
                    kept.append(b[at:p])
                at = stop = max(p + 100, stop)
            else:
                seen.add(b[p:p + 100])
        rest = b"".join([*kept, b[at:]])
        want[i, len(b)] = (len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest)
    for shard, part in ((3 << 20, 4096), (500, 2)):
        monkeypatch.setattr(repeats, "_SHARD", shard)
        monkeypatch.setattr(repeats, "_SPLIT", part)
        got = repeats.repeats(docs).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], r["n_bytes"]][:3]
    left = repeats.without_repeats(docs)
    assert left.columns == docs.columns
    sizes = {i: (t or "").encode() for i, t in texts}
    for r in left.where("doc_id is not null").collect():
        rest = want[r["doc_id"], len(sizes[r["doc_id"]])][3].decode(errors="ignore")
        assert (r["text"] or "") == rest and (r["n_chars"] or 0) == len(rest)


def test_a_frequent_gram_is_cut_into_bounded_shards(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_SPLIT", 2)
    monkeypatch.setattr(repeats, "_HELD", 500)
    rng = np.random.RandomState(11)
    phrase, line = "q" + "".join(map(chr, rng.randint(97, 123, 59))), "".join(map(chr, rng.randint(97, 123, 130)))

    def noise():
        return "".join(map(chr, rng.randint(65, 91, 60)))
    texts = [noise() + (line if i % 3 == 0 else phrase) + noise() for i in range(240)]
    # windows around the phrase that recur in differing segments
    texts += [noise()[:i % 7] + texts[i % 40 + 1][20:-20] + noise()[:i % 5] for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    ordered = docs.select(F.col("doc_id").alias("doc"), "text")
    own = repeats.texts_of(ordered, repeats.shared_segments(ordered, 100))
    assert own.where(F.col("most") > 77).count() > 0
    sizes = repeats.bodies(own, 100).groupBy("gram", "way").count()
    assert (sizes.agg(F.max("count")).first()[0] or 0) <= repeats._WAYS * repeats._SPLIT
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            if t[p:p + 100] in seen:
                gone[p:p + 100] = True
            seen.add(t[p:p + 100])
        want[i] = (int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()))
    assert sum(n > 0 for n, _ in want.values()) > 100
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.repeats(docs).collect()} == want


def test_katz_is_exact_and_normalised(docs, texts):
    uni, pairs, size = Counter(), Counter(), Counter()
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            w = split(t) + ["end"]
            uni.update(w)
            pairs.update(zip(["end"] + w, w))
            size.update(["end"] + w[:-1])
    total = sum(uni.values())

    def n_of(c):
        return [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]
    du, dp = katz.discounts(n_of(uni)), katz.discounts(n_of(pairs))

    def cut(counts, d):
        left = sum((1 - d[c]) * c for c in counts if c <= katz.K)
        return left or 1, 0 if left else 1
    left, more = cut(uni.values(), du)

    def p1(w):
        c = uni[w]
        return (du[c] if c <= katz.K else 1) * c / (total + more) if c else left / (total + more)

    def p2(a, b):
        if not size[a]:
            return p1(b)
        of = {y: c for (x, y), c in pairs.items() if x == a}
        left, more = cut(of.values(), dp)
        if b in of:
            return (dp[of[b]] if of[b] <= katz.K else 1) * of[b] / (size[a] + more)
        return left / (size[a] + more) / (1 - sum(map(p1, of))) * p1(b)
    for a in ["end", b"the", b"ab"]:
        assert sum(p2(a, b) for b in [*uni, "unknown"]) == pytest.approx(1)
    got = rows_by_id(katz.lm_scores(docs))
    for i, t in texts:
        w = split(t) + ["end"]
        if len(w) > 400:
            continue
        score = sum(math.log10(p2(a, b)) for a, b in zip(["end"] + w, w))
        base = sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (len(uni) + 1))) for x in w)
        found = [r for r in got[i] if r["n_tokens"] == len(w) and r["n_known"] == sum(x in uni for x in w)]
        assert found and found[0]["train_tokens"] == total
        assert any(r["score"] == pytest.approx(score) and r["base_score"] == pytest.approx(base) for r in found)
        assert found[0]["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)


def test_katz_cuts_frequent_contexts(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(katz, "_HOT", 5, raising=False)
    monkeypatch.setattr(katz, "_BLOCKS", 1, raising=False)
    test_katz_is_exact_and_normalised(docs, texts)
    rows = [(i, " ".join(f"the {i}w{k}" for k in range(60))) for i in range(40)]
    blocks = katz.token_blocks(spark.createDataFrame(rows, "doc_id long, text string"))
    unigrams = katz._unigram_counts(blocks, 4)
    total, _, *n1 = katz._stats(unigrams, katz.K + 3)
    known = katz._bigram_counts(blocks, unigrams, katz.Unigrams(total, n1), 4).where("block is not null").collect()
    held = Counter()
    for r in known:
        held[r["part"]] += len(katz._unz(r["counts"], np.int64))
    # Half of all pairs have one context; each part has its share of them.
    assert len(held) == 4 and max(held.values()) < 0.3 * sum(held.values())


@pytest.fixture(scope="module")
def best_path():
    """A Viterbi of its own, straight from the model file: ids and score of a text in which spaces are
    U+2581; its positions in ``spelled`` are spelled by bytes whatever pieces there are."""
    import functools
    import math

    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces, byte = {}, {}
    for i in range(model.get_piece_size()):
        value = math.floor(-math.log(27 + i) * 4096 + 0.5) / 4096 - 2.0 ** -22
        if model.is_byte(i):
            byte[int(model.id_to_piece(i)[1:-1], 16)] = i, value
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces[model.id_to_piece(i)] = i, value
    longest = max(map(len, pieces))

    @functools.lru_cache(None)
    def run(text, spelled=frozenset()):
        best = [(0.0, 0, ())]  # value, length and pieces of the last step
        for j in range(1, len(text) + 1):
            found = []
            for k in range(1, min(j, longest) + 1):
                if text[j - k:j] in pieces and not spelled & set(range(j - k, j)):
                    i, value = pieces[text[j - k:j]]
                    found.append((best[j - k][0] + value, -k, (i,)))
            if not found or found[0][1] != -1:
                raw = " " if text[j - 1] == "\u2581" and j - 1 not in spelled else text[j - 1]
                of = [byte[x] for x in raw.encode()]
                found.append((best[j - 1][0] + sum(x for _, x in of), -1, tuple(i for i, _ in of)))
            value, k, ids = max(found, key=lambda f: f[:2])
            best.append((value, -k, ids))
        out, j = [], len(text)
        while j:
            out, j = [*best[j][2], *out], j - best[j][1]
        return out, best[-1][0] + len(out) * 2.0 ** -22

    return run


def _encoding(best_path, text):
    own = frozenset(i + 1 for i, c in enumerate(text) if c == "\u2581")
    return best_path("\u2581" + text.replace(" ", "\u2581"), own) if text else ([], 0.0)


def test_token_counts_and_encoding(docs, texts, best_path):
    counted = rows_by_id(token_counts.token_counts(docs))
    whole, cut = (rows_by_id(spm.decode(spm.encode(docs, chunk=c))) for c in (1 << 15, 64))
    digests = rows_by_id(spm.digest(spm.encode(docs)))
    short = rows_by_id(spm.digest(spm.encode(docs, chunk=64)))
    for i, t in texts:
        t = t or ""
        found = [best_path("\u2581" + w.decode()) for w in t.encode().split()]
        assert (len(found), sum(len(x) for x, _ in found), pytest.approx(sum(x for _, x in found))) in [
            (r["n_words"], r["n_tokens"], r["score"]) for r in counted[i]]
        ids, score = _encoding(best_path, t)
        raw = np.array(ids, np.int32).tobytes()
        assert (t, raw) in [(r["decoded"], bytes(r["ids"])) for r in whole[i]]
        assert t in [r["decoded"] for r in cut[i]]
        want = (len(ids), pytest.approx(score), zlib.crc32(t.encode()))
        assert (*want, zlib.crc32(raw)) in [(r["n_tokens"], r["score"], r["text_crc32"], r["ids_crc32"]) for r in digests[i]]
        assert want in [(r["n_tokens"], r["score"], r["text_crc32"]) for r in short[i]]


def test_long_units_and_marks_share_the_trie(spark, best_path, monkeypatch):
    """Units on both sides of 48 characters, with shared prefixes of any length, and texts of many chunks that hold U+2581."""
    rng = random.Random(9)
    stem = "".join(rng.choice(["an", "er", "th", "É", "on", "日", "🙂", "ing"]) for _ in range(400))
    units = [stem[:n] + x for n in (0, 1, 47, 48, 49, 300, 700) for x in ("", "a", "ab", "the", "🙂🙂", "zzq")]
    units += ["x" * n for n in (47, 48, 49, 1500)] + ["🙂" * 400]
    v, units = unigram.vocabulary("piece_bpe_32k.model"), ["\u2581" + u for u in dict.fromkeys(units)]
    for few in (0, 3, 32, 10_000):
        monkeypatch.setattr(unigram, "_FEW", few)
        tokens, score = unigram.trie_counts(v, units)
        paths = unigram.trie_paths(v, units)
        for u, n, value, path in zip(units, tokens, score, paths):
            ids, best = best_path(u)
            assert np.frombuffer(path, np.int32).tolist() == ids and n == len(ids) and value == pytest.approx(best, rel=1e-12)
    monkeypatch.undo()
    words_ = ["the", "\u2581", "a\u2581b", "\u2581\u2581", "longer", "日本", "\u2581 \u2581", "x" * 90]
    rows = [(k, " ".join(rng.choice(words_) for _ in range(n))) for k, n in enumerate((1, 5, 40, 60, 300))] + [(9, "\u2581" * 500), (10, "a\u2581" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert max(len(t) for _, t in rows) > 16 * 64
    for chunk in (64, 100, 1 << 15):
        encoded = spm.encode(df, chunk=chunk)
        back = {r["doc_id"]: r["decoded"] for r in spm.decode(encoded).collect()}
        sizes = {r["doc_id"]: (r["n_tokens"], pytest.approx(r["score"])) for r in spm.digest(encoded).collect()}
        assert back == dict(rows)
        for i, t in rows:
            ids, score = _encoding(best_path, t)
            assert sizes[i] == (len(ids), score)


def test_scan_is_the_product_of_all_before():
    rng = np.random.RandomState(3)
    m = rng.randint(-9, 0, (11, 4, 4)).astype(float)
    out, run = spm.scan(m), m[0]
    for k in range(1, 11):
        run = spm.combine(run, m[k])
        assert (out[k] == run).all()
    states = spm.boundary_states(m)
    assert sum(m[k, a, b] for k, (a, b) in enumerate(zip(states, states[1:]))) == run[0, 0]


def test_quality_learns_marks(spark, docs, no_docs):
    good, bad = "the plain words of a text and more of it %d", "THE!! WORDS!! *** ### %d !!"
    rows = [(i, (bad if i % 4 == 0 else good) % i * 9) for i in range(400)] + [(None, None), (1001, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(7, None), (8, 5)], "doc_id long, quality int")
    got = quality.quality_scores(d, labels).toPandas()
    assert len(got) == 402 and got.score.between(0, 1).all()
    held = got[got.held_out & got.doc_id.lt(400)]
    assert (held.predicted == (held.doc_id % 4 > 0)).all()
    assert quality.score(docs, quality.fit(docs, labels.where("doc_id < 0"))).agg(F.max("score")).first()[0] == 0.5
    kept = quality.keep(docs, quality.fit(d, labels))
    assert kept.columns == docs.columns and kept.where("text like 'THE!!%'").count() == 0


def test_empty_tables(no_docs):
    for run in (packing.pack, jaccard.near_groups, jaccard.keep_one, repeats.repeats, repeats.without_repeats, katz.lm_scores,
                token_counts.token_counts, lambda d: spm.digest(spm.encode(d))):
        assert run(no_docs).count() == 0
    labels = no_docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.quality_scores(no_docs, labels).count() == 0
