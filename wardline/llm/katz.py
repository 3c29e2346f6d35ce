"""Katz backoff scoring with Good-Turing discounts.

Texts become blocks of token numbers over a block's own dictionary, stored once and dealt
by block. Counting and scoring are one exchange per order: a block sends its distinct
n-grams with their training counts to the part that owns the context, the part adds them up
and answers in the same order. The number of parts grows with that of blocks. A context of many
tokens is cut into ways by second word, each in its own part; its sums over the ways are one
small aggregate, joined back. The answers are the count tables, partitioned by block, and a
block evaluates them recursively: bigram if seen, else the context's backoff weight times
the unigram. No count table is ever held whole.

With r the count of an n-gram, n_r how many have it, and k = 5, counts up to k are
discounted by d_r = ((r+1) n_(r+1) / (r n_r) - q) / (1 - q), q = (k+1) n_(k+1) / n_1. Where
that is no number between 0 and 1 for every r (copied texts make even counts common), n_r
comes from a power of r fitted to n_1..n_6; if that fails too, d_r = (r - 1/2) / r. A context whose counts
are all above k gets one more count, for unseen words. What unigram discounts leave is the
probability of the one unknown word. Every context sums to 1 over the vocabulary with it.

Cases: null and empty texts are one end token; a null id trains; repeated rows count each;
without training rows every token is the unknown word, of probability 1; other columns are
not read. Words are 64-bit hashes, second words of bigrams 48-bit ones."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, partitions, slices, store
from .words import mix, text_bytes, words

K = 5
_END = np.uint64(1)
_BLOCK_BYTES = 6 << 20
_HOT = 1 << 16  # tokens of a context in one way
_BLOCKS = 2  # blocks whose distinct n-grams a part may hold


def _z(x: np.ndarray) -> bytes:
    """Small numbers compress best byte by byte."""
    x = np.ascontiguousarray(x).ravel()
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unz(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).ravel()


def held_out(fold: int = 1, folds: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def token_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, held, sizes, words, stream): documents of a block with their tokens."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([t for _, _, _, t in held])
            names, stream = np.unique(tokens, return_inverse=True)
            docs_of = [pa.concat_arrays([x[k] for x in held]) for k in (0, 1)]
            sizes = np.concatenate([x[2] for x in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), *(pa.ListArray.from_arrays([0, len(x)], x) for x in docs_of),
                 *(pa.array([x], pa.binary()) for x in (_z(sizes), names.tobytes(), _z(stream.astype(np.int32))))],
                ["block", "ids", "held", "sizes", "words", "stream"])

        for b in slices(batches):
            raw, off = text_bytes(b.column("text"))
            h, _, _, row = words(raw, off)
            n = np.bincount(row, minlength=b.num_rows) + 1
            tokens = np.full(len(h) + b.num_rows, _END)
            tokens[np.arange(len(h)) + row] = h
            held.append((b.column("doc_id"), b.column("held"), n, tokens))
            size += len(raw)
            if size >= _BLOCK_BYTES:
                yield flush()
                held, size, block = [], 0, block + 1
        if held:
            yield flush()

    return bucketed(docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(
        run, f"block long, ids array<{ids}>, held array<boolean>, sizes binary, words binary, stream binary"), "block")


def parts_of(blocks: DataFrame) -> int:
    return max(partitions(blocks.sparkSession), -(-blocks.count() // _BLOCKS))


class _Block:
    """A block's tokens as numbers of its dictionary, which is ordered by hash."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.now = _unz(row["stream"], np.int32).astype(np.int64)
        self.sizes = _unz(row["sizes"], np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = ~np.array(row["held"], bool)[self.doc]
        end = int(np.searchsorted(self.words, _END))
        self.before = np.roll(self.now, 1)
        self.before[np.cumsum(self.sizes) - self.sizes] = end  # a text starts after an end

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, second word and training count of each distinct pair; each token's pair."""
        code, at = np.unique(self.before * len(self.words) + self.now, return_inverse=True)
        return code // len(self.words), code % len(self.words), np.bincount(at, self.train, len(code)).astype(np.int64), at

    def by_part(self, parts: int) -> list[tuple[int, np.ndarray]]:
        """(part, its words in order) of the dictionary."""
        part = (self.words % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        return list(zip(part[cut].tolist(), np.split(order, cut[1:])))


def _count_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(c[c <= K + 1], minlength=K + 2)[1:].tolist()


def discounts(n: list[int]) -> np.ndarray:
    """d_0..d_k (d_0 unused) from n_1..n_(k+1)."""
    r = np.arange(1, K + 1)
    n = np.array(n, float)
    if (n > 0).all():
        slope, level = np.polyfit(np.log(np.arange(1, K + 2)), np.log(n), 1)
        for m in (n, np.exp(level) * np.arange(1, K + 2) ** slope):  # as counted, else on a fitted power of r
            q = (K + 1) * m[K] / m[0]
            d = ((r + 1) * m[1:] / (r * m[:-1]) - q) / (1 - q) if q != 1 else np.zeros(K)
            if ((d > 0) & (d < 1)).all():
                return np.append(1.0, d)
    return np.append(1.0, (r - 0.5) / r)


class Unigrams:
    """Discounted unigram probabilities from the counts alone."""

    def __init__(self, total: int, n: list[int]):
        self.total, self.d = total, discounts(n)
        r = np.arange(1, K + 1)
        cut = float(((1 - self.d[1:]) * r * np.array(n[:K])).sum())
        self.size = total if cut > 0 else total + 1
        self.unknown = (cut if cut > 0 else 1) / self.size if total else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= K, self.d[np.minimum(c, K)], 1.0)
        return np.where(c > 0, d * c / max(self.size, 1), self.unknown)


def _rows(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _unigram_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, part, counts, ways, hot, stats): each block's dictionary counts, the ways of its words as
    contexts, and the words of several ways; rows without a block hold N, V, n_1...n_6."""
    asked = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("held", pa.binary())])
    answer = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("counts", pa.binary()), ("ways", pa.binary()),
                        ("hot", pa.list_(pa.int64())), ("stats", pa.list_(pa.int64()))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = _Block(row)
                c = np.bincount(x.now, x.train, len(x.words)).astype(np.int64)
                # As a context a word has as many tokens as by itself; only the end also starts texts.
                held = np.bincount(x.now, minlength=len(x.words)) - c
                split = x.by_part(parts)
                yield _rows([[p for p, _ in split], [row["block"]] * len(split), [x.words[at].tobytes() for _, at in split],
                             [_z(c[at]) for _, at in split], [_z(held[at]) for _, at in split]], asked)

    def add(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in t["keys"].to_pylist()]
        c = np.concatenate([_unz(x, np.int64) for x in t["counts"].to_pylist()])
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        total, ways = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        np.add.at(total, at, c)
        np.add.at(ways, at, c + np.concatenate([_unz(x, np.int64) for x in t["held"].to_pylist()]))
        ways = ways // _HOT + 1
        stats = [int(total.sum()), int((total > 0).sum()), *_count_of_counts(total)]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        back, each = np.split(total[at], cuts), np.split(ways[at], cuts)
        n = len(back)
        return pa.Table.from_batches([_rows([
            t["block"].to_pylist() + [None], t["part"].to_pylist() + [None], [_z(x) for x in back] + [None], [_z(x) for x in each] + [None],
            [k[w > 1].view(np.int64) for k, w in zip(keys, each)] + [None], [None] * n + [stats]], answer)])

    sent = blocks.select("block", "held", "sizes", "words", "stream").mapInArrow(ask, "part long, block long, keys binary, counts binary, held binary")
    return store(sent.groupBy("part").applyInArrow(
        add, "block long, part long, counts binary, ways binary, hot array<long>, stats array<long>"))


def _stats(answers: DataFrame, n: int) -> list[int]:
    sums = answers.where("block is null").agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(n))).first()
    return [int(x) for x in sums]


def _answers(t: DataFrame, *columns: str, name: str) -> DataFrame:
    return t.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", *columns)).alias(name))


def _dictionary_counts(x: _Block, answers: list[dict], parts: int, name: str = "counts") -> np.ndarray:
    got = {a["part"]: a[name] for a in answers}
    out = np.zeros(len(x.words), np.int64)
    for p, at in x.by_part(parts):
        out[at] = _unz(got[p], np.int64)
    return out


def _known_pairs(x: _Block, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of known words (first, second, training count, place among the block's pairs)."""
    first, second, n, at = x.pairs()
    known = (c[first] > 0) & (c[second] > 0)
    return first, second, n, at, np.flatnonzero(known)


def _second(x: _Block, second: np.ndarray) -> np.ndarray:
    return x.words[second] >> np.uint64(16)


def _pairs_by_part(x: _Block, c: np.ndarray, ways: np.ndarray, first: np.ndarray, second: np.ndarray, known: np.ndarray, parts: int):
    """(part, its known contexts, its known pairs): pairs are ordered by context already. A context
    of several ways is in each part that has one of its pairs."""
    contexts = np.zeros(len(x.words), bool)
    contexts[first] = True
    contexts &= (c > 0) & (ways == 1)
    way = mix(_second(x, second[known])) % ways[first[known]].astype(np.uint64)
    part = ((x.words[first[known]] % np.uint64(parts) + way) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    own = dict(x.by_part(parts))
    for p in np.union1d(np.array(list(own), np.int64), part).tolist():
        a, b = np.searchsorted(part, [p, p + 1])
        pairs, at = known[order[a:b]], own.get(p, np.zeros(0, np.int64))
        at = np.union1d(at[contexts[at]], first[pairs])
        if len(at):
            yield p, at, pairs


def _bigram_counts(blocks: DataFrame, unigrams: DataFrame, p_of: Unigrams, parts: int) -> DataFrame:
    """(block, part, counts, totals, few, seen, stats): each block's pair counts, and what weighs its
    contexts; rows without a block hold the part's share of contexts of several ways."""
    asked = pa.schema([("part", pa.int64()), ("block", pa.int64()), *((k, pa.binary()) for k in (
        "context", "hot", "runs", "low", "high", "counts", "second"))])
    answer = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("counts", pa.binary()), ("totals", pa.binary()),
                        ("few", pa.binary()), ("seen", pa.binary()), ("stats", pa.list_(pa.int64()))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = _Block(row)
                c, ways = (_dictionary_counts(x, row["unigrams"], parts, k) for k in ("counts", "ways"))
                first, second, n, _, known = _known_pairs(x, c)
                out = [[] for _ in asked]
                for p, contexts, pairs in _pairs_by_part(x, c, ways, first, second, known, parts):
                    runs = np.bincount(np.searchsorted(contexts, first[pairs]), minlength=len(contexts))
                    h = _second(x, second[pairs])
                    for column, value in zip(out, (
                            p, row["block"], x.words[contexts].tobytes(), _z((ways[contexts] > 1).astype(np.uint8)), _z(runs), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                            (h >> np.uint64(32)).astype(np.uint16).tobytes(), _z(n[pairs]), _z(c[second[pairs]]))):
                        column.append(value)
                yield _rows(out, asked)

    def add(t: pa.Table) -> pa.Table:
        def column(k: str, kind=None) -> list[np.ndarray]:
            return [np.frombuffer(x, kind) if kind else _unz(x, np.int64) for x in t[k].to_pylist()]

        context, runs = column("context", np.uint64), column("runs")
        names, at, name = np.unique(np.concatenate(context), return_index=True, return_inverse=True)
        hot = np.concatenate([_unz(x, np.uint8) for x in t["hot"].to_pylist()])[at] > 0
        first = np.repeat(name, np.concatenate(runs))
        second = np.concatenate(column("low", np.uint32)).astype(np.uint64) | (
            np.concatenate(column("high", np.uint16)).astype(np.uint64) << np.uint64(32))
        n, c2 = np.concatenate(column("counts")), np.concatenate(column("second"))
        order = np.lexsort((second, first))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        lead = order[new]
        total = np.zeros(len(lead), np.int64)
        np.add.at(total, pair, n)
        owner, seen = first[lead], total > 0
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, owner, total)
        mass = np.bincount(owner[seen], p_of(c2[lead][seen]), len(names))
        few = np.stack([np.bincount(owner[total == r], minlength=len(names)) for r in range(1, K + 1)], 1).astype(np.int64)
        each = np.split(total[pair], np.cumsum([int(r.sum()) for r in runs])[:-1])
        own = np.split(name, np.cumsum([len(x) for x in context])[:-1])
        k = len(each)
        return pa.Table.from_batches([_rows([
            t["block"].to_pylist() + [None], t["part"].to_pylist() + [None], [_z(x) for x in each] + [names[hot].tobytes()],
            *([_z(v[o]) for o in own] + [_z(v[hot])] for v in (totals, few, mass)),
            [None] * k + [_count_of_counts(total)]], answer)])

    sent = blocks.select("block", "held", "sizes", "words", "stream").join(_answers(unigrams, "counts", "ways", name="unigrams"), "block")
    kinds = ", ".join(f"{k} {'long' if k in ('part', 'block') else 'binary'}" for k in asked.names)
    return store(sent.mapInArrow(ask, kinds).groupBy("part").applyInArrow(
        add, "block long, part long, counts binary, totals binary, few binary, seen binary, stats array<long>"))


def _hot_contexts(unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(block, hot): what weighs the contexts of several ways that a block has."""
    few = [f"n{r}" for r in range(1, K + 1)]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = _unz(row["few"], np.int64).reshape(-1, K)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (
                    np.frombuffer(row["counts"], np.int64), _unz(row["totals"], np.int64), *n.T.copy(), _unz(row["seen"], np.float64))],
                    ["context", "total", *few, "seen"])

    share = bigrams.where("block is null").select("counts", "totals", "few", "seen").mapInArrow(
        shares, f"context long, total long, {', '.join(f'{k} long' for k in few)}, seen double")
    sums = share.groupBy("context").agg(*(F.sum(k).alias(k) for k in ("total", *few, "seen")))
    asked = unigrams.where("block is not null").select("block", F.explode("hot").alias("context"))
    return asked.join(sums, "context").groupBy("block").agg(F.collect_list(F.struct(
        "context", "total", F.array(*few).alias("few"), "seen")).alias("hot"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    blocks = token_blocks(docs)
    parts = parts_of(blocks)
    unigrams = _unigram_counts(blocks, parts)
    total, distinct, *n1 = _stats(unigrams, K + 3)
    p_of = Unigrams(total, n1)
    bigrams = _bigram_counts(blocks, unigrams, p_of, parts)
    d = discounts(_stats(bigrams, K + 1))
    ids = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.to_pylist()):
                x = _Block(row)
                c, ways = (_dictionary_counts(x, row["unigrams"], parts, k) for k in ("counts", "ways"))
                first, second, _, at, known = _known_pairs(x, c)
                got = {a["part"]: a for a in row["bigrams"] or []}
                count = np.zeros(len(first), np.int64)
                # Per word as a context: its size, and what is left for unseen words.
                size, weight = np.ones(len(x.words)), np.ones(len(x.words))

                def weigh(contexts: np.ndarray, totals: np.ndarray, few: np.ndarray, mass: np.ndarray) -> None:
                    cut = ((1 - d[1:]) * np.arange(1, K + 1) * few.reshape(-1, K)).sum(1)
                    size[contexts] = np.where(cut > 0, totals, totals + 1)
                    weight[contexts] = np.where(cut > 0, cut, 1.0) / size[contexts] / (1 - mass)

                for p, contexts, pairs in _pairs_by_part(x, c, ways, first, second, known, parts):
                    a = got[p]
                    count[pairs] = _unz(a["counts"], np.int64)
                    one = ways[contexts] == 1
                    weigh(contexts[one], _unz(a["totals"], np.int64)[one], _unz(a["few"], np.int64).reshape(-1, K)[one],
                          _unz(a["seen"], np.float64)[one])
                hot = row["hot"] or []
                words_of = np.array([h["context"] for h in hot], np.int64).view(np.uint64)
                weigh(np.searchsorted(x.words, words_of), *(np.array([h[k] for h in hot], kind) for k, kind in (
                    ("total", np.int64), ("few", np.int64), ("seen", np.float64))))
                seen = d[np.minimum(count, K)] * (count <= K) + (count > K)
                p_pair = np.where(count > 0, seen * count / size[first], weight[first] * p_of(c[second]))
                logs = np.log10(p_pair)[at]
                base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))[x.now]
                n = len(x.sizes)
                yield pa.RecordBatch.from_arrays([
                    b.column("ids")[i].values, b.column("held")[i].values, pa.array(x.sizes),
                    pa.array(np.bincount(x.doc, c[x.now] > 0, n).astype(np.int64)), pa.array(np.full(n, total)),
                    pa.array(np.bincount(x.doc, base, n)), pa.array(np.bincount(x.doc, logs, n))], names)

    whole = blocks.join(_answers(unigrams, "counts", "ways", name="unigrams"), "block").join(
        _answers(bigrams, "counts", "totals", "few", "seen", name="bigrams"), "block", "left").join(
        _hot_contexts(unigrams, bigrams), "block", "left")
    return whole.mapInArrow(score, f"doc_id {ids}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
