"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text gets a space in front, spaces become U+2581, and the best path of the unigram model
(``unigram``) is its encoding. Giant documents are split into chunks of fixed size. What a
chunk does to path values is a max-plus matrix between boundary states: how many characters
the piece across the boundary reaches into the chunk, before and behind. The matrices are
combined associatively by a scan over the document's chunks, which gives every chunk its
entry and exit state; then chunks are backtraced independently. A document of one chunk has
only the states 0 and needs no scan.

Decoding joins the pieces' bytes and drops the space in front: it gives back every text
exactly. A U+2581 that stands in a text is spelled by its bytes, in chunks as elsewhere. Of
equal best paths the last pieces are the shortest, but across a chunk's boundary any.

Cases: null and empty texts have no ids; repeated rows give equal rows; other columns are
not read."""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import partitions, slices, store
from .unigram import MARK, SPACE, UNIT, Paths, Vocabulary, vocabulary

CHUNK = 1 << 15
_BREAK = re.compile(f"[^{SPACE}](?={SPACE})")


def _matrix(v: Vocabulary, text: str, n: int) -> np.ndarray:
    """T[i, j]: the best value from i characters into the chunk to j characters behind its
    ``n`` characters; ``text`` goes on behind them."""
    states = v.longest
    best = np.full((n + states, states), -np.inf)  # by position and entry state
    for i in range(min(states, n + 1)):
        best[i, i] = 0
    for i in range(n, states):  # a piece from before the chunk ends behind it
        best[i, i] = 0
    for i in range(n):
        for k, value, _ in v.edges(text, i):
            np.maximum(best[i + k], best[i] + value, out=best[i + k])
    return best[n:n + states].T.copy()


def _between(v: Vocabulary, text: str, n: int, enter: int, leave: int) -> list[int]:
    """The ids of the best path between two states of a chunk."""
    best, back = np.full(n + v.longest, -np.inf), [None] * (n + v.longest)
    best[enter] = 0
    for i in range(enter, n):
        if best[i] > -np.inf:
            for k, value, piece in v.edges(text, i):
                if best[i] + value >= best[i + k]:  # the shortest last piece, as in the trie
                    best[i + k], back[i + k] = best[i] + value, (k, piece)
    out, i = [], n + leave
    while i > enter:
        k, piece = back[i]
        out += [piece] if piece >= 0 else v.spelled(text[i - 1])[0][::-1]
        i -= k
    return out[::-1]


def _breaks(text: str, n: int) -> tuple[int, int] | None:
    """The first and the last break within a chunk; every path stops there."""
    found = [m.start() for m in _BREAK.finditer(text, 0, n)]
    return (found[0] + 1, found[-1] + 1) if found else None


def transfer(v: Vocabulary, paths: Paths, text: str, n: int) -> np.ndarray:
    """A chunk's matrix. Between its first and last break the value is the units' own; only what
    lies before and behind them depends on the states."""
    cut = _breaks(text, n)
    if cut is None:
        return _matrix(v, text, n)
    first, last = cut
    units = UNIT.findall(text[first:last])
    paths.learn(set(units))
    body = v.value[np.frombuffer(b"".join(map(paths.__getitem__, units)), np.int32)].sum()
    return _matrix(v, text[:first], first)[:, :1] + body + _matrix(v, text[last:], n - last)[:1]


def trace(v: Vocabulary, paths: Paths, text: str, n: int, enter: int, leave: int) -> list[int]:
    """A chunk's ids between two states."""
    cut = _breaks(text, n)
    if cut is None:
        return _between(v, text, n, enter, leave)
    first, last = cut
    units = UNIT.findall(text[first:last])
    paths.learn(set(units))
    body = np.frombuffer(b"".join(map(paths.__getitem__, units)), np.int32).tolist()
    return _between(v, text[:first], first, enter, 0) + body + _between(v, text[last:], n - last, 0, leave)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of stacks of matrices: first ``a``, then ``b``."""
    out = np.full(np.broadcast_shapes(a.shape, b.shape), -np.inf)
    for k in range(a.shape[-1]):
        np.maximum(out, a[..., :, k, None] + b[..., None, k, :], out=out)
    return out


def scan(matrices: np.ndarray) -> np.ndarray:
    """Inclusive prefix products, by doubling."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = combine(out[:-step], out[step:].copy())
        step *= 2
    return out


def boundary_states(matrices: np.ndarray) -> np.ndarray:
    """The state at each boundary (0 at both ends) on the best path through all chunks."""
    prefix = scan(matrices)[:, 0]
    states = np.zeros(len(matrices) + 1, np.int64)
    for k in range(len(matrices) - 1, 0, -1):
        states[k] = int((prefix[k - 1] + matrices[k][:, states[k + 1]]).argmax())
    return states


def _marked(text: str) -> str:
    return SPACE + text.replace(SPACE, MARK).replace(" ", SPACE)


def _encode_small(v: Vocabulary, paths: Paths, texts: list[str]) -> list[bytes]:
    """Encodings of whole texts."""
    units = [UNIT.findall(_marked(t)) if t else [] for t in texts]
    paths.learn(set().union(*units))
    return [b"".join(map(paths.__getitem__, u)) for u in units]


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, ids): the ids of every row, as little-endian int32. ``row`` is a number of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        paths = Paths(v)
        for b in slices(batches):
            texts = [t or "" for t in b.column(2).to_pylist()]
            small = [len(t) <= chunk for t in texts]
            ids = _encode_small(v, paths, [t if s else "" for t, s in zip(texts, small)])
            out = [(i, 0, 1, x, None, None, None) for i, (x, s) in enumerate(zip(ids, small)) if s]
            for i in np.flatnonzero(~np.array(small)).tolist():
                t = _marked(texts[i])
                for c, lo in enumerate(range(0, len(t), chunk)):
                    n = min(chunk, len(t) - lo)
                    body = t[lo:lo + n + v.longest]
                    out.append((i, c, -(-len(t) // chunk), None, body.encode("utf-8", "surrogatepass"), n, transfer(v, paths, body, n).tobytes()))
            row, *rest = zip(*out)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(
                pa.array(x, k) for x, k in zip(rest, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())))], names)

    def route(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        m = np.stack([np.frombuffer(x) for x in t["matrix"].to_pylist()])
        side = int(np.sqrt(m.shape[1]))
        states = boundary_states(m.reshape(-1, side, side))
        return pa.table({"row": t["row"], "chunk": t["chunk"], "enter": states[:-1], "leave": states[1:]})

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        paths = Paths(v)
        for b in batches:
            ids = [np.array(trace(v, paths, body.decode("utf-8", "surrogatepass"), *x), np.int32).tobytes()
                   for body, *x in zip(*(b.column(k).to_pylist() for k in range(3, 7)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], ["row", "doc_id", "chunk", "ids"])

    names = ["row", "doc_id", "chunk", "chunks", "ids", "body", "n", "matrix"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = store(rows.mapInArrow(cut, f"row long, doc_id {kind}, chunk long, chunks long, ids binary, body binary, n long, matrix binary"), "zstd")
    split = parts.where("chunks > 1")
    states = split.select("row", "chunk", "matrix").groupBy("row").applyInArrow(route, "row long, chunk long, enter long, leave long")
    traced = split.select("row", "doc_id", "chunk", "body", "n").join(states, ["row", "chunk"]).repartition(
        partitions(docs.sparkSession), "row", "chunk").select("row", "doc_id", "chunk", "body", "n", "enter", "leave") \
        .mapInArrow(back, f"row long, doc_id {kind}, chunk long, ids binary")
    joined = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("p"))
    whole = joined.select("row", "doc_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return parts.where("chunks = 1").select("row", "doc_id", "ids").union(whole)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``encoded`` with the column ``decoded``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model).pieces
        for b in slices(batches, "ids"):
            texts = [b"".join(map(pieces.__getitem__, np.frombuffer(x, np.int32).tolist()))[1:].decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    names = [*encoded.columns, "decoded"]
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def digest(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_tokens, score, ids_crc32, n_bytes, text_crc32): sizes and checks of the ids and of the decoded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in slices(batches, "ids"):
            out = []
            for x, t in zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                ids = np.frombuffer(x, np.int32)
                out.append((len(ids), float(v.value[ids].sum()) + len(ids) * 2.0 ** -22, zlib.crc32(x), len(t), zlib.crc32(t)))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    names = ["doc_id", "n_tokens", "score", "ids_crc32", "n_bytes", "text_crc32"]
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return decode(encoded, model).select("doc_id", "ids", "decoded").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, score double, ids_crc32 long, n_bytes long, text_crc32 long")
