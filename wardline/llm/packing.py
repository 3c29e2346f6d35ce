"""Packing by cutting-stock column generation.

Documents become pieces of at most ``capacity`` ids: whole sequences and one tail. Piece
lengths, rounded up to ``grain``, give a histogram of fixed size. A linear program over
patterns of that histogram is solved by column generation: a knapsack dynamic program
prices each new pattern with the duals. Patterns are rounded down, what is left over is
packed best-fit, and pieces ranked within their length class take the slots of their
class in order. Only the histogram reaches the driver.

Cases: null and empty texts are one piece with the end id; a repeated row is packed as
often as it occurs; a null id is kept; no rows give no pieces; other columns are not read."""
from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, store

END_ID = 1
#: Runs that long go to the other library, which takes them in linear time; ids are the same.
_LONG = re.compile(r"\S{4000}|\s{4000}")


@functools.lru_cache
def _whole(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


@functools.lru_cache
def _fast(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{vocabulary}.json")) as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, vocabulary: str = "byte_bpe_50k") -> np.ndarray:
    """The ids of one text; both libraries hold the same vocabulary, the second is several times faster."""
    if _LONG.search(text):
        return np.array(_whole(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(_fast(vocabulary).encode_to_numpy(text, allowed_special="all"), np.uint32)


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full sequences and the tail of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(token_ids(text or "", vocabulary), np.uint32(end_id)).astype("<u4")
                rows += [(i, s, min(capacity, len(ids) - s), zlib.crc32(ids[s:s + capacity]), len(ids))
                         for s in range(0, len(ids), capacity)]
            row, start, length, crc, total = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *map(pa.array, (start, length, crc, total))], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {ids}", *(f"{c} long" for c in names[1:])]))


def price(value: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern (count per size 1..capacity) of the greatest value: an unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        options = best[w - 1::-1] + value[:w]  # size s leaves w - s
        s = int(options.argmax())
        if options[s] > best[w - 1]:
            best[w], took[w] = options[s], s + 1
        else:
            best[w] = best[w - 1]
    out, w = np.zeros(capacity, np.int64), capacity
    while w > 0:
        if took[w]:
            out[took[w] - 1] += 1
            w -= took[w]
        else:
            w -= 1
    return out


def patterns_of(demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, times) that cover ``demand[s - 1]`` items of each size s exactly. Sizes run to the capacity.

    Revised simplex from one-size patterns; it stops when no pattern prices above 1, or
    after a number of pivots set by the capacity alone (any basis is a valid plan)."""
    capacity = len(demand)
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return np.zeros((0, capacity), np.int64), np.zeros(0, np.int64)
    basis = np.zeros((m, capacity), np.int64)
    basis[np.arange(m), sizes - 1] = capacity // sizes
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand[sizes - 1]
    value = np.full(capacity, -1.0)
    for _ in range(20 * capacity):
        value[sizes - 1] = inverse.sum(0)
        new = price(value, capacity)
        if value[sizes - 1] @ new[sizes - 1] <= 1 + 1e-7:
            break
        d = inverse @ new[sizes - 1]
        steps = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(steps.argmin())
        step = steps[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        basis[out] = new
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
    times = np.floor(x + 1e-6).astype(np.int64)
    left = demand - times @ basis
    while (left < 0).any():  # the tolerance above rounded one up
        over = int(np.flatnonzero(left < 0)[0])
        p = int(np.flatnonzero((basis[:, over] > 0) & (times > 0))[0])
        times[p] -= 1
        left = left + basis[p]
    rest = _best_fit(left)
    return np.concatenate([basis[times > 0], rest]), np.concatenate([times[times > 0], np.ones(len(rest), np.int64)])


def _best_fit(left: np.ndarray) -> np.ndarray:
    """Patterns for the rounding's remainder: the largest item first, into the fullest bin that takes it."""
    capacity = len(left)
    bins: list[np.ndarray] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for s in range(capacity, 0, -1):
        for _ in range(int(left[s - 1])):
            r = next((r for r in range(s, capacity) if room[r]), None)
            if r is None:
                bins.append(np.zeros(capacity, np.int64))
                b, r = len(bins) - 1, capacity
            else:
                b = room[r].pop()
            bins[b][s - 1] += 1
            room[r - s].append(b)
    return np.array(bins, np.int64).reshape(-1, capacity)


def _slots(patterns: np.ndarray, times: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """Per size: first rank, first sequence and place of each run of slots; a run is one
    place of a pattern over all the pattern's sequences."""
    first = np.concatenate([[0], np.cumsum(times)[:-1]]).astype(np.int64)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for p, pattern in enumerate(patterns):
        place = 0
        for s in np.flatnonzero(pattern)[::-1] + 1:
            for _ in range(pattern[s - 1]):
                runs.setdefault(int(s), []).append((int(times[p]), int(first[p]), place))
                place += 1
    out = {}
    for s, rows in runs.items():
        n, sequence, place = np.array(rows, np.int64).T
        out[s] = np.concatenate([[0], np.cumsum(n)[:-1]]), sequence, place
    return out


def pack(docs: DataFrame, capacity: int = 2048, grain: int = 8, vocabulary: str = "byte_bpe_50k",
         end_id: int = END_ID) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``capacity`` is a multiple of ``grain``."""
    rows = store(pieces(docs, capacity, vocabulary, end_id))
    size = F.ceil(F.col("length") / grain).cast("int")
    demand = np.zeros(capacity // grain, np.int64)
    for r in rows.groupBy(size.alias("size")).count().collect():  # at most capacity / grain rows
        demand[r["size"] - 1] = r["count"]
    runs = _slots(*patterns_of(demand))

    # Ranks within a size: parts of a size are numbered apart and shifted by the parts before.
    parts = max(256, int(demand.sum()) // 4096)
    rows = rows.select("*", size.alias("size"), F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).alias("part"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("size", "part").count().select(
        "size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("size", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.join(shift, ["size", "part"]).withColumn("rank", F.col("shift") + F.row_number().over(own) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                start, first, places = runs[int(s)]
                k = np.searchsorted(start, rank[at], "right") - 1
                sequence[at], slot[at] = first[k] + rank[at] - start[k], places[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(slot)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString() if c == 'doc_id' else 'long'}" for c in names)
    placed = ranked.select(*names[:5], "size", "rank").mapInArrow(place, kinds)
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names[:6], F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
