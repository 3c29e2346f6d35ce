"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of whole numbers; queries and candidates meet in cells of a grid
of bounded blocks. In a cell every dimension is a term: its postings (rows and values of the
candidates) are scattered, times the query's weight, into dense score arrays, from which a
partition selection takes each query's best. A ranking window merges the cells.

Cases: vectors that are null or hold null or non-finite components take no part; of vectors
of different length the missing components are 0; ties go to the smaller id; a row whose id
equals the query's is its own; identical query rows count once; sums are 64-bit."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, partitions

#: Queries and candidates of one cell.
CELL = (1024, 8192)
_ROWS = 128  # queries whose score arrays exist at once


def valid(vector: str) -> Column:
    """All components are there and finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    size = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat.flatten().to_numpy()
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all pairs, one term after the other."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(queries.shape[1]):
        rows = np.flatnonzero(candidates[:, term])
        asking = np.flatnonzero(queries[:, term])
        if len(rows) == len(candidates) and len(asking) == len(queries):
            scores += queries[:, term, None] * candidates[None, :, term]
        elif len(rows) and len(asking):
            scores[np.ix_(asking, rows)] += queries[asking, term, None] * candidates[None, rows, term]
    return scores


def best(scores: np.ndarray, open_: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest open scores, the leftmost on ties."""
    at = np.flatnonzero(open_)
    s = scores[at]
    if len(at) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        above, ties = np.flatnonzero(s > least), np.flatnonzero(s == least)
        at = at[np.concatenate([above, ties[:k - len(above)]])]
    return at


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` best of ``candidates(vec_id, embedding)`` for each row
    of ``queries`` but its own, by the inner product of floor(scale * component)."""
    def whole(df: DataFrame) -> DataFrame:
        return df.where(valid("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.transform(
            "embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))

    asked, given = whole(queries).dropDuplicates(["vec_id", "v"]), whole(candidates)
    (nq, of_q), (nc, of_c) = (df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first() for df in (asked, given))
    dims = max(of_q, of_c)
    blocks_q, blocks_c = -(-nq // CELL[0]) or 1, -(-nc // CELL[1]) or 1

    def dealt(df: DataFrame, own: int, other: int, flag: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(own)).cast("int")
        all_ = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        a, b = (mine.alias("qb"), all_.alias("cb")) if flag == 0 else (all_.alias("qb"), mine.alias("cb"))
        return df.select(a, b, F.lit(flag).alias("side"), "vec_id", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 2):
            side, ids = t["side"].to_numpy(), t["vec_id"].to_numpy()
            rows = _matrix(t["v"], dims)
            cut = int(np.searchsorted(side, 1))
            q, c, cid = rows[:cut], rows[cut:], ids[cut:]
            for lo in range(0, cut, _ROWS):
                scores = accumulate(q[lo:lo + _ROWS], c)
                out = []
                for i, row in enumerate(scores):
                    at = best(row, cid != ids[lo + i], k)
                    out.append((np.full(len(at), lo + i), at, row[at]))
                i, at, score = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array([zlib.crc32(q[x].tobytes()) for x in i], pa.int64()),
                                                  pa.array(cid[at]), pa.array(score)], ["query_id", "of", "vec_id", "score"])

    both = dealt(asked, blocks_q, blocks_c, 0).union(dealt(given, blocks_c, blocks_q, 1))
    cells = both.repartition(partitions(queries.sparkSession), "qb", "cb").sortWithinPartitions("qb", "cb", "side", "vec_id")
    found = cells.mapInArrow(work, "query_id long, of long, vec_id long, score long")
    order = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
