"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one per half of the components, make a grid of cells. A vector lives in the
cell of its nearest codes. To find its partners it walks the cells in the multi-sequence order:
by the sum of both halves' squared distances to the cell (to the border between its own code's
region and the cell's). Every visited cell is checked exactly.

The walk stops at the sum that reaches a target recall. It is measured: partners of a bounded
sample of rows are found exactly among all rows, and the stop is where the target share of them
has been met (and of partners drawn around the sample at the least similarity, for data with few
real ones). A recall of 1 asks for the exact bound: a cell's border is never farther than a vector in it, so
at the squared distance of the least similarity no partner is left out.

A pair is found if either of both meets the other's cell, and counts for both then, so the
links are symmetric.

Equal vectors are one vector with a count. Cells of many homes or visitors are cut into
blocks that meet pairwise, so no task holds a whole cell; a block returns link counts and a
spanning forest, never its pairs.

Cases: null, zero, null-holding or non-finite vectors link with nothing and are their own
component; of different lengths the missing components are 0; repeated rows link with each
other; rows without an id take part but never name a component; labels are not read."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, partitions, store
from .search import valid
from .words import mix

_LAST = 1 << 62
#: Homes and visitors of one block.
CELL = (2048, 8192)


class Grid:
    """Codebooks of both halves, fitted to a sample, and how far a walk goes."""

    def __init__(self, sample: np.ndarray, codes: int, least: float):
        rng = np.random.RandomState(7)
        self.cut = sample.shape[1] // 2
        self.books = [self._fit(h, codes, rng) for h in self.halves(sample)]
        self.codes = max(len(b) for b in self.books)
        self.least = least
        # The distance to a cell's border is never more than to a vector in it; the rest is rounding.
        self.exact = self.reach = 2 - 2 * least + 1e-6

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.cut], x[:, self.cut:]

    @staticmethod
    def _fit(h: np.ndarray, codes: int, rng: np.random.RandomState) -> np.ndarray:
        points = np.unique(h, axis=0) if len(h) else np.zeros((1, h.shape[1]))
        c = points[rng.permutation(len(points))[:codes]].copy()
        for _ in range(12):
            near = ((c ** 2).sum(1) - 2 * h @ c.T).argmin(1)
            n = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, h)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        return c

    def places(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cell, and per half the squared distance to every code's region."""
        home, far = np.zeros(len(x), np.int64), []
        for h, c in zip(self.halves(x), self.books):
            d = (h ** 2).sum(1)[:, None] - 2 * h @ c.T + (c ** 2).sum(1)
            own = d.argmin(1)
            between = np.sqrt(np.maximum((c ** 2).sum(1)[:, None] - 2 * c @ c.T + (c ** 2).sum(1), 0))[own]
            gap = np.maximum(d - d[np.arange(len(h)), own][:, None], 0)
            far.append((gap / np.maximum(2 * between, 1e-12)) ** 2 * (between > 0))
            home = home * self.codes + own
        return home, far

    def costs(self, far: list[np.ndarray], row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The sums at which rows meet cells."""
        return far[0][row, cell // self.codes] + far[1][row, cell % self.codes]

    def walk(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, visited cell of each, home per row of the chunk): cells within reach, nearest first."""
        for lo in range(0, len(x), 256):
            home, far = self.places(x[lo:lo + 256])
            sums = far[0][:, :, None] + far[1][:, None, :]
            i, a, b = np.nonzero(sums <= self.reach)
            order = np.lexsort((sums[i, a, b], i))
            i, a, b = i[order], a[order], b[order]
            yield i + lo, a * self.codes + b, home

    def met(self, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The sum at which a walk first joins x[i] and y[j], from either side."""
        (hx, fx), (hy, fy) = self.places(x), self.places(y)
        return np.minimum(self.costs(fx, i, hy[j]), self.costs(fy, j, hx[i]))


#: Parts of the way to the exact bound that recall is measured at.
_STEPS = 1000


def set_reach(grid: Grid, one: DataFrame, asked: np.ndarray, ids: np.ndarray, dims: int, recall: float) -> None:
    """Stop walks where they have met the share ``recall`` of the partners of the rows ``asked``."""
    if recall >= 1 or not len(asked):
        return
    step = grid.exact / _STEPS

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(_STEPS + 1, np.int64)
        for b in batches:
            x, own = _unit(b.column(0), dims), b.column(1).to_numpy()
            for lo in range(0, len(x), 4096):
                i, j = np.nonzero((x[lo:lo + 4096] @ asked.T >= grid.least) & (own[lo:lo + 4096, None] != ids))
                if len(i):
                    found += np.bincount(np.ceil(grid.met(x[lo:lo + 4096], asked, i, j) / step).astype(int), minlength=_STEPS + 1)[:_STEPS + 1]
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["step", "pairs"])

    real = np.zeros(_STEPS + 1, np.int64)
    for k, n in one.select("embedding", "id").mapInArrow(partners, "step long, pairs long").groupBy("step").agg(F.sum("pairs")).collect():
        real[k] = n
    rng = np.random.RandomState(11)
    drawn = np.repeat(asked, 4, 0)
    side = rng.standard_normal(drawn.shape)
    side -= (side * drawn).sum(1, keepdims=True) * drawn
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    at = np.arange(len(drawn))
    made = np.bincount(np.minimum(np.ceil(grid.met(drawn, grid.least * drawn + (1 - grid.least ** 2) ** 0.5 * side, at, at) / step), _STEPS).astype(int),
                       minlength=_STEPS + 1)
    grid.reach = max(int(np.searchsorted(np.cumsum(n), recall * n.sum())) for n in (real, made)) * step


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy()
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column reaches."""
    x, y = np.nonzero(links)
    while True:
        a, b = left.copy(), right.copy()
        np.minimum.at(a, x, right[y])
        np.minimum.at(b, y, a[x])
        if (a == left).all() and (b == right).all():
            return a, b
        left, right = a, b


def near_vectors(vectors: DataFrame, least: float = 0.95, recall: float = 0.999, sample_rows: int = 20_000,
                 asked_rows: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. ``sample_rows`` bounds the rows (by id
    hash) that the codebooks are fitted to, ``asked_rows`` those whose partners set the stop of
    walks; every row is indexed and compared."""
    own = F.lit(_LAST) + F.shiftrightunsigned(F.xxhash64("embedding"), 2)
    rows = vectors.select("vec_id", F.coalesce(F.col("vec_id").cast("long"), own).alias("id"), "embedding", (
        valid("embedding") & F.exists("embedding", lambda x: x != 0)).alias("ok"))
    one = store(rows.where("ok").groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    n, dims = one.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    sample = one.select("embedding", "id").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow().combine_chunks()
    x = _unit(sample["embedding"].chunk(0), dims) if sample.num_rows else np.zeros((0, dims))
    codes = int(max(8, min(256, 2 * n ** 0.25)))  # cells grow as the root of the rows
    grid = Grid(x, codes, least)
    set_reach(grid, one, x[:asked_rows], sample["id"].to_numpy()[:asked_rows], dims, recall)
    cells = grid.codes ** 2

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, visits = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in batches:
            for _, cell, home in grid.walk(_unit(b.column(0), dims)):
                homes += np.bincount(home, minlength=cells)
                visits += np.bincount(cell, minlength=cells)
        at = np.flatnonzero(homes + visits)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, homes[at], visits[at])], ["cell", "homes", "visits"])

    split = np.ones((2, cells), np.int64)  # blocks of homes and of visitors per cell
    if n:
        for r in one.select("embedding").mapInArrow(tally, "cell long, homes long, visits long") \
                .groupBy("cell").agg(F.sum("homes"), F.sum("visits")).collect():  # at most codes squared rows
            split[0, r[0]], split[1, r[0]] = max(1, -(-r[1] // CELL[0])), max(1, -(-r[2] // CELL[1]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, hashed = _unit(b.column(0), dims), (mix(b.column(1).to_numpy().view(np.uint64)) >> np.uint64(1)).astype(np.int64)
            lo = 0
            for row, cell, home in grid.walk(x):
                for visitor, r, c in ((False, np.arange(lo, lo + len(home)), home), (True, row, cell)):
                    mine, other = split[int(visitor), c], split[1 - int(visitor), c]
                    at = np.repeat(np.arange(len(r)), other)
                    k = np.arange(len(at)) - np.repeat(np.cumsum(other) - other, other)
                    m = (hashed[r] % mine)[at]
                    h, v = (k, m) if visitor else (m, k)
                    part = b.take(pa.array(r[at]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[at]), pa.array(h), pa.array(v), pa.array(np.full(len(at), visitor)), *part.columns], names)
                lo += len(home)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            t = t.combine_chunks()
            cut = int(np.searchsorted(t["visitor"].to_numpy(), True))
            if cut in (0, t.num_rows):
                continue
            x = _unit(t["embedding"].chunk(0), dims)
            ids, n_of = t["id"].to_numpy(), t["n"].to_numpy()
            far = grid.places(x[:cut])[1]
            for lo in range(cut, t.num_rows, 512):
                v = slice(lo, lo + 512)
                links = (x[v] @ x[:cut].T >= least) & (ids[v][:, None] != ids[None, :cut])
                i, j = np.nonzero(links)
                if not len(i):
                    continue
                home = grid.places(x[v])[0]
                back = grid.costs(far, j, home[i]) <= grid.reach  # then j finds i, too, and counts it
                count = np.bincount(i, n_of[j], len(ids[v])).astype(np.int64)
                other = np.bincount(j[~back], n_of[lo + i[~back]], cut).astype(np.int64)
                a, b = _forest(links, ids[v], ids[:cut])
                out = [(ids[v], count, a, count > 0), (ids[:cut], other, b, (b != ids[:cut]) | (other > 0))]
                i, c, m = (np.concatenate([y[k][y[3]] for y in out]) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(c), pa.array(m)], ["id", "links", "reaches"])

    names = ["cell", "h", "v", "visitor", "embedding", "id", "n"]
    kind = one.schema["embedding"].dataType.simpleString()
    dealt = one.select("embedding", "id", "n").mapInArrow(deal, f"cell long, h long, v long, visitor boolean, embedding {kind}, id long, n long")
    dealt = dealt.repartition(partitions(vectors.sparkSession), "cell", "h", "v").sortWithinPartitions("cell", "h", "v", "visitor")
    found = store(dealt.mapInArrow(check, "id long, links long, reaches long"))
    closed = components(found.select(F.col("id").alias("u"), F.col("reaches").alias("v")))
    by_id = one.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(closed, "id", "left").select(
        F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"))
    component = F.coalesce("component", "id")
    return rows.join(by_id, F.col("ok") & (F.col("embedding") == F.col("e")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component < _LAST, component).alias("component_id"), (F.col("id") == component).alias("kept"))
