"""Ranks, running sums and peers that stay balanced when one group is huge.

A plain window over a key sends the whole key to one task. The helpers here cut
a group into parts first, sum the parts, and add each part's offset, so that no
task sees more than one part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import DRAW_BITS, draw

#: A group is cut into at most 2 ** PART_BITS parts by the leading bits of a hash.
PART_BITS = 10


def running_sums(df: DataFrame, keys: list[str], split: list[str], order: list,
                 values: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key in the order (split, order).

    ``split`` columns are the leading part of the order; they and the keys must
    not be null. Rows are windowed per (key, split) part. The parts' own running
    sums are taken the same way, one split column less at a time, so each window
    stays as small as one part.
    """
    temp = {n: f"__{n}_v" for n in values}
    valued = df.withColumns({temp[n]: c for n, c in values.items()})
    window = (Window.partitionBy(*keys, *split).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    # Spread by part, not by key alone: an input that is already placed by key
    # would otherwise satisfy the window and leave a hot key in one task.
    spread = valued.repartition(*keys, *split) if split else valued
    local = spread.withColumns({n: F.sum(temp[n]).over(window) for n in values}).drop(*temp.values())
    if not split:
        return local
    parts = valued.groupBy(*keys, *split).agg(*[F.sum(t).alias(t) for t in temp.values()])
    upto = running_sums(parts, keys, split[:-1], [split[-1]],
                        {f"__{n}_u": F.col(t) for n, t in temp.items()})
    offsets = upto.select(*keys, *split, *[(F.col(f"__{n}_u") - F.col(t)).alias(f"__{n}_o")
                                           for n, t in temp.items()])
    joined = local.join(offsets, keys + split, "left")
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__{n}_o")).alias(n) for n in values])


def ordered_rank(df: DataFrame, keys: list[str], split: list[str], order: list,
                 name: str = "rank") -> DataFrame:
    """1-based row number per key in the order (split, order); the order must be total."""
    return running_sums(df, keys, split, order, {name: F.lit(1).cast("bigint")})


def first_n(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """First n rows per key. The rank filter is pushed below the shuffle by Spark
    (window group limit), so a hot key sends at most n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def group_positions(df: DataFrame, keys: list[str], node: str, seed: int = 0,
                    part_bits: int = PART_BITS, pos: str = "pos", size: str = "size") -> DataFrame:
    """Give every row of a group a position 0..size-1, in a fixed pseudo-random order.

    The order is that of a hash of the node. Parts are the leading bits of that
    hash, so the positions do not depend on how many parts there are.
    """
    h = draw(F.lit(seed), F.col(node))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
    placed = df.join(sizes, keys).withColumns({
        "__h": h, "__part": F.call_function("shiftright", h, F.lit(DRAW_BITS - part_bits))})
    ranked = ordered_rank(placed, keys, ["__part"], ["__h", node], "__rank")
    return ranked.withColumn(pos, F.col("__rank") - 1).drop("__h", "__part", "__rank")


def chunked_lists(df: DataFrame, keys: list[str], split: list[str], order: list,
                  item: Column, chunk: int, name: str = "items") -> DataFrame:
    """Ordered lists per key in pieces of at most ``chunk`` items: (keys, part, items)."""
    ranked = ordered_rank(df.withColumn("__item", item), keys, split, order, "__rank")
    ranked = ranked.withColumn("part", F.floor((F.col("__rank") - 1) / F.lit(chunk)))
    return (ranked.groupBy(*keys, "part")
            .agg(F.array_sort(F.collect_list(
                F.struct(F.col("__rank").alias("r"), F.col("__item").alias("v")))).alias("__l"))
            .select(*keys, "part", F.transform("__l", lambda s: s["v"]).alias(name)))


def latest_by(df: DataFrame, keys: list[str], value: Column, order: Column, name: str) -> DataFrame:
    """Value of the last row per key (``max_by`` combines before the shuffle)."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def constant(df: DataFrame) -> Column:
    """A one-row, one-column frame as a scalar subquery."""
    return df.scalar()
