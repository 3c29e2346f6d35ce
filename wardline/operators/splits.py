"""Held-out splits by whole election districts, and geographic clusters of districts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.ids import DRAW_BITS, draw
from ..session import cut
from .groups import running_sums

# A split bucket: the leading bits of the shuffle hash.
_HASH_BITS = 10


def _shuffled(eds: DataFrame, seed: int, key: str) -> DataFrame:
    h = draw(F.lit(seed), F.col(key))
    return eds.withColumns({"__h": h, "__hb": F.call_function("shiftright", h, F.lit(DRAW_BITS - _HASH_BITS))})


def split_by_people(people: DataFrame, seed: int, train: float = 0.8, val: float = 0.1,
                    ed: str = "ed_key", county: str = "county") -> DataFrame:
    """(ed_key, county, n_persons, split): districts in hash order within the county,
    cut where the running person count passes the shares. A district is never divided."""
    eds = people.groupBy(ed, county).agg(F.count(F.lit(1)).alias("n_persons"))
    run = running_sums(_shuffled(eds, seed, ed), [county], ["__hb"], ["__h", ed],
                       {"cum": F.col("n_persons")})
    totals = eds.groupBy(county).agg(F.sum("n_persons").alias("total"))
    j = run.join(totals, county)
    split = (F.when(F.col("cum") <= train * F.col("total"), "train")
             .when(F.col("cum") <= (train + val) * F.col("total"), "val").otherwise("test"))
    return j.select(ed, county, "n_persons", split.alias("split"))


def split_by_count(people: DataFrame, seed: int, ed: str = "ed_key_simple") -> DataFrame:
    """Variant: 80/10/10 of all districts by number, in hash order."""
    eds = people.select(ed).distinct()
    run = running_sums(_shuffled(eds, seed, ed), [], ["__hb"], ["__h", ed],
                       {"rank": F.lit(1).cast("bigint")})
    n = eds.agg(F.count(F.lit(1))).scalar()
    split = (F.when(F.col("rank") <= F.floor(n * 0.8), "train")
             .when(F.col("rank") <= F.floor(n * 0.9), "val").otherwise("test"))
    return run.select(ed, split.alias("split"))


def attach_split(people: DataFrame, splits: DataFrame, ed: str = "ed_key") -> DataFrame:
    return people.join(splits.select(ed, "split"), ed, "left")


def district_centroids(people: DataFrame, ed: str = "ed_key", county: str = "county") -> DataFrame:
    """(ed_key, county, lat, lon, n); districts without points take the mean of the others.

    Means are taken on decimals: bands and clusters must not depend on row order.
    """
    exact = lambda c: F.avg(F.col(c).cast("decimal(12,7)")).cast("double").alias(c)
    e = people.groupBy(ed).agg(F.min(county).alias(county), exact("lat"), exact("lon"),
                               F.count(F.lit(1)).alias("n"))
    mean = e.agg(F.struct(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
                 .alias("m")).scalar()
    return e.withColumns({"lat": F.coalesce(F.col("lat"), mean["lat"]),
                          "lon": F.coalesce(F.col("lon"), mean["lon"])})


def _quantile_edges(values: Column, q: Column) -> Column:
    """Distinct linear-interpolated edges 0/q .. q/q of a sorted array."""
    last = F.size(values) - 1

    def at(i: Column) -> Column:
        pos = last * i / q
        low = F.floor(pos).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, last))
        return a + (b - a) * (pos - low)

    return F.array_distinct(F.transform(F.sequence(F.lit(0), q), at))


def latitude_bands(eds: DataFrame, county: str = "county") -> DataFrame:
    """Band of each district: equal-count latitude cuts per county, repeated edges dropped."""
    lat = eds.groupBy(county).agg(F.array_sort(F.collect_list("lat")).alias("lats"))
    q = F.least(F.lit(20), F.greatest(F.lit(1), F.floor(F.size("lats") / 50))).cast("int")
    edges = lat.select(county, _quantile_edges(F.col("lats"), q).alias("edges"))
    below = F.size(F.filter("edges", lambda e: e < F.col("lat")))
    return (eds.join(edges, county)
            .withColumn("band", F.greatest(F.lit(0), below - 1)).drop("edges"))


def pack_districts(eds: DataFrame, target: int = C.CLUSTER_TARGET, ed: str = "ed_key",
                   county: str = "county") -> DataFrame:
    """Cluster per district: snake order within the county, closed at ``target`` persons.

    A district's pointer goes to the one after the first that fills a cluster begun at it, found among
    the running sums. The districts that begin a cluster are those that pointers reach from the county's
    first; pointers are doubled, so the rounds are the logarithm of the clusters, and every step is a join of small rows.
    """
    snake = F.col("lon") * F.when(F.col("band") % 2 == 0, 1).otherwise(-1)
    rows = eds.select(F.col(county).alias("county"), "band", snake.alias("s"), F.col(ed).alias("ed"), F.col("n").cast("bigint").alias("n"))
    placed = running_sums(rows, ["county"], ["band"], ["s", "ed"], {"sum": F.col("n"), "i": F.lit(1).cast("bigint")})
    placed = cut(placed.select("county", "band", "s", "ed", "i", "sum", "n"))
    # per district the first running sum that reaches the sum before it plus the target
    reached = placed.select("county", "i", F.col("sum").alias("at"), F.lit(1).alias("kind")).unionByName(
        placed.select("county", "i", (F.col("sum") - F.col("n") + target).alias("at"), F.lit(0).alias("kind")))
    later = Window.partitionBy("county").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    hit = F.min(F.when(F.col("kind") == 1, F.col("i"))).over(later)
    jump = cut(reached.withColumn("to", hit + 1).filter("kind = 0 and to is not null").select("county", "i", "to"))
    starts, n = placed.filter("i = 1").select("county", "i"), -1
    while True:
        starts = cut(starts.unionByName(starts.join(jump, ["county", "i"]).select("county", F.col("to").alias("i"))).distinct())
        before, n = n, starts.count()
        if n == before:
            break
        jump = cut(jump.join(jump.select("county", F.col("i").alias("to"), F.col("to").alias("far")), ["county", "to"])
                   .select("county", "i", F.col("far").alias("to")))
    begun = placed.join(starts.withColumn("begins", F.lit(1)), ["county", "i"], "left")
    numbered = running_sums(begun, ["county"], ["band"], ["s", "ed"], {"c": F.coalesce("begins", F.lit(0)).cast("bigint")})
    # one row per county
    offset = numbered.groupBy("county").agg(F.max("c").alias("used"))
    offset = running_sums(offset, [], [], ["county"], {"upto": F.col("used")}).select("county", (F.col("upto") - F.col("used")).alias("offset"))
    return numbered.join(offset, "county").select(F.col("ed").alias(ed), (F.col("c") - 1 + F.col("offset")).cast("int").alias("cluster"))


def assign_clusters(people: DataFrame, target: int = C.CLUSTER_TARGET, ed: str = "ed_key",
                    node: str = "person_row") -> DataFrame:
    """(person_row, cluster)."""
    packed = pack_districts(latitude_bands(district_centroids(people, ed)), target, ed)
    return people.select(node, ed).join(packed, ed).select(node, "cluster")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    n = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("clusters"), F.min("n").alias("smallest"),
                 F.floor(F.percentile("n", 0.5)).alias("median"), F.max("n").alias("largest"))
