from pyspark.sql import functions as F
from pyspark.sql import Window

from wardline.operators import groups, people


def _skewed(spark, n=3000):
    """One key holds well over a third of the rows."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 5 < 3, 0).otherwise(F.col("id") % 50).alias("k"),
                                 F.floor(F.col("id") * 7919 % 1000 / 100).alias("b"),
                                 (F.col("id") * 7919 % 1000).alias("x"))


def test_ordered_rank_equals_one_window(spark):
    df = _skewed(spark)
    got = groups.ordered_rank(df, ["k"], ["b"], ["x", "id"], "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("b", "x", "id")))
    assert got.select("id", "r").exceptAll(want.select("id", "r")).count() == 0
    assert got.count() == df.count()


def test_running_sums_by_two_levels(spark):
    df = _skewed(spark).withColumn("c", F.floor(F.col("x") / 10))
    got = groups.running_sums(df, [], ["b", "c"], ["x", "id"], {"s": F.col("x"), "n": F.lit(1).cast("bigint")})
    w = Window.orderBy("b", "c", "x", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("x").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    assert got.select("id", "s", "n").exceptAll(want).count() == 0


def test_group_positions_are_a_bijection_when_groups_are_cut(spark):
    df = _skewed(spark)
    got = groups.group_positions(df, ["k"], "id")
    bad = got.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("d"),
                               F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("size").alias("s")) \
        .filter("n <> d or lo <> 0 or hi <> n - 1 or s <> n")
    assert bad.count() == 0 and got.count() == df.count()
    for bits in (1, 4):  # the draws do not depend on the number of parts
        again = groups.group_positions(df.repartition(3), ["k"], "id", part_bits=bits)
        assert got.select("id", "pos").exceptAll(again.select("id", "pos")).count() == 0


def test_hot_group_is_spread_over_tasks(spark):
    """The window of a cut group runs on (key, part), not on the key alone."""
    plan = groups.group_positions(_skewed(spark), ["k"], "id") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_number_people_follows_file_order(spark):
    df = spark.range(500).select(F.floor(F.col("id") / 3).alias("household_row"), (F.col("id") % 3).alias("member"))
    got = people.number_people(df, block=7).collect()
    assert all(r["person_row"] == r["household_row"] * 3 + r["member"] for r in got)


def test_first_n_limits_before_the_shuffle(spark):
    df = groups.first_n(_skewed(spark), ["k"], ["x", "id"], 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert df.groupBy("k").count().filter("count > 3").count() == 0


def test_chunked_lists_keep_every_item(spark):
    df = _skewed(spark)
    got = groups.chunked_lists(df, ["k"], ["b"], ["x", "id"], F.col("id"), 100)
    assert got.agg(F.sum(F.size("items"))).first()[0] == df.count()
    assert got.agg(F.max(F.size("items"))).first()[0] == 100
