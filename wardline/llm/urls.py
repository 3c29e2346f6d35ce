"""URL filter by rules and, for what they don't cover, a path-template tree.

Rules label the urls they fit. Per host, paths form a tree of segments. Segments that are
numbers or codes become the wildcard ``*``, and so do those too rare at their node to be
literal, apart for unlabelled, mostly blocked and mostly allowed ones;
siblings whose shares of blocked labels don't differ statistically become one branch. A host
is split, and then every branch that holds labels of both kinds, to whatever depth its paths
have. A url without a rule is blocked if the deepest labelled branch on its way (below the
host itself) has a smoothed purity of blocked labels of at least ``least``.

All of it is joins and aggregates of distinct templates, a round per level; a round has only
the paths of branches that are split, and the rest is done. A node keeps at most
``1 / share`` literal children, so a window per node is small whatever the host's size.

Cases: a null url or one without ``://`` has an empty host and path, no rule and is allowed;
so is every branch without labels. Repeated rows count each; other columns are not read."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Numbers, dates, hashes and names with a number, with any file ending.
_VARIABLE = r"^[0-9a-f]{8,}([.][A-Za-z0-9]+)?$|^[^.]*[0-9][^.]*([.][A-Za-z0-9]+)?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_rule(rules: list[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest rule that fits ``host`` and ``path``; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == r[1]) | F.endswith("host", F.lit(f".{r[1]}"))) & F.startswith("path", F.lit(r[2]))
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def _level(paths: DataFrame, k: int, share: float, least_rows: int) -> DataFrame:
    """``paths`` (host, parts, n, labelled, blocked, branch, purity) with their branch on level ``k`` + 1 and
    the purity there if it has labels. ``split``: it holds labels of both kinds, and the path goes on."""
    at = ["host", "branch"]
    here = paths.withColumn("segment", F.get("parts", k))
    kids = here.groupBy(*at, "segment").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
    nodes = kids.groupBy(*at).agg(F.sum("n").alias("of"))
    literal = (F.col("segment") == "*") | (F.col("n") >= F.greatest(F.lit(least_rows), F.col("of") * share))
    kids = kids.join(nodes, at).withColumn("kept", F.when(literal, F.col("segment")).when(
        F.col("labelled") == 0, "*").when(2 * F.col("blocked") >= F.col("labelled"), "*blocked").otherwise("*allowed"))
    kept = kids.groupBy(*at, "kept").agg(F.sum("labelled").alias("labels"), F.sum("blocked").alias("bad"))
    kept = kept.withColumn("rate", (F.col("bad") + 1) / (F.col("labels") + 2))
    order = Window.partitionBy(*at, F.col("labels") > 0).orderBy("rate", "kept")
    last_rate, last_n = F.lag("rate").over(order), F.lag("labels").over(order)
    both = (F.col("rate") * F.col("labels") + last_rate * last_n) / (F.col("labels") + last_n)
    spread = F.sqrt(both * (1 - both) * (1 / F.col("labels") + 1 / last_n))
    differs = last_rate.isNull() | (F.col("labels") == 0) | (F.col("rate") - last_rate > 1.96 * spread)
    kept = kept.withColumn("new", differs.cast("int")).withColumn("class", F.sum("new").over(order))
    same = Window.partitionBy(*at, F.col("labels") > 0, "class")
    kept = kept.select(*at, "kept", F.concat("branch", F.lit("/"), F.min("kept").over(same)).alias("next"),
                       F.sum("labels").over(same).alias("labels"), F.sum("bad").over(same).alias("bad"))
    names = kids.select(*at, "segment", "kept").join(kept, [*at, "kept"]).drop("kept")
    return here.join(names, [*at, "segment"]).select(
        "host", "parts", "n", "labelled", "blocked", F.col("next").alias("branch"),
        F.when(F.col("labels") > 0, (F.col("bad") + 1) / (F.col("labels") + 2)).otherwise(F.col("purity")).alias("purity"),
        ((F.col("bad") > 0) & (F.col("bad") < F.col("labels")) & (F.size("parts") > k + 1)).alias("split"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, share: float = 0.02,
                 least_rows: int = 5, least: float = 0.7) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = rows.select("*", F.transform(segments, lambda x: F.when(x.rlike(_VARIABLE), "*").otherwise(x)).alias("parts"),
                       _longest_rule(rules, lambda r: r[1] + r[2]).alias("rule"), _longest_rule(rules, lambda r: r[0]).alias("ruled"))
    level = store(rows.groupBy("host", "parts").agg(
        F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
        .select("*", F.lit("").alias("branch"), F.lit(None).cast("double").alias("purity"), (F.size("parts") > 0).alias("split")))
    found, k = level.where("not split"), 0
    while not (more := level.where("split")).isEmpty():  # each level is stored: the next one reads it several times
        level, k = store(_level(more, k, share, least_rows)), k + 1
        found = found.union(level.where("not split"))
    found = found.select("host", "parts", (F.coalesce("purity", F.lit(0.0)) >= least).alias("bad"))
    return rows.join(found, ["host", "parts"]).select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
