"""Large JSON objects read in parts.

A file that is one object can't be split at lines. Here Spark's text reader splits it at closing
braces, wherever its byte ranges fall, and running sums along the file tell the fragments apart: first how
many quotes lie before each one, so whether it begins in a string, then how deep its braces are. Fragments
between two returns to the wanted depth are one record, parsed by itself. So no task needs
more than its byte range and no row more than one record."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import running_sums
from ..session import cut
from .files import in_file_order


def json_members(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(ordinal, text) of the objects that stand ``depth`` braces deep in the JSON files at ``path``: their
    text, preceded by what stands between them and the object before (a comma, their key, brackets).

    ``ordinal`` is the place of the object's first fragment in file order."""
    raw = in_file_order(spark, path, spark.read.option("lineSep", "}").text(path)).select(
        "ordinal", F.col("ordinal.file").alias("file"), F.col("ordinal.block").alias("block"), "value")
    # a backslash and what follows is never a brace or the end of a string
    plain = F.regexp_replace("value", r'\\.', "")
    raw = raw.withColumns({"plain": plain, "quotes": F.length(plain) - F.length(F.replace(plain, F.lit('"')))})
    parts = cut(raw)
    keys, split, order = ["file"], ["block"], ["ordinal"]
    placed = running_sums(parts.drop("value", "plain"), keys, split, order, {"upto": F.col("quotes").cast("bigint")})
    starts_in = (F.col("upto") - F.col("quotes")) % 2 == 1
    ends_in = F.col("upto") % 2 == 1
    placed = placed.select("ordinal", starts_in.alias("starts_in"), ends_in.alias("ends_in"))
    bare = F.regexp_replace(F.concat(F.when(F.col("starts_in"), '"').otherwise(""), "plain"), r'"[^"]*("|\z)', "")
    opened = F.length(bare) - F.length(F.replace(bare, F.lit("{")))
    deep = parts.join(placed, "ordinal").withColumns({"opened": opened.cast("bigint"), "closed": (~F.col("ends_in")).cast("bigint")})
    deep = running_sums(deep.select("ordinal", "file", "block", "opened", "closed"), keys, split, order, {
        "depth": F.col("opened") - F.col("closed")})
    # a record ends where the wanted depth is reached again by a closing brace
    ends = (F.col("closed") == 1) & (F.col("depth") == depth)
    deep = cut(deep.select("ordinal", "file", "block", "opened", "depth", "closed", ends.cast("bigint").alias("ends")))
    numbered = running_sums(deep, keys, split, order, {"record": F.col("ends")})
    numbered = numbered.select("ordinal", "file", (F.col("record") - F.col("ends")).alias("record"), "ends", "closed")
    # fragments of the file's end are no record
    whole = F.max("ends") == 1
    pieces = parts.select("ordinal", "value").join(numbered, "ordinal")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.concat("value", F.lit("}")).alias("t")))),
                                    lambda p: p["t"]), "")
    return pieces.groupBy("file", "record").agg(F.min("ordinal").alias("ordinal"), text.alias("text"), whole.alias("whole")) \
        .filter("whole").select("ordinal", "text")


def keyed_members(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(ordinal, key, value) of a file that is one object of objects; ``value`` is their type as DDL."""
    body = F.regexp_replace("text", r"^[\s,{]*", "")
    parsed = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), f"map<string, {value}>")
    return json_members(spark, path).select("ordinal", F.explode(parsed).alias("key", "value"))


def listed_members(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(ordinal, value) of the objects in the arrays of a file that is one object, such as the features
    of a layer. Objects that are no members of an array give nulls where the type's fields lack."""
    body: Column = F.regexp_extract("text", r"(?s)^[^{}]*?(?:\{[^{}]*?\[\s*)?(\{.*\})$", 1)
    return json_members(spark, path).select("ordinal", F.from_json(body, value).alias("value"))
