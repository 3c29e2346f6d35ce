"""Address-range geocoding against street segments."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..functions.rounding import round_half_even

BUCKET = 100


def segment_sides(segments: DataFrame) -> DataFrame:
    """Two rows per named segment: street, number range and ZIP of a side, in file order."""
    n = lambda c: text.house_number(F.col(c))
    named = segments.filter((F.coalesce("fullname", F.lit("")) != "") & (F.size("pts") >= 2))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), n("lfrom").alias("lo"), n("lto").alias("hi"),
                 F.coalesce("zipl", F.lit("")).alias("seg_zip")),
        F.struct(F.lit(1).alias("side"), n("rfrom").alias("lo"), n("rto").alias("hi"),
                 F.coalesce("zipr", F.lit("")).alias("seg_zip")))
    return named.select("county", text.normalize_street(F.col("fullname")).alias("street"),
                        "ordinal", "pts", F.explode(sides).alias("s")).select(
        "county", "street", "ordinal", "pts", "s.*")


def resolve_streets(addresses: DataFrame, sides: DataFrame) -> DataFrame:
    """Indexed street of each distinct (county, norm): itself, else its longest indexed
    token prefix. The choice looks at the street alone."""
    known = sides.select("county", "street").distinct()
    tokens = F.split(F.trim("norm"), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(tokens)),
                           lambda i: F.struct(i.alias("length"), F.array_join(
                               F.slice(tokens, F.lit(1), i), " ").alias("street")))
    names = addresses.select("county", "norm").distinct().filter(F.col("norm") != "")
    tried = names.select("county", "norm", F.explode(prefixes).alias("p")).select(
        "county", "norm", "p.*")
    return tried.join(known, ["county", "street"]).groupBy("county", "norm").agg(
        F.max_by("street", "length").alias("street"))


def _in_range(a: DataFrame, s: DataFrame) -> DataFrame:
    """Address-side pairs with the number inside the range.

    Each range is put on the level whose number cells are at least as wide as
    the range, so it covers one or two of them; an address is looked up on every
    level in use, and a wide range is met only by numbers near it.
    """
    usable = s.filter(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    usable = usable.withColumns({"low": F.least("lo", "hi"), "high": F.greatest("lo", "hi")})
    span = F.greatest(F.col("high") - F.col("low") + 1, F.lit(BUCKET)) / BUCKET
    usable = usable.withColumn("level", F.ceil(F.log2(span)).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level")) * BUCKET
    cells = usable.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
    levels = usable.agg(F.collect_set("level")).scalar()
    probes = a.withColumn("level", F.explode(levels)).withColumn("cell", F.floor(F.col("number") / size))
    return probes.join(cells, ["county", "street", "level", "cell"]).filter(
        F.col("number").between(F.col("low"), F.col("high"))).drop("level", "cell")


def geocode(addresses: DataFrame, segments: DataFrame, county: str = "county",
            number: str = "address_number", street: str = "street_name",
            zip_code: str = "zip_code") -> DataFrame:
    """Add lon and lat (5 digits) to addresses; null where no segment fits.

    The first hit in (segment, left before right) order whose ZIP agrees wins. If
    none agrees, a hit with a conflicting ZIP voids everything, else the first
    hit on a segment without ZIP is taken. Each distinct address is worked once.
    """
    keyed = addresses.withColumns({
        "__county": F.col(county), "__norm": text.normalize_street(F.col(street)),
        "__number": text.house_number(F.col(number)),
        "__zip": F.coalesce(zip_code, F.lit(""))})
    distinct = keyed.filter(F.col("__number").isNotNull()).select(
        F.col("__county").alias("county"), F.col("__norm").alias("norm"),
        F.col("__number").alias("number"), F.col("__zip").alias("zip")).distinct()
    sides = segment_sides(segments)
    placed = distinct.join(resolve_streets(distinct, sides), ["county", "norm"])
    hits = _in_range(placed, sides.drop("pts"))
    agrees = (F.col("zip") == "") | (F.col("seg_zip") == F.col("zip"))
    conflict = (F.col("zip") != "") & (F.col("seg_zip") != "") & (F.col("seg_zip") != F.col("zip"))
    seq = F.struct("ordinal", "side", "lo", "hi", F.col("street").alias("seg_street"))
    picked = hits.groupBy("county", "norm", "number", "zip").agg(
        F.min(F.when(agrees, seq)).alias("match"),
        F.min(F.when(~agrees & ~conflict, seq)).alias("fallback"),
        F.bool_or(~agrees & conflict).alias("conflict"))
    chosen = picked.withColumn("c", F.when(F.col("match").isNotNull(), F.col("match"))
                               .when(~F.col("conflict"), F.col("fallback")))
    chosen = chosen.filter(F.col("c").isNotNull()).select("county", "norm", "number", "zip", "c.*")
    # one row per segment carries the geometry; it joins after the choice is made
    shapes = sides.filter("side = 0").select("county", F.col("street").alias("seg_street"),
                                             "ordinal", "pts")
    frac = F.when(F.col("hi") != F.col("lo"), (F.col("number") - F.col("lo"))
                  / F.when(F.col("hi") != F.col("lo"), F.col("hi") - F.col("lo"))).otherwise(0.5)
    # the lambdas bind the point and each coordinate once
    point = F.transform(F.array(geometry.interpolate_along(F.col("pts"), frac)),
                        lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    rounded = F.transform(F.flatten(point), lambda c: round_half_even(c, 5))
    points = chosen.join(shapes, ["county", "seg_street", "ordinal"]).withColumn("xy", rounded).select(
        F.col("county").alias("__county"), F.col("norm").alias("__norm"),
        F.col("number").alias("__number"), F.col("zip").alias("__zip"),
        F.get("xy", F.lit(0)).alias("lon"), F.get("xy", F.lit(1)).alias("lat"))
    keys = ["__county", "__norm", "__number", "__zip"]
    base = [c for c in addresses.columns if c not in ("lon", "lat")]
    return keyed.join(points, keys, "left").select(*[keyed[c] for c in base], "lon", "lat")


def match_rate(geocoded: DataFrame) -> DataFrame:
    return geocoded.agg(F.count(F.lit(1)).alias("addresses"), F.count("lon").alias("geocoded"))


def major_roads(segments: DataFrame, lon_min: Column, lon_max: Column, lat_min: Column,
                lat_max: Column, classes: list[str]) -> DataFrame:
    """Major roads with any point in the box, as flat lat, lon lists of 5 digits."""
    inside = F.exists("pts", lambda p: p["x"].between(lon_min, lon_max)
                      & p["y"].between(lat_min, lat_max))
    flat = F.flatten(F.transform("pts", lambda p: F.array(
        round_half_even(p["y"], 5), round_half_even(p["x"], 5))))
    return (segments.filter(F.col("road_class").isin(classes) & (F.size("pts") >= 2) & inside)
            .select("county", F.coalesce("fullname", F.lit("")).alias("name"), "ordinal",
                    flat.alias("line")))


def first_seen_codes(df: DataFrame, value: str, ordinal: str, keys: list[str] | None = None,
                     block: int = 10_000) -> DataFrame:
    """0-based codes of distinct values in first-seen order (per key)."""
    from .groups import ordered_rank
    keys = keys or []
    seen = df.groupBy(*keys, value).agg(F.min(ordinal).alias("__first"))
    seen = seen.withColumns({"__b1": F.floor(F.col("__first") / F.lit(block * block)),
                             "__b2": F.floor(F.col("__first") / F.lit(block))})
    out = ordered_rank(seen, keys, ["__b1", "__b2"], ["__first", value], "code")
    return out.select(*keys, value, (F.col("code") - 1).alias("code"))
