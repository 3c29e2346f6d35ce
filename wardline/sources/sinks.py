"""Writers. Stages are versioned: each run writes to a new path, an existing one is refused.
Tables that runs write back to are kept by ``versions``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import first_n
from . import versions


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Parquet stage output, returned as read back (this also cuts the lineage)."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_columns(table: DataFrame, fresh: DataFrame, key: str, prefix: str, extra: list[str],
                    new_path: str) -> DataFrame:
    """Drop columns by prefix, join their new values and write the next version."""
    old = [c for c in table.columns if c.startswith(prefix) or c in extra]
    return write_stage(table.drop(*[c for c in old if c != key]).join(fresh, key, "left"), new_path)


def write_district_payload(records: DataFrame, path: str) -> None:
    """Gzipped JSON lines per county and assembly district."""
    (records.write.mode("overwrite").partitionBy("county", "assembly_district")
     .option("compression", "gzip").json(path))


def write_donor_payload(payload: DataFrame, path: str) -> None:
    payload.write.mode("overwrite").option("compression", "gzip").json(path)


def insert_absent(existing: DataFrame, batch: DataFrame, keys: list[str],
                  order: list[str | Column]) -> DataFrame:
    """Rows of the batch to append: the first per key, and only keys not stored yet.

    Applied to households and to people on their own keys, so that people of a
    household that is already stored are still added under its id.
    """
    fresh = first_n(batch, keys, order, 1, "__rn").drop("__rn")
    return fresh.join(existing.select(*keys), keys, "left_anti")


def load_absent(batch: DataFrame, folder: str, keys: list[str], order: list[str | Column], run: str) -> DataFrame:
    """Add the absent rows of a batch to a stored table, once per run."""
    return versions.update(batch.sparkSession, folder, lambda t: t.unionByName(
        insert_absent(t, batch, keys, order).select(t.columns)), run)


def store_scores(scores: DataFrame, folder: str, run: str, key: str = "person_id") -> DataFrame:
    """Write scores back to the stored people, once per run."""
    return versions.update(scores.sparkSession, folder, lambda t: write_scores_back(t, scores, key), run)


def reload_donations(rows: DataFrame, path: str) -> DataFrame:
    """Truncate and reload. No unique key exists, so nothing is dropped."""
    return write_stage(rows.select("donor_key", "source", "donation_date",
                                   F.col("amount").cast("decimal(10,2)").alias("amount"),
                                   "committee", "confirmed"), path)


def upsert(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Full outer join on the key; the new side wins as a whole row."""
    cols = [c for c in existing.columns if c != key]
    j = existing.select(key, F.struct(*cols).alias("o")).join(
        fresh.select(key, F.struct(*cols).alias("n")), key, "full")
    return j.select(key, F.coalesce("n", "o").alias("r")).select(key, "r.*")


def write_scores_back(people: DataFrame, scores: DataFrame, key: str = "person_id") -> DataFrame:
    """People with the new probabilities, 4 digits as stored; unscored rows keep theirs."""
    mapping = {"turnout_prob": "turnout_propensity", "dem_lean_prob": "p_dem_lean",
               "rep_lean_prob": "p_rep_lean"}
    s = scores.select(key, *[F.round(v, 4).alias(f"__{k}") for k, v in mapping.items()])
    out = people.join(s, key, "left")
    for k in mapping:
        out = out.withColumn(k, F.coalesce(F.col(f"__{k}"), F.col(k)) if k in people.columns
                             else F.col(f"__{k}")).drop(f"__{k}")
    return out


def write_list(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def encoded_records(households: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Household records with dictionary codes in place of text, districts as numbers."""
    out = households
    for column, table in codes.items():
        out = out.join(table.withColumnRenamed("code", f"{column}_code"), column, "left").drop(column)
    return out.withColumn("assembly_district", F.col("assembly_district").try_cast("int"))
