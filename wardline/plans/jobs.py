"""The two batch jobs and the donor refresh, as chains of operators cut at stored stages."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates
from ..operators import (context, donations, geocode, graph, history, households, matching, people,
                         splits)
from ..sources import files, sinks


def build_person_tables(homes: DataFrame, gifts: DataFrame, target: int, ref_year: int,
                        folder: str) -> dict:
    """Household rows (with household_row, lon, lat) to people, ballots, donors and history.

    Each stage is written once and read back, so a lost executor costs one stage.
    """
    cutoff = dates.election_day(target)
    parsed = people.with_people(homes)
    persons = people.with_person_ids(people.number_people(people.explode_people(parsed)))
    persons = persons.withColumn("ed_key", F.concat_ws(
        "|", "county", F.coalesce(F.col("assembly_district").cast("string"), F.lit("nan")),
        F.coalesce(F.col("election_district").cast("string"), F.lit("nan"))))
    persons = persons.withColumn("has_geo", F.col("lat").isNotNull().cast("int"))
    base = sinks.write_stage(persons, f"{folder}/persons_base")
    ballots = sinks.write_stage(people.explode_ballots(base), f"{folder}/ballots")
    donors = sinks.write_stage(donations.donor_committees(base, gifts, cutoff), f"{folder}/donors")
    wide = context.with_labels(base.drop("elections", "history"), ballots, target, ref_year)
    wide = context.district_shares(context.household_shares(wide.drop("household_size")))
    wide = donations.attach_donation_features(wide, donations.donation_features(gifts, cutoff))
    full = sinks.write_stage(wide, f"{folder}/persons", ["county"])
    hist = sinks.write_stage(history.history_features(full, ballots, target, ref_year),
                             f"{folder}/history")
    check_alignment(full, hist)
    return {"people": full, "ballots": ballots, "donors": donors, "history": hist,
            "segments_schema": schemas.SEGMENT}


def build_from_files(spark: SparkSession, paths: list[str], segments: DataFrame, gifts: DataFrame, target: int,
                     ref_year: int, folder: str) -> dict:
    """Voter files to people, ballots, donors and history: rows are numbered in file order and geocoded first."""
    homes = files.number_rows(files.read_households(spark, paths)).drop("ordinal")
    placed = sinks.write_stage(geocode.geocode(homes, segments), f"{folder}/homes")
    return build_person_tables(placed, gifts, target, ref_year, folder)


def check_alignment(persons: DataFrame, hist: DataFrame, key: str = "person_row") -> None:
    """Every person has exactly one history row."""
    twice = hist.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not (persons.join(hist, key, "left_anti").isEmpty()
            and hist.join(persons, key, "left_anti").isEmpty() and twice.isEmpty()):
        raise ValueError("history rows do not match the persons table")


def build_graph(persons: DataFrame, donors: DataFrame, folder: str, seed: int,
                steps: int = 16) -> dict[str, DataFrame]:
    """Typed edges, clusters, splits and random-walk encodings, each stored."""
    edges = sinks.write_stage(graph.build_edges(persons, donors, seed), f"{folder}/edges")
    clusters = sinks.write_stage(splits.assign_clusters(persons), f"{folder}/clusters")
    parts = sinks.write_stage(splits.split_by_people(persons, seed), f"{folder}/splits")
    walks = graph.random_walk_encoding(graph.both_directions(edges), clusters, steps)
    return {"edges": edges, "clusters": clusters, "splits": parts,
            "walks": sinks.write_stage(walks, f"{folder}/walks")}


def build_district_payload(homes: DataFrame, segments: DataFrame, path: str) -> str:
    """Geocoded, scored household records per county and district, text as codes."""
    kept = homes.na.drop(subset=["address_number", "street_name"]).filter("address_number <> ''")
    placed = geocode.geocode(kept, segments)
    scored = people.with_people(placed).withColumn(
        "score", households.canvass_score(F.col("people"))).select("*", "score.*").drop("score")
    ordinal = "household_row"
    codes = {c: geocode.first_seen_codes(scored, c, ordinal) for c in ("street_name", "city")}
    sinks.write_district_payload(sinks.encoded_records(scored, codes), path)
    return path


def refresh_matches(voters: DataFrame, records: DataFrame, entries: DataFrame, stored: DataFrame,
                    now: dt.datetime, folder: str) -> dict[str, DataFrame]:
    """Weekly step: due voters are matched again and merged into the cache.

    ``voters``: key, name, city, zip. ``entries`` and ``stored`` are the cache's
    entry and record tables.
    """
    due = voters.join(entries, "key", "left").filter(matching.needs_query(now)).select(
        "key", "name", "city", "zip")
    found = sinks.write_stage(matching.match_by_name(due, records), f"{folder}/found")
    at: Column = F.lit(now)
    merged = sinks.write_stage(matching.merge_entries(entries, matching.match_entries(found, at)),
                               f"{folder}/entries")
    kept = matching.merge_records(stored, found, merged)
    return {"entries": merged, "records": sinks.write_stage(kept, f"{folder}/records")}


def build_prospect_list(persons: DataFrame, gifts: DataFrame, district: int, ref_date: dt.date,
                        path: str) -> None:
    """Scored unaffiliated people of one district as CSV, best first."""
    prospects = donations.prospect_people(persons, district)
    records = donations.lookup_by_both_names(prospects, gifts)
    ranked = donations.prospect_list(prospects, donations.prospect_summary(records, ref_date))
    columns = ["first_name", "last_name", "address", "city", "zip", "age", "party",
               "assembly_district", "tier", "tier_letter", "tier_count", "num_elections_voted",
               "voting_history", "has_donation", "total_donated", "fec_total", "nyboe_total",
               "num_donations", "last_donation_date", "committees", "dem_donor", "dem_total",
               "dem_committees", "recent_donor", "donor_score"]
    sinks.write_list(ranked.select(*columns), path)
