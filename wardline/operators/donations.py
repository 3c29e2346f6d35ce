"""Donations: as-of filters, per-person features, summaries and served reports."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import ids, scores, text
from ..functions.rounding import round_half_even, safe_ratio
from .groups import chunked_lists


def _amount() -> Column:
    return F.coalesce(F.col("amount").cast("double"), F.lit(0.0))


def _money(c: Column | None = None) -> Column:
    """An amount as summed: exact to a hundredth of a cent, so that sums don't depend on the order of
    rows. They become doubles once, at the end."""
    return (F.col("amount") if c is None else c).try_cast("decimal(18,4)")


def parse_date(c: Column) -> Column:
    """``year-month-day`` text to a date; anything else to null."""
    t = c.cast("string")
    return F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(t, F.lit("y-M-d"))
                  .cast("date"))


def as_of_donations(donations: DataFrame, cutoff: dt.date, date: str = "donation_date") -> DataFrame:
    """Records dated strictly before the cutoff. Dateless records cannot be placed
    relative to it and are dropped as well."""
    return donations.withColumn(date, parse_date(F.col(date))).filter(F.col(date) < F.lit(cutoff))


def as_of_report(donations: DataFrame, cutoff: dt.date, date: str = "donation_date") -> DataFrame:
    """Per source: donors kept, records dropped at or after the cutoff, dateless records."""
    d = parse_date(F.col(date))
    per_key = donations.groupBy("source", "donor_key").agg(
        F.count_if(d < F.lit(cutoff)).alias("kept"),
        F.count_if(d >= F.lit(cutoff)).alias("post"), F.count_if(d.isNull()).alias("dateless"))
    return per_key.groupBy("source").agg(
        F.count_if(F.col("kept") > 0).alias("donors_kept"), F.sum("kept").alias("records_kept"),
        F.sum("post").alias("dropped_post_cutoff"), F.sum("dateless").alias("dropped_dateless"))


def as_of_donations_simple(donations: DataFrame, cutoff: dt.date,
                           date: str = "donation_date") -> DataFrame:
    """The variant's rule: dateless records are kept."""
    return donations.filter((F.col(date) < F.lit(cutoff)) | F.col(date).isNull())


def _conduit(names: list[str]) -> Column:
    return F.coalesce(F.upper("committee").isin(names), F.lit(False))


def donation_features(donations: DataFrame, cutoff: dt.date) -> DataFrame:
    """Per donor key over as-of, confirmed records.

    Sums are first taken per (key, source, committee), so the distinct committee
    count needs no expansion and a busy donor is combined before the shuffle.
    """
    d = (as_of_donations(donations.filter("confirmed"), cutoff)
         .withColumn("committee", F.coalesce("committee", F.lit(""))))
    parts = d.groupBy("donor_key", "source", "committee").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_money()).alias("total"),
        F.max("donation_date").alias("last"))
    per = parts.groupBy("donor_key").agg(
        *[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(f"{s}_n")
          for s in ("fec", "nyboe")],
        *[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("total"))), F.lit(0.0))
          .alias(f"{s}_total") for s in ("fec", "nyboe")],
        *[F.datediff(F.lit(cutoff), F.max(F.when(F.col("source") == s, F.col("last"))))
          .alias(f"{s}_recency_days") for s in ("fec", "nyboe")],
        F.coalesce(F.sum(F.when(_conduit(C.DEM_CONDUITS), F.col("total"))), F.lit(0.0))
        .alias("dem_conduit_total"),
        F.coalesce(F.sum(F.when(_conduit(C.REP_CONDUITS), F.col("total"))), F.lit(0.0))
        .alias("rep_conduit_total"),
        F.count_distinct("committee").alias("n_committees"))
    return per.withColumn("has_donation", F.lit(1))


def attach_donation_features(people: DataFrame, features: DataFrame) -> DataFrame:
    """Left join on donor key; people without donations get zeros and null recency."""
    out = people.join(features, "donor_key", "left")
    zeros = ["fec_n", "nyboe_n", "fec_total", "nyboe_total", "dem_conduit_total",
             "rep_conduit_total", "n_committees", "has_donation"]
    return out.fillna(0, zeros)


def donor_committees(people: DataFrame, donations: DataFrame, cutoff: dt.date) -> DataFrame:
    """One row per person and as-of confirmed record: (person_row, committee, source, amount)."""
    d = as_of_donations(donations.filter("confirmed"), cutoff).select(
        "donor_key", F.coalesce("committee", F.lit("")).alias("committee"), "source",
        _amount().alias("amount"))
    return people.select("person_row", "donor_key").join(d, "donor_key").drop("donor_key")


def donation_totals_simple(donations: DataFrame, cutoff: dt.date) -> DataFrame:
    """Variant aggregate per (donor key, source); dateless and possible records count."""
    d = as_of_donations_simple(donations, cutoff)
    parts = d.groupBy("donor_key", "source", "committee").agg(
        F.sum(_money()).alias("total"), F.count(F.lit(1)).alias("n"),
        F.max("donation_date").alias("last"))
    return parts.groupBy("donor_key", "source").agg(
        F.sum("total").cast("double").alias("total"), F.sum("n").alias("n"), F.max("last").alias("last_date"),
        F.count("committee").alias("n_committees"),
        F.coalesce(F.sum(F.when(_conduit(C.DEM_CONDUITS), F.col("total"))), F.lit(0.0)).alias("dem_conduit_total"),
        F.coalesce(F.sum(F.when(_conduit(C.REP_CONDUITS), F.col("total"))), F.lit(0.0)).alias("rep_conduit_total"))


def donation_features_simple(people: DataFrame, totals: DataFrame, cutoff: dt.date,
                             key: str = "person_row") -> DataFrame:
    """Both sources pivoted in one aggregate and joined once. The committee count
    adds the per-source distincts; never donated is 9999 days."""
    def of(source: str, c: str) -> Column:
        return F.max(F.when(F.col("source") == source, F.col(c)))

    wide = totals.groupBy("donor_key").agg(
        *[of(s, c).alias(f"{s}_{c}") for s in ("fec", "nyboe")
          for c in ("total", "n", "last_date", "n_committees", "dem_conduit_total",
                    "rep_conduit_total")])
    j = people.select(key, "donor_key").join(wide, "donor_key", "left")
    zero, never = F.lit(0), F.lit(C.NEVER_DONATED_DAYS_SIMPLE)

    def both(c: str) -> Column:
        return F.coalesce(F.col(f"fec_{c}"), zero) + F.coalesce(F.col(f"nyboe_{c}"), zero)

    return j.select(
        key, (both("n") > 0).cast("int").alias("has_donation_simple"),
        *[col for s in ("fec", "nyboe") for col in (
            F.coalesce(F.col(f"{s}_n"), zero).alias(f"{s}_n_simple"),
            F.coalesce(F.col(f"{s}_total"), F.lit(0.0)).alias(f"{s}_total_simple"),
            F.coalesce(F.datediff(F.lit(cutoff), F.col(f"{s}_last_date")), never)
            .alias(f"{s}_recency_days_simple"))],
        both("n_committees").alias("n_committees_simple"),
        both("dem_conduit_total").alias("dem_conduit_total_simple"),
        both("rep_conduit_total").alias("rep_conduit_total_simple"))


# ------------------------------------------------------------------- prospects

def lookup_by_both_names(people: DataFrame, donations: DataFrame, dedupe: bool = True,
                         first: str = "first_name", last: str = "last_name",
                         key: str = "person_row") -> DataFrame:
    """Confirmed records under FIRST LAST or LAST FIRST.

    With ``dedupe`` a record counts once per (source, date, amount, committee);
    without it a name that reads the same both ways counts twice, as in the
    second list of the source.
    """
    names = F.array(F.concat_ws(" ", F.upper(first), F.upper(last)),
                    F.concat_ws(" ", F.upper(last), F.upper(first)))
    keys = people.select(key, "city", "zip", F.posexplode(names).alias("variant", "n")).select(
        key, "variant", ids.donor_key(F.col("n"), F.col("city"), F.substring_index("zip", ".", 1))
        .alias("donor_key"))
    d = donations.filter("confirmed").select(
        "donor_key", "source", F.coalesce(F.col("donation_date").cast("string"), F.lit(""))
        .alias("date"), _amount().alias("amount"), F.coalesce("committee", F.lit(""))
        .alias("committee"), "ordinal")
    hits = keys.join(d, "donor_key").withColumn(
        "seq", F.struct(F.col("variant"), (F.col("source") == "fec").alias("fec_after"),
                        F.col("ordinal")))
    if dedupe:
        return hits.groupBy(key, "source", "date", "amount", "committee").agg(
            F.min("seq").alias("seq"))
    return hits.select(key, "source", "date", "amount", "committee", "seq")


def prospect_summary(records: DataFrame, ref_date: dt.date, key: str = "person_row") -> DataFrame:
    """Totals, counts, last date and sorted committees per person with a record.

    Dates are ISO text, empty when unknown.
    """
    amount, date = F.col("amount"), F.col("date")
    partisan = scores.is_partisan_committee(F.col("committee"))
    last = F.max(F.when(date != "", date))

    def cents(c: Column) -> Column:
        return round_half_even(F.coalesce(F.sum(_money(c)), F.lit(0.0)), 2)

    def joined(cond: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(
            F.when(cond & (F.col("committee") != ""), F.col("committee")))), "; ")

    agg = records.groupBy(key).agg(
        cents(amount).alias("total_donated"),
        cents(F.when(F.col("source") == "fec", amount)).alias("fec_total"),
        cents(F.when(F.col("source") == "nyboe", amount)).alias("nyboe_total"),
        F.count(F.lit(1)).alias("num_donations"),
        F.coalesce(last, F.lit("")).alias("last_donation_date"),
        joined(F.lit(True)).alias("committees"),
        F.max(partisan.cast("int")).alias("dem_donor"),
        cents(F.when(partisan, amount)).alias("dem_total"),
        joined(partisan).alias("dem_committees"))
    days = F.datediff(F.lit(ref_date), parse_date(F.col("last_donation_date")))
    return (agg.withColumn("has_donation", F.lit(1))
            .withColumn("recent_donor", F.coalesce(
                (days <= C.RECENCY_WINDOW_DAYS).cast("int"), F.lit(0))))


def prospect_people(people: DataFrame, district: int | None = None,
                    party: str = C.UNAFFILIATED) -> DataFrame:
    """Unaffiliated people (of one assembly district) with split name, postal address
    and readable voting history."""
    p = people.filter(F.col("party") == party)
    if district is not None:
        p = p.filter(F.col("assembly_district") == district)
    given, family = text.split_given_family(F.col("name"))
    return p.withColumns({
        "first_name": given, "last_name": family, "zip": text.zip_plain(F.col("zip_code")),
        "address": text.postal_address(F.col("address_number"), F.col("street_name")),
        "num_elections_voted": text.history_count(F.col("history")),
        "voting_history": text.history_text(F.col("history"))})


def prospect_detail(records: DataFrame, key: str = "person_row", chunk: int = 500) -> DataFrame:
    """Newest-first text of every record, in numbered parts of at most ``chunk`` records,
    so that one prolific donor never becomes one giant cell."""
    line = F.array_join(F.filter(
        F.array("date", F.format_string("$%.2f", F.col("amount")), "committee",
                F.concat(F.lit("["), F.col("source"), F.lit("]"))), lambda p: p != ""), " ")
    back = records.withColumn("__age", -F.coalesce(
        F.unix_date(parse_date(F.col("date"))), F.lit(-800_000)))
    lists = chunked_lists(back, [key], ["__age"], ["seq", "source", "amount", "committee"],
                          line, chunk, "entries")
    return lists.select(key, "part", F.array_join("entries", "; ").alias("donations_detail"))


def prospect_list(people: DataFrame, summary: DataFrame, key: str = "person_row") -> DataFrame:
    """Score and order: partisan donors, donors, then score."""
    j = people.join(summary, key, "left").fillna(
        0, ["has_donation", "dem_donor", "recent_donor", "num_donations", "total_donated",
            "fec_total", "nyboe_total", "dem_total"]).fillna(
        "", ["last_donation_date", "committees", "dem_committees"])
    j = j.withColumn("donor_score", scores.prospect_score(
        F.col("has_donation") == 1, F.col("dem_donor") == 1, F.col("total_donated"),
        F.col("num_donations"), F.col("recent_donor") == 1, F.col("tier_count")))
    return j.orderBy(F.desc("dem_donor"), F.desc("has_donation"), F.desc("donor_score"), key)


# -------------------------------------------------------------- served reports

def donation_rows(cache: DataFrame) -> DataFrame:
    """Cache entries (key, source, confirmed, possible) to flat donation rows."""
    def side(name: str, confirmed: bool) -> DataFrame:
        return cache.select("key", "source", F.explode(name).alias("r")).select(
            F.upper("key").alias("donor_key"), "source",
            F.nullif(F.trim("r.date"), F.lit("")).try_cast("date").alias("donation_date"),
            F.col("r.amount").cast("double").alias("amount"),
            F.nullif(F.trim("r.committee"), F.lit("")).alias("committee"),
            F.lit(confirmed).alias("confirmed"))
    return side("confirmed", True).unionByName(side("possible", False))


def donor_summaries(donations: DataFrame) -> DataFrame:
    """Confirmed total and count per donor key. (The view is not defined in the
    source; confirmed-only is the choice made here.)"""
    return donations.filter("confirmed").groupBy("donor_key").agg(
        F.coalesce(F.sum(_money()), F.lit(0.0)).alias("total_donated"), F.count(F.lit(1)).alias("donation_count"))


def top_committees(donations: DataFrame, n: int = 12) -> DataFrame:
    d = donations.filter(F.col("confirmed") & F.col("committee").isNotNull()
                         & (F.col("committee") != ""))
    return (d.groupBy("committee").agg(F.count(F.lit(1)).alias("cnt"),
                                       F.coalesce(F.sum(_money()), F.lit(0.0)).alias("total"))
            .orderBy(F.desc("total"), "committee").limit(n))


def top_zips(donations: DataFrame, n: int = 10) -> DataFrame:
    """Distinct donors and sum per ZIP. Aggregated per donor first, so distinct is a count."""
    per_donor = donations.filter("confirmed").groupBy("donor_key").agg(
        F.sum(_money()).alias("t"))
    z = per_donor.withColumn("zip", ids.donor_key_part(F.col("donor_key"), 2))
    return (z.filter(F.col("zip").rlike("^[0-9]{4,5}$")).groupBy("zip")
            .agg(F.count(F.lit(1)).alias("donors"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("total"))
            .orderBy(F.desc("total"), "zip").limit(n))


def donation_meta(donations: DataFrame) -> DataFrame:
    per_donor = donations.groupBy("donor_key").agg(
        F.count_if("confirmed").alias("c"), F.count_if(~F.col("confirmed")).alias("p"),
        F.sum(F.when(F.col("confirmed"), _money())).alias("t"))
    return per_donor.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("confirmed_count"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("possible_count"),
        F.coalesce(F.sum("t"), F.lit(0.0)).alias("confirmed_total"),
        F.count_if(F.col("c") > 0).alias("confirmed_donors"))


def party_giving(donations: DataFrame, people: DataFrame) -> DataFrame:
    """Donors, sum and mean gift per party, and the share of the largest sum.

    A gift counts once for every person that shares its key, as in the source.
    Both sides are summed per key before the join, so a shared or busy key meets
    as one row per party instead of as all pairs.
    """
    gifts = donations.filter("confirmed").groupBy("donor_key").agg(
        F.sum(_money()).alias("s"), F.count("amount").alias("n"))
    holders = people.filter(F.col("party").isNotNull()).groupBy("donor_key", "party").agg(
        F.count(F.lit(1)).alias("k"))
    j = gifts.join(holders, "donor_key")
    out = j.groupBy("party").agg(
        F.count(F.lit(1)).alias("donors"),
        F.coalesce(F.sum(F.col("s") * F.col("k")), F.lit(0.0)).alias("total"),
        F.sum(F.col("n") * F.col("k")).alias("__gifts"))
    out = out.withColumn("avg", safe_ratio(F.col("total"), F.col("__gifts"))).drop("__gifts")
    return share_of_largest(out, "total").orderBy(F.desc("total"))


def share_of_largest(grouped: DataFrame, value: str, name: str = "share_of_largest") -> DataFrame:
    top = grouped.agg(F.max(value)).scalar()
    return grouped.withColumn(name, safe_ratio(F.col(value), top))


def search_donations(donations: DataFrame, query: str, by_committee: bool = False,
                     limit: int = 5000) -> DataFrame:
    """Newest matching rows; undated rows come first, as a descending SQL sort puts them."""
    q = query.strip().upper()
    if not q:
        return donations.limit(0)
    if by_committee:
        hit = F.upper("committee").contains(q) & F.col("confirmed")
    else:
        needle = f"|{q}" if q.isdigit() and 4 <= len(q) <= 5 else q
        hit = F.upper("donor_key").contains(needle)
    return donations.filter(hit).orderBy(
        F.col("donation_date").desc_nulls_first(), "donor_key", "ordinal").limit(limit)


def any_party(people: DataFrame) -> DataFrame:
    """One party per donor key (the alphabetically first), and the sole party if only one."""
    return people.groupBy("donor_key").agg(
        F.min("party").alias("party"),
        F.when(F.min("party") == F.max("party"), F.min("party")).alias("sole_party"))


def donor_cards(rows: DataFrame, people: DataFrame, n: int = 200) -> DataFrame:
    """Cards of the n biggest donors in a search slice (a bounded result page)."""
    rec = F.struct(F.coalesce("donation_date", F.lit("9999-12-31").cast("date")).alias("d"),
                   "ordinal", "source", "donation_date", "amount", "committee")
    cards = rows.groupBy("donor_key").agg(
        F.coalesce(F.sum(F.when(F.col("confirmed"), _money())), F.lit(0.0))
        .alias("total_confirmed"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("confirmed"), rec)))).alias("confirmed"),
        F.reverse(F.array_sort(F.collect_list(F.when(~F.col("confirmed"), rec)))).alias("possible"))
    top = cards.orderBy(F.desc("total_confirmed"), "donor_key").limit(n)
    party = any_party(people.join(top.select("donor_key"), "donor_key", "left_semi"))
    return (top.join(party.select("donor_key", "party"), "donor_key", "left")
            .select("donor_key", ids.donor_key_part(F.col("donor_key"), 0).alias("name"),
                    ids.donor_key_part(F.col("donor_key"), 1).alias("city"),
                    ids.donor_key_part(F.col("donor_key"), 2).alias("zip"),
                    "party", "total_confirmed", "confirmed", "possible")
            .orderBy(F.desc("total_confirmed"), "donor_key"))


def donor_card_totals(rows: DataFrame) -> DataFrame:
    """Totals over all donors of the slice, not just the first cards."""
    per = rows.groupBy("donor_key").agg(
        F.sum(F.when(F.col("confirmed"), _money())).alias("t"))
    return per.agg(F.count(F.lit(1)).alias("donors"),
                   F.coalesce(F.sum("t"), F.lit(0.0)).alias("total"))


def donor_payload(donations: DataFrame, chunk: int = 1000) -> DataFrame:
    """Confirmed records newest first with the donor's total, in parts of ``chunk`` records."""
    d = donations.filter("confirmed")
    totals = d.groupBy("donor_key").agg(F.coalesce(F.sum(_money()), F.lit(0.0)).alias("t"))
    d = d.withColumn("__age", -F.coalesce(F.unix_date("donation_date"), F.lit(-800_000)))
    lists = chunked_lists(d, ["donor_key"], ["__age"], ["ordinal"],
                          F.struct(F.col("donation_date").cast("string").alias("date"),
                                   "amount", "committee"), chunk, "c")
    return lists.join(totals, "donor_key")


def embedded_payload(cache: DataFrame, people: DataFrame) -> DataFrame:
    """Confirmed donors with at most five possible matches and the party when unambiguous."""
    party = any_party(people.withColumn("donor_key", ids.donor_key(
        F.col("name"), F.col("city"), F.col("zip"), upper_name=False)))
    return (cache.filter(F.size("confirmed") > 0)
            .select(F.col("key").alias("donor_key"), F.col("confirmed").alias("c"),
                    F.slice(F.coalesce("possible", F.array()), 1, C.EMBEDDED_POSSIBLE_CAP).alias("p"))
            .join(party.select("donor_key", F.col("sole_party").alias("party")),
                  "donor_key", "left"))
