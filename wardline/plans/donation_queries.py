"""Queries over donations, prospects, matching and the match cache."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import donations, matching, metrics, people
from ..sources import files
from .registry import query
from .standin import TARGET, Views

CUTOFF = dates.election_day(TARGET)
REF = dt.date(2002, 7, 17)
NOW = dt.datetime(2002, 1, 31, 12)

_CUT = "DATE '2000-11-07'"


@query("donation_asof_report", "P5 A39",
       "source:s donors_kept:i records_kept:i dropped_post_cutoff:i dropped_dateless:i",
       f"""SELECT source, count(DISTINCT donor_key) FILTER (donation_date < {_CUT}) AS donors_kept,
       count(*) FILTER (donation_date < {_CUT}) AS records_kept,
       count(*) FILTER (donation_date >= {_CUT}) AS dropped_post_cutoff,
       count(*) FILTER (donation_date IS NULL) AS dropped_dateless
       FROM donation WHERE confirmed GROUP BY 1""")
def _(v):
    return donations.as_of_report(v.donations.filter("confirmed"), CUTOFF)


@query("donation_features", "A4 P5 J2",
       "person_row:i fec_n:i fec_total:d fec_recency_days:i nyboe_n:i nyboe_total:d "
       "nyboe_recency_days:i dem_conduit_total:d rep_conduit_total:d n_committees:i has_donation:i",
       f"""SELECT p.person_row, coalesce(fec_n, 0) AS fec_n, coalesce(fec_total, 0) AS fec_total,
       fec_recency_days, coalesce(nyboe_n, 0) AS nyboe_n, coalesce(nyboe_total, 0) AS nyboe_total,
       nyboe_recency_days, coalesce(dem, 0) AS dem_conduit_total, coalesce(rep, 0) AS rep_conduit_total,
       coalesce(n_committees, 0) AS n_committees, CASE WHEN f.donor_key IS NULL THEN 0 ELSE 1 END
         AS has_donation
       FROM person p LEFT JOIN (SELECT donor_key, count(*) FILTER (source = 'fec') AS fec_n,
         sum(coalesce(amount, 0)) FILTER (source = 'fec') AS fec_total,
         date_diff('day', max(donation_date) FILTER (source = 'fec'), {_CUT}) AS fec_recency_days,
         count(*) FILTER (source = 'nyboe') AS nyboe_n,
         sum(coalesce(amount, 0)) FILTER (source = 'nyboe') AS nyboe_total,
         date_diff('day', max(donation_date) FILTER (source = 'nyboe'), {_CUT}) AS nyboe_recency_days,
         sum(coalesce(amount, 0)) FILTER (upper(committee) = 'ACTBLUE') AS dem,
         sum(coalesce(amount, 0)) FILTER (upper(committee) = 'WINRED') AS rep,
         count(DISTINCT coalesce(committee, '')) AS n_committees
         FROM donation WHERE confirmed AND donation_date < {_CUT} GROUP BY 1) f USING (donor_key)""")
def _(v):
    return donations.attach_donation_features(
        v.people, donations.donation_features(v.donations, CUTOFF))


@query("donor_committees", "D9 P5", "person_row:i committee:s source:s n:i amount:d",
       f"""SELECT person_row, coalesce(committee, '') AS committee, source, count(*) AS n,
       sum(coalesce(amount, 0)) AS amount FROM person JOIN donation USING (donor_key)
       WHERE confirmed AND donation_date < {_CUT} GROUP BY 1, 2, 3""")
def _(v):
    d = donations.donor_committees(v.people, v.donations, CUTOFF)
    return d.groupBy("person_row", "committee", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("donation_totals_simple", "A5 P6",
       "donor_key:s source:s total:d n:i last_date:s n_committees:i dem_conduit_total:d "
       "rep_conduit_total:d",
       f"""SELECT donor_key, source, sum(amount) AS total, count(*) AS n, max(donation_date) AS last_date,
       count(DISTINCT committee) AS n_committees,
       sum(CASE WHEN upper(committee) = 'ACTBLUE' THEN coalesce(amount, 0) ELSE 0 END) AS dem_conduit_total,
       sum(CASE WHEN upper(committee) = 'WINRED' THEN coalesce(amount, 0) ELSE 0 END) AS rep_conduit_total
       FROM donation WHERE donation_date < {_CUT} OR donation_date IS NULL GROUP BY 1, 2""")
def _(v):
    return donations.donation_totals_simple(v.donations, CUTOFF)


@query("donation_features_simple", "J3",
       "person_row:i has_donation_simple:i fec_n_simple:i fec_total_simple:d "
       "fec_recency_days_simple:i nyboe_n_simple:i nyboe_total_simple:d nyboe_recency_days_simple:i "
       "n_committees_simple:i dem_conduit_total_simple:d rep_conduit_total_simple:d",
       f"""SELECT person_row, CASE WHEN coalesce(fec_n, 0) + coalesce(nyboe_n, 0) > 0 THEN 1 ELSE 0 END
         AS has_donation_simple, coalesce(fec_n, 0) AS fec_n_simple,
       coalesce(fec_total, 0) AS fec_total_simple,
       coalesce(date_diff('day', fec_last, {_CUT}), 9999) AS fec_recency_days_simple,
       coalesce(nyboe_n, 0) AS nyboe_n_simple, coalesce(nyboe_total, 0) AS nyboe_total_simple,
       coalesce(date_diff('day', nyboe_last, {_CUT}), 9999) AS nyboe_recency_days_simple,
       coalesce(fec_c, 0) + coalesce(nyboe_c, 0) AS n_committees_simple,
       coalesce(dem, 0) AS dem_conduit_total_simple, coalesce(rep, 0) AS rep_conduit_total_simple
       FROM person LEFT JOIN (SELECT donor_key, count(*) FILTER (source = 'fec') AS fec_n,
         sum(amount) FILTER (source = 'fec') AS fec_total,
         max(donation_date) FILTER (source = 'fec') AS fec_last,
         count(DISTINCT committee) FILTER (source = 'fec') AS fec_c,
         count(*) FILTER (source = 'nyboe') AS nyboe_n,
         sum(amount) FILTER (source = 'nyboe') AS nyboe_total,
         max(donation_date) FILTER (source = 'nyboe') AS nyboe_last,
         count(DISTINCT committee) FILTER (source = 'nyboe') AS nyboe_c,
         sum(amount) FILTER (upper(committee) = 'ACTBLUE') AS dem,
         sum(amount) FILTER (upper(committee) = 'WINRED') AS rep
         FROM donation WHERE donation_date < {_CUT} OR donation_date IS NULL GROUP BY 1)
       USING (donor_key)""")
def _(v):
    return donations.donation_features_simple(
        v.people, donations.donation_totals_simple(v.donations, CUTOFF), CUTOFF)


@query("top_committees", "A11", "committee:s cnt:i total:d",
       """SELECT committee, count(*) AS cnt, sum(coalesce(amount, 0)) AS total FROM donation
       WHERE confirmed AND committee <> '' GROUP BY 1 ORDER BY total DESC, committee LIMIT 12""")
def _(v):
    return donations.top_committees(v.donations)


@query("top_zips", "A12", "zip:s donors:i total:d",
       """SELECT split_part(donor_key, '|', 3) AS zip, count(DISTINCT donor_key) AS donors,
       sum(coalesce(amount, 0)) AS total FROM donation WHERE confirmed GROUP BY 1
       HAVING regexp_full_match(split_part(donor_key, '|', 3), '[0-9]{4,5}')
       ORDER BY total DESC, zip LIMIT 10""")
def _(v):
    return donations.top_zips(v.donations)


@query("party_giving", "A13 A45 J15", "party:s donors:i total:d avg:d share_of_largest:d",
       """SELECT party, count(DISTINCT d.donor_key) AS donors, sum(amount) AS total,
       avg(amount) AS avg, sum(amount) / max(sum(amount)) OVER () AS share_of_largest
       FROM donation d JOIN person p USING (donor_key) WHERE confirmed GROUP BY party""")
def _(v):
    return donations.party_giving(v.donations, v.people)


@query("donation_meta", "A14",
       "confirmed_count:i possible_count:i confirmed_total:d confirmed_donors:i",
       """SELECT count(*) FILTER (confirmed) AS confirmed_count,
       count(*) FILTER (NOT confirmed) AS possible_count,
       sum(amount) FILTER (confirmed) AS confirmed_total,
       count(DISTINCT donor_key) FILTER (confirmed) AS confirmed_donors FROM donation""")
def _(v):
    return donations.donation_meta(v.donations)


@query("donor_summaries", "A15 J2", "person_row:i total_donated:d donation_count:i",
       """SELECT person_row, coalesce(total_donated, 0) AS total_donated,
       coalesce(donation_count, 0) AS donation_count FROM person LEFT JOIN summary USING (donor_key)""")
def _(v):
    return v.people.join(donations.donor_summaries(v.donations), "donor_key", "left").fillna(
        0, ["total_donated", "donation_count"])


_CARD_SQL = """WITH hit AS (SELECT * FROM donation WHERE {where}
         ORDER BY donation_date DESC NULLS FIRST, donor_key, ordinal LIMIT 5000),
       card AS (SELECT donor_key, coalesce(sum(amount) FILTER (confirmed), 0) AS total_confirmed,
         count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (NOT confirmed) AS possible
         FROM hit GROUP BY 1)
       SELECT donor_key, split_part(donor_key, '|', 1) AS name, split_part(donor_key, '|', 2) AS city,
       split_part(donor_key, '|', 3) AS zip,
       (SELECT min(party) FROM person p WHERE p.donor_key = card.donor_key) AS party,
       total_confirmed, confirmed, possible FROM card
       ORDER BY total_confirmed DESC, donor_key LIMIT 200"""


def _cards(v: Views, q: str, committee: bool = False) -> DataFrame:
    rows = donations.search_donations(v.donations, q, committee)
    c = donations.donor_cards(rows, v.people)
    return c.withColumns({"confirmed": F.size("confirmed"), "possible": F.size("possible")})


_CARD_COLUMNS = "donor_key:s name:s city:s zip:s party:s total_confirmed:d confirmed:i possible:i"


@query("donor_cards_by_zip", "P11 A16 J20", _CARD_COLUMNS,
       _CARD_SQL.format(where="contains(upper(donor_key), '|00012')"))
def _(v):
    return _cards(v, "00012")


@query("donor_cards_by_name", "P11 A16", _CARD_COLUMNS,
       _CARD_SQL.format(where="contains(upper(donor_key), 'MACH')"))
def _(v):
    return _cards(v, " mach ")


@query("donor_cards_by_committee", "P11 A16", _CARD_COLUMNS,
       _CARD_SQL.format(where="contains(upper(committee), 'TOWN') AND confirmed"))
def _(v):
    return _cards(v, "town", committee=True)


@query("donor_card_totals", "A16", "donors:i total:d",
       """SELECT count(DISTINCT donor_key) AS donors, coalesce(sum(amount) FILTER (confirmed), 0) AS total
       FROM (SELECT * FROM donation WHERE contains(upper(donor_key), 'MACH')
         ORDER BY donation_date DESC NULLS FIRST, donor_key, ordinal LIMIT 5000)""")
def _(v):
    return donations.donor_card_totals(donations.search_donations(v.donations, "mach"))


@query("party_of_key", "J20", "donor_key:s party:s sole_party:s",
       """SELECT donor_key, min(party) AS party,
       CASE WHEN count(DISTINCT party) = 1 THEN min(party) END AS sole_party FROM person GROUP BY 1""")
def _(v):
    return donations.any_party(v.people)


@query("donor_payload", "K4", "donor_key:s part:i n:i t:d newest:s amounts:s",
       """SELECT donor_key, (r - 1) // 20 AS part, count(*) AS n, any_value(t) AS t,
       arg_min(CAST(donation_date AS VARCHAR), r) AS newest,
       string_agg(CAST(coalesce(CAST(round(amount * 100) AS BIGINT), -1) AS VARCHAR), ',' ORDER BY r) AS amounts
       FROM (SELECT *, row_number() OVER (PARTITION BY donor_key
           ORDER BY donation_date DESC NULLS LAST, ordinal) AS r,
         sum(coalesce(amount, 0)) OVER (PARTITION BY donor_key) AS t FROM donation WHERE confirmed)
       GROUP BY 1, 2""")
def _(v):
    p = donations.donor_payload(v.donations, chunk=20)
    cents = F.transform("c", lambda r: F.coalesce(
        F.round(r["amount"] * 100).cast("bigint"), F.lit(-1)).cast("string"))
    return p.select("donor_key", "part", F.size("c").alias("n"), "t",
                    F.get("c", F.lit(0))["date"].alias("newest"), F.array_join(cents, ",").alias("amounts"))


def _prospects(v: Views) -> DataFrame:
    p = v.people.filter("party = 'BLK'")
    return p.withColumns({"first_name": F.substring_index("name", " ", 1),
                          "last_name": F.expr("substring(name, instr(name, ' ') + 1)")})


_REC_SQL = """rec0 AS (SELECT p.person_row, variant, source, coalesce(CAST(donation_date AS VARCHAR), '') AS date,
         coalesce(amount, 0) AS amount, coalesce(committee, '') AS committee, ordinal
       FROM (SELECT person_row, 0 AS variant, donor_key FROM person WHERE party = 'BLK' UNION ALL
             SELECT person_row, 1, upper(substr(name, instr(name, ' ') + 1) || ' ' || split_part(name, ' ', 1))
               || '|' || upper(city) || '|' || zip FROM person WHERE party = 'BLK') p
       JOIN donation d ON d.donor_key = p.donor_key AND confirmed),
       rec AS (SELECT person_row, source, date, amount, committee,
         min((variant, CASE WHEN source = 'fec' THEN 1 ELSE 0 END, ordinal)) AS seq
         FROM rec0 GROUP BY 1, 2, 3, 4, 5)"""


@query("prospect_list", "J11 A6 F14 O2 K10",
       "person_row:i total_donated:d fec_total:d nyboe_total:d num_donations:i last_donation_date:s "
       "committees:s dem_donor:i dem_total:d dem_committees:s recent_donor:i donor_score:i",
       f"""WITH {_REC_SQL}, s AS (SELECT person_row, sum(amount) AS total,
         sum(amount) FILTER (source = 'fec') AS fec, sum(amount) FILTER (source = 'nyboe') AS nyboe,
         count(*) AS n, coalesce(max(date) FILTER (date <> ''), '') AS last,
         coalesce(string_agg(DISTINCT committee, '; ' ORDER BY committee) FILTER (committee <> ''), '') AS cs,
         max(CASE WHEN contains(upper(committee), 'DEMOCRAT') THEN 1 ELSE 0 END) AS dem,
         sum(amount) FILTER (contains(upper(committee), 'DEMOCRAT')) AS dem_t,
         coalesce(string_agg(DISTINCT committee, '; ' ORDER BY committee)
           FILTER (contains(upper(committee), 'DEMOCRAT')), '') AS dem_cs FROM rec GROUP BY 1),
       j AS (SELECT p.person_row, p.tier_count, s.*, s.n IS NOT NULL AS has,
         CASE WHEN last <> '' AND date_diff('day', CAST(nullif(last, '') AS DATE), DATE '2002-07-17') <= 1095
           THEN 1 ELSE 0 END AS recent
         FROM person p LEFT JOIN s USING (person_row) WHERE party = 'BLK')
       SELECT person_row, round(coalesce(total, 0), 2) AS total_donated, round(coalesce(fec, 0), 2) AS fec_total,
       round(coalesce(nyboe, 0), 2) AS nyboe_total, coalesce(n, 0) AS num_donations,
       coalesce(last, '') AS last_donation_date, coalesce(cs, '') AS committees,
       coalesce(dem, 0) AS dem_donor, round(coalesce(dem_t, 0), 2) AS dem_total,
       coalesce(dem_cs, '') AS dem_committees, recent AS recent_donor,
       least(100, CASE WHEN has THEN 40 + 15 * dem + CASE WHEN total > 0 THEN
           least(15, floor(log10(round(total, 2) + 1) * 6)) ELSE 0 END + least(10, 2 * n) + 10 * recent ELSE 0 END
         + CASE WHEN tier_count >= 3 THEN 5 ELSE 0 END + CASE WHEN tier_count >= 5 THEN 5 ELSE 0 END)
         AS donor_score FROM j""")
def _(v):
    p = _prospects(v)
    recs = donations.lookup_by_both_names(p, v.donations)
    return donations.prospect_list(p, donations.prospect_summary(recs, REF))


@query("prospect_people", "F16 K10", "person_row:i first_name:s last_name:s address:s zip:s num_elections_voted:i",
       """SELECT p.person_row, substr(name, 1, 1) || lower(substr(name, 2, 1)) AS first_name,
       CASE WHEN contains(name, '(X)') THEN '(X) ' ELSE '' END || split_part(name, ' ', -1)[1]
         || lower(split_part(name, ' ', -1)[2:]) AS last_name,
       (household_row % 400 + 1) || ' Street' || (household_row % 40) || ' Avenue' AS address, h.zip,
       n_ballots AS num_elections_voted FROM person p JOIN household h USING (household_row)
       WHERE party = 'BLK' AND h.assembly_district = 4""")
def _(v):
    p = people.number_people(people.explode_people(people.with_people(v.packed)), block=500)
    return donations.prospect_people(p, 4)


@query("prospect_detail", "A6", "person_row:i part:i donations_detail:s",
       f"""WITH {_REC_SQL} SELECT person_row, (r - 1) // 10 AS part,
       string_agg(array_to_string(list_filter_blank, ' '), '; ' ORDER BY r) AS donations_detail
       FROM (SELECT *, [x FOR x IN [date, printf('$%.2f', amount), committee, '[' || source || ']']
           IF x <> ''] AS list_filter_blank,
         row_number() OVER (PARTITION BY person_row ORDER BY date DESC, seq) AS r FROM rec) GROUP BY 1, 2""")
def _(v):
    recs = donations.lookup_by_both_names(_prospects(v), v.donations)
    return donations.prospect_detail(recs, chunk=10)


@query("prospect_score_bands", "A38", "band:s n:i",
       """SELECT CASE WHEN s >= 80 THEN '80-100' WHEN s >= 60 THEN '60-79' WHEN s >= 40 THEN '40-59'
       WHEN s >= 20 THEN '20-39' ELSE '0-19' END AS band, count(*) AS n
       FROM (SELECT (k * 31) % 101 AS s FROM person) GROUP BY 1""")
def _(v):
    return metrics.band_counts(v.people.withColumn("donor_score", (F.col("person_row") * 31) % 101))


@query("contact_list", "J11 F15 K10 A38",
       "person_row:i total_donated:d num_donations:i recent_donor:i donor_score:i",
       """WITH rec AS (SELECT p.person_row, d.* FROM person p JOIN donation d USING (donor_key) WHERE confirmed),
       s AS (SELECT person_row, round(sum(coalesce(amount, 0)), 2) AS total, count(*) AS n,
         max(donation_date) AS last FROM rec GROUP BY 1)
       SELECT person_row, coalesce(total, 0) AS total_donated, coalesce(n, 0) AS num_donations,
       CASE WHEN date_diff('day', last, DATE '2002-07-17') <= 1095 THEN 1 ELSE 0 END AS recent_donor,
       least(100, CASE WHEN n IS NULL THEN 0 ELSE 40 + CASE WHEN total > 0 THEN
           least(20, floor(log10(total + 1) * 7)) ELSE 0 END + least(10, 2 * n)
           + CASE WHEN date_diff('day', last, DATE '2002-07-17') <= 1095 THEN 10 ELSE 0 END END
         + CASE WHEN person_row % 3 <> 0 THEN 10 ELSE 0 END
         + CASE WHEN person_row % 2 = 0 THEN 5 ELSE 0 END) AS donor_score
       FROM person LEFT JOIN s USING (person_row)""")
def _(v):
    n = F.col("person_row")
    p = _named(v).withColumns({
        "preferred_phone": F.when(n % 3 == 1, "555"), "preferred_email": F.when(n % 3 == 0, ""),
        "cell_phone": F.when(n % 3 == 2, "556"), "party": F.when(n % 2 == 0, "d").otherwise("R")})
    recs = donations.lookup_by_both_names(p, v.donations, dedupe=False)
    return matching.contact_list(p, matching.contact_summary(recs, REF))


def _named(v: Views) -> DataFrame:
    return v.people.withColumns({"first_name": F.substring_index("name", " ", 1),
                                 "last_name": F.expr("substring(name, instr(name, ' ') + 1)")})


# ------------------------------------------------------------------- matching

def _committees(v: Views) -> DataFrame:
    """Supplier names under small ids, in two cycles."""
    s = v.table("supplier")
    return s.select((F.col("s_suppkey") % 6).cast("string").alias("committee_id"),
                    F.col("s_name").alias("name"),
                    (2000 + F.floor(F.col("s_suppkey") / 6) % 3 * 2).cast("int").alias("cycle"),
                    F.col("s_suppkey").alias("o"))


def _bulk(v: Views) -> DataFrame:
    named = matching.with_committee_names(v.donors_bulk, files.latest_committee_names(_committees(v)))
    return matching.with_donor_name(named).withColumn(
        "date", text.compact_date_to_iso(F.col("raw_date")))


_BULK_SQL = """bulk AS (SELECT event_id AS ordinal, value AS amount,
         split_part(name, ' ', 1) AS given, split_part(name, ' ', -1) AS last,
         CASE WHEN event_id % 4 = 0 THEN 'ELSEWHERE' ELSE upper(city) END AS city, zip,
         event_id % 3 = 0 AS middle, CAST(event_id % 7 AS VARCHAR) AS committee_id,
         CAST(DATE '1998-01-01' + CAST(event_id % 1000 AS INT) AS VARCHAR) AS date
       FROM events JOIN person ON person_row = user_id)"""


@query("committee_names", "S6 J13", "committee:s n:i",
       f"""WITH {_BULK_SQL}, cm AS (SELECT CAST(s_suppkey % 6 AS VARCHAR) AS committee_id,
         arg_max(s_name, (s_suppkey // 6 % 3, s_suppkey)) AS nm FROM supplier GROUP BY 1)
       SELECT coalesce(nm, committee_id) AS committee, count(*) AS n FROM bulk LEFT JOIN cm USING (committee_id)
       GROUP BY 1""")
def _(v):
    return _bulk(v).groupBy("committee").agg(F.count(F.lit(1)).alias("n"))


_MATCH_SQL = f"""{_BULK_SQL},
       voter AS (SELECT *, split_part(name, ' ', -1) AS last, split_part(name, ' ', 1) AS given,
         contains(name, '(X)') AS has_x FROM person),
       cand AS (SELECT v.person_row, b.ordinal, b.amount, b.date,
           CASE WHEN b.city = upper(v.city) AND b.zip = v.zip THEN 'confirmed' ELSE 'possible' END AS status
         FROM voter v JOIN bulk b ON b.last = v.last AND b.given = v.given AND NOT v.has_x),
       hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_row, status ORDER BY ordinal) AS r
         FROM cand) WHERE status = 'confirmed' OR r <= 10)"""


def _matches(v: Views) -> DataFrame:
    voters = v.people.select(F.col("person_row").alias("key"), "name", "city", "zip")
    return matching.match_by_name(voters, _bulk(v))


@query("name_match", "J9 W11 F7 F8", "key:i status:s ordinal:i amount:d date:s",
       f"WITH {_MATCH_SQL} SELECT person_row AS key, status, ordinal, amount, date FROM hit")
def _(v):
    return _matches(v)


_MISSING_SQL = _MATCH_SQL.replace("b.city = upper(v.city) AND b.zip = v.zip",
    "coalesce(CASE WHEN ordinal % 5 <> 0 THEN b.city END, '') = coalesce(CASE WHEN person_row % 2 <> 0 THEN upper(v.city) END, '') "
    "AND coalesce(CASE WHEN ordinal % 3 <> 0 THEN b.zip END, '') = coalesce(CASE WHEN person_row % 4 <> 0 THEN v.zip END, '')")


@query("name_match_missing_places", "J9 W11", "key:i status:s ordinal:i",
       f"WITH {_MISSING_SQL} SELECT person_row AS key, status, ordinal FROM hit")
def _(v):
    n = F.col("person_row")
    voters = v.people.select(n.alias("key"), "name", F.when(n % 2 != 0, F.col("city")).alias("city"),
                             F.when(n % 4 != 0, F.col("zip")).alias("zip"))
    donors = _bulk(v).withColumns({"city": F.when(F.col("ordinal") % 5 != 0, F.col("city")),
                                   "zip": F.when(F.col("ordinal") % 3 != 0, F.col("zip"))})
    return matching.match_by_name(voters, donors)


@query("name_match_state", "J9 S7 W11", "key:i status:s ordinal:i amount:d",
       f"WITH {_MATCH_SQL} SELECT person_row AS key, status, ordinal, amount FROM hit")
def _(v):
    """Records that keep last and first name apart."""
    apart = F.split("name", ",", 2)
    donors = matching.with_split_name(_bulk(v).drop("last", "tokens").withColumns(
        {"last_name": apart[0], "first_name": apart[1]}))
    return matching.match_by_name(v.people.select(F.col("person_row").alias("key"), "name", "city", "zip"), donors)


_PLACE_SQL = f"""WITH {_BULK_SQL}, c AS (SELECT p.person_row AS key, ordinal, CASE WHEN b.city <> 'ELSEWHERE'
           AND b.city = upper(p.city) AND b.zip = p.zip THEN 'confirmed' ELSE 'possible' END AS status
         FROM person p JOIN bulk b ON b.last = p.name[4:] AND b.zip = p.zip)
       SELECT key, status, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY key, status ORDER BY ordinal)
         AS r FROM c) WHERE status = 'confirmed' OR r <= 10"""


@query("place_classification", "J10 W11", "key:i status:s ordinal:i", _PLACE_SQL)
@query("place_classification_all_parties", "J10 W11", "key:i status:s ordinal:i", _PLACE_SQL)
def _(v):
    b = _bulk(v).select("last", F.when(F.col("city") != "ELSEWHERE", F.col("city")).alias("rec_city"),
                        F.concat("zip", F.lit("-1234")).alias("rec_zip"), "zip", "ordinal")
    p = v.people.select(F.col("person_row").alias("key"), F.expr("substring(name, 4)").alias("last"), "city", "zip")
    return matching.classify_by_place(b, people=p, on=("last", "zip"))


def _old_entries(v: Views) -> DataFrame:
    n = F.col("person_row")
    return v.people.filter(n % 2 == 0).select(
        n.alias("key"), (n % 3).alias("n_confirmed"), (n % 5).alias("n_possible"),
        F.timestamp_add("DAY", -(n % 120).cast("int"), F.lit(NOW)).alias("checked_at"),
        F.when(n % 7 != 0, F.when(n % 4 == 0, "bulk").otherwise("api")).alias("source"),
        (n % 10 == 0).alias("timeout"))


@query("match_cache_merge", "K9 D6", "key:i n_confirmed:i n_possible:i source:s origin:s",
       f"""WITH {_MATCH_SQL}, fresh AS (SELECT person_row AS key, count(*) FILTER (status = 'confirmed') AS c,
           count(*) FILTER (status = 'possible') AS p FROM hit GROUP BY 1),
       old AS (SELECT person_row AS key, person_row % 3 AS c, person_row % 5 AS p,
           CASE WHEN person_row % 7 <> 0 THEN CASE WHEN person_row % 4 = 0 THEN 'bulk' ELSE 'api' END END AS source
         FROM person WHERE person_row % 2 = 0)
       SELECT coalesce(o.key, f.key) AS key, CASE WHEN k THEN o.c ELSE f.c END AS n_confirmed,
         CASE WHEN k THEN o.p ELSE f.p END AS n_possible,
         CASE WHEN k THEN o.source ELSE 'bulk' END AS source,
         CASE WHEN k THEN 'existing' ELSE 'found' END AS origin
       FROM (SELECT o, f, f.key IS NULL OR (o.key IS NOT NULL AND o.c > 0 AND o.source IS DISTINCT FROM 'bulk')
           AS k FROM old o FULL JOIN fresh f ON o.key = f.key)""")
def _(v):
    found = matching.match_entries(_matches(v), F.lit(NOW))
    return matching.merge_entries(_old_entries(v), found)


@query("stale_entries", "P18", "key:i due:i",
       """SELECT person_row AS key, CASE WHEN person_row % 2 = 1 THEN 1
         WHEN person_row % 120 >= CASE WHEN person_row % 10 = 0 THEN 7
           WHEN person_row % 3 + person_row % 5 > 0 THEN 30 ELSE 90 END THEN 1 ELSE 0 END AS due FROM person""")
def _(v):
    p = v.people.select(F.col("person_row").alias("key")).join(_old_entries(v), "key", "left")
    return p.select("key", matching.needs_query(NOW).cast("int").alias("due"))


def _keyed_entries(v: Views) -> DataFrame:
    n = F.col("person_row")
    p = matching.task_keys(v.people).filter(n % 2 == 0)
    p = p.withColumn("key", F.when(n % 22 == 0, F.lit("bad|key")).otherwise(F.col("key")))
    return p.groupBy("key").agg(
        F.max((n % 3).cast("bigint")).alias("n_confirmed"), F.max((n % 5).cast("bigint")).alias("n_possible"),
        F.max(F.timestamp_add("DAY", -(n % 120).cast("int"), F.lit(NOW))).alias("checked_at"),
        F.lit("api").alias("source"), F.max(n % 10 == 0).alias("timeout"))


_ENTRY_SQL = """entry AS (SELECT CASE WHEN k % 22 = 0 THEN 'bad|key' ELSE name || '|' || city || '|' || zip END AS key,
         max(k % 3) AS c, max(k % 5) AS p, min(k % 120) AS age_days, max(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) AS t
         FROM person WHERE k % 2 = 0 GROUP BY 1),
       rate AS (SELECT split_part(key, '|', 3) AS zip, count(*) AS zip_total, count(*) FILTER (c > 0) AS zip_hits
         FROM entry WHERE len(string_split(key, '|')) = 3 GROUP BY 1)"""


@query("zip_hit_rate", "A21", "zip:s zip_total:i zip_hits:i",
       f"WITH {_ENTRY_SQL} SELECT * FROM rate")
def _(v):
    return matching.zip_hit_rate(_keyed_entries(v))


@query("task_list", "F13 O4 P18 U3", "key:s likelihood:d ordinal:i",
       f"""WITH {_ENTRY_SQL}, one AS (SELECT name || '|' || city || '|' || zip AS key, min(person_row) AS ordinal
         FROM person GROUP BY 1)
       SELECT o.key, o.ordinal, CASE WHEN zip_total >= 10 THEN zip_hits / zip_total * 100
           WHEN zip_total > 0 THEN (zip_hits + 2) / (zip_total + 10) * 100 ELSE 0.05 * 100 END
         + CASE tier_letter WHEN 'X' THEN 4 WHEN 'F' THEN 1 ELSE 0 END
         + CASE WHEN age >= 65 THEN 3 WHEN age >= 50 THEN 2 WHEN age >= 40 THEN 1 ELSE 0 END AS likelihood
       FROM one o JOIN person p ON p.person_row = o.ordinal LEFT JOIN entry e ON e.key = o.key
       LEFT JOIN rate r ON r.zip = p.zip
       WHERE e.key IS NULL OR age_days >= CASE WHEN t = 1 THEN 7 WHEN c + p > 0 THEN 30 ELSE 90 END"""
       .replace("c + p > 0", "e.c + e.p > 0"))
def _(v):
    p = matching.task_keys(v.people).withColumn("ordinal", F.col("person_row")).select(
        "key", "name", "city", "zip", "tier", "age", "ordinal")
    one = p.groupBy("key").agg(F.min_by(F.struct("name", "city", "zip", "tier", "age", "ordinal"),
                                        "ordinal").alias("r")).select("key", "r.*")
    return matching.task_list(one, _keyed_entries(v), NOW)


@query("district_by_address", "J12 F16", "person_row:i assembly_district:s",
       """WITH look AS (SELECT address_num AS num, street, zip, arg_max(assembly_district, household_row) AS ad
         FROM household GROUP BY 1, 2, 3)
       SELECT person_row, coalesce(CAST(ad AS VARCHAR), '') AS assembly_district FROM person p
       LEFT JOIN look ON num = CAST(household_row % 400 + 1 AS VARCHAR)
         AND street = 'STREET' || (household_row % 40) || ' AVENUE' AND look.zip = p.zip""")
def _(v):
    h = v.households.select(F.col("address_num").alias("address_number"),
                            F.initcap("street").alias("street_name"), F.concat("zip", F.lit(".0")).alias("zip_code"),
                            "assembly_district", F.col("household_row").alias("ordinal"))
    n = F.col("household_row")
    p = v.people.drop("assembly_district").withColumn("address", F.concat(
        F.lit(" "), (n % 400 + 1).cast("string"), F.lit("  Street"), (n % 40).cast("string"), F.lit(" avenue")))
    return matching.with_district(p, matching.district_by_address(h))


@query("donations_reloaded", "K6 D7", "donor_key:s confirmed:i n:i amount:d dated:i",
       """SELECT donor_key, confirmed, count(*) AS n, round(sum(amount), 2) AS amount,
       count(donation_date) AS dated FROM donation GROUP BY 1, 2""")
def _(v):
    rec = F.struct(F.coalesce(F.col("donation_date").cast("string"), F.lit(" ")).alias("date"), "amount", "committee")
    cache = v.donations.withColumn("b", F.floor(F.col("ordinal") / 50)).groupBy(
        F.lower("donor_key").alias("key"), "source", "b").agg(
        F.collect_list(F.when(F.col("confirmed"), rec)).alias("confirmed"),
        F.collect_list(F.when(~F.col("confirmed"), rec)).alias("possible"))
    rows = donations.donation_rows(cache)
    return rows.groupBy("donor_key", F.col("confirmed").cast("int").alias("confirmed")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"),
        F.count("donation_date").alias("dated"))


@query("embedded_payload", "K3 W11 J20", "donor_key:s confirmed:i possible:i party:s",
       """SELECT d.donor_key, count(*) FILTER (confirmed) AS confirmed,
       least(5, count(*) FILTER (NOT confirmed)) AS possible, any_value(sole) AS party
       FROM donation d LEFT JOIN (SELECT name || '|' || upper(city) || '|' || zip AS donor_key,
         CASE WHEN min(party) = max(party) THEN min(party) END AS sole FROM person GROUP BY 1) s USING (donor_key)
       GROUP BY 1 HAVING count(*) FILTER (confirmed) > 0""")
def _(v):
    rec = F.struct("ordinal", "amount", "committee")
    cache = v.donations.groupBy(F.col("donor_key").alias("key")).agg(
        F.collect_list(F.when(F.col("confirmed"), rec)).alias("confirmed"),
        F.collect_list(F.when(~F.col("confirmed"), rec)).alias("possible"))
    p = donations.embedded_payload(cache, v.people)
    return p.select("donor_key", F.size("c").alias("confirmed"), F.size("p").alias("possible"), "party")


@query("state_contributions", "S7", "last_name:s city:s n:i amount:d",
       """SELECT upper(split_part(name, ' ', -1)) AS last_name, upper(city) AS city, count(*) AS n,
       sum(CASE WHEN event_id % 6 = 0 THEN 0 ELSE value END) AS amount
       FROM events JOIN person ON person_row = user_id
       WHERE event_id % 3 <> 0 AND zip BETWEEN '00003' AND '00020' AND event_id % 10 <> 0 GROUP BY 1, 2""")
def _(v):
    i = F.col("event_id")
    j = v.table("events").join(v.people.select(F.col("person_row").alias("user_id"), "name", "city", "zip"),
                               "user_id")
    raw = j.select(
        F.when(i % 3 != 0, "A").otherwise("B").alias("filing_sched_abbrev"),
        F.when(i % 10 != 0, F.concat(F.lit(" "), F.lower(F.substring_index("name", " ", -1)))).otherwise("  ")
        .alias("flng_ent_last_name"), F.substring_index("name", " ", 1).alias("flng_ent_first_name"),
        F.lower("city").alias("flng_ent_city"), F.col("zip").alias("flng_ent_zip"),
        F.col("ts").cast("string").alias("sched_date"),
        F.when(i % 6 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("org_amt"),
        F.lit(" Committee ").alias("cand_comm_name"))
    c = files.clean_state_contributions(raw, "00003", "00020")
    return c.groupBy("last_name", "city").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("reloaded_amounts", "K6", "source:s n:i amount:d",
       "SELECT source, count(*) AS n, sum(round(amount, 2)) AS amount FROM donation GROUP BY 1")
def _(v):
    d = v.donations.withColumn("amount", F.col("amount").cast("decimal(10,2)"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


