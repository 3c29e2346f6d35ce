"""Civic views over the generic test tables, by integer arithmetic on their keys."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import ids
from ..session import cut

TARGET = 2000
REF_YEAR = 2002
METHODS = "EVAFDMO"
STREETS = 40


class Views:
    """Lazy views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._memo: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _keep(self, name: str, make) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    @property
    def ballots(self) -> DataFrame:
        """orders: year of the date, type by status, method by key."""
        return self._keep("ballots", lambda: self.table("orders").select(
            F.col("o_custkey").alias("person_row"), F.year("o_orderdate").alias("year"),
            F.when(F.col("o_orderstatus") == "P", "P").otherwise("G").alias("etype"),
            F.substring(F.lit(METHODS), (F.col("o_orderkey") % 7 + 1).cast("int"), F.lit(1))
            .alias("method"), F.col("o_orderkey").alias("ballot_id")))

    @property
    def people(self) -> DataFrame:
        return self._keep("people", self._people)

    def _people(self) -> DataFrame:
        c, n, r = (self.table(t) for t in ("customer", "nation", "region"))
        counts = self.ballots.groupBy("person_row").agg(F.count(F.lit(1)).alias("nb"))
        k = F.col("c_custkey")
        parties = F.array(*[F.lit(p) for p in C.PARTIES])
        j = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
             .join(counts, k == F.col("person_row"), "left").drop("person_row"))
        nb = F.coalesce("nb", F.lit(0))
        letter = F.get(F.array(*[F.lit(x) for x in C.TIER_LETTERS]), (nb % 4).cast("int"))
        seg = F.col("c_mktsegment")
        return j.select(
            k.alias("person_row"), k.alias("person_id"),
            F.floor(k / 3).alias("household_row"), (k % 3).cast("int").alias("member"),
            F.concat(F.char(65 + k % 26), F.char(65 + F.floor(k / 26) % 26),
                     F.when(k % 41 == 0, " (X) ").otherwise(" "), seg).alias("name"),
            (16 + (k * 7) % 70).cast("int").alias("age"),
            F.get(parties, (k % 7).cast("int")).alias("party"),
            letter.alias("tier_letter"), (nb % 5).cast("int").alias("tier_count"),
            F.col("r_name").alias("county"), F.col("n_name").alias("city"),
            F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("zip"),
            F.concat_ws("|", "r_name", "n_name", seg).alias("ed_key"),
            (k % 22 + 1).cast("int").alias("assembly_district"),
            (k % 9 + 1).cast("int").alias("senate_district"),
            (k % 4 + 1).cast("int").alias("congressional_district"),
            (k % 11).cast("int").alias("election_district"), "c_acctbal",
            nb.alias("n_ballots")).withColumn(
            "tier", F.concat("tier_letter", F.col("tier_count").cast("string"))).withColumn(
            "donor_key", ids.donor_key(F.col("name"), F.col("city"), F.col("zip"))).withColumn(
            "household_id", F.col("household_row"))

    @property
    def packed(self) -> DataFrame:
        """One row per household with its members and ballots packed into text."""
        return self._keep("packed", self._packed)

    def _packed(self) -> DataFrame:
        types = F.create_map(F.lit("G"), F.lit("GENERAL"), F.lit("P"), F.lit("PRIMARY"))
        methods = F.create_map(*[F.lit(x) for n, c in C.BALLOT_METHODS.items() for x in (c, n)])
        b = self.ballots.withColumn("text", F.concat(
            F.col("year").cast("string"), F.lit(" "), types[F.col("etype")], F.lit(": "),
            methods[F.col("method")]))
        h = b.groupBy("person_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("ballot_id", "text"))), lambda s: s["text"]), ", ").alias("history"))
        p = self.people.join(h, "person_row", "left")
        head = F.format_string("%s (%d, %s, %s)", "name", "age", "party", "tier")
        packed = F.when(F.col("history").isNotNull(), F.concat_ws(": ", head, "history")) \
            .otherwise(head)
        first = lambda c: F.min_by(c, "member").alias(c)
        return p.withColumn("packed", packed).groupBy("household_row").agg(
            *[first(c) for c in ("county", "city", "zip", "assembly_district", "senate_district",
                                 "congressional_district", "election_district")],
            F.count(F.lit(1)).cast("int").alias("voters_at_address"),
            (F.max("tier_count") - F.min("tier_count")).alias("engagement_gap"),
            F.count_if((F.col("tier_letter") == "X") & (F.col("tier_count") >= 4))
            .alias("num_reliable"),
            F.count_if(F.col("tier").isin(C.LOW_TIERS)).alias("num_low_engagement"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member", "packed"))),
                                     lambda s: s["packed"]), " | ").alias("household_detail")) \
            .withColumnsRenamed({"zip": "zip_code"}).withColumns({
                "address_number": (F.col("household_row") % 400 + 1).cast("string"),
                "street_name": self._street(F.col("household_row"))})

    @staticmethod
    def _street(k: Column) -> Column:
        return F.concat(F.lit("Street"), (k % STREETS).cast("string"), F.lit(" Avenue"))

    @property
    def donations(self) -> DataFrame:
        return self._keep("donations", self._donations)

    def _donations(self) -> DataFrame:
        e = self.table("events")
        i = F.col("event_id")
        names = F.create_map(F.lit("click"), F.lit("ACTBLUE"), F.lit("view"), F.lit("WinRed"),
                             F.lit("signup"), F.lit("Friends of Democrat"), F.lit("error"),
                             F.lit("Town Committee"), F.lit("purchase"), F.lit(""))
        d = e.select(
            F.when(i % 2 == 0, "fec").otherwise("nyboe").alias("source"),
            F.when(i % 17 != 0, F.date_add(F.lit(dt.date(1998, 1, 1)), ((i * 37) % 1400).cast("int")))
            .alias("donation_date"),
            F.when(i % 19 != 0, F.col("value")).alias("amount"),
            F.when(i % 23 != 0, names[F.col("event_type")]).alias("committee"),
            (i % 5 != 0).alias("confirmed"), i.alias("ordinal"), F.col("user_id"))
        keys = self.people.select(F.col("person_row").alias("user_id"), "donor_key")
        return d.join(keys, "user_id").drop("user_id")

    @property
    def households(self) -> DataFrame:
        """Served households with coordinates, scores and member counts."""
        return self._keep("households", self._households)

    def _households(self) -> DataFrame:
        from ..operators.households import score_people
        h = F.col("household_row")
        attrs = self.people.groupBy("household_row").agg(
            *[F.min_by(c, "member").alias(c) for c in (
                "county", "city", "zip", "assembly_district", "senate_district",
                "congressional_district")], F.count(F.lit(1)).alias("people_count"))
        return attrs.join(score_people(self.people), "household_row").withColumns({
            "household_id": h, "address_num": (h % 400 + 1).cast("string"),
            "street": F.upper(self._street(h)),
            "lat": F.when(h % 29 != 0, 40.5 + ((h * 131) % 5000) / 10000.0),
            "lon": F.when(h % 29 != 0, -73.9 + ((h * 257) % 9000) / 10000.0)})

    @property
    def served_people(self) -> DataFrame:
        """Served people with election lists (some null) and probabilities."""
        return self._keep("served_people", self._served_people)

    def _served_people(self) -> DataFrame:
        lists = self.ballots.groupBy("person_row").agg(F.array_sort(F.collect_list(
            F.struct("year", F.concat("etype", "method").alias("code")))).alias("elections"))
        k = F.col("person_row")
        return self.people.join(lists, "person_row", "left").withColumns({
            "elections": F.when(k % 13 != 0, F.col("elections")),
            "turnout_prob": ((k * 37) % 1000) / 1000.0,
            "dem_lean_prob": ((k * 53) % 1000) / 1000.0,
            "rep_lean_prob": F.when(k % 11 != 0, ((k * 71) % 1000) / 1000.0)})

    @property
    def zip_scores(self) -> DataFrame:
        from ..operators.districts import zip_counts, zip_scores
        return zip_scores(zip_counts(self.registrations))

    @property
    def registrations(self) -> DataFrame:
        """lineitem as registrations: ZIP by supplier, unpadded."""
        return self.table("lineitem").select(
            (F.col("l_suppkey") * F.col("l_suppkey") % 37 % 25).cast("string").alias("zip"))

    @property
    def precincts(self) -> DataFrame:
        """lineitem as precinct rows; ordinal by key."""
        office = F.get(F.array(F.lit("State Assembly"), F.lit(" State Senate"), F.lit("U.S. House"),
                               F.lit("Governor")), (F.col("l_orderkey") % 4).cast("int"))
        return self.table("lineitem").select(
            office.alias("office"), (F.col("l_suppkey") % 24).cast("string").alias("district"),
            F.concat(F.lit("Cand "), (F.col("l_linenumber") % 5).cast("string")).alias("candidate"),
            F.get(F.array(F.lit("DEM"), F.lit("rep"), F.lit("CON"), F.lit("WOR")),
                  ((F.col("l_linenumber") + F.col("l_partkey") % 2) % 4).cast("int")).alias("party"),
            F.col("l_quantity").cast("int").cast("string").alias("votes"),
            (2020 + F.col("l_orderkey") % 3 * 2).cast("int").alias("year"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))

    @property
    def points(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("lon"),
            F.get("embedding", F.lit(1)).cast("double").alias("lat"))

    @property
    def polygons(self) -> DataFrame:
        """A rectangle and a triangle per supplier, with the land area."""
        s = F.col("s_suppkey")
        x = -0.35 + (s % 10) * 0.07
        y = -0.35 + (F.floor(s / 10) % 10) * 0.07
        w = 0.02 + (s % 3) * 0.02

        def pt(a: Column, b: Column) -> Column:
            return F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))

        square = F.array(pt(x, y), pt(x + w, y), pt(x + w, y + w), pt(x, y + w), pt(x, y))
        triangle = F.array(pt(x, y), pt(x + w, y), pt(x, y + w), pt(x, y))
        return self.table("supplier").select(
            F.concat(F.lit("G"), F.lpad(s.cast("string"), 6, "0")).alias("geoid"),
            F.array(F.when(s % 2 == 0, square).otherwise(triangle)).alias("rings"),
            x.alias("x"), y.alias("y"), w.alias("w"), s.alias("s"),
            (s * 12345 % 7).alias("aland"))

    @property
    def segments(self) -> DataFrame:
        """part as street segments: 40 streets, ranges and ZIPs by key."""
        p = F.col("p_partkey")
        base = (F.floor(p / STREETS) % 8) * 50 + 1
        rev = p % 5 == 0
        x = -73.9 + (p % 100) * 0.001
        y = 40.5 + (F.floor(p / 100) % 100) * 0.001

        def pt(a: Column, b: Column) -> Column:
            return F.struct(a.alias("x"), b.alias("y"))

        zips = F.lpad((p % 25).cast("string"), 5, "0")
        s = lambda c: c.cast("string")
        return self.table("part").select(
            F.lit("ALL").alias("county"),
            F.concat(F.lit("Street"), (p % STREETS).cast("string"),
                     F.when(p % 3 == 0, " Ave").otherwise(" Avenue")).alias("fullname"),
            s(F.when(rev, base + 48).otherwise(base)).alias("lfrom"),
            s(F.when(rev, base).otherwise(base + 48)).alias("lto"),
            s(base + 1).alias("rfrom"),
            s(F.when(p % 50 == 7, base + 1).otherwise(base + 49)).alias("rto"),
            F.when(p % 4 == 1, "").otherwise(zips).alias("zipl"),
            F.when(p % 4 == 2, F.lit(None)).otherwise(zips).alias("zipr"),
            p.alias("ordinal"),
            F.when(p % 6 == 0, "S1100").when(p % 6 == 1, "S1200").otherwise("S1400")
            .alias("road_class"),
            F.array(pt(x, y), pt(x + 0.00062, y), pt(x + 0.00062, y + 0.0004181)).alias("pts"))

    @property
    def addresses(self) -> DataFrame:
        """customer as addresses on the same streets, some only found by prefix."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("address_id"), F.lit("ALL").alias("county"),
            F.when(k % 31 == 0, "").otherwise(F.concat(
                (k * 13 % 410 + 1).cast("string"), F.when(k % 9 == 0, "B").otherwise("")))
            .alias("address_number"),
            F.concat(F.lit(" street"), (k % (STREETS + 2)).cast("string"), F.lit("  avenue"),
                     F.when(k % 10 == 0, " north").otherwise("")).alias("street_name"),
            F.when(k % 12 == 0, "").otherwise(F.lpad((k * 3 % 25).cast("string"), 5, "0"))
            .alias("zip_code"))

    @property
    def donors_bulk(self) -> DataFrame:
        """events as bulk contribution records with ``LAST, FIRST M`` names."""
        i = F.col("event_id")
        e = self.table("events")
        p = self.people.select(F.col("person_row").alias("user_id"), "name", "city", "zip")
        given, family = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
        j = e.join(p, "user_id")
        extra = F.when(i % 3 == 0, " MIDDLE").otherwise("")
        return j.select(
            F.concat(family, F.lit(", "), given, extra).alias("name"),
            F.when(i % 4 == 0, "ELSEWHERE").otherwise(F.upper("city")).alias("city"), "zip",
            F.date_format(F.date_add(F.lit(dt.date(1998, 1, 1)), (i % 1000).cast("int")), "MMddyyyy")
            .alias("raw_date"), F.col("value").alias("amount"),
            (i % 7).cast("string").alias("committee_id"), i.alias("ordinal"))

    @property
    def placed_people(self) -> DataFrame:
        """People with the coordinates and address of their household."""
        h = self.households.select("household_row", "lat", "lon", F.col("address_num").alias("address_number"),
                                   F.col("street").alias("street_name"))
        return self.people.join(h, "household_row")

    def stored(self, name: str) -> DataFrame:
        """A view written once to reliable storage, for jobs that read it many times."""
        return self._keep(f"stored {name}", lambda: cut(getattr(self, name)))

    def over_stored(self, *names: str) -> Views:
        """The same views; those named, also where others are made of them, are read from storage."""
        v = Views(self.spark, self.folder)
        v._memo = {n: self.stored(n) for n in names}
        return v

    @property
    def labelled(self) -> DataFrame:
        from ..operators.context import with_labels
        return with_labels(self.people, self.ballots, TARGET, REF_YEAR)

    @property
    def scored_labels(self) -> DataFrame:
        """Labels with a probability of few distinct values, so that ties occur."""
        k = F.col("person_row")
        noise = ((k * 37) % 101) / 101.0
        p = F.when(F.col("y_turnout") == 1, 0.2 + 0.7 * noise).otherwise(0.05 + 0.75 * noise)
        return self.labelled.filter("y_turnout >= 0").select(
            "person_row", "ed_key", "y_party", "age", "tier_count", F.col("y_turnout").alias("y"),
            F.round(p, 2).alias("p"))

    @property
    def directed_edges(self) -> DataFrame:
        from ..operators import graph
        return graph.both_directions(self.edges())

    def edges(self) -> DataFrame:
        """Fixed typed edges: household cliques and three kinds of chains over the keys."""
        from ..operators import graph
        k = F.col("person_row")
        people = self.table("customer").select(F.col("c_custkey").alias("person_row"),
                                               F.floor(F.col("c_custkey") / 3).alias("household_row"))
        last = people.agg(F.max("person_row")).scalar()

        def chain(step: int, cond: Column) -> DataFrame:
            return people.filter(cond & (k + step <= last)).select(
                k.alias("u"), (k + step).alias("v"))

        return graph.combine_edges({
            "household": graph.household_edges(people),
            "ed": chain(1, F.lit(True)), "spatial_knn": chain(3, k % 5 != 0),
            "donation": chain(1, k % 2 == 0)})

    @property
    def clusters(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(k.alias("person_row"), F.floor(k / 40).alias("cluster"))

    def census_tables(self) -> list[tuple[str, DataFrame]]:
        """supplier as summary-file tables with text numbers, zeros and missing codes."""
        s = F.col("s_suppkey")
        geo = F.concat(F.when(s % 10 == 9, "1400000US").otherwise("1500000US"), F.lit("36059"),
                       F.lpad(s.cast("string"), 7, "0")).alias("GEO_ID")
        base = self.table("supplier")

        def number(i: int) -> Column:
            return (F.when(s % 11 == i % 11, "-666666666").when(s % 7 == i % 7, "0")
                    .when(s % 23 == i % 23, "*").otherwise((s * (i + 3) % 500 + 1).cast("string")))

        out = []
        for t, (table, columns) in enumerate(C.CENSUS_TABLES.items()):
            keep = base.filter(s % 13 != t)
            out.append((table, keep.select(geo, *[number(t * 5 + j).alias(c)
                                                  for j, c in enumerate(columns)])))
        return out
