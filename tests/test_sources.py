import json

import pytest
from pyspark.sql import functions as F

from wardline import schemas
from wardline.operators import donations, people
from wardline.plans import jobs
from wardline.sources import files, sinks, versions

HEADER = "county,city,zip_code,address_number,street_name,assembly_district,election_district,voters_at_address,household_detail\n"


@pytest.fixture()
def voter_files(tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text(HEADER + 'NASSAU,Town,11797.0,17B,Main Street,12.0,3,2,"ANN ROE (41, DEM, F1): 2024 GENERAL: Mail | BO ROE (50, BLK, X4)"\n'
                 'Nassau,Town,null,,Oak,12,3,1,junk\n')
    b.write_text(HEADER.replace("county,", "extra,county,") + 'z,SUFFOLK,City,11700,5,Elm Road,1,9,1,"CY DOE (30, REP, I0)"\n')
    return [str(a), str(b)]


def test_household_scans(spark, voter_files):
    h = files.read_households(spark, voter_files)
    rows = {r["city"] + r["address_number"]: r for r in h.collect()}
    assert rows["Town17B"]["zip_code"] == "11797" and rows["Town17B"]["assembly_district"] == 12
    assert rows["Town"]["zip_code"] == "" and len(rows) == 3
    assert [r["city"] for r in h.orderBy("ordinal").collect()] == ["Town", "Town", "City"]
    assert files.read_households(spark, voter_files, county="nassau").count() == 2
    kept, report = files.read_addressed_households(spark, voter_files)
    assert kept.count() == 2 and report.first()["dropped"] == 1
    narrow = files.read_household_columns(spark, voter_files + ["/no/such/file.csv"], ["county", "num_reliable", "household_detail"])
    assert narrow.columns == ["county", "household_detail"] and narrow.count() == 3


def test_cache_and_contributions(spark, tmp_path):
    cache = tmp_path / "cache.json"
    cache.write_text(json.dumps({
        "A B|X|1": {"confirmed": [{"date": "2020-01-02", "amount": 5, "committee": "C"}], "possible": [], "checked_at": "t"},
        "C D|X|1": {"confirmed": [], "possible": [{"date": "", "amount": None, "committee": " "}]}, "E": {"timeout": True}}))
    assert [r["key"] for r in files.read_donation_cache(spark, str(cache), "fec", lines=False).collect()] == ["A B|X|1"]
    (tmp_path / "lines.json").write_text('{"key":"A B|X|1","confirmed":[{"date":"2020-01-02","amount":5,"committee":"C"}]}\n{"key":"Z"}\n')
    by_line = files.read_donation_cache(spark, str(tmp_path / "lines.json"), "fec").collect()
    assert [(r["key"], r["confirmed"][0]["amount"], r["possible"]) for r in by_line] == [("A B|X|1", 5.0, [])]
    full = files.read_donation_cache(spark, str(cache), "fec", confirmed_only=False, lines=False)
    assert full.count() == 3
    rows = {r["donor_key"]: r for r in donations.donation_rows(full).collect()}
    assert rows["A B|X|1"]["confirmed"] and rows["C D|X|1"]["committee"] is None

    def line(state, name="DOE, ANN", amount="5", n=15):
        f = [""] * 21
        f[0], f[7], f[8], f[9], f[10], f[13], f[14] = "C1", name, " town ", state, "117971234", "01022024", amount
        return "|".join(f[:n])

    bulk = tmp_path / "bulk.txt"
    bulk.write_bytes("\n".join([line("NY"), line("ny", "MU\xd1OZ, B", "x"), line("NJ"), line("NY", n=12)]).encode("latin-1"))
    got = files.read_bulk_contributions(spark, str(bulk)).orderBy("ordinal").collect()
    assert [(r["name"], r["city"], r["zip"], r["date"], r["amount"]) for r in got] == [
        ("DOE, ANN", "TOWN", "11797", "2024-01-02", 5.0), ("MU\xd1OZ, B", "TOWN", "11797", "2024-01-02", 0.0)]
    for c, n in ((2022, "Old"), (2024, "New")):
        (tmp_path / f"cm{c}").write_text(f"C1|{n}|x\nbad\n")
    names = files.read_committee_names(spark, {2024: str(tmp_path / "cm2024"), 2022: str(tmp_path / "cm2022")})
    assert [tuple(r) for r in names.collect()] == [("C1", "New")]


@pytest.fixture()
def small_splits(spark):
    """Byte ranges of a few hundred bytes, several of them in one task."""
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_file_order_over_a_folder(spark, tmp_path, small_splits):
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for f, rows in (("b.csv", 90), ("a c.csv", 3), ("d.csv", 40), ("c.csv", 1)):
        lines = [f"{HEADER}".strip()] + [f"NASSAU,T{f[0]}{i},1,{i},Main,1,1,1,{'x' * (i % 50)}" for i in range(rows)]
        (folder / f).write_text("\n".join(lines) + "\n")
    for f, rows in (("a", 3), ("b", 90), ("c", 1), ("d", 40)):
        want += [f"T{f}{i}" for i in range(rows)]
    h = files.number_rows(files.read_households(spark, [str(folder), str(folder / "d.csv")]))
    got = [r["city"] for r in h.orderBy("household_row").collect()]
    assert got == want + [f"Td{i}" for i in range(40)]
    assert sorted(r["household_row"] for r in h.collect()) == list(range(174))
    assert spark.read.csv(str(folder)).rdd.getNumPartitions() > 3
    first = people.first_per_key(h.select("county", "city", "ordinal"), "county", "ordinal").first()
    assert first["city"] == "Ta0"
    names = tmp_path / "names"
    names.mkdir()
    for f in ("2", "1"):
        (names / f).write_text("".join(f"C{i % 7}|name {f} {i}|x\n" for i in range(80)))
    got = {r["committee_id"]: r["committee_name"] for r in files.read_committee_names(spark, {2024: str(names)}).collect()}
    assert got == {f"C{k}": f"name 2 {max(i for i in range(80) if i % 7 == k)}" for k in range(7)}


def test_one_object_is_read_in_parts(spark, tmp_path, small_splits):
    """Strings with braces, quotes and backslashes at every place of a byte range."""
    odd = ["}", "{", '"', "\\", '\\"}', "a{b}c", '{"x": "}"}', "\u00e9}", "", "end\\"]
    cache = {f"K{i}|{odd[i % 10]}|{i}": {"confirmed": [{"date": "2020-01-02", "amount": i + k, "committee": odd[(i + k) % 10] * (i % 9)} for k in range(i % 4)],
                                      "possible": [], "checked_at": odd[i % 7]} for i in range(300)}
    for k, indent in enumerate((None, 2)):
        path = tmp_path / f"cache{k}.json"
        path.write_text(json.dumps(cache, indent=indent, ensure_ascii=bool(k)))
        got = files.read_donation_cache(spark, str(path), "fec", confirmed_only=False, lines=False)
        rows = {r["key"]: r for r in got.collect()}
        assert rows.keys() == cache.keys() and got.count() == 300
        for key, entry in cache.items():
            assert [c.asDict() for c in rows[key]["confirmed"]] == entry["confirmed"] and rows[key]["checked_at"] == entry["checked_at"]
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 50
    (tmp_path / "none.json").write_text("{}")
    assert files.read_donation_cache(spark, str(tmp_path / "none.json"), "fec", False, False).count() == 0
    layer = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": [
        {"type": "Feature", "properties": {"SLD": str(i), "note": odd[i % 10]}, "geometry": {
            "type": "Polygon", "coordinates": [[[0, 0], [i, 0], [i, i], [0, 0]]]}} for i in range(1, 60)], "last": {"a": 1}}
    for k, order in enumerate((list(layer), ["features", "crs", "type", "last"])):
        (tmp_path / f"l{k}.json").write_text(json.dumps({c: layer[c] for c in order}))
        got = {r["d"]: r["rings"][0][1]["x"] for r in files.read_geojson(spark, str(tmp_path / f"l{k}.json"), ["SLD"], "d").collect()}
        assert got == {str(i): float(i) for i in range(1, 60)}
    results = {race: {str(y): {str(d): {"total_votes": y + d, "winner": odd[d % 10]} for d in range(9)} for y in (2020, 2022)} for race in ("senate", "house")}
    (tmp_path / "r.json").write_text(json.dumps(results))
    got = {(r["race"], r["year"], r["district"]): (r["total_votes"], r["winner"]) for r in files.read_results(spark, str(tmp_path / "r.json")).collect()}
    assert got == {(a, int(y), d): (x["total_votes"], x["winner"]) for a, ys in results.items() for y, ds in ys.items() for d, x in ds.items()}


def test_layers_and_results(spark, tmp_path):
    g = tmp_path / "l.geojson"
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    g.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"SLD": "012"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"SLD": "3"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}, indent=1))
    got = {r["district"]: len(r["rings"]) for r in files.read_geojson(spark, str(g), ["DIST", "SLD"], "district").collect()}
    assert got == {"12": 1, "3": 2}
    r = tmp_path / "r.json"
    r.write_text(json.dumps({"senate": {"2024": {"3": {"total_votes": 9, "dem_pct": 55.5, "winner": "DEM"}}}}))
    assert files.read_results(spark, str(r)).first()["dem_pct"] == 55.5
    p = tmp_path / "p.csv"
    p.write_text("office,district,candidate,party,votes\nState Senate,3,A,DEM,5\nState Senate,77,A,DEM,5\nGovernor,,A,DEM,5\nU.S. House,x,A,DEM,1\n")
    assert files.read_precincts(spark, str(p)).select("race", "district").collect() == [("senate", "3")]
    v = tmp_path / "v.json"
    v.write_text('{"zip":"11797","county":"NASSAU"}\n{"zip":"10001","county":"KINGS"}\n')
    assert files.read_registrations(spark, str(v), ["Nassau"]).count() == 1
    c = tmp_path / "c.dat"
    c.write_text("GEO_ID|B01002_E001\n1500000US360591234567|41.5\n1500000US360590000001|-666666666\n1400000US36059|3\n")
    rows = {x["bg_geoid"]: x["median_age"] for x in files.read_census_table(spark, str(c), "b01002", ["1500000US36059"]).collect()}
    assert rows == {"360591234567": 41.5, "360590000001": None}


def test_sinks(spark, tmp_path):
    t = sinks.write_stage(spark.range(6).withColumn("county", F.col("id") % 2), str(tmp_path / "t"), ["county"])
    assert t.count() == 6
    fresh = spark.range(6).withColumn("acs_x", F.col("id") * 2)
    new = sinks.replace_columns(t.withColumn("acs_old", F.lit(1)), fresh, "id", "acs_", [], str(tmp_path / "t2"))
    assert sorted(new.columns) == ["acs_x", "county", "id"] and new.filter("acs_x = 2 * id").count() == 6
    sinks.write_list(t.orderBy("id"), str(tmp_path / "list"))
    assert spark.read.csv(str(tmp_path / "list"), header=True).count() == 6
    sinks.write_metrics(t.agg(F.count("*").alias("n")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["n"] == 6


def test_money_sums_do_not_depend_on_row_order(spark, tmp_path):
    rows = [("A|T|11797", "fec", "2020-01-02", (k * 7919 % 100_000) / 100 + (1e7 if k % 500 == 0 else 0), f"C{k % 3}", k % 5 > 0, k) for k in range(3000)]
    kinds = "donor_key string, source string, donation_date string, amount double, committee string, confirmed boolean, ordinal long"
    cents = sum(round(r[3] * 100) for r in rows if r[5])
    seen = set()
    for n, order in ((1, rows), (7, rows[::-1]), (13, sorted(rows, key=lambda r: r[3]))):
        d = spark.createDataFrame(order, kinds).withColumn("donation_date", F.to_date("donation_date")).repartition(n)
        people_of = spark.createDataFrame([("A|T|11797", "DEM", 1), ("A|T|11797", "DEM", 2)], "donor_key string, party string, person_row long")
        total = donations.donor_summaries(d).first()["total_donated"]
        assert total == cents / 100 == donations.donation_meta(d).first()["confirmed_total"] == donations.top_zips(d).first()["total"]
        assert donations.party_giving(d, people_of).first()["total"] == 2 * cents / 100
        seen.add(tuple(r["total"] for r in donations.top_committees(d).collect()))
        stored = sinks.reload_donations(d, str(tmp_path / f"d{n}"))
        assert stored.count() == 3000 and stored.agg(F.sum("amount")).first()[0] * 100 == sum(round(r[3] * 100) for r in rows)
    assert len(seen) == 1


def test_versions_survive_a_crash_and_runs_count_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "people")
    with pytest.raises(LookupError):
        versions.read(spark, folder)
    first = versions.publish(spark.createDataFrame([(1, "ANN", None), (2, "BO", 0.5)], "person_id long, name string, turnout_prob double"), folder)
    scores = spark.createDataFrame([(1, 0.12345, 0.1, 0.2), (9, 0.9, 0.1, 0.2)], "person_id long, turnout_propensity double, p_dem_lean double, p_rep_lean double")
    for _ in range(2):  # the second one changes nothing
        now = sinks.store_scores(scores, folder, "scores 2024")
        assert {r["person_id"]: r["turnout_prob"] for r in now.collect()} == {1: 0.1235, 2: 0.5}
    batch = spark.createDataFrame([(2, "BO", 1), (3, "CY", 2), (3, "CY", 3)], "person_id long, name string, ordinal long").withColumn(
        "turnout_prob", F.lit(None).cast("double")).withColumns({c: F.lit(None).cast("double") for c in ("dem_lean_prob", "rep_lean_prob")})
    for _ in range(2):
        now = sinks.load_absent(batch, folder, ["person_id"], ["ordinal"], "load 7")
        assert sorted(r["name"] for r in now.collect()) == ["ANN", "BO", "CY"]
    assert [(v, run) for v, _, run in versions.history(spark, folder)] == [(1, None), (2, "scores 2024"), (3, "load 7")]
    # a run that ends after its data and before its pointer: the old version stays current, a repeat succeeds
    write = versions.publish

    def crash(df, *rest):
        df.write.parquet(f"{folder}/data/half")
        raise KeyboardInterrupt
    monkeypatch.setattr(versions, "publish", crash)
    with pytest.raises(KeyboardInterrupt):
        versions.update(spark, folder, lambda t: t.limit(0), "load 8")
    assert versions.read(spark, folder).count() == 3
    monkeypatch.setattr(versions, "publish", write)
    versions.update(spark, folder, lambda t: t.filter("person_id > 1"), "load 8")
    assert versions.read(spark, folder).count() == 2 and versions.read(spark, folder, 2).count() == 2
    assert first.count() == versions.read(spark, folder, 1).count() == 2 and "dem_lean_prob" not in first.columns
    with pytest.raises(LookupError):
        versions.read(spark, folder, 9)


def test_voter_files_to_people_in_one_job(spark, voter_files, tmp_path):
    empty = spark.createDataFrame([], "donor_key string, source string, donation_date string, amount double, committee string, confirmed boolean")
    streets = spark.createDataFrame([("NASSAU", "Main Street", "1", "49", "2", "50", "11797", "11797", "S1400", 0, [(-73.5, 40.7), (-73.4, 40.7)])], schemas.SEGMENT)
    out = jobs.build_from_files(spark, voter_files, streets, empty, 2024, 2026, str(tmp_path / "stage"))
    p = {r["name"]: r for r in out["people"].collect()}
    assert set(p) == {"ANN ROE", "BO ROE", "CY DOE"} and p["ANN ROE"]["household_row"] == 0 and p["CY DOE"]["household_row"] == 2
    assert p["ANN ROE"]["has_geo"] == 1 and -73.5 < p["ANN ROE"]["lon"] < -73.4 and p["CY DOE"]["has_geo"] == 0
    assert sorted(r["person_row"] for r in out["history"].collect()) == [0, 1, 2]


def test_refresh_is_deterministic_and_adds_people_of_stored_households(spark):
    stored = spark.createDataFrame([("h1", "ANN")], "household_id string, name string")
    batch = spark.createDataFrame([("h1", "ANN", 1), ("h1", "BO", 2), ("h1", "BO", 3), ("h2", "CY", 4)],
                                  "household_id string, name string, ordinal long")
    got = sinks.insert_absent(stored, batch, ["household_id", "name"], ["ordinal"])
    assert {(r["name"], r["ordinal"]) for r in got.collect()} == {("BO", 2), ("CY", 4)}


def test_voter_file_to_features_end_to_end(spark, voter_files, tmp_path):
    h = files.number_rows(files.read_households(spark, voter_files))
    empty = spark.createDataFrame([], "donor_key string, source string, donation_date string, amount double, committee string, confirmed boolean")
    out = jobs.build_person_tables(h.withColumns({"lon": F.lit(None).cast("double"), "lat": F.lit(None).cast("double")}),
                                   empty, 2024, 2026, str(tmp_path / "stage"))
    p = {r["name"]: r for r in out["people"].collect()}
    assert set(p) == {"ANN ROE", "BO ROE", "CY DOE"} and p["ANN ROE"]["y_turnout"] == 1
    assert p["BO ROE"]["hh_dem_share_excl"] == 1.0 and p["CY DOE"]["has_donation"] == 0
    assert out["history"].count() == 3 and out["ballots"].count() == 1
    assert sorted(r["person_row"] for r in out["people"].collect()) == [0, 1, 2]
    payload = jobs.build_district_payload(h, spark.createDataFrame([], out["segments_schema"]), str(tmp_path / "site"))
    assert payload == str(tmp_path / "site")
    assert spark.read.json(payload).count() == 2
    assert people.unparseable_households(people.with_people(h)).first()["without_people"] == 1


def test_graph_job_stores_every_table(spark, tmp_path):
    n = F.col("id")
    p = spark.range(90).select(
        n.alias("person_row"), F.floor(n / 3).alias("household_row"), F.lit("C").alias("county"), F.lit("T").alias("city"),
        F.lit("MAIN ST").alias("street_name"), F.floor(n / 6).alias("address_number"),
        F.concat(F.lit("E"), (n % 5).cast("string")).alias("ed_key"),
        (-73 - F.floor(n / 6) * 0.01).alias("lon"), F.lit(40.0).alias("lat"))
    d = p.select("person_row", F.lit("Club").alias("committee"))
    out = jobs.build_graph(p, d, str(tmp_path / "g"), seed=3, steps=2)
    assert out["walks"].count() == 90 and out["clusters"].select("cluster").distinct().count() == 1
    assert out["walks"].filter("rw1 <> 0 or rw2 <= 0 or rw2 > 1").count() == 0
    assert {r["etype"] for r in out["edges"].select("etype").distinct().collect()} >= {"household", "same_address", "spatial_knn"}


def test_match_refresh_job(spark, tmp_path):
    import datetime as dt
    now = dt.datetime(2024, 6, 1)
    voters = spark.createDataFrame([("k1", "ANN ROE", "TOWN", "1"), ("k2", "BO DOE", "TOWN", "1")], "key string, name string, city string, zip string")
    recs = spark.createDataFrame([("ROE", ["ANN", "ROE"], "TOWN", "1", "2024-01-01", 5.0, "C", 0), ("DOE", ["BO", "DOE"], "X", "1", "", 1.0, "C", 1)],
                                 "last string, tokens array<string>, city string, zip string, date string, amount double, committee string, ordinal long")
    entries = spark.createDataFrame([("k2", 1, 0, now - dt.timedelta(days=2), "api", False)],
                                    "key string, n_confirmed long, n_possible long, checked_at timestamp, source string, timeout boolean")
    stored = spark.createDataFrame([("k2", "confirmed", "2020-01-01", 9.0, "D", 7)],
                                   "key string, status string, date string, amount double, committee string, ordinal long")
    out = jobs.refresh_matches(voters, recs, entries, stored, now, str(tmp_path / "m"))
    assert {(r["key"], r["origin"]) for r in out["entries"].collect()} == {("k1", "found"), ("k2", "existing")}
    assert {(r["key"], r["amount"]) for r in out["records"].collect()} == {("k1", 5.0), ("k2", 9.0)}


def test_prospect_job(spark, voter_files, tmp_path):
    import datetime as dt
    h = files.number_rows(files.read_households(spark, voter_files))
    p = people.number_people(people.explode_people(people.with_people(h)))
    gifts = spark.createDataFrame([("ROE BO|TOWN|11797", "fec", "2025-01-01", 99.0, "Progressive Fund", True, 0)],
                                  "donor_key string, source string, donation_date string, amount double, committee string, confirmed boolean, ordinal long")
    jobs.build_prospect_list(p, gifts, 12, dt.date(2026, 7, 17), str(tmp_path / "p"))
    r = spark.read.csv(str(tmp_path / "p"), header=True).collect()
    assert len(r) == 1 and (r[0]["first_name"], r[0]["address"], r[0]["donor_score"]) == ("Bo", "17B Main Street", str(40 + 15 + 12 + 2 + 10 + 5))
