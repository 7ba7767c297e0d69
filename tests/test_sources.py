"""Readers, writers and streams over small files."""

import datetime as dt
import json
import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cadastra.operators import listings
from cadastra.plans import adapters, feed_queries, identity_queries
from cadastra.session import shared_dir
from cadastra.sources import readers, writers
from cadastra.streaming import feeds

D = dt.date


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_header_dialects(spark, tmp_path):
    web = write(tmp_path / "web.csv", 'TRANSACTION_NUMBER,INSTANCE_DATE,GROUP_EN,TRANS_VALUE,ACTUAL_AREA,AREA_EN,ROOMS_EN,PROJECT_NUMBER,IS_OFFPLAN_EN\n"11-5-2026",27-08-2026,Mortgage Registration,"1,500.50",0,BUSINESS BAY,1 B/R,17.00,Off-Plan\n')
    bulk = write(tmp_path / "bulk.csv", "transaction_id,instance_date,trans_group_en,actual_worth,procedure_area\n1-11-2026-5,2026-08-28,Sales,1500,10\n")
    row = readers.type_transactions(readers.read_register(spark, web, readers.TRANSACTION_FIELDS, ["transaction_id"]), "web").first()
    assert (row.instance_date, row.feed_date, row.trans_group, row.actual_worth, row.procedure_area) == (D(2026, 8, 27), None, "Mortgages", 1500.5, None)
    assert (row.area_name, row.rooms, row.project_number, row.reg_type) == ("Business Bay", "1 B/R", "17", "Off-Plan Properties")
    row = readers.type_transactions(readers.read_register(spark, bulk, readers.TRANSACTION_FIELDS), "bulk").first()
    assert (row.feed_date, row.meter_sale_price, row.area_name) == (D(2026, 8, 28), 150.0, "Unknown")
    with pytest.raises(readers.MissingFields):
        readers.read_register(spark, bulk, readers.TRANSACTION_FIELDS, ["rooms"])
    cover = {r.field: r.header for r in readers.header_coverage(spark.read.csv(bulk, header=True), readers.TRANSACTION_FIELDS).collect()}
    assert cover["actual_worth"] == "actual_worth" and cover["rooms"] is None and len(cover) == len(readers.TRANSACTION_FIELDS)


def test_stray_quotes(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'id,name,kind\r\n1,"Residential" 2 Towers",Flat\r\n2,plain,"a,b"\n3,"x","y"\n')
    got = [tuple(r) for r in readers.read_repaired(spark, path, ["id", "name", "kind"]).collect()]
    assert got == [("1", "Residential' 2 Towers", "Flat"), ("2", "plain", "a,b"), ("3", "x", "y")]


def test_duplicate_downloads_are_left_out(spark, tmp_path):
    for name in ("rents.csv", "rents 2.csv", "rents (1).csv"):
        write(tmp_path / name, "contract_id\n1\n")
    assert readers.read_parts(spark, str(tmp_path / "rents*.csv")).count() == 2


def test_latest_snapshot_by_name(spark):
    files = spark.createDataFrame([
        ("/a/Register_2026-09-15.csv", 5000, 1), ("/b/Register_20260915.csv", 5000, 0), ("/a/Register_2026-09-16.csv", 10, 0), ("/a/notes.csv", 9000, 0)],
        "path string, length long, root_rank int")
    row = readers.latest_snapshot(files).first()
    assert (row.path, row.file_date) == ("/b/Register_20260915.csv", D(2026, 9, 15))


def test_snapshot_typing(spark):
    cols = ["PROJECT_NUMBER", "PROJECT_EN", "DEVELOPER_EN", "PROJECT_STATUS", "PERCENT_COMPLETED", "AREA_EN", "END_DATE", "INSPECTION_DATE", "CNT_UNIT"]
    raw = spark.createDataFrame([(" 12 ", "A", "B", "ACTIVE", "n/a", "X", "2027-01-31", "31/08/2026", "40"), (None,) * 9], ", ".join(f"{c} string" for c in cols))
    row = readers.type_snapshot(raw).collect()
    assert len(row) == 1 and (row[0].project_number, row[0].percent_completed, row[0].completion_date, row[0].observed_at, row[0].units) == ("12", None, D(2027, 1, 31), D(2026, 8, 31), 40)


def test_dossiers_and_groups(spark, tmp_path):
    write(tmp_path / "i" / "x.json", json.dumps({"id": "x", "dldDevelopers": ["1"], "bonds": [{"name": "8% sukuk due 8 Jun 2027", "price": "99.45 / 101.4"}], "maturityWall": [{"year": "to mid-2027", "usdM": 251}]}, indent=1))
    write(tmp_path / "g.json", json.dumps([{"slug": "g", "name": "G", "members": ["1", "2"]}]))
    row = readers.read_dossiers(spark, str(tmp_path / "i")).first()
    assert row.issuer == "x" and row.periods is None and row.maturityWall[0].year == "to mid-2027"
    from cadastra.operators import issuers
    ins = issuers.parse_instruments(readers.read_dossiers(spark, str(tmp_path / "i"))).first()
    assert (ins.coupon, ins.maturity, ins.kind, ins.bid, ins.ask) == (0.08, D(2027, 6, 8), "Sukuk", 99.45, 101.4)
    assert [r.developer_number for r in readers.read_groups(spark, str(tmp_path / "g.json")).collect()] == ["1", "2"]


def test_permits_pick_per_row(spark):
    raw = spark.createDataFrame([("1", "", "2026-01-02", "New Building", "al quoz"), ("", "2", "03/02/2026", "Demolition", "")], "permit_number string, APPLICATION_NUMBER string, issue_date string, permit_type string, odd string")
    got = [(r.permit_number, r.permit_date, r.is_new_building) for r in readers.permit_rows(raw).collect()]
    assert got == [("1", D(2026, 1, 2), True), ("2", D(2026, 2, 3), False)]
    assert readers.unknown_headers(raw.columns, readers.PERMIT_FIELDS) == ["odd"]


SCAN = "source,source_id,permit_number,url,area_name_en,project_name_en,building_name_en,unit_number,rooms_en,area_sqm,is_off_plan,asking_price\n"


def test_scans_are_read_once(spark, tmp_path):
    write(tmp_path / "s" / "scan-2026-01-01.csv", SCAN + 's,1,,,A,,,,2 B/R,80,0,"1,000,000"\n')
    write(tmp_path / "s" / "scan-2026-01-08.csv", SCAN + "s,1,,,A,,,,2 B/R,80,TRUE,900000\n")
    done = spark.createDataFrame([(D(2026, 1, 1),)], "observed_at date")
    assert readers.read_scans(spark, str(tmp_path / "s")).count() == 2
    row = readers.read_scans(spark, str(tmp_path / "s"), done).first()
    assert (row.listing_id, row.observed_at, row.asking_price, row.is_off_plan) == ("s:1", D(2026, 1, 8), 900_000.0, True)

    def run():
        rows = feeds.stream_scans(spark, str(tmp_path / "s"))
        feeds.run_available(rows.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 2
    write(tmp_path / "s" / "scan-2026-01-15.csv", SCAN + "s,1,,,A,,,,2 B/R,80,0,800000\n")
    assert run() == 3 and run() == 3


def test_gated_replacement(spark, tmp_path):
    df = spark.range(20).withColumn("v", F.lit(1))
    store, staging = str(tmp_path / "store"), str(tmp_path / "staging")
    for bad in (dict(required=["nope"], min_rows=1), dict(required=["id"], min_rows=21), dict(required=["id"], min_rows=1, complete=False)):
        with pytest.raises(writers.Rejected):
            writers.replace_if_valid(df, staging, store, **bad)
    assert writers.replace_if_valid(df, staging, store, ["id"], 20) == 20
    assert writers.read_store(spark, store).count() == 20
    with pytest.raises(writers.Rejected):
        writers.replace_if_valid(df.limit(15), staging, store, ["id"], 1, received=16)
    assert writers.read_store(spark, store).count() == 20
    assert writers.replace_if_valid(df.limit(15), staging, store, ["id"], 1, received=15) == 15
    assert writers.read_store(spark, store).count() == 15


def test_manifest_does_not_depend_on_order(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    one = writers.write_with_manifest(df, str(tmp_path / "m1"), ["k", "v"], {"x": 1}, ["k"]).orderBy("part").collect()
    two = writers.write_with_manifest(df.orderBy(F.desc("v")).repartition(3), str(tmp_path / "m2"), ["k", "v"], {"x": 1}, ["k"]).orderBy("part").collect()
    assert one == two and [(r.part, r.rows) for r in one] == [("a", 2), ("all", 3), ("b", 1)]
    changed = writers.manifest(df.withColumn("v", F.col("v") + 1), ["k", "v"], {"x": 2}).first()
    assert changed.content_hash != one[1].content_hash and changed.config_hash != one[1].config_hash


def test_publish_keeps_column_order(spark, tmp_path):
    writers.publish(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "p"), ["b", "a"])
    assert spark.read.csv(str(tmp_path / "p"), header=True).columns == ["b", "a"]


def test_editions_are_written_once(spark, tmp_path):
    path = str(tmp_path / "e")
    assert writers.weekly_due(writers.held_editions(spark, path), "2026-09-14")
    assert writers.write_edition(spark.range(3), path, "weekly", "2026-09-07")
    assert not writers.write_edition(spark.range(5), path, "weekly", "2026-09-07")
    assert writers.write_edition(spark.range(5), path, "weekly", "2026-09-07", force=True)
    held = writers.held_editions(spark, path)
    assert held == {("weekly", "2026-09-07")} and not writers.weekly_due(held, "2026-09-13") and writers.weekly_due(held, "2026-09-14")
    assert spark.read.parquet(path).count() == 5


def test_a_local_session_without_a_shared_folder_gets_one_of_its_own():
    def bare(master, app="a"):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master, applicationId=app))

    one, two, other = (shared_dir(bare("local[2]", app), "x") for app in ("a", "a", "b"))
    assert os.path.dirname(one) == os.path.dirname(two) != os.path.dirname(other) and one != two
    with pytest.raises(ValueError):
        shared_dir(bare("spark://host:7077"), "x")


LISTED = "listing_id string, observed_at date, asking_price double, is_off_plan boolean, filed long"


def test_editions_are_written_whole_and_apart(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = spark.createDataFrame([("a", 1.5, D(2026, 9, 1), None), ("b", 1e12, None, [1, 2])], "name string, value double, day date, ids array<int>")
    none = spark.createDataFrame([], "n long")
    assert writers.write_sections({"one": rows, "two": none}, path, "weekly", "2026-09-07")
    assert not writers.write_sections({"one": none, "two": none}, path, "weekly", "2026-09-07")
    assert writers.write_sections({"one": rows.limit(1), "two": spark.range(3).withColumnRenamed("id", "n")}, path, "monthly", "2026-08")
    one = writers.read_section(spark, path, "one", "weekly", "2026-09-07")
    assert sorted(tuple(r) for r in one.drop("kind", "key").collect()) == sorted(tuple(r) for r in rows.collect())
    assert one.drop("kind", "key").schema == rows.schema and writers.read_section(spark, path, "two", "weekly").count() == 0
    assert writers.write_sections({"one": none, "two": none}, path, "weekly", "2026-09-07", force=True)
    assert writers.read_section(spark, path, "one", "weekly").count() == 0 and writers.read_section(spark, path, "two", "monthly").count() == 3
    assert writers.held_editions(spark, path) == {("weekly", "2026-09-07"), ("monthly", "2026-08")}
    with pytest.raises(ValueError):
        writers.read_section(spark, path, "three")


def listing_rows(step):
    """Scans of three listings on every ``step``-th day, one of them off-plan; listing a skips the fifth scan, c is filed twice on the third."""
    prices = [("a", 1, 100.0), ("a", 2, 100.0), ("a", 3, 100.0), ("a", 4, 90.0), ("a", 6, 80.0), ("a", 7, 80.0), ("a", 8, 70.0), ("b", 1, 50.0), ("b", 2, 50.0), ("b", 3, 45.0)]
    prices += [("c", d, p) for d, p in enumerate((2.0, 2.0, 2.5, 1.9, 1.9, 1.9, 1.8, 1.8), 1)] + [("c", 3, 2.0)]
    return [(k, D(2026, 1, 1) + dt.timedelta(days=step * (d - 1)), p * 10_000, k == "c", n) for n, (k, d, p) in enumerate(prices)]


def tracked(spark, tmp_path, name, files, step, at_once=None, tracker=None):
    landed, out = str(tmp_path / f"l{name}"), str(tmp_path / f"o{name}")
    calendar = feeds.scan_calendar(spark.createDataFrame([r[:2] for r in listing_rows(step)], "listing_id string, observed_at date"))
    with feeds.state_store(spark):
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("append").parquet(landed)
            if at_once is None or k == len(files) - 1:
                stream = feeds.stream_listing_state(feeds.stream_parquet(spark, landed, LISTED, files_per_trigger=at_once or 100), calendar, tracker)
                feeds.run_available(stream.writeStream.format("parquet").option("path", out), str(tmp_path / f"c{name}"))
    return spark.read.parquet(out)


@pytest.mark.parametrize("step", [1, 7])
def test_listing_stream_agrees_with_the_batch(spark, tmp_path, step):
    """Daily and weekly scans give the batch answer in whatever order and split their files come."""
    rows = listing_rows(step)
    prices = spark.createDataFrame(rows, LISTED).groupBy("listing_id", "observed_at").agg(F.max_by("asking_price", "filed").alias("asking_price"))
    obs = listings.track_presence(prices).cache()
    flat = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "listing_id string, is_off_plan boolean")
    cuts = {(r.listing_id, r.observed_at) for r in listings.price_cuts(obs, flat).filter("validated").collect()}
    want = {(r.listing_id, r.observed_at, r.asking_price, r.streak + 1, (r.listing_id, r.observed_at) in cuts) for r in listings.streaks(obs).filter("seen").collect()}
    days = sorted({r[1] for r in rows})
    assert ("c", days[3]) in cuts and ("a", days[3]) in cuts and ("a", days[5]) not in cuts
    of = lambda lo, hi: [r for r in rows if days[lo] <= r[1] <= days[hi]]
    third = [of(0, 2), of(3, 4), of(5, 7)]
    for name, files, at_once in (("in order", third, None), ("last first", third[::-1], None), ("mixed", [rows[k::5] for k in (3, 1, 4, 0, 2)], 1)):
        sent = tracked(spark, tmp_path, f"{name}{step}", files, step, at_once)
        got = {(r.listing_id, r.observed_at, r.asking_price, r.streak, r.is_drop) for r in feeds.listing_state(sent).collect()}
        assert got == want, name
        firsts = {(r.listing_id, r.first_price) for r in feeds.listing_state(sent).collect()}
        assert firsts == {("a", 1_000_000.0), ("b", 500_000.0), ("c", 20_000.0)}


def test_a_scan_outside_the_calendar_stops_the_stream(spark, tmp_path):
    with pytest.raises(Exception, match="calendar does not name: 2026-02-01"):
        tracked(spark, tmp_path, "x", [[("a", D(2026, 2, 1), 1.0, False, 1)]], 1)


def test_listing_state_is_let_go_after_its_days(spark, tmp_path):
    rows = listing_rows(1)
    files = [[r for r in rows if r[0] == "a" and r[1] < D(2026, 1, 5)], [("z", D(2026, 3, 1), 1.0, False, 99)], [("a", D(2026, 3, 2), 700_000.0, False, 100)]]
    calendar = feeds.scan_calendar(spark.createDataFrame([(r[1],) for f in files for r in f], "observed_at date"))
    landed, out = str(tmp_path / "l"), str(tmp_path / "o")
    with feeds.state_store(spark):
        for rows in files:
            spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("append").parquet(landed)
            stream = feeds.stream_listing_state(feeds.stream_parquet(spark, landed, LISTED), calendar, feeds.ListingTracker(keep_days=10))
            feeds.run_available(stream.writeStream.format("parquet").option("path", out), str(tmp_path / "c"))
    got = {(r.listing_id, r.observed_at): (r.first_price, r.streak) for r in feeds.listing_state(spark.read.parquet(out)).collect()}
    assert got["a", D(2026, 1, 4)] == (1_000_000.0, 4) and got["a", D(2026, 3, 2)] == (700_000.0, 1)


def test_stream_dedupe_does_not_depend_on_the_batches(spark, tmp_path):
    schema = "tx_key string, event_time timestamp"
    for k, month in enumerate((9, 1, 5)):  # neither in order nor in reverse, one file a batch
        ts = dt.datetime(2026, month, 1)
        spark.createDataFrame([(f"k{month}", ts), ("all", ts), ("all", ts), (None, ts)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    want = sorted([("None", m) for m in (1, 5, 9)] + [("all", 1), ("k1", 1), ("k5", 5), ("k9", 9)])
    for files in (1, 100):
        rows = feeds.stream_parquet(spark, str(tmp_path / "in" / "*"), schema, files_per_trigger=files)
        out = str(tmp_path / f"out{files}")
        feeds.run_available(feeds.stream_dedupe(rows, out, order=["event_time"], buckets=4), str(tmp_path / f"cp{files}"))
        held = lambda **kw: sorted((str(r.tx_key), r.event_time.month) for r in feeds.registrations(spark, out, order=["event_time"], buckets=4, **kw).collect())
        assert held() == want and held(keys=["all", "k9", "no"]) == [("all", 1), ("k9", 9)]
        newest = feeds.compact(spark, out, order=["event_time"], buckets=4)
        assert held() == want and feeds.compact(spark, out, order=["event_time"], buckets=4) == newest
        spark.createDataFrame([("late", dt.datetime(2026, 2, 1)), ("all", dt.datetime(2025, 12, 1))], schema).withColumn("bucket", feeds._bucket("tx_key", 4)).write.partitionBy(
            "bucket").parquet(f"{out}/log/epoch={newest + 1}")  # the next batch
        assert held() == sorted([w for w in want if w[0] != "all"] + [("all", 12), ("late", 2)])


def test_dedupe_reads_nothing_that_is_held(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", dt.datetime(2026, 1, 1))], "tx_key string, event_time timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    (tmp_path / "out" / "log" / "epoch=-5").mkdir(parents=True)
    (tmp_path / "out" / "log" / "epoch=-5" / "part-0.parquet").write_text("no file anyone could read")
    stream = feeds.stream_dedupe(feeds.stream_parquet(spark, str(tmp_path / "in"), rows.schema), out)
    feeds.run_available(stream, str(tmp_path / "cp"))
    assert spark.read.parquet(f"{out}/log/epoch=0").count() == 1


def _registrations(spark, n):
    return spark.range(n).selectExpr(
        "'1-11-2000-' || id AS transaction_id", "'11|2000|' || id || '|Sales' AS expected_key", "DATE '2000-01-01' AS instance_date", "'Sales' AS trans_group", "'Sell' AS procedure_name",
        "'Off-Plan Properties' AS reg_type", "'Unit' AS property_type", "'A' AS area_name", "'7' AS project_number", "'P' AS project_name", "'2 B/R' AS rooms", "80.0D AS procedure_area",
        "1000.5D AS actual_worth", "'M' AS nearest_metro", "'L' AS nearest_landmark", "'' AS nearest_mall", "'C' AS master_project")


def test_a_larger_table_lands_in_more_files(spark, monkeypatch):
    seen = {}

    def stream(session, path, schema, files_per_trigger):
        seen.update(path=path, files=files_per_trigger)
        return session.createDataFrame([], schema)

    lines = spark.range(2_000).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "0.0D AS l_discount", "0.0D AS l_tax", "'N' AS l_returnflag",
        "'F' AS l_linestatus", "TIMESTAMP_NTZ '2000-01-01 00:00:00' AS l_shipdate")
    t = SimpleNamespace(spark=spark, raw=lambda name: lines if name == "lineitem" else spark.createDataFrame([], adapters.RAW[name]))
    monkeypatch.setattr(feed_queries, "FILE_ROWS", 100)
    monkeypatch.setattr(feeds, "stream_parquet", stream)
    feed_queries._stream(t, "registration_seen", "lineitem")
    held = spark.read.parquet(seen["path"]).groupBy(F.input_file_name()).count().collect()
    assert seen["files"] == 4 and sum(r["count"] for r in held) == 2_000
    assert len(held) > 15 and max(r["count"] for r in held) < 300


def test_a_table_of_many_rows_is_not_broadcast_to_a_batch(spark, tmp_path, monkeypatch):
    spark.range(200).selectExpr("id AS p_partkey", "'' AS p_name", "'' AS p_brand", "'' AS p_type", "1 AS p_size", "1.0D AS p_retailprice").write.parquet(str(tmp_path / "part"))
    spark.range(20).selectExpr("id AS s_suppkey", "'' AS s_name", "0 AS s_nationkey", "1.0D AS s_acctbal").write.parquet(str(tmp_path / "supplier"))
    lines = spark.range(20).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "0.0D AS l_discount", "0.0D AS l_tax", "'N' AS l_returnflag",
        "'F' AS l_linestatus", "TIMESTAMP_NTZ '2000-01-01 00:00:00' AS l_shipdate")
    nation = spark.createDataFrame([(0, "A", 0)], adapters.RAW["nation"])
    stored = {n: spark.read.schema(adapters.RAW[n]).parquet(str(tmp_path / n)) for n in ("part", "supplier")}
    t = SimpleNamespace(spark=spark, raw={"lineitem": lines, "nation": nation, **stored}.get)
    monkeypatch.setattr(feeds, "stream_parquet", lambda session, path, schema, files_per_trigger: session.read.schema(schema).parquet(path))
    monkeypatch.setattr(feed_queries, "BROADCAST_ROWS", 100)
    rows = feed_queries._stream(t, "registration_seen", "lineitem").select("first_seen")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    met = [line for line in plan.splitlines() if "Join" in line]
    assert any("SortMergeJoin" in x and "p_partkey" in x for x in met) and any("BroadcastHashJoin" in x and "s_suppkey" in x for x in met)
    assert rows.count() == 20


def test_website_export_is_packed_in_bounded_files(spark, monkeypatch):
    monkeypatch.setattr(feed_queries, "FILE_ROWS", 10)
    rows = feed_queries._website_csv(SimpleNamespace(spark=spark, registration_id=_registrations(spark, 100).coalesce(1)))
    assert rows.count() == 100 and len(rows.inputFiles()) == 10 and all(f.endswith(".csv.gz") for f in rows.inputFiles())


def test_stored_feeds_hold_only_what_is_read(spark):
    held = identity_queries.stored_feeds(SimpleNamespace(registration_id=_registrations(spark, 5)))
    assert not {"expected_key", "nearest_metro", "master_project"} & set(held.columns) and held.filter("tx_key IS NOT NULL").count() == 5
    assert all(f.endswith(".zstd.parquet") for f in held.inputFiles())


def test_stored_feeds_leave_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = held()
    rows = identity_queries.stored_feeds(SimpleNamespace(registration_id=_registrations(spark, 50).repartition(4, "transaction_id")))
    for _ in range(50):  # Spark removes them in the background
        if not held() - before:
            break
        time.sleep(0.2)
    assert not held() - before and rows.count() == 50
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_sections_of_a_pack_read_what_they_share_from_storage(spark, data_dir):
    from cadastra.operators import market
    from cadastra.plans import feed_queries, market_pack
    from cadastra.plans.adapters import Tables

    r = feed_queries._register(Tables(spark, data_dir), "1995-01-01")
    periods = market.edition_periods("yearly", "2000", since=None, ytd_to=None)
    pack = market_pack.market_pack(r.tx, r.rents, r.project, r.developer, r.obs, r.pairs, "yearly", periods, r.limits, r.unit, r.bands)
    shared = [r.tx, r.rents, *[rows for name, rows in pack.items() if name.startswith("pipeline") or name in ("behind", "past_due")]]
    assert len(shared) == 8
    assert not any("Join" in rows._jdf.queryExecution().optimizedPlan().toString() for rows in shared)
