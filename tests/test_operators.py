"""Operators whose semantics SQL cannot say, or that hold on shapes the data lacks, against brute force."""

import datetime as dt
import random
from statistics import median

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadastra.functions import numbers
from cadastra.operators import forecast, grouping, identity, issuers, listings, market, panels, readings, resale, valuation
from cadastra.operators.quantiles import Pick, median_by, order_statistics

D = dt.date


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_order_statistics_match_sorting(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice([None, -5.0, 0.0, 7.25, rng.uniform(-1e6, 1e6), rng.uniform(0, 1)]), rng.randint(1, 4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    picks = {"med": Pick("v"), "up": Pick("v", "upper"), "f9": Pick("v", "floor", 0.9), "n1": Pick("v", "nearest", 0.1), "n": Pick("v", "count")}
    for weight in (None, "w"):
        got = {r["k"]: r for r in order_statistics(df, ["k"], {"v": F.col("v")}, picks, weight=weight, resolution=3).collect()}
        for k in "ab":
            vs = sorted(v for kk, v, w in rows if kk == k and v is not None for _ in range(w if weight else 1))
            n = len(vs)
            assert got[k]["n"] == n
            assert got[k]["med"] == pytest.approx(median(vs), rel=1e-12)
            assert got[k]["up"] == vs[n // 2]
            assert got[k]["f9"] == vs[min(n - 1, int(np.floor(0.9 * n)))]
            assert got[k]["n1"] == vs[int(np.floor((n - 1) * 0.1 + 0.5))]


def test_median_of_one_hot_group(spark):
    """A third of all rows share one key and one value; the answer is still exact."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("k"),
                                    F.when(F.col("id") % 3 == 0, F.lit(42.0)).otherwise(F.col("id").cast("double")).alias("v"))
    got = {r["k"]: (r["median"], r["n"]) for r in median_by(df, ["k"], "v").collect()}
    want = {k: (median(g["v"]), len(g)) for k, g in df.toPandas().groupby("k")}
    assert got == want


def test_groups_of_size_drops_a_heavy_group(spark):
    rows = [("heavy", i) for i in range(3_000)] + [("pair", 1), ("pair", 2), ("lone", 1)]
    got = grouping.groups_of_size(spark.createDataFrame(rows, "k string, v int"), ["k"], 2, 12)
    assert sorted((r["k"], r["v"], r["group_size"]) for r in got.collect()) == [("pair", 1, 2), ("pair", 2, 2)]


def test_number_rows_is_dense_for_a_hot_key(spark):
    df = spark.range(1_000).select(F.when(F.col("id") < 900, F.lit("x")).alias("k"), "id")
    got = grouping.number_rows(df, ["k"], ["id"], "n", part_rows=20).toPandas()
    assert sorted(got[got.k == "x"].n) == list(range(1, 901))
    assert sorted(got[got.k.isna()].n) == list(range(1, 101))


@pytest.fixture
def no_auto_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_number_rows_shuffles_no_row_to_meet_a_large_group(spark, no_auto_broadcast, capsys):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    grouping.number_rows(df, ["k"], ["id"], "n", part_rows=5).explain()
    assert capsys.readouterr().out.count("SortMergeJoin") <= 1  # of the parts and their blocks


def test_map_area_joins_only_rows_with_a_project(spark, no_auto_broadcast, capsys):
    rows = spark.createDataFrame([(None, "a"), (None, "Nowhere"), ("1", "Nowhere"), ("9", " b ")], "project_number string, area_text string")
    project = spark.createDataFrame([("1", "P", "m")], "project_number string, area_name string, master_project string")
    out = identity.map_area(rows, project, spark.createDataFrame([("A",), ("B",)], "area_name string"))
    got = {(r["project_number"], r["area_text"]): (r["mapped_area"], r["mapped"]) for r in out.collect()}
    assert got == {(None, "a"): ("A", True), (None, "Nowhere"): ("Nowhere", False), ("1", "Nowhere"): ("P", True), ("9", " b "): ("B", True)}
    out.explain()
    assert "Union" in capsys.readouterr().out


TX = "transaction_id string, trans_group string, instance_date date, feed_date date, procedure_name string, reg_type string, property_type string, property_sub_type string, property_usage string, area_name string, building_name string, project_number string, project_name string, rooms string, procedure_area double, actual_worth double, meter_sale_price double, first_seen date, withdrawn_on date"


def _tx(tid, date, worth, **kw):
    base = dict(transaction_id=tid, trans_group="Sales", instance_date=date, feed_date=None, procedure_name="Sell", reg_type="Existing Properties", property_type="Unit", property_sub_type=None,
                property_usage="Residential", area_name="A", building_name=None, project_number=None, project_name=None, rooms=None, procedure_area=100.0, actual_worth=worth, meter_sale_price=None,
                first_seen=D(2026, 9, 1), withdrawn_on=None)
    base.update(kw)
    return tuple(base.values())


def test_merge_duplicates(spark):
    rows = [
        _tx("1-11-2026-7", D(2026, 8, 28), 1_000_000.0, building_name="Tower", first_seen=D(2026, 8, 30), withdrawn_on=D(2026, 9, 9)),
        _tx("w#11-7-2026#1", D(2026, 8, 27), 1_000_000.75, rooms="2 B/R", procedure_area=None),
        _tx("1-11-2026-8", D(2026, 8, 1), 5.0, meter_sale_price=3.0),
        _tx("odd", D(2026, 8, 1), 1.0), _tx("odd", D(2026, 8, 1), 1.0),
    ]
    out = identity.merge_duplicates(identity.with_keys(spark.createDataFrame(rows, TX))).toPandas()
    assert len(out) == 4 and (out.transaction_id == "odd").sum() == 2
    m = out[out.transaction_id == "1-11-2026-7"].iloc[0]
    assert (m.copies, m.instance_date, m.feed_date) == (2, D(2026, 8, 27), D(2026, 8, 28))
    assert (m.actual_worth, m.procedure_area, m.meter_sale_price) == (1_000_000.75, 100.0, 10_000.0)
    assert (m.building_name, m.rooms, m.first_seen) == ("Tower", "2 B/R", D(2026, 8, 30)) and pd.isna(m.withdrawn_on)
    assert out[out.transaction_id == "1-11-2026-8"].iloc[0].meter_sale_price == 3.0


def test_lone_rows_are_sifted_out_unmoved(spark, monkeypatch):
    rows = [_tx(f"1-11-2026-{k}", D(2026, 8, 1), 5.0 + k, rooms=" ") for k in range(300)] + [_tx(f"w#11-{k}-2026#1", D(2026, 7, 1), 6.5, rooms="2 B/R") for k in range(0, 300, 60)]
    keyed = identity.with_keys(spark.createDataFrame(rows, TX)).withColumn("_h", F.xxhash64("tx_key"))
    often = keyed.groupBy("_h").count().filter("count > 1").select("_h")
    may, still = identity._sift(keyed, often)
    assert may.count() == 10 and still.count() == 295
    assert "Exchange hashpartitioning(_h" not in still._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    merged = sorted(map(str, identity.merge_duplicates(keyed.drop("_h")).collect()))
    assert len(merged) == 300 and sum("copies=2" in m for m in merged) == 5
    monkeypatch.setattr(identity, "SIEVE_BITS", 64)  # a full bitmap lets more rows through, and changes no result
    assert identity._sift(keyed, often)[0].count() > 10
    assert sorted(map(str, identity.merge_duplicates(keyed.drop("_h")).collect())) == merged
    none = identity._sift(keyed, often.limit(0))
    assert (none[0].count(), none[1].count()) == (0, 305)


def test_append_and_upsert(spark):
    store = spark.createDataFrame([("a", 1, "x")], "k string, v int, w string")
    batch = spark.createDataFrame([("a", 9, None), ("b", 2, "y"), ("b", 3, "z"), (None, 4, "q"), (None, 4, "q")], store.schema)
    assert sorted(r["v"] for r in identity.append_new(store, batch, ["k"], ["v"]).collect()) == [2, 4, 4]
    one = batch.filter("k = 'a' or v = 2")
    got = {r["k"]: (r["v"], r["w"]) for r in identity.upsert(store, one, ["k"], ["v"], ["w"]).collect()}
    assert got == {"a": (9, "x"), "b": (2, "y")}
    whole = sorted(identity.upsert(store, batch, ["k"], ["v", "w"], order=["v"]).collect(), key=repr)
    assert [tuple(r) for r in whole] == [("a", 9, None), ("b", 3, "z"), (None, 4, "q"), (None, 4, "q")]


def test_withdrawals_need_a_whole_day(spark):
    held = spark.createDataFrame([(f"t{d}{i}", D(2026, 9, d), f"k{d}{i}") for d in (1, 2, 9) for i in range(10)], "transaction_id string, feed_date date, tx_key string")
    back = held.filter("(day(feed_date) = 1 and tx_key <> 'k13') or (day(feed_date) = 2 and tx_key < 'k25') or day(feed_date) = 9").select("feed_date", "tx_key")
    marks = back.groupBy("feed_date").agg(F.count(F.lit(1)).alias("returned_rows")).withColumn("ok", F.lit(True))
    got = identity.withdrawal_marks(held, back, marks, "2026-09-10").filter("mark = 'withdrawn'").collect()
    assert [(r["tx_key"], r["withdrawn_on"]) for r in got] == [("k13", D(2026, 9, 10))]
    days = {r["feed_date"].day: r["outcome"] for r in identity.withdrawal_days(held, marks, "2026-09-10").collect()}
    assert days == {1: "checked", 2: "thin", 9: "too recent"}


# ---- listings: the scan shapes that tell validated cuts from noise ----

SHAPES = {
    "stable": [100.0] * 10, "one": [100.0] * 5 + [94.0] * 5, "two": [100.0] * 3 + [94.0] * 3 + [90.0] * 4, "three": [100.0] * 3 + [96.0] * 3 + [92.0] * 3 + [88.0],
    "small": [100.0] * 5 + [99.0] * 5, "relist": [100.0, 100.0, 100.0, None, 92.0, 92.0, 92.0, 92.0, 92.0, 92.0], "gone": [100.0] * 4 + [90.0] * 3 + [None] * 3, "early": [100.0, 90.0] + [90.0] * 8,
    "few": [None] * 8 + [100.0, 90.0],
}


def test_listing_shapes(spark):
    rows = [(name, D(2026, 1, 1) + dt.timedelta(days=7 * i), p * 10_000) for name, prices in SHAPES.items() for i, p in enumerate(prices) if p is not None]
    obs = listings.track_presence(spark.createDataFrame(rows, "listing_id string, observed_at date, asking_price double"))
    flat = spark.createDataFrame([(n, False) for n in SHAPES], "listing_id string, is_off_plan boolean")
    got = {r["listing_id"]: (r["drops"], r["rejected"]) for r in listings.listing_outcomes(obs, flat).collect()}
    none = "no-validated-drop"
    assert got == {"stable": (0, none), "one": (1, None), "two": (2, None), "three": (3, None), "small": (0, none), "relist": (0, none), "gone": (1, "currently-delisted"), "early": (0, none), "few": (0, "too-few-scans")}
    assert obs.filter("listing_id = 'gone' and not seen").count() == 1


def test_a_first_price_of_zero_stops_nothing(spark):
    scans = {"risen": [0.0, 500_000.0, 500_000.0, 500_000.0, 400_000.0], "nothing": [0.0, 0.0, 0.0]}
    rows = [(n, dt.date(2025, 1, 1 + i), p) for n, prices in scans.items() for i, p in enumerate(prices)]
    obs = spark.createDataFrame([(*r, True) for r in rows], "listing_id string, observed_at date, asking_price double, seen boolean")
    flat = spark.createDataFrame([(n, n, "A", "", 100.0, False, dt.date(2025, 1, 1)) for n in scans],
                                 "listing_id string, project_number string, area_name string, rooms string, area_sqm double, is_off_plan boolean, first_seen_at date")
    got = {r["listing_id"]: r for r in listings.listing_outcomes(obs, flat).collect()}
    assert got["risen"]["cumulative_pct"] == float("-inf") and got["risen"]["drops"] == 1 and got["risen"]["rejected"] is None
    assert np.isnan(got["nothing"]["cumulative_pct"]) and got["nothing"]["rejected"] == "no-validated-drop"
    tx = spark.createDataFrame([], "trans_group string, meter_sale_price double, project_number string, rooms string, instance_date date")
    readings_ = spark.createDataFrame([], "project_number string, completion_date date")
    drop = listings.validated_drops(flat, obs, tx, readings_, "2025-02-01").collect()
    assert [(r["listing_id"], r["drops"], r["distress_score"]) for r in drop] == [("risen", 1, None)]


def test_distress_score(spark):
    row = spark.range(1).select(
        listings.distress_score(F.lit(2), F.lit(0.10), F.lit(100), F.lit(50), F.lit(-0.10), F.lit(3.2)),
        listings.distress_score(F.lit(9), F.lit(0.90), F.lit(1), F.lit(50), F.lit(None).cast("double"), F.lit(None).cast("double"))).first()
    assert list(row) == [20 + 15 + 15 + 20 + 3, 55]


# ---- repeat sales ----

def _pairs(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = D(2012, 1, 1) + dt.timedelta(days=rng.randint(0, 1500))
        b = a + dt.timedelta(days=rng.randint(181, 900))
        w = rng.uniform(1e5, 1e6)
        rows.append((a, b, w, w * rng.uniform(0.7, 1.8), (b - a).days, "Sell", "Sell", "Unit" if i % 3 else "Villa", "P" if i % 4 else None, "North" if i % 2 else "South"))
    return rows, spark.createDataFrame(rows, "bought_on date, sold_on date, bought_for double, sold_for double, hold_days int, bought_proc string, sold_proc string, property_type string, project_number string, area_name string")


def test_index_matches_a_plain_fit(spark):
    rows, df = _pairs(spark)
    rules = resale.IndexRules(min_area_pairs=150, min_pairs=100)
    got = resale.repeat_sales_index(df, rules).toPandas()
    q = lambda d: d.year * 4 + (d.month - 1) // 3
    lo, hi = min(q(r[0]) for r in rows), max(q(r[1]) for r in rows)
    n = hi - lo + 1
    for series, keep in {"market": lambda r: True, "villas": lambda r: r[7] == "Villa", "registered_apartments": lambda r: r[7] == "Unit" and r[8], "area:North": lambda r: r[9] == "North"}.items():
        X, y = [], []
        for r in rows:
            i, j = q(r[0]) - lo, q(r[1]) - lo
            if keep(r) and i != j:
                line = np.zeros(n)
                line[j], line[i] = 1, -1
                X.append(line)
                y.append(np.log(r[3] / r[2]))
        A, b = np.array(X).T @ np.array(X), np.array(X).T @ np.array(y)
        A[0], b[0] = 0, 0
        A[0, 0] = 1
        beta = np.linalg.solve(A + 1e-6 * np.eye(n), b)
        mine = got[got.series == series].sort_values("quarter")
        assert np.allclose(mine["index"], np.floor(1000 * np.exp(beta) + 0.5) / 10)
    assert "area_apartments:South" not in set(got.series) and got[got.series == "market"]["index"].iloc[0] == 100.0
    assert resale.repeat_sales_index(df, resale.IndexRules(min_pairs=500)).count() == 0


def test_pairs_need_a_small_group_and_a_hold(spark):
    base = ("Sales", "Sell", "Unit", "Existing Properties", "N", "T", "1", "2 B/R", 80.0)
    sale = lambda day, worth, size=80.0: (*base[:8], size, day, worth)
    rows = [sale(D(2020, 1, 1), 200_000.0), sale(D(2020, 1, 20), 210_000.0), sale(D(2021, 1, 1), 300_000.0), sale(D(2022, 1, 1), 2_000_000.0)]
    rows += [sale(D(2020, 1, 1) + dt.timedelta(days=60 * i), 200_000.0, 55.0) for i in range(13)]
    df = spark.createDataFrame(rows, "trans_group string, procedure_name string, property_type string, reg_type string, area_name string, building_name string, project_number string, rooms string, procedure_area double, instance_date date, actual_worth double")
    got = resale.resale_pairs(df).collect()
    assert [(r["bought_on"], r["sold_on"], r["ambiguity"]) for r in got] == [(D(2020, 1, 20), D(2021, 1, 1), 2)]


# ---- first sales ----

def _walk(rows, tol):
    """The rule, sale by sale."""
    open_, repeats = {}, 0
    for key, _, worth, first in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        if first:
            open_.setdefault(key, []).append([worth, False])
        else:
            for o in open_.get(key, []):
                if not o[1] and abs(o[0] - worth) / o[0] <= tol:
                    o[1] = True
                    repeats += 1
                    break
    return repeats


@pytest.mark.parametrize("tol", [0.005, 0.05, 0.3])
def test_repeats_match_a_plain_walk(spark, tol):
    rng = random.Random(int(tol * 1000))
    rows = [(rng.choice("abc"), D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 900)), float(rng.randint(1_000, 3_000)), rng.random() < 0.5) for _ in range(400)]
    df = spark.createDataFrame(
        [("Sales", "Sell - Pre registration" if f else "Delayed Sell", "Unit", k, "1", "2 B/R", 80.0, d, w, w / 80, "N") for k, d, w, f in rows],
        "trans_group string, procedure_name string, property_type string, building_name string, project_number string, rooms string, procedure_area double, instance_date date, actual_worth double, meter_sale_price double, area_name string")
    entities = spark.createDataFrame([("1", "dev")], "project_number string, entity_id string")
    rules = panels.PanelRules(price_tolerance=tol, psm_min=None)
    marked = panels.mark_repeats(df, entities, rules, "2030-01-01")
    assert marked.filter("is_repeat").count() == _walk(rows, tol)
    panel = panels.first_sales_panel(marked, rules, "2020Q1").toPandas()
    assert panel.first_sale_units.sum() + panel.repeats_dropped.sum() == len(rows)


@pytest.mark.parametrize("tol", [0.0, 0.005, 0.2, 1.0, 3.0])
def test_matching_takes_the_earliest_price_that_meets(tol):
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 40)
        first = [rng.random() < 0.6 for _ in range(n)]
        worth = [float(rng.choice([100, 100, 101, 120, 100.5, rng.randint(80, 150)])) for _ in range(n)]
        open_, want = [], []
        for f, w in zip(first, worth):
            hit = None if f else next((k for k, o in enumerate(open_) if abs(o - w) / o <= tol), None)
            if f:
                open_.append(w)
            elif hit is not None:
                del open_[hit]
            want.append(hit is not None)
        assert panels.match_repeats(first, worth, tol) == want


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf"), 1e22])
def test_no_amount_is_missing_from_a_sum(spark, bad):
    df = spark.createDataFrame([("a", 0.1), ("a", None), ("b", 1e21), ("b", 0.2), ("c", bad)], "k string, v double")
    assert {r.k: r.t for r in df.filter("k <> 'c'").groupBy("k").agg(numbers.total("v").alias("t")).collect()} == {"a": 0.1, "b": 1e21}
    with pytest.raises(Exception, match="not an amount"):
        df.groupBy("k").agg(numbers.total("v").alias("t")).collect()


def test_values_are_medians_of_all_comparables(spark, monkeypatch):
    """Against every pair formed by hand: levels missing on either side, equal sales, sizes at the very edges."""
    rng = random.Random(9)
    start = D(2024, 1, 1)
    sale = lambda: (start + dt.timedelta(days=rng.randint(0, 700)), rng.choice(["N", "S"]), rng.choice("AB"), "1 B/R", rng.choice([60.0, 75.0, 80.0, 100.0, 133.0, rng.uniform(50, 140)]), 1e6, float(rng.choice([9000, 10000, rng.randint(8000, 12000)])), False)
    pool = [sale() for _ in range(400)]
    pool += pool[:60]
    subjects = {(b, r, a, d, s) for d, a, b, r, s, *_ in [sale() for _ in range(150)]}
    quarters = [f"{y}Q{q}" for y in (2023, 2024, 2025) for q in (1, 2, 3, 4)]
    levels = [(a, q, rng.uniform(80, 120)) for a in ("N", None) for q in quarters if rng.random() < 0.6]
    months = [(a, D(y, m, 1), 9, rng.uniform(80, 120)) for a in ("N", "S") for y in (2023, 2024, 2025) for m in range(1, 13) if rng.random() < 0.6]
    monkeypatch.setattr(valuation, "SUBJECTS_HELD", 10)  # several tasks a group
    universe = "instance_date date, area_name string, building_name string, rooms string, size double, worth double, psm double, off_plan boolean"
    asked = spark.createDataFrame(sorted(subjects), "building_name string, rooms string, area_name string, when date, size double")
    asked = valuation.with_factors(asked, spark.createDataFrame(levels, "area_name string, quarter string, level double"), spark.createDataFrame(months, "area_name string, month date, n long, level double"))
    got = {tuple(r)[:5]: (r.psm_value, r.comps) for r in valuation.value_subjects(asked, spark.createDataFrame(pool, universe), F.lit(-0.3)).collect()}
    by_quarter, by_month = {(a, q): v for a, q, v in levels}, {(a, m): v for a, m, _, v in months}
    quarter = lambda d: f"{d.year}Q{(d.month + 2) // 3}"
    for b, r, a, when, size in subjects:
        values = []
        for on, _, b2, r2, s2, _, psm, _ in pool:
            before = when.replace(year=when.year - 1) if (when.month, when.day) != (2, 29) else when.replace(year=when.year - 1, day=28)
            if (b, r) == (b2, r2) and before <= on < when and 0.75 * size <= s2 <= 1.33 * size:
                pairs = [(by_quarter.get((x, quarter(when))), by_quarter.get((x, quarter(on)))) for x in (a, None)] + [(by_month.get((a, when.replace(day=1))), by_month.get((a, on.replace(day=1))))]
                factor = next((to / held for to, held in pairs if to is not None and held is not None), 1.0)
                values.append(psm * factor * (size / s2) ** -0.3)
        if values:
            assert got[b, r, a, when, size][1] == len(values) and got[b, r, a, when, size][0] == pytest.approx(median(values), rel=1e-12)
        else:
            assert (b, r, a, when, size) not in got
    assert len(got) > 100
    strange = asked.withColumn("building_name", F.concat(F.lit("no "), "building_name"))
    assert valuation.value_subjects(strange, spark.createDataFrame(pool, universe), F.lit(-0.3)).collect() == []
    early = asked.withColumn("when", F.lit("2020-01-01").cast("date"))
    assert valuation.value_subjects(early, spark.createDataFrame(pool, universe), F.lit(-0.3)).collect() == []


def test_words_are_found_by_their_rarest_trigram(spark):
    held = [("x", 3, "palm tower", "palm-tower"), ("x", 1, "the palms", "the-palms"), ("x", 2, "tower of palm", "t"), ("y", 9, "palm", "lake-view"), ("x", 4, "ab", "ab")]
    asked = [("x", "palm"), ("x", "palms"), ("x", "tower"), ("y", "view"), ("x", "lake"), ("x", "mpa"), ("y", "ower"), ("z", "palm")]
    got = identity.containing(
        spark.createDataFrame(asked, "area string, word string"), spark.createDataFrame(held, "area string, pn int, name string, slug string"), "area", "word", ["name", "slug"], F.col("pn"))
    want = {(a, w, min(p for b, p, *t in held if b == a and any(w in x for x in t))) for a, w in asked if any(b == a and any(w in x for x in t) for b, _, *t in held)}
    assert {tuple(r) for r in got.collect()} == want and want


def test_entities_must_not_overlap(spark):
    config = spark.createDataFrame([("1", "whole", None, None), ("1", "named", ["p1"], None), ("1", "named", ["q9"], None)], "developer_number string, attribution_scope string, project_numbers array<string>, exclude_project_numbers array<string>")
    project = spark.createDataFrame([("p1", "1"), ("p2", "1"), ("q9", "2")], "project_number string, developer_number string")
    got = {(r["entity_id"], r["project_number"]): r["problem"] for r in panels.entity_projects(config, project).collect()}
    twice, foreign = "claimed by more than one entity", "not this developer's project"
    assert got == {("1", "p1"): twice, ("1", "p2"): None, ("1/p1", "p1"): twice, ("1/q9", "q9"): foreign}


def test_reconcile(spark):
    left = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 2), ("c", 1.0, 2)], "k string, v double, n int")
    right = spark.createDataFrame([("a", 1.0 + 1e-12, 2), ("b", 1.1, 3), ("d", 1.0, 2)], "k string, v double, n int")
    got = {r["k"]: (r["outcome"], r["columns"]) for r in panels.reconcile(left, right, ["k"], {"v": 1e-9}, ["n"]).collect()}
    assert got == {"a": ("match", None), "b": ("mismatch", "v,n"), "c": ("missing", None), "d": ("extra", None)}


# ---- escrow: the engine's own cases ----

BASE = issuers.SCENARIOS[0]


def _project(spark, horizons=(6,), scenarios=(BASE,), **kw):
    row = dict(issuer="i", project_number="1", project_name="x", status="ACTIVE", registered_completion=D(2027, 1, 1), units=100, sold_units=60, avg_ticket=1e6, certified_pct=50.0, is_live=True)
    row.update(kw)
    schema = "issuer string, project_number string, project_name string, status string, registered_completion date, units int, sold_units int, avg_ticket double, certified_pct double, is_live boolean"
    return issuers.escrow_projection(spark.createDataFrame([tuple(row.values())], schema), "2026-09-10", horizons, scenarios).collect()


@pytest.mark.parametrize("p, collected, released", [(0.0, 0.10, 0.0), (50.0, 0.40, 0.20), (100.0, 1.0, 1.0)])
def test_shares(spark, p, collected, released):
    book, hand = F.lit(BASE["book"]), F.lit(BASE["hand"])
    row = spark.range(1).select(issuers.collected_share(F.lit(p), book, hand), issuers.released_share(F.lit(p), book, hand)).first()
    assert list(row) == pytest.approx([collected, released])


def test_escrow_rules(spark):
    s = {**BASE, "cancel": 0.10, "sell": 0.5}
    assert _project(spark, scenarios=(s,))[0]["effective"] == pytest.approx(74)
    assert _project(spark, sold_units=100)[0]["released"] == pytest.approx(100 * 0.20 * 0.95)
    assert _project(spark, registered_completion=D(2026, 1, 1))[0]["months"] == 6
    assert _project(spark, scenarios=({**BASE, "delay": 6},))[0]["months"] == 10
    assert _project(spark, registered_completion=None)[0]["months"] == 24
    for r in _project(spark, horizons=range(0, 60, 6), scenarios=issuers.SCENARIOS):
        assert r["months"] >= 1 and r["pace"] <= 8 and 0 <= r["release"] <= r["effective"] * 0.95 - r["released"] + 1e-9


# ---- readings, peers, forecast ----

def test_latest_reading_ties(spark):
    rows = [(1, "p", D(2026, 1, 1), "ACTIVE", 10.0, None, "api"), (2, "p", D(2026, 2, 1), "ACTIVE", 20.0, None, "gateway"), (3, "p", D(2026, 2, 1), "PENDING", 30.0, None, "api"), (4, "p", D(2026, 9, 1), "FINISHED", 99.0, None, "api")]
    obs = spark.createDataFrame(rows, "id long, project_number string, observed_at date, status string, percent_completed double, completion_date date, source string")
    assert readings.latest_as_of(obs, "2026-06-01").first()["id"] == 2
    assert readings.latest_as_of(obs, "2026-06-01", tie="id").first()["id"] == 3
    two = readings.last_two(obs, "2026-06-01").first()
    assert (two["now"]["id"], two["before"]["id"]) == (2, 3)


def test_forecast_of_a_flat_year_is_flat(spark):
    months = [(D(2020 + i // 12, i % 12 + 1, 1), 100, 5.0) for i in range(36)]
    df = spark.createDataFrame(months, "month date, units int, value double")
    factors = forecast.seasonal_factors(df)
    assert all(abs(r["factor"] - 1) < 1e-9 for r in factors.collect())
    got = forecast.forecast(df, factors, []).filter("measure = 'units'").orderBy("h").collect()
    assert [r["month"] for r in got][:2] == [D(2023, 1, 1), D(2023, 2, 1)] and len(got) == 8
    assert all(r["flat"] == pytest.approx(100) and r["momentum"] == pytest.approx(100) for r in got)


def test_edition_windows():
    assert market.edition_periods("monthly", "2026-03")["prev"] == ("2026-02-01", "2026-02-28")
    assert market.edition_periods("yearly", "2026", ytd_to="2026-09-10")["yoy"] == ("2024-01-01", "2024-09-10")
    weekly = market.edition_periods("weekly", "2026-09-14", since="2026-09-07")
    assert weekly == {"cur": ("2026-09-08", "2026-09-14"), "prev": ("2026-09-01", "2026-09-07"), "yoy": ("2025-09-08", "2025-09-14")}
    assert market.last_full_month("2026-09-30") == "2026-09" and market.last_full_month("2026-09-29") == "2026-08"


def test_totals_are_exact_at_any_size(spark):
    big = spark.createDataFrame([(3_000_000_000_000.12,)] * 40_000 + [(0.01,), (-0.005,), (None,)], "v double")
    want = 3_000_000_000_000.12 * 40_000
    for parts in (1, 7):
        assert big.repartition(parts).agg(numbers.total("v").alias("t")).first().t == round(want, 2)
    small = spark.createDataFrame([(0.005,), (1.005,), (-1.005,)], "v double")
    assert [r.t for r in small.groupBy("v").agg(numbers.total("v").alias("t")).orderBy("v").collect()] == [-1.0, 0.01, 1.01]
    assert spark.sql("select 9.3e13D + 0.25D as v").select(numbers.half_up("v", 2)).first()[0] == 93_000_000_000_000.25
