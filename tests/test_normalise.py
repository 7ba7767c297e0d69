"""Text, number, date and identity normalisation against fixed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadastra.functions import numbers, predicates, text


def apply(spark, values, fn, schema="v string"):
    rows = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in rows.select(fn(F.col("v"))).collect()]


def test_norm_area(spark):
    cases = {"BUSINESS BAY": "Business Bay", "me'aisem first": "Me'Aisem First", "al-barsha south 2nd": "Al-Barsha South 2nd", "": "Unknown", None: "Unknown"}
    assert apply(spark, list(cases), text.norm_area) == list(cases.values())


def test_norm_project_number(spark):
    assert apply(spark, ["1740.00", " 17 ", "A-1", "", None], text.norm_project_number) == ["1740", "17", "A-1", None, None]


def test_norm_rooms(spark):
    cases = {"2 bed rooms+hall": "2 B/R", "3 B/R": "3 B/R", "Studio apt": "Studio", "penthouse": "PENTHOUSE", "NA": None, "0": "Studio", "Office": "Office", "": None}
    assert apply(spark, list(cases), text.norm_rooms) == list(cases.values())


def test_parse_date(spark):
    day = dt.date(2026, 8, 3)
    cases = {"03-08-2026": day, "2026-08-03 10:15": day, "03/08/2026": day, "46237": day, "32-13-2026": None, "": None, None: None}
    assert apply(spark, list(cases), text.parse_date) == list(cases.values())


def test_parse_number(spark):
    assert apply(spark, ["1,234.5", "0", "x", None], text.parse_number) == [1234.5, 0.0, None, None]
    assert apply(spark, ["0", "2"], lambda c: text.parse_number(c, True)) == [None, 2.0]


def test_slugs(spark):
    assert apply(spark, ["Café  Ñandú!", "--A b--"], text.slugify) == ["cafe-nandu", "a-b"]
    assert apply(spark, ["Me'Aisem First", "St. Regis"], text.area_slug) == ["me-aisem-first", "st-regis"]


KEY = "11|2026|26618|Sales"


@pytest.mark.parametrize("stored, group, key", [
    ("1-11-2026-26618", "Sales", KEY), ("11-26618-2026", "Sales", KEY), ("1-11-2026-26618#a2026090323965", "Sales", KEY), ("w#11-26618-2026#1", "Sales", KEY),
    ("1-11-2026-26618", None, KEY), ("2-11-2026-26618", "Mortgages", "11|2026|26618|Mortgages"), ("11-26618-2026", None, None), ("nonsense", "Sales", None),
    ("1-11-26-26618", "Sales", None), (None, "Sales", None), ("9-11-2026-5", " ", None),
])
def test_tx_key(spark, stored, group, key):
    row = spark.createDataFrame([(stored, group)], "id string, g string").select(text.tx_key("id", "g")).first()
    assert row[0] == key


def test_ids_carry_their_run_date(spark):
    assert apply(spark, ["1-11-2026-5#a2026090323965", "1-11-2026-5"], text.first_seen_from_id) == [dt.date(2026, 9, 3), None]


def test_observation_and_reading_dates(spark):
    day = dt.date(2026, 9, 30)
    got = apply(spark, ["2025-10-01T00:00", "2026-01-02 03:04", None], lambda c: text.observation_date(c, {"2025-10-01": "2025-09-15"}, "2026-09-30"))
    assert got == [dt.date(2025, 9, 15), dt.date(2026, 1, 2), day]
    rows = spark.createDataFrame([(dt.date(2026, 1, 1), 5.0), (None, 5.0), (None, None)], "d date, p double")
    assert [r[0] for r in rows.select(text.reading_date("d", "p", "workbook", "2026-09-30")).collect()] == [dt.date(2026, 1, 1), None, day]
    assert [r[0] for r in rows.select(text.reading_date("d", "p", "gateway", "2026-09-30")).collect()] == [dt.date(2026, 1, 1), day, day]


def test_percent_policies(spark):
    run = lambda mode: apply(spark, [50.0, 222.6, -1.0, None], lambda c: text.percent_policy(c, mode), "v double")
    assert run("null_above") == [50.0, None, -1.0, None]
    assert run("cap") == [50.0, 100.0, -1.0, None]
    assert run("hold_out") == [50.0, None, None, None]


def test_permit_classifier(spark):
    cases = {"New Building": True, "Building permit": True, "New building - modification": False, "Demolition": False, None: False}
    assert apply(spark, list(cases), text.is_new_building) == list(cases.values())


def test_capacity(spark):
    rows = spark.createDataFrame([(10, 2, 1), (0, 0, 339), (0, 0, 0), (5, 0, 1), (0, 4, 9)], "units int, villas int, lands int")
    got = [tuple(r) for r in rows.select(text.home_capacity(), text.capacity_basis()).collect()]
    assert got == [(12, "units+villas"), (339, "plots"), (None, ""), (5, "units"), (4, "villas")]


def test_first_contains_and_labels(spark):
    assert apply(spark, ["DAMAC STAR", "MY EMAAR DAMAC", "Other"], lambda c: text.first_contains(c, [("EMAAR", "Emaar"), ("DAMAC", "DAMAC")])) == ["DAMAC", "Emaar", "Other"]
    assert apply(spark, ["FINISHED", "ODD", None], text.status_label) == ["Completed", "ODD", None]


def test_rounding_goes_up_at_half(spark):
    assert apply(spark, [0.5, -0.5, 2.5, -2.5, 1.005], lambda c: numbers.half_up(c), "v double") == [1.0, 0.0, 3.0, -2.0, 1.0]
    rows = spark.createDataFrame([(0.0, 5.0), (5.0, 0.0), (6.0, 5.0), (None, 5.0)], "a double, b double")
    assert [r[0] for r in rows.select(numbers.pct_change("a", "b")).collect()] == [None, None, 20.0, None]


def test_month_arithmetic(spark):
    row = spark.range(1).select(
        F.add_months(numbers.day("2026-01-31"), 1), F.add_months(numbers.day("2026-03-31"), -1),
        numbers.months_apart(numbers.day("2026-09-10"), numbers.day("2027-02-28")), numbers.quarter_label(numbers.day("2026-09-10"))).first()
    assert list(row) == [dt.date(2026, 2, 28), dt.date(2026, 2, 28), 5, "2026Q3"]


def test_home_predicate(spark):
    rows = spark.createDataFrame([("Unit", 50.0), ("Land", 3000.0), ("Land", 3000.5), ("Land", None), ("Building", 10.0)], "property_type string, procedure_area double")
    assert [r[0] for r in rows.select(predicates.is_home()).collect()] == [True, True, False, True, False]


def test_presence_without_vintage_counts(spark):
    d = dt.date
    rows = spark.createDataFrame([(None, None), (d(2026, 1, 1), None), (d(2026, 3, 1), None), (d(2026, 1, 1), d(2026, 2, 1))], "f date, w date")
    got = rows.select(predicates.present_at(F.col("f"), F.col("w"), numbers.day("2026-02-01")))
    assert [r[0] for r in got.collect()] == [True, True, False, False]
