"""Comparable-sales valuation: size curve, carried comparables, backtest, calibrated cells."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.numbers import day, days_before, half_up, month_start, quarter_label, share
from cadastra.functions.predicates import DEFAULT_LIMITS, Limits, is_off_plan, is_sale, is_unit, psm_ok
from cadastra.operators.quantiles import Pick, order_statistics

CELL = ["building_name", "rooms"]


@dataclass(frozen=True)
class ValuationRules:
    min_comps: int = 5
    universe_days: int = 800
    size_lo: float = 0.75
    size_hi: float = 1.33
    holdout: float = 0.97
    min_area: float = 10.0
    min_worth: float = 50_000.0
    min_cell: int = 30
    min_area_month: int = 8
    default_elasticity: float = -0.33


# Buckets of comparable counts, and the band used where a bucket has no errors.
BUCKETS = (("5-9", 5, 9), ("10-29", 10, 29), ("30+", 30, None))
DEFAULT_BAND = (0.8, 1.2)


def valuation_universe(
    tx: DataFrame, as_of: str, rules: ValuationRules = ValuationRules(), limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Apartment sales that can price another: sane price, size, rooms and building all stated."""
    return tx.filter(
        is_sale() & is_unit() & psm_ok(limits) & (F.col("procedure_area") > rules.min_area)
        & (F.col("actual_worth") > rules.min_worth) & (F.col("instance_date") >= days_before(as_of, rules.universe_days))
        & (F.col("instance_date") <= day(as_of)) & (F.col("rooms") != "") & (F.col("building_name") != "")
    ).select(
        "instance_date", "area_name", "building_name", "rooms", F.col("procedure_area").alias("size"),
        F.col("actual_worth").alias("worth"), F.col("meter_sale_price").alias("psm"), is_off_plan().alias("off_plan"),
    )


def size_elasticity(sales: DataFrame, rules: ValuationRules = ValuationRules()) -> DataFrame:
    """One row: the median slope of log price on log size over building-rooms cells."""
    fitted = (
        sales.groupBy(*CELL)
        .agg(
            F.count(F.lit(1)).alias("n"), F.var_pop(F.log("size")).alias("_spread"),
            F.regr_slope(F.log("psm"), F.log("size")).alias("slope"),
        )
        .filter((F.col("n") >= rules.min_cell) & (F.col("_spread") > 0))
        .withColumn("scope", F.lit("all"))
    )
    middle = order_statistics(fitted, ["scope"], {"slope": F.col("slope")}, {"elasticity": Pick("slope")})
    return middle.agg(
        F.coalesce(F.max("elasticity"), F.lit(rules.default_elasticity)).alias("elasticity"),
    )


def holdout_cut(sales: DataFrame, share_kept: float = 0.97) -> DataFrame:
    """One row: the date of the sale at rank floor(share * n), found from counts per date.

    The running total is over distinct dates, never over sales.
    """
    by_day = sales.groupBy("instance_date").agg(F.count(F.lit(1)).alias("n"))
    running = by_day.selectExpr(
        "instance_date", "sum(n) OVER (ORDER BY instance_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached",
        "sum(n) OVER () AS total",
    )
    return running.filter(F.col("reached") > F.floor(F.col("total") * F.lit(share_kept))).agg(
        F.min("instance_date").alias("cut"), F.max("instance_date").alias("last_day")
    )


def area_month_index(sales: DataFrame, rules: ValuationRules = ValuationRules()) -> DataFrame:
    """Median price per sqm by area and month, where enough sold."""
    rows = sales.withColumn("month", month_start("instance_date"))
    counts = rows.groupBy("area_name", "month").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rules.min_area_month)
    levels = order_statistics(rows, ["area_name", "month"], {"psm": F.col("psm")}, {"level": Pick("psm")})
    return counts.join(levels, ["area_name", "month"])


def carry_series(index: DataFrame, area_prefix: str = "area_apartments:", market: str = "registered_apartments") -> DataFrame:
    """Index levels to carry comparables on: (area or null for the market, quarter, level); thin quarters left out."""
    area = F.when(F.col("series").startswith(area_prefix), F.expr(f"substring(series, {len(area_prefix) + 1})"))
    return index.filter(((F.col("series") == market) | area.isNotNull()) & ~F.col("thin")).select(
        area.alias("area_name"), "quarter", F.col("index").alias("level")
    )


def level_table(levels: DataFrame, months: DataFrame) -> DataFrame:
    """Area index level and fallback level side by side per (area, month)."""
    first = F.make_date(F.substring("quarter", 1, 4).cast("int"), F.substring("quarter", 6, 1).cast("int") * 3 - 2, F.lit(1))
    by_area = levels.filter(F.col("area_name").isNotNull()).select(
        "area_name", F.explode(F.sequence(first, F.add_months(first, 2), F.expr("interval 1 month"))).alias("month"),
        F.col("level").alias("by_index"),
    )
    return by_area.join(months.select("area_name", "month", F.col("level").alias("by_month")), ["area_name", "month"], "full_outer")


def carry(pairs: DataFrame, levels: DataFrame, months: DataFrame, elasticity: Column) -> DataFrame:
    """Carry each comparable to the subject's date and size: index first, then area-month, then as it stands.

    ``pairs`` holds area_name, when, size of the subject and comp_date, comp_size, comp_psm.
    """
    table = level_table(levels, months)
    # One entry per quarter of the market series, so the lookup rides along as a constant.
    market = levels.filter(F.col("area_name").isNull()).agg(
        F.map_from_entries(F.collect_list(F.struct("quarter", "level"))).alias("m")
    ).scalar()

    def side(rows: DataFrame, date: str, name: str) -> DataFrame:
        look = table.select(
            "area_name", F.col("month").alias("_m"), F.col("by_index").alias(f"{name}_area"), F.col("by_month").alias(f"{name}_month")
        )
        return rows.withColumn("_m", month_start(date)).join(look, ["area_name", "_m"], "left").drop("_m")

    rows = side(side(pairs, "when", "to"), "comp_date", "from").select(
        "*", F.try_element_at(market, quarter_label("when")).alias("to_market"),
        F.try_element_at(market, quarter_label("comp_date")).alias("from_market"),
    )
    factor = _factor(lambda end, kind: F.col(f"{end}_{kind}"))
    value = F.col("comp_psm") * factor * F.pow(F.col("size") / F.col("comp_size"), elasticity)
    return rows.withColumn("carried_psm", value)


SUBJECT = ["building_name", "rooms", "area_name", "when", "size"]
SUBJECTS_HELD = 20_000  # of a group that one task values; more are dealt over further tasks
YEAR = range(13)  # the months, counted back from the subject's own, that can hold its year


def _factor(side: Callable[[str, str], Column]) -> Column:
    """Level at the subject's date over level at the comparable's: its area's index, the market's, the area's month, else none.

    ``side(end, kind)`` gives the level at end ``to`` or ``from`` of kind ``area``, ``market`` or ``month``.
    """
    own = side("to", "area").isNotNull() & (side("from", "area") > 0)
    on_market = side("to", "market").isNotNull() & (side("from", "market") > 0)
    moved = lambda kind: side("to", kind) / F.nullif(side("from", kind), F.lit(0.0))
    return (
        F.when(own, moved("area")).when(on_market, moved("market"))
        .when(side("to", "month").isNotNull() & (side("from", "month") > 0), moved("month")).otherwise(F.lit(1.0))
    )


def with_factors(subjects: DataFrame, levels: DataFrame, months: DataFrame) -> DataFrame:
    """Subjects with ``factors``: what carries a comparable of each month back from theirs to their date.

    An area has an entry a month and the market one a quarter, so a subject meets one row of its area's
    levels instead of a row for every comparable.
    """
    held = level_table(levels, months).filter(F.col("area_name").isNotNull()).groupBy("area_name").agg(
        F.map_from_entries(F.collect_list(F.struct("month", F.struct(F.col("by_index").alias("area"), F.col("by_month").alias("month"))))).alias("_held"))
    market = levels.filter(F.col("area_name").isNull()).agg(F.map_from_entries(F.collect_list(F.struct("quarter", "level")))).scalar()
    rows = subjects.join(held, "area_name", "left").withColumn("_market", market)
    at = lambda k: F.add_months(F.trunc("when", "MM"), -k)

    def side(k: int) -> Callable[[str, str], Column]:
        def level(end: str, kind: str) -> Column:
            month = at(0 if end == "to" else k)
            return F.try_element_at("_market", quarter_label(month)) if kind == "market" else F.try_element_at("_held", month)[kind]

        return level

    return rows.withColumn("factors", F.array(*[_factor(side(k)) for k in YEAR])).drop("_held", "_market")


def _value_group(subjects: pd.DataFrame, comps: pd.DataFrame) -> pd.DataFrame:
    """Median carried price and number of comparables of each subject of a group; comparables stand once, in order of size."""
    comps = comps.sort_values("comp_size", kind="stable")
    size, psm, on, month, alike = (comps[c].to_numpy() for c in ("comp_size", "comp_psm", "on", "month", "alike"))
    out, kept = [], []
    wanted = zip(subjects["size"], subjects["since"], subjects["until"], subjects["own_month"], subjects["lo"], subjects["hi"], subjects["elasticity"], subjects["factors"])
    for k, (own, since, until, own_month, lo, hi, power, factors) in enumerate(wanted):
        like = slice(np.searchsorted(size, lo, side="left"), np.searchsorted(size, hi, side="right"))
        inside = (on[like] >= since) & (on[like] < until)
        if not inside.any():
            continue
        number = alike[like][inside]
        value = psm[like][inside] * np.asarray(factors, float)[own_month - month[like][inside]] * (own / size[like][inside]) ** power
        if number.max() > 1:
            value = np.repeat(value, number)
        n = len(value)
        middle = np.partition(value, [(n - 1) // 2, n // 2])
        kept.append(k)
        out.append((middle[(n - 1) // 2] / 2 + middle[n // 2] / 2, n))
    rows = subjects.iloc[kept][SUBJECT].reset_index(drop=True)
    return rows.assign(psm_value=np.array([v for v, _ in out], float), comps=np.array([n for _, n in out], np.int64))


def value_subjects(
    subjects: DataFrame, pool: DataFrame, elasticity: Column, rules: ValuationRules = ValuationRules(), bare: DataFrame | None = None
) -> DataFrame:
    """Median carried price (``psm_value``) and number of comparables (``comps``) of subjects with factors.

    A comparable is of the same building and rooms, sold in the year before, of like size. Sizes fall in bands as wide as
    the sizes a subject looks at, so a subject finds all of its comparables in two neighbouring bands: every sale goes to two
    groups, every subject to one, and no pair of them is ever a row. Sales alike in date, size and price stand once. A
    group is one tower's sales of like size in the window of the model; its subjects are dealt over as many tasks as
    they need. ``bare``, the subjects before their factors, is what they are counted from, if given.
    """
    ratio = math.log(rules.size_hi / rules.size_lo) * (1 + 1e-6)
    band = lambda size: F.floor(F.log(size) / F.lit(ratio)).cast("int")
    group = [*CELL, "_band"]
    lo, hi = F.lit(rules.size_lo) * F.col("size"), F.lit(rules.size_hi) * F.col("size")
    in_months = lambda date: F.year(date) * 12 + F.month(date)
    asked = subjects.withColumn("_band", band(lo))
    tasks = (subjects if bare is None else bare).withColumn("_band", band(lo)).groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / SUBJECTS_HELD).cast("int").alias("_tasks"))
    asked = asked.join(tasks, group).withColumn("_task", F.pmod(F.xxhash64("when", "size", "area_name"), F.col("_tasks")).cast("int"))
    asked = asked.select(
        *group, "_task", "area_name", "when", "size", "factors", F.unix_date(F.add_months("when", -12)).alias("since"), F.unix_date("when").alias("until"), in_months("when").alias("own_month"),
        lo.alias("lo"), hi.alias("hi"), elasticity.alias("elasticity"))
    comps = pool.groupBy(*CELL, F.col("instance_date").alias("comp_date"), F.col("size").alias("comp_size"), F.col("psm").alias("comp_psm")).agg(F.count(F.lit(1)).alias("alike"))
    dealt = comps.withColumn("_band", F.explode(F.array(band("comp_size"), band("comp_size") - 1))).join(tasks, group)
    dealt = dealt.withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1))).select(
        *[F.col(c).alias(f"c_{c}") for c in (*group, "_task")], F.unix_date("comp_date").alias("on"), in_months("comp_date").alias("month"), "comp_size", "comp_psm", "alike")
    schema = "building_name string, rooms string, area_name string, when date, size double, psm_value double, comps long"
    return asked.groupBy(*group, "_task").cogroup(dealt.groupBy(*[f"c_{c}" for c in (*group, "_task")])).applyInPandas(_value_group, schema)


def _bucket(n: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, lo, hi in BUCKETS:
        out = F.when((n >= lo) & (F.lit(True) if hi is None else n <= hi), F.lit(label)).otherwise(out)
    return out


def split(sales: DataFrame, rules: ValuationRules = ValuationRules()) -> tuple[DataFrame, DataFrame]:
    """Train and held-out sales around the cut date."""
    cut = holdout_cut(sales, rules.holdout).select("cut").scalar()
    return sales.filter(F.col("instance_date") < cut), sales.filter(F.col("instance_date") >= cut)


def backtest_errors(sales: DataFrame, levels: DataFrame, rules: ValuationRules = ValuationRules()) -> DataFrame:
    """Value every held-out sale that has comparables and keep its signed error.

    Held-out sales alike in cell, area, date and size share one valuation, so each distinct
    subject is valued once and joined back.
    """
    train, test = split(sales, rules)
    elasticity = size_elasticity(sales, rules).scalar()
    months = area_month_index(sales, rules)
    held = test.withColumnRenamed("instance_date", "when")
    subjects = held.select(*SUBJECT).distinct()
    middles = value_subjects(with_factors(subjects, levels, months), train, elasticity, rules, subjects)
    valued = middles.filter((F.col("comps") >= rules.min_comps) & (F.col("psm_value") > 0))
    value = F.col("psm_value") * F.col("size")
    return held.join(valued, SUBJECT).select(
        *SUBJECT, "worth", "comps", _bucket(F.col("comps")).alias("bucket"), value.alias("value"),
        ((value - F.col("worth")) / F.col("worth")).alias("error"),
    )


def calibrate(errors: DataFrame) -> DataFrame:
    """Band multipliers and accuracy by comparable bucket, and over all of them."""
    rows = errors.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.lit("all"))))
    size = F.abs("error")
    measures = {
        "e": F.col("error"), "abs": size, "w10": F.when(size <= 0.1, F.lit(1.0)), "w20": F.when(size <= 0.2, F.lit(1.0)),
    }
    picks = {
        "n": Pick("e", "count"), "_q90": Pick("e", "floor", 0.9), "_q10": Pick("e", "floor", 0.1), "_abs": Pick("abs"),
        "_w10": Pick("w10", "count"), "_w20": Pick("w20", "count"),
    }
    return order_statistics(rows, ["bucket"], measures, picks).select(
        "bucket", "n", (1 / (1 + F.col("_q90"))).alias("low_mult"), (1 / (1 + F.col("_q10"))).alias("high_mult"),
        half_up(F.col("_abs") * 100, 3).alias("median_abs_error_pct"), share("_w10", "n", 1).alias("within_10_pct"),
        share("_w20", "n", 1).alias("within_20_pct"),
    )


def valuation_cells(sales: DataFrame, levels: DataFrame, bands: DataFrame, rules: ValuationRules = ValuationRules()) -> DataFrame:
    """One published cell per building and rooms, at its typical size, with its measured band."""
    train, _ = split(sales, rules)
    last_day = holdout_cut(sales, rules.holdout).select("last_day").scalar()
    elasticity = size_elasticity(sales, rules).scalar()
    months = area_month_index(sales, rules)
    recent = train.filter(F.col("instance_date") >= F.add_months(last_day, -12))
    newest = F.struct("instance_date", "worth", "size", "area_name")
    heads = recent.groupBy(*CELL).agg(F.max_by("area_name", newest).alias("area_name"), F.max("instance_date").alias("last_sale"))
    typical = order_statistics(recent, CELL, {"s": F.col("size")}, {"size": Pick("s"), "_n": Pick("s", "count")})
    cells = heads.join(typical.filter(F.col("_n") >= rules.min_comps), CELL).withColumn("when", last_day)
    usable = cells.drop("_n").join(
        recent.select(
            *CELL, F.col("instance_date").alias("comp_date"), F.col("size").alias("comp_size"), F.col("psm").alias("comp_psm"),
            F.col("off_plan").alias("comp_off_plan"),
        ), CELL,
    ).filter(F.col("comp_size").between(F.lit(rules.size_lo) * F.col("size"), F.lit(rules.size_hi) * F.col("size")))
    carried = carry(usable, levels, months, elasticity)
    measures = {"v": F.col("carried_psm"), "off": F.when(F.col("comp_off_plan"), F.lit(1.0))}
    picks = {"psm": Pick("v"), "comps": Pick("v", "count"), "_off": Pick("off", "count")}
    head = ["area_name", "last_sale", "size"]
    rows = order_statistics(carried, [*CELL, *head], measures, picks).filter(
        (F.col("comps") >= rules.min_comps) & (F.col("psm") > 0)
    )
    measured = bands.select("bucket", "low_mult", "high_mult")
    return rows.withColumn("bucket", _bucket(F.col("comps"))).join(measured, "bucket", "left").select(
        *CELL, "area_name", "comps", half_up("size", 1).alias("typical_size"), half_up(half_up("psm", 4)).alias("psm"), "last_sale",
        share("_off", "comps").alias("offplan_share"),
        half_up(F.coalesce("low_mult", F.lit(DEFAULT_BAND[0])), 3).alias("band_low"),
        half_up(F.coalesce("high_mult", F.lit(DEFAULT_BAND[1])), 3).alias("band_high"),
        F.when(F.col("comps") >= 30, F.lit("high")).when(F.col("comps") >= 10, F.lit("medium")).otherwise(F.lit("low")).alias("confidence"),
    )


def value_units(units: DataFrame, cells: DataFrame, elasticity: Column, rules: ValuationRules = ValuationRules()) -> DataFrame:
    """Value units by their cell: moved onto their size, with the band, flagged beyond the fitted sizes."""
    joined = units.join(cells.select(*CELL, "comps", "typical_size", "psm", "band_low", "band_high", "confidence"), CELL, "left")
    relative = F.col("size") / F.col("typical_size")
    value = F.col("psm") * F.pow(relative, elasticity) * F.col("size")
    return joined.select(
        *units.columns, "comps", "confidence", half_up(value).alias("value"), half_up(value * F.col("band_low")).alias("low"),
        half_up(value * F.col("band_high")).alias("high"),
        ((relative > rules.size_hi) | (relative < 1 / rules.size_hi)).alias("extrapolated"),
    )
