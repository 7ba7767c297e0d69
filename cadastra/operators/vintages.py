"""The register as it stood on a date: vintage comparison, what moved, profiles, as-seen curves."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.numbers import between_days, count_where, day, half_up, month_label, pct_change, settle, share, total  # noqa: F401
from cadastra.functions.predicates import is_new_rent, is_off_plan, is_sale, present_at
from cadastra.operators.market import bucket_table, bucketize
from cadastra.operators.quantiles import Pick, beside, order_statistics, with_order_statistics


def vintage_by_month(tx: DataFrame, frm: str, to: str, since: str, unit: float = 1e9) -> DataFrame:
    """Sales by month as the store stood on two dates, all and off-plan (``tx`` carries its vintage columns)."""
    then = present_at(F.col("first_seen"), F.col("withdrawn_on"), day(frm))
    now = present_at(F.col("first_seen"), F.col("withdrawn_on"), day(to))
    worth, off = F.coalesce("actual_worth", F.lit(0.0)), is_off_plan()
    rows = tx.filter(is_sale() & between_days("instance_date", since, to)).groupBy(month_label("instance_date").alias("month")).agg(
        count_where(then).alias("n_then"), count_where(now).alias("n_now"), half_up(F.coalesce(total(F.when(now, worth)), F.lit(0.0)) / unit, 2).alias("value_now"),
        count_where(then & off).alias("off_then"), count_where(now & off).alias("off_now"),
        half_up(F.coalesce(total(F.when(now & off, worth)), F.lit(0.0)) / unit, 2).alias("off_value_now"))
    return rows.withColumns({"change": F.col("n_now") - F.col("n_then"), "off_change": F.col("off_now") - F.col("off_then")})


def gained(tx: DataFrame, frm: str, to: str) -> DataFrame:
    """Sales first seen inside (frm, to] and not withdrawn; a row without a vintage is never a gain."""
    return tx.filter(is_sale() & (F.col("first_seen") > day(frm)) & (F.col("first_seen") <= day(to)) & F.col("withdrawn_on").isNull())


def dated(tx: DataFrame, frm: str, to: str) -> DataFrame:
    """Sales dated inside (frm, to] that the register still holds."""
    held = F.col("withdrawn_on").isNull() | (F.col("withdrawn_on") > day(to))
    return tx.filter(is_sale() & (F.col("instance_date") > day(frm)) & (F.col("instance_date") <= day(to)) & held)


def withdrawn(tx: DataFrame, frm: str, to: str) -> DataFrame:
    return tx.filter((F.col("withdrawn_on") > day(frm)) & (F.col("withdrawn_on") <= day(to)))


def moved_summary(tx: DataFrame, frm: str, to: str, unit: float = 1e9) -> DataFrame:
    """Headline of what moved: gained, dated and withdrawn rows, late registrations, median lag."""
    c = F.col
    is_gain = is_sale() & (c("first_seen") > day(frm)) & (c("first_seen") <= day(to)) & c("withdrawn_on").isNull()
    is_dated = is_sale() & (c("instance_date") > day(frm)) & (c("instance_date") <= day(to)) & (c("withdrawn_on").isNull() | (c("withdrawn_on") > day(to)))
    gone = (c("withdrawn_on") > day(frm)) & (c("withdrawn_on") <= day(to))
    rows = tx.withColumn("window", F.lit(f"{frm}..{to}"))
    base = rows.groupBy("window").agg(
        count_where(is_gain).alias("gained"), half_up(total(F.when(is_gain, c("actual_worth"))) / unit, 2).alias("gained_value"),
        count_where(is_dated).alias("dated"), half_up(total(F.when(is_dated, c("actual_worth"))) / unit, 2).alias("dated_value"),
        count_where(gone).alias("withdrawn"), count_where(is_gain & (c("instance_date") <= day(frm))).alias("late_registrations"))
    lag = F.when(is_gain & (c("instance_date") > day(frm)), F.datediff("first_seen", "instance_date"))
    return beside(base, order_statistics(rows, ["window"], {"lag": lag}, {"median_lag_days": Pick("lag")}), ["window"]).withColumn(
        "median_lag_days", settle("median_lag_days"))


# Buckets of price per sqm in a sales profile.
PSM_BUCKETS = (
    ("0–10k", 0, 10_000), ("10–15k", 10_000, 15_000), ("15–20k", 15_000, 20_000), ("20–25k", 20_000, 25_000),
    ("25–30k", 25_000, 30_000), ("30–40k", 30_000, 40_000), ("40k+", 40_000, 1e9),
)


def _psm() -> Column:
    return F.when((F.col("meter_sale_price") > 0) & (F.col("meter_sale_price") < 200_000), F.col("meter_sale_price"))


def sales_profile(rows: DataFrame, unit: float = 1e9) -> DataFrame:
    """Totals of a set of sales with the price percentiles, as one row."""
    rows = rows.withColumn("scope", F.lit("all"))
    base = rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), half_up(total("actual_worth") / unit, 2).alias("value"), count_where(is_off_plan()).alias("offplan"), F.count(_psm()).alias("with_area"))
    picks = {"median_price": Pick("price"), "median_psm": Pick("psm"), **{f"p{int(p * 100)}": Pick("psm", "nearest", p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)}}
    measures = {"price": F.when(F.col("actual_worth") > 0, F.col("actual_worth")), "psm": _psm()}
    out = beside(base, order_statistics(rows, ["scope"], measures, picks), ["scope"])
    return out.select("scope", "n", "value", "offplan", share("offplan", "n").alias("offplan_pct"), "with_area", *[settle(p).alias(p) for p in picks])


def psm_histogram(rows: DataFrame, buckets=PSM_BUCKETS) -> DataFrame:
    """Sales by bucket of price per sqm, empty buckets included."""
    counts = rows.filter(_psm().isNotNull()).groupBy(bucketize(_psm(), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return bucket_table(rows, buckets).join(counts, "bucket", "left").select("pos", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def profile(rows: DataFrame, keys: Mapping[str, Column], top: Mapping[str, int], unit: float = 1e9) -> DataFrame:
    """Top groups of a set of sales along several keys at once: count, share, value, median price, off-plan share.

    ``keys`` maps a label to the grouping expression; blank values are left out, as in the report.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), e.alias("key")) for k, e in keys.items()]))
    long = rows.select("actual_worth", "meter_sale_price", "reg_type", entries.alias("e")).select("actual_worth", "meter_sale_price", "reg_type", "e.*").filter(
        F.coalesce("key", F.lit("")) != "")
    group = ["dimension", "key"]
    base = long.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), total("actual_worth").alias("_w"), count_where(is_off_plan()).alias("_off"))
    out = with_order_statistics(base, long, group, {"psm": _psm()}, {"_m": Pick("psm")})
    limit = F.create_map(*[F.lit(x) for pair in top.items() for x in pair])
    whole = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "key")))
    return ranked.filter(F.col("rank") <= F.element_at(limit, F.col("dimension"))).select(
        "dimension", "key", "rank", "n", share("n", whole, 1).alias("share"), half_up(F.col("_w") / unit, 2).alias("value"),
        settle("_m").alias("median_psm"), share("_off", "n").alias("offplan_pct"))


def rent_profile(rows: DataFrame, keys: Mapping[str, Column], top: Mapping[str, int]) -> DataFrame:
    """Top groups of a set of tenancies along several keys, with median rents and the new share."""
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), e.alias("key")) for k, e in keys.items()]))
    long = rows.select("annual_amount", "actual_area", "contract_reg_type", entries.alias("e")).select(
        "annual_amount", "actual_area", "contract_reg_type", "e.*").filter(F.coalesce("key", F.lit("")) != "")
    group, amount = ["dimension", "key"], F.col("annual_amount")
    base = long.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), count_where(is_new_rent()).alias("_new"))
    per_sqm = amount / F.nullif(F.col("actual_area"), F.lit(0.0))
    measures = {
        "rent": F.when((amount > 1_000) & (amount < 5e7), amount),
        "psm": F.when((F.col("actual_area") > 10) & (amount > 1_000) & (per_sqm < 20_000), per_sqm),
    }
    out = with_order_statistics(base, long, group, measures, {"_r": Pick("rent"), "_p": Pick("psm")})
    limit = F.create_map(*[F.lit(x) for pair in top.items() for x in pair])
    whole = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "key")))
    return ranked.filter(F.col("rank") <= F.element_at(limit, F.col("dimension"))).select(
        "dimension", "key", "rank", "n", share("n", whole, 1).alias("share"), settle("_r").alias("median_rent"), settle("_p").alias("median_psm"), share("_new", "n").alias("new_pct"))


def vintage_census(vintage: DataFrame) -> DataFrame:
    """Vintage rows by kind with the first and last day seen."""
    return vintage.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("first_seen").alias("first"), F.max("first_seen").alias("last"))


def as_seen_curve(tx: DataFrame, month: str, seen: str = "feed_date") -> DataFrame:
    """Off-plan registrations of a month by the day first seen: added, running count, and whether it had closed."""
    start = day(f"{month}-01")
    rows = tx.filter(is_off_plan() & F.col("instance_date").between(start, F.last_day(start))).groupBy(F.col(seen).alias("seen")).agg(
        F.count(F.lit(1)).alias("added"))
    # One row per day seen.
    running = Window.orderBy(F.col("seen").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("seen", "added", F.sum("added").over(running).alias("running"), F.coalesce(F.col("seen") > F.last_day(start), F.lit(True)).alias("after_close"))


def as_seen_totals(curve: DataFrame) -> DataFrame:
    """Count now, count at the month's close and the tail that arrived after it."""
    return curve.agg(
        F.sum("added").alias("total"), F.coalesce(F.sum(F.when(~F.col("after_close"), F.col("added"))), F.lit(0)).alias("at_close")
    ).withColumn("tail", F.col("total") - F.col("at_close"))


def dedupe_bound(tx: DataFrame, month: str) -> DataFrame:
    """How many of a month's off-plan rows an eight-part content key would collapse."""
    start = day(f"{month}-01")
    two = lambda c: F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0)))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.concat_ws("|", "procedure_name", F.col("instance_date").cast("string"), blank("area_name"), blank("building_name"), blank("project_number"),
                      blank("rooms"), two("procedure_area"), two("actual_worth"))
    groups = tx.filter(is_off_plan() & F.col("instance_date").between(start, F.last_day(start))).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return groups.filter(F.col("n") > 1).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collapsed"), F.coalesce(F.sum("n"), F.lit(0)).alias("in_groups"))


def edition_facts(months: DataFrame, areas: DataFrame, rooms: DataFrame, register_moves: DataFrame, readings: DataFrame, frm: str, to: str, stamp_source: str = "api") -> DataFrame:
    """Facts an edition opens with, from its own (small) tables."""
    c = F.col
    base = months.agg(
        F.coalesce(F.sum(F.when(c("change") < 0, c("change"))), F.lit(0)).alias("restated"), count_where(c("change") > 0).alias("months_gained"))
    five = areas.filter(c("rank") <= 5).agg(half_up(F.sum("share"), 1)).scalar()
    small = rooms.filter(c("key").rlike("(?i)studio|^1 B")).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    window = readings.filter((c("observed_at") > day(frm)) & (c("observed_at") <= day(to))).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    shifts = order_statistics(register_moves.withColumn("scope", F.lit(1)), ["scope"], {"m": c("completion_shift")}, {"v": Pick("m", "upper")})
    stamp = readings.filter(c("source") == stamp_source).agg(F.datediff(day(to), F.max("observed_at"))).scalar()
    return base.select("*", five.alias("top_five_share"), small.alias("small_units"), window.alias("readings_in_window"),
                       shifts.select("v").scalar().alias("completion_shift_upper_middle"), stamp.alias("stamp_age_days"))


def status_transitions(register_moves: DataFrame) -> DataFrame:
    return register_moves.filter(F.col("status_change").isNotNull()).groupBy("status_change").agg(F.count(F.lit(1)).alias("n"))
