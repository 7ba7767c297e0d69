"""Developer scorecards and profiles over the register, its readings and its sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.numbers import count_where, day, days_before, half_up, mean, month_start, settle, share, total
from cadastra.functions.predicates import (
    BUILDING_STATUSES, DEFAULT_LIMITS, Limits, is_off_plan, is_sale, is_unit, psm_ok, re_registration,
)
from cadastra.functions.text import first_contains, percent_policy
from cadastra.operators.quantiles import Pick, order_statistics
from cadastra.operators.readings import DAYS_PER_MONTH, latest_as_of, reading_order


def _sales_12m(tx: DataFrame, as_of: str) -> DataFrame:
    return tx.filter(is_sale() & (F.col("instance_date") >= days_before(as_of, 365))).groupBy("project_number").agg(
        F.count(F.lit(1)).alias("sales_12m"), total("actual_worth").alias("worth_12m"))


def developer_scorecard(
    developer: DataFrame, project: DataFrame, obs: DataFrame, tx: DataFrame, flags: DataFrame, as_of: str, unit: float = 1e9
) -> DataFrame:
    """Finished, active, overdue, cancelled and flagged projects with a year's sales, per developer.

    Sales are collapsed to projects first; from there on the rows are projects.
    """
    building = F.col("status").isin(*BUILDING_STATUSES)
    rows = (
        project.select("project_number", "developer_number")
        .join(latest_as_of(obs, as_of).select("project_number", "status", "completion_date"), "project_number", "left")
        .join(_sales_12m(tx, as_of), "project_number", "left")
        .join(flags.select("project_number", F.lit(1).alias("_flag")), "project_number", "left")
    )
    grouped = rows.groupBy("developer_number").agg(
        F.count(F.lit(1)).alias("projects"), count_where(F.col("status") == "FINISHED").alias("finished"), count_where(building).alias("active"),
        count_where(building & (F.col("completion_date") < day(as_of))).alias("overdue"), count_where(F.col("status") == "CANCELLED").alias("cancelled"),
        F.coalesce(F.sum("sales_12m"), F.lit(0)).alias("sales_12m"), half_up(total("worth_12m") / unit, 2).alias("value"), F.count("_flag").alias("flagged"),
    )
    return developer.join(grouped, "developer_number")


def corporate_groups(scorecard: DataFrame, keywords: Sequence[tuple[str, str]]) -> DataFrame:
    """Scorecards of the companies a group registers under, rolled up by the first keyword in their name."""
    named = scorecard.withColumn("group_name", first_contains(F.upper("developer_name"), keywords))
    sums = ["projects", "finished", "active", "overdue", "cancelled", "sales_12m", "flagged"]
    return named.groupBy("group_name").agg(
        F.count(F.lit(1)).alias("entities"), *[F.sum(c).alias(c) for c in sums], half_up(F.sum("value"), 2).alias("value"))


def developer_projects(project: DataFrame, obs: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """Each developer's projects: latest reading, overdue flag, a year's sales and the recent price."""
    rows = tx.filter(is_sale() & (F.col("instance_date") >= days_before(as_of, 365)))
    recent = is_unit() & (F.col("meter_sale_price") > 0) & (F.col("instance_date") >= days_before(as_of, 90))
    sales = rows.groupBy("project_number").agg(
        F.count(F.lit(1)).alias("sales_12m"), mean(F.when(recent, F.col("meter_sale_price"))).alias("psm_90"))
    late = F.col("status").isin(*BUILDING_STATUSES) & (F.col("completion_date") < day(as_of))
    return (
        project.select("developer_number", "project_number", "project_name")
        .join(latest_as_of(obs, as_of).select("project_number", "status", "percent_completed", "completion_date"), "project_number", "left")
        .join(sales, "project_number", "left")
        .withColumn("sales_12m", F.coalesce("sales_12m", F.lit(0)))
        .withColumn("overdue", F.coalesce(late, F.lit(False)))
    )


def profile_projects(
    project: DataFrame, obs: DataFrame, tx: DataFrame, as_of: str, limits: Limits = DEFAULT_LIMITS, unit: float = 1e6
) -> DataFrame:
    """Per project: planned against current date, slip, lateness, sales, share sold and recent price."""
    seen = obs.filter(F.col("observed_at") <= day(as_of))
    r = F.max_by(F.struct("status", "percent_completed", "completion_date"), reading_order())
    readings = seen.groupBy("project_number").agg(
        F.min("completion_date").alias("planned"), r.alias("_l"), F.count(F.lit(1)).alias("readings"), F.count_distinct("source").alias("sources"))
    d, worth = F.col("instance_date"), F.col("actual_worth")
    year, quarter = d >= days_before(as_of, 365), d >= days_before(as_of, 90)
    price = F.when(quarter & is_unit() & psm_ok(limits), F.col("meter_sale_price"))
    sales = tx.filter(is_sale() & F.col("project_number").isNotNull()).groupBy("project_number").agg(
        F.count(F.lit(1)).alias("sales_all"), count_where(year).alias("sales_12m"), half_up(total(F.when(year, worth)) / unit).alias("value_12m"),
        count_where(is_off_plan()).alias("offplan_all"), F.min(d).alias("first_sale"), F.max(d).alias("last_sale"),
        mean(price).alias("psm_90"), F.count(price).alias("psm_90_n"),
    )
    rows = (
        project.select("project_number", "project_name", "developer_number", "area_name", "units")
        .join(readings, "project_number", "left").join(sales, "project_number", "left")
        .select("*", F.col("_l.status").alias("status"), F.col("_l.completion_date").alias("current"), F.col("_l.percent_completed").alias("_pct"))
    )
    months = half_up(F.datediff("current", "planned") / F.lit(DAYS_PER_MONTH), 1)
    finished, cancelled = F.coalesce(F.col("status") == "FINISHED", F.lit(False)), F.coalesce(F.col("status") == "CANCELLED", F.lit(False))
    live = F.col("status").isNotNull() & ~finished & ~cancelled
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        "project_number", "project_name", "developer_number", "area_name", "units", "status",
        percent_policy("_pct", "cap").alias("percent"), "planned", "current",
        F.coalesce(F.when(F.col("current") != F.col("planned"), months), F.lit(0.0)).alias("slip_months"),
        F.coalesce(F.when(finished & (F.col("current") > F.col("planned")), months), F.lit(0.0)).alias("late_months"),
        finished.alias("finished"), cancelled.alias("cancelled"), live.alias("live"),
        F.coalesce(live & (F.col("current") < day(as_of)), F.lit(False)).alias("past_due"),
        zero("sales_all"), zero("sales_12m"), F.coalesce("value_12m", F.lit(0.0)).alias("value_12m"), zero("offplan_all"),
        "first_sale", "last_sale",
        F.when((F.col("sales_all") > 0) & (F.col("units") > 0), F.least(F.lit(100.0), share("sales_all", "units"))).alias("sold_pct"),
        "psm_90", zero("psm_90_n"), zero("readings"), zero("sources"),
    )


def delivery_record(profile: DataFrame, as_of: str, min_late: float = 0.5) -> DataFrame:
    """What each developer delivered, how late, what slipped, and what is due this year, later or undated."""
    c, units = F.col, F.coalesce("units", F.lit(0))
    building = c("live") & (c("status") == "ACTIVE")
    late = c("finished") & c("planned").isNotNull() & c("current").isNotNull() & (c("late_months") > min_late)
    slipped = c("live") & (c("slip_months") > min_late)
    year = F.year(day(as_of))
    base = profile.groupBy("developer_number").agg(
        count_where(c("finished")).alias("delivered"), F.sum(F.when(c("finished"), units).otherwise(0)).alias("delivered_units"),
        count_where(c("finished") & c("planned").isNotNull() & c("current").isNotNull()).alias("with_dates"), count_where(late).alias("late"),
        count_where(building).alias("building"), F.sum(F.when(building, units).otherwise(0)).alias("building_units"),
        count_where(building & c("past_due")).alias("past_due"), count_where(slipped).alias("slipped"),
        count_where(c("live") & (c("status") != "ACTIVE")).alias("pipeline"), count_where(c("cancelled")).alias("cancelled"),
        count_where(building & (F.year("current") == year)).alias("due_this_year"), count_where(building & (F.year("current") > year)).alias("due_later"),
        count_where(building & c("current").isNull()).alias("undated"),
    )
    measures = {"late": F.when(late, c("late_months")), "slip": F.when(slipped, c("slip_months"))}
    stats = order_statistics(profile, ["developer_number"], measures, {"_late": Pick("late"), "_slip": Pick("slip")})
    return base.join(stats, "developer_number", "left").select(
        "*", share(c("with_dates") - c("late"), "with_dates").alias("on_time_pct"), settle("_late", 1).alias("median_late_months"),
        settle("_slip", 1).alias("median_slip_months"),
    ).drop("_late", "_slip")


def planned_vs_delivered(profile: DataFrame, from_year: int, to_year: int) -> DataFrame:
    """Units promised for a year, delivered in it, on time, moved away from it and past due, per developer."""
    units, c = F.coalesce("units", F.lit(0)), F.col
    planned_year, delivered_year = F.year("planned"), F.when(c("finished"), F.year("current"))
    moved = ~c("finished") & c("current").isNotNull() & (F.year("current") != planned_year)
    zero = F.lit(0)
    entry = lambda year, **f: F.struct(
        year.alias("year"), *[f.get(k, zero).cast("long").alias(k) for k in (
            "planned_units", "planned_projects", "moved_units", "moved_projects", "past_due_units", "delivered_units", "delivered_projects", "on_time_units")])
    promised = entry(
        planned_year, planned_units=units, planned_projects=F.lit(1), moved_units=F.when(moved, units).otherwise(0),
        moved_projects=moved.cast("int"), past_due_units=F.when(c("past_due"), units).otherwise(0))
    delivered = entry(delivered_year, delivered_units=units, delivered_projects=F.lit(1), on_time_units=F.when(c("late_months") == 0, units).otherwise(0))
    names = ("planned_units", "planned_projects", "moved_units", "moved_projects", "past_due_units", "delivered_units", "delivered_projects", "on_time_units")
    return (
        profile.filter(~c("cancelled")).select("developer_number", F.explode(F.array(promised, delivered)).alias("e"))
        .filter(c("e.year").between(from_year, to_year))
        .groupBy("developer_number", c("e.year").alias("year")).agg(*[F.sum(F.coalesce(c(f"e.{n}"), zero)).alias(n) for n in names])
    )


def developer_momentum(tx: DataFrame, project: DataFrame, as_of: str, months: int = 24, unit: float = 1e6) -> DataFrame:
    """Monthly sales of every developer over the trailing months."""
    monthly = tx.filter(is_sale() & (F.col("instance_date") >= F.add_months(day(as_of), -months))).groupBy(
        "project_number", month_start("instance_date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), total("actual_worth").alias("worth"), count_where(is_off_plan()).alias("off"))
    return monthly.join(project.select("project_number", "developer_number"), "project_number").groupBy("developer_number", "month").agg(
        F.sum("n").alias("n"), half_up(total("worth") / unit, 2).alias("value"), F.sum("off").alias("off"))


def developer_year(tx: DataFrame, project: DataFrame, pairs: DataFrame, as_of: str, limits: Limits = DEFAULT_LIMITS, unit: float = 1e9) -> DataFrame:
    """A year's sales against the year before, share of the market, medians, and resale outcomes, per developer."""
    owner = project.select("project_number", "developer_number")
    d = F.col("instance_date")
    now, then = d >= days_before(as_of, 365), (d >= days_before(as_of, 730)) & (d < days_before(as_of, 365))
    sales = tx.filter(is_sale() & (d >= days_before(as_of, 730))).join(owner, "project_number", "left")
    worth = F.col("actual_worth")
    base = sales.groupBy("developer_number").agg(
        count_where(now).alias("n_12"), half_up(total(F.when(now, worth)) / unit, 2).alias("value_12"), count_where(now & is_off_plan()).alias("_off"),
        count_where(then).alias("n_prev"), half_up(total(F.when(then, worth)) / unit, 2).alias("value_prev"))
    base = base.withColumn("_market", base.agg(F.sum("n_12")).scalar()).filter(F.col("developer_number").isNotNull())
    price = F.when(is_unit() & psm_ok(limits), F.col("meter_sale_price"))
    medians = order_statistics(
        sales.filter(F.col("developer_number").isNotNull()), ["developer_number"], {"now": F.when(now, price), "then": F.when(then, price)},
        {"_now": Pick("now"), "_then": Pick("then")})
    clean = pairs.filter(
        (F.col("ambiguity") == 0) & (F.col("sold_on") >= days_before(as_of, 730)) & ~re_registration(F.col("change_pct"), F.col("hold_days"))
    ).join(owner, "project_number")
    resold = clean.groupBy("developer_number").agg(
        F.count(F.lit(1)).alias("resales"), count_where(F.col("change_pct") < 0).alias("_lost"), count_where(F.col("bought_reg").ilike("%off%")).alias("resales_offplan"))
    outcome = order_statistics(clean, ["developer_number"], {"g": F.col("change_pct") * 100, "h": F.col("hold_days") / F.lit(DAYS_PER_MONTH)}, {"_g": Pick("g"), "_h": Pick("h")})
    return base.join(medians, "developer_number", "left").join(resold, "developer_number", "left").join(outcome, "developer_number", "left").select(
        "developer_number", "n_12", "value_12", share("_off", "n_12").alias("offplan_pct"), "n_prev", "value_prev", share("n_12", "_market", 1).alias("market_share"),
        settle("_now").alias("med_psm"), settle("_then").alias("med_psm_prev"), F.coalesce("resales", F.lit(0)).alias("resales"),
        settle("_g", 1).alias("median_gain"), share("_lost", "resales").alias("loss_pct"), settle("_h", 1).alias("median_hold_months"),
        F.coalesce("resales_offplan", F.lit(0)).alias("resales_offplan"))


def developer_areas(profile: DataFrame) -> DataFrame:
    """Areas a developer builds in."""
    return profile.groupBy("developer_number", "area_name").agg(
        F.count(F.lit(1)).alias("projects"), F.sum(F.coalesce("units", F.lit(0))).alias("units"), count_where(F.col("live")).alias("live"))
