"""Sales forecast: seasonal factors, flat and damped-momentum cases, quarters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.numbers import day, half_up, month_start, total
from cadastra.functions.predicates import is_sale
from cadastra.operators.quantiles import Pick, order_statistics

DAMPING = 0.85
FLOOR = 1e-9


def last_whole_month(tx: DataFrame) -> Column:
    """First day of the last month held in full; a part month would read as a collapse."""
    newest = tx.filter(is_sale()).agg(F.max("instance_date").alias("d"))
    d = F.col("d")
    return newest.select(F.when(d == F.last_day(d), F.trunc(d, "MM")).otherwise(F.add_months(F.trunc(d, "MM"), -1)).alias("m")).scalar()


def market_months(tx: DataFrame, history_from: str, unit: float = 1e6) -> DataFrame:
    """Market sales per whole month from ``history_from``: units and value."""
    last = last_whole_month(tx)
    return (
        tx.filter(is_sale() & (F.col("instance_date") >= day(history_from)) & (F.col("instance_date") <= F.last_day(last)))
        .groupBy(month_start("instance_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("units"), (total("actual_worth") / unit).alias("value"))
    )


def developer_months(tx: DataFrame, project: DataFrame, market: DataFrame, group: DataFrame, unit: float = 1e6) -> DataFrame:
    """Monthly sales per issuer on the market's months, a month without a sale counting as zero.

    ``group`` maps developer_number to issuer. Sales are collapsed to project months before the joins.
    """
    by_project = tx.filter(is_sale()).groupBy("project_number", month_start("instance_date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), total("actual_worth").alias("w"))
    sales = (
        by_project.join(project.select("project_number", "developer_number"), "project_number").join(group, "developer_number")
        .groupBy("issuer", "month").agg(F.sum("n").alias("n"), total("w").alias("w"))
    )
    months = market.agg(F.sort_array(F.collect_list("month")).alias("m")).scalar()
    spine = group.select("issuer").distinct().select("issuer", F.explode(months).alias("month"))
    return spine.join(sales, ["issuer", "month"], "left").select(
        "issuer", "month", F.coalesce("n", F.lit(0)).alias("units"), (F.coalesce("w", F.lit(0.0)) / unit).alias("value"))


def _long(months: DataFrame, keys: list[str]) -> DataFrame:
    cast = months.select(*keys, "month", F.col("units").cast("double").alias("units"), F.col("value").alias("value"))
    return cast.unpivot([*keys, "month"], ["units", "value"], "measure", "v")


def centred_mean(series: DataFrame, keys: list[str], half: int = 6) -> DataFrame:
    """Mean of the frame centred on each row, only where the frame is whole; one row per month."""
    frame = Window.partitionBy(*keys).orderBy("month").rowsBetween(-half, half)
    return series.select(
        "*", (F.sum("v").over(frame) / (2 * half + 1)).alias("centred"), F.count(F.lit(1)).over(frame).alias("_n")
    ).filter(F.col("_n") == 2 * half + 1).drop("_n")


def seasonal_factors(market: DataFrame) -> DataFrame:
    """Median ratio of each calendar month to its centred thirteen-month mean, normalised to mean one."""
    ratios = centred_mean(_long(market, []), ["measure"]).filter(F.col("centred") > 0).withColumn("calendar_month", F.month("month"))
    middles = order_statistics(ratios, ["measure", "calendar_month"], {"r": F.col("v") / F.col("centred")}, {"raw": Pick("r")})
    every = market.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("calendar_month"), F.explode(F.array(F.lit("units"), F.lit("value"))).alias("measure"))
    full = every.join(middles, ["measure", "calendar_month"], "left").withColumn("raw", F.coalesce("raw", F.lit(1.0)))
    norm = F.sum("raw").over(Window.partitionBy("measure")) / 12
    return full.select("measure", "calendar_month", (F.col("raw") / norm).alias("factor"))


def forecast(months: DataFrame, factors: DataFrame, keys: list[str], horizon: int = 8, min_active: int = 0) -> DataFrame:
    """Flat and damped log-linear cases for ``horizon`` months after the last one, re-seasonalised.

    Zero months are floored before the logarithm, in slope and anchor alike. A series with fewer
    than ``min_active`` months of sales is left out.
    """
    group = [*keys, "measure"]
    rows = _long(months, keys).withColumn("calendar_month", F.month("month")).join(factors, ["measure", "calendar_month"])
    newest = Window.partitionBy(*group).orderBy(F.desc("month"))
    last12 = rows.select("*", (F.col("v") / F.col("factor")).alias("sa"), F.row_number().over(newest).alias("_rn"),
                         F.count_if(F.col("v") > 0).over(Window.partitionBy(*group)).alias("_active")).filter(
        (F.col("_rn") <= 12) & (F.col("_active") >= min_active))
    log_sa = F.log(F.greatest("sa", F.lit(FLOOR)))
    x = (12 - F.col("_rn")).cast("double")
    fit = last12.groupBy(*group).agg(
        (F.sum(F.when(F.col("_rn") <= 3, F.col("sa"))) / 3).alias("flat_level"), F.regr_slope(log_sa, x).alias("slope"),
        F.avg(log_sa).alias("_mean"), F.max("month").alias("last_month"), F.max("_active").alias("active_months"))
    d = F.lit(DAMPING)
    ahead = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    # The faded slope after h months: slope * (d + d^2 + … + d^h).
    drift = F.col("slope") * d * (1 - F.pow(d, F.col("h"))) / (1 - d)
    anchor = F.col("_mean") + F.col("slope") * F.lit(5.5)
    future = ahead.select(
        *group, F.add_months("last_month", F.col("h")).alias("month"), "h", "flat_level", "active_months",
        F.exp(anchor + drift).alias("_momentum"), ((F.exp("slope") - 1) * 100).alias("momentum_pct_per_month"))
    return future.withColumn("calendar_month", F.month("month")).join(factors, ["measure", "calendar_month"]).select(
        *group, "month", "h", (F.col("flat_level") * F.col("factor")).alias("flat"), (F.col("_momentum") * F.col("factor")).alias("momentum"),
        "momentum_pct_per_month", "flat_level")


def forecast_quarters(months: DataFrame, keys: list[str]) -> DataFrame:
    """Calendar quarters of a forecast with how many months each covers."""
    return months.groupBy(*keys, "measure", F.year("month").alias("year"), F.quarter("month").alias("quarter")).agg(
        half_up(F.sum("flat"), 4).alias("flat"), half_up(F.sum("momentum"), 4).alias("momentum"), F.count(F.lit(1)).alias("months"))
