"""Gates a build must pass: invariants, reading currency, model accuracy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.numbers import between_days, count_where, day, month_start
from cadastra.functions.predicates import is_sale
from cadastra.functions.text import tx_key, tx_number
from cadastra.operators.quantiles import Pick, order_statistics


def _check(name: str, measured: DataFrame, found: Column, allowed: Column, otherwise: str = "fail") -> DataFrame:
    return measured.select(
        F.lit(name).alias("check"), F.when(allowed, F.lit("ok")).otherwise(F.lit(otherwise)).alias("outcome"), found.cast("bigint").alias("found"))


# One registration as four feeds write it, and the key it must land on.
KEY_SHAPES = ("1-11-2026-26618", "11-26618-2026", "1-11-2026-26618#a2026090323965", "w#11-26618-2026#1")
KEY_EXPECTED = "11|2026|26618|Sales"


def key_checks(df: DataFrame) -> DataFrame:
    """The key's own cases, evaluated by the same expressions the data goes through."""
    one = df.sparkSession.range(1)
    landed = sum((tx_key(F.lit(s), F.lit("Sales")).eqNullSafe(F.lit(KEY_EXPECTED)).cast("int") for s in KEY_SHAPES), F.lit(0))
    apart = ~tx_key(F.lit("1-11-2026-26618"), F.lit("Sales")).eqNullSafe(tx_key(F.lit("2-11-2026-26618"), F.lit("Mortgages")))
    number = (tx_number(F.lit(KEY_SHAPES[3])) == KEY_SHAPES[1]) & (tx_number(F.lit(KEY_SHAPES[2])) == KEY_SHAPES[0])
    cases = [
        _check("key shapes", one, landed, landed == len(KEY_SHAPES)), _check("groups stay apart", one, apart.cast("int"), apart),
        _check("number parsing", one, number.cast("int"), number),
        _check("unreadable numbers rejected", one, F.lit(0), tx_key(F.lit("nonsense"), F.lit("Sales")).isNull()),
    ]
    return reduce(DataFrame.unionByName, cases)


def quality_report(
    tx: DataFrame, vintages: dict[str, tuple[DataFrame, DataFrame]], anchors: Sequence[tuple[str, str, str, int | Column]], as_of: str, scale: float = 1.6
) -> DataFrame:
    """One row per invariant with ok, warn or fail.

    ``tx`` carries tx_key, feed_date and withdrawn_on; ``vintages`` maps a kind to (rows with id,
    vintage rows with id); ``anchors`` are (name, from, to, expected sales) of closed periods.
    """
    copies = tx.filter(F.col("tx_key").isNotNull()).groupBy("tx_key").agg(F.count(F.lit(1)).alias("n")).agg(count_where(F.col("n") > 1).alias("v"))
    flat = tx.agg(
        count_where(F.col("tx_key").isNull()).alias("unkeyed"), count_where(F.col("withdrawn_on").isNotNull() & F.col("feed_date").isNull()).alias("unfiled"),
        *[count_where(is_sale() & between_days("instance_date", a, b)).alias(f"anchor_{i}") for i, (_, a, b, _) in enumerate(anchors)])
    first = F.add_months(F.trunc(day(as_of), "MM"), -13)
    monthly = tx.filter(is_sale() & (F.col("instance_date") >= first) & (F.col("instance_date") < F.trunc(day(as_of), "MM"))).groupBy(
        month_start("instance_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    middle = order_statistics(monthly.withColumn("k", F.lit(1)), ["k"], {"n": F.col("n")}, {"m": Pick("n", "upper")}).select("m").scalar()
    wild = monthly.agg(count_where(F.col("n") > middle * scale).alias("v"))
    checks = [
        key_checks(tx),
        _check("no duplicate keys", copies, F.col("v"), F.col("v") == 0),
        _check("every row keyed", flat, F.col("unkeyed"), F.col("unkeyed") == 0, "warn"),
        _check("withdrawals were filed", flat, F.col("unfiled"), F.col("unfiled") == 0),
        *[_check(f"anchor {name}", flat, F.col(f"anchor_{i}"), F.col(f"anchor_{i}") == expected) for i, (name, _, _, expected) in enumerate(anchors)],
        _check("no month out of scale", wild, F.col("v"), F.col("v") == 0, "warn"),
    ]
    for kind, (rows, vintage) in vintages.items():
        bare = rows.filter(F.col("id").isNotNull()).join(vintage.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("v"))
        checks.append(_check(f"every {kind} has a vintage", bare, F.col("v"), F.col("v") == 0))
    return reduce(DataFrame.unionByName, checks)


def reading_currency(register: DataFrame, handover: DataFrame, current_from: str) -> DataFrame:
    """No claim may rest on a stale reading: flag and date agree, counts add up, no percentage above 100."""
    c = F.col
    flagged = c("reading_current") != F.coalesce(c("last_read") >= day(current_from), F.lit(False))
    live = register.agg(
        count_where(flagged).alias("flag"), count_where(c("is_live")).alias("live"),
        (count_where(c("is_live")) - count_where(c("is_live") & c("reading_current")) - count_where(c("is_live") & ~c("reading_current"))).alias("unaccounted"),
        count_where(c("certified_pct") > 100).alias("above"))
    stale = handover.agg(count_where(c("last_read") < day(current_from)).alias("v"))
    checks = [
        _check("flag follows the reading date", live, c("flag"), c("flag") == 0), _check("live counts add up", live, c("unaccounted"), c("unaccounted") == 0),
        _check("no percentage above 100", live, c("above"), c("above") == 0), _check("handover rests on current readings", stale, c("v"), c("v") == 0),
    ]
    return reduce(DataFrame.unionByName, checks)


def model_gates(calibration: DataFrame, index: DataFrame, min_tested: int = 2_000, max_error_pct: float = 8.0) -> DataFrame:
    """Release gates on the models: enough held-out sales, error within bounds, an index in use."""
    c = F.col
    tested = calibration.filter(c("bucket") == "all").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("median_abs_error_pct").alias("e"))
    levels = index.agg(F.count(F.lit(1)).alias("n"))
    checks = [
        _check("valuation tested", tested, c("n"), c("n") >= min_tested),
        _check("valuation error", tested, F.round("e"), F.coalesce(c("e") <= max_error_pct, F.lit(False))),
        _check("index in use", levels, c("n"), c("n") > 0),
    ]
    return reduce(DataFrame.unionByName, checks)
