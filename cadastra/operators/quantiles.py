"""Exact order statistics by group, for groups of any size.

A built-in exact median keeps every distinct value of a group in one task. Here a
group is never gathered: values are first collapsed to (group, bucket, value, count)
with map-side combining, the running count over the *buckets* of a group (a small
set, whatever the rows) tells which bucket holds each wanted rank, and only the
distinct values of those buckets are ordered.

Buckets are logarithmic and order preserving, ``resolution`` per e-fold, so the
bucket row count of a group is bounded by the value range, not by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLUTION = 2048


@dataclass(frozen=True)
class Pick:
    """One wanted statistic of one measure.

    ``mode``: ``median`` (mean of the two middles), ``upper`` (the upper middle),
    ``floor`` (index floor(p*n), at most n-1), ``nearest`` (index round((n-1)*p)), ``count``
    (how many values there are).
    """

    measure: str
    mode: str = "median"
    p: float = 0.5

    def ranks(self) -> tuple[str, str]:
        """First and second 0-based rank wanted out of ``_total`` values, as SQL text."""
        if self.mode == "count":
            return "0", "0"
        if self.mode == "median":
            return "(_total - 1) DIV 2", "_total DIV 2"
        if self.mode == "upper":
            at = "_total DIV 2"
        elif self.mode == "floor":
            at = f"least(_total - 1, CAST(floor({self.p}D * _total) AS BIGINT))"
        elif self.mode == "nearest":
            at = f"CAST(floor((_total - 1) * {self.p}D + 0.5D) AS BIGINT)"
        else:
            raise ValueError(f"unknown quantile mode {self.mode}")
        return at, at


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    picks: Mapping[str, Pick],
    weight: str | None = None,
    resolution: int = RESOLUTION,
) -> DataFrame:
    """One row per group with every statistic in ``picks``.

    ``weight`` names a count column when a row stands for several equal ones.

    ``measures`` maps a name to a Column that is null where the row does not take part.
    A group whose measures are all null gives no row; join the result to the grouped
    base to keep it.
    """
    keys = list(keys)
    names = list(measures)
    carried = [F.col(weight).alias("_w")] if weight else []
    each = ["_w"] if weight else []
    wide = df.select(*keys, *carried, *[measures[m].cast("double").alias(f"_v{i}") for i, m in enumerate(names)])
    if len(names) == 1:
        long = wide.select(*keys, *each, F.lit(0).alias("_m"), F.col("_v0").alias("_v"))
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(f"_v{i}").alias("_v")) for i in range(len(names))])
        long = wide.select(*keys, *each, F.explode(pairs).alias("_p")).select(*keys, *each, "_p._m", "_p._v")
    counts = (
        long.filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_m", F.expr(f"floor(signum(_v) * log1p(abs(_v)) * {resolution}D)").alias("_b"), "_v")
        .agg(F.expr("sum(_w)" if weight else "count(1)").alias("_n"))
    )
    return _pick_from_counts(counts, keys, names, picks)


def _pick_from_counts(counts: DataFrame, keys: list[str], names: list[str], picks: Mapping[str, Pick]) -> DataFrame:
    group = [*keys, "_m"]
    over = ", ".join(f"`{g}`" for g in group)
    running = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    buckets = counts.groupBy(*group, "_b").agg(F.expr("sum(_n)").alias("_bn")).selectExpr(
        *[f"`{g}`" for g in group], "_b",
        f"sum(_bn) OVER (PARTITION BY {over} ORDER BY _b {running}) - _bn AS _start",
        f"sum(_bn) OVER (PARTITION BY {over} ORDER BY _b {running}) AS _end",
        f"sum(_bn) OVER (PARTITION BY {over}) AS _total",
    )

    def hits(pick: Pick, lo: str, hi: str) -> list[str]:
        return [f"(_m = {names.index(pick.measure)} AND {r} >= {lo} AND {r} < {hi})" for r in pick.ranks()]

    wanted = " OR ".join(h for pick in picks.values() for h in hits(pick, "_start", "_end"))
    targets = buckets.filter(wanted).select(*group, "_b", "_start", "_total")
    ranked = counts.join(targets, [*group, "_b"]).selectExpr(
        *[f"`{g}`" for g in group], "_v", "_total",
        f"_start + sum(_n) OVER (PARTITION BY {over}, _b ORDER BY _v {running}) - _n AS _lo",
        f"_start + sum(_n) OVER (PARTITION BY {over}, _b ORDER BY _v {running}) AS _hi",
    )
    aggs = []
    for name, pick in picks.items():
        first, second = hits(pick, "_lo", "_hi")
        if pick.mode == "count":
            aggs.append(F.expr(f"coalesce(max(CASE WHEN {first} THEN _total END), 0L)").alias(name))
        elif first == second:
            aggs.append(F.expr(f"max(CASE WHEN {first} THEN _v END)").alias(name))
        else:
            aggs.append(F.expr(f"max(CASE WHEN {first} THEN _v END) / 2 + max(CASE WHEN {second} THEN _v END) / 2").alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def with_order_statistics(
    base: DataFrame,
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    picks: Mapping[str, Pick],
) -> DataFrame:
    """``base`` (one row per group) left-joined to the order statistics of ``df``."""
    return base.join(order_statistics(df, keys, measures, picks), list(keys), "left")


def beside(base: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two tables of one row per group put side by side by grouping their union.

    For groups named by a constant, where a join would have no key left to join on.
    """
    columns = [c for c in (*base.columns, *stats.columns) if c not in keys]
    both = base.unionByName(stats, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in dict.fromkeys(columns)])


def median_by(df: DataFrame, keys: Sequence[str], value: Column | str, name: str = "median") -> DataFrame:
    """Exact median by group with the row count behind it."""
    value = F.col(value) if isinstance(value, str) else value
    return order_statistics(df, keys, {"v": value}, {name: Pick("v"), "n": Pick("v", "count")})
