"""Helpers that keep one large group from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAVY_PARTS = 1000


def groups_of_size(df: DataFrame, keys: Sequence[str], lo: int, hi: int, size: str = "group_size") -> DataFrame:
    """Rows of the groups holding lo..hi rows, with the group size; keys must not be null.

    Sizes are counted with map-side combining. A group holding over one row in a thousand is
    struck off before any row is shuffled: at most a thousand groups can be that large, which
    bounds what is broadcast whatever the data. The rest meet their sizes in a join on the
    same keys that a following window over ``keys`` needs, so it adds no shuffle of its own.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
    whole = sizes.agg(F.coalesce(F.sum(size), F.lit(0))).scalar()
    heavy = sizes.filter((F.col(size) > hi) & (F.col(size) * HEAVY_PARTS > whole)).select(*keys)
    rest = df.join(F.broadcast(heavy), keys, "left_anti")
    return rest.join(sizes.filter(F.col(size).between(lo, hi)), keys)


PART_ROWS = 50_000
BLOCK_PARTS = 1_000


def starts_of(sizes: DataFrame, keys: Sequence[str], part: str, size: str, name: str) -> DataFrame:
    """``sizes`` (keys, part from 0, size) with the rows of the parts before each, summed in blocks of parts and then over the blocks."""
    keys = list(keys)
    rows = sizes.withColumn("_block", F.floor(F.col(part) / BLOCK_PARTS))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_inner", F.coalesce(F.sum(size).over(before(*keys, "_block").orderBy(part)), F.lit(0)))
    blocks = rows.groupBy(*keys, "_block").agg(F.sum(size).alias("_held"))
    named = {k: f"_b_{i}" for i, k in enumerate([*keys, "_block"])}
    blocks = blocks.withColumn("_outer", F.coalesce(F.sum("_held").over(before(*keys).orderBy("_block")), F.lit(0)))
    blocks = blocks.select(*[F.col(k).alias(v) for k, v in named.items()], "_outer")
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]
    return inner.join(blocks, same).withColumn(name, F.col("_inner") + F.col("_outer")).drop("_block", "_inner", "_outer", *named.values())


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Number the rows of every group 1..n, each number once, without gathering a group.

    Groups are counted first. One of more than ``part_rows`` rows is split by the hash of the ordering columns
    into as many parts as its count asks for; the numbers of a part start after the rows of the parts before it. All
    other groups are numbered in order as they are.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    named = {k: f"_g_{i}" for i, k in enumerate(keys)}
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_rows)
    large = sizes.select(*[F.col(k).alias(v) for k, v in named.items()], F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts"))
    split = df.join(F.broadcast(large), [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()], "left").drop(*named.values())
    split = split.withColumn("_part", F.pmod(F.xxhash64(*order), F.coalesce("_parts", F.lit(1))).cast("int"))
    held = split.filter(F.col("_parts").isNotNull()).groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    named = {k: f"_s_{i}" for i, k in enumerate([*keys, "_part"])}
    starts = starts_of(held, keys, "_part", "_size", "_start").select(*[F.col(k).alias(v) for k, v in named.items()], "_start")
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = split.join(F.broadcast(starts), same, "left").withColumn(name, F.coalesce("_start", F.lit(0)) + F.row_number().over(inside))
    return numbered.drop("_parts", "_part", "_start", *named.values())


def number_in_order(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[Column | str], name: str) -> DataFrame:
    """Number the rows of every group 1..n by ``day`` and then ``order``; no more than a group's day meets in one task.

    The days of a group are counted, so only as many rows as it has days are summed up in order.
    """
    keys = list(keys)
    held = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(day)).rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"_s_{i}" for i, k in enumerate([*keys, day])}
    starts = held.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).select(*[F.col(k).alias(v) for k, v in named.items()], "_start")
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]
    inside = Window.partitionBy(*keys, day).orderBy(*order)
    return df.join(starts, same).withColumn(name, F.col("_start") + F.row_number().over(inside)).drop("_start", *named.values())


def left_join_keyed(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join in which rows without a key are not shuffled: they match nothing and pass by."""
    extra = [F.lit(None).cast(other.schema[c].dataType).alias(c) for c in other.columns if c != key]
    matched = df.filter(F.col(key).isNotNull()).join(other, key, "left")
    return matched.select(*df.columns, *[c for c in other.columns if c != key]).unionByName(df.filter(F.col(key).isNull()).select(*df.columns, *extra))
