"""Quarterly developer panels: entities, first sales without repeats, registrations, maturity, lag."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.numbers import between_days, count_where, day, half_up, quarter_index, quarter_label, total
from cadastra.functions.predicates import DEVELOPER_PROCEDURES, PRE_REGISTRATION, is_off_plan, is_ready, is_sale
from cadastra.operators.market import bucketize
from cadastra.operators.quantiles import Pick, order_statistics


@dataclass(frozen=True)
class PanelRules:
    procedures: tuple[str, ...] = DEVELOPER_PROCEDURES
    first_procedure: str = PRE_REGISTRATION
    price_tolerance: float = 0.005
    home_types: tuple[str, ...] = ("Unit", "Villa")
    land_max_sqm: float = 3_000.0
    psm_min: float | None = 500.0
    psm_max: float | None = 200_000.0
    psm_below: float | None = None
    statistic: str = "median"
    groups: tuple[str, ...] | None = ("Sales",)
    trailing_quarters: int = 2
    max_orphan_share: float = 0.005
    orphan_lookback: int = 6
    unit_key: tuple[str, ...] = field(default=("project_number", "building_name", "property_type", "rooms", "procedure_area"))


def quarter_start(q: str) -> str:
    return f"{q[:4]}-{(int(q[5]) - 1) * 3 + 1:02d}-01"


def entity_projects(config: DataFrame, project: DataFrame) -> DataFrame:
    """Projects of each panel entity, with the problems a config can have in ``problem``.

    ``config``: developer_number, attribution_scope, project_numbers, exclude_project_numbers
    (arrays, null or empty for none). An entity is a whole developer, a developer less some
    projects, or named projects. Named and excluded projects must be the developer's, and no
    project may be in two entities.
    """
    empty = F.array().cast("array<string>")
    c = config.select(
        "developer_number", "attribution_scope", F.coalesce("project_numbers", empty).alias("_named"),
        F.coalesce("exclude_project_numbers", empty).alias("_out"),
    ).withColumn("entity_id", F.when(F.size("_named") > 0, F.concat_ws("/", "developer_number", F.array_join("_named", "+"))).otherwise(F.col("developer_number")))
    owned = project.select("project_number", F.col("developer_number").alias("_owner"))
    whole = c.filter(F.size("_named") == 0).join(
        owned, F.col("developer_number") == F.col("_owner")).filter(~F.array_contains("_out", F.col("project_number")))
    named = c.filter(F.size("_named") > 0).withColumn("project_number", F.explode("_named")).join(owned, "project_number", "left")
    claims = whole.select("entity_id", "developer_number", "attribution_scope", "project_number", "_owner").unionByName(
        named.select("entity_id", "developer_number", "attribution_scope", "project_number", "_owner"))
    times = claims.groupBy("project_number").agg(F.count(F.lit(1)).alias("_claims"))
    problem = F.when(~F.col("_owner").eqNullSafe(F.col("developer_number")), F.lit("not this developer's project")).when(
        F.col("_claims") > 1, F.lit("claimed by more than one entity"))
    return claims.join(times, "project_number").select("entity_id", "developer_number", "attribution_scope", "project_number", problem.alias("problem"))


def match_repeats(first: Sequence[bool], worth: Sequence[float], tolerance: float) -> list[bool]:
    """Which of an island's registrations, given in order, are an earlier first one registered again.

    A later registration takes the earliest unused first one whose price it meets within the tolerance of that
    price. The firsts stand in order of price with the time they came while they are unused; the earliest of a
    range of prices is the least of a range of that row, found in as many steps as the firsts' number has digits.
    """
    prices = sorted(w for w, f in zip(worth, first) if f)
    size = 1
    while size < max(1, len(prices)):
        size *= 2
    none = len(worth)
    earliest = [none] * (2 * size)
    taken: dict[float, int] = {}  # how many of a price have come: equal prices fill their places from the left
    place_of: dict[int, int] = {}

    def put(place: int, value: int) -> None:
        node = size + place
        earliest[node] = value
        while node > 1:
            node //= 2
            earliest[node] = min(earliest[2 * node], earliest[2 * node + 1])

    def least(lo: int, hi: int) -> int:
        found, lo, hi = none, lo + size, hi + size
        while lo < hi:
            if lo % 2:
                found, lo = min(found, earliest[lo]), lo + 1
            if hi % 2:
                hi -= 1
                found = min(found, earliest[hi])
            lo, hi = lo // 2, hi // 2
        return found

    def meets(price: float, w: float) -> bool:
        return abs(price - w) / price <= tolerance

    repeats = []
    for at, (is_first, w) in enumerate(zip(first, worth)):
        if is_first:
            place_of[at] = bisect_left(prices, w) + taken.get(w, 0)
            taken[w] = taken.get(w, 0) + 1
            put(place_of[at], at)
            repeats.append(False)
            continue
        lo = bisect_left(prices, w / (1 + tolerance))
        hi = bisect_right(prices, w / (1 - tolerance)) if tolerance < 1 else len(prices)
        # The rule itself decides about the prices at both edges.
        if lo and meets(prices[lo - 1], w):
            lo = bisect_left(prices, prices[lo - 1])
        while lo < hi and not meets(prices[lo], w):
            lo = bisect_right(prices, prices[lo])
        if hi < len(prices) and meets(prices[hi], w):
            hi = bisect_right(prices, prices[hi])
        while lo < hi and not meets(prices[hi - 1], w):
            hi = bisect_left(prices, prices[hi - 1])
        hit = least(lo, hi) if lo < hi else none
        if hit < none:
            put(place_of[hit], none)
        repeats.append(hit < none)
    return repeats


def _walk_islands(batches: Iterator[pd.DataFrame], tolerance: float) -> Iterator[pd.DataFrame]:
    """Mark repeats in rows ordered by island and date; an island at hand is held until its last row has come."""

    def marked(rows: pd.DataFrame) -> pd.DataFrame:
        island = rows["island_key"].to_numpy()
        ends = [*(np.flatnonzero(island[1:] != island[:-1]) + 1).tolist(), len(rows)]
        first, worth, repeats, start = rows["is_first"].tolist(), rows["actual_worth"].tolist(), [], 0
        for end in ends:
            repeats += match_repeats(first[start:end], worth[start:end], tolerance)
            start = end
        return rows.assign(is_repeat=repeats)

    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch["island_key"].iloc[-1]
        if held and held[-1]["island_key"].iloc[-1] == last:
            held.append(batch)
            continue
        rows = pd.concat([*held, batch]) if held else batch
        going = (rows["island_key"] == last).to_numpy()
        held = [rows[going]]
        if not going.all():
            yield marked(rows[~going])
    if held:
        yield marked(pd.concat(held))


def mark_repeats(tx: DataFrame, entities: DataFrame, rules: PanelRules, as_of: str) -> DataFrame:
    """Developer sales of homes with ``is_repeat`` set where a sale is an earlier one registered again.

    The match is by unit, in order of date. Two prices that differ by more than the tolerance never match, so
    a unit's sales are first split into islands of price that cannot touch one another; islands
    without both a first and a later registration have no repeat, and those of one each are judged where they
    stand. Only the rest, part of one unit's own sales each, meet in a task.
    """
    home = F.col("property_type").isin(*rules.home_types) | (
        (F.col("property_type") == "Land") & (F.coalesce("procedure_area", F.lit(0.0)) <= rules.land_max_sqm))
    keys = [f"_u{i}" for i in range(len(rules.unit_key))]
    norm = {
        "building_name": F.coalesce(F.trim("building_name"), F.lit("")), "rooms": F.coalesce("rooms", F.lit("")),
        "procedure_area": half_up(F.coalesce("procedure_area", F.lit(0.0)), 2).cast("string"),
    }
    rows = tx.filter(is_sale() & F.col("procedure_name").isin(*rules.procedures) & home & (F.col("instance_date") <= day(as_of))).join(
        entities.select("project_number", "entity_id"), "project_number"
    ).select(
        *[c for c in ("transaction_id",) if c in tx.columns], "entity_id", "project_number", "instance_date", "actual_worth", "meter_sale_price", "procedure_name", "building_name", "property_type", "rooms",
        "procedure_area", "area_name", (F.col("procedure_name") == rules.first_procedure).alias("is_first"),
        *[norm.get(c, F.coalesce(c, F.lit(""))).alias(k) for c, k in zip(rules.unit_key, keys)],
    )
    width = max(-math.log1p(-rules.price_tolerance), 1e-9) * (1 + 1e-9)
    bucket = F.when(F.col("actual_worth") > 0, F.floor(F.log("actual_worth") / F.lit(width)))
    rows = rows.withColumn("_b", bucket)
    # Registrations of one day stand in the order of their ids, where the source has ids.
    number = [c for c in ("transaction_id",) if c in rows.columns]
    order = ["instance_date", *number, "actual_worth", "is_first"]
    rows = rows.withColumn("_at", F.struct(*order))
    by_bucket = rows.filter(F.col("_b").isNotNull()).groupBy(*keys, "_b").agg(
        count_where(F.col("is_first")).alias("_firsts"), count_where(~F.col("is_first")).alias("_laters"), F.max(F.when(F.col("is_first"), F.col("_at"))).alias("_first"))
    in_unit = Window.partitionBy(*keys).orderBy("_b")
    gaps = by_bucket.withColumn("_new", (F.coalesce(F.col("_b") - F.lag("_b").over(in_unit), F.lit(2)) > 1).cast("int"))
    islands = gaps.withColumn("_island", F.sum("_new").over(in_unit.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy(*keys, "_island")
    walked = islands.withColumns({"_f": F.sum("_firsts").over(whole), "_l": F.sum("_laters").over(whole), "_first": F.max("_first").over(whole)}).filter(
        (F.col("_f") > 0) & (F.col("_l") > 0)).select(*keys, "_b", "_island", "_first", ((F.col("_f") == 1) & (F.col("_l") == 1)).alias("_pair"))
    joined = rows.join(walked, [*keys, "_b"], "left")
    again = (F.col("_at") > F.col("_first")) & (F.abs(F.col("_first.actual_worth") - F.col("actual_worth")) / F.col("_first.actual_worth") <= rules.price_tolerance)
    few = joined.filter(F.col("_island").isNull() | F.col("_pair")).withColumn("is_repeat", F.coalesce(F.col("_pair") & ~F.col("is_first") & again, F.lit(False)))
    # An unambiguous text key of the island: lengths keep ('a','bc') and ('ab','c') apart.
    text = F.concat_ws("|", *[F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)) for k in keys], F.col("_island").cast("string"))
    columns = [c for c in few.columns if c not in (*keys, "_b", "_island", "_at", "_first", "_pair")]
    queue = joined.filter(~F.col("_pair")).withColumn("island_key", text).select("island_key", *[c for c in columns if c != "is_repeat"])
    ordered = queue.repartition("island_key").sortWithinPartitions("island_key", *order, "procedure_name", "area_name", "meter_sale_price")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + ", is_repeat boolean"
    tolerance = rules.price_tolerance
    marked = ordered.mapInPandas(lambda it: _walk_islands(it, tolerance), schema)
    columns = [c for c in columns if c not in number]
    return few.select(*columns).unionByName(marked.select(*columns))


def _psm_ok(rules: PanelRules) -> Column:
    c, ok = F.col("meter_sale_price"), F.col("meter_sale_price").isNotNull()
    if rules.psm_min is not None:
        ok = ok & (c >= rules.psm_min)
    if rules.psm_max is not None:
        ok = ok & (c <= rules.psm_max)
    if rules.psm_below is not None:
        ok = ok & (c < rules.psm_below)
    return ok


def _price(rows: DataFrame, group: list[str], value: Column, rules: PanelRules) -> DataFrame:
    """Median or mean price per sqm of the accepted prices, as the panel defines it."""
    if rules.statistic == "median":
        return order_statistics(rows, group, {"v": value}, {"price_per_sqm": Pick("v")})
    return rows.groupBy(*group).agg((total(value, 2) / F.nullif(F.count(value), F.lit(0))).alias("price_per_sqm"))


def first_sales_panel(marked: DataFrame, rules: PanelRules, from_quarter: str) -> DataFrame:
    """Per quarter and entity: first sales and their value, split by procedure, repeats dropped, price, projects."""
    group = ["quarter", "entity_id"]
    rows = marked.filter(F.col("instance_date") >= day(quarter_start(from_quarter))).withColumn("quarter", quarter_label("instance_date"))
    kept, first, worth = ~F.col("is_repeat"), F.col("is_first"), F.col("actual_worth")
    base = rows.groupBy(*group).agg(
        count_where(kept).alias("first_sale_units"), F.coalesce(total(F.when(kept, worth)), F.lit(0.0)).alias("first_sale_value"),
        count_where(kept & first).alias("offplan_units"), F.coalesce(total(F.when(kept & first, worth)), F.lit(0.0)).alias("offplan_value"),
        count_where(kept & ~first).alias("delayed_units"), F.coalesce(total(F.when(kept & ~first, worth)), F.lit(0.0)).alias("delayed_value"),
        count_where(~kept).alias("repeats_dropped"), F.coalesce(total(F.when(~kept, worth)), F.lit(0.0)).alias("repeat_value"),
    )
    projects = rows.filter(kept).groupBy(*group, "project_number").agg(F.lit(1).alias("_p")).groupBy(*group).agg(F.count(F.lit(1)).alias("active_projects"))
    price = _price(rows, group, F.when(kept & _psm_ok(rules), F.col("meter_sale_price")), rules)
    return base.join(projects, group, "left").join(price, group, "left").select(
        *base.columns, F.coalesce("active_projects", F.lit(0)).alias("active_projects"), half_up("price_per_sqm", 4).alias("price_per_sqm"))


def registrations_panel(tx: DataFrame, entities: DataFrame, rules: PanelRules, from_quarter: str, as_of: str) -> DataFrame:
    """Per quarter and entity: registrations and values, off-plan, ready and all, with price and projects."""
    group = ["quarter", "entity_id"]
    rows = tx.filter(between_days("instance_date", quarter_start(from_quarter), as_of))
    if rules.groups is not None:
        rows = rows.filter(F.col("trans_group").isin(*rules.groups))
    rows = rows.join(entities.select("project_number", "entity_id"), "project_number").withColumn("quarter", quarter_label("instance_date"))
    off, ready, worth = is_off_plan(), is_ready(), F.col("actual_worth")
    # Projects are counted by collapsing to one row per project, which any number of tasks can do.
    by_project = rows.groupBy(*group, "project_number").agg(
        count_where(off).alias("o"), total(F.when(off, worth)).alias("ov"), count_where(ready).alias("r"), total(F.when(ready, worth)).alias("rv"),
        F.count(F.lit(1)).alias("n"), total(worth).alias("v"))
    base = by_project.groupBy(*group).agg(
        F.sum("o").alias("offplan_count"), F.coalesce(total("ov"), F.lit(0.0)).alias("offplan_value"), F.sum("r").alias("ready_count"),
        F.coalesce(total("rv"), F.lit(0.0)).alias("ready_value"), F.sum("n").alias("total_count"), total("v").alias("total_value"),
        F.count(F.lit(1)).alias("active_projects"))
    price = _price(rows, group, F.when(_psm_ok(rules), F.col("meter_sale_price")), rules)
    return base.join(price, group, "left").withColumn("price_per_sqm", half_up("price_per_sqm", 4))


def orphan_share(tx: DataFrame, project: DataFrame, rules: PanelRules, from_quarter: str, as_of: str) -> DataFrame:
    """Share of each quarter's registrations under a project number the register does not hold."""
    rows = tx.filter(between_days("instance_date", quarter_start(from_quarter), as_of))
    if rules.groups is not None:
        rows = rows.filter(F.col("trans_group").isin(*rules.groups))
    counts = rows.groupBy(quarter_label("instance_date").alias("quarter"), "project_number").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(project.select("project_number", F.lit(True).alias("_held")), "project_number", "left")
    orphan = F.col("_held").isNull() & (F.coalesce("project_number", F.lit("")) != "")
    return known.groupBy("quarter").agg(
        F.sum("n").alias("registrations"), F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphans")
    ).withColumn("orphan_share", half_up(F.col("orphans") / F.col("registrations"), 6))


def panel_maturity(orphans: DataFrame, rules: PanelRules, as_of: str) -> DataFrame:
    """Quarters still filling in (recent, or with orphans inside the look-back) and old ones with a gap."""
    q = F.col("quarter")
    age = quarter_index(day(as_of)) - (F.substring(q, 1, 4).cast("int") * 4 + F.substring(q, 6, 1).cast("int") - 1)
    recent = age < rules.trailing_quarters
    over = (F.col("orphans") / F.col("registrations")) > rules.max_orphan_share
    gap = over & (age >= rules.orphan_lookback)
    late = over & (age < rules.orphan_lookback)
    return orphans.select(
        "quarter", "orphan_share", F.when(recent | late, F.lit("provisional")).otherwise(F.lit("mature")).alias("maturity"),
        F.concat_ws(",", F.when(recent, F.lit("recent")), F.when(late, F.lit("orphans"))).alias("reasons"), gap.alias("attribution_gap"))


def unscoped_projects(config: DataFrame, entities: DataFrame, project: DataFrame, tx: DataFrame, from_quarter: str, groups: Sequence[str] | None = ("Sales",)) -> DataFrame:
    """Other projects, with registrations, of developers only some of whose projects are in scope."""
    partial = config.filter(F.size(F.coalesce("project_numbers", F.array().cast("array<string>"))) > 0).select("developer_number").distinct()
    rows = tx.filter(F.col("instance_date") >= day(quarter_start(from_quarter)))
    if groups is not None:
        rows = rows.filter(F.col("trans_group").isin(*groups))
    counts = rows.groupBy("project_number").agg(F.count(F.lit(1)).alias("registrations"))
    return project.select("project_number", "project_name", "developer_number").join(partial, "developer_number", "left_semi").join(
        entities.select("project_number"), "project_number", "left_anti").join(counts, "project_number")


# Lag from a project's start to a first-sale registration, in days.
LAG_BUCKETS = (
    ("under_3_months", -10_000, 90), ("3_to_6_months", 90, 180), ("6_to_12_months", 180, 365), ("12_to_18_months", 365, 548), ("over_18_months", 548, 1e9),
)


def registration_lag(tx: DataFrame, project: DataFrame, developer_number: str | None, from_quarter: str, rules: PanelRules = PanelRules()) -> DataFrame:
    """First-sale value by quarter and by how long after the project's start it registered; undated apart."""
    home = F.col("property_type").isin(*rules.home_types) | ((F.col("property_type") == "Land") & (F.col("procedure_area") <= rules.land_max_sqm))
    rows = tx.filter((F.col("instance_date") >= day(quarter_start(from_quarter))) & F.col("procedure_name").isin(*rules.procedures) & home)
    owned = project if developer_number is None else project.filter(F.col("developer_number") == developer_number)
    dated = rows.join(owned.select("project_number", "developer_number", "project_start_date"), "project_number")
    days = F.datediff("instance_date", "project_start_date").cast("double")
    bucket = F.coalesce(bucketize(days, LAG_BUCKETS), F.lit("no_start_date"))
    return dated.groupBy("developer_number", quarter_label("instance_date").alias("quarter"), bucket.alias("lag_bucket")).agg(
        F.count(F.lit(1)).alias("registrations"), total("actual_worth").alias("first_sale_value"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerances: dict[str, float], exact: Sequence[str] = ()) -> DataFrame:
    """Row-by-row comparison of two keyed tables: missing, extra, mismatched columns or identical."""
    cols = [*tolerances, *exact]
    a = left.select(*keys, F.lit(True).alias("_l"), *[F.col(c).alias(f"l_{c}") for c in cols])
    b = right.select(*keys, F.lit(True).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in cols])
    off = []
    for c, tol in tolerances.items():
        near = F.coalesce(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= F.lit(tol) * F.greatest(F.lit(1.0), F.abs(f"l_{c}")), F.lit(False))
        off.append(F.when(~(near | (F.col(f"l_{c}").isNull() & F.col(f"r_{c}").isNull())), F.lit(c)))
    off += [F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in exact]
    joined = a.join(b, list(keys), "full_outer")
    wrong = F.concat_ws(",", *off)
    outcome = F.when(F.col("_r").isNull(), F.lit("missing")).when(F.col("_l").isNull(), F.lit("extra")).when(wrong != "", F.lit("mismatch")).otherwise(F.lit("match"))
    return joined.select(*keys, outcome.alias("outcome"), F.when(outcome == "mismatch", wrong).alias("columns"))
