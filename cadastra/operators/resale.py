"""Resales of the same home: pairs, outcomes and the repeat-sales index."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.numbers import between_days, count_where, day, days_before, half_up, quarter_index, settle, share
from cadastra.functions.predicates import OFF_PLAN, PRE_REGISTRATION, READY, SELL, is_sale, re_registration
from cadastra.functions.text import blank_to_null
from cadastra.operators.grouping import groups_of_size
from cadastra.operators.quantiles import Pick, beside, order_statistics


@dataclass(frozen=True)
class PairRules:
    """What makes two sales a resale of one home."""

    procedures: tuple[str, ...] = (SELL, PRE_REGISTRATION)
    property_types: tuple[str, ...] = ("Unit", "Villa")
    min_area: float = 10.0
    min_worth: float = 150_000.0
    since: str = "2010-01-01"
    max_group: int = 12
    min_days: int = 30
    min_change: float = -0.6
    max_change: float = 3.0
    home: tuple[str, ...] = ("area", "building", "type", "rooms", "size")


def resale_pairs(tx: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """Consecutive sales of one home; ``ambiguity`` counts the other sales sharing its identity."""
    building = blank_to_null("building_name")
    parts = {
        "area": F.coalesce("area_name", F.lit("")),
        "project": F.col("project_number"),
        "building": F.coalesce(building, F.concat(F.lit("project:"), F.coalesce("project_number", F.lit("")))),
        "type": F.col("property_type"),
        "rooms": F.col("rooms"),
        "size": F.col("procedure_area"),
    }
    keys = [f"_k_{p}" for p in rules.home]
    sales = tx.filter(
        is_sale() & F.col("procedure_name").isin(*rules.procedures) & F.col("property_type").isin(*rules.property_types)
        & (F.col("procedure_area") > rules.min_area) & (F.col("actual_worth") > rules.min_worth)
        & (F.col("instance_date") >= day(rules.since)) & F.col("rooms").isNotNull() & (F.col("rooms") != "")
        & (building.isNotNull() | F.col("project_number").isNotNull())
    ).select(
        *[parts[p].alias(k) for p, k in zip(rules.home, keys)],
        "project_number", "area_name", "building_name", "rooms", "procedure_area", "property_type",
        "instance_date", "actual_worth", "reg_type", "procedure_name",
    )
    homes = groups_of_size(sales, keys, 2, rules.max_group)
    in_order = Window.partitionBy(*keys).orderBy(
        "instance_date", "actual_worth", "procedure_name", "reg_type", "project_number", "area_name"
    )
    leg = F.struct("project_number", "area_name", "building_name", "instance_date", "actual_worth", "reg_type", "procedure_name")
    paired = homes.withColumn("_a", F.lag(leg).over(in_order)).filter(F.col("_a").isNotNull())
    out = paired.select(
        F.coalesce("_a.project_number", "project_number").alias("project_number"),
        F.col("_a.area_name").alias("area_name"), F.col("_a.building_name").alias("building_name"), "rooms",
        "procedure_area", F.col("_a.instance_date").alias("bought_on"), F.col("_a.actual_worth").alias("bought_for"),
        F.col("_a.reg_type").alias("bought_reg"), F.col("instance_date").alias("sold_on"),
        F.col("actual_worth").alias("sold_for"), F.col("reg_type").alias("sold_reg"),
        F.datediff("instance_date", "_a.instance_date").alias("hold_days"),
        (F.col("actual_worth") / F.col("_a.actual_worth") - 1).alias("change_pct"),
        (F.col("group_size") - 2).cast("int").alias("ambiguity"), "property_type",
        F.col("_a.procedure_name").alias("bought_proc"), F.col("procedure_name").alias("sold_proc"),
    )
    return out.filter(
        (F.col("hold_days") >= rules.min_days) & F.col("change_pct").between(rules.min_change, rules.max_change)
    )


def resale_stats(pairs: DataFrame, period: tuple[str, str]) -> DataFrame:
    """Resales completed in a window: all, and those bought off-plan, with quartiles and loss share."""
    rows = pairs.filter(between_days("sold_on", *period) & (F.col("ambiguity") == 0))
    rereg = re_registration(F.col("change_pct"), F.col("hold_days"))
    labels = F.array_compact(F.array(
        F.when(rereg, F.lit("reregistration")), F.when(~rereg, F.lit("all")),
        F.when(~rereg & F.col("bought_reg").ilike("%off%"), F.lit("offplan_bought")),
        F.when(~rereg & (F.col("hold_days") < 365), F.lit("quick_flip")),
    ))
    tagged = rows.withColumn("cohort", F.explode(labels))
    base = tagged.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), count_where(F.col("change_pct") < 0).alias("losses"))
    change, hold = F.col("change_pct") * 100, F.col("hold_days") / F.lit(30.44)
    picks = {
        "gain": Pick("change"), "hold": Pick("hold"), "q1": Pick("change", "nearest", 0.25), "q3": Pick("change", "nearest", 0.75),
    }
    stats = order_statistics(tagged, ["cohort"], {"change": change, "hold": hold}, picks)
    return base.join(stats, "cohort").select(
        "cohort", "n", settle("gain", 1).alias("median_gain_pct"), share("losses", "n").alias("loss_pct"),
        settle("hold", 1).alias("median_hold_months"), settle("q1", 1).alias("q1"), settle("q3", 1).alias("q3"),
    )


def resale_losses(pairs: DataFrame, as_of: str, by_area: bool = False, min_pairs: int = 50) -> DataFrame:
    """Share of the trailing year's resales that lost money, for the city or by area."""
    rows = pairs.filter(F.col("sold_on") >= days_before(as_of, 365))
    aggs = [
        F.count(F.lit(1)).alias("n"), count_where(F.col("change_pct") < 0).alias("losses"),
        half_up(half_up(F.sum("change_pct"), 6) / F.count(F.lit(1)) * 100, 1).alias("avg_pct"), F.max("sold_on").alias("latest"),
    ]
    out = rows.groupBy("area_name").agg(*aggs).filter(F.col("n") >= min_pairs) if by_area else rows.agg(*aggs)
    return out.withColumn("loss_pct", share("losses", "n"))


def recent_losses(pairs: DataFrame, project: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """The newest losing resales of identities that are all but unambiguous."""
    rows = pairs.filter(
        (F.col("sold_on") >= days_before(as_of, 365)) & (F.col("change_pct") < 0) & (F.col("ambiguity") <= 1)
    )
    # Kept to projects the register holds before the limit, as the list is of linked projects.
    held = rows.join(project.select("project_number", "project_name", "area_slug", "slug"), "project_number")
    return held.orderBy(
        F.desc("sold_on"), "change_pct", "project_number", "bought_on", "sold_for", "procedure_area"
    ).limit(limit).select(
        "project_number", "project_name", F.concat_ws("/", "area_slug", "slug").alias("page"), "area_name", "rooms",
        "procedure_area", "bought_on", "bought_for", "sold_on", "sold_for", "hold_days", half_up("change_pct", 6).alias("change_pct"),
    )


def held_gains(pairs: DataFrame, as_of: str, by_area: bool = False, min_pairs: int = 20) -> DataFrame:
    """What off-plan buyers made on resale over two years; nothing where too few resold."""
    rows = pairs.filter(
        (F.col("bought_reg") == OFF_PLAN) & (F.col("ambiguity") <= 1) & (F.col("sold_on") >= days_before(as_of, 730))
        & (F.col("hold_days") >= 90)
    )
    keys = ["area_name"] if by_area else ["scope"]
    rows = rows.withColumn("scope", F.lit("city"))
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count_where(F.col("change_pct") < 0).alias("losses"))
    picks = {k: Pick("change", "floor", p) for k, p in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))}
    picks["hold"] = Pick("hold", "floor", 0.5)
    measures = {"change": F.col("change_pct"), "hold": F.col("hold_days")}
    out = beside(base, order_statistics(rows, keys, measures, picks), keys).filter(F.col("n") >= min_pairs)
    return out.select(
        *keys, "n", "losses", half_up("median", 6).alias("median"), half_up("q1", 6).alias("q1"),
        half_up("q3", 6).alias("q3"), half_up(F.col("hold") / F.lit(30.4)).alias("hold_months"),
    )


@dataclass(frozen=True)
class IndexRules:
    """Which pairs the index is fitted on and which series are published."""

    base_year: int = 2012
    min_hold_days: int = 180
    min_price: float = 50_000.0
    max_log_move: float = 1.6
    min_area_pairs: int = 400
    min_pairs: int = 500
    thin: int = 15


def index_cells(pairs: DataFrame, rules: IndexRules = IndexRules()) -> DataFrame:
    """The normal equations of every series, summed to one row per (series, bought, sold) quarter.

    This is all the heavy work: a series has at most quarters squared cells, however many pairs.
    """
    usable = pairs.filter(
        (F.col("bought_proc") == SELL) & (F.col("sold_proc") == SELL) & (F.col("bought_for") > rules.min_price)
        & (F.col("sold_for") > rules.min_price) & (F.col("hold_days") >= rules.min_hold_days)
        & (F.col("bought_on") >= day(f"{rules.base_year}-01-01")) & F.col("sold_on").isNotNull()
    )
    apt = F.col("property_type") == "Unit"
    registered = apt & F.coalesce(F.col("project_number") != "", F.lit(False))
    area = F.nullif(F.col("area_name"), F.lit(""))
    labels = F.array_compact(F.array(
        F.lit("market"), F.when(apt, F.lit("apartments")), F.when(F.col("property_type") == "Villa", F.lit("villas")),
        F.when(registered, F.lit("registered_apartments")),
        F.when(area.isNotNull(), F.concat(F.lit("area:"), area)),
        F.when(registered & area.isNotNull(), F.concat(F.lit("area_apartments:"), area)),
    ))
    log_move = F.log(F.col("sold_for") / F.col("bought_for"))
    used = (F.col("i") != F.col("j")) & (F.abs("y") <= rules.max_log_move)
    return (
        usable.select(labels.alias("_s"), quarter_index("bought_on").alias("i"), quarter_index("sold_on").alias("j"), log_move.alias("y"))
        .select(F.explode("_s").alias("series"), "i", "j", "y")
        .groupBy("series", "i", "j")
        .agg(F.count(F.lit(1)).alias("pairs"), count_where(used).alias("used"), F.coalesce(F.sum(F.when(used, F.col("y"))), F.lit(0.0)).alias("log_sum"))
    )


RIDGE = 1e-6
_SOLVED = "series string, period int, index double, pairs_sold bigint, pairs_touching bigint, pairs bigint, used bigint"


def fit_index(i: np.ndarray, j: np.ndarray, used: np.ndarray, log_sum: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log index per period (first pinned at zero), with pairs sold in and touching each period."""
    normal, rhs = np.zeros((n, n)), np.zeros(n)
    np.add.at(normal, (j, j), used)
    np.add.at(normal, (i, i), used)
    np.add.at(normal, (i, j), -used)
    np.add.at(normal, (j, i), -used)
    np.add.at(rhs, j, log_sum)
    np.add.at(rhs, i, -log_sum)
    normal[0], rhs[0] = 0.0, 0.0
    normal[0, 0] = 1.0
    normal[np.diag_indices(n)] += RIDGE
    sold, touching = np.bincount(j, used, n), np.bincount(i, used, n) + np.bincount(j, used, n)
    return np.linalg.solve(normal, rhs), sold, touching


def _solve_series(cells: pd.DataFrame) -> pd.DataFrame:
    lo, n = int(cells["lo"].iloc[0]), int(cells["hi"].iloc[0] - cells["lo"].iloc[0]) + 1
    i, j = (cells["i"] - lo).to_numpy(int), (cells["j"] - lo).to_numpy(int)
    beta, sold, touching = fit_index(i, j, cells["used"].to_numpy(float), cells["log_sum"].to_numpy(float), n)
    return pd.DataFrame({
        "series": cells["series"].iloc[0], "period": np.arange(lo, lo + n),
        "index": np.floor(100 * np.exp(beta) * 10 + 0.5) / 10, "pairs_sold": sold.astype("int64"),
        "pairs_touching": touching.astype("int64"), "pairs": int(cells["pairs"].sum()), "used": int(cells["used"].sum()),
    })


def solve_cells(cells: DataFrame, rules: IndexRules = IndexRules()) -> DataFrame:
    """Publishable series solved from their cells, every series over the market's whole span.

    One group is at most quarters squared small rows.
    """
    is_market = F.col("series") == "market"
    span = cells.agg(
        F.min(F.least("i", "j")).alias("lo"), F.max(F.greatest("i", "j")).alias("hi"), F.sum(F.when(is_market, F.col("pairs"))).alias("n")
    )
    sizes = cells.groupBy("series").agg(F.sum("pairs").alias("_size"))
    enough = ~F.col("series").startswith("area") | (F.col("_size") >= rules.min_area_pairs)
    ready = (
        cells.join(sizes.filter(enough), "series", "left_semi")
        .filter(span.select("n").scalar() >= rules.min_pairs)
        .withColumn("lo", span.select("lo").scalar())
        .withColumn("hi", span.select("hi").scalar())
    )
    return ready.groupBy("series").applyInPandas(_solve_series, _SOLVED)


def publish_index(solved: DataFrame, rules: IndexRules = IndexRules()) -> DataFrame:
    """Solved series with quarter labels and the flag for quarters on few pairs."""
    q = F.col("period")
    return solved.select(
        "series", F.concat(F.floor(q / 4).cast("string"), F.lit("Q"), (q % 4 + 1).cast("string")).alias("quarter"),
        "index", "pairs_sold", "pairs_touching", (F.col("pairs_touching") < rules.thin).alias("thin"), "pairs", "used",
    )


def repeat_sales_index(pairs: DataFrame, rules: IndexRules = IndexRules()) -> DataFrame:
    """The Bailey-Muth-Nourse index: 100 in the first quarter, per series and quarter.

    The cells are read several times by the solve; a caller with many pairs writes
    ``index_cells`` out first and solves from the stored cells.
    """
    return publish_index(solve_cells(index_cells(pairs, rules), rules), rules)


def index_headline(index: DataFrame) -> DataFrame:
    """Latest, peak and trough of each series with the distances to them."""
    out = index.groupBy("series").agg(
        F.max_by(F.struct("quarter", "index"), "quarter").alias("latest"), F.max("index").alias("peak"), F.min("index").alias("trough"),
        F.min(F.struct((-F.col("index")).alias("x"), "quarter")).alias("_p"), F.min(F.struct("index", "quarter")).alias("_t"),
    )
    now = F.col("latest.index")
    return out.select(
        "series", F.col("latest.quarter").alias("latest_quarter"), now.alias("latest"), F.col("_p.quarter").alias("peak_quarter"),
        "peak", F.col("_t.quarter").alias("trough_quarter"), "trough",
        half_up((now / F.col("peak") - 1) * 100, 1).alias("from_peak_pct"),
        half_up((now / F.col("trough") - 1) * 100, 1).alias("from_trough_pct"),
    )


def sensitivity_rules() -> Mapping[str, Column]:
    """Nine cumulative rule sets over pairs; the last is applied to pairs keyed by area."""
    c = F.col
    sell = (c("bought_proc") == SELL) & (c("sold_proc") == SELL)
    units, n = c("property_type") == "Unit", c("ambiguity") + 2
    annual = F.pow(1 + c("change_pct"), F.lit(365.0) / F.greatest(c("hold_days"), F.lit(1))) - 1
    calm = (annual > -0.6) & (annual < 0.6)
    later = F.year("sold_on") > F.year("bought_on")
    ready = (c("bought_reg") == READY) & (c("sold_reg") == READY)
    few = sell & (c("hold_days") >= 90) & (n <= 4)
    return {
        "A_ready_legs": units & ready & (c("hold_days") >= 180),
        "B_sell_legs": units & sell & (c("hold_days") >= 180),
        "C_hold_90": units & sell & (c("hold_days") >= 90),
        "D_four_sales": units & few,
        "E_trim": units & few & calm,
        "F_villas_in": few & calm,
        "G_different_years": few & calm & later,
        "H_villas_only": few & calm & (c("property_type") == "Villa"),
        "I_area_key": few & calm & later,
    }


def variant_cells(by_project: DataFrame, by_area: DataFrame, base_year: int = 2012) -> DataFrame:
    """Annual normal-equation cells of every rule set, in one pass over each pair table."""
    rules = dict(sensitivity_rules())
    last = rules.pop("I_area_key")

    def tagged(pairs: DataFrame, wanted: Mapping[str, Column]) -> DataFrame:
        labels = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in wanted.items()]))
        return pairs.filter(F.year("bought_on") >= base_year).select(
            F.explode(labels).alias("series"), F.year("bought_on").alias("i"), F.year("sold_on").alias("j"),
            F.log(F.col("sold_for") / F.col("bought_for")).alias("y"),
        )

    rows = tagged(by_project, rules).unionByName(tagged(by_area, {"I_area_key": last}))
    return rows.groupBy("series", "i", "j").agg(F.count(F.lit(1)).alias("used"), F.sum("y").alias("log_sum"))


def _solve_variant(cells: pd.DataFrame) -> pd.DataFrame:
    years = np.unique(np.concatenate([cells["i"], cells["j"]]))
    i, j = np.searchsorted(years, cells["i"]), np.searchsorted(years, cells["j"])
    beta, _, _ = fit_index(i, j, cells["used"].to_numpy(float), cells["log_sum"].to_numpy(float), len(years))
    return pd.DataFrame({
        "series": cells["series"].iloc[0], "year": years, "index": np.round(100 * np.exp(beta), 1), "pairs": int(cells["used"].sum()),
    })


def index_variants(by_project: DataFrame, by_area: DataFrame, base_year: int = 2012) -> DataFrame:
    """How the annual index moves as one rule after another is changed."""
    cells = variant_cells(by_project, by_area, base_year)
    return cells.groupBy("series").applyInPandas(_solve_variant, "series string, year int, index double, pairs bigint")
