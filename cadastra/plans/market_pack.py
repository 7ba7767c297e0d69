"""The market pack of an edition: every section over the same three windows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.numbers import between_days
from cadastra.functions.predicates import DEFAULT_LIMITS, MORTGAGES, SALES, Limits
from cadastra.operators import market, readings, resale
from cadastra.session import materialize
from cadastra.sources import writers


def market_pack(
    tx: DataFrame, rents: DataFrame, project: DataFrame, developer: DataFrame, obs: DataFrame, pairs: DataFrame,
    kind: str, periods: dict[str, market.Period], limits: Limits = DEFAULT_LIMITS, unit: float = 1e9, bands=market.PRICE_BANDS,
) -> dict[str, DataFrame]:
    """Section name to its table. All sections read ``tx`` cut to the span the pack looks at."""
    cur, yoy = periods["cur"], periods["yoy"]
    month, year = market.last_full_month(cur[1]), int(cur[1][:4])
    pack = {
        "headline": market.headline(market.sales_stats(tx, periods, limits, unit), market.rent_stats(rents, periods, limits)),
        "monthly": market.monthly_series(tx, rents, month, 36 if kind == "yearly" else 24, limits, unit),
        "yearly": market.yearly_series(tx, cur[1], limits=limits, unit=unit),
        "ytd": market.across_years(tx, "01-01", cur[1][5:], year, limits=limits, unit=unit),
        "bands": market.price_bands(tx, cur, yoy, bands, unit),
        "deals": market.biggest_deals(tx, project, cur),
        "areas": market.area_league(tx, cur, yoy, limits=limits, unit=unit),
        "developers": market.developer_league(tx, project, developer, cur, yoy, unit=unit),
        "projects": market.project_league(tx, project, cur),
        "yields": market.yield_map(tx, rents, cur[1], limits=limits),
        "resales": resale.resale_stats(pairs, cur),
        "rent_areas": market.rent_areas(rents, cur, yoy, limits=limits),
    }
    if kind != "weekly":
        pack["same_slice"] = market.across_years(tx, cur[0][5:], cur[1][5:], year, limits=limits, unit=unit)
    live = materialize(readings.live_pipeline(obs, project, developer, cur[1]), "pack-live")  # six sections read it
    pack.update({
        "pipeline_totals": readings.pipeline_totals(live), "pipeline_years": readings.pipeline_by(live, "bucket"),
        "pipeline_areas": readings.pipeline_by(live, "area_name", 15), "pipeline_developers": readings.pipeline_by(live, "developer_name", 12),
        "behind": readings.pipeline_list(live, "behind"), "past_due": readings.pipeline_list(live, "past_due"),
    })
    return pack


def shared_sales(tx: DataFrame, since: str, until: str) -> DataFrame:
    """Sales and mortgages of the pack's span, written once to the shared folder for all its sections."""
    span = tx.filter(F.col("trans_group").isin(SALES, MORTGAGES) & between_days("instance_date", since, until))
    return materialize(span, "pack-sales")


def shared_rents(rents: DataFrame, since: str, until: str) -> DataFrame:
    """Rents that start in the pack's span, written once to the shared folder for all its sections."""
    return materialize(rents.filter(between_days("contract_start_date", since, until)), "pack-rents")


@dataclass(frozen=True)
class Register:
    """The tables an edition is made from and the thresholds of their currency."""

    tx: DataFrame
    rents: DataFrame
    project: DataFrame
    developer: DataFrame
    obs: DataFrame
    pairs: DataFrame
    limits: Limits = DEFAULT_LIMITS
    unit: float = 1e9
    bands: tuple = market.PRICE_BANDS


def write_edition(register: Register, path: str, kind: str, key: str, as_of: str, since: str | None = None, force: bool = False) -> bool:
    """Make and store one edition; nothing is computed for one that is held, unless forced.

    A weekly edition is named by its last day and goes back to ``since``; a yearly one of the year of ``as_of`` ends there.
    """
    if not force and (kind, key) in writers.held_editions(register.tx.sparkSession, path):
        return False
    to_date = as_of if kind == "yearly" and key == as_of[:4] else None
    periods = market.edition_periods(kind, key, since=since, ytd_to=to_date)
    pack = market_pack(
        register.tx, register.rents, register.project, register.developer, register.obs, register.pairs, kind, periods, register.limits, register.unit, register.bands)
    return writers.write_sections(pack, path, kind, key, force=True)


def backfill(register: Register, path: str, as_of: str, months: int = 6, years: int = 2, force: bool = False) -> list[tuple[str, str]]:
    """The monthly editions of the last months and the yearly ones of the last years that are not held, and the year so far."""
    wanted = [("monthly", market.shift_month(as_of[:7], -k), force) for k in range(months, 0, -1)]
    wanted += [("yearly", str(int(as_of[:4]) - k), force) for k in range(years, 0, -1)]
    wanted.append(("yearly", as_of[:4], True))
    return [(kind, key) for kind, key, again in wanted if write_edition(register, path, kind, key, as_of, force=again)]


def write_due(register: Register, path: str, as_of: str, first_since: str, force: bool = False, settle_days: int = 3) -> list[tuple[str, str]]:
    """What a run of ``as_of`` owes: the week's edition once seven days have passed, with the year so far beside it,
    last month's once the month is some days old, last year's if it is missing."""
    held = writers.held_editions(register.tx.sparkSession, path)
    weeks = sorted(key for kind, key in held if kind == "weekly" and key < as_of)
    wanted = []
    if force or writers.weekly_due(held, as_of):
        wanted += [("weekly", as_of, weeks[-1] if weeks else first_since, force), ("yearly", as_of[:4], None, True)]
    if dt.date.fromisoformat(as_of).day >= settle_days:
        wanted.append(("monthly", market.shift_month(as_of[:7], -1), None, False))
    wanted.append(("yearly", str(int(as_of[:4]) - 1), None, False))
    return [(kind, key) for kind, key, since, again in wanted if write_edition(register, path, kind, key, as_of, since, again)]
