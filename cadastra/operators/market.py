"""Market statistics over date windows: sales, rents, series, leagues, bands, yields."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.numbers import (
    between_days, count_where, day, days_before, half_up, month_label, month_start, pct_change, settle, share, total,
)
from cadastra.functions.predicates import (
    DEFAULT_LIMITS, MORTGAGES, SALES, Limits, is_new_rent, is_off_plan, is_ready, is_renewal, is_sale, is_unit,
    is_villa, psm_ok, rent_ok, rent_psm_ok,
)
from cadastra.functions.text import area_slug
from cadastra.operators.quantiles import Pick, with_order_statistics

Period = tuple[str, str]
ROOM_TYPES = ("Studio", "1 B/R", "2 B/R", "3 B/R", "4 B/R")


def tag_periods(df: DataFrame, date_col: str, periods: Mapping[str, Period]) -> DataFrame:
    """Rows repeated once per period they fall in, with its label; other rows are dropped.

    The overall window is filtered first so that it reaches the scan.
    """
    first = min(p[0] for p in periods.values())
    last = max(p[1] for p in periods.values())
    labels = F.array(*[F.when(between_days(date_col, a, b), F.lit(k)) for k, (a, b) in periods.items()])
    return df.filter(between_days(date_col, first, last)).withColumn("period", F.explode(F.array_compact(labels)))


def month_spine(df: DataFrame, to_month: str, months: int) -> DataFrame:
    """``months`` month starts ending with ``to_month`` ('YYYY-MM')."""
    last = day(f"{to_month}-01")
    return df.sparkSession.range(1).select(
        F.explode(F.sequence(F.add_months(last, -(months - 1)), last, F.expr("interval 1 month"))).alias("month")
    )


def sales_stats(
    tx: DataFrame, periods: Mapping[str, Period], limits: Limits = DEFAULT_LIMITS, unit: float = 1e9
) -> DataFrame:
    """Counts, values, mix, luxury, mortgages and six medians per period, in one pass."""
    tagged = tag_periods(tx.filter(F.col("trans_group").isin(SALES, MORTGAGES)), "instance_date", periods)
    sale, off, ready, apt, villa = is_sale(), is_off_plan(), is_ready(), is_unit(), is_villa()
    lux = sale & (F.col("actual_worth") >= limits.luxury)
    worth = F.col("actual_worth")
    base = tagged.groupBy("period").agg(
        count_where(sale).alias("n"),
        half_up(total(F.when(sale, worth)) / unit, 2).alias("value"),
        total(F.when(sale, worth)).alias("_worth"),
        count_where(sale & off).alias("off"),
        count_where(sale & ready).alias("ready"),
        count_where(sale & apt).alias("units"),
        count_where(sale & villa).alias("villas"),
        count_where(sale & (F.col("property_type") == "Land")).alias("land"),
        count_where(sale & (F.col("property_type") == "Building")).alias("buildings"),
        count_where(sale & (F.col("property_usage") == "Residential")).alias("_residential"),
        count_where(lux).alias("lux"),
        half_up(total(F.when(lux, worth).otherwise(F.lit(0.0))) / unit, 2).alias("lux_value"),
        count_where(~sale).alias("mortgages"),
        half_up(total(F.when(~sale, worth)) / unit, 2).alias("mortgage_value"),
    )
    psm = F.when(sale & psm_ok(limits), F.col("meter_sale_price"))
    measures = {
        "all": psm,
        "unit": F.when(apt, psm),
        "villa": F.when(villa, psm),
        "unit_off": F.when(apt & off, psm),
        "unit_ready": F.when(apt & ready, psm),
        "price": F.when(sale & (worth > 0), worth),
    }
    out = with_order_statistics(base, tagged, ["period"], measures, {f"_{m}": Pick(m) for m in measures})
    n = F.col("n")
    return out.select(
        "period", "n", "value", "off", "ready", "units", "villas", "land", "buildings", "lux", "lux_value",
        "mortgages", "mortgage_value",
        share("off", n).alias("offplan_pct"),
        share("_residential", n).alias("residential_pct"),
        share("lux", n, 1).alias("lux_pct"),
        share("mortgages", n).alias("mortgage_pct"),
        settle("_all").alias("med_psm"),
        settle("_unit").alias("med_psm_unit"),
        settle("_villa").alias("med_psm_villa"),
        settle("_unit_off").alias("med_psm_unit_off"),
        settle("_unit_ready").alias("med_psm_unit_ready"),
        pct_change("_unit_off", "_unit_ready").alias("off_ready_spread"),
        settle("_price").alias("med_price"),
        half_up(F.col("_worth") / F.nullif(n, F.lit(0))).alias("avg_ticket"),
    )


def rent_stats(rents: DataFrame, periods: Mapping[str, Period], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Contracts, new share and median rents per period; levels are quoted for flats and villas only."""
    tagged = tag_periods(rents.filter(rent_ok(limits)), "contract_start_date", periods)
    home = F.col("rent_property_type").isin("Flat", "Villa")
    amount, new = F.col("annual_amount"), is_new_rent()
    per_sqm = amount / F.nullif(F.col("actual_area"), F.lit(0.0))
    rooms = {f"rooms_{i}": (new & home & (F.col("rooms") == r)) for i, r in enumerate(ROOM_TYPES)}
    base = tagged.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(new).alias("_new"),
        *[count_where(c).alias(f"n_{k}") for k, c in rooms.items()],
    )
    measures = {
        "median_all": F.when(home, amount),
        "median_new": F.when(home & new, amount),
        "median_renew": F.when(home & is_renewal(), amount),
        "median_psm_new": F.when(home & new & rent_psm_ok(limits), per_sqm),
        **{f"median_{k}": F.when(c, amount) for k, c in rooms.items()},
    }
    out = with_order_statistics(base, tagged, ["period"], measures, {m: Pick(m) for m in measures})
    return out.select(
        "period", "n", share("_new", "n").alias("new_pct"),
        *[settle(m).alias(m) for m in measures], *[f"n_{k}" for k in rooms],
    )


# The rows of the headline table; points rows compare by difference.
HEADLINE_SALES = (
    "n", "value", "avg_ticket", "med_price", "med_psm_unit", "med_psm_villa", "offplan_pct", "off_ready_spread",
    "lux", "lux_value", "mortgages", "mortgage_pct",
)
HEADLINE_RENT = ("n", "new_pct", "median_new", "median_renew")
POINT_METRICS = ("offplan_pct", "off_ready_spread", "mortgage_pct", "new_pct")


def headline(sales: DataFrame, rents: DataFrame) -> DataFrame:
    """Sixteen measures compared across the periods labelled cur, prev and yoy."""

    def long(stats: DataFrame, source: str, metrics: tuple[str, ...]) -> DataFrame:
        cast = stats.select("period", *[F.col(m).cast("double").alias(m) for m in metrics])
        return cast.unpivot(["period"], list(metrics), "metric", "v").withColumn("source", F.lit(source))

    rows = long(sales, "sales", HEADLINE_SALES).unionByName(long(rents, "rent", HEADLINE_RENT))
    wide = rows.groupBy("source", "metric").pivot("period", ["cur", "prev", "yoy"]).agg(F.max("v"))
    points = F.col("metric").isin(*POINT_METRICS)

    def versus(other: str) -> Column:
        return F.when(points, half_up(F.col("cur") - F.col(other), 1)).otherwise(pct_change("cur", other))

    return wide.select(
        "source", "metric", "cur", "prev", "yoy", versus("prev").alias("mom_change"), versus("yoy").alias("yoy_change")
    )


def monthly_series(
    tx: DataFrame, rents: DataFrame, to_month: str, months: int, limits: Limits = DEFAULT_LIMITS, unit: float = 1e9
) -> DataFrame:
    """Monthly count, value, off-plan count and share, median price per sqm and rents; gaps filled."""
    spine = month_spine(tx, to_month, months)
    last = day(f"{to_month}-01")
    start, end = F.add_months(last, -(months - 1)), F.last_day(last)
    sales = tx.filter(is_sale() & F.col("instance_date").between(start, end)).withColumn(
        "month", month_start("instance_date")
    )
    base = sales.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), total("actual_worth").alias("_worth"), count_where(is_off_plan()).alias("off")
    )
    psm = F.when(psm_ok(limits), F.col("meter_sale_price"))
    measures = {"unit": F.when(is_unit(), psm), "villa": F.when(is_villa(), psm)}
    stats = with_order_statistics(base, sales, ["month"], measures, {"_unit": Pick("unit"), "_villa": Pick("villa")})
    leases = (
        rents.filter(F.col("contract_start_date").between(start, end))
        .groupBy(month_start("contract_start_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("rents"))
    )
    return (
        spine.join(stats, "month", "left")
        .join(leases, "month", "left")
        .select(
            month_label("month").alias("month"),
            F.coalesce("n", F.lit(0)).alias("n"),
            half_up(F.coalesce("_worth", F.lit(0.0)) / unit, 2).alias("value"),
            F.coalesce("off", F.lit(0)).alias("off"),
            share("off", "n").alias("offplan_pct"),
            settle("_unit").alias("psm_unit"),
            settle("_villa").alias("psm_villa"),
            F.coalesce("rents", F.lit(0)).alias("rents"),
        )
    )


def yearly_series(
    tx: DataFrame, to_date: str, from_year: int = 2008, limits: Limits = DEFAULT_LIMITS, unit: float = 1e9
) -> DataFrame:
    """Calendar years up to ``to_date``; the last is flagged when it is not whole."""
    sales = tx.filter(is_sale() & between_days("instance_date", f"{from_year}-01-01", to_date)).withColumn(
        "year", F.year("instance_date")
    )
    base = sales.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        half_up(total("actual_worth") / unit, 2).alias("value"),
        count_where(is_off_plan()).alias("off"),
    )
    psm = F.when(psm_ok(limits), F.col("meter_sale_price"))
    measures = {"unit": F.when(is_unit(), psm), "villa": F.when(is_villa(), psm)}
    picks = {"psm_unit": Pick("unit"), "psm_villa": Pick("villa")}
    out = with_order_statistics(base, sales, ["year"], measures, picks)
    part = F.lit(not to_date.endswith("-12-31")) & (F.col("year") == int(to_date[:4]))
    return out.select(
        "year", "n", "value", "off", settle("psm_unit").alias("psm_unit"), settle("psm_villa").alias("psm_villa"),
        part.alias("ytd"),
    )


def across_years(
    tx: DataFrame, mmdd_from: str, mmdd_to: str, to_year: int, years: int = 7,
    limits: Limits = DEFAULT_LIMITS, unit: float = 1e9,
) -> DataFrame:
    """The same calendar slice in each of the last ``years`` years with changes on the year before."""
    periods = {str(y): (f"{y}-{mmdd_from}", f"{y}-{mmdd_to}") for y in range(to_year - years + 1, to_year + 1)}
    stats = sales_stats(tx, periods, limits, unit)
    # One row per year: the window over the whole result is a handful of rows.
    by_year = Window.orderBy("year")
    prior = lambda c: F.lag(c).over(by_year)
    return stats.withColumn("year", F.col("period").cast("int")).select(
        "year", "n", "value", "med_psm_unit", "med_psm_villa", "offplan_pct", "lux",
        pct_change("n", prior("n")).alias("n_yoy"),
        pct_change("value", prior("value")).alias("value_yoy"),
        pct_change("med_psm_unit", prior("med_psm_unit")).alias("psm_yoy"),
    )


# Price bands in AED.
PRICE_BANDS = (
    ("Under AED 1m", 0.0, 1e6), ("AED 1–2m", 1e6, 2e6), ("AED 2–5m", 2e6, 5e6),
    ("AED 5–10m", 5e6, 10e6), ("AED 10–20m", 10e6, 20e6), ("AED 20m and above", 20e6, 1e15),
)


def bucketize(c: Column, edges) -> Column:
    """Label of the half-open interval [lo, hi) that holds the value, as a ``when`` chain."""
    out = None
    for label, lo, hi in edges:
        hit = (c >= F.lit(float(lo))) & (c < F.lit(float(hi)))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def bucket_table(df: DataFrame, edges) -> DataFrame:
    """The labels in order, so that empty intervals stay in the result."""
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(e[0]).alias("bucket")) for i, e in enumerate(edges)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("e")).select("e.pos", "e.bucket")


def price_bands(tx: DataFrame, cur: Period, yoy: Period, bands=PRICE_BANDS, unit: float = 1e9) -> DataFrame:
    """Sales by price band with share of all sales and count change on the year before."""
    tagged = tag_periods(tx.filter(is_sale()), "instance_date", {"cur": cur, "yoy": yoy})
    now, then = F.col("period") == "cur", F.col("period") == "yoy"
    grouped = tagged.groupBy(bucketize(F.col("actual_worth"), bands).alias("bucket")).agg(
        count_where(now).alias("n"), count_where(then).alias("n_yoy"),
        total(F.when(now, F.col("actual_worth"))).alias("worth"),
    )
    grouped = grouped.withColumn("_all", F.sum("n").over(Window.partitionBy()))
    return (
        bucket_table(tx, bands)
        .join(grouped, "bucket", "left")
        .select(
            F.col("bucket").alias("band"), "pos", F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce(share("n", "_all", 1), F.lit(0.0)).alias("share"),
            half_up(F.col("worth") / unit, 2).alias("value"), pct_change("n", "n_yoy").alias("n_change"),
        )
    )


def biggest_deals(tx: DataFrame, project: DataFrame, period: Period, top: int = 12) -> DataFrame:
    """The largest single sales of the window other than land, with their project page."""
    order = [F.desc("actual_worth"), "instance_date", "project_number", "procedure_area", "area_name", "procedure_name"]
    # Everything is settled on the ``top`` rows before the project is looked up.
    deals = (
        tx.filter(is_sale() & between_days("instance_date", *period) & (F.col("property_type") != "Land"))
        .select(
            "instance_date", "area_name", "project_name", "building_name", "property_type", "property_sub_type", "rooms",
            "procedure_area", "actual_worth", "meter_sale_price", "reg_type", "project_number", "procedure_name",
        )
        .orderBy(*order)
        .limit(top)
    )
    page = project.select("project_number", "slug", "area_slug")
    return deals.join(page, "project_number", "left").select(
        "instance_date", "area_name", "project_name", "building_name", "property_type", "property_sub_type", "rooms",
        half_up("procedure_area").alias("sqm"), half_up("actual_worth").alias("worth"),
        half_up("meter_sale_price").alias("psm"), "reg_type",
        F.when(F.col("slug").isNotNull(), F.concat_ws("/", "area_slug", "slug")).alias("page"),
    )


def area_league(
    tx: DataFrame, cur: Period, yoy: Period, top: int = 20, limits: Limits = DEFAULT_LIMITS, unit: float = 1e9
) -> DataFrame:
    """Areas by sales with share, off-plan share, median price and changes on the year before."""
    tagged = tag_periods(tx.filter(is_sale()), "instance_date", {"cur": cur, "yoy": yoy})
    now, then = F.col("period") == "cur", F.col("period") == "yoy"
    base = tagged.groupBy("area_name").agg(
        count_where(now).alias("n"), count_where(then).alias("_n_yoy"),
        total(F.when(now, F.col("actual_worth"))).alias("_worth"), count_where(now & is_off_plan()).alias("_off"),
    )
    psm = F.when(psm_ok(limits) & is_unit(), F.col("meter_sale_price"))
    out = with_order_statistics(
        base, tagged, ["area_name"], {"cur": F.when(now, psm), "yoy": F.when(then, psm)},
        {"_med": Pick("cur"), "_med_yoy": Pick("yoy")},
    )
    return (
        out.withColumn("_all", F.sum("n").over(Window.partitionBy()))
        .filter(F.col("n") > 0)
        .select(
            "area_name", area_slug("area_name").alias("slug"), "n", share("n", "_all", 1).alias("share"),
            half_up(F.col("_worth") / unit, 2).alias("value"), share("_off", "n").alias("offplan_pct"),
            settle("_med").alias("med_psm"), pct_change("_med", "_med_yoy").alias("psm_yoy"),
            pct_change("n", "_n_yoy").alias("n_yoy"),
        )
        .orderBy(F.desc("n"), "area_name")
        .limit(top)
    )


def developer_league(
    tx: DataFrame, project: DataFrame, developer: DataFrame, cur: Period, yoy: Period, top: int = 15, unit: float = 1e9
) -> DataFrame:
    """Developers by sales, with shares of linked and of all sales and the concentration of the first five.

    Sales are collapsed to one row per project before either join, so the joins carry projects, not sales.
    """
    tagged = tag_periods(tx.filter(is_sale()), "instance_date", {"cur": cur, "yoy": yoy})
    now, then = F.col("period") == "cur", F.col("period") == "yoy"
    by_project = tagged.groupBy("project_number").agg(
        count_where(now).alias("n"), count_where(then).alias("n_yoy"),
        total(F.when(now, F.col("actual_worth"))).alias("worth"),
    )
    linked = by_project.join(project.select("project_number", "developer_number"), "project_number", "left").join(
        developer, "developer_number", "left"
    )
    known = F.col("developer_name").isNotNull()
    grouped = linked.groupBy(
        F.when(known, F.col("developer_number")).alias("developer_number"), "developer_name", "developer_slug"
    ).agg(
        F.sum("n").alias("n"), F.sum("n_yoy").alias("_n_yoy"), total("worth").alias("_worth"),
        count_where(F.col("n") > 0).alias("projects"),
    )
    totals = grouped.agg(
        F.struct(F.sum("n").alias("every"), F.sum(F.when(F.col("developer_number").isNotNull(), F.col("n"))).alias("linked"))).scalar()
    # The first few are taken partition by partition; ranks and the first five's sum are over those few rows alone.
    first = grouped.filter(F.col("developer_number").isNotNull()).orderBy(F.desc("n"), "developer_number").limit(max(top, 5))
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "developer_number")))
    ranked = ranked.withColumn("_five", F.sum(F.when(F.col("rank") <= 5, F.col("n"))).over(Window.partitionBy())).withColumn("_t", totals)
    return (
        ranked.withColumns({"all_sales": F.col("_t.every"), "linked_sales": F.col("_t.linked")})
        .filter((F.col("n") > 0) & (F.col("rank") <= top))
        .select(
            "developer_number", "developer_name", "developer_slug", "rank", "n", "projects",
            half_up(F.col("_worth") / unit, 2).alias("value"),
            share("n", "linked_sales", 1).alias("share_linked"), share("n", "all_sales", 1).alias("share_all"),
            pct_change("n", "_n_yoy").alias("n_yoy"), share("linked_sales", "all_sales").alias("linked_pct"),
            "linked_sales", "all_sales", share("_five", "all_sales", 1).alias("top5_share"),
            share("_five", "linked_sales", 1).alias("top5_share_linked"),
        )
    )


def project_league(tx: DataFrame, project: DataFrame, cur: Period, top: int = 15, unit: float = 1e6) -> DataFrame:
    """Projects by sales with their page and the sales as a share of registered units."""
    sales = tx.filter(is_sale() & between_days("instance_date", *cur) & F.col("project_number").isNotNull())
    ranked = (
        sales.groupBy("project_number")
        .agg(
            F.count(F.lit(1)).alias("n"), total("actual_worth").alias("_worth"), count_where(is_off_plan()).alias("_off"),
            F.min("project_name").alias("_feed_name"), F.min("area_name").alias("sales_area"),
        )
        .orderBy(F.desc("n"), "project_number")
        .limit(top)
    )
    register = project.select("project_number", F.col("project_name").alias("_name"), "slug", "area_slug", "units")
    return ranked.join(register, "project_number", "left").select(
        "project_number", F.coalesce("_name", "_feed_name").alias("project_name"), "sales_area", "n",
        half_up(F.col("_worth") / unit, 2).alias("value"), share("_off", "n").alias("offplan_pct"), "units",
        share("n", "units", 1).alias("sold_pct_of_units"),
        F.when(F.col("slug").isNotNull(), F.concat_ws("/", "area_slug", "slug")).alias("page"),
    )


def yield_map(
    tx: DataFrame, rents: DataFrame, as_of: str, top: int = 15, bottom: int = 8, min_rents: int = 100,
    min_sales: int = 30, limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Gross yields by area: median new rent per sqm over median ready price per sqm, trailing year."""
    since, until = days_before(as_of, 365), day(as_of)
    leases = rents.filter(
        F.col("contract_start_date").between(since, until) & is_new_rent() & (F.col("rent_property_type") == "Flat")
    )
    rent_psm = F.when(rent_ok(limits) & rent_psm_ok(limits), F.col("annual_amount") / F.nullif(F.col("actual_area"), F.lit(0.0)))
    rent_side = with_order_statistics(
        leases.groupBy("area_name").agg(F.count(F.lit(1)).alias("rents")), leases, ["area_name"],
        {"v": rent_psm}, {"_rent": Pick("v")},
    ).filter((F.col("rents") >= min_rents) & F.col("_rent").isNotNull())
    sales = tx.filter(is_sale() & is_ready() & is_unit() & F.col("instance_date").between(since, until))
    sale_side = with_order_statistics(
        sales.groupBy("area_name").agg(F.count(F.lit(1)).alias("sales")), sales, ["area_name"],
        {"v": F.when(psm_ok(limits), F.col("meter_sale_price"))}, {"_sale": Pick("v")},
    ).filter((F.col("sales") >= min_sales) & (F.col("_sale") > 0))
    areas = rent_side.join(sale_side, "area_name").select(
        "area_name", settle("_rent").alias("rent_psm"), settle("_sale").alias("sale_psm"),
        share(half_up("_rent", 4), half_up("_sale", 4), 1).alias("yield_pct"), "rents", "sales",
    )
    best = Window.orderBy(F.desc("yield_pct"), "area_name")
    worst = Window.orderBy("yield_pct", F.desc("area_name"))
    return (
        areas.withColumn("top_rank", F.row_number().over(best))
        .withColumn("bottom_rank", F.row_number().over(worst))
        .filter((F.col("top_rank") <= top) | (F.col("bottom_rank") <= bottom))
    )


def rent_areas(rents: DataFrame, cur: Period, yoy: Period, top: int = 15, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Areas by contracts with median new and renewal rents, year-on-year and the spread between them."""
    homes = rents.filter(rent_ok(limits) & F.col("rent_property_type").isin("Flat", "Villa"))
    tagged = tag_periods(homes, "contract_start_date", {"cur": cur, "yoy": yoy})
    now, then, amount = F.col("period") == "cur", F.col("period") == "yoy", F.col("annual_amount")
    base = tagged.groupBy("area_name").agg(count_where(now).alias("n"), count_where(now & is_new_rent()).alias("_new"))
    measures = {
        "new": F.when(now & is_new_rent(), amount), "new_yoy": F.when(then & is_new_rent(), amount),
        "renew": F.when(now & is_renewal(), amount),
    }
    out = with_order_statistics(base, tagged, ["area_name"], measures, {f"_m_{m}": Pick(m) for m in measures})
    return (
        out.withColumn("_all", F.sum("n").over(Window.partitionBy()))
        .filter(F.col("n") > 0)
        .select(
            "area_name", area_slug("area_name").alias("slug"), "n", share("n", "_all", 1).alias("share"),
            share("_new", "n").alias("new_pct"), settle("_m_new").alias("median_new"),
            settle("_m_renew").alias("median_renew"), pct_change("_m_new", "_m_new_yoy").alias("new_yoy"),
            pct_change("_m_new", "_m_renew").alias("spread"),
        )
        .orderBy(F.desc("n"), "area_name")
        .limit(top)
    )


def month_end(ym: str) -> str:
    first = dt.date.fromisoformat(f"{ym}-01")
    return ((first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)).isoformat()


def shift_month(ym: str, n: int) -> str:
    y, m = int(ym[:4]), int(ym[5:7]) - 1 + n
    return f"{y + m // 12}-{m % 12 + 1:02d}"


def last_full_month(to: str) -> str:
    """A month still filling in would read as a false dip."""
    return to[:7] if to == month_end(to[:7]) else shift_month(to[:7], -1)


def edition_periods(kind: str, key: str, since: str | None = None, ytd_to: str | None = None) -> dict[str, Period]:
    """The three windows (cur, prev, yoy) of a weekly, monthly or yearly edition."""
    add = lambda d, n: (dt.date.fromisoformat(d) + dt.timedelta(days=n)).isoformat()
    if kind == "monthly":
        months = (key, shift_month(key, -1), shift_month(key, -12))
        return {k: (f"{m}-01", month_end(m)) for k, m in zip(("cur", "prev", "yoy"), months)}
    if kind == "yearly":
        tail = ytd_to[4:] if ytd_to else "-12-31"
        return {k: (f"{int(key) - i}-01-01", f"{int(key) - i}{tail}") for i, k in enumerate(("cur", "prev", "yoy"))}
    if kind == "weekly":
        length = (dt.date.fromisoformat(key) - dt.date.fromisoformat(since)).days
        cur = (add(since, 1), key)
        return {"cur": cur, "prev": (add(since, 1 - length), since), "yoy": (add(cur[0], -365), add(key, -365))}
    raise ValueError(kind)
