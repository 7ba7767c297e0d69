"""Area and project pages computed for every key at once: directory, statistics, rooms, rents, peers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.numbers import (
    between_days, count_where, day, days_before, half_up, mean, month_start, pct_change, ratio, settle, share, total,
)
from cadastra.functions.predicates import (
    DEFAULT_LIMITS, Limits, home_rent, is_off_plan, is_ready, is_sale, is_unit, rent_area_ok, rooms_classified, rooms_stated,
)
from cadastra.functions.text import area_slug, rooms_or_default
from cadastra.operators.quantiles import Pick, order_statistics
from cadastra.operators.readings import latest_as_of

YEAR = 365


def area_directory(project: DataFrame, tx: DataFrame) -> DataFrame:
    """Areas known from projects or from sales, one row per page address."""
    held = project.groupBy("area_slug").agg(F.min("area_name").alias("area_name"), F.count(F.lit(1)).alias("projects"))
    sold = tx.filter(F.col("area_name").isNotNull()).select("area_name").distinct().select(
        area_slug("area_name").alias("area_slug"), "area_name", F.lit(0).cast("bigint").alias("projects")
    )
    return held.unionByName(sold).groupBy("area_slug").agg(
        F.min("area_name").alias("area_name"), F.sum("projects").alias("projects")
    )


def area_stats(tx: DataFrame, project: DataFrame, drops: DataFrame, as_of: str, unit: float = 1e9) -> DataFrame:
    """Counts, value, off-plan share, recent price against the year before, and drops, per area.

    One grouped pass over sales in place of a lookup per area and measure.
    """
    d, worth, psm = F.col("instance_date"), F.col("actual_worth"), F.col("meter_sale_price")
    year = d >= days_before(as_of, YEAR)
    before = d.between(days_before(as_of, 2 * YEAR), days_before(as_of, YEAR))
    priced = is_unit() & (psm > 0)
    recent, then = d >= days_before(as_of, 90), d.between(days_before(as_of, 455), days_before(as_of, 365))
    sales = tx.filter(is_sale() & (d >= days_before(as_of, 2 * YEAR))).groupBy("area_name").agg(
        count_where(year).alias("tx_12m"), count_where(before).alias("tx_prev_12m"),
        half_up(total(F.when(year, worth)) / unit, 2).alias("value"), count_where(year & is_off_plan()).alias("_off"),
        mean(F.when(priced & recent & rooms_stated(), psm)).alias("psm_90"), count_where(priced & recent).alias("n_90"),
        count_where(priced & then).alias("n_ly"), mean(F.when(priced & then, psm)).alias("psm_ly"),
    )
    cut = drops.groupBy("area_name").agg(
        F.count(F.lit(1)).alias("drops"), half_up(F.max("cumulative_pct") * 100, 1).alias("max_drop")
    )
    base = area_directory(project, tx)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return base.join(sales, "area_name", "left").join(cut, "area_name", "left").select(
        "area_name", "area_slug", "projects", zero("tx_12m"), zero("tx_prev_12m"), "value",
        share("_off", "tx_12m").alias("offplan_pct"), "psm_90", zero("n_90"), zero("n_ly"), "psm_ly", zero("drops"), "max_drop",
    )


def movers(stats: DataFrame, n: int = 4, busiest: int = 6, min_sales: int = 30) -> DataFrame:
    """Areas whose recent price rose and fell most on the year before, and the busiest ones."""
    solid = (F.col("n_90") >= min_sales) & (F.col("n_ly") >= min_sales) & (F.col("psm_90") > 0) & (F.col("psm_ly") > 0)
    rows = stats.withColumn("yoy", F.when(solid, half_up((F.col("psm_90") / F.col("psm_ly") - 1) * 100, 1)))
    pick = lambda df, label, order, k: df.orderBy(*order, "area_name").limit(k).select(
        F.lit(label).alias("list"), "area_name", "yoy", "tx_12m", "psm_90")
    moved = rows.filter(F.col("yoy").isNotNull())
    return pick(moved, "up", [F.desc("yoy")], n).unionByName(pick(moved, "down", [F.asc("yoy")], n)).unionByName(
        pick(rows, "busiest", [F.desc("tx_12m")], busiest))


def area_projects_by_sales(tx: DataFrame, project: DataFrame, as_of: str, top: int = 40) -> DataFrame:
    """The most traded projects of every area over the trailing year."""
    sold = tx.filter(
        is_sale() & (F.col("instance_date") >= days_before(as_of, YEAR)) & F.col("project_name").isNotNull()
        & (F.col("project_name") != "") & (F.col("meter_sale_price") > 0)
    ).groupBy("area_name", "project_name").agg(
        F.count(F.lit(1)).alias("n"), count_where(is_off_plan()).alias("offplan"), mean("meter_sale_price").alias("psm"),
        mean("actual_worth").alias("price"), F.max("instance_date").alias("last"), F.min("project_number").alias("project_number"),
    )
    ranked = Window.partitionBy("area_name").orderBy(F.desc("n"), "project_name")
    return (
        sold.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
        .join(project.select("project_number", "slug"), "project_number", "left").drop("project_number")
    )


def project_cards(project: DataFrame, developer: DataFrame, obs: DataFrame, tx: DataFrame, drops: DataFrame, as_of: str) -> DataFrame:
    """Card of every project: developer, latest reading, drops and recent price."""
    psm = tx.filter((F.col("instance_date") >= days_before(as_of, 90)) & (F.col("meter_sale_price") > 0)).groupBy("project_number").agg(
        mean("meter_sale_price").alias("psm_90"))
    cuts = drops.groupBy("project_number").agg(F.count(F.lit(1)).alias("drops"))
    return (
        project.select("project_number", "project_name", "area_slug", "slug", "units", "developer_number")
        .join(developer.select("developer_number", "developer_name"), "developer_number", "left")
        .join(latest_as_of(obs, as_of).select("project_number", "status", "percent_completed", "completion_date"), "project_number", "left")
        .join(cuts, "project_number", "left").join(psm, "project_number", "left")
        .withColumn("drops", F.coalesce("drops", F.lit(0)))
    )


def sold_by_rooms(tx: DataFrame, as_of: str) -> DataFrame:
    """Recorded sales per project and rooms over the trailing year: number, price per sqm, price, last date."""
    return tx.filter(
        is_sale() & (F.col("meter_sale_price") > 0) & F.col("property_type").isin("Unit", "Villa") & (F.col("instance_date") >= days_before(as_of, YEAR))
    ).groupBy("project_number", rooms_or_default("rooms").alias("rooms")).agg(
        F.count(F.lit(1)).alias("n"), mean("meter_sale_price").alias("psm"), mean("actual_worth").alias("price"),
        F.max("instance_date").alias("last"),
    )


def project_by_rooms(tx: DataFrame, rents: DataFrame, asking: DataFrame, as_of: str) -> DataFrame:
    """Recorded prices, rents and asking prices per project and rooms, with the spread and gross yield."""
    since = days_before(as_of, YEAR)
    sold = sold_by_rooms(tx, as_of)
    let = rents.filter(
        F.col("rent_property_type").isin("Flat", "Villa") & (F.col("annual_amount") > 5_000) & (F.col("contract_start_date") >= since)
    ).groupBy("project_number", "rooms").agg(F.count(F.lit(1)).alias("rent_n"), mean("annual_amount").alias("rent"))
    asked = asking.groupBy("project_number", "rooms").agg(
        F.count(F.lit(1)).alias("asking_n"), mean("asking_price").alias("asking"),
        half_up(half_up(F.sum(ratio("asking_price", "area_sqm")), 4) / F.nullif(F.count(ratio("asking_price", "area_sqm")), F.lit(0))).alias("asking_psm"),
    )
    out = sold.join(let, ["project_number", "rooms"], "left").join(asked, ["project_number", "rooms"], "left")
    return out.select(
        "project_number", "rooms", "n", "psm", "price", "last", F.coalesce("rent_n", F.lit(0)).alias("rent_n"), "rent",
        F.coalesce("asking_n", F.lit(0)).alias("asking_n"), "asking", "asking_psm",
        pct_change("asking_psm", "psm").alias("asking_spread"), share("rent", "price", 1).alias("gross_yield"),
    )


def project_aggregates(tx: DataFrame, as_of: str) -> DataFrame:
    """Ready and off-plan price levels and counts per project over the trailing year."""
    rows = tx.filter(
        is_sale() & (F.col("project_number") != "") & F.col("property_type").isin("Unit", "Villa")
        & (F.col("meter_sale_price") > 0) & (F.col("instance_date") >= days_before(as_of, YEAR))
    )
    return rows.groupBy("project_number").agg(
        F.count(F.lit(1)).alias("n"), mean(F.when(is_ready(), F.col("meter_sale_price"))).alias("ready_psm"),
        count_where(is_ready()).alias("ready_n"), mean(F.when(is_off_plan(), F.col("meter_sale_price"))).alias("off_psm"),
        count_where(is_off_plan()).alias("off_n"),
    )


def project_rooms(tx: DataFrame, as_of: str) -> DataFrame:
    """Average price by rooms per project over the trailing year, classified rooms only."""
    rows = tx.filter(
        is_sale() & (F.col("project_number") != "") & F.col("property_type").isin("Unit", "Villa") & (F.col("meter_sale_price") > 0)
        & (F.col("actual_worth") > 0) & rooms_classified() & (F.col("instance_date") >= days_before(as_of, YEAR))
    )
    return rows.groupBy("project_number", "rooms").agg(F.count(F.lit(1)).alias("n"), mean("actual_worth").alias("price"))


# ---- peers ----

LEVELS = ("community", "all_phases", "area")


def peer_sets(project: DataFrame, agg: DataFrame, min_sales: int = 5, enough: int = 3, top: int = 10) -> DataFrame:
    """The most active like-for-like projects of each project, widened only when too few.

    Same community, then its sibling phases, then the registry area; a wider set is taken only
    when it is larger. A project's peers are the same as its group's, bar itself, so ranking is
    done once per group (bounded lists of ``top`` + 1 leaders) and each project reads its group's
    list; no pair of projects is ever formed beyond those lists.
    """
    master = F.trim(F.coalesce("master_project", F.lit("")))
    base = F.trim(F.substring_index(master, " - ", 1))
    groups = project.select(
        "project_number",
        F.nullif(master, F.lit("")).alias("community"),
        F.when(master.contains(" - "), base).alias("all_phases"),
        F.col("area_name").alias("area"),
        # A phase named exactly like its base belongs to the base's phases as a peer.
        F.nullif(base, F.lit("")).alias("phase_member"),
    )
    active = groups.join(agg.filter(F.col("n") >= min_sales).select("project_number", "n"), "project_number")
    member_of = {"community": "community", "all_phases": "phase_member", "area": "area"}
    members = active.select(
        "project_number", "n",
        F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.col(member_of[lv]).alias("grp")) for lv in LEVELS])).alias("g"),
    ).select("project_number", "n", "g.level", "g.grp").filter(F.col("grp").isNotNull())
    sizes = members.groupBy("level", "grp").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("level", "grp").orderBy(F.desc("n"), "project_number")
    leaders = members.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= top + 1)
    lists = leaders.groupBy("level", "grp").agg(F.array_sort(F.collect_list(F.struct("_rn", "project_number", "n"))).alias("leaders"))
    asked = groups.join(agg.select("project_number", (F.col("n") >= min_sales).alias("is_active")), "project_number", "left").select(
        "project_number", F.coalesce("is_active", F.lit(False)).alias("is_active"), "phase_member",
        F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(lv).alias("level"), F.col(lv).alias("grp")) for i, lv in enumerate(LEVELS)])).alias("g"),
    ).select("project_number", "is_active", "g.pos", "g.level", "g.grp")
    counted = asked.join(sizes, ["level", "grp"], "left").withColumn(
        "others", F.coalesce(F.col("size"), F.lit(0)) - F.when(F.col("is_active") & F.col("grp").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    )
    per_project = counted.groupBy("project_number").agg(
        *[F.max(F.when(F.col("level") == lv, F.col("others"))).alias(f"_n_{lv}") for lv in LEVELS],
        *[F.max(F.when(F.col("level") == lv, F.col("grp"))).alias(f"_g_{lv}") for lv in LEVELS],
    )
    c, p, a = (F.col(f"_n_{lv}") for lv in LEVELS)
    widened = (c < enough) & F.col("_g_all_phases").isNotNull() & (p > c)
    second = F.when(widened, p).otherwise(c)
    to_area = (second < enough) & (a > second)
    level = F.when(to_area, F.lit("area")).when(widened, F.lit("all_phases")).otherwise(F.lit("community"))
    chosen = per_project.withColumn("level", level).select(
        F.col("project_number").alias("subject"), "level",
        F.when(level == "area", F.col("_g_area")).when(level == "all_phases", F.col("_g_all_phases")).otherwise(F.col("_g_community")).alias("grp"),
    )
    expanded = chosen.join(lists, ["level", "grp"]).select(
        "subject", "level", "grp",
        F.explode(F.slice(F.filter("leaders", lambda x: x["project_number"] != F.col("subject")), 1, top)).alias("l"),
    )
    return expanded.select("subject", "level", "grp", F.col("l.project_number").alias("peer"), F.col("l.n").alias("n"))


# Display order of room types.
ROOM_ORDER = ("Studio", "1 B/R", "2 B/R", "3 B/R", "4 B/R", "5 B/R", "6 B/R", "7 B/R", "PENTHOUSE")


def room_columns(peers: DataFrame, rooms: DataFrame, n: int = 3) -> DataFrame:
    """The most traded room types over a project and its peers, in display order."""
    everyone = peers.select("subject", F.col("peer").alias("project_number")).unionByName(
        peers.select("subject", F.col("subject").alias("project_number")).distinct()
    )
    tally = everyone.join(rooms, "project_number").groupBy("subject", "rooms").agg(F.sum("n").alias("n"))
    busiest = Window.partitionBy("subject").orderBy(F.desc("n"), "rooms")
    place = F.array_position(F.array(*[F.lit(r) for r in ROOM_ORDER]), F.col("rooms"))
    kept = tally.withColumn("_rn", F.row_number().over(busiest)).filter(F.col("_rn") <= n)
    return kept.select("subject", "rooms", "n", F.row_number().over(Window.partitionBy("subject").orderBy(place, "rooms")).alias("position"))


def peer_verdict(project: DataFrame, peers: DataFrame, agg: DataFrame, min_sales: int = 5, min_peers: int = 3) -> DataFrame:
    """Whether a project trades in line with its peers: ready sales first, else off-plan."""
    peer_agg = agg.select(F.col("project_number").alias("peer"), "ready_psm", "ready_n", "off_psm", "off_n")
    sides = peers.join(peer_agg, "peer").groupBy(F.col("subject").alias("project_number")).agg(
        *[half_up(F.sum(F.when(F.col(f"{k}_n") >= min_sales, F.col(f"{k}_psm"))), 2).alias(f"_{k}_sum") for k in ("ready", "off")],
        *[F.count(F.when(F.col(f"{k}_n") >= min_sales, F.col(f"{k}_psm"))).alias(f"_{k}_peers") for k in ("ready", "off")],
    )
    own = agg.select("project_number", *[F.when(F.col(f"{k}_n") >= min_sales, F.col(f"{k}_psm")).alias(f"_{k}_own") for k in ("ready", "off")])
    rows = project.select("project_number").join(own, "project_number", "left").join(sides, "project_number", "left")
    fits = {k: (F.col(f"_{k}_own") > 0) & (F.col(f"_{k}_peers") >= min_peers) for k in ("ready", "off")}
    pick = lambda c: F.when(fits["ready"], F.col(f"_ready_{c}")).when(fits["off"], F.col(f"_off_{c}"))
    mine, average = pick("own"), pick("sum") / pick("peers")
    gap = mine / average - 1
    return rows.select(
        "project_number", F.when(fits["ready"], F.lit("ready")).when(fits["off"], F.lit("off-plan")).alias("basis"),
        mine.alias("own_psm"), half_up(average, 1).alias("peer_psm"), pick("peers").alias("peers"), half_up(gap * 100, 1).alias("gap_pct"),
        F.when(mine.isNull(), F.lit("too few")).when(F.abs(gap) < 0.03, F.lit("in line")).when(gap > 0, F.lit("above")).otherwise(F.lit("below")).alias("verdict"),
    )


def price_vs_area(by_rooms: DataFrame, project: DataFrame, area: DataFrame) -> DataFrame:
    """Sales-weighted project price against its area's recent price; within 2 % is in line."""
    classified = ~F.col("rooms").isin("Unclassified", "NA")
    weighted = by_rooms.filter(classified).groupBy("project_number").agg(
        F.sum("n").alias("n"), (half_up(F.sum(F.col("psm") * F.col("n")), 2) / F.sum("n")).alias("_w")
    )
    rows = weighted.join(project.select("project_number", "area_name"), "project_number").join(area.select("area_name", "psm_90"), "area_name", "left")
    gap = F.col("_w") / F.col("psm_90") - 1
    return rows.select(
        "project_number", "area_name", "n", half_up("_w", 1).alias("psm"), "psm_90", half_up(gap * 100, 1).alias("gap_pct"),
        F.when(gap.isNull(), F.lit(None)).when(F.abs(gap) < 0.02, F.lit("in line")).when(gap > 0, F.lit("above")).otherwise(F.lit("below")).alias("verdict"),
    )


# ---- rents ----

def rent_summary(rents: DataFrame, as_of: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    new, renew = F.col("contract_reg_type") == "New", F.col("contract_reg_type") == "Renew"
    return rents.filter(home_rent(limits) & (F.col("contract_start_date") >= days_before(as_of, YEAR))).agg(
        F.count(F.lit(1)).alias("n"), count_where(new).alias("n_new"), mean(F.when(new, F.col("annual_amount"))).alias("rent_new"),
        mean(F.when(renew, F.col("annual_amount"))).alias("rent_renew"), F.max("contract_start_date").alias("latest"),
    )


def rent_area_table(rents: DataFrame, tx: DataFrame, as_of: str, min_contracts: int = 200, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Rents by area: new and renewal averages, per sqm against last year, sale price, yield and spread."""
    d = F.col("contract_start_date")
    now, then = d >= days_before(as_of, YEAR), d.between(days_before(as_of, 2 * YEAR), days_before(as_of, YEAR))
    new, renew = F.col("contract_reg_type") == "New", F.col("contract_reg_type") == "Renew"
    sized = new & rent_area_ok(limits)
    per_sqm = ratio("annual_amount", "actual_area")
    avg4 = lambda c: half_up(half_up(F.sum(c), 4) / F.nullif(F.count(c), F.lit(0)))
    rows = rents.filter(home_rent(limits) & (d >= days_before(as_of, 2 * YEAR))).groupBy("area_name").agg(
        count_where(now).alias("n"), count_where(now & new).alias("n_new"),
        mean(F.when(now & new, F.col("annual_amount"))).alias("rent_new"), mean(F.when(now & renew, F.col("annual_amount"))).alias("rent_renew"),
        avg4(F.when(now & sized, per_sqm)).alias("rent_psm"), count_where(then & sized).alias("n_ly"), avg4(F.when(then & sized, per_sqm)).alias("rent_psm_ly"),
    ).filter(F.col("n") >= min_contracts)
    sale = tx.filter(
        is_sale() & is_unit() & (F.col("meter_sale_price") > 0) & rooms_stated() & (F.col("instance_date") >= days_before(as_of, YEAR))
    ).groupBy("area_name").agg(mean("meter_sale_price").alias("sale_psm"))
    return rows.join(sale, "area_name", "left").select(
        "*", area_slug("area_name").alias("slug"), pct_change("rent_psm", "rent_psm_ly").alias("rent_yoy"),
        share("rent_psm", "sale_psm", 1).alias("gross_yield"), pct_change("rent_new", "rent_renew").alias("spread"),
    )


def rent_area_rooms(rents: DataFrame, as_of: str, min_contracts: int = 20, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Rents by area and rooms with last year's new-rent average."""
    d = F.col("contract_start_date")
    now, then = d >= days_before(as_of, YEAR), d.between(days_before(as_of, 2 * YEAR), days_before(as_of, YEAR))
    new, renew = F.col("contract_reg_type") == "New", F.col("contract_reg_type") == "Renew"
    per_sqm = F.when(now & rent_area_ok(limits), ratio("annual_amount", "actual_area"))
    return rents.filter(home_rent(limits) & (d >= days_before(as_of, 2 * YEAR))).groupBy(
        "area_name", rooms_or_default("rooms", "rent_property_type").alias("rooms")
    ).agg(
        count_where(now).alias("n"), count_where(now & new).alias("n_new"), mean(F.when(now & new, F.col("annual_amount"))).alias("rent_new"),
        mean(F.when(now & renew, F.col("annual_amount"))).alias("rent_renew"),
        half_up(half_up(F.sum(per_sqm), 4) / F.nullif(F.count(per_sqm), F.lit(0))).alias("rent_psm"),
        mean(F.when(then & new, F.col("annual_amount"))).alias("rent_new_ly"),
    ).filter(F.col("n") >= min_contracts)


def rent_top_projects(rents: DataFrame, project: DataFrame, as_of: str, top: int = 30, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The most let projects of every area."""
    new, renew = F.col("contract_reg_type") == "New", F.col("contract_reg_type") == "Renew"
    grouped = rents.filter(home_rent(limits) & (F.col("contract_start_date") >= days_before(as_of, YEAR)) & F.col("project_number").isNotNull()).groupBy(
        "area_name", "project_number").agg(
        F.count(F.lit(1)).alias("n"), mean(F.when(new, F.col("annual_amount"))).alias("rent_new"), mean(F.when(renew, F.col("annual_amount"))).alias("rent_renew"))
    ranked = Window.partitionBy("area_name").orderBy(F.desc("n"), "project_number")
    return grouped.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).join(
        project.select("project_number", "project_name", "area_slug", "slug"), "project_number", "left")


def sales_by_rooms(tx: DataFrame, as_of: str, min_sales: int = 20) -> DataFrame:
    """Average sale price by area and rooms, for price-to-rent."""
    return tx.filter(
        is_sale() & is_unit() & (F.col("actual_worth") > 0) & rooms_stated() & (F.col("instance_date") >= days_before(as_of, YEAR))
    ).groupBy("area_name", "rooms").agg(F.count(F.lit(1)).alias("n"), mean("actual_worth").alias("price")).filter(F.col("n") >= min_sales)


def rent_caps(rents: DataFrame, as_of: str, min_contracts: int = 20, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Average new rent by area, home type and rooms: what a permitted increase is measured against."""
    kind = F.when(F.col("rent_property_type").isin("Villa", "Complex Villas"), F.lit("Villa")).otherwise(F.lit("Flat"))
    rooms = rooms_or_default("rooms", "rent_property_type", default=None)
    return rents.filter(
        home_rent(limits) & (F.col("contract_reg_type") == "New") & (F.col("contract_start_date") >= days_before(as_of, YEAR)) & rooms.isNotNull()
    ).groupBy("area_name", kind.alias("type"), rooms.alias("rooms")).agg(
        F.count(F.lit(1)).alias("n"), mean("annual_amount").alias("average")).filter(F.col("n") >= min_contracts)


def permitted_increase(book: DataFrame, caps: DataFrame) -> DataFrame:
    """Permitted increase of each tenancy by how far its rent is below the average for its like."""
    kind = F.when(F.col("rent_property_type").isin("Villa", "Complex Villas"), F.lit("Villa")).otherwise(F.lit("Flat"))
    rows = book.withColumn("type", kind).join(caps.select("area_name", "type", "rooms", "average"), ["area_name", "type", "rooms"])
    below = (F.col("average") - F.col("annual_amount")) / F.col("average") * 100
    # The decree's slabs, percent below average to percent of increase.
    slab = F.when(below <= 10, F.lit(0)).when(below <= 20, F.lit(5)).when(below <= 30, F.lit(10)).when(below <= 40, F.lit(15)).otherwise(F.lit(20))
    return rows.select(*book.columns, "type", "average", half_up(below, 1).alias("below_pct"), slab.alias("increase_pct"),
                       half_up(F.col("annual_amount") * (slab + 100) / 100).alias("max_rent"))


def area_yield(rents: DataFrame, tx: DataFrame, as_of: str, min_rents: int = 30, min_sales: int = 10, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Mean rent per sqm and mean ready price per sqm by area, with the gross yield where both are solid."""
    since = days_before(as_of, YEAR)
    per_sqm = F.when(rent_area_ok(limits), ratio("annual_amount", "actual_area"))
    let = rents.filter(home_rent(limits) & (F.col("contract_start_date") >= since)).groupBy("area_name").agg(
        half_up(half_up(F.sum(per_sqm), 4) / F.nullif(F.count(per_sqm), F.lit(0))).alias("rent_psm"), F.count(F.lit(1)).alias("rents"))
    sold = tx.filter(
        is_sale() & F.col("property_type").isin("Unit", "Villa") & (F.col("meter_sale_price") > 0) & rooms_classified() & is_ready()
        & (F.col("instance_date") >= since)
    ).groupBy("area_name").agg(mean("meter_sale_price").alias("sale_psm"), F.count(F.lit(1)).alias("sales"))
    solid = (F.col("rents") >= min_rents) & (F.col("sales") >= min_sales)
    return let.join(sold, "area_name", "full_outer").withColumn("gross_yield", F.when(solid, share("rent_psm", "sale_psm", 1)))


# ---- series ----

def price_volume_series(
    tx: DataFrame, period: Column, keys: Sequence[str] = (), since: str | None = None, until: str | None = None, min_priced: int = 0
) -> DataFrame:
    """Median apartment price and the volume of all sales per period and key."""
    apt = is_unit() & (F.col("meter_sale_price") > 0) & rooms_stated()
    rows = tx.filter(is_sale() & between_days("instance_date", since, until)).withColumn("period", period)
    group = [*keys, "period"]
    volume = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    middles = order_statistics(rows, group, {"v": F.when(apt, F.col("meter_sale_price"))}, {"_m": Pick("v"), "_np": Pick("v", "count")})
    out = volume.join(middles, group, "left").select(*group, settle("_m").alias("psm"), F.coalesce("_np", F.lit(0)).alias("priced"), "n")
    return out.filter(F.col("priced") >= min_priced) if min_priced else out


def mean_series(tx: DataFrame, keys: Sequence[str], since: str, until: str, classified: bool, min_sales: int = 0) -> DataFrame:
    """Mean price per sqm and count per key and month (project lines, area sparklines)."""
    rows = tx.filter(is_sale() & (F.col("meter_sale_price") > 0) & between_days("instance_date", since, until))
    if classified:
        rows = rows.filter(is_unit() & rooms_stated())
    out = rows.groupBy(*keys, month_start("instance_date").alias("month")).agg(mean("meter_sale_price").alias("psm"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= min_sales)


def history_facts(monthly: DataFrame, yearly: DataFrame, trough_after: int = 2008) -> DataFrame:
    """Rolling year against the year before, peak year, trough after a given year, last price change.

    Both inputs are one row per period.
    """
    by_time = Window.orderBy(F.desc("period"))
    year_ago = F.add_months(F.max("period").over(Window.partitionBy()), -12)
    recent = monthly.select("*", F.row_number().over(by_time).alias("_rn"), (F.col("period") == year_ago).alias("_year_ago"))
    volume = recent.agg(
        F.sum(F.when(F.col("_rn") <= 12, F.col("n"))).alias("volume_12"), F.sum(F.when(F.col("_rn").between(13, 24), F.col("n"))).alias("volume_prior_12"),
        F.max(F.when(F.col("_rn") == 1, F.col("psm"))).alias("psm_now"), F.max(F.when(F.col("_year_ago"), F.col("psm"))).alias("psm_year_ago"),
    )
    years = yearly.agg(
        F.max_by("period", F.struct("psm", -F.col("period"))).alias("peak_year"), F.max("psm").alias("peak_psm"),
        F.min_by("period", F.when(F.col("period") > trough_after, F.struct("psm", "period"))).alias("trough_year"),
        F.min(F.when(F.col("period") > trough_after, F.col("psm"))).alias("trough_psm"),
    )
    cols = [years.select(c).scalar().alias(c) for c in years.columns]
    return volume.select(
        "volume_12", "volume_prior_12", pct_change("volume_12", "volume_prior_12").alias("volume_change"), "psm_now", "psm_year_ago",
        pct_change("psm_now", "psm_year_ago").alias("psm_change"), *cols,
    )


def modal_by(df: DataFrame, keys: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    """Most frequent non-blank value per group; ties go to the first in order of text."""
    text = F.nullif(F.trim(F.col(column)), F.lit(""))
    counts = df.filter(text.isNotNull()).groupBy(*keys, text.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("x"), F.col("_v")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b._v").alias(name or column))


def project_location(tx: DataFrame, columns: Sequence[str] = ("nearest_metro", "nearest_landmark", "nearest_mall", "master_project")) -> DataFrame:
    """Modal metro, landmark, mall and community of each project over its registrations.

    The four counts are taken in one grouped pass.
    """
    rows = tx.filter(F.col("project_number").isNotNull())
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.nullif(F.trim(c), F.lit("")).alias("v")) for c in columns]))
    counts = rows.select("project_number", entries.alias("e")).groupBy("project_number", "e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    best = lambda c: F.min(F.when((F.col("k") == c) & F.col("v").isNotNull(), F.struct((-F.col("n")).alias("x"), F.col("v"))))["v"]
    return counts.groupBy("project_number").agg(
        *[best(c).alias(c) for c in columns], F.sum(F.when(F.col("k") == columns[0], F.col("n"))).alias("n"))


def backfill_community(project: DataFrame, location: DataFrame) -> DataFrame:
    """Projects with a blank community take the one their sales name."""
    known = location.select("project_number", F.col("master_project").alias("_m"))
    return project.join(known, "project_number", "left").select(
        *[F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col("_m")).alias(c) if c == "master_project" else F.col(c) for c in project.columns])


def recent_registrations(tx: DataFrame, n: int = 15) -> DataFrame:
    """The newest sales of every project; the bound is also applied before the shuffle."""
    newest = Window.partitionBy("project_number").orderBy(
        F.desc("instance_date"), F.desc("actual_worth"), "procedure_area", "area_name", "procedure_name", "building_name", "rooms")
    return tx.filter(is_sale() & F.col("project_number").isNotNull()).select(
        "project_number", "instance_date", "reg_type", "procedure_name", "building_name", "rooms", "procedure_area", "actual_worth", "meter_sale_price", "area_name"
    ).withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n).drop("area_name")


def service_charge_summary(charges: DataFrame, project: DataFrame) -> DataFrame:
    """Charges by project, year, building and usage, and the latest year's figure per unit."""
    lines = charges.groupBy(F.upper("project_name").alias("_name"), "budget_year", "property_group", "usage").agg(
        total("cost", 0).alias("total"), F.max("management_company").alias("manager"))
    years = lines.groupBy("_name", "budget_year").agg(F.sum("total").alias("_year_total"))
    latest = years.groupBy("_name").agg(F.max_by("_year_total", "budget_year").alias("_latest"))
    named = project.select("project_number", F.upper("project_name").alias("_name"), "units")
    return named.join(lines, "_name").join(latest, "_name").select(
        "project_number", "budget_year", "property_group", "usage", "total", "manager", half_up(ratio("_latest", "units")).alias("latest_per_unit"))


def permit_series(permits: DataFrame) -> DataFrame:
    """Permits filed per month: all, and those for a new building."""
    return permits.groupBy(month_start("permit_date").alias("month")).agg(
        F.count(F.lit(1)).alias("permits"), count_where(F.col("is_new_building")).alias("new_buildings"))


def permits_by_area(permits: DataFrame, as_of: str) -> DataFrame:
    return permits.filter(F.col("permit_date") >= days_before(as_of, YEAR)).groupBy("area_name").agg(
        F.count(F.lit(1)).alias("permits"), count_where(F.col("is_new_building")).alias("new_buildings"))


def read_dates(tx: DataFrame, rents: DataFrame, obs: DataFrame, project: DataFrame, as_of: str, unit: float = 1e9) -> DataFrame:
    """Provenance: how far each register was read and how much it holds, as one row."""
    sales = tx.agg(
        F.max("instance_date").alias("tx_to"), F.min("instance_date").alias("tx_from"), count_where(is_sale()).alias("tx_n"),
        half_up(total(F.when(is_sale(), F.col("actual_worth"))) / unit, 1).alias("tx_value"))
    let = rents.agg(F.max(F.when(F.col("contract_start_date") <= day(as_of), F.col("contract_start_date"))).alias("rent_to"), F.count(F.lit(1)).alias("rent_n"))
    rest = {"register_at": obs.agg(F.max("observed_at")), "register_n": project.agg(F.count(F.lit(1)))}
    return sales.select("*", *[let.select(c).scalar().alias(c) for c in let.columns], *[df.scalar().alias(k) for k, df in rest.items()])


def search_index(project: DataFrame, tx: DataFrame, developer: DataFrame, alias: dict[str, str]) -> DataFrame:
    """Everything a reader can look up: areas with common names, projects with their number, developers that build."""
    names = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    known = lambda c: F.try_element_at(names, F.col(c))
    areas = area_directory(project, tx).select(
        F.lit("Area").alias("kind"), F.lit(None).cast("string").alias("project_number"),
        F.coalesce(F.concat(known("area_name"), F.lit(" ("), "area_name", F.lit(")")), F.col("area_name")).alias("name"),
        F.lit(None).cast("string").alias("context"), F.concat(F.lit("areas/"), "area_slug").alias("page"))
    projects = project.select(
        F.lit("Project").alias("kind"), "project_number", F.col("project_name").alias("name"), F.coalesce(known("area_name"), F.col("area_name")).alias("context"),
        F.concat_ws("/", "area_slug", "slug").alias("page"))
    builders = developer.join(project.select("developer_number"), "developer_number", "left_semi").select(
        F.lit("Developer").alias("kind"), F.lit(None).cast("string").alias("project_number"), F.col("developer_name").alias("name"),
        F.lit(None).cast("string").alias("context"), F.concat(F.lit("developers/"), "developer_slug").alias("page"))
    return areas.unionByName(projects).unionByName(builders)


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def key_minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
