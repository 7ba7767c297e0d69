"""Asking-price scans: presence, streaks, validated cuts, distress, inventory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.numbers import count_where, day, days_before, half_up, mean, quotient, ratio
from cadastra.functions.predicates import is_sale
from cadastra.operators.quantiles import Pick, order_statistics


def scan_prices(events: DataFrame) -> DataFrame:
    """One price per listing and scan day, the last one filed; at most one row per listing and day."""
    return events.groupBy("listing_id", "observed_at").agg(F.max_by("asking_price", "event_id").alias("asking_price"))


def scan_days(prices: DataFrame) -> DataFrame:
    return prices.groupBy("observed_at").agg(F.count(F.lit(1)).alias("listings"))


def track_presence(prices: DataFrame) -> DataFrame:
    """The observation log: each seen price, and one unseen row at the first scan a listing misses.

    A longer absence adds no further rows, and the unseen row carries the last price. The next scan
    after each scan day is looked up from the days themselves (as many as there were scans), so no
    listing-by-day grid is made.
    """
    by_day = Window.orderBy("observed_at")
    # One row per scan day ever run.
    following = scan_days(prices).select("observed_at", F.lead("observed_at").over(by_day).alias("next_scan"))
    by_listing = Window.partitionBy("listing_id").orderBy("observed_at")
    rows = prices.join(following, "observed_at").withColumn("_next_seen", F.lead("observed_at").over(by_listing))
    missed = F.col("next_scan").isNotNull() & (F.col("_next_seen").isNull() | (F.col("_next_seen") > F.col("next_scan")))
    entry = F.array_compact(F.array(
        F.struct("observed_at", F.lit(True).alias("seen")),
        F.when(missed, F.struct(F.col("next_scan").alias("observed_at"), F.lit(False).alias("seen"))),
    ))
    return rows.select("listing_id", "asking_price", F.explode(entry).alias("e")).select(
        "listing_id", "e.observed_at", "asking_price", "e.seen"
    )


def missing_from_scan(previous: DataFrame, scan: DataFrame, observed_at: str) -> DataFrame:
    """Incremental form: rows to append for listings last seen before this scan and absent from it."""
    last = previous.groupBy("listing_id").agg(F.max_by(F.struct("asking_price", "seen"), "observed_at").alias("l"))
    return last.filter(F.col("l.seen")).join(scan.select("listing_id"), "listing_id", "left_anti").select(
        "listing_id", day(observed_at).alias("observed_at"), F.col("l.asking_price").alias("asking_price"), F.lit(False).alias("seen")
    )


def streaks(obs: DataFrame) -> DataFrame:
    """Consecutive seen scans before each observation, and the price before it.

    A listing has one row per scan day, so a window partition is bounded by the number of scans.
    """
    by_time = Window.partitionBy("listing_id").orderBy("observed_at")
    gap = F.sum((~F.col("seen")).cast("int")).over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    islands = obs.withColumn("_island", gap).withColumn("_prev", F.lag(F.struct("asking_price", "seen")).over(by_time))
    in_island = Window.partitionBy("listing_id", "_island").orderBy("observed_at").rowsBetween(Window.unboundedPreceding, -1)
    seen_before = F.coalesce(F.sum(F.col("seen").cast("int")).over(in_island), F.lit(0))
    return islands.select(
        "listing_id", "observed_at", "asking_price", "seen", F.when(F.col("seen"), seen_before).otherwise(F.lit(0)).alias("streak"),
        F.col("_prev.asking_price").alias("prev_price"), F.coalesce(F.col("_prev.seen"), F.lit(False)).alias("prev_seen"),
    )


@dataclass(frozen=True)
class DropRules:
    min_scans_before: int = 2
    min_pct: float = 0.02
    min_amount: float = 25_000.0
    comp_days: int = 90
    wide_days: int = 365
    # Off by default: also ask for a later scan that still shows the listing.
    require_later_scan: bool = False


def price_cuts(obs: DataFrame, listing: DataFrame, rules: DropRules = DropRules()) -> DataFrame:
    """Every price cut between two seen scans, and whether it passes the rules."""
    rows = streaks(obs)
    if rules.require_later_scan:
        later = Window.partitionBy("listing_id").orderBy("observed_at").rowsBetween(1, Window.unboundedFollowing)
        rows = rows.withColumn("_later", F.coalesce(F.max(F.col("seen").cast("int")).over(later), F.lit(0)))
    cuts = rows.filter(F.col("seen") & F.col("prev_seen") & (F.col("asking_price") < F.col("prev_price")))
    cuts = cuts.join(listing.select("listing_id", "is_off_plan"), "listing_id")
    amount = F.col("prev_price") - F.col("asking_price")
    pct = quotient(amount, "prev_price")
    big = (pct >= rules.min_pct) & (F.col("is_off_plan") | (amount >= rules.min_amount))
    ok = big & (F.col("streak") >= rules.min_scans_before)
    if rules.require_later_scan:
        ok = ok & (F.col("_later") == 1)
    return cuts.select(
        "listing_id", "observed_at", F.col("prev_price").alias("from_price"), F.col("asking_price").alias("to_price"),
        half_up(pct, 6).alias("cut_pct"), "streak", ok.alias("validated"),
    )


def listing_outcomes(obs: DataFrame, listing: DataFrame, rules: DropRules = DropRules()) -> DataFrame:
    """Each listing's cuts summed up, with the reason it is not published if it is not."""
    history = obs.groupBy("listing_id").agg(
        count_where(F.col("seen")).alias("scans_seen"), F.max_by("seen", "observed_at").alias("live"),
        F.min_by("asking_price", F.when(F.col("seen"), F.col("observed_at"))).alias("first_price"),
        F.max_by("asking_price", F.when(F.col("seen"), F.col("observed_at"))).alias("current_price"),
        F.min(F.when(F.col("seen"), F.col("observed_at"))).alias("first_seen"),
        F.max(F.when(F.col("seen"), F.col("observed_at"))).alias("last_seen"),
    )
    cuts = price_cuts(obs, listing, rules).groupBy("listing_id").agg(
        count_where(F.col("validated")).alias("drops"), count_where(~F.col("validated")).alias("unvalidated"),
        F.max(F.when(F.col("validated"), F.col("observed_at"))).alias("last_drop"),
    )
    rows = history.join(cuts, "listing_id", "left").withColumn("drops", F.coalesce("drops", F.lit(0)))
    reason = (
        F.when(F.col("scans_seen") < rules.min_scans_before + 1, F.lit("too-few-scans"))
        .when(F.col("drops") == 0, F.lit("no-validated-drop")).when(~F.col("live"), F.lit("currently-delisted"))
    )
    return rows.select(
        "listing_id", "scans_seen", "first_price", "current_price", "first_seen", "last_seen", "drops",
        F.coalesce("unvalidated", F.lit(0)).alias("unvalidated"), "last_drop", reason.alias("rejected"),
        half_up(quotient(F.col("first_price") - F.col("current_price"), "first_price"), 6).alias("cumulative_pct"),
        F.datediff("last_seen", "first_seen").alias("days_tracked"),
    )


def rejections(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(F.coalesce("rejected", F.lit("published")).alias("outcome")).agg(F.count(F.lit(1)).alias("listings"))


def comparable_psm(tx: DataFrame, as_of: str, rules: DropRules = DropRules()) -> tuple[DataFrame, DataFrame]:
    """Recorded price levels to hold an asking price against: (project, rooms) near, (project) wide."""
    sold = tx.filter(is_sale() & (F.col("meter_sale_price") > 0) & F.col("project_number").isNotNull())
    near = order_statistics(
        sold.filter(F.col("instance_date") >= days_before(as_of, rules.comp_days)), ["project_number", "rooms"],
        {"v": F.col("meter_sale_price")}, {"near_psm": Pick("v", "upper")},
    )
    near_any = order_statistics(
        sold.filter(F.col("instance_date") >= days_before(as_of, rules.comp_days)), ["project_number"],
        {"v": F.col("meter_sale_price")}, {"near_any_psm": Pick("v", "upper")},
    )
    wide = order_statistics(
        sold.filter(F.col("instance_date") >= days_before(as_of, rules.wide_days)), ["project_number"],
        {"v": F.col("meter_sale_price")}, {"wide_psm": Pick("v", "upper")},
    )
    return near, near_any.join(wide, "project_number", "full_outer")


def distress_score(drops: Column, cumulative: Column, days: Column, area_days: Column, gap: Column, slip_months: Column) -> Column:
    """0 to 100: cuts, depth, time on the market against its area, asking below recorded, completion slip.

    Null where no whole number holds it, as for a listing first asked at nothing, whose price rose without bound.
    """
    score = (
        F.least(F.lit(30.0), drops * 10.0) + F.least(F.lit(25.0), cumulative * 100 * 1.5)
        + F.when(days > area_days * 1.5, F.lit(15.0)).when(days > area_days, F.lit(8.0)).otherwise(F.lit(0.0))
        + F.when(gap < -0.05, F.lit(20.0)).when(gap < 0, F.lit(10.0)).otherwise(F.lit(0.0))
        + F.least(F.lit(10.0), F.coalesce(slip_months, F.lit(0.0)))
    )
    return half_up(half_up(score, 6)).try_cast("int")


def validated_drops(
    listing: DataFrame, obs: DataFrame, tx: DataFrame, readings: DataFrame, as_of: str, rules: DropRules = DropRules()
) -> DataFrame:
    """Published price drops with their recorded-price anchor, gap and distress score."""
    outcomes = listing_outcomes(obs, listing, rules).filter(F.col("rejected").isNull())
    near, wide = comparable_psm(tx, as_of, rules)
    slip = readings.filter(F.col("completion_date").isNotNull()).groupBy("project_number").agg(
        (F.datediff(F.max("completion_date"), F.min("completion_date")) / F.lit(30.4)).alias("_slip")
    )
    area_days = listing.groupBy("area_name").agg(
        (F.sum(F.datediff(day(as_of), "first_seen_at")) / F.count(F.lit(1))).alias("_area_days")
    )
    rows = (
        outcomes.join(listing.select("listing_id", "project_number", "area_name", "rooms", "area_sqm"), "listing_id")
        .join(near, ["project_number", "rooms"], "left").join(wide, "project_number", "left")
        .join(slip, "project_number", "left").join(area_days, "area_name", "left")
    )
    stated = F.coalesce(F.col("rooms") != "", F.lit(False))
    anchor = F.coalesce(F.when(stated, F.col("near_psm")).otherwise(F.col("near_any_psm")), F.col("wide_psm"))
    asking = F.when(anchor.isNotNull(), ratio("current_price", "area_sqm"))
    gap = (asking - anchor) / anchor
    score = distress_score(
        F.col("drops"), F.col("cumulative_pct"), F.col("days_tracked"), F.coalesce("_area_days", "days_tracked"), gap, F.col("_slip")
    )
    return rows.select(
        "listing_id", "project_number", "area_name", "first_price", "current_price", "drops", "cumulative_pct", "last_drop",
        "days_tracked", half_up(anchor, 2).alias("recorded_psm"), half_up(asking, 2).alias("asking_psm"), half_up(gap, 4).alias("gap"),
        score.alias("distress_score"), "unvalidated",
    )


def drop_feed(drops: DataFrame, listing: DataFrame, project: DataFrame) -> DataFrame:
    """Published drops with their listing and project page, for the feed."""
    return (
        drops.join(listing.select("listing_id", "rooms", "area_sqm", "is_off_plan"), "listing_id")
        .join(project.select("project_number", "project_name", "area_slug", "slug"), "project_number", "left")
        .select(*drops.columns, "rooms", "area_sqm", "is_off_plan", "project_name", F.concat_ws("/", "area_slug", "slug").alias("page"))
    )


def listing_inventory(listing: DataFrame, obs: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """Active listings by area at the last scan: average ask, cuts from the first price, months of inventory."""
    last_scan = obs.agg(F.max("observed_at").alias("m")).scalar()
    sides = obs.groupBy("listing_id").agg(
        F.min_by("asking_price", "observed_at").alias("first_price"),
        F.max(F.when((F.col("observed_at") == last_scan) & F.col("seen"), F.col("asking_price"))).alias("ask"),
    ).filter(F.col("ask").isNotNull())
    cut = F.col("ask") < F.col("first_price") * 0.98
    grouped = sides.join(listing.select("listing_id", "area_name"), "listing_id").filter(F.col("area_name").isNotNull()).groupBy("area_name").agg(
        F.count(F.lit(1)).alias("active"), mean("ask").alias("avg_ask"), count_where(cut).alias("cut"),
        half_up(half_up(F.sum(F.when(cut, (quotient("ask", "first_price") - 1) * 100)), 6) / F.nullif(count_where(cut), F.lit(0)), 1).alias("avg_cut_pct"),
    )
    sales = tx.filter(is_sale() & (F.col("instance_date") >= days_before(as_of, 365))).groupBy("area_name").agg(
        F.count(F.lit(1)).alias("sales_12m"))
    return grouped.join(sales, "area_name", "left").select(
        "*", F.coalesce("sales_12m", F.lit(0)).alias("_s")
    ).select(
        "area_name", "active", "avg_ask", "cut", "avg_cut_pct", F.col("_s").alias("sales_12m"),
        half_up(F.lit(100.0) * F.col("cut") / F.col("active")).alias("cut_share"),
        half_up(ratio(F.col("active"), F.col("_s") / 12.0), 1).alias("months_of_inventory"),
    )


def listing_summary(listing: DataFrame, obs: DataFrame) -> DataFrame:
    """Listings tracked, scans run, the last scan and how many were live in it."""
    by_day = obs.groupBy("observed_at").agg(count_where(F.col("seen")).alias("n"))
    return by_day.agg(
        F.count(F.lit(1)).alias("scans"), F.max("observed_at").alias("last_scan"), F.max_by("n", "observed_at").alias("active")
    ).withColumn("tracked", listing.agg(F.count(F.lit(1)).alias("n")).scalar())


def clean_listings(rows: DataFrame) -> DataFrame:
    """Latest attributes per listing: id out of its link, square feet to square metres."""
    from cadastra.functions.text import norm_rooms

    found = F.regexp_extract("link", r"details-(\d+)", 1)
    fallback = F.substring(F.regexp_replace(F.regexp_replace("link", "^https?://", ""), "(?i)[^a-z0-9]+", "-"), 1, 60)
    ids = rows.withColumn("listing_id", F.when(found != "", F.concat(F.lit("details-"), found)).otherwise(fallback))
    newest = ids.groupBy("listing_id").agg(
        F.max_by(F.struct("community", "beds", "sqft", "link"), F.struct("observed_at", "link")).alias("a"), F.max("observed_at").alias("last_seen")
    )
    return newest.select(
        "listing_id", "last_seen", F.col("a.community").alias("community"), norm_rooms("a.beds").alias("rooms"),
        half_up(F.when(F.col("a.sqft") > 0, F.col("a.sqft") * 0.092903), 1).alias("area_sqm"), F.col("a.link").alias("link"),
    )


def explode_price_log(history: DataFrame, scans: DataFrame, min_price: float = 50_000.0) -> DataFrame:
    """Observations out of each listing's date-to-price map, where no scan already holds them."""
    rows = history.select("listing_id", F.explode("price_log").alias("d", "asking_price")).select(
        "listing_id", F.col("d").try_cast("date").alias("observed_at"), "asking_price"
    )
    return rows.filter((F.col("asking_price") >= min_price) & F.col("observed_at").isNotNull()).join(
        scans.select("listing_id", "observed_at"), ["listing_id", "observed_at"], "left_anti"
    )
