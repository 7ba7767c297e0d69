"""Construction readings: the latest as of a date, what moved, supply, delay and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.numbers import (
    count_where, day, days_before, half_up, mean, months_apart, ratio, total,
)
from cadastra.functions.predicates import BUILDING_STATUSES, LIVE_STATUSES, SOURCE_RANK, is_off_plan, is_sale
from cadastra.functions.text import percent_policy
from cadastra.operators.grouping import number_in_order

READING = ("observed_at", "status", "percent_completed", "completion_date", "source", "id")
DAYS_PER_MONTH = 30.44


def _source_rank() -> Column:
    rank = F.lit(len(SOURCE_RANK))
    for name, value in SOURCE_RANK.items():
        rank = F.when(F.col("source") == name, F.lit(value)).otherwise(rank)
    return rank


def reading_order(tie: str = "ranked") -> Column:
    """What makes one reading later than another; every form ends in the unique id.

    ``ranked``: date, then the register itself over a copy of it, then id.
    ``id``: date, then id.
    """
    if tie == "ranked":
        return F.struct(F.col("observed_at"), (-_source_rank()).alias("r"), F.col("id"))
    if tie == "id":
        return F.struct(F.col("observed_at"), F.col("id"))
    raise ValueError(tie)


def latest_as_of(obs: DataFrame, as_of, tie: str = "ranked", keys: Sequence[str] = ("project_number",)) -> DataFrame:
    """The newest reading on or before a date, per entity.

    A grouped maximum, not a window: readings are combined before the shuffle, so an entity
    with any number of readings costs one row per task.
    """
    payload = [c for c in READING if c in obs.columns]
    newest = (
        obs.filter(F.col("observed_at") <= day(as_of))
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), reading_order(tie)).alias("_r"))
    )
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in payload])


def last_two(obs: DataFrame, as_of, tie: str = "ranked") -> DataFrame:
    """The two newest readings of each project side by side (previous is null for a single one).

    The row number is bounded by 2, which the engine also applies before the shuffle.
    """
    newest_first = Window.partitionBy("project_number").orderBy(reading_order(tie).desc())
    kept = (
        obs.filter(F.col("observed_at") <= day(as_of))
        .withColumn("_rn", F.row_number().over(newest_first))
        .filter(F.col("_rn") <= 2)
    )
    row = F.struct("observed_at", "status", "percent_completed", "completion_date", "source", "id")
    sides = kept.groupBy("project_number").agg(
        F.max(F.when(F.col("_rn") == 1, row)).alias("now"), F.max(F.when(F.col("_rn") == 2, row)).alias("before")
    )
    return sides


def first_last_dates(obs: DataFrame, as_of, tie: str = "ranked") -> DataFrame:
    """Earliest planned and latest current completion date per project, with the slip in months."""
    seen = obs.filter(F.col("observed_at") <= day(as_of))
    out = seen.groupBy("project_number").agg(
        F.min("completion_date").alias("planned"),
        F.max_by("completion_date", reading_order(tie)).alias("current"),
        F.count(F.lit(1)).alias("readings"),
    )
    slip = half_up(F.datediff("current", "planned") / F.lit(DAYS_PER_MONTH), 1)
    return out.withColumn("slip_months", F.when(F.col("current") != F.col("planned"), slip).otherwise(F.lit(0.0)))


def _changed(a: str, b: str, null_text: str | None = None) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def moves(
    tx: DataFrame, obs: DataFrame, project: DataFrame, developer: DataFrame, as_of: str, window: int = 45,
    min_points: float = 0.5, unit: float = 1e6,
) -> DataFrame:
    """What moved per project: recent sales, progress, completion date, status, as an event array.

    A project with no movement gives no row.
    """
    recent = (F.col("instance_date") >= days_before(as_of, window)) & (F.col("instance_date") <= day(as_of))
    prior = (F.col("instance_date") >= days_before(as_of, 2 * window)) & ~recent
    sales = (
        tx.filter(
            is_sale() & F.col("project_number").isNotNull()
            & F.col("instance_date").between(days_before(as_of, 2 * window), day(as_of))
        )
        .groupBy("project_number")
        .agg(
            count_where(recent).alias("n"), count_where(prior).alias("n_prior"),
            total(F.when(recent, F.col("actual_worth"))).alias("worth"),
            F.max(F.when(recent, F.col("instance_date"))).alias("last"),
            mean(F.when(recent, F.col("meter_sale_price"))).alias("psm"),
        )
        .filter(F.col("n") > 0)
    )
    two = last_two(obs, as_of).filter(F.col("before").isNotNull())
    delta = F.col("now.percent_completed") - F.col("before.percent_completed")
    moved = two.select(
        "project_number", half_up(delta, 1).alias("delta"), (F.abs(delta) >= min_points).alias("_p"), "now", "before"
    )
    page = project.select("project_number", "project_name", "area_name", "area_slug", "slug", "developer_number")
    joined = (
        sales.join(moved, "project_number", "full_outer")
        .join(page.filter(F.col("slug").isNotNull()), "project_number")
        .join(developer.select("developer_number", "developer_name"), "developer_number", "left")
    )
    event = lambda cond, kind, **f: F.when(
        cond,
        F.struct(
            F.lit(kind).alias("kind"),
            *[f.get(k, F.lit(None)).cast(t).alias(k) for k, t in (
                ("n", "bigint"), ("value", "double"), ("psm", "double"), ("change", "double"),
                ("from_value", "string"), ("to_value", "string"), ("on", "date"))],
        ),
    )
    events = F.array_compact(F.array(
        event(F.col("n") > 0, "sales", n=F.col("n"), value=half_up(F.col("worth") / unit), psm=F.col("psm"),
              change=F.when(F.col("n_prior") > 0, half_up(F.lit(100.0) * (F.col("n") - F.col("n_prior")) / F.col("n_prior"))),
              on=F.col("last")),
        event(F.col("_p") & (F.abs(F.col("delta")) >= min_points), "progress", change=F.col("delta"), on=F.col("now.observed_at")),
        event(_changed("before.completion_date", "now.completion_date") & F.col("now").isNotNull(), "completionDate",
              from_value=F.col("before.completion_date"), to_value=F.col("now.completion_date"), on=F.col("now.observed_at")),
        event(_changed("before.status", "now.status") & F.col("now").isNotNull(), "status",
              from_value=F.col("before.status"), to_value=F.col("now.status"), on=F.col("now.observed_at")),
    ))
    return joined.select(
        "project_number", "project_name", "area_name", "developer_name",
        F.concat_ws("/", "area_slug", "slug").alias("page"), events.alias("events"),
    ).filter(F.size("events") > 0)


def _live_with_sales(project: DataFrame, obs: DataFrame, tx: DataFrame, as_of: str, absorb_days: int) -> DataFrame:
    """Live projects with their off-plan sales to date and recent absorption.

    Live means: registered units, not cancelled, and *any* reading below complete.
    """
    unfinished = obs.filter(F.coalesce(F.col("percent_completed"), F.lit(0.0)) < 100).select("project_number")
    sold = (
        tx.filter(is_sale() & F.col("project_number").isNotNull())
        .groupBy("project_number")
        .agg(
            count_where(is_off_plan()).alias("sold"),
            count_where(F.col("instance_date") >= days_before(as_of, absorb_days)).alias("recent"),
        )
    )
    live = project.filter((F.col("units") > 0) & F.col("cancellation_date").isNull()).join(
        unfinished, "project_number", "left_semi"
    )
    joined = live.join(sold, "project_number", "left")
    return joined.select(
        "project_number", "project_name", "area_name", "area_slug", "slug", "units",
        F.coalesce("sold", F.lit(0)).alias("sold"), F.coalesce("recent", F.lit(0)).alias("recent"),
    ).withColumn("unsold", F.greatest(F.lit(0), F.col("units") - F.col("sold")))


def months_of_supply(
    project: DataFrame, obs: DataFrame, tx: DataFrame, as_of: str, by: str = "project", absorb_days: int = 180,
    min_area_unsold: int = 200, min_area_absorb: float = 3.0,
) -> DataFrame:
    """Months the unsold stock takes to clear at the recent pace: ``by`` project, area or market."""
    months = absorb_days / DAYS_PER_MONTH
    rows = _live_with_sales(project, obs, tx, as_of, absorb_days)
    absorb = F.col("recent") / F.lit(months)
    supply = half_up(ratio(F.col("unsold"), absorb), 1)
    if by == "project":
        return rows.select(
            "project_number", "project_name", "area_name", F.concat_ws("/", "area_slug", "slug").alias("page"), "units",
            "sold", "unsold", half_up(absorb, 1).alias("absorption"), supply.alias("months_of_supply"),
        ).filter(F.col("months_of_supply").isNotNull())
    sums = [F.sum("unsold").alias("unsold"), F.sum("recent").alias("recent"), F.count(F.lit(1)).alias("projects")]
    if by == "area":
        return (
            rows.groupBy("area_name").agg(*sums)
            .filter((F.col("unsold") >= min_area_unsold) & (absorb >= min_area_absorb))
            .select("area_name", "projects", "unsold", half_up(absorb, 1).alias("absorption"), supply.alias("months_of_supply"))
        )
    if by == "market":
        return rows.agg(*sums).select("projects", "unsold", half_up(absorb).alias("absorption"), supply.alias("months_of_supply"))
    raise ValueError(by)


def delay_flags(
    project: DataFrame, obs: DataFrame, tx: DataFrame, as_of: str, min_sales: int = 20, within_months: float = 6.0,
    below_percent: float = 70.0,
) -> DataFrame:
    """Projects still selling whose completion date is near or past while they are far from built."""
    sales = (
        tx.filter(is_sale() & F.col("instance_date").between(days_before(as_of, 365), day(as_of)))
        .groupBy("project_number")
        .agg(
            F.count(F.lit(1)).alias("sales_12m"), total("actual_worth").alias("value_12m"),
            count_where(is_off_plan()).alias("offplan_12m"),
        )
        .filter(F.col("sales_12m") >= min_sales)
    )
    reading = latest_as_of(obs, as_of).filter(
        F.col("status").isin(*BUILDING_STATUSES) & F.col("completion_date").isNotNull()
    )
    raw_months = F.datediff("completion_date", day(as_of)) / F.lit(30.4)
    pct = F.coalesce(F.col("percent_completed"), F.lit(0.0))
    flagged = (
        reading.filter((raw_months < within_months) & (pct < below_percent))
        .join(sales, "project_number")
        .join(project.select("project_number", "area_name"), "project_number")
        .withColumn("months_to_completion", half_up(raw_months, 1))
    )
    m = F.col("months_to_completion")
    score = (
        F.when(m < 0, F.lit(40.0)).otherwise(F.lit(40.0) - m * 6)
        + (F.lit(70.0) - pct) * 0.5
        + F.least(F.lit(25.0), F.col("sales_12m") / 20.0)
    )
    when_due = F.when(m < 0, F.lit("completion date passed, ")).otherwise(
        F.concat(half_up(m).cast("int").cast("string"), F.lit(" months to completion, "))
    )
    return flagged.select(
        "project_number", "area_name", "status", "percent_completed", "completion_date", "months_to_completion",
        "sales_12m", "value_12m", "offplan_12m",
        F.least(F.lit(100), half_up(score, 6).cast("int")).alias("risk_score"),
        F.concat(
            when_due, half_up(pct).cast("int").cast("string"), F.lit("% complete, "), F.col("sales_12m").cast("string"),
            F.lit(" sales in 12m"),
        ).alias("reason"),
    )


def live_pipeline(obs: DataFrame, project: DataFrame, developer: DataFrame, as_of: str) -> DataFrame:
    """Every project not finished or cancelled at the date, with one test for lateness."""
    rows = (
        latest_as_of(obs, as_of, tie="id")
        .join(project.select("project_number", "project_name", "area_name", "area_slug", "slug", "units", "developer_number"), "project_number")
        .join(developer.select("developer_number", "developer_name"), "developer_number", "left")
        .filter(F.col("status").isin(*LIVE_STATUSES))
    )
    late = F.coalesce(F.col("completion_date") < day(as_of), F.lit(False))
    soon = ~late & (F.col("completion_date") <= F.date_add(day(as_of), 365))
    return rows.select(
        "*", late.alias("past_due"), F.coalesce(soon, F.lit(False)).alias("due_soon"),
        F.coalesce(soon & (F.col("percent_completed") < 60), F.lit(False)).alias("behind"),
        F.when(F.col("completion_date").isNull(), F.lit("no date")).when(late, F.lit("past due"))
        .otherwise(F.year("completion_date").cast("string")).alias("bucket"),
    )


def pipeline_by(rows: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Live projects and units by completion bucket, area or developer."""
    name = F.coalesce(F.col(key), F.lit("Unknown")).alias(key)
    out = rows.groupBy(name).agg(
        F.count(F.lit(1)).alias("projects"), F.sum(F.coalesce("units", F.lit(0))).alias("units"),
        count_where(F.col("past_due")).alias("past_due"),
    )
    return out if top is None else out.orderBy(F.desc("units"), key).limit(top)


def pipeline_totals(rows: DataFrame) -> DataFrame:
    """Live, active, due within a year, past due and behind: projects and units of each."""
    groups = {
        "live": F.lit(True), "active": F.col("status") == "ACTIVE", "due_next_12": F.col("due_soon"),
        "past_due": F.col("past_due"), "behind": F.col("behind"),
    }
    aggs = []
    for name, cond in groups.items():
        aggs.append(count_where(cond).alias(f"{name}_projects"))
        aggs.append(F.coalesce(F.sum(F.when(cond, F.col("units"))), F.lit(0)).alias(f"{name}_units"))
    return rows.agg(*aggs)


def pipeline_list(rows: DataFrame, which: str, top: int = 15) -> DataFrame:
    """The largest projects behind their timetable, or past their date."""
    return (
        rows.filter(F.col(which))
        .orderBy(F.coalesce("units", F.lit(0)).desc(), "project_number")
        .limit(top)
        .select(
            "project_number", "project_name", "area_name", "developer_name",
            half_up(percent_policy("percent_completed", "cap"), 1).alias("percent"),
            F.col("completion_date").alias("due"), "units", F.concat_ws("/", "area_slug", "slug").alias("page"),
        )
    )


def register_moves(obs: DataFrame, project: DataFrame, frm: str, to: str) -> DataFrame:
    """Progress, status and completion changes between two dates, read from the observation log.

    A jump straight to complete between two different sources is kept but marked suspect.
    """
    keep = ["project_number", "observed_at", "status", "percent_completed", "completion_date", "source", "id"]
    before = latest_as_of(obs, frm).select(*[F.col(c).alias(c if c == "project_number" else f"b_{c}") for c in keep])
    after = latest_as_of(obs, to).select(*[F.col(c).alias(c if c == "project_number" else f"a_{c}") for c in keep])
    both = before.join(after, "project_number").filter(F.col("b_id") != F.col("a_id"))
    bp, ap = percent_policy("b_percent_completed", "cap"), percent_policy("a_percent_completed", "cap")
    suspect = (F.col("b_source") != F.col("a_source")) & (ap >= 99.9) & (ap - bp >= 50)
    change = F.when(F.abs(ap - bp) >= 0.05, half_up(ap - bp, 1))
    shift = F.when(
        F.col("a_completion_date") != F.col("b_completion_date"),
        half_up(F.datediff("a_completion_date", "b_completion_date") / F.lit(DAYS_PER_MONTH), 1),
    )
    moved = both.select(
        "project_number", half_up(bp, 1).alias("percent_before"), half_up(ap, 1).alias("percent_after"),
        change.alias("progress"), F.coalesce(suspect & change.isNotNull(), F.lit(False)).alias("suspect"),
        F.col("b_observed_at").alias("read_before"), F.col("a_observed_at").alias("read_after"),
        F.when(F.col("a_status") != F.col("b_status"), F.concat_ws(">", "b_status", "a_status")).alias("status_change"),
        F.when(shift.isNotNull(), F.col("b_completion_date")).alias("completion_was"),
        F.when(shift.isNotNull(), F.col("a_completion_date")).alias("completion_now"),
        shift.alias("completion_shift"),
    ).filter(F.col("progress").isNotNull() | F.col("status_change").isNotNull() | F.col("completion_shift").isNotNull())
    return moved.join(project.select("project_number", "project_name", "area_name"), "project_number", "left")


def order_progress(rows: DataFrame) -> DataFrame:
    """Progress revisions with the suspect ones last and the largest first."""
    return rows.filter(F.col("progress").isNotNull()).orderBy("suspect", F.abs("progress").desc(), "project_number")


def place_progress(rows: DataFrame) -> DataFrame:
    """Every progress revision with its ``place`` in that order.

    Progress is published to one decimal, so the places before a value follow from counts of a few thousand values at
    most; only revisions of one value are numbered together.
    """
    kept = rows.filter(F.col("progress").isNotNull()).withColumn("_size", F.abs("progress"))
    counts = kept.groupBy("suspect", "_size").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("suspect", F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("suspect", "_size", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("suspect", "_size").orderBy("project_number")
    numbered = kept.join(before.withColumnRenamed("suspect", "_s").withColumnRenamed("_size", "_z"), F.col("suspect").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    return numbered.withColumn("place", (F.col("_before") + F.row_number().over(inside)).cast("int")).drop("_size", "_before", "_s", "_z")


def entered(obs: DataFrame, project_seen: DataFrame, frm: str, to: str) -> DataFrame:
    """Projects first seen inside (frm, to]: by their vintage, else by their first reading."""
    first = obs.groupBy("project_number").agg(F.min("observed_at").alias("first_reading"))
    seen = first.join(project_seen, "project_number", "left").withColumn(
        "first_seen", F.coalesce("first_seen", "first_reading")
    )
    return seen.filter((F.col("first_seen") > day(frm)) & (F.col("first_seen") <= day(to))).select("project_number", "first_seen")


# Buckets of certified percentage.
PERCENT_MIX = (
    ("0%", 0.0, 0.0001), ("1–25%", 0.0001, 25.0), ("25–50%", 25.0, 50.0), ("50–75%", 50.0, 75.0),
    ("75–99%", 75.0, 99.9999), ("100%", 99.9999, 100.0001),
)


def reading_mix(obs: DataFrame, to: str) -> DataFrame:
    """Status mix and percentage mix of the latest readings, as (kind, label, n)."""
    from cadastra.operators.market import bucketize

    latest = latest_as_of(obs, to)
    bucket = F.coalesce(bucketize(percent_policy("percent_completed", "cap"), PERCENT_MIX), F.lit("not stated"))
    pairs = F.explode(F.array(
        F.struct(F.lit("status").alias("kind"), F.coalesce("status", F.lit("Unknown")).alias("label")),
        F.struct(F.lit("percent").alias("kind"), bucket.alias("label")),
    ))
    return latest.select(pairs.alias("p")).groupBy("p.kind", "p.label").agg(F.count(F.lit(1)).alias("n"))


def snap_window(snapshots: DataFrame, frm: str, to: str, day_col: str = "read_day") -> DataFrame:
    """The window on days actually read: the start moves forward, the end moves back."""
    d = F.col(day_col)
    return snapshots.agg(F.min(F.when(d >= day(frm), d)).alias("read_from"), F.max(F.when(d <= day(to), d)).alias("read_to"))


def snapshot_of(obs: DataFrame, read_day) -> DataFrame:
    """The register as read on one day, one row per project."""
    return latest_as_of(obs.filter(F.col("observed_at") == day(read_day)), read_day)


def register_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full comparison of two snapshots: added, gone, progress, off-scale, status and dates moved."""
    cols = ["status", "percent_completed", "completion_date", "observed_at"]
    b = before.select("project_number", F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    a = after.select("project_number", F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    bp, ap = F.col("b_percent_completed"), F.col("a_percent_completed")
    off = both & (F.coalesce(~bp.between(0, 100), F.lit(False)) | F.coalesce(~ap.between(0, 100), F.lit(False)))
    a_date, b_date = F.col("a_completion_date"), F.col("b_completion_date")
    months = half_up(
        F.lit(1.0) * months_apart(b_date, a_date) + (F.dayofmonth(a_date) - F.dayofmonth(b_date)) / F.lit(DAYS_PER_MONTH), 1
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return b.join(a, "project_number", "full_outer").select(
        "project_number",
        F.when(F.col("_b").isNull(), F.lit("added")).when(F.col("_a").isNull(), F.lit("gone")).otherwise(F.lit("held")).alias("presence"),
        off.alias("off_scale"), bp.alias("percent_before"), ap.alias("percent_after"),
        F.when(both & ~off & (F.abs(ap - bp) >= 0.05), half_up(ap - bp, 2)).alias("progress"),
        F.when(both & (text("b_status") != text("a_status")), F.concat_ws(">", "b_status", "a_status")).alias("status_change"),
        F.when(both & (a_date != b_date), months).alias("date_shift_months"),
        F.coalesce(both & (ap == bp), F.lit(False)).alias("unchanged_percent"),
    )


def register_diff_counts(diff: DataFrame) -> DataFrame:
    """The edition's counts over a register diff."""
    c = F.col
    return diff.agg(
        count_where(c("presence") != "added").alias("projects_before"), count_where(c("presence") != "gone").alias("projects_after"),
        count_where(c("presence") == "added").alias("added"), count_where(c("presence") == "gone").alias("gone"),
        count_where(c("off_scale")).alias("off_scale"), F.count("progress").alias("progress_revisions"),
        count_where(c("progress") > 0).alias("revised_up"), count_where(c("progress") <= 0).alias("revised_down"),
        F.count("status_change").alias("status_changes"), F.count("date_shift_months").alias("dates_moved"),
        count_where(c("date_shift_months") > 0).alias("slipped_later"), count_where(c("unchanged_percent")).alias("unchanged"),
    )


def build_verdict(project: DataFrame, obs: DataFrame, as_of: str) -> DataFrame:
    """Is it being built: a label and tone per project, months late and slip since the first date."""
    dates = obs.filter(F.col("observed_at") <= day(as_of)).groupBy("project_number").agg(
        F.min_by("completion_date", F.when(F.col("completion_date").isNotNull(), F.struct("observed_at", "id"))).alias("first_date")
    )
    rows = project.select("project_number", "project_name").join(latest_as_of(obs, as_of), "project_number", "left").join(
        dates, "project_number", "left"
    )
    months = lambda a, b: half_up(F.datediff(b, a) / F.lit(30.4)).cast("int")
    pct, late = F.coalesce("percent_completed", F.lit(0.0)), months(F.col("completion_date"), day(as_of))
    unfinished = F.col("completion_date").isNotNull() & (pct < 100)
    overdue = unfinished & (late > 0)
    curve = unfinished & (late <= 0) & F.col("percent_completed").isNotNull() & (-late <= 6) & (pct < 60)
    label = (
        F.when(F.col("id").isNull(), F.lit("No reading")).when(F.col("status") == "FINISHED", F.lit("Completed"))
        .when(F.col("status") == "CANCELLED", F.lit("Cancelled")).when(overdue, F.lit("Past its registered finish date"))
        .when(curve, F.lit("Behind the curve")).otherwise(F.lit("On the register's timetable"))
    )
    tone = (
        F.when(F.col("id").isNull(), F.lit("muted")).when(F.col("status") == "FINISHED", F.lit("ok"))
        .when(F.col("status") == "CANCELLED", F.lit("bad")).when(overdue & (late > 6), F.lit("bad"))
        .when(overdue | curve, F.lit("warn")).otherwise(F.lit("ok"))
    )
    open_build = F.col("id").isNotNull() & ~F.col("status").isin("FINISHED", "CANCELLED")
    slip = months(F.col("first_date"), F.col("completion_date"))
    return rows.select(
        "project_number", "status", "percent_completed", "completion_date", label.alias("label"), tone.alias("tone"),
        F.when(open_build & overdue, late).alias("months_late"),
        F.when(open_build & (slip > 0), slip).alias("slip_months"),
    )


def reading_ages(obs: DataFrame, as_of: str) -> DataFrame:
    """Readings held per source and day."""
    return obs.filter(F.col("observed_at") <= day(as_of)).groupBy("source", "observed_at").agg(F.count(F.lit(1)).alias("n"))




def delay_feed(flags: DataFrame, project: DataFrame, developer: DataFrame, limit: int = 60) -> DataFrame:
    """The riskiest delays with project and developer names."""
    names = project.select("project_number", "project_name", "area_slug", "slug", "developer_number")
    top = flags.orderBy(F.desc("risk_score"), F.desc("sales_12m"), "project_number").limit(limit)
    return top.join(names, "project_number").join(developer.select("developer_number", "developer_name"), "developer_number", "left").select(
        *flags.columns, "project_name", "developer_name", F.concat_ws("/", "area_slug", "slug").alias("page"))


def project_history(obs: DataFrame) -> DataFrame:
    """Every reading of every project, numbered in order of date."""
    rows = obs.select("project_number", "observed_at", "status", "percent_completed", "completion_date", "source", reading_order().alias("_o"))
    return number_in_order(rows, ["project_number"], "observed_at", ["_o"], "reading").drop("_o")
