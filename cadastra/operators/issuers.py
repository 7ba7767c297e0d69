"""Bond-issuing developers: register table, escrow projection, liquidity, instruments, ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.numbers import count_where, day, days_before, half_up, mean, months_apart, ratio, total
from cadastra.functions.predicates import (
    DEFAULT_LIMITS, LIVE_STATUSES, MORTGAGES, SALES, SELL, Limits, is_developer_sale, is_home, is_sale, re_registration,
)
from cadastra.functions.text import capacity_basis, first_contains, home_capacity
from cadastra.operators.readings import latest_as_of

# Scenario inputs; rates are fractions, times are months, the cap is points a month.
SCENARIOS = (
    {"name": "Base", "delay": 0, "pastdue": 6, "undated": 24, "cancel": 0.0, "sell": 0.6, "price": 0.0, "book": 0.10, "hand": 0.30, "ret": 0.05, "cap": 8.0},
    {"name": "Delayed handovers", "delay": 6, "pastdue": 12, "undated": 30, "cancel": 0.0, "sell": 0.4, "price": 0.0, "book": 0.10, "hand": 0.30, "ret": 0.05, "cap": 6.0},
    {"name": "Cancellation spike", "delay": 0, "pastdue": 6, "undated": 24, "cancel": 0.15, "sell": 0.4, "price": 0.0, "book": 0.10, "hand": 0.30, "ret": 0.05, "cap": 8.0},
    {"name": "Price cut", "delay": 0, "pastdue": 6, "undated": 24, "cancel": 0.05, "sell": 0.6, "price": -0.15, "book": 0.10, "hand": 0.30, "ret": 0.05, "cap": 8.0},
)
AED_PER_USD = 3.6725

# Words that tell the escrow agents apart, and their English names, first match wins.
ESCROW_AGENTS = (
    ("بنك دبي", "Dubai Islamic Bank"), ("الإمارات دبي", "Emirates NBD"), ("الشارقه", "Sharjah Islamic Bank"),
    ("ابوظبى الاسلامي", "Abu Dhabi Islamic Bank"), ("أبوظبي الأول", "First Abu Dhabi Bank"), ("أبوظبي ا", "First Abu Dhabi Bank"),
    ("الفجيره", "National Bank of Fujairah"), ("العربي", "Arab Bank"), ("المشرق", "Mashreq"), ("أبوظبي التجاري", "Abu Dhabi Commercial Bank"),
)


def issuer_register(
    project: DataFrame, obs: DataFrame, tx: DataFrame, pairs: DataFrame, issuers: DataFrame, as_of: str, balance_sheet: str,
    current_from: str, limits: Limits = DEFAULT_LIMITS, agents: Sequence[tuple[str, str]] = ESCROW_AGENTS,
) -> DataFrame:
    """One row per project of the issuers' developers (``issuers``: developer_number, issuer).

    All sales and mortgage measures come from one grouped pass over registrations, so the joins
    that follow carry projects only. A developer's sale is one of three procedures on a home.
    """
    c, d, worth = F.col, F.col("instance_date"), F.col("actual_worth")
    sale, mortgage, home = is_sale(), c("trans_group") == MORTGAGES, is_home(limits)
    dev_home, dev_parcel = sale & is_developer_sale() & home, sale & is_developer_sale() & ~home
    y1, y2, d90 = d >= days_before(as_of, 365), d >= days_before(as_of, 730), d >= days_before(as_of, 90)
    since_bs = d >= day(balance_sheet)
    measures = tx.filter(c("trans_group").isin(SALES, MORTGAGES) & c("project_number").isNotNull()).groupBy("project_number").agg(
        count_where(sale).alias("all_sales"), F.min(F.when(sale, d)).alias("first_sale"), F.max(F.when(sale, d)).alias("last_sale"),
        count_where(dev_home).alias("offplan_sales_all"), total(F.when(dev_home, worth)).alias("offplan_value"),
        count_where(dev_parcel).alias("parcel_sales"), F.coalesce(total(F.when(dev_parcel, worth)), F.lit(0.0)).alias("parcel_value"),
        count_where(sale & home & y1).alias("sales_12m"), total(F.when(sale & home & y1, worth)).alias("value_12m"),
        mean(F.when(sale & home & y1, c("meter_sale_price")), 2).alias("avg_psm_12m"), count_where(sale & home & y1 & d90).alias("sales_90d"),
        count_where(sale & y2 & ~y1).alias("sales_prior_12m"), count_where(mortgage & y1).alias("mortgages_12m"),
        count_where(sale & (c("procedure_name") == SELL) & since_bs).alias("ready_sales_since_bs"), count_where(mortgage & since_bs).alias("mortgages_since_bs"),
    )
    resold = pairs.filter(
        (c("sold_on") >= days_before(as_of, 730)) & (c("ambiguity") == 0) & ~re_registration(c("change_pct"), c("hold_days"))
    ).groupBy("project_number").agg(
        F.count(F.lit(1)).alias("resales_24m"), count_where(c("change_pct") < 0).alias("resales_at_loss"),
        half_up(half_up(F.sum("change_pct"), 6) / F.count(F.lit(1)) * 100, 2).alias("avg_resale_change_pct"),
        half_up(F.sum("hold_days") / F.count(F.lit(1)), 2).alias("avg_hold_days"),
    )
    first = obs.filter(c("completion_date").isNotNull()).groupBy("project_number").agg(F.min("completion_date").alias("first_seen_completion"))
    rows = (
        project.join(issuers, "developer_number")
        .join(latest_as_of(obs, as_of), "project_number", "left").join(first, "project_number", "left")
        .join(measures, "project_number", "left").join(resold, "project_number", "left")
        .withColumn("_homes", home_capacity())
    )
    sold = F.least(F.coalesce("_homes", "offplan_sales_all"), F.coalesce("offplan_sales_all", F.lit(0)))
    zero = lambda name: F.coalesce(c(name), F.lit(0)).alias(name)
    return rows.select(
        "issuer", "project_number", "project_name", "area_name", "status", c("percent_completed").alias("certified_pct"),
        c("completion_date").alias("registered_completion"), "first_seen_completion", c("observed_at").alias("last_read"),
        c("_homes").alias("units"), sold.alias("sold_units"),
        half_up(F.when(c("offplan_sales_all") > 0, c("offplan_value") / c("offplan_sales_all")), 2).alias("avg_ticket"),
        "offplan_sales_all", "offplan_value", "all_sales", "sales_12m", "value_12m", "sales_prior_12m", "sales_90d", "avg_psm_12m",
        "mortgages_12m", "resales_24m", "resales_at_loss", "avg_resale_change_pct", "avg_hold_days",
        first_contains("escrow_agent", agents).alias("escrow_agent"), "first_sale", "last_sale",
        c("project_start_date").alias("project_start"), F.coalesce(c("status").isin(*LIVE_STATUSES), F.lit(False)).alias("is_live"),
        zero("ready_sales_since_bs"), zero("mortgages_since_bs"),
        F.coalesce(c("observed_at") >= day(current_from), F.lit(False)).alias("reading_current"), capacity_basis().alias("capacity_basis"),
        zero("parcel_sales"), F.coalesce("parcel_value", F.lit(0.0)).alias("parcel_value"),
    )


def handover_candidates(register: DataFrame, as_of: str, balance_sheet: str, finished_since: str, unit: float = 1e6) -> DataFrame:
    """Projects that could have handed over since the accounts, resting on a current reading only."""
    c, pct = F.col, F.coalesce("certified_pct", F.lit(0.0))
    done = F.coalesce((c("status") == "FINISHED") & (c("registered_completion") >= day(finished_since)), F.lit(False))
    near = c("is_live") & (pct >= 60)
    past = F.coalesce(c("is_live") & (c("registered_completion") <= day(as_of)) & (pct >= 30), F.lit(False))
    after = F.coalesce((c("status") == "FINISHED") & (c("registered_completion") > day(balance_sheet)), F.lit(False))
    return register.filter(c("reading_current") & (done | near | past)).select(
        "issuer", "project_number", "project_name", "units", "sold_units",
        half_up(F.coalesce("sold_units", F.lit(0)) * F.coalesce("avg_ticket", F.lit(0.0)) / unit).alias("contracted"), "certified_pct",
        "registered_completion", "status", "ready_sales_since_bs", "mortgages_since_bs", after.alias("completed_after_accounts"), "last_read",
        ((c("ready_sales_since_bs") + c("mortgages_since_bs")) > 0).alias("corroborated"),
    )


def issuer_summary(register: DataFrame, tx: DataFrame, as_of: str, balance_sheet: str, unit: float = 1e6) -> DataFrame:
    """Totals per issuer beside the whole market's last twelve months."""
    c, live = F.col, F.col("is_live")
    contracted = F.coalesce("sold_units", F.lit(0)) * F.coalesce("avg_ticket", F.lit(0.0))
    market = tx.filter(is_sale() & (c("instance_date") >= days_before(as_of, 365))).agg(
        F.count(F.lit(1)).alias("n"), half_up(total("actual_worth") / unit).alias("v"))
    done = F.coalesce((c("status") == "FINISHED") & (c("registered_completion") > day(balance_sheet)), F.lit(False))
    return register.groupBy("issuer").agg(
        F.count(F.lit(1)).alias("projects"), count_where(live).alias("live_projects"), count_where(live & c("reading_current")).alias("live_read_current"),
        F.min("last_read").alias("register_read_from"), F.coalesce(F.sum(F.when(live, c("units"))), F.lit(0)).alias("live_units"),
        F.coalesce(F.sum(F.when(live, c("sold_units"))), F.lit(0)).alias("live_sold_units"),
        half_up(F.coalesce(total(F.when(live, contracted)), F.lit(0.0)) / unit).alias("live_contracted"),
        count_where(live & (c("registered_completion") < day(as_of))).alias("past_due_projects"),
        F.coalesce(F.sum("sales_12m"), F.lit(0)).alias("sales_12m"), half_up(F.coalesce(total("value_12m"), F.lit(0.0)) / unit).alias("value_12m"),
        count_where(done).alias("completed_since_accounts"),
    ).withColumns({"market_sales_12m": market.select("n").scalar(), "market_value_12m": market.select("v").scalar()})


def stale_readings(register: DataFrame) -> DataFrame:
    """Live projects resting on a reading that is not current."""
    return register.filter(F.col("is_live") & ~F.col("reading_current")).select("issuer", "project_number", "project_name", "last_read", "certified_pct")


# ---- escrow ----

def collected_share(p: Column, book: Column, hand: Column) -> Column:
    """Share of the price collected at certified progress p."""
    return F.when(p >= 100, F.lit(1.0)).otherwise(book + (1 - book - hand) * p / 100)


def released_share(p: Column, book: Column, hand: Column) -> Column:
    """Share released from escrow: collections drawn down in step with progress."""
    return collected_share(p, book, hand) * F.least(F.lit(1.0), p / 100)


def with_scenarios(rows: DataFrame, scenarios: Sequence[dict] = SCENARIOS) -> DataFrame:
    """Each row once per scenario; the scenarios are literals, so nothing is joined."""
    each = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in scenarios])
    return rows.withColumn("s", F.explode(each))


def escrow_projection(register: DataFrame, as_of: str, horizons: Sequence[int], scenarios: Sequence[dict] = SCENARIOS, unit: float = 1e6) -> DataFrame:
    """Further escrow release of each live project by each horizon (months after the as-of date), per scenario."""
    c = F.col
    base = register.filter(c("is_live")).select(
        "issuer", "project_number", "project_name", "status", "registered_completion",
        F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("sold_units", F.lit(0)).alias("sold"),
        F.coalesce("avg_ticket", F.lit(0.0)).alias("ticket"), F.coalesce("certified_pct", F.lit(0.0)).alias("cert"),
    )
    as_of_d, s = day(as_of), lambda k: F.col(f"s.{k}")
    rows = with_scenarios(base, scenarios)
    projected = (
        F.when(c("registered_completion").isNull(), F.add_months(as_of_d, s("undated")))
        .when(c("registered_completion") < as_of_d, F.add_months(as_of_d, s("pastdue")))
        .otherwise(F.add_months("registered_completion", s("delay")))
    )
    contracted = c("sold") * c("ticket") / unit
    unsold = F.greatest(F.lit(0), c("units") - c("sold"))
    rows = rows.withColumn("projected", projected).withColumns({
        "contracted": contracted, "unsold": unsold, "months": F.greatest(F.lit(1), months_apart(as_of_d, projected)),
        "effective": contracted * (1 - s("cancel")) + unsold * c("ticket") / unit * s("sell") * (1 + s("price")),
        "released": contracted * released_share(c("cert"), s("book"), s("hand")) * (1 - s("ret")),
        "collected": contracted * collected_share(c("cert"), s("book"), s("hand")),
    })
    rows = rows.withColumn("pace", F.least(s("cap"), (100 - c("cert")) / c("months")))
    ahead = rows.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    p = F.least(F.lit(100.0), c("cert") + c("pace") * c("horizon"))
    release = F.greatest(F.lit(0.0), c("effective") * released_share(p, s("book"), s("hand")) * (1 - s("ret")) - c("released"))
    return ahead.select(
        "issuer", "project_number", "project_name", "status", "cert", "registered_completion", c("s.name").alias("scenario"), "horizon",
        "projected", "months", "pace", "contracted", "unsold", F.when(c("units") > 0, c("sold") / c("units")).otherwise(F.lit(0.0)).alias("sold_share"),
        "effective", "released", "collected", release.alias("release"),
    )


def escrow_totals(projection: DataFrame) -> DataFrame:
    """Release by scenario and horizon over an issuer's live projects, with what escrow holds by the model."""
    f = lambda name: total(name, 4).alias(name)
    return projection.groupBy("issuer", "scenario", "horizon").agg(
        F.count(F.lit(1)).alias("projects"), f("contracted"), f("effective"), f("collected"), f("released"), f("release"),
    ).withColumn("held", half_up(F.col("collected") - F.col("released"), 4))


def monthly_release(totals: DataFrame) -> DataFrame:
    """Release in each month out of the cumulative figures (horizons 1, 2, 3, …)."""
    from pyspark.sql import Window

    by_month = Window.partitionBy("issuer", "scenario").orderBy("horizon")
    return totals.select(
        "issuer", "scenario", "horizon", F.col("release").alias("cumulative"),
        half_up(F.col("release") - F.coalesce(F.lag("release").over(by_month), F.lit(0.0)), 4).alias("in_month"),
    )


def debt_due(instruments: DataFrame, as_of: str, horizons: Sequence[int], amount: str = "amount") -> DataFrame:
    """Debt falling due by each horizon and in its month, per issuer."""
    due = instruments.filter(F.col("maturity").isNotNull())
    ahead = due.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    by = F.last_day(F.add_months(day(as_of), F.col("horizon")))
    return ahead.groupBy("issuer", "horizon").agg(
        F.coalesce(total(F.when(F.col("maturity") <= by, F.col(amount))), F.lit(0.0)).alias("debt_due"),
        F.coalesce(total(F.when(F.trunc("maturity", "MM") == F.trunc(by, "MM"), F.col(amount))), F.lit(0.0)).alias("due_in_month"),
    )


def liquidity_coverage(totals: DataFrame, debt: DataFrame, cash: DataFrame) -> DataFrame:
    """Cash outside escrow plus modelled release against debt due, per scenario and horizon."""
    from pyspark.sql import Window

    c = F.col
    rows = totals.select("issuer", "scenario", "horizon", "release").join(debt, ["issuer", "horizon"]).join(cash, "issuer")
    running = Window.partitionBy("issuer", "scenario").orderBy("horizon").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    available = c("cash") + c("release")
    return rows.select(
        "issuer", "scenario", "horizon", "debt_due", "cash", "release", half_up(F.when(c("debt_due") > 0, available / c("debt_due")), 4).alias("coverage"),
        half_up(F.greatest(F.lit(0.0), c("debt_due") - available), 2).alias("shortfall"),
        half_up(available - F.sum("due_in_month").over(running), 2).alias("running_cash"),
    )


def release_rules(
    register: DataFrame, cost_shares: Sequence[float] = (0.55, 0.65), scenario: dict | None = None, unit: float = 1e6,
    own_readings: DataFrame | None = None, booking: DataFrame | None = None,
) -> DataFrame:
    """Escrow held under the value rule and under a construction-cost rule, per issuer, reading and cost share.

    ``own_readings`` (project_number, own_pct) adds the issuer's own readings beside the register's; a project it leaves out
    keeps the register's. ``booking`` (issuer, book) gives issuers a share paid at booking of their own.
    """
    s, c = scenario or SCENARIOS[0], F.col
    rows = register.filter(c("is_live")).withColumn("cost_share", F.explode(F.array(*[F.lit(x) for x in cost_shares])))
    cert = F.coalesce("certified_pct", F.lit(0.0))
    readings = [F.struct(F.lit("register").alias("reading"), cert.alias("cert"))]
    if own_readings is not None:
        own = own_readings.groupBy("project_number").agg(F.max("own_pct").alias("_own"))
        rows = rows.join(own, "project_number", "left")
        readings.append(F.struct(F.lit("issuer").alias("reading"), F.coalesce("_own", cert).alias("cert")))
    rows = rows.withColumn("_r", F.explode(F.array(*readings))).withColumns({"reading": c("_r.reading"), "_cert": c("_r.cert")})
    book, hand = F.lit(s["book"]), F.lit(s["hand"])
    if booking is not None:
        rows = rows.join(booking.groupBy("issuer").agg(F.max("book").alias("_book")), "issuer", "left")
        book = F.coalesce("_book", book)
    cert, ticket = c("_cert"), F.coalesce("avg_ticket", F.lit(0.0))
    units, sold = F.coalesce("units", F.lit(0)), F.coalesce("sold_units", F.lit(0))
    contracted = sold * ticket / unit
    collected = contracted * collected_share(cert, book, hand)
    released = contracted * released_share(cert, book, hand) * (1 - s["ret"])
    tower = F.when(units > 0, units).otherwise(sold) * ticket / unit
    by_cost = F.least(collected, c("cost_share") * tower * cert / 100 + 0.05 * contracted)
    return rows.groupBy("issuer", "reading", "cost_share").agg(
        total(collected, 4).alias("collected"), total(collected - released, 4).alias("value_rule_held"),
        total(collected - by_cost, 4).alias("cost_rule_held"))


def top_release(projection: DataFrame, scenario: str, horizon: int, n: int = 10) -> DataFrame:
    """The projects that matter most by a horizon."""
    return projection.filter((F.col("scenario") == scenario) & (F.col("horizon") == horizon)).orderBy(
        F.desc("release"), "project_number").limit(n).select(
        "issuer", "project_number", "project_name", "status", "cert", "registered_completion", "projected", half_up("sold_share", 4).alias("sold_share"),
        half_up("release", 4).alias("release"))


def escrow_usable(register: DataFrame) -> DataFrame:
    """Whether a register row can enter the escrow model, and why not."""
    c = F.col
    reason = (
        F.when(~c("is_live"), F.lit("not live")).when(F.coalesce("sold_units", F.lit(0)) == 0, F.lit("no sales"))
        .when(F.coalesce("avg_ticket", F.lit(0.0)) == 0, F.lit("no ticket")).when(c("certified_pct").isNull(), F.lit("no reading"))
    )
    return register.select("issuer", "project_number", reason.isNull().alias("usable"), reason.alias("reason"))


# ---- dossiers ----

def parse_instruments(dossiers: DataFrame) -> DataFrame:
    """Coupon, maturity, kind and bid/ask read from each instrument's own wording; nothing is guessed."""
    rows = dossiers.select("issuer", F.explode("bonds").alias("b")).select("issuer", "b.*")
    found = lambda pattern, group, text="name": F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    coupon = found(r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double") / 100
    due = r"due\s+(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})"
    stamp = F.concat_ws(" ", found(due, 1), F.initcap(found(due, 2)), found(due, 3))
    low = F.lower("name")
    kind = (
        F.when(low.contains("payable") | low.contains("land"), F.lit("Other"))
        .when(low.contains("sukuk") | low.contains("bond") | low.contains("note"), F.lit("Sukuk")).otherwise(F.lit("Bank"))
    )
    quote = r"^\s*([\d.]+)\s*/\s*([\d.]+)"
    return rows.select(
        "issuer", "name", "isin", kind.alias("kind"), F.col("sizeUsdM").alias("usd_m"), coupon.alias("coupon"),
        F.try_to_date(F.when(found(due, 3).isNotNull(), stamp), "d MMM yyyy").alias("maturity"),
        found(quote, 1, "price").try_cast("double").alias("bid"), found(quote, 2, "price").try_cast("double").alias("ask"),
    )


def priced_instruments(instruments: DataFrame) -> DataFrame:
    """Instruments whose coupon, maturity and bid are all known, in dirhams."""
    return instruments.filter(F.col("coupon").isNotNull() & F.col("maturity").isNotNull() & F.col("bid").isNotNull()).withColumn(
        "aed_m", half_up(F.col("usd_m") * AED_PER_USD, 4))


def headroom_horizons(instruments: DataFrame, as_of: str) -> DataFrame:
    """First maturity on or after the date, then the two year ends after it."""
    first = instruments.filter(F.col("maturity") >= day(as_of)).groupBy("issuer").agg(F.min("maturity").alias("h1"))
    end = F.make_date(F.year("h1"), F.lit(12), F.lit(31))
    h2 = F.when(end <= F.col("h1"), F.make_date(F.year("h1") + 1, F.lit(12), F.lit(31))).otherwise(end)
    return first.withColumn("h2", h2).withColumn("h3", F.make_date(F.year("h2") + 1, F.lit(12), F.lit(31)))


def maturity_wall(dossiers: DataFrame) -> DataFrame:
    """Debt by maturity year across issuers, in dollars and dirhams."""
    return dossiers.select("issuer", F.explode("maturityWall").alias("w")).groupBy("w.year").agg(
        total("w.usdM").alias("usd_m"), total("w.sukukUsdM").alias("sukuk_usd_m"), F.count_distinct("issuer").alias("issuers"),
    ).withColumn("aed_m", half_up(F.col("usd_m") * AED_PER_USD, 2))


def credit_ratios(dossiers: DataFrame) -> DataFrame:
    """Leverage, cover and liquidity per reporting period; half years annualised."""
    c = F.col
    rows = dossiers.select("issuer", "financeCostOnBorrowings", F.explode("periods").alias("p")).select("issuer", "financeCostOnBorrowings", "p.*")
    factor = F.lit(12.0) / c("months")
    ebitda, cost = c("ebitda") * factor, c("financeCost") * factor
    free = c("cash") - c("escrow")
    times = lambda a, b: half_up(F.when(b > 0, a / b), 4)
    borrowing = c("financeCostOnBorrowings.aedM") * (F.lit(12.0) / F.coalesce("financeCostOnBorrowings.periodMonths", F.lit(12)))
    return rows.select(
        "issuer", "label", half_up(free, 4).alias("cash_outside_escrow"), half_up(ebitda, 4).alias("ebitda_annual"), half_up(cost, 4).alias("finance_cost_annual"),
        times(c("debt"), ebitda).alias("debt_ebitda"), times(c("debt") - free, ebitda).alias("net_debt_ebitda"),
        times(c("debt") - c("cash"), ebitda).alias("company_net_debt_ebitda"), times(c("debt") - free, c("equity")).alias("net_debt_equity"),
        times(c("debt"), c("equity")).alias("debt_equity"), times(ebitda, cost).alias("ebitda_cover"), times(c("escrow"), c("cash")).alias("escrow_share"),
        half_up(borrowing, 4).alias("borrowing_cost_annual"), half_up(F.when(c("debt") > 0, ratio(borrowing, c("debt"))), 4).alias("implied_rate"),
    )
