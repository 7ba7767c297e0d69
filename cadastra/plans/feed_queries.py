"""Source, sink and streaming queries: files Spark writes from the given tables, read back through the feeds."""

from functools import reduce

from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.functions.numbers import total
from cadastra.operators import identity, market
from cadastra.plans import identity_queries as iq
from cadastra.plans import market_queries as mq
from cadastra.plans.adapters import AS_OF, RAW, SPARK, texts
from cadastra.plans.listing_queries import ALL, BASE, listing, prices
from cadastra.plans.market_pack import Register, backfill, shared_rents, shared_sales, write_edition
from cadastra.plans.registry import query, tot
from cadastra.plans.resale_queries import pairs
from cadastra.session import materialize, shared_dir
from cadastra.sources import readers, writers
from cadastra.streaming import feeds

TITLE = "upper(substr(area_name,1,1)) || lower(substr(area_name,2))"


def _website_csv(t):
    """Registrations written as a website export: its headers, text values, day-month-year dates."""
    # Packed, as text takes ten times the room of the table; a packed file is read by one task, so its rows are bounded.
    path = shared_dir(t.spark, "website")
    c = F.col
    t.registration_id.select(
        c("transaction_id").alias("TRANSACTION_NUMBER"), F.date_format("instance_date", "dd-MM-yyyy").alias("INSTANCE_DATE"), c("trans_group").alias("GROUP_EN"),
        c("procedure_name").alias("PROCEDURE_EN"), F.when(c("reg_type").startswith("Off"), F.lit("Off-Plan")).otherwise(F.lit("Ready")).alias("IS_OFFPLAN_EN"),
        c("property_type").alias("PROP_TYPE_EN"), F.upper("area_name").alias("AREA_EN"), F.concat("project_number", F.lit(".00")).alias("PROJECT_NUMBER"),
        c("project_name").alias("PROJECT_EN"), F.regexp_replace("rooms", " B/R", " bed rooms+hall").alias("ROOMS_EN"), c("procedure_area").alias("ACTUAL_AREA"),
        F.format_number("actual_worth", 2).alias("TRANS_VALUE"),
    ).write.option("maxRecordsPerFile", FILE_ROWS).csv(path, header=True, compression="gzip")
    return readers.read_register(t.spark, path, readers.TRANSACTION_FIELDS, ["transaction_id", "instance_date", "actual_worth"])


@query("read_website_feed", f"""SELECT trans_group, reg_type, {TITLE} AS area_name, rooms, count(*) AS n, count(DISTINCT project_number) AS projects, {tot("actual_worth")} AS worth, {tot("procedure_area")} AS area,
    {tot("meter_sale_price")} AS psm, min(instance_date) AS first, max(instance_date) AS last, CAST(0 AS BIGINT) AS undated FROM registration_id GROUP BY ALL""")
def _(t):
    rows = readers.type_transactions(_website_csv(t), "web")
    return rows.groupBy("trans_group", "reg_type", "area_name", "rooms").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("project_number").alias("projects"), total("actual_worth").alias("worth"), total("procedure_area").alias("area"),
        total("meter_sale_price").alias("psm"), F.min("instance_date").alias("first"), F.max("instance_date").alias("last"), F.count_if(F.col("instance_date").isNull()).alias("undated"))


@query("read_repaired_csv", """SELECT CAST(p_partkey AS VARCHAR) AS id, 'the ''' || p_name || ''' tower' AS name, p_type AS kind FROM part""")
def _(t):
    path = shared_dir(t.spark, "quoted")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(',"the "'), "p_name", F.lit('" tower",'), "p_type", F.lit("\r"))
    t.raw("part").select(line.alias("value")).write.text(path)
    return readers.read_repaired(t.spark, path, ["id", "name", "kind"])


@query("prune_rents", f"SELECT contract_id, area_name, annual_amount FROM rent WHERE year(contract_start_date) BETWEEN 2000 AND 2100")
def _(t):
    return readers.prune_rents(t.rent, ["contract_id", "area_name", "annual_amount"], 2000)


@query("latest_snapshot", f"""SELECT 'Register_' || strftime(d, '%Y%m%d') || '.csv' AS path, d AS file_date FROM (SELECT max(CAST(ts AS DATE)) AS d FROM events WHERE event_id % 100 >= 3)""")
def _(t):
    files = t.raw("events").select(
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Register_"), F.date_format("ts", "yyyyMMdd"), F.lit(".csv"))).otherwise(
            F.concat(F.lit("Register_"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv"))).alias("path"),
        F.when(F.col("event_id") % 100 >= 3, F.lit(5_000)).otherwise(F.lit(10)).alias("length"), (F.col("user_id") % 2).alias("root_rank"))
    return readers.latest_snapshot(files)


def _scan_files(t):
    path = shared_dir(t.spark, "scans")
    prices(t).select(
        F.lit("site").alias("source"), F.col("listing_id").alias("source_id"), F.lit("").alias("permit_number"), F.lit("").alias("url"), F.lit("Area").alias("area_name_en"),
        F.lit("").alias("project_name_en"), F.lit("").alias("building_name_en"), F.lit("").alias("unit_number"), F.lit("2 B/R").alias("rooms_en"), F.lit("80.5").alias("area_sqm"),
        F.lit("yes").alias("is_off_plan"), F.format_number("asking_price", 2).alias("asking_price"), F.col("observed_at").alias("scan"),
    ).write.partitionBy("scan").csv(path, header=True)
    return path


@query("read_scans", "SELECT 'site:' || listing_id AS listing_id, observed_at, asking_price FROM pr WHERE day(observed_at) % 5 <> 0", pr=BASE["pr"])
def _(t):
    done = prices(t).filter(F.dayofmonth("observed_at") % 5 == 0)
    return readers.read_scans(t.spark, _scan_files(t), done).select("listing_id", "observed_at", "asking_price")


@query("permit_rows", f"""SELECT CAST(o_orderkey AS VARCHAR) AS permit_number, CAST(o_orderdate AS DATE) AS permit_date, o_orderkey % 3 = 0 AS is_new_building FROM orders""")
def _(t):
    c = F.col
    raw = t.raw("orders").select(
        F.when(c("o_orderkey") % 2 == 0, c("o_orderkey").cast("string")).otherwise(F.lit(" ")).alias("permit_number"),
        F.when(c("o_orderkey") % 2 == 1, c("o_orderkey").cast("string")).alias("APPLICATION_NUMBER"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("issue_date"),
        F.when(c("o_orderkey") % 3 == 0, F.lit("New  Construction")).otherwise(F.lit("Building permit - fit out")).alias("permit_type"), F.lit("al quoz").alias("area_en"))
    return readers.permit_rows(raw).select("permit_number", "permit_date", "is_new_building")


@query("normalise_text", f"""SELECT {TITLE} AS area, CASE WHEN p_size % 5 = 0 THEN 'Studio' ELSE CAST(p_size % 5 AS VARCHAR) || ' B/R' END AS rooms, CAST(l_partkey AS VARCHAR) AS project_number, CAST(l_shipdate AS DATE) AS d1, CAST(l_shipdate AS DATE) AS d2, CAST(l_shipdate AS DATE) AS d3, CAST(l_shipdate AS DATE) AS d4,
    l_extendedprice AS worth, lower(replace(p_name, ' ', '-')) AS slug, count(*) AS n FROM (SELECT *, n_name AS area_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) GROUP BY ALL""")
def _(t):
    rows = t.raw("lineitem").join(t.raw("part"), F.col("p_partkey") == F.col("l_partkey")).join(t.raw("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(
        t.raw("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    d = F.col("l_shipdate").cast("date")
    serial = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    beds = F.when(F.col("p_size") % 5 == 0, F.lit("studio flat")).otherwise(F.concat((F.col("p_size") % 5).cast("string"), F.lit(" bed rooms+hall")))
    return rows.select(
        text.norm_area(F.concat(F.lit(" "), F.lower("n_name"))).alias("area"), text.norm_rooms(beds).alias("rooms"),
        text.norm_project_number(F.concat(F.col("l_partkey").cast("string"), F.lit(".00"))).alias("project_number"), text.parse_date(F.date_format(d, "dd-MM-yyyy")).alias("d1"),
        text.parse_date(F.date_format(d, "dd/MM/yyyy")).alias("d2"), text.parse_date(d.cast("string")).alias("d3"), text.parse_date(serial).alias("d4"),
        text.parse_number(F.format_number("l_extendedprice", 2)).alias("worth"), text.slugify(F.concat(F.lit("--"), F.upper("p_name"), F.lit("!"))).alias("slug"),
    ).groupBy("area", "rooms", "project_number", "d1", "d2", "d3", "d4", "worth", "slug").agg(F.count(F.lit(1)).alias("n"))


@query("export_manifest", """SELECT part, rows FROM (SELECT 'all' AS part, count(*) AS rows FROM rent UNION ALL SELECT area_name, count(*) FROM rent GROUP BY 1)""")
def _(t):
    columns = ["contract_id", "contract_start_date", "area_name", "annual_amount"]
    return writers.write_with_manifest(t.rent, shared_dir(t.spark, "export"), columns, {"name": "rents"}, ["area_name"]).select("part", "rows")


@query("replace_if_valid", "SELECT area_name, count(*) AS n FROM rent GROUP BY 1")
def _(t):
    store = shared_dir(t.spark, "store")
    writers.replace_if_valid(t.rent, shared_dir(t.spark, "staging"), store, ["contract_id", "annual_amount"], 1)
    return writers.read_store(t.spark, store).groupBy("area_name").agg(F.count(F.lit(1)).alias("n"))


def _register(t, since: str):
    """The register as editions read it: a week's, a month's or a year's sections all look at this span."""
    sales = shared_sales(t.registration, since, "2001-12-31")
    rents = shared_rents(t.rent, since, "2001-12-31")
    return Register(sales, rents, t.project, t.developer, t.observation, pairs(t), mq.LIMITS, mq.UNIT, mq.BANDS)


@query("monthly_edition", "SELECT * FROM (" + mq._headline_sql() + ")", tagged=mq._tagged("registration", "instance_date", mq.PERIODS), st=mq.sales_stats_sql("tagged"),
       rtag=mq._tagged("rent", "contract_start_date", mq.PERIODS), rt=mq.rent_stats_sql("rtag"))
def _(t):
    """A whole edition, all its sections, written under its kind and key, then the headline read back."""
    path = shared_dir(t.spark, "editions")
    write_edition(_register(t, "1995-01-01"), path, "monthly", "2001-07", AS_OF)
    return writers.read_section(t.spark, path, "headline", "monthly", "2001-07").drop("kind", "key")


SECTIONS = ("headline", "monthly", "yearly", "ytd", "bands", "deals", "areas", "developers", "projects", "yields", "resales", "rent_areas", "same_slice",
            "pipeline_totals", "pipeline_years", "pipeline_areas", "pipeline_developers", "behind", "past_due")


def _edition_rows(t, path, kinds):
    """What the stored editions hold: the headline's figures, and the counted sections' rows and numbers."""
    parts = []
    for section, n in (("headline", None), ("monthly", "n"), ("yearly", "n"), ("bands", "n"), ("areas", "n"), ("projects", "n"), ("deals", None), ("rent_areas", "n")):
        rows = writers.read_section(t.spark, path, section).filter(F.col("kind").isin(*kinds))
        if section == "headline":
            parts.append(rows.select("kind", "key", F.lit(section).alias("section"), F.concat_ws(".", "source", "metric").alias("metric"), F.col("cur").alias("value")))
            parts.append(rows.select("kind", "key", F.lit(section).alias("section"), F.concat_ws(".", "source", "metric", F.lit("yoy")).alias("metric"), F.col("yoy").alias("value")))
        else:
            sums = {"rows": F.count(F.lit(1)), **({"n": F.sum(n)} if n else {})}
            wide = rows.groupBy("kind", "key").agg(*[v.cast("double").alias(k) for k, v in sums.items()])
            parts += [wide.select("kind", "key", F.lit(section).alias("section"), F.lit(k).alias("metric"), F.col(k).alias("value")) for k in sums]
    held = t.spark.read.schema(writers.EDITION).parquet(path).filter(F.col("kind").isin(*kinds) & F.col("columns").isNotNull())
    parts.append(held.groupBy("kind", "key").agg(F.count_distinct("section").cast("double").alias("value")).select("kind", "key", F.lit("all").alias("section"), F.lit("sections").alias("metric"), "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _edition_sql(kind: str, key: str, since: str | None = None) -> str:
    """The same figures of one edition straight from the registers."""
    year_to_date = AS_OF if kind == "yearly" and key == AS_OF[:4] else None
    periods = market.edition_periods(kind, key, since=since, ytd_to=year_to_date)
    (a, b), (c, d) = periods["cur"], periods["yoy"]
    month = market.last_full_month(b)
    span = 36 if kind == "yearly" else 24
    first = market.shift_month(month, 1 - span)
    cur = f"trans_group='Sales' AND instance_date BETWEEN DATE '{a}' AND DATE '{b}'"
    rents = f"{mq.RENT_OK} AND {mq.HOME} AND contract_start_date BETWEEN DATE '{a}' AND DATE '{b}'"
    top = lambda group, table, where, n: f"(SELECT count(*) AS n FROM {table} WHERE {where} AND {group} IS NOT NULL GROUP BY {group} ORDER BY n DESC, {group} LIMIT {n})"
    parts = {
        "monthly": f"SELECT {span}::DOUBLE AS rows, (SELECT count(*) FROM registration WHERE trans_group='Sales' AND instance_date BETWEEN DATE '{first}-01' AND DATE '{market.month_end(month)}')::DOUBLE AS n",
        "yearly": f"SELECT count(DISTINCT year(instance_date))::DOUBLE AS rows, count(*)::DOUBLE AS n FROM registration WHERE trans_group='Sales' AND instance_date BETWEEN DATE '2008-01-01' AND DATE '{b}' HAVING count(*) > 0",
        "bands": f"SELECT {len(mq.BANDS)}::DOUBLE AS rows, count(*)::DOUBLE AS n FROM registration WHERE {cur}",
        "areas": f"SELECT count(*)::DOUBLE AS rows, sum(n)::DOUBLE AS n FROM {top('area_name', 'registration', cur, 20)}",
        "projects": f"SELECT count(*)::DOUBLE AS rows, sum(n)::DOUBLE AS n FROM {top('project_number', 'registration', cur, 15)}",
        "rent_areas": f"SELECT count(*)::DOUBLE AS rows, sum(n)::DOUBLE AS n FROM {top('area_name', 'rent', rents, 15)}",
        "deals": f"SELECT least(12, count(*))::DOUBLE AS rows, NULL AS n FROM registration WHERE {cur} AND property_type <> 'Land'",
    }
    out = [f"SELECT '{s}' AS section, m AS metric, CASE m WHEN 'rows' THEN rows ELSE n END AS value FROM ({sql}), (VALUES ('rows'), ('n')) v(m) WHERE NOT (m = 'n' AND '{s}' = 'deals')" for s, sql in parts.items()]
    head = oracle_of(mq._headline_sql(), tagged=mq._tagged("registration", "instance_date", periods), st=mq.sales_stats_sql("tagged"),
                     rtag=mq._tagged("rent", "contract_start_date", periods), rt=mq.rent_stats_sql("rtag"))
    out.append(f"SELECT 'headline', source || '.' || metric || k, CASE k WHEN '' THEN cur ELSE yoy END FROM ({head}), (VALUES (''), ('.yoy')) v(k)")
    out.append(f"SELECT 'all', 'sections', {len(SECTIONS) - (kind == 'weekly')}::DOUBLE")
    return f"SELECT '{kind}' AS kind, '{key}' AS key, * FROM (" + " UNION ALL ".join(out) + ")"


def oracle_of(body: str, **ctes: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({text})" for name, text in ctes.items()) + " " + body


@query("weekly_edition", _edition_sql("weekly", "2001-07-29", "2001-07-15"))
def _(t):
    """A week's edition; one that is held is not due the next day, and asking for it again leaves it alone."""
    path, register = shared_dir(t.spark, "editions"), _register(t, "1995-01-01")
    write_edition(register, path, "weekly", "2001-07-29", AS_OF, since="2001-07-15")
    if writers.weekly_due(writers.held_editions(t.spark, path), "2001-07-30") or write_edition(register, path, "weekly", "2001-07-29", AS_OF, since="2001-07-01"):
        raise ValueError("an edition that is held was written again")
    return _edition_rows(t, path, ["weekly"])


@query("yearly_edition", _edition_sql("yearly", "2000"))
def _(t):
    path = shared_dir(t.spark, "editions")
    write_edition(_register(t, "1995-01-01"), path, "yearly", "2000", AS_OF)
    return _edition_rows(t, path, ["yearly"])


@query("backfill_editions", " UNION ALL ".join([_edition_sql("monthly", "2001-07"), _edition_sql("yearly", "2001")]))
def _(t):
    """Last month and the year so far; a second run leaves the month alone and writes the year again."""
    path, register = shared_dir(t.spark, "editions"), _register(t, "1995-01-01")
    backfill(register, path, AS_OF, months=1, years=0)
    return _edition_rows(t, path, ["monthly", "yearly"])


# ---- streaming ----

FILE_KEYS = {"lineitem": ["l_shipdate", "l_orderkey"]}
BATCHES = 5
FILE_ROWS = 1_000_000
BROADCAST_ROWS = 500_000


def _met(rows):
    """A table as a batch meets it: one of more than BROADCAST_ROWS rows by a merge join.

    Spark sizes a table by its packed files and the share of the columns read, so the keys of millions of rows look small
    enough to broadcast, and the driver holds them many times as large.
    """
    return rows.hint("merge") if rows.count() > BROADCAST_ROWS else rows


def _files_a_batch(rows: int) -> int:
    """Files of a batch, so many that none holds much more than FILE_ROWS rows however large the table."""
    return max(1, -(-rows // (BATCHES * FILE_ROWS)))


def _stream(t, view: str, name: str):
    """An adapter view with one of its raw tables read as a stream of five batches, the dates mixed; larger tables land in more files a batch."""
    body = texts(SPARK)[view]
    bound = {raw: _met(t.raw(raw)) for raw in RAW if "{" + raw + "}" in body and raw != name}
    path = shared_dir(t.spark, "landed")
    files = _files_a_batch(t.raw(name).count())
    t.raw(name).repartition(BATCHES * files, F.xxhash64(*FILE_KEYS[name])).write.parquet(path)
    return t.spark.sql(body, **bound, **{name: feeds.stream_parquet(t.spark, path, RAW[name], files_per_trigger=files)})


def _to_parquet(t, rows, mode: str = "append"):
    """Run what has landed into a table of the shared folder, one folder per epoch."""
    out = shared_dir(t.spark, "stream")

    def write(batch, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    feeds.run_available(rows.writeStream.outputMode(mode).foreachBatch(write), shared_dir(t.spark, "stream-checkpoint"))
    return t.spark.read.parquet(out)


@query("stream_dedupe", """SELECT trans_group, count(*) AS n, min(first) AS first, CAST(sum(d) AS BIGINT) AS days FROM (
    SELECT trans_group, min(instance_date) AS first, min(instance_date) - DATE '1990-01-01' AS d FROM registration_id GROUP BY trans_group, expected_key) GROUP BY 1""")
def _(t):
    """Five batches, the store settled after the run; of a key's copies the earliest counts, whichever came first."""
    rows = _stream(t, "registration_id", "lineitem").select(
        text.tx_key("transaction_id", "trans_group").alias("tx_key"), "trans_group", F.col("instance_date").cast("timestamp").alias("event_time"))
    path = shared_dir(t.spark, "registrations")
    feeds.run_available(feeds.stream_dedupe(rows, path, order=["event_time"], buckets=16), shared_dir(t.spark, "stream-checkpoint"))
    feeds.compact(t.spark, path, order=["event_time"], buckets=16)
    kept = feeds.registrations(t.spark, path, order=["event_time"])
    since = F.datediff("event_time", F.lit("1990-01-01").cast("date"))
    return kept.groupBy("trans_group").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("event_time")).alias("first"), F.sum(since.cast("long")).alias("days"))


@query("stream_activity", f"""SELECT window_start, area_name, count(*) AS n, {tot("actual_worth")} AS worth FROM (SELECT strftime(DATE '1970-01-01' + CAST((instance_date - DATE '1970-01-01') // 30 - k AS INT)*30, '%Y-%m-%d') AS window_start, area_name, actual_worth
  FROM registration, (VALUES (0), (1)) v(k) WHERE trans_group='Sales') GROUP BY ALL""")
def _(t):
    """Sixty-day windows sliding by thirty days, per area."""
    rows = _stream(t, "registration", "lineitem").filter(F.col("trans_group") == "Sales").withColumn("event_time", F.col("instance_date").cast("timestamp"))
    path = shared_dir(t.spark, "activity")
    feeds.run_available(feeds.stream_activity(rows, path, "event_time", ["area_name"], "60 days", "30 days"), shared_dir(t.spark, "stream-checkpoint"))
    return feeds.activity(t.spark, path, ["area_name"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "area_name", "n", "worth")


@query("stream_lateness", f"SELECT late, CAST(count(*) AS BIGINT) AS rows, CAST(sum(lag) AS BIGINT) AS lag_days FROM (SELECT first_seen - instance_date AS lag, first_seen - instance_date > 12 AS late FROM registration_seen) GROUP BY 1")
def _(t):
    out = shared_dir(t.spark, "lateness")
    rows = _stream(t, "registration_seen", "lineitem").select("first_seen", "instance_date")
    sink = lambda counted, epoch: counted.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    feeds.run_available(feeds.stream_lateness(rows, sink, 12), shared_dir(t.spark, "stream-checkpoint"))
    return t.spark.read.parquet(out).groupBy("late").agg(F.sum("rows").alias("rows"), F.sum("lag_days").alias("lag_days"))


@query("stream_listing_state", """SELECT listing_id, observed_at, asking_price, first_price, streak + 1 AS streak, CAST(sum(is_drop::INT) OVER (PARTITION BY listing_id ORDER BY observed_at) AS BIGINT) AS drops, is_drop FROM (
    SELECT *, first_value(asking_price) OVER (PARTITION BY listing_id ORDER BY observed_at) AS first_price,
      coalesce(prev_seen AND streak >= 2 AND asking_price < prev_price AND (is_off_plan OR prev_price - asking_price >= 10000) AND (prev_price - asking_price)/prev_price >= 0.02::DOUBLE, false) AS is_drop
    FROM st LEFT JOIN (SELECT listing_id, is_off_plan FROM li) USING (listing_id) WHERE seen)""", **{k: ALL[k] for k in ("pr", "ob", "st", "li")})
def _(t):
    """Five files, one a batch, the days of each mixed: every batch brings scans from before those of the last."""
    landed = shared_dir(t.spark, "landed")
    flat = listing(t).select("listing_id", "is_off_plan")
    given = t.price_event.join(flat, "listing_id", "left").select("listing_id", "observed_at", "asking_price", F.coalesce("is_off_plan", F.lit(False)).alias("is_off_plan"), F.col("event_id").alias("filed"))
    given.repartition(5, F.xxhash64("observed_at")).write.parquet(landed)
    rows = feeds.stream_parquet(t.spark, landed, "listing_id STRING, observed_at DATE, asking_price DOUBLE, is_off_plan BOOLEAN, filed LONG", files_per_trigger=1)
    calendar = materialize(feeds.scan_calendar(t.price_event), "calendar")
    with feeds.state_store(t.spark):
        return feeds.listing_state(_to_parquet(t, feeds.stream_listing_state(rows, calendar, feeds.ListingTracker(min_amount=10_000.0))))


@query("stream_upsert", f"""SELECT count(*) AS n, {tot("w")} AS worth, max(d) AS last FROM (SELECT coalesce(w.w, h.actual_worth) AS w, coalesce(w.d, h.instance_date) AS d FROM h LEFT JOIN w USING (tx_key))""", k=iq.KEYED, f=iq.FEEDS, h=iq.HELD,
       w="SELECT tx_key, last(instance_date ORDER BY o) AS d, last(actual_worth ORDER BY o) AS w FROM (SELECT *, row(instance_date, actual_worth, procedure_area) AS o FROM f WHERE feed='web') GROUP BY 1")
def _(t):
    """Website rows land as a log of corrections; the held register is read through it, the newest row of a key first."""
    columns = ["tx_key", "instance_date", "feed_date", "actual_worth", "procedure_area", "meter_sale_price"]
    # Stored once: the join passes over the held rows twice, and their keys take most of its time.
    held = materialize(iq.feeds(t).filter(text.feed_of("transaction_id") != "web").select(*columns), "held-feeds")
    web = _stream(t, "registration_id", "lineitem").filter(F.size(F.split("transaction_id", "-")) == 3).select(
        text.tx_key("transaction_id", "trans_group").alias("tx_key"), *columns[1:])
    path = shared_dir(t.spark, "corrections")
    feeds.run_available(feeds.land(web, path), shared_dir(t.spark, "stream-checkpoint"))
    now = identity.correct_from_register(held, feeds.landed(t.spark, path), ["instance_date", "actual_worth", "procedure_area"])
    return now.agg(F.count(F.lit(1)).alias("n"), total("actual_worth").alias("worth"), F.max("instance_date").alias("last"))


@query("stream_withdrawals", f"""SELECT mark, count(*) AS n FROM (SELECT CASE WHEN r.tx_key IS NULL THEN 'withdrawn' ELSE 'present' END AS mark FROM held h JOIN (SELECT mk.feed_date FROM mk JOIN (SELECT feed_date, count(*) AS n FROM held GROUP BY 1) c USING (feed_date)
    WHERE ok AND mk.feed_date <= DATE '{AS_OF}' - 3 AND returned_rows >= 0.9::DOUBLE*n) d USING (feed_date) LEFT JOIN (SELECT DISTINCT * FROM ret) r ON r.feed_date = h.feed_date AND r.tx_key = h.tx_key) GROUP BY 1""", **iq.WD)
def _(t):
    held, _, _ = iq._withdrawal(t)
    gone = (F.col("procedure_area") == 1) | ((F.dayofmonth("feed_date") == 5) & (F.col("procedure_area") < 20))
    returned = _stream(t, "registration_id", "lineitem").filter(F.col("feed_date").isNotNull() & ~gone).select(
        "feed_date", text.tx_key("transaction_id", "trans_group").alias("tx_key"), (F.dayofmonth("feed_date") != 9).alias("day_ok"))
    path = shared_dir(t.spark, "returned")
    feeds.run_available(feeds.land(returned, path), shared_dir(t.spark, "stream-checkpoint"))
    return feeds.withdrawals(feeds.landed(t.spark, path), held, AS_OF).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


@query("edition_windows", f"""SELECT 'weekly' AS kind, count(*) AS n FROM registration WHERE instance_date BETWEEN DATE '2001-07-16' AND DATE '2001-07-29' UNION ALL SELECT 'yearly', count(*) FROM registration WHERE instance_date BETWEEN DATE '2001-01-01' AND DATE '{AS_OF}'""")
def _(t):
    weekly = market.edition_periods("weekly", "2001-07-29", since="2001-07-15")["cur"]
    yearly = market.edition_periods("yearly", "2001", ytd_to=AS_OF)["cur"]
    rows = market.tag_periods(t.registration, "instance_date", {"weekly": weekly, "yearly": yearly})
    return rows.groupBy(F.col("period").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


