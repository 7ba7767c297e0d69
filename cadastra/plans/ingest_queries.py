"""Ingest queries: every feed written as its publisher writes it, then read, typed and compared with what was written."""

from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.functions.numbers import total
from cadastra.plans.adapters import AS_OF
from cadastra.plans.issuer_queries import dossiers
from cadastra.plans.listing_queries import BASE
from cadastra.plans.feed_queries import _scan_files, _to_parquet
from cadastra.plans.registry import cnt, query, tot
from cadastra.session import shared_dir
from cadastra.sources import ingest, readers, writers
from cadastra.streaming import feeds

N = "CAST(project_number AS INT)"
# What the staged files leave out or write wrongly, by project number.
PLANNED = "CASE WHEN project_start_date IS NOT NULL THEN project_start_date + 1000 END"
ACTUAL = f"CASE WHEN {N} % 3 = 0 AND project_start_date IS NOT NULL THEN project_start_date + 900 END"
STAMP = f"CASE WHEN {N} % 7 = 0 THEN DATE '2001-06-15' WHEN {N} % 7 = 1 THEN NULL ELSE DATE '2001-07-01' + CAST({N} % 20 AS INT) END"
CONTENT_DATES = {"2001-06-15": "2000-10-13"}


def _projects_csv(t) -> str:
    """The project register as one of its exports: its headers, numbers with a decimal part, dates day first, some values not readable."""
    path, n = shared_dir(t.spark, "projects"), F.col("project_number").cast("int")
    date = lambda c: F.date_format(c, "dd-MM-yyyy")
    start = F.col("project_start_date")
    stamp = F.when(n % 7 == 0, F.lit("2001-06-15 03:00:00")).when(n % 7 != 1, F.concat(F.date_add(F.lit("2001-07-01").cast("date"), n % 20).cast("string"), F.lit(" 03:00:00")))
    t.project.select(
        F.when(n % 50 != 0, F.concat("project_number", F.lit(".00"))).alias("PROJECT_NUMBER"), F.concat(F.lit(" "), "project_name").alias("PROJECT_EN"), F.upper("area_name").alias("AREA_EN"),
        "developer_number", date("cancellation_date").alias("cancellation_date"), F.col("master_project").alias("MASTER_PROJECT_EN"), F.col("escrow_agent").alias("escrow_agent_name_en"),
        F.when(n % 11 == 0, F.lit("soon")).otherwise(date(start)).alias("START_DATE"), date(F.date_add(start, 1000)).alias("END_DATE"), F.when(n % 3 == 0, date(F.date_add(start, 900))).alias("COMPLETION_DATE"),
        F.when(n % 13 == 0, F.lit("n/a")).otherwise((n % 120).cast("string")).alias("PERCENT_COMPLETED"), F.when(n % 2 == 0, F.lit("ACTIVE")).otherwise(F.lit("FINISHED")).alias("PROJECT_STATUS"),
        stamp.alias("load_timestamp"), F.format_number("project_value", 2).alias("PROJECT_VALUE"), F.col("units").cast("string").alias("CNT_UNIT"), F.col("villas").cast("string").alias("CNT_VILLA"),
        F.col("lands").cast("string").alias("CNT_LAND"), F.col("buildings").cast("string").alias("CNT_BUILDING"),
    ).write.csv(path, header=True)
    return path


def _projects(t):
    raw = t.spark.read.csv(_projects_csv(t), header=True, inferSchema=False)
    return ingest.type_feed(raw, ingest.PROJECTS)


START = f"CASE WHEN {N} % 11 <> 0 THEN project_start_date END"


@query("ingest_projects", f"""SELECT project_number, trim(project_name) AS project_name, upper(substr(area_name,1,1)) || lower(substr(area_name,2)) AS area_name, developer_number, cancellation_date, nullif(master_project, '') AS master_project, escrow_agent,
    {START} AS project_start_date, coalesce({ACTUAL}, {PLANNED}) AS completion_date, project_value, CAST(units AS BIGINT) AS units, CAST(villas AS BIGINT) AS villas FROM project WHERE {N} % 50 <> 0""")
def _(t):
    rows, _ = _projects(t)
    return ingest.project_register(rows).select(
        "project_number", "project_name", "area_name", "developer_number", "cancellation_date", "master_project", "escrow_agent", "project_start_date", "completion_date", "project_value", "units", "villas")


@query("feed_rejects", f"""SELECT 'projects' AS feed, 'project_number' AS field, CAST(NULL AS VARCHAR) AS value, true AS dropped, {cnt(f"{N} % 50 = 0")} AS n FROM project
  UNION ALL SELECT 'projects', 'project_start_date', 'soon', false, {cnt(f"{N} % 11 = 0")} FROM project UNION ALL SELECT 'projects', 'percent_completed', 'n/a', false, {cnt(f"{N} % 13 = 0")} FROM project""")
def _(t):
    _, rejects = _projects(t)
    return rejects.groupBy("feed", "field", "value", "dropped").agg(F.count(F.lit(1)).alias("n"))


@query("load_readings", f"""SELECT project_number, CASE WHEN st = DATE '2001-06-15' THEN DATE '2000-10-13' ELSE coalesce(st, DATE '{AS_OF}') END AS observed_at, CASE WHEN {N} % 2 = 0 THEN 'ACTIVE' ELSE 'FINISHED' END AS status,
    CASE WHEN {N} % 13 <> 0 THEN ({N} % 120)::DOUBLE END AS percent_completed, coalesce({ACTUAL}, {PLANNED}) AS completion_date, 'dld' AS source FROM (SELECT *, {STAMP} AS st FROM project) WHERE {N} % 50 <> 0""")
def _(t):
    rows, _ = _projects(t)
    return ingest.load_readings(rows, AS_OF, CONTENT_DATES)


def _readings_csv(t) -> str:
    """Readings as the gateway and the extracts give them; every fourth without an inspection date, some above 100 or below 0."""
    path, c = shared_dir(t.spark, "readings"), F.col
    percent = F.when(c("id") % 6 == 0, None).when(c("id") % 10 == 1, c("percent_completed") + 150).when(c("id") % 10 == 3, -c("percent_completed") - 1).otherwise(c("percent_completed"))
    t.observation.select(
        c("project_number").alias("PROJECT_NUMBER"), c("status").alias("PROJECT_STATUS"), percent.cast("string").alias("PERCENT_COMPLETED"),
        F.when(c("id") % 4 != 0, F.date_format("observed_at", "dd/MM/yyyy")).alias("INSPECTION_DATE"), F.when(c("id") % 5 == 0, F.date_add("completion_date", -30).cast("string")).alias("COMPLETION_DATE"),
        c("completion_date").cast("string").alias("END_DATE"), (c("id") % 40).cast("string").alias("CNT_UNIT"), c("id").cast("string").alias("SERIAL"),
    ).write.csv(path, header=True)
    return path


def _readings(t):
    raw = t.spark.read.csv(_readings_csv(t), header=True, inferSchema=False)
    return ingest.type_feed(raw, ingest.READINGS)[0]


READ = "SELECT *, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 10 = 1 THEN percent_completed + 150 WHEN id % 10 = 3 THEN -percent_completed - 1 ELSE percent_completed END AS pct, CASE WHEN id % 5 = 0 THEN completion_date - 30 ELSE completion_date END AS done FROM observation"
_SUMS = f"count(*) AS n, count(percent_completed) AS stated, {tot('percent_completed', 4)} AS percent, min(completion_date) AS first, max(completion_date) AS last"


def _summed(rows, *keys):
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("percent_completed").alias("stated"), total("percent_completed", 4).alias("percent"), F.min("completion_date").alias("first"), F.max("completion_date").alias("last"))


@query("gateway_readings", f"""SELECT project_number, observed_at, status, undated, above, {_SUMS} FROM (SELECT project_number, CASE WHEN id % 4 = 0 THEN DATE '{AS_OF}' ELSE observed_at END AS observed_at, status, id % 4 = 0 AS undated,
    coalesce(pct > 100, false) AS above, CASE WHEN pct <= 100 THEN pct END AS percent_completed, done AS completion_date FROM r) GROUP BY ALL""", r=READ)
def _(t):
    return _summed(ingest.gateway_readings(_readings(t), AS_OF), "project_number", "observed_at", "status", "undated", "above")


@query("workbook_readings", f"""SELECT project_number, observed_at, status, {_SUMS} FROM (SELECT project_number, CASE WHEN id % 4 = 0 THEN DATE '{AS_OF}' ELSE observed_at END AS observed_at, status,
    CASE WHEN pct BETWEEN 0 AND 100 THEN pct END AS percent_completed, done AS completion_date FROM r WHERE NOT (id % 4 = 0 AND pct IS NOT NULL)) GROUP BY ALL
  UNION ALL SELECT 'left out', NULL, NULL, count(*), count(*), {tot("pct", 4)}, min(done), max(done) FROM r WHERE id % 4 = 0 AND pct IS NOT NULL""", r=READ)
def _(t):
    held, left_out = ingest.workbook_readings(_readings(t), AS_OF)
    apart = _summed(left_out, F.lit("left out").alias("project_number")).withColumns({"observed_at": F.lit(None).cast("date"), "status": F.lit(None).cast("string")})
    return _summed(held, "project_number", "observed_at", "status").unionByName(apart)


@query("new_project_units", f"""SELECT status, {cnt("status <> 'FINISHED'")} AS counted, CAST(coalesce(sum(CASE WHEN status <> 'FINISHED' THEN id % 40 END), 0) AS BIGINT) AS units FROM observation GROUP BY 1""")
def _(t):
    return ingest.new_project_units(_readings(t)).groupBy("status").agg(F.count("units").alias("counted"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"))


@query("typed_snapshot", f"""SELECT project_number, observed_at, status, {_SUMS}, CAST(sum(id % 40) AS BIGINT) AS units FROM (SELECT project_number, CASE WHEN id % 4 <> 0 THEN observed_at END AS observed_at, status, pct AS percent_completed, completion_date, id FROM r) GROUP BY ALL""", r=READ)
def _(t):
    raw = t.spark.read.csv(_readings_csv(t), header=True, inferSchema=False).withColumns({c: F.lit(None).cast("string") for c in ("PROJECT_EN", "DEVELOPER_EN", "AREA_EN")})
    rows = readers.type_snapshot(raw)
    return _summed(rows, "project_number", "observed_at", "status").join(
        rows.groupBy("project_number", "observed_at", "status").agg(F.sum("units").alias("units")).select(*[F.col(c).alias(f"_{c}") for c in ("project_number", "observed_at", "status")], "units"),
        [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("project_number", "observed_at", "status")]).drop("_project_number", "_observed_at", "_status")


@query("ingest_rents", f"""SELECT contract_reg_type, upper(substr(area_name,1,1)) || lower(substr(area_name,2)) AS area_name, rent_property_type, nullif(rooms, '') AS rooms, count(*) AS n, count(DISTINCT project_number) AS projects, {tot("annual_amount")} AS amount, {tot("actual_area")} AS area,
    min(contract_start_date) AS first, max(contract_start_date) AS last FROM rent GROUP BY ALL""")
def _(t):
    path = shared_dir(t.spark, "rents")
    t.rent.select(
        F.col("contract_id").alias("CONTRACT_NUMBER"), F.date_format("contract_start_date", "yyyy-MM-dd'T00:00:00Z'").alias("START_DATE"), F.col("contract_reg_type").alias("VERSION_EN"),
        F.format_number("annual_amount", 2).alias("ANNUAL_AMOUNT"), F.lower("area_name").alias("AREA_EN"), F.concat("project_number", F.lit(".00")).alias("PROJECT_NUMBER"),
        F.col("rent_property_type").alias("PROP_TYPE_EN"), F.regexp_replace("rooms", " B/R", " bed rooms+hall").alias("ROOMS_EN"), F.col("actual_area").cast("string").alias("ACTUAL_AREA"),
    ).write.csv(path, header=True)
    rows, _ = ingest.type_feed(t.spark.read.csv(path, header=True, inferSchema=False), ingest.RENTS)
    return rows.groupBy("contract_reg_type", "area_name", "rent_property_type", "rooms").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("project_number").alias("projects"), total("annual_amount").alias("amount"), total("actual_area").alias("area"),
        F.min("contract_start_date").alias("first"), F.max("contract_start_date").alias("last"))


@query("ingest_service_charges", f"""SELECT year(o_orderdate) AS budget_year, o_orderpriority AS category, count(*) AS n, {tot("CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END")} AS cost, {cnt("o_orderkey % 9 = 0")} AS unread FROM orders GROUP BY ALL""")
def _(t):
    path, key = shared_dir(t.spark, "charges"), F.col("o_orderkey")
    t.raw("orders").select(
        F.year("o_orderdate").cast("string").alias("budget_year"), (key % 150).cast("string").alias("project_id"), F.lit("Tower").alias("project_name"), F.col("o_orderpriority").alias("service_category_name_en"),
        F.when(key % 9 == 0, F.lit("tbc")).otherwise(F.format_number("o_totalprice", 2)).alias("service_cost"),
    ).write.csv(path, header=True)
    rows, _ = ingest.type_feed(t.spark.read.csv(path, header=True, inferSchema=False), ingest.CHARGES)
    return rows.groupBy(F.col("budget_year"), "category").agg(F.count(F.lit(1)).alias("n"), total("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unread"))


STATED = {"project_number": ("PROJECT_NUMBER", "true"), "status": ("PROJECT_STATUS", "true"), "percent_completed": ("PERCENT_COMPLETED", "pct IS NOT NULL"), "inspected": ("INSPECTION_DATE", "id % 4 <> 0"),
          "completion_date": ("COMPLETION_DATE", "id % 5 = 0 AND completion_date IS NOT NULL"), "planned_end_date": ("END_DATE", "completion_date IS NOT NULL"), "load_timestamp": (None, "false"), "units": ("CNT_UNIT", "true"), "villas": (None, "false"), "lands": (None, "false")}


@query("header_coverage", " UNION ALL ".join(f"""SELECT '{field}' AS field, {f"'{head}'" if head else "NULL"} AS header, {cnt(cond)} AS stated FROM r""" for field, (head, cond) in STATED.items()), r=READ)
def _(t):
    """Which header of the written file feeds which field, and how many rows state it."""
    raw = t.spark.read.csv(_readings_csv(t), header=True, inferSchema=False)
    counts = readers.canonical(raw, ingest.READING_FIELDS).agg(*[F.count(c).alias(c) for c in ingest.READING_FIELDS]).unpivot([], list(ingest.READING_FIELDS), "field", "stated")
    return readers.header_coverage(raw, ingest.READING_FIELDS).join(counts, "field")


@query("read_parts", "SELECT project_number, count(*) AS n FROM observation GROUP BY 1")
def _(t):
    """A feed in parts, one of them downloaded twice under a numbered name, which counts once."""
    path = shared_dir(t.spark, "parts")
    rows = t.observation.select("project_number", F.col("id").cast("string").alias("id"))
    for k, name in ((0, "part-0.csv"), (1, "part-1.csv"), (2, "part-2.csv"), (0, "part-0 (1).csv")):
        rows.filter(F.col("id").cast("long") % 3 == k).write.csv(f"{path}/{name}", header=True)
    return readers.read_parts(t.spark, f"{path}/part-*.csv").groupBy("project_number").agg(F.count(F.lit(1)).alias("n"))


@query("first_seen_from_id", f"""SELECT coalesce(CASE WHEN k % 2 = 0 THEN first_seen END, CASE WHEN k % 3 = 0 THEN instance_date END) AS first_seen, count(*) AS n FROM (SELECT *, CAST(procedure_area AS INT) AS k FROM registration_id) GROUP BY 1""")
def _(t):
    k = F.col("procedure_area").cast("int")
    stored = F.when(k % 3 == 0, F.concat("transaction_id", F.lit("#a"), F.date_format("instance_date", "yyyyMMdd"), F.lit("17"))).otherwise(F.concat("transaction_id", F.lit("#1")))
    rows = t.registration_id.select(stored.alias("transaction_id"), F.when(k % 2 == 0, F.col("first_seen")).alias("first_seen"))
    return ingest.backfill_first_seen(rows).groupBy("first_seen").agg(F.count(F.lit(1)).alias("n"))


@query("read_dossiers", """SELECT 'issuer-' || CAST(c_custkey % 3 AS VARCHAR) AS issuer, count(*) AS n, CAST(2 * count(*) AS BIGINT) AS bonds, CAST(2 * count(*) AS BIGINT) AS periods, count(*) FILTER (WHERE c_custkey % 5 <> 0) AS costs, min(2001 + c_custkey % 6)::VARCHAR AS first_year FROM customer GROUP BY 1""")
def _(t):
    path = shared_dir(t.spark, "dossiers")
    dossiers(t).withColumnRenamed("issuer", "id").drop("c_custkey").write.json(path)
    rows = readers.read_dossiers(t.spark, path, one_per_file=False)
    return rows.groupBy("issuer").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("bonds").cast("long")).alias("bonds"), F.sum(F.size("periods").cast("long")).alias("periods"), F.count("financeCostOnBorrowings.aedM").alias("costs"),
        F.min(F.col("maturityWall")[0]["year"]).alias("first_year"))


@query("publish_json", "SELECT area_name, contract_id, annual_amount FROM rent")
def _(t):
    path = shared_dir(t.spark, "published")
    writers.publish(t.rent, path, ["area_name", "contract_id", "annual_amount"], "json")
    return t.spark.read.schema("area_name string, contract_id string, annual_amount double").json(path)


@query("stream_scans", "SELECT 'site:' || listing_id AS listing_id, observed_at, asking_price FROM pr", pr=BASE["pr"])
def _(t):
    """Scan files read as a stream, each once, two runs over the same folder."""
    path, out, marks = _scan_files(t), shared_dir(t.spark, "scanned"), shared_dir(t.spark, "scans-checkpoint")
    for _ in range(2):
        rows = feeds.stream_scans(t.spark, path).select("listing_id", "observed_at", "asking_price")
        feeds.run_available(feeds.land(rows, out), marks)
    return feeds.landed(t.spark, out)
