"""Identity queries: keys, duplicate merge, fills, corrections, links, vintages, withdrawals."""

from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.functions.numbers import half_up
from cadastra.operators import identity
from cadastra.plans.adapters import AS_OF
from cadastra.plans.registry import cnt, query, rnd
from cadastra.session import letting_shuffles_go, materialize

KEY = """CASE WHEN len(string_split(transaction_id,'-'))=4 THEN string_split(transaction_id,'-')[2] || '|' || string_split(transaction_id,'-')[3] || '|' || string_split(transaction_id,'-')[4] || '|' || trans_group
  WHEN len(string_split(transaction_id,'-'))=3 THEN string_split(transaction_id,'-')[1] || '|' || string_split(transaction_id,'-')[3] || '|' || string_split(transaction_id,'-')[2] || '|' || trans_group END"""
# Odd order numbers in the web shape play the website export, the rest the bulk dump.
STORED = "CASE WHEN len(string_split(transaction_id,'-'))=3 THEN 'w#' || transaction_id || '#1' ELSE transaction_id END"
KEYED = f"SELECT *, {KEY} AS tx_key FROM registration_id"
FEEDS = f"SELECT * EXCLUDE (transaction_id), {STORED} AS transaction_id, CASE WHEN len(string_split(transaction_id,'-'))=3 THEN 'web' ELSE 'bulk' END AS feed FROM k"


def keyed(t):
    return identity.with_keys(t.registration_id)


def feeds(t):
    web = F.size(F.split("transaction_id", "-")) == 3
    return keyed(t).withColumn("transaction_id", F.when(web, F.concat(F.lit("w#"), "transaction_id", F.lit("#1"))).otherwise(F.col("transaction_id")))


def stored_feeds(t):
    """The keyed feeds as a stored table: the key is a column of the register, not recomputed per step; columns no step reads are not stored."""
    rows = feeds(t).drop("expected_key", "nearest_metro", "nearest_landmark", "nearest_mall", "master_project")
    with letting_shuffles_go(rows.sparkSession):
        return materialize(rows, "keyed-feeds")


@query("registration_keys", "SELECT trans_group, count(*) AS n, count(DISTINCT expected_key) AS keys, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS unkeyed FROM registration_id GROUP BY 1")
def _(t):
    rows = keyed(t).groupBy("trans_group", "tx_key", "expected_key").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("trans_group").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.count_if(F.col("tx_key") != F.col("expected_key")).alias("wrong"),
        F.count_if(F.col("tx_key").isNull()).alias("unkeyed"))


@query("merge_summary", f"""SELECT count(*) AS keys, {cnt("n > 1")} AS held_twice, CAST(sum(n - 1) AS BIGINT) AS rows_removed, {cnt("a = 3 AND b = 4")} AS in_both_shapes
  FROM (SELECT tx_key, count(*) AS n, min(len(string_split(transaction_id,'-'))) AS a, max(len(string_split(transaction_id,'-'))) AS b FROM k GROUP BY 1)""", k=KEYED)
def _(t):
    return identity.merge_summary(keyed(t))


def _first(c: str, expr: str | None = None, cond: str | None = None) -> str:
    return f"first({expr or c} ORDER BY o) FILTER (WHERE {cond or f'{expr or c} IS NOT NULL'}) AS {c}"


MERGED = f"""SELECT tx_key, copies, transaction_id, instance_date, feed_date, actual_worth, procedure_area, first_seen, withdrawn_on, {", ".join(identity.TEXT_COLUMNS)},
    CASE WHEN copies > 1 AND procedure_area <> 0 THEN {rnd("actual_worth/procedure_area")} ELSE psm END AS meter_sale_price
  FROM (SELECT tx_key, count(*) AS copies, first(transaction_id ORDER BY o) AS transaction_id, coalesce(first(instance_date ORDER BY o) FILTER (WHERE feed='web'), min(instance_date)) AS instance_date,
      min(instance_date) FILTER (WHERE feed<>'web') AS feed_date, coalesce(first(actual_worth ORDER BY o) FILTER (WHERE abs(actual_worth - round(actual_worth)) > 1e-9), max(actual_worth)) AS actual_worth,
      {_first("procedure_area")}, {_first("psm", "meter_sale_price")}, min(first_seen) AS first_seen, CASE WHEN count(withdrawn_on)=count(*) THEN min(withdrawn_on) END AS withdrawn_on,
      {", ".join(_first(c, f"nullif(trim({c}),'')") for c in identity.TEXT_COLUMNS)}
    FROM (SELECT *, row(CASE feed WHEN 'bulk' THEN 0 ELSE 2 END, instance_date, transaction_id, actual_worth, procedure_area, meter_sale_price, project_number, area_name, building_name) AS o FROM f) GROUP BY tx_key)"""


@query("merge_duplicates", f"SELECT * FROM m", k=KEYED, f=FEEDS, m=MERGED)
def _(t):
    return identity.merge_duplicates(stored_feeds(t))


@query("stored_ids", """SELECT number || '#' || CAST(row_number() OVER (PARTITION BY number) AS VARCHAR) AS stored_id FROM (SELECT transaction_id AS number FROM registration_id)""")
def _(t):
    order = ["instance_date", "actual_worth", "procedure_area", "project_number", "area_name"]
    return identity.row_ids(t.registration_id, "bulk", order).select("stored_id")


# Every form of stored id; all sales carry one number, so half of the table repeats it.
HOT = "SELECT CASE WHEN trans_group = 'Sales' THEN '1-11-2000-1' ELSE transaction_id END AS number FROM registration_id"


@query("stored_id_forms", f"""SELECT form, CASE form WHEN 'bulk' THEN number || '#' || n WHEN 'web' THEN 'w#' || number || '#' || n ELSE number || '#a20260903' || n END AS stored_id
  FROM (SELECT number, CAST(row_number() OVER (PARTITION BY number) AS VARCHAR) AS n FROM ({HOT})), (VALUES ('bulk'), ('web'), ('api')) v(form)""")
def _(t):
    rows = t.registration_id.withColumn("transaction_id", F.when(F.col("trans_group") == "Sales", F.lit("1-11-2000-1")).otherwise(F.col("transaction_id")))
    order = ["instance_date", "actual_worth", "procedure_area", "project_number", "area_name", "expected_key"]
    forms = [identity.row_ids(rows, form, order, "20260903").select(F.lit(form).alias("form"), "stored_id") for form in ("bulk", "web", "api")]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


HELD = "SELECT tx_key, instance_date, feed_date, actual_worth, procedure_area, meter_sale_price, CASE WHEN rooms='Studio' THEN NULL ELSE rooms END AS rooms, CASE WHEN building_name LIKE '%1' THEN NULL ELSE building_name END AS building_name FROM f WHERE feed='bulk'"


@query("fill_blanks", f"""SELECT h.tx_key, h.instance_date, h.feed_date, h.actual_worth, h.procedure_area, h.meter_sale_price, coalesce(h.rooms, w.rooms) AS rooms, coalesce(h.building_name, w.building_name) AS building_name
  FROM h LEFT JOIN w USING (tx_key)""", k=KEYED, f=FEEDS, h=HELD,
       w="SELECT tx_key, first(rooms ORDER BY row(instance_date, actual_worth, project_number, rooms)) AS rooms, first(building_name ORDER BY row(instance_date, actual_worth, project_number, rooms)) AS building_name FROM f WHERE feed='web' GROUP BY 1")
def _(t):
    rows = stored_feeds(t)
    web = text.feed_of("transaction_id") == "web"
    held = rows.filter(~web).select(
        "tx_key", "instance_date", "feed_date", "actual_worth", "procedure_area", "meter_sale_price",
        F.when(F.col("rooms") != "Studio", F.col("rooms")).alias("rooms"),
        F.when(~F.col("building_name").endswith("1"), F.col("building_name")).alias("building_name"))
    return identity.fill_blanks(held, rows.filter(web), "tx_key", ["rooms", "building_name"], ["instance_date", "actual_worth", "project_number", "rooms"])


@query("correct_from_register", f"""SELECT h.tx_key, coalesce(w.d, h.instance_date) AS instance_date, CASE WHEN w.tx_key IS NOT NULL THEN coalesce(h.feed_date, h.instance_date) ELSE h.feed_date END AS feed_date,
    coalesce(w.w, h.actual_worth) AS actual_worth, h.procedure_area, CASE WHEN w.tx_key IS NOT NULL THEN {rnd("coalesce(w.w, h.actual_worth)/coalesce(w.a, h.procedure_area)", 2)} ELSE h.meter_sale_price END AS meter_sale_price
  FROM h LEFT JOIN w USING (tx_key)""", k=KEYED, f=FEEDS, h=HELD,
       w="SELECT tx_key, last(instance_date ORDER BY o) AS d, last(actual_worth ORDER BY o) AS w, last(procedure_area ORDER BY o) AS a FROM (SELECT *, row(instance_date, actual_worth, procedure_area) AS o FROM f WHERE feed='web') GROUP BY 1")
def _(t):
    rows = stored_feeds(t)
    web = text.feed_of("transaction_id") == "web"
    held = rows.filter(~web).select("tx_key", "instance_date", "feed_date", "actual_worth", "procedure_area", "meter_sale_price")
    return identity.correct_from_register(held, rows.filter(web), ["instance_date", "actual_worth", "procedure_area"])


@query("append_new", """SELECT tx_key, instance_date, actual_worth FROM (SELECT *, row_number() OVER (PARTITION BY tx_key ORDER BY instance_date, actual_worth, procedure_area) AS rn FROM f WHERE feed='web')
  WHERE rn = 1 AND tx_key NOT IN (SELECT tx_key FROM f WHERE feed='bulk')""", k=KEYED, f=FEEDS)
def _(t):
    rows = stored_feeds(t).select("transaction_id", "tx_key", "instance_date", "actual_worth", "procedure_area")
    web = text.feed_of("transaction_id") == "web"
    out = identity.append_new(rows.filter(~web), rows.filter(web), ["tx_key"], ["instance_date", "actual_worth", "procedure_area"])
    return out.select("tx_key", "instance_date", "actual_worth")


# Listings of every project, under the names of the known communities in turn, one in fourteen under none of them.
LISTED = ("SELECT *, CASE CAST(project_number AS INT) % 14 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(identity.COMMUNITY_AREAS)) + " ELSE 'Elsewhere ' || area_name END AS community FROM project")


@query("adapt_listings", f"""SELECT project_number, CASE community {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in identity.COMMUNITY_AREAS.items())} ELSE community END AS area_name,
    CASE k % 3 WHEN 0 THEN 'Emirates Living - Springs ' || CAST(k % 20 AS VARCHAR) WHEN 1 THEN '' ELSE project_name END AS project_name FROM (SELECT *, CAST(project_number AS INT) AS k FROM l)""", l=LISTED)
def _(t):
    k = F.col("project_number").cast("int")
    names = F.array(*[F.lit(name) for name in identity.COMMUNITY_AREAS])
    rows = t.project.withColumn("community", F.coalesce(F.get(names, k % 14), F.concat(F.lit("Elsewhere "), "area_name")))
    sub = F.when(k % 3 == 0, F.concat(F.lit("the springs "), (k % 20).cast("string"))).when(k % 3 == 1, F.upper("community")).otherwise(F.col("project_name"))
    return identity.adapt_listings(rows.select("project_number", "community", sub.alias("sub_community"))).select("project_number", "area_name", "project_name")


@query("upsert", """SELECT project_number, coalesce(n.units, s.units) AS units, CASE WHEN n.project_number IS NOT NULL THEN n.project_value ELSE s.project_value END AS project_value, coalesce(s.area_name, n.area_name) AS area_name
  FROM (SELECT project_number, units, project_value, area_name FROM project) s
  FULL OUTER JOIN (SELECT CASE WHEN CAST(project_number AS INT) % 2 = 0 THEN project_number ELSE 'n' || project_number END AS project_number, CASE WHEN villas > 0 THEN villas END AS units, project_value + 1 AS project_value, 'new ' || area_name AS area_name FROM project) n USING (project_number)""")
def _(t):
    """A batch of all projects, every other one under a number the store does not know."""
    store = t.project.select("project_number", "units", "project_value", "area_name")
    known = F.col("project_number").cast("int") % 2 == 0
    batch = t.project.select(
        F.when(known, F.col("project_number")).otherwise(F.concat(F.lit("n"), "project_number")).alias("project_number"), F.when(F.col("villas") > 0, F.col("villas")).alias("units"),
        (F.col("project_value") + 1).alias("project_value"), F.concat(F.lit("new "), "area_name").alias("area_name"))
    return identity.upsert(store, batch, ["project_number"], overwrite=["project_value"], keep_if_null=["units"])


@query("link_by_name", f"""SELECT coalesce(r.pn, l.pn) AS project_number, count(*) AS n FROM (SELECT CASE WHEN procedure_area > 25 THEN project_number END AS pn, '  ' || upper(project_name || ' ' || project_number) AS nm FROM registration) r
  LEFT JOIN (SELECT upper(trim(project_name)) AS nm, min(project_number) AS pn FROM project GROUP BY 1) l ON l.nm = upper(trim(r.nm)) GROUP BY 1""")
def _(t):
    rows = t.registration.select(
        F.when(F.col("procedure_area") > 25, F.col("project_number")).alias("project_number"),
        F.concat(F.lit("  "), F.upper(F.concat_ws(" ", "project_name", "project_number"))).alias("project_name"))
    return identity.link_by_name(rows, t.project).groupBy("project_number").agg(F.count(F.lit(1)).alias("n"))


@query("map_area", """SELECT area_text, coalesce(p.area_name, k.area_name, c.area_name, t.area_text) AS mapped_area, coalesce(p.area_name, k.area_name, c.area_name) IS NOT NULL AS mapped, count(*) AS n
  FROM t LEFT JOIN project p ON p.project_number = t.pn LEFT JOIN (SELECT lower(area_name) AS x, min(area_name) AS area_name FROM registration GROUP BY 1) k ON k.x = lower(t.area_text)
  LEFT JOIN (SELECT x, max_by(area_name, row(n, area_name)) AS area_name FROM (SELECT lower(trim(master_project)) AS x, area_name, count(*) AS n FROM project WHERE master_project <> '' GROUP BY ALL) GROUP BY 1) c ON c.x = lower(t.area_text)
  GROUP BY ALL""",
       t="SELECT CASE WHEN CAST(project_number AS INT) % 4 = 0 THEN project_number END AS pn, CASE CAST(procedure_area AS INT) % 3 WHEN 0 THEN area_name WHEN 1 THEN master_project ELSE 'Nowhere 5' END AS area_text FROM registration")
def _(t):
    size = F.col("procedure_area").cast("int") % 3
    rows = t.registration.select(
        F.when(F.col("project_number").cast("int") % 4 == 0, F.col("project_number")).alias("project_number"),
        F.when(size == 0, F.col("area_name")).when(size == 1, F.col("master_project")).otherwise(F.lit("Nowhere 5")).alias("area_text"))
    return identity.map_area(rows, t.project, t.registration.select("area_name")).groupBy("area_text", "mapped_area", "mapped").agg(F.count(F.lit(1)).alias("n"))


@query("disambiguate_slug", """SELECT project_number, area_slug, CASE WHEN project_number = min(project_number) OVER (PARTITION BY area_slug, s) THEN s ELSE s || '-' || project_number END AS slug
  FROM (SELECT project_number, area_slug, lower(replace(regexp_replace(project_name, ' [0-9]+$', ''), ' ', '-')) AS s FROM project)""")
def _(t):
    rows = t.project.select("project_number", "area_slug", text.slugify(F.regexp_replace("project_name", " [0-9]+$", "")).alias("slug"))
    return identity.disambiguate_slug(rows, "area_slug", "slug", "project_number")


@query("match_snapshot", """SELECT s.project_number, s.key, CASE WHEN key IS NOT NULL THEN p.project_number ELSE coalesce(a.pn, b.pn) END AS matched
  FROM s LEFT JOIN project p ON p.project_number = s.key LEFT JOIN (SELECT lower(trim(p_name)) AS nm, min(CAST(p_partkey AS VARCHAR)) AS pn FROM part GROUP BY 1) b ON b.nm = lower(s.name)
  LEFT JOIN (SELECT lower(trim(p_name)) AS nm, lower(area_name) AS ar, min(project_number) AS pn FROM project JOIN part ON CAST(p_partkey AS VARCHAR) = project_number GROUP BY ALL) a ON a.nm = lower(s.name) AND a.ar = lower(s.area)""",
       s="""SELECT project_number, CASE WHEN CAST(project_number AS INT) % 3 = 0 THEN project_number WHEN CAST(project_number AS INT) % 3 = 1 THEN 'x' || project_number END AS key, upper(p_name) AS name,
         CASE WHEN CAST(project_number AS INT) % 2 = 0 THEN area_name ELSE 'elsewhere' END AS area FROM project JOIN part ON CAST(p_partkey AS VARCHAR) = project_number""")
def _(t):
    register = t.project.withColumn("project_name", F.regexp_replace("project_name", " [0-9]+$", ""))
    n = F.col("project_number").cast("int")
    snap = register.select(
        "project_number", F.when(n % 3 == 0, F.col("project_number")).when(n % 3 == 1, F.concat(F.lit("x"), "project_number")).alias("key"),
        F.upper("project_name").alias("name"), F.when(n % 2 == 0, F.col("area_name")).otherwise(F.lit("elsewhere")).alias("area"))
    return identity.match_snapshot(snap, register).select("project_number", "key", "matched")


@query("resolve_listings", """SELECT l.listing_id, coalesce(e.pn, f.pn) AS project_number, CASE WHEN e.pn IS NOT NULL THEN 1.0::DOUBLE WHEN f.pn IS NOT NULL THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
    CASE WHEN e.pn IS NOT NULL THEN 'exact-name' WHEN f.pn IS NOT NULL THEN 'fuzzy-area-prefix' ELSE 'unresolved' END AS method
  FROM l LEFT JOIN (SELECT nm, min(project_number) AS pn FROM (SELECT project_name AS nm, project_number FROM project UNION ALL SELECT slug, project_number FROM project) GROUP BY 1) e ON e.nm = l.project_name
  LEFT JOIN (SELECT q.area_slug, q.w, min(p.project_number) AS pn FROM (SELECT DISTINCT area_slug, w FROM l) q JOIN project p ON p.area_slug = q.area_slug AND contains(lower(p.project_name), q.w) GROUP BY ALL) f ON f.area_slug = l.area_slug AND f.w = l.w""",
       l="""SELECT project_number AS listing_id, area_slug, lower(string_split(project_name, ' ')[1]) AS w, CASE CAST(project_number AS INT) % 3 WHEN 0 THEN project_name WHEN 1 THEN string_split(project_name, ' ')[1] || ' residence' ELSE 'zzz' || project_number END AS project_name0,
         CASE CAST(project_number AS INT) % 3 WHEN 0 THEN project_name WHEN 1 THEN string_split(project_name, ' ')[1] || ' residence' ELSE 'zzz' || project_number END AS project_name FROM project""".replace(
           "lower(string_split(project_name, ' ')[1]) AS w", "CASE CAST(project_number AS INT) % 3 WHEN 2 THEN 'zzz' || project_number ELSE lower(string_split(project_name, ' ')[1]) END AS w"))
def _(t):
    n = F.col("project_number").cast("int") % 3
    first_word = F.substring_index("project_name", " ", 1)
    name = F.when(n == 0, F.col("project_name")).when(n == 1, F.concat(first_word, F.lit(" residence"))).otherwise(F.concat(F.lit("zzz"), "project_number"))
    listings = t.project.select(
        F.col("project_number").alias("listing_id"), F.replace("area_name", F.lit("_"), F.lit(" ")).alias("area_name"), name.alias("project_name"),
        F.lit(None).cast("string").alias("building_name"))
    register = t.project.withColumn("area_slug", text.slugify("area_name"))
    return identity.resolve_listings(listings, register).select("listing_id", "project_number", "confidence", "method")


@query("merge_windows", """SELECT project_number, last(status ORDER BY w) FILTER (WHERE status IS NOT NULL) AS status, last(pct ORDER BY w) FILTER (WHERE pct IS NOT NULL) AS percent_completed,
    array_to_string(list_sort(list_distinct(list(w))), ',') AS windows FROM w GROUP BY 1""",
       w="""SELECT project_number, source AS w, max(CASE WHEN status <> 'FINISHED' THEN status END) AS status, max(CASE WHEN percent_completed <= 100 THEN percent_completed END) AS pct FROM observation GROUP BY ALL""")
def _(t):
    rows = t.observation.groupBy("project_number", F.col("source").alias("window")).agg(
        F.max(F.when(F.col("status") != "FINISHED", F.col("status"))).alias("status"),
        F.max(F.when(F.col("percent_completed") <= 100, F.col("percent_completed"))).alias("percent_completed"))
    return identity.merge_windows(rows, "project_number", "window", ["status", "percent_completed"]).withColumn("windows", F.concat_ws(",", "windows"))


@query("short_windows", """SELECT source, count(DISTINCT project_number) AS rows, CAST(max(total) AS INT) AS stated, count(DISTINCT project_number) < max(total) * 0.9::DOUBLE AS short FROM (
  SELECT *, CASE source WHEN 'gateway' THEN 400 ELSE 100 END AS total FROM observation) GROUP BY 1""")
def _(t):
    """Every window with what its feed says it holds, the gateway saying more than came."""
    rows = t.observation.withColumn("total", F.when(F.col("source") == "gateway", F.lit(400)).otherwise(F.lit(100)))
    return identity.short_windows(rows, "project_number", "source", "total")


# Contracts of February are dated into January, so that the series has months without any.
SERIES = "SELECT CAST(date_trunc('month', CASE WHEN month(contract_start_date) = 2 THEN contract_start_date - 31 ELSE contract_start_date END) AS DATE) AS month, area_name, rent_property_type, CAST(actual_area AS INT) % 3 AS version, count(*) AS contracts FROM rent GROUP BY ALL"


@query("versioned_series", "SELECT month, area_name, version, contracts, count(*) - 1 AS exact_repeats FROM s GROUP BY ALL", s=SERIES)
def _(t):
    return identity.versioned_series(_series(t), ["month", "area_name"], ["contracts"], "version")


def _series(t):
    date = F.when(F.month("contract_start_date") == 2, F.date_sub("contract_start_date", 31)).otherwise(F.col("contract_start_date"))
    return t.rent.groupBy(
        F.trunc(date, "MM").alias("month"), "area_name", "rent_property_type", (F.col("actual_area").cast("int") % 3).alias("version")
    ).agg(F.count(F.lit(1)).alias("contracts"))


@query("version_conflicts", "SELECT month, area_name, version, count(DISTINCT contracts) AS figures FROM s GROUP BY ALL HAVING count(DISTINCT contracts) > 1", s=SERIES)
def _(t):
    return identity.version_conflicts(_series(t), ["month", "area_name"], ["contracts"], "version")


@query("absent_months", """SELECT m AS month FROM (SELECT CAST(unnest(generate_series((SELECT min(month) FROM s), (SELECT max(month) FROM s), INTERVAL 1 MONTH)) AS DATE) AS m) WHERE m NOT IN (SELECT month FROM s)""", s=SERIES)
def _(t):
    return identity.absent_months(_series(t), "month")


@query("vintage_sweep", f"""SELECT 'tx' AS kind, transaction_id AS id, DATE '{AS_OF}' AS first_seen, CAST(NULL AS DATE) AS withdrawn_on FROM registration_id
  WHERE transaction_id NOT IN (SELECT transaction_id FROM registration_id WHERE first_seen < DATE '2001-01-01') GROUP BY 2""")
def _(t):
    rows = t.registration_id.select(F.col("transaction_id").alias("id"), "first_seen")
    vintage = rows.filter(F.col("first_seen") < "2001-01-01").select(F.lit("tx").alias("kind"), "id")
    return identity.vintage_sweep(rows, vintage, "tx", AS_OF, baseline_taken=True)


@query("vintage_baseline", """SELECT 'project' AS kind, project_number AS id, min(coalesce(f, DATE '1970-01-01')) AS first_seen, CAST(NULL AS DATE) AS withdrawn_on
  FROM project LEFT JOIN (SELECT project_number, min(observed_at) AS f FROM observation GROUP BY 1) USING (project_number) GROUP BY 2""")
def _(t):
    first = t.observation.groupBy("project_number").agg(F.min("observed_at").alias("_first"))
    rows = t.project.select("project_number").join(first, "project_number", "left").withColumnRenamed("project_number", "id")
    none = rows.select(F.lit("project").alias("kind"), "id").limit(0)
    return identity.vintage_sweep(rows, none, "project", AS_OF, False, F.coalesce("_first", F.lit("1970-01-01").cast("date")))


@query("first_seen_entities", f"""SELECT 'developer' AS kind, developer_number AS id, DATE '{AS_OF}' AS first_seen FROM (SELECT DISTINCT developer_number FROM project) WHERE developer_number NOT IN
  (SELECT developer_number FROM developer WHERE CAST(developer_number AS INT) < 6)""")
def _(t):
    store = t.developer.filter(F.col("developer_number").cast("int") < 6)
    return identity.first_seen_entities(store, t.project, "developer_number", "developer", AS_OF)


WD = {"k": KEYED, "held": "SELECT transaction_id, feed_date, tx_key FROM k WHERE feed_date IS NOT NULL",
      "ret": "SELECT feed_date, tx_key FROM k WHERE feed_date IS NOT NULL AND NOT (procedure_area = 1 OR (day(feed_date) = 5 AND procedure_area < 20))",
      "mk": "SELECT feed_date, day(feed_date) <> 9 AS ok, count(*) AS returned_rows FROM ret GROUP BY 1"}


def _withdrawal(t):
    rows = materialize(keyed(t).filter(F.col("feed_date").isNotNull()).select("transaction_id", "feed_date", "tx_key", "procedure_area"), "filed")
    gone = (F.col("procedure_area") == 1) | ((F.dayofmonth("feed_date") == 5) & (F.col("procedure_area") < 20))
    returned = rows.filter(~gone).select("feed_date", "tx_key")
    marks = returned.groupBy("feed_date").agg(F.count(F.lit(1)).alias("returned_rows")).withColumn("ok", F.dayofmonth("feed_date") != 9)
    return rows.select("transaction_id", "feed_date", "tx_key"), returned, marks


@query("withdrawal_marks", f"""SELECT transaction_id, h.feed_date, h.tx_key, CASE WHEN r.tx_key IS NULL THEN 'withdrawn' ELSE 'present' END AS mark, CASE WHEN r.tx_key IS NULL THEN DATE '{AS_OF}' END AS withdrawn_on
  FROM held h JOIN (SELECT mk.feed_date FROM mk JOIN (SELECT feed_date, count(*) AS n FROM held GROUP BY 1) c USING (feed_date) WHERE ok AND mk.feed_date <= DATE '{AS_OF}' - 3 AND returned_rows >= 0.9::DOUBLE*n) d USING (feed_date)
  LEFT JOIN (SELECT DISTINCT * FROM ret) r ON r.feed_date = h.feed_date AND r.tx_key = h.tx_key""", **WD)
def _(t):
    return identity.withdrawal_marks(*_withdrawal(t), AS_OF)


@query("withdrawal_days", f"""SELECT mk.feed_date, ok, returned_rows, n AS held_rows, CASE WHEN NOT ok THEN 'incomplete' WHEN mk.feed_date > DATE '{AS_OF}' - 3 THEN 'too recent' WHEN n IS NULL THEN 'nothing held'
    WHEN returned_rows < 0.9::DOUBLE*n THEN 'thin' ELSE 'checked' END AS outcome FROM mk LEFT JOIN (SELECT feed_date, count(*) AS n FROM held GROUP BY 1) USING (feed_date)""", **WD)
def _(t):
    held, _, marks = _withdrawal(t)
    return identity.withdrawal_days(held, marks, AS_OF)


@query("replace_source", """SELECT source, count(*) AS n, min(observed_at) AS first_read FROM (SELECT source, observed_at FROM observation WHERE source <> 'api' UNION ALL SELECT source, DATE '2001-07-01' FROM observation WHERE source='api') GROUP BY 1""")
def _(t):
    fresh = t.observation.filter(F.col("source") == "api").withColumn("observed_at", F.lit("2001-07-01").cast("date"))
    return identity.replace_source(t.observation, "api", fresh).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("first_read"))


@query("run_log", f"SELECT DATE '{AS_OF}' AS run_date, (SELECT count(*) FROM registration) AS tx, (SELECT count(*) FROM rent) AS rents, (SELECT count(*) FROM project) AS projects, 'daily' AS notes")
def _(t):
    return identity.run_log(AS_OF, {"tx": t.registration, "rents": t.rent, "projects": t.project}, "daily")
