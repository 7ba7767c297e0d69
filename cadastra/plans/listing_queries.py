"""Listing queries: presence, streaks, cuts, validated drops, distress, inventory."""

from pyspark.sql import functions as F

from cadastra.operators import listings
from cadastra.plans.adapters import AS_OF
from cadastra.plans.registry import avg, cnt, query, rnd

RULES = listings.DropRules(min_amount=10_000.0)

PRICES = "SELECT listing_id, observed_at, max_by(asking_price, event_id) AS asking_price FROM price_event GROUP BY ALL"
PRESENCE = """SELECT listing_id, observed_at, asking_price, true AS seen FROM pr UNION ALL
  SELECT listing_id, next_scan, asking_price, false FROM (SELECT pr.*, next_scan, lead(pr.observed_at) OVER (PARTITION BY listing_id ORDER BY pr.observed_at) AS next_seen FROM pr
    JOIN (SELECT observed_at, lead(observed_at) OVER (ORDER BY observed_at) AS next_scan FROM (SELECT DISTINCT observed_at FROM pr)) d USING (observed_at))
  WHERE next_scan IS NOT NULL AND (next_seen IS NULL OR next_seen > next_scan)"""
STREAKS = """SELECT listing_id, observed_at, asking_price, seen, CAST(CASE WHEN seen THEN coalesce(sum(seen::INT) OVER (PARTITION BY listing_id, island ORDER BY observed_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS BIGINT) AS streak,
    prev_price, coalesce(prev_seen, false) AS prev_seen
  FROM (SELECT *, sum((NOT seen)::INT) OVER w AS island, lag(asking_price) OVER w AS prev_price, lag(seen) OVER w AS prev_seen FROM ob WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at))"""
LISTING = """SELECT project_number AS listing_id, project_number, area_name, CASE WHEN CAST(project_number AS INT) % 4 = 0 THEN '' ELSE rooms END AS rooms, area_sqm, CAST(project_number AS INT) % 3 = 0 AS is_off_plan, first_seen_at
  FROM (SELECT p.*, 40.0::DOUBLE + units AS area_sqm, CASE WHEN CAST(project_number AS INT) % 5 = 0 THEN 'Studio' ELSE CAST(CAST(project_number AS INT) % 5 AS VARCHAR) || ' B/R' END AS rooms,
    (SELECT min(observed_at) FROM pr WHERE pr.listing_id = p.project_number) AS first_seen_at FROM project p WHERE project_number IN (SELECT listing_id FROM pr))"""
CUTS = f"""SELECT s.listing_id, s.observed_at, prev_price AS from_price, asking_price AS to_price, {rnd("(prev_price - asking_price)/prev_price", 6)} AS cut_pct, streak,
    (prev_price - asking_price)/prev_price >= 0.02::DOUBLE AND (is_off_plan OR prev_price - asking_price >= 10000) AND streak >= 2 AS validated
  FROM st s JOIN li USING (listing_id) WHERE seen AND prev_seen AND asking_price < prev_price"""
OUT = f"""SELECT h.*, coalesce(c.drops, 0) AS drops, coalesce(c.unvalidated, 0) AS unvalidated, c.last_drop,
    CASE WHEN scans_seen < 3 THEN 'too-few-scans' WHEN coalesce(drops, 0) = 0 THEN 'no-validated-drop' WHEN NOT live THEN 'currently-delisted' END AS rejected,
    {rnd("(first_price - current_price)/first_price", 6)} AS cumulative_pct, CAST(last_seen - first_seen AS INT) AS days_tracked
  FROM (SELECT listing_id, {cnt("seen")} AS scans_seen, max_by(seen, observed_at) AS live, min_by(asking_price, observed_at) FILTER (WHERE seen) AS first_price, max_by(asking_price, observed_at) FILTER (WHERE seen) AS current_price,
      min(observed_at) FILTER (WHERE seen) AS first_seen, max(observed_at) FILTER (WHERE seen) AS last_seen FROM ob GROUP BY 1) h
  LEFT JOIN (SELECT listing_id, {cnt("validated")} AS drops, {cnt("NOT validated")} AS unvalidated, max(observed_at) FILTER (WHERE validated) AS last_drop FROM cu GROUP BY 1) c USING (listing_id)"""
BASE = {"pr": PRICES, "ob": PRESENCE}
ALL = {**BASE, "st": STREAKS, "li": LISTING, "cu": CUTS, "oc": OUT}


def prices(t):
    return listings.scan_prices(t.price_event)


def listing(t):
    first = prices(t).groupBy(F.col("listing_id").alias("project_number")).agg(F.min("observed_at").alias("first_seen_at"))
    n = F.col("project_number").cast("int")
    rooms = F.when(n % 4 == 0, F.lit("")).when(n % 5 == 0, F.lit("Studio")).otherwise(F.concat((n % 5).cast("string"), F.lit(" B/R")))
    return t.project.join(first, "project_number").select(
        F.col("project_number").alias("listing_id"), "project_number", "area_name", rooms.alias("rooms"), (F.col("units") + F.lit(40.0)).alias("area_sqm"),
        (n % 3 == 0).alias("is_off_plan"), "first_seen_at")


@query("track_presence", "SELECT * FROM ob", **BASE)
def _(t):
    return listings.track_presence(prices(t))


@query("missing_from_scan", """SELECT listing_id, DATE '2001-07-20' AS observed_at, asking_price, false AS seen FROM (SELECT listing_id, max_by(asking_price, observed_at) AS asking_price, max_by(seen, observed_at) AS seen FROM ob WHERE observed_at < DATE '2001-07-20' GROUP BY 1)
  WHERE seen AND listing_id NOT IN (SELECT listing_id FROM pr WHERE observed_at = DATE '2001-07-20')""", **BASE)
def _(t):
    obs = listings.track_presence(prices(t)).filter(F.col("observed_at") < "2001-07-20")
    return listings.missing_from_scan(obs, prices(t).filter(F.col("observed_at") == "2001-07-20"), "2001-07-20")


@query("streaks", "SELECT * FROM st", **BASE, st=STREAKS)
def _(t):
    return listings.streaks(listings.track_presence(prices(t)))


@query("price_cuts", "SELECT * FROM cu", **ALL)
def _(t):
    return listings.price_cuts(listings.track_presence(prices(t)), listing(t), RULES)


@query("listing_outcomes", "SELECT listing_id, scans_seen, first_price, current_price, first_seen, last_seen, drops, unvalidated, last_drop, rejected, cumulative_pct, days_tracked FROM oc", **ALL)
def _(t):
    return listings.listing_outcomes(listings.track_presence(prices(t)), listing(t), RULES)


@query("drop_rejections", "SELECT coalesce(rejected, 'published') AS outcome, count(*) AS listings FROM oc GROUP BY 1", **ALL)
def _(t):
    return listings.rejections(listings.listing_outcomes(listings.track_presence(prices(t)), listing(t), RULES))


def _upper(cols: str, days: int) -> str:
    return f"""SELECT {cols}, list_sort(list(meter_sale_price))[count(*)//2 + 1] AS v FROM registration WHERE trans_group='Sales' AND meter_sale_price > 0 AND instance_date >= DATE '{AS_OF}' - {days} GROUP BY ALL"""


SCORE = """least(30.0::DOUBLE, drops*10.0::DOUBLE) + least(25.0::DOUBLE, cumulative_pct*100*1.5::DOUBLE) + CASE WHEN days_tracked > ad*1.5::DOUBLE THEN 15 WHEN days_tracked > ad THEN 8 ELSE 0 END
  + CASE WHEN gap < -0.05::DOUBLE THEN 20 WHEN gap < 0 THEN 10 ELSE 0 END + least(10.0::DOUBLE, coalesce(slip, 0))"""
DROPS = {
    **ALL, "n1": _upper("project_number, rooms", 90), "n2": _upper("project_number", 90), "n3": _upper("project_number", 365),
    "vd": f"""SELECT listing_id, project_number, area_name, first_price, current_price, drops, cumulative_pct, last_drop, days_tracked, {rnd("anchor", 2)} AS recorded_psm, {rnd("asking", 2)} AS asking_psm, {rnd("gap", 4)} AS gap,
      CAST({rnd(rnd(SCORE, 6))} AS INT) AS distress_score, unvalidated
    FROM (SELECT *, (asking - anchor)/anchor AS gap FROM (SELECT oc.*, li.project_number, li.area_name, li.rooms, li.area_sqm, coalesce(CASE WHEN li.rooms <> '' THEN n1.v ELSE n2.v END, n3.v) AS anchor,
        CASE WHEN coalesce(CASE WHEN li.rooms <> '' THEN n1.v ELSE n2.v END, n3.v) IS NOT NULL THEN current_price/li.area_sqm END AS asking, s.slip, a.ad
      FROM oc JOIN li USING (listing_id) LEFT JOIN n1 ON n1.project_number=li.project_number AND n1.rooms=li.rooms LEFT JOIN n2 ON n2.project_number=li.project_number LEFT JOIN n3 ON n3.project_number=li.project_number
      LEFT JOIN (SELECT project_number, (max(completion_date) - min(completion_date))/30.4::DOUBLE AS slip FROM observation GROUP BY 1) s ON s.project_number=li.project_number
      LEFT JOIN (SELECT area_name, sum(DATE '{AS_OF}' - first_seen_at)/count(*) AS ad FROM li GROUP BY 1) a ON a.area_name=li.area_name WHERE rejected IS NULL))""",
}


def _drops(t):
    return listings.validated_drops(listing(t), listings.track_presence(prices(t)), t.registration, t.observation, AS_OF, RULES)


@query("validated_drops", "SELECT * FROM vd", **DROPS)
def _(t):
    return _drops(t)


@query("drop_feed", "SELECT vd.*, li.rooms, li.area_sqm, li.is_off_plan, p.project_name, p.area_slug || '/' || p.slug AS page FROM vd JOIN li USING (listing_id) LEFT JOIN project p ON p.project_number = vd.project_number", **DROPS)
def _(t):
    return listings.drop_feed(_drops(t), listing(t), t.project)


@query("listing_inventory", f"""SELECT area_name, active, avg_ask, cut, avg_cut_pct, coalesce(n, 0) AS sales_12m, {rnd("100.0::DOUBLE*cut/active")} AS cut_share, {rnd("active/nullif(n/12.0::DOUBLE,0)", 1)} AS months_of_inventory
  FROM (SELECT area_name, count(*) AS active, {avg("ask")} AS avg_ask, {cnt("ask < fp*0.98::DOUBLE")} AS cut, {rnd(rnd("sum(CASE WHEN ask < fp*0.98::DOUBLE THEN (ask/fp-1)*100 END)", 6) + "/nullif(count(*) FILTER (WHERE ask < fp*0.98::DOUBLE),0)", 1)} AS avg_cut_pct
    FROM (SELECT listing_id, min_by(asking_price, observed_at) AS fp, max(asking_price) FILTER (WHERE seen AND observed_at = (SELECT max(observed_at) FROM ob)) AS ask FROM ob GROUP BY 1) JOIN li USING (listing_id) WHERE ask IS NOT NULL GROUP BY 1)
  LEFT JOIN (SELECT area_name, count(*) AS n FROM registration WHERE trans_group='Sales' AND instance_date >= DATE '{AS_OF}' - 365 GROUP BY 1) USING (area_name)""", **BASE, li=LISTING)
def _(t):
    return listings.listing_inventory(listing(t), listings.track_presence(prices(t)), t.registration, AS_OF)


@query("listing_summary", f"SELECT count(DISTINCT observed_at) AS scans, max(observed_at) AS last_scan, {cnt('seen AND observed_at = (SELECT max(observed_at) FROM ob)')} AS active, (SELECT count(*) FROM li) AS tracked FROM ob", **BASE, li=LISTING)
def _(t):
    return listings.listing_summary(listing(t), listings.track_presence(prices(t)))


@query("clean_listings", f"""SELECT 'details-' || user_id AS listing_id, max(CAST(ts AS DATE)) AS last_seen, max_by(event_type, row(CAST(ts AS DATE), link)) AS community,
    CASE max_by(event_id, row(CAST(ts AS DATE), link)) % 6 WHEN 0 THEN 'Studio' WHEN 5 THEN '5 B/R' ELSE CAST(max_by(event_id, row(CAST(ts AS DATE), link)) % 6 AS VARCHAR) || ' B/R' END AS rooms,
    {rnd("max_by(value, row(CAST(ts AS DATE), link))*10*0.092903::DOUBLE", 1)} AS area_sqm, max_by(link, row(CAST(ts AS DATE), link)) AS link
  FROM (SELECT *, 'https://site.example/details-' || user_id || '.html?e=' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS link FROM events) GROUP BY user_id""")
def _(t):
    rows = t.raw("events").select(
        F.concat(F.lit("https://site.example/details-"), F.col("user_id").cast("string"), F.lit(".html?e="), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("link"),
        F.col("event_type").alias("community"), F.col("ts").cast("date").alias("observed_at"), (F.col("value") * 10).alias("sqft"),
        F.when(F.col("event_id") % 6 == 0, F.lit("0")).otherwise(F.concat((F.col("event_id") % 6).cast("string"), F.lit(" bed rooms"))).alias("beds"))
    return listings.clean_listings(rows)


@query("explode_price_log", """SELECT listing_id, observed_at, asking_price FROM pr WHERE asking_price >= 50000 AND day(observed_at) % 4 <> 0""", pr=PRICES)
def _(t):
    rows = prices(t)
    history = rows.groupBy("listing_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("observed_at").cast("string"), "asking_price"))).alias("price_log"))
    return listings.explode_price_log(history, rows.filter(F.dayofmonth("observed_at") % 4 == 0))
