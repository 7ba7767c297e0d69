"""Area, project, rent and series queries."""

from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.functions.numbers import month_start
from cadastra.operators import areas, listings
from cadastra.plans.adapters import AS_OF
from cadastra.plans.listing_queries import DROPS, _drops, listing, prices
from cadastra.plans.reading_queries import latest_sql
from cadastra.plans.registry import avg, chg, cnt, med, query, rnd, shr, tot

A = f"DATE '{AS_OF}'"
SLUG = "lower(replace(replace(replace(replace(area_name,' ','-'),'''','-'),'.','-'),'--','-'))"
SALE, OFF, READY = "trans_group='Sales'", "reg_type='Off-Plan Properties'", "reg_type='Existing Properties'"
APT = "property_type='Unit' AND meter_sale_price > 0"
DIRECTORY = f"""SELECT area_slug, min(area_name) AS area_name, CAST(sum(projects) AS BIGINT) AS projects FROM (SELECT area_slug, min(area_name) AS area_name, count(*) AS projects FROM project GROUP BY 1
  UNION ALL SELECT {SLUG}, area_name, 0 FROM registration GROUP BY area_name) GROUP BY 1"""


@query("area_directory", "SELECT * FROM d", d=DIRECTORY)
def _(t):
    return areas.area_directory(t.project, t.registration)


Y, P = f"instance_date >= {A} - 365", f"instance_date BETWEEN {A} - 730 AND {A} - 365"
R90, LY = f"instance_date >= {A} - 90", f"instance_date BETWEEN {A} - 455 AND {A} - 365"
STATS = f"""SELECT d.area_name, d.area_slug, d.projects, coalesce(tx_12m,0) AS tx_12m, coalesce(tx_prev_12m,0) AS tx_prev_12m, value, {shr("o", "tx_12m")} AS offplan_pct, psm_90, coalesce(n_90,0) AS n_90, coalesce(n_ly,0) AS n_ly, psm_ly,
    coalesce(drops,0) AS drops, max_drop
  FROM d LEFT JOIN (SELECT area_name, {cnt(Y)} AS tx_12m, {cnt(P)} AS tx_prev_12m, {rnd(tot(f"CASE WHEN {Y} THEN actual_worth END") + "/1e6::DOUBLE", 2)} AS value, {cnt(f"{Y} AND {OFF}")} AS o,
      {avg(f"CASE WHEN {APT} AND {R90} AND rooms <> '' THEN meter_sale_price END")} AS psm_90, {cnt(f"{APT} AND {R90}")} AS n_90, {cnt(f"{APT} AND {LY}")} AS n_ly, {avg(f"CASE WHEN {APT} AND {LY} THEN meter_sale_price END")} AS psm_ly
    FROM registration WHERE {SALE} AND instance_date >= {A} - 730 GROUP BY 1) s USING (area_name)
  LEFT JOIN (SELECT area_name, count(*) AS drops, {rnd("max(cumulative_pct)*100", 1)} AS max_drop FROM vd GROUP BY 1) v USING (area_name)"""
AREA = {**DROPS, "d": DIRECTORY, "ast": STATS}


def _stats(t):
    return areas.area_stats(t.registration, t.project, _drops(t), AS_OF, 1e6)


@query("area_stats", "SELECT * FROM ast", **AREA)
def _(t):
    return _stats(t)


YOY = rnd("(psm_90/psm_ly - 1)*100", 1)


@query("movers", f"""SELECT 'up' AS list, area_name, yoy, tx_12m, psm_90 FROM (SELECT * FROM y WHERE yoy IS NOT NULL ORDER BY yoy DESC, area_name LIMIT 4)
  UNION ALL SELECT 'down', area_name, yoy, tx_12m, psm_90 FROM (SELECT * FROM y WHERE yoy IS NOT NULL ORDER BY yoy, area_name LIMIT 4)
  UNION ALL SELECT 'busiest', area_name, yoy, tx_12m, psm_90 FROM (SELECT * FROM y ORDER BY tx_12m DESC, area_name LIMIT 6)""", **AREA,
       y=f"SELECT *, CASE WHEN n_90 >= 5 AND n_ly >= 5 AND psm_90 > 0 AND psm_ly > 0 THEN {YOY} END AS yoy FROM ast")
def _(t):
    return areas.movers(_stats(t), min_sales=5)


@query("area_projects_by_sales", f"""SELECT g.area_name, g.project_name, n, offplan, psm, price, last, CAST(rank AS INT) AS rank, p.slug FROM (SELECT *, row_number() OVER (PARTITION BY area_name ORDER BY n DESC, project_name) AS rank FROM (
    SELECT area_name, project_name, count(*) AS n, {cnt(OFF)} AS offplan, {avg("meter_sale_price")} AS psm, {avg("actual_worth")} AS price, max(instance_date) AS last, min(project_number) AS pn
    FROM registration WHERE {SALE} AND {Y} AND project_name <> '' AND meter_sale_price > 0 GROUP BY ALL)) g LEFT JOIN project p ON p.project_number = g.pn WHERE rank <= 10""")
def _(t):
    return areas.area_projects_by_sales(t.registration, t.project, AS_OF, 10)


@query("project_cards", f"""SELECT p.developer_number, p.project_number, p.project_name, p.area_slug, p.slug, p.units, d.developer_name, l.status, l.percent_completed, l.completion_date, coalesce(v.drops,0) AS drops, s.psm_90
  FROM project p LEFT JOIN developer d USING (developer_number) LEFT JOIN l USING (project_number) LEFT JOIN (SELECT project_number, count(*) AS drops FROM vd GROUP BY 1) v USING (project_number)
  LEFT JOIN (SELECT project_number, {avg("meter_sale_price")} AS psm_90 FROM registration WHERE {R90} AND meter_sale_price > 0 GROUP BY 1) s USING (project_number)""", **DROPS, l=latest_sql(AS_OF))
def _(t):
    return areas.project_cards(t.project, t.developer, t.observation, t.registration, _drops(t), AS_OF)


def _asking(t):
    obs = listings.track_presence(prices(t)).groupBy("listing_id").agg(
        F.max_by(F.struct("asking_price", "seen"), "observed_at").alias("l")).filter(F.col("l.seen")).select("listing_id", F.col("l.asking_price").alias("asking_price"))
    return obs.join(listing(t).select("listing_id", "project_number", "rooms", "area_sqm"), "listing_id")


ROOMS = f"""SELECT project_number, coalesce(nullif(rooms,''),'Unclassified') AS rooms, count(*) AS n, {avg("meter_sale_price")} AS psm, {avg("actual_worth")} AS price, max(instance_date) AS last
  FROM registration WHERE {SALE} AND meter_sale_price > 0 AND property_type IN ('Unit','Villa') AND {Y} GROUP BY ALL"""


@query("project_by_rooms", f"""SELECT s.project_number, s.rooms, s.n, s.psm, s.price, s.last, coalesce(r.n,0) AS rent_n, r.rent, coalesce(a.n,0) AS asking_n, a.asking, a.asking_psm, {chg("a.asking_psm", "s.psm")} AS asking_spread, {shr("r.rent", "s.price", 1)} AS gross_yield
  FROM s LEFT JOIN (SELECT project_number, rooms, count(*) AS n, {avg("annual_amount")} AS rent FROM rent WHERE rent_property_type IN ('Flat','Villa') AND annual_amount > 5000 AND contract_start_date >= {A} - 365 GROUP BY ALL) r USING (project_number, rooms)
  LEFT JOIN (SELECT project_number, rooms, count(*) AS n, {avg("ask")} AS asking, {rnd(rnd("sum(ask/area_sqm)", 4) + "/count(*)")} AS asking_psm FROM (SELECT listing_id, max_by(asking_price, observed_at) AS ask, max_by(seen, observed_at) AS seen FROM ob GROUP BY 1) JOIN li USING (listing_id) WHERE seen GROUP BY ALL) a USING (project_number, rooms)""",
       **DROPS, s=ROOMS)
def _(t):
    return areas.project_by_rooms(t.registration, t.rent, _asking(t), AS_OF)


AGG = f"""SELECT project_number, count(*) AS n, {avg(f"CASE WHEN {READY} THEN meter_sale_price END")} AS ready_psm, {cnt(READY)} AS ready_n, {avg(f"CASE WHEN {OFF} THEN meter_sale_price END")} AS off_psm, {cnt(OFF)} AS off_n
  FROM registration WHERE {SALE} AND project_number <> '' AND property_type IN ('Unit','Villa') AND meter_sale_price > 0 AND {Y} GROUP BY 1"""
PROOMS = f"""SELECT project_number, rooms, count(*) AS n, {avg("actual_worth")} AS price FROM registration WHERE {SALE} AND project_number <> '' AND property_type IN ('Unit','Villa') AND meter_sale_price > 0 AND actual_worth > 0 AND rooms NOT IN ('','NA') AND {Y} GROUP BY ALL"""


@query("project_aggregates", "SELECT * FROM g", g=AGG)
def _(t):
    return areas.project_aggregates(t.registration, AS_OF)


@query("project_rooms", "SELECT * FROM g", g=PROOMS)
def _(t):
    return areas.project_rooms(t.registration, AS_OF)


# The oracle may pair projects: it runs on a small scale only.
PEERS = {
    "g": AGG, "act": "SELECT p.project_number, trim(p.master_project) AS m, trim(string_split(p.master_project, ' - ')[1]) AS base, p.area_name, g.n FROM project p JOIN g USING (project_number) WHERE g.n >= 2",
    "sub": "SELECT project_number AS subject, nullif(trim(master_project),'') AS m, CASE WHEN contains(master_project,' - ') THEN trim(string_split(master_project,' - ')[1]) END AS base, area_name FROM project",
    "cand": """SELECT subject, 'community' AS level, m AS grp, a.project_number AS peer, n FROM sub JOIN act a USING (m) WHERE a.project_number <> subject
      UNION ALL SELECT subject, 'all_phases', s.base, a.project_number, n FROM sub s JOIN act a USING (base) WHERE a.project_number <> subject
      UNION ALL SELECT subject, 'area', s.area_name, a.project_number, n FROM sub s JOIN act a USING (area_name) WHERE a.project_number <> subject""",
    "sz": "SELECT s.subject, s.base, count(*) FILTER (WHERE level='community') AS c, count(*) FILTER (WHERE level='all_phases') AS p, count(*) FILTER (WHERE level='area') AS a FROM sub s LEFT JOIN cand USING (subject) GROUP BY ALL",
    "ch": """SELECT subject, CASE WHEN (CASE WHEN c < 3 AND base IS NOT NULL AND p > c THEN p ELSE c END) < 3 AND a > (CASE WHEN c < 3 AND base IS NOT NULL AND p > c THEN p ELSE c END) THEN 'area'
      WHEN c < 3 AND base IS NOT NULL AND p > c THEN 'all_phases' ELSE 'community' END AS level FROM sz""",
    "peers": "SELECT subject, level, grp, peer, n FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, peer) AS rn FROM cand JOIN ch USING (subject, level)) WHERE rn <= 10",
}


def _peers(t):
    return areas.peer_sets(t.project, areas.project_aggregates(t.registration, AS_OF), min_sales=2)


@query("peer_sets", "SELECT * FROM peers", **PEERS)
def _(t):
    return _peers(t)


ORDER = "list_position([" + ",".join(f"'{r}'" for r in areas.ROOM_ORDER) + "], rooms)"


@query("room_columns", f"""SELECT subject, rooms, n, CAST(row_number() OVER (PARTITION BY subject ORDER BY {ORDER}, rooms) AS INT) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, rooms) AS rn FROM (SELECT subject, rooms, CAST(sum(r.n) AS BIGINT) AS n FROM (SELECT subject, peer AS project_number FROM peers UNION ALL SELECT DISTINCT subject, subject FROM peers) JOIN r USING (project_number) GROUP BY ALL)) WHERE rn <= 3""",
       **PEERS, r=PROOMS)
def _(t):
    return areas.room_columns(_peers(t), areas.project_rooms(t.registration, AS_OF))


@query("peer_verdict", f"""SELECT project_number, basis, own AS own_psm, {rnd("sm/np", 1)} AS peer_psm, np AS peers, {rnd("(own/(sm/np) - 1)*100", 1)} AS gap_pct,
    CASE WHEN own IS NULL THEN 'too few' WHEN abs(own/(sm/np) - 1) < 0.03::DOUBLE THEN 'in line' WHEN own/(sm/np) > 1 THEN 'above' ELSE 'below' END AS verdict
  FROM (SELECT *, CASE basis WHEN 'ready' THEN ro WHEN 'off-plan' THEN oo END AS own, CASE basis WHEN 'ready' THEN rs WHEN 'off-plan' THEN os END AS sm, CASE basis WHEN 'ready' THEN rp WHEN 'off-plan' THEN op END AS np
    FROM (SELECT *, CASE WHEN ro > 0 AND rp >= 3 THEN 'ready' WHEN oo > 0 AND op >= 3 THEN 'off-plan' END AS basis FROM (
      SELECT p.project_number, CASE WHEN g.ready_n >= 1 THEN g.ready_psm END AS ro, CASE WHEN g.off_n >= 1 THEN g.off_psm END AS oo, x.* EXCLUDE (subject) FROM project p LEFT JOIN g USING (project_number)
      LEFT JOIN (SELECT subject, {rnd("sum(CASE WHEN ready_n >= 1 THEN ready_psm END)", 2)} AS rs, count(CASE WHEN ready_n >= 1 THEN ready_psm END) AS rp, {rnd("sum(CASE WHEN off_n >= 1 THEN off_psm END)", 2)} AS os, count(CASE WHEN off_n >= 1 THEN off_psm END) AS op
        FROM peers JOIN g ON g.project_number = peers.peer GROUP BY 1) x ON x.subject = p.project_number)))""", **PEERS)
def _(t):
    return areas.peer_verdict(t.project, _peers(t), areas.project_aggregates(t.registration, AS_OF), min_sales=1)


@query("price_vs_area", f"""SELECT project_number, p.area_name, n, {rnd("w", 1)} AS psm, psm_90, {rnd("(w/psm_90 - 1)*100", 1)} AS gap_pct, CASE WHEN abs(w/psm_90 - 1) < 0.02::DOUBLE THEN 'in line' WHEN w/psm_90 > 1 THEN 'above' WHEN w/psm_90 <= 1 THEN 'below' END AS verdict
  FROM (SELECT project_number, CAST(sum(n) AS BIGINT) AS n, {rnd("sum(psm*n)", 2)}/sum(n) AS w FROM s WHERE rooms NOT IN ('Unclassified','NA') GROUP BY 1) JOIN project p USING (project_number) LEFT JOIN ast USING (area_name)""", **AREA, s=ROOMS)
def _(t):
    return areas.price_vs_area(areas.sold_by_rooms(t.registration, AS_OF), t.project, _stats(t))


HOME = "rent_property_type IN ('Flat','Villa','Studio','Complex Villas') AND annual_amount BETWEEN 5000 AND 5000000"
RY, RL = f"contract_start_date >= {A} - 365", f"contract_start_date BETWEEN {A} - 730 AND {A} - 365"
NEW, REN, SIZED = "contract_reg_type='New'", "contract_reg_type='Renew'", "actual_area BETWEEN 20 AND 2000"


def _ps(cond: str) -> str:
    return rnd(rnd(f"sum(CASE WHEN {cond} THEN annual_amount/actual_area END)", 4) + f"/nullif(count(CASE WHEN {cond} THEN 1 END),0)")


def _rent(cond: str) -> str:
    return avg(f"CASE WHEN {cond} THEN annual_amount END")


@query("rent_summary", f"SELECT count(*) AS n, {cnt(NEW)} AS n_new, {_rent(NEW)} AS rent_new, {_rent(REN)} AS rent_renew, max(contract_start_date) AS latest FROM rent WHERE {HOME} AND {RY}")
def _(t):
    return areas.rent_summary(t.rent, AS_OF)


@query("rent_area_table", f"""SELECT r.*, sale_psm, {SLUG} AS slug, {chg("rent_psm", "rent_psm_ly")} AS rent_yoy, {shr("rent_psm", "sale_psm", 1)} AS gross_yield, {chg("rent_new", "rent_renew")} AS spread
  FROM (SELECT area_name, {cnt(RY)} AS n, {cnt(f"{RY} AND {NEW}")} AS n_new, {_rent(f"{RY} AND {NEW}")} AS rent_new, {_rent(f"{RY} AND {REN}")} AS rent_renew, {_ps(f"{RY} AND {NEW} AND {SIZED}")} AS rent_psm, {cnt(f"{RL} AND {NEW} AND {SIZED}")} AS n_ly,
    {_ps(f"{RL} AND {NEW} AND {SIZED}")} AS rent_psm_ly FROM rent WHERE {HOME} AND contract_start_date >= {A} - 730 GROUP BY 1 HAVING {cnt(RY)} >= 20) r
  LEFT JOIN (SELECT area_name, {avg("meter_sale_price")} AS sale_psm FROM registration WHERE {SALE} AND {APT} AND rooms <> '' AND {Y} GROUP BY 1) s USING (area_name)""")
def _(t):
    return areas.rent_area_table(t.rent, t.registration, AS_OF, 20)


RROOMS = "coalesce(nullif(rooms,''), CASE WHEN rent_property_type='Studio' THEN 'Studio' ELSE 'Unclassified' END)"


@query("rent_area_rooms", f"""SELECT area_name, {RROOMS} AS rooms, {cnt(RY)} AS n, {cnt(f"{RY} AND {NEW}")} AS n_new, {_rent(f"{RY} AND {NEW}")} AS rent_new, {_rent(f"{RY} AND {REN}")} AS rent_renew, {_ps(f"{RY} AND {SIZED}")} AS rent_psm, {_rent(f"{RL} AND {NEW}")} AS rent_new_ly
  FROM rent WHERE {HOME} AND contract_start_date >= {A} - 730 GROUP BY 1, 2 HAVING {cnt(RY)} >= 5""")
def _(t):
    return areas.rent_area_rooms(t.rent, AS_OF, 5)


@query("rent_top_projects", f"""SELECT g.project_number, g.area_name, n, rent_new, rent_renew, CAST(rank AS INT) AS rank, p.project_name, p.area_slug, p.slug FROM (SELECT *, row_number() OVER (PARTITION BY area_name ORDER BY n DESC, project_number) AS rank FROM (
    SELECT area_name, project_number, count(*) AS n, {_rent(NEW)} AS rent_new, {_rent(REN)} AS rent_renew FROM rent WHERE {HOME} AND {RY} GROUP BY ALL)) g LEFT JOIN project p USING (project_number) WHERE rank <= 30""")
def _(t):
    return areas.rent_top_projects(t.rent, t.project, AS_OF)


@query("sales_by_rooms", f"SELECT area_name, rooms, count(*) AS n, {avg('actual_worth')} AS price FROM registration WHERE {SALE} AND property_type='Unit' AND actual_worth > 0 AND rooms <> '' AND {Y} GROUP BY ALL HAVING count(*) >= 5")
def _(t):
    return areas.sales_by_rooms(t.registration, AS_OF, 5)


CAPS = f"""SELECT area_name, CASE WHEN rent_property_type IN ('Villa','Complex Villas') THEN 'Villa' ELSE 'Flat' END AS type, coalesce(nullif(rooms,''), CASE WHEN rent_property_type='Studio' THEN 'Studio' END) AS rooms, count(*) AS n, {avg("annual_amount")} AS average
  FROM rent WHERE {HOME} AND {NEW} AND {RY} AND coalesce(nullif(rooms,''), CASE WHEN rent_property_type='Studio' THEN 'Studio' END) IS NOT NULL GROUP BY ALL HAVING count(*) >= 3"""


@query("rent_caps", "SELECT * FROM c", c=CAPS)
def _(t):
    return areas.rent_caps(t.rent, AS_OF, 3)


BELOW = "(average - annual_amount)/average*100"


@query("permitted_increase", f"""SELECT contract_id, b.area_name, rent_property_type, b.rooms, annual_amount, type, average, {rnd(BELOW, 1)} AS below_pct, s AS increase_pct, {rnd("annual_amount*(s + 100)/100")} AS max_rent
  FROM (SELECT b.*, c.type, c.average, CASE WHEN {BELOW} <= 10 THEN 0 WHEN {BELOW} <= 20 THEN 5 WHEN {BELOW} <= 30 THEN 10 WHEN {BELOW} <= 40 THEN 15 ELSE 20 END AS s
    FROM (SELECT contract_id, area_name, rent_property_type, rooms, annual_amount FROM rent WHERE {REN}) b JOIN c ON c.area_name=b.area_name AND c.rooms=b.rooms AND c.type = CASE WHEN rent_property_type IN ('Villa','Complex Villas') THEN 'Villa' ELSE 'Flat' END) b""", c=CAPS)
def _(t):
    book = t.rent.filter(F.col("contract_reg_type") == "Renew").select("contract_id", "area_name", "rent_property_type", "rooms", "annual_amount")
    return areas.permitted_increase(book, areas.rent_caps(t.rent, AS_OF, 3))


@query("area_yield", f"""SELECT area_name, rent_psm, r.n AS rents, sale_psm, s.n AS sales, CASE WHEN r.n >= 5 AND s.n >= 5 THEN {shr("rent_psm", "sale_psm", 1)} END AS gross_yield
  FROM (SELECT area_name, {_ps(SIZED)} AS rent_psm, count(*) AS n FROM rent WHERE {HOME} AND {RY} GROUP BY 1) r FULL OUTER JOIN (SELECT area_name, {avg("meter_sale_price")} AS sale_psm, count(*) AS n FROM registration
    WHERE {SALE} AND property_type IN ('Unit','Villa') AND meter_sale_price > 0 AND rooms NOT IN ('','NA') AND {READY} AND {Y} GROUP BY 1) s USING (area_name)""")
def _(t):
    return areas.area_yield(t.rent, t.registration, AS_OF, 5, 5)


def _series(keys: str, period: str, where: str = "true", having: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}{period} AS period, {med("meter_sale_price", f"{APT} AND rooms <> ''")} AS psm, {cnt(f"{APT} AND rooms <> ''")} AS priced, count(*) AS n FROM registration WHERE {SALE} AND {where} GROUP BY {k}{period} {having}"""


MONTH = "CAST(date_trunc('month', instance_date) AS DATE)"
IN24 = "instance_date BETWEEN DATE '1999-07-01' AND DATE '2001-07-31'"
YEARLY = _series("", "CAST(year(instance_date) AS INT)", having=f"HAVING {cnt(APT)} >= 20")


@query("market_price_series", _series("", MONTH, IN24))
def _(t):
    return areas.price_volume_series(t.registration, month_start("instance_date"), since="1999-07-01", until="2001-07-31")


@query("area_price_series", _series("area_name", MONTH, IN24))
def _(t):
    return areas.price_volume_series(t.registration, month_start("instance_date"), ["area_name"], "1999-07-01", "2001-07-31")


@query("yearly_price_series", YEARLY)
def _(t):
    return areas.price_volume_series(t.registration, F.year("instance_date"), min_priced=20)


@query("project_price_series", f"SELECT project_number, {MONTH} AS month, {avg('meter_sale_price')} AS psm, count(*) AS n FROM registration WHERE {SALE} AND meter_sale_price > 0 AND instance_date BETWEEN DATE '1998-08-01' AND DATE '2001-07-31' GROUP BY ALL")
def _(t):
    return areas.mean_series(t.registration, ["project_number"], "1998-08-01", "2001-07-31", False)


@query("area_sparklines", f"SELECT area_name, {MONTH} AS month, {avg('meter_sale_price')} AS psm, count(*) AS n FROM registration WHERE {SALE} AND {APT} AND rooms <> '' AND instance_date BETWEEN DATE '2000-09-01' AND DATE '2001-08-31' GROUP BY ALL HAVING count(*) >= 3")
def _(t):
    return areas.mean_series(t.registration, ["area_name"], "2000-09-01", "2001-08-31", True, 3)


@query("history_facts", f"""SELECT v12 AS volume_12, v24 AS volume_prior_12, {chg("v12", "v24")} AS volume_change, psm_now, psm_year_ago, {chg("psm_now", "psm_year_ago")} AS psm_change,
    (SELECT period FROM yr ORDER BY psm DESC, period LIMIT 1) AS peak_year, (SELECT max(psm) FROM yr) AS peak_psm, (SELECT period FROM yr WHERE period > 1996 ORDER BY psm, period LIMIT 1) AS trough_year, (SELECT min(psm) FROM yr WHERE period > 1996) AS trough_psm
  FROM (SELECT CAST(sum(n) FILTER (WHERE rn <= 12) AS BIGINT) AS v12, CAST(sum(n) FILTER (WHERE rn BETWEEN 13 AND 24) AS BIGINT) AS v24, max(psm) FILTER (WHERE rn = 1) AS psm_now, max(psm) FILTER (WHERE period = DATE '2000-07-01') AS psm_year_ago
    FROM (SELECT *, row_number() OVER (ORDER BY period DESC) AS rn FROM mo))""", mo=_series("", MONTH, IN24), yr=YEARLY)
def _(t):
    monthly = areas.price_volume_series(t.registration, month_start("instance_date"), since="1999-07-01", until="2001-07-31")
    yearly = areas.price_volume_series(t.registration, F.year("instance_date"), min_priced=20)
    return areas.history_facts(monthly, yearly, trough_after=1996)


LOC = ("nearest_metro", "nearest_landmark", "nearest_mall", "master_project")


@query("project_location",
       "SELECT project_number, " + ", ".join(f"min(v) FILTER (WHERE k='{c}' AND rn=1) AS {c}" for c in LOC) + ", CAST(sum(n) FILTER (WHERE k='nearest_metro') AS BIGINT) AS n FROM (SELECT *, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY project_number, k, v IS NULL ORDER BY n DESC, v) END AS rn FROM loc) GROUP BY 1",
       loc=" UNION ALL ".join(f"SELECT project_number, '{c}' AS k, nullif(trim({c}),'') AS v, count(*) AS n FROM registration GROUP BY ALL" for c in LOC))
def _(t):
    return areas.project_location(t.registration)


@query("backfill_community", """SELECT project_number, coalesce(nullif(trim(master_project),''), m) AS master_project FROM project LEFT JOIN (SELECT project_number, max_by(v, row(n, -rk)) AS m FROM (
    SELECT *, rank() OVER (ORDER BY v) AS rk FROM (SELECT project_number, trim(master_project) AS v, count(*) AS n FROM registration GROUP BY ALL)) GROUP BY 1) USING (project_number)""")
def _(t):
    location = areas.modal_by(t.registration, ["project_number"], "master_project")
    return areas.backfill_community(t.project, location).select("project_number", "master_project")


@query("recent_registrations", f"""SELECT project_number, instance_date, reg_type, procedure_name, building_name, rooms, procedure_area, actual_worth, meter_sale_price, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY project_number ORDER BY instance_date DESC, actual_worth DESC, procedure_area, area_name, procedure_name, building_name, rooms) AS rank FROM registration WHERE {SALE}) WHERE rank <= 15""")
def _(t):
    return areas.recent_registrations(t.registration)


CHARGES = """SELECT year(contract_start_date)::INT AS budget_year, p.project_name, 'Block ' || CAST(CAST(r.actual_area AS INT) % 3 AS VARCHAR) AS property_group, rent_property_type AS usage, 'Manager ' || r.project_number AS management_company, annual_amount/10 AS cost FROM rent r JOIN project p USING (project_number)"""


@query("service_charge_summary", f"""SELECT p.project_number, l.budget_year, l.property_group, l.usage, l.total, l.manager, {rnd("y.latest/nullif(p.units,0)")} AS latest_per_unit
  FROM project p JOIN l ON l.nm = upper(p.project_name) JOIN (SELECT nm, max_by(t, budget_year) AS latest FROM (SELECT nm, budget_year, sum(total) AS t FROM l GROUP BY ALL) GROUP BY 1) y ON y.nm = l.nm""",
       ch=CHARGES, l=f"SELECT upper(project_name) AS nm, budget_year, property_group, usage, {tot('cost', 0)} AS total, max(management_company) AS manager FROM ch GROUP BY ALL")
def _(t):
    charges = t.rent.join(t.project.select("project_number", "project_name"), "project_number").select(
        F.year("contract_start_date").alias("budget_year"), "project_name", F.concat(F.lit("Block "), (F.col("actual_area").cast("int") % 3).cast("string")).alias("property_group"),
        F.col("rent_property_type").alias("usage"), F.concat(F.lit("Manager "), "project_number").alias("management_company"), (F.col("annual_amount") / 10).alias("cost"))
    return areas.service_charge_summary(charges, t.project)


KIND = "CASE CAST(actual_area AS INT) % 5 WHEN 0 THEN 'New Building' WHEN 1 THEN 'Building permit' WHEN 2 THEN 'New building - modification' WHEN 3 THEN 'Demolition' ELSE 'Fit out' END"


def _permits(t):
    size = F.col("actual_area").cast("int") % 5
    kind = F.when(size == 0, F.lit("New Building")).when(size == 1, F.lit("Building permit")).when(size == 2, F.lit("New building - modification")).when(
        size == 3, F.lit("Demolition")).otherwise(F.lit("Fit out"))
    return t.rent.select(F.col("contract_start_date").alias("permit_date"), "area_name", text.is_new_building(kind).alias("is_new_building"))


@query("permit_series", f"SELECT CAST(date_trunc('month', contract_start_date) AS DATE) AS month, count(*) AS permits, {cnt('CAST(actual_area AS INT) % 5 < 2')} AS new_buildings FROM rent GROUP BY 1")
def _(t):
    return areas.permit_series(_permits(t))


@query("permits_by_area", f"SELECT area_name, count(*) AS permits, {cnt('CAST(actual_area AS INT) % 5 < 2')} AS new_buildings FROM rent WHERE {RY} GROUP BY 1")
def _(t):
    return areas.permits_by_area(_permits(t), AS_OF)


@query("read_dates", f"""SELECT (SELECT max(instance_date) FROM registration) AS tx_to, (SELECT min(instance_date) FROM registration) AS tx_from, (SELECT count(*) FROM registration WHERE {SALE}) AS tx_n,
    (SELECT {rnd(tot("actual_worth") + "/1e6::DOUBLE", 1)} FROM registration WHERE {SALE}) AS tx_value, (SELECT max(contract_start_date) FROM rent WHERE contract_start_date <= {A}) AS rent_to, (SELECT count(*) FROM rent) AS rent_n,
    (SELECT max(observed_at) FROM observation) AS register_at, (SELECT count(*) FROM project) AS register_n""")
def _(t):
    return areas.read_dates(t.registration, t.rent, t.observation, t.project, AS_OF, 1e6)


ALIAS = {"NATION_1": "Harbour District", "NATION_2": "Garden City"}
ALIASED = "CASE area_name WHEN 'NATION_1' THEN 'Harbour District' WHEN 'NATION_2' THEN 'Garden City' END"


@query("search_index", f"""SELECT 'Area' AS kind, NULL AS project_number, coalesce({ALIASED} || ' (' || area_name || ')', area_name) AS name, NULL AS context, 'areas/' || area_slug AS page FROM d
  UNION ALL SELECT 'Project', project_number, project_name, coalesce({ALIASED}, area_name), area_slug || '/' || slug FROM project
  UNION ALL SELECT 'Developer', NULL, developer_name, NULL, 'developers/' || developer_slug FROM developer WHERE developer_number IN (SELECT developer_number FROM project)""", d=DIRECTORY)
def _(t):
    return areas.search_index(t.project, t.registration, t.developer, ALIAS)


@query("moved_or_sold_keys", f"SELECT project_number FROM observation UNION SELECT project_number FROM registration WHERE {SALE}")
def _(t):
    return areas.key_union(t.observation, t.registration.filter(F.col("trans_group") == "Sales"), "project_number")


@query("unsold_keys", f"SELECT DISTINCT project_number FROM project WHERE project_number NOT IN (SELECT project_number FROM registration WHERE {SALE} AND {Y})")
def _(t):
    sold = t.registration.filter((F.col("trans_group") == "Sales") & (F.col("instance_date") >= "2000-08-01"))
    return areas.key_minus(t.project, sold, "project_number")
