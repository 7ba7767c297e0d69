"""Panel, vintage and quality queries."""

from pyspark.sql import functions as F


from cadastra.operators import identity, panels, quality, readings, valuation, vintages
from cadastra.plans import identity_queries as iq
from cadastra.plans import issuer_queries as sq
from cadastra.plans import valuation_queries as vq
from cadastra.plans.adapters import AS_OF
from cadastra.plans.reading_queries import latest_sql
from cadastra.plans.registry import chg, cnt, med, query, rnd, shr, tot  # noqa: F401
from cadastra.plans.resale_queries import solved_index
from cadastra.session import materialize

A = f"DATE '{AS_OF}'"
RULES = panels.PanelRules(land_max_sqm=30.0, max_orphan_share=0.05)
# Stand-in units seldom register twice, so some sales are staged again: half a year later a little dearer, a year later a
# tenth dearer, and once more before the first time.
WALK = panels.PanelRules(land_max_sqm=30.0)
FROM_Q = "1998Q1"
# Fixed panel scope: whole developers, one less a project, one by named projects.
CONFIG = [("0", "whole", [], []), ("1", "whole", [], []), ("2", "carved", [], ["12", "22"]), ("3", "named", ["3", "13", "23"], []), ("5", "whole", [], [])]


def _config(t):
    return t.spark.createDataFrame(CONFIG, "developer_number string, attribution_scope string, project_numbers array<string>, exclude_project_numbers array<string>")


def _entities(t):
    return panels.entity_projects(_config(t), t.project)


ENT = """SELECT CASE developer_number WHEN '3' THEN '3/3+13+23' ELSE developer_number END AS entity_id, developer_number, CASE developer_number WHEN '2' THEN 'carved' WHEN '3' THEN 'named' ELSE 'whole' END AS attribution_scope, project_number FROM project
  WHERE developer_number IN ('0','1','5') OR (developer_number = '2' AND project_number NOT IN ('12','22')) OR project_number IN ('3','13','23')"""


@query("entity_projects", "SELECT *, CAST(NULL AS VARCHAR) AS problem FROM ent", ent=ENT)
def _(t):
    return _entities(t)


Q = "CAST(year(instance_date) AS VARCHAR) || 'Q' || CAST(quarter(instance_date) AS VARCHAR)"
IN = f"instance_date BETWEEN DATE '1998-01-01' AND {A}"


def _panel_sql(stat: str) -> str:
    price = rnd(f"median(meter_sale_price) FILTER (WHERE meter_sale_price BETWEEN 500 AND 200000)", 4) if stat == "median" else rnd(tot("CASE WHEN meter_sale_price BETWEEN 500 AND 200000 THEN meter_sale_price END") + "/nullif(count(*) FILTER (WHERE meter_sale_price BETWEEN 500 AND 200000),0)", 4)
    off, ready = "reg_type='Off-Plan Properties'", "reg_type='Existing Properties'"
    return f"""SELECT {Q} AS quarter, entity_id, {cnt(off)} AS offplan_count, coalesce({tot(f"CASE WHEN {off} THEN actual_worth END")},0) AS offplan_value, {cnt(ready)} AS ready_count, coalesce({tot(f"CASE WHEN {ready} THEN actual_worth END")},0) AS ready_value,
      count(*) AS total_count, {tot("actual_worth")} AS total_value, count(DISTINCT project_number) AS active_projects, {price} AS price_per_sqm FROM registration JOIN ent USING (project_number) WHERE {IN} GROUP BY ALL"""


@query("registrations_panel", _panel_sql("median").replace(f"WHERE {IN}", f"WHERE {IN} AND trans_group='Sales'"), ent=ENT)
def _(t):
    return panels.registrations_panel(t.registration, _entities(t), RULES, FROM_Q, AS_OF)


@query("registrations_panel_mean", _panel_sql("mean"), ent=ENT)
def _(t):
    every = panels.PanelRules(statistic="mean", groups=None)
    return panels.registrations_panel(t.registration, _entities(t), every, FROM_Q, AS_OF)


AGAIN = """SELECT instance_date, actual_worth, meter_sale_price, procedure_name, trans_group, property_type, building_name, rooms, procedure_area, area_name, project_number FROM registration
  UNION ALL SELECT instance_date + v.days, actual_worth * v.dearer, meter_sale_price, 'Delayed Sell', trans_group, property_type, building_name, rooms, procedure_area, area_name, project_number
  FROM registration, (VALUES (1, 180, 1.003::DOUBLE), (2, 365, 1.1::DOUBLE), (3, -30, 0.999::DOUBLE), (1, 200, 0.998::DOUBLE)) v(k, days, dearer) WHERE procedure_name = 'Sell - Pre registration' AND dayofmonth(instance_date) % 4 = v.k"""
DEV = f"""SELECT *, row_number() OVER (PARTITION BY unit ORDER BY instance_date, actual_worth, is_first, procedure_name, area_name, meter_sale_price) AS k FROM (
  SELECT again.*, entity_id, procedure_name = 'Sell - Pre registration' AS is_first, (project_number, trim(coalesce(building_name, '')), property_type, coalesce(rooms, ''), round(coalesce(procedure_area, 0), 2)) AS unit FROM again JOIN ent USING (project_number)
  WHERE trans_group = 'Sales' AND procedure_name IN ('Sell - Pre registration','Delayed Sell','Sale On Payment Plan') AND (property_type IN ('Unit','Villa') OR (property_type = 'Land' AND coalesce(procedure_area, 0) <= 30)) AND instance_date <= {A})"""
# The walk itself, registration by registration of every unit at once: the open first prices of the unit in the order they came.
STEPS = """WITH RECURSIVE s(unit, k, open, is_repeat) AS (
  SELECT unit, k, CASE WHEN is_first THEN [actual_worth] ELSE CAST([] AS DOUBLE[]) END, false FROM dev WHERE k = 1
  UNION ALL SELECT unit, k, CASE WHEN is_first THEN list_append(open, actual_worth) WHEN hit IS NULL THEN open ELSE list_concat(open[:hit - 1], open[hit + 1:]) END, hit IS NOT NULL FROM (
    SELECT dev.*, s.open, CASE WHEN NOT dev.is_first AND dev.actual_worth > 0 THEN nullif(list_position(list_transform(s.open, lambda o: abs(o - dev.actual_worth) / o <= 0.005::DOUBLE), true), 0) END AS hit
    FROM s JOIN dev ON dev.unit = s.unit AND dev.k = s.k + 1)) SELECT unit, k, is_repeat FROM s"""
MARKED = {"ent": ENT, "again": AGAIN, "dev": DEV, "steps": STEPS, "marked": "SELECT dev.*, is_repeat FROM dev JOIN steps USING (unit, k)"}


def _marked(t):
    base = t.registration.select("instance_date", "actual_worth", "meter_sale_price", "procedure_name", "trans_group", "property_type", "building_name", "rooms", "procedure_area", "area_name", "project_number")
    staged = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(days).alias("days"), F.lit(dearer).alias("dearer")) for k, days, dearer in ((1, 180, 1.003), (2, 365, 1.1), (3, -30, 0.999), (1, 200, 0.998))])
    again = base.filter(F.col("procedure_name") == "Sell - Pre registration").withColumn("v", F.explode(staged)).filter(F.dayofmonth("instance_date") % 4 == F.col("v.k"))
    again = again.withColumns({"instance_date": F.date_add("instance_date", F.col("v.days")), "actual_worth": F.col("actual_worth") * F.col("v.dearer"), "procedure_name": F.lit("Delayed Sell")}).drop("v")
    return panels.mark_repeats(base.unionByName(again), _entities(t), WALK, AS_OF)


@query("first_sales_panel", f"""SELECT {Q} AS quarter, entity_id, {cnt("NOT is_repeat")} AS first_sale_units, coalesce({tot("CASE WHEN NOT is_repeat THEN actual_worth END")}, 0) AS first_sale_value,
    {cnt("NOT is_repeat AND is_first")} AS offplan_units, coalesce({tot("CASE WHEN NOT is_repeat AND is_first THEN actual_worth END")}, 0) AS offplan_value, {cnt("NOT is_repeat AND NOT is_first")} AS delayed_units,
    coalesce({tot("CASE WHEN NOT is_repeat AND NOT is_first THEN actual_worth END")}, 0) AS delayed_value, {cnt("is_repeat")} AS repeats_dropped, coalesce({tot("CASE WHEN is_repeat THEN actual_worth END")}, 0) AS repeat_value,
    count(DISTINCT project_number) FILTER (WHERE NOT is_repeat) AS active_projects, {rnd("median(meter_sale_price) FILTER (WHERE NOT is_repeat AND meter_sale_price BETWEEN 500 AND 200000)", 4)} AS price_per_sqm
  FROM marked WHERE instance_date >= DATE '1998-01-01' GROUP BY ALL""", **MARKED)
def _(t):
    return panels.first_sales_panel(materialize(_marked(t), "first-sales"), WALK, FROM_Q)


@query("first_sales_raw", f"""SELECT {Q} AS quarter, entity_id, count(*) AS raw, {tot("actual_worth")} AS worth FROM dev GROUP BY ALL""", ent=ENT, again=AGAIN, dev=DEV)
def _(t):
    """The panel's identity: first sales plus repeats are all the registrations."""
    from cadastra.functions.numbers import quarter_label, total
    return _marked(t).groupBy(quarter_label("instance_date").alias("quarter"), "entity_id").agg(F.count(F.lit(1)).alias("raw"), total("actual_worth").alias("worth"))


# Registrations of every tenth number name a project the register does not hold, so that some are orphans.
MOVED = "SELECT * REPLACE (CASE WHEN project_number LIKE '%7' THEN 'unlisted ' || project_number ELSE project_number END AS project_number) FROM registration"
ORPH = f"SELECT quarter, registrations, orphans, {rnd('orphans/registrations', 6)} AS orphan_share FROM (SELECT {Q} AS quarter, count(*) AS registrations, {cnt('h.project_number IS NULL')} AS orphans FROM moved r LEFT JOIN project h USING (project_number) WHERE trans_group='Sales' AND {IN} GROUP BY 1)"


def _orphans(t):
    number = F.when(F.col("project_number").endswith("7"), F.concat(F.lit("unlisted "), "project_number")).otherwise(F.col("project_number"))
    return panels.orphan_share(t.registration.withColumn("project_number", number), t.project, RULES, FROM_Q, AS_OF)


@query("orphan_share", "SELECT * FROM o", moved=MOVED, o=ORPH)
def _(t):
    return _orphans(t)


@query("panel_maturity", """SELECT quarter, orphan_share, CASE WHEN age < 2 OR (ov AND age < 6) THEN 'provisional' ELSE 'mature' END AS maturity, concat_ws(',', CASE WHEN age < 2 THEN 'recent' END, CASE WHEN ov AND age < 6 THEN 'orphans' END) AS reasons, ov AND age >= 6 AS attribution_gap
  FROM (SELECT *, 2001*4 + 2 - (CAST(substr(quarter,1,4) AS INT)*4 + CAST(substr(quarter,6,1) AS INT) - 1) AS age, orphans/registrations > 0.05::DOUBLE AS ov FROM o)""", moved=MOVED, o=ORPH)
def _(t):
    return panels.panel_maturity(_orphans(t), RULES, AS_OF)


@query("unscoped_projects", """SELECT developer_number, project_number, project_name, n AS registrations FROM project JOIN (SELECT project_number, count(*) AS n FROM registration WHERE trans_group='Sales' AND instance_date >= DATE '1998-01-01' GROUP BY 1) USING (project_number)
  WHERE developer_number='3' AND project_number NOT IN ('3','13','23')""")
def _(t):
    return panels.unscoped_projects(_config(t), _entities(t), t.project, t.registration, FROM_Q)


DAYS = "(instance_date - project_start_date)"


@query("registration_lag", f"""SELECT developer_number, {Q} AS quarter, CASE WHEN {DAYS} < -10000 THEN NULL WHEN {DAYS} < 90 THEN 'under_3_months' WHEN {DAYS} < 180 THEN '3_to_6_months' WHEN {DAYS} < 365 THEN '6_to_12_months' WHEN {DAYS} < 548 THEN '12_to_18_months' WHEN {DAYS} >= 548 THEN 'over_18_months' ELSE 'no_start_date' END AS lag_bucket,
    count(*) AS registrations, {tot("actual_worth")} AS first_sale_value FROM registration JOIN project USING (project_number) WHERE instance_date >= DATE '1998-01-01' AND procedure_name IN ('Sell - Pre registration','Delayed Sell','Sale On Payment Plan')
    AND (property_type IN ('Unit','Villa') OR (property_type='Land' AND procedure_area <= 30)) GROUP BY ALL""")
def _(t):
    return panels.registration_lag(t.registration, t.project, None, FROM_Q, RULES)


REC = f"""SELECT quarter, entity_id, CASE WHEN total_count < 4 THEN total_count + 1 ELSE total_count END AS total_count, total_value*(CASE WHEN entity_id='1' THEN 1.0001::DOUBLE ELSE 1 END) AS total_value FROM pn WHERE NOT (entity_id='0' AND quarter='1999Q1')"""


@query("reconcile", """SELECT quarter, entity_id, CASE WHEN r.total_count IS NULL THEN 'missing' WHEN l.total_count IS NULL THEN 'extra' WHEN l.total_count <> r.total_count OR abs(l.total_value - r.total_value) > 1e-6*greatest(1, abs(l.total_value)) THEN 'mismatch' ELSE 'match' END AS outcome,
    CASE WHEN r.total_count IS NOT NULL AND l.total_count IS NOT NULL AND (l.total_count <> r.total_count OR abs(l.total_value - r.total_value) > 1e-6*greatest(1, abs(l.total_value))) THEN
      concat_ws(',', CASE WHEN abs(l.total_value - r.total_value) > 1e-6*greatest(1, abs(l.total_value)) THEN 'total_value' END, CASE WHEN l.total_count <> r.total_count THEN 'total_count' END) END AS columns
  FROM (SELECT * FROM pn WHERE NOT (entity_id='5' AND quarter='2000Q2')) l FULL OUTER JOIN rc r USING (quarter, entity_id)""",
       ent=ENT, pn=_panel_sql("median").replace(f"WHERE {IN}", f"WHERE {IN} AND trans_group='Sales'"), rc=REC)
def _(t):
    panel = materialize(panels.registrations_panel(t.registration, _entities(t), RULES, FROM_Q, AS_OF), "panel")
    c = F.col
    left = panel.filter(~((c("entity_id") == "5") & (c("quarter") == "2000Q2")))
    right = panel.filter(~((c("entity_id") == "0") & (c("quarter") == "1999Q1"))).select(
        "quarter", "entity_id", F.when(c("total_count") < 4, c("total_count") + 1).otherwise(c("total_count")).alias("total_count"),
        (c("total_value") * F.when(c("entity_id") == "1", F.lit(1.0001)).otherwise(F.lit(1.0))).alias("total_value"))
    return panels.reconcile(left, right, ["quarter", "entity_id"], {"total_value": 1e-6}, ["total_count"])


# ---- vintages ----

FRM, TO = "2001-07-01", "2001-07-29"
S = "registration_seen"


def _present(d: str) -> str:
    return f"((first_seen IS NULL OR first_seen <= DATE '{d}') AND (withdrawn_on IS NULL OR withdrawn_on > DATE '{d}'))"


OFF = "reg_type='Off-Plan Properties'"
BYM = f"""SELECT *, n_now - n_then AS change, off_now - off_then AS off_change FROM (SELECT strftime(instance_date, '%Y-%m') AS month, {cnt(_present(FRM))} AS n_then, {cnt(_present(TO))} AS n_now, {rnd("coalesce(" + tot(f"CASE WHEN {_present(TO)} THEN actual_worth END") + ",0)/1e6::DOUBLE", 2)} AS value_now,
    {cnt(f"{_present(FRM)} AND {OFF}")} AS off_then, {cnt(f"{_present(TO)} AND {OFF}")} AS off_now, {rnd("coalesce(" + tot(f"CASE WHEN {_present(TO)} AND {OFF} THEN actual_worth END") + ",0)/1e6::DOUBLE", 2)} AS off_value_now
  FROM {S} WHERE trans_group='Sales' AND instance_date BETWEEN DATE '2001-01-01' AND DATE '{TO}' GROUP BY 1)"""


@query("vintage_by_month", "SELECT * FROM m", m=BYM)
def _(t):
    return vintages.vintage_by_month(t.registration_seen, FRM, TO, "2001-01-01", 1e6)


GAIN = f"trans_group='Sales' AND first_seen > DATE '{FRM}' AND first_seen <= DATE '{TO}' AND withdrawn_on IS NULL"
DATED = f"trans_group='Sales' AND instance_date > DATE '{FRM}' AND instance_date <= DATE '{TO}' AND (withdrawn_on IS NULL OR withdrawn_on > DATE '{TO}')"
GONE = f"withdrawn_on > DATE '{FRM}' AND withdrawn_on <= DATE '{TO}'"


@query("moved_summary", f"""SELECT '{FRM}..{TO}' AS "window", {cnt(GAIN)} AS gained, {rnd(tot(f"CASE WHEN {GAIN} THEN actual_worth END") + "/1e6::DOUBLE", 2)} AS gained_value, {cnt(DATED)} AS dated, {rnd(tot(f"CASE WHEN {DATED} THEN actual_worth END") + "/1e6::DOUBLE", 2)} AS dated_value,
    {cnt(GONE)} AS withdrawn, {cnt(f"{GAIN} AND instance_date <= DATE '{FRM}'")} AS late_registrations, {med("(first_seen - instance_date)::DOUBLE", f"{GAIN} AND instance_date > DATE '{FRM}'")} AS median_lag_days FROM {S}""")
def _(t):
    return vintages.moved_summary(t.registration_seen, FRM, TO, 1e6)


COLS = "instance_date, project_number, area_name, reg_type, procedure_area, actual_worth, withdrawn_on"


@query("withdrawn_rows", f"SELECT {COLS} FROM {S} WHERE {GONE}")
def _(t):
    return vintages.withdrawn(t.registration_seen, FRM, TO).select(*COLS.split(", "))


PSM = "CASE WHEN meter_sale_price > 0 AND meter_sale_price < 200000 THEN meter_sale_price END"
GAINED = f"SELECT * FROM {S} WHERE {GAIN}"


def _near(p: float) -> str:
    v = f"list_sort(list({PSM}) FILTER (WHERE {PSM} IS NOT NULL))"
    return rnd(rnd(f"({v})[CAST(floor((count({PSM}) - 1)*{p}::DOUBLE + 0.5::DOUBLE) AS BIGINT) + 1]", 4))


@query("gained_profile", f"""SELECT 'all' AS scope, count(*) AS n, {rnd(tot("actual_worth") + "/1e6::DOUBLE", 2)} AS value, {cnt(OFF)} AS offplan, {shr(cnt(OFF), "count(*)")} AS offplan_pct, count({PSM}) AS with_area, {med("actual_worth", "actual_worth > 0")} AS median_price, {rnd(rnd(f"median({PSM})", 4))} AS median_psm,
    {_near(0.1)} AS p10, {_near(0.25)} AS p25, {_near(0.5)} AS p50, {_near(0.75)} AS p75, {_near(0.9)} AS p90 FROM g""", g=GAINED)
def _(t):
    return vintages.sales_profile(vintages.gained(t.registration_seen, FRM, TO), 1e6)


HIST = (("0-1k", 0, 1_000), ("1-1.2k", 1_000, 1_200), ("1.2-1.5k", 1_200, 1_500), ("1.5-2k", 1_500, 2_000), ("2k+", 2_000, 1e9))


@query("gained_histogram", " UNION ALL ".join(f"SELECT {i} AS pos, '{b}' AS bucket, {cnt(f'meter_sale_price >= {lo} AND meter_sale_price < {hi}')} AS n FROM g" for i, (b, lo, hi) in enumerate(HIST)), g=GAINED)
def _(t):
    return vintages.psm_histogram(vintages.gained(t.registration_seen, FRM, TO), HIST)


DIMS = {"area": "area_name", "project": "project_number", "rooms": "coalesce(nullif(rooms,''),'Not stated')", "type": "property_type", "usage": "property_usage"}
TOP = {"area": 12, "project": 14, "rooms": 10, "type": 6, "usage": 4}
TOPCASE = "CASE dimension " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TOP.items()) + " END"
PROF = f"""SELECT dimension, key, CAST(rank AS INT) AS rank, n, {shr("n", "(SELECT count(*) FROM g)", 1)} AS share, {rnd("w/1e6::DOUBLE", 2)} AS value, {rnd(rnd("m", 4))} AS median_psm, {shr("o", "n")} AS offplan_pct FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS rank FROM (
    SELECT dimension, key, count(*) AS n, {tot("actual_worth")} AS w, {cnt(OFF)} AS o, median({PSM}) AS m FROM ({" UNION ALL ".join(f"SELECT '{k}' AS dimension, {e} AS key, actual_worth, meter_sale_price, reg_type FROM g" for k, e in DIMS.items())}) WHERE key <> '' GROUP BY ALL)) WHERE rank <= {TOPCASE}"""


def _keys():
    return {"area": F.col("area_name"), "project": F.col("project_number"), "rooms": F.coalesce(F.nullif("rooms", F.lit("")), F.lit("Not stated")), "type": F.col("property_type"), "usage": F.col("property_usage")}


@query("gained_groups", "SELECT * FROM p", g=GAINED, p=PROF)
def _(t):
    return vintages.profile(vintages.gained(t.registration_seen, FRM, TO), _keys(), TOP, 1e6)


RD = "SELECT * FROM rent WHERE contract_start_date > DATE '2001-05-01' AND contract_start_date <= DATE '2001-07-29'"
RDIM = {"area": "area_name", "rooms": "coalesce(nullif(rooms,''),'Not stated')", "type": "rent_property_type"}
NEW = "contract_reg_type ILIKE 'new%'"


@query("rent_profile", f"""SELECT dimension, key, CAST(rank AS INT) AS rank, n, {shr("n", "(SELECT count(*) FROM rd)", 1)} AS share, {rnd(rnd("r", 4))} AS median_rent, {rnd(rnd("p", 4))} AS median_psm, {shr("w", "n")} AS new_pct FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS rank FROM (
    SELECT dimension, key, count(*) AS n, {cnt(NEW)} AS w, median(annual_amount) FILTER (WHERE annual_amount > 1000 AND annual_amount < 5e7) AS r, median(annual_amount/actual_area) FILTER (WHERE actual_area > 10 AND annual_amount > 1000 AND annual_amount/actual_area < 20000) AS p
    FROM ({" UNION ALL ".join(f"SELECT '{k}' AS dimension, {e} AS key, annual_amount, actual_area, contract_reg_type FROM rd" for k, e in RDIM.items())}) WHERE key <> '' GROUP BY ALL)) WHERE rank <= CASE dimension WHEN 'area' THEN 12 WHEN 'rooms' THEN 8 ELSE 5 END""", rd=RD)
def _(t):
    rows = t.rent.filter((F.col("contract_start_date") > "2001-05-01") & (F.col("contract_start_date") <= "2001-07-29"))
    keys = {"area": F.col("area_name"), "rooms": F.coalesce(F.nullif("rooms", F.lit("")), F.lit("Not stated")), "type": F.col("rent_property_type")}
    return vintages.rent_profile(rows, keys, {"area": 12, "rooms": 8, "type": 5})


@query("vintage_census", f"""SELECT 'tx' AS kind, count(*) AS n, min(first_seen) AS first, max(first_seen) AS last FROM {S} UNION ALL SELECT 'project', count(*), min(f), max(f) FROM (SELECT project_number, min(observed_at) AS f FROM observation GROUP BY 1)""")
def _(t):
    tx = t.registration_seen.select(F.lit("tx").alias("kind"), "first_seen")
    projects = t.observation.groupBy("project_number").agg(F.min("observed_at").alias("first_seen")).select(F.lit("project").alias("kind"), "first_seen")
    return vintages.vintage_census(tx.unionByName(projects))


CURVE = f"""SELECT seen, added, CAST(sum(added) OVER (ORDER BY seen NULLS FIRST) AS BIGINT) AS running, coalesce(seen > DATE '2001-05-31', true) AS after_close FROM (SELECT first_seen AS seen, count(*) AS added FROM {S} WHERE {OFF} AND instance_date BETWEEN DATE '2001-05-01' AND DATE '2001-05-31' GROUP BY 1)"""


@query("as_seen_curve", "SELECT * FROM c", c=CURVE)
def _(t):
    return vintages.as_seen_curve(t.registration_seen, "2001-05", "first_seen")


@query("as_seen_totals", f"SELECT CAST(sum(added) AS BIGINT) AS total, CAST(coalesce(sum(added) FILTER (WHERE NOT after_close),0) AS BIGINT) AS at_close, CAST(sum(added) - coalesce(sum(added) FILTER (WHERE NOT after_close),0) AS BIGINT) AS tail FROM c", c=CURVE)
def _(t):
    return vintages.as_seen_totals(vintages.as_seen_curve(t.registration_seen, "2001-05", "first_seen"))


@query("dedupe_bound", f"""SELECT CAST(coalesce(sum(n - 1),0) AS BIGINT) AS collapsed, CAST(coalesce(sum(n),0) AS BIGINT) AS in_groups FROM (SELECT count(*) AS n FROM registration WHERE {OFF} AND instance_date BETWEEN DATE '2001-05-01' AND DATE '2001-05-31'
  GROUP BY procedure_name, instance_date, area_name, building_name, project_number, rooms, printf('%.2f', procedure_area), printf('%.2f', actual_worth) HAVING count(*) > 1)""")
def _(t):
    return vintages.dedupe_bound(t.registration, "2001-05")


RM = {"b": latest_sql("2001-07-15"), "a": latest_sql(TO),
      "rm": f"""SELECT CASE WHEN a.status <> b.status THEN b.status || '>' || a.status END AS status_change, CASE WHEN a.completion_date <> b.completion_date THEN {rnd("(a.completion_date - b.completion_date)/30.44::DOUBLE", 1)} END AS shift FROM a JOIN b USING (project_number) WHERE a.id <> b.id"""}


@query("status_transitions", "SELECT status_change, count(*) AS n FROM rm WHERE status_change IS NOT NULL GROUP BY 1", **RM)
def _(t):
    return vintages.status_transitions(readings.register_moves(t.observation, t.project, "2001-07-15", TO))


@query("edition_facts", f"""SELECT CAST((SELECT coalesce(sum(change) FILTER (WHERE change < 0),0) FROM m) AS BIGINT) AS restated, (SELECT count(*) FROM m WHERE change > 0) AS months_gained, (SELECT {rnd("sum(share)", 1)} FROM p WHERE dimension='area' AND rank <= 5) AS top_five_share,
    CAST((SELECT coalesce(sum(n),0) FROM p WHERE dimension='rooms' AND regexp_matches(key, '(?i)studio|^1 B')) AS BIGINT) AS small_units, (SELECT count(*) FROM observation WHERE observed_at > DATE '{FRM}' AND observed_at <= DATE '{TO}') AS readings_in_window,
    (SELECT list_sort(list(shift) FILTER (WHERE shift IS NOT NULL))[count(shift)//2 + 1] FROM rm) AS completion_shift_upper_middle, CAST(DATE '{TO}' - (SELECT max(observed_at) FROM observation WHERE source='api' AND observed_at <= DATE '{TO}') AS INT) AS stamp_age_days""",
       m=BYM, g=GAINED, p=PROF, **RM)
def _(t):
    groups = materialize(vintages.profile(vintages.gained(t.registration_seen, FRM, TO), _keys(), TOP, 1e6), "groups")
    pick = lambda d: groups.filter(F.col("dimension") == d)
    return vintages.edition_facts(vintages.vintage_by_month(t.registration_seen, FRM, TO, "2001-01-01", 1e6), pick("area"), pick("rooms"),
                                  readings.register_moves(t.observation, t.project, "2001-07-15", TO), readings.reading_ages(t.observation, TO), FRM, TO)


# ---- quality ----

QR = f"""SELECT 'key shapes' AS "check", 'ok' AS outcome, 4 AS found UNION ALL SELECT 'groups stay apart', 'ok', 1 UNION ALL SELECT 'number parsing', 'ok', 1 UNION ALL SELECT 'unreadable numbers rejected', 'ok', 0
  UNION ALL SELECT 'no duplicate keys', CASE WHEN n = 0 THEN 'ok' ELSE 'fail' END, n FROM (SELECT count(*) AS n FROM (SELECT tx_key FROM k GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'every row keyed', CASE WHEN n = 0 THEN 'ok' ELSE 'warn' END, n FROM (SELECT {cnt("tx_key IS NULL")} AS n FROM k)
  UNION ALL SELECT 'withdrawals were filed', CASE WHEN n = 0 THEN 'ok' ELSE 'fail' END, n FROM (SELECT {cnt("withdrawn_on IS NOT NULL AND feed_date IS NULL")} AS n FROM k)
  UNION ALL SELECT 'anchor 2000', CASE WHEN n = (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N' AND year(l_shipdate) = 2000) THEN 'ok' ELSE 'fail' END, n FROM (SELECT count(*) AS n FROM k WHERE trans_group='Sales' AND instance_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31')
  UNION ALL SELECT 'no month out of scale', CASE WHEN n = 0 THEN 'ok' ELSE 'warn' END, n FROM (SELECT {cnt("n > md*1.6::DOUBLE")} AS n FROM mo, (SELECT list_sort(list(n))[count(*)//2 + 1] AS md FROM mo))
  UNION ALL SELECT 'every tx has a vintage', CASE WHEN n = 0 THEN 'ok' ELSE 'fail' END, n FROM (SELECT count(*) AS n FROM k WHERE transaction_id NOT IN (SELECT transaction_id FROM k WHERE first_seen < DATE '2001-10-01'))"""


@query("quality_report", QR, k=iq.KEYED, mo=f"SELECT date_trunc('month', instance_date) AS m, count(*) AS n FROM k WHERE trans_group='Sales' AND instance_date >= DATE '2000-07-01' AND instance_date < DATE '2001-08-01' GROUP BY 1")
def _(t):
    tx = materialize(iq.keyed(t).select("transaction_id", "tx_key", "trans_group", "instance_date", "feed_date", "first_seen", "withdrawn_on"), "quality-tx")
    ids = tx.withColumnRenamed("transaction_id", "id")
    seen = ids.filter(F.col("first_seen") < "2001-10-01")
    # The closed period's figure is taken from the raw lines, before any of the joins the register is made by.
    raw = t.raw("lineitem").filter((F.col("l_returnflag") == "N") & (F.year("l_shipdate") == 2000)).agg(F.count(F.lit(1))).scalar()
    return quality.quality_report(tx, {"tx": (ids, seen)}, [("2000", "2000-01-01", "2000-12-31", raw)], AS_OF)


@query("reading_currency", f"""SELECT 'flag follows the reading date' AS "check", 'ok' AS outcome, 0 AS found UNION ALL SELECT 'live counts add up', 'ok', 0
  UNION ALL SELECT 'no percentage above 100', CASE WHEN n = 0 THEN 'ok' ELSE 'fail' END, n FROM (SELECT {cnt("certified_pct > 100")} AS n FROM reg) UNION ALL SELECT 'handover rests on current readings', 'ok', 0""", **sq.R)
def _(t):
    register = materialize(sq._register(t), "register")
    from cadastra.operators import issuers
    return quality.reading_currency(register, issuers.handover_candidates(register, AS_OF, sq.BS, "2001-01-01"), sq.CUR)


@query("model_gates", """SELECT 'valuation tested' AS "check", CASE WHEN n >= 2000 THEN 'ok' ELSE 'fail' END AS outcome, CAST(n AS BIGINT) AS found FROM (SELECT coalesce(max(n), 0) AS n FROM cal WHERE bucket = 'all')
  UNION ALL SELECT 'valuation error', CASE WHEN coalesce(e <= 8, false) THEN 'ok' ELSE 'fail' END, CAST(round(e) AS BIGINT) FROM (SELECT max(median_abs_error_pct) AS e FROM cal WHERE bucket = 'all')
  UNION ALL SELECT 'index in use', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'fail' END, count(*) FROM ix""", **vq.ON_INDEX)
def _(t):
    """Gates over the valuation's own backtest and the solved index."""
    index = materialize(solved_index(t), "index")
    levels = materialize(valuation.carry_series(index), "levels")
    return quality.model_gates(valuation.calibrate(vq._errors(vq._sales(t), levels)), index)


@query("merged_register_quality", f"SELECT count(*) AS keys, CAST(sum(copies) AS BIGINT) AS rows, {cnt('copies > 1')} AS merged, {cnt('withdrawn_on IS NOT NULL')} AS withdrawn FROM m", k=iq.KEYED, f=iq.FEEDS, m=iq.MERGED)
def _(t):
    return identity.merge_duplicates(iq.stored_feeds(t)).agg(
        F.count(F.lit(1)).alias("keys"), F.sum("copies").alias("rows"), F.count_if(F.col("copies") > 1).alias("merged"), F.count("withdrawn_on").alias("withdrawn"))


