"""Developer queries: scorecard, groups, projects, profile, delivery record, momentum."""

from cadastra.operators import developers, readings, resale
from cadastra.plans.adapters import AS_OF
from cadastra.plans.reading_queries import DELAY, latest_sql
from cadastra.plans.registry import avg, cnt, query, rnd, shr, tot
from cadastra.plans.resale_queries import RULES, pairs_sql

A = f"DATE '{AS_OF}'"
L = {"l": latest_sql(AS_OF)}
SCORE = f"""SELECT d.developer_number, d.developer_name, d.developer_slug, count(*) AS projects, {cnt("l.status='FINISHED'")} AS finished, {cnt("l.status IN ('ACTIVE','NOT_STARTED','PENDING')")} AS active,
    {cnt(f"l.status IN ('ACTIVE','NOT_STARTED','PENDING') AND l.completion_date < {A}")} AS overdue, {cnt("l.status='CANCELLED'")} AS cancelled, CAST(coalesce(sum(n),0) AS BIGINT) AS sales_12m,
    {rnd(tot("w") + "/1e6::DOUBLE", 2)} AS value, count(f.project_number) AS flagged
  FROM developer d JOIN project p USING (developer_number) LEFT JOIN l USING (project_number) LEFT JOIN (SELECT project_number, count(*) AS n, {tot("actual_worth")} AS w FROM registration WHERE trans_group='Sales' AND instance_date >= {A} - 365 GROUP BY 1) s USING (project_number)
  LEFT JOIN d f USING (project_number) GROUP BY 1, 2, 3""".replace("LEFT JOIN d f", "LEFT JOIN fl f")
S = {**L, "fl": DELAY, "sc": SCORE}


def _score(t):
    flags = readings.delay_flags(t.project, t.observation, t.registration, AS_OF, min_sales=2, within_months=24, below_percent=90)
    return developers.developer_scorecard(t.developer, t.project, t.observation, t.registration, flags, AS_OF, 1e6)


@query("developer_scorecard", "SELECT * FROM sc", **S)
def _(t):
    return _score(t)


GROUPS = [("00001", "First"), ("00003", "Second"), ("00000000", "Supplier Group")]


@query("developer_groups", f"""SELECT CASE WHEN contains(upper(developer_name), '00001') THEN 'First' WHEN contains(upper(developer_name), '00003') THEN 'Second' WHEN contains(upper(developer_name), '00000000') THEN 'Supplier Group' ELSE upper(developer_name) END AS group_name,
    count(*) AS entities, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("projects", "finished", "active", "overdue", "cancelled", "sales_12m", "flagged"))}, {rnd("sum(value)", 2)} AS value FROM sc GROUP BY 1""", **S)
def _(t):
    return developers.corporate_groups(_score(t), GROUPS)


@query("developer_projects", f"""SELECT p.project_number, p.developer_number, p.project_name, l.status, l.percent_completed, l.completion_date, coalesce(s.n,0) AS sales_12m, s.psm AS psm_90,
    coalesce(l.status IN ('ACTIVE','NOT_STARTED','PENDING') AND l.completion_date < {A}, false) AS overdue
  FROM project p LEFT JOIN l USING (project_number) LEFT JOIN (SELECT project_number, count(*) AS n, {avg(f"CASE WHEN property_type='Unit' AND meter_sale_price > 0 AND instance_date >= {A} - 90 THEN meter_sale_price END")} AS psm
    FROM registration WHERE trans_group='Sales' AND instance_date >= {A} - 365 GROUP BY 1) s USING (project_number)""", **L)
def _(t):
    return developers.developer_projects(t.project, t.observation, t.registration, AS_OF)


Y = f"instance_date >= {A} - 365"
Q90 = f"instance_date >= {A} - 90 AND property_type='Unit' AND meter_sale_price BETWEEN 500 AND 200000"
PROFILE = f"""SELECT project_number, project_name, developer_number, area_name, units, status, CASE WHEN pct IS NOT NULL THEN least(100.0::DOUBLE, pct) END AS "percent", planned, cur AS current,
    coalesce(CASE WHEN cur <> planned THEN {rnd("(cur - planned)/30.44::DOUBLE", 1)} END, 0.0::DOUBLE) AS slip_months, coalesce(CASE WHEN fin AND cur > planned THEN {rnd("(cur - planned)/30.44::DOUBLE", 1)} END, 0.0::DOUBLE) AS late_months,
    fin AS finished, can AS cancelled, status IS NOT NULL AND NOT fin AND NOT can AS live, coalesce(status IS NOT NULL AND NOT fin AND NOT can AND cur < {A}, false) AS past_due,
    coalesce(sales_all,0) AS sales_all, coalesce(sales_12m,0) AS sales_12m, coalesce(value_12m,0) AS value_12m, coalesce(offplan_all,0) AS offplan_all, first_sale, last_sale,
    CASE WHEN sales_all > 0 AND units > 0 THEN least(100.0::DOUBLE, {shr("sales_all", "units")}) END AS sold_pct, psm_90, coalesce(psm_90_n,0) AS psm_90_n, coalesce(readings,0) AS readings, coalesce(sources,0) AS sources
  FROM (SELECT p.*, r.planned, r.readings, r.sources, l.status, l.completion_date AS cur, l.percent_completed AS pct, coalesce(l.status='FINISHED',false) AS fin, coalesce(l.status='CANCELLED',false) AS can, s.* EXCLUDE (project_number)
    FROM project p LEFT JOIN (SELECT project_number, min(completion_date) AS planned, count(*) AS readings, count(DISTINCT source) AS sources FROM observation WHERE observed_at <= {A} GROUP BY 1) r USING (project_number) LEFT JOIN l USING (project_number)
    LEFT JOIN (SELECT project_number, count(*) AS sales_all, {cnt(Y)} AS sales_12m, {rnd(tot(f"CASE WHEN {Y} THEN actual_worth END") + "/1e3::DOUBLE")} AS value_12m, {cnt("reg_type='Off-Plan Properties'")} AS offplan_all, min(instance_date) AS first_sale,
      max(instance_date) AS last_sale, {avg(f"CASE WHEN {Q90} THEN meter_sale_price END")} AS psm_90, {cnt(Q90)} AS psm_90_n FROM registration WHERE trans_group='Sales' GROUP BY 1) s USING (project_number))"""
PF = {**L, "pf": PROFILE}


def _profile(t):
    return developers.profile_projects(t.project, t.observation, t.registration, AS_OF, unit=1e3)


@query("developer_profile", "SELECT * FROM pf", **PF)
def _(t):
    return _profile(t)


B = "(live AND status='ACTIVE')"
LATE, SLIP = "(finished AND late_months > 0.5)", "(live AND slip_months > 0.5)"


@query("delivery_record", f"""SELECT developer_number, {cnt("finished")} AS delivered, CAST(sum(CASE WHEN finished THEN units ELSE 0 END) AS BIGINT) AS delivered_units, {cnt("finished AND planned IS NOT NULL AND current IS NOT NULL")} AS with_dates, {cnt(LATE)} AS late, {cnt(B)} AS building,
    CAST(sum(CASE WHEN {B} THEN units ELSE 0 END) AS BIGINT) AS building_units, {cnt(f"{B} AND past_due")} AS past_due, {cnt(SLIP)} AS slipped, {cnt("live AND status <> 'ACTIVE'")} AS pipeline, {cnt("cancelled")} AS cancelled,
    {cnt(f"{B} AND year(current) = 2001")} AS due_this_year, {cnt(f"{B} AND year(current) > 2001")} AS due_later, {cnt(f"{B} AND current IS NULL")} AS undated, {shr(cnt("finished AND planned IS NOT NULL AND current IS NOT NULL") + " - " + cnt(LATE), cnt("finished AND planned IS NOT NULL AND current IS NOT NULL"))} AS on_time_pct,
    {rnd(rnd(f"median(late_months) FILTER (WHERE {LATE})", 4), 1)} AS median_late_months, {rnd(rnd(f"median(slip_months) FILTER (WHERE {SLIP})", 4), 1)} AS median_slip_months FROM pf GROUP BY 1""", **PF)
def _(t):
    return developers.delivery_record(_profile(t), AS_OF)


PV = ("planned_units", "planned_projects", "moved_units", "moved_projects", "past_due_units", "delivered_units", "delivered_projects", "on_time_units")


@query("planned_vs_delivered", "SELECT developer_number, \"year\", " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in PV) + """ FROM (
    SELECT developer_number, CAST(year(planned) AS INT) AS "year", units AS planned_units, 1 AS planned_projects, CASE WHEN NOT finished AND year(current) <> year(planned) THEN units ELSE 0 END AS moved_units,
      CASE WHEN NOT finished AND year(current) <> year(planned) THEN 1 ELSE 0 END AS moved_projects, CASE WHEN past_due THEN units ELSE 0 END AS past_due_units, 0 AS delivered_units, 0 AS delivered_projects, 0 AS on_time_units FROM pf WHERE NOT cancelled AND planned IS NOT NULL
    UNION ALL SELECT developer_number, CAST(year(current) AS INT), 0, 0, 0, 0, 0, units, 1, CASE WHEN late_months = 0 THEN units ELSE 0 END FROM pf WHERE NOT cancelled AND finished) WHERE "year" BETWEEN 1995 AND 2006 GROUP BY ALL""", **PF)
def _(t):
    return developers.planned_vs_delivered(_profile(t), 1995, 2006)


@query("developer_momentum", f"""SELECT developer_number, CAST(date_trunc('month', instance_date) AS DATE) AS month, count(*) AS n, {rnd(tot("actual_worth") + "/1e3::DOUBLE", 2)} AS value, {cnt("reg_type='Off-Plan Properties'")} AS "off"
  FROM registration JOIN project USING (project_number) WHERE trans_group='Sales' AND instance_date >= DATE '1999-08-01' GROUP BY ALL""")
def _(t):
    return developers.developer_momentum(t.registration, t.project, AS_OF, unit=1e3)


NOW, THEN = f"instance_date >= {A} - 365", f"instance_date >= {A} - 730 AND instance_date < {A} - 365"
P = "property_type='Unit' AND meter_sale_price BETWEEN 500 AND 200000"


@query("developer_year", f"""SELECT s.developer_number, n_12, value_12, {shr("o", "n_12")} AS offplan_pct, n_prev, value_prev, {shr("n_12", f"(SELECT count(*) FROM registration WHERE trans_group='Sales' AND {NOW})", 1)} AS market_share, med_psm, med_psm_prev,
    coalesce(resales,0) AS resales, median_gain, loss_pct, median_hold_months, coalesce(resales_offplan,0) AS resales_offplan
  FROM (SELECT developer_number, {cnt(NOW)} AS n_12, {rnd(tot(f"CASE WHEN {NOW} THEN actual_worth END") + "/1e6::DOUBLE", 2)} AS value_12, {cnt(f"{NOW} AND reg_type='Off-Plan Properties'")} AS o, {cnt(THEN)} AS n_prev, {rnd(tot(f"CASE WHEN {THEN} THEN actual_worth END") + "/1e6::DOUBLE", 2)} AS value_prev,
      {rnd(rnd(f"median(meter_sale_price) FILTER (WHERE {NOW} AND {P})", 4))} AS med_psm, {rnd(rnd(f"median(meter_sale_price) FILTER (WHERE {THEN} AND {P})", 4))} AS med_psm_prev
    FROM registration JOIN project USING (project_number) WHERE trans_group='Sales' AND instance_date >= {A} - 730 GROUP BY 1) s
  LEFT JOIN (SELECT developer_number, count(*) AS resales, {rnd(rnd("median(change_pct*100)", 4), 1)} AS median_gain, {shr(cnt("change_pct < 0"), "count(*)")} AS loss_pct, {rnd(rnd("median(hold_days/30.44::DOUBLE)", 4), 1)} AS median_hold_months, {cnt("bought_reg ILIKE '%off%'")} AS resales_offplan
    FROM pair JOIN project USING (project_number) WHERE ambiguity = 0 AND sold_on >= {A} - 730 AND NOT (abs(change_pct) < 0.0001::DOUBLE AND hold_days < 60) GROUP BY 1) r USING (developer_number)""", pair=pairs_sql())
def _(t):
    return developers.developer_year(t.registration, t.project, resale.resale_pairs(t.registration, RULES), AS_OF, unit=1e6)


@query("developer_areas", f"SELECT developer_number, area_name, count(*) AS projects, CAST(sum(units) AS BIGINT) AS units, {cnt('live')} AS live FROM pf GROUP BY ALL", **PF)
def _(t):
    return developers.developer_areas(_profile(t))
