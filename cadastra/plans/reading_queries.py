"""Construction-reading queries: latest as of, movement, supply, delay, pipeline, verdicts."""

from pyspark.sql import functions as F

from cadastra.functions.predicates import LIVE_STATUSES
from cadastra.operators import readings
from cadastra.plans.adapters import AS_OF
from cadastra.plans.registry import avg, cnt, query, rnd, tot

FROM, TO = "2001-07-15", "2001-07-29"
RANK = "CASE source WHEN 'gateway' THEN 0 WHEN 'register-extract' THEN 1 ELSE 2 END"


def latest_sql(as_of: str, tie: str = "ranked", source: str = "observation") -> str:
    order = f"observed_at DESC, {RANK}, id DESC" if tie == "ranked" else "observed_at DESC, id DESC"
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_number ORDER BY {order}) AS rn "
            f"FROM {source} WHERE observed_at <= DATE '{as_of}') WHERE rn = 1")


@query("latest_as_of", "SELECT project_number, observed_at, status, percent_completed, completion_date, source, id FROM l", l=latest_sql(AS_OF))
def _(t):
    return readings.latest_as_of(t.observation, AS_OF)


@query("latest_as_of_by_id", "SELECT project_number, observed_at, status, percent_completed, completion_date, source, id FROM l",
       l=latest_sql(AS_OF, "id"))
def _(t):
    return readings.latest_as_of(t.observation, AS_OF, tie="id")


TWO = (f"SELECT *, row_number() OVER (PARTITION BY project_number ORDER BY observed_at DESC, {RANK}, id DESC) AS rn "
       f"FROM observation WHERE observed_at <= DATE '{AS_OF}'")


@query("last_two_readings", """
  SELECT a.project_number, a.id AS now_id, a.percent_completed AS now_percent, a.observed_at AS now_at, b.id AS before_id,
    b.percent_completed AS before_percent, b.observed_at AS before_at
  FROM (SELECT * FROM two WHERE rn=1) a LEFT JOIN (SELECT * FROM two WHERE rn=2) b USING (project_number)""", two=TWO)
def _(t):
    return readings.last_two(t.observation, AS_OF).select(
        "project_number", F.col("now.id").alias("now_id"), F.col("now.percent_completed").alias("now_percent"),
        F.col("now.observed_at").alias("now_at"), F.col("before.id").alias("before_id"),
        F.col("before.percent_completed").alias("before_percent"), F.col("before.observed_at").alias("before_at"))


@query("first_last_dates", f"""
  SELECT g.project_number, planned, l.completion_date AS current, readings,
    CASE WHEN l.completion_date <> planned THEN {rnd("(l.completion_date - planned)/30.44::DOUBLE", 1)} ELSE 0 END AS slip_months
  FROM (SELECT project_number, min(completion_date) AS planned, count(*) AS readings FROM observation WHERE observed_at <= DATE '{AS_OF}' GROUP BY 1) g
  JOIN l USING (project_number)""", l=latest_sql(AS_OF))
def _(t):
    return readings.first_last_dates(t.observation, AS_OF)


def _event(kind: str, cond: str, **f: str) -> str:
    types = {"n": "BIGINT", "value": "DOUBLE", "psm": "DOUBLE", "change": "DOUBLE", "from_value": "VARCHAR", "to_value": "VARCHAR", "on": "DATE"}
    cols = ", ".join(f'CAST({f.get(k, "NULL")} AS {v}) AS "{k}"' for k, v in types.items())
    return f"SELECT project_number, project_name, area_name, developer_name, page, '{kind}' AS kind, {cols} FROM j WHERE {cond}"


@query("moves", " UNION ALL ".join([
    _event("sales", "n > 0", n="n", value=rnd("worth/1e3::DOUBLE"), psm="psm",
           change="CASE WHEN np > 0 THEN " + rnd("100.0::DOUBLE*(n-np)/np") + " END", on="last"),
    _event("progress", "abs(np_pct - bp_pct) >= 0.5 AND abs(" + rnd("np_pct - bp_pct", 1) + ") >= 0.5", change=rnd("np_pct - bp_pct", 1), on="now_at"),
    _event("completionDate", "now_at IS NOT NULL AND ncd IS DISTINCT FROM bcd", from_value="bcd", to_value="ncd", on="now_at"),
    _event("status", "now_at IS NOT NULL AND nst IS DISTINCT FROM bst", from_value="bst", to_value="nst", on="now_at")]),
       two=TWO,
       m="""SELECT a.project_number, a.percent_completed AS np_pct, b.percent_completed AS bp_pct, a.completion_date AS ncd, b.completion_date AS bcd,
         a.status AS nst, b.status AS bst, a.observed_at AS now_at FROM two a JOIN two b ON a.project_number=b.project_number AND a.rn=1 AND b.rn=2""",
       s=f"""SELECT project_number, {cnt("r")} AS n, {cnt("NOT r")} AS np, {tot("CASE WHEN r THEN actual_worth END")} AS worth,
         max(CASE WHEN r THEN instance_date END) AS last, {avg("CASE WHEN r THEN meter_sale_price END")} AS psm
         FROM (SELECT *, instance_date >= DATE '{AS_OF}' - 45 AS r FROM registration WHERE trans_group='Sales'
           AND instance_date BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}') GROUP BY 1 HAVING n > 0""",
       j="""SELECT p.project_number, p.project_name, p.area_name, d.developer_name, p.area_slug || '/' || p.slug AS page, s.* EXCLUDE (project_number), m.* EXCLUDE (project_number)
         FROM project p LEFT JOIN s USING (project_number) LEFT JOIN m USING (project_number) LEFT JOIN developer d ON d.developer_number=p.developer_number""")
def _(t):
    out = readings.moves(t.registration, t.observation, t.project, t.developer, AS_OF, unit=1e3)
    return out.select("project_number", "project_name", "area_name", "developer_name", "page", F.explode("events").alias("e")).select(
        "project_number", "project_name", "area_name", "developer_name", "page", "e.*")


LIVE = """SELECT p.*, coalesce(s.sold,0) AS sold, coalesce(s.recent,0) AS recent, greatest(0, p.units - coalesce(s.sold,0)) AS unsold
  FROM project p LEFT JOIN (SELECT project_number, count(*) FILTER (WHERE reg_type='Off-Plan Properties') AS sold,
    count(*) FILTER (WHERE instance_date >= DATE '2001-08-01' - 180) AS recent FROM registration WHERE trans_group='Sales' GROUP BY 1) s USING (project_number)
  WHERE p.units > 0 AND p.cancellation_date IS NULL AND EXISTS (SELECT 1 FROM observation o WHERE o.project_number=p.project_number AND coalesce(o.percent_completed,0) < 100)"""
MONTHS = 180 / 30.44


@query("supply_projects", f"""
  SELECT project_number, project_name, area_name, area_slug || '/' || slug AS page, units, sold, unsold, {rnd(f"recent/{MONTHS!r}::DOUBLE", 1)} AS absorption,
    {rnd(f"unsold/nullif(recent/{MONTHS!r}::DOUBLE,0)", 1)} AS months_of_supply FROM live WHERE recent > 0""", live=LIVE)
def _(t):
    return readings.months_of_supply(t.project, t.observation, t.registration, AS_OF)


@query("supply_areas", f"""
  SELECT area_name, projects, unsold, {rnd(f"recent/{MONTHS!r}::DOUBLE", 1)} AS absorption, {rnd(f"unsold/nullif(recent/{MONTHS!r}::DOUBLE,0)", 1)} AS months_of_supply
  FROM (SELECT area_name, count(*) AS projects, CAST(sum(unsold) AS BIGINT) AS unsold, sum(recent) AS recent FROM live GROUP BY 1)
  WHERE unsold >= 200 AND recent/{MONTHS!r}::DOUBLE >= 1""", live=LIVE)
def _(t):
    return readings.months_of_supply(t.project, t.observation, t.registration, AS_OF, by="area", min_area_absorb=1.0)


@query("supply_market", f"""
  SELECT count(*) AS projects, CAST(sum(unsold) AS BIGINT) AS unsold, {rnd(f"sum(recent)/{MONTHS!r}::DOUBLE")} AS absorption,
    {rnd(f"sum(unsold)/nullif(sum(recent)/{MONTHS!r}::DOUBLE,0)", 1)} AS months_of_supply FROM live""", live=LIVE)
def _(t):
    return readings.months_of_supply(t.project, t.observation, t.registration, AS_OF, by="market")


DELAY = f"""SELECT l.project_number, p.area_name, l.status, l.percent_completed, l.completion_date,
    {rnd(f"(l.completion_date - DATE '{AS_OF}')/30.4::DOUBLE", 1)} AS m, s.n AS sales_12m, s.w AS value_12m, s.o AS offplan_12m, coalesce(percent_completed,0) AS pct
  FROM l JOIN project p USING (project_number) JOIN (SELECT project_number, count(*) AS n, {tot("actual_worth")} AS w, {cnt("reg_type='Off-Plan Properties'")} AS o
    FROM registration WHERE trans_group='Sales' AND instance_date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}' GROUP BY 1 HAVING count(*) >= 2) s USING (project_number)
  WHERE l.status IN ('ACTIVE','NOT_STARTED','PENDING') AND (l.completion_date - DATE '{AS_OF}')/30.4::DOUBLE < 24 AND coalesce(l.percent_completed,0) < 90"""


@query("delay_flags", f"""
  SELECT project_number, area_name, status, percent_completed, completion_date, m AS months_to_completion, sales_12m, value_12m, offplan_12m,
    CAST(least(100, trunc({rnd("(CASE WHEN m < 0 THEN 40.0::DOUBLE ELSE 40.0::DOUBLE - m*6 END) + (70.0::DOUBLE - pct)*0.5::DOUBLE + least(25.0::DOUBLE, sales_12m/20.0::DOUBLE)", 6)})) AS INT) AS risk_score,
    (CASE WHEN m < 0 THEN 'completion date passed, ' ELSE CAST(CAST({rnd("m")} AS INT) AS VARCHAR) || ' months to completion, ' END)
      || CAST(CAST({rnd("pct")} AS INT) AS VARCHAR) || '% complete, ' || CAST(sales_12m AS VARCHAR) || ' sales in 12m' AS reason
  FROM d""", l=latest_sql(AS_OF), d=DELAY)
def _(t):
    return readings.delay_flags(t.project, t.observation, t.registration, AS_OF, min_sales=2, within_months=24, below_percent=90)


STATUSES = "(" + ",".join(f"'{s}'" for s in LIVE_STATUSES) + ")"
PIPE = f"""SELECT l.*, p.project_name, p.area_name, p.area_slug, p.slug, p.units, d.developer_name, l.completion_date < DATE '{AS_OF}' AS late,
    l.completion_date >= DATE '{AS_OF}' AND l.completion_date <= DATE '{AS_OF}' + 365 AS soon
  FROM l JOIN project p USING (project_number) LEFT JOIN developer d ON d.developer_number = p.developer_number WHERE l.status IN {STATUSES}"""


def _pipe(name: str, key: str, limit: str = ""):
    def make(fn):
        return query(name, f"""SELECT {key} AS {name.split('_by_')[1]}, count(*) AS projects, CAST(sum(coalesce(units,0)) AS BIGINT) AS units, {cnt("late")} AS past_due
          FROM pipe GROUP BY 1 {limit}""", l=latest_sql(AS_OF, "id"), pipe=PIPE)(fn)
    return make


def _rows(t):
    return readings.live_pipeline(t.observation, t.project, t.developer, AS_OF)


@_pipe("pipeline_by_bucket", "CASE WHEN completion_date IS NULL THEN 'no date' WHEN late THEN 'past due' ELSE CAST(year(completion_date) AS VARCHAR) END")
def _(t):
    return readings.pipeline_by(_rows(t), "bucket")


@_pipe("pipeline_by_area_name", "area_name", "ORDER BY units DESC, area_name LIMIT 15")
def _(t):
    return readings.pipeline_by(_rows(t), "area_name", 15)


@_pipe("pipeline_by_developer_name", "coalesce(developer_name,'Unknown')", "ORDER BY units DESC, developer_name LIMIT 12")
def _(t):
    return readings.pipeline_by(_rows(t), "developer_name", 12)


@query("pipeline_totals", "SELECT " + ", ".join(
    f"{cnt(c)} AS {k}_projects, CAST(coalesce(sum(units) FILTER (WHERE {c}),0) AS BIGINT) AS {k}_units" for k, c in
    {"live": "true", "active": "status='ACTIVE'", "due_next_12": "soon", "past_due": "late", "behind": "soon AND percent_completed < 60"}.items())
    + " FROM pipe", l=latest_sql(AS_OF, "id"), pipe=PIPE)
def _(t):
    return readings.pipeline_totals(_rows(t))


def _list_sql(cond: str) -> str:
    return f"""SELECT project_number, project_name, area_name, developer_name, {rnd("least(100.0::DOUBLE, percent_completed)", 1)} AS "percent", completion_date AS due, units,
      area_slug || '/' || slug AS page FROM pipe WHERE {cond} ORDER BY coalesce(units,0) DESC, project_number LIMIT 15"""


@query("pipeline_behind", _list_sql("soon AND percent_completed < 60"), l=latest_sql(AS_OF, "id"), pipe=PIPE)
def _(t):
    return readings.pipeline_list(_rows(t), "behind")


@query("pipeline_past_due", _list_sql("late"), l=latest_sql(AS_OF, "id"), pipe=PIPE)
def _(t):
    return readings.pipeline_list(_rows(t), "past_due")


@query("register_moves", f"""
  SELECT project_number, project_name, area_name, {rnd("bp", 1)} AS percent_before, {rnd("ap", 1)} AS percent_after, progress, progress IS NOT NULL AND bs <> asrc AND ap >= 99.9 AND ap - bp >= 50 AS suspect,
    b_at AS read_before, a_at AS read_after, status_change, CASE WHEN acd <> bcd THEN bcd END AS completion_was, CASE WHEN acd <> bcd THEN acd END AS completion_now,
    CASE WHEN acd <> bcd THEN {rnd("(acd - bcd)/30.44::DOUBLE", 1)} END AS completion_shift
  FROM (SELECT *, CASE WHEN abs(ap - bp) >= 0.05 THEN {rnd("ap - bp", 1)} END AS progress, CASE WHEN st_a <> st_b THEN st_b || '>' || st_a END AS status_change FROM x)
  LEFT JOIN project USING (project_number) WHERE progress IS NOT NULL OR status_change IS NOT NULL OR acd <> bcd""",
       b=latest_sql(FROM), a=latest_sql(TO),
       x="""SELECT a.project_number, least(100.0::DOUBLE, b.percent_completed) AS bp, least(100.0::DOUBLE, a.percent_completed) AS ap, a.status AS st_a, b.status AS st_b, b.source AS bs, a.source AS asrc,
         b.observed_at AS b_at, a.observed_at AS a_at, a.completion_date AS acd, b.completion_date AS bcd FROM a JOIN b USING (project_number) WHERE a.id <> b.id""")
def _(t):
    return readings.register_moves(t.observation, t.project, FROM, TO)


@query("projects_entered", """
  SELECT project_number, first_seen FROM (SELECT project_number, min(observed_at) AS first_seen FROM observation GROUP BY 1)
  WHERE first_seen > DATE '2001-07-02' AND first_seen <= DATE '2001-07-29'""")
def _(t):
    no_vintage = t.project.select("project_number", F.lit(None).cast("date").alias("first_seen"))
    return readings.entered(t.observation, no_vintage, "2001-07-02", TO)


def _mix() -> str:
    p = "least(100.0::DOUBLE, percent_completed)"
    case = " ".join(f"WHEN {p} >= {lo} AND {p} < {hi} THEN '{label}'" for label, lo, hi in readings.PERCENT_MIX)
    return f"SELECT 'status' AS kind, status AS label, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'percent', CASE {case} ELSE 'not stated' END, count(*) FROM l GROUP BY 2"


@query("reading_mix", _mix(), l=latest_sql(TO))
def _(t):
    return readings.reading_mix(t.observation, TO)


@query("readings_by_source", f"SELECT source, observed_at, count(*) AS n FROM observation WHERE observed_at <= DATE '{TO}' GROUP BY ALL")
def _(t):
    return readings.reading_ages(t.observation, TO)


@query("snap_window", """
  SELECT min(observed_at) FILTER (WHERE observed_at >= DATE '2001-07-10') AS read_from, max(observed_at) FILTER (WHERE observed_at <= DATE '2001-07-21') AS read_to
  FROM observation WHERE CAST(project_number AS INT) = 7""")
def _(t):
    days = t.observation.filter(F.col("project_number") == "7").select(F.col("observed_at").alias("read_day"))
    return readings.snap_window(days, "2001-07-10", "2001-07-21")


SNAPS = {"b": latest_sql(FROM, source=f"(SELECT * FROM observation WHERE observed_at = DATE '{FROM}')"),
         "a": latest_sql(TO, source=f"(SELECT * FROM observation WHERE observed_at = DATE '{TO}')")}
DIFF = f"""SELECT project_number, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'gone' ELSE 'held' END AS presence,
    coalesce(b.id IS NOT NULL AND a.id IS NOT NULL AND (b.percent_completed NOT BETWEEN 0 AND 100 OR a.percent_completed NOT BETWEEN 0 AND 100), false) AS off_scale,
    b.percent_completed AS percent_before, a.percent_completed AS percent_after,
    CASE WHEN b.percent_completed BETWEEN 0 AND 100 AND a.percent_completed BETWEEN 0 AND 100 AND abs(a.percent_completed - b.percent_completed) >= 0.05
      THEN {rnd("a.percent_completed - b.percent_completed", 2)} END AS progress,
    CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL AND a.status <> b.status THEN b.status || '>' || a.status END AS status_change,
    CASE WHEN a.completion_date <> b.completion_date THEN {rnd("(year(a.completion_date)*12+month(a.completion_date)-year(b.completion_date)*12-month(b.completion_date)) + (day(a.completion_date)-day(b.completion_date))/30.44::DOUBLE", 1)} END AS date_shift_months,
    coalesce(a.percent_completed = b.percent_completed, false) AS unchanged_percent
  FROM b FULL OUTER JOIN a USING (project_number)"""


def _diff(t):
    return readings.register_diff(readings.snapshot_of(t.observation, FROM), readings.snapshot_of(t.observation, TO))


@query("register_diff", DIFF, **SNAPS)
def _(t):
    return _diff(t)


@query("register_diff_counts", f"""SELECT {cnt("presence <> 'added'")} AS projects_before, {cnt("presence <> 'gone'")} AS projects_after, {cnt("presence='added'")} AS added, {cnt("presence='gone'")} AS gone,
    {cnt("off_scale")} AS off_scale, count(progress) AS progress_revisions, {cnt("progress > 0")} AS revised_up, {cnt("progress <= 0")} AS revised_down, count(status_change) AS status_changes,
    count(date_shift_months) AS dates_moved, {cnt("date_shift_months > 0")} AS slipped_later, {cnt("unchanged_percent")} AS unchanged FROM d""", **SNAPS, d=DIFF)
def _(t):
    return readings.register_diff_counts(_diff(t))


@query("build_verdict", f"""
  SELECT project_number, status, percent_completed, completion_date,
    CASE WHEN id IS NULL THEN 'No reading' WHEN status='FINISHED' THEN 'Completed' WHEN status='CANCELLED' THEN 'Cancelled' WHEN unf AND late > 0 THEN 'Past its registered finish date'
      WHEN unf AND late <= 0 AND -late <= 6 AND pct < 60 THEN 'Behind the curve' ELSE 'On the register''s timetable' END AS label,
    CASE WHEN id IS NULL THEN 'muted' WHEN status='FINISHED' THEN 'ok' WHEN status='CANCELLED' THEN 'bad' WHEN unf AND late > 6 THEN 'bad'
      WHEN unf AND late > 0 THEN 'warn' WHEN unf AND -late <= 6 AND pct < 60 THEN 'warn' ELSE 'ok' END AS tone,
    CASE WHEN id IS NOT NULL AND status NOT IN ('FINISHED','CANCELLED') AND unf AND late > 0 THEN late END AS months_late,
    CASE WHEN id IS NOT NULL AND status NOT IN ('FINISHED','CANCELLED') AND slip > 0 THEN slip END AS slip_months
  FROM (SELECT p.project_number, l.* EXCLUDE (project_number), coalesce(l.percent_completed,0) < 100 AND l.completion_date IS NOT NULL AS unf, coalesce(l.percent_completed,0) AS pct,
      CAST({rnd(f"(DATE '{AS_OF}' - l.completion_date)/30.4::DOUBLE")} AS INT) AS late, CAST({rnd("(l.completion_date - f.fd)/30.4::DOUBLE")} AS INT) AS slip
    FROM project p LEFT JOIN l USING (project_number) LEFT JOIN f USING (project_number))""",
       l=latest_sql(AS_OF), f=f"""SELECT project_number, completion_date AS fd FROM (SELECT *, row_number() OVER (PARTITION BY project_number ORDER BY observed_at, id) AS rn
         FROM observation WHERE completion_date IS NOT NULL AND observed_at <= DATE '{AS_OF}') WHERE rn = 1""")
def _(t):
    return readings.build_verdict(t.project, t.observation, AS_OF)


def _flags(t):
    return readings.delay_flags(t.project, t.observation, t.registration, AS_OF, min_sales=2, within_months=24, below_percent=90)


SCORED = f"""SELECT project_number, area_name, status, percent_completed, completion_date, m AS months_to_completion, sales_12m, value_12m, offplan_12m,
    CAST(least(100, trunc({rnd("(CASE WHEN m < 0 THEN 40.0::DOUBLE ELSE 40.0::DOUBLE - m*6 END) + (70.0::DOUBLE - pct)*0.5::DOUBLE + least(25.0::DOUBLE, sales_12m/20.0::DOUBLE)", 6)})) AS INT) AS risk_score FROM d"""


@query("delay_feed", """SELECT s.project_number, s.risk_score, s.sales_12m, s.completion_date, p.project_name, v.developer_name, p.area_slug || '/' || p.slug AS page FROM (SELECT * FROM sc ORDER BY risk_score DESC, sales_12m DESC, project_number LIMIT 10) s
  JOIN project p USING (project_number) LEFT JOIN developer v USING (developer_number)""", l=latest_sql(AS_OF), d=DELAY, sc=SCORED)
def _(t):
    out = readings.delay_feed(_flags(t), t.project, t.developer, 10)
    return out.select("project_number", "risk_score", "sales_12m", "completion_date", "project_name", "developer_name", "page")


@query("project_history", f"SELECT project_number, observed_at, status, percent_completed, completion_date, source, CAST(row_number() OVER (PARTITION BY project_number ORDER BY observed_at, -({RANK}), id) AS INT) AS reading FROM observation")
def _(t):
    return readings.project_history(t.observation)


@query("progress_order", f"""SELECT project_number, progress, suspect, CAST(row_number() OVER (ORDER BY suspect, abs(progress) DESC, project_number) AS INT) AS place FROM (SELECT *, ap >= 99.9 AND ap - bp >= 50 AND bs <> asrc AS suspect FROM (
    SELECT *, CASE WHEN abs(ap - bp) >= 0.05 THEN {rnd("ap - bp", 1)} END AS progress FROM x)) WHERE progress IS NOT NULL""",
       b=latest_sql(FROM), a=latest_sql(TO),
       x="""SELECT a.project_number, least(100.0::DOUBLE, b.percent_completed) AS bp, least(100.0::DOUBLE, a.percent_completed) AS ap, b.source AS bs, a.source AS asrc FROM a JOIN b USING (project_number) WHERE a.id <> b.id""")
def _(t):
    """All revisions of the report, numbered as listed."""
    placed = readings.place_progress(readings.register_moves(t.observation, t.project, FROM, TO))
    return placed.select("project_number", "progress", "suspect", "place")
