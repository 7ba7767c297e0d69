"""Resale queries: pairs, outcomes, index cells and the solved index."""

from cadastra.operators import resale
from cadastra.plans.adapters import AS_OF
from cadastra.plans.registry import cnt, query, rnd, shr
from cadastra.session import materialize

# Stand-in scale: line values are far below register prices, and the supplier nation is not the home's.
RULES = resale.PairRules(min_worth=1_000.0, since="1995-01-01", home=("building", "type", "rooms", "size"))
INDEX = resale.IndexRules(base_year=1995, min_price=1_000.0, min_area_pairs=15, min_pairs=100, thin=3)


def pairs_sql(home: str = "bkey, property_type, rooms, procedure_area") -> str:
    order = "instance_date, actual_worth, procedure_name, reg_type, project_number, area_name"
    lag = lambda c: f"lag({c}) OVER w"
    return f"""SELECT coalesce(pn0, project_number) AS project_number, a0 AS area_name, b0 AS building_name, rooms, procedure_area, d0 AS bought_on, w0 AS bought_for, r0 AS bought_reg,
      instance_date AS sold_on, actual_worth AS sold_for, reg_type AS sold_reg, CAST(instance_date - d0 AS INT) AS hold_days, actual_worth/w0 - 1 AS change_pct, CAST(n - 2 AS INT) AS ambiguity,
      property_type, p0 AS bought_proc, procedure_name AS sold_proc
    FROM (SELECT *, count(*) OVER (PARTITION BY {home}) AS n, {lag("project_number")} AS pn0, {lag("area_name")} AS a0, {lag("building_name")} AS b0, {lag("instance_date")} AS d0,
        {lag("actual_worth")} AS w0, {lag("reg_type")} AS r0, {lag("procedure_name")} AS p0
      FROM (SELECT *, coalesce(nullif(trim(building_name),''), 'project:' || coalesce(project_number,'')) AS bkey, coalesce(area_name,'') AS akey FROM registration
        WHERE trans_group='Sales' AND procedure_name IN ('Sell','Sell - Pre registration') AND property_type IN ('Unit','Villa') AND procedure_area > 10 AND actual_worth > 1000
          AND instance_date >= DATE '1995-01-01' AND rooms <> '')
      WINDOW w AS (PARTITION BY {home} ORDER BY {order}))
    WHERE n BETWEEN 2 AND 12 AND d0 IS NOT NULL AND instance_date - d0 >= 30 AND actual_worth/w0 - 1 BETWEEN -0.6::DOUBLE AND 3.0::DOUBLE"""


def pairs(t):
    return resale.resale_pairs(t.registration, RULES)


@query("resale_pairs", f"SELECT * REPLACE ({rnd('change_pct', 8)} AS change_pct) FROM pair", pair=pairs_sql())
def _(t):
    from cadastra.functions.numbers import half_up
    return pairs(t).withColumn("change_pct", half_up("change_pct", 8))


WINDOW = ("2000-01-01", "2001-07-31")


def _cohort(label: str, cond: str) -> str:
    pick = lambda c, p: f"list_sort(list({c}))[CAST(floor((count(*)-1)*{p}::DOUBLE + 0.5::DOUBLE) AS BIGINT) + 1]"
    return f"""SELECT '{label}' AS cohort, count(*) AS n, {rnd(rnd("median(change_pct*100)", 4), 1)} AS median_gain_pct, {shr(cnt("change_pct < 0"), "count(*)")} AS loss_pct,
      {rnd(rnd("median(hold_days/30.44::DOUBLE)", 4), 1)} AS median_hold_months, {rnd(rnd(pick("change_pct*100", 0.25), 4), 1)} AS q1, {rnd(rnd(pick("change_pct*100", 0.75), 4), 1)} AS q3
      FROM r WHERE {cond} HAVING count(*) > 0"""


RE = "(abs(change_pct) < 0.0001::DOUBLE AND hold_days < 60)"


@query("resale_stats", " UNION ALL ".join([_cohort("reregistration", RE), _cohort("all", f"NOT {RE}"), _cohort("offplan_bought", f"NOT {RE} AND bought_reg ILIKE '%off%'"),
                                           _cohort("quick_flip", f"NOT {RE} AND hold_days < 365")]), pair=pairs_sql(),
       r=f"SELECT * FROM pair WHERE sold_on BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' AND ambiguity = 0")
def _(t):
    return resale.resale_stats(pairs(t), WINDOW)


LOSS = f"""count(*) AS n, {cnt("change_pct < 0")} AS losses, {rnd(rnd("sum(change_pct)", 6) + "/count(*)*100", 1)} AS avg_pct, max(sold_on) AS latest, {shr(cnt("change_pct < 0"), "count(*)")} AS loss_pct
  FROM pair WHERE sold_on >= DATE '{AS_OF}' - 365"""


@query("resale_losses", f"SELECT {LOSS}", pair=pairs_sql())
def _(t):
    return resale.resale_losses(pairs(t), AS_OF)


@query("resale_losses_by_area", f"SELECT area_name, {LOSS} GROUP BY 1 HAVING count(*) >= 5", pair=pairs_sql())
def _(t):
    return resale.resale_losses(pairs(t), AS_OF, by_area=True, min_pairs=5)


@query("recent_losses", f"""SELECT project_number, project_name, area_slug || '/' || slug AS page, r.area_name, rooms, procedure_area, bought_on, bought_for, sold_on, sold_for, hold_days, {rnd("change_pct", 6)} AS change_pct
  FROM pair r JOIN project p USING (project_number) WHERE sold_on >= DATE '{AS_OF}' - 365 AND change_pct < 0 AND ambiguity <= 1
  ORDER BY sold_on DESC, r.change_pct, project_number, bought_on, sold_for, procedure_area LIMIT 100""", pair=pairs_sql())
def _(t):
    return resale.recent_losses(pairs(t), t.project, AS_OF)


def _gains(key: str, group: str) -> str:
    pick = lambda c, p: f"list_sort(list({c}))[CAST(least(count(*)-1, floor({p}::DOUBLE*count(*))) AS BIGINT) + 1]"
    return f"""SELECT {key}, count(*) AS n, {cnt("change_pct < 0")} AS losses, {rnd(pick("change_pct", 0.5), 6)} AS median, {rnd(pick("change_pct", 0.25), 6)} AS q1, {rnd(pick("change_pct", 0.75), 6)} AS q3,
      {rnd(pick("hold_days", 0.5) + "/30.4::DOUBLE")} AS hold_months FROM pair
      WHERE bought_reg='Off-Plan Properties' AND ambiguity <= 1 AND sold_on >= DATE '{AS_OF}' - 730 AND hold_days >= 90 {group} HAVING count(*) >= 5"""


@query("held_gains", _gains("'city' AS scope", ""), pair=pairs_sql())
def _(t):
    return resale.held_gains(pairs(t), AS_OF, min_pairs=5)


@query("held_gains_by_area", _gains("area_name", "GROUP BY area_name"), pair=pairs_sql())
def _(t):
    return resale.held_gains(pairs(t), AS_OF, by_area=True, min_pairs=5)


CELLS = """SELECT series, i, j, count(*) AS pairs, count(*) FILTER (WHERE i <> j AND abs(y) <= 1.6::DOUBLE) AS used, coalesce(sum(y) FILTER (WHERE i <> j AND abs(y) <= 1.6::DOUBLE), 0) AS log_sum
  FROM (SELECT unnest(list_filter(['market', CASE WHEN property_type='Unit' THEN 'apartments' END, CASE WHEN property_type='Villa' THEN 'villas' END,
      CASE WHEN property_type='Unit' AND project_number <> '' THEN 'registered_apartments' END, 'area:' || area_name,
      CASE WHEN property_type='Unit' AND project_number <> '' THEN 'area_apartments:' || area_name END], lambda x: x IS NOT NULL)) AS series,
    CAST(year(bought_on)*4 + quarter(bought_on) - 1 AS INT) AS i, CAST(year(sold_on)*4 + quarter(sold_on) - 1 AS INT) AS j, ln(sold_for/bought_for) AS y
  FROM pair WHERE bought_proc='Sell' AND sold_proc='Sell' AND bought_for > 1000 AND sold_for > 1000 AND hold_days >= 180 AND bought_on >= DATE '1995-01-01') GROUP BY ALL"""


@query("index_cells", f"SELECT series, i, j, pairs, used, {rnd('log_sum', 6)} AS log_sum FROM c", pair=pairs_sql(), c=CELLS)
def _(t):
    from cadastra.functions.numbers import half_up
    return resale.index_cells(pairs(t), INDEX).withColumn("log_sum", half_up("log_sum", 6))


def solved_index(t):
    """The index from cells written once: at most quarters squared small rows per series."""
    cells = materialize(resale.index_cells(pairs(t), INDEX), "index-cells")
    return resale.publish_index(resale.solve_cells(cells, INDEX), INDEX)


def elimination_sql(source: str) -> str:
    """Gauss-Jordan elimination in SQL: (series, r, beta) of the normal equations of cells (series, i, j, used, log_sum, n), periods from 0.

    The first period is pinned at zero and the diagonal carries the ridge, as in the solver; one column of all series
    is cleared in each step.
    """
    return f"""WITH RECURSIVE ent AS (SELECT series, n, j AS r, j AS q, used::DOUBLE AS v FROM {source} UNION ALL SELECT series, n, i, i, used FROM {source} UNION ALL SELECT series, n, i, j, -used FROM {source}
      UNION ALL SELECT series, n, j, i, -used FROM {source} UNION ALL SELECT series, n, j, n, log_sum FROM {source} UNION ALL SELECT series, n, i, n, -log_sum FROM {source}),
    grid AS (SELECT series, n, r, unnest(range(0, n + 1)) AS q FROM (SELECT series, n, unnest(range(0, n)) AS r FROM (SELECT DISTINCT series, n FROM {source}))),
    full_ AS (SELECT g.series, g.n, g.r, g.q, (CASE WHEN g.r = 0 THEN (g.q = 0)::INT ELSE coalesce(e.v, 0) END) + (CASE WHEN g.r = g.q THEN 1e-6::DOUBLE ELSE 0 END) AS v
      FROM grid g LEFT JOIN (SELECT series, r, q, sum(v) AS v FROM ent GROUP BY ALL) e ON e.series = g.series AND e.r = g.r AND e.q = g.q),
    start_ AS (SELECT series, n, list(line ORDER BY r) AS m FROM (SELECT series, n, r, list(v ORDER BY q) AS line FROM full_ GROUP BY ALL) GROUP BY ALL),
    step AS (SELECT series, n, 1 AS k, m FROM start_ UNION ALL SELECT series, n, k + 1, list_transform(m, lambda line, row_no: CASE WHEN row_no = k THEN list_transform(line, lambda x: x / line[k])
        ELSE list_transform(line, lambda x, col_no: x - line[k] / m[k][k] * m[k][col_no]) END) FROM step WHERE k <= n)
    SELECT series, unnest(range(0, n)) AS r, unnest(list_transform(m, lambda line: line[len(line)])) AS beta FROM step WHERE k = n + 1"""


SPAN = "(SELECT min(least(i, j)) AS lo, max(greatest(i, j)) AS hi, sum(pairs) FILTER (WHERE series = 'market') AS n FROM c)"
SOLVED = {
    "kept": f"""SELECT c.* EXCLUDE (i, j), i - lo AS i, j - lo AS j, CAST(hi - lo + 1 AS INT) AS n, lo FROM c, {SPAN} sp WHERE sp.n >= 100
      AND (series NOT LIKE 'area%' OR series IN (SELECT series FROM c GROUP BY 1 HAVING sum(pairs) >= 15))""",
    "beta": elimination_sql("kept"),
    "ix": f"""SELECT b.series, CAST((lo + r) // 4 AS VARCHAR) || 'Q' || CAST((lo + r) % 4 + 1 AS VARCHAR) AS quarter, floor(100 * exp(beta) * 10 + 0.5::DOUBLE) / 10 AS index, CAST(coalesce(s.u, 0) AS BIGINT) AS pairs_sold,
        CAST(coalesce(s.u, 0) + coalesce(g.u, 0) AS BIGINT) AS pairs_touching, coalesce(s.u, 0) + coalesce(g.u, 0) < 3 AS thin, CAST(w.pairs AS BIGINT) AS pairs, CAST(w.used AS BIGINT) AS used
      FROM beta b, (SELECT DISTINCT lo FROM kept) l JOIN (SELECT series, sum(pairs) AS pairs, sum(used) AS used FROM kept GROUP BY 1) w ON w.series = b.series
      LEFT JOIN (SELECT series, j, sum(used) AS u FROM kept GROUP BY ALL) s ON s.series = b.series AND s.j = b.r LEFT JOIN (SELECT series, i, sum(used) AS u FROM kept GROUP BY ALL) g ON g.series = b.series AND g.i = b.r""",
}


@query("repeat_sales_index", "SELECT * FROM ix", pair=pairs_sql(), c=CELLS, **SOLVED)
def _(t):
    return solved_index(t)


@query("index_headline", f"""SELECT series, latest_quarter, latest, peak_quarter, peak, trough_quarter, trough, {rnd("(latest/peak - 1)*100", 1)} AS from_peak_pct, {rnd("(latest/trough - 1)*100", 1)} AS from_trough_pct FROM (
    SELECT series, max(quarter) AS latest_quarter, max_by(index, quarter) AS latest, first(quarter ORDER BY index DESC, quarter) AS peak_quarter, max(index) AS peak, first(quarter ORDER BY index, quarter) AS trough_quarter, min(index) AS trough
    FROM ix GROUP BY series)""", pair=pairs_sql(), c=CELLS, **SOLVED)
def _(t):
    return resale.index_headline(solved_index(t))


def _variant_pairs(t):
    by_project = resale.PairRules(min_worth=1_000.0, since="1995-01-01", home=("building", "type", "rooms", "size"))
    by_area = resale.PairRules(min_worth=1_000.0, since="1995-01-01", home=("area", "building", "type", "rooms", "size"))
    return resale.resale_pairs(t.registration, by_project), resale.resale_pairs(t.registration, by_area)


SELLS = "bought_proc='Sell' AND sold_proc='Sell'"
ANN = "pow(1 + change_pct, 365.0::DOUBLE/greatest(hold_days, 1)) - 1"
CALM = f"({ANN} > -0.6::DOUBLE AND {ANN} < 0.6::DOUBLE)"
FEW = f"{SELLS} AND hold_days >= 90 AND ambiguity <= 2"
LATER = "year(sold_on) > year(bought_on)"
VARIANTS = {"A_ready_legs": "property_type='Unit' AND bought_reg='Existing Properties' AND sold_reg='Existing Properties' AND hold_days >= 180",
            "B_sell_legs": f"property_type='Unit' AND {SELLS} AND hold_days >= 180", "C_hold_90": f"property_type='Unit' AND {SELLS} AND hold_days >= 90",
            "D_four_sales": f"property_type='Unit' AND {FEW}", "E_trim": f"property_type='Unit' AND {FEW} AND {CALM}", "F_villas_in": f"{FEW} AND {CALM}",
            "G_different_years": f"{FEW} AND {CALM} AND {LATER}", "H_villas_only": f"{FEW} AND {CALM} AND property_type='Villa'"}


@query("index_variant_cells", " UNION ALL ".join(
    f"SELECT '{k}' AS series, CAST(year(bought_on) AS INT) AS i, CAST(year(sold_on) AS INT) AS j, count(*) AS used, {rnd('sum(ln(sold_for/bought_for))', 6)} AS log_sum FROM {src} WHERE {c} GROUP BY ALL"
    for k, c, src in [(k, c, "pair") for k, c in VARIANTS.items()] + [("I_area_key", f"{FEW} AND {CALM} AND {LATER}", "pair_area")]),
       pair=pairs_sql(), pair_area=pairs_sql("akey, bkey, property_type, rooms, procedure_area"))
def _(t):
    from cadastra.functions.numbers import half_up
    return resale.variant_cells(*_variant_pairs(t), base_year=1995).withColumn("log_sum", half_up("log_sum", 6))


VARIANT_CELLS = " UNION ALL ".join(
    f"SELECT '{k}' AS series, CAST(year(bought_on) AS INT) AS y0, CAST(year(sold_on) AS INT) AS y1, count(*) AS used, sum(ln(sold_for/bought_for)) AS log_sum FROM {src} WHERE {c} GROUP BY ALL"
    for k, c, src in [(k, c, "pair") for k, c in VARIANTS.items()] + [("I_area_key", f"{FEW} AND {CALM} AND {LATER}", "pair_area")])


@query("index_variants", """SELECT series, CAST(ys[r + 1] AS INT) AS year, round(100 * exp(beta), 1) AS index, CAST(pairs AS BIGINT) AS pairs FROM beta JOIN yr USING (series) JOIN (SELECT series, sum(used) AS pairs FROM vc GROUP BY 1) USING (series)""",
       pair=pairs_sql(), pair_area=pairs_sql("akey, bkey, property_type, rooms, procedure_area"), vc=VARIANT_CELLS,
       yr="SELECT series, list(y ORDER BY y) AS ys FROM (SELECT series, y0 AS y FROM vc UNION SELECT series, y1 FROM vc) GROUP BY 1",
       kept="SELECT series, used, log_sum, CAST(list_position(ys, y0) - 1 AS INT) AS i, CAST(list_position(ys, y1) - 1 AS INT) AS j, CAST(len(ys) AS INT) AS n FROM vc JOIN yr USING (series)", beta=elimination_sql("kept"))
def _(t):
    return resale.index_variants(*_variant_pairs(t), base_year=1995)
