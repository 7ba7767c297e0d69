"""Valuation queries: size curve, hold-out, fallback index, backtest, calibration, cells."""

from pyspark.sql import functions as F

from cadastra.functions.numbers import half_up, quarter_label
from cadastra.operators import valuation
from cadastra.operators.quantiles import Pick, order_statistics
from cadastra.plans.adapters import AS_OF
from cadastra.plans.registry import cnt, query, rnd, shr
from cadastra.plans.resale_queries import CELLS as INDEX_CELLS
from cadastra.plans.resale_queries import SOLVED, pairs_sql, solved_index
from cadastra.session import materialize

RULES = valuation.ValuationRules(min_worth=1_000.0, min_area_month=4)

UNIV = f"""SELECT instance_date, area_name, building_name, rooms, procedure_area AS size, actual_worth AS worth, meter_sale_price AS psm, reg_type='Off-Plan Properties' AS off_plan
  FROM registration WHERE trans_group='Sales' AND property_type='Unit' AND meter_sale_price BETWEEN 500 AND 200000 AND procedure_area > 10 AND actual_worth > 1000
    AND instance_date BETWEEN DATE '{AS_OF}' - 800 AND DATE '{AS_OF}' AND rooms <> '' AND building_name <> ''"""
ELAS = """SELECT coalesce(median(slope), -0.33::DOUBLE) AS e FROM (SELECT regr_slope(ln(psm), ln(size)) AS slope FROM u GROUP BY building_name, rooms HAVING count(*) >= 30 AND var_pop(ln(size)) > 0)"""
CUT = """SELECT min(instance_date) AS cut, max(instance_date) AS last_day FROM (SELECT instance_date, sum(n) OVER (ORDER BY instance_date) AS reached, sum(n) OVER () AS total
    FROM (SELECT instance_date, count(*) AS n FROM u GROUP BY 1)) WHERE reached > floor(total * 0.97::DOUBLE)"""
MONTHS = """SELECT area_name, CAST(date_trunc('month', instance_date) AS DATE) AS m, count(*) AS n, median(psm) AS level FROM u GROUP BY ALL HAVING count(*) >= 4"""
# The carrying index of these checks is a quarterly median that SQL can also say, with one quarter left out.
LEVELS = """SELECT * FROM (SELECT NULL AS area_name, year(instance_date) || 'Q' || quarter(instance_date) AS q, median(psm) AS level FROM u GROUP BY 2
  UNION ALL SELECT area_name, year(instance_date) || 'Q' || quarter(instance_date) AS q, median(psm) AS level FROM u GROUP BY ALL HAVING count(*) >= 20) WHERE q <> '2000Q4'"""


def _levels(sales):
    by_area = sales.withColumn("quarter", quarter_label("instance_date")).withColumn(
        "scope", F.explode(F.array(F.lit("market"), F.col("area_name"))))
    counts = by_area.groupBy("scope", "quarter").agg(F.count(F.lit(1)).alias("n"))
    levels = order_statistics(by_area, ["scope", "quarter"], {"v": F.col("psm")}, {"level": Pick("v")})
    market = F.col("scope") == "market"
    kept = counts.join(levels, ["scope", "quarter"]).filter((market | (F.col("n") >= 20)) & (F.col("quarter") != "2000Q4"))
    return materialize(kept.select(F.when(~market, F.col("scope")).alias("area_name"), "quarter", "level"), "valuation-levels")


def carried_sql(pairs_cte: str) -> str:
    def look(date: str, side: str) -> str:
        q = f"year({date}) || 'Q' || quarter({date})"
        return (f"LEFT JOIN (SELECT * FROM lv WHERE area_name IS NOT NULL) {side}a ON {side}a.area_name = p.area_name AND {side}a.q = {q} "
                f"LEFT JOIN (SELECT * FROM lv WHERE area_name IS NULL) {side}m ON {side}m.q = {q} "
                f"LEFT JOIN mo {side}f ON {side}f.area_name = p.area_name AND {side}f.m = CAST(date_trunc('month', {date}) AS DATE) ")
    return f"""SELECT p.*, comp_psm * (CASE WHEN ta.level IS NOT NULL AND fa.level > 0 THEN ta.level/fa.level WHEN tm.level IS NOT NULL AND fm.level > 0 THEN tm.level/fm.level
        WHEN tf.level IS NOT NULL AND ff.level > 0 THEN tf.level/ff.level ELSE 1 END) * pow(size/comp_size, (SELECT e FROM el)) AS v
      FROM {pairs_cte} p {look('p.when_', 't')} {look('p.comp_date', 'f')}"""


BACK = {
    "u": UNIV, "el": ELAS, "ct": CUT, "mo": MONTHS, "lv": LEVELS,
    "subj": "SELECT DISTINCT building_name, rooms, area_name, instance_date AS when_, size FROM u WHERE instance_date >= (SELECT cut FROM ct)",
    "pr": """SELECT s.*, c.instance_date AS comp_date, c.size AS comp_size, c.psm AS comp_psm FROM subj s JOIN u c USING (building_name, rooms)
      WHERE c.instance_date < (SELECT cut FROM ct) AND c.instance_date >= s.when_ - INTERVAL 12 MONTH AND c.instance_date < s.when_ AND c.size >= 0.75::DOUBLE*s.size AND c.size <= 1.33::DOUBLE*s.size""",
    "ca": carried_sql("pr"),
    "va": "SELECT building_name, rooms, area_name, when_, size, count(*) AS comps, median(v) AS pv FROM ca GROUP BY ALL HAVING count(*) >= 5",
    "er": """SELECT va.*, h.worth, pv*va.size AS value, (pv*va.size - h.worth)/h.worth AS error, CASE WHEN comps <= 9 THEN '5-9' WHEN comps <= 29 THEN '10-29' ELSE '30+' END AS bucket
      FROM va JOIN u h ON h.building_name=va.building_name AND h.rooms=va.rooms AND h.area_name=va.area_name AND h.instance_date=va.when_ AND h.size=va.size""",
}


# The chain reads the universe, the carrying index and the errors many times over, so each is
# written once to the shared folder rather than derived again by every step that reads it.
def _sales(t):
    return materialize(valuation.valuation_universe(t.registration, AS_OF, RULES), "valuation-sales")


def _errors(sales, levels):
    return materialize(valuation.backtest_errors(sales, levels, RULES), "valuation-errors")


@query("size_elasticity", f"SELECT {rnd('e', 6)} AS elasticity FROM el", u=UNIV, el=ELAS)
def _(t):
    return valuation.size_elasticity(_sales(t), RULES).select(half_up("elasticity", 6).alias("elasticity"))


@query("holdout_cut", "SELECT cut, last_day FROM ct", u=UNIV, ct=CUT)
def _(t):
    return valuation.holdout_cut(_sales(t), RULES.holdout)


@query("area_month_index", f"SELECT area_name, m AS month, n, {rnd('level', 4)} AS level FROM mo", u=UNIV, mo=MONTHS)
def _(t):
    return valuation.area_month_index(_sales(t), RULES).withColumn("level", half_up("level", 4))


@query("valuation_backtest", f"""SELECT building_name, rooms, area_name, when_ AS "when", size, worth, comps, bucket, {rnd('value', 2)} AS value, {rnd('error', 6)} AS error FROM er""", **BACK)
def _(t):
    sales = _sales(t)
    out = valuation.backtest_errors(sales, _levels(sales), RULES)
    return out.withColumn("value", half_up("value", 2)).withColumn("error", half_up("error", 6))


def _pick(p: float) -> str:
    return f"list_sort(list(error))[CAST(least(count(*)-1, floor({p}::DOUBLE*count(*))) AS BIGINT) + 1]"


CAL = f"""SELECT bucket, count(*) AS n, 1/(1 + {_pick(0.9)}) AS low_mult, 1/(1 + {_pick(0.1)}) AS high_mult, {rnd("median(abs(error))*100", 3)} AS median_abs_error_pct,
    {shr(cnt("abs(error) <= 0.1::DOUBLE"), "count(*)", 1)} AS within_10_pct, {shr(cnt("abs(error) <= 0.2::DOUBLE"), "count(*)", 1)} AS within_20_pct
  FROM (SELECT bucket, error FROM er UNION ALL SELECT 'all', error FROM er) GROUP BY bucket"""


@query("valuation_calibration", f"SELECT * REPLACE ({rnd('low_mult', 6)} AS low_mult, {rnd('high_mult', 6)} AS high_mult) FROM cal", **BACK, cal=CAL)
def _(t):
    sales = _sales(t)
    out = valuation.calibrate(_errors(sales, _levels(sales)))
    return out.withColumn("low_mult", half_up("low_mult", 6)).withColumn("high_mult", half_up("high_mult", 6))


CELLS = {
    **BACK, "cal": CAL,
    "rec": "SELECT * FROM u WHERE instance_date < (SELECT cut FROM ct) AND instance_date >= (SELECT last_day FROM ct) - INTERVAL 12 MONTH",
    "hd": """SELECT building_name, rooms, max_by(area_name, row(instance_date, worth, size, area_name)) AS area_name, max(instance_date) AS last_sale, median(size) AS size,
      (SELECT last_day FROM ct) AS when_ FROM rec GROUP BY ALL HAVING count(*) >= 5""",
    "us": """SELECT h.*, r.instance_date AS comp_date, r.size AS comp_size, r.psm AS comp_psm, r.off_plan FROM hd h JOIN rec r USING (building_name, rooms)
      WHERE r.size >= 0.75::DOUBLE*h.size AND r.size <= 1.33::DOUBLE*h.size""",
    "cc": carried_sql("us"),
    "cells": f"""SELECT building_name, rooms, area_name, comps, {rnd("size", 1)} AS typical_size, {rnd(rnd("pv", 4))} AS psm, last_sale, {shr("o", "comps")} AS offplan_share,
      {rnd("coalesce(low_mult, 0.8::DOUBLE)", 3)} AS band_low, {rnd("coalesce(high_mult, 1.2::DOUBLE)", 3)} AS band_high,
      CASE WHEN comps >= 30 THEN 'high' WHEN comps >= 10 THEN 'medium' ELSE 'low' END AS confidence
      FROM (SELECT building_name, rooms, area_name, last_sale, size, count(*) AS comps, count(*) FILTER (WHERE off_plan) AS o, median(v) AS pv FROM cc GROUP BY ALL HAVING count(*) >= 5) x
      LEFT JOIN cal ON cal.bucket = CASE WHEN comps <= 9 THEN '5-9' WHEN comps <= 29 THEN '10-29' ELSE '30+' END""",
}


def _cells(t):
    sales = _sales(t)
    levels = _levels(sales)
    return valuation.valuation_cells(sales, levels, materialize(valuation.calibrate(_errors(sales, levels)), "valuation-bands"), RULES)


@query("valuation_cells", "SELECT * FROM cells", **CELLS)
def _(t):
    return _cells(t)


@query("value_units", f"""SELECT x.*, comps, confidence, {rnd("v")} AS value, {rnd("v*band_low")} AS low, {rnd("v*band_high")} AS high, rel > 1.33::DOUBLE OR rel < 1/1.33::DOUBLE AS extrapolated FROM (
    SELECT b.*, c.comps, c.confidence, c.band_low, c.band_high, b.size/c.typical_size AS rel, c.psm*pow(b.size/c.typical_size, (SELECT e FROM el))*b.size AS v
    FROM (SELECT building_name, rooms, project_number, procedure_area AS size FROM registration WHERE trans_group='Gifts' AND property_type='Unit') b LEFT JOIN cells c USING (building_name, rooms)) y,
    LATERAL (SELECT building_name, rooms, project_number, size) x""".replace("SELECT x.*", "SELECT x.building_name, x.rooms, x.project_number, x.size"), **CELLS)
def _(t):
    units = t.registration.filter((F.col("trans_group") == "Gifts") & (F.col("property_type") == "Unit")).select(
        "building_name", "rooms", "project_number", F.col("procedure_area").alias("size"))
    return valuation.value_units(units, _cells(t), valuation.size_elasticity(_sales(t), RULES).scalar())


# The same chain on the solved index: its own levels in place of the quarterly medians.
ON_INDEX = {"pair": pairs_sql(), "c": INDEX_CELLS, **SOLVED, **BACK,
            "lv": """SELECT CASE WHEN series LIKE 'area_apartments:%' THEN substr(series, 17) END AS area_name, quarter AS q, index AS level FROM ix WHERE (series = 'registered_apartments' OR series LIKE 'area_apartments:%') AND NOT thin""",
            "cal": CAL}


@query("valuation_on_index", f"SELECT * REPLACE ({rnd('low_mult', 6)} AS low_mult, {rnd('high_mult', 6)} AS high_mult) FROM cal", **ON_INDEX)
def _(t):
    """The whole chain: pairs, solved index, carried comparables, calibration."""
    levels = materialize(valuation.carry_series(solved_index(t)), "valuation-levels")
    out = valuation.calibrate(_errors(_sales(t), levels))
    return out.withColumn("low_mult", half_up("low_mult", 6)).withColumn("high_mult", half_up("high_mult", 6))
