"""Forecast queries: seasonality, market and developer cases, quarters."""

from pyspark.sql import functions as F

from cadastra.functions.numbers import half_up
from cadastra.operators import forecast
from cadastra.plans.registry import query, rnd, tot
from cadastra.session import materialize

MK = f"""SELECT CAST(date_trunc('month', instance_date) AS DATE) AS month, count(*)::DOUBLE AS units, {tot("actual_worth")}/1e6::DOUBLE AS value FROM registration
  WHERE trans_group='Sales' AND instance_date >= DATE '1995-02-01' AND instance_date <= DATE '2001-10-31' GROUP BY 1"""
LONG = "SELECT month, 'units' AS measure, units AS v FROM mk UNION ALL SELECT month, 'value', value FROM mk"
CM = "SELECT * FROM (SELECT *, sum(v) OVER w / 13 AS centred, count(*) OVER w AS n FROM lg WINDOW w AS (PARTITION BY measure ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)) WHERE n = 13"
FA = """SELECT measure, calendar_month, raw / (sum(raw) OVER (PARTITION BY measure) / 12) AS factor FROM (SELECT e.measure, e.calendar_month, coalesce(m.raw, 1.0::DOUBLE) AS raw FROM (SELECT unnest(['units','value']) AS measure, CAST(unnest(range(1,13)) AS INT) AS calendar_month) e
  LEFT JOIN (SELECT measure, CAST(month(month) AS INT) AS calendar_month, median(v/centred) AS raw FROM cm GROUP BY ALL) m USING (measure, calendar_month))"""
FA = FA.replace("(SELECT unnest(['units','value']) AS measure, CAST(unnest(range(1,13)) AS INT) AS calendar_month)",
                "(SELECT m AS measure, CAST(c AS INT) AS calendar_month FROM (VALUES ('units'), ('value')) a(m), range(1,13) b(c))")
BASE = {"mk": MK, "lg": LONG, "cm": CM, "fa": FA}


def _fit(source: str, keys: str, having: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}measure, sum(sa) FILTER (WHERE rn <= 3)/3 AS flat_level, regr_slope(ln(greatest(sa, 1e-9::DOUBLE)), (12 - rn)::DOUBLE) AS slope, avg(ln(greatest(sa, 1e-9::DOUBLE))) AS mean_, max(month) AS last_month
      FROM (SELECT l.*, v/factor AS sa, row_number() OVER (PARTITION BY {k}l.measure ORDER BY month DESC) AS rn, count(*) FILTER (WHERE v > 0) OVER (PARTITION BY {k}l.measure) AS act FROM {source} l JOIN fa ON fa.measure = l.measure AND fa.calendar_month = month(l.month))
      WHERE rn <= 12 {having} GROUP BY {k}measure"""


def _ahead(fit: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}x.measure, x.month, CAST(h AS INT) AS h, flat_level*factor AS flat, exp(mean_ + slope*5.5::DOUBLE + slope*0.85::DOUBLE*(1 - pow(0.85::DOUBLE, h))/(1 - 0.85::DOUBLE))*factor AS momentum, (exp(slope) - 1)*100 AS momentum_pct_per_month, flat_level
      FROM (SELECT {fit}.*, h, CAST(last_month + to_months(CAST(h AS INT)) AS DATE) AS month FROM {fit}, range(1,9) r(h)) x JOIN fa ON fa.measure = x.measure AND fa.calendar_month = month(x.month)"""


def _settled(df):
    return df.select(*[half_up(c, 4).alias(c) if c in ("flat", "momentum", "momentum_pct_per_month", "flat_level") else F.col(c) for c in df.columns])


SETTLED = ", ".join(f"{rnd(c, 4)} AS {c}" for c in ("flat", "momentum", "momentum_pct_per_month", "flat_level"))


def _market(t):
    # One row per month, read by every step of the forecast.
    return materialize(forecast.market_months(t.registration, "1995-02-01"), "market-months")


@query("centred_mean", f"SELECT month, measure, {rnd('v', 4)} AS v, {rnd('centred', 4)} AS centred FROM cm", **BASE)
def _(t):
    out = forecast.centred_mean(forecast._long(_market(t), []), ["measure"])
    return out.withColumn("centred", half_up("centred", 4)).withColumn("v", half_up("v", 4))


@query("seasonal_factors", f"SELECT measure, calendar_month, {rnd('factor', 6)} AS factor FROM fa", **BASE)
def _(t):
    return forecast.seasonal_factors(_market(t)).withColumn("factor", half_up("factor", 6))


@query("market_forecast", f"SELECT measure, month, h, {SETTLED} FROM ah", **BASE, ft=_fit("lg", ""), ah=_ahead("ft", ""))
def _(t):
    market = _market(t)
    return _settled(forecast.forecast(market, forecast.seasonal_factors(market), []))


@query("market_forecast_quarters", f"""SELECT measure, CAST(year(month) AS INT) AS "year", CAST(quarter(month) AS INT) AS quarter, {rnd("sum(flat)", 4)} AS flat, {rnd("sum(momentum)", 4)} AS momentum, count(*) AS months FROM ah GROUP BY ALL""", **BASE, ft=_fit("lg", ""), ah=_ahead("ft", ""))
def _(t):
    market = _market(t)
    return forecast.forecast_quarters(forecast.forecast(market, forecast.seasonal_factors(market), []), [])


ISSUER = f"""SELECT issuer, s.month, u, w/1e6::DOUBLE AS w FROM (SELECT i.issuer, mk.month, coalesce(n, 0)::DOUBLE AS u, coalesce(w, 0) AS w FROM (SELECT DISTINCT 'issuer-' || CAST(CAST(developer_number AS INT) % 3 AS VARCHAR) AS issuer FROM developer) i, mk
    LEFT JOIN (SELECT 'issuer-' || CAST(CAST(p.developer_number AS INT) % 3 AS VARCHAR) AS issuer, CAST(date_trunc('month', instance_date) AS DATE) AS month, count(*) AS n, {tot("actual_worth")} AS w FROM registration JOIN project p USING (project_number) WHERE trans_group='Sales' GROUP BY ALL) x
    ON x.issuer = i.issuer AND x.month = mk.month) s"""


@query("issuer_forecast", f"SELECT issuer, measure, month, h, {SETTLED} FROM ah", **BASE, isu=ISSUER,
       il="SELECT issuer, month, 'units' AS measure, u AS v FROM isu UNION ALL SELECT issuer, month, 'value', w FROM isu", ft=_fit("il", "issuer", "AND act >= 30"), ah=_ahead("ft", "issuer"))
def _(t):
    market = _market(t)
    group = t.developer.select("developer_number", F.concat(F.lit("issuer-"), (F.col("developer_number").cast("int") % 3).cast("string")).alias("issuer"))
    months = forecast.developer_months(t.registration, t.project, market, group)
    return _settled(forecast.forecast(months, forecast.seasonal_factors(market), ["issuer"], min_active=30))
