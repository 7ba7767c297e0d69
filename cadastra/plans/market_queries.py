"""Market pack queries: windows, series, leagues, bands, yields, rents."""

from cadastra.functions.predicates import Limits
from cadastra.operators import market
from cadastra.plans.adapters import AS_OF
from cadastra.plans.registry import avg, chg, cnt, med, query, rnd, shr, tot

# Stand-in scale: line values run to about 105,000, so luxury and bands are set below that.
LIMITS = Limits(luxury=80_000.0)
UNIT = 1e6
PERIODS = market.edition_periods("monthly", "2001-07")
CUR, PREV, YOY = PERIODS["cur"], PERIODS["prev"], PERIODS["yoy"]
BANDS = (("under 10k", 0.0, 1e4), ("10-30k", 1e4, 3e4), ("30-60k", 3e4, 6e4), ("60-90k", 6e4, 9e4),
         ("90-200k", 9e4, 2e5), ("200k and above", 2e5, 1e15))


def _tagged(source: str, date_col: str, periods: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS period, x.* FROM {source} x WHERE {date_col} BETWEEN DATE '{a}' AND DATE '{b}'"
        for k, (a, b) in periods.items()
    )


PSM = "meter_sale_price BETWEEN 500 AND 200000"
SALE, OFF, READY = "trans_group='Sales'", "reg_type='Off-Plan Properties'", "reg_type='Existing Properties'"
APT, VIL = "property_type='Unit'", "property_type='Villa'"


def sales_stats_sql(source: str, group: str = "period") -> str:
    w, p = "actual_worth", "meter_sale_price"
    s = SALE
    return f"""
    SELECT {group}, {cnt(s)} AS n, {rnd(tot(f"CASE WHEN {s} THEN {w} END") + "/1e6::DOUBLE", 2)} AS value,
      {cnt(f"{s} AND {OFF}")} AS "off", {cnt(f"{s} AND {READY}")} AS ready, {cnt(f"{s} AND {APT}")} AS units,
      {cnt(f"{s} AND {VIL}")} AS villas, {cnt(f"{s} AND property_type='Land'")} AS land,
      {cnt(f"{s} AND property_type='Building'")} AS buildings, {cnt(f"{s} AND {w}>=80000")} AS lux,
      {rnd(tot(f"CASE WHEN {s} AND {w}>=80000 THEN {w} ELSE 0 END") + "/1e6::DOUBLE", 2)} AS lux_value,
      {cnt("trans_group='Mortgages'")} AS mortgages,
      {rnd(tot(f"CASE WHEN trans_group='Mortgages' THEN {w} END") + "/1e6::DOUBLE", 2)} AS mortgage_value,
      {shr(cnt(f"{s} AND {OFF}"), cnt(s))} AS offplan_pct,
      {shr(cnt(f"{s} AND property_usage='Residential'"), cnt(s))} AS residential_pct,
      {shr(cnt(f"{s} AND {w}>=80000"), cnt(s), 1)} AS lux_pct, {shr(cnt("trans_group='Mortgages'"), cnt(s))} AS mortgage_pct,
      {med(p, f"{s} AND {PSM}")} AS med_psm, {med(p, f"{s} AND {PSM} AND {APT}")} AS med_psm_unit,
      {med(p, f"{s} AND {PSM} AND {VIL}")} AS med_psm_villa, {med(p, f"{s} AND {PSM} AND {APT} AND {OFF}")} AS med_psm_unit_off,
      {med(p, f"{s} AND {PSM} AND {APT} AND {READY}")} AS med_psm_unit_ready,
      {chg(f"median({p}) FILTER (WHERE {s} AND {PSM} AND {APT} AND {OFF})", f"median({p}) FILTER (WHERE {s} AND {PSM} AND {APT} AND {READY})")} AS off_ready_spread,
      {med(w, f"{s} AND {w}>0")} AS med_price,
      {rnd(tot(f"CASE WHEN {s} THEN {w} END") + f"/nullif({cnt(s)},0)")} AS avg_ticket
    FROM {source} WHERE trans_group IN ('Sales','Mortgages') GROUP BY {group}"""


HOME = "rent_property_type IN ('Flat','Villa')"
NEW, RENEW = "contract_reg_type ILIKE 'new%'", "contract_reg_type ILIKE 'renew%'"
RENT_OK = "annual_amount BETWEEN 1000 AND 50000000"
RPSM = "actual_area > 10 AND annual_amount/actual_area < 20000"


def rent_stats_sql(source: str) -> str:
    rooms = "".join(
        f", {med('annual_amount', f'{HOME} AND {NEW} AND rooms={chr(39)}{r}{chr(39)}')} AS median_rooms_{i}"
        f", {cnt(f'{HOME} AND {NEW} AND rooms={chr(39)}{r}{chr(39)}')} AS n_rooms_{i}"
        for i, r in enumerate(market.ROOM_TYPES)
    )
    return f"""
    SELECT period, count(*) AS n, {shr(cnt(NEW), "count(*)")} AS new_pct, {med("annual_amount", HOME)} AS median_all,
      {med("annual_amount", f"{HOME} AND {NEW}")} AS median_new, {med("annual_amount", f"{HOME} AND {RENEW}")} AS median_renew,
      {med("annual_amount/actual_area", f"{HOME} AND {NEW} AND {RPSM}")} AS median_psm_new {rooms}
    FROM {source} WHERE {RENT_OK} GROUP BY period"""


@query("sales_stats", "SELECT * FROM st", tagged=_tagged("registration", "instance_date", PERIODS), st=sales_stats_sql("tagged"))
def _(t):
    return market.sales_stats(t.registration, PERIODS, LIMITS, UNIT)


@query("rent_stats", "SELECT * FROM st", tagged=_tagged("rent", "contract_start_date", PERIODS), st=rent_stats_sql("tagged"))
def _(t):
    return market.rent_stats(t.rent, PERIODS)


def _headline_sql() -> str:
    parts = []
    for source, metrics in (("sales", market.HEADLINE_SALES), ("rent", market.HEADLINE_RENT)):
        table = "st" if source == "sales" else "rt"
        for m in metrics:
            v = {k: f"max(CASE WHEN period='{k}' THEN {m} END)::DOUBLE" for k in ("cur", "prev", "yoy")}
            diff = (lambda o: rnd(f"{v['cur']} - {v[o]}", 1)) if m in market.POINT_METRICS else (lambda o: chg(v["cur"], v[o]))
            parts.append(f"SELECT '{source}' AS source, '{m}' AS metric, {v['cur']} AS cur, {v['prev']} AS prev, {v['yoy']} AS yoy, "
                         f"{diff('prev')} AS mom_change, {diff('yoy')} AS yoy_change FROM {table}")
    return " UNION ALL ".join(parts)


@query("headline", _headline_sql(), tagged=_tagged("registration", "instance_date", PERIODS), st=sales_stats_sql("tagged"),
       rtag=_tagged("rent", "contract_start_date", PERIODS), rt=rent_stats_sql("rtag"))
def _(t):
    return market.headline(market.sales_stats(t.registration, PERIODS, LIMITS, UNIT), market.rent_stats(t.rent, PERIODS))


@query("monthly_series", f"""
  SELECT strftime(sp.m, '%Y-%m') AS month, coalesce(s.n, 0) AS n, {rnd("coalesce(s.w,0)/1e6::DOUBLE", 2)} AS value,
    coalesce(s.o, 0) AS "off", {shr("s.o", "s.n")} AS offplan_pct, s.pu AS psm_unit, s.pv AS psm_villa, coalesce(r.n, 0) AS rents
  FROM spine sp LEFT JOIN s ON s.m = sp.m LEFT JOIN r ON r.m = sp.m""",
       spine="SELECT CAST(unnest(generate_series(DATE '1998-08-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS DATE) AS m",
       s=f"""SELECT CAST(date_trunc('month', instance_date) AS DATE) AS m, count(*) AS n, {tot("actual_worth")} AS w, {cnt(OFF)} AS o,
         {med("meter_sale_price", f"{PSM} AND {APT}")} AS pu, {med("meter_sale_price", f"{PSM} AND {VIL}")} AS pv
         FROM registration WHERE {SALE} AND instance_date BETWEEN DATE '1998-08-01' AND DATE '2001-07-31' GROUP BY 1""",
       r="SELECT CAST(date_trunc('month', contract_start_date) AS DATE) AS m, count(*) AS n FROM rent WHERE contract_start_date BETWEEN DATE '1998-08-01' AND DATE '2001-07-31' GROUP BY 1")
def _(t):
    return market.monthly_series(t.registration, t.rent, "2001-07", 36, unit=UNIT)


@query("yearly_series", f"""
  SELECT year(instance_date)::INT AS "year", count(*) AS n, {rnd(tot("actual_worth") + "/1e6::DOUBLE", 2)} AS value, {cnt(OFF)} AS "off",
    {med("meter_sale_price", f"{PSM} AND {APT}")} AS psm_unit, {med("meter_sale_price", f"{PSM} AND {VIL}")} AS psm_villa,
    year(instance_date) = 2001 AS ytd
  FROM registration WHERE {SALE} AND instance_date BETWEEN DATE '1995-01-01' AND DATE '{AS_OF}' GROUP BY year(instance_date)""")
def _(t):
    return market.yearly_series(t.registration, AS_OF, 1995, unit=UNIT)


YEARS = {str(y): (f"{y}-01-01", f"{y}-07-31") for y in range(1995, 2002)}


@query("across_years", f"""
  SELECT CAST(period AS INT) AS "year", n, value, med_psm_unit, med_psm_villa, offplan_pct, lux,
    {chg("n", "lag(n) OVER w")} AS n_yoy, {chg("value", "lag(value) OVER w")} AS value_yoy, {chg("med_psm_unit", "lag(med_psm_unit) OVER w")} AS psm_yoy
  FROM st WINDOW w AS (ORDER BY period)""", tagged=_tagged("registration", "instance_date", YEARS), st=sales_stats_sql("tagged"))
def _(t):
    return market.across_years(t.registration, "01-01", "07-31", 2001, 7, LIMITS, UNIT)


@query("price_bands", " UNION ALL ".join(f"""
  SELECT '{label}' AS band, {i} AS pos, {cnt(f"period='cur' AND {c}")} AS n, coalesce({shr(cnt(f"period='cur' AND {c}"), cnt("period='cur'"), 1)}, 0) AS share,
    {rnd(tot(f"CASE WHEN period='cur' AND {c} THEN actual_worth END") + "/1e6::DOUBLE", 2)} AS value,
    {chg(cnt(f"period='cur' AND {c}"), cnt(f"period='yoy' AND {c}"))} AS n_change FROM tagged WHERE {SALE}"""
    for i, (label, lo, hi) in enumerate(BANDS) for c in [f"actual_worth >= {lo} AND actual_worth < {hi}"]),
       tagged=_tagged("registration", "instance_date", {"cur": CUR, "yoy": YOY}))
def _(t):
    return market.price_bands(t.registration, CUR, YOY, BANDS, UNIT)


@query("biggest_deals", f"""
  SELECT d.instance_date, d.area_name, d.project_name, d.building_name, d.property_type, d.property_sub_type, d.rooms,
    {rnd("procedure_area")} AS sqm, {rnd("actual_worth")} AS worth, {rnd("meter_sale_price")} AS psm, d.reg_type,
    CASE WHEN p.slug IS NOT NULL THEN p.area_slug || '/' || p.slug END AS page
  FROM (SELECT * FROM registration WHERE {SALE} AND property_type <> 'Land' AND instance_date BETWEEN DATE '{CUR[0]}' AND DATE '{CUR[1]}'
    ORDER BY actual_worth DESC, instance_date, project_number, procedure_area, area_name, procedure_name LIMIT 12) d
  LEFT JOIN project p USING (project_number)""")
def _(t):
    return market.biggest_deals(t.registration, t.project, CUR)


@query("area_league", f"""
  SELECT area_name, lower(replace(replace(replace(replace(area_name,' ','-'),'''','-'),'.','-'),'--','-')) AS slug, n,
    {shr("n", "sum(n) OVER ()", 1)} AS share, {rnd("w/1e6::DOUBLE", 2)} AS value, {shr("o", "n")} AS offplan_pct, {rnd(rnd("mc", 4))} AS med_psm,
    {chg("mc", "my")} AS psm_yoy, {chg("n", "ny")} AS n_yoy FROM g WHERE n > 0 ORDER BY n DESC, area_name LIMIT 20""",
       tagged=_tagged("registration", "instance_date", {"cur": CUR, "yoy": YOY}),
       g=f"""SELECT area_name, {cnt("period='cur'")} AS n, {cnt("period='yoy'")} AS ny, {tot("CASE WHEN period='cur' THEN actual_worth END")} AS w,
         {cnt(f"period='cur' AND {OFF}")} AS o, median(meter_sale_price) FILTER (WHERE period='cur' AND {PSM} AND {APT}) AS mc,
         median(meter_sale_price) FILTER (WHERE period='yoy' AND {PSM} AND {APT}) AS my FROM tagged WHERE {SALE} GROUP BY area_name""")
def _(t):
    return market.area_league(t.registration, CUR, YOY, 20, unit=UNIT)


@query("developer_league", f"""
  SELECT developer_number, developer_name, developer_slug, CAST(rank AS INT) AS rank, n, projects, {rnd("w/1e6::DOUBLE", 2)} AS value, {shr("n", "linked_sales", 1)} AS share_linked,
    {shr("n", "all_sales", 1)} AS share_all, {chg("n", "ny")} AS n_yoy, {shr("linked_sales", "all_sales")} AS linked_pct, linked_sales, all_sales,
    {shr("five", "all_sales", 1)} AS top5_share, {shr("five", "linked_sales", 1)} AS top5_share_linked
  FROM (SELECT *, sum(CASE WHEN rank <= 5 THEN n END) OVER () AS five FROM r) WHERE rank <= 15 AND n > 0""",
       tagged=_tagged("registration", "instance_date", {"cur": CUR, "yoy": YOY}),
       g=f"""SELECT d.developer_number, d.developer_name, d.developer_slug, {cnt("period='cur'")} AS n, {cnt("period='yoy'")} AS ny,
         {tot("CASE WHEN period='cur' THEN actual_worth END")} AS w, count(DISTINCT CASE WHEN period='cur' THEN t.project_number END) AS projects
         FROM tagged t JOIN project p USING (project_number) JOIN developer d ON d.developer_number = p.developer_number WHERE {SALE} GROUP BY ALL""",
       r=f"""SELECT *, row_number() OVER (ORDER BY n DESC, developer_number) AS rank, CAST(sum(n) OVER () AS BIGINT) AS linked_sales,
         (SELECT count(*) FROM tagged WHERE {SALE} AND period='cur') AS all_sales FROM g""")
def _(t):
    return market.developer_league(t.registration, t.project, t.developer, CUR, YOY, unit=UNIT)


@query("project_league", f"""
  SELECT g.project_number, coalesce(p.project_name, g.nm) AS project_name, g.sales_area, g.n, {rnd("g.w/1e3::DOUBLE", 2)} AS value, {shr("g.o", "g.n")} AS offplan_pct,
    p.units, {shr("g.n", "p.units", 1)} AS sold_pct_of_units, CASE WHEN p.slug IS NOT NULL THEN p.area_slug || '/' || p.slug END AS page
  FROM (SELECT project_number, count(*) AS n, {tot("actual_worth")} AS w, {cnt(OFF)} AS o, min(project_name) AS nm, min(area_name) AS sales_area
    FROM registration WHERE {SALE} AND instance_date BETWEEN DATE '{CUR[0]}' AND DATE '{CUR[1]}' GROUP BY 1 ORDER BY n DESC, project_number LIMIT 15) g
  LEFT JOIN project p USING (project_number)""")
def _(t):
    return market.project_league(t.registration, t.project, CUR, 15, 1e3)


@query("yield_map", f"""
  SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY yield_pct DESC, area_name) AS INT) AS top_rank, CAST(row_number() OVER (ORDER BY yield_pct, area_name DESC) AS INT) AS bottom_rank FROM (
    SELECT area_name, {rnd(rnd("r.v", 4))} AS rent_psm, {rnd(rnd("s.v", 4))} AS sale_psm, {shr(rnd("r.v", 4), rnd("s.v", 4), 1)} AS yield_pct, r.n AS rents, s.n AS sales
    FROM r JOIN s USING (area_name) WHERE r.v IS NOT NULL AND s.v > 0 AND r.n >= 5 AND s.n >= 5)) WHERE top_rank <= 15 OR bottom_rank <= 8""",
       r=f"""SELECT area_name, count(*) AS n, median(annual_amount/actual_area) FILTER (WHERE {RENT_OK} AND {RPSM}) AS v FROM rent
         WHERE contract_start_date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}' AND {NEW} AND rent_property_type='Flat' GROUP BY 1""",
       s=f"""SELECT area_name, count(*) AS n, median(meter_sale_price) FILTER (WHERE {PSM}) AS v FROM registration
         WHERE {SALE} AND {READY} AND {APT} AND instance_date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}' GROUP BY 1""")
def _(t):
    return market.yield_map(t.registration, t.rent, AS_OF, min_rents=5, min_sales=5)


@query("rent_areas", f"""
  SELECT area_name, lower(replace(replace(replace(replace(area_name,' ','-'),'''','-'),'.','-'),'--','-')) AS slug, n, {shr("n", "sum(n) OVER ()", 1)} AS share,
    {shr("nw", "n")} AS new_pct, {rnd(rnd("mn", 4))} AS median_new, {rnd(rnd("mr", 4))} AS median_renew, {chg("mn", "my")} AS new_yoy, {chg("mn", "mr")} AS spread
  FROM g WHERE n > 0 ORDER BY n DESC, area_name LIMIT 15""",
       tagged=_tagged("rent", "contract_start_date", {"cur": ("2000-08-01", "2001-07-31"), "yoy": ("1999-08-01", "2000-07-31")}),
       g=f"""SELECT area_name, {cnt("period='cur'")} AS n, {cnt(f"period='cur' AND {NEW}")} AS nw,
         median(annual_amount) FILTER (WHERE period='cur' AND {NEW}) AS mn, median(annual_amount) FILTER (WHERE period='yoy' AND {NEW}) AS my,
         median(annual_amount) FILTER (WHERE period='cur' AND {RENEW}) AS mr FROM tagged WHERE {RENT_OK} AND {HOME} GROUP BY 1""")
def _(t):
    return market.rent_areas(t.rent, ("2000-08-01", "2001-07-31"), ("1999-08-01", "2000-07-31"))
