"""The domain tables as plain SELECTs over the driver's star schema.

One text serves both engines: Spark reads it through ``spark.sql`` with the raw
tables bound as DataFrames, the oracle reads it as common table expressions. Two
spellings differ per dialect, day arithmetic and JSON, and are passed in.

Money is settled to fils and price per sqm to two places where the row is made, so
sums land on a grid and do not depend on the order rows were added in.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-01"
# Readings are dated 2024 in the raw events; moved back so that both registers share one as-of date.
READING_SHIFT = 8218

SPARK = {
    "plus": lambda d, n: f"date_add({d}, CAST({n} AS INT))",
    "k": "CAST(get_json_object(props, '$.k') AS INT)",
}
DUCK = {
    "plus": lambda d, n: f"({d} + CAST({n} AS INTEGER))",
    "k": "CAST(json_extract_string(props, '$.k') AS INTEGER)",
}


def _worth() -> str:
    return "(floor(l.l_extendedprice * (CAST(1 AS DOUBLE) - l.l_discount) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE))"


def _registration_columns() -> str:
    return f"""
      CAST(l.l_shipdate AS DATE) AS instance_date,
      CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_shipdate AS DATE) END AS feed_date,
      CASE l.l_returnflag WHEN 'N' THEN 'Sales' WHEN 'R' THEN 'Mortgages' ELSE 'Gifts' END AS trans_group,
      CASE WHEN l.l_linestatus = 'O' THEN 'Sell - Pre registration'
           WHEN l.l_linenumber % 3 = 0 THEN 'Delayed Sell' ELSE 'Sell' END AS procedure_name,
      CASE WHEN l.l_linestatus = 'O' THEN 'Off-Plan Properties' ELSE 'Existing Properties' END AS reg_type,
      CASE WHEN p.p_type IN ('STANDARD', 'SMALL', 'MEDIUM') THEN 'Unit'
           WHEN p.p_type = 'ECONOMY' THEN 'Land' ELSE 'Villa' END AS property_type,
      p.p_type AS property_sub_type,
      CASE WHEN p.p_size % 4 = 0 THEN 'Commercial' ELSE 'Residential' END AS property_usage,
      n.n_name AS area_name,
      p.p_brand AS building_name,
      CAST(l.l_partkey AS STRING) AS project_number,
      p.p_name AS project_name,
      CASE WHEN p.p_size % 5 = 0 THEN 'Studio' ELSE CAST(p.p_size % 5 AS STRING) || ' B/R' END AS rooms,
      l.l_quantity AS procedure_area,
      {_worth()} AS actual_worth,
      floor({_worth()} / l.l_quantity * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS meter_sale_price,
      'Metro ' || CAST(l.l_suppkey % 7 AS STRING) AS nearest_metro,
      'Landmark ' || CAST(l.l_suppkey % 5 AS STRING) AS nearest_landmark,
      CASE WHEN l.l_suppkey % 4 = 0 THEN '' ELSE 'Mall ' || CAST(l.l_suppkey % 3 AS STRING) END AS nearest_mall,
      'Community ' || CAST(l.l_suppkey % 11 AS STRING) AS master_project"""


_REGISTRATION_FROM = """
    FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
    JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
    JOIN {nation} n ON n.n_nationkey = s.s_nationkey"""


def texts(dialect: dict) -> dict[str, str]:
    """Adapter name -> SELECT text; raw tables as ``{name}``."""
    plus, k = dialect["plus"], dialect["k"]
    tx_id = (
        "CASE WHEN l.l_linestatus = 'F' THEN "
        "CASE l.l_returnflag WHEN 'N' THEN '1' WHEN 'R' THEN '2' ELSE '3' END || '-11-' || CAST(year(o.o_orderdate) AS STRING) || '-' "
        "|| CAST(l.l_orderkey AS STRING) || CAST(l.l_linenumber AS STRING) "
        "ELSE '11-' || CAST(l.l_orderkey AS STRING) || CAST(l.l_linenumber AS STRING) || '-' || CAST(year(o.o_orderdate) AS STRING) END"
    )
    first_seen = plus("CAST(l.l_shipdate AS DATE)", "3 * l.l_linenumber")
    withdrawn = f"CASE WHEN l.l_tax = CAST(0.08 AS DOUBLE) THEN {plus(first_seen, '30')} END"
    day = plus("CAST(ts AS DATE)", f"-{READING_SHIFT}")
    base = plus("DATE '2024-01-01'", f"-{READING_SHIFT}")
    completion = plus(base, f"{k} * 10")
    return {
        "registration": f"SELECT {_registration_columns()} {_REGISTRATION_FROM}",
        "registration_id": f"""
    SELECT {tx_id} AS transaction_id,
      '11|' || CAST(year(o.o_orderdate) AS STRING) || '|' || CAST(l.l_orderkey AS STRING) || CAST(l.l_linenumber AS STRING) || '|' ||
        CASE l.l_returnflag WHEN 'N' THEN 'Sales' WHEN 'R' THEN 'Mortgages' ELSE 'Gifts' END AS expected_key,
      {first_seen} AS first_seen, {withdrawn} AS withdrawn_on, {_registration_columns()}
      {_REGISTRATION_FROM} JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey""",
        "registration_seen": f"""
    SELECT {first_seen} AS first_seen, {withdrawn} AS withdrawn_on, {_registration_columns()} {_REGISTRATION_FROM}""",
        "project": """
    SELECT CAST(p.p_partkey AS STRING) AS project_number, p.p_name || ' ' || CAST(p.p_partkey AS STRING) AS project_name,
      'p-' || CAST(p.p_partkey AS STRING) AS slug, n.n_name AS area_name,
      lower(n.n_name) AS area_slug,
      CAST(p.p_partkey % 10 AS STRING) AS developer_number,
      CASE WHEN p.p_partkey % 6 = 0 THEN '' WHEN p.p_partkey % 6 = 1 THEN 'Community ' || CAST(p.p_partkey % 11 AS STRING)
           ELSE 'Valley ' || CAST(p.p_partkey % 8 AS STRING) || ' - ' || CAST(p.p_partkey % 5 AS STRING) END AS master_project,
      CASE WHEN p.p_partkey % 4 = 0 THEN 'Mashreq escrow' ELSE 'Other agent' END AS escrow_agent,
      CASE WHEN p.p_partkey % 13 <> 0 THEN {start} END AS project_start_date,
      CASE WHEN p.p_partkey % 17 = 0 THEN {cancelled} END AS cancellation_date,
      CAST(CASE WHEN p.p_size % 9 = 0 THEN 0 ELSE p.p_size * 4 END AS INT) AS units,
      CAST(CASE WHEN p.p_size % 6 = 0 THEN p.p_size ELSE 0 END AS INT) AS villas,
      CAST(p.p_size % 3 AS INT) AS lands, CAST(1 AS INT) AS buildings,
      p.p_retailprice AS project_value
    FROM {part} p JOIN {supplier} s ON s.s_suppkey = p.p_partkey % 10 JOIN {nation} n ON n.n_nationkey = s.s_nationkey"""
        .replace("{start}", plus("DATE '1996-01-01'", "p.p_partkey % 1500"))
        .replace("{cancelled}", "DATE '2000-01-01'"),
        "developer": """
    SELECT CAST(s_suppkey AS STRING) AS developer_number, s_name AS developer_name,
      'dev-' || CAST(s_suppkey AS STRING) AS developer_slug
    FROM {supplier} WHERE s_suppkey < 10""",
        "observation": f"""
    SELECT event_id AS id, CAST(user_id AS STRING) AS project_number, {day} AS observed_at,
      CASE event_type WHEN 'view' THEN 'ACTIVE' WHEN 'click' THEN 'PENDING' WHEN 'error' THEN 'NOT_STARTED'
        WHEN 'signup' THEN 'CONDITIONAL_ACTIVATING' ELSE 'FINISHED' END AS status,
      value AS percent_completed, {completion} AS completion_date,
      CASE event_id % 3 WHEN 0 THEN 'gateway' WHEN 1 THEN 'register-extract' ELSE 'api' END AS source
    FROM {{events}}""",
        "price_event": f"""
    SELECT CAST(user_id AS STRING) AS listing_id, {day} AS observed_at, event_id,
      floor(value * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS asking_price
    FROM {{events}}""",
        "rent": """
    SELECT CAST(o.o_orderkey AS STRING) AS contract_id, CAST(o.o_orderdate AS DATE) AS contract_start_date,
      CASE WHEN o.o_orderstatus = 'O' THEN 'Renew' ELSE 'New' END AS contract_reg_type,
      o.o_totalprice AS annual_amount, n.n_name AS area_name,
      CAST(o.o_orderkey % 150 AS STRING) AS project_number,
      CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Villa' WHEN '2' THEN 'Flat' WHEN '3' THEN 'Flat'
        WHEN '4' THEN 'Studio' ELSE 'Office' END AS rent_property_type,
      CASE WHEN o.o_custkey % 5 = 0 THEN 'Studio' WHEN o.o_custkey % 7 = 0 THEN '' ELSE CAST(o.o_custkey % 5 AS STRING) || ' B/R' END AS rooms,
      CAST(20 + o.o_orderkey % 180 AS DOUBLE) AS actual_area
    FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    }


RAW = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


class Tables:
    """The domain tables of one data folder, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._texts = texts(SPARK)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        text = self._texts[name]
        bound = {raw: self.raw(raw) for raw in RAW if "{" + raw + "}" in text}
        return self.spark.sql(text, **bound)

    registration = cached_property(lambda self: self._view("registration"))
    registration_id = cached_property(lambda self: self._view("registration_id"))
    registration_seen = cached_property(lambda self: self._view("registration_seen"))
    project = cached_property(lambda self: self._view("project"))
    developer = cached_property(lambda self: self._view("developer"))
    observation = cached_property(lambda self: self._view("observation"))
    price_event = cached_property(lambda self: self._view("price_event"))
    rent = cached_property(lambda self: self._view("rent"))


def oracle(body: str, **ctes: str) -> str:
    """Oracle text: the adapters as CTEs, then ``ctes`` in order, then ``body``."""
    parts = [f"{name} AS ({text})" for name, text in texts(DUCK).items()]
    for raw in RAW:
        parts = [part.replace("{" + raw + "}", raw) for part in parts]
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
