"""Landed feeds as DataFrames: register CSVs in any header dialect, dated snapshots, scans, permits, dossiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.text import parse_date

FieldMap = Mapping[str, Sequence[str]]

# Canonical field and the headers it is published under, first match wins.
TRANSACTION_FIELDS: FieldMap = {
    "transaction_id": ("TRANSACTION_NUMBER", "transaction_id"), "instance_date": ("INSTANCE_DATE", "instance_date"),
    "trans_group": ("GROUP_EN", "trans_group_en"), "procedure_name": ("PROCEDURE_EN", "procedure_name_en"),
    "reg_type": ("IS_OFFPLAN_EN", "reg_type_en"), "property_type": ("PROP_TYPE_EN", "property_type_en"),
    "property_sub_type": ("PROP_SB_TYPE_EN", "property_sub_type_en"), "property_usage": ("USAGE_EN", "property_usage_en"),
    "area_name": ("AREA_EN", "area_name_en"), "building_name": ("BUILDING_NAME_EN", "building_name_en"),
    "project_number": ("PROJECT_NUMBER", "project_number"), "project_name": ("PROJECT_EN", "project_name_en"),
    "rooms": ("ROOMS_EN", "rooms_en"), "procedure_area": ("PROCEDURE_AREA", "ACTUAL_AREA", "procedure_area"),
    "actual_worth": ("TRANS_VALUE", "actual_worth"), "meter_sale_price": ("METER_SALE_PRICE", "meter_sale_price"),
}
RENT_FIELDS: FieldMap = {
    "contract_id": ("CONTRACT_NUMBER", "CONTRACT_ID", "contract_id"),
    "contract_start_date": ("START_DATE", "CONTRACT_START_DATE", "contract_start_date"),
    "contract_reg_type": ("CONTRACT_REG_TYPE_EN", "VERSION_EN", "contract_reg_type_en"), "annual_amount": ("ANNUAL_AMOUNT", "annual_amount"),
    "area_name": ("AREA_EN", "area_name_en"), "project_name": ("PROJECT_EN", "project_name_en"), "project_number": ("PROJECT_NUMBER", "project_number"),
    "rent_property_type": ("PROP_TYPE_EN", "EJARI_PROPERTY_TYPE_EN", "ejari_property_type_en"),
    "rooms": ("ROOMS_EN", "ejari_property_sub_type_en", "rooms_en"), "actual_area": ("ACTUAL_AREA", "actual_area"),
}
PROJECT_FIELDS: FieldMap = {
    "project_number": ("PROJECT_NUMBER", "project_number"), "project_name": ("PROJECT_EN", "project_name_en", "project_name"),
    "area_name": ("AREA_EN", "area_name_en"), "developer_number": ("DEVELOPER_NUMBER", "developer_number"),
    "developer_name": ("DEVELOPER_EN", "developer_name_en"), "cancellation_date": ("cancellation_date",),
    "master_project": ("MASTER_PROJECT_EN", "master_project_en"), "escrow_agent": ("ESCROW_ACCOUNT_NUMBER", "escrow_agent_name_en", "escrow_agent_name"),
    "project_start_date": ("START_DATE", "project_start_date"), "planned_end_date": ("END_DATE", "project_end_date"),
    "completion_date": ("COMPLETION_DATE", "completion_date"), "percent_completed": ("PERCENT_COMPLETED", "percent_completed"),
    "project_status": ("PROJECT_STATUS", "project_status"), "load_timestamp": ("load_timestamp", "LOAD_TIMESTAMP"),
    "project_value": ("PROJECT_VALUE", "project_value"), "units": ("CNT_UNIT", "no_of_units"), "villas": ("CNT_VILLA", "no_of_villas"),
    "lands": ("CNT_LAND", "no_of_lands"), "buildings": ("CNT_BUILDING", "no_of_buildings"),
}
PERMIT_FIELDS: FieldMap = {
    "permit_number": ("permit_number", "PERMIT_NUMBER", "application_number", "APPLICATION_NUMBER"),
    "permit_date": ("permit_date", "PERMIT_DATE", "application_date", "APPLICATION_DATE", "issue_date"),
    "permit_type": ("permit_type_en", "PERMIT_TYPE_EN", "permit_type", "application_type_en"),
    "area_name": ("area_name_en", "AREA_NAME_EN", "area_en", "community_en"), "status": ("status_en", "STATUS_EN", "permit_status_en"),
}


class MissingFields(ValueError):
    """A file lacks fields its register cannot do without."""


def resolve_headers(columns: Sequence[str], fields: FieldMap) -> dict[str, str | None]:
    """Canonical field to the first of its headers the file has."""
    present = set(columns)
    return {k: next((h for h in heads if h in present), None) for k, heads in fields.items()}


def header_coverage(df: DataFrame, fields: FieldMap) -> DataFrame:
    """Which header fed each canonical field, null where the file has none."""
    found = resolve_headers(df.columns, fields)
    return df.sparkSession.createDataFrame(list(found.items()), "field string, header string")


def canonical(df: DataFrame, fields: FieldMap, required: Sequence[str] = ()) -> DataFrame:
    """Rename to canonical fields; absent ones are null; a missing required one is an error."""
    found = resolve_headers(df.columns, fields)
    lacking = [k for k in required if found.get(k) is None]
    if lacking:
        raise MissingFields(f"no header found for {', '.join(lacking)}")
    return df.select(*[(F.col(f"`{h}`") if h else F.lit(None).cast("string")).alias(k) for k, h in found.items()])


def read_register(spark: SparkSession, path: str | list[str], fields: FieldMap, required: Sequence[str] = ()) -> DataFrame:
    """A register CSV, every column as text, under canonical names."""
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return canonical(raw, fields, required)


def repair_csv_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Carriage returns dropped, and a quote not at a field boundary made an apostrophe, line by line."""
    text = F.regexp_replace(column, r"\r", "")
    # Fixed value: a quote with no comma or line edge on either side of it.
    stray = r'(?<!^)(?<!,)"(?![,"]|$)|(?<!^)(?<![,"])"(?!,|$)'
    return lines.withColumn(column, F.regexp_replace(text, stray, "'"))


def read_repaired(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV whose text fields carry stray quotes, repaired and split; ``columns`` is its header."""
    lines = repair_csv_lines(spark.read.text(path))
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    parsed = lines.select(F.from_csv("value", F.lit(schema), {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    return parsed.filter(~F.coalesce(F.col(f"`{columns[0]}`") == columns[0], F.lit(False)))


def read_parts(spark: SparkSession, glob: str) -> DataFrame:
    """All parts of a feed under one glob, files or folders of files, leaving out duplicate downloads named '… (1).csv'."""
    rows = spark.read.csv(glob, header=True, inferSchema=False)
    return rows.filter(~F.col("_metadata.file_path").rlike(r"\(\d+\)\.csv(/[^/]*)?$"))


def prune_rents(rents: DataFrame, columns: Sequence[str], from_year: int = 2024, to_year: int = 2100) -> DataFrame:
    """Only the columns the statistics use and contracts that start within the years."""
    year = F.year(parse_date("contract_start_date"))
    return rents.filter(year.between(from_year, to_year)).select(*columns)


def latest_snapshot(files: DataFrame, min_bytes: int = 1_000) -> DataFrame:
    """The newest dated file by the date in its name (never by its modification time).

    ``files``: path, length, root_rank. Dates are written 2026-09-15 or 20260915; of one date the
    lower root rank wins; files too small to be a download are left out.
    """
    name = F.substring_index("path", "/", -1)
    parts = lambda i: F.regexp_extract(name, r"(\d{4})-?(\d{2})-?(\d{2})", i)
    stamp = F.try_to_date(F.concat_ws("-", parts(1), parts(2), parts(3)))
    dated = files.withColumn("file_date", stamp).filter(F.col("file_date").isNotNull() & (F.col("length") >= min_bytes))
    best = F.max(F.struct("file_date", (-F.col("root_rank")).alias("r"), "path"))
    return dated.agg(best.alias("b")).select("b.path", "b.file_date")


SCAN_SCHEMA = (
    "source STRING, source_id STRING, permit_number STRING, url STRING, area_name_en STRING, project_name_en STRING, building_name_en STRING, "
    "unit_number STRING, rooms_en STRING, area_sqm STRING, is_off_plan STRING, asking_price STRING"
)


def scan_rows(raw: DataFrame, file_path: Column) -> DataFrame:
    """Typed rows of dated listing scans: 'scan-YYYY-MM-DD.csv', or a folder 'scan=YYYY-MM-DD'."""
    return raw.select(
        F.concat_ws(":", "source", "source_id").alias("listing_id"),
        F.regexp_extract(file_path, r"scan[-=](\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("observed_at"),
        F.regexp_replace("asking_price", ",", "").try_cast("double").alias("asking_price"), F.col("area_name_en").alias("area_name"),
        F.col("project_name_en").alias("project_name"), F.col("building_name_en").alias("building_name"), F.col("rooms_en").alias("rooms"),
        F.col("area_sqm").try_cast("double").alias("area_sqm"), F.coalesce("is_off_plan", F.lit("")).rlike("(?i)^(1|true|yes)$").alias("is_off_plan"),
    )


def read_scans(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """Every scan in a folder whose day is not in ``done`` (observed_at)."""
    raw = spark.read.schema(SCAN_SCHEMA).csv(f"{path}/scan*", header=True)
    rows = scan_rows(raw.select("*", F.col("_metadata.file_path").alias("_file")), F.col("_file"))
    return rows if done is None else rows.join(done.select("observed_at").distinct(), "observed_at", "left_anti")


def permit_rows(raw: DataFrame, fields: FieldMap = PERMIT_FIELDS) -> DataFrame:
    """Per row the first non-empty of each field's spellings; the date typed, new buildings flagged."""
    from cadastra.functions.text import is_new_building, norm_area

    def first_stated(heads: Sequence[str]) -> Column:
        held = [F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")) for h in heads if h in raw.columns]
        return F.coalesce(*held) if held else F.lit(None).cast("string")

    rows = raw.select(*[first_stated(heads).alias(k) for k, heads in fields.items()])
    return rows.filter(F.col("permit_number").isNotNull()).select(
        "permit_number", parse_date("permit_date").alias("permit_date"), "permit_type", norm_area("area_name").alias("area_name"), "status",
        is_new_building("permit_type").alias("is_new_building"),
    )


def unknown_headers(columns: Sequence[str], fields: FieldMap) -> list[str]:
    known = {h for heads in fields.values() for h in heads}
    return sorted(c for c in columns if c not in known)


def type_snapshot(raw: DataFrame) -> DataFrame:
    """A register snapshot typed: keys trimmed and required, numbers and dates coerced or null."""
    return raw.select(
        F.trim("PROJECT_NUMBER").alias("project_number"), F.trim("PROJECT_EN").alias("project_name"), F.col("DEVELOPER_EN").alias("developer_name"),
        F.col("PROJECT_STATUS").alias("status"), F.col("PERCENT_COMPLETED").try_cast("double").alias("percent_completed"), F.col("AREA_EN").alias("area_name"),
        parse_date("END_DATE").alias("completion_date"), parse_date("INSPECTION_DATE").alias("observed_at"), F.col("CNT_UNIT").try_cast("int").alias("units"),
    ).filter(F.col("project_number").isNotNull() & (F.col("project_number") != ""))


DOSSIER_SCHEMA = (
    "id STRING, brand STRING, dldDevelopers ARRAY<STRING>, balanceSheetDate STRING, "
    "periods ARRAY<STRUCT<label: STRING, months: INT, revenue: DOUBLE, ebitda: DOUBLE, cash: DOUBLE, escrow: DOUBLE, debt: DOUBLE, equity: DOUBLE, financeCost: DOUBLE>>, "
    "bonds ARRAY<STRUCT<name: STRING, isin: STRING, sizeUsdM: DOUBLE, issued: STRING, listing: STRING, price: STRING, ytm: STRING, note: STRING>>, "
    "maturityWall ARRAY<STRUCT<year: STRING, usdM: DOUBLE, sukukUsdM: DOUBLE>>, "
    "financeCostOnBorrowings STRUCT<aedM: DOUBLE, periodMonths: INT, periodEnd: STRING>"
)


def read_dossiers(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Issuer dossiers, one JSON document per file or one per line; optional blocks become null."""
    return spark.read.schema(DOSSIER_SCHEMA).json(path, multiLine=one_per_file).withColumn("issuer", F.col("id"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Brand groups: one row per member company."""
    raw = spark.read.schema("slug STRING, name STRING, members ARRAY<STRING>, issuer STRING").json(path, multiLine=True)
    return raw.select("slug", "name", "issuer", F.explode("members").alias("developer_number"))


def type_transactions(raw: DataFrame, feed: str) -> DataFrame:
    """Canonical text rows of a sales feed typed and normalised (``feed``: bulk, web or api)."""
    from cadastra.functions import text

    web = feed == "web"
    worth, area = text.parse_number("actual_worth", web), text.parse_number("procedure_area", web)
    when = parse_date("instance_date")
    return raw.filter(F.col("transaction_id").isNotNull()).select(
        "transaction_id", when.alias("instance_date"), (F.lit(None).cast("date") if web else when).alias("feed_date"),
        text.norm_group("trans_group").alias("trans_group"), "procedure_name", text.norm_reg_type("reg_type").alias("reg_type"), "property_type",
        "property_sub_type", "property_usage", text.norm_area("area_name").alias("area_name"), text.blank_to_null("building_name").alias("building_name"),
        text.norm_project_number("project_number").alias("project_number"), text.blank_to_null("project_name").alias("project_name"),
        text.norm_rooms("rooms").alias("rooms"), area.alias("procedure_area"), worth.alias("actual_worth"),
        text.fill_psm(text.parse_number("meter_sale_price"), worth, area, 2 if web else 0).alias("meter_sale_price"),
    )


