"""Typed ingest of the registers' feeds: projects, readings, rents, service charges, with what was refused beside it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.sources import readers

# How a field's text becomes its value; what does not convert is null.
CONVERSIONS: Mapping[str, Callable[[Column], Column]] = {
    "text": text.blank_to_null,
    "key": text.norm_project_number,
    "number": text.parse_number,
    "whole": lambda c: text.parse_number(c).cast("bigint"),
    "date": text.parse_date,
    "area": lambda c: text.norm_area(text.blank_to_null(c)),
    "rooms": lambda c: text.norm_rooms(text.blank_to_null(c)),
}
CHECKED = ("number", "whole", "date")  # kinds whose stated values may fail to convert


@dataclass(frozen=True)
class Feed:
    """A feed's fields with the headers they come under, how each converts (text unless said), and which no row can lack."""

    name: str
    fields: readers.FieldMap
    kinds: Mapping[str, str]
    required: tuple[str, ...]


# Headers of the feeds that the readers do not name already.
READING_FIELDS: readers.FieldMap = {
    "project_number": ("PROJECT_NUMBER", "project_number"), "status": ("PROJECT_STATUS", "project_status"), "percent_completed": ("PERCENT_COMPLETED", "percent_completed"),
    "inspected": ("INSPECTION_DATE", "inspection_date"), "completion_date": ("COMPLETION_DATE", "completion_date"), "planned_end_date": ("END_DATE", "project_end_date"),
    "load_timestamp": ("load_timestamp", "LOAD_TIMESTAMP"), "units": ("CNT_UNIT", "no_of_units"), "villas": ("CNT_VILLA", "no_of_villas"), "lands": ("CNT_LAND", "no_of_lands"),
}
CHARGE_FIELDS: readers.FieldMap = {
    "budget_year": ("BUDGET_YEAR", "budget_year"), "project_id": ("PROJECT_ID", "project_id"), "project_name": ("PROJECT_NAME", "project_name"),
    "master_community": ("MASTER_COMMUNITY_NAME_EN", "master_community_name_en"), "management_company": ("MANAGEMENT_COMPANY_NAME_EN", "management_company_name_en"),
    "property_group": ("PROPERTY_GROUP_NAME_EN", "property_group_name_en"), "category": ("SERVICE_CATEGORY_NAME_EN", "service_category_name_en"), "usage": ("USAGE_NAME_EN", "usage_name_en"),
    "cost": ("SERVICE_COST", "service_cost"),
}
_COUNTS = {c: "whole" for c in ("units", "villas", "lands", "buildings")}
PROJECTS = Feed("projects", readers.PROJECT_FIELDS, {
    "project_number": "key", "area_name": "area", "developer_number": "key", "cancellation_date": "date", "project_start_date": "date", "planned_end_date": "date",
    "completion_date": "date", "percent_completed": "number", "project_value": "number", **_COUNTS}, ("project_number",))
READINGS = Feed("readings", READING_FIELDS, {
    "project_number": "key", "percent_completed": "number", "inspected": "date", "completion_date": "date", "planned_end_date": "date", **_COUNTS}, ("project_number",))
RENTS = Feed("rents", readers.RENT_FIELDS, {
    "contract_start_date": "date", "annual_amount": "number", "area_name": "area", "project_number": "key", "rooms": "rooms", "actual_area": "number"}, ("contract_id",))
CHARGES = Feed("service_charges", CHARGE_FIELDS, {"budget_year": "whole", "cost": "number"}, ("project_id",))


def type_feed(raw: DataFrame, feed: Feed) -> tuple[DataFrame, DataFrame]:
    """The feed's rows in their types, and its rejects: feed, field, value, dropped.

    A value that is stated and does not convert is listed with its field and becomes null. A row that lacks a required
    field is listed as dropped and left out. A file without the header of a required field is an error.
    """
    given = readers.canonical(raw, feed.fields, feed.required)
    stated = {c: text.blank_to_null(c) for c in feed.fields}
    typed = {c: CONVERSIONS[feed.kinds.get(c, "text")](F.col(f"`{c}`")) for c in feed.fields}
    complete = F.lit(True)
    for c in feed.required:
        complete = complete & typed[c].isNotNull()
    problems = F.array_compact(F.array(*[
        F.when(typed[c].isNull() & (stated[c].isNotNull() | F.lit(c in feed.required)), F.struct(F.lit(c).alias("field"), stated[c].alias("value"), F.lit(c in feed.required).alias("dropped")))
        for c in feed.fields if c in feed.required or feed.kinds.get(c, "text") in CHECKED]))
    rejects = given.select(F.explode(problems).alias("_p")).select(F.lit(feed.name).alias("feed"), "_p.field", "_p.value", "_p.dropped")
    return given.filter(complete).select(*[typed[c].alias(c) for c in feed.fields]), rejects


def project_register(rows: DataFrame) -> DataFrame:
    """Typed project rows as the register keeps them: named, slugged, one area each; slugs apart within an area."""
    from cadastra.operators.identity import disambiguate_slug

    name = F.coalesce(F.trim("project_name"), F.col("project_number"))
    area = F.coalesce(F.nullif(text.slugify("area_name"), F.lit("")), F.lit("unknown"))
    named = rows.withColumns({
        "project_name": name, "slug": F.coalesce(F.nullif(text.slugify(name), F.lit("")), F.col("project_number")), "area_slug": area,
        "completion_date": text.completion("completion_date", "planned_end_date")})
    return disambiguate_slug(named, "area_slug", "slug", "project_number")


def new_project_units(rows: DataFrame) -> DataFrame:
    """Counts of projects that one feed alone knows: those of finished projects arrive doubled and stay blank."""
    return rows.withColumns({c: text.safe_units(c, "status") for c in ("units", "villas", "lands")})


READING = ("project_number", "observed_at", "status", "percent_completed", "completion_date", "source")


def load_readings(rows: DataFrame, as_of: str, content_dates: Mapping[str, str] | None = None, source: str = "dld") -> DataFrame:
    """Readings of a register load (project rows), dated by when its content was read from the register."""
    return rows.select(
        "project_number", text.observation_date("load_timestamp", content_dates or {}, as_of).alias("observed_at"), F.col("project_status").alias("status"),
        "percent_completed", text.completion("completion_date", "planned_end_date").alias("completion_date"), F.lit(source).alias("source"))


def gateway_readings(rows: DataFrame, as_of: str, source: str = "gateway") -> DataFrame:
    """Readings of the gateway, dated by inspection or else by the run (``undated``); above 100 is a sum of buildings and no percentage."""
    return rows.select(
        "project_number", text.reading_date("inspected", "percent_completed", "gateway", as_of).alias("observed_at"), "status",
        text.percent_policy("percent_completed", "null_above").alias("percent_completed"), text.completion("completion_date", "planned_end_date").alias("completion_date"),
        F.lit(source).alias("source"), F.col("inspected").isNull().alias("undated"), F.coalesce(F.col("percent_completed") > 100, F.lit(False)).alias("above"))


def workbook_readings(rows: DataFrame, file_date: str, source: str = "register-extract") -> tuple[DataFrame, DataFrame]:
    """Readings of an extract, and its rows left out: a percentage without an inspection date is no dated reading.

    A percentage outside 0..100 is held out of the reading it comes with.
    """
    dated = rows.withColumn("observed_at", text.reading_date("inspected", "percent_completed", "workbook", file_date)).withColumn("source", F.lit(source))
    dated = dated.withColumn("completion_date", text.completion("completion_date", "planned_end_date"))
    held = dated.filter(F.col("observed_at").isNotNull()).withColumn("percent_completed", text.percent_policy("percent_completed", "hold_out"))
    return held.select(*READING), dated.filter(F.col("observed_at").isNull()).select(*rows.columns)


def backfill_first_seen(rows: DataFrame, stored_id: str = "transaction_id", column: str = "first_seen") -> DataFrame:
    """A missing first-seen day is read from the run date that the stored id carries."""
    return rows.withColumn(column, F.coalesce(F.col(column), text.first_seen_from_id(stored_id)))
