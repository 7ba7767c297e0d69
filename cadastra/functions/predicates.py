"""The row predicates the statistics rest on, with their thresholds as parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The register's own vocabulary.
SALES, MORTGAGES, GIFTS = "Sales", "Mortgages", "Gifts"
OFF_PLAN, READY = "Off-Plan Properties", "Existing Properties"
SELL, PRE_REGISTRATION, DELAYED_SELL = "Sell", "Sell - Pre registration", "Delayed Sell"
PAYMENT_PLAN = "Sale On Payment Plan"
DEVELOPER_PROCEDURES = (PRE_REGISTRATION, DELAYED_SELL, PAYMENT_PLAN)
LIVE_STATUSES = ("ACTIVE", "PENDING", "NOT_STARTED", "CONDITIONAL_ACTIVATING")
BUILDING_STATUSES = ("ACTIVE", "NOT_STARTED", "PENDING")
HOME_RENT_TYPES = ("Flat", "Villa", "Studio", "Complex Villas")
SOURCE_RANK = {"gateway": 0, "register-extract": 1}


@dataclass(frozen=True)
class Limits:
    """Sanity limits; defaults are the register's own, stand-in data pass theirs."""

    psm_min: float = 500.0
    psm_max: float = 200_000.0
    luxury: float = 10_000_000.0
    land_max_sqm: float = 3_000.0
    rent_min: float = 1_000.0
    rent_max: float = 50_000_000.0
    home_rent_min: float = 5_000.0
    home_rent_max: float = 5_000_000.0
    rent_psm_max: float = 20_000.0
    rent_area_min: float = 20.0
    rent_area_max: float = 2_000.0


DEFAULT_LIMITS = Limits()


def is_sale() -> Column:
    return F.col("trans_group") == SALES


def is_off_plan() -> Column:
    return F.col("reg_type") == OFF_PLAN


def is_ready() -> Column:
    return F.col("reg_type") == READY


def is_unit() -> Column:
    return F.col("property_type") == "Unit"


def is_villa() -> Column:
    return F.col("property_type") == "Villa"


def is_home(limits: Limits = DEFAULT_LIMITS) -> Column:
    """A unit, a villa, or land small enough to be a villa registered against its plot."""
    return F.col("property_type").isin("Unit", "Villa") | (
        (F.col("property_type") == "Land")
        & (F.coalesce(F.col("procedure_area"), F.lit(0.0)) <= limits.land_max_sqm)
    )


def is_developer_sale() -> Column:
    return F.col("procedure_name").isin(*DEVELOPER_PROCEDURES)


def psm_ok(limits: Limits = DEFAULT_LIMITS) -> Column:
    return F.col("meter_sale_price").between(limits.psm_min, limits.psm_max)


def rooms_stated(c: str = "rooms") -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def rooms_classified(c: str = "rooms") -> Column:
    return F.col(c).isNotNull() & ~F.col(c).isin("", "NA")


def rent_ok(limits: Limits = DEFAULT_LIMITS) -> Column:
    return F.col("annual_amount").between(limits.rent_min, limits.rent_max)


def home_rent(limits: Limits = DEFAULT_LIMITS) -> Column:
    return F.col("rent_property_type").isin(*HOME_RENT_TYPES) & F.col("annual_amount").between(
        limits.home_rent_min, limits.home_rent_max
    )


def rent_area_ok(limits: Limits = DEFAULT_LIMITS) -> Column:
    return F.col("actual_area").between(limits.rent_area_min, limits.rent_area_max)


def rent_psm_ok(limits: Limits = DEFAULT_LIMITS) -> Column:
    return (F.col("actual_area") > 10) & (
        F.col("annual_amount") / F.nullif(F.col("actual_area"), F.lit(0.0)) < limits.rent_psm_max
    )


def is_new_rent() -> Column:
    return F.col("contract_reg_type").ilike("new%")


def is_renewal() -> Column:
    return F.col("contract_reg_type").ilike("renew%")


def present_at(first_seen: Column, withdrawn_on: Column, on: Column) -> Column:
    """Held by the register on a date: a row without a vintage always counts as present."""
    return (first_seen.isNull() | (first_seen <= on)) & (withdrawn_on.isNull() | (withdrawn_on > on))


def re_registration(change: Column, hold_days: Column) -> Column:
    """Same price inside 60 days: a correction or assignment, not a resale. ``change`` is a fraction."""
    return (F.abs(change) < 0.0001) & (hold_days < 60)
