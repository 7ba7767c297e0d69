"""Normalisation of names, numbers, dates and identifiers arriving as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastra.functions.numbers import as_col, day

# The leading digit of a four-part registration number names its group.
GROUP_BY_LEAD = {"1": "Sales", "2": "Mortgages", "3": "Gifts"}


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def norm_area(c: Column | str) -> Column:
    """Title case at word boundaries; blank becomes 'Unknown'."""
    words = F.split(F.lower(F.trim(as_col(c))), r"(?<![a-z0-9_])(?=[a-z])")
    capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    titled = F.array_join(capital, "")
    return F.coalesce(F.nullif(titled, F.lit("")), F.lit("Unknown"))


def norm_project_number(c: Column | str) -> Column:
    """'1740.00' and '1740' are one project; anything not numeric is kept trimmed."""
    text = blank_to_null(c)
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)


def norm_rooms(c: Column | str) -> Column:
    """'2 bed rooms+hall' -> '2 B/R'; studio and penthouse spelled one way; NA -> null."""
    text = blank_to_null(c)
    beds = F.regexp_extract(text, r"(?i)^(\d+)\s*(?:bed|B/?R)", 1)
    return (
        F.when(text.isin("NA"), None)
        .when(beds != "", F.concat(beds, F.lit(" B/R")))
        .when(text.rlike(r"(?i)^studio") | (text == "0"), F.lit("Studio"))
        .when(text.rlike(r"(?i)^penthouse"), F.lit("PENTHOUSE"))
        .otherwise(text)
    )


def parse_number(c: Column | str, zero_is_null: bool = False) -> Column:
    """A number that may carry thousands commas; one feed writes 0 for unknown."""
    value = F.regexp_replace(as_col(c).cast("string"), ",", "").try_cast("double")
    return F.nullif(value, F.lit(0.0)) if zero_is_null else value


def parse_date(c: Column | str) -> Column:
    """ISO prefix, DD-MM-YYYY, DD/MM/YYYY, or a spreadsheet day serial; otherwise null."""
    text = F.trim(as_col(c).cast("string"))
    serial = F.when(text.rlike(r"^\d{5}(\.\d+)?$"), text).try_cast("double").cast("int")
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)).try_cast("date"),
        F.try_to_date(F.when(text.rlike(r"^\d{2}-\d{2}-\d{4}"), F.substring(text, 1, 10)), "dd-MM-yyyy"),
        F.try_to_date(F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}"), F.substring(text, 1, 10)), "dd/MM/yyyy"),
        F.date_add(F.lit("1899-12-30").cast("date"), serial),
    )


# Latin letters with marks, and the plain letters they decompose to.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def slugify(c: Column | str) -> Column:
    """Lower case, marks dropped, every other run of characters becomes one dash."""
    plain = F.translate(F.lower(as_col(c)), _MARKED, _PLAIN)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def area_slug(c: Column | str) -> Column:
    """The page address rule for areas, which differs from slugify on runs of marks."""
    out = F.lower(as_col(c))
    for old, new in ((" ", "-"), ("'", "-"), (".", "-"), ("--", "-")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def norm_reg_type(c: Column | str) -> Column:
    text = blank_to_null(c)
    return F.when(text.rlike("(?i)off"), F.lit("Off-Plan Properties")).when(
        text.isNotNull(), F.lit("Existing Properties")
    )


def norm_group(c: Column | str) -> Column:
    text = blank_to_null(c)
    return (
        F.when(text.ilike("mortgage%"), F.lit("Mortgages")).when(text.ilike("gift%"), F.lit("Gifts")).otherwise(text)
    )


def fill_psm(psm: Column | str, worth: Column | str, area: Column | str, dp: int = 0) -> Column:
    """The feed's own price per sqm, else worth over area."""
    from cadastra.functions.numbers import half_up, ratio

    return F.coalesce(as_col(psm), half_up(ratio(worth, area), dp))


def tx_number(stored_id: Column | str) -> Column:
    """The registration number inside a stored id: 'w#number#n', 'number#suffix' or plain."""
    text = F.trim(F.coalesce(as_col(stored_id), F.lit("")))
    return F.substring_index(F.regexp_replace(text, "^w#", ""), "#", 1)


# The two shapes of a registration number.
FOUR_PART = r"^([^-]*)-([^-]+)-(\d{4})-([^-]+)$"
THREE_PART = r"^([^-]+)-([^-]+)-(\d{4})$"


def tx_key(stored_id: Column | str, group: Column | str | None = None) -> Column:
    """Canonical 'procedure|year|serial|group', or null for a number of no known shape."""
    number = tx_number(stored_id)
    four = number.rlike(FOUR_PART)
    body = F.when(four, F.regexp_replace(number, FOUR_PART, "$2|$3|$4")).when(
        number.rlike(THREE_PART), F.regexp_replace(number, THREE_PART, "$1|$3|$2"))
    lead = F.when(four, F.substring_index(number, "-", 1))
    by_lead = F.lit(None).cast("string")
    for digit, name in GROUP_BY_LEAD.items():
        by_lead = F.when(lead == digit, F.lit(name)).otherwise(by_lead)
    resolved = by_lead if group is None else F.coalesce(blank_to_null(group), by_lead)
    # concat gives null as soon as the shape or the group is unknown.
    return F.concat(body, F.lit("|"), resolved)


def feed_of(stored_id: Column | str) -> Column:
    """Which feed wrote a stored id: 'web', 'api' or 'bulk'."""
    c = as_col(stored_id)
    return F.when(c.startswith("w#"), F.lit("web")).when(c.contains("#a2"), F.lit("api")).otherwise(F.lit("bulk"))


def first_seen_from_id(stored_id: Column | str) -> Column:
    """The run date carried in an '…#aYYYYMMDD…' id."""
    return F.try_to_date(F.nullif(F.regexp_extract(as_col(stored_id), r"#a(\d{8})", 1), F.lit("")), "yyyyMMdd")


def observation_date(load_stamp: Column | str, overrides: Mapping[str, str], as_of) -> Column:
    """The content date known for a load stamp, else the stamp's own day, else the as-of date."""
    stamp = F.substring(as_col(load_stamp), 1, 10)
    known = F.lit(None).cast("date")
    for key, value in overrides.items():
        known = F.when(stamp == key, day(value)).otherwise(known)
    return F.coalesce(known, stamp.try_cast("date"), day(as_of))


def completion(actual: Column | str, planned: Column | str) -> Column:
    """When a project completes: the day it did, else the planned end, which is what slips."""
    return F.coalesce(as_col(actual), as_col(planned))


def reading_date(inspected: Column | str, percent: Column | str, policy: str, as_of) -> Column:
    """Readings are dated by inspection. Without one: a workbook row that carries a percentage
    has no date (and is skipped by the caller), a gateway row takes the as-of date."""
    inspected = as_col(inspected)
    if policy == "gateway":
        return F.coalesce(inspected, day(as_of))
    if policy == "workbook":
        return F.coalesce(inspected, F.when(as_col(percent).isNull(), day(as_of)))
    raise ValueError(policy)


def percent_policy(c: Column | str, mode: str) -> Column:
    """What a percentage outside 0..100 means: not a reading, a full one, or held out."""
    c = as_col(c)
    if mode == "null_above":
        return F.when(c <= 100, c)
    if mode == "cap":
        return F.when(c.isNotNull(), F.least(c, F.lit(100.0)))
    if mode == "hold_out":
        return F.when(c.between(0, 100), c)
    raise ValueError(mode)


def safe_units(units: Column | str, status: Column | str) -> Column:
    """Unit counts of finished projects arrive doubled from one feed: leave them blank."""
    return F.when(F.upper(F.coalesce(as_col(status), F.lit(""))) == "FINISHED", None).otherwise(as_col(units))


def is_new_building(permit_type: Column | str) -> Column:
    """A permit for a new building, not for works on one that stands."""
    c = F.coalesce(as_col(permit_type), F.lit(""))
    # The two patterns that tell the kinds apart.
    return c.rlike(r"(?i)new\s*build|new\s*construction|building\s*permit\b") & ~c.rlike(
        r"(?i)modif|renov|addition|demol|decor|maintenance|fit\s*out"
    )


def home_capacity(units: str = "units", villas: str = "villas", lands: str = "lands") -> Column:
    """Homes a project can hold: units and villas, or its plots where it has neither."""
    u, v, p = (F.coalesce(F.col(c), F.lit(0)) for c in (units, villas, lands))
    return F.when(u + v > 0, u + v).when(p > 0, p)


def capacity_basis(units: str = "units", villas: str = "villas", lands: str = "lands") -> Column:
    u, v, p = (F.coalesce(F.col(c), F.lit(0)) for c in (units, villas, lands))
    return (
        F.when((u > 0) & (v > 0), F.lit("units+villas"))
        .when(u > 0, F.lit("units"))
        .when(v > 0, F.lit("villas"))
        .when(p > 0, F.lit("plots"))
        .otherwise(F.lit(""))
    )


def rooms_or_default(rooms: Column | str, property_type: Column | str | None = None, default: str | None = "Unclassified") -> Column:
    fallback = F.lit(default)
    if property_type is not None:
        fallback = F.when(as_col(property_type) == "Studio", F.lit("Studio")).otherwise(fallback)
    return F.coalesce(F.nullif(as_col(rooms), F.lit("")), fallback)


def first_contains(c: Column | str, keywords: Sequence[tuple[str, str]]) -> Column:
    """The label of the first keyword the text contains, else the text itself."""
    text = F.coalesce(as_col(c), F.lit(""))
    if not keywords:
        return text
    out = None
    for needle, label in keywords:
        hit = text.contains(needle)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(text)


def status_label(c: Column | str) -> Column:
    """The display wording of a register status."""
    # Published wordings.
    wording = {
        "ACTIVE": "Under construction",
        "NOT_STARTED": "Not started",
        "PENDING": "Pending",
        "PENDING_COMING_SOON": "Coming soon",
        "CONDITIONAL_ACTIVATING": "Conditionally activating",
        "FINISHED": "Completed",
        "CANCELLED": "Cancelled",
        "ON HOLD": "On hold",
    }
    table = F.create_map(*[F.lit(x) for pair in wording.items() for x in pair])
    return F.coalesce(F.try_element_at(table, as_col(c)), as_col(c))
