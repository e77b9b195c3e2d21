"""Scalar expressions over ledger columns: Column to Column, all inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.tables import name_key

# Vendor ids and payee names that stand for no one.
PLACEHOLDER_VENDORS = ["0" * 20, "MISCPAYVEND"]
PLACEHOLDER_PAYEES = ["UNKNOWN", "NOT AVAILABLE", "CONFIDENTIAL PAYEE", "NAME WITHHELD", "VARIOUS EMPLOYEES", "MISC PAYEE", "REDACTED"]
# Amounts in this range are fillers, both ends included.
SENTINEL_LOW, SENTINEL_HIGH = 99_999_999, 100_000_000
# Lower bounds of the magnitude bands.
BANDS = [("<100K", None), ("100K-250K", 100_000), ("250K-1M", 250_000), ("1M-10M", 1_000_000), ("10M-100M", 10_000_000), (">=100M", 100_000_000)]


def nz(c: Column) -> Column:
    """The trimmed value; null for a blank and for the literal NULL.  Only spaces are trimmed."""
    return F.nullif(F.nullif(F.trim(c), F.lit("NULL")), F.lit(""))


def is_sentinel(amount: Column) -> Column:
    return F.abs(amount).between(SENTINEL_LOW, SENTINEL_HIGH)


def real_vendor(vendor: Column) -> Column:
    """The vendor id if it stands for someone, else null."""
    return F.when(vendor.isNotNull() & ~vendor.isin(PLACEHOLDER_VENDORS), vendor)


def period_number(period: Column) -> Column:
    """The whole part of a fiscal period such as ``13.0``; null if that is no number."""
    return F.split_part(F.coalesce(period, F.lit("")), F.lit("."), F.lit(1)).try_cast("int")


def whole_code(code: Column) -> Column:
    """A code without a trailing ``.0``; null for a blank."""
    return F.nullif(F.regexp_replace(F.trim(code), r"\.0+$", ""), F.lit(""))


def magnitude_band(amount: Column) -> Column:
    out = F.when(amount.isNull(), F.lit(None).cast("string"))
    for name, low in reversed(BANDS[1:]):
        out = out.when(amount >= low, F.lit(name))
    return out.otherwise(F.lit(BANDS[0][0]))


def is_multiple(amount: Column, unit: int) -> Column:
    """A positive amount that is a whole multiple of ``unit``."""
    return (amount >= unit) & (amount % unit == 0)


def leading_digit(amount: Column) -> Column:
    """First digit of the decimal text without its point; amounts below one give 0."""
    return F.substring(F.replace(amount.cast("string"), F.lit("."), F.lit("")), 1, 1)


def second_digit(amount: Column) -> Column:
    return F.nullif(F.substring(F.floor(amount).cast("string"), 2, 1), F.lit(""))


def unattributed_bucket(payee: Column) -> Column:
    """How a payment hides its payee: blank, na, redacted, confidential or named, the first that holds."""
    upper = F.upper(F.trim(F.coalesce(payee, F.lit(""))))
    return (
        F.when(upper == "", "blank")
        .when(upper.isin("NOT AVAILABLE", "N/A", "NA", "UNKNOWN"), "na")
        .when(upper.contains("REDACT") | upper.contains("WITHHELD"), "redacted")
        .when(upper.contains("CONFIDENTIAL"), "confidential")
        .otherwise("named")
    )


def core_tokens(name: Column, dropped: list[str]) -> Column:
    """The words of a name in order: upper case, ``&`` as AND, punctuation as space, dropped words and single letters out."""
    text = F.regexp_replace(F.replace(F.upper(name), F.lit("&"), F.lit(" AND ")), r"[.,/()\-'\"#]", " ")
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(dropped))


def agency_form(name: Column) -> Column:
    """An agency's name for comparison: DEPARTMENT as DEPT, ``&`` as AND, other signs as space, spaces collapsed."""
    text = F.replace(F.replace(F.upper(name), F.lit("DEPARTMENT"), F.lit("DEPT")), F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N} ]", " "), r"\s+", " "))


def sorted_word_key(name: Column, dropped: list[str]) -> Column:
    """The distinct words of a name without boilerplate and single letters, sorted and joined."""
    words = F.filter(F.split(agency_form(name), " "), lambda w: (F.length(w) > 1) & ~w.isin(dropped))
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def normalize_entity_key(text: str) -> str:
    """``name_key`` for one Python string."""
    return re.sub(r"\s+", " ", text, flags=re.ASCII).strip(" ").upper()


def entity_key(payee: Column) -> Column:
    """The name key of a payee; null for null and blank payees."""
    return F.nullif(name_key(payee), F.lit(""))


def report_parts(stem: Column) -> dict[str, Column]:
    """Of a report's file stem such as ``22-101_Report``: id, fiscal year, number and kind."""
    number = F.regexp_extract(stem, r"\b(\d{2})-(CR|[0-9])?(\d+)", 0)
    year = F.nullif(F.regexp_extract(stem, r"\b(\d{2})-", 1), F.lit(""))
    rest = F.regexp_extract(stem, r"\b\d{2}-([A-Z0-9]+)", 1)
    kind = F.when(rest.startswith("CR"), "compliance").when(rest.startswith("3"), "special").when(rest.startswith("2"), "single").otherwise("performance")
    return {"report_id": F.nullif(number, F.lit("")), "fiscal_year": (F.lit(2000) + year.try_cast("int")).cast("int"), "report_no": F.nullif(rest, F.lit("")), "report_kind": kind}
