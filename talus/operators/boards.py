"""Boards over budget, spending and audits, and what else audit texts say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.audit import lines_of

#: What a letter behind an amount multiplies it by.
UNITS = {"K": 1e3, "M": 1e6, "B": 1e9}
AMOUNT = r"\$[0-9]+(?:\.[0-9]+)?[kKmMbB]?"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def stated_dollars(text: Column) -> Column:
    """The sum of the amounts in a text such as ``$595k; $57M``; 0 for texts without any and for null."""
    def value(m: Column) -> Column:
        unit = F.upper(F.right(m, F.lit(1)))
        factor = F.lit(1.0)
        for letter, x in UNITS.items():
            factor = F.when(unit == letter, F.lit(x)).otherwise(factor)
        return F.regexp_extract(m, r"[0-9]+(?:\.[0-9]+)?", 0).cast("double") * factor

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AMOUNT), F.lit(0))
    return F.aggregate(found, F.lit(0.0), lambda total, m: total + value(m))


def questioned_by_agency(xref: DataFrame, cites: DataFrame, reports: DataFrame) -> DataFrame:
    """(agency, n_xrefs, n_adverse, questioned): cross-references by the agencies of the reports that they cite, each once per agency.

    ``cites`` has xref_id and report.  Adverse is a relationship of contradiction,
    whatever its case.  Reports without an agency and citations of no report are left out.
    """
    at = cites.join(reports.where("agency_checkbook is not null").select(F.col("report_id").alias("report"), F.col("agency_checkbook").alias("agency")), "report").select("xref_id", "agency").distinct()
    rows = at.join(xref.select("xref_id", stated_dollars(F.col("ag_dollar")).alias("usd"), (F.upper(F.trim("relationship")) == "CONTRADICTS").alias("adverse")), "xref_id")
    out = rows.groupBy("agency").agg(F.count(F.lit(1)).alias("n_xrefs"), F.count(F.when(F.col("adverse"), 1)).alias("n_adverse"), F.round(F.sum("usd"), 2).alias("questioned"))
    return out


def fund_sources(lines: DataFrame, by: str, sources: dict[str, str]) -> DataFrame:
    """(by, source, amount, pct): the named money columns of the lines summed per source, with each one's share of the group; nulls count as nothing."""
    sums = lines.groupBy(by).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in sources.values()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.col(c).alias("amount")) for n, c in sources.items()]))
    total = sum((F.col(c) for c in sources.values()), F.lit(0.0))
    out = sums.select(by, total.alias("_t"), pairs.alias("p")).select(by, "p.source", "p.amount", "_t")
    return out.select(by, "source", F.round("amount", 2).alias("amount"), F.round(100 * F.col("amount") / F.nullif(F.col("_t"), F.lit(0.0)), 4).alias("pct"))


def year_over_year(rows: DataFrame, by: str, amount: str) -> DataFrame:
    """(by, fiscal_year, usd, previous, change, pct): each year against the previous calendar year of the group; nulls where there is none."""
    years = rows.where(F.col(by).isNotNull()).groupBy(by, "fiscal_year").agg(F.round(F.sum(amount).cast("double"), 2).alias("usd"))
    before = years.select(by, (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("usd").alias("previous"))
    out = years.join(before, [by, "fiscal_year"], "left").withColumn("change", F.round(F.col("usd") - F.col("previous"), 2))
    return out.withColumn("pct", F.round(100 * F.col("change") / F.nullif(F.col("previous"), F.lit(0.0)), 4))


def above_quantile(groups: DataFrame, measure: str, point: float) -> DataFrame:
    """The groups whose measure exceeds the exact quantile of all groups' measures, with the quantile as ``threshold``."""
    limit = groups.agg(F.percentile(measure, F.lit(point)).alias("threshold"))
    return groups.crossJoin(F.broadcast(limit)).where(F.col(measure) > F.col("threshold"))  # one row of the threshold


def recommendations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, finding_no): the lines that begin with ``Recommendation`` and the number of the last ``Finding N`` line before them in the text, null if none.

    Within each row's own lines, without a shuffle.
    """
    lines = F.transform(lines_of(F.col(text)), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    heads = F.filter("_lines", lambda x: x.line.rlike(r"^Finding [0-9]+\b"))
    rows = df.select(F.col(key), lines.alias("_lines")).select(key, "_lines", heads.alias("_heads"))
    rows = rows.select(key, "_heads", F.explode(F.filter("_lines", lambda x: x.line.startswith("Recommendation"))).alias("r"))
    before = F.filter("_heads", lambda x: x.pos < F.col("r.pos"))
    number = F.regexp_extract(F.try_element_at(before, F.lit(-1)).line, r"^Finding ([0-9]+)", 1).try_cast("int")
    return rows.select(key, "r.pos", "r.line", number.alias("finding_no"))


def keyed_patterns(df: DataFrame, key: str, text: str, patterns: dict[str, str], most: int = 10) -> DataFrame:
    """(key, n_<name>, <name>) for each named pattern: how often it occurs and its first ``most`` matches, joined by bars; texts with no match are left out."""
    found = {n: F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(0)) for n, p in patterns.items()}
    rows = df.select(key, *[f.alias(f"_{n}") for n, f in found.items()])
    counts = [c for n in patterns for c in (F.size(f"_{n}").cast("long").alias(f"n_{n}"), F.array_join(F.slice(f"_{n}", 1, most), "|").alias(n))]
    return rows.select(key, *counts).where(" or ".join(f"n_{n} > 0" for n in patterns))


def report_heads(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, agency, date_text): a report page's first non-blank line, the first body it names and the first date written out; nulls where there is none."""
    t = F.coalesce(F.col(text), F.lit(""))
    title = F.try_element_at(F.filter(F.transform(lines_of(F.col(text)), lambda x: F.trim(x)), lambda x: F.length(x) > 0), F.lit(1))
    agency = F.regexp_extract(t, r"(?:Department|Dept|Board|Office|Commission) (?:Of|On|of|on) [A-Z][a-z]+(?: (?:And|and|[A-Z][a-z]+))*", 0)
    date = F.regexp_extract(t, rf"(?:{MONTHS}) (?:[0-9]{{1,2}}, )?[0-9]{{4}}", 0)
    return df.select(key, title.alias("title"), F.nullif(agency, F.lit("")).alias("agency"), F.nullif(date, F.lit("")).alias("date_text"))


def merge_overrides(base: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """``base`` with the values that ``overrides`` states for its keys; a null there leaves what is, and keys that base lacks are left out.  Of repeated overrides the greatest value of a column counts."""
    columns = [c for c in overrides.columns if c != key and c in base.columns]
    said = overrides.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    return base.join(said, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])
