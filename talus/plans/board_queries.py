"""Boards over budget, spending and audits, each with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions import cleaning as X
from talus.operators import boards as B
from talus.operators import screens as S
from talus.operators.orphans import cited_reports
from talus.plans import audit_queries as A
from talus.plans import ledger_queries as L
from talus.plans.problems import _CITES_SQL
from talus.plans.scored_queries import _KEY, TX, scored
from talus.sources.ledger import CLEAN_SQL, expenditure
from talus.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _lines(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "fy2026_jlbc_structured").where("agency is not null").withColumn("agency_form", X.agency_form(F.col("agency"))).where("agency_form != ''")
    return rows.withColumn("line_total", A._line_total())


_LINES = f"lines AS (SELECT *, {A._FORM_SQL.format(c='agency')} AS agency_form, {A._TOTAL_SQL} AS line_total FROM fy2026_jlbc_structured WHERE agency IS NOT NULL)"


def _line_items(s: SparkSession, d: str) -> DataFrame:
    """Budget lines with their share of the agency form's budget."""
    share = F.round(100 * F.col("line_total") / F.nullif(F.sum("line_total").over(Window.partitionBy("agency_form")), F.lit(0.0)), 4)
    return _lines(s, d).select("agency_form", "line_id", "note", F.round("line_total", 2).alias("total"), share.alias("pct"))


_add("budget_line_items", _line_items, f"WITH {_LINES} SELECT agency_form, line_id, note, round(line_total, 2) AS total, round(100 * line_total / nullif(sum(line_total) OVER (PARTITION BY agency_form), 0), 4) AS pct FROM lines WHERE agency_form <> ''")

# The money columns of a budget line.
SOURCES = {"general fund": "general_fund_ongoing", "other funds": "other_funds", "one time": "one_time"}
_SUMS = ", ".join(f"sum(coalesce({c}, 0)) AS {c}" for c in SOURCES.values())
_ALL = " + ".join(SOURCES.values())
_FUND_SQL = " UNION ALL ".join(f"SELECT agency_form, '{n}' AS source, round({c}, 2) AS amount, round(100 * {c} / nullif({_ALL}, 0), 4) AS pct FROM g" for n, c in SOURCES.items())
_add("budget_fund_sources", lambda s, d: B.fund_sources(_lines(s, d), "agency_form", SOURCES), f"WITH {_LINES}, g AS (SELECT agency_form, {_SUMS} FROM lines WHERE agency_form <> '' GROUP BY 1) {_FUND_SQL}")
_add(
    "general_fund_dependence",
    lambda s, d: A.budgets(s, d).where("general_fund_pct is not null").orderBy(F.desc("general_fund_pct"), F.desc("budget"), "agency_form").limit(25).select("agency_form", "budget", "general_fund_pct"),
    f"SELECT agency_form, budget, general_fund_pct FROM ({A._BUDGETS}) WHERE general_fund_pct IS NOT NULL ORDER BY general_fund_pct DESC, budget DESC, agency_form LIMIT 25",
)
_YEARS = "y AS (SELECT agency, fiscal_year, round(CAST(sum(amount) AS DOUBLE), 2) AS usd FROM clean WHERE agency IS NOT NULL GROUP BY ALL)"
_add(
    "spend_year_over_year",
    lambda s, d: B.year_over_year(expenditure(s, d), "agency", "amount"),
    f"WITH {CLEAN_SQL}, {_YEARS} SELECT y.agency, y.fiscal_year, y.usd, p.usd AS previous, round(y.usd - p.usd, 2) AS change, round(100 * round(y.usd - p.usd, 2) / nullif(p.usd, 0), 4) AS pct FROM y LEFT JOIN y p ON p.agency = y.agency AND p.fiscal_year = y.fiscal_year - 1",
)


def _questioned(s: SparkSession, d: str) -> DataFrame:
    xref = table(s, d, "ag_findings_xref")
    cites = xref.select("xref_id", F.explode(cited_reports(F.col("ag_finding"))).alias("report"))
    return B.questioned_by_agency(xref, cites, table(s, d, "ag_reports"))


_DOLLARS = rf"coalesce(list_sum(list_transform(regexp_extract_all(ag_dollar, '{B.AMOUNT}'), lambda m: CAST(regexp_extract(m, '[0-9]+(?:\.[0-9]+)?') AS DOUBLE) * CASE upper(right(m, 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END)), 0)"
_QUESTIONED = f"""WITH {_CITES_SQL}, held AS (SELECT DISTINCT c.xref_id, r.agency_checkbook AS agency FROM cites c JOIN ag_reports r ON r.report_id = c.report WHERE ok AND r.agency_checkbook IS NOT NULL)
    SELECT agency, count(*) AS n_xrefs, count(*) FILTER (WHERE upper(trim(relationship)) = 'CONTRADICTS') AS n_adverse, round(sum({_DOLLARS}), 2) AS questioned FROM held JOIN ag_findings_xref USING (xref_id) GROUP BY 1"""
_add("questioned_cost_board", lambda s, d: _questioned(s, d).orderBy(F.desc("questioned"), "agency").limit(50), f"SELECT * FROM ({_QUESTIONED}) ORDER BY questioned DESC, agency LIMIT 50")
_add("adverse_board", lambda s, d: _questioned(s, d).where("n_adverse > 0").select("agency", "n_adverse", "n_xrefs"), f"SELECT agency, n_adverse, n_xrefs FROM ({_QUESTIONED}) WHERE n_adverse > 0")


def _questioned_share(s: SparkSession, d: str) -> DataFrame:
    """Questioned cost as a share of the budget of the same agency; agencies without a budget have none."""
    asked = _questioned(s, d).groupBy(X.agency_form(F.col("agency")).alias("agency_form")).agg(F.round(F.sum("questioned"), 2).alias("questioned"))
    planned = A._variance(s, d).where("status != 'unmatched'").select("agency_form", "budget")
    return asked.join(planned, "agency_form", "left").withColumn("pct", F.round(100 * F.col("questioned") / F.nullif(F.col("budget"), F.lit(0.0)), 4))


_add(
    "questioned_share_of_budget",
    _questioned_share,
    f"WITH q AS (SELECT {A._FORM_SQL.format(c='agency')} AS agency_form, round(sum(questioned), 2) AS questioned FROM ({_QUESTIONED}) GROUP BY 1), b AS (SELECT agency_form, budget FROM ({A.SQL['budget_actual_audit']}) WHERE status <> 'unmatched') SELECT q.*, b.budget, round(100 * questioned / nullif(budget, 0), 4) AS pct FROM q LEFT JOIN b USING (agency_form)",
)


def _matrix(s: SparkSession, d: str) -> DataFrame:
    """Agencies by risk and size of budget."""
    risk = F.when(F.col("risk") >= 40, "high").when(F.col("risk") >= 10, "some").otherwise("none")
    size = F.when(F.col("budget") >= 1e8, "large").when(F.col("budget") >= 1e6, "medium").otherwise("small")
    return A._variance(s, d).groupBy(risk.alias("risk_class"), size.alias("budget_class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("budget"), 2).alias("budget"))


_add(
    "risk_budget_matrix",
    _matrix,
    f"SELECT CASE WHEN risk >= 40 THEN 'high' WHEN risk >= 10 THEN 'some' ELSE 'none' END AS risk_class, CASE WHEN budget >= 1e8 THEN 'large' WHEN budget >= 1e6 THEN 'medium' ELSE 'small' END AS budget_class, count(*) AS n, round(sum(budget), 2) AS budget FROM ({A.SQL['budget_actual_audit']}) GROUP BY 1, 2",
)


def _alignment(s: SparkSession, d: str) -> DataFrame:
    """Whether an agency's budget changes against last year's spending in the direction in which its spending changed."""
    spent = expenditure(s, d).where("fiscal_year in (2024, 2025) and agency is not null").groupBy(X.agency_form(F.col("agency")).alias("agency_form"))
    spent = spent.agg(*[F.round(F.sum(F.when(F.col("fiscal_year") == y, F.col("amount"))).cast("double"), 2).alias(f"spent_{y}") for y in (2024, 2025)])
    out = A._variance(s, d).where("status != 'unmatched'").select("agency_form", "budget").join(spent, "agency_form")
    up, was_up = F.col("budget") > F.col("spent_2025"), F.col("spent_2025") > F.col("spent_2024")
    return out.withColumn("alignment", F.when(up.isNull() | was_up.isNull(), "unknown").when(up == was_up, "same way").otherwise("against"))


_add(
    "budget_change_alignment",
    _alignment,
    f"""WITH {CLEAN_SQL}, sp AS (SELECT {A._FORM_SQL.format(c='agency')} AS agency_form, round(CAST(sum(amount) FILTER (WHERE fiscal_year = 2024) AS DOUBLE), 2) AS spent_2024, round(CAST(sum(amount) FILTER (WHERE fiscal_year = 2025) AS DOUBLE), 2) AS spent_2025 FROM clean WHERE fiscal_year IN (2024, 2025) AND agency IS NOT NULL GROUP BY 1)
    SELECT b.agency_form, budget, spent_2024, spent_2025, CASE WHEN (budget > spent_2025) IS NULL OR (spent_2025 > spent_2024) IS NULL THEN 'unknown' WHEN (budget > spent_2025) = (spent_2025 > spent_2024) THEN 'same way' ELSE 'against' END AS alignment
    FROM ({A.SQL['budget_actual_audit']}) b JOIN sp USING (agency_form) WHERE status <> 'unmatched'""",
)
# Programs that are looked up in budget notes, spending and audit texts.
PROGRAMS = ["textbook", "bridge", "wildfire", "clinic", "parks"]


def _programs(s: SparkSession, d: str) -> DataFrame:
    """Of each program what budget lines, payments and report texts name it: one pass over each table, all programs at once."""
    hits = lambda text: F.explode(F.filter(F.array(*[F.lit(p) for p in PROGRAMS]), lambda p: F.contains(F.lower(F.coalesce(text, F.lit(""))), p))).alias("program")
    planned = _lines(s, d).select(hits(F.col("note")), "line_total").groupBy("program").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("line_total"), 2).alias("budget"))
    paid = expenditure(s, d).select(hits(F.concat_ws(" ", "appropriation", "category2", "category3")), "amount").groupBy("program").agg(F.count(F.lit(1)).alias("n_payments"), F.round(F.sum("amount").cast("double"), 2).alias("spent"))
    told = table(s, d, "documents").where("report_id is not null").select(hits(F.col("text")), "report_id").groupBy("program").agg(F.countDistinct("report_id").alias("n_reports"))
    every = s.createDataFrame([(p,) for p in PROGRAMS], "program string")
    out = every.join(planned, "program", "left").join(paid, "program", "left").join(told, "program", "left")
    return out.select("program", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_payments", "n_reports")], "budget", "spent")


_add(
    "program_accountability",
    _programs,
    f"""WITH {CLEAN_SQL}, {_LINES}, p(program) AS (VALUES {', '.join(f"('{p}')" for p in PROGRAMS)}),
    b AS (SELECT program, count(*) AS n_lines, round(sum(line_total), 2) AS budget FROM p JOIN lines ON contains(lower(coalesce(note, '')), program) WHERE agency_form <> '' GROUP BY 1),
    c AS (SELECT program, count(*) AS n_payments, round(CAST(sum(amount) AS DOUBLE), 2) AS spent FROM p JOIN clean ON contains(lower(concat_ws(' ', appropriation, category2, category3)), program) GROUP BY 1),
    r AS (SELECT program, count(DISTINCT report_id) AS n_reports FROM p JOIN documents ON contains(lower(coalesce(text, '')), program) WHERE report_id IS NOT NULL GROUP BY 1)
    SELECT program, coalesce(n_lines, 0) AS n_lines, coalesce(n_payments, 0) AS n_payments, coalesce(n_reports, 0) AS n_reports, budget, spent FROM p LEFT JOIN b USING (program) LEFT JOIN c USING (program) LEFT JOIN r USING (program)""",
)
_add(
    "benford_above_peers",
    lambda s, d: B.above_quantile(S.digit_deviation(expenditure(s, d), "agency", 50), "mad", 0.75).withColumn("threshold", F.round("threshold", 6)),
    f"WITH {CLEAN_SQL}, dg AS (SELECT agency, TRY_CAST(left(replace(CAST(amount AS VARCHAR), '.', ''), 1) AS INTEGER) AS x FROM clean WHERE agency IS NOT NULL), c AS (SELECT agency, x, count(*) AS k FROM dg WHERE x >= 1 GROUP BY ALL), a AS (SELECT agency, CAST(sum(k) AS BIGINT) AS n FROM c GROUP BY 1),"
    " m AS (SELECT agency, max(n) AS n, round(avg(abs(k::DOUBLE / n - log10(1 + 1.0::DOUBLE / x))), 6) AS mad FROM c JOIN a USING (agency) WHERE n >= 50 GROUP BY 1) SELECT m.*, round(t, 6) AS threshold FROM m, (SELECT quantile_cont(mad, 0.75) AS t FROM m) WHERE mad > t",
)
_add(
    "hourly_rate_top",
    lambda s, d: expenditure(s, d).where("hourly_rate is not null").orderBy(F.desc("hourly_rate"), "record_number", "txn").limit(10).select("record_number", "txn", F.col("hourly_rate").cast("double").alias("hourly_rate"), "position_title"),
    f"WITH {CLEAN_SQL} SELECT record_number, txn, CAST(hourly_rate AS DOUBLE) AS hourly_rate, position_title FROM clean WHERE hourly_rate IS NOT NULL ORDER BY clean.hourly_rate DESC, record_number NULLS FIRST, txn NULLS FIRST LIMIT 10",
)
_add(
    "score_band_summary",
    lambda s, d: scored(s, d).groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk_score"), 4).alias("mean_score"), F.round(F.percentile("risk_score", F.lit(0.9)), 4).alias("p90"), F.max("risk_score").alias("max_score")),
    f"WITH {TX} SELECT risk_band, count(*) AS n, round(avg(risk_score), 4) AS mean_score, round(quantile_cont(risk_score, 0.9), 4) AS p90, max(risk_score) AS max_score FROM tx GROUP BY 1",
)


def _children(s: SparkSession, d: str) -> DataFrame:
    """Payments of tiers 1 and 2 under the parents that the crosswalk states for their payee's key."""
    up = table(s, d, "entity_crosswalk").select("entity_key", "parent_key").where("entity_key is not null and parent_key is not null and parent_key not in ('', 'NULL')").distinct()
    return scored(s, d).where("tier <= 2").join(up, "entity_key").select("parent_key", "entity_key", "record_number", "transaction_id", "tier", "risk_score")


_add("entity_child_payments", _children, f"WITH {TX}, up AS (SELECT DISTINCT entity_key, parent_key FROM entity_crosswalk WHERE entity_key IS NOT NULL AND parent_key IS NOT NULL AND parent_key NOT IN ('', 'NULL')) SELECT parent_key, entity_key, record_number, transaction_id, tier, risk_score FROM tx JOIN up USING (entity_key) WHERE tier <= 2")
_add(
    "finding_recommendations",
    lambda s, d: B.recommendations(table(s, d, "documents"), "doc_id", "text"),
    r"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL),
    n AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^Finding [0-9]+\b') THEN TRY_CAST(regexp_extract(line, '^Finding ([0-9]+)', 1) AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS finding_no FROM l)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, line, finding_no FROM n WHERE starts_with(line, 'Recommendation')""",
)
PATTERNS = {"amounts": r"\$[0-9][0-9,]*(?:\.[0-9]+)?", "findings": r"Finding [0-9]+", "advice": r"(?:should|must) [a-z]+ [a-z]+"}
_add(
    "keyed_patterns",
    lambda s, d: B.keyed_patterns(table(s, d, "documents"), "doc_id", "text", PATTERNS),
    "SELECT doc_id, " + ", ".join(f"len({n}_) AS n_{n}, array_to_string({n}_[1:10], '|') AS {n}" for n in PATTERNS) + " FROM (SELECT doc_id, " + ", ".join(f"regexp_extract_all(coalesce(text, ''), '{p}') AS {n}_" for n, p in PATTERNS.items()) + ") FROM documents) WHERE ".replace(") FROM documents)", " FROM documents)") + " OR ".join(f"len({n}_) > 0" for n in PATTERNS),
)
_add(
    "report_heads",
    lambda s, d: B.report_heads(table(s, d, "documents"), "doc_id", "text"),
    rf"""SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: length(x) > 0)[1] AS title,
    nullif(regexp_extract(coalesce(text, ''), '(?:Department|Dept|Board|Office|Commission) (?:Of|On|of|on) [A-Z][a-z]+(?: (?:And|and|[A-Z][a-z]+))*'), '') AS agency, nullif(regexp_extract(coalesce(text, ''), '(?:{B.MONTHS}) (?:[0-9]{{1,2}}, )?[0-9]{{4}}'), '') AS date_text FROM documents""",
)
