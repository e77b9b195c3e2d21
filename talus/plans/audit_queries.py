"""Queries over audit reports, budgets, documents and the configured score, with SQL where SQL gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions import cleaning as X
from talus.operators import audit as A
from talus.operators import mart as M
from talus.operators import rollups as R
from talus.operators import scoring as C
from talus.operators.orphans import cited_reports
from talus.plans import ledger_queries as L
from talus.plans.problems import _CITES_SQL
from talus.sources.ledger import CLEAN_SQL, LEDGER_SQL, expenditure, ledger
from talus.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _usd(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 2) AS {name}"


# reports and findings
def _parts(s: SparkSession, d: str) -> DataFrame:
    p = X.report_parts(F.col("source_path"))
    return table(s, d, "ag_reports").select(F.col("report_id").alias("key"), *[c.alias(n) for n, c in p.items()])


_add(
    "report_id_parts",
    _parts,
    r"""SELECT report_id AS key, nullif(regexp_extract(source_path, '\b(\d{2})-(CR|[0-9])?(\d+)', 0), '') AS report_id, CAST(2000 + TRY_CAST(nullif(regexp_extract(source_path, '\b(\d{2})-', 1), '') AS INTEGER) AS INTEGER) AS fiscal_year,
    nullif(regexp_extract(source_path, '\b\d{2}-([A-Z0-9]+)', 1), '') AS report_no, CASE WHEN regexp_extract(source_path, '\b\d{2}-([A-Z0-9]+)', 1) LIKE 'CR%' THEN 'compliance' WHEN regexp_extract(source_path, '\b\d{2}-([A-Z0-9]+)', 1) LIKE '3%' THEN 'special' WHEN regexp_extract(source_path, '\b\d{2}-([A-Z0-9]+)', 1) LIKE '2%' THEN 'single' ELSE 'performance' END AS report_kind FROM ag_reports""",
)
_add(
    "finding_headings",
    lambda s, d: A.finding_headings(table(s, d, "documents"), "doc_id", "text"),
    r"SELECT doc_id, no AS finding_no, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, no ORDER BY length(title) DESC, title DESC) AS rn FROM (SELECT DISTINCT doc_id, TRY_CAST(regexp_extract(title, '^Finding ([0-9]+)', 1) AS INTEGER) AS no, title FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS title FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(title, '^Finding [0-9]+\b'))) WHERE rn = 1",
)
_add(
    "cost_sentences",
    lambda s, d: A.cost_sentences(table(s, d, "documents"), "doc_id", "text"),
    rf"""WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '[.][ \t\n\r\f]+', '.' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE text IS NOT NULL),
    items AS (SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS sentence, unnest(list_concat([NULL], ss[1:len(ss) - 1])) AS before FROM parts),
    about AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substr(sentence, 1, 80) ORDER BY pos) AS k FROM items WHERE regexp_matches(sentence, '\$[0-9]') AND regexp_matches(sentence, '{A.COST_WORDS}') AND length(sentence) BETWEEN 30 AND 400)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence, before FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM about WHERE k = 1) WHERE n <= 12""",
)
_add(
    "dollar_amounts",
    lambda s, d: A.dollar_amounts(table(s, d, "documents"), "doc_id", "text"),
    r"SELECT doc_id, len(a) AS n, array_to_string(a[1:15], '|') AS amounts FROM (SELECT doc_id, regexp_extract_all(text, '\$[0-9][0-9,]*(?:\.[0-9]+)?') AS a FROM documents WHERE text IS NOT NULL) WHERE len(a) > 0",
)
_add("context_lines", lambda s, d: A.context_lines(table(s, d, "documents"), "doc_id", "text"))
_add(
    "audit_rollup",
    lambda s, d: table(s, d, "ag_reports").groupBy("agency_checkbook").agg(F.countDistinct("report_id").alias("n_reports"), F.count(F.when(F.col("report_type") == "followup", 1)).alias("n_followup"), F.bool_or(F.lower("title").contains("duplicate")).alias("any_duplicate"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("pages"), F.max("report_date").alias("last_report")),
    "SELECT agency_checkbook, count(DISTINCT report_id) AS n_reports, count(*) FILTER (WHERE report_type = 'followup') AS n_followup, bool_or(contains(lower(title), 'duplicate')) AS any_duplicate, CAST(coalesce(sum(total_pages), 0) AS BIGINT) AS pages, max(report_date) AS last_report FROM ag_reports GROUP BY 1",
)
_add(
    "search_reports",
    lambda s, d: table(s, d, "ag_reports").where(F.upper("title").contains("LEASE") | F.upper("agency_raw").contains("WATER")).select("report_id", "title"),
    "SELECT report_id, title FROM ag_reports WHERE contains(upper(title), 'LEASE') OR contains(upper(agency_raw), 'WATER')",
)


def _xref(s: SparkSession, d: str) -> DataFrame:
    """Of every cross-reference the reports it cites and those of them that exist."""
    cites = table(s, d, "ag_findings_xref").select("xref_id", F.explode(cited_reports(F.col("ag_finding"))).alias("report"))
    known = table(s, d, "ag_reports").select(F.col("report_id").alias("report"), F.col("report_id").alias("found"))
    out = cites.join(known, "report", "left").groupBy("xref_id").agg(F.array_join(F.array_sort(F.collect_set("report")), "|").alias("report_ids"), F.array_join(F.array_sort(F.collect_set("found")), "|").alias("matched_ids"))
    return out


_add(
    "xref_resolved",
    _xref,
    f"WITH {_CITES_SQL} SELECT c.xref_id, string_agg(DISTINCT report, '|' ORDER BY report) AS report_ids, coalesce(string_agg(DISTINCT r.report_id, '|' ORDER BY r.report_id), '') AS matched_ids FROM cites c LEFT JOIN ag_reports r ON r.report_id = c.report WHERE ok AND report IS NOT NULL GROUP BY 1",
)
# Words of report titles and the fund that they mean.
FUNDS = {"wildfire": "WILDFIRE", "licence": "LICENCE", "bridge": "ROAD", "park": "PARK", "data centre": "DATA CENTRE"}
_FUND_SQL = "CASE " + " ".join(f"WHEN contains(lower(coalesce(title, '')), '{w}') THEN '{f}'" for w, f in FUNDS.items()) + " END"
_add(
    "finding_context",
    lambda s, d: A.spend_around(table(s, d, "ag_reports"), expenditure(s, d), 1, FUNDS),
    f"WITH {CLEAN_SQL}, r AS (SELECT report_id, agency_checkbook AS agency, fiscal_year, {_FUND_SQL} AS fund_keyword FROM ag_reports) SELECT r.*, (SELECT round(CAST(sum(amount) AS DOUBLE), 2) FROM clean c WHERE c.agency = r.agency AND c.fiscal_year = r.fiscal_year) AS agency_spend, (SELECT round(CAST(sum(amount) AS DOUBLE), 2) FROM clean c WHERE c.agency = r.agency AND c.fiscal_year BETWEEN r.fiscal_year - 1 AND r.fiscal_year + 1) AS agency_spend_around,"
    " (SELECT round(CAST(sum(amount) AS DOUBLE), 2) FROM clean c WHERE c.agency = r.agency AND c.fiscal_year = r.fiscal_year AND contains(c.fund, r.fund_keyword)) AS fund_spend FROM r",
)
_add(
    "audited_period_spend",
    lambda s, d: A.audited_period_spend(table(s, d, "ag_reports"), expenditure(s, d)),
    f"WITH {CLEAN_SQL}, p AS (SELECT agency_checkbook AS agency, count(DISTINCT report_id) AS n_reports, min(fiscal_year) AS first_fy, max(fiscal_year) AS last_fy FROM ag_reports WHERE agency_checkbook IS NOT NULL GROUP BY 1) SELECT p.*, (SELECT round(CAST(sum(amount) AS DOUBLE), 2) FROM clean c WHERE c.agency = p.agency AND c.fiscal_year BETWEEN first_fy AND last_fy) AS spend_during_audits FROM p",
)
_DROPPED = ", ".join(f"'{w}'" for w in A.BOILERPLATE)
_WORDS = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(replace(upper({c}), 'DEPARTMENT', 'DEPT'), '&', ' AND '), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN (" + _DROPPED + "))))"
_add(
    "agency_word_bridge",
    lambda s, d: A.word_bridge(table(s, d, "ag_reports"), "agency_raw", table(s, d, "agency_list"), "agency_name"),
    f"""WITH a AS (SELECT DISTINCT agency_raw AS a, {_WORDS.format(c='agency_raw')} AS x FROM ag_reports WHERE agency_raw IS NOT NULL), b AS (SELECT DISTINCT agency_name AS b, {_WORDS.format(c='agency_name')} AS y FROM agency_list),
    sc AS (SELECT a, b, round(len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS score FROM a, b WHERE len(list_intersect(x, y)) > 0)
    SELECT a AS agency_raw, b AS matched_name, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, length(b), b) AS rn FROM sc WHERE score >= 0.34) WHERE rn = 1""",
)

# budgets


def _line_total() -> Column:
    """A budget line's total, or the sum of its parts where it states none."""
    return F.coalesce("total", F.coalesce("general_fund_ongoing", F.lit(0.0)) + F.coalesce("other_funds", F.lit(0.0)) + F.coalesce("one_time", F.lit(0.0)))


_TOTAL_SQL = "coalesce(total, coalesce(general_fund_ongoing, 0) + coalesce(other_funds, 0) + coalesce(one_time, 0))"
_FORM_SQL = "trim(regexp_replace(regexp_replace(replace(replace(upper({c}), 'DEPARTMENT', 'DEPT'), '&', ' AND '), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def budgets(s: SparkSession, d: str) -> DataFrame:
    """Budget lines summed by the comparable form of their agency's name: total, general fund and its share."""
    lines = table(s, d, "fy2026_jlbc_structured").where("agency is not null").withColumn("agency_form", X.agency_form(F.col("agency"))).where("agency_form != ''")
    out = lines.groupBy("agency_form").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(_line_total()).alias("t"), F.sum(F.coalesce("general_fund_ongoing", F.lit(0.0))).alias("g"))
    return out.select("agency_form", "n_lines", F.round("t", 2).alias("budget"), F.round(100 * F.col("g") / F.nullif(F.col("t"), F.lit(0.0)), 4).alias("general_fund_pct"))


_BUDGETS = f"SELECT agency_form, count(*) AS n_lines, round(sum(t), 2) AS budget, round(100 * sum(coalesce(general_fund_ongoing, 0)) / nullif(sum(t), 0), 4) AS general_fund_pct FROM (SELECT *, {_FORM_SQL.format(c='agency')} AS agency_form, {_TOTAL_SQL} AS t FROM fy2026_jlbc_structured WHERE agency IS NOT NULL) WHERE agency_form <> '' GROUP BY 1"
_add("budget_by_agency", budgets, _BUDGETS)
_add(
    "budget_top_agencies",
    lambda s, d: budgets(s, d).withColumn("pct", F.round(100 * F.col("budget") / F.sum("budget").over(Window.partitionBy()), 4)).orderBy(F.desc("budget"), "agency_form").limit(10).select("agency_form", "budget", "pct"),
    f"SELECT agency_form, budget, round(100 * budget / sum(budget) OVER (), 4) AS pct FROM ({_BUDGETS}) ORDER BY budget DESC, agency_form LIMIT 10",
)
_add(
    "budget_keyword_lines",
    lambda s, d: table(s, d, "fy2026_jlbc_structured").where(F.lower("note").contains("meal") | F.lower("note").contains("clinic")).select("line_id", "agency", "note", F.round(_line_total(), 2).alias("total")),
    f"SELECT line_id, agency, note, round({_TOTAL_SQL}, 2) AS total FROM fy2026_jlbc_structured WHERE contains(lower(note), 'meal') OR contains(lower(note), 'clinic')",
)


# Fixed value: the state's name, which people type before an agency's.
PLACE = "CORVANE"
_TYPED_DROPPED = ", ".join(f"'{w}'" for w in [*A.TYPED_BOILERPLATE, PLACE])
_TYPED_WORDS = "list_distinct(list_filter(string_split({c}, ' '), lambda w: length(w) > 1 AND w NOT IN (" + _TYPED_DROPPED + ") AND NOT regexp_full_match(w, '(FY)?\\d+')))"


def _variance(s: SparkSession, d: str) -> DataFrame:
    """Every budget agency's budget against the last year's spending, and what audits there are.

    Typed names are resolved to the agencies that spent in the last two years
    and summed per agency.  Names that mean none of them stay under their own
    form, without spending and with the status unmatched.
    """
    years = expenditure(s, d).where("fiscal_year in (2024, 2025) and agency is not null").withColumn("agency_form", X.agency_form(F.col("agency"))).groupBy("agency_form").agg(F.sum(F.when(F.col("fiscal_year") == 2025, F.col("amount"))).alias("_s"))
    audits = table(s, d, "ag_reports").where("agency_checkbook is not null").withColumn("agency_form", X.agency_form(F.col("agency_checkbook"))).groupBy("agency_form").agg(F.count(F.lit(1)).alias("n_reports"))
    typed = budgets(s, d).select("agency_form", "budget")
    means = A.ranked_bridge(typed, "agency_form", years.select(F.col("agency_form").alias("listed")), "listed", PLACE)
    by_agency = typed.join(means, "agency_form", "left").groupBy(F.coalesce("listed", "agency_form").alias("agency_form")).agg(F.round(F.sum("budget"), 2).alias("budget"), F.bool_or(F.col("listed").isNotNull()).alias("matched"))
    out = by_agency.join(years, "agency_form", "left").join(audits, "agency_form", "left").withColumn("actual", F.when(F.col("matched"), F.round(F.col("_s").cast("double"), 2)))
    pct = F.round(100 * (F.col("actual") - F.col("budget")) / F.nullif(F.col("budget"), F.lit(0.0)), 4)
    told = F.when(~F.col("matched"), "unmatched").when(F.col("actual").isNull(), "no spend").when(pct > 20, "over").when(pct < -20, "under").when(pct.isNull(), "no budget").otherwise("near")
    out = out.withColumn("variance_pct", pct).withColumn("status", told)
    risk = F.least(10 * F.coalesce("n_reports", F.lit(0)), F.lit(40)) + F.when(pct > 20, F.least(F.floor(pct), F.lit(30))).otherwise(0)
    return out.select("agency_form", "budget", "actual", "variance_pct", "status", F.coalesce("n_reports", F.lit(0)).alias("n_reports"), risk.cast("long").alias("risk"))


_add(
    "budget_actual_audit",
    _variance,
    f"""WITH {CLEAN_SQL}, b AS ({_BUDGETS}), sp AS (SELECT {_FORM_SQL.format(c='agency')} AS listed, CAST(sum(amount) FILTER (WHERE fiscal_year = 2025) AS DOUBLE) AS s FROM clean WHERE fiscal_year IN (2024, 2025) AND agency IS NOT NULL GROUP BY 1),
    au AS (SELECT {_FORM_SQL.format(c='agency_checkbook')} AS agency_form, count(*) AS n FROM ag_reports WHERE agency_checkbook IS NOT NULL GROUP BY 1),
    typed AS (SELECT agency_form AS a, bare, {_TYPED_WORDS.format(c='bare')} AS aw FROM (SELECT agency_form, regexp_replace(agency_form, '^((THE|STATE OF|STATE|{PLACE}) )+', '') AS bare FROM b)),
    known AS (SELECT listed AS b, {_TYPED_WORDS.format(c='listed')} AS bw FROM sp WHERE listed <> ''),
    pairs AS (SELECT a, b, bare, len(aw) AS na, len(bw) AS nb, len(list_intersect(aw, bw)) AS n FROM typed, known),
    ranked AS (SELECT *, CASE WHEN a = b THEN 0 WHEN bare = b THEN 2 WHEN contains(' ' || b || ' ', ' ' || bare || ' ') OR contains(' ' || bare || ' ', ' ' || b || ' ') THEN 3 WHEN n = na AND n = nb THEN 4 WHEN n >= 2 THEN 5 END AS k FROM pairs WHERE n > 0 OR a = b OR bare = b),
    first_ AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY k, n DESC, n::DOUBLE / nullif(na + nb - n, 0) DESC NULLS LAST) AS place FROM ranked WHERE k IS NOT NULL),
    means AS (SELECT a AS agency_form, min(b) AS listed FROM first_ WHERE place = 1 GROUP BY 1 HAVING count(*) = 1),
    g AS (SELECT coalesce(listed, agency_form) AS agency_form, round(sum(budget), 2) AS budget, bool_or(listed IS NOT NULL) AS matched FROM b LEFT JOIN means USING (agency_form) GROUP BY 1),
    j AS (SELECT g.agency_form, budget, matched, CASE WHEN matched THEN round(s, 2) END AS actual, coalesce(n, 0) AS n_reports FROM g LEFT JOIN sp ON sp.listed = g.agency_form LEFT JOIN au ON au.agency_form = g.agency_form),
    v AS (SELECT *, round(100 * (actual - budget) / nullif(budget, 0), 4) AS variance_pct FROM j)
    SELECT agency_form, budget, actual, variance_pct, CASE WHEN NOT matched THEN 'unmatched' WHEN actual IS NULL THEN 'no spend' WHEN variance_pct > 20 THEN 'over' WHEN variance_pct < -20 THEN 'under' WHEN variance_pct IS NULL THEN 'no budget' ELSE 'near' END AS status, n_reports,
      CAST(least(10 * n_reports, 40) + CASE WHEN variance_pct > 20 THEN least(floor(variance_pct), 30) ELSE 0 END AS BIGINT) AS risk FROM v""",
)


def _near_repeats(s: SparkSession, d: str) -> DataFrame:
    """Payments of one vendor and amount that follow an equal one within seven days."""
    w = Window.partitionBy("vid", "amount").orderBy("posting_date", "txn", "record_number")
    rows = expenditure(s, d).where("vid is not null and posting_date is not null").withColumn("gap", F.datediff("posting_date", F.lag("posting_date").over(w)))
    return rows.where("gap between 0 and 7").groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("_s")).select("fiscal_year", "n", R.money("_s", "usd"))


_add("repeats_within_a_week", _near_repeats, f"WITH {CLEAN_SQL} SELECT fiscal_year, count(*) AS n, {_usd('sum(amount)', 'usd')} FROM (SELECT *, posting_date - lag(posting_date) OVER (PARTITION BY vid, amount ORDER BY posting_date, txn, record_number) AS gap FROM clean WHERE vid IS NOT NULL AND posting_date IS NOT NULL) WHERE gap BETWEEN 0 AND 7 GROUP BY 1")


def _compliance(s: SparkSession, d: str) -> DataFrame:
    """Ledger payees that are on the list of reviewed entities by name key, or hold a listed name as whole words, with what they were paid."""
    listed = table(s, d, "vendor_verdicts").select(X.entity_key(F.col("entity_key")).alias("entity_key")).where("entity_key is not null").distinct()
    paid = expenditure(s, d).withColumn("entity_key", X.entity_key(F.col("payee"))).groupBy("entity_key").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("_s"))
    found = listed.unionByName(A.holding_listed(paid, "entity_key", listed, "entity_key")).distinct()
    return paid.join(found, "entity_key").select("entity_key", "n", R.money("_s", "usd"))


_WORD_FORM = "trim(regexp_replace(upper({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_add(
    "listed_payees",
    _compliance,
    rf"""WITH {CLEAN_SQL}, l AS (SELECT DISTINCT nullif(upper(trim(regexp_replace(entity_key, '\s+', ' ', 'g'))), '') AS entity_key FROM vendor_verdicts), forms AS (SELECT DISTINCT {_WORD_FORM.format(c='entity_key')} AS form FROM l WHERE entity_key IS NOT NULL),
    p AS (SELECT nullif(upper(trim(regexp_replace(payee, '\s+', ' ', 'g'))), '') AS entity_key, count(*) AS n, {_usd('sum(amount)', 'usd')} FROM clean GROUP BY 1)
    SELECT p.* FROM p WHERE entity_key IN (SELECT entity_key FROM l WHERE entity_key IS NOT NULL) OR EXISTS (SELECT 1 FROM forms WHERE form <> '' AND contains(' ' || {_WORD_FORM.format(c='p.entity_key')} || ' ', ' ' || form || ' '))""",
)


def _audit_flags(s: SparkSession, d: str) -> DataFrame:
    """Entities whose first agency (by name) was audited within a year of the entity's payments."""
    e = table(s, d, "tier_entities").select("entity_key", "first_year", "last_year", F.try_element_at(F.array_sort("agencies"), F.lit(1)).alias("agency"))
    spans = e.where("agency is not null").withColumn("fiscal_year", F.explode(F.sequence(F.col("first_year") - 1, F.col("last_year") + 1)))
    audits = table(s, d, "ag_reports").where("agency_checkbook is not null and fiscal_year is not null").groupBy(F.col("agency_checkbook").alias("agency"), "fiscal_year").agg(F.count(F.lit(1)).alias("n"))
    near = spans.join(audits, ["agency", "fiscal_year"]).groupBy("entity_key").agg(F.sum("n").alias("n_reports"))
    return e.join(near, "entity_key", "left").select("entity_key", "agency", F.coalesce("n_reports", F.lit(0)).alias("n_reports"))


_add(
    "entities_audit_flag",
    _audit_flags,
    "WITH e AS (SELECT entity_key, first_year, last_year, list_sort(agencies)[1] AS agency FROM tier_entities) SELECT entity_key, agency, (SELECT count(*) FROM ag_reports r WHERE r.agency_checkbook = e.agency AND r.fiscal_year BETWEEN first_year - 1 AND last_year + 1) AS n_reports FROM e",
)


def _statewide(s: SparkSession, d: str) -> DataFrame:
    """One row of totals over ledger, scores, audits and budget."""
    spent = expenditure(s, d).agg(F.sum("amount").alias("_s"), F.countDistinct("agency").alias("n_agencies"))
    tiers = table(s, d, "tx_tiered").distinct().agg(F.count(F.when(F.col("tier") == 1, 1)).alias("n_tier1"), F.count(F.lit(1)).alias("n_scored"))
    audits = table(s, d, "ag_reports").agg(F.count(F.lit(1)).alias("n_reports"))
    planned = budgets(s, d).agg(F.round(F.sum("budget"), 2).alias("budget"))
    one = spent.select(R.money("_s", "spent"), "n_agencies")
    for part in (tiers, audits, planned):  # each is one row
        one = one.crossJoin(F.broadcast(part))
    return one


_add(
    "statewide_summary",
    _statewide,
    f"WITH {CLEAN_SQL} SELECT (SELECT round(CAST(sum(amount) AS DOUBLE), 2) FROM clean) AS spent, (SELECT count(DISTINCT agency) FROM clean) AS n_agencies, (SELECT count(*) FROM (SELECT DISTINCT * FROM tx_tiered) WHERE tier = 1) AS n_tier1, (SELECT count(*) FROM (SELECT DISTINCT * FROM tx_tiered)) AS n_scored, (SELECT count(*) FROM ag_reports) AS n_reports, (SELECT round(sum(budget), 2) FROM ({_BUDGETS})) AS budget",
)
_add("budget_over_spent", lambda s, d: _variance(s, d).where("status = 'over'"), f"SELECT * FROM ({SQL['budget_actual_audit']}) WHERE status = 'over'")

# the configured score over the mart
_SCORE_COLUMNS = ["record_number", "txn", *[f"f_{f}" for f in C.DEFAULT.families], "marker_sum", "risk_band", "tier"]


def _scores(s: SparkSession, d: str) -> DataFrame:
    clean = expenditure(s, d)
    out = C.score(C.with_history(M.feature_mart(clean), clean))
    return out.select(*_SCORE_COLUMNS, F.col("risk_score").cast("double").alias("risk_score"), F.array_join("fired_markers", "|").alias("fired_markers"))


_extra = ", c.amount >= 100000 AND c.amount % 100000 = 0 AS is_round_100000, c.amount >= 1000000 AND c.amount % 1000000 = 0 AS is_round_1000000, TRY_CAST(split_part(coalesce(c.period, ''), '.', 1) AS INTEGER) AS fp_canon, c.contract, c.rail, c.payee, c.category1"
_mart_head, _mart_body = L.SQL["feature_mart"].rsplit("SELECT c.record_number", 1)
_with_extra = "SELECT c.record_number" + _mart_body.replace("CAST(c.amount AS DOUBLE) AS amount\n", f"c.amount AS amount{_extra}\n")
_PAYEE_KEY = r"nullif(upper(trim(regexp_replace({c}, '\s+', ' ', 'g'))), '')"
_with_extra = f"""SELECT m.*, again.vid IS NOT NULL AS is_paid_again, p.payee_first_year, r.contract_rate FROM ({_with_extra}) m
    LEFT JOIN (SELECT vid, amount FROM clean WHERE vid IS NOT NULL AND ref IS NOT NULL GROUP BY ALL HAVING count(DISTINCT ref) >= 2 AND count(DISTINCT txn) >= 2 AND max(posting_date) - min(posting_date) BETWEEN 1 AND 90) again ON again.vid = m.vid AND again.amount = m.amount
    LEFT JOIN (SELECT {_PAYEE_KEY.format(c='payee')} AS k, min(fiscal_year) AS payee_first_year FROM clean WHERE payee IS NOT NULL GROUP BY 1) p ON p.k = {_PAYEE_KEY.format(c='m.payee')}
    LEFT JOIN (SELECT agency, fiscal_year, count(contract)::DOUBLE / count(*) AS contract_rate FROM clean GROUP BY ALL) r ON r.agency = m.agency AND r.fiscal_year = m.fiscal_year"""
_add(
    "score_payments",
    _scores,
    f"{_mart_head}SELECT {', '.join(_SCORE_COLUMNS)}, CAST(risk_score AS DOUBLE) AS risk_score, array_to_string(fired_markers, '|') AS fired_markers FROM ({C.score_sql('(' + _with_extra + ')')})",
)
