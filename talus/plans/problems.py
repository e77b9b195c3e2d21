"""Queries p2, p6 and p7, with SQL of the same results where SQL can give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.diff import table_diff
from talus.operators.orphans import cited_reports, orphan_references
from talus.operators.skew import eager_join_aggregate, heavy_keys
from talus.staging import Staged
from talus.tables import is_blank, name_key, table

HEAVY_SHARE = 0.02


#: The keys of the ledger with the columns of the scored payments that hold the same keys.
PER_KEY = {"organization_level_1_name": "agency", "vendor_id_code": "vendor_id_code"}


def _per_key(spark: SparkSession, folder: str, ledger_key: str) -> DataFrame:
    """Rows, joined rows and sums of every ledger key; a key (or null) without a scored payment has 0 joined rows, its own ledger sum and null scored sums."""
    ledger = table(spark, folder, "transactions").select(F.col(ledger_key).alias("key_value"), "amount")
    scored = table(spark, folder, "tx_tiered").select(F.col(PER_KEY[ledger_key]).alias("key_value"), F.col("amount").alias("scored"), "n_markers")
    out = eager_join_aggregate(ledger, scored, ["key_value"], ["key_value"], {"ledger_amount": F.col("amount")}, {"scored_amount": F.col("scored"), "markers": F.col("n_markers").cast("long")}, "left")
    money = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    return out.select("key_value", F.col("left_rows").alias("ledger_rows"), "joined_rows", money("ledger_amount"), money("scored_amount"), "markers")


def p2_agency_results(spark: SparkSession, folder: str) -> DataFrame:
    return _per_key(spark, folder, "organization_level_1_name")


def p2_vendor_results(spark: SparkSession, folder: str) -> DataFrame:
    return _per_key(spark, folder, "vendor_id_code")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The keys that hold most rows, out of the results of all keys."""
    keep = Staged(spark, "p2")
    heavy = [heavy_keys(keep(_per_key(spark, folder, f)), "key_value", "ledger_rows", HEAVY_SHARE).select(F.lit(f).alias("field_name"), "key_value") for f in PER_KEY]
    return heavy[0].unionByName(heavy[1])


def _per_key_sql(ledger_key: str) -> str:
    scored_key = PER_KEY[ledger_key]
    return f"""
    SELECT t.key_value, t.n AS ledger_rows, t.n * coalesce(s.n, 0) AS joined_rows, round(CAST(t.usd * coalesce(s.n, 1) AS DOUBLE), 2) AS ledger_amount,
           round(CAST(s.usd * t.n AS DOUBLE), 2) AS scored_amount, CAST(s.markers * t.n AS BIGINT) AS markers
    FROM (SELECT {ledger_key} AS key_value, count(*) AS n, sum(amount) AS usd FROM transactions GROUP BY 1) t
    LEFT JOIN (SELECT {scored_key} AS key_value, count(*) AS n, sum(amount) AS usd, sum(n_markers) AS markers FROM tx_tiered GROUP BY 1) s ON t.key_value = s.key_value"""


P2_FOUND_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS field_name, {f} AS key_value FROM transactions WHERE {f} IS NOT NULL GROUP BY {f} HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM transactions)"
    for f in ("organization_level_1_name", "vendor_id_code")
)

COPIES = {"tx_tiered": "transaction_id", "tier_entities": "entity_key"}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    diffs = [table_diff(table(spark, folder, t), table(spark, folder, f"{t}_serving"), key, t) for t, key in COPIES.items()]
    return diffs[0].unionByName(diffs[1])


#: The compared columns by kind, for the SQL of p6 (fixed values: the schemas of the two tables).
_FIELDS = {
    "tx_tiered": {
        "plain": "record_number transaction_reference_id fiscal_year posting_date agency org2 cabinet_name category1 category2 appropriation_1_name fund_1_name payee vendor_id_code vid contract_number payment_method fp_canon amount mag_band vendor_first_appearance name_is_new is_true_dup f_round f_dup f_conc f_newvendor f_yearend f_peer f_account f_rail f_entity marker_sum n_markers mag_class risk_band tier",
        "double": "vendor_share_of_agency_year robust_z_in_agencycat category_multiplier risk_score",
        "array": "fired_markers",
    },
    "tier_entities": {
        "plain": "entity_name names_merged n_vendor_ids hv_txn n_flagged n_tier1 n_tier2 top_tier first_year last_year n_agencies verify_verdict overtaker_interest public_context",
        "double": "hv_exposure flagged_exposure usd_tier1 max_risk_score",
        "array": "agencies top_markers",
    },
}


def _diff_sql(name: str, key: str) -> str:
    kinds = _FIELDS[name]
    parts = [
        f"SELECT '{name}' AS table_name, a.{key} AS row_key, '*' AS field_name, 'only_first' AS diff_kind FROM (SELECT DISTINCT * FROM {name}) a WHERE NOT EXISTS (SELECT 1 FROM {name}_serving b WHERE b.{key} = a.{key})",
        f"SELECT '{name}', b.{key}, '*', 'only_second' FROM {name}_serving b WHERE NOT EXISTS (SELECT 1 FROM {name} a WHERE b.{key} = a.{key})",
    ]
    for kind, cols in kinds.items():
        for c in cols.split():
            same = {
                "plain": f"a.{c} IS NOT DISTINCT FROM b.{c}",
                "double": f"(a.{c} IS NOT DISTINCT FROM b.{c} OR coalesce(abs(a.{c} - b.{c}) <= 1e-6, false))",
                "array": f"list_sort(a.{c}) IS NOT DISTINCT FROM list_sort(b.{c})",
            }[kind]
            parts.append(f"SELECT '{name}', a.{key}, '{c}', 'value' FROM (SELECT DISTINCT * FROM {name}) a JOIN {name}_serving b USING ({key}) WHERE NOT {same}")
    return " UNION ALL ".join(parts)


P6_FOUND_SQL = " UNION ALL ".join(_diff_sql(t, k) for t, k in COPIES.items())


def references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All references as (source_table, row_key, ref_value, period, target) and all parent keys as (target)."""
    reports, findings, verdicts = (table(spark, folder, t) for t in ("ag_reports", "ag_findings_xref", "vendor_verdicts"))
    agencies, entities = table(spark, folder, "agency_list"), table(spark, folder, "tier_entities")
    of = lambda kind, c: F.when(~is_blank(c), F.concat(F.lit(f"{kind}:"), name_key(c)))
    row = lambda source, key, ref, period, target: [F.lit(source).alias("source_table"), key.cast("string").alias("row_key"), ref.alias("ref_value"), F.coalesce(period, F.lit(0)).cast("int").alias("period"), target.alias("target")]
    cited = findings.select("xref_id", F.explode(cited_reports(F.col("ag_finding"))).alias("report"))
    refs = (
        reports.select(*row("ag_reports", F.col("report_id"), F.col("agency_checkbook"), F.col("fiscal_year"), of("agency", F.col("agency_checkbook"))))
        .unionByName(verdicts.select(*row("vendor_verdicts", F.col("entity_key"), F.col("entity_key"), F.year("reviewed_at"), of("entity", F.col("entity_key")))))
        .unionByName(cited.select(*row("ag_findings_xref", F.col("xref_id"), F.col("report"), 2000 + F.substring("report", 1, 2).cast("int"), F.concat(F.lit("report:"), F.col("report")))))
    )
    parents = (
        agencies.select(of("agency", F.col("agency_name")).alias("target"))
        .unionByName(entities.select(of("entity", F.col("entity_key")).alias("target")))
        .unionByName(reports.select(F.concat(F.lit("report:"), F.col("report_id")).alias("target")))
    )
    return refs, parents


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    refs, parents = references(spark, folder)
    return orphan_references(refs, parents, "target").drop("target").distinct()


def p7_orphans_by_period(spark: SparkSession, folder: str) -> DataFrame:
    refs, parents = references(spark, folder)
    found = orphan_references(refs, parents, "target")
    return found.groupBy("source_table", "period").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("target").alias("n_missing_keys"))


_KEY = r"upper(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
_BLANK = r"({c} IS NULL OR regexp_full_match({c}, '\s*'))"
_CITES_SQL = r"""
  tokens AS (
    SELECT xref_id, unnest(regexp_extract_all(ag_finding, 'p\.\s*\d+|(?:(?:,|/|&|\+|and)\s*)?(?:20)?\d{2}\s*[-–—]\s*\d+|(?:,|/|&|\+|and)\s*\d+|[^,/&+\s]')) AS tok,
           unnest(range(1, 1 + len(regexp_extract_all(ag_finding, 'p\.\s*\d+|(?:(?:,|/|&|\+|and)\s*)?(?:20)?\d{2}\s*[-–—]\s*\d+|(?:,|/|&|\+|and)\s*\d+|[^,/&+\s]')))) AS pos
    FROM ag_findings_xref WHERE ag_finding IS NOT NULL),
  marked AS (
    SELECT xref_id, pos, tok, regexp_extract(tok, '(\d{2})\s*[-–—]\s*\d+$', 1) AS yy, regexp_extract(tok, '(\d+)$', 1) AS num,
           regexp_matches(tok, '^(?:,|/|&|\+|and)\s*\d+$') AS more, regexp_matches(tok, '^(?:(?:,|/|&|\+|and)\s*)?(?:20)?\d{2}\s*[-–—]\s*\d+$') AS cite FROM tokens),
  runs AS (SELECT *, sum(CASE WHEN more THEN 0 ELSE 1 END) OVER (PARTITION BY xref_id ORDER BY pos) AS run FROM marked),
  cites AS (SELECT DISTINCT xref_id, max(CASE WHEN cite THEN yy END) OVER (PARTITION BY xref_id, run) || '-' || num AS report, cite OR more AS ok FROM runs)"""

P7_REFS_SQL = f"""
WITH {_CITES_SQL},
orphans AS (
  SELECT 'ag_reports' AS source_table, report_id AS row_key, agency_checkbook AS ref_value, CAST(coalesce(fiscal_year, 0) AS INTEGER) AS period, {_KEY.format(c='agency_checkbook')} AS target
  FROM ag_reports WHERE NOT {_BLANK.format(c='agency_checkbook')} AND {_KEY.format(c='agency_checkbook')} NOT IN (SELECT {_KEY.format(c='agency_name')} FROM agency_list WHERE agency_name IS NOT NULL)
  UNION ALL
  SELECT 'vendor_verdicts', entity_key, entity_key, CAST(coalesce(year(reviewed_at), 0) AS INTEGER), {_KEY.format(c='entity_key')}
  FROM vendor_verdicts WHERE NOT {_BLANK.format(c='entity_key')} AND {_KEY.format(c='entity_key')} NOT IN (SELECT {_KEY.format(c='entity_key')} FROM tier_entities WHERE entity_key IS NOT NULL)
  UNION ALL
  SELECT 'ag_findings_xref', CAST(xref_id AS VARCHAR), report, CAST(2000 + CAST(left(report, 2) AS INTEGER) AS INTEGER), report
  FROM cites WHERE ok AND report IS NOT NULL AND report NOT IN (SELECT report_id FROM ag_reports WHERE report_id IS NOT NULL))"""

P7_FOUND_SQL = P7_REFS_SQL + " SELECT DISTINCT source_table, row_key, ref_value, period FROM orphans"
P7_BY_PERIOD_SQL = P7_REFS_SQL + " SELECT source_table, period, count(*) AS n_orphans, count(DISTINCT target) AS n_missing_keys FROM orphans GROUP BY 1, 2"

QUERIES = {
    "p2_found": p2_found,
    "p2_agency_results": p2_agency_results,
    "p2_vendor_results": p2_vendor_results,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_orphans_by_period": p7_orphans_by_period,
}
SQL = {
    "p2_found": P2_FOUND_SQL,
    "p2_agency_results": _per_key_sql("organization_level_1_name"),
    "p2_vendor_results": _per_key_sql("vendor_id_code"),
    "p6_found": P6_FOUND_SQL,
    "p7_found": P7_FOUND_SQL,
    "p7_orphans_by_period": P7_BY_PERIOD_SQL,
}
