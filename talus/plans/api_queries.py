"""Reads of the API as queries with fixed arguments, each with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.api import LedgerApi
from talus.plans.scored_queries import _KEY, _VERDICT, TX
from talus.sources.ledger import LEDGER_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, read: Callable[[LedgerApi], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda s, d: read(LedgerApi(s, d))
    SQL[name] = sql


def _holds(columns: str, text: str) -> str:
    return "(" + " OR ".join(f"contains(upper({c}), '{text}')" for c in columns.split()) + ")"


_AS = lambda *columns: [F.col(c).cast("double").alias(c) for c in columns]
_SPEND = f"WITH {LEDGER_SQL}, r AS (SELECT * FROM ledger WHERE kind = 'EX' AND {_holds('category1 category2 category3 appropriation', 'CLINIC')})"
_add("api_spend_of_a_program", lambda a: a.spend(category="clinic"), f"{_SPEND} SELECT count(*) AS n_txns, round(CAST(sum(amount) AS DOUBLE), 2) AS total_usd FROM r")
_add(
    "api_spend_by_vendor",
    lambda a: a.spend(category="clinic", breakdown="vendor", limit=40),
    f"{_SPEND} SELECT payee, count(*) AS n_txns, round(CAST(sum(amount) AS DOUBLE), 2) AS total_usd, round(100 * CAST(sum(amount) AS DOUBLE) / nullif(CAST(sum(sum(amount)) OVER () AS DOUBLE), 0), 4) AS pct FROM r GROUP BY 1 ORDER BY total_usd DESC, payee NULLS LAST LIMIT 40",
)
_add(
    "api_search",
    lambda a: a.search("water", 60).withColumn("usd", F.round("usd", 2)),
    f"""WITH {TX}, every AS (SELECT 'entity' AS kind, entity_key AS name, hv_exposure AS usd FROM tier_entities WHERE {_holds('entity_name', 'WATER')} OR contains(upper(array_to_string(agencies, ' ')), 'WATER')
    UNION ALL SELECT 'agency', agency, CAST(sum(amount) AS DOUBLE) FROM tx WHERE {_holds('agency', 'WATER')} GROUP BY 2 UNION ALL SELECT 'program', appropriation_1_name, CAST(sum(amount) AS DOUBLE) FROM tx WHERE {_holds('appropriation_1_name', 'WATER')} GROUP BY 2)
    SELECT kind, name, round(usd, 2) AS usd FROM every ORDER BY kind, every.usd DESC NULLS LAST, name LIMIT 60""",
)
_add(
    "api_leads_of_a_tier",
    lambda a: a.leads(tier=2, min_amount=50_000, limit=100).select("transaction_id", "fiscal_year", "agency", "payee", *_AS("amount"), "risk_score", "status"),
    f"WITH {TX}, {_VERDICT} SELECT transaction_id, fiscal_year, agency, payee, CAST(amount AS DOUBLE) AS amount, risk_score, coalesce(verdict, 'screened_unreviewed') AS status FROM tx LEFT JOIN v USING (entity_key) WHERE tier = 2 AND tx.amount >= 50000 ORDER BY risk_score DESC NULLS LAST, tx.amount DESC, transaction_id LIMIT 100",
)
_add(
    "api_entity",
    lambda a: a.entity("roofing").select("entity_key", "entity_name", "hv_txn", "usd_tier1"),
    "SELECT entity_key, entity_name, hv_txn, usd_tier1 FROM tier_entities WHERE entity_key = 'ROOFING' OR contains(upper(entity_name), 'ROOFING') ORDER BY entity_key = 'ROOFING' DESC, usd_tier1 DESC NULLS LAST, entity_key LIMIT 1",
)
_add("api_search_findings", lambda a: a.search_findings("lease", 100), f"SELECT report_id, fiscal_year, title FROM ag_reports WHERE {_holds('title agency_raw agency_checkbook', 'LEASE')} ORDER BY fiscal_year DESC NULLS LAST, report_id LIMIT 100")
_add(
    "api_rank_audits",
    lambda a: a.rank_audits("pages", 50),
    "SELECT agency_checkbook, count(DISTINCT report_id) AS n_reports, count(*) FILTER (WHERE report_type = 'followup') AS n_followup, CAST(sum(total_pages) AS BIGINT) AS pages FROM ag_reports WHERE agency_checkbook IS NOT NULL GROUP BY 1 ORDER BY pages DESC NULLS LAST, agency_checkbook LIMIT 50",
)
_add(
    "api_rank_vendors_of_an_agency",
    lambda a: a.rank_vendors("hv_exposure", agency="water", limit=30),
    "SELECT entity_key, hv_exposure FROM tier_entities WHERE contains(upper(array_to_string(agencies, ' ')), 'WATER') ORDER BY hv_exposure DESC NULLS LAST, entity_key LIMIT 30",
)
_add(
    "api_audits_of_an_agency",
    lambda a: a.audits("DEPT OF ROADS AND BRIDGES").select("report_id", "fiscal_year", "title"),
    "SELECT report_id, fiscal_year, title FROM ag_reports WHERE agency_checkbook = 'DEPT OF ROADS AND BRIDGES'",
)
_add(
    "api_agency_card",
    lambda a: a.agency_card("DEPT OF ROADS AND BRIDGES").select("agency", "hv_txn", "n_reports", "last_report_fy", F.size("trend").cast("long").alias("n_years"), F.array_join(F.transform("top_vendors", lambda v: v.entity_key), "|").alias("top_vendors")),
    f"""WITH {TX}, x AS (SELECT * FROM tx WHERE agency = 'DEPT OF ROADS AND BRIDGES'), top AS (SELECT entity_key, sum(amount) AS usd FROM x WHERE entity_key IS NOT NULL GROUP BY 1 ORDER BY usd DESC, entity_key LIMIT 5)
    SELECT 'DEPT OF ROADS AND BRIDGES' AS agency, (SELECT count(*) FROM x) AS hv_txn, (SELECT count(*) FROM ag_reports WHERE agency_checkbook = 'DEPT OF ROADS AND BRIDGES') AS n_reports, (SELECT max(fiscal_year) FROM ag_reports WHERE agency_checkbook = 'DEPT OF ROADS AND BRIDGES') AS last_report_fy,
      (SELECT count(DISTINCT coalesce(fiscal_year, -1)) FROM x) AS n_years, (SELECT string_agg(entity_key, '|' ORDER BY CAST(usd AS DOUBLE) DESC, entity_key DESC) FROM top) AS top_vendors""",
)
