"""Queries over the ledger: cleaning, rollups, mart and screens, each with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import cleaning as X
from talus.operators import mart as M
from talus.operators import rollups as R
from talus.operators import screens as S
from talus.sources.ledger import CLEAN_SQL, LEDGER_SQL, expenditure, ledger
from talus.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _on_ledger(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda s, d: query(ledger(s, d)), f"WITH {LEDGER_SQL} {sql}")


def _on_clean(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda s, d: query(expenditure(s, d)), f"WITH {CLEAN_SQL} {sql}" if not sql.lstrip().startswith(",") else f"WITH {CLEAN_SQL}{sql}")


def _usd(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 2) AS {name}"


_N_SUM = f"count(*) AS n_txns, {_usd('sum(amount)', 'total_usd')}"

# scans, cleaning and projections
_on_ledger("ledger_scan", lambda x: R.total(x, ["fiscal_year", "kind"]), f"SELECT fiscal_year, kind, {_N_SUM} FROM ledger GROUP BY ALL")
_on_clean("clean_expenditure", lambda x: R.total(x, ["fiscal_year"]), f"SELECT fiscal_year, {_N_SUM} FROM clean GROUP BY ALL")
_on_ledger(
    "blank_and_null_text",
    lambda x: x.agg(*[F.count(c).alias(c) for c in ("vendor_id", "payee", "contract", "rail", "appropriation", "category1", "invoice")]),
    "SELECT " + ", ".join(f"count({c}) AS {c}" for c in ("vendor_id", "payee", "contract", "rail", "appropriation", "category1", "invoice")) + " FROM ledger",
)
_on_ledger(
    "entity_keys",
    lambda x: x.select(X.entity_key(F.col("payee")).alias("entity_key"), "amount").where("entity_key is not null").groupBy("entity_key").agg(F.count(F.lit(1)).alias("n_txns")),
    r"SELECT upper(trim(regexp_replace(payee, '\s+', ' ', 'g'))) AS entity_key, count(*) AS n_txns FROM ledger WHERE payee IS NOT NULL AND upper(trim(regexp_replace(payee, '\s+', ' ', 'g'))) <> '' GROUP BY 1",
)
_on_clean(
    "magnitude_bands",
    lambda x: R.total(x.withColumn("band", X.magnitude_band(F.col("amount"))), ["band"]),
    f"SELECT CASE WHEN amount >= 100000000 THEN '>=100M' WHEN amount >= 10000000 THEN '10M-100M' WHEN amount >= 1000000 THEN '1M-10M' WHEN amount >= 250000 THEN '250K-1M' WHEN amount >= 100000 THEN '100K-250K' ELSE '<100K' END AS band, {_N_SUM} FROM clean GROUP BY 1",
)
_on_clean(
    "round_flags",
    lambda x: x.agg(F.count(F.when(F.col("amount") == F.floor("amount"), 1)).alias("whole"), *[F.count(F.when(X.is_multiple(F.col("amount"), u), 1)).alias(f"round_{u}") for u in (1000, 10000, 100000, 1000000)]),
    "SELECT count(*) FILTER (WHERE amount = floor(amount)) AS whole, " + ", ".join(f"count(*) FILTER (WHERE amount >= {u} AND amount % {u} = 0) AS round_{u}" for u in (1000, 10000, 100000, 1000000)) + " FROM clean",
)
_on_clean(
    "leading_digits",
    lambda x: x.select(X.leading_digit(F.col("amount")).alias("first_digit"), X.second_digit(F.col("amount")).alias("second_digit")).groupBy("first_digit", "second_digit").agg(F.count(F.lit(1)).alias("n")),
    "SELECT left(replace(CAST(amount AS VARCHAR), '.', ''), 1) AS first_digit, nullif(substr(CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR), 2, 1), '') AS second_digit, count(*) AS n FROM clean GROUP BY ALL",
)
_on_clean(
    "period_and_type_codes",
    lambda x: x.select(X.period_number(F.col("period")).alias("fp"), X.whole_code(F.col("approp_type")).alias("approp_type")).groupBy("fp", "approp_type").agg(F.count(F.lit(1)).alias("n")),
    r"SELECT TRY_CAST(split_part(coalesce(period, ''), '.', 1) AS INTEGER) AS fp, nullif(regexp_replace(trim(approp_type), '\.0+$', ''), '') AS approp_type, count(*) AS n FROM clean GROUP BY ALL",
)

# rollups of the ledger
_on_ledger("spend_by_month", R.spend_by_month, f"SELECT fiscal_year, kind, agency, fund, category1, CAST(date_trunc('month', posting_date) AS DATE) AS month, {_N_SUM} FROM ledger GROUP BY ALL")
_on_ledger("vendor_summary", lambda x: R.total(x.where("kind = 'EX'"), ["fiscal_year", "payee", "vendor_id"]), f"SELECT fiscal_year, payee, vendor_id, {_N_SUM} FROM ledger WHERE kind = 'EX' GROUP BY ALL")
_on_ledger("agency_summary", lambda x: R.total(x, ["fiscal_year", "kind", "agency"]), f"SELECT fiscal_year, kind, agency, {_N_SUM} FROM ledger GROUP BY ALL")
_on_ledger(
    "spend_summary",
    lambda x: R.spend_summary(x).withColumn("total_usd", F.round(F.col("total_usd").cast("double"), 4)),
    "SELECT agency, fiscal_year, kind, category1, category2, category3, appropriation, round(CAST(sum(amount) AS DOUBLE), 4) AS total_usd, count(*) AS n_txns FROM ledger GROUP BY ALL",
)
_on_ledger(
    "spend_total_from_rollup",
    lambda x: R.spend_summary(x).where("kind = 'EX'").groupBy("agency").agg(F.sum("n_txns").alias("n_txns"), F.sum("total_usd").alias("_s")).select("agency", "n_txns", R.money("_s", "total_usd")),
    f"SELECT agency, {_N_SUM} FROM ledger WHERE kind = 'EX' GROUP BY 1",
)
for _by in ("category2", "fiscal_year", "payee"):
    _on_ledger(
        f"spend_breakdown_{_by}",
        lambda x, by=_by: R.spend_breakdown(x.where("kind = 'EX'"), by, "amount", F.count(F.lit(1))).orderBy(F.desc("total_usd"), F.asc_nulls_last(by)).limit(25),
        f"SELECT {_by}, {_N_SUM}, round(100 * CAST(sum(amount) AS DOUBLE) / nullif(CAST(sum(sum(amount)) OVER () AS DOUBLE), 0), 4) AS pct FROM ledger WHERE kind = 'EX' GROUP BY 1 ORDER BY total_usd DESC, {_by} ASC NULLS LAST LIMIT 25",
    )
_BUCKET = "CASE WHEN upper(trim(coalesce(payee, ''))) = '' THEN 'blank' WHEN upper(trim(payee)) IN ('NOT AVAILABLE', 'N/A', 'NA', 'UNKNOWN') THEN 'na' WHEN contains(upper(payee), 'REDACT') OR contains(upper(payee), 'WITHHELD') THEN 'redacted' WHEN contains(upper(payee), 'CONFIDENTIAL') THEN 'confidential' ELSE 'named' END"
_on_ledger(
    "unattributed_buckets",
    lambda x: R.total(x.where("kind = 'EX'").withColumn("bucket", X.unattributed_bucket(F.col("payee"))), ["bucket"]),
    f"SELECT {_BUCKET} AS bucket, {_N_SUM} FROM ledger WHERE kind = 'EX' GROUP BY 1",
)


def _unattributed(x: DataFrame) -> DataFrame:
    hidden = X.unattributed_bucket(F.col("payee")) != "named"
    out = x.where("kind = 'EX' and agency is not null").groupBy("agency").agg(F.sum("amount").alias("_all"), F.sum(F.when(hidden, F.col("amount"))).alias("_dark"), F.count(F.when(hidden, 1)).alias("n_dark"))
    return out.where("_all > 0 and _dark > 0").select("agency", R.money("_all", "total_usd"), R.money("_dark", "dark_usd"), "n_dark", F.round(100 * F.col("_dark").cast("double") / F.col("_all").cast("double"), 4).alias("dark_pct"))


_on_ledger(
    "unattributed_by_agency",
    _unattributed,
    f"SELECT agency, {_usd('sum(amount)', 'total_usd')}, {_usd(f'sum(amount) FILTER (WHERE {_BUCKET} <> {chr(39)}named{chr(39)})', 'dark_usd')}, count(*) FILTER (WHERE {_BUCKET} <> 'named') AS n_dark,"
    f" round(100 * CAST(sum(amount) FILTER (WHERE {_BUCKET} <> 'named') AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 4) AS dark_pct FROM ledger WHERE kind = 'EX' AND agency IS NOT NULL GROUP BY 1 HAVING sum(amount) > 0 AND sum(amount) FILTER (WHERE {_BUCKET} <> 'named') > 0",
)

# the feature mart
_FLOOR = M.MartConfig().floor
_on_clean("mart_vendor_year", lambda x: M.vendor_year(x).withColumn("vendor_year_total", F.round(F.col("vendor_year_total").cast("double"), 2)), f"SELECT vid, fiscal_year, {_usd('sum(amount)', 'vendor_year_total')}, count(*) AS vendor_year_txns FROM clean WHERE vid IS NOT NULL GROUP BY ALL")
_on_clean("mart_vendor_first_year", M.vendor_first, "SELECT vid, min(fiscal_year) AS vendor_first_year, count(DISTINCT fiscal_year) AS vendor_years_active FROM clean WHERE vid IS NOT NULL GROUP BY 1")
_on_clean("mart_appropriation_year", lambda x: M.appropriation_year(x).withColumn("approp_year_total", F.round(F.col("approp_year_total").cast("double"), 2)), f"SELECT appropriation, fiscal_year, {_usd('sum(amount)', 'approp_year_total')}, count(*) AS approp_year_txns FROM clean GROUP BY ALL")
_on_clean(
    "mart_duplicate_signatures",
    lambda x: M.duplicate_signatures(x).withColumn("amount", F.col("amount").cast("double")).withColumn("dup_day_span", F.col("dup_day_span").cast("long")),
    "SELECT vid, ref, CAST(amount AS DOUBLE) AS amount, count(DISTINCT txn) AS dup_distinct_txn, count(*) AS dup_rows, max(posting_date) - min(posting_date) AS dup_day_span FROM clean WHERE vid IS NOT NULL AND ref IS NOT NULL GROUP BY vid, ref, clean.amount HAVING count(DISTINCT txn) > 1",
)
_on_clean(
    "mart_true_duplicates",
    lambda x: M.true_duplicates(x, (1, 90)).withColumn("amount", F.col("amount").cast("double")).withColumn("day_span", F.col("day_span").cast("long")),
    "SELECT vid, CAST(amount AS DOUBLE) AS amount, count(DISTINCT ref) AS n_refs, count(DISTINCT txn) AS n_txns, max(posting_date) - min(posting_date) AS day_span FROM clean WHERE vid IS NOT NULL AND ref IS NOT NULL GROUP BY vid, clean.amount"
    " HAVING count(DISTINCT ref) >= 2 AND count(DISTINCT txn) >= 2 AND max(posting_date) - min(posting_date) BETWEEN 1 AND 90",
)
_PEERS = f"SELECT agency, category1, count(*) AS ac_n, median(CAST(amount AS DOUBLE)) AS ac_median, quantile_cont(CAST(amount AS DOUBLE), 0.25) AS ac_q1, quantile_cont(CAST(amount AS DOUBLE), 0.75) AS ac_q3 FROM clean WHERE amount >= {_FLOOR} GROUP BY ALL"
_on_clean(
    "mart_peer_stats",
    lambda x: M.peer_stats(x, _FLOOR).select("agency", "category1", "ac_n", *[F.round(c, 4).alias(c) for c in ("ac_median", "ac_q1", "ac_q3")]),
    f"SELECT agency, category1, ac_n, round(ac_median, 4) AS ac_median, round(ac_q1, 4) AS ac_q1, round(ac_q3, 4) AS ac_q3 FROM ({_PEERS})",
)
_on_clean("mart_contract_rate", lambda x: M.contract_rate(x).withColumn("contract_rate", F.round("contract_rate", 6)), "SELECT agency, fiscal_year, round(count(contract)::DOUBLE / count(*), 6) AS contract_rate FROM clean GROUP BY ALL")
_on_clean("mart_payee_profile", M.payee_profile, r"SELECT nullif(upper(trim(regexp_replace(payee, '\s+', ' ', 'g'))), '') AS entity_key, min(fiscal_year) AS first_fy, count(*) AS n_txns FROM clean WHERE payee IS NOT NULL GROUP BY 1")
_MART_COLUMNS = ["record_number", "txn", "fiscal_year", "agency", "vid", "mag_band", "is_whole_dollar", "is_round_10000", "first_digit", "vendor_first_appearance", "vendor_share_of_agency_year", "in_dup_signature", "in_dup_diffday", "ac_n", "robust_z_in_agencycat", "vendor_year_txns", "vendor_years_active"]
_on_clean(
    "feature_mart",
    lambda x: M.feature_mart(x).select(*_MART_COLUMNS, F.col("amount").cast("double").alias("amount")),
    f""", vy AS (SELECT vid, fiscal_year, sum(amount) AS t, count(*) AS n FROM clean WHERE vid IS NOT NULL GROUP BY ALL),
    vf AS (SELECT vid, min(fiscal_year) AS y, count(DISTINCT fiscal_year) AS k FROM clean WHERE vid IS NOT NULL GROUP BY ALL),
    ay AS (SELECT agency, fiscal_year, sum(amount) AS t FROM clean GROUP BY ALL), vay AS (SELECT vid, agency, fiscal_year, sum(amount) AS t FROM clean WHERE vid IS NOT NULL GROUP BY ALL),
    dup AS (SELECT vid, ref, amount, max(posting_date) - min(posting_date) AS span FROM clean WHERE vid IS NOT NULL AND ref IS NOT NULL GROUP BY ALL HAVING count(DISTINCT txn) > 1), ac AS ({_PEERS})
    SELECT c.record_number, c.txn, c.fiscal_year, c.agency, c.vid,
      CASE WHEN c.amount >= 100000000 THEN '>=100M' WHEN c.amount >= 10000000 THEN '10M-100M' WHEN c.amount >= 1000000 THEN '1M-10M' WHEN c.amount >= 250000 THEN '250K-1M' WHEN c.amount >= 100000 THEN '100K-250K' ELSE '<100K' END AS mag_band,
      c.amount = floor(c.amount) AS is_whole_dollar, c.amount >= 10000 AND c.amount % 10000 = 0 AS is_round_10000, left(replace(CAST(c.amount AS VARCHAR), '.', ''), 1) AS first_digit,
      vf.y = c.fiscal_year AS vendor_first_appearance, round(CAST(vay.t AS DOUBLE) / nullif(CAST(ay.t AS DOUBLE), 0), 6) AS vendor_share_of_agency_year, dup.vid IS NOT NULL AS in_dup_signature, coalesce(dup.span > 0, false) AS in_dup_diffday,
      ac.ac_n, CASE WHEN ac.ac_n >= 8 THEN round((CAST(c.amount AS DOUBLE) - ac.ac_median) / nullif(ac.ac_q3 - ac.ac_q1, 0), 6) END AS robust_z_in_agencycat, vy.n AS vendor_year_txns, vf.k AS vendor_years_active, CAST(c.amount AS DOUBLE) AS amount
    FROM clean c LEFT JOIN vy ON vy.vid = c.vid AND vy.fiscal_year = c.fiscal_year LEFT JOIN vf ON vf.vid = c.vid LEFT JOIN ay ON ay.agency = c.agency AND ay.fiscal_year = c.fiscal_year
      LEFT JOIN vay ON vay.vid = c.vid AND vay.agency = c.agency AND vay.fiscal_year = c.fiscal_year LEFT JOIN dup ON dup.vid = c.vid AND dup.ref = c.ref AND dup.amount = c.amount LEFT JOIN ac ON ac.agency = c.agency AND ac.category1 = c.category1
    WHERE c.amount >= {_FLOOR}""",
)
_on_clean(
    "mart_build_summary",
    lambda x: x.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("amount") >= _FLOOR, 1)).alias("n_mart"), F.count(F.when(F.col("amount") >= 1_000_000, 1)).alias("n_million"), F.count("vid").alias("n_vendor")),
    f"SELECT count(*) AS n, count(*) FILTER (WHERE amount >= {_FLOOR}) AS n_mart, count(*) FILTER (WHERE amount >= 1000000) AS n_million, count(vid) AS n_vendor FROM clean",
)

# screens and profiles
_BENFORD = "SELECT agency, max(all_n) AS n, round(avg(abs(n::DOUBLE / all_n - {law})), 6) AS mad FROM (SELECT agency, d, n, sum(n) OVER (PARTITION BY agency)::BIGINT AS all_n FROM (SELECT agency, TRY_CAST({digit} AS INTEGER) AS d, count(*) AS n FROM clean WHERE agency IS NOT NULL GROUP BY ALL) WHERE d >= {low}) WHERE all_n >= 50 GROUP BY 1"
_on_clean("benford_first_digit", lambda x: S.digit_deviation(x, "agency", 50), _BENFORD.format(law="log10(1 + 1.0::DOUBLE / d)", digit="left(replace(CAST(amount AS VARCHAR), '.', ''), 1)", low=1))
_on_clean(
    "benford_second_digit",
    lambda x: S.digit_deviation(x, "agency", 50, "second"),
    _BENFORD.format(law="(" + " + ".join(f"log10(1 + 1.0::DOUBLE / ({10 * k} + d))" for k in range(1, 10)) + ")", digit="substr(CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR), 2, 1)", low=0),
)
_on_clean(
    "structuring_ratio",
    lambda x: S.structuring(x, 5000, 250, 1, 15),
    "SELECT agency, count(*) FILTER (WHERE amount >= 4750 AND amount < 5000) AS n_under, count(*) FILTER (WHERE amount >= 5000 AND amount < 5250) AS n_over, round(n_under / nullif(n_over::DOUBLE, 0), 4) AS ratio FROM clean WHERE agency IS NOT NULL GROUP BY 1 HAVING n_under >= 1 ORDER BY ratio DESC NULLS FIRST, agency LIMIT 15",
)
_on_clean(
    "structuring_ratio_10k",
    lambda x: S.structuring(x, 10_000, 500, 1, 15),
    "SELECT agency, count(*) FILTER (WHERE amount >= 9500 AND amount < 10000) AS n_under, count(*) FILTER (WHERE amount >= 10000 AND amount < 10500) AS n_over, round(n_under / nullif(n_over::DOUBLE, 0), 4) AS ratio FROM clean WHERE agency IS NOT NULL GROUP BY 1 HAVING n_under >= 1 ORDER BY ratio DESC NULLS FIRST, agency LIMIT 15",
)
_INVOICES = "SELECT fiscal_year, vid, invoice, amount, count(*) AS copies FROM clean WHERE vid IS NOT NULL AND invoice IS NOT NULL GROUP BY ALL HAVING count(*) > 1"
_on_clean(
    "invoice_duplicates_summary",
    lambda x: S.invoice_duplicates(x).groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("groups"), F.sum("extra").alias("extra"), F.sum("potential").alias("_p")).select("fiscal_year", "groups", "extra", R.money("_p", "potential")),
    f"SELECT fiscal_year, count(*) AS groups, CAST(sum(copies - 1) AS BIGINT) AS extra, {_usd('sum((copies - 1) * amount)', 'potential')} FROM ({_INVOICES}) GROUP BY 1",
)
_on_clean(
    "invoice_duplicates_top",
    lambda x: S.invoice_duplicates(x).orderBy(F.desc("potential"), "fiscal_year", "vid", "invoice").limit(12).select("fiscal_year", "vid", "invoice", "copies", R.money("potential", "potential")),
    f"SELECT fiscal_year, vid, invoice, copies, {_usd('(copies - 1) * amount', 'potential')} FROM ({_INVOICES}) ORDER BY (copies - 1) * amount DESC, fiscal_year, vid, invoice LIMIT 12",
)
_on_clean(
    "yearly_spikes",
    lambda x: S.yearly_spikes(x, 100_000, 10.0),
    f"SELECT vid, fiscal_year, prev_year, {_usd('s', 'total_usd')}, {_usd('p', 'prev_usd')}, round(CAST(s AS DOUBLE) / CAST(p AS DOUBLE), 4) AS ratio FROM (SELECT vid, fiscal_year, s, lag(s) OVER w AS p, lag(fiscal_year) OVER w AS prev_year FROM (SELECT vid, fiscal_year, sum(amount) AS s FROM clean WHERE vid IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY vid ORDER BY fiscal_year)) WHERE s >= 100000 AND p > 0 AND CAST(s AS DOUBLE) / CAST(p AS DOUBLE) >= 10",
)
_on_clean(
    "hourly_rate_outliers",
    lambda x: x.agg(F.count(F.when(F.col("hourly_rate") > 200, 1)).alias("over_200"), F.count(F.when(F.col("hourly_rate") > 500, 1)).alias("over_500"), F.max("hourly_rate").cast("double").alias("max_rate")),
    "SELECT count(*) FILTER (WHERE hourly_rate > 200) AS over_200, count(*) FILTER (WHERE hourly_rate > 500) AS over_500, CAST(max(hourly_rate) AS DOUBLE) AS max_rate FROM clean",
)
_on_ledger(
    "sentinel_tally",
    lambda x: R.total(x.where(X.is_sentinel(F.col("amount"))), ["fiscal_year"]),
    f"SELECT fiscal_year, {_N_SUM} FROM ledger WHERE abs(amount) BETWEEN {X.SENTINEL_LOW} AND {X.SENTINEL_HIGH} GROUP BY 1",
)
_POINTS = [0.5, 0.9, 0.99, 0.999, 0.9999]
_on_clean("amount_quantiles", lambda x: S.quantiles(x, _POINTS), "SELECT count(*) AS n, " + ", ".join(f"round(quantile_cont(CAST(amount AS DOUBLE), {p}), 4) AS p{str(p)[2:]}" for p in _POINTS) + " FROM clean")
_STEPS = [1_000, 5_000, 10_000, 25_000, 100_000, 250_000, 1_000_000, 10_000_000]
_on_clean(
    "amount_strata",
    lambda x: S.strata(x, _STEPS),
    f"SELECT t.threshold, count(*) AS n, {_usd('sum(amount)', 'total_usd')}, round(100.0 * count(*) / (SELECT count(*) FROM clean), 4) AS pct_n, round(100 * CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM clean), 4) AS pct_usd"
    f" FROM clean JOIN (VALUES {', '.join(f'({t})' for t in _STEPS)}) t(threshold) ON amount >= t.threshold GROUP BY 1",
)
_FIELDS = ["vid", "payee", "contract", "rail", "appropriation", "invoice", "period", "protection", "description"]
_on_clean("field_coverage", lambda x: S.coverage(x, _FIELDS), "SELECT fiscal_year, count(*) AS n, " + ", ".join(f"round(100.0 * count({c}) / count(*), 4) AS {c}_pct" for c in _FIELDS) + " FROM clean GROUP BY 1")
for _name, _by, _where, _top in (("rail", ["rail"], "", 25), ("approp_type", ["approp_type"], "", 25), ("period", ["period"], "", 30), ("million_category", ["category1"], "amount >= 1000000", 25), ("million_protection_rail", ["protection", "rail"], "amount >= 1000000", 20)):
    _on_clean(
        f"distribution_{_name}",
        lambda x, by=_by, where=_where, top=_top: S.distribution(x.where(where) if where else x, by, top),
        f"SELECT {', '.join(f'coalesce({c}, {chr(39)}(null){chr(39)}) AS {c}' for c in _by)}, count(*) AS n, {_usd('sum(amount)', 'total_usd')} FROM clean {'WHERE ' + _where if _where else ''} GROUP BY ALL ORDER BY n DESC, {', '.join(str(i + 1) for i in range(len(_by)))} LIMIT {_top}",
    )
_on_clean(
    "weekend_and_round_share",
    lambda x: x.groupBy("fiscal_year").agg(F.round(100.0 * F.count(F.when(F.dayofweek("posting_date").isin(1, 7), 1)) / F.count(F.lit(1)), 4).alias("weekend_pct"), F.round(100.0 * F.count(F.when(F.col("amount") % 1000 == 0, 1)) / F.count(F.lit(1)), 4).alias("round_pct")),
    "SELECT fiscal_year, round(100.0 * count(*) FILTER (WHERE dayofweek(posting_date) IN (0, 6)) / count(*), 4) AS weekend_pct, round(100.0 * count(*) FILTER (WHERE amount % 1000 = 0) / count(*), 4) AS round_pct FROM clean GROUP BY 1",
)


def _concentration(x: DataFrame) -> DataFrame:
    """Largest vendor's share per year and agency, payments to itself left out."""
    from pyspark.sql import Window

    rows = x.where("vid is not null and agency is not null and not coalesce(upper(payee) = upper(agency), false)").groupBy("fiscal_year", "agency", "vid").agg(F.sum("amount").alias("_s"))
    group = Window.partitionBy("fiscal_year", "agency")
    rows = rows.withColumn("_all", F.sum("_s").over(group)).withColumn("rn", F.row_number().over(group.orderBy(F.desc("_s"), "vid")))
    return rows.where("rn = 1").select("fiscal_year", "agency", "vid", R.money("_s", "vendor_usd"), F.round(100 * F.col("_s").cast("double") / F.col("_all").cast("double"), 4).alias("share_pct"))


_on_clean(
    "vendor_concentration",
    _concentration,
    f"SELECT fiscal_year, agency, vid, {_usd('s', 'vendor_usd')}, round(100 * CAST(s AS DOUBLE) / CAST(a AS DOUBLE), 4) AS share_pct FROM (SELECT *, sum(s) OVER (PARTITION BY fiscal_year, agency) AS a, row_number() OVER (PARTITION BY fiscal_year, agency ORDER BY s DESC, vid) AS rn FROM (SELECT fiscal_year, agency, vid, sum(amount) AS s FROM clean WHERE vid IS NOT NULL AND agency IS NOT NULL AND NOT coalesce(upper(payee) = upper(agency), false) GROUP BY ALL)) WHERE rn = 1",
)


def _fiscal_panel(s: SparkSession, d: str) -> DataFrame:
    """Revenue, expenditure, net, margin and federal share per year, fillers counted apart."""
    x = ledger(s, d)
    real, federal = ~X.is_sentinel(F.col("amount")), F.coalesce(F.col("fund").contains("FEDERAL"), F.lit(False))
    rv, ex = (F.col("kind") == "RV") & real, (F.col("kind") == "EX") & real
    out = x.groupBy("fiscal_year").agg(F.sum(F.when(rv, F.col("amount"))).alias("r"), F.sum(F.when(ex, F.col("amount"))).alias("e"), F.sum(F.when(rv & federal, F.col("amount"))).alias("f"), F.count(F.when(~real, 1)).alias("sentinels"))
    r, e, f = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in "ref")
    out = out.select("fiscal_year", F.round(r, 2).alias("revenue"), F.round(e, 2).alias("expenditure"), F.round(r - e, 2).alias("net"), F.round(100 * (r - e) / F.nullif(r, F.lit(0.0)), 4).alias("net_margin_pct"), F.round(100 * f / F.nullif(r, F.lit(0.0)), 4).alias("federal_pct"), "sentinels")
    return out


_PANEL = "SELECT fiscal_year, round(r, 2) AS revenue, round(e, 2) AS expenditure, round(r - e, 2) AS net, round(100 * (r - e) / nullif(r, 0), 4) AS net_margin_pct, round(100 * f / nullif(r, 0), 4) AS federal_pct, sentinels FROM (SELECT fiscal_year, coalesce(CAST(sum(amount) FILTER (WHERE kind = 'RV' AND NOT s) AS DOUBLE), 0) AS r, coalesce(CAST(sum(amount) FILTER (WHERE kind = 'EX' AND NOT s) AS DOUBLE), 0) AS e, coalesce(CAST(sum(amount) FILTER (WHERE kind = 'RV' AND NOT s AND contains(fund, 'FEDERAL')) AS DOUBLE), 0) AS f, count(*) FILTER (WHERE s) AS sentinels FROM (SELECT *, abs(amount) BETWEEN 99999999 AND 100000000 AS s FROM ledger) GROUP BY 1)"
_add("fiscal_panel", _fiscal_panel, f"WITH {LEDGER_SQL} {_PANEL}")


def _fiscal_scorecard(s: SparkSession, d: str) -> DataFrame:
    """The panel turned into one row per year and measure, with its band."""
    panel = _fiscal_panel(s, d).withColumn("sentinels", F.col("sentinels").cast("double"))
    long = panel.unpivot("fiscal_year", ["net_margin_pct", "federal_pct", "sentinels"], "measure", "value")
    v = F.col("value")
    band = (
        F.when(v.isNull(), "unknown")
        .when(F.col("measure") == "net_margin_pct", F.when(v >= 2, "favorable").when(v >= -2, "balanced").otherwise("watch"))
        .when(F.col("measure") == "federal_pct", F.when(v <= 40, "lower").when(v <= 45, "moderate").otherwise("elevated"))
        .otherwise(F.when(v <= 25, "low").when(v <= 75, "moderate").otherwise("elevated"))
    )
    return long.withColumn("band", band)


_add(
    "fiscal_scorecard",
    _fiscal_scorecard,
    f"WITH {LEDGER_SQL}, panel AS ({_PANEL}), long AS (SELECT fiscal_year, 'net_margin_pct' AS measure, net_margin_pct AS value FROM panel UNION ALL SELECT fiscal_year, 'federal_pct', federal_pct FROM panel UNION ALL SELECT fiscal_year, 'sentinels', CAST(sentinels AS DOUBLE) FROM panel)"
    " SELECT *, CASE WHEN value IS NULL THEN 'unknown' WHEN measure = 'net_margin_pct' THEN CASE WHEN value >= 2 THEN 'favorable' WHEN value >= -2 THEN 'balanced' ELSE 'watch' END WHEN measure = 'federal_pct' THEN CASE WHEN value <= 40 THEN 'lower' WHEN value <= 45 THEN 'moderate' ELSE 'elevated' END ELSE CASE WHEN value <= 25 THEN 'low' WHEN value <= 75 THEN 'moderate' ELSE 'elevated' END END AS band FROM long",
)
_on_ledger(
    "federal_dependency_by_agency",
    lambda x: x.where("kind = 'RV' and agency is not null").groupBy("agency", "fiscal_year").agg(F.sum("amount").alias("a"), F.sum(F.when(F.col("fund").contains("FEDERAL"), F.col("amount"))).alias("f")).select("agency", "fiscal_year", R.money("a", "revenue"), R.money(F.coalesce("f", F.lit(0)), "federal"), F.round(100 * F.coalesce(F.col("f").cast("double"), F.lit(0.0)) / F.nullif(F.col("a").cast("double"), F.lit(0.0)), 4).alias("federal_pct")),
    f"SELECT agency, fiscal_year, {_usd('sum(amount)', 'revenue')}, {_usd(chr(99) + 'oalesce(sum(amount) FILTER (WHERE contains(fund, ' + chr(39) + 'FEDERAL' + chr(39) + ')), 0)', 'federal')}, round(100 * coalesce(CAST(sum(amount) FILTER (WHERE contains(fund, 'FEDERAL')) AS DOUBLE), 0) / nullif(CAST(sum(amount) AS DOUBLE), 0), 4) AS federal_pct FROM ledger WHERE kind = 'RV' AND agency IS NOT NULL GROUP BY ALL",
)
_on_clean(
    "duplicate_payment_groups",
    lambda x: M.duplicate_signatures(x).where("dup_day_span > 0").groupBy("vid").agg(F.count(F.lit(1)).alias("groups"), F.sum("dup_rows").alias("rows"), F.sum(F.col("amount") * (F.col("dup_rows") - 1)).alias("_p")).select("vid", "groups", "rows", R.money("_p", "potential")),
    f"SELECT vid, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, {_usd('sum(amount * (n - 1))', 'potential')} FROM (SELECT vid, ref, amount, count(*) AS n FROM clean WHERE vid IS NOT NULL AND ref IS NOT NULL GROUP BY ALL HAVING count(DISTINCT txn) > 1 AND max(posting_date) - min(posting_date) > 0) GROUP BY 1",
)
