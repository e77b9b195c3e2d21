"""Queries over scored payments, entities and verdicts, each with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from talus.functions import cleaning as X
from talus.operators import entities as E
from talus.operators import rollups as R
from talus.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """The scored payments, exact repeats once, with the payee's name key."""
    return table(spark, folder, "tx_tiered").distinct().withColumn("entity_key", X.entity_key(F.col("payee")))


_KEY = r"nullif(upper(trim(regexp_replace({c}, '\s+', ' ', 'g'))), '')"
TX = f"tx AS (SELECT *, {_KEY.format(c='payee')} AS entity_key FROM (SELECT DISTINCT * FROM tx_tiered))"


def _on_scored(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda s, d: query(scored(s, d))
    SQL[name] = f"WITH {TX}{sql}" if sql.lstrip().startswith(",") else f"WITH {TX} {sql}"


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _usd(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 2) AS {name}"


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    for a in arrays:
        df = df.withColumn(a, F.array_join(a, "|"))
    return df


def _top_sql(keys: str, k: int, where: str = "true") -> str:
    names = keys.split(", ")
    return f"tm AS (SELECT {keys}, string_agg(marker, '|' ORDER BY rn) AS top_markers FROM (SELECT {keys}, marker, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, marker) AS rn FROM (SELECT {keys}, unnest(fired_markers) AS marker FROM tx WHERE {where}) WHERE marker IS NOT NULL GROUP BY {', '.join(names)}, marker) WHERE rn <= {k} GROUP BY {keys})"


_on_scored("tier_waterfall", R.waterfall, f"SELECT tier, count(*) AS n, {_usd('sum(amount)', 'exposure')}, round(CAST(sum(amount) AS DOUBLE) / count(*), 2) AS avg_amount, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct_n, round(100 * CAST(sum(amount) AS DOUBLE) / CAST(sum(sum(amount)) OVER () AS DOUBLE), 4) AS pct_usd FROM tx GROUP BY 1")
_on_scored("tier_distribution", R.tier_distribution, f"SELECT CAST(fiscal_year AS VARCHAR) AS fy, tier, count(*) AS n, {_usd('sum(amount)', 'exposure')} FROM tx GROUP BY 1, 2 UNION ALL SELECT 'ALL', tier, count(*), round(CAST(sum(amount) AS DOUBLE), 2) FROM tx GROUP BY 2")
_on_scored(
    "score_summary",
    lambda x: x.agg(F.round(F.avg("risk_score"), 6).alias("mean"), F.round(F.percentile("risk_score", F.lit(0.99)), 6).alias("p99"), F.max("risk_score").alias("max"), F.round(100.0 * F.count(F.when(F.col("risk_score") == 0, 1)) / F.count(F.lit(1)), 4).alias("clean_pct")),
    "SELECT round(avg(risk_score), 6) AS mean, round(quantile_cont(risk_score, 0.99), 6) AS p99, max(risk_score) AS max, round(100.0 * count(*) FILTER (WHERE risk_score = 0) / count(*), 4) AS clean_pct FROM tx",
)
_on_scored("top_markers_by_agency", lambda x: _joined(R.top_markers(x, ["agency"], "fired_markers", 5), "top_markers"), f", {_top_sql('agency', 5)} SELECT agency, top_markers FROM tm")
_on_scored(
    "agency_scorecard",
    lambda x: _joined(R.agency_scorecard(x), "top_markers"),
    f", {_top_sql('agency', 5, 'agency IS NOT NULL')} SELECT a.*, tm.top_markers FROM (SELECT agency, count(*) AS hv_txn, count(*) FILTER (WHERE tier = 1) AS n_tier1, count(*) FILTER (WHERE tier = 2) AS n_tier2, count(*) FILTER (WHERE tier = 3) AS n_tier3, count(*) FILTER (WHERE marker_sum > 0) AS n_flagged,"
    f" count(DISTINCT vid) FILTER (WHERE marker_sum > 0) AS flagged_vendors, round(avg(risk_score), 4) AS avg_risk_score, max(risk_score) AS max_risk_score, {_usd('sum(amount)', 'hv_exposure')}, {_usd('sum(amount) FILTER (WHERE tier = 1)', 'usd_tier1')}, {_usd('sum(amount) FILTER (WHERE tier = 2)', 'usd_tier2')},"
    " round(100 * coalesce(CAST(sum(amount) FILTER (WHERE tier <= 2) AS DOUBLE), 0) / nullif(CAST(sum(amount) AS DOUBLE), 0), 4) AS tier12_pct FROM tx WHERE agency IS NOT NULL GROUP BY 1) a LEFT JOIN tm USING (agency)",
)
_on_scored("agency_year", R.agency_year, f"SELECT agency, fiscal_year, count(*) AS hv_txn, count(*) FILTER (WHERE tier = 1) AS n_tier1, count(*) FILTER (WHERE tier = 2) AS n_tier2, max(risk_score) AS max_risk_score, {_usd('sum(amount)', 'hv_exposure')}, {_usd('sum(amount) FILTER (WHERE tier <= 2)', 'usd_tier12')} FROM tx GROUP BY ALL")
_on_scored(
    "vendor_flagged",
    R.vendor_flagged,
    f"SELECT vid, mode() WITHIN GROUP (ORDER BY payee) AS payee, mode() WITHIN GROUP (ORDER BY agency) AS primary_agency, count(*) AS hv_txn, {_usd('sum(amount)', 'hv_exposure')}, count(*) FILTER (WHERE tier = 1) AS n_tier1, count(*) FILTER (WHERE tier = 2) AS n_tier2, max(vendor_share_of_agency_year) AS peak_share, bool_or(name_is_new) AS any_new_name, min(tier) AS top_tier, count(DISTINCT agency) AS n_agencies FROM tx WHERE vid IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE tier <= 2) > 0",
)
_on_scored(
    "program_summary",
    R.program_summary,
    f"SELECT coalesce(appropriation_1_name, '(no appropriation)') AS program, count(*) AS hv_txn, count(*) FILTER (WHERE tier = 1) AS n_tier1, count(DISTINCT agency) AS n_agencies, {_usd('sum(amount)', 'hv_exposure')}, {_usd('sum(amount) FILTER (WHERE tier = 1)', 'usd_tier1')} FROM tx GROUP BY 1 HAVING count(*) FILTER (WHERE tier = 1) > 0",
)
_on_scored(
    "entity_rollup",
    lambda x: _joined(R.entity_rollup(x, "entity_key"), "agencies", "top_markers"),
    f", {_top_sql('entity_key', 5, 'entity_key IS NOT NULL')} SELECT e.*, tm.top_markers FROM (SELECT entity_key, mode() WITHIN GROUP (ORDER BY payee) AS entity_name, count(DISTINCT vendor_id_code) AS n_vendor_ids, count(*) AS hv_txn, {_usd('sum(amount)', 'hv_exposure')}, count(*) FILTER (WHERE marker_sum > 0) AS n_flagged, {_usd('sum(amount) FILTER (WHERE marker_sum > 0)', 'flagged_exposure')},"
    " count(*) FILTER (WHERE tier = 1) AS n_tier1, count(*) FILTER (WHERE tier = 2) AS n_tier2, min(tier) AS top_tier, max(risk_score) AS max_risk_score, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, count(DISTINCT agency) AS n_agencies, coalesce(string_agg(DISTINCT agency, '|' ORDER BY agency), '') AS agencies FROM tx WHERE entity_key IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE marker_sum > 0) > 0) e LEFT JOIN tm USING (entity_key)",
)
_on_scored("primary_agency", lambda x: R.primary(x, "entity_key", "agency", "amount"), "SELECT entity_key, agency FROM (SELECT entity_key, agency, row_number() OVER (PARTITION BY entity_key ORDER BY sum(amount) DESC, agency) AS rn FROM tx WHERE entity_key IS NOT NULL AND agency IS NOT NULL GROUP BY entity_key, agency) WHERE rn = 1")
_on_scored(
    "entity_transaction_lists",
    lambda x: R.transaction_lists(x, "entity_key", 15).select("entity_key", F.array_join(F.transform("transactions", lambda t: F.concat_ws(":", t.rn, t.fy, t.txn, t.tier)), "|").alias("transactions")),
    "SELECT entity_key, string_agg(concat_ws(':', rn, fiscal_year, transaction_id, tier), '|' ORDER BY rn) AS transactions FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY risk_score DESC NULLS LAST, amount DESC NULLS LAST, transaction_id, record_number) AS rn FROM tx WHERE entity_key IS NOT NULL) WHERE rn <= 15 GROUP BY 1",
)


def _ranked(x: DataFrame) -> DataFrame:
    order = [F.desc_nulls_last("risk_score"), F.desc("amount"), F.asc("transaction_id")]
    first = x.where("tier = 1").orderBy(*order).limit(100)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "transaction_id", "agency", R.money("amount", "amount"), "risk_score", F.array_join("fired_markers", "|").alias("markers"))


_on_scored("top_transactions", _ranked, f"SELECT row_number() OVER (ORDER BY risk_score DESC NULLS LAST, amount DESC, transaction_id) AS rank, transaction_id, agency, {_usd('amount', 'amount')}, risk_score, array_to_string(fired_markers, '|') AS markers FROM (SELECT * FROM tx WHERE tier = 1 ORDER BY risk_score DESC NULLS LAST, amount DESC, transaction_id LIMIT 100)")


def _targets(x: DataFrame) -> DataFrame:
    """Vendors among the first 40 by flagged money or the first 25 by score."""
    sums = x.where("vid is not null and tier <= 2").groupBy("vid").agg(F.sum("amount").alias("s"), F.max("risk_score").alias("r"))
    by_usd = sums.orderBy(F.desc("s"), "vid").limit(40).select("vid", F.lit(True).alias("by_usd"))
    by_score = sums.orderBy(F.desc_nulls_last("r"), "vid").limit(25).select("vid", F.lit(True).alias("by_score"))
    return by_usd.join(by_score, "vid", "full").select("vid", F.coalesce("by_usd", F.lit(False)).alias("by_usd"), F.coalesce("by_score", F.lit(False)).alias("by_score"))


_on_scored("vendor_targets", _targets, "SELECT vid, u <= 40 AS by_usd, r <= 25 AS by_score FROM (SELECT vid, row_number() OVER (ORDER BY sum(amount) DESC, vid) AS u, row_number() OVER (ORDER BY max(risk_score) DESC NULLS LAST, vid) AS r FROM tx WHERE vid IS NOT NULL AND tier <= 2 GROUP BY vid) WHERE u <= 40 OR r <= 25")
_on_scored(
    "accountability_clusters",
    lambda x: x.groupBy("agency", "category1").agg(*[F.count(F.when(F.array_contains("fired_markers", m), 1)).alias(m) for m in ("masked_payee", "offcontract")], F.count(F.lit(1)).alias("n")).where("masked_payee + offcontract >= 2"),
    "SELECT agency, category1, count(*) FILTER (WHERE list_contains(fired_markers, 'masked_payee')) AS masked_payee, count(*) FILTER (WHERE list_contains(fired_markers, 'offcontract')) AS offcontract, count(*) AS n FROM tx GROUP BY ALL HAVING masked_payee + offcontract >= 2",
)
_on_scored("distinct_agency_cabinets", lambda x: x.select("agency", "cabinet_name").distinct(), "SELECT DISTINCT agency, cabinet_name FROM tx")


def _detail(s: SparkSession, d: str) -> DataFrame:
    """Payments of tiers 1 to 3 with the ledger's description, by transaction, amount, date and agency."""
    from talus.sources.ledger import ledger

    rows = scored(s, d).where("tier <= 3").select("record_number", "transaction_id", "amount", "posting_date", "agency", "tier")
    wanted = ledger(s, d).join(rows.select(F.col("transaction_id").alias("txn")).distinct(), "txn", "left_semi")  # few of the ledger's rows
    text = wanted.groupBy(F.col("txn").alias("transaction_id"), "amount", "posting_date", "agency").agg(F.min("description").alias("description"), F.min("invoice").alias("invoice"))
    return rows.join(text, ["transaction_id", "amount", "posting_date", "agency"], "left").select("record_number", "transaction_id", "tier", "description", "invoice")


from talus.sources.ledger import LEDGER_SQL  # noqa: E402

_add(
    "tier_detail",
    _detail,
    f"WITH {TX}, {LEDGER_SQL}, t AS (SELECT txn, amount, posting_date, agency, min(description) AS description, min(invoice) AS invoice FROM ledger GROUP BY ALL) SELECT tx.record_number, tx.transaction_id, tx.tier, t.description, t.invoice FROM tx LEFT JOIN t ON t.txn = tx.transaction_id AND t.amount = tx.amount AND t.posting_date = tx.posting_date AND t.agency = tx.agency WHERE tier <= 3",
)

# verdicts and leads
_VERDICT = f"v AS (SELECT {_KEY.format(c='entity_key')} AS entity_key, max(lower(trim(verdict))) AS verdict, max(overtaker_interest) AS interest FROM vendor_verdicts GROUP BY 1)"


def verdicts(s: SparkSession, d: str) -> DataFrame:
    return one_verdict(table(s, d, "vendor_verdicts"))


def one_verdict(rows: DataFrame) -> DataFrame:
    """One verdict per name key: the spellings of a key are collapsed."""
    rows = rows.withColumn("entity_key", X.entity_key(F.col("entity_key"))).where("entity_key is not null")
    return rows.groupBy("entity_key").agg(F.max(F.lower(F.trim("verdict"))).alias("verdict"), F.max("overtaker_interest").alias("interest"))


def _leads(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).where("tier = 1").join(verdicts(s, d), "entity_key", "left")
    rows = rows.orderBy(F.desc_nulls_last("risk_score"), F.desc("amount"), "transaction_id").limit(50)
    return rows.select("transaction_id", "agency", "payee", R.money("amount", "amount"), "risk_score", F.coalesce("verdict", F.lit("screened_unreviewed")).alias("status"))


_add("leads", _leads, f"WITH {TX}, {_VERDICT} SELECT transaction_id, agency, payee, {_usd('amount', 'amount')}, risk_score, coalesce(verdict, 'screened_unreviewed') AS status FROM tx LEFT JOIN v USING (entity_key) WHERE tier = 1 ORDER BY risk_score DESC NULLS LAST, amount DESC, transaction_id LIMIT 50")


def _pending(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "tier_entities").where("n_tier1 > 0").withColumn("k", X.entity_key(F.col("entity_key")))
    return rows.join(verdicts(s, d).select(F.col("entity_key").alias("k"), "verdict"), "k", "left").where("verdict is null").select("entity_key", "n_tier1", "usd_tier1")


_add("verdicts_pending", _pending, f"WITH {_VERDICT} SELECT e.entity_key, n_tier1, usd_tier1 FROM tier_entities e LEFT JOIN v ON v.entity_key = {_KEY.format(c='e.entity_key')} WHERE n_tier1 > 0 AND v.verdict IS NULL")
_add(
    "verdict_summary",
    lambda s, d: verdicts(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("interest").alias("interest")),
    f"WITH {_VERDICT} SELECT verdict, count(*) AS n, CAST(sum(interest) AS BIGINT) AS interest FROM v WHERE entity_key IS NOT NULL GROUP BY 1",
)
_on_scored(
    "explain_payments",
    lambda x: x.where("tier = 1").select("record_number", "transaction_id", "marker_sum", "category_multiplier", F.array_join(F.array_compact(F.array(*[F.when(F.col(f"f_{f}") > 0, F.concat(F.lit(f + "="), F.col(f"f_{f}").cast("string"))) for f in ("round", "dup", "conc", "newvendor", "yearend", "peer", "account", "rail", "entity")])), ",").alias("families")),
    "SELECT record_number, transaction_id, marker_sum, category_multiplier, array_to_string(list_filter([" + ", ".join(f"CASE WHEN f_{f} > 0 THEN '{f}=' || CAST(f_{f} AS VARCHAR) END" for f in ("round", "dup", "conc", "newvendor", "yearend", "peer", "account", "rail", "entity")) + "], lambda x: x IS NOT NULL), ',') AS families FROM tx WHERE tier = 1",
)
for _metric in ("usd_tier1", "n_flagged", "max_risk_score"):
    _add(
        f"rank_vendors_{_metric}",
        lambda s, d, m=_metric: table(s, d, "tier_entities").orderBy(F.desc_nulls_last(m), "entity_key").limit(20).select("entity_key", m),
        f"SELECT entity_key, {_metric} FROM tier_entities ORDER BY {_metric} DESC NULLS LAST, entity_key LIMIT 20",
    )
_add(
    "search_entities",
    lambda s, d: table(s, d, "tier_entities").where(F.upper("entity_name").contains("ROOF") | F.upper(F.array_join("agencies", " ")).contains("WATER")).select("entity_key", "n_flagged"),
    "SELECT entity_key, n_flagged FROM tier_entities WHERE contains(upper(entity_name), 'ROOF') OR contains(upper(array_to_string(agencies, ' ')), 'WATER')",
)


# entity resolution
def _resolved(s: SparkSession, d: str) -> DataFrame:
    return E.resolve(E.entity_names(scored(s, d), X.PLACEHOLDER_PAYEES))


_SUFFIX_SQL = ", ".join(f"'{w}'" for w in E.SUFFIXES + E.JOINING)
_add(
    "resolve_entities",
    _resolved,
    f"""WITH RECURSIVE {TX}, names AS (SELECT entity_key, mode() WITHIN GROUP (ORDER BY payee) AS display_name, sum(amount) AS exposure, count(*) AS n_txn FROM tx WHERE entity_key IS NOT NULL AND entity_key NOT IN ({', '.join(f"'{p}'" for p in X.PLACEHOLDER_PAYEES)}) GROUP BY 1),
    prep AS (SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(replace(upper(entity_key), '&', ' AND '), '[.,/()\\-''"#]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w NOT IN ({_SUFFIX_SQL})) AS core,
      regexp_matches(entity_key, '{E.JOINT_VENTURE}') AS jv, regexp_matches(entity_key, '{E.PUBLIC_BODY}') AS pub FROM names),
    rows_ AS (SELECT entity_key, core[1] AS first, list_sort(list_distinct(core)) AS cset, jv FROM prep WHERE NOT pub AND len(core) > 0),
    edges AS (SELECT * FROM (SELECT a.entity_key AS a, b.entity_key AS b, CASE WHEN a.cset = b.cset THEN 'norm_exact' WHEN a.jv THEN NULL
        WHEN (len(list_intersect(a.cset, b.cset)) = len(a.cset) AND len(a.cset) < len(b.cset) AND len(a.cset) >= 2) OR (len(list_intersect(a.cset, b.cset)) = len(b.cset) AND len(b.cset) < len(a.cset) AND len(b.cset) >= 2) THEN 'token_subset'
        WHEN len(list_intersect(a.cset, b.cset))::DOUBLE / len(list_distinct(list_concat(a.cset, b.cset))) >= {E.LEAST_JACCARD} AND a.cset[1:2] = b.cset[1:2] THEN 'token_jaccard' END AS rule
      FROM rows_ a JOIN rows_ b ON a.first = b.first AND a.jv = b.jv AND a.entity_key < b.entity_key) WHERE rule IS NOT NULL),
    arcs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    reach AS (SELECT entity_key AS k, entity_key AS r FROM names UNION SELECT reach.k, arcs.b FROM reach JOIN arcs ON reach.r = arcs.a),
    roots AS (SELECT k AS entity_key, min(r) AS root FROM reach GROUP BY 1),
    rules AS (SELECT root, list_sort(list(DISTINCT rule)) AS rules FROM edges JOIN roots ON roots.entity_key = edges.a GROUP BY 1),
    ranked AS (SELECT n.*, root, row_number() OVER (PARTITION BY root ORDER BY exposure DESC NULLS LAST, n_txn DESC, entity_key) AS rn, count(*) OVER (PARTITION BY root) AS group_size FROM names n JOIN roots USING (entity_key)),
    parents AS (SELECT root, entity_key AS parent_key, display_name AS parent_name FROM ranked WHERE rn = 1)
    SELECT entity_key, parent_key, parent_name, CASE WHEN entity_key = parent_key THEN 'parent' ELSE array_to_string(rules, '+') END AS method,
      CASE WHEN rules IS NULL THEN 'singleton' WHEN list_contains(rules, 'norm_exact') OR list_contains(rules, 'token_subset') THEN 'high' ELSE 'medium' END AS confidence, group_size FROM ranked JOIN parents USING (root) LEFT JOIN rules USING (root)""",
)


def _by_parent(s: SparkSession, d: str) -> DataFrame:
    """Flagged payments rolled up to the parents of their payees."""
    parents = _resolved(s, d).select("entity_key", "parent_key")
    rows = scored(s, d).join(parents, "entity_key")
    return _joined(R.entity_rollup(rows, "parent_key"), "agencies", "top_markers").select("parent_key", "hv_txn", "hv_exposure", "n_flagged", "top_tier", "agencies", "top_markers")


def _vendor_nodes(s: SparkSession, d: str) -> DataFrame:
    """One JSON document per flagged entity: rollup, primary agency and its riskiest payments."""
    x = scored(s, d)
    node = R.entity_rollup(x, "entity_key").join(R.primary(x, "entity_key", "agency", "amount").withColumnRenamed("agency", "primary_agency"), "entity_key", "left").join(R.transaction_lists(x, "entity_key", 30), "entity_key", "left")
    return node.select("entity_key", F.to_json(F.struct(*[c for c in node.columns]), {"ignoreNullFields": "false"}).alias("node"))


_add("vendor_nodes", _vendor_nodes)


TREE_KEYS = ["cabinet", "agency", "entity_key"]


def _tree_rows(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).where("entity_key is not null and agency is not null and marker_sum > 0").withColumn("cabinet", F.coalesce("cabinet_name", F.lit("(none)")))


def tree(s: SparkSession, d: str) -> DataFrame:
    """Cabinet, agency and entity with counts, tiers, ids, years, verdict and top four markers, and the entity's top fifteen payments there as an array of structs."""
    x = _tree_rows(s, d)
    sums = x.groupBy(*TREE_KEYS).agg(
        F.mode("payee", deterministic=True).alias("entity_name"), F.countDistinct("vendor_id_code").alias("n_vendor_ids"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("_s"), *[F.count(F.when(F.col("tier") == t, 1)).alias(f"n_tier{t}") for t in (1, 2)],
        F.min("tier").alias("top_tier"), F.max("risk_score").alias("max_risk_score"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"),
    )
    context = table(s, d, "vendor_verdicts").groupBy(X.entity_key(F.col("entity_key")).alias("entity_key")).agg(F.max("public_context").alias("context"))
    told = verdicts(s, d).join(context, "entity_key")
    out = sums.withColumn("usd", R.money("_s", "usd")).drop("_s").join(R.top_markers(x, TREE_KEYS, "fired_markers", 4), TREE_KEYS, "left")
    return out.join(R.transaction_lists(x, TREE_KEYS, 15), TREE_KEYS, "left").join(told, "entity_key", "left")


def _tree(s: SparkSession, d: str) -> DataFrame:
    return _joined(tree(s, d), "top_markers")


def _tree_summary(s: SparkSession, d: str) -> DataFrame:
    """The tree with markers and the ids of the listed payments as text; ``entity_tree_payments`` has the payments."""
    return _joined(tree(s, d).withColumn("transactions", F.transform("transactions", lambda t: t.txn)), "top_markers", "transactions")


def _listed(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row per listed payment of ``transactions``."""
    rows = df.select(*keys, F.explode("transactions").alias("t")).select(*keys, "t.rn", "t.fy", "t.date", F.col("t.usd").cast("double").alias("usd"), "t.txn", "t.tier", "t.category", "t.score", F.col("t.markers").alias("markers"))
    return _joined(rows, "markers")


def _listed_sql(keys: str, where: str, k: int) -> str:
    return (
        f"SELECT {keys}, rn, fiscal_year AS fy, posting_date AS date, CAST(amount AS DOUBLE) AS usd, transaction_id AS txn, tier, category1 AS category, risk_score AS score, array_to_string(fired_markers, '|') AS markers"
        f" FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY risk_score DESC NULLS LAST, amount DESC NULLS LAST, transaction_id, record_number) AS rn FROM tx WHERE {where}) WHERE rn <= {k}"
    )


_TREE_TX = TX.replace("FROM (SELECT DISTINCT * FROM tx_tiered)", ", coalesce(cabinet_name, '(none)') AS cabinet FROM (SELECT DISTINCT * FROM tx_tiered)")
_TREE_WHERE = "entity_key IS NOT NULL AND agency IS NOT NULL AND marker_sum > 0"
# arrays of structs: its SQL is that of the two queries that follow, which give all of it in flat columns
_add("entity_tree", _tree)
_add(
    "entity_tree_summary",
    _tree_summary,
    f"""WITH {_TREE_TX}, {_top_sql('cabinet, agency, entity_key', 4, _TREE_WHERE)}, {_VERDICT},
    c AS (SELECT {_KEY.format(c='entity_key')} AS entity_key, max(public_context) AS context FROM vendor_verdicts GROUP BY 1), listed AS ({_listed_sql('cabinet, agency, entity_key', _TREE_WHERE, 15)}),
    ids AS (SELECT cabinet, agency, entity_key, string_agg(txn, '|' ORDER BY rn) AS transactions FROM listed GROUP BY ALL)
    SELECT g.*, tm.top_markers, ids.transactions, v.verdict, v.interest, c.context FROM (SELECT cabinet, agency, entity_key, mode() WITHIN GROUP (ORDER BY payee) AS entity_name, count(DISTINCT vendor_id_code) AS n_vendor_ids, count(*) AS n, count(*) FILTER (WHERE tier = 1) AS n_tier1, count(*) FILTER (WHERE tier = 2) AS n_tier2,
      min(tier) AS top_tier, max(risk_score) AS max_risk_score, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, {_usd('sum(amount)', 'usd')} FROM tx WHERE {_TREE_WHERE} GROUP BY ALL) g
    LEFT JOIN tm USING (cabinet, agency, entity_key) LEFT JOIN ids USING (cabinet, agency, entity_key) LEFT JOIN v ON v.entity_key = g.entity_key LEFT JOIN c ON c.entity_key = g.entity_key""",
)
_add("entity_tree_payments", lambda s, d: _listed(R.transaction_lists(_tree_rows(s, d), TREE_KEYS, 15), TREE_KEYS), f"WITH {_TREE_TX} {_listed_sql('cabinet, agency, entity_key', _TREE_WHERE, 15)}")
_add("vendor_node_payments", lambda s, d: _listed(R.transaction_lists(scored(s, d), "entity_key", 30), ["entity_key"]), f"WITH {TX} {_listed_sql('entity_key', 'entity_key IS NOT NULL', 30)}")
_PARENTS_SQL = SQL["resolve_entities"].replace("WITH RECURSIVE ", "", 1).rsplit("SELECT entity_key, parent_key, parent_name", 1)
_add(
    "entity_rollup_by_parent",
    _by_parent,
    f"""WITH RECURSIVE {_PARENTS_SQL[0].rstrip()}, px AS (SELECT tx.*, parent_key FROM tx JOIN (SELECT entity_key, parent_key FROM ranked JOIN parents USING (root)) USING (entity_key)),
    {_top_sql('parent_key', 5).replace('FROM tx WHERE', 'FROM px WHERE')}
    SELECT e.*, tm.top_markers FROM (SELECT parent_key, count(*) AS hv_txn, {_usd('sum(amount)', 'hv_exposure')}, count(*) FILTER (WHERE marker_sum > 0) AS n_flagged, min(tier) AS top_tier, coalesce(string_agg(DISTINCT agency, '|' ORDER BY agency), '') AS agencies
      FROM px GROUP BY 1 HAVING count(*) FILTER (WHERE marker_sum > 0) > 0) e LEFT JOIN tm USING (parent_key)""",
)
