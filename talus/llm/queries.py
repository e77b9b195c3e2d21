"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.components import connected_groups
from talus.llm.mapping import UNMATCHED, map_values
from talus.llm.packing import pack
from talus.llm.quality import BREAK, ENDED, PLAIN_START, SPACE, TAIL, WORD, no_prose, prose_distance, text_stats
from talus.llm.tokens import count_tokens, encode_texts
from talus.llm.topn import top_n
from talus.staging import Staged
from talus.llm.variants import name_groups, variant_pairs
from talus.tables import name_key, table


def typed_agencies(spark: SparkSession, folder: str) -> DataFrame:
    """(source_table, row_key, value, agency_id, score) of all agency names that were typed."""
    reports = table(spark, folder, "ag_reports").select(F.lit("ag_reports").alias("source_table"), F.col("report_id").alias("row_key"), F.col("agency_raw").alias("value"))
    lines = table(spark, folder, "fy2026_jlbc_structured").select(F.lit("fy2026_jlbc_structured").alias("source_table"), F.col("line_id").cast("string").alias("row_key"), F.col("agency").alias("value"))
    return map_values(reports.unionByName(lines), "value", table(spark, folder, "agency_list"), "agency_id", "agency_name", "short_name")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return typed_agencies(spark, folder).select("source_table", "row_key", "agency_id").distinct()


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    found = typed_agencies(spark, folder).where(F.col("agency_id") == UNMATCHED)
    return found.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    real = lambda c: F.when(~F.col(c).isin("", "NULL"), F.col(c)).alias(c)
    rows = table(spark, folder, "entity_crosswalk").select("entity_key", real("parent_key"))
    return connected_groups(rows, "entity_key", "parent_key")


P3_SQL = """
WITH RECURSIVE pairs AS (SELECT DISTINCT entity_key AS a, parent_key AS b FROM entity_crosswalk WHERE entity_key IS NOT NULL AND parent_key IS NOT NULL AND parent_key NOT IN ('', 'NULL')),
arcs AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
vertices AS (SELECT entity_key AS k FROM entity_crosswalk WHERE entity_key IS NOT NULL UNION SELECT b FROM pairs),
reach AS (SELECT k, k AS r FROM vertices UNION SELECT reach.k, arcs.b FROM reach JOIN arcs ON reach.r = arcs.a)
SELECT k AS entity_key, min(r) AS group_key FROM reach GROUP BY k"""


def payee_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The name keys of all payees of transactions and of tier_entities."""
    payees = table(spark, folder, "transactions").select(name_key(F.col("payee_customer_vendor_name")).alias("key"))
    return payees.distinct().unionByName(table(spark, folder, "tier_entities").select(F.col("entity_key").alias("key")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = Staged(spark, "p4")(name_groups(payee_keys(spark, folder), "key"))
    return variant_pairs(groups)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_n(table(spark, folder, "tx_tiered"), "agency", "transaction_id", "risk_score", "amount", 10)


P5_SQL = """
WITH best AS (SELECT agency, transaction_id, risk_score, amount, row_number() OVER (PARTITION BY agency, transaction_id ORDER BY risk_score DESC, amount DESC NULLS LAST) AS k
              FROM tx_tiered WHERE agency IS NOT NULL AND transaction_id IS NOT NULL AND risk_score IS NOT NULL),
ranked AS (SELECT agency, transaction_id, row_number() OVER (PARTITION BY agency ORDER BY risk_score DESC, amount DESC NULLS LAST, transaction_id) AS place FROM best WHERE k = 1)
SELECT agency, transaction_id FROM ranked WHERE place <= 10"""


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), ["doc_id"], "text")


#: Tokens that a container of p9 holds.
CAPACITY = 2048


def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(count_tokens(table(spark, folder, "documents"), ["doc_id"], "text"), ["doc_id"], "n_tokens", CAPACITY)


def p10_text_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The plain statistics alone, which SQL can give too."""
    stats = text_stats(table(spark, folder, "documents"), ["doc_id"], "text", table(spark, folder, "common_words"))
    ratios = [c for c, kind in stats.dtypes if kind == "double"]
    return stats.withColumns({c: F.round(c, 6) for c in ratios})


def p10_stats(spark: SparkSession, folder: str) -> DataFrame:
    return prose_distance(text_stats(table(spark, folder, "documents"), ["doc_id"], "text", table(spark, folder, "common_words")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return no_prose(p10_stats(spark, folder)).select("doc_id").distinct()


_sql = lambda pattern: pattern.replace("'", "''")
_PER = "CAST({a} AS DOUBLE) / greatest({b}, 1)"
_PLAIN_CHARS = "length(replace(replace(array_to_string(words, ''), chr(39), ''), '’', ''))"
P10_TEXT_STATS_SQL = f"""
WITH listed AS (SELECT lang, list(lower(word)) AS own FROM common_words WHERE word IS NOT NULL AND lang IS NOT NULL GROUP BY lang),
parts AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_sql(BREAK)}'), lambda x: regexp_matches(x, '[^{_sql(SPACE)}]')) AS lines,
                 regexp_extract_all(lower(text), '{_sql(WORD)}') AS words, length(regexp_replace(text, '[{_sql(SPACE)}]+', '', 'g')) AS solid FROM documents),
marks AS (SELECT doc_id, lang, list_transform(words, lambda w: list_contains(own, w)) AS m FROM parts, listed),
counts AS (SELECT doc_id, lang, len(list_filter(m, lambda x: x)) AS n, len(list_filter(list_zip(m[:-2], m[2:]), lambda x: x[1] AND x[2])) AS pairs FROM marks),
best AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1)
SELECT p.doc_id, CASE WHEN ok THEN lang END AS language, CASE WHEN ok THEN len(words) END AS n_words, CASE WHEN ok THEN len(lines) END AS n_lines, CASE WHEN ok THEN solid END AS n_solid,
  CASE WHEN ok THEN round({_PER.format(a="length(array_to_string(words, ''))", b="len(words)")}, 6) END AS mean_word_length,
  CASE WHEN ok THEN round({_PER.format(a=f"solid - {_PLAIN_CHARS}", b="solid")}, 6) END AS symbol_ratio,
  CASE WHEN ok THEN round({_PER.format(a=r"length(regexp_replace(text, '[^\p{Nd}]+', '', 'g'))", b="solid")}, 6) END AS digit_ratio,
  CASE WHEN ok THEN round({_PER.format(a=f"len(list_filter(lines, lambda x: regexp_matches(right(x, {TAIL}), '{_sql(ENDED)}')))", b="len(lines)")}, 6) END AS punctuated_lines,
  CASE WHEN ok THEN round({_PER.format(a=f"len(list_filter(lines, lambda x: NOT regexp_matches(x, '{_sql(PLAIN_START)}')))", b="len(lines)")}, 6) END AS marked_lines,
  CASE WHEN ok THEN round({_PER.format(a="n", b="len(words)")}, 6) END AS common_words, CASE WHEN ok THEN round({_PER.format(a="pairs", b="len(words)")}, 6) END AS common_pairs
FROM (SELECT *, coalesce(len(lines) > 0, false) AS ok FROM parts) p LEFT JOIN best USING (doc_id)"""

QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p8_ids": p8_ids, "p9_packed": p9_packed, "p10_found": p10_found, "p10_stats": p10_stats, "p10_text_stats": p10_text_stats}
SQL = {"p3_found": P3_SQL, "p5_found": P5_SQL, "p10_text_stats": P10_TEXT_STATS_SQL}
