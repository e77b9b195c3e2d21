"""Rollups of the ledger and of scored payments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def money(c: Column | str, name: str) -> Column:
    """A decimal sum as a double of cents: sums stay exact, only the result is rounded."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 2).alias(name)


def total(df: DataFrame, keys: Sequence[str], amount: str = "amount", n: str = "n_txns", usd: str = "total_usd") -> DataFrame:
    """Count and sum of ``amount`` per ``keys``; null keys are a group."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.sum(amount).alias("_s"))
    return out.select(*keys, n, money("_s", usd))


def spend_by_month(ledger: DataFrame) -> DataFrame:
    month = F.trunc("posting_date", "month").alias("month")
    return total(ledger.select("fiscal_year", "kind", "agency", "fund", "category1", month, "amount"), ["fiscal_year", "kind", "agency", "fund", "category1", "month"])


def spend_summary(ledger: DataFrame) -> DataFrame:
    """The seven-key rollup that reads are served from; its sums are not rounded, so sums over it are exact."""
    return ledger.groupBy("agency", "fiscal_year", "kind", "category1", "category2", "category3", "appropriation").agg(F.sum("amount").alias("total_usd"), F.count(F.lit(1)).alias("n_txns"))


def spend_breakdown(rows: DataFrame, by: str, amount: str, n: Column) -> DataFrame:
    """Spend per value of ``by`` with its share of all; works on the ledger and on its rollup."""
    out = rows.groupBy(by).agg(F.sum(amount).alias("_s"), n.alias("n_txns"))
    out = out.crossJoin(F.broadcast(out.agg(F.sum("_s").alias("_all"))))  # one row of the total
    share = F.round(100 * F.col("_s").cast("double") / F.nullif(F.col("_all").cast("double"), F.lit(0.0)), 4)
    return out.select(by, "n_txns", money("_s", "total_usd"), share.alias("pct"))


def top_markers(scored: DataFrame, keys: Sequence[str], markers: str, k: int) -> DataFrame:
    """The ``k`` most frequent markers of every group, as an array; ties in order of their names."""
    counts = scored.select(*keys, F.explode(markers).alias("marker")).groupBy(*keys, "marker").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("marker")))
    first = counts.withColumn("rn", rank).where(F.col("rn") <= k)
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "marker"))), lambda x: x.marker).alias("top_markers"))


def _when(p: Column, v: Column | None = None) -> Column:
    return F.sum(F.when(p, v)) if v is not None else F.count(F.when(p, 1))


def agency_scorecard(scored: DataFrame) -> DataFrame:
    tier, amount = F.col("tier"), F.col("amount")
    out = scored.where("agency is not null").groupBy("agency").agg(
        F.count(F.lit(1)).alias("hv_txn"), F.sum("amount").alias("_all"), *[_when(tier == t).alias(f"n_tier{t}") for t in (1, 2, 3)], *[_when(tier == t, amount).alias(f"_t{t}") for t in (1, 2)],
        _when(F.col("marker_sum") > 0).alias("n_flagged"), F.countDistinct(F.when(F.col("marker_sum") > 0, F.col("vid"))).alias("flagged_vendors"), F.round(F.avg("risk_score"), 4).alias("avg_risk_score"), F.max("risk_score").alias("max_risk_score"),
    )
    both = F.coalesce("_t1", F.lit(0)) + F.coalesce("_t2", F.lit(0))
    pct = F.round(100 * both.cast("double") / F.nullif(F.col("_all").cast("double"), F.lit(0.0)), 4).alias("tier12_pct")
    out = out.select("agency", "hv_txn", "n_tier1", "n_tier2", "n_tier3", "n_flagged", "flagged_vendors", "avg_risk_score", "max_risk_score", money("_all", "hv_exposure"), money("_t1", "usd_tier1"), money("_t2", "usd_tier2"), pct)
    return out.join(top_markers(scored.where("agency is not null"), ["agency"], "fired_markers", 5), "agency", "left")


def agency_year(scored: DataFrame) -> DataFrame:
    out = scored.groupBy("agency", "fiscal_year").agg(F.count(F.lit(1)).alias("hv_txn"), F.sum("amount").alias("_all"), *[_when(F.col("tier") == t).alias(f"n_tier{t}") for t in (1, 2)], F.sum(F.when(F.col("tier") <= 2, F.col("amount"))).alias("_t12"), F.max("risk_score").alias("max_risk_score"))
    return out.select("agency", "fiscal_year", "hv_txn", "n_tier1", "n_tier2", "max_risk_score", money("_all", "hv_exposure"), money("_t12", "usd_tier12"))


def vendor_flagged(scored: DataFrame) -> DataFrame:
    """Vendors with a payment of tier 1 or 2: usual payee and agency, peak share, flags."""
    out = scored.where("vid is not null").groupBy("vid").agg(
        F.mode("payee", deterministic=True).alias("payee"), F.mode("agency", deterministic=True).alias("primary_agency"), F.count(F.lit(1)).alias("hv_txn"), F.sum("amount").alias("_all"),
        *[_when(F.col("tier") == t).alias(f"n_tier{t}") for t in (1, 2)], F.max("vendor_share_of_agency_year").alias("peak_share"), F.bool_or("name_is_new").alias("any_new_name"), F.min("tier").alias("top_tier"), F.countDistinct("agency").alias("n_agencies"),
    )
    return out.where("n_tier1 > 0 or n_tier2 > 0").select("vid", "payee", "primary_agency", "hv_txn", money("_all", "hv_exposure"), "n_tier1", "n_tier2", "peak_share", "any_new_name", "top_tier", "n_agencies")


def program_summary(scored: DataFrame) -> DataFrame:
    named = scored.withColumn("program", F.coalesce("appropriation_1_name", F.lit("(no appropriation)")))
    out = named.groupBy("program").agg(F.count(F.lit(1)).alias("hv_txn"), F.sum("amount").alias("_all"), _when(F.col("tier") == 1).alias("n_tier1"), _when(F.col("tier") == 1, F.col("amount")).alias("_t1"), F.countDistinct("agency").alias("n_agencies"))
    return out.where("n_tier1 > 0").select("program", "hv_txn", "n_tier1", "n_agencies", money("_all", "hv_exposure"), money("_t1", "usd_tier1"))


def tier_distribution(scored: DataFrame) -> DataFrame:
    """Per tier, of every year and of all years (``ALL``), in one pass of grouping sets."""
    rows = scored.select(F.col("fiscal_year").cast("string").alias("fy"), "tier", "amount")
    out = rows.groupingSets([[F.col("fy"), F.col("tier")], [F.col("tier")]], "fy", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("_s"), F.grouping("fy").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("fy")).alias("fy"), "tier", "n", money("_s", "exposure"))


def waterfall(scored: DataFrame) -> DataFrame:
    """Per tier count, exposure, average and shares of the whole."""
    out = scored.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("_s"))
    every = Window.partitionBy()
    return out.select(
        "tier", "n", money("_s", "exposure"), F.round(F.col("_s").cast("double") / F.col("n"), 2).alias("avg_amount"),
        F.round(100.0 * F.col("n") / F.sum("n").over(every), 4).alias("pct_n"), F.round(100 * F.col("_s").cast("double") / F.nullif(F.sum("_s").over(every).cast("double"), F.lit(0.0)), 4).alias("pct_usd"),
    )


def transaction_lists(scored: DataFrame, keys: str | Sequence[str], k: int) -> DataFrame:
    """Of every key its ``k`` riskiest payments as an array of structs, riskiest first."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("risk_score"), F.desc_nulls_last("amount"), F.asc("transaction_id"), F.asc("record_number"))
    first = scored.dropna(subset=keys).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    item = F.struct("rn", F.col("fiscal_year").alias("fy"), F.col("posting_date").alias("date"), F.col("amount").alias("usd"), "agency", F.col("transaction_id").alias("txn"), "tier", F.col("category1").alias("category"), F.col("risk_score").alias("score"), F.col("fired_markers").alias("markers"))
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("transactions"))


def primary(rows: DataFrame, key: str, value: str, amount: str) -> DataFrame:
    """Of every key the ``value`` with the largest sum of ``amount``; the first by name among equals."""
    sums = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.sum(amount).alias("s"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("s"), F.asc(value)))
    return sums.withColumn("rn", rank).where("rn = 1").select(key, value)


def entity_rollup(scored: DataFrame, key: str) -> DataFrame:
    """Flagged entities: names, ids, exposure, tiers, years, agencies and top markers."""
    rows = scored.where(F.col(key).isNotNull())
    flagged = F.col("marker_sum") > 0
    out = rows.groupBy(key).agg(
        F.mode("payee", deterministic=True).alias("entity_name"), F.countDistinct("vendor_id_code").alias("n_vendor_ids"), F.count(F.lit(1)).alias("hv_txn"), F.sum("amount").alias("_all"), _when(flagged).alias("n_flagged"), _when(flagged, F.col("amount")).alias("_fl"),
        *[_when(F.col("tier") == t).alias(f"n_tier{t}") for t in (1, 2)], F.min("tier").alias("top_tier"), F.max("risk_score").alias("max_risk_score"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"),
        F.countDistinct("agency").alias("n_agencies"), F.array_sort(F.collect_set("agency")).alias("agencies"),
    )
    out = out.where("n_flagged > 0").select(key, "entity_name", "n_vendor_ids", "hv_txn", money("_all", "hv_exposure"), "n_flagged", money("_fl", "flagged_exposure"), "n_tier1", "n_tier2", "top_tier", "max_risk_score", "first_year", "last_year", "n_agencies", "agencies")
    return out.join(top_markers(rows, [key], "fired_markers", 5), key, "left")
