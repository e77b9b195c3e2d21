"""The feature mart of large payments: aggregates over all clean expenditure joined to the payments above a floor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import cleaning as X


@dataclass(frozen=True)
class MartConfig:
    """Floors and units of the mart; every threshold of its operators is here."""

    floor: int = 25_000
    round_units: tuple[int, ...] = (1_000, 10_000, 100_000, 1_000_000)
    min_peers: int = 8
    duplicate_days: tuple[int, int] = (1, 90)


def vendor_year(clean: DataFrame) -> DataFrame:
    return clean.where("vid is not null").groupBy("vid", "fiscal_year").agg(F.sum("amount").alias("vendor_year_total"), F.count(F.lit(1)).alias("vendor_year_txns"))


def vendor_first(clean: DataFrame) -> DataFrame:
    return clean.where("vid is not null").groupBy("vid").agg(F.min("fiscal_year").alias("vendor_first_year"), F.countDistinct("fiscal_year").alias("vendor_years_active"))


def agency_year_total(clean: DataFrame) -> DataFrame:
    return clean.groupBy("agency", "fiscal_year").agg(F.sum("amount").alias("agency_year_total"))


def vendor_agency_year(clean: DataFrame) -> DataFrame:
    return clean.where("vid is not null").groupBy("vid", "agency", "fiscal_year").agg(F.sum("amount").alias("vendor_agency_year_total"))


def appropriation_year(clean: DataFrame) -> DataFrame:
    return clean.groupBy("appropriation", "fiscal_year").agg(F.sum("amount").alias("approp_year_total"), F.count(F.lit(1)).alias("approp_year_txns"))


def duplicate_signatures(clean: DataFrame) -> DataFrame:
    """Payments of one vendor, reference and amount under several transaction ids, with the days between them."""
    out = clean.where("vid is not null and ref is not null").groupBy("vid", "ref", "amount").agg(F.countDistinct("txn").alias("dup_distinct_txn"), F.count(F.lit(1)).alias("dup_rows"), F.datediff(F.max("posting_date"), F.min("posting_date")).alias("dup_day_span"))
    return out.where("dup_distinct_txn > 1")


def true_duplicates(clean: DataFrame, days: tuple[int, int]) -> DataFrame:
    """Vendor and amount paid under several references and transaction ids within the days."""
    out = clean.where("vid is not null and ref is not null").groupBy("vid", "amount").agg(F.countDistinct("ref").alias("n_refs"), F.countDistinct("txn").alias("n_txns"), F.datediff(F.max("posting_date"), F.min("posting_date")).alias("day_span"))
    return out.where((F.col("n_refs") >= 2) & (F.col("n_txns") >= 2) & F.col("day_span").between(*days))


def peer_stats(clean: DataFrame, floor: int) -> DataFrame:
    """Exact median and quartiles of the payments above the floor, per agency and category."""
    q = F.percentile(F.col("amount").cast("double"), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    out = clean.where(F.col("amount") >= floor).groupBy("agency", "category1").agg(F.count(F.lit(1)).alias("ac_n"), q.alias("q"))
    return out.select("agency", "category1", "ac_n", F.col("q")[0].alias("ac_median"), F.col("q")[1].alias("ac_q1"), F.col("q")[2].alias("ac_q3"))


def payee_profile(clean: DataFrame) -> DataFrame:
    return clean.where("payee is not null").groupBy(X.entity_key(F.col("payee")).alias("entity_key")).agg(F.min("fiscal_year").alias("first_fy"), F.count(F.lit(1)).alias("n_txns"))


def contract_rate(clean: DataFrame) -> DataFrame:
    """Share of payments with a contract number, per agency and year."""
    return clean.groupBy("agency", "fiscal_year").agg((F.count("contract").cast("double") / F.count(F.lit(1))).alias("contract_rate"))


def feature_mart(clean: DataFrame, config: MartConfig = MartConfig()) -> DataFrame:
    """The payments above the floor with bands, round flags, vendor, agency and peer features.

    Aggregates run over all clean expenditure and fold on the map side; joins are
    left joins on their group keys, so no payment is lost or doubled.  A missing
    vendor or peer group leaves its features null.
    """
    amount = F.col("amount")
    rows = clean.where(amount >= config.floor)
    rows = rows.withColumn("mag_band", X.magnitude_band(amount)).withColumn("is_whole_dollar", amount == F.floor(amount)).withColumn("first_digit", X.leading_digit(amount)).withColumn("fp_canon", X.period_number(F.col("period")))
    for unit in config.round_units:
        rows = rows.withColumn(f"is_round_{unit}", X.is_multiple(amount, unit))
    # one join for all vendor features; payments without a vendor get keys that match nothing, spread over all tasks
    lone = F.concat(F.lit("~"), F.pmod(F.xxhash64("record_number", "txn", "amount"), F.lit(4096)).cast("string"))
    rows = rows.withColumn("_vid", F.coalesce("vid", lone)).withColumn("_agency", F.coalesce("agency", F.lit("")))
    vendors = vendor_agency_year(clean).join(vendor_year(clean), ["vid", "fiscal_year"]).join(vendor_first(clean), "vid")
    vendors = vendors.withColumn("_agency", F.coalesce("agency", F.lit(""))).drop("agency").withColumnRenamed("vid", "_vid")
    rows = rows.join(vendors, ["_vid", "_agency", "fiscal_year"], "left")
    rows = rows.join(duplicate_signatures(clean).withColumnRenamed("vid", "_vid"), ["_vid", "ref", "amount"], "left").drop("_vid", "_agency")
    rows = rows.join(agency_year_total(clean), ["agency", "fiscal_year"], "left").join(peer_stats(clean, config.floor), ["agency", "category1"], "left")
    spread = F.nullif(F.col("ac_q3") - F.col("ac_q1"), F.lit(0.0))
    z = F.when(F.col("ac_n") >= config.min_peers, (amount.cast("double") - F.col("ac_median")) / spread)
    share = F.col("vendor_agency_year_total").cast("double") / F.nullif(F.col("agency_year_total").cast("double"), F.lit(0.0))
    return (
        rows.withColumn("vendor_first_appearance", F.col("vendor_first_year") == F.col("fiscal_year"))
        .withColumn("vendor_share_of_agency_year", F.round(share, 6))
        .withColumn("robust_z_in_agencycat", F.round(z, 6))
        .withColumn("in_dup_signature", F.col("dup_distinct_txn").isNotNull())
        .withColumn("in_dup_diffday", F.coalesce(F.col("dup_day_span") > 0, F.lit(False)))
    )
