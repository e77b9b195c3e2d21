"""Forensic screens and profiles of the clean ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import cleaning as X
from talus.operators.rollups import money
from talus.staging import Staged


def digit_deviation(clean: DataFrame, key: str, least: int, digit: str = "first") -> DataFrame:
    """Mean absolute deviation of a leading digit from Benford's law per group with at least ``least`` payments.

    Only digits that occur are averaged.  The first digit follows log10(1+1/d),
    the second the sum of that over all first digits.
    """
    d = X.leading_digit(F.col("amount")) if digit == "first" else X.second_digit(F.col("amount"))
    lowest = 1 if digit == "first" else 0
    counts = clean.select(key, d.try_cast("int").alias("d")).where((F.col("d") >= lowest) & F.col(key).isNotNull()).groupBy(key, "d").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("all_n", F.sum("n").over(Window.partitionBy(key))).where(F.col("all_n") >= least)
    x = F.col("d").cast("double")
    if digit == "first":
        law = F.log10(F.lit(1.0) + F.lit(1.0) / x)
    else:
        law = sum((F.log10(F.lit(1.0) + F.lit(1.0) / (F.lit(10.0 * k) + x)) for k in range(1, 10)), F.lit(0.0))
    return counts.groupBy(key).agg(F.max("all_n").alias("n"), F.round(F.avg(F.abs(F.col("n") / F.col("all_n") - law)), 6).alias("mad"))


def structuring(clean: DataFrame, limit: int, width: int, least: int, top: int) -> DataFrame:
    """Agencies with more payments just under a limit than just above it."""
    a = F.col("amount")
    out = clean.where("agency is not null").groupBy("agency").agg(F.count(F.when((a >= limit - width) & (a < limit), 1)).alias("n_under"), F.count(F.when((a >= limit) & (a < limit + width), 1)).alias("n_over"))
    out = out.where(F.col("n_under") >= least).withColumn("ratio", F.round(F.col("n_under") / F.nullif(F.col("n_over").cast("double"), F.lit(0.0)), 4))
    return out.orderBy(F.desc_nulls_first("ratio"), "agency").limit(top)


def invoice_duplicates(clean: DataFrame) -> DataFrame:
    """Groups of one year, vendor, invoice and amount that occur more than once."""
    out = clean.where("vid is not null and invoice is not null").groupBy("fiscal_year", "vid", "invoice", "amount").agg(F.count(F.lit(1)).alias("copies"))
    return out.where("copies > 1").withColumn("extra", F.col("copies") - 1).withColumn("potential", F.col("extra") * F.col("amount"))


def yearly_spikes(clean: DataFrame, least: float, factor: float) -> DataFrame:
    """Vendors whose year is ``factor`` times the previous year in which they were paid."""
    years = clean.where("vid is not null").groupBy("vid", "fiscal_year").agg(F.sum("amount").alias("_s"))
    w = Window.partitionBy("vid").orderBy("fiscal_year")
    out = years.withColumn("_p", F.lag("_s").over(w)).withColumn("prev_year", F.lag("fiscal_year").over(w))
    ratio = F.col("_s").cast("double") / F.nullif(F.col("_p").cast("double"), F.lit(0.0))
    return out.where((F.col("_s") >= least) & (F.col("_p") > 0) & (ratio >= factor)).select("vid", "fiscal_year", "prev_year", money("_s", "total_usd"), money("_p", "prev_usd"), F.round(ratio, 4).alias("ratio"))


def strata(clean: DataFrame, thresholds: list[int]) -> DataFrame:
    """Count, sum and share of the payments at or above each threshold, in one pass over the data."""
    hits = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("amount") >= t)
    every = clean.agg(F.sum("amount").alias("_all"), F.count(F.lit(1)).alias("all_n"))
    out = clean.select("amount", F.explode(hits).alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("_s"))
    out = out.crossJoin(F.broadcast(every))  # one row of totals
    return out.select("threshold", "n", money("_s", "total_usd"), F.round(100.0 * F.col("n") / F.col("all_n"), 4).alias("pct_n"), F.round(100 * F.col("_s").cast("double") / F.col("_all").cast("double"), 4).alias("pct_usd"))


def distribution(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    named = rows.select(*[F.coalesce(c, F.lit("(null)")).alias(c) for c in by], "amount")
    out = named.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("_s"))
    return out.orderBy(F.desc("n"), *by).limit(top).select(*by, "n", money("_s", "total_usd"))


def coverage(clean: DataFrame, fields: list[str]) -> DataFrame:
    """Percent of payments in which each field is filled, per year."""
    return clean.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("n"), *[F.round(100.0 * F.count(c) / F.count(F.lit(1)), 4).alias(f"{c}_pct") for c in fields])


def quantiles(clean: DataFrame, points: list[float]) -> DataFrame:
    """The number of payments and exact, interpolated quantiles of their amounts; nulls without payments.

    Payments are counted per amount, and the amounts cut into ranges, one a
    task; a range is numbered on from the counts of the ranges before it, of
    which there are as many as shuffle partitions.
    """
    keep = Staged(clean.sparkSession, "quantiles")
    counts = clean.where("amount is not null").groupBy(F.col("amount").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    counts = keep(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = counts.groupBy("part").agg(F.sum("k").alias("k"))
    before = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))  # a row per range
    upto = F.sum("k").over(Window.partitionBy("part").orderBy("v")) + F.col("before")
    ranked = counts.join(F.broadcast(before), "part").select("v", upto.alias("upto"))
    n = clean.agg(F.count(F.lit(1)).alias("n"), F.count("amount").alias("_known"))
    ranked = n.join(ranked, how="left")  # one row beside all amounts
    out = []
    for p in points:
        at = F.lit(p) * (F.col("_known") - 1)
        value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
        low, high = value(F.floor(at)), value(F.ceil(at))
        part = F.max(at - F.floor(at))
        out.append(F.round(low + part * (high - low), 4).alias("p" + str(p).replace("0.", "")))
    return ranked.agg(F.max("n").alias("n"), *out)
