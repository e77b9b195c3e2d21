"""Ledger files as a stream: each arriving file is folded into the spend rollup once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

KEYS = ["agency", "fiscal_year", "kind"]


def rollup_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Start folding Parquet files that appear in ``source`` into parts below ``target``; ends when all present files are read.

    A batch writes its partial sums under its number, so a batch that is run
    again after a failure replaces its own part and nothing counts twice.
    ``rollup`` adds the parts up.
    """
    rows = spark.readStream.schema(schema).parquet(source).where(F.col("transaction_type").isin("EX", "RV"))

    def fold(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(F.col("organization_level_1_name").alias("agency"), "fiscal_year", F.col("transaction_type").alias("kind")).agg(F.sum("amount").alias("total_usd"), F.count(F.lit(1)).alias("n_txns"))
        part.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy(*KEYS).agg(F.sum("total_usd").alias("total_usd"), F.sum("n_txns").alias("n_txns"))
