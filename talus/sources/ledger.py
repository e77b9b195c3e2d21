"""Reading ledgers: the canonical columns, the layouts of yearly exports, and the clean views of the table."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.functions import cleaning as X
from talus.tables import table

# The canonical ledger and the column orders of its yearly exports.
CANON = (
    ["record_number", "fiscal_year", "entity_name"] + [f"fund_{i}_name" for i in range(1, 5)] + [f"organization_level_{i}_name" for i in range(1, 11)] + ["transaction_type"]
    + [f"category_level_{i}_name" for i in range(1, 8)]
    + ["payee_customer_vendor_name", "payee_dba_name", "vendor_id_code", "posting_date", "transaction_description", "transaction_id", "transaction_reference_id", "contract_name", "contract_number"]
    + ["position_title", "hourly_rate", "gender", "amount", "payment_method", "protection_indicator", "fund_1_code", "fund_2_code", "fund_3_code", "appropriation_1_name", "appropriation_1_code"]
    + ["appropriation_type", "appropriation_category_1_name", "appropriation_category_1_code", "category_level_1_code", "category_level_2_code", "category_level_3_code", "payment__", "fiscal_period"]
    + ["cabinet", "cabinet_name", "department_code", "bfy", "invoice_number", "subfund_no", "object_no"]
)
TYPES = {"fiscal_year": "int", "posting_date": "date", "hourly_rate": "decimal(18,4)", "amount": "decimal(18,4)"}
_AFTER_51 = ["invoice_number", "payment__", "fiscal_period", "cabinet", "cabinet_name", "department_code"]
LAYOUTS = {
    "base38": [c for c in CANON[: CANON.index("payment_method") + 1] if c != "vendor_id_code"],
    "full57": CANON[:57],
    "fy2021": CANON[:51] + _AFTER_51 + ["bfy"],
    "fy2017_18": CANON[:51] + _AFTER_51 + ["subfund_no", "object_no"],
}


def canonical(raw: DataFrame, layout: list[str]) -> DataFrame:
    """The canonical columns of ``raw``, whose columns are strings in the order of ``layout``.

    Columns that a layout lacks are typed nulls; text that is no number or date
    becomes null; a date must be written in full; a fractional year is rounded.
    """
    at = {name: F.col(f"`{raw.columns[i]}`") for i, name in enumerate(layout) if i < len(raw.columns)}

    def column(name: str) -> Column:
        kind = TYPES.get(name, "string")
        if name not in at:
            return F.lit(None).cast(kind).alias(name)
        value = at[name]
        if kind == "int":
            value = F.round(value.try_cast("decimal(38,10)")).try_cast("int")
        elif kind == "date":
            value = F.when(value.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), value.try_cast("date"))
        elif kind != "string":
            value = value.try_cast(kind)
        return value.alias(name)

    return raw.select(*[column(c) for c in CANON])


def read_positional(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """A CSV export read by position whatever its header says, as the canonical ledger."""
    names = LAYOUTS[layout]
    schema = T.StructType([T.StructField(f"column{i:02d}", T.StringType()) for i in range(len(names))])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).csv(path)
    return canonical(raw, names)


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """CSV exports (a path or a glob) read by their headers, as the canonical ledger."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    names = [c.strip().lower().replace(" ", "_") for c in raw.columns]
    return canonical(raw, names)


def read_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet shards of different widths as one table: columns by name, absent ones null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_feed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV feeds with a header, of a given schema by name; values that don't fit are null and files without a column have nulls in it."""
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{names[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def read_with_long_header(spark: SparkSession, path: str, lines: int = 3) -> DataFrame:
    """A CSV file whose header takes several lines, as strings: a column's name is what its header cells say, joined by underscores.

    The header is read from the first line's worth of the file alone; its lines
    are recognised in the data by their text, so the file is still split among tasks.
    """
    head = [r.value for r in spark.read.text(path).limit(lines).collect()]  # a few lines
    cells = [next(csv.reader([line])) if line else [] for line in head]
    width = max((len(c) for c in cells), default=0)
    names = ["_".join(c[i].strip().lower().replace(" ", "_") for c in cells if i < len(c) and c[i].strip()) or f"column{i:02d}" for i in range(width)]
    if len(set(names)) < len(names):
        names = [f"{n}_{i:02d}" if names.count(n) > 1 else n for i, n in enumerate(names)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    body = spark.read.text(path).where(~F.col("value").isin(head)).select("value")
    return body.select(F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in names))).alias("r")).select("r.*") if names else spark.createDataFrame([], schema)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(report, page_no, text) of JSON documents that hold the text of a report's pages: {"report": ..., "pages": [{"page_no": ..., "text": ...}]}, one a file or a line."""
    schema = "report string, pages array<struct<page_no: int, text: string>>"
    return read_json_document(spark, path, schema).select("report", F.explode("pages").alias("p")).select("report", "p.page_no", "p.text")


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database; give partitionColumn, lowerBound, upperBound and numPartitions to read it in several tasks."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


#: Short names of the ledger's columns in the operators.
SHORT = {
    "agency": "organization_level_1_name", "org2": "organization_level_2_name", "cabinet_name": "cabinet_name", "fund": "fund_1_name", "category1": "category_level_1_name", "category2": "category_level_2_name",
    "category3": "category_level_3_name", "appropriation": "appropriation_1_name", "payee": "payee_customer_vendor_name", "vendor_id": "vendor_id_code", "txn": "transaction_id", "ref": "transaction_reference_id",
    "contract": "contract_number", "rail": "payment_method", "invoice": "invoice_number", "approp_type": "appropriation_type", "period": "fiscal_period", "protection": "protection_indicator",
    "description": "transaction_description", "record_number": "record_number", "position_title": "position_title",
}


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger without leaked headers: rows of type EX or RV, short names, blanks and literal NULLs as null."""
    rows = table(spark, folder, "transactions").where(F.col("transaction_type").isin("EX", "RV"))
    return rows.select("fiscal_year", F.col("transaction_type").alias("kind"), "posting_date", "amount", "hourly_rate", *[X.nz(F.col(c)).alias(n) for n, c in SHORT.items()])


def expenditure(spark: SparkSession, folder: str) -> DataFrame:
    """Clean expenditure: positive payments that are no fillers, with ``vid``, the id of a real vendor."""
    rows = ledger(spark, folder).where((F.col("kind") == "EX") & (F.col("amount") > 0) & ~X.is_sentinel(F.col("amount")))
    return rows.withColumn("vid", X.real_vendor(F.col("vendor_id")))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


_NZ = "nullif(nullif(trim({c}), 'NULL'), '')"
#: The same views for DuckDB, as the head of a WITH clause.
LEDGER_SQL = "ledger AS (SELECT fiscal_year, transaction_type AS kind, posting_date, amount, hourly_rate, " + ", ".join(f"{_NZ.format(c=c)} AS {n}" for n, c in SHORT.items()) + " FROM transactions WHERE transaction_type IN ('EX', 'RV'))"
_PLACEHOLDER_SQL = ", ".join(f"'{v}'" for v in X.PLACEHOLDER_VENDORS)
CLEAN_SQL = (
    LEDGER_SQL
    + f", clean AS (SELECT *, CASE WHEN vendor_id IS NOT NULL AND vendor_id NOT IN ({_PLACEHOLDER_SQL}) THEN vendor_id END AS vid FROM ledger"
    + f" WHERE kind = 'EX' AND amount > 0 AND NOT (abs(amount) BETWEEN {X.SENTINEL_LOW} AND {X.SENTINEL_HIGH}))"
)
