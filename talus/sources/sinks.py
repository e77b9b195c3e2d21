"""Writing results: Parquet, CSV, JSON documents, bundles, upserts and all-or-nothing loads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def save_table(df: DataFrame, name: str, buckets: int = 0, by: Sequence[str] = ()) -> None:
    """Create or replace a table of the catalog, bucketed and sorted by ``by`` where later joins on it should not shuffle."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.bucketBy(buckets, *by).sortBy(*by) if buckets else writer).saveAsTable(name)


def flat_arrays(df: DataFrame, separator: str = "|") -> DataFrame:
    """Arrays of strings joined to one string, since CSV holds none."""
    arrays = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    return df.select(*[F.array_join(F.col(f"`{c}`").cast("array<string>"), separator).alias(c) if c in arrays else F.col(f"`{c}`") for c in df.columns])


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with header; ``files`` is for feeds known to be small, else each partition writes its own."""
    out = flat_arrays(df)
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_array(df: DataFrame, most: int = 100_000) -> str:
    """The rows as one JSON array; for documents of at most ``most`` rows, more are refused."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a JSON array document has at most {most} rows; write JSON lines instead")
    return "[" + ",\n".join(r.j for r in rows) + "]"


def bundle(feeds: dict[str, DataFrame]) -> DataFrame:
    """(feed, row): the rows of several feeds as JSON in one table."""
    parts = [df.select(F.lit(name).alias("feed"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")) for name, df in feeds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str, update: bool = True) -> DataFrame:
    """``old`` with the rows of ``new`` by ``key``: replacing (or, without ``update``, only added where the key is absent)."""
    if update:
        return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def _move(spark: SparkSession, source: str, target: str) -> None:
    at, fs = _fs(spark, source)
    to = _fs(spark, target)[0]
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"{source} could not be renamed to {target}")


def load_together(spark: SparkSession, tables: dict[str, DataFrame], folder: str, checks: Callable[[str, DataFrame], bool] | None = None, move: Callable[[SparkSession, str, str], None] = _move) -> dict[str, int]:
    """Write several tables below ``folder`` so that either all of them are replaced or none.

    All are written, counted and checked in a staging folder first, so a table
    may be made from the one that it replaces.  Then the old folders are moved
    aside and the new ones into their place; if a move fails, those done are
    undone in reverse.  The old tables are deleted only when all new ones are in
    place; if even undoing fails they stay in the folder that the error names.
    """
    mark = uuid.uuid4().hex
    stage, aside = f"{folder}/.load-{mark}", f"{folder}/.replaced-{mark}"
    counts: dict[str, int] = {}
    moved: list[tuple[str, str]] = []
    try:
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{stage}/{name}")
            written = spark.read.parquet(f"{stage}/{name}")
            counts[name] = written.count()
            if checks and not checks(name, written):
                raise ValueError(f"the check of {name} failed; nothing was replaced")
        try:
            for name in tables:
                target, fs = _fs(spark, f"{folder}/{name}")
                steps = [(f"{folder}/{name}", f"{aside}/{name}")] if fs.exists(target) else []
                for step in [*steps, (f"{stage}/{name}", f"{folder}/{name}")]:
                    move(spark, *step)
                    moved.append(step)
        except BaseException as e:
            try:
                for source, target in reversed(moved):
                    _move(spark, target, source)
            except BaseException as worse:
                raise OSError(f"the tables replaced so far are in {aside}") from worse
            path, fs = _fs(spark, aside)
            fs.delete(path, True)  # empty: all are back in their place
            raise e
        path, fs = _fs(spark, aside)
        fs.delete(path, True)
    finally:
        path, fs = _fs(spark, stage)
        fs.delete(path, True)
    return counts


def push_jdbc(df: DataFrame, url: str, name: str, **options: str) -> int:
    """Replace a table of a database and check that it holds as many rows as were sent, counted while they are sent."""
    sent = Observation()
    df.observe(sent, F.count(F.lit(1)).alias("n")).write.format("jdbc").options(url=url, dbtable=name, **options).mode("overwrite").save()
    there = df.sparkSession.read.format("jdbc").options(url=url, dbtable=name, **options).load().count()
    if sent.get["n"] != there:
        raise ValueError(f"{name}: {sent.get['n']} rows sent, {there} there")
    return there


def push_together(spark: SparkSession, folder: str, names: Sequence[str], url: str, optional: Sequence[str] = (), **options: str) -> dict[str, int]:
    """Push the tables of a folder to a database, by name the rows that arrived; an ``optional`` table that isn't there is passed over, another is an error."""
    there = {n: exists(spark, f"{folder}/{n}.parquet") for n in [*names, *optional]}
    lost = [n for n in names if not there[n]]
    if lost:
        raise FileNotFoundError(f"{folder} has no {', '.join(lost)}")
    return {n: push_jdbc(spark.read.parquet(f"{folder}/{n}.parquet"), url, n, **options) for n, found in there.items() if found}


def plain(value):
    """A value as JSON holds it: decimals as numbers, dates as ISO text."""
    from datetime import date, datetime
    from decimal import Decimal

    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def to_records(df: DataFrame, most: int = 10_000) -> list[dict]:
    """Result rows of a report as plain dictionaries; a result of more than ``most`` is refused, so none is cut unseen."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"the result has more than {most} rows; narrow it or write it to a table")
    return [plain(r.asDict(True)) for r in rows]


def to_json_text(df: DataFrame, most: int = 10_000) -> str:
    return json.dumps(to_records(df, most), ensure_ascii=False)
