"""Differences between two copies of a table, found by a checksum matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.staging import Staged

#: Rows that a bucket of the matrix holds on average.
ROWS_PER_BUCKET = 16
#: Buckets of the coarse matrix that comes first in larger tables; the list of its unequal ones, at most so many numbers, is broadcast.
COARSE_BUCKETS = 65_536


# Expressions over many columns are written as SQL text, which the JVM parses in one call each.


def _settled(field: T.StructField) -> str:
    """The value in the form that is compared: arrays in sorted order."""
    value = _quoted(field.name)
    return f"sort_array({value})" if isinstance(field.dataType, T.ArrayType) else value


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _key(key: str) -> Column:
    return F.coalesce(F.col(_quoted(key)).cast("string"), F.lit("\x00null"))


def _hashed(df: DataFrame, key: str, fields: list[T.StructField]) -> DataFrame:
    """Per row: kh of the key, hk of the key anew, rh of the row, one 64-bit hash per field that also covers the key."""
    names = {f.name: f"v{i}" for i, f in enumerate(fields)}
    out = df.select(_key(key).alias("k"), *[F.expr(_settled(f)).alias(names[f.name]) for f in fields])
    out = out.selectExpr("xxhash64(k) as kh", "xxhash64(k, 7) as hk", *[f"xxhash64(k, {i}, v{i} is null, v{i}) as h{i}" for i in range(len(fields))])
    return out.selectExpr("*", f"xxhash64({', '.join(['hk', *[f'h{i}' for i in range(len(fields))]])}) as rh")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.col("kh"), F.lit(buckets)).alias("bucket")


def _matrix(rows: DataFrame, names: list[str], buckets: int, prefix: str) -> DataFrame:
    """Per bucket the weighted count and of each hash the exact 64-bit sum: its upper and its lower half apart, so that no sum overflows."""
    halves = [(n, half) for n in names for half in ("h", "l")]
    sums = [F.expr(f"sum(w * {f'shiftright({n}, 32)' if half == 'h' else f'({n} & 4294967295L)'})").alias(f"{prefix}{n}_{half}") for n, half in halves]
    return rows.groupBy(_bucket(buckets)).agg(F.sum("w").alias(f"{prefix}n"), *sums)


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_diff(first: DataFrame, second: DataFrame, key: str, table_name: str, tolerance: float = 1e-6, rows_per_bucket: int = ROWS_PER_BUCKET, coarse_buckets: int = COARSE_BUCKETS) -> DataFrame:
    """(table_name, row_key, field_name, diff_kind): what differs between two copies.

    A row of the first copy alone gives field ``*`` and ``only_first``, one of
    the second alone ``*`` and ``only_second``, a differing field its name and
    ``value``.  Exact repeats count once; null equals null only; doubles and
    floats are equal within ``tolerance`` (NaN equals NaN); arrays are equal
    whatever their order, repeats counted.  Columns of only one copy are not
    compared.  Where a key has several different rows in a copy, the rows are
    paired in the order of their values and unpaired ones are missing rows.  A
    null key is a key (row_key null).  Two empty copies give no rows.

    Both copies become a matrix of additive 64-bit hashes per key bucket and
    field; in large tables a coarse matrix first tells which part the fine one
    has to cover.  Where a bucket's key checksum differs its keys alone are read
    to find the missing rows, and their hashes are taken off the matrix, so that
    a missing row makes no field unequal.  Of each bucket only the unequal
    fields are then compared; a field that is unequal in no bucket isn't read.
    Keys with several different rows are compared whole, apart.
    """
    keep = Staged(first.sparkSession, "diff")
    others = {f.name: f for f in second.schema}
    fields = [f for f in first.schema if f.name != key and f.name in others]
    names = ["hk", *[f"h{i}" for i in range(len(fields))]]
    copies = {"a": (first, fields), "b": (second, [others[f.name] for f in fields])}
    hashed = {s: _hashed(df, key, own) for s, (df, own) in copies.items()}
    # keys that occur more than once are few in a sound table: with equal rows their surplus gets negative weight, with different rows they are set apart
    often = {s: keep(h.groupBy("kh").agg(F.count(F.lit(1)).alias("n"), (F.min("rh") != F.max("rh")).alias("varied")).where("n > 1")) for s, h in hashed.items()}
    varied = keep(_union(*[o.where("varied").select("kh") for o in often.values()]).distinct())
    some_varied = not varied.isEmpty()
    plain = lambda df: df.join(varied, "kh", "left_anti") if some_varied else df

    def weighted(s: str) -> DataFrame:
        again = hashed[s].join(often[s].where("not varied").select("kh", (1 - F.col("n")).alias("w")), "kh").dropDuplicates(["kh"])
        return plain(hashed[s].withColumn("w", F.lit(1).cast("long")).unionByName(again))

    rows = {s: weighted(s) for s in copies}
    halves = ["n", *[f"{n}_{half}" for n in names for half in ("h", "l")]]
    unlike = lambda *cells: f"not ({' and '.join(f'coalesce(a_{c}, 0) = coalesce(b_{c}, 0)' for c in cells)})"
    within = None
    size = max(df.count() for df, _ in copies.values())
    buckets = max(16, size // rows_per_bucket)
    if buckets > coarse_buckets:
        both = _matrix(rows["a"], names, coarse_buckets, "a_").join(_matrix(rows["b"], names, coarse_buckets, "b_"), "bucket", "full")
        within = keep(both.where(unlike(*halves)).select("bucket"))

    def covered(df: DataFrame) -> DataFrame:
        """The rows of the buckets that the coarse matrix found unequal."""
        if within is None:
            return df
        return df.withColumn("bucket", _bucket(coarse_buckets)).join(F.broadcast(within), "bucket", "left_semi").drop("bucket")

    matrix = {s: _matrix(covered(rows[s]), names, buckets, f"{s}_") for s in copies}
    matrix = keep(matrix["a"].join(matrix["b"], "bucket", "full"))
    torn = matrix.where(unlike("n", "hk_h", "hk_l")).select("bucket")

    def keys(s: str) -> DataFrame:
        df = copies[s][0].select(_key(key).alias("k")).withColumn("kh", F.xxhash64("k"))
        return plain(df.withColumn("bucket", _bucket(buckets)).join(torn, "bucket", "left_semi").select("k", "kh").distinct())

    missing = keys("a").withColumn("in_a", F.lit(True)).join(keys("b").withColumn("in_b", F.lit(True)), ["k", "kh"], "full").where("in_a is null or in_b is null")
    missing = keep(missing.select("k", "kh", F.when(F.col("in_b").isNull(), "only_first").otherwise("only_second").alias("diff_kind")))
    for s, kind in (("a", "only_first"), ("b", "only_second")):  # their hashes are taken off
        gone = _matrix(rows[s].join(missing.where(F.col("diff_kind") == kind).select("kh"), "kh", "left_semi"), names, buckets, "m_")
        other = [f"{x}_{c}" for x in copies if x != s for c in halves]
        matrix = matrix.join(gone, "bucket", "left").selectExpr("bucket", *other, *[f"coalesce({s}_{c}, 0) - coalesce(m_{c}, 0) as {s}_{c}" for c in halves])
    cells = ", ".join(f"case when {unlike(f'h{i}_h', f'h{i}_l')} then {i} end" for i in range(len(fields)))
    unequal = matrix.selectExpr("bucket", f"array_compact(array({cells})) as cells")
    unequal = keep(unequal.where(F.size("cells") > 0)) if fields else None
    at = sorted(r[0] for r in unequal.select(F.explode("cells")).distinct().collect()) if fields else []  # at most one number per column

    def compared(s: str) -> DataFrame:
        """(kh, k, values of the unequal cells) of the rows in unequal buckets."""
        df, own = copies[s]
        out = df.select(_key(key).alias("k"), *[F.expr(_settled(own[i])).alias(f"v{i}") for i in at]).withColumn("kh", F.xxhash64("k"))
        out = out.withColumn("bucket", _bucket(buckets)).join(unequal, "bucket").selectExpr("kh", "k", *[f"case when array_contains(cells, {i}) then v{i} end as v{i}" for i in at])
        return plain(out).join(missing.select("kh"), "kh", "left_anti")

    def digest(s: str) -> DataFrame:
        values = ", ".join(f"v{i} is null, v{i}" for i in at)
        return compared(s).selectExpr("kh", f"xxhash64(k, {values}) as rh", f"{s == 'a'} as x", f"{s == 'b'} as y")

    def differs(i: int) -> str:
        if isinstance(fields[i].dataType, (T.DoubleType, T.FloatType)):
            return f"not (x{i} <=> y{i} or coalesce(abs(x{i} - y{i}) <= {tolerance!r}D, false))"
        return f"not (x{i} <=> y{i})"

    texts = lambda i: "'" + fields[i].name.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found_fields = lambda of: F.expr(f"array_compact(array({', '.join(f'case when {differs(i)} then {texts(i)} end' for i in of)}))")
    found = [missing.select("k", F.lit("*").alias("field_name"), "diff_kind")]
    if at:
        digests = digest("a").unionByName(digest("b")).groupBy("kh", "rh").agg(F.bool_or("x").alias("x"), F.bool_or("y").alias("y"))
        differing = keep(digests.where("not (x and y)").select("kh").distinct())
        suspects = lambda s, as_: compared(s).join(differing, "kh", "left_semi").dropDuplicates(["k"]).selectExpr("k", *[f"v{i} as {as_}{i}" for i in at])
        found.append(suspects("a", "x").join(suspects("b", "y"), "k").select("k", F.explode(found_fields(at)).alias("field_name"), F.lit("value").alias("diff_kind")))
    if some_varied:
        every = range(len(fields))

        def versions(s: str, as_: str) -> DataFrame:
            df, own = copies[s]
            out = df.select(_key(key).alias("k"), *[F.expr(_settled(f)).alias(f"{as_}{i}") for i, f in enumerate(own)]).withColumn("kh", F.xxhash64("k"))
            out = out.join(varied, "kh", "left_semi").drop("kh").distinct()
            order = [F.col(f"{as_}{i}") for i in every] or [F.lit(1)]
            return out.withColumn("version", F.row_number().over(Window.partitionBy("k").orderBy(*order))).withColumn(f"in_{as_}", F.lit(True))

        pairs = versions("a", "x").join(versions("b", "y"), ["k", "version"], "full")
        one = lambda name, kind: F.struct(F.lit(name).alias("field_name"), F.lit(kind).alias("diff_kind"))
        kinds = F.when(F.col("in_y").isNull(), F.array(one("*", "only_first"))).when(F.col("in_x").isNull(), F.array(one("*", "only_second")))
        if fields:
            kinds = kinds.otherwise(F.transform(found_fields(every), lambda f: F.struct(f.alias("field_name"), F.lit("value").alias("diff_kind"))))
        found.append(pairs.select("k", F.explode(kinds).alias("d")).select("k", "d.field_name", "d.diff_kind").distinct())
    row_key = F.when(F.col("k") != F.lit("\x00null"), F.col("k"))
    return _union(*found).select(F.lit(table_name).alias("table_name"), row_key.alias("row_key"), "field_name", "diff_kind")

