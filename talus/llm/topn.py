"""The first N items of every group by bisection of order-preserving codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.skew import split_join
from talus.staging import Staged

#: Parts into which a cutoff interval is cut per pass: six bisections at once.
PARTS = 64
_CHUNK = 7


def double_code(x: Column) -> Column:
    """A bigint that orders as the double does (NaN last of all, null stays null): its exponent and mantissa as one number."""
    a = F.abs(x)
    guess = F.floor(F.log2(F.greatest(a, F.lit(2.2250738585072014e-308))))
    e = guess + F.when(F.pow(F.lit(2.0), guess + 1) <= a, 1).otherwise(0) - F.when(F.pow(F.lit(2.0), guess) > a, 1).otherwise(0)
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + ((a / F.pow(F.lit(2.0), e.cast("double")) - 1) * float(1 << 52)).cast("long")
    small = (a * float(2**537) * float(2**537)).cast("long")
    size = F.when(a < 2.2250738585072014e-308, small).when(a == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    code = F.when(x < 0, -size).otherwise(size)
    return F.when(x.isNull(), F.lit(None).cast("long")).when(F.isnan(x), F.lit((2047 << 52) + 1)).otherwise(code)


def _number_codes(column: Column, kind: str) -> list[Column]:
    """Codes below 2**40 in size, most significant first; null is before everything."""
    if kind in ("double", "float"):
        code = double_code(column.cast("double"))
    elif kind.startswith("decimal"):
        scale = int(kind.rstrip(")").split(",")[1])
        code = (column * F.lit(10**scale)).cast("long")
    else:
        code = column.cast("long")
    high, low = F.shiftright(code, 32), code.bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.coalesce(high, F.lit(-(1 << 40))), F.coalesce(low, F.lit(0).cast("long"))]


def _chunk_code(identifier: Column, i: int) -> Column:
    """Seven bytes of the identifier and how many there are, so that larger codes are earlier in byte order."""
    raw = F.substring(F.encode(identifier, "UTF-8"), 1 + i * _CHUNK, _CHUNK)
    number = F.conv(F.hex(F.rpad(raw, _CHUNK, F.lit(b"\x00"))), 16, 10).cast("long")
    return -(number * 8 + F.length(raw))


def top_n(df: DataFrame, group: str, identifier: str, score: str, then: str, n: int) -> DataFrame:
    """(group, identifier) of the first ``n`` distinct identifiers of every group by ``score`` and ``then``
    descending and identifier ascending in byte order.

    Rows with a null group, identifier or score are left out; a null ``then`` comes
    after all values.  An identifier that occurs more than once in a group counts
    once, with its best row.  Groups with fewer than ``n`` give all they have; an
    empty table gives no rows.

    All groups are bisected at once: a pass counts the rows of each group in the
    parts of its cutoff interval, takes the rows above the part that holds the
    N-th row and goes on with the rows of that part, first on the score's code,
    then on the second measure's, then on the identifier's, until exactly ``n``
    are taken.  Counts fold on the map side; no group is sorted or gathered.
    """
    keep = Staged(df.sparkSession, "topn")
    kinds = dict(df.dtypes)
    rows = df.select(F.col(group).alias("g"), F.col(identifier).cast("string").alias("id"), *[c for i, m in enumerate((score, then)) for c in [x.alias(f"c{2 * i + j}") for j, x in enumerate(_number_codes(F.col(m), kinds[m]))]], F.col(score).isNotNull().alias("scored"))
    rows = rows.where("g is not null and id is not null and scored")
    best = F.max(F.struct("c0", "c1", "c2", "c3")).alias("b")
    active = keep(rows.groupBy("g", "id").agg(best).select("g", "id", "b.*", F.lit(n).cast("long").alias("need")))
    left, level, fresh, taken = active.count(), 0, True, []
    while left:
        rows = active.withColumn("c", F.col(f"c{level}") if level < 4 else _chunk_code(F.col("id"), level - 4))
        if fresh:  # of a new level the interval of each group is unknown
            spans = rows.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("rows"))
            rows = split_join(rows, spans, "g", "rows", left)
        rows = rows.withColumn("part", F.expr(f"(c - lo) div ((hi - lo) div {PARTS} + 1)"))
        counts = rows.groupBy("g", "need", "part").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("lo2"), F.max("c").alias("hi2"))
        down = Window.partitionBy("g").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)
        sums = counts.withColumn("upto", F.sum("k").over(down)).withColumn("rows", F.sum("k").over(Window.partitionBy("g")))
        # the part that holds the need-th row, or the last part of a group with no more rows than needed
        cut = sums.where("upto >= need and upto - k < need or rows <= need and upto = rows")
        state = keep(cut.select("g", "rows", "lo2", "hi2", (F.col("need") - (F.col("upto") - F.col("k"))).alias("need2"), (F.col("upto") <= F.col("need")).alias("done")))
        judged = keep(split_join(rows.select("g", "id", "c0", "c1", "c2", "c3", "c"), state, "g", "rows", left))
        taken.append(judged.where("c > hi2 or done and c >= lo2").select("g", "id"))
        rest = judged.where("c between lo2 and hi2 and not done").drop("c", "done")
        left = rest.count()
        # groups cut down to one code wait for the others; then all go on with the next code
        fresh = rest.where("lo2 < hi2").isEmpty()
        level += fresh
        active = rest.select("g", "id", "c0", "c1", "c2", "c3", F.col("need2").alias("need"), *([] if fresh else [F.col("lo2").alias("lo"), F.col("hi2").alias("hi")]))
    if not taken:
        return df.select(group, F.col(identifier).cast("string").alias(identifier)).limit(0)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.select(F.col("g").alias(group), F.col("id").alias(identifier))
