"""References to records that do not exist, found with a Bloom filter of the parent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of 256 bits; the filter never has more, so what is broadcast is at most 2**18 rows of 40 bytes.
MAX_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 12
_WORDS, _BITS = 4, 8


def bloom_filter(keys: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of ``key`` as a table (block, w0..w3) of at most ``max_blocks`` rows, and its number of blocks."""
    n = keys.count()
    blocks = min(max_blocks, max(1, n // KEYS_PER_BLOCK))
    h = F.xxhash64(F.col(key))
    bit = F.explode(F.array(*[F.pmod(F.xxhash64(F.col("h"), F.lit(i + 1)), F.lit(256)).cast("int") for i in range(_BITS)]))
    bits = keys.select(h.alias("h")).select(F.pmod("h", F.lit(blocks)).alias("block"), bit.alias("bit"))
    one = F.expr("shiftleft(1L, bit & 63)")
    word = lambda w: F.coalesce(F.bit_or(F.when(F.expr("bit >> 6") == w, one)), F.lit(0).cast("long")).alias(f"w{w}")
    return bits.groupBy("block").agg(*[word(w) for w in range(_WORDS)]), blocks


def might_contain(refs: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """``refs`` with ``maybe``: false proves that the key is not in the filter (null keys give false)."""
    h = F.xxhash64(F.col(key))
    joined = refs.withColumn("block", F.pmod(h, F.lit(blocks))).join(F.broadcast(bloom), "block", "left")
    hit = F.lit(True)
    for i in range(_BITS):
        bit = f"cast(pmod(xxhash64(xxhash64(`{key}`), {i + 1}), 256) as int)"
        word = f"case {bit} >> 6 when 0 then w0 when 1 then w1 when 2 then w2 else w3 end"
        hit = hit & F.expr(f"({word} & shiftleft(1L, {bit} & 63)) != 0")
    maybe = F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()
    return joined.withColumn("maybe", maybe).drop("block", *[f"w{w}" for w in range(_WORDS)])


def orphan_references(refs: DataFrame, parents: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of ``refs`` whose ``key`` is no key of ``parents``, whole and with repeats.

    A Bloom filter of the parent keys, of bounded size, is broadcast and proves
    most orphans without a shuffle.  References that pass it are verified by an
    exact join of their distinct keys, so a key with a third of all references
    is compared once.  A null key refers to nothing and is left out.  Without
    parents every reference is an orphan.
    """
    rows = refs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("_key"), F.struct(*[F.col(f"`{c}`") for c in refs.columns]).alias("_row"))
    keys = parents.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("_key"))
    bloom, blocks = bloom_filter(keys, "_key", max_blocks)
    tested = might_contain(rows, "_key", bloom, blocks)
    passed = tested.where("maybe").drop("maybe")
    missing = passed.select("_key").distinct().join(keys, "_key", "left_anti")
    found = tested.where("not maybe").drop("maybe").unionByName(passed.join(missing, "_key", "left_semi"))
    return found.select("_row.*")


def cited_reports(text: Column) -> Column:
    """The reports that a free text cites, each once, as ``YY-N``.

    A citation is a year of two or four digits, a dash and a number; further
    numbers joined by comma, slash, ampersand or ``and`` share the year unless
    they begin a citation of their own.  Page numbers and bare years cite
    nothing; null and empty texts give an empty array.
    """
    dash = r"\s*[-‐-―−]\s*"
    cite = rf"(?<!\d)(?<!p\.)(?<!p\. )(?<!\d[-])(?:20)?\d{{2}}{dash}\d+(?!\d)(?:\s*(?:,|/|&|\+|and)\s*\d+(?!\d|{dash}\d))*"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(cite), F.lit(0))
    year = lambda m: F.regexp_extract(m, rf"^(?:20)?(\d{{2}}){dash}", 1)
    numbers = lambda m: F.regexp_extract_all(F.regexp_replace(m, rf"^(?:20)?\d{{2}}{dash}", ""), F.lit(r"\d+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(found, lambda m: F.transform(numbers(m), lambda n: F.concat(year(m), F.lit("-"), n)))))
