"""Mapping free-entered values to a reference list by weighted character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.names import fold
from talus.operators.skew import split_join
from talus.staging import Staged
from talus.tables import is_blank

#: The best entry is accepted at this cosine and this margin over the second best.
ACCEPT, MARGIN = 0.37, 0.03
#: Index rows up to which the index is broadcast (some 60 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000
#: A word that the list doesn't have says nothing if at least LEAST values have it and so large a share of them
#: names an entry at the cosine STRONG by the words that the list has.
LEAST, SHARE, STRONG = 5, 0.6, 0.7
UNMATCHED = -1
_READ_AS = str.maketrans("015", "OIS")


def words_of(value: str) -> list[str]:
    """Words in upper case without accents; dotted letters as one word; digits misread within words as letters."""
    text = re.sub(r"(?<=\w)['’](?=\w)", "", fold(value))
    text = re.sub(r"\b(?:[A-Z]\.){2,}", lambda m: m[0].replace(".", ""), text)
    return [w if w.isdigit() else w.translate(_READ_AS) for w in re.findall(r"[A-Z0-9]+", text)]


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([words_of(v) for v in batch.column(0).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), words], ["value", "words"])


def with_words(values: DataFrame) -> DataFrame:
    """(value, words) of a table with one column of strings."""
    return values.mapInArrow(_word_batches, "value string, words array<string>")


def grams_of(keys: DataFrame) -> DataFrame:
    """(key, gram, n): how often each trigram occurs in the words of ``key``, whose ends are marked; the order of words doesn't count."""
    words = keys.select("key", F.explode(F.split("key", " ")).alias("w")).where("w != ''")
    grams = words.selectExpr("key", "explode(transform(sequence(1, length(w)), i -> substring(concat('^', w, '$'), i, 3))) as gram")
    return grams.groupBy("key", "gram").agg(F.count(F.lit(1)).alias("n"))


class GramIndex:
    """An inverted index of the trigrams of a list's entries, each under all its names."""

    def __init__(self, entries: DataFrame, entry_id: str, names: list[str], keep: Staged):
        every = entries.select(F.col(f"`{entry_id}`").alias("id"), F.explode(F.array(*[F.col(f"`{n}`").cast("string") for n in names])).alias("value")).where("id is not null and value is not null")
        words = with_words(every.select("value").distinct()).select("value", F.array_join(F.array_sort("words"), " ").alias("key"))
        self.named = keep(every.join(words, "value").where("key != ''").select("id", "key").distinct())
        keys = self.named.select("key").distinct()
        self.words = keep(keys.select(F.explode(F.split("key", " ")).alias("word")).distinct())
        grams = keep(grams_of(keys))
        self.size = keys.count()
        rarity = grams.groupBy("gram").agg(F.log(1 + F.lit(float(self.size)) / F.count(F.lit(1))).alias("rarity"))
        self.rarity = keep(rarity)
        weighted = grams.join(rarity, "gram").select("key", "gram", (F.col("n") * F.col("rarity")).alias("w"))
        norms = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        self.parts = keep(weighted.join(norms, "key").select(F.col("key").alias("entry"), "gram", (F.col("w") / F.col("norm")).alias("part")))
        self.is_small = self.parts.count() <= BROADCAST_ROWS

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.is_small else df

    def best(self, keys: DataFrame, least: float) -> DataFrame:
        """(key, id, score, margin): the entry whose cosine with the words of ``key`` is largest, if at ``least``; margin over the next entry at ``least`` or else over that.

        Postings are pruned by weight: the commonest trigrams, which together
        can't lift a cosine to ``least``, look up no candidates; they are added
        only to candidates that may still reach it.
        """
        unknown = F.lit(1 + 2.0 * self.size)
        weighted = grams_of(keys).join(self._small(self.rarity), "gram", "left").select("key", "gram", (F.col("n") * F.coalesce("rarity", F.log(unknown))).alias("w"))
        of, square = Window.partitionBy("key"), F.col("w") * F.col("w")
        upward = of.orderBy("w", F.desc("gram")).rowsBetween(Window.unboundedPreceding, 0)
        weighted = weighted.select("key", "gram", "w", F.sqrt(F.sum(square).over(of)).alias("norm"), F.sqrt(F.sum(square).over(upward)).alias("below"))
        looking = F.col("below") >= least * F.col("norm")
        first = weighted.where(looking).join(self._small(self.parts), "gram").groupBy("key", "entry").agg(F.sum(F.col("w") * F.col("part")).alias("dot"), F.first("norm").alias("norm"))
        rest = weighted.where(~looking)
        most = rest.groupBy("key").agg(F.max("below").alias("rest"))
        may = first.join(most, "key", "left").where(F.col("dot") + F.coalesce("rest", F.lit(0.0)) >= F.lit(least - 1e-9) * F.col("norm"))
        added = may.select("key", "entry").join(rest.select("key", "gram", "w"), "key").join(self._small(self.parts), ["gram", "entry"]).groupBy("key", "entry").agg(F.sum(F.col("w") * F.col("part")).alias("more"))
        scored = may.join(added, ["key", "entry"], "left").select("key", "entry", F.least((F.col("dot") + F.coalesce("more", F.lit(0.0))) / F.col("norm"), F.lit(1.0)).alias("score"))
        by_id = scored.where(F.col("score") >= least).join(self._small(self.named).withColumnRenamed("key", "entry"), "entry").groupBy("key", "id").agg(F.max("score").alias("score"))
        best = by_id.groupBy("key").agg(F.max(F.struct("score", "id")).alias("b"))
        second = by_id.join(best.select("key", "b"), "key").where("id != b.id").groupBy("key").agg(F.max("score").alias("second"))
        return best.join(second, "key", "left").select("key", "b.id", "b.score", (F.col("b.score") - F.coalesce("second", F.lit(least))).alias("margin"))


def map_values(rows: DataFrame, value: str, entries: DataFrame, entry_id: str, entry_name: str, short_name: str) -> DataFrame:
    """``rows`` with the id of the entry that ``value`` names (-1: none) and ``score``, the cosine of the best entry (0: none near).

    Rows with a null or blank value are left out; all others come out once each.
    Distinct values are brought into words, and their character trigrams look up
    candidates in an inverted index of the list, which has each entry under its
    name and its short name.  The score is the cosine of the trigrams weighted
    by their rarity in the list; the best entry is accepted above a threshold
    and a margin over the second.

    Words that say nothing about the entry (the home state, kinds of bodies in
    other spellings, units, remarks) are learned from all values: words that the
    list doesn't have and that mostly stand beside words which name an entry by
    themselves.  They are left out.  With an empty list every value is
    unmatched; two entries that are alike leave a value unmatched.
    """
    keep = Staged(rows.sparkSession, "mapping")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (entry_id, "score")]
    typed = rows.where(~is_blank(F.col(f"`{value}`"))).select(F.col(f"`{value}`").alias("_value"), *kept)
    counts = keep(typed.groupBy(F.col("_value").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    index = GramIndex(entries, entry_id, [entry_name, short_name], keep)
    spread = counts.select("value").repartition(rows.sparkSession.sparkContext.defaultParallelism, "value")  # little data, much work
    listed = index.words.withColumn("known", F.lit(True))
    words = with_words(spread).select("value", F.explode("words").alias("word")).join(index._small(listed), "word", "left")
    words = keep(words.select("value", "word", F.col("known").isNotNull().alias("known")))
    keyed = lambda df, holds: df.groupBy("value").agg(F.array_join(F.array_sort(F.collect_list(F.when(holds, F.col("word")))), " ").alias("key"))

    plain = keep(keyed(words, F.col("known")))
    sure = index.best(plain.select("key").distinct(), STRONG).select("key", F.lit(1).alias("strong"))
    named = plain.join(sure, "key", "left").select("value", F.coalesce("strong", F.lit(0)).alias("strong"))
    beside = words.where("not known").select("value", "word").distinct().join(named, "value").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("strong").alias("strong"))
    silent = keep(beside.where((F.col("n") >= LEAST) & (F.col("strong") >= SHARE * F.col("n"))).select("word", F.lit(True).alias("silent")))

    telling = keep(keyed(words.join(silent, "word", "left"), F.col("silent").isNull()))
    best = index.best(telling.select("key").distinct(), ACCEPT - MARGIN)  # so that every second best that counts is known
    accepted = F.when((F.col("score") >= ACCEPT) & (F.col("margin") >= MARGIN - 1e-9), F.col("id"))
    found = telling.join(best, "key", "left").select("value", accepted.alias("found"), "score")
    decided = counts.join(found, "value", "left")
    decided = keep(decided.select("value", F.coalesce("found", F.lit(UNMATCHED)).cast("int").alias(entry_id), F.coalesce("score", F.lit(0.0)).alias("score"), "n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return split_join(typed, decided.withColumnRenamed("value", "_value").withColumnRenamed("n", "_n"), "_value", "_n", total).drop("_value")
