"""Entity resolution by blocks of a first core word, and rollups by parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.cleaning import core_tokens
from talus.staging import Staged

# Legal suffixes and joining words that tell no company apart, joint ventures, and public bodies.
SUFFIXES = ["INC", "INCORPORATED", "LLC", "LLP", "LP", "LLLP", "LLLC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PC", "PLLC", "PLC", "APC", "PA", "PLLP", "USA", "NA", "NATL", "THE", "AN", "GROUP"]
JOINING = ["A", "AND", "OF", "THE", "FOR", "TO"]
JOINT_VENTURE = r"\b(JOINT VENTURE|JT VENTURE|JV|J V|A JV)\b"
PUBLIC_BODY = (
    r"\b(COUNTY|CITY OF|TOWN OF|STATE OF|UNIVERSITY|COMMUNITY COLLEGE|COLLEGE DISTRICT|SCHOOL DISTRICT|UNIFIED SCHOOL|HIGH SCHOOL|TREASURER|DEPARTMENT OF|DEPT OF"
    r"|RETIREMENT SYSTEM|REGENTS|MUNICIPAL|CONSERVATION DISTRICT|FIRE DISTRICT|FAIR ASSOCIATION)\b"
)
LEAST_JACCARD = 0.67


def prepared(names: DataFrame) -> DataFrame:
    """Adds core (words in order), cset (its sorted set), first (the block), jv and public."""
    core = core_tokens(F.col("entity_key"), SUFFIXES + JOINING)
    out = names.withColumn("core", core).withColumn("cset", F.array_sort(F.array_distinct("core")))
    return out.withColumn("first", F.when(F.size("core") > 0, F.col("core")[0]).otherwise(F.col("entity_key"))).withColumn("jv", F.col("entity_key").rlike(JOINT_VENTURE)).withColumn("public", F.col("entity_key").rlike(PUBLIC_BODY))


def match_rule(a: str, b: str) -> Column:
    """Which rule joins two names of a block: equal core sets, one within the other, or similar sets; null if none."""
    x, y = F.col(f"{a}.cset"), F.col(f"{b}.cset")
    common = F.size(F.array_intersect(x, y))
    within = ((common == F.size(x)) & (F.size(x) < F.size(y)) & (F.size(x) >= 2)) | ((common == F.size(y)) & (F.size(y) < F.size(x)) & (F.size(y) >= 2))
    alike = (common / F.size(F.array_union(x, y)).cast("double") >= LEAST_JACCARD) & (F.slice(x, 1, 2) == F.slice(y, 1, 2))
    rule = F.when(x == y, "norm_exact").when(F.col(f"{a}.jv"), F.lit(None)).when(within, "token_subset").when(alike, "token_jaccard")
    return F.when((F.size(x) > 0) & (F.size(y) > 0), rule)


def match_edges(names: DataFrame) -> DataFrame:
    """(a, b, rule) of the matching names of every block.

    Public bodies never match, joint ventures only one another.  Names with equal
    core sets are joined to the first of them instead of all to all, so a block
    compares only its different sets.
    """
    rows = prepared(names).where("not public and size(cset) > 0")
    same = Window.partitionBy("first", "jv", "cset")
    heads = rows.withColumn("head", F.min("entity_key").over(same))
    exact = heads.where("entity_key != head").select(F.col("head").alias("a"), F.col("entity_key").alias("b"), F.lit("norm_exact").alias("rule"))
    distinct = heads.where("entity_key = head").select("entity_key", "first", "jv", "cset")
    # a set within another, or like it, has its first two words among the other's
    pairs_of = lambda c: F.flatten(F.transform(c, lambda u, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda v: F.concat_ws(" ", u, v))))
    several = distinct.where("size(cset) >= 2")
    keyed = several.withColumn("word", F.concat_ws(" ", F.slice("cset", 1, 2)))
    other = several.withColumn("word", F.explode(pairs_of(F.col("cset"))))
    x, y = keyed.alias("x"), other.alias("y")
    on = (F.col("x.first") == F.col("y.first")) & (F.col("x.word") == F.col("y.word")) & (F.col("x.jv") == F.col("y.jv")) & (F.col("x.entity_key") != F.col("y.entity_key"))
    pairs = x.join(y, on).select(F.least("x.entity_key", "y.entity_key").alias("a"), F.greatest("x.entity_key", "y.entity_key").alias("b"), match_rule("x", "y").alias("rule")).where("rule is not null")
    return exact.unionByName(pairs.distinct())


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(key, root): smallest key reachable over the edges, by label propagation with pointer jumping until nothing changes."""
    keep = Staged(edges.sparkSession, "roots")
    arcs = edges.select(F.col(left).alias("k"), F.col(right).alias("n")).unionByName(edges.select(F.col(right).alias("k"), F.col(left).alias("n"))).distinct()
    arcs = keep(arcs)
    labels = keep(arcs.groupBy("k").agg(F.least(F.min("n"), F.col("k")).alias("root")))
    while True:
        near = arcs.join(labels.select(F.col("k").alias("n"), "root"), "n").groupBy("k").agg(F.min("root").alias("near"))
        lower = labels.join(near, "k").select("k", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        jump = labels.select(F.col("k").alias("low"), F.col("root").alias("lower"))
        new = keep(lower.join(jump, "low", "left").select("k", F.least("low", F.coalesce("lower", "low")).alias("root"), (F.least("low", F.coalesce("lower", "low")) != F.col("was")).alias("moved")))
        keep.drop(labels)
        labels = new.select("k", "root")
        labels._staged_path = new._staged_path
        if new.where("moved").isEmpty():
            return labels


def resolve(names: DataFrame) -> DataFrame:
    """entity_crosswalk: every name with its parent, the method, the confidence and the size of its group.

    ``names`` has entity_key (unique), display_name, exposure and n_txn.  The
    parent is the member of the largest exposure, then count, then the first by
    name.  The parent's own method is ``parent``; confidence is high if the group
    has a certain match, medium if it has only likely ones, singleton else.
    """
    edges = Staged(names.sparkSession, "edges")(match_edges(names))
    roots = components(edges, "a", "b").select(F.col("k").alias("entity_key"), "root")
    rows = names.join(roots, "entity_key", "left").withColumn("root", F.coalesce("root", "entity_key"))
    rules = edges.join(roots.select(F.col("entity_key").alias("a"), "root"), "a").groupBy("root").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    rank = Window.partitionBy("root").orderBy(F.desc_nulls_last("exposure"), F.desc_nulls_last("n_txn"), F.asc("entity_key"))
    parents = rows.withColumn("rn", F.row_number().over(rank)).where("rn = 1").select("root", F.col("entity_key").alias("parent_key"), F.col("display_name").alias("parent_name"))
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"))
    out = rows.join(parents, "root").join(sizes, "root").join(rules, "root", "left")
    likely = F.array_contains("rules", "norm_exact") | F.array_contains("rules", "token_subset")
    confidence = F.when(F.col("rules").isNull(), "singleton").when(likely, "high").otherwise("medium")
    method = F.when(F.col("entity_key") == F.col("parent_key"), "parent").otherwise(F.array_join("rules", "+"))
    return out.select("entity_key", "parent_key", "parent_name", method.alias("method"), confidence.alias("confidence"), "group_size")


def entity_names(scored: DataFrame, placeholders: list[str]) -> DataFrame:
    """The resolver's input from scored payments: key, display name, exposure, counts."""
    from talus.functions.cleaning import entity_key

    rows = scored.withColumn("entity_key", entity_key(F.col("payee"))).where(F.col("entity_key").isNotNull() & ~F.col("entity_key").isin(placeholders))
    return rows.groupBy("entity_key").agg(F.mode("payee", deterministic=True).alias("display_name"), F.sum("amount").alias("exposure"), F.count(F.lit(1)).alias("n_txn"), F.count(F.when(F.col("marker_sum") > 0, 1)).alias("n_flagged"), F.max((F.col("tier") == 1).cast("int")).alias("has_tier1"))
