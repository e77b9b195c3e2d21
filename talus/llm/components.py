"""Connected components of pairwise matches by raking, chain compression and a reduced core."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators.skew import split_join
from talus.staging import Staged


def _ends(edges: DataFrame) -> DataFrame:
    """(v, degree, n1, n2): of each vertex its degree and its smallest and largest neighbour, folded on the map side."""
    arcs = edges.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("w").alias("n")), F.struct(F.col("w").alias("v"), F.col("u").alias("n")))).alias("a")).select("a.*")
    return arcs.groupBy("v").agg(F.count(F.lit(1)).alias("degree"), F.min("n").alias("n1"), F.max("n").alias("n2"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("w")]


def _strip_leaves(edges: DataFrame, keep: Staged) -> tuple[DataFrame, DataFrame, int]:
    """(edges without degree-one vertices, (v, parent) of the removed, their number); of a lone pair the smaller key stays."""
    leaves = _ends(edges).where("degree = 1").select("v", F.col("n1").alias("parent"))
    lone = leaves.select(F.col("parent").alias("v"), F.col("v").alias("parent"), F.lit(True).alias("lone"))
    gone = keep(leaves.join(lone, ["v", "parent"], "left").where("lone is null or v > parent").drop("lone"))
    rest = keep(edges.join(gone.select(*_pair("v", "parent")), ["u", "w"], "left_anti"))
    return rest, gone, gone.count()


def _compress_chains(edges: DataFrame, keep: Staged) -> tuple[DataFrame, DataFrame, int]:
    """(edges with every chain of degree-two vertices replaced by one edge, (v, parent) of the removed, their number).

    List ranking by pointer doubling: the state of an inner vertex v entered
    from p is the arc that it leads to; an arc whose head is no inner vertex is
    at its end.  Each doubling ends at least one arc of every chain, so when none
    ends the running arcs lie on pure cycles, which are left for the core.
    """
    inner = keep(_ends(edges).where("degree = 2").select("v", "n1", "n2"))
    n = inner.count()
    if not n:
        return edges, inner.select("v", F.col("n1").alias("parent")), 0
    ways = F.array(F.struct(F.col("n1").alias("p"), F.col("n2").alias("head")), F.struct(F.col("n2").alias("p"), F.col("n1").alias("head")))
    arcs = inner.select("v", F.explode(ways).alias("a")).select("v", "a.p", "a.head", F.col("v").alias("before"), F.lit(False).alias("ended"))
    arcs, old, running_before = keep(arcs), None, -1
    while True:
        ahead = arcs.select(F.col("v").alias("head"), F.col("p").alias("before"), F.col("head").alias("head2"), F.col("before").alias("before2"), F.col("ended").alias("ended2"))
        running = arcs.where("not ended").join(ahead, ["head", "before"], "left").select(
            "v", "p", F.coalesce("head2", "head").alias("head"), F.when(F.col("head2").isNull(), F.col("before")).otherwise(F.col("before2")).alias("before"), F.coalesce("ended2", F.lit(True)).alias("ended")
        )
        old, arcs = arcs, keep(arcs.where("ended").unionByName(running))
        keep.drop(old)
        left = arcs.where("not ended").count()
        if left in (0, running_before):
            break
        running_before = left
    done = arcs.where("ended").groupBy("v").agg(F.min("head").alias("a"), F.max("head").alias("b"), F.count(F.lit(1)).alias("k")).where("k = 2")
    gone = keep(done.select("v", F.col("a").alias("parent"), "b"))
    cut = inner.join(gone.select("v"), "v", "left_semi").select(F.explode(F.array(F.struct(*_pair("v", "n1")), F.struct(*_pair("v", "n2")))).alias("e")).select("e.*")
    bridges = gone.where("parent < b").select(F.col("parent").alias("u"), F.col("b").alias("w"))
    rest = keep(edges.join(cut, ["u", "w"], "left_anti").unionByName(bridges).distinct())
    keep.drop(arcs, inner)
    return rest, gone.select("v", "parent"), gone.count()


def _solve_core(edges: DataFrame, keep: Staged) -> DataFrame:
    """(v, label) of every vertex of ``edges``: alternating large and small stars until only stars are left."""
    last, seen = None, None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "w"), F.struct(F.col("w").alias("u"), F.col("u").alias("w")))).alias("a")).select("a.*")
        total = 2 * edges.count()
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = split_join(both.where("w > u"), least, "u", "n", total).select(F.col("w").alias("u"), F.col("m").alias("w")).where("u != w").distinct()
        large = keep(large)
        down = large.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w"))
        least = down.groupBy("u").agg(F.min("w").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = split_join(down, least, "u", "n", total)
        small = moved.select(F.col("w").alias("u"), F.col("m").alias("w")).unionByName(moved.select("u", F.col("m").alias("w"))).where("u != w").distinct()
        new = keep(small.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct())
        keep.drop(large)
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(20,0)"))).first()
        keep.drop(last)
        last, edges = new, new
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return edges.select(F.col("w").alias("v"), F.col("u").alias("label"))


def _roots(layers: list[DataFrame], keep: Staged) -> DataFrame:
    """(v, root): the vertices removed in all rounds, each with the vertex that its parents lead to, which was removed last or never.

    Pointer doubling over all layers at once: as many passes as the logarithm of their number, over the removed vertices alone.
    """
    forest = layers[0]
    for layer in layers[1:]:
        forest = forest.unionByName(layer)
    forest = keep(forest.select("v", F.col("parent").alias("root")))
    total = forest.count()
    while True:
        above = forest.select(F.col("v").alias("root"), F.col("root").alias("above"))
        states = forest.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(above, "root", "left").select("root", "above", "n")
        moved = keep(split_join(forest, states, "root", "n", total).select("v", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        keep.drop(forest)
        forest = moved
        if moved.where("moved").isEmpty():
            return forest.select("v", "root")


def _numbered(edges: DataFrame, keys: DataFrame, keep: Staged) -> DataFrame:
    """Edges between keys as edges between their numbers, the smaller first; a key with many edges is joined with its number broadcast."""
    edges = keep(edges)
    degrees = edges.select(F.explode(F.array("u", "w")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    numbers, total = keep(degrees.join(keys, "v").select("v", "id", "n")), edges.count()
    for end in ("u", "w"):
        edges = split_join(edges, numbers.withColumnRenamed("v", end), end, "n", total).drop(end).withColumnRenamed("id", end)
    return edges.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w"))


def connected_groups(pairs: DataFrame, left: str, right: str, extra_keys: DataFrame | None = None) -> DataFrame:
    """(entity_key, group_key): one row per distinct key, with the smallest key of its group (byte order).

    ``pairs`` states matches between ``left`` and ``right``, from either side and
    with repeats; a pair with a null side is no match, but its other key still
    gets a row, and so do the keys (first column) of ``extra_keys``.  Keys are
    compared as stored.  An empty input gives no rows.

    Rounds strip degree-one vertices and compress degree-two chains by list
    ranking while that removes at least a tenth of the vertices; the reduced
    core is solved by star contraction, and labels are restored to the removed
    vertices, of all rounds at once, by pointer doubling.  Every step aggregates or joins
    on keys; a vertex or group with many rows is folded on the map side or
    joined with its state broadcast.
    """
    spark = pairs.sparkSession
    keep = Staged(spark, "groups")
    l, r = F.col(f"`{left}`").cast("string"), F.col(f"`{right}`").cast("string")
    keys = pairs.select(F.explode(F.array(l, r)).alias("v"))
    if extra_keys is not None:
        keys = keys.unionByName(extra_keys.select(F.col(extra_keys.columns[0]).cast("string").alias("v")))
    # numbers in place of the keys from here on: they are written once, so they stay what they are
    keys = keep(keys.where(F.col("v").isNotNull()).distinct().select("v", F.monotonically_increasing_id().alias("id")))
    edges = keep(_numbered(pairs.where(l.isNotNull() & r.isNotNull() & (l != r)).select(F.least(l, r).alias("u"), F.greatest(l, r).alias("w")).distinct(), keys, keep))
    removed: list[tuple[DataFrame, int]] = []
    vertices = _ends(edges).count()  # keys without a match count for nothing here
    while True:
        before = edges
        edges, gone, n = _strip_leaves(edges, keep)
        chained, inner, m = _compress_chains(edges, keep)
        removed += [(g, k) for g, k in ((gone, n), (inner, m)) if k]
        if m:
            keep.drop(edges)
        edges = chained
        if before is not edges:
            keep.drop(before)
        vertices -= n + m
        if 10 * (n + m) <= vertices or edges.isEmpty():
            break
    labels = keep(_solve_core(edges, keep)) if not edges.isEmpty() else None
    if removed:
        forest, n_removed = _roots([g for g, _ in removed], keep), sum(n for _, n in removed)
        if labels is None:
            labels = forest.select("v", F.col("root").alias("label"))
        else:
            states = forest.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(labels.select(F.col("v").alias("root"), "label"), "root", "left")
            found = split_join(forest, states.select("root", F.coalesce("label", "root").alias("label"), "n"), "root", "n", n_removed)
            labels = keep(labels.unionByName(found.select("v", "label")))
    if labels is None:
        return keys.select(F.col("v").alias("entity_key"), F.col("v").alias("group_key"))
    every = labels.select(F.col("v").alias("id"), "label").unionByName(labels.select(F.col("label").alias("id"), "label").distinct())
    members = keep(keys.join(every, "id", "left").select("v", F.coalesce("label", "id").alias("label")))
    least = members.groupBy("label").agg(F.min("v").alias("group_key"), F.count(F.lit(1)).alias("n"))
    return split_join(members, least, "label", "n", members.count()).select(F.col("v").alias("entity_key"), "group_key")
