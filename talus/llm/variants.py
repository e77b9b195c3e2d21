"""Linking the spellings of a payee by a pigeonhole segment join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.components import connected_groups
from talus.llm.names import Lexicon, evidence, lexicon_of
from talus.staging import Staged

_PARSED = "key string, kind string, canon string, forms array<string>, attr string, cands array<string>, num string, legal string"


#: A phrase or given name belongs to the lexicon if at least LEAST distinct names show it, and this share of them.
LEAST, SHARE = 5, 0.002


def _evidence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for key in batch.column(0).to_pylist() for x in evidence(key)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["kind", "words"])


def learned_lexicon(keys: DataFrame) -> Lexicon:
    """Trades and given names in use among distinct name keys: words that many names share, of which there are at most some thousand."""
    least = max(LEAST, int(SHARE * keys.count()))
    counts = keys.mapInArrow(_evidence_batches, "kind string, words string").groupBy("kind", "words").agg(F.count(F.lit(1)).alias("n"))
    return lexicon_of({(r.kind, r.words): r.n for r in counts.where(F.col("n") >= least).collect()})


def _parse_batches(lexicon: Lexicon):
    names = ["key", "kind", "canon", "forms", "attr", "cands", "num", "legal"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                p = lexicon.parse(key)
                if p:
                    forms = sorted({p["core"], p["other"]} - {""})
                    rows.append((key, p["kind"], forms[0], forms, p["attr"], p["cands"], p["num"], p["legal"]))
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return run


def errors_allowed(kind: str, length: int) -> int:
    """Edits that two spellings of a name may be apart: one in short names, two, and three in the two words of a firm."""
    return 1 if length < 8 else 2 if length < 12 or kind == "person" else 3


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k+1 even segments of a string."""
    short, longer = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = short + (i >= k + 1 - longer)
        out.append((at, n))
        at += n
    return out


def probes(form: str, kind: str) -> Iterator[tuple[int, int, str]]:
    """(length, segment, substring) of the segments that a string no longer than ``form`` shares with it
    if they are at most ``errors_allowed`` edits apart; starts shifted as far as the edits before and after allow."""
    size = len(form)
    for length in range(max(1, size - 3), size + 1):
        k = errors_allowed(kind, length)
        gap = size - length
        if gap > k:
            continue
        for i, (start, n) in enumerate(segments(length, k)):
            if n:
                low = max(0, start - i, start + gap - (k - i))
                high = min(size - n, start + i, start + gap + (k - i))
                for at in range(low, high + 1):
                    yield length, i, form[at : at + n]


def _signatures(batches: Iterator[pa.RecordBatch], index: bool, probe: bool) -> Iterator[pa.RecordBatch]:
    """(node, kind, canon, forms, block) to (sig, node, form, side): the index entries and probes of every node."""
    from xxhash import xxh64_intdigest

    def sig(block: str, length: int, i: int, part: str) -> int:
        h = xxh64_intdigest(f"{block}\x1f{length}\x1f{i}\x1f{part}")
        return h - (1 << 64) if h >= 1 << 63 else h

    for batch in batches:
        sigs, nodes, texts, sides = [], [], [], []
        for node, kind, canon, forms, block in zip(*(c.to_pylist() for c in batch.columns)):
            if index:
                for i, (start, n) in enumerate(segments(len(canon), errors_allowed(kind, len(canon)))):
                    if n:
                        sigs.append(sig(block, len(canon), i, canon[start : start + n])), nodes.append(node), texts.append(canon), sides.append(True)
            if probe:
                for form in forms:
                    for found in probes(form, kind):
                        sigs.append(sig(block, *found)), nodes.append(node), texts.append(form), sides.append(False)
        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(nodes, pa.string()), pa.array(texts, pa.string()), pa.array(sides, pa.bool_())], ["sig", "node", "form", "indexed"])


def _entries(nodes: DataFrame, index: bool, probe: bool) -> DataFrame:
    return nodes.select("node", "kind", "canon", "forms", "block").mapInArrow(lambda b: _signatures(b, index, probe), "sig bigint, node string, form string, indexed boolean")


def segment_join(probing: DataFrame, indexed: DataFrame | None = None, both_ways: bool = False) -> DataFrame:
    """(a, b, gap): nodes of ``probing`` and of ``indexed`` (else of ``probing`` too) of one block whose names are within the errors allowed.

    Nodes have node, kind, canon (the name as indexed), forms (as it may be
    written) and block.  A pair is found where the longer name has a segment of
    the shorter; ``both_ways`` also probes from the indexed side, for two
    different inputs.  Every candidate is verified by banded edit distance.
    """
    same = indexed is None
    left = _entries(probing, True, True) if same else _entries(probing, both_ways, True)
    right = left if same else _entries(indexed, True, both_ways)

    def verified(p: DataFrame, i: DataFrame, swap: bool) -> DataFrame:
        pairs = p.where("not indexed").select("sig", F.col("node").alias("p"), F.col("form").alias("pf")).join(i.where("indexed").select("sig", F.col("node").alias("i"), F.col("form").alias("if")), "sig")
        k = F.expr("case when length(`if`) < 8 then 1 when length(`if`) < 12 or startswith(i, 'person') then 2 else 3 end")
        pairs = pairs.where("p != i").withColumn("gap", F.levenshtein("pf", "if", 3)).where((F.col("gap") >= 0) & (F.col("gap") <= k))
        return pairs.select(F.col("i" if swap else "p").alias("a"), F.col("p" if swap else "i").alias("b"), "gap")

    found = verified(left, right, False)
    if both_ways and not same:
        found = found.unionByName(verified(right, left, True))
    return found.groupBy("a", "b").agg(F.min("gap").alias("gap"))


def name_groups(keys: DataFrame, column: str, lexicon: Lexicon | None = None) -> DataFrame:
    """(key, group_id) of every name key that names somebody: keys of one payee have one group.

    A key is taken apart into the name itself and what tells namesakes apart:
    the trade of a firm, the number of a district, the given name of a person.
    Which words are trades and given names is learned from all keys unless a
    ``lexicon`` is given: words that many names share.
    Keys that say all of it are linked when that agrees and a segment join finds
    their names within one to three edits, in either order of the words.  A key
    that leaves the trade out or clips it, or has only initials, is linked to the
    nearest such name if just one trade (given name) there fits, and where the
    legal form or the middle initial decides between several; else it stays
    alone.  Links are consolidated into groups.  Null, blank and placeholder
    keys have no row; repeated keys count once; an empty input gives no rows.
    """
    keep = Staged(keys.sparkSession, "names")
    distinct = keep(keys.select(F.col(f"`{column}`").alias("key")).where("key is not null").distinct())
    lexicon = lexicon or learned_lexicon(distinct)
    spread = distinct.repartition(keys.sparkSession.sparkContext.defaultParallelism, "key")  # little data, much work
    parsed = keep(spread.mapInArrow(_parse_batches(lexicon), _PARSED))
    sure = F.col("attr") != ""
    firm_num = F.when(F.col("kind") == "firm", F.col("num")).otherwise(F.lit(""))
    node = F.when(sure, F.concat_ws("|", "kind", "canon", "attr", firm_num)).otherwise(F.concat_ws("|", "kind", "canon", F.lit("?"), F.concat_ws("/", "cands"), "num", "legal"))
    parsed = parsed.withColumn("node", node).withColumn("fnum", firm_num)
    # one row per node; the forms of its names differ only in whether the order of the words is known
    nodes = parsed.groupBy("node").agg(F.first("kind").alias("kind"), F.first("canon").alias("canon"), F.array_distinct(F.flatten(F.collect_set("forms"))).alias("forms"), F.first("attr").alias("attr"), F.first("cands").alias("cands"), F.first("fnum").alias("fnum"), F.max(F.when(sure, F.lit(None)).otherwise(F.col("num"))).alias("num"), F.collect_set("legal").alias("legals"), F.collect_set("num").alias("nums"))
    nodes = keep(nodes)
    full, part = nodes.where("attr != ''"), nodes.where("attr = ''")
    whole = segment_join(full.withColumn("block", F.concat_ws("|", "kind", "attr", "fnum"))).select("a", "b")
    loose = F.concat_ws("|", "kind", "fnum")
    wanting, known = part.withColumn("block", loose), full.withColumn("block", loose)
    near = segment_join(wanting, known, both_ways=True)
    x = part.select(F.col("node").alias("a"), "kind", "cands", "num", "legals")
    y = full.select(F.col("node").alias("b"), F.col("attr"), F.col("legals").alias("b_legals"), F.col("nums").alias("b_nums"))
    cases = near.groupBy("a", "b").agg(F.min("gap").alias("gap")).join(x, "a").join(y, "b")
    person = F.col("kind") == "person"
    fits = F.when(person, F.substring("attr", 1, 1) == F.element_at("cands", 1)).otherwise((F.size("cands") == 0) | F.array_contains("cands", F.col("attr")))
    sign = F.when(person, (F.col("num") != "") & F.array_contains("b_nums", F.col("num"))).otherwise(F.arrays_overlap(F.array_remove("legals", ""), "b_legals"))
    cases = cases.where(fits).withColumn("sign", F.coalesce(sign, F.lit(False)))
    chosen = cases.groupBy("a").agg(
        F.countDistinct("attr").alias("n"), F.min(F.struct("gap", "b")).alias("nearest"),
        F.countDistinct(F.when(F.col("sign"), F.col("attr"))).alias("n_sign"), F.min(F.when(F.col("sign"), F.struct("gap", "b"))).alias("signed"),
    )
    chosen = keep(chosen.select("a", F.when(F.col("n") == 1, F.col("nearest.b")).when(F.col("n_sign") == 1, F.col("signed.b")).alias("b")))
    alone = keep(wanting.join(chosen.select(F.col("a").alias("node")), "node", "left_anti"))
    between = segment_join(alone)
    between = between.select("a", "b")
    one = alone.select(F.col("node").alias("a"), F.col("cands").alias("c1"), F.col("num").alias("m1"))
    two = alone.select(F.col("node").alias("b"), F.col("cands").alias("c2"), F.col("num").alias("m2"))
    agree = (F.col("c1") == F.col("c2")) | F.arrays_overlap("c1", "c2") | (F.size("c1") == 0) | (F.size("c2") == 0)
    agree = agree & (~F.startswith(F.col("a"), F.lit("person")) | (F.col("m1") == F.col("m2")) | (F.col("m1") == "") | (F.col("m2") == ""))
    between = between.join(one, "a").join(two, "b").where(agree).select("a", "b")
    links = keep(whole.unionByName(chosen.where("b is not null")).unionByName(between))
    groups = connected_groups(links, "a", "b").select(F.col("entity_key").alias("node"), "group_key")
    return parsed.select("key", "node").join(groups, "node", "left").select("key", F.coalesce("group_key", "node").alias("group_id"))


def variant_pairs(groups: DataFrame) -> DataFrame:
    """(key_a, key_b): every pair of different keys of one group, key_a before key_b in byte order."""
    a, b = groups.select("group_id", F.col("key").alias("key_a")), groups.select("group_id", F.col("key").alias("key_b"))
    return a.join(b, "group_id").where("key_a < key_b").select("key_a", "key_b")
