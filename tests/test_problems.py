"""The operators for skewed keys, table differences and orphan references on small cases."""

import random
from collections import Counter

from pyspark.sql import functions as F

from talus.operators.diff import table_diff
from talus.operators.orphans import cited_reports, orphan_references
from talus.operators.skew import eager_join_aggregate, heavy_keys, split_join
from talus.plans.problems import p2_agency_results, p2_found, p2_vendor_results


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_eager_aggregate_equals_the_join(spark):
    random.seed(1)
    left = [(random.choice(["hot", "hot", "hot", "a", "b", None]), random.choice(["x", "y", None]), random.randint(1, 9)) for _ in range(300)]
    right = [(random.choice(["hot", "a", "c", None]), random.randint(1, 9)) for _ in range(80)]
    a, b = spark.createDataFrame(left, "k string, g string, v int"), spark.createDataFrame(right, "k string, w int")
    got = eager_join_aggregate(a, b, ["k"], ["g"], {"v": F.col("v")}, {"w": F.col("w")}).select("g", "joined_rows", "v", "w")
    want = a.join(b, "k").groupBy("g").agg(F.count(F.lit(1)), F.sum("v"), F.sum("w"))
    assert rows(got) == rows(want)


def test_eager_aggregate_of_empty_inputs(spark):
    a, b = spark.createDataFrame([], "k string, v int"), spark.createDataFrame([("a", 1)], "k string, w int")
    assert eager_join_aggregate(a, b, ["k"], ["k"], {"v": F.col("v")}).count() == 0


def test_results_of_keys_that_only_the_ledger_has(spark, tmp_path):
    spark.createDataFrame([("v1", "a", 5), ("v1", "a", 7), ("v2", "b", 3), ("v2", "b", 4), (None, None, 2)], "vendor_id_code string, organization_level_1_name string, amount int").write.parquet(f"{tmp_path}/transactions.parquet")
    spark.createDataFrame([("v1", "a", 100, 2), ("v1", "a", 200, 1), ("v9", "z", 1, 1)], "vendor_id_code string, agency string, amount int, n_markers int").write.parquet(f"{tmp_path}/tx_tiered.parquet")
    want = [("1", 2, 4, 24.0, 600.0, 6), ("2", 2, 0, 7.0, None, None), (None, 1, 0, 2.0, None, None)]
    named = lambda names: Counter((names.get(k), *rest) for k, *rest in want)
    assert rows(p2_vendor_results(spark, str(tmp_path))) == named({"1": "v1", "2": "v2"})
    assert rows(p2_agency_results(spark, str(tmp_path))) == named({"1": "a", "2": "b"})
    assert rows(p2_found(spark, str(tmp_path))) == Counter((f, k) for f, ks in (("organization_level_1_name", "ab"), ("vendor_id_code", ("v1", "v2"))) for k in ks)


def test_heavy_keys_count_nulls_and_repeats(spark):
    data = spark.createDataFrame([("a",)] * 4 + [("b",)] * 2 + [(None,)] * 4, "k string").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert rows(heavy_keys(data, "k", "n", 0.4)) == Counter({("a", 4): 1})
    assert rows(heavy_keys(data, "k", "n", 0.2)) == Counter({("a", 4): 1, ("b", 2): 1})
    assert heavy_keys(data.limit(0), "k", "n", 0.02).count() == 0


def test_split_join_keeps_every_row_once(spark):
    data = [("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)] + [(None, 0), ("none", 1)]
    df = spark.createDataFrame(data, "k string, i int")
    states = df.where("k is not null and k != 'none'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m"))
    assert split_join(df, states, "k", "n", 552).count() == 550
    assert split_join(df, states, "k", "n", 552, "left").where("m is null").count() == 2


SCHEMA = "id string, a int, x double, t array<string>, bucket string, k string"


def test_differences_of_every_kind(spark):
    one = [("1", 1, 1.0, ["a", "b"], "s", "q"), ("2", 2, None, [], None, None), ("3", 3, 3.0, None, "", "z"), ("4", 4, 4.0, ["a", "a"], "s", "s"), ("4", 4, 4.0, ["a", "a"], "s", "s"), ("6", 6, float("nan"), ["é"], "s" * 70_000, "s")]
    two = [("1", 1, 1.0 + 1e-9, ["b", "a"], "s", "q"), ("2", 2, 0.0, [], None, ""), ("3", None, 3.0, [], "", "z"), ("4", 4, 4.0, ["a"], "s", "s"), ("5", 5, 5.0, [], "s", "s"), ("6", 6, float("nan"), ["é"], "s" * 70_000, "s")]
    got = table_diff(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA).select("k", "bucket", "t", "x", "a", "id"), "id", "t")
    want = {("t", "2", "x", "value"), ("t", "2", "k", "value"), ("t", "3", "a", "value"), ("t", "3", "t", "value"), ("t", "4", "t", "value"), ("t", "5", "*", "only_second")}
    assert {tuple(r) for r in got.collect()} == want


def test_differences_with_null_keys_versions_and_repeats(spark):
    one = [(None, 1), (None, 1), ("v", 1), ("v", 2)]
    two = [(None, 2), ("v", 1)]
    got = {tuple(r) for r in table_diff(spark.createDataFrame(one, "id string, a int"), spark.createDataFrame(two, "id string, a int"), "id", "t").collect()}
    assert got == {("t", None, "a", "value"), ("t", "v", "*", "only_first")}


def test_differences_of_empty_copies_and_extra_columns(spark):
    none = spark.createDataFrame([], "id string, a int")
    some = spark.createDataFrame([("1", 1, "e")], "id string, a int, extra string")
    assert table_diff(none, none, "id", "t").count() == 0
    assert [tuple(r) for r in table_diff(some, none, "id", "t").collect()] == [("t", "1", "*", "only_first")]
    assert table_diff(some, some.drop("extra"), "id", "t").count() == 0


def test_many_rows_against_brute_force(spark):
    random.seed(2)
    a = {str(i): (random.randint(0, 5), random.choice(["p", "q", None])) for i in range(2000)}
    b = {k: (v[0] + (random.random() < 0.01), v[1]) for k, v in a.items() if random.random() > 0.01} | {"new": (1, "p")}
    make = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "id string, a int, s string")
    got = {tuple(r)[1:] for r in table_diff(make(a).union(make(a).limit(100)), make(b), "id", "t").collect()}
    want = {(k, "*", "only_first") for k in a if k not in b} | {("new", "*", "only_second")} | {(k, "a", "value") for k in a if k in b and a[k][0] != b[k][0]}
    assert got == want
    fine = table_diff(make(a), make(b), "id", "t", rows_per_bucket=2, coarse_buckets=32)  # with a coarse matrix first
    assert {tuple(r)[1:] for r in fine.collect()} == want


def test_one_changed_field_is_the_only_one_read(spark, tmp_path):
    columns = "id string, a int, s string, t array<string>, u double"
    one = [(str(i), i, f"s{i}", [f"t{i}", "x"], i / 7) for i in range(3000)]
    two = [(k, a + (k == "77"), s, t[::-1], u) for k, a, s, t, u in one if k not in ("5", "2900")] + [("new", 1, "s", [], 0.0)]
    paths = [str(tmp_path / n) for n in "xy"]
    for data, path in zip((one, two), paths):
        spark.createDataFrame(data, columns).write.parquet(path)
    out = table_diff(*[spark.read.parquet(p) for p in paths], "id", "t")
    assert {tuple(r)[1:] for r in out.collect()} == {("5", "*", "only_first"), ("2900", "*", "only_first"), ("new", "*", "only_second"), ("77", "a", "value")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    reads = {line.partition("ReadSchema: ")[2].split(">")[0] for line in plan.splitlines() if "ReadSchema" in line and any(p in line for p in paths)}
    assert reads == {"struct<id:string,a:int"}, reads  # missing rows widen nothing


def test_orphans_equal_the_anti_join(spark):
    random.seed(3)
    parents = spark.createDataFrame([(f"p{i}",) for i in range(3000)] + [(None,)], "target string")
    refs = spark.createDataFrame([(f"p{random.randint(0, 4000)}" if random.random() < 0.6 else "gone", i, "m") for i in range(5000)] + [(None, -1, "m")], "target string, block int, maybe string")
    want = rows(refs.join(parents, "target", "left_anti").where("target is not null").select("target", "block", "maybe"))
    assert rows(orphan_references(refs, parents, "target")) == want
    assert rows(orphan_references(refs, parents, "target", max_blocks=4)) == want  # a filter far too small stays exact


def test_orphans_without_parents_or_references(spark):
    none = spark.createDataFrame([], "target string")
    one = spark.createDataFrame([("a",), ("a",)], "target string")
    assert orphan_references(one, none, "target").count() == 2
    assert orphan_references(none, one, "target").count() == 0


def test_citations(spark):
    cases = {
        "AG 2021–195": ["21-195"], "2018 - 113/116 | 20-217 Highlights": ["18-113", "18-116", "20-217"], "18-158, 2020-243, 21-137": ["18-158", "20-243", "21-137"], "20-278,279 | 2025-293": ["20-278", "20-279", "25-293"],
        "Findings: 2017–211 and 323 | 2023-116 p.51": ["17-211", "17-323", "23-116"], "21-148 & 170, 2022-155": ["21-148", "21-170", "22-155"], "FY21 Highlights": [], "see report p.12": [], "": [], None: [], "No. 19-106,118": ["19-106", "19-118"], "2024-172 & 207 p.49": ["24-172", "24-207"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", cited_reports(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases
