"""The boards, the texts' patterns and the further sources on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from talus.api import LedgerApi
from talus.operators import boards as B
from talus.sources import ledger as L
from talus.sources import sinks as K


def test_stated_dollars(spark):
    cases = {"$595k; $57M": 57_595_000.0, "$1.5B and $2": 1_500_000_002.0, "none": 0.0, "": 0.0, None: 0.0}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", B.stated_dollars(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases


def test_questioned_cost_counts_a_reference_once_per_agency(spark):
    xref = spark.createDataFrame([(1, "$2k", " contradicts"), (2, None, None), (3, "$5", "EXTENDS")], "xref_id long, ag_dollar string, relationship string")
    cites = spark.createDataFrame([(1, "20-1"), (1, "20-2"), (2, "20-1"), (3, "20-9"), (3, "20-3")], "xref_id long, report string")
    reports = spark.createDataFrame([("20-1", "A"), ("20-2", "A"), ("20-3", None)], "report_id string, agency_checkbook string")
    assert [tuple(r) for r in B.questioned_by_agency(xref, cites, reports).collect()] == [("A", 2, 1, 2000.0)]


def test_years_funds_and_quantiles(spark):
    rows = spark.createDataFrame([("a", 2024, 10), ("a", 2025, 15), ("a", 2027, 1), (None, 2024, 3), ("z", 2024, 0), ("z", 2025, 4)], "k string, fiscal_year int, v int")
    got = {(r.k, r.fiscal_year): (r.usd, r.previous, r.change, r.pct) for r in B.year_over_year(rows, "k", "v").collect()}
    assert got[("a", 2025)] == (15.0, 10.0, 5.0, 50.0) and got[("a", 2027)] == (1.0, None, None, None) and got[("z", 2025)] == (4.0, 0.0, 4.0, None) and len(got) == 5
    lines = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 1.0), ("b", None, None)], "k string, g double, o double")
    assert {(r.k, r.source): (r.amount, r.pct) for r in B.fund_sources(lines, "k", {"x": "g", "y": "o"}).collect()} == {("a", "x"): (3.0, 75.0), ("a", "y"): (1.0, 25.0), ("b", "x"): (0.0, None), ("b", "y"): (0.0, None)}
    groups = spark.createDataFrame([(str(i), float(i)) for i in range(5)], "k string, m double")
    assert sorted(r.k for r in B.above_quantile(groups, "m", 0.75).collect()) == ["4"]
    assert B.above_quantile(groups.limit(0), "m", 0.75).count() == 0


def test_recommendations_belong_to_the_finding_before_them(spark):
    text = "Recommendation 0\nFinding 1: x\nno\n Recommendation: a\nFinding 2\nRecommendations b\nFinding 99999999999\nRecommendation c"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "id int, text string, line string")
    assert [tuple(r) for r in B.recommendations(df, "id", "text").orderBy("pos").collect()] == [(1, 0, "Recommendation 0", None), (1, 3, "Recommendation: a", 1), (1, 5, "Recommendations b", 2), (1, 7, "Recommendation c", None)]


def test_heads_patterns_and_overrides(spark):
    df = spark.createDataFrame([(1, "\n  A title \nThe Board Of Bone Setters said in May 2021 and on July 4, 2022 $5 $6"), (2, None)], "id int, text string")
    assert {r.id: tuple(r)[1:] for r in B.report_heads(df, "id", "text").collect()} == {1: ("A title", "Board Of Bone Setters", "May 2021"), 2: (None, None, None)}
    assert [tuple(r) for r in B.keyed_patterns(df, "id", "text", {"usd": r"\$[0-9]"}, most=1).collect()] == [(1, 2, "$5")]
    base = spark.createDataFrame([(1, "a", "b"), (2, None, "d"), (None, "e", "f")], "id int, p string, q string")
    over = spark.createDataFrame([(1, "A", None), (1, "B", None), (9, "x", "x"), (None, "y", "y")], "id int, p string, q string")
    assert {tuple(r) for r in B.merge_overrides(base, over, "id").collect()} == {(1, "B", "b"), (2, None, "d"), (None, "e", "f")}


def test_further_sources(spark, tmp_path):
    (tmp_path / "long.csv").write_text('Agency,Budget,\nname,general,other\n,fund,funds\n"A, B",1,2\nC,3,\n')
    rows = L.read_with_long_header(spark, str(tmp_path / "long.csv"))
    assert rows.columns == ["agency_name", "budget_general_fund", "other_funds"] and {tuple(r) for r in rows.collect()} == {("A, B", "1", "2"), ("C", "3", None)}
    (tmp_path / "feed.csv").write_text("Name, N\nx,1\ny,none\n")
    assert {tuple(r) for r in L.read_feed(spark, str(tmp_path / "feed.csv"), "n int, name string, more date").collect()} == {(1, "x", None), (None, "y", None)}
    (tmp_path / "pages.json").write_text(json.dumps({"report": "20-1", "pages": [{"page_no": 1, "text": "a"}, {"page_no": 2, "text": None}]}))
    assert [tuple(r) for r in L.read_pages(spark, str(tmp_path / "pages.json")).orderBy("page_no").collect()] == [("20-1", 1, "a"), ("20-1", 2, None)]


def test_nothing_is_cut_unseen_and_missing_tables_are_told(spark, tmp_path):
    with pytest.raises(ValueError):
        K.to_records(spark.range(5), most=4)
    with pytest.raises(FileNotFoundError):
        LedgerApi.opened(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        K.push_together(spark, str(tmp_path), ["a"], "jdbc:none")
