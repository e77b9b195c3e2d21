"""Cleaning, sources, sinks, scoring, entities, API and streaming on small cases."""

import json
import threading
import urllib.error
import urllib.request
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from talus.api import LedgerApi, ReadOnlyError
from talus.frontends import ask, call, server
from talus.functions import cleaning as X
from talus.operators import entities as E
from talus.operators import rollups as R
from talus.operators import scoring as C
from talus.operators.audit import cost_sentences, finding_headings, holding_listed, ranked_bridge, word_bridge
from talus.plans.audit_queries import _variance, budgets
from talus.plans.scored_queries import _tree, scored
from talus.sources import ledger as L
from talus.sources import sinks as K
from talus.streaming.feeds import rollup, rollup_stream
from talus.tables import name_key, table

KEYS = ["Acme  Corp", "  acme corp ", "a\t\nb", "UPPER", "a   b    c", "A&B (Co.)", "ñandú é"]


def test_name_keys_are_the_same_in_python_and_fixed_points(spark):
    df = spark.createDataFrame([(k,) for k in KEYS], "k string")
    for r in df.select("k", name_key(F.col("k")).alias("n"), name_key(name_key(F.col("k"))).alias("nn")).collect():
        assert r.n == X.normalize_entity_key(r.k) == r.nn


def test_cleaning_of_odd_values(spark):
    df = spark.createDataFrame([(" x ", "13.0", "2.0", Decimal("0.5")), ("NULL", "abc", " ", Decimal("99999999")), ("", None, None, Decimal("100000000")), (None, "7", "3", Decimal("1000000"))], "s string, p string, c string, a decimal(18,4)")
    got = df.select(X.nz(F.col("s")), X.period_number(F.col("p")), X.whole_code(F.col("c")), X.is_sentinel(F.col("a")), X.leading_digit(F.col("a")), X.magnitude_band(F.col("a")), X.is_multiple(F.col("a"), 1000)).collect()
    assert [tuple(r) for r in got] == [("x", 13, "2", False, "0", "<100K", False), (None, None, None, True, "9", "10M-100M", False), (None, None, None, True, "1", ">=100M", True), (None, 7, "3", False, "1", "1M-10M", True)]


def test_unattributed_buckets(spark):
    cases = {None: "blank", "  ": "blank", "N/A": "na", "Name Withheld": "redacted", "REDACTED CONFIDENTIAL": "redacted", "Confidential payee": "confidential", "Acme": "named"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.b for r in df.select("p", X.unattributed_bucket(F.col("p")).alias("b")).collect()} == cases


@pytest.mark.parametrize("layout", list(L.LAYOUTS))
def test_positional_exports_become_the_canonical_ledger(spark, tmp_path, layout):
    names = L.LAYOUTS[layout]
    values = {"fiscal_year": "2016.6", "amount": "12.34567", "posting_date": "2017-10-04 00:00:00.000", "payee_customer_vendor_name": '"Quoted ""Co"", Inc"'}
    line = ",".join(values.get(n, f"v{i}") for i, n in enumerate(names))
    bad = ",".join("x" if n in L.TYPES else "y" for n in names)
    (tmp_path / "a.csv").write_text("a,narrow,header\n" + line + "\n" + bad + "\n")
    df = L.read_positional(spark, str(tmp_path / "a.csv"), layout)
    assert df.columns == L.CANON and len(L.CANON) == 60
    first, second = df.collect()
    assert (first.fiscal_year, first.amount, str(first.posting_date), first.payee_customer_vendor_name) == (2017, Decimal("12.3457"), "2017-10-04", 'Quoted "Co", Inc')
    assert second.amount is None and second.posting_date is None and second.fiscal_year is None


def test_named_exports_and_shards_of_other_widths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Amount,Fiscal Year,Transaction Type\n1.5,2020,EX\n")
    got = L.read_named(spark, str(tmp_path / "a.csv")).first()
    assert (got.amount, got.fiscal_year, got.transaction_type, got.object_no) == (Decimal("1.5"), 2020, "EX", None)
    spark.range(2).write.parquet(str(tmp_path / "p1"))
    spark.range(3).withColumn("x", F.lit("y")).write.parquet(str(tmp_path / "p2"))
    assert L.read_shards(spark, str(tmp_path / "p1"), str(tmp_path / "p2")).where("x is null").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "é\"")], "id int, t array<string>, s string")
    K.write_csv(df, str(tmp_path / "csv"), files=1)
    assert [r.t for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("id").collect()] == ["a|b", None]
    assert json.loads(K.json_array(df.orderBy("id")))[0] == {"id": 1, "t": ["a", "b"], "s": None}
    assert K.bundle({"x": df, "y": df}).count() == 4
    new = spark.createDataFrame([(2, ["n"], "new"), (3, [], None)], df.schema)
    assert {r.id: r.s for r in K.upsert(df, new, "id").collect()} == {1: None, 2: "new", 3: None}
    assert {r.id: r.s for r in K.upsert(df, new, "id", update=False).collect()} == {1: None, 2: 'é"', 3: None}
    folder = str(tmp_path / "db")
    assert K.load_together(spark, {"a": df, "b": new}, folder) == {"a": 2, "b": 2}
    with pytest.raises(ValueError):
        K.load_together(spark, {"a": new, "b": df}, folder, lambda name, t: name == "a")
    assert spark.read.parquet(f"{folder}/a").where("s = 'new'").count() == 0
    calls = []

    def failing(spark, source, target):
        calls.append(source)
        if len(calls) == 4:  # both old tables are aside, the second new one fails
            raise OSError("lost")
        K._move(spark, source, target)

    with pytest.raises(OSError):
        K.load_together(spark, {"a": new, "b": df}, folder, move=failing)
    assert spark.read.parquet(f"{folder}/a").where("s = 'new'").count() == 0 and spark.read.parquet(f"{folder}/b").where("s = 'new'").count() == 1
    back = spark.read.parquet(f"{folder}/a")
    assert K.load_together(spark, {"a": back.unionByName(new)}, folder) == {"a": 4} and spark.read.parquet(f"{folder}/a").count() == 4
    assert sorted(p.name for p in (tmp_path / "db").iterdir()) == ["a", "b"]
    assert K.plain({"d": Decimal("12.50"), "l": [None, 7]}) == {"d": 12.5, "l": [None, 7]}


def test_scores_bands_and_tiers(spark):
    config = C.ScoreConfig((C.Marker("a", "x", 2, "p"), C.Marker("b", "x", 4, "q"), C.Marker("c", "y", 3, "r")), {"CAT": Decimal("1.5")})
    rows = [(1, 2_000_000, True, True, None, "CAT"), (2, 500_000, None, False, True, "other"), (3, 1_000_000, False, False, False, None), (4, 100_000, False, None, None, "CAT"), (5, 999_999, True, True, True, None), (6, 99_999, True, True, True, None)]
    df = spark.createDataFrame(rows, "id int, amount int, p boolean, q boolean, r boolean, category1 string")
    got = {r.id: (r.f_x, r.f_y, float(r.risk_score), r.fired_markers, r.risk_band, r.tier) for r in C.score(df, config).collect()}
    assert got == {
        1: (4, 0, 6.0, ["a", "b"], "R3_ELEVATED", 1), 2: (0, 3, 3.0, ["c"], "R2_MODERATE", 3), 3: (0, 0, 0.0, [], "R0_NONE", 4), 4: (0, 0, 0.0, [], "R0_NONE", 5), 5: (4, 3, 7.0, ["a", "b", "c"], "R3_ELEVATED", 2),
    }


def test_rollup_of_cents_equals_the_ledger(spark):
    rows = [("A", 2024, "EX", "c", Decimal("0.005")), ("A", 2024, "EX", "c", Decimal("0.005")), ("A", 2024, "EX", "d", Decimal("10.995"))]
    df = spark.createDataFrame(rows, "agency string, fiscal_year int, kind string, category1 string, amount decimal(18,4)").withColumns({c: F.lit(None).cast("string") for c in ("category2", "category3", "appropriation")})
    assert R.spend_summary(df).agg(F.sum("total_usd")).first()[0] == Decimal("11.005")


def test_entities_resolve_by_rules(spark):
    names = [("ACME TOOL SUPPLY INC", 10), ("ACME TOOL SUPPLY, LLC", 30), ("ACME TOOL", 5), ("ACME BAKERY", 1), ("ACME COUNTY", 9), ("ACME TOOL SUPPLY JV", 2), ("A CO", 1), ("ACME TOOL PARTS SUPPLY OF IOWA", 1)]
    df = spark.createDataFrame([(n, n.title(), float(x), 1) for n, x in names], "entity_key string, display_name string, exposure double, n_txn int")
    got = {r.entity_key: (r.parent_key, r.method, r.confidence, r.group_size) for r in E.resolve(df).collect()}
    parent = "ACME TOOL SUPPLY, LLC"
    assert got[parent][1] == "parent" and got["ACME TOOL SUPPLY INC"][0] == got["ACME TOOL"][0] == got["ACME TOOL PARTS SUPPLY OF IOWA"][0] == parent
    assert all(got[k] == (k, "parent", "singleton", 1) for k in ("ACME BAKERY", "ACME COUNTY", "ACME TOOL SUPPLY JV", "A CO"))
    assert E.resolve(df.limit(0)).count() == 0


def test_text_mining(spark):
    text = "Finding 1\nFinding 1: longer title\nIntro. The agency paid $5,000 for work that nobody asked for. It spent $1 too.\nFinding 2 x"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    assert {(r.finding_no, r.title) for r in finding_headings(df, "id", "t").collect()} == {(1, "Finding 1: longer title"), (2, "Finding 2 x")}
    assert [(r.id, r.sentence[:19]) for r in cost_sentences(df, "id", "t").collect()] == [(1, "The agency paid $5,")]
    a, b = spark.createDataFrame([("Dept. of Water Safety",), (None,)], "x string"), spark.createDataFrame([("DEPT OF WATER SAFETY",), ("DEPT OF WATER STORAGE",)], "y string")
    assert [tuple(r) for r in word_bridge(a, "x", b, "y").collect()] == [("Dept. of Water Safety", "DEPT OF WATER SAFETY", 1.0)]


def test_typed_agencies_mean_listed_ones(spark):
    listed = ["DEPT OF WATER SAFETY", "DEPT OF STATE", "BOARD OF PHARMACISTS", "LEAHOSTOU COMMUNITY COLLEGE", "KAKAKADEL COMMUNITY COLLEGE"]
    cases = {
        "DEPT OF WATER SAFETY": ("DEPT OF WATER SAFETY", "direct"), "DEPT OF STATE": ("DEPT OF STATE", "direct"), "WATER POLICE": ("DEPT OF WATER SAFETY", "alias"), "STATE OF X DEPT OF WATER SAFETY": ("DEPT OF WATER SAFETY", "prefix"),
        "DEPT OF WATER SAFETY GRANTS BRANCH": ("DEPT OF WATER SAFETY", "part"), "X BD OF PHARMACISTS FY2022": ("BOARD OF PHARMACISTS", "same words"), "SAFETY OF WATER UNIT": ("DEPT OF WATER SAFETY", "two shared words"),
        "OTHER COMMUNITY COLLEGE": None, "COMMUNITY COLLEGE": None, "BOARD": None, "WATER BANK": None, "": None, None: None,
    }
    a, b = spark.createDataFrame([(k,) for k in cases], "a string"), spark.createDataFrame([(k,) for k in [*listed, None]], "b string")
    got = ranked_bridge(a, "a", b, "b", "X", {"WATER POLICE": "DEPT OF WATER SAFETY"}).collect()
    assert {r.a: (r.b, r.match) for r in got} == {k: v for k, v in cases.items() if v} and len(got) == 7


def test_every_budget_agency_stays(spark, tiny):
    out = _variance(spark, tiny).collect()
    assert sum(r.budget for r in out) == pytest.approx(sum(r.budget for r in budgets(spark, tiny).collect()))
    assert len({r.agency_form for r in out}) == len(out)
    unmatched = [r for r in out if r.status == "unmatched"]
    assert unmatched and all(r.actual is None and r.variance_pct is None for r in unmatched)


def test_entity_tree_lists_payments(spark, tiny):
    rows = _tree(spark, tiny).collect()
    paid = {}
    for r in scored(spark, tiny).where("entity_key is not null and agency is not null and marker_sum > 0").collect():
        paid.setdefault((r.agency, r.entity_key), []).append(r)
    assert rows and {(r.agency, r.entity_key) for r in rows} == set(paid)
    for r in rows:
        own = sorted(paid[r.agency, r.entity_key], key=lambda p: (p.risk_score is None, -(p.risk_score or 0), p.amount is None, -(p.amount or 0), p.transaction_id or "", p.record_number or ""))[:15]
        assert [(t.txn, t.score, t.category, t.markers) for t in r.transactions] == [(p.transaction_id, p.risk_score, p.category1, p.fired_markers) for p in own]
        assert r.n_tier1 + r.n_tier2 <= r.n and r.first_year <= r.last_year


def test_listed_names_within_payees(spark):
    names = ["ACME", "ACME CO. PLUMBING", "THE ACME-CO", "ACMECO", "BIG ACME COX", "ZED", "...", "", None]
    df, listed = spark.createDataFrame([(k,) for k in names], "k string"), spark.createDataFrame([("ACME CO",), ("ZED",), ("...",), (None,)], "l string")
    assert sorted(r.k for r in holding_listed(df, "k", listed, "l").collect()) == ["ACME CO. PLUMBING", "THE ACME-CO", "ZED"]


def test_listed_payees_hold_listed_names(spark, monkeypatch):
    import talus.plans.audit_queries as Q

    paid = spark.createDataFrame([("Acme Co", 1), ("Acme Co Plumbing", 2), ("Acmeco", 4)], "payee string, amount int")
    monkeypatch.setattr(Q, "expenditure", lambda s, d: paid)
    monkeypatch.setattr(Q, "table", lambda s, d, t: spark.createDataFrame([("ACME CO",)], "entity_key string"))
    assert {tuple(r) for r in Q._compliance(spark, "").collect()} == {("ACME CO", 1, 1.0), ("ACME CO PLUMBING", 1, 2.0)}


def test_api_reads(spark, tiny):
    api = LedgerApi(spark, tiny)
    total = api.spend().first()
    assert total.n_txns == sum(r.n_txns for r in api.spend(breakdown="year").collect())
    assert api.waterfall().agg(F.round(F.sum("pct_n"), 1)).first()[0] == 100.0
    best = api.resolve_agency("Department of Water Safety").first()
    assert (best.agency, best.strength) == ("DEPT OF WATER SAFETY", "exact")
    key = table(spark, tiny, "tier_entities").where("n_tier1 > 0 or n_flagged > 0").first().entity_key
    assert api.entity(key.lower()).first().entity_key == key
    lead = scored = table(spark, tiny, "tx_tiered").where("marker_sum > 0").first()
    assert api.explain(lead.transaction_id).first().calculation.endswith(f"{scored.risk_score:.3f}")
    for m in api.AGENCY_METRICS:
        assert api.rank_agencies(m, 3).count() == 3
    with pytest.raises(ValueError):
        api.rank_vendors("name; drop table")
    with pytest.raises(ReadOnlyError):
        api.set_verdict("x", "benign")
    agency = api.rank_agencies("hv_txn", 1).first().agency
    assert api.agency_card(agency).count() == 1 and api.spend(agency=agency, category="%").first().n_txns == 0


def test_verdicts_are_replaced_and_added(spark, tiny, tmp_path):
    api = LedgerApi(spark, tiny, str(tmp_path))
    with pytest.raises(ValueError):
        api.set_verdict("x", "guilty")
    before = table(spark, tiny, "vendor_verdicts").count()
    api.set_verdict("  a new   one ", "benign")
    out = spark.read.parquet(f"{tmp_path}/vendor_verdicts.parquet")
    assert out.count() == before + 1 and out.where("entity_key = 'A NEW ONE' and verdict = 'benign'").count() == 1
    api.set_verdict("second", "needs_review")
    api.set_verdict("A new one", "genuinely_anomalous")  # another spelling of the first
    found = {r.entity_key: r.verdict for r in spark.read.parquet(f"{tmp_path}/vendor_verdicts.parquet").where("entity_key in ('A NEW ONE', 'SECOND')").collect()}
    assert found == {"A NEW ONE": "genuinely_anomalous", "SECOND": "needs_review"}
    assert spark.read.parquet(f"{tmp_path}/vendor_verdicts.parquet").count() == before + 2
    again = LedgerApi(spark, str(tmp_path), str(tmp_path))  # one folder for both
    again.set_verdict("third", "benign")
    assert spark.read.parquet(f"{tmp_path}/vendor_verdicts.parquet").count() == before + 3


def test_duplicates_and_history_of_planted_payments(spark):
    from datetime import date

    from talus.operators import mart as M

    rows = [("v", "a", 2026, Decimal(50), "r1", "t1", date(2026, 1, 1), "P", None), ("v", "b", 2026, Decimal(50), "r2", "t2", date(2026, 2, 1), "p ", "c"), ("w", "a", 2025, Decimal(50), "r1", "t3", date(2025, 1, 1), "P", None), ("w", "a", 2026, Decimal(50), "r1", "t4", date(2026, 1, 9), None, None), (None, "a", 2026, Decimal(50), "r8", "t5", date(2026, 1, 1), "Q", None)]
    df = spark.createDataFrame(rows, "vid string, agency string, fiscal_year int, amount decimal(18,4), ref string, txn string, posting_date date, payee string, contract string")
    assert [(r.vid, r.n_refs, r.day_span) for r in M.true_duplicates(df, (1, 90)).collect()] == [("v", 2, 31)]
    assert [(r.vid, r.ref, r.dup_distinct_txn) for r in M.duplicate_signatures(df).collect()] == [("w", "r1", 2)]
    out = {r.txn: (r.is_paid_again, r.payee_first_year, r.contract_rate) for r in C.with_history(df, df).collect()}
    assert out == {"t1": (True, 2025, 0.0), "t2": (True, 2025, 1.0), "t3": (False, 2025, 0.0), "t4": (False, None, 0.0), "t5": (False, 2026, 0.0)}


def test_frontends(spark, tiny):
    api = LedgerApi(spark, tiny)
    with pytest.raises(ValueError):
        call(api, "leads", {"nope": 1})
    turns = [{"role": "assistant", "tool_calls": [{"id": "1", "function": {"name": "waterfall", "arguments": "{}"}}, {"id": "2", "function": {"name": "none", "arguments": "{}"}}]}, {"role": "assistant", "content": "done"}]
    out = ask(api, "how much?", lambda messages, tools: turns.pop(0))
    assert out["answer"] == "done" and out["trail"][0]["tool"] == "waterfall" and out["trail"][1]["n_rows"] is None
    http = server(api)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}/api/"
    assert json.load(urllib.request.urlopen(base + "leads?tier=2&limit=2"))["rows"]
    for path, code in (("none", 404), ("leads?tier=x", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + path)
        assert e.value.code == code
    http.shutdown()


def test_stream_counts_each_file_once(spark, tiny, tmp_path):
    rows = table(spark, tiny, "transactions")
    for _ in range(2):
        rows.limit(500).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rollup_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    want = 2 * rows.limit(500).where("transaction_type in ('EX', 'RV')").count()
    assert rollup(spark, str(tmp_path / "out")).agg(F.sum("n_txns")).first()[0] == want


def test_plans_push_down_and_stay_in_the_jvm(spark, tiny):
    import __spark_entry__ as entry

    plan = entry.queries()["spend_by_month"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(transaction_type" in plan and "Python" not in plan and "payee" not in plan
    mart = entry.queries()["score_payments"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in mart and "CartesianProduct" not in mart


def test_every_query_loads_without_the_llm_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("talus.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "talus.llm", None)  # any import of it fails
    assert not any(q in entry.queries() for q in ("p1_found", "p3_found", "p10_found"))
    assert {"feature_mart", "p2_found", "p6_found", "p7_found"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
