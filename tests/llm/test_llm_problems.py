"""The operators of the llm subpackage against brute force and on odd input."""

import random
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talus.llm import names, quality
from talus.llm.components import connected_groups
from talus.llm.mapping import GramIndex, map_values
from talus.llm.packing import pack
from talus.llm.tokens import decode_ids, encode_texts, encoder, vocabulary
from talus.llm.topn import double_code, top_n
from talus.staging import Staged
from talus.llm.variants import errors_allowed, learned_lexicon, name_groups, probes, segments, variant_pairs


def brute_groups(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        for k in (a, b):
            if k is not None:
                find(k)
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {k: find(k) for k in up}


def check_groups(spark, pairs):
    got = {r[0]: r[1] for r in connected_groups(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got == brute_groups(pairs)


def test_groups_of_chains_stars_cycles_and_cliques(spark):
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(45)] + [("hub", f"s{i}") for i in range(30)] + [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("q1", "q2"), ("q2", "q3"), ("q3", "q1"), ("q3", "q4")]
    pairs += [("lone1", "lone2"), ("self", "self"), ("z", None), (None, "y"), (None, None), ("hub", "c020"), ("lone2", "lone1"), ("lone1", "lone2")]
    random.seed(4)
    random.shuffle(pairs)
    check_groups(spark, pairs)


def test_groups_of_a_random_graph(spark):
    random.seed(5)
    check_groups(spark, [(f"v{random.randint(0, 120)}", f"v{random.randint(0, 120)}") for _ in range(110)])


def test_groups_of_nothing(spark):
    assert connected_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def brute_top(rows, n):
    best = {}
    for g, i, s, a in rows:
        if g is not None and i is not None and s is not None:
            k = (s, a is not None, a if a is not None else 0)
            best[g, i] = max(best.get((g, i), k), k)
    out = set()
    for g in {g for g, _ in best}:
        own = sorted((i for x, i in best if x == g), key=lambda i: i.encode())
        out |= {(g, i) for i in sorted(own, key=lambda i: best[g, i], reverse=True)[:n]}
    return out


def test_top_n_with_ties_nulls_and_repeats(spark):
    random.seed(6)
    rows = [(random.choice(["hot"] * 6 + ["a", "b", None]), f"t{random.randint(0, 300)}", random.choice([1.5, 2.0, 2.0, 2.0, -1.0, 0.0, None]), random.choice([1, 2, 2, None])) for _ in range(900)]
    rows += rows[:50] + [("few", "x", 1.0, 1), ("few", None, 9.0, 9), ("long", "y" * 5000, 1.0, 1), ("long", "y" * 5000 + "z", 1.0, 1), ("long", "", 1.0, 1)]
    df = spark.createDataFrame(rows, "c0 string, g string, s double, a int").withColumn("a", F.col("a").cast("decimal(18,4)")).withColumn("lo", F.lit(1))
    got = top_n(df, "c0", "g", "s", "a", 10)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_top(rows, 10))


def test_top_n_of_nothing(spark):
    assert top_n(spark.createDataFrame([], "g string, i string, s double, a double"), "g", "i", "s", "a", 10).count() == 0


def test_double_codes_keep_the_order(spark):
    random.seed(7)
    values = [0.0, -0.0, 1.0, -1.0, float("inf"), float("-inf"), 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, 0.30000000000000004, 0.3, 4.0, 3.9999999999999996, 8.0, float("nan")]
    values += [random.uniform(-1, 1) * 10 ** random.randint(-300, 300) for _ in range(300)]
    got = {repr(r.v): r.c for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", double_code(F.col("v")).alias("c")).collect()}
    real = sorted(v for v in values if v == v)
    for x, y in zip(real, real[1:]):
        assert (got[repr(x)] < got[repr(y)]) == (x < y) and (got[repr(x)] == got[repr(y)]) == (x == y)
    assert got["nan"] > got["inf"]


TEXTS = ["", None, " ", "Hello  world\n\t it's", "naïve 👩‍🔧 数据表", "<|endoftext|>", "a" * 30_000, "\x00\x85  x", "¿Qué?", "1234567890 " * 300]


def test_tokens_equal_the_public_tokenizer_and_decode_back(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "e") for i, x in enumerate(TEXTS)] + [(0, "", "e")], "doc_id long, text string, ids string")
    out = encode_texts(df, ["doc_id"], "text")
    got = {r.doc_id: r.ids for r in out.collect()}
    assert out.count() == len(TEXTS) + 1
    for i, x in enumerate(TEXTS):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])
    back = {r.doc_id: r.t for r in out.select("doc_id", decode_ids(F.col("ids")).alias("t")).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(TEXTS))


def test_every_piece_has_its_rank():
    e = encoder(vocabulary("byte_bpe_50k"))
    assert e.encode(" the") == [262] and e.decode([262]) == " the"


def test_packing_places_everything_once(spark):
    random.seed(8)
    sizes = [random.choice([0, 1, 5, 60, 99, 100, 101, 250, 1000]) for _ in range(2000)] + [None]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "id long, n int, number string").repartition(5)
    got = pack(df, ["id"], "n", 100, windows=8, merged=2).collect()
    placed, filled = Counter(), {}
    for r in got:
        placed[r.id] += r.n_tokens
        filled.setdefault(r.container_id, []).append((r.start, r.start + r.n_tokens))
        assert r.n_tokens <= 100
    assert all(placed[i] == (s or 0) for i, s in enumerate(sizes))
    assert all(sum(1 for r in got if r.id == i) == max(1, -(-(s or 0) // 100)) for i, s in list(enumerate(sizes))[:200])
    for spans in filled.values():
        spans.sort()
        assert spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    used = sum(s or 0 for s in sizes)
    assert used / (100 * sum(1 for s in filled.values() if s[-1][1])) > 0.97


def test_packing_nothing(spark):
    assert pack(spark.createDataFrame([], "id long, n int"), ["id"], "n", 100).count() == 0


AGENCIES = [(1, "DEPT OF ROADS AND BRIDGES", "DRB"), (2, "BOARD OF TAX APPEALS", "BTA"), (3, "OFFICE OF STATE AUDITS", "OSA"), (4, "LAKESTOUBY COMMUNITY COLLEGE", "LACC"), (5, "DEPT OF WATER SAFETY", "DWSY")]
FRONTS, BACKS = ["", "Zumbria ", "The ", "Ministry: "], ["", " - Depot Team", " (draft)", ", follow-up"]


def test_typed_values_map_to_the_list(spark):
    # what a home state, kinds of bodies, units and remarks are called is learned from the other values
    learned = {f"{f}{' '.join(n.title().split()[::-1])}{b}": i for i, n, _ in AGENCIES for f in FRONTS for b in BACKS}
    cases = learned | {
        "Zumbria Dept. of Raods & Bridges: Depot Team": 1, "Roads/Bridges, the": 1, "D.R.B.": 1, " drb ": 1, "Tax Appeals [draft]": 2, "B0ard of Tax Appaels": 2, "State Audits, Ofc. of": 3, "Lakestóuby College": 4,
        "Guild of Clock Menders": -1, "Various": -1, "x" * 50_000: -1, "The\xa0Water\tSafety Ministry": 5, "--": -1, "Depot Team": -1,
    }
    df = spark.createDataFrame([(v, "own", 7) for v in cases] * 2 + [(None, "own", 7), ("", "own", 7), (" \t", "own", 7)], "typed string, short string, score int")
    entries = spark.createDataFrame(AGENCIES + AGENCIES[:1] + [(None, "NOBODY", None), (9, None, None)], "agency_id int, name string, short string")
    got = map_values(df, "typed", entries, "agency_id", "name", "short").collect()
    assert {r.typed: r.agency_id for r in got} == cases and len(got) == 2 * len(cases) and {r.short for r in got} == {"own"}
    assert all(0 <= r.score <= 1 for r in got)


def test_pruned_postings_lose_no_entry(spark, tmp_path):
    import math

    random.seed(11)
    word = lambda: "".join(random.choice("ABCDE") for _ in range(random.randint(2, 6)))
    entries = [(i, " ".join(word() for _ in range(random.randint(1, 4)))) for i in range(120)]
    keys = sorted({" ".join(word() for _ in range(random.randint(1, 5))) for _ in range(150)} | {" ".join(n.split() + [word()]) for _, n in entries[:60]})
    index = GramIndex(spark.createDataFrame(entries, "id int, name string"), "id", ["name"], Staged(spark, "test"))

    def grams(key):
        return Counter(f"^{w}$"[i : i + 3] for w in key.split() for i in range(len(w)))

    names = {tuple(sorted(n.split())) for _, n in entries}
    found_in = Counter(g for n in names for g in grams(" ".join(n)))
    weigh = lambda g: math.log(1 + len(names) / found_in[g]) if g in found_in else math.log(1 + 2 * len(names))
    vector = lambda key: {g: n * weigh(g) for g, n in grams(key).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cosine = lambda a, b: sum(x * b.get(g, 0) for g, x in a.items()) / norm(a) / norm(b)
    vectors = {i: vector(n) for i, n in entries}
    for broadcast in (True, False):
        index.is_small = broadcast
        got = {r.key: (r.score, r.margin) for r in index.best(spark.createDataFrame([(k,) for k in keys], "key string"), 0.4).collect()}
        for k in keys:
            scores = sorted((cosine(vector(k), v) for v in vectors.values()), reverse=True)
            if scores[0] < 0.4 - 1e-6:
                assert k not in got
            elif scores[0] > 0.4 + 1e-6:
                second = scores[1] if scores[1] >= 0.4 else 0.4
                assert abs(got[k][0] - scores[0]) < 1e-9 and abs(got[k][1] - (scores[0] - second)) < 1e-5


def test_typed_values_without_a_list_or_values(spark):
    entries = spark.createDataFrame([], "agency_id int, name string, short string")
    some = spark.createDataFrame([("Dept of Roads",)], "typed string")
    assert [r.agency_id for r in map_values(some, "typed", entries, "agency_id", "name", "short").collect()] == [-1]
    listed = spark.createDataFrame(AGENCIES, "agency_id int, name string, short string")
    assert map_values(some.limit(0), "typed", listed, "agency_id", "name", "short").count() == 0


def test_segments_find_every_pair_within_the_errors():
    random.seed(9)
    for _ in range(3000):
        a = "".join(random.choice("ABC") for _ in range(random.randint(1, 24)))
        b = list(a)
        for _ in range(random.randint(0, 4)):
            i = random.randint(0, len(b))
            b[i : i + random.randint(0, 1)] = random.choice(["", "A", "B", "C"])
        a, b = sorted((a, "".join(b)), key=len)
        if not a:
            continue
        k = errors_allowed("firm", len(a))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if (old := row) else row
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        if row[-1] <= k:
            index = {(len(a), i, a[s : s + n]) for i, (s, n) in enumerate(segments(len(a), k)) if n}
            assert len(a) <= k or index & set(probes(b, "firm")), (a, b)


def test_spellings_are_linked(spark):
    groups = [
        ["ZUKLIMI & PLEADREAKADEL ROOFING CORP", "ZUKLIMI PLEADREAKADEL ROO", "THE PLEADREAKADEL ZUKLIMI ROOFING", "ROOFING, ZUKLÍMI-PLEADREASADEL CORPORATION", "ZUKLIMIPLEADREAKADEL ROOFING CORP (PAYROLL)"],
        ["ZUKLIMI & PLEADREAKADEL DENTAL GROUP", "ZUKLIMI AND PLEADREAKADEL DENT GRP LLC"],
        ["COTHEYAX SHESTEZEWICK FIRE DISTRICT NO 55", "FIRE DISTRICT, COTHEYAX SHESTEZEWICK 55", "THE COTHEYAX-SHESTEZEWICK FIRE DST #55"], ["COTHEYAX SHESTEZEWICK FIRE DISTRICT NO 52"],
        ["GRAGANATOMONT, MARGARET E", "GRAGANATOMONT PEGGY", "MARGARET GRAGANÁTMONT", "GRAGANATOMONT, M E."], ["GRAGANATOMONT, JAMES", "JIM GRAGANATOMONT"],
    ]
    keys = [k for g in groups for k in g]
    df = spark.createDataFrame([(k, 1) for k in keys * 2 + ["UNKNOWN", "", "NULL", "x" * 20_000, "?!", None]], "key string, node int")
    known = names.Lexicon(["ROOFING", "DENTAL GROUP", "FIRE DISTRICT"], ["MARGARET", "JAMES"])
    got = {tuple(r) for r in variant_pairs(name_groups(df, "key", known)).collect()}
    assert got == {(a, b) for g in groups for a in g for b in g if a.encode() < b.encode()}


def test_trades_and_given_names_are_learned(spark):
    """Trades and given names that no list of the package has, each used by several names; most pairs differ in the name itself."""
    random.seed(12)
    syllables = ["BRU", "KEM", "TAL", "VOSH", "RIN", "DAX", "MUL", "FEP", "GOR", "LIT", "SNA", "WOB"]
    make = lambda n: "".join(random.choice(syllables) for _ in range(n))
    trades, given, groups = ["KITE REPAIR", "GLASS BLOWING", "MAP DRAWING", "BEEKEEPING"], ["ODALYS", "WENCESLAS", "THORBEN"], []

    def typo(word):
        i = random.randint(1, len(word) - 2)
        return word[:i] + random.choice(["", "X", word[i] * 2]) + word[i + 1 :]

    for _ in range(60):
        a, b, trade = make(3), make(4), random.choice(trades)
        groups.append([f"{a} {b} {trade}", f"THE {a} & {b} {trade} LLC", f"{trade}, {b} {a}", f"{typo(a)} {b} {trade} INC", f"{a} {typo(b)} {trade[:6].strip()}"])
    groups += [[f"{g[0].rsplit(t, 1)[0]}{u} CO"] for g in groups[:20] for t in trades if g[0].endswith(t) for u in trades if u != t]  # sister firms
    for _ in range(40):
        surname, name = make(4), random.choice(given)
        groups.append([f"{surname}, {name} K", f"{name} {surname}", f"{typo(surname)}, {name}"])
    keys = [k for g in groups for k in g]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    lexicon = learned_lexicon(df.distinct())
    assert lexicon.phrases == sorted(trades) and set(given) <= lexicon.given
    want = {(a, b) for g in groups for a in g for b in g if a < b}
    got = {tuple(r) for r in variant_pairs(name_groups(df, "key")).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.98 * len(got)
    core = lambda k: (lambda p: (min(x for x in (p["core"], p["other"]) if x), p["attr"]))(lexicon.parse(k))
    joined = sum(core(a) != core(b) for a, b in got & want)
    assert joined > 0.5 * len(want)  # these have different names and come through the segment join


def test_spellings_of_nothing(spark):
    assert name_groups(spark.createDataFrame([], "key string"), "key").count() == 0


def test_edit_distance_counts_a_swap_once():
    assert names.distance("ABCD", "ACBD", 2) == 1 and names.distance("ABCD", "ABCD", 1) == 0 and names.distance("A", "ABCD", 2) == 3


PROSE = "We found that the agency did not keep the records it was asked for, and the board could not say why the money was paid. The auditors told us that they had seen this in the past and that it will be changed."
LISTING = "\n".join(f"- unapproved invoices, item {i}" for i in range(9))
TABLE = "\n".join(f"Road Toll | {2000 + i} | {i * 913}.50 | 12%" for i in range(9))
WRAPPED = "\n".join(PROSE.upper()[i : i + 45] for i in range(0, len(PROSE), 45))


def test_prose_is_told_from_lists_tables_and_junk(spark):
    odd = {"list": LISTING, "table": TABLE, "junk": "zzzz\nxxxxxx\n######\nqwerty\nasdfasdf", "menu": "Home\nSearch\nNext »\nHome\nPrint\nShare"}
    prose = {f"p{i}": " ".join(PROSE.split(" ")[i % 5 :]) for i in range(60)}
    prose = {k: v if i % 2 else "\n".join(textwrap.wrap(v, 40 + i)) for i, (k, v) in enumerate(prose.items())} | {"wrapped": WRAPPED, "short": "It was not the first time that we saw this."}
    blank = {"null": None, "empty": "", "blank": " \n\t\n "}
    words = spark.createDataFrame([(w, "en") for w in "the of and to in a is that for it was on are as with be at by from this have not has had we they could did will us".split()] + [(None, "en")], "word string, lang string")
    df = spark.createDataFrame([(k, v, "no") for k, v in (odd | prose | blank).items()], "doc_id string, text string, distance string")
    out = quality.prose_distance(quality.text_stats(df, ["doc_id"], "text", words))
    got = {r.doc_id: r for r in out.collect()}
    assert {r.doc_id for r in quality.no_prose(out).collect()} == set(odd)
    assert all(got[k].distance is None and got[k].n_words is None for k in blank)
    r = got["table"]
    assert abs(sum(r[f"{s.name}_part"] for s in quality.STATISTICS) - r.distance) < 1e-6 * r.distance


def test_plain_statistics_are_what_they_say(spark):
    words = spark.createDataFrame([("the", "en"), ("of", "en"), ("la", "es")], "word string, lang string")
    text = "The roof of the\tbarn.\n\n- 12 (of)\u2028«La casa”!  "
    r = quality.text_stats(spark.createDataFrame([(1, text, "x")], "n_words int, text string, language string"), ["n_words"], "text", words).toDF("key", "language", "n_words", "n_lines", *[f"c{i}" for i in range(8)]).first()
    assert tuple(r)[:4] == (1, "en", 9, 3)
    solid, letters = len("".join(text.split())), 16 + 2 + 2 + 6
    assert [round(x, 9) for x in tuple(r)[4:]] == [solid, round(letters / 9, 9), round((solid - letters) / solid, 9), round(2 / solid, 9), round(2 / 3, 9), round(2 / 3, 9), round(4 / 9, 9), round(1 / 9, 9)]


def test_the_distance_alone_decides_and_looks_one_way(spark):
    words = spark.createDataFrame([(w, "en") for w in PROSE.lower().split()[:40]], "word string, lang string").distinct()
    prose = [(i, " ".join(PROSE.split(" ")[i % 5 :])) for i in range(60)]
    richer = [(100, "the and it was that they had been not for the and it was")]
    out = quality.prose_distance(quality.text_stats(spark.createDataFrame(prose + richer + [(200, TABLE)], "id int, text string"), ["id"], "text", words))
    far = {r.id: r.distance for r in out.collect()}
    assert far[100] < quality.CUTOFF < far[200] and {r.id for r in quality.no_prose(out).collect()} == {k for k, d in far.items() if d > quality.CUTOFF}


def test_long_unbroken_words_report_their_true_length(spark):
    words = spark.createDataFrame([("the", "en")], "word string, lang string")
    junk = spark.createDataFrame([("a", "x" * 60), ("b", "y" * 70 + " " + "z" * 90)], "doc_id string, text string")
    assert {r.doc_id: r.mean_word_length for r in quality.text_stats(junk, ["doc_id"], "text", words).collect()} == {"a": 60.0, "b": 80.0}


def test_quality_of_nothing(spark):
    words = spark.createDataFrame([("the", "en")], "word string, lang string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.prose_distance(quality.text_stats(none, ["doc_id"], "text", words)).count() == 0
