"""Audit reports: text mining, citations, bridges to ledger names and the spending around a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.cleaning import sorted_word_key
from talus.operators.rollups import money

# Words of agency names that tell no agency apart.
BOILERPLATE = ["STATE", "OF", "THE", "AND", "FOR", "OFFICE", "DEPARTMENT", "DEPT", "BOARD", "COMMISSION", "DIVISION"]
# More words, in forms that people type, that tell no agency apart.
TYPED_BOILERPLATE = [*BOILERPLATE, "ON", "BUREAU", "DIV", "DPT", "DEPART", "BD", "BRD", "OFC", "OFF", "COMM", "COMN", "CMSN"]
# Words that make a sentence with an amount one about cost.
COST_WORDS = r"\b(spent|paid|payments|appropriated|difference|amount|totaling)\b"
SPACE = "[ \t\n\r\f]"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def finding_headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, finding_no, title): the ``Finding N`` headings of every text; of repeated numbers the longest line."""
    heads = F.filter(F.transform(lines_of(F.col(text)), lambda x: F.trim(x)), lambda x: x.rlike(r"^Finding [0-9]+\b"))
    rows = df.select(key, F.explode(F.array_distinct(heads)).alias("title")).withColumn("finding_no", F.regexp_extract("title", r"^Finding ([0-9]+)", 1).try_cast("int"))
    best = F.max(F.struct(F.length("title"), F.col("title"))).alias("b")
    return rows.groupBy(key, "finding_no").agg(best).select(key, "finding_no", "b.title")


def cost_sentences(df: DataFrame, key: str, text: str, least: int = 30, most: int = 400, cap: int = 12) -> DataFrame:
    """(key, pos, sentence, before): sentences about money, the first ``cap`` of every text, with the sentence before each.

    A sentence counts once per text by its first 80 characters.  Only sentences
    about money leave the row and are numbered.
    """
    sentences = F.split(F.coalesce(F.col(text), F.lit("")), rf"(?<=[.]){SPACE}+")
    pairs = F.arrays_zip(sentences.alias("sentence"), F.concat(F.array(F.lit(None).cast("string")), sentences).alias("before"))
    rows = df.select(key, F.posexplode(pairs).alias("pos", "x")).select(key, "pos", "x.sentence", "x.before")
    about = rows.where(F.col("sentence").rlike(r"\$[0-9]") & F.col("sentence").rlike(COST_WORDS) & F.length("sentence").between(least, most))
    first = F.row_number().over(Window.partitionBy(key, F.substring("sentence", 1, 80)).orderBy("pos"))
    once = about.withColumn("k", first).where("k = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("n") <= cap).select(key, "pos", "sentence", "before")


def dollar_amounts(df: DataFrame, key: str, text: str, most: int = 15) -> DataFrame:
    """(key, n, amounts): how many amounts a text names and the first ``most`` of them as written."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\$[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    return df.select(key, F.size(found).cast("long").alias("n"), F.array_join(F.slice(found, 1, most), "|").alias("amounts")).where("n > 0")


def context_lines(df: DataFrame, key: str, text: str, most: int = 30, width: int = 200) -> DataFrame:
    """(key, lines): short lines before the text proper, such as headings, cut to ``width``, at most ``most``."""
    short = F.filter(F.transform(lines_of(F.col(text)), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & (F.length(x) <= 60) & ~x.rlike(r"[.;,]$"))
    return df.select(key, F.array_join(F.transform(F.slice(short, 1, most), lambda x: F.substring(x, 1, width)), "|").alias("lines")).where("lines != ''")


def word_bridge(left: DataFrame, left_name: str, right: DataFrame, right_name: str, least: float = 0.34) -> DataFrame:
    """(left_name, right_name, score): the best counterpart of every name by shared words (Jaccard), found over a word index."""
    words = lambda df, n, out: df.select(F.col(n).alias(out)).where(F.col(out).isNotNull()).distinct().withColumn("key", sorted_word_key(F.col(out), BOILERPLATE)).withColumn("words", F.filter(F.split("key", " "), lambda w: w != ""))
    a, b = words(left, left_name, "a"), words(right, right_name, "b")
    shared = a.select("a", F.size("words").alias("na"), F.explode("words").alias("w")).join(b.select("b", F.size("words").alias("nb"), F.explode("words").alias("w")), "w").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    scored = shared.withColumn("score", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")).cast("double"), 6)).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), F.length("b"), F.asc("b")))
    return scored.withColumn("rn", rank).where("rn = 1").select(F.col("a").alias(left_name), F.col("b").alias("matched_name"), "score")


def ranked_bridge(left: DataFrame, left_name: str, right: DataFrame, right_name: str, place: str = "", aliases: dict[str, str] | None = None) -> DataFrame:
    """(left_name, right_name, match): the listed agency form that every typed agency form means; one row a typed form that means one.

    Both columns hold values of ``agency_form``.  The first of these that holds
    decides, then the most shared words and the largest share of them: direct
    (equal), alias (equal once replaced by ``aliases``, form to form), prefix
    (equal without THE, STATE, STATE OF and the ``place`` at the start), part
    (one holds the other as whole words), same words, two shared words.
    Boilerplate, years, numbers and single letters are no words here.  A typed
    form that fits several listed ones equally well means none.
    """
    alias = F.lit(None).cast("string")
    for typed, listed in (aliases or {}).items():
        alias = F.when(F.col("a") == typed, F.lit(listed)).otherwise(alias)
    front = rf"^((THE|STATE OF|STATE{'|' + place if place else ''}) )+"
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: (F.length(w) > 1) & ~w.isin([*TYPED_BOILERPLATE, place]) & ~w.rlike(r"^(FY)?\d+$")))
    whole = lambda c: F.concat(F.lit("="), c)
    a = left.select(F.col(left_name).alias("a")).where("a != ''").distinct().withColumn("alias", alias).withColumn("bare", F.regexp_replace(F.coalesce("alias", "a"), front, ""))
    a = a.withColumn("words", words(F.col("bare"))).select("a", "alias", "bare", F.size("words").alias("na"), F.explode(F.array_union("words", F.array_compact(F.array(whole(F.col("a")), whole(F.col("alias")), whole(F.col("bare")))))).alias("w"))
    b = right.select(F.col(right_name).alias("b")).where("b != ''").distinct().withColumn("words", words(F.col("b")))
    b = b.select("b", F.size("words").alias("nb"), F.explode(F.array_union("words", F.array(whole(F.col("b"))))).alias("w"))
    shared = a.join(b, "w").groupBy("a", "alias", "bare", "b", "na", "nb").agg(F.count(F.when(~F.col("w").startswith("="), 1)).alias("n"))
    within = lambda x, y: F.concat(F.lit(" "), y, F.lit(" ")).contains(F.concat(F.lit(" "), x, F.lit(" ")))
    names = ["direct", "alias", "prefix", "part", "same words", "two shared words"]
    holds = [F.col("a") == F.col("b"), F.col("alias") == F.col("b"), F.col("bare") == F.col("b"), within(F.col("b"), F.col("bare")) | within(F.col("bare"), F.col("b")), (F.col("n") == F.col("na")) & (F.col("n") == F.col("nb")), F.col("n") >= 2]
    rank = F.lit(None).cast("int")
    for i, h in reversed(list(enumerate(holds))):
        rank = F.when(h, F.lit(i)).otherwise(rank)
    order = Window.partitionBy("a").orderBy("rank", F.desc("n"), F.desc(F.col("n") / F.nullif(F.col("na") + F.col("nb") - F.col("n"), F.lit(0))))
    best = shared.withColumn("rank", rank).where("rank is not null").withColumn("place", F.rank().over(order)).where("place = 1")
    one = best.groupBy("a").agg(F.count(F.lit(1)).alias("ties"), F.min("b").alias("b"), F.min("rank").alias("rank")).where("ties = 1")
    return one.select(F.col("a").alias(left_name), F.col("b").alias(right_name), F.element_at(F.array(*[F.lit(x) for x in names]), F.col("rank") + 1).alias("match"))


def holding_listed(names: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """(key): the names that hold a listed name as whole words in a row; punctuation is a space.

    Every run of words of a name is looked up in the list by an equality join,
    so neither side has to be small.
    """
    form = lambda c: F.trim(F.regexp_replace(F.upper(F.col(c)), r"[^\p{L}\p{N}]+", " "))
    split = names.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_form", form(key)).where("_form != ''").withColumn("_words", F.split("_form", " "))
    size = F.size("_words")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.array_join(F.slice("_words", i, n), " "))))
    return split.select(key, F.explode(F.array_distinct(runs)).alias("_form")).join(listed.select(form(listed_key).alias("_form")).distinct(), "_form", "left_semi").select(key).distinct()


def spend_around(reports: DataFrame, clean: DataFrame, years: int, funds: dict[str, str]) -> DataFrame:
    """Of every report the agency's spending in its year, in the years around it, and of the fund its title names.

    Spending is summed per agency and year first; the range of years becomes an
    equality join on the years it holds.
    """
    title = F.lower(F.coalesce("title", F.lit("")))
    fund = F.lit(None).cast("string")
    for word, name in reversed(list(funds.items())):
        fund = F.when(title.contains(word), F.lit(name)).otherwise(fund)
    base = reports.select("report_id", F.col("agency_checkbook").alias("agency"), "fiscal_year", fund.alias("fund_keyword"))
    by_year = clean.where("agency is not null").groupBy("agency", "fiscal_year").agg(F.sum("amount").alias("s"))
    spans = base.select("report_id", "agency", F.col("fiscal_year").alias("fy"), F.explode(F.sequence(F.col("fiscal_year") - years, F.col("fiscal_year") + years)).alias("fiscal_year"))
    near = spans.join(by_year, ["agency", "fiscal_year"]).groupBy("report_id").agg(F.sum(F.when(F.col("fiscal_year") == F.col("fy"), F.col("s"))).alias("_own"), F.sum("s").alias("_near"))
    by_fund = clean.where("agency is not null and fund is not null").groupBy("agency", "fiscal_year", "fund").agg(F.sum("amount").alias("s"))
    named = base.where("fund_keyword is not null").join(by_fund, ["agency", "fiscal_year"]).where(F.col("fund").contains(F.col("fund_keyword"))).groupBy("report_id").agg(F.sum("s").alias("_fund"))
    out = base.join(near, "report_id", "left").join(named, "report_id", "left")
    return out.select("report_id", "agency", "fiscal_year", "fund_keyword", money("_own", "agency_spend"), money("_near", "agency_spend_around"), money("_fund", "fund_spend"))


def audited_period_spend(reports: DataFrame, clean: DataFrame) -> DataFrame:
    """Per agency the reports, their first and last year, and what it spent between them."""
    periods = reports.where("agency_checkbook is not null").groupBy(F.col("agency_checkbook").alias("agency")).agg(F.countDistinct("report_id").alias("n_reports"), F.min("fiscal_year").alias("first_fy"), F.max("fiscal_year").alias("last_fy"))
    by_year = clean.groupBy("agency", "fiscal_year").agg(F.sum("amount").alias("s"))
    spent = periods.join(by_year, "agency").where(F.col("fiscal_year").between(F.col("first_fy"), F.col("last_fy"))).groupBy("agency").agg(F.sum("s").alias("_s"))
    return periods.join(spent, "agency", "left").select("agency", "n_reports", "first_fy", "last_fy", money("_s", "spend_during_audits"))
