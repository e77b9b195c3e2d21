"""Text quality statistics and how far a text lies from the prose of its language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.staging import Staged

#: Words that a list of common words may have; they become a set inside the plan.
MAX_WORDS = 100_000


@dataclass(frozen=True)
class Statistic:
    """A measure in which texts are compared: its expression over the plain statistics, the side on which it is less
    like prose (-1: low, 1: high), its tolerance (a deviation that says nothing) and what it is counted over."""

    name: str
    value: str
    side: int
    tolerance: float
    per: str


STATISTICS = [
    Statistic("common_words", "common_words", -1, 0.035, "word"),
    Statistic("common_pairs", "common_pairs", -1, 0.025, "word"),
    Statistic("symbol_ratio", "symbol_ratio", 1, 0.012, "word"),
    Statistic("digit_ratio", "digit_ratio", 1, 0.02, "word"),
    Statistic("mean_word_length", "ln(greatest(mean_word_length, 0.5))", 1, 0.06, "word"),
    Statistic("punctuated_lines", "punctuated_lines", -1, 0.2, "line"),
    Statistic("marked_lines", "marked_lines", 1, 0.06, "line"),
    Statistic("words_per_line", "ln(1 + n_words / n_lines)", -1, 0.4, "text"),
]
#: A share of n words (lines) counts n / (n + PRIOR) of its deviation, so that short texts aren't judged by chance.
PRIOR = {"word": 10.0, "line": 2.0}
#: Solid characters that count as a word of size.
WORD_CHARS = 5
#: Share of the rows nearest to the centre that mean and covariance are taken from, and how often.
NEAREST, STEPS = 0.75, 5
#: Squared distance beyond which a text is no prose: the quantile of chi-square with eight degrees of freedom that one text in two hundred exceeds.
CUTOFF = 21.95

WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]+"
SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
#: White space as characters, for counting.
SPACES = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: A sentence sign and closing signs end a line; looked for in its last TAIL characters.
ENDED, TAIL = rf"[.!?…][\"'”’)\]]*[{SPACE}]*$", 12
#: A line begins plainly with a word of two or more letters that no dot or bracket follows; else a mark, number or cell begins it.
PLAIN_START = rf"^[{SPACE}]*[\"“¿¡'‘]?[\p{{L}}\p{{N}}]{{2,}}(?:[^.)\p{{L}}\p{{N}}_]|$)"


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(b, F.lit(1))


def text_stats(df: DataFrame, keys: list[str], text: str, common_words: DataFrame) -> DataFrame:
    """``keys`` and the plain statistics of every row's whole text; nulls for null, empty and blank texts.

    n_words, n_lines (non-blank), n_solid (characters but white space), language,
    mean_word_length, symbol_ratio and digit_ratio (of the solid characters),
    punctuated_lines (share that end a sentence), marked_lines (share that don't
    begin with a word), common_words (share of the words) and common_pairs
    (share of the words that are common and follow a common one, as in running
    sentences but not in names or entries).  ``common_words`` has word and lang;
    the language is the one with most common words in the text, the first by
    name in a tie.  All in Spark's own expressions.  Repeated rows give repeated
    rows; an empty table gives none.
    """
    listed = common_words.select("word", "lang").where("word is not null and lang is not null").take(MAX_WORDS + 1)
    if len(listed) > MAX_WORDS:
        raise ValueError(f"a list of common words has at most {MAX_WORDS} words")
    words_of: dict[str, set[str]] = {}
    for word, lang in listed:
        words_of.setdefault(lang, set()).add(word.lower())
    langs = sorted(words_of) or ["und"]
    t = F.col("_text")
    solid = F.translate(t, SPACES, "")
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("_text"))
    has_line = lambda x: x.rlike(rf"[^{SPACE}]")
    rows = rows.select(
        *[F.col(f"`{k}`") for k in keys],
        F.filter(F.split(t, BREAK), has_line).alias("_lines"),
        F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)).alias("_words"),
        F.length(solid).alias("n_solid"),
        F.length(F.regexp_replace(t, r"[^\p{Nd}]+", "")).alias("_digits"),
    )
    # of each language a 1 or 0 per word: runs of ones are counted as text
    marks = lambda own: F.array_join(F.transform("_words", lambda w: F.when(w.isin(sorted(own)), "1").otherwise("0")), "")
    rows = rows.select("*", *[(marks(words_of[x]) if words_of.get(x) else F.lit("")).alias(f"_marks{i}") for i, x in enumerate(langs)])
    count = lambda c: F.length(F.replace(c, F.lit("0"), F.lit("")))
    best = F.greatest(*[F.struct(count(F.col(f"_marks{i}")).alias("n"), F.lit(-i).alias("i"), F.col(f"_marks{i}").alias("m")) for i in range(len(langs))], F.struct(F.lit(-1).alias("n"), F.lit(-len(langs)).alias("i"), F.lit("").alias("m")))
    rows = rows.withColumn("_best", best)
    n, lines = F.size("_words"), F.size("_lines")
    runs = F.length(F.replace(F.regexp_replace("_best.m", "1+", "1"), F.lit("0"), F.lit("")))
    share = lambda holds: _ratio(F.size(F.filter("_lines", holds)), lines)
    joined = F.array_join("_words", "")
    stats = {
        "language": F.element_at(F.array(*[F.lit(x) for x in langs]), 1 - F.col("_best.i")),
        "n_words": n,
        "n_lines": lines,
        "n_solid": F.col("n_solid"),
        "mean_word_length": _ratio(F.length(joined), n),
        "symbol_ratio": _ratio(F.col("n_solid") - F.length(F.translate(joined, "'’", "")), F.col("n_solid")),
        "digit_ratio": _ratio(F.col("_digits"), F.col("n_solid")),
        "punctuated_lines": share(lambda x: F.substring(x, -TAIL, TAIL).rlike(ENDED)),
        "marked_lines": share(lambda x: ~x.rlike(PLAIN_START)),
        "common_words": _ratio(F.col("_best.n"), n),
        "common_pairs": _ratio(F.col("_best.n") - runs, n),
    }
    return rows.select(*[F.col(f"`{k}`") for k in keys], *[F.when(lines > 0, c).alias(s) for s, c in stats.items()])


def _measured(stats: DataFrame) -> DataFrame:
    """Adds x<i>, the statistics as compared, and w<per>, how much their deviations count."""
    size = {"word": F.col("n_solid") / WORD_CHARS, "line": F.col("n_lines").cast("double")}
    weights = {f"w_{per}": n / (n + PRIOR[per]) for per, n in size.items()}
    return stats.select("*", *[F.expr(s.value).cast("double").alias(f"x{i}") for i, s in enumerate(STATISTICS)], *[w.alias(n) for n, w in weights.items()], F.lit(1.0).alias("w_text"))


Centres = dict[str, tuple[np.ndarray, np.ndarray]]


def _beside(rows: DataFrame, centres: Centres) -> DataFrame:
    """``rows`` with the mean (m<i>) and inverse covariance (v<i>_<j>) of their language, nulls if it has none: one row per language is broadcast."""
    p = len(STATISTICS)
    names = ["language", *[f"m{i}" for i in range(p)], *[f"v{i}_{j}" for i in range(p) for j in range(p)]]
    lines = [(k, *map(float, mean), *map(float, np.linalg.inv(cov).ravel())) for k, (mean, cov) in centres.items()]
    schema = ", ".join(f"{n} {'double' if i else 'string'}" for i, n in enumerate(names))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(lines, schema)), "language", "left")


def _deviations(rows: DataFrame, centres: Centres, outward: bool) -> DataFrame:
    """Adds z<i>, the weighted deviations from the language's centre; with ``outward`` only those away from prose."""
    def of(i: int, s: Statistic) -> str:
        z = f"w_{s.per} * (x{i} - m{i})"
        z = f"{'greatest' if s.side > 0 else 'least'}({z}, 0D)" if outward else z
        return f"case when m0 is not null and x0 is not null then {z} end as z{i}"  # greatest and least pass over nulls

    return _beside(rows, centres).selectExpr("*", *[of(i, s) for i, s in enumerate(STATISTICS)])


def _parts() -> list[str]:
    """Of each statistic its share of the squared distance: z_i times the i-th row of the inverse covariance times z."""
    p = len(STATISTICS)
    return [f"z{i} * ({' + '.join(f'v{i}_{j} * z{j}' for j in range(p))})" for i in range(p)]


def _with_distance(rows: DataFrame, centres: Centres) -> DataFrame:
    return _deviations(rows, centres, False).selectExpr("language", *[f"w_{per}" for per in ("word", "line", "text")], *[f"z{i}" for i in range(len(STATISTICS))], f"{' + '.join(_parts())} as d")


def _median_of_chi_square(p: int) -> float:
    return p * (1 - 2 / (9 * p)) ** 3


def prose_centres(rows: DataFrame) -> Centres:
    """Of each language the robust mean and covariance of its prose, by concentration steps over all rows.

    The start is the median with squared median deviations.  A step takes the
    rows within the NEAREST quantile of the distance, their weighted mean and
    the covariance of their weighted deviations and adds the squared tolerances;
    the last covariance is scaled up where the median distance exceeds that of
    chi-square.  Every figure is an aggregate per language.
    """
    p = len(STATISTICS)
    tolerance = np.diag([s.tolerance**2 for s in STATISTICS])
    half = lambda x, name: f"percentile_approx({x}, 0.5, 10000) as {name}"
    middle = {r["language"]: np.array([r[f"x{i}"] for i in range(p)]) for r in rows.groupBy("language").agg(*[F.expr(half(f"x{i}", f"x{i}")) for i in range(p)]).collect()}
    spread = _deviations(rows, {k: (m, tolerance) for k, m in middle.items()}, False).groupBy("language").agg(*[F.expr(half(f"abs(z{i})", f"s{i}")) for i in range(p)])
    centres = {r["language"]: (middle[r["language"]], np.diag([(1.4826 * r[f"s{i}"]) ** 2 for i in range(p)]) + tolerance) for r in spread.collect()}
    sums = ["count(1) as n", *[f"sum(w_{per}) as w_{per}" for per in ("word", "line", "text")], *[f"sum(z{i}) as z{i}" for i in range(p)]]
    sums = [F.expr(x) for x in [*sums, *[f"sum(z{i} * z{j}) as p{i}_{j}" for i in range(p) for j in range(i, p)]]]
    for _ in range(STEPS):
        at = _with_distance(rows, centres)
        cuts = at.groupBy("language").agg(F.expr(f"percentile_approx(d, {NEAREST}, 10000) as cut"))
        near = at.join(F.broadcast(cuts), "language").where("d <= cut")  # one row per language of the word list
        for r in near.groupBy("language").agg(*sums).collect():
            mean, _ = centres[r["language"]]
            shift = np.array([r[f"z{i}"] / r[f"w_{s.per}"] if r[f"w_{s.per}"] else 0.0 for i, s in enumerate(STATISTICS)])
            cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / r["n"]
            centres[r["language"]] = (mean + shift, cov + tolerance)
    for r in _with_distance(rows, centres).groupBy("language").agg(F.expr(half("d", "m"))).collect():
        mean, cov = centres[r["language"]]
        # only upwards: where all prose is alike, the tolerances stand
        centres[r["language"]] = (mean, cov * max(1.0, r["m"] / _median_of_chi_square(p)))
    return centres


def prose_distance(stats: DataFrame) -> DataFrame:
    """``text_stats`` with the squared robust Mahalanobis ``distance`` from the prose of the text's language and
    ``<statistic>_part``, what each statistic adds to it (they add up to it); null where the statistics are null.

    Only deviations on the side away from prose count (fewer common words, more
    symbols, shorter lines ...), each weighted by how much text it is counted
    over, so that prose of another kind or a single sentence stays near.  Mean
    and covariance are those of ``prose_centres``, per language over the whole
    table; rows that repeat all count.
    """
    keep = Staged(stats.sparkSession, "quality")
    measured = keep(_measured(stats))
    centres = prose_centres(measured.where("language is not null"))
    away = _deviations(measured, centres, True)
    names = [f"{s.name}_part" for s in STATISTICS]
    out = away.select(*[F.col(f"`{c}`") for c in stats.columns], *[F.expr(c).alias(n) for c, n in zip(_parts(), names)])
    return out.withColumn("distance", F.expr(" + ".join(names)))


def no_prose(distances: DataFrame) -> DataFrame:
    """The rows that lie beyond the cutoff from the prose of their language."""
    return distances.where(F.col("distance") > CUTOFF)
