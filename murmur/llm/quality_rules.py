"""Quality rules with risk-controlled thresholds.

Fixed base rules reject a text at once. The method's rules compare a figure of a document
with a cutoff; cutoffs come from labelled documents. Of the labelled good documents of a
stratum that the base rules keep, a cutoff would reject k of n; it is admitted if the
exact binomial tail P(Bin(n, alpha) <= k) is at most delta / m, with m the number of all
cutoffs tested (rules x grid x strata): with confidence 1 - delta, no admitted cutoff
rejects more than a share alpha of a stratum's good documents. The strictest admitted
cutoff of each rule and stratum is used, and the strata without one reject nothing more.
The rules share alpha evenly, so all of them together reject at most alpha.

All figures are DataFrame expressions within a row; fitting aggregates labelled rows into
counts by stratum, rule and grid step, whose number does not grow with the data.

Defined results: a null or empty text has no words and fails the base rules; documents
without a label only miss fitting; a doc_id that occurs several times is fitted once for
each row; labels of unknown documents are ignored; with no labels at all the method
rejects nothing; a null stratum is a stratum; extra columns are kept by ``features`` and
ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import SPACE_CLASS, Tables, let, small

WORD = r"[^\x20\x09-\x0D]"
#: Characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: The method's rules: (figure, cutoffs from strict to lenient); a document is rejected where its figure is larger.
RULES = (
    ("symbol_share", tuple(i / 100 for i in (1, 2, 3, 5, 8, 10, 15, 20, 30, 40))),
    ("dup_line_share", tuple(i / 100 for i in (5, 10, 15, 20, 30, 40, 50, 60))),
    ("word_length_excess", (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0)),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of words found twice or more.

    Windows are compared by a 64-bit hash. Only where some hash occurs twice are the
    positions sorted by hash to find the repeated ones; their union is summed by gaps.
    """

    def of(ws: Column) -> Column:
        def hashes(wh: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(wh) - window), lambda i: F.xxhash64(*[F.get(wh, i + j) for j in range(window)]))

        def covered(hs: Column) -> Column:
            placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def spans(ps: Column) -> Column:
                twice = F.filter(ps, lambda p, i: (p["h"] == F.get(ps, i - 1)["h"]) | (p["h"] == F.get(ps, i + 1)["h"]))
                starts = F.array_sort(F.transform(twice, lambda p: p["i"]))
                return let(starts, lambda ss: F.aggregate(F.transform(ss, lambda s, i: F.least(F.lit(window), F.coalesce(F.get(ss, i + 1) - s, F.lit(window)))), F.lit(0), lambda a, x: a + x))

            return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(placed, spans))

        return F.when(F.size(ws) < window + 1, F.lit(0)).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), lambda wh: let(hashes(wh), covered)))

    return let(words, of).cast("bigint")


def features(docs: DataFrame, *, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"), repeated_words(words, window).alias("n_repeat_words"))

    lines = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    out = docs.select("*", F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), let(lines, of_lines).alias("_l"), let(words_of(F.col(text)), of_words).alias("_w"))
    out = out.select(*[F.col(c) for c in out.columns if c not in ("_l", "_w")], "_l.*", "_w.*")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _figures() -> dict[str, Column]:
    """Figures of the method's rules; all are worse the larger they are."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "word_length_excess": F.abs(F.col("word_chars") / n - F.lit(5.5)),
    }


def tail_at_most(k: Column, n: Column, p: Column, risk: Column) -> Column:
    """Whether P(Bin(n, p) <= k) <= risk, exactly: the terms' logarithms are summed one by one.

    A k of n * p or more can't pass (its tail is above a quarter), so the sum has few terms.
    """
    first = n * F.log1p(-p)
    step = F.log(p) - F.log1p(-p)

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + step
        high, low = F.greatest(state["total"], term), F.least(state["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1).cast("bigint"))), F.struct(first.alias("term"), first.alias("total")), add, lambda state: state["total"])
    log_tail = F.when(k == 0, first).otherwise(total)
    return F.when(k >= n * p, False).otherwise(log_tail <= F.log(risk))


def fit(found: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", label: str = "quality", alpha: float = 0.02, delta: float = 0.05, cost: float = 1.0) -> DataFrame:
    """A row a stratum with the chosen cutoff of each rule (null: none admitted).

    Of the admitted cutoffs, the one with the most labelled bad documents rejected, less
    ``cost`` times the good ones, is chosen; of equals the most lenient.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_good"))
    rows = found.where(~F.col("base_failed")).join(known, F.col(key) == F.col("_k"))
    figures = _figures()
    good, bad = F.col("_good") == 1, F.col("_good") == 0
    marks = [(r, i, name, cut) for r, (name, cuts) in enumerate(RULES) for i, cut in enumerate(cuts)]
    counts = rows.groupBy(F.col(stratum).alias("_s")).agg(
        F.count(F.when(good, 1)).alias("n"),
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(cut).alias("cut"), F.count(F.when(good & (figures[name] > cut), 1)).alias("k"), F.count(F.when(bad & (figures[name] > cut), 1)).alias("b")) for r, i, name, cut in marks]).alias("marks"),
    )
    strata = counts.agg(F.count("*").alias("strata"))
    tested = counts.withColumn("strata", strata.scalar()).select("_s", "n", "strata", F.inline("marks"))
    risk = F.lit(delta) / (F.col("strata") * len(marks))
    admitted = tested.where((F.col("n") > 0) & tail_at_most(F.col("k"), F.col("n"), F.lit(alpha / len(RULES)), risk))
    gain = F.struct((F.col("b") - cost * F.col("k")).alias("gain"), "cut")
    chosen = admitted.groupBy("_s", "rule").agg(F.max(gain)["cut"].alias("cut"))
    return chosen.groupBy("_s").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{name}") for r, (name, _) in enumerate(RULES)])


def judge(found: DataFrame, cutoffs: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """``found`` with kept: neither the base rules nor a chosen cutoff reject the document.

    ``cutoffs`` has a row a stratum; callers broadcast it where it is as small as a category
    of few values makes it.
    """
    figures = _figures()
    joined = found.join(cutoffs, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    kept = ~F.col("base_failed")
    for name, _ in RULES:
        kept = kept & F.coalesce(figures[name] <= F.col(f"cut_{name}"), F.lit(True))
    return joined.withColumn("kept", kept).drop("_s", *[f"cut_{name}" for name, _ in RULES])


FIGURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]


def keep(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", **risk: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with cutoffs fitted on the labels."""
    tables = Tables(docs.sparkSession, "quality")
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(stratum).alias("_stratum"))
    found = tables.write(features(rows, text="_text").drop("_text"), "figures")
    marks = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    cutoffs = small(tables.write(fit(found, marks, key="_key", stratum="_stratum", label="_label", **risk), "cutoffs"))
    return judge(found, cutoffs, stratum="_stratum").where("kept").select("_row.*")
