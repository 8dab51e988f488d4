"""License scan by diagonal voting: word k-gram hashes joined to template positions.

Every rolling k-gram of a document's words is joined by its hash to the places where the
templates have it; a match votes for the diagonal (place in the document minus place in
the template). Two 64-bit hashes must agree, of which the first is joined, so no words move
and strangers meet once in 2 ** 128. Phrases (short templates) are places where all grams of a phrase fall on one
diagonal. For license texts, neighbouring diagonals are merged, which absorbs inserted or
missing words, and the merged span is verified: the share of the template's grams that it
has, and of the span's grams that it explains. Of the texts of one family, which share
passages, those with the best score in a document make its label.

Only the template index is broadcast: the templates are part of the program, and
``BROADCAST_GRAMS`` checks their size; with a larger library the document's hashes and
places are joined by shuffle. Words of a document never meet in one place: votes are
aggregated by document, template, diagonal.

Defined results: a null or empty text has no words, score 0 and no label; rows are told
apart by id and text, so repeated rows are all returned, each with its own result; texts
of any length are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm import license_texts

#: Word separators: what is neither 0-9, a-z nor beyond ASCII, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_GRAMS = 100_000
#: Kelvin sign, the one character beyond ASCII that lower-cases to an ASCII letter alone.
_KELVIN, _NEUTRAL = "K", "ĸ"


@dataclass(frozen=True)
class Template:
    """A text of a license; exact: a phrase whose words must all stand consecutively; base: counted as a place; family: texts that share passages."""

    label: str
    text: str
    exact: bool = False
    base: bool = False
    family: str = ""

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(r"[^0-9a-z]+", self.text.lower()) if w]


#: Fixed phrases of the contract, then the method's own phrases; the texts are in ``license_texts``.
PHRASES = (
    Template("mit", "mit license", True, True),
    Template("apache", "apache license", True, True),
    Template("gpl", "general public license", True, True),
    Template("cc-by-nc", "cc by nc", True),
    Template("cc-by-sa", "cc by sa", True),
    Template("mpl", "mozilla public license", True),
    Template("bsd", "bsd license", True),
)
TEXTS = tuple(Template(label, text, family=family) for family, label, text in license_texts.TEXTS)


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased. ``lower`` maps more than A-Z, but beyond ASCII no word boundary or template word depends on it."""
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit(_NEUTRAL)))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def _hashes(words: list[Column]) -> list[Column]:
    return [F.xxhash64(*words).alias("h"), F.xxhash64(F.lit("other"), *words).alias("other")]


def _index(spark: SparkSession, templates: list[tuple[int, Template]], k: int) -> tuple[DataFrame, int]:
    rows = [(no, at, t.words[at : at + k]) for no, t in templates for at in range(len(t.words) - k + 1)]
    book = spark.createDataFrame(rows, "template int, tpos int, gram array<string>")
    return book.select("template", "tpos", *_hashes([F.col("gram")[j] for j in range(k)])), len(rows)


def _votes(words: DataFrame, templates: list[tuple[int, Template]], k: int, most: int = BROADCAST_GRAMS) -> DataFrame:
    """(d, th, template, diagonal, tpos) of every match."""
    index, size = _index(words.sparkSession, templates, k)
    at = words.where(F.size("words") >= k).select("d", "th", "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("i"))
    gram = at.select("d", "th", "i", *_hashes([F.expr(f"words[i + {j}]") for j in range(k)]))
    found = gram.join(F.broadcast(index) if size <= most else index, ["h", "other"])
    return found.select("d", "th", "template", (F.col("i") - F.col("tpos")).alias("diagonal"), "tpos")


def scan(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    phrases: tuple[Template, ...] = PHRASES,
    texts: tuple[Template, ...] = TEXTS,
    phrase_k: int = 2,
    text_k: int = 4,
    neighbour: int = 8,
    least_score: float = 0.6,
    most: int = BROADCAST_GRAMS,
) -> DataFrame:
    """One row for each row: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    neighbour: diagonals so many words apart are merged; least_score: share of a license
    text that makes its label; most: so many template grams are broadcast. score is the best
    share; a whole phrase is 1.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), words_of(F.col(text)).alias("words"))
    phrase_no, text_no = list(enumerate(phrases)), list(enumerate(texts, len(phrases)))
    facts = spark.createDataFrame(
        [(no, t.label, t.base, t.family, len(t.words) - (phrase_k if t.exact else text_k) + 1) for no, t in phrase_no + text_no],
        "template int, label string, base boolean, family string, grams int",
    )
    spot = ["d", "th", "template"]
    exact = (
        _votes(rows, phrase_no, phrase_k, most)
        .groupBy(*spot, "diagonal")
        .agg(F.count_distinct("tpos").alias("votes"))
        .join(F.broadcast(facts), "template")
        .where("votes = grams")
        .select("d", "th", "label", "base", F.col("diagonal").alias("place"), F.lit(1.0).alias("score"), F.lit(1.0).alias("best"))
    )
    by_diagonal = _votes(rows, text_no, text_k, most).groupBy(*spot, "diagonal").agg(F.count_distinct("tpos").alias("votes"), F.min("tpos").alias("lo"), F.max("tpos").alias("hi"))
    order = Window.partitionBy(*spot).orderBy("diagonal")
    merged = (
        by_diagonal.withColumn("apart", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(0)) > neighbour).cast("int"))
        .withColumn("group", F.sum("apart").over(order))
        .groupBy(*spot, "group")
        .agg(F.sum("votes").alias("votes"), F.min(F.col("diagonal") + F.col("lo")).alias("start"), F.max(F.col("diagonal") + F.col("hi")).alias("end"))
        .join(F.broadcast(facts), "template")
        .withColumn("score", F.least(F.lit(1.0), F.col("votes") / F.col("grams"), F.col("votes") / (F.col("end") - F.col("start") + 1)))
        .select("d", "th", "label", "base", F.lit(None).cast("int").alias("place"), "score", F.max("score").over(Window.partitionBy("d", "th", "family")).alias("best"))
    )
    hit = (F.col("score") >= least_score) & (F.col("score") == F.col("best"))
    found = (
        exact.unionByName(merged)
        .groupBy("d", "th")
        .agg(
            F.count(F.when(F.col("base"), F.col("place"))).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("place"))).cast("bigint").alias("first_word"),
            F.max(F.when(F.col("base"), F.col("place"))).cast("bigint").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("label")))), ",").alias("labels"),
            F.max("score").alias("score"),
        )
    )
    all_rows = rows.select("d", "th", F.size("words").cast("bigint").alias("n_words"))
    joined = all_rows.alias("a").join(found.alias("f"), F.expr("a.d <=> f.d AND a.th = f.th"), "left")
    blank = F.lit("")
    return joined.select(
        F.col("a.d").alias(key),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", blank).alias("base_labels"),
        F.coalesce("labels", blank).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle(phrases: tuple[Template, ...] = PHRASES, texts: tuple[Template, ...] = TEXTS, phrase_k: int = 2, text_k: int = 4, neighbour: int = 8, least_score: float = 0.6) -> str:
    """The same rows in DuckDB SQL."""
    grams, facts = [], []
    for no, t in enumerate([*phrases, *texts]):
        k = phrase_k if t.exact else text_k
        facts.append(f"({no}, '{t.label}', {t.base}, '{t.family}', {len(t.words) - k + 1})")
        grams += [f"({no}, {at}, '{' '.join(t.words[at : at + k])}')" for at in range(len(t.words) - k + 1)]
    n = len(phrases)
    return rf"""
WITH facts(template, label, base, family, grams) AS (VALUES {', '.join(facts)}), idx(template, tpos, gram) AS (VALUES {', '.join(grams)}),
rows AS (
  SELECT doc_id, row_number() OVER () AS th,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), spots AS (SELECT th, words, unnest(range(len(words))) AS i FROM rows), votes AS (
  SELECT DISTINCT th, template, i - tpos AS diagonal, tpos FROM spots JOIN idx ON gram = array_to_string(words[i + 1:i + {phrase_k}], ' ') WHERE template < {n} AND i + {phrase_k} <= len(words)
  UNION ALL SELECT DISTINCT th, template, i - tpos, tpos FROM spots JOIN idx ON gram = array_to_string(words[i + 1:i + {text_k}], ' ') WHERE template >= {n} AND i + {text_k} <= len(words)
), diagonals AS (
  SELECT th, template, diagonal, count(*) AS votes, min(tpos) AS lo, max(tpos) AS hi FROM votes GROUP BY ALL
), apart AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {neighbour} THEN 1 ELSE 0 END AS apart FROM diagonals WHERE template >= {n} WINDOW w AS (PARTITION BY th, template ORDER BY diagonal)
), grouped AS (
  SELECT *, sum(apart) OVER (PARTITION BY th, template ORDER BY diagonal) AS g FROM apart
), found AS (
  SELECT th, label, base, diagonal AS place, 1.0 AS score, 1.0 AS best FROM diagonals JOIN facts USING (template) WHERE template < {n} AND votes = grams
  UNION ALL
  SELECT th, label, base, NULL, score, max(score) OVER (PARTITION BY th, family) FROM (
    SELECT th, label, base, family, least(1.0, sum(votes) / any_value(grams), sum(votes) / (max(diagonal + hi) - min(diagonal + lo) + 1)) AS score FROM grouped JOIN facts USING (template) GROUP BY th, template, g, label, base, family)
), best AS (
  SELECT th, count(place) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (score >= {least_score} AND score = best)), ','), '') AS labels, max(score) AS score
  FROM found GROUP BY th
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM rows LEFT JOIN best USING (th)
"""
