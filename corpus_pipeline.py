"""The training-data pipeline: five stages over documents, each on all that the one before kept.

What holds for every stage: an empty table gives an empty table; null, empty and very long
texts and repeated rows pass through as their operator defines; a row with a null id is
judged on its own text and can be no one's near duplicate; columns beyond those of
documents are left out, whatever their names, so none can clash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import decontaminate, near_dedup, pii, quality_rules, sentencepiece_codec
from murmur.llm.common import Tables, arrow_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle and per cent of similarity that make two documents near duplicates.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Texts that go to a Python worker at once.
TEXTS = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text, and one of under 20 words, goes; rows that repeat are judged alike;
    cutoffs come from the labels of ``labels``, and with none there the base rules alone decide.
    """
    return quality_rules.keep(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id.

    Texts without words are near duplicates of nothing and stay; rows that repeat a doc_id are
    one document and stay or go together.
    """
    return near_dedup.one_of_each(docs.select(COLUMNS), words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, in whatever order its parts stand; texts without words and rows without an id stay."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it are replaced in every row, and n_chars follows the text; a null text keeps its own."""
    return pii.redact(docs.select(COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), "n_chars"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: doc_id, n_tokens, the ids with begin and end, and the text that they decode to; a null text is encoded as an empty one."""
    found = sentencepiece_codec.encode_decode(docs.select(COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    with arrow_batches(spark, TEXTS):
        return Tables(spark, "encoding").write(found, "encoded")


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", encoding),
]
#: SQL can't express the stages' methods; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = tables.write(stage(spark, docs, sf_dir), f"stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
