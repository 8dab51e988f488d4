"""The ten operators' queries over the whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import chat_format, decontaminate, html_extract, license_scan, near_dedup, oracles, pii, quality_rules, sentencepiece_codec, span_dedup, url_rules
from murmur.llm.common import Tables, small, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

#: Fixed rules of the URL contract: (verdict, host, path).
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The method's own rules: host labels, path segments and file extensions of no use as training text.
BLOCKED_LABELS = ["ads", "adserver", "doubleclick", "tracker", "tracking", "porn", "xxx", "casino", "poker", "torrent", "webmail", "captcha"]
BLOCKED_SEGMENTS = ["login", "signin", "signup", "logout", "cart", "checkout", "wp-login", "wp-admin", "cgi-bin"]
BLOCKED_EXTENSIONS = ["exe", "zip", "gz", "iso", "dmg", "apk", "jpg", "jpeg", "png", "gif", "webp", "mp3", "mp4", "avi", "css", "js", "woff", "woff2"]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences to a run found earlier, with what is removed and left."""
    return span_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact encoding and decoding of every document, as digests."""
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL, digests=True)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7 formatted, then read back from the output."""
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(extra)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def url_rule_book() -> list[url_rules.Rule]:
    return (
        [url_rules.host_rule(*r) for r in HOST_RULES]
        + [url_rules.token_rule("block", t, "label") for t in BLOCKED_LABELS]
        + [url_rules.token_rule("block", t, "segment") for t in BLOCKED_SEGMENTS]
        + [url_rules.token_rule("block", t, "extension") for t in BLOCKED_EXTENSIONS]
    )


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; rule is the host rule that decided, if one did."""
    judged = url_rules.judge(table(spark, sf_dir, "pages"), url_rule_book())
    return judged.withColumn("rule", F.when(F.col("rank") == 1, F.col("rule"))).drop("rank")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, by shingles of four words."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms of every document."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a document and a benchmark item that it holds, in any order of its parts."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every document, the base rules, and the verdict with cutoffs fitted on all labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    tables = Tables(spark, "op10")
    found = tables.write(quality_rules.features(docs).drop("text"), "figures")
    cutoffs = small(tables.write(quality_rules.fit(found, table(spark, sf_dir, "labels")), "cutoffs"))
    return quality_rules.judge(found, cutoffs).select("doc_id", *quality_rules.FIGURES, "kept")


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_span_dedup": op2_span_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chat_format": op4_chat_format,
    "op5_license_scan": op5_license_scan,
    "op6_url_rules": op6_url_rules,
    "op7_near_dedup": op7_near_dedup,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES: dict[str, str] = {
    "op4_chat_format": oracles.CHAT_FORMAT,
    "op5_license_scan": license_scan.oracle(),
    "op6_url_rules": oracles.url_rules_sql(HOST_RULES, BLOCKED_LABELS, BLOCKED_SEGMENTS, BLOCKED_EXTENSIONS),
    "op7_near_dedup": oracles.NEAR_DEDUP,
    "op8_pii": oracles.pii_sql(),
    "op10_quality_rules": oracles.quality_sql(quality_rules.RULES),
}
