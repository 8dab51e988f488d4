"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over host and path plus the literal tokens (runs of a-z
and 0-9, lower-cased) that every URL it fits holds whole or with digits after them. One pass counts the rules'
tokens over all URLs; each rule is filed under its rarest one. The tokens of a URL then
fetch candidate rules by an equi-join, and only those run their regular expression.
Rules with no literal token are filed under a token that every URL has.

The index is broadcast only up to ``BROADCAST_RULES`` rules, a hard bound of a few MB;
beyond it the join shuffles tokens and rules. Copies of a URL meet before anything is
exploded, so a hot URL or host costs no more than its distinct URLs.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the
default verdict unless a rule fits the empty target; repeated rows are all returned with the same result; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import ascii_lower

BROADCAST_RULES = 20_000
_ANY = ""  # the token that every URL has


@dataclass(frozen=True)
class Rule:
    """verdict: what the rule says; rank: the best wins, before length; length: longest wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0
    length: int = 0


def host_rule(verdict: str, host: str, path: str, rank: int = 1) -> Rule:
    """Fits the host and its subdomains where the path starts with the rule's path."""
    name = host + path
    pattern = rf"(?s)\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    whole = re.findall(r"[a-z0-9]+", host.lower()) + re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path.lower())
    return Rule(name, verdict, pattern, tuple(dict.fromkeys(whole)), rank, len(name))


def token_rule(verdict: str, token: str, where: str, rank: int = 0) -> Rule:
    """Fits where a host label, a path segment or a file extension is the token."""
    t = re.escape(token)
    pattern = {
        "label": rf"(?i)\A(?:[^/]*\.)?{t}\d*\.[^/]*(?:/|\z)",
        "segment": rf"(?i)/{t}(?:/|\z)",
        "extension": rf"(?i)/[^/]*\.{t}\z",
    }[where]
    whole = re.findall(r"[a-z0-9]+", token.lower().rstrip("0123456789") if where == "label" else token.lower())  # a label's number may go on
    return Rule(f"{where}:{token}", verdict, pattern, tuple(dict.fromkeys(whole)), rank, len(token))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (
        F.coalesce(ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0)), F.lit("")),
        F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit("")),
    )


def judge(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key``, host, path, rule, rank and verdict of every row; rule is null where none fits."""
    spark = pages.sparkSession
    host, path = parts(F.col("u"))
    urls = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u")).groupBy("k", "u").agg(F.count("*").alias("copies")).withColumn("host", host).withColumn("path", path)
    whole = F.split(ascii_lower(F.concat_ws("/", "host", "path")), "[^a-z0-9]+")
    numberless = F.transform(whole, lambda t: F.regexp_replace(t, "[0-9]+$", ""))
    tokens = F.array_union(F.filter(F.array_union(whole, numberless), lambda t: t != _ANY), F.array(F.lit(_ANY)))
    asked = urls.withColumn("token", F.explode(tokens))

    rule_rows = [(i, r.name, r.verdict, r.pattern, list(r.tokens) or [_ANY], r.rank, r.length) for i, r in enumerate(rules)]
    book = spark.createDataFrame(rule_rows, "rule_no int, rule string, rule_verdict string, pattern string, literals array<string>, rank int, rule_length int")
    fits_broadcast = len(rules) <= BROADCAST_RULES
    small = F.broadcast if fits_broadcast else (lambda df: df)
    literals = book.select("rule_no", F.explode("literals").alias("token"))
    counts = asked.join(small(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.sum("copies").alias("seen"))
    rarest = literals.join(counts, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token"))["token"].alias("token"))
    index = book.drop("literals").join(rarest, "rule_no")

    best = F.max(F.when(F.expr("regexp_like(concat(host, path), pattern)"), F.struct("rank", "rule_length", "rule", "rule_verdict")))
    judged = asked.join(small(index), "token", "left").groupBy("k", "u", "copies", "host", "path").agg(best.alias("best"))
    return judged.select(
        F.col("k").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.col("best.rank").alias("rank"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    ).drop("copy")
