"""Personal data: fixed patterns, and information-theoretic sanitisation of revealing terms.

Patterns find the protected entities (e-mail, ip, card, phone, and secrets such as
``password=...``). The method then asks which words near an entity give it away: of all
N texts, n(e) hold the entity, n(t) hold the term, n(t, e) hold the term within a
few words of the entity. Disclosure is the pointwise mutual information in units of what
the entity itself would tell: log(N n(t,e) / (n(t) n(e))) / log(N / n(e)). Terms seen with
an entity in ``support`` distinct texts or more whose disclosure reaches ``generalise``
are replaced by their shape (``[NAME]``, ``[NUMBER]``, ``[WORD]``), from ``remove`` on they go, in
every text that holds the term, with or without the entity. That
support counts distinct texts keeps copies of one text from looking like evidence.

Everything is DataFrame expressions. Places come from the matches and the gaps between
them, by prefix sums in blocks, so long texts with many matches stay near linear; the
patterns are possessive or anchored at the start of a run, so no text makes them step back
for long. Words are counted over all texts, but only the candidate terms among them move. The
rows that say a term near any entity are a part of n(t), so a term whose disclosure would stay
below the limit with these alone, as that of every common word, is no candidate.
Where candidates are few, as counted, a broadcast leaves the others out before the aggregation;
beyond that the vocabulary is aggregated in each task first and joined by shuffle.

Defined results: a null or empty text has no spans; rows are told apart by id and text,
so repeated rows are all returned; ids are of any type; words cut off by the ``reach`` are no terms; overlapping spans of different kinds are all reported,
and text is replaced kind by kind in the listed order; extra columns are kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import Tables, let

#: Fixed patterns of the contract: what finds them is the same, and written so that it never steps back far.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The method's own kind: values named as secrets.
SECRET = r"(?i)\b(?:password|passwd|token|secret|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{12,}+[\"']?"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, None), ("phone", PHONE, "+"), ("secret", SECRET, None))
#: Words: letters and digits of any script.
TERM = r"[\p{L}\p{N}]+"
#: Rows that hold revealing terms are broadcast up to this many (ten MB or so); more are joined by shuffle.
BROADCAST_ROWS = 50_000
_BLOCK = 512


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""

    def of(digits: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
            doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return total + F.when(i % 2 == 1, doubled).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0

    return let(_digits(value), of)


def valid(kind: str, value: Column) -> Column:
    """The fixed test that a match of a kind must pass."""
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3) & F.forall(F.split(value, r"\."), lambda part: F.coalesce(F.right(F.concat(F.lit("000"), part), F.lit(3)).try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _prefix_sums(values: Column) -> Column:
    """Running sums: of blocks, then within blocks, so that no array is copied once an element."""

    def running(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["all"], s["sum"] + x).alias("all")), lambda s: s["all"])

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: running(F.slice(xs, b * _BLOCK + 1, _BLOCK)))

        def joined(bs: Column) -> Column:
            before = running(F.transform(bs, lambda b: F.element_at(b, -1)))
            return let(before, lambda totals: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda x: x + F.coalesce(F.get(totals, i - 1), F.lit(0))))))

        return let(blocks, joined)

    return let(values, of)


def _spans(text: Column, pattern: Column, kind_no: int, kind: str, needle: str | None = None) -> Column:
    """array of (start, kind_no, kind, end, value) of a kind, in code points, end exclusive."""
    empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>")

    def of(matches: Column) -> Column:
        def placed(gaps: Column) -> Column:
            sizes = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

            def build(ends: Column) -> Column:
                return F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), m.alias("value")))

            return F.filter(let(_prefix_sums(sizes), build), lambda s: valid(kind, s["value"]))

        return F.when(F.size(matches) == 0, empty).otherwise(let(F.split(text, pattern, F.lit(-1)), placed))

    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), of)
    return F.when(F.contains(text, F.lit(needle)), found).otherwise(empty) if needle else found


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", near: int = 6, reach: int = 120) -> DataFrame:
    """(d, th, spans, near, told): the pattern spans of every row, by start, then kind as listed, the terms near each, and those of all that are whole words of the text.

    near: words on either side of a span, which are sought within ``reach`` characters.
    """
    rows = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = F.array_sort(F.concat(*[_spans(F.col("t"), F.lit(p), no, kind, needle) for no, (kind, p, needle) in enumerate(KINDS)]))

    def context(s: Column) -> Column:
        # One character more than the reach tells whether the outermost word is whole.
        left = F.substring(F.col("t"), F.greatest(s["start"] - reach - 1, F.lit(0)) + 1, F.least(s["start"], F.lit(reach + 1)))
        right = F.substring(F.col("t"), s["end"] + 1, F.lit(reach + 1))
        left = F.when(s["start"] > reach, F.regexp_replace(left, rf"\A{TERM}", "")).otherwise(left)
        right = F.when(F.length(right) > reach, F.regexp_replace(right, rf"{TERM}\z", "")).otherwise(right)
        before = F.slice(F.reverse(_words(left)), 1, near)
        return F.filter(F.array_union(before, F.slice(_words(right), 1, near)), lambda w: F.length(w) > 2)

    def told(near: Column) -> Column:
        return F.when(F.size(near) > 0, F.array_intersect(F.flatten(near), _words(F.col("t")))).otherwise(F.array().cast("array<string>"))

    def row(spans: Column) -> Column:
        return let(F.transform(spans, context), lambda near: F.struct(spans.alias("spans"), near.alias("near"), told(near).alias("told")))

    return rows.select("d", "th", let(found, row).alias("x")).select("d", "th", "x.*")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _entity(span: Column) -> Column:
    """The value that makes two spans the same entity."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def revealing_terms(docs: DataFrame, found: DataFrame, tables: Tables, *, text: str = "text", support: int = 3, generalise: float = 0.9) -> DataFrame:
    """(e, term, disclosure) of the terms that reveal an entity; ``found`` is the written result of ``find``."""
    mentions = found.where(F.size("spans") > 0).select("d", "th", F.explode(F.arrays_zip("spans", "near")).alias("x")).select("d", "th", F.xxhash64(_entity(F.col("x.spans"))).alias("e"), F.col("x.near").alias("near"))
    # A row counts once for an entity however often it has it; the number of distinct texts keeps copies from being support.
    by_row = mentions.groupBy("d", "th", "e").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    shared = by_row.groupBy("e", "th").agg(F.count("*").alias("c")).groupBy("e").agg(F.sum("c").alias("ne"), F.count("*").alias("texts"))
    shared = shared.where(F.col("texts") >= support).select("e", "ne")
    pairs = by_row.join(shared, "e").select("e", "ne", "th", F.explode("near").alias("term"))
    together = pairs.groupBy("e", "term", "th").agg(F.count("*").alias("c"), F.first("ne").alias("ne")).groupBy("e", "term").agg(F.sum("c").alias("nte"), F.count("*").alias("texts"), F.first("ne").alias("ne"))

    def disclosure(nt: Column) -> Column:
        return F.log(F.col("n") * F.col("nte") / (nt * F.col("ne"))) / F.log(F.col("n") / F.col("ne"))

    heard = found.select(F.explode("told").alias("term")).groupBy("term").agg(F.count("*").alias("least"))
    likely = together.where(F.col("texts") >= support).withColumn("n", found.agg(F.count("*").alias("n")).scalar()).where(F.col("n") > F.col("ne")).join(heard, "term", "left")
    candidates = tables.write(likely.where(disclosure(F.coalesce("least", F.lit(1))) >= generalise).select("e", "term", "nte", "ne", "n"), "candidates")
    spoken = docs.select(F.explode(F.array_distinct(_words(F.coalesce(F.col(text), F.lit(""))))).alias("term"))
    asked = candidates.select("term").distinct()
    if asked.count() <= BROADCAST_ROWS:
        spoken = spoken.join(F.broadcast(asked), "term", "left_semi")
    counts = spoken.groupBy("term").agg(F.count("*").alias("nt"))
    return candidates.join(counts, "term").select("e", "term", disclosure(F.col("nt")).alias("disclosure")).where(F.col("disclosure") >= generalise)


def revealed_rows(docs: DataFrame, revealing: DataFrame, tables: Tables, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, th, terms) of all rows that hold a revealing term, with or without its entity; broadcast where few."""
    told = tables.write(revealing.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "told")
    told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told
    words = F.array_distinct(_words(F.coalesce(F.col(text), F.lit(""))))
    spoken = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.explode(words).alias("term"))
    rows = tables.write(spoken.join(told, "term").groupBy("d", "th").agg(F.array_sort(F.collect_set(F.struct("term", "disclosure"))).alias("terms")), "revealed")
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def term_spans(docs: DataFrame, revealed: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, th, extra): the spans of revealing terms in each row that has any."""
    keys = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    texts = keys.join(revealed, keys["d"].eqNullSafe(revealed["d"]) & (keys["th"] == revealed["th"])).select(keys["d"], keys["th"], "t", "terms").dropDuplicates(["d", "th"])
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_distinct(F.transform("terms", lambda x: x["term"])), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return texts.withColumn("p", pattern).select("d", "th", _spans(F.col("t"), F.col("p"), len(KINDS), "term").alias("extra"))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", near: int = 6, reach: int = 120, tables: Tables | None = None, **limits) -> DataFrame:
    """A row for each row: ``key``, n_<kind> of the fixed kinds, base_sha256, spans (all, as text)."""
    tables = tables or Tables(docs.sparkSession, "pii")
    found = tables.write(find(docs, key=key, text=text, near=near, reach=reach), "spans")
    revealing = tables.write(revealing_terms(docs, found, tables, text=text, **limits), "revealing")
    extra = term_spans(docs, revealed_rows(docs, revealing, tables, key=key, text=text), key=key, text=text)
    joined = found.alias("f").join(extra.alias("x"), F.expr("f.d <=> x.d AND f.th = x.th"), "left").select("f.d", "spans", "extra")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    everything = F.array_sort(F.concat("spans", F.coalesce("extra", F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>"))))
    return joined.select(
        F.col("d").alias(key),
        *[F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(everything).alias("spans"),
    )


def _replaced(text: Column, pattern: Column, kind: str, tag, needle: str | None = None) -> Column:
    """The text with the valid matches of a kind replaced by ``tag(match)``."""

    def of(matches: Column) -> Column:
        def build(gaps: Column) -> Column:
            put = lambda m: F.when(m.isNull(), "").when(valid(kind, m), tag(m)).otherwise(m)  # noqa: E731  no match follows the last gap
            return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, put(F.get(matches, i)))), "")

        return F.when(F.size(matches) == 0, text).otherwise(let(F.split(text, pattern, F.lit(-1)), build))

    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), of)
    return F.when(F.contains(text, F.lit(needle)), found).otherwise(text) if needle else found


def _shape(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit("^[0-9]+$")), "[NUMBER]").when(F.rlike(value, F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[WORD]")


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", remove: float = 0.97, near: int = 6, reach: int = 120, tables: Tables | None = None, **limits) -> DataFrame:
    """The rows with all spans replaced in ``text``: fixed kinds by their tag, revealing terms by their shape or nothing."""
    tables = tables or Tables(docs.sparkSession, "pii")
    found = tables.write(find(docs, key=key, text=text, near=near, reach=reach), "spans")
    revealing = tables.write(revealing_terms(docs, found, tables, text=text, **limits), "revealing")
    terms = revealed_rows(docs, revealing, tables, key=key, text=text)
    gone = F.transform("terms", lambda x: F.struct(x["term"], (x["disclosure"] >= remove).alias("gone")))
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_d"), F.col(text).alias("_t"))
    body = rows.join(terms, F.col("_d").eqNullSafe(F.col("d")) & (F.xxhash64("_t") == F.col("th")), "left").select("_row", "_t", gone.alias("_terms"))
    for kind, pattern, needle in KINDS:
        body = body.withColumn("_t", _replaced(F.col("_t"), F.lit(pattern), kind, lambda m: F.lit(f"[{kind.upper()}]"), needle))
    chosen = lambda g: F.array_join(F.transform(F.filter("_terms", lambda x: x["gone"] == g), lambda x: x["term"]), "|")
    bounded = lambda p: F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}\[])(?:"), p, F.lit(r")(?![\p{L}\p{N}\]])"))
    for g, tag in ((True, lambda m: F.lit("")), (False, _shape)):
        pattern = chosen(g)
        body = body.withColumn("_t", F.when(F.col("_terms").isNull() | (pattern == ""), F.col("_t")).otherwise(_replaced(F.col("_t"), bounded(pattern), "term", tag)))
    return body.select(F.col("_row").withField(text, F.col("_t")).alias("_row")).select("_row.*")
