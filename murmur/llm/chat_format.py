"""Chat formatting with Spark expressions: sort, merge same-role neighbours, concatenate.

Template of a conversation: for every run of neighbouring turns of one role
``<|turn:ROLE|>`` and a line break, the texts joined by ``<|+|>``, ``<|/turn|>`` and a
line break. Inside roles and texts a backslash becomes ``\\0``, ``<|`` becomes ``\\1`` and
``|>`` becomes ``\\2``, so no control string occurs in them and ``parse`` gets back every
turn. The loss mask covers the escaped texts of the trained roles, nothing between them;
it is given as the segments of the output in order, each with its mask bit.

Defined results: a null text or role counts as empty; turns are ordered by (turn, role,
text), nulls first, so ties are settled by content and repeated rows stay; a null
conversation id is a conversation of its own; an empty table gives an empty result; extra
columns are ignored. A conversation is one row of the result, so its turns meet in one
task; every step over them takes time in proportion to their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import let

PART, END = "<|+|>", "<|/turn|>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    return F.replace(F.replace(out, F.lit("<|"), F.lit("\\1")), F.lit("|>"), F.lit("\\2"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\1"), F.lit("<|")), F.lit("\\2"), F.lit("|>"))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def format_conversations(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv``, formatted, and segments: array of (text, loss) whose texts joined are formatted."""
    blank = F.lit("")
    rows = turns.select(F.col(conv).alias("c"), F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def merged(ts: Column) -> Column:
        """Runs of one role: array of (role, texts)."""
        heads = F.filter(F.sequence(F.lit(1), F.size(ts)), lambda i: (i == 1) | (F.element_at(ts, i)["role"] != F.element_at(ts, F.greatest(i - 1, F.lit(1)))["role"]))
        def run(hs: Column) -> Column:
            def one(at: Column, j: Column) -> Column:
                after = F.coalesce(F.get(hs, j + 1), F.size(ts) + 1)
                return F.struct(F.element_at(ts, at)["role"].alias("role"), F.transform(F.slice(ts, at, after - at), lambda t: t["text"]).alias("texts"))
            return F.transform(hs, one)
        return let(heads, run)

    def segment(piece: Column, loss: Column) -> Column:
        return F.struct(piece.alias("text"), loss.alias("loss"))

    def written(run: Column) -> Column:
        head = F.concat(F.lit("<|turn:"), escape(run["role"]), F.lit("|>\n"))
        learned = run["role"].isin(*trained)
        body = F.flatten(F.transform(run["texts"], lambda t, i: F.array(segment(F.when(i == 0, head).otherwise(PART), F.lit(False)), segment(escape(t), learned))))
        return F.concat(body, F.array(segment(F.lit(END), F.lit(False))))

    out = sorted_turns.select("c", F.flatten(F.transform(let(F.col("ts"), merged), written)).alias("segments"))
    return out.select(F.col("c").alias(conv), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, texts)."""
    runs = F.filter(F.split(formatted, r"<\|turn:"), lambda r: r != "")
    def one(run: Column) -> Column:
        role = F.substring_index(run, "|>\n", 1)
        body = F.substring(run, F.length(role) + 4, F.length(run) - F.length(role) - 3 - len(END))
        return F.struct(unescape(role).alias("role"), F.transform(F.split(body, r"<\|\+\|>"), unescape).alias("texts"))
    return F.transform(runs, one)


def digests(formatted: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """Read back from the output: turns, their digest, and what is under the loss mask."""
    back = formatted.select(conv, F.length("formatted").cast("bigint").alias("formatted_chars"), parse(F.col("formatted")).alias("runs"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"))
    each = F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda t: F.concat(r["role"], F.lit("\n"), t, F.lit("\n")))))
    return back.withColumn("each", each).select(
        conv,
        F.size("each").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("each", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
