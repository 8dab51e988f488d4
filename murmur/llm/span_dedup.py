"""Substring dedup by sliding sentence spans.

A text is cut into pieces (called sentences here) after the word of the smallest hash of
every 7 neighbouring words, so a piece has at most 7 words and cuts fall at the same words
wherever a passage stands, but for 6 words at its ends. 7 are few enough for any 50 common
words to hold a run of 25. From every sentence the shortest run of at least
``sentences`` sentences and ``words`` words is hashed to 64 bits (among 10 ** 12 runs, one in
2 * 10 ** 7 meets a stranger). Runs are joined over all
texts; the first place of a run, by document and place, is kept, and every sentence under
any other place of it is removed.

A run moves as its hash and document only, once a document; documents that lose sentences are cut
again for the places. Other places of a run in the same document are known without a join. First
documents are aggregated before the join, and a run that a third of all texts hold is met by one
row on the other side, so Spark can split it.

Defined results: a null or empty text has no sentence; rows that repeat a doc_id are one
document, which keeps what only they share, and repeated rows give one row; of equal texts
the smallest doc_id keeps them; what is left of a text keeps its own white space; ids are of
any type that can be ordered; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import Tables

#: A word; in scripts without spaces each character is one.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"(?:[{_UNSPACED}]|[^\s{_UNSPACED}]+)\s*")


def sentences_of(text: str | None, window: int = 7) -> list[tuple[int, int, int]]:
    """(start, end, words) of the pieces of a text, white space after them included.

    A text is cut after the word of the smallest hash (the last of equal ones) of every ``window`` neighbouring words.
    """
    if not text:
        return []
    ends, hashes = [], []
    for m in _WORD.finditer(text):
        ends.append(m.end())
        hashes.append(xxhash.xxh32_intdigest(m[0].rstrip()))
    out, at, before, best = [], 0, 0, -1
    for i, h in enumerate(hashes):
        if best <= i - window:
            best = min(range(max(i - window + 1, 0), i + 1), key=lambda j: (hashes[j], -j))
        elif h <= hashes[best]:
            best = i
        if i >= window - 1 and best >= before:
            out.append((at, ends[best], best + 1 - before))
            at, before = ends[best], best + 1
    if at < len(text):
        out.append((at, len(text), len(ends) - before))
    return out


def runs_of(text: str | None, sentences: int, words: int) -> list[tuple[int, int, int]]:
    """(first sentence, sentences, hash) of the shortest run from every sentence that is long enough."""
    cuts = sentences_of(text)
    keys = [" ".join(text[a:b].split()).encode() for a, b, _ in cuts]
    out, last, total = [], 0, 0
    for i in range(len(cuts)):
        while last < len(cuts) and (last - i < sentences or total < words):
            total += cuts[last][2]
            last += 1
        if last - i < sentences or total < words:
            break
        out.append((i, last - i, xxhash.xxh3_64_intdigest(b"\n".join(keys[i:last])) - (1 << 63)))
        total -= cuts[i][2]
    return out


def repeated_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sentences: int = 3, words: int = 25, tables: Tables | None = None) -> DataFrame:
    """(d, hashes): the runs of each document that another document holds first; empty where only its own text repeats them."""
    tables = tables or Tables(docs.sparkSession, "span-dedup")

    def read(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part, which, told = batch.slice(begin, 500), [], []
                for r, value in enumerate(part.column(1).to_pylist()):
                    hashes = [h for _, _, h in runs_of(value, sentences, words)]
                    own = list(dict.fromkeys(hashes))
                    own += [None] * (len(own) < len(hashes))  # no hash: the text repeats a run of its own
                    which += [r] * len(own)
                    told += own
                if which:
                    yield pa.record_batch([part.column(0).take(pa.array(which, pa.int64())), pa.array(told, pa.int64())], names=["d", "h"])

    own = docs.select(F.col(key).alias("d"), F.col(text).alias("t"))
    runs = tables.write(own.mapInArrow(read, f"d {own.schema['d'].dataType.simpleString()}, h bigint"), "runs")
    firsts = runs.where("h IS NOT NULL").groupBy("h").agg(F.min("d").alias("first"), F.count("*").alias("c")).where("c > 1").select("h", "first")
    others = runs.where("h IS NOT NULL").join(firsts, "h").where("d <> first").select("d", "h")
    return others.unionByName(runs.where("h IS NULL")).groupBy("d").agg(F.collect_set("h").alias("hashes"))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sentences: int = 3, words: int = 25, tables: Tables | None = None) -> DataFrame:
    """A row for each document that loses sentences: ``key``, n_sentences, n_removed, spans (start:end in code points), text (what is left)."""
    tables = tables or Tables(docs.sparkSession, "span-dedup")
    later = repeated_runs(docs, key=key, text=text, sentences=sentences, words=words, tables=tables)
    own = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    names = ["d", "n_sentences", "n_removed", "spans", "text"]

    def cut(batches):
        for batch in batches:
            which, rows = [], []
            for r, (value, hashes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                cuts, seen = sentences_of(value), set(hashes)
                gone = [False] * len(cuts)
                reached = 0
                for at, n, h in runs_of(value, sentences, words):  # in order of place: what an earlier run marked isn't marked again
                    if h in seen:
                        for i in range(max(at, reached), at + n):
                            gone[i] = True
                        reached = max(reached, at + n)
                    seen.add(h)
                if not reached:  # another text of the same id
                    continue
                spans: list[list[int]] = []
                for (a, b, _), g in zip(cuts, gone):
                    if g and spans and spans[-1][1] == a:
                        spans[-1][1] = b
                    elif g:
                        spans.append([a, b])
                which.append(r)
                rows.append((len(cuts), sum(gone), ",".join(f"{a}:{b}" for a, b in spans), "".join(value[a:b] for (a, b, _), g in zip(cuts, gone) if not g)))
            told = [pa.array([row[j] for row in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.record_batch([batch.column(0).take(pa.array(which, pa.int64())), *told], names=names)

    met = own.join(later, own["d"].eqNullSafe(later["d"])).select(own["d"], own["th"], "t", "hashes").dropDuplicates(["d", "th"])
    return met.select("d", "t", "hashes").mapInArrow(cut, f"d {met.schema['d'].dataType.simpleString()}, n_sentences bigint, n_removed bigint, spans string, text string").withColumnsRenamed({"d": key})
