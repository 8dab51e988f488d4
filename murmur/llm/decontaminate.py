"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Words are lower-cased runs of letters and digits; a match of k words or more holds a shared
k-gram of words (a seed), so the seeds tell all matches and no document's text moves. Tiles
that cover a share c of an item's n words hold at least c n / k of its gram places, so a
document that passes has one of the item's rarest grams: all but the c n / k - 1 places whose
grams are commonest among the documents. Documents and items are joined on those only; a
gram that all documents and all items have brings no pair together. Pairs that meet are
joined on all their seeds, one row a place in the document, and dropped if these could not
cover enough of the item. The others are tiled: windows of the search length
are hashed by a rolling Karp-Rabin hash, matches are extended and compared word by word,
the longest are marked first and never overlap, and the search length falls until it is k.
The share of an item's words under tiles is its coverage; passages in another order keep
it, since tiles may lie anywhere.

The seeds' hashes filter document grams inside the tasks where a benchmark has at most
``FILTER_GRAMS`` of them (8 bytes each); beyond it, all grams go into the join.

Defined results: null or empty texts and items match nothing; rows without an id are not
reported and stay; items shorter than k words
are never matched; rows that repeat a doc_id and text are reported once a pair; items that
repeat with their id are reported once, with another id each; ids are of any type; texts of
any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import Tables, arrow_batches, only, remember, without

FILTER_GRAMS = 4_000_000
_MEMO_WORDS = 150_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE, _MOD = 1_000_003, (1 << 61) - 1
_memo: dict[str, int] = {}
remember("decontaminate", _memo.clear)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word, in order."""
    if len(_memo) > _MEMO_WORDS:
        _memo.clear()
    out = []
    for w in _WORD.findall(text.lower()) if text else ():
        h = _memo.get(w)
        if h is None:
            h = _memo[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    if len(words) < k:
        return np.empty(0, np.int64)
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _MIX + words[i : len(words) - k + 1 + i]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).astype(np.int64)


def tiles(text: list[int], item: list[int], k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in text, place in item, length), longest first, none overlapping. Words equal to -1 match nothing."""
    marked_t, marked_i = [w == -1 for w in text], [w == -1 for w in item]
    out: list[tuple[int, int, int]] = []

    def windows(words: list[int], marked: list[bool], s: int):
        """(start, rolling hash) of every unmarked window of s words."""
        power, start, value = pow(_BASE, s - 1, _MOD), 0, 0
        for at, w in enumerate(words):
            if marked[at]:
                start, value = at + 1, 0
                continue
            if at - start >= s:
                value = (value - words[at - s] % _MOD * power) % _MOD
            value = (value * _BASE + w) % _MOD
            if at - start + 1 >= s:
                yield at - s + 1, value

    def extended(t: int, i: int) -> int:
        n = 0
        while t + n < len(text) and i + n < len(item) and not marked_t[t + n] and not marked_i[i + n] and text[t + n] == item[i + n]:
            n += 1
        return n

    s = max(k, min(len(text), len(item)))
    while True:
        table: dict[int, list[int]] = {}
        for i, value in windows(item, marked_i, s):
            table.setdefault(value, []).append(i)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for t, value in windows(text, marked_t, s) if table else ():
            for i in table.get(value, ()):
                n = extended(t, i)
                if n >= s:
                    found.append((n, t, i))
                    longest = max(longest, n)
        for n, t, i in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            free = not any(marked_t[t : t + n]) and not any(marked_i[i : i + n])
            if free:
                marked_t[t : t + n] = marked_i[i : i + n] = [True] * n
                out.append((t, i, n))
        if all(marked_i) or s == k and not found:
            return out
        if not found:
            s = max(k, s * 3 // 4 if s > 2 * k else s - 1)
        # else the same length again: parts of matches that others overlapped may be left


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    k: int = 3,
    coverage: float = 0.6,
    tables: Tables | None = None,
) -> DataFrame:
    """(``key``, ``item_key``, coverage, n_tiles, tiles as text) of every document and item that pass."""
    with arrow_batches(docs.sparkSession, 1000):
        return _contaminated(docs, benchmark, key, text, item_key, item_text, k, coverage, tables or Tables(docs.sparkSession, "decontaminate"))


def _benchmark(benchmark: DataFrame, item_key: str, item_text: str, k: int, tables: Tables) -> DataFrame:
    """(row, item, words, grams) of every distinct item."""

    def read(batches):
        for batch in batches:
            found = [word_hashes(t) for t in batch.column(1).to_pylist()]
            words, grams = pa.array([w.astype(np.int64) for w in found], pa.list_(pa.int64())), pa.array([gram_hashes(w, k) for w in found], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), words, grams], names=["item", "words", "grams"])

    rows = benchmark.select(F.col(item_key).alias("item"), F.col(item_text).alias("t"))
    items = rows.mapInArrow(read, f"item {rows.schema['item'].dataType.simpleString()}, words array<bigint>, grams array<bigint>")
    return tables.write(items.withColumn("row", F.xxhash64("item", "words")).dropDuplicates(["row"]), "items")


def _seeds(docs: DataFrame, key: str, text: str, grams: DataFrame, k: int, tables: Tables) -> DataFrame:
    """(d, th, dpos, h): the places of the documents' grams, those of the benchmark alone where it has few."""
    wanted = grams.select("h").distinct()
    few = wanted.count() <= FILTER_GRAMS
    sieve = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["h"].to_numpy())) if few else None

    def read(batches):
        only("decontaminate")
        sorted_grams = sieve.value if sieve is not None else None
        bits = None
        if sorted_grams is not None:
            bits = np.zeros(1 << 24, np.bool_)
            bits[sorted_grams & 0xFFFFFF] = True
        for batch in batches:
            rows, places, found = [], [], []
            for r, value in enumerate(batch.column(2).to_pylist()):
                own = gram_hashes(word_hashes(value), k)
                at = np.arange(len(own))
                if bits is not None and len(own):
                    at = at[bits[own & 0xFFFFFF]]
                    if len(at):
                        spot = np.minimum(np.searchsorted(sorted_grams, own[at]), len(sorted_grams) - 1)
                        at = at[sorted_grams[spot] == own[at]]
                if len(at):
                    rows.append(np.full(len(at), r))
                    places.append(at.astype(np.int32))
                    found.append(own[at])
            if rows:
                which = pa.array(np.concatenate(rows))
                yield pa.record_batch([batch.column(0).take(which), batch.column(1).take(which), pa.array(np.concatenate(places)), pa.array(np.concatenate(found))], names=["d", "th", "dpos", "h"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    return tables.write(rows.mapInArrow(read, f"d {rows.schema['d'].dataType.simpleString()}, th bigint, dpos int, h bigint"), "seeds")


def _contaminated(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str, k: int, coverage: float, tables: Tables) -> DataFrame:
    items = _benchmark(benchmark, item_key, item_text, k, tables)
    # One row a distinct gram of an item, with its places: a gram that repeats in both texts makes no pairs of places.
    placed = items.select("row", F.size("words").alias("n"), F.posexplode("grams").alias("ipos", "h"))
    grams = tables.write(placed.groupBy("row", "n", "h").agg(F.sort_array(F.collect_list("ipos")).alias("ips")), "grams")
    seeds = _seeds(docs, key, text, grams, k, tables)
    # An item's places that documents must hit at least, less one, may be its commonest: the other grams bring pairs together.
    spare = F.ceil(F.ceil(F.lit(coverage) * F.col("n") - 1e-9) / k) - 1
    common = seeds.groupBy("h").agg(F.count("*").alias("seen"))
    order = Window.partitionBy("row").orderBy(F.desc("seen"), "h")
    ranked = grams.join(common, "h").withColumn("upto", F.sum(F.size("ips")).over(order))
    rare = tables.write(ranked.where(F.col("upto") > spare).select("row", "h"), "rare")
    near = tables.write(seeds.join(rare, "h").select("d", "th", "row").distinct(), "near")
    met = seeds.join(near, ["d", "th"]).join(grams, ["row", "h"])
    pairs = met.groupBy("d", "th", "row", "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ips")))).alias("ps"), F.collect_set(F.struct("dpos", F.col("ips")[0].alias("ipos"))).alias("seeds"))
    # What the seeds of a pair could cover at best: item words under any seed.
    best = F.aggregate(F.transform("ps", lambda p, i: F.least(F.lit(k), F.coalesce(F.get("ps", i + 1) - p, F.lit(k)))), F.lit(0), lambda a, x: a + x)
    pairs = tables.write(pairs.where(best >= F.lit(coverage) * F.col("n")).select("d", "row", "seeds"), "pairs")

    def tile(batches):
        for batch in batches:
            rows, out = [], []
            for r, (words, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                # The text's words under seeds are the item's words; a gap stands for all other words.
                at: dict[int, int] = {}
                for s in sorted(own, key=lambda s: s["dpos"]):
                    for j in range(k):
                        at[s["dpos"] + j] = words[s["ipos"] + j]
                places, part, before = [], [], None
                for p in sorted(at):
                    if before is not None and p != before + 1:
                        places.append(-1)
                        part.append(-1)
                    places.append(p)
                    part.append(at[p])
                    before = p
                found = sorted((places[t], i, n) for t, i, n in tiles(part, words, k))
                share = sum(n for _, _, n in found) / len(words)
                if share >= coverage:
                    rows.append(r)
                    out.append((share, len(found), ",".join(f"{t}:{i}:{n}" for t, i, n in found)))
            which = pa.array(rows, pa.int64())
            told = [pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.float64(), pa.int64(), pa.string()))]
            yield pa.record_batch([batch.column(0).take(which), batch.column(1).take(which), *told], names=["d", "item", "coverage", "n_tiles", "tiles"])

    rows = pairs.join(items.select("row", "item", "words"), "row").select("d", "item", "words", "seeds")
    kind = lambda c: rows.schema[c].dataType.simpleString()
    found = rows.mapInArrow(tile, f"d {kind('d')}, item {kind('item')}, coverage double, n_tiles bigint, tiles string")
    return found.select(F.col("d").alias(key), F.col("item").alias(item_key), "coverage", "n_tiles", "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    tables = Tables(docs.sparkSession, "decontaminate")
    with arrow_batches(docs.sparkSession, 1000):
        found = tables.write(contaminated(docs, benchmark, key=key, tables=tables, **settings).select(key), "found")
    return without(docs, found, key)
