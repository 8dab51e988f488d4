"""Near-duplicate detection by MinHash with tensored banding, links verified on full sets.

A text's set is its distinct word shingles. Two collections of half keys are computed,
each of ``halves`` keys of ``rows`` minhashes; a table key combines one half key of
either collection, so ``halves`` ** 2 tables of 2 * ``rows`` minhashes cost only
2 * ``halves`` * ``rows`` of them. A pair of similarity s shares no table with probability
at most 2 (1 - s ** rows) ** halves (1.3e-6 at 0.8 for 14 halves of 2).

Texts with equal sets collapse to one representative first, and half keys that only one
set has never become tables. Links are found in steps that stay linear in a bucket's size:

1. In the tables (i, i) every member of a bucket is paired with the bucket's smallest
   member; each set is verified against the partner that most tables name, then against
   the partners that are not connected to it yet. Connected components join what is linked.
2. In all tables, only buckets in which several components meet are looked at further.
   Up to ``bucket`` members, all pairs across components are candidates; pairs that share
   under ``least_tables`` tables are dropped (one in a million true links at most), and so
   are sets that are in fewer such buckets.
3. Members of larger such buckets are compared exactly instead: a link of similarity
   t needs a common shingle among the first (1 - t) share of both sets in any one order of
   shingles; here those that many sets have come last, so a line, passage or word pair that
   thousands of texts have joins nothing. Sets that are connected by such shingles form a group; a group is dealt
   out in blocks by size class, and each task multiplies two blocks of at most ``BLOCK``
   sets or so. No pair leaves a task but one link for two components that it connects.

All candidates are verified on their full sets. Links inside one component are not looked
for: they change no component.

Defined results: a null or empty text, or one without words, has an empty set, is linked
with nothing and is its own component; a text with fewer words than a shingle is one
shingle; equal sets are one class; rows that repeat a doc_id are one document: each row has
the size of its own set, all their sets are kept and belong to one component, and so do the
documents that any of them links; a row without an id is linked with nothing and kept; ids
are of any type that can be ordered; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import BROADCAST_IDS, Tables, arrow_batches, only, remember, without
from murmur.llm.graph import components, labelled

BLOCK = 128
#: So many of the most common shingles are told to every task (8 bytes each); with more, the least common of them count as rare.
COMMON_SHINGLES = 1_000_000
#: The meetings of a shingle's holders with their head are dealt to so many tasks.
SALTS = 16
#: Shingles that a task counts together (24 bytes each) before they move.
COUNTED = 500_000
_MEMO_WORDS = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Sketcher:
    """Shingle sets and half keys of texts; holds the words' hashes of one Python worker."""

    def __init__(self, words: int, halves: int, rows: int, seed: int = 1):
        self.words, self.halves, self.rows = words, halves, rows
        random = np.random.default_rng(seed)
        self.factor = random.integers(1, 2**63, halves * rows * 2, dtype=np.uint64) | np.uint64(1)
        self.offset = random.integers(0, 2**63, halves * rows * 2, dtype=np.uint64)
        self.salt = random.integers(1, 2**63, halves * 2, dtype=np.uint64) | np.uint64(1)
        self.memo: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct 64-bit hashes of a text's shingles."""
        found = text.encode().lower().split() if text else []  # bytes: A-Z and the six white-space characters only
        if not found:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > _MEMO_WORDS:
            memo.clear()
        hashes = []
        for w in found:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        size = min(self.words, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = _mixed(out * _MIX + h[i : len(h) - size + 1 + i])
        return np.unique(out)

    def half_keys(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), ~np.uint64(0))
        for at in range(0, len(shingles), 4096):
            part = shingles[at : at + 4096]
            least = np.minimum(least, ((part[None, :] * self.factor[:, None] + self.offset[:, None]) ^ (part[None, :] >> np.uint64(29))).min(axis=1))
        keys = self.salt.copy()
        for r in range(self.rows):
            keys = _mixed(keys * _MIX + least[r :: self.rows])
        return keys.astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_SKETCHERS: dict[tuple, Sketcher] = {}


def _sketcher(*settings: int) -> Sketcher:
    if settings not in _SKETCHERS:
        _SKETCHERS[settings] = Sketcher(*settings)
        remember("near-dedup", lambda: [s.memo.clear() for s in _SKETCHERS.values()])
    only("near-dedup")
    return _SKETCHERS[settings]


def _sketch(docs: DataFrame, settings: tuple[int, int, int]) -> DataFrame:
    """(d, th, n, sid, halves) of every row; sid is a 128-bit digest of the set."""

    def run(batches):
        own = _sketcher(*settings)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [own.shingles(t) for t in part.column(2).to_pylist()]
                halves = pa.array([own.half_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
                sids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.binary()), halves]
                yield pa.record_batch(columns, names=["d", "th", "n", "sid", "halves"])

    kind = docs.schema["d"].dataType.simpleString()
    return docs.select("d", "th", "t").mapInArrow(run, f"d {kind}, th bigint, n bigint, sid binary, halves array<bigint>")


class _Classes:
    """The classes of equal sets (cid, d, th, ...), each with a row of ``docs`` that holds it, and the sets of wanted ones."""

    def __init__(self, docs: DataFrame, classes: DataFrame, repeats: DataFrame | None, settings: tuple[int, int, int], percent: int):
        self.docs, self.keys, self.repeats, self.settings, self.percent = docs, classes.select("cid", "d", "th"), repeats, settings, percent

    def sets(self, wanted: DataFrame, tables: Tables, name: str) -> DataFrame:
        """(cid, shingles as bytes) of the wanted classes, once each, as the written table ``name``: documents are read once a step.

        The keys of the wanted are broadcast where these, which are counted, are few.
        """
        settings = self.settings
        ids = tables.write(wanted.select("cid").distinct(), f"{name}-ids")
        told = F.broadcast if ids.count() <= BROADCAST_IDS else lambda df: df
        keys = self.keys.join(told(ids), "cid", "left_semi")
        found = self.docs.join(told(keys), ["d", "th"])
        if self.repeats is not None:  # only texts of repeated ids move, so that a class's row that repeats counts once
            again = found.join(self.repeats, "d", "left_semi").dropDuplicates(["cid"])
            found = found.join(self.repeats, "d", "left_anti").unionByName(again)

        def run(batches):
            own = _sketcher(*settings)
            for batch in batches:
                sets = pa.array([own.shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
                yield pa.record_batch([batch.column(0), sets], names=["cid", "shingles"])

        return tables.write(found.select("cid", "t").mapInArrow(run, "cid bigint, shingles binary"), name)

    def verified(self, pairs: DataFrame, tables: Tables, name: str) -> DataFrame:
        """The pairs (a, b) whose full sets are as similar as asked, 100 |A & B| >= percent |A | B|, as the written table ``name``."""
        percent = self.percent
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")), tables, f"{name}-sets")
        side = lambda name: sets.select(F.col("cid").alias(name), F.col("shingles").alias(f"{name}_set")).hint("merge")

        def run(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        # Merge joins: Spark splits the pairs of a head that thousands of sets have; with a broadcast of pairs, one task would make them all.
        out = tables.write(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a bigint, b bigint"), name)
        tables.drop(f"{name}-sets", f"{name}-sets-ids")
        return out


def _counted(sets: DataFrame) -> DataFrame:
    """(shingle, lo, hi, c): the shingles of ``sets``, with the least and largest class and their number, counted in each task first."""

    def counted(ids: list[int], held: list[np.ndarray]):
        shingles, owners = np.concatenate(held), np.repeat(np.array(ids, np.int64), [len(s) for s in held])
        order = np.lexsort((owners, shingles))
        shingles, owners = shingles[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
        last = np.append(first[1:], len(shingles)) - 1
        return pa.record_batch([pa.array(shingles[first]), pa.array(owners[first]), pa.array(owners[last]), pa.array(last - first + 1)], names=["shingle", "lo", "hi", "c"])

    def run(batches):
        ids, held, size = [], [], 0
        for batch in batches:
            for cid, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(cid)
                held.append(np.frombuffer(x.as_buffer(), np.int64))
                size += len(held[-1])
                if size > COUNTED:
                    yield counted(ids, held)
                    ids, held, size = [], [], 0
        if size:
            yield counted(ids, held)

    return sets.mapInArrow(run, "shingle bigint, lo bigint, hi bigint, c bigint")


def _rarest(sets: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """(cid, shingle): the shingles of each class one of which a linked one must have, ``common`` ones last."""
    last = sets.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common)))

    def run(batches):
        ordered, rank = last.value
        for batch in batches:
            for cid, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = np.frombuffer(x.as_buffer(), np.int64)
                n = len(s)
                if len(ordered) and n:
                    spot = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                    s = s[np.argsort(np.where(ordered[spot] == s, rank[spot] + 1, 0), kind="stable")]
                s = s[: n - -(-n * percent // 100) + 1]
                yield pa.record_batch([pa.array(np.full(len(s), cid)), pa.array(s)], names=["cid", "shingle"])

    return sets.mapInArrow(run, "cid bigint, shingle bigint")


def _sized(percent: int) -> str:
    """Sets of a link differ in size by no more than this."""
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _block_links(own: _Classes, members: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) between members (cid, comp, n) of different components, at least one for any two that have one."""
    percent = own.percent
    rarest = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1  # a link has one of so many of the rarest in common
    ids = members.select("cid", "n")
    sets = own.sets(ids, tables, "sets")
    # A set with as many shingles that no other has is linked with none. Their only holder is known without a join.
    lone = _counted(sets).groupBy("shingle").agg(F.min("lo").alias("cid"), F.max("hi").alias("last")).where("cid = last")
    alone = lone.groupBy("cid").agg(F.count("*").alias("own"))
    left = tables.write(ids.join(alone, "cid", "left").where(F.coalesce("own", F.lit(0)) < rarest).select("cid"), "left")
    members = members.join(left, "cid", "left_semi")
    sets = tables.write(sets.join(left, "cid", "left_semi"), "left-sets")
    tables.drop("sets")
    # Common shingles come last, by how many sets have them; the others in the order of their hashes. Any one order is exact.
    df = _counted(sets).groupBy("shingle").agg(F.sum("c").alias("df")).where(F.col("df") > BLOCK)
    common = df.orderBy(F.desc("df"), "shingle").limit(COMMON_SHINGLES).select("shingle").toArrow()["shingle"].to_numpy()[::-1].astype(np.int64)
    prefix = tables.write(_rarest(sets, common, percent).join(members.select("cid", "comp"), "cid"), "prefixes")
    meet = prefix.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cid").alias("head")).where("lo <> hi")
    # A shingle that many sets have meets its head in several tasks.
    meet = meet.select("shingle", "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = prefix.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
    stars = salted.join(meet, ["shingle", "salt"]).select(F.col("head").alias("a"), F.col("cid").alias("b"))
    groups = components(stars, tables, "groups").select(F.col("node").alias("cid"), F.col("comp").alias("g"))
    # Sizes of linked sets differ by a factor of t at most, so they are in the same or the next class.
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    dealt = groups.join(members.select("cid", "comp", "n"), "cid").withColumn("z", size_class)
    counts = dealt.groupBy("g", "z").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    at = lambda shift, name: counts.select("g", (F.col("z") + shift).alias("z"), F.col("blocks").alias(name))
    dealt = dealt.join(at(0, "own"), ["g", "z"]).join(at(-1, "above"), ["g", "z"], "left").join(at(1, "below"), ["g", "z"], "left")
    block = F.pmod(F.xxhash64("cid"), F.col("own")).cast("int")
    every = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    where = F.concat(
        F.transform(every(F.col("own")), lambda j: F.struct(F.col("z").alias("z"), F.lit(0).alias("up"), F.least(block, j).alias("i"), F.greatest(block, j).alias("j"), (block <= j).alias("left"))),
        F.transform(every(F.col("above")), lambda j: F.struct(F.col("z").alias("z"), F.lit(1).alias("up"), block.alias("i"), j.alias("j"), F.lit(True).alias("left"))),
        F.transform(every(F.col("below")), lambda i: F.struct((F.col("z") - 1).alias("z"), F.lit(1).alias("up"), i.alias("i"), block.alias("j"), F.lit(False).alias("left"))),
    )
    dealt = dealt.select("cid", "comp", "g", F.explode(where).alias("w")).select("cid", "comp", "g", "w.*").join(sets, "cid")
    return dealt.groupBy("g", "z", "up", "i", "j").applyInArrow(lambda t: _multiply(t, percent), "a bigint, b bigint")


def _multiply(table: pa.Table, percent: int) -> pa.Table:
    """One link for any two components that have one between a left and a right set."""
    d, comp = table["cid"].to_numpy(), table["comp"].to_numpy()
    left = np.array(table["left"].to_pylist(), bool)
    right = ~left if table["up"][0].as_py() or table["i"][0].as_py() != table["j"][0].as_py() else left
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].combine_chunks()]
    rows, columns = np.flatnonzero(left), np.flatnonzero(right)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    if len(rows) and len(columns):
        both = np.intersect1d(np.unique(np.concatenate([sets[i] for i in rows])), np.unique(np.concatenate([sets[i] for i in columns])), assume_unique=True)
        shared = np.zeros((len(rows), len(columns)), np.float64)
        for at in range(0, len(both), 8192):
            part = both[at : at + 8192]

            def matrix(of: np.ndarray) -> np.ndarray:
                m = np.zeros((len(of), len(part)), np.float32)
                for r, i in enumerate(of):
                    m[r, np.searchsorted(part, np.intersect1d(sets[i], part, assume_unique=True))] = 1
                return m

            shared += matrix(rows) @ matrix(columns).T
        size = np.array([len(s) for s in sets], np.float64)
        union = size[rows][:, None] + size[columns][None, :] - shared
        linked = (100 * shared >= percent * union) & (comp[rows][:, None] != comp[columns][None, :])
        for r, c in zip(*np.nonzero(linked)):
            x, y = rows[r], columns[c]
            out.setdefault((min(comp[x], comp[y]), max(comp[x], comp[y])), (min(d[x], d[y]), max(d[x], d[y])))
    pairs = list(out.values())
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def near_duplicates(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
    halves: int = 14,
    rows: int = 2,
    bucket: int = 64,
    least_tables: int = 6,
    tables: Tables | None = None,
) -> DataFrame:
    """A row for each row: ``key``, n_shingles, component_id (smallest id reachable), kept."""
    with arrow_batches(docs.sparkSession, 512):
        return _near_duplicates(docs, key, text, words, percent, halves, rows, bucket, least_tables, tables)


def _near_duplicates(docs: DataFrame, key: str, text: str, words: int, percent: int, halves: int, rows: int, bucket: int, least_tables: int, tables: Tables | None) -> DataFrame:
    tables = tables or Tables(docs.sparkSession, "near-dedup")
    settings = (words, halves, rows)
    docs = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    sketches = tables.write(_sketch(docs, settings), "sketches")
    whole = sketches.where("n > 0 AND d IS NOT NULL")
    classes = whole.groupBy("sid").agg(F.min(F.struct("d", "th")).alias("rep"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    # Numbers are given as the table is written, and read from it ever after: a task that runs again commits once.
    classes = tables.write(classes.select(F.monotonically_increasing_id().alias("cid"), "sid", "rep.*", "n", "halves"), "classes")
    repeats = tables.write(whole.groupBy("d").agg(F.count("*").alias("c")).where("c > 1").select("d"), "repeats")
    several = repeats.count()
    told = F.broadcast(repeats) if several <= BROADCAST_IDS else repeats
    own = _Classes(docs, classes, told if several else None, settings, percent)
    half = classes.select("cid", "n", F.posexplode("halves").alias("pos", "h"))
    shared = half.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    hot = half.join(shared, "h", "left_semi").groupBy("cid", "n").agg(F.collect_list(F.struct("pos", "h")).alias("hs"))
    hot = tables.write(hot, "halves")
    first, second = F.filter("hs", lambda x: x["pos"] < halves), F.filter("hs", lambda x: x["pos"] >= halves)

    def keys(diagonal: bool):
        other = lambda a: F.filter(second, lambda b: b["pos"] == a["pos"] + halves) if diagonal else second
        return F.explode(F.flatten(F.transform(first, lambda a: F.transform(other(a), lambda b: F.xxhash64(a["h"], b["h"])))))

    # 0: the sets of one document are connected.
    links = tables.write(_same_document(whole, classes, told) if several else docs.sparkSession.createDataFrame([], "a bigint, b bigint"), "links-0")

    # 1: the tables (i, i), each bucket against its smallest member.
    table = hot.select("cid", "n", keys(True).alias("key"))
    heads = table.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("head"), F.count("*").alias("c")).where("c > 1")
    named = table.join(heads, "key").where("cid <> head.cid").groupBy(F.col("cid").alias("b"), F.col("head.cid").alias("a")).agg(F.count("*").alias("votes"), F.first("n").alias("nb"), F.first("head.n").alias("na"))
    named = tables.write(named.where(_sized(percent)), "named")
    best = named.groupBy("b").agg(F.max(F.struct("votes", (-F.col("a")).alias("a")))["a"].alias("a")).select((-F.col("a")).alias("a"), "b")
    best = tables.write(best, "best")
    links = links.unionByName(own.verified(best, tables, "links-1"))
    comps = components(links, tables, "components-1")

    apart = labelled(named.select("a", "b"), comps).where("ca <> cb").select("a", "b").join(best, ["a", "b"], "left_anti")
    more = own.verified(tables.write(apart, "apart"), tables, "links-2")
    comps = components(more, tables, "components-2", comps)

    # 2: all tables; only where components meet.
    located = hot.join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    # Members of a component meet, so that their keys are counted before they move; of a large one they are split over tasks.
    located = tables.write(located.hint("rebalance", F.col("comp")), "located")
    wide = located.select("cid", "n", "comp", keys(False).alias("key"))
    meet = wide.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("key", "c")
    members = tables.write(wide.join(meet, "key"), "members")
    few = members.where(F.col("c") <= bucket)
    side = lambda x: few.select("key", F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}"))
    pairs = side("a").join(side("b"), "key").where(f"ca < cb AND {_sized(percent)}").groupBy("a", "b").agg(F.count("*").alias("c"))
    # A set with a link to another component meets its partner in so many of these buckets, large or small.
    met = members.groupBy("cid", "n", "comp").agg(F.count("*").alias("met"), F.max("c").alias("largest"))
    large = met.where((F.col("largest") > bucket) & (F.col("met") >= least_tables)).select("cid", "n", "comp")
    # A pair may share tables of both kinds: where both sets are in large buckets, step 3 compares them.
    large = tables.write(large, "large")
    pairs = pairs.where(F.col("c") >= least_tables).select("a", "b")
    candidates = tables.write(pairs.join(named.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
    links = own.verified(candidates, tables, "links-3")
    if not large.isEmpty():
        links = links.unionByName(tables.write(_block_links(own, large, tables), "links-4"))
    comps = components(links, tables, "components-3", comps)
    # Classes are numbered in no order of ids: a component is named by its smallest document.
    sized = comps.join(classes.select(F.col("cid").alias("node"), "d"), "node")
    names = sized.groupBy("comp").agg(F.min("d").alias("low"))
    named_classes = sized.join(names, "comp").select(F.col("node").alias("cid"), "low")
    told = classes.select("cid", "sid", F.col("d").alias("least")).join(named_classes, "cid", "left").select("sid", F.coalesce("low", "least").alias("component"))
    told = tables.write(told, "told")
    tables.keep("sketches", "told")

    # Equal sets may be a third of all rows: their class is met by Spark's skew-aware join. Empty ones meet nothing.
    answer = sketches.where("n > 0").select("d", "n", "sid").join(told, "sid", "left").select("d", "n", "component")
    answer = answer.unionByName(sketches.where("n = 0").select("d", "n", F.col("d").alias("component")))
    component = F.when(F.col("d").isNotNull(), F.coalesce("component", "d"))
    return answer.select(F.col("d").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("d") == component, F.lit(True)).alias("kept"))


def _same_document(whole: DataFrame, classes: DataFrame, repeats: DataFrame) -> DataFrame:
    """Links (a, b) that connect all classes of every repeated doc_id."""
    held = whole.join(repeats, "d", "left_semi").select("d", "sid").distinct().join(classes.select("sid", "cid"), "sid")
    return held.join(held.groupBy("d").agg(F.min("cid").alias("a")), "d").where("a <> cid").select("a", F.col("cid").alias("b"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` with the document of the smallest id of each component alone."""
    tables = Tables(docs.sparkSession, "near-dedup")
    found = tables.write(near_duplicates(docs, key=key, text=text, tables=tables, **settings), "found")
    return without(docs, found.where("NOT kept"), key)
