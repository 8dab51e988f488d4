"""Operators over a whole corpus against brute force, with hot groups and odd rows."""

import random
import re
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmur.llm import decontaminate, near_dedup, registry, span_dedup
from murmur.llm.common import Tables
from murmur.llm.graph import components

SCHEMA = "doc_id bigint, text string, d string, n int, comp string"


def frame(spark, texts):
    rows = [(i, t, "noise", 1, "x") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(r, n):
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def prose(r, n=12):
    return " ".join(sentence(r, r.randrange(4, 14)) for _ in range(n))


def edited(r, text, edits):
    words = text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def exact_components(texts, words):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = set() if not w else {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}, sets


@pytest.mark.parametrize("bucket", [64, 3])
def test_near_duplicates_equal_all_pairs(spark, bucket):
    r = random.Random(7)
    base, line = prose(r, 20), sentence(r, 30)
    texts = {i: edited(r, base, r.randrange(0, 22)) for i in range(90)}
    texts |= {100 + i: line + " " + prose(r, 3) for i in range(80)}
    texts |= {200 + i: prose(r, 6) for i in range(20)}
    texts |= {300: None, 301: "", 302: "a b", 303: "A  B", 304: "a", 305: "word " * 5000, 306: texts[200] + " tail"}
    expected, sets = exact_components(texts, 4)
    got = near_dedup.near_duplicates(frame(spark, texts), words=4, bucket=bucket).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row.component_id == expected[row.doc_id] and row.n_shingles == len(sets[row.doc_id]) and row.kept == (row.doc_id == row.component_id)
    kept = near_dedup.one_of_each(frame(spark, texts), words=4)
    assert {x.doc_id for x in kept.collect()} == set(expected.values()) and kept.columns == ["doc_id", "text", "d", "n", "comp"]


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert near_dedup.near_duplicates(frame(spark, ["x"]).limit(0)).count() == 0
    twice = frame(spark, ["one two three four five six"]).union(frame(spark, ["one two three four five six"]))
    assert [(r.component_id, r.kept) for r in near_dedup.near_duplicates(twice).collect()] == [(0, True)] * 2


def test_a_repeated_id_keeps_all_its_links(spark):
    r = random.Random(12)
    a, c = prose(r, 12), prose(r, 12)
    rows = [(1, a), (1, c), (2, c + " word"), (3, a + " word"), (4, prose(r, 12)), (None, a), (1, None), (4, None)]
    for kind, as_id in (("bigint", int), ("string", lambda i: f"doc-{i}")):
        df = spark.createDataFrame([(i if i is None else as_id(i), t, "x") for i, t in rows], f"doc_id {kind}, text string, sid string")
        got = [(x.doc_id, x.component_id, x.kept) for x in near_dedup.near_duplicates(df, words=4).collect() if x.n_shingles]
        one = as_id(1)
        assert sorted(got, key=str) == sorted([(one, one, True)] * 2 + [(as_id(2), one, False), (as_id(3), one, False), (as_id(4), as_id(4), True), (None, None, True)], key=str)
    assert near_dedup.one_of_each(df, words=4).count() == 6


def test_ids_of_any_type(spark):
    from murmur.llm import html_extract, pii, sentencepiece_codec

    r = random.Random(13)
    item = prose(r, 6)
    df = spark.createDataFrame([(f"d{i}", t, t) for i, t in enumerate([item + " " + prose(r), item, prose(r), None, item])], "doc_id string, text string, url string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(df, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()} == {("d0", "i"), ("d1", "i"), ("d4", "i")}
    assert {x.doc_id for x in span_dedup.remove_repeats(df).collect()} == {"d1", "d4"}
    ids = {f"d{i}" for i in range(5)}
    assert {x.doc_id for x in sentencepiece_codec.encode_decode(df, registry.PIECE_MODEL).collect()} == ids
    assert {x.doc_id for x in html_extract.extract_pages(df, key="doc_id", html="text").collect()} == ids
    assert {x.doc_id for x in pii.scan(df).collect()} == ids


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    r = random.Random(1)
    r.shuffle(links)
    out = {x.node: x.comp for x in components(spark.createDataFrame(links, "a bigint, b bigint"), Tables(spark, "test"), "c").collect()}
    assert all(out[i] == 0 for i in range(301)) and all(out[i] == 1000 for i in range(1000, 1200)) and len(out) == 501


def test_components_of_earlier_and_new_links(spark):
    r, tables = random.Random(3), Tables(spark, "test")
    frame_of = lambda links: spark.createDataFrame(links, "a bigint, b bigint")
    parts = [[(r.randrange(400), r.randrange(400)) for _ in range(n)] for n in (120, 0, 90, 60)]
    parts[2] += [(7, 7), parts[0][0], (900, 901)]
    known, links = None, []
    for turn, part in enumerate(parts):
        known, links = components(frame_of(part), tables, f"c{turn}", known), links + part
        root = {x: x for link in links if link[0] != link[1] for x in link}
        for _ in root:  # the smaller label goes along the links until none changes
            before = dict(root)
            for a, b in links:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
            if before == root:
                break
        assert sorted((x.node, x.comp) for x in known.collect()) == sorted(root.items())


def test_reordered_and_scattered_benchmark_items_are_caught(spark):
    r = random.Random(2)
    items = [" ".join(sentence(r, 8) for _ in range(5)) for _ in range(6)] + [None, "", "two words"]
    parts = items[0].split(". ")
    texts = [
        prose(r) + " " + items[0] + " " + prose(r),
        prose(r) + " " + ". ".join(reversed(parts)).upper() + ". " + prose(r),
        " ".join(x for p in items[1].split(". ") for x in (prose(r, 1), p + ".")),
        prose(r) + " " + items[2].split(". ")[0],
        prose(r, 200),
        None, "", "two words",
        items[3] + " " + items[4],
    ]
    bench = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(items)], "item_id bigint, text string, coverage double")
    docs = frame(spark, texts)
    got = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1), (8, 3), (8, 4)}
    assert got[0, 0].n_tiles == 1 and got[0, 0].coverage == 1 and got[1, 0].n_tiles > 1
    kept = decontaminate.clean(docs, bench)
    assert {x.doc_id for x in kept.collect()} == {3, 4, 5, 6, 7} and kept.columns == docs.columns
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def greedy(text, item, k):
    """Plain greedy tiling: the longest match of unmarked words, again and again."""
    mt, mi, total = [False] * len(text), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while t + n < len(text) and i + n < len(item) and not mt[t + n] and not mi[i + n] and text[t + n] == item[i + n]:
                    n += 1
                best = max(best, (n, -t, -i))
        n, t, i = best[0], -best[1], -best[2]
        if n < k:
            return total
        mt[t : t + n] = mi[i : i + n] = [True] * n
        total += n


def test_tiling_covers_as_much_as_plain_greedy_tiling():
    r = random.Random(9)
    for _ in range(150):
        text, item = ([r.randrange(4) for _ in range(r.randrange(0, 40))] for _ in range(2))
        found = decontaminate.tiles(text, item, 3)
        assert len({p for t, _, n in found for p in range(t, t + n)}) == sum(n for _, _, n in found)
        assert all(text[t : t + n] == item[i : i + n] and n >= 3 for t, i, n in found)
        longest = max((n for _, _, n in found), default=0)
        assert longest == max((n for t in range(len(text)) for i in range(len(item)) for n in [next((m for m in range(50) if t + m >= len(text) or i + m >= len(item) or text[t + m] != item[i + m]), 0)] if n >= 3), default=0)
        assert abs(sum(n for _, _, n in found) - greedy(text, item, 3)) <= 3


def test_pairs_meet_on_rare_grams_alone(spark):
    """A phrase in all documents and all items brings none of them together, and no pair that passes is lost."""
    r = random.Random(14)
    hot = "the most common of all phrases"
    items = [hot + " " + " ".join(sentence(r, 6) for _ in range(4)) for _ in range(30)]
    texts = [hot + " " + prose(r, 4) for _ in range(200)]
    for i in range(30):
        parts = items[i].split(". ")
        r.shuffle(parts)
        texts.append(prose(r, 2) + " " + ". ".join(parts) + " " + prose(r, 2))
        texts.append(" ".join(items[i].split()[:10]) + " " + prose(r, 2))
    tables = Tables(spark, "test")
    docs, bench = frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.coverage for x in decontaminate.contaminated(docs, bench, tables=tables).collect()}
    expected = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            a, b = ([w.lower() for w in re.findall(r"[^\W_]+", x)] for x in (t, item))
            if len({tuple(a[j : j + 3]) for j in range(len(a) - 2)} & {tuple(b[j : j + 3]) for j in range(len(b) - 2)}) * 3 >= 0.6 * len(b):
                share = greedy(a, b, 3) / len(b)
                if share >= 0.6:
                    expected[d, i] = share
    assert set(got) == set(expected) and len(got) == 30
    near = spark.read.parquet(tables.path("near"))
    assert near.count() < 200


def test_long_repetitive_texts_and_repeated_rows_are_tiled(spark):
    import time

    item = " ".join(["alpha beta gamma"] * 10) + " delta"
    texts = ["alpha beta gamma " * 20_000, "alpha beta gamma delta " * 5_000, "word " * 50_000, item, item]
    docs = frame(spark, texts).unionByName(frame(spark, texts))
    bench = spark.createDataFrame([(0, item, 1), (0, item, 1), (1, "word " * 40, 1)], "item_id bigint, text string, d int")
    began = time.time()
    got = sorted((x.doc_id, x.item_id, x.coverage) for x in decontaminate.contaminated(docs, bench).collect())
    assert [x[:2] for x in got] == [(0, 0), (1, 0), (2, 1), (3, 0), (4, 0)] and got[3][2] == 1 and got[2][2] == 1
    assert time.time() - began < 120 and decontaminate.clean(docs, bench).count() == 0


def test_repeated_spans_by_brute_force(spark):
    r = random.Random(4)
    passage = prose(r, 8)
    flat = " ".join(sentence(r, 60).split()).rstrip(".")
    texts = [prose(r) for _ in range(12)] + [prose(r, 4) + "\n" + passage + "\n" + prose(r, 4) for _ in range(30)]
    texts += [prose(r, 2) + " " + flat + " " + prose(r, 2) for _ in range(4)] + ["Er. " * 400, "Er. " * 3, None, "", "no marks here", texts[0], "x" * 30_000]
    docs = frame(spark, texts)
    runs = defaultdict(list)
    for d, t in enumerate(texts):
        for at, n, h in span_dedup.runs_of(t, 3, 25):
            runs[h].append((d, at, n))
    gone = defaultdict(set)
    for places in runs.values():
        for d, at, n in sorted(places)[1:]:
            gone[d].update(range(at, at + n))
    got = {x.doc_id: x for x in span_dedup.remove_repeats(docs).collect()}
    assert set(got) == set(gone)
    for d, row in got.items():
        cuts = span_dedup.sentences_of(texts[d])
        assert "".join(texts[d][a:b] for a, b, _ in cuts) == texts[d]
        assert row.n_removed == len(gone[d]) and row.n_sentences == len(cuts)
        assert row.text == "".join(texts[d][a:b] for i, (a, b, _) in enumerate(cuts) if i not in gone[d])
    held = [d for d, t in enumerate(texts) if passage in (got[d].text if d in got else t or "")]
    assert held == [12] and all(d not in got for d in range(12))
    assert sum(flat in (got[d].text if d in got else texts[d]) for d in range(42, 46)) == 1
    assert span_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_runs_move_as_hash_and_document_only(spark):
    from murmur.llm.common import Tables

    r = random.Random(14)
    twice, passage, other = " ".join(sentence(r, 60).split()), prose(r, 8), prose(r, 12)
    rows = [(1, passage), (2, passage + " " + other), (2, other), (2, twice + " and " + twice), (2, None), (None, passage), (None, twice + " or " + twice), (3, twice)]
    tables = Tables(spark, "span-columns")
    got = span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), tables=tables).collect()
    # Before, a run's row also held its text's hash, place and length: 2.34 GB of disk over 0.51 GB of documents.
    assert spark.read.parquet(tables.path("runs")).columns == ["d", "h"]
    assert sorted((x.doc_id is None, x.doc_id, x.n_removed > 0, passage in x.text, other in x.text, x.text.count(twice[100:200])) for x in got) == [
        (False, 2, True, False, False, 1), (False, 2, True, False, True, 0), (False, 3, True, False, False, 0), (True, None, True, False, False, 1)]


def test_any_fifty_common_words_hold_a_run():
    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 5)))
    hashes = lambda text: {h for _, _, h in span_dedup.runs_of(text, 3, 25)}
    for _ in range(1500):
        passage = [word() for _ in range(50)]
        for at in r.choice([[], [11, 25, 39], [24]]):  # sentence marks: none, or sentences of up to 16 words with their hosts
            passage[at] += "."
        texts = [" ".join([word() for _ in range(r.randrange(30))] + passage + [word() for _ in range(r.randrange(30))]) for _ in range(2)]
        assert hashes(texts[0]) & hashes(texts[1])
    for _ in range(100):
        passage = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(50))
        texts = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(20)) + passage + "。" + chr(r.randrange(0x4E00, 0x9FA5)) * 9 for _ in range(2)]
        assert hashes(texts[0]) & hashes(texts[1])


@pytest.fixture(scope="module")
def planted(spark, sf, tmp_path_factory):
    """A folder of tables on which every method decides something."""
    from murmur.llm import license_scan

    r = random.Random(21)
    rows = [(i, prose(r, 5), "en", "s", 1) for i in range(1250)]
    rows += [(1500 + i, prose(r, 5) + " " + " ".join(f"b{i}z{j}###$$" for j in range(40)), "en", "s", 0) for i in range(60)]
    rows += [(2000 + i, f"{prose(r, 3)} zorblatt {sentence(r, 2)} write to jo.doe@mail.org or {sentence(r, 4)}", "en", "s", 1) for i in range(8)]
    rows += [(2100, "Zorblatt was seen again. " + prose(r, 3), "en", "s", 1), (2101, "call +1 (784) 555-8120 or 4111 1111 1111 1111 from 10.0.0.256 and 10.0.0.25, password=abcdefgh12345678 " + prose(r, 3), None, "s", 1)]
    for i, t in enumerate(license_scan.TEXTS):
        words = t.text.split()
        rows += [(3000 + 2 * i, prose(r, 2) + " " + " ".join(w for j, w in enumerate(words) if j % 23 != 7), "en", "s", 1), (3001 + 2 * i, " ".join(words[len(words) // 2 :] + words[: len(words) // 3]), "en", "s", 1)]
    rows += [(4000, None, None, None, 1), (4001, "", "en", "s", 1), (4002, rows[0][1], "en", "s", 1), (4003, rows[0][1] + " tail", "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("planted"))
    table = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "quality"])
    table.assign(n_chars=table.text.fillna("").str.len())[["doc_id", "text", "lang", "source", "n_chars"]].to_parquet(f"{path}/documents.parquet")
    table.assign(toxic=0)[["doc_id", "quality", "toxic"]].to_parquet(f"{path}/labels.parquet")
    urls = ["http://ads2.site.io/", "http://x.io/wp-admin/", "http://x.io/cgi-bin/a", "http://a.example.net/en/x", "http://x.org/fr/", "http://x.org/a.ZIP", None, "none"]
    pd.DataFrame([(i, u, "<p>x") for i, u in enumerate(urls)], columns=["page_id", "url", "html"]).to_parquet(f"{path}/pages.parquet")
    for t in ("conversations", "benchmark"):
        pd.read_parquet(f"{sf}/{t}.parquet").to_parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles_where_every_method_decides(spark, planted, name):
    test_oracles(spark, planted, name)


def test_switching_a_method_off_changes_its_results(spark, planted):
    from murmur.llm import license_scan, pii

    kept = registry.op10_quality_rules(spark, planted)
    assert kept.where("kept = base_failed").count() >= 50
    spans = registry.op8_pii(spark, planted)
    assert spans.where("spans LIKE '%term:%'").count() >= 9
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    assert pii.scan(docs, generalise=99.0).where("spans LIKE '%term:%'").count() == 0
    found = registry.op5_license_scan(spark, planted)
    assert found.where("score > 0 AND score < 1").count() > 10 and found.where("labels <> base_labels").count() > 10
    assert found.where("labels <> ''").count() > license_scan.scan(docs, texts=()).where("labels <> ''").count()
    verdicts = {r.page_id: (r.rule, r.verdict) for r in registry.op6_url_rules(spark, planted).collect()}
    assert [verdicts[i][1] for i in range(8)] == ["block"] * 3 + ["allow", "allow", "block", "allow", "allow"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, expected = registry.QUERIES[name](spark, sf).toPandas(), con.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    plain = lambda df: sorted(tuple("" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in df[columns].itertuples(index=False))
    assert plain(got) == plain(expected)


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, seen = docs, [set(r.doc_id for r in docs.select("doc_id").collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf).cache()
        assert at.columns == docs.columns
        seen.append({r.doc_id for r in at.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:])) and seen[3] == seen[4]
    rejected = {r.doc_id for r in registry.op10_quality_rules(spark, sf).where("NOT kept").collect()}
    assert seen[1] == seen[0] - rejected
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in seen[1]}
    expected, _ = exact_components(texts, corpus_pipeline.SHINGLE_WORDS)
    assert seen[2] == {k for k, v in expected.items() if k == v}
    after = {r.doc_id: r for r in at.collect()}
    assert all(len(r.text or "") == r.n_chars for r in after.values())
    assert not any(re.search(r"[A-Za-z0-9]@[a-z0-9]+\.[a-z]", r.text or "") for r in after.values())
    last = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in last.select("doc_id").collect()} == seen[4]
    assert last.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_stages_on_every_case(spark, sf):
    """Empty tables, nulls in any column, very long texts, repeated rows and clashing columns through all five stages."""
    import corpus_pipeline

    r = random.Random(5)
    long, plain = " ".join(sentence(r, 12) for _ in range(3000)), prose(r, 12)
    rows = [(1, plain, "en", "s", 7), (1, plain, "en", "s", 7), (2, None, None, None, None), (3, "", "en", "s", 0), (4, long, "en", "s", 1), (None, prose(r), "en", "s", 1), (5, plain + " end", None, "s", 1), (6, "x" * 300_000, "en", "s", 1), (7, "mail a@b.org now " + prose(r), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit("mine") for c in ("d", "th", "n", "kept", "comp", "_row", "_key", "spans", "row", "item", "n_words", "terms")})
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == corpus_pipeline.COLUMNS
    out = sorted((x.doc_id or 0, len(x.text)) for x in at.collect())
    assert [d for d, _ in out] == [0, 1, 1, 4, 7] and out[3][1] == len(long)
    last = corpus_pipeline.encoding(spark, at, sf)
    assert last.count() == 5 and {"doc_id", "n_tokens", "ids", "decoded"} == set(last.columns)
    assert not any("a@b.org" in x.decoded for x in last.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_rows_without_an_id_crash_nothing(spark):
    import corpus_pipeline

    r = random.Random(3)
    text = prose(r, 10)
    docs = spark.createDataFrame([(None, text, None, None, None), (1, text, "en", "s", 5), (None, None, "en", "s", 0), (2, prose(r), None, "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars int")
    bench = spark.createDataFrame([(0, text)], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()} == {(1, 0)}
    assert near_dedup.near_duplicates(docs).count() == 4 and span_dedup.remove_repeats(docs).count() <= 2
    assert corpus_pipeline.personal_data(spark, docs, "").count() == 4 and corpus_pipeline.encoding(spark, docs, "").count() == 4
