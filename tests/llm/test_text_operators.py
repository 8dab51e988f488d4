"""Operators on single texts against libraries, brute force and their own round trips."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from murmur.llm import chat_format, html_extract, license_scan, pii, quality_rules, registry, url_rules
from murmur.llm.sentencepiece_codec import MARK, Codec, PieceModel, codec, encode_decode

LONG = "word " * 30_000
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark, texts, extra=True):
    rows = [(i, t, "en", "noise", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, d string, kept int")
    return df if extra else df.select("doc_id", "text", "lang")


def everything(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns with the operators' own names."""
    return documents(spark, [None, "", " ", LONG, "a b c", "a b c", "x" * 20_000, "\n\n", "é😀\x00 ▁"])


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    with open(MODEL, "rb") as file:
        return codec(file.read())


def test_encoding_equals_the_library(library, own):
    r = random.Random(4)
    bits = ["a", "b", "the", "ing", " ", "  ", "\n", MARK, "é", "😀", "\x00", "<s>", "<0x0A>", "丝", "1", ".", "\t", "ll", "e", "n", "t", "в", "ﷺ", "\u200b"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 25))) for _ in range(3000)] + ["", "aaaa" * 5000, " " * 3000]
    for t in texts:
        expected = library.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == expected
        assert own.encode_decode(t)[1] == own.decode(expected) == library.decode(expected)


def test_decoding_any_ids_equals_the_library(library, own):
    r = random.Random(5)
    for _ in range(1500):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randrange(10))]
        assert own.decode(ids) == library.decode(ids)


def test_stepping_back_is_needed_and_exact(own):
    """Some chunk's longest matches don't hold, and backtracking gives what merging gives."""
    stepped = 0
    for word in ("thonbletion", "unstoppableing", "ааестрия", "xxxxyz", "intionerthe"):
        chunk = MARK + word
        pieces = own.merge(chunk)
        expected = [i for p in pieces for i in ([own.ids[p]] if p in own.ids else [own.byte_ids[b] for b in p.encode()])]
        assert own._backtrack(chunk) == own.encode_chunk(chunk) == expected
        first = [p for _, p in own.automaton.iter_long(chunk)]
        stepped += first != pieces
    assert stepped


def test_codec_operator_on_every_case(spark, library):
    df = everything(spark)
    out = {r.doc_id: r for r in encode_decode(df, MODEL).collect()}
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    assert len(out) == 9
    for k, t in texts.items():
        assert out[k].ids == library.encode(t, add_bos=True, add_eos=True) and out[k].n_tokens == len(out[k].ids)
        assert out[k].decoded == library.decode(out[k].ids)
    digests = {r.doc_id: r for r in encode_decode(df, MODEL, digests=True).collect()}
    packed = b"".join(i.to_bytes(4, "little") for i in out[4].ids)
    assert digests[4].ids_sha256 == hashlib.sha256(packed).hexdigest()
    assert encode_decode(df.limit(0), MODEL).count() == 0


def test_memory_of_unspaced_texts_is_bounded(own, library):
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzéüß"
    before = sum(map(len, (own.chunks, own.words)))
    for i in range(300):
        text = "".join(r.choice(letters) for _ in range(1500))
        assert i > 20 or own.encode(text) == library.encode(text, add_bos=True, add_eos=True)
        own.encode_decode(text)
    assert sum(map(len, (own.chunks, own.words))) == before
    for memo in (own.compatible, own.chunks, own.words):
        for i in range(3000):
            memo.limit, kept = 100_000, memo.limit
            assert memo[("th", f"e{i}") if memo is own.compatible else f"word{i}"] is not None
            assert memo.used <= 101_000
            memo.limit = kept
    long = "".join(r.choice("abet") for _ in range(3 * 4096 + 5))
    assert own.encode(long) == library.encode(long, add_bos=True, add_eos=True)


class Counting:
    """An automaton that counts what it is asked for; with ``short``, its matches of a whole chunk aren't the longest."""

    def __init__(self, automaton, short=False):
        self.automaton, self.short, self.n = automaton, short, 0

    def iter(self, *chunk):
        for found in self.automaton.iter(*chunk):
            self.n += 1
            yield found

    def iter_long(self, chunk):
        for found in [(i, c) for i, c in enumerate(chunk) if c in self.automaton] if self.short else self.automaton.iter_long(chunk):
            self.n += 1
            yield found

    def longest_prefix(self, ahead):
        self.n += 1
        return self.automaton.longest_prefix(ahead)


def test_stepping_back_costs_the_places_that_it_reaches(library):
    """A chunk's encoding asks for few matches more than it has ids, and a table has room for a task's words."""
    with open(MODEL, "rb") as file:
        own = Codec(PieceModel.parse(file.read()))
    r = random.Random(7)
    bits = ["th", "on", "ble", "tion", "er", "ing", "en", "an", "sh", "ou", "and", "ea", "st", "è", "ai", "eaux", "ción", "ll"]
    words = list(dict.fromkeys("".join(r.choice(bits) for _ in range(r.randrange(2, 7))) for _ in range(4000)))[:3000]
    own.automaton = Counting(own.automaton)
    expected = [library.encode(w) for w in words]
    assert len(words) == 3000 and [own.encode_chunk(MARK + w) for w in words] == expected
    assert own.automaton.n < 3 * sum(map(len, expected))
    own.words.limit = 1_000_000
    own.encode_decode(" ".join(words))
    assert len(own.words) == 3000 and own.words.used <= own.words.limit


def test_steps_are_exact_from_any_first_walk_and_when_tables_are_emptied(library):
    with open(MODEL, "rb") as file:
        own = Codec(PieceModel.parse(file.read()))
    r = random.Random(8)
    words = ["".join(r.choice(["th", "on", "ble", "er", "ing", "è", "ai", "x", "1", "\n", "😀", "丝"]) for _ in range(r.randrange(1, 9))) for _ in range(1500)]
    expected = [library.encode(w) for w in words]
    own.automaton = Counting(own.automaton, short=True)
    assert [own.encode_chunk(MARK + w) for w in words] == expected
    own.compatible.forget()
    own.automaton.short, own.compatible.limit = False, 3000
    assert [own.encode_chunk(MARK + w) for w in words] == expected == [own._backtrack(MARK + w) for w in words]
    assert own.compatible.used <= 3000 and own.encode_chunk("") == own._backtrack("") == []


def test_models_that_the_method_cannot_encode_are_refused():
    with pytest.raises(ValueError):
        PieceModel.parse(b"")
    with open(MODEL, "rb") as file:
        data = file.read()
    assert len(Codec(PieceModel.parse(data)).ids) > 30_000


PAGES = {
    "plain": ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; tail</h1><p>First  one,\n with <b>bold</b>word.<p>Second<br>line</article><footer>f</footer></body>", "Head & tail\nFirst one, with boldword.\nSecond line"),
    "cut": ("<body><article><h1>Tit", "Tit"),
    "cut in a tag": ("<body><article><p>Text here.</p><p cla", "Text here."),
    "tiny article": ('<body><div class="ad">A long advert that has much more text than the article, yes.</div><article><h1>Be.</h1></article><footer>Long footer text, all rights reserved.</footer>', "Be."),
    "comments": ('<main><article class="post"><header><h1><a href=x>Title</a></h1></header><p>Body, of it.</p><div class="share">Share</div></article><section id="comments"><article class="comment"><p>hi there, nice.</p></article></section></main>', "Title\nBody, of it."),
    "divs": ('<body><div id="top"><ul class="main-menu"><li><a href=/>Home</a></ul></div><div class="content"><h2>A title here</h2><p>First para, long enough to count as text. It goes on.</p><p>Short.</p></div><div class="sidebar"><p>Side, bar.</p></div><form><label>Mail</label></form><p><a href=1>Link one</a></p></body>', "A title here\nFirst para, long enough to count as text. It goes on.\nShort."),
    "script": ('<article><script>var t="</p><p>no";</script><p>x &lt;y&gt; <!-- <p>gone</p> --> z</p></article>', "x <y> z"),
    "wrapper": ('<body><div class="page-with-sidebar"><p>The whole text is in a wrapper, whose class misleads. It stays.</p></div></body>', "The whole text is in a wrapper, whose class misleads. It stays."),
    "none": (None, ""),
    "empty": ("", ""),
    "noise": ("<<<>>< a. b <c", "<<<>>< a. b"),
    "only boilerplate": ("<nav><p>Home, away. And more of it.</p></nav><footer>All rights kept. All of them, always.</footer><aside>Side, by side.</aside>", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text(name):
    html, expected = PAGES[name]
    assert html_extract.extract(html) == expected


def test_the_ratios_decide():
    """Without the thresholds everything comes through, and without what the page says of its parts the ratios still find the text."""
    words = lambda n, at: " ".join(f"word{at + i}" + (",." [i % 2] if i % 7 == 6 else "") for i in range(n))
    body = "".join(f"<p>{words(60, 100 * i)}</p>" for i in range(6))
    page = f'<body><div class="x1"><span>Home</span></div><div class="x2">Mail us now</div><div class="story">{body}</div><div class="x3">All rights kept</div></body>'
    expected = "\n".join(words(60, 100 * i) for i in range(6))
    assert html_extract.extract(page) == expected
    assert html_extract.extract(page, share=0, least=0).count("\n") == 8
    marked = page.replace('class="x3"', 'class="footer"').replace("All rights kept", words(60, 900))
    assert html_extract.extract(marked) == expected and html_extract.extract(marked, soft=1, hard=1) != expected


def naive_text(html):
    """The same definitions without bounds: every element and attribute by the library's parser, all pairs of paths, plain edit distance."""
    from html.parser import HTMLParser

    H = html_extract
    blocks, stack = [], [dict(tag="", path=(), mark=0, inside=False, parent=None, size=0, holds=False)]
    nodes, state = list(stack), dict(buffer="", linked=0, raw="")

    def flush():
        text = " ".join(state["buffer"].split())
        if text:
            at = next(n for n in reversed(stack) if n["tag"] not in H._INLINE)
            blocks.append((at, text, min(state["linked"], len(text))))
        state.update(buffer="", linked=0)

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            attrs = {k: v or "" for k, v in attrs}
            if tag in H._RAW:
                state["raw"] = tag
                return
            if tag == "br":
                state["buffer"] += " "
            if tag in ("br", "wbr", "img"):
                return
            if tag not in H._INLINE:
                flush()
                closing = H._SIBLINGS.get(tag, ()) or ({"p"} if tag in H._CLOSES_P else ())
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at]["tag"] in closing or stack[at]["tag"] == "p" and tag in H._CLOSES_P:
                        del stack[at:]
                        if tag not in ("tr", "tbody"):
                            break
                    elif stack[at]["tag"] in H._SCOPE:
                        break
            if tag in H._VOID:
                return
            words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", attrs.get("class", "") + " " + attrs.get("id", ""))}
            root = tag in ("article", "main") or attrs.get("role") in ("main", "article")
            within = any(n["root"] for n in stack[1:])
            mark = 2 if stack[-1]["mark"] == 2 or tag in H._BOILER_TAGS or attrs.get("role") in H._BOILER_ROLES or "hidden" in attrs or tag == "header" and not within else 0
            if not mark and words & H._BOILER_WORDS and tag not in ("html", "body"):
                mark = 2 if root and words & {"comment", "comments", "reply"} else 1
            label = tag + "".join("." + c for c in sorted(attrs.get("class", "").split())[:3])
            node = dict(tag=tag, path=stack[-1]["path"] + ((label,) if tag not in H._INLINE else ()), mark=mark, root=root and mark < 2, parent=stack[-1], size=0, holds=False)
            stack.append(node)
            nodes.append(node)

        def handle_endtag(self, tag):
            if tag in H._RAW:
                state["raw"] = ""
                return
            if tag not in H._INLINE:
                flush()
            for at in range(len(stack) - 1, 0, -1):
                if stack[at]["tag"] == tag:
                    del stack[at:]
                    return
                if tag in H._INLINE and stack[at]["tag"] not in H._INLINE:
                    return

        def handle_data(self, data):
            if not state["raw"]:
                state["buffer"] += data
                state["linked"] += len(data.strip()) if any(n["tag"] == "a" for n in stack) else 0

    stack[0]["root"] = False
    parser = Parser(convert_charrefs=True)
    parser.feed(html)
    parser.close()
    flush()
    for at, text, linked in blocks:
        while at:
            at["size"] += len(text) - linked
            at = at["parent"]
    for n in reversed(nodes):
        n["holds"] |= n["root"]
        if n["parent"]:
            n["parent"]["holds"] |= n["holds"]
    for n in nodes[1:]:
        wrapper = n["mark"] == 1 and (n["holds"] or 2 * n["size"] > nodes[0]["size"])
        n["final"] = max(n["parent"].get("final", 0), 0 if wrapper else n["mark"])
        n["in"] = n["parent"].get("in", False) or n["root"]

    def edit(a, b):
        table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return table[len(a), len(b)]

    from math import exp, log1p, sqrt

    by = {}
    for at, text, linked in blocks:
        by.setdefault((at.get("final", 0), at.get("in", False), at["path"]), []).append((text, linked))
    raw = {p: log1p(sum(len(t) for t, _ in own) / len(own)) * (1 + log1p(sum(len(re.findall("[.,;:!?…。，！？]", t)) for t, _ in own) / len(own))) for p, own in by.items()}
    bounded, ratio = any(p[:2] == (0, True) for p in by), {}
    for p, own in by.items():
        group = [q for q in by if q[:2] == p[:2]]
        here = group.index(p)
        near = {q: edit(p[2], q[2]) for q in group[max(here - 8, 0) : here + 9]}
        w = {q: exp(-d * d / 2) if d < 4 else 0 for q, d in near.items()}
        links = 0 if p[2] and re.match("h[1-6]", p[2][-1]) else sum(n for _, n in own) / sum(len(t) for t, _ in own)
        ratio[p] = sqrt(raw[p] * sum(w[q] * raw[q] for q in w) / sum(w.values())) * (1 - links) * (0.001 if p[0] else 1) * (0.02 if bounded and not p[1] else 1)
    best = max(ratio.values(), default=0)
    keep = {p for p, r in ratio.items() if r >= max((0.02 if p[1] else 0.2) * best, 0.05)}
    return "\n".join(text for at, text, _ in blocks if (at.get("final", 0), at.get("in", False), at["path"]) in keep)


def test_pages_equal_a_plain_parser_and_all_pairs_of_paths(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    got = {r.page_id: r for r in registry.op1_html_extract(spark, sf.replace("0.001", "0.01")).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        html = re.sub(r"<[^>]*\Z", "", r.html or "")  # cut off inside a tag
        expected = naive_text(html)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (expected, len(expected)), r.page_id


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "deep, text." + "</div>" * 100_000, "<p><td>" + "<center>" * 100_000 + "deep, text.", "".join(f'<div class="r{i}">Row {i}, text.</div>' for i in range(10_000)), "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000 + "deep, text."])
def test_pages_of_any_shape_take_linear_time(html):
    import time

    began = time.time()
    assert "text." in html_extract.extract(html) and time.time() - began < 15


def test_pages_operator(spark):
    rows = [(i, f"http://x/{k}", h, "u") for i, (k, (h, _)) in enumerate(PAGES.items())] * 2
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, k string")).collect()
    assert len(out) == 2 * len(PAGES) and all(r.n_chars == len(r.text) for r in out)
    assert len(html_extract.extract("<p>" + "a b. " * 100_000)) > 400_000
    assert len(html_extract.extract("<div>" * 3000 + "deep, text." + "</div>" * 3000)) == 11


def test_chat_comes_back(spark):
    odd = ["", None, "\\### Assistant: </turn> ok", "<|turn:x|>\n", "<|+|>", "|>", "<", "\\0\\1\\2", "<|/turn|>\n", "a" * 50_000, "|", "><|", "\\"]
    rows = [(c, i, role, t) for c in range(3) for i, (t, role) in enumerate(zip(odd[c:], ["system", "user", "user", "assistant", "assistant", "we|>ird<|", None] * 3))]
    rows += [(None, 0, "user", "null id"), (9, 1, "assistant", "tie"), (9, 1, "assistant", "tie"), (9, 0, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    formatted = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    convs = {}
    for c, i, role, t in rows:
        convs.setdefault(c, []).append((i, role or "", t or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        joined = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        learned = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert got[c].loss_chars == len(learned) and got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    whole = formatted.select((F.array_join(F.transform("segments", lambda s: s["text"]), "") == F.col("formatted")).alias("same")).distinct().collect()
    assert [r.same for r in whole] == [True]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.NET/en/x?q#f", "http://example.net/enx", "http://net/", "http://net", "http://a.net?/", "http://planet/", "http://x.org/fr/", "http://x.org/FR/", "ftp://example.com/de/", "http://my.example.com/de", "http://ads.site.io/", "http://site.io/file.ZIP", "http://site.io/login/", "http://blogin.io/x", "a://b://c", "http://" + "a." * 5000 + "net/"]


def test_url_rules_against_plain_matching(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] * 2, "page_id bigint, url string, host string")
    got = url_rules.judge(df, registry.url_rule_book()).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        url = URLS[r.page_id]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for v, h, p in registry.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path) == (host, path)
        assert (r.rule if r.rank == 1 else None) == best[0] and (best[1] is None or r.verdict == best[1])
    verdicts = {URLS[r.page_id]: r.verdict for r in got}
    assert verdicts["http://ads.site.io/"] == verdicts["http://site.io/file.ZIP"] == verdicts["http://site.io/login/"] == "block"
    assert verdicts["http://blogin.io/x"] == "allow"


def test_numbered_hosts_meet_their_label_rules(spark):
    urls = [f"http://{host}site.io/" for label in registry.BLOCKED_LABELS for host in (f"{label}.", f"{label}2.", f"{label.upper()}077.", f"x.{label}1.", f"{label}2x.", f"{label}-2.")]
    rules = registry.url_rule_book() + [url_rules.token_rule("block", "cdn1", "label"), url_rules.token_rule("block", "77", "label")]
    urls += ["http://cdn12.site.io/", "http://cdn1.io/", "http://cdn2.io/", "http://778.io/", "http://78.io/"]
    got = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.verdict == "block") == any(re.search(x.pattern.replace(r"\z", r"\Z"), r.host + r.path) for x in rules if x.verdict == "block"), urls[r.page_id]
    assert {r.page_id for r in got if r.host == "ads2.site.io" and r.verdict == "block" and r.rule == "label:ads"}


def test_every_listed_segment_blocks(spark):
    urls = [f"http://site.io/{t}{end}" for t in registry.BLOCKED_SEGMENTS for end in ("", "/", "/x?y=1")] + ["http://site.io/WP-Admin/", "http://site.io/wp-admins/", "http://site.io/wp/admin/", "http://site.io/cgi-bin.html"]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), registry.url_rule_book()).collect()}
    n = 3 * len(registry.BLOCKED_SEGMENTS)
    assert [got[i].rule for i in range(n)] == [f"segment:{t}" for t in registry.BLOCKED_SEGMENTS for _ in range(3)]
    assert [got[i].verdict for i in range(n, len(urls))] == ["block", "allow", "allow", "allow"]


def test_licenses_by_brute_force(spark):
    mit = license_scan.TEXTS[0].text
    words = mit.split()
    changed = " ".join(words[:20] + ["INSERTED", "words"] + words[20:40] + words[42:])
    texts = ["MIT License; the mit\nLICENSE", "apache license general public license", "mit-license MIT  licenses", mit, changed, "linKs mit lic€nse mit Kelvin", None, "", "GENERAL public", "general general public license license", LONG, "mit license"] * 2
    df = documents(spark, texts)
    got = license_scan.scan(df).collect()
    assert len(got) == len(texts)
    for r in got:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        places = [(i, p.label) for p in license_scan.PHRASES if p.base for i in range(len(ws)) if ws[i : i + len(p.words)] == p.words]
        assert r.n_words == len(ws) and r.n_base == len(places)
        assert r.first_word == min((i for i, _ in places), default=None) and r.last_word == max((i for i, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[3].labels == "mit" and by[3].score == 1 and by[4].labels == "mit" and by[4].score > 0.6
    assert {r.doc_id: r for r in license_scan.scan(df.dropDuplicates(["doc_id"]), most=0).collect()} == by  # joined by shuffle
    assert license_scan.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("no", range(len(license_scan.TEXTS)))
def test_every_license_text_is_whole(no):
    assert license_scan.TEXTS[no].text.isascii() and len(license_scan.TEXTS[no].words) >= 20


def test_edited_and_reordered_license_texts(spark):
    r = random.Random(11)
    texts, labels = [], []
    for t in license_scan.TEXTS:
        words = t.text.split()
        edited = [w for i, w in enumerate(words) if i % 29 != 17]
        half = len(words) // 2
        texts += ["Here it begins. " + " ".join(words).upper() + " And it ends.", " ".join(edited), " ".join(words[half:] + ["in", "between"] + words[:half]), " ".join(r.sample(words, len(words)))]
        labels += [t.label] * 4
    got = {x.doc_id: x for x in license_scan.scan(documents(spark, texts)).collect()}
    for i, label in enumerate(labels):
        own = set(got[i].labels.split(","))
        family = {t.label for t in license_scan.TEXTS if t.family == license_scan.TEXTS[i // 4].family}
        if i % 4 == 0:
            assert label in own and got[i].score == 1, (i, label, own)
        elif i % 4 == 1:  # with every 29th word missing, which may be the one that tells a text from its family
            assert own & family and got[i].score > 0.6, (i, label, own)
        elif i % 4 == 2:  # its halves swapped: both are found, on two diagonals
            assert got[i].score >= 0.4, (i, label, got[i].score)
        else:  # the same words in no order
            assert got[i].score < 0.3 or got[i].score == 1 and any(" ".join(p.words) in " ".join(license_scan.Template("", texts[i]).words) for p in license_scan.PHRASES), (i, label, got[i].score)
    scores = [got[i].score for i in range(len(texts))]
    assert sum(0 < s < 1 for s in scores) > len(license_scan.TEXTS)
    without = license_scan.scan(documents(spark, texts), texts=()).where("score > 0").count()
    assert without < sum(s > 0 for s in scores)


def base_spans(t):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for no, (kind, p) in enumerate(kinds):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            check = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits)))
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and check % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


def test_personal_data_by_brute_force(spark):
    r = random.Random(3)
    bits = ["a@b.c", "x", ".", "@", "1", "12", "255", "256", " ", "-", "+1", "(", "4111111111111111", "é", "😀", "\n", "_d@e.f", "0", "4242 4242 4242 4242", "192.168.0.1", "%", "+1 (784) 555-8120"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 30))) for _ in range(800)]
    texts += ["1" * 3000 + ".2.3.4", "a" * 20_000, "a@b" + ".c" * 20_000, "+1" + " " * 20_000, "1 " * 20_000, None, "", " ".join(["a@b.c +1 (784) 555-8120"] * 2000)]
    texts += texts[:3]
    got = pii.scan(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    for row in got:
        spans = base_spans(texts[row.doc_id] or "")
        told = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert row.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        counts = Counter(k for _, _, k, _ in spans)
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(counts[k] for k in pii.BASE_KINDS)
        assert set(filter(None, told.split(","))) <= set(row.spans.split(","))
    clean = pii.redact(documents(spark, texts))
    assert clean.columns == ["doc_id", "text", "lang", "d", "kept"] and clean.count() == len(texts)
    for row in clean.collect():  # what is left holds no e-mail but what a replaced match has cut off, and every tag stands for a match
        t = texts[row.doc_id] or ""
        assert (row.text or "").count("[EMAIL]") == sum(k == "email" for _, _, k, _ in base_spans(t))
    assert pii.scan(documents(spark, texts).limit(0)).count() == 0


def test_terms_that_give_an_entity_away_go(spark):
    fill = [f"filler number{i} says nothing about anybody here" for i in range(300)]
    told = [f"note{i} the zorblatt can be met at jo.doe@mail.org by anybody here" for i in range(5)]
    copies = ["only copied quaxly writes to al@mail.org here"] * 5
    df = documents(spark, fill + told + copies)
    out = {r.doc_id: r.text for r in pii.redact(df, near=6).collect()}
    assert all("zorblatt" not in out[i] and "jo.doe" not in out[i] and "anybody here" in out[i] for i in range(300, 305))
    assert all(out[i] == f for i, f in enumerate(fill))
    assert all("quaxly" in out[i] and "al@" not in out[i] for i in range(305, 310))  # copies of one text are no evidence


def test_revealing_terms_go_where_the_entity_is_not(spark):
    told = [f"note{i} the zorblatt can be met at jo.doe@mail.org by anybody here" for i in range(5)]
    alone = ["Zorblatt was seen again", "again a zorblatt spoke"]
    fill = spark.range(51_000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("number"), "id", F.lit(" says nothing about anybody here, the note can be met")).alias("text"))
    df = documents(spark, told + alone, extra=False).select("doc_id", "text").unionByName(fill)
    out = {r.doc_id: r.text for r in pii.redact(df).where("doc_id < 200").collect()}
    assert all("zorblatt" not in out[i].lower() for i in range(7)) and "again" in out[5] and out[100] == "number0 says nothing about anybody here, the note can be met"
    spans = {r.doc_id: r.spans for r in pii.scan(df).where("doc_id < 200").collect()}
    assert spans[5] == "term:0:8" and spans[6] == "term:8:16" and spans[100] == ""


def test_common_words_near_entities_are_no_candidate_terms(spark):
    from murmur.llm.common import Tables

    # Before, every word near an entity was counted over all texts: here 40 names and 4 common words.
    told = [f"text{i} everybody says zorb{e}x can meet who{e}@mail.org here{i}" for e in range(40) for i in range(3)]
    fill = [f"number{i} everybody says that nobody can meet" for i in range(400)]
    tables = Tables(spark, "pii-terms")
    got = {r.doc_id: r.spans for r in pii.scan(documents(spark, told + fill), tables=tables).collect()}
    candidates = {r.term for r in spark.read.parquet(tables.path("candidates")).collect()}
    assert candidates == {f"zorb{e}x" for e in range(40)}
    assert all("term:" in got[i] for i in range(120)) and all(got[i] == "" for i in range(120, 520))
    tables = Tables(spark, "pii-redacted")  # the pipeline's stage
    out = {r.doc_id: r.text for r in pii.redact(documents(spark, told + fill), tables=tables).collect()}
    assert {r.term for r in spark.read.parquet(tables.path("candidates")).collect()} == candidates
    assert all("zorb" not in out[i] and "everybody says" in out[i] for i in range(120)) and [out[i] for i in range(120, 520)] == fill
    # A word cut by its entity is no word of its text, and is not counted among those that say it.
    found = pii.find(documents(spark, ["abc+14155550100 and abc", "abc+14155550100 alone"])).orderBy("d").collect()
    assert [sorted(r.told) for r in found] == [["abc", "and"], ["abc", "alone"]]
    glued = pii.find(documents(spark, ["abc4111 1111 1111 1111"])).collect()[0]
    assert glued.near == [["abc"]] and glued.told == []


def test_quality_figures_by_brute_force(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdef") + r.choice("xy\n#") for _ in range(r.randrange(0, 80))) for _ in range(200)] + [None, "", LONG, "a\x1cb c", "l\nl\n \nl", "x y " * 5 + "# $"]
    got = quality_rules.features(documents(spark, texts).drop("kept")).collect()
    for row in got:
        t = texts[row.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen, covered = Counter(g), set()
        for i, x in enumerate(g):
            if seen[x] > 1:
                covered.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(k, n, p, x) for n in (10, 200, 1500) for k in (0, 1, 5, 9) for p in (0.02, 0.3) for x in (1e-4, 0.05)]
    df = spark.createDataFrame(cases, "k bigint, n bigint, p double, x double")
    for row in df.select("*", quality_rules.tail_at_most(F.col("k"), F.col("n"), F.col("p"), F.col("x")).alias("fine")).collect():
        tail = sum(comb(row.n, i) * row.p**i * (1 - row.p) ** (row.n - i) for i in range(row.k + 1))
        assert row.fine == (tail <= row.x)


def test_cutoffs_reject_bad_documents_and_few_good_ones(spark):
    good = [(i, "word thing other place " * 2 + " ".join(f"w{i}x{j}" for j in range(30)), "en", 1) for i in range(1500)]
    bad = [(5000 + i, " ".join(f"b{i}z{j}###$$" for j in range(40)), "en", 0) for i in range(200)]
    df = spark.createDataFrame([x[:3] for x in good + bad], "doc_id bigint, text string, lang string").withColumn("n_words", F.lit("mine"))
    labels = spark.createDataFrame([(x[0], x[3]) for x in good + bad], "doc_id bigint, quality int")
    kept = quality_rules.keep(df, labels)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {x[0] for x in good}
    none = quality_rules.keep(df, labels.limit(0))
    assert none.count() == 1700 and quality_rules.keep(df.limit(0), labels).count() == 0
    blank = df.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"))
    assert quality_rules.keep(blank, labels).count() == 0
