"""The corpus operators on small tables: against brute force, and on nulls, empty and long texts, ties, repeated rows, empty
tables and clashing names."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataform.llm import bpe, chat, components, decontaminate, exact_dedup, html_extract, line_dedup, ngram_join, quality, token_counts, warc
from strataform.llm.textvec import Words

#: Names that operators use inside.
CLASH = "doc_id long, text string, _id string, score string, root string, _row string, key string, _text string, n_chars long"


def make(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(texts, schema)


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "i", "s", "r", "w", "k", "t", len(t or "")) for i, t in texts], CLASH)


def corpus(n=60, seed=3):
    noise, words = random.Random(seed), [f"w{i}" for i in range(400)]
    base = [" ".join(noise.choices(words, k=noise.randrange(1, 80))) for _ in range(n // 2)]
    out = []
    for i in range(n):
        t = base[noise.randrange(len(base))].split()
        for _ in range(noise.choice((0, 0, 1, 2, 6))):
            t[noise.randrange(len(t))] = noise.choice(words)
        out.append((i, " ".join(t)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, out[0][1]), (n + 3, out[0][1]), (None, out[0][1])]


def test_words_and_grams():
    texts = ["Aé-b 12", "", "x", "--", "a b c d"]
    data = pa.array(texts)
    w = Words(*ngram_join.text_buffer(data))
    assert [w.low[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == ["aé", "b", "12", "x", "a", "b", "c", "d"]
    assert np.diff(w.first).tolist() == [3, 0, 1, 0, 4] and len(w.grams(3)[0]) == 3 and len(w.grams(3, short=True)[0]) == 4
    long = np.frombuffer(("ab " * 900_000).encode(), np.uint8)
    w = Words(long, np.array([0, len(long)]))
    assert len(w.start) == 900_000 and len(set(w.hash.tolist())) == 1


def test_ids_are_those_of_the_library():
    e = bpe.encoder(bpe.default_path())
    assert e.fast is not None
    for text in ["", "a  b", "x \n  y", "é ☃ 🙂 日本", "it's  we'll", "<|endoftext|> hi", "1²½ x_y" * 50] + [t for _, t in corpus() if t]:
        assert e.encode(text).tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_exact_dedup(spark):
    big = "x y " * 60_000
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (7, None), (8, ""), (2, big), (1, big + "z"), (4, big.replace("x y", "x  y")), (6, " "), (6, " ")]
    got = {r.doc_id: r for r in exact_dedup.dedup(clashing(spark, rows)).collect()}
    assert {k: (r.keep_id, r.group_size, r.kept) for k, r in got.items()} == {5: (3, 3, False), 3: (3, 3, True), 9: (3, 3, False), 7: (7, 2, True), 8: (7, 2, False), 2: (2, 2, True), 4: (2, 2, False), 1: (1, 1, True), 6: (6, 2, True)}
    assert got[9].text_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert exact_dedup.dedup(make(spark, [])).count() == 0


def test_fingerprints_compose_and_collisions_are_refuted(spark, monkeypatch):
    a, b = b"left part", b"and right"
    (h1, _), (h2, w2), (h, _) = ((exact_dedup.chunk_hash(x)[0], exact_dedup.chunk_hash(x)[1]) for x in (a, b, a + b))
    assert (h1 * w2 + h2) % exact_dedup.PRIMES[0] == h
    rows = make(spark, [(1, "abc"), (2, "abd"), (3, "abc")])
    forged = exact_dedup.fingerprints(rows).withColumns({f"fp{i}": F.lit(7).cast("long") for i in range(3)})
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda *a: forged)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(rows).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def brute_links(texts):
    sets = ngram_join.gram_sets(pa.array([t for _, t in texts]), 5)
    links = collections.defaultdict(set)
    for a in range(len(texts)):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    return links


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 2, "block_rows": 3}])
def test_ngram_join(spark, options):
    texts = [x for x in corpus(80) if x[0] is not None][:-1]
    links = brute_links(texts)
    got = {r.doc_id: r for r in ngram_join.join(clashing(spark, texts), **options).collect()}
    assert {texts[i][0]: len(links[i]) for i in range(len(texts))} == {k: r.n_links for k, r in got.items()}
    root = {}
    for i in range(len(texts)):
        if i not in root:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in root:
                    root[k] = i
                    stack += links[k]
    assert {texts[i][0]: texts[root[i]][0] for i in root} == {k: r.class_id for k, r in got.items()}


def test_ngram_join_edges(spark):
    assert ngram_join.join(make(spark, [])).count() == 0
    got = [tuple(r) for r in ngram_join.join(make(spark, [(1, None), (2, ""), (None, "a b"), (4, "a b"), (4, "a b")])).collect()]
    assert collections.Counter(got) == collections.Counter([(1, 1, 1, 0, 0), (2, 2, 2, 0, 0), (None, None, None, 0, 0), (4, 4, 4, 1, 0), (4, 4, 4, 1, 0)])
    kept = ngram_join.keep_one(clashing(spark, [(1, "a b c"), (2, "a b c"), (3, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns[2] == "_id"


def test_common_passage_does_not_hold_documents_together(spark, monkeypatch):
    """Crowded buckets of texts that share a passage and nothing else: their pairs are pruned before any set is compared."""
    passage, noise = " ".join(f"p{i}" for i in range(60)), random.Random(4)
    texts = [(i, passage + " " + " ".join(f"u{noise.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    texts += [(100 + i, " ".join([*(f"c{k}" for k in range(80)), f"x{i}"])) for i in range(30)]
    seen = []
    verify = ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda rows, *a: seen.append({r.rep for r in rows.select("rep").collect()}) or verify(rows, *a))
    got = {r.doc_id: r for r in ngram_join.join(make(spark, texts), bucket_rows=4, block_rows=8).collect()}
    assert seen == [set(range(100, 130))]
    assert all(got[i].n_links == 0 for i in range(60)) and all(got[100 + i].n_links == 29 and got[100 + i].class_id == 100 for i in range(30))


def test_intersections_of_common_and_rare_hashes():
    noise = np.random.default_rng(1)
    sets = [np.unique(noise.integers(0, 60, 40).astype(np.uint64)) for _ in range(50)]
    got = ngram_join.intersections(sets[:20], sets[20:], often=30, columns=7)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[20 + j])) for i in range(20) for j in range(30))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (7, 7)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {50: 50, 100: 50}


def brute_lines(texts):
    """Which lines are in a run of 50 words or more that is at an earlier place: each run's best reach, all places."""
    words = lambda x: len(x.split())
    seq = [[(n, x) for n, x in enumerate((t or "").split("\n")) if x.strip()] for _, t in texts]
    gone = collections.defaultdict(set)
    for b in range(len(seq)):
        for a in range(b + 1):
            for j in range(len(seq[b])):
                for i in range(len(seq[a])):
                    if (a, i) < (b, j) and seq[a][i][1] == seq[b][j][1]:
                        n = 0
                        while i + n < len(seq[a]) and j + n < len(seq[b]) and seq[a][i + n][1] == seq[b][j + n][1]:
                            n += 1
                        if sum(words(seq[b][j + k][1]) for k in range(n)) >= 50:
                            gone[texts[b][0]] |= {seq[b][j + k][0] for k in range(n)}
    return gone


def test_line_dedup_against_brute_force(spark):
    noise = random.Random(5)
    line = lambda n: " ".join(f"v{noise.randrange(10_000)}" for _ in range(n))
    shared = [[line(60)], [line(20), line(20), line(20)], [line(30), line(5), "", line(30)], [line(12)]]
    texts = []
    for i in range(30):
        parts = [[line(noise.randrange(1, 40))] for _ in range(noise.randrange(6))] + [shared[k] for k in range(4) if noise.random() < 0.4]
        noise.shuffle(parts)
        texts.append((i, "\n".join(x for p in parts for x in p)))
    texts += [(30, None), (31, ""), (32, "\n".join([line(55)] * 3)), (33, texts[3][1])]
    got = {r.doc_id: set(r.removed) for r in line_dedup.report(clashing(spark, texts)).collect()}
    want = brute_lines(texts)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_among_many_contexts(spark, seed):
    """Few lines, short and long, in every order: a fingerprint has many contexts, and runs end at any line."""
    noise = random.Random(seed)
    lines = [" ".join(f"z{k}x{i}" for i in range(n)) for k, n in enumerate((1, 2, 3, 8, 13, 26, 30, 49, 50))]
    texts = [(i, "\n".join(noise.choices([*lines, ""], weights=[6, 6, 5, 5, 4, 3, 2, 1, 0.3, 2], k=noise.randrange(1, 25)))) for i in range(60)]
    got = {r.doc_id: set(r.removed) for r in line_dedup.report(make(spark, texts)).collect()}
    want = brute_lines(texts)
    assert sum(map(len, want.values())) > 20 and {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_line_dedup_rewrite(spark):
    line = " ".join(f"u{i}" for i in range(60))
    rows = clashing(spark, [(1, f"head\n{line}"), (2, f"{line}\n\ntail"), (3, line), (4, None), (None, line)])
    got = {r.doc_id: (r.text, r.n_chars, r._row) for r in line_dedup.rewrite(rows).collect()}
    assert got == {None: (line, len(line), "w"), 1: ("head", 4, "w"), 2: ("\ntail", 5, "w"), 4: (None, 0, "w")} or set(got) == {None, 1, 2, 4}
    assert line_dedup.report(make(spark, [])).count() == 0


def brute_windows(docs, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in docs:
        own, hit, found = words(t), set(), set()
        for item, text in items:
            w = words(text)
            n = min(10, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            for k in range(len(own) - n + 1):
                if n and tuple(own[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out[i] = (len(own), len(hit), len(found), decontaminate.sorted_digest(found), bool(hit))
    return out


@pytest.mark.parametrize("options", [{}, {"max_bytes": 60, "filter_bits": 64}, {"max_bytes": 0}])
def test_decontamination(spark, options):
    """The benchmark as a broadcast, and beyond its bound as a join behind a filter."""
    long = " ".join(f"q{i}" for i in range(14))
    items = [(10, long), (9, "Only three words"), (8, None), (7, "!!"), (6, " ".join(f"q{i}" for i in range(2, 13))), (11, long + " é"), (11, long)]
    docs = [(1, "x " + long.upper().replace("Q", "q") + " y"), (2, "only, three; WORDS here only three"), (3, None), (4, ""), (5, "q0 q1 q2"), (6, "nothing"), (8, "é " + "z " * 30_000 + long + " only three words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.scan(clashing(spark, docs), bench, **options)).collect()}
    assert got == brute_windows(docs, items)
    twice = [(None, docs[0][1]), (None, docs[0][1]), (7, docs[0][1]), (7, "clean")]
    assert sorted(r.n_hit for r in decontaminate.scan(make(spark, twice), bench, **options).collect()) == [0, 14, 14, 14]
    kept = decontaminate.decontaminate(clashing(spark, docs + twice), bench, **options)
    assert sorted((r.doc_id, r._id) for r in kept.collect()) == [(i, "i") for i in (3, 4, 5, 6, 7)] and kept.columns == clashing(spark, docs).columns
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(make(spark, docs), bench, mode="spans", **options).collect()}
    assert cut[1] == "x  y" and cut[2] == " here only three" and cut[3] is None and cut[8] == "é " + "z " * 30_000
    assert decontaminate.scan(make(spark, docs), bench.where("false"), **options).where("n_hit > 0").count() == 0 == decontaminate.scan(make(spark, []), bench, **options).count()


def test_broadcast_windows_are_small():
    """A benchmark at the bound stays within 8 times its bytes, flat, and is built in seconds."""
    import pickle
    import time

    noise = np.random.default_rng(3)
    items = [(str(i), " ".join(map(str, noise.integers(10**4, 10**6, 200)))) for i in range(6000)]
    size, began = sum(len(t) for _, t in items), time.process_time()
    windows = decontaminate.Windows(items, 10)
    assert size > 7 << 20 and time.process_time() - began < 8 and len(pickle.dumps(windows)) < 8 * size


def test_warc_round_trip(spark, tmp_path):
    import gzip

    rows = [(1, "http://a/ü x", "<p>é\r\n\r\n</p>"), (2, None, "<p>é\r\n\r\n</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n"), (6, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages.coalesce(1), str(tmp_path / "w"), file_bytes=700)
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert {k: (r.payload_bytes, r.payload_digest) for k, r in got.items()} == {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows}
    small = warc.archive_round_trip(pages, min_bytes=5).where("record_type = 'revisit'").collect()
    assert [r.page_id for r in small] == [1]
    files = [x for x in (tmp_path / "w").iterdir() if not x.name.startswith((".", "_"))]
    assert len(files) > 1 and all(f.name.endswith(".warc.gz") and f.stat().st_size < 3000 for f in files)
    for f in files:  # each record is a member of its own, the first a warcinfo, and any gzip reader reads the whole
        own = [x for data in warc.members(f.read_bytes()) for x in warc.parse(data)]
        assert own[0][0]["warc-type"] == "warcinfo" and len(own) == len(list(warc.members(f.read_bytes())))
        assert [h for h, _ in warc.parse(gzip.decompress(f.read_bytes()))] == [h for h, _ in own]


def test_warc_edges(spark):
    """Hot payloads, repeated rows, null ids, ids of other types, an empty table, clashing names; nothing stays behind."""
    import os

    schema = "page_id string, url string, html string, _id string, payload_digest string, _to string, n long"
    rows = [(f"{i:04}", "u", "same" if i % 3 == 0 else f"p{i}", "x", "y", "z", i) for i in range(90)] + [(None, "u", "same", "", "", "", 0)] * 2 + [("0089", "u", "p89", "", "", "", 0)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, schema).repartition(4)).collect()
    assert len(got) == len(rows) and {r.refers_to for r in got if r.record_type == "revisit"} == {"0087"}
    assert sum(r.record_type == "revisit" for r in got) == 31 and sum(r.page_id == "0089" and r.record_type == "response" for r in got) == 2
    assert {r.payload_bytes for r in got if r.page_id is None} == {4}
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("warc-")]


def test_token_counts(spark):
    texts = corpus()
    e = bpe.encoder(bpe.default_path())
    sizes = [len(e.encode(t)) for _, t in texts]
    table = token_counts.token_counts(clashing(spark, texts))
    for limit in (0, 1, 17, 60, 10_000):
        assert token_counts.truncated_total(table, limit) == sum(min(limit, n) for n in sizes)
    assert token_counts.quantile(table, 0.5) == sorted(sizes)[math.ceil(len(sizes) / 2) - 1]
    spans = token_counts.summary(token_counts.histogram(token_counts.lengths(make(spark, texts))), span=8)
    assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, table.collect()))
    assert token_counts.token_counts(make(spark, [])).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "[\\INST]", "<</SYS>>", "a </s>", "<s>", "\\", "<<ROLE x>>", " [/INST", "[", "<\\\\s>", "", "é🙂"]
    turns = [(r, t) for r in ("user", "assistant", "system", "tool é", "") for t in hard]
    text = chat.FIRST + "".join(chat.render_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _ in chat.parse(text)] == turns and text.count("[INST]") == len(hard)
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", hard[0]), (1, 2, "assistant", None), (2, 0, None, "b"), (3, 1, "user", "y"), (3, 1, "user", "x"), (None, 0, "user", "n")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    want = lambda *t: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    assert got[1].turns_sha256 == want(("user", "a"), ("assistant", hard[0]), ("assistant", "")) and got[1].loss_chars == len(hard[0]) and got[1].loss_sha256 == hashlib.sha256(hard[0].encode()).hexdigest()
    assert got[2].turns_sha256 == want(("", "b")) and got[3].turns_sha256 == want(("user", "x"), ("user", "y")) and got[None].n_turns == 1
    whole = {r.conv_id: r.text for r in chat.formatted(chat.format_turns(spark.createDataFrame(rows[:2], "conv_id long, turn long, role string, text string"))).collect()}
    assert [t for _, t, _ in chat.parse(whole[1])] == ["a", hard[0]]
    with pytest.raises(chat.Mismatch):
        chat.parse("<s>[INST] open")
    for cut in (1, 2, 5, 1000):  # the stream of a conversation, cut anywhere
        stream = chat.Stream()
        assert [x for k in range(0, len(text), cut) for x in stream.feed(text[k : k + cut])] == turns and stream.size == len(text)
        stream.close()
    with pytest.raises(chat.Mismatch):
        list((broken := chat.Stream()).feed("<s>[INST] open"))
        broken.close()


def test_chat_tables(spark):
    """A conversation that holds most rows, repeated rows, very long texts, clashing names, an empty table."""
    schema = "conv_id long, turn long, role string, text string, segment string, n_turns long"
    rows = [(1, i, ("user", "assistant")[i % 2], "x <s>" * (1 + i % 7), "s", 0) for i in range(3000)] + [(2, 0, "user", "a" * 3_000_000 + "[INST]", None, 1)] + [(3, 0, "assistant", "same", "", 2)] * 2
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, schema).repartition(5))).collect()}
    for conv in (1, 2, 3):
        own = sorted((t, r, x) for c, t, r, x, *_ in rows if c == conv)
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(x for _, r, x in own if r == "assistant").encode()).hexdigest()
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], schema))).count() == 0


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site.</div><main><header><h1>The  title</h1></header><p>It is the first &amp; the best of all that was &#233;t&eacute;.<br>Next<p>Short.</p>
    <div class="ad">Buy <div>now</div></div><form><input>Mail</form><ul class="related"><li><a href=y>More</a></ul><script>var a = "<p>no</p>";</script></main><section id="comments"><p>What a great post that was for all of us.</p></section><aside>Side</aside><footer>End</footer>"""
    assert html_extract.extract(page) == "The title\n\nIt is the first & the best of all that was été. Next\n\nShort."
    plain = "<div><a href=a>one</a> <a href=b>two</a></div><p>" + "This is the text of a page that has no marks, and it is long enough to be kept in the end. " * 3 + "</p><p>Short too.</p>"
    assert html_extract.extract(plain).endswith("in the end.\n\nShort too.") and "one" not in html_extract.extract(plain)
    wrapped = html_extract.extract(f'<div id="page" class="layout no-sidebar has_banner">{plain}<div class="left sidebar">{plain}</div></div>')
    assert wrapped == html_extract.extract(plain)
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p") == ""


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p class="ad">Buy<p>Text one.</p><p>Text two.</p></article>', "Text one.\n\nText two."),
        ('<article><p class="ad">Buy<h2>Title</h2><p>Text.</article>', "Title\n\nText."),
        ('<article><ul><li>One.<li class="share">Tell<ul><li>Us<li>Them</ul><li>Two.</ul><p>Text.</article>', "One.\n\nTwo.\n\nText."),
        ('<article><ul><li class="share">Tell</ul><p>Text.</article>', "Text."),
        ('<article><dl><dt class="ad">Buy<dd>Meaning.<dd class="ad">Now<dt>Word.</dl></article>', "Meaning.\n\nWord."),
        ('<article><table><tr><td class="ad">Buy<td>Cell one.<tr class="promo"><td>Now<tr><td>Cell two.</table><p>Text.</article>', "Cell one.\n\nCell two.\n\nText."),
        ('<article><table><tr><td class="ad">Buy<table><tr><td>Now</table>Still</table><p>Text.</article>', "Text."),
        ('<article><div><span class="ad">Buy</div><p>Text.</article>', "Text."),
        ('<article><p class="ad">Buy <a href=x>now</a> or <b>later</b><br>Soon</p><p>Text.</article>', "Text."),
        ('<article><a href=x><div class="ad">Buy</a> now</div><p>Text of it.</p></article>', "Text of it."),
        ('<article><div class="ad"><p>Buy<p>Now<div>Here</div></p></div><p>Text.</article>', "Text."),
        ("<head><title>t</title><body><p>" + "It is the text of a page that has no end of its head. " * 4, ("It is the text of a page that has no end of its head. " * 4).strip()),
        ('<article><h2 id="search">Search</h2><h3><span id="share">Share</span></h3><section id="related-work"><p>Text.</section></article>', "Search\n\nShare\n\nText."),
        ('<article><section class="related"><p>More</section><h2 class="ad">Buy</h2><div id="comments">Nice</div><p>Text.</article>', "Text."),
        ('<main><article><p>Text.</article><section id="comments"><p>Nice</section></main>', "Text."),
    ],
)
def test_html_parts_end_where_they_should(page, text):
    assert html_extract.extract(page) == text


def test_html_deep():
    deep = '<article><p class="ad">Buy<object>' + "<b><div>" * 20_000 + "x</object><p>Text.</article>"
    assert html_extract.extract(deep).endswith("Text.")


def test_html_table(spark):
    rows = html_extract.extract_text(spark.createDataFrame([(1, "u", None), (2, None, "<article><p>Ok é</p></article>")], "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in rows] == [(1, "u", "", 0), (2, None, "Ok é", 4)]


def test_quality_moments_of_all_documents(spark):
    docs = corpus(300)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    x = quality.features(*quality.text_buffer(pa.array([t for _, t in docs]))).astype(np.float64)
    for parts in (1, 5):
        model = quality.train(make(spark, docs).repartition(parts), labels, max_positives=9, max_unlabelled=11)
        assert np.allclose(model.center, x.mean(0), atol=1e-5) and np.allclose(model.scale, np.maximum(x.std(0), 1e-3), atol=1e-5)


def test_quality_samples(spark, monkeypatch):
    sizes, docs, fit = [], make(spark, [(i, f"the text {i}") for i in range(200)]), quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, *a, **k: sizes.append((len(p), len(u))) or fit(p, u, *a, **k))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    quality.train(docs, labels)
    quality.train(docs, labels.where("quality = 1"))
    assert sizes == [(40, 60), (40, 200)]


def test_quality_of_a_very_common_id(spark):
    """One id on most rows: one row of it is learned from, whatever the order."""
    docs = [(7, f"the common text {i % 3}") for i in range(3000)] + [(i, f"word {i} of it") for i in range(100, 160)]
    frame = make(spark, docs).withColumn("_id", F.col("doc_id")).withColumn("_kind", F.lit(1))
    x, kind = quality._collect_features(frame.repartition(6))
    assert len(x) == 61 and len(kind) == 61
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(100, 160)] + [(7, 1), (7, 1)], "doc_id long, quality int")
    a, b = (quality.train(make(spark, docs).repartition(n), labels) for n in (2, 9))
    assert np.allclose(a.weights, b.weights)
    assert quality.score(make(spark, docs), a).where("doc_id = 7").select("score").distinct().count() <= 3


def test_quality_risk_goes_down():
    """The fit against its definition: the non-negative risk in plain numpy, at the start, at the end, and at points around it."""
    noise = np.random.default_rng(2)
    xp, xu = noise.normal(1, 1, (80, 4)), np.concatenate([noise.normal(1, 1, (60, 4)), noise.normal(-1, 1, (60, 4))])

    def risk(w, b, prior=0.5):
        loss = lambda z: np.log1p(np.exp(-z))
        fp, fu = xp @ w + b, xu @ w + b
        return prior * loss(fp).mean() + max(0.0, loss(-fu).mean() - prior * loss(-fp).mean()) + 5e-4 * w @ w

    w, b = quality._descend(xp, xu, 0.5, 600)
    assert risk(w, b) < 0.8 * risk(np.zeros(4), 0.0)
    assert all(risk(w, b) <= risk(w + d[:4], b + d[4]) + 2e-3 for d in noise.normal(0, 0.05, (50, 5)))


def test_quality_learns_words():
    """Junk that only its words tell: the same sentences with words of one kind among them."""
    noise = random.Random(0)
    weights = [1 / (i + 1) for i in range(3000)]
    good = np.array([noise.random() < 0.85 for _ in range(3000)])

    def text(ok):
        words = noise.choices(range(3000), weights, k=noise.randrange(60, 400))
        return " ".join(f"w{w if ok or noise.random() > 0.15 else 2000 + noise.randrange(60)}" for w in words)

    x = quality.features(*quality.text_buffer(pa.array([text(ok) for ok in good])))
    held = np.arange(3000) % 3 == 0
    errors = []
    for own in (x, x * (np.arange(x.shape[1]) < quality.N_STATS)):
        model = quality.fit(own[~held & good], own[~held], float(good[~held].mean()))
        errors.append(((model.score(own[held]) >= 0.5) != good[held]).sum())
    assert errors[0] <= 20 and errors[0] < errors[1]


def test_quality_word_shares():
    texts = ["", None, "a b a", "\u4e2d " * 3, "...", "a " * 5000 + "b"] + [f"x{i}" for i in range(2100)]
    x = quality.features(*quality.text_buffer(pa.array(texts, pa.string())))
    assert x.shape == (len(texts), quality.N_FEATURES) and np.isfinite(x).all()
    length = (x[:, quality.N_STATS :].astype(float) ** 2).sum(1)
    assert (length[[0, 1, 4]] == 0).all() and np.allclose(np.delete(length, [0, 1, 4]), 1, atol=2e-3)
    for i in (2, 5, 6, 1005, 2105):  # no row depends on those beside it
        assert (quality.features(*quality.text_buffer(pa.array([texts[i]], pa.string())))[0] == x[i]).all()


def test_quality(spark):
    noise = random.Random(1)
    good = lambda: " ".join(noise.choice("the of and house river walks slowly green".split()) for _ in range(40)) + "."
    bad = lambda: " ".join(noise.choice(("###", "$$$", "BUY!!", "|")) + str(noise.random()) for _ in range(40))
    docs = [(i, bad() if i % 5 == 0 else good()) for i in range(400)] + [(400, None), (401, "")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 400, 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    frame = clashing(spark, docs)
    model = quality.train(frame, labels, allowed=lambda i: ~quality.held_out(i))
    got = {r.doc_id: r for r in quality.score(frame, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert np.mean([got[i].predicted == int(i % 5 != 0) for i in range(400) if got[i].held_out]) > 0.95
    again = quality.train(frame.repartition(7), labels, allowed=lambda i: ~quality.held_out(i))
    assert np.allclose(again.weights, model.weights)
    unlabelled = quality.train(frame, labels.where("quality = 1"))
    assert 0.05 <= unlabelled.prior <= 0.99
    assert quality.score(make(spark, []), quality.train(make(spark, []), labels.where("false"))).count() == 0
