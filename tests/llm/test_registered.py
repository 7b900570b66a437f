"""Every registered query of the corpus operators on the smallest tables, against SQL or a brute-force version, and the
pipeline stage by stage against plain Python."""

import collections
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_corpus import brute_lines, brute_links, brute_windows

import corpus_pipeline
from strataform.llm import bpe, html_extract, quality
from strataform.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def plain(value):
    return None if value != value else value


def key(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, ([plain(v) for v in row] for row in df.astype(object).where(df.notna(), None).values.tolist())))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def brute_model(docs, labels):
    """The classifier's fit without Spark, on the labels that aren't held out."""
    own = {}
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            own[i] = min(q, own.get(i, 1))
    x = quality.features(*quality.text_buffer(pa.array([t for _, t in docs], pa.string())))
    row = {i: k for k, (i, _) in enumerate(docs)}
    p, u = ([row[i] for i in own if i in row and (own[i] == 1 or not good)] for good in (True, False))
    order = lambda z: z[np.lexsort(z.T)]
    moments = tuple(m.astype(np.float32).astype(float) for m in (x.astype(float).mean(0), x.astype(float).std(0)))
    return quality.fit(order(x[p]), order(x[u]), sum(own.values()) / len(own), moments=moments), x


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_quality_query(spark):
    docs, labels = table(spark, "documents", "doc_id", "text"), table(spark, "labels", "doc_id", "quality")
    model, x = brute_model(docs, labels)
    want = dict(zip((i for i, _ in docs), model.score(x)))
    got = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i].score - want[i]) < 1e-3 and got[i].predicted == int(got[i].score >= 0.5) for i in want)
    held = [(i, q) for i, q in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].predicted == q for i, q in held]) >= 0.95


def test_html_query(spark):
    """One row a page, as extract() gives it on its own; a page's text is in its article, and no script or menu is in it."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op2_html_extraction"](spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.text == html_extract.extract(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        assert "<script" not in r.text and "function(" not in r.text and "  " not in r.text


def test_token_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    sizes = np.array([len(library.encode(t or "", add_special_tokens=False).ids) for (t,) in table(spark, "documents", "text")])
    got = QUERIES["op9_token_counts"](spark, SF).collect()
    assert {r.n_tokens: r.n_docs for r in got} == dict(collections.Counter(sizes.tolist()))
    for r in got:
        assert r.docs_over == (sizes > r.n_tokens).sum() and r.tokens_kept == np.minimum(sizes, r.n_tokens).sum() and r.tokens_total == sizes.sum() == r.tokens_kept + r.tokens_lost
        assert r.share_at_most == pytest.approx((sizes <= r.n_tokens).mean())


def test_pipeline_stages(spark):
    """Each stage's rows against plain Python on the rows before it, with all columns kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    model, x = brute_model([(i, r.text) for i, r in before.items()], table(spark, "labels", "doc_id", "quality"))
    items = table(spark, "benchmark", "item_id", "text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r for r in docs.collect()}
        texts = [(i, r.text) for i, r in before.items()]
        if name == "quality_classifier":
            want = {i: before[i].text for i, s in zip(before, model.score(x)) if s >= 0.5}
        elif name == "line_dedup":
            gone = brute_lines(texts)
            want = {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone.get(i, ())) if gone.get(i) else t for i, t in texts}
            want = {i: t for i, t in want.items() if not gone.get(i) or t.strip()}
        elif name == "ngram_jaccard_join":
            links, least = brute_links(texts), {}
            for k in sorted(range(len(texts)), key=lambda k: texts[k][0]):
                stack = [k]
                while stack:
                    j = stack.pop()
                    if j not in least:
                        least[j] = k
                        stack += links[j]
            want = {texts[k][0]: texts[k][1] for k in least if least[k] == k}
        else:
            hit = brute_windows(texts, items)
            want = {i: t for i, t in texts if not hit[i][-1]}
        assert {i: r.text for i, r in after.items()} == want, name
        assert all((r.lang, r.source) == (before[i].lang, before[i].source) and r.n_chars == (before[i].n_chars if r.text == before[i].text else len(r.text)) for i, r in after.items())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == set(before) and packed.groupby("sequence_id").length.sum().max() <= 1024
    whole = corpus_pipeline.run(spark, SF).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[columns].values.tolist())) == sorted(map(tuple, packed[columns].values.tolist()))
