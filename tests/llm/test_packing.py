"""Packing: what every packing must keep, and that breeding beats best fit where best fit isn't optimal."""

import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.llm import bpe, packing
from strataform.llm.queries import QUERIES

from test_corpus import clashing, corpus, make

SF = "/root/testdata/sf0.001"


def counts(lengths):
    return np.bincount(lengths, minlength=1025)


def best_fit(lengths):
    return packing.Packing(1024).best_fit(sorted(lengths, reverse=True))


def middling(seed=1):
    return np.random.default_rng(seed).integers(200, 700, 2048).tolist()


def triplets(seed=1, n=680):
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(250, 500))
        b = int(rng.integers(200, 1024 - a - 150))
        out += [a, b, 1024 - a - b]
    return out


def check(rows, total=None):
    """The sequences of a packing in pandas: at most 1024 tokens each, without gaps."""
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 1024 and own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    return rows.sequence_id.nunique()


def test_documents_are_cut_and_packed(spark):
    e = bpe.encoder(bpe.default_path())
    texts = corpus(200) + [(900, "word " * 5000), (901, "word " * 1022)]
    rows = packing.pack(clashing(spark, texts), island_rows=64).toPandas()
    least = math.ceil(rows.length.sum() / 1024)
    assert least <= check(rows) <= least + 1
    for doc, text in ((900, "word " * 5000), (200, None)):
        own = rows[rows.doc_id == doc].sort_values("piece")
        ids = np.append(e.encode(text), 2).astype("<u4")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist() and own.length.tolist()[1:] == [1024] * (len(own) - 1)
    assert packing.pack(make(spark, [])).count() == 0


def test_ids_beyond_2_to_53_and_null_ids(spark):
    ids = [9007199254740993, 9007199254740995, None, None, 2**63 - 1]
    rows = packing.pack(make(spark, [(i, "a b") for i in ids])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i in ids)
    named = packing.pack(spark.createDataFrame([("x" * 40, "a"), (None, "b")], "doc_id string, text string")).collect()
    assert {r.doc_id for r in named} == {"x" * 40, None}


@pytest.mark.parametrize("lengths, margin", [(middling(), 0.01), (middling(7), 0.01), (triplets(), 0.02), (triplets(5), 0.02)])
def test_breeding_beats_best_fit(lengths, margin):
    best, plain = None, best_fit(lengths)
    for epoch in range(packing.EPOCHS):  # an island on its own
        best = packing.evolve(counts(lengths), best and best.bins, seed=epoch)
    assert sorted(x for b in best.bins for x in b) == sorted(lengths) and min(best.room) >= 0
    assert len(best.bins) <= (1 - margin) * len(plain.bins)


def test_a_generation_gains():
    """Crossover finds what neither best fit nor complements do."""
    c = counts(triplets())
    first = packing.evolve(c, generations=0)
    later = packing.evolve(c, first.bins, generations=60, seed=2)
    assert packing.lower_bound(c, 1024) <= len(later.bins) < len(first.bins)


def test_crossover_keeps_every_piece_once():
    noise, lengths = random.Random(2), [random.Random(k).randrange(1, 1025) for k in range(300)]
    best = packing.evolve(counts(lengths), None, [(512, 512), (1000, 24)], 1)
    assert sorted(x for b in best.bins for x in b) == sorted(lengths) and min(best.room) >= 0
    full = [b for b, r in zip(best.bins, best.room) if r == 0][:5]
    child = packing.crossover(best, full, counts(lengths), noise)
    assert full and sorted(x for b in child.bins for x in b) == sorted(lengths) and child.bins[: len(full)] == full


@pytest.mark.parametrize("island_rows", [256, 4096])
def test_islands(spark, island_rows):
    """Over islands too there are fewer sequences than best fit over all pieces at once makes, and no piece is lost."""
    lengths = middling(3) + triplets(4) + [1024] * 5
    own = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    own = packing.cut_lineage(own.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "length", F.col("doc_id").alias("ids_crc32")))
    rows = packing.place(own, island_rows=island_rows).toPandas()
    assert sorted(rows.doc_id) == list(range(len(lengths))) and [lengths[i] for i in rows.doc_id] == rows.length.tolist()
    assert check(rows) < len(best_fit(lengths).bins)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_query_against_the_library(spark):
    """op4 on a whole table: every document's ids as the tokenizers library gives them, in as few sequences as the bound."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rows = QUERIES["op4_best_fit_packing"](spark, SF).toPandas()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for i, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if i == 0 else start + 1024]
            want.append((r.doc_id, i, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted(want) == sorted(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert check(rows) <= len(best_fit([w[3] for w in want]).bins)
