"""Join of documents whose word n-gram sets have a Jaccard similarity of at least a threshold.

1. Each document becomes its set of hashed n-grams and a signature of MinHash values. Documents with equal sets are one
   class, represented by its least doc_id; only representatives go on.
2. Bands of the signature give candidate buckets. In a bucket the further MinHash values of each pair are compared
   some at a time, and the pair is dropped once the posterior probability (uniform prior) that its similarity reaches
   the threshold is below the tolerance. The pairs of a bucket beyond bucket_rows are compared in the same way, but not in
   one task: the group that crowded buckets hold together is cut into blocks, every pair of blocks is a task, and only
   signatures travel. So what merely shares a common passage falls apart again.
3. What is left joins into candidate groups. Each group is cut into blocks of bounded size, and every pair of blocks is a
   task: pairs that survive the same pruning are verified exactly on the n-gram sets, all at once by matrix products.
   Tasks give, for each document, how many others it links to and one edge towards its component, never a row a pair. A
   group of n texts that really are alike needs its n * n / 2 comparisons, and each of its sets in n / block_rows tasks.
4. The components of verified links are the classes of near duplicates.

Words are runs of letters and digits in lower case; a text of fewer words than n is one n-gram, a text without words
links to nothing. Documents with a null id are linked to nothing; rows with one id are taken together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, text_buffer
from .components import components
from .textvec import Words

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: Two sets of similarity 0.8 share no band once in 1.7 million times.
BANDS, ROWS = 20, 3
#: MinHash values that are compared after the bands, and how many at a time.
COMPARED, STEP = 64, 16
#: Members of a bucket that one task compares.
BUCKET_ROWS = 512
#: n-grams and documents of a block.
BLOCK_GRAMS, BLOCK_ROWS = 1 << 19, 2048

_noise = np.random.default_rng(20240517)
_MUL = _noise.integers(0, 1 << 63, BANDS * ROWS + COMPARED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _noise.integers(0, 1 << 63, BANDS * ROWS + COMPARED, dtype=np.uint64)


@lru_cache(maxsize=16)
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After so many compared values, the fewest equal ones with which a pair stays: the posterior of similarity s given m
    of n equal, under a uniform prior, is Beta(m + 1, n - m + 1), and P(s >= t) = P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, COMPARED + 1, STEP):
        below, m = 0.0, -1
        while True:
            below += comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            if below >= tolerance:
                break
            m += 1
        out[n] = m + 1
    return out


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its n-grams, each once."""
    words = Words(*text_buffer(pc.utf8_lower(texts)))
    at, h = words.grams(n, short=True)
    first = np.searchsorted(words.doc[at] if len(at) else np.zeros(0, np.int64), np.arange(len(words.first)))
    return [np.unique(h[a:b]) for a, b in zip(first, first[1:])]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit MinHash values for each set; zeros for an empty one."""
    out = np.zeros((len(sets), len(_MUL)), np.uint16)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        every = np.concatenate([sets[i] for i in some])
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]])
        got = np.empty((len(some), len(_MUL)), np.uint16)
        value = np.empty_like(every)
        for k, (a, b) in enumerate(zip(_MUL, _ADD)):
            np.multiply(every, a, out=value)
            np.add(value, b, out=value)
            got[:, k] = np.minimum.reduceat(value, first) & np.uint64(0xFFFF)
        out[some] = got
    return out


def describe(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id, n_grams, set_hash and sig of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = gram_sets(batch.column("text"), n)
            sig = signatures(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "n_grams", "set_hash", "sig"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_grams long, set_hash binary, sig binary")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component under edges i - j."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            break
    return root


@lru_cache(maxsize=64)
def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay when values are compared some at a time."""
    equal = np.zeros(len(i), np.int16)
    for n in sorted(least):
        part = sig[:, n - STEP : n]
        equal += (part[i] == part[j]).sum(1, dtype=np.int16)
        stay = equal >= least[n]
        i, j, equal = i[stay], j[stay], equal[stay]
    return i, j


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        edges = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(own[:, a].tolist())
            if key != last and held:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held


def _candidates(rows: DataFrame, least: dict[int, int]) -> DataFrame:
    """Edges a, b that span the surviving pairs of each bucket; rows: key, rep, more (compared values), sorted by key."""
    kind = rows.schema["rep"].dataType.simpleString()

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held).combine_chunks()
        key, rep = table["key"].to_numpy(), table["rep"].to_numpy()
        sig = np.frombuffer(b"".join(table["more"].to_pylist()), np.uint16).reshape(len(key), COMPARED)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        got_i, got_j, part_i, part_j, held_pairs = [], [], [], [], 0
        for a, n in zip(edges.tolist(), np.diff(edges).tolist()):
            if n > 1:
                i, j = _upper(n)
                part_i.append(i + a)
                part_j.append(j + a)
                held_pairs += len(i)
            if part_i and (held_pairs > 200_000 or a + n == len(key)):
                i, j = survivors(sig, np.concatenate(part_i), np.concatenate(part_j), least)
                got_i.append(i)
                got_j.append(j)
                part_i, part_j, held_pairs = [], [], 0
        if not got_i:
            return None
        root = roots(len(key), np.concatenate(got_i), np.concatenate(got_j))
        a, b = rep, rep[root]
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for group in groups_of(batches, ["key"]):
            held += group
            count += sum(x.num_rows for x in group)
            if count >= 20_000:
                if out := flush(held):
                    yield out
                held, count = [], 0
        if held and (out := flush(held)):
            yield out

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def intersections(left: list[np.ndarray], right: list[np.ndarray], often: int = 24, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of left with every set of right. Hashes that many sets have go through a
    matrix product, some columns at a time; the few sets of a rare one are paired."""
    n = len(left)
    sets = [*left, *right]
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    first = np.concatenate([[0], np.flatnonzero(every[1:] != every[:-1]) + 1, [len(every)]]) if len(every) else np.zeros(1, np.int64)
    count = np.diff(first)
    out = np.zeros((n, len(right)), np.float32)
    common = np.flatnonzero(count >= often)
    column = np.full(len(count), -1)
    column[common] = np.arange(len(common))
    at = np.repeat(column, count)
    for c in range(0, len(common), columns):
        own = (at >= c) & (at < c + columns)
        x = np.zeros((len(sets), min(columns, len(common) - c)), np.float32)
        x[row[own], at[own] - c] = 1
        out += x[:n] @ x[n:].T
    rare = np.repeat((count > 1) & (count < often), count)
    every, row = every[rare], row[rare]
    for d in range(1, often):
        same = np.flatnonzero(every[d:] == every[:-d]) if len(every) > d else ()
        if not len(same):
            break
        a, b = row[same], row[same + d]  # rows ascend within a hash
        across = (a < n) & (b >= n)
        np.add.at(out, (a[across], b[across] - n), 1)
    return out


def alive(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs stay when values are compared some at a time."""
    out = np.ones((len(left), len(right)), bool)
    for r in range(0, len(left), 256):
        equal = np.zeros((len(left[r : r + 256]), len(right)), np.uint8)
        for n in sorted(least):
            for k in range(n - STEP, n):
                equal += left[r : r + 256, k, None] == right[None, :, k]
            out[r : r + 256] &= equal >= least[n]
            if not out[r : r + 256].any():
                break
    return out


def _pairs_of_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (label, block of blocks, rep, columns) once for each pair i <= j of blocks of its label that it is in, dealt by
    the pair and sorted."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o")
    pairs = rows.select("*", other).select("label", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "rep", "block", *columns)
    return pairs.repartition(F.col("label"), F.col("i"), F.col("j")).sortWithinPartitions("label", "i", "j", "rep")


def _blocks(count: Column, column: str) -> list[Column]:
    return [count.cast("int").alias("blocks"), F.pmod(F.xxhash64(column), count).cast("int").alias("block")]


def _prune(rows: DataFrame, least: dict[int, int]) -> DataFrame:
    """Edges a, b that span the surviving pairs of each label; rows: _pairs_of_blocks() with more."""
    kind = rows.schema["rep"].dataType.simpleString()

    def check(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(group).combine_chunks()
        rep, block = table["rep"], table["block"].to_numpy()
        more = np.frombuffer(b"".join(table["more"].to_pylist()), np.uint16).reshape(len(block), COMPARED)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(one) or not len(two):
            return None
        mask = alive(more[one], more[two], least)
        a, b = np.nonzero(np.triu(mask, 1) if i == j else mask)
        root = roots(len(block), one[a], two[b])
        some = np.flatnonzero(root != np.arange(len(block)))
        return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rep.take(pa.array(some)), rep.take(pa.array(root[some])))], names=["a", "b"]) if len(some) else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["label", "i", "j"]):
            if (out := check(group)) is not None:
                yield out

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _verify(rows: DataFrame, threshold: float, least: dict[int, int]) -> DataFrame:
    """rep, root, n_texts, n_docs: the links of each document in each pair of blocks; rows sorted by label, i, j, rep."""
    kind = rows.schema["rep"].dataType.simpleString()

    def check(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(group).combine_chunks()
        raw = table["grams"].to_pylist()
        rep, block, copies = (table[c].to_numpy() for c in ("rep", "block", "copies"))
        fresh = np.array([k == 0 or rep[k] != rep[k - 1] or raw[k] != raw[k - 1] for k in range(len(raw))])
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        one, two = np.flatnonzero(fresh & (block == i)), np.flatnonzero(fresh & (block == j))
        if not len(one) or not len(two):
            return None
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        more = np.frombuffer(b"".join(table["more"].to_pylist()), np.uint16).reshape(len(raw), COMPARED)
        size = np.array([len(s) for s in sets], np.float64)
        mask = alive(more[one], more[two], least)
        if i == j:
            mask = np.triu(mask, 1)
        if not mask.any():
            return None
        both = intersections([sets[k] for k in one], [sets[k] for k in two])
        mask &= both >= threshold * (size[one][:, None] + size[two][None, :] - both) - 1e-6
        a, b = np.nonzero(mask)
        if not len(a):
            return None
        texts, docs = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        for x, y, axis in ((one, two, 1), (two, one, 0)):
            np.add.at(texts, x, mask.sum(axis))
            weight = copies[y].astype(np.float64)
            np.add.at(docs, x, (mask @ weight if axis else weight @ mask).astype(np.int64))
        root = roots(len(raw), one[a], two[b])
        some = np.flatnonzero(texts)
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(texts[some]), pa.array(docs[some])], names=["rep", "root", "n_texts", "n_docs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["label", "i", "j"]):
            if (out := check(group)) is not None:
                yield out

    return rows.mapInArrow(run, f"rep {kind}, root {kind}, n_texts long, n_docs long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, bucket_rows: int = BUCKET_ROWS, block_grams: int = BLOCK_GRAMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each document: doc_id, class_id (the least doc_id of its component of links), copy_id (the least doc_id
    with the same n-grams), n_links (other documents at or above the threshold) and n_texts (different texts among them)."""
    least = least_matches(threshold, tolerance)
    every = cut_lineage(describe(docs, id_col, text_col, n))
    rows = every.where("n_grams > 0 and doc_id is not null")
    classes = cut_lineage(rows.groupBy("set_hash").agg(F.min(F.struct("doc_id", "sig")).alias("_m"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams")).select("set_hash", F.col("_m.doc_id").alias("rep"), F.col("_m.sig").alias("sig"), "copies", "n_grams"))
    more = F.expr(f"substring(sig, {2 * BANDS * ROWS + 1}, {2 * COMPARED})")
    bands = F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(sig, {2 * ROWS * b + 1}, {2 * ROWS})")) for b in range(BANDS)])
    slots = classes.select("rep", F.explode(bands).alias("key"))
    buckets = slots.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).where("n > 1")
    members = cut_lineage(slots.join(buckets, "key"))
    crowded = members.where((F.col("n") > bucket_rows) & (F.col("rep") != F.col("first"))).select(F.col("rep").alias("a"), F.col("first").alias("b"))
    small = members.where(F.col("n") <= bucket_rows).select("key", "rep").join(classes.select("rep", more.alias("more")), "rep")
    edges = _candidates(small.repartition(F.col("key")).sortWithinPartitions("key", "rep"), least)
    if not crowded.isEmpty():
        # all pairs of signatures within what crowded buckets hold together
        held = components(crowded)
        size = held.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_n"))
        held = held.join(size, "root").select(F.col("v").alias("rep"), F.col("root").alias("label"), *_blocks(F.col("_n"), "v"))
        held = held.join(classes.select("rep", more.alias("more")), "rep")
        edges = edges.unionByName(_prune(_pairs_of_blocks(held, ["more"]), least))
    found = components(edges)
    # candidate groups and their blocks
    part = found.join(classes.groupBy(F.col("rep").alias("v")).agg(F.max("copies").alias("copies"), F.sum("n_grams").alias("n_grams")), "v")
    size = part.groupBy("root").agg(F.sum("n_grams").alias("_g"), F.count(F.lit(1)).alias("_n"))
    size = size.select("root", F.greatest(F.ceil(F.col("_g") / block_grams), F.ceil(F.col("_n") / block_rows)).alias("_n"))
    part = part.join(size, "root").select(F.col("v").alias("rep"), F.col("root").alias("label"), "copies", *_blocks(F.col("_n"), "v"))
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(part.hint("shuffle_hash"), "rep")
    kind = texts.schema["rep"].dataType.simpleString()
    keep = ["rep", "label", "copies", "blocks", "block"]

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = gram_sets(batch.column("text"), n)
            sig = signatures(sets)[:, BANDS * ROWS :]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=[*keep, "grams", "more"])

    sets = texts.select(*keep, "text").mapInArrow(grams, f"rep {kind}, label {kind}, copies long, blocks int, block int, grams binary, more binary")
    links = cut_lineage(_verify(_pairs_of_blocks(sets, ["copies", "grams", "more"]), threshold, least))
    near = components(links.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    total = links.groupBy("rep").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    known = classes.select("set_hash", "rep", "copies").join(total, "rep", "left").join(near.select(F.col("v").alias("rep"), "root"), "rep", "left")
    out = every.select("doc_id", "set_hash", "n_grams").join(known, (every["set_hash"] == known["set_hash"]) & every["doc_id"].isNotNull() & (every["n_grams"] > 0), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("root", "rep", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_id"), (F.coalesce("n_docs", zero) + F.coalesce(F.col("copies") - 1, zero)).alias("n_links"), F.coalesce("n_texts", zero).alias("n_texts"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs, with all its columns, without those that aren't the least of their class."""
    drop = join(docs, id_col, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(drop, docs[id_col] == drop["_gone"], "left_anti")
