"""Benchmark decontamination: a broadcast set of the hashes of test n-grams, scanned over all training windows.

A word is a run of a-z, 0-9 and characters from U+0080 on, once A-Z are lower-cased. A window is n words of an item in a
row; an item of fewer words (not none) is one window. Every window of every document is hashed; what the set holds is
then compared word by word.

While the items' texts have max_bytes at most, they come to the driver and go out as one broadcast of flat arrays, about
five times that. Beyond it nothing of the benchmark is collected but a bit filter of fixed size: windows that pass the
filter are joined to the benchmark's own by hash and words. Both ways give the same rows.

Null text has no words; an empty benchmark hits nothing. Rows that repeat an id, or have none, are scanned each by itself, as
are texts of any length; items that repeat an id count
once, and a null item id is the empty one. Other columns than the id and text stay as they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, text_buffer
from .textvec import Words

#: Bytes of item texts that are broadcast.
MAX_BYTES = 8 << 20
#: Bits of the filter beyond that, a power of two of 64 at least.
FILTER_BITS = 1 << 26


class Windows:
    """The windows of some items in flat arrays, sorted by size and hash."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.ids = [i for i, _ in items]
        words = Words(*text_buffer(pa.array([t for _, t in items], pa.large_string())))
        at, h = words.grams(n, short=True)
        count = np.diff(words.first)
        self.low, self.start, self.end = words.low, words.start, words.end
        size = np.minimum(count[words.doc[at]], n) if len(at) else np.zeros(0, np.int64)
        order = np.lexsort([words.doc[at], h, size]) if len(at) else np.zeros(0, np.int64)
        self.at, self.item, self.hash = at[order], (words.doc[at][order] if len(at) else order).astype(np.int32), h[order]
        self.sizes = {int(k): (int(np.searchsorted(size[order], k)), int(np.searchsorted(size[order], k, side="right"))) for k in np.unique(size)}
        self._tables: dict[int, np.ndarray] = {}
        self._known: dict[tuple[int, int], dict[bytes, list[int]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": {}, "_known": {}}  # what each worker makes for itself

    def _table(self, size: int) -> np.ndarray:
        """Whether any window of that size has a hash with these low bits."""
        if size not in self._tables:
            a, b = self.sizes[size]
            table = np.zeros(1 << max(16, (8 * (b - a)).bit_length()), bool)
            table[(self.hash[a:b] & np.uint64(len(table) - 1)).astype(np.int64)] = True
            self._tables[size] = table
        return self._tables[size]

    def _items(self, size: int, h: int, words: bytes) -> list[int]:
        """The items that have a window of these words."""
        known = self._known.get((size, h))
        if known is None:
            known = self._known[size, h] = {}
            a, b = self.sizes[size]
            first, last = (a + int(np.searchsorted(self.hash[a:b], np.uint64(h), side=x)) for x in ("left", "right"))
            for at, item in zip(self.at[first:last].tolist(), self.item[first:last].tolist()):
                own = known.setdefault(b" ".join(self.low[x:y].tobytes() for x, y in zip(self.start[at : at + size], self.end[at : at + size])), [])
                if own[-1:] != [item]:
                    own.append(item)
        return known.get(words, [])

    def scan(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are inside an occurrence of a window, and for each text the items that have one in it."""
        edge = np.zeros(len(words.start) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
        for size, (a, b) in self.sizes.items():
            at, h = words.grams(size)
            table, known = self._table(size), self.hash[a:b]
            some = np.flatnonzero(table[(h & np.uint64(len(table) - 1)).astype(np.int64)])
            some = some[known[np.minimum(np.searchsorted(known, h[some]), len(known) - 1)] == h[some]]
            for i, key in zip(at[some].tolist(), h[some].tolist()):
                if own := self._items(size, key, words.joined(i, size)):
                    edge[i] += 1
                    edge[i + size] -= 1
                    items[words.doc[i]].update(self.ids[k] for k in own)
        return np.cumsum(edge[:-1]) > 0, items


def _texts(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text"))


def _broadcast(benchmark: DataFrame, n: int, max_bytes: int):
    """The broadcast windows of all items, or None where their texts exceed max_bytes."""
    if (benchmark.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0) > max_bytes:
        return None
    return benchmark.sparkSession.sparkContext.broadcast(Windows([(r.id, r.text) for r in benchmark.collect()], n))


_HIT = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_FOUND = "n_words long, hits array<struct<first: long, last: long>>, n_hit long, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """For each document: doc_id, n_words, hits (array of struct<first, last>: byte ranges of hit words in a row, in the
    UTF-8 text), n_hit, items (array of the item ids as strings, sorted)."""
    texts = _texts(benchmark, item_id, item_text)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    windows = _broadcast(texts, n, max_bytes)
    if windows is None:
        return _joined(rows, texts, n, filter_bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            words = Words(*(data := text_buffer(batch.column("text"))))
            hit, items = windows.value.scan(words)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[words.first[1:]] - total[words.first[:-1]]
            begin = hit.copy()
            begin[1:] &= ~(hit[:-1] & (words.doc[1:] == words.doc[:-1]))
            end = hit.copy()
            end[:-1] &= ~(hit[1:] & (words.doc[1:] == words.doc[:-1]))
            begin, end = np.flatnonzero(begin), np.flatnonzero(end)
            ranges: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for d, a, b in zip(words.doc[begin].tolist(), words.start[begin].tolist(), words.end[end].tolist()):
                base = int(data[1][d])
                ranges[d].append({"first": a - base, "last": b - base})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(ranges, pa.list_(_HIT)), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "hits", "n_hit", "items"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, {_FOUND}")


def _window_rows(texts: DataFrame, n: int) -> DataFrame:
    """size, h, words, items of every window of the benchmark, made where its rows are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            words = Words(*text_buffer(batch.column("text")))
            at, h = words.grams(n, short=True)
            size = np.minimum(np.diff(words.first)[words.doc[at]], n) if len(at) else np.zeros(0, np.int64)
            joined = [words.joined(i, k).decode() for i, k in zip(at.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(words.doc[at])), pa.array(size, pa.int32()), pa.array(h.view(np.int64)), pa.array(joined, pa.string())], names=["item", "size", "h", "words"])

    rows = texts.mapInArrow(run, "item string, size int, h long, words string")
    return rows.groupBy("size", "h", "words").agg(F.collect_set("item").alias("items"))


def merged(places: list[dict]) -> tuple[int, list[dict]]:
    """How many words windows cover (each with pos, size, first, last), and the byte ranges of covered words in a row."""
    count, upto, out = 0, -1, []
    for x in sorted(places, key=lambda x: (x["pos"], x["size"])):
        stop = x["pos"] + x["size"]
        if out and x["pos"] <= upto:
            if stop > upto:
                count += stop - upto
                upto, out[-1]["last"] = stop, x["last"]
        else:
            count += x["size"]
            upto = stop
            out.append({"first": x["first"], "last": x["last"]})
    return count, out


def _joined(rows: DataFrame, texts: DataFrame, n: int, filter_bits: int) -> DataFrame:
    """scan() for a benchmark that isn't broadcast; rows: doc_id, text."""
    sc, kind = rows.sparkSession.sparkContext, rows.schema["doc_id"].dataType.simpleString()
    windows = cut_lineage(_window_rows(texts, n))
    sizes = [r.size for r in windows.select("size").distinct().collect()]  # n at most
    low = F.col("h").bitwiseAND(F.lit(filter_bits - 1))
    marks = windows.select(F.shiftright(low, 6).alias("i"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    marks = marks.toArrow()  # a row for each 64 bits of the filter at most
    table = np.zeros(filter_bits // 64, np.int64)
    table[marks["i"].to_numpy()] = marks["b"].to_numpy()
    shipped = sc.broadcast(table.view(np.uint64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in small_batches(batches, "text"):
            words = Words(*(data := text_buffer(batch.column("text"))))
            places: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for size in sizes:
                at, h = words.grams(size)
                slot = h & np.uint64(filter_bits - 1)
                for k in np.flatnonzero(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).tolist():
                    i, d = int(at[k]), int(words.doc[at[k]])
                    base = int(data[1][d])
                    places[d].append({"pos": i - int(words.first[d]), "size": size, "h": int(h[k : k + 1].view(np.int64)[0]), "words": words.joined(i, size).decode(), "first": int(words.start[i]) - base, "last": int(words.end[i + size - 1]) - base})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(places, place)], names=["doc_id", "n_words", "places"])

    place = pa.list_(pa.struct([("pos", pa.int64()), ("size", pa.int32()), ("h", pa.int64()), ("words", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    # the rows of a checkpoint stay where they are, so their numbers tell them apart
    seen = cut_lineage(rows.mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<pos: long, size: int, h: long, words: string, first: long, last: long>>")).withColumn("_row", F.monotonically_increasing_id())
    found = seen.select("_row", F.inline("places")).join(windows, ["size", "h", "words"])
    found = found.groupBy("_row").agg(F.collect_set(F.struct("pos", F.col("size").cast("long").alias("size"), "first", "last")).alias("places"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [merged(x) for x in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([h for _, h in got], pa.list_(_HIT)), pa.array([c for c, _ in got], pa.int64()), batch.column("items")], names=["_row", "hits", "n_hit", "items"])

    found = found.select("_row", "places", "items").mapInArrow(merge, "_row long, hits array<struct<first: long, last: long>>, n_hit long, items array<string>")
    out = seen.select("_row", "doc_id", "n_words").join(found, "_row", "left")
    return out.select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<struct<first: long, last: long>>")).alias("hits"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without(text: bytes, hits: list[dict]) -> str:
    """The text without the byte ranges."""
    out, last = [], 0
    for x in hits:
        out.append(text[last : x["first"]])
        last = x["last"]
    return b"".join([*out, text[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with all its columns, without the documents that hold a window (mode "documents"), or with the hit words and
    what is between them cut out of the text (mode "spans")."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode: {mode!r}")
    windows = _broadcast(texts := _texts(benchmark, item_id, item_text), n, max_bytes)
    at, kind = docs.columns.index(text_col), docs.schema
    if windows is None:
        rows = cut_lineage(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))).withColumn("_row", F.monotonically_increasing_id())
        found = _joined(rows.select(F.col("_row").alias("doc_id"), F.col(f"_doc.`{text_col}`").alias("text")), texts, n, filter_bits).where("n_hit > 0").select(F.col("doc_id").alias("_row"), "hits")
        if mode == "documents":
            return rows.join(found, "_row", "left_anti").select("_doc.*")
        docs = rows.join(found, "_row", "left").select("_doc.*", F.col("hits").alias("_hits"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            texts = [t if h is None or t is None else without(t.encode(), h) for t, h in zip(columns[at].to_pylist(), batch.columns[-1].to_pylist())]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            column = batch.column(at)
            words = Words(*(data := text_buffer(column)))
            hit = windows.value.scan(words)[0]
            bad = np.zeros(batch.num_rows, bool)
            bad[words.doc[hit]] = True
            if mode == "documents":
                yield batch.filter(pa.array(~bad))
                continue
            texts = column.to_pylist()
            for d in np.flatnonzero(bad).tolist():
                own = np.arange(words.first[d], words.first[d + 1])
                own, base = own[hit[own]], int(data[1][d])
                edge = np.flatnonzero(np.diff(own) != 1)
                first, last = own[np.concatenate([[0], edge + 1])], own[np.concatenate([edge, [len(own) - 1]])]
                texts[d] = without(texts[d].encode(), [{"first": a - base, "last": b - base} for a, b in zip(words.start[first].tolist(), words.end[last].tolist())])
            columns = batch.columns
            columns[at] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(cut if windows is None else run, kind)


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of query op6 from scan()."""
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def sorted_digest(ids: Iterable[object]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
