"""Packing into sequences by a grouping genetic algorithm on islands.

A document longer than a sequence is cut into full pieces, a shorter one first; all other documents are one piece. Full
pieces are sequences of their own. The others are dealt by hash of their row to islands of about island_rows, and each
island breeds packings of its own pieces. Pieces of one length are interchangeable, so an island is a table of counts by
length and a packing a list of patterns (the lengths in a bin); only these small tables go through Python, never an id.

An island starts from best fit and from bins filled by their best complements, and is done once it reaches the lower bound.
Else crossover injects whole well-filled bins of one parent into another, takes out the bins whose pieces they hold
already, swaps displaced pieces into bins that they fill better, and best-fits the rest. After each epoch the patterns of an
island's full bins, its elite, migrate to the next island, which crosses in those that its own pieces can make. Last, the
pieces of bins that stayed under settled_fill, with those of some bins of many short pieces, form new islands and are packed
once more, until one island holds what is left, so that few bins in all aren't full.

Null text is empty: a piece of the end id alone. Rows with one id, and null ids, are packed each by itself. An empty table
gives no rows. Of docs only the id and text columns are read."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import cut_lineage, small_batches

CAPACITY, END_ID = 1024, 2
ISLAND_ROWS, EPOCHS, GENERATIONS, POPULATION = 8192, 3, 16, 5
#: Full bins whose patterns leave an island after an epoch.
ELITE = 48
#: A bin that is fuller is settled. For each other bin of an island, so many bins of the most pieces go to the next level
#: with it, as long pieces alone can't be packed better.
SETTLED_FILL, SPARE = 0.998, 6

Pattern = tuple[int, ...]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = tokenizer or default_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in small_batches(batches, "text"):
            own, cut = [], []
            for k, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                for i, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first if i == 0 else start + capacity]
                    own.append(k)
                    cut.append((i, start, len(part), zlib.crc32(part.tobytes())))
            i, start, length, crc = zip(*cut)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), pa.array(i, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Stock:
    """How many pieces of each length are at hand."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.copy()
        self._renew()

    def _renew(self) -> None:
        self.below = np.maximum.accumulate(np.where(self.n > 0, np.arange(len(self.n)), 0))  # the greatest length at hand up to each
        self.lengths = np.flatnonzero(self.n)

    def take(self, pattern: Iterable[int]) -> None:
        gone = False
        for x in pattern:
            self.n[x] -= 1
            gone |= not self.n[x]
        if gone:
            self._renew()

    def give(self, pattern: Iterable[int]) -> None:
        fresh = False
        for x in pattern:
            self.n[x] += 1
            fresh |= self.n[x] == 1
        if fresh:
            self._renew()

    def pair(self, room: int) -> Pattern:
        """The two pieces that fill a room best."""
        a = self.lengths[: np.searchsorted(self.lengths, room // 2, side="right")]
        if not len(a):
            return ()
        b = self.below[room - a]
        twin = (b == a) & (self.n[a] < 2)
        b = np.where(twin, self.below[a - 1], b)
        total = np.where(b > 0, a + b, 0)
        k = int(total.argmax())
        return (int(a[k]), int(b[k])) if total[k] else ()

    def best(self, room: int, noise: random.Random | None = None) -> Pattern:
        """One or two pieces that fill a room best, or three where noise picks the first of them."""
        one = int(self.below[room])
        if not one or one == room:
            return (one,) if one else ()
        found = max(((one,), self.pair(room)), key=sum)
        if noise is not None and sum(found) < room:
            some = self.lengths[: np.searchsorted(self.lengths, room // 2, side="right")]
            for x in some[[noise.randrange(len(some)) for _ in range(min(4, len(some)))]].tolist():
                self.n[x] -= 1  # below may still name x, which take() would mend: checked here instead
                two = self.pair(room - x) if self.n[x] else ()
                self.n[x] += 1
                if sum(two) + x > sum(found):
                    found = (x, *two)
        return found

    def rest(self) -> list[int]:
        """All pieces at hand, the longest first."""
        return np.repeat(self.lengths, self.n[self.lengths])[::-1].tolist()


class Packing:
    """Bins as lists of lengths; best_fit() finds them by the room that they have left."""

    def __init__(self, capacity: int, bins: Iterable[Iterable[int]] = ()):
        self.capacity = capacity
        self.bins = [list(b) for b in bins]
        self.room = [capacity - sum(b) for b in self.bins]

    def add(self, pattern: Iterable[int]) -> None:
        self.bins.append(list(pattern))
        self.room.append(self.capacity - sum(self.bins[-1]))

    def best_fit(self, lengths: Iterable[int]) -> Packing:
        """Each piece into the fullest bin that takes it."""
        by_room: dict[int, list[int]] = {}
        mask = 0
        for b, r in enumerate(self.room):
            if r:
                by_room.setdefault(r, []).append(b)
                mask |= 1 << r
        for x in lengths:
            fits = mask >> x
            if fits:
                r = x + (fits & -fits).bit_length() - 1
                own = by_room[r]
                b = own.pop()
                if not own:
                    mask &= ~(1 << r)
                self.bins[b].append(x)
            else:
                b, r = len(self.bins), self.capacity
                self.bins.append([x])
                self.room.append(r)
            self.room[b] = r = r - x
            if r:
                by_room.setdefault(r, []).append(b)
                mask |= 1 << r
        return self

    def rank(self) -> tuple[int, int]:
        """Fewer bins are better, then the fuller ones: the sum of squares of what is left free."""
        return -len(self.bins), sum(r * r for r in self.room)


def complemented(stock: Stock, capacity: int, noise: random.Random) -> Packing:
    """Bins that start with the longest piece at hand and are filled by the best complements; uses the stock up."""
    out = Packing(capacity)
    while len(stock.lengths):
        own = [int(stock.lengths[-1])]
        stock.take(own)
        room = capacity - own[0]
        while room and (more := stock.best(room, noise) if room > capacity // 2 else stock.best(room)):
            if sum(more) < room and room - sum(more) >= stock.lengths[0] and len(more) == 2:
                more = more[1:]  # there is room for more: the longer one now, complements of the rest after it
            stock.take(more)
            own += more
            room -= sum(more)
        out.add(own)
    return out


def fill_better(packing: Packing, stock: Stock) -> None:
    """Swaps displaced pieces (the stock) for one or two pieces of a bin where they fill it better."""
    for k, own in enumerate(packing.bins):
        if not packing.room[k] or not len(stock.lengths):
            continue
        n = len(own)
        for subset in [(i,) for i in range(n)] + [(i, j) for i in range(n) for j in range(i)][:6]:
            out = [own[i] for i in subset]
            more = stock.best(sum(out) + packing.room[k])
            if sum(more) > sum(out):
                stock.take(more)
                stock.give(out)
                packing.bins[k] = own = [x for i, x in enumerate(own) if i not in subset] + list(more)
                packing.room[k] = packing.capacity - sum(own)
                break


def crossover(into: Packing, injected: Iterable[Pattern], counts: np.ndarray, noise: random.Random) -> Packing:
    """into with the injected bins whole, as far as there are pieces for them. Its bins whose pieces these hold go, as do
    some that aren't full; what they held besides is displaced, swapped in where it fills better, and fitted in."""
    left, child = counts.tolist(), Packing(into.capacity)

    def keep(pattern: Iterable[int]) -> None:
        pattern = list(pattern)
        for i, x in enumerate(pattern):
            left[x] -= 1
            if left[x] < 0:
                for y in pattern[: i + 1]:
                    left[y] += 1
                return
        child.add(pattern)

    for b in injected:
        keep(b)
    for b, r in zip(into.bins, into.room):
        if not r or noise.random() < 0.6:
            keep(b)
    stock = Stock(np.array(left))
    fill_better(child, stock)
    if noise.random() < 0.5:
        return child.best_fit(stock.rest())
    for b in complemented(stock, into.capacity, noise).bins:
        child.add(b)
    return child


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    at = np.arange(len(counts))
    return max(-(-int((counts * at).sum()) // capacity), int(counts[2 * at > capacity].sum()))


def evolve(counts: np.ndarray, start: list[list[int]] | None = None, patterns: Iterable[Pattern] = (), seed: int = 0, capacity: int = CAPACITY, generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """The best packing of counts[x] pieces of each length x, bred from start (an earlier packing of them), best fit,
    complements and immigrant patterns."""
    noise = random.Random(seed)
    least = lower_bound(counts, capacity)
    herd = [Packing(capacity, start) if start is not None else Packing(capacity).best_fit(Stock(counts).rest())]
    best = herd[0]
    if len(best.bins) <= least:
        return best

    def join(child: Packing) -> bool:
        nonlocal best
        herd.append(child)
        best = max(best, child, key=Packing.rank)
        return len(best.bins) <= least

    if patterns and join(crossover(best, patterns, counts, noise)):
        return best
    while len(herd) < population:
        if join(complemented(Stock(counts), capacity, noise)):
            return best
    for _ in range(generations):
        a, b = (max(noise.sample(herd, 2), key=Packing.rank) for _ in range(2))
        full = [x for x, r in zip(b.bins, b.room) if r == 0]
        noise.shuffle(full)
        if join(crossover(a, full[: max(1, int(len(full) * noise.uniform(0.2, 0.8)))], counts, noise)):
            return best
        herd.remove(min(herd, key=Packing.rank))
    return best


def _write(bins: Iterable[Iterable[int]]) -> bytes:
    """Patterns as 32-bit numbers: how many lengths, then these."""
    return np.array([x for b in bins for x in (len(b), *b)], "<u4").tobytes()


def _read(data: bytes | None) -> list[list[int]]:
    flat, out, at = np.frombuffer(data or b"", "<u4").tolist(), [], 0
    while at < len(flat):
        out.append(flat[at + 1 : at + 1 + flat[at]])
        at += 1 + flat[at]
    return out


_STATE = "island long, counts array<long>, bins binary, elite binary, open boolean"


def _epoch(state: DataFrame, epoch: int, capacity: int, generations: int, population: int) -> DataFrame:
    """One epoch of each island, a row each: island, counts (n * (capacity + 1) + length), bins, elite (those of its neighbour)."""
    names = ["island", "counts", "bins", "elite", "open"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                island, packed, data, elite, open_ = (row.column(c)[0].as_py() for c in names)
                if open_:
                    counts = np.zeros(capacity + 1, np.int64)
                    for x in packed:
                        counts[x % (capacity + 1)] = x // (capacity + 1)
                    best = evolve(counts, _read(data) if epoch else None, _read(elite), island * 1000 + epoch, capacity, generations, population)
                    open_, data = len(best.bins) > lower_bound(counts, capacity), _write(best.bins)
                    full = [sorted(b) for b, r in zip(best.bins, best.room) if r == 0 and len(b) > 1]
                    random.Random(island).shuffle(full)
                    elite = _write(full[:ELITE])
                yield pa.RecordBatch.from_arrays([row.column("island"), row.column("counts"), pa.array([data], pa.binary()), pa.array([elite], pa.binary()), pa.array([open_])], names=names)

    return state.select(*names).mapInArrow(run, _STATE)


def settled_bins(length: np.ndarray, own: np.ndarray, capacity: int, settled_fill: float) -> np.ndarray:
    """Which bins of an island stay as they are; length and own (the bin) of its pieces."""
    out = np.bincount(own, length) >= settled_fill * capacity
    by_pieces = np.argsort(-np.bincount(own), kind="stable")
    out[by_pieces[: SPARE * int((~out).sum())]] = False
    return out


def _slots(state: DataFrame, capacity: int, settled_fill: float) -> DataFrame:
    """island, length, rank, bin, offset, settled of the place of every piece: the rank-th (from 1) of that length in the island."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for island, data in zip(batch.column("island").to_pylist(), batch.column("bins").to_pylist()):
                bins = _read(data)
                length = np.array([x for b in bins for x in b], np.int64)
                own = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
                fill = np.bincount(own, length, len(bins)).astype(np.int64)
                offset = np.cumsum(length) - length - (np.cumsum(fill) - fill)[own]
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(length), np.int64)
                first = np.searchsorted(length[order], length[order])
                rank[order] = np.arange(len(length)) - first + 1
                columns = [pa.array(c, pa.int64()) for c in (np.full(len(length), island), length, rank, own, offset)]
                settled = settled_bins(length, own, capacity, settled_fill)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(settled[own])], names=["island", "length", "rank", "bin", "offset", "settled"])

    return state.select("island", "bins").mapInArrow(run, "island long, length long, rank long, bin long, offset long, settled boolean")


def _level(rows: DataFrame, level: int, n_islands: int, epochs: int, capacity: int, settled_fill: float, generations: int, population: int) -> DataFrame:
    """rows (with _row, a number of each) with island, bin, offset and settled."""
    dealt = rows.withColumn("island", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(n_islands)).cast("long"))
    tasks = min(n_islands, 2 * max(dealt.sparkSession.sparkContext.defaultParallelism, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    counts = dealt.groupBy("island", "length").agg(F.count(F.lit(1)).alias("_n")).repartition(tasks, "island")  # by number: small rows, long work
    none = F.lit(None).cast("binary")
    state = counts.groupBy("island").agg(F.sort_array(F.collect_list(F.col("_n") * (capacity + 1) + F.col("length"))).alias("counts"))
    state = state.select("*", none.alias("bins"), none.alias("elite"), F.lit(True).alias("open"))
    for epoch in range(epochs):
        if epoch:
            if n_islands == 1 and epoch > 1 or state.where("open").isEmpty():
                break
            to = F.pmod(F.col("island") + 1, F.lit(n_islands))  # a ring
            arrivals = state.select(to.alias("island"), "elite")
            state = state.drop("elite").join(arrivals, "island").repartition(tasks, "island")
        state = cut_lineage(_epoch(state, epoch, capacity, generations, population))
    order = Window.partitionBy("island", "length").orderBy("_row")  # an island's pieces of one length
    ranked = dealt.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.join(_slots(state, capacity, settled_fill), ["island", "length", "rank"])


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def place(rows: DataFrame, capacity: int = CAPACITY, island_rows: int = ISLAND_ROWS, epochs: int = EPOCHS, settled_fill: float = SETTLED_FILL, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """pieces() with sequence_id and offset. rows must be the same at each reading, as cut_lineage() makes them."""
    rows = rows.select(*_PIECE, F.monotonically_increasing_id().alias("_row"))
    out = rows.where(F.col("length") >= capacity).select(*_PIECE, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows, level, count = rows.where(F.col("length") < capacity), 0, None
    while True:
        before, count = count, rows.count()
        if not count:
            return out
        n_islands = -(-count // island_rows)
        last = n_islands == 1 or before is not None and 4 * count > 3 * before
        state = _level(rows, level, n_islands, epochs, capacity, settled_fill, generations, population)
        settled = F.lit(True) if last else F.col("settled")
        if not last:
            state = cut_lineage(state)
        # levels shrink geometrically, and an island has far fewer than 2 ** 24 bins
        number = F.lit(level << 58).cast("long") + F.shiftleft("island", 24) + F.col("bin")
        out = out.unionByName(state.where(settled).select(*_PIECE, number.alias("sequence_id"), "offset"))
        if last:
            return out
        rows, level = state.where(~settled).select(*_PIECE, "_row"), level + 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, **options) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(cut_lineage(pieces(docs, id_col, text_col, capacity, tokenizer)), capacity, **options)
