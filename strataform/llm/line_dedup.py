"""Line dedup by winnowing over line hashes, in DataFrame operations alone.

Lines that aren't blank are hashed. From each line on, the shortest run of lines with noise_words words or more is a gram,
and the shortest run of min_words words or more is a window; the least gram that fits into a window is its fingerprint. So
any run of min_words words that two places share has a common fingerprint, and fingerprints that occur once are done with.
The others are joined: around each, every window that has it is matched to the first place of the corpus (in order of
doc_id, then line) with an equal window, which extends the match both ways. As the windows are shortest from each line on,
and from each line back, every line of a repeated run of min_words words or more is in a window that repeats, whatever
other contexts its fingerprint has. Matched windows are deleted from the later place. Every deleted line has an equal one
at an earlier place, so the first stays.

Null text counts as empty. Rows that repeat an id with equal text are one place and lose the same lines; blank lines stay.
Only where all lines of a text go does it become empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, salts

MIN_WORDS, NOISE_WORDS = 50, 25
_KEY = ["_id", "_t"]


def _items(lines: Column) -> Column:
    """h, h2 (two hashes), w of each line that isn't blank."""
    every = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(2), x).alias("h2"), F.size(F.regexp_extract_all(x, F.lit("\\S+"), F.lit(0))).alias("w")))
    return F.filter(every, lambda x: x["w"] > 0)


def fingerprints(lines: DataFrame, min_words: int, noise_words: int) -> DataFrame:
    """_id, _t, pos, g (hash) of the fingerprints, and of the windows that have each: lo, hi (first and last line), k, k2
    (hashes), arrays all; lines: _id, _t, pos (from 0), h, h2, w."""
    place = Window.partitionBy(*_KEY)
    before = place.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select(*_KEY, "pos", "h", "h2", "w", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("at"), F.sum("w").over(place).alias("total")).where(F.col("total") >= min_words)
    gram = place.orderBy("at").rangeBetween(0, noise_words - 1)  # lines that start before noise_words words are over
    ahead = place.orderBy("at").rangeBetween(0, min_words - 1)
    rows = rows.select("*", (F.col("at") + F.col("w")).alias("end"), F.xxhash64(F.collect_list("h").over(gram)).alias("g"), F.xxhash64(F.collect_list("h").over(ahead)).alias("k"), F.xxhash64(F.collect_list("h2").over(ahead)).alias("k2"), F.max("pos").over(ahead).alias("hi"))
    fits = place.orderBy("at").rangeBetween(0, min_words - noise_words)
    least = F.min(F.when(F.col("total") - F.col("at") >= noise_words, F.struct("g", "pos"))).over(fits)
    rows = rows.select("*", F.when(F.col("total") - F.col("at") >= min_words, least).alias("m"))
    rows = rows.select("*", F.struct(*[F.lead(c).over(place.orderBy("at")).alias(c) for c in ("m", "hi", "pos")]).alias("next"))
    # windows from each line back: the line before it is the last that ends min_words words earlier
    back = place.orderBy("end").rangeBetween(-(min_words - 1), 0)
    so_far = place.orderBy("end").rangeBetween(Window.unboundedPreceding, -min_words)
    start = F.coalesce(F.last("next").over(so_far), F.first(F.struct("m", "hi", "pos")).over(place.orderBy("end").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select("*", start.alias("s"), F.xxhash64(F.collect_list("h").over(back)).alias("bk"), F.xxhash64(F.collect_list("h2").over(back)).alias("bk2"))
    forward = F.when(F.col("m").isNotNull(), F.struct("m", F.col("pos").alias("lo"), "hi", "k", "k2"))
    backward = F.when((F.col("end") >= min_words) & (F.col("s.hi") != F.col("pos")), F.struct(F.col("s.m").alias("m"), F.col("s.pos").alias("lo"), F.col("pos").alias("hi"), F.col("bk").alias("k"), F.col("bk2").alias("k2")))
    rows = rows.select(*_KEY, F.explode(F.array_compact(F.array(forward, backward))).alias("x"))
    rows = rows.select(*_KEY, F.col("x.m.pos").alias("pos"), F.col("x.m.g").alias("g"), "x.lo", "x.hi", "x.k", "x.k2")
    return rows.groupBy(*_KEY, "pos").agg(F.first("g").alias("g"), *[F.collect_list(c).alias(c) for c in ("lo", "hi", "k", "k2")])  # one row feeds all four lists


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, noise_words: int = NOISE_WORDS) -> DataFrame:
    """_id, _t and runs (array of struct<lo, hi>, numbers of lines that aren't blank) to delete, each line in one run at
    most; docs: _id, _t, items."""
    hashes = [F.transform("items", lambda x: x["h"]).alias("h"), F.transform("items", lambda x: x["h2"]).alias("h2"), F.transform("items", lambda x: x["w"]).alias("w")]
    lines = docs.select(*_KEY, *hashes).dropDuplicates(_KEY).select(*_KEY, F.posexplode(F.arrays_zip("h", "h2", "w")).alias("pos", "x")).select(*_KEY, "pos", "x.h", "x.h2", "x.w")
    prints = cut_lineage(fingerprints(lines, min_words, noise_words))
    repeated = prints.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    windows = prints.join(repeated, "g").select(*_KEY, F.explode(F.arrays_zip("lo", "hi", "k", "k2")).alias("x")).select(*_KEY, "x.lo", "x.hi", "x.k", "x.k2")
    # equal windows of a large group of copies are dealt by salt, so no task gets them all; first goes to the salts that are there
    windows = windows.withColumn("salt", F.pmod(F.xxhash64(*_KEY, "lo"), F.lit(salts(docs.sparkSession))).cast("int"))
    first = windows.groupBy("k", "k2").agg(F.min(F.struct(*_KEY, "lo")).alias("f"), F.count(F.lit(1)).alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    first = first.select("k", "k2", "f", F.explode("salts").alias("salt"))
    later = windows.join(first, ["k", "k2", "salt"]).where(F.struct(*_KEY, "lo") > F.col("f"))
    runs = later.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("runs"))  # windows of one text
    # in order of their first lines windows never end earlier than the one before, so each adds what lies beyond that
    added = F.transform("runs", lambda r, i: F.struct(F.when(i > 0, F.greatest(r["lo"], F.get("runs", i - 1)["hi"] + 1)).otherwise(r["lo"]).alias("lo"), r["hi"].alias("hi")))
    return runs.select(*_KEY, F.filter(added, lambda r: r["lo"] <= r["hi"]).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, noise_words: int = NOISE_WORDS) -> DataFrame:
    """_row (a struct of docs' columns as they were), _text without the later repeated runs, _lines, and _removed, the
    numbers (from 0) of the lines that went."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"))
    lines = lambda t: F.split(F.coalesce(t, F.lit("")), "\n", -1)
    items = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), _items(lines(F.col(text_col))).alias("items"))
    runs = repeated_runs(items, min_words, noise_words).hint("shuffle_hash")
    rows = base.join(runs, (base["_t"] == runs["_t"]) & base["_id"].eqNullSafe(runs["_id"]), "left").select("_row", lines(F.col(f"_row.`{text_col}`")).alias("_all"), "runs")
    nos = F.transform(F.filter(F.transform("_all", lambda x, i: F.struct(i.alias("no"), x.rlike("\\S").alias("some"))), lambda x: x["some"]), lambda x: x["no"])
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.slice("_nos", r["lo"] + 1, r["hi"] - r["lo"] + 1)))))
    rows = rows.withColumn("_nos", F.when(F.col("runs").isNotNull(), nos)).withColumn("_removed", F.coalesce(gone, F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_removed"))
    kept = F.when(F.size("_removed") > 0, F.array_join(F.transform(left, lambda i: F.element_at("_all", i + 1)), "\n")).otherwise(F.col(f"_row.`{text_col}`"))
    return rows.select("_row", kept.alias("_text"), F.size("_all").alias("_lines"), "_removed")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: doc_id, text, n_lines, n_removed, removed."""
    rows = dedup_lines(docs, id_col, text_col, **options)
    return rows.select(F.col(f"_row.`{id_col}`").alias("doc_id"), F.coalesce("_text", F.lit("")).alias("text"), F.col("_lines").cast("long").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"), F.col("_removed").alias("removed"))


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """docs, with all its columns, with the deduplicated texts (and their lengths in length_col); a document of which
    nothing is left goes."""
    rows = dedup_lines(docs, id_col, text_col, **options)
    rows = rows.where((F.size("_removed") == 0) | F.col("_text").rlike("\\S"))

    def column(c: str) -> Column:
        was = F.col(f"_row.`{c}`")
        if c == text_col:
            return F.col("_text").alias(c)
        if c == length_col:
            return F.when(F.size("_removed") > 0, F.length("_text").cast(docs.schema[c].dataType)).otherwise(was).alias(c)
        return was.alias(c)

    return rows.select(*[column(c) for c in docs.columns])
