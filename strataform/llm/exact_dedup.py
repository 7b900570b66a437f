"""Exact dedup by composable polynomial fingerprints.

The bytes of a normalised text are the digits of a number in base 256; its remainders by three primes are the
fingerprint. Remainders compose: fp(a + b) = fp(a) * 256**len(b) + fp(b), so the chunks of a huge text are hashed apart,
dealt over all tasks, and combined by length-shifted arithmetic. Texts of equal fingerprint and length are then compared
chunk by chunk: in each group the least and the greatest chunk at a place must be the same bytes. That comparison is an
aggregate with map-side combine, so a group of any size reaches a reducer as one row from each task. Groups that it
refutes are split by their SHA-256.

Null counts as empty. Rows of one doc_id that repeat all stay or go together; a null doc_id is less than any other."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, salts

#: Primes below 2**31, so that products fit a long.
PRIMES = (2147483629, 2147483587, 2147483579)
#: Bytes of a chunk.
CHUNK = 1 << 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def chunk_hash(data: bytes) -> list[int]:
    """For each prime the remainder of the bytes as a number and of 256 ** len: what combining needs."""
    number = int.from_bytes(data, "big")
    return [x for p in PRIMES for x in (number % p, pow(256, len(data), p))]


_HASHES = [f"_{kind}{i}" for i in range(len(PRIMES)) for kind in ("h", "w")]


def hash_chunks(chunks: DataFrame) -> DataFrame:
    """_chunk (binary) replaced by the parts of its hash."""
    keep = [c for c in chunks.columns if c != "_chunk"]
    schema = ", ".join([f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in _HASHES])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [chunk_hash(x.as_buffer() if x.is_valid else b"") for x in batch.column("_chunk")]
            parts = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(_HASHES))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + parts, names=[*keep, *_HASHES])

    return chunks.mapInArrow(run, schema)


def combined(i: int) -> Column:
    """The fingerprint of a text by prime i from its chunks, an array of structs in order."""
    p = PRIMES[i]
    return F.aggregate("_parts", F.lit(0).cast("long"), lambda h, x: (h * x[f"_w{i}"] + x[f"_h{i}"]) % F.lit(p).cast("long"))


def chunked(df: DataFrame, chunk: int) -> DataFrame:
    """A row for each chunk of _bytes: _no and _chunk; one empty chunk for an empty text."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("_bytes") - 1, F.lit(0)).cast("int"), F.lit(chunk))
    return df.select("*", F.posexplode(starts).alias("_no", "_at")).select(*[c for c in df.columns if c != "_bytes"], "_no", F.expr(f"substring(_bytes, _at + 1, {chunk})").alias("_chunk"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, fp0.. and text_sha256 of each row's normalised text."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_raw"))
    ready = lambda df: df.select("doc_id", normalised(F.col("_raw")).alias("_norm")).select("doc_id", F.octet_length("_norm").cast("long").alias("n_bytes"), F.sha2("_norm", 256).alias("text_sha256"), F.encode("_norm", "utf-8").alias("_bytes"))
    long = F.coalesce(F.octet_length("_raw"), F.lit(0)) > chunk
    small = hash_chunks(ready(text.where(~long)).withColumnRenamed("_bytes", "_chunk"))
    small = small.select("doc_id", "n_bytes", "text_sha256", *[F.col(f"_h{i}").alias(f"fp{i}") for i in range(len(PRIMES))])
    huge = chunked(ready(text.where(long)), chunk)
    parts = hash_chunks(huge.repartition(F.col("text_sha256"), F.col("_no")))  # the chunks of one text over all tasks
    key = ["doc_id", "n_bytes", "text_sha256"]
    # equal chunk numbers of repeated rows hold equal parts, so a set has each once
    whole = parts.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("_no", *_HASHES))).alias("_parts"), F.count(F.when(F.col("_no") == 0, 1)).cast("int").alias("_rows"))
    whole = whole.select(*key, *[combined(i).alias(f"fp{i}") for i in range(len(PRIMES))], F.explode(F.array_repeat(F.lit(1), F.col("_rows"))).alias("_")).drop("_")
    return small.unionByName(whole)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    fp = [f"fp{i}" for i in range(len(PRIMES))] + ["n_bytes"]
    n_salts = salts(spark)
    rows = cut_lineage(fingerprints(docs, id_col, text_col, chunk).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(n_salts)).cast("int")))

    def groups(key: list[str], of: DataFrame) -> DataFrame:
        """Groups of two rows or more, once for each salt that they have."""
        part = of.groupBy(*key, "_salt").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n"), F.max(F.col("doc_id").isNull()).alias("_null"))
        whole = part.groupBy(*key).agg(F.min("_least").alias("_least"), F.sum("_n").alias("group_size"), F.max("_null").alias("_null"), F.collect_list("_salt").alias("_salts"))
        return whole.where("group_size > 1").select(*key, F.when(~F.col("_null"), F.col("_least")).alias("_keep"), "group_size", F.explode("_salts").alias("_salt"))

    found = cut_lineage(groups(fp, rows))
    # the texts of those groups, compared chunk by chunk
    members = rows.join(found.select(*fp, "_salt"), [*fp, "_salt"], "left_semi").select("doc_id", *fp).dropDuplicates(["doc_id", *fp])
    text = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    text = text.select("_id", F.octet_length("_norm").cast("long").alias("_len"), F.encode("_norm", "utf-8").alias("_bytes"))
    same = text.join(members.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_len") == F.col("n_bytes"))).select(*fp, "_bytes")
    refuted = chunked(same, chunk).groupBy(*fp, "_no").agg(F.min("_chunk").alias("_a"), F.max("_chunk").alias("_b")).where("_a <> _b").select(*fp).distinct()
    refuted = cut_lineage(refuted)
    if refuted.isEmpty():
        out = rows.join(found, [*fp, "_salt"], "left")
    else:
        good = rows.join(found.join(refuted, fp, "left_anti"), [*fp, "_salt"], "left")
        bad = rows.join(refuted, fp, "left_semi")
        key = ["text_sha256", *fp]
        out = good.join(refuted, fp, "left_anti").unionByName(bad.join(groups(key, bad), [*key, "_salt"], "left"), allowMissingColumns=True)
    size = F.coalesce(F.col("group_size"), F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
