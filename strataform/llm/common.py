"""What the operators share: files, lookups, Arrow batches cut to size, pass-through filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.lineage import cut as cut_lineage  # noqa: F401
from strataform.functions.lineage import shared_folder as shared_dir  # noqa: F401

#: Bytes of text that one vectorised step looks at; a longer text makes a step of its own.
STEP_BYTES = 1 << 20


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM's objects: any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined (left) to table, whose key is unique; count: how many rows about have it. Keys with a thousandth or more of
    these rows, 1,000 at most, are broadcast, the others shuffled; rows of the former and of null keys go on to any task."""
    values = [c for c in table.columns if c not in (key, count)]
    hot = table.crossJoin(F.broadcast(table.agg(F.sum(count).alias("_all")))).where(F.col(count) * 1000 >= F.col("_all"))
    first = rows.join(F.broadcast(hot.select(key, F.struct(*values).alias("_hot"))), key, "left")
    anywhere = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    first = first.withColumn("_key", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), anywhere).otherwise(F.col(key).cast("string")))
    out = first.join(table.select(F.col(key).cast("string").alias("_key"), F.struct(*values).alias("_cold")), "_key", "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in values])


def salts(spark: SparkSession) -> int:
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and len + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = (np.cumsum(size) - size) // limit
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def keep_rows(df: DataFrame, column: str, mask: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose column mask() takes, with all their columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column):
            yield batch.filter(pa.array(mask(batch.column(column))))

    return df.mapInArrow(run, df.schema)
