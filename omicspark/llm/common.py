"""What the text operators share: tables in the shared folder, pieces of Arrow batches, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and everything runs in one process, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="omicspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it is computed once, its size is known to the
    optimizer, and a lost executor costs no more than the scan of a lost task."""
    path = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def saved_sorted(df: DataFrame, by: list[str], buckets: int, partition_by: list[str]) -> DataFrame:
    """df written as a table in the shared folder, in buckets of the columns `by` and sorted by them: tables with as many
    buckets are merge-joined on these columns without a shuffle. df is to be dealt by them in as many parts."""
    spark, name = df.sparkSession, f"sorted_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.partitionBy(*partition_by).bucketBy(buckets, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._saved_at, out._table = path, name
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes the files of a table that saved() or saved_sorted() wrote and that nothing needs any more."""
    path = getattr(df, "_saved_at", None)
    if getattr(df, "_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_fields(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    """schema and the new fields; a field that is there already (in any case of letters) gives way to the new one."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + fields)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the UTF-8 bytes of the text column and its offsets (nulls are empty). A slice holds
    about most_bytes of text, or one longer row, so that memory follows the longest text and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
            at = to


def appended(batch: pa.RecordBatch, schema: pa.Schema, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with new columns, in the order of the schema."""
    arrays = [new[f.name] if f.name in new else batch.column(batch.schema.get_field_index(f.name)) for f in schema]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For the links left[i] - right[i] between 0..n-1: the smallest number that each can reach."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        live = low != high
        if not live.any():
            break
        left, right, low, high = left[live], right[live], low[live], high[live]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, not null). Returns node, root: the smallest node each can reach, itself included; only nodes
    with links to others have rows.

    Rounds of "large star" and "small star" (each node hands its neighbours to its smallest neighbour) until nothing
    changes: the links never grow in number, and the rounds grow with the logarithm of the longest path. Minima are
    partial aggregates, so that a hub is combined before its shuffle; the join with the hub's minimum is a plain
    sort-merge join, which adaptive execution can split."""
    spark = links.sparkSession
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # Large star: the larger neighbours of u, and u itself, go to the smallest of u and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large)
        # Small star: the smaller neighbours of u, and u itself, go to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = saved(moved.where("u <> v").distinct())
        sums = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(edges)
        dropped(large)
        edges = small
        if sums == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sums
