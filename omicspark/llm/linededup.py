"""Lines that many documents share, found with levelled sorted runs of line hashes.

Documents come in batches, each as large as all before it. A run is a table of line hashes with the number of documents
that have the line, bucketed and sorted by the hash; lines that are frequent enough lie apart in it. A batch is counted,
merge-anti-joined with the frequent lines of all runs, and becomes a run of its own; two runs of a level are merged into
one of the next. All runs have the same buckets, so that these joins are merges without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from omicspark.llm.common import appended, dropped, pieces, saved, saved_sorted, with_fields

#: What is stripped from both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"
#: Heavy keys (16 bytes each) up to this number are sent to the executors as a set of about 20 MB; beyond, they are joined.
BROADCAST_KEYS = 200_000
ADDED = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]


def _key(line: bytes) -> bytes:
    """The line's key as a 128-bit hash; empty for an empty key."""
    key = line.strip(BLANK).lower()  # bytes.lower() changes A-Z only
    return xxhash.xxh128_digest(key) if key else b""


def line_hashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """at (a hash of the text), h1, h2: each document's different line keys, empty ones left out."""
    slim = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.select("text", F.xxhash64("text").alias("at"))

    def hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(rows, "text"):
            h, counts = _hashes(data, offsets)
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("at")).take(at), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["at", "h1", "h2"])

    return slim.mapInArrow(hashes, "at bigint, h1 bigint, h2 bigint")


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Hashes of each text's different lines, and how many each text has."""
    found, counts = [], []
    for i in range(len(offsets) - 1):
        own = {_key(x) for x in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")}
        own.discard(b"")
        found += own
        counts.append(len(own))
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2), counts


def counted_lines(docs: DataFrame, batches: int, text_col: str = "text") -> DataFrame:
    """batch, h1, h2, n: the number of documents with each line, added up within pieces of the texts, so that a line that
    all have is one row for each piece. A document's batch comes from its text: of b batches the first two have 1 part in
    2 ** (b - 1), and each other one has as much as all before it."""
    slim = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64("text"), F.lit(1 << (batches - 1))).cast("double")
    slim = slim.select("text", F.when(part < 1, 0).otherwise(F.floor(F.log2(F.greatest(part, F.lit(1.0)))) + 1).cast("int").alias("batch"))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(rows, "text"):
            h, counts = _hashes(data, offsets)
            own = np.repeat(batch.column(batch.schema.get_field_index("batch")).to_numpy(), counts)
            order = np.lexsort((h[:, 1], h[:, 0], own))
            h, own = h[order], own[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(own[first]), pa.array(h[first, 0]), pa.array(h[first, 1]), pa.array(np.diff(np.append(first, len(own))))], names=["batch", "h1", "h2", "n"])

    return slim.mapInArrow(count, "batch int, h1 bigint, h2 bigint, n bigint")


class SortedRuns:
    """Levels of runs (h1, h2, n, heavy: whether n is `least` or more). A level that gets a second run merges the two into
    one of the next level, so that there is at most one run a level and each row is rewritten once a level."""

    def __init__(self, least: int, buckets: int):
        self.least, self.buckets = least, buckets
        self.levels: dict[int, DataFrame] = {}

    def _run(self, counted: DataFrame) -> DataFrame:
        return saved_sorted(counted.withColumn("heavy", F.col("n") >= self.least), ["h1", "h2"], self.buckets, ["heavy"])

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, n. Lines that are heavy in a run stay out: they are heavy whatever comes."""
        counted = batch.repartition(self.buckets, "h1", "h2").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        for run in self.levels.values():
            counted = counted.join(run.where("heavy").select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, self._run(counted))

    def _put(self, level: int, run: DataFrame) -> None:
        while level in self.levels:
            old = self.levels.pop(level)
            run, level = self._merged(old, run), level + 1
        self.levels[level] = run

    def _merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        n = (F.coalesce(one["n"], F.lit(0)) + F.coalesce(other["n"], F.lit(0))).alias("n")
        both = one.join(other.hint("merge"), (one["h1"] == other["h1"]) & (one["h2"] == other["h2"]), "full")
        out = self._run(both.select(F.coalesce(one["h1"], other["h1"]).alias("h1"), F.coalesce(one["h2"], other["h2"]).alias("h2"), n))
        dropped(one)
        dropped(other)
        return out

    def heavy(self) -> DataFrame:
        """h1, h2 of all lines in at least `least` documents, after all runs were merged into one."""
        while len(self.levels) > 1:
            low, high = sorted(self.levels)[:2]
            one, other = self.levels.pop(low), self.levels.pop(high)
            self._put(high + 1, self._merged(one, other))
        (run,) = self.levels.values()
        return run.where("heavy").select("h1", "h2")

    def drop(self) -> None:
        for run in self.levels.values():
            dropped(run)


def _rebuilt(rows: Iterator[pa.RecordBatch], schema: pa.Schema, text_col: str, heavy=None) -> Iterator[pa.RecordBatch]:
    """The texts without their heavy lines. heavy: all heavy hashes; None: each row has its own in _heavy."""
    for batch, data, offsets in pieces(rows, text_col):
        own = batch.column(batch.schema.get_field_index("_heavy")).to_pylist() if heavy is None else None
        texts, total, gone = [], [], []
        for i in range(batch.num_rows):
            lines = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
            drop = heavy if own is None else {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in own[i] or ()}
            kept = [x for x in lines if _key(x) not in drop] if drop else lines
            texts.append(b"\n".join(kept).decode())
            total.append(len(lines))
            gone.append(len(lines) - len(kept))
        yield appended(batch, schema, {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(gone, pa.int64())})


def drop_common_lines(docs: DataFrame, least: int = 10, text_col: str = "text", batch_bytes: int = 8 << 30, bucket_bytes: int = 512 << 20) -> DataFrame:
    """docs with text rebuilt without the lines whose key (stripped, A-Z lower-cased, not empty) is in at least `least`
    documents, and n_lines (before), n_dropped.

    Every row of docs is a document, repeated rows too. A null or empty text is one empty line and comes back empty.
    If all lines go, the text is empty. Columns named n_lines or n_dropped give way to the new ones; others stay.
    Batches double in size, the first of about batch_bytes of text, and are four at least; a bucket has the lines of
    about bucket_bytes. Up to BROADCAST_KEYS heavy lines are sent to the tasks; more are joined to the texts."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    batches = max(4, math.ceil(math.log2(max(n_bytes, 1) / batch_bytes)) + 1)
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / bucket_bytes)), 100_000)
    lines = saved(counted_lines(docs, batches, text_col), ["batch"])
    runs = SortedRuns(least, buckets)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i).select("h1", "h2", "n"))
    dropped(lines)
    heavy = saved(runs.heavy())
    runs.drop()
    schema = with_fields(docs.schema, ADDED)
    arrow = to_arrow_schema(schema)
    few = heavy.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    if few:
        rows = heavy.toPandas()
        table = np.ascontiguousarray(rows[["h1", "h2"]].to_numpy(np.int64))
        sent = spark.sparkContext.broadcast(frozenset(x.tobytes() for x in table))
        return docs.mapInArrow(lambda it: _rebuilt(it, arrow, text_col, sent.value), schema)
    own = line_hashes(docs, text_col).join(heavy, ["h1", "h2"], "left_semi").distinct().select(F.col("at").alias("_key"), F.struct("h1", "h2").alias("h"))
    own = saved(own.groupBy("_key").agg(F.collect_list("h").alias("_heavy")))
    joined = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(own, "_key", "left").drop("_key")
    return joined.mapInArrow(lambda it: _rebuilt(it, arrow, text_col), schema)


def op8_linededup(spark, sf_dir: str) -> DataFrame:
    """All documents with their lines counted, those dropped that ten documents share, and the rest's checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key FROM k WHERE length(key) > 0 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(h.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN h.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN h ON k.key = h.key GROUP BY k.doc_id
"""
