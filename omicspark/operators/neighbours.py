"""Neighbour graphs over vectors, by an inverted file of k-means cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.functions.tables import stored

#: Cells at most, vectors that they are learnt from for each cell, rounds of learning, vectors of a task's part of a cell, and
#: vectors whose true neighbours tell how many cells to look in.
MOST_CELLS, FOR_A_CELL, ROUNDS, PART, SAMPLE = 4096, 32, 8, 4096, 256
#: Vectors of a part where all are compared with all: each travels as often as there are parts.
WHOLE_PART = 16384


def _matrix(column: pa.Array, cosine: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if cosine else x


def _nearness(x: np.ndarray, y: np.ndarray, cosine: bool) -> np.ndarray:
    """Higher is nearer: the cosine, or the negative squared distance."""
    return x @ y.T if cosine else 2 * x @ y.T - (x * x).sum(axis=1)[:, None] - (y * y).sum(axis=1)[None, :]


def _least(near: np.ndarray, k: int) -> np.ndarray:
    """For each row a bound that its k highest values reach, also after rounding to nine digits: the k-th of the maxima of
    groups of columns, which is found without sorting the row."""
    width = max(1, min(64, near.shape[1] // (8 * k)))
    whole = near.shape[1] // width * width
    top = near[:, :whole].reshape(len(near), -1, width).max(axis=2)
    if top.shape[1] < k:
        return np.full(len(near), -np.inf)
    bound = np.partition(top, -k, axis=1)[:, -k]
    return bound - 2e-9 * np.maximum(1, np.where(np.isfinite(bound), np.abs(bound), 1))


def learn_cells(vectors: DataFrame, n: int, cosine: bool) -> np.ndarray:
    """Centres of about sqrt(n) k-means cells, from at most FOR_A_CELL vectors a cell (chosen by the hash of their ids)."""
    cells = max(1, min(MOST_CELLS, math.isqrt(n)))
    share = min(1.0, 1.5 * FOR_A_CELL * cells / max(n, 1))
    some = vectors.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("id"), "id").limit(FOR_A_CELL * cells).toArrow()
    x = _matrix(some.column("v").combine_chunks(), cosine)
    centres = x[np.random.default_rng(0).permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        own = _nearness(x, centres, cosine).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
        if cosine:
            centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def _assigned(vectors: DataFrame, sent, probes: int, cosine: bool) -> DataFrame:
    """Adds cells: each vector's own cell and the next nearest ones, `probes` in all."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearness(_matrix(batch.column("v"), cosine), sent.value, cosine)
            order = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists], names=["id", "v", "cells"])

    return vectors.mapInArrow(assign, f"id {dict(vectors.dtypes)['id']}, v {dict(vectors.dtypes)['v']}, cells array<int>")


def _search(seeking: DataFrame, filed: DataFrame, k: int, cosine: bool, most: int | None = None) -> DataFrame:
    """seeking: id, v, cells to look in. filed: id, v, cells, of which the first is the vector's own. id, neighbour,
    nearness, rank of the k best. Cells of more than `most` (PART) vectors on either side are cut, and each part of the one
    side meets each part of the other in a task of its own."""
    kind = dict(filed.dtypes)["id"]
    own, seek = filed.select("id", "v", F.col("cells")[0].alias("cell")), seeking.select("id", "v", F.explode("cells").alias("cell"))
    # A row a cell: how many parts its vectors and those that look into it are dealt to.
    parts = lambda df, c: df.groupBy("cell").agg(F.ceil(F.count("*") / (most or PART)).cast("int").alias(c))
    sizes = parts(own.select("cell"), "a").join(parts(seek.select("cell"), "b"), "cell")
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    there = own.join(F.broadcast(sizes), "cell").withColumn("x", part("a")).withColumn("y", F.explode(F.expr("sequence(0, b - 1)"))).select("cell", "x", "y", F.col("id").alias("n"), F.col("v").alias("u"))
    query = seek.join(F.broadcast(sizes), "cell").withColumn("y", part("b")).withColumn("x", F.explode(F.expr("sequence(0, a - 1)"))).select("cell", "x", "y", "id", "v")

    def best(queries: pa.Table, there: pa.Table) -> pa.Table:
        schema = pa.schema([("id", there.schema.field("n").type), ("neighbour", there.schema.field("n").type), ("nearness", pa.float64())])
        if not queries.num_rows or not there.num_rows:
            return schema.empty_table()
        there = there.sort_by("n")
        names, asking = there.column("n").combine_chunks(), queries.column("id").combine_chunks()
        at = {x: i for i, x in enumerate(names.to_pylist())}
        y, out = _matrix(there.column("u").combine_chunks(), cosine), []
        for i in range(0, queries.num_rows, 512):
            few = asking.slice(i, 512)
            near = _nearness(_matrix(queries.column("v").slice(i, 512).combine_chunks(), cosine), y, cosine)
            for r, x in enumerate(few.to_pylist()):
                if x in at:
                    near[r, at[x]] = -np.inf
            row, col = np.nonzero(near >= _least(near, k)[:, None])
            value = np.round(near[row, col], 9)
            order = np.lexsort((col, -value, row))
            row, col, value = row[order], col[order], value[order]
            ok = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(value)
            out.append(pa.table([few.take(pa.array(row[ok])), names.take(pa.array(col[ok])), pa.array(value[ok])], schema=schema))
        return pa.concat_tables(out)

    keys = ["cell", "x", "y"]
    found = query.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(best, f"id {kind}, neighbour {kind}, nearness double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("nearness"), "neighbour"))).where(F.col("rank") <= k)


def probes_for(vectors: DataFrame, filed: DataFrame, sent, k: int, recall: float, cosine: bool) -> int:
    """How many cells a vector has to look in: in a sample of SAMPLE vectors, compared with all others, that many hold the
    share `recall` of the true neighbours."""
    n_cells = len(sent.value)
    some = stored(_assigned(vectors.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE), sent, n_cells, cosine))
    true = _search(some, filed, k, cosine).select("id", "neighbour")
    place = true.join(filed.select(F.col("id").alias("neighbour"), F.col("cells")[0].alias("own")), "neighbour").join(some.select("id", "cells"), "id")
    places = sorted(r[0] for r in place.select(F.array_position("cells", F.col("own"))).collect())  # k numbers a sampled vector
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) if places else 1


def neighbour_graph(vectors: DataFrame, k: int, recall: float | None = 0.95, cosine: bool = True, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, neighbour, rank, nearness (the cosine, or else the negative squared distance): the k nearest other vectors of
    every vector, equally near ones by id. Null vectors are left out; vectors must be of one length, ids different.

    A vector is filed in its nearest cell and looks for neighbours in as many of its nearest cells as held the share
    `recall` of the neighbours of a sample (probes_for). None is exact: there is one cell, of whose parts (WHOLE_PART
    vectors) each meets each. Vectors of floats travel as floats."""
    spark = vectors.sparkSession
    all_of = stored(vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(vec_col) if dict(vectors.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")).alias("v")))
    n = all_of.count()
    if not n:
        return all_of.select(F.col("id").alias(id_col), F.col("id").alias("neighbour"), F.lit(0).alias("rank"), F.lit(0.0).alias("nearness"))
    if recall is None:
        filed = all_of.withColumn("cells", F.array(F.lit(0)))
        return _search(filed, filed, k, cosine, WHOLE_PART).select(F.col("id").alias(id_col), "neighbour", "rank", "nearness")
    sent = spark.sparkContext.broadcast(learn_cells(all_of, n, cosine))
    filed = stored(_assigned(all_of, sent, 1, cosine))
    filed = stored(_assigned(all_of, sent, probes_for(all_of, filed, sent, k, recall, cosine), cosine))
    out = _search(filed, filed, k, cosine)
    return out.select(F.col("id").alias(id_col), "neighbour", "rank", "nearness")
