"""Principal components of long tables of any size, by a randomised block Krylov method."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omicspark.functions.tables import stored
from omicspark.operators.gwas import ranked

#: Vectors that are multiplied at once beyond the components asked for, passes at most, and the residual (as a share of the
#: largest eigenvalue) that ends them.
EXTRA, PASSES, RESIDUAL = 14, 24, 1e-10
#: Columns whose sums travel together.
PART = 1 << 14


def _multiplied(rows: DataFrame, q: np.ndarray) -> tuple[np.ndarray, float]:
    """The centred matrix's transpose times itself times q, and the sum of its squares. A task holds sums of q's shape."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(q)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        z, square = np.zeros_like(q), 0.0
        for batch in batches:
            lists = batch.column("x")
            offsets, flat = np.asarray(lists.offsets), lists.values.slice(0)
            at, value = flat.field("at").to_numpy(), flat.field("v").to_numpy()
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                s, x = at[a:b], value[a:b] - value[a:b].mean()
                z[s] += x[:, None] * (x @ q[s])
                square += x @ x
        starts = range(0, len(z), PART)
        yield pa.RecordBatch.from_arrays([pa.array([*starts, -1], pa.int64()), pa.array([*[z[i : i + PART].tobytes() for i in starts], np.array([square]).tobytes()], pa.binary())], names=["part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in group.column("sums")], axis=0)
        return pa.table({"part": group.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part bigint, sums binary"
    parts = dict(map(tuple, rows.mapInArrow(multiply, schema).groupBy("part").applyInArrow(add, schema).collect()))
    sent.unpersist()
    if not parts:
        return np.zeros_like(q), 0.0
    return np.concatenate([np.frombuffer(parts[i]).reshape(-1, q.shape[1]) for i in range(0, len(q), PART)]), float(np.frombuffer(parts[-1])[0])


def _new_directions(z: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what z has beyond the basis."""
    norm = np.linalg.norm(z, axis=0).max(initial=0.0)
    for _ in range(2):
        z = z - basis @ (basis.T @ z)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    return u[:, s > 1e-12 * max(norm, 1e-300)]


def pca(values: DataFrame, k: int = 2, row: str = "variant_id", column: str = "sample_id", value: str = "dosage") -> DataFrame:
    """column, component (from 1), score, explained: the k first principal components of the columns (samples) over rows
    that are centred on their mean; null and missing values count as the mean. values has at most one value for each row
    and column.

    Each pass multiplies a few vectors by the matrix where its rows are; the passes' products span a Krylov space in which
    the components are found. So what the driver and each task hold is columns x vectors, never columns x columns. A space
    of all columns (up to EXTRA + k of them take one pass) gives the exact components. A score's sign makes the largest one
    positive; a column without any value has no row."""
    spark = values.sparkSession
    known = values.where(F.col(value).isNotNull() & F.col(column).isNotNull()).select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("v"))
    columns = stored(ranked(known.select("c").distinct(), [F.col("c")], "number"))
    n = columns.count()
    out = T.StructType([T.StructField(column, values.schema[column].dataType), T.StructField("component", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("explained", T.DoubleType())])
    if not n:
        return spark.createDataFrame([], out)
    rows = stored(known.join(columns, "c").groupBy("r").agg(F.collect_list(F.struct((F.col("number") - 1).alias("at"), "v")).alias("x")).select("x"))
    width = min(n, k + EXTRA)
    q = np.eye(n) if width == n else np.linalg.qr(np.random.default_rng(0).standard_normal((n, width)))[0]
    basis, image = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(PASSES):
        z, total = _multiplied(rows, q)
        basis, image = np.concatenate([basis, q], axis=1), np.concatenate([image, z], axis=1)
        small = basis.T @ image
        found, u = np.linalg.eigh((small + small.T) / 2)
        found, u = np.maximum(found[::-1][:k], 0), u[:, ::-1][:, :k]
        residual = np.linalg.norm(image @ u - (basis @ u) * found, axis=0).max(initial=0.0)
        q = _new_directions(z, basis)
        if residual <= RESIDUAL * max(found.max(initial=0.0), 1e-300) or not q.shape[1]:
            break
    scores = basis @ u * np.sqrt(found)
    scores *= np.where(scores[np.argmax(np.abs(scores), axis=0), np.arange(scores.shape[1])] < 0, -1, 1)
    share = found / max(total, 1e-300)
    # Columns x components numbers.
    made = spark.createDataFrame([(i + 1, *map(float, s)) for i, s in enumerate(scores)], "number bigint, " + ", ".join(f"s{c} double" for c in range(scores.shape[1])))
    each = F.explode(F.array(*[F.struct(F.lit(c + 1).alias("component"), F.col(f"s{c}").alias("score"), F.lit(float(share[c])).alias("explained")) for c in range(scores.shape[1])])).alias("x")
    return made.select("number", each).join(columns, "number").select(F.col("c").alias(column), "x.component", "x.score", "x.explained")
