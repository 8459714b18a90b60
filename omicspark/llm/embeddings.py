"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking with the vectors.

A rotation is learnt on a bounded sample so that the signs of the rotated vectors are balanced codes close to the
vectors. A code is m segments of w bits. w follows the logarithm of the number of vectors, so that a table's buckets don't
grow with it, and m is so large that a pair at the threshold is missed by all tables with a chance of MISS at most. In
each segment's table a vector has w + 1 keys: its own code, and its code with one bit flipped; so two vectors meet in a
bucket if some segment differs in two bits at most. Pairs within the radius are reranked by the cosine of the original
vectors, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omicspark.llm.buckets import blocked, compare, groups
from omicspark.llm.common import components, dropped, forest, saved

#: Vectors that the rotation is learnt on at most, and rounds of learning.
SAMPLE, ROUNDS = 4096, 30
#: The most that a pair at the threshold may be missed, and the radius, in standard deviations of its differing bits.
MISS, SPREAD = 0.004, 5.5
#: Bits of a segment, beyond the logarithm of the number of vectors; and at least and at most.
MORE_BITS, LEAST_BITS, MOST_BITS = 2, 12, 30


@dataclass(frozen=True)
class Shape:
    """Segments, bits of each, and the most differing bits of pairs that are reranked."""

    segments: int
    width: int
    radius: int

    @classmethod
    def of(cls, n: int, least: float) -> Shape:
        """For n vectors and pairs of cosine `least`, whose signs differ with the chance angle / pi."""
        width = min(max(math.ceil(math.log2(max(n, 2))) + MORE_BITS, LEAST_BITS), MOST_BITS)
        p = math.acos(min(max(least, -1.0), 1.0)) / math.pi
        meet = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(3))
        segments = min(max(2, math.ceil(math.log(MISS) / math.log(1 - meet)) if meet < 1 else 2), 16)
        bits = segments * width
        return cls(segments, width, math.ceil(p * bits + SPREAD * math.sqrt(p * (1 - p) * bits)))

    @property
    def bits(self) -> int:
        return self.segments * self.width


def learn(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (d x bits) by iterative quantisation: principal directions (vectors of fewer dimensions get
    random ones besides), then the rotation that brings the projected vectors closest to their signs."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x = sample - mean
    d = x.shape[1]
    _, vectors = np.linalg.eigh(x.T @ x)
    base = vectors[:, ::-1][:, :bits]
    if base.shape[1] < bits:
        base = np.concatenate([base, rng.normal(size=(d, bits - base.shape[1])) / np.sqrt(d)], axis=1)
    v = x @ base
    rotation, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
        rotation = (u @ w).T
    return mean, base @ rotation


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """node, mult, v (unit vectors, double): one row for each different vector that can link; node is its smallest id
    and mult its rows."""
    v = F.col("v")
    valid = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    one = valid.where(finite & some).groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult"))
    # Scaled by the largest component first, so that no square over- or underflows.
    most = F.array_max(F.transform("v", F.abs))
    one = one.withColumn("most", most).withColumn("v", F.transform("v", lambda x: x / F.col("most"))).drop("most")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return one.withColumn("norm", norm).select("node", "mult", F.size("v").alias("dim"), F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of pairs of codes, by segment."""
    return np.bitwise_count(a ^ b).astype(np.int64)


def canonical(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all buckets where codes a and b (rows of segments) meet, one: of the segments that differ least the first, and
    there the key that both have and that holds the fewest bits. -1 where they don't meet."""
    n = _differ(a, b)
    s = n.argmin(axis=1)
    at = np.arange(len(a))
    x, y, n = a[at, s].astype(np.int64), b[at, s].astype(np.int64), n[at, s]
    d = x ^ y
    low = d & -d  # its lowest bit
    # Two bits apart they meet halfway: below both where each has one of the bits, else with one of them.
    key = np.where((n == 2) & (np.bitwise_count(x & d) != 1), (x & ~d) | low, x & y)
    return np.where(n <= 2, (key << 4) | s, -1)


def keyed(codes: DataFrame, shape: Shape) -> DataFrame:
    """node, code, key: width + 1 keys for each segment."""
    flips = F.array(*[F.lit(x).cast("bigint") for x in (0, *(1 << b for b in range(shape.width)))])

    def keys(s: int) -> Column:
        own = F.element_at("code", s + 1).cast("bigint")
        return F.transform(flips, lambda x: F.shiftleft(own.bitwiseXOR(x), 4).bitwiseOR(F.lit(s).cast("bigint")))

    return codes.select("node", "code", F.explode(F.concat(*map(keys, range(shape.segments)))).alias("key"))


def _codes(column: np.ndarray) -> np.ndarray:
    return np.stack(column).astype(np.int32) if len(column) else np.zeros((0, 1), np.int32)


def _marked(radius: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a bucket with a partner within the radius for which this bucket is the canonical one."""
        for piece in groups(batches, ["key", "block"]):
            code = _codes(piece["code"])
            marked = np.zeros(len(piece["key"]), bool)
            group = np.concatenate([[0], np.cumsum((piece["key"][1:] != piece["key"][:-1]) | (piece["block"][1:] != piece["block"][:-1]))])
            end = np.searchsorted(group, group, "right")
            at, step = np.arange(len(group)), 1
            while len(at := at[at + step < end[at]]):
                hit = at[_differ(code[at], code[at + step]).sum(axis=1) <= radius]
                hit = hit[canonical(code[hit], code[hit + step]) == piece["key"][hit]]
                marked[hit] = marked[hit + step] = True
                step += 1
            yield pa.RecordBatch.from_arrays([pa.array(piece["key"][marked]), pa.array(piece["node"][marked])], names=["key", "node"])

    return mark


def _reranked(least: float, radius: int):
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each member's links, and a spanning forest of them, within a bucket (or a pair of its blocks)."""
        for piece in groups(batches, ["key", "block"], 1 << 13):
            code = _codes(piece["code"])
            edge = np.flatnonzero((piece["key"][1:] != piece["key"][:-1]) | (piece["block"][1:] != piece["block"][:-1])) + 1
            edges = np.concatenate([[0], edge, [len(code)]])
            nodes, links, roots = [], [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                n = hi - lo
                own, mult, side = code[lo:hi], piece["mult"][lo:hi], piece["side"][lo:hi]
                vectors = np.stack(piece["v"][lo:hi]) if len({len(x) for x in piece["v"][lo:hi]}) == 1 else None
                total, root = np.zeros(n, np.int64), np.arange(n)
                for i in range(0, n, 256):  # blocks of rows against the bucket
                    j = min(i + 256, n)
                    if vectors is not None:
                        cos = vectors[i:j] @ vectors.T
                    else:  # vectors of other lengths link with nothing
                        cos = np.array([[x @ y if len(x) == len(y) else -1.0 for y in piece["v"][lo:hi]] for x in piece["v"][lo + i : lo + j]])
                    r, c = np.nonzero(cos >= least)
                    # A pair counts in its canonical bucket, and in one pair of blocks: across them, or within one block in (x, x).
                    keep = (r + i != c) & ((side[r + i] != side[c]) | piece["diagonal"][lo])
                    r, c = r[keep], c[keep]
                    keep = (_differ(own[r + i], own[c]).sum(axis=1) <= radius) & (canonical(own[r + i], own[c]) == piece["key"][lo])
                    r, c = r[keep] + i, c[keep]
                    np.add.at(total, r, mult[c])
                    moved = np.flatnonzero(root != np.arange(n))
                    root = forest(np.concatenate([r, moved]), np.concatenate([c, root[moved]]), n)
                nodes.append(piece["node"][lo:hi])
                links.append(total)
                roots.append(piece["node"][lo:hi][root])
            out = [np.concatenate(x) for x in (nodes, links, roots)]
            some = out[1] > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in out], names=["node", "links", "root"])

    return rerank


def near_duplicates(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors with cosine >= least), component_id (smallest vec_id reachable by links, itself
    included), kept (vec_id = component_id), one row per row of df.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths don't link; a null vec_id has no links and no component, and kept is false. Rows that repeat a vec_id are
    vectors of their own in the counts and one node in the components. Equal vectors are one node with a multiplicity.
    The codes alone are shuffled to the buckets; only vectors with a partner within the radius are fetched, for their
    canonical buckets, and there compared in blocks; links are counted and joined where they are found."""
    spark = df.sparkSession
    vectors = saved(unit_vectors(df, id_col, vec_col))
    dim = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dim is None:  # nothing can link
        vec_id = F.col(id_col)
        return df.select(vec_id.alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), vec_id.alias("component_id"), vec_id.isNotNull().alias("kept"))
    shape = Shape.of(vectors.count(), least)
    sample = vectors.where(F.col("dim") == dim["dim"]).orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").toPandas()["v"]
    model = spark.sparkContext.broadcast({dim["dim"]: learn(np.stack(sample.to_list()), shape.bits)})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            code = np.zeros((len(part), shape.segments), np.int32)
            for size, at in part.groupby("dim").indices.items():
                if size not in model.value:  # rare lengths: a fixed random projection
                    model.value[size] = (np.zeros(size), np.random.default_rng(42).normal(size=(size, shape.bits)))
                mean, projection = model.value[size]
                bits = (np.stack(part["v"].to_numpy()[at]) - mean) @ projection > 0
                code[at] = bits.reshape(len(at), shape.segments, shape.width) @ (1 << np.arange(shape.width, dtype=np.int32))
            yield pd.DataFrame({"node": part["node"], "mult": part["mult"], "code": list(code), "v": part["v"]})

    coded = saved(vectors.mapInPandas(encode, "node bigint, mult bigint, code array<int>, v array<double>"))
    dropped(vectors)
    dealt = blocked(keyed(coded.select("node", "code"), shape), ["code"]).select("key", "block", "node", "code").repartition("key", "block").sortWithinPartitions("key", "block")
    found = saved(dealt.mapInArrow(_marked(shape.radius), "key bigint, node bigint").distinct())
    met = blocked(found, []).join(coded, "node").repartition("key", "block").sortWithinPartitions("key", "block")
    linked = saved(met.select("key", "block", "side", "diagonal", "node", "mult", "code", "v").mapInArrow(_reranked(least, shape.radius), "node bigint, links bigint, root bigint"))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = coded.select("node", "mult").join(counts, "node", "left").join(roots, "node", "left")
    nodes = saved(nodes.select("node", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links")))
    members = _members(df, id_col, vec_col)
    out = members.join(nodes, "node", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _members(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, node: each row's node, the smallest id of its vector (null if it can't link)."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = F.col("v")
    can = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    firsts = saved(rows.where(can).groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).where("n > 1").drop("n"))
    keyed_ = rows.withColumn("own", F.when(can, F.col("vec_id"))).join(firsts, "v", "left")
    return keyed_.select("vec_id", F.coalesce("node", "own").alias("node"))


def op1_embeddings(spark, sf_dir: str) -> DataFrame:
    """All vectors with their links, the smallest vector that each can reach, and whether it stays."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force over all pairs; the operator's recall of links is measured against it in the tests.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
