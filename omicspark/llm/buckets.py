"""Comparing the members of buckets, whatever a bucket's size, without emitting pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.llm.common import forest, saved

#: Buckets of more rows are cut into blocks, and each pair of blocks becomes a bucket of its own. A bucket of n rows has
#: blocks of BLOCK rows, or of GROWTH * sqrt(n) where that is more: as n grows, a row is repeated sqrt(n) / GROWTH times,
#: and the rows that a task holds at once grow no faster than that.
BLOCK, GROWTH = 1024, 16


def blocked(rows: DataFrame, columns: list[str], weight: str | None = None, most_weight: int = 1) -> DataFrame:
    """rows: key, node and columns, different (key, node). Leaves out buckets of one row, and cuts large ones: adds
    block (a number for the pair of blocks, 0 in small buckets) so that all pairs of a bucket meet in some (key, block),
    side (the row's own block) and diagonal (whether block is a block with itself, or a whole bucket). Rows of the same
    side meet in each of their blocks, and once on the diagonal. weight: a column of which a block holds about most_weight
    in all, or one row.

    Sizes are partial aggregates; only keys of more than one row are kept, and only large buckets are repeated."""
    sizes = saved(rows.groupBy("key").agg(F.count("*").alias("n"), (F.sum(weight) if weight else F.lit(0)).alias("w")).where("n > 1"))
    few = rows.join(sizes, "key")
    blocks = F.greatest(F.ceil(F.col("n") / F.greatest(F.lit(BLOCK), GROWTH * F.sqrt("n"))), F.ceil(F.col("w") / most_weight)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("b")).cast("int")
    few = few.withColumn("b", blocks).withColumn("own", own)
    pairs = F.when(F.col("b") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda x: F.least(x, F.col("own")) * F.col("b") + F.greatest(x, F.col("own"))))
    few = few.withColumn("block", F.explode(pairs))
    diagonal = F.expr("block div b = block % b")
    return few.select("key", "block", F.col("own").alias("side"), diagonal.alias("diagonal"), "node", *columns)


def groups(rows: Iterator[pa.RecordBatch], keys: list[str], most_rows: int = 1 << 16, most_bytes: int = 1 << 26) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted rows in pieces of whole groups of keys; a piece has about most_rows rows or most_bytes, or one larger
    group."""
    held: list[pa.RecordBatch] = []
    n, size = 0, 0

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        return {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in table.column_names}

    for batch in rows:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n < most_rows and size < most_bytes:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(n, bool)
        for k in keys:
            col = table.column(k).combine_chunks().to_numpy()
            last &= col == col[-1]
        whole = int(np.argmin(last[::-1]))
        whole = n - whole if not last.all() else 0
        if whole:
            yield columns(table.slice(0, whole))
        held = table.slice(whole).to_batches()
        n, size = n - whole, sum(x.nbytes for x in held)
    if n:
        yield columns(pa.Table.from_batches(held))


def compare(piece: dict[str, np.ndarray], linked: Callable[..., np.ndarray], columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the linked pairs' spanning forest, over all pairs of rows with the same key and block. Rows are
    compared at growing distance, so that memory follows the rows and not the pairs."""
    n = len(piece["key"])
    root = np.arange(n)
    group = np.concatenate([[0], np.cumsum((piece["key"][1:] != piece["key"][:-1]) | (piece["block"][1:] != piece["block"][:-1]))])
    end = np.searchsorted(group, group, "right")  # of each row's group
    at = np.arange(n)
    step = 1
    lefts, rights, many = [], [], 0
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        found = at[linked(*[x for c in columns for x in (piece[c][at], piece[c][at + step])])]
        lefts.append(found)
        rights.append(found + step)
        many += len(found)
        if many > 1 << 20:
            root, lefts, rights, many = _joined(root, lefts, rights), [], [], 0
        step += 1
    root = _joined(root, lefts, rights)
    other = np.flatnonzero(root != np.arange(n))
    return other, root[other]


def _joined(root: np.ndarray, lefts: list, rights: list) -> np.ndarray:
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
    old = np.flatnonzero(root != np.arange(len(root)))
    return forest(np.concatenate([left, old]), np.concatenate([right, root[old]]), len(root))


def components_in_buckets(rows: DataFrame, linked: Callable[..., np.ndarray]) -> DataFrame:
    """rows: key, node (a 64-bit code). Returns a, b: links that join the same nodes as all links do within buckets, at
    most one for each node and bucket. linked(a, b) tells for arrays of codes (uint64) which pairs link."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in groups(batches, ["key", "block"]):
            piece["code"] = piece["node"].view(np.uint64)
            one, other = compare(piece, linked, ["code"])
            yield pa.RecordBatch.from_arrays([pa.array(piece["node"][one]), pa.array(piece["node"][other])], names=["a", "b"])

    dealt = blocked(rows, []).select("key", "block", "node").repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(link, "a bigint, b bigint").distinct()
