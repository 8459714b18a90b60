"""Near-duplicate documents by SimHash fingerprints, with pigeonring filtering.

64-bit fingerprints link at most MOST differing bits. By the pigeonring principle, on the ring of segments a link has a
start from which every chain of l segments has at most l * MOST / segments differences. The index holds a key for each
form that such a chain can take (`_keys`), so that only pairs with a viable chain become candidates; these get the full
Hamming check. `similar` is the mode for a Jaccard similarity instead of a distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from omicspark.llm import shingles
from omicspark.llm.buckets import components_in_buckets
from omicspark.llm.common import appended, components, dropped, pieces, saved, with_fields

#: Words of a shingle, and the most differing bits of linked fingerprints.
WORDS, MOST = 3, 3
#: Bits of a segment of the ring.
SEGMENT = 16
#: The bits set in each byte value, for counting bits through byte histograms.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_digest = partial(xxhash.xxh64_digest, seed=42)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of A-Z lower-cased words (split at ASCII space), shingles of `words` words, repeats included; a text of fewer
    words is one shingle, one without words has fingerprint 0. Bit b is set if it is in over half of the hashes."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    parts = [w[j : j + n] for j in range(min(words, len(w)))]
    joined = map(b" ".join, zip(*parts, strict=True)) if n > 1 else [b" ".join(w)]
    hashes = np.frombuffer(b"".join(map(_digest, joined)), np.uint8).reshape(n, 8)
    if n < 64:
        counts = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(hashes[:, b], minlength=256) @ _BITS for b in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs with fp (the fingerprint as a signed bigint); a column of that name gives way."""
    schema = with_fields(docs.schema, [T.StructField("fp", T.LongType())])
    arrow = to_arrow_schema(schema)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(rows, text_col):
            fps = np.array([fingerprint(data[offsets[i] : offsets[i + 1]].tobytes(), words) for i in range(batch.num_rows)], np.uint64)
            yield appended(batch, arrow, {"fp": pa.array(fps.view(np.int64))})

    return docs.mapInArrow(add, schema)


def _keys(bits: int) -> list[tuple[int, int]]:
    """Masks of the index: each viable chain's exact part, with a number for the mask.

    On the ring of four segments of 16 bits, some start has only viable chains: its first segment is the same, the first
    two differ in one bit at most, the first three in two. So from that start either one half of the second segment and
    one half of the third are the same as well, or the second segment is."""
    ones = (1 << SEGMENT) - 1
    half = (1 << SEGMENT // 2) - 1
    out = []
    for start in range(bits // SEGMENT):
        one, two, three = (SEGMENT * ((start + i) % (bits // SEGMENT)) for i in range(3))
        chains = [ones << two] + [half << two + i | half << three + j for i in (0, SEGMENT // 2) for j in (0, SEGMENT // 2)]
        out += [ones << one | x for x in chains]
    return list(enumerate(out))


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The full check of candidates: fingerprints (uint64) with at most MOST differing bits."""
    return np.bitwise_count(a ^ b) <= MOST


def keyed(prints: DataFrame) -> DataFrame:
    """node (a fingerprint), key: a hash of each mask's number and the fingerprint's bits in it (32 bits a mask). Masks
    that two keys share by chance only bring pairs to the full check."""
    masks = [F.xxhash64(F.lit(i), F.col("node").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("bigint"))) for i, m in _keys(64)]
    return prints.select("node", F.explode(F.array(*masks)).alias("key"))


def classes(prints: DataFrame) -> DataFrame:
    """prints: fp (bigint, repeated or not). Returns node, root of the fingerprints that link with others: the smallest
    fingerprint that each can reach."""
    nodes = saved(prints.where("fp is not null").select(F.col("fp").alias("node")).distinct())
    links = saved(components_in_buckets(keyed(nodes), linked))
    out = components(links)
    dropped(nodes)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links, itself included), one row per row of docs.

    Copies share a fingerprint and are one node. Null and empty texts have fingerprint 0 and are linked like others. A
    null doc_id can't be a component's smallest unless the component has no other; repeated rows are kept."""
    prints = saved(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", words).select("doc_id", "fp"))
    roots = classes(prints)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    own = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    own = saved(own)
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    named = saved(own.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """Near duplicates from a Jaccard similarity of 0.8 of five-word shingles, exact (`shingles.classes`): no number of
    majority bits bounds that similarity, so that the fingerprints here hold parities, which do."""
    return shingles.classes(docs, id_col, text_col)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and the smallest document that links can reach."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
