"""Benchmark decontamination by winnowing.

A window is `span` consecutive words of a benchmark item. Of the hashes of its k-grams (k of `span` words) the least is
its fingerprint; so any window that occurs in a document has its fingerprint among the document's window minima, and no
shared span of `span` words can be missed. Fingerprints of documents and of benchmark windows are tables that are joined
by hash. Hits are extended: the windows of a document at its matching fingerprints are joined with the benchmark's by
their words, and the words of a document that lie in any true occurrence are hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.llm import tokens
from omicspark.llm.common import pieces, saved

#: Words of a window and of a k-gram.
SPAN, K = 10, 5
#: Fingerprints of the benchmark, and texts with matches, that are broadcast at most (under 100 MB); more are joined by a shuffle.
BROADCAST_PRINTS, BROADCAST_TEXTS = 2_000_000, 100_000
#: Words before A-Z are lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _minima(hashes: np.ndarray, n: int, k: int) -> np.ndarray:
    """The fingerprint of each window of n words (across texts, too), different for different n."""
    own = min(k, n)
    least = tokens.window_minima(tokens.grams(hashes, own), n - own + 1)
    return tokens.mixed(least + np.uint64(n))


def _windows(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """The words of the windows of n words from each first word, joined by spaces."""
    w = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return pa.array([b" ".join(w[i : i + m]).decode() for i, m in zip(first.tolist(), n.tolist(), strict=True)], pa.string())


def benchmark_windows(benchmark: DataFrame, span: int = SPAN, k: int = K, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """print, n (words), win (the words), item (the id as a string): the windows of all items. An item of fewer words than
    span, but not none, is one window."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(rows, "text", 1 << 18):
            data = tokens.LOWER[data]
            start, end, text, hashes = tokens.words(data, offsets)
            count = np.bincount(text, minlength=batch.num_rows)
            size = np.minimum(count, span)[text]
            last = (np.cumsum(count))[text]
            for n in np.unique(size).tolist():
                at = np.flatnonzero((size == n) & (np.arange(len(text)) + n <= last))
                own = pa.array(np.full(len(at), n))
                yield pa.RecordBatch.from_arrays([pa.array(_minima(hashes, n, k)[at].view(np.int64)), own, _windows(data, start, end, at, np.full(len(at), n)), batch.column(0).take(pa.array(text[at]))], names=["print", "n", "win", "item"])

    return bench.mapInArrow(cut, "print bigint, n bigint, win string, item string").distinct()


def fingerprints(texts: DataFrame, lengths: list[int], k: int = K) -> DataFrame:
    """texts: tk, size, text. Returns tk, size, print: the different window minima of each text for the windows' lengths."""

    def winnow(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(rows, "text"):
            _, _, text, hashes = tokens.words(tokens.LOWER[data], offsets)
            own, found = [], []
            for n in lengths:
                least = _minima(hashes, n, k)
                inside = text[: len(least)] == text[n - 1 :]
                new = inside.copy()
                new[1:] &= (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | ~inside[:-1]
                own.append(text[: len(least)][new])
                found.append(least[new])
            own, found = np.concatenate(own), np.concatenate(found)
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found.view(np.int64))], names=["tk", "size", "print"])

    return texts.mapInArrow(winnow, "tk bigint, size bigint, print bigint")


def occurring_windows(texts: DataFrame, lengths: list[int], k: int = K) -> DataFrame:
    """texts: tk, size, text, prints. Returns tk, size, at (first word, from 0), n, win: windows with a print of theirs."""

    def extend(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(rows, "text", 1 << 18):
            data = tokens.LOWER[data]
            start, end, text, hashes = tokens.words(data, offsets)
            first = np.cumsum(np.bincount(text, minlength=batch.num_rows)) - np.bincount(text, minlength=batch.num_rows)
            lists = batch.column(batch.schema.get_field_index("prints"))
            known = np.unique(tokens.mixed(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)) + np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.uint64))
            for n in lengths:
                least = _minima(hashes, n, k)
                inside = text[: len(least)] == text[n - 1 :]
                at = np.flatnonzero(inside & np.isin(tokens.mixed(least) + text[: len(least)].astype(np.uint64), known))
                own = pa.array(text[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(at - first[text[at]]), pa.array(np.full(len(at), n)), _windows(data, start, end, at, np.full(len(at), n))], names=["tk", "size", "at", "n", "win"])

    return texts.mapInArrow(extend, "tk bigint, size bigint, at bigint, n bigint, win string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words, hit_spans (word numbers from 0, end exclusive, merged, in order) and items (the ids, as sorted
    strings, of the items of which a window occurs).

    Words are [0-9a-z] and all characters beyond ASCII, after A-Z were lower-cased. A null text has no words; benchmark
    rows without an id or without words are no items, and rows that repeat an id are one item. Columns of docs named like
    the added ones give way; others stay. Copies of a text are looked up once. Texts are known by two numbers, their
    XXH64 and their length; only fingerprints, and texts with matching ones, are joined."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {"_tk": F.xxhash64(text), "_size": F.octet_length(text).cast("bigint")}
    bench = saved(benchmark_windows(benchmark, span, k, item_col, item_text_col))
    lengths = sorted(r["n"] for r in bench.select("n").distinct().collect())  # span numbers at most
    prints = saved(bench.select("print").distinct())
    if prints.count() <= BROADCAST_PRINTS:
        prints = F.broadcast(prints)
    texts = docs.select(keys["_tk"].alias("tk"), keys["_size"].alias("size"), text.alias("text"))
    found = saved(fingerprints(texts, lengths, k).join(prints, "print", "left_semi").distinct()) if lengths else saved(texts.select("tk", "size", F.lit(0).cast("bigint").alias("print")).limit(0))
    matched = saved(found.groupBy("tk", "size").agg(F.collect_list("print").alias("prints")))
    few = F.broadcast(matched) if matched.count() <= BROADCAST_TEXTS else matched
    once = texts.join(few, ["tk", "size"]).groupBy("tk", "size").agg(F.first("text").alias("text"), F.first("prints").alias("prints"))
    hits = saved(occurring_windows(once, lengths, k).join(bench.select("n", "win", "item"), ["n", "win"]).select("tk", "size", "at", "n", "item"))
    places = hits.select("tk", "size", "at", (F.col("at") + F.col("n")).alias("to")).distinct()
    spans = places.groupBy("tk", "size").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("start"), F.col("to").alias("end")))).alias("s"))
    joined = F.aggregate(
        "s",
        F.slice("s", 1, 1),
        lambda out, x: F.when(x["start"] <= F.element_at(out, -1)["end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(x))),
    )
    items = hits.select("tk", "size", "item").distinct().groupBy("tk", "size").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = saved(spans.select("tk", "size", joined.alias("hit_spans")).join(items, ["tk", "size"]))
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("bigint")
    added = ("n_words", "hit_spans", "items")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in added], n_words.alias("n_words"), *[x.alias(c) for c, x in keys.items()])
    out = kept.join(result, (kept["_tk"] == result["tk"]) & (kept["_size"] == result["size"]), "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>"), F.array().cast("array<string>")
    return out.select(*[kept[c] for c in kept.columns[:-2]], F.coalesce("hit_spans", empty[0]).alias("hit_spans"), F.coalesce("items", empty[1]).alias("items"))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Of all documents: the words, those inside a benchmark item's window, and the items found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH b AS (SELECT item_id::VARCHAR AS id, {_WORDS} AS w FROM benchmark),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
