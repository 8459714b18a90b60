"""Ranked lexical search of all documents for a set of items, by pipelined term partitioning.

Documents are indexed in shards of at most SHARD documents. Terms are owned by stages, rare terms by the first one. A
bundle of items visits each shard's stages one after another: it carries sparse accumulators (item, document, score so
far), and at each stage a cogroup brings them together with the owner's integer contributions for the same shard. After a
stage an accumulator goes only if even the most that later stages could add leaves it below the bundle's `top` best
documents of the shard, so that the final selection is that of all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from omicspark.llm import tokens
from omicspark.llm.common import pieces, saved

#: Documents and postings of a shard, items and terms of a bundle, and terms of the bundles that are asked in one scan of
#: the documents (their words are sent to the tasks).
SHARD, SHARD_POSTINGS = 1 << 13, 1 << 22
BUNDLE, BUNDLE_TERMS, BLOCK_TERMS = 256, 1 << 16, 1 << 19
#: Shares of the postings that the terms of the stages before the last one own.
STAGES = (1 / 64, 1 / 16, 1 / 4)
#: A term adds less than its weight times this.
FULL = 1_000_000


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as bytes, and each one's text number."""
    data = tokens.LOWER[data]
    start, end, text = tokens.bounds(data, offsets)
    flat = data[tokens.ALNUM[data]]
    to = np.concatenate([[0], np.cumsum(end - start)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(to), pa.py_buffer(flat)]), text


def bundled(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number), bundle, _id, words and counts (of the item's different words) of the items with words."""
    id_type = items.schema[id_col].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("bundle", T.LongType()), T.StructField("_id", id_type), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", longs)])
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, held, bundle = TaskContext.get().partitionId() << 40, 0, 0, TaskContext.get().partitionId() << 32
        for batch, data, offsets in pieces(batches, "_text"):
            words, text = terms_of(data, offsets)
            rows = []
            for i in np.unique(text):
                own = words.slice(int(np.searchsorted(text, i)), int(np.count_nonzero(text == i))).value_counts()
                if n and (n >= BUNDLE or held + len(own) > BUNDLE_TERMS):
                    n, held, bundle = 0, 0, bundle + 1
                rows.append((at, bundle, int(i), own.field(0).to_pylist(), own.field(1).to_pylist()))
                at, n, held = at + 1, n + 1, held + len(own)
            if rows:
                item, own_bundle, row, own_words, counts = zip(*rows, strict=True)
                ids = batch.column(batch.schema.get_field_index("_id")).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(own_bundle), ids, pa.array(own_words, arrow.field(3).type), pa.array(counts, arrow.field(4).type)], schema=arrow)

    return items.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(number, schema)


def indexed(docs: DataFrame, words, id_col: str, text_col: str) -> DataFrame:
    """One row a shard: its documents' ids and words (n), and the postings of the broadcast `words` by term: dfs documents
    each, with places in the shard (doc) and occurrences (tf); n_docs documents with words, n_words words."""
    id_type = docs.schema[id_col].dataType
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("terms", ints), T.StructField("dfs", ints)])
    schema = T.StructType([*schema, *[T.StructField(c, T.BinaryType()) for c in ("n", "doc", "tf")], T.StructField("n_docs", T.LongType()), T.StructField("n_words", T.LongType())])
    arrow = to_arrow_schema(schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, shard = pa.array(words.value, pa.large_binary()), TaskContext.get().partitionId() << 32
        ids, ns, docs_at, terms, tfs, held = [], [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            n, doc, term, tf = (np.concatenate(x) for x in (ns, docs_at, terms, tfs))
            order = np.argsort(term, kind="stable")
            own, dfs = np.unique(term, return_counts=True)
            row = {"shard": [shard], "ids": pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(ids)), "terms": [own], "dfs": [dfs], "n": [n.astype(np.int64).tobytes()]}
            row |= {"doc": [doc[order].astype(np.int32).tobytes()], "tf": [tf[order].astype(np.int64).tobytes()], "n_docs": [np.count_nonzero(n)], "n_words": [int(n.sum())]}
            return pa.RecordBatch.from_arrays([row[f.name] if isinstance(row[f.name], pa.Array) else pa.array(row[f.name], f.type) for f in arrow], schema=arrow)

        for batch, data, offsets in pieces(batches, "_text"):
            found, text = terms_of(data, offsets)
            count = np.bincount(text, minlength=batch.num_rows)
            known = pc.index_in(found, value_set=vocabulary)
            known, text = known.drop_null().to_numpy(), text[known.is_valid().to_numpy(zero_copy_only=False)]
            pair, tf = np.unique(text.astype(np.int64) * max(1, len(vocabulary)) + known, return_counts=True)
            doc, term = pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))
            own_ids = batch.column(batch.schema.get_field_index("_id"))
            at = 0
            while at < batch.num_rows:
                room = SHARD - sum(map(len, ns))
                to = min(batch.num_rows, at + room)
                a, b = np.searchsorted(doc, [at, to])
                ids.append(own_ids.slice(at, to - at))
                docs_at.append(doc[a:b] - at + sum(map(len, ns)))
                ns.append(count[at:to])
                terms.append(term[a:b])
                tfs.append(tf[a:b])
                held, at = held + b - a, to
                if sum(map(len, ns)) >= SHARD or held >= SHARD_POSTINGS:
                    yield closed()
                    ids, ns, docs_at, terms, tfs, held, shard = [], [], [], [], [], 0, shard + 1
        if ns:
            yield closed()

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(index, schema)


def _array(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(x.as_py(), kind)


def contributions(index: DataFrame, sent, stage: int, last: bool, n_docs: int, n_words: int) -> DataFrame:
    """What the owners of a stage's terms add: for each shard and bundle the contributions of the bundle's terms; with the
    last stage the documents' ids too."""
    id_type = index.schema["ids"].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("bundle", T.LongType()), T.StructField("ids", id_type), *[T.StructField(c, T.BinaryType()) for c in ("term", "end", "doc", "add")]])
    arrow = to_arrow_schema(schema)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, owner, bundles = sent.value["weight"], sent.value["owner"], sent.value["bundles"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                terms, dfs = (np.array(row[c].values.to_numpy(zero_copy_only=False), np.int64) for c in ("terms", "dfs"))
                n, doc, tf = _array(row["n"], np.int64), _array(row["doc"], np.int32), _array(row["tf"], np.int64)
                term = np.repeat(terms, dfs)
                mine = owner[term] == stage
                term, doc, tf = term[mine], doc[mine], tf[mine]
                m = 75 + 25 * n[doc] * n_docs // max(1, n_words)
                add = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
                for bundle, (of_bundle, _) in bundles.items():
                    at = np.isin(term, of_bundle)
                    if not at.any() and not last:
                        continue
                    t, df = np.unique(term[at], return_counts=True)
                    ids = batch.column("ids").slice(i, 1) if last else pa.nulls(1, arrow.field("ids").type)
                    packed = [pa.array([x.tobytes()], pa.binary()) for x in (t, np.cumsum(df), doc[at], add[at])]
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"].as_py()]), pa.array([bundle]), ids.cast(arrow.field("ids").type), *packed], schema=arrow)

    slim = index.select("shard", "ids", "terms", "dfs", "n", "doc", "tf") if last else index.select("shard", "terms", "dfs", "n", "doc", "tf")
    return slim.mapInArrow(own, schema)


CARRIED = "shard long, bundle long, item binary, doc binary, score binary"


def _visited(sent, stage: int, last: bool, top: int, out: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A bundle's visit to a stage of a shard. The last one gives the shard's best documents of each item."""

    def visit(bundle: pa.Table, owner: pa.Table) -> pa.Table:
        if not bundle.num_rows or (not owner.num_rows and not last):
            return bundle if not last else out.empty_table()
        key = bundle.column("bundle")[0].as_py()
        item, doc, score = (_array(bundle.column(c)[0], k) for c, k in (("item", np.int32), ("doc", np.int32), ("score", np.int64)))
        terms, end, docs, add = (_array(owner.column(c)[0], k) for c, k in (("term", np.int64), ("end", np.int64), ("doc", np.int32), ("add", np.int64)))
        begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
        size = 1 + max(doc.max(initial=-1), docs.max(initial=-1))
        kept = []
        for no, (own, counts, left) in enumerate(sent.value["bundles"][key][1]):
            sums = np.zeros(size, np.int64)
            a, b = np.searchsorted(item, [no, no + 1])
            sums[doc[a:b]] = score[a:b]
            for t, q in zip(own, counts, strict=True):
                i = np.searchsorted(terms, t)
                if i < len(terms) and terms[i] == t:
                    sums[docs[begin[i] : end[i]]] += q * add[begin[i] : end[i]]
            found = np.flatnonzero(sums)
            values = sums[found]
            if len(found) > top:
                least = np.partition(values, len(values) - top)[len(values) - top]
                stay = values + left[stage] >= least
                found, values = found[stay], values[stay]
            kept.append((found, values))
        items = np.repeat(np.arange(len(kept), dtype=np.int32), [len(x) for x, _ in kept])
        docs, values = (np.concatenate([x[i] for x in kept]) for i in (0, 1))
        if not last:
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (items, docs.astype(np.int32), values)]
            return pa.Table.from_arrays([bundle.column("shard").slice(0, 1), bundle.column("bundle").slice(0, 1), *packed], names=["shard", "bundle", "item", "doc", "score"])
        ids = owner.column("ids").combine_chunks().flatten()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        best = []
        for no in range(len(kept)):
            own = pa.table({"_id": ids.take(pa.array(docs[items == no])), "score": values[items == no]})
            best.append(own.sort_by([("score", "descending"), ("_id", "ascending")]).slice(0, top).append_column("item", pa.array(np.full(min(top, own.num_rows), sent.value["items"][key][no]))))
        return pa.concat_tables(best).select(out.names).cast(out)

    return visit


def _asked(spark, rows: list) -> tuple[list[bytes], dict[int, tuple], dict[int, list[int]]]:
    """The vocabulary of a block of items, by bundle the terms and each item's (terms, counts), and the items' numbers."""
    words = sorted({bytes(w) for r in rows for w in r["words"]})
    number = {w: i for i, w in enumerate(words)}
    own: dict[int, list] = {}
    names: dict[int, list[int]] = {}
    for r in sorted(rows, key=lambda r: r["item"]):
        t = np.array([number[bytes(w)] for w in r["words"]], np.int64)
        order = np.argsort(t)
        own.setdefault(r["bundle"], []).append((t[order], np.array(r["counts"], np.int64)[order]))
        names.setdefault(r["bundle"], []).append(r["item"])
    return words, {b: (np.unique(np.concatenate([t for t, _ in x])), x) for b, x in own.items()}, names


def owners(df: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each term's weight, and the stage that owns it: terms in order of df, cut where STAGES of the postings are passed."""
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    order = np.argsort(df, kind="stable")
    owner = np.zeros(len(df), np.int64)
    owner[order] = np.searchsorted(np.array(STAGES) * max(1, df.sum()), np.cumsum(df[order]))
    return weight, owner


def _best(docs: DataFrame, rows: list, top: int, id_col: str, text_col: str) -> DataFrame:
    """item, _id, score: of each item of the block the best documents of each shard."""
    spark = docs.sparkSession
    words, bundles, names = _asked(spark, rows)
    index = saved(indexed(docs, spark.sparkContext.broadcast(words), id_col, text_col), compression="zstd")
    total = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, n_words = total[0] or 0, total[1] or 0
    counted = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    df = np.zeros(len(words), np.int64)
    for r in counted.collect():  # the block's words at most
        df[r["terms"]] = r["df"]
    weight, owner = owners(df, n_docs)
    stages = len(STAGES) + 1

    def left(t: np.ndarray, q: np.ndarray) -> list[int]:
        """What stages after each one can add at most."""
        return [int((q * weight[t] * FULL)[owner[t] > s].sum()) for s in range(stages)]

    queries = {b: (t, [(own, q, left(own, q)) for own, q in x]) for b, (t, x) in bundles.items()}
    sent = spark.sparkContext.broadcast({"weight": weight, "owner": owner, "bundles": queries, "items": names})
    empty = F.lit(b"").alias
    state = index.select("shard", F.explode(F.lit(list(queries)).cast("array<bigint>")).alias("bundle"), empty("item"), empty("doc"), empty("score"))
    final = T.StructType([T.StructField("item", T.LongType()), T.StructField("_id", docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
    for stage in range(stages):
        last = stage == stages - 1
        added = contributions(index, sent, stage, last, n_docs, n_words)
        visit = _visited(sent, stage, last, top, to_arrow_schema(final))
        state = state.groupBy("shard", "bundle").cogroup(added.groupBy("shard", "bundle")).applyInArrow(visit, final if last else CARRIED)
    return state


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_col, rank (from 1), id_col, score: each item's `top` documents with the highest scores above 0, equal scores by
    ascending id (null ids last).

    Terms are runs of ASCII letters and digits and all other characters beyond ASCII, A-Z lower-cased. Each row of docs is
    a document and each row of items an item, repeated rows and null ids too. Null and empty texts, and texts without
    terms, are not found and find nothing. Other columns are left out, whatever their names. Items are asked in blocks of
    BLOCK_TERMS different words, each with one scan of the documents."""
    spark = docs.sparkSession
    asked = saved(bundled(items, item_col, item_text_col))
    sizes = asked.groupBy("bundle").agg(F.sum(F.size("words")).alias("n")).orderBy("bundle").collect()  # a row for BUNDLE items
    blocks: list[list[int]] = []
    held = 0
    for bundle, n in sizes:
        if not blocks or held + n > BLOCK_TERMS:
            blocks.append([])
            held = 0
        blocks[-1].append(bundle)
        held += n
    if not blocks:
        return docs.select(F.col(id_col).alias("_id")).limit(0).crossJoin(items.select(F.col(item_col).alias("_item")).limit(0)).select(F.col("_item").alias(item_col), F.lit(1).alias("rank"), F.col("_id").alias(id_col), F.lit(0).cast("bigint").alias("score"))
    found = None
    for block in blocks:
        rows = asked.where(F.col("bundle").isin(block)).select("item", "bundle", "words", "counts").collect()  # BLOCK_TERMS words
        own = _best(docs, rows, top, id_col, text_col)
        found = own if found is None else found.union(own)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = ranked.join(asked.select("item", F.col("_id").alias("_item")), "item")
    return named.select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")


def op11_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*)::BIGINT AS q FROM i GROUP BY ALL),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_words FROM n),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, n_docs),
c AS (SELECT item_id, doc_id, sum(q * (w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
