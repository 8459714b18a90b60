"""Literature embeddings and text: centroids, neighbours, keyword ranking, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.functions.stats import t_two_sided_p
from omicspark.functions.tables import stored


def unit(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vec, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame) -> DataFrame:
    """label, centroid: mean unit vectors, by dimension, with partial sums."""
    long = vectors.select("label", F.posexplode(unit(F.col("embedding").cast("array<double>"))).alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def isolation(vectors: DataFrame, k: int = 3) -> DataFrame:
    """Mean cosine distance of each label's centroid to its k nearest other ones. One vector per label is compared."""
    c = centroids(vectors).withColumn("centroid", unit(F.col("centroid")))
    a, b = c.alias("a"), F.broadcast(c.alias("b"))
    d = a.join(b, F.col("a.label") != F.col("b.label")).select(F.col("a.label").alias("label"), F.col("b.label").alias("other"), (1 - dot(F.col("a.centroid"), F.col("b.centroid"))).alias("d"))
    near = d.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy(F.round("d", 9), "other"))).where(F.col("_r") <= k)
    return near.groupBy("label").agg(F.round(F.avg("d"), 6).alias("isolation"))


def transfer_potential(vectors: DataFrame) -> DataFrame:
    """label, transfer: the mean cosine similarity of a label's centroid to those of all other labels. The sum over all
    labels is one vector, so that no pair of labels meets."""
    c = centroids(vectors).withColumn("centroid", unit(F.col("centroid")))
    total = c.select(F.posexplode("centroid").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    total = total.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))  # one row
    others = dot(F.col("centroid"), F.col("total")) - dot(F.col("centroid"), F.col("centroid"))
    return c.join(F.broadcast(total)).where("n > 1").select("label", F.round(others / (F.col("n") - 1), 6).alias("transfer"))


def yearly_drift(vectors: DataFrame) -> DataFrame:
    """vectors: label, year, embedding. label, n_steps, drift: the mean cosine distance between the centroids of a label's
    successive years (of those that it has)."""
    yearly = centroids(vectors.where("year is not null").select(F.struct("label", "year").alias("label"), "embedding")).select("label.label", "label.year", unit(F.col("centroid")).alias("c"))
    before = F.lag("c").over(W.partitionBy("label").orderBy("year"))
    steps = yearly.select("label", "c", before.alias("before")).where("before is not null")
    return steps.groupBy("label").agg(F.count("*").alias("n_steps"), F.round(F.avg(1 - dot(F.col("c"), F.col("before"))), 6).alias("drift"))


def group_contrast(values: DataFrame, value: str = "value", group: str = "grp") -> DataFrame:
    """One row of the values in group 1 against those in group 0: n1, n0, mean1, mean0, Welch's t, its degrees of freedom and
    p, and Cohen's d (over the pooled deviation). Groups of fewer than two values have no t."""
    own = {g: F.when(F.col(group) == g, F.col(value).cast("double")) for g in (1, 0)}
    m = values.agg(*[f(own[g]).alias(f"{name}{g}") for g in (1, 0) for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    a, b, diff = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0"), F.col("mean1") - F.col("mean0")
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("var1") + (F.col("n0") - 1) * F.col("var0"), F.col("n1") + F.col("n0") - 2))
    ok = (F.col("n1") > 1) & (F.col("n0") > 1)
    df = m.select("n1", "n0", "mean1", "mean0", F.when(ok, F.try_divide(diff, F.sqrt(a + b))).alias("t"), F.when(ok, F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("df"), F.when(ok, F.try_divide(diff, pooled)).alias("d"))
    return df.withColumn("p", F.when(F.col("t").isNotNull(), t_two_sided_p("t", "df")))


def within_variance(vectors: DataFrame) -> DataFrame:
    """Mean squared distance of the unit vectors to their label's centroid."""
    v = vectors.withColumn("u", unit(F.col("embedding").cast("array<double>"))).join(F.broadcast(centroids(vectors)), "label")
    d2 = F.aggregate(F.zip_with("u", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return v.groupBy("label").agg(F.round(F.avg(d2), 6).alias("variance"), F.count("*").alias("n"))


#: Query vectors that are sent to every task at once, about.
QUERY_BLOCK = 5_000


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """vec_id, neighbour, rank, cosine: the k nearest other vectors of each query vector. Queries go in blocks of about
    `block`, by the hash of their ids, each of which is sent to every task; each batch of vectors gives its k best, and
    those are ranked."""
    blocks = max(1, -(-queries.count() // (block or QUERY_BLOCK)))
    out = None
    for b in range(blocks):
        part = _nearest(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), vectors, k)
        out = part if out is None else out.union(part)
    return out


def _nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    q = queries.select("vec_id", "embedding").toPandas()
    ids = q["vec_id"].to_numpy()
    unit_q = np.stack([np.asarray(x, float) for x in q["embedding"]]) if len(q) else np.zeros((0, 1))
    unit_q = unit_q / np.maximum(np.linalg.norm(unit_q, axis=1, keepdims=True), 1e-300)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, unit_q))

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, mat = sent.value
        for part in parts:
            if not len(part) or not len(own):
                continue
            x = np.stack([np.asarray(v, float) for v in part["embedding"]])
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            there = part["vec_id"].to_numpy()
            for i in range(0, len(own), 256):
                cos = np.round(mat[i : i + 256] @ x.T, 9)
                cos[own[i : i + 256, None] == there[None, :]] = -np.inf
                top = np.lexsort((np.broadcast_to(there, cos.shape), -cos), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(cos)), top.shape[1])
                c = cos[rows, top.ravel()]
                ok = np.isfinite(c)
                yield pd.DataFrame({"vec_id": own[i + rows][ok], "neighbour": there[top.ravel()][ok], "cosine": c[ok]})

    found = vectors.where("embedding is not null").select("vec_id", "embedding").mapInPandas(best, "vec_id bigint, neighbour bigint, cosine double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.col("cosine").desc(), "neighbour"))).where(F.col("rank") <= k)


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x) > 2)


#: Pairs of a query and a word that are sent to the tasks at most; with more, documents and queries are joined by word.
MOST_ASKED = 200_000


def keyword_ranking(queries: DataFrame, docs: DataFrame, k: int, cap: int = 3) -> DataFrame:
    """queries: query_id, text, docs: doc_id, text. Documents by the sum over the query's words of their counts, each at
    most cap; the k best of each query. Rows that share a doc_id are one document's.

    The queries' words are sent to the tasks, which score each document where it lies and keep each query's best so far,
    so that a task holds k documents a query. Documents of several rows (found by the ids alone), and all, if there are
    more than MOST_ASKED words of queries, are scored by an inverted index of the words that queries have."""
    q = stored(queries.select("query_id", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("word")))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")

    def joined(some: DataFrame) -> DataFrame:
        words = q.select("word").distinct()
        index = some.select("doc_id", F.explode(tokens_of(F.col("text"))).alias("word")).join(F.broadcast(words), "word", "left_semi").groupBy("doc_id", "word").agg(F.least(F.count("*"), F.lit(cap)).alias("c"))
        return index.join(q, "word").groupBy("query_id", "doc_id").agg(F.sum("c").alias("score"))

    def firsts(score: DataFrame) -> DataFrame:
        return score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    if q.count() > MOST_ASKED:
        return firsts(joined(docs))
    asked = q.groupBy("query_id", "word").agg(F.count("*").alias("k")).toArrow()
    if not asked.num_rows:
        return firsts(joined(docs))
    ids = asked.column("query_id").combine_chunks().dictionary_encode("encode")
    words = asked.column("word").combine_chunks().dictionary_encode()
    weights = asked.column("k").to_numpy()
    known, names = words.dictionary, ids.dictionary
    # The queries of each word: numbers first[w] to first[w + 1] of `of`.
    order = np.argsort(words.indices.to_numpy(), kind="stable")
    of, weight = ids.indices.to_numpy()[order].astype(np.int64), weights[order]
    first = np.searchsorted(words.indices.to_numpy()[order], np.arange(len(known) + 1))
    sent = docs.sparkSession.sparkContext.broadcast((known, first, of, weight))
    kind = dict(docs.dtypes)["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, of, weight = sent.value
        held, fields = None, [("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")]

        def cut(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by(fields)
            own = rows.column("query").to_numpy()
            return rows.filter(pa.array(np.arange(len(own)) - np.searchsorted(own, own) < k))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                lists = few.column("words")
                doc = np.repeat(np.arange(len(few)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                word = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                key, n = np.unique(doc[word >= 0] * len(known) + word[word >= 0], return_counts=True)
                doc, word, n = key // len(known), key % len(known), np.minimum(n, cap)
                size = first[word + 1] - first[word]
                entry = np.arange(size.sum()) + np.repeat(first[word] - np.append(0, np.cumsum(size)[:-1]), size)
                pair, where = np.unique(np.repeat(doc, size) << 32 | of[entry], return_inverse=True)
                total = np.bincount(where, np.repeat(n, size) * weight[entry], len(pair)).astype(np.int64)
                rows = pa.table({"query": pair & 0xFFFFFFFF, "score": total, "doc_id": few.column("doc_id").take(pa.array(pair >> 32))})
                held = cut(rows if held is None else pa.concat_tables([held, rows]))
        if held is not None:
            yield from held.select(["query", "doc_id", "score"]).to_batches()

    shared = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")))
    alone = docs.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select("doc_id", tokens_of(F.col("text")).alias("words"))
    several = docs.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    listed = docs.sparkSession.createDataFrame(pa.table({"query": np.arange(len(names)), "query_id": names}))
    near = alone.mapInArrow(score, f"query bigint, doc_id {kind}, score bigint").join(F.broadcast(listed), "query").select(F.col("query_id").cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "doc_id", "score")
    return firsts(near.unionByName(joined(several)))


#: Words of a question that tell nothing, and the points for an equal name, for the phrase, and for each word
#: of the question up to a most.
GENERIC = """a an analysis analyze annotation annotations best data dataset datasets do for how i in is method methods of package
packages recommend recommended show suggest tool tools use using what which with workflow workflows""".split()
NAME_POINTS, PHRASE_POINTS, WORD_POINTS, MOST_WORD_POINTS = 35, 18, 7, 21


def catalogue_text(text: Column) -> Column:
    """Lower case, with one space for each run of characters that names don't have."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9.+_-]+", " "))


def catalogue_search(queries: DataFrame, catalogue: DataFrame, k: int = 20) -> DataFrame:
    """queries: query_id, text. catalogue: name, text (all that is searched, the name too). Each query's k best entries by
    score, then name: query_id, name, score, n_words, rank. NAME_POINTS for an entry of that name, PHRASE_POINTS where the
    whole query is part of the text, and WORD_POINTS for each of its words that is part of it, MOST_WORD_POINTS at most;
    words of fewer than three letters and GENERIC ones don't count. Entries without points are left out.

    An index of words to entries, and one of letter groups to different words, find the words that contain a query's
    word; a phrase is looked for only in entries that have the phrase's longest word. Queries never meet all entries."""
    q = queries.select("query_id", catalogue_text(F.col("text")).alias("q")).where("query_id is not null and q <> ''")
    entries = stored(catalogue.where("name is not null").select("name", catalogue_text(F.col("name")).alias("key"), catalogue_text(F.col("text")).alias("t")))
    postings = stored(entries.select("name", F.explode(F.array_distinct(F.split("t", " "))).alias("word")))
    words = F.array_distinct(F.split("q", " "))
    asked = q.select("query_id", F.explode(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(GENERIC))).alias("part"), F.lit(False).alias("phrase"))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = stored(asked.union(q.select("query_id", longest, F.lit(True))))
    # Groups of as many letters as the part has, three at most.
    needed = asked.select("part").distinct().select("part", F.substring("part", 1, 3).alias("g"))
    lengths = F.array(*[F.lit(i) for i in (1, 2, 3)])
    grams = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - n + 1, F.lit(1))), lambda i: F.substring(F.col("word"), i, n))))
    vocabulary = postings.select("word").distinct().select("word", F.explode(F.array_distinct(grams)).alias("g"))
    within = vocabulary.join(needed, "g").where(F.contains("word", "part")).select("part", "word")
    met = asked.join(within, "part").join(postings, "word").select("query_id", "name", "part", "phrase").distinct()
    counted = met.where("not phrase").groupBy("query_id", "name").agg(F.count("*").alias("n_words"))
    whole = met.where("phrase").select("query_id", "name").join(q, "query_id").join(entries.select("name", "t"), "name").where(F.contains("t", "q")).select("query_id", "name").distinct()
    same = q.join(entries.select("name", F.col("key").alias("q")), "q").select("query_id", "name").distinct()
    zero = F.lit(0).cast("bigint")
    points = counted.select("query_id", "name", F.least(F.col("n_words") * WORD_POINTS, F.lit(MOST_WORD_POINTS)).cast("bigint").alias("score"), "n_words")
    points = points.union(whole.select("query_id", "name", zero + PHRASE_POINTS, zero)).union(same.select("query_id", "name", zero + NAME_POINTS, zero))
    score = points.groupBy("query_id", "name").agg(F.sum("score").alias("score"), F.sum("n_words").alias("n_words"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "name")
    return score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def chunks(docs: DataFrame, most: int = 1000) -> DataFrame:
    """doc_id, no, chunk: the text in pieces of at most `most` characters on line boundaries; a longer line is a piece of
    its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def add(acc: Column, line: Column) -> Column:
        fits = acc["cur"].isNull() | (F.length(acc["cur"]) + 1 + F.length(line) <= most)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"), F.when(acc["cur"].isNull() | ~fits, line).otherwise(F.concat_ws("\n", acc["cur"], line)).alias("cur"))

    pieces = F.aggregate(F.split(F.coalesce("text", F.lit("")), "\n"), start, add, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    return docs.select("doc_id", F.posexplode(pieces).alias("no", "chunk"))


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """term, n_docs, n: documents that have the term, and its occurrences."""
    low = docs.select(F.lower("text").alias("t"))
    each = F.array(*[F.struct(F.lit(t).alias("term"), F.regexp_count("t", F.lit(t)).alias("n")) for t in terms])
    rows = low.select(F.explode(each).alias("x")).select("x.*")
    return rows.groupBy("term").agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
