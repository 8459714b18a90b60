"""Quality by hierarchical empirical Bayes: a document's own evidence with its host's and path's posteriors.

A logistic model of features of the text gives each document a log likelihood ratio and a probability. The
probabilities are summed by path and host (partial aggregates). Each path's share of good documents is shrunk toward its
host's, and each host's toward the global one, with strengths estimated from the spread between paths and hosts (the
method of moments), so that sparse sites follow their prior. A document's posterior odds are its likelihood ratio times
the prior odds of its path, from which its own probability was taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from omicspark.llm import tokens
from omicspark.llm.common import appended, pieces, saved, with_fields

#: Labelled documents of either class that the classifier is fitted on at most.
SAMPLE = 5000
#: Strengths of priors, in documents, lie between these.
LEAST, MOST = 1.0, 10_000.0
#: Bytes whose shares of the text are features.
SIGNS = np.frombuffer(b".,;:!?|#$%&*@<>{}[]()_=/\\\"'-", np.uint8)
N_FEATURES = 12 + len(SIGNS)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers that describe each text: sizes, kinds of characters, repetition of words and lines."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    out = np.zeros((n, N_FEATURES))
    per = 1 / np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text[mask], minlength=n) * per

    start, end, own, hashes = tokens.words(tokens.LOWER[data], offsets, tokens.NON_SPACE)
    words = np.bincount(own, minlength=n)
    each = 1 / np.maximum(words, 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2] = share((data >= 65) & (data <= 90))
    out[:, 3] = share((data >= 48) & (data <= 57))
    out[:, 4] = share(data == 10)
    out[:, 5] = share(data >= 128)
    length = end - start
    out[:, 6] = np.bincount(own, weights=length, minlength=n) * each
    out[:, 7] = np.sqrt(np.maximum(np.bincount(own, weights=length**2.0, minlength=n) * each - out[:, 6] ** 2, 0))
    for back, at in ((1, 8), (2, 9)):  # words like the one before, or the one before that
        same = (hashes[back:] == hashes[:-back]) & (own[back:] == own[:-back])
        out[:, at] = np.bincount(own[back:][same], minlength=n) * each
    different = np.unique(np.stack([own.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64) if len(own) else np.zeros(0, np.int64)
    out[:, 10] = np.bincount(different, minlength=n) / np.sqrt(np.maximum(words, 1))
    out[:, 11] = out[:, 10] / np.sqrt(np.maximum(words, 1))
    for i, sign in enumerate(SIGNS):
        out[:, 12 + i] = np.sqrt(share(data == sign))
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> dict[str, np.ndarray]:
    """Logistic regression on the standardised features, their squares and clipped tails, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = _design(x, mean, scale)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        move = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += move * min(1, 5 / (np.abs(move).max() + 1e-12))
    base = (y.sum() + 1) / (len(y) + 2)
    return {"mean": mean, "scale": scale, "w": w, "prior": np.log(base / (1 - base))}


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.ones((len(z), 1)), z, z**2], axis=1)


def _each(docs: DataFrame, text_col: str, field: T.StructField, value) -> DataFrame:
    schema = with_fields(docs.schema, [field])
    arrow = to_arrow_schema(schema)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(rows, text_col):
            yield appended(batch, arrow, {field.name: value(features(data, offsets), arrow.field(field.name).type)})

    return docs.mapInArrow(add, schema)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict[str, np.ndarray]:
    """The classifier, fitted on at most `sample` labelled documents of either class, by the hash of their ids, where
    `learn` holds. An id that is labelled again has its highest label, a document that is repeated its first text by hash.
    Only the documents' features come to the driver."""
    known = (labels if learn is None else labels.where(learn)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    parts = [known.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample) for c in (0, 1)]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(parts[0].union(parts[1])), "_id")
    first = F.min_by(F.struct("_label", "_text"), F.struct(F.xxhash64("_text"), "_text")).alias("_x")
    rows = rows.groupBy("_id").agg(first).select("_id", "_x._label", "_x._text")
    described = _each(rows, "_text", T.StructField("_x", T.ArrayType(T.DoubleType())), lambda x, kind: pa.array(list(x), kind))
    got = described.select("_id", "_label", "_x").orderBy(F.xxhash64("_id"), "_label", "_x").toPandas()
    if not len(got):
        return train(np.zeros((1, N_FEATURES)), np.zeros(1))
    return train(np.stack(got["_x"].to_list()), got["_label"].to_numpy(float))


def with_evidence(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with evidence: the log likelihood ratio of a good document. A null or empty text counts as one of no words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def ratio(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        m = sent.value
        return pa.array(np.clip(_design(x, m["mean"], m["scale"]) @ m["w"], -30, 30) - m["prior"], kind)

    return _each(docs, text_col, T.StructField("evidence", T.DoubleType()), ratio)


def _strength(rate: str, prior: str) -> Column:
    """Prior strength from groups with n documents, their own rate and their prior's: mean m(1-m) over the variance
    between groups beyond that of sampling, less one."""
    p, q = F.col(rate), F.col(prior)
    spread = F.sum(F.col("n") * (p - q) * (p - q))
    noise = F.sum(q * (1 - q))
    between = F.greatest(spread - noise, F.lit(0.0)) / F.greatest(F.sum("n") - F.count("*"), F.lit(1))
    typical = F.sum(F.col("n") * q * (1 - q)) / F.sum("n")
    return F.coalesce(F.least(F.greatest(F.try_divide(typical, between) - 1, F.lit(LEAST)), F.lit(MOST)), F.lit(MOST))


def posterior(evidence: DataFrame, prior_log_odds: float, host_col: str = "host", path_col: str = "path") -> DataFrame:
    """evidence: host, path, evidence, and any other columns. Adds host_posterior, path_posterior and score (columns of these
    names give way); null hosts and paths are groups of their own, and a null evidence is none. Sums by path are partial
    aggregates, and only they meet in the join by path, which adaptive execution splits where a path has many documents."""
    rest = [c for c in evidence.columns if c.lower() not in ("host_posterior", "path_posterior", "score")]
    known = F.coalesce(F.col("evidence"), F.lit(0.0))
    # The rows travel as one column, so that none of theirs is taken for a sum.
    df = evidence.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(host_col).alias("h"), F.col(path_col).alias("u"), known.alias("e"), (1 / (1 + F.exp(-(known + F.lit(prior_log_odds))))).alias("p"))
    paths = saved(df.groupBy("h", "u").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    mean = hosts.agg((F.sum("s") / F.sum("n")).alias("mean")).first()["mean"]  # one number, null without rows
    hosts = hosts.withColumns({"mean": F.lit(mean).cast("double"), "rate": F.col("s") / F.col("n")})
    k = hosts.agg(_strength("rate", "mean").alias("k")).first()["k"]
    hosts = saved(hosts.select(F.col("h").alias("_h"), ((F.col("s") + k * F.col("mean")) / (F.col("n") + k)).alias("host_posterior")))
    level = paths.join(hosts, paths["h"].eqNullSafe(hosts["_h"])).drop("_h").withColumn("rate", F.col("s") / F.col("n"))
    level = saved(level.withColumn("k", F.lit(level.agg(_strength("rate", "host_posterior").alias("k")).first()["k"])))
    level = level.select(F.col("h").alias("_h"), F.col("u").alias("_u"), "n", "s", "k", "host_posterior")
    out = df.join(level, df["h"].eqNullSafe(level["_h"]) & df["u"].eqNullSafe(level["_u"]))
    others = (F.col("s") - F.col("p") + F.col("k") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("k"))
    out = out.withColumn("path_posterior", F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6)))
    odds = F.col("e") + F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))
    return out.select("row.*", "host_posterior", "path_posterior", (1 / (1 + F.exp(-odds))).alias("score"))


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, score: one row per row of docs, repeats included."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    own = saved(with_evidence(slim, model).drop("text"))
    return posterior(own, float(model["prior"]))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Of documents, with source as host and lang as path; labels of the held-out fold are not learnt from."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held))
    return out.select("doc_id", held.alias("held_out"), *[F.round(c, 9).alias(c) for c in ("evidence", "host_posterior", "path_posterior", "score")], (F.col("score") >= 0.5).alias("keep"))
