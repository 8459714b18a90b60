"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omicspark.llm import decontaminate, linededup, mixing, simhash, toxicity
from omicspark.llm.common import saved


def _aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with columns of these names (in any case of letters) under others, so that an operator's own don't replace them."""
    return docs.select([F.col(f"`{c}`").alias(f"_in_{c}" if c.lower() in names else c) for c in docs.columns])


def _back(out: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of docs, from what _aside gave to an operator."""
    return out.select([F.col(f"`_in_{c}`").alias(c) if c.lower() in names else F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score toxicity.THRESHOLD or more; null and empty texts are scored like others. The
    network learns from the labelled documents of the input outside the held-out fold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = ["_toxicity"]
    scored = toxicity.score(_aside(docs, own), model, out_col="_toxicity").where(F.col("_toxicity") < toxicity.THRESHOLD)
    return _back(scored, docs, own)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the lines that ten documents or more share out of every text; all documents stay, some of them shorter (a
    null text becomes empty). n_chars follows the text."""
    own = ["n_lines", "n_dropped"]
    out = _back(linededup.drop_common_lines(_aside(docs, own)), docs, own)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (chains of texts whose sets of five-word shingles have a Jaccard similarity
    of at least 0.8) the row with the smallest doc_id, once. Rows that repeat both doc_id and text are one; different
    texts with one doc_id are documents of their own. Documents without a doc_id can't be told apart and stay."""
    own, given = ["_th"], docs
    docs = _aside(docs, own)
    marks, repeated = simhash.similar(docs.where("doc_id is not null"))
    once = marks.where("first").select("doc_id", F.col("th").alias("_th"))
    # Sort-merge at every size: the ids grow with the documents, so that no small size may stand for them.
    marked = docs.withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = marked.join(once.hint("merge"), ["doc_id", "_th"], "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["doc_id", "_th"])
    return _back(kept.select(*docs.columns).union(docs.where("doc_id is null")), given, own)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents in which a window of a benchmark item occurs."""
    own = ["n_words", "hit_spans", "items"]
    out = decontaminate.decontaminate(_aside(docs, own), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _back(out.where(F.size("hit_spans") == 0), docs, own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document: the words that the mix takes of it."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: A trained network and a graph's components have no SQL; the tests hold each stage against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
