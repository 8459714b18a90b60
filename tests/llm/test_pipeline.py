"""The pipeline's stages on small tables: each against brute force, clashing columns, and empty tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from omicspark.llm import mixing, toxicity

BENCH = "one quite special question about the long river that nobody answers well"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pipe"))
    rng = np.random.default_rng(12)
    word = lambda: f"w{rng.integers(0, 4000)}"
    docs, labels = [], []
    for i in range(160):
        text = " ".join(word() for _ in range(40))
        if i % 8 == 0:
            text += " vile scum filth vile scum"
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        if i % 5 == 0:
            text = "A shared footer line\n" + text
        if i in (31, 33):
            text += "\n" + BENCH
        docs.append((i, text, "en", ["a", "b", None][i % 3]))
    docs += [(500 + i, docs[1][1], "en", "a") for i in range(4)]  # copies
    docs += [(900, None, None, None), (901, "", "en", "b"), (902, " ".join(word() for _ in range(30_000)), "en", "b")]
    spark.createDataFrame([(*d, len(d[1] or ""), "mine", 5, "t", "x") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, _th string, n_words int, _toxicity string, items string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(7, BENCH), (8, None), (9, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def columns_stay(out, docs):
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {r[0] for r in out.select("_th").distinct().collect()} == {"mine"} and {r[0] for r in out.select("_toxicity").distinct().collect()} == {"t"}


def test_toxic_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage("toxicity")(spark, docs, folder)
    columns_stay(out, docs)
    left = {r[0] for r in out.select("doc_id").collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.doc_id: r.s for r in toxicity.score(docs.select("doc_id", "text"), model, out_col="s").collect()}
    assert left == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    assert not left & set(range(0, 160, 8)) and len(left) > 130


def test_shared_lines_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage("line_dedup")(spark, docs, folder)
    columns_stay(out, docs)
    given = {r.doc_id: r.text for r in docs.collect()}
    keys = {}
    for i, t in given.items():
        for line in set(x.strip(" \t\n\r\x0b\x0c").lower() for x in (t or "").split("\n")):
            keys.setdefault(line, set()).add(i)
    for r in out.collect():
        want = "\n".join(x for x in (given[r.doc_id] or "").split("\n") if not x.strip() or len(keys[x.strip(" \t\n\r\x0b\x0c").lower()]) < 10)
        assert r.text == want and r.n_chars == len(want)


def test_contaminated_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage("decontamination")(spark, docs, folder)
    columns_stay(out, docs)
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = {tuple(words(BENCH)[i : i + 10]) for i in range(len(words(BENCH)) - 9)}
    hit = {r.doc_id for r in docs.collect() if any(tuple(words(r.text)[i : i + 10]) in windows for i in range(len(words(r.text)) - 9))}
    assert hit == {31, 33} and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - hit


def test_the_mix_is_of_what_is_left(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id % 3 = 0")
    out = stage("mixing")(spark, docs, folder).collect()
    want = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()}
    assert {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in out} == want


def test_stages_in_a_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, folder)
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {r.doc_id for r in docs.collect()}
    assert 1 in got and not got & {500, 501, 502, 503, 31, 33, 8, 16} and 902 in got
    assert len(got) > 100


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
