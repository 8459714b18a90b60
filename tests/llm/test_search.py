"""Ranked search against plain loops, and the query against its SQL."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from omicspark.llm import search


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items, top):
    own = [(i, words(t)) for i, t in docs]
    own = [(i, w) for i, w in own if w]
    n_docs, total = len(own), sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for name, text in items:
        scores = []
        for i, w in own:
            m = 75 + 25 * len(w) * n_docs // total
            s = 0
            for t in words(text):
                tf = w.count(t)
                if tf:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(name, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def corpus(n=600):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "naïve", "漢字", "x1"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    p /= p.sum()
    text = lambda k: " ".join(rng.choice(vocabulary, k, p=p))
    docs = [(i, text(rng.integers(1, 60))) for i in range(n)]
    copy = text(30)
    docs += [(2000 + i, copy) for i in range(200)]  # ties, a fourth of the rows
    docs += [(3000, text(5000)), (3001, None), (3002, ""), (3003, " ?! "), (None, text(20)), (None, copy), (7, docs[7][1]), (8, "W1 w1,w1-W2_w3")]
    items = [(i, text(k)) for i, k in enumerate([1, 3, 10, 40, 40, 300])] + [(6, copy), (7, None), (8, ""), (9, "unknown words"), (None, "w5 w6"), (11, "w250 W250 w251")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"SHARD": 37, "BUNDLE": 4}, {"SHARD_POSTINGS": 500, "BUNDLE_TERMS": 30, "BLOCK_TERMS": 60}, {"STAGES": (0.5,)}])
def test_search_equals_loops(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(search, k, v)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("x")).repartition(2)
    out = search.search(d, i, top=5)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(docs, items, 5)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert search.search(docs.limit(0), items).count() == 0
    none = search.search(docs, items.limit(0))
    assert none.count() == 0 and none.dtypes == search.search(docs, items).dtypes


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = sorted(duck.execute(search.ORACLE).fetchall())
    assert sorted(map(tuple, __spark_entry__.queries()["op11_search"](spark, sf).collect())) == expected and len(expected) > 100
