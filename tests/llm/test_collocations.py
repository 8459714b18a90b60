"""Collocations against plain loops, and the query against its SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from omicspark.llm import collocations, tokens


def brute(docs, least, most, top, within):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    for lang in n:
        f_own = {p: c for (x, p), c in f.items() if x == lang}
        scored = []
        for p, a in f_own.items():
            if len(p) < 2 or a < least:
                continue
            longer = [c for q, c in f_own.items() if len(q) > len(p) and c >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * c >= within * a for c in longer):
                continue
            score, k = min((2000000 * a // (f_own[p[:k]] + f_own[p[k:]]), k) for k in range(1, len(p)))
            phrase = " ".join(p)
            scored.append((-score, -a, phrase.encode(), phrase, f_own[p[:k]], f_own[p[k:]]))
        out += [(lang, r + 1, phrase, -a, left, right, n[lang], -s) for r, (s, a, _, phrase, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(6)
    vocabulary = ["the", "of", "a", "été", "漢字", "x\x00y", "'s", *[f"w{i}" for i in range(20)]]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    p /= p.sum()
    marks = [" ", " ", " ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", " ;\r\n", "!? "]
    docs = []
    for i in range(300):
        text = "".join(w + rng.choice(marks) for w in rng.choice(vocabulary, rng.integers(0, 60), p=p))
        docs.append((["en", "de", None, "und"][i % 4], text.upper() if i % 7 == 0 else text))
    docs += [("en", "one long shared passage of words. One long")] * 120  # a hot text
    docs += [("en", None), ("fr", ""), (None, None), ("fr", " .. "), ("xx", "the of"), ("en", "w1 " * 3000 + "w2 w3")]
    return docs


@pytest.mark.parametrize("sizes", [{}, {"BLOB": 200, "SLICE": 1000}])
def test_collocations_equal_loops(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(collocations, k, v)
    docs = corpus()
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit("x")).withColumn("n", F.lit("y")).withColumn("piece", F.lit(1)).repartition(3)
    out = collocations.collocations(df, least=10, most=4, top=60, within=80)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, out.collect()))
    expected = brute(docs, 10, 4, 60, 80)
    assert got == expected and len(expected) > 20


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """With fingerprints of six bits all counts still come from the texts."""
    real = tokens.mixed
    monkeypatch.setattr(collocations.Runs, "fingerprints", lambda self, at, k: real(tokens.span_hashes(self.data, self.start[at], self.end[at + k - 1]) ^ self.lang) & np.uint64(63))
    docs = corpus()[:200]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(df, least=10, top=60).collect())) == brute(docs, 10, 4, 60, 80)


@pytest.mark.parametrize("most", [2, 3])
def test_shorter_phrases(spark, most):
    docs = corpus()[:150]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(df, least=5, most=most, top=40, within=90).collect())) == brute(docs, 5, most, 40, 90)


def test_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", " ")], "lang string, text string")).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(duck.execute(collocations.ORACLE).fetchall())
    assert sorted(map(tuple, __spark_entry__.queries()["op13_collocations"](spark, sf).collect())) == expected and len(expected) > 20
