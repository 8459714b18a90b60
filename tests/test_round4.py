"""Cases of the fourth round of findings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from omicspark.operators import blocks
from tests.test_blocks import ibs


@pytest.mark.parametrize("sizes", [{}, {"SAMPLES": 5, "CALLS": 300, "AT_ONCE": 40, "ROWS": 7}])
def test_sparse_and_dense_blocks_equal_loops(spark, monkeypatch, sizes):
    """F2 agg10_ibs, F3 fn19_relationship: where few samples are called, blocks hold their calls and no bits for all others"""
    for k, v in sizes.items():
        monkeypatch.setattr(blocks, k, v)
    rng = np.random.default_rng(20)
    kinds = ["AA", "AG", "GA", "GG", "A", "G", "", "CT"]
    # Variants below 40 are called in all samples, the others in a few.
    calls = [(f"s{s:02d}", int(v), ["1", None, "2"][v % 3], str(rng.choice(kinds))) for v in range(400) for s in range(60) if v < 40 or rng.random() < 0.05]
    calls += [(s, v, c, str(rng.choice(kinds))) for s, v, c, _ in calls[::50]]
    df = spark.createDataFrame(calls, "sample_id string, variant_id long, chrom string, genotype string")
    own = {}
    for s, v, c, g in calls:
        own.setdefault(s, {})[v] = (c, min(g, own.get(s, {}).get(v, (c, g))[1]))
    expected, whole = {}, {}
    for a in own:
        for b in own:
            for v in own[a].keys() & own[b].keys() if a < b else ():
                x = ibs(own[a][v][1], own[b][v][1])
                for at, k in ((expected, (a, b, own[a][v][0])), (whole, (a, b))):
                    s, n, c = at.get(k, (0, 0, 0))
                    at[k] = (s + x, n + 1, c + (x == 2))
    score = lambda s, n, c: ((s * 10**6 + n) // (2 * n) / 1e6, n, c)
    got = [tuple(r) for r in blocks.ibs_pairs(df).collect()]
    assert sorted(got, key=repr) == sorted([(*k, *score(*x)) for k, x in expected.items()] + [(*k, None, *score(*x)) for k, x in whole.items()], key=repr)
    only = blocks.ibs_pairs(df, by_chrom=False)
    assert {(r[0], r[1]): tuple(r[3:]) for r in only.collect()} == {k: score(*x) for k, x in whole.items()} and only.count() == len(whole)


def test_blocks_follow_the_calls(spark):
    """ten times the samples at the same calls take no more bytes"""
    size = {}
    for n in (200, 2000):
        df = spark.range(20_000).select((F.col("id") * 7919 % n).alias("sample"), (F.col("id") % 500).alias("variant"), F.lit(1).alias("part"), F.lit("AG").alias("call")).distinct()
        samples = blocks.ranked(df.select("sample").distinct(), [F.col("sample")], "number")
        made = blocks.packed(df, blocks.genotype_bits, samples)
        binary = [F.length(c) for c, t in made.dtypes if t == "binary"]
        size[n] = made.agg(F.sum(sum(binary[1:], binary[0]))).first()[0] / df.count()
    assert size[2000] < 10


def test_rounded_half_up():
    """F2: the score is rounded in the task as SQL does: 1/128 is 0.007813"""
    n = np.array([[127], [1], [0]])
    assert blocks.ibs_columns(n)[0].tolist() == [0.003906] and blocks.ibs_columns(np.array([[63], [1], [0]]))[0].tolist() == [0.007813]


def test_relationships_make_no_rows_by_chromosome(spark):
    """F3 fn19_relationship: rows of chromosomes are not made to be left out"""
    import __spark_entry__

    df = __spark_entry__.queries()["fn19_relationship"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter isnull" not in plan and "isnull(chrom" not in plan and df.count() > 0


@pytest.mark.parametrize("sizes", [{}, {"TILE": (3, 5)}, {"CLASS_PAIRS": 3}, {"MALES": 20}])
def test_expanded_pairs_are_all_there(spark, monkeypatch, sizes):
    """F4 jon14_compatibility: pairs in tiles are those of loops, also of individuals without common loci"""
    for k, v in sizes.items():
        monkeypatch.setattr(blocks, k, v)
    calls = [(f"i{i:03d}", i % 2, v, (i // 2 * v + i // 10) % 3) for i in range(90) for v in range(1, 5) if i % 11 or v > 2] + [("x", 0, 9, 1), ("y", 1, 8, 1)]
    own = {}
    for i, sex, v, state in calls:
        own.setdefault((sex, i), {})[v] = state > 0
    both = [(f[1], m[1], x.keys() & y.keys(), x, y) for f, x in own.items() for m, y in own.items() if f[0] == 0 and m[0] == 1]
    expected = [(f, m, len(v), round(1 - sum(x[k] and y[k] for k in v) / len(v), 6)) for f, m, v, x, y in both if v]
    df = spark.createDataFrame(calls, "id string, sex int, locus long, state int")
    assert sorted(map(tuple, blocks.compatibility(df).collect())) == sorted(expected)
    assert blocks.compatibility(df.where("sex = 1")).count() == 0


def test_written_pairs_are_small(spark, tmp_path):
    """the result grows with the square of the individuals, so that its rows are in an order that files keep small"""
    calls = spark.range(3000).selectExpr("id", "cast(id % 2 as int) as sex", "id % 7 as state").selectExpr("id", "sex", "1L as locus", "cast(state % 3 as int) as state")
    blocks.compatibility(calls).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("female", "male").distinct().count() == out.count() == 1500 * 1500
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.4 * out.count()


def test_unrelated_texts_meet_in_few_buckets(spark, monkeypatch):
    """F1 pipeline: texts that share a passage, but not four fifths, don't meet by its shingles; near copies are all found"""
    from omicspark.llm import shingles

    rng = np.random.default_rng(21)
    passage = [f"p{i}" for i in range(60)]
    own = [[f"w{x}" for x in rng.integers(0, 10**9, 60)] for _ in range(200)]
    texts = [" ".join(x[:30] + passage + x[30:]) for x in own] + [" ".join(x[:30] + passage + x[30:-1]) for x in own[:20]]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    met, plain = [], shingles.unsettled
    monkeypatch.setattr(shingles, "unsettled", lambda rows: met.append(rows.count()) or plain(rows))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, _ = shingles.classes(docs)
    assert dict(map(tuple, out.select("doc_id", "component_id").collect())) == dict(enumerate(root)) and root[200:] == list(range(20))
    # The twenty pairs share some 24 of their hashes each; the passage's would bring 220 rows each.
    assert met[0] < 20 * 2 * 30
    level = shingles.commonness(docs)
    assert level.shape == (shingles.SLOTS,) and level.max() >= shingles.STEPS * 7 and shingles.commonness(docs.limit(0)).max() == 0
