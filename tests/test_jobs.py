"""Every registered query against its SQL on the smallest tables, and hand cases of single operators."""

import importlib.util
import math
import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from omicspark.functions import stats
from omicspark.jobs.registry import ORACLES, QUERIES
from omicspark.operators import annotate, cohort, components, expression, gwas, literature, popgen, prs, solvers
from tests.conftest import rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return repr(x)
    if isinstance(x, (int, float, Decimal, np.number)):
        return "nan" if math.isnan(x) else repr(round(float(x), 6) + 0.0)
    return repr(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_imports():
    assert importlib.util.find_spec("__spark_entry__")
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_ibs_by_hand(spark):
    cases = [("AG", "AG", 2), ("AG", "GA", 2), ("AA", "AG", 1), ("AA", "GG", 0), ("A", "A", 2), ("A", "G", 0), ("A", "AG", 0), ("AA", "AA", 2), ("AG", "GG", 1)]
    df = spark.createDataFrame(cases, "a string, b string, n int").select("n", prs.ibs_at_site(F.col("a"), F.col("b")).alias("got"))
    assert all(r.n == r.got for r in df.collect())


def test_alt_count_by_hand(spark):
    cases = [("AG", "A", "G", 1), ("TC", "A", "G", 1), ("CC", "A", "G", 2), ("AT", "A", "T", None), ("AC", "A", "G", None), ("GG", "G", "C", None)]
    df = spark.createDataFrame(cases, "g string, r string, a string, n int").select("n", prs.alt_count(F.col("g"), F.col("r"), F.col("a")).alias("got"))
    assert all(r.n == r.got for r in df.collect())


def test_heterozygosity_invariants(spark):
    d = spark.createDataFrame([(s, 1, "A" if s < 3 else "B", x) for s, x in enumerate([0, 1, 2, 1, 1, None])] + [(0, 2, "A", None)], "sample_id long, variant_id long, population string, dosage int")
    assert rows(popgen.heterozygosity(d)) == [("A", 1, 0.333333, 0.5), ("B", 1, 1.0, 0.5)]
    assert rows(popgen.pairwise_fst(d)) == [("A", "B", 1, 0.0)]
    with pytest.raises(ValueError):
        popgen.equity_score(d, (0, 0, 0, 0))
    with pytest.raises(ValueError):
        popgen.equity_score(d, (1, -1, 1, 1))


def test_distributions():
    import pandas as pd

    x = np.array([-3, -0.5, 0, 1, 1.95996398454, 2.2, 6])
    want = np.array([math.erfc(v / math.sqrt(2)) / 2 for v in x])
    assert np.allclose(0.5 * stats._erfc(x / np.sqrt(2)), want, rtol=1e-10)
    assert np.allclose(stats.chi2_sf.func(pd.Series([3.841458820694124, 10.0]), pd.Series([1, 3])), [0.05, 0.01856613546304], atol=1e-9)
    assert np.allclose(stats.t_two_sided_p.func(pd.Series([2.2281388519649385, 0.0]), pd.Series([10.0, 4.0])), [0.05, 1.0], atol=1e-9)
    assert np.allclose(solvers.hwe_p.func(pd.Series([57]), pd.Series([14]), pd.Series([50])), [8.42e-22], atol=1e-3)
    assert np.allclose(solvers.hwe_p.func(pd.Series([25, 0]), pd.Series([50, 0]), pd.Series([25, 0])), [1.0, 1.0])


def test_bh_with_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, float("nan"))], "i int, p double").withColumn("g", F.lit(0))
    got = {r.i: round(r.padj, 6) for r in expression.benjamini_hochberg(df, "p", ["g"], ["i"]).collect()}
    assert got == {1: 0.05, 2: 0.066667, 3: 0.066667, 4: 1.0, 5: 1.0}


def test_bh_over_ranges_is_the_same(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 50 == 3, None).otherwise((F.col("id") * 7919 % 1009) ** 2 / 1009.0**2).alias("p"), F.lit(0).alias("g"))
    one = {r.id: round(r.padj, 9) for r in expression.benjamini_hochberg(df, "p", ["g"], ["id"]).collect()}
    assert one == {r.id: round(r.padj, 9) for r in expression.benjamini_hochberg_global(df, "p", ["id"], slices=7).collect()}


def test_segments_by_hand(spark):
    df = spark.createDataFrame([(1, 1, p, m, a) for p, (m, a) in enumerate([(0, 1), (1, 1), (2, 2), (1, 1), (1, 1), (0, 1)] + [(0, 2)] * 12)], "sample_id long, chrom long, pos long, modern int, archaic int")
    got = solvers.segments(df).collect()
    assert [(r.start, r.end, round(r.score, 6)) for r in got] == [(1, 12, 3.7)]


def test_susie_finds_planted_effects(spark):
    rng = np.random.default_rng(0)
    n, p = 2000, 40
    x = rng.normal(size=(n, p))
    x[:, 1:] += 0.5 * x[:, :-1]
    y = 0.35 * x[:, 10] - 0.3 * x[:, 30] + rng.normal(size=n)
    r = np.corrcoef(x.T)
    b = np.array([np.polyfit(x[:, j], y, 1)[0] for j in range(p)])
    res = np.array([np.std(y - b[j] * x[:, j]) / (np.std(x[:, j]) * np.sqrt(n)) for j in range(p)])
    st = spark.createDataFrame([(1, j, float(b[j] / res[j]), float(n)) for j in range(p)], "locus long, variant_id long, z double, n double")
    ld = spark.createDataFrame([(1, i, j, float(r[i, j])) for i in range(p) for j in range(i)], "locus long, i long, j long, r double")
    for method in ("susie", "susie_inf"):
        got = {g.variant_id: g for g in solvers.finemap(st, ld, method).collect()}
        assert got[10].pip > 0.9 and got[30].pip > 0.9 and got[10].converged, method
        assert got[10].credible_set != got[30].credible_set and got[20].pip < 0.2, method


def test_ancestry_recovers_a_population(spark):
    rng = np.random.default_rng(1)
    f = rng.uniform(0.05, 0.95, (200, 2))
    panel = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(f)], "variant_id long, afr double, eur double")
    calls = spark.createDataFrame([(7, i, int(rng.binomial(2, f[i, 1]))) for i in range(200)], "sample_id long, variant_id long, alt_count int")
    got = {r.population: r.proportion for r in solvers.ancestry_proportions(calls, panel, ["afr", "eur"]).collect()}
    assert got["eur"] > 0.9 and abs(sum(got.values()) - 1) < 1e-9


def test_pca_separates_groups(spark):
    rng = np.random.default_rng(3)
    d = [(s, v, int(rng.binomial(2, 0.1 if (s < 6) == (v < 50) else 0.9))) for s in range(12) for v in range(100)]
    got = {r.sample_id: r.score for r in components.pca(spark.createDataFrame(d, "sample_id long, variant_id long, dosage int"), 1).collect()}
    assert len({got[s] > 0 for s in range(6)}) == 1 and (got[0] > 0) != (got[11] > 0)


def test_ld_prune_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (6, 40))
    d = [(s, v, 1, v * 10, int(x[v % 6, s])) for v in range(12) for s in range(40)]
    df = spark.createDataFrame(d, "sample_id long, variant_id long, chrom long, pos long, dosage int")
    got = {r.variant_id: r.kept for r in solvers.ld_prune(df, window=8, block=5).collect()}
    assert got == {v: v < 6 for v in range(12)}


def test_version_order_and_chunks(spark):
    t = spark.createDataFrame([("a", "1.9.2"), ("a", "1.10"), ("a", "1.9"), ("b", "x")], "tool string, version string")
    assert rows(cohort.latest_versions(t)) == [("a", "1.10", 3), ("b", "x", 1)]
    c = spark.createDataFrame([(1, "aaa\nbb\n" + "c" * 12 + "\nd"), (2, None)], "doc_id int, text string")
    assert rows(literature.chunks(c, 8)) == [(1, 0, "aaa\nbb"), (1, 1, "c" * 12), (1, 2, "d"), (2, 0, "")]


def test_global_rank_has_no_single_task(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = gwas.ranked(df, [F.col("x").desc()], slices=8).collect()
    assert all(r["rank"] == 1000 - r.x for r in got)


def test_resistance(spark):
    d = spark.createDataFrame([("blaTEM-1", ""), ("x", "Penicillin"), ("mecA", "carbapenem"), (None, None)], "g string, d string")
    assert [r[0] for r in d.select(annotate.resistance_tier(F.col("g"), F.col("d"))).collect()] == ["Critical", "Medium", "Critical", "Not classified"]


def test_orfs():
    s = "CC" + "ATG" + "AAA" * 100 + "TAA" + "G"
    assert solvers.open_reading_frames.func(pd.Series([s, "ATGTAA", None])).tolist() == [[{"frame": 2, "start": 2, "end": 308}], [], []]
