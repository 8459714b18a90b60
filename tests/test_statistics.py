"""Tests and intervals against enumeration, numeric integration and plain loops."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from omicspark.functions import stats
from omicspark.operators import expression, gwas, prs


def t_tail(x, df, steps=200_000):
    """P(T > x) by the trapezium rule after y = 1 / u beyond x."""
    c = math.gamma((df + 1) / 2) / math.gamma(df / 2) / math.sqrt(df * math.pi)
    u = np.linspace(1e-9, 1 / x, steps)
    f = c * (1 + 1 / (u * u * df)) ** (-(df + 1) / 2) / (u * u)
    return float(np.sum((f[1:] + f[:-1]) / 2) * (u[1] - u[0]))


def exact(a, b):
    """Two-sided p by all arrangements of the values."""
    both = sorted([*a, *b])
    u = lambda own: sum(both.index(x) for x in own) - len(a) * (len(a) - 1) / 2
    seen, half = u(a), len(a) * len(b) / 2
    all_u = [u(c) for c in itertools.combinations(both, len(a))]
    return min(1.0, 2 * sum(x >= max(seen, 2 * half - seen) for x in all_u) / len(all_u))


def test_exact_rank_sums(spark):
    rng = np.random.default_rng(0)
    rows, expected = [(0, 1, float(x)) for x in (1, 2, 3)] + [(0, 0, float(x)) for x in (4, 5, 6)], {0: 0.1}
    for g, (n0, n1) in enumerate([(1, 1), (3, 5), (8, 4), (2, 9), (5, 5), (3, 3)], 1):
        a, b = rng.standard_normal(n1), rng.standard_normal(n0)
        rows += [(g, 1, float(x)) for x in a] + [(g, 0, float(x)) for x in b]
        expected[g] = exact(list(a), list(b))
    rows += [(90, 1, 1.0), (90, 0, 1.0), (90, 0, 2.0), (91, 1, 1.0), (92, 0, None)]
    got = {r["gene"]: r for r in expression.rank_sums(spark.createDataFrame(rows, "gene long, grp int, v double"), "v", ["gene"]).collect()}
    for g, p in expected.items():
        assert got[g]["exact"] and got[g]["p"] == pytest.approx(p, abs=1e-12)
    assert not got[90]["exact"] and got[91]["p"] is None and 92 not in got


def test_exact_p_of_a_large_group():
    u, n0, n1 = pd.Series([0.0, 100.0]), pd.Series([2, 2]), pd.Series([3000, 3000])
    total = math.comb(3002, 2)
    at_most = sum(1 for i in range(3001) for j in range(i, 3001) if i + j <= 100)
    assert stats.mann_whitney_exact_p.func(u, n0, n1).tolist() == pytest.approx([2 / total, 2 * at_most / total], rel=1e-12)


def test_t_quantile():
    for p, df in [(0.975, 4), (0.95, 7), (0.999, 3)]:
        x = stats.t_quantile(p, df)
        assert t_tail(x, df) == pytest.approx(1 - p, rel=1e-6)
    assert stats.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987, rel=1e-10)


def test_regulation_against_the_curve(spark):
    rng = np.random.default_rng(1)
    rows = [(g, s, s % 2, float(rng.normal(g % 7 * (s % 2), 0.4)) if rng.random() > 0.1 else None) for g in range(60) for s in range(8)]
    got = expression.protein_regulation(spark.createDataFrame(rows, "gene long, sample_id long, grp int, v double"), "v").collect()
    assert len(got) == 60 and {"upregulated", "non significant"} <= {r["regulation"] for r in got}
    ta, s0 = stats.t_quantile(0.975, 4), 0.1
    for r in got:
        x, y = ([v for g, s, grp, v in rows if g == r["gene"] and grp == k and v is not None] for k in (1, 0))
        fc = np.mean(x) - np.mean(y)
        assert r["log2fc"] == pytest.approx(fc) and r["mean_intensity"] == pytest.approx(np.mean(x + y))
        if min(len(x), len(y)) < 2:
            assert r["p"] is None and r["padj"] == 1 and r["regulation"] == "non significant"
            continue
        a, b = np.var(x, ddof=1) / len(x), np.var(y, ddof=1) / len(y)
        df = (a + b) ** 2 / (a * a / (len(x) - 1) + b * b / (len(y) - 1))
        assert r["p"] == pytest.approx(2 * t_tail(abs(fc) / math.sqrt(a + b), df), rel=1e-5)
        label = "non significant"
        if abs(fc) > ta * s0:
            need = -math.log10(2 * t_tail(ta * (1 + s0 / (abs(fc) / ta - s0)), 4))
            assert r["threshold"] == pytest.approx(need, rel=1e-6)
            if -math.log10(r["p"]) >= need:
                label = "upregulated" if fc > 0 else "downregulated"
        else:
            assert r["threshold"] is None
        assert r["regulation"] == label
    # Benjamini and Hochberg.
    p = sorted((1.0 if r["p"] is None else r["p"], r["padj"]) for r in got)
    low = 1.0
    for i in range(len(p), 0, -1):
        low = min(low, p[i - 1][0] * len(p) / i)
        assert p[i - 1][1] == pytest.approx(low)


def normal_p(z):
    return math.erfc(abs(z) / math.sqrt(2))


@pytest.mark.parametrize("within", [None, "sample"])
def test_pairwise_contrasts(spark, within):
    rng = np.random.default_rng(2)
    obs = [(c, ["a", "b", "c", "d", None][min(4, int(rng.integers(0, 5)))] if c else "e", f"s{c % 3}") for c in range(60)]
    counts = {(c, g): int(rng.integers(0, 4)) for c in range(60) for g in range(4) if rng.random() < 0.6}
    cells = spark.createDataFrame([(g, c, n) for (c, g), n in counts.items()] + [(9, 0, 0)], "gene long, cell long, count long")
    got = expression.pairwise_markers(cells, spark.createDataFrame(obs, "cell long, kind string, sample string"), "kind", within).collect()
    expected = {}
    for w in {o[2] for o in obs} if within else {None}:
        for g in (0, 1, 2, 3, 9):
            for one, other in itertools.combinations("abcde", 2):
                x, y = ([counts.get((c, g), 0) for c, kind, s in obs if kind == k and (w is None or s == w)] for k in (one, other))
                if min(len(x), len(y)) < 2:
                    continue
                u = sum((b < a) + (a == b) / 2 for a in x for b in y)
                n, d, v = len(x) + len(y), u - len(x) * len(y) / 2, len(x) * len(y) / 12
                ties = sum(k**3 - k for k in ((x + y).count(t) for t in set(x + y)))
                tied = v * (n + 1 - ties / n / (n - 1))
                z, zt = d / math.sqrt(v * (n + 1)), d / math.sqrt(tied) if tied > 1e-12 else 0.0
                expected[w, g, one, other] = (len(x), len(y), sum(a > 0 for a in x) / len(x), sum(b > 0 for b in y) / len(y), u, z, normal_p(z), zt, normal_p(zt))
    assert {(r[within] if within else None, r["gene"], r["group_1"], r["group_2"]) for r in got} == set(expected)
    for r in got:
        own = expected[r[within] if within else None, r["gene"], r["group_1"], r["group_2"]]
        assert [r[c] for c in ("n1", "n2", "pts1", "pts2", "u", "z", "p", "z_ties", "p_ties")] == pytest.approx(own, abs=1e-9)
        family = sorted(expected[k][6] for k in expected if k[0] == (r[within] if within else None) and k[2:] == (r["group_1"], r["group_2"]))
        assert r["padj"] == pytest.approx(min(1.0, *[p * len(family) / (i + 1) for i, p in enumerate(family) if p >= r["p"] - 1e-12]))


def test_contrasts_of_nothing(spark):
    cells, obs = spark.createDataFrame([], "gene long, cell long, count long"), spark.createDataFrame([], "cell long, kind string")
    assert expression.pairwise_markers(cells, obs, "kind").count() == 0


def test_bootstrap_of_the_median(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{k}", f"rs{i}", float(rng.uniform(0.1, 0.4)), float(rng.normal(0.05 * k, 0.02)), float(rng.uniform(0.01, 0.03))) for k in range(3) for i in range(3 + 10 * k)]
    rows += [("p9", "rs1", 0.2, 0.1, 0.02), ("p9", "rs2", 0.0, 0.1, 0.02), ("p9", "rs3", 0.2, None, 0.02)]
    df = spark.createDataFrame(rows, "pair_id string, snp string, beta_exposure double, beta_outcome double, se_outcome double")
    got = {r["pair_id"]: r for r in gwas.weighted_median_test(df).collect()}
    again = {r["pair_id"]: r for r in gwas.weighted_median_test(df.repartition(7)).collect()}
    assert got == again
    for pair, r in got.items():
        own = [x for x in rows if x[0] == pair and x[2] and x[3] is not None]
        weight = np.array([(x[2] / x[4]) ** 2 for x in own])

        def median(outcome, own=own, weight=weight):
            ratio = [y / x[2] for x, y in zip(own, outcome, strict=True)]
            upto = 0.0
            for i in np.argsort(ratio, kind="stable"):
                upto += weight[i] / weight.sum()
                if upto >= 0.5:
                    return ratio[i]

        assert r["n"] == len(own) and r["estimate"] == pytest.approx(median([x[3] for x in own]))
        loop = np.std([median([x[3] + rng.normal(0, x[4]) for x in own]) for _ in range(4000)])
        assert r["se"] == pytest.approx(loop, rel=0.08)
        assert r["ci_upper"] - r["ci_lower"] == pytest.approx(3.92 * r["se"]) and r["p"] == pytest.approx(normal_p(r["estimate"] / r["se"]), rel=1e-6)


def test_organ_ages_with_holes(spark):
    values = [("s1", "a", 2.0), ("s1", "b", 3.0), ("s2", "a", 2.0), ("s2", "b", None), ("s3", "a", 4.0), ("s4", "b", float("nan")), ("s4", "a", 1.0)]
    weights = [("heart", "a", 0.5), ("heart", "b", 10.0), ("heart", "x", 1.0), ("liver", "a", 1.0), ("lung", "y", 2.0)]
    out = expression.organ_ages(spark.createDataFrame(values, "sample_id string, protein string, value double"), spark.createDataFrame(weights, "organ string, protein string, weight double"))
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in out.collect()}
    assert len(got) == 12
    assert got["s1", "heart"] == (31.0, 2, 1)
    assert [got[s, "heart"][0] for s in ("s2", "s3", "s4")] == [None] * 3
    assert got["s3", "liver"] == (4.0, 1, 0) and got["s1", "lung"] == (None, 0, 1)


def test_report_of_missing_variants(spark, monkeypatch):
    rng = np.random.default_rng(4)
    scores = [(p, v, "ACGT"[v % 4], float(v)) for p in ("p1", "p2") for v in range(70000 if p == "p1" else 3)]
    calls = [("s1", int(v), "AC") for v in rng.choice(70000, 500, replace=False)] + [("s2", 70001, "GG"), ("s3", 5, None)]
    out = prs.variant_report(spark.createDataFrame(calls, "sample_id string, variant_id long, genotype string"), spark.createDataFrame(scores, "pgs_id string, variant_id long, effect_allele string, effect_weight double"))
    called = {v: g for s, v, g in calls if s == "s1"}
    n = out.groupBy("sample_id", "pgs_id").agg(F.count("*").alias("n"), F.countDistinct("variant_id").alias("d"), F.count_if(F.col("status") == "missing").alias("m")).collect()
    assert {(r[0], r[1]): (r[2], r[3], r[4]) for r in n} == {
        ("s1", "p1"): (70000, 70000, 69500), ("s1", "p2"): (3, 3, 3 - sum(v < 3 for v in called)), ("s2", "p1"): (70000, 70000, 70000), ("s2", "p2"): (3, 3, 3),
    }
    for r in out.where("sample_id = 's1' and pgs_id = 'p1'").collect():
        g = called.get(r["variant_id"])
        assert (r["status"], r["genotype"], r["contribution"]) == (("scored", g, g.count(r["effect_allele"]) * r["effect_weight"]) if g else ("missing", None, 0.0))
