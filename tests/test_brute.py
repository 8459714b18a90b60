"""Operators without SQL against plain loops, and hand cases of rules that SQL of the same hand could repeat."""

import itertools
import math

import numpy as np
import pytest

from omicspark.jobs.registry import QUERIES
from omicspark.operators import cohort, expression, gwas, literature, pgx, popgen, solvers
from omicspark.sources.adapters import view
from tests.test_jobs import SF

P2 = lambda z: math.erfc(abs(z) / math.sqrt(2))


def bh(p):
    """Adjusted p-values of a list."""
    order, out, least = np.argsort(p, kind="stable"), np.empty(len(p)), 1.0
    for k in range(len(p), 0, -1):
        least = min(least, p[order[k - 1]] * len(p) / k)
        out[order[k - 1]] = least
    return out


def test_normal_p_values(spark):
    """agg12_association_p, agg15_ivw_p, agg16_egger_p, agg17_steiger_p, agg21_de_p"""
    for r in gwas.association(view(spark, SF, "dosages").selectExpr("variant_id", "cast(dosage as double) as x", "cast(sample_id % 13 as double) as y")).collect():
        assert r.p == pytest.approx(P2(r.z), rel=1e-9, abs=1e-300)
    inst = view(spark, SF, "instruments")
    for r in gwas.ivw(inst).collect():
        assert r.p == pytest.approx(P2(r.estimate / r.se), rel=1e-9)
        df, x = r.n - 1, r.q / 2
        if df % 2 == 0:  # closed form of the chi-squared tail
            assert r.q_p == pytest.approx(math.exp(-x) * sum(x**k / math.factorial(k) for k in range(df // 2)), rel=1e-6, abs=1e-12)
    for r in gwas.egger(inst).collect():
        assert r.slope_p == pytest.approx(P2(r.slope / r.slope_se), rel=1e-9) and r.intercept_p == pytest.approx(P2(r.intercept / r.intercept_se), rel=1e-9)
    for r in gwas.sensitivity(inst).collect():
        assert r.steiger_p == pytest.approx(P2(r.steiger_z), rel=1e-3, abs=1e-12)
    got = expression.differential_expression(view(spark, SF, "counts")).collect()
    p = [P2(r.z) for r in got]
    assert np.allclose([r.p for r in got], p, rtol=1e-9) and np.allclose([r.padj for r in got], bh(np.array(p)), rtol=1e-9)


def test_rank_sum_abundance(spark):
    """agg23_abundance"""
    counts = view(spark, SF, "counts")
    by = {}
    for r in counts.collect():
        by.setdefault(r.gene, ([], []))[r.grp].append(r["count"])
    p, fc = {}, {}
    for g, (a, b) in by.items():
        if min(len(a), len(b)) < 3:
            continue
        u = sum((y > x) + 0.5 * (y == x) for x in a for y in b)
        both = a + b
        n = len(both)
        ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
        var = len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1)))
        p[g] = P2(max(abs(u - len(a) * len(b) / 2) - 0.5, 0) / math.sqrt(var)) if var else 1.0
        if not ties and min(len(a), len(b)) <= 8:  # of all arrangements those at least as far from the middle
            us = [sum(c) - len(b) * (len(b) - 1) / 2 for c in itertools.combinations(range(n), len(b))]
            p[g] = min(1.0, 2 * sum(x >= max(u, len(a) * len(b) - u) for x in us) / len(us))
        fc[g] = np.mean(b) - np.mean(a)
    got = {r.gene: r for r in expression.differential_abundance(counts, "count", "rank_sum").collect()}
    assert set(got) == set(p)
    genes = sorted(p)
    assert np.allclose([got[g].p for g in genes], [p[g] for g in genes], rtol=1e-9)
    assert np.allclose([got[g].padj for g in genes], bh(np.array([p[g] for g in genes])), rtol=1e-9)
    assert all(got[g].significant == (got[g].padj <= 0.05 and abs(fc[g]) >= 0.25) for g in genes)


def test_score_percentiles(spark):
    """agg9_prs_percentile"""
    freq = {}
    for s in view(spark, SF, "scores").collect():
        if 0 < s.allele_freq < 1:
            freq.setdefault(s.pgs_id, []).append((s.allele_freq, s.effect_weight))
    for r in QUERIES["agg9_prs_percentile"](spark, SF).collect():
        own = freq.get(r.pgs_id, [])
        sd = math.sqrt(sum(2 * f * (1 - f) * w * w for f, w in own))
        if len(own) < 3 or not sd:
            assert r.method == "unavailable" and r.percentile is None
            continue
        z = (r.raw_score - sum(2 * f * w for f, w in own)) / sd
        assert abs(r.z_score - z) < 6e-4 and abs(r.percentile - 50 * math.erfc(-z / math.sqrt(2))) < 0.06


def walked(steps, least=3.0):
    """Segments of one chromosome: (position, step) pairs in order."""
    out, held, score, best = [], [], 0.0, 0.0
    for p, x in steps:
        score = round(score + x, 9)
        if held or score > 0:
            held.append(p)
        best = max(best, score)
        if held and score < 0:
            if best >= least:
                out.append((held[0], p, round(best, 6), len(held)))
            held, score, best = [], 0.0, 0.0
    if held and best >= least:
        out.append((held[0], held[-1], round(best, 6), len(held)))
    return out


def test_segments_against_a_walk(spark):
    """win12_segments, agg49_introgression"""
    rng = np.random.default_rng(1)
    rows, want = [], set()
    for s in range(30):
        m, a = rng.integers(0, 3, 80), rng.integers(0, 3, 80)
        rows += [(s, 1, int(i * 10), int(x), int(y)) for i, (x, y) in enumerate(zip(m, a, strict=True))]
        steps = [(i * 10, 0.8 + 0.2 * min(x, y) if x and y else 0.1 if not x and not y else -0.5) for i, (x, y) in enumerate(zip(m.tolist(), a.tolist(), strict=True))]
        want |= {(s, *x) for x in walked(steps)}
    got = solvers.segments(spark.createDataFrame(rows, "sample_id long, chrom long, pos long, modern long, archaic long"))
    assert {(r.sample_id, r.start, r.end, round(r.score, 6), r.n_variants) for r in got.collect()} == want and want
    by = {r.sample_id: r for r in solvers.segment_summary(got).collect()}
    for s in {x[0] for x in want}:
        own = [x for x in want if x[0] == s]
        assert (by[s].n_segments, by[s].total_bp) == (len(own), sum(x[2] - x[1] for x in own))


def test_pruning_equals_the_walk(spark):
    """fil4_ld_prune: blocks of 7 against one walk over random chromosomes"""
    rng = np.random.default_rng(2)
    rows, kept = [], {}
    for c in (1, 2):
        x = rng.integers(0, 3, (12, 40)).astype(float)
        for i in range(1, 40):
            if rng.random() < 0.7:
                x[:, i] = np.where(rng.random(12) < 0.85, x[:, i - 1], x[:, i])
        rows += [(s, c * 100 + i, c, i, int(x[s, i])) for s in range(12) for i in range(40)]
        z = x - x.mean(axis=0)
        z /= np.where(np.linalg.norm(z, axis=0) > 0, np.linalg.norm(z, axis=0), 1)
        for i in range(40):
            kept[c * 100 + i] = not any(kept[c * 100 + j] and (z[:, i] @ z[:, j]) ** 2 > 0.4 for j in range(max(0, i - 10), i))
    df = spark.createDataFrame(rows, "sample_id long, variant_id long, chrom long, pos long, dosage long")
    for block in (7, 1000):
        assert {r.variant_id: r.kept for r in solvers.ld_prune(df, 10, 0.4, block).collect()} == kept
    assert not all(kept.values())


def test_hardy_weinberg(spark):
    """fil3_hwe, and the step of the quality-control cascade"""
    def brute(a, h, b):
        n, rare = a + h + b, min(2 * a + h, 2 * b + h)
        w = {k: math.factorial(n) / math.factorial((rare - k) // 2) / math.factorial(k) / math.factorial(n - (rare + k) // 2) * 2.0**k for k in range(rare % 2, rare + 1, 2)}
        return sum(x for x in w.values() if x <= w[h] * (1 + 1e-9)) / sum(w.values())

    cases = [(10, 20, 10), (20, 0, 20), (5, 1, 30), (0, 3, 17), (7, 7, 7)]
    df = spark.createDataFrame(cases, "n_ref long, n_het long, n_alt long")
    for r in df.select("*", solvers.hwe_p("n_ref", "n_het", "n_alt").alias("p")).collect():
        assert r.p == pytest.approx(brute(r.n_ref, r.n_het, r.n_alt), rel=1e-9)
    rows = [(s, 1, s % 2 * 2) for s in range(40)] + [(s, 2, s % 3) for s in range(40)]
    df = spark.createDataFrame(rows, "sample_id long, variant_id long, dosage long")
    assert {r.variant_id for r in popgen.genotype_qc(df).select("variant_id").distinct().collect()} == {2}
    assert popgen.genotype_qc(df, least_hwe=None).select("variant_id").distinct().count() == 2


def test_no_effect_on_a_null_locus(spark):
    """num3_susie, num4 share the locus form: without signal no inclusion probability is forced; with one it is found"""
    rng = np.random.default_rng(0)
    stats = [(0, i, float(x), 1000.0) for i, x in enumerate(rng.normal(0, 0.3, 30))] + [(1, i, 9.0 if i == 4 else float(x), 1000.0) for i, x in enumerate(rng.normal(0, 0.3, 30))]
    ld = [(k, i, i, 1.0) for k in (0, 1) for i in range(30)]
    got = solvers.finemap_susie(spark.createDataFrame(stats, "locus long, variant_id long, z double, n double"), spark.createDataFrame(ld, "locus long, i long, j long, r double")).collect()
    assert max(r.pip for r in got if r.locus == 0) < 0.2 and all(r.credible_set == 0 for r in got if r.locus == 0)
    assert {r.variant_id for r in got if r.locus == 1 and r.pip > 0.9} == {4}


def test_diplotype_rules(spark):
    panel = spark.createDataFrame([("A", 1, "*2", "T", 0.0, None), ("A", 2, "*3", "G", 0.0, None), ("A", 3, "*4", "C", 0.5, None), ("A", 4, "*5", "DEL", 0.0, None), ("D", 5, "*2A", "T", 0.0, "dpyd"), ("V", 6, "", "A", 0.0, "genotype")], "gene string, variant_id long, star string, alt string, activity double, kind string")
    calls = {
        1: [(1, "CT"), (2, "AG")],  # two heterozygous sites without function: phase unknown
        2: [(1, "TT"), (2, "AA"), (3, "AC")], 3: [(1, "CC"), (2, "AA"), (3, "CC")], 4: [(1, "CC"), (2, "AA"), (3, "AA")], 5: [(1, "CC"), (4, "AD")],
        6: [(3, "AC"), (1, "CT")], 7: [(5, "CT"), (6, "AG")], 8: [(5, "TT")], 9: [(5, "CC")], 10: [(4, "DD")],
    }
    df = spark.createDataFrame([(s, v, g) for s, own in calls.items() for v, g in own], "sample_id long, variant_id long, genotype string")
    got = {(r.sample_id, r.gene): (r.diplotype, r.phenotype) for r in pgx.phenotypes(pgx.diplotypes(df, panel)).collect()}
    assert got[1, "A"] == ("indeterminate (phase)", "indeterminate") and got[6, "A"] == ("indeterminate (phase)", "indeterminate")
    assert got[2, "A"] == ("*2/*2", "poor") and got[3, "A"] == ("*4/*4", "intermediate") and got[4, "A"] == ("*1/*1", "normal")
    assert got[5, "A"] == ("indeterminate (structural variant)", "indeterminate") and (10, "A") not in got
    assert got[7, "D"] == ("Normal/*2A", "intermediate") and got[7, "V"][0] == "AG" and got[8, "D"] == ("*2A/*2A", "poor") and got[9, "D"] == ("Normal/Normal", "normal")
    sites = spark.createDataFrame([(1, "rs1", "GA"), (1, "rs2", "TG"), (2, "rs1", "TC"), (2, "rs2", "CA"), (3, "rs1", "GG")], "sample_id long, variant_id string, genotype string")
    assert sorted(map(tuple, pgx.mthfr(sites, "rs1", "rs2").collect())) == [(1, "677CT/1298AC"), (2, "677CT/1298AC"), (3, "677CC/1298NOT_TESTED")]


def test_missing_traits_and_calls(spark):
    traits = spark.createDataFrame([(1, "x", 5), (2, "y", 9)], "id long, trait string, value long")
    gates = spark.createDataFrame([("s", "x", 3), ("s", "y", 3)], "skill string, trait string, least long")
    assert sorted(map(tuple, cohort.gates_passed(traits, gates).collect())) == [(1, "s", False, "y"), (2, "s", False, "x")]
    calls = spark.createDataFrame([(1, 7, 2), (2, 9, 1)], "sample_id long, variant_id long, dosage long")
    needs = spark.createDataFrame([("d", 7, "alt/alt")], "disease string, variant_id long, need string")
    assert sorted(map(tuple, cohort.disease_status(calls, needs).collect())) == [(1, "d", True), (2, "d", False)]


def test_chromosomes_in_order(spark):
    df = spark.createDataFrame([(c, p) for c in ("10", "2", "X", "1", "MT") for p in (5, 10)], "chrom string, pos long")
    got = {(r.chrom, r.pos): r.genome_pos for r in gwas.genome_offsets(df).collect()}
    assert [got[c, 5] for c in ("1", "2", "10", "X", "MT")] == [5, 15, 25, 35, 45]


def test_even_sample_of_uneven_groups(spark):
    rows = [(i, "abc"[(i % 7 > 1) + (i % 7 > 2)]) for i in range(60)]
    take = lambda x, n: x if n >= len(x) else [x[int(round(p))] for p in np.linspace(0, len(x) - 1, num=n)]
    groups = {g: [i for i, x in rows if x == g] for g in dict.fromkeys(x for _, x in rows)}
    chosen = {i for own in groups.values() for i in take(own, min(len(own), 48 // len(groups)))}
    left = {g: [i for i in own if i not in chosen] for g, own in groups.items()}
    while len(chosen) < 48:
        for g in sorted((g for g in groups if left[g]), key=lambda g: -len(left[g])):
            if len(chosen) < 48:
                chosen.add(left[g].pop(0))
    df = spark.createDataFrame(rows, "i long, g string")
    assert {r.i for r in expression.evenly_spaced(df, ["i"], "g").collect()} == chosen
    assert [r.i for r in expression.evenly_spaced(df, ["i"], None, 4).orderBy("i").collect()] == take(list(range(60)), 4)
    assert [r.i for r in expression.evenly_spaced(df.limit(11), ["i"], None, 4).orderBy("i").collect()] == [0, 3, 7, 10]


def test_downshift_moments(spark):
    """agg24_downshift"""
    values = [(g, s, None if (g + s) % 3 == 0 else float(g * g + s)) for g in range(9) for s in range(5)]
    df = spark.createDataFrame(values, "gene long, sample_id long, value double")
    known = [v for *_, v in values if v is not None]
    m, s = expression.matrix_moments(df)
    assert m == np.median(known) and s == pytest.approx(np.std(known))
    out = expression.downshift(df).where("imputed").collect()
    assert len(out) == 15 and all(abs(r.value - (m - 1.8 * s)) < 5 * 0.3 * s for r in out)


def test_nearest_in_blocks(spark):
    v = view(spark, SF, "vectors")
    q = v.where("vec_id % 3 = 0")
    assert sorted(map(tuple, literature.nearest(q, v, 3).collect())) == sorted(map(tuple, literature.nearest(q, v, 3, 4).collect()))


def test_organ_ages_and_build(spark):
    values = spark.createDataFrame([(1, "p", 2.0), (1, "q", 1.0)], "sample_id long, protein string, value double")
    coef = spark.createDataFrame([("o", "p", 0.5), ("o", "r", 1.0)], "organ string, protein string, weight double")
    r = expression.organ_ages(values, coef, spark.createDataFrame([("o", 10.0)], "organ string, intercept double")).first()
    assert (r.age, r.n_used, r.n_missing) == (11.0, 1, 1)
    years = expression.organ_ages(values, coef, hazard=True).first().age
    assert years == pytest.approx((1.0 + 4.801912) / 0.0897860500778604 + 9.94613787413831)
    assert [tuple(x) for x in expression.missing_proteins(values, coef).collect()] == [("o", "r")]
    calls = spark.createDataFrame([(1, 1, 100), (1, 2, 205), (2, 1, 90), (2, 2, 180), (2, 3, 300), (3, 1, 0)], "sample_id long, variant_id long, pos long")
    build = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "variant_id long, expected_pos long")
    assert sorted(map(tuple, pgx.genome_build(calls, build, 5).collect())) == [(1, 2, 0, False), (2, 1, 2, True)]
    with pytest.raises(ValueError, match="misses"):
        expression.aligned(values.selectExpr("sample_id", "value"), spark.createDataFrame([(2, "x")], "sample_id long, g string"), "g")
