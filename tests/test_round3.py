"""Queries at larger sizes: what must not grow, and shared ids, against plain loops."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from omicspark.llm import collocations
from omicspark.operators import blocks, cohort, literature, neighbours, prs, reports, solvers
from tests.conftest import rows


def loop_pairs(own, most):
    n, first = Counter(), {}
    for s in own:
        s = "".join(c.upper() if "a" <= c <= "z" else c for c in s or "")
        for i in range(len(s) - 1):
            n[s[i : i + 2]] += 1
            first[s[i : i + 2]] = min(first.get(s[i : i + 2], i), i)
    return [(p, n[p], r + 1) for r, p in enumerate(sorted(n, key=lambda p: (-n[p], first[p]))[:most])]


def test_top_pairs_make_no_row_a_letter(spark):
    """agg42_top_pairs: letters are counted where the text lies"""
    rng = np.random.default_rng(3)
    texts = [(i, "".join(rng.choice(list("abAé\U0001f600 ß"), rng.integers(0, 60)))) for i in range(60)] + [(7, "zzzaab"), (7, None), (None, "xyxyxy"), (61, "q" * 25_001), (62, None)]
    out = reports.top_pairs(spark.createDataFrame(texts, "id long, seq string"), 3, 7)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append((r["pair"], r["n"], r["rank"]))
    ids = {i for i, _ in texts}
    expected = {i: x for i in ids if (x := loop_pairs([s for j, s in texts if j == i], 3))}
    # Equal n and equal first place of two rows of an id may come in either order.
    assert {i: x for i, x in got.items() if i != 7} == {i: x for i, x in expected.items() if i != 7}
    assert [n for _, n, _ in got[7]] == [n for _, n, _ in expected[7]]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "sequence(1" not in plan and "Generate" not in plan


def test_report_counts_equal_the_report(spark):
    """jon1_variant_report: the sums without a row for each missing variant"""
    rng = np.random.default_rng(5)
    panel = [(p, int(v), "ACGT"[v % 4], float(v % 7 - 3)) for p in ("p1", "p2") for v in rng.integers(0, 40, 30)] + [("p3", 500, "A", 1.0), ("p1", None, "A", 2.0), (None, 3, "A", 1.0)]
    calls = [(f"s{int(s)}", int(v), str(rng.choice(["AC", "GG", "TA", "A"]))) for s, v in rng.integers(0, 45, (300, 2)) % [6, 45]] + [("s9", 500, None), ("s8", 499, "AA"), (None, 3, "AA"), ("s1", None, "AA")]
    g, s = spark.createDataFrame(calls, "sample_id string, variant_id long, genotype string"), spark.createDataFrame(panel, "pgs_id string, variant_id long, effect_allele string, effect_weight double")
    out = prs.report_counts(g, s)
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in out.collect()}
    expected = {}
    for who in sorted({a for a, _, x in calls if a is not None and x is not None}):
        for p, v, allele, w in panel:
            own = [x for a, b, x in calls if a == who and b == v and b is not None and x is not None]
            for x in own or [None]:
                d = None if x is None else x.count(allele)
                n, dose, c, ids = expected.get((who, p, "missing" if x is None else "scored"), (0, None, 0.0, None))
                expected[who, p, "missing" if x is None else "scored"] = (n + 1, dose if d is None else (dose or 0) + d, c + (d or 0) * w, ids if v is None else (ids or 0) + v)
    assert {k: v for k, v in got.items() if k[1] is not None} == {k: v for k, v in expected.items() if k[1] is not None}
    assert "mapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_meet_only_where_samples_share_variants(spark, monkeypatch):
    """agg10_ibs, fn19_relationship: copies of a cohort with variants of their own don't multiply the blocks"""
    monkeypatch.setattr(blocks, "SAMPLES", 4)
    monkeypatch.setattr(blocks, "CALLS", 60)
    rng = np.random.default_rng(6)
    met = {}
    for copies in (2, 8):
        calls = [(c * 100 + s, c * 100 + v, [None, "1", "2"][v % 3], str(rng.choice(["AA", "AG", "GG"]))) for c in range(copies) for s in range(8) for v in range(12) if (s + v) % 5]
        df = spark.createDataFrame(calls, "sample long, variant long, part string, call string")
        samples = blocks.ranked(df.select("sample").distinct(), [F.col("sample")], "number")
        met[copies] = blocks.packed(df, blocks.genotype_bits, samples).agg(F.sum(F.size("all_own"))).first()[0]
        named = df.toDF("sample_id", "variant_id", "chrom", "genotype")
        got = {(r[0], r[1]): r[2] for r in blocks.ibs_pairs(named.where("chrom is not null")).where("chrom is null").select("sample_1", "sample_2", "n_overlap").collect()}
        own = {}
        for s, v, part, _ in calls:
            if part:
                own.setdefault(s, set()).add(v)
        assert got == {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b and own[a] & own[b]}
    # Four times the copies; blocks dealt by a hash would meet sixteen times as often.
    assert met[8] <= 6 * met[2]


def test_lead_recovery_equals_loops(spark):
    """agg48_lead_recovery: no list of variants is searched"""
    found = [("r1", 1), ("r1", 2), ("r1", 1), ("r1", 99), ("r2", 5), ("r3", None), (None, 3), ("r4", 77)]
    lead = [(1, "b"), (2, "a"), (3, "b"), (3, "c"), (4, None), (5, "d"), (5, "d"), (None, "x"), (6, "a")]
    out = reports.lead_recovery(spark.createDataFrame(found, "run string, variant long"), spark.createDataFrame(lead, "variant long, gene string"))
    expected = []
    for run in {r for r, _ in found}:
        own = {v for r, v in found if r == run and v is not None}
        some = {(v, g) for v, g in lead if v is not None}
        n = len({v for v, g in some if v in own and g})
        expected.append((run, 6, n, round(n / 6, 4), ",".join(sorted({g for v, g in some if v in own and g})), ",".join(sorted({g for v, g in some if v not in own and g}))))
    assert rows(out) == sorted(expected, key=repr)
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()
    none = reports.lead_recovery(spark.createDataFrame(found[:1], "run string, variant long"), spark.createDataFrame([], "variant long, gene string"))
    assert rows(none) == [("r1", 0, 0, None, "", "")]


def test_composition_counts_bytes_once(spark):
    """fn16_composition: code points are the length, a null or empty text has no share"""
    texts = [(1, "aAcxé\U0001f600ſK"), (2, ""), (None, None), (1, "MKV" * 50)]
    out = reports.composition(spark.createDataFrame(texts, "id long, seq string"), "ACK")
    expected = []
    for i, s in texts:
        up = "".join(c.upper() if "a" <= c <= "z" else c for c in s or "")
        expected += [(i, x, up.count(x), round(100 * up.count(x) / len(up), 6) if up else None) for x in "ACK"]
    assert rows(out) == sorted(expected, key=repr)
    assert "replace(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_founders_with_cycles_and_unknown_parents(spark):
    """jon21_founders: against loops; two parents that are one, unknown parents, a cycle and what descends from it"""
    rng = np.random.default_rng(8)
    family = [(i, None, None) for i in range(6)] + [(i, int(rng.integers(0, i)), int(rng.integers(0, i)) if i % 4 else None) for i in range(6, 60)]
    family += [(70, 71, 3), (71, 70, None), (72, 71, 5), (73, 999, 4), (74, 2, 2), (75, 75, 1), (76, 999, None), (77, None, None)]
    df = spark.createDataFrame(family, "id long, father long, mother long")
    parents = {i: {x for x in p if x is not None} for i, *p in family}
    expected = []
    for i in parents:
        seen, todo = set(), list(parents[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += parents.get(x, ())
        n = sum(x in parents and not parents[x] for x in seen)
        if n:
            expected.append((i, n))
    assert rows(cohort.founders(df)) == sorted(expected, key=repr)
    assert cohort.founders(df.where("id < 5")).count() == 0


def test_nearest_of_a_row_without_sorting(spark, monkeypatch):
    """agg29_graph_mixing, num6_graph: the bound keeps every neighbour, ties by id, in one part or several"""
    rng = np.random.default_rng(9)
    near = np.round(rng.normal(size=(40, 700)), 1)
    low = neighbours._least(near, 5)
    assert (np.sort(near, axis=1)[:, -5] >= low).all() and (near >= low[:, None]).sum() < 40 * 350
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    x[np.abs(x).sum(axis=1) == 0] = 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -9)
    expected = {(i, int(j), r + 1) for i in range(300) for r, j in enumerate(np.lexsort((np.arange(300), -cos[i]))[:5])}
    for part in (16384, 70):
        monkeypatch.setattr(neighbours, "WHOLE_PART", part)
        assert {tuple(r) for r in neighbours.neighbour_graph(df, 5, recall=None).select("vec_id", "neighbour", "rank").collect()} == expected


@pytest.mark.parametrize("most", [200_000, 3])
def test_keyword_ranking_equals_loops(spark, monkeypatch, most):
    """num7_keyword_ranking: a task keeps k documents a query; shared and null ids, repeated queries, ties"""
    monkeypatch.setattr(literature, "MOST_ASKED", most)
    rng = np.random.default_rng(10)
    words = ["alpha", "beta", "gamma", "delta", "of", "x1y", "Beta"]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(700)] + [(5, "alpha alpha"), (5, None), (None, "gamma, gamma"), (None, "gamma"), (9000, None)]
    queries = [("q1", "alpha beta"), ("q1", "beta of"), ("q2", "GAMMA gamma delta?"), ("q3", "unheard"), ("q4", None), (None, "x1y")]
    out = literature.keyword_ranking(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 4)
    tok = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if len(w) > 2]
    counts = {}
    for i, t in docs:
        counts.setdefault(i, Counter()).update(tok(t))
    expected = []
    for who in {q for q, _ in queries}:
        asked = [w for q, t in queries if q == who for w in set(tok(t))]
        score = {i: s for i, c in counts.items() if (s := sum(min(c[w], 3) for w in asked))}
        order = sorted(score, key=lambda i: (-score[i], i is not None, i or 0))[:4]
        expected += [(who, i, score[i], r + 1) for r, i in enumerate(order)]
    assert rows(out.select("query_id", "doc_id", "score", "rank")) == sorted(expected, key=repr)


@pytest.mark.parametrize("males", [500_000, 30])
def test_pairs_of_classes_are_expanded(spark, monkeypatch, males):
    """jon14_compatibility: products are of classes, whatever the number of their members"""
    monkeypatch.setattr(blocks, "MALES", males)
    met = []
    plain = blocks._all_pairs
    monkeypatch.setattr(blocks, "_all_pairs", lambda calls, *x: met.append(calls.select("sample").distinct().count()) or plain(calls, *x))
    calls = [(i, i % 2, v, (i // 2 * v) % 3) for i in range(160) for v in range(1, 5)] + [(0, 0, 1, 2), (500, 0, 9, 1)]
    got = {tuple(r) for r in blocks.compatibility(spark.createDataFrame(calls, "id long, sex int, locus long, state int")).collect()}
    has = lambda i, v: (i // 2 * v) % 3 > 0
    assert got == {(f, m, 4, 1 - sum(has(f, v) and has(m, v) for v in range(1, 5)) / 4) for f in range(0, 160, 2) for m in range(1, 160, 2)}
    assert met[0] <= 7


def test_ld_sums_over_parts_of_samples(spark, monkeypatch):
    """fil4_ld_prune: a few samples at a time give what all give at once"""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 3, (12, 50))
    base[6:] = np.where(rng.random((6, 50)) < 0.9, base[:6], base[6:])
    df = spark.createDataFrame([(s, v, 1, v * 10, int(base[v, s])) for v in range(12) for s in range(50) if rng.random() < 0.9], "sample_id long, variant_id long, chrom long, pos long, dosage int")
    whole = rows(solvers.linked_variants(df, 10, 0.3, 5))
    monkeypatch.setattr(solvers, "LD_SAMPLES", 7)
    assert rows(solvers.linked_variants(df, 10, 0.3, 5)) == whole and whole


def test_fingerprints_travel_in_five_bytes():
    """op13_collocations: what is shuffled and written"""
    rng = np.random.default_rng(12)
    own = np.append(rng.integers(0, 1 << 40, 1000).astype(np.uint64), np.uint64((1 << 40) - 1))
    assert len(collocations._packed(own)) == 5 * len(own) and (collocations._unpacked(collocations._packed(own)) == own).all()
    assert len(collocations._unpacked(b"")) == 0
    assert len(collocations._counts(np.array([1, 255]))) == 2 and len(collocations._counts(np.array([1, 256]))) == 8


@pytest.mark.parametrize("sizes", [{}, {"WINDOW": 20}, {"CLASS_PAIRS": 3, "TIED": 20}])
def test_disjoint_pairs_take_no_round_for_each(spark, monkeypatch, sizes):
    """F3 set5_disjoint_pairs: the greedy walk over classes is that over all pairs, in few steps where scores are tied"""
    for k, v in sizes.items():
        monkeypatch.setattr(cohort, k, v)
    steps = []
    plain = cohort.stored
    monkeypatch.setattr(cohort, "stored", lambda df: steps.append(1) or plain(df))
    rng = np.random.default_rng(13)
    calls = [(i, i % 2, v, ((i // 2 * v + i // 10) % 3)) for i in rng.permutation(70).tolist() for v in range(1, 4)]
    calls += [(101, 1, 1, 2), (103, 1, 1, 2), (105, 1, 9, 0), (100, 0, 1, 0)]
    df = spark.createDataFrame(calls, "id long, sex int, locus long, state int")
    taken, females, males = [], set(), set()
    for f, m, _, s in sorted(map(tuple, blocks.compatibility(df).collect()), key=lambda x: (-x[3], x[0], x[1])):
        if f not in females and m not in males:
            taken.append((f, m, s))
            females.add(f)
            males.add(m)
    steps.clear()
    out = cohort.disjoint_members(*blocks.compatible_classes(df))
    assert rows(out) == sorted(taken, key=repr) and len(taken) > 30
    assert sizes or len(steps) < 10
    assert cohort.disjoint_members(*blocks.compatible_classes(df.where("sex = 0"))).count() == 0


def test_ties_of_pairs_take_few_rounds(spark, monkeypatch):
    """40 females and 40 males of equal scores were 40 rounds"""
    steps = []
    plain = cohort.stored
    monkeypatch.setattr(cohort, "stored", lambda df: steps.append(1) or plain(df))
    df = spark.range(40).select(F.col("id").alias("female")).crossJoin(spark.range(40).select(F.col("id").alias("male"))).withColumn("compatibility", F.lit(0.5))
    assert rows(cohort.disjoint_pairs(df)) == sorted([(i, i, 0.5) for i in range(40)], key=repr)
    assert len(steps) < 6


def test_fingerprints_of_a_unit_travel_once():
    """op13_collocations: sorted fingerprints take little more than their differences, and one of a unit's blobs is dealt once"""
    rng = np.random.default_rng(14)
    blob = np.unique(rng.integers(0, 1 << 40, 150_000).astype(np.uint64))
    assert (collocations._grown(collocations._shrunk(blob)) == blob).all() and len(collocations._shrunk(blob)) < 4 * len(blob)
    assert len(collocations._grown(collocations._shrunk(blob[:0]))) == 0
    other = np.append(blob[::2], np.uint64((1 << 40) - 1))
    dealt = list(collocations._units(iter([(7, blob), (7, np.repeat(other, 300)), (8, blob[:0])]), 5))
    assert [x.num_rows for x in dealt] == [5, 0] and dealt[0].column("unit").to_pylist() == [7] * 5
    prints = np.concatenate([collocations._grown(x) for x in dealt[0].column("prints").to_pylist()])
    assert (prints == np.union1d(blob, other)).all() and dealt[0].column("slice").to_pylist() == list(range(5))
    counts = [np.frombuffer(collocations._expanded(x), np.uint32) for x in dealt[0].column("counts").to_pylist()]
    assert sum(map(len, counts)) == len(prints) and sum(int(x.sum()) for x in counts) == len(blob) + 300 * len(other)
