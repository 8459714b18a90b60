"""The learnt and vector operators, and the pipeline, against brute force or held-out accuracy."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from omicspark.llm import embeddings as E
from omicspark.llm import quality as Q
from omicspark.llm import toxicity as T

BAD = ["loser", "idiot", "zorkan", "zorkest", "zorkity"]


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        w = list(rng.choice(vocab, rng.integers(3, 150)))
        toxic = i % 4 == 0
        if toxic:
            w.insert(int(rng.integers(0, len(w) + 1)), BAD[int(rng.integers(0, len(BAD)))])
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_learns():
    rows = corpus()
    model = T.train([r[1] for r in rows[:300]], [r[2] for r in rows[:300]])
    raw = [r[1].encode() for r in rows[300:]]
    tok = T.Tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    start, length, text = tok.windows()
    best = np.full(len(raw), -np.inf)
    np.maximum.at(best, text, T._window_logits(model, tok, start, length))
    label = np.array([r[2] for r in rows[300:]])
    assert (((1 / (1 + np.exp(-best))) >= T.THRESHOLD) == label).mean() > 0.9


def test_toxicity_gradients():
    rng = np.random.default_rng(1)
    raw = [b"some words here and there " * 3, b"few"]
    tok = T.Tokens(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + 3]))
    m = {k: v.astype(np.float64) if isinstance(v, np.ndarray) else v for k, v in T._start(tok, np.repeat([0, 1], tok.counts), np.array([1.0, 0.0]), rng).items()}
    start, length, text = tok.windows()
    label = np.array([1.0, 0.0])[text]
    at = T._kinds(tok, start, length)

    def loss(m):
        x = tok.inputs(m)
        z = T.forward(m, x @ m["w_f"] + m["w_f0"], x @ m["w_b"] + m["w_b0"], at, length)
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    g = T.gradients(m, tok, tok.inputs(m), at, length, label)
    for name in ("u_f", "un_b", "w_f", "attend", "out", "attend_v"):
        i = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        up, down = ({k: v.copy() if k == name else v for k, v in m.items()} for _ in range(2))
        up[name][i] += 1e-2
        down[name][i] -= 1e-2
        assert np.isclose((loss(up) - loss(down)) / 2e-2, g[name][i], rtol=0.05, atol=1e-4), name


def test_windows_cover_every_token():
    raw = [b"", b"a " * 5, b"b " * T.WINDOW, b"c " * 200]
    tok = T.Tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    start, length, text = tok.windows()
    base = np.concatenate([[0], np.cumsum(tok.counts)])
    for t, n in enumerate(tok.counts):
        seen = {int(x) for s, k in zip(start[text == t], length[text == t], strict=True) for x in range(s - base[t], s - base[t] + k)}
        assert seen == set(range(n))
    assert (text == 0).sum() == 1


def test_toxicity_in_spark(spark):
    rows = corpus(240)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(None, None, 1.0), (1, "", 2.0), (2, "idiot " + "x" * 5000, 3.0)], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = T.score(docs, T.fit(docs, labels)).collect()
    assert len(got) == 243 and all(0 <= r.toxicity <= 1 for r in got)
    held = [(r.toxicity >= T.THRESHOLD) == (r.doc_id % 4 == 0) for r in got[:240] if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean(held) > 0.8
    assert T.score(docs.limit(0), T.train([], [])).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 64))
    near = np.concatenate([base[:40] + 0.02 * rng.normal(size=(40, 64)) for _ in range(12)])
    hub = base[50] + 0.03 * rng.normal(size=(400, 64))
    x = np.concatenate([base, near, hub, base[:5] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    extra = [(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] + [1.0] * 63, 1), (9004, [None] + [1.0] * 63, 1), (9005, [], 1), (None, base[0].tolist(), 1), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (9008, rows[7][1], 1)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>, kept int")
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(extra)
    y = np.concatenate([x, x[7:8]]).astype(float)
    ids = [*range(len(x)), 9008]
    u = y / np.linalg.norm(y, axis=1)[:, None]
    link = u @ u.T >= 0.95
    n = link.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in ids])
    assert (found <= n).all() and found.sum() >= 0.99 * n.sum()
    assert got[9006].n_links == 1 and got[9007].component_id == 9006
    for i in (9001, 9002, 9003, 9004, 9005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and not got[None].kept
    assert {got[i].component_id for i in range(780, 1180)} == {50}
    assert E.near_duplicates(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i, t, y in corpus(320, 8):
        good = i % 3 > 0
        text = t if good else " | ".join(t.split()[:20] + ["###"] * 6)
        lines = [text]
        if i % 9 == 0:
            lines.append("  A line that many documents share ")
        if i == 33:
            lines.append("the bench passage " + " ".join(map(str, range(12))))
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}" if i % 5 else "s0", 1))
        labels.append((i, int(good), y))
    rows += [(1000, rows[2][1], "en", "s1", 1), (1001, rows[2][1], "en", None, 1), (1002, None, None, "s0", None), (1003, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, "the bench passage " + " ".join(map(str, range(12))))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    assert rng is not None
    return str(out)


def naive_posterior(rows, prior):
    """rows: host, path, evidence. The three added numbers of each row, by plain loops."""
    import math

    p = [1 / (1 + math.exp(-((e or 0.0) + prior))) for _, _, e in rows]

    def strength(groups):  # n, rate, prior of each
        spread = sum(n * (r - q) ** 2 for n, r, q in groups) - sum(q * (1 - q) for _, _, q in groups)
        between = max(spread, 0.0) / max(sum(n for n, _, _ in groups) - len(groups), 1)
        typical = sum(n * q * (1 - q) for n, _, q in groups) / sum(n for n, _, _ in groups)
        return Q.MOST if between == 0 else min(max(typical / between - 1, Q.LEAST), Q.MOST)

    def sums(key):
        out = {}
        for r, x in zip(rows, p, strict=True):
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, s + x)
        return out

    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    mean = sum(p) / len(p)
    k = strength([(n, s / n, mean) for n, s in hosts.values()])
    host = {h: (s + k * mean) / (n + k) for h, (n, s) in hosts.items()}
    k = strength([(n, s / n, host[h]) for (h, _), (n, s) in paths.items()])
    out = []
    for (h, u, e), x in zip(rows, p, strict=True):
        n, s = paths[h, u]
        own = min(max((s - x + k * host[h]) / (n - 1 + k), 1e-6), 1 - 1e-6)
        out.append((host[h], own, 1 / (1 + math.exp(-((e or 0.0) + math.log(own / (1 - own)))))))
    return out


def test_posterior_equals_loops(spark):
    """Null hosts, paths and evidence, a hot path, single documents, and columns with the names of the operator's own."""
    rng = np.random.default_rng(11)
    rows = [(["a", "b", "c", None][i % 4], [None, "x", "y"][i % 3], None if i % 17 == 0 else float(rng.normal(i % 4 - 1, 1))) for i in range(120)]
    rows += [("a", "x", float(rng.normal(2, 1))) for _ in range(200)] + [("z", "only", 1.0)]
    df = spark.createDataFrame([(i, *r, 7, "k", 1.5, -1.0) for i, r in enumerate(rows)], "doc_id long, host string, path string, evidence double, n int, k string, s double, score double")
    out = Q.posterior(df, -0.3)
    assert out.columns == ["doc_id", "host", "path", "evidence", "n", "k", "s", "host_posterior", "path_posterior", "score"]
    want = naive_posterior(rows, -0.3)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose((r.host_posterior, r.path_posterior, r.score), want[r.doc_id], atol=1e-9) and (r.n, r.k, r.s) == (7, "k", 1.5)


def test_quality_of_edges(spark):
    """Repeated ids and labels, null and empty texts, a long text, no labels, no documents."""
    long = "good words here " * 50_000
    docs = spark.createDataFrame([(1, "fine text", "h", "p"), (1, "fine text", "h", "p"), (2, None, None, None), (3, "", "h", "q"), (None, "x", "h", "p"), (4, long, "h", "p")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (4, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    once = Q.fit(docs.dropDuplicates(["doc_id"]), spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int"))
    assert all(np.allclose(model[k], once[k]) for k in model)
    got = Q.score(docs, model).collect()
    assert len(got) == 6 and all(0 < r.score < 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert Q.score(docs, Q.fit(docs, labels.limit(0))).count() == 6 and Q.score(docs.limit(0), model).count() == 0


def test_quality(spark, folder):
    got = Q.op4_quality(spark, folder).collect()
    assert len(got) == 324
    held = [r.keep == (r.doc_id % 3 > 0) for r in got if r.doc_id < 320 and r.held_out]
    assert np.mean(held) > 0.9
    df = spark.createDataFrame([(i, h, p, e) for i, (h, p, e) in enumerate([("a", "x", 5.0)] * 30 + [("a", "y", -5.0)] * 30 + [("b", None, 0.0), (None, "z", 0.0)])], "doc_id int, host string, path string, evidence double")
    post = {r.doc_id: r for r in Q.posterior(df, 0.0).collect()}
    assert len(post) == 62 and post[0].path_posterior > 0.8 > 0.2 > post[59].path_posterior
    assert abs(post[61].path_posterior - post[61].host_posterior) < 0.2  # a sparse path follows its host
    assert Q.posterior(df.limit(0), 0.0).count() == 0


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "mixing":
            assert docs.columns == before.columns
        if name == "line_dedup":
            assert docs.where("text like '%many documents share%'").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    toxic, lines, near, clean, mix = ids
    assert lines == toxic and near < lines and clean <= near and mix == clean
    assert 33 not in clean and not {1000, 1001} & near
    assert {"size", "source_size", "target", "taken"} <= set(docs.columns)
