"""Neighbour graphs, catalogue search, drift and readers by splits against plain loops."""

import numpy as np
import pytest

from omicspark.operators import literature, neighbours
from omicspark.sources import readers
from tests.conftest import rows


def brute_neighbours(x, k, cosine):
    if cosine:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T if cosine else -((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = np.round(near, 9)
    np.fill_diagonal(near, -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")[:, :k]
    return {(i, int(j)): r + 1 for i, own in enumerate(order) for r, j in enumerate(own)}


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("part", [4096, 20])
def test_all_cells_are_exact(spark, monkeypatch, cosine, part):
    monkeypatch.setattr(neighbours, "PART", part)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((150, 6)), np.repeat(rng.standard_normal((1, 6)), 60, axis=0)])  # a group of copies
    df = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], (999, None)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r["vec_id"], r["neighbour"]): r["rank"] for r in neighbours.neighbour_graph(df, 4, recall=None, cosine=cosine).collect()}
    assert got == brute_neighbours(x, 4, cosine)


def test_probed_cells_find_nine_of_ten(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16)) * 2
    x = centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["neighbour"]) for r in neighbours.neighbour_graph(df, 5).where("vec_id % 50 = 0").collect()}
    expected = {p for p in brute_neighbours(x, 5, True) if p[0] % 50 == 0}
    assert len(got & expected) >= 0.9 * len(expected)
    assert neighbours.neighbour_graph(df.limit(0), 3).count() == 0


def test_recall_on_the_given_vectors(spark):
    """num6_graph: ids divisible by 50 against brute force"""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    got = {(r["vec_id"], r["neighbour"]) for r in neighbours.neighbour_graph(v, 5).where("vec_id % 50 = 0").collect()}
    expected = {(r["vec_id"], r["neighbour"]) for r in literature.nearest(v.where("vec_id % 50 = 0"), v, 5).collect()}
    assert len(got & expected) >= 0.9 * len(expected) > 0


def test_catalogue_points(spark):
    entries = [("limma", "limma Linear models for microarray and RNA-seq data"), ("DESeq2", "DESeq2 differential expression of RNA-seq counts"), ("a", "a r x"), ("rna", None), (None, "rna"), ("seqlogo", "seqlogo Sequence logos")]
    queries = [("1", "RNA-seq"), ("2", "linear   MODELS for"), ("3", "r"), ("4", "the best tools for data"), ("5", "limma"), ("6", "differential microarray seq expression logos"), ("7", ""), ("8", None), ("9", "odels f")]

    def norm(x):
        import re

        return re.sub(r"[^a-z0-9.+_-]+", " ", (x or "").lower()).strip()

    expected = []
    for q, text in queries:
        n = norm(text)
        words = {w for w in n.split() if len(w) >= 3 and w not in literature.GENERIC}
        own = []
        for name, t in entries:
            if name and n:
                hits = sum(w in norm(t) for w in words)
                score = 35 * (norm(name) == n) + 18 * (n in norm(t)) + min(7 * hits, 21)
                if score:
                    own.append((-score, name, hits))
        expected += [(q, name, -s, h, r + 1) for r, (s, name, h) in enumerate(sorted(own)[:3])]
    got = literature.catalogue_search(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(entries, "name string, text string"), 3)
    assert rows(got.select("query_id", "name", "score", "n_words", "rank")) == sorted(expected, key=repr)


def test_group_contrast(spark):
    a, b = [1.0, 2.0, 4.0], [3.0, 5.0, 9.0, 9.0]
    r = literature.group_contrast(spark.createDataFrame([(x, 1) for x in b] + [(x, 0) for x in a] + [(None, 0)], "value double, grp int")).first()
    va, vb = np.var(a, ddof=1), np.var(b, ddof=1)
    assert r["t"] == pytest.approx((np.mean(b) - np.mean(a)) / np.sqrt(va / 3 + vb / 4))
    assert r["d"] == pytest.approx((np.mean(b) - np.mean(a)) / np.sqrt((2 * va + 3 * vb) / 5)) and 0 < r["p"] < 1
    assert literature.group_contrast(spark.createDataFrame([(1.0, 1)], "value double, grp int")).first()["t"] is None


def test_eigenstrat_by_splits(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    n, m = 11, 400
    d = rng.integers(0, 4, (m, n))
    people = [f"i{k} M P{k % 3}" if k % 5 else f"i{k} M" for k in range(n)]
    (tmp_path / "a.ind").write_text("# people\n" + "\n".join(people) + "\n")
    (tmp_path / "a.snp").write_text("".join(f"rs{i} {i % 22 + 1} 0.0 {i * 10} A G\n" for i in range(m)))
    (tmp_path / "a.geno").write_text("".join("".join("0129"[x] for x in row) + "\n" for row in d))
    bits = np.zeros((m, 12), np.uint8)
    bits[:, :n] = d
    packed = (bits[:, 0::4] | bits[:, 1::4] << 2 | bits[:, 2::4] << 4 | bits[:, 3::4] << 6).astype(np.uint8)
    (tmp_path / "b.geno").write_bytes(b"GENO" + packed.tobytes())
    expected = sorted(((f"i{k}", f"P{k % 3}" if k % 5 else "Unknown", f"rs{i}", str(i % 22 + 1), i * 10, None if d[i, k] == 3 else int(d[i, k])) for i in range(m) for k in range(n)), key=repr)
    monkeypatch.setattr(readers, "PACKED_BYTES", 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "a.geno")).rdd.getNumPartitions() > 2
        ind, snp = str(tmp_path / "a.ind"), str(tmp_path / "a.snp")
        assert rows(readers.read_eigenstrat(spark, ind, snp, str(tmp_path / "a.geno"))) == expected
        assert rows(readers.read_eigenstrat(spark, ind, snp, str(tmp_path / "b.geno"), packed=True)) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
