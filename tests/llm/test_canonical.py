"""The bucket in which a pair of codes counts is one where both are, also for pairs near the threshold."""

import numpy as np
import pytest

from omicspark.llm import embeddings as E


def test_both_codes_are_in_their_canonical_bucket():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (5000, 4)).astype(np.int32)
    b = a.copy()
    for _ in range(9):
        b[np.arange(5000), rng.integers(0, 4, 5000)] ^= (1 << rng.integers(0, 16, 5000)).astype(np.int32)
    key = E.canonical(a, b)
    at = np.flatnonzero(key >= 0)
    assert len(at) > 4000
    for code in (a[at], b[at]):
        assert (np.bitwise_count(code[np.arange(len(at)), key[at] & 15] ^ (key[at] >> 4)) <= 1).all()
    assert (E.canonical(b, a) == key).all()


def test_shape_follows_the_number_of_vectors():
    shapes = [E.Shape.of(10**k, 0.95) for k in range(2, 10)]
    assert all(a.width <= b.width and a.segments <= b.segments for a, b in zip(shapes, shapes[1:], strict=False))
    assert all(2**s.width >= 2 * 10**k for k, s in zip(range(2, 9), shapes, strict=False))


@pytest.mark.parametrize("pairs", [400, 4000])
def test_recall_near_the_threshold(spark, pairs):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(pairs, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(axis=1)[:, None] * x
    other /= np.linalg.norm(other, axis=1)[:, None]
    cos = rng.uniform(0.951, 0.97, pairs)[:, None]
    y = cos * x + np.sqrt(1 - cos**2) * other
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = E.near_duplicates(df).where("n_links > 0").count() / 2
    print(f"links found of {pairs}:", got)
    assert got >= 0.97 * pairs
