"""The pipeline's near-duplicate stage against brute force."""

import numpy as np

import corpus_pipeline
from omicspark.llm import shingles as shingles_module
from omicspark.llm.common import forest


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The kept rows: of each component of J >= 0.8 the smallest (doc_id)."""
    own = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if (not own[i] and not own[j]) or 5 * both >= 4 * len(own[i] | own[j]) > 0:
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r), r)
    return sorted(best.values())


def corpus():
    """Copies with a few replaced words, so that similarities lie on both sides of 0.8; chains; a passage that many share."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    out = []
    for _ in range(40):
        base = [word() for _ in range(rng.integers(30, 200))]
        for c in range(4):
            w = list(base)
            for at in rng.choice(len(w), int(len(w) * 0.015 * c) + (c > 0), replace=False):
                w[at] = word()
            out.append(" ".join(w))
    base = [word() for _ in range(60)]
    for _ in range(300):  # one large group of near copies
        w = list(base)
        for at in rng.integers(0, 60, 2):
            w[at] = word()
        out.append(" ".join(w))
    passage = [word() for _ in range(30)]
    out += [" ".join([word() for _ in range(12)] + passage + [word() for _ in range(12)]) for _ in range(300)]
    out += ["a few words", "A few  WORDS", "one", "", "  "]
    return [(i, t) for i, t in enumerate(out)]


def test_near_duplicates_from_four_fifths(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_repeated_ids_are_told_apart_by_text(spark):
    rng = np.random.default_rng(4)
    one, other = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 50)) for _ in range(2))
    docs = spark.createDataFrame([(7, one), (7, other), (7, other), (8, one), (None, one), (9, None), (10, "")], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(7, one), (7, other), (None, one), (9, None)], key=repr)


def near_group(n=2000, length=60, seed=5):
    """n copies of one text with three or four words replaced, most of whose pairs lie below 0.8."""
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(0, 10**6)}" for _ in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(length, 1 + i % 3, replace=False):
            w[at] = f"w{rng.integers(0, 10**6)}"
        out.append((i, " ".join(w)))
    return out


def test_large_group_with_most_pairs_below(spark):
    rows = near_group()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r[0] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    own = [shingles(t) for _, t in rows]
    ids = {}
    for i, s in enumerate(own):
        for x in s:
            ids.setdefault(x, []).append(i)
    shared = np.zeros((len(rows), len(rows)), np.int16)
    for members in ids.values():
        if len(members) > 1:
            shared[np.ix_(members, members)] += 1
    size = np.array([len(s) for s in own])
    links = 5 * shared.astype(np.int64) >= 4 * (size[:, None] + size[None, :] - shared)
    np.fill_diagonal(links, True)
    assert links.sum() - len(rows) < 0.5 * links.size
    root = np.arange(len(rows))
    while True:
        low = np.where(links, root[None, :], len(rows)).min(axis=1)
        if (low == root).all():
            break
        root = low
    assert kept == set(np.unique(root).tolist())


def test_block_links_are_a_forest_of_true_links():
    rows = near_group(300, 40, 7)
    texts = [t.encode() for _, t in rows]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found, at = shingles_module.sets(data, offsets)
    parity, ends = shingles_module._parities(found, at)
    cut = lambda x, to: np.array([x[a:b] for a, b in zip(to[:-1], to[1:], strict=True)] + [None], object)[:-1]
    piece = {"key": np.full(300, -7), "block": np.zeros(300, np.int64), "side": np.zeros(300, np.int64), "diagonal": np.ones(300, bool), "head": np.array([np.zeros(0, np.int64)] * 300 + [None], object)[:-1], "root": np.arange(300), "size": np.diff(at), "bits": cut(parity.view(np.int64), ends), "shingles": cut(found.view(np.int64), at)}
    i, j = shingles_module.block_links(piece)
    assert set(i.tolist()) | set(j.tolist()) <= set(shingles_module.members_of_pairs(piece).tolist())
    own = [shingles(t) for _, t in rows]
    link = lambda a, b: 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])
    assert all(link(a, b) for a, b in zip(i, j, strict=True))
    groups = lambda pairs: len(set(forest(*np.array(pairs, np.int64).reshape(-1, 2).T, 300).tolist()))
    every = [(a, b) for a in range(300) for b in range(a) if link(a, b)]
    assert groups(list(zip(i, j, strict=True))) == groups(every) and len(i) == 300 - groups(every)
