"""Near duplicates by the Jaccard similarity of sets of word shingles, exact: the similarity mode of `simhash`.

A text's fingerprint here is the parity of its shingles in four times as many bits as it has shingles (a power of two; a
longer fingerprint folds to a shorter one by XOR of its halves), because two such fingerprints never differ in more bits than
the sets differ in shingles. Sets with a similarity of at least 4/5 share one of the first fifth (and one) of their shingle
hashes in any order that holds for all texts, so that the pair meets in the bucket of that hash. The order here is from rare
to common, by counts of all texts' shingles in SLOTS, so that unrelated texts meet in few buckets. There it must pass the sizes and the pigeonring of the
fingerprints' segments, then the full Hamming check; only the sets of pairs that pass are fetched and compared.

Buckets are settled in rounds. First every member is checked against its bucket's smallest one; what these links join
needs no further check. Buckets that still hold several components are compared in blocks: the members of pairs that pass the
filters are told first, then their sets are sent there, the pairs are compared exactly where they were found, and a spanning
forest of the true links is all that leaves a block, no more rows than members. A pair that meets in several buckets is
looked at in the first ones only (by the first HEAD hashes of both), so that a set is sent to few of its buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.llm import tokens
from omicspark.llm.buckets import blocked, groups
from omicspark.llm.common import components, dropped, forest, pieces, saved

#: Words of a shingle. Sets link from a Jaccard similarity of 4/5: 9 x common >= 4 x (size + other size).
WORDS = 5
#: Rounds of checks against one member of each bucket, and bits of a bucket's key (buckets of several hashes only have
#: more pairs to check).
ROUNDS, KEY = 2, 40
#: Bits of a fingerprint for each shingle, fewest and most bits, and segments of its ring. With four bits a shingle few
#: shingles of a text meet in one bit, so that hardly a pair below a similarity of 0.79 passes.
BITS, LEAST_BITS, MOST_BITS, SEGMENTS = 4, 256, 16_384, 4
#: Hashes of a set that tell in which bucket a pair is looked at.
HEAD = 8
#: Shingles of a block's members in all, and shingles of pairs that are compared at once.
BLOCK_SHINGLES, AT_ONCE = 1 << 21, 1 << 20
#: Counters of shingles by their hashes, parts in which these are added up, and steps of their order for each doubling.
SLOTS, SLOT_PARTS, STEPS = 1 << 22, 64, 8
#: Texts to fetch that are broadcast as ids at most.
BROADCAST_IDS = 1_000_000


def sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different shingles in order, and their offsets by text. Words are A-Z lower-cased and split
    at ASCII space; a text of fewer words is one shingle, one without words has none."""
    n = len(offsets) - 1
    _, _, text, hashes = tokens.words(tokens.LOWER[data], offsets, tokens.NON_SPACE)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    own, found = [], []
    for k in range(1, words + 1):
        g = tokens.grams(hashes, k)
        at = first[count == k] if k < words else np.flatnonzero(text[: len(g)] == text[k - 1 :])
        own.append(text[at])
        found.append(g[at] + np.uint64(k))
    own, found = np.concatenate(own), np.concatenate(found)
    order = np.lexsort((found, own))
    own, found = own[order], found[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (found[1:] != found[:-1])
    own, found = own[new], found[new]
    return found, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])


def prefix_size(size: np.ndarray) -> np.ndarray:
    """How many of the first hashes of a set (in any order of all hashes) any set with similarity >= 4/5 has one of."""
    return np.where(size > 0, size - (4 * size + 4) // 5 + 1, 0)


def _nodes(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens.mixed(found ^ np.uint64(0xA5A5_5A5A_1234_4321)), dtype=np.uint64)])
    return tokens.mixed(sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def n_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of the fingerprint of a set of that size."""
    bits = BITS * 2.0 ** np.ceil(np.log2(np.maximum(size, 1)))
    return np.clip(bits, LEAST_BITS, MOST_BITS).astype(np.int64) // 64


def _parities(found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all sets' fingerprints, and their offsets by set."""
    words = n_words(np.diff(at))
    to = np.concatenate([[0], np.cumsum(words)])
    own = np.repeat(np.arange(len(words)), np.diff(at))
    bit = to[own] * 64 + (found & (words[own] * 64 - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=to[-1] * 64) & 1).astype(bool), bitorder="little").view(np.uint64), to


def commonness(docs: DataFrame) -> np.ndarray:
    """docs: text. How common shingles are, from 0, by the slot of their hash. Every text is counted; a task counts up to 255
    in a slot. Whatever the numbers are, they put hashes in one order, so that they make pairs meet sooner or later, but lose
    none."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.uint32)
        for _, data, offsets in pieces(rows, "text"):
            _, _, text, hashes = tokens.words(tokens.LOWER[data], offsets, tokens.NON_SPACE)
            g = tokens.grams(hashes, WORDS)
            g = g[text[: len(g)] == text[WORDS - 1 :]] if len(g) else g
            np.add.at(n, ((g + np.uint64(WORDS)) & np.uint64(SLOTS - 1)).astype(np.int64), np.uint32(1))
        if n.any():
            parts = np.minimum(n, 255).astype(np.uint8).reshape(SLOT_PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOT_PARTS)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // SLOT_PARTS, np.int64)
        for x in group.column("n"):
            total += np.frombuffer(x.as_buffer(), np.uint8)
        level = np.minimum(STEPS * np.log2(total + 1.0), 255).astype(np.uint8)
        return pa.table({"part": group.column("part")[:1], "level": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros((SLOT_PARTS, SLOTS // SLOT_PARTS), np.uint8)
    for part, level in docs.select("text").mapInArrow(count, "part bigint, n binary").groupBy("part").applyInArrow(add, "part bigint, level binary").collect():
        out[part] = np.frombuffer(level, np.uint8)
    return out.reshape(-1)


def with_prefixes(docs: DataFrame, level: np.ndarray | None = None) -> DataFrame:
    """docs: doc_id, th, text. Returns doc_id, th, node (a hash of the text's set), size, prefix (as keys), bits. level: of
    commonness(), by which the hashes are put in order; without it they are by size."""

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(rows, "text"):
            found, at = sets(data, offsets)
            size = np.diff(at)
            many = prefix_size(size)
            to = np.concatenate([[0], np.cumsum(many)])
            ordered = found
            if level is not None:
                ordered = found[np.lexsort((found, level[(found & np.uint64(len(level) - 1)).astype(np.int64)], np.repeat(np.arange(len(size)), size)))]
            own = (ordered[np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], many)] & np.uint64((1 << KEY) - 1)).view(np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(own))
            parity, ends = _parities(found, at)
            bits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(parity.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_nodes(found, at)), pa.array(size), prefix, bits], names=["doc_id", "th", "node", "size", "prefix", "bits"])

    return docs.mapInArrow(add, f"doc_id {dict(docs.dtypes)['doc_id']}, th bigint, node bigint, size bigint, prefix array<bigint>, bits array<bigint>")


def with_sets(texts: DataFrame) -> DataFrame:
    """texts: node, text. Returns node, shingles."""

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(rows, "text"):
            found, at = sets(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view(np.int64)))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(add, "node bigint, shingles array<bigint>")


def folded(flat: np.ndarray, start: np.ndarray, words: np.ndarray, to: int) -> np.ndarray:
    """Fingerprints of `words` words from each start, folded to `to` words. All have the same number of words."""
    out = flat[start[:, None] + np.arange(words[0])]
    while out.shape[1] > to:
        out = out[:, : out.shape[1] // 2] ^ out[:, out.shape[1] // 2 :]
    return out


def ring_passes(counts: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """counts: differing bits by pair and segment. Whether some start on the ring has only viable chains: the first l
    segments from it differ in at most l / segments of the budget. Each pair within its budget passes."""
    m = counts.shape[1]
    ring = np.concatenate([counts, counts], axis=1)
    sums = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(ring, axis=1)], axis=1)
    passes = np.zeros(len(counts), bool)
    for start in range(m):
        chain = sums[:, start + 1 : start + m + 1] - sums[:, start : start + 1]
        passes |= (chain * m <= np.arange(1, m + 1) * budget[:, None]).all(axis=1)
    return passes


def distances(size: np.ndarray, start: np.ndarray, flat: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The differing bits of the pairs i, j of sets as a share of their budget, infinite where they don't pass the sizes,
    the ring and the Hamming check. start: of each set's words in flat."""
    ok = 5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])
    at = np.flatnonzero(ok & (size[i] > 0))
    out = np.full(len(i), np.inf)
    words = n_words(size)
    kinds = np.stack([words[i[at]], words[j[at]]], axis=1)
    for one, other in np.unique(kinds, axis=0) if len(at) else ():
        own = at[(kinds[:, 0] == one) & (kinds[:, 1] == other)]
        least, step = min(one, other), max(1, (1 << 18) // int(max(one, other)))
        for k in range(0, len(own), step):
            p = own[k : k + step]
            a, b = (folded(flat, start[x[p]], words[x[p]], least) for x in (i, j))
            counts = np.bitwise_count(a ^ b).reshape(len(p), SEGMENTS, -1).sum(axis=2, dtype=np.int64)
            budget = (size[i[p]] + size[j[p]]) // 9
            p, counts, budget = (x[ring_passes(counts, budget)] for x in (p, counts, budget))
            far = counts.sum(axis=1)
            out[p] = np.where(far <= budget, far / np.maximum(budget, 1), np.inf)
    return out


def shortened(size: np.ndarray, start: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """All sets' fingerprints folded to LEAST_BITS: their distance is never more than that of the longer ones."""
    words, out = n_words(size), np.zeros((len(size), LEAST_BITS // 64), np.uint64)
    for n in np.unique(words):
        own = np.flatnonzero((words == n) & (size > 0))
        out[own] = folded(flat, start[own], words[own], LEAST_BITS // 64) if len(own) else 0
    return out


def may_link(size: np.ndarray, start: np.ndarray, flat: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs i, j of sets pass the filters."""
    return np.isfinite(distances(size, start, flat, i, j))


def lightest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges i - j between 0..n-1 make up a minimum spanning forest. Ties go by i and j."""
    order = np.lexsort((j, i, weight))
    i, j = i[order], j[order]
    root, chosen = np.arange(n), [np.zeros(0, np.int64)]
    live = np.flatnonzero(i != j)
    while len(live):
        best = np.full(n, len(i))
        np.minimum.at(best, root[i[live]], live)
        np.minimum.at(best, root[j[live]], live)
        new = np.unique(best[best < len(i)])
        chosen.append(new)
        root = forest(np.concatenate([i[new], np.arange(n)]), np.concatenate([j[new], root]), n)
        live = live[root[i[live]] != root[j[live]]]
    return order[np.concatenate(chosen)]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words, and where each list starts."""
    n = np.array([len(x) for x in lists], np.int64)
    return (np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)).view(np.uint64), np.cumsum(n) - n


def passing(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs a, b that pass the filters. known: node, size, bits."""
    one, other = (known.select(F.col("node").alias(c), F.col("size").alias(f"n_{c}"), F.col("bits").alias(f"s_{c}")) for c in "ab")
    sized = pairs.join(one.drop("s_a"), "a").join(other.drop("s_b"), "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    both = sized.drop("n_a", "n_b").join(one, "a").join(other, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.num_rows
            size = np.concatenate([batch.column(c).to_numpy() for c in (2, 3)])
            flat, start = _flat([x for c in (4, 5) for x in batch.column(c).to_numpy(zero_copy_only=False)])
            ok = may_link(size, start, flat, np.arange(n), np.arange(n) + n)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in (0, 1)], names=["a", "b"])

    return both.mapInArrow(keep, "a bigint, b bigint")


def checked(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs a, b of sets with similarity >= 4/5. full: node, shingles."""
    one, other = (full.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(other, "b")
    return both.where(9 * F.size(F.array_intersect("s_a", "s_b")) >= 4 * (F.size("s_a").cast("bigint") + F.size("s_b"))).select("a", "b")


def unsettled(rows: DataFrame) -> DataFrame:
    """rows: key, node, root. The rows of buckets with several roots, with the bucket's smallest node as hub."""
    stat = rows.groupBy("key").agg(F.min("node").alias("hub"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return saved(rows.join(stat.select("key", "hub"), "key").select("key", "node", "root", "hub"))


def common(ids: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many ids the sets i and j of each pair share; a set's ids are in order."""
    out, whole = np.zeros(len(i), np.int64), np.concatenate([[0], np.cumsum(size[i] + size[j])])
    low = 0
    while low < len(i):
        high = max(low + 1, int(np.searchsorted(whole, whole[low] + AT_ONCE, "right")) - 1)
        keys = []
        for x in (i[low:high], j[low:high]):
            n = size[x]
            to = np.cumsum(n)
            flat = ids[np.arange(to[-1]) + np.repeat(start[x] - (to - n), n)]
            keys.append(np.repeat(np.arange(high - low), n) << 32 | flat)
        at = np.minimum(np.searchsorted(keys[1], keys[0]), len(keys[1]) - 1)
        out[low:high] = np.bincount(keys[0][keys[1][at] == keys[0]] >> 32, minlength=high - low)
        low = high
    return out


class Block:
    """Members of buckets, or of pairs of their blocks, one after another, and the pairs of them that may link. Rows of a
    block are compared at growing distance, all blocks at once; pairs of one root, of one side off the diagonal, and those
    that a bucket before has are left out."""

    def __init__(self, piece: dict[str, np.ndarray]):
        new = (piece["key"][1:] != piece["key"][:-1]) | (piece["block"][1:] != piece["block"][:-1])
        group = np.concatenate([[0], np.cumsum(new)])
        self.end, self.at = np.searchsorted(group, group, "right"), np.arange(len(group))
        self.flat, self.start = _flat(list(piece["bits"]))
        self.size, self.n = piece["size"], len(piece["size"])
        self.short = shortened(self.size, self.start, self.flat)
        _, root = np.unique(piece["root"], return_inverse=True)
        self.root = root.reshape(-1)
        self.side = np.where(piece["diagonal"].astype(bool), -1 - np.arange(self.n), piece["side"])
        # Unequal fillers, so that only true hashes are the same.
        self.head = np.full((self.n, HEAD), 0, np.int64) - 1 - np.arange(HEAD)
        self.head -= HEAD * np.arange(self.n)[:, None]
        for row, own in enumerate(piece["head"]):
            self.head[row, : len(own)] = own
        here = self.head == piece["key"][:, None]
        self.place = np.where(here.any(axis=1), here.argmax(axis=1), HEAD)

    def met_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = np.arange(HEAD)
        a, b = (np.where(at < self.place[x][:, None], self.head[x], np.int64(-(1 << 62)) - k) for x, k in ((i, 0), (j, 1)))
        return (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))

    def pairs(self, step: int) -> np.ndarray:
        """The rows i that may link with i + step; steps are asked in order."""
        self.at = i = self.at[self.at + step < self.end[self.at]]
        i = i[(self.root[i] != self.root[i + step]) & (self.side[i] != self.side[i + step])]
        for keep in (
            lambda i: np.bitwise_count(self.short[i] ^ self.short[i + step]).sum(axis=1) <= (self.size[i] + self.size[i + step]) // 9,
            lambda i: may_link(self.size, self.start, self.flat, i, i + step),
            lambda i: ~self.met_before(i, i + step),
        ):
            i = i[keep(i)] if len(i) else i
        return i


def members_of_pairs(piece: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows have a pair in their block that may link."""
    block = Block(piece)
    some, step = np.zeros(block.n, bool), 1
    while len(block.at):
        i = block.pairs(step)
        some[i] = some[i + step] = True
        step += 1
    return np.flatnonzero(some)


def block_links(piece: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a spanning forest of the links between rows of one block with different roots: pairs that may link
    are compared by their sets, but for those that are joined by then, in this block or another."""
    block = Block(piece)
    shingles, first = _flat(list(piece["shingles"]))
    _, ids = np.unique(shingles, return_inverse=True)
    before, size = block.root, block.size
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    step = 1
    while len(block.at):
        i = block.pairs(step)
        i = i[9 * common(ids, first, size, i, i + step) >= 4 * (size[i] + size[i + step])] if len(i) else i
        if len(i):
            found.append((i, i + step))
            block.root = forest(block.root[i], block.root[i + step], int(before.max()) + 1)[block.root]
        step += 1
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    own = lightest(before[i], before[j], np.zeros(len(i)), block.n)
    return i[own], j[own]


_OF_BLOCK = ["key", "node", "root", "side", "diagonal", "size", "bits", "head"]


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in groups(batches, ["key", "block"], 1 << 13):
        at = members_of_pairs(piece)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(piece[c][at]) for c in ("key", "block", "node", "root", "side", "diagonal")], names=["key", "block", "node", "root", "side", "diagonal"])


def _linked_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in groups(batches, ["key", "block"], 1 << 13):
        i, j = block_links(piece)
        if len(i):
            a, b = piece["node"][i], piece["node"][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """doc_id, th (xxhash64 of the text), component_id (the smallest doc_id of the texts that links join), first (of the
    rows with that id the one with the smallest th): one row for each row of docs. Also tells whether some (doc_id, th)
    has several rows.

    Equal sets are one node. Null and empty texts have the empty set, which links with itself only. docs must not have
    null ids."""
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), th.alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wide = saved(with_prefixes(rows, commonness(rows)))
    prints = saved(wide.select("doc_id", "th", "node"))
    repeated = bool(prints.groupBy("doc_id", "th").count().where("count > 1").limit(1).count())
    known = saved(wide.groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.first(F.slice("prefix", 1, HEAD)).alias("head")))
    owns = saved(prints.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("own")).select("node", "own.doc_id", "own.th"))
    # Copies have the same prefix: the one of the first row is enough.
    firsts = wide.join(owns.select("doc_id", "th", "node"), ["doc_id", "th", "node"], "left_semi") if not repeated else wide.dropDuplicates(["node"])
    keys = firsts.select(F.explode(F.array_distinct("prefix")).alias("key"), "node")
    several = keys.groupBy("key").count().where("count > 1").select("key")
    shared = saved(keys.join(several, "key", "left_semi").select("key", "node", F.col("node").alias("root")))
    dropped(wide)
    at = unsettled(shared)
    dropped(shared)

    def fetched(nodes: DataFrame) -> DataFrame:
        needed = saved(owns.join(nodes.distinct(), "node", "left_semi"))
        # A list of ids of at most 24 MB is sent to the tasks; a longer one is joined by a shuffle.
        few = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
        texts = rows.join(few, ["doc_id", "th"])
        out = saved(with_sets(texts.dropDuplicates(["node"]) if repeated else texts))
        dropped(needed)
        return out

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs)
        full = fetched(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        out = saved(checked(pairs, full))
        dropped(full)
        dropped(pairs)
        return out

    def hub_pairs(at: DataFrame) -> DataFrame:
        return passing(at.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), known)

    def linked_in_blocks(at: DataFrame) -> DataFrame:
        def dealt(rows: DataFrame, more: list[str]) -> DataFrame:
            rows = rows.join(known, "node").select("block", *_OF_BLOCK, *more)
            return rows.repartition("key", "block").sortWithinPartitions("key", "block")

        sized = at.select("key", "node", "root").join(known.select("node", "size"), "node")
        met = dealt(blocked(sized, ["root"], "size", BLOCK_SHINGLES), [])
        block = dict(met.dtypes)["block"], dict(met.dtypes)["side"]
        told = saved(met.mapInArrow(_told, f"key bigint, block {block[0]}, node bigint, root bigint, side {block[1]}, diagonal boolean"))
        full = fetched(told.select("node"))
        out = saved(dealt(told.join(full, "node"), ["shingles"]).mapInArrow(_linked_in_blocks, "a bigint, b bigint").distinct())
        dropped(full)
        dropped(told)
        return out

    links, roots = None, None
    for find in [lambda at: linked(hub_pairs(at))] * ROUNDS + [linked_in_blocks]:
        found = find(at)
        links = found if links is None else links.union(found)
        roots = saved(components(links))
        if find is linked_in_blocks:
            break
        left = at.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        before, at = at, unsettled(left)
        dropped(before)
        if at.isEmpty():
            break
    dropped(at)
    named = saved(prints.join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root")))
    own = named.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("own"))
    out = named.join(own, "root").select("doc_id", "th", F.col("own.doc_id").alias("component_id"), (F.struct("doc_id", "th") == F.col("own")).alias("first"))
    return saved(out), repeated
