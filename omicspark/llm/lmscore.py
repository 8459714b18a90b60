"""Cross-entropy difference of documents under two n-gram models with one vocabulary.

The target model is counted over the target documents and the background model over all documents, scaled to the
target's tokens. Both are bigram models interpolated with unigrams over the same vocabulary: the words that occur at
least twice, the WORDS most frequent of them at most (equally frequent ones by hash); every other word is the one unknown
word. A document's own counts are left out of both models when it is scored.

Counts of bigrams are exact, however many there are. Frequent bigrams (HEAD at most, so that none of the others is hot)
are counted first and sent to the tasks. For the others, each task packs its documents' bigrams by slices of the
bigrams; a slice counts its own and returns each document's correction to the loss without them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from omicspark.llm import tokens
from omicspark.llm.common import dropped, pieces, saved

#: Words of the vocabulary and frequent bigrams at most, and the times that a bigram must occur in about two megabytes of
#: text to be taken for frequent.
WORDS, HEAD, OFTEN = 1 << 18, 1 << 17, 4
#: Tokens of all documents for each slice of the bigrams.
SLICE_TOKENS = 2_000_000
#: Weight of the bigram estimate against the unigram one, and counts added to each word.
MIXED, ADDED = 0.6, 0.5
#: Target ids that are broadcast at most (16 MB); longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: What a document begins with, as a word's hash.
BEGIN = np.uint64(0x5D0C_B361_9A7E_24F5)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its text, its word's hash, and the hash before it."""
    _, _, text, word = tokens.words(tokens.LOWER[data], offsets, tokens.NON_SPACE)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[_starts(text)] = BEGIN
    return text, word, before


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the number of each key, and how often each occurs."""
    return np.unique(key, return_inverse=True, return_counts=True)


def counts(docs: DataFrame) -> DataFrame:
    """docs: text, target. Returns before, word, n, n_target, h, h_target. Rows without before count a word, as such and
    as a history; rows with it are candidates for frequent bigrams. Counted in pieces, then in one shuffle."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(rows, "text"):
            text, word, before = _tokens(data, offsets)
            target = batch.column(batch.schema.get_field_index("target")).to_numpy(zero_copy_only=False).astype(bool)[text]
            one, at, _ = _grouped(np.concatenate([word, before]))
            sums = [np.bincount(x[keep], minlength=len(one)) for x in (at[: len(word)], at[len(word) :]) for keep in (slice(None), target)]
            order = np.lexsort((word, before))
            new = _starts(word[order], before[order])
            n = np.diff(np.append(new, len(word)))
            often = order[new[n >= OFTEN]]
            columns = [np.concatenate([x, np.zeros(len(often), np.int64)]) for x in sums]
            columns[0][len(one) :] = n[n >= OFTEN]
            first = pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(before[often].view(np.int64))])
            yield pa.RecordBatch.from_arrays([first, pa.array(np.concatenate([one, word[often]]).view(np.int64)), *map(pa.array, columns)], names=["before", "word", "n", "n_target", "h", "h_target"])

    sums = [F.sum(c).alias(c) for c in ("n", "n_target", "h", "h_target")]
    return docs.mapInArrow(count, "before bigint, word bigint, n bigint, n_target bigint, h bigint, h_target bigint").groupBy("before", "word").agg(*sums)


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The `most` rows (before, word, n, ...) with the largest n, or all; equal n go by a hash of before and word. Rows are
    counted by rungs of n, then in the rung at the edge by n, then at that n by the hash's first bits, so that only the few
    rows of one such group are sorted."""
    hashed = table.withColumn("_h", F.xxhash64(F.coalesce("before", F.lit(0)), "word"))
    steps = [-F.floor(8 * F.log2("n")).cast("bigint"), -F.col("n"), F.shiftrightunsigned("_h", 48)]
    chosen, edge, left = F.lit(False), F.lit(True), most
    for key in steps:
        sizes = sorted(map(tuple, hashed.where(edge).groupBy(key.alias("key")).count().collect()))
        last = None
        for value, n in sizes:
            if n > left:
                chosen, edge = (chosen if last is None else chosen | (edge & (key <= last))), edge & (key == value)
                break
            left, last = left - n, value
        else:
            return hashed.where(chosen | edge).drop("_h")
    few = hashed.where(edge).orderBy("_h", "before", "word").limit(left)
    return hashed.where(chosen).union(few).drop("_h")


class Models:
    """The words' counts in both models and the frequent bigrams. Words are numbers: those of the vocabulary in order of
    their hashes, then the unknown word, then the beginning. A bigram is before * words + word."""

    def __init__(self, table: DataFrame):
        word = table.where("before is null")
        names = ["n", "n_target", "h", "h_target"]
        total = word.agg(*[F.sum(c).alias(c) for c in names], F.sum(F.when(F.col("word") == int(BEGIN.view(np.int64)), F.col("h"))).alias("docs"), F.sum(F.when(F.col("word") == int(BEGIN.view(np.int64)), F.col("h_target"))).alias("docs_target")).first()
        begin = F.col("word") == int(BEGIN.view(np.int64))
        rows = most_frequent(word.where((F.col("n") >= 2) & ~begin), WORDS).toPandas()
        self.hashes = rows["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(self.hashes)
        self.hashes = self.hashes[order]
        self.size = len(order) + 2
        self.unknown, self.begin = len(order), len(order) + 1
        # By model (background, target) and word.
        self.word, self.history = (np.zeros((2, self.size)) for _ in range(2))
        for m in (0, 1):
            for table_, name in ((self.word, names[m]), (self.history, names[2 + m])):
                table_[m, : self.unknown] = rows[name].to_numpy(np.float64)[order]
            docs = total["docs_target" if m else "docs"] or 0
            self.history[m, self.begin] = docs
            self.word[m, self.unknown] = (total[names[m]] or 0) - self.word[m].sum()
            self.history[m, self.unknown] = (total[names[2 + m]] or 0) - self.history[m].sum()
        self.total = self.word.sum(axis=1)
        self.scale = np.array([self.total[1] / self.total[0] if self.total[1] else 1.0, 1.0])
        pairs = most_frequent(table.where("before is not null"), HEAD).select("before", "word").toPandas()
        number = self.numbers
        some = number(rows.nlargest(min(len(rows), HEAD // 8), "n")["word"].to_numpy(np.int64).view(np.uint64))
        rest = np.full(len(some), self.unknown)
        self.head = np.unique(np.concatenate([
            self.pair(number(pairs["before"].to_numpy(np.int64).view(np.uint64)), number(pairs["word"].to_numpy(np.int64).view(np.uint64))),
            self.pair(some, rest), self.pair(rest, some), self.pair(np.full(len(some), self.begin), some), self.pair(np.array([self.unknown, self.begin]), np.array([self.unknown] * 2)),
        ]))
        self.pairs = np.zeros((2, len(self.head)))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers; BEGIN is no word of a text."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        return np.where(known, at, np.where(hashes == BEGIN, self.begin, self.unknown))

    def pair(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        return before.astype(np.int64) * self.size + word

    def in_head(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs are in the head, and whether they are."""
        at = np.minimum(np.searchsorted(self.head, pair), len(self.head) - 1)
        return at, self.head[at] == pair

    def unigram(self, m: int, word: np.ndarray, own: np.ndarray) -> np.ndarray:
        return (self.scale[m] * np.maximum(self.word[m][word] - own, 0) + ADDED) / (self.scale[m] * self.total[m] + ADDED * (self.size - 1))

    def ratio(self, m: int, pair: np.ndarray, count: np.ndarray, own_before: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """The weighted bigram estimate over the weighted unigram one. count: of the bigram, in other documents."""
        history = self.scale[m] * np.maximum(self.history[m][pair // self.size] - own_before, 0) + ADDED
        return MIXED * self.scale[m] * count / history / ((1 - MIXED) * unigram)


def _head_counts(docs: DataFrame, sent, size: int) -> DataFrame:
    """at, n, n_target: exact counts of the frequent bigrams."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, total = sent.value, np.zeros((2, size), np.int64)
        for batch, data, offsets in pieces(rows, "text"):
            text, word, before = _tokens(data, offsets)
            at, inside = models.in_head(models.pair(models.numbers(before), models.numbers(word)))
            target = batch.column(batch.schema.get_field_index("target")).to_numpy(zero_copy_only=False).astype(bool)[text]
            total[0] += np.bincount(at[inside], minlength=size)
            total[1] += np.bincount(at[inside & target], minlength=size)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["at", "n", "n_target"])

    return docs.mapInArrow(count, "at bigint, n bigint, n_target bigint").groupBy("at").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


_PACKED = "slice int, piece bigint, ids array<{}>, doc array<int>, pair array<bigint>, own array<int>, own_word array<int>, own_before array<int>, tokens array<bigint>, background array<double>, target array<double>"
_PARTS = "piece bigint, ids array<{}>, doc array<int>, tokens array<bigint>, background array<double>, target array<double>"
_SCORES = "doc_id {}, n_tokens bigint, xent_background double, xent_target double"


def _packed(docs: DataFrame, sent, slices: int) -> DataFrame:
    """For each piece of texts: a row with its documents' sums of losses without the rarer bigrams (slice < 0, ids), and
    rows with the rarer bigrams by slice. doc is twice the number in the piece, and one more for a target document."""
    packed = _PACKED.format(dict(docs.dtypes)["doc_id"])
    schema = to_arrow_schema(T._parse_datatype_string(packed))

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part = sent.value, TaskContext.get().partitionId()
        for number, (batch, data, offsets) in enumerate(pieces(rows, "text")):
            n = batch.num_rows
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            target = batch.column(batch.schema.get_field_index("target")).to_numpy(zero_copy_only=False).astype(bool)
            piece = (part << 32) + number  # the same if the task is run again, as it reads the same rows in one order
            text, word, before = _tokens(data, offsets)
            word, before = m.numbers(word), m.numbers(before)
            _, at, many = _grouped(text * m.size + word)
            own_word = many[at]
            _, at, many = _grouped(text * m.size + before)
            own_before = many[at]
            pair = m.pair(before, word)
            order = np.lexsort((pair, text))
            new = _starts(pair[order], text[order])
            own = np.diff(np.append(new, len(pair)))
            first = order[new]  # a token for each different bigram of a document
            text, pair, word, own_word, own_before = text[first], pair[first], word[first], own_word[first], own_before[first]
            at, inside = m.in_head(pair)
            sums = []
            for k in (0, 1):
                left = np.where(target[text], 1, 0) if k else 1
                unigram = m.unigram(k, word, own_word * left)
                count = np.where(inside, m.pairs[k][at] - own * left, 0)
                loss = -np.log((1 - MIXED) * unigram) - np.log1p(m.ratio(k, pair, np.maximum(count, 0), own_before * left, unigram))
                sums.append(np.bincount(text, weights=own * loss, minlength=n))
            length = np.bincount(text, weights=own, minlength=n).astype(np.int64)
            doc = 2 * np.arange(n) + target
            none: list = []
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip([[-1 - piece % slices], [piece], [ids.to_pylist()], [doc], [none], [none], [none], [none], [length], [sums[0]], [sums[1]]], schema, strict=True)], schema=schema)
            rest = np.flatnonzero(~inside)
            where = (tokens.mixed(pair[rest].astype(np.uint64)) % np.uint64(slices)).astype(np.int32)
            rest = rest[np.argsort(where, kind="stable")]
            to = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=slices))])
            some = np.flatnonzero(np.diff(to))
            ends = pa.array(np.append(to[some], to[-1]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[rest].astype(d))) for x, d in ((doc[text], np.int32), (pair, np.int64), (own, np.int32), (own_word, np.int32), (own_before, np.int32))]
            empty = [pa.array([none] * len(some), schema.field(c).type) for c in ("tokens", "background", "target")]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), piece)), pa.array([none] * len(some), schema.field("ids").type), *lists, *empty], schema=schema)

    return docs.mapInArrow(pack, packed)


def _corrected(sent, kind: pa.DataType):
    names = ["piece", "ids", "doc", "tokens", "background", "target"]
    kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def correct(table: pa.Table) -> pa.Table:
        """Of a slice: the pieces' sums without its bigrams as they are, or for each piece the documents with some of its
        bigrams that other documents have as well, and the corrections to their losses."""
        if table.column("slice")[0].as_py() < 0:
            return pa.Table.from_arrays([table.column(c).cast(t) for c, t in zip(names, kinds, strict=True)], names=names)
        lists = table.column("doc").combine_chunks()
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        piece, doc = np.repeat(table.column("piece").to_numpy(), np.diff(lists.offsets.to_numpy())), flat("doc")
        m, own, mine = sent.value, flat("own").astype(np.int64), doc % 2 == 1
        _, pair_at, _ = _grouped(flat("pair"))
        totals = [np.bincount(pair_at, weights=x) for x in (own, own * mine)]
        some = np.flatnonzero(totals[0][pair_at] > own)
        pair, own, mine, piece, doc = flat("pair")[some], own[some], mine[some], piece[some], doc[some]
        own_word, own_before = flat("own_word")[some], flat("own_before")[some]
        fixes = []
        for k in (0, 1):
            left = mine.astype(np.int64) if k else 1
            unigram = m.unigram(k, pair % m.size, own_word * left)
            fixes.append(-own * np.log1p(m.ratio(k, pair, np.maximum(totals[k][pair_at[some]] - own * left, 0), own_before * left, unigram)))
        order = np.lexsort((doc, piece))
        piece, doc = piece[order], doc[order]
        new = _starts(piece, doc)
        sums = [np.add.reduceat(x[order], new) if len(new) else x[:0] for x in fixes]
        first = _starts(piece[new])
        ends = pa.array(np.append(first, len(new)).astype(np.int32))
        none = pa.array(np.zeros(len(first) + 1, np.int32))
        arrays = [pa.array(piece[new][first]), pa.ListArray.from_arrays(none, pa.nulls(0, kind)), pa.ListArray.from_arrays(ends, pa.array(doc[new].astype(np.int32))), pa.ListArray.from_arrays(none, pa.nulls(0, pa.int64())), *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in sums]]
        return pa.Table.from_arrays([x.cast(t) for x, t in zip(arrays, kinds, strict=True)], names=names)

    return correct


def _scored(table: pa.Table) -> pa.Table:
    """Of a piece: its documents' scores from their sums and all corrections."""
    flat = lambda t, c: t.column(c).combine_chunks().flatten()
    base = table.filter(pc.greater(pc.list_value_length(table.column("ids")), 0))
    ids, tokens, at = flat(base, "ids"), flat(base, "tokens").to_numpy(), flat(base, "doc").to_numpy() // 2
    n = len(at)
    sums = [np.bincount(flat(table, "doc").to_numpy() // 2, weights=flat(table, c).to_numpy(), minlength=n) / np.maximum(tokens, 1) for c in ("background", "target")]
    return pa.Table.from_arrays([ids, pa.array(tokens), *map(pa.array, sums)], names=["doc_id", "n_tokens", "xent_background", "xent_target"])


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, xent_background, xent_target (means over tokens, in nats) and xent_diff (target less background:
    lower is closer to the target), one row per row of docs. target_ids: doc_id of the target documents (nulls and
    repeats don't matter); without any, the target model is that of no counts.

    Null and empty texts have no tokens, and 0 in all columns. Rows that repeat an id or a text are documents of their
    own, each of which the others' models count. Columns beyond the two aren't read. docs is read several times and must
    give its rows in one order (a table, not what comes of a shuffle)."""
    spark = docs.sparkSession
    marks = target_ids.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_target", F.lit(True))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    few = marks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = slim.join(F.broadcast(marks) if few else marks, slim["doc_id"] == marks["_id"], "left").select("doc_id", "text", F.coalesce("_target", F.lit(False)).alias("target"))
    if not few:  # joined once, and in one order for all that follows
        marked = saved(marked)
    table = saved(counts(marked))
    models = Models(table)
    dropped(table)
    for r in _head_counts(marked, spark.sparkContext.broadcast(models), len(models.head)).collect():  # HEAD rows at most
        models.pairs[:, r["at"]] = r["n"], r["n_target"]
    sent = spark.sparkContext.broadcast(models)
    slices = max(1, math.ceil(models.total[0] / SLICE_TOKENS))
    kind = dict(slim.dtypes)["doc_id"]
    arrow = to_arrow_schema(slim.select("doc_id").schema).field(0).type
    parts = _packed(marked, sent, slices).groupBy("slice").applyInArrow(_corrected(sent, arrow), _PARTS.format(kind))
    out = parts.groupBy("piece").applyInArrow(_scored, _SCORES.format(kind))
    return out.withColumn("xent_diff", F.col("xent_target") - F.col("xent_background"))


def op3_lmscore(spark, sf_dir: str) -> DataFrame:
    """The target is the documents labelled to be of good quality and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1 and toxic = 0").select("doc_id"))
