"""Collocations of two to four words, counted by Rabin-Karp fingerprints.

Texts are normalised into blobs of one language, in which words are a byte apart, so that prefix polynomials over a
blob's bytes give the fingerprint of every run of words. A shuffle by slices of the fingerprints adds up their counts;
each count comes with a pointer to the unit of a few blobs that has the occurrences, by which the frequent fingerprints go
back to its blobs. There the next longer runs are looked up (all of whose pairs of words must be frequent), and last, the runs
themselves are read from the text: equal fingerprints of different texts are told apart there, and only frequent phrases
ever become strings.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from omicspark.llm import tokens
from omicspark.llm.common import dropped, pieces, saved, saved_sorted

#: Bytes of a blob (or one longer line), blobs of a unit, and bytes of text whose fingerprints one slice takes.
BLOB, UNIT, SLICE = 1 << 20, 8, 8 << 20
#: Bytes of a fingerprint: 2 ** 40 of them leave few collisions, which are told apart by the text in any case.
PRINT = 5
#: What stands between words and between pieces of a text, after normalising.
SPACE, BREAK = 32, 10
_MAP = tokens.LOWER.copy()
_MAP[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
_MAP[9] = SPACE
_MEANS = "lang string, unit bigint, n_words bigint, blob binary"


def normalised(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The texts that end at `ends` with A-Z lower-cased, one SPACE between words and one BREAK between pieces; none first."""
    data = np.insert(_MAP[data], ends, BREAK)
    gap = (data == SPACE) | (data == BREAK)
    first = gap.copy()
    first[1:] &= ~gap[:-1]
    run = np.cumsum(first) - 1
    broken = np.zeros(max(1, int(first.sum())), bool)
    broken[run[data == BREAK]] = True
    out = data[first | ~gap]
    out[(out == SPACE) | (out == BREAK)] = np.where(broken, BREAK, SPACE)[: int(first.sum())]
    return out[1:] if len(out) and out[0] in (SPACE, BREAK) else out


def blobs(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, unit (a number), n_words, blob: the normalised texts of each task by language, cut between pieces of texts and
    compressed. UNIT blobs that follow each other are a unit."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)
        piece = TaskContext.get().partitionId() << 32

        def flushed(langs: list[str], least: int) -> Iterator[pa.RecordBatch]:
            nonlocal piece
            for lang in langs:
                blob = np.concatenate(held[lang])
                ends = np.append(np.flatnonzero(blob == BREAK) + 1, len(blob))
                at = 0
                while len(blob) - at >= max(least, 1):
                    to = int(ends[max(np.searchsorted(ends, at + 1), np.searchsorted(ends, at + BLOB, "right") - 1)])
                    part = blob[at:to]
                    n = int(np.count_nonzero((part == SPACE) | (part == BREAK)))
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "unit": [piece // UNIT], "n_words": [n], "blob": [_compressed(part.tobytes())]})
                    piece, at = piece + 1, to
                held[lang], size[lang] = [blob[at:]], len(blob) - at

        for batch, data, offsets in pieces(batches, "text"):
            langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
            for lang in set(langs):
                rows = np.flatnonzero(langs == lang)
                own = [data[offsets[i] : offsets[i + 1]] for i in rows]
                text = normalised(np.concatenate(own), np.cumsum([len(x) for x in own]))
                held[lang].append(text)
                size[lang] += len(text)
            yield from flushed([x for x in size if size[x] >= BLOB], BLOB)
            if sum(size.values()) > 8 * BLOB:
                yield from flushed(list(size), 1)
        yield from flushed(list(size), 1)

    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(gather, _MEANS)


class Runs:
    """The words of a blob, and the fingerprints of its runs of words."""

    def __init__(self, blob: bytes, lang: str):
        self.data = np.frombuffer(blob, np.uint8)
        gap = (self.data == SPACE) | (self.data == BREAK)
        self.end = np.flatnonzero(gap)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        self.last = self.data[self.end] == BREAK
        self.lang = np.uint64(xxhash.xxh64_intdigest(lang.encode()))

    def inside(self, k: int) -> np.ndarray:
        """Where runs of k words within a piece of a text begin."""
        n = len(self.start) - k + 1
        ok = np.ones(max(n, 0), bool)
        for j in range(k - 1):
            ok &= ~self.last[j : j + len(ok)]
        return np.flatnonzero(ok)

    def fingerprints(self, at: np.ndarray, k: int) -> np.ndarray:
        return tokens.mixed(tokens.span_hashes(self.data, self.start[at], self.end[at + k - 1]) ^ self.lang) & np.uint64((1 << 8 * PRINT) - 1)

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        start, size = self.start[at], self.end[at + k - 1] - self.start[at]
        to = np.concatenate([[0], np.cumsum(size)])
        flat = self.data[np.arange(to[-1]) + np.repeat(start - to[:-1], size)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(to), pa.py_buffer(flat)])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def frequent_runs(own: Runs, known: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """By length, where runs begin that can be frequent: of one and two words those with a known fingerprint, of more
    words those all of whose pairs of neighbours are."""
    out = {k: (at := own.inside(k))[_among(own.fingerprints(at, k), known)] for k in (1, 2) if k <= most}
    pair = np.zeros(len(own.start) + most, bool)
    pair[out.get(2, np.zeros(0, np.int64))] = True
    for k in range(3, most + 1):
        at = own.inside(k)
        out[k] = at[np.logical_and.reduce([pair[at + j] for j in range(k - 1)])]
    return out


def _packed(prints: np.ndarray) -> bytes:
    return np.ascontiguousarray(prints, "<u8").view(np.uint8).reshape(-1, 8)[:, :PRINT].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // PRINT, 8), np.uint8)
    out[:, :PRINT] = np.frombuffer(data, np.uint8).reshape(-1, PRINT)
    return out.view("<u8").ravel()


def _counts(n: np.ndarray) -> bytes:
    """A byte a count, or four where one needs more."""
    return n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32).tobytes()


def _compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expanded(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _shrunk(prints: np.ndarray) -> bytes:
    """Sorted fingerprints as their differences: first the lowest bytes of all, last the highest ones, which are mostly 0."""
    packed = np.frombuffer(_packed(np.diff(prints, prepend=np.uint64(0))), np.uint8)
    return _compressed(packed.reshape(-1, PRINT).T.tobytes())


def _grown(data: bytes) -> np.ndarray:
    packed = np.frombuffer(_expanded(data), np.uint8)
    return np.cumsum(_unpacked(packed.reshape(PRINT, -1).T.tobytes()), dtype=np.uint64)


def _summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different fingerprints, sorted, and the sums of their counts."""
    order = np.argsort(prints, kind="stable")
    own = prints[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return own[first], np.add.reduceat(counts[order], first) if len(own) else counts


def _dealt(own: np.ndarray, n: np.ndarray, unit: int, slices: int) -> pa.RecordBatch:
    """A unit's fingerprints (different and sorted) with their counts, by slices: ranges of fingerprints."""
    part = (own * np.uint64(slices) >> np.uint64(8 * PRINT)).astype(np.int64)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    to = np.append(first, len(part))[1:]
    coded = [pa.array([f(x[a:b]) for a, b in zip(first, to, strict=True)], pa.binary()) for x, f in ((own, _shrunk), (n, lambda x: _compressed(_counts(x))))]
    return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), pa.array(np.full(len(first), unit)), *coded], names=["slice", "unit", "prints", "counts"])


_DEALT = "slice bigint, unit bigint, prints binary, counts binary"


def _units(blobs: Iterator[tuple[int, np.ndarray]], slices: int) -> Iterator[pa.RecordBatch]:
    """_dealt() of each unit. blobs: unit and fingerprints of blob by blob; a unit in two parts is dealt twice, which does no
    harm."""
    unit, held = None, []
    for u, found in chain(blobs, [(None, np.zeros(0, np.uint64))]):
        if u != unit and held:
            yield _dealt(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))), unit, slices)
            held = []
        unit = u
        held.append(np.unique(found, return_counts=True))


def frequent(dealt: DataFrame, least: int) -> DataFrame:
    """unit, prints: the fingerprints of at least `least` occurrences in all, with each unit that has some; one row a slice."""

    def add(slice_: pa.Table) -> pa.Table:
        lists = [_grown(x.as_py()) for x in slice_.column("prints")]
        prints = np.concatenate(lists)
        coded = [_expanded(x.as_py()) for x in slice_.column("counts")]
        counts = np.concatenate([np.frombuffer(x, np.uint8 if len(x) == len(own) else np.uint32).astype(np.int64) for x, own in zip(coded, lists, strict=True)])
        own, n = _summed(prints, counts)
        keep = _among(prints, own[n >= least])
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[keep]
        prints = prints[keep]
        has, begin = np.unique(row, return_index=True)
        to = np.append(begin, len(row))[1:]
        return pa.table({"unit": slice_.column("unit").take(pa.array(has)), "prints": pa.array([_shrunk(prints[a:b]) for a, b in zip(begin, to, strict=True)], pa.binary())})

    return dealt.groupBy("slice").applyInArrow(add, "unit bigint, prints binary")


def _known(lists: pa.Scalar) -> np.ndarray:
    own = [_grown(x) for x in lists.as_py()]
    return np.sort(np.concatenate(own)) if own else np.zeros(0, np.uint64)


def phrase_counts(docs: DataFrame, least: int = 30, most: int = 4, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, k, phrase, f of the phrases of one to `most` words (space-joined) that occur `least` times or more, and lang, n
    (all words). Both are saved tables."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets, slices = max(buckets, math.ceil(total / (256 * BLOB))), max(8, math.ceil(total / SLICE))
    cut = saved_sorted(blobs(docs, text_col, lang_col).repartition(buckets, "unit"), ["unit"], buckets, [])

    def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[pa.Scalar]]:
        for batch in batches:
            yield from zip(*[batch.column(c) for c in columns], strict=True)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, np.ndarray]]:
            for unit, lang, blob in rows(batches, "unit", "lang", "blob"):
                own = Runs(_expanded(blob.as_py()), lang.as_py())
                yield unit.as_py(), np.concatenate([own.fingerprints(own.inside(k), k) for k in (1, 2) if k <= most])

        return _units(found(), slices)

    def known_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, Runs, np.ndarray]]:
        unit, prints = None, None
        for u, lang, blob, known in rows(batches, "unit", "lang", "blob", "known"):
            if u.as_py() != unit:
                unit, prints = u.as_py(), _known(known)
            yield unit, lang.as_py(), Runs(_expanded(blob.as_py()), lang.as_py()), prints

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, np.ndarray]]:
            for unit, _, own, prints in known_runs(batches):
                runs = frequent_runs(own, prints, most)
                yield unit, np.concatenate([np.zeros(0, np.uint64), *[own.fingerprints(runs[k], k) for k in range(3, most + 1)]])

        return _units(found(), slices)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lang, own, prints in known_runs(batches):
            for k, at in frequent_runs(own, prints, most).items():
                at = at[_among(own.fingerprints(at, k), prints)] if k > 2 else at
                found = own.texts(at, k).value_counts()
                phrase = found.field(0).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), k, np.int32)), phrase, found.field(1)], names=["lang", "k", "phrase", "n"])

    def asked(rows: DataFrame) -> DataFrame:
        return cut.join(rows.groupBy("unit").agg(F.collect_list("prints").alias("known")).hint("merge"), "unit").select("unit", "lang", "blob", "known")

    own = saved(frequent(cut.select("unit", "lang", "blob").mapInArrow(short, _DEALT), least))
    if most > 2:
        longest = saved(frequent(asked(own).mapInArrow(longer, _DEALT), least))
        both = own.union(longest)
    else:
        longest, both = None, own
    counted = asked(both).mapInArrow(read, "lang string, k int, phrase string, n bigint")
    found = saved(counted.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    words = saved(cut.groupBy("lang").agg(F.sum("n_words").alias("n")))
    for x in (cut, own, longest):
        dropped(x)
    return found, words


def collocations(docs: DataFrame, least: int = 30, most: int = 4, top: int = 2000, within: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's `top` phrases of two to `most` words by score: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are cut at [.,;:!?] and line ends, then into words at spaces and tabs; A-Z is lower-cased. a is the phrase's
    number of occurrences (at least `least`); it is cut in two parts of frequencies l and r where floor(2000000 a / (l +
    r)) is lowest, which is the score. Phrases inside a longer one that has `within` percent of their occurrences or more
    go. Equal scores go by a, then by the phrase's bytes. n counts the language's words.

    A null text is empty, a null language is 'und' (as are documents that say so). Each row is a document, repeated rows
    too. Other columns are left out, whatever their names; empty tables give no rows."""
    found, words = phrase_counts(docs, least, most, text_col, lang_col)
    parts = F.split("phrase", " ")
    cuts = found.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("*", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice(parts, F.col("cut") + 1, F.col("k")), " ").alias("right"))
    one, other = (found.select("lang", F.col("phrase").alias(c), F.col("f").alias(c[0])) for c in ("left", "right"))
    scored = cuts.join(one, ["lang", "left"]).join(other, ["lang", "right"])
    score = F.expr("(cast(a as decimal(19, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"), F.first("a").alias("a"))
    spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    inner = found.where("k > 2").select("lang", F.col("f").alias("longer"), F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * cast(longer as decimal(19, 0)) < {within} * cast(a as decimal(19, 0))")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, ws, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM c JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : cut], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1 : c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, max(f) AS longer, phrase FROM (SELECT lang, f, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM f, range(2, 4) AS ms(m), range(1, 4) AS st(i) WHERE m < k AND i + m - 1 <= k) GROUP BY lang, phrase),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT o.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
