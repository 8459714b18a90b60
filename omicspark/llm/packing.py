"""Packing documents into sequences of a fixed length, shortest pack first over the histogram of lengths.

Documents become tokens, and tokens become pieces of at most one sequence's length. The plan knows only how many pieces
have each length: lengths are placed longest first, always into the emptiest kind of pack that has room, by updating the
counts of packing patterns. Patterns then meet pieces by rank: the pieces of a length are numbered, and a pattern owns a
range of these numbers. Packs that stay more than `slack` tokens short of full are laid end to end and cut anew at every
full sequence, so that one sequence at most is padded by more.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from omicspark.llm.common import saved

#: Tokens of a sequence, the id that ends a document, and the tokens that a pack may lack without being cut anew.
MOST, END, SLACK = 1024, 0, 8
#: Where a text may be cut before it is encoded: byte-level pre-tokenisers start a new token where white space follows
#: another character. Characters that only some call white space are left alone.
_CUT = re.compile(r"[^ \t\n\r\f\v\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u2060\u3000\ufeff][ \t\n\r\f\v]")
#: Characters whose kinds no version of Unicode disputes, and how long such a text may be for the faster encoder.
_PLAIN, PLAIN_MOST = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f]*"), 1 << 20
#: Characters that are encoded at once.
AT_ONCE = 1 << 16
#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids of a batch of pieces.
BATCH_IDS = 1 << 20


def _merge_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as merge ranks, if it is a byte-level one that cuts words as WORDS says, without
    normaliser, and whose ids are in the order of its merges; else None."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, pre = whole["model"], whole.get("pre_tokenizer") or {}
    if whole.get("normalizer") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in pairs]
    added = {x["content"] for x in whole.get("added_tokens", [])}
    if ids != sorted(ids) or any(model["vocab"][c] >= ids[0] for c in byte):
        return None
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}


class Encoder:
    """Token ids as little-endian unsigned 32-bit numbers, as the library `tokenizers` gives them for a tokenizer file.
    Plain texts of a byte-level vocabulary are encoded by `tiktoken` from the same file, which is three times as fast and
    gives the same ids; added tokens, other characters and other files are left to `tokenizers`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks = _merge_ranks(path)
        self.fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> Iterator[bytes]:
        """The ids of the text, some words at a time."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + AT_ONCE)
            to = cut.start() + 1 if cut else len(text)
            part, at = text[at:to], to
            if self.fast and len(part) <= PLAIN_MOST and _PLAIN.fullmatch(part) and not any(x in part for x in self.added):
                yield np.array(self.fast.encode_ordinary(part), "<u4").tobytes()
            else:
                yield np.array(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, "<u4").tobytes()


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end: int = END) -> DataFrame:
    """id_col, start, length, doc_tokens, ids (binary, 4 bytes each), and the piece's number among those of its length in
    its task: part, no. A document has the ids of its text and `end`; it is cut every `most` ids."""
    id_type = docs.schema[id_col].dataType
    fields = [("_id", id_type), ("start", T.LongType()), ("length", T.IntegerType()), ("doc_tokens", T.LongType()), ("ids", T.BinaryType()), ("part", T.IntegerType()), ("no", T.LongType())]
    schema = T.StructType([T.StructField(*x) for x in fields])
    arrow = to_arrow_schema(schema)
    last = np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(path), TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        rows: list[tuple] = []
        n = 0

        def packed() -> pa.RecordBatch:
            at, start, length, tokens, ids, no = zip(*rows, strict=True)
            own = {"_id": pa.concat_arrays([x.slice(0, 1) for x in at]), "start": start, "length": length, "doc_tokens": tokens, "ids": ids, "part": [part] * len(rows), "no": no}
            return pa.RecordBatch.from_arrays([own[f.name] if isinstance(own[f.name], pa.Array) else pa.array(own[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                cut, held = [], b""
                for more in chain(encoder.ids(text), [last]):
                    held += more
                    whole = len(held) // (4 * most) * 4 * most
                    cut += [held[k : k + 4 * most] for k in range(0, whole, 4 * most)]
                    held = held[whole:]
                cut += [held] if held else []
                total = sum(map(len, cut)) // 4
                for k, ids in enumerate(cut):
                    length = len(ids) // 4
                    rows.append((batch.column(0).slice(i, 1), k * most, length, total, ids, int(seen[length])))
                    seen[length] += 1
                    n += length
                    if n >= BATCH_IDS:
                        yield packed()
                        rows, n = [], 0
        if rows:
            yield packed()

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(encode, schema)


def shortest_pack_first(histogram: dict[int, int], most: int = MOST) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns, each with the number of packs: a pattern lists (length, how many of it). Lengths are placed
    longest first into the emptiest packs with room; new packs take as many of a length as they can hold. The work
    depends on the number of different lengths only."""
    packs: dict[int, list[tuple[tuple, int]]] = {}  # by fill

    def put(pattern: tuple, fill: int, n: int) -> None:
        if n:
            packs.setdefault(fill, []).append((pattern, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fills = sorted(f for f in packs if f + length <= most)
            if not fills:
                each = most // length
                put(((length, each),), each * length, left // each)
                if left % each:
                    put(((length, left % each),), left % each * length, 1)
                break
            fill = fills[0]
            pattern, n = packs[fill].pop()
            emptiest = not packs[fill]
            if emptiest:
                del packs[fill]
            if left < n:
                put(pattern, fill, n - left)
                n, each = left, 1
            else:
                # As many at once as keep these packs the emptiest before each of them.
                until = (min(fills[1] if len(fills) > 1 else most, most) - fill) if emptiest else length
                each = max(1, min((most - fill) // length, left // n, -(-until // length)))
            put((*pattern, (length, each)), fill + each * length, n)
            left -= n * each
    return [x for fill in sorted(packs, reverse=True) for x in packs[fill]]


def placements(patterns: list[tuple[tuple[tuple[int, int], ...], int]], most: int = MOST, slack: int = SLACK) -> list[tuple]:
    """length, low, high, packs, first, offset, fill, loose: pieces of that length with rank low <= r < high lie in packs
    first, first + 1, ... in turn, at offset or one or several lengths after it. In loose patterns first is the place
    where the packs begin in the stream of all such packs, which is cut every `most` tokens; sequences of the stream come
    after the other ones."""
    fills = [sum(length * k for length, k in p) for p, _ in patterns]
    whole = sum(n for (_, n), f in zip(patterns, fills, strict=True) if f >= most - slack)
    first, stream, ranks, out = 0, whole * most, dict.fromkeys({length for p, _ in patterns for length, _ in p}, 0), []
    for (pattern, n), fill in zip(patterns, fills, strict=True):
        loose, offset = fill < most - slack, 0
        for length, k in pattern:
            out.append((length, ranks[length], ranks[length] + n * k, n, stream if loose else first, offset, fill, loose))
            ranks[length] += n * k
            offset += length * k
        stream, first = (stream + n * fill, first) if loose else (stream, first + n)
    return out


_PLACES = "length int, low long, high long, packs long, first long, place int, fill int, loose boolean"


def placed(cut: DataFrame, most: int = MOST, slack: int = SLACK) -> DataFrame:
    """cut: what pieces_of gives, saved. Adds sequence_id and offset; a piece at a cut of the stream becomes two."""
    counts = saved(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    plan = cut.sparkSession.createDataFrame(placements(shortest_pack_first(histogram, most), most, slack), _PLACES)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["part", "length"]).withColumn("r", F.col("before") + F.col("no"))
    # The plan's rows follow the number of lengths and not the pieces.
    met = ranked.join(F.broadcast(plan), ["length"]).where("low <= r and r < high")
    inside = F.expr("place + (r - low) div packs * length")
    at = F.expr("(r - low) % packs")
    met = met.withColumn("at", F.when(F.col("loose"), F.col("first") + at * F.col("fill") + inside).otherwise((F.col("first") + at) * most + inside))
    room = F.least(F.col("length").cast("bigint"), most - F.col("at") % most)
    one = F.struct(F.lit(0).cast("bigint").alias("skip"), room.alias("n"), F.col("at").alias("to"))
    rest = F.struct(room.alias("skip"), (F.col("length") - room).alias("n"), (F.col("at") + room).alias("to"))
    met = met.withColumn("x", F.explode(F.when(room < F.col("length"), F.array(one, rest)).otherwise(F.array(one))))
    ids = F.expr("substring(ids, cast(4 * x.skip + 1 as int), cast(4 * x.n as int))")
    return met.select("_id", (F.col("start") + F.col("x.skip")).alias("start"), F.col("x.n").alias("length"), ids.alias("ids"), "doc_tokens", F.expr(f"x.to div {most}").alias("sequence_id"), (F.col("x.to") % most).alias("offset"))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end: int = END, slack: int = SLACK) -> DataFrame:
    """Pieces of documents in sequences of at most `most` tokens: id_col, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id and offset in it.

    path: a tokenizer file, readable on all executors. Each row of docs is a document, repeated rows and null ids too; a
    null or empty text has the end id only. Other columns of docs are left out, whatever their names. Empty docs give
    no rows. Rows of a length keep the order of the input's tasks, so that reruns over the same files agree."""
    cut = pieces_of(docs, path, id_col, text_col, most, end)
    at = saved(cut, compression="zstd")
    return placed(at, most, slack).withColumnRenamed("_id", id_col)


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens of the public byte-level tokenizer, with a checksum for each piece."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
