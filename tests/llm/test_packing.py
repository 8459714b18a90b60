"""Packing against plain encoding, and its plan against its own counts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from omicspark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
MIXED = [
    "plain words, and  two spaces\n\n\ttabs \r\n end  ", "", None, " ", "\n", "<|endoftext|>a <|endoftext|> b", "it's we'll I'M 12345 ½ ²x", "a b　c  d\x85e \x1c\x1d!\x1e f", "été à l'été naïve 漢字 かな 한글 ไทย",
    "zero​width ﻿mark ᠎ x", "x" * 5000, "😀 😀😀 👩‍👩‍👧 z", "a\x00b \x01 c\x7f", "a ́ é é !!  !? ...  --", "  \n  x  \n\n\n y \t",
]


def whole(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def test_parts_encode_like_whole_texts():
    tok = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(1)
    alphabet = [*"ab é'!. \n\t\r\x0b\x0c0漢", "́", "'s", "  ", "\x1c", "\xa0", " ", "<|endoftext|>"]
    texts = [x or "" for x in MIXED] + ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(2000)]
    encoder = packing.Encoder(PATH)
    for text in texts:
        got = np.frombuffer(b"".join(encoder.ids(text)), "<u4").tolist()
        assert got == tok.encode(text, add_special_tokens=False).ids, text


def test_texts_in_small_parts_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "AT_ONCE", 5)
    test_parts_encode_like_whole_texts()


def checked(rows, texts, most=1024, slack=packing.SLACK):
    """rows: doc_id, start, length, ids, doc_tokens, sequence_id, offset of packed texts by id."""
    tok = Tokenizer.from_file(PATH)
    parts, seqs = defaultdict(list), defaultdict(list)
    for doc, start, length, ids, tokens, seq, offset in rows:
        ids = np.frombuffer(ids, "<u4").tolist()
        assert len(ids) == length > 0
        parts[doc].append((start, ids, tokens))
        seqs[seq].append((offset, length))
    assert set(parts) == set(texts)
    for doc, own in parts.items():
        expected = whole(tok, texts[doc])
        own.sort()
        assert [x for _, ids, _ in own for x in ids] == expected
        assert [s for s, _, _ in own] == [sum(len(i) for _, i, _ in own[:k]) for k in range(len(own))]
        assert {t for _, _, t in own} == {len(expected)}
    fills = []
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
        fills.append(at)
    assert sorted(seqs) == list(range(len(seqs)))
    assert sum(f < most - slack for f in fills) <= 1
    return fills


def test_other_tokenizers_are_left_to_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, tok = packing.Encoder(path), Tokenizer.from_file(path)
    assert encoder.fast is None and packing.Encoder(PATH).fast is not None
    assert np.frombuffer(b"".join(encoder.ids("Some words, été")), "<u4").tolist() == tok.encode("Some words, été", add_special_tokens=False).ids


def test_pack_holds_every_id_once(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(50)]
    texts = {i: t for i, t in enumerate(MIXED)}
    for i in range(300):
        texts[100 + i] = " ".join(rng.choice(words, rng.integers(1, 3000 if i % 20 == 0 else 200)))
    copy = " ".join(rng.choice(words, 330))
    texts |= {1000 + i: copy for i in range(150)}  # a third of the rows have one length of over half a sequence
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("ids", F.lit(1)).repartition(5)
    out = packing.pack(docs, PATH)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    checked(out.collect(), texts)


def test_pack_of_edges(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a"), (7, None), (7, "b c"), (7, "b c")], schema), PATH).collect()
    assert Counter((r[0], r["doc_tokens"]) for r in rows) == {(None, 2): 1, (7, 1): 1, (7, 3): 2}
    assert {r["sequence_id"] for r in rows} == {0} and sorted(r["offset"] for r in rows)[0] == 0


@pytest.mark.parametrize("histogram", [{700: 1000}, {1: 10**6}, {400: 100, 3: 5}, {1: 10**6, 700: 10**5, 1024: 10}, {i: 1000 - i // 2 for i in range(1, 1025)}, {}])
def test_plan_places_each_length_once(histogram):
    patterns = packing.shortest_pack_first(histogram)
    placed = Counter()
    for pattern, n in patterns:
        assert sum(length * k for length, k in pattern) <= 1024 and n > 0
        for length, k in pattern:
            placed[length] += n * k
    assert placed == Counter(histogram)
    ranges = defaultdict(list)
    for length, low, high, *_ in packing.placements(patterns):
        ranges[length].append((low, high))
    for length, own in ranges.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == histogram[length] and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_shortest_pack_comes_first():
    """Of the packs with room the emptiest takes the next length."""
    assert packing.shortest_pack_first({900: 1, 600: 1, 100: 1}) == [(((900, 1),), 1), (((600, 1), (100, 1)), 1)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    tok = Tokenizer.from_file(PATH)
    rows = __spark_entry__.queries()["op12_packing"](spark, sf).collect()
    ids = {d: np.array(whole(tok, t), "<u4") for d, t in texts.items()}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
