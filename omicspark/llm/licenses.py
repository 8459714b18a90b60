"""License scan by conditional compression.

Candidate blocks are aligned to a template by its anchor words: a block in which too few of them stand where the
template has them can't be within the allowed differences. A block is compressed with each template as a raw zstandard
dictionary; templates are ranked by how much smaller that makes it, and the winner is confirmed by the words that really
differ.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from omicspark.llm.common import appended, pieces, with_fields

# The wording of well-known license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
}
#: The most differing words, as a share of the template's, and the least share by which the template shrinks the block.
DIFFERENT, SHRINKS = 0.2, 0.3
#: Letters of an anchor word at least.
ANCHOR = 5
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:[.-][0-9a-z\x80-\xff]+)*")
ADDED = [T.StructField("licenses", T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("shrinks", T.DoubleType()), T.StructField("n_different", T.LongType())])))]


class Scanner:
    """Finds the templates' notices in UTF-8 texts."""

    def __init__(self, templates: dict[str, str]):
        self.words = {k: [w.decode() for w in _WORD.findall(t.lower().encode())] for k, t in templates.items()}
        self.places: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        self.need: dict[str, int] = {}
        for k, words in self.words.items():
            anchors = [i for i, w in enumerate(words) if len(w) >= ANCHOR]
            # With at most DIFFERENT of all words changed, so many anchors are left.
            self.need[k] = max(1, len(anchors) - int(DIFFERENT * len(words)))
            for i in anchors:
                self.places[words[i].encode()].append((k, i))
        self.any = re.compile(b"|".join(sorted(map(re.escape, self.places), key=len, reverse=True)) or b"(?!)")
        plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.plain = plain
        self.with_template = {k: zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, words in self.words.items()}

    def blocks(self, words: list[bytes]) -> list[tuple[int, int]]:
        """First word and end of the blocks that have enough anchors in a template's order, up to a shift."""
        hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for p, w in enumerate(words):
            for k, q in self.places.get(w, ()):
                hits[k].append((p - q, q))
        out = set()
        for k, own in hits.items():
            slack = int(DIFFERENT * len(self.words[k]))
            own.sort()
            i = 0
            while i < len(own):
                j = i
                while j < len(own) and own[j][0] <= own[i][0] + slack:
                    j += 1
                if len({q for _, q in own[i:j]}) >= self.need[k]:
                    out.add((max(0, own[i][0]), min(len(words), own[j - 1][0] + len(self.words[k]))))
                i += 1
        return sorted(out)

    def rank(self, block: bytes) -> list[tuple[float, str]]:
        """Templates by the share of the block's compressed size that they save, those that save enough."""
        alone = len(self.plain.compress(block))
        saves = [(1 - len(c.compress(block)) / alone, k) for k, c in self.with_template.items()]
        return sorted(((s, k) for s, k in saves if s >= SHRINKS), key=lambda x: (-x[0], x[1]))

    def confirm(self, words: list[str], template: str) -> tuple[int, int, int] | None:
        """First word, end and number of differing words of the template's wording in the block, if few differ."""
        own = self.words[template]
        same = [m for m in SequenceMatcher(None, own, words, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        different, a, b = 0, 0, max(0, same[0].b - same[0].a)
        first = b
        for m in same:
            different += max(m.a - a, m.b - b)
            a, b = m.a + m.size, m.b + m.size
        different += len(own) - a
        return (first, min(len(words), b + len(own) - a), different) if different <= DIFFERENT * len(own) else None

    def find(self, text: bytes) -> list[tuple[str, int, int, float, int]]:
        """license, start and end (bytes), share saved, differing words; the best of those that overlap, in order."""
        low = text.lower()
        if not self.any.search(low):
            return []
        at = [m.span() for m in _WORD.finditer(low)]
        words = [low[a:b] for a, b in at]
        found = []
        for a, b in self.blocks(words):
            for saves, k in self.rank(b" ".join(words[a:b])):
                if ok := self.confirm([w.decode() for w in words[a:b]], k):
                    first, end, different = ok
                    found.append((k, at[a + first][0], at[a + end - 1][1], saves, different))
                    break
        out: list = []
        for x in sorted(found, key=lambda x: (x[1] - x[2], -x[3], x[0], x[1])):  # longer wording first
            if all(x[2] <= y[1] or x[1] >= y[2] for y in out):
                out.append(x)
        return sorted(out, key=lambda x: x[1])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """docs with licenses: the notices in each text (license, start and end in code points, end exclusive, the share by
    which the template shrinks the block, and how many of its words differ), in order, never overlapping. Null and
    empty texts have none; a column named licenses gives way. Row by row, with no shuffle; texts of any length."""
    sent = docs.sparkSession.sparkContext.broadcast(TEMPLATES if templates is None else templates)
    schema = with_fields(docs.schema, ADDED)
    arrow = to_arrow_schema(schema)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for batch, data, offsets in pieces(rows, text_col):
            out = []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                own = scanner.find(text)
                out.append([{"license": k, "start": len(text[:a].decode()), "end": len(text[:b].decode()), "shrinks": s, "n_different": n} for k, a, b, s, n in own])
            yield appended(batch, arrow, {"licenses": pa.array(out, arrow.field("licenses").type)})

    return docs.mapInArrow(add, schema)


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """All documents with the licence texts found in them, a digest of their spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), x["n_different"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join(spans, ",").alias("licenses"))
