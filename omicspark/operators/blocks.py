"""All-pairs counts over samples, by products of blocks of calls.

A block has the calls of some samples at neighbouring variants. Where most samples are called, calls become bit planes, one
bit a call and plane, and two blocks of the same variants are multiplied by AND and counted; elsewhere a block lists its
calls, and those of a variant meet one by one. So pairs of samples never meet variant by variant in a join: what is shuffled
are the blocks, once for each block of samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.functions.tables import stored
from omicspark.operators.gwas import ranked

#: Samples of a block at most, calls whose variants make up a block, pairs of calls that are counted at once, and rows of a batch.
SAMPLES, CALLS, AT_ONCE, ROWS = 1024, 1 << 20, 1 << 21, 1 << 16

Planes = np.ndarray  # plane, and samples


#: For calls at places of a block of variants: how many planes there are, and the bits to set as (plane, number of the call).
Bits = tuple[int, np.ndarray, np.ndarray]


class Kind(NamedTuple):
    """What a pair of calls comes to, as a number from 0: by bits and a product of planes (pairs in all, and those with 1, 2, ...)
    or by a table over the different calls; how many numbers there are; columns made of the counts of each number."""

    bits: Callable[..., Bits]
    product: Callable[[Planes, Planes], list[np.ndarray]]
    table: Callable[[list], np.ndarray]
    outcomes: int
    columns: dict[str, str]
    of: Callable[[np.ndarray], list[np.ndarray]]


def _alleles(known: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([ord(g[min(k, len(g) - 1)]) if g else -1 for g in known], np.int64) for k in (0, 1))


def genotype_bits(at: np.ndarray, genotype: pa.DictionaryArray) -> Bits:
    """Planes of bases: called, not diploid, and one for each allele of a variant (two, where no variant has more)."""
    known = [x.as_py() for x in genotype.dictionary]
    first, second = _alleles(known)
    code = genotype.indices.to_numpy()
    every, single = np.arange(len(at)), np.flatnonzero(np.array([len(g) < 2 for g in known], bool)[code])
    call = np.concatenate([np.flatnonzero(x[code] >= 0) for x in (first, second)])
    allele = np.concatenate([x[code][x[code] >= 0] for x in (first, second)])
    keys = at[call] << 21 | allele
    pairs = np.unique(keys)
    number = np.arange(len(pairs)) - np.searchsorted(pairs >> 21, pairs >> 21)
    plane = 2 + number[np.searchsorted(pairs, keys)]
    return 2 + int(number.max(initial=0)) + 1, np.concatenate([np.zeros(len(at), np.int64), np.ones(len(single), np.int64), plane]), np.concatenate([every, single, call])


def ibs_product(a: Planes, b: Planes) -> list[np.ndarray]:
    """In each word of planes, how many calls are common and how many of these share 1 and 2 alleles: diploid calls share 0 to 2
    alleles as multisets, haploid ones 0 or 2, a haploid and a diploid call none."""
    share, differ = a[2] & b[2], a[2] ^ b[2]
    for x, y in zip(a[3:], b[3:], strict=True):
        share |= x & y
        differ |= x ^ y
    both, single = a[0] & b[0], a[1] & b[1]
    diploid = both & ~(a[1] | b[1])
    one = diploid & share & differ
    two = (single & share) | (diploid & ~differ)
    return [np.bitwise_count(x) for x in (both, one, two)]


def ibs_table(known: list[str]) -> np.ndarray:
    """Alleles that each two of the genotypes share, as ibs_product() counts them."""
    x = np.sort(np.stack(_alleles(known)), axis=0)
    one = np.array([len(g) < 2 for g in known], bool)
    out = np.zeros((len(known), len(known)), np.int8)
    for i, (a, b) in enumerate(x.T):
        same = (x[0] == a) & (x[1] == b)
        some = (x[0] == a) | (x[1] == a) | (x[0] == b) | (x[1] == b)
        out[i] = np.where(one, 2 * same * (a >= 0), 0) if one[i] else np.where(one, 0, np.where(same, 2, some))
    return out


def ibs_columns(n: np.ndarray) -> list[np.ndarray]:
    """The share of alleles that are shared, rounded half up at the sixth place, common calls and equal calls."""
    calls = n.sum(axis=0)
    return [((2 * n[2] + n[1]) * 1_000_000 + calls) // (2 * calls) / 1e6, calls, n[2]]


def state_bits(at: np.ndarray, state: pa.DictionaryArray) -> Bits:
    """Planes of allele counts: called, and carrier."""
    carrier = np.flatnonzero(np.array([x.as_py() > 0 for x in state.dictionary], bool)[state.indices.to_numpy()])
    return 2, np.concatenate([np.zeros(len(at), np.int64), np.ones(len(carrier), np.int64)]), np.concatenate([np.arange(len(at)), carrier])


def carrier_product(a: Planes, b: Planes) -> list[np.ndarray]:
    """Variants that are common, and those at which both carry the allele."""
    return [np.bitwise_count(a[k] & b[k]) for k in (0, 1)]


def carrier_table(known: list[int]) -> np.ndarray:
    x = np.array(known) > 0
    return (x[:, None] & x).astype(np.int8)


IBS = Kind(genotype_bits, ibs_product, ibs_table, 3, {"ibs": "double", "n_overlap": "bigint", "n_concordant": "bigint"}, ibs_columns)
CARRIERS = Kind(state_bits, carrier_product, carrier_table, 2, {"risky": "bigint", "n": "bigint"}, lambda n: [n[1], n.sum(axis=0)])


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value (nulls have one, too), and the values."""
    x = column.combine_chunks().dictionary_encode("encode")
    return x.indices.to_numpy(zero_copy_only=False).astype(np.int64), x.dictionary


def _whole_variants(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about `most` calls of rows that are sorted by variant and part, so that no variant of a part is in two."""
    held: list[pa.RecordBatch] = []
    n, need = 0, most
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < need:
            continue
        table = pa.Table.from_batches(held)
        codes = [_codes(table.column(c))[0] for c in ("variant", "part")]
        other = np.flatnonzero((codes[0] != codes[0][-1]) | (codes[1] != codes[1][-1]))
        whole = int(other[-1]) + 1 if len(other) else 0
        if whole:
            yield table.slice(0, whole)
        held = table.slice(whole).to_batches()
        n -= whole
        need = max(most, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def packed(calls: DataFrame, bits: Callable[..., Bits], samples: DataFrame, by_part: bool = True) -> DataFrame:
    """calls: sample, variant, part, call (not null). samples: sample, number (from 1). Returns part (null without by_part),
    variants (a block of variants), own (a block of samples), all_own (the blocks of samples with calls there), width (samples
    of a block at most), known (the different calls), rows (which of its samples), n_planes, planes. Without planes, rows has one
    of its samples for each call, places its variant and codes its number in known. Of repeated calls the smallest counts.

    A block's variants follow each other in their order, so that where neighbouring variants are called in few samples,
    few blocks of samples meet in it."""
    kinds = dict(calls.dtypes)
    schema = f"part {kinds['part']}, variants bigint, own bigint, all_own array<bigint>, width bigint, known array<{kinds['call']}>, rows binary, places binary, codes binary, n_planes int, planes binary"
    n_calls, width = calls.count(), min(SAMPLES, max(64, -(-samples.count() // 16)))
    most = min(CALLS, max(1 << 14, n_calls // 64))
    numbered = calls.where("variant is not null").join(samples, "sample").select("part", "variant", (F.col("number") - 1).alias("number"), "call")
    dealt = numbered.repartitionByRange(max(1, -(-n_calls // most)), "variant", "part").sortWithinPartitions("variant", "part")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, table in enumerate(_whole_variants(batches, most)):
            code, known = _codes(table.column("call"))
            rank = np.argsort(np.array(known.to_pylist(), object))
            code, known = np.argsort(rank)[code], known.take(pa.array(rank))
            part, parts = _codes(table.column("part"))
            at = _codes(table.column("variant"))[0]
            at = np.cumsum(np.append(0, (at[1:] != at[:-1]) | (part[1:] != part[:-1])))
            number = table.column("number").to_numpy()
            order = np.lexsort((code, number, at, part))
            at, number, code, part = at[order], number[order], code[order], part[order]
            new = np.append(True, (number[1:] != number[:-1]) | (at[1:] != at[:-1]))
            at, number, code, part = at[new], number[new], code[new], part[new]
            variants = (TaskContext.get().partitionId() << 24) + k
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if by_part else np.array([0, len(part)])
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                own_part = parts[int(part[low])] if by_part else pa.scalar(None, parts.type)
                for own, every, fields in blocks(at[low:high], number[low:high], code[low:high], known):
                    row = {"part": own_part, "variants": variants, "own": own, "all_own": every, "width": width, "known": known.to_pylist()} | fields
                    yield pa.RecordBatch.from_arrays([pa.array([row[f.name].as_py() if f.name == "part" else row[f.name]], f.type) for f in arrow], schema=arrow)

    def blocks(at: np.ndarray, number: np.ndarray, code: np.ndarray, known: pa.Array) -> Iterator[tuple[int, list[int], dict]]:
        at = np.cumsum(np.append(0, at[1:] != at[:-1]))
        n_at = int(at[-1]) + 1
        own, row = number // width, number % width
        every = np.unique(own).tolist()
        # Planes take a step for each pair of samples and 64 variants, lists one for each pair of calls.
        flat = float((np.bincount(at).astype(float) ** 2).sum()) > float(len(np.unique(number))) ** 2 * -(-n_at // 64)
        if flat:
            n_planes, plane, which = bits(at, pa.DictionaryArray.from_arrays(pa.array(code), known))
            order = np.argsort(own[which], kind="stable")
            plane, which = plane[order], which[order]
        for block in every:
            mine = np.flatnonzero(own == block)
            if not flat:
                yield block, every, {"rows": row[mine].astype(np.uint16).tobytes(), "places": at[mine].astype(np.uint32).tobytes(), "codes": code[mine].astype(np.uint16 if len(known) < 1 << 16 else np.uint32).tobytes(), "n_planes": 0, "planes": b""}
                continue
            rows = np.unique(row[mine])
            x = np.zeros((-(-n_at // 64), n_planes, len(rows)), np.uint64)
            low, high = np.searchsorted(own[which], [block, block + 1])
            k = which[low:high]
            np.bitwise_or.at(x, (at[k] >> 6, plane[low:high], np.searchsorted(rows, row[k])), np.uint64(1) << (at[k] & 63).astype(np.uint64))
            yield block, every, {"rows": rows.astype(np.uint16).tobytes(), "places": b"", "codes": b"", "n_planes": n_planes, "planes": x.tobytes()}

    arrow = _arrow(calls, schema)
    return stored(dealt.mapInArrow(pack, schema))


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _span(rows: np.ndarray) -> np.ndarray | slice:
    """The rows, which are in order, as a slice where they follow each other."""
    return slice(int(rows[0]), int(rows[-1]) + 1) if rows[-1] - rows[0] + 1 == len(rows) else rows


class _Counts:
    """Of a pair of blocks of samples: how often each number comes of the pairs of their calls."""

    def __init__(self, outcomes: int, width: int):
        self.shape, self.held, self.n = (outcomes, width, width), [], 0
        self.all = np.zeros(self.shape, np.int64)

    def add(self, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], same: bool, table: np.ndarray) -> None:
        """The pairs of listed calls (row, place, code; sorted by place) of one variant; the same block's with those after."""
        area = self.shape[1] * self.shape[2]
        n = len(right[0])
        low = np.arange(1, n + 1) if same else np.searchsorted(right[1], left[1])
        many = np.searchsorted(right[1], left[1], "right") - low
        step = max(1, (1 << 22) // max(n, 1))
        for first in range(0, len(table), step):
            # What each call of the right has with each different call of the left.
            cells = (table[first : first + step][:, right[2]].astype(np.int32) * area + right[0]).reshape(-1)
            own = np.flatnonzero((many > 0) & (left[2] >= first) & (left[2] < first + step)) if len(table) > step else np.flatnonzero(many)
            begin, row, k = low[own] + (left[2][own] - first) * n, left[0][own].astype(np.int32) * self.shape[2], many[own]
            upto = np.cumsum(k)
            a = 0
            while a < len(own):
                done = upto[a] - k[a]
                b = max(a + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
                each = k[a:b]
                at = np.arange(upto[b - 1] - done) + np.repeat(begin[a:b] - (upto[a:b] - each - done), each)
                self.held.append(cells[at] + np.repeat(row[a:b], each))
                self.n += len(at)
                if self.n >= AT_ONCE:
                    self.counted()
                a = b

    def multiply(self, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], product: Callable[[Planes, Planes], list[np.ndarray]]) -> None:
        """The pairs of calls in planes (rows, planes by word, plane and row)."""
        to = _span(right[0])
        step = max(1, (1 << 14) // len(right[0]))
        for k in range(0, len(left[0]), step):
            n = np.zeros((self.shape[0], len(left[0][k : k + step]), len(right[0])), np.int64)
            for x, y in zip(left[1], right[1], strict=True):
                for own, found in zip(n, product(x[:, k : k + step, None], y[:, None, :]), strict=True):
                    own += found
            n[0] -= n[1:].sum(axis=0)
            at = _span(left[0][k : k + step])
            if isinstance(at, slice) or isinstance(to, slice):
                self.all[:, at, to] += n
            else:
                self.all[:, at[:, None], to] += n

    def counted(self) -> np.ndarray:
        if self.held:
            self.all += np.bincount(np.concatenate(self.held), minlength=self.all.size).reshape(self.shape)
            self.held, self.n = [], 0
        return self.all


def pair_sums(blocks: DataFrame, samples: DataFrame, kind: Kind, by_part: bool, whole: bool) -> DataFrame:
    """sample_1, sample_2 (by their numbers, the smaller one first), part and the columns of the kind for all pairs of samples
    with a common call. by_part: a row for each part; whole: one over all parts, with a null part. A block goes to the blocks of
    samples that have calls of the same variants. A task streams the blocks of a pair of blocks of samples and holds its
    counts only; the names of the samples come first, so that no row is joined with them."""
    types = dict(blocks.dtypes) | dict(samples.dtypes)
    pair = F.explode(F.transform("all_own", lambda x: F.struct(F.least(x, F.col("own")).alias("a"), F.greatest(x, F.col("own")).alias("b"))))
    columns = ["part", "variants", "own", "width", "known", "rows", "places", "codes", "n_planes", "planes"]
    met = blocks.withColumn("x", pair).select("x.a", "x.b", *columns, F.lit(None).cast(f"array<{types['sample']}>").alias("names"))
    pairs = stored(blocks.select(pair.alias("x")).select("x.a", "x.b").distinct())
    width = F.lit((blocks.select("width").first() or [1])[0])
    named = samples.groupBy(F.floor((F.col("number") - 1) / width).alias("own")).agg(F.array_sort(F.collect_list(F.struct("number", "sample"))).alias("x")).select("own", F.col("x.sample").alias("names"))
    head = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("own")).join(named, "own").withColumns({c: F.lit(None).cast(types[c]) for c in columns if c not in ("own", "variants")}).withColumn("variants", F.lit(-1).cast("bigint"))
    schema = f"sample_1 {types['sample']}, sample_2 {types['sample']}, part {types['part']}, " + ", ".join(f"{c} {t}" for c, t in kind.columns.items())

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted(part: pa.Scalar, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            calls = counts.sum(axis=0)
            if pair[0] == pair[1]:
                calls = np.triu(calls, 1)
            i, j = np.nonzero(calls)
            for k in range(0, len(i), ROWS):
                x, y = i[k : k + ROWS], j[k : k + ROWS]
                fields = [names[pair[0]].take(pa.array(x)), names[pair[1]].take(pa.array(y)), pa.array([part.as_py()], part.type).take(pa.array(np.zeros(len(x), np.int64)))]
                yield pa.RecordBatch.from_arrays(fields + [pa.array(c) for c in kind.of(counts[:, x, y])], names=["sample_1", "sample_2", "part", *kind.columns])

        def ended() -> Iterator[pa.RecordBatch]:
            """The rows of a part."""
            nonlocal every
            if sums is None:
                return
            now = sums.counted()
            if by_part:
                yield from emitted(part, now)
            if whole:
                every = now if every is None else every + now

        def ended_pair() -> Iterator[pa.RecordBatch]:
            yield from ended()
            if whole and every is not None:
                yield from emitted(pa.scalar(None, part.type), every)

        pair, part, sums, every, left, names, tables = None, None, None, None, None, {}, {}
        for batch in batches:
            field = {c: batch.column(c).to_pylist() for c in ("a", "b", "variants", "own", "part", "width", "known", "n_planes")}
            for r in range(batch.num_rows):
                at, own, variants = (field["a"][r], field["b"][r]), field["own"][r], field["variants"][r]
                if at != pair:
                    yield from ended_pair()
                    pair, sums, every, left, names = at, None, None, None, {}
                if variants < 0:
                    names[own] = batch.column("names")[r].values
                    continue
                if sums is None or field["part"][r] != part.as_py():
                    yield from ended()
                    part, sums = batch.column("part")[r], _Counts(kind.outcomes, field["width"][r])
                n_planes = field["n_planes"][r]
                raw = {c: batch.column(c)[r].as_buffer() for c in ("rows", "places", "codes", "planes")}
                rows = np.frombuffer(raw["rows"], np.uint16).astype(np.int64)
                if n_planes:
                    block = rows, np.frombuffer(raw["planes"], np.uint64).reshape(-1, n_planes, len(rows))
                else:
                    known = tuple(field["known"][r])
                    block = rows, np.frombuffer(raw["places"], np.uint32).astype(np.int64), np.frombuffer(raw["codes"], np.uint16 if len(known) < 1 << 16 else np.uint32).astype(np.int64)
                if own == at[0]:
                    left = (variants, block)
                if own == at[1] and left is not None and left[0] == variants:
                    if n_planes:
                        sums.multiply(left[1], block, kind.product)
                    else:
                        if known not in tables:
                            tables = (tables if len(tables) < 64 else {}) | {known: kind.table(list(known))}
                        sums.add(left[1], block, at[0] == at[1], tables[known])
                elif own == at[1]:
                    left = None
        if pair is not None:
            yield from ended_pair()

    # A number is given, since adaptive execution would join small parts whose products are long.
    spark = blocks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, min(5000, pairs.count()))
    dealt = met.unionByName(head).repartition(parts, "a", "b").sortWithinPartitions("a", "b", "part", "variants", "own")
    return dealt.mapInArrow(multiply, schema)


def _all_pairs(calls: DataFrame, kind: Kind, by_part: bool = True, whole: bool = False) -> DataFrame:
    calls = stored(calls)
    samples = stored(ranked(calls.select("sample").distinct(), [F.col("sample")], "number"))
    return pair_sums(packed(calls, kind.bits, samples, by_part), samples, kind, by_part, whole)


def ibs_pairs(genotypes: DataFrame, by_chrom: bool = True) -> DataFrame:
    """IBS of all pairs of samples, overall (chrom null) and by chromosome (or overall only), over variants that both have:
    sample_1 < sample_2, chrom, ibs, n_overlap, n_concordant. Genotypes are bases; null ones are no calls, and a sample's
    repeated calls of a variant count once."""
    calls = genotypes.where("genotype is not null and sample_id is not null").select(F.col("sample_id").alias("sample"), F.col("variant_id").alias("variant"), F.col("chrom").alias("part"), F.col("genotype").alias("call"))
    return _all_pairs(calls, IBS, by_chrom, True).withColumnRenamed("part", "chrom")


#: Individuals of a sex and pairs of classes that are sent to the tasks at once; more are dealt to parts, which each female meets.
MALES, CLASS_PAIRS = 500_000, 250_000
#: Males that follow each other for a female, and females whose pairs with them are a task's rows.
TILE = 256, 40_000


def compatible_classes(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """calls: id, sex, locus, state (0/1/2). Individuals of a sex with the same loci and alleles are a class, named by its
    smallest id. Returns f_rep, m_rep, n_loci, compatibility for all pairs of a class of females (0) and one of males (1) with
    common loci (the share of these at which not both carry the allele); female, f_rep; male, m_rep. Of repeated calls the
    smallest counts."""
    known = calls.where("sex in (0, 1) and state is not null and id is not null")
    seen = known.groupBy("sex", "id", "locus").agg((F.min("state") > 0).cast("int").alias("state"))
    profiles = stored(seen.groupBy("sex", "id").agg(F.array_sort(F.collect_list(F.struct("locus", "state"))).alias("profile")))
    classes = stored(profiles.groupBy("sex", "profile").agg(F.min("id").alias("rep")))
    members = stored(profiles.join(classes, ["sex", "profile"]).select("sex", "id", "rep"))
    own = classes.select(F.struct("sex", F.col("rep").alias("id")).alias("sample"), F.inline("profile")).select("sample", F.col("locus").alias("variant"), F.lit(0).alias("part"), F.col("state").alias("call"))
    # Females are numbered before males, so that each mixed pair has the female first.
    mixed = _all_pairs(own, CARRIERS).where("sample_1.sex = 0 and sample_2.sex = 1")
    pairs = stored(mixed.select(F.col("sample_1.id").alias("f_rep"), F.col("sample_2.id").alias("m_rep"), F.col("n").alias("n_loci"), F.round(1 - F.col("risky") / F.col("n"), 6).alias("compatibility")))
    females, males = (members.where(F.col("sex") == sex).select(F.col("id").alias(name), F.col("rep").alias(rep)) for sex, name, rep in ((0, "female", "f_rep"), (1, "male", "m_rep")))
    return pairs, females, males


def expanded(pairs: DataFrame, females: DataFrame, males: DataFrame) -> DataFrame:
    """The pairs of classes as pairs of their members: female, male and the other columns of pairs.

    A task has the pairs of a few males with many females, and the same males come again and again for one female after the
    other, so that a file's dictionaries stay small and its columns repeat: written rows take a tenth of a byte or two each."""
    n_females, n_males = females.count(), males.count()
    columns = ["female", "male", *[c for c in pairs.columns if c not in ("f_rep", "m_rep")]]
    if max(n_females, n_males) <= MALES and pairs.count() <= CLASS_PAIRS:
        of_part, n_tile = TILE
        m_parts = -(-n_males // of_part)
        one = stored(ranked(females, [F.col("f_rep"), F.col("female")], "at"))
        other = ranked(males, [F.col("m_rep"), F.col("male")], "at").withColumn("m_part", F.floor((F.col("at") - 1) / of_part))
        other = stored(other.groupBy("m_part", "m_rep").agg(F.sort_array(F.collect_list("male")).alias("males")))
        # A row for each female and part of the males, so that a task makes few rows from each at once.
        asked = n_females * m_parts
        tiles = pairs.sparkSession.range(0, asked, 1, max(1, min(20_000, -(-asked // n_tile)))).select((F.col("id") % max(1, n_females) + 1).alias("at"), F.expr(f"id div {max(1, n_females)}").alias("m_part"))
        met = tiles.join(F.broadcast(one), "at").join(F.broadcast(pairs), "f_rep").join(F.broadcast(other), ["m_part", "m_rep"])
        return met.withColumn("male", F.explode("males")).select(*columns)
    parts = max(1, -(-n_males // MALES))
    # A task has about ten million pairs.
    tasks = max(1, min(20_000, n_females * n_males // 10_000_000, n_females))
    asking = females.repartition(tasks).join(pairs, "f_rep")
    if parts == 1:
        met = asking.join(F.broadcast(males), "m_rep")
    else:
        met = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(males.withColumn("part", F.pmod(F.xxhash64("male"), F.lit(parts)).cast("int")), ["m_rep", "part"])
    return met.select(*columns)


def compatibility(calls: DataFrame) -> DataFrame:
    """calls: id, sex, locus, state (0/1/2). For all pairs of a female (0) and a male (1) with common loci: the share of
    these at which not both carry the allele: female, male, n_loci, compatibility. Of repeated calls the smallest counts.

    Pairs of classes are multiplied and expanded to their members at last."""
    return expanded(*compatible_classes(calls))
