"""Secret scan through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query (an AND of clauses, each an OR of trigram sets) that every
text with a match satisfies. The index has postings (trigram, text key) for the trigrams that any rule asks for; the
posting lists are intersected per text key, and only the candidates are searched with the regular expression. A rule
without mandatory trigrams (a run of hexadecimal digits) searches every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omicspark.llm.common import saved

#: A set of trigrams that must all occur; a clause is a list of such sets of which one must hold.
Clause = list[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """kind: a name. pattern: for Java's and Python's regular expressions. group: the group that must have at least
    `least` characters. base: whether its spans count as base ones."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The formats of known credentials.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    # A longest run of 32 or more: the same spans as [0-9a-f]+ whose failing matches are dropped.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
#: The most strings that a part of a pattern is spelled out into.
SPELLED = 16


def _strings(op, arg) -> list[str] | None:
    """All lower-cased strings that a node of a parsed pattern can match, if they are few."""
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN:
        if any(o is not sre.LITERAL for o, _ in arg):
            return None
        return sorted({chr(a).lower() for _, a in arg})
    if op is sre.SUBPATTERN:
        return _spelled(arg[3])
    if op is sre.BRANCH:
        each = [_spelled(x) for x in arg[1]]
        return None if None in each or sum(map(len, each)) > SPELLED else [s for x in each for s in x]
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        one = _spelled(arg[2])
        out = [""] if one is not None else None
        if out is None:
            return None
        all_ = [""] if arg[0] == 0 else []
        for n in range(1, int(arg[1]) + 1):
            out = [a + b for a in out for b in one]
            all_ += out if n >= arg[0] else []
        return all_ if len(all_) <= SPELLED else None
    return None


def _spelled(nodes) -> list[str] | None:
    out = [""]
    for op, arg in nodes:
        one = _strings(op, arg)
        if one is None or len(out) * len(one) > SPELLED:
            return None
        out = [a + b for a in out for b in one]
    return out


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that all hold for the lower-cased text of any match; none if the pattern has no mandatory trigram."""
    clauses: list[Clause] = []
    run = [""]

    def end() -> None:
        if all(len(s) >= 3 for s in run):
            clauses.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run])

    for op, arg in sre_parser.parse(pattern):
        one = _strings(op, arg)
        if one is not None and len(run) * len(one) <= SPELLED:
            run = [a + b for a in run for b in one]
        else:
            end()
            run = one if one is not None else [""]
    end()
    return clauses


#: Trigrams in one mask.
BITS = 62


def _holds(clauses: list[Clause], ids: dict[str, int]) -> Column:
    """Whether a text whose trigrams are the bits of mask0, mask1, ... is a candidate."""
    out = F.lit(True)
    for clause in clauses:
        any_ = F.lit(False)
        for need in clause:
            all_ = F.lit(True)
            for block in sorted({ids[t] // BITS for t in need}):
                bits = F.lit(sum(1 << ids[t] % BITS for t in need if ids[t] // BITS == block)).cast("bigint")
                all_ = all_ & (F.col(f"mask{block}").bitwiseAND(bits) == bits)
            any_ = any_ | all_
        out = out & any_
    return out


def postings(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """key, trigram (its place in the list): the texts, by XXH64, in which each trigram occurs. Copies of a text share
    their postings; should two texts share a key, their postings are joined, which only adds candidates."""
    low = docs.select(F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"), F.lower(F.col(text_col)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("key", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """key, and for each rule with mandatory trigrams a boolean column c_<kind>; only texts that are a candidate of
    some rule. Postings of a key are merged before the shuffle (bit_or is a partial aggregate)."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for need in clause for t in need})
    ids = {t: i for i, t in enumerate(trigrams)}
    if not ids:
        raise ValueError("no rule has a mandatory trigram")
    masks = [F.bit_or(F.expr(f"if(trigram div {BITS} = {b}, shiftleft(1L, cast(trigram % {BITS} as int)), 0L)")).alias(f"mask{b}") for b in range(len(trigrams) // BITS + 1)]
    merged = postings(docs, trigrams, text_col).groupBy("key").agg(*masks)
    flags = merged.select("key", *[_holds(q, ids).alias(f"c_{k}") for k, q in queries.items()])
    return flags.where(" or ".join(f"c_{k}" for k in queries))


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of bigint. Two levels of 256, as each step of aggregate() copies what it has so far."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x
        return F.struct(total.alias("sum"), F.concat(acc["out"], F.array(total)).alias("out"))

    def add_chunk(acc: Column, chunk: Column) -> Column:
        own = F.aggregate(chunk, start, add)
        return F.struct((acc["sum"] + own["sum"]).alias("sum"), F.concat(acc["out"], F.transform(own["out"], lambda x: x + acc["sum"])).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / 256).cast("int")), lambda i: F.slice(values, i * 256 + 1, 256))
    return F.aggregate(chunks, start, add_chunk)["out"]


def _spans(df: DataFrame, rule: Rule, no: int, candidate: Column, text_col: str) -> DataFrame:
    """Adds s_<kind>: array of struct(start, no, end, kind) of the rule's matches, by start."""
    k = rule.kind
    text = F.when(candidate, F.col(text_col))
    df = df.withColumns({f"m_{k}": F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), f"g_{k}": F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), f"p_{k}": F.split(text, rule.pattern, -1)})
    df = df.withColumns({f"l_{k}": F.transform(f"m_{k}", lambda x: F.length(x).cast("bigint")), f"n_{k}": F.transform(f"g_{k}", F.length), f"p_{k}": F.transform(f"p_{k}", lambda x: F.length(x).cast("bigint"))})
    # The i-th match starts after i + 1 pieces and i matches.
    steps = F.zip_with(F.slice(f"p_{k}", F.lit(1), F.size(f"l_{k}")), F.concat(F.array(F.lit(0).cast("bigint")), F.slice(f"l_{k}", F.lit(1), F.greatest(F.size(f"l_{k}") - 1, F.lit(0)))), lambda a, b: a + F.coalesce(b, F.lit(0).cast("bigint")))
    steps = F.slice(steps, F.lit(1), F.size(f"l_{k}"))
    df = df.withColumn(f"a_{k}", steps).withColumn(f"a_{k}", prefix_sums(F.col(f"a_{k}")))
    zipped = F.filter(F.arrays_zip(f"a_{k}", f"l_{k}", f"n_{k}"), lambda x: x[f"n_{k}"] >= rule.least)
    spans = F.transform(zipped, lambda x: F.struct(x[f"a_{k}"].alias("start"), F.lit(no).alias("no"), (x[f"a_{k}"] + x[f"l_{k}"]).alias("end"), F.lit(k).alias("kind")))
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")
    return df.withColumn(f"s_{k}", F.coalesce(spans, none)).drop(*[f"{x}_{k}" for x in "mglnpa"])


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of struct start, no, end, kind; code points, end exclusive; by start, then by the order of
    the rules), one row per row of docs.

    A null text counts as empty and has no spans; a null or repeated doc_id is kept as it is; other columns of docs are
    not read. The candidates are joined by the text's key; where they are few, their size on disk lets the optimizer
    broadcast them under spark.sql.autoBroadcastJoinThreshold, and else the join is shuffled."""
    rules = RULES if rules is None else rules
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    indexed = [r for r in rules if trigram_query(r.pattern)]
    df = docs
    if indexed:
        found = saved(candidates(docs, indexed))
        df = docs.withColumn("key", F.xxhash64("text")).join(found, "key", "left")
    for no, rule in enumerate(rules):
        if rule in indexed:
            candidate = F.coalesce(F.col(f"c_{rule.kind}"), F.lit(False))
        else:  # no mandatory trigram: every text is searched
            candidate = F.col("text").rlike(rule.pattern)
        df = _spans(df, rule, no, candidate, "text")
    return df.select("doc_id", F.array_sort(F.concat(*[F.col(f"s_{r.kind}") for r in rules])).alias("spans"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """op6: all spans of documents, and the base ones' digest."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [r.kind for r in RULES if r.base]

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    only = found.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(base)))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] != k), F.lit(True))).cast("bigint").alias(f"n_{k}") for k in base]
    return only.select("doc_id", *counts, F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _kind_sql(rule: Rule, no: int) -> str:
    pat = rule.pattern.replace("'", "''")
    return f"""list_transform(list_filter(list_transform(range(len(regexp_extract_all(t, '{pat}', 0))), lambda i: {{
        'start': list_sum(list_transform(string_split_regex(t, '{pat}')[1:i + 1], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pat}', 0)[1:i], lambda x: length(x))), 0)::BIGINT,
        'len': length(regexp_extract_all(t, '{pat}', 0)[i + 1]), 'ok': length(regexp_extract_all(t, '{pat}', {rule.group})[i + 1]) >= {rule.least}}}), lambda m: m.ok),
        lambda m: {{'start': m.start, 'no': {no}, 'txt': '{rule.kind}:' || m.start || ':' || (m.start + m.len)}})"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, {", ".join(f"{_kind_sql(r, i)} AS s_{r.kind}" for i, r in enumerate(RULES))} FROM d)
SELECT doc_id, len(s_assign)::BIGINT AS n_assign, len(s_access)::BIGINT AS n_access, len(s_hex)::BIGINT AS n_hex,
  sha256(array_to_string(list_transform(list_sort(s_assign || s_access || s_hex), lambda x: x.txt), ',')) AS base_sha256,
  array_to_string(list_transform(list_sort({" || ".join(f"s_{r.kind}" for r in RULES)}), lambda x: x.txt), ',') AS spans
FROM s
"""
