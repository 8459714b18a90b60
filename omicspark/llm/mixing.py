"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix is a number of blocks of BLOCK tokens. Blocks go to sources by highest quotients of their targets, and each
source's blocks to its shards by highest quotients of the shards' tokens, no more to a shard than three times its tokens
need. One rule holds at every size: quotients are put in order by ranges, so that no task sees all shards of a source. In a
shard the documents lie in a seeded order on one line of tokens; a shard of n tokens whose quota is q tokens takes all of
them q div n times and the first q mod n tokens of the line once more. What the blocks leave to a source's target, or are
beyond it, is made up by its first shards that have room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.llm.common import saved

#: Tokens of a block.
BLOCK = 64
#: Documents of a shard, on average: windows over a shard stay small however large its source is.
SHARD_DOCS = 64
#: Shards that are added up together before the running sums over a source.
FAN = 2048
#: No source, and no document, is taken more often than this.
MOST_EPOCHS = 3


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with no: 0, 1, ... in the order. Ranges of rows are ordered in tasks of their own and the ranges' sizes carried
    on, so that no task has all rows."""
    ranged = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    before, total = [], 0
    for k, n in sizes:
        before += [F.lit(k), F.lit(total).cast("bigint")]
        total += n
    start = F.create_map(*before)[F.col("_range")] if before else F.lit(0).cast("bigint")
    at = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("no", start + at - 1).drop("_range")


def apportion(df: DataFrame, group: list[str], weight: str, seats: str, order: list[str], cap: str | None = None) -> DataFrame:
    """Adds quota: of the group's seats (the same number in each of its rows), each row's share by highest quotients
    weight / (2k - 1), but no more than its cap; equal quotients go by `order`, which tells the rows of a group apart. Rows
    without a positive weight get none. No column is null. A cap is weight times some number, the same for all rows of a
    group, rounded up.

    With y = 1 / (2 * least quotient), a row has floor(weight * y + 1/2) seats. As these are within half a seat of
    weight * y, y is between (seats - n/2) / W and (seats + n/2) / W, or beyond if caps bind. What all rows have at the
    lower end is theirs; only the quotients from there on, one or two a row on average, are put in order."""
    some = df.select(*group, *order, seats, *([cap] if cap else []), F.when(F.col(weight) > 0, F.col(weight).cast("double")).alias("_w"))
    whole = some.groupBy(*group).agg(F.count("_w").alias("_n"), F.sum("_w").alias("_all"), *([(F.sum(cap) / F.sum("_w")).alias("_most")] if cap else []))
    some = some.join(whole, group).where("_w is not null")
    low = F.greatest(F.col(seats) - F.col("_n") / 2 - 1, F.lit(0.0)) / F.col("_all")
    high = (F.col(seats) + F.col("_n") / 2 + 1) / F.col("_all")
    least, most = (F.floor(F.col("_w") * y + 0.5) for y in (low, high))
    if cap:
        # The caps are near weight * _most; below that they bind no row, and from there on every row may reach its own.
        near = F.col("_most") - F.col("_n") / F.col("_all")
        least, most = F.least(least, F.col(cap)), F.when(high < near, F.least(most, F.col(cap))).otherwise(F.col(cap))
    rows = saved(some.select(*group, *order, seats, "_w", least.alias("_low"), F.greatest(least, most).alias("_high")))
    left = rows.groupBy(*group).agg((F.first(seats) - F.sum("_low")).alias("_left"))
    more = rows.where("_high > _low").select(*group, *order, "_w", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    more = more.withColumn("_q", F.col("_w") / (2 * F.col("_k") - 1)).drop("_w")
    placed = saved(numbered(more.withColumnsRenamed({c: f"_key_{c}" for c in order}), [*[F.col(c) for c in group], F.desc("_q"), *[F.col(f"_key_{c}") for c in order], F.col("_k")]))
    first = placed.groupBy(*group).agg(F.min("no").alias("_first")).join(left, group)
    won = placed.join(first, group).where("no - _first < _left").groupBy(*group, *[F.col(f"_key_{c}").alias(c) for c in order]).agg(F.count("*").alias("_won"))
    key = [*group, *order]
    quota = rows.join(won, key, "left").select(*key, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))
    return df.join(quota, key, "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("bigint"))


def running(df: DataFrame, group: str, no: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of the group before it in the order of no (0, 1, ...). Nodes of FAN numbers are
    added up first, so that windows hold FAN rows, or one row for FAN."""
    df = df.withColumn("_node", F.expr(f"{no} div {FAN}"))
    nodes = df.groupBy(group, "_node").agg(F.sum(value).alias("_s"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nodes = nodes.select(group, "_node", before(W.partitionBy(group).orderBy("_node"), "_s").alias("_before"))
    own = before(W.partitionBy(group, "_node").orderBy(no), value)
    return df.withColumn(name, own).join(nodes, [group, "_node"]).withColumn(name, F.col(name) + F.col("_before")).drop("_node", "_before")


def targets(sources: DataFrame, weights: list[int], most: int = MOST_EPOCHS) -> DataFrame:
    """sources: source, source_size, no. Adds weight (weights in turn by no) and target: the whole of all sizes shared by
    weight, no target above `most` times its source's size, the excess reshared by weight.

    This is target = min(most * size, weight * level). The level rises: sources that it fills stay full, and what they
    leave is shared among the others, until none is above its limit. One small aggregate a round."""
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    df = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights) + 1).cast("int")))
    total, level = df.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        full = F.col("weight") * F.lit(level) > cap
        r = df.agg(F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        now = (total - (r["full"] or 0.0)) / r["open"] if r["open"] else level
        if now <= level:
            break
        level = now
    return df.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights: list[int] | None = None, seed: int = 42, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words), source_size, target (its source's), taken (words the mix takes, repeats counted),
    one row per row of docs; the same rows on each run.

    Null texts have size 0. A null source is a source of its own, last in order. Repeated rows count each: they are one
    row with a number until the end. A document can be taken in part: its first words. Columns beyond the three aren't
    read."""
    weights = [1, 2, 3] if weights is None else weights
    each = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)).alias("at"))
    slim = saved(each.groupBy("doc_id", "source", "size", "at").agg(F.count("*").alias("rows")))
    sources = numbered(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n_docs")), [F.col("source").asc_nulls_last()])
    aim = saved(targets(sources, weights).withColumn("n_shards", F.greatest(F.ceil(F.col("n_docs") / SHARD_DOCS), F.lit(1))))
    goal = aim.agg(F.sum("target")).first()[0] or 0.0
    seats = F.lit(round(goal / block)).cast("bigint")
    quota = apportion(aim.select("no", "target").withColumn("seats", seats).withColumn("all", F.lit(0)), ["all"], "target", "seats", ["no"])
    aim = saved(aim.join(quota.select("no", F.col("quota").alias("source_quota")), "no"))
    placed = slim.alias("d").join(aim.alias("a"), F.expr("d.source <=> a.source")).select("d.*", "a.no", "a.source_size", "a.target", "a.source_quota", F.expr("pmod(d.at, a.n_shards)").alias("shard"))
    shards = placed.groupBy(F.col("no").alias("source_no"), "shard").agg(F.sum(F.col("size") * F.col("rows")).alias("n_words"), F.first("source_quota").alias("source_quota"), F.first("target").alias("target"))
    shards = saved(shards.withColumn("cap", F.ceil(MOST_EPOCHS * F.col("n_words") / block)))
    quotas = apportion(shards, ["source_no"], "n_words", "source_quota", ["shard"], "cap")
    quotas = saved(quotas.withColumn("given", F.least(F.col("quota") * block, MOST_EPOCHS * F.col("n_words"))))
    # What the blocks leave to the target, or are beyond it, is made up by the first shards that have room.
    rest = quotas.groupBy("source_no").agg((F.round(F.first("target")).cast("bigint") - F.sum("given")).alias("rest"))
    room = F.when(F.col("rest") >= 0, MOST_EPOCHS * F.col("n_words") - F.col("given")).otherwise(F.col("given"))
    filled = running(quotas.join(rest, "source_no").withColumn("room", room), "source_no", "shard", "room", "before")
    change = F.least(F.greatest(F.abs("rest") - F.col("before"), F.lit(0)), F.col("room")) * F.signum(F.col("rest").cast("double")).cast("bigint")
    quotas = saved(filled.select("source_no", F.col("shard").alias("of_shard"), (F.col("given") + change).alias("tokens")))
    own = W.partitionBy("no", "shard")
    line = own.orderBy(F.xxhash64("at"), "at", F.col("doc_id").asc_nulls_last(), "size")
    words = F.col("size") * F.col("rows")
    on_line = placed.withColumns({"start": F.sum(words).over(line.rowsBetween(W.unboundedPreceding, 0)) - words, "n": F.sum(words).over(own)})
    both = on_line.join(quotas, (F.col("no") == F.col("source_no")) & (F.col("shard") == F.col("of_shard")), "left")
    both = both.withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("rows") - 1).cast("int"))))
    epochs = F.when(F.col("n") > 0, F.expr("tokens div n")).otherwise(0)
    once_more = F.least(F.greatest(F.col("tokens") - epochs * F.col("n") - F.col("start") - F.col("copy") * F.col("size"), F.lit(0)), F.col("size"))
    return both.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + once_more).cast("bigint").alias("taken"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed by the weights 1, 2, 3 in turn."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
