"""Patient cohorts, pedigrees, targets, trials, benchmark scoring, and result tables of many sources."""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.functions.tables import stored
from omicspark.operators.blocks import expanded
from omicspark.operators.gwas import ranked


def co_occurrence(df: DataFrame, entity: str, item: str, least: int = 2) -> DataFrame:
    """Pairs of items that `least` entities or more have both. Different items of an entity first; the pairs are summed
    within each task before the shuffle."""
    one = df.select(entity, item).where(F.col(item).isNotNull()).distinct()
    a, b = one.alias("a"), one.alias("b")
    pairs = a.join(b, (F.col(f"a.{entity}") == F.col(f"b.{entity}")) & (F.col(f"a.{item}") < F.col(f"b.{item}")))
    n = pairs.groupBy(F.col(f"a.{item}").alias("item_1"), F.col(f"b.{item}").alias("item_2")).agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least)


def cohort_summary(df: DataFrame) -> DataFrame:
    """One row: patients and their ages."""
    p = df.groupBy("patient_id").agg(F.max("age").alias("age"))
    return p.agg(F.count("*").alias("n_patients"), F.min("age").alias("min_age"), F.max("age").alias("max_age"), F.round(F.avg("age"), 6).alias("mean_age"), F.percentile("age", F.lit(0.5)).alias("median_age"), F.count_if(F.col("age") < 18).alias("n_minors"), F.count_if(F.col("age") > 65).alias("n_seniors"))


def ancestors(pedigree: DataFrame, rounds: int = 64) -> DataFrame:
    """id, ancestor: all ancestors of each individual. The closure doubles its reach in each round (a path of two paths),
    so that the rounds grow with the logarithm of the depth, and ends when nothing is new. Each round is written out."""
    edges = pedigree.select("id", F.explode(F.array("father", "mother")).alias("ancestor")).where("ancestor is not null").distinct()
    if edges.sparkSession.sparkContext.getCheckpointDir() is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    reach = edges.checkpoint()
    n = reach.count()
    for _ in range(rounds):
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.ancestor").alias("ancestor"))
        reach = reach.union(longer).distinct().checkpoint()
        grown = reach.count()
        if grown == n:
            break
        n = grown
    return reach


def founders(pedigree: DataFrame) -> DataFrame:
    """id, n_founders: how many ancestors without parents each individual has.

    Only pairs with founders are made. Individuals are put in generations first (one after the last of their parents'), and
    each generation's different founders are handed to its children at once, so that a pair is made by its parents and
    never again. Individuals of a cycle, and their descendants, are in no generation; their pairs grow until none is new."""
    edges = stored(pedigree.where("id is not null").select("id", F.explode(F.array("father", "mother")).alias("parent")).where("parent is not null").distinct())
    first = stored(pedigree.where("father is null and mother is null and id is not null").select("id").distinct())
    # A parent of whom nothing is known is no founder, but it holds nobody up.
    open_ = edges.join(edges.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    needs = stored(open_.groupBy("id").agg(F.count("*").alias("needs")))
    level = stored(edges.select("id").distinct().join(needs, "id", "left_anti"))
    got, levels = None, []
    while not level.isEmpty():
        levels.append(level)
        told = open_.join(level.select(F.col("id").alias("parent")), "parent").select("id", F.lit(1).cast("bigint").alias("n"))
        got = stored((told if got is None else told.union(got)).groupBy("id").agg(F.sum("n").alias("n")).join(needs, "id"))
        level = got.where("n = needs").select("id")
        got = got.where("n < needs").select("id", "n")
    known = first.select("id", F.col("id").alias("ancestor"), F.lit(-1).alias("level"))
    numbered = levels[0].limit(0).withColumn("level", F.lit(0)) if levels else edges.select("id").limit(0).withColumn("level", F.lit(0))
    for i, x in enumerate(levels):
        numbered = numbered.union(x.select("id", F.lit(i)))
    # Edges carry the child's generation; those of no generation come last.
    own = stored(edges.join(numbered, "id", "left").withColumn("level", F.coalesce("level", F.lit(len(levels)))))
    handed, found = [stored(known.select("id", "ancestor").join(own.select(F.col("id").alias("child"), F.col("parent").alias("id"), "level"), "id").select(F.col("child").alias("id"), "ancestor", "level"))], []
    for i in range(len(levels)):
        now = reduce(DataFrame.union, [x.where(F.col("level") == i) for x in handed]).select("id", "ancestor").distinct()
        found.append(stored(now))
        later = own.where(F.col("level") > i).select(F.col("id").alias("child"), F.col("parent").alias("id"), "level")
        handed.append(stored(found[-1].join(later, "id").select(F.col("child").alias("id"), "ancestor", "level")))
    rest, new = None, stored(reduce(DataFrame.union, [x.where(F.col("level") == len(levels)) for x in handed]).select("id", "ancestor").distinct())
    cyclic = own.where(F.col("level") == len(levels)).select(F.col("id").alias("child"), F.col("parent").alias("id"))
    while not new.isEmpty():
        rest = new if rest is None else stored(rest.union(new))
        new = stored(new.join(cyclic, "id").select(F.col("child").alias("id"), "ancestor").distinct().join(rest, ["id", "ancestor"], "left_anti"))
    pairs = found + ([] if rest is None else [rest])
    return (reduce(DataFrame.union, pairs) if pairs else known.select("id", "ancestor").limit(0)).groupBy("id").agg(F.count("*").alias("n_founders"))


#: Rows of a constant list (gates, diseases) that is put into the plan at most.
MOST_CONSTANTS = 10_000


def _constants(df: DataFrame, columns: list[str]) -> list:
    rows = df.select(*columns).distinct().limit(MOST_CONSTANTS + 1).collect()
    if len(rows) > MOST_CONSTANTS:
        raise ValueError(f"a constant list of {MOST_CONSTANTS} rows at most is expected")
    return sorted(map(tuple, rows))


def gates_passed(traits: DataFrame, gates: DataFrame) -> DataFrame:
    """traits: id, trait, value. gates: skill, trait, least (a constant list). Per individual and skill: whether all gates
    are passed, and the traits that fall short or that the individual doesn't have."""
    listed = _constants(gates, ["skill", "trait", "least"])
    need = F.array(*[F.struct(F.lit(s).alias("skill"), F.lit(t).alias("trait"), F.lit(x).cast("double").alias("least")) for s, t, x in listed])
    own = traits.groupBy("id").agg(F.collect_list(F.when(F.col("trait").isin(*{t for _, t, _ in listed}), F.struct("trait", F.col("value").cast("double").alias("value")))).alias("own"))
    each = own.withColumn("g", F.explode(need))
    met = F.exists("own", lambda x: (x["trait"] == F.col("g")["trait"]) & (x["value"] >= F.col("g")["least"]))
    out = each.groupBy("id", "g.skill").agg(F.bool_and(met).alias("unlocked"), F.array_join(F.array_sort(F.collect_set(F.when(~met, F.col("g")["trait"]))), ",").alias("short"))
    return out.select("id", "skill", "unlocked", "short")


def disease_status(calls: DataFrame, needs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """calls: sample_id, variant_id, dosage. needs: disease, variant_id, need (alt/alt, alt/? or ref/ref; a constant list).
    Per sample (of calls, or of `samples`) and disease: whether all of its genotypes are there; a locus without a call
    isn't met, also where a sample has none of the disease's loci."""
    total = needs.groupBy("disease").agg(F.count("*").alias("n"))
    d, need = F.col("dosage"), F.col("need")
    met = ((need == "alt/alt") & (d == 2)) | ((need == "alt/?") & (d >= 1)) | ((need == "ref/ref") & (d == 0))
    df = calls.join(F.broadcast(needs), "variant_id").groupBy("sample_id", "disease").agg(F.count_if(met).alias("n_met"))
    affected = df.join(F.broadcast(total), "disease").where(F.col("n_met") == F.col("n")).select("sample_id", "disease", F.lit(True).alias("affected"))
    names = F.array(*[F.lit(x) for (x,) in _constants(needs, ["disease"])])
    every = (calls if samples is None else samples).select("sample_id").distinct().withColumn("disease", F.explode(names))
    return every.join(affected, ["sample_id", "disease"], "left").select("sample_id", "disease", F.coalesce("affected", F.lit(False)).alias("affected"))


#: Females that a round of disjoint_pairs() settles within a tie at most.
TIED = 1000


def disjoint_pairs(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """female, male, compatibility of the pairs that a greedy walk takes by falling score (then female, male) with no
    individual twice; the first `most` of them, or all.

    In rounds: a pair that is the best left of both its individuals is taken, since no walk can take anything else for
    them, and all pairs of either go. So that ties don't take a round for each pair, the first TIED females of the highest
    score left are walked in one task, each with her first TIED males (the other females can't take more than these).
    Rounds follow the longest chain of falling scores and the females of a tie, not the number of pairs."""
    key = F.struct((-F.col("compatibility")).alias("s"), "female", "male")
    left = stored(pairs.where("female is not null and male is not null and compatibility is not null").select("female", "male", "compatibility").distinct())
    taken = left.limit(0)

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("female", "ascending"), ("male", "ascending")])
        females, males, keep = set(), set(), []
        for i, (female, male) in enumerate(zip(rows.column("female").to_pylist(), rows.column("male").to_pylist(), strict=True)):
            if female not in females and male not in males:
                females.add(female)
                males.add(male)
                keep.append(i)
        return rows.take(pa.array(keep, pa.int64())).select(["female", "male", "compatibility"])

    while (top := left.agg(F.max("compatibility")).first()[0]) is not None:
        best = [left.groupBy(c).agg(F.min(key).alias("k")) for c in ("female", "male")]
        mutual = best[0].select("k").join(best[1].select("k"), "k").select("k.female", "k.male", (-F.col("k.s")).alias("compatibility"))
        tied = left.where(F.col("compatibility") == F.lit(top))
        first = tied.join(tied.select("female").distinct().orderBy("female").limit(TIED), "female")
        asked = first.withColumn("n", F.row_number().over(W.partitionBy("female").orderBy("male"))).where(F.col("n") <= TIED).drop("n")
        new = stored(mutual.union(asked.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(walk, left.schema)).distinct())
        taken = taken.union(new)
        left = stored(left.join(new.select("female"), "female", "left_anti").join(new.select("male"), "male", "left_anti").select("female", "male", "compatibility"))
    return taken if most is None else taken.orderBy(F.desc("compatibility"), "female", "male").limit(most)


#: Pairs of classes that a task of disjoint_members() knows at most, and members of a sex that it sees at once.
CLASS_PAIRS, WINDOW = 250_000, 2_000_000


def _by_class(members: DataFrame, name: str, rep: str) -> DataFrame:
    """id, rep, num (its place among all), pos (its place by class), c and last (its class's first and last pos)."""
    own = members.select(F.col(name).alias("id"), F.col(rep).alias("rep"))
    placed = stored(ranked(ranked(own, [F.col("id")], "num"), [F.col("rep"), F.col("id")], "pos"))
    return stored(placed.join(placed.groupBy("rep").agg(F.min("pos").alias("c"), F.max("pos").alias("last")), "rep"))


def _walked(rows: pa.Table) -> pa.Table:
    """The greedy walk over pairs of classes (kind 0: a, b, s) by their members in windows (kind 1 females, 2 males: a the
    class, b its pos, num, last): f_class, f_pos, m_class, m_pos, s of the pairs taken. A walk that needs a member beyond a
    window stops with a row of nulls.

    The members of a class that are taken are its first ones at any time, so that a class stands at its next member."""
    kind, a, b, num, last, s = (rows.column(c).to_numpy() for c in ("kind", "a", "b", "num", "last", "s"))
    queue: tuple[dict, dict] = ({}, {})
    for sex in (0, 1):
        own = np.flatnonzero(kind == sex + 1)
        own = own[np.argsort(b[own])]
        for part in np.split(own, np.flatnonzero(np.diff(a[own])) + 1) if len(own) else []:
            queue[sex][int(a[part[0]])] = (b[part].tolist(), num[part].tolist(), int(last[part[0]]))
    at, out = (dict.fromkeys(queue[0], 0), dict.fromkeys(queue[1], 0)), []

    def head(sex: int, c: int) -> int | None:
        """num of a class's next member; None: there is none, -1: it is beyond the window."""
        if c not in queue[sex]:
            return None
        pos, nums, end = queue[sex][c]
        return nums[at[sex][c]] if at[sex][c] < len(nums) else None if pos[-1] == end else -1

    def level(edges: np.ndarray) -> bool:
        """Walks the pairs of one score; False: it stopped."""
        males = defaultdict(list)
        for f, m in zip(a[edges].tolist(), b[edges].tolist(), strict=True):
            if (x := head(1, m)) is not None:
                males[f].append((x, m))
        waiting = [(x, f) for f in males if (x := head(0, f)) is not None]
        for heap in (*males.values(), waiting):
            heapq.heapify(heap)
        while waiting:
            x, f = waiting[0]
            own = males[f]
            # A male class only moves on, so that an old entry comes before its class's next member, never after it.
            while own and (y := head(1, own[0][1])) != own[0][0]:
                _, m = heapq.heappop(own)
                if y is not None:
                    heapq.heappush(own, (y, m))
            if not own:
                heapq.heappop(waiting)
                continue
            if x < 0 or own[0][0] < 0:
                return False
            m = own[0][1]
            out.append((f, queue[0][f][0][at[0][f]], m, queue[1][m][0][at[1][m]], score))
            at[0][f] += 1
            at[1][m] += 1
            heapq.heappop(waiting)
            if (x := head(0, f)) is not None:
                heapq.heappush(waiting, (x, f))
        return True

    edges = np.flatnonzero(kind == 0)
    edges = edges[np.argsort(-s[edges], kind="stable")]
    for part in np.split(edges, np.flatnonzero(np.diff(s[edges])) + 1) if len(edges) else []:
        score = float(s[part[0]])
        if not level(part):
            out.append((None,) * 5)
            break
    names, types = ("f_class", "f_pos", "m_class", "m_pos", "s"), (pa.int64(),) * 4 + (pa.float64(),)
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def disjoint_members(pairs: DataFrame, females: DataFrame, males: DataFrame) -> DataFrame:
    """disjoint_pairs() of the members of classes: pairs has f_rep, m_rep, compatibility of classes; females: female, f_rep;
    males: male, m_rep. The pairs of members are not made.

    The walk goes from one female to the next, so it is one task at a time; it knows the pairs of classes and sees WINDOW
    members of a sex, each class's next ones, and the next task goes on where it needs one beyond. Ranks, windows and the
    result are distributed. More than CLASS_PAIRS pairs of classes are expanded and go to disjoint_pairs()."""
    pairs = stored(pairs.where("compatibility is not null").select("f_rep", "m_rep", "compatibility"))
    if pairs.count() > CLASS_PAIRS:
        return disjoint_pairs(expanded(pairs, females, males))
    sexes = [_by_class(females, "female", "f_rep"), _by_class(males, "male", "m_rep")]
    one, other = (x.where("pos = c").select(F.col("rep").alias(rep), F.col("c").alias(c)) for x, rep, c in zip(sexes, ("f_rep", "m_rep"), "ab", strict=True))
    zero = F.lit(0).cast("bigint")
    edges = stored(pairs.join(one, "f_rep").join(other, "m_rep").select(F.lit(0).alias("kind"), "a", "b", zero.alias("num"), zero.alias("last"), F.col("compatibility").alias("s")))
    sizes = [max(1, WINDOW // max(1, x.where("pos = c").count())) for x in sexes]
    taken = None
    while True:
        rows = edges
        for sex, (x, size) in enumerate(zip(sexes, sizes, strict=True)):
            following = F.col("c")
            if taken is not None:
                done = taken.groupBy(F.col(("f_class", "m_class")[sex]).alias("c")).agg(F.max(("f_pos", "m_pos")[sex]).alias("done"))
                x, following = x.join(done, "c", "left"), F.coalesce(F.col("done") + 1, F.col("c"))
            rows = rows.union(x.where((F.col("pos") >= following) & (F.col("pos") < following + size)).select(F.lit(sex + 1), "c", "pos", "num", "last", F.lit(0.0)))
        new = stored(rows.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(_walked, "f_class bigint, f_pos bigint, m_class bigint, m_pos bigint, s double"))
        taken = new.where("f_pos is not null") if taken is None else taken.union(new.where("f_pos is not null"))
        if new.where("f_pos is null").isEmpty():
            break
    female, male = (x.select(F.col("pos").alias(pos), F.col("id").alias(name)) for x, pos, name in zip(sexes, ("f_pos", "m_pos"), ("female", "male"), strict=True))
    return taken.join(female, "f_pos").join(male, "m_pos").select("female", "male", F.col("s").alias("compatibility"))


def target_score(ev: DataFrame) -> DataFrame:
    """Five sub-scores of at most 20, their sum less the penalty, and the decision. The limits and points below are fixed
    values."""

    def steps(c: Column, levels: list[tuple[float, int]]) -> Column:
        out = F.lit(0)
        for above, points in reversed(levels):
            out = F.when(c > above, points).otherwise(out)
        return out

    known = F.lower("target_class").isin("kinase", "gpcr", "nuclear receptor", "protease", "ion channel")
    parts = {
        "disease": F.when(F.col("association") >= 0.7, 20).when(F.col("association") >= 0.4, 10).otherwise(0),
        "druggability": F.least(F.lit(20), F.when(known, 10).when(F.coalesce("target_class", F.lit("")) != "", 5).otherwise(0) + steps(F.col("n_ligands"), [(500, 6), (100, 5), (10, 3), (0, 1)])),
        "chemistry": F.least(F.lit(20), steps(F.col("n_compounds"), [(500, 8), (100, 6), (10, 3), (0, 1)]) + steps(F.col("n_potent"), [(50, 7), (10, 5), (0, 3)])),
        "clinical": F.when(F.col("max_phase") >= 1, 20).when(F.col("n_trials") > 0, 10).otherwise(0),
        "structure": F.when((F.col("n_pdb") > 0) & F.col("cocrystal") & (F.coalesce("resolution", F.lit(99.0)) < 2.5), 20).when((F.col("n_pdb") > 0) | F.col("alphafold"), 10).otherwise(0),
    }
    df = ev.withColumns(parts).withColumn("score", sum((F.col(c) for c in parts), F.lit(0)) + F.col("penalty"))
    decision = F.when(F.col("score") >= 75, "GO").when(F.col("score") >= 50, "CONDITIONAL_GO").when(F.col("score") >= 25, "REVIEW").otherwise("NO_GO")
    return df.withColumn("decision", decision)


def score_against_truth(found: DataFrame, truth: DataFrame) -> DataFrame:
    """found: run, gene. truth: gene, tier (null for a negative). Per run: true and false positives, misses, unknown
    genes, precision, recall and F1. Counts come from joins with the truth, without driver loops."""
    known = found.distinct().join(truth, "gene", "left").withColumn("known", F.col("is_truth").isNotNull())
    n_truth = truth.where("tier is not null").count()
    df = known.groupBy("run").agg(F.count_if(F.col("tier").isNotNull()).alias("tp"), F.count_if(F.col("known") & F.col("tier").isNull()).alias("fp"), F.count_if(~F.col("known")).alias("unknown"), F.coalesce(F.sum(F.expr("1.0D / tier")), F.lit(0.0)).alias("weighted")).withColumn("n_truth", F.lit(n_truth))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("n_truth"))
    return df.select("run", "tp", "fp", (F.col("n_truth") - F.col("tp")).alias("fn"), "unknown", F.round("weighted", 6).alias("weighted"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def first_by_order(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: the least by order, as a partial aggregate and not a window."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def latest_versions(tools: DataFrame) -> DataFrame:
    """tools: tool, version (dotted numbers). The latest version of each and how many there are."""
    parts = F.transform(F.split("version", r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return tools.groupBy("tool").agg(F.max_by("version", F.struct(parts, "version")).alias("latest"), F.countDistinct("version").alias("n_versions"))


def weighted_median_size(hist: DataFrame) -> DataFrame:
    """hist: sample, size, n. The first size at which the counts reach (total + 1) / 2, the mean and deviation."""
    w = W.partitionBy("sample")
    df = hist.withColumns({"upto": F.sum("n").over(w.orderBy("size")), "total": F.sum("n").over(w)})
    return df.groupBy("sample").agg(F.min(F.when(F.col("upto") >= (F.col("total") + 1) / 2, F.col("size"))).alias("median"), F.round(F.sum(F.col("n") * F.col("size")) / F.sum("n"), 6).alias("mean"))


def n50(lengths: DataFrame) -> DataFrame:
    """assembly, length. The first length, from the longest down, at which the sum reaches half of all."""
    w = W.partitionBy("assembly")
    by_length = lengths.groupBy("assembly", "length").agg(F.count("*").alias("c"))
    df = by_length.withColumns({"upto": F.sum(F.col("c") * F.col("length")).over(w.orderBy(F.col("length").desc())), "total": F.sum(F.col("c") * F.col("length")).over(w)})
    return df.where(F.col("upto") >= F.col("total") / 2).groupBy("assembly").agg(F.max("length").alias("n50"))


def fitness(rounds: DataFrame) -> DataFrame:
    """rounds: generation, agent, skills (array). novelty: the share of the others of its generation with another set of
    skills (0.5 for one alone); chaining: 0, 0.2, 0.6, 0.8 or 1 for none, one, two, three, more."""
    df = rounds.withColumn("set", F.array_join(F.array_sort(F.array_distinct("skills")), ","))
    g, s = W.partitionBy("generation"), W.partitionBy("generation", "set")
    n, same = F.count("*").over(g), F.count("*").over(s)
    novelty = F.when(n <= 1, 0.5).otherwise(1 - (same - 1) / (n - 1))
    k = F.size(F.array_distinct("skills"))
    chaining = F.when(k == 0, 0.0).when(k == 1, 0.2).when(k == 2, 0.6).when(k == 3, 0.8).otherwise(1.0)
    return df.select("generation", "agent", F.round(novelty, 6).alias("novelty"), chaining.alias("chaining"))


#: The parts of an agent's fitness.
FITNESS_WEIGHTS = {"utilization": 0.30, "quality": 0.30, "novelty": 0.20, "chaining": 0.20}


def composite_fitness(rounds: DataFrame) -> DataFrame:
    """rounds: generation, agent, skills (array, used), relevant (array, of the available ones that suit the task), quality (0
    to 1; null as 0). fitness() with utilization (the used share of the relevant skills; 0.5 without any) and the weighted
    composite."""
    own = rounds.select("generation", "agent", F.array_distinct(F.coalesce("skills", F.array().cast("array<string>"))).alias("s"), F.array_distinct(F.coalesce("relevant", F.array().cast("array<string>"))).alias("r"), F.coalesce("quality", F.lit(0.0)).alias("quality"))
    used = F.when(F.size("r") == 0, 0.5).otherwise(F.size(F.array_intersect("s", "r")) / F.size("r"))
    df = fitness(own.select("generation", "agent", F.col("s").alias("skills"))).join(own.select("generation", "agent", used.alias("utilization"), "quality"), ["generation", "agent"])
    total = sum(w * F.col(c) for c, w in FITNESS_WEIGHTS.items())
    return df.select("generation", "agent", *[F.round(c, 4).alias(c) for c in FITNESS_WEIGHTS], F.round(total, 4).alias("composite"))


def generation_fitness(scores: DataFrame) -> DataFrame:
    """Per generation of composite_fitness(): population, mean, deviation (of the population), least and most of the
    composite, and the means of its parts."""
    c = F.col("composite")
    return scores.groupBy("generation").agg(F.count("*").alias("population"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.min(c).alias("least"), F.max(c).alias("most"), *[F.avg(x).alias(f"mean_{x}") for x in FITNESS_WEIGHTS])
