"""GWAS post-processing, fine-mapping weights and Mendelian randomisation over long tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.functions.stats import chi2_sf, two_sided_p
from omicspark.functions.tables import stored

#: Genome-wide and suggestive significance, the median of chi-squared with one degree of freedom.
SIGNIFICANT, SUGGESTIVE, CHI2_MEDIAN = 5e-8, 1e-5, 0.4549364


def in_ranges(df: DataFrame, order: list[Column], slices: int = 64) -> DataFrame:
    """df dealt by ranges of the order, with _part, the number of a row's range. Written to the checkpoint folder, so that
    every later use sees the same ranges."""
    return stored(df.repartitionByRange(slices, *order).withColumn("_part", F.spark_partition_id()))


def ranked(df: DataFrame, order: list[Column], name: str = "rank", slices: int = 64, keep_part: bool = False) -> DataFrame:
    """df with the 1-based place of each row in one global order, without a single-task window: rows go to ranges, each
    range is numbered by itself, and the sizes of the ranges before are added (one row per range)."""
    dealt = in_ranges(df, order, slices)
    numbered = dealt.withColumn(name, F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop(*(["_before"] if keep_part else ["_part", "_before"]))


def lambda_gc(stats: DataFrame, group: str) -> DataFrame:
    """Inflation by group: element n // 2 (from 0) of the sorted positive chi-squared values over the median. Equal values
    are counted first, so that a window holds different values only."""
    values = stats.where("chisq > 0").groupBy(group, "chisq").agg(F.count("*").alias("c"))
    w = W.partitionBy(group)
    upto = values.withColumns({"upto": F.sum("c").over(w.orderBy("chisq")), "n": F.sum("c").over(w)})
    at = F.floor(F.col("n") / 2)
    hit = upto.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at))
    return hit.select(group, "n", F.round(F.col("chisq") / CHI2_MEDIAN, 6).alias("lambda_gc"))


def association(pairs: DataFrame) -> DataFrame:
    """pairs: variant_id, x (dosage), y (phenotype). Least-squares slope, its standard error, z and p per variant, from
    sums that are combined before the shuffle. Variants without spread in x are left out."""
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    sums = pairs.where("x is not null and y is not null").groupBy("variant_id").agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    df = sums.withColumns({"vx": F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), "vxy": F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), "vy": F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")}).where("vx > 1e-9 and n > 2")
    df = df.withColumn("beta", F.col("vxy") / F.col("vx"))
    df = df.withColumn("se", F.sqrt(F.greatest(F.col("vy") - F.col("beta") * F.col("vxy"), F.lit(0.0)) / (F.col("n") - 2) / F.col("vx")))
    df = df.withColumn("z", F.try_divide("beta", "se"))
    return df.select("variant_id", "n", "beta", "se", "z", two_sided_p(F.col("z")).alias("p"))


def merged_associations(gwas: DataFrame, phewas: DataFrame, eqtl: DataFrame) -> DataFrame:
    """Three sources (trait, mantissa, exponent, and columns of their own) in one table, p = mantissa * 10 ** exponent,
    with the significance flag."""
    tagged = [df.withColumn("origin", F.lit(name)) for name, df in (("gwas", gwas), ("phewas", phewas), ("eqtl", eqtl))]
    df = tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)
    return df.withColumn("p", F.col("mantissa") * F.pow(F.lit(10.0), F.col("exponent"))).withColumn("significant", F.coalesce(F.col("p") < SIGNIFICANT, F.lit(False)))


def best_p_per_trait(df: DataFrame, below: float = SIGNIFICANT) -> DataFrame:
    return df.where(F.col("p") < below).groupBy(F.lower("trait").alias("trait")).agg(F.min("p").alias("best_p"), F.count("*").alias("n"))


#: Words that make a trait a measurement.
MEASUREMENTS = ["measurement", "level", "amount", "ratio", "concentration"]


def leading_traits(df: DataFrame, most: int, below: float = SIGNIFICANT, group: list[str] | None = None) -> DataFrame:
    """best_p_per_trait() of each group (or of all), the first `most` traits: diseases before measurements, then by p, then
    by name. Traits without a name are left out."""
    by = group or []
    named = df.withColumn("trait", F.lower(F.trim("trait"))).where((F.col("trait") != "") & (F.col("p") < below))
    best = named.groupBy(*by, "trait").agg(F.min("p").alias("best_p"), F.count("*").alias("n"))
    best = best.withColumn("measurement", F.greatest(*[F.contains("trait", F.lit(w)) for w in MEASUREMENTS]))
    keys = [F.col("measurement"), F.col("best_p"), F.col("trait")]
    if not by:
        return best.orderBy(*keys).limit(most)
    return best.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*keys))).where(F.col("rank") <= most)


def chromosome_rank(chrom: Column) -> Column:
    """1..22, then X, Y, then all others (99); chromosomes can be numbers or text."""
    c = chrom.cast("string")
    number = c.try_cast("int")
    return F.when(number.between(1, 22), number).when(c == "X", 23).when(c == "Y", 24).otherwise(99)


def significance_levels(stats: DataFrame, p: str = "p") -> DataFrame:
    """The rows below the suggestive threshold, with level genome_wide or suggestive; a null p has no level."""
    return stats.where(F.col(p) < SUGGESTIVE).withColumn("level", F.when(F.col(p) < SIGNIFICANT, "genome_wide").otherwise("suggestive"))


def genome_offsets(stats: DataFrame) -> DataFrame:
    """Adds genome_pos: the position past the largest ones of all chromosomes before, in the order 1..22, X, Y, others by
    name. One row per chromosome is ordered."""
    ends = stats.groupBy("chrom").agg(F.max("pos").alias("last"))
    order = W.orderBy(chromosome_rank(F.col("chrom")), "chrom").rowsBetween(W.unboundedPreceding, -1)
    before = ends.select("chrom", F.coalesce(F.sum("last").over(order), F.lit(0)).alias("offset"))
    return stats.join(F.broadcast(before), "chrom").withColumn("genome_pos", F.col("pos") + F.col("offset")).drop("offset")


def element_at_rank(df: DataFrame, value: str, ranks: list[int], slices: int = 64) -> list:
    """The values at the given places (from 0) of the ascending order of all rows' values, as a list on the driver: equal
    values are counted, the counts go to ranges, and only the ranges that hold a place are looked into."""
    by_value = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    dealt = in_ranges(by_value, [F.col(value).asc()], slices)
    out, before = {}, 0
    for part, n in sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.sum("_c").alias("n")).collect()):
        for k in ranks:
            if before <= k < before + n:
                upto = F.sum("_c").over(W.partitionBy("_part").orderBy(value)) + before
                out[k] = dealt.where(F.col("_part") == part).withColumn("_u", upto).where(F.col("_u") > k).agg(F.min(value).alias("v")).first()["v"]
        before += n
    return [out.get(k) for k in ranks]


def qq_table(stats: DataFrame, log10p: str = "log10p") -> DataFrame:
    """rank, expected and observed -log10 p, by falling observed value."""
    n = stats.count()
    df = ranked(stats, [F.col(log10p).desc(), F.col("variant_id")])
    return df.select("variant_id", "rank", F.round(-F.log10((F.col("rank") - 0.5) / F.lit(n)), 6).alias("expected"), F.round(log10p, 6).alias("observed"))


def abf(stats: DataFrame, prior: float = 0.04, group: str = "locus") -> DataFrame:
    """Approximate Bayes factors and inclusion probabilities by locus. The variance is se**2 if all of a locus have se,
    else 1 / n if any has n, else 1e-4."""
    w = W.partitionBy(group)
    df = stats.withColumns({"_all_se": F.count("se").over(w) == F.count("*").over(w), "_any_n": F.count("n").over(w) > 0})
    v = F.when(F.col("_all_se"), F.col("se") * F.col("se")).when(F.col("_any_n"), F.coalesce(1.0 / F.col("n"), F.lit(1e-4))).otherwise(F.lit(1e-4))
    r = F.lit(prior) / (F.lit(prior) + v)
    df = df.withColumn("log_abf", 0.5 * F.log(1 - r) + 0.5 * r * F.col("z") * F.col("z"))
    df = df.withColumn("_e", F.exp(F.col("log_abf") - F.max("log_abf").over(w)))
    return df.withColumn("pip", F.col("_e") / F.sum("_e").over(w)).drop("_e", "_all_se", "_any_n")


def credible_sets(pips: DataFrame, coverage: float = 0.95, group: str = "locus") -> DataFrame:
    """The fewest variants of each locus, by falling pip, that reach the coverage."""
    w = W.partitionBy(group).orderBy(F.round("pip", 12).desc(), "variant_id")
    df = pips.withColumns({"_before": F.coalesce(F.sum("pip").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "rank": F.row_number().over(w)})
    return df.where(F.col("_before") < coverage).drop("_before")


def _moments(inst: DataFrame, keys: list[str]) -> DataFrame:
    w = 1 / (F.col("se_outcome") * F.col("se_outcome"))
    x, y = F.col("beta_exposure"), F.col("beta_outcome")
    return inst.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.sum(w * y * y).alias("wyy"))


def _ivw(df: DataFrame) -> DataFrame:
    df = df.withColumn("estimate", F.try_divide("wxy", "wxx"))
    df = df.withColumn("q", F.greatest(F.col("wyy") - 2 * F.col("estimate") * F.col("wxy") + F.col("estimate") * F.col("estimate") * F.col("wxx"), F.lit(0.0)))
    phi = F.greatest(F.lit(1.0), F.try_divide(F.col("q"), F.col("n") - 1))
    return df.withColumn("se", F.sqrt(phi / F.col("wxx")))


def ivw(inst: DataFrame) -> DataFrame:
    """Inverse-variance weighted estimate of each pair, with random-effects scale not below 1."""
    df = _ivw(_moments(inst, ["pair_id"]).where("n > 1"))
    return df.select("pair_id", "n", "estimate", "se", (F.col("estimate") - 1.96 * F.col("se")).alias("ci_lower"), (F.col("estimate") + 1.96 * F.col("se")).alias("ci_upper"), two_sided_p(F.col("estimate") / F.col("se")).alias("p"), "q", chi2_sf(F.col("q"), F.col("n") - 1).alias("q_p"))


def egger(inst: DataFrame) -> DataFrame:
    """Slope and intercept of the weighted regression with intercept, for pairs of three instruments or more."""
    df = _moments(inst, ["pair_id"]).where("n > 2").withColumn("denom", F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")).where("abs(denom) > 1e-12")
    df = df.withColumn("slope", (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / F.col("denom"))
    df = df.withColumn("intercept", (F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w"))
    rss = F.col("wyy") - F.col("intercept") * F.col("wy") - F.col("slope") * F.col("wxy")
    phi = F.greatest(F.lit(1.0), rss / (F.col("n") - 2))
    df = df.withColumns({"slope_se": F.sqrt(phi * F.col("w") / F.col("denom")), "intercept_se": F.sqrt(phi * F.col("wxx") / F.col("denom"))})
    return df.select("pair_id", "n", "slope", "slope_se", "intercept", "intercept_se", two_sided_p(F.col("slope") / F.col("slope_se")).alias("slope_p"), two_sided_p(F.col("intercept") / F.col("intercept_se")).alias("intercept_p"))


def sensitivity(inst: DataFrame, weak: float = 10) -> DataFrame:
    """Per pair: mean and least F, weak instruments, I2 of the exposure, Steiger direction with its z and p."""
    w = 1 / (F.col("se_exposure") * F.col("se_exposure"))
    x, y, f = F.col("beta_exposure"), F.col("beta_outcome"), 2 * F.col("eaf") * (1 - F.col("eaf"))
    df = inst.groupBy("pair_id").agg(F.count("*").alias("n"), F.avg("f_statistic").alias("mean_f"), F.min("f_statistic").alias("min_f"), F.count_if(F.col("f_statistic") < weak).alias("n_weak"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.sum(f * x * x).alias("r2_exposure"), F.sum(f * y * y).alias("r2_outcome"))
    q = F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")
    total = F.col("r2_exposure") + F.col("r2_outcome")
    steiger = F.when(total > 0, (F.col("r2_exposure") - F.col("r2_outcome")) / (F.sqrt(total) * 0.01)).otherwise(0.0)
    i2 = F.when((q <= F.col("n") - 1) | (F.col("n") == 1), 0.0).otherwise((q - (F.col("n") - 1)) / q)
    return df.select("pair_id", "n", F.round("mean_f", 4).alias("mean_f"), F.round("min_f", 4).alias("min_f"), "n_weak", F.round(i2, 4).alias("i2_gx"), (F.col("r2_exposure") > F.col("r2_outcome")).alias("correct_direction"), F.round(steiger, 6).alias("steiger_z"), two_sided_p(steiger).alias("steiger_p"))


def leave_one_out(inst: DataFrame) -> DataFrame:
    """The IVW estimate of each pair without each of its instruments: totals less the instrument's own terms."""
    own = W.partitionBy("pair_id")
    w = 1 / (F.col("se_outcome") * F.col("se_outcome"))
    x, y = F.col("beta_exposure"), F.col("beta_outcome")
    terms = {"wxx": w * x * x, "wxy": w * x * y, "wyy": w * y * y}
    df = inst.withColumns(terms).withColumns({"n": F.count("*").over(own) - 1, **{f"_{k}": F.sum(k).over(own) - F.col(k) for k in terms}})
    df = df.where("n >= 2").select("pair_id", "snp", "n", *[F.col(f"_{k}").alias(k) for k in terms])
    return _ivw(df).select("pair_id", "snp", "n", "estimate", "se")


def weighted_median(inst: DataFrame) -> DataFrame:
    """The first ratio, by size, at which the weights reach half."""
    own = W.partitionBy("pair_id")
    ratio, weight = F.col("beta_outcome") / F.col("beta_exposure"), F.pow(F.col("beta_exposure") / F.col("se_outcome"), F.lit(2))
    df = inst.where("beta_exposure <> 0").select("pair_id", "snp", F.round(ratio, 9).alias("ratio"), weight.alias("wt"))
    df = df.withColumn("upto", F.sum("wt").over(own.orderBy("ratio", "snp")) / F.sum("wt").over(own))
    return df.where(F.round("upto", 9) >= 0.5).groupBy("pair_id").agg(F.min_by("ratio", F.struct("ratio", "snp")).alias("estimate"))


def weighted_median_test(inst: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """pair_id, n, estimate (the first ratio, by size, at which the weights reach half), se (of `draws` parametric bootstrap
    draws of the outcomes), ci_lower, ci_upper and p. Instruments with a null number or no effect on the exposure are left
    out; without spread p is 1.

    A pair's draws come from a generator of its own, seeded by the seed and the pair, over its instruments in the order of
    their names, so that they don't depend on the partitioning; all draws are one matrix, worked in parts of a few million
    numbers."""
    pair_type = dict(inst.dtypes)["pair_id"]
    known = inst.where("beta_exposure <> 0 and beta_outcome is not null and se_outcome is not null and pair_id is not null")
    slim = known.select("pair_id", F.col("snp").cast("string").alias("snp"), "beta_exposure", "beta_outcome", "se_outcome", F.xxhash64(F.lit(seed), F.col("pair_id").cast("string")).alias("seed"))

    def resample(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["snp", "beta_exposure", "beta_outcome"])
        x, y, s = (own[c].to_numpy(float) for c in ("beta_exposure", "beta_outcome", "se_outcome"))
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = (x / s) ** 2
            weight = weight / weight.sum()
        rng = np.random.default_rng(int(own["seed"].iloc[0]) & ((1 << 63) - 1))

        def medians(outcomes: np.ndarray) -> np.ndarray:
            ratio = outcomes / x
            order = np.argsort(ratio, axis=1, kind="stable")
            reached = np.cumsum(weight[order], axis=1) >= 0.5
            at = np.where(reached.any(axis=1), reached.argmax(axis=1), len(x) - 1)
            rows = np.arange(len(outcomes))
            return ratio[rows, order[rows, at]]

        step = max(1, (1 << 21) // len(x))
        found = np.concatenate([medians(y + rng.standard_normal((min(step, draws - i), len(x))) * s) for i in range(0, draws, step)])
        return pd.DataFrame({"pair_id": own["pair_id"].iloc[:1], "n": [len(x)], "estimate": medians(y[None, :]), "se": [found.std()]})

    df = slim.groupBy("pair_id").applyInPandas(resample, f"pair_id {pair_type}, n bigint, estimate double, se double")
    p = two_sided_p(F.when(F.col("se") > 0, F.col("estimate") / F.col("se")).otherwise(0.0))
    return df.select("pair_id", "n", "estimate", "se", (F.col("estimate") - 1.96 * F.col("se")).alias("ci_lower"), (F.col("estimate") + 1.96 * F.col("se")).alias("ci_upper"), p.alias("p"))


def weighted_mode(inst: DataFrame, bandwidth: float = 0.5, points: int = 1000) -> DataFrame:
    """The grid point of the highest weighted kernel density of the ratios; the grid goes from 1 below the least ratio to
    1 above the largest. Each pair's instruments meet its own grid only."""
    df = inst.where("beta_exposure <> 0").select("pair_id", (F.col("beta_outcome") / F.col("beta_exposure")).alias("r"), (F.abs("beta_exposure") / F.col("se_outcome")).alias("wt"))
    ends = df.groupBy("pair_id").agg((F.min("r") - 1).alias("lo"), (F.max("r") + 1).alias("hi"))
    grid = ends.select("pair_id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col("r")) / bandwidth
    dens = grid.join(df, "pair_id").groupBy("pair_id", "i", "x").agg(F.round(F.sum(F.col("wt") * F.exp(-0.5 * z * z)), 9).alias("density"))
    return dens.groupBy("pair_id").agg(F.max_by("x", F.struct("density", -F.col("i"))).alias("estimate"))


def instrument_flags(inst: DataFrame) -> DataFrame:
    pair = F.concat("effect_allele", "other_allele")
    return inst.select("pair_id", "snp", pair.isin("AT", "TA", "CG", "GC").alias("palindromic"), F.col("eaf").between(0.42, 0.58).alias("ambiguous_eaf"), (F.col("f_statistic") < 10).alias("weak"))
