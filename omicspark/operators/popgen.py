"""Population genetics over long dosages (sample_id, variant_id, population, dosage 0/1/2 or null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.operators.solvers import hwe_p

# Shares of the superpopulations, and weights of the score's parts.
GLOBAL_SHARES = {"AFR": 0.17, "AMR": 0.13, "EAS": 0.22, "EUR": 0.16, "SAS": 0.26, "OCE": 0.005, "MID": 0.06}
SCORE_WEIGHTS = (0.35, 0.25, 0.20, 0.20)
BANDS = [(80, "Excellent"), (60, "Good"), (40, "Fair"), (20, "Poor")]


def site_counts(dosages: DataFrame) -> DataFrame:
    """population, variant_id, n_called, alt_sum, n_het: the one shuffle over the calls, with partial sums."""
    return dosages.groupBy("population", "variant_id").agg(F.count("dosage").alias("n_called"), F.coalesce(F.sum("dosage"), F.lit(0)).alias("alt_sum"), F.count_if(F.col("dosage") == 1).alias("n_het"))


def _af() -> Column:
    return F.try_divide(F.col("alt_sum"), 2 * F.col("n_called"))


def allele_frequencies(dosages: DataFrame) -> DataFrame:
    """Frequency of the alternative allele; null at sites without calls."""
    return site_counts(dosages).select("population", "variant_id", "n_called", F.round(_af(), 6).alias("af"))


def heterozygosity(dosages: DataFrame) -> DataFrame:
    """Mean observed and expected heterozygosity of each population over its sites with calls."""
    af = _af()
    sites = site_counts(dosages).where("n_called > 0").select("population", (F.col("n_het") / F.col("n_called")).alias("obs"), (2 * af * (1 - af)).alias("exp"))
    return sites.groupBy("population").agg(F.count("*").alias("n_sites"), F.round(F.avg("obs"), 6).alias("observed_het"), F.round(F.avg("exp"), 6).alias("expected_het"))


def population_sizes(dosages: DataFrame) -> DataFrame:
    return dosages.groupBy("population").agg(F.countDistinct("sample_id").alias("n"))


def pairwise_fst(dosages: DataFrame, least_ht: float = 0.001) -> DataFrame:
    """FST of each pair of populations: the ratio of sums over sites of HT - HS to HT, weighted by population size, at
    sites with HT above least_ht; not below 0, null without sites. The frequencies are joined by variant, so that the
    pairs grow with the sites and not with the calls."""
    af = site_counts(dosages).where("n_called > 0").select("population", "variant_id", _af().alias("p")).join(F.broadcast(population_sizes(dosages)), "population")
    a, b = af.alias("a"), af.alias("b")
    both = a.join(b, (F.col("a.variant_id") == F.col("b.variant_id")) & (F.col("a.population") < F.col("b.population")))
    n = F.col("a.n") + F.col("b.n")
    mean = (F.col("a.n") * F.col("a.p") + F.col("b.n") * F.col("b.p")) / n
    ht = 2 * mean * (1 - mean)
    hs = (F.col("a.n") * 2 * F.col("a.p") * (1 - F.col("a.p")) + F.col("b.n") * 2 * F.col("b.p") * (1 - F.col("b.p"))) / n
    pairs = both.select(F.col("a.population").alias("population_1"), F.col("b.population").alias("population_2"), ht.alias("ht"), (ht - hs).alias("d"))
    used = F.col("ht") > least_ht
    sums = pairs.groupBy("population_1", "population_2").agg(F.count_if(used).alias("n_sites"), F.try_divide(F.sum(F.when(used, F.col("d"))), F.sum(F.when(used, F.col("ht")))).alias("fst"))
    return sums.select("population_1", "population_2", "n_sites", F.round(F.greatest(F.col("fst"), F.lit(0.0)), 6).alias("fst"))


def representation(sizes: DataFrame) -> DataFrame:
    """One row: representation_index (1 less the largest deviation from the global shares; null if more than half of
    the samples are UNKNOWN) and unknown_fraction, of population, n."""
    total = F.sum("n")
    share = {p: F.coalesce(F.sum(F.when(F.col("population") == p, F.col("n"))), F.lit(0)) / total for p in GLOBAL_SHARES}
    off = F.greatest(*[F.abs(share[p] - F.lit(s)) for p, s in GLOBAL_SHARES.items()])
    unknown = F.coalesce(F.sum(F.when(F.col("population") == "UNKNOWN", F.col("n"))), F.lit(0)) / total
    return sizes.agg(F.when(unknown <= 0.5, F.greatest(F.lit(0.0), 1 - off)).alias("representation_index"), unknown.alias("unknown_fraction"), total.alias("n_samples"), F.count("*").alias("n_populations"), (F.count_if(F.upper("population").isin(list(GLOBAL_SHARES))) / 7).alias("geographic_spread"))


#: Heterozygosity by population where there are no genotypes, and for any other population.
LITERATURE_HET = {"AFR": 0.35, "AMR": 0.28, "EAS": 0.25, "EUR": 0.27, "SAS": 0.26, "OCE": 0.30, "MID": 0.28, "UNKNOWN": 0.25}
OTHER_HET = 0.25


def _composite(sizes: DataFrame, het: DataFrame, fst: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """The equity score of population sizes, a row with h (mean heterozygosity) and one with n_fst."""
    if min(weights) < 0:
        raise ValueError(f"weights must not be negative: {weights}")
    if not sum(weights):
        raise ValueError("weights must not all be zero")
    w = [x / sum(weights) for x in weights]
    # Three one-row results.
    df = representation(sizes).join(F.broadcast(het)).join(F.broadcast(fst))
    df = df.withColumn("heterozygosity_balance", F.least(F.lit(1.0), F.coalesce("h", F.lit(0.0)) / 0.5))
    possible = F.col("n_populations") * (F.col("n_populations") - 1) / 2
    df = df.withColumn("fst_coverage", F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("n_fst"), possible)), F.lit(0.0)))
    score = 100 * (w[0] * F.coalesce("representation_index", F.lit(0.0)) + w[1] * F.col("heterozygosity_balance") + w[2] * F.col("fst_coverage") + w[3] * F.col("geographic_spread"))
    df = df.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1))
    rating = F.lit("Critical")
    for least, label in reversed(BANDS):
        rating = F.when(F.col("score") >= least, label).otherwise(rating)
    return df.select("score", rating.alias("rating"), *[F.round(c, 3).alias(c) for c in ("representation_index", "heterozygosity_balance", "fst_coverage", "geographic_spread", "unknown_fraction")], "n_samples", "n_populations")


def equity_score(dosages: DataFrame, weights: tuple[float, ...] = SCORE_WEIGHTS) -> DataFrame:
    """One row: the composite score from 0 to 100, its parts and rating. Weights are scaled to a sum of 1; negative or
    all-zero ones are errors."""
    het = heterozygosity(dosages).agg(F.avg("observed_het").alias("h"))
    fst = pairwise_fst(dosages).agg(F.count("fst").alias("n_fst"))
    return _composite(population_sizes(dosages), het, fst, weights)


def equity_score_of_counts(samples: DataFrame, weights: tuple[float, ...] = SCORE_WEIGHTS) -> DataFrame:
    """equity_score() of samples (sample_id, population) without genotypes: heterozygosity is that of the literature (the mean
    over the populations there are), and no pair of populations is compared."""
    sizes = population_sizes(samples)
    known = F.coalesce(*[F.when(F.upper("population") == p, h) for p, h in LITERATURE_HET.items()], F.lit(OTHER_HET))
    return _composite(sizes, sizes.agg(F.avg(known).alias("h")), sizes.agg(F.lit(0).alias("n_fst")), weights)


def qc_stats(calls: DataFrame) -> DataFrame:
    """calls: sample_id, ref, alt, genotype (bases). Per sample: SNPs, indels, transitions, transversions, het, hom-alt,
    and their ratios."""
    snp = (F.length("ref") == 1) & (F.length("alt") == 1)
    called = F.col("genotype").isNotNull() & F.col("genotype").contains(F.col("alt"))
    ti = F.concat("ref", "alt").isin("AG", "GA", "CT", "TC")
    het = F.substring("genotype", 1, 1) != F.substring("genotype", 2, 1)
    out = calls.where(called).groupBy("sample_id").agg(F.count_if(snp).alias("n_snp"), F.count_if(~snp).alias("n_indel"), F.count_if(snp & ti).alias("n_ti"), F.count_if(snp & ~ti).alias("n_tv"), F.count_if(het).alias("n_het"), F.count_if(~het).alias("n_hom_alt"))
    return out.select("*", F.round(F.try_divide("n_ti", "n_tv"), 6).alias("ti_tv"), F.round(F.try_divide("n_het", "n_hom_alt"), 6).alias("het_hom"))


#: Bounds of a sample's verdict.
LEAST_SNPS, TI_TV, HET_HOM = 100, (1.8, 2.5), (1.0, 3.0)


def qc_verdict(stats: DataFrame) -> DataFrame:
    """qc_stats() with reasons (too few SNPs, low Ti/Tv, Het/Hom out of bounds), warnings (high or missing Ti/Tv, missing
    Het/Hom) and passes (no reasons)."""
    ti, het = F.col("ti_tv"), F.col("het_hom")
    reasons = F.array_compact(F.array(
        F.when(F.col("n_snp") < LEAST_SNPS, "few_snps"), F.when(ti < TI_TV[0], "ti_tv_low"),
        F.when(het < HET_HOM[0], "het_hom_low").when(het > HET_HOM[1], "het_hom_high"),
    ))
    warnings = F.array_compact(F.array(F.when(ti.isNull(), "ti_tv_missing").when(ti > TI_TV[1], "ti_tv_high"), F.when(het.isNull(), "het_hom_missing")))
    return stats.withColumns({"reasons": F.array_join(reasons, ","), "warnings": F.array_join(warnings, ",")}).withColumn("passes", F.col("reasons") == "")


def call_rates(dosages: DataFrame) -> DataFrame:
    """variant_id, n, call_rate, maf."""
    af = F.try_divide(F.sum("dosage"), 2 * F.count("dosage"))
    return dosages.groupBy("variant_id").agg(F.count("*").alias("n"), (F.count("dosage") / F.count("*")).alias("call_rate"), F.least(af, 1 - af).alias("maf"), F.count_if(F.col("dosage") == 0).alias("n_ref"), F.count_if(F.col("dosage") == 1).alias("n_het"), F.count_if(F.col("dosage") == 2).alias("n_alt"))


def genotype_qc(dosages: DataFrame, variant_missing: float = 0.02, sample_missing: float = 0.02, maf: float = 0.01, least_hwe: float | None = 1e-6) -> DataFrame:
    """The dosages that pass: variants by missing calls, then samples by missing calls over those, then variants by
    frequency of the rarer allele and by the exact Hardy-Weinberg p (least_hwe; None leaves that step out). Semi-joins on
    small key tables."""
    good = call_rates(dosages).where(F.col("call_rate") >= 1 - variant_missing)
    df = dosages.join(good.select("variant_id"), "variant_id", "left_semi")
    samples = df.groupBy("sample_id").agg((F.count("dosage") / F.count("*")).alias("rate")).where(F.col("rate") >= 1 - sample_missing)
    df = df.join(samples.select("sample_id"), "sample_id", "left_semi")
    frequent = call_rates(df).where(F.col("maf") >= maf)
    if least_hwe is not None:
        frequent = frequent.where(hwe_p("n_ref", "n_het", "n_alt") >= least_hwe)
    return df.join(frequent.select("variant_id"), "variant_id", "left_semi")


def split_multiallelic(variants: DataFrame) -> DataFrame:
    """variants: chrom, pos, ref, alt (comma-separated), gt (like 0/2). One row per alternative allele, with its 1-based
    number and the genotype in terms of that allele (other alternatives count as the reference)."""
    rows = variants.select("*", F.posexplode(F.split("alt", ",")).alias("allele_no", "alt_allele")).withColumn("allele_no", F.col("allele_no") + 1)
    parts = F.split(F.translate("gt", "|", "/"), "/")
    own = F.transform(parts, lambda x: F.when(x == ".", ".").when(x == F.col("allele_no").cast("string"), "1").otherwise("0"))
    return rows.withColumn("gt", F.array_join(own, "/")).drop("alt").withColumnRenamed("alt_allele", "alt")


def hard_filter(variants: DataFrame, least_qual: float = 30, least_depth: float = 10) -> DataFrame:
    """Adds passes: quality and depth at their least values (nulls fail)."""
    return variants.withColumn("passes", F.coalesce((F.col("qual") >= least_qual) & (F.col("depth") >= least_depth), F.lit(False)))
