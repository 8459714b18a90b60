"""Expression, protein and cell tables in long form (feature, sample, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.functions.stats import mann_whitney_exact_p, t_quantile, t_two_sided_p, two_sided_p
from omicspark.functions.tables import stored
from omicspark.operators.gwas import element_at_rank, ranked


def sample_qc(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample_id").agg(F.sum("count").alias("library_size"), F.count_if(F.col("count") > 0).alias("n_genes"))


def low_count_filter(counts: DataFrame, least_count: int, least_samples: int) -> DataFrame:
    """Genes with least_count in least_samples samples or more."""
    good = counts.groupBy("gene").agg(F.count_if(F.col("count") >= least_count).alias("n")).where(F.col("n") >= least_samples)
    return counts.join(good.select("gene"), "gene", "left_semi")


def cpm(counts: DataFrame) -> DataFrame:
    """Counts per million of the sample's total, and log2(cpm + 1). The totals are a small table joined by sample, so that
    no sample's rows have to meet in one task."""
    total = counts.groupBy("sample_id").agg(F.sum("count").alias("total"))
    df = counts.join(total, "sample_id").withColumn("cpm", F.try_divide(F.col("count") * F.lit(1e6), F.col("total")))
    return df.withColumn("log2_cpm", F.log2(F.col("cpm") + 1)).drop("total")


def benjamini_hochberg(df: DataFrame, p: str, group: list[str], tie: list[str], name: str = "padj") -> DataFrame:
    """Adjusted p within each group: p * n / rank, the least from the largest p down, between 0 and 1. A null or nan p
    sorts last, counts in n and gets 1."""
    valid = F.when(~F.isnan(p), F.col(p))
    by_p = W.partitionBy(*group).orderBy(valid.asc_nulls_last(), *tie)
    df = df.withColumns({"_rank": F.row_number().over(by_p), "_n": F.count("*").over(W.partitionBy(*group))})
    raw = F.coalesce(valid * F.col("_n") / F.col("_rank"), F.lit(1.0))
    down = W.partitionBy(*group).orderBy(F.col("_rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    adj = F.least(F.lit(1.0), F.min(raw).over(down))
    return df.withColumn(name, F.when(valid.isNull(), 1.0).otherwise(adj)).drop("_rank", "_n")


def benjamini_hochberg_global(df: DataFrame, p: str, tie: list[str], name: str = "padj", slices: int = 64) -> DataFrame:
    """benjamini_hochberg() of one group of any size: ranks go by ranges, each range takes its own least value from the
    largest p down, and the least of the ranges after it is carried over (one row per range)."""
    valid = F.when(~F.isnan(p), F.col(p))
    df = stored(df)
    n = df.count()  # of the table's footers
    numbered = ranked(df.withColumn("_p", valid), [F.col("_p").asc_nulls_last(), *[F.col(c).asc() for c in tie]], "_rank", slices, keep_part=True)
    numbered = numbered.withColumn("_raw", F.coalesce(F.col("_p") * n / F.col("_rank"), F.lit(1.0)))
    least = numbered.groupBy("_part").agg(F.min("_raw").alias("_m"))
    after = least.select("_part", F.min("_m").over(W.orderBy(F.col("_part").desc()).rowsBetween(W.unboundedPreceding, -1)).alias("_after"))
    down = F.min("_raw").over(W.partitionBy("_part").orderBy(F.col("_rank").desc()).rowsBetween(W.unboundedPreceding, 0))
    out = numbered.withColumn("_down", down).join(F.broadcast(after), "_part")
    adj = F.least(F.lit(1.0), F.col("_down"), F.coalesce("_after", F.lit(1.0)))
    return out.withColumn(name, F.when(F.col("_p").isNull(), 1.0).otherwise(adj)).drop("_p", "_part", "_rank", "_raw", "_down", "_after")


def two_group_moments(values: DataFrame, value: str) -> DataFrame:
    """Per gene: n, mean and sample variance of groups 0 and 1."""
    aggs = []
    for g in (0, 1):
        own = F.when(F.col("grp") == g, F.col(value))
        aggs += [F.count(own).alias(f"n{g}"), F.avg(own).alias(f"mean{g}"), F.var_samp(own).alias(f"var{g}")]
    return values.groupBy("gene").agg(*aggs)


def differential_expression(counts: DataFrame) -> DataFrame:
    """log2 fold change (group 1 less group 0) of mean log2 CPM, the normal-approximation z (variances plus 1e-12), p and
    its adjusted value over all genes."""
    m = two_group_moments(cpm(counts), "log2_cpm")
    se = F.sqrt((F.col("var0") + 1e-12) / F.col("n0") + (F.col("var1") + 1e-12) / F.col("n1"))
    df = m.select("gene", (F.col("mean1") - F.col("mean0")).alias("lfc"), ((F.col("mean1") - F.col("mean0")) / se).alias("z"))
    return benjamini_hochberg_global(df.withColumn("p", two_sided_p(F.col("z"))), "p", ["gene"])


def welch(values: DataFrame, value: str, least: int = 3, s0: float = 0.1) -> DataFrame:
    """Welch's t, its degrees of freedom and p, and the t with s0 added to the standard error, for genes with `least`
    values in both groups."""
    m = two_group_moments(values, value).where((F.col("n0") >= least) & (F.col("n1") >= least))
    a, b = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    df = m.withColumns({"diff": F.col("mean1") - F.col("mean0"), "se": F.sqrt(a + b), "df": F.try_divide((a + b) * (a + b), a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))})
    df = df.withColumns({"t": F.try_divide("diff", "se"), "t_s0": F.col("diff") / (F.col("se") + s0)})
    return df.select("gene", "n0", "n1", "diff", "t", "df", "t_s0", t_two_sided_p(F.col("t"), F.col("df")).alias("p"))


def regulation(results: DataFrame, fdr: float = 0.05, s0: float = 0.1, df: int = 4) -> DataFrame:
    """results (gene, log2fc, p) with threshold, the -log10(p) that a fold change needs, and regulation.

    The threshold is the hyperbola of a t statistic whose standard error has s0 added: beyond ta s0 (ta: the quantile of
    Student's t at 1 - fdr / 2) it is the -log10(p) of ta (1 + s0 / (abs(log2fc) / ta - s0)); nearer to zero there is none."""
    ta = t_quantile(1 - fdr / 2, df)
    size = F.abs("log2fc")
    needed = ta * (1 + s0 / (size / ta - s0))
    threshold = F.when(size > ta * s0, -F.log10(F.greatest(t_two_sided_p(F.when(size > ta * s0, needed), F.lit(float(df))), F.lit(1e-300))))
    # greatest() passes over a null; a p that can't be told reaches no threshold.
    hit = F.col("p").isNotNull() & ~F.isnan("p") & (-F.log10(F.greatest(F.col("p"), F.lit(1e-300))) >= F.col("threshold"))
    label = F.when(hit & (F.col("log2fc") > 0), "upregulated").when(hit & (F.col("log2fc") < 0), "downregulated").otherwise("non significant")
    return results.withColumn("threshold", threshold).withColumn("regulation", label)


def protein_regulation(values: DataFrame, value: str, fdr: float = 0.05, s0: float = 0.1, df: int = 4) -> DataFrame:
    """gene, mean_intensity (of all values), mean_treatment (group 1), mean_control, log2fc, p (Welch), padj (over all
    genes), threshold and regulation. A gene with fewer than two values in a group has no p and a padj of 1."""
    m = values.groupBy("gene").agg(F.avg(value).alias("mean_intensity"))
    w = welch(values, value, 2).select("gene", "p")
    g = two_group_moments(values, value).select("gene", F.col("mean1").alias("mean_treatment"), F.col("mean0").alias("mean_control"), (F.col("mean1") - F.col("mean0")).alias("log2fc"))
    tested = benjamini_hochberg_global(m.join(g, "gene").join(w, "gene", "left"), "p", ["gene"])
    return regulation(tested, fdr, s0, df)


#: A group of at most this many values, without ties, has an exact p.
EXACT = 8


def rank_sums(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mann-Whitney U of group 1 against group 0 by key, ties at their mean rank, its z, whether the exact null
    distribution holds (a group of EXACT values or fewer, no ties), and the two-sided p: by that distribution, or else by
    the normal one with corrections for ties and continuity. Equal values are counted before they are ranked."""
    by_value = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"), F.count_if(F.col("grp") == 1).alias("c1"))
    w = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    df = by_value.withColumn("mid", F.sum("c").over(w) - (F.col("c") - 1) / 2)
    df = df.groupBy(*keys).agg(F.sum("c1").alias("n1"), (F.sum("c") - F.sum("c1")).alias("n0"), F.sum(F.col("c1") * F.col("mid")).alias("r1"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    n, half = F.col("n0") + F.col("n1"), F.col("n0") * F.col("n1") / 2
    var = F.col("n0") * F.col("n1") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    df = df.withColumns({"u": F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, "sd": F.sqrt(var), "exact": (F.col("ties") == 0) & (F.least("n0", "n1") <= EXACT)})
    corrected = F.try_divide(F.greatest(F.abs(F.col("u") - half) - 0.5, F.lit(0.0)), F.col("sd"))
    # A null U costs the exact distribution nothing.
    p = F.when(F.col("exact"), mann_whitney_exact_p(F.when(F.col("exact"), F.col("u")), "n0", "n1")).otherwise(two_sided_p(corrected))
    return df.select(*keys, "n0", "n1", "u", F.try_divide(F.col("u") - half, F.col("sd")).alias("z"), "exact", p.alias("p"))


def differential_abundance(values: DataFrame, value: str, test: str = "welch", least: int = 3, most_fdr: float = 0.05, least_fc: float = 0.25, log10_scale: bool = False) -> DataFrame:
    """gene, mean0, mean1, log2fc (group 1 less group 0; over log10(2) where values are log10), p, padj (over all genes)
    and significant (padj at most most_fdr and abs(log2fc) at least least_fc), for genes with `least` values in both
    groups. test: welch or rank_sum. A p that can't be told is 1."""
    m = two_group_moments(values, value).where((F.col("n0") >= least) & (F.col("n1") >= least))
    fc = (F.col("mean1") - F.col("mean0")) / (math.log10(2) if log10_scale else 1.0)
    df = m.select("gene", "mean0", "mean1", fc.alias("log2fc"))
    if test == "welch":
        df = df.join(welch(values, value, least).select("gene", "p"), "gene")
    else:
        df = df.join(rank_sums(values, value, ["gene"]).select("gene", "p"), "gene")
    df = df.withColumn("p", F.when(F.col("p").isNull() | F.isnan("p"), 1.0).otherwise(F.col("p")))
    df = benjamini_hochberg_global(df, "p", ["gene"])
    return df.withColumn("significant", (F.col("padj") <= most_fdr) & (F.abs("log2fc") >= least_fc))


def aligned(values: DataFrame, metadata: DataFrame, group: str, least: int = 2) -> DataFrame:
    """values (sample_id, ...) with their sample's group from metadata (sample_id, group). A sample without metadata, and a
    group of fewer than `least` samples, is an error."""
    samples = values.select("sample_id").distinct()
    missing = [r[0] for r in samples.join(metadata, "sample_id", "left_anti").orderBy("sample_id").limit(5).collect()]
    if missing:
        raise ValueError(f"metadata misses samples: {missing}")
    own = metadata.join(samples, "sample_id", "left_semi").select("sample_id", group).distinct()
    small = own.groupBy(group).count().where(F.col("count") < least).orderBy(group).limit(5).collect()
    if small:
        raise ValueError(f"groups need {least} samples at least: {[r[0] for r in small]}")
    return values.join(own, "sample_id")


#: Intercept, slope and average log hazard of the Gompertz law of mortality.
GOMPERTZ = (-9.94613787413831, 0.0897860500778604, -4.801912)


def organ_ages(values: DataFrame, coefficients: DataFrame, intercepts: DataFrame | None = None, hazard: bool = False) -> DataFrame:
    """values: sample_id, protein, value. coefficients: organ, protein, weight. intercepts: organ, intercept. Per sample and
    organ: age (intercept plus weighted values of the proteins that any sample has), n_used and n_missing proteins of the
    organ. A sample that lacks one of the used proteins, or has a null or nan for it, has a null age, as has every sample
    where none of an organ's proteins is there. hazard: the sum is a log mortality hazard and is turned into years.

    The organs are a panel of one row each, sent along as one array."""
    measured = values.select("protein").distinct()
    parts = coefficients.join(measured.withColumn("_m", F.lit(1)), "protein", "left").groupBy("organ").agg(F.count("_m").alias("n_used"), F.count_if(F.col("_m").isNull()).alias("n_missing"))
    parts = parts.join(intercepts, "organ", "left") if intercepts is not None else parts.withColumn("intercept", F.lit(0.0))
    own = F.when(~F.isnan("value"), F.col("value")) * F.col("weight")
    sums = values.join(coefficients, "protein").groupBy("sample_id", "organ").agg(F.sum(own).alias("s"), F.count(own).alias("n"))
    panel = parts.agg(F.collect_list(F.struct("organ", "n_used", "n_missing", "intercept")).alias("organs"))
    every = values.select("sample_id").distinct().join(F.broadcast(panel)).select("sample_id", F.inline("organs"))
    age = F.col("s") + F.coalesce("intercept", F.lit(0.0))
    if hazard:
        a, b, h = GOMPERTZ
        age = (age - h) / b - a
    df = every.join(sums, ["sample_id", "organ"], "left")
    return df.select("sample_id", "organ", F.when(F.col("n") == F.col("n_used"), age).alias("age"), "n_used", "n_missing")


def missing_proteins(values: DataFrame, coefficients: DataFrame) -> DataFrame:
    """organ, protein: those of the coefficients that no sample has."""
    return coefficients.select("organ", "protein").distinct().join(values.select("protein").distinct(), "protein", "left_anti").select("organ", "protein")


def correlations(values: DataFrame, item: str, of: str, value: str) -> DataFrame:
    """item_1, item_2, r: Pearson correlations of a few items (organs, clocks) over what they are measured on."""
    a, b = values.alias("a"), values.alias("b")
    both = a.join(b, (F.col(f"a.{of}") == F.col(f"b.{of}")) & (F.col(f"a.{item}") < F.col(f"b.{item}")))
    return both.groupBy(F.col(f"a.{item}").alias("item_1"), F.col(f"b.{item}").alias("item_2")).agg(F.corr(f"a.{value}", f"b.{value}").alias("r"))


def markers(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """U of each gene's counts, each cluster against the rest, over all cells. Only non-zero counts are read and ranked;
    the zeros, which are the first tie of each gene, are put in by their number."""
    sizes = obs.groupBy("cluster").agg(F.count("*").alias("n1"))
    total = obs.count()
    df = cells.where("count > 0").join(obs.select("cell", "cluster"), "cell")
    by_value = df.groupBy("gene", "cluster", "count").agg(F.count("*").alias("c1"))
    w = W.partitionBy("gene").orderBy("count")
    by_gene = by_value.groupBy("gene", "count").agg(F.sum("c1").alias("c")).withColumn("n", F.lit(total))
    nz = F.sum("c").over(W.partitionBy("gene"))
    mids = by_gene.withColumn("mid", F.col("n") - nz + F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)) - (F.col("c") - 1) / 2).withColumn("zeros", F.col("n") - nz)
    sums = by_value.join(mids.select("gene", "count", "mid", "zeros", "n"), ["gene", "count"]).groupBy("gene", "cluster").agg(F.sum(F.col("c1") * F.col("mid")).alias("r"), F.sum("c1").alias("nz1"), F.max("zeros").alias("zeros"), F.max("n").alias("n"))
    out = sums.join(F.broadcast(sizes), "cluster")
    r1 = F.col("r") + (F.col("n1") - F.col("nz1")) * (F.col("zeros") + 1) / 2
    return out.select("gene", "cluster", "n1", "nz1", (r1 - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"))


#: Groups that pairwise contrasts may have: each gene's value is a row of as many counts.
MOST_GROUPS = 500


def pairwise_markers(cells: DataFrame, obs: DataFrame, group: str, within: str | None = None, least: int = 2) -> DataFrame:
    """Rank-sum contrasts of all pairs of groups of cells (group_1 < group_2), for each gene, over all cells or within each
    value of another column of obs: [within,] gene, group_1, group_2, n1, n2, pts1, pts2 (shares of cells with a count), u (of
    group_1), z, p, padj (over the genes of a contrast), and z_ties and p_ties, corrected for ties. Groups need `least`
    cells; cells without a group are left out. cells holds gene, cell, count; counts of zero need no row.

    One table of counts by value serves all pairs: running sums of it tell how many cells of each group lie below a value,
    and a pair's U is the sum of the one's counts times the other's running sums. No ranks are made for a pair."""
    own = F.col(within) if within else F.lit(0)
    labels = obs.where(F.col(group).isNotNull()).select("cell", own.alias("w"), F.col(group).alias("g")).where("w is not null")
    sizes = stored(labels.groupBy("w", "g").agg(F.count("*").alias("n")))
    groups = [r[0] for r in sizes.select("g").distinct().orderBy("g").limit(MOST_GROUPS + 1).collect()]
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    k = len(groups)

    def by_group(df: DataFrame, keys: list[str], name: str, to: str) -> DataFrame:
        wide = df.groupBy(*keys).pivot("g", groups).agg(F.sum(name))
        return wide.select(*keys, F.array(*[F.coalesce(F.col(f"`{g}`"), F.lit(0)).cast("double") for g in map(str, groups)]).alias(to)) if k else wide.withColumn(to, F.array().cast("array<double>"))

    cast = F.col("g").cast("string").alias("g")
    groups = [str(g) for g in groups]
    some = cells.where("count > 0").join(labels, "cell").groupBy("w", "gene", "count", cast).agg(F.count("*").alias("c"))
    seen = stored(by_group(some, ["w", "gene", "count"], "c", "c"))
    size = by_group(sizes.select("w", cast, "n"), ["w"], "n", "n")
    nonzero = seen.groupBy("w", "gene").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(k)]).alias("nz"))
    grid = cells.select("gene").distinct().join(F.broadcast(size.agg(F.collect_list(F.struct("w", "n")).alias("x")))).select("gene", F.inline("x"))
    base = stored(grid.join(nonzero, ["w", "gene"], "left").withColumn("nz", F.coalesce("nz", F.array_repeat(F.lit(0.0), k))))
    zeros = base.select("w", "gene", F.lit(0).cast(dict(cells.dtypes)["count"]).alias("count"), F.zip_with("n", "nz", lambda n, nz: n - nz).alias("c"))
    below = W.partitionBy("w", "gene").orderBy("count").rowsBetween(W.unboundedPreceding, -1)
    values = seen.select("w", "gene", "count", "c").union(zeros)
    values = values.withColumn("b", F.array(*[F.coalesce(F.sum(F.col("c")[i]).over(below), F.lit(0.0)) for i in range(k)]))
    one = values.select("w", "gene", "c", "b", F.posexplode("c").alias("i", "ci")).where("ci > 0")
    pair = one.select("w", "gene", "i", "ci", F.posexplode(F.zip_with("b", "c", lambda b, c: F.struct((b + c / 2).alias("m"), c.alias("cj")))).alias("j", "x")).where("i <> j")
    # Both orders of a pair meet in one row: U comes from the first group's, the mixed cubes of the ties from both.
    sums = pair.groupBy("w", "gene", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum(F.when(F.col("i") < F.col("j"), F.col("ci") * F.col("x.m")).otherwise(0.0)).alias("u"), F.sum(F.col("ci") * F.col("ci") * F.col("x.cj")).alias("mixed"))
    cubes = values.groupBy("w", "gene").agg(F.array(*[F.sum(F.pow(F.col("c")[i], F.lit(3))) for i in range(k)]).alias("cube"))
    df = sums.join(base, ["w", "gene"]).join(cubes, ["w", "gene"])
    n1, n2 = F.col("n")[F.col("i")], F.col("n")[F.col("j")]
    df = df.withColumns({"n1": n1, "n2": n2, "pts1": F.try_divide(F.col("nz")[F.col("i")], n1), "pts2": F.try_divide(F.col("nz")[F.col("j")], n2), "ties": F.col("cube")[F.col("i")] + F.col("cube")[F.col("j")] + 3 * F.col("mixed") - n1 - n2})
    df = df.where((F.col("n1") >= least) & (F.col("n2") >= least))
    n, away, var = F.col("n1") + F.col("n2"), F.col("u") - F.col("n1") * F.col("n2") / 2, F.col("n1") * F.col("n2") / 12
    df = df.withColumns({"z": away / F.sqrt(var * (n + 1)), "z_ties": F.coalesce(F.try_divide(away, F.sqrt(var * (n + 1 - F.col("ties") / (n * (n - 1))))), F.lit(0.0))})
    df = df.withColumns({"p": two_sided_p(F.col("z")), "p_ties": two_sided_p(F.col("z_ties"))})
    df = benjamini_hochberg(df, "p", ["w", "i", "j"], ["gene"])
    names = F.array(*[F.lit(g) for g in groups]) if k else F.array().cast("array<string>")
    kind = dict(obs.dtypes)[group]
    first = [F.col("w").alias(within)] if within else []
    return df.select(*first, "gene", names[F.col("i")].cast(kind).alias("group_1"), names[F.col("j")].cast(kind).alias("group_2"), *[F.col(c).cast("bigint").alias(c) for c in ("n1", "n2")], "pts1", "pts2", "u", "z", "p", "padj", "z_ties", "p_ties")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def outliers(values: DataFrame, controls: Column, least_z: float) -> DataFrame:
    """Modified z = 0.6745 (x - median) / MAD of cases against the controls of their gene, where MAD is above 0."""
    c = values.where(controls)
    med = c.groupBy("gene").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    mad = c.join(med, "gene").groupBy("gene").agg(F.first("median").alias("median"), F.percentile(F.abs(F.col("value") - F.col("median")), F.lit(0.5)).alias("mad")).where("mad > 0")
    df = values.where(~controls).join(mad, "gene").withColumn("z", 0.6745 * (F.col("value") - F.col("median")) / F.col("mad"))
    return df.where(F.abs("z") >= least_z).select("gene", "sample_id", "z")


def matrix_moments(values: DataFrame) -> tuple[float | None, float | None]:
    """Median and population deviation of all values, as two numbers."""
    r = values.agg(F.count("value").alias("n"), F.stddev_pop("value").alias("s")).first()
    if not r["n"]:
        return None, None
    low, high = element_at_rank(values, "value", [(r["n"] - 1) // 2, r["n"] // 2])
    return (low + high) / 2, r["s"]


def downshift(values: DataFrame, shift: float = 1.8, width: float = 0.3) -> DataFrame:
    """Nulls filled by draws from a normal distribution below the matrix's values: the median of all values less `shift`
    of their (population) deviations, `width` deviations wide. The draw comes from the row's own key, so that it doesn't
    depend on the partitioning. Without values nulls stay."""
    m, s = matrix_moments(values)

    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64("gene", "sample_id", F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(2))
    draw = F.lit(m).cast("double") - shift * F.lit(s).cast("double") + width * F.lit(s).cast("double") * normal
    return values.withColumn("imputed", F.col("value").isNull()).withColumn("value", F.coalesce("value", draw))


def significance(df: DataFrame, padj: str, lfc: str, most_p: float = 0.05, least_lfc: float = 1.0) -> DataFrame:
    """p made safe (null, nan and infinite as 1, between 1e-300 and 1) and the regulation label."""
    p = F.col(padj)
    safe = F.greatest(F.lit(1e-300), F.least(F.lit(1.0), F.when(p.isNull() | F.isnan(p) | (p == float("inf")), 1.0).otherwise(p)))
    hit = (F.col("safe_p") <= most_p) & (F.abs(lfc) >= least_lfc)
    return df.withColumn("safe_p", safe).withColumn("label", F.when(hit & (F.col(lfc) > 0), "up").when(hit, "down").otherwise("unchanged"))


def direction_counts(df: DataFrame, padj: str, lfc: str, most_p: float = 0.05, least_lfc: float = 1.0) -> DataFrame:
    """One row: n_tested, n_up and n_down (significant results with a rise or a fall of least_lfc or more)."""
    hit = F.coalesce(F.col(padj) <= most_p, F.lit(False))
    return df.agg(F.count("*").alias("n_tested"), F.count_if(hit & (F.col(lfc) >= least_lfc)).alias("n_up"), F.count_if(hit & (F.col(lfc) <= -least_lfc)).alias("n_down"))


def majority(obs: DataFrame) -> DataFrame:
    """The most frequent label of each cluster (the first by order for ties), its share, and its mean confidence."""
    n = obs.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    w = W.partitionBy("cluster")
    df = n.withColumns({"total": F.sum("n").over(w), "_r": F.row_number().over(w.orderBy(F.col("n").desc(), "label"))})
    return df.where("_r = 1").select("cluster", "label", "n", "total", (F.col("n") / F.col("total")).alias("support"), "confidence")


def cell_qc(cells: DataFrame, least_genes: int, most_mito: float, least_cells: int, mito: Column) -> DataFrame:
    """Cells by genes seen and share of mitochondrial counts; then genes by the cells that are left."""
    own = cells.groupBy("cell").agg(F.count_if(F.col("count") > 0).alias("g"), (F.sum(F.when(mito, F.col("count")).otherwise(0)) / F.sum("count")).alias("m"))
    kept = cells.join(own.where((F.col("g") >= least_genes) & (F.col("m") <= most_mito)).select("cell"), "cell", "left_semi")
    genes = kept.where("count > 0").groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= least_cells)
    return kept.join(genes.select("gene"), "gene", "left_semi")


def normalised(cells: DataFrame, total: float = 1e4) -> DataFrame:
    size = cells.groupBy("cell").agg(F.sum("count").alias("_t"))
    return cells.join(size, "cell").withColumn("value", F.log1p(F.col("count") * total / F.col("_t"))).drop("_t")


def variable_genes(cells: DataFrame, n_cells: Column, bins: int = 10, top: int = 20) -> DataFrame:
    """Genes by dispersion, as a z-score within bins of their mean; zeros count by the number of cells."""
    s = normalised(cells).groupBy("gene").agg((F.sum("value") / n_cells).alias("mean"), (F.sum(F.col("value") * F.col("value")) / n_cells).alias("sq"))
    s = s.withColumn("dispersion", (F.col("sq") - F.col("mean") * F.col("mean")) / F.col("mean"))
    n = s.count()
    place = ranked(s, [F.col("mean").asc(), F.col("gene").asc()], "_r")
    # As ntile: the first n mod bins bins have one gene more.
    small, more = n // bins, n % bins
    edge = more * (small + 1)
    s = place.withColumn("bin", F.when(F.col("_r") <= edge, F.floor((F.col("_r") - 1) / (small + 1)) + 1).otherwise(F.floor((F.col("_r") - 1 - edge) / max(small, 1)) + more + 1).cast("int")).drop("_r")
    w = W.partitionBy("bin")
    s = s.withColumn("z", F.try_divide(F.col("dispersion") - F.avg("dispersion").over(w), F.stddev("dispersion").over(w)))
    best = s.orderBy(F.col("z").desc_nulls_last(), "gene").limit(top).select(F.col("gene").alias("_g"))
    return s.join(F.broadcast(best), s["gene"] == best["_g"], "left").select("gene", "bin", "z", F.col("_g").isNotNull().alias("variable"))


def batch_mixing(edges: DataFrame) -> DataFrame:
    """edges: cell, batch, other_batch. Per cell: share of neighbours from other batches, and the entropy of their
    batches over the most that all batches (two at least) allow."""
    batches = edges.select(F.explode(F.array("batch", "other_batch")).alias("b")).distinct().count()
    n = edges.groupBy("cell", "batch", "other_batch").agg(F.count("*").alias("c"))
    total = F.sum("c").over(W.partitionBy("cell"))
    p = n.withColumn("p", F.col("c") / total)
    return p.groupBy("cell").agg(F.sum(F.when(F.col("batch") != F.col("other_batch"), F.col("p")).otherwise(0)).alias("cross"), (-F.sum(F.col("p") * F.log2("p")) / math.log2(max(2, batches))).alias("entropy"))


def graph_mixing(graph: DataFrame, labels: DataFrame, id_col: str = "cell", batch: str = "batch") -> DataFrame:
    """batch_mixing() over a neighbour graph (id_col, neighbour) and the batch of each of its points (id_col, batch)."""
    own, other = labels.select(id_col, F.col(batch).alias("batch")), labels.select(F.col(id_col).alias("neighbour"), F.col(batch).alias("other_batch"))
    edges = graph.select(id_col, "neighbour").join(own, id_col).join(other, "neighbour")
    return batch_mixing(edges.withColumnRenamed(id_col, "cell")).withColumnRenamed("cell", id_col)


def evenly_spaced(df: DataFrame, order: list[str], group: str | None = None, most: int = 48) -> DataFrame:
    """At most `most` rows of df: all, if there are no more. Else evenly spaced ones (the rounded positions of `most` even
    steps); with a group, most div groups from each (one at least) and then, in turns, the first that are left of each
    group, the groups with more left first, then by first appearance. A null group is one of its own.

    Orders go by ranges or by group; only what fills the list up, fewer than `most` rows, is put in one order."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    n = df.count()
    if n <= most:
        return df
    if group is None:
        spots = {round(i * (n - 1) / (most - 1)) if most > 1 else 0 for i in range(most)}
        return ranked(df, keys, "_i").where((F.col("_i") - 1).isin(*spots)).drop("_i")
    df = ranked(df, keys, "_at")
    own = df.withColumn("_i", F.row_number().over(W.partitionBy(group).orderBy("_at")) - 1)
    sizes = own.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    share = max(1, most // max(1, sizes.count()))
    own = own.join(sizes, own[group].eqNullSafe(sizes["_g"])).drop("_g")
    take = F.least(F.lit(share), F.col("_n"))
    step = F.when(take > 1, (F.col("_n") - 1) / (take - 1)).otherwise(F.lit(0.0))
    spots = F.transform(F.sequence(F.lit(0), take - 1), lambda k: F.bround(k * step).cast("bigint"))
    own = own.withColumn("_chosen", (F.col("_n") <= share) | F.array_contains(spots, F.col("_i").cast("bigint")))
    chosen, rest = own.where("_chosen"), own.where("not _chosen")
    missing = most - chosen.count()
    out = [*df.drop("_at").columns]
    if missing <= 0:
        return chosen.select(*out)
    turn = rest.withColumn("_turn", F.row_number().over(W.partitionBy(group).orderBy("_at")))
    turn = turn.withColumn("_left", F.col("_n") - F.least(F.lit(share), F.col("_n")) - F.col("_turn"))
    filled = turn.orderBy("_turn", F.col("_left").desc(), "_first").limit(missing)
    return chosen.select(*out).union(filled.select(*out))


def de_order(results: DataFrame) -> DataFrame:
    """Results (gene, lfc, p or no p) in order: by p, then by falling lfc; without a p column by falling abs(lfc)."""
    keys = [F.col("p").asc_nulls_last(), F.col("lfc").desc()] if "p" in results.columns else [F.abs("lfc").desc()]
    return results.orderBy(*keys, "gene")


def display_cap(scores: DataFrame, group: str, score: str = "score", least: float = 4.0, fallback: float = 8.0) -> DataFrame:
    """group, cap (the 0.995 quantile of the finite scores, `least` at least; `fallback` without any), n_top (scores at
    the 0.9 quantile or above)."""
    finite = F.when(~F.isnan(score) & (F.abs(score) != float("inf")), F.col(score).cast("double"))
    by = scores.groupBy(group).agg(F.percentile(finite, F.lit(0.995)).alias("q"), F.percentile(finite, F.lit(0.9)).alias("t"))
    joined = scores.withColumn("_s", finite).join(by, group)
    return joined.groupBy(group).agg(F.coalesce(F.greatest(F.first("q"), F.lit(least)), F.lit(fallback)).alias("cap"), F.count_if(F.col("_s") >= F.col("t")).alias("n_top"))
