"""Result tables brought together: profiles, dossiers, registers, generations, sheets and scores of methods."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.functions.tables import stored

#: Evidence levels from the best down; the bands of a residue's confidence, with their lower ends; the weights
#: of a fine-mapping method's score.
LEVELS = ["1A", "1B", "2A", "2B", "3", "4"]
BANDS = [("very_high", 90), ("confident", 70), ("low", 50), ("very_low", 0)]
METHOD_WEIGHTS = {"recall": 0.4, "pip": 0.3, "precision": 0.2, "rank": 0.1}
WARFARIN_GENES = ("CYP2C9", "VKORC1")


def panel_genotypes(genotypes: DataFrame, panel: DataFrame) -> DataFrame:
    """genotypes: sample_id, variant_id, genotype. panel: gene, variant_id. Per sample and gene with a call: n_panel, n_called
    and genotypes (variant:genotype, by variant, comma-joined). A null genotype is no call."""
    n = panel.groupBy("gene").agg(F.countDistinct("variant_id").alias("n_panel"))
    own = genotypes.where("genotype is not null").join(panel.select("gene", "variant_id").distinct(), "variant_id")
    each = F.transform(F.array_sort(F.collect_list(F.struct("variant_id", "genotype"))), lambda x: F.concat_ws(":", x["variant_id"].cast("string"), x["genotype"]))
    out = own.groupBy("sample_id", "gene").agg(F.count("*").alias("n_called"), F.array_join(each, ",").alias("genotypes"))
    return out.join(n, "gene").select("sample_id", "gene", "n_panel", "n_called", "genotypes")


def warfarin(samples: DataFrame, calls: DataFrame) -> DataFrame:
    """samples: sample_id. calls: sample_id, gene, diplotype, phenotype. Each sample's action by two genes: sample_id, drug,
    gene, diplotype, phenotype, action, missing (the gene for want of which nothing can be said)."""
    one, other = WARFARIN_GENES
    get = lambda g, c: F.max(F.when(F.col("gene") == g, F.col(c)))
    wide = calls.where(F.col("gene").isin(one, other)).groupBy("sample_id").agg(get(one, "phenotype").alias("p1"), get(other, "phenotype").alias("p2"), get(one, "diplotype").alias("d1"), get(other, "diplotype").alias("d2"))
    df = samples.select("sample_id").distinct().join(wide, "sample_id", "left")
    p1, p2 = (F.lower(F.coalesce(c, F.lit(""))) for c in ("p1", "p2"))

    def unusable(p: Column) -> Column:
        return (p == "") | p.contains("indeterminate") | p.contains("not genotyped")

    missing = F.when(unusable(p1), one).when(unusable(p2), other)
    usable = F.when(p1.contains("normal") & p2.contains("normal"), "standard").when(p1.contains("poor") | p2.contains("high"), "avoid").otherwise("caution")
    action = F.when(missing.isNotNull() | p1.contains("unknown") | p2.contains("unknown"), "indeterminate").otherwise(usable)
    both = lambda x, y: F.concat(F.lit(f"{one} "), F.coalesce(x, F.lit("?")), F.lit(f" / {other} "), F.coalesce(y, F.lit("?")))
    return df.select("sample_id", F.lit("warfarin").alias("drug"), F.lit(f"{one} + {other}").alias("gene"), both("d1", "d2").alias("diplotype"), both("p1", "p2").alias("phenotype"), action.alias("action"), missing.alias("missing"))


def single_drug(samples: DataFrame, calls: DataFrame, guide: DataFrame, drug: str) -> DataFrame:
    """One drug of the guide (drug, gene, phenotype, action) for each sample: sample_id, drug, gene, diplotype, phenotype,
    action. A gene that wasn't tested is NOT_TESTED and indeterminate, as is a phenotype that the guide doesn't have.
    warfarin goes by warfarin(). An unknown drug has no rows."""
    if drug == "warfarin":
        return warfarin(samples, calls).drop("missing")
    own = guide.where(F.col("drug") == drug)
    gene = own.select("gene").distinct()  # a row a gene of the drug
    df = samples.select("sample_id").distinct().join(F.broadcast(gene.agg(F.collect_set("gene").alias("g")))).select("sample_id", F.explode("g").alias("gene"))
    df = df.join(calls.select("sample_id", "gene", "diplotype", "phenotype"), ["sample_id", "gene"], "left").join(own.select("gene", "phenotype", "action"), ["gene", "phenotype"], "left")
    tested = F.col("diplotype").isNotNull() | F.col("phenotype").isNotNull()
    return df.select("sample_id", F.lit(drug).alias("drug"), "gene", F.when(tested, F.col("diplotype")).otherwise("NOT_TESTED").alias("diplotype"), F.when(tested, F.col("phenotype")).otherwise("Indeterminate").alias("phenotype"), F.coalesce("action", F.lit("indeterminate")).alias("action"))


def person_profile(drugs: DataFrame, scores: DataFrame, nutrients: DataFrame, ancestry: DataFrame, most_traits: int = 3) -> DataFrame:
    """A row for each sample that any of the results knows. drugs: sample_id, gene, drug, action; scores: sample_id, trait,
    percentile, risk; nutrients: sample_id, domain, category; ancestry: sample_id, population, share.

    genes_profiled, n_avoid, n_caution, n_standard; risks (the first `most_traits` traits by name with a percentile) and
    more_traits; domains_assessed, elevated and moderate (lists, comma-joined); top_population and its share. What has not
    been assessed is null. Each source is summed up by sample before the joins."""
    action = lambda a: F.count_if(F.col("action") == a)
    d = drugs.groupBy("sample_id").agg(F.countDistinct("gene").alias("genes_profiled"), action("avoid").alias("n_avoid"), action("caution").alias("n_caution"), action("standard").alias("n_standard"))
    told = F.when(F.col("percentile").isNotNull(), F.struct("trait", F.format_string("%s %s (%d)", "risk", "trait", F.bround("percentile").cast("int")).alias("t")))
    s = scores.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["t"]).alias("all"))
    s = s.select("sample_id", F.array_join(F.slice("all", 1, most_traits), "; ").alias("risks"), F.greatest(F.size("all") - most_traits, F.lit(0)).cast("bigint").alias("more_traits"))
    named = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("domain")))), ",")
    n = nutrients.groupBy("sample_id").agg(F.countDistinct("domain").alias("domains_assessed"), named("Elevated").alias("elevated"), named("Moderate").alias("moderate"))
    best = F.max_by(F.struct("population", "share"), F.struct("share", F.col("population")))
    a = ancestry.where("share is not null").groupBy("sample_id").agg(best.alias("x")).select("sample_id", F.col("x.population").alias("top_population"), F.col("x.share").alias("top_share"))
    return reduce(lambda x, y: x.join(y, "sample_id", "full"), [d, s, n, a])


def target_dossier(targets: DataFrame, associations: DataFrame, papers: DataFrame, trials: DataFrame, most: int = 5) -> DataFrame:
    """A row for each (gene, disease) that any evidence knows: summary of the gene (targets: gene, summary), score
    (associations: gene, disease, score; the highest), papers (gene, disease, paper_id, year: the `most` newest as an array
    of structs) and n_papers, trials (gene, disease, trial_id, status: the first `most` by id) and n_trials, n_recruiting.

    Each source is summed up by gene and disease before the joins; a hot pair's papers are cut to the newest within each
    task's partial result, so that no pair is gathered whole."""
    key = ["gene", "disease"]
    a = associations.groupBy(*key).agg(F.max("score").alias("score"))

    def first(df: DataFrame, order: list[Column], fields: list[str], name: str) -> DataFrame:
        few = df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= most)
        return few.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))

    p = papers.groupBy(*key).agg(F.count("*").alias("n_papers")).join(first(papers, [F.desc_nulls_last("year"), F.col("paper_id")], ["paper_id", "year"], "papers"), key)
    t = trials.groupBy(*key).agg(F.count("*").alias("n_trials"), F.count_if(F.upper("status") == "RECRUITING").alias("n_recruiting")).join(first(trials, [F.col("trial_id")], ["trial_id", "status"], "trials"), key)
    df = reduce(lambda x, y: x.join(y, key, "full"), [a, p, t])
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_papers", "n_trials", "n_recruiting")}
    return df.withColumns(zero).join(targets.select("gene", "summary"), "gene", "left")


def new_in_second(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The entries of the first register, and those of the second that the first doesn't have (register: first or second).
    Entries without a key are kept."""
    only = second.join(first.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return first.withColumn("register", F.lit("first")).unionByName(only.withColumn("register", F.lit("second")))


def citations_within(edges: DataFrame, corpus: DataFrame) -> DataFrame:
    """edges: doc_id, cited. The different edges of which both ends are in the corpus (doc_id), without those to itself, and
    how often the corpus cites the cited one (n_cited)."""
    docs = corpus.select("doc_id").distinct()
    inside = edges.where("doc_id <> cited").select("doc_id", "cited").distinct().join(docs, "doc_id", "left_semi").join(docs.withColumnRenamed("doc_id", "cited"), "cited", "left_semi")
    return inside.join(inside.groupBy("cited").agg(F.count("*").alias("n_cited")), "cited").select("doc_id", "cited", "n_cited")


def in_several(results: DataFrame, least: int = 2) -> DataFrame:
    """results: domain, gene. Genes of `least` domains or more: gene, n_domains, domains (comma-joined). Different pairs are
    found first, so that a frequent gene is small before its shuffle."""
    pairs = results.where("gene is not null and domain is not null").select("domain", "gene").distinct()
    return pairs.groupBy("gene").agg(F.count("*").alias("n_domains"), F.array_join(F.array_sort(F.collect_list("domain")), ",").alias("domains")).where(F.col("n_domains") >= least)


def shared_positions(modern: DataFrame, archaic: DataFrame) -> DataFrame:
    """Both: chrom, pos, ref, alt. The positions that both have: chrom, pos, the alleles of either, and whether they are the
    same alleles (in either order)."""
    a = archaic.select("chrom", "pos", F.col("ref").alias("archaic_ref"), F.col("alt").alias("archaic_alt"))
    same = (F.col("ref") == F.col("archaic_ref")) & (F.col("alt") == F.col("archaic_alt")) | (F.col("ref") == F.col("archaic_alt")) & (F.col("alt") == F.col("archaic_ref"))
    return modern.select("chrom", "pos", "ref", "alt").join(a, ["chrom", "pos"]).withColumn("same_alleles", same)


def enriched(samples: DataFrame, sheet: DataFrame, key: str) -> DataFrame:
    """samples with the columns of the sheet and whether the sheet has them (matched). A sheet that lists a key again gives
    its first row by the other columns."""
    rest = [c for c in sheet.columns if c != key]
    own = sheet.groupBy(key).agg(F.min(F.struct(*rest)).alias("_s"))
    return samples.join(own, key, "left").select(*samples.columns, *[F.col(f"_s.{c}").alias(c) for c in rest], F.col("_s").isNotNull().alias("matched"))


def match_counts(df: DataFrame) -> DataFrame:
    """One row of an enriched() table: n, n_matched, n_unmatched."""
    return df.agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"), F.count_if(~F.col("matched")).alias("n_unmatched"))


def sheet_summary(sheet: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Per group the number of rows and, for each field, how many different values there are and which (in order)."""
    some = [x for f in fields for x in (F.countDistinct(f).alias(f"n_{f}"), F.array_join(F.array_sort(F.collect_set(F.col(f).cast("string"))), ",").alias(f))]
    return sheet.groupBy(group).agg(F.count("*").alias("n"), *some)


def paired_delta(values: DataFrame, subjects: DataFrame, before: str, after: str) -> DataFrame:
    """values: feature, subject, time, value. subjects: subject, grp (may repeat). feature, subject, grp, delta of the subjects
    that have a value at both times; repeated values at a time are averaged."""
    at = lambda t: F.avg(F.when(F.col("time") == t, F.col("value")))
    pairs = values.where(F.col("time").isin(before, after)).groupBy("feature", "subject").agg(at(before).alias("x"), at(after).alias("y")).where("x is not null and y is not null")
    return pairs.join(subjects.groupBy("subject").agg(F.min("grp").alias("grp")), "subject", "left").select("feature", "subject", "grp", (F.col("y") - F.col("x")).alias("delta"))


def outliers_in_panel(outliers: DataFrame, panel: DataFrame) -> DataFrame:
    """outliers (gene, sample_id, z) with the disease and mechanism of a panel (gene, disease, mechanism), or 'not in panel';
    a gene of several diseases has a row for each."""
    df = outliers.join(panel.select("gene", "disease", "mechanism").distinct(), "gene", "left")
    return df.withColumns({"disease": F.coalesce("disease", F.lit("not in panel")), "mechanism": F.coalesce("mechanism", F.lit("not in panel")), "direction": F.when(F.col("z") > 0, "over").otherwise("under")})


def without_warned(rows: DataFrame, warning: str = "qc_warning") -> DataFrame:
    """rows (sample_id, ...) of the samples that have no row with a warning (WARN..., in any case of letters)."""
    return rows.join(rows.where(F.upper(F.col(warning)).startswith("WARN")).select("sample_id").distinct(), "sample_id", "left_anti")


def aptamer_values(rows: DataFrame) -> DataFrame:
    """rows: feature, sample_id, rfu, row_check, sample_type, col_check. log10 of the values of samples and features that
    passed; a value that isn't positive is null."""
    good = rows.where((F.upper("row_check") == "PASS") & (F.col("sample_type") == "Sample") & (F.upper("col_check") == "PASS"))
    return good.select("feature", "sample_id", F.when(F.col("rfu") > 0, F.log10("rfu")).alias("value"))


def detection(rows: DataFrame) -> DataFrame:
    """rows: feature, sample_id, npx, lod. Per feature n, n_above (values above the limit of detection) and above_lod_pct, of
    the values that are there."""
    known = F.col("npx").isNotNull() & F.col("lod").isNotNull()
    above = F.count_if(known & (F.col("npx") > F.col("lod")))
    return rows.groupBy("feature").agg(F.count_if(known).alias("n"), above.alias("n_above"), F.round(100 * F.try_divide(above, F.count_if(known)), 6).alias("above_lod_pct"))


def base_mean_filter(results: DataFrame, least: float, value: str = "base_mean") -> DataFrame:
    """The results with a mean of `least` or more; all of them, if that leaves none. One aggregated row tells which."""
    any_left = results.agg(F.coalesce(F.max(F.col(value) >= least), F.lit(False)).alias("_any"))
    return results.join(F.broadcast(any_left)).where(~F.col("_any") | (F.col(value) >= least)).drop("_any")


def recruiting(trials: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """trials (trial_id, disease, status) in one of the statuses (any case of letters; None: all), with the number of
    recruiting ones of their disease."""
    s = F.upper("status")
    kept = trials if statuses is None else trials.where(s.isin([x.upper() for x in statuses]))
    n = kept.groupBy("disease").agg(F.count_if(s == "RECRUITING").alias("n_recruiting"))
    return kept.join(n, "disease")


def phase_by_status(trials: DataFrame, statuses: list[str]) -> DataFrame:
    """trials: phase, status. Per phase the number in each of the statuses, the rest as other, and total."""
    own = F.coalesce(F.upper("status"), F.lit(""))
    counts = [F.count_if(own == s.upper()).alias(s.lower()) for s in statuses]
    return trials.groupBy("phase").agg(*counts, F.count_if(~own.isin([s.upper() for s in statuses])).alias("other"), F.count("*").alias("total"))


def drug_evidence(evidence: DataFrame) -> DataFrame:
    """evidence: drug, level, source, verified. Per drug the best level (of LEVELS; others are worse), its sources (in order,
    comma-joined), how many rows, and whether any is verified."""
    place = F.coalesce(*[F.when(F.col("level") == x, i) for i, x in enumerate(LEVELS)], F.lit(len(LEVELS)))
    return evidence.groupBy("drug").agg(F.min_by("level", F.struct(place, "level")).alias("best_level"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"), F.coalesce(F.bool_or("verified"), F.lit(False)).alias("verified"))


def relative_abundance(reads: DataFrame) -> DataFrame:
    """reads: sample_id, taxon, reads. Adds pct of the sample's reads; samples without reads are null. Totals are joined."""
    total = reads.groupBy("sample_id").agg(F.sum("reads").alias("_total"))
    return reads.join(total, "sample_id").withColumn("pct", 100 * F.try_divide(F.col("reads"), F.col("_total"))).drop("_total")


def contig_depth(depth: DataFrame, least: int = 1) -> DataFrame:
    """depth: contig, depth, n (positions of that depth). Per contig: length, mean depth, and breadth (share of positions
    of depth `least` or more)."""
    n = F.sum("n")
    covered = F.sum(F.when(F.col("depth") >= least, F.col("n")).otherwise(0))
    return depth.groupBy("contig").agg(n.alias("length"), F.try_divide(F.sum(F.col("depth") * F.col("n")), n).alias("mean_depth"), F.try_divide(covered, n).alias("breadth"))


def insert_sizes(hist: DataFrame) -> DataFrame:
    """hist: sample, size, n. Per sample: n, mean and (population) deviation of the sizes, from three sums."""
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("size")), F.sum(F.col("n") * F.col("size") * F.col("size"))
    df = hist.groupBy("sample").agg(n.alias("n"), s.cast("double").alias("s"), q.cast("double").alias("q"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    return df.select("sample", "n", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0))).alias("sd"))


def confidence_bands(residues: DataFrame) -> DataFrame:
    """residues: structure, confidence. Per structure the percentage of residues in each of BANDS, and n."""
    ends = [None, *[low for _, low in BANDS[:-1]]]
    c = F.col("confidence")
    share = [F.round(100 * F.count_if((c >= low) & (F.lit(True) if top is None else c < top)) / F.count("*"), 6).alias(name) for (name, low), top in zip(BANDS, ends, strict=True)]
    return residues.where(c.isNotNull()).groupBy("structure").agg(F.count("*").alias("n"), *share)


def probe_means(values: DataFrame, separator: str = "_") -> DataFrame:
    """values: probe, sample_id, value. The mean over replicate probes, which share what stands before the separator."""
    return values.withColumn("probe", F.substring_index("probe", separator, 1)).groupBy("probe", "sample_id").agg(F.count("value").alias("n"), F.avg("value").alias("value"))


def population_by_generation(people: DataFrame) -> DataFrame:
    """people: id, generation, sex, health. Per generation: n, sex_ratio (share of males), health mean, least and most."""
    h = F.coalesce("health", F.lit(1.0))
    return people.groupBy("generation").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("sex") == "Male") / F.count("*"), 4).alias("sex_ratio"), F.round(F.avg(h), 4).alias("health_mean"), F.round(F.min(h), 4).alias("health_least"), F.round(F.max(h), 4).alias("health_most"))


def trait_drift(people: DataFrame, traits: DataFrame) -> DataFrame:
    """traits: id, trait, score. Per generation and trait: mean and population deviation; a person without a score of the
    trait counts as 0.5 (if there are scores of that person at all)."""
    scored = people.select("id", "generation").join(traits.select("id").distinct(), "id", "left_semi").groupBy("generation").agg(F.count("*").alias("n_all"))
    s = F.col("score").cast("double")
    own = traits.join(people.select("id", "generation"), "id").groupBy("generation", "trait").agg(F.count("*").alias("n"), F.sum(s).alias("s"), F.sum(s * s).alias("q"))
    blank = F.col("n_all") - F.col("n")
    df = own.join(scored, "generation").withColumn("mean", (F.col("s") + 0.5 * blank) / F.col("n_all"))
    sd = F.sqrt(F.greatest((F.col("q") + 0.25 * blank) / F.col("n_all") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return df.select("generation", "trait", F.round("mean", 4).alias("mean"), F.round(sd, 4).alias("sd"))


def allele_drift(people: DataFrame, calls: DataFrame) -> DataFrame:
    """calls: id, locus, dosage (copies of the alternative allele). Per generation and locus: af over the calls that are
    there, and n of them."""
    known = calls.where("dosage is not null").join(people.select("id", "generation"), "id")
    return known.groupBy("generation", "locus").agg(F.count("*").alias("n"), F.round(F.sum("dosage") / (2 * F.count("*")), 4).alias("af"))


def diversity(people: DataFrame, calls: DataFrame) -> DataFrame:
    """Per generation the mean over people of the share of their loci that are heterozygous; people without calls are left
    out."""
    own = calls.where("dosage is not null").groupBy("id").agg((F.count_if(F.col("dosage") == 1) / F.count("*")).alias("het"))
    return own.join(people.select("id", "generation"), "id").groupBy("generation").agg(F.count("*").alias("n"), F.round(F.avg("het"), 4).alias("heterozygosity"))


def mutation_burden(people: DataFrame, mutations: DataFrame) -> DataFrame:
    """mutations: id, kind. Per generation: total, disease_risk, protective, neutral (all other kinds); 0 where there is none."""
    k = F.coalesce("kind", F.lit("neutral"))
    own = mutations.join(people.select("id", "generation"), "id").groupBy("generation").agg(F.count("*").alias("total"), F.count_if(k == "disease_risk").alias("disease_risk"), F.count_if(k == "protective").alias("protective"))
    df = people.select("generation").distinct().join(own, "generation", "left").fillna(0, ["total", "disease_risk", "protective"])
    return df.withColumn("neutral", F.col("total") - F.col("disease_risk") - F.col("protective"))


def prevalence(people: DataFrame, conditions: DataFrame) -> DataFrame:
    """conditions: id, condition. Per generation and condition: n (rows, as often as they are recorded) and share of people."""
    size = people.groupBy("generation").agg(F.countDistinct("id").alias("n_people"))
    own = conditions.join(people.select("id", "generation"), "id").groupBy("generation", "condition").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    return own.join(size, "generation").select("generation", "condition", "n", F.round(F.col("d") / F.col("n_people"), 6).alias("share"))


def inferred_traits(people: DataFrame, calls: DataFrame, registry: DataFrame) -> DataFrame:
    """calls: id, locus, dosage. registry: trait, locus, dominance, effect (a panel). Per person and trait: the mean of the
    loci that the person has, weighted by effect: half the copies (additive, and any other word), one copy or more
    (dominant), two copies (recessive); 0.5 without any."""
    d = F.col("dosage")
    score = F.when(F.col("dominance") == "dominant", (d >= 1).cast("double")).when(F.col("dominance") == "recessive", (d == 2).cast("double")).otherwise(d * 0.5)
    own = calls.where("dosage is not null").join(registry, "locus").groupBy("id", "trait").agg(F.sum(score * F.col("effect")).alias("s"), F.sum("effect").alias("w"))
    names = registry.agg(F.collect_set("trait").alias("t"))  # one row of the panel's traits
    grid = people.select("id").distinct().join(F.broadcast(names)).select("id", F.explode("t").alias("trait"))
    value = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.5)
    return grid.join(own, ["id", "trait"], "left").select("id", "trait", F.round(value, 4).alias("value"))


def lead_recovery(found: DataFrame, lead: DataFrame) -> DataFrame:
    """found: run, variant. lead: variant, gene. Per run: n_lead, n_recovered, recovery, recovered and missed genes (in
    order, comma-joined). A gene is missed where fewer of its variants are found than it has, so that only counts by run
    and gene meet."""
    led, own = lead.where("variant is not null").select("variant", "gene").distinct(), stored(found.select("run", "variant").distinct())
    hits = own.join(led, "variant").select(F.col("run").alias("_run"), "variant", F.col("gene").alias("_gene"))
    total = lead.agg(F.countDistinct("variant").alias("n_lead"))
    n = hits.where("_gene is not null").groupBy("_run").agg(F.countDistinct("variant").alias("n_recovered"))
    each = hits.groupBy("_run", "_gene").agg(F.count("*").alias("h"))
    runs = own.select("run").distinct()
    grid = runs.crossJoin(led.groupBy("gene").agg(F.count("*").alias("k"))).join(each, F.col("run").eqNullSafe(F.col("_run")) & F.col("gene").eqNullSafe(F.col("_gene")), "left")
    h = F.coalesce("h", F.lit(0))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("gene")))), ",")
    genes = grid.groupBy(F.col("run").alias("_of")).agg(listed(h > 0).alias("recovered"), listed(h < F.col("k")).alias("missed"))
    df = runs.join(n, F.col("run").eqNullSafe(F.col("_run")), "left").join(genes, F.col("run").eqNullSafe(F.col("_of")), "left").crossJoin(F.broadcast(total)).withColumn("n_recovered", F.coalesce("n_recovered", F.lit(0)))
    return df.select("run", "n_lead", "n_recovered", F.round(F.try_divide("n_recovered", "n_lead"), 4).alias("recovery"), F.coalesce("recovered", F.lit("")).alias("recovered"), F.coalesce("missed", F.lit("")).alias("missed"))


def method_scores(results: DataFrame, causal: DataFrame) -> DataFrame:
    """results: method, locus, variant, pip, in_set. causal: locus, variant. Per method and locus: causal variants captured by
    credible sets, the sum of their pips, their mean rank by pip (equal pips by variant), the sets' size, precision, recall,
    f1 and the weighted score of METHOD_WEIGHTS."""
    w = W.partitionBy("method", "locus")
    df = results.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("pip"), "variant")), "n": F.count("*").over(w)})
    df = df.join(causal.select("locus", "variant", F.lit(True).alias("causal")).distinct(), ["locus", "variant"], "left")
    c, inside = F.coalesce("causal", F.lit(False)), F.coalesce("in_set", F.lit(False))
    g = df.groupBy("method", "locus").agg(F.count_if(c & inside).alias("captured"), F.sum(F.when(c, F.col("pip")).otherwise(0.0)).alias("pip"), F.avg(F.when(c, F.col("rank"))).alias("rank"), F.count_if(inside).alias("size"), F.max("n").alias("n"))
    total = causal.distinct().groupBy("locus").agg(F.count("*").alias("n_causal"))
    g = g.join(total, "locus")
    p = F.coalesce(F.try_divide("captured", "size"), F.lit(0.0))
    r = F.col("captured") / F.col("n_causal")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    rank = F.coalesce("rank", F.col("n").cast("double"))
    k = METHOD_WEIGHTS
    total = k["recall"] * r + k["pip"] * F.col("pip") / F.col("n_causal") + k["precision"] * p + k["rank"] * (1 - rank / F.col("n"))
    return g.select("method", "locus", "captured", "n_causal", F.round("pip", 4).alias("causal_pip"), F.round(rank, 1).alias("mean_rank"), "size", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), F.round(total, 4).alias("score"))


def passes(scores: DataFrame, least: dict[str, float]) -> DataFrame:
    """scores with passed: whether each named column reaches its least value; null doesn't."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in least.items()], F.lit(True))
    return scores.withColumn("passed", ok)


def counts_by_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n: the counts of several columns, by grouping sets over one scan; nulls and empty values are left out."""
    small = df.select(*[F.col(f).cast("string").alias(f) for f in fields])
    counted = small.groupingSets([[F.col(f)] for f in fields], *fields).agg(F.grouping_id().alias("_id"), F.count("*").alias("n"))
    # Of a set only its own column's bit is clear.
    full = (1 << len(fields)) - 1
    own = [(f, full - (1 << (len(fields) - 1 - i))) for i, f in enumerate(fields)]
    name = F.coalesce(*[F.when(F.col("_id") == i, f) for f, i in own])
    return counted.select(name.alias("field"), F.coalesce(*[F.when(F.col("_id") == i, F.col(f)) for f, i in own]).alias("value"), "n").where("value is not null and value <> ''")


def notable_non_flagged(ranked: DataFrame, tiers: list[str], most: int = 5) -> DataFrame:
    """ranked: variant_id, score, consequence_rank, flagged, annotated, tier. The first `most` variants, by falling score, then
    rank and id, that are annotated and not flagged but of one of the tiers."""
    return ranked.where(~F.col("flagged") & F.col("annotated") & F.col("tier").isin(tiers)).orderBy(F.desc("score"), "consequence_rank", "variant_id").limit(most)


def composition(seqs: DataFrame, letters: str) -> DataFrame:
    """seqs: id, seq. id, letter, n, pct of each of the letters in the sequence (a-z count as A-Z). A sequence's bytes are
    counted once for all letters; where letters aren't all of ASCII, each is found by a difference of lengths."""
    if not letters.isascii():
        s = F.translate(F.coalesce("seq", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        each = F.array(*[F.struct(F.lit(x).alias("letter"), (F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))).cast("bigint").alias("n")) for x in letters])
        return seqs.select("id", F.length(s).alias("_n"), F.explode(each).alias("x")).select("id", "x.letter", "x.n", F.round(100 * F.try_divide(F.col("x.n"), F.col("_n")), 6).alias("pct"))
    kind, upper = dict(seqs.dtypes)["id"], np.arange(256)
    upper[97:123] -= 32
    code = np.frombuffer(letters.encode(), np.uint8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                few = batch.slice(at, 1024)
                n = np.zeros((few.num_rows, 256), np.int64)
                for i, text in enumerate(few.column("seq").cast(pa.binary())):
                    data = np.frombuffer(text.as_buffer() or b"", np.uint8)
                    for start in range(0, len(data), 1 << 20):
                        n[i] += np.bincount(data[start : start + (1 << 20)], minlength=256)
                # Bytes 128 to 191 go on with a letter.
                length = n[:, :128].sum(axis=1) + n[:, 192:].sum(axis=1)
                folded = np.zeros_like(n)
                np.add.at(folded.T, upper, n.T)
                each = np.repeat(np.arange(few.num_rows), len(code))
                yield pa.RecordBatch.from_arrays([few.column("id").take(pa.array(each)), pa.array(list(letters) * few.num_rows, pa.string()), pa.array(folded[:, code].ravel()), pa.array(length[each])], names=["id", "letter", "n", "_n"])

    counted = seqs.select("id", "seq").mapInArrow(count, f"id {kind}, letter string, n bigint, _n bigint")
    return counted.select("id", "letter", "n", F.round(100 * F.try_divide(F.col("n"), F.col("_n")), 6).alias("pct"))


def nucleotide_stats(seqs: DataFrame) -> DataFrame:
    """seqs: id, seq. Per sequence its length, counts and percentages of A, C, G and T, gc and at content."""
    s = F.translate(F.coalesce("seq", F.lit("")), "acgt", "ACGT")
    n = {x: (F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))).cast("bigint") for x in "ACGT"}
    length = F.greatest(F.length(s), F.lit(1))
    pct = lambda c: F.round(100 * c / length, 2)
    return seqs.select("id", F.length(s).cast("bigint").alias("length"), *[c.alias(f"n_{x.lower()}") for x, c in n.items()], *[pct(c).alias(f"pct_{x.lower()}") for x, c in n.items()], pct(n["G"] + n["C"]).alias("gc"), pct(n["A"] + n["T"]).alias("at"))


def length_summary(stats: DataFrame) -> DataFrame:
    """One row of nucleotide_stats(): n, total, least, most and mean length, mean gc."""
    return stats.agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.min("length").alias("least"), F.max("length").alias("most"), F.round(F.avg("length"), 1).alias("mean"), F.round(F.avg("gc"), 2).alias("mean_gc"))


def _pair_counts(codes: np.ndarray, doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of n and smallest places of equal (doc, pair of letters)."""
    order = np.lexsort((codes, doc))
    codes, doc, place, n = codes[order], doc[order], place[order], n[order]
    new = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[new], doc[new], np.minimum.reduceat(place, new) if len(new) else place, np.add.reduceat(n, new) if len(new) else n


def _letter_pairs(texts: list[str | None], piece: int) -> tuple[np.ndarray, ...]:
    """Of each text the different pairs of neighbouring letters (as first << 21 | second): pair, text, first place (from 1)
    and number. Long texts are counted by pieces."""
    out = [(np.zeros(0, np.int64),) * 4]
    for number, text in enumerate(texts):
        letters = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letters[(letters >= 97) & (letters <= 122)] -= 32
        for at in range(0, len(letters) - 1, piece):
            own = letters[at : at + piece + 1]
            pair, first, n = np.unique(own[:-1] << 21 | own[1:], return_index=True, return_counts=True)
            out.append((pair, np.full(len(pair), number), first + at + 1, n))
    return _pair_counts(*(np.concatenate(x) for x in zip(*out, strict=True)))


def top_pairs(seqs: DataFrame, most: int = 5, piece: int = 10_000) -> DataFrame:
    """seqs: id, seq. Each sequence's `most` frequent pairs of neighbouring letters (a-z as A-Z; overlaps count): id, pair, n,
    rank; equally frequent ones in order of their first place. Rows that share an id are one sequence's.

    A task counts the pairs of a sequence where it lies, long ones piece by piece, and hands on the best; only of ids that
    several rows share (found by the ids alone) all different pairs go on to be added up."""
    kind = dict(seqs.dtypes)["id"]
    # Stored, so that its size is known and few of them are broadcast: then texts stay where they are.
    shared = stored(seqs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.lit(True).alias("whole")))
    rows = seqs.where(F.length("seq") > 1).join(shared, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "seq", F.coalesce("whole", F.lit(False)).alias("whole"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                pair, doc, first, n = _letter_pairs(few.column("seq").to_pylist(), piece)
                order = np.lexsort((first, -n, doc))
                pair, doc, first, n = (x[order] for x in (pair, doc, first, n))
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
                keep = (rank < most) | few.column("whole").to_numpy(zero_copy_only=False)[doc]
                letters = np.stack([pair[keep] >> 21, pair[keep] & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                whole = few.take(pa.array(doc[keep]))
                yield pa.RecordBatch.from_arrays([whole.column("id"), pa.array([letters[i : i + 2] for i in range(0, len(letters), 2)], pa.string()), pa.array(n[keep]), pa.array(first[keep]), pa.array((rank[keep] + 1).astype(np.int32)), whole.column("whole")], names=["id", "pair", "n", "first", "rank", "whole"])

    found = stored(rows.mapInArrow(count, f"id {kind}, pair string, n bigint, first bigint, rank int, whole boolean"))
    added = found.where("whole").groupBy("id", "pair").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    added = added.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= most)
    return found.where("not whole").select("id", "pair", "n", "rank").union(added.select("id", "pair", "n", "rank"))
