"""Variant interpretation: frequency fields, priority tiers, ACMG criteria, panels, nutrition and resistance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Consequence terms from the most to the least severe.
SEVERITY = [
    "transcript_ablation", "splice_acceptor_variant", "splice_donor_variant", "stop_gained", "frameshift_variant",
    "stop_lost", "start_lost", "transcript_amplification", "feature_elongation", "feature_truncation",
    "inframe_insertion", "inframe_deletion", "missense_variant", "protein_altering_variant",
    "splice_donor_5th_base_variant", "splice_region_variant", "splice_donor_region_variant",
    "splice_polypyrimidine_tract_variant", "incomplete_terminal_codon_variant", "start_retained_variant",
    "stop_retained_variant", "synonymous_variant", "coding_sequence_variant", "mature_miRNA_variant",
    "5_prime_UTR_variant", "3_prime_UTR_variant", "non_coding_transcript_exon_variant", "intron_variant",
    "NMD_transcript_variant", "non_coding_transcript_variant", "coding_transcript_variant", "upstream_gene_variant",
    "downstream_gene_variant", "TFBS_ablation", "TFBS_amplification", "TF_binding_site_variant",
    "regulatory_region_ablation", "regulatory_region_amplification", "regulatory_region_variant", "intergenic_variant",
]
# Scores of impacts and of ClinVar buckets.
IMPACT = {"HIGH": 4, "MODERATE": 3, "LOW": 2, "MODIFIER": 1}
BUCKETS = {"pathogenic_or_likely_pathogenic": 4, "conflicting": 2, "risk_factor": 2, "drug_response": 2, "other_or_uncertain": 1, "benign_or_likely_benign": 0}
PATHOGENIC = ["pathogenic", "likely_pathogenic"]
# Resistance tiers in order, each with gene families before drug classes.
TIERS = [
    ("Critical", ["NDM", "OXA-48", "KPC", "VIM", "IMP", "CTX-M", "SHV", "TEM"], ["carbapenem", "cephalosporin"]),
    ("High", ["VanA", "VanB", "mecA", "mecC", "QnrA", "QnrB", "QnrS", "GyrA", "ParC"], ["vancomycin", "methicillin", "clarithromycin", "fluoroquinolone"]),
    ("Medium", ["PBP", "TEM", "ROB"], ["penicillin", "ampicillin"]),
]


def _mapped(values: dict, key: Column, default=None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def severity_rank(consequence: Column) -> Column:
    """0 for the most severe; null for a term that isn't ranked."""
    at = F.array_position(F.array(*map(F.lit, SEVERITY)), consequence)
    return F.when(at > 0, at.cast("int") - 1)


def impact_tier(impact: Column) -> Column:
    return F.when(F.upper(impact).isin(list(IMPACT)), F.upper(impact)).otherwise("UNKNOWN")


def is_pathogenic(clinvar: Column) -> Column:
    parts = F.transform(F.split(F.lower(F.translate(clinvar, ";", "/")), "/"), F.trim)
    return F.coalesce(F.arrays_overlap(parts, F.array(*map(F.lit, PATHOGENIC))), F.lit(False))


def clinvar_bucket(clinvar: Column) -> Column:
    low = F.lower(clinvar)
    return (
        F.when(F.coalesce(clinvar, F.lit("")) == "", "other_or_uncertain").when(low.contains("conflict"), "conflicting").when(is_pathogenic(clinvar), "pathogenic_or_likely_pathogenic")
        .when(low.contains("benign"), "benign_or_likely_benign").when(low.rlike("risk[_ ]factor"), "risk_factor").when(low.rlike("drug[_ ]response"), "drug_response").otherwise("other_or_uncertain")
    )


def frequency_fields(freqs: Column) -> dict[str, Column]:
    """Of a map population -> frequency: least gnomAD value, largest, spread, whether the spread is 0.05 or more, the
    population of the largest, and a summary by falling frequency."""
    values = F.map_values(freqs)
    gnomad = F.map_values(F.map_filter(freqs, lambda k, v: F.lower(k).contains("gnomad")))
    entries = F.array_sort(F.transform(F.map_entries(freqs), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    summary = F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), F.round(-e["v"], 6).cast("string"))), ";")
    spread = F.array_max(values) - F.array_min(values)
    return {"gnomad_min": F.array_min(gnomad), "max_af": F.array_max(values), "spread": spread, "outlier": F.coalesce(spread >= 0.05, F.lit(False)), "top_population": F.element_at(F.transform(entries, lambda e: e["k"]), 1), "summary": summary}


def prioritised(variants: DataFrame) -> DataFrame:
    """variants: consequence, impact, clinvar, gnomad_af, outlier. Adds the rank, tier and bucket of each field, the
    priority score, Tier 1-4 and the reasons for review."""
    df = variants.withColumns({"severity": severity_rank(F.col("consequence")), "impact_tier": impact_tier(F.col("impact")), "bucket": clinvar_bucket(F.col("clinvar")), "rare": F.coalesce(F.col("gnomad_af") < 0.001, F.lit(False))})
    df = df.withColumn("relevant", F.col("rare") & is_pathogenic(F.col("clinvar")))
    score = 10 * _mapped(IMPACT, F.col("impact_tier"), 0) + 15 * _mapped(BUCKETS, F.col("bucket"), 0) + F.when(F.col("rare"), 20).otherwise(0) + F.when(F.col("outlier"), 10).otherwise(0) + F.coalesce(F.greatest(F.lit(0), 40 - F.col("severity")), F.lit(0))
    strong = F.col("impact_tier").isin("HIGH", "MODERATE")
    tier = (
        F.when(F.col("relevant"), "Tier 1").when(strong & (F.col("rare") | F.col("bucket").isin("conflicting", "other_or_uncertain")), "Tier 2")
        .when(F.col("bucket").isin("risk_factor", "drug_response") | F.col("impact_tier").isin("LOW", "MODERATE"), "Tier 3").otherwise("Tier 4")
    )
    reasons = F.array_compact(F.array(F.when(F.col("relevant"), "rare_pathogenic_clinvar"), F.when(F.col("impact_tier") == "HIGH", "high_impact"), F.when(F.col("impact_tier") == "MODERATE", "moderate_impact"), F.when(F.col("outlier"), "population_frequency_outlier"), F.when(F.col("bucket").isin("risk_factor", "drug_response", "conflicting"), F.col("bucket"))))
    return df.withColumns({"score": score, "tier": tier, "reasons": F.array_join(reasons, ";")})


def acmg(ev: DataFrame) -> DataFrame:
    """ev: consequence, impact, clinvar, stars, gnomad_af, cadd, sift, polyphen, splice_delta. Adds a boolean column for
    each of 12 criteria and the class by the published combining rules."""
    low, cons = F.lower(F.coalesce("clinvar", F.lit(""))), F.col("consequence")
    missense = cons == "missense_variant"
    known = low.contains("pathogenic") & ~low.contains("conflicting")
    stars = F.coalesce(F.col("stars") >= 2, F.lit(False))

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    flags = {
        "pvs1": cons.isin("stop_gained", "frameshift_variant", "splice_acceptor_variant", "splice_donor_variant", "start_lost", "transcript_ablation"),
        "ps1": missense & known & stars,
        "pm1": missense & (F.col("impact") == "HIGH"),
        "pm2": F.col("gnomad_af").isNull() | (F.col("gnomad_af") < 0.0001),
        "pm4": cons.isin("inframe_insertion", "inframe_deletion", "stop_lost"),
        "pp3": missense & (sure(F.col("cadd") >= 25.3) | sure(F.col("sift").isin("deleterious", "deleterious_low_confidence")) | sure(F.col("polyphen").isin("probably_damaging", "possibly_damaging"))),
        "pp5": known & stars,
        "ba1": F.col("gnomad_af") > 0.05,
        "bs1": F.col("gnomad_af") > 0.01,
        "bp4": sure(F.col("cadd") < 15) | sure(F.col("sift") == "tolerated") | sure(F.col("polyphen") == "benign"),
        "bp6": low.contains("benign") & ~low.contains("pathogenic") & stars,
        "bp7": (cons == "synonymous_variant") & F.coalesce(F.col("splice_delta") < 0.1, F.lit(True)),
    }
    df = ev.withColumns({k: sure(v) for k, v in flags.items()})

    def n(*names: str) -> Column:
        return sum((F.col(x).cast("int") for x in names), F.lit(0))

    very, strong, moderate, support = n("pvs1"), n("ps1"), n("pm1", "pm2", "pm4"), n("pp3", "pp5")
    against, weakly = n("bs1"), n("bp4", "bp6", "bp7")
    pathogenic = (very >= 1) & ((strong >= 1) | (moderate >= 2) | ((moderate >= 1) & (support >= 1)) | (support >= 2)) | (strong >= 2) | (strong >= 1) & ((moderate >= 3) | ((moderate >= 2) & (support >= 2)) | ((moderate >= 1) & (support >= 4)))
    likely = (moderate >= 1) & ((very >= 1) | (strong >= 1)) | (strong >= 1) & (support >= 2) | (moderate >= 3) | (moderate >= 2) & (support >= 2) | (moderate >= 1) & (support >= 4)
    for_, not_ = very + strong + moderate + support > 0, against + weakly > 0
    label = (
        F.when(F.col("ba1") | (against >= 2), "Benign").when(for_ & not_, "Uncertain Significance").when(pathogenic, "Pathogenic").when(likely, "Likely Pathogenic")
        .when(((against >= 1) & (weakly >= 1)) | (weakly >= 2), "Likely Benign").otherwise("Uncertain Significance")
    )
    return df.withColumn("acmg_class", label)


def with_evidence(variants: DataFrame, evidence: DataFrame, defaults: dict) -> DataFrame:
    """Variants with their evidence by chrom, pos, ref and alt; where there is none, the defaults."""
    return variants.join(evidence, ["chrom", "pos", "ref", "alt"], "left").fillna(defaults)


def best_per_variant(consequences: DataFrame) -> DataFrame:
    """One consequence of each variant: by severity, canonical, MANE, with a gene, then transcript."""
    w = W.partitionBy("variant_id").orderBy(F.coalesce(severity_rank(F.col("consequence")), F.lit(len(SEVERITY))), F.col("canonical").desc(), F.col("mane").desc(), F.col("gene").isNull(), "transcript")
    return consequences.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def counts_by_field(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n: the counts of several columns in one pass, by grouping sets."""
    sets = [F.when(F.lit(True), F.col(f).cast("string")).alias(f) for f in fields]
    small = df.select(*sets)
    rows = small.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x"))
    return rows.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def nutrient_scores(genotypes: DataFrame, panel: DataFrame) -> DataFrame:
    """genotypes: sample_id, variant_id, genotype. panel: variant_id, domain, risk_allele, ref_allele, weight. Per sample
    and domain: the weighted risk from 0 to 10, its category, and the panel's variants tested. A genotype with other
    alleles than the panel's counts as not tested. Domains without any tested variant have no row."""
    df = genotypes.join(panel, "variant_id")
    g = F.col("genotype")
    risk, ref = (F.length(g) - F.length(F.replace(g, F.col(c), F.lit(""))) for c in ("risk_allele", "ref_allele"))
    tested = df.where(g.isNotNull()).withColumn("risk", risk).where(risk + ref == 2)
    sums = tested.groupBy("sample_id", "domain").agg(F.sum(F.col("risk") / 2 * F.col("weight")).alias("s"), F.sum("weight").alias("w"), F.count("*").alias("n_tested"))
    score = F.round(F.col("s") / F.col("w") * 10, 2)
    total = panel.groupBy("domain").agg(F.count("*").alias("n_panel"))
    out = sums.join(F.broadcast(total), "domain").withColumn("score", score)
    category = F.when(F.col("score") < 3.5, "Low").when(F.col("score") < 6.5, "Moderate").otherwise("Elevated")
    return out.select("sample_id", "domain", "score", category.alias("category"), "n_tested", (F.col("n_panel") - F.col("n_tested")).alias("n_missing"))


def gene_nutrient_matrix(genotypes: DataFrame, panel: DataFrame, domains: list[str]) -> DataFrame:
    """panel as in nutrient_scores(), with gene. One row a gene: the mean raw risk (0, 0.5 or 1 for none, one or two risk
    alleles) over samples and variants for each of the domains, 0 where nothing was tested."""
    g = F.col("genotype")
    risk, ref = (F.length(g) - F.length(F.replace(g, F.col(c), F.lit(""))) for c in ("risk_allele", "ref_allele"))
    raw = genotypes.where(g.isNotNull()).join(panel, "variant_id").where(risk + ref == 2).select("gene", "domain", (risk / 2).alias("raw"))
    mean = lambda d: F.coalesce(F.avg(F.when(F.col("domain") == d, F.col("raw"))), F.lit(0.0)).alias(d)
    return raw.groupBy("gene").agg(*[mean(d) for d in domains])


def panel_status(samples: DataFrame, genotypes: DataFrame, panel: DataFrame) -> DataFrame:
    """Each sample's status at each panel variant: not_tested, no_call, allele_mismatch or found. The panel is a constant
    list, so every sample gets one row for each of its variants."""
    pairs = samples.select("sample_id").distinct().join(F.broadcast(panel.withColumn("_one", F.lit(1))), F.lit(True))
    g = genotypes.select("sample_id", "variant_id", "genotype", F.lit(True).alias("_row"))
    df = pairs.join(g, ["sample_id", "variant_id"], "left")
    own = F.length(F.col("genotype")) - F.length(F.replace(F.col("genotype"), F.col("risk_allele"), F.lit(""))) + F.length(F.col("genotype")) - F.length(F.replace(F.col("genotype"), F.col("ref_allele"), F.lit("")))
    status = F.when(F.col("_row").isNull(), "not_tested").when(F.col("genotype").isNull(), "no_call").when(own < 2, "allele_mismatch").otherwise("found")
    return df.select("sample_id", "variant_id", status.alias("status"))


def resistance_tier(gene: Column, drug_class: Column) -> Column:
    """The first tier of which a gene family or, failing those, a drug class is in the name."""
    out = F.lit("Not classified")
    for tier, families, drugs in reversed(TIERS):
        hit = F.lit(False)
        for f in families:
            hit = hit | F.lower(gene).contains(f.lower())
        for d in drugs:
            hit = hit | F.lower(drug_class).contains(d)
        out = F.when(F.coalesce(hit, F.lit(False)), tier).otherwise(out)
    return out


def drug_matches(queries: DataFrame, drugs: DataFrame) -> DataFrame:
    """queries: query. drugs: drug, brand (a constant list). The best match of each query: exact name, brand, part of a
    name, or within two edits."""
    q, d, b = F.lower("query"), F.lower("drug"), F.lower("brand")
    tier = F.when(q == d, 1).when(q == b, 2).when(d.contains(q) | q.contains(d), 3).when(F.levenshtein(q, d) <= 2, 4)
    df = queries.join(F.broadcast(drugs), F.lit(True)).withColumn("tier", tier).where("tier is not null")
    best = df.groupBy("query").agg(F.min(F.struct("tier", F.levenshtein(q, d).alias("edits"), "drug")).alias("x"))
    return best.select("query", F.col("x.drug").alias("drug"), F.col("x.tier").alias("tier"))


def in_panel(variants: DataFrame, panel: DataFrame, secondary: list[str] | None = None) -> DataFrame:
    """The variants of the panel's genes (gene; a constant list), with secondary_finding: whether the gene is listed."""
    out = variants.join(F.broadcast(panel.select("gene").distinct()), "gene", "left_semi")
    return out.withColumn("secondary_finding", F.col("gene").isin(*(secondary or [])) if secondary else F.lit(False))


def by_impact(variants: DataFrame) -> DataFrame:
    """impact (upper case), impact_rank (HIGH, MODERATE, LOW, others), n and n_pathogenic, in order of the rank."""
    impact = F.upper("impact")
    rank = F.when(impact == "HIGH", 0).when(impact == "MODERATE", 1).when(impact == "LOW", 2).otherwise(3)
    df = variants.groupBy(impact.alias("impact"), rank.alias("impact_rank")).agg(F.count("*").alias("n"), F.count_if(F.lower("clinvar").contains("pathogenic")).alias("n_pathogenic"))
    return df.orderBy("impact_rank", "impact")
