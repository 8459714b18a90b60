"""Pharmacogenomics: diplotypes, phenotypes and drug recommendations from panel genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Alternative alleles that a genotyping array can't test.
STRUCTURAL = ("DEL", "INS", "TA7")


def diplotypes(genotypes: DataFrame, panel: DataFrame) -> DataFrame:
    """genotypes: sample_id, variant_id, genotype. panel: gene, variant_id, star, alt, activity (0 for no function), and
    kind if there is one (star, dpyd or genotype; star if not); a constant list. Per sample and gene with a tested
    variant: diplotype, n_tested and n_panel (structural variants count in neither), activity.

    star: of the detected alleles, those without function first, the first two (or the first twice, if homozygous), *1 for
    what isn't there, in order of their names. Indeterminate (no activity) are a heterozygous call of a structural variant,
    and two or more heterozygous variants of which one has no function, because their phase is unknown. dpyd: the first
    detected variant with Normal, or twice. genotype: the call of the gene's variant as it is."""
    kind = F.coalesce(F.col("kind"), F.lit("star")) if "kind" in panel.columns else F.lit("star")
    listed = panel.select("gene", "variant_id", "star", F.upper("alt").alias("alt"), "activity", kind.alias("kind"))
    df = genotypes.where("genotype is not null").join(F.broadcast(listed), "variant_id")
    structural = F.col("alt").isin(*STRUCTURAL)
    copies = F.length("genotype") - F.length(F.replace(F.col("genotype"), F.col("alt"), F.lit("")))
    hetero = F.size(F.array_distinct(F.split("genotype", ""))) > 1
    seen = F.struct((F.col("activity") != 0).alias("later"), "variant_id", "star", "activity", copies.alias("copies"))
    own = df.groupBy("sample_id", "gene").agg(
        F.first("kind").alias("kind"), F.count_if(~structural).alias("n_tested"), F.bool_or(structural & hetero).alias("_sv"),
        F.array_sort(F.collect_list(F.when(~structural & (copies > 0), seen))).alias("found"), F.min_by("genotype", "variant_id").alias("_call"),
    ).where("n_tested > 0")
    total = listed.where(~structural).groupBy("gene").agg(F.count("*").alias("n_panel"))
    df = own.join(F.broadcast(total), "gene")
    one, two = F.get("found", F.lit(0)), F.get("found", F.lit(1))
    het = F.filter("found", lambda x: x["copies"] == 1)
    phase = (F.size(het) >= 2) & F.exists(het, lambda x: x["activity"] == 0)
    other = F.when(one["copies"] >= 2, one).otherwise(two)
    pair = F.array_sort(F.array(F.coalesce(one["star"], F.lit("*1")), F.coalesce(other["star"], F.lit("*1"))))
    by_id = F.array_sort("found", lambda x, y: F.when(x["variant_id"] < y["variant_id"], -1).when(x["variant_id"] > y["variant_id"], 1).otherwise(0))
    first = F.get(by_id, F.lit(0))
    dpyd = F.when(first.isNull(), "Normal/Normal").when(first["copies"] == 2, F.concat_ws("/", first["star"], first["star"])).otherwise(F.concat(F.lit("Normal/"), first["star"]))
    unsure = F.when(F.col("_sv"), "indeterminate (structural variant)").when((F.col("kind") == "star") & phase, "indeterminate (phase)")
    name = F.when(F.col("kind") == "genotype", F.col("_call")).when(unsure.isNotNull(), unsure).when(F.col("kind") == "dpyd", dpyd).otherwise(F.array_join(pair, "/"))
    at = F.when(F.col("kind") == "dpyd", F.coalesce(first["activity"], F.lit(1.0)) + F.when(first["copies"] == 2, first["activity"]).otherwise(F.lit(1.0))).otherwise(F.coalesce(one["activity"], F.lit(1.0)) + F.coalesce(other["activity"], F.lit(1.0)))
    return df.select("sample_id", "gene", name.alias("diplotype"), "n_tested", "n_panel", F.when(unsure.isNull() & (F.col("kind") != "genotype"), at).alias("activity"))


def mthfr(genotypes: DataFrame, id_677: str, id_1298: str) -> DataFrame:
    """sample_id, diplotype like 677CT/1298AC: both sites on the gene's strand (C>T and A>C), bases in order. A call of the
    other strand's bases only (G, A; T, G) is flipped; a site without a call is NOT_TESTED, a sample without both has no row."""

    def site(id_: str, plus: str) -> Column:
        call = F.max(F.when(F.col("variant_id").cast("string") == id_, F.upper("genotype")))
        flipped = F.when(call.rlike(f"^[{plus}]+$"), F.translate(call, "ACGT", "TGCA")).otherwise(call)
        return F.array_join(F.array_sort(F.split(flipped, "")), "")

    df = genotypes.where("genotype is not null").where(F.col("variant_id").cast("string").isin(id_677, id_1298)).groupBy("sample_id").agg(site(id_677, "GA").alias("a"), site(id_1298, "TG").alias("b"))
    return df.select("sample_id", F.concat(F.lit("677"), F.coalesce("a", F.lit("NOT_TESTED")), F.lit("/1298"), F.coalesce("b", F.lit("NOT_TESTED"))).alias("diplotype"))


def genome_build(calls: DataFrame, expected: DataFrame, tolerance: int = 0) -> DataFrame:
    """calls: sample_id, variant_id, pos. expected: variant_id, expected_pos of the build asked for (a constant list). Per
    sample with a position above 0 at a listed variant: n_match (within the tolerance), n_mismatch, and other_build (two
    mismatches at least, and no fewer than matches)."""
    near = F.abs(F.col("pos") - F.col("expected_pos")) <= tolerance
    df = calls.where("pos > 0").join(F.broadcast(expected), "variant_id").groupBy("sample_id").agg(F.count_if(near).alias("n_match"), F.count_if(~near).alias("n_mismatch"))
    return df.withColumn("other_build", (F.col("n_mismatch") >= 2) & (F.col("n_mismatch") >= F.col("n_match")))


def phenotypes(calls: DataFrame) -> DataFrame:
    """Adds the phenotype by activity; partial panels and unknown phases are indeterminate where nothing was detected."""
    a = F.col("activity")
    by_activity = F.when(a == 0, "poor").when(a < 1.25, "intermediate").when(a <= 2.25, "normal").otherwise("rapid")
    partial = (F.col("n_tested") < F.col("n_panel")) & F.col("diplotype").isin("*1/*1", "Normal/Normal")
    return calls.withColumn("phenotype", F.when(a.isNull() | partial, "indeterminate").otherwise(by_activity))


def recommendations(samples: DataFrame, calls: DataFrame, guide: DataFrame, drugs: DataFrame) -> DataFrame:
    """samples: sample_id. calls: phenotypes(). guide: drug, gene, phenotype, action. drugs: drug, genes (array). Per sample
    and drug: the severest action over its genes; indeterminate where a gene has no usable call."""
    severity = {"avoid": 3, "adjust": 2, "standard": 1}
    rank = F.coalesce(*[F.when(F.col("action") == k, v) for k, v in severity.items()])
    need = samples.join(F.broadcast(drugs.select("drug", F.explode("genes").alias("gene"))), F.lit(True))
    df = need.join(calls.select("sample_id", "gene", "phenotype"), ["sample_id", "gene"], "left").join(F.broadcast(guide), ["drug", "gene", "phenotype"], "left")
    df = df.withColumn("r", F.coalesce(rank, F.lit(0)))
    out = df.groupBy("sample_id", "drug").agg(F.max("r").alias("most"), F.min("r").alias("least"))
    label = F.when(F.col("most") == 3, "avoid").when(F.col("least") == 0, "indeterminate").when(F.col("most") == 2, "adjust").otherwise("standard")
    return out.select("sample_id", "drug", label.alias("action"))
