"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "csv", partition_by: dict[str, list[str]] | None = None) -> None:
    """Each table in a folder of its own name, partitioned by the columns named for it."""
    for name, df in tables.items():
        w = df.write.mode("overwrite").option("header", True)
        by = (partition_by or {}).get(name)
        (w.partitionBy(*by) if by else w).format(fmt).save(f"{folder}/{name}")


def write_lead_variants(stats: DataFrame, path: str) -> None:
    """Tab-separated variants with p in scientific notation, in no order."""
    stats.select("variant_id", "chrom", "pos", F.format_string("%.4e", "p").alias("p"), F.format_string("%.6f", "beta").alias("beta")).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


#: Columns of the summary-statistics and lead-variant tables: name, source column, format.
SUMMARY = [("CHROM", "chrom", None), ("POS", "pos", None), ("ID", "variant_id", None), ("A0", "allele0", None), ("A1", "allele1", None), ("A1FREQ", "a1freq", "%.6f"), ("N", "n", None), ("BETA", "beta", "%.6f"), ("SE", "se", "%.6f"), ("CHISQ", "chisq", "%.6f"), ("LOG10P", "log10p", "%.6f"), ("P", "p", "%.2e")]
LEADS = [x for x in SUMMARY if x[0] in ("CHROM", "POS", "ID", "A0", "A1", "BETA", "SE")] + [("P", "p", "%.2e"), ("LOG10P", "log10p", "%.4f")]


def write_gwas(stats: DataFrame, path: str, columns: list[tuple] = SUMMARY) -> None:
    """Tab-separated association results with the columns of SUMMARY, or of LEADS, by falling log10p: each file is a range
    of it, in the order of the files' names."""
    text = [(F.col(c) if f is None else F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c).cast("double")))).alias(name) for name, c, f in columns]
    ordered = stats.orderBy(F.desc_nulls_last("log10p"), "chrom", "pos", "variant_id")
    ordered.select(*text).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_bed(segments: DataFrame, path: str) -> None:
    """BED lines of segments: chrom, start, end, name, score."""
    segments.select(F.concat_ws("\t", "chrom", "start", "end", "name", F.round("score", 3)).alias("value")).write.mode("overwrite").text(path)


def fhir_date(c: Column) -> Column:
    """A date of any precision as YYYY, YYYY-MM or YYYY-MM-DD; null if it isn't one."""
    return F.when(c.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), c)


def research_studies(trials: DataFrame) -> DataFrame:
    """nct_id, resource (ResearchStudy JSON), valid: whether it has an identifier, a title and a status."""
    status = F.when(F.col("status") == "COMPLETED", "completed").when(F.col("status").isin("RECRUITING", "ACTIVE_NOT_RECRUITING"), "active").otherwise("administratively-completed")
    body = F.struct(F.lit("ResearchStudy").alias("resourceType"), F.array(F.struct(F.lit("https://clinicaltrials.gov").alias("system"), F.col("nct_id").alias("value"))).alias("identifier"), F.col("title"), status.alias("status"), F.struct(fhir_date(F.col("start_date")).alias("start")).alias("period"), F.transform("conditions", lambda c: F.struct(c.alias("text"))).alias("condition"))
    return trials.select("nct_id", F.to_json(body).alias("resource"), (F.coalesce("nct_id", F.lit("")).rlike("^NCT[0-9]{8}$") & (F.coalesce("title", F.lit("")) != "") & F.col("status").isNotNull()).alias("valid"))
