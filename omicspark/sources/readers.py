"""Readers of the formats that genotype, summary-statistic, expression and report files come in, as tidy DataFrames.

Paths may be files, folders or patterns of any store that Spark reads. The file's name stands for the sample where the
format has no sample column.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.functions.tables import stored
from omicspark.operators.gwas import ranked


def _sample() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^/.]*)?$", 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.rtrim("value").alias("line"), _sample().alias("sample_id"))


def _number(c: Column, kind: str = "double") -> Column:
    return F.trim(c).try_cast(kind)


def read_23andme(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, rsid, chrom, pos, genotype of tab-separated text. Comment lines and ids that begin with neither rs nor i
    are left out, dashes removed, empty genotypes dropped; a position that isn't a number is 0."""
    f = F.split("line", "\t")
    df = _lines(spark, path).where("line not like '#%'").select("sample_id", F.get(f, F.lit(0)).alias("rsid"), F.get(f, F.lit(1)).alias("chrom"), F.coalesce(_number(F.get(f, F.lit(2)), "bigint"), F.lit(0)).alias("pos"), F.replace(F.trim(F.get(f, F.lit(3))), F.lit("-"), F.lit("")).alias("genotype"))
    return df.where("rsid rlike '^(rs|i)' and genotype <> ''")


def read_ancestry(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, rsid, chrom, pos, genotype of tab- or comma-separated text with two allele columns; 0 stands for a
    missing allele, the header may be in any case, and only rs ids stay."""
    f = F.split("line", "[\t,]")
    alleles = F.translate(F.concat(F.trim(F.get(f, F.lit(3))), F.trim(F.get(f, F.lit(4)))), "0-", "")
    df = _lines(spark, path).where("line not like '#%'").select("sample_id", F.get(f, F.lit(0)).alias("rsid"), F.get(f, F.lit(1)).alias("chrom"), F.coalesce(_number(F.get(f, F.lit(2)), "bigint"), F.lit(0)).alias("pos"), alleles.alias("genotype"))
    return df.where("rsid rlike '^rs[0-9]' and genotype <> ''")


def read_myheritage(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, rsid, chrom, pos, genotype of comma-separated, possibly quoted text."""
    f = F.transform(F.split("line", ","), lambda x: F.translate(F.trim(x), '"', ""))
    df = _lines(spark, path).where("line not like '#%'").select("sample_id", F.get(f, F.lit(0)).alias("rsid"), F.get(f, F.lit(1)).alias("chrom"), F.coalesce(_number(F.get(f, F.lit(2)), "bigint"), F.lit(0)).alias("pos"), F.replace(F.get(f, F.lit(3)), F.lit("-"), F.lit("")).alias("genotype"))
    return df.where("rsid rlike '^(rs|i)[0-9]' and genotype <> ''")


def _vcf(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("line", "\t")
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]
    cols = [F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)]
    df = _lines(spark, path).where("line not like '#%' and line <> ''").select("sample_id", *cols, F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))).alias("calls"))
    return df.withColumns({"pos": _number(F.col("pos"), "bigint"), "qual": _number(F.col("qual"))})


def _gt(call: Column, fmt: Column) -> Column:
    at = F.array_position(F.split(fmt, ":"), "GT").cast("int")
    return F.translate(F.get(F.split(call, ":"), at - 1), "|", "/")


def read_vcf_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """sample_id (the file), rsid, chrom, pos, genotype of the first sample's calls in bases; missing alleles dropped."""
    df = _vcf(spark, path).withColumn("gt", _gt(F.get("calls", F.lit(0)), F.col("format")))
    alleles = F.concat(F.array("ref"), F.split("alt", ","))
    bases = F.transform(F.filter(F.split("gt", "/"), lambda x: x != "."), lambda x: F.get(alleles, x.try_cast("int")))
    df = df.withColumn("genotype", F.array_join(bases, ""))
    return df.where("genotype <> ''").select("sample_id", F.col("id").alias("rsid"), "chrom", "pos", "genotype")


def read_vcf_dosages(spark: SparkSession, path: str, clip: bool = False) -> DataFrame:
    """sample_id, variant_id, chrom, pos, dosage of every sample. The id falls back to chrom:pos; a haploid call counts
    double; a call with a missing allele is null. clip: the first two copies only (min(alt, 2)). Sample names come from
    each file's own header line, joined by file."""
    df = _vcf(spark, path).withColumnRenamed("sample_id", "file")
    header = _lines(spark, path).where("line like '#CHROM%'").select(F.col("sample_id").alias("file"), F.posexplode(F.slice(F.split("line", "\t"), 10, 1 << 20)).alias("i", "sample_id"))
    long = df.select("file", F.when(F.col("id") == ".", F.concat_ws(":", "chrom", "pos")).otherwise(F.col("id")).alias("variant_id"), "chrom", "pos", "format", F.posexplode("calls").alias("i", "call"))
    parts = F.split(_gt(F.col("call"), F.col("format")), "/")
    n = F.size(F.filter(parts, lambda x: x != "0"))
    dose = F.when(F.exists(parts, lambda x: x == "."), None).when(F.size(parts) == 1, 2 * n).otherwise(n)
    return long.join(header, ["file", "i"]).select("sample_id", "variant_id", "chrom", "pos", (F.least(dose, F.lit(2)) if clip else dose).cast("tinyint").alias("dosage"))


def read_vcf_alleles(spark: SparkSession, path: str) -> DataFrame:
    """One row per alternative allele: variant_id (chrom:pos:ref:alts where there is none), chrom, pos, ref, alt, qual,
    filter (array), info (map; a flag is "true")."""
    # The first of fields that repeat a key stays.
    fields = F.filter(F.split("info", ";"), lambda x: ~x.isin("", "."))
    keys = F.transform(fields, lambda x: F.substring_index(x, "=", 1))
    once = F.filter(fields, lambda x, i: F.array_position(keys, F.substring_index(x, "=", 1)) == i + 1)
    info = F.transform_values(F.str_to_map(F.array_join(once, ";"), F.lit(";"), F.lit("=")), lambda k, v: F.coalesce(v, F.lit("true")))
    info = F.when(F.size(fields) > 0, info).otherwise(F.create_map().cast("map<string,string>"))
    df = _vcf(spark, path).select(F.when(F.col("id") == ".", F.concat_ws(":", "chrom", "pos", "ref", "alt")).otherwise(F.col("id")).alias("variant_id"), "chrom", "pos", "ref", F.explode(F.split("alt", ",")).alias("alt"), "qual", F.filter(F.split("filter", ";"), lambda x: x != ".").alias("filter"), info.alias("info"))
    return df


def detect_format(spark: SparkSession, path: str) -> DataFrame:
    """sample_id (the file) and format, from the lines of each file."""
    low = F.lower("line")
    kind = F.when(F.col("line").startswith("##fileformat=VCF"), "vcf").when(low.contains("ancestrydna") | low.rlike("allele1[\t,]allele2"), "ancestry").when(low.contains("myheritage") | low.rlike('^"?rsid"?,"?chromosome"?,"?position"?,"?result'), "myheritage").when(low.contains("23andme") | low.rlike("^#? ?rsid\tchromosome\tposition\tgenotype"), "23andme")
    rank = F.when(kind == "vcf", 0).when(kind == "ancestry", 1).when(kind == "myheritage", 2).otherwise(3)
    return _lines(spark, path).select("sample_id", kind.alias("k"), rank.alias("r")).groupBy("sample_id").agg(F.coalesce(F.min_by("k", F.when(F.col("k").isNotNull(), F.col("r"))), F.lit("unknown")).alias("format"))


def read_pgs_scores(spark: SparkSession, path: str) -> DataFrame:
    """pgs_id (from the file), rsid (the harmonised one first), effect_allele, other_allele, effect_weight, allele_freq.
    The header is the first line without #; only rs ids with a weight stay."""
    df = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)

    def col(*names: str) -> Column:
        have = {c.lower(): c for c in df.columns}
        found = [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = df.select(_sample().alias("pgs_id"), col("hm_rsID", "rsID", "rsid").alias("rsid"), F.upper(col("effect_allele")).alias("effect_allele"), F.upper(col("other_allele")).alias("other_allele"), _number(col("effect_weight")).alias("effect_weight"), _number(col("allelefrequency_effect", "allele_freq")).alias("allele_freq"))
    return out.where("rsid like 'rs%' and effect_weight is not null")


#: Names that a column of summary statistics goes by.
SUMSTAT_NAMES = {"rsid": ["rsid", "snp", "id", "variant_id", "markername"], "chrom": ["chrom", "chr", "chromosome", "#chrom"], "pos": ["pos", "bp", "position", "base_pair_location"], "beta": ["beta", "b", "effect", "log_or"], "se": ["se", "stderr", "standard_error"], "z": ["z", "zscore", "z_score"], "p": ["p", "pval", "pvalue", "p_value"], "maf": ["maf", "eaf", "freq", "af"], "n": ["n", "n_total", "sample_size"]}


def chrom_key(c: Column) -> Column:
    """The chromosome without leading letters c, h and r."""
    return F.regexp_replace(F.trim(c), "^[chr]+", "")


def read_sumstats(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """rsid, chrom, pos, beta, se, z, p, maf, n under any of their usual names; z is beta / se where it isn't given; rows
    without a finite z are left out. With chrom, start and end only that window."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    have = {c.lower(): c for c in df.columns}
    cols = {}
    for name, aliases in SUMSTAT_NAMES.items():
        own = [F.col(f"`{have[a]}`") for a in aliases if a in have]
        cols[name] = F.coalesce(*own) if own else F.lit(None).cast("string")
    z = F.coalesce(_number(cols["z"]), F.try_divide(_number(cols["beta"]), _number(cols["se"])))
    out = df.select(cols["rsid"].alias("rsid"), chrom_key(cols["chrom"]).alias("chrom"), _number(cols["pos"], "bigint").alias("pos"), *[_number(cols[c]).alias(c) for c in ("beta", "se")], z.alias("z"), *[_number(cols[c]).alias(c) for c in ("p", "maf", "n")])
    out = out.where("z is not null and not isnan(z) and abs(z) < double('infinity')")
    return out if chrom is None else out.where((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def read_regenie(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated results of 13 fields or more with LOG10P above 0; p is 10 ** -LOG10P."""
    f = F.split(F.trim("line"), r"\s+")
    names = {"chrom": 0, "pos": 1, "variant_id": 2, "allele0": 3, "allele1": 4, "a1freq": 5, "n": 7, "beta": 9, "se": 10, "chisq": 11, "log10p": 12}
    text = ("chrom", "variant_id", "allele0", "allele1")
    df = _lines(spark, path).where(F.size(f) >= 13).select(*[(F.get(f, F.lit(i)) if n in text else _number(F.get(f, F.lit(i)))).alias(n) for n, i in names.items()])
    return df.where("log10p > 0").withColumn("p", F.pow(F.lit(10.0), -F.col("log10p")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """i (from 0), line of a text file, read by splits: a split's lines are counted where they are read, and the counts of
    the splits before it (a row each) are added."""
    at = F.monotonically_increasing_id()
    df = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), at.alias("at"))
    blocks = df.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "start", "first", before.alias("before"))
    return df.join(F.broadcast(blocks), ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first")).alias("i"), F.col("value").alias("line"))


#: Bytes of a packed genotype file that a task reads at once.
PACKED_BYTES = 32 << 20


def _packed_rows(spark: SparkSession, path: str, n_people: int, n_sites: int) -> DataFrame:
    """i, k, d (0 to 2, or null) of a packed file: 4 bytes, then ceil(people / 4) bytes a site, two bits a person, the
    lowest first; 3 is a missing call. The file is opened by the store that its path names (local, HDFS, S3 or GCS)."""
    width = -(-n_people // 4)
    step = max(1, PACKED_BYTES // max(1, width))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
        for batch in batches:
            with store.open_input_file(name) as f:
                for block in batch.column(0).to_pylist():
                    low = block * step
                    n = min(step, n_sites - low)
                    data = np.frombuffer(f.read_at(n * width, 4 + low * width), np.uint8)
                    n = len(data) // width
                    data = data[: n * width].reshape(n, width)
                    for r in range(0, n, max(1, (1 << 20) // n_people)):
                        part = data[r : r + max(1, (1 << 20) // n_people)]
                        d = ((part[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(len(part), -1)[:, :n_people].astype(np.int8)
                        i = np.repeat(np.arange(low + r, low + r + len(part)), n_people)
                        k = np.tile(np.arange(n_people), len(part))
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(d.ravel(), mask=d.ravel() == 3)], names=["i", "k", "d"])

    blocks = -(-n_sites // step) if n_people else 0
    return spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(read, "i bigint, k bigint, d tinyint")


def read_eigenstrat(spark: SparkSession, ind: str, snp: str, geno: str, packed: bool = False) -> DataFrame:
    """sample_id, population, variant_id, chrom, pos, dosage of a triple of files; a missing call is null. The .geno file has
    a line for each site and a digit for each individual (9: missing), or is packed. It is read by splits, the other two are
    small beside it. Blank lines and those that begin with # don't count in .ind and .snp; fewer than three fields leave
    the population unknown, fewer than six leave the site out."""

    def fields(path: str, least: int) -> DataFrame:
        f = F.split(F.trim("line"), r"\s+")
        rows = numbered_lines(spark, path).where("trim(line) <> '' and trim(line) not like '#%'").select("i", f.alias("f")).where(F.size("f") >= least)
        return ranked(rows, [F.col("i")], "n", 8).select((F.col("n") - 1).alias("i"), "f")

    people = stored(fields(ind, 2).select(F.col("i").alias("k"), F.get("f", F.lit(0)).alias("sample_id"), F.coalesce(F.get("f", F.lit(2)), F.lit("Unknown")).alias("population")))
    sites = stored(fields(snp, 6).select("i", F.get("f", F.lit(0)).alias("variant_id"), F.get("f", F.lit(1)).alias("chrom"), _number(F.get("f", F.lit(3)), "bigint").alias("pos")))
    if packed:
        calls = _packed_rows(spark, geno, people.count(), sites.count())
    else:
        digits = numbered_lines(spark, geno).select("i", F.posexplode(F.filter(F.split(F.trim("line"), ""), lambda x: x != "")).alias("k", "c"))
        calls = digits.select("i", "k", F.when(F.col("c").isin("0", "1", "2"), F.col("c").cast("tinyint")).alias("d"))
    return calls.join(sites, "i").join(people, "k").select("sample_id", "population", "variant_id", "chrom", "pos", F.col("d").alias("dosage"))


def read_matrix(spark: SparkSession, path: str, sep: str = ",", id_col: str | None = None, value: str = "value") -> DataFrame:
    """feature, sample_id, value of a wide table with a row per feature; blanks are null."""
    df = spark.read.option("sep", sep).option("header", True).csv(path)
    first = id_col or df.columns[0]
    rest = [c for c in df.columns if c != first]
    long = df.select(F.col(f"`{first}`").alias("feature"), *[_number(F.col(f"`{c}`")).alias(c) for c in rest])
    return long.unpivot(["feature"], [f"`{c}`" for c in rest], "sample_id", value)


def read_protein_groups(spark: SparkSession, path: str, prefix: str = "LFQ intensity ") -> DataFrame:
    """feature, sample_id, value of a protein table: contaminants, reverse hits and those by site only are left out, zeros
    are null, and proteins without any value go."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    for c in ("Potential contaminant", "Reverse", "Only identified by site"):
        if c in df.columns:
            df = df.where(F.coalesce(F.col(f"`{c}`"), F.lit("")) != "+")
    wide = [c for c in df.columns if c.startswith(prefix)]
    long = df.select(F.col(f"`{df.columns[0]}`").alias("feature"), *[F.nullif(_number(F.col(f"`{c}`")), F.lit(0.0)).alias(c[len(prefix) :]) for c in wide]).unpivot(["feature"], [f"`{c[len(prefix) :]}`" for c in wide], "sample_id", "value")
    return long.join(long.groupBy("feature").agg(F.count("value").alias("n")).where("n > 0").select("feature"), "feature", "left_semi")


def read_diann(spark: SparkSession, path: str) -> DataFrame:
    """feature (Genes), sample_id (the run), value of a table whose intensity columns end in .raw."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    wide = [c for c in df.columns if c.endswith(".raw")]
    return df.select(F.coalesce(F.col("Genes"), F.col("`Protein.Ids`")).alias("feature"), *[_number(F.col(f"`{c}`")).alias(c) for c in wide]).unpivot(["feature"], [f"`{c}`" for c in wide], "sample_id", "value")


def read_olink_npx(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, feature, npx, lod; samples with any WARN row are left out whole."""
    df = spark.read.option("header", True).csv(path)
    df = df.select(F.col("SampleID").alias("sample_id"), F.col("OlinkID").alias("feature"), _number(F.col("NPX")).alias("npx"), (_number(F.col("LOD")) if "LOD" in df.columns else F.lit(None).cast("double")).alias("lod"), (F.col("QC_Warning") if "QC_Warning" in df.columns else F.lit("PASS")).alias("qc"))
    return df.join(df.where("upper(qc) like 'WARN%'").select("sample_id").distinct(), "sample_id", "left_anti").drop("qc")


def read_10x_mtx(spark: SparkSession, folder: str) -> DataFrame:
    """cell, gene, count of a folder with matrix.mtx, features.tsv and barcodes.tsv (gzipped or not): 1-based triplets
    joined to the names by line number."""

    def names(stem: str, field: int) -> DataFrame:
        df = numbered_lines(spark, f"{folder}/{stem}.tsv*").where("line <> ''")
        return df.select((F.col("i") + 1).alias("i"), F.get(F.split("line", "\t"), F.lit(field)).alias("name"))

    genes, cells = names("features", 1), names("barcodes", 0)
    f = F.split(F.trim("line"), r"\s+")
    lines = numbered_lines(spark, f"{folder}/matrix.mtx*").where("line not like '%\\%%' and trim(line) <> ''")
    sizes = lines.agg(F.min("i").alias("first"))  # one row
    rows = lines.join(F.broadcast(sizes)).select((F.col("i") - F.col("first")).alias("i"), *[_number(F.get(f, F.lit(i)), "bigint").alias(c) for i, c in enumerate(("g", "c", "count"))])
    # The first line that is no comment has the sizes.
    return rows.where("i > 0").drop("i").join(genes.withColumnRenamed("name", "gene"), F.col("g") == F.col("i")).drop("i").join(cells.withColumnRenamed("name", "cell"), F.col("c") == F.col("i")).select("cell", "gene", "count")


def read_bracken(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, name, reads, fraction at species level."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.select(_sample().alias("sample_id"), "name", F.col("taxonomy_lvl").alias("level"), _number(F.col("new_est_reads"), "bigint").alias("reads"), _number(F.col("fraction_total_reads")).alias("fraction")).where("level = 'S'").drop("level")


def read_rgi(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, gene, drug_class, cut_off of hits that are Perfect or Strict."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.select(_sample().alias("sample_id"), F.col("Best_Hit_ARO").alias("gene"), F.col("`Drug Class`").alias("drug_class"), F.col("Cut_Off").alias("cut_off")).where("cut_off in ('Perfect', 'Strict')")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq (upper case) of each record."""
    df = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head = F.trim(F.substring_index("value", "\n", 1))
    body = F.when(F.col("value").contains("\n"), F.upper(F.regexp_replace(F.substring("value", F.instr("value", "\n"), F.length("value")), r"\s", ""))).otherwise("")
    return df.select(F.substring_index(head, " ", 1).alias("id"), F.trim(F.when(head.contains(" "), F.substring(head, F.instr(head, " "), F.length(head))).otherwise("")).alias("description"), body.alias("seq"))


def read_trials_json(spark: SparkSession, path: str) -> DataFrame:
    """nct_id, title, status, phase, conditions, interventions, start_date, summary of nested trial records, one a line."""
    schema = "protocolSection struct<identificationModule: struct<nctId: string, briefTitle: string>, statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>>, designModule: struct<phases: array<string>, studyType: string>, conditionsModule: struct<conditions: array<string>>, armsInterventionsModule: struct<interventions: array<struct<name: string>>>, descriptionModule: struct<briefSummary: string>>"
    p = "protocolSection"
    df = spark.read.schema(schema).json(path)
    return df.select(F.col(f"{p}.identificationModule.nctId").alias("nct_id"), F.col(f"{p}.identificationModule.briefTitle").alias("title"), F.col(f"{p}.statusModule.overallStatus").alias("status"), F.concat_ws(" / ", f"{p}.designModule.phases").alias("phase"), F.col(f"{p}.designModule.studyType").alias("study_type"), F.coalesce(F.col(f"{p}.conditionsModule.conditions"), F.array().cast("array<string>")).alias("conditions"), F.coalesce(F.col(f"{p}.armsInterventionsModule.interventions.name"), F.array().cast("array<string>")).alias("interventions"), F.col(f"{p}.statusModule.startDateStruct.date").alias("start_date"), F.substring(F.col(f"{p}.descriptionModule.briefSummary"), 1, 300).alias("summary"))


def read_evidence_json(spark: SparkSession, path: str) -> DataFrame:
    """gene, drugs, level, kind of gene-drug annotations, one a line; drugs are joined by a comma."""
    df = spark.read.schema("gene struct<symbol: string>, relatedChemicals array<struct<name: string>>, levelOfEvidence struct<term: string>, objCls string").json(path)
    return df.select(F.col("gene.symbol").alias("gene"), F.concat_ws(", ", "relatedChemicals.name").alias("drugs"), F.col("levelOfEvidence.term").alias("level"), F.col("objCls").alias("kind"))


#: What an evidence file's rows have beyond gene and drug: column, JSON field and its default.
EVIDENCE = {
    "annotation": {"id": "coalesce(accessionId, id, '')", "evidence_level": "coalesce(levelOfEvidence.term, '')", "phenotype_category": "coalesce(phenotypeCategory, '')"},
    "guideline": {"id": "coalesce(id, '')", "name": "coalesce(name, '')", "source": "coalesce(source, '')", "dosing_info": "coalesce(dosingInformation, false)"},
    "label": {"id": "coalesce(id, '')", "name": "coalesce(name, '')", "source": "coalesce(source, '')", "testing_level": "coalesce(testingLevel, '')"},
}


def read_evidence_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of clinical annotations, guidelines or drug labels, one JSON object a line: gene and drug (names joined by a comma
    and a space), and the columns of EVIDENCE[kind]; what an object doesn't have is empty, or false."""
    named = "array<struct<{}: string>>"
    schema = f"id string, accessionId string, name string, source string, dosingInformation boolean, testingLevel string, phenotypeCategory string, levelOfEvidence struct<term: string>, relatedChemicals {named.format('name')}, relatedGenes {named.format('symbol')}"
    df = spark.read.schema(schema).json(path)
    joined = lambda c, f: F.concat_ws(", ", F.transform(F.coalesce(c, F.expr(f"array() :: {named.format(f)}")), lambda x: F.coalesce(x[f], F.lit(""))))
    return df.select(joined("relatedGenes", "symbol").alias("gene"), joined("relatedChemicals", "name").alias("drug"), *[F.expr(e).alias(c) for c, e in EVIDENCE[kind].items()])


def read_multiqc_general_stats(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, metric, value of the general statistics, a list of maps sample -> metric -> value; a later tool's value
    takes the place of an earlier one's."""
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", "report_general_stats_data array<map<string, map<string, double>>>").alias("j"))
    rows = df.select(F.posexplode("j.report_general_stats_data").alias("tool", "m")).select("tool", F.explode("m").alias("sample_id", "metrics")).select("tool", "sample_id", F.explode("metrics").alias("metric", "value"))
    return rows.groupBy("sample_id", "metric").agg(F.max_by("value", "tool").alias("value"))



#: Names that the fields of a sample sheet go by, first choice first.
SHEET_NAMES = {"sample_id": ["sample_id", "sampleid", "sample", "id"], "sample_name": ["sample_name", "name"], "project": ["sample_project", "project", "project_name"], "sample_type": ["sample_type", "type"]}


def normalise_sample_sheet(rows: DataFrame, order: str) -> DataFrame:
    """rows: a sheet with columns of any of the usual names, and their order. One row per sample: each field's first value
    that isn't blank, by alias and then by row."""
    have = {c.lower(): c for c in rows.columns}
    cols = []
    for name, aliases in SHEET_NAMES.items():
        own = [F.nullif(F.trim(F.col(f"`{have[a]}`").cast("string")), F.lit("")) for a in aliases if a in have]
        cols.append((F.coalesce(*own) if own else F.lit(None).cast("string")).alias(name))
    df = rows.select(F.col(order).alias("_order"), *cols).where("sample_id is not null")
    rest = [c for c in SHEET_NAMES if c != "sample_id"]
    return df.groupBy("sample_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in rest])


#: Names of run metrics.
RUN_METRICS = {"q30": ["q30", "pct_q30", "%>=q30", "percent_q30"], "yield_gb": ["yield_gb", "yield", "yield (gb)"], "cluster_pf": ["cluster_pf", "clusters_pf", "%pf", "pct_pf"], "error_rate": ["error_rate", "error rate"]}


def normalise_run_qc(rows: DataFrame) -> DataFrame:
    """rows: run, key, value (text). One row per run with the canonical metrics as numbers, by the first alias there is."""
    m = rows.groupBy("run").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.lower(F.trim("key")).alias("k"), F.col("value"))))).alias("m"))
    return m.select("run", *[F.coalesce(*[F.regexp_replace(F.get(F.array(F.col("m")[a]), F.lit(0)), "%", "").try_cast("double") for a in aliases]).alias(name) for name, aliases in RUN_METRICS.items()])


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables with differing columns in one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
