"""Queries on iterative and numeric operators, and on pharmacogenomics."""

from pyspark.sql import functions as F

from omicspark.jobs.query import query
from omicspark.operators import components as K
from omicspark.operators import gwas as G
from omicspark.operators import pgx as P
from omicspark.operators import popgen
from omicspark.operators import prs as R
from omicspark.operators import solvers as S


def _dense(g):
    return g.select("sample_id", "variant_id", "chrom", (F.col("variant_id") * 100).alias("pos"), R.dosage_of(F.lit("G"), F.col("genotype")).alias("dosage"))


def _panel(d, p):
    return d.select("variant_id").distinct().select("variant_id", *[((F.col("variant_id") * (7 + i) % 97) / 97.0).alias(x) for i, x in enumerate(p)])


_POPS = ["afr", "eur", "eas", "sas", "amr"]
query("num1_pca", "genotypes_dense", lambda g: K.pca(_dense(g)).select("sample_id", "component", F.round("score", 6).alias("score"), F.round("explained", 6).alias("explained")))
query("num1_pca_expression", "counts", lambda c: K.pca(c.withColumn("v", F.log2(F.col("count") + 1)), 3, "gene", "sample_id", "v").select("sample_id", "component", F.abs(F.round("score", 5)).alias("size"), F.round("explained", 6).alias("explained")))
query("num2_ancestry", "genotypes_dense", lambda g: S.ancestry_proportions(_dense(g).withColumnRenamed("dosage", "alt_count"), _panel(g, _POPS), _POPS).withColumn("proportion", F.round("proportion", 5)))


def _ld(s):
    near = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("d")
    return s.select("locus", F.col("variant_id").alias("i"), near).withColumn("j", F.col("i") + F.col("d")).where("cast(j / 50 as bigint) = locus").select("locus", "i", "j", F.pow(F.lit(0.6), F.col("d")).alias("r"))


query("num3_susie", "sumstats", lambda s: S.finemap_susie(s.select("locus", "variant_id", "z", F.lit(5000.0).alias("n")), _ld(s)).withColumns({"pip": F.round("pip", 5), "purity": F.round("purity", 5)}))
query("num4_susie_inf", "sumstats", lambda s: S.finemap(s.select("locus", "variant_id", "z", F.lit(5000.0).alias("n")), _ld(s), "susie_inf").withColumn("pip", F.round("pip", 4)))
query("fil4_ld_prune", "genotypes_dense", lambda g: S.ld_prune(_dense(g), most_r2=0.2))


def _shared(d):
    return d.select("sample_id", F.lit(1).cast("bigint").alias("chrom"), "pos", F.col("dosage").alias("modern"), (F.col("variant_id") * 5 % 3).alias("archaic"))


query("win12_segments", "genotypes_dense", lambda g: S.segments(_shared(_dense(g))).withColumn("score", F.round("score", 6)))
query("agg49_introgression", "genotypes_dense", lambda g: S.segment_summary(S.segments(_shared(_dense(g)))))
query("fil3_hwe", "dosages", lambda d: popgen.call_rates(d).select("variant_id", "n_ref", "n_het", "n_alt", F.round(S.hwe_p("n_ref", "n_het", "n_alt"), 6).alias("p")))
query("agg43_orfs", "papers", lambda p: p.select("doc_id", F.explode(S.open_reading_frames(F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz .,\n", "ATGATGATGATGATGATGATGATGAT"))).alias("x")).select("doc_id", "x.frame", "x.start", "x.end"))

_PGX = "p AS (SELECT variant_id, 'G' || (variant_id % 6) AS gene, '*' || (2 + variant_id // 6) AS star, CASE WHEN variant_id % 13 = 0 THEN 'DEL' ELSE alt END AS alt, (variant_id % 3) / 2 AS activity FROM variants WHERE variant_id < 60)"


def _pgx_panel(v):
    return v.where("variant_id < 60").select("variant_id", F.expr("concat('G', cast(variant_id % 6 as string))").alias("gene"), F.expr("concat('*', cast(2 + variant_id div 6 as string))").alias("star"), F.expr("case when variant_id % 13 = 0 then 'DEL' else alt end").alias("alt"), F.expr("cast((variant_id % 3) / 2 as double)").alias("activity"))


def _calls(g, v):
    return P.phenotypes(P.diplotypes(g.select("sample_id", "variant_id", "genotype"), _pgx_panel(v)))


_CALLS = f"""{_PGX}, x AS (SELECT g.sample_id, p.*, p.alt = 'DEL' AS sv, genotype[1] <> genotype[2] AS het, length(genotype) - length(replace(genotype, p.alt, '')) AS n FROM genotypes g JOIN p ON g.variant_id = p.variant_id WHERE genotype IS NOT NULL),
a AS (SELECT sample_id, gene, count(*) FILTER (NOT sv) AS n_tested, bool_or(sv AND het) AS sv, coalesce(list({{'star': star, 'act': activity, 'n': n}} ORDER BY activity <> 0, variant_id) FILTER (NOT sv AND n > 0), []) AS f FROM x GROUP BY ALL),
b AS (SELECT *, f[1] AS one, CASE WHEN f[1].n >= 2 THEN f[1] ELSE f[2] END AS two, len(list_filter(f, lambda v: v.n = 1)) >= 2 AND len(list_filter(f, lambda v: v.n = 1 AND v.act = 0)) > 0 AS phase FROM a WHERE n_tested > 0),
d AS (SELECT sample_id, gene, CASE WHEN sv THEN 'indeterminate (structural variant)' WHEN phase THEN 'indeterminate (phase)' ELSE array_to_string(list_sort([coalesce(one.star, '*1'), coalesce(two.star, '*1')]), '/') END AS diplotype, n_tested, (SELECT count(*) FROM p WHERE p.gene = b.gene AND alt <> 'DEL') AS n_panel, CASE WHEN NOT sv AND NOT phase THEN coalesce(one.act, 1) + coalesce(two.act, 1) END AS activity FROM b),
f AS (SELECT *, CASE WHEN activity IS NULL OR (n_tested < n_panel AND diplotype = '*1/*1') THEN 'indeterminate' WHEN activity = 0 THEN 'poor' WHEN activity < 1.25 THEN 'intermediate' WHEN activity <= 2.25 THEN 'normal' ELSE 'rapid' END AS phenotype FROM d)"""
query("fn10_diplotypes", "genotypes variants", _calls, f"WITH {_CALLS} SELECT * FROM f")
query(
    "jon5_recommendations", "genotypes variants",
    lambda g, v: P.recommendations(g.select("sample_id").distinct(), _calls(g, v), g.sparkSession.sql("values ('d0', 'G0', 'normal', 'standard'), ('d0', 'G0', 'intermediate', 'adjust'), ('d1', 'G1', 'normal', 'standard'), ('d1', 'G2', 'normal', 'standard'), ('d1', 'G2', 'intermediate', 'avoid') as t(drug, gene, phenotype, action)"), g.sparkSession.sql("values ('d0', array('G0')), ('d1', array('G1', 'G2')) as t(drug, genes)")),
    f"""WITH {_CALLS}, gd(drug, gene, phenotype, action) AS (VALUES ('d0', 'G0', 'normal', 1), ('d0', 'G0', 'intermediate', 2), ('d1', 'G1', 'normal', 1), ('d1', 'G2', 'normal', 1), ('d1', 'G2', 'intermediate', 3)), dr(drug, gene) AS (VALUES ('d0', 'G0'), ('d1', 'G1'), ('d1', 'G2')),
s AS (SELECT DISTINCT sample_id FROM genotypes), r AS (SELECT s.sample_id, dr.drug, coalesce(gd.action, 0) AS r FROM s CROSS JOIN dr LEFT JOIN f ON f.sample_id = s.sample_id AND f.gene = dr.gene LEFT JOIN gd ON gd.drug = dr.drug AND gd.gene = dr.gene AND gd.phenotype = f.phenotype)
SELECT sample_id, drug, CASE WHEN max(r) = 3 THEN 'avoid' WHEN min(r) = 0 THEN 'indeterminate' WHEN max(r) = 2 THEN 'adjust' ELSE 'standard' END AS action FROM r GROUP BY sample_id, drug""",
)
