"""Queries on cohorts, pedigrees, targets, benchmark scoring, tools, literature and text."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.jobs.query import query
from omicspark.operators import annotate as A
from omicspark.operators import blocks as B
from omicspark.operators import cohort as C
from omicspark.operators import expression as X
from omicspark.operators import literature as L
from omicspark.operators import neighbours as N
from omicspark.operators import pgx

query("jon13_comorbidity", "cohort", lambda c: C.co_occurrence(c, "patient_id", "condition"), "WITH d AS (SELECT DISTINCT patient_id, condition FROM cohort) SELECT a.condition AS item_1, b.condition AS item_2, count(*) AS n FROM d a JOIN d b ON a.patient_id = b.patient_id AND a.condition < b.condition GROUP BY ALL HAVING count(*) >= 2")
query("agg37_cohort", "cohort", C.cohort_summary, "WITH p AS (SELECT patient_id, max(age) AS age FROM cohort GROUP BY patient_id) SELECT count(*) AS n_patients, min(age) AS min_age, max(age) AS max_age, round(avg(age), 6) AS mean_age, quantile_cont(age, 0.5)::DOUBLE AS median_age, count(*) FILTER (age < 18) AS n_minors, count(*) FILTER (age > 65) AS n_seniors FROM p")
query("agg37_top_conditions", "cohort", lambda c: c.groupBy("condition").agg(F.countDistinct("patient_id").alias("n")).orderBy(F.col("n").desc(), "condition").limit(10), "SELECT condition, count(DISTINCT patient_id) AS n FROM cohort GROUP BY condition ORDER BY n DESC, condition LIMIT 10")
query("jon21_founders", "pedigree", C.founders, "WITH RECURSIVE e AS (SELECT id, unnest([father, mother]) AS p FROM pedigree WHERE father IS NOT NULL), r AS (SELECT id, p FROM e UNION SELECT r.id, e.p FROM r JOIN e ON r.p = e.id) SELECT id, count(*) AS n_founders FROM r WHERE p < 16 GROUP BY id")
_TRAITS = "t AS (SELECT id, 'trait' || k AS trait, (id * 31 + k * 17) % 100 AS value FROM pedigree, range(4) r(k))"


def _traits(p):
    return p.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("id", "k", F.concat(F.lit("trait"), F.col("k").cast("string")).alias("trait"), ((F.col("id") * 31 + F.col("k") * 17) % 100).alias("value"))


query(
    "jon18_skill_gates", "pedigree", lambda p: C.gates_passed(_traits(p).where("(id + k) % 9 > 0").drop("k"), p.sparkSession.sql("values ('a', 'trait0', 30), ('a', 'trait1', 50), ('b', 'trait2', 80), ('c', 'trait1', 10), ('c', 'trait3', 10) as g(skill, trait, least)")),
    f"""WITH {_TRAITS}, o AS (SELECT * FROM t WHERE (id + trait[6:]::INT) % 9 > 0), g(skill, trait, least) AS (VALUES ('a', 'trait0', 30), ('a', 'trait1', 50), ('b', 'trait2', 80), ('c', 'trait1', 10), ('c', 'trait3', 10)),
x AS (SELECT i.id, g.skill, g.trait, coalesce(o.value >= g.least, false) AS met FROM (SELECT DISTINCT id FROM o) i CROSS JOIN g LEFT JOIN o ON o.id = i.id AND o.trait = g.trait)
SELECT id, skill, bool_and(met) AS unlocked, coalesce(string_agg(trait, ',' ORDER BY trait) FILTER (NOT met), '') AS short FROM x GROUP BY id, skill""",
)
_NEEDS = "values ('d1', 3, 'alt/?'), ('d1', 8, 'ref/ref'), ('d2', 5, 'alt/alt'), ('d3', 7, 'alt/?'), ('d3', 11, 'alt/?'), ('d3', 19, 'alt/?')"
query(
    "jon19_disease_status", "genotypes_dense", lambda g: C.disease_status(g.select("sample_id", "variant_id", (F.length("genotype") - F.length(F.replace("genotype", F.lit("G"), F.lit("")))).alias("dosage")), g.sparkSession.sql(f"{_NEEDS} as t(disease, variant_id, need)")),
    f"""WITH n(disease, variant_id, need) AS ({_NEEDS}), c AS (SELECT s.sample_id, n.disease, n.need, length(genotype) - length(replace(genotype, 'G', '')) AS d FROM (SELECT DISTINCT sample_id FROM genotypes_dense) s CROSS JOIN n LEFT JOIN genotypes_dense g ON g.sample_id = s.sample_id AND g.variant_id = n.variant_id)
SELECT sample_id, disease, bool_and(coalesce((need = 'alt/alt' AND d = 2) OR (need = 'alt/?' AND d >= 1) OR (need = 'ref/ref' AND d = 0), false)) AS affected FROM c GROUP BY sample_id, disease""",
)
def _carriers(p):
    return p.select("id", "sex", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("locus")).select("id", "sex", "locus", ((F.col("id") * F.col("locus") + F.floor(F.col("id") / 3)) % 3).alias("state"))


query(
    "jon14_compatibility", "breeders", lambda p: B.compatibility(_carriers(p)),
    "WITH c AS (SELECT id, sex, l AS locus, (id * l + id // 3) % 3 AS state FROM breeders, range(1, 9) r(l)) SELECT f.id AS female, m.id AS male, count(*) AS n_loci, round(1 - count(*) FILTER (f.state > 0 AND m.state > 0) / count(*), 6) AS compatibility FROM c f JOIN c m ON f.locus = m.locus AND f.sex = 0 AND m.sex = 1 GROUP BY ALL",
)
_GEN = "greatest(CAST(floor(log2(greatest(id, 1))) AS BIGINT) - 3, 0)"


def _generation():
    return F.greatest(F.floor(F.log2(F.greatest("id", F.lit(1)))) - 3, F.lit(0))


query("agg38_generations", "pedigree", lambda p: p.withColumn("generation", _generation()).groupBy("generation").agg(F.count("*").alias("n"), F.round(F.avg("trait"), 4).alias("mean"), F.round(F.stddev_pop("trait"), 4).alias("sd"), F.min("trait").alias("least"), F.max("trait").alias("most"), F.count_if(F.col("sex") == 0).alias("n_female")), f"SELECT {_GEN} AS generation, count(*) AS n, round(avg(trait), 4) AS mean, round(stddev_pop(trait), 4) AS sd, min(trait) AS least, max(trait) AS most, count(*) FILTER (sex = 0) AS n_female FROM pedigree GROUP BY 1")
query("agg39_generation_af", "pedigree dosages", lambda p, d: d.join(p.select(F.col("id").alias("sample_id"), _generation().alias("generation")), "sample_id").groupBy("generation", "variant_id").agg(F.round(F.sum("dosage") / (2 * F.count("dosage")), 6).alias("af")).where("af is not null"), f"SELECT {_GEN} AS generation, variant_id, round(sum(dosage) / (2 * count(dosage)), 6) AS af FROM dosages JOIN pedigree ON id = sample_id GROUP BY ALL HAVING count(dosage) > 0")
query(
    "agg40_trait_inference", "dosages", lambda d: d.withColumns({"trait": F.col("variant_id") % 5, "w": 1 + F.col("variant_id") % 3, "x": F.when(F.col("variant_id") % 3 == 0, F.col("dosage") / 2).when(F.col("variant_id") % 3 == 1, (F.col("dosage") > 0).cast("double")).otherwise((F.col("dosage") == 2).cast("double"))}).groupBy("sample_id", "trait").agg(F.round(F.coalesce(F.sum(F.col("w") * F.col("x")) / F.sum(F.when(F.col("x").isNotNull(), F.col("w"))), F.lit(0.5)), 6).alias("value")),
    "WITH x AS (SELECT sample_id, variant_id % 5 AS trait, 1 + variant_id % 3 AS w, CASE variant_id % 3 WHEN 0 THEN dosage / 2 WHEN 1 THEN (dosage > 0)::INT ELSE (dosage = 2)::INT END AS x FROM dosages) SELECT sample_id, trait, round(coalesce(sum(w * x) / sum(w) FILTER (x IS NOT NULL), 0.5), 6) AS value FROM x GROUP BY ALL",
)
query(
    "agg41_fitness", "pedigree", lambda p: C.fitness(p.select((F.col("id") % 20).alias("generation"), F.col("id").alias("agent"), F.filter(F.array(*[F.when((F.col("id") * (k + 3) % 7) < 3, F.lit(f"s{k}")) for k in range(4)]), lambda x: x.isNotNull()).alias("skills"))),
    """WITH x AS (SELECT id % 20 AS generation, id AS agent, list_filter([CASE WHEN id * (k + 3) % 7 < 3 THEN 's' || k END FOR k IN range(4)], lambda s: s IS NOT NULL) AS s FROM pedigree),
n AS (SELECT *, count(*) OVER (PARTITION BY generation) AS n, count(*) OVER (PARTITION BY generation, s) AS same FROM x)
SELECT generation, agent, round(CASE WHEN n <= 1 THEN 0.5 ELSE 1 - (same - 1) / (n - 1) END, 6) AS novelty, (CASE len(s) WHEN 0 THEN 0 WHEN 1 THEN 0.2 WHEN 2 THEN 0.6 WHEN 3 THEN 0.8 ELSE 1 END)::DOUBLE AS chaining FROM n""",
)
_T = dict(association="(variant_id % 11) / 10.0", target_class="CASE variant_id % 4 WHEN 0 THEN 'Kinase' WHEN 1 THEN 'GPCR' WHEN 2 THEN 'enzyme' END", n_ligands="variant_id % 700", n_compounds="variant_id * 3 % 900", n_potent="variant_id % 80", max_phase="variant_id % 5 - 1", n_trials="variant_id % 3", n_pdb="variant_id % 4", cocrystal="variant_id % 2 = 0", resolution="CASE WHEN variant_id % 5 > 0 THEN 1.5 + variant_id % 3 END", alphafold="variant_id % 7 = 0", penalty="-(variant_id % 4) * 5")
query(
    "agg47_target_score", "annotations", lambda a: C.target_score(a.select("variant_id", *[F.expr(f"{v}").alias(k) for k, v in _T.items()])).select("variant_id", "disease", "druggability", "chemistry", "clinical", "structure", F.col("score").cast("bigint").alias("score"), "decision"),
    f"""WITH e AS (SELECT variant_id, {', '.join(f'{v} AS {k}' for k, v in _T.items())} FROM annotations),
s AS (SELECT *, CASE WHEN association >= 0.7 THEN 20 WHEN association >= 0.4 THEN 10 ELSE 0 END AS disease, CASE WHEN target_class IN ('Kinase', 'GPCR') THEN 10 WHEN target_class IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN n_ligands > 500 THEN 6 WHEN n_ligands > 100 THEN 5 WHEN n_ligands > 10 THEN 3 WHEN n_ligands > 0 THEN 1 ELSE 0 END AS druggability,
  CASE WHEN n_compounds > 500 THEN 8 WHEN n_compounds > 100 THEN 6 WHEN n_compounds > 10 THEN 3 WHEN n_compounds > 0 THEN 1 ELSE 0 END + CASE WHEN n_potent > 50 THEN 7 WHEN n_potent > 10 THEN 5 WHEN n_potent > 0 THEN 3 ELSE 0 END AS chemistry, CASE WHEN max_phase >= 1 THEN 20 WHEN n_trials > 0 THEN 10 ELSE 0 END AS clinical,
  CASE WHEN n_pdb > 0 AND cocrystal AND coalesce(resolution, 99) < 2.5 THEN 20 WHEN n_pdb > 0 OR alphafold THEN 10 ELSE 0 END AS structure FROM e),
t AS (SELECT *, (disease + druggability + chemistry + clinical + structure + penalty)::BIGINT AS score FROM s)
SELECT variant_id, disease, druggability, chemistry, clinical, structure, score, CASE WHEN score >= 75 THEN 'GO' WHEN score >= 50 THEN 'CONDITIONAL_GO' WHEN score >= 25 THEN 'REVIEW' ELSE 'NO_GO' END AS decision FROM t""",
)
query(
    "agg48_benchmark_score", "annotations", lambda a: C.score_against_truth(a.select((F.col("variant_id") % 13).alias("run"), "gene"), a.select("gene").distinct().where("cast(substr(gene, 5) as int) % 3 > 0").select("gene", F.lit(True).alias("is_truth"), F.expr("case when cast(substr(gene, 5) as int) % 3 = 1 then 1 + cast(substr(gene, 5) as int) % 4 end").alias("tier"))),
    """WITH t AS (SELECT DISTINCT gene, CASE WHEN gene[5:]::INT % 3 = 1 THEN 1 + gene[5:]::INT % 4 END AS tier FROM annotations WHERE gene[5:]::INT % 3 > 0), f AS (SELECT DISTINCT variant_id % 13 AS run, gene FROM annotations),
c AS (SELECT run, count(tier) AS tp, count(*) FILTER (t.gene IS NOT NULL AND tier IS NULL) AS fp, count(*) FILTER (t.gene IS NULL) AS unknown, coalesce(sum(1.0 / tier), 0) AS weighted FROM f LEFT JOIN t ON f.gene = t.gene GROUP BY run), n AS (SELECT count(*) AS n FROM t WHERE tier IS NOT NULL)
SELECT run, tp, fp, n - tp AS fn, unknown, round(weighted::DOUBLE, 6) AS weighted, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / n, 6) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / n) / nullif(tp / nullif(tp + fp, 0) + tp / n, 0), 6) AS f1 FROM c, n""",
)
query("set2_first_by_order", "annotations", lambda a: C.first_by_order(a.select("gene", "variant_id", "consequence"), ["gene"], ["variant_id"]), "SELECT gene, min(variant_id) AS variant_id, arg_min(consequence, variant_id) AS consequence FROM annotations GROUP BY gene")
query("set3_truth_sets", "annotations", lambda a: a.where("variant_id % 4 = 0").select("gene").intersect(a.where("variant_id % 3 = 0").select("gene")).withColumn("part", F.lit("both")).union(a.where("variant_id % 40 = 0").select("gene").subtract(a.where("variant_id % 30 = 0").select("gene")).withColumn("part", F.lit("first"))), "SELECT gene, 'both' AS part FROM (SELECT gene FROM annotations WHERE variant_id % 4 = 0 INTERSECT SELECT gene FROM annotations WHERE variant_id % 3 = 0) UNION ALL SELECT gene, 'first' FROM (SELECT gene FROM annotations WHERE variant_id % 40 = 0 EXCEPT SELECT gene FROM annotations WHERE variant_id % 30 = 0)")
query("set4_shared_variants", "genotypes_dense", lambda g: g.where("sample_id = 1").select("variant_id").intersect(g.where("sample_id = 2").select("variant_id")), "SELECT variant_id FROM genotypes_dense WHERE sample_id = 1 INTERSECT SELECT variant_id FROM genotypes_dense WHERE sample_id = 2")
query("jon8_shared_positions", "variants annotations", lambda v, a: v.where("variant_id % 2 = 0").select("chrom", "pos").join(a.where("variant_id % 3 = 0").select("chrom", "pos", "gene"), ["chrom", "pos"]), "SELECT v.chrom, v.pos, a.gene FROM variants v JOIN annotations a ON v.chrom = a.chrom AND v.pos = a.pos WHERE v.variant_id % 2 = 0 AND a.variant_id % 3 = 0")
query("jon10_sheet_match", "obs", lambda o: o.where("cell % 3 = 0").join(o.where("cell % 2 = 0").select("cell", F.lit(1).alias("hit")), "cell", "left").groupBy("cluster").agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched")), "SELECT cluster, count(*) FILTER (cell % 2 = 0) AS matched, count(*) FILTER (cell % 2 > 0) AS unmatched FROM obs WHERE cell % 3 = 0 GROUP BY cluster")
query(
    "jon11_build_check", "genotypes annotations", lambda g, a: pgx.genome_build(g, a.where("gene in ('GENE1', 'GENE2', 'GENE3')").select("variant_id", (F.col("pos") + F.round(F.col("afr") * 500).cast("bigint")).alias("expected_pos")), 25),
    """WITH e AS (SELECT variant_id, pos + round(afr * 500)::BIGINT AS e FROM annotations WHERE gene IN ('GENE1', 'GENE2', 'GENE3')), n AS (SELECT sample_id, count(*) FILTER (abs(pos - e) <= 25) AS n_match, count(*) FILTER (abs(pos - e) > 25) AS n_mismatch FROM genotypes JOIN e USING (variant_id) WHERE pos > 0 GROUP BY sample_id)
SELECT *, n_mismatch >= 2 AND n_mismatch >= n_match AS other_build FROM n""",
)
query("jon15_new_trials", "obs", lambda o: o.where("cell % 2 = 0").select("cell", F.lit("first").alias("register")).unionByName(o.where("cell % 3 = 0").join(o.where("cell % 2 = 0").select("cell"), "cell", "left_anti").select("cell", F.lit("second").alias("register"))), "SELECT cell, 'first' AS register FROM obs WHERE cell % 2 = 0 UNION ALL SELECT cell, 'second' FROM obs WHERE cell % 3 = 0 AND cell % 2 > 0")
query("jon16_citations", "papers", lambda p: p.select("doc_id", F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 3 + 1)).alias("cited")).join(p.select(F.col("doc_id").alias("cited")), "cited", "left_semi").select("doc_id", "cited"), "SELECT doc_id, c AS cited FROM (SELECT doc_id, unnest([doc_id * 2, doc_id * 3 + 1]) AS c FROM papers) WHERE c IN (SELECT doc_id FROM papers)")
query("jon17_several_domains", "annotations", lambda a: a.groupBy("gene").agg(F.countDistinct("impact").alias("n_domains")).where("n_domains >= 5"), "SELECT gene, count(DISTINCT impact) AS n_domains FROM annotations GROUP BY gene HAVING count(DISTINCT impact) >= 5")
query(
    "jon22_profile", "genotypes scores counts", lambda g, s, c: g.groupBy("sample_id").agg(F.count("genotype").alias("n_calls"), F.max_by("chrom", F.struct("pos", "chrom")).alias("last_chrom")).join(c.where("count > 150").groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("gene").cast("string"))), ",").alias("high_genes")), "sample_id", "left"),
    "SELECT g.sample_id, g.n_calls, g.last_chrom, c.high_genes FROM (SELECT sample_id, count(genotype) AS n_calls, arg_max(chrom, pos) AS last_chrom FROM genotypes GROUP BY sample_id) g LEFT JOIN (SELECT sample_id, string_agg(gene::VARCHAR, ',' ORDER BY gene::VARCHAR) AS high_genes FROM counts WHERE count > 150 GROUP BY sample_id) c USING (sample_id)",
)
query(
    "jon23_dossier", "annotations sumstats", lambda a, s: a.groupBy("gene").agg(F.count("*").alias("n_variants"), F.min("gnomad_af").alias("least_af")).join(s.join(a.select("variant_id", "gene"), "variant_id").groupBy("gene").agg(F.round(F.max(F.abs("z")), 6).alias("best_z"), F.size(F.collect_list(F.struct("variant_id", "z"))).cast("bigint").alias("n_stats")), "gene", "left"),
    "SELECT * FROM (SELECT gene, count(*) AS n_variants, min(gnomad_af) AS least_af FROM annotations GROUP BY gene) LEFT JOIN (SELECT gene, round(max(abs(z)), 6) AS best_z, count(*) AS n_stats FROM sumstats JOIN annotations USING (variant_id) GROUP BY gene) USING (gene)",
)
query("win9_latest_version", "annotations", lambda a: C.latest_versions(a.select(F.col("gene").alias("tool"), F.concat_ws(".", (F.col("variant_id") % 3).cast("string"), (F.col("variant_id") % 13).cast("string")).alias("version"))), "SELECT gene AS tool, (variant_id % 3) || '.' || (variant_id % 13) AS latest, n_versions FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY variant_id % 3 DESC, variant_id % 13 DESC) AS r FROM annotations) JOIN (SELECT gene, count(DISTINCT (variant_id % 3, variant_id % 13)) AS n_versions FROM annotations GROUP BY gene) USING (gene) WHERE r = 1")
query("win5_insert_median", "cells", lambda c: C.weighted_median_size(c.groupBy((F.col("gene") % 10).alias("sample"), F.col("count").alias("size")).agg(F.count("*").alias("n"))), "WITH h AS (SELECT gene % 10 AS sample, count AS size, count(*) AS n FROM cells GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY sample ORDER BY size) AS upto, sum(n) OVER (PARTITION BY sample) AS total FROM h) SELECT sample, min(size) FILTER (upto >= (total + 1) / 2) AS median, round(sum(n * size) / sum(n), 6) AS mean FROM c GROUP BY sample")
query("win6_n50", "cells", lambda c: C.n50(c.select((F.col("gene") % 10).alias("assembly"), F.col("count").alias("length"))), "WITH x AS (SELECT gene % 10 AS assembly, count AS length, sum(count) OVER (PARTITION BY gene % 10 ORDER BY count DESC) AS upto, sum(count) OVER (PARTITION BY gene % 10) AS total FROM cells) SELECT assembly, max(length) AS n50 FROM x WHERE upto >= total / 2 GROUP BY assembly")
query("agg44_depth", "cells", lambda c: c.groupBy("gene").agg(F.round(F.avg("count"), 6).alias("depth"), F.round(F.count_if(F.col("count") >= 10) / F.count("*"), 6).alias("breadth")), "SELECT gene, round(avg(count), 6) AS depth, round(count(*) FILTER (count >= 10) / count(*), 6) AS breadth FROM cells GROUP BY gene")
query("agg50_confidence_bands", "cells", lambda c: c.withColumn("b", F.col("count") * 2).groupBy("gene").agg(*[F.round(100 * F.count_if((F.col("b") >= lo) & (F.col("b") < hi)) / F.count("*"), 6).alias(n) for n, lo, hi in (("very_high", 90, 10**9), ("confident", 70, 90), ("low", 50, 70), ("very_low", 0, 50))]), "SELECT gene, round(100 * count(*) FILTER (count * 2 >= 90) / count(*), 6) AS very_high, round(100 * count(*) FILTER (count * 2 BETWEEN 70 AND 89) / count(*), 6) AS confident, round(100 * count(*) FILTER (count * 2 BETWEEN 50 AND 69) / count(*), 6) AS low, round(100 * count(*) FILTER (count * 2 < 50) / count(*), 6) AS very_low FROM cells GROUP BY gene")
query("agg36_phase_status", "obs", lambda o: o.groupBy("batch").pivot("label", list(range(5))).count().select("batch", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"status{i}") for i in range(5)]), f"SELECT batch, {', '.join(f'count(*) FILTER (label = {i}) AS status{i}' for i in range(5))} FROM obs GROUP BY batch")
query("agg35_drug_evidence", "annotations", lambda a: a.withColumn("level", F.element_at(F.array(*map(F.lit, ["1A", "1B", "2A", "2B", "3", "4"])), (F.col("variant_id") % 6 + 1).cast("int"))).groupBy("gene").agg(F.min("level").alias("best_level"), F.array_join(F.array_sort(F.collect_set("impact")), ",").alias("sources"), F.bool_or(F.col("clinvar") == "drug_response").alias("verified")), "SELECT gene, min((['1A', '1B', '2A', '2B', '3', '4'])[variant_id % 6 + 1]) AS best_level, string_agg(DISTINCT impact, ',' ORDER BY impact) AS sources, bool_or(clinvar = 'drug_response') AS verified FROM annotations GROUP BY gene")
query("agg53_sheet_summary", "obs", lambda o: o.groupBy("batch").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("cluster")), ",").alias("projects")), "SELECT batch, count(*) AS n, string_agg(DISTINCT cluster::VARCHAR, ',' ORDER BY cluster::VARCHAR) AS projects FROM obs GROUP BY batch")
query("fil15_trial_status", "obs", lambda o: o.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("n_recruiting")), "SELECT cluster, count(*) AS n, count(*) FILTER (label = 0) AS n_recruiting FROM obs GROUP BY cluster")
query("srt5_merged_genes", "annotations", lambda a: C.first_by_order(a.where("variant_id % 5 = 0").select("gene", (F.col("variant_id") + 1000000).alias("seq")).union(a.where("variant_id % 7 = 0").select("gene", F.col("variant_id").alias("seq"))), ["gene"], ["seq"]).orderBy("seq").limit(30), "SELECT gene, min(seq) AS seq FROM (SELECT gene, variant_id + 1000000 AS seq FROM annotations WHERE variant_id % 5 = 0 UNION ALL SELECT gene, variant_id FROM annotations WHERE variant_id % 7 = 0) GROUP BY gene ORDER BY seq LIMIT 30")
query("srt7_impact_order", "annotations", A.by_impact, "SELECT upper(impact) AS impact, CASE upper(impact) WHEN 'HIGH' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END AS impact_rank, count(*) AS n, count(*) FILTER (clinvar ILIKE '%pathogenic%') AS n_pathogenic FROM annotations GROUP BY ALL")
def _contrast(v):
    grp = F.when(F.col("n") > F.avg("n").over(W.partitionBy(F.lit(1))), 1).otherwise(0)  # a row a label
    out = L.group_contrast(v.select(F.col("variance").alias("value"), grp.alias("grp")))
    return out.select("n1", "n0", *[F.round(c, n).alias(c) for c, n in (("mean1", 6), ("mean0", 6), ("t", 4), ("df", 4), ("d", 4))])


_U = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM vectors), l AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(u) AS x FROM u), c AS (SELECT label, i, avg(x) AS x FROM l GROUP BY ALL)"
query("agg51_isolation", "vectors", L.isolation, f"WITH {_U}, n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label), d AS (SELECT a.label, b.label AS other, 1 - sum(a.x * b.x) / (max(na.n) * max(nb.n)) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 9), other) AS r FROM d) SELECT label, round(avg(d), 6) AS isolation FROM k WHERE r <= 3 GROUP BY label")
query("agg51_variance", "vectors", L.within_variance, f"WITH {_U}, d AS (SELECT l.vec_id, l.label, sum((l.x - c.x) * (l.x - c.x)) AS d FROM l JOIN c ON l.label = c.label AND l.i = c.i GROUP BY ALL) SELECT label, round(avg(d), 6) AS variance, count(*) AS n FROM d GROUP BY label")
_CENTRES = f"{_U}, m AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM c)"
query("agg51_transfer", "vectors", L.transfer_potential, f"WITH {_CENTRES}, d AS (SELECT a.label, b.label AS other, sum(a.x * b.x) AS s FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY ALL) SELECT label, round(avg(s), 6) AS transfer FROM d GROUP BY label")
query(
    "agg51_drift", "dated_vectors", L.yearly_drift,
    """WITH u AS (SELECT label, year, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM dated_vectors), l AS (SELECT label, year, unnest(range(64)) AS i, unnest(u) AS x FROM u),
c AS (SELECT label, year, i, avg(x) AS x FROM l GROUP BY ALL), m AS (SELECT label, year, i, x / sqrt(sum(x * x) OVER (PARTITION BY label, year)) AS x FROM c), y AS (SELECT label, year, lag(year) OVER (PARTITION BY label ORDER BY year) AS before FROM (SELECT DISTINCT label, year FROM c)),
d AS (SELECT y.label, y.year, 1 - sum(a.x * b.x) AS d FROM y JOIN m a ON a.label = y.label AND a.year = y.year JOIN m b ON b.label = y.label AND b.year = y.before AND b.i = a.i GROUP BY ALL) SELECT label, count(*) AS n_steps, round(avg(d), 6) AS drift FROM d GROUP BY label""",
)
_VARIED = f"{_U}, d AS (SELECT l.vec_id, l.label, sum((l.x - c.x) * (l.x - c.x)) AS d FROM l JOIN c ON l.label = c.label AND l.i = c.i GROUP BY ALL), v AS (SELECT label, count(*) AS n, round(avg(d), 6) AS value FROM d GROUP BY label), g AS (SELECT value, CASE WHEN n > (SELECT avg(n) FROM v) THEN 1 ELSE 0 END AS grp FROM v)"
query(
    "agg51_contrast", "vectors", lambda v: _contrast(L.within_variance(v)),
    f"""WITH {_VARIED}, m AS (SELECT count(*) FILTER (grp = 1) AS n1, count(*) FILTER (grp = 0) AS n0, avg(value) FILTER (grp = 1) AS mean1, avg(value) FILTER (grp = 0) AS mean0, var_samp(value) FILTER (grp = 1) AS v1, var_samp(value) FILTER (grp = 0) AS v0 FROM g), s AS (SELECT *, v1 / n1 AS a, v0 / n0 AS b FROM m)
SELECT n1, n0, round(mean1, 6) AS mean1, round(mean0, 6) AS mean0, round(CASE WHEN n1 > 1 AND n0 > 1 THEN (mean1 - mean0) / sqrt(a + b) END, 4) AS t, round(CASE WHEN n1 > 1 AND n0 > 1 THEN (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)) END, 4) AS df, round(CASE WHEN n1 > 1 AND n0 > 1 THEN (mean1 - mean0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) END, 4) AS d FROM s""",
)
query("num6_graph", "vectors", lambda v: N.neighbour_graph(v, 5).withColumn("nearness", F.round("nearness", 6)))
query(
    "agg29_graph_mixing", "vectors", lambda v: X.graph_mixing(N.neighbour_graph(v, 5, recall=None), v.select("vec_id", "label"), "vec_id", "label").select("vec_id", F.round("cross", 6).alias("cross"), F.round("entropy", 6).alias("entropy")),
    """WITH q AS (SELECT a.vec_id, a.label, b.vec_id AS other, b.label AS ol, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id), e AS (SELECT vec_id, label, ol FROM q QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) <= 5),
p AS (SELECT vec_id, label, ol, count(*) / 5 AS p FROM e GROUP BY ALL) SELECT vec_id, round(sum(CASE WHEN label <> ol THEN p ELSE 0 END), 6) AS "cross", round(0 - sum(p * log2(p)) / (SELECT log2(greatest(2, count(DISTINCT label))) FROM vectors), 6) AS entropy FROM p GROUP BY vec_id""",
)
query(
    "num6_nearest", "vectors", lambda v: L.nearest(v.where("vec_id % 50 = 0").select("vec_id", "embedding"), v, 5).select("vec_id", "neighbour", "rank", F.round("cosine", 6).alias("cosine")),
    "WITH q AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour) AS rank FROM q) SELECT vec_id, neighbour, rank, round(c, 6) AS cosine FROM r WHERE rank <= 5",
)
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2)"
_GENERIC = ", ".join(f"'{w}'" for w in L.GENERIC)
_NORM = "trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9.+_-]+', ' ', 'g'))"
query(
    "num7_catalogue", "catalogue questions", lambda c, q: L.catalogue_search(q, c),
    f"""WITH e AS (SELECT name, {_NORM.format(x='name')} AS key, {_NORM.format(x='text')} AS t FROM catalogue WHERE name IS NOT NULL), q AS (SELECT query_id, {_NORM.format(x='text')} AS q FROM questions),
w AS (SELECT query_id, q, list_filter(list_distinct(string_split(q, ' ')), lambda x: length(x) >= 3 AND x NOT IN ({_GENERIC})) AS ws FROM q WHERE q <> ''),
s AS (SELECT query_id, name, (CASE WHEN key = q THEN 35 ELSE 0 END + CASE WHEN contains(t, q) THEN 18 ELSE 0 END)::BIGINT AS s, len(list_filter(ws, lambda x: contains(t, x)))::BIGINT AS n_words FROM w, e),
r AS (SELECT query_id, name, (s + least(7 * n_words, 21))::BIGINT AS score, n_words FROM s) SELECT query_id, name, score, n_words, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM r WHERE score > 0 QUALIFY rank <= 20""",
)
query(
    "num7_keyword_ranking", "papers items", lambda p, i: L.keyword_ranking(i.select(F.col("item_id").alias("query_id"), "text"), p, 10),
    f"WITH q AS (SELECT query_id, unnest(list_distinct(t)) AS word FROM (SELECT item_id AS query_id, {_TOK} AS t FROM items)), d AS (SELECT doc_id, word, least(count(*), 3) AS c FROM (SELECT doc_id, unnest({_TOK}) AS word FROM papers) GROUP BY ALL), s AS (SELECT query_id, doc_id, sum(c)::BIGINT AS score FROM q JOIN d USING (word) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10",
)
query("num8_chunks", "papers", lambda p: L.chunks(p).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk") + 1).alias("total")))
query("num9_term_counts", "papers", lambda p: L.term_counts(p, ["the", "license", "token", "stupid"]), "WITH t AS (SELECT unnest(['the', 'license', 'token', 'stupid']) AS term) SELECT term, count(*) FILTER (contains(lower(text), term)) AS n_docs, sum(len(string_split(lower(text), term)) - 1)::BIGINT AS n FROM papers, t GROUP BY term")
query("agg42_composition", "papers", lambda p: p.select("doc_id", *[F.round(100 * (F.length("text") - F.length(F.replace(F.lower("text"), F.lit(b), F.lit("")))) / F.length("text"), 4).alias(f"pct_{b}") for b in "acgt"]), "SELECT doc_id, " + ", ".join(f"round(100 * (length(text) - length(replace(lower(text), '{b}', ''))) / length(text), 4) AS pct_{b}" for b in "acgt") + " FROM papers")
query("agg42_dinucleotides", "papers", lambda p: p.select(F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("s")).select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))), lambda i: F.substr("s", i, F.lit(2))), lambda x: F.length(x) == 2)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "pair").limit(5), "WITH s AS (SELECT regexp_replace(lower(text), '[^acgt]', '', 'g') AS s FROM papers), p AS (SELECT s[i:i + 1] AS pair FROM (SELECT s, unnest(range(1, length(s))) AS i FROM s)) SELECT pair, count(*) AS n FROM p GROUP BY pair ORDER BY n DESC, pair LIMIT 5")
query("set5_disjoint_pairs", "breeders", lambda p: C.disjoint_members(*B.compatible_classes(_carriers(p))))
