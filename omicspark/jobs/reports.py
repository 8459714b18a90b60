"""Queries on result tables brought together."""

from pyspark.sql import functions as F

from omicspark.jobs.query import query
from omicspark.operators import annotate as A
from omicspark.operators import cohort as C
from omicspark.operators import expression as X
from omicspark.operators import gwas as G
from omicspark.operators import popgen as P
from omicspark.operators import reports as R


def _r(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


query(
    "jon4_panel_genotypes", "genotypes annotations", lambda g, a: R.panel_genotypes(g, a),
    "SELECT sample_id, gene, n_panel, count(*) AS n_called, string_agg(variant_id || ':' || genotype, ',' ORDER BY variant_id) AS genotypes FROM genotypes JOIN annotations USING (variant_id) JOIN (SELECT gene, count(*) AS n_panel FROM annotations GROUP BY gene) USING (gene) WHERE genotype IS NOT NULL GROUP BY sample_id, gene, n_panel",
)
_WARFARIN = """s AS (SELECT DISTINCT o_custkey AS sample_id FROM orders), c AS (SELECT sample_id, max(diplotype) FILTER (gene = 'CYP2C9') AS d1, max(diplotype) FILTER (gene = 'VKORC1') AS d2, max(phenotype) FILTER (gene = 'CYP2C9') AS p1, max(phenotype) FILTER (gene = 'VKORC1') AS p2 FROM pgx_calls GROUP BY sample_id),
m AS (SELECT s.sample_id, d1, d2, p1, p2, CASE WHEN p1 IS NULL THEN 'CYP2C9' WHEN p2 IS NULL OR p2 ILIKE '%indeterminate%' THEN 'VKORC1' END AS missing FROM s LEFT JOIN c USING (sample_id))
SELECT sample_id, 'warfarin' AS drug, 'CYP2C9 + VKORC1' AS gene, 'CYP2C9 ' || coalesce(d1, '?') || ' / VKORC1 ' || coalesce(d2, '?') AS diplotype, 'CYP2C9 ' || coalesce(p1, '?') || ' / VKORC1 ' || coalesce(p2, '?') AS phenotype,
  CASE WHEN missing IS NOT NULL OR p1 ILIKE '%unknown%' OR p2 ILIKE '%unknown%' THEN 'indeterminate' WHEN p1 ILIKE '%normal%' AND p2 ILIKE '%normal%' THEN 'standard' WHEN p1 ILIKE '%poor%' OR p2 ILIKE '%high%' THEN 'avoid' ELSE 'caution' END AS action, missing FROM m"""
query("jon5_warfarin", "pgx_calls drug_actions", lambda c, d: R.warfarin(d.select("sample_id"), c), f"WITH {_WARFARIN.replace('o_custkey AS sample_id FROM orders', 'sample_id FROM drug_actions')}")
query(
    "jon5_single_drug", "pgx_calls guide drug_actions", lambda c, g, d: R.single_drug(d.select("sample_id"), c, g, "BUILDING"),
    """WITH s AS (SELECT DISTINCT sample_id FROM drug_actions), g AS (SELECT * FROM guide WHERE drug = 'BUILDING'), k AS (SELECT DISTINCT gene FROM g)
SELECT s.sample_id, 'BUILDING' AS drug, k.gene, CASE WHEN c.sample_id IS NULL THEN 'NOT_TESTED' ELSE c.diplotype END AS diplotype, CASE WHEN c.sample_id IS NULL THEN 'Indeterminate' ELSE c.phenotype END AS phenotype, coalesce(g.action, 'indeterminate') AS action
FROM s CROSS JOIN k LEFT JOIN pgx_calls c ON c.sample_id = s.sample_id AND c.gene = k.gene LEFT JOIN g ON g.gene = c.gene AND g.phenotype = c.phenotype""",
)
query(
    "jon22_person_profile", "drug_actions trait_scores nutrients ancestry", R.person_profile,
    """WITH d AS (SELECT sample_id, count(DISTINCT gene) AS genes_profiled, count(*) FILTER (action = 'avoid') AS n_avoid, count(*) FILTER (action = 'caution') AS n_caution, count(*) FILTER (action = 'standard') AS n_standard FROM drug_actions GROUP BY sample_id),
t AS (SELECT sample_id, trait, risk || ' ' || trait || ' (' || round_even(percentile, 0)::INT || ')' AS t, row_number() OVER (PARTITION BY sample_id ORDER BY trait) AS k FROM trait_scores WHERE percentile IS NOT NULL),
s AS (SELECT sample_id, coalesce(string_agg(t.t, '; ' ORDER BY k) FILTER (k <= 3), '') AS risks, greatest(count(t.t) - 3, 0) AS more_traits FROM (SELECT DISTINCT sample_id FROM trait_scores) LEFT JOIN t USING (sample_id) GROUP BY sample_id),
n AS (SELECT sample_id, count(DISTINCT domain) AS domains_assessed, coalesce(string_agg(DISTINCT domain, ',' ORDER BY domain) FILTER (category = 'Elevated'), '') AS elevated, coalesce(string_agg(DISTINCT domain, ',' ORDER BY domain) FILTER (category = 'Moderate'), '') AS moderate FROM nutrients GROUP BY sample_id),
a AS (SELECT sample_id, population AS top_population, share AS top_share FROM ancestry QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY share DESC, population DESC) = 1)
SELECT * FROM d FULL JOIN s USING (sample_id) FULL JOIN n USING (sample_id) FULL JOIN a USING (sample_id)""",
)
_TEXT = lambda c, f: F.array_join(F.transform(c, f), ",")
query(
    "jon23_target_dossier", "targets associations gene_papers gene_trials",
    lambda t, a, p, r: R.target_dossier(t, a, p, r).withColumns({"papers": _TEXT("papers", lambda x: F.concat_ws(":", x["paper_id"], x["year"])), "trials": _TEXT("trials", lambda x: F.concat_ws(":", x["trial_id"], x["status"]))}),
    """WITH a AS (SELECT gene, disease, max(score) AS score FROM associations GROUP BY ALL), p AS (SELECT gene, disease, max(n) AS n_papers, string_agg(paper_id || ':' || year, ',' ORDER BY r) AS papers FROM (SELECT *, count(*) OVER (PARTITION BY gene, disease) AS n, row_number() OVER (PARTITION BY gene, disease ORDER BY year DESC, paper_id) AS r FROM gene_papers) WHERE r <= 5 GROUP BY ALL),
t AS (SELECT gene, disease, max(n) AS n_trials, max(k) AS n_recruiting, string_agg(trial_id || ':' || status, ',' ORDER BY r) AS trials FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (upper(status) = 'RECRUITING') OVER w AS k, row_number() OVER (PARTITION BY gene, disease ORDER BY trial_id) AS r FROM gene_trials WINDOW w AS (PARTITION BY gene, disease)) WHERE r <= 5 GROUP BY ALL)
SELECT gene, disease, score, coalesce(n_papers, 0) AS n_papers, papers, coalesce(n_trials, 0) AS n_trials, coalesce(n_recruiting, 0) AS n_recruiting, trials, summary FROM a FULL JOIN p USING (gene, disease) FULL JOIN t USING (gene, disease) LEFT JOIN targets USING (gene)""",
)
query(
    "jon15_second_register", "gene_trials", lambda t: R.new_in_second(*[t.where(F.col("register") == k).select("trial_id", "status") for k in ("F", "O")], "trial_id").withColumnRenamed("register", "source"),
    "SELECT trial_id, status, 'first' AS source FROM gene_trials WHERE register = 'F' UNION ALL SELECT trial_id, status, 'second' FROM gene_trials WHERE register = 'O' AND trial_id NOT IN (SELECT trial_id FROM gene_trials WHERE register = 'F')",
)
query("jon16_citations_within", "citations papers", lambda c, p: R.citations_within(c, p), "WITH e AS (SELECT DISTINCT doc_id, cited FROM citations WHERE doc_id <> cited AND doc_id IN (SELECT doc_id FROM papers) AND cited IN (SELECT doc_id FROM papers)) SELECT doc_id, cited, count(*) OVER (PARTITION BY cited) AS n_cited FROM e")
query("jon17_in_several", "associations gene_trials", lambda a, t: R.in_several(a.select(F.col("disease").alias("domain"), "gene").union(t.select(F.col("phase").alias("domain"), "gene")), 9), "SELECT gene, count(*) AS n_domains, string_agg(domain, ',' ORDER BY domain) AS domains FROM (SELECT disease AS domain, gene FROM associations UNION SELECT phase, gene FROM gene_trials) GROUP BY gene HAVING count(*) >= 9")
query(
    "jon8_shared_alleles", "variants genotypes", lambda v, g: R.shared_positions(v, g.where("sample_id < 100").select("chrom", "pos", F.col("alt").alias("ref"), F.col("ref").alias("alt")).distinct()),
    "SELECT v.chrom, v.pos, v.ref, v.alt, a.alt AS archaic_ref, a.ref AS archaic_alt, v.ref = a.ref AND v.alt = a.alt OR v.ref = a.alt AND v.alt = a.ref AS same_alleles FROM variants v JOIN (SELECT DISTINCT chrom, pos, ref, alt FROM genotypes WHERE sample_id < 100) a USING (chrom, pos)",
)
query("jon10_enriched", "people sheet", lambda p, s: R.enriched(p.select("id", "sex"), s, "id"), "SELECT p.id, sex, project, kind, project IS NOT NULL AS matched FROM people p LEFT JOIN (SELECT id, project, kind FROM sheet QUALIFY row_number() OVER (PARTITION BY id ORDER BY project, kind) = 1) s ON s.id = p.id")
query("jon10_match_counts", "people sheet", lambda p, s: R.match_counts(R.enriched(p.select("id"), s, "id")), "SELECT count(*) AS n, count(*) FILTER (id IN (SELECT id FROM sheet)) AS n_matched, count(*) FILTER (id NOT IN (SELECT id FROM sheet)) AS n_unmatched FROM people")
query("agg53_projects", "sheet", lambda s: R.sheet_summary(s, "kind", ["project"]), "SELECT kind, count(*) AS n, count(DISTINCT project) AS n_project, string_agg(DISTINCT project, ',' ORDER BY project) AS project FROM sheet GROUP BY kind")
query(
    "jon12_delta_by_group", "measured people", lambda m, p: _r(R.paired_delta(m, p.select(F.col("id").alias("subject"), F.col("sex").alias("grp")), "O", "F"), "delta", digits=4),
    "WITH d AS (SELECT feature, subject, avg(value) FILTER (time = 'O') AS x, avg(value) FILTER (time = 'F') AS y FROM measured GROUP BY ALL) SELECT feature, subject, sex AS grp, round(y - x, 4) AS delta FROM d LEFT JOIN people ON id = subject WHERE x IS NOT NULL AND y IS NOT NULL",
)
query(
    "jon20_outliers_in_panel", "counts annotations", lambda c, a: _r(R.outliers_in_panel(X.outliers(c.select("gene", "sample_id", F.col("count").cast("double").alias("value")), F.col("sample_id") >= 5, 2.0), a.where("clinvar is not null").select(F.col("variant_id").alias("gene"), F.col("clinvar").alias("disease"), F.col("impact").alias("mechanism"))), "z"),
    """WITH m AS (SELECT gene, quantile_cont(count::DOUBLE, 0.5) AS m FROM counts WHERE sample_id >= 5 GROUP BY gene), d AS (SELECT gene, m, quantile_cont(abs(count - m), 0.5) AS mad FROM counts JOIN m USING (gene) WHERE sample_id >= 5 GROUP BY gene, m),
z AS (SELECT gene, sample_id, 0.6745 * (count - m) / mad AS z FROM counts JOIN d USING (gene) WHERE sample_id < 5 AND mad > 0)
SELECT z.gene, sample_id, round(z, 6) AS z, coalesce(clinvar, 'not in panel') AS disease, CASE WHEN clinvar IS NULL THEN 'not in panel' ELSE impact END AS mechanism, CASE WHEN z > 0 THEN 'over' ELSE 'under' END AS direction FROM z LEFT JOIN annotations a ON a.variant_id = z.gene AND clinvar IS NOT NULL WHERE abs(z) >= 2""",
)
query("fil6_without_warned", "measured", lambda m: R.without_warned(m).groupBy("feature").agg(F.countDistinct("sample_id").alias("n_samples"), F.count("*").alias("n")), "SELECT feature, count(DISTINCT sample_id) AS n_samples, count(*) AS n FROM measured WHERE sample_id NOT IN (SELECT sample_id FROM measured WHERE upper(qc_warning) LIKE 'WARN%') GROUP BY feature")
query("fil7_aptamer_values", "measured", lambda m: _r(R.aptamer_values(m), "value").groupBy("feature", "sample_id").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.round(F.sum("value"), 4).alias("total")), "SELECT feature, sample_id, count(*) AS n, count(v) AS n_value, round(sum(v), 4) AS total FROM (SELECT feature, sample_id, round(log10(CASE WHEN rfu > 0 THEN rfu END), 6) AS v FROM measured WHERE upper(row_check) = 'PASS' AND sample_type = 'Sample' AND upper(col_check) = 'PASS') GROUP BY ALL")
query("agg31_detection", "measured", R.detection, "SELECT feature, count(*) AS n, count(*) FILTER (npx > lod) AS n_above, round(100 * count(*) FILTER (npx > lod) / count(*), 6) AS above_lod_pct FROM measured GROUP BY feature")
_BASE = "WITH b AS (SELECT gene, avg(count) AS base_mean FROM counts GROUP BY gene) SELECT gene, round(base_mean, 6) AS base_mean FROM b WHERE base_mean >= {x} OR (SELECT count(*) FROM b WHERE base_mean >= {x}) = 0"
query("fil11_display_filter", "counts", lambda c: _r(R.base_mean_filter(c.groupBy("gene").agg(F.avg("count").alias("base_mean")), 30), "base_mean"), _BASE.format(x=30))
query("fil11_fall_back", "counts", lambda c: _r(R.base_mean_filter(c.groupBy("gene").agg(F.avg("count").alias("base_mean")), 10**9), "base_mean"), _BASE.format(x=10**9))
query("fil15_recruiting", "gene_trials", lambda t: R.recruiting(t, ["recruiting", "completed"]).select("trial_id", "disease", "status", "n_recruiting"), "SELECT trial_id, disease, status, count(*) FILTER (status = 'Recruiting') OVER (PARTITION BY disease) AS n_recruiting FROM gene_trials WHERE upper(status) IN ('RECRUITING', 'COMPLETED')")
query("agg36_phase_by_status", "gene_trials", lambda t: R.phase_by_status(t, ["Recruiting", "Completed"]), "SELECT phase, count(*) FILTER (upper(status) = 'RECRUITING') AS recruiting, count(*) FILTER (upper(status) = 'COMPLETED') AS completed, count(*) FILTER (upper(status) = 'WITHDRAWN') AS other, count(*) AS total FROM gene_trials GROUP BY phase")
_LEVEL = "CASE impact WHEN 'HIGH' THEN '1A' WHEN 'MODERATE' THEN '2B' WHEN 'LOW' THEN '4' ELSE 'x' END"
query(
    "agg35_best_evidence", "annotations", lambda a: R.drug_evidence(a.select(F.col("gene").alias("drug"), F.expr(_LEVEL).alias("level"), F.col("clinvar").alias("source"), (F.col("gnomad_af") > 0).alias("verified"))),
    f"SELECT gene AS drug, (['1A', '1B', '2A', '2B', '3', '4', 'x'])[min(list_position(['1A', '1B', '2A', '2B', '3', '4', 'x'], {_LEVEL}))] AS best_level, coalesce(string_agg(DISTINCT clinvar, ',' ORDER BY clinvar), '') AS sources, count(*) AS n, coalesce(bool_or(gnomad_af > 0), false) AS verified FROM annotations GROUP BY gene",
)
query("agg30_relative_abundance", "counts", lambda c: _r(R.relative_abundance(c.select("sample_id", F.col("gene").alias("taxon"), F.col("count").alias("reads"))), "pct"), "SELECT sample_id, gene AS taxon, count AS reads, round(100 * count / sum(count) OVER (PARTITION BY sample_id), 6) AS pct FROM counts")
query("agg44_contigs", "cells", lambda c: _r(R.contig_depth(c.groupBy(F.col("gene").alias("contig"), F.col("count").alias("depth")).agg(F.count("*").alias("n")), 20), "mean_depth", "breadth"), "SELECT gene AS contig, count(*) AS length, round(avg(count), 6) AS mean_depth, round(count(*) FILTER (count >= 20) / count(*), 6) AS breadth FROM cells GROUP BY gene")
query("agg44_inserts", "cells", lambda c: _r(R.insert_sizes(c.groupBy(F.col("gene").alias("sample"), F.col("count").alias("size")).agg(F.count("*").alias("n"))), "mean", "sd", digits=4), "SELECT gene AS sample, count(*) AS n, round(avg(count), 4) AS mean, round(stddev_pop(count), 4) AS sd FROM cells GROUP BY gene")
query("agg50_bands", "measured", lambda m: R.confidence_bands(m.select(F.col("feature").alias("structure"), (F.col("npx") * 2).alias("confidence"))), "SELECT feature AS structure, count(*) AS n, round(100 * count(*) FILTER (npx * 2 >= 90) / count(*), 6) AS very_high, round(100 * count(*) FILTER (npx * 2 >= 70 AND npx * 2 < 90) / count(*), 6) AS confident, round(100 * count(*) FILTER (npx * 2 >= 50 AND npx * 2 < 70) / count(*), 6) AS low, round(100 * count(*) FILTER (npx * 2 < 50) / count(*), 6) AS very_low FROM measured GROUP BY feature")
query("agg52_replicates", "measured", lambda m: _r(R.probe_means(m.select(F.concat_ws("_", F.split("feature", " ")[0], "time").alias("probe"), "sample_id", "npx").withColumnRenamed("npx", "value")), "value"), "SELECT split_part(feature, ' ', 1) AS probe, sample_id, count(*) AS n, round(avg(npx), 6) AS value FROM measured GROUP BY ALL")
query("agg38_population", "people", R.population_by_generation, "SELECT generation, count(*) AS n, round(count(*) FILTER (sex = 'Male') / count(*), 4) AS sex_ratio, round(avg(coalesce(health, 1)), 4) AS health_mean, round(min(coalesce(health, 1)), 4) AS health_least, round(max(coalesce(health, 1)), 4) AS health_most FROM people GROUP BY generation")
query(
    "agg38_trait_drift", "people person_traits", R.trait_drift,
    "WITH k AS (SELECT id, generation FROM people WHERE id IN (SELECT id FROM person_traits)), t AS (SELECT DISTINCT generation, trait FROM person_traits JOIN k USING (id)), x AS (SELECT k.generation, t.trait, coalesce(score, 0.5) AS s FROM k JOIN t USING (generation) LEFT JOIN person_traits p ON p.id = k.id AND p.trait = t.trait) SELECT generation, trait, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS sd FROM x GROUP BY ALL",
)
query("agg38_diversity", "people person_calls", R.diversity, "SELECT generation, count(*) AS n, round(avg(h), 4) AS heterozygosity FROM (SELECT id, count(*) FILTER (dosage = 1) / count(*) AS h FROM person_calls GROUP BY id) JOIN people USING (id) GROUP BY generation")
query("agg38_mutations", "people mutations", R.mutation_burden, "SELECT generation, count(kind) AS total, count(*) FILTER (kind = 'disease_risk') AS disease_risk, count(*) FILTER (kind = 'protective') AS protective, count(*) FILTER (kind = 'neutral') AS neutral FROM people LEFT JOIN mutations USING (id) GROUP BY generation")
query("agg38_prevalence", "people conditions", R.prevalence, "SELECT generation, condition, count(*) AS n, round(count(DISTINCT id) / max(k), 6) AS share FROM people JOIN conditions USING (id) JOIN (SELECT generation, count(*) AS k FROM people GROUP BY generation) USING (generation) GROUP BY ALL")
query("agg39_allele_drift", "people person_calls", R.allele_drift, "SELECT generation, locus, count(*) AS n, round(sum(dosage) / (2 * count(*)), 4) AS af FROM people JOIN person_calls USING (id) GROUP BY ALL")
query(
    "agg40_inferred_traits", "people person_calls registry", lambda p, c, g: R.inferred_traits(p, c, g.drop("dominance0")),
    """WITH x AS (SELECT id, trait, effect, CASE dominance WHEN 'dominant' THEN (dosage >= 1)::INT WHEN 'recessive' THEN (dosage = 2)::INT ELSE dosage * 0.5 END AS s FROM person_calls JOIN registry USING (locus)), g AS (SELECT id, trait, round(sum(s * effect) / sum(effect), 4) AS v FROM x GROUP BY ALL)
SELECT p.id, t.trait, coalesce(v, 0.5) AS value FROM people p CROSS JOIN (SELECT DISTINCT trait FROM registry) t LEFT JOIN g ON g.id = p.id AND g.trait = t.trait""",
)
query(
    "agg48_lead_recovery", "finemapped causal", lambda f, c: R.lead_recovery(f.where("in_set").select(F.col("method").alias("run"), "variant"), c.select("variant", "gene")),
    """WITH f AS (SELECT DISTINCT method AS run, variant FROM finemapped WHERE in_set), g AS (SELECT DISTINCT run FROM f), n AS (SELECT count(DISTINCT variant) AS n FROM causal), x AS (SELECT g.run, c.gene, c.variant, f.variant IS NOT NULL AS hit FROM g CROSS JOIN causal c LEFT JOIN f ON f.run = g.run AND f.variant = c.variant)
SELECT run, n AS n_lead, count(*) FILTER (hit) AS n_recovered, round(count(*) FILTER (hit) / n, 4) AS recovery, coalesce(string_agg(DISTINCT gene, ',' ORDER BY gene) FILTER (hit), '') AS recovered, coalesce(string_agg(DISTINCT gene, ',' ORDER BY gene) FILTER (NOT hit), '') AS missed FROM x, n GROUP BY run, n""",
)
query(
    "agg48_method_scores", "finemapped causal", lambda f, c: R.passes(R.method_scores(f, c.select("locus", "variant")), {"recall": 0.1, "precision": 0.01}),
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY method, locus ORDER BY pip DESC, variant) AS r, count(*) OVER (PARTITION BY method, locus) AS n FROM finemapped), t AS (SELECT locus, count(*) AS n_causal FROM causal GROUP BY locus),
g AS (SELECT method, locus, count(*) FILTER (c.variant IS NOT NULL AND in_set) AS captured, coalesce(sum(pip) FILTER (c.variant IS NOT NULL), 0) AS p, coalesce(avg(r) FILTER (c.variant IS NOT NULL), max(n)) AS r, count(*) FILTER (in_set) AS size, max(n) AS n FROM k LEFT JOIN causal c USING (locus, variant) GROUP BY ALL),
s AS (SELECT *, CASE WHEN size > 0 THEN captured / size ELSE 0 END AS pr, captured / n_causal AS re FROM g JOIN t USING (locus))
SELECT method, locus, captured, n_causal, round(p, 4) AS causal_pip, round(r, 1) AS mean_rank, size, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1, round(0.4 * re + 0.3 * p / n_causal + 0.2 * pr + 0.1 * (1 - r / n), 4) AS score, round(re, 4) >= 0.1 AND round(pr, 4) >= 0.01 AS passed FROM s""",
)
query("agg34_grouping_sets", "annotations", lambda a: R.counts_by_fields(a, ["gene", "consequence", "impact", "clinvar"]), "SELECT CASE WHEN grouping(gene) = 0 THEN 'gene' WHEN grouping(consequence) = 0 THEN 'consequence' WHEN grouping(impact) = 0 THEN 'impact' ELSE 'clinvar' END AS field, coalesce(gene, consequence, impact, clinvar) AS value, count(*) AS n FROM annotations GROUP BY GROUPING SETS (gene, consequence, impact, clinvar) HAVING value IS NOT NULL")
_RANK = "CASE consequence WHEN 'stop_gained' THEN 0 WHEN 'frameshift_variant' THEN 1 WHEN 'missense_variant' THEN 2 ELSE 3 END"
query(
    "srt2_notable", "annotations", lambda a: R.notable_non_flagged(a.select("variant_id", F.round(F.col("afr") * 100, 4).alias("score"), F.expr(_RANK).alias("consequence_rank"), F.coalesce(F.col("clinvar") == "Pathogenic", F.lit(False)).alias("flagged"), F.col("gnomad_af").isNotNull().alias("annotated"), F.col("impact").alias("tier")), ["HIGH", "MODERATE"]),
    f"SELECT variant_id, round(afr * 100, 4) AS score, {_RANK} AS consequence_rank, false AS flagged, true AS annotated, impact AS tier FROM annotations WHERE coalesce(clinvar, '') <> 'Pathogenic' AND gnomad_af IS NOT NULL AND impact IN ('HIGH', 'MODERATE') ORDER BY score DESC, consequence_rank, variant_id LIMIT 5",
)
query("set3_truth_parts", "finemapped causal", lambda f, c: f.where("in_set").select("variant").intersect(c.select("variant")).withColumn("part", F.lit("found")).union(c.select("variant").subtract(f.where("in_set").select("variant")).withColumn("part", F.lit("missed"))).union(f.where("in_set").select("variant").subtract(c.select("variant")).withColumn("part", F.lit("unknown"))), "WITH f AS (SELECT DISTINCT variant FROM finemapped WHERE in_set), c AS (SELECT DISTINCT variant FROM causal) SELECT coalesce(f.variant, c.variant) AS variant, CASE WHEN c.variant IS NULL THEN 'unknown' WHEN f.variant IS NULL THEN 'missed' ELSE 'found' END AS part FROM f FULL JOIN c ON f.variant = c.variant")
query("fn16_composition", "papers", lambda p: R.composition(p.select(F.col("doc_id").alias("id"), F.col("text").alias("seq")), "ACDEFGHIKLMNPQRSTVWY"), "SELECT doc_id AS id, letter, (length(s) - length(replace(s, letter, '')))::BIGINT AS n, round(100 * (length(s) - length(replace(s, letter, ''))) / nullif(length(s), 0), 6) AS pct FROM (SELECT doc_id, translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM papers), (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS letter)")
query("agg6_counts_only", "ancestry people", lambda a, p: P.equity_score_of_counts(p.select(F.col("id").alias("sample_id"), F.expr("case when generation < 5 then 'AFR' when generation < 12 then 'eur' when generation < 18 then 'EAS' else 'XX' end").alias("population"))))
query(
    "agg14_leading_traits", "associations", lambda a: G.leading_traits(a.select(F.concat_ws(" ", "gene", F.when(F.col("disease") == "BUILDING", "Level")).alias("trait"), (F.col("score") / 1e7).alias("p")), 12, 3e-9).withColumn("best_p", F.round(F.col("best_p") * 1e9, 6)),
    "WITH t AS (SELECT lower(gene || CASE WHEN disease = 'BUILDING' THEN ' Level' ELSE '' END) AS trait, score / 1e7 AS p FROM associations) SELECT trait, round(min(p) * 1e9, 6) AS best_p, count(*) AS n, contains(trait, 'level') AS measurement FROM t WHERE p < 3e-9 GROUP BY trait ORDER BY measurement, min(p), trait LIMIT 12",
)
_NUTRIENTS = "SELECT variant_id, gene, concat('n', CAST(length(consequence) % 4 AS VARCHAR(2))) AS domain, alt AS risk_allele, ref AS ref_allele, 1.0 AS weight FROM annotations JOIN variants USING (variant_id)"
query(
    "agg33_gene_nutrient", "genotypes annotations variants", lambda g, a, v: _r(A.gene_nutrient_matrix(g.select("sample_id", "variant_id", "genotype"), a.join(v.select("variant_id", "ref", "alt"), "variant_id").select("variant_id", "gene", F.concat(F.lit("n"), (F.length("consequence") % 4).cast("string")).alias("domain"), F.col("alt").alias("risk_allele"), F.col("ref").alias("ref_allele"), F.lit(1.0).alias("weight")), ["n0", "n1", "n2", "n3"]), "n0", "n1", "n2", "n3"),
    f"WITH p AS ({_NUTRIENTS}), r AS (SELECT gene, domain, (length(genotype) - length(replace(genotype, risk_allele, ''))) / 2 AS raw FROM genotypes JOIN p USING (variant_id) WHERE genotype IS NOT NULL) SELECT gene, {', '.join(f'round(coalesce(avg(raw) FILTER (domain = {chr(39)}n{i}{chr(39)}), 0), 6) AS n{i}' for i in range(4))} FROM r GROUP BY gene",
)
_FIT = """x AS (SELECT generation, id AS agent, list(DISTINCT trait) FILTER (score > 0.4) AS s, list(DISTINCT trait) FILTER (score > 0.25 AND score < 0.6) AS r, coalesce(max(health), 0) AS quality FROM people JOIN person_traits USING (id) GROUP BY generation, id),
y AS (SELECT generation, agent, list_sort(coalesce(s, [])) AS s, coalesce(r, []) AS r, quality FROM x), n AS (SELECT *, count(*) OVER (PARTITION BY generation) AS n, count(*) OVER (PARTITION BY generation, s) AS same FROM y),
f AS (SELECT generation, agent, CASE WHEN len(r) = 0 THEN 0.5 ELSE len(list_intersect(s, r)) / len(r) END AS utilization, quality, round(CASE WHEN n <= 1 THEN 0.5 ELSE 1 - (same - 1) / (n - 1) END, 6) AS novelty, (CASE len(s) WHEN 0 THEN 0 WHEN 1 THEN 0.2 WHEN 2 THEN 0.6 WHEN 3 THEN 0.8 ELSE 1 END)::DOUBLE AS chaining FROM n),
c AS (SELECT generation, agent, round(utilization, 4) AS utilization, round(quality, 4) AS quality, round(novelty, 4) AS novelty, chaining, round(0.3 * utilization + 0.3 * quality + 0.2 * novelty + 0.2 * chaining, 4) AS composite FROM f)"""


def _rounds(p, t):
    used, suits = (F.when(c, F.col("trait")) for c in (F.col("score") > 0.4, (F.col("score") > 0.25) & (F.col("score") < 0.6)))
    return p.join(t, "id").groupBy("generation", F.col("id").alias("agent")).agg(F.collect_set(used).alias("skills"), F.collect_set(suits).alias("relevant"), F.max("health").alias("quality"))


query("agg41_composite", "people person_traits", lambda p, t: C.composite_fitness(_rounds(p, t)), f"WITH {_FIT} SELECT * FROM c")
query("agg41_generations", "people person_traits", lambda p, t: _r(C.generation_fitness(C.composite_fitness(_rounds(p, t))), "mean", "sd", *[f"mean_{x}" for x in C.FITNESS_WEIGHTS], digits=11), f"WITH {_FIT} SELECT generation, count(*) AS population, round(avg(composite), 11) AS mean, round(stddev_pop(composite), 11) AS sd, min(composite) AS least, max(composite) AS most, round(avg(utilization), 11) AS mean_utilization, round(avg(quality), 11) AS mean_quality, round(avg(novelty), 11) AS mean_novelty, round(avg(chaining), 11) AS mean_chaining FROM c GROUP BY generation")
_SEQS = lambda p: p.select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))
_ACGT = "x AS (SELECT doc_id AS id, translate(coalesce(text, ''), 'acgt', 'ACGT') AS s FROM papers), y AS (SELECT id, length(s) AS length, " + ", ".join(f"length(s) - length(replace(s, '{b}', '')) AS n_{b.lower()}" for b in "ACGT") + " FROM x), z AS (SELECT *, " + ", ".join(f"round(100 * n_{b} / greatest(length, 1), 2) AS pct_{b}" for b in "acgt") + ", round(100 * (n_g + n_c) / greatest(length, 1), 2) AS gc, round(100 * (n_a + n_t) / greatest(length, 1), 2) AS at FROM y)"
query("agg42_nucleotides", "papers", lambda p: R.nucleotide_stats(_SEQS(p)), f"WITH {_ACGT} SELECT * FROM z")
query("agg42_lengths", "papers", lambda p: R.length_summary(R.nucleotide_stats(_SEQS(p))), f"WITH {_ACGT} SELECT count(*) AS n, sum(length)::BIGINT AS total, min(length) AS least, max(length) AS most, round(avg(length), 1) AS mean, round(avg(gc), 2) AS mean_gc FROM z")
query(
    "agg42_top_pairs", "papers", lambda p: R.top_pairs(_SEQS(p)),
    "WITH x AS (SELECT doc_id AS id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM papers WHERE length(text) > 1), p AS (SELECT id, unnest(list_transform(range(1, length(s)), lambda i: [substr(s, i, 2), i::VARCHAR])) AS q FROM x), n AS (SELECT id, q[1] AS pair, count(*) AS n, min(q[2]::BIGINT) AS first FROM p GROUP BY ALL) SELECT id, pair, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS rank FROM n QUALIFY rank <= 5",
)
