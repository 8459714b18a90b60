"""Queries on frequencies, heterozygosity, FST, scores of equity, genotype quality."""

from pyspark.sql import functions as F

from omicspark.jobs.query import query
from omicspark.operators import popgen as P

_SITES = """s AS (SELECT population, variant_id, count(dosage) AS n_called, coalesce(sum(dosage), 0) AS alt_sum, count(*) FILTER (dosage = 1) AS n_het
  FROM dosages GROUP BY population, variant_id), sz AS (SELECT population, count(DISTINCT sample_id) AS n FROM dosages GROUP BY population)"""
_FST = """af AS (SELECT population, variant_id, alt_sum / (2.0 * n_called) AS p FROM s WHERE n_called > 0),
x AS (SELECT a.population AS population_1, b.population AS population_2, a.p AS p, b.p AS q, na.n AS n, nb.n AS m FROM af a JOIN af b ON a.variant_id = b.variant_id AND a.population < b.population
  JOIN sz na ON na.population = a.population JOIN sz nb ON nb.population = b.population),
y AS (SELECT population_1, population_2, 2 * ((n * p + m * q) / (n + m)) * (1 - (n * p + m * q) / (n + m)) AS ht, (n * 2 * p * (1 - p) + m * 2 * q * (1 - q)) / (n + m) AS hs FROM x),
fst AS (SELECT population_1, population_2, count(*) FILTER (ht > 0.001) AS n_sites,
  round(greatest(sum(ht - hs) FILTER (ht > 0.001) / sum(ht) FILTER (ht > 0.001), 0), 6) AS fst FROM y GROUP BY population_1, population_2)"""
_HET = """h AS (SELECT population, count(*) AS n_sites, round(avg(n_het / n_called), 6) AS observed_het, round(avg(2 * (alt_sum / (2.0 * n_called)) * (1 - alt_sum / (2.0 * n_called))), 6) AS expected_het
  FROM s WHERE n_called > 0 GROUP BY population)"""

query("agg1_allele_freq", "dosages", P.allele_frequencies, f"WITH {_SITES} SELECT population, variant_id, n_called, round(alt_sum / nullif(2.0 * n_called, 0), 6) AS af FROM s")
query("agg2_heterozygosity", "dosages", P.heterozygosity, f"WITH {_SITES}, {_HET} SELECT * FROM h")
query("agg3_fst", "dosages", P.pairwise_fst, f"WITH {_SITES}, {_FST} SELECT * FROM fst")
_REP = """g(population, share) AS (VALUES ('AFR', 0.17), ('AMR', 0.13), ('EAS', 0.22), ('EUR', 0.16), ('SAS', 0.26), ('OCE', 0.005), ('MID', 0.06)),
tot AS (SELECT sum(n) AS total, count(*) AS n_populations, coalesce(sum(n) FILTER (population = 'UNKNOWN'), 0) AS unknown FROM sz),
rep AS (SELECT 1 - max(abs(coalesce(n, 0) / total - share)) AS ri, count(n) / 7 AS gs FROM g LEFT JOIN sz USING (population), tot)"""
query(
    "agg4_representation", "dosages",
    lambda d: P.representation(P.population_sizes(d)).select(F.round("representation_index", 6).alias("representation_index"), F.round("unknown_fraction", 6).alias("unknown_fraction"), "n_samples", "n_populations", F.round("geographic_spread", 6).alias("geographic_spread")),
    f"WITH {_SITES}, {_REP} SELECT round(CASE WHEN unknown / total <= 0.5 THEN greatest(ri, 0) END, 6) AS representation_index, round(unknown / total, 6) AS unknown_fraction, total AS n_samples, n_populations, round(gs, 6) AS geographic_spread FROM rep, tot",
)
query(
    "agg6_equity_score", "dosages", P.equity_score,
    f"""WITH {_SITES}, {_HET}, {_FST}, {_REP},
c AS (SELECT ri, gs, total, n_populations, unknown / total AS uf, (SELECT least(1, avg(observed_het) / 0.5) FROM h) AS hb, least(1, (SELECT count(fst) FROM fst) / (n_populations * (n_populations - 1) / 2)) AS fc FROM rep, tot),
r AS (SELECT *, round(100 * (0.35 * ri + 0.25 * hb + 0.2 * fc + 0.2 * gs), 1) AS score FROM c)
SELECT score, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' WHEN score >= 20 THEN 'Poor' ELSE 'Critical' END AS rating,
  round(ri, 3) AS representation_index, round(hb, 3) AS heterozygosity_balance, round(fc, 3) AS fst_coverage, round(gs, 3) AS geographic_spread, round(uf, 3) AS unknown_fraction, total AS n_samples, n_populations FROM r""",
)
query(
    "agg7_vcf_qc", "genotypes", P.qc_stats,
    """WITH c AS (SELECT *, substr(genotype, 1, 1) <> substr(genotype, 2, 1) AS het, ref || alt IN ('AG', 'GA', 'CT', 'TC') AS ti FROM genotypes WHERE genotype IS NOT NULL AND contains(genotype, alt)),
a AS (SELECT sample_id, count(*) FILTER (length(ref) = 1 AND length(alt) = 1) AS n_snp, count(*) FILTER (length(ref) > 1 OR length(alt) > 1) AS n_indel, count(*) FILTER (ti) AS n_ti, count(*) FILTER (NOT ti) AS n_tv, count(*) FILTER (het) AS n_het, count(*) FILTER (NOT het) AS n_hom_alt FROM c GROUP BY sample_id)
SELECT *, round(n_ti / nullif(n_tv, 0), 6) AS ti_tv, round(n_het / nullif(n_hom_alt, 0), 6) AS het_hom FROM a""",
)
query(
    "agg7_verdict", "genotypes", lambda g: P.qc_verdict(P.qc_stats(g)).select("sample_id", "reasons", "warnings", "passes"),
    """WITH c AS (SELECT *, substr(genotype, 1, 1) <> substr(genotype, 2, 1) AS het, ref || alt IN ('AG', 'GA', 'CT', 'TC') AS ti FROM genotypes WHERE genotype IS NOT NULL AND contains(genotype, alt)),
a AS (SELECT sample_id, count(*) AS n, count(*) FILTER (ti) / nullif(count(*) FILTER (NOT ti), 0) AS t, count(*) FILTER (het) / nullif(count(*) FILTER (NOT het), 0) AS h FROM c GROUP BY sample_id),
r AS (SELECT sample_id, concat_ws(',', CASE WHEN n < 100 THEN 'few_snps' END, CASE WHEN t < 1.8 THEN 'ti_tv_low' END, CASE WHEN h < 1 THEN 'het_hom_low' WHEN h > 3 THEN 'het_hom_high' END) AS reasons,
  concat_ws(',', CASE WHEN t IS NULL THEN 'ti_tv_missing' WHEN t > 2.5 THEN 'ti_tv_high' END, CASE WHEN h IS NULL THEN 'het_hom_missing' END) AS warnings FROM a)
SELECT *, reasons = '' AS passes FROM r""",
)
query(
    "fil1_multiallelic", "annotations",
    lambda a: P.split_multiallelic(a.select("variant_id", F.when(F.col("variant_id") % 3 == 0, "C,G").otherwise("T").alias("alt"), F.element_at(F.array(*map(F.lit, ["0/1", "1|2", "2/2", "./1", "0/0"])), (F.col("variant_id") % 5 + 1).cast("int")).alias("gt"))).select("variant_id", F.col("allele_no").cast("bigint").alias("allele_no"), "alt", "gt"),
    """WITH v AS (SELECT variant_id, CASE WHEN variant_id % 3 = 0 THEN ['C', 'G'] ELSE ['T'] END AS alts, (['0/1', '1|2', '2/2', './1', '0/0'])[variant_id % 5 + 1] AS gt FROM annotations),
x AS (SELECT variant_id, gt, unnest(alts) AS alt, unnest(range(1, len(alts) + 1)) AS allele_no FROM v)
SELECT variant_id, allele_no, alt, array_to_string([CASE WHEN g = '.' THEN '.' WHEN g = allele_no::VARCHAR THEN '1' ELSE '0' END FOR g IN string_split(replace(gt, '|', '/'), '/')], '/') AS gt FROM x""",
)
query(
    "fil2_hard_filter", "instruments",
    lambda v: P.hard_filter(v.select("pair_id", F.col("f_statistic").alias("qual"), (F.col("snp") % 40).alias("depth"))).groupBy("pair_id").agg(F.count("*").alias("n"), F.count_if(~F.col("passes")).alias("n_removed")),
    "SELECT pair_id, count(*) AS n, count(*) FILTER (NOT (f_statistic >= 30 AND snp % 40 >= 10)) AS n_removed FROM instruments GROUP BY pair_id",
)
query(
    "fil3_genotype_qc", "dosages",
    lambda d: P.call_rates(P.genotype_qc(d, 0.3, 0.3, 0.01, None)).select("variant_id", "n", F.round("call_rate", 6).alias("call_rate"), F.round("maf", 6).alias("maf")),
    """WITH g AS (SELECT variant_id FROM dosages GROUP BY variant_id HAVING count(dosage) / count(*) >= 0.7),
d1 AS (SELECT * FROM dosages WHERE variant_id IN (SELECT variant_id FROM g)),
d2 AS (SELECT * FROM d1 WHERE sample_id IN (SELECT sample_id FROM d1 GROUP BY sample_id HAVING count(dosage) / count(*) >= 0.7)),
f AS (SELECT variant_id, count(*) AS n, round(count(dosage) / count(*), 6) AS call_rate, least(sum(dosage) / (2.0 * count(dosage)), 1 - sum(dosage) / (2.0 * count(dosage))) AS maf FROM d2 GROUP BY variant_id)
SELECT variant_id, n, call_rate, round(maf, 6) AS maf FROM f WHERE maf >= 0.01""",
)
