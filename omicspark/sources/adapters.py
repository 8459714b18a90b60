"""Views that shape the given star-schema tables like omics tables.

Each is a query in the SQL that Spark and DuckDB share; a table is named in braces, and `DIV` stands for integer
division. The same text is the input of a job and the first part of its oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # Samples are customers, variants are parts; 3 stands for a missing call.
    "dosages": """
SELECT sample_id, variant_id, population, variant_id % 22 + 1 AS chrom, variant_id * 100 AS pos,
  CASE WHEN d < 3 THEN d END AS dosage
FROM (SELECT o_custkey AS sample_id, l_partkey AS variant_id,
        max(CASE n_regionkey WHEN 0 THEN 'AFR' WHEN 1 THEN 'AMR' WHEN 2 THEN 'EAS' WHEN 3 THEN 'EUR' ELSE 'MID' END) AS population,
        min((l_suppkey + l_linenumber) % 4) AS d
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        JOIN {nation} ON c_nationkey = n_nationkey
      GROUP BY o_custkey, l_partkey) AS g""",
    "variants": """
SELECT p_partkey AS variant_id, p_partkey % 22 + 1 AS chrom, p_partkey * 100 AS pos,
  substr('ACGTAC', CAST(p_partkey % 6 AS INT) + 1, 1) AS ref, substr('GTAACT', CAST(p_partkey % 6 AS INT) + 1, 1) AS alt
FROM {part}""",
    "genotypes": """
SELECT d.sample_id, d.variant_id, v.chrom, v.pos, v.ref, v.alt,
  CASE d.dosage WHEN 0 THEN concat(v.ref, v.ref) WHEN 1 THEN concat(v.ref, v.alt) WHEN 2 THEN concat(v.alt, v.alt) END AS genotype
FROM <dosages> AS d JOIN <variants> AS v ON d.variant_id = v.variant_id""",
    "genotypes_dense": """
SELECT s AS sample_id, v AS variant_id, v % 22 + 1 AS chrom,
  CASE (((s * 7919 + 1) * (v * 1049 + 1)) % 10007) % 4 WHEN 0 THEN 'AA' WHEN 1 THEN 'AG' WHEN 2 THEN 'GG' END AS genotype
FROM (SELECT DISTINCT l_suppkey DIV 3 AS s, l_partkey DIV 8 AS v FROM {lineitem}) AS k
WHERE (((s * 7919 + 1) * (v * 1049 + 1)) % 10007) % 4 < 3""",
    "scores": """
SELECT p_size % 5 AS pgs_id, p_partkey AS variant_id, substr('GTAACT', CAST(p_partkey % 6 AS INT) + 1, 1) AS effect_allele,
  CAST(p_partkey % 2001 - 1000 AS DOUBLE) / 1000 AS effect_weight, CAST(p_partkey % 101 AS DOUBLE) / 100 AS allele_freq
FROM {part}""",
    "sumstats": """
SELECT variant_id, locus, chrom, pos, n, beta, se, beta / se AS z
FROM (SELECT l_partkey AS variant_id, l_partkey DIV 50 AS locus, l_partkey % 22 + 1 AS chrom, l_partkey * 100 AS pos,
        count(*) AS n, round(avg(l_discount) - 0.05, 9) AS beta, round(0.001 + 0.01 / count(*), 9) AS se
      FROM {lineitem} GROUP BY l_partkey) AS s""",
    "instruments": """
SELECT a.k DIV 25 AS pair_id, a.k AS snp, CAST(5 + p_size AS DOUBLE) / 100 AS eaf, substr('ACGTAC', CAST(a.k % 6 AS INT) + 1, 1) AS effect_allele,
  substr('GTATCG', CAST(a.k % 6 AS INT) + 1, 1) AS other_allele, a.b AS beta_exposure, a.s AS se_exposure, b.b AS beta_outcome, b.s AS se_outcome,
  round(a.b * a.b / (a.s * a.s), 6) AS f_statistic
FROM (SELECT l_partkey AS k, round(avg(l_discount) + 0.01, 6) AS b, round(0.004 + 0.01 / count(*), 6) AS s FROM {lineitem} WHERE l_suppkey % 2 = 0 GROUP BY l_partkey) AS a
JOIN (SELECT l_partkey AS k, round(avg(l_tax) - 0.02, 6) AS b, round(0.004 + 0.02 / count(*), 6) AS s FROM {lineitem} WHERE l_suppkey % 2 = 1 GROUP BY l_partkey) AS b ON a.k = b.k
JOIN {part} ON p_partkey = a.k""",
    # Gene by sample counts, zeros filled in.
    "counts": """
SELECT g.gene, s.sample_id, s.sample_id % 2 AS grp, s.sample_id % 3 AS batch, coalesce(x.n, 0) AS count
FROM (SELECT DISTINCT l_partkey DIV 4 AS gene FROM {lineitem}) AS g
CROSS JOIN (SELECT DISTINCT l_suppkey % 20 AS sample_id FROM {lineitem}) AS s
LEFT JOIN (SELECT l_partkey DIV 4 AS gene, l_suppkey % 20 AS sample_id, CAST(sum(l_quantity) AS BIGINT) AS n FROM {lineitem} GROUP BY l_partkey DIV 4, l_suppkey % 20) AS x
  ON x.gene = g.gene AND x.sample_id = s.sample_id""",
    "annotations": """
SELECT p_partkey AS variant_id, p_partkey % 22 + 1 AS chrom, p_partkey * 100 AS pos, concat('GENE', CAST(p_partkey % 97 AS VARCHAR(9))) AS gene,
  CASE p_partkey % 9 WHEN 0 THEN 'stop_gained' WHEN 1 THEN 'missense_variant' WHEN 2 THEN 'synonymous_variant' WHEN 3 THEN 'frameshift_variant'
    WHEN 4 THEN 'intron_variant' WHEN 5 THEN 'splice_region_variant' WHEN 6 THEN 'inframe_deletion' WHEN 7 THEN '5_prime_UTR_variant' ELSE 'intergenic_variant' END AS consequence,
  CASE p_partkey % 9 WHEN 0 THEN 'HIGH' WHEN 3 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 6 THEN 'MODERATE' WHEN 2 THEN 'LOW' WHEN 5 THEN 'low' ELSE 'MODIFIER' END AS impact,
  CASE p_size % 8 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic' WHEN 2 THEN 'Benign/Likely_benign' WHEN 3 THEN 'risk_factor'
    WHEN 4 THEN 'drug_response' WHEN 5 THEN 'Conflicting_interpretations_of_pathogenicity' WHEN 6 THEN 'Uncertain_significance' END AS clinvar,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE round((p_retailprice - 900) * (p_size % 3) / 100000, 6) END AS gnomad_af,
  CAST(p_size AS DOUBLE) / 500 AS afr, CAST(p_partkey % 40 AS DOUBLE) / 500 AS eas, CAST(p_partkey % 23 AS DOUBLE) / 500 AS nfe
FROM {part}""",
    "cohort": """
SELECT user_id AS patient_id, user_id % 90 AS age, concat(event_type, '_', regexp_extract(props, '[0-9]+', 0)) AS condition
FROM {events}""",
    "cells": """
SELECT l_orderkey AS cell, l_partkey % 200 AS gene, CAST(sum(l_quantity) AS BIGINT) AS count FROM {lineitem} GROUP BY l_orderkey, l_partkey % 200""",
    "obs": """
SELECT l_orderkey AS cell, min(l_suppkey % 8) AS cluster, min(l_linenumber) % 3 AS batch, min(l_partkey % 5) AS label, CAST(min(l_discount) AS DOUBLE) AS confidence
FROM {lineitem} GROUP BY l_orderkey""",
    "pedigree": """
SELECT c_custkey AS id, CASE WHEN c_custkey >= 16 THEN c_custkey DIV 2 END AS father, CASE WHEN c_custkey >= 16 THEN c_custkey DIV 3 END AS mother,
  c_custkey % 2 AS sex, c_acctbal AS trait FROM {customer}""",
    "breeders": "SELECT s_suppkey AS id, s_suppkey % 2 AS sex FROM {supplier}",
    # Shapes of result tables: every column comes from a column of the given tables.
    "pgx_calls": """
SELECT c_custkey AS sample_id, 'CYP2C9' AS gene, CASE c_mktsegment WHEN 'FURNITURE' THEN '*1/*1' WHEN 'MACHINERY' THEN '*1/*2' WHEN 'BUILDING' THEN '*3/*3' ELSE '*1/*9' END AS diplotype,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'Normal Metabolizer' WHEN 'MACHINERY' THEN 'Intermediate Metabolizer' WHEN 'BUILDING' THEN 'Poor Metabolizer' ELSE 'Unknown' END AS phenotype FROM {customer} WHERE c_mktsegment <> 'HOUSEHOLD'
UNION ALL
SELECT o_custkey, 'VKORC1', max(o_orderstatus), CASE max(o_orderpriority) WHEN '5-LOW' THEN 'Normal Sensitivity' WHEN '4-NOT SPECIFIED' THEN 'High Sensitivity' WHEN '3-MEDIUM' THEN 'Indeterminate' ELSE 'Moderate Sensitivity' END FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey""",
    "guide": "SELECT DISTINCT c_mktsegment AS drug, 'CYP2C9' AS gene, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Poor Metabolizer' ELSE 'Normal Metabolizer' END AS phenotype, CASE WHEN o_orderpriority = '1-URGENT' THEN 'avoid' ELSE 'standard' END AS action FROM {customer} JOIN {orders} ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "drug_actions": "SELECT o_custkey AS sample_id, l_returnflag AS gene, concat('d', CAST(l_suppkey AS VARCHAR(9))) AS drug, CASE o_orderpriority WHEN '1-URGENT' THEN 'avoid' WHEN '2-HIGH' THEN 'caution' ELSE 'standard' END AS action FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey",
    "trait_scores": "SELECT o_custkey AS sample_id, p_type AS trait, CASE WHEN max(l_discount) > 0.01 THEN round(avg(l_quantity) * 2, 3) END AS percentile, max(CASE WHEN l_quantity > 40 THEN 'High' ELSE 'Average' END) AS risk FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey GROUP BY o_custkey, p_type",
    "nutrients": "SELECT DISTINCT o_custkey AS sample_id, n_name AS domain, CASE WHEN s_acctbal > 7000 THEN 'Elevated' WHEN s_acctbal > 3000 THEN 'Moderate' ELSE 'Low' END AS category FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey",
    "ancestry": "SELECT c_custkey AS sample_id, r_name AS population, round(sum(l_extendedprice), 2) AS share FROM {customer} JOIN {orders} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey GROUP BY c_custkey, r_name",
    "targets": "SELECT p_name AS gene, max(p_brand) AS summary FROM {part} GROUP BY p_name",
    "associations": "SELECT p_name AS gene, c_mktsegment AS disease, l_discount AS score FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey WHERE l_returnflag = 'A'",
    "gene_papers": "SELECT p_name AS gene, c_mktsegment AS disease, l_orderkey * 10 + l_linenumber AS paper_id, year(l_shipdate) AS year FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey WHERE l_returnflag = 'N'",
    "gene_trials": "SELECT p_name AS gene, c_mktsegment AS disease, l_orderkey * 10 + l_linenumber AS trial_id, CASE o_orderstatus WHEN 'O' THEN 'Recruiting' WHEN 'P' THEN 'COMPLETED' ELSE 'WITHDRAWN' END AS status, p_type AS phase, l_linestatus AS register FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey WHERE l_returnflag = 'R'",
    "citations": "SELECT l_partkey AS doc_id, l_suppkey AS cited FROM {lineitem}",
    "people": "SELECT c_custkey AS id, c_nationkey AS generation, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Male' ELSE 'Female' END AS sex, CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END AS health FROM {customer}",
    "person_traits": "SELECT o_custkey AS id, o_orderpriority AS trait, round(avg(o_totalprice) / 500000, 6) AS score FROM {orders} GROUP BY o_custkey, o_orderpriority",
    "person_calls": "SELECT o_custkey AS id, l_suppkey AS locus, CAST(count(*) % 3 AS INT) AS dosage FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey",
    "mutations": "SELECT o_custkey AS id, CASE l_returnflag WHEN 'A' THEN 'disease_risk' WHEN 'R' THEN 'protective' ELSE 'neutral' END AS kind FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_discount > 0.05",
    "conditions": "SELECT user_id AS id, event_type AS condition FROM {events}",
    "registry": "SELECT n_name AS trait, s_suppkey AS locus, r_name AS dominance0, CASE r_regionkey WHEN 0 THEN 'additive' WHEN 1 THEN 'dominant' WHEN 2 THEN 'recessive' ELSE 'other' END AS dominance, s_acctbal AS effect FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey WHERE s_acctbal > 0",
    "finemapped": "SELECT o_orderpriority AS method, p_type AS locus, p_partkey AS variant, round(max(l_discount), 6) AS pip, max(l_tax) > 0.06 AS in_set FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey GROUP BY o_orderpriority, p_type, p_partkey",
    "causal": "SELECT p_type AS locus, p_partkey AS variant, p_name AS gene FROM {part} WHERE p_size = 13",
    "sheet": "SELECT DISTINCT o_custkey AS id, o_orderpriority AS project, o_orderstatus AS kind FROM {orders} WHERE o_totalprice > 250000",
    "measured": "SELECT p_name AS feature, o_custkey AS subject, o_custkey AS sample_id, o_orderstatus AS time, l_extendedprice AS value, l_quantity - 10 AS rfu, l_quantity AS npx, p_size AS lod, CASE WHEN l_tax = 0.08 AND l_discount > 0.09 THEN 'Warn' ELSE 'Pass' END AS qc_warning, CASE WHEN l_linestatus = 'F' THEN 'PASS' ELSE 'FLAG' END AS row_check, CASE WHEN l_returnflag = 'A' THEN 'Sample' ELSE 'QC' END AS sample_type, CASE WHEN p_type = 'PROMO' THEN 'FLAG' ELSE 'pass' END AS col_check FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey",
    "items": "SELECT item_id, text FROM {benchmark}",
    "papers": "SELECT doc_id, text, source, lang FROM {documents}",
    "vectors": "SELECT vec_id, embedding, label FROM {embeddings}",
    "dated_vectors": "SELECT vec_id, embedding, label, year(o_orderdate) AS year FROM {embeddings} JOIN (SELECT o_custkey, min(o_orderdate) AS o_orderdate FROM {orders} GROUP BY o_custkey) AS o ON o_custkey = vec_id",
    # Entries are brands and kinds of parts, questions their names.
    "catalogue": "SELECT concat(p_brand, '.', p_name) AS name, concat(p_brand, ' ', p_name, ' ', max(p_type), ' ', max(CAST(p_size AS VARCHAR(9)))) AS text FROM {part} GROUP BY p_brand, p_name",
    "questions": "SELECT DISTINCT concat('best ', p_type, ' ', p_name, ' tools') AS query_id, concat(p_name, ' ', p_type) AS text FROM {part} UNION SELECT DISTINCT p_brand, substr(p_brand, 2, 5) FROM {part} UNION SELECT DISTINCT concat(p_brand, '.', p_name), concat(p_brand, '.', p_name) FROM {part} WHERE p_size = 7",
}


def _nested(text: str) -> str:
    return re.sub(r"<(\w+)>", lambda m: f"({_nested(VIEWS[m[1]])})", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in sf_dir."""
    text = re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", _nested(VIEWS[name]))
    return spark.sql(text.replace(" DIV ", " div "))


def view_sql(name: str) -> str:
    """The view as a common table expression of DuckDB."""
    text = re.sub(r"\{(\w+)\}", lambda m: m[1], _nested(VIEWS[name]))
    return f"{name} AS ({text.replace(' DIV ', ' // ')})"
