"""Queries on annotation, classification, panels and resistance."""

from pyspark.sql import functions as F

from omicspark.jobs.query import query
from omicspark.operators import annotate as A

def _pop():
    return F.create_map(F.lit("afr"), F.col("afr"), F.lit("eas"), F.col("eas"), F.lit("gnomad_nfe"), F.col("nfe"))


def _prioritised(a):
    return A.prioritised(a.withColumn("outlier", A.frequency_fields(_pop())["outlier"]))


_SEV = "CASE consequence " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(A.SEVERITY)) + " END"
_PRIO = f"""p AS (SELECT *, greatest(afr, eas, nfe) - least(afr, eas, nfe) >= 0.05 AS outlier, {_SEV} AS severity, CASE WHEN upper(impact) IN ('HIGH', 'MODERATE', 'LOW', 'MODIFIER') THEN upper(impact) ELSE 'UNKNOWN' END AS impact_tier,
  CASE WHEN clinvar IS NULL THEN 'other_or_uncertain' WHEN clinvar ILIKE '%conflict%' THEN 'conflicting' WHEN clinvar IN ('Pathogenic', 'Likely_pathogenic') THEN 'pathogenic_or_likely_pathogenic' WHEN clinvar ILIKE '%benign%' THEN 'benign_or_likely_benign'
    WHEN clinvar IN ('risk_factor', 'drug_response') THEN clinvar ELSE 'other_or_uncertain' END AS bucket, coalesce(gnomad_af < 0.001, false) AS rare FROM annotations),
q AS (SELECT *, rare AND bucket = 'pathogenic_or_likely_pathogenic' AS relevant FROM p),
r AS (SELECT *, 10 * CASE impact_tier WHEN 'HIGH' THEN 4 WHEN 'MODERATE' THEN 3 WHEN 'LOW' THEN 2 WHEN 'MODIFIER' THEN 1 ELSE 0 END + 15 * CASE bucket WHEN 'pathogenic_or_likely_pathogenic' THEN 4 WHEN 'benign_or_likely_benign' THEN 0 WHEN 'other_or_uncertain' THEN 1 ELSE 2 END
    + CASE WHEN rare THEN 20 ELSE 0 END + CASE WHEN outlier THEN 10 ELSE 0 END + coalesce(greatest(0, 40 - severity), 0) AS score,
  CASE WHEN relevant THEN 'Tier 1' WHEN impact_tier IN ('HIGH', 'MODERATE') AND (rare OR bucket IN ('conflicting', 'other_or_uncertain')) THEN 'Tier 2' WHEN bucket IN ('risk_factor', 'drug_response') OR impact_tier IN ('LOW', 'MODERATE') THEN 'Tier 3' ELSE 'Tier 4' END AS tier,
  concat_ws(';', CASE WHEN relevant THEN 'rare_pathogenic_clinvar' END, CASE WHEN impact_tier = 'HIGH' THEN 'high_impact' END, CASE WHEN impact_tier = 'MODERATE' THEN 'moderate_impact' END, CASE WHEN outlier THEN 'population_frequency_outlier' END, CASE WHEN bucket IN ('risk_factor', 'drug_response', 'conflicting') THEN bucket END) AS reasons FROM q)"""
_COLS = "variant_id, severity, impact_tier, bucket, rare, relevant, score, tier, reasons"
query("fn6_priority", "annotations", lambda a: _prioritised(a).select(*_COLS.split(", ")), f"WITH {_PRIO} SELECT {_COLS} FROM r")
query("srt2_priority_top", "annotations", lambda a: _prioritised(a).orderBy(F.col("score").desc(), "severity", "variant_id").limit(10).select("variant_id", "score", "tier"), f"WITH {_PRIO} SELECT variant_id, score, tier FROM r ORDER BY score DESC, severity, variant_id LIMIT 10")
query(
    "agg34_annotation_summary", "annotations", lambda a: A.counts_by_field(_prioritised(a), ["gene", "consequence", "impact_tier", "bucket", "tier"]),
    f"WITH {_PRIO} SELECT CASE WHEN grouping(gene) = 0 THEN 'gene' WHEN grouping(consequence) = 0 THEN 'consequence' WHEN grouping(impact_tier) = 0 THEN 'impact_tier' WHEN grouping(bucket) = 0 THEN 'bucket' ELSE 'tier' END AS field, coalesce(gene, consequence, impact_tier, bucket, tier) AS value, count(*) AS n FROM r GROUP BY GROUPING SETS (gene, consequence, impact_tier, bucket, tier)",
)
query(
    "fn7_frequency", "annotations", lambda a: a.select("variant_id", *[(F.round(c, 6) if k in ("gnomad_min", "max_af", "spread") else c).alias(k) for k, c in A.frequency_fields(_pop()).items() if k != "summary"]),
    """SELECT variant_id, round(nfe, 6) AS gnomad_min, round(greatest(afr, eas, nfe), 6) AS max_af, round(greatest(afr, eas, nfe) - least(afr, eas, nfe), 6) AS spread, greatest(afr, eas, nfe) - least(afr, eas, nfe) >= 0.05 AS outlier,
  CASE WHEN afr >= eas AND afr >= nfe THEN 'afr' WHEN eas >= nfe THEN 'eas' ELSE 'gnomad_nfe' END AS top_population FROM annotations""",
)


def _evidence(a):
    return a.withColumns({"stars": F.col("variant_id") % 4, "cadd": (F.col("variant_id") % 40).cast("double"), "sift": F.when(F.col("variant_id") % 3 == 0, "deleterious").when(F.col("variant_id") % 3 == 1, "tolerated"), "polyphen": F.when(F.col("variant_id") % 5 == 0, "probably_damaging").when(F.col("variant_id") % 5 == 1, "benign"), "splice_delta": F.when(F.col("variant_id") % 6 == 0, 0.3)})


query(
    "fn9_acmg", "annotations", lambda a: A.acmg(_evidence(a)).select("variant_id", "acmg_class", F.concat_ws(",", *[F.when(F.col(c), c) for c in "pvs1 ps1 pm1 pm2 pm4 pp3 pp5 ba1 bs1 bp4 bp6 bp7".split()]).alias("criteria")),
    """WITH e AS (SELECT *, variant_id % 4 >= 2 AS st, variant_id % 40 AS cadd, variant_id % 3 AS s, variant_id % 5 AS p, coalesce(clinvar ILIKE '%pathogenic%' AND clinvar NOT ILIKE '%conflicting%', false) AS known, consequence = 'missense_variant' AS mis FROM annotations),
f AS (SELECT variant_id, consequence IN ('stop_gained', 'frameshift_variant') AS pvs1, mis AND known AND st AS ps1, mis AND impact = 'HIGH' AS pm1, gnomad_af IS NULL OR gnomad_af < 0.0001 AS pm2, consequence = 'inframe_deletion' AS pm4, mis AND (cadd >= 25.3 OR s = 0 OR p = 0) AS pp3, known AND st AS pp5,
  coalesce(gnomad_af > 0.05, false) AS ba1, coalesce(gnomad_af > 0.01, false) AS bs1, cadd < 15 OR s = 1 OR p = 1 AS bp4, coalesce(clinvar ILIKE '%benign%' AND clinvar NOT ILIKE '%pathogenic%', false) AND st AS bp6, consequence = 'synonymous_variant' AND variant_id % 6 <> 0 AS bp7 FROM e),
n AS (SELECT *, pvs1::INT AS a, ps1::INT AS b, pm1::INT + pm2::INT + pm4::INT AS c, pp3::INT + pp5::INT AS d, bs1::INT AS x, bp4::INT + bp6::INT + bp7::INT AS y FROM f)
SELECT variant_id, CASE WHEN ba1 OR x >= 2 THEN 'Benign' WHEN a + b + c + d > 0 AND x + y > 0 THEN 'Uncertain Significance'
  WHEN (a >= 1 AND (b >= 1 OR c >= 2 OR (c >= 1 AND d >= 1) OR d >= 2)) OR b >= 2 OR (b >= 1 AND (c >= 3 OR (c >= 2 AND d >= 2) OR (c >= 1 AND d >= 4))) THEN 'Pathogenic'
  WHEN (c >= 1 AND (a >= 1 OR b >= 1)) OR (b >= 1 AND d >= 2) OR c >= 3 OR (c >= 2 AND d >= 2) OR (c >= 1 AND d >= 4) THEN 'Likely Pathogenic'
  WHEN (x >= 1 AND y >= 1) OR y >= 2 THEN 'Likely Benign' ELSE 'Uncertain Significance' END AS acmg_class,
  concat_ws(',', CASE WHEN pvs1 THEN 'pvs1' END, CASE WHEN ps1 THEN 'ps1' END, CASE WHEN pm1 THEN 'pm1' END, CASE WHEN pm2 THEN 'pm2' END, CASE WHEN pm4 THEN 'pm4' END, CASE WHEN pp3 THEN 'pp3' END, CASE WHEN pp5 THEN 'pp5' END, CASE WHEN ba1 THEN 'ba1' END, CASE WHEN bs1 THEN 'bs1' END, CASE WHEN bp4 THEN 'bp4' END, CASE WHEN bp6 THEN 'bp6' END, CASE WHEN bp7 THEN 'bp7' END) AS criteria FROM n""",
)
query(
    "jon7_evidence", "variants annotations",
    lambda v, a: A.with_evidence(v.select("variant_id", "chrom", "pos", "ref", "alt"), v.join(a.where("gnomad_af is not null"), "variant_id").select(v["chrom"], v["pos"], "ref", "alt", "gnomad_af", "clinvar"), {"clinvar": "not_provided", "gnomad_af": 0.0}).select("variant_id", "gnomad_af", "clinvar"),
    "SELECT v.variant_id, coalesce(a.gnomad_af, 0) AS gnomad_af, coalesce(a.clinvar, 'not_provided') AS clinvar FROM variants v LEFT JOIN annotations a ON a.variant_id = v.variant_id AND a.gnomad_af IS NOT NULL",
)
query(
    "win8_best_consequence", "annotations",
    lambda a: A.best_per_variant(a.select((F.col("variant_id") - F.col("variant_id") % 4).alias("variant_id"), F.col("variant_id").alias("transcript"), "consequence", (F.col("variant_id") % 2 == 0).alias("canonical"), (F.col("variant_id") % 3 == 0).alias("mane"), F.when(F.col("variant_id") % 5 > 0, F.col("gene")).alias("gene"))).select("variant_id", "transcript", "consequence"),
    f"SELECT variant_id - variant_id % 4 AS variant_id, variant_id AS transcript, consequence FROM annotations QUALIFY row_number() OVER (PARTITION BY variant_id - variant_id % 4 ORDER BY {_SEV}, (variant_id % 2 = 0) DESC, (variant_id % 3 = 0) DESC, variant_id % 5 = 0, variant_id) = 1",
)
query("fil12_panel_filter", "annotations", lambda a: A.in_panel(a, a.where("clinvar = 'Pathogenic' and gnomad_af < 0.002").select("gene"), ["GENE13", "GENE17"]).select("variant_id", "gene", "secondary_finding"), "SELECT variant_id, gene, gene IN ('GENE13', 'GENE17') AS secondary_finding FROM annotations WHERE gene IN (SELECT gene FROM annotations WHERE clinvar = 'Pathogenic' AND gnomad_af < 0.002)")


def _panel(v, a):
    return v.join(a, "variant_id").where("variant_id <= 60").select("variant_id", (F.col("variant_id") % 4).alias("domain"), F.col("alt").alias("risk_allele"), F.when(F.col("variant_id") % 10 == 0, "N").otherwise(F.col("ref")).alias("ref_allele"), (1 + F.col("variant_id") % 3).cast("double").alias("weight"))


_PANEL = "p AS (SELECT v.variant_id, v.variant_id % 4 AS domain, v.alt AS risk, CASE WHEN v.variant_id % 10 = 0 THEN 'N' ELSE v.ref END AS refa, 1.0 + v.variant_id % 3 AS weight FROM variants v JOIN annotations a ON a.variant_id = v.variant_id WHERE v.variant_id <= 60)"
query(
    "agg33_nutrient_scores", "genotypes variants annotations", lambda g, v, a: A.nutrient_scores(g.select("sample_id", "variant_id", "genotype"), _panel(v, a)),
    f"""WITH {_PANEL}, x AS (SELECT sample_id, domain, weight, length(genotype) - length(replace(genotype, risk, '')) AS r, length(genotype) - length(replace(genotype, refa, '')) AS o FROM genotypes JOIN p USING (variant_id) WHERE genotype IS NOT NULL),
s AS (SELECT sample_id, domain, round(sum(r / 2 * weight) / sum(weight) * 10, 2) AS score, count(*) AS n_tested FROM x WHERE r + o = 2 GROUP BY sample_id, domain)
SELECT sample_id, domain, score, CASE WHEN score < 3.5 THEN 'Low' WHEN score < 6.5 THEN 'Moderate' ELSE 'Elevated' END AS category, n_tested, (SELECT count(*) FROM p WHERE p.domain = s.domain) - n_tested AS n_missing FROM s""",
)
query(
    "jon6_panel_status", "dosages genotypes variants annotations", lambda d, g, v, a: A.panel_status(d, g, _panel(v, a)).groupBy("variant_id", "status").agg(F.count("*").alias("n")),
    f"""WITH {_PANEL}, s AS (SELECT DISTINCT sample_id FROM dosages), x AS (SELECT p.variant_id, g.sample_id AS hit, genotype, length(genotype) - length(replace(genotype, risk, '')) + length(genotype) - length(replace(genotype, refa, '')) AS own FROM s CROSS JOIN p LEFT JOIN genotypes g ON g.sample_id = s.sample_id AND g.variant_id = p.variant_id)
SELECT variant_id, CASE WHEN hit IS NULL THEN 'not_tested' WHEN genotype IS NULL THEN 'no_call' WHEN own < 2 THEN 'allele_mismatch' ELSE 'found' END AS status, count(*) AS n FROM x GROUP BY ALL""",
)
_GENES = ["NDM-1", "blaTEM-1", "OXA-48", "vanA-cluster", "mecA", "qnrS1", "PBP2x", "unknown", "tetM", "ROB-1"]
_DRUGS = ["carbapenem antibiotic", "penicillin beta-lactam", "fluoroquinolone antibiotic", "tetracycline", "macrolide"]
query(
    "agg32_resistance", "cells",
    lambda c: c.select(F.element_at(F.array(*map(F.lit, _GENES)), (F.col("gene") % 10 + 1).cast("int")).alias("g"), F.element_at(F.array(*map(F.lit, _DRUGS)), (F.col("cell") % 5 + 1).cast("int")).alias("drug_class"), "count").withColumn("tier", A.resistance_tier(F.col("g"), F.col("drug_class"))).groupBy("g", "tier").pivot("drug_class", _DRUGS).agg(F.sum("count")).select(F.col("g").alias("gene"), "tier", *[F.col(d).alias(d.split()[0]) for d in _DRUGS]),
    f"""WITH x AS (SELECT ({_GENES!r})[gene % 10 + 1] AS gene, ({_DRUGS!r})[cell % 5 + 1] AS d, count FROM cells),
t AS (SELECT *, CASE WHEN regexp_matches(gene, '(?i)NDM|OXA-48|KPC|VIM|IMP|CTX-M|SHV|TEM') OR regexp_matches(d, 'carbapenem|cephalosporin') THEN 'Critical' WHEN regexp_matches(gene, '(?i)VanA|VanB|mecA|mecC|QnrA|QnrB|QnrS|GyrA|ParC') OR regexp_matches(d, 'vancomycin|methicillin|clarithromycin|fluoroquinolone') THEN 'High'
  WHEN regexp_matches(gene, '(?i)PBP|TEM|ROB') OR regexp_matches(d, 'penicillin|ampicillin') THEN 'Medium' ELSE 'Not classified' END AS tier FROM x)
SELECT gene, tier, {", ".join(f"(sum(count) FILTER (d = '{d}'))::BIGINT AS {d.split()[0]}" for d in _DRUGS)} FROM t GROUP BY gene, tier""",
)
query(
    "fn11_drug_names", "annotations",
    lambda a: A.drug_matches(a.select(F.concat(F.when(F.col("variant_id") % 3 == 0, "gen").when(F.col("variant_id") % 3 == 1, "GENE").otherwise("gne"), (F.col("variant_id") % 30).cast("string")).alias("query")).distinct(), a.select(F.col("gene").alias("drug"), F.concat(F.lit("brand"), F.substring("gene", 5, 3)).alias("brand")).distinct()),
    """WITH q AS (SELECT DISTINCT CASE variant_id % 3 WHEN 0 THEN 'gen' WHEN 1 THEN 'GENE' ELSE 'gne' END || (variant_id % 30) AS query FROM annotations), d AS (SELECT DISTINCT gene AS drug FROM annotations),
x AS (SELECT query, drug, CASE WHEN lower(query) = lower(drug) THEN 1 WHEN lower(query) = 'brand' || drug[5:7] THEN 2 WHEN contains(lower(drug), lower(query)) OR contains(lower(query), lower(drug)) THEN 3 WHEN levenshtein(lower(query), lower(drug)) <= 2 THEN 4 END AS tier, levenshtein(lower(query), lower(drug)) AS e FROM q, d)
SELECT query, arg_min(drug, (tier, e, drug)) AS drug, min(tier) AS tier FROM x WHERE tier IS NOT NULL GROUP BY query""",
)
