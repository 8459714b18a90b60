"""Queries on association results, fine-mapping and Mendelian randomisation."""

from pyspark.sql import functions as F

from omicspark.functions.stats import two_sided_p
from omicspark.jobs.query import query
from omicspark.operators import gwas as G


def _r(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


query(
    "agg11_lambda_gc", "sumstats", lambda s: G.lambda_gc(s.withColumn("chisq", F.round(F.col("z") * F.col("z"), 9)), "chrom"),
    """WITH x AS (SELECT chrom, round(z * z, 9) AS c FROM sumstats), y AS (SELECT chrom, c, row_number() OVER (PARTITION BY chrom ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS n FROM x WHERE c > 0)
SELECT chrom, n::BIGINT AS n, round(c / 0.4549364, 6) AS lambda_gc FROM y WHERE i = n // 2""",
)
query(
    "agg12_association", "dosages",
    lambda d: _r(G.association(d.select("variant_id", F.col("dosage").cast("double").alias("x"), (((F.col("sample_id") * 37 % 101) / F.lit(10.0) + F.col("dosage")) * 0.7310585).alias("y"))).select("variant_id", "n", "beta", "se"), "beta", "se", digits=5),
    """WITH x AS (SELECT variant_id, dosage::DOUBLE AS x, ((sample_id * 37 % 101) / 10.0 + dosage) * 0.7310585 AS y FROM dosages WHERE dosage IS NOT NULL),
a AS (SELECT variant_id, count(*) AS n, regr_slope(y, x) AS beta, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM x GROUP BY variant_id)
SELECT variant_id, n, round(beta, 5) AS beta, round(sqrt(greatest(syy - beta * sxy, 0) / (n - 2) / sxx), 5) AS se FROM a WHERE n > 2 AND sxx > 1e-9""",
)
query("agg12_association_p", "dosages", lambda d: _r(G.association(d.select("variant_id", F.col("dosage").cast("double").alias("x"), (F.col("sample_id") % 13).cast("double").alias("y"))), "beta", "se", "z", "p"))
_ASSOC = "CASE WHEN variant_id % 11 = 0 THEN NULL ELSE 1 + variant_id % 9 END"
query(
    "agg13_associations", "sumstats",
    lambda s: G.merged_associations(
        s.where("variant_id % 3 = 0").select(F.concat(F.lit("Trait"), (F.col("variant_id") % 50).cast("string")).alias("trait"), F.expr(f"cast({_ASSOC} as double)").alias("mantissa"), (-(F.col("variant_id") % 20)).alias("exponent"), "variant_id"),
        s.where("variant_id % 3 = 1").select(F.concat(F.lit("TRAIT"), (F.col("variant_id") % 50).cast("string")).alias("trait"), F.expr(f"cast({_ASSOC} as double)").alias("mantissa"), (-(F.col("variant_id") % 20)).alias("exponent"), "variant_id", "n"),
        s.where("variant_id % 3 = 2").select(F.concat(F.lit("gene"), (F.col("variant_id") % 50).cast("string")).alias("trait"), F.expr(f"cast({_ASSOC} as double)").alias("mantissa"), (-(F.col("variant_id") % 20)).alias("exponent"), "variant_id", "locus"),
    ).select("origin", "trait", "variant_id", F.round(-F.log10("p"), 6).alias("log10p"), "n", "locus", "significant"),
    f"""WITH x AS (SELECT variant_id, CASE variant_id % 3 WHEN 0 THEN 'gwas' WHEN 1 THEN 'phewas' ELSE 'eqtl' END AS origin, CASE variant_id % 3 WHEN 0 THEN 'Trait' WHEN 1 THEN 'TRAIT' ELSE 'gene' END || (variant_id % 50) AS trait,
  ({_ASSOC}) * power(10.0, -(variant_id % 20)) AS p, CASE WHEN variant_id % 3 = 1 THEN n END AS n, CASE WHEN variant_id % 3 = 2 THEN locus END AS locus FROM sumstats)
SELECT origin, trait, variant_id, round(-log10(p), 6) AS log10p, n, locus, coalesce(p < 5e-8, false) AS significant FROM x""",
)
query(
    "agg14_best_p", "sumstats",
    lambda s: G.best_p_per_trait(s.select(F.concat(F.when(F.col("variant_id") % 2 == 0, "Trait").otherwise("TRAIT"), (F.col("variant_id") % 50).cast("string")).alias("trait"), F.exp(-F.abs("z") * 4).alias("p")), 1e-5).select("trait", F.round(F.log10("best_p"), 6).alias("log10_best_p"), "n"),
    "SELECT 'trait' || (variant_id % 50) AS trait, round(log10(min(exp(-abs(z) * 4))), 6) AS log10_best_p, count(*) AS n FROM sumstats WHERE exp(-abs(z) * 4) < 1e-5 GROUP BY ALL",
)
_ABF = """v AS (SELECT locus, variant_id, z, 0.04 / (0.04 + se * se) AS r FROM sumstats), l AS (SELECT *, 0.5 * ln(1 - r) + 0.5 * r * z * z AS log_abf FROM v),
e AS (SELECT *, exp(log_abf - max(log_abf) OVER (PARTITION BY locus)) AS e FROM l), p AS (SELECT locus, variant_id, log_abf, e / sum(e) OVER (PARTITION BY locus) AS pip FROM e)"""
query("win2_abf", "sumstats", lambda s: _r(G.abf(s).select("locus", "variant_id", "log_abf", "pip"), "log_abf", "pip"), f"WITH {_ABF} SELECT locus, variant_id, round(log_abf, 6) AS log_abf, round(pip, 6) AS pip FROM p")
_CS = f"{_ABF}, c AS (SELECT *, coalesce(sum(pip) OVER (PARTITION BY locus ORDER BY round(pip, 12) DESC, variant_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY locus ORDER BY round(pip, 12) DESC, variant_id) AS rank FROM p)"
query("win3_credible_sets", "sumstats", lambda s: _r(G.credible_sets(G.abf(s)).select("locus", "variant_id", "pip", "rank"), "pip"), f"WITH {_CS} SELECT locus, variant_id, round(pip, 6) AS pip, rank FROM c WHERE before < 0.95")
query("srt6_high_pip", "sumstats", lambda s: _r(G.abf(s).where("pip >= 0.1").select("locus", "variant_id", "pip"), "pip"), f"WITH {_ABF} SELECT locus, variant_id, round(pip, 6) AS pip FROM p WHERE pip >= 0.1")
query("win13_causal_rank", "sumstats", lambda s: G.credible_sets(G.abf(s), 2.0).where("variant_id % 50 in (10, 40)").select("locus", "variant_id", "rank"), f"WITH {_CS} SELECT locus, variant_id, rank FROM c WHERE variant_id % 50 IN (10, 40)")
query("fil13_significant", "sumstats", lambda s: G.significance_levels(s.withColumn("p", two_sided_p(F.col("z")))).select("variant_id", F.round("z", 6).alias("z"), "level"), "SELECT variant_id, round(z, 6) AS z, CASE WHEN abs(z) > 5.451310443869 THEN 'genome_wide' ELSE 'suggestive' END AS level FROM sumstats WHERE abs(z) > 4.417173413469")
query("srt1_lead_variants", "sumstats", lambda s: s.orderBy(F.abs("z").desc(), "variant_id").limit(20).select("variant_id", F.round("z", 6).alias("z")), "SELECT variant_id, round(z, 6) AS z FROM sumstats ORDER BY abs(z) DESC, variant_id LIMIT 20")
query("win10_qq", "sumstats", lambda s: G.qq_table(s.withColumn("log10p", F.round(F.col("z") * F.col("z"), 9))), "SELECT variant_id, row_number() OVER w AS rank, round(-log10((row_number() OVER w - 0.5) / count(*) OVER ()), 6) AS expected, round(round(z * z, 9), 6) AS observed FROM sumstats WINDOW w AS (ORDER BY round(z * z, 9) DESC, variant_id)")
query("win11_genome_offset", "sumstats", lambda s: G.genome_offsets(s.select("variant_id", F.when(F.col("chrom") == 22, "X").otherwise(F.col("chrom").cast("string")).alias("chrom"), "pos")), "WITH x AS (SELECT variant_id, CASE WHEN chrom = 22 THEN 'X' ELSE chrom::VARCHAR END AS chrom, pos, chrom AS c FROM sumstats), e AS (SELECT chrom, min(c) AS c, max(pos) AS last FROM x GROUP BY chrom), o AS (SELECT chrom, coalesce(sum(last) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM e) SELECT variant_id, chrom, pos, (pos + off)::BIGINT AS genome_pos FROM x JOIN o USING (chrom)")
_MR = """t AS (SELECT pair_id, snp, 1 / (se_outcome * se_outcome) AS w, beta_exposure AS x, beta_outcome AS y FROM instruments),
m AS (SELECT pair_id, count(*) AS n, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy, sum(w * y * y) AS wyy FROM t GROUP BY pair_id)"""
query(
    "agg15_ivw", "instruments", lambda i: _r(G.ivw(i).select("pair_id", "n", "estimate", "se", "ci_lower", "ci_upper", "q"), "estimate", "se", "ci_lower", "ci_upper", "q", digits=5),
    f"""WITH {_MR}, e AS (SELECT *, wxy / wxx AS estimate FROM m WHERE n > 1), q AS (SELECT *, greatest(wyy - 2 * estimate * wxy + estimate * estimate * wxx, 0) AS q FROM e),
s AS (SELECT *, sqrt(greatest(1, q / (n - 1)) / wxx) AS se FROM q)
SELECT pair_id, n, round(estimate, 5) AS estimate, round(se, 5) AS se, round(estimate - 1.96 * se, 5) AS ci_lower, round(estimate + 1.96 * se, 5) AS ci_upper, round(q, 5) AS q FROM s""",
)
query("agg15_ivw_p", "instruments", lambda i: _r(G.ivw(i).select("pair_id", "p", "q_p"), "p", "q_p"))
query(
    "agg16_egger", "instruments", lambda i: _r(G.egger(i).drop("slope_p", "intercept_p"), "slope", "slope_se", "intercept", "intercept_se", digits=5),
    f"""WITH {_MR}, d AS (SELECT *, w * wxx - wx * wx AS denom FROM m WHERE n > 2), s AS (SELECT *, (w * wxy - wx * wy) / denom AS slope FROM d WHERE abs(denom) > 1e-12),
i AS (SELECT *, (wy - slope * wx) / w AS intercept FROM s), f AS (SELECT *, greatest(1, (wyy - intercept * wy - slope * wxy) / (n - 2)) AS phi FROM i)
SELECT pair_id, n, round(slope, 5) AS slope, round(sqrt(phi * w / denom), 5) AS slope_se, round(intercept, 5) AS intercept, round(sqrt(phi * wxx / denom), 5) AS intercept_se FROM f""",
)
query("agg16_egger_p", "instruments", lambda i: _r(G.egger(i).select("pair_id", "slope_p", "intercept_p"), "slope_p", "intercept_p"))
query("agg17_steiger_p", "instruments", lambda i: _r(G.sensitivity(i).select("pair_id", "steiger_p"), "steiger_p"))
query(
    "agg17_sensitivity", "instruments", lambda i: _r(G.sensitivity(i).drop("steiger_p"), "steiger_z", digits=4),
    """WITH t AS (SELECT pair_id, count(*) AS n, avg(f_statistic) AS mean_f, min(f_statistic) AS min_f, count(*) FILTER (f_statistic < 10) AS n_weak, sum(1 / (se_exposure * se_exposure)) AS w, sum(beta_exposure / (se_exposure * se_exposure)) AS wx,
  sum(beta_exposure * beta_exposure / (se_exposure * se_exposure)) AS wxx, sum(2 * eaf * (1 - eaf) * beta_exposure * beta_exposure) AS r1, sum(2 * eaf * (1 - eaf) * beta_outcome * beta_outcome) AS r2 FROM instruments GROUP BY pair_id),
q AS (SELECT *, wxx - wx * wx / w AS q FROM t)
SELECT pair_id, n, round(mean_f, 4) AS mean_f, round(min_f, 4) AS min_f, n_weak, round(CASE WHEN q <= n - 1 OR n = 1 THEN 0 ELSE (q - (n - 1)) / q END, 4) AS i2_gx, r1 > r2 AS correct_direction, round(CASE WHEN r1 + r2 > 0 THEN (r1 - r2) / (sqrt(r1 + r2) * 0.01) ELSE 0 END, 4) AS steiger_z FROM q""",
)
query(
    "agg18_leave_one_out", "instruments", lambda i: _r(G.leave_one_out(i), "estimate", "se", digits=5),
    f"""WITH {_MR}, l AS (SELECT t.pair_id, t.snp, m.n - 1 AS n, m.wxx - t.w * t.x * t.x AS wxx, m.wxy - t.w * t.x * t.y AS wxy, m.wyy - t.w * t.y * t.y AS wyy FROM t JOIN m ON t.pair_id = m.pair_id WHERE m.n > 2),
e AS (SELECT *, wxy / wxx AS estimate FROM l), q AS (SELECT *, greatest(wyy - 2 * estimate * wxy + estimate * estimate * wxx, 0) AS q FROM e)
SELECT pair_id, snp, n, round(estimate, 5) AS estimate, round(sqrt(greatest(1, q / (n - 1)) / wxx), 5) AS se FROM q""",
)
query("win4_median_test", "instruments", lambda i: _r(G.weighted_median_test(i), "estimate", "se", "ci_lower", "ci_upper", "p"))
query(
    "win4_weighted_median", "instruments", lambda i: _r(G.weighted_median(i), "estimate"),
    """WITH r AS (SELECT pair_id, snp, round(beta_outcome / beta_exposure, 9) AS ratio, power(beta_exposure / se_outcome, 2) AS wt FROM instruments WHERE beta_exposure <> 0),
c AS (SELECT *, sum(wt) OVER (PARTITION BY pair_id ORDER BY ratio, snp) / sum(wt) OVER (PARTITION BY pair_id) AS upto FROM r)
SELECT pair_id, round(min(ratio), 6) AS estimate FROM c WHERE round(upto, 9) >= 0.5 GROUP BY pair_id""",
)
query(
    "num5_weighted_mode", "instruments", lambda i: _r(G.weighted_mode(i), "estimate", digits=4),
    """WITH r AS (SELECT pair_id, beta_outcome / beta_exposure AS r, abs(beta_exposure) / se_outcome AS wt FROM instruments WHERE beta_exposure <> 0),
e AS (SELECT pair_id, min(r) - 1 AS lo, max(r) + 1 AS hi FROM r GROUP BY pair_id), g AS (SELECT pair_id, i, lo + (hi - lo) * i / 999 AS x FROM e, range(1000) t(i)),
d AS (SELECT g.pair_id, i, x, round(sum(wt * exp(-0.5 * ((x - r) / 0.5) * ((x - r) / 0.5))), 9) AS density FROM g JOIN r ON g.pair_id = r.pair_id GROUP BY g.pair_id, i, x)
SELECT pair_id, round(arg_max(x, (density, -i)), 4) AS estimate FROM d GROUP BY pair_id""",
)
query("fil14_instrument_flags", "instruments", G.instrument_flags, "SELECT pair_id, snp, effect_allele || other_allele IN ('AT', 'TA', 'CG', 'GC') AS palindromic, eaf BETWEEN 0.42 AND 0.58 AS ambiguous_eaf, f_statistic < 10 AS weak FROM instruments")
