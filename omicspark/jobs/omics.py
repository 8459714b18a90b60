"""Queries on expression, proteins, cells and abundances."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from omicspark.jobs.query import query
from omicspark.operators import expression as X


def _r(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


query("agg19_sample_qc", "counts", X.sample_qc, "SELECT sample_id, sum(count)::BIGINT AS library_size, count(*) FILTER (count > 0) AS n_genes FROM counts GROUP BY sample_id")
query("fil5_low_count", "counts", lambda c: X.low_count_filter(c, 60, 18).select("gene", "sample_id", "count"), "SELECT gene, sample_id, count FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY gene HAVING count(*) FILTER (count >= 60) >= 18)")
_CPM = "t AS (SELECT sample_id, sum(count) AS total FROM counts GROUP BY sample_id), c AS (SELECT gene, sample_id, grp, count * 1e6 / total AS cpm, log2(count * 1e6 / total + 1) AS l FROM counts JOIN t USING (sample_id))"
query("agg20_cpm", "counts", lambda c: _r(X.cpm(c).select("gene", "sample_id", "cpm", "log2_cpm"), "cpm", "log2_cpm"), f"WITH {_CPM} SELECT gene, sample_id, round(cpm, 6) AS cpm, round(l, 6) AS log2_cpm FROM c")
_MOM = f"{_CPM}, m AS (SELECT gene, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, avg(l) FILTER (grp = 0) AS m0, avg(l) FILTER (grp = 1) AS m1, var_samp(l) FILTER (grp = 0) AS v0, var_samp(l) FILTER (grp = 1) AS v1 FROM c GROUP BY gene)"
query("agg21_de", "counts", lambda c: _r(X.differential_expression(c).select("gene", "lfc", "z"), "lfc", "z", digits=5), f"WITH {_MOM} SELECT gene, round(m1 - m0, 5) AS lfc, round((m1 - m0) / sqrt((v0 + 1e-12) / n0 + (v1 + 1e-12) / n1), 5) AS z FROM m")
query("agg21_de_p", "counts", lambda c: _r(X.differential_expression(c), "lfc", "z", "p", "padj"))
query(
    "agg22_welch", "counts", lambda c: _r(X.welch(X.cpm(c), "log2_cpm").drop("p"), "diff", "t", "df", "t_s0", digits=5),
    f"WITH {_MOM}, s AS (SELECT *, v0 / n0 AS a, v1 / n1 AS b FROM m) SELECT gene, n0, n1, round(m1 - m0, 5) AS diff, round((m1 - m0) / sqrt(a + b), 5) AS t, round((a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1)), 5) AS df, round((m1 - m0) / (sqrt(a + b) + 0.1), 5) AS t_s0 FROM s",
)
query("agg22_welch_p", "counts", lambda c: _r(X.benjamini_hochberg(X.welch(X.cpm(c), "log2_cpm").withColumn("g", F.col("gene") % 5), "p", ["g"], ["gene"]).select("gene", "p", "padj"), "p", "padj"))
query(
    "agg23_rank_sum", "counts", lambda c: _r(X.rank_sums(c, "count", ["gene"]).drop("exact", "p"), "z", digits=5),
    """WITH r AS (SELECT gene, grp, rank() OVER w + (count(*) OVER (PARTITION BY gene, count) - 1) / 2 AS mid, count(*) OVER (PARTITION BY gene, count) AS c FROM counts WINDOW w AS (PARTITION BY gene ORDER BY count)),
s AS (SELECT gene, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, sum(mid) FILTER (grp = 1) AS r1, sum(c * c - 1) AS ties FROM r GROUP BY gene), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s)
SELECT gene, n0, n1, u, round((u - n0 * n1 / 2) / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))), 5) AS z FROM u""",
)
query(
    "agg23_exact", "counts", lambda c: _r(X.rank_sums(c, "count", ["gene", "batch"]).select("gene", "batch", "n0", "n1", "u", "exact", F.when(F.col("exact"), F.col("p")).alias("p")), "p"),
    """WITH r AS (SELECT gene, batch, grp, rank() OVER w + (count(*) OVER (PARTITION BY gene, batch, count) - 1) / 2 AS mid, count(*) OVER (PARTITION BY gene, batch, count) AS c FROM counts WINDOW w AS (PARTITION BY gene, batch ORDER BY count)),
u AS (SELECT gene, batch, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, sum(mid) FILTER (grp = 1) - count(*) FILTER (grp = 1) * (count(*) FILTER (grp = 1) + 1) / 2 AS u, max(c) = 1 AND least(count(*) FILTER (grp = 0), count(*) FILTER (grp = 1)) <= 8 AS exact FROM r GROUP BY gene, batch),
k AS (SELECT DISTINCT n0, n1 FROM u), a AS (SELECT n0, n1, list_sum(list_transform(range(0, n0 + n1), lambda i: ((m >> i) & 1) * (i + 1))) - n1 * (n1 + 1) / 2 AS u FROM k, range(0, 16384) t(m) WHERE m < (1::BIGINT << (n0 + n1)) AND bit_count(m) = n1),
p AS (SELECT u.gene, u.batch, least(1, 2 * count(*) FILTER (a.u >= greatest(u.u, u.n0 * u.n1 - u.u)) / count(*)) AS p FROM u JOIN a ON a.n0 = u.n0 AND a.n1 = u.n1 WHERE exact GROUP BY u.gene, u.batch)
SELECT u.*, round(p.p, 6) AS p FROM u LEFT JOIN p USING (gene, batch)""",
)
query("agg22_regulation", "counts", lambda c: _r(X.protein_regulation(X.cpm(c), "log2_cpm"), "mean_intensity", "mean_treatment", "mean_control", "log2fc", "p", "padj", "threshold"))
query(
    "agg22_threshold", "counts", lambda c: X.regulation(X.differential_expression(c).select("gene", F.col("lfc").alias("log2fc"), "p"), s0=0.02).select("gene", F.round("log2fc", 5).alias("log2fc"), F.round(F.least("threshold", F.lit(8.0)), 4).alias("threshold")),
    # Student's t of four degrees of freedom has a closed form; its quantile at 0.975 is the constant.
    f"WITH {_MOM}, f AS (SELECT gene, m1 - m0 AS x, 2.7764451051977987 AS ta FROM m), d AS (SELECT gene, x, CASE WHEN abs(x) > ta * 0.02 THEN ta * (1 + 0.02 / (abs(x) / ta - 0.02)) END AS d FROM f), e AS (SELECT gene, x, d, d / sqrt(1 + d * d / 4) AS s FROM d) SELECT gene, round(x, 5) AS log2fc, round(least(8, CASE WHEN d IS NOT NULL THEN -log10(greatest(1e-300, 1 - 0.75 * s * (1 - s * s / 12))) END), 4) AS threshold FROM e",
)
query("agg23_abundance", "counts", lambda c: _r(X.differential_abundance(c, "count", "rank_sum"), "mean0", "mean1", "log2fc", "p", "padj"))
_P = "(gene * 7919 % 1009) / 1009.0"
query(
    "win1_bh", "counts", lambda c: _r(X.benjamini_hochberg(c.withColumn("p", F.when(F.col("gene") % 50 == 0, None).otherwise(F.expr("cast((gene * 7919 + sample_id * 31) % 1009 as double) / 1009"))), "p", ["sample_id"], ["gene"]).select("gene", "sample_id", "padj"), "padj"),
    """WITH x AS (SELECT gene, sample_id, CASE WHEN gene % 50 = 0 THEN NULL ELSE ((gene * 7919 + sample_id * 31) % 1009)::DOUBLE / 1009 END AS p FROM counts),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p NULLS LAST, gene) AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM x),
a AS (SELECT *, min(coalesce(p * n / k, 1)) OVER (PARTITION BY sample_id ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM r)
SELECT gene, sample_id, round(CASE WHEN p IS NULL THEN 1 ELSE least(1, m) END, 6) AS padj FROM a""",
)
query(
    "fil10_significance", "counts", lambda c: X.significance(c.select("gene", "sample_id", F.expr("case gene % 4 when 0 then null when 1 then double('nan') when 2 then 0.0 else 0.2 end").alias("padj"), (F.col("gene") % 7 - 3).cast("double").alias("lfc")), "padj", "lfc").select("gene", "sample_id", "safe_p", "label"),
    "WITH x AS (SELECT gene, sample_id, CASE gene % 4 WHEN 2 THEN 1e-300 WHEN 3 THEN 0.2 ELSE 1 END AS safe_p, gene % 7 - 3 AS lfc FROM counts) SELECT gene, sample_id, safe_p::DOUBLE AS safe_p, CASE WHEN safe_p <= 0.05 AND lfc >= 1 THEN 'up' WHEN safe_p <= 0.05 AND lfc <= -1 THEN 'down' ELSE 'unchanged' END AS label FROM x",
)
_LFC = f"{_MOM}, d AS (SELECT gene, round(m1 - m0, 6) AS lfc FROM m)"
query("agg26_top_genes", "counts", lambda c: X.top_k(X.differential_expression(c).select("gene", F.round("lfc", 6).alias("lfc")).withColumn("direction", F.when(F.col("lfc") > 0, "up").otherwise("down")), ["direction"], [F.abs("lfc").desc(), F.col("gene")], 10), f"WITH {_LFC}, e AS (SELECT *, CASE WHEN lfc > 0 THEN 'up' ELSE 'down' END AS direction FROM d) SELECT gene, lfc, direction, row_number() OVER (PARTITION BY direction ORDER BY abs(lfc) DESC, gene) AS rank FROM e QUALIFY rank <= 10")
query("agg26_directions", "counts", lambda c: X.direction_counts(X.differential_expression(c).select("gene", F.round("lfc", 6).alias("lfc"), F.round(F.abs("z"), 4).alias("padj")), "padj", "lfc", 1.5, 0.2), f"WITH {_MOM}, d AS (SELECT gene, round(m1 - m0, 6) AS lfc, round(abs((m1 - m0) / sqrt((v0 + 1e-12) / n0 + (v1 + 1e-12) / n1)), 4) AS z FROM m) SELECT count(*) AS n_tested, count(*) FILTER (z <= 1.5 AND lfc >= 0.2) AS n_up, count(*) FILTER (z <= 1.5 AND lfc <= -0.2) AS n_down FROM d")
query(
    "agg25_outliers", "counts", lambda c: _r(X.outliers(c.select("gene", "sample_id", F.col("count").cast("double").alias("value")), F.col("sample_id") >= 5, 3.0), "z"),
    """WITH m AS (SELECT gene, quantile_cont(count::DOUBLE, 0.5) AS m FROM counts WHERE sample_id >= 5 GROUP BY gene), d AS (SELECT gene, m, quantile_cont(abs(count - m), 0.5) AS mad FROM counts JOIN m USING (gene) WHERE sample_id >= 5 GROUP BY gene, m),
z AS (SELECT gene, sample_id, 0.6745 * (count - m) / mad AS z FROM counts JOIN d USING (gene) WHERE sample_id < 5 AND mad > 0) SELECT gene, sample_id, round(z, 6) AS z FROM z WHERE abs(z) >= 3""",
)
def _intensities(c):
    return c.select("gene", "sample_id", F.when(F.col("count") > 40, F.log2("count")).alias("value"))


query("agg24_downshift", "counts", lambda c: X.downshift(_intensities(c)).where("imputed").groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")))
query("agg24_moments", "counts", lambda c: c.sparkSession.createDataFrame([X.matrix_moments(_intensities(c))], "median double, sd double").select(F.round(F.col("median") - 1.8 * F.col("sd"), 6).alias("mean"), F.round(0.3 * F.col("sd"), 6).alias("sd")), "WITH v AS (SELECT log2(count) AS v FROM counts WHERE count > 40) SELECT round(median(v) - 1.8 * stddev_pop(v), 6) AS mean, round(0.3 * stddev_pop(v), 6) AS sd FROM v")
_PRO = "x AS (SELECT gene, sample_id, CASE WHEN count = 0 THEN NULL ELSE count END AS v, gene % 40 = 0 AS contaminant FROM counts)"
query("fil8_protein_filter", "counts", lambda c: c.where("gene % 40 <> 0").select("gene", "sample_id", F.expr("nullif(count, 0)").alias("value")).groupBy("gene").agg(F.count("value").alias("n_values"), F.sum("value").alias("total")).where("n_values > 0"), f"WITH {_PRO} SELECT gene, count(v) AS n_values, sum(v)::BIGINT AS total FROM x WHERE NOT contaminant GROUP BY gene HAVING count(v) > 0")
query("fil6_warn_samples", "counts", lambda c: c.join(c.where("count = 0").select("gene").distinct(), "gene", "left_anti").groupBy("gene").agg(F.sum("count").alias("total")), "SELECT gene, sum(count)::BIGINT AS total FROM counts WHERE gene NOT IN (SELECT gene FROM counts WHERE count = 0) GROUP BY gene")
query("fil7_log10_positive", "counts", lambda c: c.where("grp = 1 and batch <> 2").select("gene", "sample_id", F.round(F.log10(F.expr("nullif(count, 0)")), 6).alias("log10_rfu")), "SELECT gene, sample_id, round(log10(nullif(count, 0)), 6) AS log10_rfu FROM counts WHERE grp = 1 AND batch <> 2")
query("agg31_npx", "counts", lambda c: c.groupBy("gene").pivot("sample_id", list(range(20))).agg(F.first("count")).select("gene", *[F.col(str(i)).alias(f"s{i}") for i in range(20)]).join(c.groupBy("gene").agg(F.round(100 * F.count_if(F.col("count") > 50) / F.count("*"), 6).alias("above_lod_pct")), "gene"), f"SELECT gene, {', '.join(f'(max(count) FILTER (sample_id = {i}))::BIGINT AS s{i}' for i in range(20))}, round(100 * count(*) FILTER (count > 50) / count(*), 6) AS above_lod_pct FROM counts GROUP BY gene")
query("jon9_metadata", "counts", lambda c: X.aligned(c.select("gene", "sample_id", "count"), c.select("sample_id", "grp").distinct(), "grp").groupBy("grp").agg(F.countDistinct("sample_id").alias("n_samples"), F.sum("count").alias("total")), "SELECT grp, count(DISTINCT sample_id) AS n_samples, sum(count)::BIGINT AS total FROM counts GROUP BY grp")
query(
    "jon12_paired_delta", "counts", lambda c: c.where("sample_id % 2 = 0").select("gene", (F.col("sample_id") / 2).cast("bigint").alias("subject"), F.col("count").alias("before")).join(c.where("sample_id % 2 = 1").select("gene", ((F.col("sample_id") - 1) / 2).cast("bigint").alias("subject"), F.col("count").alias("after")), ["gene", "subject"]).select("gene", "subject", (F.col("after") - F.col("before")).alias("delta")),
    "SELECT a.gene, a.sample_id // 2 AS subject, b.count - a.count AS delta FROM counts a JOIN counts b ON a.gene = b.gene AND b.sample_id = a.sample_id + 1 WHERE a.sample_id % 2 = 0",
)
query("jon20_outlier_panel", "counts", lambda c: c.join(F.broadcast(c.where("gene % 10 = 0 and sample_id = 0").select("gene", F.lit("panel").alias("mechanism"))), "gene", "left").select("gene", "sample_id", F.coalesce("mechanism", F.lit("none")).alias("mechanism")), "SELECT gene, sample_id, CASE WHEN gene % 10 = 0 THEN 'panel' ELSE 'none' END AS mechanism FROM counts")
def _clock(c, s):
    return X.organ_ages(c.select("sample_id", F.col("gene").alias("protein"), F.log2(F.col("count") + 1).alias("value")), s.select(F.col("pgs_id").alias("organ"), F.col("variant_id").alias("protein"), F.col("effect_weight").alias("weight")), s.select(F.col("pgs_id").alias("organ")).distinct().select("organ", (30.0 + F.col("organ")).alias("intercept")))


_CLOCK = """p AS (SELECT DISTINCT gene FROM counts), k AS (SELECT pgs_id AS organ, count(gene) AS n_used, count(*) - count(gene) AS n_missing FROM scores LEFT JOIN p ON gene = variant_id GROUP BY pgs_id),
a AS (SELECT sample_id, pgs_id AS organ, 30 + any_value(pgs_id) + sum(log2(count + 1) * effect_weight) AS age FROM counts JOIN scores ON gene = variant_id GROUP BY sample_id, pgs_id)"""
query("agg46_correlation", "counts scores", lambda c, s: _r(X.correlations(_clock(c, s), "organ", "sample_id", "age"), "r"), f"WITH {_CLOCK} SELECT x.organ AS item_1, y.organ AS item_2, round(corr(x.age, y.age), 6) AS r FROM a x JOIN a y ON x.sample_id = y.sample_id AND x.organ < y.organ GROUP BY ALL")
query("agg45_organ_clock", "counts scores", lambda c, s: _r(_clock(c, s), "age"), f"WITH {_CLOCK} SELECT sample_id, organ, round(age, 6) AS age, n_used, n_missing FROM a JOIN k USING (organ)")
query(
    "agg45_organ_clock_holes", "counts scores", lambda c, s: _r(_clock(c.withColumn("count", F.when((F.col("gene") * 31 + F.col("sample_id")) % 211 > 0, F.col("count"))), s), "age"),
    f"""WITH {_CLOCK}, h AS (SELECT sample_id, pgs_id AS organ, bool_or((gene * 31 + sample_id) % 211 = 0) AS hole FROM counts JOIN scores ON gene = variant_id GROUP BY sample_id, pgs_id)
SELECT s.sample_id, k.organ, round(CASE WHEN NOT hole THEN age END, 6) AS age, n_used, n_missing FROM (SELECT DISTINCT sample_id FROM counts) s, k LEFT JOIN a ON a.sample_id = s.sample_id AND a.organ = k.organ LEFT JOIN h ON h.sample_id = s.sample_id AND h.organ = k.organ""",
)
query("agg45_missing", "counts scores", lambda c, s: X.missing_proteins(c.select(F.col("gene").alias("protein")), s.select(F.col("pgs_id").alias("organ"), F.col("variant_id").alias("protein"))), "SELECT DISTINCT pgs_id AS organ, variant_id AS protein FROM scores WHERE variant_id NOT IN (SELECT gene FROM counts)")
query("agg52_probes", "counts", lambda c: c.groupBy((F.floor(F.col("gene") / 10)).alias("prefix"), "sample_id").agg(F.round(F.avg("count"), 6).alias("mean")), "SELECT gene // 10 AS prefix, sample_id, round(avg(count), 6) AS mean FROM counts GROUP BY ALL")
query("win14_display_cap", "counts", lambda c: _r(X.display_cap(c, "sample_id", "count"), "cap"), "WITH q AS (SELECT sample_id, greatest(quantile_cont(count::DOUBLE, 0.995), 4) AS cap, quantile_cont(count::DOUBLE, 0.9) AS t FROM counts GROUP BY sample_id) SELECT sample_id, round(any_value(cap), 6) AS cap, count(*) FILTER (count >= t) AS n_top FROM counts JOIN q USING (sample_id) GROUP BY sample_id")
query(
    "win15_even_sample", "obs", lambda o: X.evenly_spaced(o.select("cell", "cluster"), ["cell"], "cluster", 48),
    """WITH x AS (SELECT cell, cluster, row_number() OVER (PARTITION BY cluster ORDER BY cell) - 1 AS i, count(*) OVER (PARTITION BY cluster) AS n, min(cell) OVER (PARTITION BY cluster) AS first FROM obs),
t AS (SELECT greatest(1, 48 // count(DISTINCT cluster)) AS share, count(*) AS total FROM obs),
k AS (SELECT x.*, least(share, n) AS take, total FROM x, t),
c AS (SELECT *, list_contains(list_transform(range(take), lambda j: round_even(j * ((n - 1) / greatest(take - 1, 1)), 0)::BIGINT), i) OR total <= 48 AS chosen FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cell) AS turn FROM c WHERE NOT chosen),
f AS (SELECT cell, cluster FROM r ORDER BY turn, n - take - turn DESC, first LIMIT (SELECT greatest(0, 48 - count(*)) FROM c WHERE chosen))
SELECT cell, cluster FROM c WHERE chosen UNION ALL SELECT cell, cluster FROM f""",
)
query("win15_even_ungrouped", "obs", lambda o: X.evenly_spaced(o.select("cell"), ["cell"], None, 48), "WITH x AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS i, count(*) OVER () AS n FROM obs) SELECT cell FROM x WHERE n <= 48 OR list_contains(list_transform(range(48), lambda j: round_even(j * ((n - 1) / 47), 0)::BIGINT), i)")
query("srt3_de_order", "counts", lambda c: X.de_order(X.differential_expression(c)).limit(25).select("gene", F.round("lfc", 6).alias("lfc")), f"WITH {_MOM}, z AS (SELECT gene, m1 - m0 AS lfc, abs(m1 - m0) / sqrt((v0 + 1e-12) / n0 + (v1 + 1e-12) / n1) AS z FROM m) SELECT gene, round(lfc, 6) AS lfc FROM z ORDER BY z DESC, lfc DESC, gene LIMIT 25")
query("srt3_de_order_without_p", "counts", lambda c: X.de_order(X.differential_expression(c).select("gene", F.round("lfc", 6).alias("lfc"))).limit(25), f"WITH {_LFC} SELECT gene, lfc FROM d ORDER BY abs(lfc) DESC, gene LIMIT 25")
query("fil11_base_mean", "counts", lambda c: c.groupBy("gene").agg(F.avg("count").alias("base")).withColumn("n_ok", F.count_if(F.col("base") >= 100).over(W.partitionBy(F.lit(1)))).where("n_ok = 0 or base >= 100").select("gene", F.round("base", 6).alias("base")), "WITH b AS (SELECT gene, avg(count) AS base FROM counts GROUP BY gene) SELECT gene, round(base, 6) AS base FROM b WHERE base >= 100 OR (SELECT count(*) FROM b WHERE base >= 100) = 0")
query("agg27_majority", "obs", lambda o: _r(X.majority(o), "support", "confidence"), "WITH n AS (SELECT cluster, label, count(*) AS n, avg(confidence) AS c FROM obs GROUP BY ALL) SELECT cluster, label, n, (sum(n) OVER (PARTITION BY cluster))::BIGINT AS total, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS support, round(c, 6) AS confidence FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1")
query(
    "agg28_markers", "cells obs", X.markers,
    """WITH a AS (SELECT g.gene, o.cell, o.cluster, coalesce(c.count, 0) AS v FROM (SELECT DISTINCT gene FROM cells) g CROSS JOIN obs o LEFT JOIN cells c ON c.cell = o.cell AND c.gene = g.gene),
r AS (SELECT gene, cluster, v, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2 AS mid FROM a)
SELECT gene, cluster, count(*) AS n1, count(*) FILTER (v > 0) AS nz1, sum(mid) - count(*) * (count(*) + 1) / 2 AS u FROM r GROUP BY gene, cluster HAVING count(*) FILTER (v > 0) > 0""",
)
_PAIRS = """a AS (SELECT g.gene, o.cell, o.cluster, o.batch, coalesce(c.count, 0) AS v FROM (SELECT DISTINCT gene FROM cells) g CROSS JOIN obs o LEFT JOIN cells c ON c.cell = o.cell AND c.gene = g.gene),
v AS (SELECT gene, {w} AS w, {g} AS g, v, count(*) AS c FROM a GROUP BY ALL), n AS (SELECT gene, w, g, sum(c) AS n, sum(c) FILTER (v > 0) AS nz FROM v GROUP BY ALL),
s AS (SELECT x.gene, x.w, x.g AS group_1, y.g AS group_2, sum(x.c * y.c * CASE WHEN y.v < x.v THEN 1 WHEN y.v = x.v THEN 0.5 ELSE 0 END) AS u FROM v x JOIN v y ON x.gene = y.gene AND x.w = y.w AND x.g < y.g GROUP BY ALL),
t AS (SELECT gene, w, group_1, group_2, sum(c * c * c - c) AS ties FROM (SELECT s.gene, s.w, s.group_1, s.group_2, v.v, sum(v.c) AS c FROM s JOIN v ON v.gene = s.gene AND v.w = s.w AND v.g IN (s.group_1, s.group_2) GROUP BY ALL) GROUP BY ALL),
z AS (SELECT s.*, m.n::BIGINT AS n1, k.n::BIGINT AS n2, coalesce(m.nz, 0) / m.n AS pts1, coalesce(k.nz, 0) / k.n AS pts2, ties, u - m.n * k.n / 2 AS d FROM s JOIN t USING (gene, w, group_1, group_2) JOIN n m ON m.gene = s.gene AND m.w = s.w AND m.g = group_1 JOIN n k ON k.gene = s.gene AND k.w = s.w AND k.g = group_2 WHERE m.n >= 2 AND k.n >= 2)"""
_PAIR_COLS = "gene, group_1, group_2, n1, n2, round(pts1, 6) AS pts1, round(pts2, 6) AS pts2, u::DOUBLE AS u, round(d / sqrt(n1 * n2 / 12 * (n1 + n2 + 1)), 5) AS z, round(CASE WHEN d = 0 THEN 0 ELSE d / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) END, 5) AS z_ties"


def _contrasts(c, o, *names):
    return _r(_r(X.pairwise_markers(c, o, *names).drop("p", "padj", "p_ties"), "pts1", "pts2"), "z", "z_ties", digits=5)


query("agg28_pairwise", "cells obs", lambda c, o: _contrasts(c, o, "cluster"), f"WITH {_PAIRS.format(w=0, g='cluster')} SELECT {_PAIR_COLS} FROM z")
query("agg28_within", "cells obs", lambda c, o: _contrasts(c, o, "batch", "cluster"), f"WITH {_PAIRS.format(w='cluster', g='batch')} SELECT w AS cluster, {_PAIR_COLS} FROM z")
query("agg28_pairwise_p", "cells obs", lambda c, o: _r(X.pairwise_markers(c, o, "cluster").select("gene", "group_1", "group_2", "p", "padj", "p_ties"), "p", "padj", "p_ties"))
_MARKERS = """a AS (SELECT g.gene, o.cell, o.cluster, coalesce(c.count, 0) AS v FROM (SELECT DISTINCT gene FROM cells) g CROSS JOIN obs o LEFT JOIN cells c ON c.cell = o.cell AND c.gene = g.gene),
r AS (SELECT gene, cluster, v, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2 AS mid FROM a),
u AS (SELECT gene, cluster, sum(mid) - count(*) * (count(*) + 1) / 2 AS u FROM r GROUP BY gene, cluster HAVING count(*) FILTER (v > 0) > 0)"""
query("win7_top_markers", "cells obs", lambda c, o: X.top_k(X.markers(c, o).select("gene", "cluster", "u"), ["cluster"], [F.col("u").desc(), F.col("gene")], 5), f"WITH {_MARKERS} SELECT gene, cluster, u, row_number() OVER (PARTITION BY cluster ORDER BY u DESC, gene) AS rank FROM u QUALIFY rank <= 5")
query(
    "fil16_cell_qc", "cells", lambda c: X.cell_qc(c, 3, 0.3, 50, F.col("gene") < 20).select("cell", "gene", "count"),
    """WITH s AS (SELECT cell, count(*) FILTER (count > 0) AS g, sum(CASE WHEN gene < 20 THEN count ELSE 0 END) / sum(count) AS m FROM cells GROUP BY cell), k AS (SELECT c.* FROM cells c JOIN s ON s.cell = c.cell AND g >= 3 AND m <= 0.3)
SELECT cell, gene, count FROM k WHERE gene IN (SELECT gene FROM k WHERE count > 0 GROUP BY gene HAVING count(*) >= 50)""",
)
query(
    "num10_variable_genes", "cells obs", lambda c, o: _r(X.variable_genes(c, F.lit(float(o.count()))), "z", digits=4),
    """WITH v AS (SELECT gene, ln(1 + count * 1e4 / sum(count) OVER (PARTITION BY cell)) AS v FROM cells), n AS (SELECT count(*)::DOUBLE AS n FROM obs),
m AS (SELECT gene, sum(v) / any_value(n) AS mean, sum(v * v) / any_value(n) AS sq FROM v, n GROUP BY gene), d AS (SELECT gene, mean, (sq - mean * mean) / mean AS d, ntile(10) OVER (ORDER BY mean, gene) AS bin FROM m),
z AS (SELECT gene, bin, (d - avg(d) OVER w) / stddev(d) OVER w AS z FROM d WINDOW w AS (PARTITION BY bin)) SELECT gene, bin::INT AS bin, round(z, 4) AS z, row_number() OVER (ORDER BY z DESC NULLS LAST, gene) <= 20 AS variable FROM z""",
)
query(
    "agg29_batch_mixing", "obs", lambda o: _r(X.batch_mixing(o.select("cell", "batch", F.explode(F.sequence(F.col("cell") + 1, F.col("cell") + 4)).alias("other")).join(o.select(F.col("cell").alias("other"), F.col("batch").alias("other_batch")), "other")), "cross", "entropy"),
    """WITH e AS (SELECT a.cell, a.batch, b.batch AS ob, count(*) AS c FROM obs a JOIN obs b ON b.cell IN (a.cell + 1, a.cell + 2, a.cell + 3, a.cell + 4) GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY cell) AS p FROM e)
SELECT cell, round(sum(CASE WHEN batch <> ob THEN p ELSE 0 END), 6) AS cross, round(0 - sum(p * log2(p)) / (SELECT log2(greatest(2, count(DISTINCT batch))) FROM obs), 6) AS entropy FROM p GROUP BY cell""",
)
query("agg30_abundance", "counts", lambda c: c.withColumn("pct", F.round(100 * F.col("count") / F.sum("count").over(W.partitionBy("sample_id")), 6)).where("count > 0").select("gene", "sample_id", "pct"), "WITH x AS (SELECT gene, sample_id, count, round(100 * count / sum(count) OVER (PARTITION BY sample_id), 6) AS pct FROM counts) SELECT gene, sample_id, pct FROM x WHERE count > 0")
query("fil9_perfect_strict", "annotations", lambda a: a.where(F.col("impact").isin("HIGH", "MODERATE")).groupBy("gene").agg(F.count("*").alias("n")), "SELECT gene, count(*) AS n FROM annotations WHERE impact IN ('HIGH', 'MODERATE') GROUP BY gene")
