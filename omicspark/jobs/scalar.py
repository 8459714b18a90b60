"""Queries on scalar functions and remaining orders."""

from pyspark.sql import functions as F

from omicspark.functions import scalars as S
from omicspark.jobs.query import query
from omicspark.operators import expression as X

query("fn8_distinct_join", "annotations", lambda a: a.select("variant_id", S.distinct_join(F.array("consequence", "impact", "consequence", "clinvar", F.lit(" "))).alias("joined")), "SELECT variant_id, concat_ws(';', consequence, impact, clinvar) AS joined FROM annotations")
query("fn12_text_fields", "papers", lambda p: p.select("doc_id", S.date_key(F.concat_ws(" ", (F.lit(2000) + F.col("doc_id") % 20).cast("string"), F.when(F.col("doc_id") % 3 == 0, "Mar").when(F.col("doc_id") % 3 == 1, "11"), F.when(F.col("doc_id") % 3 == 0, "7"))).alias("date_key"), S.first_sentence(F.col("text")).alias("first"), S.author_list(F.split("source", "r")).alias("authors")), """SELECT doc_id, ((2000 + doc_id % 20) * 10000 + CASE doc_id % 3 WHEN 0 THEN 307 WHEN 1 THEN 1100 ELSE 0 END)::BIGINT AS date_key, trim(coalesce(nullif(regexp_extract(text, '(?s)^(.*?[.!?])\\s', 1), ''), text)) AS first, array_to_string(string_split(source, 'r')[1:3], ', ') AS authors FROM papers""")
query(
    "fn15_sequence_type", "papers", lambda p: p.select("doc_id", S.sequence_type(F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.upper("text"), "[^ACGT]", "")).otherwise(F.col("text"))).alias("kind"), F.round(S.residue_share(F.col("text"), "FWY"), 4).alias("aromatic"), F.round(S.residue_share(F.col("text"), "DEKR"), 4).alias("charged")),
    "WITH x AS (SELECT doc_id, text, upper(substr(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(upper(text), '[^ACGT]', '', 'g') ELSE text END, 1, 500)) AS h FROM papers) SELECT doc_id, CASE WHEN length(regexp_replace(h, '[^ACGTUN]', '', 'g')) / nullif(length(h), 0) > 0.85 THEN 'nucleotide' WHEN length(h) > 0 THEN 'protein' END AS kind, round(100 * length(regexp_replace(upper(text), '[^FWY]', '', 'g')) / length(text), 4) AS aromatic, round(100 * length(regexp_replace(upper(text), '[^DEKR]', '', 'g')) / length(text), 4) AS charged FROM x",
)
query("fn17_sex_flag", "pedigree", lambda p: p.select("id", S.is_female(F.element_at(F.array(*map(F.lit, [" f", "Male", "woman", "?", "M"])), (F.col("id") % 5 + 1).cast("int"))).alias("female")), "SELECT id, CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 0 END AS female FROM pedigree")


def _nested(a):
    one = F.struct(F.array(F.col("consequence"), F.lit("intron_variant")).alias("terms"), F.concat("gene", F.lit("a")).alias("gene"), F.when(F.col("variant_id") % 2 == 0, "tolerated").alias("sift"), F.lit(None).cast("string").alias("polyphen"))
    two = F.struct(F.array(F.lit("missense_variant")).alias("terms"), F.concat("gene", F.lit("b")).alias("gene"), F.lit("deleterious").alias("sift"), F.lit("benign").alias("polyphen"))
    return S.nested_evidence(F.array(one, two), F.array(F.create_map(F.lit("gnomad_nfe"), F.col("nfe"), F.lit("afr"), F.col("afr")), F.create_map(F.lit("gnomADg"), F.col("eas"))))


query(
    "fn20_nested_evidence", "annotations", lambda a: a.select("variant_id", *[c.alias(k) for k, c in _nested(a).items()]),
    """SELECT variant_id, CASE WHEN consequence IN ('stop_gained', 'frameshift_variant', 'inframe_deletion') THEN consequence ELSE 'missense_variant' END AS consequence, gene || CASE WHEN consequence IN ('stop_gained', 'frameshift_variant', 'inframe_deletion', 'missense_variant') THEN 'a' ELSE 'b' END AS gene,
  CASE WHEN variant_id % 2 = 0 THEN 'tolerated' ELSE 'deleterious' END AS sift, 'benign' AS polyphen, greatest(nfe, eas) AS gnomad_af FROM annotations""",
)
query(
    "srt4_outlier_order", "counts", lambda c: X.outliers(c.select("gene", "sample_id", F.col("count").cast("double").alias("value")), F.col("sample_id") >= 5, 2.0).select("gene", "sample_id", F.round("z", 6).alias("z"), (F.col("gene") % 10 == 0).alias("in_panel")).orderBy("sample_id", F.col("in_panel").desc(), F.abs("z").desc(), "gene"),
    """WITH m AS (SELECT gene, quantile_cont(count::DOUBLE, 0.5) AS m FROM counts WHERE sample_id >= 5 GROUP BY gene), d AS (SELECT gene, m, quantile_cont(abs(count - m), 0.5) AS mad FROM counts JOIN m USING (gene) WHERE sample_id >= 5 GROUP BY gene, m),
z AS (SELECT gene, sample_id, 0.6745 * (count - m) / mad AS z FROM counts JOIN d USING (gene) WHERE sample_id < 5 AND mad > 0) SELECT gene, sample_id, round(z, 6) AS z, gene % 10 = 0 AS in_panel FROM z WHERE abs(z) >= 2""",
)
query("agg5_balance", "dosages", lambda d: d.groupBy("population").agg(F.count_if(F.col("dosage") == 1).alias("h"), F.count("dosage").alias("n")).agg(F.round(F.least(F.lit(1.0), F.avg(F.col("h") / F.col("n")) / 0.5), 6).alias("balance"), F.count("*").alias("n_populations")), "SELECT round(least(1, avg(h / n) / 0.5), 6) AS balance, count(*) AS n_populations FROM (SELECT population, count(*) FILTER (dosage = 1) AS h, count(dosage) AS n FROM dosages GROUP BY population)")
