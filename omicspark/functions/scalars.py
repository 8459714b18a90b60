"""Small functions of columns that several jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from omicspark.operators.annotate import severity_rank


def distinct_join(values: Column, sep: str = ";") -> Column:
    """The different non-empty strings of an array, in the order in which they come first."""
    return F.array_join(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != ""))), sep)


def date_key(text: Column) -> Column:
    """A date of any precision as a number yyyymmdd for sorting, zeros for what is missing; month names count."""
    parts = F.split(F.trim(text), r"[\s/-]+")
    names = F.array(*map(F.lit, "jan feb mar apr may jun jul aug sep oct nov dec".split()))
    month = F.get(parts, F.lit(1))
    number = F.coalesce(month.try_cast("int"), F.nullif(F.array_position(names, F.lower(F.substring(month, 1, 3))).cast("int"), F.lit(0)), F.lit(0))
    return F.coalesce(F.get(parts, F.lit(0)).try_cast("int"), F.lit(0)) * 10000 + number * 100 + F.coalesce(F.get(parts, F.lit(2)).try_cast("int"), F.lit(0))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, question or exclamation mark before a space, or the whole text."""
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)^(.*?[.!?])(?=\s)", 1), F.lit("")), text))


def author_list(names: Column, most: int = 3) -> Column:
    """The first authors, with "et al." where there are more."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, " et al.").otherwise(""))


def sequence_type(seq: Column) -> Column:
    """nucleotide if more than 85% of the first 500 characters are nucleotide letters, else protein; null if empty."""
    head = F.upper(F.substring(seq, 1, 500))
    share = F.try_divide(F.length(F.regexp_replace(head, "[^ACGTUN]", "")), F.length(head))
    return F.when(share > 0.85, "nucleotide").when(share.isNotNull(), "protein")


def residue_share(seq: Column, letters: str) -> Column:
    """Percentage of the residues that are among the letters."""
    return F.try_divide(100 * F.length(F.regexp_replace(F.upper(seq), f"[^{letters}]", "")), F.length(seq))


def is_female(sex: Column) -> Column:
    """1 for female, 0 for male, null for anything else."""
    s = F.upper(F.trim(sex))
    return F.when(s.isin("F", "FEMALE", "WOMAN", "2"), 1).when(s.isin("M", "MALE", "MAN", "1"), 0)


def nested_evidence(transcripts: Column, colocated: Column) -> dict[str, Column]:
    """transcripts: array of struct(terms array, gene, sift, polyphen). colocated: array of maps population -> frequency.
    The most severe term, the gene of the first transcript that carries it, the first SIFT and PolyPhen there is, and
    the largest gnomAD frequency."""
    ranked = F.flatten(F.transform(transcripts, lambda t: F.transform(t["terms"], lambda x: F.struct(F.coalesce(severity_rank(x), F.lit(999)).alias("r"), x.alias("term")))))
    term = F.array_min(ranked)["term"]
    carriers = F.filter(transcripts, lambda t: F.array_contains(t["terms"], term))

    def first(field: str) -> Column:
        return F.get(F.filter(F.transform(transcripts, lambda t: t[field]), lambda x: x.isNotNull()), F.lit(0))

    gnomad = F.flatten(F.transform(colocated, lambda m: F.map_values(F.map_filter(m, lambda k, v: F.lower(k).contains("gnomad")))))
    return {"consequence": term, "gene": F.get(carriers, F.lit(0))["gene"], "sift": first("sift"), "polyphen": first("polyphen"), "gnomad_af": F.array_max(gnomad)}
