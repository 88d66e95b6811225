"""Overlap of texts in their context, and what a text needs before it is submitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, signs of disclosure, sentence ends, placeholders, figure and reference marks.
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\p{Z}]"
DISCLOSURE = r"\bpreprint\b|\bthesis\b|\bdisclos\w*\b|\bderived from\b|\badapted from\b|\breproduced from\b"
PRIOR_CATEGORIES = ("thesis", "preprints", "preprint")
SENTENCE_END = r".!?。！？"
WORD = r"[A-Za-z0-9]+|[一-鿿]"
LONG_SENTENCE = 45
PLACEHOLDER = r"\b(TODO|TBD|XXX|INSERT|PLACEHOLDER|AUTHOR QUERY)\b"
FIGURE_MARK = r"\b(?:Fig\.?|Figure)[ \t\r\n]+([A-Za-z0-9]+)"
REFERENCES = rf"^{SPACE}*(?:references|bibliography){SPACE}*$"
DOI = r"\b10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"
DOI_TAIL = r"[.,;:)］】]+$"


def normal_space(c: Column) -> Column:
    """Runs of any white space made one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def discloses(c: Column) -> Column:
    """Whether a text says that it stems from earlier work."""
    return F.coalesce(c.rlike(f"(?i)(?:{DISCLOSURE})"), F.lit(False))


def classify_overlap(pairs: DataFrame) -> DataFrame:
    """The pairs with (kind, risk, tags) of each overlap, by sections, categories and disclosure of both sides; the first rule that applies counts.

    ``pairs`` has left_ and right_ section, category and text, and similarity; nulls are no section, category or disclosure.
    """
    text = F.concat_ws("\n", "left_text", "right_text")
    either = lambda field, *names: F.coalesce(F.col(f"left_{field}").isin(*names), F.lit(False)) | F.coalesce(F.col(f"right_{field}").isin(*names), F.lit(False))
    disclosed, score = discloses(text), F.col("similarity")
    rules = [
        (either("section", "methods"), "methods_boilerplate_overlap", "R2_max", ["methods_boilerplate_overlap"]),
        (disclosed & either("category", *PRIOR_CATEGORIES), "self_overlap_candidate", "R2_max", ["self_overlap_candidate", "disclosed_prior_text_overlap"]),
        (either("section", "results") & (score >= 0.45) & ~disclosed, "text_overlap_candidate", "R3_possible", ["results_text_overlap"]),
        (either("section", "abstract", "conclusion") & (score >= 0.5) & ~disclosed, "text_overlap_candidate", "R3_possible", ["abstract_conclusion_overlap"]),
        (F.lit(True), "text_overlap_candidate", "R2_possible", []),
    ]
    out = F.lit(None)
    for when, kind, risk, tags in reversed(rules):
        row = F.struct(F.lit(kind).alias("kind"), F.lit(risk).alias("risk"), F.array(*[F.lit(t) for t in ("text_overlap_candidate", *tags)]).alias("tags"))
        out = F.when(when, row).otherwise(out)
    return pairs.withColumn("rule_", out).select(*pairs.columns, "rule_.kind", "rule_.risk", "rule_.tags")


def overlap_examples(left: Column, right: Column, most: int = 5) -> Column:
    """The first shared shingles in their order, a preview of ``most``."""
    return F.slice(F.array_sort(F.array_intersect(left, right)), 1, most)


def sentence_lengths(c: Column) -> Column:
    """Words, or ideographs, of each sentence that has any; a sentence ends with a mark and white space."""
    parts = F.split(c, f"(?<=[{SENTENCE_END}]){SPACE}+")
    return F.filter(F.transform(parts, lambda s: F.regexp_count(s, F.lit(WORD))), lambda n: n > 0)


def dois(c: Column) -> Column:
    """DOIs in order, lower case, closing punctuation dropped, each once."""
    found = F.regexp_extract_all(c, F.lit(f"(?i){DOI}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, DOI_TAIL, ""))))


def reference_section(c: Column) -> Column:
    """What follows the first heading of a reference list; empty without one."""
    return F.regexp_extract(c, f"(?imsd){REFERENCES}(.*)", 1)


def readiness(texts: DataFrame, key: str) -> DataFrame:
    """(key, n_sentences, n_long, n_words, placeholders, figure_refs, has_references, dois, language_status, reference_status) of each text.

    DOIs are those of the reference list, or of the whole text if there is none. A text with long sentences or placeholders, or without DOIs, needs
    attention. Null keys and texts give nothing; repeated rows count once.
    """
    t = texts.select(key, "text").where(f"{key} is not null and text is not null").distinct()
    section = reference_section(F.col("text"))
    t = t.withColumn("section", section).withColumn("lengths", sentence_lengths(F.col("text")))
    marks = lambda p, g: F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?i){p}"), F.lit(g))))
    t = t.withColumn("placeholders", marks(PLACEHOLDER, 0)).withColumn("figure_refs", marks(FIGURE_MARK, 1))
    t = t.withColumn("dois", dois(F.when(F.col("section") != "", F.col("section")).otherwise(F.col("text"))))
    n_long = F.size(F.filter("lengths", lambda n: n >= LONG_SENTENCE)).cast("bigint")
    status = lambda bad: F.when(bad, "needs_attention").otherwise("ready_for_manual_review")
    return t.select(
        key, F.size("lengths").cast("bigint").alias("n_sentences"), n_long.alias("n_long"), F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_words"),
        "placeholders", "figure_refs", (F.col("section") != "").alias("has_references"), "dois",
        status((n_long > 0) | (F.size("placeholders") > 0)).alias("language_status"), status(F.size("dois") == 0).alias("reference_status"),
    )
