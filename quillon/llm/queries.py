"""Queries and SQL of the training-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import language, leaks, near_duplicates, packing, scan_noise, shared_spans
from quillon.session import materialise, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, sf_dir, "paragraphs"), "paragraph_id", 0.5)
    return pairs.select("paragraph_id_a", "paragraph_id_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at the usual similarity of 0.8: one row per paragraph, its number of linked texts."""
    return near_duplicates.similar_groups(table(spark, sf_dir, "paragraphs"), "paragraph_id", 0.8).select("paragraph_id", "n_links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.defects(table(spark, sf_dir, "paragraphs"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repaired(table(spark, sf_dir, "paragraphs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "paragraphs"), "paragraph_id")


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each paragraph is shared."""
    paragraphs = table(spark, sf_dir, "paragraphs")
    return shared_spans.shared_amount(shared_spans.shared_spans(paragraphs, "paragraph_id"), paragraphs, "paragraph_id")


def p5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal stretches that stand in the same paragraphs, and in how many."""
    return shared_spans.repeats(table(spark, sf_dir, "paragraphs"), "paragraph_id").drop("other")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers of each specification: see packing.account."""
    lengths = materialise(packing.token_lengths(table(spark, sf_dir, "documents")), "lengths")
    specs = table(spark, sf_dir, "container_specs")
    return packing.account(materialise(packing.pack(lengths, specs), "containers"), lengths, specs)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and used room of each specification."""
    specs = table(spark, sf_dir, "container_specs")
    return packing.fill(packing.pack(packing.token_lengths(table(spark, sf_dir, "documents")), specs), specs)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the stated length; the fingerprints' candidates that are equal word for word."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), leaks.PASSAGE, radius=3)
    return found.where("verbatim").select("doc_id", "item_id")


def p8_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand in a document as a whole, with small edits too: how many of its windows are like the item."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id", "n_windows", "verbatim")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(table(spark, sf_dir, "documents")).select("doc_id", "seg_no", "lang")


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p5_found": p5_found,
    "p5_shared": p5_shared,
    "p5_repeats": p5_repeats,
    "p7_packing": p7_packing,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_similar": p8_similar,
    "p9_found": p9_found,
}

_TOKENS = """toks as (select paragraph_id, regexp_extract_all(lower(max(text)), '[a-z0-9]+') as t from paragraphs where text is not null group by 1)"""
_PAIRS = f"""with {_TOKENS},
sh as (select distinct paragraph_id as id, array_to_string(t[i:i+4], ' ') as s from (select paragraph_id, t, unnest(range(1, len(t) - 3)) as i from toks where len(t) >= 5)),
n as (select id, count(*) as n from sh group by 1),
common as (select a.id as a, b.id as b, count(*) as k from sh a join sh b on a.s = b.s and a.id < b.id group by 1, 2),
pairs as (select a, b, k / (x.n + y.n - k) as j from common join n x on x.id = a join n y on y.id = b)"""
_SPANS = f"""with {_TOKENS},
w as (select paragraph_id, i - 1 as pos, array_to_string(t[i:i+19], ' ') as s from (select paragraph_id, t, unnest(range(1, len(t) - 18)) as i from toks where len(t) >= 20)),
hit as (select paragraph_id, pos from w where s in (select s from w group by s having count(distinct paragraph_id) > 1)),
runs as (select paragraph_id, pos, sum(case when gap <= 20 then 0 else 1 end) over (partition by paragraph_id order by pos) as run
         from (select *, pos - lag(pos) over (partition by paragraph_id order by pos) as gap from hit)),
spans as (select paragraph_id, min(pos) as span_start, max(pos) + 20 - min(pos) as span_tokens from runs group by paragraph_id, run)"""

_WORDS = """regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')"""
_RUNS = "select {0}, unnest(list_transform(range(1, len(t) - 11), lambda i: array_to_string(t[i:i+12], ' '))) as s from (select {0}, {1} as t from {2}) where len(t) >= 13"

SQL = {
    "p7_packing": """select spec_id, (select count(distinct doc_id) from documents where text <> '') as n_documents, 0::bigint as lost_tokens,
0::bigint as over_full, 0::bigint as needless_splits, true as well_filled from container_specs""",
    "p8_found": f"""with i as (select distinct * from ({_RUNS.format("item_id", _WORDS, "eval_items")})), d as ({_RUNS.format("doc_id", _WORDS, "documents")})
select distinct doc_id, item_id from d join i using (s)""",
    "p1_found": f"{_PAIRS} select a as paragraph_id_a, b as paragraph_id_b from pairs where j >= 0.5",
    "p1_groups": f"""{_PAIRS}, sets as (select id, list(s order by s) as c from sh group by 1),
links as (select id, count(distinct c) filter (c <> mine) as n_links, count(*) as n from (
  select l.id, sets.c, own.c as mine from (select a as id, b as other from pairs where j >= 0.8 union all select b, a from pairs where j >= 0.8) l
  join sets on sets.id = other join sets own on own.id = l.id) group by 1)
select id as paragraph_id, n_links from links""",
    "p5_found": f"{_SPANS} select paragraph_id, span_start, span_tokens from spans",
    "p5_repeats": f"""with {_TOKENS},
w as (select paragraph_id, i - 1 as pos, array_to_string(t[i:i+19], ' ') as s from (select paragraph_id, t, unnest(range(1, len(t) - 18)) as i from toks where len(t) >= 20)),
held as (select s, list(distinct paragraph_id order by paragraph_id) as held_by from w group by s having count(distinct paragraph_id) > 1),
hit as (select paragraph_id, pos, held_by, pos - row_number() over (partition by paragraph_id, held_by order by pos) as run from w join held using (s))
select paragraph_id, min(pos) as span_start, max(pos) + 20 - min(pos) as span_tokens, len(held_by) as n_records from hit group by paragraph_id, held_by, run""",
    "p5_shared": f"""{_SPANS} select paragraph_id, coalesce(n_spans, 0) as n_spans, coalesce(shared_tokens, 0)::bigint as shared_tokens, len(t) as n_tokens,
round(coalesce(shared_tokens, 0) / len(t), 6) as shared_ratio
from toks left join (select paragraph_id, count(*) as n_spans, sum(span_tokens) as shared_tokens from spans group by 1) using (paragraph_id) where len(t) > 0""",
}
