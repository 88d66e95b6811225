"""Text functions, overlap of paragraphs, phrase search and readiness figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import text as T
from quillon.plans.dialect import DUCK, Spark, both
from quillon.session import table

#: Fixed values.
SECTIONS = ("abstract", "introduction", "methods", "results", "discussion", "conclusion", "materials and methods")


def latest_paragraphs(d: Spark) -> str:
    """One row per paragraph_id."""
    cols = "paragraph_id, doc_id, package_root, path, category, section, text"
    return f"paras as (select paragraph_id, max(doc_id) as doc_id, max(package_root) as package_root, max(path) as path, max(category) as category, max(section) as section, max(text) as text from (select {cols} from paragraphs) group by paragraph_id)"


def tokens(d: Spark, x: str = "text") -> str:
    return d.all(f"lower({x})", "[a-z0-9]+")


def _shingles(d: Spark) -> str:
    """Shingles by positions and the next four tokens, so no array function works on slices."""
    if d.spark:
        words = "words as (select paragraph_id, pos, col as w from toks lateral view posexplode(t) p as pos, col)"
    else:
        words = "words as (select paragraph_id, unnest(range(len(t))) as pos, unnest(t) as w from toks)"
    return f"""toks as (select paragraph_id, {tokens(d)} as t from paras where text is not null),
{words},
runs as (select paragraph_id, {"concat_ws(' ', w, lead(w, 1) over s, lead(w, 2) over s, lead(w, 3) over s, lead(w, 4) over s)"} as sh, lead(w, 4) over s as fifth from words window s as (partition by paragraph_id order by pos)),
shingles as (select distinct paragraph_id, sh from runs where fifth is not null)"""


def sc30_normal_space(d: Spark) -> str:
    return f"with {latest_paragraphs(d)} select paragraph_id, trim({d.sub('text', '[ \\t\\r\\n]+', ' ')}) as text from paras where text is not null"


def sc31_tokens(d: Spark) -> str:
    return f"with {latest_paragraphs(d)}, t as (select paragraph_id, {tokens(d)} as t from paras where text is not null) select paragraph_id, cast({d.size}(t) as bigint) as n_tokens, {d.at('t', '1')} as first_token from t"


def sc32_shingles(d: Spark) -> str:
    return f"with {latest_paragraphs(d)}, {_shingles(d)} select paragraph_id, count(*) as n_shingles, min(sh) as least, max(sh) as greatest_ from shingles group by paragraph_id"


def sc33_sections(d: Spark) -> str:
    """Section headings of documents and the section carried forward over their blocks."""
    if d.spark:
        blocks = "blocks as (select doc_id, pos, trim(col) as body from (select distinct doc_id, text from documents where text is not null) lateral view posexplode(split(trim(text), r'\\n[ \\t\\r]*\\n')) p as pos, col)"
    else:
        blocks = "blocks as (select doc_id, unnest(range(len(b))) as pos, trim(unnest(b)) as body from (select distinct doc_id, string_split_regex(trim(text), '\\n[ \\t\\r]*\\n') as b from documents where text is not null))"
    head = d.extract("lower(body)", "^(" + "|".join(reversed(SECTIONS)) + "):", 1)
    return f"""with {blocks}, heads as (select doc_id, pos, body, nullif(case when {head} = 'materials and methods' then 'methods' else {head} end, '') as head from blocks)
select doc_id, cast(pos as bigint) as block_no, coalesce({'last_value(head, true)' if d.spark else 'last_value(head ignore nulls)'} over (partition by doc_id order by pos rows between unbounded preceding and current row), 'unknown') as section,
cast({d.size}({tokens(d, d.sub('body', '^[A-Za-z ]+:[ ]*', ''))}) as bigint) as n_tokens from heads"""


def sc34_split_paragraphs(d: Spark) -> str:
    """Blocks of at least 24 tokens, numbered within their document."""
    if d.spark:
        blocks = "blocks as (select doc_id, pos, col as body from (select distinct doc_id, text from documents where text is not null) lateral view posexplode(split(trim(text), r'\\n[ \\t\\r]*\\n')) p as pos, col)"
    else:
        blocks = "blocks as (select doc_id, unnest(range(len(b))) as pos, unnest(b) as body from (select distinct doc_id, string_split_regex(trim(text), '\\n[ \\t\\r]*\\n') as b from documents where text is not null))"
    number = f"lpad(cast(row_number() over (partition by doc_id order by pos) as {d.text}), 3, '0')"
    return f"with {blocks}, n as (select doc_id, pos, cast({d.size}({tokens(d, 'body')}) as bigint) as n_tokens from blocks) select doc_id, concat('p', {number}) as number, n_tokens from n where n_tokens >= 24"


def j01_overlap(d: Spark) -> str:
    """Paragraph texts with a shingle similarity of 0.35 or more in different documents, not both manuscripts.

    One row per pair of different shingle sets, named by their least paragraph, or per set that stands in several documents.
    Only the rarest shingles of a set are joined (a set similar to another must share one of them), so frequent
    shingles meet no one; the similarity is then exact.
    """
    keep = "n - ceil(0.35 * n) + 1"
    if d.spark:
        sets = "sets as (select paragraph_id, array_sort(collect_list(xxhash64(sh))) as s from shingles group by paragraph_id)"
        key, common = "xxhash64(s)", "size(array_intersect(a.s, b.s))"
        each = "each_ as (select c, n, explode(s) as sh from classes)"
    else:
        sets = "sets as (select paragraph_id, list(sh order by sh) as s from shingles group by paragraph_id)"
        key, common = "s", "len(list_intersect(a.s, b.s))"
        each = "each_ as (select c, n, unnest(s) as sh from classes)"
    cross = "(a.nm_lo is not null and not (a.nm_lo = a.nm_hi and b.lo = b.hi and a.nm_lo = b.lo))"
    back = "(b.nm_lo is not null and not (b.nm_lo = b.nm_hi and a.lo = a.hi and b.nm_lo = a.lo))"
    nm = "case when category is null or category <> 'manuscript' then doc_id end"
    return f"""with {latest_paragraphs(d)}, {_shingles(d)}, {sets},
own as (select sets.paragraph_id, s, doc_id, {nm} as nm from sets join paras on paras.paragraph_id = sets.paragraph_id),
classes as (select {key} as c, any_value(s) as s, min({d.size}(s)) as n, min(paragraph_id) as id, count(*) as members, min(doc_id) as lo, max(doc_id) as hi, min(nm) as nm_lo, max(nm) as nm_hi from own group by {key}),
{each}, df as (select sh, count(*) as df from each_ group by sh having count(*) > 1),
ranked as (select each_.c, n, each_.sh, row_number() over (partition by each_.c order by coalesce(df, 1), each_.sh) as k from each_ left join df on df.sh = each_.sh),
rare as (select c, n, sh from ranked where k <= {keep}),
cand as (select distinct a.c as ca, b.c as cb from rare a join rare b on a.sh = b.sh and a.n <= b.n and a.n >= 0.35 * b.n where a.c <> b.c),
scored as (select least(a.id, b.id) as left_id, greatest(a.id, b.id) as right_id, {common} / (a.n + b.n - {common}) as j from cand join classes a on a.c = ca join classes b on b.c = cb where {cross} or {back})
select distinct left_id, right_id, round(j, 6) as similarity from scored where j >= 0.35
union all select id, id, 1.0 from classes where members > 1 and lo < hi and nm_lo is not null"""


def _anchor(d: Spark) -> str:
    """The first twelve tokens of the first sentence that has as many, else of the whole text."""
    sentences = d.split("text", "[.!?]+[ \\n]+" if d.spark else "[.!?]+[ \\n]+")
    long_ = f"{d.filter}({d.transform}({sentences}, {d.fn('s', tokens(d, 's'))}), {d.fn('t', f'{d.size}(t) >= 12')})"
    first = f"coalesce({d.at(long_, '1')}, {tokens(d)})"
    cut = f"slice({first}, 1, 12)" if d.spark else f"({first})[1:12]"
    return d.join(cut, " ")


def sc40_anchor_phrase(d: Spark) -> str:
    return f"with {latest_paragraphs(d)} select paragraph_id, {_anchor(d)} as phrase from paras where text is not null"


def t02_query_paragraphs(d: Spark) -> str:
    """The six paragraphs of each package that a phrase search asks for first."""
    rank = "case section when 'results' then 0 when 'abstract' then 1 when 'conclusion' then 2 when 'discussion' then 3 when 'methods' then 5 when 'introduction' then 6 else 4 end"
    return f"""with {latest_paragraphs(d)}, r as (select package_root, paragraph_id, section, row_number() over (partition by package_root order by {rank}, path, paragraph_id) as k from paras where text is not null)
select package_root, paragraph_id, section, cast(k as bigint) as k from r where k <= 6"""


def x01_phrase_search(d: Spark) -> str:
    """Evaluation items whose anchor phrase stands in a document: all 12-token windows meet the few phrases by equality."""
    if d.spark:
        words = "words as (select doc_id, pos, col as w from (select distinct doc_id, regexp_extract_all(lower(text), '[a-z0-9]+', 0) as t from documents where text is not null) lateral view posexplode(t) p as pos, col)"
        parts = ", ".join(["w", *[f"lead(w, {k}) over s" for k in range(1, 12)]])
        runs = f"runs as (select doc_id, concat_ws(' ', {parts}) as phrase, lead(w, 11) over s as last_ from words window s as (partition by doc_id order by pos))"
    else:
        words = "toks as (select distinct doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents where text is not null)"
        runs = "runs as (select doc_id, array_to_string(t[i:i+11], ' ') as phrase, 1 as last_ from (select doc_id, t, unnest(range(1, len(t) - 10)) as i from toks where len(t) >= 12))"
    return f"with {words}, {runs}, q as (select item_id, {_anchor(d)} as phrase from eval_items) select distinct doc_id, item_id from runs join q on q.phrase = runs.phrase where last_ is not null"


QUERIES, SQL = both([sc30_normal_space, sc31_tokens, sc32_shingles, sc33_sections, sc34_split_paragraphs, j01_overlap, sc40_anchor_phrase, t02_query_paragraphs, x01_phrase_search])


# From here on the queries are operators over DataFrames, and their SQL is written apart.


def one_paragraph(spark: SparkSession, d: str) -> DataFrame:
    """One row per paragraph_id; repeats differ in nulls only."""
    cols = ("doc_id", "package_root", "path", "category", "section", "text")
    return table(spark, d, "paragraphs").groupBy("paragraph_id").agg(*[F.max(c).alias(c) for c in cols])


def sc30_normal_space(spark: SparkSession, d: str) -> DataFrame:
    return one_paragraph(spark, d).where("text is not null").select("paragraph_id", T.normal_space(F.col("text")).alias("text"))


def sc38_disclosure(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of each category that disclose earlier work."""
    rows = one_paragraph(spark, d).where("text is not null")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(T.discloses(F.col("text"))).alias("disclosed"))


def overlap_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of paragraphs with what they are candidates of: (left_id, right_id, similarity, kind, risk, tags)."""
    sides = one_paragraph(spark, d).select("paragraph_id", "section", "category", "text")
    side = lambda name: sides.toDF(f"{name}_id", f"{name}_section", f"{name}_category", f"{name}_text")
    pairs = QUERIES["j01_overlap"](spark, d).join(side("left"), "left_id").join(side("right"), "right_id")
    return T.classify_overlap(pairs).select("left_id", "right_id", F.col("similarity").cast("double").alias("similarity"), "kind", "risk", "tags")


def sc39_classify_overlap(spark: SparkSession, d: str) -> DataFrame:
    return overlap_candidates(spark, d).withColumn("tags", F.array_join("tags", ","))


def sc37_overlap_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first five shared shingles of each overlap of two paragraphs."""
    sets = table(spark, d, "paragraphs").where("text is not null").groupBy("paragraph_id").agg(F.max("text").alias("text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    place = sets.select("paragraph_id", F.posexplode(words).alias("pos", "w"))
    after = Window.partitionBy("paragraph_id").orderBy("pos")
    run = place.select("paragraph_id", F.concat_ws(" ", "w", *[F.lead("w", k).over(after) for k in range(1, 5)]).alias("sh"), F.lead("w", 4).over(after).alias("last_")).where("last_ is not null")
    bags = run.groupBy("paragraph_id").agg(F.collect_set("sh").alias("bag"))  # bounded by a paragraph
    pairs = QUERIES["j01_overlap"](spark, d).where("left_id <> right_id").join(bags.toDF("left_id", "a"), "left_id").join(bags.toDF("right_id", "b"), "right_id")
    return pairs.select("left_id", "right_id", F.array_join(T.overlap_examples(F.col("a"), F.col("b")), " | ").alias("examples"))


def sc43_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, words, placeholders, figures and references of each document (A-35)."""
    r = T.readiness(table(spark, d, "documents"), "doc_id")
    joined = lambda c: F.array_join(c, "|").alias(c)
    return r.select("doc_id", "n_sentences", "n_long", "n_words", joined("placeholders"), joined("figure_refs"), "has_references", joined("dois"), "language_status", "reference_status")


def sc44_dois(spark: SparkSession, d: str) -> DataFrame:
    """DOIs in claims' texts and in paragraphs, each once per row, with how many rows name it."""
    texts = table(spark, d, "paragraphs").select("text").union(table(spark, d, "claim_manifest").select("claim_text")).union(table(spark, d, "documents").select("text"))
    found = texts.where("text is not null").distinct().select(F.explode(T.dois(F.col("text"))).alias("doi"))
    return found.groupBy("doi").agg(F.count("*").alias("n"))


QUERIES |= {f.__name__: f for f in (sc30_normal_space, sc37_overlap_examples, sc38_disclosure, sc39_classify_overlap, sc43_readiness, sc44_dois)}

_PARAS = latest_paragraphs(DUCK)
_DISCLOSES = r"""regexp_matches({0}, '(?i)(\bpreprint\b|\bthesis\b|\bdisclos[A-Za-z0-9_]*\b|\bderived from\b|\badapted from\b|\breproduced from\b)')"""
_WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\p{Z}]"
_DOIS = r"""list_transform(regexp_extract_all({0}, '(?i)\b10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+'), lambda x: lower(rtrim(x, '.,;:)］】')))"""
#: Each once, in order of the first place.
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
SQL |= {
    "sc30_normal_space": rf"with {_PARAS} select paragraph_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) as text from paras where text is not null",
    "sc38_disclosure": f"with {_PARAS} select category, count(*) as n, count(*) filter ({_DISCLOSES.format('text')}) as disclosed from paras where text is not null group by category",
    "sc39_classify_overlap": f"""with o as ({SQL["j01_overlap"]}), {_PARAS},
p as (select left_id, right_id, similarity, [l.section, r.section] as s, [l.category, r.category] as c, {_DISCLOSES.format("concat(coalesce(l.text, ''), chr(10), coalesce(r.text, ''))")} as told
 from o join paras l on l.paragraph_id = left_id join paras r on r.paragraph_id = right_id),
k as (select *, case when list_contains(s, 'methods') then 1 when told and list_has_any(c, ['thesis', 'preprints', 'preprint']) then 2
 when list_contains(s, 'results') and similarity >= 0.45 and not told then 3 when list_has_any(s, ['abstract', 'conclusion']) and similarity >= 0.5 and not told then 4 else 5 end as k from p)
select left_id, right_id, similarity::double as similarity, ['methods_boilerplate_overlap', 'self_overlap_candidate', 'text_overlap_candidate', 'text_overlap_candidate', 'text_overlap_candidate'][k] as kind,
 ['R2_max', 'R2_max', 'R3_possible', 'R3_possible', 'R2_possible'][k] as risk,
 concat('text_overlap_candidate', [',methods_boilerplate_overlap', ',self_overlap_candidate,disclosed_prior_text_overlap', ',results_text_overlap', ',abstract_conclusion_overlap', ''][k]) as tags from k""",
    "sc37_overlap_examples": f"""with o as ({SQL["j01_overlap"]}), t as (select paragraph_id, regexp_extract_all(lower(max(text)), '[a-z0-9]+') as t from paragraphs where text is not null group by 1),
b as (select paragraph_id, list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) as bag from t where len(t) >= 5)
select left_id, right_id, array_to_string(list_sort(list_intersect(x.bag, y.bag))[1:5], ' | ') as examples from o join b x on x.paragraph_id = left_id join b y on y.paragraph_id = right_id where left_id <> right_id""",
    "sc43_readiness": rf"""with t as (select distinct doc_id, text from documents where doc_id is not null and text is not null),
s as (select *, regexp_extract(text, '(?ims)^{_WS}*(?:references|bibliography){_WS}*$(.*)', 1) as section,
 list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+|[一-鿿]'))), lambda n: n > 0) as lengths from t),
m as (select *, list_sort(list_distinct(regexp_extract_all(text, '(?i)\b(TODO|TBD|XXX|INSERT|PLACEHOLDER|AUTHOR QUERY)\b'))) as holders,
 list_sort(list_distinct(regexp_extract_all(text, '(?i)\b(?:Fig\.?|Figure)[ \t\r\n]+([A-Za-z0-9]+)', 1))) as figs, {_DOIS.format("case when section <> '' then section else text end")} as found from s)
select doc_id, len(lengths) as n_sentences, len(list_filter(lengths, lambda n: n >= 45)) as n_long, coalesce(list_sum(lengths), 0)::bigint as n_words, array_to_string(holders, '|') as placeholders, array_to_string(figs, '|') as figure_refs,
 section <> '' as has_references, array_to_string({_ONCE.format("found")}, '|') as dois,
 case when len(list_filter(lengths, lambda n: n >= 45)) > 0 or len(holders) > 0 then 'needs_attention' else 'ready_for_manual_review' end as language_status,
 case when len(found) = 0 then 'needs_attention' else 'ready_for_manual_review' end as reference_status from m""",
    "sc44_dois": f"""with t as (select text from paragraphs union select claim_text from claim_manifest union select text from documents), f as (select list_distinct({_DOIS.format("text")}) as found from t where text is not null)
select doi, count(*) as n from (select unnest(found) as doi from f) group by doi""",
}
