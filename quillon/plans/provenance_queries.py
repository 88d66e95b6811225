"""Provenance over the manifests: links, routing, similar files in context. Their SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import provenance as P
from quillon.plans.dialect import DUCK
from quillon.plans.package_queries import _files, _links, _path, _pieces
from quillon.session import table

KEY = r"(?:fig(?:ure)?|supp(?:lementary)?|s)[_ .-]*([0-9]+|[ivx]+)([a-z])?"


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each row of the assembly manifest once, its latest delivery."""
    cols = ["package_root", "figure_panel", "source_record", "relation_type", "modality"]
    rows = table(spark, d, "assembly_manifest").where("row_id is not null")
    return rows.groupBy("row_id").agg(F.max(F.struct("ingested_at", *cols)).alias("r")).select("row_id", *[f"r.{c}" for c in cols])


def files(spark: SparkSession, d: str) -> DataFrame:
    return P.last_files(table(spark, d, "file_hash_manifest"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return P.structured_links(manifest_rows(spark, d), files(spark, d))


def similar_files(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that stand for similar images here: the first figure of a package with a figure's number, and each other figure, raw image or source of that number."""
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    number = F.nullif(F.concat(F.regexp_extract(stem, KEY, 1), F.regexp_extract(stem, KEY, 2)), F.lit(""))
    keyed = files(spark, d).where(P.role(F.col("path")) != "resource").withColumn("figure_key", number).where("figure_key is not null")
    first = keyed.where(P.role(F.col("path")) == "figure_panel").groupBy("package_root", "figure_key").agg(F.min("path").alias("left"))
    pairs = keyed.join(first, ["package_root", "figure_key"]).where("path <> left")
    scope = F.when(F.length("path") % 2 == 0, "global").otherwise("local_patch")
    return pairs.select("package_root", "figure_key", F.concat_ws("~", "left", "path").alias("edge_id"), "left", F.col("path").alias("right"), scope.alias("scope"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("package_root is not null and text is not null").select("package_root", F.col("path").alias("segment"), "text")


def classified(spark: SparkSession, d: str) -> DataFrame:
    edges = similar_files(spark, d)
    return P.classify_edges(edges, links(spark, d), P.disclosures(edges, texts(spark, d)), P.contexts(texts(spark, d), files(spark, d)))


def prov01_link_validation(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).select("row_id", "figure", "source", "relation", "modality", "effect", "confidence")


def prov03_graph(spark: SparkSession, d: str) -> DataFrame:
    """The edges of each package's graph: distinct links whose ends are files of the package."""
    f = files(spark, d)
    node = lambda name: f.toDF("package_root", name)
    e = links(spark, d).where("effect <> 'unsupported_relation'").select("package_root", "figure", "source", "relation").distinct()
    return e.join(node("figure"), ["package_root", "figure"], "left_semi").join(node("source"), ["package_root", "source"], "left_semi").select("package_root", "figure", "source", "relation")


def prov05_modality_routing(spark: SparkSession, d: str) -> DataFrame:
    return P.routing(links(spark, d)).withColumn("modalities", F.array_join("modalities", ","))


def prov06_contexts(spark: SparkSession, d: str) -> DataFrame:
    return P.contexts(texts(spark, d), files(spark, d))


def prov07_edge_classes(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("package_root", "edge_id", "tag", "reportable")


def prov08_cluster_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.cluster_edges(classified(spark, d), ["package_root", "figure_key"]).select("package_root", "figure_key", "edge_id", "tag")


def prov09_candidates(spark: SparkSession, d: str) -> DataFrame:
    return P.candidates(classified(spark, d), ["package_root", "figure_key"]).withColumn("tags", F.array_join("tags", ","))


def prov11_positive(spark: SparkSession, d: str) -> DataFrame:
    return P.positive_rows(classified(spark, d))


def j12_disclosure_window(spark: SparkSession, d: str) -> DataFrame:
    """Similar figures whose reuse a text of the package discloses where it names both."""
    return P.disclosures(similar_files(spark, d), texts(spark, d)).select("package_root", "edge_id", F.length("window").cast("bigint").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        prov01_link_validation, prov03_graph, prov05_modality_routing, prov06_contexts, prov07_edge_classes, prov08_cluster_edges, prov09_candidates, prov11_positive, j12_disclosure_window,
    )
}

_TOKEN = r"""lower(regexp_replace(replace({0}, '\', '/'), '^[.,;:()\[\]{{}}"'']+|[.,;:()\[\]{{}}"'']+$', '', 'g'))"""
_ROLE = "case split_part({0}, '/', 1) when 'figures' then 'figure_panel' when 'raw_images' then 'raw_image' when 'source_data' then 'source_data' else 'resource' end"


def _every(field: str) -> str:
    return f"unnest(list_distinct(list_transform({_pieces(DUCK, field)}, lambda x: {_path(DUCK, 'x')})))"


_MODALITY = "case m " + " ".join(f"when '{a}' then '{b}'" for a, b in ({m.replace("_", " "): m for m in P.MODALITIES} | P.ALIASES).items()) + " else 'other' end"
_DECLARED = f"""{_files(DUCK)}, {_links(DUCK)},
fig as (select row_id, package_root, source_record, relation_type, modality, {_every("figure_panel")} as figure from links where package_root is not null),
src as (select * exclude (source_record), {_every("source_record")} as source from fig),
tok as (select row_id, package_root, {_TOKEN.format("figure")} as figure, {_TOKEN.format("source")} as source, lower(coalesce(nullif(trim(relation_type), ''), 'declared_derived_from')) as relation,
 trim(regexp_replace(lower(coalesce(modality, '')), '[_ -]+', ' ', 'g')) as m from src),
names as (select package_root, split_part(path, '/', -1) as name, min(path) as path from files group by 1, 2),
ends as (select row_id, t.package_root, relation, {_MODALITY} as modality, coalesce(a.path, b.path, case when contains(figure, '/') then figure end) as figure, coalesce(c.path, e.path, case when contains(source, '/') then source end) as source from tok t
 left join files a on a.package_root = t.package_root and a.path = figure left join names b on b.package_root = t.package_root and b.name = split_part(figure, '/', -1)
 left join files c on c.package_root = t.package_root and c.path = source left join names e on e.package_root = t.package_root and e.name = split_part(source, '/', -1)),
judged as (select distinct *, case when relation not in ('declared_derived_from', 'same_field_different_channel', 'same_membrane_reprobe', 'declared_same_source') then 'unsupported_relation'
 when figure not like 'figures/%' then null when source like 'raw\\_images/%' escape '\\' or source like 'source\\_data/%' escape '\\' then 'expected_traceability'
 when source like 'figures/%' then case when relation in ('same_field_different_channel', 'same_membrane_reprobe') then 'expected_traceability' else 'candidate_traceability' end end as effect from ends where figure is not null and source is not null),
declared as (select * from judged where effect is not null),
sure as (select * from declared where effect = 'expected_traceability' and figure <> source and case when source like 'figures/%' then relation <> 'declared_derived_from' and relation <> 'declared_same_source' else relation <> 'same_field_different_channel' end)""".replace("\\\\", "\\")
_SIMILAR = rf"""keyed as (select package_root, path, {_ROLE.format("path")} as role, concat(regexp_extract(stem, '{KEY}', 1), regexp_extract(stem, '{KEY}', 2)) as figure_key
 from (select *, regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '') as stem from files) where {_ROLE.format("path")} <> 'resource'),
firsts as (select package_root, figure_key, min(path) as l from keyed where role = 'figure_panel' and figure_key <> '' group by 1, 2),
edges as (select package_root, figure_key, concat(l, '~', path) as edge_id, l, path as r, role, case when length(path) % 2 = 0 then 'global' else 'local_patch' end as scope from keyed join firsts using (package_root, figure_key) where path <> l)"""
_RE = lambda p: "'(?s)" + p.replace("\\w", "[A-Za-z0-9_]") + "'"
_TELLING = f"telling as (select distinct package_root, path as segment, lower(text) as t from documents where package_root is not null and text is not null and regexp_matches(lower(text), {_RE(P.REUSE)}))"
_ALIAS = r"""list_filter(list_distinct([lower({0}), lower(regexp_replace(split_part({0}, '/', -1), '\.[^.]*$', '')), translate(lower(regexp_replace(split_part({0}, '/', -1), '\.[^.]*$', '')), '_-', '  '),
 'figure ' || nullif(regexp_extract({0}, '(?:figure|fig)[ _-]*([0-9]+[a-z]?)[^/]*$', 1), ''), 'fig ' || nullif(regexp_extract({0}, '(?:figure|fig)[ _-]*([0-9]+[a-z]?)[^/]*$', 1), ''), nullif(regexp_extract({0}, '(?:figure|fig)[ _-]*([0-9]+[a-z]?)[^/]*$', 1), '')]), lambda a: a is not null and a <> '')"""
_WINDOWS = f"""{_TELLING}, met as (select e.package_root, edge_id, segment, t, l, r from edges e join telling using (package_root)),
lpos as (select *, unnest({_ALIAS.format("l")}) as a from met), rpos as (select *, unnest({_ALIAS.format("r")}) as a from met),
lat as (select package_root, edge_id, segment, t, unnest(range(1, length(t) + 1)) as p, a from lpos where contains(t, a)), rat as (select package_root, edge_id, segment, unnest(range(1, length(t) + 1)) as p, t, a from rpos where contains(t, a)),
near as (select x.package_root, x.edge_id, x.segment, x.p as lp, y.p as rp, x.t[greatest(least(x.p, y.p) - 500, 1):greatest(x.p, y.p) + 499] as w from lat x join rat y on x.package_root = y.package_root and x.edge_id = y.edge_id and x.segment = y.segment and abs(x.p - y.p) <= 500
 where x.t[x.p:x.p + length(x.a) - 1] = x.a and y.t[y.p:y.p + length(y.a) - 1] = y.a),
windows as (select package_root, edge_id, min_by(w, (segment, lp, rp)) as w from near where regexp_matches(w, {_RE(P.REUSE)}) group by 1, 2)"""
_TOLD = lambda p: f"coalesce(bool_or(regexp_matches(lower(text), {_RE(p)})), false)"
_CONTEXT = rf"""told as (select package_root, {_TOLD(P.REUSE)} as reuse, {_TOLD("loading control")} as control, {_TOLD(P.SAME)} as same, {_TOLD(P.DENIED)} as denied, {_TOLD(P.MEMBRANE)} as membrane, {_TOLD(P.EXPERIMENT)} as experiment from documents group by 1),
held as (select package_root, bool_or(regexp_matches(path, '^source_data/.*\.(csv|tsv|xlsx|xls)$')) as source_available, bool_or(regexp_matches(path, '^raw_images/.*\.(tif|tiff|czi|nd2|lif|oib|oir|svs|vsi|png|jpg|jpeg)$')) as raw_available from files group by 1),
ctx as (select package_root, coalesce(reuse, false) as reuse_disclosed, coalesce(control and same, false) as loading_control, coalesce(membrane and not denied, false) as same_membrane, coalesce(experiment and not denied, false) as same_experiment, source_available, raw_available from held left join told using (package_root))"""
_CLASSED = f"""{_DECLARED}, {_SIMILAR}, {_WINDOWS}, {_CONTEXT}, pairs as (select distinct package_root, least(figure, source) as a, greatest(figure, source) as b from sure),
classed as (select e.*, case when p.a is not null and role = 'figure_panel' then case scope when 'local_patch' then 'declared_local_patch_requires_verification' else 'manifest_conflict' end
 when p.a is not null then 'expected_traceability' when role = 'raw_image' then 'unresolved_fig_raw_similarity' when role <> 'figure_panel' then 'unresolved_similarity'
 when w is not null then case when ((contains(w, 'loading control') and regexp_matches(w, {_RE(P.SAME)})) or regexp_matches(w, {_RE(P.MEMBRANE)})) and (source_available or raw_available) then 'disclosed_legitimate_reuse' else 'disclosed_unjustified_reuse' end
 when scope = 'local_patch' then 'local_patch_cross_context' else 'cross_context_reuse_candidate' end as tag
 from edges e left join pairs p on p.package_root = e.package_root and p.a = least(l, r) and p.b = greatest(l, r) left join windows v on v.package_root = e.package_root and v.edge_id = e.edge_id left join ctx c on c.package_root = e.package_root),
ranked as (select *, tag not in ('unresolved_fig_raw_similarity', 'unresolved_similarity', 'expected_traceability') as shows, bool_or(tag not in ('unresolved_fig_raw_similarity', 'unresolved_similarity', 'expected_traceability')) over (partition by package_root, figure_key) as any_ from classed),
chosen as (select * from ranked where tag <> 'expected_traceability' and (shows or not any_))"""
_NAMED = "case " + " ".join(f"when list_contains(tags, '{t}') then '{{}}'" for t, _, _ in P.CANDIDATES) + " end"
SQL = {
    "prov01_link_validation": f"with {_DECLARED} select row_id, figure, source, relation, modality, effect, case effect when 'expected_traceability' then 0.98 when 'candidate_traceability' then 0.5 else 0 end::double as confidence from declared",
    "prov03_graph": f"with {_DECLARED} select distinct d.package_root, figure, source, relation from declared d join files a on a.package_root = d.package_root and a.path = figure join files b on b.package_root = d.package_root and b.path = source where effect <> 'unsupported_relation'",
    "prov05_modality_routing": f"""with {_DECLARED}, p as (select package_root, figure, list_sort(list(distinct modality)) as ms from sure where figure like 'figures/%' group by 1, 2)
select package_root, figure, array_to_string(ms, ',') as modalities, case when len(list_intersect(ms, ['chart', 'schematic'])) = 0 then 'scan' when len(list_intersect(ms, ['chart', 'schematic'])) = len(ms) then 'exclude' else 'conflict' end as route from p""",
    "prov06_contexts": f"""with {_files(DUCK)}, {_CONTEXT} select *, case when reuse_disclosed and loading_control and (same_membrane or same_experiment) and (source_available or raw_available) then 'disclosed_legitimate_reuse'
 when reuse_disclosed then 'disclosed_unjustified_reuse' end as tag from ctx""",
    "prov07_edge_classes": f"with {_CLASSED} select package_root, edge_id, tag, tag <> 'expected_traceability' as reportable from classed",
    "prov08_cluster_edges": f"with {_CLASSED} select package_root, figure_key, edge_id, tag from chosen",
    "prov09_candidates": f"""with {_CLASSED}, g as (select package_root, figure_key, list_sort(list(distinct tag)) as tags, count(*) as n_edges from chosen group by 1, 2), pos as (select package_root, figure_key, count(*) as n from classed where tag = 'expected_traceability' group by 1, 2)
select package_root, figure_key, {_NAMED.format(*[k for _, k, _ in P.CANDIDATES])} as kind, {_NAMED.format(*[r for _, _, r in P.CANDIDATES])} as risk, array_to_string(tags, ',') as tags, n_edges, coalesce(n, 0) as n_positive from g left join pos using (package_root, figure_key)""",
    "prov11_positive": f"""with {_CLASSED} select package_root, 'PROV-' || lpad((row_number() over (partition by package_root order by l, r))::varchar, 4, '0') as provenance_id, l as figure_panel, r as source_record
 from (select distinct package_root, l, r from classed where tag = 'expected_traceability')""",
    "j12_disclosure_window": f"with {_files(DUCK)}, {_SIMILAR}, {_WINDOWS} select package_root, edge_id, length(w) as n_chars from windows",
}
