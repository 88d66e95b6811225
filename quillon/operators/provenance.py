"""Where figures come from: declared links, what similar files mean in the light of them, and what the texts disclose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.paths import base_name, references, strip
from quillon.operators.snapshots import listing

#: Kinds of panels and their other names; kinds that aren't scanned.
MODALITIES = ("microscopy", "western_blot", "chart", "schematic", "other")
ALIASES = {
    "blot": "western_blot", "gel": "western_blot", "western blot": "western_blot", "wb": "western_blot", "image": "other", "photo": "other", "table": "chart", "graph": "chart",
    "plot": "chart", "bar chart": "chart", "line chart": "chart", "diagram": "schematic", "flowchart": "schematic", "flow chart": "schematic", "icon": "schematic",
}
UNSCANNED = ("chart", "schematic")
#: Relations a link may state, and those that explain a figure from a source or from another figure.
RELATIONS = ("declared_derived_from", "same_field_different_channel", "same_membrane_reprobe", "declared_same_source")
SOURCE_RELATIONS = ("declared_derived_from", "declared_same_source", "same_membrane_reprobe")
FIGURE_RELATIONS = ("same_field_different_channel", "same_membrane_reprobe")
#: What discloses a reuse, a control, a shared membrane, and what denies it.
REUSE = r"\bdisclos\w*\b.{0,80}\breus\w*\b|\breus\w*\b.{0,80}\bdisclos\w*\b|\bintentionally reused\b|\bsame loading control\b|\bsame gapdh loading control\b|\bloading control was reused\b|\bsame membrane\b|\breprobed\b"
SAME = r"\breus\w*\b|\bsame\b"
MEMBRANE = r"\bsame membrane\b|\bshared membrane\b|\bmembrane was reprobed\b|\breprobed\b"
EXPERIMENT = r"\bsame experiment\b|\bsame membrane\b|\bshared membrane\b|\breprobed\b"
DENIED = r"does not state.{0,80}same membrane|not state.{0,80}same membrane|no shared membrane|no same membrane|without.{0,80}same membrane"
#: Tags of similar pairs, candidates that they make, and the risk suggested, the first one found counts.
CANDIDATES = (
    ("declared_local_patch_requires_verification", "local_patch_reuse", "R1_max"),
    ("local_patch_cross_context", "local_patch_reuse", "R3_possible"),
    ("same_image_copy_move", "same_image_copy_move", "R3_possible"),
    ("manifest_conflict", "image_reuse_cluster", "R3_possible"),
    ("cross_context_reuse_candidate", "image_reuse_cluster", "R3_possible"),
    ("disclosed_unjustified_reuse", "image_reuse_cluster", "R3_possible"),
    ("disclosed_legitimate_reuse", "image_reuse_cluster", "R3_possible_pending_context"),
    ("unresolved_fig_raw_similarity", "unresolved_fig_raw_similarity", "R1_max"),
    ("unresolved_similarity", "image_similarity_candidate", "R2_or_R3_pending_context"),
)
REUSE_TAGS = tuple(t for t, _, _ in CANDIDATES[:7])
RADIUS = 500


def role(path: Column) -> Column:
    return F.when(path.startswith("figures/"), "figure_panel").when(path.startswith("raw_images/"), "raw_image").when(path.startswith("source_data/"), "source_data").otherwise("resource")


def normal_modality(c: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[_ -]+", " "))
    names = {m.replace("_", " "): m for m in MODALITIES} | ALIASES
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), bare), F.lit("other"))


def last_files(manifest: DataFrame) -> DataFrame:
    """(package_root, path) of each package's last snapshot."""
    files = listing(manifest)
    last = files.groupBy("package_root").agg(F.max("snapshot_no").alias("snapshot_no"))
    return files.join(last, ["package_root", "snapshot_no"]).select("package_root", "path")


def resolve(rows: DataFrame, column: str, files: DataFrame) -> DataFrame:
    """The rows with ``column`` replaced by the file of their package that it names: by full path, else by file name (the least path of that
    name), else itself if it has a folder; null otherwise. Punctuation around it is dropped."""
    token = F.lower(F.regexp_replace(F.translate(strip(F.col(column)), "\\", "/"), r"""^[.,;:()\[\]{}"']+|[.,;:()\[\]{}"']+$""", ""))
    keyed = rows.withColumn("token_", token).withColumn("name_", base_name(F.col("token_")))
    whole = files.select("package_root", F.col("path").alias("token_"), F.col("path").alias("by_path_")).distinct()
    named = files.groupBy("package_root", base_name(F.col("path")).alias("name_")).agg(F.min("path").alias("by_name_"))
    found = keyed.join(whole, ["package_root", "token_"], "left").join(named, ["package_root", "name_"], "left")
    return found.withColumn(column, F.coalesce("by_path_", "by_name_", F.when(F.col("token_").contains("/"), F.col("token_")))).select(*rows.columns)


def structured_links(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(row_id, package_root, figure, source, relation, modality, effect, confidence) of the links that manifest rows declare, a row for each figure and source named.

    ``rows`` has (row_id, package_root, figure_panel, source_record, relation_type, modality). A relation that isn't known gives
    the effect ``unsupported_relation``, which is a warning. Rows without a resolved figure and source, and links that aren't from a figure to a raw image, source
    table or, where stated, another figure, give nothing.
    """
    each = lambda c: F.explode(F.array_distinct(references(F.col(c))))
    ends = rows.where("package_root is not null").withColumn("figure", each("figure_panel")).withColumn("source", each("source_record"))
    relation = F.lower(strip(F.coalesce(F.nullif(strip(F.col("relation_type")), F.lit("")), F.lit("declared_derived_from"))))
    ends = ends.select("row_id", "package_root", "figure", "source", relation.alias("relation"), normal_modality(F.col("modality")).alias("modality"))
    found = resolve(resolve(ends, "figure", files), "source", files).where("figure is not null and source is not null")
    to, known = role(F.col("source")), F.col("relation").isin(*RELATIONS)
    effect = (
        F.when(~known, "unsupported_relation").when(role(F.col("figure")) != "figure_panel", None).when(to.isin("raw_image", "source_data"), "expected_traceability")
        .when((to == "figure_panel") & F.col("relation").isin(*FIGURE_RELATIONS), "expected_traceability").when(to == "figure_panel", "candidate_traceability")
    )
    named = found.withColumn("effect", effect).where("effect is not null")
    confidence = F.when(F.col("effect") == "expected_traceability", 0.98).when(F.col("effect") == "candidate_traceability", 0.5).otherwise(0.0)
    return named.withColumn("confidence", confidence).distinct()


def authoritative(links: DataFrame) -> DataFrame:
    """The links that settle where a figure comes from."""
    roles = F.array_sort(F.array(role(F.col("figure")), role(F.col("source"))))
    to_source = (roles == F.array(F.lit("figure_panel"), F.lit("raw_image"))) | (roles == F.array(F.lit("figure_panel"), F.lit("source_data")))
    to_figure = roles == F.array(F.lit("figure_panel"), F.lit("figure_panel"))
    relation = F.col("relation")
    good = (to_source & relation.isin(*SOURCE_RELATIONS)) | (to_figure & relation.isin(*FIGURE_RELATIONS))
    return links.where((F.col("effect") == "expected_traceability") & (F.col("figure") != F.col("source")) & good)


def prose_links(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(package_root, file, line_no, figure, source): figures and sources named on one line of a manifest in prose; ``lines`` has (package_root, file, line_no, line).

    Only for files of packages without a structured manifest; see ordered_mappings() for lists in prose, which link nothing.
    """
    named = lines.withColumn("token", F.explode(F.regexp_extract_all("line", F.lit(r"[A-Za-z0-9_./\\-]+\.(?:png|jpe?g|tiff?|pdf|svg|csv|tsv|xlsx?|czi|nd2|lif)\b"), F.lit(0))))
    found = resolve(named.select("package_root", "file", "line_no", "token"), "token", files).where("token is not null").distinct()
    side = lambda name, *roles: found.where(role(F.col("token")).isin(*roles)).withColumnRenamed("token", name)
    return side("figure", "figure_panel").join(side("source", "raw_image", "source_data"), ["package_root", "file", "line_no"])


def ordered_mappings(texts: DataFrame) -> DataFrame:
    """(package_root, file) of manifests in prose that map lists of figures to lists of sources: a warning."""
    return texts.where(F.lower("text").rlike("figure panels map to|figures map to")).select("package_root", "file").distinct()


def routing(links: DataFrame) -> DataFrame:
    """(package_root, figure, modalities, route) by the declared kinds of each panel: ``exclude`` if only charts and schematics, ``conflict`` if mixed, else ``scan``."""
    panels = authoritative(links).where(F.col("figure").startswith("figures/")).groupBy("package_root", "figure").agg(F.array_sort(F.collect_set("modality")).alias("modalities"))
    drawn = F.exists("modalities", lambda m: m.isin(*UNSCANNED))
    shot = F.exists("modalities", lambda m: ~m.isin(*UNSCANNED))
    return panels.withColumn("route", F.when(drawn & shot, "conflict").when(drawn, "exclude").otherwise("scan"))


def aliases(path: Column) -> Column:
    """What a text may call a file: its path, its name without suffix, that with blanks, and the figure's number."""
    stem = F.lower(F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", ""))
    panel = F.regexp_extract(stem, r"(?:figure|fig)[ _-]*([0-9]+[a-z]?)", 1)
    every = F.array(F.lower(path), stem, F.translate(stem, "_-", "  "), *[F.when(panel != "", F.concat(F.lit(p), panel)) for p in ("figure ", "fig ", "")])
    return F.array_distinct(F.filter(every, lambda a: a.isNotNull() & (a != "")))


def positions(text: Column, alias: Column) -> Column:
    """Where, from 0, an alias stands in a text; places don't overlap."""
    parts = F.split(text, F.concat(F.lit("\\Q"), alias, F.lit("\\E")))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda a, p: a + F.length(p)) + (k - 1) * F.length(alias))
    return F.slice(ends, 1, F.size(parts) - 1)


def disclosures(edges: DataFrame, texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(package_root, edge_id, window): of each edge whose ends are named within ``radius`` characters of each other in one text, around which a reuse is
    disclosed, the window of the first such place (by text, place of the left and of the right end).

    ``edges`` has (package_root, edge_id, left, right), ``texts`` (package_root, segment, text). Only texts that disclose anything are looked into.
    """
    telling = texts.select("package_root", "segment", F.lower("text").alias("text")).where(F.col("text").rlike(f"(?s){REUSE}")).distinct()
    at = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(aliases(F.col(c)), lambda a: positions(F.col("text"), a)))))
    named = edges.select("package_root", "edge_id", "left", "right").join(telling, "package_root").withColumn("l", at("left")).withColumn("r", at("right"))

    def window(a: Column, b: Column) -> Column:
        first = F.greatest(F.least(a, b) - radius, F.lit(0))
        return F.substring(F.col("text"), first + 1, F.greatest(a, b) + radius - first)

    near = F.flatten(F.transform("l", lambda a: F.transform(F.filter("r", lambda b: F.abs(a - b) <= radius), lambda b: window(a, b))))
    found = named.withColumn("windows", F.filter(near, lambda w: w.rlike(REUSE))).where(F.size("windows") > 0)
    return found.groupBy("package_root", "edge_id").agg(F.min_by(F.col("windows")[0], "segment").alias("window"))


def contexts(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(package_root, reuse_disclosed, loading_control, same_membrane, same_experiment, source_available, raw_available, tag) of each package with files."""
    low = F.lower("text")
    says = lambda p, name: F.coalesce(F.bool_or(low.rlike(p)), F.lit(False)).alias(name)
    told = texts.where("package_root is not null and text is not null").groupBy("package_root").agg(
        says(REUSE, "reuse"), says("loading control", "control"), says(SAME, "same"), says(DENIED, "denied"), says(MEMBRANE, "membrane"), says(EXPERIMENT, "experiment")
    )
    tables, images = F.col("path").rlike(r"^source_data/.*\.(csv|tsv|xlsx|xls)$"), F.col("path").rlike(r"^raw_images/.*\.(tif|tiff|czi|nd2|lif|oib|oir|svs|vsi|png|jpg|jpeg)$")
    held = files.groupBy("package_root").agg(F.bool_or(tables).alias("source_available"), F.bool_or(images).alias("raw_available"))
    c = held.join(told, "package_root", "left").fillna(False)
    denied = F.col("denied")
    out = c.select(
        "package_root", F.col("reuse").alias("reuse_disclosed"), (F.col("control") & F.col("same")).alias("loading_control"), (~denied & F.col("membrane")).alias("same_membrane"),
        (~denied & F.col("experiment")).alias("same_experiment"), "source_available", "raw_available",
    )
    legitimate = F.expr("reuse_disclosed and loading_control and (same_membrane or same_experiment) and (source_available or raw_available)")
    return out.withColumn("tag", F.when(legitimate, "disclosed_legitimate_reuse").when(F.col("reuse_disclosed"), "disclosed_unjustified_reuse"))


def classify_edges(edges: DataFrame, links: DataFrame, disclosed: DataFrame, context: DataFrame) -> DataFrame:
    """The edges with ``tag`` and ``reportable``: what a pair of similar files means.

    ``edges`` has (package_root, edge_id, left, right, scope): scope is ``global`` or ``local_patch``. ``links`` are structured_links(), ``disclosed`` disclosures(), ``context`` contexts().
    """
    ordered = lambda a, b: (F.least(a, b).alias("lo_"), F.greatest(a, b).alias("hi_"))
    declared = authoritative(links).select("package_root", *ordered("figure", "source"), F.lit(True).alias("declared")).distinct()
    e = edges.withColumns({"lo_": F.least("left", "right"), "hi_": F.greatest("left", "right")}).join(declared, ["package_root", "lo_", "hi_"], "left")
    e = e.join(disclosed, ["package_root", "edge_id"], "left").join(context.select("package_root", "source_available", "raw_available"), "package_root", "left")
    a, b, local, told = role(F.col("left")), role(F.col("right")), F.col("scope") == "local_patch", F.col("window")
    figures, available = (a == "figure_panel") & (b == "figure_panel"), F.coalesce(F.expr("source_available or raw_available"), F.lit(False))
    explained = (told.contains("loading control") & told.rlike(SAME)) | told.rlike(MEMBRANE)
    mixed = ((a == "figure_panel") & (b == "raw_image")) | ((a == "raw_image") & (b == "figure_panel"))
    tag = (
        F.when((F.col("left") == F.col("right")) & local, "same_image_copy_move")
        .when(F.col("declared") & figures & local, "declared_local_patch_requires_verification").when(F.col("declared") & figures, "manifest_conflict")
        .when(F.col("declared"), "expected_traceability").when(mixed, "unresolved_fig_raw_similarity")
        .when(figures & explained & available, "disclosed_legitimate_reuse").when(figures & told.isNotNull(), "disclosed_unjustified_reuse")
        .when(figures & local, "local_patch_cross_context").when(figures, "cross_context_reuse_candidate").otherwise("unresolved_similarity")
    )
    return e.select(*edges.columns, tag.alias("tag")).withColumn("reportable", F.col("tag") != "expected_traceability")


def cluster_edges(classified: DataFrame, cluster: list[str]) -> DataFrame:
    """Of each cluster the edges that show a reuse, or if it has none all that are reportable."""
    shows = F.col("tag").isin(*REUSE_TAGS)
    any_ = classified.where(shows).select(*cluster).distinct().withColumn("any_", F.lit(True))
    return classified.where("reportable").join(any_, cluster, "left").where(F.col("any_").isNull() | shows).select(*classified.columns)


def candidates(classified: DataFrame, cluster: list[str]) -> DataFrame:
    """(cluster, kind, risk, tags, n_edges, n_positive): the candidate each cluster's edges make; clusters without a reportable edge make none."""
    chosen = cluster_edges(classified, cluster).groupBy(*cluster).agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.count("*").alias("n_edges"))
    kind = risk = F.lit(None).cast("string")
    for tag, k, r in reversed(CANDIDATES):
        has = F.array_contains("tags", tag)
        kind, risk = F.when(has, k).otherwise(kind), F.when(has, r).otherwise(risk)
    positive = classified.where("not reportable").groupBy(*cluster).agg(F.count("*").alias("n_positive"))
    out = chosen.select(*cluster, kind.alias("kind"), risk.alias("risk"), "tags", "n_edges").join(positive, cluster, "left")
    return out.withColumn("n_positive", F.coalesce("n_positive", F.lit(0).cast("bigint")))


def is_image_candidate(detector: Column, kind: Column) -> Column:
    """Whether a candidate is judged by its edges; gaps and failures pass as they are."""
    return ~kind.isin("audit_coverage_gap", "detector_execution_failure") & F.concat_ws(" ", detector, kind).contains("image")


def positive_rows(classified: DataFrame) -> DataFrame:
    """(package_root, provenance_id, figure_panel, source_record) of the pairs that their links explain, numbered within a package."""
    turned = (role(F.col("left")) != "figure_panel") & (role(F.col("right")) == "figure_panel")
    rows = classified.where("tag = 'expected_traceability'").select(
        "package_root", F.when(turned, F.col("right")).otherwise(F.col("left")).alias("figure_panel"), F.when(turned, F.col("left")).otherwise(F.col("right")).alias("source_record")
    ).distinct()
    number = F.row_number().over(Window.partitionBy("package_root").orderBy("figure_panel", "source_record"))
    return rows.select("package_root", F.format_string("PROV-%04d", number).alias("provenance_id"), "figure_panel", "source_record")

