"""Package files, manifests, provenance, calibration of candidates and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillon.operators.provenance import ALIASES, MODALITIES
from quillon.plans.dialect import SPARK, Spark, both

#: Categories by keyword, with the suffixes they are limited to.
CATEGORY_RULES = [
    ("manuscript", "manuscript paper article maintext", ".pdf .docx .doc"),
    ("supplementary", "supp supplement supplementary appendix", None),
    ("source_data", "source sourcedata source-data data", ".csv .tsv .xlsx .xls"),
    ("figures", "fig figure panel", ".png .jpg .jpeg .tif .tiff .pdf .svg"),
    ("figure_assembly", "assembly figure fig", ".pptx .ppt .ai .psd .indd .svg"),
    ("raw_images", "raw original uncropped unprocessed czi nd2 lif", ".tif .tiff .czi .nd2 .lif .oib .oir .svs .vsi .png .jpg .jpeg"),
    ("protocols", "protocol method eln notebook samplemap sample_map batch", ".pdf .docx .doc .txt .md .csv .xlsx .xls"),
    ("statistics_code", "stats analysis code script prism graphpad", ".r .rmd .py .ipynb .m .sas .do .pzfx .csv .xlsx"),
    ("ethics_irb", "ethics irb iacuc approval consent", None),
    ("clinical_registration", "nct clinicaltrials chictr registry registration", None),
    ("omics_accession", "geo sra arrayexpress pride proteomexchange accession", None),
    ("flow_fcs", "flow fcs flowjo workspace gating", ".fcs .wsp .jo .pdf .png .tif .tiff"),
]
CATEGORIES = tuple(c for c, _, _ in CATEGORY_RULES)
ROLES = {"figures": "figure_panel", "raw_images": "raw_image", "source_data": "source_data", "figure_assembly": "assembly_file", "manuscript": "manuscript", "supplementary": "supplementary", "protocols": "protocol", "statistics_code": "analysis_code"}
NO_REFERENCE = ("", "na", "n/a", "none", "not_applicable", "not applicable", "-")
#: Categories that a package of a mode and of a domain is expected to have.
BASE_EXPECTED = {"internal": ("manuscript", "supplementary", "source_data", "figures"), "external": ("manuscript",)}
DOMAIN_EXPECTED = {
    "wetlab": ("raw_images", "figure_assembly"), "animal": ("protocols", "ethics_irb"), "cell": ("protocols",), "clinical": ("clinical_registration", "ethics_irb", "protocols"),
    "omics": ("omics_accession", "source_data", "statistics_code"), "flow": ("flow_fcs", "protocols"),
}


def expected_categories(mode: str, domains: tuple[str, ...] = ()) -> list[str]:
    """What a package should hold; an unknown mode counts as internal, an unknown domain adds nothing."""
    base = BASE_EXPECTED.get(mode, BASE_EXPECTED["internal"])
    return sorted({*base, *(c for d in domains for c in DOMAIN_EXPECTED.get(d.strip().lower(), ()))})


EXPECTED = tuple(expected_categories("internal", ("wetlab", "animal")))
#: Caps by tag; whether a contradiction tag lifts them.
CAPS = {
    **dict.fromkeys(("weak_forensic_triage_signal", "weak_statistical_signal", "weak_signal", "terminal_digit", "precision_mixing", "cross_file_sequence_reuse", "benford_style", "p_value_clustering", "methods_boilerplate_overlap", "disclosed_prior_text_overlap"), ("R2", False)),
    **dict.fromkeys(("image_similarity_candidate", "global_image_similarity", "image_reuse_cluster", "local_patch_reuse", "same_image_copy_move"), ("R3", True)),
    **dict.fromkeys(("local_patch_cross_context", "cross_context_reuse_candidate", "manifest_conflict", "pseudoreplication_candidate", "text_overlap_candidate", "self_overlap_candidate", "duplicate_publication_candidate", "results_text_overlap", "abstract_conclusion_overlap", "external_text_search_candidate", "external_text_match_candidate"), ("R3", False)),
    **dict.fromkeys(("declared_local_patch_requires_verification", "unresolved_fig_raw_similarity", "detector_execution_failure", "audit_coverage_gap", "completeness_gap", "external_literature_search_gap"), ("R1", False)),
}
CONTEXT_CAPS = {"disclosed_legitimate_reuse": ("R2", False), "disclosed_unjustified_reuse": ("R3", False)}
R4_TAGS = ("direct_contradiction", "raw_record_conflict", "source_to_figure_conflict", "source_data_cannot_reproduce_claim", "raw_image_mismatch")
MISSING_TAGS = ("audit_coverage_gap", "completeness_gap", "detector_execution_failure", "missing_source_data", "source_data_missing", "source_data_unavailable", "unresolved_fig_raw_similarity")
MODES = {"internal_presubmission": ("R4", None), "external_public_material": ("R3", "R1"), "response_to_concern": ("R4", None)}


def _quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _trim(d: Spark, x: str) -> str:
    return d.sub(x, r"^\s+|\s+$", "")


def _path(d: Spark, x: str) -> str:
    slashed = f"replace({_trim(d, x)}, '{chr(92) * 2 if d.spark else chr(92)}', '/')"
    return f"lower({d.sub(d.sub(slashed, '/+', '/'), r'^(\./)+', '')})"


def _files(d: Spark) -> str:
    """The files of each package's last snapshot."""
    return f"""listed as (select package_root, cast(snapshot_no as bigint) as snapshot_no, {_path(d, 'path')} as path, nullif(lower({_trim(d, 'sha256')}), '') as sha, size_bytes, role, received_at
 from file_hash_manifest where package_root is not null and snapshot_no is not null and path is not null),
once as (select *, row_number() over (partition by package_root, snapshot_no, path order by received_at desc nulls last, sha desc nulls last, size_bytes desc nulls last, role desc nulls last) as k from listed),
snaps as (select package_root, snapshot_no, path, sha, size_bytes, role from once where k = 1),
last_ as (select package_root as p, max(snapshot_no) as no from snaps group by package_root), files as (select snaps.* from snaps join last_ on p = package_root and no = snapshot_no)"""


def _category(d: Spark) -> str:
    top = d.extract("path", "^([^/]+)/", 1)
    suffix = d.extract("path", r"(\.[^./]*)$", 1)
    ranked = []  # score, then the earlier name, then the name itself, compared as text
    for k, (c, words, suffixes) in enumerate(sorted(CATEGORY_RULES)):
        hits = " + ".join(f"case when contains(path, '{w}') then 1 else 0 end" for w in words.split())
        allowed = f"suffix in ({_quoted(suffixes.split())})" if suffixes else "true"
        ranked.append(f"concat(case when {allowed} then {hits} else 0 end, '{90 - k}{c}')")
    return f"""parts as (select *, {top} as top, {suffix} as suffix from files), scored as (select *, greatest({', '.join(ranked)}) as best from parts),
inventory as (select package_root, path, sha, size_bytes, suffix, case when top in ({_quoted(CATEGORIES)}) then top when best like '0%' then 'other' else substring(best, 4) end as category from scored)"""


def _inventory(d: Spark) -> str:
    return f"{_files(d)}, {_category(d)}"


def sc60_file_categories(d: Spark) -> str:
    return f"with {_inventory(d)} select package_root, path, category from inventory"


def sc61_figure_keys(d: Spark) -> str:
    p = "(fig(ure)?|supp(lementary)?|s)[_ .-]*([0-9]+|[ivx]+)([a-z])?"
    stem = d.sub(d.extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    return f"with {_files(d)} select distinct path, case when {d.like(stem, p)} then concat('fig', {d.extract(stem, p, 4)}, {d.extract(stem, p, 5)}) end as figure_key from files"


def _role(x: str) -> str:
    return "case " + " ".join(f"when {x} like '{c}/%' then '{r}'" for c, r in ROLES.items()) + " else 'other' end"


def sc62_roles(d: Spark) -> str:
    return f"with {_files(d)} select {_role('path')} as from_path, coalesce(lower(role), 'none') as stated, count(*) as n from files group by {_role('path')}, coalesce(lower(role), 'none')"


def sc63_resource_ids(d: Spark) -> str:
    number = f"lpad(cast(row_number() over (partition by package_root order by path) as {d.text}), 4, '0')"
    slug = f"left({d.sub(d.sub('path', '[^a-z0-9]+', '_'), '^_+|_+$', '')}, 48)"
    return f"with {_files(d)} select package_root, path, concat('res_', {number}, '_', {slug}) as resource_id from files"


def sc64_modalities(d: Spark) -> str:
    bare = f"trim({d.sub('lower(coalesce(modality, ' + repr('') + '))', '[_ -]+', ' ')})"
    alias = " ".join(f"when {bare} = '{a}' then '{m}'" for a, m in ALIASES.items())
    own = " ".join(f"when {bare} = '{m.replace('_', ' ')}' then '{m}'" for m in MODALITIES)
    return f"select coalesce(modality, 'none') as stated, case {own} {alias} else 'other' end as modality, count(distinct row_id) as n from assembly_manifest group by coalesce(modality, 'none'), case {own} {alias} else 'other' end"


def _claims(d: Spark) -> str:
    return "claims as (select * from (select *, row_number() over (partition by row_id order by ingested_at desc nulls last) as k_ from claim_manifest) c where k_ = 1)"


def _links(d: Spark) -> str:
    return "links as (select * from (select *, row_number() over (partition by row_id order by ingested_at desc nulls last) as k_ from assembly_manifest) c where k_ = 1)"


def _pieces(d: Spark, field: str) -> str:
    return f"{d.filter}({d.transform}({d.split(f'coalesce({field}, {chr(39) * 2})', '[;|]')}, {d.fn('x', _trim(d, 'x'))}), {d.fn('x', f'lower(x) not in ({_quoted(NO_REFERENCE)})')})"


def sc66_references(d: Spark) -> str:
    return f"with {_claims(d)}, r as (select row_id, {d.unnest(_pieces(d, 'source_data'))} as ref from claims) select row_id, ref, {_path(d, 'ref')} as path from r"


def sc67_package_hash(d: Spark) -> str:
    """A hash of each package's sorted files."""
    line = f"concat(path, '|', coalesce(sha, ''), '|', coalesce(cast(size_bytes as {d.text}), ''), '|', category)"
    agg = f"array_join(array_sort(collect_list({line})), '~')" if d.spark else f"string_agg({line}, '~' order by {line})"
    return f"with {_inventory(d)} select package_root, {d.sha(agg)} as package_hash, count(*) as n_files from inventory group by package_root"


def r01_snapshot_manifest(d: Spark) -> str:
    return f"with {_inventory(d)} select package_root, category, count(*) as n_files, cast(sum(size_bytes) as bigint) as bytes, count(sha) as n_hashed from inventory group by package_root, category"


def a27_missing_materials(d: Spark) -> str:
    """Expected categories that a package lacks (J-15), for each mode and domain."""
    wanted = [f"'{m}|{x}|{c}'" for m in BASE_EXPECTED for x in DOMAIN_EXPECTED for c in expected_categories(m, (x,))]
    return f"""with {_inventory(d)}, packages as (select distinct package_root from inventory), have as (select distinct package_root, category from inventory),
want as (select package_root, {d.unnest(d.array(*wanted))} as mdc from packages),
named as (select package_root, {d.extract('mdc', '^([^|]*)', 1)} as mode, {d.extract('mdc', '[|]([^|]*)[|]', 1)} as domain, {d.extract('mdc', '([^|]*)$', 1)} as category from want)
select w.package_root, w.mode, w.domain, w.category from named w left join have h on h.package_root = w.package_root and h.category = w.category where h.category is null"""


def j08_figures_to_sources(d: Spark) -> str:
    """Figures and the raw images or source tables of their package with the same figure key."""
    p = "(fig(ure)?|supp(lementary)?|s)[_ .-]*([0-9]+|[ivx]+)([a-z])?"
    stem = d.sub(d.extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    return f"""with {_inventory(d)}, keyed as (select package_root, path, category, concat({d.extract(stem, p, 4)}, {d.extract(stem, p, 5)}) as k from inventory where {d.like(stem, p)})
select f.package_root, f.path as figure, s.path as source, f.k as figure_key from keyed f join keyed s on f.package_root = s.package_root and f.k = s.k where f.category = 'figures' and s.category in ('raw_images', 'source_data')"""


def _resolved(d: Spark) -> str:
    """Links of assembly rows, one for each figure and source a row names, with both ends looked up: by full path, else by file name.

    A field without a reference gives null.
    """
    name = d.extract("path", "([^/]*)$", 1)
    if d.spark:
        every = lambda f: f"explode(array_distinct({d.transform}({_pieces(d, f)}, {d.fn('x', _path(d, 'x'))})))"
        ends = f"figure, source from links lateral view outer {every('figure_panel')} f_ as figure lateral view outer {every('source_record')} s_ as source"
    else:
        every = lambda f: f"(select unnest(case when len({_pieces(d, f)}) = 0 then [null] else list_distinct({d.transform}({_pieces(d, f)}, {d.fn('x', _path(d, 'x'))})) end) as {f}_)"
        ends = f"f_.figure_panel_ as figure, s_.source_record_ as source from links, lateral {every('figure_panel')} f_, lateral {every('source_record')} s_"
    return f"""{_files(d)}, {_links(d)}, ends as (select row_id, package_root, relation_type, modality, {ends} where package_root is not null),
names as (select package_root, {name} as name, min(path) as path from files group by package_root, {name}),
resolved as (select e.row_id, e.package_root, relation_type, modality, coalesce(f1.path, f2.path) as figure, coalesce(s1.path, s2.path) as source, figure as stated_figure, source as stated_source from ends e
 left join files f1 on f1.package_root = e.package_root and f1.path = e.figure left join names f2 on f2.package_root = e.package_root and f2.name = e.figure
 left join files s1 on s1.package_root = e.package_root and s1.path = e.source left join names s2 on s2.package_root = e.package_root and s2.name = e.source)"""


def j09_assembly_files(d: Spark) -> str:
    return f"with {_resolved(d)} select row_id, figure, source from resolved"


def j07_graph_edges(d: Spark) -> str:
    """Nodes and distinct edges of each package's graph; links with an unknown end as warnings (G-03)."""
    return f"""with {_resolved(d)}, e as (select distinct package_root, figure, source, relation_type from resolved where figure is not null and source is not null)
select package_root, count(*) as n_edges, count(distinct figure) as n_figures, count(distinct source) as n_sources from e group by package_root"""


def j07_graph_warnings(d: Spark) -> str:
    return f"with {_resolved(d)} select package_root, count(*) as n_links, count(case when figure is null then 1 end) as unknown_figure, count(case when source is null then 1 end) as unknown_source from resolved group by package_root"


#: Candidates that the screens make, one for each kind of tag.
_TAGS = [*CAPS, *CONTEXT_CAPS, "expected_traceability", "missing_source_data", *R4_TAGS]
_CANDIDATES = [
    (f"C{i:03d}", mode, tag, suggestion, strength, "weak_signal" if i % 4 == 0 else ("direct_contradiction" if i % 11 == 0 else tag), i % 5 != 0)
    for i, (mode, tag, suggestion, strength) in enumerate(
        (m, t, s, e) for k, t in enumerate(_TAGS) for j, m in enumerate(MODES) for s, e in ((("R4_only_if_direct_contradiction", "strong_candidate"), ("R2_or_R3_depending", "candidate"), (None, "strong_candidate"), ("R0_positive", "weak_signal"))[(k + j) % 4],)
    )
]


def _calibration(d: Spark, cands: str | None = None) -> str:
    """Risk as the minimum of the suggested risk and all caps; the log of caps as the ones that lower a running minimum."""
    rule = lambda section, caps: [(section, t, int(r[1]), u) for t, (r, u) in caps.items()]
    rules = rule(1, CAPS) + rule(2, CONTEXT_CAPS)
    start = "coalesce(" + ("cast(nullif(array_max(regexp_extract_all(upper(suggestion), r'R([0-4])', 1)), '') as int)" if d.spark else "list_max(regexp_extract_all(upper(suggestion), 'R([0-4])', 1))::int") + ", case strength when 'direct_contradiction' then 4 when 'strong_candidate' then 3 when 'candidate' then 2 else 1 end)"
    distinct = "array_distinct" if d.spark else "list_distinct"
    cands = cands or d.values("cands", "id, mode, tag, suggestion, strength, tag2, complete", _CANDIDATES)
    return f"""{cands}, {d.values('rules', 'section, tag, cap, lifted', rules)},
{d.values('modes', 'mode, cap, missing_cap', [(m, int(a[1]), int(b[1]) if b else None) for m, (a, b) in MODES.items()])},
tagged as (select id, mode, complete, {start} as start_, {distinct}({d.array('tag', 'tag2', 'strength')}) as tags from cands),
each_ as (select id, {d.unnest('tags')} as tag from tagged), r4 as (select id, max(case when tag in ({_quoted(R4_TAGS)}) then 1 else 0 end) as has_r4, max(case when tag in ({_quoted(MISSING_TAGS)}) then 1 else 0 end) as lacking,
 max(case when tag = 'expected_traceability' then 1 else 0 end) as positive from each_ group by id),
caps as (select t.id, 0 as section, 'mode' as tag, m.cap from tagged t join modes m on m.mode = t.mode union all select t.id, 0, 'missing_source_data', m.missing_cap from tagged t join modes m on m.mode = t.mode join r4 on r4.id = t.id where lacking = 1 and m.missing_cap is not null
 union all select e.id, r.section, e.tag, r.cap from each_ e join rules r on r.tag = e.tag join r4 on r4.id = e.id where not (has_r4 = 1 and r.lifted)),
low as (select id, min(cap) as cap, count(case when section > 0 then 1 end) as n_rules from caps group by id),
capped as (select t.id, start_, least(start_, coalesce(cap, 9)) as risk, has_r4, positive, complete, coalesce(n_rules, 0) as n_rules from tagged t join r4 on r4.id = t.id left join low on low.id = t.id),
bounded as (select *, case when risk = 4 and has_r4 = 0 then 3 else risk end as r3 from capped),
final as (select id, start_, case when r3 >= 3 and not complete then 2 else r3 end as risk, start_ = 0 and positive = 1 and n_rules = 0 and has_r4 = 0 as as_positive from bounded)"""


def cal02_risks(d: Spark) -> str:
    return f"with {_calibration(d)} select id, cast(start_ as bigint) as suggested, cast(risk as bigint) as risk from final where not as_positive"


def cal06_cap_log(d: Spark) -> str:
    """The caps that bind, in the order of section and tag: those below the suggested risk and all caps before them."""
    return f"""with {_calibration(d)}, run as (select c.id, section, c.tag, c.cap, start_, min(c.cap) over (partition by c.id order by section, c.tag rows between unbounded preceding and 1 preceding) as before from caps c join tagged t on t.id = c.id)
select id, section, tag, cap from run where cap < least(start_, coalesce(before, 9))"""


def cal09_positive(d: Spark) -> str:
    return f"with {_calibration(d)} select id from final where as_positive"


def a29_risk_histogram(d: Spark) -> str:
    rows = [(k,) for k in range(5)]
    return f"with {_calibration(d)}, {d.values('levels', 'level', rows)} select concat('R', level) as level, count(final.id) as n from levels left join final on final.risk = level and not as_positive group by level"


def a30_overall_risk(d: Spark) -> str:
    return f"with {_calibration(d)} select mode, concat('R', max(greatest(risk, 1))) as overall from final join tagged on tagged.id = final.id group by mode"


def _owner(t: str) -> str:
    has = lambda ws: " or ".join(f"contains({t}, '{w}')" for w in ws)
    return f"case when {has(('stat', 'p-value', 'sem', 'sd', 'mean', 'n consistency'))} then 'statistician' when {has(('image', 'figure', 'raw', 'blot', 'gel', 'microscopy', 'traceability'))} then 'figure_preparer' when {has(('source', 'data', 'claim', 'manifest'))} then 'data_owner' when {has(('ethics', 'irb', 'consent', 'registry', 'protocol'))} then 'corresponding_author' else 'first_author' end"


def a31_action_queue(d: Spark) -> str:
    """One numbered action per calibrated finding and per missing category of a package, findings first by risk."""
    number = f"lpad(cast(row_number() over (order by kind, risk desc, subject) as {d.text}), 4, '0')"
    return f"""with {_calibration(d)}, queue as (select 0 as kind, risk, concat(final.id, ' ', cands.tag) as subject from final join cands on cands.id = final.id where not as_positive
 union all select 1, 1, concat('missing ', category) from ({' union all '.join(f"select '{c}' as category" for c in EXPECTED)}) m)
select concat('ACT-', {number}) as action_id, subject, concat('R', risk) as risk, {_owner('lower(subject)')} as owner from queue"""


def a28_claim_coverage(d: Spark) -> str:
    """Per package how many claims have evidence in each field."""
    fields = ("source_data", "raw_record", "analysis_code", "protocol")
    counts = ", ".join(f"count(case when {d.size}({_pieces(d, f)}) > 0 then 1 end) as with_{f}" for f in fields)
    return f"with {_claims(d)} select package_root, count(*) as n_claims, {counts}, count(case when claim_text is null or trim(claim_text) = '' then 1 end) as without_text from claims group by package_root"


def j14_claim_files(d: Spark) -> str:
    """Claims by whether all, some or none of their source references are in the package's last snapshot."""
    name = d.extract("path", "([^/]*)$", 1)
    return f"""with {_files(d)}, {_claims(d)}, refs as (select row_id, package_root, {d.unnest(_pieces(d, 'source_data'))} as ref from claims), norm as (select distinct row_id, package_root, {_path(d, 'ref')} as ref from refs),
known as (select distinct package_root, path as k from files union select distinct package_root, {name} from files), hit as (select n.row_id, count(*) as n, count(k) as found from norm n left join known on known.package_root = n.package_root and k = ref group by n.row_id)
select case when found = n then 'all' when found = 0 then 'none' else 'some' end as coverage, count(*) as n_claims from hit group by case when found = n then 'all' when found = 0 then 'none' else 'some' end"""


def a33_unsupported_formats(d: Spark) -> str:
    kind = "case when suffix in ('.doc', '.docx') then 'word' when suffix = '.xls' then 'old_excel' when suffix = '.pzfx' then 'prism' when suffix = '.nd2' then 'microscope' end"
    return f"with {_inventory(d)} select package_root, {kind} as kind, count(*) as n, min(path) as first_path from inventory where {kind} is not null group by package_root, {kind}"


_CHECKS = [("figures", "raw images", "raw_images"), ("figures", "assembly files", "figure_assembly"), ("statistics", "source data", "source_data"), ("statistics", "analysis code", "statistics_code"), ("methods", "protocols", "protocols"), ("methods", "ethics approval", "ethics_irb"), ("text", "manuscript", "manuscript"), ("text", "supplement", "supplementary")]


def a34_checklist(d: Spark) -> str:
    """Per package and module whether the materials its checks need are there (J-16)."""
    return f"""with {_inventory(d)}, {d.values('checks', 'module, material, category', _CHECKS)}, have as (select distinct package_root, category from inventory), packages as (select distinct package_root from have),
want as (select package_root, {d.unnest(d.array(*[f"'{m}|{c}'" for m, _, c in _CHECKS]))} as mc from packages), split_ as (select package_root, {d.extract('mc', '^([^|]*)', 1)} as module, {d.extract('mc', '([^|]*)$', 1)} as category from want),
per as (select s.package_root, s.module, count(*) as n, count(h.category) as ready from split_ s left join have h on h.package_root = s.package_root and h.category = s.category group by s.package_root, s.module)
select package_root, module, n, ready, case when ready = n then 'READY' when ready = 0 then 'MISSING' else 'PARTIAL' end as state from per"""


def a36_eval_metrics(d: Spark) -> str:
    """Label recall: a label counts if a finding of its case contains one of its words (J-18)."""
    labels = [("case_1", "L1", "image_reuse"), ("case_1", "L2", "SD is not"), ("case_2", "L3", "overlap"), ("case_3", "L4", "fabricated")]
    findings = [("case_1", "image_reuse cluster in figure 2"), ("case_2", "text overlap with thesis"), ("case_3", "terminal digits")]
    return f"""with {d.values('labels', 'case_id, label_id, word', labels)}, {d.values('findings', 'case_id, body', findings)},
hit as (select l.case_id, l.label_id, max(case when contains(f.body, l.word) then 1 else 0 end) as found from labels l left join findings f on f.case_id = l.case_id group by l.case_id, l.label_id)
select count(*) as n_labels, cast(sum(found) as bigint) as n_found, round(cast(sum(found) as double) / count(*), 6) as recall from hit"""


def a38_dedup_records(d: Spark) -> str:
    """First record per lower-cased brand and type of a part, numbered."""
    number = f"lpad(cast(row_number() over (order by lower(p_brand), lower(p_type)) as {d.text}), 4, '0')"
    return f"""with r as (select *, row_number() over (partition by lower(p_brand), lower(p_type) order by p_partkey) as k from part), one as (select p_partkey, p_brand, p_type from r where k = 1)
select concat('CASE-', {number}) as case_id, p_partkey from one"""


def j17_controls(d: Spark) -> str:
    """Customers that share no nation, segment or key with a concern set: identifiers are matched as typed values, without OR."""
    ids = d.unnest(d.array(f"concat('n:', cast(c_nationkey as {d.text}))", f"concat('k:', cast(c_custkey as {d.text}))"))
    return f"""with concern as (select concat('n:', cast(s_nationkey as {d.text})) as v from supplier where s_suppkey <= 3 union select concat('k:', cast(o_custkey as {d.text})) from orders where o_totalprice > 400000),
mine as (select c_custkey, {ids} as v from customer), bad as (select distinct c_custkey from mine join concern on concern.v = mine.v) select c.c_custkey from customer c left join bad on bad.c_custkey = c.c_custkey where bad.c_custkey is null"""


def j20_reaudit_diff(d: Spark) -> str:
    """Findings of a previous and a current run joined in full: fixed, new or persisted."""
    prev, cur = "l_quantity >= 45", "l_discount >= 0.05"
    return f"""with p as (select distinct l_orderkey as k from lineitem where {prev}), c as (select distinct l_orderkey as k from lineitem where {cur}),
j as (select case when c.k is null then 'fixed' when p.k is null then 'new' else 'persisted' end as state from p full outer join c on p.k = c.k) select state, count(*) as n from j group by state"""


def r02_metric_diff(d: Spark) -> str:
    """Metrics of the first and the last snapshot of each package, side by side (R-03)."""
    return f"""with {_files(d)}, per as (select package_root, snapshot_no, count(*) as n_files, cast(sum(size_bytes) as bigint) as bytes from snaps group by package_root, snapshot_no),
ends as (select package_root, min(snapshot_no) as a, max(snapshot_no) as b from per group by package_root), m as (select e.package_root, x.n_files as n0, y.n_files as n1, x.bytes as b0, y.bytes as b1 from ends e join per x on x.package_root = e.package_root and x.snapshot_no = a join per y on y.package_root = e.package_root and y.snapshot_no = b)
select package_root, 'n_files' as metric, n0 as previous, n1 as current_ from m union all select package_root, 'bytes', b0, b1 from m"""


def snk02_safe_csv(d: Spark) -> str:
    """Cells that a spreadsheet would take for formulas get a quote in front."""
    bare = d.sub("notes", "^[ \\t\\r\\n﻿]+", "")
    return f"with v as (select distinct coalesce(notes, '') as notes from assembly_manifest union all select distinct concat('=', owner) from claim_manifest where owner is not null) select notes, case when {d.like(bare, '^[=+@-]')} then concat('''', notes) else notes end as safe from v" if not d.spark else f"with v as (select distinct coalesce(notes, '') as notes from assembly_manifest union all select distinct concat('=', owner) from claim_manifest where owner is not null) select notes, case when {d.like(bare, '^[=+@-]')} then concat(\"'\", notes) else notes end as safe from v"


def sc69_publication_status(d: Spark) -> str:
    rows = [(x,) for x in ("Retraction", "Expression of Concern", "Correction", "Erratum", "Corrigendum", "Reinstatement", "Notice", "RETRACT and correct")]
    n = "lower(nature)"
    return f"with {d.values('v', 'nature', rows)} select nature, case when contains({n}, 'retract') then 'retracted' when contains({n}, 'expression') and contains({n}, 'concern') then 'expression_of_concern' when contains({n}, 'correct') or contains({n}, 'errat') or contains({n}, 'corrig') then 'corrected' when contains({n}, 'reinstate') then 'reinstated' else 'publication_status_event' end as status from v"


def sc71_expected_risk(d: Spark) -> str:
    rows = [("R2 to R3",), ("max R1",), ("none",), ("R0/R4",)]
    top = "array_max(regexp_extract_all(t, r'R[0-4]', 0))" if d.spark else "list_max(regexp_extract_all(t, 'R[0-4]'))"
    return f"with {d.values('v', 't', rows)} select t, coalesce({top}, 'R4') as risk from v"


def sc72_owners(d: Spark) -> str:
    return f"with {_claims(d)} select row_id, {_owner('lower(concat(coalesce(source_data, ' + repr('') + '), coalesce(claim_text, ' + repr('') + ')))')} as owner from claims"


def calibrated(candidates: DataFrame) -> DataFrame:
    """(id, suggested, risk) of candidates (id, mode, tag, suggestion, strength, tag2, complete); those that are positive evidence are left out."""
    name = "quillon_candidates"
    candidates.createOrReplaceTempView(name)
    sql = f"with {_calibration(SPARK, f'cands as (select * from {name})')} select id, concat('R', start_) as suggested, concat('R', risk) as risk from final where not as_positive"
    return candidates.sparkSession.sql(sql)


QUERIES, SQL = both([
    sc60_file_categories, sc61_figure_keys, sc62_roles, sc63_resource_ids, sc64_modalities, sc66_references, sc67_package_hash, sc69_publication_status, sc71_expected_risk, sc72_owners,
    a27_missing_materials, a28_claim_coverage, a29_risk_histogram, a30_overall_risk, a31_action_queue, a33_unsupported_formats, a34_checklist, a36_eval_metrics, a38_dedup_records,
    j07_graph_edges, j07_graph_warnings, j08_figures_to_sources, j09_assembly_files, j14_claim_files, j17_controls, j20_reaudit_diff,
    cal02_risks, cal06_cap_log, cal09_positive,
    r01_snapshot_manifest, r02_metric_diff, snk02_safe_csv,
])
