"""Queries and SQL of the general data-processing problems: snapshots, rows that fail to parse, orphan references."""

from __future__ import annotations

from quillon.operators import references, rows, snapshots

QUERIES = {
    "p3_found": snapshots.p3_found,
    "p3_changes": snapshots.p3_changes,
    "p4_found": rows.p4_found,
    "p4_broken_field": rows.p4_broken_field,
    "p4_loaded": rows.p4_loaded,
    "p6_found": references.p6_found,
    "p6_counts": references.p6_counts,
    "p6_current": references.p6_current,
}


def _trimmed(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _path(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(replace({_trimmed(c)}, '\', '/'), '/+', '/', 'g'), '^(\./)+', ''))"


_LISTING = f"""listed as (
  select package_root, snapshot_no::bigint as snapshot_no, path, h, size_bytes from (
    select *, row_number() over (partition by package_root, snapshot_no, path order by received_at desc nulls last, h desc nulls last, size_bytes desc nulls last) as k from (
      select package_root, snapshot_no, {_path("path")} as path, nullif(lower({_trimmed("sha256")}), '') as h, received_at, size_bytes
      from file_hash_manifest where package_root is not null and snapshot_no is not null and path is not null))
  where k = 1)"""

_CHANGES = f"""with {_LISTING},
nos as (select package_root, snapshot_no, lag(snapshot_no) over (partition by package_root order by snapshot_no) as prev
        from (select distinct package_root, snapshot_no from listed)),
cur as (select l.* from listed l join nos using (package_root, snapshot_no) where prev is not null),
old as (select l.package_root, n.snapshot_no, l.path, l.h, l.size_bytes from listed l join nos n on n.package_root = l.package_root and n.prev = l.snapshot_no),
both_ as (select coalesce(c.package_root, o.package_root) as package_root, coalesce(c.snapshot_no, o.snapshot_no) as snapshot_no,
                 coalesce(c.path, o.path) as path, c.path is null as gone, o.path is null as fresh, c.h as new_h, o.h as old_h, c.size_bytes as new_size, o.size_bytes as old_size
          from cur c full outer join old o on c.package_root = o.package_root and c.snapshot_no = o.snapshot_no and c.path = o.path),
changes as (select *, case when fresh then 'added' when gone then 'removed' else 'changed' end as change_kind from both_ where fresh or gone or new_h <> old_h)"""


def _refs(name: str, field: str) -> str:
    return f"""select distinct '{name}' as src_table, row_id, package_root, snapshot_no, '{field}' as ref_field, {_path("piece")} as ref_path, period from (
    select row_id, package_root, snapshot_no, strftime(created_at, '%Y-%m') as period, {_trimmed("unnest(string_split_regex(" + field + ", '[;|]'))")} as piece
    from (select *, row_number() over (partition by row_id order by ingested_at desc nulls last) as k from {name}) where k = 1)
  where lower(piece) not in ('', 'na', 'n/a', 'none', 'not_applicable', 'not applicable', '-')"""


_ORPHANS = f"""with {_LISTING},
refs as ({" union all ".join(_refs(name, f) for name, fields in references.FIELDS.items() for f in fields)}),
present as (select distinct package_root, snapshot_no, unnest([path, split_part(path, '/', -1)]) as ref_path from listed),
spans as (select package_root, ref_path, list(snapshot_no) as nos, min(snapshot_no) as lo, max(snapshot_no) as hi from present group by 1, 2),
orphans as (
  select r.*, case when lo < r.snapshot_no then 'deleted' when hi > r.snapshot_no then 'late' else 'missing' end as orphan_kind
  from refs r left join spans s using (package_root, ref_path) where not coalesce(list_contains(nos, r.snapshot_no), false))"""

_D = ("','", "';'", "chr(9)")


def _case(column: str, make) -> str:
    return "case " + " ".join(f"when {column} = {d} then {make(d, p)}" for d, p in zip(_D, (",", ";", r"\t"), strict=True)) + " end"


_FIELDS_OF = lambda line: lambda d, p: rf"""regexp_extract_all({d} || {line}, '{p}("(?:[^"]|"")*"|[^"{p}]*)', 1)"""
_UNQUOTE = """list_transform({0}, lambda f: case when f[1] = '"' then replace(f[2:-2], '""', '"') else f end)"""
_NUMBER = "[+-]?(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?%?"


def _value(t: str) -> str:
    plain = f"regexp_extract({t}, '^[<>]?[ \\t]*({_NUMBER})$', 1)"
    return f"try_cast(translate({plain}, ',%', '.') as double) / case when {plain} like '%\\%' escape '\\' then 100 else 1 end"


def _acceptable(c: str, probability: bool) -> str:
    t = rf"regexp_replace({c}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
    in_range = f" and ({t}[1] in ('<', '>') or {_value(t)} between 0 and 1)" if probability else ""
    return (
        f"({c} is null or lower({t}) in ('', 'na', 'n/a', 'nan', 'null', '-') or coalesce(regexp_matches({t}, '^[<>]?[ \\t]*{_NUMBER}$')"
        f" and isfinite({_value(t)}){in_range}, false))"
    )


_CHECKED = rf"""raw as (select * from (select *, row_number() over (partition by row_id order by received_at desc nulls last) as k from raw_source_rows) where k = 1),
heads as (select package_root, figure_file, lower(trim(source_table)) as target, regexp_replace(regexp_replace(line, '^﻿', ''), '\r$', '') as head from raw where line_no = 1),
schemas as (select *, case when length(head) - length(replace(head, chr(9), '')) > 0 then chr(9)
                           when length(head) - length(replace(head, ';', '')) > length(head) - length(replace(head, ',', '')) then ';' else ',' end as d from heads),
cols as (select package_root, figure_file, target, d, list_transform({_UNQUOTE.format(_case("d", _FIELDS_OF("head")))}, lambda c: lower(trim(c))) as columns from schemas),
data as (select row_id, target, d, columns, regexp_replace(coalesce(line, ''), '\r$', '') as line from raw join cols using (package_root, figure_file) where line_no <> 1),
split as (select row_id, target, columns, {_UNQUOTE.format(_case("d", _FIELDS_OF("line")))} as fields,
                 {_case("d", lambda d, p: rf"""regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^"{p}]*)(?:{p}(?:"(?:[^"]|"")*"|[^"{p}]*))*')""")} as quoted_well from data),
got as (select *, fields[list_position(columns, 'mean')] as mean, fields[list_position(columns, 'p_value')] as p_value, fields[list_position(columns, 'value')] as val from split),
checked as (select *, case when not quoted_well then 'broken_quoting' when len(fields) <> len(columns) then 'column_count'
   when target = 'figure_7_summary' and not ({_acceptable("mean", False)} and {_acceptable("p_value", True)}) then 'invalid_value'
   when target = 'figure_6_field_measurements' and not {_acceptable("val", False)} then 'invalid_value' end as reason from got)"""


def _bad(name: str, cols: dict[str, bool]) -> str:
    good = " and ".join(_acceptable(c, p) for c, p in cols.items())
    return f"""select '{name}' as src_table, row_id, 'invalid_value' as reason
from (select *, row_number() over (partition by row_id order by ingested_at desc nulls last) as k from {name}) where k = 1 and not ({good})"""


_FIELD = lambda p: rf'(?:"(?:[^"]|"")*"|[^"{p}]*)'
_FIRST_BROKEN = lambda d, p: rf"""list_filter(range(1, len(columns) + 1), lambda k: not regexp_matches(line, '^{_FIELD(p)}(?:{p}{_FIELD(p)}){{' || (k - 1)::varchar || '}}(?:{p}|$)'))[1]"""
_TRIM_FIELD = r"regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"

SQL = {
    "p3_found": f"{_CHANGES} select package_root, snapshot_no, path, change_kind from changes",
    "p3_changes": f"{_CHANGES} select package_root, snapshot_no, path, change_kind, old_h as old_hash, new_h as new_hash, old_size, new_size from changes",
    "p4_found": f"with {_CHECKED} select 'raw_source_rows' as src_table, row_id, reason from checked where reason is not null union all "
    + " union all ".join(_bad(name, cols) for name, cols in rows.TYPED.items()),
    "p4_loaded": f"with {_CHECKED} select row_id, target, "
    + ", ".join(f"round({_value(_TRIM_FIELD.format(c))}, 9) as {n}" for c, n in (("mean", "mean"), ("p_value", "p_value"), ("val", '"value"')))
    + " from checked where reason is null",
    "p4_broken_field": f"""with {_CHECKED}, broken as (select c.row_id, reason, columns, case when reason = 'invalid_value' then least(
  case when target = 'figure_7_summary' and not ({_acceptable("mean", False)}) then list_position(columns, 'mean') end,
  case when target = 'figure_7_summary' and not ({_acceptable("p_value", True)}) then list_position(columns, 'p_value') end,
  case when target = 'figure_6_field_measurements' and not ({_acceptable("val", False)}) then list_position(columns, 'value') end)
 else coalesce({_case("d", _FIRST_BROKEN)}, len(columns) + 1) end as broken_field
 from checked c join (select row_id, line, d from data) x using (row_id) where reason is not null)
select row_id, reason, broken_field::bigint as broken_field, columns[broken_field] as column_name from broken""",
    "p6_current": f"""{_ORPHANS}, last_ as (select package_root, max(snapshot_no) as no from listed group by 1)
select o.package_root, ref_path, count(*) as n_refs from orphans o join last_ l on l.package_root = o.package_root and no = o.snapshot_no group by 1, 2""",
    "p6_found": f"{_ORPHANS} select src_table, row_id, ref_field, ref_path, orphan_kind from orphans",
    "p6_counts": f"{_ORPHANS} select src_table, period, orphan_kind, count(*) as n_orphans from orphans group by 1, 2, 3",
}
