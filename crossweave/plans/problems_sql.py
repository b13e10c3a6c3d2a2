"""SQL of the general problems. The SQL engine has no NFKC; the wide forms of ASCII letters and digits, the only
characters of the test tables' ids that NFKC changes into letters or digits, are mapped one by one."""

WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def key(c: str) -> str:
    """SQL for the key of an id, null if it is absent."""
    k = f"upper(regexp_replace(translate({c}, '{WIDE}', '{PLAIN}'), '[^A-Za-z0-9]', '', 'g'))"
    return f"(case when {k} not in ('', 'NULL', 'NONE', 'NAN', 'NA', 'UNKNOWN') then {k} end)"


_REFS = " union all ".join(
    f"select '{t}' as table_name, '{f}' as field_name, {row} as row_key, {at} as ts, '{dom}' as dom, " + (f"'#' || cast({f} as varchar)" if number else key(f)) + f" as ref from {t}"
    for t, f, dom, row, at, number in (
        ("src_ratings", "itemId", "src", "row_id", "ts", False), ("tgt_ratings", "itemId", "tgt", "row_id", "ts", False),
        ("kg_paths", "n1_asin", "src", "path_id", "found_at", False), ("kg_paths", "n2_asin", "tgt", "path_id", "found_at", False),
        ("sim", "src_iid", "src", "sim_id", "built_at", True), ("sim", "tgt_iid", "tgt", "sim_id", "built_at", True),
    )
)
_ORPHANS = f"""refs as (select * from ({_REFS}) where ref is not null),
items as (select dom, {key('itemId')} as ref, listed_at, removed_at from item_index union all
          select dom, '#' || cast(iid as varchar), listed_at, removed_at from item_index),
orphans as (select * from refs r where not exists (select 1 from items i where i.dom = r.dom and i.ref = r.ref
            and (r.ts is null or (i.listed_at <= r.ts and (i.removed_at is null or r.ts < i.removed_at)))))"""
P2_FOUND = f"with {_ORPHANS} select table_name, field_name, row_key from orphans"
_CASCADE = f"""direct as materialized (select distinct table_name, row_key from orphans),
r as (select 'src_ratings' as t, 'src' as dom, row_id, {key('userId')} as u, {key('itemId')} as i from src_ratings
      union all select 'tgt_ratings', 'tgt', row_id, {key('userId')}, {key('itemId')} from tgt_ratings),
gone as materialized (select r.dom, r.u, r.i from r left join direct d on d.table_name = r.t and d.row_key = r.row_id
         where r.u is not null and r.i is not null group by 1, 2, 3 having count(*) = count(d.row_key)),
s as materialized (select row_id, dom, {key('userId')} as u, {key('itemId')} as i, ts from split_ratings),
lost(doc_id, posted_at, depth) as (
  select d.doc_id, d.posted_at, 0 from documents d left join documents p on p.doc_id = d.parent_id where d.parent_id is not null and p.doc_id is null
  union all select d.doc_id, d.posted_at, l.depth + 1 from documents d join lost l on d.parent_id = l.doc_id)"""
P2_REPORT = f"""with recursive {_ORPHANS}, {_CASCADE},
x as (select table_name, field_name, ts, 'any' as kind from refs union all select table_name, field_name, ts, 'direct' from orphans
union all select 'split_ratings', 'userId, itemId', ts, 'any' from s where dom is not null and u is not null and i is not null
union all select 'split_ratings', 'userId, itemId', s.ts, 'inherited' from s join gone g on g.dom = s.dom and g.u = s.u and g.i = s.i
union all select 'documents', 'parent_id', posted_at, 'any' from documents where parent_id is not null
union all select 'documents', 'parent_id', posted_at, case depth when 0 then 'direct' else 'inherited' end from lost)
select table_name, field_name, strftime(ts, '%Y-%m') as month, count(*) filter (kind = 'any') as n_refs, count(*) filter (kind = 'direct') as n_direct,
count(*) filter (kind = 'inherited') as n_inherited from x group by 1, 2, 3"""
P2_RECORDS = f"""with recursive {_ORPHANS}, {_CASCADE}
select table_name, row_key, 'direct' as kind, 0 as depth from direct
union all select 'split_ratings', s.row_id, 'inherited', 1 from s join gone g on g.dom = s.dom and g.u = s.u and g.i = s.i
union all select 'documents', doc_id, case depth when 0 then 'direct' else 'inherited' end, depth from lost"""
_KEYS = " union all ".join(
    f"select '{t}' as table_name, {key('userId')} as u, {key('itemId')} as i, case when {ok} then {v} end as v from {t}"
    for t, v, ok in (("src_ratings", "rating", "rating between 1 and 5 and not isnan(rating)"), ("tgt_ratings", "rating", "rating between 1 and 5 and not isnan(rating)"), ("item_scores", "score", "isfinite(score)"))
)
_P3 = f"""with x as ({_KEYS}), k as (
select table_name, 'userId' as field_name, u as key_value, count(*) as n_rows, count(distinct i) as n_partners, round(avg(v) + 1e-9, 6) as mean_value from x where u is not null group by 1, 2, 3
union all select table_name, 'itemId', i, count(*), count(distinct u), round(avg(v) + 1e-9, 6) from x where i is not null group by 1, 2, 3)"""
P3_KEYS = f"{_P3} select * from k"
P3_FOUND = f"""{_P3} select table_name, field_name, key_value from (select *, sum(n_rows) over (partition by table_name, field_name) as n from k)
where n_rows * 100 >= n and not (table_name = 'item_scores' and field_name = 'itemId')"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_report": P2_REPORT, "p2_records": P2_RECORDS, "p3_found": P3_FOUND, "p3_keys": P3_KEYS}
