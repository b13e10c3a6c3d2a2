"""SQL of the queries of this package."""

from crossweave.llm.sample import BITS, GOLDEN
from crossweave.plans.problems_sql import key

_BASKETS = f"b as (select distinct {key('userId')} as u, {key('itemId')} as i from src_ratings), bs as (select * from b where u is not null and i is not null)"
P1_FOUND = f"""with {_BASKETS}, n as (select i, count(*) as c from bs group by 1), t as (select count(distinct u) as c from bs),
p as (select x.i as item_a, y.i as item_b, count(*) as c from bs x join bs y on x.u = y.u and x.i < y.i group by 1, 2 having count(*) >= 12)
select item_a, item_b from p join n a on a.i = item_a join n b on b.i = item_b, t where p.c * t.c >= 20 * a.c * b.c"""
_SPLIT = f"s as (select row_id, dom, split, {key('userId')} as u, {key('itemId')} as i from split_ratings)"
_MET = "from s a join s b on a.dom = b.dom and a.u = b.u and a.i = b.i and a.split = 'train' and b.split in ('val', 'test')"
P4_FOUND = f"with {_SPLIT} select least(a.row_id, b.row_id) as row_a, greatest(a.row_id, b.row_id) as row_b {_MET}"
_SHINGLES = "list_distinct(list_transform(range(1, length({0}) + 1), lambda k: substr('^' || {0} || '$', k, 3)))"
_JACCARD = "(case when a.{0} = b.{0} then 1.0 else len(list_intersect({1}, {2})) / len(list_distinct({1} || {2}))::double end)"
_SIMILAR = " + ".join(f"0.4 * {_JACCARD.format(c, _SHINGLES.format(f'a.{c}'), _SHINGLES.format(f'b.{c}'))}" for c in "ui")
P4_REPORT = f"""with s as (select row_id, dom, split, {key('userId')} as u, {key('itemId')} as i, r, epoch_us(ts) // 1000000 as t from split_ratings),
d as (select a.row_id as x, b.row_id as y, b.dom, b.split, b.u, b.i, case when a.u = b.u and a.i = b.i then 'same' else 'near' end as kind,
round({_SIMILAR} + case when a.t = b.t then 0.15 else 0 end + case when a.r = b.r then 0.05 else 0 end, 6) as v
from s a join s b on a.dom = b.dom and a.split = 'train' and b.split in ('val', 'test') and a.u is not null and a.i is not null and b.u is not null and b.i is not null
and ((a.u = b.u and a.i = b.i) or (a.t = b.t and (a.u = b.u or a.i = b.i))))
select dom, split, kind, count(distinct u || '|' || i) as n_records, count(distinct y) as n_rows, count(*) as n_pairs, min(v) as least_similarity from d where v >= 0.8 group by 1, 2, 3"""
_TOP = """with m as (select userId, itemId, max(score) as score from item_scores where isfinite(score) and userId is not null and itemId is not null group by 1, 2),
r as (select *, cast(row_number() over (partition by userId order by score desc, itemId) as integer) as rank from m)"""
P5_FOUND = f"{_TOP} select userId as user_key, itemId as item_key from r where rank <= 10"
P5_RANKED = f"{_TOP} select * from r where rank <= 10"


def _sample(keys: str, where: str) -> str:
    joined = " || '|' || ".join(keys.split(", "))
    return f"""with x as (select 'src' as dom, {key('userId')} as user_key, {key('itemId')} as item_key, batch_no from src_ratings
union all select 'tgt', {key('userId')}, {key('itemId')}, batch_no from tgt_ratings),
f as (select {keys}, min(coalesce(cast(batch_no as bigint), -1)) as first_batch from x where {where} group by {keys}),
s as (select *, row_number() over (order by first_batch, md5({joined}), {keys}) - 1 as seq from f)
select * from s where (cast(seq as hugeint) * {GOLDEN} + 123456789) % {1 << BITS} < {round(0.05 * (1 << BITS))}"""


P6_USERS = _sample("user_key", "user_key is not null")
P6_PAIRS = _sample("dom, user_key, item_key", "user_key is not null and item_key is not null")
_COUNTS = f"with k as (select {key('itemId')} as item_key from src_ratings union all select {key('itemId')} from tgt_ratings), c as (select item_key, count(*) as n_rows from k where item_key is not null group by 1)"
P7_FOUND = f"{_COUNTS} select item_key from c where n_rows * 1000 >= 3 * (select sum(n_rows) from c)"
P7_TOP = f"{_COUNTS} select item_key, n_rows from c order by n_rows desc, item_key limit 100"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND, "p4_found": P4_FOUND, "p4_report": P4_REPORT, "p5_found": P5_FOUND, "p5_ranked": P5_RANKED,
        "p6_users": P6_USERS, "p6_pairs": P6_PAIRS, "p7_found": P7_FOUND, "p7_top": P7_TOP,
        "p8_round_trip": "select doc_id, true as same from documents",
    }
