"""SQL of the pipeline queries: each is a chain of common table expressions over the base tables."""

from __future__ import annotations

from crossweave.plans.fixture import DRAWS, GLOBAL_BIAS, KEPT, P_AXIOM1, P_AXIOM2, P_SAT, SRC_LACKS, SRC_TYPES, TGT_LACKS, TRAIN_DRAWS

_TYPES = ", ".join(f"'{t}'" for t in SRC_TYPES)


def _hash(salt: str, *ids: str, seed: int = 0) -> str:
    """As functions.hashing.seeded_hash."""
    return f"cast('0x' || substr(md5('{seed}|{salt}|' || " + " || '|' || ".join(ids or ("uid", "iid")) + "), 1, 15) as bigint)"


def _domain(d: str, cond: str, lacks: int) -> list[tuple[str, str]]:
    other = "tgt" if d == "src" else "src"
    return [
        (f"users_{d}", f"select u as userId, row_number() over (order by sh desc, u) - 1 as uid, sh as is_shared from (select distinct userId as u, userId in (select userId from raw_{other}) as sh from raw_{d})"),
        (f"items_{d}", f"select itemId, row_number() over (order by itemId) - 1 as iid from (select distinct itemId from raw_{d})"),
        (f"rated_{d}", f"select uid, iid, cast(case when rating >= 4 and not isnan(rating) then 1 else 0 end as integer) as r, dt from raw_{d} join users_{d} using (userId) join items_{d} using (itemId)"),
        (f"split_{d}", _loo(f"rated_{d}", f"{_hash('split')}, iid")),
        (f"matrix_{d}", f"select uid, iid, cast(sum(r) as bigint) as cnt from split_{d} where r = 1 and split = 'train' group by 1, 2"),
    ]


def _loo(source: str, order: str) -> str:
    return f"""select uid, iid, r, case when r = 1 and rn = 1 and n >= 2 then 'test' when r = 1 and rn = 2 and n >= 3 then 'val' else 'train' end as split
from (select *, row_number() over (partition by uid, r order by {order}) as rn, count(*) over (partition by uid, r) as n from {source})"""


def _factor(d: str, kind: str) -> str:
    key = "uid" if kind == "users" else "iid"
    at = f"{key} % (select count(*) from embeddings)" if kind == "users" else f"({key} * 7 + 3) % (select count(*) from embeddings)"
    return f"select {key}, cast(embedding as double[]) as v, (({key} * 37) % 101) / 1000.0::double as b from (select distinct {key} from {kind}_{d}) join embeddings on vec_id = {at}"


def _scored(pairs: str, d: str, biased: bool = True, item: str = "iid", out: str = "score") -> str:
    bias = f" + u.b + i.b + {GLOBAL_BIAS}" if biased else ""
    return f"select p.*, round(list_dot_product(u.v, i.v){bias}, 6) as {out} from {pairs} p join uf_{d} u on u.uid = p.uid join if_{d} i on i.iid = p.{item}"


def _draws(positives: str, seed: int, m: int) -> str:
    n = "(select count(*) from items_tgt)"
    return f"""select d.uid, pos_iid, cast(draw as integer) as draw, iid, cast(m.uid is not null as integer) as is_false from (
select uid, pos_iid, draw, {_hash('draw', 'uid', 'pos_iid', 'draw', seed=seed)} % {n} as iid
from {positives}, range({m}) t(draw)) d left join matrix_tgt m using (uid, iid)"""


def _candidates(seed: int, biased: bool) -> str:
    return _scored(f"""(select uid, pos_iid, 0 as cand_pos, pos_iid as iid, 1 as is_pos from positives union all select uid, pos_iid, slot, iid, 0 from
(select *, cast(row_number() over (partition by uid, pos_iid order by is_false, draw) as integer) as slot from ({_draws('positives', seed, DRAWS)})) where slot <= {KEPT})""", "tgt", biased)


def _first_true(seed: int) -> str:
    return f"select uid, pos_iid, arg_min(iid, is_false * 1000 + draw) as neg_iid, min(is_false) as is_false from ({_draws('train_positives', seed, TRAIN_DRAWS)}) group by 1, 2"


def _triples(of: str) -> str:
    return f"select a.*, round(list_dot_product(u.v, q.v) + u.b + q.b + {GLOBAL_BIAS}, 6) as neg_score from ({_scored(of, 'tgt', True, 'pos_iid', 'pos_score')}) a join uf_tgt u on u.uid = a.uid join if_tgt q on q.iid = a.neg_iid"


def _summary(candidates: str) -> str:
    return f"""select count(*) as n_rows, avg(g) as ndcg10, avg(h) as hr10, avg(g) filter (uid < (select n from shared)) as ndcg10_shared, avg(h) filter (uid < (select n from shared)) as hr10_shared
from (select uid, case when rank <= 10 then 1 / log2(rank + 1) else 0 end as g, cast(rank <= 10 as integer) as h
from (select *, row_number() over (partition by uid, pos_iid order by score desc, cand_pos) as rank from ({candidates})) where is_pos = 1)"""


def _sat(of: str, p: int) -> str:
    return f"select 1 - pow(avg(pow(1 - 1 / (1 + exp(-(pos_score - neg_score))), {p})), 1.0 / {p}) as sat from {of}"


def _softplus(d: str) -> str:
    return f"(ln(1 + exp(-abs({d}))) + greatest(-({d}), 0))"


def _percent(part: str, quota: str, any_: str) -> str:
    return f"""select uid, iid, r, case when not {any_} then 'train' when rn <= qt then 'test' when rn <= qt + qv then 'val' else 'train' end as split from (
select *, {quota.format(n='n - qt', f=0.25)} as qv from (select *, {quota.format(n='n', f=0.2)} as qt from (
select uid, iid, r, row_number() over (partition by {part} order by {_hash('split')}, uid, iid) as rn, count(*) over (partition by {part}) as n, max(r) over (partition by uid) = 1 as has from rated_src)))"""


_SIDE = "select 'A' || lpad(cast(p_partkey as varchar), 9, '0') as n{0}_asin, p_brand, p_size from part where p_type {1} in ({2})"
CTES: list[tuple[str, str]] = [
    ("interactions", "select o_custkey as c, l_partkey as p, max(least(5, 2 + floor(l_quantity / 10))) as rating, max(o_orderdate) as dt from lineitem join orders on l_orderkey = o_orderkey group by 1, 2"),
    *[(f"raw_{d}", f"select c_name as userId, 'A' || lpad(cast(p as varchar), 9, '0') as itemId, cast(rating as double) as rating, dt from interactions join part on p = p_partkey join customer on c = c_custkey where p_type {neg} in ({_TYPES}) and c % 10 <> {lacks}")
      for d, neg, lacks in (("src", "", SRC_LACKS), ("tgt", "not", TGT_LACKS))],
    *_domain("src", "", SRC_LACKS), *_domain("tgt", "not", TGT_LACKS),
    ("shared", "select count(*) as n from users_src where is_shared"),
    ("kg", f"select distinct n1_asin, n2_asin from ({_SIDE.format(1, '', _TYPES)}) a join ({_SIDE.format(2, 'not', _TYPES)}) b on a.p_brand = b.p_brand and abs(a.p_size - b.p_size) <= 5"),
    ("simt", "select distinct a.iid as src_iid, b.iid as tgt_iid from kg join items_src a on a.itemId = n1_asin join items_tgt b on b.itemId = n2_asin"),
    ("warm", "select uid, count(*) as n_pos from matrix_src where uid < (select n from shared) group by 1 having count(*) > 15"),
    ("cold", "select u.uid, count(m.uid) as n_pos from (select uid from users_tgt where is_shared) u left join matrix_tgt m on m.uid = u.uid group by 1 having count(m.uid) <= 5"),
    *[(f"{k[0]}f_{d}", _factor(d, k)) for k in ("users", "items") for d in ("src", "tgt")],
    ("scores", _scored("(select uid, iid, n_pos from warm, items_src)", "src", False)),
    ("ranks", "select *, cast(row_number() over (partition by uid order by score desc, iid) as integer) as rank from scores"),
    ("rels", "select k.uid, k.iid, k.rank, k.n_pos, cast(m.uid is not null as integer) as rel from ranks k left join matrix_src m on m.uid = k.uid and m.iid = k.iid where rank <= 2 * n_pos"),
    ("curve", """select uid, rank as k, round(g / greatest(i, 2.220446049250313e-16), 6) as ndcg, n_pos from (
select *, sum(rel / log2(rank + 1)) over w as g, sum(case when rank <= n_pos then 1 / log2(rank + 1) else 0 end) over w as i from rels window w as (partition by uid order by rank)) where rank >= n_pos"""),
    ("best", "select uid, n_pos, cast(greatest(n_pos, coalesce(max(case when rel > 0 then rank end), 0)) as integer) as best_k from rels group by 1, 2"),
    ("topk", "select r.uid, r.iid, r.rank from rels r join best b on b.uid = r.uid where rank <= best_k"),
    ("cand", "select distinct uid, tgt_iid as iid from topk join simt on iid = src_iid"),
    ("positives", "select uid, iid as pos_iid from split_tgt where split = 'test' and r > 0"),
    ("train_positives", "select uid, iid as pos_iid from split_tgt where split = 'train' and r > 0"),
    ("cands", _candidates(0, True)),
    ("negs", _first_true(0)),
    ("triples", _triples("negs")),
    ("reg_users", f"select distinct uid from cand order by {_hash('axiom', 'uid')}, uid limit 256"),
    ("reg_neg", "select uid, iid from reg_users, items_tgt where (uid, iid) not in (select uid, iid from cand union all select uid, iid from matrix_tgt where uid >= (select n from shared))"),
    ("reg", f"""select a.uid, pos_iid, neg_iid from (select uid, arg_min(iid, {_hash('axiom')}) as pos_iid from cand where uid in (select uid from reg_users) group by 1) a
join (select uid, arg_min(iid, {_hash('axiom')}) as neg_iid from reg_neg group by 1) b on a.uid = b.uid"""),
    ("reg_triples", _triples("reg")),
]


def _needed(body: str) -> list[tuple[str, str]]:
    """The expressions that a query needs, in order."""
    import re

    text, used = body, []
    for name, sql in reversed(CTES):
        if re.search(rf"\b{name}\b", text):
            used.append((name, sql))
            text += " " + sql
    return used[::-1]


def _query(body: str) -> str:
    ctes = _needed(body)
    return ("with " + ",\n".join(f"{n} as ({s})" for n, s in ctes) + "\n" if ctes else "") + body


_QUOTA = "(case when {n} > 1 then greatest(1, floor(({n}) * {f})) else 0 end)"
_THIN = f"select uid, iid, r from (select *, row_number() over (partition by uid order by {_hash('thin')}, uid, iid) as rn, count(*) over (partition by uid) as n from split_tgt where split = 'train') where uid >= (select n from shared)"
_SHARED_ONLY = "uid < (select n from shared)"
BODIES = {
    "scan_ratings": "select userId, itemId, rating from raw_src",
    "scan_kg_paths": "select n1_asin, n2_asin from kg",
    "implicit_feedback": "select userId, itemId, cast(case when rating >= 4 then 1 else 0 end as integer) as r from raw_src",
    "shared_users": "select userId, uid from users_src where is_shared",
    "exclusive_users": "select 'src' as domain, userId, uid from users_src where not is_shared union all select 'tgt', userId, uid from users_tgt where not is_shared",
    "user_index_src": "select * from users_src",
    "user_index_tgt": "select * from users_tgt",
    "item_index": "select * from items_src",
    "item_index_first_seen": "select itemId, row_number() over (order by f, itemId) - 1 as iid from (select itemId, min(dt) as f from raw_src group by 1)",
    "item_universe": "select range as iid from range((select count(*) from items_tgt))",
    "ratings_indexed": "select 'src' as domain, uid, iid, r from rated_src union all select 'tgt', uid, iid, r from rated_tgt",
    "dataset_stats": "select 'src' as domain, count(distinct uid) as n_users, count(distinct iid) as n_items, (select n from shared) as n_shared from rated_src union all select 'tgt', count(distinct uid), count(distinct iid), (select n from shared) from rated_tgt",
    "split_leave_one_out": "select * from split_src",
    "split_leave_last_out": _loo("rated_src", "dt desc, iid desc"),
    "split_percent_user": _percent("uid, r", _QUOTA, "has"),
    "split_percent_stratified": _percent("r", "floor(({n}) * {f})", "true"),
    "test_shared_only": f"select uid, iid, r from split_tgt where split = 'test' and {_SHARED_ONLY}",
    "train_no_shared": "select uid, iid, r from split_tgt where split = 'train' and uid >= (select n from shared)",
    "train_all_shared": "select uid, iid, r from split_tgt where split = 'train'",
    "train_thinned": f"{_THIN} or rn <= round_even(0.4 * n, 0)",
    "eval_positives": "select uid, pos_iid as iid from positives",
    "ui_matrix": "select * from matrix_src",
    "ui_matrix_no_shared": "select * from matrix_tgt where uid >= (select n from shared)",
    "user_pos_counts": "select uid, count(*) as n_pos from matrix_src group by 1",
    "sim_pairs": "select * from simt",
    "sim_missing_items": "select n1_asin, n2_asin from kg where n1_asin not in (select itemId from items_src) or n2_asin not in (select itemId from items_tgt)",
    "sim_adjacency": "select src_iid, count(*) as n_tgt, string_agg(cast(tgt_iid as varchar), ',' order by tgt_iid) as tgt_iids from simt group by 1",
    "warm_users": "select * from warm",
    "cold_users": "select * from cold",
    "transfer_users": "select uid from warm where uid in (select uid from cold)",
    "mf_score": _scored("(select uid, iid from split_src where split = 'test')", "src"),
    "mf_score_sigmoid": f"select uid, iid, round(1 / (1 + exp(-score)), 6) as score from ({_scored(chr(40) + 'select uid, iid from split_src where split = ' + chr(39) + 'test' + chr(39) + chr(41), 'src')})",
    "src_scores": "select uid, iid, score from ranks where rank <= 2 * n_pos",
    "src_ranking": "select uid, iid, rank from rels",
    "ndcg_curve": "select uid, k, ndcg from curve",
    "best_k": "select uid, n_pos, cast(k as integer) as best_k from (select *, row_number() over (partition by uid order by ndcg desc, k) as o from curve) where o = 1",
    "best_k_closed_form": "select * from best",
    "src_topk": "select * from topk",
    "transfer_candidates": "select * from cand",
    "transfer_pairs": "select * from cand",
    "transfer_pairs_retained": "select uid, iid from cand where uid in (select uid from cold) and (uid, iid) not in (select uid, iid from matrix_tgt)",
    "reg_negative_candidates": "select uid, iid from (select distinct uid from cand), items_tgt where (uid, iid) not in (select uid, iid from cand)",
    "neg_draws": _draws("positives", 0, DRAWS),
    "train_negatives": "select * from negs",
    "eval_negatives": f"select uid, pos_iid, slot, iid from (select *, cast(row_number() over (partition by uid, pos_iid order by is_false, draw) as integer) as slot from ({_draws('positives', 0, DRAWS)})) where slot <= {KEPT}",
    "eval_candidates": "select * from cands",
    "eval_pairs": "select uid, pos_score, neg_score from (select uid, pos_iid, max(case when is_pos = 1 then score end) as pos_score, max(case when is_pos = 0 then score end) as neg_score from cands where cand_pos <= 1 group by 1, 2)",
    "ndcg_at_k": "select uid, pos_iid, round(max(case when is_pos = 1 and rank <= 10 then 1 / log2(rank + 1) else 0 end), 6) as value from (select *, row_number() over (partition by uid, pos_iid order by score desc, cand_pos) as rank from cands) group by 1, 2",
    "hit_at_k": "select uid, pos_iid, cast(max(case when rank <= 10 then is_pos else 0 end) as integer) as value from (select *, row_number() over (partition by uid, pos_iid order by score desc, cand_pos) as rank from cands) group by 1, 2",
    "auc_user_macro": "select round(avg(a), 6) as auc from (select uid, avg(cast(p > n as integer)) as a from (select uid, pos_iid, max(case when is_pos = 1 then score end) as p, max(case when is_pos = 0 then score end) as n from cands where cand_pos <= 1 group by 1, 2) group by 1)",
    "eval_summary": f"select n_rows, round(ndcg10, 6) as ndcg10, round(hr10, 6) as hr10, round(ndcg10_shared, 6) as ndcg10_shared, round(hr10_shared, 6) as hr10_shared from ({_summary('select * from cands')})",
    "dist_predicate": "select uid, pos_iid, neg_iid, round(1 / (1 + exp(-(pos_score - neg_score))), 6) as truth from triples",
    "bpr_loss": f"select round(avg({_softplus('pos_score - neg_score')}), 6) as loss from triples",
    "forall_axiom1": f"select round(sat, 6) as sat from ({_sat('triples', P_AXIOM1)})",
    "forall_axiom2": f"select round(sat, 6) as sat from ({_sat('reg_triples', P_AXIOM2)})",
    "sat_agg": f"select round(s, 6) as sat, round(1 - s, 6) as loss from (select 1 - pow((pow(1 - a.sat, {P_SAT}) + pow(1 - b.sat, {P_SAT})) / 2, 1.0 / {P_SAT}) as s from ({_sat('triples', P_AXIOM1)}) a, ({_sat('reg_triples', P_AXIOM2)}) b)",
    "epoch_batches": f"select uid, iid, (row_number() over (order by {_hash('batch 0')}, uid, iid) - 1) // 256 as batch from matrix_src",
    "epoch_batch_count": "select cast(ceil(count(*) / 256) as bigint) as n_batches from matrix_src",
    "reg_batch": "select uid as reg_uid, pos_iid as reg_pos, neg_iid as reg_neg from reg",
    "epoch_summary": " union all ".join(
        f"""select {e} as epoch, round(avg(l), 6) as loss, round(avg(s), 6) as sat from (select batch, avg({_softplus('pos_score - neg_score')}) as l, 1 - pow(avg(pow(1 - 1 / (1 + exp(-(pos_score - neg_score))), {P_AXIOM1})), 1.0 / {P_AXIOM1}) as s
from ({_triples(f'({_first_true(e)})')}) t join (select uid, iid as pos_iid, (row_number() over (order by {_hash(f'batch {e}')}, uid, iid) - 1) // 256 as batch from matrix_tgt) b using (uid, pos_iid) group by 1)"""
        for e in range(3)
    ),
    "early_stop_trace": """select epoch, score, best_so_far, flat_epochs, stopped from (select *, flat_epochs > 5 as stopped, min(case when flat_epochs > 5 then epoch end) over () as stop from (
select epoch, score, best_so_far, cast(n - max(case when up then n end) over (order by epoch) as integer) as flat_epochs from (
select *, row_number() over (order by epoch) as n, best_so_far > coalesce(lag(best_so_far) over (order by epoch), -1e308) as up from (
select *, max(score) over (order by epoch) as best_so_far from (select cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as epoch, round(avg(value), 6) as score from events group by 1))))) where stop is null or epoch <= stop""",
    "seed_summary": "select model, round(avg(ndcg10), 5) as ndcg_all, round(avg(ndcg10_shared), 5) as ndcg_shared from (" + " union all ".join(
        f"select '{name}' as model, round(ndcg10, 6) as ndcg10, round(ndcg10_shared, 6) as ndcg10_shared from ({_summary(_candidates(seed, biased))})" for name, biased in (("biased", True), ("plain", False)) for seed in range(3)
    ) + ") group by 1",
}


def oracle_sql() -> dict[str, str]:
    return {name: _query(body) for name, body in BODIES.items()}
