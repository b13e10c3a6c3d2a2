"""One query for each operator of the recommendation pipeline, over the whole tables of a folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.functions.feedback import implicit
from crossweave.operators import indexing, logic, matrices, metrics, negatives, ranking, scoring, splits, transfer
from crossweave.operators.scale import table
from crossweave.plans.fixture import P_AXIOM1, P_AXIOM2, P_SAT, fixture, reg_batch
from crossweave.training import batches, sweep
from crossweave.training.steps import ltn_step, mf_step

BATCH = 256
SRC_COLUMNS = ("userId", "itemId", "rating")


def scan_ratings(spark, d):
    return fixture(spark, d).raw["src"].select(*SRC_COLUMNS)


def scan_kg_paths(spark, d):
    return fixture(spark, d).kg_paths


def implicit_feedback(spark, d):
    return fixture(spark, d).raw["src"].select("userId", "itemId", implicit(F.col("rating")).alias("r"))


def shared_users(spark, d):
    return fixture(spark, d).users["src"].where("is_shared").select("userId", "uid")


def exclusive_users(spark, d):
    f = fixture(spark, d)
    return reduce(DataFrame.unionByName, [f.users[x].where("not is_shared").select(F.lit(x).alias("domain"), "userId", "uid") for x in ("src", "tgt")])


def user_index_src(spark, d):
    return fixture(spark, d).users["src"]


def user_index_tgt(spark, d):
    return fixture(spark, d).users["tgt"]


def item_index(spark, d):
    return fixture(spark, d).items["src"]


def item_index_first_seen(spark, d):
    return indexing.item_index_first_seen(fixture(spark, d).raw["src"], "dt")


def item_universe(spark, d):
    return spark.range(fixture(spark, d).n_items["tgt"]).withColumnRenamed("id", "iid")


def ratings_indexed(spark, d):
    f = fixture(spark, d)
    return reduce(DataFrame.unionByName, [f.rated[x].select(F.lit(x).alias("domain"), "uid", "iid", "r") for x in ("src", "tgt")])


def dataset_stats(spark, d):
    f = fixture(spark, d)
    return reduce(DataFrame.unionByName, [indexing.dataset_stats(f.rated[x], f.n_shared, x) for x in ("src", "tgt")])


def split_leave_one_out(spark, d):
    return fixture(spark, d).split["src"]


def split_leave_last_out(spark, d):
    return splits.LeaveLastOut("dt").split(fixture(spark, d).rated["src"]).drop("dt")


def split_percent_user(spark, d):
    return splits.PercentSplit(0, 0.25, 0.2).split(fixture(spark, d).rated["src"].drop("dt"))


def split_percent_stratified(spark, d):
    return splits.PercentSplit(0, 0.25, 0.2, user_level=False).split(fixture(spark, d).rated["src"].drop("dt"))


def test_shared_only(spark, d):
    f = fixture(spark, d)
    return splits.only_shared(f.part("tgt", "test"), f.n_shared)


def train_no_shared(spark, d):
    return fixture(spark, d).thinned(0.0)


def train_all_shared(spark, d):
    return fixture(spark, d).thinned(1.0)


def train_thinned(spark, d):
    return fixture(spark, d).thinned(0.4)


def eval_positives(spark, d):
    return fixture(spark, d).positives.select("uid", F.col("pos_iid").alias("iid"))


def ui_matrix(spark, d):
    return fixture(spark, d).matrix["src"]


def ui_matrix_no_shared(spark, d):
    return fixture(spark, d).matrix_no_shared


def user_pos_counts(spark, d):
    return matrices.user_pos_counts(fixture(spark, d).matrix["src"])


def sim_pairs(spark, d):
    return fixture(spark, d).sim


def sim_missing_items(spark, d):
    f = fixture(spark, d)
    return f.missing_paths


def sim_adjacency(spark, d):
    return matrices.sim_adjacency(fixture(spark, d).sim)


def warm_users(spark, d):
    return fixture(spark, d).warm


def cold_users(spark, d):
    return fixture(spark, d).cold


def transfer_users(spark, d):
    f = fixture(spark, d)
    return transfer.transfer_users(f.warm, f.cold)


def mf_score(spark, d):
    f = fixture(spark, d)
    return f.score(f.part("src", "test").select("uid", "iid"), "src")


def mf_score_sigmoid(spark, d):
    return mf_score(spark, d).withColumn("score", F.round(scoring.sigmoid(F.col("score")), 6))


def src_scores(spark, d):
    """Scores of the first 2n items of warm users with n positives, the depth that the pipeline cuts from."""
    return fixture(spark, d).top_scores(2 * F.col("n_pos")).select("uid", "iid", "score")


def src_ranking(spark, d):
    return fixture(spark, d).ranking.select("uid", "iid", "rank")


def ndcg_curve(spark, d):
    f = fixture(spark, d)
    return ranking.ndcg_curve(f.ranking, f.warm, f.n_items["src"])


def best_k(spark, d):
    return ranking.best_k(ndcg_curve(spark, d), fixture(spark, d).warm)


def best_k_closed_form(spark, d):
    return fixture(spark, d).best


def src_topk(spark, d):
    return fixture(spark, d).top


def transfer_candidates(spark, d):
    return fixture(spark, d).candidates


def transfer_pairs(spark, d):
    """No target ratings of shared users are kept, so all warm ones are transfer users."""
    return fixture(spark, d).pairs


def transfer_pairs_retained(spark, d):
    """All target ratings are kept: users that are warm and cold, without the items they rated."""
    f = fixture(spark, d)
    users = transfer_users(spark, d)
    return transfer.transfer_pairs(f.candidates_of(users), f.matrix["tgt"].join(users, "uid", "left_semi"))


def reg_negative_candidates(spark, d):
    """Of every transfer user."""
    return fixture(spark, d).negatives_of()


def neg_draws(spark, d):
    return fixture(spark, d).draws()


def train_negatives(spark, d):
    return fixture(spark, d).train_negatives()


def eval_negatives(spark, d):
    return negatives.keep_best(fixture(spark, d).draws(), 100)


def eval_candidates(spark, d):
    return fixture(spark, d).scored_candidates


def eval_pairs(spark, d):
    if fixture(spark, d).few_vectors:
        return fixture(spark, d).ranks.select("uid", "pos_score", "neg_score")
    x = fixture(spark, d).scored_candidates
    return x.where("cand_pos <= 1").groupBy("uid", "pos_iid").agg(F.max(F.when(F.col("is_pos") == 1, F.col("score"))).alias("pos_score"), F.max(F.when(F.col("is_pos") == 0, F.col("score"))).alias("neg_score")).drop("pos_iid")


def ndcg_at_k(spark, d):
    return metrics.ndcg_at_k(fixture(spark, d).scored_candidates, 10)


def hit_at_k(spark, d):
    if fixture(spark, d).few_vectors:
        return fixture(spark, d).ranks.select("uid", "pos_iid", (F.col("rank") <= 10).cast("int").alias("value"))
    return metrics.hit_at_k(fixture(spark, d).scored_candidates, 10)


def auc_user_macro(spark, d):
    return metrics.auc_user_macro(eval_pairs(spark, d))


def eval_summary(spark, d):
    f = fixture(spark, d)
    return metrics.eval_summary(metrics.row_metrics(f.scored_candidates, 10), f.n_shared)


def dist_predicate(spark, d):
    x = fixture(spark, d).train_triples
    return x.select("uid", "pos_iid", "neg_iid", F.round(logic.truth(F.col("pos_score"), F.col("neg_score")), 6).alias("truth"))


def bpr_loss(spark, d):
    return fixture(spark, d).train_triples.agg(F.round(F.avg(logic.softplus_loss(F.col("pos_score"), F.col("neg_score"))), 6).alias("loss"))


def _forall(df, p):
    return df.agg(logic.forall(logic.truth(F.col("pos_score"), F.col("neg_score")), p).alias("sat"))


def forall_axiom1(spark, d):
    return _forall(fixture(spark, d).train_triples, P_AXIOM1).select(F.round("sat", 6).alias("sat"))


def forall_axiom2(spark, d):
    return _forall(fixture(spark, d).reg_triples, P_AXIOM2).select(F.round("sat", 6).alias("sat"))


def sat_agg(spark, d):
    f = fixture(spark, d)
    x = _forall(f.train_triples, P_AXIOM1).withColumn("b", _forall(f.reg_triples, P_AXIOM2).scalar())
    x = x.select(logic.sat_agg([F.col("sat"), F.col("b")], P_SAT).alias("sat"))
    return x.select(F.round("sat", 6).alias("sat"), F.round(1 - F.col("sat"), 6).alias("loss"))


def epoch_batches(spark, d):
    return batches.epoch_batches(fixture(spark, d).matrix["src"].select("uid", "iid"), BATCH, 0)


def epoch_batch_count(spark, d):
    return batches.batch_count(fixture(spark, d).matrix["src"], BATCH)


def reg_batch_query(spark, d):
    return reg_batch(fixture(spark, d), BATCH, 0)


def epoch_summary(spark, d):
    f = fixture(spark, d)
    parts = []
    for e in range(3):
        x = f.triples(f.train_negatives(e)) if e else f.train_triples
        b = batches.epoch_batches(f.matrix["tgt"].select("uid", "iid"), BATCH, e).select("uid", F.col("iid").alias("pos_iid"), "batch")
        parts.append(batches.epoch_summary(x.join(b, ["uid", "pos_iid"]), P_AXIOM1).select(F.lit(e).alias("epoch"), "loss", "sat"))
    return reduce(DataFrame.unionByName, parts)


def early_stop_trace(spark, d):
    """Days as epochs and the mean event value of a day as its score."""
    x = table(spark, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("score"))
    return logic.early_stop_trace(x, 5)


def seed_summary(spark, d):
    """Mean metrics over three seeds of the negative draws, of the model with and without biases."""
    f = fixture(spark, d)
    parts = []
    for seed in range(3):
        ranks = (f.ranks if seed == 0 else f._keep(f"ranks_{seed}", f.eval_ranks(seed))) if f.few_vectors else None
        for name, biased in (("biased", True), ("plain", False)):
            if ranks is None:
                c = f.scored_candidates if biased and seed == 0 else f.eval_candidates(seed, biased)
                rows = metrics.row_metrics(c, 10)
            else:
                rows = metrics.of_rank(ranks.select("uid", "pos_iid", F.col("rank" if biased else "plain_rank").alias("rank")), 10)
            parts.append(metrics.eval_summary(rows, f.n_shared).select(F.lit(name).alias("model"), "ndcg10", "ndcg10_shared"))
    x = reduce(DataFrame.unionByName, parts)
    return x.groupBy("model").agg(F.round(F.avg("ndcg10"), 5).alias("ndcg_all"), F.round(F.avg("ndcg10_shared"), 5).alias("ndcg_shared"))


def mf_train_step(spark, d):
    f = fixture(spark, d)
    return mf_step(f.train_negatives(), f.user_factors("tgt"), f.item_factors("tgt"))


def ltn_train_step(spark, d):
    f = fixture(spark, d)
    reg = reg_batch(f, BATCH, 0).selectExpr("reg_uid as uid", "reg_pos as pos_iid", "reg_neg as neg_iid")
    return ltn_step(f.train_negatives(), reg, f.user_factors("tgt"), f.item_factors("tgt"), P_AXIOM1, P_AXIOM2, P_SAT)


def sweep_trials(spark, d):
    return sweep.trials_frame(spark, sweep.trials(50, seed=0))


def queries():
    fs = (
        scan_ratings, scan_kg_paths, implicit_feedback, shared_users, exclusive_users, user_index_src, user_index_tgt, item_index, item_index_first_seen,
        item_universe, ratings_indexed, dataset_stats, split_leave_one_out, split_leave_last_out, split_percent_user, split_percent_stratified, test_shared_only,
        train_no_shared, train_all_shared, train_thinned, eval_positives, ui_matrix, ui_matrix_no_shared, user_pos_counts, sim_pairs, sim_missing_items,
        sim_adjacency, warm_users, cold_users, transfer_users, mf_score, mf_score_sigmoid, src_scores, src_ranking, ndcg_curve, best_k, best_k_closed_form,
        src_topk, transfer_candidates, transfer_pairs, transfer_pairs_retained, reg_negative_candidates, neg_draws, train_negatives, eval_negatives,
        eval_candidates, eval_pairs, ndcg_at_k, hit_at_k, auc_user_macro, eval_summary, dist_predicate, bpr_loss, forall_axiom1, forall_axiom2, sat_agg,
        epoch_batches, epoch_batch_count, epoch_summary, early_stop_trace, seed_summary, mf_train_step, ltn_train_step, sweep_trials,
    )
    return {**{f.__name__: f for f in fs}, "reg_batch": reg_batch_query}
