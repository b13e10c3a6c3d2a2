"""python -m crossweave --source NAME --target NAME --ratings NAME=CSV ... --paths JSONL --folder DIR: one experiment, the
mean over several seeds, or a search of hyperparameters."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from crossweave.operators.metrics import Metric
    from crossweave.pipeline import Pipeline, over_seeds
    from crossweave.sources.readers import read_paths, read_ratings
    from crossweave.sources.store import Store, config_key
    from crossweave.training.config import experiment, mf_experiment
    from crossweave.training.sweep import trials, tune, with_trial

    a = argparse.ArgumentParser(prog="crossweave", description=__doc__)
    a.add_argument("--source", required=True)
    a.add_argument("--target", required=True)
    a.add_argument("--ratings", required=True, action="append", metavar="NAME=CSV")
    a.add_argument("--paths", required=True, metavar="JSONL")
    a.add_argument("--folder", required=True)
    a.add_argument("--model", choices=("ltn", "axiom", "mf"), default="ltn")
    a.add_argument("--metric", choices=[m.value for m in Metric], default=Metric.NDCG10.value, help="what models are validated by")
    a.add_argument("--sparsity-sh", type=float, default=0.0)
    a.add_argument("--epochs", type=int, default=500)
    a.add_argument("--seeds", type=int, nargs="+", default=[0])
    a.add_argument("--tune", type=int, metavar="TRIALS", help="random search of so many trials, written as a table, instead of one experiment")
    a.add_argument("--tuned", choices=("source_model", "target_mf", "target_ltn"), default="target_ltn")
    a.add_argument("--clear", action="store_true")
    x = a.parse_args(argv)
    files = dict(r.split("=", 1) for r in x.ratings)
    spark = SparkSession.builder.appName("crossweave").getOrCreate()
    of_pair = mf_experiment if x.model == "mf" else experiment

    def pipeline(seed: int, trial: dict | None = None) -> Pipeline:
        config = of_pair(x.source, x.target, seed=seed, sparsity_sh=x.sparsity_sh, epochs=x.epochs, metric=Metric(x.metric))
        config = with_trial(config, x.tuned, trial) if trial else config
        return Pipeline(read_ratings(spark, files[x.source]), read_ratings(spark, files[x.target]), read_paths(spark, x.paths), config, x.folder, x.clear)

    if x.tune:
        store = Store(spark, f"{x.folder}/sweeps/{config_key(source=x.source, target=x.target, tuned=x.tuned, seed=x.seeds[0], trials=x.tune, epochs=x.epochs, metric=x.metric, sparsity=x.sparsity_sh)}")
        tune(lambda trial: pipeline(x.seeds[0], trial), x.tuned, trials(x.tune, x.seeds[0]), store).orderBy("score", ascending=False).show(x.tune, False)
        return
    over_seeds(pipeline, x.seeds, x.model).show(len(x.seeds) + 1, False)


if __name__ == "__main__":
    main()
