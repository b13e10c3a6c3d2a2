"""Configurations of the experiments."""

from __future__ import annotations

from dataclasses import dataclass, field

from crossweave.operators.metrics import Metric
from crossweave.operators.splits import LeaveOneOut, SplitStrategy


@dataclass(frozen=True)
class MfParams:
    n_factors: int
    learning_rate: float
    weight_decay: float
    batch_size: int


@dataclass(frozen=True)
class LtnParams(MfParams):
    p_axiom1: int = 2
    p_axiom2: int = 2
    p_sat: int = 2


# Tuned hyperparameters by data set, and by source and target.
SOURCE_MF = {
    "books": MfParams(200, 1.81e-4, 2.66e-4, 256),
    "movies": MfParams(200, 1.96e-4, 0.0800, 512),
    "music": MfParams(200, 4.04e-4, 0.0767, 512),
}
TARGET_LTN = {
    ("books", "movies"): LtnParams(200, 2.13e-4, 0.0927, 256, 7, 4, 2),
    ("movies", "music"): LtnParams(100, 2.60e-4, 0.0901, 256, 9, 2, 8),
    ("music", "movies"): LtnParams(100, 2.51e-4, 0.0609, 256, 6, 1, 8),
}
TARGET_MF = {"movies": MfParams(100, 6.86e-4, 0.0906, 512), "music": MfParams(200, 5.22e-4, 0.0999, 512)}


@dataclass(frozen=True)
class Experiment:
    """All that a run's results hang on; the cache key is made of it."""

    source: str
    target: str
    seed: int = 0
    sparsity_sh: float = 0.0
    source_split: SplitStrategy = field(default_factory=LeaveOneOut)
    target_split: SplitStrategy = field(default_factory=LeaveOneOut)
    source_mf: MfParams = SOURCE_MF["movies"]
    target_ltn: LtnParams = TARGET_LTN["movies", "music"]
    target_mf: MfParams = TARGET_MF["music"]
    epochs: int = 500
    patience: int = 5
    train_draws: int = 3
    eval_draws: int = 150
    eval_kept: int = 100
    metric: Metric = Metric.NDCG10

    def __post_init__(self):
        if not 0 <= self.sparsity_sh <= 1:
            raise ValueError("sparsity_sh, the share of shared users' rows that is kept, has to be between 0 and 1")


def mf_experiment(source: str, target: str, **changes) -> Experiment:
    """The configuration of the models without a transfer: any pair whose data sets have tuned parameters."""
    if source not in SOURCE_MF or target not in TARGET_MF:
        raise KeyError(f"no hyperparameters for {source} and {target}")
    seed = changes.get("seed", 0)
    return Experiment(source, target, **{"source_split": LeaveOneOut(seed), "target_split": LeaveOneOut(seed), "source_mf": SOURCE_MF[source], "target_mf": TARGET_MF[target], **changes})


def experiment(source: str, target: str, **changes) -> Experiment:
    """The tuned configuration of a registered pair; the seed also draws both splits, unless changes name others."""
    if (source, target) not in TARGET_LTN:
        raise KeyError(f"no hyperparameters for {source} to {target}")
    seed = changes.get("seed", 0)
    return Experiment(source, target, **{"source_split": LeaveOneOut(seed), "target_split": LeaveOneOut(seed), "source_mf": SOURCE_MF[source], "target_ltn": TARGET_LTN[source, target], "target_mf": TARGET_MF[target], **changes})
