"""Run settings: plain dataclasses of operator arguments (configuration, not a plan IR)."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.engineer import Feature
from ..operators.models import Candidate
from ..operators.problem import CLASSIFICATION, SCALE_SENSITIVE, Problem

# Fixed defaults (they must equal the reference's baseline settings).
TEST_SIZE = 0.2
SEED = 42
FOLDS = 5
CLASSIFICATION_POOL = ("logistic_regression", "random_forest", "gradient_boosting")
REGRESSION_POOL = ("linear_regression", "random_forest", "gradient_boosting")
CLASSIFICATION_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
REGRESSION_METRICS = ("mae", "mse", "rmse", "r2")


@dataclass
class SplitConfig:
    strategy: str = "stratified"  # random / stratified / time
    test_size: float = TEST_SIZE
    seed: int = SEED
    time_column: str | None = None


@dataclass
class SelectionConfig:
    method: str = "none"
    threshold: float | None = None
    max_features: int | None = None
    candidates: list[str] | None = None  # default: the problem's features

    def __post_init__(self):
        if self.method in ("mutual_info", "model") and self.max_features is None:
            raise ValueError(f"selection {self.method!r} needs max_features")


@dataclass
class RunConfig:
    split: SplitConfig = field(default_factory=SplitConfig)
    candidates: list[Candidate] = field(default_factory=list)
    features: list[Feature] = field(default_factory=list)
    selection: SelectionConfig = field(default_factory=SelectionConfig)
    folds: int = FOLDS
    metric: str = "f1"
    scale: bool | None = None  # None: scale when a candidate is scale sensitive
    prep_steps: list | None = None  # None: the recommended column actions
    default_grids: bool = True  # a candidate without a search gets its family's default grid


def default_config(problem: Problem, max_candidates: int | None = None, tier: str = "standard") -> RunConfig:
    """Stratified 80/20 for classification, random 80/20 for regression, seed 42, no
    selection; candidates logistic / linear, forest, boosting with 5 folds. The
    ``minimal`` tier (the reference's choice on a small machine) keeps the first two
    candidates and 3 folds."""
    if tier not in ("standard", "minimal"):
        raise ValueError(f"unknown tier {tier!r}")
    if max_candidates is None:
        max_candidates = 2 if tier == "minimal" else 3
    cls = problem.problem_type == CLASSIFICATION
    pool = CLASSIFICATION_POOL if cls else REGRESSION_POOL
    cands = [Candidate(f"model_{i + 1:03d}", fam, {} if fam == "linear_regression" else {"random_state": SEED})
             for i, fam in enumerate(pool[:max_candidates])]
    return RunConfig(
        split=SplitConfig("stratified" if cls else "random"),
        candidates=cands,
        metric=problem.metric,
        folds=3 if tier == "minimal" else FOLDS,
    )


def scale_sensitive(cfg: RunConfig) -> bool:
    return any(c.family in SCALE_SENSITIVE for c in cfg.candidates)
