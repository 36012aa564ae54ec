"""Typed configuration with its checks, and YAML with one document for each class."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from .operators.boosting import SETTINGS
from .operators.estimators import MODELS, OF_CLASSES

FILTERS = ("none", "positive", "geq-average", "top-p-percentile")
AGGREGATIONS = ("mean", "loss-weighted-average", "rank-mean")
DRAWS = ("random", "stratified", "balanced", "per-population")
SELECTIONS = ("auto", "f_regression", "f_classif", "r_regression", "variance", "chi2", "mutual_info", "rfe", "percentile")
SCORERS = ("rocauc", "r2", "pearson_corr")


def one_of(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; it is {value!r}")


@dataclass(frozen=True)
class DataConfig:
    classification: bool
    maf_threshold: float = 0.0
    missingness_threshold: float = 0.05
    max_samples: int = 100_000
    max_features: int = 10_000
    draw: str = "random"
    fixed_draw: bool = False
    controls_per_case: int = 1
    scale_labels: bool = False
    outlier_threshold: float = 0.0

    def __post_init__(self):
        if not 0 <= self.maf_threshold <= 0.5 or not 0 <= self.missingness_threshold <= 1:
            raise ValueError("thresholds are shares; a minor allele's is at most a half")
        one_of("draw", self.draw, DRAWS)
        if self.controls_per_case < 1 or self.outlier_threshold < 0 or (self.scale_labels and self.classification):
            raise ValueError("controls_per_case is positive, outlier_threshold isn't negative, classes aren't scaled")
        if self.max_samples < 1 or self.max_features < 1:
            raise ValueError("a patch has samples and variants")


@dataclass(frozen=True)
class ModelConfig:
    model_name: str = "linear_l2"
    n_estimators: int = 128
    filter_strat: str = "none"
    agg_strat: str = "mean"
    p: float = 0.75
    temp: float = 0.5
    pos_thresh: float | None = None
    ensemble: tuple = ()
    class_loss: bool = False
    k_best: int = 0
    selection: str = "auto"

    def __post_init__(self):
        one_of("model_name", self.model_name, (*MODELS, *SETTINGS))
        for m in self.ensemble:
            one_of("ensemble", m, tuple(SETTINGS) if self.model_name in SETTINGS else tuple(MODELS))
        one_of("selection", self.selection, SELECTIONS)
        if self.k_best < 0:
            raise ValueError("k_best isn't negative")
        one_of("filter_strat", self.filter_strat, FILTERS)
        one_of("agg_strat", self.agg_strat, AGGREGATIONS)
        if self.n_estimators < 1 or self.temp <= 0 or not 0 <= self.p <= 1:
            raise ValueError("n_estimators and temp are positive, p is a share")

    @property
    def members(self) -> list[str]:
        """The base models of an estimator, all fitted on its patch; losses of classes where class_loss asks for them."""
        names = [self.model_name, *self.ensemble]
        return [OF_CLASSES.get(m, m) for m in names] if self.class_loss else names

    @property
    def trees(self) -> bool:
        return self.model_name in SETTINGS

    @property
    def needs_hold_out(self) -> bool:
        return self.filter_strat != "none" or self.agg_strat == "loss-weighted-average"

    def bar(self, classification: bool) -> float:
        return self.pos_thresh if self.pos_thresh is not None else 0.5 if classification else 0.0


@dataclass(frozen=True)
class TrainConfig:
    batch_size: int = 1
    patience: int = 0
    scorer: str | None = None
    seed: int = 22

    def __post_init__(self):
        if self.scorer is not None:
            one_of("scorer", self.scorer, SCORERS)
        if self.batch_size < 1 or self.patience < 0:
            raise ValueError("batch_size is positive, patience isn't negative")


@dataclass(frozen=True)
class Config:
    data: DataConfig
    model: ModelConfig = field(default_factory=ModelConfig)
    train: TrainConfig = field(default_factory=TrainConfig)

    def __post_init__(self):
        if not self.data.classification and self.scorer == "rocauc":
            raise ValueError("rocauc needs classes")
        if self.data.classification and self.scorer == "r2":
            raise ValueError("r2 needs a continuous label")

    @property
    def scorer(self) -> str:
        return self.train.scorer or ("rocauc" if self.data.classification else "r2")


def override(config: Config, **given) -> Config:
    """The configuration with fields of any class replaced; unknown fields are errors."""
    parts = [config.data, config.model, config.train]
    unknown = set(given) - {f.name for p in parts for f in fields(p)}
    if unknown:
        raise TypeError(f"no such fields: {', '.join(sorted(unknown))}")
    return Config(*[replace(p, **{k: v for k, v in given.items() if k in {f.name for f in fields(p)}}) for p in parts])


def load(text: str, **overrides) -> Config:
    """The first YAML document with a class's name as its key gives its fields; unknown fields are errors, a missing
    document leaves the defaults. Overrides name a field of any class."""
    import yaml

    documents = [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
    parts = []
    for cls in (DataConfig, ModelConfig, TrainConfig):
        given = next((d[cls.__name__] or {} for d in documents if cls.__name__ in d), {})
        parts.append(cls(**given))
    return override(Config(*parts), **overrides)
