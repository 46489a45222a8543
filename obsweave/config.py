"""Feature and training settings.  Every value is an argument; these are the defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureConfig:
    rolling_hours: tuple[int, ...] = (6, 12, 24)
    lag_rows: tuple[int, ...] = (1, 2, 3, 6, 12)
    rain_sum_hours: int = 6
    horizon: int = 1
    # One series is cut into buckets of this length, so a station that holds
    # most of the table is still spread over many tasks.
    bucket_hours: int = 168
    # How rolling statistics are computed: "sliding" frames share the one sort of
    # all windows and cost rows x rows-in-frame; "split" frames take
    # one more sort and arrays and are linear in rows, for dense stations.
    # The two round differently in the last digits, so a feature table keeps to
    # one of them; nothing in the data changes it.
    frames: str = "sliding"
    # "hour" keeps the last row of each station and hour, so that lags, which
    # count rows, count hours where live polls mix with hourly history.
    resample: str | None = None

    def __post_init__(self):
        if self.horizon < 1 or min(self.lag_rows, default=1) < 1:
            raise ValueError("horizon and lags must be positive")
        if self.frames not in ("sliding", "split") or self.resample not in (None, "hour"):
            raise ValueError("frames are sliding or split, resample is None or hour")
        if self.bucket_hours < self.longest_frame:
            raise ValueError("bucket_hours must cover the longest rolling frame")

    @property
    def longest_frame(self) -> int:
        return max((*self.rolling_hours, self.rain_sum_hours))


Grid = Mapping[str, Sequence]

# Parameter grids per model family.
REGRESSION_GRIDS: Mapping[str, Grid] = {
    "GradientBoostedTrees": {"maxDepth": [5, 7, 10], "maxIter": [50, 100], "stepSize": [0.1, 0.05]},
    "RandomForest": {
        "numTrees": [50, 100, 150],
        "maxDepth": [5, 10, 15],
        "minInstancesPerNode": [1, 5],
    },
    "LinearRegression": {"elasticNetParam": [0.0, 0.5, 1.0], "regParam": [0.01, 0.1]},
}
CLASSIFICATION_GRIDS: Mapping[str, Grid] = {
    "GradientBoostedTrees": {"maxDepth": [5, 7, 10], "maxIter": [50, 100], "stepSize": [0.1, 0.05]},
    "RandomForest": {
        "numTrees": [50, 100, 150],
        "maxDepth": [5, 10, 15],
        "minInstancesPerNode": [1, 5],
    },
}


@dataclass(frozen=True)
class TrainingConfig:
    train: float = 0.6
    validation: float = 0.2
    test: float = 0.2
    folds: int = 3
    seed: int = 42
    parallelism: int = 4
    regression_grids: Mapping[str, Grid] = field(default_factory=lambda: REGRESSION_GRIDS)
    classification_grids: Mapping[str, Grid] = field(default_factory=lambda: CLASSIFICATION_GRIDS)

    def __post_init__(self):
        if abs(self.train + self.validation + self.test - 1.0) > 1e-9:
            raise ValueError("split shares must add up to 1")
