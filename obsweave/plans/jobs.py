"""The batch jobs end to end, over table paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from obsweave.config import FeatureConfig, TrainingConfig
from obsweave.operators.keyed import DAY, read_days
from obsweave.operators.latest import on_newest_days
from obsweave.plans import scoring, training
from obsweave.plans.features import usable_rows
from obsweave.plans.incremental import derive_features, refresh_features
from obsweave.sources.tables import flatten, observed, read_features, read_raw


def flat_observations(spark: SparkSession, raw_path: str) -> DataFrame:
    """Flat rows with a city and a usable time; the partition column stays, so days prune."""
    flat = flatten(observed(read_raw(spark, raw_path)), DAY)
    return flat.dropna(subset=["city", "timestamp"])


def run_features(
    spark: SparkSession, raw_path: str, features_path: str, config: FeatureConfig | None = None
) -> dict[str, int]:
    """Derive the whole feature table in one write; returns its rows, and those of
    them that are usable.

    Every row is stored, so that a correction can replace any of them; readers
    take the usable ones.
    """
    seen = derive_features(flat_observations(spark, raw_path), features_path, config)
    return {"derived": seen["rows"], "usable": seen["usable"]}


def run_refresh(
    spark: SparkSession,
    raw_path: str,
    changed: DataFrame,
    features_path: str,
    config: FeatureConfig | None = None,
) -> None:
    """Bring the feature table up to date with the written keys in ``changed``."""
    refresh_features(flat_observations(spark, raw_path), changed, features_path, config)


def run_training(
    spark: SparkSession, features_path: str, base: str, config: TrainingConfig | None = None
) -> list[training.Trained]:
    features = usable_rows(read_features(spark, features_path))
    return training.train_and_save(features, base, config=config)


def run_scoring(
    spark: SparkSession, features_path: str, base: str, predictions_path: str, horizon: int = 1
) -> int:
    """Score the newest rows and keep the predictions; returns how many were written."""
    saved = read_days(spark, features_path)
    if saved is None:
        return 0
    features = on_newest_days(usable_rows(saved)).drop(DAY)
    scored = scoring.score_latest(spark, features, base, horizon)
    scored = scored.persist()  # one row per station, used by the count and the write
    try:
        written = scored.count()
        if written:
            scoring.save_predictions(scored, predictions_path)
        return written
    finally:
        scored.unpersist()
