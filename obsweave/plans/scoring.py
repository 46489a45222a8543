"""Batch scoring of the newest feature row per station, with model provenance."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from obsweave.operators.keyed import NewestTable, read_days, upsert
from obsweave.operators.latest import newest_row
from obsweave.plans.training import Task, latest_entry, rain_task, temperature_task
from obsweave.schemas import MODEL_REGISTRY, PREDICTIONS

PREDICTION_KEYS = ("city", "source_timestamp", "horizon_hours")
# Ties on the prediction time go to the newest source row, then model version.
PREDICTION_TIES = ("source_timestamp", "temp_model_version", "rain_model_version")


def load_latest(
    spark: SparkSession, base: str, task: Task
) -> tuple[PipelineModel | None, Row | None]:
    """The newest saved model of a task and its registry row, or (None, None)."""
    registry = read_days(spark, f"{base.rstrip('/')}/model_registry", MODEL_REGISTRY)
    entry = latest_entry(registry, task.model_prefix).first() if registry is not None else None
    return (PipelineModel.load(entry.path), entry) if entry else (None, None)


def _complete(columns: list[str]) -> Column:
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return ~F.exists(values, lambda v: v.isNull() | F.isnan(v))


def _known(entry: Row | None, name: str) -> Column:
    return F.coalesce(F.lit(entry[name] if entry else None).cast("string"), F.lit("unknown"))


def score(
    rows: DataFrame,
    temp_model: PipelineModel | None = None,
    temp_entry: Row | None = None,
    rain_model: PipelineModel | None = None,
    rain_entry: Row | None = None,
    *,
    horizon: int = 1,
    as_of: Column | None = None,
) -> DataFrame:
    """Predictions of both models per row; null where a model or an input is missing."""
    models = {"predicted_temperature": temp_model, "predicted_rain": rain_model}
    inputs = {
        name: model.stages[0].getInputCols() for name, model in models.items() if model is not None
    }
    marked = rows.withColumn("observed_temperature", F.col("temperature")).withColumns(
        {f"_can_{name}": _complete(columns) for name, columns in inputs.items()}
    )
    used = sorted({c for columns in inputs.values() for c in columns})
    scored = marked.na.fill(0.0, subset=used) if used else marked
    for name, model in models.items():
        if model is None:
            scored = scored.withColumn(name, F.lit(None).cast("double"))
        else:
            known = F.when(F.col(f"_can_{name}"), F.col(name))
            scored = model.transform(scored).withColumn(name, known)
    return scored.select(
        "city",
        F.col("timestamp").alias("source_timestamp"),
        (F.current_timestamp() if as_of is None else as_of).alias("prediction_timestamp"),
        "predicted_temperature",
        "predicted_rain",
        "observed_temperature",
        F.lit(horizon).alias("horizon_hours"),
        _known(temp_entry, "model_name").alias("temp_model_name"),
        _known(temp_entry, "version").alias("temp_model_version"),
        _known(rain_entry, "model_name").alias("rain_model_name"),
        _known(rain_entry, "version").alias("rain_model_version"),
    )


def score_latest(spark: SparkSession, features: DataFrame, base: str, horizon: int = 1) -> DataFrame:
    """Score the newest row per station with the newest models.

    Without any model the result is empty.
    """
    temp_model, temp_entry = load_latest(spark, base, temperature_task(horizon))
    rain_model, rain_entry = load_latest(spark, base, rain_task(horizon))
    if temp_model is None and rain_model is None:
        return spark.createDataFrame([], PREDICTIONS)
    newest = newest_row(features)
    return score(newest, temp_model, temp_entry, rain_model, rain_entry, horizon=horizon)


def newest_predictions(path: str, keep: int = 24) -> NewestTable:
    """The newest ``keep`` predictions of every station, beside the table at ``path``."""
    return NewestTable(
        path.rstrip("/") + "_newest",
        time="prediction_timestamp",
        identity=PREDICTION_KEYS,
        order="prediction_timestamp",
        ties=PREDICTION_TIES,
        keep=keep,
    )


def save_predictions(predictions: DataFrame, path: str) -> None:
    """Keyed write: scoring the same rows again replaces their predictions.

    The newest of every station are kept beside the table as well.
    """
    upsert(
        predictions,
        path,
        keys=PREDICTION_KEYS,
        order="prediction_timestamp",
        time="source_timestamp",
        newest=[newest_predictions(path)],
    )
