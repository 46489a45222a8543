"""Model training: pipelines, grids, cross-validation, choice between families."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from obsweave.config import Grid, TrainingConfig
from obsweave.operators.metrics import binary_areas, regression_metrics
from obsweave.operators.split import hash_split, split_bucket
from obsweave.plans.features import KEYS, target_columns
from obsweave.schemas import MODEL_REGISTRY, TRAINING_RUNS
from obsweave.session import shared_dir


@dataclass(frozen=True)
class Task:
    """What a model predicts.  Intermediate columns carry the task's prefix, so
    two models can score the same rows."""

    prefix: str
    label: str
    output: str
    estimators: dict[str, type[Estimator]]
    grids: str
    horizon: int

    @property
    def model_prefix(self) -> str:
        return f"{self.prefix}_prediction_{self.horizon}h"


def temperature_task(horizon: int = 1) -> Task:
    return Task(
        "temp",
        target_columns(horizon)[0],
        "predicted_temperature",
        {
            "GradientBoostedTrees": GBTRegressor,
            "RandomForest": RandomForestRegressor,
            "LinearRegression": LinearRegression,
        },
        "regression_grids",
        horizon,
    )


def rain_task(horizon: int = 1) -> Task:
    return Task(
        "rain",
        target_columns(horizon)[1],
        "predicted_rain",
        {"GradientBoostedTrees": GBTClassifier, "RandomForest": RandomForestClassifier},
        "classification_grids",
        horizon,
    )


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    family: str
    task: Task
    validation_score: float
    metrics: dict[str, float]
    importances: list[tuple[str, float]]
    params: dict[str, str] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.task.model_prefix}_{self.family}"


def feature_columns(df: DataFrame, horizon: int = 1) -> list[str]:
    """Every numeric column but the keys and the targets."""
    excluded = {*KEYS, *target_columns(horizon)}
    return [
        f.name
        for f in df.schema.fields
        if f.name not in excluded and isinstance(f.dataType, NumericType)
    ]


def training_rows(features: DataFrame, horizon: int = 1) -> DataFrame:
    """Rows with every feature and both targets known, and only those columns."""
    wanted = [*feature_columns(features, horizon), *target_columns(horizon)]
    present = [c for c in wanted if c in features.columns]
    return features.select(*KEYS, *present).dropna("any", subset=present)


def build_pipeline(task: Task, estimator: type[Estimator], columns: list[str]) -> Pipeline:
    raw, scaled = f"{task.prefix}_features_raw", f"{task.prefix}_features"
    model = estimator(featuresCol=scaled, labelCol=task.label, predictionCol=task.output)
    if hasattr(model, "setRawPredictionCol"):
        model.setRawPredictionCol(f"{task.prefix}_raw_prediction")
        model.setProbabilityCol(f"{task.prefix}_probability")
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol=raw),
            StandardScaler(inputCol=raw, outputCol=scaled),
            model,
        ]
    )


def build_grid(estimator: Estimator, grid: Grid) -> list:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def task_evaluator(task: Task) -> Evaluator:
    if task.prefix == "temp":
        return RegressionEvaluator(
            labelCol=task.label, predictionCol=task.output, metricName="rmse"
        )
    return BinaryClassificationEvaluator(
        labelCol=task.label, rawPredictionCol=f"{task.prefix}_raw_prediction"
    )


def held_out_metrics(task: Task, scored: DataFrame) -> dict[str, float]:
    if task.prefix == "temp":
        return regression_metrics(scored, task.label, task.output).first().asDict()
    return binary_areas(scored, task.label, f"{task.prefix}_raw_prediction")


def importances(model: PipelineModel, top: int = 10) -> list[tuple[str, float]]:
    """The most important inputs: tree importances, or absolute coefficients."""
    columns, fitted = model.stages[0].getInputCols(), model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        weights = fitted.featureImportances.toArray()
    else:
        weights = abs(fitted.coefficients.toArray())
    ranked = sorted(zip(columns, map(float, weights)), key=lambda pair: -pair[1])
    return ranked[:top]


def best_params(
    pipeline: Pipeline, candidates: list, evaluator: Evaluator, rows: DataFrame, config: TrainingConfig
) -> dict:
    """The parameters with the best mean score over the folds that ``_fold`` marks."""
    totals = [0.0] * len(candidates)
    with ThreadPool(config.parallelism) as pool:
        for fold in range(config.folds):
            inside = rows.where(F.col("_fold") != fold).persist(StorageLevel.MEMORY_AND_DISK)
            held_out = rows.where(F.col("_fold") == fold).persist(StorageLevel.MEMORY_AND_DISK)
            models = pipeline.fitMultiple(inside, candidates)
            for place, model in pool.imap_unordered(lambda _, models=models: next(models), candidates):
                totals[place] += evaluator.evaluate(model.transform(held_out))
            inside.unpersist()
            held_out.unpersist()
    best = max(totals) if evaluator.isLargerBetter() else min(totals)
    return candidates[totals.index(best)]


def train(features: DataFrame, task: Task, config: TrainingConfig | None = None) -> Trained:
    """Cross-validate each family on the train part, choose on the validation part
    and measure on the test part.

    The parts and folds depend on row keys alone, so they repeat under any
    partitioning.
    """
    config = config or TrainingConfig()
    spark = features.sparkSession
    shared_dir(spark)  # boosted trees cut their lineage there
    rows = training_rows(features, task.horizon)
    columns = feature_columns(rows, task.horizon)
    shares = (config.train, config.validation, config.test)
    # Parts and folds hang on row keys alone; the table is read once for all.
    fold = split_bucket(*KEYS, seed=config.seed + 1, buckets=config.folds).cast("int").alias("_fold")
    rows = rows.select(*KEYS, *columns, task.label, fold).persist(StorageLevel.MEMORY_AND_DISK)
    train_part, validation_part, test_part = [
        part.persist(StorageLevel.MEMORY_AND_DISK) for part in hash_split(rows, shares, KEYS, config.seed)
    ]
    evaluator = task_evaluator(task)
    best: tuple[float, str, PipelineModel, dict[str, str]] | None = None
    try:
        for family, grid in getattr(config, task.grids).items():
            pipeline = build_pipeline(task, task.estimators[family], columns)
            candidates = build_grid(pipeline.getStages()[-1], grid)
            model = pipeline.fit(train_part, best_params(pipeline, candidates, evaluator, train_part, config))
            score = evaluator.evaluate(model.transform(validation_part))
            better = best is None or (
                score > best[0] if evaluator.isLargerBetter() else score < best[0]
            )
            if better:
                fitted = model.stages[-1]
                chosen = {name: str(fitted.getOrDefault(name)) for name in grid}
                best = (score, family, model, chosen)
        score, family, model, chosen = best
        metrics = held_out_metrics(task, model.transform(test_part))
    finally:
        for part in (rows, train_part, validation_part, test_part):
            part.unpersist()
    return Trained(model, family, task, score, metrics, importances(model), chosen)


# --- registry and ledger -------------------------------------------------


def _append_row(spark: SparkSession, row: Row, schema, path: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def save_model(trained: Trained, base: str, now: datetime | None = None) -> Row:
    """Write the pipeline below ``base`` and append its registry row."""
    now = now or datetime.now(timezone.utc)
    version = now.strftime("%Y%m%d_%H%M%S")
    # Two trainings in one second share a version, not a place.
    path = f"{base.rstrip('/')}/models/{trained.name}_{version}_{uuid.uuid4().hex[:8]}"
    trained.model.write().overwrite().save(path)
    entry = Row(
        model_name=trained.name,
        model_type=type(trained.model).__name__,
        path=path,
        timestamp=now,
        version=version,
    )
    _append_row(SparkSession.active(), entry, MODEL_REGISTRY, f"{base.rstrip('/')}/model_registry")
    return entry


def log_run(
    trained: Trained,
    base: str,
    config: TrainingConfig,
    model_path: str | None = None,
    now: datetime | None = None,
) -> None:
    """Append parameters, metrics and importances of a run to the ledger."""
    now = now or datetime.now(timezone.utc)
    kind = {"temp": "temperature", "rain": "rain"}[trained.task.prefix]
    row = Row(
        run_name=f"{trained.task.prefix}_{trained.family}_{now.strftime('%Y%m%d_%H%M%S')}",
        model_type=kind,
        model_name=trained.family,
        horizon_hours=trained.task.horizon,
        logged_at=now,
        params={
            "model_algorithm": trained.family,
            "horizon_hours": str(trained.task.horizon),
            "train_ratio": str(config.train),
            "cv_folds": str(config.folds),
            **trained.params,
        },
        metrics={k: float(v) for k, v in trained.metrics.items()},
        importances=[Row(feature=f, weight=w) for f, w in trained.importances],
        model_path=model_path,
    )
    _append_row(SparkSession.active(), row, TRAINING_RUNS, f"{base.rstrip('/')}/training_runs")


def latest_entry(registry: DataFrame, prefix: str) -> DataFrame:
    """The newest registry row whose model name starts with ``prefix``."""
    named = registry.where(F.col("model_name").startswith(prefix))
    return named.orderBy(F.col("timestamp").desc(), F.col("version").desc()).limit(1)


def train_and_save(
    features: DataFrame,
    base: str,
    tasks: Iterable[Task] | None = None,
    config: TrainingConfig | None = None,
) -> list[Trained]:
    """The training job: every task is trained, saved and logged."""
    config = config or TrainingConfig()
    done = []
    for task in tasks or (temperature_task(), rain_task()):
        trained = train(features, task, config)
        entry = save_model(trained, base)
        log_run(trained, base, config, entry.path)
        done.append(trained)
    return done
