"""Model quality as aggregates."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_error(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.withColumn("error", F.abs(F.col(label) - F.col(prediction)))


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """RMSE, MAE and R2 of the scored rows, in one pre-aggregated pass."""
    known = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    miss = F.col(label) - F.col(prediction)
    sums = known.agg(
        F.avg(miss * miss).alias("mse"),
        F.avg(F.abs(miss)).alias("mae"),
        F.var_pop(label).alias("variance"),
    )
    return sums.select(
        F.sqrt("mse").alias("rmse"),
        "mae",
        (1 - F.try_divide(F.col("mse"), F.col("variance"))).alias("r2"),
    )


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    return df.groupBy(label, prediction).count()


def binary_areas(df: DataFrame, label: str = "label", score: str = "score") -> dict[str, float]:
    """Exact areas under the ROC and precision-recall curves.

    ``numBins=0`` keeps every distinct score; scores are combined and range
    sorted across the cluster.
    """
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    evaluator = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score, numBins=0)
    return {
        "auc_roc": evaluator.setMetricName("areaUnderROC").evaluate(known),
        "auc_pr": evaluator.setMetricName("areaUnderPR").evaluate(known),
    }
