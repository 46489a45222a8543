"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Logistic models, one a flaw, give each document its evidence, from the style of
the text and from telling words.  Expected numbers of good documents are summed over all
documents by path and by host; a path's rate is shrunk toward its host's and a
host's toward the whole corpus', by strengths estimated from how much rates
really differ.  The site's rate against the corpus' shifts a document's log odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.llm import wordhash
from obsweave.llm.common import kept, release_arrow_memory, whole_text
from obsweave.operators.ranking import free_name

SAMPLE = 8_000  # labelled documents that a fit takes at most
BINS = 1 << 18  # hashed words
TELLING = 640  # bins that the model of a flaw may weigh
SURE = 3.0  # standard errors that a telling bin differs by
RIDGE = 0.3
BROADCAST_PATHS = 100_000  # beyond, verdicts join by shuffle
SCORED = 500  # texts whose features a task holds at once
MARGIN = 12.0  # evidence is held within this many log odds

_KINDS = np.zeros(256, np.int64)  # other
for _kind, _bytes in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:'\"?()-", b"!"), 1
):
    _KINDS[list(_bytes)] = _kind
_KINDS[128:] = 7


def _style(text: str, hashes: np.ndarray) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_KINDS[raw], minlength=8) / max(len(raw), 1)
    n = max(len(hashes), 1)
    if len(hashes):
        _, times = np.unique(hashes, return_counts=True)
        distinct, most = len(times) / n, times.max() / n
        phrases = len(wordhash.shingle_set(hashes, 4)) / max(n - 3, 1)
    else:
        distinct = most = phrases = 0.0
    lines = text.split("\n")
    return [
        *share,
        math.log1p(len(hashes)),
        math.log1p(len(raw) / n),
        distinct * math.log1p(n),
        most,
        min(phrases, 1.0),
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
    ]


def features(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Style matrix, and the word bins of each text."""
    hashes = list(wordhash.words(texts, wordhash.MARKS))
    style = np.array([_style(t, h) for t, h in zip(texts, hashes)]).reshape(len(texts), -1)
    return style, [np.unique(h & np.uint64(BINS - 1)).astype(np.int64) for h in hashes]


@dataclass(frozen=True)
class Flaw:
    """Log odds that a text lacks one flaw: standardised style, and a weight for each bin."""

    mean: np.ndarray
    scale: np.ndarray
    style: np.ndarray
    words: np.ndarray
    bias: float

    def odds(self, style: np.ndarray, bins: list[np.ndarray]) -> np.ndarray:
        return (style - self.mean) / self.scale @ self.style + self.bias + [self.words[b].sum() for b in bins]


@dataclass(frozen=True)
class Model:
    flaws: tuple[Flaw, ...]

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Log odds that each text lacks every flaw."""
        style, bins = features(texts)
        good = np.ones(len(texts))
        for flaw in self.flaws:
            good *= 1 / (1 + np.exp(-np.clip(flaw.odds(style, bins), -MARGIN, MARGIN)))
        return np.clip(np.log(good) - np.log1p(-good), -MARGIN, MARGIN)


def fit_rows(style: np.ndarray, bins: list[np.ndarray], good: np.ndarray) -> Flaw:
    """Ridge logistic regression; without both classes, every text has the same odds."""
    n, width = len(good), style.shape[1] if len(good) else len(_style("", np.empty(0, np.uint64)))
    weights = np.zeros(BINS)
    if n == 0 or good.all() or not good.any():
        bias = -MARGIN if n and not good.any() else MARGIN
        return Flaw(np.zeros(width), np.ones(width), np.zeros(width), weights, bias)
    n_good, n_bad = good.sum(), n - good.sum()
    in_good, in_bad = np.zeros(BINS), np.zeros(BINS)
    for own, label in zip(bins, good):
        (in_good if label else in_bad)[own] += 1
    a, b = (in_good + 0.5) / (n_good + 1), (in_bad + 0.5) / (n_bad + 1)
    sure = np.abs(np.log(a / b)) / np.sqrt(1 / (in_good + 0.5) + 1 / (in_bad + 0.5))
    telling = np.argsort(-sure, kind="stable")[:TELLING]
    telling = telling[sure[telling] > SURE]
    mean, scale = style.mean(0), style.std(0) + 1e-6
    place = np.full(BINS, -1)
    place[telling] = np.arange(len(telling))
    x = np.zeros((n, width + len(telling) + 1))
    x[:, :width] = (style - mean) / scale
    for row, own in enumerate(bins):
        at = place[own]
        x[row, width + at[at >= 0]] = 1.0
    x[:, -1] = 1.0
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (good - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    weights[telling] = w[width:-1]
    return Flaw(mean, scale, w[:width], weights, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text") -> Model:
    """A model of ``quality = 1`` and ``toxic = 0`` from at most ``sample`` labelled documents.

    The sample is the labels whose id hashes lowest, so it is the same on every
    run.  Labels with a null are left out.  Of rows that repeat a labelled id one
    counts, the one whose text hashes lowest.
    """
    chosen = (
        labels.dropna(subset=["doc_id", "quality", "toxic"])
        .select(
            F.col("doc_id").alias("_label_id"),
            F.array(F.col("quality") == 1, F.col("toxic") == 0).alias("good"),
        )
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("_doc_id"), whole_text(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("_doc_id") == F.col("_label_id"))
    rows = joined.groupBy("_label_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            style, bins = features(batch["text"].tolist())
            yield pd.DataFrame(
                {"id": batch["_label_id"], "style": list(style), "bins": [b.astype(np.int32) for b in bins], "good": batch["good"]}
            )

    schema = "id bigint, style array<double>, bins array<int>, good array<boolean>"
    described = rows.withColumn("_label_id", F.col("_label_id").cast("bigint")).mapInPandas(describe, schema).toPandas()
    described = described.sort_values("id", kind="stable")  # sums in one order on every run
    width = len(_style("", np.empty(0, np.uint64)))
    style = np.array(described["style"].tolist(), float).reshape(len(described), width)
    bins = [np.asarray(b, np.int64) for b in described["bins"]]
    good = np.array(described["good"].tolist(), bool).reshape(len(described), 2)
    return Model(tuple(fit_rows(style, bins, good[:, i]) for i in range(2)))


def evidence(model: Model, text: Column) -> Column:
    """Log odds of each text as a column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [model.evidence(batch.iloc[at : at + SCORED].tolist()) for at in range(0, len(batch), SCORED)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")
        release_arrow_memory()

    # Else a filter on what is derived from it is pushed below, and each text scored again there.
    return score.asNondeterministic()(text)


def _rate(odds: str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(odds)))


def _strength(groups: DataFrame, prior: Column) -> float:
    """How many documents a prior is worth: moments of the groups' rates about it."""
    mean = F.col("good") / F.col("rows")
    row = groups.agg(
        F.sum("rows").alias("rows"),
        F.sum(F.col("rows") * (mean - prior) ** 2).alias("spread"),
        F.sum(F.col("rows") * prior * (1 - prior)).alias("chance"),
        F.count("*").alias("groups"),
    ).first()
    if not row["rows"]:
        return 1.0
    chance = row["chance"] / row["rows"]
    between = (row["spread"] - row["groups"] * chance) / row["rows"]
    if chance <= 0:
        return 1.0
    return float(min(max(chance / between - 1 if between > 0 else 1e6, 1.0), 1e6))


def posteriors(scores: DataFrame) -> DataFrame:
    """Per ``host, path`` of the scores: ``host_rate, path_rate`` and ``shift`` in log odds."""
    paths = kept(
        scores.groupBy("host", "path").agg(F.count("*").alias("rows"), F.sum(_rate("evidence")).alias("good")), "paths"
    )
    total = paths.agg(F.sum("rows").alias("rows"), F.sum("good").alias("good")).first()
    overall = (total["good"] + 0.5) / (total["rows"] + 1) if total["rows"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("rows").alias("rows"), F.sum("good").alias("good"))
    k = _strength(hosts, F.lit(overall))
    hosts = hosts.select(
        F.col("host").alias("_host"), ((F.col("good") + k * overall) / (F.col("rows") + k)).alias("host_rate")
    )
    placed = kept(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "host-rates")
    k = _strength(placed, F.col("host_rate"))
    shrunk = (F.col("good") + k * F.col("host_rate")) / (F.col("rows") + k)
    odds = F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    return placed.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "host_rate", shrunk.alias("path_rate")
    ).withColumn("shift", odds - F.lit(math.log(overall / (1 - overall))))


def classify(
    docs: DataFrame, model: Model, host: str = "source", path: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with ``evidence, host_rate, path_rate, quality, kept``.

    ``quality`` is the posterior that a document is good, ``kept`` whether it is
    at least one half.  Null text is empty text; null hosts and paths are hosts
    and paths; repeated rows are judged alike; an empty table stays empty.
    Columns of these names that the input has already are replaced.
    """
    made = [c for c in ("host_rate", "path_rate", "quality", "kept") if c not in (host, path)]
    judged = docs.drop(*made).withColumn(
        "evidence", evidence(model, whole_text(text_col))
    )
    scores = judged.select(
        F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "evidence"
    )
    found = free_name(judged, "_rates")
    rates = kept(posteriors(scores), "rates").select(F.struct("_host", "_path", "host_rate", "path_rate", "shift").alias(found))
    if rates.count() <= BROADCAST_PATHS:
        rates = F.broadcast(rates)
    sites = ((host, "_host"), (path, "_path"))
    same = [F.col(c).cast("string").eqNullSafe(F.col(f"{found}.{name}")) for c, name in sites]
    odds = F.col("evidence") + F.col(f"{found}.shift")
    return (
        judged.join(rates, same[0] & same[1])
        .withColumns({c: F.col(f"{found}.{c}") for c in ("host_rate", "path_rate")})
        .withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
        .withColumn("kept", F.col("quality") >= 0.5)
        .drop(found)
    )
