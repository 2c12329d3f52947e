"""Feature joins, out-of-fold training, fold averages, losses and submissions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.tfidf import folds
from pairloom.plans.abreast import abreast
from pairloom.plans.lineage import Scratch
from pairloom.plans.ship import ship


def join_features(families: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Full outer join of feature tables on the key; columns are named family_feature."""
    named = [df.select(key, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key)) for name, df in families.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), named)


def fold_mean(parts: DataFrame, key: str = "id", fold: str = "fold") -> DataFrame:
    """The mean of every feature over the rows of an id (one per fold; `fold` names the column that says which)."""
    return parts.groupBy(key).agg(*(F.avg(c).alias(c) for c in parts.columns if c not in (key, fold)))


def mean_loss(losses: DataFrame, loss: str = "log_loss") -> DataFrame:
    """mean_loss, n_folds: the mean of the folds' losses."""
    return losses.agg(F.avg(loss).alias("mean_loss"), F.count(loss).alias("n_folds"))


def weigh_pairs(pairs: DataFrame, scores: DataFrame, key: str = "id", score: str = "prob") -> DataFrame:
    """Pairs with their score as weight, joined by id; pairs without a score go."""
    return pairs.join(scores.select(key, F.col(score).alias("weight")), key).where("weight is not null")


def out_of_fold(pairs: DataFrame, fit: Callable[[DataFrame], Any], apply: Callable[[Any, DataFrame], DataFrame], k: int = 5, test: DataFrame | None = None, threads: int = 5) -> tuple[DataFrame, DataFrame | None]:
    """What `apply` makes of each pair with a model that `fit` made on the other folds, and for test pairs the means over the folds' models.

    So many folds are fitted at once."""
    rows = Scratch(pairs.sparkSession, "folds").keep(folds(pairs, k))
    models = abreast(pairs.sparkSession, lambda fold: fit(rows.where(F.col("fold") != fold).select(*pairs.columns)), range(k), threads)
    held = [apply(model, rows.where(F.col("fold") == fold).select(*pairs.columns)) for fold, model in enumerate(models)]
    tested = None if test is None else fold_mean(reduce(DataFrame.union, (apply(model, test) for model in models)))
    return reduce(DataFrame.union, held), tested


def weighted_mean(value: Column, n: Column) -> Column:
    return F.sum(value * n) / F.greatest(F.sum(n), F.lit(1))


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))


def logit_loss(x: Column, y: Column) -> Column:
    """The mean log loss of logits, without overflow for large ones."""
    return F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))))


def boosted_trees(rounds: int = 2000, depth: int = 7, least: int = 150, rate: float = 0.02, tolerance: float = 0.0) -> GBTClassifier:
    """Trees of so many levels, `rounds` at most: a round whose gain on the validation rows is under the tolerance ends it, and the trees up to the best round stay."""
    return GBTClassifier(featuresCol="features", labelCol="is_duplicate", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=least, validationTol=tolerance, seed=951)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """The number of rounds with the least loss (the first such) before `patience` rounds bring no lower one, and whether that ended the search."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def patient_trees(train: DataFrame, held: DataFrame, rounds: int, patience: int, make: Callable[[int], GBTClassifier]) -> GBTClassificationModel:
    """Boosted trees up to the round whose loss on the held rows no round of the next `patience` falls below, `rounds` at most.

    MLlib's own validation ends at the first round without a gain, and it can't go on from a model. So `make(n)` is fitted for twice as many rounds each time until the
    search ends within them, at about three times the work of the rounds that are needed; equal seeds make equal first trees, so the last fit is the start of the one before."""
    n = min(rounds, 2 * patience)
    while True:
        model = make(n).fit(train)
        best, ended = best_round(model.evaluateEachIteration(held), patience)
        if ended or n == rounds:
            return model if best == n else make(best).fit(train)
        n = min(rounds, 2 * n)


def stack(features: DataFrame, labels: DataFrame, k: int = 5, test: DataFrame | None = None, make: Callable[[], GBTClassifier] = boosted_trees, patience: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold probabilities (id, fold, is_duplicate, prob) of the training rows, and fold means for the test rows. The held-out fold says when a model stops:
    at its first round without a gain, or, with `patience`, once so many rounds have brought none."""
    names = [c for c in features.columns if c != "id"]
    table = Scratch(features.sparkSession, "stack").keep(folds(features.na.fill(0).join(labels, "id"), k))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(table)

    def fitted(fold: int) -> GBTClassificationModel:
        if patience is None:
            return make().setValidationIndicatorCol("held").fit(rows.withColumn("held", F.col("fold") == fold))
        return patient_trees(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold), make().getMaxIter(), patience, lambda n: make().setMaxIter(n))

    scored, tested = [], []
    for fold, model in enumerate(abreast(features.sparkSession, fitted, range(k))):
        prob = vector_to_array("probability")[1].alias("prob")
        scored.append(model.transform(rows.where(F.col("fold") == fold)).select("id", "fold", "is_duplicate", prob))
        if test is not None:
            tested.append(model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(test.na.fill(0))).select("id", F.lit(fold).alias("fold"), prob))
    union = lambda x: reduce(DataFrame.union, x)
    return union(scored), fold_mean(union(tested)) if tested else None


def submission(sample: DataFrame, predictions: DataFrame, key: str = "id", score: str = "is_duplicate") -> DataFrame:
    """Every sample id with its score, 0 where there is none."""
    return sample.select(key).join(predictions.select(key, score), key, "left").na.fill(0, [score])


def predict(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Batch inference with any model: `load` runs once per task and returns a function from input frames to output frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield model(frame)

    return ship(rows).mapInPandas(run, schema)


def predict_mean(rows: DataFrame, loads: list[Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]], schema: str, key: str = "id") -> DataFrame:
    """The means of what several models (one of each fold, say) give for a row."""
    return fold_mean(reduce(DataFrame.union, (predict(rows, load, schema) for load in loads)), key)
