"""From the CSV files of pairs to features and a submission:
spark-submit pairloom/plans/pairs_job.py --train train.csv --test test.csv --sample sample.csv --out DIR [--families basic,double,...] [--folder DIR_OF_HEADS].

Writes DIR/train and DIR/test (the feature tables), DIR/scored (out-of-fold probabilities) and DIR/submission (CSV). Folders of features that exist are read instead of made
with --reuse, so stacking can be tried anew alone."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import clean, encoders, stacking
from pairloom.plans import training
from pairloom.plans.job import listed
from pairloom.sources import tables


def flags(text: str) -> list[bool]:
    """Values of 0 or 1, parted by commas."""
    found = listed()(text)
    if bad := [x for x in found if x not in ("0", "1")]:
        raise argparse.ArgumentTypeError(f"neither 0 nor 1: {', '.join(bad)}")
    return [x == "1" for x in found]


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    known = [*training.TEXT, *training.NEURAL, *training.GRAPH]
    p = argparse.ArgumentParser(description="Makes pair features, stacks them, and writes a submission.")
    p.add_argument("--train", required=True, help="CSV of id, question1, question2, is_duplicate")
    p.add_argument("--test", required=True, help="CSV of test_id, question1, question2")
    p.add_argument("--sample", help="CSV with the test_ids that the submission needs; all test pairs without it")
    p.add_argument("--out", required=True, help="folder of the results")
    p.add_argument("--families", type=listed(), default=[*training.TEXT, *training.GRAPH], help=f"parted by commas, of: {', '.join(known)}")
    p.add_argument("--heads", help="folder where the trained families keep their heads, by family and fold")
    p.add_argument("--training-folds", type=listed(int), default=list(range(5)), help="folds whose heads are trained; the others' are read from --heads")
    p.add_argument("--warm-start-folds", type=flags, default=[], help="0 or 1 for each of the training folds: whether it goes on from its saved head")
    p.add_argument("--epochs", type=int, default=50)
    p.add_argument("--early-stopping", type=int, default=3, help="epochs without a lower loss that end a head's training")
    p.add_argument("--rounds", type=int, default=2000, help="boosting rounds at most")
    p.add_argument("--patience", type=int, default=50, help="boosting rounds without a lower loss that end a fold")
    p.add_argument("--rate", type=float, default=0.02)
    p.add_argument("--depth", type=int, default=7)
    p.add_argument("--least", type=int, default=150, help="rows in a leaf at least")
    p.add_argument("--reuse", action="store_true", help="read DIR/train and DIR/test instead of making them")
    asked = p.parse_args(arguments)
    if unknown := [x for x in asked.families if x not in known]:
        p.error(f"no such family: {', '.join(unknown)}")
    if asked.warm_start_folds and len(asked.warm_start_folds) != len(asked.training_folds):
        p.error("--warm-start-folds needs a value for each of the training folds")
    if asked.heads is None and (any(asked.warm_start_folds) or set(asked.training_folds) != set(range(5))):
        p.error("heads that aren't trained from the start are read from --heads")
    return asked


def read(spark: SparkSession, asked: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Cleaned training and test pairs, both by id."""
    train = clean.clean_pairs(tables.read_pairs(spark, asked.train))
    test = clean.clean_pairs(tables.read_pairs(spark, asked.test, tables.TEST), "test_id").withColumnRenamed("test_id", "id")
    return train, test


def features(asked: argparse.Namespace, train: DataFrame, test: DataFrame) -> training.Tables:
    """Trained families first, with the folds that the arguments say; then the others."""
    own, of_test = {}, {}
    warm = [fold for fold, x in zip(asked.training_folds, asked.warm_start_folds) if x]
    done = [fold for fold in range(5) if fold not in asked.training_folds]
    for name in asked.families:
        if encoder := training.ENCODER_OF.get(name):
            path = None if asked.heads is None else f"{asked.heads}/{name}"
            own[name], of_test[name] = encoders.pair_features(train, encoder, test=test, epochs=asked.epochs, patience=asked.early_stopping, path=path, warm=warm, done=done)
    return training.feature_tables(train, test, [x for x in asked.families if x not in own], own, of_test)


def run(spark: SparkSession, asked: argparse.Namespace) -> None:
    train, test = read(spark, asked)
    if not asked.reuse:
        for name, table in zip(("train", "test"), features(asked, train, test)):
            tables.write_features(table, f"{asked.out}/{name}")
    own, of_test = (tables.read_features(spark, f"{asked.out}/{name}") for name in ("train", "test"))
    make: Callable = lambda: stacking.boosted_trees(asked.rounds, asked.depth, asked.least, asked.rate)
    scored, tested = stacking.stack(own.drop("is_duplicate"), own.select("id", "is_duplicate"), test=of_test, make=make, patience=asked.patience)
    tables.write_features(scored, f"{asked.out}/scored")
    sample = test if asked.sample is None else tables.read_pairs(spark, asked.sample, "test_id string, is_duplicate string", texts=()).withColumnRenamed("test_id", "id")
    sent = stacking.submission(sample.where(F.col("id").isNotNull()), tested.select("id", F.col("prob").alias("is_duplicate")))
    tables.write_submission(sent.withColumnRenamed("id", "test_id"), f"{asked.out}/submission")


def main(arguments: list[str] | None = None) -> None:
    run(SparkSession.builder.getOrCreate(), parse(arguments))


if __name__ == "__main__":
    main()
