"""The job from CSV files to a submission, and its arguments."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from pairloom.plans import pairs_job


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


def test_from_files_to_a_submission(spark, tmp_path):
    """Dirty ids, repeated ids and missing texts in the test file; ids in the sample that no pair has."""
    r = random.Random(4)
    words = ["red cat", "blue cat", "red dog", 'a "quoted" dog', "two\nlines"]
    same = lambda i: (w := r.choice(words), w if i % 2 else r.choice(words))
    train = write(tmp_path / "train.csv", ["id", "question1", "question2", "is_duplicate"], [(i, *same(i), i % 2) for i in range(60)])
    tests = [(i, *same(i)) for i in range(20)]
    test = write(tmp_path / "test.csv", ["test_id", "question1", "question2"], [*tests, ("life", "x", "y"), (3, "again", "again"), (30, "x", ""), ("31.0", "red cat", "red cat")])
    sample = write(tmp_path / "sample.csv", ["test_id", "is_duplicate"], [(i, 1) for i in range(33)])
    args = ["--train", train, "--test", test, "--sample", sample, "--out", str(tmp_path / "out"), "--families", "basic,neighbor", "--rounds", "4", "--patience", "2", "--rate", "0.3", "--depth", "2", "--least", "2"]
    pairs_job.run(spark, pairs_job.parse(args))
    first = (tmp_path / "out/submission").glob("*.csv")
    rows = [row for f in first for row in csv.DictReader(open(f))]
    got = {int(row["test_id"]): float(row["is_duplicate"]) for row in rows}
    assert sorted(got) == list(range(33)) and got[30] == got[32] == 0 and 0 < got[31] < 1 and all(0 < got[i] < 1 for i in range(20))
    assert got[31] > 0.5  # equal texts
    scored = spark.read.parquet(str(tmp_path / "out/scored"))
    assert scored.count() == 60 and scored.agg(F.countDistinct("fold")).first()[0] == 5
    pairs_job.run(spark, pairs_job.parse([*args[:-10], "--rounds", "2", "--patience", "1", "--depth", "1", "--least", "1", "--reuse"]))


def test_arguments():
    base = ["--train", "a", "--test", "b", "--out", "c"]
    asked = pairs_job.parse([*base, "--families", "basic,esim", "--heads", "h", "--training-folds", "0,2", "--warm-start-folds", "1,0"])
    assert asked.families == ["basic", "esim"] and asked.training_folds == [0, 2] and asked.warm_start_folds == [True, False]
    for bad in (["--families", "none"], ["--warm-start-folds", "2"], ["--heads", "h", "--training-folds", "0,1", "--warm-start-folds", "1"], ["--training-folds", "0"]):
        with pytest.raises(SystemExit):
            pairs_job.parse([*base, *bad])
