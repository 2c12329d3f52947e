"""Running the jobs of several folds at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T, R = TypeVar("T"), TypeVar("R")


def abreast(spark: SparkSession, work: Callable[[T], R], items: Iterable[T], threads: int = 5) -> list[R]:
    """What work gives for each item, in order; up to `threads` items' jobs share the executors, as folds do in MLlib's cross-validation."""
    items = list(items)
    if threads <= 1 or len(items) <= 1:
        return [work(x) for x in items]
    tasks = [inheritable_thread_target(spark)(lambda x=x: work(x)) for x in items]
    with ThreadPool(min(threads, len(items))) as pool:
        return pool.map(lambda task: task(), tasks)
