"""Subword views of pairs: each text alone, or both texts of a pair in one sequence, cut and padded to a fixed length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.ship import ship


def _encoded(find: Callable[[], str], max_len: int, padding: int, joint: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(find())
        t.enable_truncation(max_len)
        t.enable_padding(length=max_len, pad_id=padding)
        for batch in batches:
            texts = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            made = t.encode_batch(list(zip(*texts)) if joint else texts[0])
            columns = [pa.array([x.ids for x in made], pa.list_(pa.int32())), pa.array([x.attention_mask for x in made], pa.list_(pa.int32()))]
            if joint:
                columns.append(pa.array([x.type_ids for x in made], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "ids", "mask", "types"][: 1 + len(columns)])

    return run


def single_view(pairs: DataFrame, column: str, vocabulary: Callable[[], str], max_len: int = 40, padding: int = 0) -> DataFrame:
    """id, ids, mask (arrays of max_len): the subwords of one text. `vocabulary` gives the tokenizer file's path on the executor; null texts are empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    return ship(pairs).select(F.col("id").cast("long"), text.alias("text")).mapInArrow(_encoded(vocabulary, max_len, padding, False), "id long, ids array<int>, mask array<int>")


def joint_view(pairs: DataFrame, vocabulary: Callable[[], str], max_len: int = 80, padding: int = 0) -> DataFrame:
    """id, ids, mask, types (arrays of max_len): both texts' subwords in one sequence, the longer cut first; types says of which text."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("question1", "question2")]
    return ship(pairs).select(F.col("id").cast("long"), *texts).mapInArrow(_encoded(vocabulary, max_len, padding, True), "id long, ids array<int>, mask array<int>, types array<int>")
