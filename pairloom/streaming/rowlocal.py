"""Row-local pair features over streams; nothing here needs state or watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.clean import hash_pairs, token_similarity, word_differences

FEATURES = {"hash": hash_pairs, "similarity": token_similarity, "words": word_differences}


def start(pairs: DataFrame, feature: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append a feature of a stream of pairs to Parquet, once for each row."""
    return FEATURES[feature](pairs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
