"""Statistics of a node metric at the two ends of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return a / (b + F.lit(eps))


def pair_stats(a: Column, b: Column, prefix: str, ratio_eps: float | None = None) -> dict[str, Column]:
    """min, max, mean and absolute difference; with ratio_eps also max / max(min, eps). Nulls are to be filled before."""
    low, high = F.least(a, b), F.greatest(a, b)
    out = {f"{prefix}_min": low, f"{prefix}_max": high, f"{prefix}_mean": (a + b) / 2, f"{prefix}_diff": high - low}
    return out | ({f"{prefix}_ratio": high / F.greatest(low, F.lit(ratio_eps))} if ratio_eps is not None else {})


def look_up(pairs: DataFrame, metric: DataFrame, names: dict[str, float]) -> DataFrame:
    """pairs with <name>_u and <name>_v from metric (node, names...), defaults where a node is missing."""
    out = pairs
    for end in ("u", "v"):
        side = metric.select(F.col("node").alias(end), *(F.col(n).alias(f"{n}_{end}") for n in names))
        out = out.join(side, end, "left")
    fill = [F.coalesce(f"{n}_{e}", F.lit(d)).alias(f"{n}_{e}") for n, d in names.items() for e in ("u", "v")]
    return out.select(*pairs.columns, *fill)
