"""Expressions over arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column, eps: float = EPS) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def entropy(p: Column, eps: float = EPS) -> Column:
    return -total(F.transform(p, lambda x: clip(x, eps, 1.0) * F.ln(clip(x, eps, 1.0))))


def jensen_shannon(p: Column, q: Column, eps: float = EPS) -> Column:
    """Divergence in nats of clipped, not re-normalised mixtures."""

    def part(x: Column, y: Column) -> Column:
        x, y = clip(x, eps, 1.0), clip(y, eps, 1.0)
        m = (x + y) / 2
        return (x * F.ln(x / m) + y * F.ln(y / m)) / 2

    return total(F.zip_with(p, q, part))


def argmax(x: Column) -> Column:
    return F.array_position(x, F.array_max(x)) - 1


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def masked_mean(rows: Column, mask: Column, width: int) -> Column:
    """Mean of the rows (arrays of `width`) where mask is 1."""
    zero = F.array_repeat(F.lit(0.0), width)
    summed = F.aggregate(F.zip_with(rows, mask, lambda r, m: F.transform(r, lambda x: x * m)), zero, lambda s, r: F.zip_with(s, r, lambda x, y: x + y))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(summed, lambda x: x / count)


def length_mask(length: Column, most: int) -> Column:
    """1 for the first `length` of `most` places, 0 for the others."""
    return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.when(i <= length, 1.0).otherwise(0.0))


def masked_softmax(x: Column, mask: Column) -> Column:
    """Softmax over the places where mask is 1, zeros elsewhere (everywhere, if mask is 0 throughout)."""
    top = F.coalesce(F.array_max(F.zip_with(x, mask, lambda v, m: F.when(m > 0, v))), F.lit(0.0))
    raised = F.zip_with(x, mask, lambda v, m: F.when(m > 0, F.exp(v - top)).otherwise(0.0))
    return F.transform(raised, lambda v: v / F.greatest(total(raised), F.lit(1e-13)))


def masked_max(rows: Column, mask: Column, width: int, least: float = -1e7) -> Column:
    """The largest of each coordinate over the rows where mask is 1; `least` where there is none."""
    low = F.array_repeat(F.lit(least), width)
    return F.aggregate(F.zip_with(rows, mask, lambda r, m: F.when(m > 0, r).otherwise(low)), low, lambda s, r: F.zip_with(s, r, lambda x, y: F.greatest(x, y)))


def first_row(rows: Column) -> Column:
    """The vector of the first token, which stands for the sequence."""
    return F.get(rows, F.lit(0))


def combination(a: Column, b: Column) -> Column:
    """[a, b, |a - b|, a * b, cosine]."""
    return F.concat(a, b, difference(a, b), product(a, b), F.array(cosine(a, b)))


def embedding_pair(a: Column, b: Column) -> dict[str, Column]:
    """Fourteen statistics of a pair of embeddings."""
    na, nb = norm(a) + EPS, norm(b) + EPS
    had, diff = product(a, b), difference(a, b)
    n = F.size(a)
    return {
        "cos": dot(a, b) / (na * nb),
        "dot": dot(a, b),
        "l2": F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))),
        "norm_u": na,
        "norm_v": nb,
        "norm_min": F.least(na, nb),
        "norm_max": F.greatest(na, nb),
        "norm_ratio": F.greatest(na, nb) / F.greatest(F.least(na, nb), F.lit(EPS)),
        "had_mean": total(had) / n,
        "had_max": F.array_max(had),
        "had_min": F.array_min(had),
        "diff_mean": total(diff) / n,
        "diff_max": F.array_max(diff),
        "add_mean": total(F.zip_with(a, b, lambda x, y: x + y)) / n,
    }


def topic_pair(p: Column, q: Column, topics: int) -> dict[str, Column]:
    """Scalars of two topic mixtures, then absolute differences and products by topic."""
    diff, prod = difference(p, q), product(p, q)
    out = {
        "dot": dot(p, q),
        "l1": total(diff),
        "l2": F.sqrt(dot(diff, diff)),
        "jsd": jensen_shannon(p, q),
        "cos": cosine(p, q),
        "ent_diff": F.abs(entropy(p) - entropy(q)),
        "argmax_equal": (argmax(p) == argmax(q)).cast("int"),
    }
    return out | {f"abs_diff_{i}": F.element_at(diff, i + 1) for i in range(topics)} | {f"prod_{i}": F.element_at(prod, i + 1) for i in range(topics)}
