"""Text expressions: normalising, hashing, tokens and token-set similarities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
#: The characters of the character vocabulary, numbered from 2 in this order (fixed values).
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789.,!?;:'\"-()[]{}@#$%^&*_+=/\\"


def normalize(c: Column) -> Column:
    """Null to '', lower case, white space (Unicode) to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def stable_hash(c: Column) -> Column:
    """A 128-bit hex identity of the normalised text."""
    return F.md5(normalize(c))


def blake_hash(c: Column) -> Column:
    """The same identity as 16 bytes of BLAKE2b in hex, for keys that must equal those of tables made elsewhere. A batch of texts at a time in Python."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        import hashlib

        return texts.map(lambda x: hashlib.blake2b(x.encode("utf-8"), digest_size=16).hexdigest())

    return digest(normalize(c))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_tokens(c: Column) -> Column:
    """Words of two characters and more, Unicode, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def common(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def different(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def jaccard_distance(a: Column, b: Column) -> Column:
    return 1 - F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + F.lit(EPS))


def dice(a: Column, b: Column) -> Column:
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) + F.lit(EPS))
