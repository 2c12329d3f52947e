"""Word and character vocabularies and encoded sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import CHARACTERS
from pairloom.operators.numbering import numbered

#: Addresses, abbreviations with points, numbers with separators, runs of points and dashes, and simple faces stay whole; numbers part from units; contractions part before n't or the
#: apostrophe, cannot and some spoken forms in two; else words and single marks. An approximation of a rule-based English tokenizer, on lower-cased texts.
TOKEN = (
    r"(?U)https?://\S+[\w/]|www\.\S+[\w/]|[\w.+-]+@\w[\w-]*(?:\.\w[\w-]*)+|\b(?:\p{L}\.){2,}|\b(?:mr|mrs|ms|dr|prof|vs|st|jr|sr|etc|inc|ltd|co|approx)\.(?!\w)"
    r"|\d+(?:[.,:]\d+)+|\d+(?:st|nd|rd|th)\b|\d+(?=\p{L})|\.{2,}|-{2,}|[:;=]-?[()dp](?!\w)|<3"
    r"|\bcan(?=not\b)|(?<=\bcan)not\b|\b(?:gon|wan)(?=na\b)|(?<=\b(?:gon|wan))na\b|\bgot(?=ta\b)|(?<=\bgot)ta\b"
    r"|\w+(?=n['\u2019]t\b)|n['\u2019]t\b|['\u2019](?:s|m|re|ve|ll|d)\b|\w+|[^\w\s]"
)
ASCII_TOKEN = "[a-z0-9]+|[^a-z0-9 \t\r\n\f\x0b]"


def words(c: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def vocabulary(pairs: DataFrame, columns: tuple[str, ...] = ("question1", "question2"), pattern: str = TOKEN) -> DataFrame:
    """token, idx from 2 by first appearance: column by column, in order of id, then of place.

    The first places are found by an aggregation; only they are numbered, and no single task holds the vocabulary."""
    places = None
    for block, column in enumerate(columns):
        rows = pairs.select(F.lit(block).alias("block"), "id", F.posexplode(words(F.col(column), pattern)).alias("place", "token"))
        places = rows if places is None else places.union(rows)
    first = places.groupBy("token").agg(F.min(F.struct("block", "id", "place")).alias("at"))
    return numbered(first, [], [F.col("at")], "n").select("token", (F.col("n") + 1).alias("idx"))


def sentences(pairs: DataFrame, column: str, vocab: DataFrame, max_len: int = 40, pattern: str = TOKEN) -> DataFrame:
    """id, ids array<int> padded with 0 to max_len (unknown 1), len (after truncation)."""
    tokens = pairs.select("id", F.posexplode_outer(F.slice(words(F.col(column), pattern), 1, max_len)).alias("place", "token"))
    coded = tokens.join(vocab, "token", "left").select("id", F.when(F.col("place").isNotNull(), F.struct("place", F.coalesce("idx", F.lit(1)).cast("int").alias("idx"))).alias("x"))
    ids = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["idx"])
    rows = coded.groupBy("id").agg(ids.alias("ids"))
    return rows.select("id", F.concat("ids", F.array_repeat(F.lit(0), max_len - F.size("ids"))).alias("ids"), F.size("ids").alias("len"))


def characters(pairs: DataFrame, column: str, max_len: int = 40, max_char_len: int = 20, pattern: str = TOKEN) -> DataFrame:
    """id, chars array<array<int>>: for each token its characters' numbers, padded and cut to max_char_len; rows padded to max_len."""
    table = F.lit(CHARACTERS)

    def code(token: Column) -> Column:
        letters = F.filter(F.split(token, ""), lambda c: c != "")
        found = F.transform(F.slice(letters, 1, max_char_len), lambda c: F.when(F.instr(table, c) > 0, F.instr(table, c) + 1).otherwise(1))
        return F.concat(found, F.array_repeat(F.lit(0), max_char_len - F.size(found)))

    rows = F.transform(F.slice(words(F.col(column), pattern), 1, max_len), code)
    blank = F.array_repeat(F.array_repeat(F.lit(0), max_char_len), max_len - F.size(rows))
    return pairs.select("id", F.concat(rows, blank).alias("chars"))


def vector_table(vocab: DataFrame, vectors: DataFrame, size: int = 300, scale: float = 0.01, seed: int = 951) -> DataFrame:
    """idx, token, vec: each token's vector; tokens without one get normal draws of that scale, which a hash of token and place fixes."""

    def uniform(i: Column, salt: int) -> Column:
        return (F.pmod(F.xxhash64("token", i, F.lit(seed + salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    drawn = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: scale * F.sqrt(-2 * F.ln(uniform(i, 0))) * F.cos(2 * F.pi() * uniform(i, 1)))
    return vocab.join(vectors.select("token", "vec"), "token", "left").select("idx", "token", F.coalesce("vec", drawn).alias("vec"))


def sentence_vectors(encoded: DataFrame, table: DataFrame, size: int = 300) -> DataFrame:
    """id, rows array<array<double>>: the vectors of an encoded sentence's ids in order, zeros for padding and unknown words."""
    places = encoded.select("id", F.posexplode("ids").alias("place", "idx")).join(table.select(F.col("idx").cast("int").alias("idx"), "vec"), "idx", "left")
    blank = F.array_repeat(F.lit(0.0), size)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("vec", blank).alias("vec")))), lambda x: x["vec"])
    return places.groupBy("id").agg(rows.alias("rows"))


#: Buckets that character n-grams are hashed to, and the lengths of the n-grams (fixed values of the public subword models).
BUCKETS, SHORTEST, LONGEST = 2_000_000, 3, 6


def character_ngrams(token: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The n-grams of a token's characters between marks for its begin and end, by place, then length."""
    marked = F.concat(F.lit("<"), token, F.lit(">"))
    size = F.length(marked)
    ends = lambda i: F.filter(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: i + n - 1 <= size)
    return F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(ends(i), lambda n: F.substring(marked, i, n))))


def ngram_bucket(ngram: Column, buckets: int = BUCKETS) -> Column:
    """The 32-bit FNV-1a hash of the n-gram's UTF-8 bytes, each taken as a signed number, modulo buckets."""
    digits = F.hex(F.encode(ngram, "UTF-8"))
    octet = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    signed = lambda b: F.when(b >= 128, b.bitwiseOR(F.lit(0xFFFFFF00))).otherwise(b)
    places = F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)
    return F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(signed(octet(i))) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))) % buckets


def subword_vectors(tokens: DataFrame, grams: DataFrame, known: DataFrame | None = None, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """token, vec: for each distinct token (not null) the mean of its n-grams' vectors, with its own among them where `known` (token, vec) has one. Tokens without any of them are left out.

    grams: bucket, vec. N-grams meet their vectors by a join, so neither table has to fit one task. An n-gram that a token holds twice counts twice."""
    asked = tokens.select("token").where(F.col("token").isNotNull()).distinct()
    places = asked.select("token", F.explode(character_ngrams(F.col("token"), shortest, longest)).alias("gram"))
    met = places.select("token", ngram_bucket(F.col("gram"), buckets).alias("bucket")).join(grams.select("bucket", "vec"), "bucket").select("token", "vec")
    if known is not None:
        met = met.union(asked.join(known.select("token", "vec"), "token"))
    return _mean_vectors(met, "token")


def _mean_vectors(rows: DataFrame, key: str) -> DataFrame:
    """key, vec: the means by coordinate, summed before they are shuffled."""
    means = rows.select(key, F.posexplode("vec").alias("d", "x")).groupBy(key, "d").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda v: v["x"]).alias("vec"))


def bucket_vectors(known: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, vec: for each bucket the mean of the vectors of the words (token, vec) that hold one of its n-grams; a stand-in for trained n-gram vectors where only words' are at hand."""
    places = known.select("vec", F.explode(F.array_distinct(F.transform(character_ngrams(F.col("token"), shortest, longest), lambda g: ngram_bucket(g, buckets)))).alias("bucket"))
    return _mean_vectors(places, "bucket")
