"""TF-IDF with smoothed idf as grouped counts; all folds' vocabularies come from one pass with the fold as a key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import tokens
from pairloom.operators.numbering import numbered
from pairloom.plans.lineage import Scratch

#: Pairs for each partition that counts terms.
PAIRS = 2_000


def folds(rows: DataFrame, k: int = 5, seed: int = 7610, label: str = "is_duplicate", key: str = "id") -> DataFrame:
    """rows with a fold column, stratified by label, in an order that only the ids and the seed decide."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    ranked = numbered(rows, [label], [order, F.col(key)], "_number")
    return ranked.select(*rows.columns, F.pmod(F.col("_number") - 1, F.lit(k)).cast("int").alias("fold"))


def dealt(pairs: DataFrame, n: int) -> DataFrame:
    """Pairs (so many) dealt by id, some PAIRS to a partition: what is grouped by the id and more stays in its task, whose memory is that of its pairs."""
    return pairs.repartition(max(pairs.sparkSession.sparkContext.defaultParallelism, -(-n // PAIRS)), "id")


def term_counts(pairs: DataFrame, tokenizer: Callable[[Column], Column] = tokens, *keep: str) -> DataFrame:
    """id, term, tf1, tf2: how often a pair's two texts hold a term."""
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("question1").alias("t")), F.struct(F.lit(2).alias("side"), F.col("question2").alias("t"))))
    terms = pairs.select("id", *keep, sides.alias("s")).select("id", *keep, "s.side", F.explode(tokenizer(F.col("s.t"))).alias("term"))
    return terms.groupBy("id", *keep, "term").agg(F.count_if(F.col("side") == 1).alias("tf1"), F.count_if(F.col("side") == 2).alias("tf2"))


def _by_text(terms: DataFrame) -> DataFrame:
    """terms with tf, the two texts as documents of their own."""
    return terms.withColumn("tf", F.explode(F.array("tf1", "tf2"))).where("tf > 0")


def _vocabulary(stats: DataFrame, n: Column, by: list[str], min_df: int, max_df: float, size: int) -> DataFrame:
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    top = numbered(kept.withColumn("idf", F.ln((1 + n) / (1 + F.col("df"))) + 1), by, [F.desc("total"), F.col("term")], "_number")
    return top.where(F.col("_number") <= size).drop("_number")


def fit(terms: DataFrame, documents: int, min_df: int = 3, max_df: float = 0.95, size: int = 150_000) -> DataFrame:
    """term, df, total, idf of the kept vocabulary."""
    stats = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return _vocabulary(stats, F.lit(documents), [], min_df, max_df, size)


def fit_folds(terms: DataFrame, sizes: dict[int, int], min_df: int = 3, max_df: float = 0.95, size: int = 150_000, sides: int = 2) -> DataFrame:
    """fold, term, df, total, idf: for each fold the vocabulary of all other folds, as totals less the fold's own counts. A pair is so many documents as `sides` says."""
    own = terms.groupBy("term", "fold").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    per = own.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("df", "total")))).alias("own"))
    every = per.select("*", F.explode(F.array(*map(F.lit, sorted(sizes)))).alias("fold"))
    mine = F.col("own")[F.col("fold")]
    left = every.select("fold", "term", (F.col("df") - F.coalesce(mine["df"], F.lit(0))).alias("df"), (F.col("total") - F.coalesce(mine["total"], F.lit(0))).alias("total"))
    total = sum(sizes.values())
    n = F.element_at(F.create_map(*[F.lit(x) for f, c in sizes.items() for x in (f, sides * (total - c))]), F.col("fold"))
    return _vocabulary(left, n, ["fold"], min_df, max_df, size)


def weights(terms: DataFrame, vocab: DataFrame, on: list[str], sublinear: bool = False, normed: bool = True) -> DataFrame:
    """terms with w, of length 1 per document if normed."""
    tf = 1 + F.ln("tf") if sublinear else F.col("tf")
    w = terms.join(vocab.select(*on, "idf"), on).withColumn("w", tf * F.col("idf"))
    if not normed:
        return w
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id", "side", *(x for x in on if x != "term"))))
    return w.withColumn("w", F.col("w") / length)


def by_term(vocab: DataFrame) -> DataFrame:
    """term, idfs: the folds' idfs of a term, as one written row. Every task gets them, at most as many as all folds' vocabularies hold, so terms meet them without a shuffle."""
    rows = vocab.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("fold", "idf"))).alias("idfs"))
    return F.broadcast(Scratch(vocab.sparkSession, "idfs").keep(rows))


def pair_distances(weighted: DataFrame, ids: DataFrame, *keep: str) -> DataFrame:
    """cos, l2d, dot, ov_ratio_1, ov_ratio_2, nnz_ratio from a row (id, w1, w2) for each term of a pair. Texts get length 1 after the sums, so no term waits for its text's length."""
    s = weighted.groupBy("id", *keep).agg(
        F.sum(F.col("w1") * F.col("w2")).alias("dot"), F.sqrt(F.sum(F.col("w1") * F.col("w1"))).alias("l1"), F.sqrt(F.sum(F.col("w2") * F.col("w2"))).alias("l2"),
        F.sum("w1").alias("s1"), F.sum("w2").alias("s2"), F.count_if(F.col("w1") != 0).alias("n1"), F.count_if(F.col("w2") != 0).alias("n2"),
    )
    s = ids.select("id", *keep).join(s, ["id", *keep], "left").na.fill(0)
    over = lambda x, *lengths: F.when(reduce(lambda a, b: a * b, lengths) > 0, x / reduce(lambda a, b: a * b, lengths)).otherwise(0.0)
    has1, has2 = ((F.col(c) > 0).cast("double") for c in ("l1", "l2"))
    s = s.select("id", *keep, "n1", "n2", over(F.col("dot"), F.col("l1"), F.col("l2")).alias("dot"), over(F.col("s1"), F.col("l1")).alias("s1"), over(F.col("s2"), F.col("l2")).alias("s2"), has1.alias("q1"), has2.alias("q2"))
    r1, r2 = F.sqrt("n1"), F.sqrt("n2")
    return s.select(
        "id", *keep, (F.col("dot") / (F.col("q1") * F.col("q2") + F.lit(1e-9))).alias("cos"), F.sqrt(F.greatest(F.col("q1") + F.col("q2") - 2 * F.col("dot"), F.lit(0.0))).alias("l2d"), "dot",
        (F.col("dot") / (F.col("s1") + F.lit(1e-9))).alias("ov_ratio_1"), (F.col("dot") / (F.col("s2") + F.lit(1e-9))).alias("ov_ratio_2"), (F.least(r1, r2) / (F.greatest(r1, r2) + F.lit(1e-12))).alias("nnz_ratio"),
    )


def _both(terms: DataFrame) -> DataFrame:
    """Terms (tf1, tf2, idf) with the weights of both texts."""
    return terms.withColumns({"w1": F.col("tf1") * F.col("idf"), "w2": F.col("tf2") * F.col("idf")})


def _own_fold(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Terms that the vocabulary of their row's fold holds, with idf."""
    return terms.join(by_term(vocab), "term").withColumn("idf", F.col("idfs")[F.col("fold")]).where("idf is not null").drop("idfs")


def _every_fold(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Terms once for each fold whose vocabulary holds them, with fold and idf."""
    return terms.join(by_term(vocab), "term").select(*terms.columns, F.explode("idfs").alias("fold", "idf"))


def pair_features(pairs: DataFrame, **bounds) -> DataFrame:
    rows = Scratch(pairs.sparkSession, "tfidf").keep(pairs.select("id", "question1", "question2"))
    n = rows.count()
    terms = term_counts(dealt(rows, n))
    vocab = fit(_by_text(terms), 2 * n, **bounds).withColumn("fold", F.lit(0))
    return pair_distances(_both(_own_fold(terms.withColumn("fold", F.lit(0)), vocab)), rows)


def _folded(pairs: DataFrame, k: int) -> tuple[DataFrame, dict[int, int]]:
    rows = folds(pairs, k)
    return rows, {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}


def oof_features(pairs: DataFrame, k: int = 5, **bounds) -> DataFrame:
    """Every pair's features under the vocabulary of the other folds."""
    rows, sizes = _folded(pairs, k)
    terms = term_counts(dealt(rows, sum(sizes.values())), tokens, "fold")
    return pair_distances(_both(_own_fold(terms, fit_folds(_by_text(terms), sizes, **bounds))), rows)


def _by_fold(test: DataFrame, k: int) -> DataFrame:
    """The ids of test pairs once for each fold."""
    return test.select("id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))


def _over_folds(made: DataFrame) -> DataFrame:
    return made.groupBy("id").agg(*(F.avg(c).alias(c) for c in made.columns if c not in ("id", "fold")))


def tested_features(pairs: DataFrame, test: DataFrame, k: int = 5, **bounds) -> DataFrame:
    """The test pairs' features, each the mean over the vocabularies that leave out a fold of the pairs."""
    rows, sizes = _folded(pairs, k)
    vocab = fit_folds(_by_text(term_counts(dealt(rows, sum(sizes.values())), tokens, "fold")), sizes, **bounds)
    asked = Scratch(test.sparkSession, "tfidf").keep(test.select("id", "question1", "question2"))
    terms = term_counts(dealt(asked, asked.count()))
    return _over_folds(pair_distances(_both(_every_fold(terms, vocab)), _by_fold(asked, k), "fold"))


def _differences(pairs: DataFrame, *keep: str) -> DataFrame:
    """id, side, term, tf: the words that are in one text of a pair only, once each."""
    t1, t2 = tokens(F.col("question1")), tokens(F.col("question2"))
    one = F.array_union(F.array_except(t1, t2), F.array_except(t2, t1))
    return pairs.select("id", *keep, F.lit(1).alias("side"), F.explode(one).alias("term"), F.lit(1).alias("tf"))


def _norms(weighted: DataFrame, ids: DataFrame, *keep: str) -> DataFrame:
    sums = weighted.groupBy("id", *keep).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("diff_l2"), F.sum("w").alias("diff_l1"))
    return ids.select("id", *keep).join(sums, ["id", *keep], "left").na.fill(0.0)


def difference_norms(pairs: DataFrame, min_df: int = 3, max_df: float = 0.98, size: int = 80_000) -> DataFrame:
    """diff_l2, diff_l1 of the unnormed TF-IDF of the words in one text only."""
    rows = Scratch(pairs.sparkSession, "tfidf").keep(pairs.select("id", "question1", "question2", F.lit(0).alias("fold")))
    terms = _differences(rows, "fold")
    vocab = fit(terms, rows.count(), min_df, max_df, size).withColumn("fold", F.lit(0))
    return _norms(_once(_own_fold(terms, vocab)), rows)


def _once(terms: DataFrame) -> DataFrame:
    """Terms (idf) that a text holds once, with their weight."""
    return terms.withColumn("w", F.col("idf"))


def oof_difference_norms(pairs: DataFrame, k: int = 5, min_df: int = 3, max_df: float = 0.98, size: int = 80_000) -> DataFrame:
    """As difference_norms, each pair under the vocabulary of the other folds."""
    rows, sizes = _folded(pairs, k)
    terms = _differences(rows, "fold")
    return _norms(_once(_own_fold(terms, fit_folds(terms, sizes, min_df, max_df, size, sides=1))), rows)


def tested_difference_norms(pairs: DataFrame, test: DataFrame, k: int = 5, min_df: int = 3, max_df: float = 0.98, size: int = 80_000) -> DataFrame:
    """As tested_features, for the norms of differences."""
    rows, sizes = _folded(pairs, k)
    vocab = fit_folds(_differences(rows, "fold"), sizes, min_df, max_df, size, sides=1)
    return _over_folds(_norms(_once(_every_fold(_differences(test), vocab)), _by_fold(test, k), "fold"))
