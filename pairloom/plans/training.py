"""The stacker's tables: families of pair features for training and test pairs, each by id, joined and labelled; and the stacked prediction of test pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import clean, encoders, fuzzy, graph, iterative, stacking, tfidf, topics, walks
from pairloom.operators.numbering import numbered
from pairloom.plans.lineage import Scratch

#: A family's features of the training pairs and, where there are test pairs, of those.
Tables = tuple[DataFrame, DataFrame | None]


def question_nodes(pairs: DataFrame) -> DataFrame:
    """id, u, v: the numbers of the pair's normalised texts, in order of their hashes."""
    hashes = clean.hash_pairs(pairs)
    names = numbered(hashes.select(F.col("h1").alias("h")).union(hashes.select("h2")).distinct(), [], [F.col("h")], "node")
    for column, end in (("h1", "u"), ("h2", "v")):
        hashes = hashes.join(names.select(F.col("h").alias(column), F.col("node").alias(end)), column)
    return hashes.select("id", "u", "v")


def _local(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame | None], Tables]:
    """A family that looks at nothing but the pair."""
    return lambda pairs, test: (make(pairs), None if test is None else make(test))


def _counted(own: Callable[[DataFrame], DataFrame], of_test: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame | None], Tables]:
    return lambda pairs, test: (own(pairs), None if test is None else of_test(pairs, test))


def _latent(model: DataFrame, pairs: DataFrame) -> DataFrame:
    return topics.latent_rows(model, pairs).select("id", *(F.element_at("svd", i + 1).alias(str(i)) for i in range(64)))


def _neural(encoder: str) -> Callable[[DataFrame, DataFrame | None], Tables]:
    return lambda pairs, test: encoders.pair_features(pairs, encoder, test=test)


def _walks(edges: DataFrame) -> DataFrame:
    return walks.node_vectors(walks.random_walks(walks.core_graph(edges.where("u <> v"))))


#: Families made from the texts alone; what is fitted is fitted out of fold, and test pairs get the means over the folds' models.
TEXT: dict[str, Callable[[DataFrame, DataFrame | None], Tables]] = {
    "basic": _local(clean.token_similarity),
    "fuzzy": _local(fuzzy.fuzzy_ratios),
    "double": _counted(tfidf.oof_features, tfidf.tested_features),
    "diff": _counted(tfidf.oof_difference_norms, tfidf.tested_difference_norms),
    "svd": lambda pairs, test: stacking.out_of_fold(topics.common_words(pairs), topics.latent_model, _latent, test=None if test is None else topics.common_words(test)),
    "lda": lambda pairs, test: stacking.out_of_fold(pairs, topics.topic_model, topics.topic_pairs, test=test),
}
#: Families of trained heads over attention between the texts; made where they are named.
ENCODER_OF = {"sbert": "pooled", "deberta": "joint", "esim": "aligned", "diin": "interaction", "transformer": "channels", "bimpm": "matching"}
NEURAL: dict[str, Callable[[DataFrame, DataFrame | None], Tables]] = {name: _neural(encoder) for name, encoder in ENCODER_OF.items()}
#: Families made from the graph of which text is asked with which.
GRAPH: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "graph": lambda pairs, edges: graph.graph_features(pairs, edges, iterative.pagerank(edges)),
    "neighbor": lambda pairs, edges: graph.pair_features(pairs, graph.average_neighbour_degree(edges), {"and": 0.0}),
    "kcore": lambda pairs, edges: graph.pair_features(pairs, iterative.core_numbers(edges), {"core": 0}),
    "katz": lambda pairs, edges: graph.pair_features(pairs, iterative.katz(edges, rounds=200, tolerance=1e-6), {"katz": 0.0}, 1e-9),
    "triangle": graph.triangle_features,
    "components": lambda pairs, edges: graph.pair_features(pairs, graph.component_features(edges), {x: 1.0 if x == "size" else 0.0 for x in ("size", "density", "mean_deg", "max_deg", "avg_clust")}, 1e-12),
    "twohop": graph.two_hop_features,
    "n2v": lambda pairs, edges: walks.vector_features(pairs, _walks(edges)),
}
#: Parts of the family `graph` that go without its ranks, components and paths; made where they are named.
LINKS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"links": graph.link_features}


def _keyed(train: DataFrame, test: DataFrame, *columns: str) -> DataFrame:
    """Training and test rows as one table; even ids are training rows', odd ones test rows', so equal ids stay apart."""
    parts = [rows.select((2 * F.col("id") + side).alias("id"), *columns) for side, rows in enumerate((train, test))]
    return parts[0].union(parts[1])


def _side(rows: DataFrame, side: int) -> DataFrame:
    return rows.where(F.pmod("id", F.lit(2)) == side).withColumn("id", F.shiftright("id", 1))


def feature_tables(train: DataFrame, test: DataFrame | None = None, names: list[str] | None = None, given: dict[str, DataFrame] | None = None, given_test: dict[str, DataFrame] | None = None, nodes: DataFrame | None = None) -> Tables:
    """id and family_feature columns of the training pairs, with is_duplicate where they have it, and of the test pairs: the named families (text and graph ones by default) and
    the given ones, tables by id that models made elsewhere.

    The graph holds the pairs of both tables. Where the family `deberta` is named or given, its probabilities weigh the edges of the walks. `nodes` (id, u, v) says which nodes a
    training pair's texts are, by default question_nodes; it goes without test pairs."""
    names = [*TEXT, *GRAPH] if names is None else names
    scratch = Scratch(train.sparkSession, "training")
    made = {name: (TEXT | NEURAL)[name](train, test) for name in names if name in TEXT or name in NEURAL}
    made = {name: tuple(None if t is None else scratch.keep(t) for t in tables) if name in NEURAL else tables for name, tables in made.items()}
    made |= {name: (table, (given_test or {}).get(name)) for name, table in (given or {}).items()}
    if on_graph := [name for name in names if name in GRAPH or name in LINKS]:
        if nodes is None:
            nodes = question_nodes(train if test is None else _keyed(train, test, "question1", "question2"))
        nodes = scratch.keep(nodes)
        ends = scratch.keep(nodes.select("u", "v").distinct())
        edges = scratch.keep(graph.edges_of(ends))
        walked = edges
        if "n2v" in on_graph and "deberta" in made:
            own, of_test = made["deberta"]
            scores = own.select("id", "prob") if test is None or of_test is None else _keyed(own, of_test, "prob")
            walked = scratch.keep(graph.weighted_edges(stacking.weigh_pairs(nodes, scores)))
        for name in on_graph:
            wide = nodes.join((GRAPH | LINKS)[name](ends, walked if name == "n2v" else edges), ["u", "v"]).drop("u", "v")
            made[name] = (wide, None) if test is None else tuple(_side(scratch.keep(wide), side) for side in (0, 1))
    joined = stacking.join_features({name: tables[0] for name, tables in made.items()})
    if "is_duplicate" in train.columns:
        joined = joined.join(train.select("id", "is_duplicate"), "id", "left")
    return joined, None if test is None else stacking.join_features({name: tables[1] for name, tables in made.items() if tables[1] is not None})


def training_table(pairs: DataFrame, names: list[str] | None = None, given: dict[str, DataFrame] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """The training pairs' table alone."""
    return feature_tables(pairs, None, names, given, nodes=nodes)[0]


def predict_pairs(train: DataFrame, test: DataFrame, sample: DataFrame | None = None, names: list[str] | None = None, make: Callable[[], GBTClassifier] = stacking.boosted_trees, patience: int | None = 50, **given) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold probabilities of the training pairs (id, fold, is_duplicate, prob), and id, is_duplicate (the probability) for every id of the sample, by default the
    test pairs: 0 for ids that no test pair has."""
    own, of_test = feature_tables(train, test, names, **given)
    scratch = Scratch(train.sparkSession, "predicted")
    own, of_test = scratch.keep(own), scratch.keep(of_test)
    features = own.drop("is_duplicate")
    missing = [F.lit(None).cast(kind).alias(c) for c, kind in features.dtypes if c not in of_test.columns]
    scored, tested = stacking.stack(features, own.select("id", "is_duplicate"), test=of_test.select("*", *missing), make=make, patience=patience)
    return scored, stacking.submission(test if sample is None else sample, tested.select("id", F.col("prob").alias("is_duplicate")))
