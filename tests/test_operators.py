import random
import re

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text, vectors
from pairloom.operators import clean, fuzzy, graph, iterative, stacking, tfidf, topics, vocabulary, walks
from pairloom.operators.components import connected_components
from pairloom.operators.numbering import numbered
from pairloom.plans import job, training, views
from pairloom.sources import tables
from pairloom.streaming import rowlocal


def edges(spark, pairs):
    return graph.edges_of(spark.createDataFrame(pairs, "u long, v long"))


def sample(seed, n=30, m=60):
    r = random.Random(seed)
    return sorted({tuple(sorted((r.randrange(n), r.randrange(n)))) for _ in range(m)})


def neighbours(pairs):
    out = {}
    for u, v in pairs:
        out.setdefault(u, set()).add(v)
        out.setdefault(v, set()).add(u)
    return out


def test_cleaning(spark):
    rows = spark.createDataFrame([("1", "b", "x"), ("1", "a", "y"), ("q", "a", "b"), ("2", None, "b"), ("16777217", "c", "d")], "id string, question1 string, question2 string")
    got = {(r.id, r.question1) for r in clean.clean_pairs(rows).collect()}
    assert got == {(1, "a"), (16777217, "c")}


def test_normalising(spark):
    row = spark.createDataFrame([("  A \tB  ", None)], "a string, b string").select(text.normalize(F.col("a")), text.normalize(F.col("b")), text.word_tokens(F.lit("Été à l'école x"))).first()
    assert (row[0], row[1], row[2]) == ("a b", "", ["été", "école"])


def test_similarities_of_empty_texts(spark):
    row = clean.token_similarity(spark.createDataFrame([(1, "", None)], "id long, question1 string, question2 string")).first()
    assert row.jaccard_distance == 1.0 and row.dice == 0.0


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_fuzzy_against_plain_dynamic_programs():
    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choices("ab c", k=r.randrange(1, 14))) for _ in range(2))
        assert abs(fuzzy.ratio(a, b) - 200 * slow_lcs(a, b) / (len(a) + len(b))) < 1e-9
        s, l = (a, b) if len(a) <= len(b) else (b, a)
        both = [(s, l), (l, s)] if len(a) == len(b) else [(s, l)]
        best = max(200 * slow_lcs(x, w) / (len(x) + len(w)) for x, y in both for e in range(1, len(y) + len(x)) if (w := y[max(0, e - len(x)) : e]))
        assert abs(fuzzy.partial_ratio(a, b) - best) < 1e-9
    pairs = [tuple("".join(r.choices("ab é🙂", k=r.choice([0, 1, 5, 30, 90]))) for _ in range(2)) for _ in range(300)]
    together = fuzzy.partial_ratios(pairs)
    assert together == {p: fuzzy.partial_ratio(*p) for p in pairs} and fuzzy.partial_ratio("", "") == 100.0 and fuzzy.partial_ratio("a", "") == 0.0
    long_ = "".join(r.choices("abcdefgh", k=33_000))
    assert fuzzy.partial_ratio(long_[20_000:20_040] + "!", long_) == pytest.approx(100 * 80 / 82)  # more characters than 16 bits number
    assert fuzzy.token_set_ratio("new york mets", "mets york new new") == 100.0
    assert fuzzy.token_set_ratio("", "a") == 0.0 and fuzzy.weighted_ratio("", "") == 0.0
    assert fuzzy.weighted_ratio("same text", "same text") == 100.0


def test_components_and_cores_and_caps(spark):
    pairs = sample(1) + [(100, 101), (200, 200)]
    e = edges(spark, pairs)
    near = neighbours(pairs)
    comp = {r.node: r.component for r in graph.component_table(e).collect()}
    for start in near:
        seen, stack = {start}, [start]
        while stack:
            for x in near[stack.pop()] - seen:
                seen.add(x)
                stack.append(x)
        assert comp[start] == min(seen)
    left = {k: v - {k} for k, v in near.items()}
    core, k = {}, 0
    alive = {x for x in left if left[x]}
    while alive:
        k += 1
        while low := [x for x in alive if len(left[x] & alive) < k]:
            for x in low:
                core[x] = k - 1
            alive -= set(low)
    assert {r.node: r.core for r in iterative.core_numbers(e).collect()} == {x: c for x, c in core.items()}

    deg_cap, sample_k, size_cap = 4, 3, 6
    far = {}
    for r in graph.two_hop(spark.createDataFrame([(x,) for x in near], "node long"), graph.adjacency(e), deg_cap, sample_k, size_cap).collect():
        far.setdefault(r.node, set()).add(r.x)
    for u, nb in near.items():
        order, got = sorted(nb), set()
        for w in order[:sample_k] if len(nb) > deg_cap else order:
            got |= near[w]
            if len(got) > size_cap:
                break
        assert far.get(u, set()) == got - {u} - nb, u


def test_rank_sums_to_one_and_clustering_is_a_share(spark):
    e = edges(spark, sample(2))
    assert abs(iterative.pagerank(e).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    rows = graph.clustering(e).collect()
    assert all(0 <= r.clustering <= 1 for r in rows) and sum(r.triangles for r in rows) % 3 == 0


def test_shortest_path_on_a_path(spark):
    e = edges(spark, [(i, i + 1) for i in range(7)])
    asked = spark.createDataFrame([(0, 0), (0, 3), (0, 4), (0, 6), (0, 99), (99, 99)], "u long, v long")
    assert {(r.u, r.v): r.distance for r in graph.bounded_shortest_path(asked, e).collect()} == {(0, 0): 0, (0, 3): 3, (0, 4): 4, (0, 6): 5, (0, 99): -1, (99, 99): 0}


def test_core_numbers_of_chains_and_tails(spark):
    """A chain that 200 rounds don't settle, and a tail on a triangle; too few rounds raise."""
    chain, tail = [(i, i + 1) for i in range(450)], [(1000, 1001), (1001, 1002), (1000, 1002)] + [(i, i + 1) for i in range(1002, 1030)]
    got = {r.node: r.core for r in iterative.core_numbers(edges(spark, chain + tail)).collect()}
    assert got == {i: 2 if 1000 <= i <= 1002 else 1 for i in [*range(451), *range(1000, 1031)]}
    with pytest.raises(RuntimeError):
        iterative.core_numbers(edges(spark, tail), max_rounds=5)


def test_two_hop_query_has_no_caps(spark, monkeypatch):
    """A hub of 250 neighbours with one more each: the query counts them all, as its SQL does."""
    from pairloom.plans import registry

    e = edges(spark, [(0, i) for i in range(1, 251)] + [(i, 1000 + i) for i in range(1, 251)])
    monkeypatch.setattr(registry, "graph_pairs", lambda spark, sf_dir: e)
    got = {(r.u, r.v): (r.size_u, r.size_v) for r in registry.queries()["two_hop_pairs"](spark, "").collect()}
    assert got[0, 1] == (250, 249) and got[250, 1250] == (249, 1) and len(got) == 500


def test_empty_graph(spark):
    e = edges(spark, [])
    assert connected_components(e, "u", "v").count() == 0 and graph.link_features(e, e).count() == 0 and iterative.core_numbers(e).count() == 0


def test_folds_balance_and_cover(spark):
    rows = tfidf.folds(spark.range(103).select("id", (F.col("id") % 3 == 0).cast("int").alias("is_duplicate"))).groupBy("fold", "is_duplicate").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in rows if r.is_duplicate == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_terms_meet_idfs_in_their_own_task(spark, monkeypatch):
    """Terms are neither shuffled by term nor once for each fold; more pairs are more partitions, not larger ones."""
    pairs = spark.createDataFrame([(i, f"red apple tree{i % 3}", f"red apple tree{i % 2}", i % 2) for i in range(60)], "id long, question1 string, question2 string, is_duplicate int")
    for made in (tfidf.oof_features(pairs, min_df=1), tfidf.tested_features(pairs, pairs, min_df=1), tfidf.tested_difference_norms(pairs, pairs, min_df=1)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not re.search(r"hashpartitioning\((fold|term)", plan)
        assert made.count() == 60
    monkeypatch.setattr(tfidf, "PAIRS", 3)
    assert tfidf.dealt(pairs, 60).rdd.getNumPartitions() == 20


def test_common_neighbours_of_test_pairs_need_no_ranks(spark, monkeypatch):
    """The test table asks for common neighbours alone; ranks, components and paths of the whole graph are not made for it."""
    from pairloom.plans import registry

    def made(*_, **__):
        raise AssertionError("not needed")

    for module, name in ((iterative, "pagerank"), (graph, "component_table"), (graph, "bounded_shortest_path")):
        monkeypatch.setattr(module, name, made)
    assert "cn" in registry.queries()["test_table"](spark, "/root/testdata/sf0.001").columns


@pytest.mark.parametrize("name", ["katz_pairs", "graph_features"])
def test_order_lines_are_joined_once(spark, monkeypatch, name):
    """What a query of the graph returns reads the written pairs, not the order lines again."""
    from pairloom.plans import registry

    asked, make = [], registry.graph_pairs
    monkeypatch.setattr(registry, "graph_pairs", lambda *x: asked.append(x) or make(*x))
    files = registry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "lineitem" in f] and len(asked) == 1


def test_vocabulary_and_encoding(spark):
    pairs = spark.createDataFrame([(1, "b a b", "c"), (2, "", "a d")], "id long, question1 string, question2 string")
    vocab = vocabulary.vocabulary(pairs)
    assert {r.token: r.idx for r in vocab.collect()} == {"b": 2, "a": 3, "c": 4, "d": 5}
    got = {r.id: (r.ids, r.len) for r in vocabulary.sentences(pairs, "question1", vocab, max_len=4).collect()}
    assert got == {1: ([2, 3, 2, 0], 3), 2: ([0, 0, 0, 0], 0)}
    chars = vocabulary.characters(pairs, "question1", max_len=2, max_char_len=3).where("id = 1").first().chars
    assert chars == [[3, 0, 0], [2, 0, 0]]
    assert len(text.CHARACTERS) == len(set(text.CHARACTERS)) == 63


def test_vectors(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = row.select(*(c.alias(n) for n, c in vectors.embedding_pair(F.col("a"), F.col("b")).items())).first()
    assert got.cos == 0 and got.dot == 0 and abs(got.l2 - 5**0.5) < 1e-9
    pooled = spark.sql("select array(array(1D, 2D), array(3D, 4D)) as r, array(1D, 0D) as m").select(vectors.masked_mean(F.col("r"), F.col("m"), 2).alias("x")).first().x
    assert pooled == [1.0, 2.0]


def test_walks_follow_edges(spark):
    pairs = sample(3)
    e = walks.core_graph(graph.edges_of(spark.createDataFrame(pairs, "u long, v long"), self_loops=False))
    real = {(r.u, r.v) for r in e.collect()}
    made = walks.random_walks(e, walks=2, length=6).collect()
    nodes = {x for p in real for x in p}
    assert len(made) == 2 * len(nodes) and all(len(r.nodes) == 6 for r in made)
    assert all((min(a, b), max(a, b)) in real for r in made for a, b in zip(r.nodes, r.nodes[1:]))


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text('id,question1,question2,is_duplicate\n1,"a ""quoted""\nline",b,0\n2,NA,c,1\n3.0,d,e,1\n')
    rows = {r.id: (r.question1, r.is_duplicate) for r in tables.read_pairs(spark, str(path)).collect()}
    assert rows == {1: ('a "quoted"\nline', 0), 2: (None, 1), 3: ("d", 1)}
    (tmp_path / "v.txt").write_text("the 0.5 -1\n")
    assert tables.read_vectors(spark, str(tmp_path / "v.txt")).first().vec == [0.5, -1.0]
    (tmp_path / "v.json").write_text('{"<pad>": 0, "a": 2}')
    assert {r.token: r.idx for r in tables.read_vocabulary(spark, str(tmp_path / "v.json")).collect()} == {"<pad>": 0, "a": 2}
    out = stacking.submission(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 0.5)], "id long, is_duplicate double"))
    tables.write_submission(out, str(tmp_path / "out"))
    assert sorted(x.strip() for f in (tmp_path / "out").glob("part-*") for x in f.open()) == ["1,0.5", "2,0.0", "id,is_duplicate"]


def test_batch_prediction(spark):
    def load():
        return lambda frame: frame.assign(prob=frame.x * 2)[["id", "prob"]]

    got = stacking.predict(spark.createDataFrame([(1, 2.0)], "id long, x double"), load, "id long, prob double").first()
    assert got.prob == 4.0


def test_streams(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a b", "b c")], "id long, question1 string, question2 string")
    pairs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
    rowlocal.start(stream, "words", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.common_words, row.diff_words) == ("b", "a c")


def test_vocabulary_round_trip_and_ids(spark, tmp_path):
    vocab = spark.createDataFrame([(f'a"{i}', i) for i in range(2500)], "token string, idx long")
    tables.write_vocabulary(vocab, str(tmp_path / "v"))
    assert {r.token: r.idx for r in tables.read_vocabulary(spark, str(tmp_path / "v")).collect()} == {f'a"{i}': i for i in range(2500)}
    (tmp_path / "t.csv").write_text("id,question1,question2,is_duplicate\n9007199254740993,a,b,0\n1e30,a,b,0\nx,a,b,1\n4.0,a,b,1\n")
    assert [r.id for r in tables.read_pairs(spark, str(tmp_path / "t.csv")).collect()] == [9007199254740993, None, None, 4]


def test_folds_are_merged_in_order(spark, tmp_path):
    parts = spark.createDataFrame([(i, f, float(i * f)) for i in (3, 1, 2) for f in range(5)], "id long, fold int, x double")
    tables.write_features(parts, str(tmp_path / "parts"), "fold")
    tables.merge_folds(spark, str(tmp_path / "parts"), str(tmp_path / "all"))
    assert [(r.id, r.x) for r in spark.read.parquet(str(tmp_path / "all")).collect()] == [(1, 2.0), (2, 4.0), (3, 6.0)] and not (tmp_path / "parts").exists()
    assert stacking.mean_loss(spark.createDataFrame([(0, 0.5), (1, 1.0)], "fold int, log_loss double")).first().mean_loss == 0.75
    weighed = stacking.weigh_pairs(spark.createDataFrame([(1, 7, 8), (2, 8, 9)], "id long, u long, v long"), spark.createDataFrame([(2, 0.25)], "id long, prob double"))
    assert [(r.u, r.v, r.weight) for r in graph.weighted_edges(weighed).collect()] == [(8, 9, 0.25)]


def test_masks_and_hashes(spark):
    import hashlib

    row = spark.sql("select array(array(1D, -2D), array(3D, -4D), array(9D, 9D)) as r, array(1D, 2D, 50D) as x, ' Ab  C' as t, 2 as n")
    mask = vectors.length_mask(F.col("n"), 3)
    got = row.select(mask.alias("m"), vectors.masked_softmax(F.col("x"), mask).alias("s"), vectors.masked_max(F.col("r"), mask, 2).alias("top"), vectors.first_row(F.col("r")).alias("cls"), text.blake_hash(F.col("t")).alias("h")).first()
    assert got.m == [1.0, 1.0, 0.0] and got.top == [3.0, -2.0] and got.cls == [1.0, -2.0] and got.s[2] == 0 and abs(got.s[1] / got.s[0] - 2.718281828) < 1e-6 and abs(sum(got.s) - 1) < 1e-12
    assert got.h == hashlib.blake2b(b"ab c", digest_size=16).hexdigest()


def test_subword_views(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pairloom.operators import subwords

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    pairs = spark.createDataFrame([(1, "a short text", "another one"), (2, None, "word " * 200)], "id long, question1 string, question2 string")
    one = {r.id: r for r in subwords.single_view(pairs, "question1", lambda: path, 12).collect()}
    ids = t.encode("a short text").ids
    assert one[1].ids[: len(ids)] == ids and len(one[1].ids) == 12 and sum(one[1].mask) == len(ids) and len(one[2].ids) == 12
    both = {r.id: r for r in subwords.joint_view(pairs, lambda: path, 30).collect()}
    ids = t.encode("a short text", "another one").ids
    assert both[1].ids[: len(ids)] == ids and all(len(x) == 30 for r in both.values() for x in (r.ids, r.mask, r.types)) and sum(both[2].mask) == 30


def test_ranks_settle_or_raise(spark):
    e = edges(spark, sample(5))
    near, far = (iterative.pagerank(e, rounds=100, tolerance=x) for x in (1e-9, 1e-4))
    a, b = ({r.node: r["rank"] for r in x.collect()} for x in (near, far))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-2 and abs(sum(a.values()) - 1) < 1e-9
    with pytest.raises(RuntimeError):
        iterative.pagerank(e, rounds=5, tolerance=1e-12)
    with pytest.raises(RuntimeError):
        iterative.katz(e, rounds=5, tolerance=1e-9)


def test_numbers_in_groups_and_ranges(spark):
    """One group holds most rows; one is null."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 == 0, "a").when(F.col("id") % 11 == 0, None).otherwise("hot").alias("g"), F.xxhash64("id").alias("x")).repartition(5)
    got = numbered(rows, ["g"], [F.desc("x")], "n").collect()
    own = {}
    for r in sorted(got, key=lambda r: -r.x):
        own.setdefault(r.g, []).append(r.n)
    assert len(got) == 3000 and set(own) == {"a", "hot", None} and all(n == list(range(1, len(n) + 1)) for n in own.values())
    assert numbered(rows.limit(0), [], [F.col("x")], "n").count() == 0


def test_walkers_take_along_few_nodes(spark, monkeypatch):
    """What is written for a walker holds the nodes of a few steps, and the walks don't depend on how many."""
    e = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(0, 3), (2, 5)], "u long, v long")
    keep, most = walks.Scratch.keep, []

    def kept(self, df):
        if "nodes" in df.columns:
            most.append(df.agg(F.max(F.size("nodes"))).first()[0])
        return keep(self, df)

    monkeypatch.setattr(walks.Scratch, "keep", kept)
    short, whole = ({r.walk: r.nodes for r in walks.random_walks(e, walks=2, length=9, every=every).collect()} for every in (2, 20))
    assert short == whole and len(short) == 14 and all(len(x) == 9 for x in short.values()) and max(most) <= 3


def test_vectors_train_in_few_partitions(spark, monkeypatch):
    made, real = [], walks.Word2Vec
    monkeypatch.setattr(walks, "Word2Vec", lambda **options: made.append(options) or real(**options))
    frame = spark.createDataFrame([([1, 2, 3],)] * 40, "nodes array<long>")
    assert walks.node_vectors(frame, size=4, sentences=1).count() == 3 and made[0]["numPartitions"] == 16


def test_vectors_train_in_whole_waves():
    """Sixteen partitions on twelve cores would take two waves, the second with four."""
    assert [walks.training_partitions(10**7, cores) for cores in (1, 6, 8, 12, 16, 100)] == [16, 12, 16, 12, 16, 16]
    assert walks.training_partitions(0, 12) == 1 and walks.training_partitions(30_000, 12) == 3


def test_walks_draw_by_weight_in_buckets(spark):
    """A hub whose neighbours lie in many buckets: each is met in proportion to its weight."""
    e = spark.createDataFrame([(0, i, 3.0 if i <= 20 else 1.0) for i in range(1, 41)], "u long, v long, weight double")
    for bucket in (4, 1024):
        steps = [b for r in walks.random_walks(e, walks=60, length=8, bucket=bucket).collect() for a, b in zip(r.nodes, r.nodes[1:]) if a == 0]
        heavy = sum(b <= 20 for b in steps) / len(steps)
        assert len(steps) == 40 * 60 * 3 + 60 * 4 and abs(heavy - 0.75) < 0.03 and len(set(steps)) == 40


def test_common_neighbours_of_a_hub(spark):
    e = edges(spark, [(0, i) for i in range(1, 60)] + [(1, 2), (1, 3), (2, 3)])
    got = {(r.u, r.v): r.cn for r in graph.link_features(e, e).collect()}
    assert got[0, 1] == 2 and got[0, 50] == 0 and got[1, 2] == 2


def test_out_of_fold_models_never_see_their_rows(spark):
    pairs = spark.range(50).select("id", (F.col("id") % 2).cast("int").alias("is_duplicate"))
    test = spark.range(100, 103).select("id")

    def fit(rows):
        return sorted(r.id for r in rows.collect())

    def apply(seen, rows):
        return rows.select("id", F.array_contains(F.array(*map(F.lit, seen)), F.col("id")).cast("double").alias("seen"), F.lit(float(len(seen))).alias("n"))

    held, tested = stacking.out_of_fold(pairs, fit, apply, 5, test)
    assert [(r.seen, r.n) for r in held.orderBy("id").collect()] == [(0.0, 40.0)] * 50
    assert {(r.id, r.n) for r in tested.collect()} == {(100, 40.0), (101, 40.0), (102, 40.0)}


def test_latent_models_are_written(spark):
    """The loadings lie in files, not in the plan of what reads them."""
    pairs = spark.createDataFrame([(i, f"red apple tree{i % 3}", f"red apple tree{i % 2}") for i in range(12)], "id long, question1 string, question2 string")
    model = topics.latent_model(pairs, k=2, min_df=1, max_df=1.0)
    assert model.inputFiles() and {len(r.v) for r in model.collect()} == {2}


def test_latent_rows_shuffle_nothing(spark):
    """Pairs meet the loadings in their own task, with texts or with their common words; a pair without terms gets zeros."""
    pairs = spark.createDataFrame([(i, f"red apple tree{i % 3}", f"red apple tree{i % 2}") for i in range(12)] + [(12, None, "red"), (13, "x", "x")], "id long, question1 string, question2 string")
    model = topics.latent_model(pairs, k=2, min_df=2, max_df=1.0)
    made = topics.latent_rows(model, pairs, 3)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got, same = ({r.id: r.svd for r in rows.collect()} for rows in (made, topics.latent_rows(model, topics.common_words(pairs), 3)))
    assert got == same and len(got) == 14 and got[12] == got[13] == [0.0] * 3 and 0.5 < got[0][0] <= 1 and got[0][2] == 0


def test_latent_vectors_against_numpy(spark):
    import numpy as np

    r = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.sample(words, 5)) for _ in range(40)]
    pairs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)] + [(99, "a", "b")], "id long, question1 string, question2 string")
    got = {x.id: x.svd for x in topics.latent_features(pairs, k=3, min_df=1).collect()}
    has = np.array([[w in t.split() for w in sorted(words)] for t in texts], float)
    x = has * (np.log((1 + 41) / (1 + has.sum(0))) + 1)
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = np.linalg.svd(x, full_matrices=False)[2][:3].T
    v *= np.sign(v[np.abs(v).argmax(0), range(3)])
    assert got[99] == [0.0] * 3 and np.abs(np.array([got[i] for i in range(40)]) - x @ v).max() < 1e-6


def test_singular_vectors_of_sparse_rows(spark):
    import numpy as np

    g = np.random.default_rng(3)
    a = (g.normal(size=(300, 40)) * 0.8 ** np.arange(40)) * (g.random((300, 40)) < 0.4)
    rows = spark.createDataFrame([([int(i) for i in np.flatnonzero(x)], [float(v) for v in x[np.flatnonzero(x)]]) for x in a], "idx array<int>, w array<double>")
    got = topics.right_singular_vectors(rows.repartition(5), 40, 6)
    want = np.linalg.svd(a, full_matrices=False)[2][:6].T
    assert got.shape == (40, 6) and np.allclose(abs((got * want).sum(0)), 1, atol=1e-4)
    assert np.allclose(got.T @ got, np.eye(6), atol=1e-9)


def test_stacker_stops_by_the_held_out_fold(spark):
    r = random.Random(3)
    rows = [(i, x := r.random(), int(x + r.gauss(0, 0.2) > 0.5)) for i in range(200)]
    table = spark.createDataFrame(rows, "id long, x double, is_duplicate int")
    scored, tested = stacking.stack(table.select("id", "x"), table.select("id", "is_duplicate"), 2, table.select("id", "x").limit(5), lambda: stacking.boosted_trees(8, 2, 5, 0.3))
    loss = scored.agg(stacking.log_loss(F.col("prob"), F.col("is_duplicate"))).first()[0]
    assert scored.count() == 200 and loss < 0.6 and tested.count() == 5
    p = stacking.logit_loss(F.lit(800.0), F.lit(0.0))
    assert spark.range(1).agg(p).first()[0] == 800.0


def test_word_vectors_and_models_means(spark):
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, idx long")
    table = vocabulary.vector_table(vocab, spark.createDataFrame([("a", [1.0, 2.0])], "token string, vec array<double>"), 2)
    got = {r.token: r.vec for r in table.collect()}
    assert got["a"] == [1.0, 2.0] and len(got["b"]) == 2 and 0 < max(map(abs, got["b"])) < 0.1
    encoded = spark.createDataFrame([(1, [2, 1, 3, 0])], "id long, ids array<int>")
    assert vocabulary.sentence_vectors(encoded, table, 2).first().rows == [[1.0, 2.0], [0.0, 0.0], got["b"], [0.0, 0.0]]
    loads = [lambda n=n: lambda frame: frame.assign(prob=frame.x * n) for n in (1, 3)]
    assert stacking.predict_mean(spark.createDataFrame([(1, 2.0)], "id long, x double"), loads, "id long, x double, prob double").first().prob == 4.0


def test_training_table_counts_whole_two_hop_sets(spark):
    """A hub of 250 neighbours with one more each: no cap of degree or size drops any."""
    pairs = spark.createDataFrame([(i, "hub", f"near {i}") for i in range(250)] + [(250 + i, f"near {i}", f"far {i}") for i in range(250)], "id long, question1 string, question2 string")
    got = {r.id: {r.twohop_size_u, r.twohop_size_v} for r in training.training_table(pairs, ["twohop"]).collect()}
    assert all(got[i] == {249, 250} and got[250 + i] == {1, 249} for i in range(250)) and len(got) == 500


def test_training_table_takes_given_families(spark):
    pairs = spark.createDataFrame([(1, "a b", "b c", 1), (2, "B  c", "a b", 0), (3, "x", "x", 0)], "id long, question1 string, question2 string, is_duplicate int")
    nodes = {r.id: (r.u, r.v) for r in training.question_nodes(pairs).collect()}
    assert nodes[1] == nodes[2][::-1] and nodes[3][0] == nodes[3][1] and {x for p in nodes.values() for x in p} == {1, 2, 3}
    neural = spark.createDataFrame([(1, 0.5)], "id long, prob double")
    got = {r.id: r for r in training.training_table(pairs, ["basic", "neighbor"], {"esim": neural}).collect()}
    assert len(got) == 3 and got[1].esim_prob == 0.5 and got[2].esim_prob is None and got[1].neighbor_and_min == 1.0 and got[1].is_duplicate == 1


def test_job_arguments():
    asked = job.parse(["--tables", "x", "--out", "y", "--queries", "degree, components"])
    assert asked.queries == ["degree", "components"] and job.listed(int)("0,2") == [0, 2]
    with pytest.raises(SystemExit):
        job.parse(["--tables", "x", "--out", "y", "--queries", "nothing"])


def test_tokens_of_english(spark):
    """Tokens that part or stay whole by rule."""
    cases = {
        "I can't; they cannot, she's gonna!": ["i", "ca", "n't", ";", "they", "can", "not", ",", "she", "'s", "gon", "na", "!"],
        "See https://a.org/x?y=1, or mail me.too@b.co.uk.": ["see", "https://a.org/x?y=1", ",", "or", "mail", "me.too@b.co.uk", "."],
        "The U.S. has 1,234.5 km... at 10km, 3rd": ["the", "u.s.", "has", "1,234.5", "km", "...", "at", "10", "km", ",", "3rd"],
        "Dr. No vs. well-known -- $5 :) (ok)": ["dr.", "no", "vs.", "well", "-", "known", "--", "$", "5", ":)", "(", "ok", ")"],
        "don\u2019t we\u2019ll caf\u00e9": ["do", "n\u2019t", "we", "\u2019ll", "caf\u00e9"],
        "canada wanna gotta notary": ["canada", "wan", "na", "got", "ta", "notary"],
        "": [],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", vocabulary.words(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == cases


def test_subword_vectors(spark):
    def fnv(gram):
        h = 2166136261
        for b in gram.encode():
            h = ((h ^ (b if b < 128 else b | 0xFFFFFF00)) * 16777619) & 0xFFFFFFFF
        return h

    def grams(w, a=3, b=6):
        w = f"<{w}>"
        return [w[i : i + n] for i in range(len(w)) for n in range(a, b + 1) if i + n <= len(w)]

    words = ["a", "word", "na\u00efve", "\U0001f642x", "aaaaaa", "other"]
    table = spark.createDataFrame([(w,) for w in [*words, "word", None]], "token string")
    got = {r.token: r.g for r in table.select("token", vocabulary.character_ngrams(F.col("token")).alias("g")).where("token is not null").collect()}
    assert {w: sorted(g) for w, g in got.items()} == {w: sorted(grams(w)) for w in words}
    hashes = table.where("token is not null").select(F.explode(vocabulary.character_ngrams(F.col("token"))).alias("g")).select("g", vocabulary.ngram_bucket(F.col("g"), 1 << 40).alias("h")).collect()
    assert all(r.h == fnv(r.g) for r in hashes)
    r = random.Random(1)
    vecs = {b: [r.random(), r.random()] for b in {fnv(g) % 50 for w in words[:5] for g in grams(w)}}
    known = {"word": [1.0, 2.0], "unasked": [5.0, 5.0]}
    made = vocabulary.subword_vectors(table, spark.createDataFrame(list(vecs.items()), "bucket long, vec array<double>"), spark.createDataFrame(list(known.items()), "token string, vec array<double>"), buckets=50)
    found = {x.token: x.vec for x in made.collect()}
    for w in words:
        parts = [vecs[b] for g in grams(w) if (b := fnv(g) % 50) in vecs] + ([known[w]] if w in known else [])
        assert found.get(w) == (pytest.approx([sum(c) / len(parts) for c in zip(*parts)]) if parts else None)
    of_words = vocabulary.bucket_vectors(spark.createDataFrame([("abc", [1.0]), ("abd", [3.0])], "token string, vec array<double>"), 3, 3, 1 << 40)
    assert {x.bucket: x.vec[0] for x in of_words.collect()} == {fnv("<ab"): 2.0, fnv("abc"): 1.0, fnv("bc>"): 1.0, fnv("abd"): 3.0, fnv("bd>"): 3.0}


def test_boosting_is_patient(spark):
    assert stacking.best_round([3.0, 2.0, 2.5, 2.4, 1.0], 2) == (2, True) and stacking.best_round([3.0, 2.0, 2.5, 1.0, 1.0], 3) == (4, False) and stacking.best_round([1.0], 5) == (1, False)
    r = random.Random(8)
    rows = [(i, x := r.random(), r.random(), int(x + r.gauss(0, 0.4) > 0.5)) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, x double, z double, is_duplicate int")
    make = lambda: stacking.boosted_trees(24, 3, 3, 0.4)
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(table).coalesce(1).cache()
    train, held = data.where("id >= 100"), data.where("id < 100")
    model = stacking.patient_trees(train, held, 24, 3, lambda n: make().setMaxIter(n))
    losses = make().fit(train).evaluateEachIteration(held)
    best = stacking.best_round(losses, 3)[0]
    assert model.getNumTrees == best and model.evaluateEachIteration(held) == pytest.approx(losses[:best])
    scored, _ = stacking.stack(table.select("id", "x", "z"), table.select("id", "is_duplicate"), 2, make=lambda: stacking.boosted_trees(6, 2, 5, 0.3), patience=2)
    assert scored.count() == 300


def test_tables_of_training_and_test_pairs(spark, monkeypatch):
    """Equal ids in both tables stay apart; the graph holds both; the walks take the given probabilities as weights."""
    r = random.Random(12)
    words = ["a b", "b c", "c d", "d e", "e a", "f"]
    rows = [(i, r.choice(words), r.choice(words), i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "id long, question1 string, question2 string, is_duplicate int")
    test = spark.createDataFrame([(i, r.choice(words), "new " + r.choice(words)) for i in range(15)], "id long, question1 string, question2 string")
    seen = []
    monkeypatch.setattr(training, "_walks", lambda edges: seen.append(edges) or spark.createDataFrame([], "node long, vec array<double>"))
    scores = spark.createDataFrame([(i, 0.25 + i / 1000) for i in range(40)], "id long, prob double")
    of_test = spark.createDataFrame([(i, 0.75) for i in range(15)], "id long, prob double")
    own, tested = training.feature_tables(train, test, ["basic", "double", "neighbor", "n2v"], {"deberta": scores}, {"deberta": of_test})
    assert own.count() == 40 and tested.count() == 15 and set(tested.columns) == set(own.columns) - {"is_duplicate"}
    assert seen[0].where("u = v").count() == 0 and seen[0].agg(F.max("weight")).first()[0] == 0.75
    degree = {}
    for p in train.collect() + test.collect():
        a, b = (" ".join(x.split()) for x in (p.question1, p.question2))
        degree.setdefault(a, set()).add(b)
        degree.setdefault(b, set()).add(a)
    d = {n: len(s) + (n in s) for n, s in degree.items()}
    near = {n: sum(d[x] for x in s) / d[n] for n, s in degree.items()}
    got = {x.id: x for x in tested.collect()}
    for p in test.collect():
        assert got[p.id].neighbor_and_max == pytest.approx(max(near[p.question1], near[p.question2]))
    assert {x.id: x.basic_dice for x in own.collect()} == {x.id: x.dice for x in clean.token_similarity(train).collect()}
    scored, sent = training.predict_pairs(train, test, spark.range(20).select("id"), ["basic", "neighbor"], lambda: stacking.boosted_trees(4, 2, 2, 0.3), 2)
    sent = {x.id: x.is_duplicate for x in sent.collect()}
    assert len(sent) == 20 and all(sent[i] == 0 for i in range(15, 20)) and all(0 < sent[i] < 1 for i in range(15)) and scored.count() == 40


def test_functions_and_views_in_sql(spark):
    """SQL's functions are the DataFrame functions, nulls and accents included, and run no Python."""
    names = views.create(spark, "/root/testdata/sf0.001", ["degree"])
    assert "degree" in names and spark.sql("select count(*) from degree join graph_pairs on node = u").first()[0] > 0
    pairs = spark.createDataFrame([(1, " Caf\u00e9\u00a0 x a1", "x A1 b"), (2, None, "x"), (3, "", None)], "id long, question1 string, question2 string")
    made = spark.sql("select id, normalize_text(question1) n, text_hash(question1) h, pair_jaccard_distance(question1, question2) j, pair_dice(question1, question2) d, common_words(question1, question2) c, diff_words(question1, question2) w from {p}", p=pairs)
    assert "Python" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()
    like = {r.id: r for r in clean.token_similarity(pairs).join(clean.word_differences(pairs), "id").join(clean.hash_pairs(pairs), "id").collect()}
    for r in made.collect():
        q = like[r.id]
        assert (r.h, r.j, r.d, r.c, r.w) == (q.h1, q.jaccard_distance, q.dice, q.common_words, q.diff_words)
    rows = spark.createDataFrame([([0.2, 0.8], [0.5, 0.5]), ([0.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    want = rows.select(vectors.cosine(a, b), vectors.jensen_shannon(a, b), vectors.entropy(a), vectors.argmax(a).cast("long"), vectors.norm(a)).collect()
    got = spark.sql("select vec_cosine(a, b), vec_jsd(a, b), vec_entropy(a), vec_argmax(a), vec_norm(a) from {r}", r=rows).collect()
    assert all(tuple(x) == pytest.approx(tuple(y)) for x, y in zip(got, want))
    assert spark.sql("select logit_loss(800D, 0D), logit_loss(0D, 1D)").first()[0] == 800.0


def test_components_round_is_one_query(spark, monkeypatch):
    """A round's count and checksum come with its writing; nothing is read again for them."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")

    def refuse(self):
        raise AssertionError("read again")

    with monkeypatch.context() as m:
        m.setattr(type(edges), "first", refuse)
        found = connected_components(edges, "a", "b")
        none = connected_components(edges.where("a = b"), "a", "b")
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}
    assert none.collect() == []
