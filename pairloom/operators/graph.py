"""The pair graph: edges, degrees, link prediction, triangles, components and their pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.pairs import look_up, pair_stats, safe_divide
from pairloom.operators.components import connected_components
from pairloom.plans.lineage import Scratch


def edges_of(pairs: DataFrame, self_loops: bool = True) -> DataFrame:
    """Undirected simple edges u <= v."""
    e = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u is not null and v is not null").distinct()
    return e if self_loops else e.where("u <> v")


def weighted_edges(pairs: DataFrame, weight: str = "weight", eps: float = 1e-6) -> DataFrame:
    """No self-loops; weights clipped to [eps, 1 - eps]; of repeated edges the largest weight."""
    w = F.least(F.greatest(F.col(weight), F.lit(eps)), F.lit(1 - eps))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), w.alias("weight")).where("u <> v").groupBy("u", "v").agg(F.max("weight").alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways; a self-loop is one row."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(edges.where("u <> v").select(F.col("v").alias("src"), F.col("u").alias("dst")))


def degrees(adj: DataFrame) -> DataFrame:
    """node, d_nb (distinct neighbours), d (a self-loop counts twice)."""
    return adj.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d_nb"), (F.count("*") + F.sum((F.col("src") == F.col("dst")).cast("int"))).alias("d"))


def common_neighbours(pairs: DataFrame, adj: DataFrame, deg: DataFrame) -> DataFrame:
    """u, v, cn, adamic_adar, resource_allocation: one aggregation for all three. The neighbours of a pair's end of lower degree are looked up among the other's."""
    first = F.col("d_nb_u") <= F.col("d_nb_v")
    ends = look_up(pairs.select("u", "v"), deg, {"d_nb": 0}).select("u", "v", F.when(first, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("y"))
    a = adj.select(F.col("src").alias("x"), F.col("dst").alias("z"))
    b = adj.select(F.col("src").alias("y"), F.col("dst").alias("z"))
    shared = ends.join(a, "x").join(b, ["y", "z"]).join(deg.select(F.col("node").alias("z"), "d"), "z")
    aa = F.sum(F.when(F.col("d") > 1, 1 / F.ln(F.col("d"))).otherwise(0.0))
    return shared.groupBy("u", "v").agg(F.count("*").alias("cn"), aa.alias("adamic_adar"), F.sum(F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(0.0)).alias("resource_allocation"))


def link_features(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree features, common neighbours, Jaccard, Adamic-Adar, resource allocation, preferential attachment."""
    adj = adjacency(edges)
    deg = degrees(adj)
    wide = look_up(pairs, deg, {"d": 0, "d_nb": 0}).join(common_neighbours(pairs, adj, deg), ["u", "v"], "left")
    du, dv, cn = F.col("d_u"), F.col("d_v"), F.coalesce("cn", F.lit(0))
    return wide.select(
        "u", "v", du.alias("deg_u"), dv.alias("deg_v"), F.least(du, dv).alias("deg_min"), F.greatest(du, dv).alias("deg_max"), F.abs(du - dv).alias("deg_diff"),
        safe_divide(du, dv).alias("deg_ratio"), cn.alias("cn"), safe_divide(cn, F.col("d_nb_u") + F.col("d_nb_v") - cn).alias("jaccard"),
        F.coalesce("adamic_adar", F.lit(0.0)).alias("adamic_adar"), F.coalesce("resource_allocation", F.lit(0.0)).alias("resource_allocation"), (du * dv).alias("preferential_attachment"),
    )


def component_table(edges: DataFrame) -> DataFrame:
    """node, component for every node, alone ones too."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    found = connected_components(edges, "u", "v")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles: edges point to the end of larger (degree, id), so a hub's pairs are few."""
    e = edges.where("u <> v")
    deg = degrees(adjacency(e)).select("node", "d")
    a = e.join(deg.select(F.col("node").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("node").alias("v"), F.col("d").alias("dv")), "v")
    first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    o = a.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("y"))
    wedge = o.join(o.select("x", F.col("y").alias("z")), "x").where("y < z").select("x", F.col("y").alias("u"), F.col("z").alias("v"))
    closed = wedge.join(e, ["u", "v"])
    return closed.select(F.explode(F.array("x", "u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, triangles, clustering (self-loops left out; 0 below degree 2)."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    deg = degrees(adjacency(edges.where("u <> v"))).select("node", F.col("d").alias("k"))
    t, k = F.coalesce("triangles", F.lit(0)), F.coalesce("k", F.lit(0))
    return nodes.join(deg, "node", "left").join(triangles(edges), "node", "left").select("node", t.alias("triangles"), F.when(k >= 2, 2 * t / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def average_neighbour_degree(edges: DataFrame) -> DataFrame:
    adj = adjacency(edges)
    deg = degrees(adj)
    summed = adj.join(deg.select(F.col("node").alias("dst"), "d"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("d").alias("s"))
    return summed.join(deg, "node").select("node", (F.col("s") / F.col("d")).alias("and"))


def component_features(edges: DataFrame) -> DataFrame:
    """node, size, density (2m over n(n-1)/2, as the reported feature has it), mean_deg, max_deg, avg_clust of the node's component."""
    comp = component_table(edges)
    deg = degrees(adjacency(edges)).select("node", "d")
    nodes = comp.join(deg, "node").join(clustering(edges).select("node", "clustering"), "node")
    m = edges.join(comp.withColumnRenamed("node", "u"), "u").groupBy("component").agg(F.count("*").alias("m"))
    per = nodes.groupBy("component").agg(F.count("*").alias("n"), F.max("d").alias("max_deg"), F.avg("clustering").alias("avg_clust")).join(m, "component")
    n, pairs = F.col("n"), F.col("n") * (F.col("n") - 1) / 2
    stats = per.select("component", n.cast("double").alias("size"), F.when(n > 1, 2 * F.col("m") / F.greatest(pairs, F.lit(1.0))).otherwise(0.0).alias("density"), (2 * F.col("m") / n).alias("mean_deg"), F.col("max_deg").cast("double").alias("max_deg"), "avg_clust")
    return comp.join(stats, "component").drop("component")


def pair_features(pairs: DataFrame, metric: DataFrame, defaults: dict[str, float], ratio_eps: float | None = None) -> DataFrame:
    """Pair statistics of node metrics."""
    wide = look_up(pairs, metric, defaults)
    return wide.select("u", "v", *(c.alias(n) for name in defaults for n, c in pair_stats(F.col(f"{name}_u"), F.col(f"{name}_v"), name, ratio_eps).items()))


def triangle_features(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    wide = look_up(pairs, clustering(edges), {"triangles": 0, "clustering": 0.0})
    tu, tv = F.col("triangles_u"), F.col("triangles_v")
    tri = {"tri_min": F.least(tu, tv), "tri_max": F.greatest(tu, tv), "tri_diff": F.abs(tu - tv), "tri_mean": (tu + tv) / 2, "tri_log_u": F.log1p(tu), "tri_log_v": F.log1p(tv)}
    return wide.select("u", "v", *(c.alias(n) for n, c in (tri | pair_stats(F.col("clustering_u"), F.col("clustering_v"), "clu")).items()))


def bounded_shortest_path(pairs: DataFrame, edges: DataFrame, cutoff: int = 4) -> DataFrame:
    """u, v, distance: 0 for equal ends, -1 where an end is no node, cutoff + 1 beyond the cutoff. Pairs drop out of the frontier when met."""
    scratch = Scratch(edges.sparkSession, "paths")
    adj = scratch.keep(adjacency(edges))
    nodes = adj.select(F.col("src").alias("node")).distinct()
    known = pairs.select("u", "v").join(nodes.withColumnRenamed("node", "u"), "u", "left_semi").join(nodes.withColumnRenamed("node", "v"), "v", "left_semi")
    open_ = scratch.keep(known.where("u <> v").distinct())
    met = known.where("u = v").select("u", "v", F.lit(0).alias("distance")).distinct()
    reach = open_.select("u").distinct().select("u", F.col("u").alias("at"))
    for step in range(1, cutoff + 1):
        reach = scratch.keep(reach.join(adj.select(F.col("src").alias("at"), "dst"), "at").select("u", F.col("dst").alias("at")).distinct())
        hit = scratch.keep(open_.join(reach.withColumnRenamed("at", "v"), ["u", "v"], "left_semi"))
        met = met.union(hit.select("u", "v", F.lit(step).alias("distance")))
        open_ = scratch.keep(open_.join(hit, ["u", "v"], "left_anti"))
        reach = reach.join(open_.select("u").distinct(), "u", "left_semi")
    far = known.distinct().withColumn("known", F.lit(True))
    return pairs.select("u", "v").join(met, ["u", "v"], "left").join(far, ["u", "v"], "left").select("u", "v", F.coalesce("distance", F.when(F.col("u") == F.col("v"), 0).when(F.col("known"), cutoff + 1).otherwise(-1)).cast("long").alias("distance"))


def graph_features(pairs: DataFrame, edges: DataFrame, ranks: DataFrame, cutoff: int = 4) -> DataFrame:
    """The twenty columns of a pair: link features, sizes of the ends' components, bounded distance, and their ranks' smallest, largest, difference and ratio."""
    comp = component_table(edges)
    sizes = comp.join(comp.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "size")
    wide = look_up(look_up(link_features(pairs, edges), sizes, {"size": 0}), ranks, {"rank": 0.0}).join(bounded_shortest_path(pairs, edges, cutoff), ["u", "v"])
    su, sv, ru, rv = (F.col(c) for c in ("size_u", "size_v", "rank_u", "rank_v"))
    return wide.select(
        *(c for c in wide.columns if c not in ("size_u", "size_v", "rank_u", "rank_v")), *(c.alias(n) for n, c in {"comp_size_u": su, "comp_size_v": sv, "comp_size_min": F.least(su, sv), "comp_size_max": F.greatest(su, sv)}.items()),
        F.least(ru, rv).alias("pagerank_min"), F.greatest(ru, rv).alias("pagerank_max"), F.abs(ru - rv).alias("pagerank_diff"), safe_divide(ru, rv).alias("pagerank_ratio"),
    )


def two_hop(nodes: DataFrame, adj: DataFrame, deg_cap: int | None = None, sample_k: int = 80, size_cap: int | None = None) -> DataFrame:
    """(node, x): nodes two hops away, without the node and its neighbours.

    Caps are for who asks for them (the reference has 200, 80 and 5,000): a node over deg_cap uses its sample_k smallest neighbours; they are followed in order of id
    until the set is over size_cap. Without both the result is whole.
    """
    if deg_cap is None and size_cap is None:
        used = adj.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("w"))
        reached = used.join(adj.select(F.col("src").alias("w"), F.col("dst").alias("x")), "w").where("node <> x").select("node", "x").distinct()
        return reached.join(adj.select(F.col("src").alias("node"), F.col("dst").alias("x")), ["node", "x"], "left_anti")
    deg_cap, size_cap = (2**62 if cap is None else cap for cap in (deg_cap, size_cap))
    d = adj.groupBy("src").agg(F.count("*").alias("d_nb"))
    ranked = adj.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(d, "src").withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    used = ranked.where((F.col("d_nb") <= deg_cap) | (F.col("rank") <= sample_k)).select(F.col("src").alias("node"), F.col("dst").alias("w"), "rank")
    first = used.join(adj.select(F.col("src").alias("w"), F.col("dst").alias("x")), "w").groupBy("node", "x").agg(F.min("rank").alias("rank"))
    new = first.groupBy("node", "rank").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("node").orderBy("rank"))
    last = new.withColumn("seen", running).where(F.col("seen") > size_cap).groupBy("node").agg(F.min("rank").alias("last"))
    kept = first.join(last, "node", "left").where(F.col("last").isNull() | (F.col("rank") <= F.col("last"))).where("node <> x").select("node", "x")
    return kept.join(adj.select(F.col("src").alias("node"), F.col("dst").alias("x")), ["node", "x"], "left_anti")


def two_hop_features(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Sizes and overlaps of the ends' whole two-hop sets. A node's neighbours are all in each other's sets, so a hub's degree counts squared."""
    adj = adjacency(edges)
    deg = degrees(adj).select(F.col("node").alias("x"), F.col("d_nb").alias("d"))
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    far = two_hop(ends, adj)
    sizes = far.groupBy("node").agg(F.count("*").alias("size"))
    both = pairs.select("u", "v").join(far.withColumnRenamed("node", "u"), "u").join(far.withColumnRenamed("node", "v"), ["v", "x"]).join(deg, "x", "left")
    big = F.col("d") > 1
    shared = both.groupBy("u", "v").agg(F.count("*").alias("inter"), F.sum(F.when(big, 1 / F.col("d")).otherwise(0.0)).alias("ra"), F.sum(F.when(big, 1 / F.ln("d")).otherwise(0.0)).alias("aa"))
    wide = look_up(pairs, sizes, {"size": 0}).join(shared, ["u", "v"], "left").na.fill({"inter": 0, "ra": 0.0, "aa": 0.0})
    union = F.col("size_u") + F.col("size_v") - F.col("inter")
    return wide.select("u", "v", "inter", F.when(union > 0, F.col("inter") / F.greatest(union, F.lit(1))).otherwise(0.0).alias("jacc"), "size_u", "size_v", "ra", "aa", F.log1p("ra").alias("log_ra"), F.log1p("aa").alias("log_aa"))
