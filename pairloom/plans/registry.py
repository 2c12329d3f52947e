"""The queries of the library and their SQL. Floats are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import session, vectors
from pairloom.functions.pairs import look_up
from pairloom.operators import clean, encoders, fuzzy, graph, iterative, stacking, tfidf, topics, vocabulary, walks
from pairloom.plans.fixtures import GRAPH_SQL, SPLIT_SQL, TEXT_GRAPH_SQL, TEXT_SQL, VECTOR_SQL, graph_pairs, label_rows, split_pairs, text_pairs, vector_pairs, weighted_graph_pairs
from pairloom.plans.lineage import Scratch
from pairloom.plans.training import feature_tables, predict_pairs, question_nodes
from pairloom.plans.training import training_table as joined_families

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places (never a negative zero), counts to long."""

    def one(name: str, kind: str):
        if kind in ("double", "float"):
            return (F.round(F.col(name).cast("double"), 6) + F.lit(0.0)).alias(name)
        return F.col(name).cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else F.col(name)

    return df.select(*(one(n, k) for n, k in df.dtypes))


def _query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def _written_pairs(spark, sf_dir) -> DataFrame:
    """The graph's pairs as a written table, for queries that read them more than once; making them joins all order lines with each other."""
    return Scratch(spark, "pairs").keep(graph_pairs(spark, sf_dir))


def _r(*expressions: str) -> str:
    """round(x, 6) + 0.0 as name, for 'x as name'."""
    out = []
    for e in expressions:
        x, name = e.rsplit(" as ", 1)
        out.append(f"round(cast({x} as double), 6) + 0.0 as {name}")
    return ", ".join(out)


def _pair_stats(m: str, prefix: str, ratio: str | None = None, u: str = "mu", v: str = "mv") -> str:
    a, b = f"{u}.{m}", f"{v}.{m}"
    out = [f"least({a}, {b}) as {prefix}_min", f"greatest({a}, {b}) as {prefix}_max", f"({a} + {b}) / 2.0 as {prefix}_mean", f"abs({a} - {b}) as {prefix}_diff"]
    if ratio:
        out.append(f"greatest({a}, {b}) / greatest(least({a}, {b}), {ratio}) as {prefix}_ratio")
    return _r(*out)


# cleaning, hashing and tokens


@_query(f"with {TEXT_SQL} select id, question1, question2, is_duplicate from (select id, question1, question2, cast(is_duplicate as bigint) as is_duplicate, row_number() over (partition by id order by question1, question2) as rn from text_pairs where question1 is not null and question2 is not null) where rn = 1")
def clean_pairs(spark, sf_dir):
    return clean.clean_pairs(text_pairs(spark, sf_dir))


_NORM = r"trim(regexp_replace(lower(coalesce({}, '')), '\s+', ' ', 'g'))"


@_query(f"with {TEXT_SQL} select id, md5({_NORM.format('question1')}) as h1, md5({_NORM.format('question2')}) as h2, cast(is_duplicate as bigint) as is_duplicate from text_pairs")
def pair_hash(spark, sf_dir):
    return clean.hash_pairs(text_pairs(spark, sf_dir), "is_duplicate")


_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_AB = f"select id, list_distinct({_TOKENS.format('question1')}) as a, list_distinct({_TOKENS.format('question2')}) as b from text_pairs"


@_query(f"with {TEXT_SQL}, t as ({_AB}), s as (select id, len(list_intersect(a, b)) as i, len(a) as na, len(b) as nb from t) select id, " + _r("1 - i / (na + nb - i + 1e-9) as jaccard_distance", "2 * i / (na + nb + 1e-9) as dice") + " from s")
def token_similarity(spark, sf_dir):
    return clean.token_similarity(text_pairs(spark, sf_dir))


@_query(f"with {TEXT_SQL}, t as ({_AB}) select id, coalesce(array_to_string(list_sort(list_intersect(a, b)), ' '), '') as common_words, coalesce(array_to_string(list_sort(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))), ' '), '') as diff_words from t")
def common_diff_words(spark, sf_dir):
    return clean.word_differences(text_pairs(spark, sf_dir))


@_query(
    f"with {TEXT_SQL}, t as ({_AB}), s as (select id, len(list_intersect(a, b)) as i, len(a) as na, len(b) as nb from t) select s.id, md5({_NORM.format('question1')}) as hash, " + _r("1 - i / (na + nb - i + 1e-9) as distance", "2 * i / (na + nb + 1e-9) as dice", "i / (na + 1e-9) as share")
    + " from s join text_pairs on text_pairs.id = s.id"
)
def sql_text_functions(spark, sf_dir):
    """The text functions as SQL knows them."""
    session.register(spark)
    shared = "cast(size(array_intersect(text_tokens(question1), text_tokens(question2))) as double)"
    whole = "cast(size(array_distinct(text_tokens(question1))) as double)"
    return spark.sql(f"select id, text_hash(question1) as hash, pair_jaccard_distance(question1, question2) as distance, pair_dice(question1, question2) as dice, safe_ratio({shared}, {whole}) as share from {{t}}", t=text_pairs(spark, sf_dir))


@_query()
def fuzzy_ratios(spark, sf_dir):
    return fuzzy.fuzzy_ratios(text_pairs(spark, sf_dir))


# vocabularies and encoded sentences, with the ASCII token rule that both engines share

_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+|[^a-z0-9 \t\r\n\f\x0b]')"
_PLACES = f"""places as (select 0 as block, id, unnest({_WORDS.format('question1')}) as token, generate_subscripts({_WORDS.format('question1')}, 1) as place from text_pairs
  union all select 1, id, unnest({_WORDS.format('question2')}), generate_subscripts({_WORDS.format('question2')}, 1) from text_pairs),
  firsts as (select token, min((block, id, place)) as spot from places group by token),
  vocab as (select token, row_number() over (order by spot) + 1 as idx from firsts)"""


@_query(f"with {TEXT_SQL}, {_PLACES} select token, cast(idx as bigint) as idx from vocab")
def vocab_index(spark, sf_dir):
    return vocabulary.vocabulary(text_pairs(spark, sf_dir), pattern=vocabulary.ASCII_TOKEN)


@_query(
    f"""with {TEXT_SQL}, {_PLACES}, p as (select p.id, p.place, v.idx from places p join vocab v on p.token = v.token where p.block = 0 and p.place <= 40),
    g as (select id, array_to_string(list(idx order by place), ' ') as ids, count(*) as n from p group by id)
    select t.id, coalesce(g.ids, '') || repeat(' 0', 40 - cast(coalesce(g.n, 0) as integer)) as ids, coalesce(g.n, 0) as len from text_pairs t left join g on t.id = g.id"""
)
def sent_encode(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir)
    vocab = vocabulary.vocabulary(pairs, pattern=vocabulary.ASCII_TOKEN)
    made = vocabulary.sentences(pairs, "question1", vocab, pattern=vocabulary.ASCII_TOKEN)
    text = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return made.select("id", F.when(F.col("len") > 0, text).otherwise(F.concat(F.lit(" "), text)).alias("ids"), "len")


_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789.,!?;:''\"-()[]{}@#$%^&*_+=/\\"


@_query(
    f"""with {TEXT_SQL}, w as (select id, unnest({_WORDS.format('question1')}) as token, generate_subscripts({_WORDS.format('question1')}, 1) as place from text_pairs),
    c as (select id, place, token, unnest(range(1, 21)) as k from w where place <= 40),
    n as (select id, place, k, case when k > length(token) then 0 when instr('{_CHARS}', substr(token, k, 1)) > 0 then instr('{_CHARS}', substr(token, k, 1)) + 1 else 1 end as code from c)
    select t.id, coalesce(sum((n.place * 31 + n.k) * n.code), 0)::bigint as checksum, coalesce(sum(n.code), 0)::bigint as total from text_pairs t left join n on t.id = n.id group by t.id"""
)
def char_encode(spark, sf_dir):
    """The codes of each sentence's characters, as sums that fix the place of every code."""
    made = vocabulary.characters(text_pairs(spark, sf_dir), "question1", pattern=vocabulary.ASCII_TOKEN)
    rows = made.select("id", F.posexplode("chars").alias("i", "row")).select("id", "i", F.posexplode("row").alias("k", "code"))
    return rows.groupBy("id").agg(F.sum(((F.col("i") + 1) * 31 + F.col("k") + 1) * F.col("code")).alias("checksum"), F.sum("code").alias("total"))


# edges and link prediction


@_query(f"with {GRAPH_SQL} select u, v from graph_pairs")
def edges_distinct(spark, sf_dir):
    return graph.edges_of(graph_pairs(spark, sf_dir))


@_query(f"with {GRAPH_SQL} select u, v from graph_pairs where u <> v")
def edges_no_loops(spark, sf_dir):
    return graph.edges_of(graph_pairs(spark, sf_dir), self_loops=False)


@_query("with w as (select least(l_partkey, l_suppkey) as u, greatest(l_partkey, l_suppkey) as v, least(greatest(cast(l_discount as double), 1e-6), 1 - 1e-6) as w from lineitem where l_partkey <> l_suppkey) select u, v, " + _r("max(w) as weight") + " from w group by u, v")
def edges_weighted_max(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), F.col("l_discount").cast("double").alias("weight"))
    return graph.weighted_edges(lines)


@_query(f"with {GRAPH_SQL} select node, cast(d_nb as bigint) as d_nb, cast(d as bigint) as d from nb")
def degree(spark, sf_dir):
    return graph.degrees(graph.adjacency(graph_pairs(spark, sf_dir)))


@_query(
    f"""with {GRAPH_SQL}, cn as (select p.u, p.v, count(*) as cn, sum(case when z.d > 1 then 1 / ln(z.d) else 0 end) as aa, sum(1.0 / z.d) as ra
      from graph_pairs p join adj a on a.src = p.u join adj b on b.src = p.v and b.dst = a.dst join nb z on z.node = a.dst group by p.u, p.v)
    select p.u, p.v, cast(x.d as bigint) as deg_u, cast(y.d as bigint) as deg_v, cast(least(x.d, y.d) as bigint) as deg_min, cast(greatest(x.d, y.d) as bigint) as deg_max, cast(abs(x.d - y.d) as bigint) as deg_diff,
      {_r('x.d / (y.d + 1e-9) as deg_ratio')}, cast(coalesce(cn, 0) as bigint) as cn, {_r('coalesce(cn, 0) / (x.d_nb + y.d_nb - coalesce(cn, 0) + 1e-9) as jaccard', 'coalesce(aa, 0) as adamic_adar', 'coalesce(ra, 0) as resource_allocation')}, cast(x.d * y.d as bigint) as preferential_attachment
    from graph_pairs p join nb x on x.node = p.u join nb y on y.node = p.v left join cn on cn.u = p.u and cn.v = p.v"""
)
def link_features(spark, sf_dir):
    pairs = _written_pairs(spark, sf_dir)
    return graph.link_features(pairs, graph.edges_of(pairs))


# components, cores, ranks

_COMPONENTS = """reach as (select src as node, src as other from adj union select reach.node, adj.dst from reach join adj on adj.src = reach.other),
  comp as (select node, min(other) as component from reach group by node)"""
_TRIANGLES = """e as (select u, v from graph_pairs where u <> v),
  t as (select a.u as x, a.v as y, b.v as z from e a join e b on a.v = b.u join e c on c.u = a.u and c.v = b.v),
  corner as (select x as node from t union all select y from t union all select z from t),
  k as (select node, d - 2 * (select count(*) from graph_pairs g where g.u = nb.node and g.v = nb.node) as k from nb),
  tri as (select nb.node, (select count(*) from corner c where c.node = nb.node) as t from nb),
  clu as (select tri.node, tri.t, case when k.k >= 2 then 2.0 * tri.t / (k.k * (k.k - 1)) else 0.0 end as c from tri join k on tri.node = k.node)"""


@_query(f"with recursive {GRAPH_SQL}, {_COMPONENTS} select node, component from comp")
def components(spark, sf_dir):
    return graph.component_table(graph_pairs(spark, sf_dir))


_COMP_STATS = ("size", "density", "mean_deg", "max_deg", "avg_clust")


@_query(
    f"""with recursive {GRAPH_SQL}, {_COMPONENTS}, {_TRIANGLES},
    m as (select component, count(*) as m from graph_pairs join comp on comp.node = graph_pairs.u group by component),
    per as (select comp.component, count(*) as n, max(nb.d) as max_deg, avg(clu.c) as avg_clust from comp join nb on nb.node = comp.node join clu on clu.node = comp.node group by comp.component),
    f as (select comp.node, cast(n as double) as size, case when n > 1 then 2.0 * m / (n * (n - 1) / 2.0) else 0.0 end as density, 2.0 * m / n as mean_deg, cast(max_deg as double) as max_deg, avg_clust
      from comp join per on per.component = comp.component join m on m.component = comp.component)
    select p.u, p.v, {', '.join(_pair_stats(x, x, '1e-12') for x in _COMP_STATS)} from graph_pairs p join f mu on mu.node = p.u join f mv on mv.node = p.v"""
)
def component_pair_features(spark, sf_dir):
    pairs = _written_pairs(spark, sf_dir)
    return graph.pair_features(pairs, graph.component_features(pairs), {x: 1.0 if x == "size" else 0.0 for x in _COMP_STATS}, 1e-12)


@_query(
    f"""with recursive {GRAPH_SQL}, n as (select count(*) as n from nb),
    pr as (select node, 1.0::double / n.n as r, 0 as it from nb, n union all
      select a.dst, 0.15 / n.n + 0.85 * sum(pr.r / nb.d_nb), pr.it + 1 from pr join nb on nb.node = pr.node join adj a on a.src = pr.node, n where pr.it < 20 group by a.dst, pr.it, n.n),
    m as (select node, r from pr where it = 20)
    select p.u, p.v, {_r('1000 * least(mu.r, mv.r) as pagerank_min', '1000 * greatest(mu.r, mv.r) as pagerank_max', '1000 * abs(mu.r - mv.r) as pagerank_diff', 'mu.r / (mv.r + 1e-9) as pagerank_ratio')}
    from graph_pairs p join m mu on mu.node = p.u join m mv on mv.node = p.v"""
)
def pagerank_pairs(spark, sf_dir):
    """Ranks count a thousandfold, so that six places say something."""
    pairs = _written_pairs(spark, sf_dir)
    wide = look_up(pairs, iterative.pagerank(pairs), {"rank": 0.0})
    a, b = F.col("rank_u"), F.col("rank_v")
    return wide.select("u", "v", (1000 * F.least(a, b)).alias("pagerank_min"), (1000 * F.greatest(a, b)).alias("pagerank_max"), (1000 * F.abs(a - b)).alias("pagerank_diff"), (a / (b + F.lit(1e-9))).alias("pagerank_ratio"))


@_query(
    f"""with lf as ({_SQL['link_features']}), pr as ({_SQL['pagerank_pairs']}), c as ({_SQL['components']}), n as (select component, count(*) as size from c group by component), s as (select c.node, n.size from c join n on n.component = c.component)
    select lf.*, x.size as comp_size_u, y.size as comp_size_v, least(x.size, y.size) as comp_size_min, greatest(x.size, y.size) as comp_size_max, cast(case when lf.u = lf.v then 0 else 1 end as bigint) as distance,
      pr.pagerank_min, pr.pagerank_max, pr.pagerank_diff, pr.pagerank_ratio from lf join pr on pr.u = lf.u and pr.v = lf.v join s x on x.node = lf.u join s y on y.node = lf.v"""
)
def graph_features(spark, sf_dir):
    """All columns of a pair in one table; ranks count a thousandfold, their ratio as it is."""
    pairs = _written_pairs(spark, sf_dir)
    made = graph.graph_features(pairs, graph.edges_of(pairs), iterative.pagerank(pairs))
    return made.withColumns({c: 1000 * F.col(c) for c in ("pagerank_min", "pagerank_max", "pagerank_diff")})


@_query(
    f"""with recursive {GRAPH_SQL}, {_COMPONENTS},
    big as (select component from comp group by component order by count(*) desc, component limit 1),
    inside as (select node from comp where component = (select component from big)),
    ladj as (select src, dst from adj where src in (select node from inside)),
    al as (select 0.9 / max(d) as alpha from nb where node in (select node from inside)),
    kz as (select node, 0.0::double as x, 0 as it from inside union all
      select a.src, al.alpha * sum(kz.x) + 1.0, kz.it + 1 from kz join ladj a on a.dst = kz.node, al where kz.it < 20 group by a.src, kz.it, al.alpha),
    l as (select sqrt(sum(x * x)) as l from kz where it = 20),
    m as (select nb.node, coalesce(kz.x / l.l, 0.0) as k from nb cross join l left join kz on kz.node = nb.node and kz.it = 20)
    select p.u, p.v, {_pair_stats('k', 'katz', '1e-9')} from graph_pairs p join m mu on mu.node = p.u join m mv on mv.node = p.v"""
)
def katz_pairs(spark, sf_dir):
    pairs = _written_pairs(spark, sf_dir)
    return graph.pair_features(pairs, iterative.katz(pairs), {"katz": 0.0}, 1e-9)


@_query(
    f"""with recursive {GRAPH_SQL}, sides as (select src, dst from adj where src <> dst),
    kc as (select src as node, count(*) as core, 0 as it from sides group by src union all
      select src, max(least(core, place)), max(it) + 1 from (select a.src, kc.core, kc.it, row_number() over (partition by a.src order by kc.core desc) as place from kc join sides a on a.dst = kc.node where kc.it < 60) group by src),
    m as (select nb.node, coalesce(kc.core, 0) as core from nb left join kc on kc.node = nb.node and kc.it = 60)
    select p.u, p.v, least(mu.core, mv.core) as core_min, greatest(mu.core, mv.core) as core_max, {_r('(mu.core + mv.core) / 2.0 as core_mean')}, abs(mu.core - mv.core) as core_diff
    from graph_pairs p join m mu on mu.node = p.u join m mv on mv.node = p.v"""
)
def kcore_pairs(spark, sf_dir):
    """The SQL takes sixty rounds, six times what the given graphs need to settle."""
    pairs = _written_pairs(spark, sf_dir)
    return graph.pair_features(pairs, iterative.core_numbers(pairs), {"core": 0})


@_query(f"with {GRAPH_SQL}, m as (select a.src as node, sum(z.d) * 1.0 / max(x.d) as a from adj a join nb z on z.node = a.dst join nb x on x.node = a.src group by a.src) select p.u, p.v, {_pair_stats('a', 'and')} from graph_pairs p join m mu on mu.node = p.u join m mv on mv.node = p.v")
def avg_neighbor_degree_pairs(spark, sf_dir):
    pairs = _written_pairs(spark, sf_dir)
    return graph.pair_features(pairs, graph.average_neighbour_degree(pairs), {"and": 0.0})


@_query(
    f"""with {GRAPH_SQL}, {_TRIANGLES} select p.u, p.v, least(mu.t, mv.t) as tri_min, greatest(mu.t, mv.t) as tri_max, abs(mu.t - mv.t) as tri_diff, {_r('(mu.t + mv.t) / 2.0 as tri_mean', 'ln(1 + mu.t) as tri_log_u', 'ln(1 + mv.t) as tri_log_v')}, {_pair_stats('c', 'clu')}
    from graph_pairs p join clu mu on mu.node = p.u join clu mv on mv.node = p.v"""
)
def triangle_clustering_pairs(spark, sf_dir):
    pairs = _written_pairs(spark, sf_dir)
    return graph.triangle_features(pairs, graph.edges_of(pairs))


@_query(
    f"""with {GRAPH_SQL}, far as (select distinct a.src as node, b.dst as x from adj a join adj b on b.src = a.dst where a.src <> b.dst and not exists (select 1 from adj c where c.src = a.src and c.dst = b.dst)),
    size as (select node, count(*) as n from far group by node),
    s as (select p.u, p.v, count(*) as i, sum(case when z.d_nb > 1 then 1.0 / z.d_nb else 0 end) as ra, sum(case when z.d_nb > 1 then 1 / ln(z.d_nb) else 0 end) as aa
      from graph_pairs p join far a on a.node = p.u join far b on b.node = p.v and b.x = a.x join nb z on z.node = a.x group by p.u, p.v),
    w as (select p.u, p.v, coalesce(s.i, 0) as i, coalesce(x.n, 0) as su, coalesce(y.n, 0) as sv, coalesce(ra, 0) as ra, coalesce(aa, 0) as aa from graph_pairs p left join s on s.u = p.u and s.v = p.v left join size x on x.node = p.u left join size y on y.node = p.v)
    select u, v, i as inter, {_r('case when su + sv - i > 0 then i / (su + sv - i) else 0.0 end as jacc')}, su as size_u, sv as size_v, {_r('ra as ra', 'aa as aa', 'ln(1 + ra) as log_ra', 'ln(1 + aa) as log_aa')} from w"""
)
def two_hop_pairs(spark, sf_dir):
    """Without caps, as its SQL; the caps of `graph.two_hop` are the reference's."""
    pairs = _written_pairs(spark, sf_dir)
    return graph.two_hop_features(pairs, graph.edges_of(pairs))


@_query(
    f"""with recursive {GRAPH_SQL}, asked as (select u, v from graph_pairs union select b.u, a.v from graph_pairs a join graph_pairs b on a.u = b.v union select u, -1 from graph_pairs),
    walk as (select distinct u, u as x, 0 as d from asked where u in (select node from nb) union select w.u, a.dst, w.d + 1 from walk w join adj a on a.src = w.x where w.d < 4),
    near as (select u, x as v, min(d) as d from walk group by u, x)
    select a.u, a.v, cast(case when a.u = a.v then 0 when a.v not in (select node from nb) then -1 else coalesce(n.d, 5) end as bigint) as distance from asked a left join near n on n.u = a.u and n.v = a.v"""
)
def bounded_shortest_path(spark, sf_dir):
    """Edges, pairs two steps apart, and pairs with an end that is no node."""
    e = graph_pairs(spark, sf_dir)
    two = e.select("u", F.col("v").alias("m")).join(e.select(F.col("u").alias("m"), "v"), "m").select("u", "v")
    return graph.bounded_shortest_path(e.union(two).union(e.select("u", F.lit(-1).cast("long"))).distinct(), e)


def _walks(spark, sf_dir) -> DataFrame:
    return walks.random_walks(walks.core_graph(graph.weighted_edges(weighted_graph_pairs(spark, sf_dir))))


@_query()
def random_walks(spark, sf_dir):
    made = _walks(spark, sf_dir)
    return made.select("walk", F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ").alias("nodes"))


@_query()
def n2v_pairs(spark, sf_dir):
    return walks.vector_features(graph_pairs(spark, sf_dir), walks.node_vectors(_walks(spark, sf_dir)))


# TF-IDF, topics and vectors


def _tfidf_sql(fold: bool) -> str:
    f, on = ("fold, ", "t.fold = v.fold and ") if fold else ("", "")
    rows = "r as (select *, ((row_number() over (partition by is_duplicate order by md5(cast(id as varchar) || '-7610'), id) - 1) % 5) as fold from text_pairs)" if fold else "r as (select *, 0 as fold from text_pairs)"
    if fold:
        stats = """own as (select term, fold, count(*) as df, sum(tf) as total from t group by term, fold), per as (select term, sum(df) as df, sum(total) as total from own group by term), fs as (select fold, count(*) as n from r group by fold), al as (select sum(n) as n from fs),
        st as (select fs.fold, per.term, per.df - coalesce(own.df, 0) as df, per.total - coalesce(own.total, 0) as total, 2 * (al.n - fs.n) as n from per cross join fs cross join al left join own on own.term = per.term and own.fold = fs.fold),"""
    else:
        stats = "st as (select 0 as fold, term, count(*) as df, sum(tf) as total, (select 2 * count(*) from r) as n from t group by term),"
    return f"""with {TEXT_SQL}, {rows},
    w as (select id, fold, 1 as side, unnest({_TOKENS.format('question1')}) as term from r union all select id, fold, 2, unnest({_TOKENS.format('question2')}) from r),
    t as (select id, fold, side, term, count(*) as tf from w group by all), {stats}
    v as (select fold, term, ln((1.0 + n) / (1 + df)) + 1 as idf from (select *, row_number() over (partition by fold order by total desc, term) as rn from st where df >= 3 and df <= 0.95 * n) where rn <= 150000),
    x as (select t.id, t.side, t.term, t.tf * v.idf as w from t join v on t.fold = v.fold and t.term = v.term),
    y as (select id, side, term, w / sqrt(sum(w * w) over (partition by id, side)) as w from x),
    b as (select id, term, coalesce(sum(w) filter (where side = 1), 0) as a, coalesce(sum(w) filter (where side = 2), 0) as b from y group by id, term),
    s as (select id, sum(a * b) as dot, sum(a * a) as q1, sum(b * b) as q2, sum(a) as s1, sum(b) as s2, count(*) filter (where a <> 0) as n1, count(*) filter (where b <> 0) as n2 from b group by id),
    z as (select r.id, coalesce(dot, 0) as dot, coalesce(q1, 0) as q1, coalesce(q2, 0) as q2, coalesce(s1, 0) as s1, coalesce(s2, 0) as s2, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2 from r left join s on r.id = s.id)
    select id, {_r('dot / (sqrt(q1) * sqrt(q2) + 1e-9) as cos', 'sqrt(greatest(q1 + q2 - 2 * dot, 0)) as l2d', 'dot as dot', 'dot / (s1 + 1e-9) as ov_ratio_1', 'dot / (s2 + 1e-9) as ov_ratio_2', 'least(sqrt(n1), sqrt(n2)) / (greatest(sqrt(n1), sqrt(n2)) + 1e-12) as nnz_ratio')} from z"""


@_query(_tfidf_sql(fold=False))
def tfidf_pair_features(spark, sf_dir):
    return tfidf.pair_features(text_pairs(spark, sf_dir))


@_query(_tfidf_sql(fold=True))
def tfidf_oof(spark, sf_dir):
    return tfidf.oof_features(text_pairs(spark, sf_dir))


_OF_FOLDS = _tfidf_sql(fold=True).split("x as (select t.id")[0].replace(TEXT_SQL, SPLIT_SQL).replace("as fold from text_pairs)", "as fold from train)")
_FEATURES = {"cos": "dot / (sqrt(q1) * sqrt(q2) + 1e-9)", "l2d": "sqrt(greatest(q1 + q2 - 2 * dot, 0))", "dot": "dot", "ov_ratio_1": "dot / (s1 + 1e-9)", "ov_ratio_2": "dot / (s2 + 1e-9)", "nnz_ratio": "least(sqrt(n1), sqrt(n2)) / (greatest(sqrt(n1), sqrt(n2)) + 1e-12)"}


@_query(
    f"""{_OF_FOLDS} tw as (select id, 1 as side, unnest({_TOKENS.format('question1')}) as term from test union all select id, 2, unnest({_TOKENS.format('question2')}) from test),
    x as (select tt.id, v.fold, tt.side, tt.term, tt.tf * v.idf as w from (select id, side, term, count(*) as tf from tw group by all) tt join v on v.term = tt.term),
    y as (select id, fold, side, term, w / sqrt(sum(w * w) over (partition by id, fold, side)) as w from x),
    b as (select id, fold, term, coalesce(sum(w) filter (where side = 1), 0) as a, coalesce(sum(w) filter (where side = 2), 0) as b from y group by id, fold, term),
    s as (select id, fold, sum(a * b) as dot, sum(a * a) as q1, sum(b * b) as q2, sum(a) as s1, sum(b) as s2, count(*) filter (where a <> 0) as n1, count(*) filter (where b <> 0) as n2 from b group by id, fold),
    z as (select test.id, coalesce(dot, 0) as dot, coalesce(q1, 0) as q1, coalesce(q2, 0) as q2, coalesce(s1, 0) as s1, coalesce(s2, 0) as s2, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2 from test cross join range(5) as f(fold) left join s on s.id = test.id and s.fold = f.fold)
    select id, {_r(*(f'avg({x}) as {n}' for n, x in _FEATURES.items()))} from z group by id"""
)
def tfidf_test(spark, sf_dir):
    """Test pairs' features, as means over the folds' vocabularies."""
    return tfidf.tested_features(*split_pairs(spark, sf_dir))


@_query(
    f"""with {TEXT_SQL}, ab as ({_AB}), d as (select id, unnest(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))) as term from ab),
    st as (select term, count(*) as df, (select count(*) from ab) as n from d group by term),
    v as (select term, ln((1.0 + n) / (1 + df)) + 1 as idf from (select *, row_number() over (order by df desc, term) as rn from st where df >= 3 and df <= 0.98 * n) where rn <= 80000),
    s as (select id, sqrt(sum(idf * idf)) as l2, sum(idf) as l1 from d join v on v.term = d.term group by id)
    select ab.id, {_r('coalesce(l2, 0) as diff_l2', 'coalesce(l1, 0) as diff_l1')} from ab left join s on s.id = ab.id"""
)
def tfidf_diff_norms(spark, sf_dir):
    return tfidf.difference_norms(text_pairs(spark, sf_dir))


@_query(
    f"""with {TEXT_SQL}, ab as ({_AB}), f as (select id, ((row_number() over (partition by is_duplicate order by md5(cast(id as varchar) || '-7610'), id) - 1) % 5) as fold from text_pairs),
    d as (select ab.id, f.fold, unnest(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))) as term from ab join f on f.id = ab.id),
    own as (select term, fold, count(*) as df from d group by term, fold), fs as (select fold, count(*) as n from f group by fold),
    st as (select fs.fold, t.term, t.df - coalesce(own.df, 0) as df, (select count(*) from f) - fs.n as n from (select term, sum(df) as df from own group by term) t cross join fs left join own on own.term = t.term and own.fold = fs.fold),
    v as (select fold, term, ln((1.0 + n) / (1 + df)) + 1 as idf from (select *, row_number() over (partition by fold order by df desc, term) as rn from st where df >= 3 and df <= 0.98 * n) where rn <= 80000),
    s as (select id, sqrt(sum(idf * idf)) as l2, sum(idf) as l1 from d join v on v.term = d.term and v.fold = d.fold group by id)
    select f.id, {_r('coalesce(l2, 0) as diff_l2', 'coalesce(l1, 0) as diff_l1')} from f left join s on s.id = f.id"""
)
def tfidf_diff_oof(spark, sf_dir):
    return tfidf.oof_difference_norms(text_pairs(spark, sf_dir))


def _wide(made: DataFrame) -> DataFrame:
    return made.select("id", *(F.element_at("svd", i + 1).alias(f"svd_{i}") for i in range(64)))


@_query()
def svd_common(spark, sf_dir):
    return _wide(topics.latent_features(text_pairs(spark, sf_dir)))


@_query()
def svd_oof(spark, sf_dir):
    return _wide(stacking.out_of_fold(topics.common_words(text_pairs(spark, sf_dir)), topics.latent_model, topics.latent_rows)[0])


@_query()
def lda_pairs(spark, sf_dir):
    return topics.topic_features(text_pairs(spark, sf_dir))


@_query()
def lda_oof(spark, sf_dir):
    return stacking.out_of_fold(text_pairs(spark, sf_dir), topics.topic_model, topics.topic_pairs)[0]


_DOT, _NA, _NB = "list_dot_product(a, b)", "(sqrt(list_dot_product(a, a)) + 1e-12)", "(sqrt(list_dot_product(b, b)) + 1e-12)"
_HAD, _DIFF, _ADD = ("list_transform(list_zip(a, b), lambda x: {})".format(x) for x in ("x[1] * x[2]", "abs(x[1] - x[2])", "x[1] + x[2]"))


@_query(
    f"with {VECTOR_SQL} select id, "
    + _r(
        f"{_DOT} / ({_NA} * {_NB}) as cos", f"{_DOT} as dot", "list_distance(a, b) as l2", f"{_NA} as norm_u", f"{_NB} as norm_v", f"least({_NA}, {_NB}) as norm_min", f"greatest({_NA}, {_NB}) as norm_max",
        f"greatest({_NA}, {_NB}) / greatest(least({_NA}, {_NB}), 1e-12) as norm_ratio", f"list_sum({_HAD}) / len(a) as had_mean", f"list_max({_HAD}) as had_max", f"list_min({_HAD}) as had_min",
        f"list_sum({_DIFF}) / len(a) as diff_mean", f"list_max({_DIFF}) as diff_max", f"list_sum({_ADD}) / len(a) as add_mean",
    )
    + ", is_duplicate::bigint as is_duplicate from vector_pairs"
)
def embedding_pair_features(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("id", *(c.alias(n) for n, c in vectors.embedding_pair(F.col("a"), F.col("b")).items()), "is_duplicate")


_SOFT = "list_transform({0}, lambda x: exp(x) / list_sum(list_transform({0}, lambda y: exp(y))))"
_CLIP = "least(greatest({}, 1e-12), 1.0)"
_P, _Q = (f"least(greatest({x}, 1e-12), 1.0)" for x in ("x[1]", "x[2]"))


@_query(
    f"""with {VECTOR_SQL}, s as (select id, {_SOFT.format('a')} as p, {_SOFT.format('b')} as q from vector_pairs),
    h as (select *, -list_sum(list_transform(p, lambda x: {_CLIP.format('x')} * ln({_CLIP.format('x')}))) as hp, -list_sum(list_transform(q, lambda x: {_CLIP.format('x')} * ln({_CLIP.format('x')}))) as hq from s)
    select id, {_r('hp as entropy_u', 'hq as entropy_v', f'list_sum(list_transform(list_zip(p, q), lambda x: ({_P} * ln({_P} / (({_P} + {_Q}) / 2)) + {_Q} * ln({_Q} / (({_P} + {_Q}) / 2))) / 2)) as jsd', 'list_sum(list_transform(list_zip(p, q), lambda x: abs(x[1] - x[2]))) as l1')},
    cast(list_position(p, list_max(p)) = list_position(q, list_max(q)) as bigint) as argmax_equal from h"""
)
def mixture_pair_features(spark, sf_dir):
    """Topic-pair scalars on mixtures that both engines make alike: softmax of the embeddings."""

    def soft(c: str):
        return F.transform(c, lambda x: F.exp(x) / vectors.total(F.transform(c, F.exp)))

    rows = vector_pairs(spark, sf_dir).select("id", soft("a").alias("p"), soft("b").alias("q"))
    p, q = F.col("p"), F.col("q")
    return rows.select("id", vectors.entropy(p).alias("entropy_u"), vectors.entropy(q).alias("entropy_v"), vectors.jensen_shannon(p, q).alias("jsd"), vectors.total(vectors.difference(p, q)).alias("l1"), (vectors.argmax(p) == vectors.argmax(q)).cast("long").alias("argmax_equal"))


@_query(
    f"""with {VECTOR_SQL}, s as (select id, a, b, {_SOFT.format('a')} as p, {_SOFT.format('b')} as q from vector_pairs)
    select id, {_r(f'{_DOT} as dot', f'{_DOT} / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-12) as cos', 'list_distance(a, b) as l2', f'list_sum({_DIFF}) as l1', f'-list_sum(list_transform(p, lambda x: {_CLIP.format("x")} * ln({_CLIP.format("x")}))) as entropy')},
    {_r(f'list_sum(list_transform(list_zip(p, q), lambda x: ({_P} * ln({_P} / (({_P} + {_Q}) / 2)) + {_Q} * ln({_Q} / (({_P} + {_Q}) / 2))) / 2)) as jsd', f'1 / (1 + exp(-{_DOT})) as prob')}, cast(list_position(a, list_max(a)) - 1 as bigint) as top from s"""
)
def sql_vector_functions(spark, sf_dir):
    """The vector functions as SQL knows them; mixtures are the embeddings' softmax."""
    session.register(spark)
    soft = "transform({0}, x -> exp(x) / aggregate(transform({0}, z -> exp(z)), 0D, (s, y) -> s + y))"
    columns = f"vec_dot(a, b) as dot, vec_cosine(a, b) as cos, vec_l2(a, b) as l2, vec_l1(a, b) as l1, vec_entropy({soft.format('a')}) as entropy, vec_jsd({soft.format('a')}, {soft.format('b')}) as jsd, sigmoid(vec_dot(a, b)) as prob, vec_argmax(a) as top"
    return spark.sql(f"select id, {columns} from {{t}}", t=vector_pairs(spark, sf_dir))


@_query(f"with {VECTOR_SQL} select id, {_r(f'list_sum(a) + list_sum(b) + list_sum({_DIFF}) + list_sum({_HAD}) + {_DOT} / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-12) as total', f'1 / (1 + exp(-{_DOT})) as prob')}, cast(4 * len(a) + 1 as bigint) as width from vector_pairs")
def neural_combination(spark, sf_dir):
    rows = vector_pairs(spark, sf_dir).select("id", vectors.combination(F.col("a"), F.col("b")).alias("x"), vectors.sigmoid(vectors.dot(F.col("a"), F.col("b"))).alias("prob"))
    return rows.select("id", vectors.total(F.col("x")).alias("total"), "prob", F.size("x").cast("long").alias("width"))


# pair encoders, with drawn token vectors that both engines make alike

_SIZE = 4
_DRAWN = f"""tok as (select id, side, token, pos from (select id, 0 as side, unnest({_WORDS.format('question1')}) as token, generate_subscripts({_WORDS.format('question1')}, 1) as pos from text_pairs
    union all select id, 1, unnest({_WORDS.format('question2')}), generate_subscripts({_WORDS.format('question2')}, 1) from text_pairs) where pos <= 40),
  x as (select id, side, pos, d, cast('0x' || substr(md5(token || '#' || d), 1, 8) as bigint) / 4294967296.0 - 0.5 as v from tok, range({_SIZE}) as r(d))"""


def _digest(df: DataFrame) -> DataFrame:
    """id, the sum of the coordinates, their sum weighted by place, and how many there are."""
    x = F.col("x")
    places = F.transform(x, lambda v, i: (i + 1) * v)
    return df.select("id", vectors.total(x).alias("total"), vectors.total(places).alias("weighted"), F.size(x).alias("width"))


def _coded(spark, sf_dir, encoder: str, size: int = _SIZE) -> DataFrame:
    return _digest(encoders.encode(text_pairs(spark, sf_dir), encoder, size, pattern=vocabulary.ASCII_TOKEN))


@_query(
    f"""with {TEXT_SQL}, {_DRAWN}, m as (select id, side, d, avg(v) as v from x group by all),
    f as (select t.id, r.d, coalesce(a.v, 0) as u, coalesce(b.v, 0) as v from text_pairs t cross join range({_SIZE}) as r(d) left join m a on a.id = t.id and a.side = 0 and a.d = r.d left join m b on b.id = t.id and b.side = 1 and b.d = r.d),
    s as (select id, sum(u + v + abs(u - v) + u * v) as t, sum((d + 1) * u + ({_SIZE} + d + 1) * v + ({2 * _SIZE} + d + 1) * abs(u - v) + ({3 * _SIZE} + d + 1) * u * v) as w, sum(u * v) / greatest(sqrt(sum(u * u) * sum(v * v)), 1e-8) as c from f group by id)
    select id, {_r('t + c as total', f'w + {4 * _SIZE + 1} * c as weighted')}, cast({4 * _SIZE + 1} as bigint) as width from s"""
)
def encoder_pooled(spark, sf_dir):
    return _coded(spark, sf_dir, "pooled")


def _context_sql(name: str, source: str, size: int) -> str:
    """Running averages forth, then back, of a table of coordinates."""
    one = "select a.id, a.side, a.pos, a.d{} as d, sum(b.v * pow(0.5, abs(a.pos - b.pos) + 1)) as v from {} a join {} b on b.id = a.id and b.side = a.side and b.d = a.d and b.pos {} a.pos group by all"
    return f"{name} as ({one.format('', source, source, '<=')} union all {one.format(f' + {size}', source, source, '>=')})"


def _attended_sql(name: str, source: str, other: str, scale: float = 1.0) -> str:
    """What each place attends to; other: the side that is attended to, as an expression over a.side."""
    return f"""{name}_e as (select a.id, a.side, a.pos, b.pos as at, exp(sum(a.v * b.v) * {scale}) as e from {source} a join {source} b on b.id = a.id and b.side = {other} and b.d = a.d group by all),
    {name} as (select e.id, e.side, e.pos, b.d, sum(e.e * b.v) / sum(e.e) as v from {name}_e e join {source} b on b.id = e.id and b.side = {other.replace('a.', 'e.')} and b.pos = e.at group by all)"""


_WIDE = 16 * _SIZE


@_query(
    f"""with {TEXT_SQL}, {_DRAWN}, {_context_sql('c', 'x', _SIZE)}, {_attended_sql('met', 'c', '1 - a.side')},
    p as (select c.id, c.side, c.pos, c.d, c.v, coalesce(met.v, 0) as m from c left join met on met.id = c.id and met.side = c.side and met.pos = c.pos and met.d = c.d),
    enhanced as (select id, side, pos, d, v from p union all select id, side, pos, d + {2 * _SIZE}, m from p union all select id, side, pos, d + {4 * _SIZE}, v - m from p union all select id, side, pos, d + {6 * _SIZE}, v * m from p),
    {_context_sql('f', 'enhanced', 8 * _SIZE)}, pool as (select id, side, d, avg(v) as mean, max(v) as top from f group by all),
    s as (select id, sum(mean + top) as t, sum(({_WIDE} * side + d + 1) * mean + ({_WIDE} * (2 + side) + d + 1) * top) as w from pool group by id)
    select t.id, {_r('coalesce(t, 0) as total', 'coalesce(w, 0) as weighted')}, cast({4 * _WIDE} as bigint) as width from text_pairs t left join s on s.id = t.id"""
)
def encoder_aligned(spark, sf_dir):
    return _coded(spark, sf_dir, "aligned")


_UNIT = "{0} as (select id, side, pos, d, v / greatest(sqrt(sum(v * v) over (partition by id, side, pos)), 1e-12) as v from {1})"
_CELL = "select a.id, {} as channel, a.pos as i, b.pos as j, sum(a.v * b.v) as v from {} a join {} b on b.id = a.id and b.d = a.d where a.side = 0 and b.side = 1 group by all"


@_query(
    f"""with {TEXT_SQL}, {_DRAWN}, {_attended_sql('own', 'x', 'a.side', _SIZE ** -0.5)}, enc as (select x.id, x.side, x.pos, x.d, x.v + own.v as v from x join own on own.id = x.id and own.side = x.side and own.pos = x.pos and own.d = x.d),
    {_attended_sql('met', 'enc', '1 - a.side', _SIZE ** -0.5)}, {_UNIT.format('u', 'enc')}, {_UNIT.format('um', 'met')},
    maps as ({_CELL.format(0, 'u', 'u')} union all {_CELL.format(1, 'um', 'u')} union all {_CELL.format(2, 'u', 'um')}
      union all select a.id, 3, a.pos, b.pos, case when a.token = b.token then 1.0 else 0.0 end from tok a join tok b on b.id = a.id where a.side = 0 and b.side = 1),
    fields as (select id, channel * 16 + (i - 1) // 10 * 4 + (j - 1) // 10 as c, case when count(*) = 100 then max(v) else greatest(max(v), 0) end as top, sum(v) / 100 as mean from maps group by all),
    s as (select id, sum(top + mean) as t, sum((c + 1) * top + (c + 65) * mean) as w from fields group by id)
    select t.id, {_r('coalesce(t, 0) as total', 'coalesce(w, 0) as weighted')}, cast(128 as bigint) as width from text_pairs t left join s on s.id = t.id"""
)
def encoder_channels(spark, sf_dir):
    return _coded(spark, sf_dir, "channels")


_FNV = """list_reduce(list_concat([2166136261], list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: cast('0x' || x as bigint))),
      lambda h, b: (xor(h, case when b >= 128 then b | 4294967040 else b end) * 16777619) & 4294967295) % 2000"""


@_query(
    f"""with {TEXT_SQL}, w as (select distinct token from (select unnest({_WORDS.format('question1')}) as token from text_pairs)),
    p as (select token, '<' || token || '>' as m, unnest(range(1, length(token) + 3)) as i from w), g as (select token, m, i, unnest(range(3, 7)) as n from p),
    b as (select token, {_FNV.format('substr(m, i, n)')} as bucket from g where i + n - 1 <= length(m)),
    v as (select token, d, avg(cast('0x' || substr(md5(bucket || '#' || d), 1, 8) as bigint) / 4294967296.0 - 0.5) as x from b, range({_SIZE}) as r(d) group by all)
    select token, {_r('sum(x) as total', 'sum((d + 1) * x) as weighted')} from v group by token"""
)
def subword_vectors(spark, sf_dir):
    """Vectors of all first texts' tokens from those of their n-grams' buckets, which are drawn."""
    tokens = text_pairs(spark, sf_dir).select(F.explode(vocabulary.words(F.col("question1"), vocabulary.ASCII_TOKEN)).alias("token"))
    part = lambda b, d: F.conv(F.substring(F.md5(F.concat_ws("#", b.cast("string"), d.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5
    grams = spark.range(2000).select(F.col("id").alias("bucket"), F.array(*(part(F.col("id"), F.lit(d)) for d in range(_SIZE))).alias("vec"))
    made = vocabulary.subword_vectors(tokens, grams, buckets=2000)
    return made.select("token", vectors.total(F.col("vec")).alias("total"), vectors.total(F.transform("vec", lambda v, i: (i + 1) * v)).alias("weighted"))


@_query()
def encoder_interaction(spark, sf_dir):
    return _coded(spark, sf_dir, "interaction", 16)


@_query()
def encoder_matching(spark, sf_dir):
    return _coded(spark, sf_dir, "matching", 16)


@_query()
def encoder_joint(spark, sf_dir):
    return _coded(spark, sf_dir, "joint", 16)


@_query()
def encoder_heads(spark, sf_dir):
    """Probabilities and representations by heads fitted out of fold over fitted token vectors."""
    return encoders.pair_features(text_pairs(spark, sf_dir), "pooled", size=16, width=16, epochs=4, steps=20)[0]


# folds, joins, stacking


@_query("select doc_id as id, cast(quality as bigint) as is_duplicate, cast((row_number() over (partition by quality order by md5(cast(doc_id as varchar) || '-7610'), doc_id) - 1) % 5 as bigint) as fold from labels")
def stratified_folds(spark, sf_dir):
    return tfidf.folds(label_rows(spark, sf_dir))


def _families(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pairs = text_pairs(spark, sf_dir)
    return stacking.join_features({"basic": clean.token_similarity(pairs), "tfidf": tfidf.pair_features(pairs)}), pairs.select("id", "is_duplicate")


@_query("with basic as (" + _SQL["token_similarity"] + "), tf as (" + _SQL["tfidf_pair_features"] + f"), lab as (with {TEXT_SQL} select id, is_duplicate from text_pairs) select coalesce(b.id, t.id) as id, b.jaccard_distance as basic_jaccard_distance, b.dice as basic_dice, t.cos as tfidf_cos, t.l2d as tfidf_l2d, t.dot as tfidf_dot, t.ov_ratio_1 as tfidf_ov_ratio_1, t.ov_ratio_2 as tfidf_ov_ratio_2, t.nnz_ratio as tfidf_nnz_ratio, cast(lab.is_duplicate as bigint) as is_duplicate from basic b full join tf t on b.id = t.id left join lab on lab.id = coalesce(b.id, t.id)")
def feature_join(spark, sf_dir):
    features, labels = _families(spark, sf_dir)
    return features.join(labels, "id", "left")


@_query("select cast(label as bigint) as fold, " + _r("avg(v) as mean", "sum(v * w) / greatest(sum(w), 1) as weighted") + " from (select label, cast(embedding[1] as double) as v, 1 + vec_id % 7 as w from embeddings) group by label")
def fold_average(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("fold"), F.element_at("embedding", 1).cast("double").alias("v"), (1 + F.col("vec_id") % 7).alias("w"))
    means = stacking.fold_mean(rows.select("fold", F.col("v").alias("mean")), key="fold")
    weighted = rows.groupBy("fold").agg(stacking.weighted_mean(F.col("v"), F.col("w")).alias("weighted"))
    return means.join(weighted, "fold").withColumn("fold", F.col("fold").cast("int"))


def _family_sql(name: str, sql: str, *keys: str) -> str:
    return f"{name} as (select {', '.join(keys)}, columns(lambda c: not list_contains({list(keys)}, c)) as '{name}_\\0' from ({sql}))"


def _of_texts(name: str) -> str:
    return _SQL[name].replace(GRAPH_SQL, TEXT_GRAPH_SQL)


_TEXT_FAMILIES = {"basic": "token_similarity", "double": "tfidf_oof", "diff": "tfidf_diff_oof"}
_GRAPH_FAMILIES = {"graph": "graph_features", "neighbor": "avg_neighbor_degree_pairs", "triangle": "triangle_clustering_pairs", "twohop": "two_hop_pairs"}


@_query(
    "with " + ", ".join([*(_family_sql(k, _SQL[q], "id") for k, q in _TEXT_FAMILIES.items()), *(_family_sql(k, _of_texts(q), "u", "v") for k, q in _GRAPH_FAMILIES.items())])
    + f", pair as (with {TEXT_GRAPH_SQL} select e.id, e.u, e.v, cast(t.is_duplicate as bigint) as is_duplicate from ends e join text_pairs t on t.id = e.id)"
    + " select * exclude (u, v) from pair " + " ".join([*(f"join {k} using (id)" for k in _TEXT_FAMILIES), *(f"join {k} using (u, v)" for k in _GRAPH_FAMILIES)])
)
def training_table(spark, sf_dir):
    """Families of text and graph features in one table; ranks count a thousandfold, as in graph_features, and a pair's ends are in order of their number."""
    pairs = text_pairs(spark, sf_dir)
    nodes = question_nodes(pairs).select("id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    made = joined_families(pairs, [*_TEXT_FAMILIES, *_GRAPH_FAMILIES], nodes=nodes)
    return made.withColumns({c: 1000 * F.col(c) for c in ("graph_pagerank_min", "graph_pagerank_max", "graph_pagerank_diff")})


@_query(
    f"with {SPLIT_SQL}, graph as (" + _of_texts("avg_neighbor_degree_pairs") + "), linked as (" + _of_texts("link_features") + "), basic as (" + _SQL["token_similarity"] + f"), e as (with {TEXT_GRAPH_SQL} select id, u, v from ends)"
    " select test.id, b.jaccard_distance as basic_jaccard_distance, b.dice as basic_dice, g.* exclude (u, v) rename (and_min as neighbor_and_min, and_max as neighbor_and_max, and_mean as neighbor_and_mean, and_diff as neighbor_and_diff), cast(l.cn as bigint) as cn"
    " from test join basic b on b.id = test.id join e on e.id = test.id join graph g on g.u = e.u and g.v = e.v join linked l on l.u = e.u and l.v = e.v"
)
def test_table(spark, sf_dir):
    """Test pairs in the graph of all pairs, with the common neighbours of their ends."""
    train, test = split_pairs(spark, sf_dir)
    made = feature_tables(train, test, ["basic", "neighbor", "links"])[1]
    return made.select("id", *(c for c in made.columns if c.startswith(("basic_", "neighbor_"))), F.col("links_cn").alias("cn"))


@_query()
def stacked_submission(spark, sf_dir):
    """From pairs to the submission: families of training and test pairs, patient trees out of fold, means for the test pairs."""
    train, test = split_pairs(spark, sf_dir)
    return predict_pairs(train, test, names=["basic", "double", "neighbor"], make=lambda: stacking.boosted_trees(rounds=24, depth=4, least=20, rate=0.1), patience=6)[1]


def _stacked(spark, sf_dir) -> DataFrame:
    features, labels = _families(spark, sf_dir)
    return stacking.stack(features, labels, make=lambda: stacking.boosted_trees(rounds=60, depth=5, least=20, rate=0.1))[0]


@_query()
def stack_gbt(spark, sf_dir):
    return _stacked(spark, sf_dir)


@_query()
def logloss_cv(spark, sf_dir):
    """The loss of each fold, and their mean as fold -1."""
    losses = _stacked(spark, sf_dir).groupBy("fold").agg(stacking.log_loss(F.col("prob"), F.col("is_duplicate")).alias("log_loss"), F.count("*").alias("n"))
    return losses.union(stacking.mean_loss(losses).select(F.lit(-1), "mean_loss", "n_folds"))


@_query("with e as (select cast(label % 2 as double) as y, cast(embedding[1] as double) as x from embeddings) select " + _r("avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) as loss") + ", count(*) as n from e")
def logit_loss(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("label") % 2).alias("y"), F.element_at("embedding", 1).cast("double").alias("x"))
    return e.agg(stacking.logit_loss(F.col("x"), F.col("y")).alias("loss"), F.count("*").alias("n"))


@_query("with e as (select label % 2 as y, 1 / (1 + exp(-cast(embedding[1] as double))) as p from embeddings) select " + _r("avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as log_loss") + ", count(*) as n from e")
def log_loss(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("label") % 2).alias("y"), vectors.sigmoid(F.element_at("embedding", 1).cast("double")).alias("p"))
    return e.agg(stacking.log_loss(F.col("p"), F.col("y")).alias("log_loss"), F.count("*").alias("n"))


@_query("with basic as (" + _SQL["token_similarity"] + f"), lab as (with {TEXT_SQL} select id, is_duplicate from text_pairs) select lab.id, case when lab.is_duplicate = 1 then b.dice else 0.0 end as is_duplicate from lab left join basic b on b.id = lab.id")
def submission(spark, sf_dir):
    """All ids, with the score of those that one was made for and 0 for the others."""
    pairs = text_pairs(spark, sf_dir)
    made = clean.token_similarity(pairs.where("is_duplicate = 1")).select("id", F.col("dice").alias("is_duplicate"))
    return stacking.submission(pairs, made)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
