"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import ann, ball_tree, chat, interpolation, jaccard_join, licenses, packing, pieces, pii, quality, token_counts, trie, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: What pseudonyms are keyed with where the session names no key: known to all, so for trials on made-up data only.
TRIAL_KEY = "trial"


def pseudonym_key(spark: SparkSession) -> str:
    """The session's spark.pairloom.pseudonymKey."""
    return spark.conf.get("spark.pairloom.pseudonymKey", TRIAL_KEY)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), pseudonym_key(spark), counted="n_replaced")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir), lines=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.sql("select * from values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    more = more.select(*(F.col(f.name).cast(f.dataType) for f in said.schema))
    return chat.read_back(chat.windows(said.union(more)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(_documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.quality_report(docs, quality.labelled_references(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score_documents(_documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return ball_tree.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.spliced(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_nearest, op3_packing, op4_pseudonyms, op5_licenses, op6_warc, op7_chat, op8_sentencepiece, op9_jaccard_join, op10_quality, op11_lm_scores, op12_hard_negatives, op13_prefix_trie)}


_PHRASES = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for label, phrase in licenses.PHRASES.items())
_TEMPLATES = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate(licenses.TEMPLATES))

#: Pages, conversations, their trie, links between documents, license labels and hard negatives have results that SQL can express; the other operators are tested against brute force.
#: Links in SQL: texts meet by the rarest shingles that two sets of such similarity must share one of, and are compared whole.
#: Licenses in SQL: of all passages of a template's width that open with a word of it, those that hold enough of its words.
#: The trie in SQL: each node's sequence is a list, and it adds to all its prefixes; crc32 is folded bit by bit over the digits.
#: Windows in SQL: what a window would repeat if it opened at a turn hangs on prefix sums alone; whether it opens there is a recursion over turns.
SQL = {
    "op5_licenses": rf"""
        with said as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
        phrases(label, phrase) as (values {_PHRASES}),
        templates(t, label, wording) as (values {_TEMPLATES}),
        sized as (select *, len(list_distinct(wording)) as n, cast(ceil(1.5 * len(wording)) as bigint) as width, cast(ceil(0.9 * len(list_distinct(wording)) - 1e-9) as bigint) as need from templates),
        own as (select t, unnest(list_distinct(wording)) as word from templates),
        w as (select r, unnest(words) as word, unnest(range(len(words))) as i from said),
        bases as (select s.r, p.label, unnest(list_filter(range(len(s.words)), lambda i: s.words[i + 1 : i + len(p.phrase)] = p.phrase)) as i from said s, phrases p where list_contains(s.words, p.phrase[-1])),
        b as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from bases group by r),
        hits as (select w.r, own.t, w.i, w.word from w join own using (word)),
        able as (select h.r, h.t from hits h join sized using (t) group by h.r, h.t having count(distinct h.word) >= any_value(need)),
        few as (select h.* from hits h join able using (r, t)),
        around as (select a.r, a.t, a.i, count(distinct z.word) as held, list(z.word order by z.i) as said from few a join sized s using (t) join few z on z.r = a.r and z.t = a.t and z.i >= a.i and z.i < a.i + s.width group by a.r, a.t, a.i),
        found as (select a.r, s.label, a.held / s.n as share from around a join sized s using (t) where a.held >= s.need and (len(s.wording) > {licenses.SHORT}
            or len(s.wording) = list_reduce(list_concat([0], list_transform(a.said, lambda x: 0)), lambda k, x, p: case when s.wording[k + 1] = a.said[p - 1] then k + 1 else k end))),
        every as (select r, label, share from found union all select r, label, 0 from bases),
        l as (select r, string_agg(distinct label, ',' order by label) as labels, max(share) as score from every group by r)
        select s.doc_id, cast(len(s.words) as bigint) as n_words, coalesce(b.n_base, 0) as n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') as base_labels, coalesce(l.labels, '') as labels, cast(coalesce(l.score, 0) as double) as score
        from said s left join b on b.r = s.r left join l on l.r = s.r""",
    "op9_jaccard_join": r"""
        with recursive said as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
        sets as (select doc_id, list_sort(list_distinct(case when len(words) = 0 then cast([] as varchar[]) when len(words) < 3 then [array_to_string(words, ' ')]
            else list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) end)) as shingles from said),
        classes as (select min(doc_id) as first, shingles, len(shingles) as n from sets where len(shingles) > 0 group by shingles),
        held as (select first, n, unnest(shingles) as shingle from classes),
        known as (select shingle, count(*) as df from held group by shingle),
        placed as (select h.first, h.n, h.shingle, row_number() over (partition by h.first order by k.df, h.shingle) as place from held h join known k using (shingle)),
        heads as (select first, n, shingle from placed where place <= n - (90 * n + 99) // 100 + 1),
        met as (select distinct a.first as a, b.first as b from heads a join heads b on a.shingle = b.shingle and a.first < b.first and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
        shared as (select m.a, m.b, x.n + y.n as total, len(list_intersect(x.shingles, y.shingles)) as hits from met m join classes x on x.first = m.a join classes y on y.first = m.b),
        links as (select a, b from shared where 100 * hits >= 90 * (total - hits)),
        ways as (select a, b from links union all select b, a from links),
        reach(a, b) as (select first, first from classes union select r.a, w.b from reach r join ways w on w.a = r.b),
        found as (select a as first, min(b) as component_id from reach group by a)
        select s.doc_id, cast(len(s.shingles) as bigint) as n_shingles, coalesce(f.component_id, s.doc_id) as component_id
        from sets s left join classes c on c.shingles = s.shingles left join found f on f.first = c.first""",
    "op7_chat": """
        with recursive said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized as (select *, cast(ceil(length(text) / 4.0) as bigint) + 4 as n, 10 + length(role) + length(text) + (select sum((length(y) - length(replace(y, c, ''))) // length(c)) from
              (select unnest([role, text]) as y), (select unnest(['\\', '<s>', '</s>', '<r>', '[INST]', '[/INST]']) as c)) as chars from said),
        t as (select *, row_number() over w as i, coalesce(sum(n) over (w rows between unbounded preceding and 1 preceding), 0) as start from sized window w as (partition by conv_id order by turn nulls first, role, text)),
        sys as (select conv_id, i, n, chars, start from (select *, row_number() over (partition by conv_id order by i) as k from t where role = 'system') where k = 1),
        fits as (select a.conv_id, a.i, s.n as sn, s.chars as sc, s.i is not null and not (a.start - s.start <= least(256, 1024 - a.n)) as away
            from t a left join sys s on s.conv_id is not distinct from a.conv_id and s.i < a.i),
        led as (select a.conv_id, a.i, a.n, a.chars, coalesce(any_value(f.sn) filter (where f.away), 0) + coalesce(sum(b.n), 0) as ln, coalesce(any_value(f.sc) filter (where f.away), 0) + coalesce(sum(b.chars), 0) as lc
            from t a join fits f on f.conv_id is not distinct from a.conv_id and f.i = a.i
            left join t b on b.conv_id is not distinct from a.conv_id and b.i < a.i and a.start - b.start <= least(256, 1024 - a.n - case when f.away then f.sn else 0 end) group by a.conv_id, a.i, a.n, a.chars),
        run as (select conv_id, i, ln + n as filled, lc + chars as made from led where i = 1
            union all select l.conv_id, l.i, case when r.filled + l.n > 1024 then l.ln + l.n else r.filled + l.n end, case when r.filled + l.n > 1024 then l.lc + l.chars else l.chars end
            from run r join led l on l.conv_id is not distinct from r.conv_id and l.i = r.i + 1),
        f as (select conv_id, sum(made) as formatted_chars from run group by conv_id),
        d as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
            coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '') as loss from t group by conv_id)
        select d.conv_id, d.n_turns, d.turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(f.formatted_chars as bigint) as formatted_chars
        from d join f on f.conv_id is not distinct from d.conv_id""",
    "op12_hard_negatives": """
        with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
            where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        p as (select anchor_id, vec_id as positive_id, score as positive_score from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same) where k <= 5),
        n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
            from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
        select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""",
    "op13_prefix_trie": """
        with own as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns from conversations where conv_id is not null group by conv_id),
        shared as (select *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: [cast(ascii(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end)) % 9 as h from own),
        rebuilt as (select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns from shared c left join own b on b.conv_id = c.conv_id - c.conv_id % 5),
        prefixes as (select conv_id, len(turns) as size, unnest(range(len(turns) + 1)) as depth, turns from rebuilt),
        nodes as (select depth, turns[1:depth] as node, min(conv_id) as conv_id, count(*) as n_convs, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where size = depth) as ends from prefixes group by all),
        families as (select node[1:depth - 1] as node, count(*) as n from nodes where depth > 0 group by all),
        full_nodes as (select n.*, coalesce(f.n, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * strlen(n.node[depth].text) end as saved from nodes n left join families f on f.node = n.node),
        above as (select node, depth, n_children, saved, unnest(range(depth + 1)) as k from full_nodes),
        subtrees as (select k, node[1:k] as node, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(saved) as saved_tokens from above group by all)
        select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
        from full_nodes n join subtrees s on s.node = n.node left join nodes p on n.depth > 0 and p.node = n.node[1:n.depth - 1]""",
    "op6_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
             f as (select h, min(page_id) as first, count(*) as n from p where strlen(h) >= 100 group by h)
        select p.page_id, cast(strlen(p.h) as bigint) as payload_bytes, sha256(p.h) as payload_digest,
               case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end as record_type,
               case when f.first <> p.page_id then f.first end as refers_to
        from p left join f on p.h = f.h""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
