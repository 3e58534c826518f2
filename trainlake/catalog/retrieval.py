"""Queries on keyword and vector retrieval. Queries of a search are every row whose id is divisible by 20; all rows are searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import pyround
from ..operators import extract
from ..operators import retrieval as ops
from ..sources import tables
from .corpus import _ART
from .registry import pr, query

BRIDGE = {"a": ["运动", "the", "erth-at"], "b": ["睡眠", "and"]}


def _articles(spark, sf_dir):
    a = tables.articles(spark, sf_dir)
    return a.select("id", "domain", "score", "key_points", "content_md", ops.searchable(F.col("title")).alias("title_text"), ops.searchable(F.col("title"), F.array_join("key_points", " ")).alias("body"))


_STOP = "['" + "','".join(fixed.STOP) + "']"
_TERMS = f"list_distinct(list_filter(regexp_extract_all(replace(lower({{}}), '-', ' '), '[a-z][a-z\\-]{{{{2,}}}}'), lambda w: not list_contains({_STOP}, w)))"


def _queries(spark, sf_dir):
    b = tables.table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    return b.select(F.col("item_id").alias("query_id"), ops.query_terms(F.col("text"), {}).alias("terms"))


_SEARCH = f"""
ar2 as (select id, domain, score, replace(lower(title), '-', ' ') as tt, replace(lower(title || ' ' || array_to_string(key_points, ' ')), '-', ' ') as body from ar),
qs as (select item_id as query_id, {_TERMS.format("text")} as terms from benchmark where item_id % 20 = 0),
ms as (select query_id, id, score, least(1.0, list_sum(list_transform(terms, lambda t: case when contains(tt, t) then 3 when contains(body, t) then 1 else 0 end)) / 8.0::double) as m from ar2, qs)
"""


@query(f"select item_id, array_to_string(list_sort({_TERMS.format('text')}), ' ') as terms from benchmark")
def fn50_query_terms(spark, sf_dir):
    b = tables.table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(F.array_sort(ops.query_terms(F.col("text"), {})), " ").alias("terms"))


_BRIDGED = f"""br0 as (select item_id, replace(lower('减脂期间运动怎么吃 ' || text), '-', ' ') as low from benchmark),
br1 as (select *, regexp_extract_all(low, '[a-z][a-z\\-]{{2,}}') as ws, regexp_extract_all(low, '[\\x{{4e00}}-\\x{{9fff}}]+') as runs from br0),
br2 as (select *, flatten(list_transform(runs, lambda r: flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, greatest(length(r) - n, -1) + 2), lambda i: substr(r, i, n)))))) as grams from br1)"""


@query(
    f"""with {_BRIDGED} select item_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(list_concat(ws, grams), lambda w: not list_contains({_STOP}, w)), case when contains(low, '运动') then ['the', 'erth at'] else [] end, case when contains(low, '睡眠') then ['and'] else [] end))), ' ') as terms from br2 where low is not null"""
)
def fn50_bridge(spark, sf_dir):
    b = tables.table(spark, sf_dir, "benchmark")
    raw = F.concat(F.lit("减脂期间运动怎么吃 "), F.col("text"))
    return b.select("item_id", F.array_join(F.array_sort(ops.query_terms(raw, BRIDGE)), " ").alias("terms"))


@query(f"with {_ART}, {_SEARCH} select query_id, id, {pr('m', 3)} as match from ms where m > 0")
def fn52_match(spark, sf_dir):
    return ops.matches(_queries(spark, sf_dir), _articles(spark, sf_dir), 1e-9).select("query_id", "id", pyround("match", 3).alias("match"))


@query(f"with {_ART}, {_SEARCH}, t as (select *, {pr('0.6::double * m + 0.4::double * coalesce(nullif(score, 0), 0.5::double)', 4)} as total from ms where m >= 0.2) select query_id, id, {pr('m', 3)} as match, total, place::int as place from (select *, row_number() over (partition by query_id order by total desc, id) as place from t) where place <= 6")
def ret01_keyword(spark, sf_dir):
    return ops.keyword_search(_queries(spark, sf_dir), _articles(spark, sf_dir))


_COS = """
qv as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0),
cs as (select query_id, vec_id as id, list_sum(list_transform(list_zip(q, embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(q, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))) as c from embeddings, qv)
"""


def _vectors(spark, sf_dir):
    v = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), v


@query(f"with {_COS} select query_id, id, {pr('c', 5)} as cosine, place::int as place from (select *, row_number() over (partition by query_id order by c desc, id) as place from cs) where place <= 30")
def joi14_cosine_topk(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return ops.nearest(q, v).withColumn("cosine", pyround("cosine", 5))


@query(
    f"""with {_COS}, m as (select *, row_number() over (partition by query_id order by c desc, id) as place, id // 64 = query_id // 64 as hit from cs),
e as (select *, row_number() over (partition by query_id, place > 30 and hit order by place) as n from m) select query_id, id, {pr('c', 5)} as cosine, (case when place <= 30 then place else 30 + n end)::int as place from e where place <= 30 or (hit and n <= 10)"""
)
def ret02_recall_pool(spark, sf_dir):
    """Keyword hits are stood in for by the neighbours in a block of 64 ids."""
    q, v = _vectors(spark, sf_dir)
    near = q.select("query_id", F.floor(F.col("query_id") / 64).alias("b")).join(v.select("id", F.floor(F.col("id") / 64).alias("b")), "b")
    return ops.recall_pool(q, v, near.select("query_id", "id", F.lit(0.5).alias("match"))).select("query_id", "id", pyround("cosine", 5).alias("cosine"), "place")


_PASSAGE = "((query_id * 13 + id * 7 + k * 5) % 100) / 10.0::double - 5"


@query(
    f"""with {_COS}, pool as (select query_id, id from (select *, row_number() over (partition by query_id order by c desc, id) as place from cs) where place <= 30),
b as (select query_id, id, max({_PASSAGE}) as r from pool, range(4) t(k) group by 1, 2), t as (select query_id, id, r, {pr('0.7::double / (1 + exp(-r)) + 0.3::double * coalesce(nullif((id % 10) / 10.0::double, 0), 0.5::double)', 4)} as total from b where r >= -2.5)
select query_id, id, {pr('r', 3)} as rank, total, nth::int as nth from (select *, row_number() over (partition by query_id order by total desc, id) as nth from t) where nth <= 6"""
)
def ret03_two_stage(spark, sf_dir):
    """The second score, a model's in production, is a fixed formula of query, article and passage here."""
    q, v = _vectors(spark, sf_dir)
    pool = ops.nearest(q, v).select("query_id", "id", ((F.col("id") % 10) / 10).alias("score"))
    return ops.rerank(pool, _passage_scores(pool)).select("query_id", "id", pyround("rank", 3).alias("rank"), "total", "nth")


@query(f"with {_ART} select id, len(p)::int as n_parts, md5(array_to_string(p, '|')) as parts_md5 from (select id, case when len(f) > 0 then f else [content_md] end as p from (select *, list_filter(list_transform(key_points[1:8], lambda x: trim(x)), lambda x: x <> '') as f from ar))")
def fn53_parts(spark, sf_dir):
    a = _articles(spark, sf_dir).select("id", ops.parts(F.col("key_points"), F.col("content_md")).alias("p"))
    return a.select("id", F.size("p").alias("n_parts"), F.md5(F.array_join("p", "|").cast("binary")).alias("parts_md5"))


@query("select (count(*) filter (vec_id % 3 <> 0) >= 0.5 * count(*)) as usable from embeddings")
def ret04_usable(spark, sf_dir):
    v = tables.table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))
    return ops.usable(v)


@query(f"select vec_id, len(embedding)::int as n, {pr('list_sum(list_transform(embedding, lambda x: x::double))', 6)} as total, {pr('list_sum(list_transform(embedding, lambda x, i: x::double * i))', 6)} as weighted, len(embedding) = 63 as other_packed from embeddings")
def fn54_pack(spark, sf_dir):
    """Every vector packed and unpacked again; of another dimension it gives nothing."""
    e = tables.table(spark, sf_dir, "embeddings").withColumn("p", ops.pack(F.col("embedding"), 64))
    e = e.withColumn("v", ops.unpack(F.col("p"), 64))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.size("v").alias("n"), pyround(total(F.col("v")), 6).alias("total"), pyround(total(F.transform("v", lambda x, i: x * (i + 1))), 6).alias("weighted"), ops.unpack(F.col("p"), 63).isNotNull().alias("other_packed"))


@query(
    f"""with {_COS}, best as (select query_id, max(case when id <> query_id then c end) as top from cs group by 1)
select count(*) filter (top >= 0.5) as hits, count(*) filter (top < 0.5) as misses, {pr('min(top)', 4)} as lowest, {pr('max(top)', 4)} as highest from best"""
)
def agg24_evaluation(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return ops.evaluate(q, v, 0.5)


_PROTOTYPES = "qv as (select vec_id as pid, embedding as q from embeddings where vec_id < 6), s as (select vec_id, max(list_sum(list_transform(list_zip(q, embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(q, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))))) as m from embeddings, qv group by 1)"


@query(
    f"with {_PROTOTYPES} select vec_id as id, "
    + pr("m", 5)
    + " as topic_score from s"
)
def agg22_prototypes(spark, sf_dir):
    """Best cosine of each vector to the prototypes of its set, the first six vectors."""
    _, v = _vectors(spark, sf_dir)
    scores = ops.prototype_scores(v, v.where("id < 6").select(F.col("id").alias("query_id"), "embedding"))
    return scores.select("id", pyround("topic_score", 5).alias("topic_score"))


@query(f"with {_PROTOTYPES} select vec_id as id from s where {pr('m', 5)} >= 0.3")
def kb21_veto(spark, sf_dir):
    """Vectors near enough to a prototype to stay once the veto is on."""
    _, v = _vectors(spark, sf_dir)
    scores = ops.prototype_scores(v, v.where("id < 6").select(F.col("id").alias("query_id"), "embedding"))
    return extract.veto(scores.withColumn("topic_score", pyround("topic_score", 5)), 0.3, enabled=True).select("id")


_BOTH = f"""{_SEARCH.rstrip()},
qe as (select query_id, embedding as q from qs join embeddings on vec_id = query_id), cand as (select ar2.*, embedding from ar2 join embeddings on vec_id = id),
cs as (select query_id, id, score, list_sum(list_transform(list_zip(q, embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(q, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))) as c from cand, qe),
rk as (select cs.*, coalesce(m, 0) as m, row_number() over (partition by cs.query_id order by c desc, cs.id) as place from cs left join ms on ms.query_id = cs.query_id and ms.id = cs.id),
pool as (select * from (select *, row_number() over (partition by query_id, place > 30 and m >= 0.3 order by place) as n from rk) where place <= 30 or (m >= 0.3 and n <= 10)),
b as (select query_id, id, score, max({_PASSAGE}) as r from pool, range(4) t(k) group by 1, 2, 3)"""


def _search_set(spark, sf_dir):
    """(queries with terms and vectors, vectors) of the benchmark items and of all rows."""
    v = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return _queries(spark, sf_dir).join(v.withColumnRenamed("id", "query_id"), "query_id"), v


def _passage_scores(pool):
    k = pool.select("query_id", "id", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    return k.select("query_id", "id", (((F.col("query_id") * 13 + F.col("id") * 7 + F.col("k") * 5) % 100) / 10 - 5).alias("rank"))


_SUMMARY = "case when id % 3 <> 0 then left(content_md, id % 90) end"
_TEXTS = f"""x as (select id, title, coalesce(trim({_SUMMARY}), '') as s, coalesce(array_to_string(key_points[1:6], '；'), '') as p6, coalesce(array_to_string(key_points[1:4], '；'), '') as p4, content_md from (select id, title, key_points, content_md from ar)),
y as (select *, concat_ws(chr(10), nullif(trim(title), ''), nullif(s, ''), nullif(p6, '')) as t from x)"""


@query(f"with {_ART}, {_TEXTS} select id, trim(left(case when length(t) < 60 then t || chr(10) || left(trim(content_md), 1200) else t end, 1600)) as doc_text, case when s <> '' then left(trim(s || chr(10) || p4, ' ' || chr(10) || chr(9) || chr(13)), 1600) else trim(trim(title) || chr(10) || left(trim(content_md), 1200), ' ' || chr(10) || chr(9) || chr(13)) end as rerank_text from y")
def fn51_texts(spark, sf_dir):
    """What vectors and rerankers read of all articles; a third has no summary."""
    a = tables.articles(spark, sf_dir)
    k, c = F.col("id"), F.col("content_md")
    summary = F.when(k % 3 != 0, F.substring(c, F.lit(1), (k % 90).cast("int")))
    made = lambda f: f(F.col("title"), summary, F.col("key_points"), c)
    return a.select("id", made(ops.doc_text).alias("doc_text"), made(ops.rerank_text).alias("rerank_text"))


@query(f"with {_ART}, {_BOTH}, t as (select query_id, id, {pr('0.7::double / (1 + exp(-r)) + 0.3::double * coalesce(nullif(score, 0), 0.5::double)', 4)} as total from b where r >= -2.5) select query_id, id, total, nth::int as nth, 'vectors' as via from (select *, row_number() over (partition by query_id order by total desc, id) as nth from t) where nth <= 6")
def ret04_retrieve(spark, sf_dir):
    """The whole path over articles that have vectors; the passage scores are a fixed formula."""
    q, v = _search_set(spark, sf_dir)
    return ops.retrieve(q, _articles(spark, sf_dir).join(v.select("id"), "id", "left_semi"), v, _passage_scores)


_NONE_KEPT = "case when query_id % 40 = 0 then -9 else r end"


@query(f"with {_ART}, {_BOTH}, t as (select query_id, id, {pr('0.7::double / (1 + exp(-r)) + 0.3::double * coalesce(nullif(score, 0), 0.5::double)', 4)} as total from (select query_id, id, score, {_NONE_KEPT} as r from b) where r >= -2.5) select query_id, id, total, nth::int as nth, 'vectors' as via from (select *, row_number() over (partition by query_id order by total desc, id) as nth from t) where nth <= 6")
def ret04_nothing_kept(spark, sf_dir):
    """Every second query has no passage over the floor: it has no result and is not searched by keywords; the others keep theirs."""
    q, v = _search_set(spark, sf_dir)
    low = lambda pool: _passage_scores(pool).withColumn("rank", F.when(F.col("query_id") % 40 == 0, F.lit(-9.0)).otherwise(F.col("rank")))
    return ops.retrieve(q, _articles(spark, sf_dir).join(v.select("id"), "id", "left_semi"), v, low)


@query(f"with {_ART}, {_SEARCH}, t as (select ms.*, {pr('0.6::double * m + 0.4::double * coalesce(nullif(score, 0), 0.5::double)', 4)} as total from ms semi join embeddings on vec_id = query_id where m >= 0.2) select query_id, id, total, nth::int as nth, 'keywords' as via from (select *, row_number() over (partition by query_id order by total desc, id) as nth from t) where nth <= 6")
def ret04_fallback(spark, sf_dir):
    """A third of the vectors is too few: keywords answer."""
    q, v = _search_set(spark, sf_dir)
    return ops.retrieve(q, _articles(spark, sf_dir), v.where("id % 3 = 0"), _passage_scores)
