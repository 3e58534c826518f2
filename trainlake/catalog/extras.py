"""Queries on extraction, titles, dates, plans and other small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import hooks
from ..functions import fixed, text
from ..functions.numbers import pyround, sigmoid
from ..operators import activities, extract, rounds
from ..operators import articles as art
from ..operators.segments import even_sample
from ..sources import tables
from .corpus import _ART, _CLEAN, MD, TOPICS, _hits, _prose, markdown
from .registry import pr, query
from .training import ACT, _acts

_DAYS = "d as (select o_orderkey as id, cast(o_orderdate as date) + (o_orderkey % 9000)::int as d, o_orderkey % 6 as k from orders)"


@query(
    f"""with {_DAYS}, r as (select id, case when k in (3, 4) then date_trunc('month', d)::date else d end as v, k from d)
select id, case when k <> 5 and v between date '1990-01-01' and date '2024-06-30' then v end::varchar as date from r"""
)
def fn23_parse_date(spark, sf_dir):
    """Order dates spread over 25 years, written in five forms (two of them of the month) and one that is no date."""
    k = F.col("o_orderkey")
    d = F.date_add(F.to_date("o_orderdate"), (k % 9000).cast("int"))
    forms = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy年M月d日"), F.date_format(d, "yyyy.M.d"), F.date_format(d, "yyyy/M"), F.date_format(d, "yyyy年M月"), F.concat(F.lit("v"), F.date_format(d, "yyyyMMdd"))]
    raw = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    return tables.table(spark, sf_dir, "orders").select(k.alias("id"), text.parse_date(raw, "2024-06-30").cast("string").alias("date"))


@query("select doc_id, case when length(h) > length(source) then h else source end as title from (select doc_id, source, substr(trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g')), 1, 300) as h from (select doc_id, source, substr('# ' || text, 3, 3998) as text from documents))")
def fn38_titles(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    h = text.first_heading(F.concat(F.lit("# "), F.col("text")))
    return d.select("doc_id", text.better_title(F.col("source"), h).alias("title"))


@query(
    """with l as (select doc_id, list_slice(list_transform(list_filter(list_zip(string_split(coalesce(text, ''), chr(10)), range(1, 100000)), lambda z: z[2] is not null and z[1] is not null and (doc_id + z[2]) % 3 = 0), lambda z: 'http://e.x/' || (length(z[1]) % 5)::varchar || '.png'), 1, 100000) as us from documents)
select doc_id, array_to_string(list_transform(list_filter(list_transform(us, lambda u, i: {'u': u, 'i': i}), lambda s: list_position(us, s.u) = s.i), lambda s: s.u)[1:3], ',') as urls from l"""
)
def fn45_images(spark, sf_dir):
    """Every third line of a document is an image named by the line's length; the others are links."""
    d = tables.table(spark, sf_dir, "documents")
    line = lambda x, i: F.when((F.col("doc_id") + i + 1) % 3 == 0, F.concat(F.lit("t ![a](http://e.x/"), (F.length(x) % 5).cast("string"), F.lit(".png) u"))).otherwise("[x](http://e.x/no.png)")
    md = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return d.select("doc_id", F.array_join(text.image_urls(md, 3), ",").alias("urls"))


@query("select doc_id, case when doc_id % 4 < 3 then to_json({'a': doc_id, 't': left(replace(coalesce(text, ''), chr(10), ' '), 40)})::varchar end as body from documents")
def fn47_tolerant_json(spark, sf_dir):
    """Objects of a document's id and beginning: bare, fenced, with words around, and cut off."""
    k = F.col("doc_id")
    obj = F.to_json(F.struct(k.alias("a"), F.left(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(40)).alias("t")))
    raw = F.when(k % 4 == 0, obj).when(k % 4 == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(k % 4 == 2, F.concat(F.lit("Sure: "), obj, F.lit(" done"))).otherwise(F.substring(obj, 1, 12))
    return tables.table(spark, sf_dir, "documents").select("doc_id", extract.tolerant_json(raw).alias("body"))


@query("select conv_id, turn, substr(trim(case when turn % 2 = 0 then '家里没牛奶 ' || text else text end) || case when turn % 2 = 0 then ' 食材替换 食物替代 同等营养 热量相近' else '' end, 1, 120) as q from conversations")
def ret05_query(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations")
    m = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("家里没牛奶 "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", extract.search_query(m).alias("q"))


_RULES = f"""rb0 as (select id, title, domain, {_prose('content_md')} as p from ar),
rb1 as (select *, replace(lower(title || chr(10) || p[:20000]), '-', ' ') as low, lower((title || chr(10) || p)[:2000]) as lb, trim(regexp_replace(p[:400], '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as head from rb0),
rb2 as (select *, list_distinct(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+')) as ws from rb1),
rb3 as (select *, {", ".join(f"({_hits('ws', 'low', t)})::int as {t}" for t in TOPICS)} from rb2),
rb4 as (select *, list_filter(list_sort([{{'n': -english, 'i': 0, 't': 'english'}}, {{'n': -german, 'i': 1, 't': 'german'}}, {{'n': -romance, 'i': 2, 't': 'romance'}}]), lambda x: x.n < 0) as o from rb3)"""


@query(
    f"""with {_ART}, {_RULES} select id, coalesce(o[1].t, 'training') as category, array_to_string(list_transform(o, lambda x: x.t), ',') as topics, md5(case when length(head) > 280 then head[:280] || '…' else head end) as summary_md5,
case {" ".join(f"when {' or '.join(f'contains(lb, {chr(39)}{w}{chr(39)})' for w in ws)} then '{level}'" for level, ws in fixed.EVIDENCE)} when regexp_matches(domain, '{"|".join(fixed.REVIEW_HOSTS)}') then 'review' else 'popular' end as evidence_level, case when length(p) < 120 then 'short' else 'rules' end as note from rb4"""
)
def kb18_rule_based(spark, sf_dir):
    out = extract.rule_based(tables.articles(spark, sf_dir).drop("score"), TOPICS)
    return out.select("id", "category", F.array_join("topics", ",").alias("topics"), F.md5(F.col("summary").cast("binary")).alias("summary_md5"), "evidence_level", "note")


@query(
    """with p as (select doc_id // 4 as id, doc_id % 4 as part, case when doc_id % 3 = 0 then '' else 's' || doc_id::varchar end as summary, ['p' || (doc_id % 5)::varchar, 'q' || (doc_id % 7)::varchar, 'p1'][1:(doc_id % 4)] as pts, ['popular', 'rct', 'review'][doc_id % 3 + 1] as ev from documents),
b as (select *, row_number() over (partition by id order by len(pts) desc, part) as b, case ev when 'popular' then 2 when 'rct' then 3 else 4 end as e from p),
u as (select id, case when b = 1 then -1 else part end as o, unnest(pts) as x, unnest(range(len(pts))) as i from b), d as (select id, x, min(struct_pack(o := o, i := i)) as pos from u group by 1, 2), k as (select id, array_to_string(list(x order by pos)[1:8], ',') as key_points from d group by 1),
s as (select id, coalesce(max(case when b = 1 and summary <> '' then summary end), min_by(summary, part) filter (summary <> ''), '') as summary, max_by(ev, struct_pack(e := e, p := -part)) as evidence_level from b group by 1)
select s.id, s.summary, coalesce(key_points, '') as key_points, evidence_level from s left join k on k.id = s.id"""
)
def kb18_merge(spark, sf_dir):
    k = F.col("doc_id")
    pts = F.array(F.concat(F.lit("p"), (k % 5).cast("string")), F.concat(F.lit("q"), (k % 7).cast("string")), F.lit("p1"))
    parts = tables.table(spark, sf_dir, "documents").select(F.floor(k / 4).alias("id"), (k % 4).alias("part"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("summary"), F.slice(pts, F.lit(1), (k % 4).cast("int")).alias("key_points"), F.element_at(F.array(F.lit("popular"), F.lit("rct"), F.lit("review")), (k % 3 + 1).cast("int")).alias("evidence_level"))
    return extract.merge_parts(parts).withColumn("key_points", F.array_join("key_points", ","))


@query(f"with {MD}, p as (select doc_id as id, length({_prose('content_md')}) as n from md) select id, n::int as prose_chars from p where n > 5000 order by n desc, id limit 20")
def snk15_reextract(spark, sf_dir):
    return extract.to_reextract(markdown(spark, sf_dir).withColumnRenamed("doc_id", "id"), 20).select("id", "prose_chars")


@query("select url, case when page_id % 3 = 0 then md5(html) when page_id % 3 = 1 then 'second' end as body, case when page_id % 3 = 0 then 'primary' when page_id % 3 = 1 then 'secondary' end as fetch_via from pages")
def src27_fallback(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages")
    first = p.where("page_id % 2 = 0 or page_id % 3 = 0").select("page_id", "url", (F.col("page_id") % 3 == 0).alias("ok"), F.md5(F.col("html").cast("binary")).alias("text"))
    second = p.select("page_id", "url", (F.col("page_id") % 3 == 1).alias("ok"), F.lit("second").alias("text"))
    return extract.fallback_pages(first, second, ["page_id", "url"]).select("url", F.col("text").alias("body"), "fetch_via")


@query("select s_suppkey as id from supplier where s_suppkey % 5 <> 0 and 'd' || (s_suppkey % 7)::varchar in ('d1', 'd2', 'd99')")
def src30_load_sources(spark, sf_dir):
    k = F.col("s_suppkey")
    sources = tables.table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("d"), (k % 7).cast("string")).alias("domain"), (k % 5 != 0).alias("enabled"))
    return rounds.enabled_sources(sources, spark.createDataFrame([("d1",), ("d2",), ("d99",)], "domain string")).select("id")


@query(f"with {_ART} select id, score < 0.3 or domain = 'unknown.xyz' as deleted from ar")
def snk10_purge(spark, sf_dir):
    kept, gone = rounds.purge(tables.articles(spark, sf_dir), 0.3, spark.createDataFrame([("unknown.xyz",)], "domain string"))
    return kept.select("id", F.lit(False).alias("deleted")).union(gone.select("id", F.lit(True)))


@query(f"with {_ART} select id from ar where score >= 0.2 and {pr('case id % 7 when 0 then 1.0 when 1 then 0.85 when 2 then 0.5 when 3 then 0.95 when 4 then 1.0 when 5 then 0.35 else 1.0 end', 3)} >= 0.85")
def flt05_prefilter(spark, sf_dir):
    return art.prefilter(tables.articles(spark, sf_dir), min_score=0.2, authority=0.85).select("id")


@query(f"with {ACT} select activity_id from act where start_time >= timestamp '2001-07-02' and start_time < timestamp '2001-07-18'")
def flt03_between(spark, sf_dir):
    return _acts(spark, sf_dir).where(activities.between_days("2001-08-01", 30, 14)).select("activity_id")


@query(f"with {ACT} select activity_id from act where start_time >= timestamp '2001-07-25'")
def flt02_rolling(spark, sf_dir):
    return activities.rolling(_acts(spark, sf_dir), "2001-08-01", 7).select("activity_id")


@query(
    """with m as (select distinct date_trunc('month', o_orderdate)::date as f from orders), d as (select f, unnest(range(f, f + interval 1 month, interval 1 day))::date as d from m)
select year(f)::int as year, month(f)::int as month, strftime(d, '%Y-%m-%d') as date, ((day(d) - 1 + isodow(f) - 1) // 7)::int as week, isodow(d)::int as dow from d"""
)
def fn14_month_grid(spark, sf_dir):
    """Grids of all months that have orders."""
    months = tables.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    return activities.month_grid(months).withColumn("date", F.col("date").cast("string"))


@query("select o_orderkey as id, case o_orderkey % 5 when 0 then 'p' || o_custkey when 1 then left('1998-01-01T00:00:00.000000000+08:00' || o_orderkey, 32) when 2 then 'b' || o_custkey when 3 then 'o' || o_custkey end as date from orders")
def fn38_pick_date(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    pair = lambda name, value: F.map_from_arrays(F.array(F.lit(name), F.lit("other")), F.array(value, F.lit("x")))
    long = F.concat(F.lit("1998-01-01T00:00:00.000000000+08:00"), F.col("o_orderkey").cast("string"))
    both = F.map_from_arrays(F.array(F.lit("date"), F.lit("published_time"), F.lit("article:published_time")), F.array(F.lit("later"), F.concat(F.lit("p"), c), F.lit("")))
    meta = F.when(k == 0, both).when(k == 1, pair("article:published_time", long)).when(k == 2, pair("pubdate", F.concat(F.lit("b"), c))).when(k == 3, pair("og:published_time", F.concat(F.lit("o"), c))).otherwise(pair("date", F.lit("")))
    return o.select(F.col("o_orderkey").alias("id"), text.pick_date(meta).alias("date"))


_PLAN = "concat_ws(' ', nullif(goal, ''), case when lower(goal) in ('fat_loss', 'weight_loss') then '减脂饮食 营养搭配 食材热量' end, nullif(flags, ''), nullif(request, ''), nullif(left(note, 200), ''))"


@query(f"with c as (select c_custkey as id, case c_custkey % 4 when 0 then 'Fat_Loss' when 1 then 'endurance' when 2 then 'weight_loss' end as goal, case when c_custkey % 3 = 0 then 'knee hip' else '' end as flags, case when c_custkey % 8 <> 7 then c_name else '' end as request, case when c_custkey % 8 = 7 then '' else repeat(c_mktsegment, 30) end as note from customer) select id, left(trim(case when {_PLAN} = '' then '跑步训练 计划 心率区间' else {_PLAN} end), 120) as query from c")
def ret05_plan_query(spark, sf_dir):
    k = F.col("c_custkey")
    c = tables.table(spark, sf_dir, "customer")
    goal = F.when(k % 4 == 0, "Fat_Loss").when(k % 4 == 1, "endurance").when(k % 4 == 2, "weight_loss")
    flags = F.when(k % 3 == 0, F.array(F.lit("knee"), F.lit("hip")))
    request, note = F.when(k % 8 != 7, F.col("c_name")), F.when(k % 8 != 7, F.repeat("c_mktsegment", F.lit(30)))
    return c.select(k.alias("id"), extract.plan_query(goal, flags, F.array().cast("array<string>"), request, note).alias("query"))


@query(f"with {MD}, {_CLEAN} select doc_id, length(content) >= 300 as long_enough from cl")
def crw06_minimum(spark, sf_dir):
    m = markdown(spark, sf_dir)
    return m.select("doc_id", (F.length(text.clean_markdown(F.col("content_md"))) >= 300).alias("long_enough"))


_TITLES = ["关于召开年度会议的通知", "如何科学跑步", "2024年度大会在京召开", "领导调研基层工作", "Sleep and recovery", "签约仪式举行", "膝盖疼怎么办", "研讨会成功举办"]


@query(f"select doc_id, regexp_matches(left(coalesce(text, ''), 10) || {_TITLES}[doc_id % 8 + 1], '{fixed.NEWS}') as news from documents")
def fn44_news(spark, sf_dir):
    """Titles of a document's beginning and one of eight headlines."""
    t = F.concat(F.left(F.coalesce("text", F.lit("")), F.lit(10)), F.element_at(F.array(*[F.lit(x) for x in _TITLES]), (F.col("doc_id") % 8 + 1).cast("int")))
    return tables.table(spark, sf_dir, "documents").select("doc_id", art.is_news(t).alias("news"))


@query("with l as (select conv_id, unnest(list(turn order by turn)) as turn from conversations group by 1), e as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from l) select conv_id, turn from e where n <= 3 or i in (0, n - 1) or i = round_even((n - 1) / 2.0, 0)::int")
def win09_even_sample(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return c.select("conv_id", F.explode(even_sample(F.col("t"), 3)).alias("turn"))


@query(f"select p_partkey, {pr('1 / (1 + exp(-(p_size - 25) / 10.0::double))', 6)} as p from part")
def fn12_sigmoid(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").select("p_partkey", pyround(sigmoid((F.col("p_size") - 25) / 10), 6).alias("p"))


def _stand_in(title, body, domain):
    """A model's stand-in: two points and the body's head for a summary; no answer for what is marked so."""
    if domain == "silent":
        raise TimeoutError("no answer")
    return {"summary": body[:30], "key_points": [body, title], "evidence_level": "rct" if title == "region" else "popular", "substantive": True}


@query(
    """select o_custkey as id, case when o_custkey % 10 <> 0 then min_by(left(c_name, 30), 1) when o_custkey % 20 <> 0 then left('r' || any_value(c_nationkey), 30) else '' end as summary,
  case when o_custkey % 10 <> 0 then any_value(c_name) || '|name|r' || any_value(c_nationkey) || '|region' when o_custkey % 20 <> 0 then 'r' || any_value(c_nationkey) || '|region' else '' end as points,
  case when o_custkey % 20 = 0 then 'unknown' else 'rct' end as evidence_level, case when o_custkey % 20 = 0 then 2 when o_custkey % 10 = 0 then 1 else 0 end::bigint as n_failed,
  case when o_custkey % 10 = 0 then 'TimeoutError: no answer' end as error
from (select c_custkey as o_custkey, c_name, c_nationkey from customer) group by o_custkey"""
)
def led05_extract_batch(spark, sf_dir):
    """Fields of two parts an article, by a model that gives no answer for a part of every tenth and for both of every twentieth."""
    c = tables.table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey"))
    silent = lambda every: F.when(F.col("id") % every == 0, "silent").otherwise("e.org")
    part = lambda k, title, body, domain: F.struct(F.lit(k).alias("part"), F.lit(title).alias("title"), body.alias("body"), domain.alias("domain"))
    two = F.array(part(0, "name", F.col("c_name"), silent(10)), part(1, "region", F.concat(F.lit("r"), F.col("c_nationkey").cast("string")), silent(20)))
    parts = c.select("id", F.explode(two).alias("p")).select("id", "p.*")
    docs = c.select("id", F.col("c_name").alias("title"), F.col("c_name").alias("content_md"), F.lit("e.org").alias("domain"), F.lit(None).cast("date").alias("published_at"))
    out = extract.extract_batch(docs, parts, _stand_in, hooks.Packing(threads=4))
    return out.select("id", "summary", F.array_join("key_points", "|").alias("points"), "evidence_level", "n_failed", "error")


def _by_length(texts):
    """Stands for an embedding model: a vector of 64 times the text's length."""
    return texts.map(lambda t: [float(len(t))] * 64)


@query(
    f"""with v as (select vec_id, case when vec_id % 3 <> 0 then case when vec_id % 5 = 0 then embedding[1:3] else embedding end end as e, vec_id % 3 <> 0 and vec_id % 5 <> 0 and coalesce(len(embedding), 0) = 64 as old from embeddings)
select vec_id as id, case when old then {pr('e[1]', 4)} else length(vec_id::varchar) end::double as first, 64 as n from v"""
)
def snk14_backfill(spark, sf_dir):
    """Vectors where they are missing (every third) or of another length (every fifth); the others stay."""
    k = F.col("vec_id")
    v = tables.table(spark, sf_dir, "embeddings").select(k.alias("id"), F.when(k % 3 != 0, F.when(k % 5 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))).alias("embedding"))
    out = hooks.backfill_vectors(v, F.col("id").cast("string"), _by_length, dim=64)
    return out.select("id", pyround(F.get("embedding", F.lit(0)), 4).alias("first"), F.size("embedding").alias("n"))
