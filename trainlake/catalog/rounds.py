"""Queries on crawl rounds, search results, shoes, lists, profiles and rendered texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, physio, render
from ..functions.numbers import pyround
from ..operators import articles as art
from ..operators import extract, frontier, ledger, retrieval, rounds, segments
from ..plans import metrics
from ..sources import tables
from .corpus import _ACTIONS, _ART, _CLEAN, _TALLY, AS_OF, MD, TOPICS, _hits, _share, markdown
from .registry import pr, query
from .training import ACT, DAILY, L, _acts

_HOST = "['docs.docin.com', 'www.cdc.gov', 'example.com', 'uni.edu', 'a.zhaopin.com'][{} % 5 + 1]"


def _hits_table(spark, sf_dir):
    """Web results: a page's number gives its host, three passes return overlapping addresses."""
    k = F.col("page_id")
    host = F.element_at(F.array(*[F.lit(x) for x in ("docs.docin.com", "www.cdc.gov", "example.com", "uni.edu", "a.zhaopin.com")]), (k % 5 + 1).cast("int"))
    p = tables.table(spark, sf_dir, "pages").select((k % 7).alias("query"), (k % 3).alias("pass"), k.alias("pos"), F.concat(F.lit("http://"), host, F.lit("/p"), (F.floor(k / 10)).cast("string")).alias("url"))
    return p


@query(
    f"""with r as (select page_id % 7 as query, page_id % 3 as pass, page_id as pos, {_HOST.format('page_id')} as host, 'http://' || {_HOST.format('page_id')} || '/p' || (page_id // 10)::varchar as url from pages),
f as (select query, url, host, min(struct_pack(p := pass, o := pos)) as hit from r group by 1, 2, 3), a as (select *, case host when 'www.cdc.gov' then 1.0 when 'uni.edu' then 0.95 when 'example.com' then 0.5 end::double as authority from f where not contains(host, 'docin.com') and not contains(host, 'zhaopin.com'))
select query, url, host, authority, row_number() over (partition by query order by authority desc, hit, url)::int as place from a where authority >= 0.4"""
)
def crw08_search_results(spark, sf_dir):
    return frontier.search_results(_hits_table(spark, sf_dir), min_authority=0.4)


_TRACE = f"""tr as (select id, source, length(content) as chars, {pr(_share('content'), 3)} as link_ratio, title || chr(10) || content as b from (select ar.*, cl.content from ar join cl on cl.doc_id = ar.id)),
tw as (select *, replace(lower(b), '-', ' ') as low from tr), tx as (select *, list_distinct(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+')) as ws from tw),
ty as (select *, {", ".join(f"({_hits('ws', 'low', t)})::int as {t}" for t in TOPICS)} from tx), tz as (select *, {pr('least(1, (english + german + romance) / 12.0::double)', 3)} as relevance from ty),
gt as (select id, source, chars, link_ratio, relevance, case when id % 9 = 0 then 'failed' when chars < 300 then 'too_short' when link_ratio >= 0.8 then 'index_page' when relevance < 0.25 then 'irrelevant' else 'pass' end as reason from tz)"""


def _trace(spark, sf_dir):
    pages = tables.articles(spark, sf_dir).withColumn("ok", F.col("id") % 9 != 0).withColumn("url", F.col("id").cast("string"))
    return rounds.gate_trace(pages, TOPICS)


@query(f"with {_ART}, {_TRACE} select id::varchar as url, source, chars::int as chars, link_ratio, relevance, reason from gt")
def kb22_gate_trace(spark, sf_dir):
    return _trace(spark, sf_dir).drop("category")


@query(
    f"""with {_ART}, {_TRACE}, c as (select source, reason, count(*) as n from gt group by 1, 2)
select source, sum(n)::bigint as pages, coalesce(sum(n) filter (reason = 'failed'), 0)::bigint as failed, coalesce(sum(n) filter (reason = 'pass'), 0)::bigint as passed, {pr("coalesce(sum(n) filter (reason = 'pass'), 0)::double / sum(n)", 3)} as pass_share, (min(struct_pack(o := -n, r := reason))).r as usual from c group by 1"""
)
def kb22_source_health(spark, sf_dir):
    return rounds.source_health(_trace(spark, sf_dir))


_ROUND = f"""rg as (select sc.*, id % 9 <> 0 as ok from sc join (select id as i, content_md from ar) on i = id where length(content_md) >= 300 and id % 9 <> 0),
ra as (select *, case when length(content) < 300 then 'too_short' when link_ratio >= 0.8 then 'index_page' when relevance_score < 0.25 then 'irrelevant' else 'inserted' end as action from rg)"""


@query(
    f"""with {_ART}, {_ROUND} select 1::bigint as run_id, 'manual' as trigger, 'done' as status, (select count(*) from ar)::bigint as discovered, (select count(*) from ra)::bigint as fetched, (select count(*) from ra where action = 'inserted')::bigint as inserted, 0::bigint as updated,
(select count(*) from ra where action <> 'inserted')::bigint as skipped, (select count(*) from ar where length(content_md) < 300 or id % 9 = 0)::bigint as failed, '' as error
union all select 0, 'weekly', 'running', 0, 0, 0, 0, 0, 0, null"""
)
def led06_crawl_round(spark, sf_dir):
    """The table of runs after a round over all documents into an empty store; an older run stays as it was."""
    pages = tables.articles(spark, sf_dir).drop("score").withColumn("ok", F.col("id") % 9 != 0).withColumn("url_hash", F.col("id").cast("string"))
    stored = pages.limit(0).select("url_hash", F.col("content_md").alias("content"), "title", "id")
    empty = spark.createDataFrame([], rounds.RUN)
    runs = rounds.open_run(empty, "weekly", "2024-01-01 00:00:00").withColumn("run_id", F.lit(0).cast("long"))
    out = rounds.crawl_round(pages.select("source", "id"), pages, stored, runs, "manual", AS_OF, "2024-06-30 10:00:00", TOPICS)
    return out["runs"].drop("started_at", "finished_at")


_STORED = f"""s2 as (select id, case when id % 2 = 0 then content else content || '!' end as content, title from sc where id % 4 in (0, 1)),
r2 as (select sc.*, case when length(sc.content) < 300 then 'too_short' when link_ratio >= 0.8 then 'index_page' when s2.id is null and relevance_score < 0.25 then 'irrelevant' when s2.content = sc.content then 'skipped' when s2.id is not null then 'updated' else 'inserted' end as action
  from sc join ar on ar.id = sc.id left join s2 on s2.id = sc.id where length(ar.content_md) >= 300 and sc.id % 9 <> 0),
t2 as (select f.source, coalesce(fetched, 0)::bigint as fetched, failed, {", ".join(f"coalesce({a}, 0)::bigint as {a}" for a in _ACTIONS)} from (select source, count(*) filter (length(content_md) < 300 or id % 9 = 0) as failed from ar group by 1) f
  left join (select source, count(*) as fetched, {_TALLY} from r2 group by 1) t on t.source is not distinct from f.source)"""


def _second_round(spark, sf_dir):
    """A round over all documents; half of them are stored, half of those with another text."""
    pages = tables.articles(spark, sf_dir).drop("score").withColumn("ok", F.col("id") % 9 != 0).withColumn("url_hash", F.col("id").cast("string"))
    content = art.text.clean_markdown(F.col("content_md"))
    stored = pages.where("id % 4 in (0, 1)").select("url_hash", F.when(F.col("id") % 2 == 0, content).otherwise(F.concat(content, F.lit("!"))).alias("content"), "title", "id")
    return rounds.crawl_round(pages.select("source", "id"), pages, stored, spark.createDataFrame([], rounds.RUN), "manual", AS_OF, "2024-06-30 10:00:00", TOPICS)


@query(f"with {_ART}, {_STORED}, n2 as (select id, content from r2 where action in ('inserted', 'updated')) select id, md5(content) as content_md5 from n2 union all select id, md5(content) from s2 where id not in (select id from n2)")
def led06_round_store(spark, sf_dir):
    """The store after a round that inserts, updates and skips."""
    return _second_round(spark, sf_dir)["store"].select("id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"with {_ART}, {_STORED} select * from t2")
def led06_round_tally(spark, sf_dir):
    return _second_round(spark, sf_dir)["tally"]


@query(
    f"""with {_ART}, {_STORED}, v as (select sum(fetched)::bigint as fetched, sum(failed)::bigint as failed, sum(inserted + updated)::bigint as stored, sum(irrelevant)::bigint as irrelevant, coalesce(list_sort(list(source) filter (fetched >= 3 and inserted + updated + skipped = 0)), []) as dead from t2),
p as (select *, list_filter([case when failed / (fetched + failed) > 0.5 then 'fail_rate' end, case when fetched > 0 and stored = 0 then 'nothing_stored' end, case when irrelevant > greatest(3, fetched / 2) then 'irrelevant' end, case when len(dead) > 0 then 'dead_sources' end], lambda x: x is not null) as problems from v)
select fetched, failed, stored, irrelevant, array_to_string(dead, ',') as dead_sources, array_to_string(problems, ',') as problems, case when list_contains(problems, 'fail_rate') or list_contains(problems, 'nothing_stored') then 'bad' when len(problems) > 0 then 'warn' else 'ok' end as verdict from p"""
)
def led06_round_verdict(spark, sf_dir):
    v = _second_round(spark, sf_dir)["verdict"]
    return v.select("fetched", "failed", "stored", "irrelevant", F.array_join("dead_sources", ",").alias("dead_sources"), F.array_join("problems", ",").alias("problems"), "verdict")


_SHAPED = "s as (select page_id, page_id % 4 as shape, length(url) % 5 + 1 as n from pages)"


@query(
    f"""with {_SHAPED} select page_id, case when shape < 2 then shape = 1 when shape = 3 then false end as is_list, case shape when 0 then 'a,d' when 1 then '' when 3 then 'q' end as top_keys,
case shape when 0 then '$.a.b.c=' || n::varchar || '(x,y);$.d=1(z)' when 1 then '$[0].r=' || n::varchar || '(x,y);$[1].r=1(z)' when 3 then '' end as found from s"""
)
def src23_shapes(spark, sf_dir):
    """Probes of JSON of four shapes: lists at two depths, a list of objects with lists, a broken file, an object without lists."""
    from ..sources import workouts

    many = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('{"x": 1, "y": 2}'), F.length("url") % 5 + 1), ","), F.lit("]"))
    shape = F.col("page_id") % 4
    body = (
        F.when(shape == 0, F.concat(F.lit('{"a": {"b": {"c": '), many, F.lit('}}, "d": [{"z": 1}]}')))
        .when(shape == 1, F.concat(F.lit('[{"r": '), many, F.lit('}, {"r": [{"z": 1}]}]')))
        .when(shape == 2, F.concat(F.lit('{"a": '), many))
        .otherwise('{"q": [1, 2]}')
    )
    found = workouts.probe_json(tables.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), body.alias("content")))
    shown = F.transform("candidates", lambda c: F.concat(c["path"], F.lit("="), c["count"].cast("string"), F.lit("("), F.array_join(c["keys"], ","), F.lit(")")))
    return found.select(F.col("path").cast("long").alias("page_id"), "is_list", F.array_join("top_keys", ",").alias("top_keys"), F.array_join(shown, ";").alias("found"))


@query(f"with {_ART} select id, title, domain, published_at::varchar as published, score, coalesce(len(key_points), 0)::int as n_points from ar")
def prj05_brief(spark, sf_dir):
    return art.brief(tables.articles(spark, sf_dir))


@query(f"with {ACT}, f as (select * from act where sport_type = 'running' and start_time >= date '2001-06-01' and start_time < date '2001-07-01') select activity_id, (select count(*) from f) as total from f order by start_time desc, activity_id limit 20 offset 5")
def srt01_page_total(spark, sf_dir):
    from ..operators import activities

    return activities.list_page(_acts(spark, sf_dir), "running", 2001, 6, 5, 20).select("activity_id", "total")


@query("select s_suppkey as shoe_id, row_number() over (order by s_suppkey % 3 = 0, date '2001-01-01' + (s_suppkey * 7 % 400)::int desc, s_suppkey)::int as place from supplier")
def win15_shoe_list(spark, sf_dir):
    k = F.col("s_suppkey")
    shoes = tables.table(spark, sf_dir, "supplier").select(k.alias("shoe_id"), (k % 3 == 0).cast("int").alias("retired"), F.date_add(F.lit("2001-01-01").cast("date"), (k * 7 % 400).cast("int")).alias("created_at"))
    rows = ledger.shoe_list(shoes).select("shoe_id").withColumn("o", F.monotonically_increasing_id())
    place = F.count(F.lit(1)).over(ledger.window_of("o")).cast("int")
    return rows.select("shoe_id", place.alias("place"))


@query(
    """with s as (select s_suppkey as shoe_id, s_name as name, 'b' as brand, case when s_suppkey % 4 = 0 then 0 else s_acctbal end as initial_km, 0 as retired from supplier where s_suppkey % 10 <> 0),
p as (select s_suppkey as shoe_id, case s_suppkey % 5 when 0 then ' new ' when 1 then ' ' end as name, case when s_suppkey % 2 = 0 then 7 end as retired from supplier),
j as (select p.*, s.shoe_id is not null as known from p left join s using (shoe_id))
select s.shoe_id, case when trim(j.name) <> '' then trim(j.name) else s.name end as name, s.brand, s.initial_km::double as initial_km, case when (j.name is null or trim(j.name) <> '') and j.retired is not null then 1 else 0 end as retired, case when trim(j.name) = '' then 'blank_name' end as reason from s join j using (shoe_id)
union all select shoe_id, null, null, null, null, 'unknown' from j where not known"""
)
def snk09_shoes(spark, sf_dir):
    """Shoes created and patched, with the rejected patches."""
    k = F.col("s_suppkey")
    t = tables.table(spark, sf_dir, "supplier")
    made = ledger.new_shoes(t.where(k % 10 != 0).select(k.alias("shoe_id"), F.concat(F.lit(" "), "s_name").alias("name"), F.lit("b ").alias("brand"), F.lit("2001-02-30").alias("purchased_date"), F.when(k % 4 != 0, F.col("s_acctbal")).alias("initial_km"), F.lit(None).cast("date").alias("created_at")))
    patches = t.select(k.alias("shoe_id"), F.when(k % 5 == 0, " new ").when(k % 5 == 1, " ").alias("name"), F.when(k % 2 == 0, 7).alias("retired"))
    shoes, rejects = ledger.patch_shoes(made, patches)
    return shoes.join(rejects, "shoe_id", "full").select("shoe_id", "name", "brand", "initial_km", "retired", "reason")


@query(f"select l_suppkey as shoe_id, {pr('sum(cast(l_quantity / 10 as decimal(18,2)))')} as km from lineitem group by 1")
def snk08_accumulate(spark, sf_dir):
    """Mileage of half of the lines stored, the rest added to it."""
    li = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("shoe_id"), (F.col("l_quantity") / 10).alias("km"), (F.col("l_orderkey") % 2 == 0).alias("old"))
    stored = li.where("old").groupBy("shoe_id").agg(pyround(F.sum(F.col("km").cast("decimal(18,2)"))).alias("km"))
    return ledger.accumulate(stored, li.where("not old"), ["shoe_id"], "km")


@query("select o_orderkey as id from orders order by o_orderdate desc, o_orderkey desc limit 20")
def flt09_latest(spark, sf_dir):
    return ledger.latest(tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "o_orderdate", 20).select("id")


@query("select distinct cast(ts as date)::varchar as date from events where cast(ts as date) >= date '2024-01-31' - 14")
def flt09_daily(spark, sf_dir):
    return ledger.since(tables.daily_metrics(spark, sf_dir), tables.AS_OF_EVENTS, 14).select(F.col("date").cast("string"))


@query("with p as (select c_custkey as activity_id, 'NATION_' || (c_nationkey + i)::varchar as city from customer, range(3) t(i)), v as (select c_custkey as activity_id, 'NATION_' || c_nationkey::varchar as city from customer where c_custkey % 3 <> 0) select activity_id, city, (activity_id, city) in (select (activity_id, city) from v) as visited from p")
def joi17_cities(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("activity_id"), "c_nationkey")
    city = lambda i: F.concat(F.lit("NATION_"), (F.col("c_nationkey") + i).cast("string"))
    places = c.select("activity_id", F.explode(F.array(*[city(i) for i in range(3)])).alias("city"))
    seen, new = ledger.cities_of(places, c.where("activity_id % 3 <> 0").select("activity_id", city(0).alias("city")))
    return seen.withColumn("visited", F.lit(True)).union(new.withColumn("visited", F.lit(False)))


@query("select c_custkey, case when c_custkey % 4 = 0 then 30 else 2024 - (1950 + c_custkey % 60) end::int as age from customer")
def fn24_age(spark, sf_dir):
    k = F.col("c_custkey")
    return tables.table(spark, sf_dir, "customer").select("c_custkey", ledger.age(F.when(k % 4 != 0, 1950 + k % 60).otherwise(0), "2024-06-30").alias("age"))


@query("select 190 as max_hr, 55 as resting_hr, 'male' as gender, max_by(70 + (n % 50) / 10.0::double, date) as weight_kg from (select cast(ts as date) as date, count(*) as n from events group by 1)")
def led01_profile_params(spark, sf_dir):
    from ..operators import ingest

    profile = spark.createDataFrame([(1, 0, 55, "")], "id long, max_hr int, resting_hr int, gender string")
    return ingest.profile_params(profile, tables.daily_metrics(spark, sf_dir))


@query("select c_custkey as user_id, case when c_custkey % 3 <> 0 and c_custkey % 4 <> 0 then c_mktsegment else 'health' end as goal, case when c_custkey % 3 <> 0 and c_custkey % 5 <> 0 then 'e' || c_nationkey else 'beginner' end as experience, case when c_custkey % 3 <> 0 then c_acctbal end as height_cm from customer")
def led02_profile_defaults(spark, sf_dir):
    """Customers as users: a third has no profile, some profiles lack fields, some users have a second one that doesn't count."""
    k = F.col("c_custkey")
    c = tables.table(spark, sf_dir, "customer").withColumn("user_id", k)
    own = c.where(k % 3 != 0).select("user_id", k.alias("id"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("goal"), F.when(k % 5 != 0, F.concat(F.lit("e"), F.col("c_nationkey").cast("string"))).alias("experience"), F.col("c_acctbal").alias("height_cm"))
    more = c.where(k % 7 == 1).where(k % 3 != 0).select("user_id", (k + 1_000_000_000).alias("id"), F.lit("later").alias("goal"), F.lit("later").alias("experience"), F.lit(1.0).alias("height_cm"))
    return ledger.profiles_with_defaults(c, own.unionByName(more), "user_id", {"goal": "health", "experience": "beginner"})


@query(f"with {_ART}, f as (select id // 3 as query_id, id % 3 + 1 as nth, id % 4 <> 0 as there, * from ar) select query_id, coalesce(string_agg(case when there then '[' || nth::varchar || '] ' || title || '  —— ' || domain || coalesce(' ' || year(published_at)::varchar, '') || case when len(key_points) > 0 then chr(10) || '    要点：' || array_to_string(key_points[1:2], '；') else '' end end, chr(10) order by nth), '（知识库暂无相关条目）') as evidence from f group by 1")
def fn46_evidence(spark, sf_dir):
    k = F.col("id")
    found = tables.articles(spark, sf_dir).select(F.floor(k / 3).alias("query_id"), (k % 3 + 1).alias("nth"), F.when(k % 4 != 0, F.col("title")).alias("title"), F.lit("").alias("organization"), "domain", "published_at", F.lit(None).cast("string").alias("summary"), "key_points")
    return render.evidence_block(found, 2)


@query("select c_custkey, case when a > 0 and b > 0 then '近 28 天 ' || a::varchar || '% 的运动没有心率数据，' || b::varchar || '% 的训练负荷是按配速估算的（原始文件不含心率，如华为 GPX/TCX 导出）' when a > 0 then '近 28 天 ' || a::varchar || '% 的运动没有心率数据' when b > 0 then b::varchar || '% 的训练负荷是按配速估算的（原始文件不含心率，如华为 GPX/TCX 导出）' end || '。基于负荷的判断（受伤风险、是否需要减量）请留有余地，别当成精确实测值。' as line from (select c_custkey, c_custkey % 4 * 25 as a, c_custkey % 5 * 20 as b from customer)")
def fn46_data_quality(spark, sf_dir):
    k = F.col("c_custkey")
    return tables.table(spark, sf_dir, "customer").select("c_custkey", render.data_quality(k % 4 / 4, k % 5 / 5).alias("line"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 9999 else 10.0 * (50 + c_custkey % 40) + 1000 end::bigint as kcal from customer")
def val09_targets(spark, sf_dir):
    """A made-up number in a plan is replaced by the computed one where targets are available."""
    k = F.col("c_custkey")
    made = F.struct((k % 3 != 0).alias("available"), *[(10 * (50 + k % 40) + 1000).cast("long").alias(n) for n in ("target_kcal", "protein_g", "fat_g", "carb_g", "deficit_kcal")])
    plan = F.create_map(F.lit("target_kcal"), F.lit(9999).cast("long"))
    return tables.table(spark, sf_dir, "customer").select("c_custkey", render.with_targets(plan, made)["target_kcal"].alias("kcal"))


@query("select c_custkey, md5('【用户档案】{\"name\":\"' || c_name || '\"}' || chr(10) || '【聚合指标】{\"n\":' || c_nationkey::varchar || '}' || chr(10) || '【最近运动】[1,2]' || case when c_custkey % 2 = 0 then chr(10) || '【数据质量】q' else '' end || chr(10) || chr(10) || '【循证依据·来自训练知识库】' || chr(10) || 'e') as context_md5 from customer")
def val10_context(spark, sf_dir):
    c = render.context(F.struct(F.col("c_name").alias("name")), F.struct(F.col("c_nationkey").alias("n")), F.array(F.lit(1), F.lit(2)), F.lit("e"), diet=F.create_map(F.lit("other"), F.lit("x")), quality=F.when(F.col("c_custkey") % 2 == 0, "q"))
    return tables.table(spark, sf_dir, "customer").select("c_custkey", F.md5(c.cast("binary")).alias("context_md5"))


@query("select doc_id, md5(case when length(text) <= 1000 then text else text[:600] || chr(10) || chr(10) || '...(中间略)...' || chr(10) || chr(10) || text[-400:] end) as trimmed_md5 from documents")
def kb16_trim(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.md5(segments.trim(F.col("text"), 1000).cast("binary")).alias("trimmed_md5"))


@query(
    f"""with {_ART} select id, id % 5 <> 0 as substantive, case when id % 5 = 0 then title when id % 3 = 0 then 'T' else title end as title, case when id % 5 = 0 then 'training' when id % 2 = 0 then 'german' else category end as category,
case when id % 5 = 0 then 'unknown' when id % 4 = 0 then 'rct' else evidence_level end as evidence_level, case when id % 5 = 0 then '' else 'a,b' end as points, (case when id % 5 <> 0 and id % 7 = 0 then date '2020-03-04' else published_at end)::varchar as published from sc"""
)
def kb18_finalize(spark, sf_dir):
    a = tables.articles(spark, sf_dir)
    k = F.col("id")
    fields = F.struct(F.when(k % 3 == 0, " T ").otherwise(" ").alias("title"), F.lit("o").alias("organization"), F.lit("").alias("author"), F.when(k % 7 == 0, "2020-03-04").alias("published_at"), F.when(k % 2 == 0, "german").otherwise("nonsense").alias("category"), F.array(F.lit("x")).alias("topics"), F.lit("s").alias("summary"), F.array(F.lit(" a "), F.lit(" "), F.lit("b")).alias("key_points"), F.when(k % 4 == 0, "rct").otherwise("great").alias("evidence_level"), (k % 5 != 0).alias("substantive"))
    out = extract.finalize(a.withColumn("content_md", art.text.clean_markdown(F.col("content_md"))).withColumn("fields", fields), TOPICS)
    return out.select("id", "substantive", "title", "category", "evidence_level", F.array_join("key_points", ",").alias("points"), F.col("published_at").cast("string").alias("published"))


@query("select doc_id as id, doc_id % 4 <> 0 as extracted from documents")
def joi16_with_fields(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    fields = d.where("id % 4 <> 0").select("id", F.struct(F.col("id").alias("x")).alias("fields"))
    return extract.with_fields(d, fields).select("id", F.col("fields").isNotNull().alias("extracted"))


@query("select page_id, false as is_list, 'meta,data' as top_keys, '$.data.items' as path, (1 + page_id % 3)::int as n from pages")
def src23_probe(spark, sf_dir):
    from ..sources import workouts

    k = F.col("page_id")
    item = F.format_string('{"t": %d, "hr": 1}', k)
    body = F.concat(F.lit('{"meta": {"n": [1, 2]}, "data": {"items": ['), F.array_join(F.array_repeat(item, (1 + k % 3).cast("int")), ","), F.lit("]}}"))
    found = workouts.probe_json(tables.table(spark, sf_dir, "pages").select(k.cast("string").alias("path"), body.alias("content")))
    return found.select(F.col("path").cast("long").alias("page_id"), "is_list", F.array_join("top_keys", ",").alias("top_keys"), F.get("candidates.path", F.lit(0)).alias("path"), F.get("candidates.count", F.lit(0)).alias("n"))
