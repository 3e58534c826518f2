"""Queries on pages and articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text, url
from ..functions.numbers import pyround
from ..operators import articles as ops
from ..operators import frontier, segments, turns
from ..sources import tables
from ..storage import keep
from .registry import pr, query

AS_OF = "2024-06-30"
#: The invented prose has none of the default topics' words, so queries use common words of its languages.
TOPICS = {"english": ["the", "is", "on"], "german": ["der", "die", "nicht"], "romance": ["que", "de la", "un"]}
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_LINK = fixed.LINK.replace("'", "''")
MD = """
md0 as (select doc_id, source, lang, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: case (doc_id + i - 1) % 7 when 0 then '## ' || x when 1 then '[' || x[:60] || '](http://e.x/' || (i - 1)::varchar || ')' when 2 then '[' || x[:60] || '](http://e.x/' || (i - 1)::varchar || ')' else x end) as ls from documents),
md as (select doc_id, source, lang, ls, array_to_string(ls, chr(10)) as content_md from md0)
"""


def markdown(spark, sf_dir):
    """Documents with every seventh line a heading and two of seven a link."""
    d = tables.table(spark, sf_dir, "documents")
    x = lambda s, i: F.concat(F.lit("["), F.substring(s, 1, 60), F.lit("](http://e.x/"), i.cast("string"), F.lit(")"))

    def line(s, i):
        k = (F.col("doc_id") + i) % 7
        return F.when(k == 0, F.concat(F.lit("## "), s)).when(k.isin(1, 2), x(s, i)).otherwise(s)

    return d.select("doc_id", "source", "lang", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n").alias("content_md"))


_PARTS = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"


def _part(u, i):
    return f"regexp_extract({u}, {_PARTS}, {i})"


def _normal(u):
    query_ = f"array_to_string(list_filter(string_split({_part(u, 4)}, '&'), lambda kv: contains(kv, '=') and not ends_with(kv, '=') and not starts_with(kv, '=') and not regexp_matches(lower(kv), '^(utm_|spm|from|share)')), '&')"
    return f"""(coalesce(nullif(lower({_part(u, 1)}), ''), 'https') || '://' || lower({_part(u, 2)}) || coalesce(nullif(regexp_replace({_part(u, 3)}, '/+$', ''), ''), '/') || case when {query_} = '' then '' else '?' || {query_} end)"""


def _host(u):
    return f"regexp_replace(regexp_replace(lower({_part(u, 2)}), ':.*$', ''), '^www\\.', '')"


@query(f"select page_id, {_normal('url')} as url, {_host('url')} as host, sha256(trim(url))[:32] as url_hash from pages")
def fn31_normalize_url(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages")
    return p.select("page_id", url.normalise(F.col("url")).alias("url"), url.host(F.col("url")).alias("host"), url.url_hash(F.col("url")).alias("url_hash"))


def _rank(p, folder):
    last = f"coalesce(list_filter(string_split({p}, '/'), lambda s: s <> '')[-1], '')"
    depth = f"len(list_filter(string_split({p}, '/'), lambda s: s <> ''))"
    signs = " + ".join(f"case when regexp_matches({p}, '{rx}', 'i') then {n} else 0 end" for rx, n in fixed.ARTICLE_SIGNS)
    return f"""({signs} + least(3, greatest(0, {depth} - 1)) + case when length({last}) >= 20 and length({last}) - length(replace({last}, '-', '')) >= 3 then 2 else 0 end + case when regexp_matches({last}, '\\d{{4,}}') then 2 else 0 end
  - case when regexp_matches(regexp_replace({last}, '\\.[^.]*$', ''), '{fixed.SECTION}', 'i') then 4 else 0 end + case when regexp_replace({folder}, '/+$', '') <> '' and starts_with({p}, regexp_replace({folder}, '/+$', '') || '/') then 6 else 0 end)"""


_URLS = f"u as (select page_id, coalesce(nullif({_part('url', 3)}, ''), '/') as p from pages)"


@query(
    f"""with {_URLS}, s as (select *, list_filter(string_split(p, '/'), lambda x: x <> '') as segs from u), t as (select *, coalesce(segs[-1], '') as last from s)
select page_id, {_rank('p', "'/en/'")} as rank, case when regexp_matches(p, '{fixed.SKIP_TYPE}', 'i') or regexp_matches(p, '(^|/)({fixed.SKIP_PART})(/|$)', 'i') or regexp_matches(p, '{fixed.SHOP}', 'i') or len(segs) = 0 then false
  when regexp_matches(regexp_replace(last, '\\.[^.]*$', ''), '{fixed.SECTION}', 'i') and len(segs) <= 2 then false
  when regexp_matches(p, '/\\d{{4}}[/-]\\d{{1,2}}|/\\d{{4,}}') or regexp_matches(last, '{fixed.PAGE_TYPE}', 'i') or regexp_matches(lower(p), '{"|".join(fixed.ARTICLE_PARTS)}') then true
  else length(last) >= 20 and length(last) - length(replace(last, '-', '')) >= 3 end as article_like from t"""
)
def fn33_article_like(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages")
    return p.select("page_id", url.article_rank(F.col("url"), F.lit("/en/")).alias("rank"), url.is_article_like(F.col("url")).alias("article_like"))


def _html_text():
    s = "coalesce(html, '')"
    for t in fixed.DROPPED_TAGS:
        s = f"regexp_replace({s}, '<{t}[^>]*>.*?</{t}>', ' ', 'gis')"
    s = f"regexp_replace({s}, '<!--.*?-->', ' ', 'gs')"
    s = f"regexp_replace({s}, '</({fixed.BLOCK_TAGS})\\s*>', chr(10), 'gi')"
    s = _unescape(f"regexp_replace({s}, '<[^>]+>', ' ', 'g')")
    return f"regexp_replace({s}, '[ \\t\\x{{a0}}]+', ' ', 'g')"


def _unescape(s):
    for name, char in fixed.ENTITIES.items():
        s = f"replace({s}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return s


@query(
    f"""with a as (select page_id, {_html_text()} as s from pages), b as (select page_id, array_to_string(list_transform(string_split(s, chr(10)), lambda x: trim(x, {_WS})), chr(10)) as s from a),
c as (select page_id, trim(regexp_replace(s, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_WS}) as s from b) select page_id, md5(s) as text_md5, length(s)::int as n_chars from c"""
)
def fn36_html_to_text(spark, sf_dir):
    t = tables.table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(text.html_to_text(F.col("html")))).alias("t"))
    return t.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").alias("n_chars"))


_HREF = "list_filter(regexp_extract_all(html, '<a[^>]+href=[\"'']([^\"''#]+)[\"'']', 1, 'i'), lambda h: not regexp_matches(h, '^(javascript|mailto|tel):', 'i'))"


@query(f"select page_id, trim({_unescape('regexp_replace(regexp_extract(html, ' + chr(39) + '<title[^>]*>(.*?)</title>' + chr(39) + ', 1, ' + chr(39) + 'is' + chr(39) + '), ' + chr(39) + '[ ]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, {_WS}) as title, len({_HREF})::int as n_links, array_to_string({_HREF}, ' ') as links from pages")
def fn37_title_links(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages")
    return p.select("page_id", text.html_title(F.col("html")).alias("title"), F.size(text.html_links(F.col("html"))).alias("n_links"), F.array_join(text.html_links(F.col("html")), " ").alias("links"))


_LINKS = f"""
hr as (select page_id, url, unnest(hs) as href, unnest(range(len(hs))) as pos from (select page_id, url, {_HREF} as hs from pages)),
lk0 as (select page_id, url, pos, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href else {_part('url', 1)} || '://' || {_part('url', 2)} || href end as abs from hr),
lk as (select page_id, url, pos, {_normal('abs')} as link from lk0)
"""


@query(
    f"""with {_LINKS}, own as (select page_id, url, link, min(pos) as pos from lk where {_host('link')} = {_host('url')} or ends_with({_host('link')}, '.' || {_host('url')}) group by all),
f as (select *, coalesce(nullif({_part('link', 3)}, ''), '/') as p, regexp_replace(coalesce(nullif({_part('url', 3)}, ''), '/'), '/(index|default|list|main)\\.(html?|php|jsp|aspx?)$', '', 'i') as bd from own),
r as (select page_id, link, pos, {_rank('p', 'bd')} as rank from f) select page_id, link, rank, place::int as place from (select *, row_number() over (partition by page_id order by rank desc, pos) as place from r) where place <= 4"""
)
def crw01_discover(spark, sf_dir):
    return frontier.discover(tables.table(spark, sf_dir, "pages"), 4, F.lit(True))


@query(f"with {_LINKS}, every as (select page_id, link, pos + 1 as place from lk union all select page_id, {_normal('url')}, 0 from pages) select link, page_id, place::int as place from every qualify row_number() over (partition by link order by page_id, place) = 1")
def set01_union_dedupe(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages")
    every = frontier.links(p).select("page_id", "link", (F.col("pos") + 1).alias("place")).unionByName(p.select("page_id", url.normalise(F.col("url")).alias("link"), F.lit(0).alias("place")))
    return frontier.first_owner(every, ["page_id", "place"])


@query(
    f"""with {_LINKS}, c as (select (page_id % 5)::varchar as source, page_id, link, pos as place from lk), o as (select * from c qualify row_number() over (partition by link order by source, page_id, place) = 1),
t as (select *, row_number() over (partition by source, page_id order by place) as turn from o) select source, page_id, link, turn::int as turn, nth::int as nth from (select *, row_number() over (partition by source order by turn, page_id) as nth from t) where nth <= 30"""
)
def win12_share_out(spark, sf_dir):
    c = frontier.links(tables.table(spark, sf_dir, "pages")).select((F.col("page_id") % 5).cast("string").alias("source"), "page_id", "link", F.col("pos").alias("place"))
    return frontier.share_out(c, 30).select("source", "page_id", "link", "turn", "nth")


def _share(s):
    return f"case when length({s}) > 0 then (length({s}) - length(regexp_replace({s}, '{_LINK}', '', 'g'))) / length({s})::double else 1 end"


def _prose(x):
    kept = f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: trim(x, {_WS})), lambda s: s <> '' and {_share('s')} <= 0.4)"
    return f"array_to_string(list_transform({kept}, lambda s: regexp_replace(s, '\\[\\[*([^\\]]{{0,120}})\\]\\([^)\\s]{{0,300}}\\)', '\\1', 'g')), chr(10))"



@query(f"with {MD} select doc_id, md5({_prose('content_md')}) as prose_md5, {pr(_share('content_md'), 3)} as link_ratio from md")
def fn41_prose(spark, sf_dir):
    m = markdown(spark, sf_dir)
    return m.select("doc_id", F.md5(text.prose_only(F.col("content_md")).cast("binary")).alias("prose_md5"), ops.link_ratio(F.col("content_md")).alias("link_ratio"))


_CLEAN = f"""
cl0 as (select doc_id, unnest(ls) as x, unnest(range(len(ls))) as i from (select doc_id, string_split(regexp_replace(content_md, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) as ls from md)),
cl1 as (select *, trim(x, {_WS}) as s from cl0),
cl2 as (select *, (regexp_matches(s, '^[-*\\[\\]()!>\\s]*(https?://|\\[.*\\]\\()') or (length(s) < 40 and contains(s, '](')))::int as l from cl1),
cl3 as (select *, sum(l) over (partition by doc_id order by i rows between 3 preceding and current row) as run from cl2),
cl as (select doc_id, trim(coalesce(string_agg(x, chr(10) order by i) filter (run < 4), ''), {_WS}) as content from cl3 group by 1)
"""


@query(f"with {MD}, {_CLEAN} select doc_id, md5(content) as content_md5, length(content)::int as n_chars from cl")
def crw05_clean_markdown(spark, sf_dir):
    c = markdown(spark, sf_dir).select("doc_id", F.explode(F.array(text.clean_markdown(F.col("content_md")))).alias("c"))
    return c.select("doc_id", F.md5(F.col("c").cast("binary")).alias("content_md5"), F.length("c").alias("n_chars"))


_NAV = f"""
nv0 as (select doc_id, unnest(ls) as x, unnest(range(len(ls))) as i, len(ls) as n from md0),
nv1 as (select *, trim(x, {_WS}) as s from nv0),
nv2 as (select *, (length(s) >= 120 and not regexp_matches(s, '^(#|>|\\||```|~~~|---|===)') and {_share('s')} <= 0.35) as p from nv1),
nv3 as (select *, sum(p::int) over (partition by doc_id order by i rows between current row and 29 following) as near from nv2),
an as (select doc_id, min(i) filter (p and near >= 2) as a, max(n) as n from nv3 group by 1),
st as (select an.doc_id, an.a, an.n, coalesce(max(case when starts_with(nv3.s, '#') and nv3.i < an.a and nv3.i >= an.a - 15 then nv3.i end), any_value(an.a)) as st, max(case when nv3.p and nv3.i > an.a then nv3.i end) as la from an join nv3 on nv3.doc_id = an.doc_id group by an.doc_id, an.a, an.n),
en as (select *, coalesce(least(n, la + 13), n) as en from st),
ft as (select en.doc_id, min(nv3.i) as f from en join nv3 on nv3.doc_id = en.doc_id and nv3.i > en.st and nv3.i < en.en and regexp_matches(nv3.x, '^[\\s#>|\\-*_·]*({fixed.FOOTER})', 'i') group by 1),
bd as (select en.doc_id, trim(string_agg(nv3.x, chr(10) order by nv3.i), {_WS}) as body from en left join ft using (doc_id) join nv3 on nv3.doc_id = en.doc_id and nv3.i >= en.st and nv3.i < coalesce(ft.f, en.en) where en.a is not null and en.n > 6 group by 1)
"""


@query(f"with {MD}, {_NAV} select md.doc_id, md5(coalesce(body, content_md)) as body_md5, (body is not null) as cut from md left join bd using (doc_id)")
def crw04_strip_navigation(spark, sf_dir):
    m = markdown(spark, sf_dir).select("doc_id", "content_md", F.explode(F.array(text.strip_navigation(F.col("content_md")))).alias("b"))
    n = F.size(F.split("content_md", "\n"))
    prose = F.transform(F.split("content_md", "\n"), text.is_prose)
    near = F.exists(F.sequence(F.lit(0), n - 1), lambda i: F.get(prose, i) & (F.size(F.filter(F.slice(prose, i + 1, 30), lambda p: p)) >= 2))
    return m.select("doc_id", F.md5(F.col("b").cast("binary")).alias("body_md5"), ((n > 6) & near).alias("cut"))


_DOMAINS = "['www.cdc.gov', 'blog.sleepfoundation.org', 'example.com', 'uni.edu', 'clinic.nhs.uk', 'unknown.xyz', 'sport.gov.cn']"


def _domain_score(d):
    d = f"regexp_replace(lower(trim({d})), '^www\\.', '')"
    suffix = "case " + " ".join(f"when ends_with({d}, '{s}') then {w}" for s, w in fixed.SUFFIXES) + f" else {fixed.OTHER_SUFFIX} end"
    listed = f"case {d} " + " ".join(f"when '{h}' then {w}" for h, w in fixed.HOSTS.items()) + " else case " + " ".join(f"when ends_with({d}, '.{h}') then {w}" for h, w in fixed.HOSTS.items()) + " else 0 end end"
    return f"greatest({suffix}, {listed})::double"


@query(f"select doc_id, {pr(_domain_score(_DOMAINS + '[doc_id % 7 + 1]'), 3)} as domain_score from documents")
def fn42_domain_score(spark, sf_dir):
    d = F.element_at(F.array(*[F.lit(x) for x in ("www.cdc.gov", "blog.sleepfoundation.org", "example.com", "uni.edu", "clinic.nhs.uk", "unknown.xyz", "sport.gov.cn")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", pyround(url.domain_score(d), 3).alias("domain_score"))


def _hits(words, low, topic):
    single = [k for k in TOPICS[topic] if " " not in k]
    several = [k for k in TOPICS[topic] if " " in k]
    n = f"len(list_intersect({words}, {single}::varchar[]))"
    return n + "".join(f" + case when regexp_matches(' ' || {low} || ' ', '[^\\p{{L}}\\p{{N}}_]{k}[^\\p{{L}}\\p{{N}}_]') then 1 else 0 end" for k in several)


_HIT = f"""
ht0 as (select doc_id, replace(lower(coalesce(text, '')), '-', ' ') as low from documents), ht1 as (select doc_id, low, list_distinct(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+')) as ws from ht0),
ht as (select doc_id, {", ".join(f"({_hits('ws', 'low', t)})::int as {t}" for t in TOPICS)} from ht1)
"""


@query(f"with {_HIT} select * from ht")
def kb10_keyword_hits(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(ops.keyword_hits(F.col("text"), TOPICS))).alias("h"))
    return d.select("doc_id", *[F.get("h", F.lit(i))["hits"].alias(t) for i, t in enumerate(TOPICS)])


_CLASS = f"""
cs0 as (select *, list_sort([{{'n': -english, 'i': 0, 't': 'english'}}, {{'n': -german, 'i': 1, 't': 'german'}}, {{'n': -romance, 'i': 2, 't': 'romance'}}]) as o from ht),
cs as (select doc_id, coalesce(list_filter(o, lambda x: x.n < 0)[1].t, 'training') as category, array_to_string(list_transform(list_filter(o, lambda x: x.n < 0), lambda x: x.t), ',') as topics, {pr('least(1, (english + german + romance) / 12.0::double)', 3)} as relevance from cs0)
"""


@query(f"with {_HIT}, {_CLASS} select * from cs")
def kb11_classify(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(ops.classify(ops.keyword_hits(F.col("text"), TOPICS)))).alias("c"))
    return d.select("doc_id", "c.category", F.array_join("c.topics", ",").alias("topics"), "c.relevance")


_ART = f"""
ar0 as (select doc_id as id, source, lang, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') as nb, text as content_md from documents),
ar as (select id, source, lang, nb[1][:80] as title, nb[2:9] as key_points, content_md, {_DOMAINS}[id % 7 + 1] as domain, case when id % 6 <> 0 then date '2024-06-01' - (id % 3000)::int end as published_at, {pr('(id % 100) / 100.0::double')} as score from ar0 where len(nb) > 0),
md as (select id as doc_id, content_md from ar),
{_CLEAN},
sc0 as (select ar.*, cl.content, title || chr(10) || ({_prose('cl.content')})[:20000] as blob from ar join cl on cl.doc_id = ar.id),
sc1 as (select *, replace(lower(blob), '-', ' ') as low, lower(blob[:2000]) as lb from sc0),
sc2 as (select *, list_distinct(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+')) as ws from sc1),
sc3 as (select *, {", ".join(f"({_hits('ws', 'low', t)})::int as {t}" for t in TOPICS)} from sc2),
sc4 as (select *, list_filter(list_sort([{{'n': -english, 'i': 0, 't': 'english'}}, {{'n': -german, 'i': 1, 't': 'german'}}, {{'n': -romance, 'i': 2, 't': 'romance'}}]), lambda x: x.n < 0) as o,
  case {" ".join(f"when {' or '.join(f'contains(lb, {chr(39)}{w}{chr(39)})' for w in ws)} then '{level}'" for level, ws in fixed.EVIDENCE)} when regexp_matches(domain, '{"|".join(fixed.REVIEW_HOSTS)}') then 'review' else 'popular' end as evidence_level from sc3),
sc5 as (select id, source, title, content, domain, published_at, coalesce(o[1].t, 'training') as category, array_to_string(list_transform(o, lambda x: x.t), ',') as topics, evidence_level, {pr('least(1, (english + german + romance) / 12.0::double)', 3)} as relevance_score,
  {pr(_domain_score('domain'), 3)} as domain_score, case when evidence_level in ('guideline', 'review') then 0.9 when published_at is null then 0.6 else {pr("exp(-greatest(0, date_diff('day', published_at, date '" + AS_OF + "')) * ln(2) / 900)", 3)} end::double as recency_score, {pr(_share('content'), 3)} as link_ratio from sc4),
sc as (select *, {pr('0.55::double * domain_score + 0.2::double * recency_score + 0.25::double * relevance_score', 4)} as score from sc5)
"""


def _scored(spark, sf_dir):
    return ops.score_articles(tables.articles(spark, sf_dir).drop("score"), AS_OF, TOPICS)


@query(f"with {_ART} select id, category, topics, evidence_level, domain_score, recency_score, relevance_score, link_ratio, score from sc")
def kb14_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "category", F.array_join("topics", ",").alias("topics"), "evidence_level", "domain_score", "recency_score", "relevance_score", "link_ratio", "score")


_GATE = f"""{_ART}, st as (select id, case when id % 2 = 0 then content else content || '!' end as content, title from sc where id % 4 in (0, 1)),
ga as (select sc.*, case when length(sc.content) < 300 then 'too_short' when link_ratio >= 0.8 then 'index_page' when st.id is null and relevance_score < 0.25 then 'irrelevant' when st.id is not null and st.content = sc.content and st.title = sc.title then 'skipped' when st.id is not null then 'updated' else 'inserted' end as action from sc left join st on st.id = sc.id)"""


def _gated(spark, sf_dir):
    s = keep(_scored(spark, sf_dir), "scored").withColumn("url_hash", url.url_hash(F.concat(F.lit("http://e.x/"), F.col("id").cast("string"))))
    stored = s.where("id % 4 in (0, 1)").select("url_hash", F.when(F.col("id") % 2 == 0, F.col("content")).otherwise(F.concat("content", F.lit("!"))).alias("content"), "title", "id")
    return ops.gate(s, stored), stored


@query(f"with {_GATE} select id, action from ga")
def kb20_gates(spark, sf_dir):
    return _gated(spark, sf_dir)[0].select("id", "action")


_ACTIONS = ("inserted", "updated", "skipped", "too_short", "index_page", "news_item", "irrelevant", "not_article")
_TALLY = ", ".join(f"count(*) filter (action = '{a}') as {a}" for a in _ACTIONS)


@query(f"with {_GATE} select source, count(*) as fetched, {_TALLY} from ga group by 1")
def snk12_tallies(spark, sf_dir):
    return ops.tallies(_gated(spark, sf_dir)[0])


@query(
    f"""with {_GATE}, t as (select source, count(*) as fetched, {_TALLY} from ga group by 1),
v as (select sum(fetched)::bigint as fetched, (count(*) * 2)::bigint as failed, sum(inserted + updated)::bigint as stored, sum(irrelevant)::bigint as irrelevant, coalesce(list_sort(list(source) filter (fetched >= 3 and inserted + updated + skipped = 0)), []) as dead, sum(too_short) as a, sum(index_page) as b, sum(news_item) as c, sum(not_article) as e from t),
p as (select *, list_filter([case when failed / (fetched + failed) > 0.5 then 'fail_rate' end, case when fetched > 0 and stored = 0 then 'nothing_stored' end, case when irrelevant > greatest(3, fetched / 2) then 'irrelevant' end, case when len(dead) > 0 then 'dead_sources' end], lambda x: x is not null) as problems,
  list_sort(list_filter([{{'n': -a, 'r': 'too_short'}}, {{'n': -b, 'r': 'index_page'}}, {{'n': -c, 'r': 'news_item'}}, {{'n': -irrelevant, 'r': 'irrelevant'}}, {{'n': -e, 'r': 'not_article'}}], lambda x: x.n < 0)) as rs from v)
select fetched, failed, stored, irrelevant, array_to_string(dead, ',') as dead_sources, array_to_string(problems, ',') as problems, array_to_string(list_transform(rs[1:5], lambda x: x.r || '=' || (-x.n)::bigint::varchar), ',') as reasons,
  case when list_contains(problems, 'fail_rate') or list_contains(problems, 'nothing_stored') then 'bad' when len(problems) > 0 then 'warn' else 'ok' end as verdict from p"""
)
def agg23_verify(spark, sf_dir):
    v = ops.verify_round(ops.tallies(_gated(spark, sf_dir)[0]).withColumn("failed", F.lit(2).cast("long")))
    return v.withColumns({c: F.array_join(c, ",") for c in ("dead_sources", "problems", "reasons")})


@query(f"with {_GATE}, n as (select id, content, title from ga where action in ('inserted', 'updated')) select id, md5(content) as content_md5 from n union all select id, md5(content) from st where id not in (select id from n)")
def snk11_upsert(spark, sf_dir):
    g, stored = _gated(spark, sf_dir)
    return ops.upsert(stored, g).select("id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"with {_ART} select domain, count(*) as n from sc group by 1 order by n desc, domain limit 20")
def agg17_stats(spark, sf_dir):
    return ops.stats(_scored(spark, sf_dir), "domain", 20)


@query(f"with {_ART} select category, count(*) as n from sc group by 1")
def agg18_categories(spark, sf_dir):
    return ops.stats(_scored(spark, sf_dir), "category")


@query("with s as (select distinct source from documents), c as (select source, count(*) as n from documents group by 1) select s.source, n from s join c on s.source is not distinct from c.source")
def joi04_source_counts(spark, sf_dir):
    return ops.source_counts(tables.table(spark, sf_dir, "documents").select("source").distinct(), tables.table(spark, sf_dir, "documents"))


@query("with s as (select source from documents union select n_name from nation), c as (select source, count(*) as n from documents group by 1) select s.source, coalesce(n, 0) as n from s left join c on s.source is not distinct from c.source")
def joi04_all_source_counts(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    return ops.source_counts(d.select("source").union(tables.table(spark, sf_dir, "nation").select("n_name")).distinct(), d)


@query(f"with {_ART} select id from ar order by published_at desc nulls last, score desc, id limit 50 offset 10")
def srt02_nulls_last(spark, sf_dir):
    return ops.listing(tables.articles(spark, sf_dir), offset=10, limit=50).select("id")


@query(f"with {_ART} select id from ar where domain = 'uni.edu' and score >= 0.2 and (contains(lower(title), 'the') or contains(lower(content_md), 'the')) order by score desc, published_at desc nulls last, id limit 20")
def flt04_search(spark, sf_dir):
    a = tables.articles(spark, sf_dir).drop("key_points")
    return ops.listing(a, domain="uni.edu", min_score=0.2, search="THE", by="score").select("id")


@query(f"with {_ART} select id, array_to_string(list_distinct_ordered, '|') as points_md5 from (select id, list_transform(list_filter(list_transform(key_points, lambda x, i: {{'i': i, 'x': x}}), lambda s: list_position(key_points, s.x) = s.i), lambda s: s.x) as list_distinct_ordered from ar)")
def set04_ordered_distinct(spark, sf_dir):
    return tables.articles(spark, sf_dir).select("id", F.array_join(F.array_distinct("key_points"), "|").alias("points_md5"))


@query("select conv_id, turn, md5(text) as text_md5 from conversations where role = 'user' qualify row_number() over (partition by conv_id order by turn desc) = 1")
def win14_last_turn(spark, sf_dir):
    return turns.last_turn(tables.table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("select conv_id, turn from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def win14_recent_turns(spark, sf_dir):
    return turns.recent_turns(tables.table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn")


def _packed(pieces, limit, glue):
    """Neighbouring strings of a list joined as long as they fit, in SQL."""
    acc = f"""list_reduce(list_transform({pieces}, lambda piece: {{'done': []::varchar[], 'cur': piece}}), lambda a, e: case when a.cur = '' then {{'done': a.done, 'cur': e.cur}} when length(a.cur || {glue} || e.cur) <= {limit} then {{'done': a.done, 'cur': a.cur || {glue} || e.cur}} else {{'done': list_append(a.done, a.cur), 'cur': e.cur}} end, {{'done': []::varchar[], 'cur': ''}})"""
    return f"list_transform([{acc}], lambda r: case when r.cur = '' then r.done else list_append(r.done, r.cur) end)[1]"


def _segments(limit, most):
    chops = f"""flatten(list_transform(list_filter(list_transform(regexp_extract_all(p, '[^。！？!?；;\\n]+[。！？!?；;]?'), lambda s: trim(s, {_WS})), lambda s: s <> ''), lambda s: list_transform(range(0, (length(s) + {limit - 1}) // {limit}), lambda i: substr(s, i * {limit} + 1, {limit}))))"""
    gap = "chr(10) || chr(10)"
    return f"""sg0 as (select doc_id, trim(content_md, {_WS}) as t from md),
sg1 as (select doc_id, unnest(string_split(t, chr(10))) as x, unnest(range(len(string_split(t, chr(10))))) as i from sg0 where length(t) > {limit}),
sg2 as (select *, sum((i > 0 and regexp_matches(trim(x, {_WS}), '^#{{1,4}}\\s'))::int) over (partition by doc_id order by i) as b from sg1),
sg3 as (select doc_id, b, trim(string_agg(x, chr(10) order by i), {_WS}) as blk from sg2 group by 1, 2),
sg4 as (select * from sg3 where blk <> '' and not regexp_matches(split_part(blk, chr(10), 1), '{fixed.NOISE_HEADING}', 'i')),
sg5 as (select doc_id, b, unnest(ps) as p, unnest(range(len(ps))) as j from (select *, list_filter(regexp_split_to_array(blk, '\\n\\s*\\n'), lambda p: trim(p, {_WS}) <> '') as ps from sg4 where length(blk) > {limit})),
sg6 as (select doc_id, b, j, case when length(p) <= {limit} then [p] else {_packed(chops, limit, "''")} end as ps from sg5),
sg7 as (select doc_id, b, {_packed('ps', limit, gap)} as ch from (select doc_id, b, flatten(list(ps order by j)) as ps from sg6 group by 1, 2) union all select doc_id, b, [blk] from sg4 where length(blk) <= {limit}),
sg8 as (select doc_id, {_packed('ch', limit, gap)} as ss from (select doc_id, flatten(list(ch order by b)) as ch from sg7 group by 1)),
sg as (select doc_id, t, case when t = '' then [] when length(t) <= {limit} then [t] when ss is null then [] when len(ss) <= {most} then ss else list_transform(range({most}), lambda k: ss[round_even(k * (len(ss) - 1) / {most - 1}.0::double, 0)::int + 1]) end as ss from sg0 left join sg8 using (doc_id))"""


_SEGMENT_ROWS = "select doc_id, unnest(range(len(ss)))::int as place, length(unnest(ss))::int as n_chars, md5(unnest(ss)) as segment_md5 from sg"


@query(f"with {MD}, {_segments(segments.CHARS, segments.MOST)} {_SEGMENT_ROWS}")
def kb17_segments(spark, sf_dir):
    m = markdown(spark, sf_dir).select("doc_id", F.posexplode(segments.segment(F.col("content_md"))).alias("place", "segment"))
    return m.select("doc_id", "place", F.length("segment").alias("n_chars"), F.md5(F.col("segment").cast("binary")).alias("segment_md5"))


@query(f"with {MD}, {_segments(200, 4)} {_SEGMENT_ROWS}")
def kb17_short_segments(spark, sf_dir):
    """Segments of 200 characters, which most texts exceed: blocks, paragraphs and sentences are all cut."""
    m = markdown(spark, sf_dir).select("doc_id", F.posexplode(segments.segment(F.col("content_md"), 200, 4)).alias("place", "segment"))
    return m.select("doc_id", "place", F.length("segment").alias("n_chars"), F.md5(F.col("segment").cast("binary")).alias("segment_md5"))


@query(f"with {MD}, {_segments(segments.CHARS, segments.MOST)} select doc_id, {pr('case when length(t) > 0 then least(1, coalesce(list_sum(list_transform(ss, lambda s: length(s))), 0) / length(t)::double) else 1 end', 4)} as coverage from sg")
def agg20_coverage(spark, sf_dir):
    m = markdown(spark, sf_dir)
    return m.select("doc_id", pyround(segments.coverage(F.col("content_md"), segments.segment(F.col("content_md"))), 4).alias("coverage"))


def _nearest_rank(p):
    return f"list_sort(list(n_chars))[least(count(*), floor(count(*) * {p})::bigint + 1)]"


@query(f"select lang, {_nearest_rank(0.25)} as p25, {_nearest_rank(0.5)} as p50, {_nearest_rank(0.9)} as p90 from documents group by 1")
def agg19_nearest_rank(spark, sf_dir):
    return ops.percentiles(tables.table(spark, sf_dir, "documents"), "lang", "n_chars", {"p25": 0.25, "p50": 0.5, "p90": 0.9}).drop("n")


def _price_rank(p):
    return f"list_sort(list(l_extendedprice))[least(count(*), floor(count(*) * {p})::bigint + 1)]"


@query(f"select l_returnflag as flag, count(*) as n, {_price_rank(0.01)} as p01, {_price_rank(0.5)} as p50, {_price_rank(0.999)} as p999, {_price_rank(1.0)} as most from lineitem group by 1")
def agg19_continuous(spark, sf_dir):
    """Ranks of prices, nearly all of them distinct, in three groups that hold all rows."""
    items = tables.table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return ops.percentiles(items, "flag", "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p999": 0.999, "most": 1.0})
