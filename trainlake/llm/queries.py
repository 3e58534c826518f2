"""The registered queries opN_<name>: thin uses of the operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, importance, line_dedup, minhash_dedup, mixing, quality_classifier, quality_rules, secret_scan, sharding, suffix_dedup, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines or more; op1_line_dedup_content has the operator's default, which deletes shorter ones too."""
    out = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), short_bytes=None)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


OP1_SQL = """
with l as (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as x from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null)),
nb as (select doc_id, i, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from l),
r as (select doc_id, i, t, row_number() over (partition by doc_id order by i) as r from nb where t <> ''),
w as (select doc_id, r, t || chr(10) || lead(t, 1) over w || chr(10) || lead(t, 2) over w as k from r window w as (partition by doc_id order by r)),
later as (select doc_id, r from (select doc_id, r, row_number() over (partition by k order by doc_id, r) as o from w where k is not null) where o > 1),
gone as (select distinct r.doc_id, r.i from later join r on r.doc_id = later.doc_id and r.r between later.r and later.r + 2),
kept as (select l.doc_id, string_agg(x, chr(10) order by l.i) as t from l anti join gone on gone.doc_id = l.doc_id and gone.i = l.i group by l.doc_id)
select d.doc_id, coalesce(a.n, 0)::bigint as n_lines, coalesce(g.n, 0)::bigint as n_removed, case when d.text is not null then md5(coalesce(kept.t, '')) end as kept_md5
from documents d left join (select doc_id, count(*) as n from r group by doc_id) a using (doc_id)
left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id) left join kept using (doc_id)
"""


def op1_line_dedup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_line_dedup that also deletes runs of one or two lines, of 40 bytes or more or that are a whole text."""
    out = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


OP1_CONTENT_SQL = """
with l as (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as x from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null)),
nb as (select doc_id, i, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from l),
r as (select doc_id, i, t, row_number() over (partition by doc_id order by i) as r, count(*) over (partition by doc_id) as m from nb where t <> ''),
w as (select doc_id, r, m, t, lead(t, 1) over w as t1, lead(t, 2) over w as t2 from r window w as (partition by doc_id order by r)),
k as (select doc_id, r, 1 as n, t as k, m = 1 or strlen(t) >= 40 as due from w
  union all select doc_id, r, 2, t || chr(10) || t1, m = 2 or strlen(t) + strlen(t1) >= 40 from w where t1 is not null
  union all select doc_id, r, 3, t || chr(10) || t1 || chr(10) || t2, true from w where t2 is not null),
later as (select doc_id, r, n from (select *, row_number() over (partition by k order by doc_id, r) as o from k) where o > 1 and due),
gone as (select distinct r.doc_id, r.i from later join r on r.doc_id = later.doc_id and r.r between later.r and later.r + later.n - 1),
kept as (select l.doc_id, string_agg(x, chr(10) order by l.i) as t from l anti join gone on gone.doc_id = l.doc_id and gone.i = l.i group by l.doc_id)
select d.doc_id, coalesce(a.n, 0)::bigint as n_lines, coalesce(g.n, 0)::bigint as n_removed, case when d.text is not null then md5(coalesce(kept.t, '')) end as kept_md5
from documents d left join (select doc_id, count(*) as n from r group by doc_id) a using (doc_id)
left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id) left join kept using (doc_id)
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f
"""


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "class_size")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality_classifier.classify(docs.select("doc_id", "text", "source", "lang"), model, keep_text=False)
    return scored.select("doc_id", "source", "lang", "p_quality", "p_toxic", "host_rate", "path_rate", "accepted")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    return found.select("doc_id", "word_no", F.md5(F.col("value").cast("binary")).alias("value_md5"), F.length("value").alias("value_chars"), "p_secret", "is_secret")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.apply_policy(quality_rules.ledger(docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask")


OP6_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
g as (select rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] as g
      from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
hot as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from g) where c > 1),
rep as (select rid, count(distinct i + k) as n from hot, (select unnest([0, 1, 2]) as k) group by rid),
ln as (select rid, count(*) as n, count(distinct l) as nd
       from (select rid, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
m as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(ln.n, 0) as n_lines, coalesce(ln.n - ln.nd, 0)::bigint as n_dup_lines,
        coalesce(rep.n, 0)::bigint as n_repeat_words, len(regexp_extract_all(text, '[A-Za-z]')) as n_letters, len(regexp_extract_all(text, '[A-Z]')) as n_upper
      from w left join rep using (rid) left join ln using (rid)),
f as (select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (100 * n_symbols > 100 * n_words)::bigint
        + 8 * (100 * n_dup_lines > 50 * n_lines)::bigint + 16 * (100 * n_upper > 50 * n_letters)::bigint
        + 32 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::bigint as fail_mask from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_mask & 3) <> 0 as base_failed, fail_mask = 0 as kept, fail_mask::bigint as fail_mask from f
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    light = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    out = sharding.shard(light, ["doc_id", "size", "text_crc32", "text_hash"], n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.schedule(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", "source", "n_tokens", "weight", "copies", "epoch", "block", "position")

URL_RULES = [("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False)]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of an id is the outcome of the page of that id: bad if of low quality or toxic."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    rules = url_filter.rules_table(spark, [url_filter.Rule.of(text, allow) for text, allow in URL_RULES])
    out = url_filter.judge(pages, url_filter.outcomes(pages, labels), rules)
    return out.select("page_id", "host", "path", "rule", "verdict", "judged_by", "n_labelled", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))


OP11_SQL = r"""
with l as (select doc_id, max(greatest(1 - quality, toxic)) as bad from labels group by doc_id having max(greatest(1 - quality, toxic)) is not null),
p as (select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path, l.bad from pages left join l on l.doc_id = page_id),
h as (select host, string_split(host, '.') as ls, count(bad)::double as n, coalesce(sum(bad), 0)::double as k from p group by host),
h2 as (select *, list_aggregate(ls[-2:], 'string_agg', '.') as domain, ls[-1] as suffix from h),
m0 as (select (sum(k) + 0.5) / (sum(n) + 1.0) as mu from h2),
s0 as (select suffix, sum(n) as n, sum(k) as k, any_value(mu) as mu from h2, m0 group by suffix),
c0 as (select sum((k - n * mu) ** 2 - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0) as rho from s0),
s1 as (select suffix, (s * mu + k) / (s + n) as mu from s0, (select case when rho is null then 1 when rho > 0 then least(10000, greatest(1, 1 / rho - 1)) else 10000 end as s from c0)),
d0 as (select domain, any_value(s1.mu) as mu, sum(n) as n, sum(k) as k from h2 join s1 using (suffix) group by domain),
c1 as (select sum((k - n * mu) ** 2 - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0) as rho from d0),
d1 as (select domain, (s * mu + k) / (s + n) as mu from d0, (select case when rho is null then 1 when rho > 0 then least(10000, greatest(1, 1 / rho - 1)) else 10000 end as s from c1)),
e0 as (select host, n, k, d1.mu from h2 join d1 using (domain)),
c2 as (select sum((k - n * mu) ** 2 - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0) as rho from e0),
e1 as (select host, n, s * mu + k as a, s * (1 - mu) + n - k as b from e0, (select case when rho is null then 1 when rho > 0 then least(10000, greatest(1, 1 / rho - 1)) else 10000 end as s from c2)),
e as (select host, n, a / (a + b) as rate, a / (a + b) - sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as bound from e1),
r(rh, rp, rv) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f as (select p.*, (select arg_max(struct_pack(rule := rh || rp, v := rv), length(rh || rp)) from r where (p.host = rh or ends_with(p.host, '.' || rh)) and starts_with(p.path, rp)) as x from p)
select page_id, f.host, path, x.rule as rule, coalesce(x.v, case when bound > 0.25 then 'block' else 'allow' end) as verdict,
  case when x.rule is not null then 'rule' else 'reputation' end as judged_by, n::bigint as n_labelled, round(rate, 6) as bad_rate, round(bound, 6) as bad_bound
from f join e using (host)
"""
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


OP12_SQL = """
with v as (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where label is not null and embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)),
s as (select a.rid as arid, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from v a, v b where a.vec_id % 100 = 0 and a.rid <> b.rid),
p as (select * from (select *, row_number() over (partition by arid order by score desc, vec_id nulls last) as k from s where same) where k <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.arid, p.k order by s.score desc, s.vec_id nulls last) as rank
  from p join s on s.arid = p.arid and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP13_SQL = r"""
with recursive t0(i, k, c) as (select i::ubigint, 0, i::ubigint from range(256) r(i) union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from t0 where k < 8),
tab as (select list(c order by i) as tab from t0 where k = 8),
hx as (select map_from_entries(list((h1 || h2, (16 * a + b)::ubigint))) as hx from
  (select unnest(string_split('0123456789ABCDEF', '')) as h1, unnest(range(16)) as a), (select unnest(string_split('0123456789ABCDEF', '')) as h2, unnest(range(16)) as b)),
texts as (select true as corpus, row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
  union all select false, -row_number() over (), item_id, coalesce(text, '') from benchmark),
w as (select corpus, rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from texts),
p as (select corpus, rid, ws, unnest(range(1, len(ws) + 1)) as i from w),
f as (select corpus, rid, ws[i] as f from p union all select corpus, rid, ws[i] || ' ' || ws[i + 1] from p where i < len(ws)
  union all select corpus, rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] from p where i + 1 < len(ws)),
g as (select f, (xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, octet_length(encode(f))), lambda j: hx[hex(encode(f))[2 * j + 1:2 * j + 2]])),
  lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint) % 10000)::bigint as bucket from (select distinct f from f), tab, hx),
c as (select corpus, rid, bucket, count(*) as n from f join g using (f) group by all),
b as (select bucket, sum(case when corpus then n else 0 end)::double as s, sum(case when corpus then 0 else n end)::double as t from c group by bucket),
v as (select bucket, floor(1000 * ln((b.t + 1) * (a.s + 10000) / ((b.s + 1) * (a.t + 10000))))::bigint as gain from b, (select sum(s) as s, sum(t) as t from b) a(s, t)),
x as (select rid, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from c join v using (bucket) where corpus group by rid),
y as (select doc_id, rid, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  ('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1:8])::bigint::double as h from w left join x using (rid) where corpus),
z as (select *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::bigint as score, n_words >= 20 as fit from y),
r as (select *, row_number() over (partition by fit order by score desc, doc_id nulls last, n_features, weight) as k, count(*) over (partition by fit) as m from z)
select doc_id, n_features, weight, score, case when fit and k <= floor(5 * m / 100) then k end as rank from r
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op1_line_dedup_content, op2_warc, op3_minhash_dedup, op4_quality_classifier, op5_secret_scan, op6_quality_rules, op7_sharding, op8_decontamination, op9_suffix_dedup, op10_mixing, op11_url_filter, op12_hard_negatives, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op1_line_dedup_content": OP1_CONTENT_SQL, "op2_warc": OP2_SQL, "op6_quality_rules": OP6_SQL, "op11_url_filter": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_importance_resampling": OP13_SQL}
