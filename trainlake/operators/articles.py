"""Web articles: topics, evidence, scores, gates, upserts, statistics and the check of a crawl round."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text, url
from ..functions.numbers import nz, pyround, ratio
from ..storage import keep
from . import ledger


def blob(body: Column, title: Column) -> Column:
    """Title and the first 20,000 characters of prose: what topics are judged on."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(text.prose_only(body), 1, fixed.CLASSIFY_CHARS))


def keyword_hits(x: Column, topics: dict[str, list[str]] | None = None) -> Column:
    """array<struct(topic, hits)> in the order of topics: distinct words of each topic in the text; hyphens count as spaces.
    Words in Latin letters match as whole words, others anywhere. Single words are looked up in the set of the text's words."""
    topics = topics or fixed.TOPICS
    latin = lambda w: any("a" <= c <= "z" for c in w)

    listed = {t: [k.lower().replace("-", " ") for k in dict.fromkeys(ks)] for t, ks in topics.items()}
    strings = lambda ks: F.array(*[F.lit(k) for k in ks]).cast("array<string>")
    alone = strings(dict.fromkeys(k for ks in listed.values() for k in ks if latin(k) and " " not in k))

    def count(low: Column) -> Column:
        def of(words: Column) -> Column:
            out = []
            for topic, keys in listed.items():
                single = [k for k in keys if latin(k) and " " not in k]
                several = [k for k in keys if latin(k) and " " in k]
                n = F.size(F.array_intersect(words, strings(single)))
                for k in several:
                    n = n + F.when(low.contains(k) & low.rlike(rf"(?U)\b{k}\b"), 1).otherwise(0)
                for k in keys:
                    if not latin(k):
                        n = n + F.when(low.contains(k), 1).otherwise(0)
                out.append(F.struct(F.lit(topic).alias("topic"), n.alias("hits")))
            return F.array(*out)

        # small letters first: they are most of a text, and the Unicode class is slow
        return text.once(F.array_intersect(F.split(low, r"(?U)[^a-z0-9_\w]+"), alone), of)

    return text.once(F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("-"), F.lit(" ")), count)


def classify(hits: Column, fallback: str = "training") -> Column:
    """struct(category, topics, relevance) of keyword_hits(): topics by hits, ties in their order."""

    def of(some: Column) -> Column:
        order = F.array_sort(F.transform(some, lambda h, i: F.struct((-h["hits"]).alias("n"), i.alias("i"), h["topic"].alias("topic"))))
        total = F.aggregate(some, F.lit(0), lambda a, h: a + h["hits"])
        return F.struct(
            F.coalesce(F.get(order, F.lit(0))["topic"], F.lit(fallback)).alias("category"),
            F.transform(order, lambda o: o["topic"]).alias("topics"),
            pyround(F.least(F.lit(1.0), total / fixed.SATURATION), 3).alias("relevance"),
        )

    return text.once(F.filter(hits, lambda h: h["hits"] > 0), of)


def evidence_level(domain: Column, x: Column) -> Column:
    """The first level whose phrase stands in the first 2,000 characters; popular if none and the host is no review's."""
    any_of = lambda low, words: reduce(or_, (low.contains(w) for w in words))

    def stated(low: Column) -> Column:
        out = F.when(any_of(low, fixed.EVIDENCE[0][1]), fixed.EVIDENCE[0][0])
        for level, words in fixed.EVIDENCE[1:]:
            out = out.when(any_of(low, words), level)
        return out

    return F.coalesce(text.once(F.lower(F.substring(x, 1, 2000)), stated), F.when(F.coalesce(domain, F.lit("")).rlike("|".join(fixed.REVIEW_HOSTS)), "review").otherwise("popular"))


def recency(published: Column, level: Column, as_of: str) -> Column:
    """Half-life of 900 days; 0.9 for guidelines and reviews, 0.6 without a date."""
    age = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), published))
    return F.when(level.isin("guideline", "review"), 0.9).when(published.isNull(), 0.6).otherwise(pyround(F.exp(-age * math.log(2) / fixed.HALF_LIFE_DAYS), 3))


def combined_score(domain_score: Column, recency_score: Column, relevance: Column) -> Column:
    return pyround(fixed.W_DOMAIN * domain_score + fixed.W_RECENCY * recency_score + fixed.W_RELEVANCE * relevance, 4)


def link_ratio(x: Column) -> Column:
    return F.when(F.length(x) > 0, pyround(text.matched_chars(x, fixed.LINK) / F.length(x), 3)).otherwise(1.0)


def is_news(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(fixed.NEWS)


def score_articles(docs: DataFrame, as_of: str, topics: dict | None = None) -> DataFrame:
    """Adds content (cleaned), category, topics, evidence_level, the four scores and link_ratio. No shuffle."""
    out = docs.withColumn("content", text.clean_markdown(F.col("content_md")))
    out = out.withColumn("_blob", blob(F.col("content"), F.col("title")))
    out = out.withColumn("_c", classify(keyword_hits(F.col("_blob"), topics))).withColumn("evidence_level", evidence_level(F.col("domain"), F.col("_blob")))
    out = out.withColumns({"category": F.col("_c.category"), "topics": F.col("_c.topics"), "relevance_score": F.col("_c.relevance"), "domain_score": pyround(url.domain_score(F.col("domain")), 3), "recency_score": recency(F.col("published_at"), F.col("evidence_level"), as_of), "link_ratio": link_ratio(F.col("content"))})
    return out.withColumn("score", combined_score(F.col("domain_score"), F.col("recency_score"), F.col("relevance_score"))).drop("_blob", "_c")


def gate(scored: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds action, the first gate that decides: too_short, index_page, news_item, irrelevant, not_article, skipped, updated or
    inserted. stored: url_hash, content and title of what is there; it holds one row a hash, so the join keeps the rows."""
    old = stored.select("url_hash", F.col("content").alias("_content"), F.col("title").alias("_title"), F.lit(True).alias("_known"))
    rows = scored.join(old, "url_hash", "left")
    known = F.coalesce("_known", F.lit(False))
    substantive = F.coalesce("substantive", F.lit(True)) if "substantive" in scored.columns else F.lit(True)
    action = (
        F.when(F.length("content") < fixed.MIN_BODY, "too_short")
        .when(F.col("link_ratio") >= fixed.INDEX_SHARE, "index_page")
        .when(is_news(F.col("title")), "news_item")
        .when(~known & (F.col("relevance_score") < fixed.MIN_RELEVANCE), "irrelevant")
        .when(~substantive, "not_article")
        .when(known & (F.col("_content") == F.col("content")) & (F.col("_title") == F.col("title")), "skipped")
        .when(known, "updated")
        .otherwise("inserted")
    )
    return rows.withColumn("action", action).drop("_content", "_title", "_known")


def upsert(stored: DataFrame, gated: DataFrame) -> DataFrame:
    """The store after a batch: updated rows replace theirs, inserted ones are added, the rest stays. Of one hash in a batch the row
    with the largest id counts."""
    new = gated.where(F.col("action").isin("inserted", "updated")).withColumn("_n", F.row_number().over(W.partitionBy("url_hash").orderBy(F.desc("id")))).where("_n = 1")
    new = new.select(stored.columns)
    return stored.join(new.select("url_hash"), "url_hash", "left_anti").select(stored.columns).unionByName(new)


def tallies(gated: DataFrame) -> DataFrame:
    """Counts of each action by source."""
    actions = ["inserted", "updated", "skipped", "too_short", "index_page", "news_item", "irrelevant", "not_article"]
    return gated.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), *[F.count_if(F.col("action") == a).alias(a) for a in actions])


def stats(articles: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """key, n in falling order of n, ties by key."""
    out = articles.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)
    return out.limit(top) if top else out


def source_counts(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """source and n, the number of its articles, 0 too; a null source is one. One row a source; articles are counted before the join."""
    counts = articles.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    return sources.join(counts, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def verify_round(tally: DataFrame, top: int = 5) -> DataFrame:
    """One row on a crawl round: totals, problems and a verdict (ok, warn, bad). tally: tallies() with a column failed."""
    rejects = ["too_short", "index_page", "news_item", "irrelevant", "not_article"]
    t = tally.agg(
        F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.col("inserted") + F.col("updated")), F.lit(0)).alias("stored"),
        F.coalesce(F.sum("irrelevant"), F.lit(0)).alias("irrelevant"),
        F.array_sort(F.collect_set(F.when((F.col("fetched") >= 3) & (F.col("inserted") + F.col("updated") + F.col("skipped") == 0), F.col("source")))).alias("dead_sources"),
        *[F.coalesce(F.sum(r), F.lit(0)).alias(f"_{r}") for r in rejects],
    )
    fail_rate = F.coalesce(ratio("failed", nz(F.col("fetched") + F.col("failed"))), F.lit(0.0))
    problems = F.array_compact(
        F.array(
            F.when(fail_rate > 0.5, "fail_rate"),
            F.when((F.col("fetched") > 0) & (F.col("stored") == 0), "nothing_stored"),
            F.when(F.col("irrelevant") > F.greatest(F.lit(3), F.col("fetched") / 2), "irrelevant"),
            F.when(F.size("dead_sources") > 0, "dead_sources"),
        )
    )
    reasons = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"_{r}")).alias("n"), F.lit(r).alias("reason")) for r in rejects]), lambda x: x["n"] < 0))
    out = t.withColumns({"problems": problems, "reasons": F.transform(F.slice(reasons, 1, top), lambda x: F.concat(x["reason"], F.lit("="), (-x["n"]).cast("string")))})
    verdict = F.when(F.array_contains("problems", "fail_rate") | F.array_contains("problems", "nothing_stored"), "bad").when(F.size("problems") > 0, "warn").otherwise("ok")
    return out.withColumn("verdict", verdict).drop(*[f"_{r}" for r in rejects])


def listing(articles: DataFrame, category: str | None = None, domain: str | None = None, min_score: float | None = None, search: str | None = None, offset: int = 0, limit: int = 20, by: str = "published", evidence_level: str | None = None, status: str | None = None) -> DataFrame:
    """A page of articles with `total`, the number of all that fit. by: published (latest first, undated last, then score) or score."""
    for c, v in (("category", category), ("domain", domain), ("evidence_level", evidence_level), ("status", status)):
        if v is not None:
            articles = articles.where(F.col(c) == v)
    if min_score is not None:
        articles = articles.where(F.col("score") >= min_score)
    if search:
        fields = [F.col(c) if t == "string" else F.to_json(c) for c, t in articles.dtypes if c in ("title", "summary", "organization", "key_points", "content_md")]
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.lower(f).contains(search.lower()), F.lit(False))
        articles = articles.where(hit)
    published, score = F.col("published_at").desc_nulls_last(), F.col("score").desc()
    return ledger.page(articles, [*([published, score] if by == "published" else [score, published]), "id"], offset, limit)


def prefilter(articles: DataFrame, category: str | None = None, min_score: float = 0.0, authority: float | None = None) -> DataFrame:
    """The articles that retrieval looks at: of a category, of a score, of an authority of the host (0.85: only authoritative)."""
    if category is not None:
        articles = articles.where(F.col("category") == category)
    articles = articles.where(F.coalesce("score", F.lit(0.0)) >= min_score)
    return articles if authority is None else articles.where(pyround(url.domain_score(F.col("domain")), 3) >= authority)


def brief(articles: DataFrame) -> DataFrame:
    """What a list shows of an article: no body, the date as text, points counted."""
    return articles.select("id", "title", "domain", F.col("published_at").cast("string").alias("published"), "score", F.size("key_points").alias("n_points"))


def detail(articles: DataFrame, stored_scores: DataFrame) -> DataFrame:
    """An article whole, with the parts of its score."""
    return articles.join(stored_scores.select("id", "domain_score", "recency_score", "relevance_score"), "id", "left")


def percentiles(values: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of a column by group: the value at place floor(n p) of the sorted ones, the last at most. Exact.

    Distinct values with their counts are range-partitioned by (group, value) and written; a group of many values lies in many parts.
    The parts' sums give each one's first place, so places are counted within a part and no window holds a group. Nulls are left
    out; a null group is a group."""
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(counts.repartitionByRange(n, "_by", "_v").withColumn("_part", F.spark_partition_id()), "ranked")
    line = W.partitionBy("_by").orderBy("_part")
    sums = dealt.groupBy("_by", "_part").agg(F.sum("_n").alias("_n"))
    sums = sums.select(F.col("_by").alias("_b"), F.col("_part").alias("_p"), (F.sum("_n").over(line) - F.col("_n")).alias("_base"), F.sum("_n").over(W.partitionBy("_by")).alias("_all"))
    rows = dealt.join(sums, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p")))
    rows = rows.withColumn("_upto", F.col("_base") + F.sum("_n").over(W.partitionBy("_by", "_part").orderBy("_v")))
    rank = lambda p: F.least(F.floor(F.col("_all") * p), F.col("_all") - 1)
    at = lambda p: (F.col("_upto") > rank(p)) & (F.col("_upto") - F.col("_n") <= rank(p))
    out = rows.groupBy("_by").agg(F.max("_all").alias("n"), *[F.max(F.when(at(p), F.col("_v"))).alias(name) for name, p in points.items()])
    return out.withColumnRenamed("_by", by)
