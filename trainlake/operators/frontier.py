"""Which pages to fetch: links of list pages filtered, ranked and shared out among sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text, url


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, link: the links of every page, resolved and normalised."""
    out = pages.select("page_id", "url", F.posexplode(text.html_links(F.col("html"))).alias("pos", "href"))
    return out.select("page_id", "url", "pos", url.normalise(url.resolve(F.col("href"), F.col("url"))).alias("link"))


def discover(pages: DataFrame, most: int = 40, like_article: Column | None = None) -> DataFrame:
    """page_id, link, rank, place: at most `most` article-like links of the page's own site, best first, ties in page order."""
    own = links(pages).where(url.same_site(F.col("link"), url.host(F.col("url"))))
    own = own.where(url.is_article_like(F.col("link")) if like_article is None else like_article)
    first = own.groupBy("page_id", "url", "link").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("rank", url.article_rank(F.col("link"), url.section_of(F.col("url"))))
    w = W.partitionBy("page_id").orderBy(F.desc("rank"), "pos")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("page_id", "link", "rank", "place")


def first_owner(candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row a link: the first by order owns it."""
    w = W.partitionBy("link").orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def share_out(candidates: DataFrame, quota: int, source: str = "source", page: str = "page_id") -> DataFrame:
    """At most `quota` links a source, drawn from its pages in turn: first the best link of each page, then the second, and so on.
    A link belongs to the first source and page that list it."""
    owned = first_owner(candidates, [source, page, "place"])
    turn = F.row_number().over(W.partitionBy(source, page).orderBy("place"))
    rows = owned.withColumn("turn", turn)
    n = F.row_number().over(W.partitionBy(source).orderBy("turn", page))
    return rows.withColumn("nth", n).where(F.col("nth") <= quota)


def search_results(results: DataFrame, blocked: Sequence[str] = fixed.BLOCKED_HOSTS, min_authority: float = 0.0) -> DataFrame:
    """url, host, authority and place of the results worth fetching: each address once (its first hit by pass and pos), none of a
    blocked host (whose name holds one of the names), none under min_authority; the most authoritative first, then in order of
    the hits. results: query, pass, pos, url."""
    first = results.where("url is not null and url <> ''").groupBy("query", "url").agg(F.min(F.struct("pass", "pos")).alias("hit"))
    rows = first.withColumn("host", F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))))
    for name in blocked:
        rows = rows.where(~F.contains("host", F.lit(name)))
    rows = rows.withColumn("authority", url.domain_score(F.col("host"))).where(F.col("authority") >= min_authority)
    w = W.partitionBy("query").orderBy(F.desc("authority"), "hit", "url")
    return rows.select("query", "url", "host", "authority", F.row_number().over(w).alias("place"))

