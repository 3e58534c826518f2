"""A crawl round over fetched pages: gates, store, tallies, verdict and its entry in the table of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import pyround, ratio
from ..storage import keep
from . import articles as art

RUN = "run_id long, trigger string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, discovered long, fetched long, inserted long, updated long, skipped long, failed long, error string"
ERROR_CHARS = 4000


def open_run(runs: DataFrame, trigger: str, at: str, run_id: int | None = None) -> DataFrame:
    """runs with a new one that is running; its id is run_id, or one more than the largest."""
    n = {"discovered", "fetched", "inserted", "updated", "skipped", "failed"}
    made = {"run_id": F.coalesce(F.max("run_id"), F.lit(0).cast("long")) + 1 if run_id is None else F.lit(run_id), "trigger": F.lit(trigger), "status": F.lit("running"), "started_at": F.lit(at).cast("timestamp_ntz")}
    cols = [made.get(f.name, F.lit(0) if f.name in n else F.lit(None)).cast(f.dataType).alias(f.name) for f in runs.schema]
    return runs.unionByName(runs.agg(*cols))


def finish_run(runs: DataFrame, run_id: int, totals: DataFrame, status: str, at: str, error: str = "") -> DataFrame:
    """runs with one of them ended: its status, time, totals (one row; a missing column counts 0) and error. Others, and all runs if
    there is none of that id, stay as they are."""
    own = F.col("run_id") == run_id
    named = totals.select(*[F.col(c).alias(f"_t_{c}") for c in totals.columns])
    new = {"status": F.lit(status), "finished_at": F.lit(at), "error": F.lit(error[:ERROR_CHARS])}
    counts = ("discovered", "fetched", "inserted", "updated", "skipped", "failed")
    new |= {c: F.coalesce(f"_t_{c}", F.lit(0)) if c in totals.columns else F.lit(0) for c in counts}
    out = runs.crossJoin(F.broadcast(named))
    return out.select(*[F.when(own, new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in runs.schema])


def round_totals(candidates: DataFrame, fetched: DataFrame, tally: DataFrame) -> DataFrame:
    """One row: discovered, fetched (with a body of MIN_BODY characters), inserted, updated, skipped (by any gate) and failed."""
    good = F.col("ok") & (F.length("content_md") >= fixed.MIN_BODY)
    a = candidates.agg(F.count(F.lit(1)).alias("discovered"))
    b = fetched.agg(F.count_if(good).alias("fetched"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"))
    skipped = ("skipped", "too_short", "index_page", "news_item", "irrelevant", "not_article")
    c = tally.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("inserted", "updated")], F.coalesce(F.sum(sum((F.col(x) for x in skipped[1:]), F.col(skipped[0]))), F.lit(0)).alias("skipped"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


def crawl_round(candidates: DataFrame, fetched: DataFrame, stored: DataFrame, runs: DataFrame, trigger: str, as_of: str, at: str, topics: dict | None = None) -> dict[str, DataFrame]:
    """All stages of a round that follow fetching: store, tallies, verdict and runs.

    candidates: source and url; fetched: a row an address with ok, source and the columns of score_articles(); stored: as in
    gate(). Pages that failed or are too short for the gates count as failed, a null source is one. Fetching itself is a hook.
    The gated pages are written once, so that articles are scored once and all four results are of one state of the store."""
    good = fetched.where(F.col("ok") & (F.length("content_md") >= fixed.MIN_BODY))
    gated = keep(art.gate(art.score_articles(good, as_of, topics), stored), "gated")
    tally = art.tallies(gated)
    lost = fetched.groupBy("source").agg(F.count_if(~F.coalesce(F.col("ok") & (F.length("content_md") >= fixed.MIN_BODY), F.lit(False))).alias("failed"))
    counts = [c for c in tally.columns if c != "source"]
    with_failed = lost.join(tally.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0, counts)
    totals = round_totals(candidates, fetched, tally)
    run_id = runs.agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("m")).first()["m"] + 1
    begun = open_run(runs, trigger, at, run_id)
    return {"store": art.upsert(stored, gated), "tally": with_failed, "verdict": art.verify_round(with_failed), "runs": finish_run(begun, run_id, totals, "done", at)}


def gate_trace(pages: DataFrame, topics: dict | None = None) -> DataFrame:
    """url, chars, link_ratio, relevance, category and reason of every fetched page: the first gate that would stop it, or pass.
    Nothing is filtered."""
    from ..functions import text

    out = pages.withColumn("content", text.clean_markdown(F.col("content_md")))
    out = out.withColumn("_c", art.classify(art.keyword_hits(F.concat_ws("\n", "title", "content"), topics))).withColumn("link_ratio", art.link_ratio(F.col("content")))
    reason = (
        F.when(~F.coalesce("ok", F.lit(False)), "failed")
        .when(F.length("content") < fixed.MIN_BODY, "too_short")
        .when(F.col("link_ratio") >= fixed.INDEX_SHARE, "index_page")
        .when(F.col("_c.relevance") < fixed.MIN_RELEVANCE, "irrelevant")
        .otherwise("pass")
    )
    return out.select("url", "source", F.length("content").alias("chars"), "link_ratio", F.col("_c.relevance").alias("relevance"), F.col("_c.category").alias("category"), reason.alias("reason"))


def source_health(trace: DataFrame) -> DataFrame:
    """A row a source: pages, failed, passed, pass_share and its most frequent reason."""
    by = trace.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
    n = lambda r: F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0))
    out = by.groupBy("source").agg(F.sum("n").alias("pages"), n("failed").alias("failed"), n("pass").alias("passed"), F.min(F.struct((-F.col("n")).alias("o"), "reason")).alias("m"))
    return out.select("source", "pages", "failed", "passed", pyround(ratio("passed", "pages"), 3).alias("pass_share"), F.col("m.reason").alias("usual"))


def enabled_sources(sources: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Sources that are switched on, of the domains asked for where any are (a table with a column domain)."""
    rows = sources.where(F.coalesce("enabled", F.lit(False)))
    return rows if only is None else rows.join(only.select("domain"), "domain", "left_semi")


def purge(articles: DataFrame, min_score: float, domains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): articles of a score under min_score (no score counts as 0) and of the domains given are deleted."""
    low = F.coalesce("score", F.lit(0.0)) < min_score
    rows = articles.withColumn("_low", low)
    if domains is not None:
        listed = domains.select("domain", F.lit(True).alias("_listed")).distinct()
        rows = rows.join(listed, "domain", "left").withColumn("_low", F.col("_low") | F.coalesce("_listed", F.lit(False))).drop("_listed")
    return rows.where("not _low").drop("_low"), rows.where("_low").drop("_low")
