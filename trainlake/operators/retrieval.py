"""Top-k retrieval: by keywords, and by vectors with a recall pool, a second score for each passage and a floor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import fixed
from ..functions.numbers import nz, pyround
from ..functions.text import once
from ..storage import keep

RECALL, EXTRA_MIN, KEEP, COVERAGE, PARTS = 30, 0.3, -2.5, 0.5, 8
#: Queries that one pass over the articles or vectors answers; a larger set takes more passes and not more memory.
BLOCK = 4096
#: Cells of a table of scores (queries by articles) that a task holds at once: 8 MB.
CELLS = 1 << 20


def query_terms(x: Column, topics: dict | None = None) -> Column:
    """Search terms: Latin words of three or more letters, CJK runs as 2- to 4-grams, and the Latin words of every topic of which a
    CJK word occurs; stop words left out."""
    topics = topics or fixed.TOPICS
    latin = lambda w: any(c.isascii() and c.isalpha() for c in w)

    def of(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit(r"([a-z][a-z\-]{2,})"), F.lit(1))
        runs = F.regexp_extract_all(low, F.lit(r"([\x{4e00}-\x{9fff}]+)"), F.lit(1))
        gram = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - (n - 1), F.lit(1))), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        grams = F.flatten(F.transform(runs, lambda r: F.concat(*[gram(r, n) for n in (2, 3, 4)])))
        bridge = []
        for keys in topics.values():
            cjk, other = [k for k in keys if not latin(k)], [k.lower().replace("-", " ") for k in keys if latin(k)]
            if cjk and other:
                hit = F.exists(F.array(*[F.lit(k) for k in cjk]), lambda k: low.contains(k))
                bridge.append(F.when(hit, F.array(*[F.lit(k) for k in other])).otherwise(F.array().cast("array<string>")))
        plain = F.filter(F.concat(words, grams), lambda w: ~w.isin(*fixed.STOP))
        return F.array_distinct(F.concat(plain, *bridge))

    return once(F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("-"), F.lit(" ")), of)


def searchable(*parts: Column) -> Column:
    return F.replace(F.lower(F.concat_ws(" ", *parts)), F.lit("-"), F.lit(" "))


def _points(key_points: Column, most: int) -> Column:
    return F.array_join(F.slice(F.coalesce(key_points, F.array().cast("array<string>")), 1, most), fixed.POINT_SEPARATOR, "None")


def doc_text(title: Column, summary: Column, key_points: Column, content: Column, limit: int = 1200) -> Column:
    """What an article's vector is made of: title, summary and six points, a line each; the beginning of the text too where that is under
    60 characters."""
    filled = lambda x: F.btrim(F.coalesce(x, F.lit("")))
    lines = F.filter(F.array(filled(title), filled(summary), _points(key_points, 6)), lambda x: x != "")
    short = F.coalesce(content, F.lit("")) != ""
    return once(F.array_join(lines, "\n"), lambda t: F.btrim(F.substring(F.when((F.length(t) < 60) & short, F.concat(t, F.lit("\n"), F.substring(F.btrim(content), 1, limit))).otherwise(t), 1, limit + 400)))


def rerank_text(title: Column, summary: Column, key_points: Column, content: Column, limit: int = 1200) -> Column:
    """What a reranker reads: summary and four points without the title; title and beginning of the text where there is no summary."""
    filled = lambda x: F.btrim(F.coalesce(x, F.lit("")))
    whole = F.substring(F.btrim(F.concat(filled(summary), F.lit("\n"), _points(key_points, 4)), F.lit(" \n\t\r")), 1, limit + 400)
    return F.when(filled(summary) != "", whole).otherwise(F.btrim(F.concat(filled(title), F.lit("\n"), F.substring(filled(content), 1, limit)), F.lit(" \n\t\r")))


def match_score(terms: Column, body: Column, title: Column) -> Column:
    """Three for each term in the title, else one for each in the body; an eighth of the sum, at most 1."""
    n = F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.when(title.contains(t), 3.0).when(body.contains(t), 1.0).otherwise(0.0))
    return F.least(F.lit(1.0), n / 8.0)


def _blocks(queries: DataFrame, block: int) -> Iterator[list]:
    """The rows of a stated set of queries, about `block` at a time, dealt by a hash of query_id."""
    n = max(1, -(-queries.count() // block))
    for i in range(n):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else queries
        yield part.orderBy("query_id").collect()


def _slices(batch: pa.RecordBatch, n_queries: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose table of scores has at most CELLS cells, however many queries there are."""
    step = max(1, CELLS // max(n_queries, 1))
    return (batch.slice(k, step) for k in range(0, len(batch), step))


def _union(parts: Iterator[DataFrame], none: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return none if out is None else out


def _each_best(scores: np.ndarray, ids: np.ndarray, top: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `top` largest of each row, ties by id, and all within `slack` of the last of them; -inf is none."""
    if scores.shape[1] > top:
        last = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
        keep = scores >= last[:, None] - slack
    else:
        keep = np.ones(scores.shape, bool)
    row, col = np.nonzero(keep & np.isfinite(scores))
    if not slack:
        order = np.lexsort((ids[col], -scores[row, col], row))
        row, col = row[order], col[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
        row, col = row[nth < top], col[nth < top]
    return row, col


def matches(queries: DataFrame, articles: DataFrame, least: float, top: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, id, match, score of the pairs with a match of `least` (more than 0) or more; with `top` only those that can be
    among a query's best by 0.60 match + 0.40 score.

    queries: query_id, terms; articles: id, title_text, body, score. A pass over the articles takes a block of queries, held as an
    inverted index: the block's terms and, for each, its queries. A task looks all terms up in a text at once and adds the weights of
    those found along their postings, so memory and work follow the postings and pairs without a match are never rows."""
    ship(articles.sparkSession)

    def run(rows: list) -> DataFrame:
        terms = sorted({t for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(terms)}
        ids = np.array([r["query_id"] for r in rows], np.int64)
        pairs = np.array(sorted((place[t], i) for i, r in enumerate(rows) for t in r["terms"]), np.int64).reshape(-1, 2)
        asked, ends = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))

        def task(batches):
            import ahocorasick

            machine = ahocorasick.Automaton()
            for t, i in place.items():
                machine.add_word(t, i)
            machine.make_automaton()
            found = (lambda x: {i for _, i in machine.iter(x)}) if terms else (lambda x: set())

            def matched(title: str, body: str) -> np.ndarray:
                weight = dict.fromkeys(found(body or ""), 1.0) | dict.fromkeys(found(title or ""), 3.0)
                at = [asked[ends[i] : ends[i + 1]] for i in weight]
                if not at:
                    return np.zeros(len(ids))
                return np.bincount(np.concatenate(at), np.repeat(list(weight.values()), [len(x) for x in at]), len(ids))

            for b in batches:
                for part in _slices(b, len(ids)):
                    match = np.array([matched(*x) for x in zip(part.column("title_text").to_pylist(), part.column("body").to_pylist(), strict=True)]).reshape(len(part), len(ids))
                    match = np.minimum(1.0, match.T / 8.0)
                    score = part.column("score").to_numpy(zero_copy_only=False).astype(np.float64)
                    rank = np.where(match >= least, 0.60 * match + 0.40 * np.where(np.isnan(score) | (score == 0), 0.5, score)[None, :], -np.inf)
                    article = part.column("id").to_numpy(zero_copy_only=False)
                    row, col = np.nonzero(match >= least) if top is None else _each_best(rank, article, top, 2e-4)
                    cols = [pa.array(ids[row]), pa.array(article[col], pa.int64()), pa.array(match[row, col]), part.column("score").cast(pa.float64()).take(pa.array(col))]
                    yield pa.RecordBatch.from_arrays(cols, ["query_id", "id", "match", "score"])

        return articles.select(F.col("id").cast("long").alias("id"), "title_text", "body", F.col("score").cast("double").alias("score")).mapInArrow(task, "query_id long, id long, match double, score double")

    none = articles.select(F.lit(0).cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), F.lit(0.0).alias("match"), F.col("score").cast("double").alias("score")).limit(0)
    return _union(map(run, _blocks(queries.select(F.col("query_id").cast("long").alias("query_id"), "terms"), block)), none)


def keyword_search(queries: DataFrame, articles: DataFrame, top: int = 6, min_match: float = 0.2, block: int = BLOCK) -> DataFrame:
    """query_id, id, match, score, place of each query's best articles; see matches(). Only what each task finds best is shuffled."""
    rows = matches(queries, articles, min_match, top, block).withColumn("total", pyround(0.60 * F.col("match") + 0.40 * F.coalesce(nz("score"), F.lit(0.5)), 4))
    w = W.partitionBy("query_id").orderBy(F.desc("total"), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("query_id", "id", pyround("match", 3).alias("match"), "total", "place")


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 for a zero or empty vector."""
    n = F.least(F.size(a), F.size(b))
    short = lambda v: F.transform(F.slice(v, F.lit(1), n), lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(short(a), short(b), lambda x, y: x * y))
    norm = lambda v: F.sqrt(total(F.transform(short(v), lambda x: x * x)))
    return F.when(n > 0, F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))).otherwise(0.0)


def pack(vector: Column, dim: int) -> Column:
    """A vector as JSON text; null for a null one or one of another length."""
    return F.when(F.size(vector) == dim, F.to_json(F.transform(vector, lambda x: x.cast("double"))))


def unpack(packed: Column, dim: int) -> Column:
    """The vector of JSON text; null for text that is none or has another length."""
    v = F.from_json(packed, "array<double>")
    return F.when((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), v)


def _cosines(a: list, b: list) -> np.ndarray:
    """Cosine of every pair over the shorter length, to 12 places; 0 for a zero, empty or missing vector."""
    out = np.zeros((len(a), len(b)))
    groups = [{}, {}]
    for side, vectors in zip(groups, (a, b), strict=True):
        for i, v in enumerate(vectors):
            if v is not None and len(v):
                side.setdefault(len(v), []).append(i)
    for n, i in groups[0].items():
        for m, j in groups[1].items():
            x, y = (np.array([v[k] for k in at], np.float64)[:, : min(n, m)] for v, at in ((a, i), (b, j)))
            with np.errstate(invalid="ignore", divide="ignore"):
                c = (x / np.sqrt((x * x).sum(1))[:, None]) @ (y / np.sqrt((y * y).sum(1))[:, None]).T
            out[np.ix_(i, j)] = np.nan_to_num(c)
    return np.round(out, 12) + 0.0


def _near(queries: DataFrame, vectors: DataFrame, top: int, block: int, others: bool) -> DataFrame:
    """query_id, id, cosine: of each batch of vectors the `top` nearest to each query. A pass over the vectors takes a block of
    queries; tasks multiply matrices, so no table of pairs is made."""
    ship(vectors.sparkSession)

    def run(rows: list) -> DataFrame:
        ids, q = np.array([r["query_id"] for r in rows], np.int64), [np.array(r["embedding"], np.float64) if r["embedding"] is not None else None for r in rows]

        def task(batches):
            for b in (part for whole in batches for part in _slices(whole, len(q))):
                here = b.column("id").to_numpy(zero_copy_only=False)
                c = _cosines(q, [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in b.column("embedding")])
                if others:
                    c = np.where(ids[:, None] == here[None, :], -np.inf, c)
                row, col = _each_best(c, here, top, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(here[col], pa.int64()), pa.array(c[row, col])], ["query_id", "id", "cosine"])

        return vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(task, "query_id long, id long, cosine double")

    none = vectors.select(F.lit(0).cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), F.lit(0.0).alias("cosine")).limit(0)
    return _union(map(run, _blocks(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding"), block)), none)


def nearest(queries: DataFrame, vectors: DataFrame, top: int = RECALL, block: int = BLOCK, others: bool = False) -> DataFrame:
    """query_id, id, cosine, place: the `top` nearest vectors of each query of a stated set, against all vectors; with `others` a
    vector of the query's own id doesn't count. Ties by id. The shuffle carries at most `top` rows a query and batch."""
    w = W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return _near(queries, vectors, top, block, others).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def recall_pool(queries: DataFrame, vectors: DataFrame, hits: DataFrame, size: int = RECALL, least: float = EXTRA_MIN, block: int = BLOCK) -> DataFrame:
    """query_id, id, cosine, place: the `size` nearest vectors, and in order of cosine behind them up to a third as many of the
    other articles whose keyword match is `least` or more.

    hits: query_id, id, match. The cosine of the extras is computed for hits alone, not by ranking every vector."""
    pool = nearest(queries, vectors, size, block)
    more = hits.where(F.col("match") >= least).select("query_id", "id").join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")
    more = more.join(vectors.select("id", "embedding"), "id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    more = more.select("query_id", "id", F.round(cosine(F.col("_q"), F.col("embedding")), 12).alias("cosine"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    more = more.withColumn("place", nth).where(F.col("place") <= max(1, size // 3)).withColumn("place", F.col("place") + size)
    return pool.unionByName(more)


def prototype_scores(vectors: DataFrame, prototypes: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, topic_score: the best cosine of each vector to a stated set of prototypes (query_id, embedding), in one pass over the
    vectors for each block of prototypes."""
    ship(vectors.sparkSession)

    def run(rows: list) -> DataFrame:
        q = [np.array(r["embedding"], np.float64) if r["embedding"] is not None else None for r in rows]

        def task(batches):
            for b in (part for whole in batches for part in _slices(whole, len(q))):
                c = _cosines([x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in b.column("embedding")], q)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(c.max(1, initial=-1.0))], ["id", "topic_score"])

        return vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(task, "id long, topic_score double")

    parts = [run(rows) for rows in _blocks(prototypes.select("query_id", "embedding"), block)]
    out = _union(iter(parts), None)
    return out if len(parts) == 1 else out.groupBy("id").agg(F.max("topic_score").alias("topic_score"))


def evaluate(queries: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """One row: how many queries have another vector of `threshold` or more, how many have none, and the range of the best."""
    best = _near(queries, vectors, 1, BLOCK, True).groupBy("query_id").agg(F.max("cosine").alias("cosine"))
    hit = F.col("cosine") >= threshold
    return best.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), pyround(F.min("cosine"), 4).alias("lowest"), pyround(F.max("cosine"), 4).alias("highest"))


def parts(key_points: Column, fallback: Column, most: int = PARTS) -> Column:
    """The passages of an article that are scored by themselves: its non-blank key points, else the whole text."""
    p = F.filter(F.transform(F.slice(F.coalesce(key_points, F.array().cast("array<string>")), 1, most), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(p) > 0, p).otherwise(F.array(fallback))


def rerank(pool: DataFrame, passage_scores: DataFrame, top: int = 6, floor: float = KEEP) -> DataFrame:
    """The best passage decides an article's rank; articles under `floor` are dropped, the rest ordered by
    0.70 * sigmoid(rank) + 0.30 * score. passage_scores: query_id, id, rank, one row a passage."""
    best = passage_scores.groupBy("query_id", "id").agg(F.max("rank").alias("rank"))
    rows = pool.join(best, ["query_id", "id"]).where(F.col("rank") >= floor)
    rows = rows.withColumn("total", pyround(0.70 / (1 + F.exp(-F.col("rank"))) + 0.30 * F.coalesce(nz("score"), F.lit(0.5)), 4))
    w = W.partitionBy("query_id").orderBy(F.desc("total"), "id")
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top)


def usable(vectors: DataFrame, least: float = COVERAGE) -> DataFrame:
    """One row: whether enough articles have a vector for the vector path to be taken."""
    return vectors.agg((F.count_if(F.col("embedding").isNotNull()) >= least * F.count(F.lit(1))).alias("usable"))


def retrieve(queries: DataFrame, articles: DataFrame, vectors: DataFrame, scorer, top: int = 6, block: int = BLOCK) -> DataFrame:
    """query_id, id, total, nth, via of each query's best articles.

    Where enough articles have a vector, the vector path decides: recall pool, passage scores, floor; a query that keeps nothing
    there has no result and is not searched by keywords. Else all queries are. queries: query_id, embedding, terms; articles: as
    in matches(); vectors: id, embedding; scorer(pool) gives passage scores (query_id, id, rank). The pool is made once and written. One
    flag reaches the driver."""
    every = articles.select("id").join(vectors, "id", "left")
    if usable(every).first()["usable"]:
        hits = matches(queries, articles, EXTRA_MIN, block=block)
        own = every.where("embedding is not null").select("id", "embedding")
        pool = keep(recall_pool(queries, own, hits, block=block).join(articles.select("id", "score"), "id"), "pool")
        return rerank(pool, scorer(pool), top).select("query_id", "id", "total", "nth", F.lit("vectors").alias("via"))
    return keyword_search(queries, articles, top, block=block).select("query_id", "id", "total", F.col("place").alias("nth"), F.lit("keywords").alias("via"))
