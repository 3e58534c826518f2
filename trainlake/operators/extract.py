"""Fields of an article without a model, and the merge of fields that a model gave for its parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import hooks
from ..deploy import ship
from ..functions import fixed, text
from ..storage import keep
from . import articles, segments

#: Evidence levels from weakest to strongest; most key points and topics; signs of a question for a substitute.
EVIDENCE_RANK = ["unknown", "popular", "rct", "review", "guideline"]
MOST_POINTS, MOST_TOPICS, SUMMARY_CHARS, LEAST_PROSE = 8, 8, 280, 120
SWAP_SIGNS = "没有|换成|替换|替代|换一个|换别的|不爱吃|买不到|不吃|过敏|家里没|手边没"
SWAP_TERMS = " 食材替换 食物替代 同等营养 热量相近"


def rule_based(docs: DataFrame, topics: dict | None = None) -> DataFrame:
    """Adds category, topics, summary (the beginning of the prose), evidence_level and note (short for under 120 characters of prose)."""
    out = docs.withColumn("_p", text.prose_only(F.col("content_md")))
    out = out.withColumn("_c", articles.classify(articles.keyword_hits(articles.blob(F.col("_p"), F.col("title")), topics)))
    head = F.trim(F.regexp_replace(F.substring("_p", 1, 400), r"\s+", " "))
    summary = F.when(F.length(head) > SUMMARY_CHARS, F.concat(F.substring(head, 1, SUMMARY_CHARS), F.lit("…"))).otherwise(head)
    level = articles.evidence_level(F.col("domain"), F.concat_ws("\n", "title", "_p"))
    return out.withColumns({"category": F.col("_c.category"), "topics": F.slice("_c.topics", 1, MOST_TOPICS), "summary": summary, "evidence_level": level, "note": F.when(F.length("_p") < LEAST_PROSE, "short").otherwise("rules")}).drop("_p", "_c")


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row an article of rows (id, part, summary, key_points, evidence_level): the part with most key points is the base (the first of
    equals), the others' points follow in order, each once; the strongest evidence counts, and the first summary if the base has none."""
    w = W.partitionBy("id")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in EVIDENCE_RANK]), F.coalesce("evidence_level", F.lit("unknown"))), F.lit(0))
    base = F.row_number().over(w.orderBy(F.size(F.coalesce("key_points", F.array().cast("array<string>"))).desc(), "part"))
    rows = parts.withColumns({"_b": base, "_e": rank}).withColumn("_o", F.when(F.col("_b") == 1, -1).otherwise(F.col("part")))
    pieces = F.array_sort(F.collect_list(F.struct("_o", F.coalesce("key_points", F.array().cast("array<string>")).alias("p"))))
    flat = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(pieces, lambda x: x["p"])), lambda s: F.trim(s)), lambda s: s != ""))
    first = lambda cond: F.min_by("summary", F.when(cond, F.col("part")))
    has = F.coalesce(F.col("summary"), F.lit("")) != ""
    return rows.groupBy("id").agg(
        F.coalesce(first((F.col("_b") == 1) & has), first(has), F.lit("")).alias("summary"),
        F.slice(flat, 1, MOST_POINTS).alias("key_points"),
        F.max_by("evidence_level", F.struct("_e", -F.col("part"))).alias("evidence_level"),
    )


def to_reextract(stored: DataFrame, limit: int = 100, longest: int = segments.CHARS) -> DataFrame:
    """Articles whose prose exceeds one segment, longest first."""
    rows = stored.withColumn("prose_chars", F.length(text.prose_only(F.col("content_md")))).where(F.col("prose_chars") > longest)
    return rows.orderBy(F.desc("prose_chars"), "id").limit(limit)


def search_query(message: Column, most: int = 120) -> Column:
    """The message cut to `most` characters; questions for a substitute get nutrition terms first."""
    m = F.trim(F.coalesce(message, F.lit("")))
    return F.substring(F.when(m.rlike(SWAP_SIGNS), F.concat(m, F.lit(SWAP_TERMS))).otherwise(m), 1, most)


def plan_query(goal: Column, flags: Column, constraints: Column, request: Column, assessment: Column, most: int = 120) -> Column:
    """What the knowledge base is asked for a plan: goal (with food terms where it is to lose weight), risk flags, constraints, request
    and the first 200 characters of the assessment, those that are there, cut to `most`; a general question where nothing is."""
    listed = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), " ")
    food = F.when(F.lower(goal).isin(*fixed.DIET_GOALS), fixed.DIET_TERMS)
    pieces = F.filter(F.array(goal, food, listed(flags), listed(constraints), request, F.substring(assessment, 1, 200)), lambda x: F.coalesce(x, F.lit("")) != "")
    text_ = F.array_join(pieces, " ")
    return F.substring(F.trim(F.when(text_ == "", fixed.PLAN_TERMS).otherwise(text_)), 1, most)


def tolerant_json(raw: Column) -> Column:
    """The JSON object inside a model's answer, without fences and text around it; null if there is none."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def fallback_pages(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """One row a key: the primary backend's page where it is ok, else the secondary's; fetch_via tells which. Either side has one row
    a key; where an address was fetched more than once, keys name the fetch too."""
    p = primary.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ok").alias("_ok"), F.col("text").alias("_text"))
    rows = p.join(secondary.select(*keys, "ok", "text"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "full")
    good = F.coalesce("_ok", F.lit(False))
    via = F.when(good, "primary").when(F.coalesce("ok", F.lit(False)), "secondary")
    return rows.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], F.when(good, F.col("_text")).when(F.coalesce("ok", F.lit(False)), F.col("text")).alias("text"), via.alias("fetch_via"))


def veto(scored: DataFrame, floor: float, enabled: bool = False) -> DataFrame:
    """Rows whose topic_score is under the floor are dropped, if the veto is on."""
    return scored.where(F.col("topic_score") >= floor) if enabled else scored


def finalize(docs: DataFrame, topics: dict | None = None) -> DataFrame:
    """Fields that a model gave (a struct `fields` of title, organization, author, published_at, category, topics, summary,
    key_points, evidence_level, substantive) brought to legal values; where the model says that the page is no article, its fields are
    emptied and substantive is false. docs: id, title, content_md, domain, published_at, fields.

    An unknown category or evidence level is taken from the text; points and topics are trimmed, blank ones left out."""
    out = docs.withColumn("_p", text.prose_only(F.col("content_md")))
    guess = articles.classify(articles.keyword_hits(articles.blob(F.col("_p"), F.col("title")), topics))["category"]
    level = articles.evidence_level(F.col("domain"), F.concat_ws("\n", "title", "_p"))
    f = lambda c: F.trim(F.coalesce(F.col(f"fields.{c}"), F.lit("")))
    listed = lambda c, most: F.slice(F.filter(F.transform(F.coalesce(F.col(f"fields.{c}"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    real = F.coalesce(F.col("fields.substantive"), F.lit(True))
    known = list(topics or fixed.TOPICS)
    none = F.array().cast("array<string>")
    values = {
        "title": F.substring(F.coalesce(F.nullif(f("title"), F.lit("")), "title"), 1, 500),
        "organization": F.substring(f("organization"), 1, 256),
        "author": F.substring(f("author"), 1, 256),
        "category": F.when(f("category").isin(*known), f("category")).otherwise(guess),
        "topics": listed("topics", MOST_TOPICS),
        "summary": f("summary"),
        "key_points": listed("key_points", MOST_POINTS),
        "evidence_level": F.when(f("evidence_level").isin(*EVIDENCE_RANK), f("evidence_level")).otherwise(level),
    }
    empty = {"title": F.col("title"), "category": F.lit("training"), "topics": none, "key_points": none, "evidence_level": F.lit("unknown")}
    published = F.coalesce(F.when(real, text.parse_date(F.col("fields.published_at"), "9999-12-31")), F.col("published_at"))
    made = {c: F.when(real, v).otherwise(empty.get(c, F.lit(""))) for c, v in values.items()}
    return out.select("id", "domain", real.alias("substantive"), published.alias("published_at"), *[v.alias(c) for c, v in made.items()])


def extract_parts(parts: DataFrame, model: hooks.Extractor, packing: hooks.Packing = hooks.Packing()) -> DataFrame:
    """One row an article of parts (id, part, title, body, domain): its merged fields as a struct, how many parts there are and failed, and
    the first error. A part that fails leaves the others' fields; an article of which all parts failed has null fields."""
    ship(parts.sparkSession)
    asked = parts.select("id", "part", hooks.extract(model, packing, title=F.col("title"), body=F.col("body"), domain=F.col("domain")).alias("x"))
    asked = keep(asked, "extracted")  # a model is called once a part
    counts = asked.groupBy("id").agg(F.count(F.lit(1)).alias("n_parts"), F.count("x.error").alias("n_failed"), F.min_by("x.error", F.when(F.col("x.error").isNotNull(), F.col("part"))).alias("error"))
    good = asked.where("x.error is null")
    merged = merge_parts(good.select("id", "part", *[f"x.fields.{c}" for c in ("summary", "key_points", "evidence_level")]))
    first = good.groupBy("id").agg(F.min_by("x.fields", "part").alias("f"))
    fields = F.col("f").withField("summary", F.col("summary")).withField("key_points", F.col("key_points")).withField("evidence_level", F.col("evidence_level"))
    return counts.join(first.join(merged, "id").select("id", fields.alias("fields")), "id", "left")


def extract_batch(docs: DataFrame, parts: DataFrame, model: hooks.Extractor, packing: hooks.Packing = hooks.Packing(), topics: dict | None = None) -> DataFrame:
    """finalize() of what the model gave for docs' parts, with n_failed and error. Articles of which every part failed keep their row
    with empty fields, category training and evidence unknown; articles without parts are finalized without fields."""
    found = extract_parts(parts, model, packing)
    out = finalize(docs.join(found.select("id", "fields"), "id", "left"), topics)
    out = out.join(found.select("id", "n_parts", "n_failed", "error"), "id", "left")
    lost = F.coalesce(F.col("n_failed") == F.col("n_parts"), F.lit(False))
    empty = {"category": F.lit("training"), "topics": F.array().cast("array<string>"), "summary": F.lit(""), "key_points": F.array().cast("array<string>"), "evidence_level": F.lit("unknown")}
    return out.withColumns({c: F.when(lost, x).otherwise(F.col(c)) for c, x in empty.items()}).drop("n_parts").withColumn("n_failed", F.coalesce("n_failed", F.lit(0)))


def with_fields(fetched: DataFrame, fields: DataFrame) -> DataFrame:
    """Fetched pages with their extracted fields by id; a page whose extraction failed keeps its row, with null fields. Positions
    never decide."""
    return fetched.join(fields.select("id", "fields"), "id", "left")

