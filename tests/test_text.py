"""Operators without SQL against plain Python, and worked values."""

import math
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from trainlake import hooks, queries
from trainlake.functions import fixed, physio, text, url
from trainlake.operators import articles, extract, retrieval, segments


def chop(s, n):
    return [s[i : i + n] for i in range(0, len(s), n)] or [""]


def pack(pieces, limit, glue):
    out, cur = [], ""
    for p in pieces:
        if not cur:
            cur = p
        elif len(cur) + len(glue) + len(p) <= limit:
            cur += glue + p
        else:
            out.append(cur)
            cur = p
    return out + [cur] if cur else out


def segment(t, limit, most):
    t = t.strip()
    if not t:
        return []
    if len(t) <= limit:
        return [t]
    parts, cur = [], None
    for ln in t.split("\n"):
        if cur is not None and re.match(r"#{1,4}\s", ln.strip()):
            parts.append(cur)
            cur = ln
        else:
            cur = ln if cur is None else cur + "\n" + ln
    parts = [p.strip() for p in [*parts, cur] if p.strip()]
    parts = [p for p in parts if not re.match(fixed.NOISE_HEADING, p.split("\n")[0], re.I)]
    chunks = []
    for p in parts:
        if len(p) <= limit:
            chunks.append(p)
            continue
        pieces = []
        for para in re.split(r"\n\s*\n", p):
            if not para.strip():
                continue
            if len(para) <= limit:
                pieces.append(para)
            else:
                sents = [s.strip() for s in re.findall(r"[^。！？!?；;\n]+[。！？!?；;]?", para)]
                pieces += pack([c for s in sents if s for c in chop(s, limit)], limit, "")
        chunks += pack(pieces, limit, "\n\n")
    segs = pack(chunks, limit, "\n\n")
    if len(segs) <= most:
        return segs
    return [segs[round(i * (len(segs) - 1) / (most - 1))] for i in range(most)]


def test_segments(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice(["run", "slow", "heart", "rest"]) for _ in range(rng.randint(3, 20))) + rng.choice("!?;。")
    texts = ["", "  ", "short", "x" * 450, "# A\n" + "y" * 90 + "\n## References\nzzz\n# B\nend"]
    for _ in range(30):
        t = ""
        for _ in range(rng.randint(1, 12)):
            t += rng.choice(["", "# Head\n", "## References\n", "\n\n", "\n"]) + sentence() + rng.choice(["\n", "\n\n", " "])
        texts.append(t)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", segments.segment(F.col("t"), 100, 5).alias("s"))
    for r in df.collect():
        assert r.s == segment(texts[r.i], 100, 5), texts[r.i]


def test_coverage_is_whole_for_short_texts(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(segments.coverage(F.col("t"), segments.segment(F.col("t")))).collect()] == [1.0, 1.0, 1.0]


def test_query_terms_bridge(spark):
    df = spark.createDataFrame([("减脂 the weight-loss run",)], "q string")
    got = set(df.select(retrieval.query_terms(F.col("q"), {"w": ["减脂", "weight loss", "body fat"], "x": ["睡眠", "sleep"]})).first()[0])
    assert got == {"减脂", "weight", "loss", "run", "body fat", "weight loss"}


def test_rule_based(spark):
    body = "Running and marathon training improve endurance. " * 20
    rows = [(1, "Guide", body, "acsm.org"), (2, "x", "short", "a.com"), (3, None, None, None)]
    out = {r.id: r for r in extract.rule_based(spark.createDataFrame(rows, "id long, title string, content_md string, domain string")).collect()}
    assert out[1].category == "training" and out[1].note == "rules" and out[1].summary.endswith("…") and len(out[1].summary) == 281
    assert out[2].note == "short" and out[3].category == "training" and out[3].topics == []


def test_worked_values(spark):
    lit = lambda x: F.lit(x)
    n = physio.nutrition_targets(lit(73.1), lit(180.0), lit(22), lit("male"), lit("fat_loss"), lit(4))
    r = spark.range(1).select(n.alias("n"), physio.trimp(lit(34.5), lit(145.0)).alias("t"), physio.load(lit("running"), lit(34.53 * 60), lit(5600 / (34.53 * 60)), lit(None).cast("double")).alias("l")).first()
    assert (r.n.bmr, r.n.tdee, r.n.target_kcal, r.n.protein_g, r.n.fat_g, r.n.carb_g, r.n.deficit_kcal) == (1751, 2714, 2314, 132, 66, 298, 400)
    assert abs(r.t - 34.5 * 0.64 * (85 / 130) * math.exp(1.92 * 85 / 130)) < 1e-9 and abs(r.l.load - 51.4) < 0.5 and r.l.source == "met_estimate"
    none = spark.range(1).select(physio.nutrition_targets(lit(None).cast("double"), lit(180.0), lit(22), lit("male"), lit("health"), lit(4)).alias("n")).first().n
    assert not none.available and none.bmr is None


def test_urls(spark):
    cases = {
        ("../b/c.html?x=1&utm_a=2&y=#f", "HTTPS://Example.COM/a/d/e"): "https://example.com/a/b/c.html?x=1",
        ("//o.org/", "http://x.com/"): "http://o.org/",
        ("/p/", "http://x.com/q"): "http://x.com/p",
        ("?k=v", "http://x.com/q/r"): "http://x.com/q/r?k=v",
        ("mailto:a@b", "http://x.com"): None,
    }
    df = spark.createDataFrame([(u, b, w) for (u, b), w in cases.items()], "u string, b string, w string")
    for r in df.select("w", url.normalise(url.resolve(F.col("u"), F.col("b"))).alias("got")).collect():
        assert r.w is None or r.got == r.w
    likes = {"http://x/2024/05/a": True, "http://x/index.html": False, "http://x/tag/a": False, "http://x/a.pdf": False, "http://x/a/b/c.html": True, "http://x/": False, "http://x/the-long-article-slug-here": True}
    df = spark.createDataFrame(list(likes.items()), "u string, w boolean")
    assert all(r.got == r.w for r in df.select("w", url.is_article_like(F.col("u")).alias("got")).collect())


def test_long_paths_are_resolved_whole(spark):
    long = "x" * 1_500_000
    (r,) = spark.createDataFrame([(f"../{long}/end", "http://a.org/b/c/d")], "u string, b string").select(url.resolve(F.col("u"), F.col("b")).alias("got")).collect()
    assert r.got == f"http://a.org/b/{long}/end"


def test_gates_need_no_store(spark):
    doc = lambda i, t, body: (i, t, body, "cdc.gov", None)
    body = "Regular exercise and running improve endurance and health. " * 10
    rows = [doc(1, "T", "short"), doc(2, "T", "[a](http://x) " * 60), doc(3, "年度会议通知", body), doc(4, "T", "nothing to see here " * 30), doc(5, "T", body)]
    docs = spark.createDataFrame(rows, "id long, title string, content_md string, domain string, published_at date")
    scored = articles.score_articles(docs, "2024-06-30").withColumn("url_hash", F.col("id").cast("string"))
    stored = spark.createDataFrame([], "url_hash string, content string, title string")
    got = {r.id: r.action for r in articles.gate(scored, stored).collect()}
    assert got == {1: "too_short", 2: "index_page", 3: "news_item", 4: "irrelevant", 5: "inserted"}


def test_hooks(spark):
    df = spark.createDataFrame([(1, "ab", [1.0, 2.0]), (2, "abc", None), (3, "x", [1.0])], "id long, t string, embedding array<float>")
    out = hooks.backfill_vectors(df, F.col("t"), lambda s: pd.Series([[float(len(x)), 0.0] for x in s]), dim=2)
    assert {r.id: list(r.embedding) for r in out.collect()} == {1: [1.0, 2.0], 2: [3.0, 0.0], 3: [1.0, 0.0]}


def test_clean_markdown_keeps_three_links(spark):
    md = "start\n" + "\n".join(f"- [l{i}](http://x/{i})" for i in range(6)) + "\n\n\n\nend"
    got = spark.createDataFrame([(md,)], "t string").select(text.clean_markdown(F.col("t"))).first()[0]
    assert got == "start\n- [l0](http://x/0)\n- [l1](http://x/1)\n- [l2](http://x/2)\n\nend"


def test_source_counts_cover_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = dict(docs.groupBy("source").count().collect()) | {r.n_name: 0 for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    got = {r.source: r.n for r in queries.queries()["joi04_all_source_counts"](spark, sf_dir).collect()}
    assert got == want and sum(got.values()) == docs.count() and 0 in got.values()


def test_evaluation_ranks_nothing(spark, sf_dir):
    plan = queries.queries()["agg24_evaluation"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Window" not in plan and "row_number" not in plan


def test_bridge_takes_terms_from_whole_texts(spark, sf_dir):
    plain, bridged = ({r.item_id: set(r.terms.split()) for r in queries.queries()[n](spark, sf_dir).collect()} for n in ("fn50_query_terms", "fn50_bridge"))
    assert plain and all(plain[i] <= bridged[i] for i in plain)


def test_packing_keeps_to_the_budget():
    p = hooks.Packing(budget=100, least=2, most=5)
    lengths = [90, 1, 2, 60, 30, 30, 3, 20, 4, 200]
    got = p.batches(lengths)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert [lengths[i] for b in got for i in b] == sorted(lengths)
    assert all(len(b) <= 5 and (len(b) <= 2 or len(b) * max(lengths[i] for i in b) <= 100) for b in got)
    assert p.batches([]) == []


def test_embedding_in_batches_keeps_order_and_tries_again(spark, tmp_path):
    log = str(tmp_path)
    texts = ["x" * (1 + (i * 37) % 200) for i in range(60)] + [None]

    def model(batch):
        import os
        import uuid

        if not os.path.exists(f"{log}/failed"):
            open(f"{log}/failed", "w").close()
            raise ConnectionError("busy")
        with open(f"{log}/{uuid.uuid4().hex}.call", "w") as f:
            f.write(" ".join(str(len(x)) for x in batch))
        return pd.Series([[float(len(x)), 1.0] for x in batch])

    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    packing = hooks.Packing(budget=400, least=2, most=8, count=len, threads=2, tries=2)
    got = {r.id: r.v for r in df.select("id", hooks.embed(F.col("t"), model, packing).alias("v")).collect()}
    assert got == {i: [float(len(t or "")), 1.0] for i, t in enumerate(texts)}
    calls = [[int(x) for x in p.read_text().split()] for p in tmp_path.glob("*.call")]
    assert sum(map(len, calls)) == len(texts)
    assert all(len(c) <= 8 and (len(c) <= 2 or len(c) * max(c) <= 400) for c in calls) and max(map(len, calls)) == 8


def test_a_failing_text_or_image_is_a_row(spark):
    def fields(title, body):
        if title == "bad":
            raise ValueError("no answer")
        return ["no dict"] if title == "list" else {"title": title.upper(), "key_points": [body], "other": 1}

    df = spark.createDataFrame([(1, "a", "x"), (2, "bad", "y"), (3, "list", "z"), (4, "b", None)], "id long, t string, b string")
    got = {r.id: r.x for r in df.select("id", hooks.extract(fields, hooks.Packing(threads=3), title=F.col("t"), body=F.col("b")).alias("x")).collect()}
    assert got[1].fields.title == "A" and got[1].fields.key_points == ["x"] and got[1].error is None and got[1].fields.summary is None
    assert got[2].fields is None and got[2].error == "ValueError: no answer" and got[3].error == "TypeError: the answer is of type list"
    assert got[4].fields.title == "B"

    def ocr(image):
        return [{"text": image.decode(), "conf": 0.5, "bbox": [[0.0, 1.0]]}]

    images = spark.createDataFrame([(1, bytearray(b"hi")), (2, bytearray(b"\xff"))], "id long, i binary")
    got = {r.id: r.x for r in images.select("id", hooks.read_image(F.col("i"), ocr).alias("x")).collect()}
    assert got[1].blocks[0].text == "hi" and got[2].blocks is None and got[2].error.startswith("UnicodeDecodeError")


def test_lines_of_texts_with_other_ends(spark):
    texts = ["", "a", "a\n", "\n\na", "a\r\nb\rc\n\rd", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h ", "\r\n\r\n", "a\x1fb\tc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.x for r in df.select("t", text.lines(F.col("t")).alias("x")).collect()}
    assert got == {t: re.split(text.LINES, t) for t in texts}


def test_texts_are_split_and_lowered_once(spark):
    """A row's words are found once, whatever is made of the hits; its beginning is lowered once for all phrases."""
    df = spark.createDataFrame([("x", "d")], "t string, domain string")
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan(articles.classify(articles.keyword_hits(F.col("t")))).count("split(") == 1
    assert plan(articles.evidence_level(F.col("domain"), F.col("t"))).count("lower(") == 1
