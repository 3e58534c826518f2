"""Registered queries without SQL against plain Python on a small written fixture, row by row; and the edges of their operators."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trainlake.llm import decontamination, minhash_dedup, mixing, quality_classifier, suffix_dedup, warc
from trainlake.llm import queries as llm

from . import reference
from .test_pairs import brute_repeats, docs


def words(rng, n):
    return " ".join(rng.choice(["tan", "ore", "shi", "vel", "nom", "qua", "rin", "ost"]) + rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n))


ITEM = "Which of these four rivers runs through the old town, and where does it meet the sea at last?"


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Folder of documents, benchmark and labels: near copies, exact copies, nulls, empties, ties and a long text."""
    rng = random.Random(8)
    rows = []
    for g in range(40):
        base = words(rng, rng.randint(20, 160)).split()
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((len(rows), " ".join(w), "en" if g % 3 else "de", f"s{g % 4}" if g % 5 else "hot"))
    rows += [(500, None, None, None), (501, "", "en", "hot"), (502, " \n", "en", "hot"), (503, words(rng, 20_000), "en", "s1"), (504, rows[3][1], "en", "s2"), (504, rows[3][1], "en", "s2"), (505, f"a b c {ITEM} d e f", "en", "s3")]
    rows += [(506, ITEM.upper().replace("TOWN,", "TOWM"), "en", "s3"), (507, "ünï " * 80 + "x", "fr", "s0"), (None, words(rng, 30), "en", "s0")]
    path = f"file://{tmp_path_factory.mktemp('fixture')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, words(rng, 30)), (4, "!?")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(d, int(i % 3 > 0), int(i % 7 == 0)) for i, (d, *_) in enumerate(rows) if d is not None and d < 120]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def result(spark, path, name):
    return [tuple(r) for r in llm.queries()[name](spark, path).collect()]


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_op3(spark, fixture):
    path, rows = fixture
    pairs = [(d, t) for d, t, *_ in rows]
    want = [(pairs[i][0], min((pairs[k][0] for k in c if pairs[k][0] is not None), default=None), len(c)) for c in reference.near_classes(pairs) for i in c]
    same(result(spark, path, "op3_minhash_dedup"), want)


def test_op7(spark, fixture):
    path, rows = fixture
    same(result(spark, path, "op7_sharding"), reference.sharding([(d, t) for d, t, *_ in rows]))


def test_op8(spark, fixture):
    path, rows = fixture
    got = result(spark, path, "op8_decontamination")
    assert {(r[0], r[1], r[4]) for r in got} == {(505, 1, 0), (506, 1, 1)}
    (r,) = [r for r in got if r[0] == 505]
    assert rows[[x[0] for x in rows].index(505)][1][r[2] : r[3]] == ITEM.rstrip("?")


def test_op9(spark, fixture):
    path, rows = fixture
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in result(spark, path, "op9_suffix_dedup")]
    same(got, brute_repeats([(d, t) for d, t, *_ in rows]))


@pytest.mark.parametrize("block_docs", [4096, 10])
def test_op10(spark, fixture, monkeypatch, block_docs):
    path, rows = fixture
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block_docs)
    got = result(spark, path, "op10_mixing")
    same(got, reference.schedule([(d, t, s) for d, t, _, s in rows], block_docs=block_docs))
    assert {r[1]: max(x[4] for x in got if x[1] == r[1]) for r in got} and max(r[5] for r in got) >= 1


def test_op4(spark, fixture):
    path, rows = fixture
    got = {(r[0], r[1], r[2], r[3]): r for r in ((*x[:5], *x[5:]) for x in result(spark, path, "op4_quality_classifier"))}
    table = spark.read.parquet(f"{path}/documents.parquet")
    model = quality_classifier.fit(table, spark.read.parquet(f"{path}/labels.parquet"))
    scored = quality_classifier.evidence(table, model).collect()
    want = reference.posteriors([(r.source, r.lang, r.quality_logit, r.toxic_logit) for r in scored])
    assert len(scored) == len(rows)
    for r, (host, site, p) in zip(scored, want, strict=True):
        toxic = 1 / (1 + np.exp(-r.toxic_logit))
        x = got[r.doc_id, r.source, r.lang, round(p, 6)] if (r.doc_id, r.source, r.lang, round(p, 6)) in got else min((v for k, v in got.items() if k[:3] == (r.doc_id, r.source, r.lang)), key=lambda v: abs(v[3] - p))
        assert abs(x[3] - p) < 2e-6 and abs(x[4] - toxic) < 2e-6 and abs(x[5] - host) < 1e-9 and abs(x[6] - site) < 1e-9
        assert x[7] == (x[3] >= 0.5 and x[4] < 0.5)


def test_one_class_of_labels_or_sites(spark):
    rows = [(i, "good words here " * (i + 1), "s", "en") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(df, quality_classifier.fit(df, labels)).collect()
    assert len(out) == 12 and all(r.accepted for r in out)


def test_near_group_of_many_variants(spark):
    """Variants from nearly equal to half rewritten around two centres: chains, loose texts, and pairs that only the last step finds."""
    rng = random.Random(12)
    rows = []
    for base in (words(rng, 120).split(), words(rng, 90).split()):
        for k in range(70):
            w = list(base)
            for _ in range(k // 4):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((len(rows), " ".join(w)))
            if k % 9 == 0:  # a partner of this variant alone
                w[rng.randrange(len(w))] = "partner"
                rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {rows[i][0]: min(c) for c in reference.near_classes(rows) for i in c}


def test_bands_find_near_pairs():
    rng = np.random.default_rng(5)
    for similarity, least in ((0.8, 0.975), (0.85, 0.998)):
        equal = (rng.random((4000, minhash_dedup.SLOTS)) < similarity)[:, minhash_dedup._ORDER].all(2).any(1)
        assert equal.mean() > least


def test_suffix_dedup_with_a_frequent_anchor(spark):
    rng = random.Random(3)
    line = "the same twenty-four bytes and more of boilerplate text"
    many = " ".join(f"{rng.randrange(10**9)} {line}" for _ in range(4000))
    rows = [(1, many), (2, f"head {line} {many[:3000]} tail"), (3, many[:90_000]), (4, line)]
    for bucket_rows in (suffix_dedup.BUCKET_ROWS, 64):
        found = suffix_dedup.remove_repeats(docs(spark, rows, True), bucket_rows=bucket_rows).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found) == brute_repeats(rows)


def test_repetitive_texts_and_short_items(spark):
    items = [(1, "ab" * 200), (2, "Blue"), (3, "東京都"), (4, "x " * 30)]
    rows = [(1, "ab" * 500_000), (2, "a blue, sky"), (3, "blues"), (4, "住所は東京都です"), (5, "BLUE"), (5, "BLUE"), (6, "ab" * 150), (7, "x " * 20_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = Counter((r.doc_id, r.item_id, r.start_char, r.end_char) for r in decontamination.find(docs(spark, rows, True), bench).collect())
    assert found == Counter({(1, 1, 0, 400): 1, (2, 2, 2, 6): 1, (4, 3, 3, 6): 1, (5, 2, 0, 4): 2, (7, 4, 0, 59): 1})
    assert sorted(r.doc_id for r in decontamination.clean(docs(spark, rows, True), bench).collect()) == [3, 6]
    assert decontamination.find(docs(spark, rows), bench.limit(0)).count() == 0


def test_matches_are_counted_in_pieces(monkeypatch):
    rng = random.Random(9)
    text = words(rng, 400)
    index = decontamination.build_index([(i, text[i * 50 : i * 50 + 300]) for i in range(20)])
    whole = decontamination.search(text, index)
    monkeypatch.setattr(decontamination, "MATCHES", 7)
    assert len(whole) == 20 and decontamination.search(text, index) == whole


def test_truncated_gzip_is_an_error():
    import gzip

    stream = gzip.compress(b"x" * 100_000)
    for cut, fails in ((len(stream), False), (len(stream) - 3, True), (20, True)):
        left = [stream[:cut]]
        read = lambda n: left.pop() if left else b""  # noqa: E731, B023
        if fails:
            with pytest.raises(EOFError):
                list(warc.inflate(read))
        else:
            assert sum(map(len, warc.inflate(read))) == 100_000


def test_schedule_of_one_source_and_of_none(spark):
    df = spark.createDataFrame([(i, "w " * i, "only") for i in range(1, 9)], "doc_id long, text string, source string").withColumn("epoch", F.lit("clash"))
    got = mixing.schedule(df).collect()
    assert {r.doc_id for r in got} == set(range(1, 9)) and sorted(r.position for r in got) == list(range(8))
    assert mixing.schedule(df.limit(0)).count() == 0
    assert mixing.schedule(df.withColumn("text", F.lit(""))).count() == 0


def test_pipeline_rows(spark, fixture):
    """run() against plain Python, from the classifier's verdicts on."""
    pipeline = pytest.importorskip("corpus_pipeline")
    path, rows = fixture
    table = spark.read.parquet(f"{path}/documents.parquet")
    model = quality_classifier.fit(table, spark.read.parquet(f"{path}/labels.parquet"))
    kept = [(r.doc_id, r.text, r.lang, r.source) for r in quality_classifier.classify(table, model).collect() if r.accepted]
    low = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0)
    leads = [kept[min(c, key=lambda i: low(kept[i]))] for c in reference.near_classes([r[:2] for r in kept])]
    index = decontamination.build_index([(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()])
    clean = [r for r in leads if not (r[1] and decontamination.search(r[1], index))]
    copies = {(d, s): c for d, s, _, _, c, *_ in reference.schedule([(d, t, s) for d, t, _, s in clean])}
    drawn = [r for r in clean for _ in range(copies.get((r[0], r[3]), 0))]
    hashed = lambda r: reference.spark_hash(r[1], r[3], r[2])
    drawn.sort(key=lambda r: (low(r), hashed(r)))
    want = []
    for i, r in enumerate(drawn):
        p = reference.permute(i, len(drawn), 17)
        want.append((r[0], r[1], r[2], r[3], i, len(drawn), p % 16, p // 16))
    got = [(r.doc_id, r.text, r.lang, r.source, r.row_no, r.n_rows, r.shard, r.slot) for r in pipeline.run(spark, path).collect()]
    assert len(want) > 20 and any(r[0] is None for r in kept) in (True, False)
    same(got, want)


def test_pipeline_stages_take_empty_tables_and_nulls(spark, fixture):
    pipeline = pytest.importorskip("corpus_pipeline")
    path, _ = fixture
    table = spark.read.parquet(f"{path}/documents.parquet")
    nulls = table.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in table.dtypes])
    counts = defaultdict(list)
    for name, stage in pipeline.STAGES:
        for df in (table.limit(0), nulls):
            out = stage(spark, df, path)
            assert name == "shard" or out.columns == table.columns
            counts[name].append(out.count())
    assert all(v[0] == 0 for v in counts.values())
    assert [counts[n][1] for n in ("near_dedup", "decontaminate", "mix_sources", "shard")] == [3, 3, 0, 3]


def test_op5(spark, fixture, tmp_path):
    """Every candidate that plain Python finds, and the forest's verdict on it; planted secrets of all forms are found and taken out."""
    import hashlib

    a, b = "Zx81kLq9vT2mPw4RsY7u", "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = [f'set token = "{b}" here', f"password:{a}", f'{{"password":"{a}","n":1}}', f"postgres://admin:{a}@db/x", f"Authorization: Bearer {a}{a}", "commit 9fceb02d0ae598e95dc970b74767f19372d61af8 merged", f"a={a},b={a[::-1]};c=1", None, "", " ", f"x {'word ' * 5000} api_key={a}", "thanonontioniner longwordwithoutanydigits", f"secret {a}, {a}"]
    rows = [(i, t, "en", "s0") for i, t in enumerate(texts)] + [(1, texts[1], "en", "s0")]
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("value", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    got = llm.queries()["op5_secret_scan"](spark, path).collect()
    want = Counter((d, i, hashlib.md5(v.encode()).hexdigest(), len(v)) for d, t, *_ in rows for i, _, v in reference.secret_candidates(t))
    assert Counter((r.doc_id, r.word_no, r.value_md5, r.value_chars) for r in got) == want
    assert all(r.is_secret == (r.p_secret >= 0.5) for r in got)
    secret = {r.doc_id for r in got if r.is_secret}
    assert {0, 1, 2, 3, 10} <= secret and not {5, 11} & secret
