"""URL judging, hard negatives and importance resampling against plain Python, with nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trainlake.llm import hard_negatives, importance, url_filter

RULES = [url_filter.Rule.of(*r) for r in (("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False))]
PAGES = "page_id long, url string"


def judged(spark, rows, labels=(), rules=RULES, schema=PAGES):
    pages = spark.createDataFrame(list(rows), schema)
    marks = spark.createDataFrame(list(labels), "page_id long, bad int")
    return url_filter.judge(pages, url_filter.outcomes(pages, marks), url_filter.rules_table(spark, rules))


def test_urls_and_rules(spark):
    cases = {
        "http://WWW.Example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/"),
        "https://example.com/EN/": ("example.com", "/EN/", "com/"),
        "https://example.com": ("example.com", "", None),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/"),
        "x://a.net/fr/?x=/es/": ("a.net", "/fr/", "net/fr/"),
        "x://net/es/y#z": ("net", "/es/y", "net/es/"),
        "ftp://h?a/b": ("h", "", None),
        "a://b://c/d": ("b:", "//c/d", None),
        "no scheme/x": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "http://ÀB.org/ü/\nx": ("Àb.org", "/ü/\nx", None),
        "http://" + "a." * 300 + "com/" + "x" * 50_000: ("a." * 300 + "com", "/" + "x" * 50_000, "com/"),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(None, None), (3, "https://example.com"), (3, "https://example.com")]
    out = judged(spark, rows).collect()
    assert len(out) == len(rows)
    want = list(cases.values())
    for r in out:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule) == want[r.page_id]
        if r.rule is not None:
            assert r.verdict == {"com/": "allow", "www.example.com/en/": "allow"}.get(r.rule, "block") and r.judged_by == "rule"


def test_equal_length_takes_the_longer_host(spark):
    rules = [url_filter.Rule.of("b.org/xyz", True), url_filter.Rule.of("a.b.org/x", False)]
    (r,) = judged(spark, [(1, "http://a.b.org/xyz")], rules=rules).collect()
    assert (r.rule, r.verdict) == ("a.b.org/x", "block")


def _shrunk(counts):
    """Posterior mean and lower bound of every host from (n, k) by host, in plain Python."""

    def concentration(groups):
        over = sum((k - n * mu) ** 2 - n * mu * (1 - mu) for n, k, mu in groups)
        base = sum(n * (n - 1) * mu * (1 - mu) for n, k, mu in groups)
        rho = over / base if base else 0
        return min(10_000, max(1, 1 / rho - 1)) if rho > 0 else 10_000

    def level(of, parent):
        sums = defaultdict(lambda: [0, 0])
        for host, (n, k) in counts.items():
            sums[of(host)][0] += n
            sums[of(host)][1] += k
        rows = {g: (n, k, parent(g)) for g, (n, k) in sums.items()}
        s = concentration(rows.values())
        return {g: (s * mu + k, s * (1 - mu) + n - k) for g, (n, k, mu) in rows.items()}

    total = [sum(x) for x in zip(*counts.values(), strict=True)]
    domain = lambda h: ".".join(h.split(".")[-2:])
    mean = lambda ab: ab[0] / sum(ab)
    top = level(lambda h: h.split(".")[-1], lambda g: (total[1] + 0.5) / (total[0] + 1))
    mid = level(domain, lambda g: mean(top[g.split(".")[-1]]))
    low = level(lambda h: h, lambda g: mean(mid[domain(g)]))
    return {h: (mean(ab), mean(ab) - math.sqrt(mean(ab) * (1 - mean(ab)) / (sum(ab) + 1))) for h, ab in low.items()}


def test_reputation(spark):
    rng = random.Random(3)
    hosts = [f"{s}.{d}.{t}" for t in ("org", "de") for d in ("aa", "bb", "cc") for s in ("x", "y", "z")] + ["", "solo"]
    rates = {h: rng.choice([0.02, 0.3, 0.9]) for h in hosts}
    rows, labels, counts = [], [], {h: [0, 0] for h in hosts}
    for i in range(900):
        h = "x.aa.org" if i % 3 == 0 else rng.choice(hosts)
        rows.append((i, f"http://{h}/p{i}" if h else None))
        if rng.random() < 0.6:
            bad = int(rng.random() < rates[h])
            labels += [(i, bad)] * (1 + (i % 5 == 0)) + ([(i, None)] if i % 7 == 0 else [])
            counts[h][0] += 1
            counts[h][1] += bad
    want = _shrunk({h: c for h, c in counts.items() if any(h in (r[1] or "") if h else r[1] is None for r in rows)})
    out = judged(spark, rows, [*labels, (None, 1), (5000, 1)], rules=RULES).collect()
    assert len(out) == 900 and {r.verdict for r in out} == {"allow", "block"}
    for r in out:
        rate, bound = want[r.host]
        assert r.bad_rate == pytest.approx(rate) and r.bad_bound == pytest.approx(bound)
        assert r.verdict == ("block" if bound > url_filter.MAX_BAD else "allow") and r.n_labelled == counts[r.host][0]


def test_url_filter_edges(spark):
    assert judged(spark, []).count() == 0
    out = judged(spark, [(1, "http://a.org/", "mine", "r")], schema="page_id long, url string, note string, rule string").collect()
    assert out[0].note == "mine" and out[0].rule is None and out[0].verdict == "allow"
    pages = spark.createDataFrame([(1, "http://unseen.org/")], PAGES)
    none = spark.createDataFrame([], "url string, bad int")
    (r,) = url_filter.judge(pages, none, url_filter.rules_table(spark, [])).collect()
    assert (r.verdict, r.bad_bound) == ("allow", None)


@pytest.mark.parametrize("hot", [1, 2, 4, 1000])
def test_hot_hosts_meet_their_site_once(spark, hot):
    """No, one, a few and all hosts, domains and suffixes are hot: every row comes once and is judged alike."""
    hosts = ["a.x.com"] * 300 + ["b.x.com"] * 60 + [f"h{i}.d{i % 7}.{('com', 'org', 'net')[i % 3]}" for i in range(120)] + [""] * 20
    pages = spark.createDataFrame([(i, f"s://{h}/p" if h else None) for i, h in enumerate(hosts)] + [(None, "s://a.x.com/p")] * 3, PAGES)
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, len(hosts), 2)], "page_id long, bad int")
    out = url_filter.judge(pages, url_filter.outcomes(pages, marks), url_filter.rules_table(spark, RULES), hot=hot).collect()
    counts = defaultdict(lambda: [0, 0])
    for i, h in enumerate(hosts):
        counts[h][0] += i % 2 == 0
        counts[h][1] += i % 2 == 0 and i % 5 == 0
    want = _shrunk(counts)
    assert sorted(r.page_id for r in out if r.page_id is not None) == list(range(len(hosts))) and len(out) == len(hosts) + 3
    for r in out:
        rate, bound = want[r.host]
        assert (r.bad_rate, r.bad_bound) == pytest.approx((rate, bound))
        assert r.rule == ("com/" if r.host.endswith("com") else None) and (r.rule or r.verdict == ("block" if bound > url_filter.MAX_BAD else "allow"))


def test_double_suffixes(spark):
    d = spark.createDataFrame([("a.b.co.uk",), ("b.org",), ("org",), ("",)], "h string")
    from pyspark.sql import functions as F

    out = d.select(url_filter.registered_domain(F.col("h"), ["co.uk"]), url_filter.suffix(F.col("h"), ["co.uk"])).collect()
    assert [tuple(r) for r in out] == [("b.co.uk", "co.uk"), ("b.org", "org"), ("org", "org"), ("", "")]


VECTORS = "vec_id long, embedding array<float>, label int"


def mined(rows):
    """The contract in plain Python. rows: (vec_id, vector, label)."""
    rows = [(v, [math.floor(256 * x) for x in e], y) for v, e, y in rows if y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda sv: (-sv[0], sv[1] is None, sv[1] or 0)
    out = []
    for i, (a, e, y) in enumerate(rows):
        if a is None or a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(e, f)), v, z) for j, (v, f, z) in enumerate(rows) if j != i]
        for ps, pv, _ in sorted((s for s in scored if s[2] == y), key=key)[:5]:
            fit = sorted((s for s in scored if s[2] != y and 30 * ps <= 100 * s[0] <= 90 * ps), key=key)[:10]
            out += [(a, pv, r, v, ps, s) for r, (s, v, _) in enumerate(fit, 1)]
    return out


def check_mined(spark, rows, **how):
    got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, VECTORS), **how).collect()]
    assert Counter(got) == Counter(mined(rows))
    return got


def vectors(rng, n, dim=6, labels=3):
    return [(i, [float(np.float32(rng.gauss(0, 1) * rng.choice([0.1, 1]))) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("segment_rows,widths", [(7, (0.0,)), (16, (0.0, 0.05, 0.2)), (2048, ())])
def test_hard_negatives(spark, segment_rows, widths):
    rng = random.Random(5)
    rows = vectors(rng, 420)
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(90)]  # one vector of many rows, all ties
    rows += [(500, rows[0][1], 1), (500, rows[0][1], 1), (600, [0.0] * 6, 2), (None, rows[3][1], 0), (None, rows[3][1], 1)]
    rows += [(700, None, 1), (800, rows[1][1], None), (900, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1100, [math.nan] * 6, 0), (1200, [math.inf] + [0.0] * 5, 0)]
    assert check_mined(spark, rows, segment_rows=segment_rows, widths=widths, n_pivots=5)


def test_pruning_leaves_segments_out(spark):
    """Clusters far apart: the last round doesn't send every query to every segment, and nothing is lost."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        c = i % 6
        rows.append((i, [float(np.float32((8 if j == c else 0) + rng.gauss(0, 0.3))) for j in range(6)], rng.randrange(2)))
    seen = []
    visit = hard_negatives.Index._visit

    def counted(self, queries, bands, *a):
        out = visit(self, queries, bands, *a)
        seen.append(out)
        return out

    hard_negatives.Index._visit = counted
    try:
        assert check_mined(spark, rows, segment_rows=20, widths=(0.0, 0.02), n_pivots=6)
    finally:
        hard_negatives.Index._visit = visit
    assert len(seen) == 6


def test_hard_negatives_edges(spark):
    assert check_mined(spark, []) == []
    assert check_mined(spark, [(0, [1.0, 0.0], 1)]) == []
    assert check_mined(spark, [(100, [1.0, 2.0], 1), (2, [1.0], 1), (3, [0.25, 0.125], 2), (4, [], 2)])
    large = lambda f: [(0, [4.0 * f, 1.0], 1), (1, [4.0 * f, 2.0], 1), (2, [2.0 * f, 0.5], 2), (3, [1.5 * f, 7.0], 3)]
    assert check_mined(spark, large(2.0**16))  # scores over 2^53, still to the unit
    assert hard_negatives.mine(spark.createDataFrame(large(2.0**90), VECTORS)).count() == 0  # all are held at 2^55
    extra = spark.createDataFrame([(0, [1.0, 0.0], 1, 5), (1, [1.0, 0.1], 1, 6), (2, [0.5, 0.0], 2, 7)], VECTORS + ", segment int")
    assert [r.negative_id for r in hard_negatives.mine(extra).collect()] == [2]


def features_of(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def resampled(docs, target, percent=5):
    f = [features_of(t) for _, t in docs]
    s, t = sum((c for _, c in f), Counter()), sum((features_of(x)[1] for _, x in target), Counter())
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10_000) / ((s[b] + 1.0) * (T + 10_000))))
    rows = []
    for (d, _), (w, c) in zip(docs, f, strict=True):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in c.items())
        rows.append([d, sum(c.values()), len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[2] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[3]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return [tuple(r) for r in rows]


def some_docs(rng, n):
    w = ["Alpha", "beta", "GAMMA", "δέλτα", "e5", "zeta", "日本", "the", "the", "x" * 60]
    return [(i, " ".join(rng.choice(w) + rng.choice(["", ".", ", ", "\n"]) for _ in range(rng.choice([0, 3, 19, 20, 21, 60, 200])))) for i in range(n)]


@pytest.mark.parametrize("piece", [7, 50, 1 << 20])
def test_features_do_not_depend_on_pieces(piece):
    texts = ["", "a", "x" * 100 + " y " + "z" * 70, "hello World hello", "日本 語 abc " * 50, *[t for _, t in some_docs(random.Random(1), 60)]]
    got = [Counter() for _ in texts]
    for d, b, _ in importance.features([t.encode() for t in texts], piece=piece):
        for i, x in zip(d.tolist(), b.tolist(), strict=True):
            got[i][x] += 1
    assert got == [features_of(t)[1] for t in texts]


@pytest.mark.parametrize("block_postings", [300, 1 << 20])
def test_resampling(spark, block_postings):
    rng = random.Random(2)
    docs = some_docs(rng, 150)
    docs += [(7, docs[7][1]), (7, docs[7][1]), (8, "another text under a used id " * 9), (None, None), (None, "q r s " * 30), (900, ""), (901, "!? \x00"), (902, "hot " * 40_000)]
    docs += [(1000 + i, docs[5][1]) for i in range(80)]
    target = [(1, "beta zeta the e5"), (2, None), (3, "Beta Zeta the the 日本")]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(target, "item_id long, text string"), block_postings=block_postings).collect()
    assert Counter(tuple(r) for r in got) == Counter(resampled(docs, target))


def test_resampling_edges(spark):
    none_d, none_t = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(none_d, none_t).count() == 0
    docs = [(i, f"a b c {i} " * 12) for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "2 as slice", "3 as score")
    got = importance.resample(d, none_t, percent=10).collect()
    assert Counter(tuple(r) for r in got) == Counter(resampled(docs, [], 10)) and sum(r["rank"] is not None for r in got) == 3
