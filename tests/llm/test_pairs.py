"""Near-dedup, suffix dedup, line dedup and decontamination against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from trainlake.llm import decontamination, line_dedup, minhash_dedup, suffix_dedup

DOC = "doc_id long, text string"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOC).repartition(3)
    if extra:  # columns that clash with outputs and internal names
        for c in ("n_lines", "kept", "digest", "label", "class_id", "_tl_doc"):
            df = df.selectExpr("*", f"'x' as {c}")
    return df


def grams(t):
    w = (t or "").split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute_classes(rows):
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    g = [grams(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            both = sum((g[i] & g[j]).values())
            if rows[i][1] == rows[j][1] or both and both / (sum(g[i].values()) + sum(g[j].values()) - both) >= 0.8:
                up[top(i)] = top(j)
    classes = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        classes[top(i)].append(d)
    return {d: min(v) for v in classes.values() for d in v}


def near_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 250))]
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 50))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    return rows + [(1000 + i, t) for i, t in enumerate(["", " ", "", "a b", "a b", "c " * 500, "c " * 510, None, None])]


def test_near_classes(spark):
    rows = near_rows()
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs(spark, rows, True)).collect()}
    assert got == brute_classes(rows)


def test_keep_one(spark):
    rows = near_rows()
    kept = minhash_dedup.keep_one(docs(spark, rows, True))
    assert kept.columns[:2] == ["doc_id", "text"] and "digest" in kept.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(rows).values()))


def test_near_empty(spark):
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_signature_agreement_is_weighted_jaccard():
    a = np.repeat(np.arange(1, 200, dtype=np.uint64) * np.uint64(7919), np.arange(1, 200) % 5 + 1)
    b = np.concatenate([a[60:], np.arange(1, 90, dtype=np.uint64) * np.uint64(104729)])
    want = minhash_dedup.similarity(minhash_dedup.bag(a), minhash_dedup.bag(b))
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    assert abs(want - sum((ca & cb).values()) / sum((ca | cb).values())) < 1e-12
    got = np.mean(minhash_dedup.bag_minhash(a, 4096) == minhash_dedup.bag_minhash(b, 4096))
    assert abs(got - want) < 0.04


def brute_repeats(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1 if d is not None else 0):
            first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((-1 if d is None else d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def repeat_rows():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ab cdé\n") for _ in range(n))
    parts = [text(rng.randint(30, 200)) for _ in range(12)]
    rows = [(i if i % 17 else i // 2, "".join(rng.choice(parts) if rng.random() < 0.6 else text(rng.randint(0, 60)) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    return rows + [(200, None), (201, ""), (None, parts[0] + parts[1]), (202, "a" * 900), (203, "a" * 100 + "b" + "a" * 49), (204, "a" * 900), (204, "a" * 900), (205, "ab" * 300), (206, "ba" * 300)]


@pytest.mark.parametrize("bucket_rows", [10_000, 3])
def test_suffix_dedup(spark, bucket_rows):
    rows = repeat_rows()
    found = suffix_dedup.remove_repeats(docs(spark, rows), bucket_rows=bucket_rows).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found)
    assert got == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_order_survives_hash_collisions():
    raw = np.frombuffer(b"".join(bytes([97 + (i * 7 + j) % 3 for j in range(60)]) for i in range(40)), np.uint8)
    place, group = np.arange(0, len(raw) - 50, 5), np.arange(0, len(raw) - 50, 5) % 2
    s = suffix_dedup._Suffixes(raw, place, 50)
    want = sorted(range(len(place)), key=lambda i: (group[i], raw[place[i] : place[i] + 50].tobytes()))
    key = lambda i: (group[i], raw[place[i] : place[i] + 50].tobytes())
    assert [key(i) for i in s.sort(group)] == [key(i) for i in want]
    s.hash = np.zeros_like(s.hash)  # every hash collides
    assert [key(i) for i in s.sort(group)] == [key(i) for i in want]


def brute_lines(rows, run=3):
    seen, gone = {}, defaultdict(set)
    nonblank = {}
    for d, t in sorted((r for r in set(rows) if r[0] is not None and r[1] is not None)):
        ls = [(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()]
        nonblank[d] = ls
        for k in range(len(ls) - run + 1):
            key = tuple(x for _, x in ls[k : k + run])
            if key in seen:
                gone[d].update(i for i, _ in ls[k : k + run])
            seen.setdefault(key, (d, k))
    out = {}
    for d, t in rows:
        if t is None or d is None:
            out[d] = (0 if t is None else sum(1 for x in t.split("\n") if x.strip()), 0, t)
        else:
            out[d] = (len(nonblank[d]), len(gone[d]), "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [f"line {i}" for i in range(30)]
    rows = []
    for d in range(60):
        ls = []
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(26)
            ls += pool[k : k + rng.randint(1, 5)] if rng.random() < 0.5 else [f"own {rng.random()}", "", "  " + rng.choice(pool) + " "]
        rows.append((d, "\n".join(ls)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a\n" * 9), (104, "a\n" * 9), (None, rows[3][1])]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.remove_repeated_lines(docs(spark, rows, True), short_bytes=None).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_repeated_rows_and_empty(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc")]
    got = sorted((r.doc_id, r.n_removed) for r in line_dedup.remove_repeated_lines(docs(spark, rows), short_bytes=None).collect())
    assert got == [(1, 0), (1, 0), (2, 3)]
    assert line_dedup.remove_repeated_lines(docs(spark, [])).count() == 0


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, "Ünïcode résumé of a benchmark passage, with punctuation; and length"), (3, "short"), (4, None), (5, "")]


def test_decontamination(spark):
    item = ITEMS[0][1]
    rows = [
        (1, "before. " + item + " after"),
        (2, "THE QUICK   brown fox, jumps over the lazy dog: near the river bank!"),
        (3, item.replace("lazy", "lozy")),
        (4, item.replace("brown fox", "red wolf").replace("lazy dog", "old cat")),
        (5, "nothing of the kind " * 20),
        (6, None),
        (7, ""),
        (8, "x" * 50_000 + " " + ITEMS[1][1] + " " + "y" * 50_000),
    ]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.find(docs(spark, rows), bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 1), (8, 2)}
    assert found[1, 1].n_edits == 0 and rows[0][1][found[1, 1].start_char : found[1, 1].end_char] == item and found[3, 1].n_edits == 1
    blocks = {(r.doc_id, r.item_id) for r in decontamination.find(docs(spark, rows), bench, block_chars=70).collect()}
    assert blocks == set(found)
    assert sorted(r.doc_id for r in decontamination.clean(docs(spark, rows), bench).collect()) == [4, 5, 6, 7]
    assert decontamination.find(docs(spark, []), bench).count() == 0


def edit_distance_inside(item, text):
    """Least edits between item and any part of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_edit_distance():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 30)))) for i in range(6)]
    index = decontamination.build_index(items)
    for _ in range(60):
        i, t = rng.choice(items)
        t = list(t)
        for _ in range(rng.randint(0, 9)):
            p = rng.randrange(len(t))
            op = rng.random()
            t[p : p + 1] = [] if op < 0.3 else [t[p], rng.choice("abcdefgh")] if op < 0.6 else [rng.choice("abcdefgh")]
        text = " ".join(word() for _ in range(10)) + " " + "".join(t) + " " + " ".join(word() for _ in range(10))
        code = "".join(map(chr, decontamination.normalise(text)[0]))
        found = {h[0]: h[3] for h in decontamination.search(text, index)}
        for k, (item_id, item) in enumerate(items):
            least = edit_distance_inside(item, code)
            assert (item_id in found) == (least <= index.budgets[k]), (least, index.budgets[k], found)
            if item_id in found:
                assert found[item_id] == least


def test_near_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (5, long), (None, "other words here"), (7, long + " tail"), (7, long + " tail")]
    got = sorted(((r.doc_id, r.class_size) for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 4), (5, 4), (None, 1), (7, 4), (7, 4)], key=str)
    assert minhash_dedup.keep_one(docs(spark, rows)).count() == 2


def moved_records(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_suffix_dedup_moves_packed_rows(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    parts = [text(400) for _ in range(40)]
    rows = [(i, text(200) + rng.choice(parts) + text(2000) + rng.choice(parts) + text(200)) for i in range(120)]
    before = moved_records(spark)
    found = suffix_dedup.remove_repeats(docs(spark, rows)).collect()
    moved = moved_records(spark) - before
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found) == brute_repeats(rows)
    assert moved < 20 * len(rows)  # there are 24,000 anchors


def test_suffix_dedup_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1500)
    rows = repeat_rows()
    found = suffix_dedup.remove_repeats(docs(spark, rows), bucket_rows=3).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found) == brute_repeats(rows)


def test_suffix_dedup_without_repeats(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcdefghij") for _ in range(300))) for i in range(9)]
    found = suffix_dedup.remove_repeats(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept.decode()) for r in found) == [(i, 0, t) for i, t in rows]


@pytest.mark.parametrize("length", [25, 50, 84])
def test_later_strings(length):
    rng = random.Random(length)
    anchor, segments = b"x" * suffix_dedup.GRAM, []
    reach = length - suffix_dedup.GRAM
    for i in range(300):
        at, behind = rng.randint(0, reach), rng.randint(0, reach)
        behind = max(behind, reach - at)
        side = lambda n: bytes(rng.choice(b"ab") if rng.random() < 0.1 else 97 for _ in range(n))
        segments.append((i % 3, at, side(at) + anchor + side(behind), rng.randint(0, 40)))
    first, want = {}, []
    for bucket, at, seg, doc in segments:
        for j in range(len(seg) - length + 1):
            key = bucket, at - j, seg[j : j + length]
            first[key] = min(doc, first.get(key, doc))
    for bucket, at, seg, doc in segments:
        want.append(sum(1 << j for j in range(len(seg) - length + 1) if at >= j and first[bucket, at - j, seg[j : j + length]] < doc))
    col = lambda k, kind=np.int64: np.array([s[k] for s in segments], kind)
    raw, size = np.frombuffer(b"".join(s[2] for s in segments), np.uint8), np.array([len(s[2]) for s in segments])
    assert suffix_dedup.later_strings(raw, size, col(0), col(1), col(3), length).tolist() == want
