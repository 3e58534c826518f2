"""Plain-Python versions of the operators that have no SQL."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash


def spark_hash(*values):
    """xxhash64 of longs (Python ints), ints (in a tuple) and strings as Spark chains them; nulls are left out."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = struct.pack("<q", v) if isinstance(v, int) else struct.pack("<i", v[0]) if isinstance(v, tuple) else v.encode()
        h = xxhash.xxh64(data, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def permute(x, n, seed, rounds=6):
    a = max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
    b = max(1, -(-n // a))
    while True:
        left, right = x % a, x // a
        for k in range(rounds):
            if k % 2 == 0:
                left = (left + spark_hash(right, (seed,), (k,)) % a) % a
            else:
                right = (right + spark_hash(left, (seed,), (k,)) % b) % b
        x = right * a + left
        if x < n:
            return x


def sharding(rows, n_shards=16, seed=17):
    """rows: (doc_id, text). The columns of the query, as a sorted list."""
    keyed = []
    for d, t in rows:
        b = (t or "").encode()
        keyed.append((d, len(b) + 1, zlib.crc32(b), 42 if t is None else spark_hash(t)))
    low = lambda v: (v is not None, v)
    keyed.sort(key=lambda r: tuple(map(low, r)))
    out = []
    for i, (d, size, crc, _) in enumerate(keyed):
        p = permute(i, len(keyed), seed)
        out.append((d, size, crc, "rows", p % n_shards, p // n_shards, None, i))
    return out


def exponent(tokens, target=0.95, most=2.0):
    total = sum(tokens)
    p = [t / total for t in tokens]

    def weights(a):
        z = sum(x**a for x in p)
        return [x**a / z for x in p]

    diverse = lambda a: -sum(w * math.log(w) for w in weights(a)) >= target * math.log(len(p))
    too_often = lambda a: max(w / x for w, x in zip(weights(a), p, strict=True)) > most

    def largest(ok):
        if ok(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(24):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low

    repeats = largest(too_often)
    return max(largest(diverse), min(1.0, repeats + 2.0**-24) if repeats > 0 else 0.0)


def schedule(rows, seed=23, target=0.95, most=2.0, block_docs=4096):
    """rows: (doc_id, text, source). (doc_id, source, n_tokens, weight, copies, epoch, block, position) of every draw."""
    sources = defaultdict(list)
    for d, t, s in rows:
        sources[s].append((d, t, len((t or "").split())))
    tokens = {s: sum(r[2] for r in v) for s, v in sources.items()}
    live = {s: n for s, n in tokens.items() if n}
    total = sum(live.values())
    a = exponent(list(live.values()), target, most) if len(live) > 1 else 1.0
    z = sum((n / total) ** a for n in live.values())
    out = []
    for s, n in live.items():
        weight = round((n / total) ** a / z, 12)
        quota = min(math.floor(total * weight), math.floor(most * n))
        epochs, rest = divmod(quota, n)
        blocks = max(1, -(-len(sources[s]) // block_docs))
        key = lambda r, e: (spark_hash(spark_hash(r[0], r[1]), (seed,), e) % (1 << 64)) >> 2  # noqa: E731, B023
        drawn = [(r, e) for e in range(epochs) for r in sources[s]]
        last = sorted(sources[s], key=lambda r: key(r, epochs))  # noqa: B023
        held = 0
        for i, r in enumerate(last):
            ties = [x for x in last if key(x, epochs) == key(r, epochs)]
            upto = sum(x[2] for x in last[:i] if key(x, epochs) != key(r, epochs)) + sum(x[2] for x in ties)
            if not rest or upto > rest:
                break
            held += r[2]
            drawn.append((r, epochs))
        copies = Counter((r[0], r[1]) for r, _ in drawn)
        many = Counter((r[0], r[1]) for r in sources[s])
        places = defaultdict(list)
        for r, e in drawn:
            k = key(r, e)
            places[e, int(k / float(1 << 62) * blocks)].append((k, r))
        for (e, block), rs in places.items():
            for position, (_, r) in enumerate(sorted(rs, key=lambda x: x[0])):
                out.append((r[0], s, r[2], weight, copies[r[0], r[1]] // many[r[0], r[1]], e, block, position))
    return out


def grams(t):
    w = (t or "").split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def near_classes(rows, threshold=0.8):
    """rows: (doc_id, text). Lists of row numbers that chains of links join."""
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    g = [grams(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None or top(i) == top(j):
                continue
            both = sum((g[i] & g[j]).values())
            if rows[i][1] == rows[j][1] or both and both / (sum(g[i].values()) + sum(g[j].values()) - both) >= threshold:
                up[top(i)] = top(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[top(i)].append(i)
    return list(classes.values())


def posteriors(rows):
    """rows: (host, path, quality_logit, toxic_logit). For each (host_rate, path_rate, p_quality) without its own evidence."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    own = [round(sigmoid(q) * (1 - sigmoid(t)), 6) for _, _, q, t in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, p, _, _), x in zip(rows, own, strict=True):
        hosts[h].append(x)
        paths[h, p].append(x)
    mean = sum(own) / len(own)

    def weight(groups, parent, siblings):
        n = sum(len(v) for v in groups.values())
        within = sum(len(v) * parent(k) * (1 - parent(k)) for k, v in groups.items())
        around = sum(len(v) * (sum(v) / len(v) - parent(k)) ** 2 for k, v in groups.items())
        noise = sum(parent(k) * (1 - parent(k)) * (1 - 1 / siblings(k)) for k in groups)
        return max(min(within / n / max((around - noise) / n, 1e-9), 1e6), 1.0)

    host_mean = lambda h: sum(hosts[h]) / len(hosts[h])
    top = weight(hosts, lambda _: mean, lambda _: len(hosts))
    sub = weight(paths, lambda k: host_mean(k[0]), lambda k: sum(1 for x in paths if x[0] == k[0]))
    out = []
    for (h, p, q, t), x in zip(rows, own, strict=True):
        host = (sum(hosts[h]) - x + top * mean) / (len(hosts[h]) - 1 + top)
        path = (sum(paths[h, p]) - x + sub * host) / (len(paths[h, p]) - 1 + sub)
        out.append((host, path, sigmoid(q + logit(path) - logit(mean))))
    return out


def secret_candidates(text):
    """[(word_no, part_no, value)] of the secret scan, with the operator's patterns read by Python's re."""
    import re

    from trainlake.llm import secret_scan as s

    find = lambda p, x: re.search(p, x, re.ASCII)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]

    def behind(one, two):
        assigned = one[-1:] in ("=", ":") and one and (find(s.KEY_WORDS, one) or find(s.KEY_WORDS, two) or find(s.NAME + "$", one))
        return bool(assigned or find("^" + s.USER + "$", one))

    def bare(x):
        return re.sub(r"^\\?[\"'`]|\\+$", "", x) if find(r"^\\?[\"'`]", x) else re.sub(r"(?<![.,;:!?*#&\\])[.,;:!?*#&\\]+$", "", x)

    out = []
    for i, word in enumerate(words):
        one, two = words[i - 1] if i else "", words[i - 2] if i > 1 else ""
        n = len(word)
        if not (n >= s.MIN_LENGTH or n > s.MIN_ASSIGNED and ("=" in word or ":" in word) or n >= s.MIN_ASSIGNED and i and behind(one, two)):
            continue
        wide = []
        head = find(r"^[(\[{<]*(" + s.VALUE + ")", word)
        if behind(one, two):
            wide.append(bare(head[1] if head else ""))
        for m in re.finditer(f"(?=({s.NAME}{s.VALUE}))", word, re.ASCII):
            wide.append(bare(m[1][find("^" + s.NAME, m[1]).end() :]))
        for m in re.finditer(s.USER + r"[^\s/@]{%d,}(?=@)" % s.MIN_ASSIGNED, word, re.ASCII):
            wide.append(m[0][find("^" + s.USER, m[0]).end() :])
        found = [v for v in wide if len(v) >= s.MIN_ASSIGNED]
        cores = list(re.finditer(s.CORE, word, re.ASCII))
        for k, m in enumerate(cores):
            gap = word[cores[k - 1].end() if k else 0 : m.start()]
            near = re.sub(r"[\"'`\\(\[{>]+$", "", (cores[k - 1][0] if k else "") + gap)
            inside = k > 0 or (near and near[-1] in "=:")
            first = lambda v: (v, one if inside else two, near if inside else one)  # noqa: E731, B023
            enough = lambda c: len(c[0]) >= (s.MIN_ASSIGNED if behind(c[2], c[1]) or find(s.SELF, c[0]) else s.MIN_LENGTH)
            ps = re.split("(?<==)(?=[^=])", m[0])
            value = lambda j: ps[j].rstrip("=") if j < len(ps) - 1 else ps[j]  # noqa: E731, B023
            cut = [c for c in ((value(j), one, ps[j - 1]) if j else first(value(j)) for j in range(len(ps))) if enough(c)]
            found += [c[0] for c in (cut or [c for c in [first(m[0])] if enough(c)]) if c[0] not in wide]
        out += [(i, k, v) for k, v in enumerate(found)]
    return out
