"""Near-duplicate documents by BagMinHash: weighted-Jaccard signatures over the multiset of five-word shingles, banding, and
verification on the shingles themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, materialize
from .components import components
from .textcore import U, mix, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
#: Bands take their rows from SLOTS values in four orders, so that each value serves in four bands. Measured over random
#: signatures, a pair of similarity 0.8 shares a band with probability 0.99, one of 0.85 with 0.9998 and one of 0.6 with 0.16.
SLOTS, ROWS, STRIDES = 252, 12, (1, 5, 11, 13)
BANDS = SLOTS // ROWS * len(STRIDES)
_ORDER = np.concatenate([(np.arange(SLOTS) * k % SLOTS).reshape(-1, ROWS) for k in STRIDES])
#: Rounds in which buckets are held against one text before the pairs that are left are compared; results don't depend on it.
CENTRES = 2
#: Elements that at most so many of the texts left hold are rare: texts that share one meet at it, others in buckets.
RARE = 16
CACHE_BYTES = 64 << 20


def _processes(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, rate and share of every Poisson process of a bag. Weight levels are split into (0,1], (1,2], (2,4], (4,8] ...;
    a weight takes all points of the intervals below it, and of the interval it ends in those at levels up to it."""
    element, weight = np.unique(shingles, return_counts=True)
    seeds, rates, shares = [mix(element ^ U(0xA5A5A5A5A5A5A5A5))], [np.ones(len(element))], [np.ones(len(element))]
    k = 1
    while (more := weight > (low := 1 << (k - 1))).any():
        element, weight = element[more], weight[more]
        seeds.append(mix(element + U(k * 0xD1342543DE82EF95 % (1 << 64))))
        rates.append(np.full(len(element), float(low)))
        shares.append(np.minimum((weight - low) / low, 1.0))
        k += 1
    return np.concatenate(seeds), np.concatenate(rates), np.concatenate(shares)


def bag_minhash(shingles: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """m values; two bags agree in each with probability equal to their weighted Jaccard similarity. Points of all processes
    are made in order of time up to a horizon that fills all m slots with high probability, and the horizon is doubled if it
    does not; the earliest point in a slot gives its value."""
    seed, rate, share = _processes(shingles)
    horizon = m * (np.log(m) + 3) / len(shingles)
    while True:
        times, values = [], []
        s, r, f, t, j = seed, rate, share, np.zeros(len(seed)), 0
        step = max(4, int(horizon))
        while len(s):
            draws = mix(s[:, None] + np.arange(j + 1, j + step + 1, dtype=np.uint64)[None, :] * U(0x9E3779B97F4A7C15))
            at = t[:, None] + np.cumsum(-np.log1p(-((draws >> U(11)).astype(float) / (1 << 53))), axis=1) / r[:, None]
            v = mix(draws ^ U(0x5851F42D4C957F2D))
            keep = at < horizon
            if (f < 1).any():
                keep &= ((mix(v ^ U(0x14057B7EF767814F)) >> U(11)).astype(float) / (1 << 53)) < f[:, None]
            times.append(at[keep])
            values.append(v[keep])
            on = at[:, -1] < horizon
            s, r, f, t, j = s[on], r[on], f[on], at[on, -1], j + step
        time, value = np.concatenate(times), np.concatenate(values)
        slot = (value % U(m)).astype(np.int64)
        out, filled = np.zeros(m, np.uint64), np.zeros(m, bool)
        order = np.argsort(-time, kind="stable")
        out[slot[order]] = value[order]
        filled[slot] = True
        if filled.all():
            return out
        horizon *= 2


def band_keys(signature: np.ndarray) -> np.ndarray:
    s = signature[_ORDER]
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F)
    for i in range(ROWS):
        h = mix(h * U(3) + s[:, i])
    return h.view(np.int64)


def bag(shingles: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the i-th occurrence of a shingle is an element of its own, so that Jaccard similarity of
    these sets is weighted Jaccard similarity of the multisets."""
    h = np.sort(shingles)
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    return np.sort(np.where(nth == 0, h, mix(h + nth.astype(np.uint64) * U(0xD1342543DE82EF95))).view(np.int64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = np.count_nonzero(a[at] == b)
    return both / (len(a) + len(b) - both)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n (shingles) and bands of every row with a text; equal texts of a batch are signed once."""

    def sign(batches):
        for b in batches:
            n, bands, known = [], [], {}
            for text, digest in zip(b.column("text"), b.column("digest").to_pylist(), strict=True):
                if digest not in known:
                    h = shingle_hashes(text.as_buffer().to_pybytes(), WORDS)
                    known[digest] = (len(h), band_keys(bag_minhash(h)) if len(h) else np.empty(0, np.int64))
                n.append(known[digest][0])
                bands.append(known[digest][1])
            offsets = np.cumsum([0, *map(len, bands)], dtype=np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*bands, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(n, pa.int64()), flat], ["doc_id", "digest", "n", "bands"])

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")
    return map_batches(rows, sign, "doc_id long, digest binary, n long, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and sim, the weighted Jaccard similarity of their bags of shingles, for pairs (a, b) of nodes. Texts are sent rather
    than bags, since they are shorter and compress; a task keeps CACHE_BYTES of bags at most."""

    def compare(batches):
        known: dict[int, np.ndarray] = {}
        held = 0

        def bag_of(node: int, text) -> np.ndarray:
            nonlocal held
            if node not in known:
                made = bag(shingle_hashes(text.as_buffer().to_pybytes(), WORDS))
                if held + made.nbytes > CACHE_BYTES:
                    known.clear()
                    held = 0
                known[node] = made
                held += made.nbytes
                return made
            return known[node]

        for b in batches:
            sim = [similarity(bag_of(x, s), bag_of(y, t)) for x, y, s, t in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("s"), b.column("t"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")
    return map_batches(both.select("a", "b", "s", "t"), compare, "a long, b long, sim double")


def shared_elements(nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n, common, frequent) and (node, e). common counts the elements of a node's bag that the bag of another of these
    nodes holds too, frequent those that more than RARE of them hold; the second table has the elements of 2 to RARE holders.
    Two bags have no more in common than the smaller common number, and without a rare element no more than the smaller
    frequent number."""

    def elements(batches):
        for b in batches:
            bags = [bag(shingle_hashes(t.as_buffer().to_pybytes(), WORDS)) for t in b.column("text")]
            who = np.repeat(b.column("node").to_numpy(), [len(x) for x in bags])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(np.concatenate([*bags, np.empty(0, np.int64)]))], ["node", "e"])

    each = map_batches(texts.join(nodes, "node", "left_semi").select("node", "text"), elements, "node long, e long")
    few = each.groupBy("e").agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("one")).where(F.col("holders") <= RARE)
    few = materialize(few, "near-few")
    rare = materialize(each.join(few.where("holders > 1").select("e"), "e").select("node", "e"), "near-rare")
    own = few.where("holders = 1").groupBy(F.col("one").alias("node")).agg(F.count(F.lit(1)).alias("own"))
    seldom = rare.groupBy("node").agg(F.count(F.lit(1)).alias("seldom"))
    out = nodes.join(own, "node", "left").join(seldom, "node", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0)))
    return out.select("node", "n", "common", (F.col("common") - F.coalesce("seldom", F.lit(0))).alias("frequent")), rare


def _close(a: str, b: str, threshold: float):
    """Sizes that allow the similarity: |A| / |B| >= threshold."""
    return F.least(F.col(a), F.col(b)) >= F.lit(threshold) * F.greatest(F.col(a), F.col(b))


def _reach(common: Column, sizes: Column, threshold: float) -> Column:
    """Whether `common` equal elements allow the similarity for bags of `sizes` elements together."""
    return common * F.lit(1 + threshold) >= F.lit(threshold) * sizes - 1e-6


def _ends(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _meeting(rare: DataFrame, side: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) in different components that share a rare element and that sizes and shared elements allow; an element has
    RARE holders at most, so it gives few pairs."""
    end = lambda x: side.select(*[F.col(c).alias(f"{x}{c}") for c in ("node", "n", "common", "label")])
    held = rare.join(side.select("node"), "node", "left_semi")
    pairs = held.select("e", F.col("node").alias("anode")).join(held.select("e", F.col("node").alias("bnode")), "e").where("anode < bnode").select("anode", "bnode").distinct()
    pairs = pairs.join(end("a"), "anode").join(end("b"), "bnode").where("alabel <> blabel").where(_close("an", "bn", threshold))
    return pairs.where(_reach(F.least("acommon", "bcommon"), F.col("an") + F.col("bn"), threshold)).select(F.col("anode").alias("a"), F.col("bnode").alias("b"))


def _links(nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs of different texts, enough to join all texts that links join.

    In each bucket of equal band keys every text is held against one centre, the text with most company in its buckets; so
    large groups of near copies cost one comparison a text. Where that leaves a bucket in several components, exact bounds rule
    pairs out before any text moves: sizes; the elements that a bag shares with any other bag left (a text of many changes of
    its own has too few for any partner, and leaves by itself); and the triangle inequality of Jaccard distances around the
    centre. Texts that share a rare element meet there, a few at each; so in the buckets only those are left that have enough
    frequent elements in common. Another centre is taken among the texts still apart from the first, and in the end all pairs
    between components that the bounds allow are compared."""
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
    crowd = materialize(members.join(sizes, "key"), "near-members")
    rank = materialize(crowd.groupBy("node").agg(F.sum("size").alias("company"), F.first("n").alias("n")), "near-rank")
    crowd = crowd.join(rank.select("node", "company"), "node").select("key", "node", "n", "company", F.col("node").alias("label"), F.lit(-1).cast("long").alias("main"), F.col("n").alias("common"), F.lit(False).alias("turned"))
    crowd = materialize(crowd, "near-crowd")
    # texts of the nodes that have company, fetched once
    wanted = nodes.join(rank.select("node"), "node", "left_semi").select("node", F.col("doc_id").alias("d"), F.col("digest").alias("g"))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")
    texts = rows.join(wanted, F.col("digest").eqNullSafe(F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")
    texts = materialize(texts.dropDuplicates(["node"]), "near-texts")

    known = labels = meeting = None
    for turn in range(CENTRES):
        centres = crowd.where("label <> main and not turned").groupBy("key").agg(F.max(F.struct("company", "node", "n", "label", "common")).alias("c"))
        centres = materialize(centres.select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"), F.col("c.label").alias("cl"), F.col("c.common").alias("cc")), "near-centres")
        beside = crowd.join(centres, "key").where("label <> cl").where(_close("n", "cn", threshold)).where(_reach(F.least("common", "cc"), F.col("n") + F.col("cn"), threshold))
        pairs = _ends(beside, "node", "centre")
        if turn:
            pairs = pairs.union(meeting).distinct().join(known, ["a", "b"], "left_anti")
        found = materialize(similarities(materialize(pairs, "near-pairs"), texts), "near-found")
        known = found if known is None else known.union(found)
        labels = components(known.where(F.col("sim") >= threshold))
        named = lambda df, node, out: df.drop(out).join(labels.select(F.col("node").alias(node), F.col("label").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))  # noqa: E731, B023
        if turn == 0:  # only buckets in several components matter further
            crowd = crowd.join(centres.select("key", F.col("centre").alias("first")), "key")
            crowd = materialize(named(named(crowd, "node", "label"), "first", "main"), "near-labelled")
            crowd = crowd.join(crowd.where("label <> main").select("key").distinct(), "key", "left_semi")
            near = F.when(F.col("node") == F.col("first"), 1.0).otherwise(F.col("sim"))
            crowd = crowd.withColumn("a", F.least("node", "first")).withColumn("b", F.greatest("node", "first")).join(known, ["a", "b"], "left")
            crowd = materialize(crowd.withColumn("near", near).drop("a", "b", "sim", "common"), "near-mixed")
            counts, rare = shared_elements(crowd.select("node", "n").distinct(), texts)
            counts = materialize(counts, "near-counts")
            side = counts.where(_reach(F.col("common"), F.col("n") * (1 + threshold), threshold)).join(crowd.select("node", "label").distinct(), "node")
            meeting = _meeting(rare, side, threshold)
            crowd = crowd.join(counts.select("node", F.col("frequent").alias("common")), "node").where(_reach(F.col("common"), F.col("n") * (1 + threshold), threshold))
            crowd = materialize(crowd.withColumn("turned", F.col("node") == F.col("first")), "near-left")
        else:
            crowd = crowd.join(centres.select("key", F.col("centre").alias("now")), "key", "left").withColumn("turned", F.col("turned") | F.coalesce(F.col("node") == F.col("now"), F.lit(False))).drop("now")
            crowd = materialize(named(named(crowd, "node", "label"), "first", "main"), "near-left")
    loose = crowd.where("label <> main").select("key", F.col("node").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"), F.col("common").alias("ac"), F.col("near").alias("as"))
    others = crowd.select("key", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("label").alias("bl"), F.col("common").alias("bc"), F.col("near").alias("bs"), "main")
    apart = F.coalesce(F.abs(F.col("as") - F.col("bs")) <= 1 - threshold + 1e-9, F.lit(True))
    fits = _close("an", "bn", threshold) & _reach(F.least("ac", "bc"), F.col("an") + F.col("bn"), threshold) & apart
    again = loose.join(others, "key").where("al <> bl and (bl = main or a < b)").where(fits)
    again = materialize(_ends(again).join(known, ["a", "b"], "left_anti"), "near-pairs")
    return known.union(materialize(similarities(again, texts), "near-found")).where(F.col("sim") >= threshold).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, digest, label, class_id and class_size of every row: rows are in one class if a chain of links joins them, a link
    being equal texts or a weighted Jaccard similarity of threshold or more over bags of five-word shingles. class_id is the
    smallest doc_id of the class, label a number that no two classes share.

    A text of one to four words has its words as its only shingle; texts without words, empty ones too, are linked to equal
    texts only. A row with a null text is a class of its own (digest and label null, class_id its doc_id, class_size 1); rows with a
    null doc_id are classed like others and give no class_id unless they are alone. Repeated rows are all returned; an empty
    table gives no rows. Other columns are not looked at."""
    rows = materialize(signatures(docs), "near-signatures")
    nodes = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "bands")).alias("r")).select("digest", "r.*")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    labels = components(_links(nodes, docs, threshold))
    named = nodes.select("node", "digest").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    classed = materialize(rows.select("doc_id", "digest").join(named, "digest"), "near-classed")
    classes = materialize(classed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "near-classes")
    alone = docs.where("text is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("label"), F.col("doc_id").cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return classed.join(classes, "label").select("doc_id", "digest", "label", "class_id", "class_size").unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs that lead their class: of each class one row with the smallest doc_id stays (nulls come first), all
    rows with null texts stay. Of equal rows one stays; columns are those of docs."""
    d, g = fresh(docs, "doc", "digest")
    lead = near_duplicates(docs, threshold).where("digest is not null").groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("r"))
    kept = materialize(lead.select(F.col("r.doc_id").alias(d), F.col("r.digest").alias(g)), "near-kept")
    rows = docs.where("text is not null").withColumn(g, F.unhex(F.md5(F.col("text").cast("binary")))).withColumn(d, F.col("doc_id").cast("long"))
    lost = [c + "_" for c in (d, g)]
    kept = kept.withColumnsRenamed(dict(zip((d, g), lost, strict=True)))
    rows = rows.join(kept, rows[d].eqNullSafe(kept[lost[0]]) & rows[g].eqNullSafe(kept[lost[1]]), "left_semi")
    return rows.dropDuplicates([d, g]).drop(d, g).unionByName(docs.where("text is null"))
