"""Hard negatives by one-dimensional distance keys.

Vectors get one more component that makes all norms equal, so the largest inner product is the least distance. Each is stored under its
nearest pivot and its distance to it, sorted by (pivot, distance) and cut to segments. By the triangle inequality a query's distances to
a segment's vectors lie between bounds that follow from its own distance to the pivot and the segment's key interval. A search looks at
the segments around the query's keys, then at wider key intervals, and ends where the bounds of all segments left rule them out."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, materialize

PIVOTS, SAMPLE, SEGMENT_ROWS = 16, 8192, 2048
#: Half widths of the key intervals of the search's rounds, as shares of the largest norm; what the last leaves is looked at where the
#: bounds don't rule it out.
WIDTHS = (0.0, 0.05)
#: Row number within a segment has this many bits of a row's uid.
BITS = 20
LARGEST = (1 << 63) - 1
#: Scores are held within these ends, so that percentages of them are still longs.
HELD = 1 << 55
SLACK = 1e-9


def usable(vectors: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Rows with a label and a vector of finite components only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(label).isNotNull() & F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _cells(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long float64 vectors kept as binary."""
    raw = [x.as_buffer() for x in column]
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    """x with the component that makes its squared norm `most`."""
    return np.hstack([x, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0.0))[:, None]])


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0.0))


def _means(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows of the sample."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(rounds):
        near = _to_pivots(sample, pivots).argmin(1)
        pivots = np.stack([sample[near == j].mean(0) if (near == j).any() else pivots[j] for j in range(len(pivots))])
    return pivots


class Index:
    """Table of (segment, pivot, pos, dist, vec_id, label, vec), sorted by (pivot, dist) and written once; `segments` has each one's key interval."""

    def __init__(self, vectors: DataFrame, vec: str, vec_id: str, label: str, scale: int, n_pivots: int, sample: int, segment_rows: int):
        spark = vectors.sparkSession
        q = F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
        rows = usable(vectors, vec, label).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), q.alias("q"))
        norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
        size = rows.agg(F.max(norm).alias("most"), F.max(F.size("q")).alias("dim")).first()
        self.most, self.dim = float(size.most or 0.0), max(int(size.dim or 0), 1)
        dim, most = self.dim, self.most
        some = rows.select("q").orderBy(F.xxhash64("q"), F.xxhash64("vec_id")).limit(sample).collect()
        plain = np.zeros((len(some), dim))
        for i, r in enumerate(some):
            plain[i, : len(r.q)] = r.q
        self.pivots = pivots = _means(_lift(plain, most), n_pivots) if some else np.zeros((1, dim + 1))

        def keys(batches):
            for b in batches:
                at = b.column(2)
                x = np.zeros((b.num_rows, dim))
                n = np.diff(at.offsets.to_numpy())
                row = np.repeat(np.arange(b.num_rows), n)
                x[row, np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)] = at.flatten().to_numpy()
                d = _to_pivots(_lift(x, most), pivots)
                near = d.argmin(1)
                vecs = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vecs, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "label", "vec", "pivot", "dist"])

        def cut(batches):
            from pyspark import TaskContext

            no, pos, last = TaskContext.get().partitionId() << 20, 0, -1
            for b in batches:
                segment, place = [], []
                for p in b.column(3).to_numpy():
                    if p != last or pos == segment_rows:
                        no, pos, last = no + 1, 0, p
                    segment.append(no)
                    place.append(pos)
                    pos += 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segment, pa.int64()), pa.array(place, pa.int32())], [*b.schema.names, "segment", "pos"])

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        schema = "vec_id long, label long, vec binary, pivot int, dist double"
        keyed = materialize(map_batches(rows, keys, schema), "keyed")
        order = ["pivot", "dist", "vec_id"]
        self.table = materialize(map_batches(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order), cut, f"{schema}, segment long, pos int"), "index")
        ends = self.table.groupBy("segment", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
        line = W.partitionBy("pivot").orderBy("lo", "hi", "segment")
        # each segment's part of the pivot's line reaches to the next one's, and the outermost have no end
        ends = ends.withColumn("ring_lo", F.when(F.row_number().over(line) == 1, F.lit(0.0)).otherwise(F.col("lo")))
        self.segments = materialize(ends.withColumn("ring_hi", F.coalesce(F.lead("lo").over(line), F.lit(float("inf")))), "segments")

    def uid(self):
        return F.call_function("shiftleft", F.col("segment"), F.lit(BITS)) + F.col("pos")

    def queries(self, which) -> DataFrame:
        """(qid, vec_id, label, vec, norm, reach) of the index's rows for which `which` holds; reach: distances to all pivots."""
        pivots, most = self.pivots, self.most

        def task(batches):
            for b in batches:
                x = _cells(b.column(3)) if b.num_rows else np.zeros((0, len(pivots[0]) - 1))
                # the query's own extra component is 0: its distances to lifted vectors fall as inner products rise
                d = _to_pivots(np.hstack([x, np.zeros((len(x), 1))]), pivots)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.einsum("ij,ij->i", x, x)), pa.array(list(d), pa.list_(pa.float64()))], [*b.schema.names, "norm", "reach"])

        rows = self.table.where(which).select(self.uid().alias("qid"), "vec_id", "label", "vec")
        return materialize(map_batches(rows, task, "qid long, vec_id long, label long, vec binary, norm double, reach array<double>"), "queries")

    def search(self, queries: DataFrame, bands: DataFrame, k: int, same_label: bool, widths=WIDTHS) -> DataFrame:
        """(qid, band, score, vec_id, uid): of the rows of the query's own label (same_label, without itself) or of other labels, the k of
        greatest score within low..high of each band, ties to smaller vec_id. bands: (qid, band, low, high) of the queries.

        Each round sends a query to the segments whose key interval is within the round's width of its keys and whose bounds on the
        score meet a band; a band that has k results by then is cut at the least of them. The last round has no width, so what is
        never looked at is ruled out by its bounds: results are exact."""
        best, seen = None, None
        bands = materialize(bands, "bands")
        for width in [*widths, None]:
            open_bands = bands
            if best is not None:
                full = best.groupBy("qid", "band").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
                open_bands = bands.join(full.select("qid", "band", "least"), ["qid", "band"], "left").select("qid", "band", F.greatest("low", F.coalesce("least", "low")).alias("low"), "high")
            found = self._visit(queries, open_bands.where("low <= high"), k, same_label, seen, width)
            rows = found if best is None else best.unionByName(found)
            place = F.row_number().over(W.partitionBy("qid", "band").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid"))
            best = materialize(rows.withColumn("place", place).where(F.col("place") <= k).drop("place"), "found")
            seen = width
        return best

    def _visit(self, queries, bands, k, same_label, seen, width):
        size = float(np.sqrt(self.most))
        spread = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        deals = max(1, spread // len(self.pivots))
        with_bands = queries.join(bands.groupBy("qid").agg(F.collect_list(F.struct("band", "low", "high")).alias("bands")), "qid")
        keys = with_bands.select("qid", "norm", "bands", F.posexplode("reach").alias("pivot", "at")).withColumn("deal", F.pmod(F.xxhash64("qid"), F.lit(deals)).cast("int"))
        segments = self.segments.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(lo) - F.col("at"), F.col("at") - F.col(hi))
        top, unit = F.col("norm") + self.most, SLACK * (F.col("norm") + self.most + 1)
        greatest = (top - gap("lo", "hi") ** 2) / 2 + unit
        least = (top - (F.col("hi") + F.col("at")) ** 2) / 2 - unit
        ring = gap("ring_lo", "ring_hi")
        pairs = keys.join(segments, ["pivot", "deal"]).withColumn("greatest", greatest).withColumn("least", least)
        if width is not None:
            pairs = pairs.where(ring <= width * size)
        if seen is not None:
            pairs = pairs.where(ring > seen * size)
        pairs = pairs.where(F.exists("bands", lambda b: (b["low"] <= F.col("greatest")) & (b["high"] >= F.col("least"))))
        visits = pairs.select("qid", "segment").join(with_bands.select("qid", "label", "vec", "bands"), "qid")
        rows = self.table.select("segment", F.lit(0).alias("kind"), self.uid().alias("id"), "vec_id", "label", "vec")
        rows = rows.unionByName(visits.select("segment", F.lit(1).alias("kind"), F.col("qid").alias("id"), "label", "vec", "bands"), allowMissingColumns=True)
        dealt = rows.repartition(spread, "segment").sortWithinPartitions("segment", "kind")
        exact = self.most < 2.0**53

        def scores(q, x):
            if exact:
                return (q @ x.T).astype(np.int64)
            whole = lambda a: np.array([[int(v) for v in r] for r in a], object)
            return np.clip(whole(q) @ whole(x).T, -HELD, HELD).astype(np.int64)

        def task(batches):
            at, parts, held = None, [], None
            for b in batches:
                segment, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
                start = 0
                for key, run in groupby(zip(segment.tolist(), kind.tolist(), strict=True)):
                    n = sum(1 for _ in run)
                    piece = b.slice(start, n)
                    start += n
                    if key[0] != at:
                        at, parts, held = key[0], [], None
                    if key[1] == 0:
                        parts.append((piece.column(2).to_numpy(), piece.column(3).fill_null(LARGEST).to_numpy(), piece.column(4).to_numpy(), _cells(piece.column(5))))
                        continue
                    if held is None:
                        held = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    for lo in range(0, n, 256):
                        out = list(_best(piece.slice(lo, 256), held))
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["qid", "band", "score", "vec_id", "uid"])

        def _best(piece, held):
            uids, ids, labels, x = held
            all_scores = scores(_cells(piece.column(5)), x)
            for i, (qid, label, bands) in enumerate(zip(piece.column(2).to_pylist(), piece.column(4).to_pylist(), piece.column(6).to_pylist(), strict=True)):
                s = all_scores[i]
                fit = (labels == label) & (uids != qid) if same_label else labels != label
                for band in bands:
                    of = np.flatnonzero(fit & (s >= band["low"]) & (s <= band["high"]))
                    if len(of) > k:
                        of = of[s[of] >= np.partition(s[of], len(of) - k)[len(of) - k]]
                    for j in of[np.lexsort((uids[of], ids[of], -s[of]))][:k]:
                        yield qid, band["band"], int(s[j]), None if ids[j] == LARGEST else int(ids[j]), int(uids[j])

        return map_batches(dealt, task, "qid long, band int, score long, vec_id long, uid long")


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, vec: str = "embedding", vec_id: str = "vec_id", label: str = "label", n_pivots: int = PIVOTS, sample: int = SAMPLE, segment_rows: int = SEGMENT_ROWS, widths=WIDTHS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose vec_id is divisible by `every`.

    Scores are inner products of floor(scale * x). An anchor's positives are the first n_positives other rows of its label; each
    positive has the first n_negatives rows of other labels whose score is `low` to `high` percent of its own. The search is exact; only the
    pivots are fitted on a bounded sample (the `sample` rows of least hash).

    Rows with a null label, a null vector or a null or non-finite component take no part; components that a shorter vector lacks count as 0.
    A null vec_id is no anchor and comes last among ties; repeated rows are rows of their own, as anchors, positives and negatives.
    Scores are held within 2^55 either way. An empty table gives no rows; other columns are not read."""
    index = Index(vectors, vec, vec_id, label, scale, n_pivots, sample, segment_rows)
    anchors = index.queries(F.pmod("vec_id", F.lit(every)) == 0)
    whole = anchors.select("qid", F.lit(0).alias("band"), F.lit(-LARGEST).alias("low"), F.lit(LARGEST).alias("high"))
    positives = index.search(anchors, whole, n_positives, True, widths).drop("band")
    line = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    positives = materialize(positives.withColumn("band", F.row_number().over(line)).withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), "positives")
    # low * s <= 100 * t <= high * s in whole numbers: t from ceil(low * s / 100) to floor(high * s / 100)
    s = F.col("positive_score")
    bands = positives.withColumn("a", -s * low).withColumn("b", s * high)
    bands = bands.select("qid", "band", F.expr("-((a - pmod(a, 100)) div 100)").alias("low"), F.expr("(b - pmod(b, 100)) div 100").alias("high")).where("low <= high")
    negatives = index.search(anchors, bands, n_negatives, False, widths)
    rank = F.row_number().over(W.partitionBy("qid", "band").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid"))
    out = negatives.withColumn("rank", rank).join(positives.select("qid", "band", "positive_id", "positive_score"), ["qid", "band"]).join(anchors.select("qid", F.col("vec_id").alias("anchor_id")), "qid")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
