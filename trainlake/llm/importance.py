"""Importance resampling towards a target distribution over bucket-partitioned inverted postings.

Texts become postings (bucket, document, count) of hashed word runs. Postings are shuffled by bucket; where the postings and counts of a
bucket's two corpora meet its gain is computed, each posting gives gain * count to its document, and contributions are summed by
document. Gumbel noise from the document's id turns weights into a draw without replacement."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sharding
from .common import map_batches, materialize, partitions_for

BUCKETS, MOST_WORDS = 10_000, 3
#: Buckets go to this many slices; a slice's postings are dealt to as many tasks as the input needs.
SLICES = 8
#: A block of postings ends with the document that brings it to this many, or with this many documents.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 20, 1 << 14
#: Bytes of text that are looked at in one piece.
PIECE = 1 << 20
POSTINGS = "block string, slice int, n_docs int, keys binary, counts binary, ids array<long>, n_features array<long>, n_words array<long>, totals array<long>"


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()
_shifts: list[np.ndarray] = []


def _shift_table(k: int) -> np.ndarray:
    """4 x 256 values: what a CRC's bytes become when 2^k zero bytes follow."""
    while len(_shifts) <= k:
        if not _shifts:
            one = lambda c: CRC[c & 255] ^ (c >> np.uint32(8))
        else:
            last = _shifts[-1]
            one = lambda c, t=last: _apply(t, _apply(t, c))
        _shifts.append(np.stack([one(np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)]))
    return _shifts[k]


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][(c >> np.uint32(8)) & 255] ^ t[2][(c >> np.uint32(16)) & 255] ^ t[3][c >> np.uint32(24)]


def _shift(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The linear part of a CRC when n[i] bytes follow: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""
    out, k, most = c.copy(), 0, int(n.max(initial=0))
    while most >> k:
        at = np.flatnonzero((n >> k) & 1)
        out[at] = _apply(_shift_table(k), out[at])
        k += 1
    return out


def _word_crcs(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word b[start : start + size]; words of over 32 bytes one by one, the others byte by byte together."""
    out = np.zeros(len(start), np.uint32)
    long = np.flatnonzero(size > 32)
    for i in long:
        out[i] = zlib.crc32(b[start[i] : start[i] + size[i]])
    order = np.argsort(-np.where(size > 32, 0, size), kind="stable")
    order = order[: len(order) - len(long)]
    s, n = start[order], size[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-n, -np.arange(1, 33), "right")
    for i in range(int(n.max(initial=0))):
        k = live[i]
        c[:k] = CRC[(c[:k] ^ b[s[:k] + i]) & 255] ^ (c[:k] >> np.uint32(8))
    out[order] = ~c
    return out


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pieces(texts: list[bytes], size: int):
    """(first, bytes, doc of each byte's text, whether the first text goes on from the last piece): texts joined by a zero byte, long texts
    cut between words."""
    some, held, first = [], 0, 0
    for i, t in enumerate(texts):
        at, going = 0, False
        while len(t) - at > size:
            if some:
                yield first, some, False
                some, held = [], 0
            end = at + size
            while end < len(t) and (t[end] >= 128 or t[end : end + 1].isalnum()):
                end += 1
            yield i, [t[at:end]], going
            at, going = end, True
        if going:
            yield i, [t[at:]], True
            first = i + 1
            continue
        if held + len(t) > size and some:
            yield first, some, False
            some, held = [], 0
        if not some:
            first = i
        some.append(t[at:])
        held += len(t)
    if some:
        yield first, some, False


def features(texts: list[bytes], buckets: int = BUCKETS, most: int = MOST_WORDS, piece: int = PIECE):
    """Pieces of (doc, bucket) of every run of 1 to `most` words, and (doc) of every word; arrays, documents by their place in texts."""
    tail_c, tail_n = np.empty(0, np.uint32), np.empty(0, np.int64)
    for first, some, going in _pieces(texts, piece):
        b = _LOWER[np.frombuffer(b"\0".join(some), np.uint8)]
        edge = np.diff(_WORD[b].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start = np.flatnonzero(edge == 1)
        size = np.flatnonzero(edge == -1) - start
        begins = np.cumsum([0] + [len(t) + 1 for t in some[:-1]])
        doc = first + np.searchsorted(begins, start, "right") - 1
        crc = _word_crcs(b, start, size)
        if not going:
            tail_c, tail_n = tail_c[:0], tail_n[:0]
        old = len(tail_c)
        c, n = np.concatenate([tail_c, crc]), np.concatenate([tail_n, size])
        d = np.concatenate([np.full(old, first), doc])
        docs, got = [doc], [c[old:] % np.uint32(buckets)]
        run, run_n = c, n
        for k in range(1, most):
            # runs of k + 1 words ending at each place: a run of k, a space and a word
            if len(c) <= k:
                break
            spaced = _joined(c[k:], n[k:])
            run, run_n = _shift(run[:-1], n[k:] + 1) ^ spaced, run_n[:-1] + n[k:] + 1
            new = np.flatnonzero((d[k:] == d[:-k]) & (np.arange(k, len(c)) >= old))
            docs.append(d[k:][new])
            got.append(run[new] % np.uint32(buckets))
        keep = min(most - 1, len(c))
        mine = d[len(c) - keep :] == first
        tail_c, tail_n = c[len(c) - keep :][mine], n[len(c) - keep :][mine]
        yield np.concatenate(docs), np.concatenate(got), doc


def _joined(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC of a space and each word."""
    return _shift(np.full(len(c), zlib.crc32(b" "), np.uint32), n) ^ c


def _pack(values: np.ndarray) -> bytes:
    """Small non-negative numbers as bytes, larger ones as 255 and in full behind, compressed."""
    large = values[values >= 255].astype("<u8")
    return zlib.compress(np.minimum(values, 255).astype(np.uint8).tobytes() + large.tobytes() + np.array([len(large)], "<u4").tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    k = int(np.frombuffer(raw[-4:], "<u4")[0])
    out = np.frombuffer(raw[: len(raw) - 4 - 8 * k], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[len(raw) - 4 - 8 * k : -4], "<u8").astype(np.int64)
    return out


class _Blocks:
    """Gathers the postings of whole documents and gives them as rows of POSTINGS."""

    def __init__(self, buckets: int, slices: int, part: int, most: int):
        self.buckets, self.slices, self.part, self.most, self.n = buckets, slices, part, most, 0
        self.sums = np.zeros(buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.loose, self.held = [], 0
        self.ids, self.n_features, self.n_words = [], [], []

    def add(self, keys: np.ndarray) -> None:
        self.loose.append(keys)
        self.held += len(keys)
        if self.held > 4 * self.most:
            self.settle()

    def settle(self) -> None:
        """Loose keys become sorted postings with counts; a document has a posting a bucket at most."""
        if self.loose:
            k = np.sort(np.concatenate(self.loose))
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
            k, c = k[at], np.diff(np.r_[at, len(k)])
            if len(self.keys):
                k, c = np.concatenate([self.keys, k]), np.concatenate([self.counts, c])
                order = np.argsort(k, kind="stable")
                k, c = k[order], c[order]
                at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                k, c = k[at], np.add.reduceat(c, at)
            self.keys, self.counts, self.loose, self.held = k, c, [], 0

    def rows(self):
        self.settle()
        name = f"{self.part}-{self.n}"
        self.n += 1
        n = len(self.ids)
        bucket = self.keys // BLOCK_DOCS
        self.sums += np.bincount(bucket, self.counts, self.buckets).astype(np.int64)
        ends = np.searchsorted(bucket, _bounds(self.buckets, self.slices))
        for s in range(self.slices):
            k = self.keys[ends[s] : ends[s + 1]]
            if len(k):
                yield (name, s, n, _pack(np.diff(k, prepend=ends_key(self.buckets, self.slices, s))), _pack(self.counts[ends[s] : ends[s + 1]]), None, None, None, None)
        yield (name, None, n, None, None, self.ids, self.n_features, self.n_words, None)
        self.clear()


def _bounds(buckets: int, slices: int) -> np.ndarray:
    """First bucket of each slice, and the end."""
    return np.arange(slices + 1) * buckets // slices


def ends_key(buckets: int, slices: int, s: int) -> int:
    return int(_bounds(buckets, slices)[s]) * BLOCK_DOCS


def postings(docs: DataFrame, id_column: str, text_column: str, buckets: int = BUCKETS, most: int = MOST_WORDS, slices: int = SLICES, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Blocks of postings of whole texts, a row a block and slice; a row a block with its documents (ids, features, words); and a row a
    task with the buckets' totals, all written to the shared folder. A block holds about a million postings."""

    def task(batches):
        from pyspark import TaskContext

        blocks = _Blocks(buckets, slices, TaskContext.get().partitionId(), block_postings)
        schema = pa.schema([("block", pa.string()), ("slice", pa.int32()), ("n_docs", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("ids", "n_features", "n_words", "totals")]])
        as_batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi in _spans(batch.column(1)):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)[lo:hi]]
                base = len(blocks.ids)
                n_features, n_words = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for d, b, w in features(texts, buckets, most):
                    n_features += np.bincount(d, minlength=hi - lo)
                    n_words += np.bincount(w, minlength=hi - lo)
                    blocks.add(b.astype(np.int64) * BLOCK_DOCS + (base + d))
                blocks.ids += ids[lo:hi]
                blocks.n_features += n_features.tolist()
                blocks.n_words += n_words.tolist()
                if len(blocks.ids) + 256 > BLOCK_DOCS or len(blocks.keys) + blocks.held > block_postings:
                    yield as_batch(blocks.rows())
        if blocks.ids:
            yield as_batch(blocks.rows())
        if blocks.n:
            yield as_batch([(None, None, None, None, None, None, None, None, blocks.sums.tolist())])

    return materialize(map_batches(docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")), task, POSTINGS), "postings")


def _spans(column: pa.Array):
    """Runs of at most 256 texts and about 4 MB."""
    lo = held = 0
    for i, x in enumerate(column):
        n = len(x.as_buffer()) if x.is_valid else 0
        if i > lo and (i - lo >= 256 or held + n > 4 << 20):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(column):
        yield lo, len(column)


def _totals(posted: DataFrame, slices: int, buckets: int) -> DataFrame:
    """(bucket, n) of a corpus, by partial sums."""
    rows = posted.where("totals is not null").select(F.posexplode("totals").alias("bucket", "n"))
    return rows.groupBy("bucket").agg(F.sum("n").cast("long").alias("n"))


def contributions(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, slices: int = SLICES) -> DataFrame:
    """(block, gains): for each slice of a block's postings, the sum of gain * count of each of its documents.

    The two corpora's totals of a slice's buckets go to each task of the slice ahead of its postings, so a task computes its gains and
    then streams over blocks; it holds one at a time. A slice is dealt to as many tasks as its postings need."""
    size = corpus.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("keys"), F.lit(0)) + F.coalesce(F.octet_length("counts"), F.lit(0))), F.lit(0)).alias("n")).first().n
    deals = -(-partitions_for(size, 16 << 20, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))) // slices)
    both = _totals(corpus, slices, buckets).withColumnRenamed("n", "s").join(_totals(target, slices, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    firsts = F.array(*[F.lit(int(x)) for x in _bounds(buckets, slices)[1:]])
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")).first()
    heads = both.withColumn("slice", F.size(F.filter(firsts, lambda x: x <= F.col("bucket")))).groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("known"))
    heads = heads.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).select("slice", "deal", F.lit(None).cast("string").alias("block"), F.lit(0).alias("n_docs"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"), "known")
    rows = corpus.where("slice is not null").select("slice", F.pmod(F.xxhash64("block", "slice"), F.lit(deals)).cast("int").alias("deal"), "block", "n_docs", "keys", "counts", F.lit(None).cast(heads.schema["known"].dataType).alias("known"))
    dealt = heads.unionByName(rows).repartition(slices * deals, "slice", "deal").sortWithinPartitions("slice", "deal", F.col("block").asc_nulls_first())
    s_all, t_all = float(sums.all_s), float(sums.all_t)

    def task(batches):
        gains, first = None, 0
        for batch in batches:
            blocks, values = [], []
            for r in batch.to_pylist():
                if r["known"] is not None:
                    first = int(_bounds(buckets, slices)[r["slice"]])
                    s, t = np.zeros(buckets - first), np.zeros(buckets - first)
                    for x in r["known"]:
                        s[x["bucket"] - first], t[x["bucket"] - first] = x["s"], x["t"]
                    gains = np.floor(1000 * np.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
                    continue
                k = np.cumsum(_unpack(r["keys"]))
                part = np.bincount(k % BLOCK_DOCS, gains[k // BLOCK_DOCS] * _unpack(r["counts"]), r["n_docs"])
                blocks.append(r["block"])
                values.append(part.astype(np.int64))
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.string()), pa.array(values, pa.list_(pa.int64()))], ["block", "gains"])

    return map_batches(dealt, task, "block string, gains array<long>")


def weights(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", target_id: str = "item_id", text_column: str = "text", buckets: int = BUCKETS, most: int = MOST_WORDS, slices: int = SLICES, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(id, n_features, n_words, weight), one row a row of docs: the log importance, in thousandths, of its text under the target.

    Words are runs of digits, letters and bytes from 128 on, A-Z lower-cased; features are all runs of 1 to `most` words joined by one
    space, in buckets by CRC-32 modulo `buckets`. A null or empty text has no feature and weight 0; repeated rows and ids have a row each;
    an empty target leaves only the corpus's own frequencies. docs must be a table or a plan whose tasks give the same rows when they
    are run again, as scans do. Texts are looked at in pieces of a megabyte; a block's postings fit a task, whatever their documents' size."""
    corpus = postings(docs, id_column, text_column, buckets, most, slices, block_postings)
    goal = postings(target, target_id, text_column, buckets, most, slices, block_postings)
    rows = corpus.where("ids is not null").select("block", "ids", "n_features", "n_words", F.lit(None).cast("array<long>").alias("gains"))
    rows = rows.unionByName(contributions(corpus, goal, buckets, slices), allowMissingColumns=True)
    n = partitions_for(0, 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(n, "block").sortWithinPartitions("block", F.col("ids").isNull().desc())
    schema = pa.schema([("id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64())])

    def task(batches):
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                if not batch.column(1)[i].is_valid:
                    gains = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                    total = gains if total is None else total + gains
                    continue
                ids, n_features, n_words = (batch.column(c)[i].values for c in (1, 2, 3))
                weight = pa.array(np.zeros(len(ids), np.int64) if total is None else total)
                yield pa.RecordBatch.from_arrays([ids, n_features, n_words, weight], schema=schema)
                total = None

    return map_batches(rows, task, "id long, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, **how) -> DataFrame:
    """(id, n_features, n_words, weight, score, rank): of the N documents with `least_words` words or more the floor(percent * N / 100) of
    highest score have ranks 1, 2, 3..., the rest null. score is weight plus Gumbel noise (in thousandths) from SHA-256 of seed and id.

    Ties go to smaller ids (a null id comes after all), then to fewer features; rows equal in all of these get ranks in any order.
    Ranks come from one range partitioning of the eligible rows, with an offset a partition."""
    w = weights(docs, target, **how)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(w.withColumn("score", F.col("weight") + noise), "scores")
    fit = scored.where(F.col("n_words") >= least_words)
    placed = sharding.number_rows(fit.withColumn("down", -F.col("score")).withColumn("no_id", F.col("id").isNull()), ["down", "no_id", "id", "n_features", "weight"])
    rank = F.when(F.col("row_no") < F.floor(F.lit(percent) * F.col("n_rows") / 100), F.col("row_no") + 1)
    out = ["id", "n_features", "n_words", "weight", "score"]
    return placed.select(*out, rank.cast("long").alias("rank")).unionByName(scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
