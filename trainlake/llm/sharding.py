"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, let, materialize

ROUNDS = 6
#: The domain a*b exceeds n by less than a <= sqrt(n) + 1 numbers, and a walk visits each of those at most once.
WALK = 64


def _sides(n: Column) -> tuple[Column, Column]:
    """a = ceil(sqrt(n)) and b = ceil(n / a): the smallest near-square domain a*b >= n."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    return a, F.greatest(F.floor((n + a - 1) / a).cast("long"), F.lit(1).cast("long"))


def _noise(x: Column, seed: int, k: int, modulus: Column) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(seed), F.lit(k)), modulus)


def _rounds(v: Column, a: Column, b: Column, seed: int, order, sign: int) -> Column:
    """Passes the pair (left mod a, right mod b) through the rounds; let() keeps each half from being written out twice."""

    def go(half: Column, todo: list[int]) -> Column:
        if not todo:
            return half["r"] * a + half["l"]
        k, rest = todo[0], todo[1:]
        if k % 2 == 0:
            new = F.struct(F.pmod(half["l"] + sign * _noise(half["r"], seed, k, a), a).alias("l"), half["r"].alias("r"))
        else:
            new = F.struct(half["l"].alias("l"), F.pmod(half["r"] + sign * _noise(half["l"], seed, k, b), b).alias("r"))
        return let(new, lambda h: go(h, rest))

    return let(F.struct(F.pmod(v, a).alias("l"), F.floor(v / a).cast("long").alias("r")), lambda h: go(h, list(order)))


def _walk(x: Column, n: Column, seed: int, order, sign: int) -> Column:
    """Applies the rounds again and again until the number falls below n."""

    def walk(ab: Column) -> Column:
        step = lambda v: _rounds(v, ab["a"], ab["b"], seed, order, sign)
        more = lambda first: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < n, v).otherwise(step(v)))
        return let(let(step(x), lambda first: F.when(first < n, first).otherwise(more(first))), lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))

    a, b = _sides(n)
    return let(F.struct(a.alias("a"), b.alias("b")), walk)


def permute(x: Column, n: Column, seed: int) -> Column:
    """Bijection of 0..n-1."""
    return _walk(x, n, seed, range(ROUNDS), 1)


def invert(y: Column, n: Column, seed: int) -> Column:
    """The number that permute() sends to y: shard s, slot k holds row invert(k * n_shards + s)."""
    return _walk(y, n, seed, tuple(reversed(range(ROUNDS))), -1)


def number_rows(docs: DataFrame, order: list[str]) -> DataFrame:
    """Adds row_no (0..n-1 in the order of the given columns, nulls first) and n_rows.

    Rows are range-partitioned and sorted; the sorted table is written once, then each partition's rows are counted and
    the offsets (one row a partition) are broadcast. No window over all rows. Rows equal in all order columns keep an
    arbitrary order among themselves."""
    mono, part, base = fresh(docs, "mono", "part", "base")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(docs.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(mono, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(part, F.call_function("shiftright", F.col(mono), F.lit(33)))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(part).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias(base), F.sum("n").over(every).cast("long").alias("n_rows"))
    return rows.drop("n_rows", "row_no").join(F.broadcast(offsets), part).withColumn("row_no", F.col(base) + F.col(mono).bitwiseAND(F.lit((1 << 33) - 1))).drop(mono, part, base)


def shard(docs: DataFrame, order: list[str], n_shards: int = 16, seed: int = 17) -> DataFrame:
    """Adds row_no, n_rows, shard (int) and slot (long) to every row.

    Law "rows": the permuted number p gives shard p mod n_shards and slot p div n_shards, so shard sizes differ by one at
    most and slots have no gap. The same rows, order and seed give the same result whatever the partitioning. Null keys
    sort first, repeated rows get places of their own, an empty table stays empty; input columns named like an output are
    replaced."""
    (p,) = fresh(docs, "p")
    out = number_rows(docs, order).withColumn(p, permute(F.col("row_no"), F.col("n_rows"), seed))
    return out.withColumn("shard", F.pmod(F.col(p), F.lit(n_shards)).cast("int")).withColumn("slot", F.floor(F.col(p) / n_shards).cast("long")).drop(p)
