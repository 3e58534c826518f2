"""Temperature mixing: source token shares raised to an exponent that meets a target entropy or a repetition limit, realised
as budgeted block permutations of each source's documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, fresh, materialize

#: Documents that a block of a source's permutation holds on average.
BLOCK_DOCS = 4096
#: Exponents that one pass over the source table tries for each condition, and passes; the exponent is found to GRID^-PASSES.
GRID, PASSES = 256, 3


@dataclass(frozen=True)
class Mix:
    """target_entropy: share of the largest entropy, log(number of sources). max_repeats: epochs of any source at most.
    budget_tokens: tokens to draw in all; by default as many as there are."""

    target_entropy: float = 0.95
    max_repeats: float = 2.0
    budget_tokens: int | None = None
    seed: int = 23


def count_tokens(text: Column) -> Column:
    """Words of the text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_tokens(rows: DataFrame) -> DataFrame:
    """source, n_docs, n_tokens; partial sums come before the shuffle, so a hot source is one row a task."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("n_tokens"))


def _largest(sources: DataFrame, conditions: list) -> list[float]:
    """For each condition the largest exponent in 0..1 for which it holds, 0 if none does; a condition must hold below that
    exponent. It is asked with a, z = sum p^a and l = sum p^a log p over the shares p of the sources.

    A pass cuts the interval of every condition in GRID parts; GRID + 1 rows of sums reach the driver."""
    spans = [(0.0, 1.0)] * len(conditions)
    for _ in range(PASSES):
        tried = sources.select("share", F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("i"))
        at = [F.lit(low) + F.lit((high - low) / GRID) * F.col("i") for low, high in spans]
        cols = [c for k, a in enumerate(at) for c in (F.sum(F.pow("share", a)).alias(f"z{k}"), F.sum(F.pow("share", a) * F.log("share")).alias(f"l{k}"))]
        rows = sorted(tried.groupBy("i").agg(*cols).collect(), key=lambda r: r["i"])
        for k, (low, high) in enumerate(spans):
            point = lambda i: low + (high - low) / GRID * i  # noqa: E731, B023
            held = [conditions[k](point(r["i"]), r[f"z{k}"], r[f"l{k}"]) for r in rows]
            i = held.index(False) - 1 if False in held else GRID
            spans[k] = (point(max(i, 0)), point(min(i + 1, GRID))) if i >= 0 else (low, low)
    return [low for low, _ in spans]


def temperature(sources: DataFrame, mix: Mix) -> tuple[float, int]:
    """The exponent and the budget. Entropy falls as the exponent rises and repetition falls too, so the exponent is the
    largest that meets the entropy, raised to the smallest that keeps every source within max_repeats; where both can't be
    met the repetition limit holds, and where it fails even at 1, the exponent is 1."""
    from math import log

    r = sources.agg(F.sum("n_tokens").alias("t"), F.min("n_tokens").alias("least"), F.count(F.lit(1)).alias("k")).first()
    total, least, k = r["t"] or 0, r["least"] or 0, r["k"]
    budget = total if mix.budget_tokens is None else mix.budget_tokens
    if k < 2:
        return 1.0, budget
    sources = sources.withColumn("share", F.col("n_tokens") / F.lit(total))
    diverse = lambda a, z, l: log(z) - a * l / z >= mix.target_entropy * log(k)  # noqa: E731, E741
    too_often = lambda a, z, l: budget / total * (least / total) ** (a - 1) / z > mix.max_repeats  # noqa: E731, E741
    by_entropy, by_repeats = _largest(sources, [diverse, too_often])
    return max(by_entropy, min(1.0, by_repeats + float(GRID) ** -PASSES) if by_repeats > 0 else 0.0), budget


def _key(row_key: Column, seed: int, epoch: Column) -> Column:
    """Place of a row in the permutation of an epoch, 0 .. 2^62 - 1."""
    return F.call_function("shiftrightunsigned", F.xxhash64(row_key, F.lit(seed), epoch), F.lit(2))


def _block(key: Column, n_blocks: Column) -> Column:
    return F.floor(key.cast("double") / F.lit(float(1 << 62)) * n_blocks).cast("long")


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row a source: source, n_docs, n_tokens, n_blocks, weight, quota, epochs (whole passes) and cutoff (rows of the last, partial
    pass whose key is at most this are drawn; null: none).

    The partial pass is a permutation by hash, cut into blocks by ranges of the hash. Token sums of blocks find the block in
    which the quota ends, and only that block's rows are summed one by one, so no source is ever ordered in one task."""
    every = materialize(source_tokens(rows), "mix-sources")
    sources = every.where("n_tokens > 0")
    exponent, budget = temperature(sources, mix)
    total = F.lit(float((sources.agg(F.sum("n_tokens")).first()[0]) or 1))
    raised = sources.withColumn("raised", F.pow(F.col("n_tokens") / total, F.lit(exponent)))
    z = F.lit(float(raised.agg(F.sum("raised")).first()[0] or 1.0))
    quota = F.floor(F.lit(float(budget)) * F.round(F.col("raised") / z, 12)).cast("long")
    quotas = raised.withColumn("weight", F.round(F.col("raised") / z, 12)).withColumn("quota", F.least(quota, F.floor(F.lit(mix.max_repeats) * F.col("n_tokens")).cast("long")))
    quotas = quotas.withColumn("epochs", F.floor(F.col("quota") / F.col("n_tokens")).cast("long")).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("n_tokens"))
    quotas = materialize(quotas.withColumn("n_blocks", F.greatest(F.ceil(F.col("n_docs") / BLOCK_DOCS).cast("long"), F.lit(1).cast("long"))).drop("raised"), "mix-quotas")
    s = quotas.select(F.col("source").alias("s"), "epochs", "rest", "n_blocks")
    keyed = rows.join(s, F.col("source").eqNullSafe(F.col("s"))).withColumn("key", _key(F.col("row_key"), mix.seed, F.col("epochs")))
    keyed = materialize(keyed.select("source", "tokens", "key", "rest", _block(F.col("key"), F.col("n_blocks")).alias("block")), "mix-keyed")
    blocks = keyed.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("t"))
    through = F.sum("t").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, 0))
    ends = blocks.withColumn("through", through).where("through > rest and through - t <= rest")
    ends = materialize(ends.groupBy("source").agg(F.min(F.struct("block", (F.col("rest") - F.col("through") + F.col("t")).alias("left"))).alias("e")).select(F.col("source").alias("s"), F.col("e.block").alias("b"), F.col("e.left").alias("left")), "mix-ends")
    inside = keyed.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    run = F.sum("tokens").over(W.partitionBy("source").orderBy("key").rangeBetween(W.unboundedPreceding, 0))
    last = inside.withColumn("run", run).where("run <= left").groupBy(F.col("source").alias("s")).agg(F.max("key").alias("last"))
    first = ends.join(last.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").join(quotas.select(F.col("source").alias("s3"), "n_blocks"), F.col("s").eqNullSafe(F.col("s3")))
    # the block's first key, less one, where none of its rows fits: all earlier blocks are drawn
    before = F.ceil(F.col("b").cast("double") / F.col("n_blocks") * F.lit(float(1 << 62))).cast("long") - 1
    cut = first.select("s", F.coalesce("last", before).alias("cutoff"))
    out = quotas.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    return materialize(out.select("source", "n_docs", "n_tokens", "n_blocks", "weight", "quota", "epochs", F.when(F.col("rest") > 0, F.col("cutoff")).alias("cutoff")), "mix-plan")


OUTPUTS = ("n_tokens", "weight", "copies", "mix_key", "epoch", "block", "position")


def _decided(docs: DataFrame, settings: Mix, tokens: Column | None) -> tuple[DataFrame, dict]:
    """docs with n_tokens, weight and copies, and under the names given the row's key and its source's epochs and n_blocks."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in OUTPUTS])
    names = dict(zip(("row", "source", "weight", "epochs", "cutoff", "n_blocks"), fresh(docs, "row", "source", "weight", "epochs", "cutoff", "n_blocks"), strict=True))
    row_key = F.xxhash64("doc_id", "text")
    counted = count_tokens(F.col("text")) if tokens is None else tokens
    rows = materialize(docs.select("source", counted.alias("tokens"), row_key.alias("row_key")), "mix-rows")
    decided = plan(rows, settings).select(*[F.col(c).alias(names[c]) for c in ("source", "weight", "epochs", "cutoff", "n_blocks")])
    out = docs.withColumn(names["row"], row_key).withColumn("n_tokens", counted).join(decided, F.col("source").eqNullSafe(F.col(names["source"])), "left")
    epochs = F.coalesce(F.col(names["epochs"]), F.lit(0).cast("long"))
    last = _key(F.col(names["row"]), settings.seed, epochs)
    copies = epochs + F.when(last <= F.col(names["cutoff"]), 1).otherwise(0)
    out = out.withColumn("weight", F.coalesce(names["weight"], F.lit(0.0))).withColumn("copies", copies.cast("int")).withColumn(names["epochs"], epochs)
    return out.drop(*[names[c] for c in ("source", "weight", "cutoff")]), names


def mix(docs: DataFrame, settings: Mix = Mix(), tokens: Column | None = None) -> DataFrame:
    """Every row of docs with n_tokens, weight (of its source), copies (times it is drawn) and mix_key (its place in the last
    pass).

    A source's budget is quota = budget * weight tokens: whole epochs draw every row once each, and the last pass draws rows
    in the order of a seeded hash while their tokens fit the rest, so a source comes short of its quota by less than the
    next document. Equal rows have equal places and are drawn alike. A null source is a source; sources without any token
    have weight 0 and no copies; null and empty texts have 0 tokens and follow their source; a single source has weight 1;
    an empty table stays empty; input columns named like an output are replaced. Long texts are counted whole."""
    out, names = _decided(docs, settings, tokens)
    return out.withColumn("mix_key", _key(F.col(names["row"]), settings.seed, F.col(names["epochs"]))).drop(*names.values())


def schedule(docs: DataFrame, settings: Mix = Mix(), tokens: Column | None = None, keep_text: bool = True) -> DataFrame:
    """The rows of docs (without text if keep_text is false) once for each time they are drawn, with n_tokens, weight, copies
    and their place: epoch (from 0), block and position (both from 0) in the epoch's permutation of the source.

    Epochs of a source differ in order; a block holds BLOCK_DOCS rows on average, so that no task orders a source. Reading a
    source by (epoch, block, position) draws its quota. Nulls, empties and clashing columns as in mix()."""
    out, names = _decided(docs, settings, tokens)
    out = (out if keep_text else out.drop("text")).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    (key,) = fresh(out, "key")
    out = out.withColumn(key, _key(F.col(names["row"]), settings.seed, F.col("epoch").cast("long")))
    out = out.withColumn("block", _block(F.col(key), F.col(names["n_blocks"])))
    place = F.row_number().over(W.partitionBy("source", "epoch", "block").orderBy(key)) - 1
    return out.withColumn("position", place).drop(key, *names.values())


def draw(docs: DataFrame, settings: Mix = Mix()) -> DataFrame:
    """The rows of docs as often as mix() draws them, columns as they are."""
    clash = {c: n for c, n in zip(docs.columns, fresh(docs, *docs.columns), strict=True) if c.lower() in OUTPUTS}
    (c,) = fresh(docs, "copy")
    chosen = mix(docs.withColumnsRenamed(clash), settings).where("copies > 0").withColumn(c, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return chosen.select(*[F.col(clash.get(x, x)).alias(x) for x in docs.columns])
