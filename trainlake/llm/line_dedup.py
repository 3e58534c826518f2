"""Repeated runs of lines, found by winnowing: hashes of GRAM neighbouring lines are reduced to window minima, which every run
of RUN equal lines is guaranteed to share; places with a shared minimum are joined and their matches extended both ways; all
but the first of equal runs are deleted. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, materialize

#: Lines of the shortest run that is deleted, and of a fingerprint. A window is RUN - GRAM + 1 fingerprints wide.
RUN = 3
GRAM = 2
#: Bytes from which a shorter run is deleted too.
SHORT_BYTES = 40


def _trimmed(text: Column) -> Column:
    """The lines of a text as (i, x): place and content without white space at the ends; blank lines are left out."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.cast("int").alias("i"), F.btrim(x, F.lit(SPACE_CHARS)).alias("x")))
    return F.filter(lines, lambda s: s["x"] != "")


def _grams(h: Column, size: int) -> Column:
    """A hash for each `size` neighbouring line hashes."""
    n = F.size(h) - (size - 1)
    return F.when(n > 0, F.transform(F.slice(h, F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))).otherwise(F.array().cast("array<long>"))


def _minima(g: Column, width: int) -> Column:
    """Places of the least hash of every window (the first of equals), each once."""

    def place(i: Column) -> Column:
        best = lambda k: F.struct(F.get(g, i + k).alias("h"), (i + k).alias("p"))
        return F.least(*[best(k) for k in range(width)])["p"] if width > 1 else i

    n = F.size(g) - (width - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.slice(g, F.lit(1), F.greatest(n, F.lit(0))), lambda _, i: place(i.cast("int"))))).otherwise(F.array().cast("array<int>"))


def fingerprints(docs: DataFrame, run: int = RUN, gram: int = GRAM, short_bytes: int | None = None) -> DataFrame:
    """doc_id, th (hash of the text), a and b (two independent hashes of each non-blank line), lines (their places) and
    marks (p, f: place and hash of each selected fingerprint) of every text with `run` or more non-blank lines; with
    short_bytes of every text with a non-blank line, and sizes (bytes of each)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.explode(F.array(_trimmed(text))).alias("ln"))
    sizes = [] if short_bytes is None else [F.transform("ln", lambda s: F.octet_length(s["x"])).alias("sizes")]
    rows = rows.where(F.size("ln") >= (run if short_bytes is None else 1)).select(
        "doc_id",
        "th",
        F.transform("ln", lambda s: s["i"]).alias("lines"),
        F.transform("ln", lambda s: F.xxhash64(s["x"])).alias("a"),
        F.transform("ln", lambda s: F.xxhash64(F.lit("b"), s["x"])).alias("b"),
        *sizes,
    )
    marks = let(_grams(F.col("a"), gram), lambda g: F.transform(_minima(g, run - gram + 1), lambda p: F.struct(p.alias("p"), F.get(g, p).alias("f"))))
    return rows.withColumn("marks", marks)


def _short_runs(rows: DataFrame, run: int, short_bytes: int) -> DataFrame:
    """Every run of fewer than `run` lines: its start, size and hashes, and whether it is due if it stands earlier: it holds
    short_bytes bytes or is all of its text."""

    def of(k: int) -> Column:
        n = F.size("a") - (k - 1)
        at = lambda c, i: [F.get(c, i + j) for j in range(k)]
        held = lambda i: sum(at("sizes", i), F.lit(0)) >= short_bytes
        run_at = lambda _, i: F.struct(i.cast("int").alias("start"), F.lit(k).alias("size"), F.xxhash64(*at("a", i)).alias("ka"), F.xxhash64(*at("b", i)).alias("kb"), ((n == 1) | held(i)).alias("due"))
        return F.transform(F.slice("a", F.lit(1), F.greatest(n, F.lit(0))), run_at)

    return rows.select("doc_id", "th", F.explode(F.flatten(F.array(*[of(k) for k in range(1, run)]))).alias("r")).select("doc_id", "th", "r.*")


def repeated_lines(docs: DataFrame, run: int = RUN, gram: int = GRAM, short_bytes: int | None = None) -> DataFrame:
    """doc_id, th and gone (places of lines, ascending) of the texts that have lines to delete.

    A fingerprint that occurs once proves that no run through it repeats; the rest are joined back to their places, and each
    place is extended both ways to every run of `run` lines through it. Equal runs (equal in two hashes of each line) keep
    their first place by (doc_id, th, line); overlapping repeats join to longer deleted stretches. With short_bytes, runs of
    fewer lines take part too, each by its own hashes (see _short_runs). Counts and firsts are
    partial sums before the shuffle; both joins have one row a key on one side, so a hot key may be split."""
    rows = materialize(fingerprints(docs, run, gram, short_bytes).dropDuplicates(["doc_id", "th"]), "lines-rows")
    marks = rows.select(F.explode("marks.f").alias("f"))
    shared = marks.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f")
    places = rows.select("doc_id", "th", F.explode(F.transform("marks", lambda m: _context(m, run, gram))).alias("m")).select("doc_id", "th", "m.*")
    hits = places.join(shared, "f")
    reach = run - gram
    # the runs through a fingerprint start at p - reach .. p; `left` lines of the context lie before p
    starts = F.sequence(F.greatest(F.col("left") - reach, F.lit(0)), F.least(F.col("left"), F.size("ca") - run))
    runs = hits.where(F.size("ca") >= run).withColumn("j", F.explode(starts))
    key = [F.xxhash64(*[F.get(c, F.col("j") + k) for k in range(run)]).alias(n) for c, n in (("ca", "ka"), ("cb", "kb"))]
    runs = runs.select("doc_id", "th", (F.col("p") - F.col("left") + F.col("j")).alias("start"), F.lit(run).alias("size"), *key, F.lit(True).alias("due")).distinct()
    if short_bytes is not None:
        runs = runs.unionByName(_short_runs(rows, run, short_bytes))
    runs = materialize(runs, "lines-runs")
    firsts = runs.groupBy("size", "ka", "kb").agg(F.min(F.struct("doc_id", "th", "start")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("due").alias("any")).where("n > 1 and any").drop("n", "any")
    later = runs.where("due").join(firsts, ["size", "ka", "kb"]).where(F.struct("doc_id", "th", "start") > F.col("first"))
    gone = later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    place = lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1)
    return gone.join(rows.select("doc_id", "th", "lines"), ["doc_id", "th"]).select("doc_id", "th", F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("runs", place))), lambda i: F.get("lines", i))).alias("gone"))


def _context(m: Column, run: int, gram: int) -> Column:
    """f, p, left, ca, cb: a mark with the line hashes within run - gram places on both sides, and how many come before."""
    p, reach = m["p"], run - gram
    first = F.greatest(p - reach, F.lit(0))
    width = p + gram + reach - first
    return F.struct(m["f"].alias("f"), p.alias("p"), (p - first).alias("left"), F.slice(F.col("a"), first + 1, width).alias("ca"), F.slice(F.col("b"), first + 1, width).alias("cb"))


def remove_repeated_lines(docs: DataFrame, run: int = RUN, gram: int = GRAM, short_bytes: int | None = SHORT_BYTES) -> DataFrame:
    """Every row of docs with n_lines, n_removed and kept_text: the text without each line that lies in a run of `run` or
    more lines which also stands earlier, in the same text or one of a smaller doc_id. Also each line of a shorter run that
    stands earlier and holds short_bytes bytes or more, or is all of its text; with short_bytes None shorter runs stay.

    Lines are compared without white space at their ends; blank lines neither count nor break a run and stay. Null texts give
    null kept_text and no lines; rows with a null doc_id are kept whole and take nothing from others. Rows equal in doc_id and
    text are one document, treated alike; two texts under one doc_id are ordered by a hash. An empty table gives no rows;
    input columns named like an output are replaced."""
    outputs = ("n_lines", "n_removed", "kept_text")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in outputs])
    gone = repeated_lines(docs, run, gram, short_bytes).withColumnsRenamed({"doc_id": "_tl_d", "th": "_tl_h", "gone": "_tl_gone"})
    both = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_tl_d")) & (F.xxhash64("text") == F.col("_tl_h")), "left")
    lines = F.split("text", "\n", -1)
    n = F.coalesce(F.size("_tl_gone"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_tl_gone"))
    kept = F.when(F.col("_tl_gone").isNull(), F.col("text")).otherwise(let(lines, lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")))
    counted = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")))
    return both.withColumns({"n_lines": counted.cast("long"), "n_removed": F.when(F.col("_tl_gone").isNull(), 0).otherwise(n).cast("long"), "kept_text": kept}).drop("_tl_d", "_tl_h", "_tl_gone")
