"""Long texts cut into segments of bounded size: at headings, then paragraphs and sentences, then evenly sampled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import lines, once, strip

CHARS, MOST = 5000, 5
STRINGS = "array<string>"


def blocks(x: Column) -> Column:
    """Parts that begin at headings; parts under noise headings (references and the like) are dropped."""

    def step(acc: Column, ln: Column) -> Column:
        start = strip(ln).rlike(r"^#{1,4}\s") & acc["open"]
        return F.struct(
            F.when(start, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(start | ~acc["open"], ln).otherwise(F.concat(acc["cur"], F.lit("\n"), ln)).alias("cur"),
            F.lit(True).alias("open"),
        )

    zero = F.struct(F.array().cast(STRINGS).alias("done"), F.lit("").alias("cur"), F.lit(False).alias("open"))
    parts = F.aggregate(lines(x), zero, step, lambda a: F.concat(a["done"], F.array(a["cur"])))
    parts = F.filter(F.transform(parts, strip), lambda b: b != "")
    return F.filter(parts, lambda b: ~F.substring_index(b, "\n", 1).rlike("(?i)" + fixed.NOISE_HEADING))


def _pack(pieces: Column, limit: int, glue: str) -> Column:
    """Neighbouring pieces joined as long as they fit."""

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["cur"]) + len(glue) + F.length(p) <= limit
        empty = acc["cur"] == ""
        return F.struct(
            F.when(empty | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"),
            F.when(empty, p).when(fits, F.concat(acc["cur"], F.lit(glue), p)).otherwise(p).alias("cur"),
        )

    zero = F.struct(F.array().cast(STRINGS).alias("done"), F.lit("").alias("cur"))
    return F.aggregate(pieces, zero, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def _chopped(s: Column, limit: int) -> Column:
    n = F.greatest(F.ceil(F.length(s) / limit).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(s, i * limit + 1, F.lit(limit)))


def sentences(x: Column, limit: int) -> Column:
    """Sentences packed to at most limit characters; longer ones are chopped."""
    found = F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"([^。！？!?；;\n]+[。！？!?；;]?)"), F.lit(1)), strip), lambda s: s != "")
    return _pack(F.flatten(F.transform(found, lambda s: _chopped(s, limit))), limit, "")


def paragraphs(block: Column, limit: int) -> Column:
    """A block as it is if it fits, else its paragraphs (or their sentences) packed."""
    paras = F.filter(F.split(block, r"\n\s*\n"), lambda p: strip(p) != "")
    pieces = F.flatten(F.transform(paras, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(sentences(p, limit))))
    return F.when(F.length(block) <= limit, F.array(block)).otherwise(_pack(pieces, limit, "\n\n"))


def even_sample(segs: Column, most: int) -> Column:
    """`most` segments at even distances, first and last included; places round half to even."""
    step = (F.size(segs) - 1) / (most - 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * step).cast("int"))
    return F.when(F.size(segs) <= most, segs).otherwise(F.transform(places, lambda p: F.get(segs, p)))


def segment(x: Column, limit: int = CHARS, most: int = MOST) -> Column:
    """At most `most` segments of at most `limit` characters; none for a blank text."""

    def cut(t: Column) -> Column:
        chunks = F.flatten(F.transform(blocks(t), lambda b: paragraphs(b, limit)))
        return F.when(t == "", F.array().cast(STRINGS)).when(F.length(t) <= limit, F.array(t)).otherwise(once(_pack(chunks, limit, "\n\n"), lambda s: even_sample(s, most)))

    return once(strip(F.coalesce(x, F.lit(""))), cut)


def coverage(x: Column, segs: Column) -> Column:
    """Share of a text's characters that its segments hold; 1.0 for a blank text."""
    total = F.length(strip(F.coalesce(x, F.lit(""))))
    return F.when(total > 0, F.least(F.lit(1.0), F.aggregate(segs, F.lit(0), lambda a, s: a + F.length(s)) / total)).otherwise(1.0)


def trim(x: Column, limit: int = CHARS) -> Column:
    """A text over `limit` characters cut to its first 60 % and last 40 %, with a mark between."""
    head = int(limit * 0.6)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, head), F.lit("\n\n...(中间略)...\n\n"), F.right(x, F.lit(limit - head))))

