"""Quality rules as a bitmask ledger: every rule is measured once a document, failures are bits of one integer,
and versioned policies and ablations are bit operations on that ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, fresh, let, word_array

#: Rule name -> bit. Bits are never reused, so ledgers written by older versions stay readable.
BITS = {
    "few_words": 0,
    "repeated_windows": 1,
    "symbols": 2,
    "duplicate_lines": 3,
    "shouting": 4,
    "word_length": 5,
}

#: Policy version -> rules whose failure rejects a document. "base" holds the two rules that always reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "word_length"),
}


#: Bits of a window's hash at most; the length of the text takes the low ones.
HASH_BITS = 64


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbols_per_100_words: int = 100
    max_duplicate_line_pct: int = 50
    max_upper_pct: int = 50
    min_word_chars: int = 2
    max_word_chars: int = 20


def policy_mask(version: str) -> int:
    return sum(1 << BITS[r] for r in POLICIES[version])


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Each window becomes one long: hash above, position in the low bits. After one primitive sort equal windows are
    neighbours; equal hash bits are confirmed on the words themselves. Where different windows of a text have equal hash
    bits, its windows are sorted by their words instead, so the work grows as n log n however many hashes collide."""

    def shift_of(ws: Column) -> Column:
        return F.greatest(F.length(F.bin(F.size(ws).cast("long"))), F.lit(64 - HASH_BITS))

    def windows(ws: Column, shift: Column) -> Column:
        keep = F.expr("-1L")

        def pack(w: Column, i: Column) -> Column:
            h = F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))
            return F.call_function("shiftleft", F.call_function("shiftright", h, shift), shift).bitwiseOR(i.cast("long")).bitwiseAND(keep)

        return F.sort_array(F.transform(F.slice(ws, F.lit(1), F.size(ws) - 2), pack))

    def count(ws: Column) -> Column:
        return let(shift_of(ws), lambda shift: let(windows(ws, shift), lambda s: covered(ws, shift, s)))

    def position(x: Column, shift: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1).cast("int")

    def alike(shift: Column, x: Column, y: Column) -> Column:
        return F.call_function("shiftrightunsigned", x.bitwiseXOR(y), shift) == 0

    def exact(ws: Column, p: Column, q: Column) -> Column:
        return (F.get(ws, p) == F.get(ws, q)) & (F.get(ws, p + 1) == F.get(ws, q + 1)) & (F.get(ws, p + 2) == F.get(ws, q + 2))

    def sorted_windows(ws: Column) -> Column:
        """Windows as text (words hold no spaces) with their places, in order."""
        window = lambda w, i: F.struct(F.concat_ws(" ", w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("w"), i.cast("int").alias("at"))
        return F.sort_array(F.transform(F.slice(ws, F.lit(1), F.size(ws) - 2), window))

    def same(t: Column, x: Column, k: Column) -> Column:
        return F.when((k >= 0) & (k < F.size(t)), F.get(t, k)["w"] == x["w"]).otherwise(False)

    def spans(places: Column) -> Column:
        """Words of the windows at the given places, ascending."""
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x))

    def covered(ws: Column, shift: Column, s: Column) -> Column:
        beside = lambda x, i, k: alike(shift, x, F.get(s, i + k))
        twins = F.filter(s, lambda x, i: (i > 0) & beside(x, i, -1))
        unlike = F.filter(s, lambda x, i: (i > 0) & beside(x, i, -1) & ~exact(ws, position(x, shift), position(F.get(s, i - 1), shift)))
        either = F.filter(s, lambda x, i: ((i > 0) & beside(x, i, -1)) | ((i + 1 < F.size(s)) & beside(x, i, 1)))
        by_hash = spans(F.sort_array(F.transform(either, lambda x: position(x, shift))))
        by_words = let(sorted_windows(ws), lambda t: spans(F.sort_array(F.transform(F.filter(t, lambda x, i: same(t, x, i - 1) | same(t, x, i + 1)), lambda x: x["at"]))))
        return F.when(F.size(twins) == 0, F.lit(0)).when(F.size(unlike) == 0, by_hash).otherwise(by_words)

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, count)).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters and
    n_upper (long). Null and empty texts measure 0 everywhere; every row, repeated or not, is measured by itself;
    an input column with an output's name is replaced."""
    w, ln = fresh(docs, "words", "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({w: word_array(F.col(text_col)), ln: F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")})
    return out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size(ln).cast("long"),
            "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
            "n_repeat_words": _repeat_words(F.col(w)),
            "n_letters": F.regexp_count(text, F.lit("[A-Za-z]")).cast("long"),
            "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        }
    ).drop(w, ln)


def failures(limits: Limits = Limits()) -> dict[str, Column]:
    """Rule -> condition under which it fails, on the measurements alone."""
    c = F.col
    return {
        "few_words": c("n_words") < limits.min_words,
        "repeated_windows": 100 * c("n_repeat_words") > limits.max_repeat_pct * c("n_words"),
        "symbols": 100 * c("n_symbols") > limits.max_symbols_per_100_words * c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > limits.max_duplicate_line_pct * c("n_lines"),
        "shouting": 100 * c("n_upper") > limits.max_upper_pct * c("n_letters"),
        "word_length": (c("word_chars") < limits.min_word_chars * c("n_words")) | (c("word_chars") > limits.max_word_chars * c("n_words")),
    }


def ledger(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """measure() plus fail_mask (long): bit b is set if the rule of that bit fails. No row is dropped."""
    mask = F.lit(0).cast("long")
    for rule, fails in failures(limits).items():
        mask = mask.bitwiseOR(F.when(fails, F.lit(1 << BITS[rule]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, text_col).withColumn("fail_mask", mask)


def apply_policy(ledger_df: DataFrame, version: str = "v2") -> DataFrame:
    """Adds base_failed and kept (boolean) and policy (string); kept is false where a rule of the policy fails."""
    bad = lambda v: F.col("fail_mask").bitwiseAND(F.lit(policy_mask(v)).cast("long")) != 0
    return ledger_df.withColumn("base_failed", bad("base")).withColumn("kept", ~bad("base") & ~bad(version)).withColumn("policy", F.lit(version))


def ablations(ledger_df: DataFrame, version: str = "v2") -> DataFrame:
    """One row a rule of the policy: documents that fail it, that fail it alone, and that the policy would keep without it.

    One pass: distinct masks are counted first (at most 2^rules rows, partial counts on the map side), the rest is bit work."""
    full = policy_mask(version)
    masks = ledger_df.groupBy(F.col("fail_mask").bitwiseAND(F.lit(full).cast("long")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in POLICIES[version]])
    per = masks.select("n", "mask", F.explode(rules).alias("r")).select("n", "mask", "r.rule", "r.bit")
    return per.groupBy("rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_fail_alone"),
        F.sum(F.when(F.col("mask").bitwiseAND(F.lit(full).cast("long") - F.col("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
