"""Benchmark decontamination by the q-gram lemma: shared character q-grams are counted in overlapping bands of diagonals,
regions that meet the edit budget's bound are kept, and each is verified by banded alignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .textcore import BASE, INVERSE, U, mix, powers

Q = 12
#: Edits allowed per character of a benchmark item.
ERROR_RATE = 0.05
#: Characters of benchmark items that one pass over the documents looks for.
BLOCK_CHARS = 4_000_000
#: Shared q-grams of a text and the items that are counted at once.
MATCHES = 1 << 20
_FILTER_BITS = 22
HIT = "doc_id long, item_id long, start_char long, end_char long, n_edits long, item_chars long"


def _normal_table() -> np.ndarray:
    """Code point -> lower-case letter or digit, or a space for all others (of the first 65,536; later ones stay)."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


_NORMAL = _normal_table()
_VALUE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text in lower case with every run of other characters as one space, none at the ends; and the
    place of each in the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = raw < 1 << 16
    code = np.where(low, _NORMAL[np.where(low, raw, 0)], raw)
    gap = code == 32
    keep = ~gap
    if len(code):
        keep[1:] |= gap[1:] & ~gap[:-1]
    at = np.flatnonzero(keep)
    code = code[at]
    lo, hi = int(len(code) > 0 and code[0] == 32), len(code) - int(len(code) > 1 and code[-1] == 32)
    return code[lo:hi], at[lo:hi]


def gram_hashes(code: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash for each window of q characters."""
    if len(code) < q:
        return np.empty(0, np.uint64)
    p = np.empty(len(code) + 1, np.uint64)
    p[0] = 0
    np.cumsum((_VALUE[code & 0xFFFF] + (code >> 16).astype(np.uint64)) * powers(BASE, len(code)), out=p[1:])
    return (p[q:] - p[:-q]) * powers(INVERSE, len(code))[: len(code) - q + 1]


@dataclass
class Index:
    """The q-grams of a block of benchmark items, sorted by hash, with a bit table that drops most other q-grams; and items of
    fewer than Q characters by length, as (hash, item_id, code)."""

    ids: list
    codes: list
    budgets: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    at: np.ndarray
    bits: np.ndarray
    short: dict


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * U(0xD6E8FEB86659FD93)) >> U(64 - _FILTER_BITS)).astype(np.int64)


def build_index(items: list[tuple], error_rate: float = ERROR_RATE) -> Index:
    """items: (item_id, text). Items that are null or have no letter or digit are left out. The budget of an item is
    error_rate of its length, less where the lemma would ask for no shared q-gram at all; items of fewer than Q characters
    after normalise() have none and are looked for as they are."""
    ids, codes, budgets, grams, item, at, short = [], [], [], [], [], [], {}
    for item_id, text in items:
        code = normalise(text)[0] if text is not None else np.empty(0, np.uint32)
        if len(code) >= Q:
            g = gram_hashes(code)
            ids.append(item_id)
            codes.append(code)
            budgets.append(min(int(error_rate * len(code)), (len(code) - Q) // Q))
            grams.append(g)
            item.append(np.full(len(g), len(ids) - 1))
            at.append(np.arange(len(g)))
        elif len(code):
            short.setdefault(len(code), []).append((gram_hashes(code, len(code))[0], item_id, code))
    if not ids:
        return Index([], [], np.empty(0, int), np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int), np.zeros(1 << _FILTER_BITS, bool), short)
    grams = np.concatenate(grams)
    order = np.argsort(grams, kind="stable")
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[_slot(grams)] = True
    return Index(ids, codes, np.array(budgets), grams[order], np.concatenate(item)[order], np.concatenate(at)[order], bits, short)


def align(item: np.ndarray, region: np.ndarray, shift: int, low: int, high: int) -> tuple[int, int, int]:
    """Least edits that turn item into a part of region, over alignments whose diagonals (place in region + shift, less place
    in item) stay within low..high; with that part's start and end in region. Cells outside the band are never filled."""
    width, far = high - low + 1, len(item) + len(region) + 1
    offset = np.arange(width)
    col = offset + low - shift  # place in region of band cell 0.. for row 0
    cost = np.where((col >= 0) & (col <= len(region)), 0, far)
    start = col.copy()
    for i in range(1, len(item) + 1):
        col = offset + low - shift + i
        ok = (col >= 1) & (col <= len(region))
        same = np.zeros(width, bool)
        same[ok] = region[col[ok] - 1] == item[i - 1]
        diagonal = np.where(ok, cost + ~same, far)
        above = np.append(cost[1:], far) + 1
        new_start = np.where(diagonal <= above, start, np.append(start[1:], 0))
        best = np.where((col >= 0) & (col <= len(region)), np.minimum(diagonal, above), far)
        slope = best - offset
        run = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == run, offset, 0))
        cost, start = np.minimum(run + offset, far), new_start[source]
        cost = np.where((col >= 0) & (col <= len(region)), cost, far)
    j = int(np.argmin(cost))
    return int(cost[j]), int(start[j]), int(j + low - shift + len(item))


def _bands(h: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Keys (item, band) and how many q-grams of the text each shares. Band b of an item holds diagonals b * step ..
    (b + 2) * step - 1, where step is its budget + 1: any step consecutive diagonals lie within a band. About MATCHES shared
    q-grams are expanded at once, so repetitive texts need no more memory than others."""
    near = np.flatnonzero(index.bits[_slot(h)])
    lo, hi = np.searchsorted(index.grams, h[near], "left"), np.searchsorted(index.grams, h[near], "right")
    n = hi - lo
    near, lo, n = near[n > 0], lo[n > 0], n[n > 0]
    size, step = np.array([len(c) for c in index.codes], np.int64), index.budgets + 1
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    through = np.cumsum(n)
    at = 0
    while at < len(near):
        end = max(at + 1, int(np.searchsorted(through, (through[at - 1] if at else 0) + MATCHES, "right")))
        m = n[at:end]
        entry = np.repeat(lo[at:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        item, diagonal = index.item[entry], np.repeat(near[at:end], m) - index.at[entry]
        band = (diagonal + size[item]) // step[item]
        found, c = np.unique(np.concatenate([item, item]) * (1 << 40) + np.concatenate([band, band - 1]) + 1, return_counts=True)
        if at:
            found, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
            c = np.bincount(back, np.concatenate([counts, c])).astype(np.int64)
        keys, counts, at = found, c, end
    return keys, counts


def _short_hits(code: np.ndarray, index: Index):
    """(item_id, start, end) of the first place of each short item between word ends; scripts without spaces between words
    (from U+2E80 on) may stand anywhere."""
    free = lambda x, i: i < 0 or i >= len(code) or code[i] == 32 or x >= 0x2E80
    for m, items in index.short.items():
        h = gram_hashes(code, m)
        for want, item_id, item in items:
            for s in np.flatnonzero(h == want).tolist():
                if free(item[0], s - 1) and free(item[-1], s + m) and (code[s : s + m] == item).all():
                    yield item_id, s, s + m
                    break


def search(text: str, index: Index) -> list[tuple]:
    """(item_id, start_char, end_char, n_edits, item_chars) for the best region of every item found in the text."""
    code, place = normalise(text)
    found: dict[int, tuple] = {}
    keys, counts = _bands(gram_hashes(code), index) if index.ids else (np.empty(0, np.int64),) * 2
    for key, c in zip(keys.tolist(), counts.tolist(), strict=True):
        i, b = key >> 40, (key & ((1 << 40) - 1)) - 1
        m, k = len(index.codes[i]), int(index.budgets[i])
        # bands come in order of place, so nothing better follows a region without edits
        if c < m + 1 - Q * (k + 1) or i in found and found[i][0] == 0:
            continue
        low = b * (k + 1) - m
        high = low + 2 * (k + 1) - 1
        first = max(0, low - k)
        region = code[first : max(first, high + m + k)]
        edits, s, e = align(index.codes[i], region, first, low, high)
        if edits <= k and (i not in found or (edits, first + s) < found[i][:2]):
            found[i] = (edits, first + s, first + e)
    hits = [(index.ids[i], s, e, edits, len(index.codes[i])) for i, (edits, s, e) in found.items()]
    hits += [(item_id, s, e, 0, e - s) for item_id, s, e in _short_hits(code, index)]
    return [(item_id, int(place[s]), int(place[max(e, s + 1) - 1]) + 1, edits, chars) for item_id, s, e, edits, chars in hits]


def _blocks(benchmark: DataFrame, error_rate: float, block_chars: int):
    """(index, number of blocks) for each block of items. A hash of the item deals it to a block, so blocks hold about block_chars each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(total) // block_chars))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == i) if n > 1 else items
        yield build_index([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").toLocalIterator()], error_rate), n


def find(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """HIT rows: each document row and benchmark item such that a part of the text is within the item's edit budget, with the
    best part (fewest edits, then first) as character places in the text.

    Every row of docs is searched whole for every item; the items go to the tasks in blocks of about block_chars, one pass
    over the documents a block. With several blocks each pass is written before the next one's index is made, so a larger benchmark
    takes more passes and not more memory, of tasks or of the driver, which holds one block. Null and empty texts have no
    hits, repeated rows have each their hits, null ids are returned as they are, an empty table on either side gives none."""

    def run(index: Index):
        def task(batches):
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if t for hit in search(t, index)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in HIT.split(", ")])

        return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, HIT)

    out = None
    for index, n in _blocks(benchmark, error_rate, block_chars):
        hits = materialize(run(index), "hits") if n > 1 else run(index)
        out = hits if out is None else out.unionByName(hits)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs without a hit, all columns as they are; rows with null or empty texts stay. Of several blocks each leaves a
    written table of what it kept."""
    at = docs.columns.index("text")

    def run(df: DataFrame, index: Index) -> DataFrame:
        def task(batches):
            for b in batches:
                yield b.filter(pa.array([not (t and search(t, index)) for t in b.column(at).to_pylist()], pa.bool_()))

        return map_batches(df, task, df.schema)

    for index, n in _blocks(benchmark, error_rate, block_chars):
        docs = materialize(run(docs, index), "clean") if n > 1 else run(docs, index)
    return docs
