"""Repeated substrings across documents by suffix sorting: suffixes are dealt to buckets by content, each bucket is sorted by a
mergesort whose comparisons find common extensions with prefix polynomial hashes and binary search, and bytes confirm what
hashes say.

A string of LENGTH bytes is owned by its least GRAM-byte substring (by hash, leftmost of ties), its anchor. Equal strings
have equal anchors at equal places, so only suffixes that start with strings of one anchor need to be compared. Anchors that
occur once only are dropped before any text moves; of the others a segment moves: the bytes of all
neighbouring strings that one anchor place owns, fewer than 2 * LENGTH of them. Equal segments become one before the sort.
Anchors of many places are dealt to several buckets by the content of their strings, so that no bucket is large.

In a bucket what follows the anchors is sorted, and so is what precedes them, backwards; two strings are equal if both their
parts are. Texts are held in blocks of some megabytes and buckets in parts; what a block has for a part moves as one row of packed
arrays, and so does the part's answer to it. A block has its texts again when answers come, so texts don't move with them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_cogroups, map_groups, materialize, new_path, partitions_for, released_shuffles
from .textcore import INVERSE, U, mix, powers, prefix

LENGTH = 50
GRAM = 24
#: Places of an anchor up to which its segments are one bucket; the strings of an anchor of more places are dealt by content to
#: buckets of about as many strings.
BUCKET_ROWS = 10_000
#: Bytes of text of a block, about; there are as many parts as blocks, and as many as shuffle partitions at least.
BLOCK = 16 << 20
#: Strings of a text looked at at once.
PIECE = 4 << 20
#: Bytes of small texts that are looked at together.
GROUP = 1 << 15
_AT_BITS = 24
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray(max(0, len(b) - 7), np.uint64, b if len(b) > 7 else np.zeros(8, np.uint8), 0, (1,))


def _stir(h: np.ndarray, shift: int, odd: int) -> None:
    h ^= h >> U(shift)
    h *= U(odd)


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each string of gram bytes, 8 at least."""
    w, n = _words(b).copy(), len(b) - gram + 1
    h = w[:n] * U(_ODD[0])
    for at in [*range(8, gram - 8, 8), gram - 8]:
        h ^= h >> U(32)
        h += w[at : at + n]
        h *= U(_ODD[1])
    _stir(h, 29, _ODD[2])
    h ^= h >> U(32)
    return h


def _piece_hashes(b: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """A hash for each b[start : start + size], of 8 to `most` bytes; equal for equal bytes wherever they stand."""
    w, h = _words(b), size.astype(np.uint64)
    for at in range(0, most, 8):
        _stir(h, 32, _ODD[1])
        h += w[start + np.minimum(at, size - 8)]
        h *= U(_ODD[0])
    return mix(h)


def _anchor_places(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every gram, and for every string of `length` bytes the place of its anchor."""
    h = _gram_hashes(b, gram)
    low = U((1 << _AT_BITS) - 1)
    least = h & ~low
    least |= np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return h, (least & low).view(np.int64)


def anchor_runs(texts: list[np.ndarray], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """The runs of neighbouring strings with one anchor place of all texts: text, start of the first, number of strings, anchor less
    start, hash as five arrays; none of texts shorter than length. Small texts are looked at together, long ones in pieces."""
    out = [(np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)]

    def together(b: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray, top: int = 0):
        h, at = _anchor_places(b, length, gram)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        new[begin[begin < len(at)]] = True
        first = np.flatnonzero(new)
        own, after = np.searchsorted(end, first, "right"), np.append(first[1:], len(at))
        keep = first + length <= end[own]
        first, own, after = first[keep], own[keep], after[keep]
        place = at[first]
        out.append((text[own], first - begin[own] + top, np.minimum(after, end[own] - length + 1) - first, place - first, h[place]))

    def flush(group: list[int]):
        size = np.array([len(texts[i]) for i in group])
        end = np.cumsum(size)
        together(np.concatenate([texts[i] for i in group]), end - size, end, np.array(group))

    group: list[int] = []
    held = 0
    for i, b in enumerate(texts):
        if len(b) < length:
            continue
        if group and held + len(b) > GROUP:  # texts stay in order
            flush(group)
            group, held = [], 0
        if len(b) <= GROUP:
            group.append(i)
            held += len(b)
            continue
        for top in range(0, len(b) - length + 1, PIECE):
            piece = b[top : top + PIECE + length - 1]
            together(piece, np.zeros(1, np.int64), np.array([len(piece)]), np.array([i]), top)
    if group:
        flush(group)
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[start:start + size] of all pieces, one behind the other."""
    end = np.cumsum(size)
    return raw[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted table's runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _part(h: np.ndarray, n: int) -> np.ndarray:
    """One of n equal ranges of hashes, by their upper halves."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


_ROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("more", pa.int64()), ("packed", pa.binary())])
_ROW_DDL = "part int, block int, n long, more long, packed binary"


def _pack(arrays) -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(rows: pa.Table, kinds: list[tuple]) -> list[list[np.ndarray]]:
    """Of each row its arrays. kinds: (type, what says how many there are: "n", "more" or the place of an array that sums up to it)."""
    out = []
    for n, more, packed in zip(rows["n"].to_pylist(), rows["more"].to_pylist(), rows["packed"].to_pylist(), strict=True):
        raw, at, arrays = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), 0, []
        for kind, many in kinds:
            count = {"n": n, "more": more}[many] if isinstance(many, str) else int(arrays[many].sum())
            arrays.append(np.frombuffer(raw, kind, count, at))
            at += arrays[-1].nbytes
        out.append(arrays)
    return out


def _together(rows: list[list[np.ndarray]], kinds: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.empty(0, k) for k, _ in kinds]


def _table(part, block, n, more, packed) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip((part, block, n, more, packed), _ROW, strict=True)], _ROW)


def _block(texts: pa.Table):
    """A block's texts in order of their ids: doc_id, th, bytes."""
    doc, th, raws = texts["doc_id"].to_numpy(), texts["th"].to_numpy(), []
    for c in texts["text"].chunks:
        kind = np.int64 if pa.types.is_large_string(c.type) else np.int32
        at = np.frombuffer(c.buffers()[1], kind)[c.offset : c.offset + len(c) + 1].tolist()
        raw = np.frombuffer(c.buffers()[2], np.uint8)
        raws += [raw[x:y] for x, y in zip(at, at[1:])]
    order = np.lexsort((th, doc))
    return doc[order], th[order], [raws[i] for i in order.tolist()]


_ANCHORS = [(np.uint32, "n"), (np.int32, "n"), (np.uint8, "n")]
_ANSWERED = [(np.uint8, "n")]


def _anchors(texts: pa.Table, length: int, slots: list[int]) -> pa.Table:
    """The anchors of a block, each once with the number of its places and whether several texts have it: a row for each part, which
    tells them apart by the lower halves of their hashes."""
    who, *_, h = anchor_runs(_block(texts)[2], length)
    order = np.argsort(h)
    who, h = who[order], h[order]
    head = _heads(h)
    several = (np.maximum.reduceat(who, head) > np.minimum.reduceat(who, head)).astype(np.uint8)
    places, h = np.diff(np.r_[head, len(h)]), h[head]
    cut = np.searchsorted(_part(h, len(slots)), np.arange(len(slots) + 1))
    parts = np.flatnonzero(np.diff(cut))
    low, places = h.astype(np.uint32), np.minimum(places, (1 << 31) - 1).astype(np.int32)
    packed = [_pack([x[cut[p] : cut[p + 1]] for x in (low, places, several)]) for p in parts]
    block = texts["block"][0].as_py()
    return _table([slots[p] for p in parts], [block] * len(parts), np.diff(cut)[parts], [0] * len(parts), packed)


def _shared(rows: pa.Table, bucket_rows: int, width: int) -> pa.Table:
    """Answers a part's blocks: of each of their anchors 0 if no other text has it, else 1 + log2 of the number of its buckets."""
    sizes = rows["n"].to_numpy()
    low, places, several = _together(_unpack(rows, _ANCHORS), _ANCHORS)
    order = np.sort(low.astype(np.uint64) << U(32) | np.arange(len(low), dtype=np.uint64)).astype(np.uint32)
    head = _heads(low[order])
    n = np.diff(np.r_[head, len(low)])
    total = np.add.reduceat(places[order].astype(np.int64), head)
    common = (n > 1) | np.maximum.reduceat(several[order], head).astype(bool)
    # cut into strings, a place gives at most `width` rows
    buckets = np.where(total > bucket_rows, np.ceil(np.log2(np.maximum(1, total * width / bucket_rows))), 0)
    answer = np.empty(len(low), np.uint8)
    answer[order] = np.repeat(np.where(common, 1 + buckets, 0).astype(np.uint8), n)
    end = np.cumsum(sizes)
    return _table(rows["part"].to_numpy(), rows["block"].to_numpy(), sizes, [0] * len(sizes), [_pack([answer[e - n : e]]) for e, n in zip(end, sizes, strict=True)])


#: Of a segment: bucket, anchor less start, size, hash, first doc_id, number of places; then text and start of each place, and bytes.
_SEGMENTS = [(np.uint32, "n"), (np.uint8, "n"), (np.uint8, "n"), (np.uint64, "n"), (np.int64, "n"), (np.uint32, "n"), (np.uint32, "more"), (np.uint32, "more"), (np.uint8, 2)]
#: Of a segment: doc_id of the first that holds it, the strings of it that are older still, its size, number of places; text and start of each.
_MASKS = [(np.int64, "n"), (np.int64, "n"), (np.uint8, "n"), (np.uint32, "n"), (np.uint32, "more"), (np.uint32, "more")]


def _segments(texts: pa.Table, answers: pa.Table, length: int, slots: list[int]) -> pa.Table:
    """The segments of a block's shared anchors, equal ones once with all their places. Those of an anchor with several buckets are
    cut into their single strings, which go to a bucket by their hash."""
    doc, _, raws = _block(texts)
    who, start, count, at, h = anchor_runs(raws, length)
    order = np.argsort(h)
    head = _heads(h[order])
    (answer,) = _together(_unpack(answers.sort_by("part"), _ANSWERED), _ANSWERED)
    buckets = np.empty(len(h), np.uint8)
    buckets[order] = np.repeat(answer, np.diff(np.r_[head, len(h)]))
    keep = buckets > 0
    who, start, count, at, h, buckets = (x[keep] for x in (who, start, count, at, h, buckets))
    if (buckets > 1).any():
        each = np.where(buckets > 1, count, 1)
        j = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        who, start, count, at, h, buckets = (np.repeat(x, each) for x in (who, start, count, at, h, buckets))
        start, at, count = start + j, at - j, np.where(buckets > 1, 1, count)
    size = count + length - 1
    raw = np.concatenate([*raws, np.empty(0, np.uint8)])
    place = (np.cumsum([0, *map(len, raws)])[:-1])[who] + start if len(raws) else start
    sh = _piece_hashes(raw, place, size, 2 * length - GRAM)
    key = mix(h + (sh & ((U(1) << (np.maximum(buckets, 1) - 1).astype(np.uint64)) - U(1))) * U(_ODD[0]))
    order = np.lexsort((at, sh, key))
    who, start, at, key, sh, size, place = (x[order] for x in (who, start, at, key, sh, size, place))
    head = _heads(key, sh, at)
    n = np.diff(np.r_[head, len(key)])
    at, key, sh, size, place, first = at[head], key[head], sh[head], size[head], place[head], doc[who[head]]
    cut = np.searchsorted(_part(key, len(slots)), np.arange(len(slots) + 1))
    places = np.r_[head, len(who)]
    parts, packed, more = np.flatnonzero(np.diff(cut)), [], []
    for p in parts:
        x, y = slice(cut[p], cut[p + 1]), slice(places[cut[p]], places[cut[p + 1]])
        packed.append(_pack([key[x].astype(np.uint32), at[x].astype(np.uint8), size[x].astype(np.uint8), sh[x], first[x], n[x].astype(np.uint32), who[y].astype(np.uint32), start[y].astype(np.uint32), _gather(raw, place[x], size[x])]))
        more.append(y.stop - y.start)
    block = texts["block"][0].as_py()
    return _table([slots[p] for p in parts], [block] * len(parts), np.diff(cut)[parts], more, packed)


def _least(rows: pa.Table, length: int, most: int = 20_000) -> pa.Table:
    """Answers a part's blocks: the first text that holds a segment, and which of its strings start in an earlier one. Whole buckets
    are sorted, about `most` distinct segments at a time."""
    each = _unpack(rows, _SEGMENTS)
    bucket, at, size, sh, first, n, who, start, raw = _together(each, _SEGMENTS)
    size = size.astype(np.int64)
    begin = np.cumsum(size) - size
    order = np.lexsort((first, at, sh, bucket))
    new = np.zeros(len(order), bool)
    new[_heads(*(x[order] for x in (bucket, sh, at, size)))] = True
    a, b = order[:-1][~new[1:]], order[1:][~new[1:]]
    if len(a):  # bytes confirm what hashes say
        differ = np.add.reduceat(_gather(raw, begin[a], size[a]) != _gather(raw, begin[b], size[b]), np.cumsum(size[a]) - size[a])
        new[1:][np.flatnonzero(~new[1:])[differ > 0]] = True
    lead = order[new]
    mask = np.zeros(len(lead), np.int64)
    heads = np.r_[_heads(bucket[lead]), len(lead)]
    several = np.repeat(np.diff(heads) > 1, np.diff(heads))
    done = 0
    while done < len(lead):
        end = int(heads[np.searchsorted(heads, min(done + most, len(lead)))])
        some = done + np.flatnonzero(several[done:end])
        if len(some):
            k = lead[some]
            mask[some] = later_strings(_gather(raw, begin[k], size[k]), size[k], bucket[k].astype(np.int64), at[k].astype(np.int64), first[k], length)
        done = end
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    oldest, mask = (first[lead][own], mask[own]) if len(own) else (first, mask)
    keep = (mask != 0) | (oldest < first) | (n > 1)
    packed, counts, more = [], [], []
    k = np.cumsum([0, *(len(x[0]) for x in each)])
    for i, x in enumerate(each):
        s = keep[k[i] : k[i + 1]]
        y = np.repeat(s, x[5])
        z = slice(k[i], k[i + 1])
        packed.append(_pack([oldest[z][s], mask[z][s], x[2][s], x[5][s], x[6][y], x[7][y]]))
        counts.append(int(s.sum()))
        more.append(int(y.sum()))
    return _table(rows["part"].to_numpy(), rows["block"].to_numpy(), counts, more, packed)


class _Suffixes:
    """Strings of `length` bytes at given places of a buffer, compared by hash with the bytes as witness."""

    def __init__(self, raw: np.ndarray, place: np.ndarray, length: int):
        self.raw, self.place, self.length = raw, place, length
        self.hash, self.back = prefix(raw), powers(INVERSE, len(raw) + 1)
        self.view = np.lib.stride_tricks.sliding_window_view(raw, length)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings x and y, at most `length`, by binary search over prefix hashes."""
        a, b = self.place[x], self.place[y]
        ha, hb, ia, ib = self.hash[a], self.hash[b], self.back[a], self.back[b]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        for _ in range(int(self.length).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.hash[a + mid] - ha) * ia == (self.hash[b + mid] - hb) * ib
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair."""
        n = self.extension(x, y)
        k = np.minimum(n, self.length - 1)
        a, b = self.raw[self.place[x] + k].astype(np.int16), self.raw[self.place[y] + k].astype(np.int16)
        return np.where(n >= self.length, 0, np.sign(a - b))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of all strings by (group, bytes). Bottom-up mergesort of all groups at once: at each level an element's new
        place is its place in its own run plus its rank in the sibling run, found by binary search."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        i = np.arange(len(g))
        width = 1
        while len(size) and width < size.max():
            here = np.flatnonzero(end - begin > width)
            k = (i[here] - begin[here]) // width
            own = begin[here] + k * width
            left = k % 2 == 0
            other = np.where(left, own + width, own - width)
            lo, hi = np.minimum(other, end[here]), np.minimum(other + width, end[here])
            floor = lo.copy()
            todo = np.flatnonzero(lo < hi)
            while len(todo):
                mid = (lo[todo] + hi[todo]) >> 1
                c = self.compare(order[mid], order[here[todo]])
                before = (c < 0) | ((c == 0) & ~left[todo])
                lo[todo] = np.where(before, mid + 1, lo[todo])
                hi[todo] = np.where(before, hi[todo], mid)
                todo = todo[lo[todo] < hi[todo]]
            new = np.minimum(own, np.where(left, own, other)) + (i[here] - own) + (lo - floor)
            moved = order.copy()
            moved[new] = order[here]
            order, width = moved, width * 2
        return self._verified(order, group)

    def _verified(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order as it is if the bytes agree with it, else (a hash collision) the order by bytes."""
        a, b = self.view[self.place[order[:-1]]], self.view[self.place[order[1:]]]
        same = group[order[:-1]] == group[order[1:]]
        differ = a != b
        at = differ.argmax(1)
        rows = np.arange(len(a))
        if (same & differ[rows, at] & (a[rows, at] > b[rows, at])).any():
            keys = np.ascontiguousarray(self.view[self.place]).view(f"S{self.length}").ravel()
            return np.lexsort((keys, group))
        return order


def _common(raw: np.ndarray, start: np.ndarray, step: int, size: np.ndarray, most: int, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order within buckets of the strings raw[start], raw[start + step] and so on, of the given sizes up to `most`; and how many bytes
    each has in common with the one before it in its bucket, -1 for a bucket's first."""
    i = np.arange(most)
    inside = i < size[:, None]
    row = np.where(inside, raw[np.where(inside, start[:, None] + step * i, 0)], 0).astype(np.uint8)
    strings = _Suffixes(row.ravel(), np.arange(len(size)) * most, most)
    order = strings.sort(bucket)
    differ = row[order[1:]] != row[order[:-1]]
    n = np.where(differ.any(1), differ.argmax(1), most)
    return order, np.r_[-1, np.where(bucket[order[1:]] == bucket[order[:-1]], n, -1)]


def later_strings(raw: np.ndarray, size: np.ndarray, bucket: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """raw holds segments of the given sizes one behind the other. For each a bit mask of its strings that also start in a
    segment of a smaller doc in the same bucket.

    A string that starts d bytes before the anchor is its d bytes before and its length - d bytes after; among segments sorted by either side
    those that agree that far stand together."""
    begin, reach = np.cumsum(size) - size, length - GRAM
    before, in_common_before = _common(raw, begin + at - 1, -1, at, reach, bucket)
    after, in_common_after = _common(raw, begin + at, 1, size - at, length, bucket)
    mask = np.zeros(len(size), np.int64)
    a, b = np.empty((2, len(size)), np.int64)
    for d in range(reach + 1):
        a[before] = np.cumsum(in_common_before < d)
        b[after] = np.cumsum(in_common_after < length - d)
        have = np.flatnonzero((at >= d) & (size - at >= length - d))
        have = have[(np.bincount(a[have])[a[have]] > 1) & (np.bincount(b[have])[b[have]] > 1)] if len(have) else have
        key = a[have] * (len(size) + 1) + b[have]
        order = np.argsort(key)
        key, have = key[order], have[order]
        head = _heads(key)
        if len(head) < len(key):
            least = np.repeat(np.minimum.reduceat(doc[have], head), np.diff(np.r_[head, len(key)]))
            have = have[least < doc[have]]
            mask[have] |= np.int64(1) << (at[have] - d)
    return mask


_CUT = "doc_id long, th long, spans array<struct<start:long,end:long>>, n_removed long, kept binary, kept_sha256 string"


def _removed(doc: np.ndarray, texts: list[np.ndarray], rows: pa.Table, length: int):
    """Maximal runs of removed bytes: text, start and end of each, in order."""
    oldest, mask, size, n, who, start = _together(_unpack(rows, _MASKS), _MASKS)
    who, start, size = who.astype(np.int64), start.astype(np.int64), np.repeat(size.astype(np.int64), n)
    whole = (np.int64(1) << (size - length + 1)) - 1
    mask = np.where(doc[who] > np.repeat(oldest, n), whole, np.repeat(mask, n)) if len(who) else whole
    base = np.cumsum([0, *(len(b) + 1 for b in texts)])  # with a gap, so that runs don't go on in the next text
    place = base[who] + start
    all_of = mask == whole
    begin, end = [place[all_of]], [place[all_of] + size[all_of]]
    some, bits = place[~all_of], mask[~all_of]
    for j in range(int(size.max(initial=0)) - length + 1):
        x = some[bits >> j & 1 > 0] + j
        begin.append(x)
        end.append(x + length)
    begin, end = np.concatenate(begin), np.concatenate(end)
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order])
    head = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]]) if len(begin) else np.empty(0, np.int64)
    begin, end = begin[head], end[np.r_[head[1:], len(end)] - 1] if len(head) else end
    text = np.searchsorted(base, begin, "right") - 1
    return text, begin - base[text], end - base[text]


def _cut(texts: pa.Table, rows: pa.Table, length: int, keep: bool) -> pa.Table:
    """Merged spans of each text, and what is left of it."""
    doc, th, raws = _block(texts)
    text, start, end = _removed(doc, raws, rows, length)
    cut = np.searchsorted(text, np.arange(len(raws) + 1))
    edges, at, kept, sha = np.stack([start, end], 1).ravel().tolist(), (2 * cut).tolist(), [], []
    for i, raw in enumerate(raws):
        edge = [0, *edges[at[i] : at[i + 1]], len(raw)]
        left = b"".join([raw[x:y].data for x, y in zip(edge[::2], edge[1::2], strict=True)])
        kept.append(left if keep else None)
        sha.append(hashlib.sha256(left).hexdigest())
    gone = np.r_[0, np.cumsum(end - start)]
    spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"]))
    cols = [pa.array(doc, pa.int64()), pa.array(th, pa.int64()), spans, pa.array(gone[cut[1:]] - gone[cut[:-1]], pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())]
    return pa.table(cols, ["doc_id", "th", "spans", "n_removed", "kept", "kept_sha256"])


def _slots(spark: SparkSession, n: int) -> list[int]:
    """n numbers in order, of which each falls to a partition of its own among n by hash."""
    some = spark.range(n * 24).select(F.col("id").cast("int").alias("id"))
    found = some.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("partition")).agg(F.min("id").alias("id")).orderBy("partition").collect()
    ids = [r.id for r in found]
    return sorted({*ids, *range(n * 24, n * 24 + n - len(ids))})


def _bucketed(df: DataFrame, n: int, keys: list[str], tag: str) -> str:
    """Name of a table in the shared folder that holds df, which comes in n parts by keys, with one file a part, so that joins on
    the keys move the other side only."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    name = f"trainlake_{path.rsplit('-', 1)[1]}"
    with released_shuffles(spark):
        df.write.option("path", path).option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return name


def _done(texts: DataFrame, slots: list[int], length: int, bucket_rows: int, keep_bytes: bool) -> DataFrame:
    """_CUT of texts, which stand in blocks by the numbers of slots."""
    width = length - GRAM + 1
    anchors = map_groups(texts, "block", lambda t: _anchors(t, length, slots), _ROW_DDL)
    shared = map_groups(anchors, "part", lambda t: _shared(t, bucket_rows, width), _ROW_DDL)
    segments = map_cogroups(texts, shared, "block", lambda t, rows: _segments(t, rows, length, slots), _ROW_DDL)
    masks = map_groups(segments, "part", lambda t: _least(t, length), _ROW_DDL)
    return map_cogroups(texts, masks, "block", lambda t, rows: _cut(t, rows, length, keep_bytes), _CUT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS, keep_bytes: bool = True) -> DataFrame:
    """length: GRAM + 1 to GRAM + 60. doc_id, n_bytes, spans (array of start, end in bytes), n_removed, kept (binary, null unless keep_bytes) and kept_sha256 of every row:
    each byte covered by a string of `length` bytes that also starts in a text of a smaller doc_id is removed.

    Strings are judged on the input; they never cross documents. A text equal to one of a smaller doc_id loses all its bytes
    if it has `length` or more; so only one text of a group of copies is looked at further. Null texts are empty. Rows with
    a null doc_id lose nothing and take nothing from others. Repeated rows are all returned, each with the same result; texts
    under one doc_id (told apart by a 64-bit hash) don't take from each other; an empty table gives no rows; other columns are not looked at."""
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit("")).cast("binary")
    alone = (F.octet_length(body) < length) | F.col("doc_id").isNull()
    key = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("th")
    short = [F.when(alone, F.sha2(body, 256)).alias("short_sha"), F.when(alone & F.lit(keep_bytes), body).alias("short_kept")]
    rows = materialize(docs.select(*key, F.unhex(F.md5(body)).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"), *short), "repeat-rows")
    whole = rows.where("doc_id is not null").where(F.col("n_bytes") >= length)
    firsts = materialize(whole.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), F.min("n_bytes").alias("n_bytes")), "repeat-firsts")

    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    slots = _slots(spark, partitions_for(total, BLOCK, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    n = len(slots)
    # texts are dealt out by doc_id and th; the number of their block falls to the partition where they are
    block = F.expr(f"element_at(array({','.join(map(str, slots))}), pmod(hash(doc_id, th), {n}) + 1)").alias("block")
    leads = firsts.select(F.col("first").alias("doc_id"), "th").repartition(n, "doc_id", "th")
    whole = docs.where("doc_id is not null").where(F.octet_length("text") >= length).select(*key, "text").repartition(n, "doc_id", "th")
    table = _bucketed(whole.join(leads, ["doc_id", "th"]).select(block, "doc_id", "th", "text"), n, ["block"], "repeat-texts")
    try:
        done = materialize(_done(spark.table(table), slots, length, bucket_rows, keep_bytes), "repeat-done").dropDuplicates(["doc_id", "th"])
    finally:
        spark.sql(f"drop table if exists {table}")

    found = rows.join(firsts.select("digest", "first"), "digest", "left").join(done, ["doc_id", "th"], "left")
    copy, empty = F.col("first") < F.col("doc_id"), F.array().cast("array<struct<start:long,end:long>>")
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", empty)).alias("spans"),
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy & F.lit(keep_bytes), F.lit(b"")).otherwise(F.coalesce("kept", "short_kept")).alias("kept"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "short_sha")).alias("kept_sha256"),
    )
