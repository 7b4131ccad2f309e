"""Dedup of repeated byte strings with an enhanced suffix array, distributed.

Which suffixes can share `length` bytes is settled first. In every window of
`length` bytes the leftmost K-byte string with the least hash is its anchor: a
function of the window's content alone, so equal windows in any two documents
have equal anchors at equal places. Consecutive windows of one anchor form a
segment.

1. Blocks of documents send the distinct anchor hashes that they hold to hash
   buckets (a hot anchor: one entry a block). A bucket answers each block with a
   bit per entry: whether another document has it.
2. Blocks send the distinct segments of shared anchors, each with the least
   document id that holds it. A bucket sorts the suffixes of its segments that
   differ under one anchor, computes longest common prefixes, and walks the tree
   of common-prefix intervals with a stack. An interval whose occurrences have
   different left neighbours is a maximal repeat; its least document id holds
   for all its occurrences. (An interval with one left neighbour only is the
   tail of a longer repeat with the same occurrences.) Blocks get back, for each
   segment, the least id for every window.
3. Blocks mark the bytes of all windows that an earlier document has.

`repeat_groups` lists the repeats themselves with all occurrences, by the same
passes: buckets answer how often each window occurs instead of its least id.

Texts cross one shuffle, by block, which the three passes share; everything else
that moves is anchors and segments. No group of documents meets in one task: a
bucket sees a block's distinct entries, never the documents behind them. A block
sends one row to each bucket, so blocks grow with the square root of the input
(from BLOCK_BYTES at BLOCKS_FROM up to MOST_BYTES): rows are then in proportion
to the input, and an anchor that every block has is a short list. The input's
size is counted, not estimated, and tasks are as many as blocks ask for.

Edge cases: null texts are empty; texts shorter than `length` lose nothing; rows
with a null id lose nothing and are no source; rows with equal ids count as one
document, none earlier than the other; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd  # noqa: F401  (Spark's cogroup needs it)
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, docs_of, expand, mixed

K = 20
#: A block's bytes up to an input of BLOCKS_FROM, and at most (128 MB, from about 8 TB on); a worker needs some ten times as much.
BLOCK_BYTES, BLOCKS_FROM, MOST_BYTES = 8_000_000, 32_000_000_000, 128_000_000
#: Parts of a block that are hashed at once.
PART = 1_000_000
MOST_PARTS = 8192
NONE = np.iinfo(np.int64).max


def _words(data: np.ndarray, at: np.ndarray | None = None, n: int = 0) -> np.ndarray:
    """Little-endian 64-bit words at every byte (of n), or at the given places; data has 8 spare bytes."""
    view = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    return view[at] if at is not None else view[:n].copy()


def _anchor_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of the K = 20 bytes in words at 0, 8 and 12."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x += c
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _leftmost(h: np.ndarray, w: int) -> np.ndarray:
    """For each start of w neighbours the place of the first least one."""
    n = len(h) - w + 1
    least, place, span = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * span <= w:
        a, b = least[:-span], least[span:]
        right = b < a
        place = np.where(right, place[span:], place[:-span])
        least = np.minimum(a, b)
        span *= 2
    rest = w - span
    if rest:
        right = least[rest : rest + n] < least[:n]
        return np.where(right, place[rest : rest + n], place[:n])
    return place[:n]


class Segments:
    """Of one block: for each run of windows with one anchor its document, first window, windows, anchor hash and content hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, contents: bool):
        cols = [[], [], [], [], []]
        start = 0
        while start < len(off) - 1:
            end = max(start + 1, int(np.searchsorted(off, off[start] + PART, "right")) - 1)
            part = self._part(data, off, start, end, length, contents)
            if part:
                for c, x in zip(cols, part):
                    c.append(x)
            start = end
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.doc, self.first, self.count, self.anchor, self.content = (np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(cols, kinds))

    @staticmethod
    def _part(data, off, start, end, length, contents):
        base, n = int(off[start]), int(off[end] - off[start])
        if n < length:
            return None
        own = np.zeros(n + 32, np.uint8)
        own[:n] = data[base : base + n]
        h = _anchor_hash(_words(own, n=n - K + 1), _words(own[8:], n=n - K + 1), _words(own[12:], n=n - K + 1))
        owner = _leftmost(h, length - K + 1)
        # windows inside a document
        size = np.maximum(off[start + 1 : end + 1] - off[start:end] - length + 1, 0)
        p = expand(off[start:end] - base, size)
        if not len(p):
            return None
        doc = np.repeat(np.arange(start, end), size)
        o = owner[p]
        new = np.ones(len(p), bool)
        new[1:] = (o[1:] != o[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        first, count = p[at], np.diff(np.append(at, len(p)))
        content = np.zeros(len(at), np.uint64)
        if contents:
            content = segment_hashes(own, first, count + length - 1)
        return doc[at], base + first, count, h[o[at]], content


def segment_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of data[start : start + size], 8 bytes at a time; data has 8 spare bytes."""
    h = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    todo = np.arange(len(start))
    for k in range(0, int(size.max(initial=0)), 8):
        todo = todo[size[todo] > k]
        w = _cut(_words(data, start[todo] + k).byteswap(), np.minimum(size[todo] - k, 8).astype(np.uint64))
        h[todo] = mixed(h[todo] * np.uint64(0xD1342543DE82EF95) ^ w)
    return h


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] for all, end to end; indexes are made for a part at a time."""
    at = np.append(0, np.cumsum(size))
    out = np.empty(int(at[-1]), data.dtype)
    step = 20_000
    for k in range(0, len(start), step):
        out[at[k] : at[min(k + step, len(start))]] = data[expand(start[k : k + step], size[k : k + step])]
    return out


# the enhanced suffix array of one bucket


def suffix_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:end], and for each in that order the longest common prefix with the one before."""
    size = end - start
    most = int(size.max()) if len(size) else 0
    own = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = []
    for k in range(0, most, 8):
        w = _words(own, start + k).byteswap()
        room = np.clip(size - k, 0, 8).astype(np.uint64)  # bytes past a suffix's end count as zero
        words.append(_cut(w, room))
    order = np.lexsort([size, *words[::-1]]) if len(start) else np.zeros(0, np.int64)
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for w in words:
            s = w[order]
            x = s[1:] ^ s[:-1]
            lcp[1:] += np.where(same, _lead(x), 0)
            same &= x == 0
        lcp[1:] = np.minimum(lcp[1:], np.minimum(size[order][1:], size[order][:-1]))
    return order, lcp


def _cut(w: np.ndarray, room: np.ndarray) -> np.ndarray:
    keep = (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - np.maximum(room, 1)) * np.uint64(8))) << ((np.uint64(8) - np.maximum(room, 1)) * np.uint64(8))
    return np.where(room > 0, w & keep, np.uint64(0))


def _lead(x: np.ndarray) -> np.ndarray:
    """Equal leading bytes, from the exclusive or of two big-endian words."""
    out = np.zeros(len(x), np.int64)
    for k in range(8):
        out += (x >> np.uint64(8 * k)) == 0
    return out


def intervals(lcp: np.ndarray, left: np.ndarray, least: int, value: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Maximal repeats: (first, last, depth, smallest value) of the common-prefix intervals that are at least `least` deep and whose members have more than one left neighbour.

    left: the byte before each suffix in suffix order, -1 where there is none
    (then nothing can be extended). A stack holds the open intervals.
    """
    n = len(lcp)
    change = np.zeros(n + 1, np.int64)
    change[1:n] = (left[1:] != left[:-1]) | (left[1:] < 0) | (left[:-1] < 0)
    change = np.cumsum(change)
    deep = lcp >= least
    out: list[tuple[int, int, int, int]] = []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):  # lcp[a:z] are deep: suffixes a - 1 to z - 1
        vals, depths = value[a - 1 : z].tolist(), lcp[a:z].tolist()
        stack: list[list[int]] = []  # depth, first, smallest
        for i, d in enumerate([*depths, -1]):
            at, low = a - 1 + i, vals[i]  # d is the common prefix of suffixes at and at + 1
            first = at
            while stack and stack[-1][0] > d:
                depth, first, small = stack.pop()
                low = min(low, small)
                if change[at] > change[first]:
                    out.append((first, at, depth, low))
                if stack and stack[-1][0] >= d:
                    stack[-1][2] = min(stack[-1][2], low)
            if d >= 0:
                if stack and stack[-1][0] == d:
                    stack[-1][2] = min(stack[-1][2], low)
                else:
                    stack.append([d, first, low])
    return out


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """All maximal repeats of at least `least` bytes in texts, each with all its occurrences (text, start)."""
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.arange(off[-1])
    which = np.searchsorted(off, start, "right") - 1
    order, lcp = suffix_array(data, start, off[1:][which])
    left = np.where(start == off[which], -1, np.append(0, data)[start])[order]
    out = []
    for a, z, depth, _ in intervals(lcp, left, least, np.zeros(len(order), np.int64)):
        occ = sorted((int(which[p]), int(p - off[which[p]])) for p in order[a : z + 1])
        t, s = occ[0]
        out.append((texts[t][s : s + depth], occ))
    return out


def _least_ids(data: np.ndarray, off: np.ndarray, anchor_at: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct segments with the least document id of each: (segments with windows that an earlier document has, n + 1 offsets, least id by window)."""
    own = np.concatenate([data, np.zeros(16, np.uint8)])
    at = off[:-1] + anchor_at
    h = _anchor_hash(_words(own, at), _words(own, at + 8), _words(own, at + 12))
    _, inv, n = np.unique(h, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[inv.reshape(-1)] > 1)  # one anchor, several segments: they share windows in part
    count = (np.diff(off) - length + 1)[some]
    start = expand(off[:-1][some], count)
    seg = np.repeat(np.arange(len(some)), count)
    end = off[1:][some][seg]
    low = ids[some][seg].copy()
    if len(start):
        order, lcp = suffix_array(data, start, end)
        inner = start > off[:-1][some][seg]
        left = np.where(inner, own[np.maximum(start - 1, 0)].astype(np.int64), -1)[order]
        found = intervals(lcp, left, length, low[order])
        if found:
            a, z, depth, small = (np.asarray(x, np.int64) for x in zip(*found))
            member = order[expand(a, z - a + 1)]
            reach = np.repeat(depth - length + 1, z - a + 1)
            np.minimum.at(low, expand(member, reach), np.repeat(np.repeat(small, z - a + 1), reach))
    where = np.append(0, np.cumsum(count))
    earlier = np.flatnonzero(np.maximum.reduceat(low < ids[some][seg], where[:-1])) if len(some) else np.zeros(0, np.int64)
    parts = np.append(0, np.cumsum(count[earlier]))
    return some[earlier], parts, low[expand(where[:-1][earlier], count[earlier])]


# the three passes


def _block(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows in a fixed order, the bytes of their texts, and their ids."""
    t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, off = bytes_of(t.column("text"))
    return t, data, off, np.asarray(t.column("doc_id"))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket (stable), the buckets that have some, and n + 1 edges of their parts in it."""
    b = _bucket(h, buckets)
    order = np.argsort(b, kind="stable")
    each, first = np.unique(b[order], return_index=True)
    return order, each, np.append(first, len(b))


def _anchors(seg: Segments, owner: np.ndarray, buckets: int):
    """Distinct anchor hashes by bucket, ascending; whether segments of two owners have it; each segment's entry; buckets and edges."""
    h, at = np.unique(seg.anchor, return_inverse=True)
    at = at.reshape(-1)
    lo, hi = np.full(len(h), NONE), np.full(len(h), -NONE)
    np.minimum.at(lo, at, owner)
    np.maximum.at(hi, at, owner)
    order, each, edges = _by_bucket(h, buckets)
    place = np.empty(len(h), np.int64)
    place[order] = np.arange(len(h))
    return h[order], (lo < hi)[order], place[at], each, edges


def _owners(seg: Segments, ids: np.ndarray, within: bool) -> np.ndarray:
    """Whose each segment is: its document's, or its own where repeats within a document count."""
    return np.arange(len(seg.doc)) if within else ids[seg.doc]


def _segments_of(seg: Segments, keep: np.ndarray, ids: np.ndarray):
    """Distinct segments among those in keep: one's index, and the least id of each."""
    c, first, inv = np.unique(seg.content[keep], return_index=True, return_inverse=True)
    low = np.full(len(c), NONE)
    np.minimum.at(low, inv.reshape(-1), ids[seg.doc[keep]])
    return keep[first], low


_ROW = "bucket long, block long, a binary, b binary, c binary, d binary, e binary"
_ROW_TYPE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in "abcde")])


def _table(bucket: np.ndarray, block: np.ndarray | int, **cols: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """Rows of _ROW. A column is (values end to end, n + 1 edges in them); each row gets its part's bytes."""
    n = len(bucket)
    out = [pa.array(bucket, pa.int64()), pa.array(np.broadcast_to(block, n), pa.int64())]
    for c in "abcde":
        if c in cols:
            values, edges = cols[c]
            off = (edges * values.dtype.itemsize).astype(np.int64)
            out.append(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary()))
        else:
            out.append(pa.nulls(n, pa.binary()))
    return pa.Table.from_arrays(out, schema=_ROW_TYPE)


def _column(t: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's values end to end, and n + 1 edges of the rows in them."""
    data, off = bytes_of(t.column(name))
    values = np.frombuffer(data.tobytes(), kind)
    return values, off // values.dtype.itemsize


def layout(total: int, block_bytes: int | None = None) -> tuple[int, int]:
    """(blocks, partitions) for an input of so many bytes: half a block a partition on average up to MOST_PARTS of them, then some blocks, four at most."""
    size = block_bytes or int(min(MOST_BYTES, BLOCK_BYTES * max(1.0, total / BLOCKS_FROM) ** 0.5))
    blocks = max(1, -(-total // size))
    return blocks, max(-(-blocks // 4), min(2 * blocks, MOST_PARTS))


def _grouped(df: DataFrame, parts: int, key: str):
    return df.repartition(parts, key).groupBy(key)


def _shared_anchors(src: DataFrame, length: int, block_bytes: int | None, within: bool) -> tuple[DataFrame, DataFrame, int, int, int]:
    """Documents by block; for each block and bucket a bit per entry, whether another document (within: another place) has the anchor; partitions; buckets of anchors and of segments."""
    if length < K + 8:
        raise ValueError(f"length must be {K + 8} or more")
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = layout(total, block_bytes)
    near, far = blocks, 3 * blocks  # segments are several times as long as what they stand for
    own = src.filter("doc_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition(parts, "block")

    def send_anchors(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        _, data, off, ids = _block(t)
        seg = Segments(data, off, length, False)
        h, several, _, each, edges = _anchors(seg, _owners(seg, ids, within), near)
        return _table(each, block, a=(h, edges), b=(several.view(np.uint8), edges))

    def find_shared(t: pa.Table) -> pa.Table:
        h, edges = _column(t, "a", "<u8")
        several = _column(t, "b", "u1")[0].astype(bool)
        _, inv, n = np.unique(h, return_inverse=True, return_counts=True)
        inv = inv.reshape(-1)
        shared = n > 1  # a document is in one block only, so two blocks are two documents
        shared[inv[several]] = True
        return _table(np.asarray(t.column("bucket")), np.asarray(t.column("block")), a=(shared[inv].view(np.uint8), edges))

    anchors = own.groupBy("block").applyInArrow(send_anchors, _ROW)
    return own, _grouped(anchors, parts, "bucket").applyInArrow(find_shared, _ROW), parts, near, far


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, with_text: bool = True) -> DataFrame:
    """One row for each document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept).

    Every byte goes that lies in a string of `length` bytes which also starts in
    a document with a smaller id. spans: array<struct<start, end>> of removed
    runs in bytes; kept: the bytes that stay (null unless with_text).
    """
    src = docs_of(docs, id_col, text_col)
    null_ids = src.filter("doc_id IS NULL")
    own, shared, parts, near, far = _shared_anchors(src, length, block_bytes, within=False)

    def send_segments(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _ROW_TYPE.empty_table()
        block = left.column("block")[0].as_py()
        _, data, off, ids = _block(left)
        seg = Segments(data, off, length, True)
        _, _, entry, _, _ = _anchors(seg, ids[seg.doc], near)
        shared = _column(right.sort_by("bucket"), "a", "u1")[0].astype(bool)
        one, low = _segments_of(seg, np.flatnonzero(shared[entry]), ids)
        order, each, edges = _by_bucket(seg.anchor[one], far)
        one, low = one[order], low[order]
        size = seg.count[one] + length - 1
        text = gather(data, seg.first[one], size)
        at = np.append(0, np.cumsum(size))
        # the anchor stands at or after the last window's start
        lead = _anchor_places(text, at, seg.anchor[one], seg.count[one])
        return _table(each, block, a=(text, at[edges]), b=(size.astype("<u2"), edges), c=(lead.astype(np.uint8), edges), d=(low.astype("<i8"), edges))

    def find_least(t: pa.Table) -> pa.Table:
        text = bytes_of(t.column("a"))[0]
        size, edges = _column(t, "b", "<u2")
        size, lead, low = size.astype(np.int64), _column(t, "c", "u1")[0].astype(np.int64), _column(t, "d", "<i8")[0]
        at = np.append(0, np.cumsum(size))
        content = segment_hashes(np.concatenate([text, np.zeros(8, np.uint8)]), at[:-1], size)
        _, first, inv = np.unique(content, return_index=True, return_inverse=True)
        inv = inv.reshape(-1)
        least = np.full(len(first), NONE)
        np.minimum.at(least, inv, low)
        some = size[first]
        part, off, by_window = _least_ids(gather(text, at[:-1][first], some), np.append(0, np.cumsum(some)), lead[first], least, length)
        where = np.full(len(first), -1)
        where[part] = np.arange(len(part))
        w = where[inv]
        hit = np.flatnonzero(w >= 0)
        row = np.searchsorted(edges, hit, "right") - 1
        cnt = np.diff(off)[w[hit]]
        hits = np.searchsorted(hit, edges)
        return _table(np.asarray(t.column("bucket")), np.asarray(t.column("block")), a=(content, edges), b=(least[inv].astype("<i8"), edges), c=((hit - edges[row]).astype("<i8"), hits), d=(by_window[expand(off[:-1][w[hit]], cnt)].astype("<i8"), np.append(0, np.cumsum(cnt))[hits]))

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _OUT.empty_table()
        t, data, off, ids = _block(left)
        cover = np.zeros(len(data) + 1, np.int32)
        if right.num_rows:
            seg = Segments(data, off, length, True)
            content, edges = _column(right, "a", "<u8")
            least = _column(right, "b", "<i8")[0]
            hit, hits = _column(right, "c", "<i8")
            hit = hit + np.repeat(edges[:-1], np.diff(hits))
            by_window = _column(right, "d", "<i8")[0]
            order = np.argsort(content)
            at = np.minimum(np.searchsorted(content, seg.content, sorter=order), max(0, len(content) - 1))
            place = order[at] if len(order) else at
            known = np.flatnonzero(content[place] == seg.content) if len(content) else np.zeros(0, np.int64)
            place = place[known]
            doc = ids[seg.doc[known]]
            whole = least[place] < doc
            _cover(cover, seg.first[known[whole]], seg.count[known[whole]] + length - 1)
            if len(hit):
                n_win = np.zeros(len(content), np.int64)
                n_win[hit] = _window_counts(seg, known, place, hit)
                start = np.zeros(len(content), np.int64)
                start[hit] = np.cumsum(n_win[hit]) - n_win[hit]
                rest = np.flatnonzero(~whole & (n_win[place] > 0))
                c = n_win[place[rest]]
                earlier = by_window[expand(start[place[rest]], c)] < np.repeat(doc[rest], c)
                first = expand(seg.first[known[rest]], c)[earlier]
                _cover(cover, first, np.full(len(first), length))
        gone = np.cumsum(cover[:-1]) > 0
        return _result(t, data, off, gone, with_text)

    sent = own.groupBy("block").cogroup(_grouped(shared, parts, "block")).applyInArrow(send_segments, _ROW)
    least = _grouped(sent, parts, "bucket").applyInArrow(find_least, _ROW)
    done = own.groupBy("block").cogroup(_grouped(least, parts, "block")).applyInArrow(mark, RESULT)
    alone = null_ids.mapInArrow(lambda it: (_result(pa.Table.from_batches([b]), *bytes_of(b.column(1)), np.zeros(len(bytes_of(b.column(1))[0]), bool), with_text).to_batches()[0] for b in it if b.num_rows), RESULT)
    return done.unionByName(alone)


def repeat_groups(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """Repeats of `length` bytes or more with all their occurrences, one row for each: (repeat, depth, n, doc_id, start).

    Neighbouring windows of `length` bytes belong together where both, and the two as
    one string, occur equally often; a repeat is a longest run of such windows that
    occur more than once. It can be extended on neither side without losing some
    occurrences or gaining others, and each repeated window of a document lies in
    exactly one repeat, so rows are never more than bytes. (A long repeat whose inner
    part occurs more often is therefore given as several; `maximal_repeats` nests them.)

    repeat: a 128-bit hash of the string, in hexadecimal, equal wherever it stands;
    depth: its bytes; n: its occurrences, this one included, in whatever document, the
    same one too; start: in bytes. Windows are counted in the buckets of their anchors,
    from the suffix array's intervals at depth `length` and one byte more; no group meets
    in one task. Rows with a null id are left out; rows with equal ids count one by one.
    """
    own, shared, parts, near, far = _shared_anchors(docs_of(docs, id_col, text_col), length, block_bytes, within=True)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _ROW_TYPE.empty_table()
        block = left.column("block")[0].as_py()
        _, data, off, ids = _block(left)
        seg = Segments(data, off, length, False)
        entry = _anchors(seg, _owners(seg, ids, True), near)[2]
        keep = np.flatnonzero(_column(right.sort_by("bucket"), "a", "u1")[0].astype(bool)[entry])
        content, size = _followed(data, off, seg, keep, length)
        _, first, n = np.unique(content, return_index=True, return_counts=True)
        one, size = keep[first], size[first]
        order, each, edges = _by_bucket(seg.anchor[one], far)
        one, size, n = one[order], size[order], n[order]
        at = np.append(0, np.cumsum(size))
        return _table(each, block, a=(gather(data, seg.first[one], size), at[edges]), b=(size.astype("<u2"), edges), c=(seg.count[one].astype("<u2"), edges), d=(n.astype("<i8"), edges), e=(seg.anchor[one], edges))

    def count(t: pa.Table) -> pa.Table:
        text = bytes_of(t.column("a"))[0]
        size, edges = _column(t, "b", "<u2")
        size, windows, n, anchor = size.astype(np.int64), _column(t, "c", "<u2")[0].astype(np.int64), _column(t, "d", "<i8")[0], _column(t, "e", "<u8")[0]
        at = np.append(0, np.cumsum(size))
        content = segment_hashes(np.concatenate([text, np.zeros(8, np.uint8)]), at[:-1], size)
        _, first, inv = np.unique(content, return_index=True, return_inverse=True)
        inv = inv.reshape(-1)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, inv, n)
        some = size[first]
        run_at, runs, each, longer = _counts(gather(text, at[:-1][first], some), np.append(0, np.cumsum(some)), windows[first], total, anchor[first], length)
        per = runs[inv]
        pick = expand((np.cumsum(runs) - runs)[inv], per)
        inside = np.append(0, np.cumsum(per))[edges]
        return _table(np.asarray(t.column("bucket")), np.asarray(t.column("block")), a=(content, edges), b=(per.astype("<i8"), edges), c=(run_at[pick].astype("<i8"), inside), d=(each[pick].astype("<i8"), inside), e=(longer[pick].astype("<i8"), inside))

    def list_groups(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _GROUP.empty_table()
        _, data, off, ids = _block(left)
        seg = Segments(data, off, length, False)
        known, per = _column(right, "a", "<u8")[0], _column(right, "b", "<i8")[0]
        run_at, each, longer = (_column(right, c, "<i8")[0] for c in "cde")
        order = np.argsort(known)
        content, _ = _followed(data, off, seg, np.arange(len(seg.doc)), length)
        place = order[np.minimum(np.searchsorted(known, content, sorter=order), len(known) - 1)] if len(known) else np.zeros(0, np.int64)
        has = np.flatnonzero(known[place] == content) if len(known) else np.zeros(0, np.int64)
        place = place[has]
        pick = expand((np.cumsum(per) - per)[place], per[place])
        owner = np.repeat(has, per[place])
        start, n, m = seg.first[owner] + run_at[pick], each[pick], longer[pick]
        # a run ends where the next one of its segment starts, or with the segment
        end = seg.first[owner] + seg.count[owner]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        end[inner] = start[inner + 1]
        # windows that occur more often than with their next byte stand alone
        twice = n > 1
        start, end, n, m, owner = start[twice], end[twice], n[twice], m[twice], owner[twice]
        cuts = np.where(n == m, 1, end - start)
        width = np.repeat(np.where(n == m, end - start, 1), cuts)
        start, n, m, doc = expand(start, cuts), np.repeat(n, cuts), np.repeat(m, cuts), np.repeat(seg.doc[owner], cuts)
        joined = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + width[:-1]) & (n[1:] == n[:-1]) & (m[:-1] == n[1:])
        first = np.flatnonzero(np.append(True, ~joined)[: len(start)])
        last = np.append(first[1:], len(start))[: len(first)] - 1
        a, z = start[first], start[last] + width[last] + length - 1
        keys = [hashlib.blake2b(data[x:y].tobytes(), digest_size=16).hexdigest() for x, y in zip(a.tolist(), z.tolist())]
        return pa.Table.from_arrays([pa.array(keys, pa.string()), pa.array(z - a), pa.array(n[first]), pa.array(ids[doc[first]]), pa.array(a - off[doc[first]])], schema=_GROUP)

    sent = own.groupBy("block").cogroup(_grouped(shared, parts, "block")).applyInArrow(send, _ROW)
    counted = _grouped(sent, parts, "bucket").applyInArrow(count, _ROW)
    return own.groupBy("block").cogroup(_grouped(counted, parts, "block")).applyInArrow(list_groups, GROUPS)


GROUPS = "repeat string, depth long, n long, doc_id long, start long"
_GROUP = pa.schema([("repeat", pa.string()), *((c, pa.int64()) for c in ("depth", "n", "doc_id", "start"))])


def _followed(data: np.ndarray, off: np.ndarray, seg: Segments, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and sizes of segments with the byte that follows in their document, where there is one."""
    first = seg.first[which]
    size = np.minimum(seg.count[which] + length, off[seg.doc[which] + 1] - first)
    return segment_hashes(np.concatenate([data, np.zeros(8, np.uint8)]), first, size), size


def _counts(data: np.ndarray, off: np.ndarray, windows: np.ndarray, times: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For distinct segments that occur so many times: how often each window occurs, alone and with its next byte (0 without one).

    Given as runs of equal pairs: first window of each run, runs of each segment, the two counts.
    """
    seg = np.repeat(np.arange(len(windows)), windows)
    start = expand(off[:-1], windows)
    stop = np.minimum(start + length + 1, off[1:][seg])
    each, longer = times[seg], np.where(stop - start > length, times[seg], 0)
    _, inv, n = np.unique(anchor, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[inv.reshape(-1)][seg] > 1)  # one anchor, several segments: they share windows in part
    if len(some):
        order, lcp = suffix_array(data, start[some], stop[some])
        at = some[order]
        for depth, out in ((length, each), (length + 1, longer)):
            group = np.cumsum(lcp < depth) - 1
            sums = np.zeros(int(group[-1]) + 1, np.int64)
            np.add.at(sums, group, times[seg[at]])
            out[at] = np.where(stop[at] - start[at] >= depth, sums[group], 0)
    new = np.ones(len(seg), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (each[1:] != each[:-1]) | (longer[1:] != longer[:-1])
    run = np.flatnonzero(new)
    return (start - off[:-1][seg])[run], np.bincount(seg[run], minlength=len(windows)), each[run], longer[run]


def _anchor_places(text: np.ndarray, at: np.ndarray, anchor: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where in each segment its anchor starts: not before the last window does, and the first such place."""
    own = np.concatenate([text, np.zeros(32, np.uint8)])
    out = np.full(len(anchor), -1)
    todo = np.arange(len(anchor))
    k = 0
    while len(todo):
        p = at[todo] + count[todo] - 1 + k
        hit = _anchor_hash(_words(own, p), _words(own, p + 8), _words(own, p + 12)) == anchor[todo]
        out[todo[hit]] = count[todo[hit]] - 1 + k
        todo = todo[~hit]
        k += 1
    return out


def _window_counts(seg: Segments, known: np.ndarray, place: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Windows of the entries in hit, from the block's own segments with that content."""
    n = np.zeros(int(max(place.max(initial=0), hit.max())) + 1, np.int64)
    n[place] = seg.count[known]
    return n[hit]


def _cover(cover: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
    np.add.at(cover, first, 1)
    np.add.at(cover, first + size, -1)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])


def _result(t: pa.Table, data: np.ndarray, off: np.ndarray, gone: np.ndarray, with_text: bool) -> pa.Table:
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    before = np.append(0, np.cumsum(gone))
    new = gone.copy()
    new[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
    last = gone.copy()
    last[:-1] &= ~gone[1:] | (doc[1:] != doc[:-1])
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    per = np.bincount(doc[starts], minlength=n)
    kept = data[~gone].tobytes()
    left = off - before[off]
    parts = [kept[a:z] for a, z in zip(left[:-1].tolist(), left[1:].tolist())]
    spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), pa.StructArray.from_arrays([pa.array(starts - off[doc[starts]]), pa.array(ends - off[doc[starts]])], fields=list(_SPAN)))
    return pa.Table.from_arrays([t.column("doc_id").combine_chunks() if isinstance(t.column("doc_id"), pa.ChunkedArray) else t.column("doc_id"), pa.array(np.diff(off)), pa.array(np.diff(before[off])), pa.array(per.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()), spans, pa.array(parts if with_text else [None] * n, pa.binary())], schema=_OUT)
