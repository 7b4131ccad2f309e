"""Sequence packing by order-preserving dynamic programming.

The token stream of consecutive documents is cut into windows of at most
`window` tokens. Cuts may lie at document ends (free), sentence ends (a small
penalty) or, in long stretches without either, inside a sentence (a large
penalty). A window of a power-of-two length needs no padding; any other is
padded to `window`. With f(j) the least cost of the stream up to cut j,

    f(j) = penalty(j) + min( window - pos(j) + min over i with pos(i) >= pos(j) - window of (f(i) + pos(i)),
                             min over powers of two p, window / 8 <= p < window, with a cut at pos(j) - p, of f(that cut) )

and the inner minimum over a sliding range is kept in a monotone queue: every
cut enters and leaves it once. Shorter powers of two are not looked for, so that
no document is cut to crumbs for their sake.

Edge cases: a null text is empty and makes one piece, its end token. A null
doc_id stays null. Repeated rows are packed as often as they occur. Each Arrow
batch is one stream; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import docs_of, slices
from .tokens import encoder

END = 0  # the id after each document
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids array<int>"


@functools.cache
def _sentence_ends(path: str) -> np.ndarray:
    """Whether a token closes a sentence: it ends in . ! ? or holds a line break."""
    e = encoder(path)
    out = np.zeros(e.n_vocab, bool)
    for i in range(e.n_vocab):
        try:
            b = e.core.decode_single_token_bytes(i)
        except KeyError:
            continue
        out[i] = b[-1:] in (b".", b"!", b"?") or b"\n" in b
    return out


def cuts(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int, sentence_cost: float, inside_cost: float) -> np.ndarray:
    """The chosen cut positions, from 0 to total."""
    if not total:
        return np.zeros(1, np.int64)
    pen = np.full(total + 1, -1.0)
    pen[sentence_ends] = sentence_cost
    pen[doc_ends] = 0
    pen[0] = pen[total] = 0
    pos = np.flatnonzero(pen >= 0)
    step = max(1, window // 4)
    wide = np.flatnonzero(np.diff(pos) > step)
    if len(wide):
        more = np.concatenate([np.arange(pos[k] + step, pos[k + 1], step) for k in wide])
        pen[more] = inside_cost
        pos = np.flatnonzero(pen >= 0)
    m = len(pos)
    # earlier cuts at a distance of a power of two below the window
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    p = window // 2
    while p >= max(1, window // 8):
        want = pos - p
        at = np.minimum(np.searchsorted(pos, want), m - 1)
        hit = np.flatnonzero(pos[at] == want)
        later.append(hit)
        earlier.append(at[hit])
        p //= 2
    order = np.argsort(np.concatenate(later), kind="stable")
    later, earlier = [*np.concatenate(later)[order].tolist(), m], [*np.concatenate(earlier)[order].tolist(), 0]
    q = 0
    where, cost = pos.tolist(), pen[pos].tolist()
    best, back = [0.0] * m, [0] * m
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (f(i) + pos(i), i), increasing
    for j in range(1, m):
        at = where[j]
        low = at - window
        while where[queue[0][1]] < low:
            queue.popleft()
        least, i = queue[0]
        f = least + window - at
        while later[q] == j:
            k = earlier[q]
            if best[k] < f:
                f, i = best[k], k
            q += 1
        f += cost[j]
        best[j], back[j] = f, i
        key = f + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], m - 1
    while j > 0:
        out.append(where[j])
        j = back[j]
    return np.asarray([0, *out[::-1]], np.int64)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = 1024, sentence_cost: float = 2.0, inside_cost: float = 48.0, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence; no shuffle.

    Columns: doc_id, start (ids of the document before the piece), length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset (in the sequence), sequence_tokens (before padding),
    ids (null unless with_ids).
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        serial, part = 0, TaskContext.get().partitionId() << 36
        for whole in batches:
            for b in slices(whole):
                out, serial = _pack_batch(b, path, window, sentence_cost, inside_cost, with_ids, part, serial)
                yield out

    return docs_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def _pack_batch(b: pa.RecordBatch, path, window, sentence_cost, inside_cost, with_ids, part, serial):
    ids, off = encoder(path).ids(b.column(1).to_pylist())
    n = len(off) - 1
    lens = np.diff(off)
    ends = np.cumsum(lens + 1)
    stream = np.zeros(int(ends[-1]) if n else 0, np.uint32)
    keep = np.ones(len(stream), bool)
    keep[ends - 1] = False
    stream[keep] = ids
    stream[ends - 1] = END
    closing = np.flatnonzero(keep & _sentence_ends(path)[stream]) + 1
    at = cuts(len(stream), ends, closing, window, sentence_cost, inside_cost)
    bounds = np.union1d(at, np.append(0, ends))
    lo, hi = bounds[:-1], bounds[1:]
    doc = np.searchsorted(ends, lo, "right")
    seq = np.searchsorted(at, lo, "right") - 1
    raw = stream.astype("<u4").tobytes()
    crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(lo.tolist(), hi.tolist())), np.int64, len(lo))
    total = np.diff(at)
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(stream.astype(np.int32))) if with_ids else pa.nulls(len(lo), pa.list_(pa.int32()))
    out = pa.RecordBatch.from_arrays(
        [b.column(0).take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (lo - (ends - lens - 1)[doc], hi - lo, crc, (lens + 1)[doc], part + serial + seq, lo - at[seq], total[seq])), lists],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids"],
    )
    return out, serial + len(total)


def padding(sequence_tokens: int, window: int = 1024) -> int:
    """Padding of a sequence: none at a power of two, else up to the window."""
    return 0 if sequence_tokens & (sequence_tokens - 1) == 0 else window - sequence_tokens
