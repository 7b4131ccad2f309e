"""Benchmark decontamination: word n-gram seeds, then Smith-Waterman alignment.

Every trigram and pair of words of a test item is a seed, however many documents
have it, and so are a few single words. Where a document has a seed, the words
around it are aligned with the whole item; an alignment with at least
`threshold` of the item's best score is a match, which copies with edited,
dropped or inserted words still reach. Before alignment a document and an item,
and then a seed, are only passed over where the words shared by the item and the
document or the words around the seed, counted as often as both have them, are
too few for that score; words around a seed reach as far as an
alignment of that score can. So all alignments of that score are found:

With M matched words in runs of at most k, M / k - 1 edits or more stand between
the runs, each at a cost of a point or more, so a score S takes at least
k (S - 1) / (2 k - 1) shared words. Pairs need to be seeds only where that many
are shared (k = 2), single words where S - 1 are (k = 1); and of an item's m
words any m - S + 2 then hold a matched one, for which the rarest are taken.

Test items are a small table; they go to the workers in blocks of at most
`block_grams` trigrams (a documented bound), each broadcast, one pass over the
documents a block. Documents are never joined with each other and nothing of them is
collected.

Edge cases: null texts are empty; words are \\w+ runs in lower case; items
without words never match, items of one or two words match as such; a document
matches an item at most once, by its best place; repeated rows give repeated
matches; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, expand, free, mixed, slices
from .words import Words

WORD = re.compile(r"\w+")
MATCH, MISS, GAP = 2, -1, -1
#: Cells of a part's table of words, and seeds in items that a part has at most (one text may have more).
CELLS, HITS = 1 << 24, 2_000_000


class Index:
    """Items as word numbers, and their n-grams (of n words and fewer; only the whole item where it is shorter than n) as seeds with the places they have in items."""

    def __init__(self, items: list[tuple[int, str]], n: int = 3, threshold: float = 0.5):
        self.n = n
        texts = [t or "" for _, t in items]
        w = Words(texts)
        self.vocab = np.unique(w.hashes)  # ascending; a word's number is its place plus 1
        numbers = (np.searchsorted(self.vocab, w.hashes) + 1).astype(np.int32)
        spans = [(k, a, z) for (k, _), a, z in zip(items, w.per_text[:-1].tolist(), w.per_text[1:].tolist()) if z > a]
        self.keys = [k for k, _, _ in spans]
        self.items = [numbers[a:z] for _, a, z in spans]
        self.size = np.fromiter(map(len, self.items), np.int64, len(self.items))
        self.least = np.maximum(1, np.ceil(MATCH * self.size * threshold - 1e-9)).astype(np.int64)  # the score of a match
        self.lengths: set[int] = set()
        self.often = np.bincount(numbers)
        self._cells(numbers, np.repeat(np.arange(len(spans)), self.size))
        self._seeds()

    def _cells(self, words: np.ndarray, item: np.ndarray) -> None:
        """A cell for each word's first, second, ... standing in an item, as often as any item has it; each item's cells."""
        rank = _ranks(item * (len(self.vocab) + 1) + words)
        self.most = np.zeros(len(self.vocab) + 1, np.int64)
        np.maximum.at(self.most, words, rank + 1)
        self.base = np.cumsum(self.most) - self.most
        self.cells = self.base[words] + rank
        self.cells_at = np.append(0, np.cumsum(self.size))

    def _seeds(self) -> None:
        """Distinct grams, ascending; of each its entries: item, place in it, and the words that a document must share with the item."""
        cols = [[np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(3))]
        for i, v in enumerate(self.items):
            for g, at, need in self._seeds_of(i, v):
                for c, x in zip(cols, (g, np.full(len(g), i), at, np.full(len(g), need))):
                    c.append(x)
        gram, item, at, need = map(np.concatenate, cols)
        order = np.argsort(gram, kind="stable")
        self.item, self.at, self.need = item[order], at[order], need[order]
        self.sorted, first = np.unique(gram[order], return_index=True)
        self.first = np.append(first, len(gram))
        self.mask = np.uint64((1 << max(10, (16 * len(gram)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[self.sorted & self.mask] = True

    def _seeds_of(self, i: int, v: np.ndarray):
        """(grams, places, shared words needed): a score is at most MATCH for each shared word, and less where runs are short."""
        top = min(self.n, len(v))
        for k in range(top, 0 if top == self.n else top - 1, -1):
            need = -(-int(self.least[i]) // MATCH)
            if k < top:
                need = max(need, -(-k * (int(self.least[i]) - 1) // (MATCH * k - 1)))
            if need > len(v):
                continue
            at = np.arange(len(v) - k + 1)
            if k == 1 and top > 1:
                at = np.argsort(self.often[v], kind="stable")[: len(v) - need + 1]
            self.lengths.add(k)
            yield self.grams(v, k)[at], at, need

    def grams(self, w: np.ndarray, n: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """A hash for each n-gram of word numbers, or those at the given places; n: the item's own by default."""
        n = n or min(self.n, len(w))
        at = np.arange(max(0, len(w) - n + 1)) if at is None else at
        g = np.full(len(at), n, np.uint64)
        for k in range(n):
            g = mixed(g * np.uint64(0x9E3779B97F4A7C15) + w[at + k].astype(np.uint64))
        return g

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts end to end (0: not in any item), and n + 1 offsets."""
        w = Words(texts)
        at = np.minimum(np.searchsorted(self.vocab, w.hashes), max(0, len(self.vocab) - 1))
        hit = self.vocab[at] == w.hashes if len(self.vocab) else np.zeros(len(at), bool)
        return np.where(hit, at + 1, 0).astype(np.int32), w.per_text

    def places(self, w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position in the text, number of the seed) of each seed in the numbered texts, by text."""
        known, out = w > 0, []
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for n in range(1, self.n + 1):
            if len(w) < n or n not in self.lengths:
                continue
            m = len(w) - n + 1
            run = known[:m] & (text[:m] == text[n - 1 :])
            for k in range(1, n):
                run &= known[k : m + k]
            p = np.flatnonzero(run)
            g = self.grams(w, n, p)
            some = self.maybe[g & self.mask]
            p, g = p[some], g[some]
            at = np.minimum(np.searchsorted(self.sorted, g), max(0, len(self.sorted) - 1))
            hit = self.sorted[at] == g if len(self.sorted) else np.zeros(len(g), bool)
            p = p[hit]
            out.append((text[p], p - off[text[p]], at[hit]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        t, p, k = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(t, kind="stable")
        return t[order], p[order], k[order]

    def shared(self, w: np.ndarray, off: np.ndarray, text: np.ndarray, item: np.ndarray) -> np.ndarray:
        """For pairs of a text and an item the words they share, each as often as both have it."""
        own = np.repeat(np.arange(len(off) - 1), np.diff(off))
        p = np.flatnonzero(w > 0)
        own, words = own[p], w[p]
        rank = np.zeros(len(words), np.int64)
        several = np.flatnonzero(self.most[words] > 1)
        rank[several] = _ranks(own[several] * (len(self.vocab) + 1) + words[several])
        use = rank < self.most[words]
        width = int(self.most.sum())
        there = np.zeros((len(off) - 1) * width, bool)
        there[own[use] * width + self.base[words[use]] + rank[use]] = True
        n = self.size[item]
        hit = there[np.repeat(text * width, n) + self.cells[expand(self.cells_at[item], n)]]
        return np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64) if len(n) else np.zeros(0, np.int64)

    def windows(self, w: np.ndarray, off: np.ndarray):
        """(text, item, start, end): the stretches to align with items that have a seed there, without overlaps."""
        t, p, k = self.places(w, off)
        n = self.first[k + 1] - self.first[k]
        before = np.append(0, np.cumsum(n))[np.searchsorted(t, np.arange(len(off)))]  # entries before each text
        rows = max(1, CELLS // max(1, int(self.most.sum())))
        lo = 0
        while lo < len(off) - 1:
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(before, before[lo] + HITS, "right")) - 1))
            a, z = np.searchsorted(t, [lo, hi])
            if z > a:
                yield from self._windows(w[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo, t[a:z] - lo, p[a:z], k[a:z])
            lo = hi

    def _windows(self, w: np.ndarray, off: np.ndarray, base: int, t: np.ndarray, p: np.ndarray, k: np.ndarray):
        n = self.first[k + 1] - self.first[k]
        e = expand(self.first[k], n)
        pair, inv = np.unique(np.repeat(t, n) * len(self.items) + self.item[e], return_inverse=True)
        inv = inv.reshape(-1)
        both = self.shared(w, off, pair // len(self.items), pair % len(self.items))[inv]
        use = np.flatnonzero(both >= self.need[e])
        pair, need, start = pair[inv[use]], self.need[e[use]], (np.repeat(p, n) - self.at[e])[use]
        t, i = pair // len(self.items), pair % len(self.items)
        pad = np.maximum(0, MATCH * both[use] - self.least[i])  # each word more or less costs one point
        a, z = np.maximum(0, start - pad), np.minimum(off[t + 1] - off[t], start + self.size[i] + pad)
        near, rows = [np.zeros(0, bool)], max(1, CELLS // max(1, int(self.most.sum())))
        for x in range(0, len(a), rows):
            k = slice(x, x + rows)
            at = expand((off[t] + a)[k], (z - a)[k])
            near.append(self.shared(w[at], np.append(0, np.cumsum((z - a)[k])), np.arange(len(a[k])), i[k]) >= need[k])
        near = np.concatenate(near)
        found = defaultdict(set)
        for x, s, y in zip(pair[near].tolist(), a[near].tolist(), z[near].tolist()):
            found[x].add((s, y))
        for x, places in found.items():
            t, i = divmod(x, len(self.items))
            spans: list[list[int]] = []
            for a, z in sorted(places):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(z, spans[-1][1])
                else:
                    spans.append([a, z])
            for a, z in spans:
                yield base + t, i, a, z


def _ranks(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(x, kind="stable")
    new = np.flatnonzero(np.diff(x[order], prepend=-1))
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
    return out


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of all pairs together, along antidiagonals. Best local score and the end in the second sequence."""
    best, end = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        block = [order[at]]
        m, n = (len(x) for x in pairs[order[at]])
        while at + len(block) < len(order):
            a, b = pairs[order[at + len(block)]]
            if max(m, len(a)) * (len(block) + 1) > 400_000 or len(b) > 2 * n + 64 or len(a) > 2 * m + 64:
                break
            m, n = max(m, len(a)), max(n, len(b))
            block.append(order[at + len(block)])
        at += len(block)
        n = max(len(pairs[k][1]) for k in block)
        a = np.full((len(block), m), -1, np.int32)
        b = np.full((len(block), n + 2 * m), -2, np.int32)
        for r, k in enumerate(block):
            x, y = pairs[k]
            a[r, : len(x)] = x
            b[r, m : m + len(y)] = np.where(y > 0, y, -2)
        b = b[:, ::-1]
        rows = np.arange(len(block))
        h1 = np.zeros((len(block), m + 1), np.int32)  # antidiagonal d - 1, by item position
        h2 = np.zeros_like(h1)
        top, where = np.zeros(len(block), np.int32), np.zeros(len(block), np.int64)
        for d in range(m + n - 1):
            # cell (i, j) has i + j = d; reversed b gives j = d - i as a rising slice
            s = b.shape[1] - 1 - m - d
            same = a == b[:, s : s + m]
            h = np.zeros_like(h1)
            h[:, 1:] = np.maximum(np.maximum(h2[:, :-1] + np.where(same, MATCH, MISS), 0), np.maximum(h1[:, 1:], h1[:, :-1]) + GAP)
            k = h.argmax(1)
            v = h[rows, k]
            up = v > top
            top[up] = v[up]
            where[up] = d - (k[up] - 1)
            h2, h1 = h1, h
        best[block], end[block] = top, where
    return best, end


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.5, block_grams: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, end_word): documents that hold a test item, and where the best alignment ends."""
    src = docs_of(docs, id_col, text_col)
    out = None
    for index in _blocks(items.select(F.col(item_col).alias("k"), F.col(item_text).cast("string").alias("t")), block_grams, threshold):
        one = _against(src, index, threshold)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


SCHEMA = "doc_id long, item_id long, score double, end_word long"


def _blocks(items: DataFrame, block_grams: int, threshold: float):
    """Items as indexes of bounded size."""
    own, size = [], 0
    for r in items.orderBy("k").toLocalIterator():
        own.append((r.k, r.t))
        size += len(WORD.findall(r.t or ""))
        if size >= block_grams:
            yield Index(own, threshold=threshold)
            own, size = [], 0
    if own:
        yield Index(own, threshold=threshold)


def _against(src: DataFrame, index: Index, threshold: float) -> DataFrame:
    shared = src.sparkSession.sparkContext.broadcast(index)  # bounded by block_grams

    def run(batches):
        for whole in batches:
            for b in slices(whole, limit=2_000_000):
                yield _matches_in(b, shared.value, threshold)

    return src.mapInArrow(run, SCHEMA)


def _matches_in(b: pa.RecordBatch, index: Index, threshold: float) -> pa.RecordBatch:
    ids = b.column(0).to_pylist()
    w, off = index.numbers(b.column(1).to_pylist())
    who, pairs = [], []
    for t, i, a, z in index.windows(w, off):
        who.append((t, i, a))
        pairs.append((index.items[i], w[off[t] + a : off[t] + z]))
    best, end = align(pairs)
    top: dict[tuple[int, int], tuple[float, int]] = {}
    for (r, i, a), s, e in zip(who, best.tolist(), end.tolist()):
        share = s / (MATCH * len(index.items[i]))
        if share >= threshold and (share, -(a + e)) > top.get((r, i), (0.0, 0)):
            top[(r, i)] = (share, -(a + e))
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([ids[r] for r, _ in top], pa.int64()),
            "item_id": pa.array([index.keys[i] for _, i in top], pa.int64()),
            "score": pa.array([v[0] for v in top.values()], pa.float64()),
            "end_word": pa.array([-v[1] for v in top.values()], pa.int64()),
        }
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """Rows of docs whose id has no match, with all their columns; rows with a null id are kept."""
    (name,) = free(docs.columns, "found_id")
    bad = matches(docs, items, id_col=id_col, **kw).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs[id_col].cast("long") == F.col(name), "left_anti")
