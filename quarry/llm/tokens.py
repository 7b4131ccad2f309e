"""Byte-level BPE token ids for whole columns of text.

A text falls into pieces by the vocabulary's split pattern. The pieces of many
texts are found at once with array operations on code points, equal pieces are
encoded once, and ids are gathered for all of them. The result equals that of
encoding each text on its own.

Pieces are equal where two 64-bit hashes are, each a sum of mixed (place, code
point) pairs under a key drawn at random in each process. Where pieces agree in
the first hash and not in the second, everything known is forgotten and a new
key drawn. New pieces go straight to the byte-pair core, not through the
pattern again, so a piece may be of any length. Texts longer than a chunk are
cut where a letter or digit meets a space, which every split does too.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import regex
import tiktoken

from .common import expand, mixed

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
SPECIAL = "<|endoftext|>"
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1_000_000
_CUT = regex.compile(r"[\p{L}\p{N}](?= )")
#: Distinct pieces that an encoder remembers; beyond it starts afresh.
REMEMBER = 1_000_000


@functools.cache
def _classes() -> np.ndarray:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        hits = "".join(regex.findall(pattern, every))
        out[np.frombuffer(hits.encode("utf-32-le"), "<u4")] = kind
    return out


def place_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """A mixed 64-bit value for each (place in its run, code point); runs are starts to ends, ascending."""
    bounds = np.concatenate([[0], np.stack([starts, ends], 1).ravel(), [len(cps)]])
    v = np.arange(len(cps), dtype=np.int64) - np.repeat(bounds[:-1], np.diff(bounds))
    v <<= 21  # a code point has 21 bits
    v |= cps
    return mixed(v.view(np.uint64) * np.uint64(_BASE) ^ np.uint64(key))


class Pieces:
    """Where the split pattern cuts the given texts, and two hashes of each piece under a key."""

    key = int.from_bytes(os.urandom(8), "little")

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        self.hashed = None
        self.lens = np.fromiter(map(len, texts), np.int64, len(texts))
        cps = np.frombuffer(self.joined.encode("utf-32-le"), "<u4")
        n = len(cps)
        ends = np.cumsum(self.lens)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.cps = cps
            self.per_text = np.zeros(len(texts) + 1, np.int64)
            return
        cls = _classes()[cps]
        blank = cls == SPACE
        first = np.zeros(n + 1, bool)
        first[ends - self.lens] = True
        first[0], first[n] = True, True
        after_space = np.zeros(n, bool)
        after_space[1:] = cps[:-1] == 32
        after_space &= ~first[:n]
        start = np.ones(n, bool)
        start[1:] = cls[1:] != cls[:-1]
        start &= blank | ~after_space
        start |= first[:n]
        last_blank = blank.copy()
        last_blank[:-1] &= ~blank[1:]
        last_blank &= ~first[1:]
        start |= last_blank
        self._contractions(cps, cls, first, after_space, start)
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], n)
        self.cps = cps
        self.per_text = np.append(0, np.searchsorted(self.starts, ends))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of all pieces under the class's present key."""
        if self.hashed and self.hashed[0] == Pieces.key:
            return self.hashed[1]
        if not len(self.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        v = place_hashes(self.cps, self.starts, self.ends, Pieces.key)
        first = np.add.reduceat(v, self.starts)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xA0761D6478BD642F)
        v ^= v >> np.uint64(32)
        self.hashed = Pieces.key, (first, np.add.reduceat(v, self.starts))
        return self.hashed[1]

    @staticmethod
    def _contractions(cps, cls, first, after_space, start) -> None:
        """'s 't 'm 'd 're 've 'll, where the apostrophe opens a piece."""
        n = len(cps)
        at = np.flatnonzero((cps == 39) & start & ~after_space)
        at = at[at + 1 < n]
        at = at[~first[at + 1]]
        if not len(at):
            return
        c1 = cps[at + 1]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        nxt = np.minimum(at + 2, n - 1)
        c2 = np.where((at + 2 < n) & ~first[nxt], cps[nxt], 0)
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for hit, width in ((one, 2), (two, 3)):
            p = at[hit]
            start[p + 1] = False
            end = p + width
            start[end[end < n]] = True


@dataclass
class Chunk:
    """Segments of texts: the text of each, their pieces, and (segment, id) of those that are a special string."""

    owner: np.ndarray
    pieces: Pieces
    special: list[tuple[int, int]]


def chunks(texts: list[str], special: dict[str, int] | None = None) -> Iterator[Chunk]:
    """Texts in parts of about _CHUNK characters; in a part a special string's segment is empty."""
    mark = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    owner, segments, odd, size = [], [], [], 0
    for i, t in enumerate(texts):
        for k, part in enumerate(mark.split(t) if mark and any(s in t for s in special) else (t,)):
            if k % 2:
                odd.append((len(segments), special[part]))
                owner.append(i)
                segments.append("")
                continue
            at = 0
            while at < len(part):
                cut = _CUT.search(part, at + _CHUNK) if len(part) - at > _CHUNK else None
                end = cut.end() if cut else len(part)
                if size and size + end - at > _CHUNK:
                    yield Chunk(np.asarray(owner, np.int64), Pieces(segments), odd)
                    owner, segments, odd, size = [], [], [], 0
                owner.append(i)
                segments.append(part[at:end])
                size += end - at
                at = end
    if segments:
        yield Chunk(np.asarray(owner, np.int64), Pieces(segments), odd)


class Encoder:
    """Ids of one vocabulary, with the ids of pieces seen before."""

    def __init__(self, path: str, special: dict[str, int] | None = None):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = special or {}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.n_vocab = max([*ranks.values(), *self.special.values()]) + 1
        self._reset()

    def _reset(self) -> None:
        self.key = Pieces.key
        self.known = np.zeros(0, np.uint64)  # first hashes, ascending
        self.check = np.zeros(0, np.uint64)  # each one's second hash
        self.place = np.zeros(0, np.int64)  # each one's row in off and cnt
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.off = np.zeros(0, np.int64)
        self.cnt = np.zeros(0, np.int64)

    def _index(self, p: Pieces) -> np.ndarray:
        """For each piece its row in the table of known pieces."""
        while (out := self._try(p)) is None:
            Pieces.key = int.from_bytes(os.urandom(8), "little")
        return out

    def _try(self, p: Pieces) -> np.ndarray | None:
        """None where two pieces share their first hash only."""
        if len(self.known) > REMEMBER or self.key != Pieces.key:
            self._reset()
        hashes, checks = p.hashes()
        order = np.argsort(hashes)
        h, c = hashes[order], checks[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if (~new[1:] & (c[1:] != c[:-1])).any():
            return None
        each, check = h[new], c[new]
        at = np.searchsorted(self.known, each)
        hit = np.zeros(len(each), bool)
        if len(self.known):
            near = np.minimum(at, len(self.known) - 1)
            hit = self.known[near] == each
            if (hit & (self.check[near] != check)).any():
                return None
        if not hit.all():
            miss = np.flatnonzero(~hit)
            first = order[np.flatnonzero(new)[miss]]
            joined, encode = p.joined, self.core._core_bpe.encode_single_piece
            self._learn(each[miss], check[miss], at[miss], [encode(joined[s:e].encode()) for s, e in zip(p.starts[first].tolist(), p.ends[first].tolist())])
            at = np.searchsorted(self.known, each)
        out = np.empty(len(h), np.int64)
        out[order] = self.place[at][np.cumsum(new) - 1]
        return out

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, at: np.ndarray, fresh: list[list[int]]) -> None:
        had = len(self.off)
        cnt = np.fromiter(map(len, fresh), np.int64, len(fresh))
        ids = np.fromiter((x for f in fresh for x in f), np.uint32, int(cnt.sum()))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.off = np.append(self.off, self.used + np.cumsum(cnt) - cnt)
        self.cnt = np.append(self.cnt, cnt)
        self.used += len(ids)
        self.known = np.insert(self.known, at, hashes)
        self.check = np.insert(self.check, at, checks)
        self.place = np.insert(self.place, at, np.arange(had, had + len(fresh)))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for c in chunks(texts, self.special):
            self.add_counts(c, out)
        return out

    def add_counts(self, c: Chunk, out: np.ndarray) -> None:
        """Adds a chunk's tokens to its texts' counts."""
        np.add.at(out, c.owner, self._per_segment(c, self._index(c.pieces)))

    def _per_segment(self, c: Chunk, at: np.ndarray) -> np.ndarray:
        per = np.diff(np.append(0, np.cumsum(self.cnt[at]))[c.pieces.per_text])
        for k, _ in c.special:
            per[k] = 1
        return per

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets."""
        flats, lens = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for c in chunks(texts, self.special):
            at = self._index(c.pieces)
            per = self._per_segment(c, at)
            np.add.at(lens, c.owner, per)
            flat = self.flat[expand(self.off[at], self.cnt[at])]
            if c.special:
                where = (np.cumsum(per) - per)[[k for k, _ in c.special]]
                flat = np.insert(flat, where - np.arange(len(where)), [x for _, x in c.special])
            flats.append(flat)
        return np.concatenate(flats), np.append(0, np.cumsum(lens))


@functools.lru_cache(maxsize=4)
def encoder(path: str, special: bool = True) -> Encoder:
    """One per worker process. special: the end-of-text string in a text is that one id."""
    return Encoder(path, {SPECIAL: 50256} if special else None)
