"""Words of many texts at once: \\w+ runs in lower case, as 64-bit hashes: sums of mixed (place, code point) pairs, so that no two words share one by their form."""

from __future__ import annotations

import functools

import numpy as np

from .common import mixed
from .tokens import place_hashes


#: Fixed, since hashes of one word must agree in all tasks.
KEY = 0x3C6EF372FE94F82B


@functools.cache
def _is_word() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (chr(c).isalnum() or c == 95):
            out[c] = True
    return out


class Words:
    """hashes of all words end to end; per_text: n + 1 offsets into them.

    keep: with the texts in lower case (joined, each with a line break after it; cps: as code
    points), where words start and end in that, and the hash value of each place.
    """

    def __init__(self, texts: list[str], keep: bool = False):
        low = [t.lower() for t in texts]
        joined = "\n".join(low) + "\n"
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(cps)
        word = np.zeros(n + 1, bool)
        word[1:] = _is_word()[cps]
        edge = word[1:] != word[:-1]
        at = np.flatnonzero(edge)
        # the last character is never a word's
        starts, ends = at[::2], at[1::2]
        values = place_hashes(cps, starts, ends, KEY) if len(at) else np.zeros(n, np.uint64)
        total = np.add.reduceat(values, at)[::2] if len(at) else np.zeros(0, np.uint64)
        self.hashes = mixed(total + (ends - starts).astype(np.uint64))
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
        self.per_text = np.append(0, np.searchsorted(starts, text_ends))
        if keep:
            self.joined, self.cps, self.starts, self.ends, self.values = joined, cps, starts, ends, values

    def stems(self, which: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first n letters of the given words (which must have as many), as hash_words gives them."""
        total = np.zeros(len(which), np.uint64)
        for k in range(n):
            total += self.values[self.starts[which] + k]
        return mixed(total + np.uint64(n))


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words that are \\w+ runs in lower case, as Words gives them."""
    return Words(words).hashes
