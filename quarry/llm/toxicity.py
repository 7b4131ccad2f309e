"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Training reads a bounded sample of labelled rows (`sample` rows, the first by a
hash of the id). It gives the lexicon (words and word stems that toxic rows have
far more often); for the trees a row's features come from a lexicon without its
part of the sample, and the calibration reads scores of trees without it. What the
driver holds is bounded by `sample` and `entries`. Scoring is one map over the
documents, without a shuffle. Label, language, source and id are never inputs.

Features of a text: densities and numbers of lexicon hits, how near they stand
to second-person words, capitals, punctuation, and obfuscated words (symbols or
digits inside, drawn-out letters) and lexicon hits among them once undone.

Edge cases: a null text is empty and is scored like any other; a null id is
scored and never trained on; repeated label rows count once, with the largest
label, and labels other than 0 and 1 not at all; rows that repeat a sampled id are
in the sample with it, by its first text; without both labels in the sample every score is the share of toxic
rows; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, docs_of, materialise, mixed, slices
from .words import Words, hash_words

STEMS = range(4, 8)
#: Parts of the sample for features and calibration out of fold, and how much likelier in toxic rows an entry must be.
PARTS, ODDS = 5, 12
#: Weights are whole ten-thousandths, so that their sums do not depend on the order.
WHOLE = 10_000
YOU = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes vosotros ti tus su".split())
UNDO = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "5": "s", "7": "t", "*": "", "_": "", "-": "", ".": "", "#": "", "%": "", "&": ""})
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = "A-Z À-Ö Ø-Þ Α-Ω А-Я"
REMEMBER = 500_000
#: Bytes of text whose features are found at once.
PART = 250_000
NAMES = ["log_words", "hits", "density", "weight_sum", "weight_max", "weight_density", "distinct_hits", "near_you", "you_density", "caps_letters", "caps_words", "punct", "exclaim", "odd_words", "odd_hits", "drawn", "digits", "line_hits"]
_STEM = np.uint64(0x5851F42D4C957F2D)
SPACE, ALPHA, LETTER, DIGIT, PUNCT, CAPITAL, UPPER, LOWER, EDGE = (1 << k for k in range(9))


@functools.cache
def _flags() -> np.ndarray:
    """What each code point is."""
    every = np.array([chr(c) for c in range(0x110000)])
    is_ = np.char
    word = is_.isalnum(every)
    word[ord("_")] = True
    space, digit = is_.isspace(every), is_.isdecimal(every)
    letter = word & ~digit
    letter[ord("_")] = False
    out = np.zeros(0x110000, np.uint16)
    for bit, mask in ((SPACE, space), (ALPHA, is_.isalpha(every)), (LETTER, letter), (DIGIT, digit), (PUNCT, ~word & ~space), (UPPER, is_.isupper(every)), (LOWER, is_.islower(every) | is_.istitle(every) & ~is_.isupper(every))):
        out[mask] |= bit
    for r in CAPITALS.split():
        out[ord(r[0]) : ord(r[2]) + 1] |= CAPITAL
    out[[ord(c) for c in EDGES]] |= EDGE
    return out


@functools.cache
def _you() -> np.ndarray:
    return np.sort(hash_words(sorted(YOU)))


def entries_of(word: str):
    """A word and its stems, as the lexicon names them."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


class Lexicon(dict):
    """Entries with their weights; remembers what it has said of undone words (up to REMEMBER of them)."""

    def __init__(self, entries: dict[str, float]):
        super().__init__(entries)
        self.said: dict[str, float] = {}
        names = list(entries)
        h = hash_words([e.rstrip("*") for e in names]) if names else np.zeros(0, np.uint64)
        h = h ^ np.where([e.endswith("*") for e in names], _STEM, np.uint64(0)).astype(np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        self.whole = np.rint(np.asarray(list(entries.values()), float)[order] * WHOLE).astype(np.int64)

    def __reduce__(self):
        return Lexicon, (dict(self),)

    def weight(self, word: str) -> float:
        v = self.said.get(word)
        if v is None:
            if len(self.said) >= REMEMBER:
                self.said.clear()
            v = self.said[word] = max((self[e] for e in entries_of(word) if e in self), default=0.0)
        return v

    def _of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.whole[at], 0)

    def weights(self, w: Words, which: np.ndarray) -> np.ndarray:
        """The given words' weights, in ten-thousandths: the greatest of a word's entries."""
        out = self._of(w.hashes[which])
        size = w.ends[which] - w.starts[which]
        for n in STEMS:
            long = np.flatnonzero(size > n)
            out[long] = np.maximum(out[long], self._of(w.stems(which[long], n) ^ _STEM))
        return out


def _by_text(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of each (text, word)."""
    return mixed(hashes + text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _sums(mask: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """How often mask holds in a to z, for all pairs of them."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[z] - total[a]


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """A row of NAMES for each text; texts without words have zeros throughout."""
    m = len(texts)
    if not m:
        return np.zeros((0, len(NAMES)))
    w = Words(texts, keep=True)
    n = np.diff(w.per_text)
    text = np.repeat(np.arange(m), n)
    per = lambda where, x=None: np.bincount(where, x, m)
    _, one, pair = np.unique(_by_text(text, w.hashes), return_index=True, return_inverse=True)
    _, first, inv = np.unique(w.hashes[one], return_index=True, return_inverse=True)
    first, inv = one[first], inv.reshape(-1)[pair.reshape(-1)]
    weight = lexicon.weights(w, first)[inv] if len(first) else np.zeros(0, np.int64)
    hit = np.flatnonzero(weight > 0)
    you = np.flatnonzero(np.isin(w.hashes[first], _you())[inv])
    hits, n_you, total = per(text[hit]), per(text[you]), per(text, weight) / WHOLE
    most = np.zeros(m, np.int64)
    np.maximum.at(most, text[hit], weight[hit])
    near = np.zeros(m)
    if len(hit) and len(you):
        k = np.searchsorted(you, hit)
        for j in (np.maximum(k - 1, 0), np.minimum(k, len(you) - 1)):
            same = text[you[j]] == text[hit]
            np.maximum.at(near, text[hit[same]], 1 / (1 + np.abs(you[j] - hit)[same]))
    c = w.cps
    drawn = np.zeros(len(w.hashes), bool)
    four = np.flatnonzero((c[:-3] == c[1:-2]) & (c[1:-2] == c[2:-1]) & (c[2:-1] == c[3:])) if len(c) > 3 else np.zeros(0, np.int64)
    owner = np.searchsorted(w.starts, four, "right") - 1
    inside = (owner >= 0) & (four < w.ends[owner]) if len(w.ends) else np.zeros(len(four), bool)
    drawn[owner[inside]] = True
    distinct, distinct_hits, n_drawn = per(text[one]), per(text[one[weight[one] > 0]]), per(text[one[drawn[one]]])
    line = np.unique(np.searchsorted(np.flatnonzero(c == 10), w.starts[hit]), return_index=True)[1]
    hit_lines = per(text[hit[line]])
    # characters as they stand
    joined = "\n".join(texts) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    f = _flags()[c]
    size = np.fromiter(map(len, texts), np.int64, m)
    ends = np.cumsum(size + 1)
    count = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), ends), prepend=0)
    flagged = lambda bit: (f & bit) != 0
    break_ = c == 10
    lines = count(~break_ & np.append(True, break_[:-1]))
    run = np.flatnonzero(np.diff(np.concatenate([[True], flagged(SPACE)])))
    a, z = run[::2], run[1::2]  # the last character is white space
    which = np.searchsorted(ends, a, "right")
    in_run = lambda bit: _sums(flagged(bit), a, z)
    caps = per(which[(in_run(UPPER) > 0) & (in_run(LOWER) == 0)])
    other = np.flatnonzero(in_run(ALPHA) < z - a)
    odd, undone = _odd(joined, f, a[other], z[other], which[other], lexicon, m)
    some, chars = np.maximum(n, 1), np.maximum(size, 1)
    out = np.stack([np.log1p(n), np.minimum(hits, 50), hits / some, np.minimum(total, 200.0), most / WHOLE, total / some, distinct_hits, near, n_you / some, count(flagged(CAPITAL)) / chars, caps / np.maximum(1, per(which)), count(flagged(PUNCT)) / chars, count(c == 33) / chars, odd / some, np.minimum(undone, 20), n_drawn / np.maximum(distinct, 1), count(flagged(DIGIT)) / chars, np.where(hits > 0, hit_lines / np.maximum(1, lines), 0.0)], 1)
    out[n == 0] = 0
    return out


def _odd(joined: str, f: np.ndarray, a: np.ndarray, z: np.ndarray, which: np.ndarray, lexicon: Lexicon, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the words with letters that are not letters throughout, edges of punctuation aside, and how many of them are in the lexicon once undone."""
    inner = np.flatnonzero((f & (EDGE | SPACE)) == 0)
    lo, hi = np.searchsorted(inner, a), np.searchsorted(inner, z)
    some = lo < hi
    a, z, which = inner[lo[some]], inner[hi[some] - 1] + 1, which[some]
    is_odd = (_sums((f & ALPHA) != 0, a, z) < z - a) & (_sums((f & LETTER) != 0, a, z) > 0)
    a, z, which = a[is_odd], z[is_odd], which[is_odd]
    found = np.fromiter((lexicon.weight(joined[x:y].lower().translate(UNDO)) > 0 for x, y in zip(a.tolist(), z.tolist())), bool, len(a))
    return np.bincount(which, minlength=m), np.bincount(which[found], minlength=m)


@dataclass
class Boosted:
    """Logistic boosting with histogram trees of fixed depth."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, value, as heaps
    depth: int = 3

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1).astype(np.int16) if len(x) else np.zeros((0, len(self.edges)), np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, l2: float = 1.0, n_bins: int = 32) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = self.bins(x)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        z = np.full(len(y), self.base)
        width = n_bins + 1
        flat = b + (np.arange(x.shape[1]) * width).astype(np.int64)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, q * (1 - q) + 1e-9
            feat, cut, value = (np.zeros(2 ** (self.depth + 1), t) for t in (np.int64, np.int64, float))
            node = np.ones(len(y), np.int64)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    rows = np.flatnonzero(node == k)
                    feat[k] = -1
                    if len(rows) < 2:
                        continue
                    f = flat[rows].ravel()
                    gs = np.bincount(f, np.repeat(g[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                    hs = np.bincount(f, np.repeat(h[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                    best = int(gain.argmax())
                    if gain.flat[best] < 1e-6:
                        continue
                    feat[k], cut[k] = divmod(best, width)
                    node[rows] = 2 * k + (b[rows, feat[k]] > cut[k])
            for k in np.unique(node):
                rows = node == k
                value[k] = rate * g[rows].sum() / (h[rows].sum() + l2)
            z += value[node]
            self.trees.append((feat, cut, value))
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feat, cut, value in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                live = (node < len(feat) // 2) & (feat[np.minimum(node, len(feat) - 1)] >= 0)
                f = np.maximum(feat[node], 0)
                node = np.where(live, 2 * node + (b[rows, f] > cut[node]), node)
            z += value[node]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; breakpoints and values for linear interpolation. Equal z are one block from the start, in whatever order they come."""
    values, at = np.unique(z, return_inverse=True)
    blocks: list[list[float]] = []  # sum, n, low, high
    for a, v, n in zip(values.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist()):
        blocks.append([v, n, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    xs, ys = [], []
    for s, n, lo, hi in blocks:
        v = (s + 0.5 * y.mean()) / (n + 0.5)
        xs += [lo, hi] if hi > lo else [lo]
        ys += [v, v] if hi > lo else [v]
    return np.asarray(xs), np.maximum.accumulate(np.asarray(ys))


@dataclass
class Model:
    lexicon: Lexicon
    prior: float
    trees: Boosted | None = None
    xs: np.ndarray | None = None
    ys: np.ndarray | None = None

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return np.clip(np.interp(self.trees.decision(features(texts, self.lexicon)), self.xs, self.ys), 0, 1)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out from training."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5))


def entry_counts(texts: list[str], y: list[int], part: list[int]) -> pa.RecordBatch:
    """(entry, part, neg, pos): in how many of a part's texts of each label a word or stem stands."""
    w = Words(texts, keep=True)
    text = np.repeat(np.arange(len(texts)), np.diff(w.per_text))
    word = np.unique(_by_text(text, w.hashes), return_index=True)[1]
    size = (w.ends - w.starts)[word]
    hashes, at, cut = [w.hashes[word]], [word], [size]
    for n in STEMS:
        long = word[size > n]
        hashes.append(w.stems(long, n) ^ _STEM)
        at.append(long)
        cut.append(np.full(len(long), n))
    h, at, cut = map(np.concatenate, (hashes, at, cut))
    one = np.unique(_by_text(text[at], h), return_index=True)[1]
    h, at, cut = h[one], at[one], cut[one]
    t, y, part = text[at], np.asarray(y, np.int64), np.asarray(part, np.int64)
    _, first, group = np.unique(mixed(h + part[t].astype(np.uint64)), return_index=True, return_inverse=True)
    pos = np.bincount(group.reshape(-1), y[t], len(first)).astype(np.int64)
    both = np.bincount(group.reshape(-1), minlength=len(first))
    start, end = w.starts[at[first]], w.ends[at[first]]
    names = [w.joined[a : a + c] + ("*" if a + c < z else "") for a, z, c in zip(start.tolist(), end.tolist(), cut[first].tolist())]
    return pa.RecordBatch.from_pydict({"entry": pa.array(names, pa.string()), "part": pa.array(part[t[first]], pa.int32()), "neg": pa.array(both - pos), "pos": pa.array(pos)})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = 20_000, entries: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled rows outside of the held-out fold; at most `sample` of them, and `entries` in the lexicon."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().filter("y IN (0, 1)").filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    src = docs_of(docs, id_col, text_col)
    # the sample has at most `sample` rows of 12 bytes
    found = src.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = materialise(found.select("doc_id", "text", "y", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(PARTS)).alias("part")), "toxicity-sample")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 0.0
    if not n.get(1) or not n.get(0):
        discard(rows)
        return Model(Lexicon({}), prior)

    def words(batches):
        for whole in batches:
            for b in slices(whole, limit=PART):
                yield entry_counts(*(b.column(i).to_pylist() for i in range(3)))

    rows = (sample_rows := rows).select("text", F.col("y").cast("int").alias("y"), F.col("part").cast("int").alias("part"))
    sizes = np.zeros((PARTS, 2))
    for r in rows.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.part, r.y] = r.n
    counted = rows.select("text", "y", "part").mapInArrow(words, "entry string, part int, neg long, pos long")
    each = [F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(PARTS) for c in ("neg", "pos")]
    totals = counted.groupBy("entry").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), *each)
    least = max(3, int(0.002 * sizes[:, 1].sum()))
    w = F.log((F.col("pos") + 0.25) / (sizes[:, 1].sum() + 1)) - F.log((F.col("neg") + 0.25) / (sizes[:, 0].sum() + 1))
    found = totals.filter(F.col("pos") >= least).withColumn("w", w).filter(F.col("w") >= math.log(ODDS)).orderBy(F.desc(F.col("w") * F.sqrt("pos")), "entry").limit(entries).collect()

    def lexicon(without: int | None) -> Lexicon:
        n0, n1 = (sizes[:, y].sum() - (sizes[without, y] if without is not None else 0) for y in (0, 1))
        out = {}
        for r in found:
            neg, pos = (r[c] - (r[f"{c}{without}"] if without is not None else 0) for c in ("neg", "pos"))
            v = math.log((pos + 0.25) / (n1 + 1)) - math.log((neg + 0.25) / (n0 + 1))
            if pos >= 2 and v >= math.log(ODDS):
                out[r.entry] = round(v, 4)
        return Lexicon(out)

    model = Model(lexicon(None), prior)
    without = [lexicon(k) for k in range(PARTS)]  # a row's features never come from its own label

    def feats(batches):
        for whole in batches:
            for b in slices(whole, limit=PART):
                texts, part = b.column(0).to_pylist(), np.asarray(b.column(2))
                x = np.zeros((len(texts), len(NAMES)))
                for k in range(PARTS):
                    own = np.flatnonzero(part == k)
                    x[own] = features([texts[i] for i in own], without[k])
                yield pa.RecordBatch.from_pydict({"y": b.column(1), "part": b.column(2), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    # sorted: sums of doubles, and so the model, do not depend on the order in which tasks end
    rest = sorted((r.part, r.y, r.x) for r in rows.mapInArrow(feats, "y int, part int, x array<double>").collect())
    x = np.asarray([r[2] for r in rest], float).reshape(len(rest), len(NAMES))
    yy, part = np.asarray([r[1] for r in rest], float), np.asarray([r[0] for r in rest])
    z = np.zeros(len(yy))
    for k in range(PARTS):
        if (part == k).any() and (part != k).any():
            z[part == k] = Boosted().fit(x[part != k], yy[part != k]).decision(x[part == k])
    discard(sample_rows)
    model.trees = Boosted().fit(x, yy)
    model.xs, model.ys = isotonic(z, yy)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, limit=PART):
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(model.score(b.column(1).to_pylist()), pa.float64())})

    return docs_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of docs whose text scores below the threshold, with all their columns."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col, PART):
                s = model.score([t or "" for t in b.column(at).to_pylist()])
                yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, schema)
