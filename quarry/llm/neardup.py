"""Near-duplicates by BagMinHash over multisets of word shingles.

Each text is the multiset of its five-word shingles. Its signature comes from
Poisson processes over the weight axis, split at 0, 1, 2, 4, 8, ...: a shingle
of weight w takes the processes of all intervals below w, and of the interval
that holds w the points below it. Component i keeps the earliest point that
falls to it, so two signatures agree in a component with the probability of
the weighted Jaccard similarity. Points come in time order, and a shingle stops
when its next point is later than all minima of its text.

BANDS bands of ROWS components give buckets. Of a pair with similarity 0.8 the
chance to share none is (1 - 0.8**6)**42 < 3e-6. Texts with equal multisets are
collapsed before; within a bucket candidates are all pairs where it holds at
most SMALL texts, else each text with the bucket's centre and its neighbour.
The centre is the text with most bucket mates overall: in a group of edited
copies that is the text they were made from. A bucket with more than a 10,000th
of all rows is dealt out in parts, each with neighbours of its own, and its
centre is broadcast. Rows are linear in the input. Candidates are verified on
whole multisets, and classes are the connected components of verified links,
found by alternating large-star and small-star steps on tables in the shared
folder, until all links are stars.

Then larger buckets that still hold several components are settled. Buckets
that share texts form crowds; in each, every text outside the crowd's main
component meets every text of other components, in blocks of about BLOCK bytes a
side. Pairs whose signatures agree in at least PLAUSIBLE of their components (a
pair at 0.8 falls below with a probability under 4e-6) are verified in the block
on whole multisets, and the block gives out only links that join components. So
no link inside a bucket is passed over, buckets of one component cost nothing,
and rows stay linear in the input.

Edge cases: words are \\w+ runs in lower case; a text of one to four words is
one shingle; texts without words are alike only if equal; a null text is
empty; rows with a null id get a null class; rows with equal ids and texts are
one document, rows with equal ids and different texts are different ones, each
with its own class (whose name, the least id in it, another class may then have
too); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, docs_of, expand, free, limit_of, materialise, mixed, slices, spread
from .words import Words

SHINGLE = 5
BANDS, ROWS = 42, 6
SMALL = 8
#: Times are whole ticks, so sums of them are exact and do not depend on which texts are sketched together.
TICKS = 2.0**38
BLOCK, PLAUSIBLE = 16 << 20, 0.68
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle."""
    w = Words(texts)
    n = np.diff(w.per_text)
    h = np.append(w.hashes, np.zeros(SHINGLE, np.uint64))
    g = np.zeros(len(w.hashes), np.uint64)
    for k in range(SHINGLE):
        g = mixed(g * _K + h[k : len(g) + k])
    full = n >= SHINGLE
    counts = np.where(full, n - SHINGLE + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    out = g[expand(w.per_text[:-1], counts)]
    short = np.flatnonzero((n > 0) & ~full)
    one = []
    for t in short.tolist():
        v = np.full(1, n[t], np.uint64)
        for x in w.hashes[w.per_text[t] : w.per_text[t + 1]]:
            v = mixed(v * _K + x)
        one.append(v[0])
    return np.concatenate([text, short]), np.concatenate([out, np.asarray(one, np.uint64)])


def bags(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) without repeats, by text and hash."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(n, m) times of the earliest points, in ticks; infinite for texts without elements."""
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    level = expand(np.zeros(len(levels), np.int64), levels)
    elem = np.repeat(np.arange(len(h)), levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    share = np.minimum((weight[elem] - low) / width, 1.0)  # the part of the interval below the weight
    seed = mixed(h[elem] + level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
    where = text[elem]
    t = np.zeros(len(elem))
    c = np.zeros(len(elem), np.uint64)
    sig = np.full(n * m, np.inf)
    while len(t):
        g = int(np.clip(40_000 // len(t), 1, 64))
        turn = c[:, None] + np.arange(1, g + 1, dtype=np.uint64)
        u = mixed(seed[:, None] + turn * _K)
        v = mixed(u ^ np.uint64(0xA0761D6478BD642F))
        at = t[:, None] + np.cumsum(np.floor(np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * -TICKS / width[:, None]), 1)
        comp = ((v >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        ok = (v & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < share[:, None]
        np.minimum.at(sig, (where[:, None] * m + comp)[ok], at[ok])
        t, c = at[:, -1], c + np.uint64(g)
        live = t < sig.reshape(n, m).max(1)[where]
        t, c, seed, width, share, where = t[live], c[live], seed[live], width[live], share[live], where[live]
    return sig.reshape(n, m)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t1, t2, k1, k2, total, bands): 128 bits of the text and of its multiset, the multiset's size, and bucket keys (none for texts without words)."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, limit=2_000_000):
                texts = b.column(3).to_pylist()
                n = len(texts)
                text, h, w = bags(*shingles(texts))
                x = mixed(h + w.astype(np.uint64) * _K)
                keys = []
                for salt in (1, 2):
                    k = np.zeros(n, np.uint64)
                    np.add.at(k, text, mixed(x ^ np.uint64(salt)))
                    keys.append(mixed(k))
                total = np.bincount(text, w, n).astype(np.int64)
                for i in np.flatnonzero(total == 0).tolist():
                    d = hashlib.sha256(texts[i].encode()).digest()
                    keys[0][i], keys[1][i] = (int.from_bytes(d[j : j + 8], "little") for j in (0, 8))
                sig = signatures(text, h, w, n).view(np.uint64).reshape(n, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
                for r in range(ROWS):
                    key = mixed(key * _K + sig[:, :, r])
                size = np.where(total > 0, BANDS, 0)
                flat = key.view(np.int64).reshape(-1)[np.repeat(total > 0, BANDS)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(k.view(np.int64)) for k in keys), pa.array(total), lists], names=["doc_id", "t1", "t2", "k1", "k2", "total", "bands"])

    return hashed(docs_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, t1 long, t2 long, k1 long, k2 long, total long, bands array<long>")


def text_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def hashed(src: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text) from (doc_id, text)."""
    return src.select("doc_id", *(h.alias(n) for h, n in zip(text_hashes(F.col("text")), ("t1", "t2"))), "text")


def buckets(reps: DataFrame) -> DataFrame:
    """(rep, total, key, cnt, hot, part) for every bucket of two or more, from (rep, total, bands); a hot bucket is dealt out in parts."""
    rows = reps.select("rep", "total", F.explode("bands").alias("key"))
    counts = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1"), "neardup-counts")
    limit = limit_of(BANDS * reps.count())
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("cnt") / limit)).cast("int")
    out = materialise(spread(rows, counts, "key", limit).select("rep", "total", "key", "cnt", (F.col("cnt") > limit).alias("hot"), part.alias("part")), "neardup-buckets")
    discard(counts)
    return out


def candidates(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of small buckets, centre and neighbour in larger ones."""
    mates = shared.groupBy("rep").agg(F.sum("cnt").alias("mates"))
    w = Window.partitionBy("key", "part").orderBy(F.desc("mates"), "rep")
    me = F.struct("rep", "total")
    back = [F.lag(me, k).over(w) for k in range(1, SMALL)]
    known = shared.join(mates, "rep")
    # at most 10,000 buckets are hot
    centres = known.filter("hot").groupBy("key").agg(F.min_by(me, F.struct(-F.col("mates"), "rep")).alias("centre"))
    ranked = known.join(F.broadcast(centres), "key", "left").select("rep", "total", F.array("centre", F.first(me).over(w.rowsBetween(Window.unboundedPreceding, 0)), back[0], *[F.when(F.col("cnt") <= SMALL, b) for b in back[1:]]).alias("others"))
    pairs = ranked.select("rep", "total", F.explode(F.array_distinct(F.filter("others", lambda o: o.isNotNull()))).alias("o")).select("rep", "total", F.col("o.rep").alias("o"), F.col("o.total").alias("ot"))
    fits = pairs.filter((F.col("rep") != F.col("o")) & (5 * F.least("total", "ot") >= 4 * F.greatest("total", "ot")))
    return fits.select(F.least("rep", "o").alias("a"), F.greatest("rep", "o").alias("b")).distinct()


def _by_key(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined with a table of one row for each key; hot keys, 10,000 at most, are broadcast."""
    hot = rows.filter("hot").join(F.broadcast(table.filter("hot").drop("hot")), "key")
    return hot.unionByName(rows.filter("NOT hot").join(table.filter("NOT hot").drop("hot"), "key"))


def crowds(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(crowd, rep, total, comp, minor, ni, nj): texts in crowds of several components; two texts of one large bucket share a crowd."""
    big = shared.filter(F.col("cnt") > SMALL).join(roots, F.col("rep") == F.col("node"), "left").select("key", "hot", "rep", "total", F.coalesce("root", "rep").alias("comp"))
    split = big.groupBy("key", "hot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("first")).filter("lo <> hi").select("key", "hot", "first")
    rows = materialise(_by_key(big, split), "neardup-open")
    label = rows.groupBy("rep").agg(F.min("first").alias("label"))
    crowd = rows.join(label, "rep").groupBy("key", "hot").agg(F.min("label").alias("crowd"))
    each = materialise(_by_key(rows, crowd).select("crowd", "rep", "total", "comp").distinct(), "neardup-crowds")
    cost = F.sum(8 * F.col("total") + (BLOCK >> 10))
    parts = each.groupBy("crowd", "comp").agg(F.count(F.lit(1)).alias("n"), cost.alias("cost"))
    sums = parts.groupBy("crowd").agg(F.max_by(F.struct("comp", "cost"), F.struct("n", "comp")).alias("main"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    out = materialise(each.join(sums.select("crowd", F.col("main.comp").alias("main"), blocks(F.col("cost") - F.col("main.cost")).alias("ni"), blocks(F.col("cost")).alias("nj")), "crowd").withColumn("minor", F.col("comp") != F.col("main")).drop("main"), "neardup-members")
    discard(rows, each)
    return out


def settled(members: DataFrame, bag: DataFrame) -> DataFrame:
    """(a, b): links between components of one crowd, as many as join what they join; members as crowds gives them, bag has (id, bag, sig)."""
    rows = members.join(bag.hint("merge"), members["rep"] == bag["id"])
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), n.cast("long")).cast("int")
    row = ["rep", "total", "comp", "minor", "sig", "bag"]
    left = rows.filter("minor").select("crowd", own(F.col("ni")).alias("i"), every(F.col("nj")).alias("j"), F.lit(True).alias("query"), *row)
    right = rows.select("crowd", every(F.col("ni")).alias("i"), own(F.col("nj")).alias("j"), F.lit(False).alias("query"), *row)
    cells = left.unionByName(right).repartition("crowd", "i", "j").sortWithinPartitions("crowd", "i", "j")

    def run(batches):
        cell, held = None, []
        for b in batches:
            at = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
            cut = np.append(0, np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1) if len(at) else np.zeros(0, np.int64)
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
                if held and tuple(at[s]) != cell:
                    yield _joining(held)
                    held = []
                cell = tuple(at[s])
                held.append(b.slice(s, e - s))
        if held:
            yield _joining(held)

    return cells.mapInArrow(run, "a long, b long")


def _joining(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Links of one block that join components."""
    t = pa.Table.from_batches(parts)
    query, minor = (t[c].to_numpy().astype(bool) for c in ("query", "minor"))
    rep, total, comp = (t[c].to_numpy() for c in ("rep", "total", "comp"))
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    bag = t["bag"]
    at: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := at.get(x, x)) != x:
            x = y
        return x

    r = np.flatnonzero(~query)
    a, b = [], []
    for q in np.flatnonzero(query).tolist():
        ok = (comp[r] != comp[q]) & (5 * np.minimum(total[r], total[q]) >= 4 * np.maximum(total[r], total[q])) & (~minor[r] | (rep[r] > rep[q]))
        hit = r[ok]
        hit = hit[(sig[hit] == sig[q]).mean(1) >= PLAUSIBLE]
        mine = bag[q].as_buffer() if len(hit) else None
        for k in hit.tolist():
            x, y = top(int(comp[q])), top(int(comp[k]))
            if x != y and alike(*overlap(mine, bag[k].as_buffer())):
                at[max(x, y)] = min(x, y)
                a.append(int(rep[q]))
                b.append(int(rep[k]))
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def bag_bytes(src: DataFrame, reps: DataFrame, ids: DataFrame, with_sig: bool = False) -> DataFrame:
    """(id, bag, sig): a byte for each signature component if asked for, and whole multisets of the texts in ids (numbers as reps has them), as sorted 64-bit values; the j-th copy of a shingle is a value of its own."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, limit=2_000_000):
                text, h, w = bags(*shingles(b.column(1).to_pylist()))
                sig = [x.tobytes() for x in mixed(signatures(text, h, w, b.num_rows).view(np.uint64)).astype(np.uint8)] if with_sig else [None] * b.num_rows
                j = expand(np.zeros(len(w), np.int64), w)
                v = mixed(np.repeat(h, w) + j.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                t = np.repeat(text, w)
                v = v[np.lexsort((v, t))]
                off = 8 * np.append(0, np.cumsum(np.bincount(t, minlength=b.num_rows)))
                raw = v.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[x:y] for x, y in zip(off[:-1], off[1:])], pa.binary()), pa.array(sig, pa.binary())], names=["id", "bag", "sig"])

    # ids grow with the corpus, so they are never broadcast, however few they are here
    named = reps.select(F.col("rep").alias("id"), "doc_id", "t1", "t2").join(ids.hint("merge"), "id", "left_semi")
    texts = hashed(src).join(named.hint("merge"), ["doc_id", "t1", "t2"]).select("id", "text")
    return materialise(texts.mapInArrow(run, "id long, bag binary, sig binary").dropDuplicates(["id"]), "neardup-bags")


def overlap(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of the multisets' intersection and union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def alike(both: int, union: int, parts: int = 5, of: int = 4) -> bool:
    return union > 0 and parts * both >= of * union


def verified(pairs: DataFrame, bag: DataFrame, parts: int = 5, of: int = 4) -> DataFrame:
    """Pairs whose multisets have parts * |intersection| >= of * |union|."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                keep.append(alike(*overlap(x, y), parts, of))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    limit = limit_of(pairs.count())
    for k, own in (("a", "x"), ("b", "y")):
        # a text in very many pairs goes out in copies, one for each part of them; at most 10,000 texts are
        hot = F.broadcast(pairs.groupBy(k).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > limit).select(F.col(k).alias("id"), F.ceil(F.col("cnt") / limit).cast("int").alias("parts")))
        copies = bag.join(hot, "id", "left").select(F.col("id").alias(k), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("bag").alias(own))
        part = F.pmod(F.xxhash64("b" if k == "a" else "a"), F.coalesce("parts", F.lit(1))).cast("int")
        pairs = pairs.join(hot.withColumnRenamed("id", k), k, "left").withColumn("part", part).drop("parts").join(copies, [k, "part"]).drop("part")
    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _shape(e: DataFrame) -> tuple[int, int]:
    """Of links (u, v), v < u: how many nodes keep them from being stars around their least nodes, and the most links of one node."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    each = ends.groupBy("n").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("cnt"))
    r = each.agg(F.count_if(F.expr("up > 1 OR up = 1 AND cnt > 1")).alias("open"), F.coalesce(F.max("cnt"), F.lit(0)).alias("most")).first()
    return r.open, r.most


def components(links: DataFrame) -> DataFrame:
    """(node, root): each linked node and the least node of its component, roots themselves left out."""
    e = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        open_, most = _shape(e)
        if not open_:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        limit = limit_of(2 * e.count())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("cnt")).select("u", F.least("u", "m").alias("m"), "cnt")
        met = spread(both, least, "u", limit) if most > limit else both.join(least, "u")
        large = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialise(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)


def _firsts(reps: DataFrame, roots: DataFrame) -> DataFrame:
    """(k1, k2, cnt, copy_of, first): for each multiset the least id that has it, and the first (doc_id, t1, t2) of its class."""
    me = F.struct("doc_id", "t1", "t2")
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    names = materialise(linked.join(reps.select(F.col("rep").alias("node"), "doc_id", "t1", "t2"), "node").groupBy("root").agg(F.min(me).alias("first"), F.count(F.lit(1)).alias("cnt")), "neardup-names")
    first = spread(linked, names, "root", limit_of(linked.count())).select("node", "first")
    out = materialise(reps.join(first, F.col("rep") == F.col("node"), "left").select("k1", "k2", "cnt", F.col("doc_id").alias("copy_of"), F.coalesce("first", me).alias("first")), "neardup-firsts")
    discard(names)
    return out


def _settled_classes(src: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, copy_of, first) for every row with an id, and with nulls for one without."""
    sk = materialise(sketch(src), "neardup-sketch")
    has = sk.filter("doc_id IS NOT NULL")
    row = F.struct("doc_id", "t1", "t2", "total", "bands")
    one = has.groupBy("k1", "k2").agg(F.min_by(row, F.struct("doc_id", "t1", "t2")).alias("r"), F.count(F.lit(1)).alias("cnt"))
    # numbers are fixed once written
    reps = materialise(one.select("k1", "k2", "cnt", "r.*").withColumn("rep", F.monotonically_increasing_id()), "neardup-reps")
    shared = buckets(reps)
    pairs = materialise(candidates(shared), "neardup-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    bag = bag_bytes(src, reps, ids)
    roots = components(verified(pairs, bag))
    open_ = crowds(shared, roots)
    if not open_.isEmpty():
        more = bag_bytes(src, reps, open_.select(F.col("rep").alias("id")).distinct(), True)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(settled(open_, more)))
        discard(more)
    first = _firsts(reps, roots)
    discard(reps, shared, pairs, bag, open_)
    out = spread(has.select("doc_id", "t1", "t2", "k1", "k2"), first, ["k1", "k2"], limit_of(sk.count())).select("doc_id", "t1", "t2", "copy_of", "first")
    none = sk.filter("doc_id IS NULL").select("doc_id", "t1", "t2")
    return out.unionByName(none, allowMissingColumns=True)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_of) for every row: the least id of its class, and of the documents with its very multiset."""
    return _settled_classes(docs_of(docs, id_col, text_col)).select("doc_id", F.col("first.doc_id").alias("class_id"), "copy_of")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that are the first of their class, by id and then by the text's hash, with all their columns and whatever their names; rows with a null id stay.

    Rows that are equal in id and text are one document: they all stay or all go.
    """
    names = free(docs.columns, "gone_id", "gone_t1", "gone_t2")
    rows = _settled_classes(docs_of(docs, id_col, text_col)).filter("first <> struct(doc_id, t1, t2)")
    gone = rows.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "t1", "t2"), names))).distinct()
    own = [docs[id_col].cast("long"), *text_hashes(F.coalesce(docs[text_col].cast("string"), F.lit("")))]
    on = functools.reduce(lambda x, y: x & y, (c == F.col(n) for c, n in zip(own, names)))
    return docs.join(gone, on, "left_anti")
