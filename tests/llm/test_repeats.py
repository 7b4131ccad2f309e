import hashlib
import random
from collections import Counter

import numpy as np

from quarry.llm import repeats as rp


def brute(rows, length=50):
    """doc -> list of (n_bytes, n_removed, n_spans, sha) of its rows."""
    least = {}
    for i, t in rows:
        if i is not None:
            for p in range(len(t) - length + 1):
                s = t[p : p + length]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if i is not None and least[t[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def check(df, rows, **kw):
    got = sorted((tuple(r)[:5] for r in rp.remove_repeats(df, **kw).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    return got


def test_maximal_repeats_against_brute_force():
    r = random.Random(3)
    for _ in range(40):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 14))) for _ in range(4)]
        got = {s: occ for s, occ in rp.maximal_repeats(texts, 2)}
        occ = {}
        for t, x in enumerate(texts):
            for a in range(len(x)):
                for z in range(a + 2, len(x) + 1):
                    occ.setdefault(x[a:z], []).append((t, a))
        want = {}
        for s, at in occ.items():
            left = [texts[t][a - 1] if a else (t, "start") for t, a in at]
            right = [texts[t][a + len(s)] if a + len(s) < len(texts[t]) else (t, "end") for t, a in at]
            if len(at) > 1 and len(set(left)) > 1 and len(set(right)) > 1:
                want[s] = sorted(at)
        assert got == want


def test_planted_repeats_over_many_blocks(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(30) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, 60)
            parts += [p[a : a + r.randint(20, 200)], text(r.randint(0, 5))]
        rows.append((i * 3, "".join(parts)))
    base = rows[40][1] + text(100)
    rows += [(1000 + i, base) for i in range(15)] + [(1, base), (2000, "ab" * 200), (2001, "ab" * 300), (2002, "x" * 49), (2003, "x" * 49), (2004, "y" * 50), (2005, "y" * 51), (5000, ""), (5001, None), (1000, base), (2000, "ab" * 200)]
    for i in range(10):
        t = base.split(" ")
        t[r.randrange(len(t))] = "edited"
        rows.append((3000 + i, " ".join(t)))
    rows += [(None, base), (None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string").repartition(3)
    got = check(df, [(i, (t or "").encode()) for i, t in rows], block_bytes=1 << 30)
    many = check(df, [(i, (t or "").encode()) for i, t in rows], block_bytes=1000)
    assert got == many and sum(x[2] for x in got) > 10000
    full = rp.remove_repeats(df, 50).filter("doc_id = 2001").collect()[0]
    assert [(s.start, s.end) for s in full.spans] == [(0, 600)] and full.kept == b""
    assert rp.remove_repeats(df.limit(0), 50).count() == 0


def brute_groups(rows, length=50):
    """(string, n, id, start) of every occurrence, from counts of all windows and of all windows with their next byte."""
    one, two = Counter(), Counter()
    for _, t in rows:
        for p in range(len(t) - length + 1):
            one[t[p : p + length]] += 1
            if p + length < len(t):
                two[t[p : p + length + 1]] += 1
    out = []
    for i, t in rows:
        n = [one[t[p : p + length]] for p in range(len(t) - length + 1)]
        a = 0
        for p in range(len(n)):
            if p + 1 == len(n) or not n[p] == n[p + 1] == two[t[p : p + length + 1]]:
                if n[p] > 1:
                    out.append((t[a : p + length], n[p], i, a))
                a = p + 1
    return out


def check_groups(df, rows, length=50, **kw):
    want = brute_groups(rows, length)
    got = sorted(tuple(r) for r in rp.repeat_groups(df, length, **kw).collect())
    assert got == sorted((hashlib.blake2b(s, digest_size=16).hexdigest(), len(s), n, i, a) for s, n, i, a in want)
    listed = Counter(r[0] for r in got)
    assert all(listed[r[0]] == r[2] for r in got)
    return want


def test_groups_list_every_occurrence(spark):
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(6)]
    rows = [(i, text(r.randint(0, 30)) + "".join(r.choice(passages)[r.randint(0, 90) :][: r.randint(40, 250)] + text(r.randint(0, 3)) for _ in range(r.randint(0, 4)))) for i in range(80)]
    rows += [(200, "ab" * 200), (201, "ab" * 90), (202, "x" * 49), (203, "y" * 50), (204, "y" * 51), (205, ""), (206, None), (207, passages[0] * 2), (3, passages[1]), (208, rows[5][1] + text(20)), (300, "z" * 1000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in [*rows, (None, passages[0])]], "doc_id long, text string, block string").repartition(3)
    data = [(i, (t or "").encode()) for i, t in rows]
    for size in (1 << 30, 1500):
        want = check_groups(df, data, block_bytes=size)
    assert max(n for _, n, _, _ in want) > 10 and max(len(s) for s, *_ in want) > 120
    assert rp.repeat_groups(df.limit(0)).count() == 0
    few = [(i, "".join(r.choice("ab") for _ in range(300))) for i in range(40)]
    check_groups(spark.createDataFrame(few, "doc_id long, text string"), [(i, t.encode()) for i, t in few], 28, block_bytes=2000)


def test_whole_table_groups_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check_groups(docs, [(r.doc_id, r.text.encode()) for r in docs.collect()], block_bytes=200_000)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, [(r.doc_id, r.text.encode()) for r in docs.collect()], block_bytes=200_000)


def test_other_lengths(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("ab") for _ in range(400))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x)[:3] for x in rp.remove_repeats(df, 28).collect())
    assert got == sorted(x[:3] for x in brute([(i, t.encode()) for i, t in rows], 28))
    assert np.array_equal(rp._leftmost(np.array([3, 1, 1, 2, 0], np.uint64), 3), [1, 1, 4])


def test_segment_hashes_tell_contents_apart():
    r = random.Random(8)
    parts = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(3000)})
    parts += [bytes(97 + (i.bit_count() + k) % 2 for i in range(4096)) for k in (0, 1)] + [b"a" * 8, b"a" * 9, b"a" * 8 + b"\0"]
    data = np.frombuffer(b"".join(parts) * 2 + bytes(8), np.uint8)
    size = np.array([len(p) for p in parts] * 2)
    h = rp.segment_hashes(data, np.cumsum(size) - size, size)
    assert len(set(h.tolist())) == len(set(parts)) and (h[: len(parts)] == h[len(parts) :]).all()


def test_messages_stay_in_proportion_to_the_input():
    for total in (0, 10**6, 5 * 10**8, 3 * 10**10, 10**12, 10**14):
        blocks, parts = rp.layout(total)
        assert blocks <= 10**6 and blocks * blocks <= max(1, total / 15 / 8) and 1 <= parts <= max(2 * blocks, 8192) and 4 * parts >= blocks
        assert blocks * rp.MOST_BYTES >= total


def test_a_plan_without_statistics(spark):
    """After a join, where the planner's estimate of the size is a product."""
    rows = [(i, "same passage of some fifty letters, here and there " * 2 + str(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df.join(spark.range(20).withColumnRenamed("id", "doc_id"), "doc_id"), [(i, t.encode()) for i, t in rows])
