import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import neardup as nd


def bag(t):
    import re

    w = re.findall(r"\w+", t.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = {i: bag(t) for i, t in texts.items()}
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = bags[a], bags[b]
        u = sum((x | y).values())
        if texts[a] == texts[b] or (u and 5 * sum((x & y).values()) >= 4 * u):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


def test_signatures_estimate_weighted_jaccard():
    r = random.Random(1)
    for _ in range(4):
        a, b = Counter(), Counter()
        for k in range(300):
            base = r.choice([1, 1, 2, 3, 7])
            a[k] += base
            b[k if r.random() < 0.7 else 1000 + k] += r.choice([base, base, base + 1])
        true = sum((a & b).values()) / sum((a | b).values())
        h = [np.array([x * 2654435761 + 5 for x in s], np.uint64) for s in (a, b)]
        w = np.array([*a.values(), *b.values()])
        sig = nd.signatures(np.repeat([0, 1], [len(a), len(b)]), nd.mixed(np.concatenate(h)), w, 2, 4096)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    tiny = nd.signatures(np.array([0]), np.array([9], np.uint64), np.array([1]), 2, 64)
    assert np.isfinite(tiny[0]).all() and np.isinf(tiny[1]).all()


def test_signatures_do_not_depend_on_the_batch():
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghij") + str(r.randrange(99)) for _ in range(r.randrange(5, 400))) for _ in range(150)]

    def sig(ts):
        return nd.signatures(*nd.bags(*nd.shingles(ts)), len(ts))

    together = sig(texts)
    for k in range(0, 150, 10):
        assert (sig([texts[k]])[0] == together[k]).all()


def test_links_that_meet_only_in_large_buckets(spark):
    """Two families around one template, each linked within, and single links between texts that are nobody's centre."""
    r = random.Random(11)
    base = [f"w{r.randrange(9000)}" for _ in range(300)]
    rows = []
    for i in range(240):
        t = list(base)
        for _ in range(7 + i % 4):
            t[r.randrange(300)] = f"own{i}x{r.randrange(99)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in nd.classes(df).collect()}
    assert got == brute(rows) and len(set(got.values())) > 1


def test_classes_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.class_id for r in nd.classes(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(set(got.values())) < len(got)


def test_group_of_edited_copies_and_edge_cases(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    base = [r.choice(words) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, "..."), (3, "..."), (4, "one two"), (5, "ONE, two"), (6, "two one"), (500, " ".join(base))]
    for i in range(7, 60):
        t = list(base)
        for _ in range(8):
            t[r.randrange(400)] = "edit%d" % i
        rows.append((i, " ".join(t)))
    rows += [(i, " ".join(r.choice(words) for _ in range(50))) for i in range(60, 90)] + [(90, rows[-1][1])] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "one two", "x")], "doc_id long, text string, class_id string")
    got = nd.classes(df).collect()
    assert len(got) == len(rows) + 1
    assert {x.doc_id: x.class_id for x in got if x.doc_id is not None} == brute(rows)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {*brute(rows).values(), None}
    assert nd.classes(df.limit(0)).count() == 0


def test_equal_ids_with_different_texts_and_clashing_names(spark):
    """No text that stands once is lost, whatever ids and columns there are."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    a, b, c = words(1), words(2), words(3)
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (8, c + " more"), (None, a), (None, None), (9, None), (10, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, gone_id long").withColumns({"__gone": F.lit(1), "gone_t1": F.lit("x"), "first": F.lit(2), "t1": F.lit(3), "CNT": F.lit(4)})
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.gone_id for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8]
    got = sorted((r.doc_id, r.class_id, r.copy_of) for r in nd.classes(df).collect() if r.doc_id is not None)
    assert got == [(3, 3, 3), (5, 3, 3), (5, 5, 5), (7, 7, 7), (7, 7, 7), (8, 7, 8), (9, 9, 9), (10, 9, 9)]


def test_hot_keys_are_spread(spark, monkeypatch):
    """Buckets, copies, stars and pairs beyond the limit of one task give the same classes."""
    monkeypatch.setattr(nd, "limit_of", lambda rows: 5)
    r = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(base)) for i in range(20)]
    for i in range(20, 80):
        t = list(base)
        for k in r.sample(range(300), 2):
            t[k] = f"own{i}"
        rows.append((i, " ".join(t)))
    rows += [(i, " ".join(f"x{r.randrange(900)}" for _ in range(40))) for i in range(80, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in nd.classes(df).collect()}
    assert got == brute(rows) and len(set(got.values())) == 21


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 150: 100}
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0
