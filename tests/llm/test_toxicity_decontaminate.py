import itertools
import math
import random
import re

import numpy as np

from quarry.llm import decontaminate as dc
from quarry.llm import entry_points, toxicity


def auc(score, y):
    s, y = np.asarray(score), np.asarray(y)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean()) if len(a) and len(b) else 1.0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = entry_points.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert auc([r.score for r in got], [r.toxic for r in got]) > 0.9
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.9


def plain_features(text, weights):
    """One text's features, a word at a time."""
    weigh = lambda w: max((weights[e] for e in toxicity.entries_of(w) if e in weights), default=0.0)
    word = re.compile(r"\w+")
    words = word.findall(text.lower())
    if not words:
        return [0.0] * len(toxicity.NAMES)
    n, raw, lines = len(words), text.split(), [x for x in text.split("\n") if x]
    hits = [i for i, w in enumerate(words) if weigh(w) > 0]
    you = [i for i, w in enumerate(words) if w in toxicity.YOU]
    total = sum(weigh(words[i]) for i in hits)
    odd = [c for c in (r.strip(toxicity.EDGES) for r in raw) if c and not c.isalpha() and re.search(r"[^\W\d_]", c)]
    return [
        math.log1p(n),
        min(len(hits), 50),
        len(hits) / n,
        min(total, 200),
        max((weigh(words[i]) for i in hits), default=0),
        total / n,
        len({words[i] for i in hits}),
        max((1 / (1 + abs(i - j)) for i in hits for j in you), default=0),
        len(you) / n,
        len(re.findall("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]", text)) / len(text),
        sum(r.isupper() for r in raw) / len(raw),
        len(re.findall(r"[^\w\s]", text)) / len(text),
        text.count("!") / len(text),
        len(odd) / n,
        min(20, sum(weigh(o.lower().translate(toxicity.UNDO)) > 0 for o in odd)),
        sum(bool(re.search(r"(\w)\1{3,}", w)) for w in set(words)) / len(set(words)),
        len(re.findall(r"\d", text)) / len(text),
        sum(any(weigh(w) > 0 for w in word.findall(x.lower())) for x in lines) / len(lines) if hits else 0,
    ]


def test_features_against_one_word_at_a_time(spark, sf):
    r = random.Random(6)
    bits = ["clod", "Clods", "CLODDY", "you", "Du", "c10d", "c-l-o-d", "!!", "...", "x", "soooo", "aaaa", "12", "a_b", "don't", "İstanbul", "Σας", "ǅ", "É", "\n", "\n\n", "\t", "\u3000", "\x1c", "²", "२", "😀", "----", "zz-", "\x00", "blockhead", "blo", "ß"]
    texts = ["", "...", " ", "\n", *("".join(r.choice(bits) + r.choice([" ", " ", "", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(600))]
    texts += [x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    weights = {"clod": 3.1234, "clod*": 2.5, "bloc*": 2.75, "ß": 4.0, "the": 2.6}
    got = toxicity.features(texts, toxicity.Lexicon(weights))
    assert np.allclose(got, [plain_features(t, weights) for t in texts], rtol=1e-12, atol=0)
    assert toxicity.features([], toxicity.Lexicon({})).shape == (0, len(toxicity.NAMES))


def test_entry_counts_against_sets():
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "alphabet", "alphab", "beta", "İx", "a"]) for _ in range(r.randint(0, 6))) for _ in range(300)]
    y, part = [r.randrange(2) for _ in texts], [r.randrange(3) for _ in texts]
    want = {}
    for t, v, k in zip(texts, y, part):
        for e in {e for w in re.findall(r"\w+", t.lower()) for e in toxicity.entries_of(w)}:
            want.setdefault((e, k), [0, 0])[v] += 1
    got = {(x["entry"], x["part"]): [x["neg"], x["pos"]] for x in toxicity.entry_counts(texts, y, part).to_pylist()}
    assert got == want


def test_trees_against_exhaustive_splits():
    """Each tree of the first rounds takes the splits that a search over all features and cuts finds, and their leaf values."""
    r = np.random.default_rng(2)
    x = r.integers(0, 6, (120, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] * r.random(120) > 4).astype(float)
    m = toxicity.Boosted().fit(x, y, rounds=3)
    z = np.full(len(y), math.log(y.mean() / (1 - y.mean())))

    def grow(rows, level):
        g, h = (y - 1 / (1 + np.exp(-z)))[rows], (1 / (1 + np.exp(-z)) * (1 - 1 / (1 + np.exp(-z))))[rows]
        gain = lambda k: g[k].sum() ** 2 / (h[k].sum() + 1) + g[~k].sum() ** 2 / (h[~k].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
        cuts = [(gain(x[rows, f] < c), f, c) for f in range(3) for c in m.edges[f]] if level < 3 and len(rows) > 1 else []
        top = max((c[0] for c in cuts), default=0)
        if top < 1e-6:
            out[rows] = 0.2 * g.sum() / (h.sum() + 1)
            return
        _, f, c = next(t for t in cuts if t[0] >= top - 1e-12)
        left = x[rows, f] < c
        grow(rows[left], level + 1)
        grow(rows[~left], level + 1)

    for _ in range(3):
        out = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        z = z + out
    assert np.allclose(m.decision(x), z)


def test_isotonic_is_the_best_monotone_fit():
    """Pooled means minimise squared error among all monotone step functions; the prior's half row moves them by as much as it weighs."""
    r = random.Random(5)
    for _ in range(30):
        n = r.randint(2, 7)
        z = np.array([float(r.randrange(5)) for _ in range(n)])
        y = np.array([float(r.randrange(2)) for _ in range(n)])
        xs, ys = toxicity.isotonic(z, y)
        values = sorted(set(z))
        best = None
        for cut in itertools.product([0, 1], repeat=len(values) - 1):
            group = np.concatenate([[0], np.cumsum(cut, dtype=np.int64)])
            mean = [y[np.isin(z, np.asarray(values)[group == k])].mean() for k in range(group[-1] + 1)]
            if all(p < q for p, q in zip(mean, mean[1:])):
                fit = np.array([mean[group[values.index(v)]] for v in z])
                err = ((fit - y) ** 2).sum()
                if best is None or err < best[0] - 1e-12:
                    size = [np.isin(z, np.asarray(values)[group == k]).sum() for k in range(group[-1] + 1)]
                    best = err, [(m * c + 0.5 * y.mean()) / (c + 0.5) for m, c in zip(mean, size)], group
        want = np.maximum.accumulate([best[1][best[2][k]] for k in range(len(values))])
        assert np.allclose(np.interp(values, xs, ys), want)


def test_isotonic_is_monotone_and_trees_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = toxicity.Boosted().fit(x[:1500], y[:1500])
    assert auc(m.decision(x[1500:]), y[1500:]) > 0.95
    xs, ys = toxicity.isotonic(m.decision(x), y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all() and 0 <= ys[0] <= ys[-1] <= 1


def test_isotonic_takes_ties_in_any_order():
    z, y = np.array([0.0, 1.0, 1.0, 1.0, 2.0]), np.array([0.0, 0.0, 1.0, 1.0, 1.0])
    xs, ys = toxicity.isotonic(z, y)
    assert len(set(xs.tolist())) == len(xs)
    for k in ([4, 3, 2, 1, 0], [0, 3, 1, 2, 4]):
        a, b = toxicity.isotonic(z[k], y[k])
        assert np.array_equal(a, xs) and np.array_equal(b, ys)


def test_model_does_not_depend_on_the_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    one = toxicity.train(docs.repartition(3), labels)
    two = toxicity.train(docs.repartition(7, "source"), labels.repartition(2))
    assert dict(one.lexicon) == dict(two.lexicon) and np.array_equal(one.xs, two.xs) and np.array_equal(one.ys, two.ys)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(i, "you awful clod " + str(i) if i % 3 == 0 else f"calm words {i}", "c") for i in range(60)] + [(None, "you clod", "c"), (70, None, "c"), (71, "", "c"), (72, "🙂 " * 20000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] * 2 + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    rows = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert len(rows) == 64 and rows[3] > rows[4] and all(0 <= v <= 1 for v in rows.values()) and rows[70] == rows[71]
    assert toxicity.train(docs, labels.limit(0)).prior == 0.0
    assert toxicity.keep_clean(docs, m).columns == docs.columns
    assert toxicity.score(docs.limit(0), m).count() == 0


def test_equal_ids_and_odd_labels_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"you clod {i}" if i % 2 else f"calm {i}") for i in range(40)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 7) for i in range(40)] + [(i, -1) for i in range(40)], "doc_id long, toxic int")
    once = toxicity.train(docs.distinct(), labels.filter("toxic IN (0, 1)"))
    m = toxicity.train(docs, labels)
    assert dict(m.lexicon) == dict(once.lexicon) and m.prior == once.prior and np.array_equal(m.ys, once.ys)


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_words_equal_the_pattern():
    import re

    from quarry.llm.words import Words, hash_words

    texts = ["Ab c_d, é1!", "", "...", "İx ٣ ², 汉字 a\u0301b", "tail"]
    w = Words(texts)
    want = [re.findall(r"\w+", t.lower()) for t in texts]
    assert np.diff(w.per_text).tolist() == [len(x) for x in want]
    assert w.hashes.tolist() == hash_words([x for ws in want for x in ws]).tolist() and len(set(w.hashes.tolist())) == len({x for ws in want for x in ws})


def test_alignment_against_brute_force():
    r = random.Random(2)
    pairs = [(np.array([r.randint(1, 4) for _ in range(r.randint(1, 12))], np.int32), np.array([r.randint(0, 4) for _ in range(r.randint(1, 30))], np.int32)) for _ in range(300)]
    best, _ = dc.align(pairs)
    assert best.tolist() == [smith_waterman(a.tolist(), [v or -9 for v in b.tolist()]) for a, b in pairs]


def test_matches_against_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): round(r.score, 6) for r in dc.matches(docs, items).collect()}
    index = dc.Index([(r.item_id, r.text) for r in items.collect()])
    want = {}
    for r in docs.collect():
        w, _ = index.numbers([r.text])
        if not len(w):
            continue
        best, _ = dc.align([(i, w) for i in index.items])
        for k, (s, i) in enumerate(zip(best, index.items)):
            if s / (2 * len(i)) >= 0.5:
                want[(r.doc_id, index.keys[k])] = round(s / (2 * len(i)), 6)
    assert want and got == want


def test_decontaminate_edited_copies_and_edge_cases(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    item = [r.choice(words) for _ in range(30)]
    edited = [w if k % 6 else "zzz" for k, w in enumerate(item)] + ["tail"] * 5
    noise = [" ".join(r.choice(words) for _ in range(60)) for _ in range(20)]
    docs = [(0, " ".join(item), "x"), (1, noise[0] + " " + " ".join(edited) + " " + noise[1], "x"), (2, None, "x"), (3, "", "x"), (None, " ".join(item), "x"), (5, "Hi there!", "x")] + [(10 + i, t, "x") for i, t in enumerate(noise)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "hi THERE"), (4, "...")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in dc.matches(df, items).collect()}
    assert got == {(0, 1), (1, 1), (None, 1), (5, 3)}
    assert {x.doc_id for x in dc.drop_contaminated(df, items).collect()} == {2, 3, None, *range(10, 30)}
    assert dc.matches(df, items.limit(0)).count() == 0 and dc.matches(df.limit(0), items).count() == 0
    assert {(x.doc_id, x.item_id) for x in dc.matches(df, items, block_grams=2).collect()} == got


def test_thousands_of_edited_copies_are_all_found(spark):
    r = random.Random(8)
    item = [f"q{k}" for k in range(40)]
    copies = [" ".join(f"e{r.randrange(10**6)}" if k % 5 == 2 else w for k, w in enumerate(item)) for _ in range(3000)]
    clean = [" ".join(f"n{r.randrange(10**4)}" for _ in range(50)) for _ in range(3000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(copies + clean)], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = dc.matches(df, items).collect()
    assert sorted(x.doc_id for x in got) == list(range(3000)) and all(x.score >= 0.5 for x in got)


def test_shared_words_are_counted_as_often_as_both_have_them():
    r = random.Random(9)
    index = dc.Index([(k, " ".join(r.choice("abcdef") for _ in range(r.randint(1, 12)))) for k in range(20)])
    w, off = index.numbers([" ".join(r.choice("abcdefxyz") for _ in range(r.randint(0, 15))) for _ in range(30)])
    t, i = (x.reshape(-1) for x in np.indices((30, 20)))
    want = [sum(min((w[off[a] : off[a + 1]] == v).sum(), (index.items[b] == v).sum()) for v in set(index.items[b].tolist())) for a, b in zip(t, i)]
    assert index.shared(w, off, t, i).tolist() == want


def found_in(index, texts, threshold):
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    return {(x["doc_id"], x["item_id"]): x["score"] for x in dc._matches_in(b, index, threshold).to_pylist()}


def test_copies_without_three_words_in_a_row_are_found():
    for n, changed in ((8, 2), (14, 4), (38, 12)):
        item = [f"q{k}" for k in range(n)]
        doc = ["x"] * 100 + [f"e{k}" if k % 3 == 2 else w for k, w in enumerate(item)] + ["y"] * 100
        assert sum(a != b for a, b in zip(item, doc[100:])) == changed
        got = found_in(dc.Index([(1, " ".join(item))]), [" ".join(doc)], 0.5)
        assert got.keys() == {(0, 1)} and got[0, 1] == smith_waterman(item, doc) / (2 * n) >= 0.5
    item = [f"q{k}" for k in range(20)]
    spread = " ".join(f"{w} e{k}" for k, w in enumerate(item))
    assert found_in(dc.Index([(1, " ".join(item))]), [spread], 0.5) == {(0, 1): 21 / 40}


def test_all_alignments_of_the_threshold_are_found():
    r = random.Random(11)
    reached = 0
    for threshold in (0.3, 0.5, 0.6, 0.8):
        words = [f"w{k}" for k in range(30)]
        items = [[r.choice(words) for _ in range(r.randint(3, 25))] for _ in range(25)]
        docs = []
        for v in items * 4:
            edited = []
            for w in v:
                edited += r.choice([[w], [w], [w], [w], ["e"], [], [w, "e"], ["e", w]])
            docs.append([r.choice([*words, "e"]) for _ in range(r.randint(0, 40))] + edited + [r.choice(words) for _ in range(r.randint(0, 40))])
        want = {(a, b): s / (2 * len(v)) for a, d in enumerate(docs) for b, v in enumerate(items) if (s := smith_waterman(v, d)) >= 2 * len(v) * threshold}
        assert found_in(dc.Index([(k, " ".join(v)) for k, v in enumerate(items)], threshold=threshold), [" ".join(d) for d in docs], threshold) == want
        reached += len(want)
    assert reached > 300
