import random
import re

import corpus_pipeline as cp
import public_tokenizers
from test_neardup import brute as near_classes
from test_toxicity_decontaminate import plain_features
from tokenizers import Tokenizer

from quarry.llm import decontaminate, toxicity

LABELS = "doc_id long, toxic int"


def test_stages_keep_clean_rows_and_take_edge_cases(spark, tmp_path):
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    same, item = text(80), text(30)
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (None, text(20), "en", "a", 1), (2, same, "en", "a", 1), (3, same, "en", "b", 1), (4, text(20) + " " + item, "en", "a", 1)] + [(10 + i, text(60), "en", "a", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    spark.createDataFrame([(10, 0), (None, 1)], LABELS).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    gone = [set(), set(), {1, 3}, {4}]  # a null text is an empty one, so 1 is a copy of 0
    left = {x[0] for x in rows}
    for (name, stage), out in zip(cp.STAGES[:-1], gone):
        docs = cp.materialise(stage(spark, docs, sf), f"test-{name}")
        left -= out
        assert {x.doc_id for x in docs.collect()} == left, name
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {x.doc_id for x in cp.STAGES[-1][1](spark, docs, sf).collect()} == left


def test_whole_table_against_brute_force(spark, sf):
    """run() on all documents: what each stage keeps by plain Python, and the kept texts' ids in the pieces."""
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    x = np.array([plain_features(r.text, model.lexicon) for r in rows.values()])
    score = np.clip(np.interp(model.trees.decision(x), model.xs, model.ys), 0, 1)
    texts = {i: r.text for (i, r), s in zip(rows.items(), score) if s < cp.TOXIC_FROM}
    assert len(texts) < len(rows)
    sites = {}
    for i, t in texts.items():
        for line in set(t.split("\n")):
            sites.setdefault(line, set()).add(rows[i].source)
    bad = {line for line, s in sites.items() if line.strip(" ") and len(s) >= cp.MIN_SITES}
    texts = {i: "\n".join(x for x in t.split("\n") if x not in bad) for i, t in texts.items()}
    classes = near_classes(list(texts.items()))
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    word = re.compile(r"\w+")
    index = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    held = set()
    for i, t in texts.items():
        w, _ = index.numbers([t])
        if len(word.findall(t)):
            best, _ = decontaminate.align([(v, w) for v in index.items])
            if any(s >= len(v) for s, v in zip(best, index.items)):
                held.add(i)
    texts = {i: t for i, t in texts.items() if i not in held}
    pieces = {}
    for r in cp.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert pieces.keys() == texts.keys() and held
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in texts.items():
        assert [x for _, ids in sorted(pieces[i]) for x in ids] == [*plain.encode(t, add_special_tokens=False).ids, 0]


def test_stages_pass_columns_of_any_name(spark, sf, tmp_path):
    names = ["lines_total", "lines_removed", "__r1", "__drop", "__gone", "__bad", "row_1", "gone_id", "found_id", "score", "class_id"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    docs = cp.materialise(docs.select("*", *[cp.F.lit(k).alias(n) for k, n in enumerate(names)]), "test-names")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() and {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0
