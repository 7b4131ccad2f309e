import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.packing import END, cuts, pack, padding
from quarry.llm.rollups import Ledger, count_tokens, revised, signed
from quarry.llm.tokens import Encoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = ["'s", "'ll", "'", "re", "ve", " ", "  ", "\n", "\t", "a", "B", "é", "1", "२", "!", "''", "don't", "　", "汉", "😀", "ʼ", "'S", "\r\n", "'d", "", "\x00"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def random_texts(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_ids_equal_the_tokenizers(plain):
    texts = [*random_texts(4000), "x<|endoftext|>y", ""]
    e = Encoder(PATH, {"<|endoftext|>": 50256})
    ids, off = e.ids(texts)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    assert e.counts(texts).tolist() == np.diff(off).tolist()
    assert e.ids([])[1].tolist() == [0] and e.counts([]).tolist() == []


def thue_morse(n, a="a", b="b"):
    """Two texts of n letters, n a power of two, that polynomials modulo 2**64 cannot tell apart beyond 2,000 letters."""
    s = "".join(b if i.bit_count() % 2 else a for i in range(n))
    return s, s.translate(str.maketrans(a + b, b + a))


def test_pieces_that_polynomial_hashes_confuse(plain):
    for n in (2048, 8192):
        texts = [*thue_morse(n), *thue_morse(n, "1", "2"), *thue_morse(n, "!", "?")]
        for e in (Encoder(PATH), Encoder(PATH, {"<|endoftext|>": 50256})):
            ids, off = e.ids(texts)
            want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
            assert [ids[a:z].tolist() for a, z in zip(off, off[1:])] == want
            assert e.counts(texts).tolist() == list(map(len, want))


def test_long_runs_and_long_texts(plain):
    """Runs of a million equal characters of each class, and texts beyond a chunk with special strings inside."""
    r = random.Random(2)
    runs = [c * 1_000_000 for c in (" ", "\n", "a", "7", "!", "\u3000")]
    runs += [" " * 300_000 + "x" + "\t" * 300_000, "a" * 600_000 + "<|endoftext|>" + " " * 1_200_000 + "<|endoftext|>b", " ".join(r.choice(["alpha", "don't", "  ", "1234", "\n\n", "...", "<|endoftext|>"]) for _ in range(400_000))]
    e = Encoder(PATH, {"<|endoftext|>": 50256})
    for t in runs:
        ids, off = e.ids(["ab", t, "", "c"])
        want = plain.encode(t, add_special_tokens=False).ids
        assert ids[off[1] : off[2]].tolist() == want and len(off) == 5 and e.counts([t]).tolist() == [len(want)]


def test_a_shared_first_hash_draws_a_new_key(plain, monkeypatch):
    from quarry.llm import tokens

    real, calls = tokens.place_hashes, []

    def weak(cps, starts, ends, key):
        calls.append(key)
        return real(cps, starts, ends, key) if len(set(calls)) > 1 else cps.astype(np.uint64)

    monkeypatch.setattr(tokens, "place_hashes", weak)
    e = Encoder(PATH)
    for texts in (["ad", "xx"], ["bc", "ad"], ["bd", "ac"]):
        ids, off = e.ids(texts)
        assert [ids[a:z].tolist() for a, z in zip(off, off[1:])] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def cost_of(at, doc_ends, sentence_ends, window, sc, ic):
    total, last = 0, at[-1]
    for a, b in zip(at, at[1:]):
        n = b - a
        assert 0 < n <= window
        total += 0 if n & (n - 1) == 0 and n >= window // 8 else window - n
        total += 0 if b in doc_ends or b == last else sc if b in sentence_ends else ic
    return total


def test_cuts_are_optimal_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        n, window = r.randint(1, 60), 16
        ends = sorted({n, *(r.randint(1, n) for _ in range(r.randint(0, 4)))})
        sents = sorted({r.randint(1, n) for _ in range(r.randint(0, 25))} - set(ends))
        allowed = {0, n, *ends, *sents}
        got = cuts(n, np.array(ends), np.array(sents, dtype=np.int64), window, 2.0, 48.0).tolist()
        allowed |= set(got)
        pos = sorted(allowed)
        best = {0: 0.0}
        for j in pos[1:]:
            step = [best[i] + cost_of([i, j, n] if j < n else [i, j], ends, sents, window, 2.0, 48.0) - (cost_of([j, n], ends, sents, 10**9, 2.0, 48.0) if j < n else 0) for i in pos if i < j and j - i <= window] if False else [best[i] + (0 if (j - i) & (j - i - 1) == 0 and j - i >= window // 8 else window - (j - i)) for i in pos if i < j and j - i <= window]
            best[j] = min(step, default=float("inf")) + (0 if j in ends or j == n else 2.0 if j in sents else 48.0)
        assert cost_of(got, ends, sents, window, 2.0, 48.0) == pytest.approx(best[n])


def test_pack_places_every_id_once(spark, plain):
    texts = [*random_texts(200, 3), None, "", "One. " * 3000, "nobreak" * 2000]
    df = spark.createDataFrame([(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length string").coalesce(2)
    rows = pack(df).collect()
    assert sum(r.length for r in rows) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
        assert sum(r.length for r in rs) == rs[0].sequence_tokens <= 1024
    for i, t in enumerate(texts):
        rs = sorted(by_doc[i if i != 7 else None], key=lambda r: r.start)
        ids = [x for r in rs for x in r.ids]
        assert ids == [*plain.encode(t or "", add_special_tokens=False).ids, END] and rs[0].doc_tokens == len(ids)
    assert sum(padding(rs[0].sequence_tokens) for rs in by_seq.values()) < 1024 * 3 + 0.05 * sum(r.length for r in rows)
    assert pack(df.limit(0)).count() == 0


def test_ledger_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two", "a", "en"), (2, None, "a", None), (3, "three", None, "en"), (3, "three", None, "en")], "doc_id long, text string, source string, lang string")
    paths = {"v1": PATH, "v2": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    counts = count_tokens(docs, paths).cache()
    e = {k: encoder(p, False) for k, p in paths.items()}
    v1, v2 = counts.filter("tokenizer = 'v1'"), counts.filter("tokenizer = 'v2'")
    led = Ledger(spark, str(tmp_path / "ledger"))
    assert led.totals().count() == 0
    assert led.commit("a", signed(v1, 1))
    assert not led.commit("a", signed(v1, 1))
    led.commit("b", revised(signed(v1, 1), signed(v2, 1)))
    led.fold()
    assert not led.commit("b", signed(v1, 5))
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in led.totals().collect()}
    three = len(e["v2"].core.encode_ordinary("three"))
    assert got == {("a", "en", "v2"): (1, len(e["v2"].core.encode_ordinary("one two"))), ("a", None, "v2"): (1, 0), (None, "en", "v2"): (2, 2 * three)}
    led.commit("c", signed(v2, -1))
    led.commit("d", signed(v2.limit(0), 1))
    led.fold()
    assert led.totals().count() == 0


def _delta(spark, n):
    return spark.createDataFrame([("a", "en", "t", 1, n)], "source string, lang string, tokenizer string, docs long, tokens long")


def test_a_batch_that_comes_in_during_a_fold_counts_once(spark, tmp_path, monkeypatch):
    led = Ledger(spark, str(tmp_path / "ledger"))
    led.commit("a", _delta(spark, 5))
    sums = Ledger._sums

    def late(self, snap, rest):
        monkeypatch.setattr(Ledger, "_sums", sums)
        assert Ledger(spark, self.path).commit("b", _delta(spark, 7))
        return sums(self, snap, rest)

    monkeypatch.setattr(Ledger, "_sums", late)
    assert led.fold()
    assert [r.tokens for r in led.totals().collect()] == [12]
    assert led.fold() and [r.tokens for r in led.totals().collect()] == [12]
    assert not led.commit("a", _delta(spark, 1)) and not led.commit("b", _delta(spark, 1))


def test_two_writers_of_one_batch_and_two_folds(spark, tmp_path, monkeypatch):
    one, two = (Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    monkeypatch.setattr(Ledger, "_names", lambda self: [])  # neither sees the other
    assert one.commit("x", _delta(spark, 5)) and not two.commit("x", _delta(spark, 9))
    monkeypatch.undo()
    assert [r.tokens for r in one.totals().collect()] == [5]
    monkeypatch.setattr(Ledger, "_visible", lambda self: (None, [], ["batch=x"]))
    assert one.fold() and not two.fold()
    monkeypatch.undo()
    assert [r.tokens for r in two.totals().collect()] == [5]
    assert not [p for p in (tmp_path / "ledger").iterdir() if p.name.startswith("_new")]


def test_query_totals_are_plain_counts(spark, sf):
    """op10 over its whole table against a tokenizer that encodes one text after the other."""
    import base64
    from collections import Counter

    import tiktoken

    from quarry.llm.entry_points import op10_token_rollup

    want = Counter()
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for r in rows:
            want[r.source, r.lang, name] += 1 + (len(e.encode_ordinary(r.text or "")) << 32)
    got = {(r.source, r.lang, r.tokenizer): r.docs + (r.tokens << 32) for r in op10_token_rollup(spark, sf).collect()}
    assert got == want


def test_counting_edge_cases(spark):
    empty = count_tokens(spark.createDataFrame([], "doc_id long, text string, source string, lang string"), {"v": PATH})
    assert empty.count() == 0 and empty.columns == ["doc_id", "source", "lang", "tokenizer", "tokens"]
    df = spark.createDataFrame([(1, "a b", "s", "l", "x", 5), (None, None, None, None, None, None)], "doc_id long, text string, source string, lang string, tokenizer string, tokens int")
    assert {tuple(r) for r in count_tokens(df, {"v": PATH}).collect()} == {(1, "s", "l", "v", 2), (None, None, None, "v", 0)}
