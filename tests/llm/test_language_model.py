import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_model as lm
from millrace.llm.common import fold
from millrace.llm.queries import op2_language_model


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def check_counts(rows, docs, in_training):
    c = collections.Counter()
    for i, t in docs:
        if in_training(i):
            c.update(tokens(t))
    n, unit = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    want = sorted(
        (str(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10(c[x] + 0.5) - unit for x in tokens(t)))
        for i, t in docs
    )
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = op2_language_model(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_counts(rows, docs, lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 1}
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.97
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def small_model():
    rng = np.random.default_rng(1)
    words = [b"\n", b"the", b"of", b"der", b"die", b"a", b"x,"]
    code = np.array([k if k < 5 else lm.rare_code(t) for k, t in enumerate(words)] + [0], np.uint16)
    mass = rng.random((lm.RARE, lm.INNER)) + 1
    v = lm.Vocabulary({w: k for k, w in enumerate(words)}, np.arange(70.0, 0, -10), 5, 400, 9, mass, code)
    w = lm.initial_weights(v, rng.integers(0, 5, (lm.SYMBOLS, 2 * (lm.OWN + lm.KINDS))).astype(float))
    return v, w, rng


def plain_log10(text, v, w):
    """The model's definition, a token and a branch at a time."""
    mask = (1 << 64) - 1

    def code_of(t):
        k = v.head.get(t, -1)
        return k if 0 <= k < v.explicit else lm.rare_code(t)

    words = tokens(text)
    places = [lm.SYMBOLS] * lm.PAD + [int(w.place[code_of(t) & 4095]) for t in words]
    total = 0.0
    for i, t in enumerate(words):
        code, at = code_of(t), i + lm.PAD
        hashes = []
        for f, mix in zip(lm.FEATURES, lm.MIX, strict=True):
            back = [places[at - k] + 1 for k in f]
            x = back[0] if len(f) == 1 else back[0] << 13 | back[1]
            x = x * int(mix) & mask
            hashes.append(x ^ x >> 31)
        place = places[at]
        path = [(0, place >> 8), (place >> 8, place >> 4 & 15), (place >> 4, place & 15)]
        if (code & 4095) >= lm.EXPLICIT:
            path.append((place, code >> 12))
        for level, (node, branch) in enumerate(path):
            logits = [float(x) for x in w.bias[level][node]]
            for h in hashes[: lm.USED[level]]:
                if level:
                    h = (h ^ node + (level << 20)) * int(lm.MIX[0]) & mask
                row = w.rows[level][h >> 64 - lm.ROWS_BITS]
                logits = [a + float(b) for a, b in zip(logits, row, strict=True)]
            top = max(logits)
            total += (logits[branch] - top - math.log(sum(math.exp(x - top) for x in logits))) / math.log(10)
        if len(path) == 4:
            k = v.head.get(t, -1)
            count = v.counts[k] if k >= 0 else 0
            total += math.log10((count + 0.5) / v.rare_mass[(code & 4095) - lm.EXPLICIT, code >> 12])
    return total


def test_scores_match_the_plain_model():
    v, w, rng = small_model()
    w.rows = [rng.normal(size=x.shape).astype(np.float32) for x in w.rows]
    texts = ["", "the", "The of  der\n die zebra x, été the", " ".join(["the", "qq", "of", "a"] * 30)]
    coder = lm.Coder(v)
    rows = [coder.one(t) for t in texts]
    got = lm.path_scores(v, w)([r[4] for r in rows])
    unseen = [sum(math.log10(0.5) for _ in r[5]) for r in rows]
    got = [g + r[3] + u for g, r, u in zip(got, rows, unseen, strict=True)]
    assert np.allclose(got, [plain_log10(t, v, w) for t in texts], rtol=1e-4)


def test_probabilities_sum_to_one():
    v, w, rng = small_model()
    w.rows = [rng.normal(size=x.shape).astype(np.float32) for x in w.rows]
    symbols = np.array([lm.SYMBOLS] * lm.PAD + [1, 3, 0], np.uint16)
    total = 0.0
    for place in range(lm.SYMBOLS):
        places = w.place[symbols].copy()
        places[-1] = place
        total += math.exp(lm.log_probabilities(places, np.full(len(places), -1, np.int8), np.array([len(places) - 1]), w)[0])
    assert abs(total - 1) < 1e-4


def test_row_sums():
    rng = np.random.default_rng(2)
    for rows in (np.array([3], np.uint16), rng.integers(0, 9, 50).astype(np.uint16), rng.integers(0, 9000, 300).astype(np.uint16)):
        p = rng.normal(size=(len(rows), lm.BRANCH)).astype(np.float32)
        index, sums = lm._row_sums(p.view(np.complex64), rows)
        assert sorted(index.tolist()) == sorted(set(rows.tolist()))
        for i, s in zip(index, sums, strict=True):
            assert np.allclose(s, p[rows == i].sum(axis=0), atol=1e-4)


def test_training_lowers_the_loss():
    v, w, rng = small_model()
    symbols = np.array([lm.SYMBOLS] * lm.PAD + [1, 2, lm.EXPLICIT + 6, 0] * 300, np.uint16)
    parts = np.where((symbols >= lm.EXPLICIT) & (symbols < lm.SYMBOLS), 3, -1).astype(np.int8)
    places, at = w.place[symbols], np.arange(lm.PAD, len(symbols))
    state = [np.ones(len(x), np.float32) for x in w.rows]
    before = lm.log_probabilities(places, parts, at, w).mean()
    for _ in range(30):
        lm.train_batch(places, parts, at, w, state, 0.25)
    assert lm.log_probabilities(places, parts, at, w).mean() > before / 4


@pytest.mark.parametrize("head", [3, 1000])
def test_odd_rows(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "READ", 1000)
    rows = [(i, f"the word{i % 7} and été {i}", i) for i in range(60)]
    rows += [(100, None, 1), (101, "", 1), (None, "the rare zebra", 1), (5, rows[5][1], 1), (102, "long word " * 3000, 1), (103, "q" * 200_000, 1), (2**53 + 1, "the", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long")
    got = lm.score_texts(df, learn=fold("doc_id") != 1, head=head, explicit=4).collect()
    check_counts(got, [r[:2] for r in rows], lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score_texts(df.limit(0), learn=F.lit(True)).collect() == []
    none = lm.score_texts(df.limit(3), learn=F.lit(False)).collect()
    assert [r.n_known for r in none] == [0, 0, 0] and all(abs(r.score - r.base_score) < 1e-9 for r in none)


def test_every_learning_text_reaches_the_weights(spark):
    """One pass in four rounds takes every row once, and copies of one text are spread over the rounds."""
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("alpha beta alpha gamma alpha beta").alias("text"))
    v = lm.vocabulary(lm.count_tokens(df), 100, 4)
    coded = lm.code_texts(df, v)
    assert coded.select(F.pmod(F.xxhash64("row"), F.lit(4))).distinct().count() == 4
    w = lm.fit(coded, v)
    assert np.abs(w.rows[0]).max() > 0


def test_a_step_of_equal_counts_larger_than_the_head(spark):
    df = spark.range(500).select(F.concat(F.lit("w"), "id").alias("text"))
    v = lm.vocabulary(lm.count_tokens(df), 100)
    assert 20 < len(v.head) <= 110 and v.distinct == 501


def test_words_of_a_huge_text_are_cut_nowhere(monkeypatch):
    text = " ".join(f"wörd{i}" for i in range(500)) + " " * 70 + "x" * 100
    want = tokens(text)
    for read in (7, 64, 65, 100):
        monkeypatch.setattr(lm, "READ", read)
        assert lm.tokens_of(text) == want
        assert lm.tokens_of(text + "\n ") == want
