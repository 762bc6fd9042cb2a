import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.common import fold
from millrace.llm.queries import op1_quality_classifier


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op1_quality_classifier(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert auc([rows[r.doc_id].score for r in held], [r.quality for r in held]) > 0.97


def test_dual_coordinate_descent_reaches_the_hinge_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(60)]
    labels = np.array([int(3 in r) ^ int(rng.random() < 0.1) for r in rows])
    ratios = rng.normal(size=12)
    w, bias = quality.hinge_weights(rows, labels, ratios, epochs=3000, tolerance=1e-12)
    x = np.zeros((60, 13))
    for k, r in enumerate(rows):
        x[k, r] = ratios[r] / max(1, len(r)) ** 0.5
        x[k, 12] = 1
    y = np.where(labels > 0, 1, -1)
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    cost = 1 / (2 * share[labels])

    def loss(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()

    best = np.r_[w, bias]
    assert all(loss(best) <= loss(best + rng.normal(size=13) * s) + 1e-6 for s in (1, 0.1, 0.01, 0.001) for _ in range(200))


def test_features_are_independent_of_slices(monkeypatch):
    text = "Some WORDS, words words and 12 marks !!! é日本 " * 40
    whole = quality.features(text)
    monkeypatch.setattr(quality, "SLICE", 64)
    assert sorted(whole) == sorted(quality.features(text))
    assert len(whole) == len(set(whole.tolist()))


@pytest.mark.parametrize("labels,expected", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (None, 1), (2, None)], 0.0)])
def test_missing_classes(spark, labels, expected):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, marks, learn=F.lit(True))
    got = quality.score_texts(docs, model).collect()
    assert len(got) == 3 and all(abs(r.score - expected) < 0.01 for r in got)


def test_odd_rows(spark):
    rows = [(i, "good text of words" if i % 2 else "BAD!! TEXT!!", "x") for i in range(40)]
    rows += [(100, None, "x"), (None, "good", "x"), (101, "good " * 300_000, "x"), (102, "", "x"), (1, "good text of words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (100, 1)], "doc_id long, quality int")
    model = quality.fit(docs, marks, learn=fold("doc_id") != 0)
    got = quality.score_texts(docs, model).collect()
    assert len(got) == len(rows)
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 40)
    assert quality.score_texts(docs.limit(0), model).collect() == []
