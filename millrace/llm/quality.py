"""Quality classifier: Naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts, texts

BITS = 18  # of a feature's hash
TOKEN = re.compile(r"\w+|[^\w\s]+")
BREAK = re.compile(r"\s")
SLICE = 1 << 20  # characters tokenised at a time
MEMO = 200_000
_WORDS: dict[str, int] = {}


def _word(token: str) -> int:
    """Hash of the token in lower case, times 8, plus its shape: 1 capitals, 2 capitalised, 3 lower case, 4 digits,
    5 marks, 6 one capital, 7 other."""
    if token.isalpha():
        shape = 3 if token.islower() else (1 if len(token) > 1 else 6) if token.isupper() else 2 if token.istitle() else 7
    else:
        shape = 4 if token.isdigit() else 7 if token[0].isalnum() else 5
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) * 8 + shape


def _spread(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed indicators of a whole text, distinct: tokens, pairs of tokens, runs of one to three token shapes, and
    whether a token of each shape repeats the one before. A text without a token has none."""
    grams: list[np.ndarray] = []
    shapes = np.zeros(1024, bool)  # the lowest places, which grams leave free
    carry: list[str] = []
    if len(_WORDS) > MEMO:
        _WORDS.clear()
    at = 0
    while at < len(text):
        # A slice ends where a token does.
        end = min(len(text), at + SLICE)
        if end < len(text) and (cut := BREAK.search(text, end)):
            end = cut.start()
        elif end < len(text):
            end = len(text)
        tokens = carry + TOKEN.findall(text, at, end)
        at = end
        for t in set(tokens).difference(_WORDS):
            _WORDS[t] = _word(t)
        both = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
        h, s = both >> np.uint64(3), (both & np.uint64(7)).astype(np.int64)
        grams += [_spread(h, bits), _spread(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F), bits)]
        shapes[s + 8] = True
        shapes[s[:-1] * 8 + s[1:] + 64] = True
        shapes[s[:-2] * 64 + s[1:-1] * 8 + s[2:] + 512] = True
        shapes[s[1:][h[1:] == h[:-1]] + 16] = True
        carry = tokens[-2:]
    if not grams:
        return np.zeros(0, np.int32)
    found = np.unique(np.concatenate(grams))
    return np.concatenate([np.flatnonzero(shapes).astype(np.int32), found[found >= len(shapes)]])


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = bias + sum of weights / sqrt(indicators)."""

    weights: np.ndarray  # float32, by hash: hinge weight times log-count ratio
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return self.bias + float(self.weights[found].sum(dtype=np.float64)) / max(1.0, len(found)) ** 0.5

    def score(self, text: str) -> float:
        z = self.slope * self.margin(features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, bits: int = BITS) -> np.ndarray:
    """log of (smoothed share of an indicator in class 1) / (the same in class 0)."""
    counts = np.full((2, 1 << bits), alpha)
    for row, y in zip(rows, labels, strict=True):
        counts[int(y), row] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1]) - np.log(shares[0])


def hinge_weights(
    rows: list[np.ndarray],
    labels: np.ndarray,
    ratios: np.ndarray,
    cost: float = 1.0,
    epochs: int = 12,
    tolerance: float = 1e-3,
    seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss on ratio-scaled indicators, each row scaled by the
    root of its length; the classes' costs balance their counts. The bias is one more weight, on a constant 1."""
    w, bias = np.zeros(len(ratios)), 0.0
    values = [ratios[r] / max(1.0, len(r)) ** 0.5 for r in rows]
    norms = np.array([1.0 + float(v @ v) for v in values])
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    upper = cost / np.maximum(2 * share[(y > 0).astype(int)], 1e-9)
    a = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            slope = y[i] * (float(w[r] @ v) + bias) - 1.0
            new = min(max(a[i] - slope / norms[i], 0.0), upper[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[r] += step * v
                bias += step
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < tolerance:
            break
    return w, bias


def calibrated(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back margins: Newton steps on smoothed targets."""
    pos, neg = (weight * labels).sum(), (weight * (1 - labels)).sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit_rows(found: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, hold: np.ndarray) -> Model:
    """The model of feature rows; rows marked in `hold` calibrate it and teach nothing else."""
    train = np.flatnonzero(~hold)
    ratios = log_count_ratios([found[i] for i in train], labels[train])
    w, bias = hinge_weights([found[i] for i in train], labels[train], ratios)
    model = Model((w * ratios).astype(np.float32), bias, 1.0, 0.0)
    held = np.flatnonzero(hold)
    if len(set(labels[held].tolist())) == 2:
        margins = np.array([model.margin(found[i]) for i in held])
        model.slope, model.shift = calibrated(margins, labels[held].astype(float), weight[held])
    return model


def fit(documents: DataFrame, labels: DataFrame, learn: Column, rows_per_class: int = 4000) -> Model:
    """Fit on a bounded sample of the labelled rows for which `learn` (an expression over labels.doc_id) holds.

    rows_per_class bounds the sample: of each class the rows with the smallest hash of the id. It is broadcast to the
    documents (8,000 ids at most), features are extracted where the texts lie (2^18 distinct ones a row at most), and
    one task, bounded by the sample, runs the descent. Of rows that repeat a sampled id the first by the text's hash
    teaches. A fifth of the sample calibrates the score to the classes' shares in all labelled rows. With
    fewer than two classes the model scores the one there is as 1 or 0, and 0.5 where there is none.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learn)
        .select("doc_id", F.col("quality").cast("int").alias("y"))
        .distinct()
    )
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        sure = {0: -5.0, 1: 5.0}.get(next(iter(totals), None), 0.0)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, sure)
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        picked = part if picked is None else picked.union(part)

    def make() -> Callable[[list[str]], list[pa.Array]]:
        return lambda part: [pa.array([features(t).tobytes() for t in part], pa.binary())]

    def learned(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["doc_id", "y", "found"])
        found = [np.frombuffer(b, np.int32) for b in batch["found"]]
        y = batch["y"].to_numpy()
        share = np.array([totals[v] / (y == v).sum() for v in y], float)
        hold = np.array([zlib.crc32(b"held%d" % i) % 5 == 0 for i in batch["doc_id"]], bool)
        m = fit_rows(found, y, share, hold)
        return pd.DataFrame({"weights": [m.weights.tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    taught = texts(documents).join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64("text"))
    sample = (
        map_texts(taught, make, "found binary")
        .groupBy("doc_id", "y")
        .agg(F.min(F.struct("h", "found")).getField("found").alias("found"))
    )
    row = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learned, "weights binary, bias double, slope double, shift double").first()
    if row is None:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0)
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"], row["slope"], row["shift"])


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: 0 to 1, higher where label 1 is likelier. Null texts count as empty; a text
    without a token gets the score of the bias alone. Repeated rows and null ids stay; empty tables stay empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: 2^18 weights

    def make() -> Callable[[list[str]], list[pa.Array]]:
        return lambda part: [pa.array(list(map(shared.value.score, part)), pa.float64())]

    return map_texts(texts(df, id_col, text_col), make, "score double")


def keep(df: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose text scores the threshold or more. Each text is scored where it
    lies: nothing is joined or shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(part: pd.Series) -> pd.Series:
        return part.map(lambda t: shared.value.score(t or "")).astype("float64")

    return df.filter(scored(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
