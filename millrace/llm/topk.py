"""Exact top-k inner products, pruned by the means and deviations of vector segments, coarse to fine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.storage import materialise

LEVELS = (1, 4, 16)  # segments of a vector at each resolution


def _segments(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, sqrt(length) times the mean and the deviation of its segments."""
    cuts = np.array_split(np.arange(x.shape[1]), parts)
    root = np.array([np.sqrt(len(c)) for c in cuts])
    mean = np.stack([x[:, c].mean(axis=1) for c in cuts], axis=1)
    dev = np.stack([x[:, c].std(axis=1) for c in cuts], axis=1)
    return mean * root, dev * root


def block_top(
    queries: np.ndarray, qids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray] | None = None
) -> list[tuple]:
    """(query id, vector id, score): the k best rows of each query within these arrays, exactly. own: numbers of the
    queries' and the candidates' rows, where ids alone do not tell a query's own row.

    Segment means m and deviations s bound a distance from below: |q-x|^2 >= sum L((mq-mx)^2 + (sq-sx)^2), which
    bounds the inner product (|q|^2+|x|^2-|q-x|^2)/2 from above by sum L(mq*mx + sq*sx). Each resolution drops the
    rows whose bound is under the k-th best score known; survivors get exact integer scores.
    """
    out: list[tuple] = []
    n, dim = rows.shape
    if not n:
        return out
    floats = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0)) ** 2 * max(1, dim) < 2**52
    exact_rows = rows.astype(np.float64) if floats else rows
    xf, qf = rows.astype(np.float64), queries.astype(np.float64)
    levels = [p for p in LEVELS if p <= dim]
    xs, qs = [_segments(xf, p) for p in levels], [_segments(qf, p) for p in levels]
    # Rounding of the bounds is far below this share of |q||x|.
    slack = 1e-9 * (np.sqrt((xf**2).sum(axis=1)).max(initial=0) * np.sqrt((qf**2).sum(axis=1)) + 1)

    def score(i: int, at: np.ndarray) -> np.ndarray:
        if floats:
            return (exact_rows[at] @ qf[i]).astype(np.int64)
        return (rows[at] * queries[i]).sum(axis=1)

    for start in range(0, len(queries), 64):
        part = slice(start, min(len(queries), start + 64))
        coarse = None
        if levels:
            (xm, xd), (qm, qd) = xs[0], qs[0]
            coarse = qm[part] @ xm.T + qd[part] @ xd.T
        for i in range(part.start, part.stop):
            other = ids != qids[i] if own is None else own[1] != own[0][i]
            bound = coarse[i - start] if coarse is not None else np.zeros(n)
            alive = np.flatnonzero(other)
            if len(alive) > k and levels:
                # A first threshold: exact scores of the rows that look best at the finest resolution.
                (xm, xd), (qm, qd) = xs[-1], qs[-1]
                look = np.argpartition(-bound[alive], min(len(alive) - 1, 32 * k))[: 32 * k]
                look = alive[look]
                fine = xm[look] @ qm[i] + xd[look] @ qd[i]
                look = look[np.argsort(-fine)[: 2 * k]]
                least = np.sort(score(i, look))[-k] - slack[i]
                alive = alive[bound[alive] >= least]
                for (xm, xd), (qm, qd) in zip(xs[1:], qs[1:], strict=True):
                    alive = alive[xm[alive] @ qm[i] + xd[alive] @ qd[i] >= least]
            s = score(i, alive)
            if len(s) > k:
                worst = np.partition(s, len(s) - k)[len(s) - k]
                keep = s >= worst
                alive, s = alive[keep], s[keep]
            best = np.lexsort((ids[alive], -s))[:k]
            name = qids[i] if own is None else own[0][i]
            out += [(int(name), int(ids[alive[b]]), int(s[b])) for b in best]
    return out


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(rid, vec_id, v, dim): floor(scale * x) of every component x, as long, and a number of the row, given before the
    table is written. Rows with a null id or vector, or with a null or non-finite component, take no part."""
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = (
        df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("x"))
        .filter(finite)
        .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
        .withColumn("dim", F.size("v"))
        .withColumn("rid", F.monotonically_increasing_id())
    )
    return materialise(rows, "vectors")


def exact_top_k(
    df: DataFrame,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    rows_per_block: int = 8192,
    queries_per_block: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product for each query, ties to the
    smaller vec_id; all rows, if fewer than k.

    Queries are the rows whose id is divisible by `every`, candidates all rows but the query's own. Queries and
    candidates are hashed into blocks; each pair of blocks is one bounded task that returns k rows a query, and the
    merge keeps the k best, so no task holds more than one block of each. Vectors are compared with those of the same
    length only. Rows that repeat an id are rows of their own: each is a candidate for all others, and where its id is a
    query's, a query. An empty table gives an empty table.
    """
    v = quantised(df, id_col, vector_col, scale)
    n = v.count()  # of the written table: its files tell
    row_blocks = max(1, -(-n // rows_per_block))
    query_blocks = max(1, -(-n // (every * queries_per_block)))
    candidates = v.select(
        "dim",
        F.pmod(F.xxhash64("rid"), F.lit(row_blocks)).cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"),
        "rid",
        "vec_id",
        "v",
    )
    queries = v.filter(F.pmod("vec_id", F.lit(every)) == 0).select(
        "dim",
        F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"),
        F.pmod(F.xxhash64("rid"), F.lit(query_blocks)).cast("int").alias("qb"),
        "rid",
        "vec_id",
        "v",
    )

    def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = int(pdf["dim"].iloc[0])
        v = np.concatenate(pdf["v"].to_list() or [np.zeros(0)]).astype(np.int64).reshape(len(pdf), width)
        return v, pdf["vec_id"].to_numpy(np.int64), pdf["rid"].to_numpy(np.int64)

    def run(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(q) and len(x):
            (qv, qi, qr), (xv, xi, xr) = arrays(q), arrays(x)
            found = block_top(qv, qi, xv, xi, k, own=(qr, xr))
        return pd.DataFrame(found, columns=["rid", "vec_id", "score"]).astype("int64")

    tops = (
        queries.groupBy("dim", "rb", "qb")
        .cogroup(candidates.groupBy("dim", "rb", "qb"))
        .applyInPandas(run, "rid long, vec_id long, score long")
    )
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return (
        tops.groupBy("rid")
        .agg(best.alias("best"))
        .join(v.select("rid", F.col("vec_id").alias("query_id")), "rid")
        .select("query_id", F.posexplode("best").alias("at", "b"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("b.vec_id").alias("vec_id"),
            (-F.col("b.s")).alias("score"),
        )
    )
