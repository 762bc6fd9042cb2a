import hashlib
import math

import pytest

from millrace.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, cluster string, part int"


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * int(c) if abs(c) >= 2**53 else 256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda p: (p[0] is None, hashlib.sha256(f"2:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        at = [j for _, j in assign()]
        for j in set(at):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    done = assign()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    inertia = {j: sum(d for d, a in done if a == j) for _, j in done}
    long = lambda x: x if x < 2**63 else None
    total = sum(inertia.values())
    return sorted(((i, j, long(d), long(inertia[j]), long(total), sha[j]) for (i, _), (d, j) in zip(kept, done, strict=True)), key=str)


def found(df, **given):
    return sorted((tuple(r) for r in clustering.lloyd(df, **given).collect()), key=str)


def test_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 40, 2, 64)
    assert found(df, rounds=2) == want
    # The cut into shards and blocks changes nothing.
    assert found(df.repartition(5), rounds=2, width=7, rows=33) == want


def test_odd_rows(spark):
    rows = [
        (1, [0.1, 0.2, -0.3], "x", 1),
        (1, [0.1, 0.2, -0.3], "x", 1),
        (1, [0.5, 0.2, 0.3], "x", 1),
        (2, [0.1, 0.2], "x", 1),
        (3, None, "x", 1),
        (4, [None, 0.1, 0.2], "x", 1),
        (5, [float("nan"), 0.1, 0.2], "x", 1),
        (6, [float("inf"), 0.1, 0.2], "x", 1),
        (7, [-0.001, -0.002, 0.0], "x", 1),
        (None, [9.0, 9.0, 9.5], "x", 1),
        (2**53 + 1, [9.0, 9.0, 9.0], "x", 1),
        (8, [], "x", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 3, 40):
        result = clustering.lloyd(df, k=k, dim=3, width=2)
        assert result.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in result.collect()), key=str) == brute([r[:2] for r in rows], k, 5, 3)
    assert found(df.limit(0)) == [] and found(df, dim=9) == []


@pytest.mark.parametrize("size", [2.0**18, 2.0**20, 2.0**40, 1e300])
def test_large_components(spark, size):
    rows = [(i, [size * (1 + i / 8), -size / (1 + i), 0.25 * i]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, k=3, dim=3, width=2, rows=4) == brute(rows, 3, 5, 3)
