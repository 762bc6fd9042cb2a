"""Conflicts by sweeps against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.sweep import first_by_another


def brute(rows, width):
    out = {}
    for n, k, o, t in rows:
        others = [m for m, k2, o2, t2 in rows if None not in (k, o, t, k2, o2, t2) and k2 == k and o2 != o and abs(t2 - t) <= width]
        if others:
            out[n] = min(others)
    return out


def swept(spark, rows, width, **given):
    df = spark.createDataFrame(rows, "n long, k string, o string, t long")
    return {r.number: r.other for r in first_by_another(df, "k", "o", "t", "n", width, **given).collect()}


@pytest.mark.parametrize("width,parts,owners", [(0, 48, 3), (1, 48, 2), (7, 48, 5), (96, 48, 9), (100, 4, 1), (100, 4, 17), (97, 48, 4)])
def test_against_all_pairs(spark, width, parts, owners):
    rng = random.Random(width + owners)
    rows = [(i, f"k{rng.randrange(3)}", f"o{rng.randrange(owners)}", rng.randrange(-400, 400)) for i in range(150)]
    rng.shuffle(rows)
    assert swept(spark, rows, width, most_parts=parts) == brute(rows, width)


def test_odd_rows(spark):
    rows = [(1, None, "a", 5), (2, "k", None, 5), (3, "k", "a", None), (4, "k", "a", 5), (5, "k", "b", 5), (6, "", "b", 5), (7, "", "c", 5)]
    assert swept(spark, rows, 10) == {4: 5, 5: 4, 6: 7, 7: 6} == brute(rows, 10)
    assert swept(spark, rows[:0], 10) == {}


def test_one_busy_key(spark):
    # Two owners in turn, all on one key: the pairs within the window would be some ten thousand million.
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("n"), F.lit("k").alias("k"), (F.col("id") % 2).alias("o"), (F.col("id") * 3).alias("t"))
    width = 96_000
    found = first_by_another(df, "k", "o", "t", "n", width)
    low = F.greatest(F.lit(0), F.col("number") - width // 3)
    want = F.when(low % 2 != F.col("number") % 2, low).otherwise(low + 1)
    assert found.count() == n and found.filter(F.col("other") != want).count() == 0
