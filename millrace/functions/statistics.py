"""Grouped statistics with fixed meanings for small groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import clamp, histogram_bin, sample_sd


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., n, total, mean, sd, q05, median, q95): sd is 0 for one value; quantiles interpolate linearly."""
    v = F.col(value).cast("double")
    q = lambda x: F.percentile(v, F.lit(x))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), sample_sd(v).alias("sd"), q(0.05).alias("q05"), q(0.5).alias("median"), q(0.95).alias("q95"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n); values outside count in the outer bins."""
    return df.filter(F.col(value).isNotNull()).groupBy(histogram_bin(clamp(F.col(value).cast("double"), low, high), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))


def normal_equations(df: DataFrame, target: str, regressors: list[str], *by: str) -> DataFrame:
    """(by..., i, j, xx, xy): sums of products of the regressors, i <= j; xy on the diagonal."""
    cells = [
        F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), (F.col(a) * F.col(b)).cast("double").alias("xx"), (F.col(a) * F.col(target)).cast("double").alias("xy"))
        for k, a in enumerate(regressors)
        for b in regressors[k:]
    ]
    rows = df.select(*by, F.inline(F.array(*cells)))
    return rows.groupBy(*by, "i", "j").agg(F.sum("xx").alias("xx"), F.sum(F.when(F.col("i") == F.col("j"), F.col("xy"))).alias("xy"))


def quantile_sketches(df: DataFrame, value: str, *by: str, k: int = 800) -> DataFrame:
    """(by..., sketch, n): a mergeable sketch of each group's values, of bounded size: its ranks are off by about 2.3 / k at
    most (k 800: 0.3 %), with 99 % confidence. Nulls and NaN do not count."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"), F.count("*").alias("n"))


def merged_quantiles(sketches: DataFrame, ranks: list[float], *by: str) -> DataFrame:
    """(by..., rank, quantile, n) of merged sketches: by coarser keys, the values themselves are not read again."""
    whole = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("s"), F.sum("n").alias("n"))
    at = F.array(*[F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_double("s", F.lit(float(r))).alias("quantile")) for r in ranks])
    return whole.select(*by, F.inline(at), "n")
