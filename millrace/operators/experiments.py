"""Geo-lift experiments: synthetic controls, placebo inference and power, for many tests at once.

panel: test_id, geo, day, kpi (dense). tests: test_id, start. cells: test_id, cell, geo; cell 'test' is the real one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel, counters): duplicates summed, missing geo-days zero; counters: test_id, bad (no number), missing."""
    rows = panel.select("test_id", "geo", F.col("day").try_cast("date").alias("day"), F.col("kpi").try_cast("double").alias("kpi"))
    good = rows.filter("day is not null and kpi is not null and not isnan(kpi)")
    summed = good.groupBy("test_id", "geo", "day").agg(F.sum("kpi").alias("kpi"))
    grid = summed.select("test_id", "geo").distinct().join(summed.select("test_id", "day").distinct(), "test_id")
    full = grid.join(summed, ["test_id", "geo", "day"], "left")
    missing = full.groupBy("test_id").agg(F.count_if(F.col("kpi").isNull()).alias("missing"))
    bad = rows.groupBy("test_id").agg(F.count_if(F.col("day").isNull() | F.col("kpi").isNull() | F.isnan("kpi")).alias("bad"))
    return full.withColumn("kpi", F.coalesce("kpi", F.lit(0.0))), bad.join(missing, "test_id")


def with_pre(panel: DataFrame, tests: DataFrame) -> DataFrame:
    return panel.join(tests.select("test_id", "start"), "test_id").withColumn("pre", F.col("day") < F.col("start"))


def normalised(panel: DataFrame, tests: DataFrame) -> DataFrame:
    """(test_id, geo, day, kpi, pre, z): z is kpi over the geo's mean before the start; null if that is 0."""
    mean = F.avg(F.when(F.col("pre"), F.col("kpi"))).over(Window.partitionBy("test_id", "geo"))
    return with_pre(panel, tests).withColumn("m", mean).withColumn("z", F.when(F.col("m") != 0, F.col("kpi") / F.col("m"))).drop("m", "start")


def gram(norm: DataFrame) -> DataFrame:
    """(test_id, i, j, g): products of pre-period series, i <= j; one row a pair of geos, whatever the days."""
    pre = norm.filter("pre and z is not null")
    a = pre.select("test_id", "day", F.col("geo").alias("i"), F.col("z").alias("zi"))
    b = pre.select("test_id", "day", F.col("geo").alias("j"), F.col("z").alias("zj"))
    return a.join(b, ["test_id", "day"]).filter("i <= j").groupBy("test_id", "i", "j").agg(F.sum(F.col("zi") * F.col("zj")).alias("g"))


def cell_series(panel: DataFrame, tests: DataFrame, cells: DataFrame) -> DataFrame:
    """(test_id, cell, day, pre, kpi, cell_mean): the members' sum and its pre-period mean."""
    rows = with_pre(panel, tests).join(cells, ["test_id", "geo"]).groupBy("test_id", "cell", "day", "pre").agg(F.sum("kpi").alias("kpi"))
    return rows.withColumn("cell_mean", F.avg(F.when(F.col("pre"), F.col("kpi"))).over(Window.partitionBy("test_id", "cell")))


def donors(norm: DataFrame, cells: DataFrame) -> DataFrame:
    """(test_id, cell, geo): control pool: geos outside the test cell and outside the cell itself."""
    geos = norm.filter("z is not null").select("test_id", "geo").distinct()
    pool = cells.select("test_id", "cell").distinct().join(geos, "test_id")
    pool = pool.join(cells.filter("cell = 'test'").select("test_id", "geo"), ["test_id", "geo"], "left_anti")
    return pool.join(cells, ["test_id", "cell", "geo"], "left_anti").select("test_id", "cell", "geo")


def cross_products(norm: DataFrame, series: DataFrame, pool: DataFrame) -> DataFrame:
    """(test_id, cell, geo, b): pre-period products of the scaled cell and each of its donors."""
    y = series.filter("pre and cell_mean <> 0").select("test_id", "cell", "day", (F.col("kpi") / F.col("cell_mean")).alias("y"))
    z = norm.filter("pre").select("test_id", "geo", "day", "z")
    return pool.join(z, ["test_id", "geo"]).join(y, ["test_id", "cell", "day"]).groupBy("test_id", "cell", "geo").agg(F.sum(F.col("z") * F.col("y")).alias("b"))


def _simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    c = np.cumsum(u) - 1
    k = np.flatnonzero(u - c / np.arange(1, len(u) + 1) > 0)[-1]
    return np.maximum(v - c[k] / (k + 1), 0)


def _fit(g: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """min w'Gw/2 - b'w over w >= 0, sum w = 1: accelerated projected gradient."""
    n = len(b)
    w = x = np.full(n, 1 / n)
    size = max(float(np.linalg.norm(g, 2)), 1e-12)
    t = 1.0
    for _ in range(steps):
        new = _simplex(x - (g @ x - b) / size)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-9:
            return new
        w, t = new, t2
    return w


def donor_weights(grams: DataFrame, cross: DataFrame) -> DataFrame:
    """(test_id, cell, geo, w): simplex weights of each cell's donors. A group holds donors squared numbers, never days."""
    full = grams.unionByName(grams.filter("i <> j").select("test_id", F.col("j").alias("i"), F.col("i").alias("j"), "g"))
    rows = cross.withColumnRenamed("geo", "i").join(full, ["test_id", "i"])
    rows = rows.join(cross.select("test_id", "cell", F.col("geo").alias("j")), ["test_id", "cell", "j"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, i = np.unique(pdf["i"].to_numpy(str), return_inverse=True)
        j = np.searchsorted(names, pdf["j"].to_numpy(str))
        g, b = np.zeros((len(names), len(names))), np.zeros(len(names))
        g[i, j], b[i] = pdf["g"].to_numpy(float), pdf["b"].to_numpy(float)
        return pd.DataFrame({"test_id": pdf["test_id"].iloc[0], "cell": pdf["cell"].iloc[0], "geo": names, "w": _fit(g, b)})

    return rows.groupBy("test_id", "cell").applyInPandas(solve, "test_id long, cell string, geo string, w double")


def uniform_weights(pool: DataFrame) -> DataFrame:
    return pool.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("test_id", "cell")))


def counterfactual(norm: DataFrame, series: DataFrame, weights: DataFrame) -> DataFrame:
    """series with fit: weighted donors times the cell's pre-period mean."""
    mixed = weights.join(norm.select("test_id", "geo", "day", "z"), ["test_id", "geo"]).groupBy("test_id", "cell", "day").agg(F.sum(F.col("w") * F.col("z")).alias("mix"))
    return series.join(mixed, ["test_id", "cell", "day"]).withColumn("fit", F.col("mix") * F.col("cell_mean")).drop("mix")


def fit_metrics(fitted: DataFrame) -> DataFrame:
    """(test_id, cell, pre_rmspe, post_rmspe, ratio, lift, incremental, mape)."""
    gap, pre = F.col("kpi") - F.col("fit"), F.col("pre")
    post = ~pre
    rows = fitted.groupBy("test_id", "cell").agg(
        F.sqrt(F.avg(F.when(pre, gap * gap))).alias("pre_rmspe"), F.sqrt(F.avg(F.when(post, gap * gap))).alias("post_rmspe"),
        F.sum(F.when(post, gap)).alias("incremental"), F.sum(F.when(post, F.col("fit"))).alias("expected"),
        F.avg(F.when(pre & (F.col("kpi") != 0), F.abs(gap / F.col("kpi")))).alias("mape"),
    )
    return rows.select(
        "test_id", "cell", "pre_rmspe", "post_rmspe", F.when(F.col("pre_rmspe") > 0, F.col("post_rmspe") / F.col("pre_rmspe")).alias("ratio"),
        F.when(F.col("expected") != 0, F.col("incremental") / F.col("expected")).alias("lift"), "incremental", "mape",
    )


def placebo_cells(panel: DataFrame, tests: DataFrame, test_cell: DataFrame, draws: int = 60) -> DataFrame:
    """(test_id, cell, geo): cells of the test's size from its controls, drawn by hash, distinct, those of 0.5 to 2
    times the test's volume first. Every control by itself, in order, for a test of one geo; none if fewer than two
    controls would be left."""
    pre = with_pre(panel, tests).filter("pre").groupBy("test_id", "geo").agg(F.sum("kpi").alias("volume"))
    test = test_cell.select("test_id", "geo")
    size = pre.join(test, ["test_id", "geo"]).groupBy("test_id").agg(F.count("*").alias("k"), F.sum("volume").alias("test_volume"))
    pool = pre.join(test, ["test_id", "geo"], "left_anti")
    pool = pool.withColumn("controls", F.count("*").over(Window.partitionBy("test_id"))).join(size, "test_id").filter("controls - k >= 2")
    each = pool.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(4 * draws - 1))))
    order = F.when(F.col("k") == 1, F.lpad(F.abs(F.col("draw") - F.rank().over(Window.partitionBy("test_id", "draw").orderBy("geo")) + 1).cast("string"), 9, "0")).otherwise(
        F.md5(F.concat_ws("|", F.col("test_id").cast("string"), F.col("draw").cast("string"), F.col("geo")))
    )
    picked = each.withColumn("o", order).withColumn("r", F.row_number().over(Window.partitionBy("test_id", "draw").orderBy("o", "geo"))).filter("r <= k")
    sets = picked.groupBy("test_id", "draw").agg(F.array_sort(F.collect_list("geo")).alias("geos"), (F.sum("volume") / F.first("test_volume")).alias("size"))
    sets = sets.groupBy("test_id", "geos").agg(F.min("draw").alias("draw"), F.first("size").alias("size"))
    rank = Window.partitionBy("test_id").orderBy((~F.col("size").between(0.5, 2.0)).cast("int"), "draw")
    return (
        sets.withColumn("n", F.row_number().over(rank))
        .filter(F.col("n") <= draws)
        .select("test_id", F.format_string("placebo-%02d", "n").alias("cell"), F.explode("geos").alias("geo"))
    )


def injected(panel: DataFrame, tests: DataFrame, cells: DataFrame, lift: float) -> DataFrame:
    """panel with a known lift on the test geos from the start on."""
    hit = cells.filter("cell = 'test'").select("test_id", "geo", F.lit(1 + lift).alias("f"))
    rows = panel.join(hit, ["test_id", "geo"], "left").join(tests.select("test_id", "start"), "test_id")
    return rows.select("test_id", "geo", "day", F.when(F.col("f").isNotNull() & (F.col("day") >= F.col("start")), F.col("kpi") * F.col("f")).otherwise(F.col("kpi")).alias("kpi"))


def inference(metrics: DataFrame) -> DataFrame:
    """(test_id, lift, incremental, ratio, mape, placebos, beaten, p, low, high): p = (1 + placebos with as large a
    ratio) / (placebos + 1); the 90 % interval takes the placebos' lifts off the test's."""
    real = metrics.filter("cell = 'test'").select("test_id", "lift", "incremental", "ratio", "mape")
    other = metrics.filter("cell <> 'test'").select("test_id", F.col("ratio").alias("pr"), F.col("lift").alias("pl"))
    rows = real.join(other, "test_id").groupBy("test_id", "lift", "incremental", "ratio", "mape").agg(
        F.count("*").alias("placebos"), F.count_if(F.col("pr") < F.col("ratio")).alias("beaten"),
        F.percentile("pl", F.lit(0.05)).alias("q05"), F.percentile("pl", F.lit(0.95)).alias("q95"),
    )
    p = (1 + F.col("placebos") - F.col("beaten")) / (F.col("placebos") + 1)
    return rows.select("test_id", "lift", "incremental", "ratio", "mape", "placebos", "beaten", p.alias("p"), (F.col("lift") - F.col("q95")).alias("low"), (F.col("lift") - F.col("q05")).alias("high"))


def null_bands(fitted: DataFrame) -> DataFrame:
    """(test_id, day, gap, low, high, cumulative, cum_low, cum_high) after the start: the test's relative gap, and the
    placebos' 5 % and 95 % points, by day and summed up."""
    post = fitted.filter("not pre").withColumn("gap", (F.col("kpi") - F.col("fit")) / F.col("cell_mean"))
    so_far = Window.partitionBy("test_id", "cell").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    post = post.withColumn("cum", F.sum("gap").over(so_far))
    q = lambda c, x: F.percentile(F.when(F.col("cell") != "test", F.col(c)), F.lit(x))
    real = lambda c: F.max(F.when(F.col("cell") == "test", F.col(c)))
    return post.groupBy("test_id", "day").agg(
        real("gap").alias("gap"), q("gap", 0.05).alias("low"), q("gap", 0.95).alias("high"),
        real("cum").alias("cumulative"), q("cum", 0.05).alias("cum_low"), q("cum", 0.95).alias("cum_high"),
    )


def power_curve(backtests: DataFrame, max_lift: float = 0.2, points: int = 41) -> DataFrame:
    """(test_id, lift, power) from null back-tests (test_id, null_lift, threshold): the share of them in which a lift on
    top of the null one would pass the threshold."""
    grid = F.explode(F.array(*[F.lit(k * max_lift / (points - 1)) for k in range(points)])).alias("lift")
    hit = F.avg((F.col("lift") + F.col("null_lift") * (1 + F.col("lift")) > F.col("threshold")).cast("double"))
    return backtests.select("*", grid).groupBy("test_id", "lift").agg(hit.alias("power"))


def null_lifts(backtests: DataFrame, level: float = 0.95) -> DataFrame:
    """(test_id, null_lift, threshold) from back-tests (test_id, window_id, cell, lift): the test cell's lifts where there
    was none, next to the placebo cells' 95 % point."""
    edge = backtests.filter("cell <> 'test'").groupBy("test_id").agg(F.percentile("lift", F.lit(level)).alias("threshold"))
    return backtests.filter("cell = 'test'").select("test_id", F.col("lift").alias("null_lift")).join(edge, "test_id")


def minimum_effect(curve: DataFrame, power: float = 0.8) -> DataFrame:
    """(test_id, mde): where the curve first crosses, by linear interpolation; null if it never does."""
    w = Window.partitionBy("test_id").orderBy("lift")
    rows = curve.withColumn("l0", F.lag("lift").over(w)).withColumn("p0", F.lag("power").over(w))
    cross = F.when(F.col("p0").isNull(), F.col("lift")).otherwise(F.col("l0") + (power - F.col("p0")) / (F.col("power") - F.col("p0")) * (F.col("lift") - F.col("l0")))
    hit = F.when((F.col("power") >= power) & (F.col("p0").isNull() | (F.col("p0") < power)), F.struct("lift", cross.alias("x")))
    return rows.withColumn("hit", hit).groupBy("test_id").agg(F.min("hit")["x"].alias("mde"))


def windows(panel: DataFrame, tests: DataFrame, count: int = 24, history: int = 28) -> DataFrame:
    """(test_id, window_id, start, stop): up to `count` windows before the start for back-tests, as long as the test
    itself, evenly from the first with `history` days before it to the last that fits. None where none fits."""
    days = with_pre(panel, tests).select("test_id", "day", "pre").distinct()
    lengths = days.groupBy("test_id").agg(F.count_if(F.col("pre")).alias("n"), F.count_if(~F.col("pre")).alias("post"))
    room = F.col("n") - F.col("post") - history
    lengths = lengths.withColumn("room", room).filter("room >= 0").withColumn("k", F.least(F.lit(count), F.col("room") + 1))
    at = F.floor(history + F.when(F.col("k") > 1, F.col("i") * F.col("room") / (F.col("k") - 1)).otherwise(0) + 0.5).cast("int")
    starts = lengths.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int")))).select("test_id", at.alias("r"), "post")
    place = days.withColumn("r", F.row_number().over(Window.partitionBy("test_id").orderBy("day")) - 1).select("test_id", "r", "day")
    first = place.withColumnRenamed("day", "start")
    last = place.select("test_id", F.col("r").alias("end"), F.col("day").alias("stop"))
    rows = starts.join(first, ["test_id", "r"]).withColumn("end", F.col("r") + F.col("post"))
    return rows.join(last, ["test_id", "end"]).select("test_id", F.col("r").alias("window_id"), "start", "stop")


def backtest(panel: DataFrame, wins: DataFrame, cells: DataFrame, solve: bool = True) -> DataFrame:
    """(test_id, window_id, cell, lift): every cell in every window, fitted on the days before it alone, with solved or
    uniform weights. A window is a test of its own: its id joins the key, so all of them run as one job."""
    both = wins.select("test_id", "window_id", F.xxhash64("test_id", "window_id").alias("key"), "start", "stop")
    rows = panel.join(both, "test_id").filter("day < stop").select(F.col("key").alias("test_id"), "geo", "day", "kpi")
    keyed = cells.join(both, "test_id").select(F.col("key").alias("test_id"), "cell", "geo")
    tests = both.select(F.col("key").alias("test_id"), "start")
    norm, series = normalised(rows, tests), cell_series(rows, tests, keyed)
    pool = donors(norm, keyed)
    w = donor_weights(gram(norm), cross_products(norm, series, pool)) if solve else uniform_weights(pool)
    found = fit_metrics(counterfactual(norm, series, w)).select(F.col("test_id").alias("key"), "cell", "lift")
    return found.join(both.select("key", "test_id", "window_id"), "key").drop("key")


def rank_geos(panel: DataFrame, tests: DataFrame, solve: bool = True) -> DataFrame:
    """(test_id, geo, mape, share): how well all other geos reproduce each geo before the start, and its share of the
    volume."""
    alone = panel.select("test_id", F.col("geo").alias("cell"), "geo").distinct()
    norm, series = normalised(panel, tests), cell_series(panel, tests, alone)
    pool = donors(norm, alone)
    w = donor_weights(gram(norm), cross_products(norm, series, pool)) if solve else uniform_weights(pool)
    fits = fit_metrics(counterfactual(norm, series, w)).select("test_id", "cell", "mape")
    return fits.join(volume_share(panel, tests, alone), ["test_id", "cell"]).select("test_id", F.col("cell").alias("geo"), "mape", "share")


def suggest_cell(ranked: DataFrame, low: float = 0.12, high: float = 0.20, largest: float = 0.06) -> DataFrame:
    """(test_id, geos, share) from (test_id, geo, mape, share): geos of the best fit first, until the cell's share
    reaches `low`; a geo with a share over `largest`, or one that would take the cell over `high`, is passed over."""
    rows = ranked.groupBy("test_id").agg(F.array_sort(F.collect_list(F.struct("mape", "geo", "share"))).alias("all"))
    start = F.struct(F.array().cast("array<string>").alias("geos"), F.lit(0.0).alias("share"))
    take = lambda acc, g: (acc["share"] < low) & (g["share"] <= largest) & (acc["share"] + g["share"] <= high)
    folded = F.aggregate(
        "all", start,
        lambda acc, g: F.struct(F.when(take(acc, g), F.concat(acc["geos"], F.array(g["geo"]))).otherwise(acc["geos"]).alias("geos"), F.when(take(acc, g), acc["share"] + g["share"]).otherwise(acc["share"]).alias("share")),
    )
    return rows.select("test_id", folded.alias("f")).select("test_id", "f.*")


def panel_errors(panel: DataFrame, geos: int = 4, days: int = 42) -> DataFrame:
    """(test_id, error) of panels too small to test: fewer geos than 4, or fewer days than 42."""
    n = panel.groupBy("test_id").agg(F.countDistinct("geo").alias("g"), F.countDistinct("day").alias("d"))
    rows = F.array_compact(
        F.array(
            F.when(F.col("g") < geos, F.format_string(f"%d geos, at least {geos} are needed", "g")),
            F.when(F.col("d") < days, F.format_string(f"%d days, at least {days} are needed", "d")),
        )
    )
    return n.select("test_id", F.explode(rows).alias("error"))


def default_start(panel: DataFrame, share: float = 0.75) -> DataFrame:
    """(test_id, start): the day three quarters through each panel."""
    days = panel.select("test_id", "day").distinct()
    all_days = F.array_sort(F.collect_list("day"))
    return days.groupBy("test_id").agg(F.element_at(all_days, (F.floor(F.count("*") * share) + 1).cast("int")).alias("start"))


def volume_share(panel: DataFrame, tests: DataFrame, cells: DataFrame) -> DataFrame:
    """(test_id, cell, share) of the pre-period volume."""
    pre = with_pre(panel, tests).filter("pre")
    total = pre.groupBy("test_id").agg(F.sum("kpi").alias("total"))
    return pre.join(cells, ["test_id", "geo"]).groupBy("test_id", "cell").agg(F.sum("kpi").alias("v")).join(total, "test_id").select("test_id", "cell", (F.col("v") / F.col("total")).alias("share"))


def verdicts(found: DataFrame, spend: Column, value: Column) -> DataFrame:
    """inference rows with verdict (pos, neg, none), disagrees (with p at 0.1), poor_fit (MAPE over 10 %), the
    incremental interval, and iroas = incremental value over spend."""
    verdict = F.when(F.col("low") > 0, "pos").when(F.col("high") < 0, "neg").otherwise("none")
    per = F.when(F.col("lift") != 0, F.col("incremental") / F.col("lift"))
    return found.select(
        "*", verdict.alias("verdict"), ((verdict != "none") != (F.col("p") <= 0.1)).alias("disagrees"), (F.col("mape") > 0.1).alias("poor_fit"),
        (F.col("low") * per).alias("incremental_low"), (F.col("high") * per).alias("incremental_high"),
        F.when(spend != 0, F.col("incremental") * value / spend).alias("iroas"),
    )


def ratio_histogram(metrics: DataFrame, bins: int = 18) -> DataFrame:
    """(test_id, bin, cells) of the ratios between the test's smallest and largest."""
    w = Window.partitionBy("test_id")
    rows = metrics.filter("ratio is not null").withColumn("lo", F.min("ratio").over(w)).withColumn("hi", F.max("ratio").over(w))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("ratio") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))).otherwise(0)
    return rows.groupBy("test_id", at.cast("int").alias("bin")).agg(F.count("*").alias("cells"))


def top_donors(weights: DataFrame, k: int = 10, least: float = 0.001) -> DataFrame:
    """(test_id, geo, w): the test cell's k heaviest donors."""
    rank = F.row_number().over(Window.partitionBy("test_id").orderBy(F.desc("w"), "geo"))
    return weights.filter((F.col("cell") == "test") & (F.col("w") > least)).withColumn("r", rank).filter(F.col("r") <= k).select("test_id", "geo", "w")
