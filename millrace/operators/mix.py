"""Media-mix models of many panels at once: curves, non-negative ridge fits, returns and budget plans.

spend: panel_id, week, channel, spend. target: panel_id, week, revenue.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.storage import materialise

# Fixed values.
DECAYS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
HALF_SATURATIONS = (0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0)  # times the channel's mean weekly spend
SHAPES = (1.0, 1.5, 2.2)
HOLDOUT = 13  # weeks
YEAR = 52.18  # weeks
PENALTY = 0.05  # of the ridge; the intercept is free
START = (0.3, 1.0, 1.5)  # decay, multiple and shape the search starts from, and the priors' centres
WIDTHS = (0.3, 0.8, 0.7)  # of the priors on decay, log multiple and shape
TERMS = ["trend", *[f"{f}{k}" for k in (1, 2, 3) for f in ("sin", "cos")]]


def validated(wide: DataFrame, channels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(spend rows of the sound lines, errors) from wide text rows (panel_id, line, week, revenue, one column for each
    channel). Currency signs, spaces and underscores are ignored."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[€$£\s_]", "").try_cast("double")
    rules = [
        (F.col("week").isNull() | (F.trim(F.col("week").cast("string")) == ""), F.lit("week is missing")),
        (clean("revenue").isNull(), F.lit("revenue is missing")),
        (clean("revenue") <= 0, F.lit("revenue must be positive")),
        *[(clean(c).isNull(), F.lit(f"{c} is no number")) for c in channels],
        *[(clean(c) < 0, F.lit(f"{c} is negative")) for c in channels],
    ]
    marked = wide.withColumn("errors", F.array_compact(F.array(*[F.when(c, m) for c, m in rules])))
    errors = marked.select("panel_id", "line", F.explode("errors").alias("error"))
    good = marked.filter(F.size("errors") == 0).select("panel_id", "week", clean("revenue").alias("revenue"), *[clean(c).alias(c) for c in channels])
    return good.unpivot(["panel_id", "week", "revenue"], channels, "channel", "spend"), errors


def wide_export(spend: DataFrame, target: DataFrame, channels: list[str]) -> DataFrame:
    wide = spend.groupBy("panel_id", "week").pivot("channel", channels).sum("spend")
    return target.join(wide, ["panel_id", "week"])


def adstock(spend: DataFrame, decays=DECAYS) -> DataFrame:
    """(panel_id, channel, decay, week, x): (1 - d) times the decayed sum of spend so far, for each decay. A channel's
    weeks are one array, folded once."""
    series = spend.groupBy("panel_id", "channel").agg(F.array_sort(F.collect_list(F.struct("week", "spend"))).alias("s"))
    rows = series.withColumn("decay", F.explode(F.array(*[F.lit(float(d)) for d in decays])))
    folded = F.aggregate(
        "s",
        F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("run")),
        lambda acc, p: F.struct(
            F.concat(acc["out"], F.array((acc["run"] * F.col("decay") + p["spend"]) * (1 - F.col("decay")))).alias("out"),
            (acc["run"] * F.col("decay") + p["spend"]).alias("run"),
        ),
        lambda acc: acc["out"],
    )
    return rows.withColumn("a", folded).select("panel_id", "channel", "decay", F.inline(F.arrays_zip("s", "a"))).select("panel_id", "channel", "decay", F.col("s.week").alias("week"), F.col("a").alias("x"))


def hill(x: Column, half: Column, shape: Column) -> Column:
    return F.when(x > 0, 1 / (1 + F.pow(half / x, shape))).otherwise(0.0)


def curve_candidates(spend: DataFrame, decays=DECAYS) -> DataFrame:
    """(panel_id, channel, decay, half, shape): the grid, half-saturations as multiples of the mean weekly spend."""
    level = spend.groupBy("panel_id", "channel").agg(F.avg("spend").alias("level"))
    grid = F.array(*[F.struct(F.lit(float(d)).alias("decay"), F.lit(h).alias("h"), F.lit(s).alias("shape")) for d, h, s in product(decays, HALF_SATURATIONS, SHAPES)])
    return level.select("panel_id", "channel", "level", F.inline(grid)).select("panel_id", "channel", "decay", (F.col("level") * F.col("h")).alias("half"), "shape")


def saturated(stocked: DataFrame, curves: DataFrame) -> DataFrame:
    """(panel_id, channel, week, v): each channel's response with one curve each (decay, half, shape)."""
    rows = stocked.join(curves, ["panel_id", "channel", "decay"])
    return rows.select("panel_id", "channel", "week", hill(F.col("x"), F.col("half"), F.col("shape")).alias("v"))


def baseline(target: DataFrame) -> DataFrame:
    """target with t (week number), trend (0 to 1) and three yearly sine and cosine pairs."""
    w = Window.partitionBy("panel_id")
    rows = target.withColumn("t", F.row_number().over(w.orderBy("week")) - 1).withColumn("n", F.count("*").over(w))
    waves = {}
    for k in (1, 2, 3):
        waves[f"sin{k}"] = F.sin(2 * math.pi * k * F.col("t") / YEAR)
        waves[f"cos{k}"] = F.cos(2 * math.pi * k * F.col("t") / YEAR)
    return rows.withColumn("trend", F.col("t") / F.greatest(F.col("n") - 1, F.lit(1))).withColumns(waves)


def _ridge(x: np.ndarray, y: np.ndarray, media: int) -> tuple[np.ndarray, float]:
    """Ridge weights and the sum of squared errors. The first column is the intercept, which is not penalised; the last
    `media` weights are non-negative: while some are negative, the most negative one leaves and the rest is refitted."""
    first = x.shape[1] - media
    g, h = x.T @ x + PENALTY * np.diag([0.0, *[1.0] * (x.shape[1] - 1)]), x.T @ y
    live = np.arange(x.shape[1])
    while True:
        beta = np.linalg.solve(g[np.ix_(live, live)], h[live])
        drop = first + int(np.argmin(beta[first:])) if len(live) > first else -1
        if drop < 0 or beta[drop] >= 0:
            out = np.zeros(x.shape[1])
            out[live] = beta
            error = y - x @ out
            return out, float(error @ error)
        live = np.delete(live, drop)


def _responses(spend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All curves of one channel: (curves, 3) decay, multiple and shape, (curves, weeks) responses, (curves,) priors."""
    grid = np.array(list(product(DECAYS, HALF_SATURATIONS, SHAPES)))
    stocks = {}
    for d in DECAYS:
        run, out = 0.0, np.zeros(len(spend))
        for k, v in enumerate(spend):
            run = run * d + v
            out[k] = run * (1 - d)
        stocks[d] = out
    x = np.stack([stocks[d] for d in grid[:, 0]])
    half = grid[:, 1] * max(float(spend.mean()), 1e-12)
    ratio = np.divide(half[:, None], x, out=np.full(x.shape, np.inf), where=x > 0)
    away = (grid[:, 0] - START[0]) / WIDTHS[0], np.log(grid[:, 1] / START[1]) / WIDTHS[1], (grid[:, 2] - START[2]) / WIDTHS[2]
    return grid, 1 / (1 + ratio ** grid[:, 2:]), sum(a * a for a in away)


FIT_SCHEMA = "panel_id long, channel string, decay double, half double, shape double, beta double"


def fit_panels(spend: DataFrame, target: DataFrame, sweeps: int = 4, holdout: int = HOLDOUT) -> DataFrame:
    """(panel_id, channel, decay, half, shape, beta), and a panel's baseline terms with null curves.

    A group is one panel: its weeks and channels, a few thousand numbers, whatever the number of panels. Each channel's
    curve (216 of them) is searched in turn, at most `sweeps` times round, from decay 0.3, one mean spend and shape 1.5:
    the least squared error on the training weeks, over the variance the first curves leave, plus weak priors on decay,
    half-saturation and shape. The chosen curves are then refitted on all weeks. Revenue is in units of its mean over
    the training weeks while fitting; coefficients are returned in its own.
    """
    rows = spend.join(baseline(target), ["panel_id", "week"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        weeks = pdf.drop_duplicates("week").sort_values("week")
        raw = pdf.pivot_table(index="week", columns="channel", values="spend", aggfunc="sum").reindex(weeks["week"]).fillna(0.0)
        flat = np.column_stack([np.ones(len(weeks)), weeks[TERMS].to_numpy(float)])
        train = slice(0, max(len(weeks) - holdout, (len(weeks) + 1) // 2))
        scale = max(float(np.abs(weeks["revenue"].to_numpy(float)[train]).mean()), 1e-9)
        y = weeks["revenue"].to_numpy(float) / scale
        curves = [_responses(raw[c].to_numpy(float)) for c in raw.columns]
        start = list(product(DECAYS, HALF_SATURATIONS, SHAPES)).index(START)
        design = np.column_stack([flat, *[v[start] for _, v, _ in curves]])
        picks = [start] * len(curves)
        free = max(len(y[train]) - design.shape[1], 1)
        noise = max(_ridge(design[train], y[train], len(curves))[1] / free, 1e-12)

        def cost(x: np.ndarray, chosen: list[int]) -> float:
            return _ridge(x[train], y[train], len(curves))[1] / noise + sum(p[k] for (_, _, p), k in zip(curves, chosen, strict=True))

        best = cost(design, picks)
        for _ in range(sweeps):
            before = list(picks)
            for i, (_, values, _) in enumerate(curves):
                trial = design.copy()
                for k, value in enumerate(values):
                    trial[:, flat.shape[1] + i] = value
                    now = cost(trial, [*picks[:i], k, *picks[i + 1 :]])
                    if now < best - 1e-9:
                        best, picks[i] = now, k
                        design[:, flat.shape[1] + i] = value
            if picks == before:
                break
        beta = _ridge(design, y, len(curves))[0] * scale
        panel = int(pdf["panel_id"].iloc[0])
        out = [(panel, name, None, None, None, b) for name, b in zip(["1", *TERMS], beta, strict=False)]
        for c, k, b, (grid, _, _) in zip(raw.columns, picks, beta[flat.shape[1] :], curves, strict=True):
            decay, multiple, shape = grid[k]
            out.append((panel, c, decay, multiple * float(raw[c].mean()), shape, b))
        return pd.DataFrame(out, columns=["panel_id", "channel", "decay", "half", "shape", "beta"])

    return rows.groupBy("panel_id").applyInPandas(solve, FIT_SCHEMA)


def fitted(target: DataFrame, stocked: DataFrame, model: DataFrame) -> DataFrame:
    """(panel_id, week, revenue, fit, holdout): fit sums baseline terms and channel responses."""
    curves = model.filter("decay is not null")
    media = saturated(stocked, curves.drop("beta")).join(curves.select("panel_id", "channel", "beta"), ["panel_id", "channel"])
    media = media.groupBy("panel_id", "week").agg(F.sum(F.col("v") * F.col("beta")).alias("media"))
    base = baseline(target)
    values = base.select("panel_id", "week", "revenue", "t", "n", F.lit(1.0).alias("1"), *TERMS)
    long = values.unpivot(["panel_id", "week", "revenue", "t", "n"], ["1", *TERMS], "channel", "v")
    flat = long.join(model.filter("decay is null").select("panel_id", "channel", "beta"), ["panel_id", "channel"])
    flat = flat.groupBy("panel_id", "week", "revenue", "t", "n").agg(F.sum(F.col("v") * F.col("beta")).alias("base"))
    return flat.join(media, ["panel_id", "week"]).select("panel_id", "week", "revenue", (F.col("base") + F.col("media")).alias("fit"), "base", (F.col("t") >= F.col("n") - HOLDOUT).alias("holdout"))


def fit_quality(rows: DataFrame) -> DataFrame:
    """(panel_id, r2, train_mape, holdout_mape)."""
    err = F.col("revenue") - F.col("fit")
    mean = F.avg("revenue").over(Window.partitionBy("panel_id"))
    ape = F.abs(err / F.col("revenue"))
    return rows.withColumn("m", mean).groupBy("panel_id").agg(
        (1 - F.sum(err * err) / F.sum((F.col("revenue") - F.col("m")) * (F.col("revenue") - F.col("m")))).alias("r2"),
        F.avg(F.when(~F.col("holdout"), ape)).alias("train_mape"), F.avg(F.when(F.col("holdout"), ape)).alias("holdout_mape"),
    )


def decomposition(spend: DataFrame, stocked: DataFrame, model: DataFrame) -> DataFrame:
    """(panel_id, channel, spend, contribution, roi)."""
    curves = model.filter("decay is not null")
    media = saturated(stocked, curves.drop("beta")).join(curves.select("panel_id", "channel", "beta"), ["panel_id", "channel"])
    got = media.groupBy("panel_id", "channel").agg(F.sum(F.col("v") * F.col("beta")).alias("contribution"))
    paid = spend.groupBy("panel_id", "channel").agg(F.sum("spend").alias("spend"))
    return paid.join(got, ["panel_id", "channel"]).withColumn("roi", F.when(F.col("spend") > 0, F.col("contribution") / F.col("spend")))


def response(at: Column) -> Column:
    return F.col("beta") * hill(at, F.col("half"), F.col("shape"))


def marginal_roi(levels: DataFrame) -> DataFrame:
    """levels (panel_id, channel, weekly, half, shape, beta) with marginal: a central difference of 50 or 1 %."""
    h = F.greatest(F.lit(50.0), 0.01 * F.col("weekly"))
    return levels.withColumn("marginal", (response(F.col("weekly") + h) - response(F.greatest(F.col("weekly") - h, F.lit(0.0)))) / (h + F.least(h, F.col("weekly"))))


def response_curve(levels: DataFrame, points: int = 61) -> DataFrame:
    """(panel_id, channel, spend, revenue) at equal steps up to twice the weekly spend."""
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    rows = levels.select("*", k).withColumn("x", F.col("weekly") * 2.0 * F.col("k") / (points - 1))
    return rows.select("panel_id", "channel", "k", F.col("x").alias("spend"), response(F.col("x")).alias("revenue"))


def budget_plan(levels: DataFrame, budgets: DataFrame, max_change: float = 0.5, steps: int = 100) -> DataFrame:
    """(panel_id, channel, weekly, planned) for budgets (panel_id, budget) and optional column `locked` in levels.

    Every channel may move by max_change; locked ones stay. The floor is spent first, then steps of a hundredth of
    each range, in order of what they earn a unit: the running gain over the best start so far (the curve's concave
    envelope), so an S-shaped curve takes its early steps together with those that pay for them.
    """
    locked = F.col("locked") if "locked" in levels.columns else F.lit(False)
    base = levels.select(
        "*",
        F.when(locked, F.col("weekly")).otherwise(F.col("weekly") * (1 - max_change)).alias("floor"),
        F.when(locked, F.lit(0.0)).otherwise(F.col("weekly") * 2 * max_change / steps).alias("step"),
    )
    room = base.groupBy("panel_id").agg(F.sum("floor").alias("floors")).join(budgets, "panel_id").withColumn("free", F.greatest(F.col("budget") - F.col("floors"), F.lit(0.0)))
    each = base.filter("step > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    gain = (response(F.col("floor") + F.col("k") * F.col("step")) - response(F.col("floor"))) / (F.col("k") * F.col("step"))
    # The mean gain from the floor up to a step or a later one: never rises along the curve.
    ahead = Window.partitionBy("panel_id", "channel").orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    each = each.withColumn("mean", gain).withColumn("gain", F.max("mean").over(ahead))
    order = Window.partitionBy("panel_id").orderBy(F.desc("gain"), "channel", "k").rowsBetween(Window.unboundedPreceding, 0)
    taken = each.withColumn("used", F.sum("step").over(order)).join(room.select("panel_id", "free"), "panel_id").filter("used <= free + 1e-9")
    added = taken.groupBy("panel_id", "channel").agg(F.sum("step").alias("added"))
    return base.join(added, ["panel_id", "channel"], "left").select("panel_id", "channel", "weekly", (F.col("floor") + F.coalesce("added", F.lit(0.0))).alias("planned"), "half", "shape", "beta")


def _steps(levels: DataFrame, max_change: float, steps: int) -> tuple[DataFrame, DataFrame]:
    """The channels with their floor and step, and one row for each step with what it earns a unit (never rising along a
    curve: the mean gain from the floor up to it or a later one), to 12 places, so that like curves tie."""
    locked = F.col("locked") if "locked" in levels.columns else F.lit(False)
    base = levels.select(
        "*",
        F.when(locked, F.col("weekly")).otherwise(F.col("weekly") * (1 - max_change)).alias("floor"),
        F.when(locked, F.lit(0.0)).otherwise(F.col("weekly") * 2 * max_change / steps).alias("step"),
    )
    each = base.filter("step > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    gain = (response(F.col("floor") + F.col("k") * F.col("step")) - response(F.col("floor"))) / (F.col("k") * F.col("step"))
    ahead = Window.partitionBy("panel_id", "channel").orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    return base, each.withColumn("mean", gain).withColumn("gain", F.round(F.max("mean").over(ahead), 12)).select("panel_id", "channel", "k", "step", "gain")


def global_plan(levels: DataFrame, budget: float, max_change: float = 0.5, steps: int = 100, grid: int = 64, rounds: int = 12) -> DataFrame:
    """(panel_id, channel, weekly, planned) for one budget over all panels, as budget_plan plans each panel by its own.

    The price of money is searched for: at every price of a grid, one aggregate sums what all steps that earn more would
    spend; the two prices around the budget are the next grid's ends. Steps above the price are taken wherever they are,
    and only the few at it are put in order (gain, panel, channel, step) and taken while they fit. What comes to the
    driver is a grid's sums. A budget under all floors leaves the floors.
    """
    base, each = _steps(levels, max_change, steps)
    each = materialise(each, "budget-steps")
    free = budget - (base.agg(F.sum("floor")).first()[0] or 0.0)
    low, high = each.agg(F.min("gain"), F.max("gain")).first()
    if low is None or free <= 0:
        return base.select("panel_id", "channel", "weekly", F.col("floor").alias("planned"))
    low, high = low - abs(low) - 1.0, high  # at `low` every step is taken, at `high` none
    for _ in range(rounds):
        prices = [low + (high - low) * i / grid for i in range(grid + 1)]
        spent = each.agg(*[F.coalesce(F.sum(F.when(F.col("gain") > p, F.col("step"))), F.lit(0.0)).alias(f"p{i}") for i, p in enumerate(prices)]).first()
        at = next((i for i in range(grid + 1) if spent[i] <= free), grid)  # demand falls as the price rises
        if at == 0:
            break
        low, high = prices[at - 1], prices[at]
        if each.filter((F.col("gain") > low) & (F.col("gain") <= high)).limit(10_001).count() <= 10_000:
            break
    sure = each.filter(F.col("gain") > high)
    used = sure.agg(F.coalesce(F.sum("step"), F.lit(0.0))).first()[0]
    order = Window.orderBy(F.desc("gain"), "panel_id", "channel", "k").rowsBetween(Window.unboundedPreceding, 0)
    margin = each.filter((F.col("gain") > low) & (F.col("gain") <= high)).withColumn("sum", F.sum("step").over(order)).filter(F.col("sum") <= free - used + 1e-9).drop("sum")
    added = sure.unionByName(margin).groupBy("panel_id", "channel").agg(F.sum("step").alias("added"))
    return base.join(added, ["panel_id", "channel"], "left").select("panel_id", "channel", "weekly", (F.col("floor") + F.coalesce("added", F.lit(0.0))).alias("planned"))


def plan_summary(plan: DataFrame, budgets: DataFrame) -> DataFrame:
    """(panel_id, budget, planned, unspent, revenue_now, revenue_plan, movers): movers changed by over 0.5 %."""
    moved = F.abs(F.col("planned") - F.col("weekly")) > 0.005 * F.col("weekly")
    sums = plan.groupBy("panel_id").agg(F.sum("planned").alias("planned"), F.sum(response(F.col("weekly"))).alias("revenue_now"), F.sum(response(F.col("planned"))).alias("revenue_plan"), F.count_if(moved).alias("movers"))
    return sums.join(budgets, "panel_id").withColumn("unspent", F.col("budget") - F.col("planned"))


def channel_correlation(spend: DataFrame) -> DataFrame:
    """(panel_id, a, b, r) of weekly spends; 0 where one does not vary."""
    x = spend.select("panel_id", "week", F.col("channel").alias("a"), F.col("spend").alias("x"))
    y = spend.select("panel_id", "week", F.col("channel").alias("b"), F.col("spend").alias("y"))
    rows = x.join(y, ["panel_id", "week"]).filter("a < b")
    return rows.groupBy("panel_id", "a", "b").agg(F.coalesce(F.nanvl(F.corr("x", "y"), F.lit(0.0)), F.lit(0.0)).alias("r"))


def recovery_diagnosis(spend: DataFrame, correlation: DataFrame, contribution: DataFrame, target: DataFrame) -> DataFrame:
    """(panel_id, channel, collinear, flat, flights, few_flights, small): why a channel's curve may be hard to recover.

    flat: spend varies by under 0.3 of its mean. A flight is a run of weeks above 40 % of the channel's peak; few_flights:
    four at most, with a lower quartile below a tenth of the peak. small: none of these, and its contribution
    (panel_id, channel, contribution) is under 4 % of the panel's revenue.
    """
    w = Window.partitionBy("panel_id", "channel")
    high = F.col("spend") > 0.4 * F.max("spend").over(w)
    rows = spend.withColumn("high", high)
    rows = rows.withColumn("rise", F.col("high") & ~F.coalesce(F.lag("high").over(w.orderBy("week")), F.lit(False)))
    stats = rows.groupBy("panel_id", "channel").agg(
        (F.coalesce(F.stddev_samp("spend"), F.lit(0.0)) / F.avg("spend") < 0.3).alias("flat"),
        F.count_if(F.col("rise")).alias("flights"),
        (F.percentile("spend", F.lit(0.25)) < 0.1 * F.max("spend")).alias("gaps"),
    )
    ends = correlation.filter(F.abs("r") > 0.6)
    hit = ends.select("panel_id", F.explode(F.array("a", "b")).alias("channel")).distinct().withColumn("collinear", F.lit(True))
    revenue = target.groupBy("panel_id").agg(F.sum("revenue").alias("revenue"))
    share = contribution.join(revenue, "panel_id").select("panel_id", "channel", (F.col("contribution") / F.col("revenue")).alias("share"))
    marked = stats.join(hit, ["panel_id", "channel"], "left").join(share, ["panel_id", "channel"], "left")
    marked = marked.withColumn("collinear", F.coalesce("collinear", F.lit(False))).withColumn("few_flights", (F.col("flights") <= 4) & F.col("gaps"))
    none = ~F.col("collinear") & ~F.col("flat") & ~F.col("few_flights")
    return marked.select("panel_id", "channel", "collinear", "flat", "flights", "few_flights", (none & F.coalesce(F.col("share") < 0.04, F.lit(False))).alias("small"))


def headline(plan: DataFrame) -> DataFrame:
    """(panel_id, headline) of a plan (panel_id, channel, weekly, planned, half, shape, beta): what moves where, and what
    it earns a week. A channel moves if it changes by over 0.5 % of all spend."""
    panel = Window.partitionBy("panel_id")
    rows = plan.withColumn("change", F.col("planned") - F.col("weekly")).withColumn("least", 0.005 * F.sum("weekly").over(panel))
    best = lambda order: F.row_number().over(panel.orderBy(order, "channel"))
    rows = rows.withColumn("up", best(F.desc("change"))).withColumn("down", best(F.asc("change")))
    grown, cut = F.col("change") > F.col("least"), F.col("change") < -F.col("least")
    sums = rows.groupBy("panel_id").agg(
        F.count_if(grown).alias("ups"), F.count_if(cut).alias("downs"), F.sum(F.when(cut, -F.col("change")).otherwise(0.0)).alias("moved"),
        F.max(F.when(F.col("up") == 1, F.col("channel"))).alias("top"), F.max(F.when(F.col("down") == 1, F.col("channel"))).alias("bottom"),
        F.sum(response(F.col("planned")) - response(F.col("weekly"))).alias("gain"),
    )
    money = lambda c: F.format_string("%.0f", F.round(c))
    gain = F.concat(F.when(F.col("gain") >= 0, "+").otherwise("-"), money(F.abs("gain")), F.lit(" revenue/wk"))
    shift = F.concat(F.lit("Shift "), money(F.col("moved")), F.lit("/wk "))
    text = (
        F.when((F.col("ups") == 0) & (F.col("downs") == 0), "Today's split is already close to the best plan")
        .when((F.col("ups") == 1) & (F.col("downs") == 1), F.concat(shift, F.lit("from "), "bottom", F.lit(" to "), "top", F.lit(": "), gain))
        .when((F.col("ups") > 0) & (F.col("downs") > 0), F.concat(shift, F.lit("toward "), "top", F.lit(": "), gain))
        .when(F.col("ups") > 0, F.concat(F.lit("Extra budget goes mostly to "), "top", F.lit(": "), gain))
        .otherwise(F.concat(F.lit("Cuts land first on "), "bottom", F.lit(": "), gain))
    )
    return sums.select("panel_id", text.alias("headline"))


def panel_errors(spend: DataFrame, weeks: int = 52, active: int = 4, channels: int = 8) -> DataFrame:
    """(panel_id, error) of panels that cannot be fitted: fewer weeks than 52, more channels than 8, or a channel with
    spend in fewer than 4 weeks."""
    each = spend.groupBy("panel_id", "channel").agg(F.count_if(F.col("spend") > 0).alias("on"))
    short = spend.groupBy("panel_id").agg(F.countDistinct("week").alias("n"), F.countDistinct("channel").alias("c"))
    message = lambda text, n: F.format_string(text, n)
    return (
        short.filter(F.col("n") < weeks).select("panel_id", message(f"%d weeks, at least {weeks} are needed", F.col("n")).alias("error"))
        .union(short.filter(F.col("c") > channels).select("panel_id", message(f"%d channels, at most {channels} are fitted", F.col("c"))))
        .union(each.filter(F.col("on") < active).select("panel_id", F.format_string(f"%s has spend in %d weeks, at least {active} are needed", "channel", "on")))
    )


def truth_recovery(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """(panel_id, channel, roi, true_roi, error, off): off by more than a fifth."""
    rows = estimate.select("panel_id", "channel", "roi").join(truth, ["panel_id", "channel"])
    return rows.withColumn("error", (F.col("roi") - F.col("true_roi")) / F.col("true_roi")).withColumn("off", F.abs("error") > 0.2)
