"""Lead scoring: fit, signals, tiers, routing, learned weights, drafts and their gate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import clamp, half_up
from millrace.plans.storage import materialise

# Fixed values.
SIGNALS = {
    "segment_pql": 5.0,
    "helm_fork": 5.0,
    "github_fork_main": 4.0,
    "inbound_form": 4.0,
    "github_fork_api": 3.0,
    "pypi_active": 3.0,
    "job_posting": 3.0,
    "docker_deployed": 2.0,
    "website_pricing": 2.0,
    "github_star": 1.0,
}
FLAG_OF = {
    "helm_fork": "helm",
    "github_fork_main": "fork_main",
    "inbound_form": "inbound",
    "github_fork_api": "fork_api",
    "pypi_active": "pypi",
    "job_posting": "job",
    "docker_deployed": "docker",
    "website_pricing": "pricing",
    "github_star": "star",
}
DIMENSIONS = ("billing_complexity", "company_scale", "funding_growth", "headcount_fit", "technical_fit")
BILLING = {"flat": 1, "subscription": 1, "usage-based": 2, "hybrid": 3}
STAGES = {"pre-seed": 0, "bootstrapped": 1, "seed": 1, "series-a": 2, "series-b-plus": 3, "public": 3}
BANNED = r"(?i)\b(solution|seamless|powerful|robust|cutting-edge|empower|leverage|industry-leading|world-class|innovative|synerg)"
WEAK_OPENING = r"(?i)^(I wanted|Just wanted|I noticed|We noticed|I saw|I came across|I hope this|Following up)"
CLAIMS = (
    (r"(?i)self-hosted|\b\d[\d,]*\s+invoices\b", ("segment_pql",)),
    (r"(?i)\bhelm\b", ("helm_fork",)),
    (r"(?i)\bfork(ed|s)?\b", ("helm_fork", "github_fork_main", "github_fork_api")),
    (r"(?i)\bmain repo\b", ("github_fork_main",)),
    (r"(?i)\bapi repo\b", ("github_fork_api",)),
    (r"(?i)python client|\bpypi\b", ("pypi_active",)),
    (r"(?i)\bdocker\b", ("docker_deployed",)),
    (r"(?i)\bhiring\b|job post", ("job_posting",)),
    (r"(?i)\bstarred\b", ("github_star",)),
    (r"(?i)pricing page|looked at pricing|visited (the |your )?pricing", ("website_pricing",)),
    (r"(?i)\bform\b|reached out|asked about", ("inbound_form",)),
)


@dataclass(frozen=True)
class Config:
    weights: dict[str, float] = field(default_factory=lambda: dict(SIGNALS))
    cap: float = 15.0
    tier_a: float = 20.0
    tier_b: float = 12.0
    tier_c: float = 7.0
    half_life: float = 0.0  # days; 0: no decay


def _coded(c: str, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def _step(c: str, *steps: tuple[int, int]) -> Column:
    """Points of the first threshold that is reached, highest first; 0 below all."""
    out = F.lit(0)
    for least, points in reversed(steps):
        out = F.when(F.col(c) >= least, points).otherwise(out)
    return out


def icp(accounts: DataFrame) -> DataFrame:
    """accounts with the five fit dimensions and their sum, icp."""
    extra = F.col("multi_currency") | F.col("multi_product") | F.col("enterprise_contracts")
    base = _coded("billing_model", BILLING)
    stage = _coded("funding_stage", STAGES)
    parts = {
        "billing_complexity": F.when(extra, F.least(base + 1, F.lit(3))).otherwise(base),
        "company_scale": _step("headcount", (200, 3), (20, 2), (1, 1)),
        "funding_growth": F.when(F.col("funding_total_m") >= 50, F.greatest(stage, F.lit(3))).otherwise(stage),
        "headcount_fit": _step("headcount", (100, 3), (10, 2), (1, 1)),
        "technical_fit": F.when(F.col("api_first") & F.col("high_event_volume"), 3).when(F.col("api_first"), 2).otherwise(1),
    }
    return accounts.withColumns(parts).withColumn("icp", sum((F.col(d) for d in DIMENSIONS), F.lit(0)))


def composite(accounts: DataFrame) -> DataFrame:
    """accounts with pql: five banded product triggers, 15 at most."""
    steps = (
        _step("invoices_30d", (200, 3), (50, 2), (20, 1))
        + F.when(F.col("plans") + F.col("metrics") >= 8, 3).when(F.col("plans") + F.col("metrics") >= 4, 2).when(F.col("plans") + F.col("metrics") >= 2, 1).otherwise(0)
        + _step("seats", (3, 2), (2, 1))
        + F.when(F.col("payment_failed"), 2).otherwise(0)
        + _step("hosting_months", (6, 2), (2, 1))
    )
    return accounts.withColumn("pql", F.least(F.lit(15), steps))


def flags(accounts: DataFrame, learning: bool = False) -> DataFrame:
    """accounts with `fired`, a map of signal to whether it fired. For learning, the product signal means 50 invoices."""
    product = F.col("invoices_30d") >= 50 if learning else F.col("pql") > 0
    pairs = []
    for s in SIGNALS:
        pairs += [F.lit(s), product if s == "segment_pql" else F.coalesce(F.col(FLAG_OF[s]), F.lit(False))]
    return accounts.withColumn("fired", F.create_map(*pairs))


def branch() -> Column:
    building = F.col("fork_main") | F.col("helm") | F.col("fork_api") | F.col("pypi")
    return F.when(F.col("invoices_30d") >= 50, "A").when(building, "B").otherwise("C")


def signal_points(accounts: DataFrame, cfg: Config) -> DataFrame:
    """(id, signal, points, age) for every fired signal: weight (times composite / 5 for the product signal), halved
    with each half-life of its age."""
    full = flags(composite(accounts))
    weight = F.create_map(*[x for s, w in cfg.weights.items() for x in (F.lit(s), F.lit(float(w)))])
    rows = full.select("id", "pql", "age", F.explode("fired").alias("signal", "on")).filter("on")
    base = F.when(F.col("signal") == "segment_pql", F.col("pql") * weight[F.col("signal")] / 5).otherwise(weight[F.col("signal")])
    decay = F.pow(F.lit(0.5), F.col("age")[F.col("signal")] / F.lit(cfg.half_life)) if cfg.half_life > 0 else F.lit(1.0)
    return rows.select("id", "signal", (base * decay).alias("points"), F.col("age")[F.col("signal")].alias("age"))


def score(accounts: DataFrame, cfg: Config) -> DataFrame:
    """(id, name, icp, raw_signal, signal, total, tier, branch)."""
    sums = signal_points(accounts, cfg).groupBy("id").agg(F.sum("points").alias("raw_signal"))
    rows = icp(accounts).join(sums, "id", "left").withColumn("raw_signal", F.coalesce("raw_signal", F.lit(0.0)))
    rows = rows.withColumn("signal", F.least("raw_signal", F.lit(cfg.cap))).withColumn("total", F.col("icp") + F.col("signal"))
    tier = F.when(F.col("total") >= cfg.tier_a, "A").when(F.col("total") >= cfg.tier_b, "B").when(F.col("total") >= cfg.tier_c, "C").otherwise("none")
    rows = rows.withColumn("tier", tier)
    return rows.select("id", "name", "icp", "raw_signal", "signal", "total", "tier", F.when(F.col("tier") != "none", branch()).alias("branch"))


def explain_points(accounts: DataFrame, cfg: Config) -> DataFrame:
    """(id, part, points, rule): where each point of a score comes from."""
    fit = icp(accounts).select(
        "id", F.inline(F.array(*[F.struct(F.lit(d).alias("part"), F.col(d).cast("double").alias("points"), F.concat(F.lit(d + " = "), F.col(d).cast("string")).alias("rule")) for d in DIMENSIONS]))
    )
    rule = F.concat(F.lit("fired "), F.col("age").cast("string"), F.lit(" days ago"))
    return fit.unionByName(signal_points(accounts, cfg).select("id", F.col("signal").alias("part"), "points", rule.alias("rule")))


def ranking(scores: DataFrame, by: str = "total", k: int = 100) -> DataFrame:
    """The k best accounts by icp, signal or total; ties by total, then name."""
    return scores.orderBy(F.desc(by), F.desc("total"), "name", "id").limit(k)


def tier_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("tier").agg(F.count("*").alias("accounts"))


def features(accounts: DataFrame) -> DataFrame:
    """accounts with one double column for each dimension and signal."""
    rows = flags(composite(icp(accounts)), learning=True)
    return rows.withColumns({**{d: F.col(d).cast("double") for d in DIMENSIONS}, **{s: F.col("fired")[s].cast("double") for s in SIGNALS}})


def fit_logit(rows: DataFrame, lam: float, label: str = "y"):
    """L2 logistic regression on standardised features, intercept free; lam is the penalty of the summed loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = [*DIMENSIONS, *SIGNALS]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    n = max(1, vectors.count())
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=lam / n, elasticNetParam=0.0, standardization=True, maxIter=100).fit(vectors)
    return model, dict(zip(names, model.coefficients.toArray().tolist(), strict=True))


def out_of_fold(rows: DataFrame, lam: float, folds: int = 4, label: str = "y") -> DataFrame:
    """(id, fold, y, p): each row's probability under the model that did not see its fold."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = materialise(rows, "features")
    out = None
    for k in range(folds):
        model, _ = fit_logit(rows.filter(F.col("fold") != k), lam, label)
        held = VectorAssembler(inputCols=[*DIMENSIONS, *SIGNALS], outputCol="features").transform(rows.filter(F.col("fold") == k))
        part = model.transform(held).select("id", "fold", F.col(label).alias("y"), vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def auc(scored: DataFrame, score_col: str = "score", label: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., auc): Mann-Whitney with tied ranks, from counts by score value: each tie is one row in the window."""
    groups = scored.groupBy(*by, score_col).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    below = Window.partitionBy(*by).orderBy(score_col).rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2.0)
    pos, n = F.sum("pos"), F.sum("n")
    value = (F.sum(F.col("pos") * F.col("rank")) - pos * (pos + 1) / 2.0) / (pos * (n - pos))
    return ranked.groupBy(*by).agg(F.when((pos > 0) & (n > pos), value).alias("auc"))


def deciles(scored: DataFrame, score_col: str = "score", label: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., decile, n, rate): rows in descending score (then id), cut at round(d*n/10); decile 0 is the top.

    Rows are counted by score value, and the window is over the distinct values. Only the values that a cut parts, nine
    at most for each of `by`, are looked at row by row.
    """
    tied = scored.groupBy(*by, F.col(score_col).alias("value")).agg(F.count("*").alias("n"), F.sum(label).alias("hits"))
    above = Window.partitionBy(*by).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = tied.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))

    def decile(rank: Column) -> Column:
        return sum((F.when(rank >= half_up(F.col("all") * d / 10.0), 1).otherwise(0) for d in range(1, 10)), F.lit(0))

    ranked = ranked.withColumn("decile", decile(F.col("above"))).withColumn("last", decile(F.col("above") + F.col("n") - 1))
    whole = ranked.filter("decile = last").select(*by, "decile", "n", "hits")
    cut = ranked.filter("decile < last").select(*by, "value", "above", "all")
    inside = F.row_number().over(Window.partitionBy(*by, "value").orderBy("id")) - 1
    parted = (
        scored.withColumn("value", F.col(score_col))
        .join(cut, [*by, "value"])
        .withColumn("rank", F.col("above") + inside)
        .select(*by, decile(F.col("rank")).alias("decile"), F.lit(1).cast("long").alias("n"), F.col(label).alias("hits"))
    )
    sums = whole.unionByName(parted).groupBy(*by, "decile").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return sums.select(*by, "decile", "n", (F.col("hits") / F.col("n")).alias("rate"))


def integer_weights(coefficients: DataFrame) -> DataFrame:
    """(signal, weight) from (signal, coefficient): scaled so that the strongest is 5, clamped to 0-5, half up."""
    top = F.greatest(F.max("coefficient").over(Window.partitionBy()), F.lit(1e-9))
    return coefficients.select("signal", half_up(clamp(5 * F.col("coefficient") / top, 0.0, 5.0)).cast("int").alias("weight"))


def weight_gap(learned: DataFrame, current: DataFrame) -> DataFrame:
    """(signal, learned, current, gap): signals whose weights differ, the widest gap first."""
    both = learned.withColumnRenamed("weight", "learned").join(current.withColumnRenamed("weight", "current"), "signal")
    return both.withColumn("gap", F.col("learned") - F.col("current")).filter("gap <> 0").orderBy(F.desc(F.abs("gap")), "signal")


def top_decile_lift(by_decile: DataFrame) -> DataFrame:
    """(lift): conversion of the top decile over that of all."""
    top = F.sum(F.when(F.col("decile") == 0, F.col("rate")))
    return by_decile.agg((top / (F.sum(F.col("rate") * F.col("n")) / F.sum("n"))).alias("lift"))


def drafts(accounts: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, branch, subject, body): an opening message for each account with a branch."""
    rows = accounts.join(scores.select("id", "branch"), "id").filter("branch is not null")
    acts = [("helm_fork", "helm", "deployed the Helm charts", "Helm charts"), ("github_fork_main", "fork_main", "forked the main repo", "main repo"),
            ("github_fork_api", "fork_api", "forked the API repo", "API repo"), ("pypi_active", "pypi", "integrated the Python client", "Python client")]
    done = F.array_sort(
        F.array_compact(
            F.array(*[F.when(F.col(c), F.struct(F.col("age")[s].alias("age"), F.lit(k).alias("k"), F.lit(act).alias("act"), F.lit(tool).alias("tool"))) for k, (s, c, act, tool) in enumerate(acts)])
        )
    )
    last = F.get(done, F.lit(0))
    reason = (
        F.when(F.col("job"), "is hiring for billing infrastructure")
        .when(F.col("inbound"), "asked about pricing through the site form")
        .when(F.col("hosting_months") > 0, F.format_string("has run the self-hosted edition for %d months", "hosting_months"))
        .when(F.col("pricing"), "looked at pricing this month")
        .when(F.col("docker"), "pulled the Docker image this month")
        .when(F.col("star"), "starred the open-source repo")
        .otherwise(F.concat(F.lit("runs "), "billing_model", F.lit(" pricing")))
    )
    subject = (
        F.when(F.col("branch") == "A", F.format_string("%d invoices a month, self-hosted", "invoices_30d"))
        .when(F.col("branch") == "B", F.concat("name", F.lit(" and the "), last["tool"]))
        .otherwise(F.concat(F.lit("Billing at "), "name"))
    )
    story = (
        F.when(F.col("branch") == "A", F.format_string("has run the self-hosted edition for %d months and issued %d invoices in 30 days", "hosting_months", "invoices_30d"))
        .when(F.col("branch") == "B", last["act"])
        .otherwise(reason)
    )
    body = F.concat(F.lit("Hi there,\n\n"), F.col("name"), F.lit(" "), story, F.lit(".\n\nWorth 20 minutes?"))
    return rows.select("id", "branch", subject.alias("subject"), body.alias("body"))


def gate(draft: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, rule, ok): one row for each rule and draft."""
    rows = draft.join(flags(composite(accounts)).select("id", "name", "fired"), "id")
    words = lambda c: F.regexp_count(F.col(c), F.lit(r"\S+"))
    backed, unbacked = F.lit(False), F.lit(False)
    for pattern, signals in CLAIMS:
        said = F.col("body").rlike(pattern)
        real = F.exists(F.array(*[F.col("fired")[s] for s in signals]), lambda x: x)
        backed, unbacked = backed | (said & real), unbacked | (said & ~real)
    opener = F.regexp_replace("body", r"(?i)^\s*(hi|hello|hey)\b[^\n]*\n+", "")
    rules = {
        "body length": words("body") <= 75,
        "subject length": words("subject") <= 8,
        "vocabulary": ~F.concat("subject", F.lit(" "), "body").rlike(BANNED),
        "company named": F.contains(F.lower("body"), F.lower("name")),
        "cites a signal": backed,
        "no unbacked claim": ~unbacked,
        "opening": ~opener.rlike(WEAK_OPENING),
        "one closing question": F.trim("body").rlike(r"\?$") & (F.regexp_count("body", F.lit(r"\?")) == 1),
    }
    return rows.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("ok")) for k, v in rules.items()])))


def config_difference(current: DataFrame, source: DataFrame) -> DataFrame:
    """(signal, source, current) of the weights that differ."""
    both = source.withColumnRenamed("weight", "source").join(current.withColumnRenamed("weight", "current"), "signal")
    return both.filter("source <> current")
