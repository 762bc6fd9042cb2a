"""Copy and claims gate: tables of drafts against rules, a claims register and competitors.

drafts: draft_id, channel, market, text. Text keeps its line breaks; a label such as "H:" in front of a line names its
field. Every check is one expression over all drafts; terms of a rule are one pattern, built when the plan is made.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PREFIXES = {
    "rsa": {"h": "headline", "headline": "headline", "d": "description", "description": "description"},
    "meta": {"p": "primary", "primary": "primary", "h": "headline", "headline": "headline"},
    "linkedin": {},
    "email": {"subject": "subject", "s": "subject", "preheader": "preheader", "pre": "preheader", "body": "body"},
}
FALLBACK = {"rsa": "headline", "meta": "primary", "linkedin": "body", "email": "body"}
JOINED = {"rsa": (), "meta": ("primary",), "linkedin": ("body",), "email": ("body",)}
WEIGHT = {"info": 0, "warn": 10, "block": 40}
LENGTHS = (
    ("LEN-RSA-HEAD", "rsa", "headline", 30, "block", 40), ("LEN-RSA-DESC", "rsa", "description", 90, "block", 40),
    ("LEN-META-PRIMARY", "meta", "primary", 125, "warn", 10), ("LEN-META-HEAD", "meta", "headline", 40, "warn", 10),
    ("LEN-LI-MAX", "linkedin", "body", 3000, "block", 40), ("LEN-EMAIL-SUBJ", "email", "subject", 60, "warn", 10),
    ("LEN-EMAIL-PRE", "email", "preheader", 110, "warn", 5),
)
HYPE = (
    "revolution*", "game-chang*", "seamless*", "unlock*", "supercharg*", "best-in-class", "cutting-edge", "world-class", "next-gen*",
    "disrupt*", "effortless*", "synerg*", "leverag*", "empower*", "robust", "innovative", "powerful", "magic*", "skyrocket*",
)
PUSHY = ("act now", "buy now", "limited time", "don't miss out", "hurry", "last chance", "you won't believe", "click here")
ABSOLUTE = {
    "UK": ("risk-free", "risk free", "no risk", "guarantee*", "can't lose", "completely safe"),
    "DE": ("risikofrei", "risk-free", "risk free", "ohne risiko", "garantiert", "guarantee*"),
    "US": ("proven", "clinically", "scientifically", "studies show", "research shows", "guaranteed results"),
}
SUPERLATIVES = (
    "#1", "no. 1", "number one", "market leader", "market-leading", "marktführer", "industry-leading", "leading", "the best",
    "the fastest", "the cheapest", "the only", "the easiest", "most trusted", "most popular",
)
COMPARISONS = (
    "cheaper than", "better than", "faster than", "easier than", "simpler than", "unlike", "outperform*", "vs", "versus",
    "compared to", "compared with", "instead of", "günstiger als", "besser als", "schneller als",
)
DISPARAGING = ("clunky", "outdated", "terrible", "awful", "overpriced", "useless", "broken", "rip-off", "ripoff", "scam", "slow")
CLAIM_NOUN = (
    "(?i)^(hours?|minutes?|seconds?|compan(y|ies)|customers?|businesses|teams?|users?|countries|currencies|reviews?|reviewers|faster"
    "|quicker|cheaper|less|fewer|more|saved?|savings|times|cashback|markup)$"
)
STOP_WORDS = (
    "a", "an", "the", "of", "on", "in", "by", "to", "for", "and", "or", "with", "your", "you", "our", "we", "us", "is", "are", "up",
    "under", "no", "across", "per", "every", "it", "its", "at", "as", "from", "than", "more", "that", "this", "be", "get", "can", "out",
    "all", "one", "each", "just",
)
BRAND_WORDS = ("card", "spend", "team", "finance", "expense")  # of the house's own trade: they carry no claim
WORD = r"[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9'’-]*"
NUMBER = r"([€£$]\s?)?(\d{1,3}(?:[.,]\d{3})+|\d+(?:[.,]\d+)?)(\s?%|\s?x(?![a-z])|[km](?![a-z]))?(\+)?"
PASSIVE = (
    r"(?i)\b(?:is|are|was|were|be|been|being|gets?|got)\s+(?:\w+ly\s+)?"
    r"(?:\w+ed|known|done|made|given|taken|seen|built|paid|sent|spent|kept|held|shown|chosen)\b"
)
EMOJI = "[☀-➿\U0001f300-\U0001faff]"


@dataclass(frozen=True)
class Rule:
    """A phrase rule as data. None in markets or channels: all. `unless` lets a hit off where its pattern stands in the
    whole text (unless_scope 'text') or in the hit's sentence ('sentence'). Message and fix may hold {terms} and {n}."""

    rule: str
    severity: str
    terms: tuple[str, ...]
    weight: int | None = None
    markets: tuple[str, ...] | None = None
    channels: tuple[str, ...] | None = None
    unless: str | None = None
    unless_scope: str = "text"
    message: str = "Found: {terms}."
    fix: str = "Remove or rephrase."


def standard_rules(custom: tuple[str, ...] = ()) -> list[Rule]:
    """The house's phrase rules; custom: words that a team bans for itself."""
    rules = [
        Rule("TOV-HYPE", "warn", HYPE, 8, message="Hype words: {terms}.", fix="Say what the product does."),
        Rule("TOV-PUSHY", "warn", PUSHY, 8, message="Pressure: {terms}.", fix="Give a reason to act."),
        *[Rule(f"{m}-ABSOLUTE", "block", t, markets=(m,), message="Promises certainty: {terms}.", fix="State the term that holds.") for m, t in ABSOLUTE.items()],
    ]
    return rules + ([Rule("TOV-CUSTOM", "warn", custom, 8, message="Banned words: {terms}.")] if custom else [])


def term_pattern(terms) -> str:
    """One pattern for a rule's terms: longest first, * for a word's rest, no letter or # right before, none after."""
    parts = sorted((re.escape(t.lower()).replace(r"\*", r"[\w-]*") for t in terms), key=len, reverse=True)
    return r"(?i)(?<![\w#])(" + "|".join(parts) + r")(?!\w)"


def split_batch(batches: DataFrame, limit: int | None = None) -> DataFrame:
    """(batch_id, n, text): drafts of a pasted text: parts between lines of ---, if any, else lines; blanks dropped."""
    parts = F.when(F.col("text").rlike(r"(?m)^\s*---+\s*$"), F.split("text", r"(?m)^\s*---+\s*$")).otherwise(F.split("text", "\n"))
    kept = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    rows = batches.select("batch_id", F.posexplode(kept).alias("n", "text"))
    return rows.filter(F.col("n") < limit) if limit else rows


def fields(drafts: DataFrame) -> DataFrame:
    """(draft_id, channel, market, field_no, field, text, labelled): lines by label; unlabelled lines join the field
    before where the channel lets it run on."""
    rows = drafts.select("draft_id", "channel", "market", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")).alias("line", "raw")).filter(F.trim("raw") != "")
    label = F.lower(F.regexp_extract("raw", r"^\s*([A-Za-z]+)\s*:", 1))
    kind, fallback, runs = F.lit(None).cast("string"), F.lit("body"), F.lit(None).cast("array<string>")
    for channel, names in PREFIXES.items():
        own = F.col("channel") == channel
        for name, value in names.items():
            kind = F.when(own & (label == name), value).otherwise(kind)
        fallback = F.when(own, FALLBACK[channel]).otherwise(fallback)
        runs = F.when(own, F.array(*[F.lit(x) for x in JOINED[channel]]).cast("array<string>")).otherwise(runs)
    rows = rows.withColumn("kind", kind).withColumn("fallback", fallback).withColumn("runs", runs)
    order = Window.partitionBy("draft_id").orderBy("line")
    # The field that a line would continue: the last labelled one, or the fallback once a line has used it.
    prior = F.last(F.coalesce("kind", "fallback"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("kind").isNotNull() | prior.isNull() | ~F.array_contains("runs", prior)
    text = F.when(F.col("kind").isNotNull(), F.regexp_replace("raw", r"^\s*[A-Za-z]+\s*:\s*", "")).otherwise(F.col("raw"))
    rows = rows.withColumn("field_no", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("clean", F.regexp_replace(text, r"^\s+|\s+$", ""))
    grouped = rows.groupBy("draft_id", "channel", "market", "field_no").agg(F.array_sort(F.collect_list(F.struct("line", "clean", F.coalesce("kind", "fallback").alias("field"), F.col("kind").isNotNull().alias("labelled")))).alias("ls"))
    return grouped.select("draft_id", "channel", "market", "field_no", F.get("ls", F.lit(0))["field"].alias("field"), F.array_join(F.transform("ls", lambda x: x["clean"]), "\n").alias("text"), F.get("ls", F.lit(0))["labelled"].alias("labelled"))


def sentences(drafts: DataFrame) -> DataFrame:
    """(draft_id, market, sentence_no, sentence): broken at line breaks and after .!? before white space."""
    cut = F.split(F.coalesce("text", F.lit("")), r"\n|(?<=[.!?])\s+")
    return drafts.select("draft_id", "market", F.posexplode(F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")).alias("sentence_no", "sentence"))


def _finding(rule: str, severity: str, weight: int | None = None) -> list[Column]:
    return [F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(WEIGHT[severity] if weight is None else weight).alias("weight")]


def length_findings(parsed: DataFrame) -> DataFrame:
    """(draft_id, rule, severity, weight, count): fields over their limit, hooks, missing fields and assets, unlabelled
    lines."""
    limits = F.array(*[F.struct(*_finding(r, s, w), F.lit(c).alias("c"), F.lit(f).alias("f"), F.lit(n).alias("n")) for r, c, f, n, s, w in LENGTHS])
    over = parsed.select("draft_id", "channel", "field", "text", F.inline(limits)).filter("c = channel and f = field and length(text) > n")
    over = over.groupBy("draft_id", "rule", "severity", "weight").agg(F.count("*").alias("count"))
    one = F.lit(1).cast("long").alias("count")
    hook = parsed.filter("channel = 'linkedin' and field_no = 1 and length(substring_index(text, '\n', 1)) > 150").select("draft_id", *_finding("LEN-LI-HOOK", "warn"), one)
    counts = parsed.groupBy("draft_id", "channel").agg(*[F.count_if(F.col("field") == f).alias(f) for f in ("headline", "description", "subject", "preheader")], F.count_if(~F.col("labelled")).alias("bare"))
    few = counts.filter("channel = 'rsa' and (headline < 3 or description < 2)").select("draft_id", *_finding("FMT-RSA-COUNT", "warn"), one)
    bare = counts.filter("channel = 'rsa' and bare > 0").select("draft_id", *_finding("FMT-RSA-LABEL", "warn", 5), F.col("bare").alias("count"))
    subject = counts.filter("channel = 'email' and subject = 0").select("draft_id", *_finding("FMT-EMAIL-SUBJ", "warn"), one)
    pre = counts.filter("channel = 'email' and preheader = 0").select("draft_id", *_finding("FMT-EMAIL-PRE", "info"), one)
    bang = parsed.filter("channel = 'rsa' and field = 'headline' and contains(text, '!')").groupBy("draft_id").agg(F.count("*").alias("count")).select("draft_id", *_finding("FMT-RSA-EXCLAIM", "block"), "count")
    return reduce(DataFrame.unionByName, [over, hook, few, bare, subject, pre, bang])


def phrase_hits(drafts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(draft_id, rule, start, stop, term): every place (characters from 0) where a rule's term stands, in its market and
    channel, unless the rule lets it off. The text is cut at the hits, so that each keeps its place."""
    out = []
    for r in rules:
        pattern = term_pattern(r.terms)
        rows = drafts.select("draft_id", "market", "channel", F.coalesce("text", F.lit("")).alias("text"))
        for chosen, col in ((r.markets, "market"), (r.channels, "channel")):
            if chosen:
                rows = rows.filter(F.col(col).isin(*chosen))
        rows = rows.filter(F.col("text").rlike(pattern))
        if r.unless and r.unless_scope == "text":
            rows = rows.filter(~F.col("text").rlike("(?i)" + r.unless))
        lengths = lambda c: F.transform(c, lambda x: F.length(x))
        hits, gaps = F.regexp_extract_all("text", F.lit(pattern), 1), F.split("text", pattern)
        # A draft's hits and the stretches before them, in order: their lengths add up to the places.
        kept = "text" if r.unless_scope == "sentence" and r.unless else F.lit(None).cast("string").alias("text")
        rows = rows.select("draft_id", kept, F.transform(hits, lambda x: F.lower(x)).alias("term"), lengths(gaps).alias("gap"), lengths(hits).alias("size"))
        rows = rows.select("draft_id", "text", F.posexplode(F.arrays_zip("term", F.slice("gap", 1, F.size("term")).alias("gap"), "size")).alias("i", "x"))
        so_far = Window.partitionBy("draft_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("stop", F.sum(F.col("x.gap") + F.col("x.size")).over(so_far).cast("int"))
        rows = rows.select("draft_id", "text", (F.col("stop") - F.col("x.size")).alias("start"), "stop", F.col("x.term").alias("term"))
        if r.unless and r.unless_scope == "sentence":
            before = F.regexp_extract(F.substring(F.col("text"), F.lit(1), F.col("start")), r"(?s)((?:(?![.!?]\s|\n).)*)$", 1)
            after = F.regexp_extract(F.expr("substring(text, start + 1)"), r"(?s)^((?:(?![.!?]\s|\n).)*)", 1)
            rows = rows.filter(~F.concat(before, after).rlike("(?i)" + r.unless))
        out.append(rows.select("draft_id", F.lit(r.rule).alias("rule"), "start", "stop", "term"))
    return reduce(DataFrame.unionByName, out)


def phrase_findings(drafts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(draft_id, rule, severity, weight, count, terms, first_start) from phrase_hits: terms in lower case, distinct, in
    order of first use."""
    kinds = drafts.sparkSession.createDataFrame(
        [(r.rule, r.severity, WEIGHT[r.severity] if r.weight is None else r.weight) for r in rules], "rule string, severity string, weight int"
    )
    found = phrase_hits(drafts, rules).groupBy("draft_id", "rule").agg(
        F.count("*").alias("count"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "term"))), lambda x: x["term"])).alias("terms"), F.min("start").alias("first_start")
    )
    return found.join(F.broadcast(kinds), "rule").select("draft_id", "rule", "severity", "weight", "count", "terms", "first_start")  # one row a rule


def with_messages(findings: DataFrame, rules: list[Rule]) -> DataFrame:
    """findings with message and fix: the rule's templates, with {terms} and {n} filled in; null for other rules."""
    spark = findings.sparkSession
    texts = spark.createDataFrame([(r.rule, r.message, r.fix) for r in rules], "rule string, message string, fix string")
    said = lambda c: F.replace(F.replace(F.col(c), F.lit("{terms}"), F.array_join("terms", ", ")), F.lit("{n}"), F.col("count").cast("string"))
    return findings.join(F.broadcast(texts), "rule", "left").withColumns({"message": said("message"), "fix": said("fix")})  # one row a rule


def syllables(words: Column) -> Column:
    """Syllables of all words of an array, by rules for spelling; they are counted in one string, not word by word."""
    said = F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-z ]+", "")
    # Up to three letters count one, as "a" does. Of longer words some endings and a first y are dropped.
    short = F.regexp_replace(said, "(?<![a-z])[a-z]{1,3}(?![a-z])", "a")
    bare = F.regexp_replace(short, "y(?<![a-z]y)|(?:[bcdfghjkmnpqrstvwxz]es|ed|[bcdfghjkmnpqrstvwxz]e)(?![a-z])", "")
    voiced = F.regexp_count(bare, F.lit("[a-z]*?[aeiouy][a-z]*"))
    return F.regexp_count(bare, F.lit("[aeiouy]{1,2}")) + F.regexp_count(said, F.lit("[a-z]+")) - voiced  # a word has one at least


def draft_stats(drafts: DataFrame) -> DataFrame:
    """(draft_id, words, sentences, flesch, we, you, bangs, caps, emoji, passive, long_sentences)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.filter(F.split(text, r"\n|(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    base = drafts.select("draft_id", text.alias("text"), words.alias("w"), cut.alias("s"))
    n, m = F.size("w"), F.size("s")
    syl = syllables(F.col("w"))
    flesch = F.when((n > 0) & (m > 0), 206.835 - 1.015 * n / m - 84.6 * syl / n)
    pronoun = lambda *p: F.size(F.filter("w", lambda w: F.lower(w).isin(*p)))
    return base.select(
        "draft_id", n.alias("words"), m.alias("sentences"), F.round(flesch, 4).alias("flesch"),
        pronoun("we", "our", "us", "ours").alias("we"), pronoun("you", "your", "yours").alias("you"),
        F.regexp_count("text", F.lit("!")).alias("bangs"), F.size(F.filter("w", lambda w: w.rlike("^[A-Z]{3,}$"))).alias("caps"),
        F.regexp_count("text", F.lit(EMOJI)).alias("emoji"), F.regexp_count("text", F.lit(PASSIVE)).alias("passive"),
        F.size(F.filter("s", lambda s: F.regexp_count(s, F.lit(WORD)) > 25)).alias("long_sentences"),
    )


def tone_findings(stats: DataFrame, min_words: int = 30) -> DataFrame:
    """(draft_id, rule, severity, weight, count): exclamation marks, capitals, emoji, long sentences, passive voice,
    readability, and we over you."""
    rules = [
        (F.col("bangs") > 1, "TOV-EXCLAIM", "warn", 6, F.col("bangs") - 1), (F.col("caps") > 0, "TOV-CAPS", "warn", 6, F.col("caps")),
        (F.col("emoji") > 0, "TOV-EMOJI", "warn", 6, F.col("emoji")), (F.col("long_sentences") > 0, "TOV-LONG-SENT", "warn", 6, F.col("long_sentences")),
        (F.col("passive") > 0, "TOV-PASSIVE", "info", 0, F.col("passive")), ((F.col("words") >= min_words) & (F.col("flesch") < 50), "TOV-READABILITY", "warn", 8, F.lit(1)),
        ((F.col("we") + F.col("you") >= 3) & (F.col("we") > F.col("you")), "TOV-PERSON", "warn", 6, F.lit(1)),
    ]
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(w).alias("weight"), n.cast("long").alias("count"))) for c, r, s, w, n in rules]))
    return stats.select("draft_id", F.inline(rows))


def claim_tokens(text: Column) -> Column:
    """Distinct stems of the words that carry a claim."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1), lambda w: ~w.rlike(r"^\d"))
    stem = lambda w: F.when((F.length(w) > 4) & w.endswith("ies"), F.regexp_replace(w, "ies$", "y")).when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)
    bare = F.transform(words, lambda w: F.regexp_replace(w, "['’]s$", ""))
    return F.array_distinct(F.filter(F.transform(bare, stem), lambda w: ~w.isin(*STOP_WORDS, *BRAND_WORDS)))


def claim_numbers(sentence_rows: DataFrame) -> DataFrame:
    """(draft_id, market, sentence_no, clause, value): numbers that make a claim: marked (currency, %, x, k, m, +), or
    in front of a claim noun by three words; years and numbered standards do not count. clause: between commas, ; : and
    dashes, and around 'and' or 'but'."""
    clauses = F.split("sentence", r"[,;:](?!\d)|\s(?:and|but)\s|\s[–—-]\s")
    rows = sentence_rows.select("draft_id", "market", "sentence_no", F.explode(clauses).alias("clause"))
    spots = F.regexp_extract_all("clause", F.lit(r"(\S*\s?(?<![A-Za-z#/:\d.,])" + NUMBER + r"(?![/:\w])(?:\s+\S+){0,3})"), 1)
    rows = rows.select("*", F.explode(spots).alias("spot"))
    part = lambda k: F.regexp_extract("spot", NUMBER, k)
    raw = part(2)
    number = F.when(raw.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.regexp_replace(raw, "[.,]", "")).otherwise(F.replace(raw, F.lit(","), F.lit("."))).try_cast("double")
    scale = F.when(F.trim(part(3)) == "k", 1e3).when(F.trim(part(3)) == "m", 1e6).otherwise(1.0)
    marked = (part(1) != "") | (part(3) != "") | (part(4) != "")
    noun = F.exists(F.slice(F.regexp_extract_all(F.regexp_replace("spot", r"^.*?\d[\d.,]*", ""), F.lit(f"({WORD})"), 1), 1, 3), lambda w: w.rlike(CLAIM_NOUN))
    standard = F.col("spot").rlike(r"(?i)^(no\.?|nr\.?|number|iso|iec|level)\s?\d")
    year = raw.rlike(r"^(19|20)\d\d$") & ~marked
    return rows.filter((marked | noun) & ~standard & ~year).select("draft_id", "market", "sentence_no", "clause", (number * scale).alias("value"))


def register_match(claims: DataFrame, register: DataFrame) -> DataFrame:
    """claims with the best register row, if any, and the outcome: ok, unsubstantiated, retired, wrong market, altered
    or qualifier dropped.

    register: reg_no, id, claim, numbers, qualifier, markets, retired. It is broadcast (a few rows, a policy document);
    a row fits with two shared stems and 0.4 of its own, or with the number and one stem; ties go to the first row.
    """
    reg = F.broadcast(register.withColumn("rt", claim_tokens(F.col("claim"))))
    key = ["draft_id", "market", "sentence_no", "clause", "value"]
    shared = F.size(F.array_intersect("ct", "rt"))
    rows = claims.dropDuplicates(key).withColumn("ct", claim_tokens(F.col("clause"))).join(reg).withColumn("shared", shared).withColumn("share", shared / F.greatest(F.size("rt"), F.lit(1))).withColumn("hit", F.array_contains("numbers", F.col("value")))
    fits = ((F.col("shared") >= 2) & (F.col("share") >= 0.4)) | (F.col("hit") & (F.col("shared") >= 1))
    score = F.col("shared") + F.col("share") + F.when(F.col("hit"), 2).otherwise(0)
    best = rows.groupBy(*key).agg(F.max(F.when(fits, F.struct(score.alias("score"), (-F.col("reg_no")).alias("n"), "id", "hit", "qualifier", "markets", "retired"))).alias("b"))
    b = F.col("b")
    outcome = (
        F.when(b.isNull(), "unsubstantiated")
        .when(b["retired"].isNotNull(), "retired")
        .when(~b["hit"], "altered")
        .when(~F.array_contains(b["markets"], F.col("market")), "wrong market")
        .when(b["qualifier"].isNotNull() & ~F.contains(F.lower("clause"), b["qualifier"]), "qualifier dropped")
        .otherwise("ok")
    )
    return best.select(*key, b["id"].alias("evidence"), outcome.alias("outcome"))


def best_entry(rows: DataFrame, register: DataFrame, sentence: str, numbers: Column) -> DataFrame:
    """rows with the best register row's id, share of its stems, numbers_fit, markets, retired and competitor, for a
    sentence and the numbers in it; null where none fits. As in register_match, but by sentence."""
    reg = F.broadcast(register.withColumn("rt", claim_tokens(F.col("claim"))))  # a policy document: a few rows
    key = rows.columns
    shared = F.size(F.array_intersect("ct", "rt"))
    both = rows.withColumn("ct", claim_tokens(F.col(sentence))).withColumn("found_numbers", numbers).join(reg)
    both = both.withColumn("shared", shared).withColumn("ratio", shared / F.greatest(F.size("rt"), F.lit(1)))
    both = both.withColumn("numbers_fit", (F.size("found_numbers") > 0) & (F.size(F.array_except("found_numbers", "numbers")) == 0))
    fits = ((F.col("shared") >= 2) & (F.col("ratio") >= 0.4)) | (F.col("numbers_fit") & (F.col("shared") >= 1))
    score = F.col("shared") + F.col("ratio") + F.when(F.col("numbers_fit"), 2).otherwise(0)
    found = F.struct(score.alias("score"), (-F.col("reg_no")).alias("n"), "id", F.col("ratio").alias("share"), "numbers_fit", F.col("markets").alias("ok_markets"), "retired", "competitor", F.col("numbers").alias("own_numbers"))
    return both.groupBy(*key).agg(F.max(F.when(fits, found)).alias("e")).select(*key, "e.id", "e.share", "e.numbers_fit", "e.ok_markets", "e.retired", "e.competitor", "e.own_numbers")


def sentence_numbers(sentence: Column) -> Column:
    return F.transform(F.regexp_extract_all(sentence, F.lit(r"(?<![\w.,])(\d+(?:[.,]\d{3})*(?:\.\d+)?)"), 1), lambda n: F.regexp_replace(n, ",", "").cast("double"))


def superlative_findings(sentence_rows: DataFrame, register: DataFrame) -> DataFrame:
    """(draft_id, rule, severity, weight, count, evidence): sentences with a superlative, unless the register holds 0.6 of
    such a claim, in force and for the market."""
    hits = F.size(F.regexp_extract_all("sentence", F.lit(term_pattern(SUPERLATIVES)), 1))
    rows = sentence_rows.withColumn("hits", hits).filter("hits > 0")
    matched = best_entry(rows, register, "sentence", F.array().cast("array<double>"))
    backed = F.coalesce((F.col("share") >= 0.6) & F.col("retired").isNull() & F.array_contains("ok_markets", F.col("market")), F.lit(False))
    none = F.lit(None).cast("string").alias("evidence")
    return matched.filter(~backed).groupBy("draft_id").agg(F.sum("hits").alias("count")).select("draft_id", *_finding("CLM-SUPERLATIVE", "block"), "count", none)


def certificate_findings(drafts: DataFrame, certificates: dict[str, str | None]) -> DataFrame:
    """(draft_id, rule, severity, weight, count, evidence): certificates that a text names: backed ones tell their evidence,
    others block."""
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(term_pattern(certificates)), 1), lambda t: F.lower(t))
    rows = drafts.select("draft_id", F.explode(found).alias("term"))
    evidence = F.lit(None).cast("string")
    for term, ev in certificates.items():
        evidence = F.when(F.col("term") == term.lower(), F.lit(ev).cast("string")).otherwise(evidence)
    rows = rows.withColumn("evidence", evidence).groupBy("draft_id", "evidence").agg(F.count("*").alias("count"))
    bare = F.col("evidence").isNull()
    return rows.select("draft_id", F.when(bare, "SEC-CERT").otherwise("CLM-OK").alias("rule"), F.when(bare, "block").otherwise("info").alias("severity"), F.when(bare, WEIGHT["block"]).otherwise(WEIGHT["info"]).alias("weight"), "count", "evidence")


def competitor_findings(sentence_rows: DataFrame, competitors: list[str], register: DataFrame | None = None) -> DataFrame:
    """(draft_id, rule, severity, weight, count, evidence): mentions, and sentences that compare with or disparage a
    competitor. A comparison that the register backs (0.6 of its words and, where it has numbers, these; in force, for the
    market and against this competitor) warns with its evidence instead of blocking. Counts sentences; spans.findings
    tells every mention and its place."""
    named = sentence_rows.filter(F.col("sentence").rlike(term_pattern(competitors)))
    none = F.lit(None).cast("string").alias("evidence")

    def counted(rows: DataFrame, rule: str, severity: str, weight: int) -> DataFrame:
        return rows.groupBy("draft_id").agg(F.count("*").alias("count")).select("draft_id", *_finding(rule, severity, weight), "count", none)

    compared = named.filter(F.col("sentence").rlike(term_pattern(COMPARISONS)))
    parts = [counted(named, "CMP-MENTION", "warn", 15), counted(named.filter(F.col("sentence").rlike(term_pattern(DISPARAGING))), "CMP-DISPARAGE", "block", 40)]
    if register is None:
        return reduce(DataFrame.unionByName, [*parts, counted(compared, "CMP-COMPARE", "block", 40)])
    matched = best_entry(compared, register, "sentence", sentence_numbers(F.col("sentence")))
    against = F.contains(F.lower("sentence"), F.lower(F.coalesce("competitor", F.lit("\x00"))))
    strong = (F.col("share") >= 0.6) & ((F.size("own_numbers") == 0) | F.col("numbers_fit"))
    backed = F.coalesce(against & strong & F.col("retired").isNull() & F.array_contains("ok_markets", F.col("market")), F.lit(False))
    judged = matched.withColumn("backed", backed)
    signed = judged.filter("backed").groupBy("draft_id", F.col("id").alias("evidence")).agg(F.count("*").alias("count"))
    signed = signed.select("draft_id", *_finding("CMP-COMPARE", "warn", WEIGHT["warn"]), "count", "evidence")
    return reduce(DataFrame.unionByName, [*parts, counted(judged.filter("not backed"), "CMP-COMPARE", "block", 40), signed])


def verdicts(drafts: DataFrame, findings: DataFrame, threshold: int = 20) -> DataFrame:
    """(draft_id, score, verdict, reason, hash): score sums weight times count, three at most; any block blocks. reason:
    the heaviest block and how many more, or the two heaviest warnings."""
    held = F.when(F.col("severity") != "info", F.struct(F.when(F.col("severity") == "block", 0).otherwise(1).alias("o"), (-F.col("weight")).alias("w"), "rule"))
    sums = findings.groupBy("draft_id").agg(
        F.least(F.lit(100), F.sum(F.col("weight") * F.least("count", F.lit(3)))).alias("score"), F.count_if(F.col("severity") == "block").alias("blocks"),
        F.array_sort(F.collect_list(held)).alias("held"),
    )
    rows = drafts.select("draft_id", F.coalesce("text", F.lit("")).alias("text")).join(sums, "draft_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    blocks = F.coalesce("blocks", F.lit(0))
    verdict = F.when(F.trim("text") == "", "empty").when(blocks > 0, "block").when(F.col("score") >= threshold, "review").otherwise("approve")
    first = F.get("held", F.lit(0))["rule"]
    more = F.when(blocks > 1, F.concat(first, F.lit(" and "), (blocks - 1).cast("string"), F.lit(" more"))).otherwise(first)
    reason = F.when(verdict == "block", more).when(verdict == "review", F.array_join(F.transform(F.slice("held", 1, 2), lambda x: x["rule"]), ", "))
    return rows.select("draft_id", "score", verdict.alias("verdict"), reason.alias("reason"), fnv1a(F.col("text")).alias("hash"))


def ledger_rows(drafts: DataFrame, verdict_rows: DataFrame, findings: DataFrame, threshold: int = 20) -> DataFrame:
    """(draft_id, draft_hash, channel, market, decision, risk_score, threshold, findings): what the gate keeps of a decision;
    findings as rule:severity in their order."""
    listed = ordered(findings).groupBy("draft_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "rule", "severity"))), lambda x: F.concat(x["rule"], F.lit(":"), x["severity"])).alias("findings")
    )
    rows = drafts.select("draft_id", "channel", "market").join(verdict_rows, "draft_id").join(listed, "draft_id", "left")
    return rows.select(
        "draft_id", F.concat(F.lit("fnv1a:"), "hash").alias("draft_hash"), "channel", "market", F.col("verdict").alias("decision"), F.col("score").alias("risk_score"),
        F.lit(threshold).alias("threshold"), F.coalesce("findings", F.array().cast("array<string>")).alias("findings"),
    )


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as eight hexadecimal digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))

    def step(acc: Column, unit: Column) -> Column:
        return (acc.bitwiseXOR(unit) * 16777619).bitwiseAND(F.lit(4294967295))

    def add(acc: Column, c: Column) -> Column:
        pair = step(step(acc, F.shiftright(c, 16)), c.bitwiseAND(F.lit(65535)))
        return F.when(c > 65535, pair).otherwise(step(acc, c))

    h = F.aggregate(codes, F.lit(2166136261).cast("long"), add)
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def ordered(findings: DataFrame) -> DataFrame:
    """findings with n: their order within a draft, by severity, then rule."""
    rank = F.when(F.col("severity") == "block", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return findings.withColumn("n", F.row_number().over(Window.partitionBy("draft_id").orderBy(rank, "rule")))


def tally(verdict_rows: DataFrame) -> DataFrame:
    return verdict_rows.groupBy("verdict").agg(F.count("*").alias("drafts"))


def segments(spans: DataFrame) -> DataFrame:
    """(draft_id, start, stop, rules) from overlapping spans (draft_id, rule, start, stop): disjoint stretches with the
    rules that cover each, equal neighbours merged."""
    edges = spans.select("draft_id", F.explode(F.array("start", "stop")).alias("start")).distinct()
    parts = edges.withColumn("stop", F.lead("start").over(Window.partitionBy("draft_id").orderBy("start"))).filter("stop is not null")
    s = spans.select("draft_id", "rule", F.col("start").alias("a"), F.col("stop").alias("b"))
    covered = parts.join(s, "draft_id").filter("a <= start and b >= stop").groupBy("draft_id", "start", "stop").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    w = Window.partitionBy("draft_id").orderBy("start")
    new = (F.lag("stop").over(w) != F.col("start")) | (F.lag("rules").over(w) != F.col("rules"))
    runs = covered.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    return runs.groupBy("draft_id", "run", "rules").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")
