"""The copy gate's steps on drafts that come in one partition."""

import re

from pyspark.sql import functions as F

from millrace.operators import copygate as c
from millrace.operators import spans
from millrace.queries import copygate as q


def test_sentences_take_no_rules_and_all_tasks(spark, sf_dir, monkeypatch):
    def scan(*_):
        raise AssertionError("sentences need no scan for rules")

    monkeypatch.setattr(spans, "scanned", scan)
    found = q.c_sentence_spans(spark, sf_dir)
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1  # texts are dealt once, by draft
    rows = spark.range(0, 400, 1, 1).selectExpr("id as draft_id", "'meta' as channel", "'UK' as market", "'One. Two.' as text")
    sizes = spans.masked(rows).select("draft_id").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 400 and max(sizes) < 200


def test_syllables_of_a_text_are_those_of_its_words(spark):
    def one(word):
        x = re.sub("[^a-z]", "", word.lower())
        bare = re.sub("^y", "", re.sub("(?:[^laeiouy]es|ed|[^laeiouy]e)$", "", x))
        return 0 if x == "" else 1 if len(x) <= 3 else max(1, len(re.findall("[aeiouy]{1,2}", bare)))

    words = "yces yyes Hmmm needed tables syllable They're café 2024 x9 été yellow eyes used use Straße queue ÀÖÿ rhythm beyed ye yyyyy aces a'b'c'e É-e whales".split()
    made = ["".join(x) for x in __import__("itertools").product("abeldsy", repeat=4)]
    rows = [(i, made[i : i + 60] + words[i % len(words) :]) for i in range(0, len(made), 60)] + [(-1, []), (-2, ["É", "12"])]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    got = {r.k: r.n for r in df.select("k", c.syllables(F.col("w")).alias("n")).collect()}
    assert got == {k: sum(map(one, w)) for k, w in rows}
    plan = df.select(c.syllables(F.col("w")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_hits_carry_no_parameters_to_be_parsed(spark, monkeypatch):
    from millrace.operators import ruleset

    seen, write = {}, spans.materialise
    monkeypatch.setattr(spans, "materialise", lambda df, name="table": seen.setdefault(name, write(df, name)))
    rows = spark.createDataFrame([(1, "linkedin", "DE", "Kostenlos!! Free.")], "draft_id long, channel string, market string, text string")
    spans.findings(rows, ruleset.house(spark))
    hits = {(r.rule, r.scope, r.most) for r in seen["draft-hits"].collect()}
    assert "params" not in seen["draft-hits"].columns and {("DE-FREE", "sentence", None), ("TOV-EXCLAIM", None, 1)} <= hits


def test_what_is_written_of_a_draft_grows_with_its_text(spark, monkeypatch):
    from millrace.operators import ruleset

    seen, write = {}, spans.materialise
    monkeypatch.setattr(spans, "materialise", lambda df, name="table": seen.setdefault(name, write(df, name)))
    text = "It is the best, act now and win. " * 300  # terms everywhere
    rows = spark.createDataFrame([(k, "linkedin", "US", text) for k in range(4)], "draft_id long, channel string, market string, text string")
    found = spans.findings(rows, ruleset.house(spark))
    size = lambda name: sum(len(r.j) for r in seen[name].selectExpr("to_json(struct(*)) j").collect())
    assert size("draft-scan") < 4 * 4 * len(text)  # texts once, not again at every place
    assert not any(c in f.name for f in seen["draft-fields"].schema for c in ("text", "lines"))
    assert {"draft-sentences"}.isdisjoint(seen)
    assert {(r.rule, r["count"]) for r in found.filter("draft_id = 0").collect()} >= {("TOV-PUSHY", 300)}


def test_numbers_find_their_sentence_without_meeting_all_others(spark):
    outer = spark.range(5000).selectExpr("id % 2 draft_id", "cast(id as int) sentence_no", "id * 10 start", "id * 10 + 8 stop", "'s' sentence")
    inner = spark.range(5000).selectExpr("id % 2 draft_id", "id * 10 + id % 9 start", "id * 10 + id % 9 + 2 stop")
    got = {whole: {(r.draft_id, r.start, r.sentence_no) for r in spans._in(inner, outer, whole).collect()} for whole in (True, False)}
    rows = [(k % 2, k * 10 + k % 9, k) for k in range(5000)]
    assert got[False] == {r for r in rows if r[2] % 9 < 8} and got[True] == {r for r in rows if r[2] % 9 <= 6}
    plan = spans._in(inner, outer, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_drafts_are_not_gone_through_once_a_part_of_the_rules(spark):
    from millrace.operators import ruleset

    rows = spark.createDataFrame([(1, "linkedin", "DE", "Kostenlos!! Free.")], "draft_id long, channel string, market string, text string")
    plan = spans.findings(rows, ruleset.house(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def hits_of(spark, text, terms, pattern=None):
    from millrace.operators import ruleset

    rules = [(1, "OWN", "block", 7, "phrase", None, None, "{}", "", "")]
    if pattern:
        rules.append((2, "PATTERN", "info", None, "regex", None, None, '{"pattern": "%s"}' % pattern, "", ""))
    own = ruleset.Ruleset.of(spark.createDataFrame(rules, ruleset.RULE_SCHEMA), spark.createDataFrame([("OWN", t, None) for t in terms], ruleset.TERM_SCHEMA), ruleset.house(spark).register)
    scan, matchers = spans.scanned(spark.createDataFrame([(1, "meta", "UK", text)], "draft_id long, channel string, market string, text string"), own)
    got = spans.hit_spans(scan, matchers, own.rules).select("rule_no", "start", "stop", "term", "s.s0", "s.s1").collect()
    units = text.encode("utf-16-le")
    assert all(units[2 * r.start : 2 * r.stop].decode("utf-16-le") == r.term and (r.s0 is None or r.s0 <= r.start < r.s1) for r in got)
    return sorted((r.rule_no, r.term) for r in got)


def test_terms_of_any_beginning_are_found(spark):
    text = "x marks Usable \U0001f600 things.\n.com x2 a.com zz. \u017fcam, aab! No. 1 is #x"
    assert hits_of(spark, text, ("x", "*able", ".com", "scam", "aa*", "no. 1"), "z*") == sorted([(1, "x"), (1, "Usable"), (1, ".com"), (1, "\u017fcam"), (1, "aab"), (1, "No. 1"), (2, "zz")])
    assert hits_of(spark, text, ("x", "scam", "aa*", "no. 1", "aab")) == sorted([(1, "x"), (1, "\u017fcam"), (1, "aab"), (1, "No. 1")])
    assert hits_of(spark, text.replace("\u017f", "s"), ("x", "scam", "aa*", "no. 1", "üb*")) == sorted([(1, "x"), (1, "scam"), (1, "aab"), (1, "No. 1")])


def test_speech_counts_as_the_words_do(spark):
    made = ["".join(x) for x in __import__("itertools").product("abedsy", repeat=4)]
    odd = "yces Hmmm They're café we-all 2024 x9 été Straße ÀÖÿ rhythm a'b'c'e É-e We our US you’ll 'your' we’re ours: us"
    rows = [(i, " ".join(made[i : i + 99])) for i in range(0, len(made), 99)] + [(-1, odd), (-2, ""), (-3, "—")]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("w", F.regexp_extract_all("t", F.lit(f"({c.WORD})"), 1))
    got = df.select("k", spans._speech(F.col("t")).alias("s"), F.size("w").alias("n"), c.syllables(F.col("w")).alias("syl")).collect()
    assert all((r.s.words, r.s.syllables) == (r.n, r.syl) for r in got)
    assert {r.k: (r.s.we, r.s.you) for r in got if r.k < 0} == {-1: (6, 1), -2: (0, 0), -3: (0, 0)}  # your' is another word


def test_words_after_an_edge_are_looked_for_by_their_first_letters():
    assert spans.pattern_regex(c.PASSIVE).startswith("(?i)(?=[ABGIWabgiw])(?<![A-Za-z0-9_])(?:is|")
    assert spans.pattern_regex(r"\bx?y\b") == spans.EDGE + "x?y" + spans.EDGE
