"""The copy gate over span tables: fields, sentences, clauses, numbers and hits keep their places in the text.

Drafts are read once, whatever the number of rules: one pass cuts a text at its lines, sentences and numbers and writes the
pieces with their places. Where some rule's term can begin is found in these, without a shuffle, and only hits leave
that step. Places are UTF-16 units from 0, as in a browser's strings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import copygate as c
from millrace.operators.ruleset import Ruleset
from millrace.plans.storage import materialise

MOST_RULES = 100_000  # rows of a policy's tables: they become one pattern when the plan is made
REACH = 256  # characters from its beginning in which a term must end
BLANK = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"  # BLANK's
SENTENCE = rf"(?:[^\n.!?]++|[.!?](?!{BLANK}))*+(?:\n|[.!?]|\z)"  # up to a line break, or .!? before white space
UNIT = r"(?:[\w#]++[^\w#]?+|[^\w#])"  # terms begin where one of these does, nowhere else
BREAK = rf"(?<=\n)|(?={BLANK})(?<=[.!?])"
BLOCK = 64  # pieces whose places are summed at a time
EDGE = r"(?:(?=[A-Za-z0-9_])(?<![A-Za-z0-9_])|(?![A-Za-z0-9_])(?<=[A-Za-z0-9_]))"  # ahead first: looking back costs more
CLAUSE_ENDS = r"(,|;|:| and | but | - | – | — )"
NUMBER = r"([€£$]" + BLANK + r"?)?([0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]+(?:[.,][0-9]+)?)(" + BLANK + r"?%|" + BLANK + r"?[xX](?![a-zA-Z])|[kKmM](?![a-zA-Z]))?(\+)?"
YOU = {"you", "your", "yours", "you're", "you’re", "you'll", "you’ll"}
WE = {"we", "our", "ours", "us", "we're", "we’re", "we'll", "we’ll"}
WORDS_FIRST = r"(\(\?i\))?\\b(\(\?:((?:[A-Za-z]{2,}\??\|)*[A-Za-z]{2,}\??)\).*)"  # a pattern that begins with one of some words
SPAN = "struct<start:long,stop:long>"


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    wide = F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]")))
    return (F.length(text) + wide).cast("long")


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _lead(text: Column) -> Column:
    """White space in front: of one unit each."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(BLANKS)))


def _trail(text: Column) -> Column:
    return F.length(text) - F.length(F.rtrim(text, F.lit(BLANKS)))


def _before(sizes: str) -> Column:
    """For each element of an array column the sum of those before it, block by block: appending copies what it appends to."""
    count = F.greatest(F.size(sizes) - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(count / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))
    long = lambda x: x.cast("long")
    within = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast("array<long>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    total = lambda b: F.aggregate(b, long(F.lit(0)), lambda a, x: a + x)
    none = F.struct(long(F.lit(0)).alias("at"), F.array().cast("array<array<long>>").alias("out"))
    return F.aggregate(blocks, none, lambda a, b: F.struct((a["at"] + total(b)).alias("at"), F.array_append(a["out"], within(b, a["at"])).alias("out")), lambda a: F.flatten(a["out"]))


@lru_cache(maxsize=2**17)
def _word(word: str) -> int:
    """A word's syllables as copygate.syllables has them, plus 2**32 where it is ours and 2**64 where it is the reader's."""
    low = word.lower()
    letters = re.sub("[^a-z]", "", low)
    bare = re.sub("^y", "", re.sub("(?:[^laeiouy]es|ed|[^laeiouy]e)$", "", letters))
    count = 0 if not letters else 1 if len(letters) <= 3 else max(1, len(re.findall("[aeiouy]{1,2}", bare)))
    return count + ((low in WE) << 32) + ((low in YOU) << 64)


def _speech(text: Column) -> Column:
    """words, syllables, we, you of a text. Words recur, so that each is looked at about once a task."""

    @F.pandas_udf("words long, syllables int, we int, you int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        word = re.compile(c.WORD)
        for batch in texts:
            found = [word.findall(t) for t in batch]
            sums = [sum(map(_word, w)) for w in found]
            yield pd.DataFrame({"words": [len(w) for w in found], "syllables": [x & 0xFFFFFFFF for x in sums], "we": [x >> 32 & 0xFFFFFFFF for x in sums], "you": [x >> 64 for x in sums]})

    return count(text)


def pattern_regex(pattern: str) -> str:
    """\\b between ASCII letters, digits, _ and others; where words follow it at the beginning, their first letters are
    looked for first."""
    front = re.fullmatch(WORDS_FIRST, pattern, re.S)
    if front:
        letters = {w[0] for w in front[3].split("|")}
        letters |= {x for w in letters for x in (w.lower(), w.upper())} if front[1] else set()
        pattern = f"{front[1] or ''}(?=[{''.join(sorted(letters))}])(?<![A-Za-z0-9_]){front[2]}"
    return pattern.replace(r"\b", EDGE)


def term_regex(term: str) -> str:
    """* stands for a word's rest, s? and a last ? for what may be missing."""
    word = re.escape(term.lower()).replace(r"\*", r"[\w-]*").replace(r"s\?", "s?")
    return word[:-2] + "?" if word.endswith(r"\?") else word


def _head(term: str) -> str:
    """What every spelling of a term begins with, in lower case."""
    return re.split(r"\*|s\?|.\?$", term.lower(), flags=re.S)[0]


def _policy(rules: Ruleset) -> tuple[DataFrame, list[tuple[str, str]], list[str] | None]:
    """(key, head, rule_no, pattern, size): terms by their first letters, and patterns of their own (key kind:n); the
    rules that a whole text can let off, with the pattern for that; the channels whose fields rules of a pattern read."""
    spark = rules.rules.sparkSession
    known = rules.rules.selectExpr(
        "rule_no", "rule", "type", "channels", "try_variant_get(params, '$.unless', 'string') unless", "try_variant_get(params, '$.unlessScope', 'string') scope", "try_variant_get(params, '$.minLen', 'int') least", "try_variant_get(params, '$.pattern', 'string') pattern"
    ).limit(MOST_RULES + 1).collect()
    terms = rules.terms.filter("term is not null and trim(term) <> ''").limit(MOST_RULES + 1).collect()
    if max(len(known), len(terms)) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rows of rules or terms")
    by_rule: dict[str, list[str]] = {}
    for t in terms:
        by_rule.setdefault(t["rule"], []).append(t["term"])
    own: list[tuple[str, str, int, str, int]] = []
    for r in known:
        kind = f"kind:{r['rule_no']}"
        if r["type"] in ("phrase", "superlative", "competitor", "comparative", "disparage", "cert"):
            for w in by_rule.get(r["rule"], []):
                own.append((_head(w)[:2], re.match(r"[\x00-\x7f]*", _head(w))[0], r["rule_no"], term_regex(w), len(term_regex(w))))
        elif r["type"] == "exclaim":
            own.append((kind, "", r["rule_no"], "!", 1))
        elif r["type"] == "caps":
            own.append((kind, "", r["rule_no"], "(?=[A-ZÄÖÜ])" + EDGE + "[A-ZÄÖÜ]{%d,}" % (r["least"] or 3) + EDGE, 1))
        elif r["type"] == "regex" and r["pattern"]:
            own.append((kind, "", r["rule_no"], pattern_regex(r["pattern"]), 1))
    off = [(r["rule"], r["unless"]) for r in known if r["unless"] and r["scope"] == "text"]
    read = [r["channels"] for r in known if r["type"] == "field-regex"]
    channels = None if any(x is None for x in read) else sorted({ch for x in read for ch in x})
    return spark.createDataFrame(own, "key string, head string, rule_no int, pattern string, size int"), off, channels


def _any_term(patterns: list[tuple[str, str]], flags: str) -> str:
    """One pattern for all terms (head, pattern), by their first letters, so that a place that begins none fails at once."""
    firsts: dict[str, set[str]] = {}
    for head, w in patterns:
        first = re.match(r"\\?.", w, re.S)[0] if head else ""  # terms without a beginning of their own stand alone
        firsts.setdefault(first, set()).add(w[len(first) :])
    grouped = [f"{a}(?:{'|'.join(sorted(rest, key=lambda w: (-len(w), w)))})" for a, rest in sorted(firsts.items())]
    return rf"(?{flags}:(?:" + ("|".join(grouped) or r"(?!)") + r")(?!\w))"


def _pieces(text: str, terms: list) -> Column:
    """The pieces of a text, cut where sentences end and where some term can begin. Case beyond ASCII is folded only for
    terms that need it and in texts with letters that fold to ASCII; one pattern does for all terms."""
    known = [(r["head"], r["pattern"]) for r in terms]
    exact = F.regexp_extract_all(text, F.lit(f"(?s){UNIT}(?:(?!{_any_term(known, 'iu')}|{BREAK}){UNIT})*+"), F.lit(0))
    if not terms or any(not r["head"] or r["head"][0] in BLANKS + ".!?" for r in terms):
        return exact
    letters = "".join(sorted({re.escape(x) for r in terms for x in (r["head"][0], r["head"][0].upper())}))
    plain, other = [x for x in known if x[1].isascii()], [x for x in known if not x[1].isascii()]
    begun = "|".join([_any_term(plain, "i"), *([_any_term(other, "iu")] if other else [])])
    # What ends a sentence ends a piece as it is met, which spares looking back.
    inner, end = rf"(?:[^\w#\n.!?]|[.!?](?!{BLANK}))", rf"(?:\n|[.!?](?={BLANK}))"
    unit = rf"(?:[\w#]++{inner}?+|{inner})"
    quick = rf"{unit}(?:(?!(?=[{letters}])(?:{begun})){unit})*+{end}?+|{end}"
    folded = (F.octet_length(text) > F.length(text)) & F.col(text).rlike("[ſıİ\u212a]")
    return F.when(folded, exact).otherwise(F.regexp_extract_all(text, F.lit(quick), F.lit(0)))


def masked(drafts: DataFrame) -> DataFrame:
    """(draft_id, channel, market, text, lines, masked, sentences) of every draft that has a number; masked: the text with
    blanks for its labels; sentences: its pieces, with the places of what they hold between white space. Unknown channels
    count as rsa, unknown markets as UK; null texts are empty.

    Drafts are dealt anew by their number into spark.sql.shuffle.partitions: they may come in few files, and cutting a
    text takes far longer than reading it.
    """
    prefixes = F.create_map(*[F.lit(x) for ch, names in c.PREFIXES.items() for p, f in names.items() for x in (f"{ch}|{p}", f)])
    parts = int(drafts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = drafts.select("draft_id", "channel", "market", "text").filter("draft_id is not null").repartition(parts, "draft_id").select(
        "draft_id",
        F.when(F.col("channel").isin(*c.PREFIXES), F.col("channel")).otherwise("rsa").alias("channel"),
        F.when(F.col("market").isin("UK", "DE", "US"), F.col("market")).otherwise("UK").alias("market"),
        F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n").alias("text"),
    )
    label = f"^{BLANK}*([A-Za-z]+){BLANK}*:{BLANK}*"
    labels = F.col("channel").isin(*[ch for ch, names in c.PREFIXES.items() if names]) & F.col("text").contains(":")

    def line(x: Column) -> Column:
        prefix = F.regexp_extract(x, label, 0)
        kind = F.try_element_at(prefixes, F.concat("channel", F.lit("|"), F.lower(F.regexp_extract(x, label, 1))))
        return F.struct(x.alias("text"), F.when(prefix != "", kind).alias("kind"), F.when((prefix != "") & kind.isNotNull(), F.length(prefix)).otherwise(0).alias("cut"))

    def plain(x: Column) -> Column:
        return F.struct(x.alias("text"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("cut"))

    def piece(z: Column) -> Column:
        text = z["pieces"]
        return F.struct((z["at"] + _lead(text)).alias("start"), (z["at"] + units(text) - _trail(text)).alias("stop"), text.alias("text"))

    rows = rows.withColumn("lines", F.when(labels, F.transform(F.split("text", "\n"), line)).otherwise(F.transform(F.split("text", "\n"), plain)))
    whole = F.array_join(F.transform("lines", lambda x: F.concat(F.repeat(F.lit(" "), x["cut"]), F.substring(x["text"], x["cut"] + 1, F.length(x["text"])))), "\n")
    rows = rows.withColumn("masked", F.when(labels, whole).otherwise(F.col("text")))
    rows = rows.withColumn("pieces", F.regexp_extract_all("masked", F.lit(SENTENCE), F.lit(0))).withColumn("sizes", F.transform("pieces", units))
    rows = rows.withColumn("at", _before("sizes")).withColumn("sentences", F.transform(F.arrays_zip("pieces", "at"), piece))
    return rows.select("draft_id", "channel", "market", "text", "lines", "masked", "sentences")


def scanned(drafts: DataFrame, rules: Ruleset) -> tuple[DataFrame, DataFrame]:
    """(draft_id, channel, market, lines, filled, sentences, numbers, let_off, words, syllables, we, you) of every draft, in
    one pass, written; and the matchers. Of lines, the text stays only where a rule of a pattern reads a field."""
    matchers, off, channels = _policy(rules)
    rows = masked(drafts)
    read = F.lit(True) if channels is None else F.col("channel").isin(*channels)

    def line(x: Column) -> Column:
        text = x["text"]
        return F.struct(
            x["kind"].alias("kind"), x["cut"].alias("cut"), units(text).alias("units"), F.length(text).alias("chars"), _lead(text).alias("lead"), _trail(text).alias("trail"), F.when(read, text).alias("text")
        )

    def number(gap: Column, i: Column) -> Column:
        tok = F.coalesce(F.get("toks", i), F.lit(""))
        before = F.right(F.concat(F.coalesce(F.get("toks", i - 1), F.lit("")), gap), F.lit(9))
        rest = F.left(F.array_join(F.transform(F.slice("both", i + 2, 20), lambda z: F.concat(z["gaps"], F.coalesce(z["toks"], F.lit("")))), ""), F.lit(40))
        return F.struct(units(gap).alias("gap"), units(tok).alias("units"), tok.alias("text"), before.alias("before"), rest.alias("rest"))

    none = F.array().cast("array<string>")
    let_off = F.array_compact(F.array(*[F.when(F.col("masked").rlike("(?iu)" + p), F.lit(r)) for r, p in off])) if off else none
    digits = F.col("masked").rlike("[0-9]")
    done = (
        rows.withColumn("gaps", F.when(digits, F.split("masked", NUMBER)).otherwise(none))
        .withColumn("toks", F.when(digits, F.regexp_extract_all("masked", F.lit(NUMBER), F.lit(0))).otherwise(none))
        .withColumn("both", F.arrays_zip("gaps", "toks"))
        .withColumn("speech", _speech(F.col("masked")))
        .select(
            "draft_id", "channel", "market",
            F.transform("lines", line).alias("lines"),
            F.col("text").rlike(f"[^{BLANK[1:]}").alias("filled"),
            "sentences",
            F.transform("gaps", number).alias("numbers"),
            let_off.alias("let_off"),
            "speech.*",
        )
    )
    return materialise(done, "draft-scan"), matchers


def _running(key: list[str], size: Column) -> Column:
    """The sum of the sizes before a row."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def field_spans(scan: DataFrame) -> DataFrame:
    """(draft_id, channel, field_no, field, labelled, start, stop, chars, hook, hook_stop, first, last): lines by label;
    unlabelled lines run on where the channel lets them. chars counts the text's characters, places units; hook: the
    length of the first line that holds something, hook_stop: where it ends; first and last: the field's lines."""
    rows = scan.select("draft_id", "channel", F.posexplode("lines").alias("i", "l")).select("draft_id", "channel", "i", "l.kind", "l.cut", "l.units", "l.chars", "l.lead", "l.trail")
    rows = rows.withColumn("at", _running(["draft_id"], F.col("units") + 1)).withColumn("nth", _running(["draft_id"], F.col("chars") + 1)).filter("lead < chars")
    fallback = F.create_map(*[F.lit(x) for p in c.FALLBACK.items() for x in p])
    runs = F.create_map(*[x for ch, names in c.JOINED.items() for x in (F.lit(ch), F.array(*map(F.lit, names)).cast("array<string>"))])
    rows = rows.withColumn("labelled", F.col("kind").isNotNull()).withColumn("field", F.coalesce("kind", F.element_at(fallback, F.col("channel"))))
    order = Window.partitionBy("draft_id").orderBy("i")
    prior = F.lag("field").over(order)
    new = F.col("labelled") | prior.isNull() | ~F.array_contains(F.element_at(runs, F.col("channel")), prior)
    skip = F.when(F.col("labelled"), F.col("cut")).otherwise(F.col("lead"))
    rows = rows.withColumn("field_no", F.sum(new.cast("int")).over(order)).withColumn("skip", skip).withColumn("begins", F.col("at") + skip).withColumn("ends", F.col("at") + F.col("units") - F.col("trail"))
    # A field's text runs from the first line that holds more than a label to the last one.
    held = F.when(F.col("chars") - F.col("trail") > F.col("skip"), F.col("i"))
    first = F.struct((F.col("units") - F.col("trail") - F.col("skip")).alias("len"), (F.col("units") - F.col("skip")).alias("line"))
    parts = rows.groupBy("draft_id", "channel", "field_no").agg(
        F.min_by("field", "i").alias("field"), F.min_by("labelled", "i").alias("labelled"), F.min_by("begins", "i").alias("start"),
        F.max_by(F.greatest("begins", "ends"), "i").alias("stop"), F.min("i").alias("first"), F.max("i").alias("last"),
        F.coalesce(F.max(F.when(held.isNotNull(), F.col("nth") + F.col("chars") - F.col("trail"))) - F.min(F.when(held.isNotNull(), F.col("nth") + F.col("skip"))), F.lit(0)).alias("chars"),
        F.min_by(first, held).alias("h"), (F.min(held) == F.max(held)).alias("alone"),
    )
    hook_stop = F.col("start") + F.when(F.col("alone"), F.col("h.len")).otherwise(F.col("h.line"))
    return parts.select("draft_id", "channel", "field_no", "field", "labelled", "start", "stop", "chars", F.coalesce("h.len", F.lit(0)).alias("hook"), hook_stop.alias("hook_stop"), "first", "last")


def sentence_spans(scan: DataFrame) -> DataFrame:
    """(draft_id, channel, market, sentence_no, start, stop, sentence): broken at line breaks and after .!? before white
    space. scan: what `masked` or `scanned` returns."""
    rows = scan.select("draft_id", "channel", "market", F.posexplode("sentences").alias("sentence_no", "s")).filter("s.stop > s.start")
    return rows.select("draft_id", "channel", "market", "sentence_no", "s.start", "s.stop", _strip(F.col("s.text")).alias("sentence"))


def hit_spans(scan: DataFrame, matchers: DataFrame, rules: DataFrame) -> DataFrame:
    """(draft_id, market, rule_no, start, stop, term, s): every hit of every rule in its channel and market, left to right,
    none overlapping another of its rule; of a rule's terms that begin at a place, the longest one. s: the sentence in
    which a term begins; null for rules of a pattern."""
    asks = F.expr("type in ('superlative', 'competitor') or coalesce(try_variant_get(params, '$.unlessScope', 'string'), '') = 'sentence'")
    scope = rules.select("rule_no", "channels", "markets", asks.alias("asks"))
    any_of = F.expr("(channels is null or array_contains(channels, channel)) and (markets is null or array_contains(markets, market))")
    known = matchers.collect()  # a policy table
    texts = scan.select("draft_id", "channel", "market", "sentences", F.array_join("sentences.text", "").alias("masked"))
    some = "struct<sentence_no:int,s0:long,s1:long,sentence:string>"
    # Terms: a text is cut where one can begin and where sentences do.
    of_terms = [r for r in known if not r["key"].startswith("kind:")]
    low32 = F.lit(2**31 - 1).cast("long")  # a piece's length and whether a sentence begins there, in one number to be summed

    def sized(x: Column, i: Column) -> Column:
        end = F.right(F.get("pieces", i - 1), F.lit(1))
        return units(x) * 2**31 + F.when((i > 0) & ((end == "\n") | (end.isin(".", "!", "?") & (_lead(F.left(x, F.lit(1))) > 0))), 1).otherwise(0)

    def place(z: Column, i: Column) -> Column:
        ctx = F.left(F.array_join(F.slice("pieces", i + 1, 16), ""), F.lit(REACH))
        no = (z["so_far"].bitwiseAND(low32) + z["sizes"].bitwiseAND(low32)).cast("int")
        at = F.get("sentences", no)
        begun = F.struct(F.shiftright(z["so_far"], 31).alias("start"), ctx.alias("ctx"), F.struct(no.alias("sentence_no"), at["start"].alias("s0"), at["stop"].alias("s1"), at["text"].alias("sentence")).cast(some).alias("s"))
        if any(not r["head"] or r["head"][0] in BLANKS for r in of_terms):
            return begun
        return F.when(_lead(F.left(z["pieces"], F.lit(1))) == 0, begun)  # no term begins with white space

    pieces = texts.withColumn("pieces", _pieces("masked", of_terms)).withColumn("sizes", F.transform("pieces", sized)).withColumn("so_far", _before("sizes"))
    begun = F.array_compact(F.transform(F.arrays_zip("pieces", "sizes", "so_far"), place))
    places = pieces.select("draft_id", "channel", "market", F.explode(begun).alias("p")).select("draft_id", "channel", "market", "p.*")
    low = F.lower(F.translate(F.left("ctx", F.lit(2)), "ıſİ", "isi"))
    keys = [F.left(low, F.lit(n)) for n in sorted({len(r["key"]) for r in of_terms})] or [F.lit("")]
    places = places.withColumn("key", F.explode(F.array_distinct(F.array(*keys))))
    terms = matchers.filter("key not like 'kind:%'").join(scope, "rule_no")
    found = places.join(F.broadcast(terms), "key").filter(any_of)  # a policy table
    found = found.filter(F.lower(F.translate(F.left("ctx", F.length("head")), "ıſİ", "isi")) == F.col("head"))
    found = found.withColumn("term", F.expr(r"regexp_extract(ctx, concat('(?s)^(?iu:(', pattern, r')(?!\w))'), 1)")).filter("term <> ''")
    # Left to right, the longest term first: what begins within the last one kept is dropped.
    s = F.struct("s.sentence_no", "s.s0", "s.s1", F.when(F.col("asks"), _strip(F.col("s.sentence"))).alias("sentence")).cast(some).alias("s")
    hit = F.struct("start", (-F.col("size")).alias("size"), (-F.length("term")).alias("len"), "term", (F.col("start") + units(F.col("term"))).alias("stop"), s)
    hits = found.select("draft_id", "market", "rule_no", hit.alias("hit"))
    none = F.array().cast(f"array<struct<start:long,size:int,len:int,term:string,stop:long,s:{some}>>")
    kept = F.aggregate(
        F.array_sort(F.collect_list("hit")), none, lambda acc, x: F.when((F.size(acc) == 0) | (x["start"] >= F.try_element_at(acc, F.lit(-1))["stop"]), F.array_append(acc, x)).otherwise(acc)
    )
    out = hits.groupBy("draft_id", "market", "rule_no").agg(kept.alias("hits")).select("draft_id", "market", "rule_no", F.inline("hits")).select("draft_id", "market", "rule_no", "start", "stop", "term", "s")
    # Patterns: what stands before each match with the match, and the match; all rules of that kind in one pass.
    searched = []
    for r in known:
        if r["key"].startswith("kind:"):
            gap = F.lit(f"(?s)(.*?)({r['pattern']}|\\z)(?!\\G)")  # never nothing at all
            matched = F.struct(F.lit(r["rule_no"]).alias("rule_no"), F.regexp_extract_all("masked", gap, F.lit(0)).alias("pieces"), F.regexp_extract_all("masked", gap, F.lit(2)).alias("toks"))
            searched.append(F.when(F.col("masked").rlike(r["pattern"]), matched))
    if searched:
        ruled = texts.select("draft_id", "channel", "market", F.inline(F.array_compact(F.array(*searched))))
        ruled = ruled.join(F.broadcast(scope), "rule_no").filter(any_of)  # a policy table
        ruled = ruled.withColumn("sizes", F.transform("pieces", units)).withColumn("at", _before("sizes"))
        ruled = ruled.select("draft_id", "market", "rule_no", F.inline(F.arrays_zip("at", "sizes", "toks"))).filter("toks <> ''").withColumn("stop", F.col("at") + F.col("sizes"))
        out = out.unionByName(ruled.select("draft_id", "market", "rule_no", (F.col("stop") - units(F.col("toks"))).alias("start"), "stop", F.col("toks").alias("term"), F.lit(None).cast(some).alias("s")))
    return out


def number_spans(scan: DataFrame) -> DataFrame:
    """(draft_id, market, start, stop, raw, value): numbers that make a claim: marked (currency, %, x, k, m, +) or with a claim
    noun among the next three words; parts of words, dates, standards and years do not count."""
    rows = scan.select("draft_id", "market", F.posexplode("numbers").alias("i", "x")).withColumn("at", _running(["draft_id"], F.col("x.gap") + F.col("x.units")))
    rows = rows.filter("x.text <> ''").select("draft_id", "market", (F.col("at") + F.col("x.gap")).alias("start"), (F.col("at") + F.col("x.gap") + F.col("x.units")).alias("stop"), "x.text", "x.before", "x.rest")
    part = lambda k: F.regexp_extract("text", NUMBER, k)
    marked = (part(1) != "") | (part(3) != "") | (part(4) != "")
    plain = F.when(part(2).rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$"), F.regexp_replace(part(2), "[.,]", "")).otherwise(F.replace(part(2), F.lit(","), F.lit(".")))
    scale = F.when(F.lower(part(3)) == "k", 1e3).when(F.lower(part(3)) == "m", 1e6).otherwise(1.0)
    noun = F.exists(F.slice(F.regexp_extract_all("rest", F.lit(f"({c.WORD})"), 1), 1, 3), lambda w: w.rlike(c.CLAIM_NOUN))
    inside = F.col("before").rlike("[A-Za-z#/:]$") | F.col("rest").rlike("^[/:]") | F.col("before").rlike(rf"(?i)(?:no\.?|nr\.?|number|iso|iec|level){BLANK}?$")
    year = ~marked & part(2).rlike("^(19|20)[0-9]{2}$")
    return rows.filter(~inside & ~year & (marked | noun)).select("draft_id", "market", "start", "stop", _strip(F.col("text")).alias("raw"), (plain.try_cast("double") * scale).alias("value"))


def clause_spans(sentences: DataFrame) -> DataFrame:
    """(draft_id, sentence_no, start, stop, clause): a sentence between commas, ; : dashes, 'and' and 'but'; the first
    place of the ending counts to neither."""
    both = F.arrays_zip(F.split("sentence", CLAUSE_ENDS).alias("part"), F.regexp_extract_all("sentence", F.lit(CLAUSE_ENDS), F.lit(0)).alias("end"))
    rows = sentences.select("draft_id", "sentence_no", F.col("start").alias("first"), F.posexplode(both).alias("i", "x"))
    rows = rows.withColumn("start", F.col("first") + _running(["draft_id", "sentence_no"], units(F.col("x.part")) + F.coalesce(units(F.col("x.end")), F.lit(0))))
    return rows.select("draft_id", "sentence_no", "start", (F.col("start") + units(F.col("x.part"))).alias("stop"), _strip(F.col("x.part")).alias("clause"))


def register_best(texts: DataFrame, register: DataFrame, key: list[str]) -> DataFrame:
    """(key, reg_no, ratio, numbers_fit): the best entry for each (key, said, values), by shared stems: an equi-join of
    stems, as every fit shares one. values: the numbers said. Ties go to the first entry."""
    stems = register.select("reg_no", F.col("numbers").alias("known"), c.claim_tokens(F.col("claim")).alias("rt"))
    stems = stems.withColumn("rt", F.array_except("rt", F.array(F.lit("fernway"))))
    mine = texts.select(*key, "values", F.explode(c.claim_tokens(F.col("said"))).alias("stem"))
    met = mine.join(stems.select("reg_no", "known", F.size("rt").alias("of"), F.explode("rt").alias("stem")), "stem")
    met = met.groupBy(*key, "reg_no").agg(F.count("*").alias("shared"), F.first("of").alias("of"), F.first("values").alias("values"), F.first("known").alias("known"))
    fit = (F.size("values") > 0) & (F.size(F.array_except("values", "known")) == 0)
    met = met.withColumn("ratio", F.col("shared") / F.col("of")).withColumn("numbers_fit", fit)
    met = met.filter("shared >= 2 and ratio >= 0.4 or numbers_fit and shared >= 1")
    score = F.col("shared") + F.col("ratio") + F.when(F.col("numbers_fit"), 2).otherwise(0)
    return met.groupBy(*key).agg(F.max_by(F.struct("reg_no", "ratio", "numbers_fit"), F.struct(score, -F.col("reg_no"))).alias("b")).select(*key, "b.*")


def _in(inner: DataFrame, outer: DataFrame, whole: bool) -> DataFrame:
    """inner with the sentence that holds its beginning (whole: all of it): the last one that begins before it."""
    row, s = F.struct(*inner.columns), F.struct("sentence_no", F.col("start").alias("s0"), F.col("stop").alias("s1"), "sentence")
    both = inner.select("draft_id", F.col("start").alias("at"), F.lit(1).alias("side"), row.alias("row")).unionByName(outer.select("draft_id", F.col("start").alias("at"), F.lit(0).alias("side"), s.alias("s")), True)
    order = Window.partitionBy("draft_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("s", F.last("s", True).over(order)).filter("row is not null and s is not null").select("row.*", "s.*")
    return held.filter("stop <= s1" if whole else "start < s1")


def _vars(**columns: Column) -> Column:
    return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))])


def findings(drafts: DataFrame, ruleset: Ruleset) -> DataFrame:
    """(draft_id, n, rule, severity, weight, count, spans, evidence, message, fix): everything the rules find, in order: by
    severity, then by the first place, then as the rules stand. drafts: draft_id, channel, market, text.

    Empty drafts have no findings. An empty table gives an empty table.
    """
    scan, matchers = scanned(drafts, ruleset)
    return findings_of(scan, matchers, ruleset)


def findings_of(scan: DataFrame, matchers: DataFrame, ruleset: Ruleset) -> DataFrame:
    rules = ruleset.rules
    scan = scan.filter("filled")
    sentences = sentence_spans(scan)
    kinds = rules.select("rule_no", "rule", "type", "channels", "markets", "params")
    # What hits need of a rule's parameters is read here, once a rule and not once a hit.
    text = lambda name: F.expr(f"try_variant_get(params, '$.{name}', 'string')")
    of_hits = rules.select("rule_no", "rule", "type", text("unless").alias("unless"), text("unlessScope").alias("scope"), F.get_json_object(F.to_json("params"), "$.max").cast("int").alias("most"))
    hits = hit_spans(scan, matchers, rules).join(F.broadcast(of_hits), "rule_no")  # a policy table
    hits = materialise(hits.select("*", "s.*").drop("s"), "draft-hits")
    fields = materialise(field_spans(scan), "draft-fields")
    param = lambda name, kind="int": F.expr(f"try_variant_get(params, '$.{name}', '{kind}')")
    span = lambda a, b: F.array(F.struct(F.col(a).cast("long").alias("start"), F.col(b).cast("long").alias("stop")))
    no_spans = F.array().cast(f"array<{SPAN}>")
    scoped = F.expr("(channels is null or array_contains(channels, channel)) and (markets is null or array_contains(markets, market))")
    out: list[DataFrame] = []

    def found(rows: DataFrame, spans: Column, said: Column, count: Column | None = None, rule: Column | None = None, severity: Column | None = None, evidence: Column | None = None, last: bool = False) -> None:
        """said: what the messages name; rule: the one whose message it is, where it is not the one that found it."""
        none = F.lit(None).cast("string")
        out.append(
            rows.select(
                "draft_id", F.lit(int(last)).alias("pass"), F.col("rule_no").alias("by"), (F.lit(1) if count is None else count).cast("long").alias("count"), spans.alias("spans"),
                said.cast("map<string,string>").alias("vars"), (F.col("rule") if rule is None else rule).alias("rule"), (none if severity is None else severity).alias("own"),
                (none if evidence is None else evidence).alias("evidence"),
            )
        )

    def of(kind: str) -> DataFrame:
        return F.broadcast(rules.filter(F.col("type") == kind))  # policy tables: else drafts are gone through once a part of them

    empty = F.create_map().cast("map<string,string>")
    # Fields.
    in_field = fields.join(of("length").select(*kinds.columns), F.expr("(channels is null or array_contains(channels, channel)) and field = try_variant_get(params, '$.field', 'string')"))
    over = in_field.withColumn("max", param("max")).filter("chars > max").withColumn("cut", F.col("start") + F.col("max"))
    found(over, span("cut", "stop"), _vars(len=F.col("chars"), max=F.col("max")))
    marks = fields.join(of("field-regex").select(*kinds.columns), F.expr("(channels is null or array_contains(channels, channel)) and field = try_variant_get(params, '$.field', 'string')"))
    # Lines of a field in order, with what stands between them: its text is theirs, untouched.
    of_field = F.array_join(F.transform(F.slice("lines", F.col("first") + 1, F.col("last") - F.col("first") + 1), lambda x: F.concat(F.repeat(F.lit(" "), x["cut"]), F.substring(x["text"], x["cut"] + 1, F.length(x["text"])))), "\n")
    marks = marks.join(scan.select("draft_id", "lines"), "draft_id").withColumn("text", _strip(of_field))
    pattern = param("pattern", "string")
    gaps = F.transform(F.arrays_zip(F.split("text", pattern).alias("gap"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("tok")), lambda z: F.struct(units(z["gap"]).alias("gap"), F.coalesce(units(z["tok"]), F.lit(0)).alias("size")))
    marks = marks.select("draft_id", "rule_no", "rule", "field_no", F.col("start").alias("first"), F.posexplode(gaps).alias("i", "x")).withColumn("at", F.col("first") + _running(["draft_id", "rule_no", "field_no"], F.col("x.gap") + F.col("x.size")))
    marks = marks.filter("x.size > 0").select("draft_id", "rule_no", "rule", F.struct((F.col("at") + F.col("x.gap")).alias("start"), (F.col("at") + F.col("x.gap") + F.col("x.size")).alias("stop")).alias("s"))
    marks = marks.groupBy("draft_id", "rule_no", "rule").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    found(marks, F.col("spans"), empty, F.size("spans"))
    hook = fields.filter("field_no = 1").join(of("hook").select(*kinds.columns), F.expr("channels is null or array_contains(channels, channel)")).withColumn("max", param("max"))
    hook = hook.filter("hook > max").withColumn("cut", F.col("start") + F.col("max"))
    found(hook, span("cut", "hook_stop"), _vars(len=F.col("hook"), max=F.col("max")))
    per = scan.select("draft_id", "channel", "market").join(
        fields.groupBy("draft_id").agg(F.collect_list("field").alias("have"), F.count_if(~F.col("labelled")).alias("bare")), "draft_id"
    )
    all_rules = per.join(F.broadcast(rules.filter(F.col("type").isin("count", "unlabelled", "required")).select(*kinds.columns)), scoped)
    number = lambda f: F.size(F.filter("have", lambda x: x == f))
    counts = all_rules.filter("type = 'count'").withColumn("h", number(F.lit("headline"))).withColumn("d", number(F.lit("description")))
    counts = counts.filter((F.col("h") < param("headline")) | (F.col("d") < param("description")))
    found(counts, no_spans, _vars(have=F.concat(F.col("h").cast("string"), F.lit(" headline(s) and "), F.col("d").cast("string"), F.lit(" description(s)"))))
    found(all_rules.filter("type = 'unlabelled' and bare > 0"), no_spans, _vars(n=F.col("bare")))
    found(all_rules.filter(F.expr("type = 'required' and not array_contains(have, try_variant_get(params, '$.field', 'string'))")), no_spans, empty)
    # Hits counted by rule, each term in its first spelling.
    let_off = scan.select("draft_id", F.explode("let_off").alias("rule"))
    phrases = hits.filter("type in ('phrase', 'regex', 'exclaim', 'caps', 'competitor')").join(let_off, ["draft_id", "rule"], "left_anti")
    bound = phrases.filter("scope = 'sentence'")
    free = phrases.filter("coalesce(scope, '') <> 'sentence'")
    bound = bound.filter("s0 is not null")
    patterned = rules.filter(F.expr("type in ('regex', 'exclaim', 'caps') and try_variant_get(params, '$.unlessScope', 'string') = 'sentence'"))
    if not patterned.isEmpty():  # a policy table
        bound = bound.unionByName(_in(phrases.filter("scope = 'sentence' and s0 is null").drop("sentence_no", "s0", "s1", "sentence"), sentences, whole=False))
    kept = bound.filter("start >= s0 and start < s1").filter(~F.expr("sentence rlike concat('(?iu)', unless)"))
    allowed = ruleset.terms.select("rule", F.col("term"))
    plain = free.filter("type <> 'caps'").unionByName(kept).unionByName(free.filter("type = 'caps'").join(allowed, ["rule", "term"], "left_anti").select(*phrases.columns))
    names = ruleset.terms.join(of("competitor").select("rule"), "rule").select(F.lower("term").alias("low"), F.col("term").alias("name")).distinct()
    named = plain.withColumn("low", F.lower("term")).join(F.broadcast(names), "low", "left")  # competitors: rows of a policy table
    named = named.withColumn("term", F.when(F.col("type") == "competitor", F.coalesce("name", "term")).otherwise(F.col("term")))
    named = named.select("draft_id", "rule_no", "rule", "type", "most", "low", "start", "stop", "term")
    spelled = named.groupBy("draft_id", "rule_no", "rule", "type", "most", "low").agg(
        F.min(F.struct("start", "term")).alias("one"), F.collect_list(F.struct("start", "stop")).alias("s")
    )
    counted = spelled.groupBy("draft_id", "rule_no", "rule", "type", "most").agg(F.array_sort(F.collect_list("one")).alias("ones"), F.array_sort(F.flatten(F.collect_list("s"))).alias("spans"))
    counted = counted.withColumn("n", F.size("spans")).withColumn("max", F.when(F.col("type") == "exclaim", F.col("most"))).filter("type <> 'exclaim' or n > max")
    terms = F.array_join(F.transform("ones", lambda x: x["term"]), ", ")
    found(counted, F.col("spans"), _vars(terms=terms, n=F.col("n"), max=F.col("max")), F.when(F.col("type") == "exclaim", F.col("n") - F.col("max")).otherwise(F.col("n")))
    # The whole draft.
    whole = scan.select("draft_id", "channel", "market", "words", "syllables", "we", "you", F.size(F.filter("sentences", lambda s: s["stop"] > s["start"])).alias("sents"))
    whole = whole.join(F.broadcast(rules.filter(F.col("type").isin("flesch", "person")).select(*kinds.columns)), scoped)
    ease = 206.835 - 1.015 * (F.col("words") / F.col("sents")) - 84.6 * (F.col("syllables") / F.col("words"))
    hard = whole.filter("type = 'flesch'").withColumn("min", param("min")).filter((F.col("words") >= param("minWords")) & (ease < F.col("min")))
    found(hard, no_spans, _vars(score=F.floor(ease + 0.5), min=F.col("min")))
    person = whole.filter("type = 'person'").filter((F.col("we") + F.col("you") >= param("minPronouns")) & (F.col("we") > F.col("you")))
    found(person, no_spans, _vars(we=F.col("we"), you=F.col("you")))
    long = sentences.join(of("sentence-length").select(*kinds.columns, param("max").alias("max")), scoped)
    # Words are one character at least, as is what parts them.
    long = long.filter((F.length("sentence") > 2 * F.col("max")) & (F.regexp_count("sentence", F.lit(c.WORD)) > F.col("max"))).groupBy("draft_id", "rule_no", "rule", "max").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    found(long, F.col("spans"), _vars(n=F.size("spans"), max=F.col("max")), F.size("spans"))
    # Claims: superlatives, certificates, comparisons and numbers against the register.
    register = ruleset.register
    entry = register.select("reg_no", "id", "claim", "numbers", "qualifier", F.col("markets").alias("ok_markets"), "retired", "competitor")
    top = hits.filter("type = 'superlative' and start >= s0 and start < s1")
    said = top.select("draft_id", "sentence_no", F.col("sentence").alias("said"), F.array().cast("array<double>").alias("values")).distinct()
    backed = register_best(said, register, ["draft_id", "sentence_no"]).join(entry, "reg_no").filter("ratio >= 0.6 and retired is null")
    top = top.join(backed.select("draft_id", "sentence_no", "ok_markets"), ["draft_id", "sentence_no"], "left").filter("ok_markets is null or not array_contains(ok_markets, market)")
    found(top, span("start", "stop"), _vars(term=F.col("term")))
    certs = hits.filter("type = 'cert'").withColumn("low", F.lower("term")).join(ruleset.terms.select("rule", F.lower("term").alias("low"), F.col("evidence").alias("ev")), ["rule", "low"], "left")
    certs = certs.join(register.select(F.col("id").alias("ev"), "claim"), "ev", "left")
    found(certs, span("start", "stop"), _vars(term=F.col("term"), ev=F.col("ev"), claim=F.col("claim")), rule=F.when(F.col("ev").isNull(), F.col("rule")).otherwise("CLM-OK"), evidence=F.col("ev"))
    counted_in = scan.filter("size(numbers) > 0")
    in_sentence = materialise(_in(number_spans(counted_in), sentence_spans(counted_in), whole=True), "draft-numbers")
    who = hits.filter("type = 'competitor' and start >= s0 and start < s1").withColumn("low", F.lower("term")).join(F.broadcast(names), "low", "left").select("draft_id", "sentence_no", "sentence", F.col("start").alias("c0"), F.col("stop").alias("c1"), F.coalesce("name", "term").alias("comp"))
    against = who.join(hits.filter("type in ('comparative', 'disparage') and start >= s0 and stop <= s1").drop("sentence"), ["draft_id", "sentence_no"])
    first = against.groupBy("draft_id", "market", "sentence_no", "sentence", "c0", "c1", "comp", "rule_no", "rule", "type").agg(F.min(F.struct("start", "stop", "term")).alias("h")).select("*", "h.*")
    found(first.filter("type = 'disparage'"), span("start", "stop"), _vars(comp=F.col("comp"), term=F.col("term")))
    compared = first.filter("type = 'comparative'")
    values = in_sentence.groupBy("draft_id", "sentence_no").agg(F.collect_set("value").alias("v"))
    said = compared.select("draft_id", "sentence_no", F.col("sentence").alias("said")).distinct().join(values, ["draft_id", "sentence_no"], "left").withColumn("values", F.coalesce("v", F.array().cast("array<double>")))
    best = register_best(said, register, ["draft_id", "sentence_no"]).join(entry, "reg_no").filter("ratio >= 0.6 and retired is null and (size(numbers) = 0 or numbers_fit)")
    compared = compared.join(best.select("draft_id", "sentence_no", F.col("competitor").alias("comp"), F.col("id").alias("ev"), "ok_markets"), ["draft_id", "sentence_no", "comp"], "left")
    strong = F.coalesce(F.array_contains("ok_markets", F.col("market")), F.lit(False))
    both = F.concat(span("start", "stop"), span("c0", "c1"))
    found(compared, F.when(strong, span("start", "stop")).otherwise(both), _vars(comp=F.col("comp"), term=F.col("term")), severity=F.when(strong, "warn"), evidence=F.when(strong, F.col("ev")))
    parts = clause_spans(in_sentence.select("draft_id", "sentence_no", F.col("s0").alias("start"), "sentence").distinct()).withColumnRenamed("start", "p0").withColumnRenamed("stop", "p1")
    claims = in_sentence.join(parts, ["draft_id", "sentence_no"]).filter("start >= p0 and start < p1")
    said = claims.groupBy("draft_id", "sentence_no", "clause").agg(F.collect_set("value").alias("values")).withColumn("said", F.col("clause"))
    best = register_best(said, register, ["draft_id", "sentence_no", "clause"]).join(entry, "reg_no")
    claims = claims.join(best, ["draft_id", "sentence_no", "clause"], "left")
    dropped = F.col("qualifier").isNotNull() & ~F.expr(r"clause rlike concat('(?iu)(?<![A-Za-z0-9_])\\Q', qualifier, '\\E(?![A-Za-z0-9_])')")
    outcome = (
        F.when(F.col("id").isNull(), "CLM-UNSUB")
        .when(~F.array_contains("numbers", F.col("value")), "CLM-ALTERED")
        .when(F.col("retired").isNotNull(), "CLM-RETIRED")
        .when(~F.array_contains("ok_markets", F.col("market")), "CLM-MARKET")
        .when(dropped, "CLM-QUALIFIER")
        .otherwise("CLM-OK")
    )
    snippet = F.when(units(F.col("clause")) > 70, F.concat(F.left("clause", F.lit(67)), F.lit("…"))).otherwise(F.col("clause"))
    want = F.array_join(F.transform("numbers", lambda v: F.regexp_replace(F.format_number(v, 3), r"\.?0+$", "")), ", ")
    about = _vars(snippet=snippet, ev=F.col("id"), claim=F.col("claim"), got=F.col("raw"), want=want, why=F.col("retired"), markets=F.array_join("ok_markets", ", "), market=F.col("market"), q=F.col("qualifier"))
    found(claims.withColumn("rule", outcome).withColumn("rule_no", F.lit(0)), span("start", "stop"), about, evidence=F.col("id"), last=True)
    rows = reduce(DataFrame.unionByName, out).join(F.broadcast(rules.select("rule", "severity", "weight", "message", "fix")), "rule")  # a policy table
    severity = F.coalesce("own", "severity")
    plain_weight = F.when(severity == "block", c.WEIGHT["block"]).when(severity == "warn", c.WEIGHT["warn"])
    weight = F.when(severity == "info", 0).when((severity == F.col("severity")) & F.col("weight").isNotNull(), F.col("weight")).otherwise(plain_weight)
    filled = lambda t: F.aggregate(F.map_entries("vars"), F.col(t), lambda acc, e: F.coalesce(F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]), acc))
    first_place = F.coalesce(F.get("spans", F.lit(0))["start"], F.lit(10**9).cast("long"))
    rank = F.when(severity == "block", 0).when(severity == "warn", 1).otherwise(2)
    rows = rows.select("draft_id", "pass", "by", "rule", severity.alias("severity"), weight.alias("weight"), "count", "spans", "evidence", filled("message").alias("message"), filled("fix").alias("fix"), first_place.alias("at"), rank.alias("rank"))
    order = Window.partitionBy("draft_id").orderBy("rank", "at", "pass", "by", "rule")
    made = Window.partitionBy("draft_id").orderBy("pass", "by", "at", "rule")
    return rows.withColumn("n", F.row_number().over(order)).withColumn("made", F.row_number().over(made)).select(
        "draft_id", "n", "made", "rule", "severity", "weight", "count", "spans", "evidence", "message", "fix"
    )


def verdicts(drafts: DataFrame, found: DataFrame, threshold: float = 20) -> DataFrame:
    """(draft_id, score, verdict, reason): the score sums weight times count (three at most), up to 100; any block blocks.
    reason: the first block made and how many more, or the two heaviest warnings; null for the rest."""
    ranked = F.when(F.col("severity") == "warn", F.struct((-F.col("weight")).alias("w"), "made", "rule"))
    sums = found.groupBy("draft_id").agg(
        F.least(F.lit(100), F.sum(F.col("weight") * F.least("count", F.lit(3)))).alias("score"), F.count_if(F.col("severity") == "block").alias("blocks"),
        F.min_by("message", F.when(F.col("severity") == "block", F.col("made"))).alias("first"), F.array_sort(F.collect_list(ranked)).alias("warns"),
    )
    rows = drafts.select("draft_id", F.coalesce(F.col("text").rlike(f"[^{BLANK[1:]}"), F.lit(False)).alias("filled")).join(sums, "draft_id", "left")
    score, blocks = F.coalesce("score", F.lit(0)).cast("long"), F.coalesce("blocks", F.lit(0))
    verdict = F.when(~F.col("filled"), "empty").when(blocks > 0, "block").when(score >= threshold, "review").otherwise("approve")
    more = F.when(blocks > 1, F.concat("first", F.lit(" Plus "), (blocks - 1).cast("string"), F.lit(" more."))).otherwise(F.col("first"))
    reason = F.when(verdict == "block", more).when(verdict == "review", F.array_join(F.transform(F.slice("warns", 1, 2), lambda x: x["rule"]), ", "))
    return rows.select("draft_id", score.alias("score"), verdict.alias("verdict"), reason.alias("reason"))
