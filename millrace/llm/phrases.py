"""Phrase collocations: only longest windows are counted, and ROLLUP sums their prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bits import bit_table, holds
from millrace.llm.words import Words, chunks, cut, mixed, translation
from millrace.plans.storage import materialise

PIECES = translation(breaks=b".,;:!?\x0a\x0b\x0c\x0d", spaces=b"\x09")
SIEVE = 3  # words of the longest runs that are looked up before windows are made


def _corpus(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def _runs(words: Words, langs: list[str], longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, .. longest words, each as long as there are words: a hash of the run that starts at a word, with
    its language, and whether it ends in the word's piece."""
    by_lang = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)[words.text]
    own = mixed(by_lang, words.hashes())
    out = [(own, np.ones(len(own), bool))]
    for k in range(1, longest):
        run, inside = out[-1][0].copy(), np.zeros(len(own), bool)
        rest = max(0, len(own) - k)
        run[:rest] = mixed(run[:rest], own[k:])
        inside[:rest] = words.piece[k:] == words.piece[:rest]
        out.append((run, inside))
    return out


def common_runs(corpus: DataFrame, least: int) -> np.ndarray:
    """A bit table that holds every run of up to SIEVE words of a (lang, text) table that occurs `least` times or more.

    Runs are counted by 64-bit hashes: words and pairs first, then those longer ones whose shorter parts are common. The
    table has one size, whatever the input. Some others fall on a set bit; none that is common misses.
    """
    table = np.zeros(0, np.uint8)
    for size in range(2, SIEVE + 1):
        sent = corpus.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], size: int = size, sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = batch.column("lang").to_pylist()
                for first, texts in chunks(batch.column("text")):
                    words = cut(texts, PIECES)
                    if not len(words):
                        continue
                    runs = _runs(words, langs[first : first + len(texts)], size)
                    h, inside = runs[-1]
                    if size == 2:
                        h = np.concatenate([runs[0][0], h[inside]])
                    else:
                        known = holds(sent.value, runs[-2][0])
                        h = h[inside & known & np.append(known[1:], False)]
                    h, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        counted = corpus.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        found = bit_table(counted.filter(F.col("n") >= least), "h")
        table = found | table if len(table) else found
    return table


def windows(corpus: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, w1 .. w<longest>, n): for every word, the window of that word and those that follow it in its piece,
    padded with nulls behind the piece, and from where a word, pair or triple occurs under `least` times in the language:
    no phrase across such a place is that frequent. n adds up to the number of words."""
    bits = corpus.sparkSession.sparkContext.broadcast(common_runs(corpus, least))
    names = [f"w{k + 1}" for k in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in chunks(batch.column("text")):
                words, some = cut(texts, PIECES), langs[first : first + len(texts)]
                size = len(words)
                if not size:
                    continue
                spelled = words.spelled()
                codes = spelled.indices.to_numpy(zero_copy_only=False)
                known = [inside & holds(bits.value, h) for h, inside in _runs(words, some, min(longest, SIEVE))]
                held, columns = known[0], []
                for k in range(longest):
                    back = min(k, len(known) - 1)  # the run that ends k words on, as long as they are looked up
                    held = held & np.append(known[back][k - back :], np.zeros(min(size, k - back), bool))
                    lead = np.append(codes[k:], np.zeros(min(k, size), codes.dtype))
                    columns.append(pa.array(np.where(held, lead, -1)))
                spoken = pa.array(some).dictionary_encode()
                lang = pa.array(spoken.indices.to_numpy()[words.text])
                counted = pa.table([lang, *columns], ["lang", *names]).group_by(["lang", *names]).aggregate([([], "count_all")])
                counted = counted.combine_chunks()

                def word(name: str, counted: pa.Table = counted, known: pa.Array = spelled.dictionary) -> pa.Array:
                    code = counted[name].to_numpy()
                    return known.take(pa.array(code, mask=code < 0)).cast(pa.string())

                out = [spoken.dictionary.take(pa.array(counted["lang"].to_numpy())), *map(word, names)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(counted["count_all"].to_numpy())], ["lang", *names, "n"])

    schema = ", ".join(["lang string", *(f"{w} string" for w in names), "n long"])
    return corpus.mapInArrow(run, schema).groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrase_counts(
    df: DataFrame, longest: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, words, n): every phrase of up to `longest` words that occurs `least` times or more, and for each language
    the number of all its words, under no words.

    ROLLUP sums the counts of the longest windows over ever shorter prefixes. Which columns it has rolled up is read
    from grouping_id, so padding is never taken for it.
    """
    names = [f"w{k + 1}" for k in range(longest)]
    top = windows(_corpus(df, text_col, lang_col), longest, least)
    rolled = top.rollup("lang", *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    rolled = rolled.filter(F.col("gid") < 1 << longest).select(
        "lang", F.array_compact(F.array(*names)).alias("words"), (F.lit(longest) - F.bit_count("gid")).alias("level"), "n"
    )
    return rolled.filter((F.size("words") == F.col("level")) & ((F.col("level") == 0) | (F.col("n") >= least))).drop("level")


def collocations(
    df: DataFrame,
    longest: int = 5,
    least: int = 100,
    first: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    salts: int = 64,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `first` phrases of 2 to `longest` words by score.

    a, l and r are the counts of a phrase and of the two parts of its lowest-scoring cut, n all words of the language,
    the score floor(1000 a n / (l r)) in exact decimals (counts up to 10^16). A phrase inside a longer one as frequent as
    itself is left out. Languages that are null count as `und`, null texts as empty; repeated rows count each time; very
    long texts are read whole; ties go by count, then by the phrase's bytes. An empty table gives an empty table.
    """
    counted = materialise(phrase_counts(df, longest, least, text_col, lang_col), "phrases")
    known = counted.filter(F.size("words") > 0).select("lang", F.concat_ws(" ", "words").alias("phrase"), "words", "n")
    total = counted.filter(F.size("words") == 0).select("lang", F.col("n").alias("total"))
    found = known.filter(F.size("words") > 1).withColumnRenamed("n", "a")
    size = F.size("words")

    def count_of(part: str, name: str) -> DataFrame:
        return known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))

    cuts = found.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("head"),
        F.concat_ws(" ", F.slice("words", F.col("k") + 1, size)).alias("tail"),
    )
    wide = "cast({} as decimal(16,0))".format
    top = f"cast(1000 as decimal(4,0)) * {wide('a')} * {wide('total')}"
    scored = (
        cuts.join(count_of("head", "l"), ["lang", "head"])
        .join(count_of("tail", "r"), ["lang", "tail"])
        .join(total, "lang")
        .withColumn("score", F.expr(f"({top}) div ({wide('l')} * {wide('r')})"))
        .groupBy("lang", "phrase", "a", "total")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # Every shorter run of words inside a candidate, with the highest count of those around it.
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda m: F.transform(
                F.sequence(F.lit(1), size - m + 1), lambda s: F.concat_ws(" ", F.slice("words", s, m))
            ),
        )
    )
    inside = (
        found.filter(size > 2)
        .select("lang", F.explode(spans).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("around"))
    )
    kept = scored.join(inside, ["lang", "phrase"], "left").filter("around is null or around < a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best lie among the best of each share of it, so no task sorts a whole language.
    share = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    part = Window.partitionBy("lang", "share").orderBy(*order)
    best = share.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= first).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
