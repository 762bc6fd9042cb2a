"""Line dedup by winnowing over line hashes, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import free_name
from millrace.plans.storage import materialise

NO_ID = -(1 << 63)


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _doc(id_col: str, text_col: str) -> Column:
    """A document's key: its id (null first) and its text's hash. Rows alike in both are one document."""
    return F.struct(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(_text(text_col)).alias("h")
    )


def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, k, pos, hash, words) of every line that holds a word: k counts these within the document, pos counts all
    lines. The hash is over the line in lower case without outer blanks. Partitioned by document."""
    in_order = Window.partitionBy("doc").orderBy("pos")
    return (
        # The key first, on its own: beside the explosion it would be hashed anew for every line.
        df.select(_doc(id_col, text_col).alias("doc"), _text(text_col).alias("text"))
        .select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select(
            "doc", "pos", F.xxhash64(F.lower(F.trim("line"))).alias("hash"), F.regexp_count("line", F.lit(r"\S+")).alias("words")
        )
        .filter("words > 0")
        .repartition("doc")
        .groupBy("doc", "pos")
        .agg(F.min("hash").alias("hash"), F.min("words").alias("words"))
        .withColumn("k", F.row_number().over(in_order))
    )


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, fp, content, at, first, last, first_pos, last_pos): the winnowing windows.

    The windows are the shortest runs of lines with min_words words that begin at a line, and the shortest that end at
    one; each run once. fp is the smallest line hash in the window (of equal ones the last), at that line's k, and
    content the hash of all its lines.
    """
    before = Window.partitionBy("doc").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    # Lines that begin within min_words words of the window's begin, or end within as many of its end: at most
    # min_words, as each has a word.
    onwards = Window.partitionBy("doc").orderBy("start").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("doc").orderBy("end").rangeBetween(1 - min_words, 0)

    def window(frame, first: Column, last: Column) -> Column:
        least = F.min(F.struct("hash", (-F.col("k")).alias("k"))).over(frame)
        return F.struct(
            least["hash"].alias("fp"),
            F.xxhash64(F.collect_list("hash").over(frame)).alias("content"),
            (-least["k"]).alias("at"),
            first.alias("first"),
            last.alias("last"),
            F.min("pos").over(frame).alias("first_pos"),
            F.max("pos").over(frame).alias("last_pos"),
            F.sum("words").over(frame).alias("n"),
        )

    placed = lines.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("long")).withColumn(
        "end", F.col("start") + F.col("words")
    )
    k = F.col("k")
    both = placed.select(
        "doc", window(onwards, k, F.max("k").over(onwards)).alias("onwards"), window(back, F.min("k").over(back), k).alias("back")
    )
    runs = both.select("doc", F.explode(F.array("onwards", "back")).alias("w")).select("doc", "w.*").filter(F.col("n") >= min_words)
    # The lines lie by document already: no shuffle.
    return runs.groupBy("doc", "first", "last").agg(
        *[F.first(c).alias(c) for c in ("fp", "content", "at", "first_pos", "last_pos")]
    )


def repeated_runs(df: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, runs): for each document with lines that repeat earlier ones, the array of its runs {first, last} of line
    positions to delete, in order and apart."""
    marks = materialise(windows(line_table(df, id_col, text_col), min_words), "windows")
    # Fingerprints selected at more than one position: partial minima and maxima go through the shuffle.
    place = F.xxhash64("doc", "at")
    shared = marks.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("fp")
    candidates = materialise(marks.join(shared, "fp", "left_semi"), "candidates")
    # The earliest place of a window's lines around a fingerprint. Written, so that both sides of the join below come
    # from plain shuffles and a hot passage's part can be split.
    earliest = (
        candidates.groupBy("fp", "content").agg(F.min(F.struct("doc", "first")).alias("source"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    earliest = materialise(earliest, "earliest")
    matches = candidates.join(earliest, ["fp", "content"]).filter("doc <> source.doc or first <> source.first")
    # Neighbouring matches become one run.
    so_far = Window.partitionBy("doc").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    in_order = Window.partitionBy("doc").orderBy("first", "last")
    fresh = F.coalesce(F.col("first") > F.max("last").over(so_far) + 1, F.lit(True)).cast("int")
    runs = (
        matches.select("doc", "first", "last", "first_pos", "last_pos", fresh.alias("fresh"))
        .withColumn("run", F.sum("fresh").over(in_order))
        .groupBy("doc", "run")
        .agg(F.min("first_pos").alias("first"), F.max("last_pos").alias("last"))
    )
    return runs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _without(text: Column, runs: Column) -> Column:
    """The text without the lines of its runs: the stretches between runs, joined. Linear in lines and runs."""

    def kept(lines: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(runs, i - 1)["last"] + 1, F.lit(0))
        end = lambda i: F.coalesce(F.get(runs, i)["first"], F.size(lines))
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(runs)), lambda i: F.slice(lines, begin(i) + 1, F.greatest(end(i) - begin(i), F.lit(0)))
            )
        )

    # Inside of an array of one, so that the text is split once and not for every run.
    return F.array_join(F.get(F.transform(F.array(F.split(text, "\n")), kept), F.lit(0)), "\n")


def dedup_lines(
    df: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", runs_col: str = "removed_runs"
) -> DataFrame:
    """All rows and columns of df, the text without its repeated runs, plus `removed_runs` (array of {first, last} line
    positions; empty if none). If df has a column of that name, that one stays and the new one is `removed_runs_2`.

    A run is a stretch of whole lines with at least min_words words. It is repeated if the same lines (in lower case,
    without outer blanks) stand earlier, where documents are in the order of their ids (null first; equal ids by the
    text's hash) and lines in that of their positions; within a document also a later run that repeats an earlier one.
    Every line of every repeated run is deleted, and no other line that holds a word. Every deleted line's first
    occurrence stays.

    Winnowing: each shortest run with min_words words, from a line on or back from one, is a window, and its smallest
    line hash is selected as a fingerprint, so any repeated run shares selected fingerprints. Positions are joined by
    fingerprint; those whose fingerprint stands elsewhere too are extended both ways, to the windows that begin and
    end around them, and these are compared with their earliest place alone, never with each other: a hot passage
    costs one row an occurrence. Every line of a longer repeated run lies in such a window, so windows that match and
    touch make up the maximal runs, whatever their length, and the work is linear in lines.

    Null texts count as empty and come back empty where nothing is removed from them: null stays null. Lines without
    a word are ignored in matching and go only inside of a run or between runs that touch. Rows alike in id and text
    count as one document and get one result. A text all of whose lines go comes back empty. An empty table gives an
    empty table.
    """
    key, held = free_name(df, "doc_key"), free_name(df, "doc_runs")
    found = repeated_runs(df, min_words, id_col, text_col).select(F.col("doc").alias(key), F.col("runs").alias(held))
    joined = df.join(found, _doc(id_col, text_col) == F.col(key), "left")
    out = [
        F.when(F.col(held).isNull(), F.col(c)).otherwise(_without(F.col(c), F.col(held))).alias(c) if c == text_col else F.col(c)
        for c in df.columns
    ]
    none = F.array().cast("array<struct<first:int,last:int>>")
    return joined.select(*out, F.coalesce(held, none).alias(free_name(df, runs_col)))
