"""Chat formatting: logged snapshots that a longer conversation continues are dropped, the others rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role = F.coalesce(F.col(role_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        df.filter(F.col(conv_col).isNotNull())
        .select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
        .distinct()
    )


def collapse_snapshots(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, turn, role, text) of the maximal conversations: those that are not, as a whole, the first turns of a
    longer one; of equal conversations the one with the smallest conv_id.

    A rolling hash of the turns so far (SHA-256 over the last prefix's hash, role and text) names each prefix. A
    conversation's last hash is looked for among the proper prefixes of others (an anti-join on the hash), so a prefix
    that thousands share stays one row in the join. Turn numbers only order the turns; nulls come first. Null roles
    and texts count as empty, rows without a conv_id are dropped, repeated rows count once, and turns of one number
    are ordered by role and text. An empty table gives an empty table.
    """
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = _turns(df, conv_col, turn_col, role_col, text_col)
    said = F.sha2(F.concat_ws("\x1f", F.sha2("role", 256), F.sha2("text", 256)), 256)
    # Bounded by a conversation's own length: one array of its turns' hashes, folded from left to right.
    folded = (
        turns.withColumn("said", said)
        .withColumn("at", F.row_number().over(ordered))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "said"))).alias("all"))
        .select(
            "conv_id",
            F.aggregate(
                "all",
                F.array().cast("array<string>"),
                lambda acc, t: F.concat(
                    acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), t["said"]), 256))
                ),
            ).alias("prefixes"),
        )
    )
    whole = folded.select("conv_id", F.element_at("prefixes", -1).alias("hash"))
    proper = folded.select(F.explode(F.expr("slice(prefixes, 1, size(prefixes) - 1)")).alias("hash")).distinct()
    # Equal conversations first: one row a hash is left for the anti-join.
    kept = whole.groupBy("hash").agg(F.min("conv_id").alias("conv_id")).join(proper, "hash", "left_anti")
    return turns.join(kept.select("conv_id"), "conv_id", "left_semi")


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, chat): each conversation as one text, every turn as start, role, newline, text, end.

    Markers inside a turn's text are broken by a zero-width space after their first character, so that a text cannot
    open or close a turn. Input as collapse_snapshots returns it.
    """

    def safe(c):
        for mark in (start, end):
            c = F.replace(c, F.lit(mark), F.lit(mark[0] + "​" + mark[1:]))
        return c

    part = F.concat(F.lit(start), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(end))
    key = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "text", part.alias("part"))
    return (
        turns.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(key)).alias("all"))
        .select(
            "conv_id",
            F.size("all").cast("long").alias("n_turns"),
            F.array_join(F.transform("all", lambda t: t["part"]), "\n").alias("chat"),
        )
    )


def format_chats(df: DataFrame, **columns: str) -> DataFrame:
    """Collapse, then render."""
    return render(collapse_snapshots(df, **columns))
