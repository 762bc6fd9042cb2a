"""Neighbours in time by sorted sweeps: every row meets sums of others, never the others one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _codes(rows: DataFrame, owner: str) -> tuple[DataFrame, int]:
    """(owner, code): a number from 0 for each distinct owner, and how many bits it takes."""
    owners = rows.select(owner).distinct()
    coded = owners.withColumn("code", F.row_number().over(Window.orderBy(owner)) - 1)
    n = owners.count()
    return coded, max(1, (max(n, 1) - 1).bit_length())


def first_by_another(rows: DataFrame, key: str, owner: str, at: str, number: str, width: int, most_parts: int = 48) -> DataFrame:
    """(number, other): for each row the smallest number among rows of the same key and another owner whose time differs
    by at most `width`; rows without any are left out.

    rows has one row a number, times as long integers. Rows with a null key, owner or time take no part.

    Two owners are different if a bit of their codes is, so the smallest number of another owner is the least of some
    smallest numbers, one for each bit of the code: these can be merged, in any order, without the rows. The window is cut
    into parts of one length: whole parts are summed once, and what reaches into the parts at both ends comes from running
    sums over these parts, forth and back. Work is linear in the rows of a key, however many there are, and a key is
    spread over its parts.
    """
    known = rows.select(F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(at).alias("at"), F.col(number).alias("number"))
    known = known.filter("key is not null and owner is not null and at is not null and number is not null")
    codes, bits = _codes(known, "owner")
    parts = next(k for k in range(min(most_parts, max(1, width)), 0, -1) if width % k == 0)
    length = width // parts if width else 1
    reach = parts if width else 0
    known = known.join(codes, "owner").withColumn("part", F.floor(F.col("at") / F.lit(length)).cast("long"))
    names = [f"m{b}{v}" for b in range(bits) for v in (0, 1)]

    def has(b: int, v: int) -> Column:
        return F.shiftright("code", b).bitwiseAND(F.lit(1)) == v

    own = [F.when(has(b, v), F.col("number")).alias(f"m{b}{v}") for b in range(bits) for v in (0, 1)]
    merged = [F.min(n).alias(n) for n in names]
    instants = known.select("key", "part", "at", *own).groupBy("key", "part", "at").agg(*merged)
    none = F.lit(None).cast("long")

    def best(df: DataFrame) -> DataFrame:
        """The least number of another owner that the merged columns of a row know of."""
        other = F.array_min(F.array(*[F.when(has(b, 0), F.col(f"m{b}1")).otherwise(F.col(f"m{b}0")) for b in range(bits)]))
        return df.select("number", other.alias("other")).filter("other is not null")

    # Whole parts: those within reach on both sides.
    sums = instants.groupBy("key", "part").agg(*merged)
    inner = Window.partitionBy("key").orderBy("part").rangeBetween(-max(0, reach - 1), max(0, reach - 1))
    whole = sums.select("key", "part", *[F.min(n).over(inner).alias(n) for n in names])
    found = best(known.join(whole, ["key", "part"]))

    # The parts at both ends: a row asks there at the last time it reaches.
    ask = known.select("key", "code", "number", "at")
    for sign in (1, -1):
        to = F.col("at") + sign * width
        asked = ask.withColumn("at", to).withColumn("part", F.floor(F.col("at") / F.lit(length)).cast("long"))
        both = instants.select("key", "part", "at", F.lit(0).alias("asks"), none.alias("number"), F.lit(None).cast("int").alias("code"), *names).unionByName(
            asked.select("key", "part", "at", F.lit(1).alias("asks"), "number", "code", *[none.alias(n) for n in names])
        )
        running = Window.partitionBy("key", "part").orderBy(F.col("at") * sign, "asks").rowsBetween(Window.unboundedPreceding, 0)
        reached = both.select("key", "number", "code", "asks", *[F.min(n).over(running).alias(n) for n in names])
        found = found.unionByName(best(reached.filter("asks = 1")))
    return found.groupBy("number").agg(F.min("other").alias("other"))
