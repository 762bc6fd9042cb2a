"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.storage import checkpointed


ROWS = 50_000  # edges of a partition, about, between the steps of a round
LEAST = 8  # partitions


def _pairs(*named: tuple[str, str]) -> Column:
    """Several rows of two columns from each row, which is read once."""
    return F.inline(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in named]))


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(_pairs(("a", "b"), ("b", "a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return joined.select(_pairs(("m", "a"), ("m", "b"))).toDF("a", "b").filter("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that can be reached.

    Alternates large-star and small-star rounds, each a grouped minimum and an equi-join (which AQE splits where a
    hub is hot), until the edge set stands still. Rounds grow with the logarithm of the longest path. Null ends and
    loops are ignored, so a node without any other link is absent. An empty table gives an empty table. Few edges stay
    in few partitions, as each partition of a step leaves files of its own behind.
    """
    now = checkpointed(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
        .filter("x is not null and y is not null and a <> b")
        .select("a", "b")
        .distinct()
    )

    def state(df: DataFrame) -> tuple:
        # The sum is a decimal: it cannot overflow, and equal edge sets give equal sums in any order.
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    if before[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        parts = max(LEAST, -(-before[0] // ROWS))
        tied = _large_star(now.coalesce(parts)).coalesce(parts)  # as many edges at most
        now = checkpointed(_small_star(tied).coalesce(parts))
        after = state(now)
        if after == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
