"""Lloyd's clustering over shards of columns: partial distances are exact integers, and each shard updates its own slice
of the centroids."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.storage import materialise

SAFE = 1 << 27  # up to this size, the squares of 64 differences add up within 64 bits
LONG = (1 << 63) - 1


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers: of 64 bits where distances fit, else Python's own."""
    small = np.floor(x * scale)
    if np.abs(small).max(initial=0) <= SAFE:
        return small.astype(np.int64)
    # From 2^53 on a double is a whole number, whose product may pass the largest double.
    whole = [int(np.floor(c * scale)) if abs(c) < 1 << 53 else int(c) * scale for c in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def partial_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids over these columns alone: one row a row, one column a centroid."""
    out = [((rows - c) ** 2).sum(axis=1) for c in centroids]
    return np.stack(out, axis=1)


def vectors(df: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the vectors of exactly dim components, none of them null or not finite."""
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        df.filter(F.size(F.col(vector_col)) == dim)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda c: c.cast("double")).alias("x"))
        .filter(finite)
    )


def shards(kept: DataFrame, width: int, rows: int, scale: int) -> DataFrame:
    """(block, part, ids, slice): blocks of up to `rows` vectors as each task meets them, cut into parts of `width`
    columns. ids stands with part 0. No row is shuffled; as the table is written, blocks keep their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                v = scaled(x, scale)
                cuts = range(0, v.shape[1], width)
                ids = batch.column("vec_id").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(cuts), pa.int64()),
                        pa.array(range(len(cuts)), pa.int32()),
                        pa.array([ids] + [None] * (len(cuts) - 1), pa.list_(pa.int64())),
                        pa.array([pickle.dumps(np.ascontiguousarray(v[:, c : c + width])) for c in cuts], pa.binary()),
                    ],
                    ["block", "part", "ids", "slice"],
                )
                block += 1

    return materialise(kept.mapInArrow(run, "block long, part int, ids array<long>, slice binary"), "vector-shards")


def seeds(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of smallest sha256 of `salt:vec_id`, in that order; repeated ids by vector, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in first])


def lloyd(
    df: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dim: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    salt: str = "2",
    width: int = 16,
    rows: int = 1024,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector with exactly dim
    components, none null or non-finite, each taken as floor(scale * component).

    A shard holds `width` columns of a block of vectors. In each round every shard adds its partial squared distances to
    its slice of the centroids; reduceByKey sums a block's shards, whose argmin (ties: the smaller number) goes back to
    them; each sums the columns of its vectors by cluster, and the new slice is the exact floor of sum by count. Shards
    never move after their first dealing: distances and cluster numbers do. Empty centroids stay. What comes to the
    driver is k times dim numbers.

    Rows that repeat an id, or have none, are vectors of their own. With fewer than k vectors there are fewer clusters.
    Components too large for 64-bit distances are reckoned in Python's integers; a distance or sum that passes 64 bits is
    null. Other columns do not matter. An empty table gives an empty table.
    """
    spark = df.sparkSession
    kept = vectors(df, dim, id_col, vector_col)
    table = shards(kept, width, rows, scale)
    schema = "block long, cluster array<int>, distance array<long>"
    centroids = seeds(kept, k, salt)
    if not len(centroids):
        done = spark.createDataFrame([], schema)
        facts = []
    else:
        centroids = scaled(centroids, scale)
        cuts = [slice(c, min(dim, c + width)) for c in range(0, dim, width)]
        deal = max(spark.sparkContext.defaultParallelism, -(-table.count() // 64))
        held = (
            table.select("block", "part", "slice")
            .rdd.map(lambda r: ((r["block"], r["part"]), pickle.loads(r["slice"])))
            .partitionBy(deal)
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        try:
            for _ in range(rounds):
                centroids = _updated(held, _distances(held, centroids, cuts, deal), centroids, cuts, deal)
            found = _distances(held, centroids, cuts, deal).map(_nearest)
            done = materialise(spark.createDataFrame(found, schema), "vector-clusters")
        finally:
            held.unpersist()
        facts = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    ids = table.filter("part = 0").select("block", "ids")
    each = (
        done.join(ids, "block")
        .select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("z"))
        .select(F.col("z.ids").alias("vec_id"), F.col("z.cluster").alias("cluster"), F.col("z.distance").alias("distance"))
    )
    wide = F.col("distance").cast("decimal(38,0)")
    whole = F.when(F.count("*") == F.count("distance"), F.sum(wide)).alias("s")
    sums = {r["cluster"]: r["s"] for r in each.groupBy("cluster").agg(whole).collect()}
    total = None if None in sums.values() else sum(sums.values())

    def long(x: int | None) -> int | None:
        return int(x) if x is not None and x <= LONG else None

    known = [(i, long(sums.get(i)), long(total), sha) for i, sha in facts]  # k rows
    by_cluster = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return each.join(F.broadcast(by_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _distances(held: RDD, centroids: np.ndarray, cuts: list[slice], deal: int) -> RDD:
    """(block, distances): each block's squared distances to all centroids, summed over its shards."""
    sent = held.context.broadcast(centroids)
    partial = held.map(lambda s: (s[0][0], partial_distances(s[1], sent.value[:, cuts[s[0][1]]])))
    return partial.reduceByKey(np.add, deal)


def _nearest(block: tuple[int, np.ndarray]) -> tuple[int, list[int], list[int | None]]:
    at = block[1].argmin(axis=1)
    least = block[1].min(axis=1).tolist()
    return block[0], at.tolist(), [d if d <= LONG else None for d in least]


def _updated(held: RDD, distances: RDD, centroids: np.ndarray, cuts: list[slice], deal: int) -> np.ndarray:
    """The centroids after a round; each slice is summed where its shards are."""
    k, parts = len(centroids), len(cuts)
    told = distances.flatMap(lambda b: [((b[0], p), b[1].argmin(axis=1)) for p in range(parts)]).partitionBy(deal)

    def sums(both: tuple[list, list]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        cluster = dict(both[1])
        for (block, part), rows in both[0]:
            at = cluster[block, part]
            total = np.zeros((k, rows.shape[1]), rows.dtype)
            np.add.at(total, at, rows)
            yield part, (total, np.bincount(at, minlength=k))

    # Shards and what they are told are dealt alike, so they meet partition by partition.
    added = held.glom().zip(told.glom()).flatMap(sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), deal)
    out = centroids.astype(object)
    for part, (total, count) in added.collect():  # k numbers a column
        some = np.flatnonzero(count)
        out[some, cuts[part]] = total[some].astype(object) // count[some, None].astype(object)
    return out.astype(np.int64) if max(map(abs, out.ravel().tolist()), default=0) <= SAFE else out
