"""Sharding along a Hilbert curve through several metadata dimensions, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.storage import materialise

BITS = 4  # of each dimension
DIMENSIONS = ("lang", "source", "size")
RUN = 20_000  # rows of a cell that are ranked in one task


def prefix_number(c: Column) -> Column:
    """The first six bytes of a text as a number that orders as the bytes do; null is 0."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def hilbert_index(axes: Column, dims: int, bits: int = BITS) -> Column:
    """Index along the Hilbert curve of an array of `dims` ints of `bits` bits each, by the transpose method: undo the
    excess work from the highest bit down, Gray encode, then interleave."""
    zero = F.lit(0)
    steps = F.array(
        *[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dims)]
    )

    def undo(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        here = F.get(x, s["i"])
        swap = F.get(x, zero).bitwiseXOR(here).bitwiseAND(low)
        invert = here.bitwiseAND(s["q"]) != 0
        return F.transform(
            x,
            lambda v, k: F.when(invert, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
            .when((k == 0) | (k == s["i"]), F.when(s["i"] == 0, v).otherwise(v.bitwiseXOR(swap)))
            .otherwise(v),
        )

    undone = F.aggregate(steps, axes, undo)
    gray = F.transform(
        F.sequence(zero, F.lit(dims - 1)),
        lambda k: F.aggregate(F.slice(undone, 1, k + 1), zero, lambda acc, v: acc.bitwiseXOR(v)),
    )
    flips = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]),
        zero,
        lambda t, q: F.when(F.get(gray, F.lit(dims - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    )
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])
    return F.aggregate(
        places,
        zero,
        lambda acc, p: acc * 2
        + F.when(
            F.get(gray, p["i"]).bitwiseXOR(flips).bitwiseAND(F.call_function("shiftleft", F.lit(1), p["b"])) != 0, 1
        ).otherwise(0),
    )


def hilbert_shards(
    df: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row.

    Language, source and size are quantised at the sixteenths of the whole table (texts by their first six bytes; a null
    is the lowest value): a value that holds several sixteenths skips as many levels, so that columns of few values reach
    the curve's highest bits too. A row's cell is its place on the Hilbert curve through these three dimensions. Rows with
    equal texts lie in one cell, that of their least language and source, side by side. Runs of equal row counts are
    cut (law `rows`: counts differ by one at most), so a shard's files cover few values of every dimension, and only
    the copies at a cut, of one text for each cut, lie in two shards (a text with more copies than a shard has rows: in
    as many as it must). size: UTF-8 bytes of the text, none for null, plus 1. slot: place in the shard, from 0.
    grown_shard is null under this law.

    Within a cell the texts that have over a run of copies come first, then the others by a hash of the text; equal
    texts go by id. Rows alike in id and text are told apart by nothing: they take neighbouring slots in either order.
    A null text counts as empty. An empty table gives an empty table. A hot cell is split by the text's hash, and a hot
    text by a hash of the id (null ids by lot), into runs of about 20,000 rows, ranked apart; only counts of cells
    (4,096 at most) and of runs meet.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        prefix_number(F.col(lang_col)).alias("d_lang"),
        prefix_number(F.col(source_col)).alias("d_source"),
    )
    rows = rows.withColumn("d_size", F.col("size").cast("double"))
    steps = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    cuts = rows.agg(*[F.percentile_approx(f"d_{d}", steps, 10_000).alias(d) for d in DIMENSIONS]).first()
    level = [
        sum((F.when(F.col(f"d_{d}") > c, 1).otherwise(0) for c in sorted(cuts[d] or [])), F.lit(0))
        for d in DIMENSIONS
    ]
    placed = rows.select("doc_id", "size", "text_crc32", "h", F.array(*level).alias("own_axes"))
    # One row a text: partial counts and minima go through the shuffle, however many copies there are.
    same = ["h", "text_crc32", "size"]
    groups = placed.groupBy(*same).agg(F.min("own_axes").alias("axes"), F.count("*").alias("copies"))
    groups = materialise(groups, "groups")
    # 16^3 cells at most, whatever the input.
    cells = groups.groupBy("axes").agg(F.sum("copies").alias("cell_rows"), F.sum(F.when(F.col("copies") <= RUN, F.col("copies")).otherwise(0)).alias("cold_rows"))
    cells = cells.withColumn("curve", hilbert_index(F.col("axes"), len(DIMENSIONS)))
    ahead = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "axes",
        "curve",
        F.greatest(F.ceil(F.col("cold_rows") / RUN), F.lit(1)).alias("runs"),
        F.coalesce(F.sum("cell_rows").over(ahead), F.lit(0)).alias("cell_at"),
    )
    # Written first: else the optimiser infers a filter on the curve, and computes it for every row.
    cells = materialise(cells, "cells")
    # Texts that have copies, with those copies' cell; a text alone is in its own.
    shared = groups.filter("copies > 1").select(*same, F.col("axes").alias("shared_axes"), "copies")
    with_cell = (
        placed.join(shared, same, "left")
        .withColumn("axes", F.coalesce("shared_axes", "own_axes"))
        .withColumn("copies", F.coalesce("copies", F.lit(1)))
        .join(F.broadcast(cells), "axes")
    )
    hot = F.col("copies") > RUN
    # The hash's upper half, split evenly into as many runs as the cell's cold texts, or the hot text's copies, need.
    upper = F.shiftrightunsigned("h", 32)
    cold_run = F.floor(upper * F.col("runs") / (1 << 32))
    lot = F.when(F.col("doc_id").isNull(), F.floor(F.rand(11) * (1 << 20))).otherwise(0)
    hot_part = F.floor(F.shiftrightunsigned(F.xxhash64("doc_id", "h", lot), 32) * F.ceil(F.col("copies") / RUN) / (1 << 32))
    in_runs = with_cell.select(
        "doc_id", *same, "curve", "cell_at",
        F.struct((~hot).alias("cold"), F.when(hot, F.col("h")).otherwise(cold_run).cast("long").alias("run"), F.when(hot, hot_part).otherwise(0).cast("int").alias("part")).alias("run"),
    )
    in_runs = materialise(in_runs, "placed")
    before = Window.partitionBy("curve").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        in_runs.groupBy("curve", "run", "cell_at")
        .agg(F.count("*").alias("run_rows"))
        .select("curve", "run", (F.col("cell_at") + F.coalesce(F.sum("run_rows").over(before), F.lit(0))).alias("run_at"))
    )
    n = df.count()
    within = Window.partitionBy("curve", "run").orderBy(upper, "h", "text_crc32", "size", "doc_id")
    ranked = (
        in_runs.withColumn("r", F.row_number().over(within) - 1)
        .join(runs, ["curve", "run"])
        .withColumn("rank", F.col("run_at") + F.col("r"))
    )
    shard = F.expr(f"rank * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("curve").cast("int").alias("curve"),
    )
