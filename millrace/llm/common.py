"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns, whatever their names, never reach an operator. Null texts are empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo folds; null ids fall in fold 0 of the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or where df has such a column (in any case), the first of name_2, name_3, ... that it has not."""
    taken = {c.lower() for c in df.columns}
    found, k = name, 1
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], Sequence[pa.Array]]],
    schema: str,
    text_col: str = "text",
    rows: int = 1024,
) -> DataFrame:
    """df's columns but the text, and new ones computed from it, row by row, in Arrow batches.

    make() is called once a task and gives a function from some texts to the new columns. The other columns pass
    through as they are: an id beside a null id does not turn into a float on its way. schema names the new columns.
    """
    kept = [c for c in df.columns if c != text_col]
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        names = None
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                new = compute(batch.column(text_col).to_pylist())
                if names is None:
                    names = kept + [x.strip().split(" ")[0] for x in schema.split(",")]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names)

    return df.select(*kept, text_col).mapInArrow(run, types)


BLOCK = 1 << 15  # numbers of an array that travel in one row


def summed(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], tasks: int) -> np.ndarray | None:
    """The sum of the arrays that run() makes of each partition of df (None: nothing), as float64.

    All arrays have one length, which the model fixes whatever the input, so the sum may come to the driver. It is made
    in two steps, blocks of the arrays from about the root of the tasks at a time, so that no group holds all parts.
    """
    schema = "block int, task int, part binary"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = run(batches)
        if flat is not None:
            cuts = range(0, len(flat), BLOCK)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(cuts)), pa.int32()),
                    pa.array([task] * len(cuts), pa.int32()),
                    pa.array([flat[c : c + BLOCK].astype(np.float32).tobytes() for c in cuts], pa.binary()),
                ],
                ["block", "task", "part"],
            )

    def add(kind: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def total(batch: pd.DataFrame) -> pd.DataFrame:
            out = sum(np.frombuffer(p, kind).astype(np.float64) for p in batch["part"])
            return pd.DataFrame({"block": batch["block"].iloc[:1], "task": batch["task"].iloc[:1], "part": [out.tobytes()]})

        return total

    fan = max(1, round(tasks**0.5))
    some = df.mapInArrow(parts, schema).groupBy("block", F.pmod("task", F.lit(fan)).alias("some"))
    whole = some.applyInPandas(add(np.float32), schema).groupBy("block").applyInPandas(add(np.float64), schema)
    found = {r["block"]: np.frombuffer(r["part"]) for r in whole.collect()}
    return np.concatenate([found[k] for k in sorted(found)]) if found else None
