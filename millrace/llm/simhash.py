"""SimHash near-duplicates: every pair of tiles of fingerprints that can hold a link is compared bit by bit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name, map_texts, texts
from millrace.operators.graph import components
from millrace.plans.storage import materialise

SEGMENTS = 4  # 16-bit words of a fingerprint whose population counts make a tile's profile
SLICE = 1 << 15  # shingles hashed and counted at a time


def fingerprint(text: str, shingle_words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: bit i is set if it is set in over half of the shingles' XXH64 values.

    Repeats count. Fewer words than a shingle make one shingle; no word gives zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII spaces matter
    if not words:
        return 0
    last = max(1, len(words) - shingle_words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, last, SLICE):
        part = words[at : min(last, at + SLICE) + shingle_words - 1]
        if len(part) <= shingle_words:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle_words)), strict=False))
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > last).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, h, fp): h is xxhash64 of the text, fp the fingerprint's 64 bits as a signed long. One row for each row
    of df."""

    def make() -> Callable[[list[str]], list[pa.Array]]:
        return lambda part: [pa.array(np.array([fingerprint(t, shingle_words) for t in part], np.uint64).view(np.int64))]

    return map_texts(texts(df, id_col, text_col).withColumn("h", F.xxhash64("text")), make, "fp long")


def _profile(fp: str) -> list[Column]:
    width = 64 // SEGMENTS
    return [
        F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1))) for k in range(SEGMENTS)
    ]


def _steps(radius: int) -> list[list[int]]:
    """Profile differences within the radius, one of each opposite pair: two fingerprints differ in at least as many
    bits as their population counts do, word by word."""
    near = [s for s in product(range(-radius, radius + 1), repeat=SEGMENTS) if sum(map(abs, s)) <= radius]
    return [list(s) for s in near if s >= (0,) * SEGMENTS]


def _forest(i: np.ndarray, j: np.ndarray, parent: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Of the links i-j, those that join what was apart so far."""
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = x, y
        while (up := parent.setdefault(a, a)) != a:
            parent[a] = a = parent[up]
        while (up := parent.setdefault(b, b)) != b:
            parent[b] = b = parent[up]
        if a != b:
            parent[a] = b
            yield x, y


def compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links between two tiles of distinct fingerprints, as a spanning forest: it has the links' components, and
    fewer links than the tiles have fingerprints."""
    found: list[tuple[int, int]] = []
    parent: dict[int, int] = {}
    step = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            found += _forest(i, j if same else j + len(a), parent)
    offset = 0 if same else len(a)
    return [(int(a[x]), int(b[y - offset])) for x, y in ((min(p), max(p)) for p in found)]


def links(distinct: DataFrame, radius: int = 3, tile_rows: int = 2048) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column fp that differ in at most radius bits, thinned to
    a spanning forest for each pair of tiles.

    A tile holds fingerprints of one population-count profile (counts of each 16-bit word), hashed into blocks of
    about tile_rows. A pair of tiles is skipped when its profiles differ by more than the radius, which no link can
    bridge; all other pairs are compared exhaustively with exclusive-or and bit counts.
    """
    profiled = distinct.select("fp", F.array(*_profile("fp")).alias("tile"))
    # At most 17^4 profiles, whatever the input: a bounded table.
    blocks = materialise(profiled.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).alias("blocks")), "simhash-blocks")
    tiles = (
        profiled.join(F.broadcast(blocks), "tile")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        .groupBy("tile", "block")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = materialise(tiles, "simhash-tiles")
    steps = F.array(*[F.array(*[F.lit(x) for x in s]) for s in _steps(radius)])
    # Which blocks meet which: named by tile and block, so that the pairs of a common profile are spread as well.
    meets = (
        tiles.select(F.col("tile").alias("ltile"), F.col("block").alias("lblock"), F.explode(steps).alias("step"))
        .select("ltile", "lblock", F.zip_with("ltile", "step", lambda x, d: x + d).alias("tile"))
        .join(F.broadcast(blocks), "tile")
        .select("ltile", "lblock", "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        .filter("tile <> ltile or lblock <= block")
    )
    left = tiles.select(F.col("tile").alias("ltile"), F.col("block").alias("lblock"), F.col("fps").alias("lfps"))
    pairs = (
        meets.join(left, ["ltile", "lblock"])
        .join(tiles, ["tile", "block"])
        .select("lfps", "fps", F.expr("tile = ltile and lblock = block").alias("same"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b, same in zip(batch["lfps"], batch["fps"], batch["same"], strict=True):
                out += compare(np.asarray(a, np.int64), np.asarray(b, np.int64), radius, bool(same))
            yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return pairs.mapInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(doc_id, h, fp, component_id) for every row of df: component_id is the smallest doc_id that links reach, h is
    xxhash64 of the text.

    Fingerprints are compared once each, however many documents share one, so copies cost one row. Null texts count
    as empty, and texts without a word share fingerprint zero, which links like any other. Rows that repeat an id
    stay as they are; a null id keeps its row but is never a component's id (a component of null ids alone has a null
    one). An empty table gives an empty table.
    """
    marked = materialise(fingerprints(df, id_col, text_col), "simhash")
    # One row a fingerprint, however often it occurs.
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, radius), "a", "b").select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(member, "fp").select("doc_id", "h", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The rows of df whose id is the smallest of its component; columns as in df.

    Rows that repeat the kept id all stay. Rows with a null id stay too: nothing tells which of them to keep. An id with
    several texts is judged text by text.
    """
    found = near_duplicates(df, id_col, text_col, radius)
    gone_id, gone_h = free_name(df, "gone_id"), free_name(df, "gone_h")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)).distinct()
    same = (F.col(id_col).cast("long") == F.col(gone_id)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(gone_h))
    return df.join(gone, same, "left_anti")
