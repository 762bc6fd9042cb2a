"""Exact Jaccard join of shingle sets: inverted lists of rare shingles are merged, common ones are probed."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bits import bit_table, holds
from millrace.llm.common import summed, texts
from millrace.llm.words import Words, chunks, cut, mixed, translation
from millrace.operators.graph import components
from millrace.plans.storage import materialise

WORDS = translation(breaks=b"", spaces=b"\x09\x0a\x0b\x0c\x0d")
BUCKETS = 20  # bits of the table of shingle counts: 2^20 numbers, whatever the input
ROUNDS = 2  # of comparing with the heads of lists; what they leave is searched for in full
QUERIES = 256  # whose lists are taken out of a batch and merged at a time
CHUNK = 1 << 18  # bytes of text that are cut at a time: their numbers take some forty times as much
LIST = 256  # about as many entries of an inverted list travel in one row


def shingle_sets(words: Words, n_texts: int, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of `size` words: of all its words if they are
    fewer, none if it has no word."""
    each = words.hashes()
    folded, run = [each], each
    for k in range(1, size):
        run = mixed(run[: max(0, len(each) - k)], each[k:])
        folded.append(run)
    first = np.searchsorted(words.text, np.arange(n_texts + 1))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        k = min(size, b - a)
        out.append(np.unique(folded[k - 1][a : b - k + 1]) if k else np.zeros(0, np.uint64))
    return out


def short_lists(n: int, percent: int) -> int:
    """How many of a set's n shingles, rarest first, are looked up: all but the ceil(share * n) - 1 commonest, its long
    lists. What has ceil(share * n) in common with the set, the least that a link takes, is in one of them."""
    return n + percent * -n // 100 + 1


def occurrences(n: int, m: int, percent: int) -> int:
    """In how many short lists sets of n and m shingles must meet to link: the T they must have in common less the long
    lists of the larger. Up to the rarer one of the two last shingles looked up, both have looked up all."""
    return -(percent * -(n + m) // (100 + percent)) + percent * -max(n, m) // 100 + 1


def overlap(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """How many of a are in the sorted b, by binary search; may stop short once `need` is out of reach."""
    found = 0
    for at in range(0, len(a), 1024):
        part = a[at : at + 1024]
        place = np.searchsorted(b, part)
        found += int((b[np.minimum(place, len(b) - 1)] == part).sum())
        if found + len(a) - at - len(part) < need:
            break
    return found


def merged(lists: list[np.ndarray]) -> list[tuple[int, int]]:
    """(id, in how many lists) by a heap over sorted lists."""
    return [(int(i), sum(1 for _ in same)) for i, same in groupby(heapq.merge(*lists))]


def _key(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mixed(ids.view(np.uint64), text)


def _hashed(batch: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, batch), np.uint64, len(batch))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents' shingles fall in each of 2^BUCKETS buckets. Only the order in which shingles are looked up
    comes from it, so that common ones come last; results do not depend on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(1 << BUCKETS)
        for batch in batches:
            for _, part in chunks(batch.column("text"), most=CHUNK):
                for s in shingle_sets(cut(part, WORDS), len(part), size):
                    total[(s >> np.uint64(64 - BUCKETS)).astype(np.int64)] += 1  # distinct, but buckets may repeat
        return total

    found = summed(docs, run, docs.rdd.getNumPartitions())
    return np.zeros(1 << BUCKETS) if found is None else found


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(rid, doc_id, key, th, n, digest, lead): for every row of (doc_id, text) its number, hashes of id and text, the size
    and a 128-bit digest of its shingle set, and the shingles to be looked up, rarest first."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, size).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            for first, part in chunks(batch.column("text"), most=CHUNK):
                sets = shingle_sets(cut(part, WORDS), len(part), size)
                th = _hashed(part)
                leads = []
                for s in sets:
                    rare = np.lexsort((s, counts.value[(s >> np.uint64(64 - BUCKETS)).astype(np.int64)]))
                    leads.append(s[rare[: short_lists(len(s), percent) if len(s) else 0]].view(np.int64))
                flat = np.concatenate(leads) if leads else np.zeros(0, np.int64)
                offsets = np.cumsum([0] + [len(x) for x in leads])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(part)),
                        pa.array(_key(ids[first : first + len(part)], th).view(np.int64)),
                        pa.array(th.view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                    ],
                    ["doc_id", "key", "th", "n", "digest", "lead"],
                )

    schema = "doc_id long, key long, th long, n long, digest binary, lead array<long>"
    # Numbers are given before the table is written, and read from it ever after.
    return materialise(docs.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "jaccard-rows")


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, th, shingles) for the documents whose (key, th) are wanted, and a few more: the sorted set as bytes. A bit
    table tells which texts have to be cut at all."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            for first, part in chunks(batch.column("text"), most=CHUNK):
                th = _hashed(part)
                key = _key(ids[first : first + len(part)], th)
                some = np.flatnonzero(holds(table.value, key))
                if len(some):
                    sets = shingle_sets(cut([part[i] for i in some], WORDS), len(some), size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key[some].view(np.int64)),
                            pa.array(th[some].view(np.int64)),
                            pa.array([s.tobytes() for s in sets], pa.binary()),
                        ],
                        ["key", "th", "shingles"],
                    )

    found = docs.mapInArrow(run, "key long, th long, shingles binary").join(wanted, ["key", "th"], "left_semi")
    return found.groupBy("key", "th").agg(F.first("shingles").alias("shingles"))


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of (x, y) whose sets have at least `percent` of their union in common; sets tells (sid, key, th)."""

    def named(c: str) -> DataFrame:
        return sets.select(F.col("sid").alias(c), F.col("key").alias(f"{c}_key"), F.col("th").alias(f"{c}_th"))

    told = materialise(pairs.select("x", "y").join(named("x"), "x").join(named("y"), "y"), "jaccard-pairs")
    wanted = told.select(F.explode(F.array(*[F.struct(F.col(f"{c}_key").alias("key"), F.col(f"{c}_th").alias("th")) for c in "xy"])).alias("k"))
    whole = whole_sets(docs, wanted.select("k.*").distinct(), size)

    def side(c: str) -> DataFrame:
        return whole.select(F.col("key").alias(f"{c}_key"), F.col("th").alias(f"{c}_th"), F.col("shingles").alias(c + c))

    both = told.join(side("x"), ["x_key", "x_th"]).join(side("y"), ["y_key", "y_th"]).select("x", "y", "xx", "yy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("xx").to_pylist(), batch.column("yy").to_pylist(), strict=True):
                p, q = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both_n = len(p) + len(q)
                need = -(-percent * both_n // (100 + percent))
                common = overlap(p, q, need) if min(len(p), len(q)) >= need else 0
                keep.append(100 * common >= percent * (both_n - common))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(run, "x long, y long"), "jaccard-links")


def _fit(a: str, b: str, percent: int) -> str:
    """SQL: sets of these sizes can link."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def postings(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(w, sid, n): the inverted lists, one row an entry, of the shingles that sets look up; lists of one row are left
    out. Entries are dealt once, by w, and sizes come after most of them have gone."""
    each = rows.select(F.col("rid").alias("sid"), F.explode("lead").alias("w"))
    live = each.withColumn("rows", F.count("*").over(Window.partitionBy("w"))).filter("rows > 1").select("w", "sid")
    # Copies go: of equal sets, all with equal lists, the first row stands for all.
    return materialise(live.join(sets.select("sid", "n"), "sid").select("w", "sid", "n"), "jaccard-postings")


def _owned(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The lists with the component of each entry and its number of sets (cs)."""
    lists = lists.select("w", "sid", "n")
    if roots is None:
        return lists.select("*", F.col("sid").alias("comp"), F.lit(1).cast("long").alias("cs"))
    sized = roots.join(roots.groupBy("root").agg(F.count("*").alias("cs")), "root")
    known = lists.join(sized.withColumnRenamed("node", "sid"), "sid", "left")
    return known.select(*lists.columns, F.coalesce("root", "sid").alias("comp"), F.coalesce("cs", F.lit(1)).alias("cs"))


def stars(lists: DataFrame, tried: DataFrame | None, percent: int, k: int) -> DataFrame:
    """(x, y): for each set up to k others of other components, each the smallest of such in some of its lists: those that
    it shares most lists with, and as many as a link takes; what meets in fewer is left to search(). Each entry is
    compared with two of its list, whatever its length."""
    of_list = Window.partitionBy("w")
    entry = F.struct("n", "sid", "comp")
    both = lists.withColumn("first", F.min(entry).over(of_list))
    both = both.withColumn("second", F.min(F.when(F.col("comp") != F.col("first.comp"), entry)).over(of_list)).filter("second is not null")
    head = F.when(F.col("comp") == F.col("first.comp"), F.col("second")).otherwise(F.col("first"))
    met = both.select("sid", "n", head.alias("h")).filter(_fit("n", "h.n", percent))
    pair = F.least("sid", "h.sid").alias("x"), F.greatest("sid", "h.sid").alias("y")
    met = met.groupBy(*pair, "sid").agg(F.count("*").alias("shared"), F.max("n").alias("n"), F.max("h.n").alias("m"))
    met = met.filter(f"shared > ceil({percent} * (n + m) / (100 + {percent})) - ceil({percent} * greatest(n, m) / 100)")  # occurrences()
    if tried is not None:
        met = met.join(tried, ["x", "y"], "left_anti")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("s"), "x", "y"))), 1, k)
    return met.groupBy("sid").agg(best.alias("best")).select(F.inline("best")).select("x", "y").distinct()


def unsettled(lists: DataFrame) -> DataFrame:
    """The lists whose sets stand in several components, with the largest component (main) and the length (size) of each.
    Components only grow together: what is left out here needs not be looked at again."""
    of_list = Window.partitionBy("w")
    told = lists.select(
        "*",
        F.max(F.struct("cs", "comp")).over(of_list)["comp"].alias("main"),
        F.min("comp").over(of_list).alias("low"),
        F.max("comp").over(of_list).alias("high"),
        F.count("*").over(of_list).alias("size"),
    )
    return materialise(told.filter("low < high").drop("low", "high"), "jaccard-mixed")


def candidates(lists: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """(x, y): what search() finds in any lists with their components."""
    return search(unsettled(lists), percent, most)


def search(mixed_lists: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """(x, y): sets of different components that meet in so many short lists that they may link, x the smaller id.

    Components are ordered by size. Of each list, the entries outside its largest component are queries, and meet those
    of larger components alone: so all that two sets share is counted for the same one of them, once a list. Every query
    merges its lists, in rows of about LIST entries that were spread by set, and keeps what occurs often enough: of each
    row all, or the `most` that occur most.
    """
    spread = -(-(mixed_lists.agg(F.max("size")).first()[0] or 1) // LIST)
    rows = (
        mixed_lists.groupBy("w", F.pmod(F.xxhash64("sid"), F.lit(spread)).alias("share"))
        .agg(F.array_sort(F.collect_list(F.struct("sid", "n", "comp", "cs"))).alias("entries"))
        .withColumnRenamed("w", "v")
    )
    queries = mixed_lists.filter("comp <> main").select("w", F.col("sid").alias("x"), F.col("n").alias("xn"), F.col("comp").alias("xc"), F.col("cs").alias("xs"))
    fits = F.expr(f"filter(entries, e -> (e.cs > xs or (e.cs = xs and e.comp > xc)) and {_fit('e.n', 'xn', percent)})")
    held = (
        queries.join(rows, F.col("w") == F.col("v"))
        .select("x", "xn", "share", fits.alias("e"))
        .filter(F.size("e") > 0)
        .groupBy("x", "xn", "share")
        .agg(F.collect_list("e.sid").alias("ids"), F.collect_list("e.n").alias("sizes"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(at, QUERIES).to_pandas()
                found = []
                for x, n, ids, sizes in zip(batch["x"], batch["xn"], batch["ids"], batch["sizes"], strict=True):
                    size = dict(zip(np.concatenate(ids).tolist(), np.concatenate(sizes).tolist(), strict=True))
                    met = [(-c, y) for y, c in merged(list(ids)) if c >= occurrences(n, size[y], percent)]
                    found += [(x, y) for _, y in (met if most is None else heapq.nsmallest(most, met))]
                pairs = np.array(found, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

    met = held.select("x", "xn", "ids", "sizes").mapInArrow(run, "x long, y long")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_duplicates(
    df: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of df: the number of its distinct shingles of `size` words and the
    smallest doc_id that links reach. Two rows link when 100 * intersection >= percent * union of their sets, which is
    computed in full.

    Equal sets are one. Sets that link meet in some of the lists of their rarest shingles; their commonest ones, the long
    lists, are only probed. In a few rounds each set is compared with the smallest ones of its lists that stand in other
    components; then a T-occurrence search merges the lists of whatever still stands in different components of one, and
    what occurs in as many as a link takes is probed, the likeliest first and at last all that is left. So a group of near copies is joined through a few of them, and not
    compared pair by pair.

    Null texts count as empty; rows without a word are components of their own, unless they repeat an id. Rows that
    repeat an id stay as they are; a null id is never a component's id where another is in it. Very long texts are read
    whole; other columns do not matter. An empty table gives an empty table.
    """
    docs = texts(df, id_col, text_col)
    rows = signatures(docs, size, percent)
    sets = materialise(
        rows.filter("n > 0")
        .groupBy("digest")
        .agg(F.min(F.struct("rid", "key", "th", "n")).alias("one"), F.min("doc_id").alias("least"))
        .select("digest", F.col("one.rid").alias("sid"), F.col("one.key").alias("key"), F.col("one.th").alias("th"), F.col("one.n").alias("n"), "least"),
        "jaccard-sets",
    )
    lists = postings(rows, sets)
    links, tried, roots = None, None, None
    for _ in range(ROUNDS):
        tests = materialise(stars(_owned(lists, roots), tried, percent, k=2), "jaccard-stars")
        good = verified(docs, tests, sets, size, percent)
        links = good if links is None else links.union(good)
        tried = tests if tried is None else tried.union(tests)
        if good.isEmpty():
            break
        roots = components(links, "x", "y")
    # The likeliest first: what they join need not be compared. The last turn leaves none out.
    for most in (4, 64, None):
        lists = unsettled(_owned(lists, roots))
        rest = materialise(search(lists, percent, most).join(tried, ["x", "y"], "left_anti"), "jaccard-rest")
        if not rest.isEmpty():
            tried = tried.union(rest)
            good = verified(docs, rest, sets, size, percent)
            if not good.isEmpty():
                links = links.union(good)
                roots = components(links, "x", "y")
    roots = roots if roots is not None else components(links, "x", "y")
    roots = roots.select(F.col("node").alias("sid"), "root")
    rooted = sets.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(least, "root").select("digest", "component_id")
    return rows.join(member, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
