"""Benchmark decontamination by latent semantic retrieval, verified by longest common subsequences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name, map_texts, summed, texts
from millrace.plans.storage import materialise

WORD = re.compile(r"\w+")
PASSAGE = 64  # words
CHUNK = 1 << 11  # weighted words whose latent vectors are gathered at a time: as many as the processor's cache holds
SLICE = 200_000  # words of a text handled at a time
FOUND = {
    "doc_id": pa.int64(), "h": pa.int64(), "item_id": pa.int64(),
    "coverage": pa.float64(), "answer_coverage": pa.float64(), "place": pa.int64(), "cosine": pa.float64(),
}


@dataclass(frozen=True)
class Settings:
    rank: int = 128  # latent dimensions
    cosine: float = 0.3  # of a passage and an item's direction in the latent space, to become a candidate
    own: float = 0.4  # or, before scaling, this share of the item's own projection
    coverage: float = 0.7  # share of the item's words in the longest common subsequence
    answer: float = 0.6  # the same of the item's last words
    common: float = 0.1  # terms in a larger share of the passages carry no weight
    items_per_block: int = 500  # the latent space has a fixed rank: more items in it than a few times that blur
    seed: int = 11


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_places(item: list[int]) -> dict[int, int]:
    """The places of each word in an item, a bit for each."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    return places


def common_subsequence(a: list[int], places: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of a and an item of n words; what the item lacks matches nothing."""
    full = (1 << n) - 1
    rows = full
    for w in a:
        if m := places.get(w, 0):
            u = rows & m
            rows = ((rows + u) | (rows - u)) & full
    return n - rows.bit_count()


def answer_words(n: int) -> int:
    """How many of an item's last words count as its answer."""
    return min(n, max(3, n // 5))


@dataclass
class Items:
    """A block of benchmark items in the vocabulary of their own words; term 0 stands for every other word."""

    ids: list
    words: list[list[int]]
    vocabulary: dict[str, int]

    @classmethod
    def of(cls, rows: list) -> Items:
        vocabulary: dict[str, int] = {}
        ids, coded = [], []
        for r in rows:
            found = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(r["text"] or "")]
            if found:
                ids.append(r["item_id"])
                coded.append(found)
        return cls(ids, coded, vocabulary)

    @property
    def terms(self) -> int:
        return len(self.vocabulary) + 1


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows sorted each in itself, and where a term starts in one."""
    rows = np.sort(rows, axis=1)
    first = np.ones(rows.shape, bool)
    np.not_equal(rows[:, 1:], rows[:, :-1], out=first[:, 1:])
    return rows, first


class Passages:
    """TF-IDF rows of the passages of PASSAGE words that start every `stride` words of coded texts.

    A row's value at a term is the term's count times its idf. Terms of weight 0 are left out; `length` is each row's
    Euclidean length. Texts lie side by side, each filled up with term 0.
    """

    def __init__(self, coded: np.ndarray, idf: np.ndarray, stride: int = PASSAGE) -> None:
        self.stride, self.idf = stride, idf
        coded = np.where(idf[coded] > 0, coded, 0).astype(coded.dtype)
        coded = np.concatenate([coded, np.zeros(-len(coded) % PASSAGE + PASSAGE - stride, coded.dtype)])
        self.coded = coded
        rows, first = _runs(np.lib.stride_tricks.sliding_window_view(coded, PASSAGE)[::stride])
        # A term that occurs n times adds n^2 idf^2: its first place 1, the others each what n^2 grows by.
        place = np.arange(rows.size)
        begin = np.maximum.accumulate(np.where(first.ravel(), place, 0))
        grown = (2 * (place - begin) + 1).reshape(rows.shape)
        self.length = np.sqrt((grown * (idf**2)[rows]).sum(axis=1))

    def times(self, basis: np.ndarray) -> np.ndarray:
        """These rows times a term-by-k matrix (float32). Passages that overlap share the sums of their parts."""
        scaled = (basis * self.idf[:, None]).astype(np.float32)
        parts = np.zeros((len(self.coded) // self.stride, basis.shape[1]), np.float32)
        at = np.flatnonzero(self.coded)
        for k in range(0, len(at), CHUNK):
            here = at[k : k + CHUNK]
            part = here // self.stride
            heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            parts[part[heads]] += np.add.reduceat(scaled.take(self.coded[here], axis=0), heads, axis=0)
        each = PASSAGE // self.stride
        rows = len(self.length)
        return sum(parts[k : k + rows] for k in range(each))

    def add_gram(self, basis: np.ndarray, total: np.ndarray) -> None:
        """total += (unit rows transposed) times (unit rows times basis). Only where passages do not overlap."""
        squared = np.where(self.length > 0, self.length**2, 1.0)[:, None]
        y = (self.times(basis) / squared).astype(np.float32)
        # Pairs of floats as complex numbers: added at once.
        pairs = np.pad(y, ((0, 0), (0, y.shape[1] % 2))).view(np.complex64)
        at = np.flatnonzero(self.coded)
        for k in range(0, len(at), 4 * CHUNK):
            here = at[k : k + 4 * CHUNK]
            term = self.coded[here]
            order = np.argsort(term, kind="stable")
            term = term[order]
            heads = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            sums = np.add.reduceat(pairs.take(here[order] // self.stride, axis=0), heads, axis=0).view(np.float32)
            total[term[heads]] += sums[:, : total.shape[1]] * self.idf[term[heads]][:, None]


def _pieces(blobs: Iterator, dtype: np.dtype) -> Iterator[np.ndarray]:
    """Coded texts in slices that end on a passage, neighbours joined with a gap until there is enough for numpy."""
    gap = np.zeros(PASSAGE, dtype)
    held: list[np.ndarray] = []
    n = 0
    for b in blobs:
        coded = np.frombuffer(b, dtype)  # bytes or a buffer
        for at in range(0, len(coded), SLICE - SLICE % PASSAGE):
            part = coded[at : at + SLICE - SLICE % PASSAGE]
            held += [part, gap[: -len(part) % PASSAGE]]
            n += len(part)
            if n >= SLICE:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _code(df: DataFrame, items: Items, dtype: np.dtype) -> DataFrame:
    """(doc_id, h, coded): every text's words as vocabulary terms."""
    vocabulary = df.sparkSession.sparkContext.broadcast(items.vocabulary)

    def make() -> Callable[[list[str]], list[pa.Array]]:
        find = vocabulary.value.get

        def coded(text: str) -> bytes:
            words = words_of(text)
            return np.fromiter(map(find, words, repeat(0)), dtype, len(words)).tobytes()

        return lambda part: [pa.array(list(map(coded, part)), pa.binary())]

    return map_texts(df, make, "coded binary")


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Buffer]:
    return (x.as_buffer() for batch in batches for x in batch.column("coded"))


def _counted(coded: DataFrame, dtype: np.dtype, terms: int, tasks: int) -> np.ndarray:
    """For each term the passages that hold it; term 0, which none lacks, counts all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros(terms)
        for part in _pieces(_blobs(batches), dtype):
            rows, first = _runs(np.concatenate([part, np.zeros(-len(part) % PASSAGE, dtype)]).reshape(-1, PASSAGE))
            counts += np.bincount(rows[first], minlength=terms)
            counts[0] += (rows[:, 0] != 0).sum()
        return counts

    found = summed(coded.select("coded"), run, tasks)
    return np.zeros(terms) if found is None else found


def _inverse_frequencies(coded: DataFrame, items: Items, dtype: np.dtype, common: float, tasks: int) -> tuple[np.ndarray, int]:
    """idf by term over all passages of the corpus and the items; 0 for other words and for common terms."""
    counts = _counted(coded, dtype, items.terms, tasks)
    for w in items.words:
        counts[list(set(w))] += 1
        counts[0] += 1
    passages = counts[0]
    idf = np.log((1 + passages) / (1 + counts))
    idf[counts > max(common * passages, 10)] = 0.0
    idf[0] = 0.0
    return idf, int(passages)


def item_rows(items: Items, idf: np.ndarray) -> np.ndarray:
    """(items, terms): each item's whole text as one TF-IDF row, not scaled. The block bounds its size."""
    out = np.zeros((len(items.words), items.terms), np.float32)
    for row, words in zip(out, items.words, strict=True):
        np.add.at(row, words, 1.0)
    return out * idf.astype(np.float32)


def latent_basis(
    coded: DataFrame, items: Items, idf: np.ndarray, passages: int, dtype: np.dtype, s: Settings, tasks: int
) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF passages, by randomised subspace iteration on A^T A: a random
    start, one pass, an orthonormal basis, a second pass, and the small eigenproblem. The items are rows too, weighted
    to count as much as the corpus, so that the space holds what tells them apart."""
    rank = min(s.rank, len(items.words), items.terms)
    weight = max(1.0, passages / len(items.words))
    own = item_rows(items, idf).astype(np.float64)
    size = np.linalg.norm(own, axis=1, keepdims=True)
    own = np.divide(own, size, out=np.zeros_like(own), where=size > 0)

    def gram(basis: np.ndarray) -> np.ndarray:
        shared = coded.sparkSession.sparkContext.broadcast((idf, basis.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            weights, b = shared.value
            total = np.zeros(b.shape)
            for part in _pieces(_blobs(batches), dtype):
                Passages(part, weights).add_gram(b, total)
            return total.ravel()

        found = summed(coded.select("coded"), run, tasks)
        return (0 if found is None else found.reshape(basis.shape)) + weight * (own.T @ (own @ basis))

    start = np.random.default_rng(s.seed).normal(size=(items.terms, rank))
    q, _ = np.linalg.qr(gram(start))
    small = q.T @ gram(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)]


class Verifier:
    """Longest common subsequences of one block's items with stretches of coded texts."""

    def __init__(self, items: Items, s: Settings) -> None:
        self.items, self.s = items, s
        self.known: dict[int, tuple] = {}

    def _item(self, j: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """An item in numbers of its own words, from 1: the number of each term (0: none), how often the item has each,
        and the item in these numbers."""
        if j not in self.known:
            words = np.array(self.items.words[j])
            distinct, own, counts = np.unique(words, return_inverse=True, return_counts=True)
            number = np.zeros(self.items.terms, np.int64)
            number[distinct] = np.arange(1, len(distinct) + 1)
            self.known[j] = (number, counts, (own + 1).tolist())
        return self.known[j]

    def __call__(self, coded: np.ndarray, begin: int, j: int) -> tuple[float, float, int]:
        """Best (coverage, answer coverage, place) of an item near a passage: longest common subsequences with
        stretches half as long again as the item, at steps of an eighth of it; coverage 0 where none reaches `coverage`."""
        number, counts, item = self._item(j)
        n, kinds = len(item), len(counts) + 1
        width, step = n + n // 2 + 4, max(1, n // 8)
        best = (0.0, 0.0, begin)
        low, high = max(0, begin - n), min(len(coded), begin + PASSAGE + n)
        near = number[coded[low:high]]
        # Words of a stretch that the item has bound its common subsequence from above.
        sums = np.r_[0, np.cumsum(near > 0)]
        least = self.s.coverage * n
        if sums[-1] < least:
            return best
        starts = np.arange(0, max(1, high - low - n // 2), step)
        starts = starts[sums[np.minimum(starts + width, high - low)] - sums[starts] >= least]
        if not len(starts):
            return best
        # So do, more closely, as many of each word as the item has.
        padded = np.concatenate([near, np.zeros(width, np.int64)])
        stretches = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
        rows = np.arange(len(starts))[:, None] * kinds
        found = np.bincount((stretches + rows).ravel(), minlength=len(starts) * kinds).reshape(-1, kinds)[:, 1:]
        bound = np.minimum(found, counts).sum(axis=1)
        places = None
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < least or bound[k] <= best[0] * n:
                break
            places = places or word_places(item)
            stretch = stretches[k][stretches[k] > 0].tolist()
            share = common_subsequence(stretch, places, n) / n
            if share > best[0]:
                tail = answer_words(n)
                best = (share, common_subsequence(stretch, word_places(item[-tail:]), tail) / tail, low + int(starts[k]))
        return best


def _search(coded: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, dtype: np.dtype, s: Settings) -> DataFrame:
    whole = item_rows(items, idf)
    latent = whole @ basis
    size = np.linalg.norm(latent, axis=1, keepdims=True)
    directions = np.divide(latent, size, out=np.zeros_like(latent), where=size > 1e-6)
    # What a passage with the item reaches before scaling is the item's own projection, whatever else it holds; of an
    # item longer than three quarters of a passage it holds a part.
    part = np.array([min(1.0, 0.75 * PASSAGE / len(w)) for w in items.words])
    least = (s.own * size[:, 0] * part).astype(np.float32)
    # An item without a weighted term has no direction: a candidate for every passage, checked by its words.
    blind = np.flatnonzero(size[:, 0] <= 1e-6)
    least[blind] = np.inf
    shared = coded.sparkSession.sparkContext.broadcast((items, idf, basis.astype(np.float32), directions.T.astype(np.float32), least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        these, weights, b, toward, enough = shared.value
        verified = Verifier(these, s)
        # Slices of a huge text overlap by more than the longest item and its surroundings.
        lap = 4 * PASSAGE + 4 * max(map(len, these.words), default=0)
        half = PASSAGE // 2

        def search(texts: list[np.ndarray]) -> Iterator[tuple]:
            """(text, item, (coverage, answer coverage, place, cosine)) of every candidate, texts side by side."""
            ends = np.cumsum([len(t) + half + -len(t) % half for t in texts])
            starts = np.r_[0, ends[:-1]]
            joined = np.zeros(ends[-1], dtype)
            for t, at in zip(texts, starts, strict=True):
                joined[at : at + len(t)] = t
            p = Passages(joined, weights, half)
            y = p.times(b)  # a passage keeps its length: what lies outside the space counts against it
            size = p.length.astype(np.float32)
            for at in range(0, len(y), 4096):
                near = y[at : at + 4096] @ toward
                own = size[at : at + 4096, None]
                near[own[:, 0] == 0] = -1.0
                for i, j in zip(*np.nonzero((near >= s.cosine * own) | (near >= enough)), strict=True):
                    place = (at + int(i)) * half
                    k = int(np.searchsorted(starts, place, "right")) - 1
                    if place - starts[k] >= len(texts[k]):
                        continue  # in the gap behind a text
                    yield k, int(j), (*verified(texts[k], int(place - starts[k]), int(j)), float(near[i, j] / max(own[i, 0], 1e-9)))
            for j in blind.tolist():
                for k, t in enumerate(texts):
                    for begin in range(0, max(1, len(t)), half):
                        yield k, j, (*verified(t, begin, j), 0.0)

        held: list[tuple] = []  # (row, place of the slice, words)

        def flush() -> pa.RecordBatch:
            best: dict[tuple, tuple] = {}
            for k, j, (share, tail, place, cosine) in search([h[2] for h in held]):
                row, at, _ = held[k]
                if share >= s.coverage and tail >= s.answer:
                    key = (row, these.ids[j])
                    best[key] = max(best.get(key, (0.0,)), (share, tail, at + place, cosine))
            held.clear()
            columns = list(zip(*[(*row, item, *found) for (row, item), found in best.items()], strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND.values(), strict=True)], list(FOUND))

        n = 0
        for batch in batches:
            for doc_id, h, blob in zip(*(batch.column(c) for c in ("doc_id", "h", "coded")), strict=True):
                whole = np.frombuffer(blob.as_buffer(), dtype)
                row = (doc_id.as_py(), h.as_py())
                for at in range(0, max(1, len(whole)), SLICE):
                    held.append((row, at, whole[at : at + SLICE + lap]))
                    n += len(held[-1][2])
                    if n > SLICE:
                        yield flush()
                        n = 0
        if held:
            yield flush()

    kinds = {pa.int64(): "long", pa.float64(): "double"}
    return coded.mapInArrow(run, ", ".join(f"{c} {kinds[t]}" for c, t in FOUND.items()))


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    settings: Settings | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, h, item_id, coverage, answer_coverage, place, cosine): the benchmark items that a document contains,
    word for word or reworded; h is xxhash64 of the text, place the word near which the best match starts.

    The items' words are the vocabulary; idf counts all passages (64 words) of the corpus; words in over a share `common` of them carry no weight. A randomised SVD over these
    TF-IDF passages gives a latent space, in which each overlapping passage is compared with each item; at a cosine
    of `cosine` or more, or where the passage reaches the share `own` of the item's own projection (which falls as
    items grow in number), the pair is a candidate, and all candidates are verified: the longest common subsequence with
    a stretch one and a half times as long must cover `coverage` of the item's words and `answer` of its last fifth
    (its answer; three words at least).

    Benchmarks are taken in blocks of about items_per_block items, so what is broadcast is bounded; each block costs
    two passes over the coded corpus for the SVD and one for the search. Null or wordless texts and items match
    nothing, repeated rows give one result, repeated item ids one item each, and empty tables an empty result. Huge
    texts are searched in overlapping slices.
    """
    s = settings or Settings()
    docs = texts(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    blocks = max(1, -(-items.count() // s.items_per_block))
    found: list[DataFrame] = []
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        block = Items.of(part.collect())
        dtype = np.dtype(np.uint16 if block.terms < 1 << 16 else np.int32)
        coded = _code(docs, block, dtype)
        if not block.words:
            found.append(_search(coded.limit(0), block, np.zeros(1), np.zeros((1, 1)), dtype, s))
            continue
        coded = materialise(coded, "coded")
        tasks = coded.rdd.getNumPartitions()
        idf, passages = _inverse_frequencies(coded, block, dtype, s.common, tasks)
        basis = latent_basis(coded, block, idf, passages, dtype, s, tasks)
        found.append(_search(coded, block, idf, basis, dtype, s))
    # A huge text's slices and repeated rows can tell of one leak several times.
    best = F.max(F.struct("coverage", "answer_coverage", "place", "cosine")).alias("best")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "h", "item_id").agg(best).select("doc_id", "h", "item_id", "best.*")


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    settings: Settings | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of df, with all their columns, in which find_leaks finds nothing. Rows with a null id are judged by
    their text like all others."""
    leaks = find_leaks(df, benchmark, settings, id_col, text_col)
    leak_id, leak_h = free_name(df, "leak_id"), free_name(df, "leak_h")
    gone = leaks.select(F.col("doc_id").alias(leak_id), F.col("h").alias(leak_h)).distinct()
    same: Column = F.col(id_col).cast("long").eqNullSafe(F.col(leak_id)) & (
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(leak_h)
    )
    return df.join(gone.hint("shuffle_hash"), same, "left_anti")
