"""LM scoring: a hashed maximum-entropy model over n-gram and skip features with a class-factored softmax."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts, summed, texts
from millrace.plans.storage import materialise

END = b"\n"  # the end token; no word holds a line break
BRANCH = 16  # classes in all, classes in a class, symbols in one of these: a softmax over 16 each
SYMBOLS = BRANCH**3
RARE = 1024  # symbols that stand for words alike in spelling; all other symbols are words
EXPLICIT = SYMBOLS - RARE
KINDS = 64  # of spelling: RARE // KINDS symbols each
INNER = 16  # parts of a rare symbol, told apart by the context too
LAGS = (1, 2, 3, 4, 5)  # single words back
PAIRS = ((1, 2), (1, 3))  # pairs of words back
PAD = max(LAGS)
#: Features in the order of their use; a softmax takes the first so many of them.
FEATURES = ((1,), (2,), (3,), (1, 2), (4,), (1, 3), (5,))
USED = (7, 4, 3, 2)  # by classes, classes in a class, symbols, parts
ROWS_BITS = 15  # hashed rows of 16 weights for each of the four
STEP = 8192  # tokens of a numpy batch
FLUSH = 1 << 18  # tokens whose texts are held together
ROW_SHARE = 0.05  # of a row's squared gradient in its step size
OWN = 128  # most frequent words that count as neighbours of their own when words are ordered
READ = 1 << 22  # bytes of a text split into words at a time
NON_ASCII = re.compile(rb"[\xc2-\xf4][\x80-\xbf]+")
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def word_slices(text: str) -> Iterator[list[bytes]]:
    """Words in lower case (A-Z) between the six ASCII spaces, then the end token; of a huge text some at a time."""
    data = text.encode("utf-8", "surrogatepass").lower()
    if len(data) <= READ:
        words = data.split()
        words.append(END)
        yield words
        return
    at, carry = 0, b""
    while at < len(data):
        part = carry + data[at : at + READ]
        at += READ
        words = part.split()
        # What may go on in the next slice is carried over.
        carry = words.pop() if at < len(data) and words and not part[-1:].isspace() else b""
        yield words
    yield [carry, END] if carry else [END]


def tokens_of(text: str) -> list[bytes]:
    return [w for part in word_slices(text) for w in part]


def kind(token: bytes) -> int:
    """0 to KINDS-1, by the first character beyond ASCII, else by the last character."""
    if m := NON_ASCII.search(token):
        return 32 + sum(m.group()) % 32
    last = token[-1]
    return last - 97 if 97 <= last <= 122 else 26 + last % 6


def rare_code(token: bytes) -> int:
    """Symbol (after the words) and, in the four highest bits of 16, part of a token that is no symbol of its own."""
    group = kind(token) * (RARE // KINDS) + zlib.crc32(token[-3:]) % (RARE // KINDS)
    return EXPLICIT + group | (zlib.crc32(token[:2]) % INNER) << 12


@dataclass
class Vocabulary:
    """Known counts. The first `explicit` head words are symbols of their own, all others belong to rare symbols."""

    head: dict[bytes, int]  # rank of the most frequent tokens
    counts: np.ndarray  # of the head, by rank
    explicit: int
    tokens: int  # N
    distinct: int  # V
    rare_mass: np.ndarray  # (RARE, INNER): sum of count + 0.5 over a part's seen words, plus 0.5 for all unseen ones
    code: np.ndarray  # of the head, by rank: the word itself if explicit, else its rare code


@dataclass
class Weights:
    place: np.ndarray  # symbol -> place in the order of symbols, whose base-16 digits are its classes
    bias: list[np.ndarray]  # by level: (nodes, 16) log masses; 0 classes, 1 in a class, 2 symbols, 3 parts by place
    rows: list[np.ndarray]  # by level: (2^ROWS_BITS, 16)


def context(places: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A 64-bit hash of each n-gram or skip feature in front of each place."""
    back = {k: places[at - k].astype(np.uint64) + np.uint64(1) for k in LAGS}
    out = []
    for f, mix in zip(FEATURES, MIX, strict=True):
        x = back[f[0]] if len(f) == 1 else back[f[0]] << np.uint64(13) | back[f[1]]
        x = x * mix
        out.append(x ^ (x >> np.uint64(31)))
    return out


def row_index(h: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
    """The weights' row for a feature's hash in a node of a level."""
    if level:
        h = (h ^ (node + np.uint64(level << 20))) * MIX[0]
    return (h >> np.uint64(64 - ROWS_BITS)).astype(np.uint16)


def _levels(place: np.ndarray, part: np.ndarray) -> Iterator[tuple]:
    """(level, which tokens, node, branch taken): three for each token, and a fourth for those of rare symbols."""
    every = slice(None)
    yield 0, every, np.zeros(len(place), np.uint16), place >> 8
    yield 1, every, place >> 8, (place >> 4) & 15
    yield 2, every, place >> 4, place & 15
    rare = np.flatnonzero(part >= 0)
    if len(rare):
        yield 3, rare, place[rare], part[rare]


def _logits(w: Weights, level: int, node: np.ndarray, hashes: list[np.ndarray], which) -> tuple[np.ndarray, list]:
    x = w.bias[level].take(node, axis=0)
    wide = node.astype(np.uint64)
    rows = [row_index(h[which], wide, level) for h in hashes[: USED[level]]]
    for r in rows:
        x += w.rows[level].take(r, axis=0)
    return x, rows


def _shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16, tokens) exp(x - max), and the maxima."""
    t = np.ascontiguousarray(x.T)
    top = t.max(axis=0)
    t -= top
    np.exp(t, out=t)
    return t, top


def log_probabilities(places: np.ndarray, parts: np.ndarray, at: np.ndarray, w: Weights) -> np.ndarray:
    """Natural log of p(class | context) p(class in it | context) p(symbol | context), for rare symbols times
    p(part | context), at each of the places `at`."""
    hashes = context(places, at)
    out = np.zeros(len(at))
    for level, which, node, branch in _levels(places[at], parts[at]):
        x, _ = _logits(w, level, node, hashes, which)
        chosen = x[np.arange(len(x)), branch].astype(np.float64)
        share, top = _shares(x)
        out[which] += chosen - top - np.log(share.sum(axis=0))
    return out


def _row_sums(p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of p's lines for each. p is (tokens, 8) complex: pairs of floats, added at once."""
    order = np.argsort(rows, kind="stable")
    s = rows.take(order)
    first = np.empty(len(s) + 1, bool)
    first[0] = first[-1] = True
    np.not_equal(s[1:], s[:-1], out=first[1:-1])
    alone = first[:-1] & first[1:]
    single, several = np.flatnonzero(alone), np.flatnonzero(~alone)
    sums, index = [p.take(order.take(single), axis=0)], [s.take(single)]
    if len(several):
        begins = np.flatnonzero(first[:-1].take(several))
        sums.append(np.add.reduceat(p.take(order.take(several), axis=0), begins, axis=0))
        index.append(s.take(several.take(begins)))
    return np.concatenate(index).astype(np.int64), np.concatenate(sums).view(np.float32)


def train_batch(places: np.ndarray, parts: np.ndarray, at: np.ndarray, w: Weights, state: list[np.ndarray], rate: float) -> None:
    """One step of Adagrad on a batch, in place; the 16 weights of a row share one step size."""
    hashes = context(places, at)
    share = np.full(BRANCH, ROW_SHARE, np.float32)
    for level, which, node, branch in _levels(places[at], parts[at]):
        x, rows = _logits(w, level, node, hashes, which)
        p, _ = _shares(x)
        p /= p.sum(axis=0)
        p[branch, np.arange(len(x))] -= 1
        p = np.ascontiguousarray(p.T).view(np.complex64)
        table, squares = w.rows[level], state[level]
        lines = table.view(f"V{4 * BRANCH}").reshape(-1)  # a row as one item: quicker to write back
        for r in rows:
            row, grad = _row_sums(p, r)
            total = squares.take(row) + (grad * grad) @ share
            squares[row] = total
            grad *= (-rate / np.sqrt(total))[:, None]
            grad += table.take(row, axis=0)
            lines[row] = grad.view(lines.dtype).reshape(-1)


def _in_order(near: np.ndarray) -> np.ndarray:
    """Symbols in an order that keeps alike neighbourhoods together: halved at the median of the leading principal
    direction, again and again, down to 16."""
    back = near.sum(axis=0) + 1e-9
    x = near + 4 * back / back.sum()
    x = np.sqrt(x / x.sum(axis=1, keepdims=True))

    def lead(v: np.ndarray) -> np.ndarray:
        c = v - v.mean(axis=0)
        few = len(c) < c.shape[1]
        vector = np.linalg.eigh(c @ c.T if few else c.T @ c)[1][:, -1]
        y = vector if few else c @ vector
        return y if y[np.argmax(np.abs(y))] > 0 else -y

    def halved(index: np.ndarray) -> list[np.ndarray]:
        order = index[np.argsort(lead(x[index]), kind="stable")]
        if len(order) <= BRANCH:
            return [order]
        return halved(order[: len(order) // 2]) + halved(order[len(order) // 2 :])

    return np.concatenate(halved(np.arange(len(near))))


def initial_weights(v: Vocabulary, near: np.ndarray) -> Weights:
    """Classes of symbols by the words around them; biases that make the model the unigram model."""
    order = _in_order(near)
    place = np.empty(SYMBOLS + 1, np.uint16)
    place[order] = np.arange(SYMBOLS)
    place[SYMBOLS] = SYMBOLS  # before a text
    mass = np.full((SYMBOLS, INNER), 1e-30)
    mass[: v.explicit, 0] = v.counts[: v.explicit] + 0.5
    mass[EXPLICIT:] = v.rare_mass
    mass = mass[order]
    whole = mass.sum(axis=1)
    bias = [whole.reshape(BRANCH, -1).sum(axis=1)[None], whole.reshape(BRANCH, BRANCH, -1).sum(axis=2), whole.reshape(-1, BRANCH), mass]
    rows = [np.zeros((1 << ROWS_BITS, BRANCH), np.float32) for _ in bias]
    return Weights(place, [np.log(b).astype(np.float32) for b in bias], rows)


def count_tokens(documents: DataFrame) -> DataFrame:
    """(token, n) over all texts: each task adds up its own words before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"token": list(held.keys()), "n": list(held.values())})
            held.clear()
            return out

        for batch in batches:
            for t in batch["text"]:
                for words in word_slices(t):
                    held.update(words)
                if len(held) > 400_000:
                    yield flush()
        yield flush()

    return documents.select("text").mapInPandas(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, head: int, explicit: int = EXPLICIT) -> Vocabulary:
    """The most frequent tokens, about `head` at most, come to the driver, with sums over all the others.

    A histogram of the counts (a few hundred steps) tells from which count on they are that few; of the step that
    goes beyond, a share by the token's hash. So nothing is sorted and no task returns more than its own.
    """
    octave = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(octave.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).orderBy(F.desc("k")).collect()
    total, distinct = sum(r["n"] for r in steps), sum(r["v"] for r in steps)
    chosen, held = F.lit(False), 0
    for r in steps:
        if held + r["v"] > head:
            spread = 1 << 20
            chosen = chosen | ((octave == r["k"]) & (F.pmod(F.xxhash64("token"), F.lit(spread)) < int(0.95 * spread * (head - held) / r["v"])))
            break
        chosen, held = octave >= r["k"], held + r["v"]
    top = counts.filter(chosen).collect()
    ranked = sorted(((bytes(r["token"]), r["n"]) for r in top), key=lambda x: (-x[1], x[0]))
    explicit = min(explicit, EXPLICIT, len(ranked))
    known = {t for t, _ in ranked[:explicit]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass = np.zeros(RARE * INNER)
        for batch in batches:
            for t, n in zip(batch["token"], batch["n"], strict=True):
                if t not in known:
                    code = rare_code(t)
                    mass[((code & 4095) - EXPLICIT) * INNER + (code >> 12)] += n + 0.5
        at = np.flatnonzero(mass)
        yield pd.DataFrame({"k": at, "m": mass[at]})

    rare = np.full(RARE * INNER, 0.5)
    # At most RARE * INNER rows, whatever the input.
    for r in counts.mapInPandas(run, "k int, m double").groupBy("k").agg(F.sum("m").alias("m")).collect():
        rare[r["k"]] += r["m"]
    return Vocabulary(
        {t: k for k, (t, _) in enumerate(ranked)},
        np.array([n for _, n in ranked], np.float64),
        explicit,
        int(total),
        int(distinct),
        rare.reshape(RARE, INNER),
        np.array([k if k < explicit else rare_code(t) for k, (t, _) in enumerate(ranked)] + [0], np.uint16),
    )


class Coder:
    """Texts as codes of symbols and parts, with what their tokens' own counts add up to."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.log = np.log10(np.r_[v.counts, 1.0] + 0.5)
        self.log[-1] = 0.0  # tokens outside the head get theirs from the join
        self.next_row = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0

    def one(self, text: str) -> tuple:
        n, known, own, rare, codes, tail = 0, 0, 0.0, 0.0, [], []
        for words in word_slices(text):
            rank = np.fromiter(map(self.v.head.get, words, repeat(-1)), np.int64, len(words))
            code = self.v.code.take(rank)
            outside = np.flatnonzero(rank < 0).tolist()
            if outside:
                rest = [words[i] for i in outside]
                code[outside] = list(map(rare_code, rest))
                tail += rest
            logs = self.log.take(rank)
            n += len(words)
            known += len(words) - len(outside)
            own += float(logs.sum())
            rare += float(logs[(code & 4095) >= EXPLICIT].sum())
            codes.append(code.tobytes())
        return n, known, own, rare, b"".join(codes), tail

    def __call__(self, part: list[str]) -> list[pa.Array]:
        first, self.next_row = self.next_row, self.next_row + len(part)
        columns = list(zip(*map(self.one, part), strict=True)) if part else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
        return [pa.array(range(first, first + len(part)), pa.int64()), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]]


def code_texts(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """docs' columns but the text, and: row (unique), n_tokens, head_known, head_log and rare_log (sums of
    log10(count + 0.5) over the head's tokens, and over those of rare symbols), codes, tail (tokens outside the head)."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    schema = "row long, n_tokens long, head_known long, head_log double, rare_log double, codes binary, tail array<binary>"
    return map_texts(docs, lambda: Coder(shared.value), schema)


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts side by side with PAD places before each: symbols, parts (-1: none), where tokens stand, where texts end."""
    lengths = np.array([len(b) // 2 for b in blobs])
    symbols = np.full(int(lengths.sum()) + PAD * len(blobs), SYMBOLS, np.uint16)
    parts = np.full(len(symbols), -1, np.int8)
    ends = np.cumsum(lengths + PAD)
    for b, n, end in zip(blobs, lengths.tolist(), ends.tolist(), strict=True):
        code = np.frombuffer(b, np.uint16)
        symbols[end - n : end] = code & 4095
        parts[end - n : end] = np.where((code & 4095) >= EXPLICIT, code >> 12, -1)
    return symbols, parts, np.flatnonzero(symbols != SYMBOLS), ends


def _groups(blobs: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Texts until there is enough for numpy."""
    held, n = [], 0
    for b in blobs:
        held.append(b)
        n += len(b) // 2
        if n > FLUSH:
            yield held
            held, n = [], 0
    if held:
        yield held


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    return (x.as_py() for batch in batches for x in batch.column("codes"))


def neighbours(coded: DataFrame, v: Vocabulary, tasks: int) -> np.ndarray:
    """(SYMBOLS, 2 * (OWN + KINDS)): how often which most frequent words, or kinds of other words, stand before and
    after a symbol, in all texts."""
    width = OWN + KINDS
    column = np.full(SYMBOLS + 1, width)
    for t, k in v.head.items():
        if k < v.explicit:
            column[k] = k if k < OWN else OWN + kind(t)
    column[EXPLICIT:SYMBOLS] = OWN + np.arange(RARE) // (RARE // KINDS)
    shared = coded.sparkSession.sparkContext.broadcast(column)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        column = shared.value
        near = np.zeros((2, SYMBOLS * width))
        for held in _groups(_blobs(batches)):
            symbols = _joined(held)[0].astype(np.int64)
            for k, (a, b) in enumerate(((symbols[:-1], symbols[1:]), (symbols[1:], symbols[:-1]))):
                other = column[b]
                hit = (a < SYMBOLS) & (other < width)
                near[k] += np.bincount(a[hit] * width + other[hit], minlength=SYMBOLS * width)
        return near.ravel()

    got = summed(coded.select("codes"), run, tasks)
    got = np.zeros((2, SYMBOLS, width)) if got is None else got.reshape(2, SYMBOLS, width)
    return np.concatenate([got[0], got[1]], axis=1)


def fit(coded: DataFrame, v: Vocabulary, rounds: int = 4, rate: float = 0.25) -> Weights:
    """Weights from one pass over all coded learning texts, in rounds of distributed gradient updates.

    In a round every task starts from the shared weights, takes Adagrad steps over its own texts, and returns its
    change; changes are averaged by tokens, in blocks, and applied. Each round learns from another share of the rows
    (by the row's number, so that copies of one text are spread over all rounds) and together they learn from every
    row; the classes are made from what stands around the words in all of them.
    """
    spark = coded.sparkSession
    partitions = coded.rdd.getNumPartitions()
    w = initial_weights(v, neighbours(coded, v, partitions))
    # Fewer, longer tasks: each returns a change of the model's size.
    tasks = max(1, min(partitions, max(spark.sparkContext.defaultParallelism, partitions // 4)))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(w)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray | None:
            base = shared.value
            own = Weights(base.place, base.bias, [x.copy() for x in base.rows])
            state = [np.ones(len(x), np.float32) for x in own.rows]
            n = 0
            for held in _groups(_blobs(batches)):
                symbols, parts, at, _ = _joined(held)
                places = own.place.take(symbols)
                n += len(at)
                for a in range(0, len(at), STEP):
                    train_batch(places, parts, at[a : a + STEP], own, state, rate)
            return np.r_[np.concatenate([(x - y).ravel() for x, y in zip(own.rows, base.rows, strict=True)]) * n, n] if n else None

        part = coded.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).select("codes").coalesce(tasks)
        change = summed(part, learn, tasks)
        if change is not None:
            mean = (change[:-1] / change[-1]).astype(np.float32).reshape(len(w.rows), *w.rows[0].shape)
            w = Weights(w.place, w.bias, [x + y for x, y in zip(w.rows, mean, strict=True)])
    return w


def path_scores(v: Vocabulary, w: Weights | None) -> Callable[[list[bytes]], np.ndarray]:
    """A function from coded texts to each one's sum of log10 p(symbol, part | context) less, for rare symbols, the
    log10 mass of the part: with log10(count + 0.5) of its rare tokens it makes the text's score."""
    unit = np.log10(v.tokens + 0.5 * (v.distinct + 1))
    rare_log = np.log10(v.rare_mass)

    def run(blobs: list[bytes]) -> np.ndarray:
        symbols, parts, at, ends = _joined(blobs)
        lp = np.zeros(len(symbols))
        rare = np.flatnonzero(parts >= 0)
        if w is None:
            lp[rare] = -unit
        else:
            places = w.place.take(symbols)
            for a in range(0, len(at), STEP):
                here = at[a : a + STEP]
                lp[here] = log_probabilities(places, parts, here, w)
            lp /= np.log(10)
            lp[rare] -= rare_log[symbols[rare].astype(np.int64) - EXPLICIT, parts[rare]]
        return np.add.reduceat(lp, np.r_[0, ends[:-1]]) if len(ends) else np.zeros(0)

    return run


def score_texts(
    df: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    head: int = 200_000,
    explicit: int = EXPLICIT,
    rounds: int = 4,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of df, learning from the rows for
    which `learn` (an expression over doc_id) holds.

    Counts c, their sum N and the number of distinct tokens V cover all learning texts. base_score is the sum of
    log10((c+0.5)/(N+0.5(V+1))). score is the model's log10 probability: a softmax over 16 classes, one over the 16
    classes in that class, and one over the 16 symbols in it, each given the context: hashes of single words one to
    five back and of pairs of words. The `explicit` most frequent tokens (3,072 at most) are symbols; each of the
    other 1,024 stands for words alike in spelling, in 16 parts with a softmax given the context too. Within a part
    words have their smoothed share of its counts.

    The `head` most frequent tokens are broadcast; the others' counts meet the texts in a join on the token, one row
    for each such token of a text, so no part of the vocabulary needs to fit in a task. Null texts count as empty: one
    end token. Repeated rows and null ids stay as they are. With no learning text all counts are 0. An empty table
    gives an empty table. A huge text is one context from its first token to its last.
    """
    docs = texts(df, id_col, text_col)
    counts = materialise(count_tokens(docs.filter(learn)), "counts")
    v = vocabulary(counts, head, explicit)
    coded = materialise(code_texts(docs.select("doc_id", learn.alias("learn"), "text"), v), "coded")
    w = fit(coded.filter("learn"), v, rounds) if v.explicit else None
    shared = df.sparkSession.sparkContext.broadcast((v, w))
    unit = float(np.log10(v.tokens + 0.5 * (v.distinct + 1)))
    kept = ["row", "doc_id", "n_tokens", "head_known", "head_log", "rare_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = path_scores(*shared.value)
        for batch in batches:
            lp = [score(held) for held in _groups(x.as_py() for x in batch.column("codes"))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.concatenate(lp) if lp else [], pa.float64())], [*kept, "lp"]
            )

    schema = "row long, doc_id long, n_tokens long, head_known long, head_log double, rare_log double, lp double"
    scored = coded.select(*kept, "codes").mapInArrow(run, schema)
    tail = (
        coded.filter(F.size("tail") > 0)
        .select("row", F.explode("tail").alias("token"))
        .join(counts, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_log"), F.count("n").alias("tail_known"))
    )
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return scored.join(tail, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("lp") + F.col("rare_log") + tail_log).alias("score"),
    )
