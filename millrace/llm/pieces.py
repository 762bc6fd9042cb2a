"""N-best segmentation over the piece lattice of a SentencePiece vocabulary, and decoding."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts, texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # below the lowest piece score, for each character without a piece
#: No piece crosses the place before a space marker that follows another character, nor either side of a line break.
SEGMENT = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
MEMO = 600_000  # segments remembered in a worker
BATCH = 20_000  # segments solved together
RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("ids", pa.list_(pa.int32())),
        ("score", pa.float64()),
        (
            "others",
            pa.list_(
                pa.struct(
                    [
                        ("score", pa.float64()),
                        ("edits", pa.list_(pa.struct([("at", pa.int64()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
                    ]
                )
            ),
        ),
    ]
)
RESULT_DDL = (
    "doc_id long, ids array<int>, score double, "
    "others array<struct<score:double,edits:array<struct<at:long,drop:int,ids:array<int>>>>>"
)
_LOADED: dict[str, Pieces] = {}


class Pieces:
    """A vocabulary and its lattices. Scores are the model file's, which for a BPE model are minus the merge ranks:
    whole numbers, so sums are exact."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: model.get_score(i) for i in plain if model.get_score(i) > -1e8}
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.score):
            raise ValueError(f"{path}: pieces that hold a space marker or a line break inside cannot be cut into segments")
        self.raw: list[bytes] = [b""] * size
        for p, i in self.ids.items():
            self.raw[i] = p.encode()
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self._trie()
        self.forget()

    def forget(self) -> None:
        """Start with no solved segment. A segment's number leads to its best score, the loss of its second-best path,
        and its ids, which lie one after the other in a pool."""
        self.memo: dict[str, int] = {}
        self.best, self.loss = np.zeros(1024), np.zeros(1024)
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.pooled = np.zeros(4096, np.int32), 0

    def _remember(self, segments: list[str], best: np.ndarray, loss: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        a, b = len(self.memo), len(self.memo) + len(segments)
        for name in ("best", "loss", "first", "size"):
            if b > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * b))
        if self.pooled + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.pooled + len(ids)))
        self.best[a:b], self.loss[a:b], self.size[a:b] = best, loss, size
        self.first[a:b] = self.pooled + np.cumsum(size) - size
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        self.pooled += len(ids)
        self.memo.update(zip(segments, range(a, b), strict=True))

    def solved(self, segment: str) -> tuple[list[int], float, float]:
        """(ids, best score, loss of the second-best path) of a segment that solve has seen."""
        k = self.memo[segment]
        return self.pool[self.first[k] : self.first[k] + self.size[k]].tolist(), float(self.best[k]), float(self.loss[k])

    def _trie(self) -> None:
        """Transitions of the pieces' trie as sorted keys node * width + character."""
        letters = sorted({c for p in self.score for c in p})
        self.letter = np.zeros(max(map(ord, letters)) + 2, np.int64)
        for k, c in enumerate(letters):
            self.letter[ord(c)] = k + 1
        width = len(letters) + 1
        nodes, ends = {"": 0}, [-1]
        keys: list[tuple[int, int]] = []
        for p in sorted(self.score):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    ends.append(-1)
                    keys.append((nodes[p[: k - 1]] * width + int(self.letter[ord(p[k - 1])]), nodes[p[:k]]))
            ends[nodes[p]] = self.ids[p]
        keys.sort()
        self.width, self.keys, self.goto = width, np.array([k for k, _ in keys]), np.array([v for _, v in keys])
        self.ends = np.array(ends)
        self.id_score = np.zeros(max(self.ids.values()) + 1)
        for p, v in self.score.items():
            self.id_score[self.ids[p]] = v

    def char_ids(self, c: str) -> list[int]:
        """The pieces of a character that has none of its own: its UTF-8 bytes."""
        raw = c.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown_id]

    def solve(self, segments: list[str]) -> None:
        """Remember (ids, best score, loss of the second-best path) of each segment, by forward and backward Viterbi
        passes over all of their lattices at once."""
        segments = [s for s in segments if s]
        lengths = np.array([len(s) for s in segments])
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        total = len(codes)
        begin = np.r_[0, np.cumsum(lengths)]
        owner = np.repeat(np.arange(len(segments)), lengths)
        offset = np.arange(total) - begin[owner]
        letter = self.letter[np.minimum(codes, len(self.letter) - 1)]
        # Edges: walk the trie from every place at once.
        starts, sizes, pieces = [], [], []
        at, node = np.arange(total), np.zeros(total, np.int64)
        for n in range(1, self.longest + 1):
            inside = offset[at] + n <= lengths[owner[at]]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            key = node * self.width + letter[at + n - 1]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            at, node = at[hit], self.goto[k[hit]]
            done = self.ends[node] >= 0
            starts.append(at[done])
            sizes.append(np.full(int(done.sum()), n))
            pieces.append(self.ends[node[done]])
        start, size, piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)
        bare = np.ones(total, bool)
        bare[start[size == 1]] = False
        bare = np.flatnonzero(bare)
        start, size = np.r_[start, bare], np.r_[size, np.ones(len(bare), np.int64)]
        cost = np.r_[self.id_score[piece], np.full(len(bare), self.unknown)]
        piece = np.r_[piece, np.full(len(bare), -1)]
        # Nodes: one more than characters in each segment.
        src = start + owner[start]
        dst = src + size
        nodes = total + len(segments)
        first_node = begin[:-1] + np.arange(len(segments))
        last_node = first_node + lengths
        alpha, beta = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
        alpha[first_node] = 0.0
        beta[last_node] = 0.0
        back = np.full(nodes, -1)

        def sweep(near: np.ndarray, far: np.ndarray, step: np.ndarray, value: np.ndarray, keep: bool) -> None:
            # Of equal scores the longest last piece wins.
            order = np.lexsort((-size, near, step))
            cuts = np.flatnonzero(np.r_[True, np.diff(step[order]) != 0])
            for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
                e = order[a:b]
                got = value[far[e]] + cost[e]
                heads = np.flatnonzero(np.r_[True, np.diff(near[e]) != 0])
                best = np.maximum.reduceat(got, heads)
                value[near[e[heads]]] = best
                if keep:
                    hit = np.flatnonzero(got == np.repeat(best, np.diff(np.r_[heads, len(e)])))
                    group = near[e[hit]]
                    lead = np.r_[True, group[1:] != group[:-1]]
                    back[group[lead]] = e[hit[lead]]

        sweep(dst, src, offset[start] + size, alpha, True)
        sweep(src, dst, lengths[owner[start]] - offset[start], beta, False)
        used = np.zeros(len(start), bool)
        is_first = np.zeros(nodes, bool)
        is_first[first_node] = True
        now = last_node
        while len(now):
            e = back[now]
            used[e] = True
            now = src[e]
            now = now[~is_first[now]]
        through = np.where(used, -np.inf, alpha[src] + cost + beta[dst])
        second = np.full(len(segments), -np.inf)
        np.maximum.at(second, owner[start], through)
        on = np.flatnonzero(used)
        on = on[np.argsort(start[on])]
        path, where = piece[on], start[on]
        # A character without a piece spells its bytes.
        lost = np.flatnonzero(path < 0)
        spelled = [self.char_ids(chr(c)) for c in codes[where[lost]].tolist()]
        many = np.ones(len(path), np.int64)
        many[lost] = [len(x) for x in spelled]
        ids = np.repeat(path, many)
        begins = np.cumsum(many) - many
        for at, x in zip(begins[lost].tolist(), spelled, strict=True):
            ids[at : at + len(x)] = x
        size = np.bincount(owner[where], many, len(segments)).astype(np.int64)
        best = alpha[last_node]
        self._remember(segments, best, best - second, size, ids)

    def nbest(self, segment: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of one segment, best first: forward Viterbi scores, then A* backwards from the
        end, where the forward score of a place is exactly what the rest of the path can still earn."""
        size = len(segment)
        alpha = [0.0] + [-np.inf] * size
        edges: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(size + 1)]
        for a in range(size):
            for b in range(a + 1, min(size, a + self.longest) + 1):
                p = segment[a:b]
                s = self.score.get(p)
                if s is None and b == a + 1:
                    edges[b].append((a, self.unknown, self.char_ids(p)))
                elif s is not None:
                    edges[b].append((a, s, [self.ids[p]]))
            # Scores of the next place are complete: all of its edges start before it.
            alpha[a + 1] = max(alpha[x] + s for x, s, _ in edges[a + 1])
        out: list[tuple[float, list[int]]] = []
        # (minus total, order, place, score of the part behind, its pieces as a chain)
        heap: list[tuple] = [(-alpha[size], 0, size, 0.0, None)]
        order = 0
        while heap and len(out) < n:
            total, _, at, done, chain = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while chain:
                    ids += chain[0]
                    chain = chain[1]
                out.append((-total, ids))
                continue
            for a, s, ids in sorted(edges[at], key=lambda e: e[0]):
                order += 1
                heapq.heappush(heap, (-(alpha[a] + s + done), order, a, s + done, (ids, chain)))
        return out

    def segments(self, text: str) -> list[str]:
        """The text as the model sees it: a space in front, spaces as markers, cut where no piece can cross."""
        return SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, batch: list[str], n: int) -> list[tuple[bytes, float, list[tuple[float, list[tuple[int, int, list[int]]]]]]]:
        """For each text: ids of the best segmentation, its score, and the n-1 next ones as edits of it."""
        cut = [self.segments(t) for t in batch]
        memo = self.memo
        fresh = sorted({s for parts in cut for s in parts if s not in memo}, key=len)
        if len(memo) + len(fresh) > MEMO:
            self.forget()
            fresh = sorted({s for parts in cut for s in parts}, key=len)
        at = 0
        while at < len(fresh):
            # A batch is bounded in characters too.
            end = at + max(1, min(BATCH, (1 << 19) // len(fresh[min(len(fresh), at + BATCH) - 1])))
            self.solve(fresh[at:end])
            at = end
        return [self._document(parts, n) for parts in cut]

    def _document(self, parts: list[str], n: int):
        which = np.fromiter(map(self.memo.__getitem__, parts), np.int64, len(parts))
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.first[which] - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes()
        score = float(self.best[which].sum())
        if n < 2 or not parts:
            return ids, score, []
        # The n best of a text change at most the n-1 segments that lose least: any other change could be exchanged
        # for one of theirs. Ties go to the earlier segment.
        loss = self.loss[which]
        near = np.flatnonzero(np.isfinite(loss))
        if len(near) > n - 1:
            limit = np.partition(loss[near], n - 2)[n - 2]
            near = near[loss[near] <= limit]
            near = np.sort(near[np.argsort(loss[near], kind="stable")[: n - 1]])
        if not len(near):
            return ids, score, []
        lists = [self.nbest(parts[k], n) for k in near]
        places = (ends - sizes)[near]
        found: list[tuple[float, tuple[int, ...]]] = []
        root = (0,) * len(lists)
        heap, seen = [(-score, root)], {root}
        while heap and len(found) < n:
            total, choice = heapq.heappop(heap)
            found.append((-total, choice))
            for k in range(len(lists)):
                if choice[k] + 1 < len(lists[k]):
                    to = choice[:k] + (choice[k] + 1,) + choice[k + 1 :]
                    if to not in seen:
                        seen.add(to)
                        change = lists[k][to[k]][0] - lists[k][choice[k]][0]
                        heapq.heappush(heap, (total - change, to))
        others = []
        for total, choice in found[1:]:
            edits = [(int(places[k]), int(sizes[near[k]]), lists[k][c][1]) for k, c in enumerate(choice) if c]
            others.append((total, edits))
        return ids, score, others

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def pieces(path: str) -> Pieces:
    """One for each worker process, which keeps what it has solved."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_nbest(df: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, score, others) for every row: the best segmentation of the whole text into pieces, its score, and
    the next n-1 segmentations, each as its score and edits of the best one ({at, drop, ids}: at piece `at`, `drop`
    pieces give way to ids).

    A segmentation's score is the sum of its pieces' scores in the model file; of equal ones the longest last pieces
    win. A character without a piece counts as the lowest score less 10 and is spelled in byte pieces. A text is cut
    where no piece can cross (before spaces, around line breaks). Each segment has its own lattice: a forward Viterbi
    pass gives the best path and, with a backward one, the loss of the second-best; the segments of least loss get
    their n best paths from an A* search, backwards from the end, whose heuristic, the forward score, is exact; the
    text's n best combine these.

    Null texts count as empty; an empty text has no pieces, score 0 and no others. Repeated rows and null ids stay.
    An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            ids, documents = batch.column(0), batch.column(1)
            at = 0
            while at < len(documents):
                part: list[str] = []
                first, chars = at, 0
                while at < len(documents) and (not part or chars < 1 << 20):
                    part.append(documents[at].as_py())
                    chars += len(part[-1])
                    at += 1
                solved = model.encode(part, n)
                sizes = np.r_[0, np.cumsum([len(s[0]) // 4 for s in solved])].astype(np.int32)
                flat = np.frombuffer(b"".join([s[0] for s in solved]), np.int32)
                others = [
                    [{"score": s, "edits": [{"at": a, "drop": d, "ids": i} for a, d, i in e]} for s, e in x[2]] for x in solved
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, at - first),
                        pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)),
                        pa.array([s[1] for s in solved], pa.float64()),
                        pa.array(others, RESULT.field("others").type),
                    ],
                    schema=RESULT,
                )

    return texts(df, id_col, text_col).mapInArrow(run, RESULT_DDL)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with column `out`: the text that the pieces spell, without the space in front of it; null ids give null,
    bytes that are no UTF-8 the replacement character."""

    @F.pandas_udf("string")
    def spelled(ids: pd.Series) -> pd.Series:
        model = pieces(model_path)
        return ids.map(lambda x: None if x is None else model.decode(np.asarray(x)))

    return df.withColumn(out, spelled(F.col(ids_col)))


def encode_and_check(df: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, scores, round_trip) for every row: encode_nbest, decoded again next to its text.

    ids_crc32 is over the ids as little-endian 32-bit numbers, scores are those of the n best segmentations, and
    round_trip says that decoding the ids gives the text back.
    """

    def make() -> Callable[[list[str]], list[pa.Array]]:
        model = pieces(model_path)

        def checked(part: list[str]) -> list[pa.Array]:
            solved = model.encode(part, n)
            return [
                pa.array([len(ids) // 4 for ids, _, _ in solved], pa.int64()),
                pa.array([zlib.crc32(ids) for ids, _, _ in solved], pa.int64()),
                pa.array([[score, *[s for s, _ in others]] for _, score, others in solved], pa.list_(pa.float64())),
                pa.array(
                    [model.decode(np.frombuffer(ids, np.int32)) == text for text, (ids, _, _) in zip(part, solved, strict=True)],
                    pa.bool_(),
                ),
            ]

        return checked

    schema = "n_pieces long, ids_crc32 long, scores array<double>, round_trip boolean"
    return map_texts(texts(df, id_col, text_col), make, schema, rows=64)
