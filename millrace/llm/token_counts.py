"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced where both encodings agree."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts, texts

CHUNK = 1 << 14  # characters of a chunk; longer texts are huge
OVERLAP = 256  # characters that neighbouring chunks share at first
MEMO = 300_000  # segments remembered in a worker
#: A single space between two characters that are not white space starts a token of every byte-level model.
SEGMENT = re.compile(r"(?<=\S)(?= \S)")
_LOADED: dict[str, Counter] = {}


class Counter:
    """Counts tokens with a tokenizer file: .json by tokenizers, .model by sentencepiece."""

    def __init__(self, path: str) -> None:
        self.memo: dict[str, int] = {}
        self.byte_level = False
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import json

            from tokenizers import Tokenizer
            from tokenizers.processors import ByteLevel

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            split = spec.get("pre_tokenizer") or {}
            self.special = [t["content"] for t in spec.get("added_tokens", [])]
            # Only then are chunks and segments proven to splice: the split looks forward by a few characters at most.
            self.byte_level = (
                split.get("type") == "ByteLevel"
                and split.get("use_regex", True)
                and not split.get("add_prefix_space")
                and spec.get("normalizer") is None
                and not any(" " in t or a.get("lstrip") or a.get("rstrip") or a.get("single_word") for t, a in
                            zip(self.special, spec.get("added_tokens", []), strict=True))
            )
            if self.byte_level:
                self.model.post_processor = ByteLevel(trim_offsets=False)  # offsets then cover every character
            self.margin = max([8, *(len(t) + 1 for t in self.special)])
        else:
            from sentencepiece import SentencePieceProcessor

            self.model = SentencePieceProcessor(model_file=path)

    def whole(self, batch: list[str]) -> list[int]:
        if hasattr(self.model, "encode_batch_fast"):
            return [len(e.ids) for e in self.model.encode_batch_fast(batch, add_special_tokens=False)]
        return [len(ids) for ids in self.model.encode(batch, num_threads=1)]

    def segmented(self, batch: list[str]) -> list[int]:
        """Counts of texts, a segment at a time; a segment's count is remembered."""
        memo = self.memo
        parts = [SEGMENT.split(t) for t in batch]
        fresh = list({s for p in parts for s in p if s not in memo})
        if len(memo) + len(fresh) > MEMO:
            # The first ones seen are the frequent ones: they stay, the later half goes.
            for s in list(memo)[MEMO // 2 :]:
                del memo[s]
            fresh = list({s for p in parts for s in p if s not in memo})
        memo.update(zip(fresh, self.whole(fresh), strict=True))
        return [sum(map(memo.__getitem__, p)) for p in parts]

    def boundaries(self, chunk: str) -> tuple[np.ndarray, np.ndarray]:
        """Character offsets at which a word of the pre-tokenizer starts, and the tokens before each."""
        e = self.model.encode(chunk, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        starts = np.array([a for a, _ in e.offsets], np.int64)
        first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)][: len(words)])
        return np.r_[starts[first], len(chunk)], np.r_[first, len(words)]

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a long text from overlapping chunks.

        A word boundary of a chunk is stable if it is the chunk's proven start or lies over `margin` characters
        before the chunk's cut end and before its last word: no later character can move it. Two chunks are spliced at
        the last boundary that is stable in the first and present in the second past its own cut start; from there
        both split alike. If the overlap holds none, it is doubled, until the chunks are one.
        """
        at, total, skip = 0, 0, 0  # the chunk's start, tokens so far, its characters already counted
        while True:
            end = min(len(text), at + chunk)
            places, before = self.boundaries(text[at:end])
            done = int(before[np.searchsorted(places, skip)])
            if end == len(text):
                return total + int(before[-1]) - done
            stable = places[:-2][places[:-2] <= end - at - self.margin]
            wide = overlap
            while True:
                start = max(at, end - wide)
                if start <= at:
                    # No place to splice in the whole chunk: encode a wider one from the same start.
                    chunk *= 2
                    break
                other, _ = self.boundaries(text[start : min(len(text), start + 2 * wide)])
                # Past the other chunk's start, as its first word may be cut, and inside of its own stable part.
                sure = other[1:-2] + start - at
                common = np.intersect1d(stable[stable > skip], sure)
                if len(common):
                    cut = int(common[-1])
                    total += int(before[np.searchsorted(places, cut)]) - done
                    at, skip = start, at + cut - start
                    break
                wide *= 2

    def count(self, batch: list[str], chunk: int = CHUNK) -> list[int]:
        if not self.byte_level:
            return self.whole(batch)
        out = [0] * len(batch)
        short = [i for i, t in enumerate(batch) if len(t) <= chunk]
        for i, n in zip(short, self.segmented([batch[i] for i in short]), strict=True):
            out[i] = n
        for i in set(range(len(batch))) - set(short):
            out[i] = self.spliced(batch[i], chunk)
        return out


def counter(path: str) -> Counter:
    """One for each worker process, which keeps what it has remembered."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def token_counts(
    df: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row: UTF-8 bytes, tokens of the whole text without added
    special tokens, and whether these are over the limit.

    Null texts count as empty: no bytes, no tokens. Special strings inside a text are handled as the library does by
    default. Repeated rows and null ids stay as they are; an empty table gives an empty table. Texts of over `chunk`
    characters go in overlapping chunks of that size, spliced where both encodings agree; models other than byte-level ones, for which no splice is proven, encode each text whole.
    """

    def make() -> Callable[[list[str]], list[pa.Array]]:
        one = counter(tokenizer_path)
        return lambda part: [pa.array(one.count(part, chunk), pa.int64())]

    docs = texts(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return map_texts(docs, make, "n_tokens long", rows=64).withColumn("over_limit", F.col("n_tokens") > limit)
