import math
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import chat, sharding, token_counts, topk
from millrace.llm.queries import op5_sharding, op9_token_counts, op10_exact_topk

BPE = public_tokenizers.path("byte_bpe_50k.json")


def tokens(texts):
    return [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_the_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(docs, tokens(list(docs.values())), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op9_token_counts(spark, sf_dir).collect()}
    assert got == {i: (len(docs[i].encode()), n, n > 1024) for i, n in want.items()}


def test_token_counts_of_odd_texts(spark):
    odd = [
        None, "", " ", "  a  b ", "a\n\n b\r\n\tc ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "it's we'll 'll ' s",
        "x" * 3000, "\x1c a\x85 b　c d", "日本語 テキスト" * 40, "a <|endof text|> <|endoftext|", "é ñ 🙂🙂 🙂", "12 345  6,7 . !!! ",
    ]
    rows = [(i, t, i, "x") for i, t in enumerate(odd)] + [(None, "a b", 1, "y"), (3, "a b", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, n_bytes string")
    got = [(r.doc_id, r.n_tokens) for r in token_counts.token_counts(df, BPE).collect()]
    want = [(i, n) for (i, *_), n in zip(rows, tokens([r[1] or "" for r in rows]), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.token_counts(df.limit(0), BPE).collect() == []


def test_chunks_splice_anywhere():
    count = token_counts.Counter(BPE)
    rng = random.Random(3)
    pools = ["ab c'ls.,  \n", "日本語 ", "x", "🙂é ", " \t\n", "a1 <|endoftext|>"]
    for trial in range(60):
        pool = rng.choice(pools)
        text = "".join(rng.choice(rng.choice([pool, "".join(pools)])) if rng.random() < 0.8 else rng.choice(["<|endoftext|>", "'re", "  ", " word", "'ll"]) for _ in range(rng.randrange(50, 900)))
        assert count.spliced(text, chunk=64, overlap=8) == tokens([text])[0], (trial, text)
    huge = ("lorem ipsum 'dolor' " * 9000)[:150_000]
    assert count.count([huge]) == tokens([huge])
    assert count.spliced("z" * 5000, chunk=64, overlap=8) == tokens(["z" * 5000])[0]


def test_sentencepiece_counts(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path).collect()}
    assert got == {1: len(SentencePieceProcessor(model_file=path).encode("Hello there")), 2: 0}


def brute_top(vectors, k=5, every=50):
    out = []
    ints = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    for q in ints:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


def test_top_k_ties_and_blocks(spark):
    rng = np.random.default_rng(0)
    for dim, scale in ((1, 1), (3, 1), (8, 3), (40, 1e5)):
        vectors = {i: (rng.integers(-2, 3, dim) * scale / 7).tolist() for i in range(-60, 160)}
        df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id long, embedding array<double>, score string")
        got = topk.exact_top_k(df, rows_per_block=37, queries_per_block=1).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(vectors)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (5, [0.5, 0.5]), (5, [0.25, 0.5]), (50, [1.0]), (51, [2.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df).collect())
    # Rows that repeat an id are candidates of their own.
    assert got == [(0, 1, 5, 256 * 128 + 128 * 128), (0, 2, 5, 256 * 64 + 128 * 128), (50, 1, 51, 256 * 512)]
    assert topk.exact_top_k(df.limit(0)).collect() == []


def test_top_k_rows_that_repeat_a_query(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df, k=2).collect())
    assert got == [(50, 1, 1, 0), (50, 1, 1, 65536), (50, 2, 1, 0), (50, 2, 1, 32768)]


def test_shards_cover_few_values(spark, sf_dir):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source", F.octet_length("text").alias("bytes"))
    placed = op5_sharding(spark, "/root/testdata/sf0.01").select("doc_id", "shard").join(df, "doc_id")

    def spread(shard):
        """Mean number of languages and sources in a shard, and mean share of the size range, in ranks."""
        size = F.percent_rank().over(Window.orderBy("bytes"))
        by = placed.withColumn("rank", size).groupBy(shard.alias("s")).agg(F.countDistinct("lang").alias("l"), F.countDistinct("source").alias("c"), (F.max("rank") - F.min("rank")).alias("r"))
        return by.agg(F.avg("l"), F.avg("c"), F.avg("r")).first()

    curve, chance = spread(F.col("shard")), spread(F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    assert curve[0] < 0.75 * chance[0] and curve[1] < 0.75 * chance[1] and curve[2] < 0.9 * chance[2], (curve, chance)


def test_top_k_table(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = op10_exact_topk(spark, sf_dir).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(vectors)


def hilbert(axes, bits):
    """Index by the recursive state of the curve: Skilling's published transform, on Python ints."""
    x, n = list(axes), len(axes)
    q = 1 << bits - 1
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & q - 1
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << bits - 1
    while q > 1:
        t ^= q - 1 if x[-1] & q else 0
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_hilbert_curve_is_one_walk(spark):
    cells = [(a, b, c) for a in range(8) for b in range(8) for c in range(8)]
    df = spark.createDataFrame(cells, "a int, b int, c int").select("*", sharding.hilbert_index(F.array("a", "b", "c"), 3, bits=3).alias("h"))
    rows = df.collect()
    assert all(r.h == hilbert((r.a, r.b, r.c), 3) for r in rows)
    walk = [(r.a, r.b, r.c) for r in sorted(rows, key=lambda r: r.h)]
    assert sorted(r.h for r in rows) == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1 for p, q in zip(walk, walk[1:], strict=False))


def check_shards(rows, docs):
    n = len(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(by.get(s, [])) for s in range(16)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    shards_of = {}
    for r in rows:
        shards_of.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert sum(len(x) - 1 for x in shards_of.values()) <= 15  # a text's copies are parted by cuts alone
    last = -1
    for s in sorted(by):
        part = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in part] == list(range(len(part)))
        assert part[0].curve >= last and [r.curve for r in part] == sorted(r.curve for r in part)
        last = part[-1].curve


def test_shards(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_shards(op5_sharding(spark, sf_dir).collect(), docs)


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = [(i % 9 or None, "t" * (i % 4) if i % 5 else None, "en" if i % 3 else None, "hot", i) for i in range(200)]
    rows += [(2**53 + 1, "q", "de", "cold", 1), (None, "one", "de", None, 1), (5, "one", None, "cold", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, curve int")
    check_shards(sharding.hilbert_shards(df).collect(), [r[:2] for r in rows])
    assert sharding.hilbert_shards(df.limit(0)).collect() == []
    check_shards(sharding.hilbert_shards(df.limit(5)).collect(), [(r.doc_id, r.text) for r in df.limit(5).collect()])


def test_chat_snapshots(spark):
    rows = [
        (1, 0, "user", "hi", "z"), (1, 1, "assistant", "yo", "z"),
        (2, 0, "user", "hi", "z"), (2, 1, "assistant", "yo", "z"), (2, 2, "user", "more", "z"),
        (3, 5, "user", "hi", "z"), (3, 9, "assistant", "yo", "z"), (3, 11, "user", "more", "z"),
        (4, 0, "user", "hi", "z"), (4, 1, "assistant", "other", "z"),
        (5, 0, None, None, "z"), (5, 0, None, None, "z"), (6, None, "user", "<|im_end|>", "z"), (6, 1, "user", "b", "z"),
        (None, 0, "user", "lost", "z"), (7, 0, "userhi", "", "z"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 4, 5, 6, 7}
    assert got[2].n_turns == 3
    assert got[2].chat.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>")
    assert got[6].chat.count("<|im_end|>") == 2 and "<​|im_end|>" in got[6].chat
    assert chat.format_chats(df.limit(0)).collect() == []
