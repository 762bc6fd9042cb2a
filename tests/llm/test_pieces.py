import itertools
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm.pieces import SPACE, Pieces, decode, encode_nbest

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return Pieces(PATH)


def brute(model, text):
    """Scores of all segmentations of a whole text, without cutting it into segments; best first."""
    s = SPACE + text.replace(" ", SPACE)
    out = []
    for cuts in itertools.product((0, 1), repeat=len(s) - 1):
        edges = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(s)]
        total, ids = 0.0, []
        for a, b in zip(edges, edges[1:], strict=False):
            p = s[a:b]
            if p in model.score:
                total, ids = total + model.score[p], ids + [model.ids[p]]
            elif len(p) == 1:
                total, ids = total + model.unknown, ids + model.char_ids(p)
            else:
                break
        else:
            out.append((total, ids))
    return sorted(out, key=lambda x: -x[0])


def spelled(row):
    """The full ids of every segmentation of a result row."""
    found = [(row.score, list(row.ids))]
    for o in row.others:
        ids = list(row.ids)
        for e in sorted(o.edits, key=lambda e: -e.at):
            ids[e.at : e.at + e.drop] = e.ids
        found.append((o.score, ids))
    return found


def test_nbest_against_all_segmentations(spark, model):
    rng = random.Random(2)
    words = ["the", "in", "aé", "日", "and\n", "a", " ", "\t", "ing", "x", "\n", "ther", "🙂", "th e"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))[:12]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in encode_nbest(df, PATH, n=5).collect()}
    for i, text in docs:
        want = brute(model, text)
        got = spelled(rows[i])
        assert [s for s, _ in got] == [s for s, _ in want[:5]], text
        assert len({tuple(ids) for _, ids in got}) == len(got)
        scores = {tuple(ids): s for s, ids in want}
        assert all(scores[tuple(ids)] == s for s, ids in got)


def test_odd_rows_and_round_trip(spark):
    odd = [None, "", " ", "  lead  trail ", "a\r\nb\tc\x00", "日本語🙂 é", "x" * 2000, "word " * 20_000, "ﬁ 　"]
    rows = [(i, t, i) for i, t in enumerate(odd)] + [(None, "a b", 1), (3, "a b", 1), (3, "a b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = decode(encode_nbest(df, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in out) == sorted((str(i), t or "") for i, t, _ in rows)
    empty = [r for r in out if r.doc_id in (0, 1)]
    assert all((list(r.ids), r.score, r.others) == ([], 0.0, []) for r in empty)
    assert encode_nbest(df.limit(0), PATH).collect() == []


def test_round_trip_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = decode(encode_nbest(docs, PATH), PATH).join(docs.select("doc_id", "text"), "doc_id")
    assert out.filter(F.col("decoded") != F.col("text")).count() == 0
    bad = out.filter(F.exists("others", lambda o: o["score"] > F.col("score"))).count()
    assert bad == 0


def test_vectorised_and_single_search_agree(model):
    rng = random.Random(4)
    segments = ["".join(rng.choice("etaoinshr▁é~日") for _ in range(rng.randrange(1, 25))).replace("▁", "") or "e" for _ in range(300)]
    segments = sorted(set(segments))
    model.forget()
    model.solve(segments)
    for s in segments:
        ids, best, loss = model.solved(s)
        two = model.nbest(s, 2)
        assert (best, ids) == two[0]
        assert loss == (two[0][0] - two[1][0] if len(two) > 1 else float("inf"))
