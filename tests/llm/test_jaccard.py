import random
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import jaccard
from millrace.llm.words import cut

SCHEMA = "doc_id long, text string, digest string, n int, component_id int"


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = low.encode().split()
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def brute(rows, size=4, percent=85):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, len(s), ids.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(df, **given):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df, **given).collect()), key=str)


def chain(rng, n, words, change):
    """n texts, each the last one with some words changed."""
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        yield " ".join(text)
        for _ in range(change):
            text[rng.randrange(words)] = f"w{rng.randrange(10**6)}"


def test_chains_cliques_and_shared_passages(spark):
    rng = random.Random(5)
    rows = []
    for n, words, change in ((25, 60, 1), (12, 90, 2), (9, 200, 3), (14, 33, 1), (6, 8, 1), (5, 5, 1), (7, 120, 6)):
        rows += list(chain(rng, n, words, change))
    base = [f"p{i}" for i in range(80)]
    rows += [" ".join(base[: 60 + k]) for k in range(20)]  # prefixes of one text
    for _ in range(40):  # mostly one passage: in many lists together, few of them alike
        rows.append(" ".join(base[:50] + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 12))]))
    clique = [f"c{i}" for i in range(150)]
    for i in range(30):
        rows.append(" ".join(clique[:i] + [f"x{i}"] + clique[i + 1 :]))
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(1 for d, _, c in want if d != c) > 80
    assert found(df.repartition(3)) == want
    assert found(df, size=2, percent=60) == brute(rows, 2, 60)


def test_search_by_lists_finds_what_heads_do_not(spark, monkeypatch):
    rng = random.Random(6)
    rows = list(enumerate(t for _ in range(6) for t in chain(rng, 8, 160, 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "stars", lambda lists, *_, **__: lists.selectExpr("sid as x", "sid as y").limit(0))
    monkeypatch.setattr(jaccard, "LIST", 2)
    assert found(df) == brute(rows)  # without any star


def test_brute_force_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert found(df) == brute([tuple(r) for r in df.collect()])


def test_odd_rows(spark):
    long = " ".join(f"n{i % 9973}" for i in range(60_000))
    rows = [
        (1, None, "x", 1, 1),
        (2, "", "x", 1, 1),
        (3, " \t\x0b\n", "x", 1, 1),
        (4, "One two", "x", 1, 1),
        (5, "one TWO", "x", 1, 1),
        (5, "one TWO", "x", 1, 1),
        (None, "one two", "x", 1, 1),
        (None, "nobody else", "x", 1, 1),
        (None, None, "x", 1, 1),
        (6, "É é " * 50, "x", 1, 1),
        (7, "É é " * 80, "x", 1, 1),
        (8, long, "x", 1, 1),
        (2**53 + 1, long + " end", "x", 1, 1),
        (5, "another text under the same id", "x", 1, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    result = jaccard.near_duplicates(df)
    assert result.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(df) == brute([r[:2] for r in rows])
    assert found(df.limit(0)) == []


@pytest.mark.parametrize("percent", [50, 85, 99, 100])
def test_short_lists_keep_what_can_link(percent):
    """Over all sizes: with so many in common, the rarest ones looked up by both are at least as many as demanded."""
    for n in range(1, 40):
        for m in range(n, 40):
            for common in range(n + 1):
                if 100 * common >= percent * (n + m - common):
                    p, q = jaccard.short_lists(n, percent), jaccard.short_lists(m, percent)
                    # At worst all that is not common is rarer; one of the two has looked up everything that far.
                    worst = min(p - (n - common), q - (m - common))
                    assert worst >= jaccard.occurrences(n, m, percent) >= 1


def test_occurrences_in_random_sets():
    rng = random.Random(8)
    for _ in range(400):
        percent = rng.choice([60, 85])
        n = rng.randrange(5, 60)
        a = set(range(n))
        b = {rng.randrange(1000, 2000) if rng.random() < 0.08 else x for x in a} | {3000 + i for i in range(rng.randrange(3))}
        if 100 * len(a & b) < percent * len(a | b):
            continue
        order = {x: rng.random() for x in a | b}
        look = [set(sorted(s, key=order.get)[: jaccard.short_lists(len(s), percent)]) for s in (a, b)]
        assert len(look[0] & look[1]) >= jaccard.occurrences(len(a), len(b), percent)


def test_overlap_and_merge():
    b = np.arange(0, 9000, 3, dtype=np.uint64)
    a = np.arange(0, 9000, 2, dtype=np.uint64)
    assert jaccard.overlap(a, b, 1) == 1500
    assert jaccard.overlap(a, b, 4000) < 4000
    lists = [np.array([1, 4, 9]), np.array([4, 9]), np.array([2, 9])]
    assert jaccard.merged(lists) == [(1, 1), (2, 1), (4, 2), (9, 3)]


def test_shingles_of_a_chunk():
    texts = [b"a b c d e", b"", b"A  b\tc\nd e", b"x", b"x x x x x x"]
    sets = jaccard.shingle_sets(cut(texts, jaccard.WORDS), len(texts), 4)
    assert [len(s) for s in sets] == [2, 0, 2, 1, 1] and (sets[0] == sets[2]).all()


def test_lists_that_different_components_lead(spark):
    # 1 and 2 meet in two lists, as a link takes; component 1 leads the first list and component 2 the second.
    lists = spark.createDataFrame([(10, 1, 12), (10, 2, 12), (10, 3, 12), (11, 1, 12), (11, 2, 12), (11, 4, 12)], "w long, sid long, n long")
    roots = spark.createDataFrame([(1, 1), (3, 1), (2, 2), (4, 2)], "node long, root long")
    assert jaccard.occurrences(12, 12, 85) == 2
    assert {tuple(r) for r in jaccard.candidates(jaccard._owned(lists, roots), 85).collect()} == {(1, 2)}


def test_candidates_against_counting(spark):
    rng = random.Random(3)
    entries = [(w, sid, 12) for w in range(60) for sid in rng.sample(range(40), 8)]
    comp = {sid: sid - sid % (2 + sid // 12 * 2) if sid < 36 else sid for sid in range(40)}
    comp = {sid: min(k for k in comp if comp[k] == c) for sid, c in comp.items()}
    lists = spark.createDataFrame(entries, "w long, sid long, n long")
    roots = spark.createDataFrame([(k, v) for k, v in comp.items() if k < 36], "node long, root long")
    of = {sid: {w for w, s, _ in entries if s == sid} for sid in range(40)}
    want = {(x, y) for x, y in combinations(range(40), 2) if comp[x] != comp[y] and len(of[x] & of[y]) >= 2}
    assert want and {tuple(r) for r in jaccard.candidates(jaccard._owned(lists, roots), 85).collect()} == want


def counted(spark, df):
    """df, and how many of its rows have been read since."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_lists_are_dealt_once(spark):
    rng = random.Random(9)
    rows = [(sid, 12, rng.sample(range(300), 4)) for sid in range(200)]
    df, seen = counted(spark, spark.createDataFrame(rows, "rid long, n long, lead array<long>"))
    got = jaccard.postings(df, spark.range(0, 200, 2).selectExpr("id as sid", "12L as n"))  # odd ones are copies
    assert seen.value == 200
    of = {w: [sid for sid, _, lead in rows if w in lead] for w in range(300)}
    assert {(r.w, r.sid, r.n) for r in got.collect()} == {(w, s, 12) for w, ss in of.items() if len(ss) > 1 for s in ss if s % 2 == 0}
    lists, seen = counted(spark, got)
    jaccard.stars(jaccard._owned(lists, None), None, 85, k=2).collect()
    assert seen.value == got.count()


def test_stars_test_what_meets_often_enough(spark):
    # 1 and 2 meet in two lists, as sets of 12 must to link; 3 and 4 in one.
    lists = spark.createDataFrame([(10, 1, 12), (10, 2, 12), (11, 1, 12), (11, 2, 12), (12, 3, 12), (12, 4, 12)], "w long, sid long, n long")
    assert {tuple(r) for r in jaccard.stars(jaccard._owned(lists, None), None, 85, k=2).collect()} == {(1, 2)}


def test_a_turn_starts_from_what_the_last_one_left(spark):
    lists = spark.createDataFrame([(10, 1, 12), (10, 2, 12), (11, 2, 12), (11, 3, 12)], "w long, sid long, n long")
    left = jaccard.unsettled(jaccard._owned(lists, spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")))
    assert {(r.w, r.sid, r.comp, r.main, r.size) for r in left.collect()} == {(11, 2, 1, 1, 2), (11, 3, 3, 1, 2)}
    assert jaccard.unsettled(jaccard._owned(left, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, root long"))).isEmpty()
