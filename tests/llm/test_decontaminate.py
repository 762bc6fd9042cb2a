import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm.decontaminate import (
    Items,
    Passages,
    Settings,
    Verifier,
    answer_words,
    common_subsequence,
    decontaminate,
    find_leaks,
    item_rows,
    latent_basis,
    word_places,
    words_of,
)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y and x else max(row[k], row[k - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 90))] for _ in "ab")
        b = [x + 1 for x in b]
        assert common_subsequence(a, word_places(b), len(b)) == lcs(a, b)


def dense_rows(coded, idf, stride):
    """TF-IDF rows by loops."""
    starts = range(0, len(coded), stride)
    out = np.zeros((len(starts), len(idf)))
    for row, at in zip(out, starts, strict=True):
        for t in coded[at : at + 64]:
            row[t] += idf[t]
    return out


def test_passage_rows():
    rng = np.random.default_rng(0)
    idf = np.array([0.0, 1.0, 2.0, 0.0, 0.5])
    for n in (1, 63, 64, 200, 1000):
        coded = rng.integers(0, 5, n).astype(np.uint16)
        for stride in (64, 32):
            dense = dense_rows(coded, idf, stride)
            p = Passages(coded, idf, stride)
            assert np.allclose(p.length[: len(dense)], np.linalg.norm(dense, axis=1)) and not p.length[len(dense) :].any()
            basis = rng.normal(size=(5, 3))
            assert np.allclose(p.times(basis)[: len(dense)], dense @ basis, atol=1e-4)
        dense = dense_rows(coded, idf, 64)
        size = np.linalg.norm(dense, axis=1, keepdims=True)
        unit = np.divide(dense, size, out=np.zeros_like(dense), where=size > 0)
        total = np.zeros((5, 3))
        Passages(coded, idf).add_gram(basis, total)
        assert np.allclose(total, unit.T @ unit @ basis, atol=1e-4)


def test_basis_matches_dense_svd(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [" ".join(rng.choice(vocabulary[: 3 + i % 28]) for _ in range(64 * 3)) for i in range(40)]
    items = Items.of([{"item_id": k, "text": " ".join(rng.sample(vocabulary, 12))} for k in range(20)])
    idf = np.r_[0, np.linspace(0.5, 2, items.terms - 1)]
    coded = [np.array([items.vocabulary.get(w, 0) for w in d.split()], np.uint16) for d in docs]
    df = spark.createDataFrame([(c.tobytes(),) for c in coded], "coded binary")
    dense = np.concatenate([*[dense_rows(c, idf, 64) for c in coded], item_rows(items, idf)])
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    dense[120:] *= (120 / 20) ** 0.5
    basis = latent_basis(df, items, idf, 120, np.dtype(np.uint16), Settings(rank=20), 2)
    exact = np.linalg.svd(dense, full_matrices=False)[2]
    assert np.allclose(basis.T @ basis, np.eye(20), atol=1e-6)
    # The five leading directions lie in the space, and it holds nearly as much as the best space of its rank does.
    assert all(np.linalg.norm(basis.T @ exact[k]) > 0.95 for k in range(5))
    assert ((dense @ basis) ** 2).sum() > 0.98 * ((dense @ exact[:20].T) ** 2).sum()


def reworded(text, rng, share):
    return " ".join(w if rng.random() > share else "zzz" + str(rng.randrange(99)) for w in text.split())


def reordered(text, rng, share):
    words = text.split()
    for k in range(len(words) - 1):
        if rng.random() < share:
            words[k], words[k + 1] = words[k + 1], words[k]
    return " ".join(words)


def exhaustive(rows, items, s):
    """(doc_id, item_id) of every leak: each item is verified at every place of every text, without retrieval."""
    block = Items.of([{"item_id": i, "text": t} for i, t in items])
    verified = Verifier(block, s)
    found = set()
    for doc_id, text in rows:
        coded = np.array([block.vocabulary.get(w, 0) for w in words_of(text)], np.uint16)
        for j, item in enumerate(block.ids):
            for at in range(0, max(1, len(coded)), 32):
                share, tail, _ = verified(coded, at, j)
                if share >= s.coverage and tail >= s.answer:
                    found.add((doc_id, item))
                    break
    return found


def test_recall_against_exhaustive_verification(spark, sf_dir):
    """Verbatim items, items with a tenth of the words replaced, and items with neighbours swapped, apart: what the
    retrieval finds of all that exhaustive verification finds, and that it finds nothing else."""
    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    kinds = {"verbatim": str.upper, "edited": lambda t: reworded(t, rng, 0.1), "reordered": lambda t: reordered(t, rng, 0.2)}
    rows, planted = [], {}
    for k, r in enumerate(docs):
        words = r.text.split()[:1500]
        if k % 2 == 0:
            kind = list(kinds)[k // 2 % 3]
            item, text = items[k % len(items)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = kinds[kind](text).split()
            planted[r.doc_id, item] = kind
        rows.append((r.doc_id, " ".join(words)))
    every = exhaustive(rows, items, Settings())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()}
    assert found <= every
    recall = {kind: [p in found for p in planted if planted[p] == kind and p in every] for kind in kinds}
    shares = {kind: sum(x) / len(x) for kind, x in recall.items()}
    print(shares, {kind: len(x) for kind, x in recall.items()}, len(found), len(every))
    assert shares["verbatim"] == 1.0 and shares["edited"] >= 0.9 and shares["reordered"] >= 0.9
    assert len(found) >= 0.9 * len(every)
    assert all(p in every for p in planted if planted[p] == "verbatim")
    kept = {r.doc_id for r in decontaminate(df, bench).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in found}


def test_verifier_is_the_longest_common_subsequence():
    rng = random.Random(4)
    items = Items.of([{"item_id": 0, "text": " ".join(rng.choice("abcdefg") for _ in range(20))}])
    s, n = Settings(coverage=0.3), 20
    item = items.words[0]
    for _ in range(40):
        coded = np.array([rng.randrange(items.terms) for _ in range(rng.randrange(1, 150))], np.uint16)
        low, high = max(0, 32 - n), min(len(coded), 32 + 64 + n)
        want = [lcs(coded[a : min(a + 34, high)].tolist(), item) / n for a in range(low, max(low + 1, high - 10), 2)]
        want = max(want, default=0.0)
        share, tail, at = Verifier(items, s)(coded, 32, 0)
        assert share == want if want >= 0.3 else share in (0.0, want)
        if share:
            assert tail == lcs(coded[at : min(at + 34, high)].tolist(), item[-answer_words(n) :]) / answer_words(n)


def test_ids_beside_null_and_clashing_names(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    big = 2**53 + 1
    rows = [(None, "nothing", 1, 2), (big, f"x {item} y", 3, 4), (big - 1, "clean", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, leak_id long, leak_h long").coalesce(1)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()] == [(big, 7)]
    kept = decontaminate(df, bench)
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == {rows[0], rows[2]}


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    filler = " ".join(f"f{i % 977}" for i in range(300_000))
    rows = [
        (1, None, "a"), (2, "", "b"), (3, f"x {item} y", "c"), (3, f"x {item} y", "c"), (None, item.title(), "d"),
        (4, "alpha beta gamma", "e"), (5, f"{filler} {item} tail", "f"), (6, filler, "g"), (7, " ".join(reversed(item.split())), "h"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(9, item), (9, item), (10, None), (11, " .,"), (12, "other words here")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in find_leaks(df, bench).collect())
    assert got == [("3", 9), ("5", 9), ("None", 9)]
    kept = decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.item_id for r in kept.collect()) == ["a", "b", "e", "g", "h"]
    assert find_leaks(df.limit(0), bench).collect() == []
    assert find_leaks(df, bench.limit(0)).collect() == []
    assert decontaminate(df, bench.limit(0)).count() == len(rows)
    small = Settings(items_per_block=1)
    assert sorted((str(r.doc_id), r.item_id) for r in find_leaks(df, bench, small).collect()) == got
    assert df.filter(F.col("text").isNull()).count() == 1


def test_recall_does_not_fall_with_the_number_of_items(spark):
    """Passages of 8 to 59 words, each verbatim between 130 other words: all of 1,000 are found in one block."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    odds = [1 / (20 + i) for i in range(3000)]
    items = [" ".join(rng.choices(vocabulary, odds, k=rng.randrange(8, 60))) for _ in range(1000)]
    rows = []
    for k, text in enumerate(items):
        host = rng.choices(vocabulary, odds, k=130)
        rows.append((k, " ".join([*host[:65], text, *host[65:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(df, bench, Settings(items_per_block=1000)).collect()}
    assert [len(items[k].split()) for k in range(1000) if (k, k) not in found] == []
