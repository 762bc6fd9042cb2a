from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.queries import op7_simhash

SCHEMA = "doc_id long, text string, component_id string, fp int"


def brute_fingerprint(text):
    words = [w for w in text.translate({i: i + 32 for i in range(65, 91)}).encode().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    least = {i: i for i, _ in rows}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for (i, a), (j, b) in combinations(rows, 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted((find(i), find(j)))
            least[y] = x
    return {i: find(i) for i, _ in rows}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    expected = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{fp:016x}", expected[i]) for i, fp in fps}


def test_links_between_crafted_fingerprints(spark):
    base = 0x0F0F_1234_5678_9ABC
    fps = [base, base ^ 0b111, base ^ 0b1111 << 20, base ^ (1 << 63), base ^ (0b111 << 30) ^ 0b111, 0, 1, 0b11111]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {}
    for r in simhash.components(simhash.links(df, tile_rows=2), "a", "b").collect():
        roots.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
    want = {}
    for i, r in brute_components(list(enumerate(fps))).items():
        want.setdefault(r, set()).add(fps[i])
    assert sorted(map(sorted, roots.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_odd_rows(spark):
    rows = [
        (1, None, "x", 1),
        (2, "", "x", 1),
        (3, " \t\n", "x", 1),
        (4, "One two", "x", 1),
        (5, "one TWO", "x", 1),
        (5, "one TWO", "x", 1),
        (None, "one two", "x", 1),
        (6, "É é " * 50_000, "x", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "h", "fp", "component_id"]
    found = [(r.doc_id, r.component_id) for r in got.collect()]
    assert sorted(found, key=str) == sorted(
        [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (None, 4), (6, 6)], key=str
    )
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    clash = df.withColumn("gone_id", F.lit(1)).withColumn("GONE_H", F.lit(2))
    assert simhash.keep_one(clash).columns == clash.columns and simhash.keep_one(clash).count() == kept.count()
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "None"]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_zero_links_to_near_zero(spark):
    df = spark.createDataFrame([(0,), (7,), (8,), (-1,)], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    assert {x for p in got for x in p} == {0, 7, 8} and len(got) == 2


def test_ids_beside_null_and_ids_with_two_texts(spark):
    big = 2**53 + 1
    a, b = "alpha beta gamma delta", "nu xi omicron pi rho"
    rows = [(None, a), (big, a), (1, b), (3, a), (3, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, 3), (big, 3), (1, 1), (3, 3), (3, 1)}
    # Of each group one row stays, though the id 3 heads one and follows in the other.
    assert sorted(map(str, (tuple(r) for r in simhash.keep_one(df).collect()))) == sorted(map(str, [(None, a), (1, b), (3, a)]))
