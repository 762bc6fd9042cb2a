from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import bits, phrases, words

SCHEMA = "doc_id long, text string, lang string, phrase string, N int"


def brute(rows, longest, least, first):
    """(lang, rank, phrase, a, l, r, n, score), phrase by phrase, from counts of all runs of words."""
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    counts[lang, tuple(ws[i : i + k])] += 1
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, ws), a in found.items():
        longer = [
            b for (g, o), b in found.items() if g == lang and len(o) > len(ws) and any(o[i : i + len(ws)] == ws for i in range(len(o)))
        ]
        if any(100 * b >= 100 * a for b in longer):
            continue
        scores = []
        for k in range(1, len(ws)):
            left, right = counts[lang, ws[:k]], counts[lang, ws[k:]]
            scores.append((int(Fraction(1000 * a * total[lang], left * right)), k, left, right))
        score, _, left, right = min(scores)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    rows = set()
    for lang, cands in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(cands)[:first], 1):
            rows.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return rows


def got(df, **given):
    return {tuple(r) for r in phrases.collocations(df, **given).collect()}


def test_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    rows = [tuple(r) for r in df.collect()]
    want = brute(rows, 5, 20, 40)
    assert len(want) > 60 and got(df, least=20, first=40) == want
    assert got(df.repartition(7), least=20, first=40, salts=3) == want


def test_odd_rows(spark):
    rows = [
        (1, "Red, red RED\tred  red. É é É é", "en", "x", 1),
        (2, "red red red red red red red", "en", "x", 1),
        (2, "red red red red red red red", "en", "x", 1),
        (3, None, "en", "x", 1),
        (4, "", None, "x", 1),
        (5, " .,;\n", None, "x", 1),
        (None, "un deux\x0bun deux trois un deux", None, "x", 1),
        (6, "a b " * 60_000, "long", "x", 1),
        (7, "b a\nb a", "", "x", 1),
        (8, "x\x00y x\x00y", "en", "x", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(r[1], r[2]) for r in rows], 5, 2, 5)
    result = phrases.collocations(df, least=2, first=5)
    assert result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert dict(result.dtypes) == {"lang": "string", "phrase": "string"} | {c: "bigint" for c in ("rank", "a", "l", "r", "n", "score")}
    assert {tuple(r) for r in result.collect()} == want
    assert {r[0] for r in want} == {"en", "und", "long", ""}
    assert got(df.limit(0)) == set()


def test_products_beyond_64_bits(spark):
    counted = spark.sql("select 'x' as lang, 3000000000000L as a, 4000000000000L as total, 3000000000001L as l, 3000000000007L as r")
    wide = "cast({} as decimal(16,0))".format
    score = F.expr(f"cast(1000 as decimal(4,0)) * {wide('a')} * {wide('total')} div ({wide('l')} * {wide('r')})")
    exact = 1000 * 3000000000000 * 4000000000000 // (3000000000001 * 3000000000007)
    assert counted.select(score).first()[0] == exact


def test_places_without_common_runs_are_padded(spark):
    df = spark.createDataFrame([("a b c", "en")] * 3 + [("a b d", "en")], "text string, lang string")
    found = {(r.w1, r.w2, r.w3): r.n for r in phrases.windows(df.select("lang", "text"), 3, 3).collect()}
    assert found == {("a", "b", "c"): 3, ("a", "b", None): 1, ("b", "c", None): 3, ("b", None, None): 1, ("c", None, None): 3, (None,) * 3: 1}


def test_counts_whatever_stands_on_shared_bits(spark, monkeypatch):
    # With every bit set nothing is padded early; the counts are the same.
    df = spark.createDataFrame([("a b a b a c", "en"), ("b a", "fr")] * 2, "text string, lang string")
    want = sorted(map(str, phrases.phrase_counts(df, 3, 2).collect()))
    monkeypatch.setattr(phrases, "common_runs", lambda *_: np.full(1 << (bits.BITS - 3), 255, np.uint8))
    assert sorted(map(str, phrases.phrase_counts(df, 3, 2).collect())) == want


def test_chunks_cut_between_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(words, "CHUNK", 4)
    parts = list(words.chunks(pa.array(["ab", "cdefgh", None, "i", "jklm", "n"])))
    assert parts == [(0, [b"ab", b"cdefgh"]), (2, [b"", b"i", b"jklm"]), (5, [b"n"])]
