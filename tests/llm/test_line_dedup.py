import random

from pyspark.sql import functions as F

from millrace.llm.line_dedup import dedup_lines


def brute(docs, min_words, every_run=False):
    """The docstring's definition with dicts and loops: each run of lines that has the words, or each shortest one from
    a line on and back from one, is deleted where it stands earlier."""
    lines = {
        d: [(p, t.strip(" ").lower(), len(t.split())) for p, t in enumerate(text.split("\n")) if t.split()]
        for d, text in docs
    }
    runs = []
    for d, ls in lines.items():
        for i in range(len(ls)):
            n = 0
            for j in range(i, len(ls)):
                n += ls[j][2]
                if n >= min_words:
                    runs.append((tuple(x[1] for x in ls[i : j + 1]), d, i, j))
                    if not every_run:
                        break
        for j in range(0 if every_run else len(ls)):
            n = 0
            for i in range(j, -1, -1):
                n += ls[i][2]
                if n >= min_words:
                    runs.append((tuple(x[1] for x in ls[i : j + 1]), d, i, j))
                    break
    first = {}
    for content, d, i, _ in sorted(runs, key=lambda m: (m[1], m[2])):
        first.setdefault(content, (d, i))
    gone = {d: set() for d in lines}
    for content, d, i, j in runs:
        if first[content] != (d, i):
            gone[d] |= set(range(i, j + 1))
    out = {}
    for d, text in docs:
        places = {lines[d][k][0] for k in gone[d]}
        for k in gone[d]:
            if k + 1 in gone[d]:
                places |= set(range(lines[d][k][0], lines[d][k + 1][0]))
        out[d] = "\n".join(t for p, t in enumerate(text.split("\n")) if p not in places)
    return out


def result(df, **options):
    return {r.doc_id: r.text for r in dedup_lines(df, **options).collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9))) for _ in range(14)]
    blocks = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))) for _ in range(6)]
    for min_words in (1, 5, 10):
        docs = [
            (i, "\n".join(rng.choice(blocks) if rng.random() < 0.5 else rng.choice(pool) for _ in range(rng.randrange(0, 9))))
            for i in range(120)
        ]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = result(df, min_words=min_words)
        assert got == brute(docs, min_words) == brute(docs, min_words, every_run=True)


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert result(df) == brute(docs, 50)


def test_lines_behind_a_header_that_stands_elsewhere_first(spark):
    head, short = " ".join("h" * 60), " ".join("s" * 45)
    docs = [(1, f"{head}\nother words"), (2, f"{head}\n{short}\nyes"), (3, f"{head}\n{short}\nno")]
    got = result(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == {1: docs[0][1], 2: f"{short}\nyes", 3: "no"}


def test_many_equal_lines_are_one_run(spark):
    line = " ".join("w" * 50)
    df = spark.createDataFrame([(1, "\n".join([line] * 100_000)), (2, "\n".join([line, "x"] * 30_000))], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[1].text == line and [tuple(x) for x in got[1].removed_runs] == [(1, 99_999)]
    # x and a line, twice: every stretch of these repeats from the second on.
    assert got[2].text == "x" and len(got[2].removed_runs) == 2


def test_clashing_names(spark):
    p = " ".join("p" * 51)
    df = spark.createDataFrame([(1, p, 7, 8, 9), (2, p, 7, 8, 9)], "doc_id long, text string, removed_runs int, Doc_Key int, doc_runs int")
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "removed_runs_2"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "" and got[2].removed_runs == 7 and len(got[2].removed_runs_2) == 1


def test_passage_in_other_contexts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    many = "\n".join(f"line {i} of a passage with eight words" for i in range(8))
    docs = [
        (1, f"own start\n{passage}\nown end"),
        (2, f"{many}\nx y z"),
        (3, f"other\n{passage.upper()}  \nline 3 of a passage with eight words"),
        (4, f"before\n\n{many}\nafter {passage}"),
        (5, f"{passage}\nkeep me\n{passage}"),
    ]
    got = result(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got[1] == docs[0][1] and got[2] == docs[1][1]
    assert got[3] == "other\nline 3 of a passage with eight words"
    assert got[4] == f"before\n\nafter {passage}"
    assert got[5] == "keep me"


def test_odd_rows(spark):
    p = " ".join("p" * 51)
    rows = [(1, None, 1), (2, "", 1), (None, p, 1), (3, p, 2), (3, p, 2), (3, p + "\nx", 3), (4, "\n\n", 1), (5, "q " * 200_000, 1), (6, "a\n" * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "runs", "removed_runs"]
    got = sorted(((r.doc_id, r.text, len(r.removed_runs)) for r in out.collect()), key=str)
    tail = [r for r in got if r[0] == 6]
    assert len(tail) == 1 and tail[0][1].count("a") < 100
    want = [(1, None, 0), (2, "", 0), (None, p, 0), (3, "", 1), (3, "", 1), (3, "x", 1), (4, "\n\n", 0), (5, "q " * 200_000, 0)]
    assert [r for r in got if r[0] != 6] == sorted(want, key=str)
    assert dedup_lines(df.limit(0)).collect() == []
    assert out.filter(F.size("removed_runs") > 0).count() == 4
