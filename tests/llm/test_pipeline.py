"""Each stage on the smallest table, held against a plain version of its rule."""

import numpy as np
import public_tokenizers

import corpus_pipeline
from millrace.llm import quality
from millrace.llm.common import fold, table
from millrace.llm.decontaminate import words_of
from millrace.llm.pieces import Pieces
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id") != 0)
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k == 4:
            break
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            assert set(now) == {i for i, t in before.items() if model.score(t or "") >= 0.3}
        elif k == 1:
            assert now == brute_lines(list(before.items()), 50)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif k == 2:
            roots = brute_components([(i, brute_fingerprint(t)) for i, t in before.items()])
            assert set(now) == set(roots.values())
        else:
            items = [f" {' '.join(words_of(r.text))} " for r in table(spark, sf_dir, "benchmark").collect()]
            leaky = {i for i, t in before.items() if any(x in f" {' '.join(words_of(t))} " for x in items)}
            assert not leaky & set(now) and len(set(before) - set(now) - leaky) <= 0.01 * len(before)
        before = now
    pieces = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.collect()
    assert {r.doc_id: pieces.decode(np.array(r.ids, np.int32)) for r in rows} == before


def test_run_returns_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "ids", "score", "others"] and out.count() > 0


def test_stages_take_odd_tables(spark, sf_dir):
    """Null and empty texts, repeated rows, null ids beside large ones, columns named like helpers, and an empty table."""
    line = " ".join(f"word{i}" for i in range(60))
    rows = [
        (None, "plain words of no note", "en", "a", 1, 7, 7, 7), (2**53 + 1, f"start\n{line}", "en", "a", 2, 7, 7, 7), (2, None, None, None, None, 7, 7, 7),
        (3, "", "de", "b", 0, 7, 7, 7), (4, "same text again here", "de", "b", 20, 7, 7, 7), (4, "same text again here", "de", "b", 20, 7, 7, 7), (1, f"{line}\nend", "en", "a", 5, 7, 7, 7),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, removed_runs int, gone_id int, leak_id int"
    for docs in (spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            kept = out.collect()
            assert len(kept) <= docs.count()
            if name != "line_dedup":
                assert {tuple(r) for r in kept} <= {tuple(r) for r in docs.collect()}, name
            elif kept:
                assert {r.doc_id: r.text for r in kept}[2**53 + 1] == "start"
        last = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
        assert sorted(map(str, (r.doc_id for r in last.collect()))) == sorted(map(str, (r.doc_id for r in docs.collect())))
