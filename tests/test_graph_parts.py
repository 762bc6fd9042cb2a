"""Few edges stay in few partitions between the rounds of a component search."""

import random

from millrace.operators import graph


def test_rounds_leave_few_files(spark, monkeypatch):
    sizes = []
    write = graph.checkpointed

    def seen(df):
        done = write(df)
        sizes.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(graph, "checkpointed", seen)
    given = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in given}
    path = list(range(200))
    random.Random(1).shuffle(path)
    edges = [(a, b) for a, b in zip(path, path[1:])] + [(500, 501), (502, 500), (501, 501)]
    want = {n: min(path) for n in path} | {500: 500, 501: 500, 502: 500}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want
    assert len(sizes) > 2 and max(sizes[1:]) <= graph.LEAST
