"""Top-k against all scores."""

import math
import random

from quillon.llm import topk_search as ts


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % 5 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for i, q in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_against_all_scores(spark):
    rng = random.Random(2)
    vector = lambda n: [round(rng.uniform(-1, 1), 3) for _ in range(n)]
    hot = vector(8)
    rows = [(i, hot if i % 3 == 0 else vector(8)) for i in range(120)]
    rows += [(200, vector(3)), (201, vector(3)), (205, None), (210, []), (215, [1.0, None] + [0.0] * 6), (220, [float("nan")] * 8), (225, [float("inf")] * 8), (None, vector(8)), (7, rows[7][1]), (10, vector(8)), (-5, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(5)
    for k in (1, 10, 500):
        assert sorted(tuple(r) for r in ts.top_k(frame, "vec_id % 5 = 0", k).collect()) == brute(rows, k)
    ts.QUERY_BLOCK, keep = 7, ts.QUERY_BLOCK
    try:
        assert sorted(tuple(r) for r in ts.top_k(frame, "vec_id % 5 = 0", 3).collect()) == brute(rows, 3)
        ts.QUERY_BLOCK = 3  # so many blocks that their answers are written
        assert sorted(tuple(r) for r in ts.top_k(frame, "vec_id % 5 = 0", 3).collect()) == brute(rows, 3)
    finally:
        ts.QUERY_BLOCK = keep
    assert ts.top_k(frame.limit(0), "vec_id % 5 = 0").count() == 0
