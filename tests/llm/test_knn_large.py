"""Exact top-k search over vectors whose products go beyond 64 bits."""

import math
import random

from quire.llm import knn


def test_large_finite_vectors_take_part(spark):
    r = random.Random(1)
    size = lambda i: 2.0 ** r.choice((0, 8, 20, 30, 45))
    rows = [(i, [r.uniform(-1, 1) * m for _ in range(4)]) for i in range(120) for m in (size(i),)] + [(500, [1e300, 0.0, 0.0, 0.0]), (501, None), (502, [float("nan")] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = knn.top_k(knn.quantised(vectors), knn.F.col("vec_id") % 10 == 0, 5, pivots=8, group_queries=4, block_rows=30).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows[:120]}
    expected = []
    for q in range(0, 120, 10):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        expected += [(q, n, i, -s if -(2**63) <= -s < 2**63 else None) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, found)) == sorted(expected)
    assert any(e[3] is None for e in expected) and any(e[3] is not None for e in expected)
