"""Vector scores in small blocks: every pair once, and a bounded part of them in a task at a time."""

import inspect
import random

import numpy as np

from quire.operators import retrieval as R


def test_blocks_and_slices_leave_no_pair_out(spark):
    r = random.Random(5)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(700)]
    queries = spark.createDataFrame(vectors[:430], "query_id bigint, vector array<double>")
    chunks = spark.createDataFrame(vectors, "chunk_id bigint, embedding array<double>")
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # More queries in a block than a slice has, and more blocks than one on both sides.
    found = R.vector_scores(queries, chunks, 300, 210).collect()
    assert len(found) == 430 * 700 and all(abs(a["score"] - x[a["query_id"]] @ x[a["chunk_id"]]) < 1e-9 for a in found)
    first = R.vector_search(queries, chunks, 3, -1.0, 300, 210).where("query_id % 43 = 0").collect()
    for q in range(0, 430, 43):
        assert [a["chunk_id"] for a in sorted(first, key=lambda a: a["rank"]) if a["query_id"] == q] == np.argsort(-(x[q] @ x.T))[:3].tolist()


def test_blocks_are_bounded():
    held = lambda f: [inspect.signature(f).parameters[p].default for p in ("query_block", "chunk_block")]
    # All scores of two blocks leave a task as one table; a search holds a slice's scores alone.
    assert np.prod(held(R.vector_scores)) <= 2**20
    assert R.SLICE * held(R.vector_search)[1] <= 2**20


def test_scores_send_each_vector_seldom(spark, monkeypatch):
    kind, dealt = type(spark.range(0)), []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, f=kind.mapInArrow, **b: dealt.append(self) or f(self, *a, **b))
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)] if i % 50 else None) for i in range(3000)]
    queries = spark.createDataFrame(rows[:1000], "query_id bigint, vector array<float>")
    chunks = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    assert R.vector_scores(queries, chunks).distinct().count() == 980 * 2940
    # Before, each side was sent for every 512 queries or 2,048 chunks of the other, as doubles.
    assert dict(dealt[0].dtypes)["v"] == "array<float>" and dealt[0].count() <= 2940 + 980 * spark.sparkContext.defaultParallelism
