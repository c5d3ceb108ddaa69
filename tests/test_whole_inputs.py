"""Queries over whole inputs against brute force: all rows, all queries, whole texts, long lines."""

import random

import numpy as np

import __spark_entry__ as entry


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_search_and_similarity(spark, tmp_path):
    r = random.Random(3)
    at = str(tmp_path)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(6)], i % 10) for i in range(620)]
    texts = {i: f"text {i} " + "".join(r.choice("abcde ") for _ in range(900)) for i in range(620)}
    lines = {0: "\n".join("".join(r.choice("abcXYZ") for _ in range(n)) for n in (300, 20, 260, 10, 5, 40, 350, 30))}
    texts |= lines
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    run = lambda name: entry.queries()[name](spark, at).collect()

    x = np.array([np.array(v, np.float32) for _, v, _ in vectors], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = x[::20] @ x.T
    found = {(a["query_id"], a["chunk_id"]): a["score"] for a in run("h2_cosine_similarity_whole")}
    assert len(found) == 31 * 620 and all(abs(found[20 * q, c] - score[q, c]) < 2e-6 for q in range(31) for c in range(620))
    best = lambda q, k: sorted(range(620), key=lambda c: (-score[q, c], c))[:k]
    assert {(a["query_id"], a["rank"], a["chunk_id"]) for a in run("h3_vector_search_whole")} == {(20 * q, n + 1, c) for q in range(31) for n, c in enumerate(best(q, 5)) if score[q, c] >= 0.05}
    context = {a["query_id"]: a["context"] for a in run("h4_build_context_whole")}
    assert len(context) == 31
    for q in range(31):
        first = f"[Page {best(q, 1)[0] % 10 + 1}]: {texts[best(q, 1)[0]]}"
        assert context[20 * q] == (first if len(first) <= 900 else first[:900] + "...") or len(first) < 900 and context[20 * q].startswith(first)
    assert len(run("h5_citations_whole")) == 31 * 8

    similar = {a["line_no"]: a["similarity"] for a in run("g6_string_similarity_whole") if a["pair_id"] == 0}
    line = lines[0].split("\n")[6]
    assert similar == {6: int((1 - distance(line, line.upper()) / len(line)) * 100 + 0.5)}
