"""Consistent weighted sampling against the exact generalised Jaccard similarity, and neighbours against a sorted list."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import fingerprints as P

VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "Mi", "ne", "or", "pu", "ré", "st") for b in ("n", "dar", "x", "vil", "q", "Ös", "ta", "im", "y", "be")]


def jaccard(a, b):
    a, b = (collections.Counter(t.lower().split()) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0


def bags(spark, groups):
    """Rows of (g, word, x, y) for pairs of texts."""
    rows = []
    for g, pair in enumerate(groups):
        x, y = (collections.Counter(t.split()) for t in pair)
        rows += [(g, w, x[w], y[w]) for w in x | y]
    return spark.createDataFrame(rows, "g int, word string, x int, y int")


def test_collision_rate_is_generalised_jaccard(spark):
    r = random.Random(2)
    pairs = [("a a a a b", "a b"), ("a b c d", "a b c d"), ("a " * 100 + "b", "b " * 100 + "a"), ("a b", "c d"), ("a", "a a a")]
    for n in (3, 30, 300):
        words = [r.choice(VOCABULARY) for _ in range(n)]
        pairs.append((" ".join(words), " ".join(words[n // 3 :] + r.choices(VOCABULARY, k=n // 3))))
    samples = 1024
    found = P.fingerprints(bags(spark, pairs), ["g"], ["x", "y"], samples).select("g", "x", P.likeness(F.col("x"), F.col("y")).alias("near")).collect()
    assert all(len(row["x"]) == 4 * samples for row in found)
    for row in found:
        j = jaccard(*pairs[row["g"]])
        # Four standard errors.
        assert abs(row["near"] - j) <= 4 * (j * (1 - j) / samples) ** 0.5 + 1e-12, (pairs[row["g"]], row["near"], j)


def test_empty_groups(spark):
    table = spark.createDataFrame([(1, "", 1, 0), (2, "a", 0, 2), (3, "", 1, 1), (3, "a", 3, 3)], "g int, word string, x int, y int")
    found = {r["g"]: (r["x"], r["y"], r["near"]) for r in P.fingerprints(table, ["g"], ["x", "y"]).select("*", P.likeness(F.col("x"), F.col("y")).alias("near")).collect()}
    assert found[1] == ("", "", 1.0) and found[2][0] == "" and found[2][1] and found[2][2] == 0.0 and found[3][2] == 1.0


def neighbours(docs):
    """(doc_id, n_chars, edited) in the order of the operator, equal doc_ids in any order."""
    out = collections.Counter()
    for k, (d, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        h = len(t) // 2
        out[(d, len(t), t[: len(t) - h] + after[:h])] += 1
    return out


@pytest.mark.parametrize("zone_chars", [400, 10**9])
def test_neighbours(spark, monkeypatch, zone_chars):
    monkeypatch.setattr(P, "ZONE_CHARS", zone_chars)
    r = random.Random(6)
    docs = [(i, " ".join(r.choices(VOCABULARY, k=r.randint(1, 60)))) for i in range(-20, 60)]
    docs += [(70, ""), (71, "x"), (72, "\t é😀 \n😀"), (73, docs[3][1]), (-(2**63), "least of all"), (2**63 - 1, "word " * 30_000)]
    docs.sort(key=lambda x: -x[0])
    table = spark.createDataFrame([(d, t, "en", 1) for d, t in docs], "doc_id bigint, text string, zone string, rn int").repartition(5)
    found = P.neighbour_fingerprints(table).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = neighbours(docs)
    assert collections.Counter((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in found) == collections.Counter({(d, n, sha(e)): c for (d, n, e), c in expected.items()})
    of = {x["doc_id"]: x for x in found}
    edited = {d: e for d, _, e in expected}
    text = dict(docs)
    errors = []
    for k, (d, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        errors += [of[d]["near_edited"] - jaccard(t, edited[d]), of[d]["near_next"] - jaccard(t, after)]
        assert (of[d]["edited_fingerprint"] == of[d]["fingerprint"]) >= (t == edited[d])
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1
    assert of[73]["fingerprint"] == of[docs[[x for x, _ in docs].index(-17)][0]]["fingerprint"] and text[73] == text[-17]
    assert of[70]["fingerprint"] == "" and of[70]["near_edited"] == 1.0 and of[70]["near_next"] == 0.0


def test_ties_nulls_and_repeats(spark):
    docs = [(5, "one two three four"), (5, "one two three four"), (5, "five six seven"), (None, None), (None, "eight nine"), (4, None), (4, None)]
    rows = lambda df: collections.Counter(map(tuple, df.collect()))
    found = P.neighbour_fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert rows(found.groupBy("doc_id", "n_chars").count()) == collections.Counter([(5, 18, 2), (5, 14, 1), (None, 0, 1), (None, 10, 1), (4, 0, 2)])
    assert found.where("near_next < 0 or near_next > 1 or near_next is null or near_edited is null").count() == 0
    # However the rows are dealt, the order of equal doc_ids is that of their texts' hashes.
    again = P.neighbour_fingerprints(spark.createDataFrame(docs[::-1], "doc_id bigint, text string").repartition(3))
    assert rows(found) == rows(again)
    one = P.neighbour_fingerprints(spark.createDataFrame([(1, "only one here")], "doc_id bigint, text string")).first()
    assert one["near_next"] == 1.0
    assert P.neighbour_fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_samples_at_once_do_not_matter(spark, monkeypatch):
    from quire.llm import fingerprints as X

    assert X.AT_ONCE <= 8
    docs = spark.createDataFrame([(1, "a b c a"), (2, "b c d"), (3, ""), (4, None)], "doc_id bigint, text string")
    few = sorted(map(tuple, X.neighbour_fingerprints(docs).collect()))
    monkeypatch.setattr(X, "AT_ONCE", 32)
    assert sorted(map(tuple, X.neighbour_fingerprints(docs).collect())) == few
