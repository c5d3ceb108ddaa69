"""Decontamination, substrings, fingerprints and personal data against brute force, with awkward rows."""

import collections
import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import decontaminate as D
from quire.llm import private as P
from quire.llm import simhash as S
from quire.llm import substrings as U
from quire.llm.components import components

SCHEMA = "doc_id bigint, text string, TEXT_ string, n_words string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)


def prose(seed, n, words=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def corpus():
    shared = prose(1, 60, 900)
    docs = [(i, prose(i + 10, 120, 900)) for i in range(12)]
    docs += [(20, docs[0][1]), (21, docs[0][1]), (22, shared + " tail"), (23, "head " + shared), (24, (prose(3, 10, 900) + " ") * 9), (25, None), (26, ""), (27, " \t "), (28, "É a b"), (20, docs[0][1]), (None, docs[0][1]), (29, "x" * 200_000)]
    return docs


def test_contamination(spark):
    items = [(1, prose(1, 60, 900)), (2, "Ab, cd"), (3, None), (3, ""), (None, "w1 w2"), (1, prose(1, 60, 900)), (4, prose(10, 30, 900))]
    docs = [*corpus(), (40, "x ab cd ab-cd"), (41, "ab")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = collections.Counter()
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for i, x in items:
            v = split(x)
            n = min(10, len(v))
            for k in range(len(v) - n + 1) if v and i is not None else ():
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == v[k : k + n]:
                        hit |= set(range(a, a + n))
                        found.add(i)
        expected[(d, len(w), len(hit), tuple(sorted(found)))] += 1
    for block in (D.BLOCK_BYTES, 100):
        found = D.contamination(frame(spark, docs), bench, block_bytes=block)
        rows = found.select("doc_id", "n_words", D.covered(F.col("runs")).alias("n"), F.array_distinct(F.transform("runs", lambda r: r["item_id"])).alias("i")).collect()
        assert collections.Counter((r[0], r[1], r[2], tuple(sorted(r[3]))) for r in rows) == expected


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contamination(frame(spark, []), none).count() == 0
    assert D.contamination(frame(spark, [(1, "a")]), none).first()["runs"] == []


def test_proximity(spark):
    index = D.build_index(frame(spark, [(1, "a x x b"), (2, "a x x x x x b"), (3, "b a"), (4, None)]))
    found = D.search_proximity(index, [(7, ("a", "b"))], 3)
    assert {r["doc_id"]: [(x["start"], x["stop"]) for x in r["runs"]] for r in found.collect()} == {1: [(0, 4)], 2: [], 3: [(0, 2)], 4: []}


def test_substrings(spark):
    docs = corpus()
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    expected = collections.Counter()
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        expected[(d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    for chars in (U.SHARD_CHARS, 2_000):
        rows = U.repeated_passages(frame(spark, docs), shard_chars=chars).collect()
        assert collections.Counter((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"]) for r in rows) == expected
    assert U.repeated_passages(frame(spark, [])).count() == 0


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [S.TILE, 3])
def test_near_duplicates(spark, tile):
    base = prose(5, 400, 9000).split()
    docs = corpus() + [(100 + i, " ".join([*base[:i], "new", *base[i + 1 :]])) for i in range(12)]
    prints = [plain_print(t) for _, t in docs]
    group = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((d for (d, _), x in zip(docs, group) if x == g and d is not None), default=None) for g in group}
    expected = collections.Counter((d, p, least[g]) for (d, _), p, g in zip(docs, prints, group))
    rows = S.near_duplicates(frame(spark, docs), tile=tile).collect()
    assert collections.Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in rows) == expected


def test_no_documents(spark):
    assert S.near_duplicates(frame(spark, [])).count() == 0
    assert P.private_spans(frame(spark, [])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (1, 2)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_base_private(spark):
    docs = [(1, "a@b.c_d@e.f x@y 1.2.3.4.5 300.1.1.1 +1 234 567 8901x é😀 foo@bar.com"), (2, None), (3, ""), (4, "4111 1111 1111 1111 4111-1111-1111-1111"), (5, "a.b@c-d.e.f.g. 00255.001.1.1 4111111111111111"), (6, "1" * 5000 + " " + "1 " * 5000 + "a" * 50_000 + "@" + "b." * 5000 + "c"), (7, "x\x01y@z.com 4111\x011111 1.1.1.1"), (1, "a@b.c"), (None, "a@b.cc")]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, value):
        d = re.sub("[^0-9]", "", value)
        if kind == "card":
            twice = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
            return 16 <= len(d) <= 19 and sum(twice) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "phone": 8 <= len(d) <= 15}[kind]

    expected = collections.Counter((d, ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t or "") if good(k, m[0]))) for d, t in docs)
    found = P.private_spans(frame(spark, docs)).select("doc_id", P.listed(F.col("base"))).collect()
    assert collections.Counter(map(tuple, found)) == expected


def test_contexts_find_more(spark):
    docs = [(i, f"words {i} please call +1 555 123 4{i:03d} now") for i in range(8)] + [(20, "so please call 555-0199-77 today"), (21, "it weighs 555-0199-77 grams")]
    found = {r["doc_id"]: r["s"] for r in P.private_spans(frame(spark, docs)).select("doc_id", P.listed(F.col("spans")).alias("s")).collect()}
    assert found[20] == "phone:15:26" and found[21] == ""
    text = spark.createDataFrame([("so please call 555-0199-77 today", [(3, 15, 26)])], "text string, spans array<struct<kind:int,start:bigint,stop:bigint>>")
    assert text.select(P.masked(F.col("text"), F.col("spans"))).first()[0] == "so please call [PHONE] today"


def test_hash_is_stable():
    assert hashlib.sha256(str(plain_print("a b c")).encode()).hexdigest() == hashlib.sha256(str(S.fingerprint("A b\tC")).encode()).hexdigest()


def test_postings_are_held_a_few_segments_at_a_time(spark, monkeypatch):
    made = []
    monkeypatch.setattr(D, "stored", lambda *a, f=D.stored, **b: made.append(f(*a, **b)) or made[-1])
    monkeypatch.setattr(D, "SEGMENT_WORDS", 3)
    docs = spark.createDataFrame([(i, "a b c d") for i in range(50)], "doc_id bigint, text string").coalesce(1)
    found = D.contamination(docs, spark.createDataFrame([(1, "b c")], "item_id bigint, text string"))
    assert found.where("runs[0].start = 1 and runs[0].stop = 3").count() == 50
    groups = [file.metadata.row_group(i).num_rows for f in made[0].inputFiles() for file in [pq.ParquetFile(f.removeprefix("file://"))] for i in range(file.metadata.num_row_groups)]
    # All 50 were one group before, written and read from memory.
    assert sum(groups) == 50 and max(groups) <= D.SEGMENTS_HELD
