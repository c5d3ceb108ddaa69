"""The stored index, as-of versions, swept boxes, folder reach, cascades, imports, bookmarks and the like on hand rows and against plain Python."""

import collections
import datetime
import os
import random
import time

from pyspark.sql import functions as F

from quire.operators import compare as C
from quire.operators import entities as E
from quire.operators import history as K
from quire.operators import library as J
from quire.operators import manifest as I
from quire.operators import search as S
from quire.operators.chunk_index import ChunkIndex

AT = datetime.datetime(2024, 1, 1)


def rows(df, *columns):
    return collections.Counter(map(tuple, (df.select(*columns) if columns else df).collect()))


def files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_index_changes_only_its_buckets(spark, tmp_path):
    chunks = spark.createDataFrame([(d, c, f"text {d} {c}") for d in range(40) for c in range(3)] + [(None, 9, "lost")], "doc_id bigint, chunk bigint, content string")
    path = f"{tmp_path}/index"
    index = ChunkIndex(spark, f"file://{path}", chunks.schema, 8)
    index.create(chunks)
    assert rows(index.read()) == rows(chunks.where("doc_id is not null")) and len(files(path)) == 8
    before = files(path)
    index.add(spark.createDataFrame([(7, 1, "new"), (None, 1, "x")], chunks.schema))
    same, forced = files(path), spark.createDataFrame([(7, 5, "forced")], chunks.schema)
    # A known document is passed over; its bucket alone is written.
    assert rows(index.read()) == rows(chunks.where("doc_id is not null")) and len(set(before) - set(same)) == 1
    index.add(forced, force=True)
    index.add(forced, force=True)
    index.add(spark.createDataFrame([(100, 1, "fresh")], chunks.schema))
    expected = rows(chunks.where("doc_id <> 7").unionByName(forced)) + collections.Counter([(100, 1, "fresh")])
    assert rows(index.read()) == expected
    assert rows(index.of_documents(spark.createDataFrame([(7,), (100,)], "doc_id bigint"))) == collections.Counter([(7, 5, "forced"), (100, 1, "fresh")])
    kept = files(path)
    index.remove(spark.createDataFrame([(100,), (555,), (None,)], "doc_id bigint"))
    assert len(set(kept) - set(files(path))) <= 2 and (100, 1, "fresh") not in rows(index.read())
    # All documents may go; the buckets are emptied.
    index.remove(chunks.select("doc_id"))
    assert index.read().count() == 0
    index.add(chunks)
    assert rows(index.read()) == rows(chunks.where("doc_id is not null"))


def test_versions_as_of(spark):
    r = random.Random(1)
    day = lambda n: AT + datetime.timedelta(hours=n)
    versions, number = [], collections.Counter()
    for _ in range(300):
        d = r.choice([1, 1, 1, 2, 3, 4])
        number[d] += 1
        versions.append((d, number[d], 100 + number[d], 7 * number[d], day(r.randint(0, 900))))
    points = [(r.randint(0, 5), day(r.randint(-20, 1000))) for _ in range(400)] + [(1, versions[0][4]), (None, AT), (2, None)]
    table = spark.createDataFrame(versions + [(1, 99, 1, 1, None)], "document_id bigint, version_number int, blob_id bigint, size bigint, created_at timestamp")
    found = J.versions_as_of(table, spark.createDataFrame(points + points[:3], "document_id bigint, at timestamp"), 86_400)
    expected = collections.Counter()
    for d, at in points + points[:3]:
        if d is not None and at is not None:
            best = max(((v[4], v[1], v) for v in versions if v[0] == d and v[4] <= at), default=None)
            expected[(d, at, *(best[2][1:4] if best else (None,) * 3))] += 1
    assert rows(found) == expected
    assert J.versions_as_of(table.limit(0), spark.createDataFrame(points[:1], "document_id bigint, at timestamp")).first()["version_number"] is None


def test_boxes_by_a_sweep(spark):
    r = random.Random(5)
    schema = "doc_id bigint, page int, item_idx int, str string, x double, y double, width double, height double, has_eol boolean"
    items, text = [], ""
    for i in range(400):
        s = r.choice(["", "ab", "cde", None, "f"])
        items.append((1, 1, i, s, r.uniform(0, 500), r.uniform(0, 500), 9.0, 5.0, r.random() < 0.2))
        text += (s or "") + ("\n" if items[-1][8] else "")
    matches = []
    for _ in range(120):
        a = r.randrange(len(text))
        matches.append((1, 1, a, text[a : a + r.randint(1, 30)]))
    found = S.match_rects(spark.createDataFrame(matches, "doc_id bigint, page int, start int, text string"), spark.createDataFrame(items, schema))
    expected, at, spans = collections.Counter(), 0, []
    for it in items:
        n = len(it[3] or "")
        spans.append((at, at + n, it))
        at += n + it[8]
    for m in matches:
        hit = [it for a, b, it in spans if a < m[2] + len(m[3]) and b > m[2]]
        if hit:
            x = min(it[4] for it in hit)
            expected[(*m, x, min(it[5] for it in hit), max(it[4] + it[6] for it in hit) - x, 5.0)] += 1
    assert rows(found) == expected
    # A page of 100,000 items and 10,000 matches: their product would be a billion.
    n = 100_000
    many = spark.range(n).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("item_idx"), F.lit("abcde").alias("str"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), F.lit(False).alias("has_eol"))
    asked = spark.range(10_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(1).alias("page"), (F.col("id") * 49).cast("int").alias("start"), F.lit("abcdefgh").alias("text"))
    began = time.time()
    assert S.match_rects(asked, many).count() == 10_000 and time.time() - began < 60


def test_folders_chain_and_ring(spark):
    n = 10_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    began = time.time()
    assert J.folder_subtree(chain, n - 3).count() == 3 and J.folder_subtree(chain, 77_777).count() == 0
    assert J.folder_subtree(chain, 0).count() == n and time.time() - began < 150
    small = [(i, i - 1 if i else None) for i in range(33)] + [(100, 102), (101, 100), (102, 101), (103, 101), (200, 999)]
    up = dict(small)
    expected = collections.Counter()
    for i in up:
        at, level, seen = i, 0, set()
        while at in up and at not in seen:
            seen.add(at)
            expected[(at, i, level)] += 1
            at, level = up[at], level + 1
    table = spark.createDataFrame(small + [(None, 1)], "id bigint, parent_id bigint")
    assert rows(J.folder_tree(table)) == expected
    assert {x["id"] for x in J.folder_subtree(table, 101).collect()} == {100, 101, 102, 103}


def test_cascade(spark):
    talk = "conv_id bigint, document_ids array<bigint>, updated_at timestamp"
    tables = {
        "documents": spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id bigint, name string"),
        "blobs": spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "document_id bigint, id bigint"),
        "conversations": spark.createDataFrame([(1, [1], AT), (2, [1, 2, 1], AT), (3, [], AT), (4, None, AT), (5, [1, 1], AT), (6, [2, None], AT)], talk),
        "messages": spark.createDataFrame([(1, "x"), (2, "y"), (5, "z"), (7, "w")], "conv_id bigint, text string"),
    }
    later = AT + datetime.timedelta(days=1)
    left = J.delete_documents(spark.createDataFrame([(1,), (1,), (None,)], "document_id bigint"), tables, later)
    assert rows(left["documents"]) == collections.Counter([(2, "b"), (None, "c")]) and rows(left["blobs"]) == collections.Counter([(2, 20), (None, 30)])
    assert {x["conv_id"]: (x["document_ids"], x["updated_at"]) for x in left["conversations"].collect()} == {2: ([2], later), 3: ([], AT), 4: (None, AT), 6: ([2, None], AT)}
    assert rows(left["messages"]) == collections.Counter([(2, "y"), (7, "w")])


def test_import(spark):
    schema = "id bigint, filename string, content binary, mime_type string, page_count int, tags array<string>, folder_id string, outcome string"
    new = [(1, "a", bytearray(b"%PDF-1"), None, 1, ["x"], "f", ""), (2, "b", bytearray(b""), None, 1, None, None, ""), (3, "c", bytearray(b"%PDF-1"), "text/html", 1, None, None, ""), (4, "d", bytearray(b"PDF"), "application/pdf", 1, None, None, ""), (5, "e", bytearray(b"%PDF-2"), "", 1, None, None, ""), (6, "f", None, None, None, None, None, ""), (1, "longer", bytearray(b"%PDF-longer"), None, 2, None, None, "")]
    out = J.import_files(spark.createDataFrame(new, schema), spark.createDataFrame([(5,), (None,)], "id bigint"), AT)
    assert {x["id"]: x["outcome"] for x in out["outcomes"].collect()} == {1: "imported", 2: "error", 3: "error", 4: "error", 5: "skipped", 6: "error"}
    assert tuple(out["counts"].first()) == (1, 1, 4)
    document, blob, version = out["documents"].first(), out["blobs"].first(), out["versions"].first()
    assert document["filename"] == "longer" and document["current_version_id"] == version["id"] and version["blob_id"] == blob["id"] and blob["size"] == 11 and version["version_number"] == 1


def test_bookmarks_of_any_depth(spark):
    import json

    nest = {"title": "deepest", "dest": 1, "items": []}
    for k in range(12):
        nest = {"title": f" level {k} " if k % 3 else " \t", "dest": 0, "items": [nest, {"title": "out", "dest": 9, "items": []}]}
    outlines = spark.createDataFrame([(1, json.dumps([nest, {"title": "last", "dest": 1}])), (2, json.dumps([{"title": "two", "dest": 0, "items": []}])), (3, None), (4, "{bad"), (5, "[]")], "doc_id bigint, outline string")
    docs = spark.createDataFrame([(1, 1, 2, 3), (1, 2, 1, 2), (1, 3, 3, 1), (2, 1, 4, 5)], "bundle bigint, position int, doc_id bigint, page_count bigint")
    found = sorted(tuple(x) for x in I.merge_bookmarks(docs, outlines).collect())
    levels = [f"level {k}" for k in range(11, -1, -1) if k % 3]
    assert found == [(1, 0, 2, "two", 0)] + [(1, i + 1, 1, t, 3) for i, t in enumerate(levels)] + [(1, len(levels) + 1, 1, "deepest", 4), (1, len(levels) + 2, 1, "last", 4)]
    checks = I.merge_checks(spark.createDataFrame([(1,), (2,), (3,)], "bundle bigint"), docs, 2)
    assert {x["bundle"]: x["error"] for x in checks.collect()} == {1: "Cannot merge more than 2 documents at once", 2: None, 3: "No documents provided for merging"}


def test_labels_and_images(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 7)], "doc_id bigint, page int")
    assert [x["label"] for x in I.page_labels(pages, "x-of-y", start_page=3, end_page=5, start_number=1).orderBy("page").collect()] == ["1 of 6", "2 of 6", "3 of 6"]
    assert [x["label"] for x in I.page_labels(pages, "custom").orderBy("page").collect()] == list("123456")
    images = spark.createDataFrame([(1, 1, 1, "a", 10, 10, "DCTDecode"), (1, 1, 2, "a", 99, 99, None), (1, 1, 3, "", 50, 50, None), (1, 2, 4, "b", 3, 50, None), (1, 2, 5, "c", 11, 11, "JPXDecode"), (1, 2, 6, "d", 11, 11, None)], "doc_id bigint, page int, seq int, object_name string, width int, height int, filter string")
    assert [tuple(x)[1:] for x in I.image_metadata(images, 5, 5).orderBy("index").collect()] == [(0, 1, "a", "jpeg", 10, 10, 30, "image_page1_1.jpeg"), (1, 2, "c", "jp2", 11, 11, 363, "image_page2_2.jp2"), (2, 2, "d", "png", 11, 11, 182, "image_page2_3.png")]
    assert {x["page"]: (x["images"], x["total"]) for x in I.image_counts(pages, images).collect()} == {1: (1, 4), 2: (3, 4), 3: (0, 4), 4: (0, 4), 5: (0, 4), 6: (0, 4)}


def test_page_comparison(spark):
    page = "pair_id bigint, page int, width double, height double"
    a, b = spark.createDataFrame([(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0)], page), spark.createDataFrame([(1, 1, 600.9, 800.0), (1, 2, 601.0, 800.0), (1, 3, 600.0, 800.0)], page)
    line = "pair_id bigint, page int, line_no int, text string"
    left, right = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 1, "y"), (1, 2, 2, "z")], line), spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 1, "Y"), (1, 2, 2, "z")], line)
    diff = C.line_diff(left, right)
    found = C.page_comparison(a, b, diff, spark.createDataFrame([(1, 2, 51.0)], "pair_id bigint, page int, score double"))
    assert {x["page"]: tuple(x)[2:] for x in found.collect()} == {1: ("both", True, 1, 50, None, 50), 2: ("both", False, 1, 100, 51.0, 76), 3: ("added", True, 1, 100, None, 100)}
    assert tuple(C.comparison_summary(found, diff).first()) == (1, 2, 3, 3, 0, 1, 0, 0, 1, 75, 51)
    pairs = C.compare_page_pairs(spark.createDataFrame([(1, 2, 2), (1, 1, 1), (1, 1, 2)], "pair_id bigint, page_a int, page_b int"), left, right, a, b)
    assert {(x["page_a"], x["page_b"]): tuple(x)[3:] for x in pairs.collect()} == {(2, 2): (1, 100, False, 50), (1, 1): (1, 50, True, 50), (1, 2): (3, 0, False, 0)}


def test_prompts_and_statistics(spark):
    talk = spark.createDataFrame([(1, t, "system" if t == 1 else "user" if t % 2 else "assistant", f"m{t}") for t in range(4)] + [(2, 0, "user", None)], "conv_id bigint, turn int, role string, text string")
    settings = spark.createDataFrame([(1, "S", "C"), (2, "", None)], "conv_id bigint, system string, context string")
    assert {x["conv_id"]: x["prompt"] for x in K.local_prompts(talk, settings, 2).collect()} == {1: "System: S\n\nContext:\nC\n\nAssistant: m2\n\nUser: m3\n\nAssistant:", 2: "User: \n\nAssistant:"}
    assert [tuple(x) for x in K.cloud_messages(talk.where("conv_id = 1"), settings).orderBy("seq").collect()] == [(1, 0, "system", "S"), (1, 1, "assistant", "m0"), (1, 2, "assistant", "m2"), (1, 3, "user", "m3")]
    runs = spark.createDataFrame([(1, "a", "x", "succeeded", AT, AT + datetime.timedelta(seconds=3)), (2, "a", None, "failed", AT, None), (3, "a", "x", "running", AT, None)], "run_id bigint, operation string, engine string, status string, created_at timestamp, completed_at timestamp")
    stats = {(x["operation"], x["engine"], x["status"], x["level"]): x for x in K.run_statistics(runs, spark.createDataFrame([(1, 5), (1, 6)], "run_id bigint, size bigint")).collect()}
    whole = stats[None, None, None, 7]
    assert (whole["runs"], whole["success_rate"], whole["artifacts"], whole["bytes"], whole["mean_ms"]) == (3, 0.5, 2, 11, 3000.0)
    # A null engine and all engines are told apart by their level.
    assert stats["a", None, None, 1]["runs"] == 1 and stats["a", None, None, 3]["runs"] == 3


def test_named_groups(spark):
    assert E.group_names(r"\((?<a>x)[(](?:y)(?<b>z(q))(?=w)(?<!u)(?<c2>v)") == {"a": 1, "b": 2, "c2": 4}
    pages = spark.createDataFrame([(1, 1, "k=v and k= then z"), (2, 1, None)], "doc_id bigint, page int, text string")
    found = E.extract_custom_named(pages, {"pair": r"(?<key>\w)=(?<value>\w)?", "plain": "z"}).collect()
    assert [(x["start"], x["name"], x["groups"]) for x in found] == [(0, "pair", {"$1": "k", "$2": "v", "key": "k", "value": "v"}), (8, "pair", {"$1": "k", "key": "k"}), (16, "plain", None)]
