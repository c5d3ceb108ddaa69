"""Limits, replays, streams and exports: hand rows, brute force, and streams in several micro-batches."""

import collections
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import geometry as G
from quire.operators import history as K
from quire.operators import layout as L
from quire.operators import library as J
from quire.operators import manifest as I
from quire.operators import retrieval as R
from quire.operators import search as S
from quire.sinks import exports as X
from quire.sources import files as A
from quire.streaming import jobs as M


def test_rate_limit(spark):
    arrivals = spark.createDataFrame([(1, 1, 10_000), (1, 2, 10_100), (1, 3, 10_200), (1, 4, 11_000), (2, 5, 10_200), (2, 6, None)], "client bigint, request_id bigint, at_ms bigint")
    assert sorted(tuple(r) for r in I.rate_limit(arrivals, 2, 1000).collect()) == [(1, 1, True, 0), (1, 2, True, 0), (1, 3, False, 1), (1, 4, True, 0), (2, 5, True, 0)]
    assert I.rate_limit(arrivals.limit(0)).count() == 0


def streamed(spark, tmp_path, rows, schema, order):
    """A stream of the rows, a file and so a micro-batch for each part in order."""
    at = f"{tmp_path}/source"
    parts = [rows[i :: 1][: len(rows) // 3 + 1] for i in range(0, len(rows), len(rows) // 3 + 1)]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{at}/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)


def moments(n, seed):
    r = random.Random(seed)
    at = datetime.datetime(2024, 1, 1)
    for _ in range(n):
        at += datetime.timedelta(seconds=r.randint(1, 400))
        yield at


def test_limit_stream_is_the_batch_one(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randint(1, 4), i, at) for i, at in enumerate(moments(150, 5))]
    stream = streamed(spark, tmp_path, rows, "client bigint, request_id bigint, ts timestamp", "ts")
    found = M.replayed(M.rate_limit(stream, 3, 900_000, "1 hour"), "limit").collect()
    batch = I.rate_limit(spark.createDataFrame(rows, "client bigint, request_id bigint, ts timestamp").select("client", "request_id", F.unix_millis("ts").alias("at_ms")), 3, 900_000).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(map(tuple, batch))


def test_job_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, 1, "queued", at(0)), (1, 2, "succeeded", at(1)), (2, 3, "queued", at(2)), (1, 4, "failed", at(3)), (3, 5, "queued", at(100)), (3, 6, "running", at(101)), (4, 7, "queued", at(102)), (4, 8, "cancelled", at(103)), (5, 9, "queued", at(400))]
    stream = streamed(spark, tmp_path, rows, "job_id bigint, event_id bigint, status string, updated_at timestamp", "updated_at")
    found = M.replayed(M.job_lifecycle(stream, "1 minute", 1800), "jobs").collect()
    got = {(r["job_id"], r["event_id"], r["outcome"]) for r in found}
    assert {(1, 1, "accepted"), (1, 2, "accepted"), (1, 4, "rejected"), (2, 3, "accepted"), (4, 8, "accepted")} <= got
    # Unfinished jobs expire when the watermark passes 30 minutes after their first event; finished ones don't, and the last has time left.
    assert {r["job_id"]: r["at"] for r in found if r["outcome"] == "expired"} == {2: at(32), 3: at(130)}


def test_replay_stream_and_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randint(1, 3), i, r.choice(["add", "add", "undo", "redo"]), r.random() < 0.8) for i in range(120)]
    table = spark.createDataFrame(rows, "document_id bigint, seq bigint, action string, can_undo boolean")
    expected, state = set(), collections.defaultdict(lambda: [[], -1])
    for d, s, action, can in rows:
        held, index = state[d]
        before = (list(held), index)
        if action == "add":
            held = held[: index + 1] + [can]
            held = held[-5:]
            index = len(held) - 1
        elif action == "undo":
            index -= index >= 0 and held[index]
        else:
            index += index < len(held) - 1
        applied = action == "add" or (held, index) != before
        state[d] = [held, index]
        expected.add((d, s, action, applied, len(held), index, sum(held[: index + 1]), len(held) - 1 - index))
    assert {tuple(x) for x in K.history_replay(table, 5).collect()} == expected
    stream = streamed(spark, tmp_path, rows, "document_id bigint, seq bigint, action string, can_undo boolean", "seq")
    assert {tuple(x) for x in M.replayed(M.history_replay(stream, 5), "replay").collect()} == expected


def test_chat_stream(spark):
    lines = [(1, 0, 'data: {"id": "a", "choices": [{"delta": {"content": "Hel"}, "finish_reason": null}]}'), (1, 1, ""), (1, 2, "data: {bad"), (1, 3, 'data: {"id": "a", "choices": [{"delta": {"content": "lo"}}]}'), (1, 4, 'data: {"id": "a", "choices": [{"delta": {}, "finish_reason": "stop"}]}'), (1, 5, "data: [DONE]"), (1, 6, None)]
    table = spark.createDataFrame(lines, "stream_id bigint, seq bigint, line string")
    assert [tuple(r) for r in M.assemble_chat_stream(table).collect()] == [("a", "Hello", 3, True, "stop")]
    assert M.assemble_chat_stream(table.limit(0)).count() == 0


def test_files(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.4 x"), ("b.pdf", b""), ("c.pdf", b"PK.."), ("sub.pdf", b"%PDF-" + b"0" * 50), ("d.txt", b"%PDF-")):
        (tmp_path / name).write_bytes(data)
    found = {r["path"].rsplit("/", 1)[1]: (r["error"], r["content"] is None) for r in A.read_pdf_files(spark, str(tmp_path), most=40).collect()}
    assert found == {"a.pdf": (None, False), "c.pdf": ("INVALID_PDF", True), "sub.pdf": ("FILE_TOO_LARGE", True)}
    table = spark.createDataFrame([("a", b"%PDF-"), ("b", b""), ("c", None), ("d", b"PK")], "path string, content binary")
    assert [r["error"] for r in A.validated(table).orderBy("path").collect()] == [None, "EMPTY_FILE", "EMPTY_FILE", "INVALID_PDF"]


def test_tables_are_exported(spark, tmp_path):
    tables = spark.createDataFrame([(1, 1, 0, [["No", "", "No"], ["1", 'a "b"', "x,y"]], [0]), (1, 2, 0, [["p", "q"]], [])], "doc_id bigint, page int, table_idx int, rows array<array<string>>, header_rows array<int>")
    assert sorted((r["page"], r["row"], r["line"]) for r in X.table_lines(tables).collect()) == [(1, 0, "No,,No"), (1, 1, '1,"a ""b""","x,y"'), (2, 0, "p,q")]
    objects = {(r["page"], r["row"]): json.loads(r["json"]) for r in X.table_objects(tables).collect()}
    assert objects == {(1, 1): {"Column_2": 'a "b"', "No": "x,y"}, (2, 0): ["p", "q"]}
    assert X.table_text(tables).first()["text"] == 'No,,No\n1,"a ""b""","x,y"\n\n--- Table 2 (Page 2) ---\np,q'
    for form in ("csv", "tsv", "jsonl"):
        X.write_tables(tables, f"{tmp_path}/{form}", form)
    assert spark.read.text(f"{tmp_path}/jsonl").count() == 2
    grid = X.typed_grid(L.table_cells(spark.createDataFrame([(1, 1, 0, [["1,234.5 kg", "abc", " "], ["-7", "9", "x" * 60]], [])], tables.schema)))
    assert sorted((r["row"], r["col"], r["kind"], r["number"]) for r in grid.collect()) == [(0, 0, "number", 1234.5), (0, 1, "text", None), (0, 2, "empty", None), (1, 0, "number", -7.0), (1, 1, "number", 9.0), (1, 2, "text", None)]
    assert sorted((r["col"], r["width"]) for r in X.column_widths(grid).collect()) == [(0, 10), (1, 10), (2, 50)]


def test_widths_of_tables_are_told_without_a_shuffle(spark):
    kinds = "doc_id bigint, page int, table_idx int, rows array<array<string>>, header_rows array<int>"
    cells = ["1,234.5 kg", "abc", " ", "-.123456", "1e20", "1e-3x", "Ee", "1234567", ".99999", "+5.", "12345678", "x" * 9, "y" * 60, None, "", "-1,5e9,x", "9e9 e", "1e400", "00000.10"]
    some = [(k, 1, 0, [[c, "a"], ["7", c], [cells[k - 1], "b", "c" * k]], []) for k, c in enumerate(cells)] + [(90, 1, 0, [], []), (91, 1, 0, [[], ["abcdefghijk"]], [])]
    tables = spark.createDataFrame(some, kinds)
    found, known = X.table_widths(tables), X.column_widths(X.typed_grid(L.table_cells(tables)))
    assert found.schema.simpleString() == known.schema.simpleString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, known.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_library_round_trip(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id bigint, name string")
    X.export_library({"documents": spark.createDataFrame([(2, "new"), (3, "c")], old.schema)}, str(tmp_path))
    back = X.import_library(spark, str(tmp_path), {"documents": old.schema}, {"documents": old}, merge=True)["documents"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(1, "a"), (None, "n"), (2, "new"), (3, "c")], key=str)
    assert sorted(map(tuple, X.import_library(spark, str(tmp_path), {"documents": old.schema})["documents"].collect())) == [(2, "new"), (3, "c")]
    spark.createDataFrame([(1,)], "version int").write.mode("overwrite").json(f"{tmp_path}/archive_version")
    with pytest.raises(ValueError):
        X.import_library(spark, str(tmp_path), {"documents": old.schema})


def test_prompts(spark):
    queries = spark.createDataFrame([(1, "Why?"), (2, "Who?")], "query_id bigint, question string")
    hits = spark.createDataFrame([(1, 2, 7, "second"), (1, 1, 3, "first"), (1, 3, 9, "x" * 100)], "query_id bigint, rank int, page int, content string")
    found = {r["query_id"]: r for r in R.build_prompts(queries, hits, 50, instructions="Be kind.").collect()}
    assert found[1]["prompt"] == "\n".join(["Be kind.", *R.PROMPT_CONTEXT, "[Page 3] first\n", "[Page 7] second\n", "\n## Question\n", "Why?", *R.PROMPT_RULES])
    assert found[2]["prompt"].startswith("Be kind.\nNo relevant context") and not found[2]["has_context"]
    assert found[1]["tokens"] == -(-len(found[1]["prompt"]) // 4)


def test_chunks_by_the_rule():
    """The stated rule, sentence by sentence, against bounds from lengths."""
    import re

    def plain(text, size, overlap):
        clean = " ".join(text.split())
        if not clean:
            return []
        if len(clean) <= size:
            return [clean]
        out, held = [], ""
        for sentence in re.findall(r"[^.!?]+[.!?]+|[^.!?]+$", clean) or [clean]:
            s = sentence.strip()
            if len(held) + len(s) + 1 <= size:
                held = f"{held} {s}" if held else s
            elif held:
                out.append(held)
                held = (held[-overlap:] if overlap else "") + " " + s
            else:
                for w in s.split(" "):
                    if len(held) + len(w) + 1 <= size:
                        held = f"{held} {w}" if held else w
                    else:
                        out += [held] * bool(held)
                        held = w
        return [*out, held.strip()] if held.strip() else out

    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(["a", "bc", " ", ".", "word", "! ", "? ", "long" * 9]) for _ in range(r.randint(0, 90)))
        size, overlap = r.randint(5, 60), r.choice([0, 3, 8])
        assert [c for c, _, _ in R.split_chunks(text, size, overlap)] == plain(text, size, overlap)


def test_queries_are_read_as_java_reads_them(spark):
    pages = spark.createDataFrame([(1, 1, "ab (?P<a>x) ab"), (1, 2, None), (1, 3, "")], "doc_id bigint, page int, text string")
    assert [r["start"] for r in S.search_text(pages, "(?P<a>x)", regex=True).collect()] == [3]
    assert [r["start"] for r in S.search_text(pages, "ab", around=2).orderBy("start").collect()] == [0, 12]
    with pytest.raises(ValueError):
        S.query_pattern("x*", regex=True)


def test_folders_may_be_a_ring(spark):
    folders = spark.createDataFrame([(1, None), (2, 1), (3, 2), (10, 11), (11, 10), (20, 99)], "id bigint, parent_id bigint")
    found = {tuple(r) for r in J.folder_tree(folders).collect()}
    assert found == {(i, i, 0) for i in (1, 2, 3, 10, 11, 20)} | {(1, 2, 1), (2, 3, 1), (1, 3, 2), (10, 11, 1), (11, 10, 1)}


@pytest.mark.parametrize(("ms", "text"), [(-1, "Invalid duration"), (850, "850ms"), (2500, "2.5s"), (90_000, "1m 30s"), (120_000, "2m"), (7_500_000, "2h 5m"), (7_200_000, "2h")])
def test_durations(spark, ms, text):
    assert spark.range(1).select(J.duration(F.lit(ms).cast("bigint"))).first()[0] == text


def test_numbers_run_over_zones(spark):
    r = random.Random(6)
    ids = r.sample(range(10**12), 400)
    pages = [(d, p) for d in ids for p in range(1, r.randint(2, 5))]
    found = {(x["doc_id"], x["page"]): x["bates"] for x in I.bates_numbers(spark.createDataFrame(pages, "doc_id bigint, page int"), per_zone=30, digits=3).collect()}
    assert found == {k: f"{n:03d}" for n, k in enumerate(sorted(pages), 1)}


def test_redactions_are_checked(spark):
    boxes = [(1, 1, 1, 10.0, 10.0, 5.0, 5.0, "text", False), (1, 2, 0, 1.0, 1.0, 1.0, 1.0, "area", False), (1, 3, 1, 1.0, float("nan"), 1.0, 1.0, "area", None), (1, 4, 9, 1.0, 1.0, 1.0, 1.0, "area", False), (1, 5, 1, 900.0, 1.0, 1.0, 1.0, "area", False), (1, 6, 1, 1.0, 1.0, 1.0, 1.0, "area", True)]
    table = spark.createDataFrame(boxes, "doc_id bigint, id bigint, page int, x double, y double, width double, height double, kind string, applied boolean")
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0)], "doc_id bigint, page int, page_width double, page_height double")
    found = {r["id"]: (r["error"], r["left"], r["right"]) for r in G.redaction_plan(table, pages, 72).collect()}
    assert found == {1: (None, 8, 17), 2: ("BAD_PAGE", None, None), 3: ("BAD_BOX", None, None), 4: ("PAGE_OUT_OF_RANGE", None, None), 5: ("OFF_PAGE", None, None)}
