"""Rows, tables, headings and forms against plain Python, with awkward rows."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import forms as B
from quire.operators import layout as L

ITEM = "doc_id bigint, page int, item_idx int, str string, x double, y double, width double, height double, font_size double, font_name string, has_eol boolean, row string"


def items(spark, rows):
    full = [(d, p, i, s, float(x) if x is not None else None, float(y) if y is not None else None, 20.0, 10.0, size, font, eol, "clash") for d, p, i, s, x, y, size, font, eol in rows]
    return spark.createDataFrame(full, ITEM)


def scattered():
    r = random.Random(2)
    rows = []
    for d in range(6):
        for i in range(40):
            rows.append((d, 1 + i % 2, i, r.choice(["a", "bb", "7", "x y"]), r.choice([50, 52, 149, 151, 250]), 700 - 9 * (i // 4) - r.random() * 6, 11.0, "Sans", r.random() < 0.2))
    return [*rows, (9, 1, 0, None, 1, 1, 1.0, "f", False), (9, 1, 1, "  ", 1, 1, 1.0, "f", False), (9, 1, 2, "alone", None, 5, 1.0, "f", False)]


def test_rows_are_anchored_at_their_first(spark):
    data = scattered()
    expected = collections.Counter()
    pages = collections.defaultdict(list)
    for d, p, i, s, x, y, *_ in data:
        if s and s.strip() and x is not None:
            pages[d, p].append((y, x, i, s))
    for key, held in pages.items():
        row, anchor = -1, None
        by_row = collections.defaultdict(list)
        for y, x, i, s in sorted(held, key=lambda t: -t[0]):
            if anchor is None or abs(y - anchor) > 5:
                row, anchor = row + 1, y
            by_row[row].append((x, -y, i, s))
        for row, cells in by_row.items():
            for place, (x, _, _, s) in enumerate(sorted(cells)):
                expected[(*key, row, place, s, float(x))] += 1
    found = L.group_rows(items(spark, data).repartition(3)).collect()
    assert collections.Counter((r["doc_id"], r["page"], r["row"], r["place"], r["str"], r["x"]) for r in found) == expected


def test_tolerance_is_measured_from_the_anchor(spark):
    rows = [(1, 1, i, str(i), 10 * i, y, 11.0, "f", False) for i, y in enumerate((100, 95, 90.5, 90, 84.99))]
    assert [r["row"] for r in sorted(L.group_rows(items(spark, rows)).collect(), key=lambda r: r["x"])] == [0, 0, 1, 1, 2]


def test_lines_end_at_marks_and_gaps_become_spaces(spark):
    rows = [(1, 1, 0, "He", 0, 100, 11.0, "f", False), (1, 1, 1, "llo", 21, 101, 11.0, "f", False), (1, 1, 2, "you", 60, 99, 11.0, "f", True), (1, 1, 3, "next", 90, 100, 11.0, "f", False)]
    assert sorted((r["line_no"], r["text"]) for r in L.items_to_lines(items(spark, rows)).collect()) == [(1, "Hello you"), (2, "next")]


def test_tables_of_one_page(spark):
    grid = [["No", "Item", "Price"], ["1", "pen", "2.50"], ["2", "", "3.00"]]
    rows = [(1, 1, 3 * a + b, s, 50 + 100 * b, 700 - 20 * a, 11.0, "f", False) for a, line in enumerate(grid) for b, s in enumerate(line)]
    table = L.extract_tables(items(spark, rows + [(2, 1, 0, "lonely", 1, 1, 1.0, "f", False)])).collect()
    assert len(table) == 1 and [list(r) for r in table[0]["rows"]] == grid and table[0]["header_rows"] == [0]
    assert math.isclose(table[0]["confidence"], 2 / 3 * 0.4 + 0.4 + 8 / 9 * 0.2)
    for operator in (L.extract_tables, L.items_to_lines, L.heading_blocks, L.group_rows):
        assert operator(items(spark, [])).count() == 0


def test_headings_and_their_parents(spark):
    lines = [("Big", 20.0, "Sans"), ("body text", 11.0, "Sans"), ("Mid one", 15.0, "Sans"), ("more body", 11.0, "Sans"), ("12", 15.0, "Sans"), ("Mid two", 15.0, "Sans"), ("bold line", 11.0, "Sans-Bold"), ("last body", 11.0, "Sans")]
    found = L.toc_hierarchy(L.extract_headings(L.heading_blocks(items(spark, [(1, 1, i, s, 50, 700 - 20 * i, size, font, True) for i, (s, size, font) in enumerate(lines)])))).collect()
    assert sorted((r["seq"], r["title"], r["level"], r["parent_seq"]) for r in found) == [(0, "Big", 1, None), (1, "Mid one", 2, 0), (2, "Mid two", 2, 0)]


def test_hierarchy_is_the_stack_one(spark):
    r = random.Random(7)
    levels = [r.randint(1, 6) for _ in range(60)]
    stack, expected = [], {}
    for seq, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        expected[seq] = stack[-1] if stack else None
        stack.append(seq)
    entries = spark.createDataFrame([(1, s, v) for s, v in enumerate(levels)], "doc_id bigint, seq int, level int")
    assert {x["seq"]: x["parent_seq"] for x in L.toc_hierarchy(entries).collect()} == expected


@pytest.mark.parametrize(("label", "kind", "sure"), [("Email Address:", "email", 95), ("Date of birth", "date", 95), ("x", "signature", 95), ("call 555-123-4567", "phone", 85), ("$12.5", "number", 75), ("whatever", "text", 50), ("Country:", "text", 95), ("Choose", "dropdown", 95)])
def test_field_types(spark, label, kind, sure):
    row = spark.createDataFrame([(label,)], "label string").select(B.suggest_field_type(F.col("label")).alias("t")).first()["t"]
    assert (row["type"], row["confidence"]) == (kind, sure)


def boxes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, page int, item_idx int, str string, x double, y double, width double, height double")


def test_overlap_of_more_than_half_drops_the_later_field(spark):
    pages = spark.createDataFrame([(1, 1, 612.0)], "doc_id bigint, page int, page_width double")
    rows = [(1, 1, 0, "_____", 100.0, 100.0, 100.0, 5.0), (1, 1, 1, "_____", 150.0, 100.0, 100.0, 5.0), (1, 1, 2, "_____", 149.0, 100.0, 100.0, 5.0), (1, 1, 3, "Name:", 20.0, 100.0, 40.0, 10.0), (1, 1, 4, None, 1.0, 1.0, 1.0, 1.0)]
    found = B.detect_form_fields(boxes(spark, rows), pages).collect()
    # Exactly half is kept; one point more is not; the label's own place overlaps the first line.
    assert sorted(r["x"] for r in found) == [100.0, 150.0] and {r["label"] for r in found} == {"Name", "Unlabeled field"}
    assert B.detect_form_fields(boxes(spark, []), pages).count() == 0


def test_names_are_unique_and_pass_over_used_ones(spark):
    names = ["name", "name_2", "name", "name", "x", "name"]
    fields = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)] + [(2, 0, "name")], "doc_id bigint, seq int, name string")
    found = {(r["doc_id"], r["seq"]): r["unique_name"] for r in B.unique_field_names(fields).collect()}
    assert found == {(1, 0): "name", (1, 1): "name_2", (1, 2): "name_3", (1, 3): "name_4", (1, 4): "x", (1, 5): "name_5", (2, 0): "name"}


def test_dense_page_by_cells(spark):
    """20,000 items on one page in seconds, and a small one against all pairs."""
    import random
    import time

    r = random.Random(1)
    item = lambda i, n: (1, 1, i, r.choice(["_____", "[ ]", "Name", "Date", "x1", "City:"]), r.uniform(0, n), r.uniform(0, n), r.uniform(5, 60), 10.0)
    schema = "doc_id int, page int, item_idx int, str string, x double, y double, width double, height double"
    small = [item(i, 500) for i in range(150)]
    places = B.field_candidates(spark.createDataFrame(small, schema), spark.createDataFrame([(1, 1, 600.0)], "doc_id int, page int, page_width double")).where("family < 2")
    found = {(x["family"], x["item_idx"]): x["label_text"] for x in B.nearby_labels(places, spark.createDataFrame(small, schema)).collect()}
    labels = [x for x in small if len(x[3]) > 1 and x[3] != "_____"]
    for p in places.collect():
        near = []
        for _, _, i, s, x, y, w, h in labels:
            apart = ((x + w / 2 - p["x"] - p["width"] / 2) ** 2 + (y + h / 2 - p["y"] - p["height"] / 2) ** 2) ** 0.5
            left = x + w < p["x"] and y < p["y"] + p["height"] and y + h > p["y"]
            if apart < 150 and (left or y > p["y"] + p["height"] and abs(x - p["x"]) < p["width"]):
                near.append((x + w >= p["x"], i, s))
        assert found[p["family"], p["item_idx"]] == (min(near)[2] if near else None)
    dense = spark.createDataFrame([item(i, 3000) for i in range(20_000)], schema)
    began = time.time()
    fields = B.detect_form_fields(dense, spark.createDataFrame([(1, 1, 3000.0)], "doc_id int, page int, page_width double")).collect()
    assert len(fields) > 1000 and time.time() - began < 60
    boxes_ = [(f["x"], f["y"], f["width"], f["height"]) for f in fields if f["type"] == "checkbox"][:300]
    for i, (x, y, w, h) in enumerate(boxes_):
        for a, b, c, d in boxes_[:i]:
            wide, high = min(x + w, a + c) - max(x, a), min(y + h, b + d) - max(y, b)
            assert not (wide > 0 and high > 0 and wide * high > 0.5 * min(w * h, c * d))


def test_grids_are_those_of_the_steps_in_one_shuffle(spark):
    r = random.Random(4)
    data = scattered() + [(20 + d, 1, r.choice([i, i, None]), r.choice(["a", "b", "é"]), r.choice([50, 54.9, 55, 95, 100, 100, float("nan")]), r.choice([700, 698, 694.5, 690, 600, 595, 594.9]), 11.0, "f", False) for d in range(8) for i in range(30)]
    table = items(spark, data).repartition(3).cache()
    rows = L.group_rows(table)
    wanted = sorted((x["doc_id"], x["page"], x["row"], list(x["cells"])) for x in L.assign_cells(rows, L.detect_columns(rows)).collect())
    grids = L.page_grids(table)
    assert sorted((x["doc_id"], x["page"], x["row"], list(x["cells"])) for x in L.page_cells(grids).collect()) == wanted and len(wanted) > 50
    box = {(x["doc_id"], x["page"]): repr([x["a"], x["b"], x["c"], x["d"]]) for x in rows.groupBy("doc_id", "page").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max(F.col("x") + F.col("width")).alias("c"), F.max(F.col("y") + F.col("height")).alias("d")).collect()}
    assert all(repr([x["x"], x["y"], x["right"], x["top"]]) == box[x["doc_id"], x["page"]] for x in grids.collect())
    assert L.extract_tables(items(spark, data))._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
