"""Retrieval, search, comparison, manifests and records on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from quire.operators import compare as C
from quire.operators import library as J
from quire.operators import manifest as I
from quire.operators import retrieval as R
from quire.operators import search as S
from quire.operators import texts as B
from quire.plans import registry


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, []),
        ("  \n ", []),
        ("short  text", [("short text", 0, 10)]),
        ("One two. Three four. Five.", [("One two.", 0, 8), ("wo. Three four.", 5, 20), ("ur. Five.", 17, 26)]),
        ("aaaa bbbb cccc dddd. e.", [("aaaa bbbb", 0, 0), ("cccc dddd.", 0, 20), ("dd. e.", 17, 23)]),
    ],
)
def test_chunks(text, expected):
    assert R.split_chunks(text, 12, 3) == expected


def test_context_overflow(spark):
    hits = [(1, 1, 1, "a" * 100), (1, 2, 2, "b" * 300), (1, 3, 3, "c"), (2, 1, 1, "d" * 500)]
    table = spark.createDataFrame(hits, "query_id bigint, rank int, page int, content string")
    found = {r["query_id"]: r["context"] for r in R.build_context(table, 250).collect()}
    first = "[Page 1]: " + "a" * 100
    assert found[1] == first + "\n\n" + ("[Page 2]: " + "b" * 300)[: 250 - len(first) - 2] + "..."
    assert found[2] == ("[Page 1]: " + "d" * 500)[:250] + "..."
    assert {r["query_id"]: r["context"] for r in R.build_context(table, 212).collect()}[1] == first


def test_search_rules(spark):
    pages = spark.createDataFrame([(1, 1, "A.B a.b axb"), (1, 2, "a.b"), (2, 1, None)], "doc_id bigint, page int, text string")
    found = S.search_text(pages, "a.b").collect()
    assert sorted((r["page"], r["start"], r["match_index"]) for r in found) == [(1, 0, 0), (1, 4, 1), (2, 0, 2)]
    assert S.search_text(pages, "").count() == 0
    assert S.search_text(pages, "a.b", regex=True).count() == 4
    assert S.search_text(pages, "(a", regex=True).count() == 0
    with pytest.raises(ValueError):
        S.search_text(pages, "x*", regex=True)


def test_positional_diff(spark):
    left = C.lines_of_documents(spark.createDataFrame([(1, "a\nb\nc")], "doc_id bigint, text string"))
    right = C.lines_of_documents(spark.createDataFrame([(1, "a\nx\nb\nc")], "doc_id bigint, text string"))
    found = {r["line_no"]: r["change"] for r in C.line_diff(left, right).collect()}
    assert found == {0: "unchanged", 1: "modified", 2: "modified", 3: "added"}


@pytest.mark.parametrize(("a", "b", "expected"), [("abc", "abc", 100), ("", "", 100), ("", "a", 0), ("abcd", "abxd", 75)])
def test_string_similarity(spark, a, b, expected):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(C.string_similarity(F.col("a"), F.col("b"))).first()[0] == expected


def test_split_by_size_and_bookmark(spark):
    pages = spark.createDataFrame([(1, p, 700) for p in range(1, 6)], "doc_id bigint, page int, byte_size bigint")
    assert [r["part"] for r in I.split_by_size(pages, 2200).orderBy("page").collect()] == [1, 1, 1, 2, 2]
    marks = spark.createDataFrame([(1, 1), (1, 4), (1, 9)], "doc_id bigint, page int")
    assert [(r["start"], r["end"]) for r in I.split_by_bookmark(pages, marks).orderBy("part").collect()] == [(1, 3), (4, 5)]
    with pytest.raises(ValueError):
        I.split_by_size(pages, 100)


@pytest.mark.parametrize(("spec", "expected"), [("1-3, 5", [(1, 3), (5, 5)]), ("0", None), ("3-1", None), ("7", None), ("a", None), (" ", None)])
def test_page_ranges(spark, spec, expected):
    found = spark.createDataFrame([(spec,)], "s string").select(I.parse_page_ranges(F.col("s"), F.lit(6))).first()[0]
    assert (found and [(r["start"], r["end"]) for r in found]) == expected


def test_rate_limit_window_opens_at_first_request(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate((10_000, 10_100, 10_200, 11_000))], "client bigint, request_id bigint, at_ms bigint")
    assert [r["allowed"] for r in I.rate_limit(rows, 2, 1000).orderBy("request_id").collect()] == [True, True, False, True]


@pytest.mark.parametrize(("size", "text"), [(0, "0 Bytes"), (500, "500 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1024**2, "1 MB")])
def test_human_size(spark, size, text):
    assert spark.range(1).select(J.human_size(F.lit(size))).first()[0] == text


def test_folder_tree(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")
    assert {(r["id"], r["level"]) for r in J.folder_tree(rows).where("ancestor = 'a'").collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_html_to_text(spark):
    html = "<style>x</style><h1>T</h1><ul><li>a</li><li>b &amp;lt;</li></ul><p>c<br>d</p>"
    assert spark.range(1).select(B.html_to_text(F.lit(html))).first()[0] == "# T\n\n  - a\n  - b &lt;\nc\nd"


def test_every_query_has_a_twin_or_a_reason():
    assert set(registry.queries()) == set(registry.oracle_sql())
