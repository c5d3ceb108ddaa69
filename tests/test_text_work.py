"""Text work: done once, by as many tasks as the pages need, and keywords counted by words."""

import random
import re

from pyspark.sql import functions as F

from quire.functions.spans import spelt
from quire.operators import classify as C
from quire.operators import entities as E
from quire.plans import more, views

SF = "/root/testdata/sf0.001"


def test_hits_are_found_once(spark):
    pages = views.biz_pages(spark, SF)
    for found in (E.extract_amounts(pages), E.extract_key_information(pages), C.keyword_matches(pages)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Generate "):]
        assert not [line for line in below.splitlines() if "Filter" in line], below[:2000]


def test_tasks_grow_with_the_pages(spark, monkeypatch):
    monkeypatch.setattr(views, "PAGES_A_TASK", 100)
    assert views.biz_pages(spark, SF).rdd.getNumPartitions() == 15
    assert "Repartition" in more._orders_stream(spark, SF)._jdf.queryExecution().analyzed().toString()


def test_keywords_by_words_are_keywords_by_pattern(spark):
    r = random.Random(7)
    listed = C._listed({"other": ("###", "Été")}) + [("other", "###"), ("other", "été")]
    words = [k for _, k in listed] + ["x", "_", ".", " ", "\n", "invoices", "#7", "cvs", "ſ", "É"]
    texts = ["".join(r.choice(words) + r.choice(["", " ", " ", ":", "-"]) for _ in range(40)).lower() for _ in range(60)]
    count = C.keyword_counter([k for _, k in listed])
    for t in texts:
        slow = [(i, n) for i, (_, k) in enumerate(listed) if (n := len(re.findall(C.keyword_pattern(k), t)))]
        assert count(t) == slow
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert C.keyword_matches(docs).count() == 0 and {tuple(a["p"]) for a in docs.select(C.keyword_points(docs["text"]).alias("p")).collect()} == {(0,) * 10}


def test_classes_are_spelt_out():
    assert spelt(r"[a-c0-9-]\[a-z]x[!-a-z]") == r"[a-c0123456789-]\[a-z]x[!-a-z]"
    assert spelt(r"(?i)[0-9-.]") == r"(?i)[0-9-.]"
    pattern = E.EMAIL
    assert re.findall(spelt(pattern), "a.B9@x-1.org, no@") == re.findall(pattern, "a.B9@x-1.org, no@") != []


def test_characters_are_counted_by_text(spark):
    r = random.Random(3)
    texts = ["", None, " ", "a", "A b", "\t\n", "é Ü9 \u2003x\x0b", None, *("".join(r.choice("aZ9 \né\u00a0.") for _ in range(r.randrange(9))) for _ in range(200)), " z", "q "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1).orderBy("doc_id").select("doc_id", C.class_counts(F.col("text")).alias("c"))
    found = {x["doc_id"]: x["c"] for x in rows.collect()}
    for i, t in enumerate(texts):
        wanted = None if t is None else tuple(len(re.findall(p, t, re.A)) for p in ("[A-Z]", "[a-z]", "[0-9]", r"\S+"))
        assert (found[i] if t is None else tuple(found[i])) == wanted, t
