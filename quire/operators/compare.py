"""Comparison of document versions, line by line in place.

Lines are tables (pair_id, page, line_no, text), line_no counted over the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of_documents(docs: DataFrame, per_page: int = 40) -> DataFrame:
    """pair_id, page, line_no, text of (doc_id, text): lines split at newlines, per_page to a page."""
    rows = docs.select(F.col("doc_id").alias("pair_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return rows.select("pair_id", (F.floor(F.col("line_no") / per_page) + 1).cast("int").alias("page"), "line_no", "text")


def line_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair_id, line_no, page, change (unchanged, modified, added, removed), before, after: line i against line i."""
    a = left.select("pair_id", "line_no", F.col("page").alias("p1"), F.col("text").alias("before"), F.lit(True).alias("in_left"))
    b = right.select("pair_id", "line_no", F.col("page").alias("p2"), F.col("text").alias("after"), F.lit(True).alias("in_right"))
    both = a.join(b, ["pair_id", "line_no"], "full_outer")
    change = F.when(F.col("in_left").isNull(), "added").when(F.col("in_right").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("modified")
    return both.select("pair_id", "line_no", F.coalesce("p1", "p2").alias("page"), change.alias("change"), "before", "after")


def _counts() -> list[Column]:
    kinds = ("unchanged", "modified", "added", "removed")
    return [F.count_if(F.col("change") == k).alias(k) for k in kinds]


def _similar() -> Column:
    return F.floor(100 * F.count_if(F.col("change") == "unchanged") / F.count(F.lit(1)) + 0.5).cast("int").alias("similarity")


def text_similarity(diff: DataFrame) -> DataFrame:
    """pair_id, counts of each change, similarity: the rounded percentage of unchanged lines."""
    return diff.groupBy("pair_id").agg(*_counts(), _similar())


def compare_pages(diff: DataFrame) -> DataFrame:
    """pair_id, page, counts of each change, similarity of the page."""
    return diff.groupBy("pair_id", "page").agg(*_counts(), _similar())


def compare_documents(diff: DataFrame) -> DataFrame:
    """pair_id, pages, changed_pages, identical_pages, changes, mean_similarity (rounded mean over pages)."""
    pages = compare_pages(diff)
    changed = F.col("modified") + F.col("added") + F.col("removed")
    return pages.groupBy("pair_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(changed > 0).alias("changed_pages"), F.count_if(changed == 0).alias("identical_pages"), F.sum(changed).alias("changes"), F.floor(F.avg("similarity") + 0.5).cast("int").alias("mean_similarity"))


def page_comparison(pages_a: DataFrame, pages_b: DataFrame, diff: DataFrame, visual: DataFrame | None = None) -> DataFrame:
    """pair_id, page, presence (both, added, removed), same_size, differences, text_similarity, visual_similarity, similarity of every page of either side.

    pages_a and pages_b: pair_id, page, width, height; diff as `line_diff` gives it; visual: pair_id, page, score. A missing page and a size that
    differs by a point or more are a difference each, as is every changed line. Pages without lines are alike in text. Where there is a
    score the similarity is the rounded mean of both; unknown sizes count as equal.
    """
    side = lambda df, w: df.select("pair_id", "page", F.lit(True).alias(f"in_{w}"), F.col("width").alias(f"w_{w}"), F.col("height").alias(f"h_{w}"))
    rows = side(pages_a, "a").join(side(pages_b, "b"), ["pair_id", "page"], "full")
    rows = rows.join(compare_pages(diff), ["pair_id", "page"], "left")
    rows = rows.join(visual.select("pair_id", "page", "score"), ["pair_id", "page"], "left") if visual is not None else rows.withColumn("score", F.lit(None).cast("double"))
    same = F.coalesce((F.abs(F.col("w_a") - F.col("w_b")) < 1) & (F.abs(F.col("h_a") - F.col("h_b")) < 1), F.lit(True))
    presence = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("both")
    lines = F.coalesce(F.col("modified") + F.col("added") + F.col("removed"), F.lit(0))
    text = F.coalesce("similarity", F.lit(100)).cast("int")
    both = F.floor((text + F.col("score")) / 2 + 0.5).cast("int")
    return rows.select("pair_id", "page", presence.alias("presence"), same.alias("same_size"), (lines + (presence != "both").cast("int") + (~same).cast("int")).alias("differences"), text.alias("text_similarity"), F.col("score").alias("visual_similarity"), F.coalesce(both, text).alias("similarity"))


def comparison_summary(pages: DataFrame, diff: DataFrame) -> DataFrame:
    """pair_id, pages_a, pages_b, changed_pages, identical_pages, changes, additions, deletions, modifications, similarity, visual_similarity (null without scores) of pages as `page_comparison` gives them."""
    mean = lambda c: F.floor(F.avg(c) + 0.5).cast("int")
    by_pair = pages.groupBy("pair_id").agg(F.count_if(F.col("presence") != "added").alias("pages_a"), F.count_if(F.col("presence") != "removed").alias("pages_b"), F.count_if(F.col("differences") > 0).alias("changed_pages"), F.count_if(F.col("differences") == 0).alias("identical_pages"), mean("similarity").alias("similarity"), mean("visual_similarity").alias("visual_similarity"))
    kinds = diff.groupBy("pair_id").agg(*_counts())
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = by_pair.join(kinds, "pair_id", "left")
    return rows.select("pair_id", "pages_a", "pages_b", "changed_pages", "identical_pages", (zero("added") + zero("removed") + zero("modified")).alias("changes"), zero("added").alias("additions"), zero("removed").alias("deletions"), zero("modified").alias("modifications"), "similarity", "visual_similarity")


def compare_page_pairs(choices: DataFrame, lines_a: DataFrame, lines_b: DataFrame, sizes_a: DataFrame, sizes_b: DataFrame) -> DataFrame:
    """pair_id, page_a, page_b, differences, text_similarity, same_size, similarity of chosen pages (pair_id, page_a, page_b), one against another.

    lines: pair_id, page, line_no, text, compared in their order on the page; sizes: pair_id, page, width, height. Where sizes differ by a point or more the similarity
    is halved. Pages without lines are alike in text; a chosen page without a size counts as missing, and its choice is left out.
    """
    n = F.row_number().over(Window.partitionBy("pair_id", "page").orderBy("line_no")) - 1
    placed = lambda lines, w: lines.select("pair_id", F.col("page").alias(f"page_{w}"), n.alias("line_no"), "text")
    keyed = choices.select("pair_id", "page_a", "page_b").distinct().withColumn("choice", F.concat_ws("/", "pair_id", "page_a", "page_b"))
    of = lambda lines, w: placed(lines, w).join(keyed, ["pair_id", f"page_{w}"]).select(F.col("choice").alias("pair_id"), F.lit(1).alias("page"), "line_no", "text")
    found = text_similarity(line_diff(of(lines_a, "a"), of(lines_b, "b"))).select(F.col("pair_id").alias("choice"), (F.col("modified") + F.col("added") + F.col("removed")).alias("changed"), F.col("similarity").alias("text"))
    size = lambda sizes, w: sizes.select("pair_id", F.col("page").alias(f"page_{w}"), F.col("width").alias(f"w_{w}"), F.col("height").alias(f"h_{w}"))
    rows = keyed.join(size(sizes_a, "a"), ["pair_id", "page_a"]).join(size(sizes_b, "b"), ["pair_id", "page_b"]).join(found, "choice", "left")
    same = F.coalesce((F.abs(F.col("w_a") - F.col("w_b")) < 1) & (F.abs(F.col("h_a") - F.col("h_b")) < 1), F.lit(True))
    text = F.coalesce("text", F.lit(100)).cast("int")
    return rows.select("pair_id", "page_a", "page_b", (F.coalesce("changed", F.lit(0)) + (~same).cast("int")).alias("differences"), text.alias("text_similarity"), same.alias("same_size"), F.when(same, text).otherwise(F.floor(text * 0.5 + 0.5)).cast("int").alias("similarity"))


def identical_documents(docs: DataFrame) -> DataFrame:
    """file_hash, size, copies, first_id of byte-equal documents that occur more than once: one row a group."""
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("file_hash"), F.octet_length("text").alias("size"))
    return keyed.groupBy("file_hash", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def string_similarity(a: Column, b: Column) -> Column:
    """round(100 (1 - edit distance / longer length)): 100 for equal texts, 0 where one is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 100).when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.floor((1 - F.levenshtein(a, b) / longer) * 100 + 0.5)).cast("int")


def diff_report(diff: DataFrame) -> DataFrame:
    """pair_id, report: a summary line, then every changed line in order."""
    mark = F.when(F.col("change") == "added", "+ ").when(F.col("change") == "removed", "- ").otherwise("~ ")
    line = F.when(F.col("change") != "unchanged", F.struct(F.col("line_no").alias("n"), F.concat(mark, F.lit("line "), F.col("line_no") + 1, F.lit(": "), F.coalesce("after", "before")).alias("t")))
    out = diff.groupBy("pair_id").agg(*_counts(), F.array_sort(F.collect_list(line)).alias("changes"))
    head = F.concat_ws(" ", F.lit("unchanged"), "unchanged", F.lit("modified"), "modified", F.lit("added"), "added", F.lit("removed"), "removed")
    return out.select("pair_id", F.array_join(F.concat(F.array(head), F.transform("changes", lambda c: c["t"])), "\n").alias("report"))
