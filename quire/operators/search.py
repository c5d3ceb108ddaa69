"""Search and replace in page texts (doc_id, page, text).

Null and empty texts have no matches, and null ones stay null where texts are replaced; repeated rows are searched each; empty tables give no
rows; columns not named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.functions.spans import BOUND, find_all, let

PIECE = 1024


def _matches_nothing(pattern: str) -> bool | None:
    """Whether a pattern, as the executors' Java reads it, matches the empty text; null for an invalid one. Without a session Python's reading must do."""
    context = SparkContext._active_spark_context
    if context is None:
        try:
            return re.compile(pattern).match("") is not None
        except re.error:
            return None
    try:
        return context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").lookingAt()
    except (Py4JError, IllegalArgumentException):
        return None


def query_pattern(query: str, case_sensitive: bool = False, whole_word: bool = False, regex: bool = False) -> str | None:
    """The pattern a query stands for; an invalid expression is taken literally; null for an empty query.

    Patterns that match the empty text have no spans and are refused.
    """
    if not query:
        return None
    body = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", query)
    if regex and (empty := _matches_nothing(query)) is not None:
        if empty:
            raise ValueError("the pattern matches the empty text")
        body = query
    body = f"{BOUND}(?:{body}){BOUND}" if whole_word else body
    return body if case_sensitive else f"(?i){body}"


def _contexts(text: Column, pattern: str, around: int) -> Column:
    """start, text and context of every match, as an array.

    Contexts are cut out of pieces of the text, as reaching into a long text takes as long as what stands before.
    """
    length = F.length(text)

    def context(m: Column, pieces: Column) -> Column:
        start = F.greatest(F.lit(0), m["start"] - around)
        stop = m["start"] + F.length(m["text"]) + around
        k = (start / PIECE).cast("int")
        near = F.substring(F.concat(F.get(pieces, k), F.coalesce(F.get(pieces, k + 1), F.lit(""))), start - k * PIECE + 1, stop - start)
        body = F.when(stop - start <= PIECE, near).otherwise(F.substring(text, start + 1, stop - start))
        return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(stop < length, "...").otherwise(""))

    def made(pieces: Column) -> Column:
        return F.transform(find_all(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text"), context(m, pieces).alias("context")))

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), made)


def search_text(pages: DataFrame, query: str, around: int = 30, max_results: int | None = None, **options) -> DataFrame:
    """doc_id, page, start, text, context, match_index (0-based in the document, by page and place)."""
    pattern = query_pattern(query, **options)
    if pattern is None:
        return pages.limit(0).select("doc_id", "page", F.lit(0).alias("start"), "text", F.col("text").alias("context"), F.lit(0).alias("match_index"))
    # Pages without a match are left out before texts are cut in pieces.
    found = pages.where(F.col("text").rlike(pattern)).select("doc_id", "page", F.inline(_contexts(F.col("text"), pattern, around)))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "start")) - 1
    found = found.withColumn("match_index", index)
    return found if max_results is None else found.where(F.col("match_index") < max_results)


def match_rects(matches: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, page, start, text, x, y, width, height: the box of all items whose characters a match shares; matches with none are dropped.

    matches (doc_id, page, start, text) of page texts that items (doc_id, page, item_idx, str, x, y, width, height, has_eol) make up in order with a break after
    each item that ends a line. An interval join by a sweep: matches and items of a page come in order of their
    places, and only the last item and the matches not yet closed are held, so the work grows with their number and overlaps,
    not with their product. Matches may overlap each other. Null texts have no characters, and items without a whole box cover nothing.
    """
    n = F.coalesce(F.length("str"), F.lit(0))
    before = Window.partitionBy("doc_id", "page").orderBy("item_idx").rowsBetween(Window.unboundedPreceding, -1)
    box = ["x", "y", "width", "height"]
    placed = items.select("doc_id", "page", F.coalesce(F.sum(n + F.coalesce(F.col("has_eol"), F.lit(False)).cast("int")).over(before), F.lit(0)).cast("bigint").alias("at"), F.lit(0).alias("kind"), n.cast("bigint").alias("n"), *[F.col(c).cast("double").alias(c) for c in box], F.lit(None).cast("string").alias("text"))
    placed = placed.where(" and ".join(f"{c} is not null" for c in box))
    asked = matches.select("doc_id", "page", F.col("start").cast("bigint").alias("at"), F.lit(1).alias("kind"), F.length("text").cast("bigint").alias("n"), *[F.lit(None).cast("double").alias(c) for c in box], "text").where("n > 0")
    # Dealt by a hash of the page: a union of sides that are dealt by page already would be taken as dealt, though their partitions may have been coalesced apart.
    rows = placed.unionByName(asked).repartition(F.xxhash64("doc_id", "page")).sortWithinPartitions("doc_id", "page", "at", "kind")
    kinds = {f.name: f.dataType for f in matches.schema.fields}
    out = StructType([StructField(c, kinds[c]) for c in ("doc_id", "page", "start", "text")] + [StructField(c, DoubleType()) for c in box])
    return rows.mapInArrow(lambda batches: _swept(batches, to_arrow_schema(out)), out)


def _swept(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Boxes of matches (kind 1) over items (kind 0) in order of page, place and kind."""
    page, item, still = None, None, []

    def close(at: float) -> list[tuple]:
        """Takes out the matches that end at or before a place, as rows."""
        nonlocal still
        done = [m for m in still if m[0] <= at]
        if done:
            still = [m for m in still if m[0] > at]
        return [(*page, start, text, x, y, right - x, height) for _, start, text, x, y, right, height in done if x is not None]

    def cover(m: list, box: tuple) -> None:
        x, y, width, height = box
        m[3:] = (x, y, x + width, height) if m[3] is None else (min(m[3], x), min(m[4], y), max(m[5], x + width), max(m[6], height))

    for batch in batches:
        found: list[tuple] = []
        for doc, number, at, kind, n, x, y, width, height, text in zip(*[c.to_pylist() for c in batch.columns]):
            if (doc, number) != page:
                found += close(float("inf"))
                page, item, still = (doc, number), None, []
            if still:
                found += close(at)
            if kind:
                m = [at + n, at, text, None, None, None, None]
                if item and item[0] > at:
                    cover(m, item[1])
                still.append(m)
            else:
                # An item without characters strictly inside a match counts, at its start it does not.
                for m in still:
                    if at + n > m[1]:
                        cover(m, (x, y, width, height))
                if n:
                    item = at + n, (x, y, width, height)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
    if found := close(float("inf")):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def count_matches(pages: DataFrame, query: str, **options) -> DataFrame:
    """doc_id, page, matches: of a document as a whole where page is null."""
    n = F.regexp_count("text", F.lit(query_pattern(query, **options)))
    return pages.select("doc_id", "page", n.alias("n")).rollup("doc_id", "page").agg(F.sum("n").alias("matches"), F.grouping("doc_id").alias("whole")).where("whole = 0 and matches > 0").select("doc_id", "page", "matches")


def replace_text(pages: DataFrame, query: str, replacement: str, occurrence: int | None = None, **options) -> DataFrame:
    """doc_id, page, replaced, replacements: all matches of a page, or its occurrence-th alone (1-based)."""
    pattern = query_pattern(query, **options)
    text = F.col("text")
    plain = replacement.replace("\\", "\\\\").replace("$", "\\$")
    if occurrence is None:
        return pages.select("doc_id", "page", F.regexp_replace("text", pattern, plain).alias("replaced"), F.regexp_count("text", F.lit(pattern)).alias("replacements"))
    rows = pages.select("doc_id", "page", "text", F.get(find_all(text, pattern), F.lit(occurrence - 1)).alias("m"))
    spliced = F.concat(F.substring(text, F.lit(1), F.col("m.start")), F.lit(replacement), F.substring(text, F.col("m.start") + F.length("m.text") + 1, F.length(text)))
    return rows.select("doc_id", "page", F.when(F.col("m").isNull(), text).otherwise(spliced).alias("replaced"), F.col("m").isNotNull().cast("int").alias("replacements"))


def preview_replacements(pages: DataFrame, query: str, replacement: str, **options) -> DataFrame:
    """The matches with their context as it will be."""
    plain = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return search_text(pages, query, **options).withColumn("preview", F.regexp_replace("context", query_pattern(query, **{k: v for k, v in options.items() if k not in ("around", "max_results")}), plain))


def search_library(docs: DataFrame, query: str, *columns: str, tags: str | None = None) -> DataFrame:
    """Documents one of whose columns, or tags, holds the query, whatever its case."""
    q = query.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    if tags:
        hit = hit | F.coalesce(F.exists(tags, lambda t: F.lower(t).contains(q)), F.lit(False))
    return docs.where(hit)
