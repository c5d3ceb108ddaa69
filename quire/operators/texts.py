"""Page texts: assembly from positioned items, conversion, paragraphs, hashes.

Null texts stay null in columns and are left out of joined texts; empty ones stay empty; repeated rows and equal ids count each; empty
tables give no rows; columns not named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The replacements of each conversion, in the order in which they apply.
HTML_TO_TEXT = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?is)<h1[^>]*>(.*?)</h1>", "# $1\n\n"),
    (r"(?is)<h[2-6][^>]*>(.*?)</h[2-6]>", "## $1\n\n"),
    (r"(?is)<p[^>]*>(.*?)</p>", "$1\n\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(?:div|li)>", "\n"),
    (r"(?i)<li[^>]*>", "  - "),
    (r"<[^>]+>", ""),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    (r"\n\s*\n\s*\n", "\n\n"),
)
MARKDOWN_TO_HTML = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    (r"(?m)^### (.+)$", "<h3>$1</h3>"),
    (r"(?m)^## (.+)$", "<h2>$1</h2>"),
    (r"(?m)^# (.+)$", "<h1>$1</h1>"),
    (r"\*\*\*(.+?)\*\*\*", "<strong><em>$1</em></strong>"),
    (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"\*(.+?)\*", "<em>$1</em>"),
    (r"(?m)^\* (.+)$", "<li>$1</li>"),
    (r"(?m)^- (.+)$", "<li>$1</li>"),
    (r"(?m)^[0-9]+\. (.+)$", "<li>$1</li>"),
    (r"((?:<li>[^\n]+?</li>\n?)+)", "<ul>$1</ul>"),
    (r"\n\n+", "</p><p>"),
    (r"(?s)\A(.*)\z", "<p>$1</p>"),
    (r"<p>\s*</p>", ""),
    (r"<p>(<h[1-6]>)", "$1"),
    (r"(</h[1-6]>)</p>", "$1"),
    (r"<p>(<ul>)", "$1"),
    (r"(</ul>)</p>", "$1"),
    (r"\n", "<br>"),
)
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))
HTML_HEAD = ('<!DOCTYPE html>\n<html lang="en">\n<head>\n  <meta charset="UTF-8">\n  <title>', "</title>\n</head>\n<body>\n  <h1>", "</h1>\n")
OCR_LANGUAGES = ("eng", "spa", "fra", "deu", "ita", "por", "nld", "pol", "rus", "jpn", "chi_sim", "chi_tra", "kor", "ara", "hin")


def _chain(text: Column, steps) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)


def html_to_text(html: Column) -> Column:
    """Plain text with marked headings and bullets."""
    return F.regexp_replace(_chain(html, HTML_TO_TEXT), r"^\s+|\s+$", "")


def markdown_to_html(markdown: Column) -> Column:
    """Headings, emphasis, lists, paragraphs and line breaks as HTML; the rest is escaped."""
    return _chain(markdown, MARKDOWN_TO_HTML)


def escape_html(text: Column) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), ESCAPES, text)


def pages_to_html(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, html of (doc_id, page, text) and (doc_id, title): each page as "Page i of n" with its text as it stands; untitled documents are "Converted PDF"."""
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id")).cast("string")
    number = F.concat(F.lit("    <div class=\"page-number\">Page "), F.col("page").cast("string"), F.lit(" of "), total, F.lit("</div>\n"))
    block = F.concat(F.lit("  <div class=\"page\">\n"), number, F.lit("    <pre>"), escape_html(F.trim(F.coalesce("text", F.lit("")))), F.lit("</pre>\n  </div>"))
    body = pages.select("doc_id", "page", block.alias("block")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block"))), lambda b: b["block"]), "\n").alias("body"))
    rows = body.join(titles.groupBy("doc_id").agg(F.min("title").alias("title")), "doc_id", "left")
    title = escape_html(F.coalesce("title", F.lit("Converted PDF")))
    head = F.concat(F.lit(HTML_HEAD[0]), title, F.lit(HTML_HEAD[1]), title, F.lit(HTML_HEAD[2]))
    return rows.select("doc_id", F.concat(head, "body", F.lit("\n</body>\n</html>")).alias("html"))


def valid_ocr_language(code: Column) -> Column:
    """Whether a language code is one of the 15 that recognition knows; false for null."""
    return F.coalesce(code.isin(*OCR_LANGUAGES), F.lit(False))


def full_text(pages: DataFrame) -> DataFrame:
    """doc_id, text (pages in order, a blank line between, trimmed), characters."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
    return pages.groupBy("doc_id").agg(F.trim(joined).alias("text")).withColumn("characters", F.length("text"))


def assemble_page_text(items: DataFrame, mode: str = "lines") -> DataFrame:
    """doc_id, page, text of items (doc_id, page, item_idx, str, has_eol) in order.

    mode: "eol" adds a line break after items that end a line; "lines" a break there and else a space, without
    spaces before breaks; "flat" one space between all.
    """
    end = {"eol": F.when(F.col("has_eol"), "\n").otherwise(""), "lines": F.when(F.col("has_eol"), "\n").otherwise(" "), "flat": F.lit(" ")}[mode]
    parts = F.transform(F.array_sort(F.collect_list(F.struct("item_idx", F.concat("str", end).alias("s")))), lambda i: i["s"])
    text = F.array_join(parts, "")
    text = F.trim(F.regexp_replace(text, r"[ ]+\n", "\n")) if mode == "lines" else F.rtrim(text) if mode == "flat" else text
    return items.groupBy("doc_id", "page").agg(text.alias("text"))


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (0-based), text of the blocks between blank lines that hold text, lines right-trimmed."""
    rows = docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"\n\s*\n", -1), lambda b: F.length(F.trim(b)) > 0)).alias("paragraph", "text"))
    return rows.withColumn("text", F.regexp_replace("text", r"(?m)[ \t]+$", ""))


def ocr_fallback(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """doc_id, page, text, source: the extracted text if over 50 characters, else the recognised one."""
    rows = pages.join(ocr.select("doc_id", "page", F.col("text").alias("seen")), ["doc_id", "page"], "left")
    long = F.length(F.trim("text")) > 50
    return rows.select("doc_id", "page", F.when(long, F.col("text")).otherwise(F.coalesce("seen", "text")).alias("text"), F.when(long | F.col("seen").isNull(), "text").otherwise("ocr").alias("source"))


def content_hash(docs: DataFrame) -> DataFrame:
    """doc_id, sha256 and base64 of the text's bytes."""
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("base64"))


def text_table_rows(pages: DataFrame) -> DataFrame:
    """doc_id, page, row, cells: lines of two or more cells, split at tabs or two spaces; pages with two such lines."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.filter(F.split(F.trim(x), r"\t+| {2,}", -1), lambda c: F.length(F.trim(c)) > 0))
    rows = pages.select("doc_id", "page", F.filter(lines, lambda c: F.size(c) >= 2).alias("rows")).where(F.size("rows") >= 2)
    return rows.select("doc_id", "page", F.posexplode("rows").alias("row", "cells"))
