"""Exports: entities, tables, classes, history and whole libraries, as text columns and as folders of part files.

Writers go through Spark's writers, one folder for each kind or table; nothing passes the driver. Null values become empty
CSV fields. Empty tables write folders without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.shared import shared_folder
from quire.functions.spans import first_of_each, inlined
from quire.operators import entities as E

# CSV headers by entity kind, as (header, column of the extractor), and the archive's version.
CSV_COLUMNS = {
    "date": (("Value", "text"), ("Format", "format"), ("Parsed Date", "parsed"), ("Confidence", "confidence"), ("Page", "page")),
    "amount": (("Original", "text"), ("Value", "value"), ("Currency", "currency"), ("Confidence", "confidence"), ("Page", "page")),
    "email": (("Email", "text"), ("Domain", "domain"), ("Confidence", "confidence"), ("Page", "page")),
    "phone": (("Phone", "text"), ("Normalized", "digits"), ("Format", "format"), ("Confidence", "confidence"), ("Page", "page")),
    "name": (("Full Name", "text"), ("First Name", "first"), ("Last Name", "last"), ("Confidence", "confidence"), ("Page", "page")),
    "url": (("URL", "text"), ("Domain", "domain"), ("Secure", "secure"), ("Confidence", "confidence"), ("Page", "page")),
    "id": (("ID Type", "id_type"), ("Value", "text"), ("Valid", "valid"), ("Confidence", "confidence"), ("Page", "page")),
    "address": (("Full Address", "text"), ("City", "city"), ("State", "state"), ("ZIP", "zip"), ("Confidence", "confidence"), ("Page", "page")),
}
TITLES = {"date": "Date", "amount": "Amount", "email": "Email", "phone": "Phone", "name": "Name", "url": "URL", "id": "ID", "address": "Address"}
ARCHIVE_VERSION = 2


def csv_field(value: Column, delimiter: str = ",") -> Column:
    """The value, in quotes with its quotes doubled if it holds the delimiter, a quote or a line break; empty for null."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    odd = text.contains(delimiter) | text.contains('"') | text.contains("\n")
    return F.when(odd, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def entity_rows(pages: DataFrame, kinds: tuple[str, ...] = tuple(CSV_COLUMNS)) -> DataFrame:
    """doc_id, kind, fields (the export columns of the kind, in order, as strings) of every entity, in one pass over the pages; true and false become Yes and No."""
    found = pages.select("doc_id", "page", *[E.KINDS[k][0](F.col("text")).alias(k) for k in kinds])

    def of_kind(kind: str) -> Column:
        key = E.KINDS[kind][2]
        plain = lambda h, c: F.when(h[c], "Yes").otherwise("No") if c in ("secure", "valid") else (F.col("page") if c == "page" else h[c]).cast("string")
        row = lambda h: F.struct(F.lit(kind).alias("kind"), F.array(*[plain(h, c) for _, c in CSV_COLUMNS[kind]]).alias("fields"))
        return F.transform(first_of_each(F.col(kind), key) if key else F.col(kind), row)

    return inlined(found, ["doc_id"], F.concat(*map(of_kind, kinds)), "kind")


def entity_csv_lines(pages: DataFrame, kinds: tuple[str, ...] = tuple(CSV_COLUMNS)) -> DataFrame:
    """doc_id, kind, line: the CSV line of every entity."""
    titles = F.create_map(*[F.lit(x) for k in kinds for x in (k, TITLES[k])])
    return entity_rows(pages, kinds).select("doc_id", "kind", F.concat_ws(",", F.try_element_at(titles, F.col("kind")), F.transform("fields", lambda x: csv_field(x))).alias("line"))


def write_entities(pages: DataFrame, path: str, form: str = "csv", kinds: tuple[str, ...] = tuple(CSV_COLUMNS)) -> None:
    """One folder for each kind below path: CSV with headers, or JSON lines.

    The pages are read once: what is found goes to the shared folder by kind, and each kind's folder is written from its own part.
    """
    aside = shared_folder(pages.sparkSession, "entities")
    rows = entity_rows(pages, kinds)
    rows.write.partitionBy("kind").parquet(aside)
    held = pages.sparkSession.read.schema(rows.schema).parquet(aside)
    for kind in kinds:
        fields = [F.get("fields", F.lit(i)).alias(h) for i, (h, _) in enumerate(CSV_COLUMNS[kind])]
        writer = held.where(F.col("kind") == kind).select("doc_id", F.lit(TITLES[kind]).alias("Type"), *fields).write.mode("overwrite")
        if form == "csv":
            writer.option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/{kind}")
        else:
            writer.json(f"{path}/{kind}")


def table_lines(tables: DataFrame, delimiter: str = ",", headers: bool = True) -> DataFrame:
    """doc_id, page, table_idx, row, line: the delimited line of each table row; without headers as many first rows are left out as there are headers."""
    rows = tables.select("doc_id", "page", "table_idx", "header_rows", F.posexplode("rows").alias("row", "cells"))
    rows = rows if headers else rows.where(F.col("row") >= F.size("header_rows"))
    return rows.select("doc_id", "page", "table_idx", "row", F.array_join(F.transform("cells", lambda c: csv_field(c, delimiter)), delimiter).alias("line"))


def table_text(tables: DataFrame, delimiter: str = ",") -> DataFrame:
    """doc_id, text: a document's tables as one text, a marked line before each but the first."""
    body = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: csv_field(c, delimiter)), delimiter)), "\n")
    one = tables.select("doc_id", "page", "table_idx", body.alias("body"))
    listed = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "table_idx", "body"))).alias("t"))
    mark = lambda t, i: F.when(i == 0, t["body"]).otherwise(F.concat(F.lit("\n--- Table "), (i + 1).cast("string"), F.lit(" (Page "), t["page"].cast("string"), F.lit(") ---\n"), t["body"]))
    return listed.select("doc_id", F.array_join(F.transform("t", mark), "\n").alias("text"))


def table_objects(tables: DataFrame) -> DataFrame:
    """doc_id, page, table_idx, row, json: each row after the header as an object of header to cell (blank headers Column_i, of equal ones the last cell); rows of tables without one as arrays."""
    rows = tables.select("doc_id", "page", "table_idx", "header_rows", "rows", F.posexplode("rows").alias("row", "cells"))
    has = (F.size("header_rows") > 0) & (F.size("rows") > 1)
    names = F.transform(F.get("rows", F.get("header_rows", F.lit(0))), lambda h, i: F.coalesce(F.nullif(F.trim(h), F.lit("")), F.concat(F.lit("Column_"), (i + 1).cast("string"))))
    pairs = F.transform(names, lambda h, i: F.struct(h.alias("h"), F.coalesce(F.get("cells", i), F.lit("")).alias("v"), i.alias("i")))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["h"] == p["h"]) & (q["i"] > p["i"])))
    made = F.map_from_arrays(F.transform(last, lambda p: p["h"]), F.transform(last, lambda p: p["v"]))
    return rows.where(~has | (F.col("row") > F.array_max("header_rows"))).select("doc_id", "page", "table_idx", "row", F.when(has, F.to_json(made)).otherwise(F.to_json("cells")).alias("json"))


def write_tables(tables: DataFrame, path: str, form: str = "csv") -> None:
    """Tables below path as csv or tsv, those of a document together, or as JSON lines."""
    if form in ("csv", "tsv"):
        table_text(tables, "\t" if form == "tsv" else ",").select("text").write.mode("overwrite").text(path)
    elif form in ("json", "jsonl"):
        table_objects(tables).select(F.col("json").alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"can't write {form}")


def _number(text: Column) -> Column:
    """The number that a trimmed text begins with, commas left out; null where there is none or it is not finite."""
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def _written(number: Column) -> Column:
    """The number as text; a whole one without its fraction."""
    return F.regexp_replace(number.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def typed_grid(cells: DataFrame) -> DataFrame:
    """doc_id, page, table_idx, sheet, row, col, kind (empty, number, text), number, text of cells (doc_id, page, table_idx, row, col, value).

    A cell that begins with a number, commas left out, is that number.
    """
    text = F.trim("value")
    number = _number(text)
    kind = F.when(F.length(text) == 0, "empty").when(number.isNotNull(), "number").otherwise("text")
    sheet = F.concat(F.lit("Table_Page"), F.col("page").cast("string"), F.lit("_"), (F.col("table_idx") + 1).cast("string"))
    return cells.select("doc_id", "page", "table_idx", sheet.alias("sheet"), "row", "col", kind.alias("kind"), number.alias("number"), F.when(kind == "text", text).alias("text"))


def column_widths(grid: DataFrame) -> DataFrame:
    """doc_id, page, table_idx, col, width: the longest cell and 2 more, from 10 to 50."""
    shown = F.when(F.col("kind") == "number", _written(F.col("number"))).otherwise(F.coalesce("text", F.lit("")))
    longest = F.max(F.length(shown))
    return grid.groupBy("doc_id", "page", "table_idx", "col").agg(F.greatest(F.lit(10), F.least(F.lit(50), longest + 2)).alias("width"))


def table_widths(tables: DataFrame) -> DataFrame:
    """doc_id, page, table_idx, col, width: column_widths of the typed cells of tables, told within each table's row: no cell is a row of its own and nothing is shuffled."""

    def shown(cell: Column) -> Column:
        text = F.trim(cell)
        number = _number(text)
        # Of 7 characters at most none takes more than 8 as a number, unless it has an exponent: the least width is for 8.
        short = (F.length(text) <= 7) & ~F.lower(text).contains("e")
        return F.when(short, F.length(text)).when(number.isNotNull(), F.length(_written(number))).otherwise(F.coalesce(F.length(text), F.lit(0)))

    columns = F.array_max(F.transform("rows", lambda r: F.size(r)))
    longest = lambda i: F.array_max(F.transform(F.filter("rows", lambda r: F.size(r) > i), lambda r: shown(F.get(r, i))))
    widths = F.transform(F.sequence(F.lit(0), columns - 1), lambda i: F.greatest(F.lit(10), F.least(F.lit(50), longest(i) + 2)))
    return tables.select("doc_id", "page", "table_idx", F.posexplode(F.when(columns > 0, widths)).alias("col", "width"))


def export_classifications(classes: DataFrame, files: DataFrame, keywords: DataFrame, manual: DataFrame) -> DataFrame:
    """filename, type (a manual one wins), confidence, level, overridden (Yes or No), keyword_count, top_keywords.

    classes (doc_id, type, confidence, level), files (doc_id, filename), keywords (doc_id, category, keyword, count, weight), manual (doc_id, type).
    """
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count") * F.col("weight")).alias("o"), "keyword", "category"))), 1, 5)
    words = keywords.groupBy("doc_id").agg(F.count(F.lit(1)).alias("keyword_count"), F.array_join(F.transform(top, lambda k: k["keyword"]), ",").alias("top_keywords"))
    rows = classes.join(files.select("doc_id", "filename"), "doc_id").join(words, "doc_id", "left").join(manual.select("doc_id", F.col("type").alias("manual")), "doc_id", "left")
    return rows.select("doc_id", "filename", F.coalesce("manual", "type").alias("type"), "confidence", "level", F.when(F.col("manual").isNull(), "No").otherwise("Yes").alias("overridden"), F.coalesce("keyword_count", F.lit(0)).alias("keyword_count"), F.coalesce("top_keywords", F.lit("")).alias("top_keywords"))


def export_history(history: DataFrame) -> DataFrame:
    """id, type, timestamp (ISO, UTC), description, can_undo, document_ids, metadata of log entries, without states before and after.

    An entry can be undone if it says so, has one document, and its metadata (JSON) names the versions before and after.
    """
    has = lambda k: F.get_json_object("metadata", f"$.{k}").isNotNull()
    undo = F.coalesce(F.col("can_undo") & (F.size("document_ids") == 1) & has("beforeVersionId") & has("afterVersionId"), F.lit(False))
    return history.select("id", "type", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "description", undo.alias("can_undo"), "document_ids", "metadata")


def export_library(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its own below path, and the archive's version."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
    spark.createDataFrame([(ARCHIVE_VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/archive_version")


def import_library(spark: SparkSession, path: str, schemas: dict, current: dict[str, DataFrame] | None = None, merge: bool = False, key: str = "id") -> dict[str, DataFrame]:
    """The tables of an archive; with merge, rows of current whose key is not in the archive stay beside them."""
    version = spark.read.json(f"{path}/archive_version").first()
    if not version or version["version"] != ARCHIVE_VERSION:
        raise ValueError("unsupported archive version")
    out = {}
    for name, schema in schemas.items():
        new = spark.read.schema(schema).json(f"{path}/{name}")
        out[name] = upsert(current[name], new, key) if merge and current and name in current else new
    return out


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The new rows, and the old ones whose key is not among them; null keys never match."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def validate_archive(documents: DataFrame, versions: DataFrame, blobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """record, id, error of rows that refer to nothing.

    documents (id, current_version_id, original_version_id), versions (id, blob_id), blobs (id), artifacts (id, blob_id).
    """
    known = versions.select(F.col("id").alias("ref")).distinct()
    missing = documents.where("current_version_id is null or original_version_id is null").select(F.lit("document").alias("record"), "id", F.lit("NO_VERSION").alias("error"))
    refs = documents.where("current_version_id is not null and original_version_id is not null").select("id", F.explode(F.array("current_version_id", "original_version_id")).alias("ref"))
    lost = refs.join(known, "ref", "left_anti").select("id").distinct().select(F.lit("document").alias("record"), "id", F.lit("MISSING_VERSION").alias("error"))
    bytes_ = blobs.select(F.col("id").alias("blob_id")).distinct()
    no_blob = lambda t, name: t.join(bytes_, "blob_id", "left_anti").select(F.lit(name).alias("record"), "id", F.lit("MISSING_BYTES").alias("error"))
    return missing.unionByName(lost).unionByName(no_blob(versions, "version")).unionByName(no_blob(artifacts, "artifact"))
