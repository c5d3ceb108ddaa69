"""Page manifest jobs: one row a page (doc_id, page, byte_size), never PDF bytes."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.folds import fold_rows
from quire.functions.shared import materialised


def parse_page_ranges(spec: Column, last: Column) -> Column:
    """"1-5, 8" as array<struct<start,end>>; null if any part is bad or out of range, or there is none."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    number = lambda p, k: F.regexp_extract(p, r"^([0-9]+)\s*(?:-\s*([0-9]+))?$", k).try_cast("int")
    ranges = F.transform(parts, lambda p: F.struct(number(p, 1).alias("start"), F.coalesce(number(p, 2), number(p, 1)).alias("end")))
    good = F.forall(ranges, lambda r: F.coalesce((r["start"] >= 1) & (r["end"] <= last) & (r["start"] <= r["end"]), F.lit(False)))
    return F.when((F.size(ranges) > 0) & good, ranges)


def split_by_ranges(manifest: DataFrame, specs: DataFrame) -> DataFrame:
    """doc_id, part, page, error for specs (doc_id, spec): a range join of pages and ranges; a bad spec is one error row."""
    last = manifest.groupBy("doc_id").agg(F.max("page").alias("last"))
    parsed = specs.join(last, "doc_id").select("doc_id", parse_page_ranges(F.col("spec"), F.col("last")).alias("ranges"))
    parts = parsed.where("ranges is not null").select("doc_id", F.posexplode("ranges").alias("part", "r"))
    pages = parts.join(manifest.select("doc_id", "page"), "doc_id").where("page between r.start and r.end").select("doc_id", (F.col("part") + 1).alias("part"), "page", F.lit(None).cast("string").alias("error"))
    bad = parsed.where("ranges is null").select("doc_id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("page"), F.lit("INVALID_RANGE").alias("error"))
    return pages.unionByName(bad)


def split_every(manifest: DataFrame, n: int) -> DataFrame:
    """doc_id, part, first_page, last_page, pages: n pages to a part."""
    part = (F.floor((F.col("page") - 1) / n) + 1).cast("int")
    return manifest.groupBy("doc_id", part.alias("part")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("pages"))


def split_plan(manifest: DataFrame, mode: str = "single", pages: tuple[int, ...] = (), parts: int = 2, prefix: str = "split") -> DataFrame:
    """doc_id, part, first_page, last_page, pages, filename, error: one row for each output.

    mode: single (every page), pages (those listed, in their order), even, odd, or parts (so many runs of equal length, the last ones
    shorter or missing). Listed pages out of range, and documents without such pages, give one error row.
    """
    last = F.max("page").over(Window.partitionBy("doc_id"))
    rows = manifest.select("doc_id", "page").withColumn("total", last)
    if mode == "parts":
        each = F.ceil(F.col("total") / parts)
        rows = rows.withColumn("part", (F.floor((F.col("page") - 1) / each) + 1).cast("int"))
    elif mode == "pages":
        wanted = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(i + 1).alias("part")) for i, p in enumerate(pages)])
        docs = rows.groupBy("doc_id").agg(F.max("total").alias("total"))
        bad = docs.where(F.exists(F.array(*map(F.lit, pages)), lambda p: (p < 1) | (p > F.col("total"))))
        rows = docs.join(bad.select("doc_id"), "doc_id", "left_anti").select("doc_id", "total", F.inline(wanted))
        failed = bad.select("doc_id", F.lit("PAGE_OUT_OF_RANGE").alias("error"))
    else:
        if mode in ("even", "odd"):
            none = rows.groupBy("doc_id").agg(F.count_if(F.col("page") % 2 == (0 if mode == "even" else 1)).alias("n")).where("n = 0")
            failed = none.select("doc_id", F.lit("NO_PAGES").alias("error"))
            rows = rows.where(F.col("page") % 2 == (0 if mode == "even" else 1))
        rows = rows.withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    plan = rows.groupBy("doc_id", "part").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("pages"), F.max("total").alias("total"))
    single = (F.col("first_page") == F.col("last_page")) | (F.count(F.lit(1)).over(Window.partitionBy("doc_id")) == F.col("total"))
    name = F.when(single, F.concat(F.lit(f"{prefix}_page"), "first_page", F.lit(".pdf"))).otherwise(F.concat(F.lit(f"{prefix}_pages"), "first_page", F.lit("-"), "last_page", F.lit(".pdf")))
    plan = plan.select("doc_id", "part", "first_page", "last_page", "pages", name.alias("filename"), F.lit(None).cast("string").alias("error"))
    return plan.unionByName(failed, allowMissingColumns=True) if mode in ("pages", "even", "odd") else plan


def split_by_size(manifest: DataFrame, max_bytes: int) -> DataFrame:
    """doc_id, part, page: a part ends before the page that would take it over max_bytes (at least 1024); one page may exceed it alone.

    A document's pages stream through one task in order; a null size counts as none.
    """
    if max_bytes < 1024:
        raise ValueError("max_bytes must be at least 1024")

    def start():
        part, used = 1, 0

        def step(size: int | None) -> tuple[int]:
            nonlocal part, used
            size = size or 0
            if used and used + size > max_bytes:
                part, used = part + 1, 0
            used += size
            return (part,)

        return step

    return fold_rows(manifest.select("doc_id", "page", "byte_size"), ["doc_id"], ["page"], ["byte_size"], "part int", start).select("doc_id", "part", "page")


def split_by_bookmark(manifest: DataFrame, outline: DataFrame) -> DataFrame:
    """doc_id, part, start, end: parts begin at page 1 and at bookmark pages in range."""
    last = manifest.groupBy("doc_id").agg(F.max("page").alias("last"))
    starts = outline.join(last, "doc_id").where("page between 1 and last").select("doc_id", "last", F.col("page").alias("start"))
    starts = starts.unionByName(starts.select("doc_id", "last", F.lit(1).alias("start"))).distinct()
    w = Window.partitionBy("doc_id").orderBy("start")
    return starts.select("doc_id", F.row_number().over(w).alias("part"), "start", F.coalesce(F.lead("start").over(w) - 1, F.col("last")).alias("end"))


def extract_pages(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, new_page, error of the pages (doc_id, page) wanted of each document, once each and in order.

    Pages the document doesn't have make it one error row instead.
    """
    wanted = pages.select("doc_id", "page").distinct().join(manifest.select("doc_id").distinct(), "doc_id", "left_semi")
    found = wanted.join(manifest.select("doc_id", "page", F.lit(True).alias("here")), ["doc_id", "page"], "left")
    found = found.withColumn("bad", F.max(F.col("here").isNull()).over(Window.partitionBy("doc_id")))
    kept = found.where("not bad").select("doc_id", "page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).alias("new_page"), F.lit(None).cast("string").alias("error"))
    return kept.unionByName(found.where("bad").select("doc_id", F.lit("PAGE_OUT_OF_RANGE").alias("error")).distinct(), allowMissingColumns=True)


def remove_pages(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, new_page of the pages that stay, numbered anew."""
    kept = manifest.select("doc_id", "page").join(pages, ["doc_id", "page"], "left_anti")
    return kept.withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))


def emptied_documents(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, error of documents of which the pages removed are all there are."""
    left = manifest.select("doc_id", "page").join(pages, ["doc_id", "page"], "left_anti").select("doc_id").distinct()
    return manifest.select("doc_id").distinct().join(left, "doc_id", "left_anti").select("doc_id", F.lit("NO_PAGES_LEFT").alias("error"))


def reorder_pages(manifest: DataFrame, orders: DataFrame) -> DataFrame:
    """doc_id, page, new_page: pages at their place in the document's order (doc_id, order: array of pages); places of unknown pages stay empty."""
    placed = orders.select("doc_id", F.posexplode("order").alias("i", "page"))
    return placed.join(manifest.select("doc_id", "page"), ["doc_id", "page"]).select("doc_id", "page", (F.col("i") + 1).alias("new_page"))


def merge_plan(docs: DataFrame) -> DataFrame:
    """bundle, doc_id, page_offset, page_count: documents (bundle, position, doc_id, page_count) laid end to end."""
    w = Window.partitionBy("bundle").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return docs.select("bundle", "doc_id", F.coalesce(F.sum("page_count").over(w), F.lit(0)).cast("bigint").alias("page_offset"), "page_count")


def merge_checks(bundles: DataFrame, docs: DataFrame, most: int = 50) -> DataFrame:
    """bundle, documents, error of every bundle (bundle): null where its documents (bundle, ...) can be merged, which takes 1 to `most`."""
    n = docs.groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))
    rows = bundles.select("bundle").distinct().join(n, "bundle", "left").select("bundle", F.coalesce("n", F.lit(0)).alias("documents"))
    return rows.withColumn("error", F.when(F.col("documents") == 0, "No documents provided for merging").when(F.col("documents") > most, f"Cannot merge more than {most} documents at once"))


_OUTLINE = "array<struct<title:string,dest:int,items:string>>"
#: White space at both ends, as scripts of web pages trim it.
_ENDS = "^[\\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u000b]+|[\\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u000b]+$"


def flat_outline(outlines: DataFrame) -> DataFrame:
    """doc_id, path (0-based places from the top), title, dest of every entry of outlines (doc_id, outline: JSON array of {title, dest, items}), however deep.

    Nested entries stay JSON until their level is unfolded, and levels with entries are written to the shared folder, so there are as many
    rounds as levels. Null, empty and unreadable outlines have no entries. Order by path is that of reading.
    """
    level = outlines.select("doc_id", F.array().cast("array<int>").alias("path"), F.col("outline").alias("items"))
    found = None
    while True:
        rows = level.select("doc_id", "path", F.posexplode(F.from_json("items", _OUTLINE)).alias("i", "e")).where("e is not null")
        rows = materialised(rows.select("doc_id", F.concat("path", F.array("i")).alias("path"), "e.title", "e.dest", "e.items"), "outline")
        part = rows.select("doc_id", "path", "title", "dest")
        found = part if found is None else found.unionByName(part)
        level = rows.where("items is not null and items not in ('', '[]')").select("doc_id", "path", "items")
        if level.isEmpty():
            return found


def merge_bookmarks(docs: DataFrame, outlines: DataFrame) -> DataFrame:
    """bundle, seq (0-based), doc_id, title, page (0-based in the merged document): the outlines (doc_id, outline) of documents (bundle, position, doc_id, page_count), flattened.

    Entries without a title or with a place outside their document are left out; what is nested in them stays.
    """
    plan = merge_plan(docs).join(docs.select("bundle", "doc_id", "position"), ["bundle", "doc_id"])
    title = F.regexp_replace("title", _ENDS, "")
    rows = flat_outline(outlines).withColumn("title", title).where("length(title) > 0").join(plan, "doc_id").where("dest >= 0 and dest < page_count")
    seq = F.row_number().over(Window.partitionBy("bundle").orderBy("position", "path")) - 1
    return rows.select("bundle", seq.alias("seq"), "doc_id", "title", (F.col("page_offset") + F.col("dest")).alias("page"))


def page_labels(manifest: DataFrame, form: str = "x-of-y", custom: str = "", start_page: int = 1, end_page: int | None = None, start_number: int = 1) -> DataFrame:
    """doc_id, page, label: page-x, x-of-y, x-slash-y, x-only or custom with {page} and {total}; without a custom text the number alone.

    Pages from start_page to end_page have one, numbered from start_number; the total is that of all pages. Null pages have none.
    """
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id")).cast("string")
    page = (F.col("page") - start_page + start_number).cast("string")
    form = "x-only" if form == "custom" and not custom else form
    label = {
        "page-x": F.concat(F.lit("Page "), page),
        "x-of-y": F.concat(page, F.lit(" of "), total),
        "x-slash-y": F.concat(page, F.lit("/"), total),
        "x-only": page,
        "custom": F.replace(F.replace(F.lit(custom), F.lit("{page}"), page), F.lit("{total}"), total),
    }[form]
    # The total is counted before pages are left out.
    labelled = manifest.select("doc_id", "page", label.alias("label")).where(F.col("page") >= start_page)
    return labelled if end_page is None else labelled.where(F.col("page") <= end_page)


def bates_numbers(manifest: DataFrame, prefix: str = "", suffix: str = "", start: int = 1, digits: int = 6, per_zone: int = 100_000, most_zones: int = 10_000, start_page: int = 1, end_page: int | None = None) -> DataFrame:
    """doc_id, page, bates: one running number over the pages from start_page to end_page of all documents, in doc_id and page order. doc_id is a number; rows without one are left out.

    Documents are cut into zones of about per_zone at quantiles of doc_id, whatever their spread. Only the zones' sums, most_zones at
    most, are added up in one task; documents are numbered within their zone and pages within their document.
    """
    manifest = manifest.where(F.col("page") >= start_page) if start_page > 1 else manifest
    manifest = manifest if end_page is None else manifest.where(F.col("page") <= end_page)
    counts = manifest.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    zones = max(1, min(most_zones, counts.count() // per_zone))
    cuts = sorted(set(counts.approxQuantile("doc_id", [i / zones for i in range(1, zones)], 0.25 / zones))) if zones > 1 else []
    inf = float("inf")
    if cuts:
        zoned = Bucketizer(splits=[-inf, *cuts, inf], inputCol="at", outputCol="zone").transform(counts.withColumn("at", F.col("doc_id").cast("double"))).drop("at")
    else:
        zoned = counts.withColumn("zone", F.lit(0.0))
    before = lambda key, part, x: F.coalesce(F.sum(x).over(Window.partitionBy(*part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = zoned.groupBy("zone").agg(F.sum("n").alias("z"))
    sums = sums.select("zone", before("zone", [F.lit(0)], "z").alias("zone_before"))
    first = zoned.join(F.broadcast(sums), "zone").select("doc_id", (F.col("zone_before") + before("doc_id", ["zone"], "n")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    number = (F.col("first") + nth + F.lit(start - 1)).cast("string")
    padded = F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number)
    return manifest.join(first, "doc_id").select("doc_id", "page", F.concat(F.lit(prefix), padded, F.lit(suffix)).alias("bates"))


def image_inventory(images: DataFrame, min_width: int = 0, min_height: int = 0) -> DataFrame:
    """doc_id, page, images, pixels: distinct objects of a page (doc_id, page, object_name, width, height) of the least size."""
    one = images.where((F.col("width") >= min_width) & (F.col("height") >= min_height)).groupBy("doc_id", "page", "object_name").agg(F.max(F.col("width") * F.col("height")).alias("px"))
    return one.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("images"), F.sum("px").alias("pixels"))


# The format that each filter of a stored image gives, and the share of the raw bytes it is taken to need.
IMAGE_FORMATS = {"DCTDecode": "jpeg", "JPXDecode": "jp2", "JBIG2Decode": "jbig2"}
IMAGE_SHARES = {"jpeg": 0.1, "png": 0.5}


def image_metadata(images: DataFrame, min_width: int = 0, min_height: int = 0, prefix: str = "image") -> DataFrame:
    """doc_id, index (0-based in the document), page, object_name, format, width, height, estimated_bytes, filename of a page's distinct objects.

    images: doc_id, page, seq (order of painting), object_name, width, height, filter. Of a name the first painted one counts, and goes where it
    is too small; without a name there is none. Missing sizes are 0; unknown and missing filters are png.
    """
    first = F.row_number().over(Window.partitionBy("doc_id", "page", "object_name").orderBy("seq"))
    rows = images.where("coalesce(object_name, '') <> ''").withColumn("nth", first).where("nth = 1").fillna(0, ["width", "height"])
    rows = rows.where((F.col("width") >= min_width) & (F.col("height") >= min_height))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in IMAGE_FORMATS.items() for x in kv]), F.col("filter")), F.lit("png"))
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in IMAGE_SHARES.items() for x in kv]), F.col("format")), F.lit(1.0))
    raw = F.col("width").cast("bigint") * F.col("height") * 3
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq", "object_name")) - 1
    rows = rows.withColumn("format", kind).withColumn("index", index).withColumn("estimated_bytes", F.floor(raw * share + 0.5).cast("bigint"))
    name = F.concat(F.lit(f"{prefix}_page"), F.col("page").cast("string"), F.lit("_"), (F.col("index") + 1).cast("string"), F.lit("."), "format")
    return rows.select("doc_id", "index", "page", "object_name", "format", "width", "height", "estimated_bytes", name.alias("filename"))


def image_counts(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, page, images, total (of the document) for every page (doc_id, page): distinct named objects, 0 on pages without one."""
    n = images.where("coalesce(object_name, '') <> ''").groupBy("doc_id", "page").agg(F.countDistinct("object_name").alias("images"))
    rows = manifest.select("doc_id", "page").distinct().join(n, ["doc_id", "page"], "left").fillna(0, ["images"])
    return rows.withColumn("total", F.sum("images").over(Window.partitionBy("doc_id")))


def window_counter(limit: int, window_ms: int, reset: int | None = None, count: int = 0):
    """A client's limiter: a step from a request's time to (allowed, retry_after in seconds), and its state (reset, count)."""

    def step(at: int) -> tuple[bool, int]:
        nonlocal reset, count
        if reset is None or reset <= at:
            reset, count = at + window_ms, 0
        if count >= limit:
            return False, -(-(reset - at) // 1000)
        count += 1
        return True, 0

    return step, lambda: (reset, count)


def rate_limit(requests: DataFrame, limit: int = 30, window_ms: int = 60_000) -> DataFrame:
    """client, request_id, allowed, retry_after: a client's window opens at its first request and holds limit requests.

    requests: (client, request_id, at_ms). A client's requests stream through one task in order of time; only its window is
    held. retry_after is in seconds. The order is what the limit is about, so a client is never spread over tasks.
    """
    rows = requests.select("client", "request_id", "at_ms").where("at_ms is not null")
    found = fold_rows(rows, ["client"], ["at_ms", "request_id"], ["at_ms"], "allowed boolean, retry_after bigint", lambda: window_counter(limit, window_ms)[0])
    return found.select("client", "request_id", "allowed", "retry_after")


def request_counts(requests: DataFrame, width: str = "1 hour") -> DataFrame:
    """start, kind, requests, clients in tumbling windows of (ts, kind, client)."""
    return requests.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("client").alias("clients")).select(F.col("w.start").alias("start"), "kind", "requests", "clients")
