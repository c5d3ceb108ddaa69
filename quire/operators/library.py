"""The document library: filters, versions, folders, tags, names, annotations, statistics.

Tables are keyed by id or document_id. Null fields fail filters and sort last where descending; repeated rows count; empty
tables give no rows, and statistics over them one row of zeros or nulls. Columns not named are kept or ignored as stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.shared import materialised

STATUSES = ("ready", "processing", "archived", "error", "pending")
# MIME types by extension.
MIME_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "svg": "image/svg+xml", "txt": "text/plain", "html": "text/html", "json": "application/json",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
SORTABLE = ("filename", "file_size", "page_count", "created_at", "status", "id")


def query_documents(docs: DataFrame, status: str | None = None, folder_id: str | None = None, tags: tuple[str, ...] = (), favourites: bool = False, search: str = "", root: bool = False, sort_by: str = "created_at", descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the documents that pass all filters (tags: any of), sorted by the field and then id, with total and has_more. root: those in no folder."""
    if sort_by not in SORTABLE:
        raise ValueError(f"can't sort by {sort_by}")
    kept = docs
    if status:
        kept = kept.where(F.col("status") == status)
    if folder_id is not None:
        kept = kept.where(F.col("folder_id") == folder_id)
    if root:
        kept = kept.where(F.col("folder_id").isNull())
    if tags:
        kept = kept.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if favourites:
        kept = kept.where("is_favorite")
    if search:
        kept = kept.where(F.lower("filename").contains(search.lower()) | F.exists("tags", lambda t: F.lower(t).contains(search.lower())))
    order = F.desc(sort_by) if descending else F.asc(sort_by)
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    return kept.orderBy(order, "id").offset(offset).limit(limit).join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + limit)


def recent_documents(docs: DataFrame, n: int = 5) -> DataFrame:
    """The n newest documents."""
    return docs.orderBy(F.desc("created_at"), "id").limit(n)


def favourites(docs: DataFrame, n: int = 5) -> DataFrame:
    """The n favourites changed last."""
    return docs.where("is_favorite").orderBy(F.desc("updated_at"), "id").limit(n)


def top_accessed(accesses: DataFrame, n: int = 10) -> DataFrame:
    """document_id, accesses, last_accessed_at of the n documents with most accesses (document_id, at), the latest and then the smallest id first of equal ones."""
    counts = accesses.groupBy("document_id").agg(F.count(F.lit(1)).alias("accesses"), F.max("at").alias("last_accessed_at"))
    return counts.orderBy(F.desc("accesses"), F.desc("last_accessed_at"), "document_id").limit(n)


def library_stats(docs: DataFrame) -> DataFrame:
    """grouping (all, status, month), key, documents, pages, bytes, in one pass with grouping sets.

    Every known status has a row, of zeros where no document has it; documents without a status or month are counted under a null key. The key of all is empty.
    """
    month = docs.withColumn("month", F.date_format("created_at", "yyyy-MM"))
    sets = month.groupingSets([[], ["status"], ["month"]], "status", "month").agg(F.grouping("status").alias("s"), F.grouping("month").alias("m"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
    sets = sets.select(F.when(F.col("s") == 0, "status").when(F.col("m") == 0, "month").otherwise("all").alias("grouping"), F.when(F.col("s") == 0, F.col("status")).when(F.col("m") == 0, F.col("month")).otherwise("").alias("key"), "documents", "pages", "bytes")
    zeros = docs.sparkSession.createDataFrame([("status", k, 0, 0, 0) for k in STATUSES], "grouping string, key string, documents bigint, pages bigint, bytes bigint")
    return sets.unionByName(zeros).groupBy("grouping", "key").agg(*[F.sum(c).alias(c) for c in ("documents", "pages", "bytes")])


def content_stats(docs: DataFrame, messages: DataFrame, embeddings: DataFrame, dimensions: int = 384) -> DataFrame:
    """conversations, messages, conversation_bytes (of the messages as JSON), embedding_bytes, thumbnail_bytes: one row.

    docs (thumbnail), messages (conv_id, turn, role, text), embeddings. Sums over empty tables are 0.
    """
    size = F.octet_length(F.to_json(F.struct("turn", "role", "text")))
    # Each side is one row.
    talk = messages.agg(F.countDistinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum(size), F.lit(0)).alias("conversation_bytes"))
    vectors = embeddings.agg((F.count(F.lit(1)) * dimensions * 4).alias("embedding_bytes"))
    pictures = docs.agg(F.coalesce(F.sum(F.octet_length("thumbnail")), F.lit(0)).alias("thumbnail_bytes"))
    return talk.join(F.broadcast(vectors), F.lit(True)).join(F.broadcast(pictures), F.lit(True))


def storage_quota(stats: DataFrame, quota: int) -> DataFrame:
    """used, available, percent (1 decimal), level (critical from 95, low from 80, else ok) of the whole library."""
    used = F.col("bytes")
    percent = F.round(used / quota * 100, 1)
    return stats.where("grouping = 'all'").select(used.alias("used"), F.greatest(F.lit(0), quota - used).alias("available"), percent.alias("percent"), F.when(percent >= 95, "critical").when(percent >= 80, "low").otherwise("ok").alias("level"))


def import_documents(new: DataFrame, docs: DataFrame) -> DataFrame:
    """id, outcome (imported, skipped, error) of arriving documents (id, file_size): known ids are skipped, empty ones errors; of repeated ids the largest file counts."""
    known = docs.select("id").distinct().withColumn("known", F.lit(True))
    rows = new.groupBy("id").agg(F.max("file_size").alias("file_size")).join(known, "id", "left")
    return rows.select("id", F.when(F.coalesce("file_size", F.lit(0)) <= 0, "error").when(F.col("known"), "skipped").otherwise("imported").alias("outcome"))


def import_files(new: DataFrame, docs: DataFrame, at) -> dict[str, DataFrame]:
    """The tables that an import of files (id, filename, content, mime_type, page_count, tags, folder_id) makes beside documents (id): outcomes, documents, blobs, versions, counts.

    outcomes: id, outcome (imported, skipped, error), message. A known id is skipped; a file that is empty, of another type than PDF or
    without its header is an error. Of repeated ids the largest file counts, of equally large ones the one of the smaller hash. An
    imported file has a record, a blob and version 1, all made at the given time; their ids are hashes of the document's. counts is one row.
    """
    hashed = new.withColumns({"_size": F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint"), "_sha": F.sha2(F.coalesce("content", F.lit(b"")), 256)})
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_size"), "_sha", "filename"))
    known = docs.select(F.col("id").alias("_known")).where("_known is not null").distinct()
    one = hashed.withColumn("_nth", nth).where("_nth = 1").drop("_nth").join(known, F.col("id") == F.col("_known"), "left")
    mime = F.coalesce("mime_type", F.lit(""))
    # The messages.
    message = F.when(F.col("_size") == 0, "Cannot import an empty document").when((mime != "") & (mime != MIME_TYPES["pdf"]), "Only application/pdf documents can be imported").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "The selected file does not contain a PDF header")
    told = materialised(one.withColumn("message", F.when(F.col("_known").isNull(), message)).withColumn("outcome", F.when(F.col("_known").isNotNull(), "skipped").when(F.col("message").isNotNull(), "error").otherwise("imported")).drop("_known"), "import")
    made = told.where("outcome = 'imported'").withColumns({"blob_id": F.sha2(F.concat(F.col("id").cast("string"), F.lit("/blob/1")), 256), "version_id": F.sha2(F.concat(F.col("id").cast("string"), F.lit("/version/1")), 256), "created_at": F.lit(at).cast("timestamp")})
    records = made.select("id", "filename", F.lit(MIME_TYPES["pdf"]).alias("mime_type"), F.col("_size").alias("file_size"), "page_count", F.lit("ready").alias("status"), "tags", "folder_id", "created_at", F.col("created_at").alias("updated_at"), F.col("created_at").alias("last_accessed_at"), F.col("_sha").alias("file_hash"), F.col("version_id").alias("original_version_id"), F.col("version_id").alias("current_version_id"), F.lit("local-only").alias("sync_status"))
    blobs = made.select(F.col("blob_id").alias("id"), F.col("id").alias("document_id"), F.col("content").alias("data"), F.col("_size").alias("size"), F.col("_sha").alias("sha256"), "created_at")
    versions = made.select(F.col("version_id").alias("id"), F.col("id").alias("document_id"), "blob_id", F.lit(1).alias("version_number"), F.lit("import").alias("source"), F.lit("Original import").alias("label"), "created_at")
    counts = told.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("imported", "imported"), ("skipped", "skipped"), ("error", "errors"))])
    return {"outcomes": told.select("id", "outcome", "message"), "documents": records, "blobs": blobs, "versions": versions, "counts": counts}


def append_versions(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """document_id, version_number, blob_id, parent_version, is_current: changes (document_id, seq, blob_id) numbered on from the last version."""
    last = versions.groupBy("document_id").agg(F.max("version_number").alias("last"))
    w = Window.partitionBy("document_id").orderBy("seq")
    rows = changes.join(last, "document_id", "left").withColumn("version_number", F.coalesce("last", F.lit(0)) + F.row_number().over(w))
    newest = F.max("version_number").over(Window.partitionBy("document_id"))
    return rows.select("document_id", "version_number", "blob_id", F.nullif(F.col("version_number") - 1, F.lit(0)).alias("parent_version"), (F.col("version_number") == newest).alias("is_current"))


def latest_version(versions: DataFrame) -> DataFrame:
    """document_id, version_number, blob_id, size of the newest version."""
    return versions.groupBy("document_id").agg(F.max_by(F.struct("version_number", "blob_id", "size"), "version_number").alias("v")).select("document_id", "v.*")


def version_history(versions: DataFrame) -> DataFrame:
    """document_id, place (1 is the newest), version_number, blob_id, size of all versions, newest first."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("version_number")))
    return versions.select("document_id", place.alias("place"), "version_number", "blob_id", "size")


def bytes_as_of(versions: DataFrame, moment) -> DataFrame:
    """document_id, version_number, size as they stood at the moment."""
    return latest_version(versions.where(F.col("created_at") <= F.lit(moment)))


def versions_as_of(versions: DataFrame, points: DataFrame, span_seconds: int = 86_400) -> DataFrame:
    """document_id, at, version_number, blob_id, size: for every point (document_id, at) the version in force, nulls before the first one.

    An as-of join without an inequality: versions (document_id, version_number, blob_id, size, created_at) and points are
    sorted together and the last version is carried forward, within stretches of span_seconds; only a stretch's last
    version goes on to the later ones, so a document with most of all rows is spread over its stretches. A version made at the very
    moment counts, of several the highest number. Points without a document or time, and versions without a time, take no part; repeated points keep a row each.
    """
    stretch = lambda at: F.floor(F.unix_micros(at.cast("timestamp")) / (span_seconds * 1_000_000))
    made = versions.where("created_at is not null").select("document_id", F.col("created_at").cast("timestamp").alias("at"), F.struct("version_number", "blob_id", "size").alias("v"))
    made = made.groupBy("document_id", "at").agg(F.max_by("v", "v.version_number").alias("v")).withColumn("s", stretch(F.col("at")))
    asked = points.where("document_id is not null and at is not null").select("document_id", F.col("at").cast("timestamp").alias("at")).withColumn("s", stretch(F.col("at")))
    both = made.withColumn("ask", F.lit(0)).unionByName(asked.withColumn("ask", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("document_id", "s").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("v", F.last("v", ignorenulls=True).over(so_far)).where("ask = 1")
    # A row for each stretch of a document: its last version, and the last one of those before.
    ends = both.groupBy("document_id", "s").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("at"))).alias("last"))
    earlier = Window.partitionBy("document_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("document_id", "s", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    found = inside.join(ends, ["document_id", "s"]).withColumn("v", F.coalesce("v", "before"))
    return found.select("document_id", "at", "v.version_number", "v.blob_id", "v.size")


def delete_documents(ids: DataFrame, tables: dict[str, DataFrame], at=None) -> dict[str, DataFrame]:
    """What is left of each table once the documents of ids (document_id) go.

    documents goes by id; conversations (conv_id, document_ids) loses the ids from its lists, is changed at the given time where it has an
    updated_at, and goes where none is left; messages (conv_id) go with their conversation; all other tables (blobs, versions,
    runs, artifacts, embeddings, ...) go by document_id. Conversations that named no document stay, as do rows without an id. Repeated ids do no harm.
    """
    gone = ids.select(F.col("document_id").alias("_gone_id")).where("_gone_id is not null").distinct()
    out = {n: t.join(gone, t["id" if n == "documents" else "document_id"] == gone["_gone_id"], "left_anti") for n, t in tables.items() if n not in ("conversations", "messages")}
    if "conversations" in tables:
        talks = tables["conversations"]
        hits = talks.select(F.col("conv_id").alias("_hit_conv"), F.explode(F.array_distinct("document_ids")).alias("_gone_id")).join(gone, "_gone_id").groupBy("_hit_conv").agg(F.collect_set("_gone_id").alias("_gone_ids"))
        left = F.filter("document_ids", lambda d: ~F.coalesce(F.array_contains("_gone_ids", d), F.lit(False)))
        marked = talks.join(hits, talks["conv_id"] == hits["_hit_conv"], "left").withColumn("_left_ids", F.when(F.col("_gone_ids").isNull(), F.col("document_ids")).otherwise(left))
        dropped = F.col("_gone_ids").isNotNull() & (F.size("_left_ids") == 0)
        if at is not None and "updated_at" in talks.columns:
            marked = marked.withColumn("updated_at", F.when(F.col("_gone_ids").isNotNull(), F.lit(at)).otherwise(F.col("updated_at")))
        out["conversations"] = marked.where(~dropped).withColumn("document_ids", F.col("_left_ids")).select(*talks.columns)
        if "messages" in tables:
            silent = marked.where(dropped).select(F.col("conv_id").alias("_gone_conv")).distinct()
            out["messages"] = tables["messages"].join(silent, tables["messages"]["conv_id"] == silent["_gone_conv"], "left_anti")
    elif "messages" in tables:
        out["messages"] = tables["messages"]
    return out


def folder_tree(folders: DataFrame) -> DataFrame:
    """ancestor, id, level for every folder (id, parent_id) below each one, itself at 0, however deep.

    By doubled reach: a round joins what lies up to 2^k levels above with the folder 2^k levels up, so a chain of n folders takes
    log2(n) rounds; each is written to the shared folder. A folder of a ring has all of the ring above it once, and rounds end when
    they find no new pair. Roots are folders whose parent is null or unknown; ids must not repeat.
    """
    known = folders.select("id", "parent_id").where("id is not null")
    up = known.join(known.select(F.col("id").alias("parent_id")), "parent_id").select("id", F.col("parent_id").alias("above"))
    found = known.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("level"))
    reach, count = 1, found.count()
    while True:
        up = materialised(up, "folder_steps")
        further = up.select(F.col("id").alias("low"), F.col("above").alias("id")).join(found, "id").select("ancestor", F.col("low").alias("id"), (F.col("level") + reach).alias("level"))
        found = materialised(found.unionByName(further).groupBy("ancestor", "id").agg(F.min("level").alias("level")), "folders")
        if (new := found.count()) == count:
            return found
        count, reach = new, 2 * reach
        up = up.join(up.select(F.col("id").alias("above"), F.col("above").alias("top")), "above").select("id", F.col("top").alias("above"))


def folder_subtree(folders: DataFrame, folder_id) -> DataFrame:
    """id of a folder (id, parent_id) and of all below it, without the pairs of the others.

    Every folder keeps one place above it and whether the wanted one lies on the way there; a round doubles the way, so a chain
    of n folders takes log2(n) rounds. Rings end when the way is longer than there are folders. An unknown folder has no subtree.
    """
    known = folders.select("id", F.col("parent_id").alias("above")).where("id is not null")
    state = known.withColumn("hit", F.col("id") == F.lit(folder_id)).withColumn("above", F.when(~F.col("hit"), F.col("above")))
    most, reach = known.count(), 1
    while True:
        state = materialised(state, "subtree")
        if reach > most or state.where("not hit and above is not null").isEmpty():
            return state.where("hit").select("id")
        there = state.select(F.col("id").alias("above"), F.col("above").alias("top"), F.col("hit").alias("found"))
        # What is settled has no way left, so no null or shared key gathers rows.
        open_ = state.where("not hit and above is not null").join(there, "above", "left")
        moved = open_.select("id", F.when(~F.coalesce("found", F.lit(False)), F.col("top")).alias("above"), F.coalesce("found", F.lit(False)).alias("hit"))
        state, reach = state.where("hit or above is null").unionByName(moved), 2 * reach


def delete_folder(folders: DataFrame, docs: DataFrame, folder_id, target=None) -> tuple[DataFrame, DataFrame]:
    """The folders without one and all below it, and the documents, those in them moved to the target folder (null: to the root)."""
    gone = folder_subtree(folders, folder_id).select(F.col("id").alias("_gone_folder"))
    kept = folders.join(gone, folders["id"] == gone["_gone_folder"], "left_anti")
    moved = docs.join(gone, docs["folder_id"] == gone["_gone_folder"], "left").withColumn("folder_id", F.when(F.col("_gone_folder").isNotNull(), F.lit(target)).otherwise(F.col("folder_id"))).drop("_gone_folder")
    return kept, moved


def folder_counts(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """folder_id, documents (0 where empty)."""
    n = docs.groupBy("folder_id").agg(F.count(F.lit(1)).alias("documents"))
    return folders.select(F.col("id").alias("folder_id")).join(n, "folder_id", "left").fillna(0, ["documents"])


def tag_counts(docs: DataFrame) -> DataFrame:
    """tag, documents."""
    return docs.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("documents"))


def change_tags(docs: DataFrame, add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> DataFrame:
    """The documents with tags added at the end, once, and others taken away."""
    lits = lambda ts: F.array(*map(F.lit, ts)).cast("array<string>")
    return docs.withColumn("tags", F.array_except(F.array_union("tags", lits(add)), lits(remove)))


def human_size(n: Column) -> Column:
    """Bytes as "1.5 KB": two decimals at most, trailing zeros dropped."""
    units = F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB", "TB")))
    step = F.when(n >= 1024**4, 4).when(n >= 1024**3, 3).when(n >= 1024**2, 2).when(n >= 1024, 1).otherwise(0)
    number = F.regexp_replace(F.format_string("%.2f", F.round(n / F.pow(F.lit(1024.0), step), 2)), r"\.?0+$", "")
    return F.when(n < 0, "Invalid size").when(n == 0, "0 Bytes").otherwise(F.concat_ws(" ", number, F.get(units, step)))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without one, for names that begin with it, and where nothing follows."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def duration(ms: Column) -> Column:
    """Milliseconds as "850ms", "2.5s", "1m 30s" or "2h 5m"."""
    seconds = F.floor(ms / 1000)
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    two = lambda a, x, b, y: F.when(b > 0, F.concat(a.cast("string"), F.lit(f"{x} "), b.cast("string"), F.lit(y))).otherwise(F.concat(a.cast("string"), F.lit(x)))
    return (
        F.when(ms < 0, "Invalid duration").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(seconds < 60, F.format_string("%.1fs", F.floor(ms / 100 + 0.5) / 10))
        .when(minutes < 60, two(minutes, "m", seconds % 60, "s")).otherwise(two(hours, "h", minutes % 60, "m"))
    )


def relative_time(at: Column, now: Column) -> Column:
    """How long ago: "just now", "5 minutes ago", up to years of 365 days."""
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))
    out = F.when(seconds < 60, "just now")
    # Unit, its seconds and the seconds at which the next one takes over.
    for unit, size, up_to in (("minute", 60, 3600), ("hour", 3600, 86_400), ("day", 86_400, 7 * 86_400), ("week", 7 * 86_400, 28 * 86_400), ("month", 30 * 86_400, 360 * 86_400), ("year", 365 * 86_400, None)):
        # Between 28 and 30 days, and 360 and 365, the larger unit counts 0.
        n = F.floor(seconds / size)
        text = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        out = out.when(seconds < up_to, text) if up_to else out.otherwise(text)
    return out


def truncate(text: Column, most: int, suffix: str = "...") -> Column:
    """The text, cut so that with the suffix it has most characters if it has more."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix)))


def sanitize_filename(name: Column) -> Column:
    """Characters that file systems refuse become _, dots in front one _, dots at the end go; "unnamed" where nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^\.+", "_"), r"\.+$", "")
    return F.coalesce(F.nullif(F.trim(clean), F.lit("")), F.lit("unnamed"))


def output_name(name: Column, suffix: str, extension_to: str | None = None) -> Column:
    """The file name with the suffix before its extension, or before a new one."""
    dotted = name.rlike(r"(?s)^.+\.[^.]*$")
    base = F.when(dotted, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    tail = F.lit("." + extension_to.removeprefix(".")) if extension_to else F.when(dotted, F.regexp_extract(name, r"\.[^.]*$", 0)).otherwise("")
    return sanitize_filename(F.concat(base, F.lit(suffix), tail))


def artifact_name(name: Column) -> Column:
    """The last part of a path with all but letters, digits, dots, dashes and underscores replaced; null if nothing or only dots are left."""
    safe = F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*$", 1), "[^a-zA-Z0-9._-]", "_")
    return F.when(~safe.isin("", ".", ".."), safe)


def mime_type(extension_of: Column) -> Column:
    """The MIME type of an extension, with or without a dot; application/octet-stream for others."""
    types = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(types, F.regexp_replace(F.lower(extension_of), r"^\.", "")), F.lit("application/octet-stream"))


def distinct_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order; null is a key."""
    n = _fresh(rows)
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(n) == 1).drop(n)


def chunk_rows(rows: DataFrame, size: int, group: str, *order: str) -> DataFrame:
    """The rows with chunk: 0-based groups of size rows in the given order within each value of the column group."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size).cast("int"))


def _fresh(rows: DataFrame) -> str:
    """A column name that the rows don't have."""
    return "_" * (1 + max(map(len, rows.columns), default=0)) + "n"


def annotation_counts(annotations: DataFrame) -> DataFrame:
    """document_id, page, type, annotations, unlocked: by page and type, by page (type null) and by document (both null)."""
    return annotations.rollup("document_id", "page", "type").agg(F.count(F.lit(1)).alias("annotations"), F.count_if(~F.coalesce("locked", F.lit(False))).alias("unlocked")).where("document_id is not null")


def filter_annotations(annotations: DataFrame, page: int | None = None, kind: str | None = None, unlocked: bool = False) -> DataFrame:
    """Annotations of a page, of a type, or that aren't locked."""
    kept = annotations if page is None else annotations.where(F.col("page") == page)
    kept = kept if kind is None else kept.where(F.col("type") == kind)
    return kept.where(~F.coalesce("locked", F.lit(False))) if unlocked else kept


def move_annotations(annotations: DataFrame, moves: DataFrame, at) -> DataFrame:
    """The annotations, those in moves (id, to_page) on their new page and changed at the given time; locked ones stay. Of several moves of one the largest page counts."""
    to = moves.groupBy("id").agg(F.max("to_page").alias("to_page"))
    rows = annotations.join(to, "id", "left")
    go = F.col("to_page").isNotNull() & ~F.coalesce("locked", F.lit(False))
    return rows.withColumn("page", F.when(go, F.col("to_page")).otherwise(F.col("page"))).withColumn("updated_at", F.when(go, F.lit(at)).otherwise(F.col("updated_at"))).drop("to_page")
