"""Operation history, job runs and chat logs.

Null fields fail filters and count as missing in sums; repeated rows are entries of their own; ties in time go by id; empty tables
give no rows, and totals over them one row of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.folds import fold_rows

# Operation types, terminal states, formats and rules of operations.
TYPES = ("merge", "split", "compress", "convert", "watermark", "security", "rotate", "crop", "resize", "reorder", "delete_pages", "extract_images", "extract_text", "ocr", "signature", "annotation", "edit", "other")
OFFICE = ("docx", "xlsx", "pptx")
MODEL_ID = r"\A[a-zA-Z0-9._:/-]{1,160}\z"
TERMINAL = ("succeeded", "failed", "cancelled", "expired")


def history_filter(history: DataFrame, types: tuple[str, ...] = (), query: str = "") -> DataFrame:
    """Entries of the types whose description, file names (an array, where there is one) or type label holds the query, whatever its case."""
    kept = history.where(F.col("type").isin(*types)) if types else history
    if not query:
        return kept
    q = query.lower()
    hit = F.coalesce(F.lower("description").contains(q), F.lit(False)) | F.coalesce(F.lower(type_label(F.col("type"))).contains(q), F.lit(False))
    if "file_names" in history.columns:
        hit = hit | F.coalesce(F.exists("file_names", lambda n: F.lower(n).contains(q)), F.lit(False))
    return kept.where(hit)


def type_label(kind: Column) -> Column:
    """The words of an operation type, capitalised; Unknown for others."""
    return F.when(kind.isin(*TYPES), F.when(kind == "ocr", "OCR").otherwise(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))).otherwise("Unknown")


def history_by_day(history: DataFrame) -> DataFrame:
    """day, entries, users, types (sorted)."""
    return history.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("user_id").alias("users"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def recent_operations(history: DataFrame, n: int = 10) -> DataFrame:
    """The n newest entries of all."""
    return history.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def cap_history(history: DataFrame, most: int = 50) -> DataFrame:
    """The newest entries of each user, most at most."""
    return _among(history, F.desc("timestamp"), F.desc("id"), test=lambda n: n <= most)


def clear_range(history: DataFrame, first: int, last: int) -> DataFrame:
    """The entries of each user but those at places first to last, 0-based from the oldest."""
    return _among(history, F.asc("timestamp"), F.asc("id"), test=lambda n: (n <= first) | (n > last + 1))


def _among(history: DataFrame, *order: Column, test) -> DataFrame:
    """The entries whose place in their user's order passes the test."""
    n = "_" * (1 + max(map(len, history.columns))) + "n"
    return history.withColumn(n, F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(test(F.col(n))).drop(n)


def clear_older_than(history: DataFrame, moment) -> DataFrame:
    """Entries from the moment on."""
    return history.where(F.col("timestamp") >= F.lit(moment))


def operations_for_document(history: DataFrame, document_id) -> DataFrame:
    """Entries whose document_ids hold the document."""
    return history.where(F.array_contains("document_ids", F.lit(document_id)))


def operations_by_document(history: DataFrame) -> DataFrame:
    """document_id, operations, undoable, last_at over all documents of the entries; an entry counts once for each of its documents."""
    rows = history.select(F.explode(F.array_distinct("document_ids")).alias("document_id"), "timestamp", undoable().alias("undo"))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("operations"), F.count_if("undo").alias("undoable"), F.max("timestamp").alias("last_at"))


def undoable() -> Column:
    """Whether an entry (can_undo, document_ids, metadata) can be undone: it says so, has one document and names the versions before and after."""
    has = lambda k: F.get_json_object("metadata", f"$.{k}").isNotNull()
    return F.coalesce(F.col("can_undo") & (F.size("document_ids") == 1) & has("beforeVersionId") & has("afterVersionId"), F.lit(False))


def replayer(most: int = 50, held: list[bool] | None = None, index: int = -1):
    """A document's undo log: a step from (action, can_undo) to (applied, entries, position, undo, redo), and its state (held, index)."""
    held = list(held or [])

    def step(action: str, can_undo: bool | None) -> tuple[bool, int, int, int, int]:
        nonlocal index
        applied = True
        if action == "add":
            del held[index + 1 :]
            held.append(bool(can_undo))
            del held[: max(0, len(held) - most)]
            index = len(held) - 1
        elif action == "undo" and index >= 0 and held[index]:
            index -= 1
        elif action == "redo" and index < len(held) - 1:
            index += 1
        else:
            applied = False
        return applied, len(held), index, sum(held[: index + 1]), len(held) - 1 - index

    return step, lambda: (held, index)


def history_replay(events: DataFrame, most: int = 50) -> DataFrame:
    """document_id, seq, action, applied, entries, position, undo, redo after each event (document_id, seq, action, can_undo).

    add cuts off what was undone; undo and redo move the position where they can; the oldest of over `most` entries goes. A document's
    events stream through one task in order of seq.
    """
    rows = events.select("document_id", "seq", "action", "can_undo")
    return fold_rows(rows, ["document_id"], ["seq"], ["action", "can_undo"], "applied boolean, entries int, position int, undo int, redo int", lambda: replayer(most)[0]).drop("can_undo")


def validate_operations(operations: DataFrame) -> DataFrame:
    """id, error of operations (id, type, options: JSON): the first rule broken, null for good ones. Missing, null and unreadable options are empty ones."""
    get = lambda k: F.get_json_object("options", f"$.{k}")
    blank = lambda k: F.length(F.trim(F.coalesce(get(k), F.lit("")))) == 0
    more = lambda *ks: F.coalesce(F.greatest(*[F.coalesce(get(k).try_cast("double"), F.lit(0.0)) for k in ks]) > 0, F.lit(False))
    kind = F.col("type")
    user = F.coalesce(get("userPassword"), F.lit(""))
    crop = ((get("cropMode") == "percentage") & more("cropPercent.left", "cropPercent.right", "cropPercent.top", "cropPercent.bottom")) | ((get("cropMode") == "absolute") & more("cropBox.width", "cropBox.width") & more("cropBox.height", "cropBox.height"))
    server = ((kind == "compress") & (get("level") == "maximum")) | ((kind == "convert") & get("format").isin(*OFFICE)) | ((kind == "ocr") & (get("engine") == "server")) | (kind == "security")
    error = (
        F.when((kind == "security") & blank("ownerPassword"), "Owner password required")
        .when((kind == "security") & (user != "") & (user == get("ownerPassword")), "Passwords must be different")
        .when((kind == "watermark") & blank("text"), "Watermark text required")
        .when((kind == "split") & (get("mode") == "range") & blank("ranges"), "Page range required")
        .when((kind == "crop") & ~F.coalesce(crop, F.lit(False)), "Crop values required")
        .when(server & ~F.coalesce(get("serverConsent") == "true", F.lit(False)), "Upload consent required")
    )
    return operations.select("id", error.alias("error"))


def queue_stats(runs: DataFrame) -> DataFrame:
    """total, a count for each status, overall_progress: the rounded mean progress, 100 for ended runs."""
    statuses = ("queued", "running", *TERMINAL[:3])
    progress = F.when(F.col("status").isin(*TERMINAL), 100.0).otherwise(F.col("progress"))
    return runs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.floor(F.coalesce(F.avg(progress), F.lit(0.0)) + 0.5).cast("int").alias("overall_progress"))


def run_outcomes(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """operation, engine (null: all), runs, succeeded, artifacts, bytes over the cube of operation and engine."""
    made = artifacts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    rows = runs.join(made, "run_id", "left").fillna(0, ["n", "size"])
    return rows.cube("operation", "engine").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.sum("n").alias("artifacts"), F.sum("size").alias("bytes"))


def run_statistics(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """operation, engine, status (null: all, told from null values by level), level, runs, succeeded, success_rate, artifacts, bytes, mean_ms, longest_ms over the cube of the three.

    runs (run_id, operation, engine, status, created_at, completed_at), artifacts (run_id, size). The rate is of succeeded among ended runs, null
    where none has ended. Runs without both times have no duration. level is Spark's grouping id.
    """
    made = artifacts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    rows = runs.join(made, "run_id", "left").fillna(0, ["n", "size"])
    took = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1000
    good, ended = F.count_if(F.col("status") == "succeeded"), F.count_if(F.col("status").isin(*TERMINAL))
    return rows.withColumn("ms", took).cube("operation", "engine", "status").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("runs"), good.alias("succeeded"), (good / F.nullif(ended, F.lit(0))).alias("success_rate"), F.sum("n").alias("artifacts"), F.sum("size").alias("bytes"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("longest_ms"))


def active_jobs(events: DataFrame) -> DataFrame:
    """job_id, status, updated_at of the jobs whose last state isn't terminal."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "event_id")).alias("s")).select("job_id", "s.*")
    return last.where(~F.col("status").isin(*TERMINAL))


def job_lifecycle(events: DataFrame) -> DataFrame:
    """job_id, event_id, status, accepted: an event after a job's first terminal state is a rejected conflict."""
    w = Window.partitionBy("job_id").orderBy("updated_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("status").isin(*TERMINAL).cast("int")).over(w), F.lit(0))
    return events.select("job_id", "event_id", "status", (ended == 0).alias("accepted"))


def explode_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn (0-based), role, text, citations of conversations (conv_id, messages: array of struct(role, text, citations)); empty ones give no rows."""
    return conversations.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", "turn", "m.*")


def conversations_for_document(conversations: DataFrame, document_id) -> DataFrame:
    """Conversations (conv_id, document_ids, ...) about the document."""
    return conversations.where(F.array_contains("document_ids", F.lit(document_id)))


def recent_conversations(conversations: DataFrame, n: int = 10) -> DataFrame:
    """The n conversations changed last."""
    return conversations.orderBy(F.desc("updated_at"), "conv_id").limit(n)


def message_counts(messages: DataFrame) -> DataFrame:
    """conv_id, messages, and of those user and assistant ones."""
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("user"), F.count_if(F.col("role") == "assistant").alias("assistant"))


def citation_usage(messages: DataFrame, shown: int = 3) -> DataFrame:
    """document_id, page (null: all pages), citations, messages, shown: how often each page and document is cited, and how often among the first `shown` of a message."""
    rows = messages.select("conv_id", "turn", F.posexplode("citations").alias("at", "c")).select("conv_id", "turn", "at", "c.document_id", "c.page")
    seen = rows.rollup("document_id", "page").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("conv_id", "turn").alias("messages"), F.count_if(F.col("at") < shown).alias("shown"))
    return seen.where("document_id is not null")


def messages_by_role(messages: DataFrame) -> DataFrame:
    """role, messages, characters."""
    return messages.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("characters"))


def last_message(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the last message."""
    return messages.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("m")).select("conv_id", "m.*")


def prompt_history(messages: DataFrame, n: int = 6) -> DataFrame:
    """conv_id, prompt: the last n messages as "User: ..." and "Assistant: ..." lines."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("text"))
    kept = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("prompt"))


def local_prompts(messages: DataFrame, settings: DataFrame | None = None, n: int = 6) -> DataFrame:
    """conv_id, prompt: an optional system and context part, the last n messages as "User: ..." and "Assistant: ..." and the begin of an answer, a blank line between.

    settings: conv_id, system, context; null and empty ones are left out. Conversations without messages have no prompt.
    """
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    kept = messages.withColumn("_last", last).where(F.col("_last") <= n).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    if settings is None:
        return kept.select("conv_id", F.array_join(F.concat("lines", F.array(F.lit("Assistant:"))), "\n\n").alias("prompt"))
    part = lambda c, head: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.array(F.concat(F.lit(head), c))).otherwise(F.array().cast("array<string>"))
    rows = kept.join(settings.select("conv_id", "system", "context"), "conv_id", "left")
    return rows.select("conv_id", F.array_join(F.concat(part("system", "System: "), part("context", "Context:\n"), "lines", F.array(F.lit("Assistant:"))), "\n\n").alias("prompt"))


def cloud_messages(messages: DataFrame, settings: DataFrame) -> DataFrame:
    """conv_id, seq (0-based), role, content: one system row (settings: conv_id, system) and then the stored messages by turn, their system rows left out.

    Conversations without settings begin with an empty system row.
    """
    heads = messages.select("conv_id").distinct().join(settings.select("conv_id", "system"), "conv_id", "left").select("conv_id", F.lit(0).alias("seq"), F.lit("system").alias("role"), F.coalesce("system", F.lit("")).alias("content"))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rest = messages.where("role is null or role <> 'system'").select("conv_id", seq.alias("seq"), "role", F.col("text").alias("content"))
    return heads.unionByName(rest)


def validate_chats(messages: DataFrame, most: int = 100, characters: int = 200_000) -> DataFrame:
    """conv_id, code: the first rule a conversation breaks, else ok."""
    facts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("role").isin("system", "user", "assistant"), F.lit(False))).alias("odd"), F.count_if(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0).alias("blank"), F.sum(F.length("text")).alias("size"))
    code = F.when(F.col("n") > most, "TOO_MANY_MESSAGES").when(F.col("odd") > 0, "INVALID_ROLE").when(F.col("blank") > 0, "EMPTY_MESSAGE").when(F.col("size") > characters, "TOO_LONG").otherwise("ok")
    return facts.select("conv_id", code.alias("code"))


def validate_chat_options(requests: DataFrame) -> DataFrame:
    """request_id, code of (request_id, model, temperature, max_tokens): INVALID_MODEL, INVALID_TEMPERATURE (0 to 2), INVALID_MAX_TOKENS (1 to 32,768) or ok; null temperature and max_tokens take defaults."""
    code = F.when(~F.coalesce(F.col("model").rlike(MODEL_ID), F.lit(False)), "INVALID_MODEL").when(~F.coalesce(F.col("temperature").between(0, 2), F.lit(True)), "INVALID_TEMPERATURE").when(~F.coalesce(F.col("max_tokens").between(1, 32_768), F.lit(True)), "INVALID_MAX_TOKENS").otherwise("ok")
    return requests.select("request_id", code.alias("code"))


def code_blocks(messages: DataFrame) -> DataFrame:
    """conv_id, turn, block, language (text where none), code of the fenced blocks."""
    pattern = r"(?s)```(\w*)\n?(.*?)```"
    rows = messages.select("conv_id", "turn", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("l"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("c"))).alias("block", "b"))
    return rows.select("conv_id", "turn", "block", F.when(F.col("b.l") == "", "text").otherwise(F.col("b.l")).alias("language"), F.trim("b.c").alias("code"))
