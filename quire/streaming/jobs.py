"""Job, request and undo streams with state by key, and running counts.

Each operator has a batch form beside it that gives the same rows for a finished input. State is kept by key and dropped by
timers; a stream's watermark bounds how late an event may come. Sources are any streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.functions.shared import shared_folder
from quire.operators.history import TERMINAL, replayer
from quire.operators.manifest import window_counter

TTL_SECONDS = 1800
#: Groups of jobs that share a state: a call and its frames cost more than the rows of one job.
JOB_GROUPS = 1024
#: The moment of what has none.
_NEVER = np.iinfo(np.int64).max


def _ordered(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's events of one micro-batch, in order. Most keys have one frame of few rows, where pandas costs more than the rows."""
    held = list(frames)
    rows = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
    return rows if len(rows) < 2 else rows.sort_values(list(by), kind="stable")


class _Lives:
    """The jobs of a group: number, end of life, timer, and whether a terminal state was seen, in order of number."""

    KINDS = {"job": np.int64, "ends": np.int64, "timer": np.int64, "ended": np.bool_}
    SCHEMA = ", ".join(f"{c} binary" for c in KINDS)

    def __init__(self, held: tuple | None = None):
        self.columns = [np.frombuffer(x, t) for x, t in zip(held or (b"",) * 4, self.KINDS.values())]

    def state(self) -> tuple:
        return tuple(x.tobytes() for x in self.columns)

    def take(self, job: np.ndarray, at: np.ndarray, final: np.ndarray, ttl_ms: int, watermark: int) -> np.ndarray:
        """Which events, in order of job and time, come after a terminal state of their job; the timers of these jobs begin anew."""
        own, first = np.unique(job, return_index=True)
        after = np.append(first[1:], len(job))
        known, ends, timer, ended = self.columns
        place = np.searchsorted(known, own)
        old = np.zeros(len(own), bool)
        old[place < len(known)] = known[place[place < len(known)]] == own[place < len(known)]
        began = at[first]
        my_ends, my_ended = np.where(began == _NEVER, _NEVER, np.minimum(began, _NEVER - ttl_ms) + ttl_ms), np.zeros(len(own), bool)
        held = ends[place[old]]
        my_ends[old], my_ended[old] = np.where(held == _NEVER, my_ends[old], held), ended[place[old]]
        counted = np.concatenate(([0], np.cumsum(final)))
        late = np.repeat(my_ended, after - first) | (counted[:-1] > np.repeat(counted[first], after - first))
        others = np.ones(len(known), bool)
        others[place[old]] = False
        mine = own, my_ends, np.maximum(my_ends, watermark + 1), my_ended | (counted[after] > counted[first])
        both = [np.concatenate((x[others], y)) for x, y in zip(self.columns, mine)]
        order = np.argsort(both[0], kind="stable")
        self.columns = [x[order] for x in both]
        return late

    def drop(self, watermark: int) -> tuple[np.ndarray, np.ndarray]:
        """The jobs whose timers the watermark has passed go; (number, end) of the unfinished ones."""
        job, ends, timer, ended = self.columns
        gone = timer < watermark
        self.columns = [x[~gone] for x in self.columns]
        return job[gone & ~ended], ends[gone & ~ended]


def job_lifecycle(events: DataFrame, late: str = "1 hour", ttl_seconds: int = TTL_SECONDS, groups: int = JOB_GROUPS) -> DataFrame:
    """job_id, event_id, status, at, outcome (accepted, rejected, expired) of (job_id bigint, event_id bigint, status, updated_at).

    A job's first terminal state is final: later events are rejected conflicts. A job lives for ttl_seconds from its first event; when the
    watermark has passed that, an unfinished one is given out as expired (event_id null), and its state goes, so events that come after begin a new job.
    Events of a micro-batch are taken in order of time and event_id, those without a time last; a job without any time does not expire.
    Jobs are dealt to groups by a hash of job_id, each of which keeps its jobs' lives as arrays; a checkpoint holds for one number of groups.
    """
    group = F.when(F.col("job_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(groups)).cast("int"))
    at = F.col("updated_at").cast("timestamp")
    # Frames would turn whole numbers with nulls among them into floats.
    watched = events.select(group.alias("group"), F.coalesce("job_id", F.lit(0)).alias("job_id"), F.coalesce("event_id", F.lit(0)).alias("event_id"), F.col("event_id").isNull().alias("no_event"), "status", at.alias("updated_at"))
    watched = watched.withColumn("ms", F.coalesce(F.unix_millis("updated_at"), F.lit(int(_NEVER)))).withWatermark("updated_at", late)

    def step(key, frames, state: GroupState) -> Iterator[pd.DataFrame]:
        lives, watermark, out = _Lives(state.get if state.exists else None), state.getCurrentWatermarkMs(), []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)
            rows = rows.take(np.lexsort([rows[c].to_numpy() for c in ("event_id", "no_event", "ms", "job_id")]))
            job, at = rows["job_id"].to_numpy(), rows["ms"].to_numpy()
            rejected = lives.take(job, at, rows["status"].isin(TERMINAL).to_numpy(), ttl_seconds * 1000, watermark)
            out.append(pd.DataFrame({"job_id": job, "event_id": pd.arrays.IntegerArray(rows["event_id"].to_numpy(), rows["no_event"].to_numpy()), "status": rows["status"].array, "ms": pd.arrays.IntegerArray(at, at == _NEVER), "outcome": np.where(rejected, "rejected", "accepted")}))
        job, ends = lives.drop(watermark)
        if len(job):
            out.append(pd.DataFrame({"job_id": job, "event_id": pd.array([None] * len(job), "Int64"), "status": "expired", "ms": ends, "outcome": "expired"}))
        timer = lives.columns[2]
        if len(timer):
            state.update(lives.state())
            if timer.min() < _NEVER:
                state.setTimeoutTimestamp(int(timer.min()))
        elif state.exists:
            state.remove()
        for rows in out:
            yield rows.assign(no_job=key[0] < 0)

    schema = "job_id bigint, event_id bigint, status string, ms bigint, outcome string, no_job boolean"
    found = watched.groupBy("group").applyInPandasWithState(step, schema, _Lives.SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.when(~F.col("no_job"), F.col("job_id")).alias("job_id"), "event_id", "status", F.timestamp_millis("ms").alias("at"), "outcome")


def expire_jobs(events: DataFrame, now, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """job_id, status, expires_at, error_code of all jobs of a finished input at a moment: unfinished ones are expired once ttl_seconds have passed since their first event."""
    events = events.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    order = F.struct("updated_at", "event_id")
    ended = F.min(F.when(F.col("status").isin(*TERMINAL), F.struct("updated_at", "event_id", "status")))["status"]
    jobs = events.groupBy("job_id").agg(F.min("updated_at").alias("created"), F.max_by("status", order).alias("last"), ended.alias("final"))
    expires = F.timestamp_micros(F.unix_micros("created") + ttl_seconds * 1_000_000)
    gone = F.col("final").isNull() & (expires <= F.lit(now))
    return jobs.select("job_id", F.when(gone, "expired").otherwise(F.coalesce("final", "last")).alias("status"), expires.alias("expires_at"), F.when(gone, "JOB_EXPIRED").alias("error_code"))


def rate_limit(requests: DataFrame, limit: int = 30, window_ms: int = 60_000, late: str = "10 minutes") -> DataFrame:
    """client, request_id, allowed, retry_after of (client bigint, request_id bigint, ts): a client's window opens at its first request and holds limit requests.

    The window is the state; it goes when the watermark has passed its end. Requests of a micro-batch are taken in order of time.
    """
    watched = requests.select("client", "request_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)

    def step(key, frames, state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(frames, "ms", "request_id")
        allow, held = window_counter(limit, window_ms, *(state.get if state.exists else (None, 0)))
        found = [allow(at) for at in rows["ms"].tolist()]
        reset, count = held()
        state.update((reset, count))
        state.setTimeoutTimestamp(max(reset, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": rows["client"], "request_id": rows["request_id"], "allowed": [a for a, _ in found], "retry_after": [r for _, r in found]})

    return watched.groupBy("client").applyInPandasWithState(step, "client bigint, request_id bigint, allowed boolean, retry_after bigint", "reset bigint, count int", "append", GroupStateTimeout.EventTimeTimeout)


def history_replay(events: DataFrame, most: int = 50) -> DataFrame:
    """document_id, seq, action, applied, entries, position, undo, redo of (document_id bigint, seq bigint, action, can_undo), as in the batch form; a document's events come in order of seq."""

    def step(key, frames, state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(frames, "seq")
        held, index = state.get if state.exists else ([], -1)
        act, now = replayer(most, list(held), index)
        found = list(zip(*[act(a, c) for a, c in zip(rows["action"], rows["can_undo"])]))
        held, index = now()
        state.update((held, index))
        yield pd.DataFrame({"document_id": rows["document_id"], "seq": rows["seq"], "action": rows["action"]} | dict(zip(("applied", "entries", "position", "undo", "redo"), found)))

    schema = "document_id bigint, seq bigint, action string, applied boolean, entries int, position int, undo int, redo int"
    return events.select("document_id", "seq", "action", "can_undo").groupBy("document_id").applyInPandasWithState(step, schema, "held array<boolean>, index int", "append", GroupStateTimeout.NoTimeout)


def request_counts(requests: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, kind, requests in tumbling or, with slide, sliding windows of (ts, kind); a stream gives a window out when the watermark has passed it."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window.alias("w"), "kind").agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(F.col("w.start").alias("start"), "kind", "requests")


def session_counts(requests: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """client, start, end, requests: a client's requests (ts, client) less than gap apart are a session."""
    counts = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "client").agg(F.count(F.lit(1)).alias("requests"))
    return counts.select("client", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def chat_lines(lines: DataFrame, *more: str) -> DataFrame:
    """stream_id, seq, the columns more, id, delta, finish_reason of all server lines (stream_id, seq, line): those that say nothing, such as blank lines, other fields, the end mark and unreadable data, have a null id."""
    data = F.regexp_extract(F.trim("line"), r"(?s)\Adata: (.*)\z", 1)
    known = F.when((data != "") & (data != "[DONE]"), data)
    rows = lines.select("stream_id", "seq", *more, F.from_json(known, "id string, choices array<struct<delta:struct<content:string>,finish_reason:string>>").alias("j"))
    first = F.get("j.choices", F.lit(0))
    delta, reason = F.coalesce(first["delta"]["content"], F.lit("")), first["finish_reason"]
    says = (delta != "") | reason.isNotNull()
    return rows.select("stream_id", "seq", *more, F.when(says, F.coalesce(F.col("j.id"), F.lit(""))).alias("id"), F.when(says, delta).alias("delta"), reason.alias("finish_reason"))


def chat_deltas(lines: DataFrame) -> DataFrame:
    """stream_id, seq, id, delta, finish_reason of server lines (stream_id, seq, line): blank lines, other fields, the end mark and unreadable data are skipped.

    Stateless: for streams and finished inputs alike.
    """
    data = F.regexp_extract(F.trim("line"), r"(?s)\Adata: (.*)\z", 1)
    rows = lines.select("stream_id", "seq", data.alias("data")).where("data <> '' and data <> '[DONE]'").withColumn("j", F.from_json("data", "id string, choices array<struct<delta:struct<content:string>,finish_reason:string>>"))
    first = F.get("j.choices", F.lit(0))
    rows = rows.select("stream_id", "seq", F.col("j.id").alias("id"), F.coalesce(first["delta"]["content"], F.lit("")).alias("delta"), first["finish_reason"].alias("finish_reason"))
    return rows.where("delta <> '' or finish_reason is not null")


def assemble_chat_stream(lines: DataFrame) -> DataFrame:
    """id, content, chunks, finished, finish_reason: the deltas of each id in order of seq."""
    parts = chat_deltas(lines)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda p: p["delta"]), "")
    reason = F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq")))
    return parts.groupBy("id").agg(text.alias("content"), F.count(F.lit(1)).alias("chunks"), F.count("finish_reason").alias("ends"), reason.alias("finish_reason")).select("id", "content", "chunks", (F.col("ends") > 0).alias("finished"), "finish_reason")


def type_counts(rows: DataFrame, kind: str) -> DataFrame:
    """kind, n: running counts by the column kind, for update or complete mode."""
    return rows.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def replayed(stream: DataFrame, label: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """All rows that a stream gives out for what its source holds now: an availableNow run into the shared folder, read back.

    mode: append, or update, where rows of later micro-batches stay beside earlier ones with their batch number in _batch. partitions: of the state.
    """
    spark = stream.sparkSession
    out, marks = shared_folder(spark, label), shared_folder(spark, f"{label}-progress")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", marks).outputMode(mode)
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(lambda rows, n: rows.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out)).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    schema = stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    return spark.read.schema(schema).parquet(out)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of an update-mode replay the last row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n", "_batch")
