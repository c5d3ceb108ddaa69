"""Jobs, undo logs and chat answers as streams with state and timers by key (transformWithState).

State lives in RocksDB, is written with each micro-batch and found again by a query that starts anew on the same
checkpoint; a stream may also begin from the state that a batch table gives. A key's rows of one micro-batch are put in
order in memory, so a source's trigger limit bounds them; what is kept between micro-batches is stated at each
operator. `run` starts a stream with the state store it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from quire.functions.folds import fold_rows
from quire.operators.history import TERMINAL, replayer

from .jobs import TTL_SECONDS, chat_lines

_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB_ROWS = "job_id bigint, event_id bigint, status string, ms bigint, began bigint, outcome string"
REPLAY_ROWS = "document_id bigint, seq bigint, action string, applied boolean, entries int, position int, undo int, redo int"
CHAT_ROWS = "stream_id bigint, id string, content string, chunks int, finished boolean, finish_reason string"


def run(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Takes in what the stream's source holds now, and gives all rows given out so far: appended to path, read back. Called again, it goes on from the checkpoint."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, ROCKS)
    try:
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", path).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(path)


def _together(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(list(by), kind="stable")


class _Life:
    """A job's life: from its first event for ttl_ms; its first terminal state is final."""

    def __init__(self, ttl_ms: int, began: int | None = None, ended: bool = False):
        self.ttl_ms, self.began, self.ended = ttl_ms, began, ended

    def take(self, at: int, status: str) -> tuple[str, int | None]:
        """The outcome of an event, and when the life before it ran out unfinished, if it did: an event after the end of a life begins a new one."""
        ran_out = None
        if self.began is not None and at >= self.began + self.ttl_ms:
            ran_out = None if self.ended else self.began
            self.began, self.ended = None, False
        if self.began is None:
            self.began = at
        outcome = "rejected" if self.ended else "accepted"
        self.ended = self.ended or status in TERMINAL
        return outcome, ran_out


def _expired(job: int, began: int, ttl_ms: int) -> dict:
    return {"job_id": job, "event_id": None, "status": "expired", "ms": began + ttl_ms, "began": began, "outcome": "expired"}


def _job_frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["job_id", "event_id", "status", "ms", "began", "outcome"])
    return out.astype({"job_id": "int64", "event_id": "Int64", "ms": "int64", "began": "int64"})


class _Jobs(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "began bigint, ended boolean")

    def _keep(self, life: _Life, timers) -> None:
        self.job.update((life.began, life.ended))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(life.began + self.ttl_ms, timers.getCurrentWatermarkInMs() + 1))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self._keep(_Life(self.ttl_ms, int(first["began"]), bool(first["ended"])), timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        life = _Life(self.ttl_ms, *(self.job.get() if self.job.exists() else ()))
        out = []
        frame = _together(rows, "ms", "event_id")
        for event, status, at in zip(frame["event_id"].tolist(), frame["status"].tolist(), frame["ms"].tolist()):
            outcome, ran_out = life.take(at, status)
            if ran_out is not None:
                out.append(_expired(key[0], ran_out, self.ttl_ms))
            out.append({"job_id": key[0], "event_id": event, "status": status, "ms": at, "began": life.began, "outcome": outcome})
        self._keep(life, timerValues)
        yield _job_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            began, ended = self.job.get()
            self.job.clear()
            if not ended:
                yield _job_frame([_expired(key[0], began, self.ttl_ms)])

    def close(self) -> None:
        pass


def _job_rows(found: DataFrame) -> DataFrame:
    return found.select("job_id", "event_id", "status", F.timestamp_millis("ms").alias("at"), F.timestamp_millis("began").alias("began"), "outcome")


def job_states(events: DataFrame, initial: DataFrame | None = None, late: str = "1 hour", ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """job_id, event_id, status, at, began, outcome (accepted, rejected, expired) of the stream (job_id bigint, event_id bigint, status, updated_at).

    A job's life lasts ttl_seconds from its first event; its first terminal state is final, and later events of that life are rejected. Once
    the watermark or a later event has passed its end, an unfinished life is given out as expired (event_id null), and the next
    event begins a new one. initial: job_id, began (timestamp), ended of jobs that run already, one row each. Held by job: two values and a timer, until its life ends.
    """
    watched = events.select("job_id", "event_id", "status", F.col("updated_at").cast("timestamp").alias("updated_at")).withColumn("ms", F.unix_millis("updated_at")).withWatermark("updated_at", late)
    start = initial.select("job_id", F.unix_millis(F.col("began").cast("timestamp")).alias("began"), "ended").groupBy("job_id") if initial is not None else None
    return _job_rows(watched.groupBy("job_id").transformWithStateInPandas(_Jobs(ttl_seconds * 1000), _parse_datatype_string(JOB_ROWS), "Append", "EventTime", start))


def job_states_batch(events: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The same rows for a finished input: every unfinished life is given out as expired.

    A job's events stream through one task in order of time; only its life is held.
    """
    def start():
        life = _Life(ttl_seconds * 1000)

        def step(at: int, status: str) -> tuple[str, int]:
            outcome, _ = life.take(at, status)
            return outcome, life.began

        return step

    rows = events.select("job_id", "event_id", "status", F.unix_millis(F.col("updated_at").cast("timestamp")).alias("ms")).where("ms is not null")
    told = fold_rows(rows, ["job_id"], ["ms", "event_id"], ["ms", "status"], "outcome string, began bigint", start)
    open_ = told.groupBy("job_id", "began").agg(F.max((F.col("outcome").eqNullSafe("accepted") & F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))).cast("int")).alias("ended")).where("ended = 0")
    gone = open_.select("job_id", F.lit(None).cast("bigint").alias("event_id"), F.lit("expired").alias("status"), (F.col("began") + ttl_seconds * 1000).alias("ms"), "began", F.lit("expired").alias("outcome"))
    return _job_rows(told.select("job_id", "event_id", "status", "ms", "began", "outcome").unionByName(gone))


class _Replay(StatefulProcessor):
    def __init__(self, most: int, idle_ms: int):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", "held array<boolean>, index int")

    def _keep(self, held: list, index: int, newest: int, timers) -> None:
        self.log.update(([bool(x) for x in held], index))
        for old in list(self.handle.listTimers()):
            newest = max(newest, old - self.idle_ms)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(newest + self.idle_ms, timers.getCurrentWatermarkInMs() + 1))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self._keep(list(first["held"]), int(first["index"]), int(first["ms"]), timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, index = self.log.get() if self.log.exists() else ([], -1)
        act, now = replayer(self.most, list(held), index)
        frame = _together(rows, "seq")
        found = list(zip(*[act(a, c) for a, c in zip(frame["action"], frame["can_undo"])]))
        self._keep(*now(), int(frame["ms"].max()), timerValues)
        yield pd.DataFrame({"document_id": frame["document_id"], "seq": frame["seq"], "action": frame["action"]} | dict(zip(("applied", "entries", "position", "undo", "redo"), found)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        yield from ()

    def close(self) -> None:
        pass


def replay_states(events: DataFrame, initial: DataFrame | None = None, most: int = 50, late: str = "1 hour", idle_seconds: int = 30 * 86_400) -> DataFrame:
    """document_id, seq, action, applied, entries, position, undo, redo of the stream (document_id bigint, seq bigint, action, can_undo, at), as in the batch form; a document's events come in order of seq.

    initial: document_id, held (array of can_undo), index, at (of its last event) of logs that exist already. Held by document: at most `most` flags, a
    place and a timer. When the watermark is idle_seconds past its last event, a log is dropped; the document's next one begins anew.
    """
    rows = events.select("document_id", "seq", "action", "can_undo", F.col("at").cast("timestamp").alias("at")).withColumn("ms", F.unix_millis("at")).withWatermark("at", late).groupBy("document_id")
    start = initial.select("document_id", "held", "index", F.unix_millis(F.col("at").cast("timestamp")).alias("ms")).groupBy("document_id") if initial is not None else None
    return rows.transformWithStateInPandas(_Replay(most, idle_seconds * 1000), _parse_datatype_string(REPLAY_ROWS), "Append", "EventTime", start)


class _Chats(StatefulProcessor):
    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.front = handle.getValueState("front", "seq bigint")
        self.lines = handle.getMapState("lines", "seq bigint", "id string, delta string, reason string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        front = self.front.get()[0] if self.front.exists() else 0
        newest = 0
        for frame in rows:
            for seq, at, *line in zip(*[frame[c].tolist() for c in ("seq", "ms", "id", "delta", "finish_reason")]):
                newest = max(newest, at)
                if seq >= front:
                    self.lines.updateValue((seq,), tuple(None if x is None or x != x else x for x in line))
        out = []
        # The front is the first line that has not come yet; an answer is whole once the front has passed its finish mark.
        while self.lines.containsKey((front,)):
            id_, _, reason = self.lines.getValue((front,))
            if id_ is None:
                self.lines.removeKey((front,))
            elif reason is not None:
                out.append(self._answer(key[0], id_, front, reason))
            front += 1
        self.front.update((front,))
        for old in list(self.handle.listTimers()):
            newest = max(newest, old - self.quiet_ms)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(newest + self.quiet_ms, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield _chat_frame(out)

    def _answer(self, stream: int, id_: str, upto: int | None, reason: str | None) -> tuple:
        """An answer's lines, taken out of the state in order of seq."""
        mine = sorted((k[0], v[1]) for k, v in self.lines.iterator() if v[0] == id_ and (upto is None or k[0] <= upto))
        for seq, _ in mine:
            self.lines.removeKey((seq,))
        return stream, id_, "".join(d or "" for _, d in mine), len(mine), reason is not None, reason

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Behind a gap an answer may have its mark already.
        left = sorted((k[0], v[0], v[2]) for k, v in self.lines.iterator() if v[0] is not None)
        out = [self._answer(key[0], id_, seq, reason) for seq, id_, reason in left if reason is not None]
        out += [self._answer(key[0], id_, None, None) for id_ in dict.fromkeys(v[0] for _, v in sorted(self.lines.iterator()) if v[0] is not None)]
        self.lines.clear()
        self.front.clear()
        if out:
            yield _chat_frame(out)

    def close(self) -> None:
        pass


def _chat_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["stream_id", "id", "content", "chunks", "finished", "finish_reason"]).astype({"chunks": "int32"})


def chat_states(lines: DataFrame, late: str = "1 minute", quiet_seconds: int = 300) -> DataFrame:
    """stream_id, id, content, chunks, finished, finish_reason of server lines (stream_id bigint, seq bigint from 0, line, at) that come in any order.

    An answer is given out when all lines up to its finish mark have come, its deltas in order of seq, and dropped from the
    state; deltas of its id behind the mark begin another one. When the watermark is quiet_seconds past a stream's last line, what
    it still holds is given out, and its state goes. Repeated lines count once. Held by stream: the lines of answers not given out.
    """
    rows = chat_lines(lines.select("stream_id", "seq", "line", F.col("at").cast("timestamp").alias("at")), "at")
    watched = rows.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return watched.groupBy("stream_id").transformWithStateInPandas(_Chats(quiet_seconds * 1000), _parse_datatype_string(CHAT_ROWS), "Append", "EventTime")


def chat_answers(lines: DataFrame) -> DataFrame:
    """The same rows for a finished input (stream_id, seq, line)."""
    rows = chat_lines(lines).where("id is not null")
    # The part of a delta is the number of finish marks before it.
    before = F.count("finish_reason").over(Window.partitionBy("stream_id", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda p: p["delta"]), "")
    reason = F.max("finish_reason")
    out = rows.withColumn("part", before).groupBy("stream_id", "id", "part").agg(text.alias("content"), F.count(F.lit(1)).cast("int").alias("chunks"), reason.alias("finish_reason"))
    return out.select("stream_id", "id", "content", "chunks", F.col("finish_reason").isNotNull().alias("finished"), "finish_reason")
