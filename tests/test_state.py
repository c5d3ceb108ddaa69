"""Streams with state: several micro-batches with a restart between them against the batch forms."""

import collections
import datetime
import random

from pyspark.sql import functions as F

from quire.operators import history as K
from quire.streaming import jobs as M
from quire.streaming import state as T

START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


class Source:
    """A folder of files, one a micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/{self.n:03}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(self.path)


def rows(df, *columns):
    return collections.Counter(map(tuple, (df.select(*columns) if columns else df).collect()))


def test_jobs_with_a_restart(spark, tmp_path):
    r = random.Random(4)
    schema = "job_id bigint, event_id bigint, status string, updated_at timestamp"
    events = [(r.randint(1, 6), i, r.choice(["queued", "running", "running", "succeeded", "failed"]), at(3 * i)) for i in range(90)]
    source = Source(spark, tmp_path / "in", schema)
    where = f"{tmp_path}/out", f"{tmp_path}/marks"
    for k in range(0, 45, 15):
        source.put(events[k : k + 15])
    T.run(T.job_states(source.stream(), None, "1 minute", 1800), *where)
    for k in range(45, 90, 15):
        # Within a file order does not matter.
        source.put(r.sample(events[k : k + 15], 15))
    # The same query built anew goes on from the checkpoint.
    found = T.run(T.job_states(source.stream(), None, "1 minute", 1800), *where)
    batch = T.job_states_batch(spark.createDataFrame(events, schema), 1800)
    told = "outcome <> 'expired'"
    assert rows(found.where(told)) == rows(batch.where(told))
    # Lives that ended before the last watermark have expired in both.
    closed = rows(batch.where("outcome = 'expired'").where(F.col("at") < F.lit(at(3 * 75 - 1))))
    assert not closed - rows(found.where("outcome = 'expired'")) and not rows(found.where("outcome = 'expired'")) - rows(batch)
    assert closed


def test_jobs_from_a_table(spark, tmp_path):
    schema = "job_id bigint, event_id bigint, status string, updated_at timestamp"
    source = Source(spark, tmp_path / "in", schema)
    source.put([(1, 1, "running", at(5)), (2, 2, "running", at(6)), (3, 3, "queued", at(7)), (4, 9, "queued", at(50))])
    source.put([(9, 4, "queued", at(300))])
    source.put([(9, 5, "succeeded", at(301))])
    start = spark.createDataFrame([(1, at(0), True), (2, at(0), False), (4, at(0), True)], "job_id bigint, began timestamp, ended boolean")
    found = T.run(T.job_states(source.stream(), start, "1 minute", 1800), f"{tmp_path}/out", f"{tmp_path}/marks")
    got = {(x["job_id"], x["event_id"]): (x["outcome"], x["began"]) for x in found.collect()}
    assert got[1, 1] == ("rejected", at(0)) and got[2, 2] == ("accepted", at(0)) and got[3, 3] == ("accepted", at(7))
    # After the end of its life an ended job begins a new one.
    assert got[4, 9] == ("accepted", at(50))
    assert got[2, None] == ("expired", at(0)) and got[3, None] == ("expired", at(7)) and (1, None) not in got


def test_replay_with_a_restart_and_from_a_table(spark, tmp_path):
    r = random.Random(8)
    schema = "document_id bigint, seq bigint, action string, can_undo boolean, at timestamp"
    events = [(r.randint(1, 4), i, r.choice(["add", "add", "undo", "redo"]), r.random() < 0.8, at(i)) for i in range(120)]
    source = Source(spark, tmp_path / "in", schema)
    where = f"{tmp_path}/out", f"{tmp_path}/marks"
    # What a batch run has seen of the first 40 events is where the stream begins.
    state = {}
    for d, _, action, can, _ in events[:40]:
        act, now = K.replayer(5, *state.get(d, ([], -1)))
        act(action, can)
        held, index = now()
        state[d] = list(held), index
    start = spark.createDataFrame([(d, h, i, at(39)) for d, (h, i) in state.items()], "document_id bigint, held array<boolean>, index int, at timestamp")
    source.put(events[40:60])
    source.put(events[60:80])
    T.run(T.replay_states(source.stream(), start, 5), *where)
    source.put(events[80:])
    found = T.run(T.replay_states(source.stream(), start, 5), *where)
    batch = K.history_replay(spark.createDataFrame(events, schema), 5).where("seq >= 40")
    assert rows(found, *found.columns) == rows(batch, *found.columns)


def test_idle_logs_are_dropped(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "document_id bigint, seq bigint, action string, can_undo boolean, at timestamp")
    for k, (doc, minutes) in enumerate([(1, 0), (2, 100), (2, 101), (1, 102)]):
        source.put([(doc, k, "add", True, at(minutes))])
    found = T.run(T.replay_states(source.stream(), None, 5, "1 minute", 3600), f"{tmp_path}/out", f"{tmp_path}/marks")
    assert {x["seq"]: x["entries"] for x in found.collect()} == {0: 1, 1: 1, 2: 2, 3: 1}


def test_chat_lines_out_of_order(spark, tmp_path):
    r = random.Random(2)
    say = lambda id_, text, reason=None: f'data: {{"id": "{id_}", "choices": [{{"delta": {{"content": "{text}"}}, "finish_reason": {f"{chr(34)}{reason}{chr(34)}" if reason else "null"}}}]}}'
    lines = []
    for stream in range(5):
        seq = 0
        for k in range(4):
            for w in range(r.randint(1, 9)):
                lines.append((stream, seq, say(f"m{stream}-{k % 3}", f"w{w} ")))
                if r.random() < 0.4:
                    seq += 1
                    lines.append((stream, seq, r.choice(["", ": ping", "data: {bad", "data: [DONE]", None])))
                seq += 1
            lines.append((stream, seq, say(f"m{stream}-{k % 3}", "", "stop")))
            seq += 1
    lines.append((7, 0, say("open", "never ended")))
    lines += [(8, 1, say("gap", "b", "length")), (8, 2, say("tail", "c"))]
    schema = "stream_id bigint, seq bigint, line string, at timestamp"
    mixed = r.sample(lines, len(lines)) + lines[:3]
    source = Source(spark, tmp_path / "in", schema)
    where = f"{tmp_path}/out", f"{tmp_path}/marks"
    cut = len(mixed) // 3
    for k in range(3):
        source.put([(*x, at(0)) for x in mixed[k * cut : (k + 1) * cut if k < 2 else None]])
        if k == 1:
            T.run(T.chat_states(source.stream()), *where)
    source.put([(9, 0, None, at(60))])
    source.put([(9, 1, None, at(61))])
    found = T.run(T.chat_states(source.stream()), *where)
    batch = T.chat_answers(spark.createDataFrame(lines, "stream_id bigint, seq bigint, line string"))
    assert rows(found, *found.columns) == rows(batch, *found.columns)
    assert (7, "open", "never ended", 1, False, None) in rows(found)


def test_jobs_share_a_state(spark, tmp_path):
    r = random.Random(11)
    big = 2**60 + 1
    at = datetime.datetime(2024, 1, 1)
    rows = [(r.choice([None, 1, 2, 3, big, big + 2]), r.choice([None, big + 2 * i]), r.choice(["queued", "running", None, "failed", "succeeded"] + ["running"] * 9), at + datetime.timedelta(seconds=r.randint(0, 900), microseconds=999)) for i in range(120)]
    schema = "job_id bigint, event_id bigint, status string, updated_at timestamp"
    parts = [rows[:50], rows[50:], [(9, 1, "queued", at + datetime.timedelta(hours=9))], [(8, 2, "queued", at + datetime.timedelta(hours=30))]]
    expected, ended, first = collections.Counter(), set(), {}
    for part in parts:
        for j, e, s, t in sorted(part, key=lambda x: (x[3], x[1] is None, x[1] or 0)):
            first.setdefault(j, t)
            expected[(j, e, s, t.replace(microsecond=0), "rejected" if j in ended else "accepted")] += 1
            ended |= {j} if s in ("failed", "succeeded") else set()
    for j in set(first) - ended - {8}:
        expected[(j, None, "expired", (first[j] + datetime.timedelta(hours=8)).replace(microsecond=0), "expired")] += 1
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/source/{n}")
    for groups in (1, 3):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/source")
        found = M.replayed(M.job_lifecycle(stream, "1 hour", 8 * 3600, groups), "jobs")
        assert collections.Counter(map(tuple, found.collect())) == expected
