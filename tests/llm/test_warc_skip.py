"""Unwanted records are gone past without being inflated; members of other writers are read all the same."""

import gzip
import io
import random

from quire.llm import warc as W


def test_inflated_bytes(tmp_path):
    r = random.Random(1)
    payloads = [bytes(r.randrange(97, 123) for _ in range(r.choice([10, 3000, 200_000]))) for _ in range(200)]
    raw = [W.record(i, f"u{i}", p, "response", None, "2024-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    told, plain = b"".join(map(W.member, raw)), b"".join(gzip.compress(x) for x in raw)
    assert gzip.decompress(told) == b"".join(raw)
    for data, mixed in ((told, False), (plain, True), (b"".join(W.member(x) if i % 3 else gzip.compress(x) for i, x in enumerate(raw)), True)):
        members = W._Members(io.BytesIO(data), 0)
        found = list(W.records(members, len(data), [("source_id", "in", (77, 150))], True))
        assert [(x["source_id"], x["payload"]) for x in found] == [(i, payloads[i]) for i in (77, 150)]
        if not mixed:
            # Heads of all, payloads of two.
            assert members.inflated < 200 * 4200 + len(payloads[77]) + len(payloads[150]) and members.inflated < len(b"".join(raw)) / 5
    members = W._Members(io.BytesIO(told), 0)
    assert len(list(W.records(members, len(told), [], False))) == 200 and members.inflated <= 200 * 4200
