"""The pipeline's stages on a small corpus with planted cases."""

import functools
import random

import corpus_pipeline as P
from quire.llm.tokens import token_pieces


def test_stages(spark, tmp_path):
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in "aeiou" for c in ("lo", "rin", "st", "mpe")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(30)
    docs = [(i, prose(r.randint(60, 180)) + (" nastyword " if i % 4 == 0 else " ") + prose(20)) for i in range(240)]
    docs += [(500, docs[1][1]), (501, docs[1][1]), (502, prose(40) + " " + passage + " " + prose(40)), (503, "write to some.one@example.com or +1 555 123 4567 " + prose(60)), (504, None)]
    rows = [(d, t, "en", f"s{d % 3}", len(t or ""), "extra") for d, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d in range(0, 240) if d % 3], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert now.columns == columns
            seen[name] = {x["doc_id"]: x["text"] for x in now.collect()}
    toxic = {d for d in range(240) if d % 4 == 0}
    # The chain has only 160 labelled rows here: nearly all rows are told apart, and the later stages are judged on what it kept.
    kept = set(seen["toxicity"])
    assert len(kept ^ ({d for d, _ in docs} - toxic)) <= 12
    assert kept >= {1, 500, 501, 503, 504}
    assert set(seen["near_copies"]) == kept - {500, 501}
    assert set(seen["decontamination"]) == kept - {500, 501, 502}
    assert set(seen["private"]) == set(seen["decontamination"])
    assert seen["private"][503].startswith("write to [EMAIL] or [PHONE] ")
    assert all(seen["private"][d] == t for d, t in docs if d in seen["private"] and d != 503)
    texts = spark.createDataFrame(list(seen["private"].items()), "doc_id bigint, text string")
    want = {(x["doc_id"], x["piece"], x["start"], x["length"]) for x in token_pieces(texts).collect()}
    assert {(x["doc_id"], x["piece"], x["start"], x["length"]) for x in now.collect()} == want


def test_near_copies(spark):
    r = random.Random(8)
    prose = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    grams = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    grams = functools.cache(grams)
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.8
    rows = []
    for d in range(0, 200, 10):
        base = prose(r.randint(80, 400))
        rows.append((d, " ".join(base)))
        for k in range(1, 5):  # from near copies to far ones
            other = list(base)
            for _ in range(k * len(base) // 60):
                other[r.randrange(len(other))] = "changed"
            rows.append((d + k, " ".join(other)))
    base = prose(300)
    rows += [(1000 + i, " ".join(base[:i] + ["swapped"] + base[i + 1 :])) for i in range(100)]  # one large group
    rows += [(7, " ".join(prose(50))), (7, " ".join(prose(50))), (7, rows[0][1]), (2000, rows[0][1]), (None, rows[0][1]), (None, "alone without an id"), (3000, None), (3001, ""), (3002, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for part in (256, 40):
        keys = {(x["text_key"], x["least_id"]) for x in P.keep_distinct(docs, part).collect()}
        kept = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "") for x in P.drop_near_copies(spark, docs, "").collect())
        assert len(keys) == len(kept)
        texts = [t for _, _, t in kept if t.strip()]
        assert not any(alike(a, b) for i, a in enumerate(texts) for b in texts[:i])
        # What goes is a near copy of an earlier text.
        assert all(t in texts or any(alike(t, u) for e, u in rows if e is not None and u and u != t and e < d) or t == rows[0][1] for d, t in rows if d is not None and t and t.strip())
        assert sum(1000 <= d < 1100 for _, d, _ in kept) == 1 and [k for k in kept if k[1] >= 3000] == [(False, 3000, "")]
        assert sum(d == 7 for _, d, _ in kept) == 2 and (True, 0, "alone without an id") in kept and kept[0][:2] == (False, 0)


def test_unlike_texts_of_one_band(spark, monkeypatch):
    """Texts that share a band but are no near copies don't halve: parts meet parts, and nothing is missed."""
    from quire.llm import near_copies as N

    monkeypatch.setattr(N, "bands", lambda hashes: [1])
    r = random.Random(3)
    base = {i: [f"w{r.randrange(10**6)}" for _ in range(40)] for i in range(90)}
    rows = [(i, " ".join(w)) for i, w in base.items()] + [(100 + i, " ".join([*base[i], "more"])) for i in range(0, 90, 3)] + [(None, " ".join([*base[1], "again"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = [x["doc_id"] for x in P.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == list(range(90))


def test_stages_take_empty_tables_and_clashing_names(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic string, spans string, text_key string, bands string, n int, hit_key string, length int"
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "ten words that a test document will hold as they stand")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "some text to keep, mail a.b@c.de", "en", "s", 30, "t", "s", "k", "b", 1, "h", 2), (2, None, "en", "s", 0, "t", "s", "k", "b", 1, "h", 2), (2, None, "en", "s", 0, "t", "s", "k", "b", 1, "h", 2), (None, "x " * 50_000, "en", "s", 9, "t", "s", "k", "b", 1, "h", 2)]
    for k, given in enumerate((rows, [])):
        now = spark.createDataFrame(given, schema)
        now.write.parquet(f"{tmp_path}/{k}/in.parquet")
        now = spark.read.parquet(f"{tmp_path}/{k}/in.parquet")
        for n, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, now, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{k}/{n}.parquet")
            now = spark.read.parquet(f"{tmp_path}/{k}/{n}.parquet")
            if n < 4:
                assert now.columns == [c.split()[0] for c in schema.split(", ")] and now.count() == (len(given) if n == 0 else min(3, len(given)))
        assert now.count() == 0 if not given else now.agg({"length": "sum"}).first()[0] > 50_000


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """Near copies that share no band are found by the links of their fingerprints; linked texts that are no near copies stay."""
    from quire.llm import near_copies as N
    from quire.llm.simhash import fingerprint

    monkeypatch.setattr(N, "bands", lambda hashes: [hash(hashes.tobytes())])
    r = random.Random(4)
    base = {i: [f"w{r.randrange(10**6)}" for _ in range(300)] for i in range(30)}
    rows = [(i, " ".join(w)) for i, w in base.items()] + [(100 + i, " ".join([*w, "more"])) for i, w in base.items()]
    # One shingle makes up most of both texts and so all bits, yet their sets of shingles differ.
    rows += [(200, " ".join(["same"] * 50)), (201, " ".join(["same"] * 50 + ["other"] * 8))]
    away = [(fingerprint(rows[i][1]) ^ fingerprint(rows[30 + i][1])).bit_count() for i in range(30)]
    near = [i for i in range(30) if away[i] <= N.RADIUS]
    assert len(near) > 5 and (fingerprint(rows[60][1]) ^ fingerprint(rows[61][1])).bit_count() <= N.RADIUS
    kept = {x["doc_id"] for x in P.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "").collect()}
    assert kept == {d for d, _ in rows} - {100 + i for i in near}
