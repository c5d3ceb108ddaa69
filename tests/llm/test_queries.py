"""The registered queries over files with null, empty, repeated, clashing and no rows, against brute force."""

import base64
import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from quire.llm import registry

Q = registry.queries()
WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "ra", "lis")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    docs = [(i, prose(i, 90)) for i in range(30)]
    docs += [(30, docs[1][1]), (2, docs[2][1]), (2, "another text of id two"), (31, None), (32, ""), (None, docs[3][1]), (33, "mail a.b@c.de or 10.0.0.1, +49 170 123456 and 4111 1111 1111 1111"), (34, "<|endoftext|> x"), (35, prose(7, 6000)), (36, " \t\n ")]
    return docs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = corpus()
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    # Columns with names that the operators make themselves.
    save([(d, t, "en", "s", len(t or ""), 7, "x", "y") for d, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, length int, shard string, bands string", "documents")
    save([(i, int(i % 3 > 0), int(i % 4 == 0), "z") for i in range(30)] + [(1, None, 1), (None, 1, 1)][:0], "doc_id bigint, quality int, toxic int, p string", "labels")
    save([(1, docs[5][1][:60], 3), (2, None, 3), (3, "", 3)], "item_id bigint, text string, doc_id int", "benchmark")
    r = random.Random(3)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(0, 300, 3)] + [(1000, None), (1001, [None] * 6), (1002, [1e300] * 6), (150, [0.5] * 6)]
    save([(i, v, 1, "q") for i, v in vectors], "vec_id bigint, embedding array<double>, label int, score string", "embeddings")
    pages = [(1, "u", "<article><p>same body here.</p></article>"), (2, "u", "<article><p>same body here.</p></article>"), (2, "v", None), (3, None, ""), (4, "w", "<nav>m</nav><p>é text 😀.</p>")]
    save([(i, u, h, "k", "t") for i, u, h in pages], "page_id bigint, url string, html string, payload_digest string, text string", "pages")
    return at


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", list(Q))
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).count() == 0


def rows(spark, folder, name, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in Q[name](spark, folder).collect())


def test_op2(spark, folder):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect() if r["embedding"] and None not in r["embedding"] and r["vec_id"] != 150 and abs(r["embedding"][0]) < 1e100}
    found = Q["op2_knn"](spark, folder).where("query_id <> 150").collect()
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in vectors.items()}
    doubled = [r for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id = 150").collect()]
    v[150] = min([int(np.floor(256 * x)) for x in r["embedding"]] for r in doubled)
    expected = set()
    for q in v:
        if q % 50 == 0 and q != 150:
            best = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q)[:5]
            expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in found} == expected


def test_op4_chain(spark, folder):
    """The chain by plain loops: out-of-fold log-odds of quality feed the model of toxic."""
    from quire.llm import toxicity as X

    docs = {d: t for d, t in corpus() if d is not None and d < 30 and not (d == 2 and t.startswith("another"))}
    chain = X.fit_chain(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.read.parquet(f"{folder}/labels.parquet"))
    ids = sorted(docs)
    y = {"quality": [int(i % 3 > 0) for i in ids], "toxic": [int(i % 4 == 0) for i in ids]}
    found = {i: set(X.features(docs[i]).tolist()) for i in ids}
    chosen = set()
    for c in y:
        score = {}
        for f in set().union(*found.values()):
            df, hit = sum(f in found[i] for i in ids), sum(v for i, v in zip(ids, y[c]) if f in found[i])
            if df >= 3:
                score[f] = (hit * len(ids) - df * sum(y[c])) ** 2 / (df * (len(ids) + 1 - df))
        chosen |= set(sorted(score, key=lambda f: (-score[f], f))[: X.FEATURES])
    assert set(chain.chosen) == chosen
    at = [np.array(sorted(chain.chosen[f] for f in found[i] if f in chain.chosen), np.int64) for i in ids]
    fold = [xxhash.xxh32_intdigest(str(i)) % X.FOLDS for i in ids]
    held = np.zeros(len(ids))
    for k in range(X.FOLDS):
        inside = [n for n in range(len(ids)) if fold[n] != k]
        w = X.fit_linear([at[n] for n in inside], np.zeros((len(inside), 0)), np.array([y["quality"][n] for n in inside], float), len(chosen))
        for n in range(len(ids)):
            if fold[n] == k:
                held[n] = w[at[n]].sum() + w[-1]
    w = X.fit_linear(at, held[:, None], np.array(y["toxic"], float), len(chosen))
    assert np.allclose(w, chain.weights[1])
    plain = X.fit_linear(at, np.zeros((len(ids), 0)), np.array(y["quality"], float), len(chosen))
    for n, row in enumerate(chain.log_odds(at)):
        first = plain[at[n]].sum() + plain[-1]
        assert np.allclose(row, [first, w[at[n]].sum() + w[-2] * first + w[-1]])


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def test_op5(spark, folder):
    found = Q["op5_pack"](spark, folder).collect()
    expected = collections.Counter()
    for d, t in corpus():
        ids = ids_of(t)
        at, step, k = 0, len(ids) % 2048 or 2048, 0
        while at < len(ids):
            part = ids[at : at + step]
            expected[(d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
            at, step, k = at + step, 2048, k + 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    places = collections.defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 2048
    # The bound by the sum of lengths, which few pieces can't always reach.
    assert len(places) <= -(-sum(r["length"] for r in found) // 2048) + 1


def test_op6(spark, folder):
    def mark(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    docs = [(d, mark(t)) for d, t in corpus()]
    group = list(range(len(docs)))
    for _ in docs:
        for i, (_, a) in enumerate(docs):
            for j, (_, b) in enumerate(docs[:i]):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((d for (d, _), x in zip(docs, group) if x == g and d is not None), default=None) for g in group}
    assert rows(spark, folder, "op6_simhash", "doc_id", "fingerprint", "component_id") == collections.Counter((d, f"{p:016x}", least[g]) for (d, p), g in zip(docs, group))


def test_op7(spark, folder):
    text = {"<article><p>same body here.</p></article>": "same body here.", "<nav>m</nav><p>é text 😀.</p>": "é text 😀."}
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()
    assert rows(spark, folder, "op7_html", "page_id", "url", "text", "n_chars") == collections.Counter((i, u, text.get(h, ""), len(text.get(h, ""))) for i, u, h in pages)


def test_op8(spark, folder):
    line = "mail a.b@c.de or 10.0.0.1, +49 170 123456 and 4111 1111 1111 1111"
    spans = {line: "email:5:13,ip:17:25,card:46:65,phone:27:41"}
    count = {line: (1, 1, 1, 1)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = collections.Counter((d, *count.get(t, (0,) * 4), sha(spans.get(t, "")), spans.get(t, "")) for d, t in corpus())
    assert rows(spark, folder, "op8_private", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == expected


def test_op9(spark, folder):
    found = Q["op9_matrices"](spark, folder)
    assert found.groupBy().sum("length").first()[0] == sum(len(ids_of(t)) for _, t in corpus())


def test_op10(spark, folder):
    pages = [(i, (h or "").encode()) for i, _, h in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    last = {h: max(i for i, x in pages if x == h) for _, h in pages}
    expected = collections.Counter((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), *(("response", None) if i == last[h] else ("revisit", last[h]))) for i, h in pages)
    assert rows(spark, folder, "op10_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected


def test_long_text_goes_in_pieces(spark):
    from pyspark.sql import functions as F

    from quire.llm import private as P

    r = random.Random(4)
    parts = ["a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "+49 170 123456", "plain words here", "x.\ny", "12 34"]
    text = " ".join(r.choice(parts) for _ in range(9000))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short a@b.cc")], "doc_id bigint, text string")
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, value):
        d = re.sub("[^0-9]", "", value)
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "phone": 8 <= len(d) <= 15}[kind]

    listed = lambda t: ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t) if good(k, m[0]))
    found = P.private_spans(docs).select("doc_id", P.listed(F.col("base"))).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter([(1, listed(text)), (1, listed(text)), (None, listed(text)), (2, listed("short a@b.cc"))])
    spans = sorted((m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if good(k, m[0]))
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    plain = "".join([*out, text[at:]])
    kinds = list(patterns)
    table = spark.createDataFrame([(text, [(kinds.index(k), a, b) for a, b, k in spans])], "text string, spans array<struct<kind:int,start:bigint,stop:bigint>>")
    assert table.select(P.masked(F.col("text"), F.col("spans"))).first()[0] == plain
