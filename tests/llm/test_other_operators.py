"""Search, scoring, packing, extraction and archives against brute force or exact round trips."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import html_text as H
from quire.llm import knn as K
from quire.llm import packing as B
from quire.llm import token_matrix as M
from quire.llm import toxicity as X
from quire.llm import warc as W
from quire.llm.common import new_folder, pick
from quire.llm.tokens import Encoder, default_ranks, token_pieces


def test_top_k(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(200)]  # one hot vector
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, rows[0][1]), (704, [0.5]), rows[20]]
    vectors = K.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    plain = {}
    for i, x in rows:
        x = np.array(x, np.float32) if x and None not in x else None
        if i is not None and x is not None and np.isfinite(x).all():
            plain[i] = [math.floor(256 * float(v)) for v in x] + [0] * (8 - len(x))
    expected = set()
    for q in plain:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(plain[q], v)), i) for i, v in plain.items() if i != q)[:5]
            expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    for options in ({}, {"pivots": 4, "group_queries": 3, "block_rows": 50}):
        found = K.top_k(vectors, F.col("vec_id") % 20 == 0, 5, **options).collect()
        assert len(found) == len(expected) and {tuple(x) for x in found} == expected
    assert K.top_k(vectors.limit(0), F.lit(True)).count() == 0
    assert K.top_k(vectors.limit(1), F.lit(True)).count() == 0


def test_plan_is_whole_and_tight():
    r = random.Random(2)
    for _ in range(200):
        size = r.choice([10, 50, 2048])
        counts = collections.Counter()
        for _ in range(r.choice([1, 5, 50, 400])):
            counts[r.randint(1, size if r.random() < 0.5 else max(1, size // 5))] += r.choice([1, 1, 3, 40])
        got = collections.Counter()
        for n, holds in B.plan(dict(counts), size):
            assert n > 0 and sum(x * k for x, k in holds) <= size
            for x, k in holds:
                got[x] += n * k
        assert got == counts


def optimum(items, size):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [r - items[i] * (j == k) for j, r in enumerate(rooms)])
        go(i + 1, [*rooms, size - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    r = random.Random(6)
    for _ in range(150):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        counts = dict(collections.Counter(items))
        fixed = sum(n for n, _ in B._fixed(counts, 20))
        assert fixed + optimum(sorted(collections.Counter(counts).elements(), reverse=True), 20) == optimum(items, 20)


def documents():
    r = random.Random(1)
    texts = [" ".join(r.choice(["the", "lexicon,", "of\nword", "Überzug", "a", "12", "don't"]) for _ in range(r.choice([1, 30, 300, 4000]))) for _ in range(40)]
    return [*enumerate(texts), (50, None), (51, ""), (3, texts[3]), (None, "x"), (52, "  two  spaces \n\n end "), (53, "<|endoftext|> a　b")]


def test_pieces_and_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    docs = documents()
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, length int")
    pieces = token_pieces(table, 512).collect()
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for d, t in docs:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        mine = by_doc[d][: len(by_doc[d]) // (2 if d == 3 else 1)]
        assert b"".join(p["ids"] for p in mine) == np.array(ids, "<u4").tobytes()
        assert all(p["length"] <= 512 for p in mine) and (len(ids) > 512 or len(mine) == 1)
    placed = B.pack_documents(table, 512).collect()
    assert len(placed) == len(pieces)
    rows = collections.defaultdict(list)
    for p in placed:
        rows[p["sequence_id"]].append((p["offset"], p["length"]))
    for held in rows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert len(rows) <= 1.05 * -(-sum(p["length"] for p in pieces) // 512) + 1
    assert B.pack_documents(table.limit(0)).count() == 0


def test_encoder_handles_white_space():
    encode = Encoder(default_ranks())
    for text in ("a  b", " a", "a ", "a \n b", "a  b", "\x1c a", "a, b. c", "", "x　 y", "it's 12.5 %%% ok"):
        assert encode.encode(text) == Encoder.pack(encode.plain(text)) if text else encode.encode(text) == b""


def test_matrices(spark):
    docs = [x for x in documents() if x[0] != 3]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = M.packed_rows(table, 256, window_ids=2000).collect()
    got = collections.defaultdict(dict)
    for r in rows:
        ids, spots, cuts = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(spots) == 256 and cuts[0] == 0 and cuts == sorted(cuts)
        for a, b, s in zip(cuts, cuts[1:], r["segments"]):
            assert b - a == s["length"] and (spots[a:b] == np.arange(b - a)).all()
            got[s["doc_id"]][s["piece"]] = ids[a:b].tobytes()
        assert (ids[cuts[-1] :] == 0).all()
    expected = collections.defaultdict(bytes)
    for p in token_pieces(table, 256).collect():
        expected[p["doc_id"]] += p["ids"]
    assert {d: b"".join(x for _, x in sorted(v.items())) for d, v in got.items()} == expected
    assert M.packed_rows(table.limit(0)).count() == 0


def test_best_fit_decreasing_is_best_fit():
    r = random.Random(3)
    lengths = [r.randint(1, 64) for _ in range(300)]
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, x in enumerate(rooms) if x >= n]
        k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
        rooms += [64] * (k == len(rooms))
        rooms[k] -= n
    assert sorted(64 - sum(lengths[i] for i in row) for row in M.best_fit_decreasing(lengths, 64)) == sorted(rooms)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>T</h1><p>a<b>b</b> &amp;\n c<br>d</p><aside>no</aside><p>e</article><footer>x</footer>", "T ab & c d e"),
        ("<nav>menu</nav><div class='cookie-notice'>x</div><p>Only &lt;this&gt;", "Only <this>"),
        ("<script>var t='</p>';</script><article>x</article>", "x"),
        ("<div class=comments>" + "nice " * 60 + "</div><p>" + "word " * 60 + "</p>", ("word " * 60).strip()),
        ("a < b", "a < b"),
        ("<article><p>" + "y " * 100_000 + "</p></article>", ("y " * 100_000).strip()),
    ],
)
def test_main_text(html, text):
    assert H.main_text(html) == text


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 0), (1, "u", "<p>a</p>", 0), (None, None, None, 0)], "page_id bigint, url string, html string, text int")
    assert sorted(map(str, map(tuple, H.extract(pages).collect()))) == ["(1, 'u', 'a')", "(1, 'u', 'a')", "(None, None, '')"]
    assert H.extract(pages.limit(0)).count() == 0


def test_archive_round_trip(spark):
    pages = [(1, "http://a/1\r\nX: y", "same"), (2, None, "same"), (3, "http://b", None), (4, "https://b", ""), (5, "u", "é" * 300_000), (6, "u", "other"), (6, "u", "other"), (None, "u", "lone")]
    path = new_folder(spark, "warc-test")
    W.write_archive(spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, record_type int"), path)
    back = W.read_archive(spark, path).collect()
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    expected = collections.Counter((i, len((h or "").encode()), W.digest((h or "").encode()), *(("response", None) if (i if i is not None else -1) == last[h or ""] else ("revisit", last[h or ""]))) for i, _, h in pages)
    assert collections.Counter((r["source_id"], r["payload_length"], r["payload_digest"], r["record_type"], r["refers_to_source"]) for r in back) == expected
    assert {r["payload"].decode() for r in back if r["record_type"] == "response"} == {h or "" for _, _, h in pages}
    few = W.read_archive(spark, path).where("record_type = 'response' and target_uri like 'http%'")
    assert few.select("source_id").collect() == [(4,)] and "Filter" not in few._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert all(r["payload"] is None for r in W.read_archive(spark, path, payloads=False).collect())


def test_archive_of_nothing(spark):
    path = new_folder(spark, "warc-none")
    W.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert W.read_archive(spark, path).count() == 0


def test_chain_on_held_out_rows(spark):
    r = random.Random(8)
    plain = [f"{a}{b}" for a in "bcdfghjklm" for b in ("alo", "eri", "ino", "upe")]
    docs, labels = [], []
    for i in range(900):
        words = [r.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[r.randrange(40)] = "nasty" + r.choice(["", "ling", "wort", "um"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 7 > 0), int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "nasty"), (0, docs[0][1])]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, toxic int")
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    found = X.toxicity(table, known).collect()
    assert len(found) == len(docs)
    held = [(r["toxic"], r["doc_id"] % 5 == 0) for r in found if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 2 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert not any(r["toxic"] for r in X.toxicity(table, known.limit(0)).collect())


def test_linear_model_separates():
    rows = [np.array([i % 2]) for i in range(200)]
    y = np.array([i % 2 for i in range(200)], float)
    w = X.fit_linear(rows, np.zeros((200, 0)), y, 2)
    assert ((X.predict_linear(w, rows, np.zeros((200, 0))) > 0) == (y > 0)).all()


def test_pick_tells_case_apart(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    both = spark.createDataFrame([(1, "a", "b")], "doc_id int, text string, TEXT string")
    spark.conf.set("spark.sql.caseSensitive", "false")
    assert tuple(pick(both, "doc_id", "text").first()) == (1, "a")


def test_crc_of_ids(spark):
    one = token_pieces(spark.createDataFrame([(1, "abc def")], "doc_id bigint, text string")).select("ids", F.crc32("ids").alias("c")).first()
    assert one["c"] == zlib.crc32(one["ids"])


def test_top_k_with_ids_repeated_many_times(spark):
    r = random.Random(9)
    far = [(i, [r.uniform(-1, 0.2) for _ in range(4)]) for i in range(60)]
    rows = [*far, *[(1, [0.9, 0.9, 0.9, 0.9])] * 10, *[(40, [0.9, 0.9, 0.9, 0.8])] * 10]
    plain = {}
    for i, x in rows:
        v = [math.floor(256 * float(a)) for a in np.array(x, np.float32)]
        plain.setdefault(i, []).append(v)
    expected = set()
    for q in (0, 20, 40):
        score = {i: max(sum(a * b for a, b in zip(u, min(vs))) for u in plain[q]) for i, vs in plain.items() if i != q}
        expected |= {(q, n + 1, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])}
    vectors = K.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    for options in ({}, {"pivots": 4, "group_queries": 2, "block_rows": 20}):
        assert {tuple(x) for x in K.top_k(vectors, F.col("vec_id") % 20 == 0, 5, **options).collect()} == expected


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title><meta charset=utf-8><body><article><p>whole</p></article></body></html>", "whole"),
        ("<head><link rel=x><p>no body tag", "no body tag"),
        ("<div class='layout with-sidebar'><article>a</article><div class=sidebar>s</div></div>", "a"),
        ("<div id='page-header-wrap'><main>b</main></div>", "b"),
        ("<form action=/><main><p>c<form>inner</form></main></form>", "c"),
        ("<article>long enough story</article><div class=comments><article>reply</article></div>", "long enough story"),
        ("<div class='layout with-sidebar'><p>one two three</p><nav>n</nav><nav>n</nav><nav>n</nav><p>short</p></div>", "one two three short"),
        ("<p>" + "word " * 60 + "</p><nav>a</nav><nav>b</nav><nav>c</nav><p>end</p><p>Copyright law has a history.</p><footer>f</footer>", "word " * 60 + "end Copyright law has a history."),
    ],
)
def test_main_text_is_whole(html, text):
    assert H.main_text(html) == text


def test_far_groups_are_pruned(spark):
    r = random.Random(12)
    centres = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(10)]
    rows = [(i, [c + r.uniform(-0.01, 0.01) for c in centres[i % 10]]) for i in range(2000)]
    vectors = K.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    options = {"pivots": 16, "group_queries": 10}
    dealt = K.top_k(vectors, F.col("vec_id") % 20 == 0, 5, dealt_only=True, **options)
    groups = dealt.select("group").distinct().count()
    copies = dealt.where("not is_query").count() / len(rows)
    assert groups >= 8 and copies < 0.4 * groups
    v = {i: np.array([math.floor(256 * a) for a in x]) for i, x in rows}
    expected = set()
    for q in range(0, 2000, 20):
        best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:5]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(x) for x in K.top_k(vectors, F.col("vec_id") % 20 == 0, 5, **options).collect()} == expected
