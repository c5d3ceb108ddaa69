"""Source divergence against plain loops, and the transducer against sorted lists."""

import collections
import random
import re

import pytest

from quire.llm import divergence as D


@pytest.mark.parametrize("seed", range(5))
def test_transducer(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 7))).encode() for _ in range(300)} | {b"x" * 5000, b"a", b"ab", b"abc"})
    machine = D.Transducer.load(D.Transducer.build(words).save())
    others = [b"zz", b"", b"ab" * 30, b"x" * 4999, b"aa\xff"]
    asked = r.sample(words, 50) + [o for o in others if o not in words] + [words[0]]
    places = {w: i for i, w in enumerate(words)}
    assert machine.ordinals(b"\n".join(asked), len(asked)).tolist() == [places.get(w, -1) for w in asked]
    assert [machine.spell(i) for i in range(len(words))] == words
    # Minimal: no two states have one right language.
    edges = collections.defaultdict(list)
    for key, target in zip(machine.keys.tolist(), machine.targets.tolist()):
        edges[key >> 8].append((key & 255, target))
    marks = [(bool(f), tuple(edges[i])) for i, f in enumerate(machine.final)]
    assert len(set(marks)) == len(marks)


def plain(docs, least, unit, top):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    rows = [(lang or "", source or "", word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        frequency = collections.Counter(t for _, _, ts in mine for t in set(ts))
        kept = [t for t, n in frequency.items() if n >= least]
        sources = {s for _, s, _ in mine}

        def share(chosen):
            n = collections.Counter(t for _, s, ts in mine if s in chosen for t in ts if frequency[t] >= least)
            return n, {t: 1 + unit * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        q = share(sources)[1]
        of = {s: share({s}) for s in sources}
        f = lambda p, q: (p - q) ** 2 // q
        for s, (n, p) in of.items():
            pairs = sorted((-sum(f(p[t], of[o][1][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[t], q[t]), t.encode()) for t in kept if n[t] and p[t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return collections.Counter(out)


def sample():
    r = random.Random(9)
    words = ["Alpha", "beta", "éta", "d3lta", "ΩMEGA", "x_y", "zeta", "a", "😀", "it's"] + [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(60)]
    docs = [(r.choice(["en", "de", "", None, "x\x00y"]), r.choice(["s1", "s2", "É", None, "S1", "long" * 50]), " ".join(r.choices(words, range(1, len(words) + 1), k=r.randint(0, 60)))) for _ in range(150)]
    return docs + [("fr", "alone", None), ("fr", "other", ""), ("it", "one", "words that no other document has"), docs[0], docs[0], ("en", "s1", "y" * 70_000 + " " + "beta " * 900)] + [("en", "s9", "y" * 70_000)] * 3


@pytest.mark.parametrize("settings", [{}, {"SHARD_TERMS": 7, "BLOCK": 5, "TILE": 2, "HELD": 20}])
def test_divergence(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(D, name, value)
    docs = sample()
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, source string, text string, n int, ordinal int").repartition(5)
    found = D.divergence(table, 3, 10**9, 12).select("lang", "source", "part", "item", "value", "rank")
    expected = plain(docs, 3, 10**9, 12)
    assert collections.Counter(map(tuple, found.collect())) == expected
    assert any(i == "y" * 70_000 for _, _, _, i, _, _ in expected)


def test_shares_beyond_64_bits():
    import numpy as np

    big = np.array([10**12, 0], np.int64)
    assert D._shares(big, 10**12, 2, 10**9).tolist() == [1 + 10**9 * (10**12 + 1) // (10**12 + 2), 1]


def test_words_behind_a_prefix_and_sums():
    words = sorted([b"6465 baum", b"6465 haus", b"656e house", b"656e tree"])
    machine = D.Transducer.load(D.Transducer.build(words).save())
    assert machine.ordinals(b"tree\nbaum\nhouse", 3, b"656e ").tolist() == [3, -1, 2]
    assert machine.ordinals(b"tree\nbaum", 2, b"6672 ").tolist() == [-1, -1]
    at, n = D._summed(D.np.array([5, 2, 5, 2, 9]), D.np.array([1, 2**40, 3, 4, 5]))
    assert (at.tolist(), n.tolist()) == ([2, 5, 9], [2**40 + 4, 4, 5])
    assert D._summed(D.np.empty(0, D.np.int64), D.np.empty(0, D.np.int64))[1].tolist() == []


def test_equal_counts_with_many_sendings(spark, monkeypatch):
    """Groups in many small sendings and stretches give what one sending gives, and are summed where they meet."""
    r = random.Random(3)
    rows = [(r.choice(["de", "en", ""]), r.choice("ab"), " ".join(r.choice("abcdef") * r.randint(1, 3) for _ in range(30))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3).cache()
    whole = sorted(map(tuple, D.divergence(docs).collect()))
    monkeypatch.setattr(D, "HELD", 40)
    monkeypatch.setattr(D, "SHARD_TERMS", 7)
    assert sorted(map(tuple, D.divergence(docs).collect())) == whole
