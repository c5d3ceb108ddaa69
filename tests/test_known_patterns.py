"""The library's own patterns by whole batches find what Java finds in texts one by one."""

import random

from pyspark.sql import functions as F

from quire.functions import spans as S
from quire.operators import entities as E

PARTS = (
    "2024-01-31 1/2/99 31.12.2020 March 5th, 2021 mar. 5 2021 5 mai 2021 5th May 2021 MAY 6, 1999 Sept. 7, 2001 12-12-12 $1,234.50 1234567 USD ıNR 12 İNR 5 uſd 9 Rſ. 7 EUR 1.5 3.14 chf 元 5 C$ 9 Mr. John Smith Jr. Dr Ann Lee The End "
    "a.b@c.de x@@y.org me@mail.example.com, +1 234 567 8901 (555) 123-4567 555-123-4567 555.123.4567 555 123 4567 12 Main Street, Boston, MA 02134 Austin TX 78701-1234 x_Miami, FL 33101 Bost on MA 02134 1 A Rd, CA90210 "
    "https://www.a-b.com/x?y=1 www.x.zzz ftp://q.io. a@b.com/z 123-45-6789 000 12 3456 12-1234567 Invoice #INV-77 order: PO-1234 A/C 1234-56 acct#ABCDEF Ref 12345 Tracking 1234567890 1Z12345678901234AB ID: AB-123 license ZZZZZ ﷐ ﷑x é 😀 ſ _ - , . \n \t"
).split(" ")


def test_known_patterns_find_what_java_finds(spark, monkeypatch):
    r = random.Random(5)
    texts = [(" ".join(r.choice(PARTS) for _ in range(60)) if i % 2 else "".join(r.choice(PARTS) + r.choice(["", " ", "\n", ",", "  "]) for _ in range(60)),) for i in range(60)]
    docs = spark.createDataFrame([*texts, ("",), (None,), (" ".join(PARTS),)], "text string").coalesce(1)
    asked = []

    def both(text, pattern, words=(), guard=None, groups=0, needs=(), within=None):
        found = S.find_known(text, pattern, words, guard, groups, needs, within)
        if pattern.startswith("(?i)(\\d+\\s+"):
            # Java looks for streets in the same stretches.
            moved = lambda s: F.transform(S.find_all(s["text"], pattern, groups=groups), lambda h: h.withField("start", h["start"] + s["start"]))
            plain = F.flatten(F.transform(S.find_all(text, E._UP_TO_ZIP), moved))
        else:
            plain = S.find_all(text, pattern, groups=groups, needs=needs)
        asked.append((pattern, found, plain))
        return found

    monkeypatch.setattr(E, "find_known", both)
    for hits, _, _ in E.KINDS.values():
        hits(F.col("text"))
    assert len(asked) == 26
    found = docs.select(*[f.alias(f"f{i}") for i, (_, f, _) in enumerate(asked)], *[p.alias(f"p{i}") for i, (_, _, p) in enumerate(asked)]).collect()
    for i, (pattern, _, _) in enumerate(asked):
        assert [x[f"f{i}"] for x in found] == [x[f"p{i}"] for x in found], pattern
        assert any(x[f"f{i}"] for x in found), pattern


def test_known_patterns_take_one_pass(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(E, "find_known", lambda *a, **b: asked.append((a, b)) or S.find_known(*a, **b))
    for hits, _, _ in E.KINDS.values():
        hits(F.col("text"))
    r = random.Random(8)
    odd = [*PARTS, *"ſ K ı İ \x0b \x1c \x85 \xa0 ﷒ \r - , . : / 12 MA jan ST".split(" "), " ", "", "\n"]
    texts = [("".join(r.choice(odd) + r.choice(["", " ", "-", "\n"]) for _ in range(50)),) for _ in range(150)]
    docs = spark.createDataFrame([*texts, ("",), (None,)], "text string").coalesce(1)
    # Before, Python tried each pattern at every character.
    assert len(asked) == 26 and all(S.linear(a[1]) for a, _ in asked)
    found = docs.select(*[S.find_known(*a, **b).alias(f"f{i}") for i, (a, b) in enumerate(asked)], *[S.find_by_python(*a, **b).alias(f"p{i}") for i, (a, b) in enumerate(asked)]).collect()
    for i, (a, _) in enumerate(asked):
        assert [x[f"f{i}"] for x in found] == [x[f"p{i}"] for x in found], a[1]
    assert S.linear("(?<=a)b") is None and S.linear("(?!a)b") is None
    assert [[(m["start"], m["text"], m["groups"]) for m in x["m"]] for x in docs.limit(0).union(spark.createDataFrame([("xab",)], "text string")).select(S.find_known(F.col("text"), "(?<=a)(b)", groups=1).alias("m")).collect()] == [[(2, "b", ["b"])]]
