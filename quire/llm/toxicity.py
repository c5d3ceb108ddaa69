"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another; each model sees the words and word beginnings that set its
category apart and the log-odds of the earlier categories. For training, those come from models that did not see
the row (out of fold); for prediction, from the models of all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

#: Bound on the labelled rows that models are fitted on, the least by hash of doc_id.
MOST_LABELLED = 20_000
#: Bound on the features chosen for each category.
FEATURES = 512
FOLDS = 4
SPACE = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")


def _of_word(word: str) -> list[int]:
    parts = {"w " + word} | {"p " + word[:n] for n in (4, 5, 6) if len(word) >= n}
    return [xxhash.xxh32_intdigest(p) % SPACE for p in parts]


def _of_shape(text: str, words: list[str]) -> list[int]:
    """Length and share of letters, in steps."""
    letters = sum(map(len, words))
    return [xxhash.xxh32_intdigest(p) % SPACE for p in (f"n {int(math.log2(1 + len(words)))}", f"l {int(10 * letters / max(1, len(text)))}", f"m {int(letters / max(1, len(words)))}")]


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text; none for null and empty ones."""
    if not text:
        return np.empty(0, np.int64)
    words = _WORD.findall(text.lower())
    return np.unique(np.array([f for w in set(words) for f in _of_word(w)] + _of_shape(text, words), np.int64))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, width: int, rounds: int = 200, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on binary features (indices below width) and dense ones: weights, dense weights, bias."""
    n, dense = len(y), extra.shape[1]
    w = np.zeros(width + dense + 1)
    share = np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4)
    w[-1] = math.log(share / (1 - share))
    if not n or share in (1e-4, 1 - 1e-4):
        return w
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    at = np.concatenate(rows).astype(np.int64) if len(of) else np.empty(0, np.int64)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(of, w[at], n) + extra @ w[width:-1] + w[-1]
        gap = (_sigmoid(z) - y) / n
        g = np.concatenate((np.bincount(at, gap[of], width), extra.T @ gap, [gap.sum()]))
        g[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def predict_linear(w: np.ndarray, rows: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
    dense = extra.shape[1]
    width = len(w) - dense - 1
    return np.array([w[r].sum() for r in rows]).reshape(-1) + extra @ w[width : width + dense] + w[-1] if len(rows) else np.empty(0)


@dataclass
class Chain:
    """A fitted chain: chosen features, weights and threshold of each category."""

    categories: list[str]
    chosen: dict[int, int]
    weights: list[np.ndarray]
    thresholds: list[float]

    def log_odds(self, rows: list[np.ndarray]) -> np.ndarray:
        """A column for each category."""
        out = np.zeros((len(rows), 0))
        for w in self.weights:
            out = np.concatenate((out, predict_linear(w, rows, out)[:, None]), axis=1)
        return out


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts the classes with the best F1, midway to the next lower one; 0.5 without both."""
    if not len(y) or not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][np.diff(p[order]) == 0] = -1
    i = int(f1.argmax())
    below = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float((p[order][i] + below) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), most: int = MOST_LABELLED, keep: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Fits the chain on (doc_id, text) with labels (doc_id, one 0/1 column for each category).

    At most `most` labelled documents take part. Label rows with a null id or a null category are left out,
    repeated ones count once (the largest values). Without labels of both classes a category's model is its
    prior; without any labels every probability is near 0.
    """
    spark = docs.sparkSession
    known = pick(labels, "doc_id", *categories).dropna().groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in categories])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # Broadcast: at most `most` rows of a few numbers.
    sample = pick(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64())), *[batch.column(c) for c in categories]], names=["doc_id", "features", *categories])

    sample = stored(sample.mapInArrow(numbered, f"doc_id bigint, features array<bigint>, {', '.join(f'{c} int' for c in categories)}"), "labelled")
    sizes = sample.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories]).first()
    n = sizes["n"]
    counts = sample.select(F.explode("features").alias("f"), *categories).groupBy("f").agg(F.count(F.lit(1)).alias("df"), *[F.sum(c).alias(c) for c in categories]).where("df >= 3")
    chosen: set[int] = set()
    for c in categories:
        gap = F.col(c) * float(n) - F.col("df") * float(sizes[c])
        weight = gap * gap / (F.col("df") * (float(n) + 1 - F.col("df")))
        chosen |= {r["f"] for r in counts.orderBy(weight.desc(), "f").limit(keep).select("f").collect()}
    place = {f: i for i, f in enumerate(sorted(chosen))}
    table = spark.createDataFrame([(f, i) for f, i in place.items()], "f bigint, i int")
    wanted = sample.select("doc_id", F.explode("features").alias("f")).join(F.broadcast(table), "f").groupBy("doc_id").agg(F.array_sort(F.collect_list("i")).alias("at"))
    # The driver gets at most `most` rows of chosen features.
    rows = sample.drop("features").join(wanted, "doc_id", "left").orderBy("doc_id").collect()
    at = [np.array(r["at"] or [], np.int64) for r in rows]
    fold = np.array([xxhash.xxh32_intdigest(str(r["doc_id"])) % folds for r in rows], np.int64)
    chain = Chain(list(categories), place, [], [])
    unseen = np.zeros((len(rows), 0))
    for c in categories:
        y = np.array([r[c] for r in rows], np.float64)
        z = np.zeros(len(rows))
        for k in range(folds):
            inside, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            w = fit_linear([at[i] for i in inside], unseen[inside], y[inside], len(place))
            if len(out):
                z[out] = predict_linear(w, [at[i] for i in out], unseen[out])
        chain.weights.append(fit_linear(at, unseen, y, len(place)))
        chain.thresholds.append(_best_threshold(_sigmoid(z), y))
        unseen = np.concatenate((unseen, z[:, None]), axis=1)
    return chain


class _Places(dict):
    """Chosen features of a word, kept by word."""

    def __init__(self, chosen: dict[int, int]):
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = tuple(self.chosen[f] for f in _of_word(word) if f in self.chosen)
        if len(word) <= 32:
            self[word] = out
        return out


def scores(text: Column, chain: Chain) -> Column:
    """The categories' probabilities of a text, as an array in the chain's order; 0 for null, empty and blank texts."""

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = _Places(chain.chosen)
        for batch in batches:
            if len(places) > 500_000:
                places.clear()
            rows = []
            for t in batch:
                found: set[int] = set()
                if t:
                    words = _WORD.findall(t.lower())
                    for w in set(words):
                        found.update(places[w])
                    found.update(chain.chosen[f] for f in _of_shape(t, words) if f in chain.chosen)
                rows.append(np.array(sorted(found), np.int64))
            p = _sigmoid(chain.log_odds(rows))
            p[[not t or t.isspace() for t in batch]] = 0
            yield pd.Series(list(p))

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), **options) -> DataFrame:
    """doc_id, a column p_<category> for each, and toxic: whether the last category's probability reaches its threshold.

    A row for every row of (doc_id, text), null and empty texts, null ids and repeats included.
    """
    chain = fit_chain(docs, labels, categories, **options)
    found = pick(docs, "doc_id", "text").select("doc_id", scores(F.col("text"), chain).alias("p"))
    return found.select("doc_id", *[F.get("p", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(categories)], (F.get("p", F.lit(len(categories) - 1)) >= chain.thresholds[-1]).alias("toxic"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, p_quality, p_toxic, toxic of every document."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return toxicity(read("documents"), read("labels"))
