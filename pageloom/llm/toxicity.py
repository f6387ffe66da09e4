"""Toxicity by a counterfactually regularised classifier (operator 10).

Logistic regression over which words, and which word beginnings, a text holds.
Beside the usual loss, every labelled text that names a group is scored again
with each identity term swapped for another of its kind, and the squared change
of the log odds is penalised: the model can't lean on who is mentioned.

Features are counted in Spark over a sample of at most about TRAIN_ROWS labelled
texts, drawn by a hash of the id and written once as sets of words; of those that
tell more than LEAST_TOLD (G test), the FEATURES that tell most are kept, and the
sample's feature lists, not its texts, come to the driver for the fit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, held_out, importable, stored, table

TRAIN_ROWS, FEATURES, LEAST_TEXTS, LEAST_TOLD, BEGINNINGS = 20_000, 2048, 4, 6.0, (4, 5, 6)
SAMPLE_PARTS = 32
STEPS, RATE, RIDGE, SWAP = 400, 0.1, 2e-4, 1.0
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
MOST_WORDS = 500_000
# Identity terms by kind; a term's counterpart is the next of its kind.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("her", "his"), ("mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("disabled", "abled"), ("blind", "sighted"), ("deaf", "hearing"),
    ("frauen", "männer"), ("frau", "mann"), ("femmes", "hommes"), ("femme", "homme"), ("mujeres", "hombres"), ("mujer", "hombre"),
)
COUNTERPART = {t: kind[(i + 1) % len(kind)] for kind in IDENTITIES for i, t in enumerate(kind)}


def features_of(word: str) -> list[str]:
    """A word, and its beginnings marked by a dash."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def words_of(text) -> set[str]:
    return set(WORD.findall(text.lower())) if isinstance(text, str) else set()


def labelled(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """doc_id, toxic and the set of words of each text of the sample; held-out
    rows are never in it."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, train_rows / max(1, known.count()))
    sample = known.where(drawn("doc_id", share))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # about train_rows rows

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "words": [sorted(words_of(t)) for t in b["text"]], "toxic": (b["toxic"] > 0).astype(int)})

    return stored(texts.repartition(SAMPLE_PARTS, "doc_id").mapInPandas(held, "doc_id long, words array<string>, toxic int"), "labelled")


def chosen_features(sample: DataFrame, most: int = FEATURES) -> list[str]:
    """The features whose presence tells most about the label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = (Counter(), Counter())
            for words, toxic in zip(b["words"], b["toxic"], strict=True):
                seen[toxic].update({f for w in words for f in features_of(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"feature": names, "clean": [seen[0][f] for f in names], "toxic": [seen[1][f] for f in names]})

    n = sample.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).first()
    if not n["toxic"] or not n["clean"]:
        return []
    found = sample.select("words", "toxic").mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).where(F.col("a") + F.col("b") >= LEAST_TEXTS)
    rate = (F.col("a") + F.col("b")) / (n["clean"] + n["toxic"])

    def part(have, of: int):  # of the G statistic: one class's texts with and without the feature
        return F.when(have > 0, have * F.log(have / (of * rate))).otherwise(0.0) + F.when(have < of, (of - have) * F.log((of - have) / (of * (1 - rate)))).otherwise(0.0)

    told = found.where(rate < 1).withColumn("g", part(F.col("a"), n["clean"]) + part(F.col("b"), n["toxic"]))
    top = [r["feature"] for r in told.where(F.col("g") >= LEAST_TOLD).orderBy(F.desc("g"), "feature").limit(most).collect()]
    return sorted({*top, *COUNTERPART})


def fit(rows: list[tuple[list[int], list[int], int]], n_features: int, swap: float = SWAP) -> np.ndarray:
    """Weights, the constant last, from (features, features after the swap, label)."""
    y = np.array([r[2] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col = np.concatenate([np.array(r[0], np.int64) for r in rows])
    pairs = [i for i, r in enumerate(rows) if r[0] != r[1]]
    sign_at = np.concatenate([np.repeat(k, len(rows[i][0]) + len(rows[i][1])) for k, i in enumerate(pairs)]).astype(int) if pairs else np.zeros(0, int)
    sign_col = np.concatenate([np.array(rows[i][0] + rows[i][1], np.int64) for i in pairs]) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([np.repeat([1.0, -1.0], [len(rows[i][0]), len(rows[i][1])]) for i in pairs]) if pairs else np.zeros(0)
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for step in range(1, STEPS + 1):
        z = np.bincount(at, w[col], len(rows)) + w[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(col, miss[at], n_features), miss.sum())
        g[:-1] += RIDGE * w[:-1]
        if pairs:
            change = np.bincount(sign_at, sign * w[sign_col], len(pairs))
            g[:-1] += 2 * swap / len(pairs) * np.bincount(sign_col, sign * change[sign_at], n_features)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, swap: float = SWAP) -> tuple[dict[str, float], float]:
    """(weight of each feature, constant); without both labels, no features.

    Held-out rows, null labels and labels without an id teach nothing; of several labels of
    an id the largest counts; every row with a labelled id is a text of the sample."""
    importable(docs.sparkSession)
    sample = labelled(docs, labels, train_rows)
    names = chosen_features(sample)
    if not names:
        return {}, -2.0
    number = {f: i for i, f in enumerate(names)}

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def held(words) -> list[int]:
            return sorted({number[f] for w in words for f in features_of(w) if f in number})

        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "a": [held(w) for w in b["words"]], "b": [held({COUNTERPART.get(x, x) for x in w}) for w in b["words"]], "toxic": b["toxic"]})

    rows = sorted(sample.mapInPandas(lists, "doc_id long, a array<int>, b array<int>, toxic int").collect())  # about train_rows rows of feature numbers
    w = fit([(r["a"], r["b"], r["toxic"]) for r in rows], len(names), swap)
    return {f: float(x) for f, x in zip(names, w, strict=False) if x}, float(w[-1])


def score(docs: DataFrame, weights: dict[str, float], constant: float) -> DataFrame:
    """row (the columns of docs, whatever their names) and score (0 to 1) for every row.

    A null or empty text gets the constant's score.  Repeated rows and rows without an id
    are rows like any other; an empty table gives no rows.
    """
    importable(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            out = []
            for text in b:
                found: set[str] = set()
                for w in words_of(text):
                    fs = known.get(w)
                    if fs is None:
                        fs = known[w] = tuple(f for f in features_of(w) if f in weights)
                    if fs:
                        found.update(fs)
                out.append(constant + sum(weights[f] for f in sorted(found)))
            if len(known) > MOST_WORDS:
                known.clear()
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float), -60, 60))))

    return docs.select(F.struct("*").alias("row"), scored("text").alias("score"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, *train(docs, table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier does not call toxic, with their columns, whatever their
    names; null and empty texts stay, repeated rows and rows without an id stay or go by
    their text, and an empty table gives no rows."""
    return score(docs, *train(docs, labels)).where(F.col("score") < THRESHOLD).select("row.*")
