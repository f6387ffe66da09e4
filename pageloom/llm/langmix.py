"""Language identification by multilingual mixtures (operator 7).

A document is a mixture of languages over hashed letter trigrams.  Expectation
maximisation estimates its proportions until they move by less than SETTLED;
languages are then added to the set in order of their proportion as long as the
likelihood, less a penalty for each language, grows.  The language with the largest
share is the prediction, its share the score.

Trigram models are counted in Spark from a sample of at most about TRAIN_DOCS
whole documents of each language, drawn by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, held_out, importable, table

TRAIN_DOCS, BUCKETS, SETTLED, PENALTY, NONE = 2000, 1 << 15, 1e-4, 8.0, "und"


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of a text's letters, each run of others one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, 32)
    if not (codes != 32).any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[32], codes[(codes != 32) | (np.concatenate([[0], codes[:-1]]) != 32)], [32]]).astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return ((mixed * np.uint64(0x27D4EB2F) >> np.uint64(13)) % np.uint64(BUCKETS)).astype(np.int64)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of every bucket, (languages, BUCKETS).

    Held-out rows, null languages and null texts teach nothing; rows with a null id are
    drawn together; repeated rows count as often as they occur; an empty table gives no
    languages."""
    known = docs.where(F.col("lang").isNotNull() & (F.col("lang") != NONE) & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / counts[lang]))])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                if isinstance(text, str):
                    total[langs.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": total[lang, bucket]})

    rows = known.where(drawn("doc_id", F.element_at(share, F.col("lang")))).select("lang", "text").mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages * BUCKETS rows
    table_ = np.full((len(langs), BUCKETS), 0.5)
    table_[rows["lang"], rows["bucket"]] += rows["n"]
    return langs, np.log(table_ / table_.sum(axis=1, keepdims=True))


def mixture(p: np.ndarray, n: np.ndarray, settled: float = SETTLED) -> tuple[np.ndarray, float]:
    """Proportions of the rows of likelihoods p for counts n, and the log likelihood."""
    share = np.full(len(p), 1 / len(p))
    while True:
        joint = share[:, None] * p
        before, share = share, joint @ (n / joint.sum(axis=0))
        share /= share.sum()
        if np.abs(share - before).max() < settled:
            return share, float(n @ np.log(share @ p))


def identify(text: str | None, langs: list[str], model: np.ndarray) -> tuple[str, float]:
    """Language and score of a text; NONE and 0 if it has no letter."""
    grams = trigrams(text) if text else np.zeros(0, np.int64)
    if not len(grams) or not langs:
        return NONE, 0.0
    counts = np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    n, logp = counts[at].astype(float), model[:, at]
    alone = logp @ n
    p = np.exp(logp - logp.max(axis=0))
    shift = float(n @ logp.max(axis=0))
    order = np.argsort(-mixture(p, n)[0], kind="stable") if len(langs) > 1 else np.array([0])
    best, share = np.array([int(alone.argmax())]), np.ones(1)
    value = float(alone.max())
    for size in range(2, len(langs) + 1):
        some = order[:size]
        s, likely = mixture(p[some], n)
        likely += shift - PENALTY * np.log1p(n.sum()) * (size - 1)
        if likely <= value:
            break
        best, share, value = some, s, likely
    top = int(share.argmax())
    return langs[best[top]], float(min(1.0, share[top]))


def predict(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """row (the columns of docs, whatever their names), lang_pred and score for every row.

    A null text, or one without letters, is NONE with score 0, and so is every text if no
    language was learned.  Repeated rows and rows without an id are rows like any other; an
    empty table gives no rows.
    """
    model = model.astype(np.float32)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table_ = model.astype(float)
        for b in batches:
            yield pd.DataFrame([identify(t if isinstance(t, str) else None, langs, table_) for t in b], columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})

    importable(docs.sparkSession)
    return docs.select(F.struct("*").alias("row"), predicted("text").alias("found")).select("row", "found.*")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, *train(docs)).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose text has a language, one that fills at least that share, with their
    columns, whatever their names; null and letterless texts go, rows without an id and
    repeated rows stay or go by their text, and an empty table gives no rows."""
    found = predict(docs, *train(docs))
    return found.where((F.col("lang_pred") != NONE) & (F.col("score") >= least)).select("row.*")
