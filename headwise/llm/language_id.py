"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, all but letters becomes single spaces, and the runs of one to three code
points are hashed to ``DIM`` features. Document frequencies are counted over all training rows; the
classifier is fitted on a bounded sample, by default ``PER_LANGUAGE`` rows a language and
``SAMPLE`` rows in all, those with the smallest hashes. It is trained online with the
follow-the-regularised-leader rule, with an L1 and an L2 penalty on each weight, so most weights
are exactly zero. Every fifth sample row is left out to choose the temperature that divides the
scores before the softmax.

Whole texts are read. Null text or text without a letter gives ``und`` with score 0; so does every
row if no language could be learned. Rows that repeat, or lack an id, get their prediction like any
other; equal scores go to the language that sorts first. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .hashing import U

DIM = 1 << 15
PER_LANGUAGE = 1000
SAMPLE = 8000
EPOCHS = 3
#: Step size, its offset, and the two penalties of the online rule.
RATE, OFFSET, L1, L2 = 1.0, 1.0, 0.02, 0.01
FOLDS = 3

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of a text; empty without a letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32)
    letter = letters()[code]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.where(letter, code, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate(([32], code[keep], [32])).astype(U)
    shift = U(64 - 15)
    grams = [code * U(0x9E3779B97F4A7C15), code[:-1] * U(0xC2B2AE3D27D4EB4F) + code[1:] * U(0x165667B19E3779F9)]
    grams.append(code[:-2] * U(0x85EBCA77C2B2AE63) + code[1:-1] * U(0x27D4EB2F165667C5) + code[2:] * U(0xD6E8FEB86659FD93))
    counts = np.bincount((np.concatenate([(g ^ g >> U(29)) * U(0xBF58476D1CE4E5B9) for g in grams]) >> shift).astype(np.int64), minlength=DIM)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighted(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = (1 + np.log(counts)) * idf[found]
    return x / np.sqrt((x * x).sum())


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Rows with each feature, and all rows, of a frame with a column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIM + 1, dtype=np.int64), 0
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                seen[features(text)[0]] += 1
                n += 1
        seen[DIM] = n
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["feature", "n"])

    seen = np.zeros(DIM + 1, dtype=np.int64)
    # One number for each feature, however many rows.
    for feature, n in texts.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():
        seen[feature] = n
    return seen[:DIM], int(seen[DIM])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int) -> tuple[np.ndarray, float]:
    """(weights, temperature) from (class, features, values) in order; the last feature is a constant."""
    z, n = np.zeros((DIM + 1, n_classes)), np.zeros((DIM + 1, n_classes))

    def weights(at):
        small = np.abs(z[at]) <= L1
        return np.where(small, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((OFFSET + np.sqrt(n[at])) / RATE + L2))

    held = rows[::5] if len(rows) >= 5 * n_classes else []
    learn = [r for i, r in enumerate(rows) if not held or i % 5]
    for _ in range(EPOCHS):
        for y, at, x in learn:
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / RATE * w
            n[at] += g * g
    w = weights(np.arange(DIM + 1))
    if not held:
        return w, 1.0
    scores = np.stack([x @ w[at] for _, at, x in held])
    truth = np.array([r[0] for r in held])
    temperatures = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    losses = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(held)), truth], 1e-12)).mean() for t in temperatures]
    return w, float(temperatures[int(np.argmin(losses))])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> dict:
    """A model from all rows of ``docs`` that have a language."""
    from pyspark.sql import Window as W

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    seen, total = document_frequencies(rows.select("text"))
    order = [F.xxhash64("id"), "id"]
    best = rows.select("id", "lang").withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("at") <= per_language)
    best = stored(best.orderBy("at", "lang").limit(sample).select("id").distinct(), "sample")
    idf = np.log((1 + total) / (1 + seen)) + 1

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["text"].map(lambda t: len(features(t)[0]) > 0)].sort_values(["h", "lang", "text"], kind="stable")
        names = sorted(set(frame["lang"]))
        known = {k: i for i, k in enumerate(names)}
        points = []
        for lang, text in zip(frame["lang"], frame["text"]):
            at, counts = features(text)
            points.append((known[lang], np.append(at, DIM), np.append(weighted(at, counts, idf), 1.0)))
        w, temperature = fit(points, len(names)) if names else (np.zeros((DIM + 1, 0)), 1.0)
        out = [(name, int(i), float(w[i, k])) for k, name in enumerate(names) for i in np.flatnonzero(w[:, k])]
        out += [(name, -1, temperature) for name in names]
        return pd.DataFrame(out, columns=["lang", "feature", "weight"])

    # The sample is bounded, so one task may hold it; the model has at most DIM weights a language.
    chosen = rows.join(F.broadcast(best), "id", "left_semi").select("lang", "text", F.xxhash64("id").alias("h"))
    fitted = chosen.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "lang string, feature int, weight double").collect()
    names = sorted({r["lang"] for r in fitted})
    w = np.zeros((DIM + 1, len(names)))
    temperature = 1.0
    for lang, feature, weight in fitted:
        if feature < 0:
            temperature = weight
        else:
            w[feature, names.index(lang)] = weight
    return {"names": names, "weights": w, "temperature": temperature, "idf": idf}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of each row, from its text alone."""
    names, temperature, idf = [*model["names"], "und"], model["temperature"], model["idf"]
    rows = np.flatnonzero(model["weights"].any(axis=1))
    # Only features with a weight travel with the tasks.
    held = model["weights"][rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((DIM + 1, len(names) - 1))
        w[rows] = held
        for batch in slices(batches, "text"):
            lang, score = [], []
            for text in batch.column("text").to_pylist():
                at, counts = features(text)
                if len(at) and len(names) > 1:
                    p = softmax((weighted(at, counts, idf) @ w[at] + w[DIM]) / temperature)
                    lang.append(names[int(p.argmax())])
                    score.append(float(p.max()))
                else:
                    lang.append("und")
                    score.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang), pa.array(score)], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_: Column) -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 1, F.lit(False))
