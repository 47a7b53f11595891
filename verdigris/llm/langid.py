"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Documents become hashed counts of character 1- to 3-grams over lower-cased letters (every run of
other characters is one space), damped by 1 + ln(count), weighted by inverse document frequency and
scaled to unit length. The weights are learned by follow-the-regularised-leader (FTRL-Proximal)
with an elastic net: l1 keeps the weight table sparse, l2 keeps it small. A temperature fitted on
rows kept out of the training makes the scores calibrated.

Document frequencies count every training row, in one distributed pass. The classifier is fitted on
a bounded sample of the labelled rows: at most SAMPLE, shared evenly between the languages and drawn
by a hash of the key, so that it is the same on every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import remainder, texts, tune

#: Buckets of the hashed n-grams; longest n-gram; most labelled rows that the classifier is fitted on.
DIM, ORDER, SAMPLE = 1 << 16, 3, 3000
#: Buckets of one slice of the table of document frequencies on its way through the shuffle.
SLICE = 1 << 12
#: Characters taken at a time, whatever the text's length.
PIECE = 1 << 20
UNKNOWN = "und"
_EDGE = np.array([32], np.uint32)
_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; built once in each process."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, or None if it has no letter.

    A long text is taken PIECE characters at a time; what a piece leaves (whether it ended in a letter, and its last
    symbols) goes on to the next, so that the counts are those of the text as one.
    """
    low, any_letter, before = text.lower(), False, True
    total, carry = np.zeros(DIM, np.int64), np.zeros(0, np.uint32)
    for start in range(0, max(1, len(low)), PIECE):
        codes = np.frombuffer(low[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[codes]
        any_letter = any_letter or bool(is_letter.any())
        # of a run of other characters the first stays, as a space
        kept = is_letter | np.r_[before, is_letter[:-1]][: len(codes)]
        seq = np.concatenate([carry if start else _EDGE, np.where(is_letter, codes, np.uint32(32))[kept], _EDGE if start + PIECE >= len(low) else _EDGE[:0]])
        part, found = np.zeros(len(seq), np.uint32), []
        for n in range(1, ORDER + 1):
            part = part[: max(0, len(seq) - n + 1)] * np.uint32(0x01000193) ^ seq[n - 1 :]
            h = (part[max(0, len(carry) - n + 1) :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            found.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16))
        total += np.bincount(np.concatenate(found), minlength=DIM)
        carry, before = seq[len(seq) - min(len(seq), ORDER - 1) :], bool(is_letter[-1]) if len(codes) else True
    return total if any_letter else None


@dataclass
class Model:
    """langs (sorted), idf, weights [bucket, lang], bias, temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = (1.0 + np.log(counts[at])) * self.idf[at]
        return at, x / np.linalg.norm(x)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; ('und', 0) without a letter or without any language learned."""
        counts = gram_counts(text) if text and self.langs else None
        if counts is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.features(counts)) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of k classes from rows (buckets, values, class), by FTRL-Proximal with l1 and l2."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) > l1, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2), 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / alpha * w
            n[at] = grown
    w = weights(z, n)
    return w[:DIM], w[DIM]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 0.05 and 20 of least negative log likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, and how many rows have a letter. Counted in every task, added up by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in texts(b):
                c = gram_counts(t)
                if c is not None:
                    total += c > 0
                    rows += 1
        parts = [total[i : i + SLICE].tobytes() for i in range(0, DIM, SLICE)]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(-1, len(parts)), pa.int32()), "counts": pa.array([np.array([rows], np.int64).tobytes(), *parts], pa.binary())})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [key[0]], "counts": [np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0).tobytes()]})

    schema = "slice int, counts binary"
    got = {r["slice"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in df.select(F.col(text).alias("text")).mapInArrow(run, schema).groupBy("slice").applyInPandas(add, schema).collect()}
    return (np.concatenate([got[i] for i in range(DIM // SLICE)]), int(got[-1][0])) if got else (np.zeros(DIM, np.int64), 0)


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows of df; those with null lang or null text teach nothing. Without such rows it knows no language."""
    tune(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(DIM), np.zeros((DIM, 0)), np.zeros(0))
    df_counts, n = document_frequencies(rows, "text")
    idf = np.log((1.0 + n) / (1.0 + df_counts)) + 1.0
    quota = max(1, sample // len(langs))
    spread = 1 << 30
    draw = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("langid")), F.lit(spread))
    most: Column = F.lit(0)
    for x in langs:
        most = F.when(F.col("lang") == x, F.lit(min(spread, int(spread * 1.2 * quota / counts[x]) + 1))).otherwise(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, many, of, draws = [], [], [], []
            for t, x, d in zip(texts(b), b.column("lang").to_pylist(), b.column("draw").to_pylist()):
                c = gram_counts(t)
                if c is not None:
                    i = np.flatnonzero(c)
                    at.append(i.astype(np.int32).tobytes())
                    many.append(c[i].astype(np.int32).tobytes())
                    of.append(x)
                    draws.append(d)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.binary()), "many": pa.array(many, pa.binary()), "lang": pa.array(of, pa.string()), "draw": pa.array(draws, pa.int64())})

    picked = rows.withColumn("draw", draw).filter(F.col("draw") < most).select("text", "lang", "draw").mapInArrow(run, "at binary, many binary, lang string, draw bigint").toPandas()
    picked = picked.sort_values(["lang", "draw", "at"]).groupby("lang").head(quota)
    model = Model(langs, idf, np.zeros((DIM, len(langs))), np.zeros(len(langs)))
    train, held = [], []
    for r in picked.itertuples():
        c = np.zeros(DIM, np.int64)
        c[np.frombuffer(r.at, np.int32)] = np.frombuffer(r.many, np.int32)
        (held if r.draw % 5 == 0 else train).append((*model.features(c), langs.index(r.lang)))
    if not train:
        train = held
    model.weights, model.bias = ftrl(train, len(langs))
    model.temperature = calibrate(np.array([model.logits(at, x) for at, x, _ in held]).reshape(len(held), len(langs)), np.array([y for *_, y in held], int))
    return model


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score for every row of df.

    Null texts and texts without a letter are 'und' with score 0, and so is everything if no language was learned.
    Equal texts get equal results; ties between languages go to the first in order; repeated rows and keys each
    give a row; other columns are not read.
    """
    tune(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), (remainder(key, 5) == 0).alias("held_out"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in texts(b)]
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "held_out": b.column("held_out"), "lang_pred": pa.array([x for x, _ in got], pa.string()), "score": pa.array([s for _, s in got], pa.float64())})

    schema = "key " + rows.schema["key"].dataType.simpleString() + ", held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """predict() for every row of df, learned from its rows whose crc32(key as text) modulo 5 is not 0."""
    return predict(df, fit(df.filter(remainder(key, 5) != 0), key, text, lang), key, text)


def keep(df: DataFrame, model: Model, text: str = "text", least: float = 0.4, among: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of df, all columns as they are, whose language is known with a score of least or more (and is in among).

    Rows without a letter (null and empty texts too) are rejected; if the model knows no language, every row with a
    letter stays. Each row is judged by its text alone, so equal texts fare equally; repeated rows and keys stay as
    they are, an empty table stays empty.
    """
    tune(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            fine = []
            for t in texts(b, text):
                if not m.langs:
                    fine.append(gram_counts(t) is not None)
                    continue
                x, s = m.predict(t)
                fine.append(x != UNKNOWN and s >= least and (among is None or x in among))
            yield b.filter(pa.array(fine, pa.bool_()))

    return df.mapInArrow(run, df.schema)
