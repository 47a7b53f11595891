"""Toxicity of whole texts, read through a noisy channel.

A character model (4-grams over a-z, the word boundary and one class for all other letters) is
counted over every document. Words that look disguised are decoded with it: each observed character
is a node of a lattice, with arcs to the letters it may stand for (leetspeak), to nothing (a
separator, or one more of a repeated letter) and, where letters stand alone, across the white space
between them. Viterbi finds the cheapest letters under channel plus character model; it keeps every
state, so nothing is cut off, however long the word.

The restored text is then scored: logistic regression on which of the learned words and word
beginnings occur anywhere in it. Learned are those whose presence
depends most on the label (log-likelihood ratio). Words and weights are fitted on a bounded sample of labelled
rows: at most SAMPLE of each label, drawn by a hash of the key.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import release, remainder, staged, texts, tune

#: Labelled rows of each label, and words, that the classifier is fitted on at most.
SAMPLE, VOCABULARY = 6000, 2000
#: Lengths of the word beginnings that are features besides whole words; least log-likelihood ratio of a feature.
BEGINNINGS, RATIO = (4, 5, 6, 7, 8), 20.0
#: Length of a character n-gram, symbols of its alphabet (0 boundary, 1-26 a-z, 27 any other letter).
ORDER, SYMBOLS = 4, 28
#: What a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "aeiou"}
#: Channel costs, in nats: a stand-in letter, a wildcard letter, a dropped repeat, a dropped separator.
STAND_IN, WILD, REPEAT, SEPARATOR = 0.5, 2.0, 2.5, 0.2
SLICE = 1 << 15
#: Characters counted at a time; what stands between texts. Longest disguised word that is kept decoded.
PIECE, EDGE, KEPT = 1 << 20, " " * (ORDER - 1), 128

_WORD = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\W_])[^\W_@$!|+*](?:[ .\-_*~]{1,2}[\w@$!|+]){2,}(?![^\W_])")
_LETTER_AND_MARK = re.compile(r"[^\W\d_].*[\d@$!|+€(*#.\-_~]|[\d@$!|+€(*#.\-_~].*[^\W\d_]")
_MARKS = ".,;:?\"')([]{}-_~&%"
_BETWEEN, _ODD = re.compile(r"(\s+)"), re.compile(r"[\d@$!|+€(*#.\-_~]|([^\W\d_])\1\1")
_table: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """Symbol of each code point."""
    if not _table:
        t = np.fromiter((27 if chr(c).isalpha() else 0 for c in range(0x110000)), np.int32, 0x110000)
        t[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _table.append(t)
    return _table[0]


def character_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of the character n-grams of every row, added up in each task and then by slice."""
    size = SYMBOLS**ORDER

    def count(text: str) -> np.ndarray:
        s = symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        gram = s[: len(s) - ORDER + 1]
        for n in range(1, ORDER):
            gram = gram * np.int32(SYMBOLS) + s[n : len(s) - ORDER + 1 + n]
        return np.bincount(gram, minlength=size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, chars = np.zeros(size, np.int64), [], 0
        for b in batches:
            for t in texts(b):
                low = t.lower()
                if len(low) > PIECE:  # windows that overlap by all but one of an n-gram's characters: each n-gram once
                    whole = EDGE + low + EDGE
                    for start in range(0, len(whole) - ORDER + 1, PIECE):
                        total += count(whole[start : start + PIECE + ORDER - 1])
                    continue
                waiting.append(low)
                chars += len(low)
                if chars >= PIECE:
                    total += count(EDGE + EDGE.join(waiting) + EDGE)
                    waiting, chars = [], 0
        if waiting:
            total += count(EDGE + EDGE.join(waiting) + EDGE)
        parts = [total[i : i + SLICE].tobytes() for i in range(0, size, SLICE)]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(len(parts)), pa.int32()), "counts": pa.array(parts, pa.binary())})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [key[0]], "counts": [np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0).tobytes()]})

    schema = "slice int, counts binary"
    got = df.select(F.col(text).alias("text")).mapInArrow(run, schema).groupBy("slice").applyInPandas(add, schema).collect()
    total = np.zeros(size, np.int64)
    for r in got:
        part = np.frombuffer(bytes(r["counts"]), np.int64)
        total[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    return total


def character_costs(counts: np.ndarray) -> np.ndarray:
    """-ln P(symbol | three before it), interpolated down to the uniform (Witten-Bell)."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for n in range(1, ORDER + 1):
        c = counts.reshape(-1, *(SYMBOLS,) * n).sum(0).astype(np.float64)
        total, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), p)
    return -np.log(p).astype(np.float32).reshape(-1)


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def lattice(c: str) -> tuple[list[tuple[str, int, float]], float | None]:
    """What an observed character may stand for (letter, symbol, cost), and the cost of leaving it out, if it may be."""
    options = LEET.get(c, "")
    arcs = [(x, symbol(x), WILD if len(options) > 2 else STAND_IN) for x in options]
    if c.isalpha():
        arcs.append((c, symbol(c), 0.0))
    return arcs, SEPARATOR if not c.isalnum() else None if arcs else WILD


def decode(seen: str, costs: list[float]) -> str:
    """The likeliest word behind a disguised one, by Viterbi over its lattice; '' if nothing is left of it.

    A state is the last three symbols and the last letter; of equal costs the first met stays. The letters so far are
    a chain that states share, so a long word costs as much for each character as a short one.
    """
    size = SYMBOLS ** (ORDER - 1)
    states: dict[tuple[int, str], tuple[float, tuple | None]] = {(0, ""): (0.0, None)}
    for c in seen:
        arcs, drop = lattice(c)
        after: dict[tuple[int, str], tuple[float, tuple | None]] = {}
        for state, (cost, word) in states.items():
            past, last = state
            past *= SYMBOLS
            for x, n, extra in arcs:
                extra += cost
                if x == last and (state not in after or extra + REPEAT < after[state][0]):
                    after[state] = (extra + REPEAT, word)
                n += past
                extra += costs[n]
                to = (n % size, x)
                if to not in after or extra < after[to][0]:
                    after[to] = (extra, (word, x))
            if drop is not None and (state not in after or cost + drop < after[state][0]):
                after[state] = (cost + drop, word)
        states = after
    word, letters = min(((cost + costs[past * SYMBOLS], n, word) for n, ((past, _), (cost, word)) in enumerate(states.items())), default=(0.0, 0, None))[2], []
    while word is not None:
        word, x = word
        letters.append(x)
    return "".join(reversed(letters))


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings with a star."""
    found = set(words)
    for n in BEGINNINGS:
        found.update([x + "*" for x in {w[:n] for w in words} if len(x) == n])
    return found


def disguise(chunk: str) -> tuple[str, str, str] | None:
    """What stands before, in and after the disguised word of a chunk between white space; None if it looks plain."""
    inside = chunk.strip(_MARKS)
    if not inside or not (_REPEATED.search(inside) or not inside.isalpha() and _LETTER_AND_MARK.search(inside)):
        return None
    at = chunk.index(inside)
    return chunk[:at], inside, chunk[at + len(inside) :]


class Restorer:
    """Restores disguised words under a character model; keeps what it has restored, up to a number of words.

    One finder serves the text and its words: letters spaced out are a disguised word, and so is what `disguise` finds
    in a chunk between white space.
    """

    def __init__(self, costs: np.ndarray, most: int = 200_000):
        self.costs, self.most, self.known = costs.tolist(), most, {}

    def word(self, seen: str) -> str:
        """A disguised word, decoded."""
        got = self.known.get(seen)
        if got is None:
            got = decode(seen, self.costs)
            if len(self.known) < self.most and len(seen) <= KEPT:
                self.known[seen] = got
        return got

    def chunk(self, chunk: str) -> str:
        """A chunk between white space, restored."""
        if chunk.isalpha() and not _REPEATED.search(chunk):
            return chunk
        parts = disguise(chunk)
        return chunk if parts is None else parts[0] + self.word(parts[1]) + parts[2]

    def plain(self, low: str) -> tuple[str, list[str]]:
        """A lower-case text with a gap where letters are spaced out, and what is found in the gaps, restored."""
        spaced: list[str] = []

        def gap(m: re.Match) -> str:
            spaced.append(self.word(m.group()))
            return "\n\0 "

        return _SPACED.sub(gap, low), spaced

    def text(self, text: str) -> str:
        """The whole text in lower case with every disguised word restored."""
        rest, spaced = self.plain(text.lower().replace("\0", " "))
        whole = "".join(self.chunk(x) if x and not x.isspace() else x for x in _BETWEEN.split(rest)) if spaced or _ODD.search(rest) else rest
        parts = whole.split("\n\0 ")
        return parts[0] + "".join(w + p for w, p in zip(spaced, parts[1:]))

    def words(self, text: str) -> set[str]:
        """The words of the restored text."""
        rest, spaced = self.plain(text.lower().replace("\0", " "))
        found, odd = set(), spaced
        for c in set(rest.split()):
            # a chunk without its outer marks is a word, or something odd
            if c.isalpha() or (c := c.strip(_MARKS)).isalpha():
                found.add(c)
            elif c:
                odd.append(self.chunk(c))
        if _REPEATED.search(" ".join(found)):
            repeated = {c for c in found if _REPEATED.search(c)}
            found -= repeated
            odd += map(self.chunk, repeated)
        found.update(_WORD.findall(" ".join(odd)))
        return found


@dataclass
class Model:
    """Words, their weights, the bias, and the character costs; weights are empty if a label was missing."""

    words: list[str]
    weights: np.ndarray
    bias: float
    costs: np.ndarray
    index: dict[str, int] = field(default_factory=dict)
    stems: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.index = {w: i for i, w in enumerate(self.words)}
        self.stems = {w[: BEGINNINGS[0]] for w in self.words if w.endswith("*")}

    def score(self, words: set[str]) -> float:
        found = {self.index[w] for w in words & self.index.keys()}
        for w in [w for w in words if w[: BEGINNINGS[0]] in self.stems]:
            found.update(self.index[f] for f in features({w}) if f in self.index)
        z = self.bias + sum(float(self.weights[i]) for i in sorted(found))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model:
    """A model from the rows of docs that labels marks 0 or 1; the character model from every row of docs.

    Null labels and keys teach nothing; of several labels for a key the largest counts. If either label is missing,
    every text scores the share of label 1 (0.0 without labels).
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    costs = character_costs(character_counts(rows))
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / total if total else 0.0
        return Model([], np.zeros(0), math.log(max(share, 1e-9) / max(1 - share, 1e-9)), costs)
    spread = 1 << 30
    most = F.when(F.col("y") == 1, F.lit(min(spread, spread * 5 // 4 * (sample + 100) // counts[1]))).otherwise(F.lit(min(spread, spread * 5 // 4 * (sample + 100) // counts[0])))
    marks = marks.withColumn("draw", F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("toxicity")), F.lit(spread)))
    # the first of each label in the order of the draw, of a few more than are wanted: 2 x sample keys at most
    of = lambda y: marks.filter((F.col("y") == y) & (F.col("draw") < most)).orderBy("draw", "key").limit(sample).drop("draw")
    picked = of(0).unionByName(of(1))
    shared = spark.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for b in batches:
            words = [sorted(features(restorer.words(t))) for t in texts(b)]
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "words": pa.array(words, pa.list_(pa.string()))})

    seen = staged(rows.join(F.broadcast(picked), "key").select("y", "text").mapInArrow(run, "y int, words array<string>"), "toxicity", docs.count())
    n = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    model = Model([], np.zeros(0), math.log((n1 + 0.5) / (n0 + 0.5)), costs)
    if n1 and n0:
        # log-likelihood ratio of a word's presence against the label, and only words that speak for either clearly
        part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        share = (a + b) / (n1 + n0)
        ratio = 2 * (part(a, share * n1) + part(b, share * n0) + part(n1 - a, (1 - share) * n1) + part(n0 - b, (1 - share) * n0))
        best = (
            seen.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
            .withColumn("g", ratio).filter((F.col("g") >= RATIO) & (a / n1 > b / n0)).orderBy(F.desc("g"), "word").limit(vocabulary)
        )
        words = [r["word"] for r in best.collect()]
        where = {w: i for i, w in enumerate(words)}

        def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [[where[w] for w in ws.as_py() or [] if w in where] for ws in batch.column("words")]
                yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "at": pa.array(got, pa.list_(pa.int32()))})

        if words:
            grouped = seen.mapInArrow(present, "y int, at array<int>").groupBy("y", "at").agg(F.count("*").alias("n")).orderBy("y", "at").collect()
            x, y, many = np.zeros((len(grouped), len(words))), np.zeros(len(grouped)), np.zeros(len(grouped))
            for i, r in enumerate(grouped):
                x[i, list(r["at"])] = 1.0
                y[i], many[i] = r["y"], r["n"]
            model = Model(words, *weighted(x, y, many), costs)
    release(seen)
    return model


def weighted(x: np.ndarray, y: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of an l2-penalised logistic regression on rows that stand for many equal ones (Adam steps)."""
    w, b, l2 = np.zeros(x.shape[1]), float(np.log((many @ y + 0.5) / (many @ (1 - y) + 0.5))), 0.02
    vw, vb, mw, mb = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    for t in range(1, 801):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = many * (p - y)
        gw, gb = x.T @ e + l2 * w, float(e.sum())
        mw, mb, vw, vb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.99 * vw + 0.01 * gw * gw, 0.99 * vb + 0.01 * gb * gb
        c1, c2, rate = 1 - 0.9**t, 1 - 0.99**t, 0.1 * (1 - t / 900)
        w -= rate * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", restored: bool = False) -> DataFrame:
    """key, held_out, score, predicted (and, with restored=True, the restored text) for every row of df.

    Null and empty texts have no words and score what the bias gives. Equal texts score equally; repeated rows and
    keys each give a row; other columns are not read.
    """
    tune(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), (remainder(key, 5) == 0).alias("held_out"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = Restorer(m.costs)
        for b in batches:
            s = [m.score(restorer.words(t)) for t in texts(b)]
            out = {"key": b.column("key"), "held_out": b.column("held_out"), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in s], pa.int32())}
            if restored:
                out["restored"] = pa.array([restorer.text(t) for t in texts(b)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "key " + rows.schema["key"].dataType.simpleString() + ", held_out boolean, score double, predicted int" + ", restored string" * restored
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def assess(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """score() for every row of df, learned from the labels whose crc32(key as text) modulo 5 is not 0."""
    return score(df, fit(df, labels.filter(remainder(key, 5) != 0), key, text, label), key, text)


def keep(df: DataFrame, model: Model, text: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of df, all columns as they are, that score less than below.

    Each row is judged by its text alone: equal texts fare equally, null and empty ones score what the bias gives,
    repeated rows and keys stay as they are, an empty table stays empty.
    """
    tune(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = Restorer(m.costs)
        for b in batches:
            yield b.filter(pa.array([m.score(restorer.words(t)) < below for t in texts(b, text)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
