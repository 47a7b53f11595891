"""Few-shot classifiers on embeddings: fit on a bounded support set, predict by streaming any number of rows through.

A method has fit(support, validation) and logits(features); its fitted state is small and travels to the
tasks. Training is numpy on the driver: a support set has at most a few thousand rows, and separate
(method, size, seed) fits are what parallelism is for.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Grids of cache weight and sharpness, and of two caches.
WEIGHTS, SHARPNESS = (0.5, 1, 2, 3, 5, 8, 12), (1, 3, 5, 7, 9)
TWO_WEIGHTS, TWO_SHARPNESS = (0.5, 1, 2, 4, 8), (1, 3, 5, 7)
SCALE = 100.0


@dataclass
class Batch:
    """Features x [n, d], labels y [n], and optionally a second backbone's features x2 [n, d2]."""

    x: np.ndarray
    y: np.ndarray
    x2: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.y)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-8)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def one_hot(y: np.ndarray, classes: int) -> np.ndarray:
    return (y[:, None] == np.arange(classes)).astype(float)


def per_class(one: np.ndarray) -> np.ndarray:
    """One-hot labels over the number of rows of their class (1 at least)."""
    return one / np.maximum(1, one.sum(0))


def macro_f1(pred: np.ndarray, y: np.ndarray, classes: int) -> float:
    """Mean F1 over all classes; a class that neither occurs nor is predicted counts 0."""
    tp = np.array([((pred == c) & (y == c)).sum() for c in range(classes)])
    both = np.bincount(pred, minlength=classes) + np.bincount(y, minlength=classes)
    return float(np.divide(2 * tp, both, out=np.zeros(classes), where=both > 0).mean())


def first_best(options: list, score: Callable[[object], float]) -> object:
    """The option of largest score, the first of equal ones."""
    values = [score(o) for o in options]
    return options[int(np.argmax(values))]


#: What gives the macro-F1 of each of some options on a validation set (None without rows), from the classes [options, n]
#: that they predict for n rows of it.
Judge = Callable[[Callable], "np.ndarray | None"]


def counted(pred: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """[options, classes, 2]: how often a class is predicted rightly, and how often it is predicted plus how often it occurs;
    counts of slices add up."""
    each = lambda x: np.bincount(x, minlength=classes)
    return np.array([np.stack([each(y[p == y]), each(p) + each(y)], 1) for p in pred])


def f1_of(counts: np.ndarray) -> np.ndarray | None:
    """Macro-F1 of each option; a class that neither occurs nor is predicted counts 0."""
    hits, both = counts[..., 0], counts[..., 1]
    return np.divide(2 * hits, both, out=np.zeros(both.shape), where=both > 0).mean(1) if both.any() else None


def judge_of(validation: Batch | Judge, classes: int) -> Judge:
    """Of rows at hand, or what is a judge already."""
    if callable(validation):
        return validation
    return lambda answers: f1_of(counted(answers(validation), validation.y, classes)) if len(validation) else None


class Method:
    """Scores of classes from text vectors [classes, d].

    pick: trained methods keep the checked epoch of best validation macro-F1 instead of the last.
    """

    pick = False

    def __init__(self, text: np.ndarray):
        self.text = text

    def fit(self, support: Batch, validation: Batch | Judge) -> Method:
        return self

    def logits(self, x: np.ndarray, x2: np.ndarray | None = None) -> np.ndarray:
        raise NotImplementedError

    def f1(self, b: Batch | Judge) -> float:
        f1 = judge_of(b, len(self.text))(lambda x: self.logits(x.x, x.x2).argmax(1)[None])
        return 0.0 if f1 is None else float(f1[0])


class ZeroShot(Method):
    def logits(self, x, x2=None):
        return SCALE * x @ self.text.T


class NearestNeighbour(Method):
    """The class of the nearest support row."""

    def fit(self, support, validation):
        self.keys, self.y = support.x, support.y
        return self

    def logits(self, x, x2=None):
        s = x @ self.keys.T
        return np.stack([s[:, self.y == c].max(1, initial=-2.0) for c in range(len(self.text))], 1)


class Cache(Method):
    """Zero-shot scores plus weight * sum of exp(-sharpness (1 - cos)) over a class's support rows, over their number."""

    def affinity(self, x: np.ndarray, keys: np.ndarray, sharpness: float) -> np.ndarray:
        return np.exp(-sharpness * (1 - x @ keys.T))

    def fit(self, support, validation):
        self.keys, self.values = unit(support.x), per_class(one_hot(support.y, len(self.text)))
        return self.tune(validation)

    def tune(self, validation: Batch | Judge) -> Cache:
        options = list(itertools.product(WEIGHTS, SHARPNESS))

        def answers(v: Batch) -> np.ndarray:
            z = SCALE * v.x @ self.text.T
            votes = {b: self.affinity(v.x, self.keys, b) @ self.values for b in SHARPNESS}
            return np.stack([(z + a * votes[b]).argmax(1) for a, b in options])

        f1 = judge_of(validation, len(self.text))(answers)
        self.weight, self.sharpness = (1.0, 5.0) if f1 is None else options[int(f1.argmax())]
        return self

    def logits(self, x, x2=None):
        return SCALE * x @ self.text.T + self.weight * self.affinity(x, self.keys, self.sharpness) @ self.values


def checked_epochs(epochs: int) -> set[int]:
    """Ten evenly spaced epochs, and the last."""
    every = max(1, epochs // 10)
    return {*range(every, epochs + 1, every), epochs}


def adam(params: list[np.ndarray], loss: Callable, steps: int, rate: float, decay: float = 0.01, score: Callable | None = None) -> list[np.ndarray]:
    """Parameters after AdamW steps with a cosine schedule; loss(params) gives the gradients too.

    With score, those of the checked epoch that scores best, the first of equal ones.
    """
    best, looks = None, checked_epochs(steps) if score else set()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        _, grads = loss(params)
        now = rate * 0.5 * (1 + np.cos(np.pi * (t - 1) / steps))
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] * (1 - now * decay) - now * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if t in looks and (best is None or score(params) > best[0]):
            best = (score(params), [p.copy() for p in params])
    return best[1] if best else params


def cross_entropy(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss and its gradient by the logits."""
    p = softmax(z)
    n = len(y)
    loss = float(-np.log(np.maximum(p[np.arange(n), y], 1e-300)).mean())
    p[np.arange(n), y] -= 1
    return loss, p / n


def through_unit(u: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """The gradient by u of what has gradient grad by unit(u)."""
    n = np.maximum(np.linalg.norm(u, axis=-1, keepdims=True), 1e-8)
    w = u / n
    return (grad - w * (w * grad).sum(-1, keepdims=True)) / n


class TrainedCache(Cache):
    """A cache whose keys are trained on the support rows, with weight and sharpness 5 meanwhile."""

    epochs, rate = 20, 1e-3

    def loss(self, params: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        a = self.affinity(x, params[0], 5.0)
        loss, dz = cross_entropy(SCALE * x @ self.text.T + 5.0 * a @ self.values, y)
        return loss, [((dz @ self.values.T) * 25.0 * a).T @ x]

    def fit(self, support, validation):
        self.keys, self.values = unit(support.x), per_class(one_hot(support.y, len(self.text)))

        def score(p: list[np.ndarray]) -> float:
            self.keys = p[0]
            return self.tune(validation).f1(validation)

        self.keys = adam([self.keys], lambda p: self.loss(p, support.x, support.y), self.epochs, self.rate, score=score if self.pick and (callable(validation) or len(validation)) else None)[0]
        return self.tune(validation)


class TwoCaches(Method):
    """Zero-shot scores plus two caches, one for each backbone, keys trained; weights and sharpness by grid on validation."""

    epochs, rate = 20, 1e-3

    def parts(self, x, x2, k1, k2, b):
        return np.exp(-b * (1 - x @ k1.T)), np.exp(-b * (1 - x2 @ k2.T))

    def loss(self, params, x, x2, y):
        a, c = self.parts(x, x2, *params, 5.0)
        loss, dz = cross_entropy(SCALE * x @ self.text.T + 2.5 * (a + c) @ self.values, y)
        g = dz @ self.values.T * 12.5
        return loss, [(g * a).T @ x, (g * c).T @ x2]

    def fit(self, support, validation):
        self.values = per_class(one_hot(support.y, len(self.text)))
        self.weights = (1.0, 1.0, 5.0)

        def score(p: list[np.ndarray]) -> float:
            self.keys = p
            return self.tune(validation).f1(validation)

        self.keys = adam([unit(support.x), unit(support.x2)], lambda p: self.loss(p, support.x, support.x2, support.y), self.epochs, self.rate, score=score if self.pick and (callable(validation) or len(validation)) else None)
        return self.tune(validation)

    def tune(self, validation: Batch | Judge) -> TwoCaches:
        options = list(itertools.product(TWO_WEIGHTS, TWO_WEIGHTS, TWO_SHARPNESS))

        def answers(v: Batch) -> np.ndarray:
            z = SCALE * v.x @ self.text.T
            votes = {b: [a @ self.values for a in self.parts(v.x, v.x2, *self.keys, b)] for b in TWO_SHARPNESS}
            return np.stack([(z + o[0] * votes[o[2]][0] + o[1] * votes[o[2]][1]).argmax(1) for o in options])

        f1 = judge_of(validation, len(self.text))(answers)
        if f1 is not None:
            self.weights = options[int(f1.argmax())]
        return self

    def logits(self, x, x2=None):
        a, c = self.parts(x, x2, *self.keys, self.weights[2])
        return SCALE * x @ self.text.T + self.weights[0] * a @ self.values + self.weights[1] * c @ self.values


class Adapter(Method):
    """Trained once for each setting of its grid; the setting of best validation macro-F1 stays, the first of equal ones."""

    grid: tuple = ()
    epochs, rate = 50, 1e-3

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "look"}  # what looks at validation stays on the driver

    def start(self, support: Batch, option: float) -> list[np.ndarray]:
        raise NotImplementedError

    def loss(self, params: list[np.ndarray], x: np.ndarray, y: np.ndarray, option: float) -> tuple[float, list[np.ndarray]]:
        raise NotImplementedError

    def train(self, params: list[np.ndarray], support: Batch, option: float) -> list[np.ndarray]:
        return adam(params, lambda p: self.loss(p, support.x, support.y, option), self.epochs, self.rate, score=self.look)

    def fit(self, support, validation):
        def score(p: list[np.ndarray]) -> float:
            self.params = p
            return self.f1(validation)

        best, self.look = None, score if self.pick and (callable(validation) or len(validation)) else None
        for option in self.grid:
            self.option = option
            self.params, self.option = self.train(self.start(support, option), support, option), option
            score = self.f1(validation)
            if best is None or score > best[0]:
                best = (score, self.params, option)
        _, self.params, self.option = best
        self.look = None
        return self


class TaskResidual(Adapter):
    """Class vectors text + a R, R trained from 0."""

    grid = (0.5, 1.0)

    def start(self, support, option):
        return [np.zeros_like(self.text)]

    def loss(self, params, x, y, a):
        u = self.text + a * params[0]
        loss, dz = cross_entropy(SCALE * x @ unit(u).T, y)
        return loss, [a * through_unit(u, SCALE * dz.T @ x)]

    def logits(self, x, x2=None):
        return SCALE * x @ unit(self.text + self.option * self.params[0]).T


class FeatureAdapter(Adapter):
    """Features r MLP(x) + (1 - r) x, a bottleneck of a quarter of the width."""

    grid = (0.2, 0.6)

    def start(self, support, option):
        d = self.text.shape[1]
        rng = np.random.default_rng(0)
        return [rng.uniform(-1, 1, (max(1, d // 4), d)) / np.sqrt(d), rng.uniform(-1, 1, (d, max(1, d // 4))) / np.sqrt(max(1, d // 4))]

    def forward(self, params, x, r):
        a = np.maximum(0, x @ params[0].T)
        b = np.maximum(0, a @ params[1].T)
        return a, b, r * b + (1 - r) * x

    def loss(self, params, x, y, r):
        a, b, u = self.forward(params, x, r)
        loss, dz = cross_entropy(SCALE * unit(u) @ self.text.T, y)
        db = r * through_unit(u, SCALE * dz @ self.text) * (b > 0)
        return loss, [((db @ params[1]) * (a > 0)).T @ x, db.T @ a]

    def logits(self, x, x2=None):
        return SCALE * unit(self.forward(self.params, x, self.option)[2]) @ self.text.T


class ClassAdaptiveProbe(Adapter):
    """Class vectors trained from text, held to it the more the surer zero-shot is of the class; the grid is the learning rate."""

    grid, epochs = (0.1, 0.01), 300

    def start(self, support, option):
        p = softmax(SCALE * support.x @ self.text.T)
        self.pull = np.array([p[support.y == c, c].mean() if (support.y == c).any() else 0.0 for c in range(len(self.text))])
        return [self.text.copy()]

    def loss(self, params, x, y, option):
        w = params[0]
        loss, dz = cross_entropy(SCALE * x @ unit(w).T, y)
        off = w - self.text
        return loss + float((self.pull[:, None] * off * off).sum() / len(w)), [through_unit(w, SCALE * dz.T @ x) + 2 * self.pull[:, None] * off / len(w)]

    def train(self, params, support, option):
        best = None
        for t in range(self.epochs):
            g = self.loss(params, support.x, support.y, option)[1][0]
            params = [params[0] - option * 0.5 * (1 + np.cos(np.pi * t / self.epochs)) * g / max(1.0, np.linalg.norm(g))]
            if self.look and t + 1 in checked_epochs(self.epochs) and (best is None or self.look(params) > best[0]):
                best = (self.look(params), params)
        return best[1] if best else params

    def logits(self, x, x2=None):
        return SCALE * x @ unit(self.params[0]).T


class TextGraph(Adapter):
    """Text vectors mixed with a graph convolution over text and support prototypes, b the share of the refined ones."""

    grid = (0.3, 0.6)

    def start(self, support, option):
        c = len(self.text)
        means = np.stack([support.x[support.y == i].mean(0) if (support.y == i).any() else self.text[i] for i in range(c)])
        nodes = np.vstack([self.text, unit(means)])
        a = np.maximum(0, nodes @ nodes.T)
        d = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
        self.mixed = ((d[:, None] * a * d) @ nodes)[:c]
        return [np.eye(self.text.shape[1])]

    def vectors(self, w, b):
        g = self.mixed @ w.T
        return g, b * unit(g) + (1 - b) * self.text

    def loss(self, params, x, y, b):
        g, u = self.vectors(params[0], b)
        loss, dz = cross_entropy(SCALE * x @ unit(u).T, y)
        dg = through_unit(g, b * through_unit(u, SCALE * dz.T @ x))
        return loss, [dg.T @ self.mixed]

    def logits(self, x, x2=None):
        return SCALE * x @ unit(self.vectors(self.params[0], self.option)[1]).T


class LinearProbe(Method):
    """Multinomial logistic regression with an l2 penalty of 1 / C, C by validation; classes without rows get -inf."""

    grid = (1.0, 10.0, 100.0)

    def fit(self, support, validation):
        classes = np.unique(support.y)
        y, best = np.searchsorted(classes, support.y), None
        x = np.hstack([support.x, np.ones((len(support), 1))])
        for c in self.grid:
            w, step = np.zeros((len(classes), x.shape[1])), 1.0
            pen = np.full(x.shape[1], 1 / (c * len(x)))
            pen[-1] = 0.0
            move, before = np.zeros_like(w), np.inf
            for _ in range(400):
                loss, dz = cross_entropy(x @ w.T, y)
                loss += 0.5 * float((pen * w * w).sum())
                step = step * 0.5 if loss > before else step * 1.02
                before = loss
                move = 0.9 * move - step * (dz.T @ x + pen * w)
                w = w + move
            self.w, self.classes = w, classes
            score = self.f1(validation)
            if best is None or score > best[0]:
                best = (score, w)
        self.w = best[1]
        return self

    def logits(self, x, x2=None):
        out = np.full((len(x), len(self.text)), -np.inf)
        out[:, self.classes] = np.hstack([x, np.ones((len(x), 1))]) @ self.w.T
        return out


METHODS: dict[str, type[Method]] = {
    "zero_shot": ZeroShot, "one_nn": NearestNeighbour, "linear_probe": LinearProbe, "cache": Cache, "trained_cache": TrainedCache,
    "two_caches": TwoCaches, "task_residual": TaskResidual, "feature_adapter": FeatureAdapter, "class_adaptive": ClassAdaptiveProbe, "text_graph": TextGraph,
}


def batch(df: DataFrame, vector: str = "embedding", label: str = "label", second: str | None = None, key: str = "vec_id", most: int = 100_000) -> Batch:
    """A bounded set of rows in memory, in the order of key."""
    names = [key, vector, label, *([second] if second else [])]
    pdf = df.select(*names).limit(most + 1).toPandas().sort_values(key)
    if len(pdf) > most:
        raise ValueError(f"more than {most} rows")
    stack = lambda c: np.stack(pdf[c].to_list()).astype(float) if len(pdf) else np.zeros((0, 1))
    return Batch(stack(vector), pdf[label].to_numpy(int), stack(second) if second else None)


def predict(df: DataFrame, method: Method, key: str = "vec_id", vector: str = "embedding", second: str | None = None) -> DataFrame:
    """key, probs, pred of every row: the fitted method travels to the tasks, rows stream through in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(method)
    names = [F.col(key).alias("id"), F.col(vector).alias("v"), *([F.col(second).alias("s")] if second else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(float)
                x2 = np.stack(b.column("s").to_numpy(zero_copy_only=False)).astype(float) if second else None
                p = softmax(shared.value.logits(x, x2))
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "probs": pa.array(list(p), pa.list_(pa.float64())), "pred": pa.array(p.argmax(1).astype(np.int32))})

    return df.select(*names).mapInArrow(run, "id bigint, probs array<double>, pred int").withColumnRenamed("id", key)
