"""Few-shot methods over graphs of an item's parts: regions with class texts, and patches; trained on support sets."""

from __future__ import annotations

import copy
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from verdigris.operators.classifiers import SCALE, SHARPNESS, WEIGHTS, Judge, counted, f1_of, first_best, macro_f1, one_hot, per_class, softmax, unit
from verdigris.operators.gradients import Adam, Var, cross_entropy
from verdigris.operators.graphnet import OBJECT, TEXT, WHOLE, Network, Nodes, pooled

# The grid of the second cache's weight and sharpness, the share of label smoothing, the epochs of the second keys.
SECOND_WEIGHTS, SECOND_SHARPNESS = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0), (1.0, 3.0, 5.0, 7.0, 9.0)
SMOOTHING, SECOND_EPOCHS = 0.1, 20
#: Items of a slice, whose graphs a processor's cache can hold.
SLICE = 64


@dataclass
class Parts:
    """Items x [n, d] with labels y, their nodes [n, k, d], mask [n, k] and geometry [n, k, 6] (centre, size, score, kind);
    a second backbone's vectors, and further views of each item [n, v, d] to train with."""

    x: np.ndarray
    y: np.ndarray
    nodes: np.ndarray
    mask: np.ndarray
    geometry: np.ndarray
    x2: np.ndarray | None = None
    views: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.y)

    def cut(self, rows: int = SLICE) -> list[Parts]:
        """In slices, one at least, so that a pass holds the graphs of a slice only."""
        part = lambda x, i: None if x is None else x[i : i + rows]
        return [Parts(*(part(x, i) for x in (self.x, self.y, self.nodes, self.mask, self.geometry, self.x2, self.views))) for i in range(0, max(1, len(self)), rows)]

    def seen(self, rng: np.random.Generator, drop: float) -> Parts:
        """As an epoch of training sees them: one view of each item at random, a share of the nodes left out."""
        x = self.x if self.views is None else self.views[np.arange(len(self)), rng.integers(0, self.views.shape[1], len(self))]
        return replace(self, x=x, mask=self.mask * (rng.random(self.mask.shape) >= drop))


#: The classes [options, n] that each of some options predicts for n items.
Answers = Callable[[Parts], np.ndarray]


def judge_of(validation: Parts | Judge, classes: int) -> Judge:
    """Of items at hand, or what is a judge already."""
    if callable(validation):
        return validation
    return lambda answers: f1_of(sum(counted(answers(x), x.y, classes) for x in validation.cut())) if len(validation) else None


@dataclass
class RegionGraph:
    """An item's regions and the class texts as one graph. It moves the item's vector and, item by item, the texts.

    Scores are the sum of: text (SCALE cos with the class texts), cache (weight times the votes of the support set's
    moved vectors), prototype (a learned share of SCALE cos with the moved texts) and, with second, the votes of a
    second backbone's support vectors. moved_queries: whether the moved vector asks, or the plain one; texts: whether
    class texts are nodes; kinds: the regions that are looked at besides the object; most: how many nodes of an item.
    """

    text: np.ndarray
    hidden: int = 256
    rounds: int = 2
    heads: int = 4
    epochs: int = 60
    rate: float = 1e-3
    drop: float = 0.2
    moved_queries: bool = True
    texts: bool = True
    gated: bool = True
    placed: bool = True
    kinds: tuple[int, ...] | None = None
    most: int | None = None
    second: bool = False
    seed: int = 0
    params: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.network = Network(self.text.shape[1], self.hidden, self.rounds, self.heads, self.gated, self.placed)

    def start(self) -> dict[str, np.ndarray]:
        rng, d = np.random.default_rng(self.seed), self.text.shape[1]
        small = lambda rows: rng.normal(0, 0.1 / np.sqrt(rows), (rows, d))
        p = self.network.start(rng) | {"move": small(3 * self.hidden), "weight": np.array([5.0]), "sharp": np.array([5.0])}
        return p | ({"move_text": small(self.hidden), "share": np.array([0.5])} if self.texts else {})

    @property
    def size(self) -> int:
        """The number of trained values."""
        return sum(v.size for v in (self.params or self.start()).values())

    def graph(self, b: Parts) -> tuple[Nodes, int]:
        """The items' node tables, and how many of the nodes, from the first, are of the picture."""
        k = b.nodes.shape[1] if self.most is None else min(b.nodes.shape[1], self.most)
        kind = b.geometry[:, :k, 5].astype(int).clip(WHOLE, TEXT - 1)
        live = b.mask[:, :k] > 0
        if self.kinds is not None:
            live = live & np.isin(kind, (OBJECT, *self.kinds))
        tables = [Nodes.alike(b.x[:, None], WHOLE, (0.5, 0.5, 1.0, 1.0, 1.0)), Nodes(b.nodes[:, :k], kind, b.geometry[:, :k, :5], live)]
        if self.texts:
            tables.append(Nodes.alike(np.broadcast_to(self.text, (len(b), *self.text.shape)), TEXT))
        return Nodes.side_by_side(tables), 1 + k

    def moved(self, p: dict[str, Var], b: Parts) -> tuple[Var, Var | None]:
        """The items' vectors [n, d] and, if texts are nodes, their own class texts [n, classes, d]."""
        nodes, pictured = self.graph(b)
        h = self.network.states(p, nodes)
        item = (Var(b.x) + pooled(h[:, :pictured], nodes.live[:, :pictured], p["ask"]) @ p["move"]).unit()
        return item, (Var(nodes.vector[:, pictured:]) + h[:, pictured:] @ p["move_text"]).unit() if self.texts else None

    def terms(self, p: dict[str, Var], b: Parts, keys: Var) -> dict[str, Var]:
        """[n, classes] parts of the scores, by name."""
        item, own_texts = self.moved(p, b) if self.texts or self.moved_queries else (None, None)
        asks = item if self.moved_queries else Var(b.x)
        out = {"text": Var(SCALE * b.x @ self.text.T), "cache": p["weight"] * votes(asks, keys, p["sharp"], self.values)}
        if own_texts is not None:
            n, c, d = own_texts.shape
            out["prototype"] = p["share"] * SCALE * (own_texts @ asks.reshape(n, d, 1)).reshape(n, c)
        return out

    def fit(self, support: Parts, validation: Parts | Judge) -> RegionGraph:
        """Trained to tell the support set; of every fifth epoch the best on validation, then weight and sharpness by grid.
        The epochs are judged together after the last one, as training does not depend on validation."""
        self.values, judge = per_class(one_hot(support.y, len(self.text))), judge_of(validation, len(self.text))
        self.second_keys, self.second_option = None, (0.0, 1.0)
        rng, opt = np.random.default_rng(self.seed + 1), Adam(self.start(), self.rate, self.epochs)

        def loss(p: dict[str, Var]) -> Var:
            keys = self.moved(p, support.seen(rng, self.drop))[0]
            return cross_entropy(total(self.terms(p, support.seen(rng, self.drop), keys)), support.y, SMOOTHING)

        kept = [] if self.epochs else [opt.params]
        for epoch in range(self.epochs):
            opt.step(loss)
            if epoch % 5 == 4 or epoch == self.epochs - 1:
                kept.append(dict(opt.params))
        models = [copy.copy(self) for _ in kept]
        for m, params in zip(models, kept):
            m.settle(params, support)
        f1 = judge(lambda b: np.stack([m.logits(b).argmax(1) for m in models]))
        self.settle(kept[-1] if f1 is None else kept[int(f1.argmax())], support)
        if self.second:
            self.second_keys = self.train_second(support)
        if f1 is not None:
            self.tune(judge)
        return self

    def settle(self, params: dict[str, np.ndarray], support: Parts) -> None:
        """Take parameters over, and the support set's vectors as they move it."""
        self.params = dict(params)
        self.keys = self.moved(leaves(self.params), support)[0].value

    def train_second(self, support: Parts) -> np.ndarray:
        """The second backbone's support vectors, trained as keys against the scores of all else."""
        base, opt = self.logits(replace(support, x2=None)), Adam({"keys": unit(support.x2)}, self.rate, SECOND_EPOCHS)
        for _ in range(SECOND_EPOCHS):
            opt.step(lambda p: cross_entropy(Var(base) + 5.0 * votes(Var(unit(support.x2)), p["keys"].unit(), 5.0, self.values), support.y, SMOOTHING))
        return unit(opt.params["keys"])

    def tune(self, judge: Judge) -> None:
        """Weight and sharpness of the cache, then of the second one, by macro-F1 on validation; the first of equal ones."""
        options = list(itertools.product(WEIGHTS, SHARPNESS))
        now = copy.copy(self)

        def said(b: Parts) -> tuple[np.ndarray, dict[float, np.ndarray]]:
            """What all but the caches say, and the votes of the cache at each sharpness."""
            parts = now.explained(replace(b, x2=None))
            p = leaves(now.params)
            asks = Var(np.concatenate([now.moved(p, x)[0].value for x in b.cut()]) if now.moved_queries else b.x)
            return sum(v for k, v in parts.items() if k != "cache"), {s: votes(asks, Var(now.keys), s, now.values).value for s in SHARPNESS}

        def first(b: Parts) -> np.ndarray:
            rest, by = said(b)
            return np.stack([(rest + w * by[s]).argmax(1) for w, s in options])

        weight, sharp = options[int(judge(first).argmax())]
        self.params |= {"weight": np.array([float(weight)]), "sharp": np.array([float(sharp)])}
        if self.second:
            others = list(itertools.product(SECOND_WEIGHTS, SECOND_SHARPNESS))

            def second(b: Parts) -> np.ndarray:
                rest, by = said(b)
                other = {s: votes(Var(unit(b.x2)), Var(now.second_keys), s, now.values).value for s in SECOND_SHARPNESS}
                return np.stack([(rest + weight * by[sharp] + w * other[s]).argmax(1) for w, s in others])

            self.second_option = others[int(judge(second).argmax())]

    def explained(self, b: Parts) -> dict[str, np.ndarray]:
        """The parts of the scores by name; they add up to the logits."""
        p, keys = leaves(self.params), Var(self.keys)
        slices = [{k: v.value for k, v in self.terms(p, x, keys).items()} for x in b.cut()]
        out = {k: np.concatenate([x[k] for x in slices]) for k in slices[0]}
        if self.second_keys is not None and b.x2 is not None:
            weight, sharp = self.second_option
            out["second"] = weight * votes(Var(unit(b.x2)), Var(self.second_keys), sharp, self.values).value
        return out

    def logits(self, b: Parts) -> np.ndarray:
        return sum(self.explained(b).values())

    def f1(self, b: Parts) -> float:
        return macro_f1(self.logits(b).argmax(1), b.y, len(self.text)) if len(b) else 0.0

    def importance(self, b: Parts) -> np.ndarray:
        """[n, k]: how much the predicted class's margin falls without a node; 0 for nodes that are masked already."""
        n, k = b.mask.shape
        pred = self.logits(b).argmax(1)
        # every item once whole and once without each of its nodes
        each = lambda x: None if x is None else np.repeat(x, k + 1, 0)
        without = (each(b.mask).reshape(n, k + 1, k) * (1 - np.eye(k + 1, k, -1))).reshape(-1, k)
        z = self.logits(Parts(each(b.x), each(b.y), each(b.nodes), without, each(b.geometry), each(b.x2))).reshape(n, k + 1, -1)
        chosen = np.arange(z.shape[2]) == pred[:, None, None]
        margin = np.where(chosen, z, -np.inf).max(2) - np.where(chosen, -np.inf, z).max(2)
        return np.where(b.mask > 0, margin[:, :1] - margin[:, 1:], 0.0)


def aggregated(h: Var, how: str, warmth: Var) -> Var:
    """[n, d]: the patches' [n, k, d] mean, max, min, deviation of the sample, or mean weighted by softmax(warmth h), in each number."""
    if how == "mean":
        return h.mean(1, False)
    if how == "max":
        return h.max(1)
    if how == "min":
        return -(-h).max(1)
    if how == "std":
        apart = h - h.mean(1)
        return ((apart * apart).sum(1, False) * (1.0 / max(1, h.shape[1] - 1)) + 1e-12).power(0.5)
    weights = (h * warmth).transpose(0, 2, 1).softmax().transpose(0, 2, 1)
    return (weights * h).sum(1, False)


def leaves(params: dict[str, np.ndarray]) -> dict[str, Var]:
    return {k: Var(v) for k, v in params.items()}


def total(parts: dict[str, Var]) -> Var:
    first, *rest = parts.values()
    for x in rest:
        first = first + x
    return first


def votes(asks: Var, keys: Var, sharp: Var | float, values: np.ndarray) -> Var:
    """[n, classes]: exp(-sharp (1 - cos)) of each key, shared out to its class."""
    return ((asks @ keys.transpose(1, 0) - 1.0) * sharp).exp() @ values


# What each ablation and each candidate of the selection changes in RegionGraph.
ABLATIONS: dict[str, dict] = {
    "full": {},
    "no-text-nodes": {"texts": False},
    "no-gate": {"gated": False},
    "no-geometry": {"placed": False},
    "object-only": {"most": 1},
    "instances-only": {"kinds": (2,)},
    "spots-only": {"kinds": (3,)},
    "train-only-graph": {"moved_queries": False},
}
CANDIDATES: dict[str, dict] = {
    "full": {},
    "train-only-graph": {"moved_queries": False},
    "no-geometry": {"placed": False},
    "spots-only": {"kinds": (3,)},
    "train-only+no-geometry": {"moved_queries": False, "placed": False},
    "full-H128": {"hidden": 128},
    "train-only-graph-H128": {"moved_queries": False, "hidden": 128},
    "full+second-cache": {"second": True},
    "train-only-graph+second-cache": {"moved_queries": False, "second": True},
}


class PatchGraph:
    """A cache queried in training by vectors that a relational graph over an item's patches refines, and afterwards by
    the plain vector. mode: both attentions, the additive or the multiplicative one only, or no edges between patches;
    pools: aggregations put together; graph=False trains the keys with plain queries."""

    def __init__(self, text: np.ndarray, layers: int = 2, mode: str = "both", pools: tuple[str, ...] = ("mean", "max", "std"), weight: float = 5.0, sharp: float = 5.0, epochs: int = 20, rate: float = 1e-3, graph: bool = True, last: str = "relu", seed: int = 0):
        self.text, self.layers, self.mode, self.pools, self.weight, self.sharp = text, layers, mode, pools, weight, sharp
        self.epochs, self.rate, self.graph, self.last, self.seed = epochs, rate, graph, last, seed

    def start(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        d, rng = self.text.shape[1], np.random.default_rng(self.seed)
        p = {"keys": keys.copy()}
        if self.graph:
            for i in range(self.layers):
                p |= {f"w{i}": np.eye(d), f"a{i}": rng.uniform(-1, 1, (d, 1)) * np.sqrt(6 / (2 * d)), f"b{i}": rng.uniform(-1, 1, (d, 1)) * np.sqrt(6 / (2 * d))}
            p |= {f"pool_{m}": np.eye(d) / len(self.pools) for m in self.pools} | {"warmth": np.ones(1)}
        return p

    def refined(self, p: dict[str, Var], patches: np.ndarray) -> Var:
        h = Var(patches)
        n, k, d = patches.shape
        for i in range(self.layers):
            w = h @ p[f"w{i}"]
            if self.mode != "no_edges":
                add = (w @ p[f"a{i}"]) + (w @ p[f"b{i}"]).transpose(0, 2, 1)
                times = (w @ w.transpose(0, 2, 1)).sigmoid()
                e = {"both": lambda: add * times, "additive": lambda: add, "multiplicative": lambda: times}[self.mode]()
                w = e.leaky(0.2).softmax() @ w
            h = w if i == self.layers - 1 and self.last == "identity" else w.leaky()
        return total({m: aggregated(h, m, p["warmth"]) @ p[f"pool_{m}"] for m in self.pools}).unit()

    def fit(self, support: Parts, validation: Parts | Judge) -> PatchGraph:
        """The epoch of best validation macro-F1 stays, 0 included; then weight and sharpness by grid."""
        self.values, judge = per_class(one_hot(support.y, len(self.text))), judge_of(validation, len(self.text))
        opt = Adam(self.start(unit(support.x)), self.rate, self.epochs)

        def loss(p: dict[str, Var]) -> Var:
            q = self.refined(p, support.nodes) if self.graph else Var(support.x)
            return cross_entropy(SCALE * (q @ self.text.T) + self.weight * votes(q, p["keys"], self.sharp, self.values), support.y)

        kept = [opt.params["keys"]]
        for _ in range(self.epochs):
            opt.step(loss)
            kept.append(opt.params["keys"])
        self.best, now = (self.weight, self.sharp), copy.copy(self)
        f1 = judge(lambda b: np.stack([now.scores(b, keys, now.weight, now.sharp).argmax(1) for keys in kept]))
        self.best_epoch = self.epochs if f1 is None else int(f1.argmax())
        self.keys = kept[self.best_epoch]
        if f1 is not None:
            options, keys = list(itertools.product(WEIGHTS, SHARPNESS)), self.keys
            self.best = options[int(judge(lambda b: np.stack([now.scores(b, keys, *o).argmax(1) for o in options])).argmax())]
        return self

    def scores(self, b: Parts, keys: np.ndarray, weight: float, sharp: float) -> np.ndarray:
        return SCALE * b.x @ self.text.T + weight * np.exp(-sharp * (1 - b.x @ keys.T)) @ self.values

    def logits(self, b: Parts) -> np.ndarray:
        return self.scores(b, self.keys, *self.best)

    def f1(self, b: Parts) -> float:
        return macro_f1(self.logits(b).argmax(1), b.y, len(self.text)) if len(b) else 0.0


# The configurations of the patch graph that are compared, and the weights and sharpnesses trained with.
CONFIGURATIONS: dict[str, dict] = {
    "exact": {},
    "additive": {"mode": "additive"},
    "multiplicative": {"mode": "multiplicative"},
    "no-edges": {"mode": "no_edges"},
    "min-max-softmax": {"pools": ("min", "max", "softmax")},
    "last-identity": {"last": "identity"},
    "no-graph": {"graph": False},
}
TRAINED_WITH = ((1.0, 1.0), (10.0, 1.0), (10.0, 5.0))


def select_patch_graph(text: np.ndarray, support: Parts, validation: Parts, epochs: int = 20, **options) -> tuple[PatchGraph, list[dict]]:
    """The patch graph of best validation macro-F1 over one and two layers and TRAINED_WITH, the first of equal ones; and all of them as rows."""
    tried = [PatchGraph(text, layers=n, weight=a, sharp=b, epochs=epochs, **options).fit(support, validation) for n in (1, 2) for a, b in TRAINED_WITH]
    rows = [{"layers": m.layers, "weight": m.weight, "sharp": m.sharp, "best_epoch": m.best_epoch, "val_f1": m.f1(validation)} for m in tried]
    return first_best(tried, lambda m: m.f1(validation)), rows


def probabilities(method: RegionGraph | PatchGraph, b: Parts) -> np.ndarray:
    return softmax(method.logits(b))
