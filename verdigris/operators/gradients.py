"""Reverse-mode differentiation of numpy expressions: enough for small graph networks on support sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _fit(grad: np.ndarray, shape: tuple) -> np.ndarray:
    """A gradient summed over what broadcasting added."""
    while grad.ndim > len(shape):
        grad = grad.sum(0)
    for i, n in enumerate(shape):
        if n == 1 and grad.shape[i] != 1:
            grad = grad.sum(i, keepdims=True)
    return grad


class Var:
    """A value and how to pass its gradient on."""

    __array_priority__ = 100

    def __init__(self, value, parents: tuple = ()):
        self.value, self.parents, self.grad = np.asarray(value, np.float64), parents, None

    @property
    def shape(self) -> tuple:
        return self.value.shape

    def __add__(self, o):
        o = var(o)
        return Var(self.value + o.value, ((self, lambda g: g), (o, lambda g: g)))

    def __mul__(self, o):
        o = var(o)
        return Var(self.value * o.value, ((self, lambda g: g * o.value), (o, lambda g: g * self.value)))

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + -var(o)

    def __rsub__(self, o):
        return var(o) - self

    def __truediv__(self, o):
        return self * var(o).power(-1.0)

    def __rtruediv__(self, o):
        return var(o) / self

    __radd__, __rmul__ = __add__, __mul__

    def __matmul__(self, o):
        o = var(o)
        if self.value.ndim > 2 and o.value.ndim == 2:  # one product of all rows; numpy makes one for each matrix of a stack
            rows = lambda x: x.reshape(-1, x.shape[-1])
            out = (rows(self.value) @ o.value).reshape(*self.shape[:-1], o.shape[1])
            return Var(out, ((self, lambda g: (rows(g) @ o.value.T).reshape(self.shape)), (o, lambda g: rows(self.value).T @ rows(g))))
        return Var(self.value @ o.value, ((self, lambda g: g @ o.value.swapaxes(-1, -2)), (o, lambda g: self.value.swapaxes(-1, -2) @ g)))

    def _map(self, value: np.ndarray, slope: Callable[[], np.ndarray]) -> Var:
        """A function of each number; its slopes are worked out where a gradient is asked for."""
        return Var(value, ((self, lambda g: g * slope()),))

    def power(self, p: float) -> Var:
        return self._map(self.value**p, lambda: p * self.value ** (p - 1))

    def exp(self) -> Var:
        e = np.exp(self.value)
        return self._map(e, lambda: e)

    def log(self) -> Var:
        return self._map(np.log(self.value), lambda: 1 / self.value)

    def leaky(self, below: float = 0.0) -> Var:
        slope = np.where(self.value > 0, 1.0, below)
        return self._map(self.value * slope, lambda: slope)

    def sigmoid(self) -> Var:
        s = 1 / (1 + np.exp(-np.clip(self.value, -60, 60)))
        return self._map(s, lambda: s * (1 - s))

    def gelu(self) -> Var:
        """x times about the share of a standard normal below x (by tanh)."""
        x = self.value
        t = np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * (x * x * x)))
        return self._map(x * (1 + t) / 2, lambda: (1 + t) / 2 + x * (1 - t * t) / 2 * np.sqrt(2 / np.pi) * (1 + 0.134145 * x * x))

    def sum(self, axis: int = -1, keep: bool = True) -> Var:
        back = lambda g: np.broadcast_to(g if keep else np.expand_dims(g, axis), self.shape)
        return Var(self.value.sum(axis, keepdims=keep), ((self, back),))

    def mean(self, axis: int = -1, keep: bool = True) -> Var:
        return self.sum(axis, keep) * (1.0 / self.shape[axis])

    def max(self, axis: int, keep: bool = False) -> Var:
        top = self.value.max(axis, keepdims=True)
        hit = self.value == top
        hit = hit / hit.sum(axis, keepdims=True)
        return Var(top if keep else np.squeeze(top, axis), ((self, lambda g: (g if keep else np.expand_dims(g, axis)) * hit),))

    def reshape(self, *shape: int) -> Var:
        return Var(self.value.reshape(shape), ((self, lambda g: g.reshape(self.shape)),))

    def transpose(self, *axes: int) -> Var:
        back = np.argsort(axes)
        return Var(self.value.transpose(axes), ((self, lambda g: g.transpose(back)),))

    def __getitem__(self, at) -> Var:
        def back(g):
            out = np.zeros(self.shape)
            np.add.at(out, at, g)
            return out

        return Var(self.value[at], ((self, back),))

    def softmax(self, mask: np.ndarray | None = None) -> Var:
        z = self.value if mask is None else np.where(mask > 0, self.value, -np.inf)
        e = np.exp(z - z.max(-1, keepdims=True))
        p = e / e.sum(-1, keepdims=True)
        return Var(p, ((self, lambda g: p * (g - (g * p).sum(-1, keepdims=True))),))

    def unit(self) -> Var:
        return self * ((self * self).sum() + 1e-16).power(-0.5)

    def normed(self, gain: Var, shift: Var) -> Var:
        c = self - self.mean()
        return c * ((c * c).mean() + 1e-5).power(-0.5) * gain + shift

    def backward(self) -> None:
        """Gradients of this (a single number) by everything it came from."""
        order, seen = [], set()

        def visit(v: Var) -> None:
            stack = [(v, iter(v.parents))]
            seen.add(id(v))
            while stack:
                node, rest = stack[-1]
                for p, _ in rest:
                    if id(p) not in seen:
                        seen.add(id(p))
                        stack.append((p, iter(p.parents)))
                        break
                else:
                    order.append(node)
                    stack.pop()

        visit(self)
        for v in order:
            v.grad = np.zeros(v.shape)
        self.grad = np.ones(self.shape)
        for v in reversed(order):
            for p, back in v.parents:
                p.grad = p.grad + _fit(back(v.grad), p.shape)


def var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def joined(parts: list[Var], axis: int) -> Var:
    edges = np.cumsum([0, *[p.shape[axis] for p in parts]])
    cut = lambda i: lambda g: np.take(g, range(edges[i], edges[i + 1]), axis)
    return Var(np.concatenate([p.value for p in parts], axis), tuple((p, cut(i)) for i, p in enumerate(parts)))


def cross_entropy(z: Var, y: np.ndarray, smoothing: float = 0.0) -> Var:
    """Mean cross entropy of logits against labels, a share of the target spread over all classes."""
    n, c = z.shape
    target = np.full((n, c), smoothing / c)
    target[np.arange(n), y] += 1 - smoothing
    top = z.value.max(1, keepdims=True)
    logs = (z - top) - (z - top).exp().sum().log()
    return (logs * target).sum().sum(0).reshape(1) * (-1.0 / n)


class Adam:
    """AdamW over named arrays, with a warm-up over the first tenth of the steps and a cosine after it."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, steps: int, decay: float = 1e-4):
        self.params, self.rate, self.steps, self.decay, self.t = params, rate, steps, decay, 0
        self.m, self.v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))

    def step(self, loss: Callable[[dict[str, Var]], Var]) -> float:
        names = {k: Var(p) for k, p in self.params.items()}
        out = loss(names)
        out.backward()
        self.t += 1
        warm = max(1, self.steps // 10)
        now = self.rate * (self.t / warm if self.t <= warm else 0.5 * (1 + np.cos(np.pi * (self.t - warm) / max(1, self.steps - warm))))
        for k, p in self.params.items():
            g = names[k].grad if names[k].grad is not None else np.zeros_like(p)
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * g, 0.999 * self.v[k] + 0.001 * g * g
            self.params[k] = p * (1 - now * self.decay) - now * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        return float(out.value.sum())
