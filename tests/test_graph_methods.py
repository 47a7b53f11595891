"""Gradients of the graph methods by finite differences, invariants of masks, and that they learn."""

import numpy as np
import pytest

from verdigris.operators import classifiers as cl
from verdigris.operators import graphmethods as gm
from verdigris.operators import graphnet as gn
from verdigris.operators.gradients import Var, cross_entropy, joined


def toy(n=18, c=3, d=8, k=4, seed=0):
    rng = np.random.default_rng(seed)
    text = cl.unit(np.random.default_rng(9).normal(size=(c, d)))
    y = np.arange(n) % c
    x = cl.unit(text[y] + 0.4 * rng.normal(size=(n, d)))
    nodes = cl.unit(x[:, None] + 0.5 * rng.normal(size=(n, k, d)))
    geometry = np.concatenate([rng.uniform(0.2, 0.8, (n, k, 5)), rng.integers(1, 4, (n, k, 1))], -1)
    mask = np.ones((n, k))
    mask[::3, -1] = 0
    return text, gm.Parts(x, y, nodes, mask, geometry, cl.unit(x + 0.1 * rng.normal(size=x.shape)))


def differences(loss, params, names, tol=2e-5):
    leaves = {k: Var(v) for k, v in params.items()}
    out = loss(leaves)
    out.backward()
    rng = np.random.default_rng(0)
    for k in names:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in params[k].shape)
            old = params[k][i]
            sides = []
            for h in (1e-6, -1e-6):
                params[k][i] = old + h
                sides.append(float(loss({n: Var(v) for n, v in params.items()}).value.sum()))
            params[k][i] = old
            assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(leaves[k].grad[i], abs=tol, rel=1e-3)


def test_operations():
    rng = np.random.default_rng(1)
    p = {"a": rng.normal(size=(3, 4)), "b": rng.uniform(1, 2, (4, 2)), "g": np.ones(4), "s": np.zeros(4)}

    def loss(v):
        x = joined([v["a"].normed(v["g"], v["s"]).leaky(0.2), v["a"].sigmoid().unit()], 0)
        y = (x @ v["b"]).softmax() * x[:, :2].exp() / (v["b"].max(0) + 3.0) - v["b"].log().mean(0)
        return cross_entropy(y, np.array([0, 1, 0, 1, 0, 1]), 0.1) + y.transpose(1, 0).reshape(12).sum(0).reshape(1) * 0.01

    differences(loss, p, list(p))


@pytest.mark.parametrize("options", [{}, {"moved_queries": False}, {"texts": False, "gated": False, "placed": False}, {"kinds": (2,), "most": 3}])
def test_region_graph_gradients(options, monkeypatch):
    monkeypatch.setattr(gm, "SCALE", 5.0)
    text, s = toy()
    m = gm.RegionGraph(text, hidden=8, heads=2, drop=0.0, **options)
    m.values = cl.per_class(cl.one_hot(s.y, 3))
    params = m.start()
    assert m.size == sum(v.size for v in params.values())

    def loss(p):
        return cross_entropy(gm.total(m.terms(p, s, m.moved(p, s)[0])), s.y, 0.1)

    names = ["enter", "move", "0.0.value", "1.1.take", "0.1.send", "0.0.relation", "weight", "sharp", "ask"]
    differences(loss, params, names + (["share", "move_text"] if m.texts else []) + (["1.own", "0.sent"] if m.gated else []) + (["place", "placed"] if m.placed else []))


def test_network_against_plain_loops():
    """One round, two heads, gated, written out node by node."""
    rng, text, s = np.random.default_rng(3), *toy(4)
    net = gn.Network(8, hidden=6, rounds=1, heads=2)
    p = net.start(rng)
    nodes = gn.Nodes.side_by_side([gn.Nodes.alike(s.x[:, None], gn.WHOLE, (0.5, 0.5, 1, 1, 1)), gn.Nodes(s.nodes, s.geometry[..., 5].astype(int), s.geometry[..., :5], s.mask > 0), gn.Nodes.alike(np.broadcast_to(text, (4, 3, 8)), gn.TEXT)])
    got = net.states(gm.leaves(p), nodes).value
    gelu = lambda x: 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))
    for b in range(4):
        n = nodes.kind.shape[1]
        h = [nodes.vector[b, i] @ p["enter"] + p["kind"][nodes.kind[b, i]] + (0 if np.isnan(nodes.place[b, i, 0]) else gelu(nodes.place[b, i] @ p["place"]) @ p["placed"]) for i in range(n)]
        for i in range(n):
            message = []
            for head in range(2):
                v = [x @ p[f"0.{head}.value"] for x in h]
                drawn = []
                for j in range(n):
                    one, other = nodes.place[b, i], nodes.place[b, j]
                    r = np.array([0, 0, 0, nodes.vector[b, i] @ nodes.vector[b, j]])
                    if not np.isnan(one[0] + other[0]):
                        sides = [max(0, min(one[k] + one[k + 2] / 2, other[k] + other[k + 2] / 2) - max(one[k] - one[k + 2] / 2, other[k] - other[k + 2] / 2)) for k in (0, 1)]
                        common = sides[0] * sides[1]
                        r[:3] = common / max(one[2] * one[3] + other[2] * other[3] - common, 1e-6), np.hypot(*(one[:2] - other[:2])), one[4] * other[4]
                    x = (v[i] @ p[f"0.{head}.take"] + v[j] @ p[f"0.{head}.send"] + r @ p[f"0.{head}.relation"]).item()
                    drawn.append((x if x > 0 else 0.2 * x) if nodes.live[b, j] else -np.inf)
                a = np.exp(np.array(drawn) - max(drawn))
                message.append((a / a.sum()) @ np.array(v))
            m = np.concatenate(message)
            gate = 1 / (1 + np.exp(-(h[i] @ p["0.own"] + m @ p["0.sent"] + p["0.open"])))
            out = h[i] + gate * (m - h[i])
            assert np.allclose((out - out.mean()) / np.sqrt(out.var() + 1e-5), got[b, i])


def test_parts_add_up_and_views_train():
    text, s = toy(24)
    s.views = np.stack([s.x, s.x[:, ::-1]], 1)
    m = gm.RegionGraph(text, hidden=8, heads=2, epochs=6, second=True).fit(s, toy(12, seed=4)[1])
    parts = m.explained(s)
    assert set(parts) == {"text", "cache", "prototype", "second"} and np.allclose(sum(parts.values()), m.logits(s))
    assert np.allclose(np.concatenate([m.logits(x) for x in s.cut(5)]), m.logits(s))


def test_patch_graph_selection():
    text, s = toy(18)
    best, rows = gm.select_patch_graph(text, s, toy(12, seed=4)[1], epochs=2)
    assert len(rows) == 6 and best.f1(toy(12, seed=4)[1]) == max(r["val_f1"] for r in rows)
    for options in gm.CONFIGURATIONS.values():
        gm.PatchGraph(text, epochs=1, **options).fit(s, s)
    for options in (gm.ABLATIONS | gm.CANDIDATES).values():
        gm.RegionGraph(text, epochs=1, **{"hidden": 8, **options, **({"hidden": 16} if "hidden" in options else {})}).fit(s, s)


@pytest.mark.parametrize("mode", ["both", "additive", "multiplicative", "no_edges"])
def test_patch_graph_gradients(mode, monkeypatch):
    monkeypatch.setattr(gm, "SCALE", 5.0)
    text, s = toy()
    m = gm.PatchGraph(text, mode=mode, pools=("mean", "max", "min", "std", "softmax"), last="identity")
    m.values = cl.per_class(cl.one_hot(s.y, 3))
    params = {k: v + 0.05 * np.random.default_rng(2).normal(size=v.shape) for k, v in m.start(s.x).items()}

    def loss(p):
        q = m.refined(p, s.nodes)
        return cross_entropy(5.0 * (q @ text.T) + 2.0 * gm.votes(q, p["keys"], 5.0, m.values), s.y)

    differences(loss, params, ["keys", "w0", "w1", "pool_mean", "pool_std", "warmth"] + (["a0", "b1"] if mode in ("both", "additive") else []))


def test_masked_nodes_do_not_matter():
    text, s = toy()
    m = gm.RegionGraph(text, hidden=8, heads=2, epochs=3).fit(s, s)
    z = m.logits(s)
    changed = gm.Parts(s.x, s.y, np.where(s.mask[..., None] > 0, s.nodes, 7.0), s.mask, np.where(s.mask[..., None] > 0, s.geometry, 0.0), s.x2)
    assert np.allclose(m.logits(changed), z)
    gone = m.importance(s)
    assert gone.shape == s.mask.shape and np.all(gone[s.mask == 0] == 0)
    few = gm.RegionGraph(text, kinds=(), most=2).graph(s)[0]
    assert few.kind.shape[1] == 1 + 2 + len(text) and not few.live[:, 1:3][few.kind[:, 1:3] != gn.OBJECT].any()


@pytest.mark.parametrize("make", [lambda t: gm.RegionGraph(t, hidden=8, heads=2, epochs=11, second=True), lambda t: gm.PatchGraph(t, epochs=5)])
def test_judged_slice_by_slice(make):
    """Counts of slices, as tasks add them up, choose what the items at once choose."""
    text, s = toy(24)
    valid = toy(30, seed=5)[1]
    sliced = lambda answers: gm.f1_of(sum(gm.counted(answers(x), x.y, 3) for x in valid.cut(7)))
    one, other = make(text).fit(s, valid), make(text).fit(s, sliced)
    assert np.allclose(one.logits(valid), other.logits(valid)) and one.f1(valid) == pytest.approx(cl.macro_f1(one.logits(valid).argmax(1), valid.y, 3))
    assert np.isfinite(make(text).fit(s, gm.Parts(valid.x[:0], valid.y[:0], valid.nodes[:0], valid.mask[:0], valid.geometry[:0], valid.x2[:0])).logits(valid)).all()


@pytest.mark.parametrize("make", [lambda t: gm.RegionGraph(t, hidden=8, heads=2, epochs=15), lambda t: gm.PatchGraph(t, epochs=5), lambda t: gm.PatchGraph(t, epochs=5, graph=False)])
def test_they_learn(make):
    text, s = toy(30)
    m = make(text).fit(s, toy(24, seed=5)[1])
    assert m.f1(s) > 0.8 and np.allclose(gm.probabilities(m, s).sum(1), 1)
