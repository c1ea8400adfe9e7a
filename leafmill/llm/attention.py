"""A small causal self-attention language model in numpy.

One attention layer with relative places over windows of units, read out through two levels:
a class of units, then the unit within its class.  Frequent subwords are units
of their own; the others share units by frequency and are told apart by their
corpus counts, so that all subwords together have probability one.

A window predicts STEP units; its keys are those units' inputs and the OVERLAP
inputs before them, so every unit is predicted once and has that much context at
least.  A unit's query, key and value depend on the unit alone: they are looked
up in a table of all units that is computed once per batch.
"""

from __future__ import annotations

import ctypes
import functools
import glob
import math
import os
from typing import NamedTuple

import numpy as np

#: Inputs a window sees, and those of them that only give context.
WINDOW, OVERLAP = 32, 8
STEP = WINDOW - OVERLAP
WIDTH = 16
#: Classes of frequent subwords and members of each; classes that the other subwords share.
HEADS, MEMBERS, TAILS = 32, 32, 16
CLASSES = HEADS + TAILS
START = HEADS * MEMBERS + TAILS
LIMIT = 30.0
#: By unit: its class, and its member number in a head class.
GROUP = np.r_[np.arange(HEADS * MEMBERS) // MEMBERS, HEADS + np.arange(TAILS)].astype(np.int8)
MEMBER = np.r_[np.arange(HEADS * MEMBERS) % MEMBERS, np.zeros(TAILS, np.int64)].astype(np.int8)
#: Windows scored at a time, and windows of a training step.
BATCH, TRAIN = 128, 96


@functools.cache
def one_thread() -> None:
    """Tasks share an executor's cores: threads of the matrix library would only wait for each other.

    A large block that is freed also makes the C library keep smaller ones for later instead of giving
    them back to the system after each batch, which costs a fault for every page of the next.
    """
    np.empty(24 << 20, np.uint8)
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        call = getattr(ctypes.CDLL(path), "scipy_openblas_set_num_threads64_", None)
        if call:
            call(1)


class Units(NamedTuple):
    """By subword id: its unit and log probability within it, which is not 0 for shared units."""

    unit: np.ndarray
    inner: np.ndarray
    head: np.ndarray  # log share of each member of each head class, for the start of training
    mass: np.ndarray  # log share of each class


def units(counts: np.ndarray) -> Units:
    """Units from the corpus counts of all subword ids (add-one)."""
    weight = counts.astype(np.float64) + 1
    order = np.argsort(-weight, kind="stable")
    inner, unit = np.zeros(len(counts)), np.zeros(len(counts), np.uint16)
    top, rest = np.split(order, [HEADS * MEMBERS])
    unit[top] = np.arange(len(top))
    if len(rest):
        share = np.cumsum(weight[rest]) / weight[rest].sum()
        unit[rest] = HEADS * MEMBERS + np.minimum((share * TAILS).astype(np.int64), TAILS - 1)
    by_unit = np.bincount(unit, weight, START)
    mass = np.bincount(GROUP, by_unit, CLASSES)
    inner[rest] = np.log(weight[rest] / by_unit[unit[rest]])
    with np.errstate(divide="ignore"):
        head = np.log(by_unit[: HEADS * MEMBERS] / mass[GROUP[: HEADS * MEMBERS]]).reshape(HEADS, MEMBERS)
        return Units(unit, inner, np.maximum(np.nan_to_num(head, nan=-LIMIT), -LIMIT), np.maximum(np.log(mass / mass.sum()), -LIMIT))


Model = dict[str, np.ndarray]


def start(u: Units, seed: int = 6) -> Model:
    """Weights before training: the read-out gives the corpus shares."""
    rng = np.random.default_rng(seed)
    new = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
    d = WIDTH
    return {
        "embed": new(START + 1, d, by=0.5),
        "qkv": new(d, 3 * d, by=d**-0.5),
        "place": (-0.3 * np.arange(WINDOW)).astype(np.float32),
        "class": new(d, CLASSES, by=0.05),
        "class0": u.mass.astype(np.float32),
        "member": new(HEADS, d, MEMBERS, by=0.05),
        "member0": u.head.astype(np.float32),
    }


_BEGIN = np.array([START], np.uint16)
#: How far back each key of a window lies from each query; negative after it.
_BACK = np.arange(STEP)[:, None] + OVERLAP - np.arange(WINDOW)
_PLACE = np.maximum(_BACK, 0)


class _Ready(NamedTuple):
    """What windows share as long as the weights stay as they are."""

    table: np.ndarray  # by unit: itself, its scaled query, its key, its value, and a one
    place: np.ndarray  # by query and key of a window, what their places add
    group: np.ndarray  # the read-out's weights with its constants as last row
    member: np.ndarray


def _ready(m: Model) -> _Ready:
    d = WIDTH
    table = np.empty((START + 1, 4 * d + 1), m["embed"].dtype)
    table[:, :d], table[:, 4 * d] = m["embed"], 1
    np.matmul(m["embed"], _scaled(m["qkv"]), out=table[:, d : 4 * d])
    place = np.where(_BACK >= 0, m["place"][_PLACE], table.dtype.type(-1e9))
    return _Ready(table, place, np.concatenate([m["class"], m["class0"][None]]), np.concatenate([m["member"], m["member0"][:, None]], axis=1))


def _hidden(r: _Ready, x: np.ndarray, begins: np.ndarray):
    """Hidden states (n, STEP, WIDTH) of windows of input units (n, WINDOW), with what the way back needs.

    ``begins`` marks windows that start a text: their context is hidden.
    """
    d = WIDTH
    t = np.take(r.table, x, axis=0)
    e, q, k, v = t[:, OVERLAP:, :d], t[:, OVERLAP:, d : 2 * d], t[:, :, 2 * d : 3 * d], t[:, :, 3 * d :]
    a = q @ k.transpose(0, 2, 1)
    a += r.place
    a[begins, :, :OVERLAP] = -1e9
    _limit(a)
    np.exp(a, out=a)
    a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(len(a), STEP, 1)
    c = a @ v[:, :, :d]
    h = e + c
    np.tanh(h, out=h)
    return h, (t, a, c)


def _limit(z: np.ndarray) -> None:
    """Keeps logits within the range of exp; to look for the largest costs less than to write all."""
    if not z.max(initial=0) <= LIMIT:
        np.minimum(z, LIMIT, out=z)


def _scaled(qkv: np.ndarray) -> np.ndarray:
    """Weights with those of the query scaled."""
    return np.concatenate([qkv[:, :WIDTH] * qkv.dtype.type(WIDTH**-0.5), qkv[:, WIDTH:]], axis=1)


class _Targets(NamedTuple):
    """Kept targets by class: their flat places, classes, and members; those of head classes come first and lie in ``runs`` (class, first, end)."""

    at: np.ndarray
    group: np.ndarray
    heads: int  # so many are of head classes
    member: np.ndarray
    runs: list[tuple[int, int, int]]


def _targets(unit: np.ndarray, keep: np.ndarray) -> _Targets:
    at = np.flatnonzero(keep)
    of = GROUP[unit.ravel()[at]]
    order = np.argsort(of, kind="stable")
    at, of = at[order], of[order].astype(np.intp)
    count = np.bincount(of, minlength=CLASSES)[:HEADS]
    ends = np.cumsum(count)
    heads = int(ends[-1])
    runs = [r for r in zip(range(HEADS), (ends - count).tolist(), ends.tolist(), strict=True) if r[1] < r[2]]
    return _Targets(at, of, heads, MEMBER[unit.ravel()[at[:heads]]].astype(np.intp), runs)


def _rows(t: _Targets, h: np.ndarray) -> np.ndarray:
    """Hidden states of targets with a last column of ones."""
    rows = np.empty((len(t.at), WIDTH + 1), h.dtype)
    rows[:, :WIDTH], rows[:, WIDTH] = np.take(h.reshape(-1, WIDTH), t.at, axis=0), 1
    return rows


def _member_logits(t: _Targets, rows: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Logits of targets of head classes within their class."""
    z = np.empty((t.heads, MEMBERS), rows.dtype)
    for c, first, end in t.runs:
        np.matmul(rows[first:end], member[c], out=z[first:end])
    return z


def _flat_places(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    return np.arange(0, z.size, z.shape[1]) + column


def log_probs(m: Model, x: np.ndarray, begins: np.ndarray, unit: np.ndarray, keep: np.ndarray, ready: _Ready | None = None) -> np.ndarray:
    """Natural log probabilities (n, STEP) of the target units that ``keep`` marks, 0 elsewhere."""
    r = ready or _ready(m)
    t = _targets(unit, keep)
    rows = _rows(t, _hidden(r, x, begins)[0])

    def log_soft(z, target):
        got = np.take(z, _flat_places(z, target))
        np.exp(z, out=z)
        return got - np.log(z @ np.ones(z.shape[1], z.dtype))

    out = log_soft(rows @ r.group, t.group)
    if t.heads:
        out[: t.heads] += log_soft(_member_logits(t, rows, r.member), t.member)
    whole = np.zeros(keep.shape, out.dtype)
    whole.ravel()[t.at] = out
    return whole


def bounded(m: Model) -> Model:
    """The model with its read-out scaled where a logit could leave the range of exp: hidden states are within one."""
    m = dict(m)
    for w, b in (("class", "class0"), ("member", "member0")):
        most = np.abs(m[w]).sum(axis=-2).max() + np.abs(m[b]).max()
        if most > 2.6 * LIMIT:
            m[w], m[b] = m[w] * np.float32(2.6 * LIMIT / most), m[b] * np.float32(2.6 * LIMIT / most)
    return m


def _views(flat: np.ndarray, like: Model) -> Model:
    """The vector ``flat`` as weights in the shapes of ``like``."""
    ends = np.cumsum([w.size for w in like.values()])
    return {n: part.reshape(w.shape) for (n, w), part in zip(like.items(), np.split(flat, ends[:-1]), strict=True)}


def gradients(m: Model, x: np.ndarray, begins: np.ndarray, unit: np.ndarray, keep: np.ndarray, g: Model | None = None) -> tuple[float, Model]:
    """Mean loss and its gradients; with ``g``, weights of zeros that take them, the loss is not computed (NaN)."""
    d, with_loss = WIDTH, g is None
    r = _ready(m)
    h, (t, a, c) = _hidden(r, x, begins)
    if g is None:
        g = {n: np.zeros_like(w) for n, w in m.items()}
    to = _targets(unit, keep)
    rows = _rows(to, h)
    n = max(len(to.at), 1)

    def softmax(z, target):
        """Turns logits into the loss's gradient by them; returns the loss."""
        _limit(z)
        np.exp(z, out=z)
        sums, places = z @ np.ones(z.shape[1], z.dtype), _flat_places(z, target)
        lost = np.log(sums / np.take(z, places)).sum() if with_loss else math.nan
        z *= (1 / (n * sums))[:, None]
        z.reshape(-1)[places] -= 1 / n
        return lost

    p = rows @ r.group
    loss = softmax(p, to.group)
    turned = rows.T
    by_group = turned @ p
    g["class"][:], g["class0"][:] = by_group[:d], by_group[d]
    back = p @ m["class"].T
    if to.heads:
        p = _member_logits(to, rows, r.member)
        loss += softmax(p, to.member)
        by_member, more = np.zeros_like(r.member), np.empty((to.heads, d), h.dtype)
        for of, first, end in to.runs:
            part = p[first:end]
            np.matmul(turned[:, first:end], part, out=by_member[of])
            np.matmul(part, m["member"][of].T, out=more[first:end])
        back[: to.heads] += more
        g["member"][:], g["member0"][:] = by_member[:, :d], by_member[:, d]
    back *= 1 - rows[:, :d] ** 2
    # gradients by hidden states, and a last column that takes the mean out of the gradients by weights
    dh = np.zeros((len(x) * STEP, d + 1), h.dtype)
    dh[to.at, :d] = back
    dh = dh.reshape(-1, STEP, d + 1)
    dh[:, :, d] = -np.einsum("ijk,ijk->ij", dh[:, :, :d], c)
    # of the scaled query, key and value of each input
    by = np.empty((len(x), WINDOW, 3 * d), h.dtype)
    by[:, :OVERLAP, :d] = 0
    np.matmul(a.transpose(0, 2, 1), dh[:, :, :d], out=by[:, :, 2 * d :])
    da = dh @ t[:, :, 3 * d :].transpose(0, 2, 1)
    da *= a
    np.matmul(da, t[:, :, 2 * d : 3 * d], out=by[:, OVERLAP:, :d])
    np.matmul(da.transpose(0, 2, 1), t[:, OVERLAP:, d : 2 * d], out=by[:, :, d : 2 * d])
    g["place"][:] = np.bincount(_PLACE.ravel(), da.sum(axis=0).ravel(), WINDOW)  # 0 after a query
    by = by.reshape(-1, 3 * d)
    np.matmul(t.reshape(-1, 4 * d + 1)[:, :d].T, by, out=g["qkv"])
    g["qkv"][:, :d] *= d**-0.5
    de = (by @ _scaled(m["qkv"]).T).reshape(-1, WINDOW, d)
    de[:, OVERLAP:] += dh[:, :, :d]
    order = np.argsort(x, axis=None, kind="stable")
    used = x.ravel()[order]
    first = np.append(0, np.flatnonzero(used[1:] != used[:-1]) + 1)
    # two numbers are added at a time, as one complex number
    pairs = np.take(de.reshape(-1, d), order, axis=0).view(np.result_type(de, np.complex64))
    g["embed"][used[first]] = np.add.reduceat(pairs, first, axis=0).view(de.dtype)
    return float(loss / n), g


def train(m: Model, windows: tuple[np.ndarray, ...], rate: float = 0.01, batch: int = 32) -> Model:
    """One pass of Adam over windows (x, begins, unit, keep); returns new weights."""
    flat = np.concatenate([w.ravel() for w in m.values()])
    g, one, two = (np.zeros_like(flat) for _ in range(3))
    m, by, some = _views(flat, m), _views(g, m), np.empty_like(flat)
    for step, at in enumerate(range(0, len(windows[0]), batch), 1):
        g[:] = 0
        gradients(m, *(w[at : at + batch] for w in windows), by)
        # means of g and of g g, weights 0.1 and 0.01 for the newest, are kept as 10 and 100 times themselves
        one *= 0.9
        one += g
        np.multiply(g, g, out=g)
        two *= 0.99
        two += g
        # weights -= rate one' / (sqrt(two') + 1e-6), the means divided by the weights they hold
        up = math.sqrt(0.01 / (1 - 0.99**step))
        np.sqrt(two, out=some)
        some += 1e-6 / up
        np.divide(one, some, out=g)
        g *= rate * 0.1 / ((1 - 0.9**step) * up)
        flat -= g
    return m


def cut_windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over texts of ``lengths`` units that lie one after the other: text, and first unit within it that it scores."""
    count = -(-lengths // STEP)
    text = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, nth * STEP


def inputs(flat: np.ndarray, base: np.ndarray, first: np.ndarray, ends: np.ndarray, begins: np.ndarray):
    """(x, begins, unit, keep) of windows over ``flat``, which holds inputs and, one place on, targets.

    A window's first scored input is at ``base + first``, the last target of its text before ``ends``.
    """
    at = (base + first)[:, None] + np.arange(-OVERLAP, STEP)
    x, now = np.take(flat, at, mode="clip"), np.take(flat, at[:, OVERLAP:] + 1, mode="clip")
    x[begins, :OVERLAP] = START
    keep = at[:, OVERLAP:] + 1 < ends[:, None]
    now[~keep] = 0
    return x, begins, now, keep


def score(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text of units, without what lies within shared units."""
    one_thread()
    lengths = np.array([len(t) for t in texts], np.int64)
    # every text stands after a START of its own
    flat = np.concatenate([x for t in texts for x in (_BEGIN, t)] or [_BEGIN])
    ends = np.cumsum(lengths + 1)
    text, first = cut_windows(lengths)
    m, out = bounded(m), np.zeros(len(lengths))
    ready = _ready(m)
    for at in range(0, len(text), BATCH):
        t, f = text[at : at + BATCH], first[at : at + BATCH]
        got = log_probs(m, *inputs(flat, (ends - lengths - 1)[t], f, ends[t], f == 0), ready)
        out += np.bincount(t, got.sum(axis=1, dtype=np.float64), len(lengths))
    return out
