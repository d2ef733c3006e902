"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Token ids are 0 .. n-1, 0 being the end of a document, which is also what stands before its first token. The
input side is one row per id (embedding and input weights in one); the output side is P(class) P(id | class).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WINDOW = 32
FEW = 8
LANES = 96
#: Scoring holds less a lane, so more fit a core's cache.
SCORE_LANES = 128
#: Numbers a step of the weights takes at a time.
PIECE = 8192
#: Exponentials of less, up or down, and their sums are normal single-precision numbers.
SAFE = 80.0
_F = np.float32
_ONES = np.ones(4096, _F)


@dataclass
class Shape:
    """starts: first id (in class order) of each class, and n at the end; order: ids in class order."""

    hidden: int
    order: np.ndarray
    starts: np.ndarray

    def __post_init__(self):
        self.n, self.classes = len(self.order), len(self.starts) - 1
        self.place = np.empty(self.n, np.int64)
        self.place[self.order] = np.arange(self.n)
        # few bits sort fast
        self.of = (np.searchsorted(self.starts, self.place, "right") - 1).astype(np.min_scalar_type(self.classes))


def shape(counts: np.ndarray, hidden: int, classes: int) -> Shape:
    """Classes of about equal shares of the square roots of counts, frequent ids first."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    root = np.cumsum(np.sqrt(counts[order] + 1.0))
    edge = np.searchsorted(root, root[-1] * np.arange(1, classes) / classes, "right")
    return Shape(hidden, order, np.unique(np.concatenate([[0], edge, [len(counts)]])))


def fresh(s: Shape, counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; output biases that already give each id its share."""
    rng = np.random.default_rng(seed)
    some = lambda *d: (rng.standard_normal(d) * 0.1).astype(_F)
    share = np.log((counts[s.order] + 1.0) / (counts.sum() + s.n))
    p = {"x": some(s.n, 3 * s.hidden), "u": some(s.hidden, 3 * s.hidden), "c": some(s.hidden, s.classes) * 0, "w": some(s.n, s.hidden) * 0}
    p["bw"] = share.astype(_F)
    p["bc"] = np.array([np.log(np.exp(share[a:z]).sum()) for a, z in zip(s.starts[:-1], s.starts[1:], strict=True)], _F)
    p["x"][:, : s.hidden] += 1.0  # states are kept at first
    return p


def pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype(_F).tobytes() for k in sorted(p))


def unpack(s: Shape, data: bytes) -> dict[str, np.ndarray]:
    dims = {"bc": (s.classes,), "bw": (s.n,), "c": (s.hidden, s.classes), "u": (s.hidden, 3 * s.hidden), "w": (s.n, s.hidden), "x": (s.n, 3 * s.hidden)}
    p, at, flat = {}, 0, np.frombuffer(data, _F)
    for k in sorted(dims):
        size = int(np.prod(dims[k]))
        p[k] = flat[at : at + size].reshape(dims[k]).copy()
        at += size
    return p


def _stacked(rows: np.ndarray, hidden: int) -> np.ndarray:
    """(n, 3 hidden) as (3, n, hidden): each gate's numbers lie together, so that elementwise work runs over whole blocks."""
    return rows.reshape(len(rows), 3, hidden).transpose(1, 0, 2)


def _beside(stack: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(stack.transpose(1, 0, 2)).reshape(stack.shape[1], -1)


def _forward(x: np.ndarray, u: np.ndarray, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, ...]:
    """States before the first and after each step, (steps + 1, lanes, hidden), and, if kept, what the way back needs: gates
    (steps, 2, lanes, hidden), candidates and u's part of them. x, u: stacked weights. ids: (steps, lanes); where fresh, a sequence
    begins, and the state before the step counts as 0."""
    steps, lanes = ids.shape
    hidden = h.shape[1]
    given = np.take(x, ids.ravel(), axis=1).reshape(3, steps, lanes, hidden)
    states = np.empty((steps + 1, lanes, hidden), _F)
    kept = steps if keep else 1
    gates, n, by_u = np.empty((kept, 2, lanes, hidden), _F), np.empty((kept, lanes, hidden), _F), np.empty((kept, 3, lanes, hidden), _F)
    states[0] = h
    begins = fresh.any(axis=1)
    with np.errstate(over="ignore"):  # a gate far below 0 is 1 / (1 + inf)
        for t in range(steps):
            h, out, k = states[t], states[t + 1], t if keep else 0
            if begins[t]:
                h = np.where(fresh[t][:, None], _F(0), h)
            gate, some, own = gates[k], n[k], by_u[k]
            np.matmul(h, u, out=own)
            np.add(own[:2], given[:2, t], out=gate)
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += _F(1)
            np.reciprocal(gate, out=gate)
            np.multiply(gate[1], own[2], out=some)
            some += given[2, t]
            np.tanh(some, out=some)
            np.subtract(h, some, out=out)
            out *= gate[0]
            out += some
    return states, gates, n, by_u[:, 2]


def _bound(w: np.ndarray, h: np.ndarray) -> float:
    """No logit is larger, up or down. w: (k, hidden + 1); h as wide, its last column ones."""
    return float(max(h.max(), -h.min()) * np.abs(w).sum(axis=1).max())


def _softmax(logits: np.ndarray, at: np.ndarray, small: bool, whole: bool) -> np.ndarray:
    """Log probabilities at the given flat places of (k, rows), one a row; if whole, logits become the loss's slopes, in place.
    small: no exponential can overflow, and no sum vanish."""
    if not small:
        logits -= logits.max(axis=0)
    flat = logits.ravel()
    own = flat.take(at)
    np.exp(logits, out=logits)
    total = _ONES[: len(logits)] @ logits if len(logits) <= len(_ONES) else logits.sum(axis=0)
    log = own - np.log(total)
    if whole:
        logits /= total
        flat[at] = np.exp(log) - _F(1)
    return log


def _output(p: dict, s: Shape, h: np.ndarray, y: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log P(y | h) per row, and the slope of the summed loss in h, if grads are asked for. Rows are brought into
    the order of their classes once; logits are (ids, rows); a column of ones carries the biases."""
    whole = grads is not None
    if not len(y):
        return np.zeros(0, _F), np.zeros_like(h) if whole else None
    hidden, count = h.shape[1], len(y)
    order = np.argsort(s.of[y], kind="stable")
    y, rows = y[order], np.ones((count, hidden + 1), _F)
    rows[:, :hidden] = np.take(h, order, axis=0)
    cls, m = s.of[y], np.arange(count)
    place = s.place[y] - s.starts[cls]
    edge = np.searchsorted(cls, np.arange(s.classes + 1))
    # places in the flat logits of a class, whose rows are from edge to edge
    place = place * np.diff(edge)[cls] + m - edge[cls]
    edge = edge.tolist()
    c, words = (np.concatenate(x, axis=1) for x in ((p["c"].T, p["bc"][:, None]), (p["w"], p["bw"][:, None])))
    logits = c @ rows.T
    log = _softmax(logits, cls * np.intp(count) + m, _bound(c, rows) < SAFE, whole)
    small = _bound(words, rows) < SAFE
    if whole:
        by_c = logits @ rows
        slope = logits.T @ c[:, :hidden]
        more, by_w = np.zeros_like(slope), np.zeros_like(words)
        grads["c"] += by_c[:, :hidden].T
        grads["bc"] += by_c[:, hidden]
    starts = s.starts.tolist()
    for k in range(s.classes):
        a, z, first, last = starts[k], starts[k + 1], edge[k], edge[k + 1]
        if first == last or z - a == 1:
            continue
        w, hk = words[a:z], rows[first:last]
        logits = w @ hk.T
        log[first:last] += _softmax(logits, place[first:last], small, whole)
        if whole:
            np.matmul(logits.T, w[:, :hidden], out=more[first:last])
            np.matmul(logits, hk, out=by_w[a:z])
    back = np.empty_like(log)
    back[order] = log
    if not whole:
        return back, None
    slope += more
    grads["w"] += by_w[:, :hidden]
    grads["bw"] += by_w[:, hidden]
    dh = np.empty_like(slope)
    dh[order] = slope
    return back, dh


def _summed(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows in (3, rows, hidden). An even number of columns is added two at a time, as
    complex numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    kind = np.complex64 if rows.shape[-1] % 2 == 0 else _F
    return keys[begins], np.add.reduceat(np.take(rows.view(kind), order, axis=1), begins, axis=1).view(_F)


class _Flat:
    """Arrays by name, as views of one flat array."""

    def __init__(self, dims: dict[str, tuple[int, ...]]):
        self.all = np.zeros(sum(math.prod(d) for d in dims.values()), _F)
        self.at, start = {}, 0
        for k, d in dims.items():
            self.at[k] = self.all[start : start + math.prod(d)].reshape(d)
            start += math.prod(d)


def _step(p: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, count: int, pace: float) -> None:
    """Adam's step, by pieces that stay in a core's cache."""
    some = np.empty(PIECE, _F)
    for a in range(0, len(p), PIECE):
        part = slice(a, a + PIECE)
        gk, one, two, pk = g[part], first[part], second[part], p[part]
        t = some[: len(gk)]
        one *= _F(0.9)
        gk *= _F(0.1 / count)
        one += gk
        two *= _F(0.99)
        gk *= gk  # a hundredth of the slope's square
        two += gk
        np.sqrt(two, out=t)
        t += _F(1e-6)
        np.divide(one, t, out=t)
        t *= _F(pace)
        pk -= t


@dataclass
class _Laid:
    """Sequences laid out in lanes, one after another, lane after lane: inputs, what follows them, the sequence's number and
    whether it begins. Lanes are about equally full, the fullest first; size: their steps. Held flat, so one very long
    sequence costs its own length only."""

    given: np.ndarray
    wanted: np.ndarray
    owner: np.ndarray
    fresh: np.ndarray
    size: np.ndarray

    def windows(self, window: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Whether it is the last, then inputs, what follows, numbers (-1: nothing) and beginnings, each (steps, lanes)."""
        first, steps = np.cumsum(self.size) - self.size, int(self.size.max(initial=0))
        for start in range(0, steps, window):
            live = int(np.searchsorted(-self.size, -start, "left"))
            t = np.arange(start, min(start + window, steps))[:, None]
            none = t >= self.size[:live]
            at = np.where(none, 0, t + first[:live])
            owner, fresh = self.owner[at], self.fresh[at]
            owner[none], fresh[none] = -1, False
            yield start + window >= steps, self.given[at], self.wanted[at], owner, fresh


def _laid(sequences: list[np.ndarray], lanes: int) -> _Laid:
    """The longest are dealt first, each to the emptiest lane; within a lane they keep their order."""
    some = [j for j in range(len(sequences)) if len(sequences[j]) > 1]
    heap = [(0, k) for k in range(min(lanes, len(some)))]
    held: list[list[int]] = [[] for _ in heap]
    for j in sorted(some, key=lambda j: -len(sequences[j])):
        size, k = heap[0]
        held[k].append(j)
        heapq.heapreplace(heap, (size + len(sequences[j]) - 1, k))
    sizes = sorted(heap, key=lambda x: (-x[0], x[1]))
    js = [j for _, k in sizes for j in sorted(held[k])]
    long = np.array([len(sequences[j]) - 1 for j in js], np.int64)
    none = [np.zeros(0, np.int32)]
    fresh = np.zeros(int(long.sum()), bool)
    fresh[np.cumsum(long) - long] = True
    given, wanted = (np.concatenate(none + [sequences[j][part] for j in js]).astype(np.int32) for part in (slice(0, -1), slice(1, None)))
    return _Laid(given, wanted, np.repeat(np.array(js, np.int32), long), fresh, np.array([size for size, _ in sizes], np.int64))


def train(p: dict[str, np.ndarray], s: Shape, batches: Iterator[list[np.ndarray]], rate: float = 0.004, window: int = WINDOW) -> tuple[dict[str, np.ndarray], int]:
    """One pass of truncated backpropagation over batches of sequences (each begins with its first input), which are
    laid out in as many lanes as the largest batch has sequences. States go from window to window; a sequence
    begins where the one before it in its lane ends. A step of the weights is made for each window, or once FEW windows of
    tokens have come together. Every token is visited. Returns the weights and the number of tokens."""
    lists = list(batches)
    laid = _laid([q for some in lists for q in some], max(map(len, lists), default=0))
    hidden = s.hidden
    given = p | {k: _stacked(p[k], hidden) for k in ("u", "x")}
    dims = {k: v.shape for k, v in given.items()}
    weights, slopes, first, second = (_Flat(dims) for _ in range(4))
    q, grads = weights.at, slopes.at
    for k, v in given.items():
        q[k][:] = v
    steps = tokens = count = 0
    h = np.zeros((len(laid.size), hidden), _F)
    for last, ids, wanted, owner, fresh in laid.windows(window):
        use, begins = owner >= 0, fresh.any(axis=1)
        wide, live = ids.shape
        states, gates, n, un = _forward(q["x"], q["u"], ids, fresh, h[:live], True)
        hs, z, r = states[1:], gates[:, 0], gates[:, 1]
        h = hs[-1]
        before = np.where(fresh[..., None], _F(0), states[:-1])
        if not count:
            slopes.all.fill(0)
        if use.all():
            dh_out = _output(q, s, hs.reshape(-1, hidden), wanted.ravel(), grads)[1].reshape(wide, live, hidden)
        else:
            dh_out = np.zeros((wide, live, hidden), _F)
            _, dh_out[use] = _output(q, s, hs[use], wanted[use], grads)
        count += int(use.sum())
        tokens += int(use.sum())
        by_z, by_n, by_r = (before - n) * z * (1 - z), (1 - z) * (1 - n * n), un * r * (1 - r)
        da, dr = np.empty((3, wide, live, hidden), _F), np.empty((wide, live, hidden), _F)
        back, two, one = np.zeros((live, hidden), _F), np.empty((2, live, hidden), _F), np.empty((live, hidden), _F)
        ut = q["u"].transpose(0, 2, 1)
        for t in range(wide - 1, -1, -1):
            dh = dh_out[t]
            dh += back
            np.multiply(dh, by_z[t], out=da[0, t])
            dn = np.multiply(dh, by_n[t], out=da[2, t])
            np.multiply(dn, by_r[t], out=da[1, t])
            np.multiply(dn, r[t], out=dr[t])
            np.matmul(da[:2, t], ut[:2], out=two)
            np.matmul(dr[t], ut[2], out=one)
            np.multiply(dh, z[t], out=back)
            back += two[0]
            back += two[1]
            back += one
            if begins[t]:
                back[fresh[t]] = 0
        da = da.reshape(3, -1, hidden)
        was = before.reshape(-1, hidden).T
        grads["u"][:2] += was @ da[:2]
        grads["u"][2] += was @ dr.reshape(-1, hidden)
        flat = ids.ravel()
        found, sums = _summed(da, flat.astype(np.int16) if s.n <= 1 << 15 else flat)
        grads["x"][:, found] += sums
        if count < FEW * window and not last:
            continue
        steps += 1
        pace = rate * np.sqrt(1 - 0.99**steps) / (1 - 0.9**steps)
        _step(weights.all, slopes.all, first.all, second.all, count, pace)
        count = 0
    return q | {k: _beside(q[k]) for k in ("u", "x")}, tokens


def score(p: dict[str, np.ndarray], s: Shape, sequences: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
    """Natural log probability of each whole sequence (which begins with its first input). The state goes from
    window to window through the sequence; sequences run in SCORE_LANES lanes side by side."""
    laid = _laid(sequences, SCORE_LANES)
    total = np.zeros(len(sequences))
    h = np.zeros((len(laid.size), s.hidden), _F)
    x, u = (np.ascontiguousarray(_stacked(p[k], s.hidden)) for k in ("x", "u"))
    for _, ids, wanted, owner, fresh in laid.windows(window):
        states = _forward(x, u, ids, fresh, h[: ids.shape[1]], False)[0]
        h = states[-1]
        use = owner >= 0
        log, _ = _output(p, s, states[1:][use], wanted[use], None)
        total += np.bincount(owner[use], log.astype(np.float64), len(total))
    return total
