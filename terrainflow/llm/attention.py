"""A small causal self-attention model over subword ids, in numpy: scores, gradients and training steps.

The logits of the next id start from how often it follows the current one in the training corpus (prior), and the
attention over all ids before corrects them. The next id is drawn in two steps, first its class, then its place in the
class. Ids outside of the CLASSES * PLACES - 1
most frequent share one slot; which of them it is follows their counts in the training corpus.
"""

from __future__ import annotations

import numpy as np

WIDTH = 32
STRIDE = 24
DIM = 16
CLASSES = 32
PLACES = 32
SLOTS = CLASSES * PLACES
BATCH = 256
#: Windows that are scored at once.
SCORED = 1536
#: Of these, windows and rows of logits that are worked on at once, so that what they need stays in a core's cache.
CHUNK, ROWS = 64, 2048


def prior(follows: np.ndarray, frequency: np.ndarray, smoothing: float = 4.0) -> dict[str, np.ndarray]:
    """Fixed logits from counts follows[current, next], smoothed by the frequency of the slots."""
    p = (follows + smoothing * frequency) / (follows.sum(axis=1, keepdims=True) + smoothing)
    p = p.reshape(SLOTS, CLASSES, PLACES)
    by_class = p.sum(axis=2)
    return {"class": np.log(by_class).astype(np.float32), "slot": np.log(p / by_class[:, :, None]).astype(np.float32)}


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters that leave the prior nearly as it is."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": normal(SLOTS, DIM, scale=0.3),
        "place": normal(WIDTH, DIM, scale=0.05),
        "query": normal(DIM, DIM, scale=DIM**-0.5),
        "key": normal(DIM, DIM, scale=DIM**-0.5),
        "value": normal(DIM, DIM, scale=DIM**-0.5),
        "mix": normal(DIM, DIM, scale=DIM**-0.5),
        "last": normal(DIM, DIM, scale=DIM**-0.5),
        "class_w": normal(DIM, CLASSES, scale=0.02),
        "class_b": np.zeros(CLASSES, np.float32),
        "slot_w": normal(CLASSES, DIM, PLACES, scale=0.02),
        "slot_b": np.zeros((CLASSES, PLACES), np.float32),
    }


_PAST = np.tril(np.ones((WIDTH, WIDTH), np.float32))


def hidden(p, ids):
    """ids: windows x WIDTH. State that predicts the next id at every place, and what the gradients need."""
    h = np.take(p["embed"], ids, axis=0)
    h += p["place"]
    flat = h.reshape(-1, DIM)
    q, k, v = ((flat @ p[n]).reshape(h.shape) for n in ("query", "key", "value"))
    q *= np.float32(DIM**-0.5)
    s = q @ k.transpose(0, 2, 1)
    np.minimum(s, np.float32(60), out=s)  # far beyond what training reaches; keeps the exponentials finite
    np.exp(s, out=s)
    s *= _PAST
    total = s.sum(axis=2, keepdims=True)
    o = s @ v
    o /= total
    u = flat @ p["last"] + o.reshape(-1, DIM) @ p["mix"]
    return u, (h, q, k, v, s, total, o)


_ONES = np.ones(max(CLASSES, PLACES), np.float32)


def _picked(x, place):
    """Logarithm of the softmax at one place of each row. Logits are corrected log-probabilities, so they need no shift."""
    out = np.take(x, np.arange(0, x.size, x.shape[1]) + place)
    np.exp(x, out=x)
    return out - np.log(x @ _ONES[: x.shape[1]])


def ready(p, base):
    """Parameters for scoring: biases folded into the prior, and what the attention takes from an id and from a place.

    Its columns are query, key, value as mixed for the output, 1, and the part that skips the attention.
    """
    skip, scale = np.zeros((DIM, 1), np.float32), np.float32(DIM**-0.5)
    every = np.concatenate([p["query"] * scale, p["key"], p["value"] @ p["mix"], skip, p["last"]], axis=1)
    by_slot, by_place = p["embed"] @ every, p["place"] @ every
    by_slot[:, 3 * DIM] = 1
    most = lambda a: sum(np.sqrt((t[:, a : a + DIM] ** 2).sum(axis=1)).max() for t in (by_slot, by_place))
    p = p | {"by_slot": by_slot, "by_place": by_place, "most": most(0) * most(DIM)}
    return p | {"class_p": base["class"] + p["class_b"], "slot_p": np.ascontiguousarray((base["slot"] + p["slot_b"]).transpose(1, 0, 2))}


def states(p, ids, begin: int):
    """As hidden(), of the places from `begin` on. p: from ready()."""
    x = np.take(p["by_slot"], ids, axis=0)
    x += p["by_place"]
    s = x[:, begin:, :DIM] @ x[:, :, DIM : 2 * DIM].transpose(0, 2, 1)
    if p["most"] > 60:  # no two ids and places go beyond it
        np.minimum(s, np.float32(60), out=s)
    np.exp(s, out=s)
    s *= _PAST[begin:]
    o = s @ x[:, :, 2 * DIM : 3 * DIM + 1]  # the last column: what the weights sum up to
    u = o[:, :, :DIM] / o[:, :, DIM:]
    u += x[:, begin:, 3 * DIM + 1 :]
    return u.reshape(-1, DIM)


def log_probabilities(p, u, current, target):
    """Natural logarithm of the probability of each target slot, given the current one and its state. p: from ready()."""
    c, place = target // PLACES, target % PLACES
    out = np.empty(len(u), np.float32)
    for lo in range(0, len(u), ROWS):
        own = slice(lo, lo + ROWS)
        x = u[own] @ p["class_w"]
        x += np.take(p["class_p"], current[own], axis=0)
        out[own] = _picked(x, c[own])
    order = np.argsort(c.astype(np.int8), kind="stable")
    edges = np.searchsorted(c[order], np.arange(CLASSES + 1))
    u, place, current = np.take(u, order, axis=0), place[order], current[order]
    inner = np.empty(len(u), np.float32)
    for k in range(CLASSES):
        a, b = edges[k], edges[k + 1]
        if b > a:
            x = u[a:b] @ p["slot_w"][k]
            x += np.take(p["slot_p"][k], current[a:b], axis=0)
            inner[a:b] = _picked(x, place[a:b])
    out[order] += inner
    return out


def gradients(p, base, ids, target, by_class=None):
    """Gradients of the mean negative log-probability of the targets (windows x WIDTH each). Negative targets do not count.

    by_class: base["slot"] with classes first, where it is at hand.
    """
    ids = np.maximum(ids, 0)
    by_class = np.ascontiguousarray(base["slot"].transpose(1, 0, 2)) if by_class is None else by_class
    u, (h, q, k, v, a, total, o) = hidden(p, ids)
    a /= total
    flat = h.reshape(-1, DIM)
    current = ids.ravel()
    order = np.flatnonzero(target.ravel() >= 0)
    n = max(len(order), 1)
    c = target.ravel()[order] // PLACES
    by = np.argsort(c.astype(np.int8), kind="stable")
    order, c = order[by], c[by]
    edges = np.searchsorted(c, np.arange(CLASSES + 1))
    place, now, us = target.ravel()[order] % PLACES, current[order], u[order]
    g = {}
    d = us @ p["class_w"]
    d += p["class_b"]
    d += np.take(base["class"], now, axis=0)
    d = _errors(d, c, n)
    g["class_w"], g["class_b"] = us.T @ d, d.sum(axis=0)
    dus = d @ p["class_w"].T
    g["slot_w"], g["slot_b"] = np.zeros_like(p["slot_w"]), np.zeros_like(p["slot_b"])
    for j in range(CLASSES):
        lo, hi = edges[j], edges[j + 1]
        if hi > lo:
            d = us[lo:hi] @ p["slot_w"][j]
            d += p["slot_b"][j]
            d += np.take(by_class[j], now[lo:hi], axis=0)
            d = _errors(d, place[lo:hi], n)
            g["slot_w"][j], g["slot_b"][j] = us[lo:hi].T @ d, d.sum(axis=0)
            dus[lo:hi] += d @ p["slot_w"][j].T
    du = np.zeros_like(u)
    du[order] = dus
    g["last"], g["mix"] = flat.T @ du, o.reshape(-1, DIM).T @ du
    dh = du @ p["last"].T
    do = (du @ p["mix"].T).reshape(h.shape)
    da = do @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ do
    da -= (do * o).sum(axis=2, keepdims=True)  # what the softmax takes off is the same for a whole row
    da *= a
    dk = da.transpose(0, 2, 1) @ q
    dq = da @ k
    dq *= np.float32(DIM**-0.5)
    for name, grad in (("query", dq), ("key", dk), ("value", dv)):
        grad = grad.reshape(-1, DIM)
        g[name] = flat.T @ grad
        dh += grad @ p[name].T
    g["place"] = dh.reshape(h.shape).sum(axis=0)
    at = current[:, None] * DIM + np.arange(DIM)
    g["embed"] = np.bincount(at.ravel(), dh.ravel(), SLOTS * DIM).astype(np.float32).reshape(SLOTS, DIM)
    return g


def _errors(x, place, n):
    """Of logits near log-probabilities (which need no shift): softmax less the one at place, over n."""
    np.exp(x, out=x)
    x /= (x @ _ONES[: x.shape[1]])[:, None] * np.float32(n)
    x.ravel()[np.arange(0, x.size, x.shape[1]) + place] -= np.float32(1 / n)
    return x


def train(p, base, windows, rate):
    """One pass of Adam over windows (n x WIDTH + 1 slots) from the given parameters; returns new ones."""
    p = {k: x.copy() for k, x in p.items()}
    by_class = np.ascontiguousarray(base["slot"].transpose(1, 0, 2))
    first, second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step, lo in enumerate(range(0, len(windows), BATCH), 1):
        part = windows[lo : lo + BATCH].astype(np.int64)
        warm = rate * min(1.0, step / 10)
        for k, g in gradients(p, base, part[:, :-1], part[:, 1:], by_class).items():
            first[k] += (g - first[k]) * np.float32(0.1)
            second[k] += (g * g - second[k]) * np.float32(0.01)
            p[k] -= np.float32(warm / (1 - 0.9**step)) * first[k] / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-7))
    return p


def score_each(p, base, slots, first):
    """Natural log-probability of every slot but the first of each sequence, in order: slots end to end, `first` the
    index of each sequence's first (one more entry than sequences). Each is scored once, by the first overlapping window
    that holds it.
    """
    p, slots = ready(p, base), slots.astype(np.int32)
    out = np.zeros(len(slots) - (len(first) - 1))
    size = np.diff(first) - 1  # scored slots, and inputs that predict them
    count = np.where(size > WIDTH, 1 + -(-(size - WIDTH) // STRIDE), 1)
    owner = np.repeat(np.arange(len(size)), count)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    for skip, rows in ((0, np.flatnonzero(begin == 0)), (WIDTH - STRIDE, np.flatnonzero(begin))):  # places that the window before has scored
        for lo in range(0, len(rows), SCORED):
            own, at = owner[rows[lo : lo + SCORED]], begin[rows[lo : lo + SCORED]]
            index = first[own][:, None] + np.minimum(at[:, None] + np.arange(WIDTH), np.maximum(size[own] - 1, 0)[:, None])
            ids = slots[index]
            u = np.concatenate([states(p, ids[k : k + CHUNK], skip) for k in range(0, len(ids), CHUNK)])
            fresh = (at[:, None] + np.arange(skip, WIDTH) < size[own][:, None]).ravel()
            at = index[:, skip:].ravel()[fresh]
            out[at - np.repeat(own, WIDTH - skip)[fresh]] = log_probabilities(p, u[fresh], slots[at], slots[at + 1])
    return out


def score_prior(base, slots, first):
    """As score_each, by the prior alone."""
    slots = slots.astype(np.int64)
    inputs = np.ones(len(slots), bool)
    inputs[first[1:] - 1] = False
    at = np.flatnonzero(inputs)
    c, place = slots[at + 1] // PLACES, slots[at + 1] % PLACES
    return base["class"][slots[at], c].astype(float) + base["slot"][slots[at], c, place]


def score(p, base, slots, first):
    """Sums of score_each by sequence."""
    size = np.diff(first) - 1
    return np.bincount(np.repeat(np.arange(len(size)), size), score_each(p, base, slots, first), minlength=len(size))
