"""A causal self-attention model of subword classes in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Classes (frequent subwords and one for the rest) of the input, of the input before it, of the output; width; positions seen
#: before a window's stride; tokens that a window scores.
INPUTS, BEFORE, OUTPUTS, WIDTH, SIGHT, STRIDE = 512, 64, 128, 16, 16, 16
#: A subword of a class for the rest is told by LEVELS digits below BASE, so inputs and outputs tell all subwords apart. Those whose first
#: digit is below NEAR are counted behind each input class.
BASE, LEVELS, NEAR = 37, 3, 3
RATE, BATCH = 0.01, 128
SHAPES = {
    "qe": (INPUTS + 1 + LEVELS * BASE, 2 * WIDTH), "kv": (INPUTS + 1 + LEVELS * BASE, 2 * WIDTH), "u": (WIDTH, OUTPUTS), "digits": (LEVELS, WIDTH, BASE),
    "r": (SIGHT + STRIDE,),
}
ONES = np.ones(OUTPUTS, np.float32)
PAD = INPUTS  # the class behind the end of what can be seen
#: Groups of a level that are told apart behind each input class.
GROUPS = [1 if level == 0 else NEAR * BASE ** (level - 1) for level in range(LEVELS)]


@dataclass
class Attention:
    """Single-head attention with relative positions on top of a table of class triples.

    logits(next) = triple[last but one, last, next] + (embedding of last + attention over the last SIGHT classes) @ u

    Inputs are codes: a class, or beyond PAD, the number of a subword of the last class, whose embedding is that of the class and of its digits.
    Targets are a class, or from OUTPUTS on, the number of a subword of the last class. Its digits have a softmax each, of the same sum @ digits on
    top of `rest`, a table of each level: a row for each input class in front and group below GROUPS, then one for each group of digits before.
    """

    triple: np.ndarray
    weights: dict[str, np.ndarray]
    rest: list[np.ndarray]


def fresh(triple: np.ndarray, rest: list[np.ndarray] | None = None, seed: int = 5) -> Attention:
    draw = np.random.default_rng(seed)
    weights = {name: (draw.normal(0, 0.1, shape)).astype(np.float32) for name, shape in SHAPES.items()}
    weights["r"][:] = 0
    if rest is None:
        rest = [np.zeros((INPUTS * near + BASE**level, BASE)) for level, near in enumerate(GROUPS)]
    return Attention(triple.astype(np.float32).reshape(-1, OUTPUTS), weights, [table.astype(np.float32) for table in rest])


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = np.asarray(values[at : at + n], np.float32).reshape(shape).copy()
        at += n
    return out


# query i of a window looks at key j: what lies before the window's stride, and the stride up to itself
_QUERY, _KEY = np.arange(STRIDE)[:, None], np.arange(SIGHT + STRIDE)[None, :]
_BACK = _QUERY + SIGHT - _KEY
ALLOWED = (_BACK >= 0) & (_BACK < SIGHT + STRIDE)
BACK = np.clip(_BACK, 0, SIGHT + STRIDE - 1)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over sequences put behind each other: where their stride starts, and where their sequence starts and ends.

    Every position is in the stride of one window, so it is scored once; SIGHT positions before the stride are seen again.
    """
    count = -(-lengths // STRIDE)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    of = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return begin[of] + nth * STRIDE, begin[of], (begin + lengths)[of]


def _seen(classes: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(-SIGHT, STRIDE)
    inside = (at >= low[:, None]) & (at < high[:, None])
    return np.where(inside, classes[np.clip(at, 0, len(classes) - 1)], PAD)


def _digits(number: np.ndarray) -> np.ndarray:
    return np.stack([number // BASE ** (LEVELS - 1 - level) % BASE for level in range(LEVELS)], -1)


def _rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the embedding tables for codes: that of the class, then places of subwords told by digits, and their digits' rows."""
    rare = np.flatnonzero(x > PAD)
    rows = np.where(x > PAD, INPUTS - 1, x).astype(np.uint16).ravel()
    return rows, rare, (INPUTS + 1 + np.arange(LEVELS) * BASE + _digits(x.ravel()[rare] - PAD - 1)).astype(np.uint16)


def _embedded(table: np.ndarray, at: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    rows, rare, digits = at
    found = table.take(rows, 0)
    found[rare] += table[digits].sum(1)
    return found


def _spread(slope: np.ndarray, at: tuple[np.ndarray, np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Slopes of the tables' rows from those of the places that took them."""
    rows, rare, digits = at
    rows = np.concatenate([rows, digits.ravel()])
    order = np.argsort(rows, kind="stable")
    place = np.concatenate([np.arange(len(slope)), np.repeat(rare, LEVELS)])[order]
    begin = np.flatnonzero(np.diff(rows[order], prepend=-1))
    out = np.zeros((size, slope.shape[1]), np.float32)
    out[rows[order[begin]]] = np.add.reduceat(slope.take(place, 0), begin, axis=0)
    return out


def _forward(model: Attention, x: np.ndarray) -> tuple:
    w, n = model.weights, len(x)
    seen, last = _rows(x), _rows(x[:, SIGHT:])
    qe = _embedded(w["qe"], last).reshape(n, STRIDE, 2, WIDTH)
    kv = _embedded(w["kv"], seen).reshape(n, SIGHT + STRIDE, 2, WIDTH)
    q, k, v = qe[:, :, 0], kv[:, :, 0], kv[:, :, 1]
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(WIDTH**-0.5)
    a += w["r"][BACK] + np.where(ALLOWED, np.float32(0), np.float32(-1e9))
    # scores stay small, so they need no largest one taken off before exp; a query always sees itself
    np.exp(a, out=a)
    a *= (x != PAD)[:, None, :]
    a /= np.maximum(a.sum(2, keepdims=True), np.float32(1e-30))
    h = a @ v
    h += qe[:, :, 1]
    h = h.reshape(-1, WIDTH)
    logits = h @ w["u"]
    class_ = np.minimum(last[0], INPUTS - 1).astype(np.int64)
    logits += model.triple.take(np.minimum(x[:, SIGHT - 1 : -1], BEFORE - 1).ravel() * INPUTS + class_, 0)
    return seen, last, class_, q, k, v, a, h, logits


def _told(model: Attention, level: int, number: np.ndarray, class_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of a digit of subwords of the last class, by number, behind the digits before it; and the digit."""
    group, near = number // BASE ** (LEVELS - level), GROUPS[level]
    rows = np.where(group < near, class_ * near, INPUTS * near) + group
    logits = h @ model.weights["digits"][level]
    logits += model.rest[level].take(rows, 0)
    return logits, number // BASE ** (LEVELS - 1 - level) % BASE


def log_probabilities(model: Attention, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, batch: int = 192) -> np.ndarray:
    """Natural log probability of the target at every position, for sequences put behind each other."""
    start, low, high = windows(lengths)
    out = np.zeros(len(inputs), np.float32)
    for i in range(0, len(start), batch):
        s = start[i : i + batch]
        _, _, class_, *_, h, logits = _forward(model, _seen(inputs, s, low[i : i + batch], high[i : i + batch]))
        at = (s[:, None] + np.arange(STRIDE)).ravel()
        real = np.flatnonzero(at < np.repeat(high[i : i + batch], STRIDE))
        at = at[real]
        target = targets[at]
        own = logits[real, np.minimum(target, OUTPUTS - 1)]
        np.exp(logits, out=logits)
        out[at] = own - np.log(logits @ ONES)[real]
        told = np.flatnonzero(target >= OUTPUTS)
        real, at, number = real[told], at[told], target[told] - OUTPUTS
        for level in range(LEVELS if len(told) else 0):
            logits, digit = _told(model, level, number, class_[real], h[real])
            own = logits[np.arange(len(told)), digit]
            np.exp(logits, out=logits)
            out[at] += own - np.log(logits.sum(1))
    return out


def train(model: Attention, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, part: int, parts: int, seed: int) -> int:
    """Adam over one of `parts` parts of the windows, dealt at random; changes the model, returns the windows used.

    With the same seed the parts have no window in common and together they are all windows.
    """
    start, low, high = windows(lengths)
    if not len(start):
        return 0
    chosen = np.random.default_rng(seed).permutation(len(start))[part::parts]
    first = {n: np.zeros_like(x) for n, x in model.weights.items()}
    second = {n: np.zeros_like(x) for n, x in model.weights.items()}
    for step, i in enumerate(range(0, len(chosen), BATCH), 1):
        c = chosen[i : i + BATCH]
        x = _seen(inputs, start[c], low[c], high[c])
        seen, last, class_, q, k, v, a, h, p = _forward(model, x)
        at = (start[c][:, None] + np.arange(STRIDE)).ravel()
        inside = at < np.repeat(high[c], STRIDE)
        real = np.flatnonzero(inside)
        target = targets[at[real]]
        share = np.float32(1 / max(len(real), 1))
        # scores stay small here too
        np.exp(p, out=p)
        p *= (np.where(inside, share, np.float32(0)) / (p @ ONES))[:, None]
        p[real, np.minimum(target, OUTPUTS - 1)] -= share
        w = model.weights
        slope = {"u": h.T @ p, "digits": np.zeros_like(w["digits"])}
        dh = p @ w["u"].T
        told = np.flatnonzero(target >= OUTPUTS)
        number, told = target[told] - OUTPUTS, real[told]
        for level in range(LEVELS if len(told) else 0):
            own = h[told]
            p, digit = _told(model, level, number, class_[told], own)
            np.exp(p, out=p)
            p *= (share / p.sum(1))[:, None]
            p[np.arange(len(told)), digit] -= share
            slope["digits"][level] = own.T @ p
            dh[told] += p @ w["digits"][level].T
        dh = dh.reshape(len(c), STRIDE, WIDTH)
        dqe = np.empty((len(c), STRIDE, 2, WIDTH), np.float32)
        dkv = np.empty((len(c), SIGHT + STRIDE, 2, WIDTH), np.float32)
        dqe[:, :, 1] = dh
        dkv[:, :, 1] = a.transpose(0, 2, 1) @ dh
        da = dh @ v.transpose(0, 2, 1)
        da -= np.einsum("nij,nij->ni", da, a)[:, :, None]
        da *= a
        slope["r"] = np.bincount(BACK.ravel(), da.sum(0).ravel(), SIGHT + STRIDE).astype(np.float32)
        da *= np.float32(WIDTH**-0.5)
        dqe[:, :, 0] = da @ k
        dkv[:, :, 0] = da.transpose(0, 2, 1) @ q
        slope["qe"] = _spread(dqe.reshape(-1, 2 * WIDTH), last, len(w["qe"]))
        slope["kv"] = _spread(dkv.reshape(-1, 2 * WIDTH), seen, len(w["kv"]))
        for n, g in slope.items():
            first[n] += np.float32(0.1) * (g - first[n])
            second[n] += np.float32(0.01) * (g * g - second[n])
            w[n] -= np.float32(RATE / (1 - 0.9**step)) * first[n] / (np.sqrt(second[n] * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-6))
    return len(chosen)
