"""Slow, plain numpy forms of the array operators, written apart from the Spark code."""

from itertools import product

import numpy as np


def trunc_div(a, b):
    return abs(a) // b * (1 if a >= 0 else -1)


def reduce_window(values, method, integral):
    v = sorted(values)
    if method == "mean":
        return trunc_div(sum(v), len(v)) if integral else sum(v) / len(v)
    return {"min": v[0], "max": v[-1], "median": v[len(v) // 2], "max_sup": v[-2] if len(v) > 1 else v[0], "min_sup": v[1] if len(v) > 1 else v[0]}[method]


def halve(a, axes, method):
    shape = [(n + 1) // 2 if i in axes else n for i, n in enumerate(a.shape)]
    integral = a.dtype.kind in "iu"
    out = np.empty(shape, a.dtype)
    for at in product(*map(range, shape)):
        window = a[tuple(slice(2 * c, 2 * c + 2) if i in axes else slice(c, c + 1) for i, c in enumerate(at))].ravel()
        out[at] = reduce_window([x.item() for x in window], method, integral)
    return out


def fold(a, n, level, method):
    """Fold axis 0 in epochs of n frames."""
    groups: dict[int, list[int]] = {}
    for t in range(a.shape[0]):
        groups.setdefault(((t // n) >> level) * n + t % n, []).append(t)
    out = {}
    for key, ts in groups.items():
        frames = [a[t].astype(object) for t in ts]
        if method == "mean_fold":
            acc = frames[0]
            for f in frames[1:]:
                acc = np.vectorize(lambda x, y: (x + y) >> level, otypes=[object])(acc, f)
        elif method == "mean":
            acc = np.vectorize(trunc_div, otypes=[object])(sum(frames), len(frames))
        else:
            acc = np.stack(frames).min(0) if method == "min" else np.stack(frames).max(0)
        out[key] = acc
    return out


def cells_of(a, names):
    return [tuple(map(int, at)) + (a[at].item(),) for at in product(*map(range, a.shape))]
