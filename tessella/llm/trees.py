"""A small classification tree (Gini impurity, axis-parallel cuts), as nested tuples."""

from __future__ import annotations


def _gini(rows: list, labels: list) -> float:
    n = len(labels)
    return n - sum(labels.count(c) ** 2 for c in set(labels)) / n if n else 0.0


def grow(rows: list[tuple], labels: list, depth: int = 8, least: int = 1):
    """``(feature, cut, below-or-equal, above)`` or a label. Of equal cuts the first feature and the lowest cut win."""
    if len(set(labels)) == 1 or not depth:
        return max(sorted(set(labels)), key=labels.count)
    best = None
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low = [c for r, c in zip(rows, labels, strict=True) if r[f] <= cut]
            high = [c for r, c in zip(rows, labels, strict=True) if r[f] > cut]
            if min(len(low), len(high)) >= least and (best is None or _gini(rows, low) + _gini(rows, high) < best[0] - 1e-9):
                best = (_gini(rows, low) + _gini(rows, high), f, cut)
    if best is None:
        return max(sorted(set(labels)), key=labels.count)
    _, f, cut = best
    side = [r[f] <= cut for r in rows]
    part = lambda s: ([r for r, x in zip(rows, side, strict=True) if x == s], [c for c, x in zip(labels, side, strict=True) if x == s])
    return f, cut, grow(*part(True), depth - 1, least), grow(*part(False), depth - 1, least)


def decide(tree, row: tuple):
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree
