"""Decision trees read back from a fitted Spark forest as plain nested tuples."""

from __future__ import annotations

import re
from typing import Union

#: (feature, threshold, subtree where feature <= threshold, subtree where it is larger), or the value of a leaf
Tree = Union[float, tuple]

_IF = re.compile(r"If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"Predict: (\S+)")


def parse(debug_string: str) -> Tree:
    """The tree that `toDebugString` prints; every split is on a continuous feature."""
    lines = iter([x.strip() for x in debug_string.splitlines() if "feature" in x or "Predict" in x])

    def node() -> Tree:
        line = next(lines)
        if leaf := _LEAF.match(line):
            return float(leaf[1])
        split = _IF.match(line)
        left = node()
        next(lines)  # Else
        return int(split[1]), float(split[2]), left, node()

    return node()


def value(tree: Tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def paths(tree: Tree, so_far: tuple = ()) -> list[tuple]:
    """Every path from the root as conditions (feature, is_greater, threshold), inner nodes included."""
    if not isinstance(tree, tuple):
        return [so_far] if so_far else []
    feature, threshold, low, high = tree
    return ([so_far] if so_far else []) + paths(low, (*so_far, (feature, False, threshold))) + paths(high, (*so_far, (feature, True, threshold)))


def simplify(path: tuple) -> tuple:
    """Conditions on one feature and direction merged into the tightest, in fixed order."""
    best: dict[tuple[int, bool], float] = {}
    for feature, greater, threshold in path:
        old = best.get((feature, greater))
        best[feature, greater] = threshold if old is None else (max if greater else min)(old, threshold)
    return tuple((f, g, t) for (f, g), t in sorted(best.items()))
