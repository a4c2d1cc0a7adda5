"""Incremental reduced-error pruning: an ordered list of threshold rules from labelled rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rule:
    """``label`` if every (feature, is_le, threshold) holds."""

    label: str
    tests: tuple[tuple[str, bool, float], ...]


def _covers(x: np.ndarray, tests: Sequence[tuple[int, bool, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, le, cut in tests:
        hit &= (x[:, j] <= cut) if le else (x[:, j] > cut)
    return hit


def _grow(x: np.ndarray, y: np.ndarray, features: Sequence[int], most: int = 5) -> list[tuple[int, bool, float]]:
    """Adds the test of one of the ``features`` with the best FOIL gain until no negative is covered."""
    tests: list[tuple[int, bool, float]] = []
    hit = np.ones(len(x), bool)
    while len(tests) < most and (hit & ~y).any() and (hit & y).any():
        p0, n0 = (hit & y).sum(), (hit & ~y).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for j in features:
            order = np.argsort(x[hit, j], kind="stable")
            v, pos = x[hit, j][order], y[hit][order]
            edge = np.flatnonzero(np.diff(v) > 1e-12)
            if not len(edge):
                continue
            p_le, n_le = np.cumsum(pos)[edge], np.cumsum(~pos)[edge]
            for le, p, n in ((True, p_le, n_le), (False, p0 - p_le, n0 - n_le)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (j, le, float((v[edge[k]] + v[edge[k] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        hit &= _covers(x, [best[1]])
    return tests


def _prune(x: np.ndarray, y: np.ndarray, tests: list[tuple[int, bool, float]]) -> list[tuple[int, bool, float]]:
    """Drops final tests while (p - n) / (p + n) on the pruning rows does not fall."""
    def worth(ts: list) -> float:
        hit = _covers(x, ts)
        p, n = (hit & y).sum(), (hit & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0
    best = list(tests)
    for k in range(len(tests) - 1, 0, -1):
        if worth(tests[:k]) >= worth(best):
            best = tests[:k]
    return best


def induce(x: np.ndarray, labels: np.ndarray, names: Sequence[str], default: str, seed: int = 0, most_rules: int = 12, splits: int = 12, least: float = 0.95, fewest: float = 0.01) -> list[Rule]:
    """An ordered rule list: classes from the rarest on, each by incremental reduced-error pruning.

    A rule depends much on its split into growing and pruning rows and on its first test, so each is
    grown and pruned on ``splits`` of them, all but the first with a random half of the features, and the
    one that gains most over all rows left is kept.  A class is done once no
    rule is right in ``least`` of the rows it covers and finds ``fewest`` of the class: rules for a
    handful of rows do not carry over to other texts.  Rows with missing values are left out.  No rows, or one class only, give no rules.
    """
    keep = ~np.isnan(x).any(axis=1)
    x, labels = x[keep], labels[keep]
    rng = np.random.default_rng(seed)
    left, out = np.ones(len(x), bool), []
    classes = sorted((c for c in set(labels) if c != default), key=lambda c: ((labels == c).sum(), c))
    for c in classes:
        for _ in range(most_rules):
            rows = np.flatnonzero(left)
            y = labels[rows] == c
            if y.sum() < 3:  # nothing is left to learn from
                break
            base, best, gain = np.log2(y.mean()), None, 0.0
            for number in range(splits):
                some = np.arange(x.shape[1]) if number == 0 else np.sort(rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2])
                mixed = rng.permutation(len(rows))
                cut = 2 * len(rows) // 3
                grow, prune = rows[mixed[:cut]], rows[mixed[cut:]]
                tests = _prune(x[prune], labels[prune] == c, _grow(x[grow], labels[grow] == c, some.tolist()))
                hit = _covers(x[rows], tests)
                p, n = (hit & y).sum(), (hit & ~y).sum()
                if tests and p >= max(3, fewest * (labels == c).sum()) and p >= least * (p + n) and p * (np.log2((p + 1) / (p + 2 * n + 2)) - base) > gain:  # a wrong row weighs twice
                    best, gain = tests, p * (np.log2((p + 1) / (p + 2 * n + 2)) - base)
            if best is None:
                break
            out.append(Rule(str(c), tuple((names[j], le, t) for j, le, t in best)))
            left &= ~_covers(x, best)
    return out


def to_case(rules: Sequence[Rule], default: str) -> str:
    """The rule list as a SQL CASE expression."""
    if not rules:
        return f"'{default}'"
    whens = [f"when {' and '.join(f'{n} {"<=" if le else ">"} {t!r}D' for n, le, t in r.tests)} then '{r.label}'" for r in rules]
    return "case " + " ".join(whens) + f" else '{default}' end"
