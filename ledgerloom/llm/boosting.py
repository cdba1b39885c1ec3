"""Gradient-boosted trees over a table of counted feature vectors.

Candidates have few different vectors of binned features, so Spark counts them (vector, positives, total)
and the trees are fitted on those counts; the table's size is bounded by the bins, not by the rows.
The fitted trees become one SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Stump2:
    """A tree of depth two: a test (feature >= cut), then one on each side; values at the four leaves."""

    tests: list[tuple[int, int]]
    values: list[float]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        side = [x[:, f] >= c for f, c in self.tests]
        return np.where(side[0], 2 + side[2], side[1].astype(int))

    def sql(self, at: str) -> str:
        test = [f"{at}[{f}] >= {c}" for f, c in self.tests]
        low = f"case when {test[1]} then {self.values[1]!r}D else {self.values[0]!r}D end"
        high = f"case when {test[2]} then {self.values[3]!r}D else {self.values[2]!r}D end"
        return f"case when {test[0]} then {high} else {low} end"


def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, int]:
    """The test with the largest gain."""
    found, most = (0, int(x[:, 0].min())), -1.0
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[1:]:
            up = x[:, f] >= c
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (up, ~up))
            if gain > most + 1e-12:
                found, most = (f, int(c)), gain
    return found


@dataclass
class Boosted:
    base: float
    trees: list[Stump2]

    @classmethod
    def fitted(cls, x: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = 20, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
        """Logistic loss on counted vectors: ``positive[i]`` of ``total[i]`` candidates with features ``x[i]``."""
        share = (positive.sum() + 1) / (total.sum() + 2)
        model = cls(float(np.log(share / (1 - share))), [])
        score = np.full(len(x), model.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = positive - total * p, total * p * (1 - p)
            tests = [_best(x, g, h, ridge)]
            up = x[:, tests[0][0]] >= tests[0][1]
            tests += [_best(x[s], g[s], h[s], ridge) if s.any() else (0, 0) for s in (~up, up)]
            tree = Stump2(tests, [0.0] * 4)
            leaf = tree.leaf(x)
            tree.values = [float(round(rate * g[leaf == k].sum() / (h[leaf == k].sum() + ridge), 9)) for k in range(4)]
            score = score + np.asarray(tree.values)[leaf]
            model.trees.append(tree)
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for t in self.trees:  # in the order in which the expressions add, so that both agree to the last bit
            total = total + np.asarray(t.values)[t.leaf(x)]
        return total

    def folded(self, at: str) -> str:
        """The same as ``sql``, as a fold over the trees' numbers, which are one literal: a short plan, however many trees there are."""
        if not self.trees:
            return f"{self.base!r}D"
        numbers = [v for t in self.trees for v in (*(x for test in t.tests for x in test), *t.values)]
        row = lambda k: f"w[i * 10 + {k}]"
        test = lambda k: f"{at}[cast({row(2 * k)} as int)] >= {row(2 * k + 1)}"
        step = f"o + if({test(0)}, if({test(2)}, {row(9)}, {row(8)}), if({test(1)}, {row(7)}, {row(6)}))"
        literal = f"cast(split('{','.join(map(repr, map(float, numbers)))}', ',') as array<double>)"
        return f"transform(array({literal}), w -> aggregate(sequence(0, {len(self.trees) - 1}), {self.base!r}D, (o, i) -> {step}))[0]"

    def sql(self, at: str) -> str:
        test = [f"{at}[{f}] >= {c}" for f, c in self.tests]
        low = f"case when {test[1]} then {self.values[1]!r}D else {self.values[0]!r}D end"
        high = f"case when {test[2]} then {self.values[3]!r}D else {self.values[2]!r}D end"
        return f"case when {test[0]} then {high} else {low} end"


def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, int]:
    """The test with the largest gain."""
    found, most = (0, int(x[:, 0].min())), -1.0
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[1:]:
            up = x[:, f] >= c
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (up, ~up))
            if gain > most + 1e-12:
                found, most = (f, int(c)), gain
    return found


@dataclass
class Boosted:
    base: float
    trees: list[Stump2]

    @classmethod
    def fitted(cls, x: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = 20, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
        """Logistic loss on counted vectors: ``positive[i]`` of ``total[i]`` candidates with features ``x[i]``."""
        share = (positive.sum() + 1) / (total.sum() + 2)
        model = cls(float(np.log(share / (1 - share))), [])
        score = np.full(len(x), model.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = positive - total * p, total * p * (1 - p)
            tests = [_best(x, g, h, ridge)]
            up = x[:, tests[0][0]] >= tests[0][1]
            tests += [_best(x[s], g[s], h[s], ridge) if s.any() else (0, 0) for s in (~up, up)]
            tree = Stump2(tests, [0.0] * 4)
            leaf = tree.leaf(x)
            tree.values = [float(round(rate * g[leaf == k].sum() / (h[leaf == k].sum() + ridge), 9)) for k in range(4)]
            score = score + np.asarray(tree.values)[leaf]
            model.trees.append(tree)
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for t in self.trees:  # in the order in which the expressions add, so that both agree to the last bit
            total = total + np.asarray(t.values)[t.leaf(x)]
        return total

    def folded(self, at: str) -> str:
        """The same as ``sql``, as a fold over an array of the trees: a short plan, however many there are."""
        rows = [f"named_struct({', '.join(f"'f{i}', {f}, 'c{i}', {c}" for i, (f, c) in enumerate(t.tests))}, {', '.join(f"'v{i}', {v!r}D" for i, v in enumerate(t.values))})" for t in self.trees]
        test = lambda i: f"{at}[t.f{i}] >= t.c{i}"
        return f"aggregate(array({', '.join(rows)}), {self.base!r}D, (o, t) -> o + if({test(0)}, if({test(2)}, t.v3, t.v2), if({test(1)}, t.v1, t.v0)))" if rows else f"{self.base!r}D"

    def sql(self, at: str) -> str:
        """The log-odds, as an expression over the integer array ``at``."""
        return " + ".join([f"{self.base!r}D", *(f"({t.sql(at)})" for t in self.trees)])


def threshold(score: np.ndarray, positive: np.ndarray, total: np.ndarray, precision: float) -> float:
    """The least score from which on held-out candidates reach ``precision``, by isotonic calibration; else infinity."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # least score, positives, total; calibrated shares rise from block to block
    for i in order:
        blocks.append([score[i], float(positive[i]), float(total[i])])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, p, t = blocks.pop()
            blocks[-1][1] += p
            blocks[-1][2] += t
    return next((float(s) for s, p, t in blocks if p >= precision * t), float("inf"))
