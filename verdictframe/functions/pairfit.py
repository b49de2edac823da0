"""Small numeric helpers run inside tasks on per-group pair counts."""

from __future__ import annotations

import math

import numpy as np

COEF_BOUND = 30.0


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def components(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Connected-component label of each model in the battle graph."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        if np.array_equal(new, label):
            return label
        label = new


def centred(coef: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Ratings are only defined up to a shift per component: make each sum 0."""
    sums = np.bincount(label, coef, minlength=len(coef))
    sizes = np.bincount(label, minlength=len(coef))
    return coef - sums[label] / sizes[label]


def has_finite_fit(left, right, a_win, b_win, label) -> bool:
    """Whether every component is strongly connected by "has beaten".

    Otherwise some models never lose to the rest and their strengths grow
    without end.
    """
    winner = np.concatenate([left[a_win > 0], right[b_win > 0]])
    loser = np.concatenate([right[a_win > 0], left[b_win > 0]])
    roots = np.unique(label)
    for start, end in ((winner, loser), (loser, winner)):
        seen = np.zeros(len(label), dtype=bool)
        seen[roots] = True
        while True:
            before = seen.sum()
            seen[end[seen[start]]] = True
            if seen.sum() == before:
                break
        if not seen.all():
            return False
    return True


def fit_bradley_terry(left, right, a_win, b_win, size, max_iter=200, tol=1e-10):
    """Newton fit of log-odds strengths; returns (coef, converged).

    Pairs with only wins on one side can push coefficients to infinity; they
    are held at ``COEF_BOUND`` and reported as not converged.
    """
    coef = np.zeros(size)
    label = components(size, left, right)
    total = a_win + b_win
    finite = has_finite_fit(left, right, a_win, b_win, label)
    same = (label[:, None] == label[None, :]).astype(float)
    for _ in range(max_iter):
        p = sigmoid(coef[left] - coef[right])
        slope = a_win - total * p
        grad = np.bincount(left, slope, size) - np.bincount(right, slope, size)
        w = total * p * (1 - p)
        hess = np.zeros((size, size))
        np.add.at(hess, (left, left), w)
        np.add.at(hess, (right, right), w)
        np.add.at(hess, (left, right), -w)
        np.add.at(hess, (right, left), -w)
        step = np.linalg.lstsq(hess + same * max(w.mean(), 1e-12), grad, rcond=None)[0]
        biggest = np.abs(step).max(initial=0.0)
        if biggest > 2.0:
            step *= 2.0 / biggest
        coef = centred(coef + step, label)
        if np.abs(coef).max(initial=0.0) > COEF_BOUND:
            return np.clip(coef, -COEF_BOUND, COEF_BOUND), False
        if biggest < tol:
            return coef, finite
    return coef, False


def fit_rao_kupper(left, right, a_win, b_win, tie, size, eta=0.1, max_iter=300, tol=1e-10):
    """Newton fit of strengths with a tie parameter; (coef, eta, converged).

    With s1 = sigmoid(d - eta) and s2 = sigmoid(-d - eta) the tie probability
    1 - s1 - s2 equals (exp(2 eta) - 1) s1 s2, so the log likelihood is concave.
    """
    coef = np.zeros(size)
    label = components(size, left, right)
    same = (label[:, None] == label[None, :]).astype(float)
    up, down, ties = a_win + tie, b_win + tie, tie.sum()

    def value(c, e):
        d = c[left] - c[right]
        with np.errstate(over="ignore"):
            logs = -up * np.logaddexp(0, e - d) - down * np.logaddexp(0, e + d)
        return logs.sum() + ties * math.log(math.expm1(2 * e))

    if ties <= 0:
        return (*_no_tie_fit(left, right, a_win, b_win, size), False)
    current = value(coef, eta)
    for _ in range(max_iter):
        d = coef[left] - coef[right]
        s1, s2 = sigmoid(d - eta), sigmoid(-d - eta)
        g1, g2 = up * (1 - s1), down * (1 - s2)
        w1, w2 = up * s1 * (1 - s1), down * s2 * (1 - s2)
        x = math.exp(2 * eta)
        grad = np.zeros(size + 1)
        grad[:size] = np.bincount(left, g1 - g2, size) - np.bincount(right, g1 - g2, size)
        grad[size] = -(g1 + g2).sum() + ties * 2 * x / (x - 1)
        info = np.zeros((size + 1, size + 1))
        w = w1 + w2
        np.add.at(info, (left, left), w)
        np.add.at(info, (right, right), w)
        np.add.at(info, (left, right), -w)
        np.add.at(info, (right, left), -w)
        cross = np.bincount(left, w2 - w1, size) - np.bincount(right, w2 - w1, size)
        info[:size, size] = info[size, :size] = cross
        info[size, size] = w.sum() + ties * 4 * x / (x - 1) ** 2
        info[:size, :size] += same * max(w.mean(), 1e-12)
        step = np.linalg.lstsq(info, grad, rcond=None)[0]
        scale = 1.0
        while scale > 1e-9:
            new_eta = eta + scale * step[size]
            new_coef = centred(coef + scale * step[:size], label)
            if new_eta > 0 and value(new_coef, new_eta) >= current - 1e-12:
                break
            scale /= 2
        moved = np.abs(scale * step).max()
        coef, eta = new_coef, new_eta
        current = value(coef, eta)
        if np.abs(coef).max(initial=0.0) > COEF_BOUND:
            return np.clip(coef, -COEF_BOUND, COEF_BOUND), eta, False
        if moved < tol:
            return coef, eta, True
    return coef, eta, False


def _no_tie_fit(left, right, a_win, b_win, size):
    """Without ties the best tie parameter is 0: plain strengths."""
    return fit_bradley_terry(left, right, a_win, b_win, size)[0], 0.0


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation over n points, Student t with n-2."""
    if n < 3 or r != r:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)
