"""Models of one round on one series, as small functions on numpy arrays: they run inside tasks, many rounds side by side.

A model takes (data, **parameters). data has x_train, y_train, x_val, y_val, x_test, y_test
and features (their names). It returns a dict with prediction and proba for the test rows, and
perhaps extras (numbers by name).
"""

from __future__ import annotations

import numpy as np

#: The thresholds that are tried, and the one that stands if none gives a positive. Fixed values.
LOW, HIGH, STEP, DEFAULT_THRESHOLD = 0.20, 0.70, 0.05, 0.35


def fit_logistic(x, y, c: float = 1.0, zero_weight: float = 1.0, rounds: int = 50, tol: float = 1e-10):
    """Newton steps for weighted logistic regression with an L2 penalty 1 / c (not on the bias)."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.where(y == 1, 1.0, zero_weight)
    beta, penalty = np.zeros(x1.shape[1]), np.full(x1.shape[1], 1.0 / c)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        grad = x1.T @ (w * (p - y)) + penalty * beta
        step = np.linalg.solve((x1.T * (w * p * (1 - p))) @ x1 + np.diag(penalty + 1e-9), grad)
        beta -= step
        if np.abs(step).max() < tol:
            break
    return lambda z: 1 / (1 + np.exp(-np.clip(np.column_stack([z, np.ones(len(z))]) @ beta, -30, 30)))


def grow_tree(x, residual, rows, columns, depth: int, least: float, l1: float, l2: float, gamma: float, rate: float) -> list:
    """A regression tree on squared loss, as nested [column, cut, left, right] or the leaf's value; splits maximise the regularised gain."""

    def strength(g, n):
        g = np.sign(g) * np.maximum(np.abs(g) - l1, 0)
        return g * g / (n + l2)

    def leaf(own):
        g = residual[own].sum()
        return float(rate * np.sign(g) * max(abs(g) - l1, 0) / (len(own) + l2))

    def node(own, left_depth):
        best = (2 * gamma, None)  # the gain must exceed gamma
        if left_depth and len(own) >= 2 * least:
            whole = strength(residual[own].sum(), len(own))
            for j in columns:
                order = own[np.argsort(x[own, j], kind="stable")]
                v, g, n = x[order, j], np.cumsum(residual[order])[:-1], np.arange(1, len(own))
                ok = (v[1:] > v[:-1]) & (n >= least) & (len(own) - n >= least)
                if ok.any():
                    gain = np.where(ok, strength(g, n) + strength(residual[own].sum() - g, len(own) - n) - whole, -np.inf)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (j, (v[i] + v[i + 1]) / 2))
        if best[1] is None:
            return leaf(own)
        j, cut = best[1]
        low = x[own, j] <= cut
        return [j, cut, node(own[low], left_depth - 1), node(own[~low], left_depth - 1)]

    return node(rows, depth)


def run_tree(tree, x):
    if not isinstance(tree, list):
        return np.full(len(x), tree)
    j, cut, left, right = tree
    low = x[:, j] <= cut
    out = np.empty(len(x))
    out[low], out[~low] = run_tree(left, x[low]), run_tree(right, x[~low])
    return out


def fit_boosted(x, y, x_val=None, y_val=None, learning_rate: float = 0.01, max_depth: int = 3, n_estimators: int = 500, min_child_weight: float = 10, subsample: float = 0.6, colsample_bytree: float = 0.6, gamma: float = 0.5, reg_alpha: float = 0.5, reg_lambda: float = 5.0, early_stopping_rounds: int | None = 50, random_state: int = 42):
    """Boosted trees for squared loss with row and column samples, L1 and L2 penalties, stopped early on the validation rows."""
    rng, base = np.random.default_rng(random_state), float(np.mean(y))
    f, trees, best, best_n = np.full(len(y), base), [], np.inf, 0
    watch = x_val is not None and len(x_val) and early_stopping_rounds
    f_val = np.full(len(x_val), base) if watch else None
    n_columns = max(1, round(x.shape[1] * colsample_bytree))
    for _ in range(n_estimators):
        rows = np.flatnonzero(rng.random(len(y)) < subsample)
        columns = np.sort(rng.choice(x.shape[1], n_columns, replace=False))
        if not len(rows):
            continue
        tree = grow_tree(x, y - f, rows, columns, max_depth, min_child_weight, reg_alpha, reg_lambda, gamma, learning_rate)
        trees.append(tree)
        f = f + run_tree(tree, x)
        if watch:
            f_val = f_val + run_tree(tree, x_val)
            loss = float(np.mean((f_val - y_val) ** 2))
            if loss < best:
                best, best_n = loss, len(trees)
            elif len(trees) - best_n >= early_stopping_rounds:
                break
    kept = trees[:best_n] if watch else trees
    return lambda z: base + sum((run_tree(t, z) for t in kept), np.zeros(len(z)))


def isotonic(x, y, weight=None):
    """Breakpoints of the non-decreasing fit by pooling adjacent violators; equal x count as one point."""
    xs, inverse = np.unique(x, return_inverse=True)
    w = np.bincount(inverse, weight)
    mean = np.bincount(inverse, np.asarray(y, float) * (1.0 if weight is None else weight)) / w
    pools: list[list[float]] = []  # mean, weight, points
    for m, n in zip(mean, w, strict=True):
        pools.append([m, n, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, n2, k2 = pools.pop()
            m1, n1, k1 = pools[-1]
            pools[-1] = [(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, k1 + k2]
    return xs, np.repeat([p[0] for p in pools], [p[2] for p in pools])


def platt(x, y, weight=None, rounds: int = 100):
    """Slope and intercept of the sigmoid on x, with the usual prior on the targets."""
    w = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    good, bad = float(w[y > 0].sum()), float(w[y <= 0].sum())
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x1, beta = np.column_stack([x, np.ones(len(x))]), np.array([0.0, np.log((good + 1) / (bad + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        step = np.linalg.solve((x1.T * (w * p * (1 - p))) @ x1 + 1e-12 * np.eye(2), x1.T @ (w * (p - t)))
        beta -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def best_threshold(y, proba, metric: str = "balanced", low: float = LOW, high: float = HIGH, step: float = STEP, default: float = DEFAULT_THRESHOLD) -> tuple[float, float]:
    """The first threshold of the best score; the default and -1 if none gives a positive."""
    y, best = np.asarray(y), (default, -1.0)
    for t in np.arange(low, high + step, step):
        p = proba >= t
        if p.any():
            tp, pp = float((p & (y == 1)).sum()), float(p.sum())
            score = {"f1": 2 * tp / (pp + float((y == 1).sum())), "precision": tp / pp, "accuracy": float((p == (y == 1)).mean())}.get(metric, tp / pp * np.sqrt(pp / len(p)))
            if score > best[1]:
                best = (float(t), score)
    return best


def logreg_binary(data: dict, C: float = 1.0, class_weight: float = 1.0, max_iter: int = 100, tol: float = 1e-4, solver: str = "newton", penalty: str = "l2") -> dict:
    """Logistic regression; class_weight is that of class 0. Newton steps stand for every solver."""
    if penalty != "l2":
        raise ValueError("only the l2 penalty is implemented")
    proba = fit_logistic(data["x_train"], data["y_train"], C, class_weight, max_iter, tol)(data["x_test"])
    return {"prediction": (proba >= 0.5).astype(float), "proba": proba}


def random_binary(data: dict, random_weights: float = 0.5, random_state: int = 0) -> dict:
    """Predictions by chance; random_weights is the share of class 0."""
    rng, n = np.random.default_rng(random_state), len(data["x_test"])
    return {"prediction": (rng.random(n) >= random_weights).astype(float), "proba": np.where(rng.random(n) >= random_weights, 0.9, 0.1)}


def boosted_regressor(data: dict, learning_rate: float = 0.01, max_depth: int = 3, n_estimators: int = 500, min_child_weight: float = 10, subsample: float = 0.6, colsample_bytree: float = 0.6, gamma: float = 0.5, reg_alpha: float = 0.5, reg_lambda: float = 5.0, objective: str = "reg:squarederror", booster: str = "gbtree", early_stopping_rounds: int | None = 50, random_state: int = 42) -> dict:
    """Boosted regression trees."""
    if (objective, booster) != ("reg:squarederror", "gbtree"):
        raise ValueError("only squared loss on trees is implemented")
    f = fit_boosted(data["x_train"], data["y_train"], data["x_val"], data["y_val"], learning_rate, max_depth, n_estimators, min_child_weight, subsample, colsample_bytree, gamma, reg_alpha, reg_lambda, early_stopping_rounds, random_state)
    out = f(data["x_test"])
    return {"prediction": out, "proba": out}


def calibrated_binary(data: dict, use_calibration: bool = True, threshold_metric: str = "balanced", C: float = 1.0, classifier=None) -> dict:
    """A classifier (default: logistic regression), calibrated on the validation rows by isotonic regression, with the threshold chosen there.

    classifier: takes (x_train, y_train) and returns a function from rows to probabilities.
    """
    f = (classifier or (lambda x, y: fit_logistic(x, y, C)))(data["x_train"], data["y_train"])
    val, test = f(data["x_val"]), f(data["x_test"])
    if use_calibration and len(val):
        xs, ys = isotonic(val, data["y_val"])
        val, test = np.interp(val, xs, ys), np.interp(test, xs, ys)
    threshold, score = best_threshold(data["y_val"], val, threshold_metric)
    return {"prediction": (test >= threshold).astype(float), "proba": test, "extras": {"optimal_threshold": threshold, "val_score": score}}
