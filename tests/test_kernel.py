"""The kernel machine against a plain dual solver, and its error bound against the full kernel."""

import warnings

import numpy as np
import pytest

from modalweave.operators import baselines as B
from modalweave.operators import kernel as K


def rings(n, seed=0):
    """Three rings around each other, some points astray, dealt to three donors."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    radius = 1.0 + 1.5 * y + rng.normal(scale=0.35, size=n)
    angle = rng.uniform(0, 2 * np.pi, n)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    return [(i, i % 3, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, donor int, y int, features array<double>").repartition(3)


def dual(kernel, sign, c, steps=4000):
    """Support vectors of two classes: the pair of multipliers that violates the most is moved, until none does."""
    alpha, grad = np.zeros(len(sign)), -np.ones(len(sign))
    for _ in range(steps):
        up = ((sign > 0) & (alpha < c)) | ((sign < 0) & (alpha > 0))
        low = ((sign > 0) & (alpha > 0)) | ((sign < 0) & (alpha < c))
        score = -sign * grad
        i, j = np.flatnonzero(up)[score[up].argmax()], np.flatnonzero(low)[score[low].argmin()]
        if score[i] - score[j] < 1e-4:
            break
        step = (score[i] - score[j]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = min(step, c - alpha[i] if sign[i] > 0 else alpha[i], alpha[j] if sign[j] > 0 else c - alpha[j])
        alpha[i] += sign[i] * step
        alpha[j] -= sign[j] * step
        grad += step * sign * (kernel[:, i] - kernel[:, j])
    return alpha, (score[i] + score[j]) / 2


def by_dual(train, test, gamma, c):
    x, y = np.array([r[3] for r in train]), np.array([r[2] for r in train])
    t = np.array([r[3] for r in test])
    votes = np.zeros((len(t), 3))
    for a in range(3):
        for b in range(a + 1, 3):
            at = np.flatnonzero((y == a) | (y == b))
            sign = np.where(y[at] == a, 1.0, -1.0)
            alpha, offset = dual(K.rbf(x[at], x[at], gamma), sign, c)
            above = K.rbf(t, x[at], gamma) @ (alpha * sign) + offset > 0
            votes[above, a] += 1
            votes[~above, b] += 1
    return votes.argmax(axis=1)


def test_agrees_with_a_dual_solver(spark):
    rows = rings(300)
    reports = {}
    got = {r["cell_id"]: (r["fold"], r["y_pred"]) for r in B.rbf_svm(frame(spark, rows), error=0.01, reports=reports).collect()}
    same = right = 0
    for fold in range(3):
        train, test = [r for r in rows if r[1] != fold], [r for r in rows if r[1] == fold]
        x = np.array([r[3] for r in train])
        want = by_dual(train, test, 1.0 / (2 * x.var()), 1.0)
        same += sum(got[r[0]] == (fold, int(w)) for r, w in zip(test, want, strict=True))
        right += sum(got[r[0]][1] == r[2] for r in test)
    assert same >= 0.95 * len(rows) and right >= 0.85 * len(rows), (same, right)
    assert set(reports) == {0, 1, 2} and all(r.error <= 0.01 and r.converged and len(r.steps) == 3 for r in reports.values())


def test_the_error_bounds_every_kernel_value(spark):
    rows = rings(400, seed=3)
    x = np.array([r[3] for r in rows])
    full = K.rbf(x, x, 0.4)
    for error in (0.5, 0.1, 0.001):
        model = K.fit_nystroem(frame(spark, rows), 0.4, 2, error, 400)
        z = model.features(x)
        assert np.abs(z @ z.T - full).max() <= model.error + 1e-7 and model.error <= error
        assert np.allclose(model.residual(x).max(), model.error)
        assert len({tuple(p) for p in model.landmarks}) == len(model.landmarks) < 200


def test_too_few_landmarks_or_steps_are_reported(spark):
    rows = rings(200, seed=4)
    df = frame(spark, [r[:2] + (r[2],) + r[3:] for r in rows])
    with pytest.warns(RuntimeWarning, match="landmarks leave an error"):
        machine = K.fit_pairs(df.select("y", "features"), 5.0, 2, 1.0, 1e-6, 10, 200, 1e-5)
    assert machine.report.landmarks == 10 and machine.report.error > 1e-6
    with pytest.warns(RuntimeWarning, match="not fitted within"):
        machine = K.fit_pairs(df.select("y", "features"), 0.5, 2, 1.0, 0.1, 200, 1, 1e-9)
    assert not machine.report.converged


def test_copies_nulls_and_one_class(spark):
    rows = [(i, i % 3, 1, [1.0, 2.0]) for i in range(30)] + [(40, 0, 1, None), (41, 1, None, [1.0, 2.0])]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = {r["cell_id"]: r["y_pred"] for r in B.rbf_svm(frame(spark, rows)).collect()}
    assert got[40] is None and {v for k, v in got.items() if k != 40} == {1} and len(got) == 32
