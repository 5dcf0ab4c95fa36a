"""A radial basis kernel as features of bounded error, and one-against-one linear machines on them.

Landmarks are rows of the table. With W their kernel matrix, W = L L', the features of a row x are
L^-1 k(landmarks, x); products of features are the kernel up to sqrt(r(x) r(y)), where the residual
r(x) = k(x, x) - |features(x)|^2 is what the landmarks don't explain of x. So the largest residual of all
rows bounds the error of every kernel value. While it exceeds the wanted error, the rows of the largest
residuals become candidates, and those that explain each other least become landmarks: each round takes
one pass over the rows, of which only a bounded number of candidates comes to the driver.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalweave.operators.blocks import as_lists, as_matrix

FIRST = 64  # landmarks to begin with; later rounds may double them
JITTER = 1e-10  # least residual of a landmark, which keeps the factor invertible


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * x @ y.T
    return np.exp(-gamma * np.maximum(square, 0.0))


@dataclass
class Nystroem:
    """Landmarks, and the inverse of the Cholesky factor of their kernel."""

    gamma: float
    landmarks: np.ndarray
    factor: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    error: float = 1.0

    def features(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.landmarks, self.gamma) @ self.factor.T

    def residual(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x)
        return np.maximum(1.0 - (z * z).sum(axis=1), 0.0)

    def extended(self, candidates: np.ndarray, most: int, enough: float) -> Nystroem:
        """With the candidates that are left unexplained, the least explained first: a pivoted Cholesky factor of theirs."""
        z = self.features(candidates)
        own = rbf(candidates, candidates, self.gamma) - z @ z.T
        left, rows, taken = own.diagonal().copy(), np.zeros((0, len(candidates))), []
        while len(taken) < min(most, len(candidates)):
            at = int(left.argmax())
            if left[at] <= max(enough, JITTER):
                break
            row = (own[at] - rows[:, at] @ rows) / np.sqrt(left[at])
            rows, left = np.vstack([rows, row]), np.maximum(left - row * row, 0.0)
            left[at] = 0.0
            taken.append(at)
        landmarks = np.vstack([self.landmarks, candidates[taken]])
        m, add = len(self.landmarks), len(taken)
        lower = np.zeros((m + add, m + add))
        if m:
            lower[:m, :m] = np.linalg.inv(self.factor)
        lower[m:, :m], lower[m:, m:] = z[taken], rows[:, taken].T
        return Nystroem(self.gamma, landmarks, np.linalg.inv(lower))


def worst(rows: DataFrame, model: Nystroem, n: int) -> tuple[float, np.ndarray]:
    """The largest residual, and the rows of the n largest (each vector once)."""
    width = model.landmarks.shape[1]

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            yield pa.RecordBatch.from_arrays([v, pa.array(model.residual(as_matrix(v, width)))], ["v", "r"])

    found = rows.mapInArrow(run, "v array<double>, r double").orderBy(F.desc("r"), "v").limit(n).collect()
    vectors = dict.fromkeys(tuple(r["v"]) for r in found)
    return max((r["r"] for r in found), default=0.0), np.array(list(vectors), np.float64).reshape(-1, width)


def fit_nystroem(rows: DataFrame, gamma: float, width: int, error: float, max_landmarks: int) -> Nystroem:
    """Landmarks until every kernel value of the rows (``features``) is within ``error``, or ``max_landmarks``.

    ``error`` of the result is the largest residual of all rows: the bound that was reached.
    """
    rows = rows.select(F.col("features").alias("v")).where("v IS NOT NULL")
    model = Nystroem(gamma, np.zeros((0, width)))
    first = rows.orderBy(F.xxhash64("v"), "v").limit(min(FIRST, max_landmarks)).collect()
    candidates = np.array([r["v"] for r in first], np.float64).reshape(-1, width)
    while True:
        model = model.extended(candidates, max_landmarks - len(model.landmarks), error)
        model.error, candidates = worst(rows, model, max(FIRST, 2 * len(model.landmarks)))
        if model.error <= error or len(model.landmarks) >= max_landmarks:
            return model


def with_features(rows: DataFrame, model: Nystroem) -> DataFrame:
    """``features`` replaced by those of the model; a NULL vector stays NULL."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = rows.columns
    at, width = names.index("features"), model.landmarks.shape[1]

    def run(batches):
        for batch in batches:
            column = batch.column("features")
            z = as_lists(sent.value.features(as_matrix(column, width)))
            if column.null_count:
                z = pa.array([v if k else None for v, k in zip(z.to_pylist(), column.is_valid().to_pylist(), strict=True)], z.type)
            yield pa.RecordBatch.from_arrays([z if i == at else c for i, c in enumerate(batch.columns)], names)

    return rows.mapInArrow(run, rows.schema)


@dataclass
class Report:
    """What a fit reached: landmarks, bound of the kernel's error, steps of each pair of classes, and whether all ended."""

    landmarks: int
    error: float
    steps: dict[tuple[int, int], int]
    converged: bool


@dataclass
class PairwiseMachine:
    """For each pair of classes a < b a hyperplane; above it lies a."""

    classes: list[int]
    kernel: Nystroem
    planes: dict[tuple[int, int], tuple[np.ndarray, float]]
    report: Report

    def votes(self, x: np.ndarray) -> np.ndarray:
        z = self.kernel.features(x)
        out = np.zeros((len(x), len(self.classes)))
        place = {c: i for i, c in enumerate(self.classes)}
        for (a, b), (w, b0) in self.planes.items():
            above = z @ w + b0 > 0
            out[above, place[a]] += 1
            out[~above, place[b]] += 1
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Most votes; a tie goes to the smaller class."""
        return np.array(self.classes)[self.votes(x).argmax(axis=1)]


def fit_pairs(
    rows: DataFrame, gamma: float, width: int, c: float, error: float, max_landmarks: int, max_iter: int, tol: float
) -> PairwiseMachine:
    """``rows``: y, features. A hinge loss of weight ``c`` and a free offset for each pair of classes."""
    kernel = fit_nystroem(rows, gamma, width, error, max_landmarks)
    counts = {int(r["y"]): r["count"] for r in rows.where("y IS NOT NULL").groupBy("y").count().collect()}
    classes = sorted(counts)
    mapped = with_features(rows.select("y", "features"), kernel)
    mapped = mapped.select(F.col("y").cast("int").alias("y"), array_to_vector("features").alias("features")).persist()
    planes, steps, ended = {}, {}, True
    for a, b in combinations(classes, 2):
        two = mapped.where(F.col("y").isin(a, b)).select((F.col("y") == a).cast("double").alias("label"), "features")
        # The objective is the mean loss plus reg / 2 |w|^2, so reg = 1 / (c n) gives every row the weight c.
        reg = 1.0 / (c * (counts[a] + counts[b]))
        svc = LinearSVC(regParam=reg, maxIter=max_iter, tol=tol, standardization=False)
        model = svc.fit(two)
        planes[a, b] = model.coefficients.toArray(), float(model.intercept)
        steps[a, b] = int(model.summary().totalIterations)
        ended &= steps[a, b] < max_iter
    mapped.unpersist()
    if not ended:
        warnings.warn(f"a pair of classes was not fitted within {max_iter} steps", RuntimeWarning, stacklevel=2)
    if kernel.error > error:
        text = f"{max_landmarks} landmarks leave an error of up to {kernel.error:.3g} in the kernel (wanted {error:.3g})"
        warnings.warn(text, RuntimeWarning, stacklevel=2)
    return PairwiseMachine(classes, kernel, planes, Report(len(kernel.landmarks), kernel.error, steps, ended))


def predict(rows: DataFrame, machine: PairwiseMachine) -> DataFrame:
    """``rows`` (with ``features``) beside ``prediction``; a row without a vector has none."""
    sent = rows.sparkSession.sparkContext.broadcast(machine)
    names, width = [*rows.columns, "prediction"], machine.kernel.landmarks.shape[1]

    def run(batches):
        for batch in batches:
            column = batch.column("features")
            if machine.classes:
                found = sent.value.predict(as_matrix(column, width)).astype(np.int32)
                told = pa.array(found, pa.int32(), mask=~np.asarray(column.is_valid()))
            else:
                told = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, told], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", prediction int"
    return rows.mapInArrow(run, schema)
