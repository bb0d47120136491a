"""Linear models from sufficient statistics: one scan, however many folds, penalties and terms are tried.

Counts, means and centred cross-products of the columns are gathered per cell (a fold and an inner fold). Cells are
combined or left out on the driver, where each is one matrix of the columns' number squared; least squares, penalised paths and
analyses of variance are worked out from these. Rows are read a second time only to score predictions.

Rows with a NULL or NaN in any used column are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .targets import with_fold

FAN = 64  # partial states combined by one task
CHUNK = 4096


@dataclass
class Moments:
    """Count, means and centred cross-products of some columns."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def none(cls, size: int) -> Moments:
        return cls(0.0, np.zeros(size), np.zeros((size, size)))

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(0)
        return cls(float(len(x)), mean, (x - mean).T @ (x - mean))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n),
                       self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.cross.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, size: int) -> Moments:
        flat = np.frombuffer(data)
        return cls(float(flat[0]), flat[1 : 1 + size], flat[1 + size :].reshape(size, size))


def total(cells: Iterable[Moments], size: int) -> Moments:
    out = Moments.none(size)
    for c in cells:
        out = out + c
    return out


def moments(df: DataFrame, columns: Sequence[str | Column], cell: Sequence[str] = ()) -> dict[tuple, Moments]:
    """Moments of the columns for each value of the ``cell`` columns (whole numbers, few values), in one pass.

    A task adds up its own rows; the states, one matrix a task and cell, are combined in two levels.
    """
    size = len(columns)
    values = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    keys = [F.col(k).cast("long").alias(f"_c{i}") for i, k in enumerate(cell)]
    names = [f"_c{i}" for i in range(len(cell))]
    rows = df.select(*keys, *values)
    for i in range(size):
        rows = rows.where(F.col(f"_x{i}").isNotNull() & ~F.isnan(f"_x{i}"))

    def add(batches):
        held: dict[tuple, Moments] = {}
        for pdf in batches:
            x = pdf[[f"_x{i}" for i in range(size)]].to_numpy(float)
            parts = pdf.groupby(names).indices if names else {(): np.arange(len(pdf))}
            for key, at in parts.items():
                key = key if isinstance(key, tuple) else (key,)
                for k in range(0, len(at), CHUNK):
                    held[key] = held.get(key, Moments.none(size)) + Moments.of(x[at[k : k + CHUNK]])
        part = TaskContext.get().partitionId()
        if held:
            yield pd.DataFrame([(*k, part, m.to_bytes()) for k, m in held.items()], columns=[*names, "part", "state"])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        state = total((Moments.from_bytes(s, size) for s in pdf.sort_values("part")["state"]), size)
        first = pdf.iloc[:1].copy()
        first["state"], first["part"] = [state.to_bytes()], [int(pdf["part"].min())]
        return first[[*names, "part", "state"]]

    schema = ", ".join([*[f"{n} long" for n in names], "part long", "state binary"])
    states = rows.mapInPandas(add, schema)
    states = states.withColumn("_to", F.floor(F.col("part") / FAN)).groupBy(*names, "_to").applyInPandas(combine, schema)
    states = states.groupBy(*names).applyInPandas(combine, schema)
    return {tuple(r[n] for n in names): Moments.from_bytes(bytes(r["state"]), size) for r in states.collect()}


# ---- models of one matrix -----------------------------------------------------------------

def least_squares(m: Moments, inputs: Sequence[int], target: int) -> tuple[np.ndarray, float]:
    """Coefficients and intercept; columns that others explain get none."""
    x = list(inputs)
    scale = np.sqrt(np.maximum(np.diag(m.cross)[x], 1e-300))
    gram = m.cross[np.ix_(x, x)] / np.outer(scale, scale)
    beta = np.linalg.lstsq(gram, m.cross[x, target] / scale, rcond=1e-12)[0] / scale
    return beta, float(m.mean[target] - m.mean[x] @ beta)


def squared_error(m: Moments, inputs: Sequence[int], target: int, beta: np.ndarray, intercept: float) -> float:
    """Mean squared error of a linear model on the rows behind ``m``."""
    x = list(inputs)
    centred = m.cross[target, target] - 2 * beta @ m.cross[x, target] + beta @ m.cross[np.ix_(x, x)] @ beta
    return float(centred / m.n + (m.mean[target] - intercept - m.mean[x] @ beta) ** 2)


def penalised(gram: np.ndarray, products: np.ndarray, penalty: float, mix: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent for half the mean squared error plus penalty * (mix * |b| + (1 - mix) / 2 * b^2)."""
    beta = start.copy()
    for _ in range(1000):
        largest = 0.0
        for j in range(len(beta)):
            rest = products[j] - gram[j] @ beta + gram[j, j] * beta[j]
            kept = math.copysign(max(abs(rest) - penalty * mix, 0.0), rest) / (gram[j, j] + penalty * (1 - mix)) if gram[j, j] > 0 else 0.0
            largest = max(largest, abs(kept - beta[j]))
            beta[j] = kept
        if largest <= 1e-12 * max(1.0, float(np.abs(beta).max(initial=0.0))):
            break
    return beta


def elastic_net(cells: dict[int, Moments], inputs: Sequence[int], target: int, penalties: int = 50, mix: float = 0.5,
                least: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """Coefficients, intercept and penalty chosen by the mean error over the inner folds ``cells``; inputs are standardised.

    Penalties fall evenly in their logarithm from the one that leaves no coefficient; of equal errors the largest counts.
    """
    x, size = list(inputs), len(next(iter(cells.values())).mean)
    whole = total(cells.values(), size)
    spread = np.sqrt(np.diag(whole.cross)[x] / whole.n)
    spread = np.where(spread > 0, spread, 1.0)

    def scaled(m: Moments) -> tuple[np.ndarray, np.ndarray]:
        return m.cross[np.ix_(x, x)] / np.outer(spread, spread) / m.n, m.cross[x, target] / spread / m.n

    top = float(np.abs(scaled(whole)[1]).max()) / mix
    grid = [top * least ** (i / (penalties - 1)) for i in range(penalties)]
    errors = np.zeros(penalties)
    for k, held in cells.items():
        rest = total((m for j, m in cells.items() if j != k), size)
        gram, products = scaled(rest)
        beta = np.zeros(len(x))
        for i, penalty in enumerate(grid):
            beta = penalised(gram, products, penalty, mix, beta)
            plain = beta / spread
            errors[i] += squared_error(held, x, target, plain, float(rest.mean[target] - rest.mean[x] @ plain)) / len(cells)
    best = int(np.argmin(errors))
    gram, products = scaled(whole)
    beta = np.zeros(len(x))
    for penalty in grid[: best + 1]:
        beta = penalised(gram, products, penalty, mix, beta)
    beta = beta / spread
    return beta, float(whole.mean[target] - whole.mean[x] @ beta), grid[best]


LEARNERS = ("Mean", "Linear", "ElasticNet")


def fit(train: DataFrame, columns: Sequence[str], keys: Sequence[str], y: str = "y", inner: int = 5,
        seed=123456) -> dict[str, tuple[np.ndarray, float]]:
    """Coefficients and intercept of each linear learner from one scan; inner folds are hashes of the key."""
    cells = moments(with_fold(train, keys, inner, f"{seed}-inner", "_inner"), [*columns, y], ["_inner"])
    size, inputs, target = len(columns) + 1, range(len(columns)), len(columns)
    whole = total(cells.values(), size)
    if not whole.n:
        return {}
    beta, intercept, _ = elastic_net({j: m for (j,), m in cells.items()}, inputs, target)
    return {"Mean": (np.zeros(len(columns)), float(whole.mean[target])), "Linear": least_squares(whole, inputs, target),
            "ElasticNet": (beta, intercept)}


def predicted(columns: Sequence[str], beta: Sequence[float], intercept: float) -> Column:
    return F.lit(float(intercept)) + sum((F.col(c).cast("double") * float(b) for c, b in zip(columns, beta, strict=True)), F.lit(0.0))


def fold_models(df: DataFrame, columns: Sequence[str], keys: Sequence[str], y: str = "y", folds: int = 10, inner: int = 5,
                learners: Sequence[str] = LEARNERS, seed=123456) -> list[dict]:
    """A fitted model for each fold left out and each learner: fold, learner, beta, intercept, penalty."""
    tagged = with_fold(with_fold(df, keys, folds, seed), keys, inner, f"{seed}-inner", "_inner")
    cells = moments(tagged, [*columns, y], ["fold", "_inner"])
    size, inputs, target = len(columns) + 1, range(len(columns)), len(columns)
    out = []
    for k in sorted({f for f, _ in cells}):
        rest = {j: total((m for (f, i), m in cells.items() if f != k and i == j), size) for j in range(inner)}
        rest = {j: m for j, m in rest.items() if m.n}
        whole = total(rest.values(), size)
        if not whole.n:
            continue
        for name in learners:
            beta, penalty = np.zeros(len(columns)), None
            intercept = float(whole.mean[target])
            if name == "Linear":
                beta, intercept = least_squares(whole, inputs, target)
            elif name == "ElasticNet":
                beta, intercept, penalty = elastic_net(rest, inputs, target)
            out.append({"fold": int(k), "learner": name, "beta": [float(b) for b in beta], "intercept": float(intercept), "penalty": penalty})
    return out


_MODEL = "fold int, learner string, beta array<double>, intercept double, penalty double"


def cross_validate(df: DataFrame, columns: Sequence[str], keys: Sequence[str], y: str = "y", folds: int = 10, inner: int = 5,
                   learners: Sequence[str] = LEARNERS, seed=123456) -> tuple[DataFrame, DataFrame]:
    """Mean and spread over folds of each learner's scores (MSE, MAE, EV; test and train), and the out-of-fold predictions.

    Two scans in all: one for the statistics, one that scores every row by all models at once.
    """
    models = fold_models(df, columns, keys, y, folds, inner, learners, seed)
    spark = df.sparkSession
    fitted = F.broadcast(spark.createDataFrame([tuple(m.values()) for m in models], _MODEL))  # folds x learners rows
    usable = with_fold(df, keys, folds, seed)
    for c in (*columns, y):
        usable = usable.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    rows = usable.select(*keys, F.col("fold").alias("_own"), F.col(y).cast("double").alias("y_true"), *[
        F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    # every model scores every row: the models are few and broadcast, so their table is attached as one array
    table = fitted.agg(F.collect_list(F.struct("fold", "learner", "beta", "intercept")).alias("_m"))
    each = rows.withColumn("_m", F.explode(table.scalar())).select(
        *keys, "y_true", F.col("_m.learner").alias("learner"), F.col("_m.fold").alias("fold"),
        F.when(F.col("_m.fold") == F.col("_own"), "test").otherwise("train").alias("part"),
        sum((F.col(f"_x{i}") * F.get("_m.beta", F.lit(i)) for i in range(len(columns))), F.col("_m.intercept")).alias("preds"))
    gap = F.col("y_true") - F.col("preds")
    scores = each.groupBy("learner", "part", "fold").agg(
        F.avg(gap * gap).alias("MSE"), F.avg(F.abs(gap)).alias("MAE"),
        (1 - F.try_divide(F.var_pop(gap), F.var_pop("y_true"))).alias("EV"))
    long = scores.unpivot(["learner", "part", "fold"], ["MSE", "MAE", "EV"], "metric", "value")
    summary = long.groupBy("learner", "part", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return summary, each.where("part = 'test'").select(*keys, "y_true", "preds", "learner")


# ---- analysis of variance -----------------------------------------------------------------

def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, out = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny), 1.0
    out = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def f_tail(f: float, between: float, left: float) -> float:
    """Chance of an F value above ``f``."""
    return incomplete_beta(left / (left + between * f), left / 2, between / 2) if f > 0 else 1.0


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """The matrix with row and column ``k`` swept: as if the target had been regressed on that column too."""
    pivot = a[k, k]
    out = a - np.outer(a[:, k], a[k, :]) / pivot
    out[k, :], out[:, k] = a[k, :] / pivot, a[:, k] / pivot
    out[k, k] = -1 / pivot
    return out


def interaction_anova(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Type 2 table of the full interaction model: term, sum_sq, df, f, pval; a last row for the residuals.

    A term is tested by what it adds to the model of all terms that do not contain it. One scan gathers the cross-products
    of all terms; the models are swept out of that matrix. A term that others explain adds nothing and has df 0.
    """
    terms = [frozenset(c) for r in range(1, len(factors) + 1) for c in combinations(factors, r)]
    products = []
    for t in terms:
        value = F.lit(1.0)
        for c in sorted(t):
            value = value * F.col(c).cast("double")
        products.append(value)
    m = moments(df, [*products, y]).get((), Moments.none(len(terms) + 1))
    scale = np.sqrt(np.maximum(np.diag(m.cross), 1e-300))
    base = m.cross / np.outer(scale, scale)
    size = float(scale[-1]) ** 2

    def residual(chosen: Iterable[frozenset]) -> tuple[float, int]:
        a, used = base, 0
        for i, t in enumerate(terms):
            if t in chosen and a[i, i] > 1e-10:
                a, used = sweep(a, i), used + 1
        return float(a[-1, -1]) * size, used

    full, used = residual(set(terms))
    left = int(m.n) - used - 1
    out = []
    for t in terms:
        others = {u for u in terms if not t <= u}
        (without, few), (with_it, more) = residual(others), residual(others | {t})
        degrees, gain = more - few, without - with_it
        f = gain / degrees / (full / left) if degrees and left > 0 and full > 0 else None
        out.append((":".join(sorted(t)), gain, degrees, f, None if f is None else f_tail(f, degrees, left)))
    out.append(("Residual", full, left, None, None))
    return df.sparkSession.createDataFrame(out, "term string, sum_sq double, df int, f double, pval double")
