"""Gaussian mixed model with nested random intercepts, fitted from group sums.

For nested groups the inverse of the response covariance acts on group sums only.
What leaves the rows is therefore, for each innermost group, its size n and the
sum of its design-and-response rows, plus one cross-product of all rows. A trial
set of variance ratios is then evaluated level by level: the inner sums are
weighted and subtracted, summed into the next level, and so on. Each trial gives
the generalised least-squares cross-product matrix and the log determinant of the
covariance exactly; many trials, and all submodels of a design, share one job.

All sums are taken about the columns' means. A design with an intercept gives the same
fit in these coordinates, and offsets far larger than the spread cost no digits; only the
coefficients are moved back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.operators.design import Design
from sward.session import pin

_SUM = "__row"


@dataclass
class GroupSums:
    """Sufficient statistics of one model frame for a design and its submodels."""

    design: Design
    response: str
    groups: list[str]
    rows: int
    shift: np.ndarray
    centred: np.ndarray
    inner: DataFrame
    cells: DataFrame
    inner_gram: DataFrame
    counts: list[int]
    strata: dict[str, int]

    @property
    def width(self) -> int:
        return len(self.design.effects) + 1

    @property
    def gram(self) -> np.ndarray:
        """Cross-products of the design and the response as they are."""
        return self.moved_back(self.centred)

    def moved_back(self, matrix: np.ndarray) -> np.ndarray:
        """A cross-product matrix about the means, in the columns' own coordinates."""
        shift = np.eye(self.width)
        if np.any(self.shift):
            shift[_intercept(self.design)] += self.shift
        return shift.T @ matrix @ shift

    def solve(
        self, matrix: np.ndarray, logdet: float, columns: Sequence[int], method: str
    ) -> Solution:
        """``solve`` for a matrix about the means, with coefficients of the columns as they are."""
        if not np.any(self.shift):
            return solve(matrix, logdet, columns, self.rows, method)
        at = _intercept(self.design)
        if at not in columns:
            return solve(self.moved_back(matrix), logdet, columns, self.rows, method)
        found = solve(matrix, logdet, columns, self.rows, method)
        back = np.eye(len(columns))
        place = list(columns).index(at)
        back[place] -= self.shift[list(columns)]
        beta = back @ found.beta
        beta[place] += self.shift[-1]
        return Solution(beta, back @ found.inverse @ back.T, found.sigma2, found.loglik)

    def about_means(self, beta: np.ndarray, columns: Sequence[int]) -> np.ndarray:
        """Coefficients that fit the response about its mean from the columns about theirs."""
        out = np.array(beta, dtype=float)
        if np.any(self.shift):
            place = list(columns).index(_intercept(self.design))
            out[place] += float(self.shift[list(columns)] @ out) - self.shift[-1]
        return out


def _intercept(design: Design) -> int | None:
    """Position of the column of ones."""
    return next((i for i, effect in enumerate(design.effects) if not effect.term), None)


def _z(width: int) -> list[str]:
    return [f"z{i}" for i in range(width)]


def _matrix_rows(matrix: np.ndarray, **fixed) -> pd.DataFrame:
    """A matrix as one record per row, numbered from 0."""
    width = matrix.shape[1]
    frame = pd.DataFrame(matrix, columns=_z(width))
    frame.insert(0, _SUM, np.arange(len(matrix), dtype=np.int32))
    for name, value in reversed(list(fixed.items())):
        frame.insert(0, name, value)
    return frame


def _row_gram(design: Design, response: str, shift: np.ndarray) -> Callable:
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            z = np.column_stack([design.matrix(batch), batch[response].to_numpy(dtype=float)])
            z -= shift
            part = z.T @ z
            total = part if total is None else total + part
        if total is not None:
            yield _matrix_rows(total)

    return products


def _size_gram(width: int) -> Callable:
    """Cross-products of the groups' sums by group size; rows arrive sorted by size."""
    names = _z(width)

    def summed(n: int, total: np.ndarray, count: int) -> pd.DataFrame:
        frame = _matrix_rows(total, n=np.int64(n))
        # the group count travels with the first matrix row
        frame["m"] = [count] + [0] * (width - 1)
        return frame

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, total, count = None, np.zeros((width, width)), 0
        for batch in batches:
            for n, part in batch.groupby("n", sort=False):
                if size is not None and n != size:
                    yield summed(size, total, count)
                    total, count = np.zeros((width, width)), 0
                s = part[names].to_numpy()
                size, total, count = n, total + s.T @ s, count + len(part)
        if size is not None:
            yield summed(size, total, count)

    return products


def _doubles(names: Sequence[str]) -> str:
    return ", ".join(f"`{name}` double" for name in names)


def group_sums(
    df: DataFrame,
    response: str,
    design: Design,
    groups: Sequence[str],
) -> GroupSums:
    """Collect the sufficient statistics of a model frame.

    ``groups`` runs from the outermost to the innermost level. Rows with a missing
    value are an error.
    """
    groups = list(groups)
    width = len(design.effects) + 1
    names = _z(width)
    frame = df.select(*groups, *design.variables, response)
    needed = [*groups, *design.variables, response]
    columns = [*design.columns(), F.col(response)]
    # one pass tells the row count, whether anything is missing, and the columns' means
    check = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(needed)],
        *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)],
    ).first()
    missing = [c for i, c in enumerate(needed) if check[f"null_{i}"]]
    if missing:
        raise ValueError(f"missing values in {missing}")
    shift = np.zeros(width)
    at = _intercept(design)
    if at is not None and check["rows"]:
        shift = np.array([check[f"mean_{i}"] for i in range(width)], dtype=float)
        shift[at] = 0.0
    partial = frame.select(*design.variables, response).mapInPandas(
        _row_gram(design, response, shift), f"{_SUM} int, {_doubles(names)}"
    )
    centred = _collect_matrix(partial.groupBy(_SUM).agg(*_sums(names)), names)
    z = [(c - F.lit(float(m))).alias(name) for name, c, m in zip(names, columns, shift)]
    spread = [F.expr(f"min({c}) as lo{i}") for i, c in enumerate(names[:-1])]
    spread += [F.expr(f"max({c}) as hi{i}") for i, c in enumerate(names[:-1])]
    inner = pin(
        frame.select(*groups, *z)
        .groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("n"), *_sums(names), *spread)
    )
    counts = [
        inner.select(*groups[:k]).distinct().count() for k in range(1, len(groups))
    ] + [inner.count()]
    parents = groups[:-1]
    # groups of one size under one parent share their weight, so only their sum matters
    cells = pin(
        inner.groupBy(*parents, "n").agg(F.count(F.lit(1)).alias("m"), *_sums(names))
    )
    inner_gram = pin(
        inner.select("n", *names).sortWithinPartitions("n")
        .mapInPandas(_size_gram(width), f"n long, {_SUM} int, {_doubles(names)}, m long")
        .groupBy("n", _SUM)
        .agg(*_sums([*names, "m"]))
    )
    return GroupSums(
        design, response, groups, check["rows"], shift, centred, inner, cells, inner_gram, counts,
        _column_strata(inner, design, groups),
    )


def _column_strata(inner: DataFrame, design: Design, groups: list[str]) -> dict[str, int]:
    """Innermost level with a group in which the column varies, 0 when there is none.

    Level k counts from 1 at the outermost groups. Levels are tried from the inside,
    each only for the columns that did not vary further in.
    """
    strata = dict.fromkeys(design.names, 0)
    left = list(range(len(design.names)))
    for depth in range(len(groups), 0, -1):
        if not left:
            break
        level = inner
        if depth < len(groups):
            level = inner.groupBy(*groups[:depth]).agg(
                *[F.expr(f"min(lo{i}) as lo{i}") for i in left],
                *[F.expr(f"max(hi{i}) as hi{i}") for i in left],
            )
        row = level.agg(*[F.expr(f"bool_or(lo{i} < hi{i}) as v{i}") for i in left]).first()
        for i in left:
            if row[f"v{i}"]:
                strata[design.names[i]] = depth
        left = [i for i in left if not row[f"v{i}"]]
    return strata


def _sums(names: Sequence[str]) -> list[Column]:
    return [F.expr(f"sum({name}) as {name}") for name in names]


def _collect_matrix(rows: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Matrix rows to the driver; the size is fixed by the design."""
    frame = rows.toPandas().sort_values(_SUM)
    return frame[list(names)].to_numpy()


# ---- evaluation of trial variance ratios -------------------------------------------------


def _stack(blocks: Sequence[np.ndarray], logdets: Sequence[float], names: list[str]) -> pd.DataFrame:
    """One matrix per trial as numbered rows; its log determinant is with the first row."""
    width = len(names)
    frame = pd.DataFrame(np.vstack(blocks), columns=names)
    frame["trial"] = np.repeat(np.arange(len(blocks), dtype=np.int32), width)
    frame[_SUM] = np.tile(np.arange(width, dtype=np.int32), len(blocks))
    w = np.zeros(len(frame))
    w[::width] = logdets
    frame["w"] = w
    return frame


def _inner_step(ratios: np.ndarray, width: int) -> Callable:
    """Subtraction of the innermost level, from cross-products by group size."""
    names = _z(width)
    order = ["trial", _SUM, *names, "w"]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["n"].to_numpy(dtype=float)
            m = batch["m"].to_numpy(dtype=float)
            rows = batch[names].to_numpy()
            index = batch[_SUM].to_numpy()
            blocks, logdets = [], []
            for inner in ratios[:, -1]:
                total = np.zeros((width, width))
                np.add.at(total, index, rows * (inner / (1.0 + n * inner))[:, None])
                blocks.append(total)
                logdets.append(float((m * np.log1p(n * inner)).sum()))
            yield _stack(blocks, logdets, names)[order]

    return step


def _starts(batch: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Positions at which a new key begins in sorted rows."""
    change = np.zeros(len(batch), dtype=bool)
    change[:1] = True
    for key in keys:
        column = batch[key]
        differs = (column != column.shift()) & ~(column.isna() & column.shift().isna())
        change |= differs.to_numpy()
    return np.flatnonzero(change)


def _fold(
    t: np.ndarray, w: np.ndarray, ratio: float
) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """One grouping level: subtraction, log determinant, and the scaled sums."""
    scale = 1.0 / (1.0 + ratio * w)
    weighted = t * (ratio * scale)[:, None]
    return weighted.T @ t, -float(np.log(scale).sum()), t * scale[:, None], w * scale


def _open(heads: pd.DataFrame, trials: Sequence[int], s: Sequence, w: Sequence, names: list[str]):
    """Sums handed to the next level: one row per group and trial, numbered -1."""
    up = pd.concat([heads] * len(trials), ignore_index=True)
    sums = pd.DataFrame(np.vstack(s), columns=names)
    sums["trial"] = np.repeat(np.asarray(trials, dtype=np.int32), len(heads))
    sums[_SUM] = np.int32(-1)
    sums["w"] = np.concatenate(w)
    return pd.concat([up, sums], axis=1)


def _cell_step(ratios: np.ndarray, width: int, keys: list[str], parents: list[str]) -> Callable:
    """Fold the cells of each innermost parent; rows arrive sorted by parent."""
    names = _z(width)
    level = len(keys) - 1
    order = ["trial", *parents, _SUM, *names, "w"]

    def fold(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts = _starts(batch, keys)
        heads = batch[keys].iloc[starts].reset_index(drop=True)
        n = batch["n"].to_numpy(dtype=float)
        m = batch["m"].to_numpy(dtype=float)
        sums = batch[names].to_numpy()
        upper = _starts(heads, parents) if parents else None
        blocks, logdets, tops, weights = [], [], [], []
        for ratio in ratios:
            damp = 1.0 / (1.0 + n * ratio[-1])
            t = np.add.reduceat(sums * damp[:, None], starts)
            w = np.add.reduceat(m * n * damp, starts)
            matrix, logdet, s, v = _fold(t, w, ratio[level])
            blocks.append(matrix)
            logdets.append(logdet)
            if parents:
                tops.append(np.add.reduceat(s, upper))
                weights.append(np.add.reduceat(v, upper))
        out = _stack(blocks, logdets, names)
        for key in parents:
            out[key] = None
        yield out[order]
        if parents:
            above = heads[parents].iloc[upper].reset_index(drop=True)
            yield _open(above, range(len(ratios)), tops, weights, names)[order]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None
        for batch in batches:
            if carried is not None:
                batch = pd.concat([carried, batch], ignore_index=True)
            last = int(_starts(batch, keys)[-1]) if len(batch) else 0
            carried = batch.iloc[last:]
            if last:
                yield from fold(batch.iloc[:last].reset_index(drop=True))
        if carried is not None and len(carried):
            yield from fold(carried.reset_index(drop=True))

    return step


def _level_step(ratios: np.ndarray, width: int, level: int, parents: list[str]) -> Callable:
    """Fold summed groups of one outer level; matrix rows pass through."""
    names = _z(width)
    order = ["trial", *parents, _SUM, *names, "w"]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            closed = batch[batch[_SUM] >= 0].copy()
            for key in parents:
                closed[key] = None
            yield closed[order]
            pending = batch[batch[_SUM] < 0]
            if not len(pending):
                continue
            blocks = [np.zeros((width, width)) for _ in ratios]
            logdets = [0.0] * len(ratios)
            for trial, part in pending.groupby("trial"):
                t, w = part[names].to_numpy(), part["w"].to_numpy()
                trial = int(trial)
                blocks[trial], logdets[trial], s, v = _fold(t, w, ratios[trial][level])
                if parents:
                    heads = part[parents].reset_index(drop=True)
                    yield _open(heads, [trial], [s], [v], names)[order]
            out = _stack(blocks, logdets, names)
            for key in parents:
                out[key] = None
            yield out[order]

    return step


class Evaluator:
    """Evaluates trial variance ratios on the cells, which are laid out once."""

    def __init__(self, sums: GroupSums):
        self.sums = sums
        self.names = _z(sums.width)
        keys = sums.groups[:-1]
        self.totals = _sums([*self.names, "w"])
        self.types = {f.name: f.dataType.simpleString() for f in sums.cells.schema.fields}
        self.cells = None
        if keys:
            self.cells = (
                sums.cells.repartition(*keys).sortWithinPartitions(*keys).persist()
            )

    def close(self) -> None:
        if self.cells is not None:
            self.cells.unpersist()

    def _schema(self, keys: Sequence[str]) -> str:
        typed = ", ".join(f"`{k}` {self.types[k]}" for k in keys)
        return f"trial int, {typed + ', ' if keys else ''}{_SUM} int, {_doubles(self.names)}, w double"

    def _summed(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.groupBy("trial", *keys, _SUM).agg(*self.totals)

    def evaluate(self, ratios: np.ndarray) -> list[tuple[np.ndarray, float]]:
        """(cross-product matrix under the trial covariance, its log determinant)."""
        return [(self.sums.moved_back(m), logdet) for m, logdet in self.evaluate_centred(ratios)]

    def evaluate_centred(self, ratios: np.ndarray) -> list[tuple[np.ndarray, float]]:
        """As ``evaluate``, for the columns about their means."""
        sums, width = self.sums, self.sums.width
        rows = None
        if self.cells is not None:
            keys = sums.groups[:-1]
            parents = keys[:-1]
            rows = self.cells.mapInPandas(
                _cell_step(ratios, width, keys, parents), self._schema(parents)
            )
            while parents:
                summed = self._summed(rows, parents)
                level, parents = len(parents) - 1, parents[:-1]
                rows = summed.mapInPandas(
                    _level_step(ratios, width, level, parents), self._schema(parents)
                )
        inner = sums.inner_gram.mapInPandas(_inner_step(ratios, width), self._schema([]))
        rows = inner if rows is None else rows.unionByName(inner)
        collected = self._summed(rows, []).toPandas()
        results = []
        for trial in range(len(ratios)):
            part = collected[collected["trial"] == trial].sort_values(_SUM)
            removed = part[self.names].to_numpy()
            matrix = sums.centred - (removed + removed.T) / 2.0
            results.append((matrix, float(part["w"].sum())))
        return results


# ---- criterion and fit -------------------------------------------------------------------


@dataclass(frozen=True)
class Solution:
    beta: np.ndarray
    inverse: np.ndarray
    sigma2: float
    loglik: float


def solve(
    matrix: np.ndarray, logdet: float, columns: Sequence[int], rows: int, method: str
) -> Solution:
    """Fixed effects, residual variance and log likelihood for one submodel."""
    index = np.asarray(columns)
    a, b, c = matrix[np.ix_(index, index)], matrix[index, -1], matrix[-1, -1]
    scale = np.sqrt(np.diag(a))
    if not np.all(scale > 0):
        raise ValueError("a design column is zero everywhere")
    scaled = a / np.outer(scale, scale)
    try:
        factor = np.linalg.cholesky(scaled)
    except np.linalg.LinAlgError as error:
        raise ValueError("the design columns are linearly dependent") from error
    root = np.linalg.inv(factor)
    inverse = (root.T @ root) / np.outer(scale, scale)
    beta = inverse @ b
    residual = float(c - 2.0 * beta @ b + beta @ a @ beta)
    p = len(index)
    logdet_a = 2.0 * float(np.log(np.diag(factor)).sum() + np.log(scale).sum())
    if method == "REML":
        sigma2 = residual / (rows - p)
        twice = (rows - p) * (math.log(2.0 * math.pi * sigma2) + 1.0) + logdet + logdet_a
    else:
        sigma2 = residual / rows
        twice = rows * (math.log(2.0 * math.pi * sigma2) + 1.0) + logdet
    return Solution(beta, inverse, sigma2, -twice / 2.0)


@dataclass
class MixedModel:
    """A fitted model; random effects and fitted values stay DataFrames."""

    design: Design
    groups: list[str]
    method: str
    rows: int
    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    ratios: np.ndarray
    loglik: float
    df: np.ndarray
    sums: GroupSums

    @property
    def variances(self) -> dict[str, float]:
        """Variance of each random level and of the residual."""
        named = dict(zip(self.groups, self.ratios * self.sigma2))
        return named | {"Residual": self.sigma2}

    def aic(self) -> float:
        """-2 log likelihood + 2 (fixed effects + variance ratios + 1)."""
        return -2.0 * self.loglik + 2.0 * (len(self.beta) + len(self.groups) + 1)


@dataclass
class _Search:
    """Trust-region search of one model over the relative standard deviations.

    The criterion is an even, smooth function of them, so a variance of zero is an
    ordinary minimum at zero and needs no bound.
    """

    columns: list[int]
    center: np.ndarray
    radius: float = 0.3
    done: bool = False
    best: float = math.inf
    best_point: np.ndarray | None = None

    def trials(self) -> np.ndarray:
        """The center, its neighbours along each axis, and the corners around it."""
        size = len(self.center)
        offsets = [np.zeros(size)]
        offsets += [sign * row for row in np.eye(size) for sign in (-1.0, 1.0)]
        if size > 1:
            offsets += [np.array(corner) for corner in product((-1.0, 1.0), repeat=size)]
        return self.center + self.radius * np.array(offsets)

    def update(self, points: np.ndarray, values: np.ndarray, tolerance: float) -> None:
        """Move to the minimum of a quadratic through the trial values.

        A move that turns out worse than the best point so far is taken back.
        """
        low = int(np.argmin(values))
        failed = values[0] > self.best + tolerance
        if values[low] < self.best:
            self.best, self.best_point = float(values[low]), np.abs(points[low])
        if failed:
            self.center, self.radius = self.best_point, self.radius * 0.4
            self.done = self.radius < 1e-4
            return
        size = len(self.center)
        offsets = (points - self.center) / self.radius
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        terms = np.column_stack(
            [np.ones(len(points)), offsets] + [offsets[:, i] * offsets[:, j] for i, j in pairs]
        )
        weights, *_ = np.linalg.lstsq(terms, values - values[0], rcond=None)
        gradient = weights[1 : size + 1]
        hessian = np.zeros((size, size))
        for weight, (i, j) in zip(weights[size + 1 :], pairs):
            hessian[i, j] += weight
            hessian[j, i] += weight
        curvature, axes = np.linalg.eigh(hessian)
        along = axes.T @ gradient
        floor = 1e-4 * max(float(np.abs(curvature).max()), 1e-12)
        step = axes @ np.array(
            [-g / k if k > floor else -math.copysign(3.0, g) if abs(g) > tolerance else 0.0
             for g, k in zip(along, curvature)]
        )
        inside = bool(np.all(np.abs(step) <= 1.0))
        moved = self.center + self.radius * np.clip(step, -3.0, 3.0)
        # zero is the axis of symmetry: a step across it stops there
        self.center = np.where(moved * np.where(self.center < 0, -1.0, 1.0) < 0.0, 0.0, np.abs(moved))
        if float(np.ptp(values)) < tolerance or (inside and self.radius < 5e-3):
            self.done = True
        elif inside:
            self.radius *= 0.15
        elif np.abs(step).max() > 2.0:
            self.radius *= 2.0


def fit_designs(
    sums: GroupSums,
    designs: Sequence[Design],
    method: str = "REML",
    max_rounds: int = 60,
    tolerance: float = 1e-6,
) -> list[MixedModel]:
    """Fit submodels of the collected design together; a round of trials is one job.

    Raises when a search has not converged after ``max_rounds``.
    """
    position = {name: i for i, name in enumerate(sums.design.names)}
    searches = [
        _Search([position[name] for name in design.names], np.full(len(sums.groups), 0.6))
        for design in designs
    ]
    evaluator = Evaluator(sums)
    try:
        for _ in range(max_rounds):
            active = [s for s in searches if not s.done]
            if not active:
                break
            blocks = [s.trials() for s in active]
            points, back = np.unique(np.abs(np.vstack(blocks)), axis=0, return_inverse=True)
            back = np.asarray(back).ravel()
            found = evaluator.evaluate_centred(np.square(points))
            at = 0
            for search, block in zip(active, blocks):
                where = back[at : at + len(block)]
                at += len(block)
                values = np.array(
                    [-2.0 * sums.solve(*found[i], search.columns, method).loglik
                     for i in where]
                )
                search.update(block, values, tolerance)
        if not all(s.done for s in searches):
            raise RuntimeError(f"the variance search did not converge in {max_rounds} rounds")
        final = np.square(np.array([s.center for s in searches]))
        found = evaluator.evaluate_centred(final)
    finally:
        evaluator.close()
    return [
        _model(sums, design, ratios, matrix, logdet, method)
        for design, ratios, (matrix, logdet) in zip(designs, final, found)
    ]


def estimable(sums: GroupSums, design: Design | None = None) -> Design:
    """The design without columns that are sums of multiples of those before them.

    Such a column, for example a predictor with one value in all rows, adds nothing to the model and
    has no coefficient of its own. The columns kept span the design, so likelihood and fitted values
    are those of the whole.
    """
    design = design or sums.design
    position = {name: i for i, name in enumerate(sums.design.names)}
    index = [position[name] for name in design.names]
    at = _intercept(design)
    if at is None:
        kept = set(first_independent(sums.gram[np.ix_(index, index)]))
    else:
        # beside an intercept, a column counts by its spread; whether it has any is told exactly
        varies = sums.inner.agg(*[F.expr(f"min(lo{i}) < max(hi{i}) as v{i}") for i in index]).first()
        free = [k for k, i in enumerate(index) if k != at and varies[f"v{i}"]]
        part = [index[k] for k in free]
        kept = {at, *(free[k] for k in first_independent(sums.centred[np.ix_(part, part)]))}
    return Design(tuple(e for k, e in enumerate(design.effects) if k in kept), design.factors)


def first_independent(gram: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Positions of columns that do not depend on earlier ones, from their cross-products.

    Cholesky in the given order: a column is passed over when what earlier ones leave of it, as a
    share of its own square sum, is below ``tolerance``.
    """
    scale = np.sqrt(np.diag(gram))
    scale = np.where(scale > 0.0, scale, 1.0)
    rest = gram / np.outer(scale, scale)
    taken = []
    for i in range(len(gram)):
        if rest[i, i] > tolerance:
            rest = rest - np.outer(rest[:, i], rest[i]) / rest[i, i]
            taken.append(i)
    return taken


def _model(
    sums: GroupSums,
    design: Design,
    ratios: np.ndarray,
    matrix: np.ndarray,
    logdet: float,
    method: str,
) -> MixedModel:
    columns = [sums.design.names.index(name) for name in design.names]
    solution = sums.solve(matrix, logdet, columns, method)
    return MixedModel(
        design, sums.groups, method, sums.rows, solution.beta,
        solution.inverse * solution.sigma2, solution.sigma2, ratios, solution.loglik,
        containment_df(design, sums), sums,
    )


def submodels_at(
    sums: GroupSums, designs: Sequence[Design], ratios: Sequence[float], method: str = "REML"
) -> list[MixedModel]:
    """Models of several designs with given variance ratios, outermost first.

    The designs' columns are among those of ``sums``; one evaluation of the ratios serves them all.
    """
    evaluator = Evaluator(sums)
    trial = np.array([ratios], dtype=float)
    try:
        matrix, logdet = evaluator.evaluate_centred(trial)[0]
    finally:
        evaluator.close()
    return [_model(sums, design, trial[0], matrix, logdet, method) for design in designs]


def model_at(sums: GroupSums, ratios: Sequence[float], method: str = "REML") -> MixedModel:
    """The model with given variance ratios, outermost first, instead of fitted ones."""
    return submodels_at(sums, [sums.design], ratios, method)[0]


def fit_nested_lmm(
    df: DataFrame,
    response: str,
    design: Design,
    groups: Sequence[str],
    method: str = "REML",
) -> MixedModel:
    """Fit a mixed model with a random intercept for each nested group."""
    return fit_designs(group_sums(df, response, design, groups), [design], method)[0]


# ---- degrees of freedom ------------------------------------------------------------------


def _left_over(sums: GroupSums, strata: Sequence[int]) -> list[float]:
    """Degrees of freedom of each level after the columns estimated at it."""
    sizes = [*sums.counts, sums.rows]
    left = [float(now - before) for before, now in zip([0, *sizes[:-1]], sizes)]
    for stratum in strata:
        left[stratum] -= 1.0
    left[0] -= 1.0
    return left


def containment_df(design: Design, sums: GroupSums) -> np.ndarray:
    """Denominator degrees of freedom by the level at which a column is estimated.

    The intercept takes the largest.
    """
    strata = [sums.strata[effect.name] for effect in design.effects if effect.term]
    left = _left_over(sums, strata)
    return np.array(
        [left[sums.strata[e.name]] if e.term else max(left) for e in design.effects]
    )


def term_df(design: Design, sums: GroupSums) -> dict[tuple[str, ...], float]:
    """As ``containment_df`` for whole terms; a term is at its innermost column's level."""
    level: dict[tuple[str, ...], int] = {}
    for effect in design.effects:
        level[effect.term] = max(level.get(effect.term, 0), sums.strata[effect.name])
    left = _left_over(sums, [level[e.term] for e in design.effects if e.term])
    return {term: left[depth] if term else max(left) for term, depth in level.items()}
