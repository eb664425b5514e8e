"""Models of one whole series, or pair of series, in order: unit roots, cointegration, breaks.

Each is a fit over the ordered rows of a key in one Arrow group. A group is one series, a row a day, so a
task holds days, not a table; keys are spread over tasks.

Defined results: rows with a null in a column that is read are left out; too few rows,
or rows that do not determine a fit, give null; rows that tie in `order` are taken in any order; repeated rows count each; an empty
table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Published response surfaces of critical values at 1, 5 and 10 %, fixed values: c0 + c1 / n + c2 / n^2 + c3 / n^3 for one series, and for the residual of two.
UNIT_ROOT = ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0.0))
COINTEGRATED = ((-3.89644, -10.9519, -22.527, 0.0), (-3.33613, -6.1101, -6.823, 0.0), (-3.04445, -4.2412, -2.72, 0.0))
#: Critical values of the stationarity test at 1, 5 and 10 %, and at 5 % of the trace and the largest root of two series, by the rank supposed; fixed values.
STATIONARY = (0.739, 0.463, 0.347)
TRACE, LARGEST = (15.4943, 3.8415), (14.2639, 3.8415)
#: Critical values at 10, 5 and 1 % of the trace and the largest root, by the series less the rank supposed, from one on; fixed values.
TRACES = ((2.7055, 3.8415, 6.6349), (13.4294, 15.4943, 19.9349), (27.0669, 29.7961, 35.4628), (44.4929, 47.8545, 54.6815), (65.8202, 69.8189, 77.8202), (91.109, 95.7542, 104.9637))
ROOTS = ((2.7055, 3.8415, 6.6349), (12.2971, 14.2639, 18.52), (18.8928, 21.1314, 25.865), (25.1236, 27.5858, 32.7172), (31.2379, 33.8777, 39.3693), (37.2786, 40.0763, 45.8662))
#: Published response surfaces of p-values for one series and for the residual of two: least and greatest statistic, where the surfaces meet, and the
#: coefficients of the normal quantile below and above it, from the constant on; fixed values.
P_VALUES = (
    (-18.83, 2.74, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    (-18.86, 0.92, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
)
#: Statistics and p-values of the stationarity test, and the 95 % quantile of the law of break dates; fixed values.
STATIONARY_P = ((0.347, 0.1), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
BREAK_95 = 11.0


def _by_key(df: DataFrame, columns: list[str], key: list[str], order: list[str], out: str, run: Callable[[pd.DataFrame], list[tuple] | pd.DataFrame]) -> DataFrame:
    """run(rows of a key in order) for each key; its tuples follow the key's columns."""
    kinds = dict(df.dtypes)
    names = [*key, *(c.strip().split(" ")[0] for c in out.split(","))]

    def grouped(group: pd.DataFrame) -> pd.DataFrame:
        own = tuple(group[k].iloc[0] for k in key)
        return pd.DataFrame([(*own, *row) for row in run(group.sort_values(order))], columns=names)

    return df.select(*dict.fromkeys([*key, *order, *columns])).groupBy(*key).applyInPandas(grouped, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), out]))


def _fit(design: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Coefficients, their standard errors and the rest; None if the rows do not determine them."""
    n, k = design.shape
    if n <= k:
        return None
    beta, _, rank, _ = np.linalg.lstsq(design, target, rcond=None)
    rest = target - design @ beta
    spread = rest @ rest / (n - k)
    if rank < k or not spread > 0:
        return None
    return beta, np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * spread), rest


def _root(x: np.ndarray, lags: int, constant: bool) -> tuple[float | None, int]:
    """The t value of the level in the regression of its changes, and the rows used."""
    d = np.diff(x)
    n = len(d) - lags
    if n <= lags + 3:
        return None, max(n, 0)
    parts = [x[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)], *([np.ones(n)] if constant else [])]
    found = _fit(np.stack(parts, axis=1), d[lags:])
    return (float(found[0][0] / found[1][0]) if found else None), n


def _critical(surface: tuple, n: int) -> list[float | None]:
    return [sum(c / n**i for i, c in enumerate(row)) if n else None for row in surface]


def unit_root_p(statistic: float | None, n_series: int = 1) -> float | None:
    """The chance of a statistic this low or lower under a unit root, of one series or of the residual of two."""
    if statistic is None:
        return None
    least, greatest, meet, low, high = P_VALUES[n_series - 1]
    if statistic <= least or statistic >= greatest:
        return 0.0 if statistic <= least else 1.0
    return NormalDist().cdf(sum(c * statistic**i for i, c in enumerate(low if statistic <= meet else high)))


def stationary_p(statistic: float | None) -> float | None:
    """The chance of a statistic this high or higher if the series is stationary, between the published 1 and 10 %."""
    return None if statistic is None else float(np.interp(statistic, *zip(*STATIONARY_P, strict=True)))


def _chosen_lags(x: np.ndarray, constant: bool, most: int | None) -> int:
    """The lags of a unit root regression by Akaike's criterion, all on the rows that the longest leaves."""
    d = np.diff(x)
    longest = int(12 * (len(x) / 100) ** 0.25) if most is None else most
    longest = max(0, min(longest, len(d) // 2 - 3))
    target, scores = d[longest:], []
    if len(target) < 3:
        return 0
    for lags in range(longest + 1):
        parts = [x[longest:-1], *[d[longest - k : len(d) - k] for k in range(1, lags + 1)], *([np.ones(len(target))] if constant else [])]
        found = _fit(np.stack(parts, axis=1), target)
        scores.append(math.inf if found is None else len(target) * math.log(max(found[2] @ found[2], 1e-300) / len(target)) + 2 * len(parts))
    return int(np.argmin(scores)) if math.isfinite(min(scores)) else 0


def unit_roots(df: DataFrame, value: str, key: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """Both tests of a series with p-values (M6): adf with the lags that Akaike's criterion chooses up to `most` (by default 12 (n / 100)^(1/4)), and kpss."""

    def run(group: pd.DataFrame) -> list[tuple]:
        x = group[value].dropna().to_numpy(float)
        lags = _chosen_lags(x, True, most)
        statistic, n = _root(x, lags, True)
        level, kernel = _level(x, None)
        return [(statistic, unit_root_p(statistic), lags, n, level, stationary_p(level), kernel)]

    return _by_key(df, [value], key, order, "adf double, adf_p double, adf_lags long, n long, kpss double, kpss_p double, kpss_lags long", run)


def cointegration(df: DataFrame, y: str, x: str, key: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """Engle-Granger both ways with p-values (M7): dependent, slope, statistic, p, and the lags that Akaike's criterion chooses for the rest."""

    def run(group: pd.DataFrame) -> list[tuple]:
        rows, out = group[[y, x]].dropna().to_numpy(float), []
        for name, a, b in ((y, rows[:, 0], rows[:, 1]), (x, rows[:, 1], rows[:, 0])):
            line = _fit(np.stack([b, np.ones(len(b))], axis=1), a) if len(a) > 2 else None
            lags = 0 if line is None else _chosen_lags(line[2], False, most)
            slope, _, statistic, n = _engle_granger(a, b, lags)
            out.append((name, slope, statistic, unit_root_p(statistic, 2), lags, n))
        return out

    return _by_key(df, [y, x], key, order, "dependent string, slope double, statistic double, p double, lags long, n long", run)


def dickey_fuller(df: DataFrame, value: str, key: list[str], order: list[str], lags: int = 1) -> DataFrame:
    """statistic of the augmented Dickey-Fuller regression with a constant, its rows n, and critical values (M6)."""

    def run(group: pd.DataFrame) -> list[tuple]:
        statistic, n = _root(group[value].dropna().to_numpy(float), lags, True)
        return [(statistic, n, *_critical(UNIT_ROOT, n))]

    return _by_key(df, [value], key, order, "statistic double, n long, critical_1 double, critical_5 double, critical_10 double", run)


def _level(x: np.ndarray, lags: int | None) -> tuple[float | None, int]:
    """The statistic of the test that a series is stationary round a level, and its lags."""
    n = len(x)
    most = int(4 * (n / 100) ** 0.25) if lags is None else lags
    if n <= most + 1:
        return None, most
    e = x - x.mean()
    spread = e @ e + 2 * sum((1 - k / (most + 1)) * (e[k:] @ e[:-k]) for k in range(1, most + 1))
    return (float((np.cumsum(e) ** 2).sum() / n / spread) if spread > 0 else None), most


def kpss(df: DataFrame, value: str, key: list[str], order: list[str], lags: int | None = None) -> DataFrame:
    """statistic of the test that a series is stationary round a level, with Bartlett weights over `lags`, by default 4 (n / 100)^(1/4) (M6)."""

    def run(group: pd.DataFrame) -> list[tuple]:
        x = group[value].dropna().to_numpy(float)
        statistic, most = _level(x, lags)
        return [(statistic, len(x), most, *STATIONARY)]

    return _by_key(df, [value], key, order, "statistic double, n long, lags long, critical_1 double, critical_5 double, critical_10 double", run)


def _engle_granger(a: np.ndarray, b: np.ndarray, lags: int) -> tuple:
    """slope, intercept, statistic, rows: a on b, then the unit root of the rest."""
    line = _fit(np.stack([b, np.ones(len(b))], axis=1), a) if len(a) > 2 else None
    if line is None:
        return None, None, None, 0
    return float(line[0][0]), float(line[0][1]), *_root(line[2], lags, False)


def engle_granger(df: DataFrame, y: str, x: str, key: list[str], order: list[str], lags: int = 1) -> DataFrame:
    """For y on x and x on y: the line, and the unit root statistic of its rest with critical values (M7)."""

    def run(group: pd.DataFrame) -> list[tuple]:
        rows = group[[y, x]].dropna().to_numpy(float)
        out = []
        for name, a, b in ((y, rows[:, 0], rows[:, 1]), (x, rows[:, 1], rows[:, 0])):
            found = _engle_granger(a, b, lags)
            out.append((name, *found, *_critical(COINTEGRATED, found[3])))
        return out

    return _by_key(df, [y, x], key, order, "dependent string, slope double, intercept double, statistic double, n long, critical_1 double, critical_5 double, critical_10 double", run)


def _johansen(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Roots from the greatest on, their vectors, and the rows; None if the rows do not determine them."""
    d = np.diff(x, axis=0)
    n, p = len(d) - lags, x.shape[1]
    if n <= p * lags + p + 2:
        return None
    # changes and levels without what a constant and the changes before explain
    own = np.concatenate([np.ones((n, 1)), *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]], axis=1)
    clean = lambda z: z - own @ np.linalg.lstsq(own, z, rcond=None)[0]
    r0, r1 = clean(d[lags:]), clean(x[lags:-1])
    s00, s11, s01 = r0.T @ r0 / n, r1.T @ r1 / n, r0.T @ r1 / n
    if min(np.linalg.cond(s00), np.linalg.cond(s11)) > 1e12:
        return None
    roots, vectors = np.linalg.eig(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01)))
    by = np.argsort(-roots.real)
    return np.clip(roots.real[by], 0, 1 - 1e-15), vectors.real[:, by], n


def johansen(df: DataFrame, a: str, b: str, key: list[str], order: list[str], lags: int = 1) -> DataFrame:
    """For the ranks 0 and 1 of two series: root, trace and largest-root statistics with 5 % values; at rank 0 the cointegrating weight of b for one of a (M8)."""

    def run(group: pd.DataFrame) -> list[tuple]:
        x = group[[a, b]].dropna().to_numpy(float)
        found = _johansen(x, lags)
        if found is None:
            return [(r, None, None, None, *limits, None, max(len(x) - 1 - lags, 0)) for r, limits in enumerate(zip(TRACE, LARGEST, strict=True))]
        roots, vectors, n = found
        weight = float(vectors[1, 0] / vectors[0, 0]) if vectors[0, 0] else None
        logs = -n * np.log(1 - roots)
        return [(r, float(roots[r]), float(logs[r:].sum()), float(logs[r]), TRACE[r], LARGEST[r], weight if r == 0 else None, n) for r in range(2)]

    return _by_key(df, [a, b], key, order, "rank long, root double, trace double, largest double, trace_5 double, largest_5 double, weight double, n long", run)


def johansen_of(df: DataFrame, columns: list[str], key: list[str], order: list[str], lags: int = 1) -> DataFrame:
    """For each rank of two to six series: root, trace and largest-root statistics with 10, 5 and 1 % values, and the root's vector with one for the first series (M8)."""
    if not 2 <= len(columns) <= len(TRACES):
        raise ValueError(f"two to {len(TRACES)} series are needed")
    p = len(columns)

    def run(group: pd.DataFrame) -> list[tuple]:
        x = group[columns].dropna().to_numpy(float)
        found = _johansen(x, lags)
        limits = [(*TRACES[p - r - 1], *ROOTS[p - r - 1]) for r in range(p)]
        if found is None:
            return [(r, None, None, None, *limits[r], None, max(len(x) - 1 - lags, 0)) for r in range(p)]
        roots, vectors, n = found
        logs = -n * np.log(1 - roots)
        scaled = [(vectors[:, r] / vectors[0, r]).tolist() if vectors[0, r] else None for r in range(p)]
        return [(r, float(roots[r]), float(logs[r:].sum()), float(logs[r]), *limits[r], scaled[r], n) for r in range(p)]

    levels = ", ".join(f"{kind}_{level} double" for kind in ("trace", "largest") for level in (10, 5, 1))
    return _by_key(df, columns, key, order, f"rank long, root double, trace double, largest double, {levels}, vector array<double>, n long", run)


def _best_cuts(n: int, cost: Callable[[np.ndarray, int], np.ndarray], most: int, least: int) -> tuple[list[float], list[list[int]]]:
    """For each number of cuts up to `most`: the least total cost of segments of `least` rows or more, and the bounds of the segments.

    Dynamic programming over ends with pruning: splitting a segment never costs more, so a start i whose best way to j costs no less than the best
    way that ends a segment at j is outdone by j for every end from j + least on, and is dropped there.
    """
    costs, back = [np.full(n + 1, np.inf)], []
    ends = np.arange(least, n + 1)
    costs[0][ends] = [float(cost(np.zeros(1, np.int64), int(j))[0]) for j in ends]
    for _ in range(most):
        before, now, cut = costs[-1], np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        starts, gone = np.zeros(0, np.int64), {}
        for j in range(2 * least, n + 1):
            starts = np.append(starts, j - least)
            if j in gone:
                starts = starts[~np.isin(starts, gone.pop(j))]
            total = before[starts] + cost(starts, j)
            k = int(np.argmin(total))
            now[j], cut[j] = total[k], starts[k]
            outdone = starts[total >= before[j]]
            if len(outdone):
                gone[j + least] = outdone
        costs.append(now)
        back.append(cut)
    bounds = []
    for m in range(most + 1):
        at = [n]
        for level in range(m, 0, -1):
            at.append(int(back[level - 1][at[-1]]))
        bounds.append([0, *reversed(at)])
    return [float(c[n]) for c in costs], bounds


def _prefix(*columns: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, len(columns))), np.cumsum(np.stack(columns, axis=1), axis=0)])


def breaks(df: DataFrame, y: str, x: str, key: list[str], order: list[str], most: int = 3, least: int = 30, width: float = BREAK_95) -> DataFrame:
    """Unknown breaks of the line of y on x (M11): (n_breaks, segment, first, last, n, slope, intercept, rss, first_low, first_high) of the best cut into segments.

    Every number of breaks up to `most` is solved exactly, from prefix sums; the number is chosen by the Bayesian criterion. `first` and `last` number the
    rows from 0 on. A break's `first` has an interval by the published law of break dates (`width`: its quantile), null in the first segment.
    """

    def run(group: pd.DataFrame) -> list[tuple]:
        rows = group[[y, x]].dropna().to_numpy(float)
        n = len(rows)
        if n < least:
            return []
        v, u = rows[:, 0] - rows[:, 0].mean(), rows[:, 1] - rows[:, 1].mean()
        sums = _prefix(u, v, u * u, u * v, v * v)

        def rss(i: np.ndarray, j: int) -> np.ndarray:
            """Of the rows from i to before j."""
            m = np.asarray(j - i, float)
            su, sv, suu, suv, svv = np.moveaxis(sums[j] - sums[i], -1, 0)
            cuu, cuv, cvv = suu - su * su / m, suv - su * sv / m, svv - sv * sv / m
            return np.maximum(cvv - np.where(cuu > 1e-12, cuv * cuv / np.where(cuu > 1e-12, cuu, 1), 0), 0)

        costs, cuts = _best_cuts(n, rss, most, least)
        score = [n * math.log(max(c, 1e-300) / n) + (3 * m + 2) * math.log(n) if math.isfinite(c) else math.inf for m, c in enumerate(costs)]
        m = int(np.argmin(score))
        bounds, out, before = cuts[m], [], None
        for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own = rows[i:j]
            spread = ((own[:, 1] - own[:, 1].mean()) ** 2).sum()
            slope = float(((own[:, 1] - own[:, 1].mean()) * own[:, 0]).sum() / spread) if spread > 0 else None
            line = np.array([own[:, 0].mean() - (slope or 0.0) * own[:, 1].mean(), slope or 0.0])
            error, low, high = float(rss(np.array([i]), j)[0]), None, None
            if before is not None:
                design = np.stack([np.ones(j - bounds[k - 1]), rows[bounds[k - 1] : j, 1]], axis=1)
                shift = line - before[0]
                strength = shift @ (design.T @ design / len(design)) @ shift * (len(design) - 4) / max(error + before[1], 1e-300)
                reach = int(width / strength) + 1 if strength > 0 else n
                low, high = max(bounds[k - 1], i - reach), min(j - 1, i + reach)
            out.append((m, k, i, j - 1, j - i, slope, None if slope is None else float(line[0]), error, low, high))
            before = line, error
        return out

    return _by_key(df, [y, x], key, order, "n_breaks long, segment long, first long, last long, n long, slope double, intercept double, rss double, first_low long, first_high long", run)


def variance_breaks(df: DataFrame, value: str, key: list[str], order: list[str], most: int = 3, least: int = 30, width: float = BREAK_95) -> DataFrame:
    """Unknown breaks of the variance of a residual round 0 (M11): (n_breaks, segment, first, last, n, variance, first_low, first_high), as `breaks` gives them for a line.

    Segments cost n log(mean square), so the likelihood of normal residuals decides; a break adds a variance and a date to the criterion.
    """

    def run(group: pd.DataFrame) -> list[tuple]:
        e = group[value].dropna().to_numpy(float)
        n = len(e)
        if n < least:
            return []
        sums = _prefix(e * e)[:, 0]
        floor = max(sums[-1] / n * 1e-12, 1e-300)
        likely = lambda i, j: (j - i) * np.log(np.maximum((sums[j] - sums[i]) / (j - i), floor))
        costs, cuts = _best_cuts(n, likely, most, least)
        m = int(np.argmin([c + (2 * k + 1) * math.log(n) for k, c in enumerate(costs)]))
        bounds, out = cuts[m], []
        for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            low = high = None
            if k:
                left, right = e[bounds[k - 1] : i] ** 2, e[i:j] ** 2
                noise = (left.var() * len(left) + right.var() * len(right)) / max(len(left) + len(right) - 2, 1)
                strength = (right.mean() - left.mean()) ** 2 / max(noise, 1e-300)
                reach = int(width / strength) + 1 if strength > 0 else n
                low, high = max(bounds[k - 1], i - reach), min(j - 1, i + reach)
            out.append((m, k, i, j - 1, j - i, float((sums[j] - sums[i]) / (j - i)), low, high))
        return out

    return _by_key(df, [value], key, order, "n_breaks long, segment long, first long, last long, n long, variance double, first_low long, first_high long", run)


def half_life_interval(df: DataFrame, value: str, key: list[str], order: list[str], draws: int = 500, level: float = 0.9, seed: int = 7) -> DataFrame:
    """half_life with an interval from `draws` seeded resamples of its steps, the same on every run (M5); resamples that do not revert count as endless."""

    def run(group: pd.DataFrame) -> list[tuple]:
        x = group[value].dropna().to_numpy(float)
        if len(x) < 5:
            return [(None, None, None, max(len(x) - 1, 0))]
        b, d = x[:-1], np.diff(x)

        def life(rows: np.ndarray) -> float:
            u, v = b[rows], d[rows]
            spread = ((u - u.mean()) ** 2).sum()
            kappa = ((u - u.mean()) * v).sum() / spread if spread > 0 else 0.0
            return -math.log(2) / kappa if kappa < 0 else math.inf

        rng = np.random.default_rng(seed)
        found = np.sort([life(rng.integers(0, len(d), len(d))) for _ in range(draws)])
        low, high = (float(found[min(draws - 1, round(q * draws))]) for q in ((1 - level) / 2, (1 + level) / 2))
        whole = life(np.arange(len(d)))
        return [(whole if math.isfinite(whole) else None, low, high if math.isfinite(high) else None, len(d))]

    return _by_key(df, [value], key, order, "half_life double, low double, high double, n long", run)
