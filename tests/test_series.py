"""Models of whole series against plain computations by their definitions."""

import datetime as dt
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.functions import filters, rolling, series, stats, trading


def _frame(spark, **columns):
    names = list(columns)
    rows = [("s", i, *(None if v is None else float(v) for v in values)) for i, values in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "k string, i int, " + ", ".join(f"{n} double" for n in names))


def _t_value(design, target, column):
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ target
    rest = target - design @ beta
    return beta[column] / math.sqrt(inverse[column, column] * (rest @ rest) / (len(target) - design.shape[1]))


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(3)
    trend = np.cumsum(rng.normal(size=400))
    return trend + rng.normal(size=400) * 0.3, 0.5 * trend + rng.normal(size=400) * 0.3


def test_unit_roots(spark, walk):
    a, _ = walk
    for lags in (0, 1, 3):
        d = np.diff(a)
        n = len(d) - lags
        design = np.stack([np.ones(n), a[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]], axis=1)
        row = series.dickey_fuller(_frame(spark, v=a), "v", ["k"], ["i"], lags).first()
        assert row["statistic"] == pytest.approx(_t_value(design, d[lags:], 1)) and row["n"] == n and row["critical_1"] < row["critical_5"] < row["critical_10"] < -2.5
    e = a - a.mean()
    spread = (e @ e) / len(e) + 2 * sum((1 - k / 6) * (e[k:] * e[:-k]).sum() / len(e) for k in range(1, 6))
    row = series.kpss(_frame(spark, v=a), "v", ["k"], ["i"], 5).first()
    assert row["statistic"] == pytest.approx((np.cumsum(e) ** 2).sum() / len(e) ** 2 / spread) and row["statistic"] > row["critical_1"]
    assert series.kpss(_frame(spark, v=np.diff(a)), "v", ["k"], ["i"]).first()["statistic"] < 0.463
    for odd in ([1.0] * 20, [1.0, 2.0], [None] * 9):
        assert series.dickey_fuller(_frame(spark, v=odd), "v", ["k"], ["i"]).first()["statistic"] is None
        assert series.kpss(_frame(spark, v=odd), "v", ["k"], ["i"]).first()["statistic"] is None
    assert series.dickey_fuller(_frame(spark, v=a).limit(0), "v", ["k"], ["i"]).count() == 0


def test_engle_granger(spark, walk):
    a, b = walk
    found = {r["dependent"]: r for r in series.engle_granger(_frame(spark, a=a, b=b), "a", "b", ["k"], ["i"]).collect()}
    for name, y, x in (("a", a, b), ("b", b, a)):
        slope, intercept = np.polyfit(x, y, 1)
        e = y - intercept - slope * x
        d = np.diff(e)
        assert found[name]["slope"] == pytest.approx(slope) and found[name]["statistic"] == pytest.approx(_t_value(np.stack([e[1:-1], d[:-1]], axis=1), d[1:], 0))
        assert found[name]["statistic"] < found[name]["critical_1"] < found[name]["critical_5"]
    rows = {r["i"]: r for r in rolling.rolling_engle_granger(_frame(spark, a=a, b=b), "a", "b", ["k"], ["i"], rows=100).collect()}
    assert rows[98]["statistic"] is None and len(rows) == 400
    for end in (99, 250, 399):
        part = series._engle_granger(a[end - 99 : end + 1], b[end - 99 : end + 1], 1)
        assert rows[end]["statistic"] == pytest.approx(part[2]) and rows[end]["rejects"] == (part[2] < series._critical(series.COINTEGRATED, part[3])[1])


def test_johansen(spark, walk):
    a, b = walk
    x = np.stack([a, b], axis=1)
    d = np.diff(x, axis=0)
    own = np.concatenate([np.ones((len(d) - 1, 1)), d[:-1]], axis=1)
    project = np.eye(len(own)) - own @ np.linalg.inv(own.T @ own) @ own.T
    r0, r1 = project @ d[1:], project @ x[1:-1]
    s = lambda p, q: p.T @ q / len(own)
    roots = sorted(np.linalg.eigvals(np.linalg.inv(s(r1, r1)) @ s(r1, r0) @ np.linalg.inv(s(r0, r0)) @ s(r0, r1)).real, reverse=True)
    found = series.johansen(_frame(spark, a=a, b=b), "a", "b", ["k"], ["i"]).orderBy("rank").collect()
    assert [r["root"] for r in found] == pytest.approx(roots)
    assert found[0]["trace"] == pytest.approx(-len(own) * sum(math.log(1 - r) for r in roots)) and found[1]["trace"] == found[1]["largest"]
    assert found[0]["trace"] > found[0]["trace_5"] and found[1]["trace"] < found[1]["trace_5"] and found[0]["weight"] == pytest.approx(-2, abs=0.2)
    assert all(r["root"] is None for r in series.johansen(_frame(spark, a=[1.0] * 30, b=[2.0] * 30), "a", "b", ["k"], ["i"]).collect())


def test_breaks_against_all_cuts(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = np.where(np.arange(60) < 22, 1 + 2 * x, np.where(np.arange(60) < 41, 6 - x, -3 + 0.5 * x)) + rng.normal(size=60) * 0.3

    def rss(i, j):
        return ((y[i:j] - np.polyval(np.polyfit(x[i:j], y[i:j], 1), x[i:j])) ** 2).sum()

    best = {}
    for m in range(4):
        for cuts in itertools.combinations(range(8, 53), m):
            bounds = [0, *cuts, 60]
            if min(b - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)) >= 8:
                total = sum(rss(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
                best[m] = min(best.get(m, (math.inf, ())), (total, cuts))
    m = min(best, key=lambda m: 60 * math.log(best[m][0] / 60) + (3 * m + 2) * math.log(60))
    found = series.breaks(_frame(spark, y=y, x=x), "y", "x", ["k"], ["i"], most=3, least=8).orderBy("segment").collect()
    assert m == 2 and tuple(r["first"] for r in found[1:]) == best[2][1] and sum(r["rss"] for r in found) == pytest.approx(best[2][0])
    assert found[0]["slope"] == pytest.approx(2, abs=0.2) and series.breaks(_frame(spark, y=y[:5], x=x[:5]), "y", "x", ["k"], ["i"]).count() == 0


def test_pruned_cuts_equal_all_cuts():
    rng = np.random.default_rng(21)
    for trial in range(12):
        n, least = int(rng.integers(20, 70)), int(rng.integers(3, 8))
        e = rng.normal(size=n) * np.where(np.arange(n) < n // 2, 1, rng.choice([1.0, 3.0]))
        sums = series._prefix(e, e * e)
        kinds = {
            "level": lambda i, j: (sums[j, 1] - sums[i, 1]) - (sums[j, 0] - sums[i, 0]) ** 2 / (j - i),
            "variance": lambda i, j: (j - i) * np.log((sums[j, 1] - sums[i, 1]) / (j - i)),
        }
        for cost in kinds.values():
            found, bounds = series._best_cuts(n, cost, 2, least)
            for m in range(3):
                every = [[0, *c, n] for c in itertools.combinations(range(1, n), m) if min(b - a for a, b in zip([0, *c], [*c, n], strict=True)) >= least]
                price = lambda at: sum(float(cost(np.array([a]), b)[0]) for a, b in zip(at[:-1], at[1:], strict=True))
                assert found[m] == (pytest.approx(min(map(price, every))) if every else math.inf)
                assert not every or price(bounds[m]) == pytest.approx(found[m])


def test_variance_breaks_and_intervals(spark):
    rng = np.random.default_rng(22)
    e = rng.normal(size=300) * np.where(np.arange(300) < 120, 1.0, 4.0)
    found = series.variance_breaks(_frame(spark, e=e), "e", ["k"], ["i"], most=3, least=20).orderBy("segment").collect()
    assert len(found) == 2 and abs(found[1]["first"] - 120) < 8 and found[1]["first_low"] <= 120 <= found[1]["first_high"] and found[0]["first_low"] is None
    assert found[1]["variance"] == pytest.approx((e[found[1]["first"] :] ** 2).mean())
    # the interval of a line's break holds the true one
    for _ in range(2):
        x = rng.normal(size=160)
        y = np.where(np.arange(160) < 80, 1 + x, 1.8 + 1.4 * x) + rng.normal(size=160)
        row = series.breaks(_frame(spark, y=y, x=x), "y", "x", ["k"], ["i"], most=1, least=20).filter("segment = 1").first()
        assert row["first_low"] <= 80 <= row["first_high"] and row["first_low"] <= row["first"] <= row["first_high"]
    assert series.variance_breaks(_frame(spark, e=e[:5]), "e", ["k"], ["i"]).count() == 0


def test_p_values_and_lags(spark, walk):
    for statistic, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.1)):
        assert series.unit_root_p(statistic) == pytest.approx(p, rel=0.02)
    for statistic, p in ((-3.9, 0.01), (-3.34, 0.05), (-3.04, 0.1)):
        assert series.unit_root_p(statistic, 2) == pytest.approx(p, rel=0.03)
    assert series.unit_root_p(-25.0) == 0 and series.unit_root_p(3.0) == 1 and series.unit_root_p(None) is None
    assert [series.stationary_p(v) for v in (0.1, 0.463, 0.6565, 2.0)] == pytest.approx([0.1, 0.05, 0.0175, 0.01])
    a, b = walk
    d = np.diff(a)
    scores = []
    for lags in range(5):
        design = np.stack([np.ones(len(d) - 4), a[4:-1], *[d[4 - k : len(d) - k] for k in range(1, lags + 1)]], axis=1)
        rest = d[4:] - design @ np.linalg.lstsq(design, d[4:], rcond=None)[0]
        scores.append(len(rest) * math.log(rest @ rest / len(rest)) + 2 * design.shape[1])
    row = series.unit_roots(_frame(spark, v=a), "v", ["k"], ["i"], most=4).first()
    assert row["adf_lags"] == int(np.argmin(scores)) and row["adf"] == pytest.approx(series.dickey_fuller(_frame(spark, v=a), "v", ["k"], ["i"], row["adf_lags"]).first()["statistic"])
    assert row["adf_p"] > 0.05 and row["kpss_p"] == 0.01 and series.unit_roots(_frame(spark, v=np.diff(a)), "v", ["k"], ["i"]).first()["adf_p"] < 0.001
    both = {r["dependent"]: r for r in series.cointegration(_frame(spark, a=a, b=b), "a", "b", ["k"], ["i"]).collect()}
    assert both["a"]["p"] < 0.01 and both["b"]["p"] < 0.01 and both["a"]["slope"] == pytest.approx(np.polyfit(b, a, 1)[0])
    assert series.unit_roots(_frame(spark, v=[1.0, 2.0]), "v", ["k"], ["i"]).first()["adf_p"] is None


def test_johansen_of_three(spark, walk):
    a, b = walk
    rng = np.random.default_rng(23)
    x = np.stack([a, b, np.cumsum(rng.normal(size=400))], axis=1)
    df = _frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2])
    d = np.diff(x, axis=0)
    own = np.concatenate([np.ones((len(d) - 1, 1)), d[:-1]], axis=1)
    project = np.eye(len(own)) - own @ np.linalg.inv(own.T @ own) @ own.T
    r0, r1 = project @ d[1:], project @ x[1:-1]
    s = lambda p, q: p.T @ q / len(own)
    roots = sorted(np.linalg.eigvals(np.linalg.inv(s(r1, r1)) @ s(r1, r0) @ np.linalg.inv(s(r0, r0)) @ s(r0, r1)).real, reverse=True)
    found = series.johansen_of(df, ["a", "b", "c"], ["k"], ["i"]).orderBy("rank").collect()
    assert [r["root"] for r in found] == pytest.approx(roots) and [r["trace"] for r in found] == pytest.approx([-len(own) * sum(math.log(1 - v) for v in roots[k:]) for k in range(3)])
    assert found[0]["trace"] > found[0]["trace_1"] > found[0]["trace_5"] > found[0]["trace_10"] and found[1]["trace"] < found[1]["trace_5"]
    assert found[0]["vector"][0] == 1 and found[0]["vector"][1] == pytest.approx(-2, abs=0.2)
    two = series.johansen_of(df, ["a", "b"], ["k"], ["i"]).orderBy("rank").collect()
    plain = series.johansen(df, "a", "b", ["k"], ["i"]).orderBy("rank").collect()
    assert [(r["trace"], r["trace_5"], r["largest_5"]) for r in two] == [(r["trace"], r["trace_5"], r["largest_5"]) for r in plain]
    with pytest.raises(ValueError):
        series.johansen_of(df, ["a"], ["k"], ["i"])
    assert all(r["root"] is None for r in series.johansen_of(_frame(spark, a=[1.0] * 30, b=[2.0] * 30), ["a", "b"], ["k"], ["i"]).collect())


def test_half_life_interval(spark):
    rng = np.random.default_rng(5)
    x = [0.0]
    for _ in range(800):
        x.append(x[-1] * 0.9 + rng.normal())
    df = _frame(spark, v=x)
    row = series.half_life_interval(df, "v", ["k"], ["i"], draws=200).first()
    b, d, draw = np.array(x[:-1]), np.diff(x), np.random.default_rng(7)
    lives = []
    for _ in range(200):
        rows = draw.integers(0, len(d), len(d))
        kappa = np.polyfit(b[rows], d[rows], 1)[0]
        lives.append(-math.log(2) / kappa)
    lives.sort()
    assert (row["low"], row["high"]) == pytest.approx((lives[10], lives[190])) and row["low"] < row["half_life"] < row["high"]
    assert row["half_life"] == pytest.approx(stats.half_life(df, "v", ["k"], ["i"]).first()["half_life"])
    assert series.half_life_interval(_frame(spark, v=[1.0, 2.0]), "v", ["k"], ["i"]).first()["half_life"] is None


def test_kalman_against_a_loop(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=50), rng.normal(size=50)
    y[7] = np.nan
    want, mean, cov = [], np.zeros(2), np.eye(2)
    for a, b in zip(x, y, strict=True):
        want.append(mean.copy())
        cov = cov + 1e-4 * np.eye(2)
        if not np.isnan(b):
            h = np.array([[1.0, a]])
            gain = cov @ h.T / (h @ cov @ h.T + 1e-2)
            mean, cov = mean + (gain * (b - h @ mean)).ravel(), (np.eye(2) - gain @ h) @ cov
    found = filters.kalman(_frame(spark, y=[None if np.isnan(v) else v for v in y], x=x), "y", "x", ["k"], ["i"]).orderBy("i").collect()
    assert [(r["alpha"], r["beta"]) for r in found] == [pytest.approx(tuple(w)) for w in want]


def test_nothing_looks_ahead(spark):
    rng = np.random.default_rng(4)
    z, price = rng.normal(size=200) * 2, 100 + np.cumsum(rng.normal(size=200))

    def run(z, price):
        rows = trading.signal_states(_frame(spark, z=z, price=price), "z", ["k"], ["i"]).join(_frame(spark, z=z, price=price).select("k", "i", "price"), ["k", "i"])
        return {r["i"]: (r["position"], r["value"]) for r in trading.backtest(rows, "position", "price", ["k"], ["i"]).collect()}

    one = run(z, price)
    z2, price2 = z.copy(), price.copy()
    z2[120:], price2[120:] = 5.0, 1e6
    two = run(z2, price2)
    assert all(one[i] == pytest.approx(two[i], nan_ok=True) for i in range(120))
    held = 0
    for i in range(1, 200):
        before, held = held, one[i - 1][0]
        assert one[i][1] == pytest.approx(held * (price[i] / price[i - 1] - 1) - abs(held - before) / 1e4)
    blocks = _frame(spark, y=price, x=z).withColumn("b", (F.col("i") / 50).cast("int"))
    fits = {r["i"]: r["slope"] for r in stats.walk_forward(blocks, "y", "x", ["k"], "b").collect()}
    assert fits[10] is None and fits[120] == pytest.approx(np.polyfit(z[:100], price[:100], 1)[0])


def test_guarded_documents(spark):
    rows = [("fresh", dt.date(2024, 1, 2), 1, "enter", 1, False), ("fresh", dt.date(2024, 1, 1), 0, None, 1, False), ("stale", dt.date(2024, 1, 2), 1, None, 9, False), ("broken", dt.date(2024, 1, 2), -1, "enter", 1, True), ("none", dt.date(2024, 1, 2), -1, None, None, False)]
    df = spark.createDataFrame(rows, "k string, date date, position int, reason string, lag int, failed boolean")
    got = {r["k"]: r for r in trading.signal_documents(df, ["k"], "date", {"lag": 5}, F.col("failed"), ["position"]).collect()}
    assert {k: (r["state"], r["action"]) for k, r in got.items()} == {"fresh": ("LONG", "ENTER_LONG"), "stale": ("FLAT", "NONE"), "broken": ("FLAT", "NONE"), "none": ("FLAT", "NONE")}
    assert json.loads(got["stale"]["document"])["data_quality"] == {"stale_inputs": ["lag"], "warnings": ["stale inputs"]}
    anchors = stats.anchor_checks(df.withColumn("v", F.lit(-1.0)), "v", "date", ["k"], [("old", dt.date(2020, 1, 1), dt.date(2020, 2, 1), 1), ("now", dt.date(2024, 1, 1), dt.date(2024, 1, 5), -1)])
    assert {(r["anchor"], r["ok"]) for r in anchors.collect()} == {("old", None), ("now", True)}
