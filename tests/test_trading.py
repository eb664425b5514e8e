"""Sweeps, ledgers, significance, filters, rolling windows and the daily run against plain loops."""

import datetime as dt
import hashlib
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.functions import filters, ledger, rolling, series, significance, sweeps, trading
from driftgrid.streaming import signals

DAY = dt.date(2020, 1, 1)


def _rows(seed, n=260, keys=("a", None)):
    rng = np.random.default_rng(seed)
    out = []
    for k in keys:
        z, fast, price = rng.normal(size=n) * 1.8, rng.normal(size=n) * 1.8, 100 * np.exp(np.cumsum(rng.normal(size=n) * 0.01))
        out += [(k, DAY + dt.timedelta(i), None if i % 17 == 3 else float(z[i]), float("nan") if i % 23 == 4 else float(fast[i]), None if i % 41 == 7 else float(price[i]), float(i % 5) if i % 7 else None) for i in range(n)]
    return out


SCHEMA = "k string, d date, z double, fast double, price double, carry double"


def _single(spark, rows, z, enter, leave, stop, most):
    df = spark.createDataFrame(rows, SCHEMA)
    states = trading.signal_states(df, z, ["k"], ["d"], enter, leave, stop, most).withColumnRenamed("z", "_z")
    same = states["k"].eqNullSafe(df["k"]) & (states["d"] == df["d"])
    joined = df.join(states, same).select(df["*"], states["position"], states["reason"])
    return trading.backtest(joined, "position", "price", ["k"], ["d"], carry="carry", cost_bps=3.0)


def test_sweep_equals_the_fold(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, SCHEMA)
    grid = sweeps.Grid(z=("z", "fast"), enter=(1.0, 2.0), leave=(0.25, 1.0), stop=(3.0,), most_rows=(5, 40))
    found = sweeps.sweep(df, grid, "price", ["k"], ["d"], carry="carry", cost_bps=3.0, group_bytes=3 * sweeps.CELL_BYTES).collect()
    assert len(found) == 2 * len(grid.cells()) == 24 and all(r["leave"] < r["enter"] for r in found)
    assert sorted(map(str, found)) == sorted(map(str, sweeps.sweep(df, grid, "price", ["k"], ["d"], carry="carry", cost_bps=3.0).collect()))
    for cell in ((0, 0, 0, 0, 0), (1, 1, 1, 0, 1), (0, 1, 0, 0, 1)):
        z, enter, leave, stop, most = (a[i] for a, i in zip((grid.z, grid.enter, grid.leave, grid.stop, grid.most_rows), cell, strict=True))
        one = _single(spark, rows, z, enter, leave, stop, most)
        for key in ("a", None):
            own = [r for r in one.filter(F.col("k").eqNullSafe(F.lit(key))).orderBy("d").collect()]
            v = np.array([r["value"] for r in own if r["value"] is not None])
            got = next(r for r in found if r["k"] == key and tuple(r[a] for a in sweeps.AXES) == cell)
            assert got["n"] == len(v) and got["pnl"] == pytest.approx(v.sum(), abs=1e-12) and got["sharpe"] == pytest.approx(v.mean() / v.std(ddof=1))
            centred = (v - v.mean()) / v.std()
            assert got["skewness"] == pytest.approx((centred**3).mean()) and got["kurtosis"] == pytest.approx((centred**4).mean())
            equity = np.cumsum(v)
            assert got["max_drawdown"] == pytest.approx((equity - np.maximum(np.maximum.accumulate(equity), 0)).min())
            assert got["n_trades"] == sum(r["reason"] == "enter" for r in own) and got["n_stops"] == sum(r["reason"] == "stop" for r in own)
    surface = {r["k"]: r for r in sweeps.surface(spark.createDataFrame(found, sweeps.sweep(df, grid, "price", ["k"], ["d"]).schema), ["k"]).collect()}
    for key in ("a", None):
        own = {tuple(r[a] for a in sweeps.AXES): r["pnl"] for r in found if r["k"] == key}
        near = {c: [v for o, v in own.items() if sum(abs(a - b) for a, b in zip(c, o, strict=True)) == 1] for c in own}
        best, values = max(own, key=own.get), np.array(list(own.values()))
        if key is not None:
            assert surface[key]["best"] == own[best] and surface[key]["neighbours"] == pytest.approx(np.mean(near[best])) and surface[key]["n_cells"] == 12
            assert surface[key]["spike"] == pytest.approx((own[best] - np.mean(near[best])) / values.std()) and surface[key]["share_positive"] == pytest.approx((values > 0).mean())
            assert surface[key]["roughness"] == pytest.approx(np.mean([(own[c] - np.mean(n)) ** 2 for c, n in near.items() if n]) / values.var())
    assert sweeps.sweep(df.limit(0), grid, "price", ["k"], ["d"]).count() == 0
    assert sweeps.sweep(df, sweeps.Grid(("z",), (1.0,), (2.0,)), "price", ["k"], ["d"]).count() == 0
    flat = sweeps.sweep(df.withColumn("price", F.lit(None).cast("double")), grid, "price", ["k"], ["d"]).first()
    assert flat["n"] == 0 and flat["pnl"] is None and flat["sharpe"] is None


def test_out_of_sample(spark):
    rows = _rows(4)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("month", F.month("d"))
    grid = sweeps.Grid(z=("z", "fast"), enter=(1.0, 1.5), leave=(0.25,), stop=(3.0,), most_rows=(10,))
    parts = sweeps.sweep(df, grid, "price", ["k"], ["d"], carry="carry", cost_bps=3.0, block="month")
    whole = {(r["k"], r["i_z"], r["i_enter"]): r for r in sweeps.sweep(df, grid, "price", ["k"], ["d"], carry="carry", cost_bps=3.0).collect()}
    own = parts.collect()
    for at, r in whole.items():
        mine = [p for p in own if (p["k"], p["i_z"], p["i_enter"]) == at]
        assert sum(p["pnl"] for p in mine) == pytest.approx(r["pnl"], abs=1e-12) and sum(p["n"] for p in mine) == r["n"] and sum(p["n_trades"] for p in mine) == r["n_trades"] and len(mine) == 9
    found = {(r["k"], r["month"]): r for r in sweeps.out_of_sample(parts, ["k"], "month").collect()}
    assert len(found) == 2 * 8
    for (key, month), r in found.items():
        past = {c: sum(p["pnl"] for p in own if p["k"] == key and p["month"] < month and (p["i_z"], p["i_enter"]) == c) for c in ((0, 0), (0, 1), (1, 0), (1, 1))}
        best = max(past, key=past.get)
        assert (r["i_z"], r["i_enter"]) == best and r["in_sample"] == pytest.approx(past[best], abs=1e-12)
        assert r["out_of_sample"] == pytest.approx(next(p["pnl"] for p in own if p["k"] == key and p["month"] == month and (p["i_z"], p["i_enter"]) == best), abs=1e-12)


def _book(rows, key_rows):
    """A loop over (position, price, spot, carry, cost) rows: every stretch of one side that is held."""
    out, held, was = [], 0.0, 0.0
    for i, r in enumerate(key_rows):
        side, before = np.sign(held), np.sign(was)
        moved, cost = abs(held - was), r["cost"] or 0.0
        shut = before != 0 and side != before
        part = abs(was) / moved if shut else 0.0
        if shut:
            out[-1]["pnl"] -= part * cost
            out[-1]["turnover"] += part * moved
        if side:
            if side != before:
                out.append({"side": side, "entry": key_rows[i - 1]["d"], "n_rows": 0, "pnl": 0.0, "turnover": 0.0})
            t = out[-1]
            t["n_rows"] += 1
            t["pnl"] += (r["spot"] or 0.0) + (r["carry_return"] or 0.0) - (1 - part) * cost
            t["turnover"] += (1 - part) * moved
            t["exit"] = r["d"] if np.sign(r["p"]) != side else None
            t["reason"] = r["reason"] if t["exit"] else None
        was, held = held, float(r["p"])
    return out


def test_ledger(spark):
    rows = _rows(2)
    one = _single(spark, rows, "z", 1.5, 0.5, 3.0, 20).withColumn("p", F.col("position").cast("double"))
    rng = np.random.default_rng(9)
    turning = spark.createDataFrame([("t", DAY + dt.timedelta(i), float(rng.integers(-2, 3)), 100.0 + i % 7, "r") for i in range(120)], "k string, d date, p double, price double, reason string")
    turning = trading.backtest(turning, "p", "price", ["k"], ["d"], cost_bps=50.0)
    for df in (one, turning):
        found = ledger.trades(df, "p", "price", ["k"], ["d"], "reason")
        got = sorted(found.collect(), key=lambda r: (r["k"] is None, r["k"] or "", r["trade"]))
        want, total = [], 0.0
        for key in sorted({r["k"] for r in df.collect()}, key=lambda k: (k is None, k or "")):
            own = df.filter(F.col("k").eqNullSafe(F.lit(key))).orderBy("d").collect()
            want += _book(rows, own)
            total += sum(r["value"] for r in own if r["value"] is not None)
        assert len(got) == len(want) > 10
        for g, w in zip(got, want, strict=True):
            assert (g["side"], g["entry"]["d"], g["exit"] and g["exit"]["d"], g["n_rows"], g["reason"]) == (w["side"], w["entry"], w["exit"], w["n_rows"], w["reason"])
            assert g["pnl"] == pytest.approx(w["pnl"], abs=1e-12) and g["turnover"] == pytest.approx(w["turnover"]) and g["worst"] <= min(0, g["pnl"]) + 1e-12
            assert g["pnl"] == pytest.approx(g["spot"] + g["carry"] - g["cost"], abs=1e-12)
        if df is turning:
            assert sum(g["pnl"] for g in got) == pytest.approx(total, abs=1e-12)  # the ledger's sums are those of the backtest
        figures = {r["k"]: r for r in ledger.trade_figures(found, ["k"]).collect()}
        key = got[0]["k"]
        closed = [w for g, w in zip(got, want, strict=True) if g["k"] == key and w["exit"]]
        assert figures[key]["mean_rows"] == pytest.approx(np.mean([w["n_rows"] for w in closed])) and figures[key]["hit_rate"] == pytest.approx(np.mean([w["pnl"] > 0 for w in closed]))
    assert ledger.trades(one.limit(0), "p", "price", ["k"], ["d"]).count() == 0
    # the folded engine's ledger is the vectorised engine's cell
    cell = {r["k"]: r for r in sweeps.sweep(spark.createDataFrame(rows, SCHEMA), sweeps.Grid(("z",), (1.5,), (0.5,), (3.0,), (20,)), "price", ["k"], ["d"], carry="carry", cost_bps=3.0).collect()}
    for key in ("a", None):
        own = one.filter(F.col("k").eqNullSafe(F.lit(key)))
        assert cell[key]["pnl"] == pytest.approx(own.agg(F.sum("value")).first()[0], abs=1e-12)
        assert cell[key]["turnover"] == pytest.approx(ledger.trades(own, "p", "price", ["k"], ["d"]).agg(F.sum("turnover")).first()[0])


def test_normal(spark):
    x = [-9.0, -7.5, -3.3, -1.0, -1e-3, 0.0, 0.4, 2.2, 5.0, 7.2]
    p = [1e-12, 1e-4, 0.02, 0.03, 0.5, 0.77, 0.98, 0.9999]
    df = spark.createDataFrame([(v,) for v in x], "v double").select("v", significance.normal_cdf(F.col("v")).alias("c"))
    for r in df.collect():
        assert r["c"] == pytest.approx(0.5 * math.erfc(-r["v"] / math.sqrt(2)), rel=1e-9, abs=1e-15)
    for r in spark.createDataFrame([(v,) for v in p], "v double").select("v", significance.normal_inverse(F.col("v")).alias("q")).collect():
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["v"]), rel=2e-9, abs=1e-9)
    odd = spark.createDataFrame([(0.0,), (1.0,), (None,), (2.0,)], "v double").select(significance.normal_inverse(F.col("v")).alias("q"), significance.normal_cdf(F.col("v")).alias("c")).collect()
    assert all(r["q"] is None for r in odd) and [r["c"] is None for r in odd] == [False, False, True, False]


def test_deflated(spark):
    cells = [("a", i, 0.02 * i - 0.05, 500, -0.3, 4.5) for i in range(9)] + [("a", 9, None, 500, None, None), ("b", 0, 0.1, 300, 0.0, 3.0)]
    df = spark.createDataFrame(cells, "k string, i_z long, sharpe double, n long, skewness double, kurtosis double")
    found = {r["k"]: r for r in significance.deflated_sharpe(df, ["k"], ["i_z"]).collect()}
    trials = np.array([c[2] for c in cells[:9]])
    inverse = NormalDist().inv_cdf
    expected = trials.std(ddof=1) * ((1 - 0.5772156649015329) * inverse(1 - 1 / 9) + 0.5772156649015329 * inverse(1 - 1 / (9 * math.e)))
    chance = NormalDist().cdf((trials[8] - expected) * math.sqrt(499) / math.sqrt(1 + 0.3 * trials[8] + 3.5 / 4 * trials[8] ** 2))
    assert found["a"]["n_trials"] == 9 and found["a"]["expected"] == pytest.approx(expected, rel=1e-7) and found["a"]["deflated"] == pytest.approx(chance, rel=1e-7)
    assert found["b"]["expected"] == 0 and found["b"]["deflated"] == found["b"]["undeflated"]
    assert significance.deflated_sharpe(df.limit(0), ["k"], ["i_z"]).count() == 0


def test_bootstrap(spark):
    rng = np.random.default_rng(6)
    values = {"a": rng.normal(0.05, 1, 90).tolist(), "short": [0.1, -0.2, 0.3], "one": [0.5], "flat": [0.0] * 12}
    rows = [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)] + [("a", 200, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    found = {r["k"]: r for r in significance.bootstrap_sharpe(df, "v", ["k"], ["i"], draws=60, block=7, seed=3).collect()}
    for key in ("a", "short"):
        v = np.array(values[key])
        ratios = []
        for draw in range(60):
            at = [int(hashlib.md5(f"3|{key}|{draw}|{slot}".encode()).hexdigest()[:12], 16) % len(v) for slot in range(-(-len(v) // 7))]
            own = np.array([v[(s + o) % len(v)] for s in at for o in range(7)])
            ratios.append(own.mean() / own.std(ddof=1) * math.sqrt(252))
        assert found[key]["sharpe"] == pytest.approx(v.mean() / v.std(ddof=1) * math.sqrt(252)) and found[key]["n_draws"] == 60
        assert (found[key]["low"], found[key]["high"]) == pytest.approx(tuple(np.quantile(ratios, [0.05, 0.95]))) and found[key]["share_not_positive"] == pytest.approx(np.mean(np.array(ratios) <= 0))
    assert found["one"]["sharpe"] is None and found["flat"]["sharpe"] is None and found["flat"]["n_draws"] == 0
    assert significance.bootstrap_sharpe(df.limit(0), "v", ["k"], ["i"]).count() == 0


def test_scaled_positions(spark):
    rng = np.random.default_rng(8)
    price = 100 * np.exp(np.cumsum(rng.normal(size=60) * 0.02))
    df = spark.createDataFrame([("k", i, 1, float(p)) for i, p in enumerate(price)], "k string, i int, p int, price double")
    size = [r["size"] for r in trading.volatility_scaled(df, "p", "price", ["k"], ["i"], target=0.1, rows=20).orderBy("i").collect()]
    moves = price[1:] / price[:-1] - 1
    assert size[:20] == [1.0] * 20
    for i in range(20, 60):
        assert size[i] == pytest.approx(min(0.1 / (moves[i - 20 : i].std(ddof=1) * math.sqrt(252)), 3.0))


def test_kalman_over_chunks(spark):
    rng = np.random.default_rng(12)
    rows = []
    for key, n in (("a", 300), (None, 41), ("c", 1)):
        x, y = rng.normal(size=n) * 3, rng.normal(size=n)
        rows += [(key, DAY + dt.timedelta(int(i)), None if i % 19 == 5 else float(y[i]), float("nan") if i % 29 == 3 else float(x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, d date, y double, x double")
    want = {}
    for key in ("a", None, "c"):
        mean, cov = np.zeros(2), np.eye(2)
        for k, d, b, a in rows:
            if k != key:
                continue
            want[key, d] = mean.copy()
            cov = cov + 1e-3 * np.eye(2)
            if b is not None and not math.isnan(a):
                h = np.array([1.0, a])
                gain = cov @ h / (h @ cov @ h + 0.05)
                mean, cov = mean + gain * (b - h @ mean), cov - np.outer(gain, h @ cov)
    for span in (7, 50, 10_000):
        found = filters.kalman(df, "y", "x", ["k"], ["d"], 1e-3, 0.05, span).collect()
        assert len(found) == len(rows)
        for r in found:
            assert (r["alpha"], r["beta"]) == pytest.approx(tuple(want[r["k"], r["d"]]), abs=1e-9)
    assert filters.kalman(df.limit(0), "y", "x", ["k"], ["d"]).count() == 0
    stamped = df.select("k", F.col("d").cast("timestamp").alias("d"), "y", "x")
    assert filters.kalman(stamped, "y", "x", ["k"], ["d"], span=30).count() == len(rows)


def test_rolling_cointegration_equals_refits(spark):
    rng = np.random.default_rng(13)
    trend = np.cumsum(rng.normal(size=150)) + 1e5
    a, b = trend + rng.normal(size=150), 0.4 * trend + rng.normal(size=150)
    rows = [("k", i, float(a[i]), None if i == 70 else float(b[i])) for i in range(150)] + [("flat", i, 1.0, 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, a double, b double")
    known = np.delete(np.arange(150), 70)
    for lags in (0, 1, 2):
        found = {(r["k"], r["i"]): r for r in rolling.rolling_engle_granger(df, "a", "b", ["k"], ["i"], rows=40, lags=lags).collect()}
        assert len(found) == 149 + 60 and all(r["statistic"] is None for (k, _), r in found.items() if k == "flat")
        for end in range(149):
            row = found["k", int(known[end])]
            if end < 39:
                assert row["statistic"] is None and row["rejects"] is None
            else:
                at = known[end - 39 : end + 1]
                want = series._engle_granger(a[at], b[at], lags)
                assert row["statistic"] == pytest.approx(want[2], rel=1e-6) and row["rejects"] == (want[2] < series._critical(series.COINTEGRATED, want[3])[1])
    assert rolling.rolling_engle_granger(df.limit(0), "a", "b", ["k"], ["i"]).count() == 0


def test_windows_of_half_lives(spark):
    rng = np.random.default_rng(14)
    v = [50.0]
    for _ in range(199):
        v.append(50 + 0.8 * (v[-1] - 50) + rng.normal())

    def run(values):
        df = spark.createDataFrame([("k", i, x, 3) for i, x in enumerate(values)], "k string, i int, v double, length int")
        rows = rolling.rolling_half_life(df, "v", ["k"], ["i"], rows=50).withColumn("length", rolling.window_rows(F.col("half_life"), 2, 3, 30))
        return {r["i"]: r for r in rolling.zscore_of_length(rows, "v", "length", ["k"], ["i"]).collect()}

    found, x = run(v), np.array(v)
    assert all(found[i]["half_life"] is None and found[i]["z"] is None for i in range(50))
    for i in range(50, 200):
        own = x[i - 50 : i]
        kappa = np.polyfit(own[:-1], np.diff(own), 1)[0]
        life = -math.log(2) / kappa if kappa < 0 else None
        assert found[i]["half_life"] == (pytest.approx(life) if life else None)
        if life:
            n = int(min(max(round(life * 2), 3), 30))
            assert found[i]["length"] == n and found[i]["z"] == pytest.approx((x[i] - x[i - n : i].mean()) / x[i - n : i].std(ddof=1))
    changed = run([*v[:120], *(0.0 for _ in v[120:])])
    assert all((changed[i]["half_life"], changed[i]["z"]) == (found[i]["half_life"], found[i]["z"]) for i in range(120))  # nothing looks ahead
    gaps = spark.createDataFrame([("k", i, None if i in (4, 5) else float(i * i), 4) for i in range(9)] + [(None, 0, 1.0, None)], "k string, i int, v double, length int")
    z = {(r["k"], r["i"]): r["z"] for r in rolling.zscore_of_length(gaps, "v", "length", ["k"], ["i"]).collect()}
    assert z["k", 7] == pytest.approx((49 - np.mean([9, 36])) / np.std([9, 36], ddof=1)) and z["k", 2] is None and z["k", 5] is None and z[None, 0] is None


def test_signal_run_in_any_split(spark, tmp_path):
    rows = [(k, d, z) for k, d, z, *_ in _rows(3, n=80, keys=("a", "b", None))]
    schema = "k string, d date, z double"
    rules = trading.Rules(1.5, 0.5, 3.0, 12)
    want = sorted(map(str, trading.signal_states(spark.createDataFrame(rows, schema), "z", ["k"], ["d"], 1.5, 0.5, 3.0, 12).collect()))
    for n, cuts in enumerate(((), (1, 2, 40), (13, 14, 60, 79))):
        folder = str(tmp_path / f"run{n}")
        bounds = [0, *cuts, 80]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            part = [r for r in rows if lo <= (r[1] - DAY).days < hi]
            spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(f"{folder}/rows")
            signals.run_signals(spark.readStream.schema(schema).parquet(f"{folder}/rows"), "z", ["k"], "d", folder, rules)  # each run starts anew from its checkpoint
        assert sorted(map(str, signals.history(spark, folder).collect())) == want
    # a run without new rows, and rows that come late or twice, leave the history as it is
    signals.run_signals(spark.readStream.schema(schema).parquet(f"{folder}/rows"), "z", ["k"], "d", folder, rules)
    spark.createDataFrame([*rows[:5], ("a", None, 9.0)], schema).write.mode("append").parquet(f"{folder}/rows")
    signals.run_signals(spark.readStream.schema(schema).parquet(f"{folder}/rows"), "z", ["k"], "d", folder, rules)
    assert sorted(map(str, signals.history(spark, folder).collect())) == want
    last = {r["k"]: r for r in spark.createDataFrame(trading.signal_states(spark.createDataFrame(rows, schema), "z", ["k"], ["d"], 1.5, 0.5, 3.0, 12).filter("d = '2020-03-20'").collect(), "k string, d date, z double, position int, reason string").collect()}
    inputs = spark.createDataFrame([("a", dt.date(2020, 3, 20), 1, True), ("b", dt.date(2020, 3, 20), 9, True)], "k string, d date, age int, rejects boolean")
    guarded = signals.failed_runs(inputs, "rejects", ["k"], "d", 1)
    documents = {r["k"]: r for r in signals.latest(signals.history(spark, folder), ["k"], "d", guarded, {"age": 3}, F.col("regime_failed"), ["z", "position"]).collect()}
    assert documents["a"]["state"] == {1: "LONG", -1: "SHORT", 0: "FLAT"}[last["a"]["position"]] and "warnings\":[]" in documents["a"]["document"]
    assert documents["b"]["state"] == "FLAT" and "stale inputs" in documents["b"]["document"] and documents[None]["action"] == "NONE"
    runs = signals.failed_runs(spark.createDataFrame([("a", i, r) for i, r in enumerate([True, False, None, False, True, False])], "k string, i int, r boolean"), "r", ["k"], "i", 3)
    assert [r["regime_failed"] for r in runs.orderBy("i").collect()] == [False, False, False, True, False, False]
