import datetime as dt
import json
import hashlib
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.config import parse
from driftgrid.functions import series as models
from driftgrid.functions import stats, trading
from driftgrid.operators import align, provenance
from driftgrid.sources import feeds
from driftgrid.streaming.increment import follow
from test_alignment import SERIES, observed, settings


def _values(df):
    return {(r["series"], r["obs_date"].isoformat()): r["value"] for r in df.collect()}


def test_fred(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DATE,DGS10\n2024-07-01,4.48\n2024-07-04,.\n2024-07-05, nan\n")
    assert _values(feeds.fred(spark, str(tmp_path / "a.csv"), "us10y")) == {("us10y", "2024-07-01"): 4.48, ("us10y", "2024-07-04"): None, ("us10y", "2024-07-05"): None}
    assert feeds.fred(spark, str(tmp_path / "a.csv"), "us10y", dt.date(2024, 7, 4)).count() == 2
    (tmp_path / "b.csv").write_text("DATE\n2024-07-01\n")
    with pytest.raises(ValueError):
        feeds.fred(spark, str(tmp_path / "b.csv"), "x")
    (tmp_path / "c.csv").write_text('"observation_date","DGS2"\n"2024-07-01","4.5"\n2024-07-02,"1,5"\n')
    with pytest.warns(UserWarning, match="DGS2"):
        got = feeds.fred(spark, str(tmp_path / "c.csv"), "us2y", code="DGS10")
    assert _values(got) == {("us2y", "2024-07-01"): 4.5, ("us2y", "2024-07-02"): None}


def test_mof(spark, tmp_path):
    body = "Date,1Y,2Y,10Y\r\n2024/7/1,0.1,0.352,1.056\r\n2024/7/3,-,0.36,1.1\r\nfooter\r\n"
    for name, content in {"bom": ("﻿Bonds\r\n" + body).encode(), "cp932": ("国債金利\r\n" + body).encode("cp932")}.items():
        (tmp_path / name).write_bytes(content)
        got = _values(feeds.mof(spark, str(tmp_path / name), {"jgb1y": "1Y", "jgb2y": "2Y"}))
        assert got == {("jgb1y", "2024-07-01"): 0.1, ("jgb2y", "2024-07-01"): 0.352, ("jgb1y", "2024-07-03"): None, ("jgb2y", "2024-07-03"): 0.36}
    assert [(r["ordinal"], r["line"]) for r in feeds.mof_rejects(spark, str(tmp_path / "bom")).collect()] == [(4, "footer")]
    with pytest.raises(ValueError):
        feeds.mof(spark, str(tmp_path / "bom"), {"x": "50Y"})
    (tmp_path / "none").write_text("no header\n1,2\n")
    with pytest.raises(ValueError):
        feeds.mof(spark, str(tmp_path / "none"), {"x": "2Y"})
    found = feeds.raw_files(spark, str(tmp_path / "none")).first()
    assert found["bytes"] == 14 and found["sha256"] == hashlib.sha256(b"no header\n1,2\n").hexdigest()


def test_prices(spark):
    rows = [("2024-07-01 00:00:00+01:00", "161.5", 0), ("2024-07-02", "161.0", 1), ("2024-07-02", "161.8", 2), ("2024-07-03", None, 3), ("2024-07-04", "1", 4), ("2024-07-04", None, 5)]
    frame = spark.createDataFrame(rows, "date string, `Close|USDJPY=X` string, ordinal long")
    assert _values(feeds.yahoo(frame, "usdjpy", "USDJPY=X")) == {("usdjpy", "2024-07-01"): 161.5, ("usdjpy", "2024-07-02"): 161.8}
    with pytest.raises(ValueError):
        feeds.yahoo(frame.limit(0), "usdjpy", "USDJPY=X")
    got = feeds.bars(spark, [SimpleNamespace(date=dt.date(2024, 7, 1), close=1.0), SimpleNamespace(date="2024-07-01", close=2.0)], "usdjpy")
    assert _values(got) == {("usdjpy", "2024-07-01"): 2.0}
    with pytest.raises(ValueError):
        feeds.bars(spark, [], "usdjpy")
    with pytest.raises(ValueError):
        feeds.fx(spark, parse(settings()), {}, "other")
    assert feeds.bar_duration(dt.date(2010, 1, 1), dt.date(2010, 2, 1)) == "1 Y"


def test_fetch_and_metadata(spark, tmp_path):
    (tmp_path / "f.csv").write_text("DATE,X\n2024-05-01,1\n2024-06-10,2\n2024-07-01,3\n2024-07-01,4\n")
    (tmp_path / "old").write_text("Date,2Y\n2024/7/1,0.1\n2024/7/2,0.2\n")
    (tmp_path / "new").write_text("Date,2Y\n2024/7/2,-\n")
    bars_ = spark.createDataFrame([("2024-07-01", "160", 0)], "date string, Close string, ordinal long")
    got = _values(feeds.fetch_all(spark, parse(settings()), {"fred": {"us2y": str(tmp_path / "f.csv")}, "mof": [str(tmp_path / "old"), str(tmp_path / "new")], "yahoo": bars_}))
    assert got == {("us2y", "2024-06-10"): 2.0, ("us2y", "2024-07-01"): 4.0, ("jgb2y", "2024-07-01"): 0.1, ("jgb2y", "2024-07-02"): None, ("usdjpy", "2024-07-01"): 160.0}
    config, obs = parse(settings()), observed(spark)
    a = align.align(spark, obs, config, SERIES)
    document = provenance.metadata(obs, a, config)
    provenance.save(a, document, str(tmp_path / "out"))
    daily, read = provenance.load_daily(spark, str(tmp_path / "out"))
    assert daily.count() == read["row_count"] == 14 and read["dropped_dates"] == [{"date": "2024-07-04", "columns": ["us10y", "us2y"], "reasons": ["missing_on_snapshot_date"]}]

    # published in one job: the same document and table, and the observations are read once
    obs.write.parquet(str(tmp_path / "obs"))
    stored = spark.read.parquet(str(tmp_path / "obs"))
    for convention in ("ny_close", "tokyo_close"):
        config = parse(settings(convention))
        a = align.align(spark, stored, config, SERIES)
        want = json.loads(json.dumps(provenance.metadata(stored, a, config), default=str))
        once = provenance.publish(spark, stored, config, SERIES, str(tmp_path / convention))
        daily, read = provenance.load_daily(spark, str(tmp_path / convention))
        assert read == want == json.loads(json.dumps(once, default=str)) and sorted(map(tuple, daily.collect())) == sorted(map(tuple, a.daily.collect()))
        fresh = align.align(spark, stored, config, SERIES)
        for frame in (fresh.daily, align.report_rows(fresh), fresh.carries):
            assert frame._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1


def test_stream(spark, tmp_path):
    rules = spark.createDataFrame([("a", "g", "us", 2, "none", True, False)], "series string, grp string, market string, max_lag int, shift string, required boolean, exact boolean")
    cal = spark.createDataFrame([(dt.date(2024, 7, d), 1) for d in (1, 2, 3, 4)], "date date, back int")
    spark.createDataFrame([("a", dt.date(2024, 7, 1), 5.0)], "series string, obs_date date, value double").write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema("series string, obs_date date, value double").parquet(str(tmp_path / "in"))
    follow(stream, str(tmp_path / "store"), rules, cal, lambda df, i: out.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r["date"].day, r["value"]) for r in out) == [(1, 5.0), (2, 5.0), (3, 5.0)]
    # a later batch gives the days that it can change, from all that is stored
    out.clear()
    more = [("a", dt.date(2024, 7, 3), 7.0), ("b", dt.date(2024, 7, 1), 1.0), ("a", None, 2.0)]
    spark.createDataFrame(more, "series string, obs_date date, value double").write.mode("append").parquet(str(tmp_path / "in"))
    follow(stream, str(tmp_path / "store"), rules, cal, lambda df, i: out.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r["date"].day, r["value"]) for r in out) == [(3, 7.0), (4, 7.0)]


def test_statistics(spark):
    rng = np.random.default_rng(5)
    x = [0.0]
    for _ in range(999):
        x.append(x[-1] * 0.9 + rng.normal())
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, i int, v double")
    r = stats.half_life(df, "v", ["k"], ["i"]).first()
    d, b = np.diff(x), np.array(x[:-1])
    assert r["kappa"] == pytest.approx(np.polyfit(b, d, 1)[0]) and 4 < r["half_life"] < 10 and r["half_life"] == pytest.approx(-math.log(2) / r["kappa"])
    assert models.dickey_fuller(df, "v", ["k"], ["i"]).first()["statistic"] < -5
    z = [(r["i"], r["z"]) for r in stats.rolling_zscore(df, "v", ["k"], ["i"], 60).orderBy("i").collect()]
    assert z[59][1] is None and z[100][1] == pytest.approx((x[100] - np.mean(x[40:100])) / np.std(x[40:100], ddof=1))
    poisoned = df.withColumn("v", F.when(F.col("i") == 101, 1e9).otherwise(F.col("v")))
    assert stats.rolling_zscore(poisoned, "v", ["k"], ["i"], 60).filter("i = 100").first()["z"] == pytest.approx(z[100][1])


def test_signals(spark):
    path = [None, 1.0, 2.5, 1.0, 0.2, -2.2, -3.6, -2.5, -0.1, -2.0, -1.0, -1.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(path)], "k string, i int, z double")
    got = [(r["position"], r["reason"]) for r in trading.signal_states(df, "z", ["k"], ["i"], most_rows=2).orderBy("i").collect()]
    assert got == [(0, None), (0, None), (-1, "enter"), (-1, None), (0, "exit"), (1, "enter"), (0, "stop"), (0, None), (0, None), (1, "enter"), (1, None), (0, "time")]
