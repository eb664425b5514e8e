"""Landing, settings and commands, with fetchers that give files instead of a network."""

import datetime as dt
import hashlib
import json
from types import SimpleNamespace

import pandas as pd
import pytest

from driftgrid import cli, config
from driftgrid.sources import feeds, landing

SETTINGS = """
project: {name: daily, start_date: "2024-07-01", end_date: "2024-07-19"}
paths: {raw_dir: data/raw, processed_dir: data/processed, reports_dir: reports, signals_dir: signals}
sources:
  fred:
    api_key_env: DRIFTGRID_TEST_KEY
    csv_url_template: "http://fred/{series}"
    series: {us2y: DGS2, us10y: DGS10, us10y_real: DFII10}
    snapshot_note: "close"
  mof:
    all_history_url: "http://mof/all.csv"
    current_year_url: "http://mof/now.csv"
    encoding_candidates: ["utf-8", "cp932", "latin-1"]
    tenors: {jgb2y: "2Y", jgb10y: "10Y"}
  fx: {provider: yahoo, yahoo_ticker: "USDJPY=X", yahoo_field: Close}
  ibkr:
    host_env: H
    port_env: P
    client_id_env: C
    spot: {symbol: USD, currency: JPY, exchange: IDEALPRO, what_to_show: MIDPOINT}
    futures: {symbol: JPY, exchange: CME}
    bar_size: "1 day"
    use_rth: false
    live_account_confirmed: false
alignment:
  convention: ny_close
  drop_if_missing: [usdjpy, us2y, us10y]
  asof_max_lag_days: {jgb2y: 7, jgb10y: 7, us10y_real: 4}
  weekmask: "Mon Tue Wed Thu Fri"
  publication_lag_days: 3
validation:
  bounds: {usdjpy: [70.0, 200.0], jgb10y: [-1.0, 10.0]}
  max_gap_business_days: 5
  min_rows: 5
  required_start_before: "2024-07-05"
  max_days_stale_end: 10
"""
DAYS = [dt.date(2024, 6, 24) + dt.timedelta(d) for d in range(26) if (dt.date(2024, 6, 24) + dt.timedelta(d)).weekday() < 5]


@pytest.fixture
def root(tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "default.yaml").write_text(SETTINGS, encoding="utf-8")
    return tmp_path


def get(url):
    if url.startswith("http://fred/"):
        return "".join(f"{d},{v}\n" for d, v in [("DATE", url[12:]), *((d, 4 + d.day / 100) for d in DAYS)]).encode()
    if "api_key" in url:
        return json.dumps({"observations": [{"date": str(d), "value": "." if d.day == 4 else str(4 + d.day / 100)} for d in reversed(DAYS)]}).encode()
    if url == "http://mof/all.csv":
        return ("Bonds\nDate,2Y,10Y\n" + "".join(f"{d.year}/{d.month}/{d.day},0.3,1.0\n" for d in DAYS[:-3])).encode()
    raise OSError("not there")


def download(ticker, start, end):
    assert (ticker, start, end) == ("USDJPY=X", dt.date(2024, 5, 31), dt.date(2024, 7, 19))
    return pd.DataFrame({("Open", ticker): 1.0, ("Close", ticker): [160 + d.day / 100 for d in DAYS]}, index=pd.DatetimeIndex(DAYS, tz="Europe/London"))


def test_settings(root, monkeypatch):
    found = config.load(root=root)
    assert found.root == str(root.resolve()) and found.folder("raw") == root.resolve() / "data/raw" and found.folder("signals") == root.resolve() / "signals"
    assert found.sources.ibkr.futures.exchange == "CME" and not found.sources.ibkr.live_account_confirmed
    monkeypatch.setenv("DRIFTGRID_ROOT", str(root))
    assert config.load().root == str(root.resolve()) and config.load("configs/default.yaml").alignment.convention == "ny_close"
    (root / "bad.yaml").write_text(SETTINGS + "root: /\n", encoding="utf-8")
    with pytest.raises(config.ConfigError):
        config.load("bad.yaml")
    with pytest.raises(FileNotFoundError):
        config.load("none.yaml")


def test_landing(spark, root, monkeypatch):
    settings = config.load(root=root)
    with pytest.warns(UserWarning, match="current year"):
        landed, records = landing.land_all(spark, settings, get=get, download=download)
    rows = {r["source"]: r for r in records.collect()}
    assert set(rows) == {"fred:DGS2", "fred:DGS10", "fred:DFII10", "mof:all", "yahoo:USDJPY=X"} and len(landed["mof"]) == 1
    assert rows["mof:all"]["sha256"] == hashlib.sha256(get("http://mof/all.csv")).hexdigest() and rows["mof:all"]["url"] == "http://mof/all.csv"
    assert (root / "data/raw/mof/all.csv").read_bytes() == get("http://mof/all.csv")  # as it came
    assert landing.changed(spark, records).count() == 0
    (root / "data/raw/mof/all.csv").write_text("other")
    assert [r["source"] for r in landing.changed(spark, records).collect()] == ["mof:all"]
    prices = {r["obs_date"]: r["value"] for r in feeds.fx(spark, settings, landed).collect()}
    assert prices[dt.date(2024, 7, 19)] == pytest.approx(160.19) and len(prices) == len(DAYS)
    monkeypatch.setenv("DRIFTGRID_TEST_KEY", "secret")
    record = landing.land_fred(settings, "DGS2", dt.date(2024, 6, 1), get)
    assert "secret" not in record.url and (root / "data/raw/fred/DGS2.csv").read_text().startswith("DATE,DGS2\n2024-06-24,4.24\n")
    values = {r["obs_date"]: r["value"] for r in feeds.fred(spark, record.path, "us2y", code="DGS2").collect()}
    assert values[dt.date(2024, 7, 4)] is None and values[dt.date(2024, 7, 5)] == pytest.approx(4.05)
    with pytest.raises(OSError):
        landing.land_mof(settings, lambda url: get("nowhere"))
    with pytest.raises(ValueError):
        landing.land_yahoo(spark, settings, DAYS[0], None, lambda *_: pd.DataFrame())


def test_broker_bars(spark, root):
    settings = config.load(root=root)
    asked = []
    bars = [SimpleNamespace(date=d, close=160.0) for d in (dt.date(2020, 1, 1), *DAYS)]
    landed, _ = landing.land_all(spark, settings, "ibkr", get=lambda u: get(u) if "now" not in u else get("http://mof/all.csv"), request=lambda x: asked.append(x) or bars)
    assert asked[0]["readonly"] and asked[0]["duration"] == "1 Y" and len(landed["ibkr"]) == len(DAYS)
    assert feeds.fx(spark, settings, landed, "ibkr").count() == len(DAYS)
    with pytest.raises(ValueError):
        landing.land_all(spark, settings, "ibkr", get=lambda u: get("http://mof/all.csv") if "mof" in u else get(u))
    text = SETTINGS.replace("live_account_confirmed: false", "live_account_confirmed: true")
    (root / "live.yaml").write_text(text, encoding="utf-8")
    with pytest.raises(PermissionError):
        landing.land_bars(config.load("live.yaml", root), DAYS[0], DAYS[-1], lambda _: bars)


def test_commands(spark, root, capsys):
    with pytest.warns(UserWarning):
        assert cli.main(["fetch", "--root", str(root)], spark, get=get, download=download) == 0
    assert "15 rows" in capsys.readouterr().out
    assert cli.main(["validate", "--root", str(root)], spark) == 0
    assert "PASS" in (root / "reports" / cli.REPORT).read_text()
    strict = SETTINGS.replace("usdjpy: [70.0, 200.0]", "usdjpy: [70.0, 160.05]")
    (root / "strict.yaml").write_text(strict, encoding="utf-8")
    assert cli.main(["validate", "--root", str(root), "--config", "strict.yaml"], spark) == 1
    assert "FAIL" in (root / "reports" / cli.REPORT).read_text()


def test_http(tmp_path):
    (tmp_path / "a.txt").write_bytes(b"body")
    assert landing.http_get((tmp_path / "a.txt").as_uri()) == b"body"
    with pytest.raises(OSError):
        landing.http_get((tmp_path / "none").as_uri())


def test_http_feed(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    spark.dataSource.register(feeds.HttpFeed)
    urls = ",".join((tmp_path / n).as_uri() for n in ("a.txt", "b.txt"))
    assert sorted(bytes(r["content"]) for r in spark.read.format("http_feed").option("urls", urls).load().collect()) == [b"one", b"two"]


def test_root_by_uri(spark, root, monkeypatch):
    """The whole run with a file: URI as the root; a failed landing leaves the former one whole."""
    uri = root.as_uri()
    settings = config.load(root=uri)
    assert settings.folder("raw") == f"{uri}/data/raw" and config.resolve_root("s3://bucket/x/") == "s3://bucket/x"
    whole = lambda u: get(u) if "now" not in u else get("http://mof/all.csv")
    assert cli.main(["fetch", "--root", uri], spark, get=whole, download=download) == 0 and cli.main(["validate", "--root", uri], spark) == 0
    assert (root / "reports" / cli.REPORT).exists() and (root / "data/processed/daily.parquet").is_dir()
    archive = landing.Archive(settings.folder("raw"))
    first = archive.manifest()
    assert len(first) == 6 and all(r.path.startswith(uri) for r in first) and len(list((root / "data/raw/manifests").iterdir())) == 1
    changed = {"n": 0}

    def failing(url):
        changed["n"] += 1
        if "mof" in url:
            raise OSError("down")
        return get(url).replace(b"4.", b"5.")

    with pytest.raises(OSError):
        landing.land_all(spark, settings, get=failing, download=download)
    assert changed["n"] == 4 and archive.manifest() == first  # three series had been fetched
    assert (root / "data/raw/fred/DGS2.csv").read_bytes() == get("http://fred/DGS2")
    records = spark.createDataFrame(first, landing.RECORDS)
    assert landing.changed(spark, records).count() == 0
    (root / "data/raw/fred/DGS2.csv").write_text("broken")
    assert [r["source"] for r in landing.changed(spark, records).collect()] == ["fred:DGS2"]
    archive.restore()
    assert landing.changed(spark, records).count() == 0
    # the same bytes are held once, a second landing is a second manifest
    objects = sorted(p.name for p in (root / "data/raw/objects").glob("*/*"))
    landing.land_all(spark, settings, get=whole, download=download)
    assert sorted(p.name for p in (root / "data/raw/objects").glob("*/*")) == objects and len(list((root / "data/raw/manifests").iterdir())) == 2
    assert not [p for p in root.rglob(".*") if p.suffix != ".crc" and "raw" in p.parts]
    with pytest.raises(FileNotFoundError):
        config.load("none.yaml", uri)
