"""Landing of feeds: fetched, kept unmodified, hashed, and then read by Spark.

A run needs a handful of small files, so the driver lands them; `http_feed` in feeds.py reads many addresses on
the executors. Every fetcher is an argument, so tests and other transports give their own.

Files go through Hadoop's file systems, so driver and executors see the same ones on a cluster.

Defined results: what was landed before is overwritten once all feeds of a landing are there; a failed fetch is an error, but for the current year's yields, without
which the history alone is read, with a warning; an empty feed is an error of its reader.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import uuid
import warnings
from collections.abc import Callable
from pathlib import Path
from typing import Any, NamedTuple
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..config import WARM_UP_DAYS, Config
from .feeds import bar_duration, raw_files

API_URL = "https://api.stlouisfed.org/fred/series/observations"
RECORDS = "source string, url string, path string, downloaded_at string, sha256 string, bytes long"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, deleted when the driver ends."""
    path = store.join(store.shared_dir(spark), "driftgrid-feeds", uuid.uuid4().hex)
    store.delete_at_exit(spark, path)
    return path


class Landed(NamedTuple):
    """Where a raw file came from and what it holds (K1)."""

    source: str
    url: str
    path: str
    downloaded_at: str
    sha256: str
    bytes: int


def http_get(url: str, timeout: float = 60.0) -> bytes:
    """The body of a page; a status other than 200 is an OSError."""
    with urlopen(Request(url, headers={"User-Agent": "driftgrid"}), timeout=timeout) as answer:
        if getattr(answer, "status", 200) not in (200, None):
            raise OSError(f"{url}: status {answer.status}")
        return answer.read()


class Archive:
    """Raw files under a root, which may be a URI of any file system that Hadoop knows.

    A body is kept twice: under its hash in `objects`, which never changes, and under its name, where readers and people look. What is put is
    only staged in `objects`; `commit` then renames the named files into place, one step each, and writes the next manifest. So a landing
    that fails before it leaves all of the former one, and `restore` brings back the named files of the last manifest at any time.
    """

    def __init__(self, root: str | Path) -> None:
        self.root = str(root)
        self.staged: dict[str, Landed] = {}

    def put(self, source: str, url: str, body: bytes, *name: str) -> Landed:
        digest, path = hashlib.sha256(body).hexdigest(), store.join(self.root, *name)
        held = self._object(digest)
        if not store.exists(held):
            store.write(held, body)
        self.staged[path] = Landed(source, url, path, dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), digest, len(body))
        return self.staged[path]

    def _object(self, digest: str) -> str:
        return store.join(self.root, "objects", digest[:2], digest)

    def _publish(self, records: list[Landed]) -> None:
        for record in records:
            store.write(record.path, store.read(self._object(record.sha256)))

    def commit(self) -> list[Landed]:
        """Publish what was put, and write it down as the next manifest."""
        records = list(self.staged.values())
        self._publish(records)
        number = max((int(name.split(".")[0]) for name in store.names(store.join(self.root, "manifests"))), default=0) + 1
        store.write(store.join(self.root, "manifests", f"{number:08d}.json"), json.dumps([r._asdict() for r in records], indent=2).encode())
        self.staged = {}
        return records

    def manifest(self) -> list[Landed]:
        """The records of the last landing that was committed; none before the first."""
        found = sorted(store.names(store.join(self.root, "manifests")))
        return [Landed(**r) for r in json.loads(store.read(store.join(self.root, "manifests", found[-1])))] if found else []

    def restore(self) -> list[Landed]:
        """Put the named files of the last manifest back."""
        records = self.manifest()
        self._publish(records)
        return records


def _archive(config: Config, archive: Archive | None) -> tuple[Archive, Callable[[Any], Any]]:
    """The archive to put into, and what to do at the end: commit, unless the caller does."""
    own = archive or Archive(config.folder("raw"))
    return own, (lambda found: found) if archive else (lambda found: (own.commit(), found)[1])


def land_fred(config: Config, code: str, start: dt.date, get: Callable[[str], bytes] = http_get, archive: Archive | None = None) -> Landed:
    """One series: by the interface if its key is in the environment, as a CSV of its observations; else the open CSV."""
    fred = config.sources.fred
    (into, done), name = _archive(config, archive), ("fred", f"{code}.csv")
    key = os.environ.get(fred.api_key_env)
    if not key:
        url = fred.csv_url_template.format(series=code)
        return done(into.put(f"fred:{code}", url, get(url), *name))
    query = {"series_id": code, "observation_start": start.isoformat(), "file_type": "json"}
    found = json.loads(get(f"{API_URL}?{urlencode(query | {'api_key': key})}"))["observations"]
    body = "".join(f"{d},{v}\n" for d, v in [("DATE", code), *sorted((o["date"], o["value"]) for o in found)])
    return done(into.put(f"fred:{code}", f"{API_URL}?{urlencode(query)}", body.encode(), *name))  # no key in the record


def land_mof(config: Config, get: Callable[[str], bytes] = http_get, archive: Archive | None = None) -> list[Landed]:
    """The history and, if it can be had, the current year, which wins where both have a day."""
    mof = config.sources.mof
    into, done = _archive(config, archive)
    out = []
    for label, url in (("mof:all", mof.all_history_url), ("mof:current", mof.current_year_url)):
        try:
            out.append(into.put(label, url, get(url), "mof", url.rsplit("/", 1)[-1]))
        except OSError as why:
            if label == "mof:all":
                raise
            warnings.warn(f"the current year's yields can't be had ({why}); the history is used alone", stacklevel=2)
    return done(out)


def yahoo_download(ticker: str, first: str, behind: str | None) -> Any:
    """Bars of the days from `first` to before `behind`, as a pandas frame."""
    from yfinance import Ticker

    return Ticker(ticker).history(start=first, end=behind, auto_adjust=False)


def land_yahoo(spark: SparkSession, config: Config, start: dt.date, end: dt.date | None, download: Callable | None = None, archive: Archive | None = None) -> tuple[DataFrame, Landed]:
    """Bars, archived before anything is made of them, as the reader `yahoo` takes them; `download` is called with the ticker, the first and the last day."""
    fx = config.sources.fx
    into, done = _archive(config, archive)
    if download is None:
        frame = yahoo_download(fx.yahoo_ticker, start.isoformat(), (end + dt.timedelta(days=1)).isoformat() if end else None)
    else:
        frame = download(fx.yahoo_ticker, start, end)
    if frame is None or frame.empty:
        raise ValueError(f"{fx.yahoo_ticker}: the feed is empty")
    record = done(into.put(f"yahoo:{fx.yahoo_ticker}", f"yahoo://{fx.yahoo_ticker}", frame.to_csv().encode(), "yahoo", f"{fx.yahoo_ticker.replace('=', '_')}.csv"))
    flat = frame.copy()
    flat.columns = ["|".join(map(str, c)) if isinstance(c, tuple) else str(c) for c in frame.columns]
    names = list(flat.columns)
    rows = [(str(at), *(None if v != v else str(v) for v in values), i) for i, (at, values) in enumerate(zip(flat.index, flat.itertuples(index=False), strict=True))]
    return spark.createDataFrame(rows, ", ".join(["date string", *(f"`{n}` string" for n in names), "ordinal long"])), record


def land_bars(config: Config, start: dt.date, end: dt.date, request: Callable[[dict], list], archive: Archive | None = None) -> tuple[list, Landed]:
    """Broker bars from start to end by a read-only request; a live account is refused."""
    broker = config.sources.ibkr
    if broker.live_account_confirmed:
        raise PermissionError("a live account is not used for reading prices")
    asked = {"symbol": broker.spot.symbol, "currency": broker.spot.currency, "exchange": broker.spot.exchange, "what_to_show": broker.spot.what_to_show, "bar_size": broker.bar_size, "use_rth": broker.use_rth, "duration": bar_duration(start, end), "readonly": True}
    found = [b for b in request(asked) if str(start) <= str(b.date)[:10] <= str(end)]
    body = "".join(f"{d},{c}\n" for d, c in [("date", "close"), *((str(b.date)[:10], "" if b.close is None else b.close) for b in found)])
    into, done = _archive(config, archive)
    return found, done(into.put(f"ibkr:{broker.spot.symbol}.{broker.spot.currency}", f"ibkr://{broker.spot.symbol}{broker.spot.currency}", body.encode(), "ibkr", f"{broker.spot.symbol}{broker.spot.currency}.csv"))


def land_all(spark: SparkSession, config: Config, provider: str | None = None, get: Callable[[str], bytes] = http_get, download: Callable | None = None, request: Callable[[dict], list] | None = None) -> tuple[dict, DataFrame]:
    """What `fetch_all` reads, from WARM_UP_DAYS before the start on, and the records of all raw files: one landing, committed once every feed is there."""
    archive = Archive(config.folder("raw"))
    start = config.project.start_date - dt.timedelta(days=WARM_UP_DAYS)
    rates = {series: land_fred(config, code, start, get, archive) for series, code in config.sources.fred.series.items()}
    bonds = land_mof(config, get, archive)
    landed: dict = {"fred": {series: r.path for series, r in rates.items()}, "mof": [r.path for r in bonds]}
    name = provider or config.sources.fx.provider
    if name == "yahoo":
        landed["yahoo"], price = land_yahoo(spark, config, start, config.project.end_date, download, archive)
    elif name == "ibkr":
        if request is None:
            raise ValueError("a request function is needed to read from a broker")
        landed["ibkr"], price = land_bars(config, start, config.project.end, request, archive)
    else:
        raise ValueError(f"unknown provider {name}")
    archive.commit()
    return landed, spark.createDataFrame([*rates.values(), *bonds, price], RECORDS)


def changed(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Records whose file no longer has the bytes that were landed (K1)."""
    paths = [r["path"] for r in records.select("path").collect()]
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    now = raw_files(spark, paths).select(bare("path").alias("_at"), F.col("sha256").alias("now"))
    return records.join(now, bare(records["path"]) == now["_at"], "left").filter("now is null or now <> sha256").select(*records.columns)
