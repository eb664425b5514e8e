"""Readers of landed feeds: each gives observations (series, obs_date, value, ordinal).

Files are landed unmodified and read in place, so a run can be repeated from its archive. `ordinal` is the
place in the file, which keep-last rules need. Live fetching is a Python data source whose partitions are
URLs, read on executors; the fetcher is an option, so tests give their own.

Defined results: an empty feed, a missing header, column or tenor is a ValueError; unreadable numbers are null; unreadable dates
are an error in the FRED reader and dropped in the MoF reader; repeated dates are kept here and resolved by `keep_last`.
"""

from __future__ import annotations

import contextlib
import csv
import datetime as dt
import re
import warnings
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import store
from ..config import WARM_UP_DAYS, Config
from ..functions import digest
from ..functions.parsing import loose_date, number, strict_date, wall_date

OBSERVATIONS = "series string, obs_date date, value double, ordinal long"
#: Bytes of the largest file that one task reads whole for its hash, and of the splits of longer ones.
WHOLE, SPLIT = 64 << 20, 128 << 20
BOM = b"\xef\xbb\xbf"


def raw_files(spark: SparkSession, path: str | list[str], source: str = "file", whole: int = WHOLE, split: int = SPLIT) -> DataFrame:
    """Provenance of landed files: (source, path, landed_at, sha256, bytes); contents are hashed in place.

    Files of more than `whole` bytes are hashed split by split while the frame is built, by jobs with a task for each such file. A file whose
    name ends like a packed one (`.gz`) is a single split; a stretch without a newline is in a task's memory at once.
    """
    files = spark.read.format("binaryFile").load(path)
    short, long = files.filter(F.col("length") <= whole), files.filter(F.col("length") > whole).drop("content")
    out = short.withColumn("sha256", F.sha2("content", 256)).drop("content")
    if lengths := {r["path"]: r["length"] for r in long.select("path", "length").collect()}:
        hashes = spark.createDataFrame(list(_long_hashes(spark, lengths, split).items()), "path string, sha256 string")
        out = out.unionByName(long.join(F.broadcast(hashes), "path"))
    return out.select(F.lit(source).alias("source"), "path", F.col("modificationTime").alias("landed_at"), "sha256", F.col("length").alias("bytes"))


class _Hashed(NamedTuple):
    """How far a file is hashed: the state, whether a line has begun, and where the last split with lines starts."""

    words: tuple[int, ...]
    tail: bytes
    n: int
    begun: bool = False
    at: int = -1


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a job is planned."""
    held = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _split_hashes(spark: SparkSession, path: str, before: _Hashed) -> RDD:
    """What `before` becomes in each split of a file, if that is the one behind it; a job runs one of them.

    Spark's lines keep their bytes, whatever these are, but for the newline behind each; it is hashed before the next.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun, at = digest.State(*before[:3]), before.begun, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None and (at := batch.column(1)[0].as_py()) <= before.at:
                raise ValueError(f"{path}: the split at {at} comes after the one at {before.at}")
            lines = pa.LargeListArray.from_arrays(pa.array([0, batch.num_rows], pa.int64()), batch.column(0))
            state = digest.update(state, (b"\n" if begun else b"") + pc.binary_join(lines, b"\n")[0].as_py())
            begun = True
        row = _Hashed(*state, begun, before.at if at is None else at)
        yield pa.RecordBatch.from_pylist([row._asdict()], pa.schema({"words": pa.list_(pa.int64()), "tail": pa.binary(), "n": pa.int64(), "begun": pa.bool_(), "at": pa.int64()}))

    literal = re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
    lines = spark.read.options(**store.as_it_is(spark, path)).text(literal, lineSep="\n").select(F.col("value").cast("binary"), "_metadata.file_block_start")
    return lines.mapInArrow(hashed, "words array<long>, tail binary, n long, begun boolean, at long").rdd


def _long_hashes(spark: SparkSession, lengths: dict[str, int], split: int) -> dict[str, str]:
    """Hashes of whole files by path.

    A hash follows its file from front to back, so the state after a split is handed to the task of the next one: a job takes the k-th split of all files.
    """
    planned = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    marks = {path: store.head(spark, path, len(BOM)) for path in lengths}  # lines leave it out
    rest = {path: _Hashed(*digest.update(digest.State(), mark if mark == BOM else b"")) for path, mark in marks.items()}
    found, k = {}, 0
    while rest:
        with _settings(spark, planned):
            parts = {path: _split_hashes(spark, path, before) for path, before in rest.items()}
            counts = [part.getNumPartitions() for part in parts.values()]
        wanted = [behind + k for behind in accumulate(counts[:-1], initial=0)]
        rows = spark.sparkContext.runJob(spark.sparkContext.union(list(parts.values())), list, wanted)
        k += 1
        for path, row, count in zip(parts, rows, counts, strict=True):
            now = rest[path] = _Hashed(tuple(row["words"]), bytes(row["tail"]), row["n"], row["begun"], row["at"])
            if k == count:
                del rest[path]
                state = digest.State(*now[:3])
                state = digest.update(state, b"\n") if state.n == lengths[path] - 1 else state  # the last line's
                if state.n != lengths[path]:
                    raise ValueError(f"{path}: {state.n} of {lengths[path]} bytes were read")
                found[path] = digest.finish(state)
    return found


def _lines(files: DataFrame, encodings: tuple[str, ...]) -> DataFrame:
    """(path, ordinal, line) of whole small files, decoded by the first encoding that fits (B2)."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for name in encodings:
                    try:
                        text = bytes(content).decode(name)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError(f"{path}: none of {', '.join(encodings)} fits")
                rows += [(path, i, line) for i, line in enumerate(text.lstrip("﻿").splitlines())]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "line"])

    return files.select("path", "content").mapInPandas(decoded, "path string, ordinal long, line string")


def _cells(width: int) -> Column:
    """The first cells of a CSV line, quoted or not; null where the line has fewer."""
    row = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    return F.array(*[row[f"c{i}"] for i in range(width)])


def fred(spark: SparkSession, path: str, series: str, start: dt.date | None = None, code: str | None = None) -> DataFrame:
    """A two-column CSV by position; header names vary. Rows from `start` on, with no upper bound (A1, B1).

    A value column named other than `code` (the series if it is None) is a warning.
    """
    files = spark.read.format("binaryFile").load(path)
    rows = _lines(files, ("utf-8",)).filter("trim(line) <> ''").withColumn("cells", _cells(2))
    heads = [r["cells"][1] for r in rows.filter("ordinal = 0").select("cells").collect()]  # one for each file
    if not heads or any(h is None for h in heads):
        raise ValueError(f"{series}: a date and a value column are needed")
    if other := sorted({h.strip() for h in heads if h.strip().upper() != (code or series).upper()}):
        warnings.warn(f"{series}: the value column is {', '.join(other)}, not {code or series}", stacklevel=2)
    out = rows.filter("ordinal > 0").select(F.lit(series).alias("series"), strict_date(F.col("cells")[0]).alias("obs_date"), number(F.col("cells")[1]).alias("value"), "ordinal")
    return out.filter(F.col("obs_date") >= start) if start else out


def fred_all(spark: SparkSession, paths: dict[str, str], start: dt.date | None = None, codes: dict[str, str] | None = None) -> DataFrame:
    """All FRED series as one long table (A3); codes maps series to the names of their value columns."""
    frames = [fred(spark, path, series, start, (codes or {}).get(series)) for series, path in paths.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _mof_body(spark: SparkSession, path: str, encodings: tuple[str, ...]) -> tuple[list[str], DataFrame]:
    """The header's names and the lines below it, with their cells and dates."""
    rows = _lines(spark.read.format("binaryFile").load(path), encodings)
    head = rows.filter(F.lower(F.ltrim("line")).startswith("date")).orderBy("ordinal").select("ordinal", "line").first()
    if head is None:
        raise ValueError(f"{path}: no header line begins with Date")
    names = [c.strip().lstrip("﻿").upper() for c in next(csv.reader([head["line"]]))]
    body = rows.filter(F.col("ordinal") > head["ordinal"]).withColumn("cells", _cells(len(names)))
    return names, body.withColumn("obs_date", loose_date(F.col("cells")[0]))


def mof(spark: SparkSession, path: str, tenors: dict[str, str], encodings: tuple[str, ...] = ("utf-8", "cp932", "latin-1"), start: dt.date | None = None) -> DataFrame:
    """A yield table with titles above its header and footers below; tenors maps series to columns."""
    names, body = _mof_body(spark, path, encodings)
    missing = [t for t in tenors.values() if t.upper() not in names]
    if missing:
        raise ValueError(f"{path}: no tenor {', '.join(missing)}")
    values = [F.struct(F.lit(s).alias("series"), number(F.col("cells")[names.index(t.upper())]).alias("value")) for s, t in tenors.items()]
    out = body.filter("obs_date is not null").select("obs_date", "ordinal", F.explode(F.array(*values)).alias("v")).select("v.series", "obs_date", "v.value", "ordinal")
    return out.filter(F.col("obs_date") >= start) if start else out


def mof_rejects(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "cp932", "latin-1")) -> DataFrame:
    """(path, ordinal, line) of the lines below the header, blank ones aside, that `mof` leaves out since their dates can't be read."""
    _, body = _mof_body(spark, path, encodings)
    return body.filter("obs_date is null and trim(line) <> ''").select("path", "ordinal", "line")


def yahoo(frame: DataFrame, series: str, ticker: str, field: str = "Close") -> DataFrame:
    """Bars (date, then columns named FIELD or FIELD|TICKER, in file order by `ordinal`) as observations.

    The last of repeated dates wins before missing values go: a date whose last bar is missing is missing.
    """
    names = [c for c in frame.columns if c not in ("date", "ordinal")]
    chosen = next((c for c in (f"{field}|{ticker}", field) if c in names), next((c for c in names if c.split("|")[0] == field), None))
    if chosen is None:
        raise ValueError(f"{series}: no column {field}")
    if not frame.head(1):
        raise ValueError(f"{series}: the feed is empty")
    from ..operators.dedup import keep_last

    rows = frame.select(F.lit(series).alias("series"), wall_date(F.col("date")).alias("obs_date"), number(F.col(f"`{chosen}`").cast("string")).alias("value"), "ordinal")
    return keep_last(rows, ["series", "obs_date"], ["ordinal"]).filter("value is not null")


def bars(spark: SparkSession, rows: list, series: str) -> DataFrame:
    """Broker bars, objects with `date` and `close`, as observations; missing closes stay null."""
    if not rows:
        raise ValueError(f"{series}: no bars")
    found = [(series, str(r.date)[:10], None if r.close is None else str(r.close), i) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(found, "series string, d string, v string, ordinal long")
    from ..operators.dedup import keep_last

    return keep_last(frame.select("series", strict_date(F.col("d")).alias("obs_date"), number(F.col("v")).alias("value"), "ordinal"), ["series", "obs_date"], ["ordinal"])


def bar_duration(start: dt.date, end: dt.date) -> str:
    """How far back a broker is asked for bars: whole years, one at least."""
    return f"{max(1, (end - start).days // 365 + 1)} Y"


def fx(spark: SparkSession, config: Config, landed: dict, provider: str | None = None) -> DataFrame:
    """The FX feed of the provider given, else of the settings (A10); live broker access is refused."""
    name = provider or config.sources.fx.provider
    if name == "yahoo":
        return yahoo(landed["yahoo"], "usdjpy", config.sources.fx.yahoo_ticker, config.sources.fx.yahoo_field)
    if name == "ibkr":
        if config.sources.ibkr.live_account_confirmed:
            raise PermissionError("a live account is not used for reading prices")
        found = bars(spark, landed["ibkr"], "usdjpy")
        return found.filter(F.col("obs_date").between(config.project.start_date - dt.timedelta(days=WARM_UP_DAYS), config.project.end))
    raise ValueError(f"unknown provider {name}")


def fetch_all(spark: SparkSession, config: Config, landed: dict, provider: str | None = None) -> DataFrame:
    """All feeds from WARM_UP_DAYS before the start on, so that look-backs at the start resolve.

    landed: `fred` maps series to paths, `mof` lists the history file and the current year's, later ones winning;
    `yahoo` is a DataFrame of bars and `ibkr` a list of bars.
    """
    from ..operators.dedup import keep_last, priority_merge

    start = config.project.start_date - dt.timedelta(days=WARM_UP_DAYS)
    rates = keep_last(fred_all(spark, landed["fred"], start, config.sources.fred.series), ["series", "obs_date"], ["ordinal"])
    bonds = [mof(spark, p, config.sources.mof.tenors, config.sources.mof.encoding_candidates, start) for p in landed["mof"]]
    prices = fx(spark, config, landed, provider).filter(F.col("obs_date") >= start)
    parts = [rates, priority_merge(bonds, ["series", "obs_date"], ["ordinal"]), prices]
    out = parts[0].select("series", "obs_date", "value")
    for part in parts[1:]:
        out = out.unionByName(part.select("series", "obs_date", "value"))
    return out


class HttpFeed(DataSource):
    """`spark.read.format("http_feed")`: one partition for each URL, fetched on the executors.

    Options: urls (comma-separated), timeout in seconds, agent. A status other than 200 is an OSError.
    """

    @classmethod
    def name(cls) -> str:
        return "http_feed"

    def schema(self) -> str:
        return "url string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(dict(self.options))


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u.strip()) for u in self.options.get("urls", "").split(",") if u.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, bytes]]:
        from urllib.request import Request, urlopen

        request = Request(partition.value, headers={"User-Agent": self.options.get("agent", "driftgrid")})
        with urlopen(request, timeout=float(self.options.get("timeout", "30"))) as answer:
            if getattr(answer, "status", 200) not in (200, None):
                raise OSError(f"{partition.value}: status {answer.status}")
            yield partition.value, answer.read()
