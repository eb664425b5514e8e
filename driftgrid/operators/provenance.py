"""Metadata of a run and its sinks.

Defined results: null values are left out of a series' range; a series without values, and a table without rows, give no range
and no row of it; repeated rows count each; ties do not matter, as only counts, least and greatest days are kept; saving replaces what was
there. The daily table has a row a day and is saved as one file in the order of its days.
"""

from __future__ import annotations

import json
import subprocess
from dataclasses import asdict

import pyspark
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..config import Config
from .align import Aligned, align, report_of

SCHEMA_VERSION = "1.0"
NOTES = {
    "ny_close": ["Every column is read on the New York day of the row.", "JGB yields of the same date were fixed hours before New York closes, so they look back and never ahead."],
    "tokyo_close": ["JGB yields are those of the row's Tokyo day.", "FX and US columns are those of the last weekday before it, which Tokyo knew."],
}


def source_ranges(observations: DataFrame) -> DataFrame:
    """(series, n_rows, first, last) of the observed values, warm-up included."""
    return observations.filter("value is not null").groupBy("series").agg(F.count("*").alias("n_rows"), F.min("obs_date").alias("first"), F.max("obs_date").alias("last"))


def git_revision(root: str = ".") -> str | None:
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def _document(found: dict, ranges: list[dict], columns: list[str], config: Config, files: DataFrame | None) -> dict:
    return {
        "schema_version": SCHEMA_VERSION,
        "versions": {"spark": pyspark.__version__, "revision": git_revision()},
        "convention": config.alignment.convention,
        "row_count": found["rows_out"],
        "range": [str(found["first"]), str(found["last"])] if found["rows_out"] else None,
        "columns": columns,
        "notes": NOTES[config.alignment.convention],
        "sources": [r.asDict() for r in files.collect()] if files is not None else [],
        "series": ranges,
        "alignment": report_of(found),
        "dropped_dates": [{"date": d["date"], "columns": sorted(m["column"] for m in d["missing"]), "reasons": sorted({m["reason"] for m in d["missing"]})} for d in found["dropped_dates"]],
        "config": asdict(config),
    }


def metadata(observations: DataFrame, aligned: Aligned, config: Config, files: DataFrame | None = None) -> dict:
    """One document for a run, by one aggregation over its days and one over its observations."""
    found = aligned.days.agg(*[c.alias(k) for k, c in aligned.metrics.items()]).first().asDict()
    ranges = [r.asDict() for r in source_ranges(observations).orderBy("series").collect()]
    return _document(found, ranges, aligned.daily.columns, config, files)


def _save_daily(daily: DataFrame, folder: str) -> None:
    daily.coalesce(1).sortWithinPartitions("date").write.mode("overwrite").parquet(f"{folder}/daily.parquet")


def _save_document(spark: SparkSession, document: dict, folder: str) -> None:
    text = json.dumps(document, indent=2, default=str)
    spark.createDataFrame([(line,) for line in text.splitlines()], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata.json")


def save(aligned: Aligned, document: dict, folder: str) -> None:
    """daily.parquet, one file in date order, and metadata.json beside it."""
    _save_daily(aligned.daily, folder)
    _save_document(aligned.daily.sparkSession, document, folder)


def publish(spark: SparkSession, observations: DataFrame, config: Config, series: list[str], folder: str, files: DataFrame | None = None) -> dict:
    """Align and save in one job that reads the observations once; its document is filled by what is observed on the way."""
    seen = Observation("ranges")
    known = F.col("value").isNotNull()
    each = {name: known & (F.col("series") == name) for name in series}
    ranges = [c.alias(f"{k}|{name}") for name, own in each.items() for k, c in (("n_rows", F.count_if(own)), ("first", F.min(F.when(own, F.col("obs_date")))), ("last", F.max(F.when(own, F.col("obs_date")))))]
    aligned = align(spark, observations.observe(seen, *ranges), config, series, Observation("report"))
    _save_daily(aligned.daily, folder)
    spans = [{"series": name, **{k: seen.get[f"{k}|{name}"] for k in ("n_rows", "first", "last")}} for name in sorted(series) if seen.get[f"n_rows|{name}"]]
    document = _document(aligned.observed.get, spans, aligned.daily.columns, config, files)
    _save_document(spark, document, folder)
    return document


def load_daily(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    lines = spark.read.option("wholetext", True).text(f"{folder}/metadata.json").collect()
    return spark.read.parquet(f"{folder}/daily.parquet"), json.loads("".join(r["value"] for r in lines))


def write_text(text: str, path: str) -> None:
    store.write(path, text.encode())
