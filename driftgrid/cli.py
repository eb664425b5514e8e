"""Commands: fetch lands the feeds and builds the daily table, validate checks it.

    python -m driftgrid.cli fetch [--config configs/default.yaml] [--root .] [--fx-provider yahoo]
    python -m driftgrid.cli validate [--config configs/default.yaml] [--root .]

`validate` writes its report and ends with 1 if there is an error, else 0.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import store
from .config import Config, load
from .operators import provenance, validate
from .sources import feeds, landing

REPORT = "validation.md"


def fetch(spark: SparkSession, config: Config, provider: str | None = None, **fetchers) -> dict:
    """Land, align and save; the metadata document."""
    landed, records = landing.land_all(spark, config, provider, **fetchers)
    observations = feeds.fetch_all(spark, config, landed, provider)
    series = sorted({*config.sources.fred.series, *config.sources.mof.tenors, "usdjpy"})
    return provenance.publish(spark, observations, config, series, str(config.folder("processed")), records)


def check(spark: SparkSession, config: Config) -> tuple[str, bool]:
    """The report on the saved table, and whether it has no error."""
    daily, document = provenance.load_daily(spark, str(config.folder("processed")))
    found = validate.validate(daily, config, document)
    return validate.markdown(found), found.ok


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **fetchers) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["fetch", "validate"])
    parser.add_argument("--config")
    parser.add_argument("--root")
    parser.add_argument("--fx-provider", choices=["yahoo", "ibkr"])
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("driftgrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = load(args.config, args.root)  # a root by URI is read through the session
    if args.command == "fetch":
        document = fetch(spark, config, args.fx_provider, **fetchers)
        print(f"{document['row_count']} rows, {document['range']}, {document['convention']}, {document['alignment']['rows_dropped']} days dropped")
        return 0
    text, ok = check(spark, config)
    provenance.write_text(text, store.join(config.folder("reports"), REPORT))
    print(text)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
