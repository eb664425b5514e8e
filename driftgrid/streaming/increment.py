"""Daily increments as a stream: new observations re-align only the days that they can change.

Only those days are looked up, and of the store only the part that they can read: its files are filtered by date.

Defined results: a batch without rows, or with rows that no calendar day can read, gives an empty table; rows of later batches win over
earlier ones of the same day; null series, days or values are no observation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.align import looked_up, targets_of


def touched_targets(batch: DataFrame, rules: DataFrame, calendar: DataFrame) -> DataFrame:
    """The targets whose look-up can read an observation of this batch."""
    reach = batch.filter("obs_date is not null").select("series", "obs_date").distinct().join(rules.select("series", "max_lag"), "series")
    spread = reach.select("series", F.explode(F.sequence("obs_date", F.date_add("obs_date", F.col("max_lag")))).alias("target"))
    # only series of the batch are multiplied by the calendar
    own = rules.join(reach.select("series").distinct(), "series", "left_semi")
    return targets_of(own, calendar).join(spread.distinct(), ["series", "target"], "left_semi")


def follow(stream: DataFrame, store: str, rules: DataFrame, calendar: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Append each batch of (series, obs_date, value) to the store, then give the sink the re-aligned rows.

    A batch that is run again overwrites its own part of the store, so results are the same after a failure.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        targets = touched_targets(spark.read.parquet(f"{store}/batch={batch_id}"), rules, calendar)
        first, last, most = targets.join(rules.select("series", "max_lag"), "series").agg(F.min("target"), F.max("target"), F.max("max_lag")).first()
        held = spark.read.parquet(store).filter(F.col("batch") <= batch_id).withColumnRenamed("batch", "ordinal")
        if first is not None:
            held = held.filter(F.col("obs_date").between(first - dt.timedelta(days=most), last))
        sink(looked_up(targets, held, rules, most), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
