"""The daily signal run as a stream with keyed state.

Each key's state is its position, the rows it is held, whether it is barred, and the last row taken. A batch carries it on by the rule of
`signal_states`, so any split of the rows into batches, runs and restarts gives what one fold over all of them gives. The history is a folder
that is only appended to; a run without new rows, or one that is repeated after a failure, leaves it as it is.

Defined results: rows up to the last one taken of their key are late and are left out, as are rows without an order; a null z-score
leaves a position as it is, but for the rows held; rows of a batch that tie in order are taken by their z-score, null last; a batch
without rows does nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.trading import Rules, signal_documents, step


def signal_stream(rows: DataFrame, z: str, key: list[str], order: str, rules: Rules | None = None) -> DataFrame:
    """(key, order, z, position, reason) of a stream of rows; `order` is a date, time, number or string."""
    rules = rules or Rules()
    own = rows.filter(F.col(order).isNotNull()).select(*key, order, F.col(z).cast("double").alias("z"))
    kind = own.schema[order].dataType
    out = T.StructType([*own.schema.fields, T.StructField("position", T.IntegerType()), T.StructField("reason", T.StringType())])
    state_type = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("held", T.LongType()), T.StructField("barred", T.BooleanType()), T.StructField("last", kind)])
    moment = isinstance(kind, (T.TimestampType, T.TimestampNTZType))

    def run(own_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(parts), ignore_index=True).sort_values([order, "z"])
        position, held, barred, last = state.get if state.exists else (0, 0, False, None)
        fresh = group if last is None else group[group[order] > (pd.Timestamp(last) if moment else last)]
        found = []
        for value in fresh["z"].tolist():
            position, held, barred, reason = step(position, held, barred, value, rules)
            found.append((position, reason))
        if found:
            at = fresh[order].iloc[-1]
            at = at.to_pydatetime() if moment else at.item() if hasattr(at, "item") else at
            state.update((int(position), int(held), bool(barred), at))
            yield fresh[[*key, order, "z"]].assign(position=[p for p, _ in found], reason=[r for _, r in found])

    return own.groupBy(*key).applyInPandasWithState(run, out, state_type, "append", GroupStateTimeout.NoTimeout)


def run_signals(rows: DataFrame, z: str, key: list[str], order: str, folder: str, rules: Rules | None = None) -> None:
    """Take all rows that the stream has and that no run before has taken, and append them to the history in `folder`."""
    found = signal_stream(rows, z, key, order, rules)
    run = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/history")
    run.awaitTermination()


def history(spark: SparkSession, folder: str) -> DataFrame:
    """All signals so far: the files that finished runs have committed."""
    return spark.read.parquet(f"{folder}/history")


def latest(signals: DataFrame, key: list[str], order: str, inputs: DataFrame, lags: dict[str, int], failed: Column, figures: list[str]) -> DataFrame:
    """(key, order, state, action, document) of the last signal of each key, guarded by the columns of `inputs` (key, order, ages and what `failed` reads)."""
    return signal_documents(signals.join(inputs, [*key, order], "left"), key, order, lags, failed, figures)


def failed_runs(df: DataFrame, rejects: str, key: list[str], order: str, n: int) -> DataFrame:
    """df with regime_failed: whether the last n rows up to this one all fail to reject (a null is a failure), as the guard of a regime asks."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(1 - n, 0)
    bad = F.when(F.coalesce(F.col(rejects), F.lit(False)), 0).otherwise(1)
    return df.withColumn("regime_failed", F.sum(bad).over(w) >= n)
