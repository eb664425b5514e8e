"""Keep-last and priority rules (C1-C3). Both are aggregations, so repeated keys combine before the shuffle.

Defined results: null keys are a key of their own; of rows that tie in all ranks the greatest stays; an
empty table gives an empty one; all other columns travel with their row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: list[str], rank: list[str]) -> DataFrame:
    """The whole row with the greatest rank for each key; its missing values are not filled from others."""
    others = [c for c in df.columns if c not in {*key, *rank}]
    best = df.groupBy(*key).agg(F.max(F.struct(*rank, *others)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in [*rank, *others]]).select(df.columns)


def priority_merge(frames: list[DataFrame], key: list[str], rank: list[str]) -> DataFrame:
    """Rows of all frames; for one key, a later frame wins as a whole row."""
    out = None
    for i, frame in enumerate(frames):
        part = frame.withColumn("_priority", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return keep_last(out, key, ["_priority", *rank]).drop("_priority")
