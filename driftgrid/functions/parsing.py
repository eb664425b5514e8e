"""Tolerant parsing of cells (B1, B4-B6, B8, the NaN contract): null marks what is missing, never NaN.

Defined results: null and empty cells, marks for missing values and junk are null; cells are read one by one, so repeated rows, ties and empty
tables have no say; long cells are junk; only `strict_date` takes junk for an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that count as missing, fixed values.
MISSING = ["", ".", "-", "NA", "N/A", "n/a", "ND", "NaN", "nan", "null", "NULL", "None", "#N/A", "<NA>"]


def number(cell: Column) -> Column:
    """A double, or null for missing marks, junk and NaN; infinities stay, for bounds to find."""
    text = F.trim(cell)
    value = F.when(~text.isin(MISSING), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def loose_date(cell: Column) -> Column:
    """A date of y/M/d or y-M-d; junk is null."""
    text = F.trim(cell)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(form)).cast("date") for form in ("yyyy/M/d", "yyyy-M-d")])


def strict_date(cell: Column) -> Column:
    """A date of yyyy-MM-dd; junk is an error."""
    return F.to_date(F.trim(cell), "yyyy-MM-dd")


def wall_date(stamp: Column) -> Column:
    """The local day that a time stamp shows; a zone at its end is cut off, not converted."""
    return F.to_date(F.substring(F.trim(stamp.cast("string")), 1, 10), "yyyy-MM-dd")
