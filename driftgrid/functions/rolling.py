"""Rolling figures from prefix sums: windows of any length, or of a length that differs by row.

Sums up to each row are taken once in a key; a window's sum is the difference of two of them, so the cost does not grow with the window. Values are
taken from the first of their key before they are squared, which no figure here depends on, and which keeps the sums small.

Defined results: a window that is not full, or that does not determine a fit, gives null; a row that ties in `order` is taken in any order;
repeated rows count each; an empty table gives an empty one. Rows with a null value are left out by `rolling_engle_granger`; in the
others they keep their place and are not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import COINTEGRATED, _critical


def _t_values(e: np.ndarray, lags: int, n: int) -> np.ndarray:
    """The t value of the level in the regression of the changes of a residual on it and on `lags` changes before, from the sums of products e[i, j] of the residual i and j rows back."""
    width = lags + 2
    # rows: the regressors, then the target, in residuals 0 .. lags + 1 rows back
    parts = np.zeros((lags + 2, width))
    parts[0, 1] = 1
    for k in range(1, lags + 1):
        parts[k, k], parts[k, k + 1] = 1, -1
    parts[-1, 0], parts[-1, 1] = 1, -1
    products = parts @ e @ parts.T
    xx, xy, yy = products[:, :-1, :-1], products[:, :-1, -1], products[:, -1, -1]
    scale = np.sqrt(np.einsum("nii->ni", xx))
    able = np.isfinite(products).all(axis=(1, 2)) & (scale > 0).all(axis=1)
    unit = np.where(able[:, None, None], xx / np.where(able[:, None, None], scale[:, :, None] * scale[:, None, :], 1.0), np.eye(lags + 1))
    able &= np.linalg.det(unit) > 1e-12
    unit[~able] = np.eye(lags + 1)
    inverse = np.linalg.inv(unit)
    safe = np.where(able[:, None], scale, 1.0)
    beta = (inverse @ (np.where(able[:, None], xy, 0.0) / safe)[:, :, None])[:, :, 0] / safe
    rest = yy - (beta * xy).sum(axis=1)
    able &= rest > 1e-12 * np.abs(yy)
    error = np.sqrt(np.where(able, rest, 1.0) / (n - lags - 1) * inverse[:, 0, 0]) / safe[:, 0]
    return np.where(able, beta[:, 0] / error, np.nan)


def _tested(batches: Iterator[pa.RecordBatch], lags: int, n: int, limit: float) -> Iterator[pa.RecordBatch]:
    """The last column, sums of products or null, as the statistic and whether it rejects."""
    for batch in batches:
        sums = batch.column(batch.num_columns - 1)
        some = np.flatnonzero(sums.is_valid().to_numpy(zero_copy_only=False))
        found = np.full(batch.num_rows, np.nan)
        if len(some):
            found[some] = _t_values(sums.drop_null().flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, lags + 2, lags + 2), lags, n)
        gone = np.isnan(found)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, mask=gone), pa.array(found < limit, mask=gone)], names=[*batch.schema.names[:-1], "statistic", "rejects"])


def rolling_engle_granger(df: DataFrame, y: str, x: str, key: list[str], order: list[str], rows: int = 500, lags: int = 1) -> DataFrame:
    """statistic of y on x over the `rows` rows up to each row, null before there are as many (M7); rejects if it is under the 5 % value.

    Line and residual regression of every window follow from sums of products of y and x up to lags + 1 rows apart.
    """
    n, back, m = rows - 1 - lags, lags + 2, len(key)
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    own = df.filter(known(y) & known(x)).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*key, *order])], F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    ks, os = [f"c{i}" for i in range(m)], [f"c{i + m}" for i in range(len(order))]
    w = Window.partitionBy(*ks).orderBy(*os)
    own = own.withColumns({"_y": F.col("_y") - F.first("_y").over(w), "_x": F.col("_x") - F.first("_x").over(w), "_i": F.row_number().over(w)})
    own = own.withColumns({f"{v}{i}": F.coalesce(F.lag(f"_{v}", i).over(w), F.lit(0.0)) for v in "yx" for i in range(back)})
    places = [(v, i) for v in "yx" for i in range(back)]
    products = {f"{a}{i}": F.col(f"{a}{i}") for a, i in places} | {f"{a}{i}{b}{j}": F.col(f"{a}{i}") * F.col(f"{b}{j}") for p, (a, i) in enumerate(places) for b, j in places[p:]}
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = own.select(*ks, *os, "_i", *[F.sum(c).over(upto).alias(f"s_{k}") for k, c in products.items()])
    ends = ["y0", "x0", "y0y0", "y0x0", "x0x0"]
    # a window of all rows gives the line, one of the rows that have lags + 1 rows of the window before them the residual's products
    spans = {f"d_{k}": F.col(f"s_{k}") - F.coalesce(F.lag(f"s_{k}", n).over(w), F.lit(0.0)) for k in products} | {f"w_{k}": F.col(f"s_{k}") - F.coalesce(F.lag(f"s_{k}", rows).over(w), F.lit(0.0)) for k in ends}
    sums = sums.select(*ks, *os, "_i", *[c.alias(k) for k, c in spans.items()])
    c = lambda name: F.col(name)
    spread = c("w_x0x0") - c("w_x0") * c("w_x0") / rows
    slope = F.when(spread > 1e-12 * c("w_x0x0"), (c("w_y0x0") - c("w_y0") * c("w_x0") / rows) / spread)
    sums = sums.withColumn("_s", slope).withColumn("_c", (c("w_y0") - F.col("_s") * c("w_x0")) / rows)
    s, k = F.col("_s"), F.col("_c")

    def product(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        cross = c(f"d_y{i}y{j}") - s * (c(f"d_y{i}x{j}") + c(f"d_y{j}x{i}")) + s * s * c(f"d_x{i}x{j}")
        return cross - k * (c(f"d_y{i}") + c(f"d_y{j}") - s * (c(f"d_x{i}") + c(f"d_x{j}"))) + k * k * n

    full = F.when((F.col("_i") >= rows) & s.isNotNull() & F.lit(n > lags + 3), F.array(*[product(i, j) for i in range(back) for j in range(back)]))
    asked = sums.select(*ks, *os, full.alias("e"))
    kinds = dict(df.dtypes)
    head = ", ".join(f"c{i} {kinds[name]}" for i, name in enumerate([*key, *order]))
    limit = _critical(COINTEGRATED, n)[1] if n > 0 else -math.inf
    found = asked.mapInArrow(lambda batches: _tested(batches, lags, n, limit), f"{head}, statistic double, rejects boolean")
    return found.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate([*key, *order])], "statistic", "rejects")


def rolling_half_life(df: DataFrame, value: str, key: list[str], order: list[str], rows: int = 250) -> DataFrame:
    """df with half_life from the changes of the `rows` rows before each row (its own left out); null unless the value reverts (M5)."""
    w = Window.partitionBy(*key).orderBy(*order)
    v = F.col(value).cast("double")
    own = df.withColumns({"_from": F.lag(v).over(w), "_first": F.first(v).over(w), "_k": F.row_number().over(w)}).withColumn("_change", v - F.col("_from"))
    pair = v.isNotNull() & F.col("_from").isNotNull()
    x, y = F.when(pair, F.col("_from") - F.col("_first")), F.when(pair, F.col("_change"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"_sn": F.count(x), "_sx": F.sum(x), "_sy": F.sum(y), "_sxx": F.sum(x * x), "_sxy": F.sum(x * y)}
    own = own.withColumns({k: F.coalesce(c.over(upto), F.lit(0)).cast("double") for k, c in sums.items()})
    # changes of the rows before: the first of them has the row before it as its level, which lies in the window too
    own = own.withColumns({f"{k}w": F.lag(k, 1).over(w) - F.coalesce(F.lag(k, rows).over(w), F.lit(0.0)) for k in sums})
    n, sx, sy, sxx, sxy = (F.col(f"{k}w") for k in sums)
    spread = sxx - sx * sx / F.nullif(n, F.lit(0.0))
    kappa = F.when((F.col("_k") > rows) & (spread > 1e-12 * sxx), (sxy - sx * sy / n) / spread)
    out = own.withColumn("half_life", F.when(kappa < 0, -math.log(2) / kappa))
    return out.drop("_from", "_first", "_k", "_change", *sums, *[f"{k}w" for k in sums])


def window_rows(half_life: Column, times: float, least: int, most: int) -> Column:
    """A window of `times` half-lives in whole rows, from `least` to `most`; null where there is no half-life."""
    return F.when(half_life.isNotNull(), F.least(F.greatest(F.round(half_life * times), F.lit(least)), F.lit(most))).cast("int")


def zscore_of_length(df: DataFrame, value: str, length: str, key: list[str], order: list[str]) -> DataFrame:
    """df with z: the distance of a row from the mean of the `length` rows before it (a column, so each row has its own frame), in their standard deviations.

    The sums up to the row before, and up to `length` rows before that, are found by row number: a frame of SQL has one length for all rows.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    v = F.col(value).cast("double")
    own = df.withColumns({"_k": F.row_number().over(w), "_d": v - F.first(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"_n": F.count("_d").over(upto), "_s": F.coalesce(F.sum("_d").over(upto), F.lit(0.0)), "_q": F.coalesce(F.sum(F.col("_d") * F.col("_d")).over(upto), F.lit(0.0))})
    start = own.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(key)], F.col("_k").alias("_at"), F.col("_n").alias("_n0"), F.col("_s").alias("_s0"), F.col("_q").alias("_q0"))
    same = F.col("_at") == F.col("_k") - F.col(length)
    for i, c in enumerate(key):
        same = same & F.col(f"_g{i}").eqNullSafe(F.col(f"`{c}`"))
    rows = own.join(start, same, "left")
    n, s, q = (F.col(f"_{k}") - F.col(f"_{k}0") for k in "nsq")
    mean = s / F.nullif(n, F.lit(0))
    spread = (q - s * mean) / F.nullif(n - 1, F.lit(0))
    z = F.when((F.col(length) > 1) & (spread > 1e-12 * q), (F.col("_d") - mean) / F.sqrt(spread))
    return rows.withColumn("z", z).drop("_k", "_d", "_n", "_s", "_q", "_at", "_n0", "_s0", "_q0", *[f"_g{i}" for i in range(len(key))])
