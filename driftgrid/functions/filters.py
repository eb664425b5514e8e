"""A Kalman filter over chunks of a series (M9).

The step from one filtered state to another is an element (A, b, C, eta, J) of an associative operation, so a long series is cut into chunks of `span`
of its order, and three passes do the filter: each chunk is reduced to one element, the elements of a key are folded in order, which gives every chunk
its first state, and each chunk is filtered from there. Chunks of any keys share an Arrow batch, as arrays of states; a task holds
batches of chunks, never a key.

Defined results: a row with a null or infinite value leaves the state as it is, but for the drift, and still has a row; a null in `order` comes
first; rows that tie in `order` are taken by their values; repeated rows count each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of an element of two states: A, C and J are 2 x 2.
_SIZES = {"A": (2, 2), "b": (2,), "C": (2, 2), "eta": (2,), "J": (2, 2)}
_EYE = np.eye(2)
#: Rows of the longest chunk times chunks that one step handles.
STEP_CELLS = 1 << 20


def _combine(i: dict[str, np.ndarray], j: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The element of i, then j; arrays of elements."""
    turn = lambda m: np.swapaxes(m, -1, -2)
    times = lambda m, v: (m @ v[..., None])[..., 0]
    onward = j["A"] @ np.linalg.inv(_EYE + i["C"] @ j["J"])
    back = turn(i["A"]) @ np.linalg.inv(_EYE + j["J"] @ i["C"])
    return {
        "A": onward @ i["A"],
        "b": times(onward, i["b"] + times(i["C"], j["eta"])) + j["b"],
        "C": onward @ i["C"] @ turn(j["A"]) + j["C"],
        "eta": times(back, j["eta"] - times(j["J"], i["b"])) + i["eta"],
        "J": back @ j["J"] @ i["A"] + i["J"],
    }


def _none(n: int) -> dict[str, np.ndarray]:
    """Elements of no step."""
    return {k: np.broadcast_to(_EYE if k == "A" else np.zeros(shape), (n, *shape)).copy() for k, shape in _SIZES.items()}


def _step(y: np.ndarray, x: np.ndarray, drift: float, noise: float) -> dict[str, np.ndarray]:
    """Elements of one row each: the states drift, then y = alpha + beta x is seen with noise; NaN: nothing is seen."""
    known = np.isfinite(y) & np.isfinite(x)
    h = np.stack([np.ones(len(x)), np.where(known, x, 0.0)], axis=1)
    y = np.where(known, y, 0.0)
    spread = drift * (h * h).sum(axis=1) + noise
    seen = known.astype(float)
    gain = drift * h / spread[:, None] * seen[:, None]
    a = _EYE - gain[:, :, None] * h[:, None, :]
    weight = (seen / spread)[:, None]
    return {"A": a, "b": gain * y[:, None], "C": a * drift, "eta": h * (y[:, None] * weight), "J": h[:, :, None] * (h * weight)[:, None, :]}


def _padded(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y and x of some chunks as matrices (NaN behind a chunk's end), and the rows of each."""
    flat, offsets = rows.flatten(), rows.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    inside = np.arange(size.max(initial=0)) < size[:, None]
    out = []
    for name in ("y", "x"):
        values = flat.field(name).fill_null(np.nan).to_numpy(zero_copy_only=False)
        m = np.full(inside.shape, np.nan)
        m[inside] = values
        out.append(m)
    return out[0], out[1], size


def _slices(size: np.ndarray) -> Iterator[slice]:
    """Chunks that are stepped through together."""
    lo = 0
    while lo < len(size):
        hi, longest = lo, 0
        while hi < len(size) and max(longest, int(size[hi])) * (hi + 1 - lo) <= max(STEP_CELLS, int(size[hi])):
            longest = max(longest, int(size[hi]))
            hi += 1
        yield slice(lo, max(hi, lo + 1))
        lo = max(hi, lo + 1)


def _flat(element: dict[str, np.ndarray]) -> pa.Array:
    n = len(element["b"])
    values = np.concatenate([element[k].reshape(n, -1) for k in _SIZES], axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _element(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in _SIZES.items():
        width = int(np.prod(shape))
        out[k] = values[:, at : at + width].reshape(-1, *shape)
        at += width
    return out


def _reduced(batches: Iterator[pa.RecordBatch], drift: float, noise: float) -> Iterator[pa.RecordBatch]:
    """The last column, the rows of a chunk, as the element of all of them."""
    for batch in batches:
        rows, found = batch.column(batch.num_columns - 1), []
        for some in _slices(np.diff(rows.offsets.to_numpy())):
            y, x, size = _padded(rows.slice(some.start, some.stop - some.start))
            total = _none(len(size))
            for k in range(y.shape[1]):
                on = size > k
                new = _combine({n: v[on] for n, v in total.items()}, _step(y[on, k], x[on, k], drift, noise))
                for n, v in total.items():
                    v[on] = new[n]
            found.append(_flat(total))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.float64()))], names=batch.schema.names)


def _started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, the elements of a key in order, as the states (mean and covariance) before each."""
    for batch in batches:
        elements = batch.column(batch.num_columns - 1)
        size = np.diff(elements.offsets.to_numpy()).astype(np.int64)
        flat = elements.flatten()
        values = flat.field("element").flatten().to_numpy(zero_copy_only=False).reshape(-1, 16)
        first = np.cumsum(size) - size
        # the prior is an element that forgets what was before
        state = _none(len(size))
        state["A"][:] = 0.0
        state["C"][:] = _EYE
        before = np.zeros((len(values), 6))
        for k in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > k)
            at = first[on] + k
            before[at] = np.concatenate([state["b"][on], state["C"][on].reshape(-1, 4)], axis=1)
            new = _combine({n: v[on] for n, v in state.items()}, _element(values[at]))
            for n, v in state.items():
                v[on] = new[n]
        states = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * 6, pa.int32()), pa.array(before.ravel()))
        column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.StructArray.from_arrays([flat.field("chunk"), states], names=["chunk", "state"]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=batch.schema.names)


def _filtered(batches: Iterator[pa.RecordBatch], drift: float, noise: float) -> Iterator[pa.RecordBatch]:
    """Rows of chunks with the mean before each, from the state before the chunk."""
    for batch in batches:
        rows, states = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 6)
        found = []
        for some in _slices(np.diff(rows.offsets.to_numpy())):
            own = rows.slice(some.start, some.stop - some.start)
            y, x, size = _padded(own)
            mean, cov = states[some, :2].copy(), states[some, 2:].reshape(-1, 2, 2).copy()
            out = np.full((*y.shape, 2), np.nan)
            for k in range(y.shape[1]):
                out[:, k] = mean
                known = (size > k) & np.isfinite(y[:, k]) & np.isfinite(x[:, k])
                cov = cov + drift * _EYE
                h = np.stack([np.ones(len(size)), np.where(known, x[:, k], 0.0)], axis=1)
                at = (cov @ h[:, :, None])[:, :, 0]
                gain = at / ((at * h).sum(axis=1) + noise)[:, None] * known[:, None]
                mean = mean + gain * (np.where(known, y[:, k], 0.0) - (h * mean).sum(axis=1))[:, None]
                cov = cov - gain[:, :, None] * at[:, None, :]
            inside = np.arange(y.shape[1]) < size[:, None]
            flat = own.flatten()
            values = pa.StructArray.from_arrays([flat.field("at"), pa.array(out[inside][:, 0]), pa.array(out[inside][:, 1])], names=["at", "alpha", "beta"])
            found.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), values))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.concat_arrays(found)] if found else [c.slice(0, 0) for c in batch.columns[:-1]], names=batch.schema.names[:-1])


def chunk_of(order: Column, kind: str, span: int) -> Column:
    """The chunk that a date, time or number lies in: `span` days, or `span` of the number."""
    if kind.startswith("timestamp"):
        order = F.unix_date(F.to_date(order))
    elif kind == "date":
        order = F.unix_date(order)
    return F.floor(order / span).cast("long")


def kalman(df: DataFrame, y: str, x: str, key: list[str], order: list[str], drift: float = 1e-4, noise: float = 1e-2, span: int = 366) -> DataFrame:
    """(key, order, alpha, beta) of y on x that drift as random walks, filtered in order within each key; both before the row is seen (M9).

    The first column of `order` is a date, a time or a number, cut into chunks of `span`; a task's memory grows with the rows of a chunk.
    """
    kinds = dict(df.dtypes)
    at = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    row = F.struct(at.alias("at"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    keyed = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)]
    ks = [f"k{i}" for i in range(len(key))]
    chunks = df.select(*keyed, chunk_of(F.col(f"`{order[0]}`"), kinds[order[0]], span).alias("chunk"), row.alias("row")).groupBy(*ks, "chunk").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    head = ", ".join(f"{k} {kinds[c]}" for k, c in zip(ks, key, strict=True))
    values = chunks.select(*ks, "chunk", F.transform("rows", lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"))).alias("rows"))
    elements = values.mapInArrow(lambda batches: _reduced(batches, drift, noise), f"{head}, chunk long, element array<double>")
    by_key = elements.groupBy(*ks).agg(F.sort_array(F.collect_list(F.struct("chunk", "element"))).alias("elements"))
    starts = by_key.mapInArrow(_started, f"{head}, elements array<struct<chunk: long, state: array<double>>>")
    starts = starts.select(*ks, F.explode("elements").alias("e")).select(*ks, F.col("e.chunk").alias("chunk"), F.col("e.state").alias("state"))
    same = [chunks[c].eqNullSafe(starts[c]) for c in [*ks, "chunk"]]
    joined = chunks.join(starts, same).select(*[chunks[k] for k in ks], chunks["rows"], starts["state"])
    out = joined.mapInArrow(lambda batches: _filtered(batches, drift, noise), f"{head}, rows array<struct<at: {dict(joined.select(F.col('rows')[0]['at'].alias('a')).dtypes)['a']}, alpha: double, beta: double>>")
    rows = out.select(*ks, F.explode("rows").alias("r"))
    return rows.select(*[F.col(k).alias(c) for k, c in zip(ks, key, strict=True)], *[F.col(f"r.at.o{i}").alias(c) for i, c in enumerate(order)], "r.alpha", "r.beta")
