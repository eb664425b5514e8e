"""Sweeps of signal rules over a grid of parameters.

`sweep` simulates every cell of a grid in one pass over the rows of a key: the state of all cells (position, rows held, barred, sums of returns)
are arrays, and a row is one step for all of them. Rows are dealt by key, sorted, and read as a stream of Arrow batches, so a task
holds the state of one key and never its rows; a grid whose state passes `group_bytes` is cut into groups of cells that
run beside each other. `surface` tells whether a figure is smooth over the grid or one spike, `out_of_sample` what the best cell of the past
makes in the block after it.

Defined results: as `signal_states` and `backtest` give for one cell; rows without a return (the first of a key, a null or zero price) count for no
cell; keys without any return have null figures; rows that tie in `order` are taken in any order; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of state and results of one cell.
CELL_BYTES = 256
AXES = ["i_z", "i_enter", "i_leave", "i_stop", "i_most"]
_RULES = {"z": "string", "enter": "double", "leave": "double", "stop": "double", "most_rows": "long"}
_FIGURES = {"n": "long", "pnl": "double", "sharpe": "double", "skewness": "double", "kurtosis": "double", "max_drawdown": "double", "exposure": "double", "n_trades": "long", "n_stops": "long", "turnover": "double", "cost": "double"}


@dataclass(frozen=True)
class Grid:
    """All cells of the axes whose thresholds are in order (leave < enter < stop); z names the columns of z-scores, one for each window."""

    z: tuple[str, ...]
    enter: tuple[float, ...]
    leave: tuple[float, ...]
    stop: tuple[float, ...] = (3.5,)
    most_rows: tuple[int, ...] = (60,)

    def cells(self) -> list[tuple[int, ...]]:
        axes = product(*(range(len(a)) for a in (self.z, self.enter, self.leave, self.stop, self.most_rows)))
        return [c for c in axes if self.leave[c[2]] < self.enter[c[1]] < self.stop[c[3]]]


class _State:
    """Every cell of one group for one key."""

    def __init__(self, grid: Grid, cells: np.ndarray, cost_bps: float, per_year: int) -> None:
        self.grid, self.cells, self.cost_rate, self.per_year = grid, cells, cost_bps / 1e4, per_year
        self.enter, self.leave, self.stop = (np.array(a, float)[cells[:, i]] for i, a in ((1, grid.enter), (2, grid.leave), (3, grid.stop)))
        self.most, self.of = np.array(grid.most_rows, np.int64)[cells[:, 4]], cells[:, 0]
        k = len(cells)
        self.position, self.rows_held, self.barred = np.zeros(k), np.zeros(k, np.int64), np.zeros(k, bool)
        self.was, self.price, self.carry = np.zeros(k), None, 0.0
        self.clear()

    def clear(self) -> None:
        """Begin the figures anew; positions stay."""
        k = len(self.cells)
        self.n, self.sums = 0, np.zeros((4, k))
        self.equity, self.peak, self.down = np.zeros(k), np.zeros(k), np.zeros(k)
        self.active, self.trades, self.stops, self.turnover = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k)
        self.cost = np.zeros(k)

    def row(self, price: float | None, carry: float | None, z: np.ndarray) -> None:
        held = self.position
        moved = np.abs(held - self.was)
        self.turnover += moved
        if price is not None and self.price:
            cost = moved * self.cost_rate
            value = held * (price / self.price - 1) + held * self.carry / 100 / self.per_year - cost
            self.n += 1
            self.cost += cost
            self.active += value != 0
            power = value.copy()
            for total in self.sums:
                total += power
                power *= value
            self.equity += value
            np.maximum(self.peak, self.equity, out=self.peak)
            np.minimum(self.down, self.equity - self.peak, out=self.down)
        self.was, self.price, self.carry = held, price, 0.0 if carry is None else carry
        own = z[self.of]
        known, size = np.isfinite(own), np.abs(own)
        open_ = held != 0
        self.rows_held += open_
        with np.errstate(invalid="ignore"):
            stop = open_ & known & (size >= self.stop)
            calm = known & (size <= self.leave)
            close = stop | open_ & (calm | (self.rows_held >= self.most))
            enter = ~open_ & known & (size >= self.enter) & (size < self.stop) & ~self.barred
        self.position = np.where(close, 0.0, np.where(enter, -np.sign(own), held))
        self.rows_held[enter] = 0
        self.barred = stop | self.barred & ~calm
        self.trades += enter
        self.stops += stop

    def figures(self) -> list[pa.Array]:
        n, nothing = self.n, self.n == 0
        mean = self.sums / max(n, 1)
        spread = mean[1] - mean[0] ** 2
        # a spread that is all rounding is none
        flat = spread <= 1e-15 * np.maximum(mean[1], 1e-300)
        sd = np.sqrt(np.where(flat, 1.0, spread))
        third = mean[2] - 3 * mean[0] * mean[1] + 2 * mean[0] ** 3
        fourth = mean[3] - 4 * mean[0] * mean[2] + 6 * mean[0] ** 2 * mean[1] - 3 * mean[0] ** 4
        sample = sd * np.sqrt(n / (n - 1)) if n > 1 else sd
        hide = flat | (n < 2)
        columns = [(np.full(len(sd), n), False), (self.sums[0], nothing), (mean[0] / sample, hide), (third / sd**3, hide), (fourth / sd**4, hide), (self.down, nothing), (self.active / max(n, 1), nothing), (self.trades, False), (self.stops, False), (self.turnover, False), (self.cost, nothing)]
        return [pa.array(v, mask=np.broadcast_to(np.asarray(m), v.shape)) for v, m in columns]


def _run(batches: Iterator[pa.RecordBatch], grid: Grid, groups: list[np.ndarray], n_key: int, cost_bps: float, per_year: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows are (key..., group, block, price, carry, z...), sorted by key, group and order; the schema has the block behind the key if it is asked for."""
    now, state, part = None, None, None
    blocks = len(schema) - n_key - len(AXES) - len(_RULES) - len(_FIGURES)

    def done() -> pa.RecordBatch:
        cells = state.cells
        key = [pa.array([v] * len(cells), schema.field(i).type) for i, v in enumerate([*now[:-1], part][: n_key + blocks])]
        at = n_key + blocks + len(AXES)
        rules = [pa.array(np.array(a, dtype=object if i == 0 else None)[cells[:, i]].tolist(), schema.field(at + i).type) for i, a in enumerate((grid.z, grid.enter, grid.leave, grid.stop, grid.most_rows))]
        figures = [x.cast(schema.field(at + len(_RULES) + i).type) for i, x in enumerate(state.figures())]
        return pa.RecordBatch.from_arrays([*key, *(pa.array(cells[:, i]) for i in range(len(AXES))), *rules, *figures], schema=schema)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[: n_key + 4]]
        z = np.stack([c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns[n_key + 4 :]], axis=1) if batch.num_rows else np.zeros((0, 1))
        for i in range(batch.num_rows):
            own = tuple(c[i] for c in columns[: n_key + 1])
            if own != now:
                if state is not None:
                    yield done()
                now, state, part = own, _State(grid, groups[own[-1]], cost_bps, per_year), columns[n_key + 1][i]
            elif blocks and columns[n_key + 1][i] != part:
                yield done()
                state.clear()
                part = columns[n_key + 1][i]
            state.row(columns[n_key + 2][i], columns[n_key + 3][i], z[i])
    if state is not None:
        yield done()


def sweep(df: DataFrame, grid: Grid, price: str, key: list[str], order: list[str], carry: str | None = None, cost_bps: float = 1.0, per_year: int = 252, group_bytes: int = 16 << 20, block: str | None = None) -> DataFrame:
    """For each key (and each stretch of equal values of `block`, if one is named, with positions carried on) and cell: the cell's place on AXES and its rules, n returns, pnl (their sum), sharpe of a row, skewness and kurtosis, max_drawdown, exposure, trades, stops, turnover and cost."""
    from pyspark.sql.pandas.types import to_arrow_schema

    cells = np.array(grid.cells(), np.int64).reshape(-1, len(AXES))
    size = max(1, group_bytes // CELL_BYTES)
    groups = [cells[i : i + size] for i in range(0, len(cells), size)]
    fields = [*(df.schema[k] for k in [*key, *([block] if block else [])]), *(T.StructField(a, T.LongType()) for a in AXES)]
    schema = T.StructType([*fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in {**_RULES, **_FIGURES}.items())).fields])
    if not groups:
        return df.sparkSession.createDataFrame([], schema)
    at = F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))) if len(groups) > 1 else F.lit(0)
    values = [(F.col(f"`{block}`") if block else F.lit(0)).alias("_block"), F.col(price).cast("double").alias("_price"), (F.col(carry).cast("double") if carry else F.lit(0.0)).alias("_carry"), *[F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(grid.z)]]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(key)], *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)], *values).withColumn("_group", at)
    dealt, sort = [f"_k{i}" for i in range(len(key))] + ["_group"], [f"_o{i}" for i in range(len(order))]
    rows = rows.repartition(*dealt).sortWithinPartitions(*dealt, *sort).select(*dealt, "_block", "_price", "_carry", *[f"_z{i}" for i in range(len(grid.z))])
    arrow, n_key = to_arrow_schema(schema), len(key)
    return rows.mapInArrow(lambda batches: _run(batches, grid, groups, n_key, cost_bps, per_year, arrow), schema)


def surface(cells: DataFrame, key: list[str], figure: str = "pnl") -> DataFrame:
    """For each key, how smooth `figure` is over the grid: n_cells, share_positive, best and the mean of its neighbours (a step away on one axis), spike and roughness.

    spike is the best cell's lead over its neighbours in standard deviations of all cells; roughness the mean square distance of a cell
    from the mean of its neighbours, by the variance of all cells (0: flat or linear; 1 and more: no better than noise).
    """
    steps = [(axis, by) for axis in AXES for by in (-1, 1)]
    own = cells.select(*key, *AXES, F.col(figure).alias("_v"))
    beside = F.array(*[F.struct(*[(F.col(a) + by if a == axis else F.col(a)).alias(a) for a in AXES]) for axis, by in steps])
    near = own.select(*key, F.explode(beside).alias("_a"), "_v").select(*key, "_a.*", F.col("_v").alias("_w")).groupBy(*key, *AXES).agg(F.avg("_w").alias("_near"))
    rows = own.join(near, [*key, *AXES], "left")
    first = F.max_by(F.struct("_v", "_near"), F.struct("_v", *[-F.col(a) for a in AXES]))
    out = rows.groupBy(*key).agg(F.count("_v").alias("n_cells"), (F.count_if(F.col("_v") > 0) / F.nullif(F.count("_v"), F.lit(0))).alias("share_positive"), first.alias("_b"), F.nullif(F.stddev_pop("_v"), F.lit(0.0)).alias("_sd"), F.avg(F.pow(F.col("_v") - F.col("_near"), 2)).alias("_rough"))
    return out.select(*key, "n_cells", "share_positive", F.col("_b._v").alias("best"), F.col("_b._near").alias("neighbours"), ((F.col("_b._v") - F.col("_b._near")) / F.col("_sd")).alias("spike"), (F.col("_rough") / F.pow("_sd", F.lit(2.0))).alias("roughness"))


def out_of_sample(cells: DataFrame, key: list[str], block: str, figure: str = "pnl") -> DataFrame:
    """For each key and block of a sweep by blocks: the cell that was best by `figure` over all blocks before, what it had there (in_sample, in_rows), and what it then made (out_of_sample, out_rows).

    Nothing of a block takes part in its own choice; the first block of a key has none, so no row.
    """
    before = Window.partitionBy(*key, *AXES).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.withColumns({"_past": F.sum(figure).over(before), "_rows": F.sum("n").over(before)}).filter(F.col("_past").isNotNull())
    best = F.max_by(F.struct(*AXES, *_RULES, F.col("_past").alias("in_sample"), F.col("_rows").alias("in_rows"), F.col(figure).alias("out_of_sample"), F.col("n").alias("out_rows")), F.struct("_past", *[-F.col(a) for a in AXES]))
    return rows.groupBy(*key, block).agg(best.alias("_b")).select(*key, block, "_b.*")
