"""Operator 4, quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are cut into bins; each feature has a lookup table of
log-odds, learnt by cyclic boosting: in every round each feature in turn gets one
shallow tree, fitted to the gradients summed over its bins, at a low learning rate.
The pairs of features that explain most of what is left then get tables of their own in
the same way. A score is the sigmoid of the intercept plus one table entry for each
feature and pair, added up for whole batches.

The model is fitted on at most `sample` labelled rows (the default is the documented
bound; those with the least hash of their doc_id, and of the documents that have these ids the rows with the least hash of id
and text), because one driver fits it. Counts
and scores cover all rows and whole texts.

Defined results: a null or empty text is scored like any other (all features zero); rows
with a null label are not learnt from; repeated rows are scored each and labels that
contradict each other are each learnt; without any label every score is 0.5; an empty table
gives an empty one; ties of a score at 0.5 count as quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, in_arrow, rows_of, table, text_buffers, word_hashes, words_of
from .quality_rules import MEASURES, measure

SAMPLE, ROUNDS, PAIR_ROUNDS, PAIRS, BINS, PAIR_BINS, RATE = 20_000, 150, 60, 6, 64, 12, 0.1
FEATURES = ["log_words", "word_chars", "symbols", "upper", "bangs", "repeats", "same_next", "distinct", "line_words", "repeated_lines", "digits", "stops", "wide", "pipes", "long_words"]


def _per_word(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each text, one row each."""
    m = dict(zip(MEASURES, measure(data, offsets).astype(float), strict=True))
    n = len(offsets) - 1
    starts, ends = words_of(data, offsets)
    row = rows_of(offsets, starts)
    hashes = word_hashes(data, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    count = lambda flags: np.bincount(row[flags], minlength=n)
    words = np.maximum(m["n_words"], 1)
    size = np.maximum(np.diff(offsets), 1)
    out = [
        np.log1p(m["n_words"]),
        m["word_chars"] / words,
        m["n_symbols"] / words,
        m["n_upper"] / np.maximum(m["word_chars"], 1),
        m["n_bangs"] / words,
        m["n_repeat_words"] / words,
        count(same) / words,
        np.bincount(row[order][fresh], minlength=n) / words,
        np.log1p(m["n_words"] / np.maximum(m["n_lines"], 1)),
        m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        _per_word((data >= 48) & (data <= 57), offsets) / size,
        _per_word((data == 46) | (data == 44), offsets) / words,
        _per_word(data >= 128, offsets) / size,
        _per_word(data == 124, offsets) / words,
        count(ends - starts > 16) / words,
    ]
    return np.stack(out, axis=1)


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for i, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, i], "right")]
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            out += values[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Newton steps of a tree with few leaves over ordered bins."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    bounds = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = _gain(cg[at] - cg[a], ch[at] - ch[a]) + _gain(cg[b] - cg[at], ch[b] - ch[at]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(at[k])))
        if best[1] < 0:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a tree that splits one feature, then each side by the other."""

    def halves(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        rows = _tree(g.sum(1), h.sum(1), 2)
        out = np.zeros_like(g)
        for value in np.unique(rows):
            side = rows == value
            out[side] = _tree(g[side].sum(0), h[side].sum(0), 2)
        return float((out * g - 0.5 * out * out * (h + 1e-9)).sum()), out

    (a, x), (b, y) = halves(g, h), halves(g.T, h.T)
    return x if a >= b else y.T


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model for features x and labels y (0 or 1)."""
    model = AdditiveModel()
    if not len(y):
        model.edges, model.tables = [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1]
        return model
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model.intercept = float(np.log(rate / (1 - rate)))
    model.edges = [_cuts(x[:, i], BINS) for i in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    odds = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for i, b in enumerate(binned):
            p = 1 / (1 + np.exp(-odds))
            step = RATE * _tree(np.bincount(b, y - p, len(model.tables[i])), np.bincount(b, p * (1 - p), len(model.tables[i])))
            model.tables[i] += step
            odds += step[b]
    model.pair_edges = [_cuts(x[:, i], PAIR_BINS) for i in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.pair_edges)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        p = 1 / (1 + np.exp(-odds))
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape), cell

    def worth(i: int, j: int) -> float:
        g, h, _ = sums(i, j)
        return float(_gain(g, h).sum() - _gain(g.sum(0), h.sum(0)).sum() - _gain(g.sum(1), h.sum(1)).sum())

    every = [(i, j) for i in range(x.shape[1]) for j in range(i)]
    model.pairs = sorted(every, key=lambda ij: -worth(*ij))[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h, cell = sums(i, j)
            step = RATE * _tree2(g, h)
            model.pair_tables[k] += step
            odds += step.ravel()[cell]
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in blocks(offsets):
            x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, np.ascontiguousarray(x.T))], names=["own", *FEATURES])


def _scored(batches: Iterator[pa.RecordBatch], model: AdditiveModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        out = [np.zeros(0)]
        for lo, hi in blocks(offsets):
            out.append(model.score(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out))], names=["row", "text", "score"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Fit on labelled rows outside the held-out third (crc32 of the doc_id as text, modulo 3, is 1)."""
    chosen = labels.filter("quality is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    chosen = chosen.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("id"), "id", "quality").limit(sample)
    # at most `sample` rows of two numbers, so they go to every task
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    rows = rows.select(F.struct("quality", F.xxhash64("id", "text").alias("at"), "id").alias("own"), "text")
    schema = T.StructType([rows.schema["own"], *[T.StructField(f, T.DoubleType()) for f in FEATURES]])
    # many documents may share an id: the driver gets `sample` rows at most
    found = in_arrow(rows, _featured, schema).orderBy("own.at", "own.id", "own.quality", *FEATURES).limit(sample).select("own.quality", *FEATURES).toPandas()
    return fit(found[FEATURES].to_numpy(float), found["quality"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """docs' row as a struct without its text, the text, and the score."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return in_arrow(rows, partial(_scored, model=model), schema)


def op4_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
