"""Operator 13, toxicity: maximum-scoring segments of token log-odds.

A token is a run of letters, in lower case. `learn` counts in how many toxic and other labelled documents each token, and each
of its first bytes (PREFIXES), occurs. The rate of a node of this tree has a Dirichlet prior: `prior` documents at the rate of
the node above it, so a rare token leans on its stem and a rare stem on all documents. A node with the documents of the node above it
adds nothing. The log-odds of a token against all documents, less `drift`, is its score: negative in plain text.

One scan over a text finds every maximal-scoring segment (disjoint stretches that no longer or shorter stretch outdoes, in linear time).
The greatest segment of a clean text of n tokens follows an extreme-value law, P(S <= x) = exp(-K n exp(-lambda x)); lambda and K are fitted
by maximum likelihood to clean labelled documents that the counts have not seen, texts without a segment being censored. The law makes
expected numbers of segments that good (`passages` lists those under `expected`), and one statistic for each document: how unlikely its best r
segments are, for the r that says most, up to RANKS. A logistic curve over that turns it into a score.

The model is fitted on at most `sample` labelled documents (the documented bound; those with the least hash of their id, then of
id and text), two thirds for the counts and one for the calibration, and keeps at most `nodes` nodes, those of most documents; every text is scored whole.

Defined results: a null or empty text is scored like any other, without a segment; rows with a null label or id are not learnt from;
contradicting labels are each learnt; repeated rows are scored each; without a toxic label every score is 0; without a clean one it is
1; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, BASE, LOWER, blocks, in_arrow, mix, rows_of, runs_of, table, text_buffers

SAMPLE, NODES, PRIOR, DRIFT, EXPECTED, RANKS = 40_000, 400_000, 8.0, 2.0, 0.05, 8
#: Lengths in bytes at which the beginning of a token is a node; the whole token comes after them.
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_POWER = np.array([pow(int(BASE), j, 1 << 64) for j in range(max(PREFIXES))], np.uint64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case (A-Z and the accented letters of Latin-1), and the starts and ends of the runs of letters."""
    data = LOWER[data]
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = data + 32 * accented.astype(np.uint8)
    return data, *runs_of(_LETTER[data], offsets)


def _whole(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the tokens."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    packed = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    if len(packed):
        place = packed - np.repeat(starts, size)
        power = np.full(int(size.max()), BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        out = np.add.reduceat(_BYTE[data[packed]] * power[place], np.cumsum(size) - size)
    return mix(out + np.uint64(99))


def chains(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of each different token from its first bytes to the whole, and which of them each place holds."""
    whole = _whole(data, starts, ends)
    own, first, of = np.unique(whole, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    h, out = np.zeros(len(own), np.uint64), []
    for j in range(max(PREFIXES)):
        inside = s + j < e
        h[inside] += _BYTE[data[s[inside] + j]] * _POWER[j]
        if j + 1 in PREFIXES:
            out.append(mix(h + np.uint64(j + 1)))
    return np.stack([*out, own]), of


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, node, above, toxic, total): documents by node."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in blocks(offsets):
            low, starts, ends = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            row = rows_of(offsets[lo : hi + 1] - offsets[lo], starts)
            tree, of = chains(low, starts, ends)
            pairs = np.unique(of * np.int64(hi - lo) + row)
            token, doc = pairs // (hi - lo), pairs % (hi - lo)
            for level, nodes in enumerate(tree):
                own, first, node = np.unique(nodes, return_index=True, return_inverse=True)
                seen = np.unique(node[token] * np.int64(hi - lo) + doc)
                at = seen // (hi - lo)
                above = tree[level - 1][first] if level else np.zeros(len(own), np.uint64)
                columns = [pa.array(np.full(len(own), level, np.int32)), pa.array(own.view(np.int64)), pa.array(above.view(np.int64)), pa.array(np.bincount(at, toxic[lo:hi][seen % (hi - lo)], len(own)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(own)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["level", "node", "above", "toxic", "total"])


@dataclass
class SegmentModel:
    """Log-odds by node and level, the extreme-value law, and the logistic curve."""

    rate: float = 0.0
    drift: float = DRIFT
    nodes: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.uint64)] * (len(PREFIXES) + 1))
    odds: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)] * (len(PREFIXES) + 1))
    slope: float = 1.0
    often: float = 1.0
    curve: tuple[float, float] = (0.0, 1.0)

    def token_scores(self, tree: np.ndarray) -> np.ndarray:
        """Of each chain: the log-odds of its deepest known node, less the drift."""
        out = np.zeros(tree.shape[1])
        for nodes, own, odds in zip(tree, self.nodes, self.odds, strict=True):
            if len(own):
                at = np.minimum(np.searchsorted(own, nodes), len(own) - 1)
                known = own[at] == nodes
                out[known] = odds[at[known]]
        return out - self.drift

    def statistic(self, n: int, scores: list[float]) -> float:
        """Minus the log of the chance that a clean text of n tokens has r segments as good as its best r, for the best r; higher is less like a clean text."""
        base, best = math.log(self.often * max(n, 1)), 0.0
        for r, value in enumerate(sorted(scores, reverse=True)[:RANKS], 1):
            # of r or more by the law of rare events with the mean exp(-x); in logs, as long passages make the mean 0 in a double
            x = self.slope * value - base
            if r == 1:
                best = x
            elif x > 0:
                tail = sum(math.exp(math.lgamma(r + 1) - math.lgamma(r + k + 1) - k * x) for k in range(20))
                best = max(best, math.exp(-x) + r * x + math.lgamma(r + 1) - math.log(tail) - math.log(RANKS))
        return best if scores else min(-base, 0.0)

    def score(self, statistic: np.ndarray) -> np.ndarray:
        if self.rate in (0.0, 1.0):
            return np.full(len(statistic), self.rate)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.clip(statistic, -20, 60), -30, 30)))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, start, end) of all maximal-scoring segments, in order, each with a positive score.

    Adjoining positive scores are one step; each step looks back along links to the last segment that begins lower, so the
    whole is linear in the number of steps.
    """
    positive = scores > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]])))
    if not len(edge):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    lows, highs, starts, ends, back = [], [], [], [], []
    for s, e, low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), total[edge[::2]].tolist(), total[edge[1::2]].tolist(), strict=True):
        j = len(lows) - 1
        while True:
            while j >= 0 and lows[j] >= low:
                j = back[j]
            if j < 0 or highs[j] >= high:
                break
            # the segment from j on to here outdoes both
            low, s = lows[j], starts[j]
            i, j = j, back[j]
            del lows[i:], highs[i:], starts[i:], ends[i:], back[i:]
        lows.append(low)
        highs.append(high)
        starts.append(s)
        ends.append(e)
        back.append(j)
    return [(h - w, s, e) for w, h, s, e in zip(lows, highs, starts, ends, strict=True)]


def _scanned(data: np.ndarray, offsets: np.ndarray, model: SegmentModel) -> Iterator[tuple[int, list[tuple[float, int, int]], np.ndarray, np.ndarray]]:
    """For each text: its number of tokens, its segments, and the starts and ends of its tokens in bytes."""
    low, starts, ends = tokens(data, offsets)
    tree, of = chains(low, starts, ends)
    scores = model.token_scores(tree)[of]
    bounds = np.searchsorted(starts, offsets)
    for k in range(len(offsets) - 1):
        a, b = bounds[k], bounds[k + 1]
        yield int(b - a), segments(scores[a:b]), starts[a:b] - offsets[k], ends[a:b] - offsets[k]


def _measured(batches: Iterator[pa.RecordBatch], model: SegmentModel) -> Iterator[pa.RecordBatch]:
    """(toxic, n, best): the greatest RANKS scores of each text."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        n, best = [], []
        for lo, hi in blocks(offsets):
            for count, found, _, _ in _scanned(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model):
                n.append(count)
                best.append(sorted((x[0] for x in found), reverse=True)[:RANKS])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(best, pa.list_(pa.float64()))], names=["toxic", "n", "best"])


def _logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _tree_odds(model: SegmentModel, level: np.ndarray, node: np.ndarray, above: np.ndarray, toxic: np.ndarray, total: np.ndarray, prior: float) -> None:
    """Rates down the tree, each with `prior` documents at the rate above it."""
    keys, rates, counts = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for k in range(len(PREFIXES) + 1):
        at = np.flatnonzero(level == k)
        at = at[np.argsort(node[at], kind="stable")]
        parent, of = np.full(len(at), model.rate), np.full(len(at), -1.0)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, above[at]), len(keys) - 1)
            known = keys[place] == above[at]
            parent[known], of[known] = rates[place[known]], counts[place[known]]
        rates = np.where(total[at] == of, parent, (toxic[at] + prior * parent) / (total[at] + prior))
        keys, counts = node[at], total[at].astype(float)
        model.nodes[k], model.odds[k] = keys, _logit(rates) - _logit(model.rate)


def fit_law(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """lambda and K of clean texts of n tokens with greatest segments `best` (0: none, censored)."""
    n = np.maximum(n, 1).astype(float)
    some = best > 0
    if some.sum() < 2:
        return 1.0, 1 / max(n.sum(), 1.0)
    x, w, rest = best[some], n[some], n[~some].sum()

    def slope(lam: float) -> float:
        e = w * np.exp(-lam * x)
        return len(x) / lam - x.sum() + len(x) * (e * x).sum() / (e.sum() + rest)

    low, high = 1e-3, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return low, float(len(x) / ((w * np.exp(-low * x)).sum() + rest))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of the logistic curve of y over x, with a slight ridge."""
    x, w = np.clip(x, -20, 60), np.zeros(2)
    design = np.stack([np.ones(len(x)), x], axis=1)
    ridge = np.array([1e-6, 1e-3]) * max(len(x), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-9)
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, nodes: int = NODES, prior: float = PRIOR, drift: float = DRIFT) -> SegmentModel:
    """Fit on labelled rows outside the held-out fourth (crc32 of the doc_id as text, modulo 4, is 2)."""
    chosen = labels.filter("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    chosen = chosen.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id", "toxic").limit(sample)
    # at most `sample` rows of two numbers, so they go to every task
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    # many documents may share an id: those with the `sample` least hashes; beyond that number only copies of one row with one id can come, and no text leaves its task
    rows = rows.select("toxic", "text", F.xxhash64("id", "text").alias("at"))
    last = rows.select("at").orderBy("at").limit(sample).agg(F.max("at").alias("last"), F.count("*").alias("n")).first()
    if not last["n"]:
        return SegmentModel()
    rows = rows.filter(F.col("at") <= last["last"])
    part = F.pmod(F.col("at"), F.lit(3)) == 0
    model = SegmentModel(drift=drift)
    model.rate = float(rows.filter(~part).agg(F.avg("toxic")).first()[0] or 0.0)
    if model.rate in (0.0, 1.0):
        return model
    counted = in_arrow(rows.filter(~part).select("toxic", "text"), _counted, "level int, node long, above long, toxic long, total long")
    counted = counted.groupBy("level", "node").agg(F.min("above").alias("above"), F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
    # what is left out has no evidence of its own: one or no toxic document and few others; such a node takes the rate above it
    kept = counted.filter("toxic >= 2 or total >= 8").orderBy(F.desc("total"), "level", "node").limit(nodes).toPandas()
    _tree_odds(model, kept["level"].to_numpy(), kept["node"].to_numpy(np.int64).view(np.uint64), kept["above"].to_numpy(np.int64).view(np.uint64), kept["toxic"].to_numpy(), kept["total"].to_numpy(), prior)
    seen = in_arrow(rows.filter(part).select("toxic", "text"), partial(_measured, model=model), "toxic int, n long, best array<double>").limit(sample).toPandas()
    y, n = seen["toxic"].to_numpy(float), seen["n"].to_numpy()
    clean = y == 0
    model.slope, model.often = fit_law(n[clean], np.array([b[0] if len(b) else 0.0 for b in seen["best"]])[clean] if len(seen) else np.zeros(0))
    model.curve = fit_curve(np.array([model.statistic(int(a), list(b)) for a, b in zip(n, seen["best"], strict=True)]), y)
    return model


_PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType()), T.StructField("text", T.StringType())]))
_PASSAGE_PA = pa.list_(pa.struct([("start", pa.int64()), ("tokens", pa.int64()), ("score", pa.float64()), ("expected", pa.float64()), ("text", pa.string())]))


def _scored(batches: Iterator[pa.RecordBatch], model: SegmentModel, expected: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        n, statistic, passages = [], [], []
        for lo, hi in blocks(offsets):
            own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            for k, (count, found, starts, ends) in enumerate(_scanned(own, at, model)):
                n.append(count)
                statistic.append(model.statistic(count, [x[0] for x in found]))
                listed = []
                for value, s, e in found:
                    often = model.often * max(count, 1) * math.exp(-min(model.slope * value, 700))
                    if often <= expected:
                        listed.append({"start": s, "tokens": e - s, "score": value, "expected": often, "text": own[at[k] + starts[s] : at[k] + ends[e - 1]].tobytes().decode()})
                passages.append(listed)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(statistic, pa.float64()), pa.array(model.score(np.array(statistic))), pa.array(passages, _PASSAGE_PA)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n_tokens", "statistic", "score", "passages"])


def score(docs: DataFrame, model: SegmentModel, expected: float = EXPECTED) -> DataFrame:
    """(row, n_tokens, statistic, score, passages): docs' row as a struct without its text; passages by place, with the number of the
    first token, the tokens, the score, the segments as good that a clean text of this length would have, and the text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("statistic", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("passages", _PASSAGE)])
    return in_arrow(rows, partial(_scored, model=model, expected=expected), schema)


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_tokens", F.size("passages").cast("long").alias("n_passages"))
