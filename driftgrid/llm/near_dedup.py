"""Operator 3, MinHash near-dedup by fast similarity sketching.

A document's set is its distinct `shingle`-word shingles, lower-cased over A-Z; a
text with fewer words is one shingle of all its words; a text without words has an
empty set and is linked with nothing.

Sketch: `BANDS * ROWS` coordinates. In round r every element of the set is hashed
to a bin and a value; a bin keeps the least value of the first round that reaches
it. After as many rounds as there are coordinates, round r instead places every
element in one given bin, so every coordinate fills however small the set, and the
estimate stays concentrated because one round spreads the elements over the bins
without repeats. One byte of each coordinate is stored. Rows of ROWS coordinates
form BANDS band keys; sets that agree on a band are candidates: with 32 bands of 5,
sets at a similarity of 0.8 fail to meet with a chance of 3 in a million.

Links, confirmed on the full sets of 64-bit shingle hashes: intersection * 100 >=
percent * union. Equal sets are one class, found by an aggregation. Every class is first
confirmed against one leader of its buckets, so a group of m near copies costs m
pairs; linked classes get one label. Then all pairs between different labels
of a bucket are compared by their sketches, in blocks bounded in members and shingles; members
left with a partner that agrees on MIN_AGREE of the bytes (at 0.8 less is over six standard deviations off)
bring their texts to the same block, where every such pair is confirmed on its full sets unless a link
found before joins them already. A block gives members, then links of a spanning forest, never its
pairs. A pair is compared in the first of its buckets alone. No bucket or partner is capped.

Defined results: null text is empty; equal rows are one class; a row with a null
doc_id takes the component of an equal set and else has none (kept); rows that
share a doc_id count as one document; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, in_arrow, mix, rows_of, dropped, table, text_buffers, window_sums, word_hashes, words_of, written

BANDS, ROWS = 32, 5
MIN_AGREE = 0.6
#: Members, and shingles, of a bucket on one side of a comparison.
CHUNK, CHUNK_SHINGLES = 2000, 500_000
#: Pairs of one leader that share a copy of its text.
LEADER_PAIRS = 200
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_FEATURES = "doc_id long, n_shingles long, k0 long, k1 long, sketch binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows on end, and the n + 1 bounds of the rows."""
    data = LOWER[data]
    starts, ends = words_of(data, offsets)
    hashes = word_hashes(data, starts, ends)
    grams = window_sums(hashes, shingle)
    word_at = np.searchsorted(starts, offsets)
    sets = []
    for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        if b - a >= shingle:
            sets.append(np.unique(grams[a : b - shingle + 1]))
        else:
            sets.append(window_sums(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else hashes[:0])
    return np.concatenate([*sets, hashes[:0]]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sketches(elements: np.ndarray, bounds: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """One byte for each of `size` coordinates of each set; zeros for an empty set."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros((n, size), np.uint8)
    empty = np.ones((n, size), bool)
    empty[np.diff(bounds) == 0] = False
    for turn in range(2 * size):
        if not len(owner):
            break
        h = mix(elements + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = (h >> np.uint64(33)).astype(np.int64) % size if turn < size else np.full(len(h), turn - size)
        place = owner * size + bins
        least = np.full(n * size, _FULL)
        open_ = empty.ravel()[place]
        np.minimum.at(least, place[open_], mix(h)[open_])
        hit = least != _FULL
        out.ravel()[hit] = (least[hit] >> np.uint64(11)).astype(np.uint8)
        empty.ravel()[hit] = False
        if hit.any() or turn >= size:
            more = empty.any(axis=1)[owner]
            elements, owner = elements[more], owner[more]
    return out


def _features(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in blocks(offsets):
            elements, bounds = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(elements ^ np.uint64(salt)))]) for salt in (0x51ED270B, 0x7F4A7C15)]
            k0, k1 = ((s[bounds[1:]] - s[bounds[:-1]]).astype(np.uint64).view(np.int64) for s in sums)
            sketch = sketches(elements, bounds)
            width = sketch.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.arange(hi - lo + 1, dtype=np.int32) * width), pa.py_buffer(sketch.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(k0), pa.array(k1), packed], names=["doc_id", "n_shingles", "k0", "k1", "sketch"])


def _linked(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text_a, text_b), those a and b whose full sets are similar enough."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        sides = [text_buffers(batch.column(i)) for i in (2, 3)]
        for lo, hi in blocks(sides[0][1] + sides[1][1]):
            (x, xb), (y, yb) = (shingle_sets(d[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], shingle) for d, o in sides)
            for i in range(hi - lo):
                p, q = x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]]
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good[lo + i] = shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])


def _candidates(group: pa.Table, percent: int) -> tuple[pa.Table, np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """A bucket's members on sides i and j (one side if i = j) by set size, their labels, and the pairs that may be similar enough.

    The pairs come as a member's row and its partners' rows, which have other labels at that time (the
    labels may change meanwhile). Partners of a like size are a range; a pair comes in the first band it shares alone.
    """
    group = group.sort_by([("n", "ascending"), ("node", "ascending")])
    band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
    side, component, size = (group.column(c).to_numpy().copy() for c in ("side", "component", "n"))
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(side), -1)
    left, right = (np.flatnonzero(side == x) for x in (i, j))
    lo = np.searchsorted(size[right] * 100, percent * size[left])
    hi = np.searchsorted(size[right] * percent, 100 * size[left], "right")
    least = int(np.ceil(MIN_AGREE * percent / 80 * sketch.shape[1]))

    def pairs() -> Iterator[tuple[int, np.ndarray]]:
        for k, x in enumerate(left.tolist()):
            at = right[lo[k] : hi[k]]
            at = at[component[at] != component[x]]
            if i == j:
                at = at[at > x]
            equal = sketch[at] == sketch[x]
            near = np.count_nonzero(equal, axis=1) >= least
            if near.any():
                at, equal = at[near], equal[near, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2)
                at = at[np.argmax(equal, axis=1) == band]
                if len(at):
                    yield x, at

    return group, component, pairs()


def _alike(group: pa.Table, percent: int) -> pa.Table:
    """The members that have a partner left."""
    group, _, pairs = _candidates(group, percent)
    keep = np.zeros(len(group), bool)
    for x, at in pairs:
        keep[x] = True
        keep[at] = True
    return group.filter(pa.array(keep))


def _forest(group: pa.Table, shingle: int, percent: int) -> pa.Table:
    """Links (a, b) that join all labels whose members' full sets are similar enough."""
    group, component, pairs = _candidates(group, percent)
    data, offsets = text_buffers(group.column("text").combine_chunks())
    parts = [shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle) for lo, hi in blocks(offsets)]
    names, elements = np.unique(np.concatenate([e for e, _ in parts]), return_inverse=True)
    length = np.concatenate([np.diff(b) for _, b in parts])
    start = np.cumsum(length) - length
    mark = np.zeros(len(names), bool)
    links: list[tuple[int, int]] = []
    for x, at in pairs:
        own = elements[start[x] : start[x] + length[x]]
        mark[own] = True
        heads = np.cumsum(length[at]) - length[at]
        at_words = np.arange(int(length[at].sum())) + np.repeat(start[at] - heads, length[at])
        shared = np.add.reduceat(mark[elements[at_words]], heads, dtype=np.int64)
        mark[own] = False
        for y in at[(shared > 0) & (100 * shared >= percent * (length[x] + length[at] - shared))].tolist():
            if component[y] != component[x]:
                component[component == component[y]] = component[x]
                links.append((x, y))
    ends = np.array(links, np.int64).reshape(-1, 2)
    node = group.column("node").to_numpy()
    return pa.table({"a": node[ends[:, 0]], "b": node[ends[:, 1]]})


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b), for every node of a link.

    Alternates stars: each node sends its larger neighbours, then its smaller ones, to its least
    neighbour, until every edge is a star's. All steps are joins and aggregations; a hub's edges are joined with one row of
    its own, so adaptive execution can split them over tasks, and its least neighbour is aggregated before the shuffle.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while edges.head(1):
        before = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        moved = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(before, least, large, down)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def near_classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = written(in_arrow(source, partial(_features, shingle=shingle), _FEATURES), "features")
    sets = features.filter("n_shingles > 0 and doc_id is not null")
    held: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """A table that goes before this function returns."""
        held.append(written(df, name))
        return held[-1]

    classes = kept(sets.groupBy("k0", "k1").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("s")).select("k0", "k1", F.col("s.doc_id").alias("node"), F.col("s.n_shingles").alias("n"), F.col("s.sketch").alias("sketch")), "classes")

    def banded(rows: DataFrame) -> DataFrame:
        """A row for each band of each class."""
        others = [c for c in rows.columns if c != "sketch"]
        return rows.select(*others, F.posexplode(F.array(*[F.substring("sketch", i * ROWS + 1, ROWS) for i in range(BANDS)])).alias("band", "key"))

    bands = banded(classes.select("node", "sketch"))
    counts = bands.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = kept(bands.join(counts, ["band", "key"]), "shared")
    # the member that meets the most others over all its buckets leads: in a group of edited copies, their original
    weights = shared.groupBy("node").agg(F.sum("m").alias("w"))
    leaders = shared.join(weights, "node").groupBy("band", "key").agg(F.max(F.struct("w", (-F.col("node")).alias("less"))).alias("s"))
    leaders = leaders.select("band", "key", (-F.col("s.less")).alias("lead"))
    buckets = kept(shared.join(leaders, ["band", "key"]).filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")), "buckets")
    members = buckets.select("a").unionByName(buckets.select(F.col("b").alias("a"))).distinct()
    texts = kept(source.join(members.withColumnRenamed("a", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        # one leader may be in a third of all pairs: its text is copied once for each LEADER_PAIRS of them
        copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / LEADER_PAIRS).cast("int").alias("c"))
        right = copies.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("salt"))
        left = pairs.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("c")).cast("int").alias("salt"))
        sides = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(right, ["b", "salt"])
        return in_arrow(sides.select("a", "b", "x", "y"), partial(_linked, shingle=shingle, percent=percent), "a long, b long")

    def best(pairs: DataFrame) -> DataFrame:
        """For each a, the b of most buckets in common."""
        counted = pairs.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
        return counted.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("less"))).alias("s")).select("a", (-F.col("s.less")).alias("b"))

    # a leader outranks all whom it leads, so that the links form trees; classes under one root of height two get its label
    links = kept(confirmed(kept(best(buckets), "pairs")).groupBy("a").agg(F.min("b").alias("b")), "links")
    above = links.select(F.col("a").alias("b"), F.col("b").alias("root"))
    roots = links.join(above, "b", "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("component"))
    ids = classes.groupBy("node").agg(F.max("n").alias("n"))
    labels = kept(ids.join(roots, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component")), "labels")

    def contracted(links: DataFrame) -> DataFrame:
        """Links between labels, the larger one first."""
        of_a, of_b = (labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b"))
        ends = links.join(of_a, "a").join(of_b, "b").filter("of_a <> of_b")
        return ends.select(F.greatest("of_a", "of_b").alias("a"), F.least("of_a", "of_b").alias("b"))

    labelled = shared.select("band", "key", "node").join(labels, "node")
    per_key = labelled.groupBy("band", "key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    split = per_key.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("n").alias("shingles")).filter("parts > 1")
    open_ = labelled.join(split.select("band", "key", "m", "shingles"), ["band", "key"])
    sides = F.ceil(F.greatest(F.col("m") / CHUNK, F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    cut = open_.select("band", "key", "node", "component", "n", sides.alias("c"), F.pmod(F.xxhash64("node", F.lit(5)), sides).cast("int").alias("side"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda k: F.struct(F.least(k, "side").alias("i"), F.greatest(k, "side").alias("j"))))
    cut = cut.withColumn("p", other).select("band", "key", "node", "component", "n", "side", "p.i", "p.j").join(classes.select("node", "sketch"), "node")

    def alike(group: pa.Table) -> pa.Table:
        return _alike(group, percent)

    def forest(group: pa.Table) -> pa.Table:
        return _forest(group, shingle, percent)

    block = ["band", "key", "i", "j"]
    left = kept(cut.groupBy(*block).applyInArrow(alike, cut.schema), "left")
    links = links.unionByName(kept(left.join(texts, "node").groupBy(*block).applyInArrow(forest, "a long, b long"), "links"))
    joined = components(contracted(links)).select(F.col("node").alias("component"), F.col("component").alias("root"))
    grown = kept(labels.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("root")), "grown")
    least = grown.groupBy("root").agg(F.min("node").alias("component_id"))
    nodes = classes.select("k0", "k1", "node").join(grown.join(least, "root"), "node").select("k0", "k1", "component_id")
    rows = features.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("k0")).alias("k0"), F.when(F.col("n_shingles") > 0, F.col("k1")).alias("k1"))
    named = written(nodes, "nodes")
    dropped(*held)
    return rows.join(named, ["k0", "k1"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
