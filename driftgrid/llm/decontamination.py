"""Operator 9, benchmark decontamination: latent semantic retrieval.

Texts are lower-cased over A-Z and read as words of letters and digits, hashed to `TERMS`
terms. The corpus is a matrix of blocks of `BLOCK` words by terms, weighted by
inverse document frequencies. Terms in more than `COMMON` of the documents (20 at least) weigh nothing, unless
some items have them and no more than `COMMON` of the items do: a leak may stand in a third of all documents. Terms that
any item has weigh `FLOOR` at least, so no item's vector is zero for its terms' commonness. Its leading right
singular vectors come from a distributed randomised SVD: tasks add their blocks, with random signs, to
`SKETCH` random rows, the rows of all tasks are summed, and the driver takes the singular vectors of
that sketch. It holds SKETCH x TERMS numbers, whatever the size of the corpus. Counts
and sketch cover all documents, in one scan.

A passage, two blocks in a row, is projected by adding the rows of its words, scaled by
the singular values. Items are cut into passages of at most `ITEM` words. Every passage whose cosine with an
item's passage is `NEAR` or more is a candidate, and each is checked; in a run of adjoining blocks the cosine orders
the checks. The cosine of a short or reworded item inside other text can be under `NEAR`, so exact counts give further candidates for
every item: of an item of L words a leak holds K = `COVER_ANSWER` * L or more, so of all but its K - j most frequent
words it holds j or more. Every block in which j of these begin within a span of L + min(L, `BLOCK`) words is
checked with the words that far around it, and what passes again in each such span there, as common words alone can make
up half of an item in a wider stretch by chance; no leak within such a span is lost, whatever its cosine or weights. The same count
over the words to be checked spares the check of hits that cannot be leaks. The cosines are looked up in an index: there is a centre for `CLUSTER` item vectors
and each vector is kept at its `SPILL` nearest centres, as hits lie all round a block; a block is compared with what its `PROBES` nearest centres hold, or one in `SHARE` of them if that
is more, and with all items where there are no more centres. A test holds the recall at 20,000 vectors, and how much is compared, to the full product. The benchmark is a set of queries: items go to the tasks in groups of at most `GROUP` passages, `GROUPS` groups in one
scan of the texts; more take another scan, after which the groups before are let go, so what is broadcast is bounded.

A candidate is confirmed on the words around it by the longest common subsequence with
the whole item: it is a leak if this covers `COVER` of the item's words, or
`COVER_ANSWER` of them and `ANSWER` of those of the item's answer (its last
sentence, or its last quarter if it has one sentence only). `latent` tells whether the document was a candidate for the item by cosine, or by counts alone; `counts` switches the counts off. Retrieval and confirmation are one more scan; no text is
shuffled.

Defined results: null and empty texts and items have no words and match nothing; an item
of under `LEAST` words is not searched for; repeated rows are reported each; a document that holds an
item at several places is reported once, at the place of the longest subsequence, in a
tie the first run's, there the highest cosine's; items that share an item_id are searched for each; empty tables give an empty one; other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, in_arrow, mix, runs_of, table, text_buffers, word_hashes, written

TERMS, RANK, SKETCH, BLOCK, ITEM, NEAR, COMMON, GROUP = 1 << 14, 96, 192, 16, 48, 0.34, 0.05, 20_000
#: Groups of items for one scan of the texts; item vectors for a centre, centres that hold a vector, and centres looked into for each block: so many, or one in so many.
GROUPS, CLUSTER, SPILL, PROBES, SHARE = 4, 16, 3, 48, 18
FLOOR = 0.1
COVER, COVER_ANSWER, ANSWER, LEAST = 0.7, 0.5, 0.8, 5
#: Words and blocks handled at once.
CHUNK, CHUNK_BLOCKS = 1 << 14, 2048
#: Counted words held at once, and the bits of a place in their codes.
COUNTED, PLACE = 1 << 22, 40

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the n + 1 bounds of the texts."""
    data = LOWER[data]
    inside = _WORD[data]
    starts, ends = runs_of(inside, offsets)
    return word_hashes(np.where(inside, data, np.uint8(32)), starts, ends), np.searchsorted(starts, offsets)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_ids, word hashes and bounds of some texts at once."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in blocks(offsets):
            hashes, bounds = word_ids(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield batch.column(0).slice(lo, hi - lo), hashes, bounds


def _block_bounds(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of all rows begin, and the row of each."""
    count = -(-np.diff(bounds) // BLOCK)
    row = np.repeat(np.arange(len(count)), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    return bounds[row] + BLOCK * (np.arange(len(row)) - first[row]), row


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row 0: documents that hold each term, and documents; other rows: blocks added up with random signs."""
    held = np.zeros(TERMS + 1)
    total = np.zeros(SKETCH * TERMS, np.float32)
    for ids, hashes, bounds in _texts(batches):
        terms = (hashes % np.uint64(TERMS)).astype(np.int64)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        held[:TERMS] += np.bincount(np.unique(row * TERMS + terms) % TERMS, minlength=TERMS)
        held[TERMS] += len(bounds) - 1
        begin, of = _block_bounds(bounds)
        # a block's row and sign depend on its document and place, so copies do not add up in step
        seed = mix(mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))[of] + begin.astype(np.uint64) - bounds[:-1][of].astype(np.uint64))
        place = ((seed >> np.uint64(1)) % np.uint64(SKETCH)).astype(np.int64) * TERMS
        size = np.diff(np.append(begin, len(terms)))
        cells, count = np.unique((np.repeat(place, size) + terms) * 2 + np.repeat((seed & np.uint64(1)).astype(np.int64), size), return_counts=True)
        np.add.at(total, cells >> 1, np.where(cells & 1, count, -count).astype(np.float32))
    # a task of few blocks sends the cells that it has, not the sketch
    for lo in (-1, *range(0, SKETCH, 16)):
        part = [(-1, held)] if lo < 0 else list(enumerate(total.reshape(SKETCH, TERMS)[lo : lo + 16], lo))
        cells = [np.flatnonzero(r) for _, r in part]
        yield pa.RecordBatch.from_arrays([pa.array([at + 1 for at, _ in part], pa.int32()), pa.array([c.astype(np.int32).tobytes() for c in cells], pa.binary()), pa.array([r[c].astype(np.float64).tobytes() for (_, r), c in zip(part, cells, strict=True)], pa.binary())], names=["row", "cells", "data"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rows of one partition; all of a row are in one."""
    total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(TERMS + 1))
    for batch in batches:
        for at, cells, data in zip(*(batch.column(i) for i in range(3)), strict=True):
            total[at.as_py()][np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(data.as_buffer(), np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["row", "data"])


def latent_space(docs: DataFrame, in_items: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """TERMS x RANK weights that project a passage, by adding them over its words, on scaled singular vectors; documents that hold each term."""
    # SKETCH + 1 rows of TERMS numbers
    parts = in_arrow(docs, _sketched, "row int, cells binary, data binary").repartition("row")
    rows = in_arrow(parts, _summed, "row int, data binary").collect()
    found = {r["row"]: np.frombuffer(r["data"], np.float64) for r in rows}
    if not found or not found[0][TERMS]:
        return np.zeros((TERMS, RANK), np.float32), np.zeros(TERMS)
    held, n = found[0][:TERMS], found[0][TERMS]
    special = (in_items > 0) & (in_items <= max(1, COMMON * n_items))
    idf = np.log((1 + n) / (1 + held)) * ((held <= max(20, COMMON * n)) | special)
    idf = np.where(in_items > 0, np.maximum(idf, FLOOR), idf)
    sketch = np.stack([found[i + 1][:TERMS] for i in range(SKETCH)]) * idf
    values, vectors = np.linalg.eigh(sketch @ sketch.T)
    values, vectors = values[::-1][:RANK], vectors[:, ::-1][:, :RANK]
    scale = np.where(values > 1e-9 * max(values.max(), 1e-30), 1 / np.maximum(values, 1e-30), 0)
    return (idf[:, None] * (sketch.T @ vectors) * scale).astype(np.float32), held


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def passages(weights: np.ndarray, used: np.ndarray, terms: np.ndarray, begin: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Unit vectors of the passages that begin at each block: it and the next one of its row."""
    keep = np.flatnonzero(used[terms])
    block = np.searchsorted(begin, keep, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else block
    edges = np.append(first, len(keep))
    out = np.zeros((len(begin), weights.shape[1]), np.float32)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CHUNK)))
        a, b = int(edges[lo]), int(edges[hi])
        out[block[first[lo:hi]]] = np.add.reduceat(weights[terms[keep[a:b]]], first[lo:hi] - a, axis=0)
        lo = hi
    next_to = np.flatnonzero(row[1:] == row[:-1])
    both = out.copy()
    both[next_to] += out[next_to + 1]
    return _unit(both)


def clusters(vectors: np.ndarray, size: int = CLUSTER, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """A centre for about `size` unit vectors each, and the `SPILL` nearest centres of each vector, the nearest first."""
    centres = vectors[np.linspace(0, len(vectors) - 1, max(1, len(vectors) // size)).astype(np.int64)]
    parts = range(0, len(vectors), CHUNK_BLOCKS)
    for _ in range(rounds):
        of = np.concatenate([np.argmax(vectors[lo : lo + CHUNK_BLOCKS] @ centres.T, axis=1) for lo in parts])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, vectors)
        centres = np.where(np.bincount(of, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres, np.concatenate([np.argsort(-(vectors[lo : lo + CHUNK_BLOCKS] @ centres.T), axis=1, kind="stable")[:, :SPILL] for lo in parts])


def near_items(rows: np.ndarray, vectors: np.ndarray, centres: np.ndarray, of: np.ndarray, near: float, probes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, vector, cosine) of the pairs with a cosine of `near` or more among the vectors that the centres nearest to each row hold."""
    probes = probes or max(PROBES, len(centres) // SHARE)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    members = np.argsort(of.ravel(), kind="stable") // of.shape[1]
    edges = np.append(0, np.cumsum(np.bincount(of.ravel(), minlength=len(centres)))).tolist()
    for lo in range(0, len(rows), CHUNK_BLOCKS):
        part = rows[lo : lo + CHUNK_BLOCKS]
        if len(centres) <= probes:
            cosines = part @ vectors.T
            row, vector = np.nonzero(cosines >= near)
            found.append((row + lo, vector, cosines[row, vector]))
            continue
        nearest = np.argpartition(part @ centres.T, -probes, axis=1)[:, -probes:].ravel()
        asking = np.argsort(nearest, kind="stable") // probes
        ends = np.append(0, np.cumsum(np.bincount(nearest, minlength=len(centres)))).tolist()
        codes, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for c in range(len(centres)):
            at, own = asking[ends[c] : ends[c + 1]], members[edges[c] : edges[c + 1]]
            if not len(at) or not len(own):
                continue
            cosines = part[at] @ vectors[own].T
            i, j = np.nonzero(cosines >= near)
            codes.append(at[i] * len(vectors) + own[j])
            hits.append(cosines[i, j])
        # several of a row's centres may hold one vector
        code, first = np.unique(np.concatenate(codes), return_index=True)
        found.append((code // len(vectors) + lo, code % len(vectors), np.concatenate(hits)[first]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _by_runs(item: np.ndarray, block: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The order of hits by item, then by run of adjoining blocks, the best of each run first."""
    order = np.lexsort((block, item))
    fresh = np.concatenate([[True], (item[order][1:] != item[order][:-1]) | (block[order][1:] != block[order][:-1] + 1)])
    return order[np.lexsort((-cosine[order], np.cumsum(fresh)))]


def word_index(items: list[tuple[int, list[int], int]], held: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted words, bounds of their items and these; by item, how many of its words a leak holds at least, its span and its length."""
    found, least, span = [], [], []
    for at, (_, words, _) in enumerate(items):
        n, full = len(words), math.ceil(COVER_ANSWER * len(words))
        least.append(-(-full // 3))
        span.append(n + min(n, BLOCK))
        own = np.unique(np.array(sorted(words, key=lambda w: held[w % TERMS])[: n - full + least[-1]], np.uint64))
        found.append((own, np.full(len(own), at, np.int64)))
    words, of = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((of, words))
    keys, first = np.unique(words[order], return_index=True)
    return keys, np.append(first, len(order)), of[order], np.array(least), np.array(span), np.array([len(words) for _, words, _ in items])


def _counted(index: tuple[np.ndarray, ...], hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For ranges of items, the sorted codes (item << PLACE) + place of the words that count for them."""
    keys, first, of, least = index[:4]
    low = np.zeros(1 << 16, bool)
    low[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    place = np.flatnonzero(low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    key = np.minimum(np.searchsorted(keys, hashes[place]), len(keys) - 1)
    same = keys[key] == hashes[place]
    place, key = place[same], key[same]
    counts = np.bincount(of, np.repeat(np.bincount(key, minlength=len(keys)), np.diff(first)), minlength=len(least))
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // COUNTED, prepend=-1)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(least)], strict=True):
        inside = (of >= lo) & (of < hi)
        size = np.add.reduceat(inside.astype(np.int64), first[:-1])
        begin, n = np.cumsum(size) - size, size[key]
        item = of[inside][np.repeat(begin[key] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        # an item has a passage at least, so there are no more than GROUP of them
        order = np.argsort((item - lo).astype(np.uint16), kind="stable")
        yield lo, hi, ((item << PLACE) + np.repeat(place, n))[order]


def candidates(index: tuple[np.ndarray, ...], hashes: np.ndarray, bounds: np.ndarray, begin: np.ndarray, row: np.ndarray, block: np.ndarray, item: np.ndarray, cosine: np.ndarray, counts: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(block, item, cosine, first and last word to check) of the hits, and of the blocks found by counts (cosine -2), for ranges of items; without `counts`, of the hits alone."""
    least, span, size = index[3:]
    ends = lambda block, before, after: (np.maximum(bounds[row[block]], begin[block] - before), np.minimum(bounds[row[block] + 1], begin[block] + after))
    for lo, hi, code in _counted(index, hashes):
        own = np.flatnonzero((item >= lo) & (item < hi))
        margin = np.maximum(BLOCK, size[item[own]])
        a, b = ends(block[own], margin, 2 * BLOCK + margin)
        base = item[own] << PLACE
        enough = np.searchsorted(code, base + b) - np.searchsorted(code, base + a) >= least[item[own]]
        own = own[enough]
        yield block[own], item[own], cosine[own], a[enough], b[enough]
        if not counts:
            continue
        of, place = code >> PLACE, code & ((1 << PLACE) - 1)
        last = np.arange(len(code)) + least[of] - 1
        at = np.flatnonzero(last < len(code))
        at = at[code[last[at]] - code[at] < span[of[at]]]
        of, first, last = of[at], np.searchsorted(begin, place[at], "right") - 1, np.searchsorted(begin, place[last[at]], "right") - 1
        cells = np.unique((of * len(begin) + first)[row[first] == row[last]])
        of, first = cells // len(begin), cells % len(begin)
        yield first, of, np.full(len(of), -2.0), *ends(first, span[of], BLOCK + span[of])


def common_words(words: list[int], places: dict[int, int], full: int) -> int:
    """Length of the longest common subsequence; places: for each word of the item, the bits of its positions."""
    left = full
    for word in words:
        hit = left & places.get(word, 0)
        if hit:
            left = ((left + hit) | (left - hit)) & full
    return full.bit_count() - left.bit_count()


def _is_leak(common: int, answer: int, size: int, last: int) -> bool:
    return common >= COVER * size or common >= COVER_ANSWER * size and answer >= ANSWER * last


def answer_words(text: str) -> int:
    """How many of the item's last words are its answer."""
    n = len(word_ids(*_buffers(text))[0])
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if len(word_ids(*_buffers(p))[0])]
    return len(word_ids(*_buffers(parts[-1]))[0]) if len(parts) > 1 else max(1, n // 4)


def _buffers(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def _masks(words: list[int]) -> tuple[dict[int, int], int]:
    places: dict[int, int] = {}
    for i, word in enumerate(words):
        places[word] = places.get(word, 0) | 1 << i
    return places, (1 << len(words)) - 1


def _leaks(batches: Iterator[pa.RecordBatch], weights, groups: list, near: float, counts: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Leaks of some groups of items into (doc_id, text)."""
    w = weights.value
    used = w.any(axis=1)
    masks = [[(*_masks(own), *_masks(own[-last:])) for _, own, last in g.value[0]] for g in groups]
    for ids, hashes, bounds in _texts(batches):
        if not len(hashes):
            continue
        begin, row = _block_bounds(bounds)
        rows = passages(w, used, (hashes % np.uint64(TERMS)).astype(np.int64), begin, row)
        for group, own_masks in zip(groups, masks, strict=True):
            found = _leaks_of(group.value, own_masks, rows, hashes, bounds, begin, row, ids.to_pylist(), near, counts)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def _leaks_of(group, masks: list, rows: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, begin: np.ndarray, row: np.ndarray, doc_ids: list, near: float, counts: bool) -> list[tuple]:
    """Leaks of a group of items into some texts."""
    items, vectors, of_vector, centres, cluster, index = group
    block, vector, cosine = near_items(rows, vectors, centres, cluster, near)
    item = of_vector[vector]
    # the code of a block skips one between rows, so that runs end there
    order = _by_runs(item, block + row[block], cosine) if len(item) else item
    found: dict[tuple[int, int], tuple] = {}
    latent = set()
    for part_ in candidates(index, hashes, bounds, begin, row, block[order], item[order], cosine[order], counts):
        for block_, item_, cosine_, a, b in zip(*(c.tolist() for c in part_), strict=True):
            i = int(row[block_])
            if cosine_ >= -1:
                latent.add((i, item_))
            item_id, own, last = items[item_]
            places, full, answer, full_answer = masks[item_]
            part = [x for x in hashes[a:b].tolist() if x in places]
            if len(part) < COVER_ANSWER * len(own):
                continue
            held = 0  # the item's words that are here at all: no subsequence holds more of them, or of its answer
            for x in set(part):
                held |= places[x]
            best = found.get((i, item_), (0,) * 5)[4]
            if held.bit_count() <= best or not _is_leak(held.bit_count(), (held >> len(own) - last).bit_count(), len(own), last):
                continue
            n = common_words(part, places, full)
            if n <= best or n < COVER_ANSWER * len(own):
                continue
            m = common_words(part, answer, full_answer)
            if not _is_leak(n, m, len(own), last):
                continue
            if cosine_ < -1:  # found by counts
                near_by, reach = hashes[a:b].tolist(), int(index[4][item_])
                spans = [(at, [x for x in near_by[at : at + reach] if x in places]) for at, x in enumerate(near_by) if x in places]
                checked = [(common_words(own_part, places, full), -at, common_words(own_part, answer, full_answer)) for at, own_part in spans]
                n, at, m = max((c for c in checked if _is_leak(c[0], c[2], len(own), last)), default=(0, 0, 0))
                a, cosine_ = a - at, float((vectors[of_vector == item_] @ rows[block_]).max())
            if n > found.get((i, item_), (0,) * 5)[4]:
                found[i, item_] = (doc_ids[i], item_id, a - int(bounds[i]), len(own), n, last, m, cosine_)
    return [(*leak, pair in latent) for pair, leak in found.items()]


_KINDS = [("doc_id", pa.int64(), "long"), ("item_id", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("item_words", pa.int64(), "long"), ("common_words", pa.int64(), "long"), ("answer_words", pa.int64(), "long"), ("answer_common", pa.int64(), "long"), ("cosine", pa.float64(), "double"), ("latent", pa.bool_(), "boolean")]


def _item_groups(benchmark: DataFrame) -> Iterator[list[tuple[int, list[int], int]]]:
    """Items in groups of a bounded number of passages: item_id, hashes of the words, number of answer words."""
    held: list[tuple[int, list[int], int]] = []
    size = 0
    for row in benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        words = word_ids(*_buffers(row["text"]))[0].tolist()
        if len(words) < LEAST:
            continue
        if held and size + len(words) // ITEM + 1 > GROUP:
            yield held
            held, size = [], 0
        held.append((row["item_id"], words, min(len(words), answer_words(row["text"]))))
        size += len(words) // ITEM + 1
    if held:
        yield held


def item_passages(items: list[tuple[int, list[int], int]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the passages of all items, and the places of their items."""
    rows, of = [], []
    for at, (_, words, _) in enumerate(items):
        terms = (np.array(words, np.uint64) % np.uint64(TERMS)).astype(np.int64)
        parts = -(-len(terms) // ITEM)
        for k in range(parts):
            rows.append(weights[terms[len(terms) * k // parts : len(terms) * (k + 1) // parts]].sum(axis=0))
            of.append(at)
    return _unit(np.array(rows, np.float32)), np.array(of, np.int64)


def find_leaks(docs: DataFrame, benchmark: DataFrame, near: float = NEAR, counts: bool = True) -> DataFrame:
    """(doc_id, item_id, first_word, item_words, common_words, answer_words, answer_common, cosine, latent) of each leak."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([(name, kind) for name, kind, _ in _KINDS])
    out = spark.createDataFrame([], ", ".join(f"{name} {kind}" for name, _, kind in _KINDS))
    in_items, n_items = np.zeros(TERMS), 0
    for items in _item_groups(benchmark):
        for words in {tuple(words) for _, words, _ in items}:
            in_items[np.unique(np.array(words, np.uint64) % np.uint64(TERMS)).astype(np.int64)] += 1
            n_items += 1
    if not n_items:
        return out
    weights, held = latent_space(texts, in_items, n_items)
    sent = spark.sparkContext.broadcast(weights)
    groups: list = []

    def scan() -> DataFrame:
        return in_arrow(texts, partial(_leaks, weights=sent, groups=list(groups), near=near, counts=counts, schema=schema), out.schema)

    for items in _item_groups(benchmark):
        if len(groups) == GROUPS:  # what is broadcast at once is bounded: this scan is done before the next groups are sent
            out = out.unionByName(written(scan(), "leaks"))
            for group in groups:
                group.destroy()
            groups = []
        vectors, of_vector = item_passages(items, weights)
        groups.append(spark.sparkContext.broadcast((items, vectors, of_vector, *clusters(vectors), word_index(items, held))))
    return out.unionByName(scan())


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("cosine")
