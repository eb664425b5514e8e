"""Operator 8, suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

Texts are UTF-8 bytes. A byte goes if a `width`-byte string that also starts earlier
(smaller doc_id, or same document, earlier start) covers it. Matches never cross texts.

Strings. Each window of `width` bytes has an anchor, the first of its `mer`-byte grams with the least
hash; equal windows have theirs at the same place. Windows in a row with one anchor form a string
of the bytes that they cover, sent to the bucket that the anchor's hash names. A shard is the part of a task's
texts handled at once.

Transforms. A string is read from its anchor on in symbols of `SYMBOL` bytes, and its suffixes are
those at whole symbols. A shard's transform holds, for the suffixes that begin at the k-th symbol in their
sorted order, the symbol before each: a Burrows-Wheeler transform of all its
strings, a column for each k. Windows reach to the left of their anchors too, so a second transform reads the strings
backwards from there.

Merge. The interleave of a bucket says for each slot of the merged order which shard's next suffix stands
there. It begins as the shards on end; each round deals the preceding symbols of all shards to
the slots and refines the interleave by them, stably: so slots ordered by their suffixes from
symbol k + 1 on become slots ordered from k on. No suffix is compared with another. The common prefixes
of neighbours come along: with equal symbols, a symbol more than the least common prefix between their two slots before; else the
leading bytes that the symbols share.

Repeated intervals. A window that begins d bytes before its anchor has d bytes to the left and
`width` - d to the right. Slots between which no common prefix falls under `width` - d form an interval of
the merged order, those of the backward order an interval by d: windows with one d are equal exactly if they share both
intervals. All but the first of them, in the order of the documents, repeat. Nothing is hashed or compared beside that.

A shard decides its own windows in this way before it sends them: the first copy is sent on and later ones are known to repeat,
so a passage that a third of all texts share reaches its bucket once for each shard. Anchors in very many strings would fill
a bucket with windows that differ: a pass before counts the bytes of each anchor's strings, and of the (at most `HOT`) grams
that bring a bucket's worth or more none is an anchor in windows that have another.

Why not every byte: a transform of all suffixes by single bytes takes `width` rounds over each text. With symbols of eight
bytes at anchors there are some 24 rounds over a fraction of the places, with the same result. A shard's columns are built where its strings
arrive, by a sort in each round: in the order of their suffixes, the symbols pack to 1.6 times the bytes of the strings (2000 documents, zstd), and the shards' permutations
of all rounds, from which the symbols would follow by gathers, to 0.6 times the input at the bucket count of 0.5 GB (0.4 at the entropy of random orders), beside strings of 1.5 times the input:
neither would fit the disk.

Defined results: a null text is empty; texts shorter than `width` keep all; rows with one
doc_id and one text count as one document; rows with one doc_id and other
texts are ordered by a hash of the text; a null doc_id comes before all others; an
empty table gives an empty one; other columns pass through `strip_spans` as they are.
A character that loses some of its bytes leaves the rest as they are, so kept bytes need
not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, blocks, hot_keys, in_arrow, is_hot, mix, rows_of, sliding_min, squeezed, table, text_buffers, window_sums
from .substring_dedup import _runs

WIDTH, MER, LEVEL, SYMBOL = 100, 16, 3, 8
#: Text of one shard; packed strings for which a bucket is made; grams that are no anchors if others are there, at most.
SHARD_BYTES, BUCKET_BYTES, HOT = 4 << 20, 6 << 20, 4096

_SENT = "part long, meta binary, words binary"
_SPANS = "id long, tag long, s int, e int"
_META = 5  # id, tag, start of the string in its text, its bytes, the place of its anchor in it


def symbols_at(text: np.ndarray, places: np.ndarray, step: int = 1) -> np.ndarray:
    """The SYMBOL bytes from each place on, forwards or backwards, as one number that sorts like them."""
    if step > 0:
        return np.ndarray(len(text) - SYMBOL + 1, ">u8", text, strides=(1,))[places].astype(np.uint64)
    return np.ndarray(len(text) - SYMBOL + 1, "<u8", text, strides=(1,))[places - SYMBOL + 1].astype(np.uint64)


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi] for each range, both ends included."""
    out = values[hi].copy()
    level = np.log2(np.maximum(hi - lo + 1, 1)).astype(np.int64)
    part = values
    for k in range(1, int(level.max(initial=0)) + 1):
        part = np.minimum(part[: -(1 << (k - 1))], part[1 << (k - 1) :])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(part[lo[at]], part[hi[at] - (1 << k) + 1])
    return out


def refined(common: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots ordered stably by the symbol before each, and the common prefix of each with the one before it.

    `common` holds the common prefixes of the slots as they were.
    """
    by = np.argsort(symbol, kind="stable")
    symbol = symbol[by]
    out = np.zeros(len(by), common.dtype)
    equal = symbol[1:] == symbol[:-1]
    at = np.flatnonzero(equal) + 1
    out[at] = SYMBOL + _least(common, by[at - 1] + 1, by[at])
    at = np.flatnonzero(~equal) + 1
    differ = symbol[at] ^ symbol[at - 1]
    for i in range(1, SYMBOL):
        out[at] += (differ >> np.uint64(64 - 8 * i)) == 0
    return by, out


def transform(text: np.ndarray, places: np.ndarray, depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """One shard's order of the suffixes at the places, and their common prefixes up to depth bytes or some more."""
    order, common = np.arange(len(places)), np.zeros(len(places), np.int16)
    for at in reversed(range(0, depth, SYMBOL)):
        by, common = refined(common, symbols_at(text, places[order] + step * at, step))
        order = order[by]
    return order, common


def columns(text: np.ndarray, places: np.ndarray, shard: np.ndarray, depth: int, step: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """The transforms of shards that stand on end: for each k the symbols before the suffixes at symbol k + 1, by shard and in their order; and the order of the first suffixes."""
    order = np.arange(len(places))
    out = []
    for at in reversed(range(0, depth, SYMBOL)):
        out.append(symbols_at(text, places[order] + step * at, step))
        # the places stay with their shard
        order = order[np.lexsort((out[-1], shard))]
    return out[::-1], order


def merge(transforms: list[np.ndarray], shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of shards: the number of the shard for each slot, and the slots' common prefixes."""
    interleave, common = shard, np.zeros(len(shard), np.int16)
    for column in reversed(transforms):
        symbol = np.empty(len(column), np.uint64)
        symbol[np.argsort(interleave, kind="stable")] = column
        by, common = refined(common, symbol)
        interleave = interleave[by]
    return interleave, common


def merged(text: np.ndarray, places: np.ndarray, shard: np.ndarray, depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """As `transform`, for the strings of shards that stand on end."""
    parts, order = columns(text, places, shard, depth, step)
    interleave, common = merge(parts, shard)
    out = np.empty(len(order), np.int64)
    out[np.argsort(interleave, kind="stable")] = order
    return out, common


def repeated_windows(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, number: np.ndarray, width: int, mer: int, shard: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings and places of the windows equal to one in a string of a smaller number; and the merged order of the strings.

    String i has the windows from lo to hi, all round the anchor at place; strings with one number are the
    same string of one document. `text` has `width` + SYMBOL more bytes at either end.
    """

    def ordered(at: np.ndarray, depth: int, step: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return transform(text, at, depth, step) if shard is None else merged(text, at, shard[some], depth, step)

    every = np.arange(len(lo))
    order, common = ordered(place, width, 1, every)
    most = common.copy()
    most[:-1] = np.maximum(most[:-1], most[1:])  # with any other string
    right, rank = np.empty(len(lo), np.int64), np.empty(len(lo), np.int64)
    right[order], rank[order] = most, every
    first, last = np.maximum(place - hi, width - right), place - lo  # bytes before the anchor
    some = np.flatnonzero(first <= last)
    strings, windows = [], []
    if len(some):
        back, back_common = ordered(place[some] - 1, max(width - mer, 1), -1, some)
        back_most = back_common.copy()
        back_most[:-1] = np.maximum(back_most[:-1], back_most[1:])
        left, back_rank = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
        left[back], back_rank[back] = back_most, np.arange(len(some))
        first, last = first[some], np.minimum(last[some], left)
        for d in range(int(first.min()), int(last.max()) + 1):
            own = np.flatnonzero((first <= d) & (d <= last))
            if len(own) < 2:
                continue
            # the intervals that the string is in, to the right and to the left
            interval = np.cumsum(common < width - d)[rank[some[own]]] * (len(some) + 1) + np.cumsum(back_common < d)[back_rank[own]]
            by = np.lexsort((number[some[own]], interval))
            own, interval = own[by], interval[by]
            begins = np.maximum.accumulate(np.where(np.append(True, interval[1:] != interval[:-1]), np.arange(len(own)), 0))
            again = some[own[number[some[own]] > number[some[own[begins]]]]]
            strings.append(again)
            windows.append(place[again] - d)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *strings]), np.concatenate([none, *windows]), order


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, mer: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of windows in a row with one anchor: first and last window, anchor's place, and its hash."""
    long = np.flatnonzero(np.diff(offsets) >= width)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    grams = window_sums(_BYTE[data], mer)
    # 31 bits of the hash after a bit for hot grams, then the place: the first of equal grams is the least
    least = (grams >> np.uint64(33) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    if hot is not None and len(hot):
        least[is_hot(grams, hot)] |= np.uint64(1 << 63)
    least = sliding_min(least, width - mer + 1)
    at = _windows(offsets[:-1][long], offsets[1:][long] - width)
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    hi = np.concatenate([lo[1:], [len(at)]]) - 1
    return at[lo], at[hi], place[lo], grams[place[lo]]


def _windows(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All window places from each lo to its hi."""
    n = hi - lo + 1
    before = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(lo - before[:-1], n) + np.arange(before[-1])


def _send(ids: np.ndarray, tags: np.ndarray, data: np.ndarray, offsets: np.ndarray, parts: int, width: int, mer: int, hot: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """A shard: spans known to repeat, and for each bucket the sorted strings."""
    by = np.lexsort((tags, ids))
    if (by[1:] != by[:-1] + 1).any():  # texts in the order of the documents
        data = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in by.tolist()])
        offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[by])])
        ids, tags = ids[by], tags[by]
    same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (tags[1:] == tags[:-1])])
    lo, hi, place, low = anchors(data, offsets, width, mer, hot)
    fresh = ~same[rows_of(offsets, lo)]  # rows of one document and text count once
    lo, hi, place, low = lo[fresh], hi[fresh], place[fresh], low[fresh]
    if not len(lo):
        return
    pad = width + SYMBOL
    _, suspects, order = repeated_windows(np.pad(data, pad), lo + pad, hi + pad, place + pad, np.arange(len(lo)), width, mer)
    again = np.zeros(int(hi[-1]) + 1, bool)
    again[suspects - pad] = True
    zip_up = zstandard.ZstdCompressor(level=LEVEL).compress
    if again.any():
        gone = np.flatnonzero(again)
        row = rows_of(offsets, gone)
        cut = np.concatenate([[True], (gone[1:] > gone[:-1] + width) | (row[1:] != row[:-1])])
        first = np.flatnonzero(cut)
        last = np.concatenate([first[1:], [len(gone)]]) - 1
        of = row[first]
        known = [ids[of], tags[of], gone[first] - offsets[of], gone[last] + width - offsets[of]]
        yield int(mix(low[:1])[0] % np.uint64(parts)), zip_up(_planes(known)), b""
    # what is left of each string: the stretches of windows not seen before
    left = np.cumsum(np.concatenate([[0], ~again]))
    whole = left[hi + 1] - left[lo] == hi - lo + 1
    some = (left[hi + 1] > left[lo]) & ~whole
    rank = np.empty(len(lo), np.int64)
    rank[order] = np.arange(len(lo))
    pick = np.flatnonzero(whole)
    a, b, of = lo[pick], hi[pick], pick
    if some.any():
        at = _windows(lo[some], hi[some])
        of_at = np.repeat(np.flatnonzero(some), (hi - lo + 1)[some])
        keep = ~again[at]
        p, q = _runs(keep, np.concatenate([[False], (at[1:] == at[:-1] + 1) & (of_at[1:] == of_at[:-1])]))
        a, b, of = np.concatenate([a, at[p]]), np.concatenate([b, at[q]]), np.concatenate([of, of_at[p]])
    bucket = (mix(low[of]) % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((rank[of], bucket))
    a, b, of, bucket = a[by], b[by], of[by], bucket[by]
    row = rows_of(offsets, a)
    meta = [ids[row], tags[row], a - offsets[row], b - a + width, place[of] - a]
    text, s, e = data.tobytes(), a.tolist(), (b + width).tolist()
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[i]), zip_up(_planes([m[i:j] for m in meta])), zip_up(b"".join([text[s[k] : e[k]] for k in range(i, j)]))


def _planes(columns: list[np.ndarray]) -> bytes:
    """Numbers by the order of their bytes, which packs well."""
    return b"".join([np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns])


def _columns(planes: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(n, 8, -1).transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def _map(batches: Iterator[pa.RecordBatch], parts: int, width: int, mer: int, hot: np.ndarray, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        tags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = text_buffers(batch.column(2))
        for lo, hi in blocks(offsets, shard_bytes):
            out = list(_send(ids[lo:hi], tags[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], parts, width, mer, hot))
            if out:
                part, meta, words = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(meta, pa.binary()), pa.array(words, pa.binary())], names=["part", "meta", "words"])


def _bucket(group: pa.Table, width: int, mer: int) -> pa.Table:
    """Merge the shards of a bucket; the spans of windows equal to one that starts earlier."""
    unzip = zstandard.ZstdDecompressor().decompress
    out, metas, texts = [np.zeros((4, 0), np.int64)], [np.zeros((_META + 1, 0), np.int64)], []
    for i, (meta, words) in enumerate(zip(group.column("meta").to_pylist(), group.column("words").to_pylist(), strict=True)):
        planes = _columns(unzip(meta), _META if words else 4)
        if words:
            metas.append(np.concatenate([planes, np.full((1, planes.shape[1]), i)]))
            texts.append(unzip(words))
        else:
            out.append(planes)
    pad = bytes(width + SYMBOL)
    ids, tags, start, size, anchor, shard = np.concatenate(metas, axis=1)
    shard = shard.astype(np.uint16 if len(texts) < 1 << 16 else np.uint32)  # short numbers sort by their digits
    text = np.frombuffer(b"".join([pad, *texts, pad]), np.uint8)
    del texts, metas
    if len(ids):
        begin = len(pad) + np.cumsum(size) - size
        # the order of the documents; rows of one document and text may come from several shards
        by = np.lexsort((start + anchor, tags, ids))
        key = np.stack([ids, tags, start + anchor])[:, by]
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(np.append(False, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        string, window, _ = repeated_windows(text, begin, begin + size - width, begin + anchor, number, width, mer, shard)
        where = start[string] + window - begin[string]
        by = np.lexsort((where, number[string]))
        string, where = string[by], where[by]
        p, q = _runs(np.ones(len(where), bool), np.append(False, (number[string][1:] == number[string][:-1]) & (where[1:] == where[:-1] + 1))[: len(where)])
        out.append(np.stack([ids[string[p]], tags[string[p]], where[p], where[q] + width]))
    ids, tags, s, e = np.concatenate(out, axis=1)
    return pa.table({"id": ids, "tag": tags, "s": s.astype(np.int32), "e": e.astype(np.int32)})


def _keyed(docs: DataFrame) -> DataFrame:
    """docs' rows with an id (null: the least number) and a tag that tells texts and null ids apart."""
    tag = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit(""))), 32)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), tag.alias("tag"), F.struct("*").alias("row"))


def _anchored(batches: Iterator[pa.RecordBatch], width: int, mer: int, shard_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bytes of text, anchors' hashes, and the bytes of their strings, for each shard."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for i, j in blocks(offsets, shard_bytes):
            lo, hi, _, low = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, mer)
            yield int(offsets[j] - offsets[i]), low, hi - lo + width


def repeated_spans(docs: DataFrame, width: int = WIDTH, mer: int = MER, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Spans (id, tag, s, e) of bytes that windows which also start earlier cover; spans may overlap."""
    if not 1 <= mer <= width:
        raise ValueError("mer is from 1 to width")
    total, hot = hot_keys(docs, partial(_anchored, width=width, mer=mer, shard_bytes=shard_bytes), bucket_bytes, HOT)
    # a string repeats width - 1 bytes, so packed text is about four times the input
    parts = max(8, -(-4 * total // bucket_bytes))
    sent = in_arrow(_keyed(docs).select("id", "tag", F.col("row.text").alias("text")), partial(_map, parts=parts, width=width, mer=mer, hot=hot, shard_bytes=shard_bytes), _SENT)

    def bucket(group: pa.Table) -> pa.Table:
        return _bucket(group, width, mer)

    return sent.groupBy("part").applyInArrow(bucket, _SPANS)


def _strip(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, spans = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, found in zip(texts, spans, strict=True):
            data = unzip(text.as_py())
            left, at, gone, runs = [], 0, 0, 0
            for span in sorted((x["s"], x["e"]) for x in found.as_py() or ()):
                if span[0] > at or not runs:
                    left.append(data[at : span[0]])
                    runs += 1
                    at = span[0]
                if span[1] > at:
                    gone += span[1] - at
                    at = span[1]
            left.append(data[at:])
            rest = b"".join(left)
            n_bytes.append(len(data))
            n_removed.append(gone)
            n_spans.append(runs)
            kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())], names=[*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept"])


def strip_spans(docs: DataFrame, width: int = WIDTH, mer: int = MER, digest: bool = False, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): docs' row as a struct without its text, and the kept bytes, or
    their SHA-256 if digest."""
    spans = repeated_spans(docs, width, mer, shard_bytes, bucket_bytes).groupBy("id", "tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    others = [c for c in docs.columns if c != "text"]
    keyed = _keyed(docs).select("id", "tag", F.struct(*[F.col(f"row.`{c}`") for c in others]).alias("row"), F.col("row.text").alias("text"))
    keyed = squeezed(keyed)
    joined = keyed.join(spans, ["id", "tag"], "left").select("row", "text", "spans")
    schema = T.StructType([joined.schema["row"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.StringType() if digest else T.BinaryType())])
    return in_arrow(joined, partial(_strip, digest=digest), schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return strip_spans(docs, digest=True).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
