"""Operator 5, substring dedup: super-k-mer partitioning of word windows.

A window is `width` consecutive words of one document. Consecutive windows that
share their minimiser (the least hash of their `mmer`-word grams) travel as one
packed string to the bucket that the minimiser names; equal windows have equal
minimisers, so every bucket can count its windows by itself. In the bucket, windows
are sorted by a hash and neighbours are compared byte by byte, so counts are exact.

Each task first counts its own batch in the same way (a combiner): a window that
occurs twice there is known to repeat, and only one copy of it is sent on. So a
passage that a third of all documents share reaches its bucket once for each
batch, not once for each document. A gram that is common among windows which differ would fill one
bucket: a pass before counts the bytes of each minimiser's super-k-mers, and the grams that bring a bucket's worth or
more (at most `HOT`) are minimisers only of windows that have no other.

Every word covered by a window whose words also start anywhere else, in the same
document or another, is removed from all its places.

Defined results: a null text has no words; a text with fewer than `width` words
keeps all; a repeated row counts as another document, so its windows repeat;
overlapping windows of one document that are equal (ties) repeat as well; an empty
table gives an empty one; a null doc_id is matched as a value; further columns are
passed through by `strip_repeats` as they are.
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

from .common import IS_SPACE, blocks, hot_keys, in_arrow, is_hot, mix, rows_of, sliding_min, squeezed, table, text_buffers, window_sums, word_hashes, words_of

WIDTH, MMER = 35, 4
#: Text handled at once by the combiner, and packed text for which a bucket is made.
BATCH_BYTES, BUCKET_BYTES, HOT = 4 << 20, 4 << 20, 4096

_SENT = "part long, meta binary, words binary"
_RUNS = "id long, tag long, s int, e int"


def repeated(text: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that begin at the words `at` (ascending): occurs twice or more; occurred before.

    `keys` are hashes of the windows; equal hashes are confirmed on the text, whose
    words are separated by single spaces.
    """
    twice, before = np.zeros(len(at), bool), np.zeros(len(at), bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return twice, before
    group = np.concatenate([[True], ~same])
    first = order[np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))]
    member = np.concatenate([[False], same])
    mine, other = order[member], first[member]
    by = np.argsort(mine, kind="stable")
    mine, other = mine[by], other[by]
    # runs in which both windows move on by one word are confirmed in one comparison
    a, b = at[mine], at[other]
    cut = np.flatnonzero((a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]])
    a0, a1 = starts[a[lo]].tolist(), ends[a[hi - 1] + width - 1].tolist()
    b0, b1 = starts[b[lo]].tolist(), ends[b[hi - 1] + width - 1].tolist()
    good = [text[p:q] == text[r:s] for p, q, r, s in zip(a0, a1, b0, b1, strict=True)]
    if all(good):
        before[mine] = True
        twice[mine] = twice[other] = True
        return twice, before
    # unequal windows with one hash: count the windows of these hashes by their words
    seen: dict[bytes, int] = {}
    doubtful = np.isin(keys, keys[mine])
    for i in np.flatnonzero(doubtful).tolist():
        words = text[starts[at[i]] : ends[at[i] + width - 1]]
        j = seen.setdefault(words, i)
        if j != i:
            before[i] = twice[i] = twice[j] = True
    return twice, before


def _runs(flags: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last indices of the runs of flags; joined: the entry follows on from the one before."""
    if not flags.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = flags & ~np.concatenate([[False], flags[:-1] & joined[1:]])
    closes = flags & ~np.concatenate([flags[1:] & joined[1:], [False]])
    return np.flatnonzero(opens), np.flatnonzero(closes)


def _normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with one space for each run of white space, and the words' new places."""
    space = IS_SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return np.where(space, np.uint8(32), data)[keep].tobytes(), place[starts], place[ends]


def minimisers(hashes: np.ndarray, at: np.ndarray, width: int, mmer: int, hot: np.ndarray | None = None) -> np.ndarray:
    """The least gram of each window, hot ones last."""
    grams = window_sums(hashes, mmer) >> np.uint64(1)
    if hot is not None and len(hot):
        grams[is_hot(grams, hot)] |= np.uint64(1 << 63)
    return sliding_min(grams, width - mmer + 1)[at]


def _weighed(batches: Iterator[pa.RecordBatch], width: int, mmer: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bytes of text, minimisers, and the bytes of their super-k-mers, for each part of the texts."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for i, j in blocks(offsets, BATCH_BYTES):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends = words_of(part, bounds)
            row = rows_of(bounds, starts)
            at = np.flatnonzero(row[width - 1 :] == row[: len(row) - width + 1]) if len(row) >= width else row[:0]
            if not len(at):
                yield len(part), np.zeros(0, np.uint64), np.zeros(0)
                continue
            least = minimisers(word_hashes(part, starts, ends), at, width, mmer)
            lo, hi = _runs(np.ones(len(at), bool), np.append(False, (at[1:] == at[:-1] + 1) & (least[1:] == least[:-1])))
            yield len(part), least[lo], ends[at[hi] + width - 1] - starts[at[lo]]


def _send(ids: np.ndarray, tags: np.ndarray, data: np.ndarray, offsets: np.ndarray, parts: int, width: int, mmer: int, hot: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Packed super-k-mers by bucket, and the runs of words that repeat within this batch."""
    starts, ends = words_of(data, offsets)
    if len(starts) < width:
        return
    row = rows_of(offsets, starts)
    hashes = word_hashes(data, starts, ends)
    at = np.flatnonzero(row[width - 1 :] == row[: len(row) - width + 1])
    if not len(at):
        return
    text, starts, ends = _normal(data, starts, ends)
    twice, before = repeated(text, starts, ends, window_sums(hashes, width)[at], at, width)
    first_word = np.searchsorted(row, np.arange(len(offsets) - 1))
    next_to = np.concatenate([[False], at[1:] == at[:-1] + 1])
    zip_up = zstandard.ZstdCompressor(level=3).compress
    lo, hi = _runs(twice, next_to)
    if len(lo):
        of = row[at[lo]]
        known = np.stack([ids[of], tags[of], at[lo] - first_word[of], at[hi] - first_word[of] + width])
        yield int(mix(hashes[:1])[0] % np.uint64(parts)), zip_up(known.astype(np.int64).tobytes()), b""
    least = minimisers(hashes, at, width, mmer, hot)
    joined = next_to & np.concatenate([[False], least[1:] == least[:-1]])
    lo, hi = _runs(~before, joined)
    bucket = (mix(least[lo]) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    lo, hi, bucket = lo[by], hi[by], bucket[by]
    of = row[at[lo]]
    p, q = starts[at[lo]], ends[at[hi] + width - 1]
    meta = np.stack([ids[of], tags[of], at[lo] - first_word[of], q - p]).astype(np.int64)
    p, q = p.tolist(), q.tolist()
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        packed = b"".join([text[p[i] : q[i]] for i in range(a, b)])
        yield int(bucket[a]), zip_up(meta[:, a:b].tobytes()), zip_up(packed)


def _map(batches: Iterator[pa.RecordBatch], parts: int, width: int, mmer: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        tags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = text_buffers(batch.column(2))
        for lo, hi in blocks(offsets, BATCH_BYTES):
            out = list(_send(ids[lo:hi], tags[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], parts, width, mmer, hot))
            if out:
                part, meta, words = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(meta, pa.binary()), pa.array(words, pa.binary())], names=["part", "meta", "words"])


def _bucket(group: pa.Table, width: int) -> pa.Table:
    """Runs of repeated words in the documents, from all super-k-mers of one bucket."""
    unzip = zstandard.ZstdDecompressor().decompress
    out, metas, texts = [np.zeros((4, 0), np.int64)], [np.zeros((4, 0), np.int64)], []
    for meta, words in zip(group.column("meta").to_pylist(), group.column("words").to_pylist(), strict=True):
        table_ = np.frombuffer(unzip(meta), np.int64).reshape(4, -1)
        if words:
            metas.append(table_)
            texts.append(unzip(words))
        else:
            out.append(table_)
    text, meta = b"".join(texts), np.concatenate(metas, axis=1)
    del texts, metas
    if len(text):
        data, offsets = np.frombuffer(text, np.uint8), np.concatenate([[0], np.cumsum(meta[3])])
        starts, ends = words_of(data, offsets)
        row = rows_of(offsets, starts)
        at = np.flatnonzero(row[width - 1 :] == row[: len(row) - width + 1])
        keys = window_sums(word_hashes(data, starts, ends), width)[at]
        twice, _ = repeated(text, starts, ends, keys, at, width)
        lo, hi = _runs(twice, np.concatenate([[False], at[1:] == at[:-1] + 1]))
        of = row[at[lo]]
        shift = meta[2][of] - np.searchsorted(row, np.arange(meta.shape[1]))[of]
        out.append(np.stack([meta[0][of], meta[1][of], at[lo] + shift, at[hi] + shift + width]))
    ids, tags, s, e = np.concatenate(out, axis=1)
    return pa.table({"id": ids, "tag": tags, "s": s.astype(np.int32), "e": e.astype(np.int32)})


def _keyed(docs: DataFrame) -> DataFrame:
    """docs' doc_id (null as 0) and a tag that tells texts and null ids apart, beside its row."""
    tag = F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), tag.alias("tag"), F.struct("*").alias("row"))


def repeated_runs(docs: DataFrame, width: int = WIDTH, mmer: int = MMER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Runs (id, tag, s, e) of word places that windows found elsewhere cover; runs may overlap."""
    total, hot = hot_keys(docs, partial(_weighed, width=width, mmer=mmer), bucket_bytes, HOT)
    # a super-k-mer repeats width - 1 words, so packed text is about three times the input
    parts = max(8, -(-3 * total // bucket_bytes))
    sent = in_arrow(_keyed(docs).select("id", "tag", F.col("row.text").alias("text")), partial(_map, parts=parts, width=width, mmer=mmer, hot=hot), _SENT)

    def bucket(group: pa.Table) -> pa.Table:
        return _bucket(group, width)

    return sent.groupBy("part").applyInArrow(bucket, _RUNS)


def _strip(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, runs = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(texts, runs, strict=True):
            whole = unzip(text.as_py())
            words = whole.split()
            gone = 0
            if spans.is_valid and len(spans):
                keep = np.ones(len(words), bool)
                for span in spans.as_py():
                    keep[span["s"] : span["e"]] = False
                gone = len(words) - int(keep.sum())
                left = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
            else:
                left = b" ".join(words)
            n_words.append(len(words))
            n_removed.append(gone)
            kept.append(hashlib.sha256(left).hexdigest() if digest else (left if gone else whole).decode())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*batch.schema.names[:-2], "n_words", "n_removed", "kept"])


def strip_repeats(docs: DataFrame, width: int = WIDTH, mmer: int = MMER, digest: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, n_words, n_removed, kept): docs' row as a struct without its text, and the kept words joined by
    one space (the text as it is if no word goes; a null text is empty), or the SHA-256 of the joined words if digest."""
    runs = repeated_runs(docs, width, mmer, bucket_bytes).groupBy("id", "tag").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    others = [c for c in docs.columns if c != "text"]
    keyed = _keyed(docs).select("id", "tag", F.struct(*[F.col(f"row.`{c}`") for c in others]).alias("row"), F.col("row.text").alias("text"))
    joined = squeezed(keyed).join(runs, ["id", "tag"], "left").select("row", "text", "runs")
    schema = T.StructType([joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return in_arrow(joined, partial(_strip, digest=digest), schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return strip_repeats(docs, digest=True).select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT rid, i, array_to_string(words[i:i + 34], ' ') AS w
      FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 34)) AS i FROM d WHERE len(words) >= 35)),
r AS (SELECT rid, i FROM s QUALIFY count(*) OVER (PARTITION BY w) >= 2),
t AS (SELECT rid, p, words[p] AS word FROM (SELECT rid, words, unnest(generate_series(1, len(words))) AS p FROM d)),
c AS (SELECT t.rid, t.p, t.word, EXISTS (SELECT 1 FROM r WHERE r.rid = t.rid AND r.i BETWEEN t.p - 34 AND t.p) AS gone FROM t),
k AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY rid)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
