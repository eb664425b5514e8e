"""Operator 2, packing: mixture-controlled, by deficit round-robin over source queues.

Each source is a queue of its documents' tokens in a fixed order, with a weight. While a
source is due w tokens for each unit of time, its deficit (what it was due less what it
got) grows; each time it has grown by half a piece of `least_piece` tokens the source is served
its next piece, pieces due at one time by the order of the sources. The stream of
pieces is cut into windows of `window` tokens, in which each source's tokens are put
together. So every source has its share of every window to within two pieces, deficits are carried
from window to window and from lane to lane, and small sources give few, longer
pieces. A queue that runs dry leaves its share to the others, in proportion to their weights.

Scale: which tokens of each source lie before a given place of the stream follows in
closed form: piece j of a source of weight w comes at time (2 j + 1) / w, and the time
of a place is found by bisection over what all sources are due. So each lane of
`lane_windows` windows is filled by itself, from the deficits that all lanes before it leave,
and a document needs only its place in its source's queue to know its pieces. Two-level prefix sums
over (source, bucket) give that; no source's queue is ever in one task. The driver holds one
number for each queue, at most `queues` of them. Where there are more sources, those without a target are members of
groups by a hash of their names. A group is a queue, and its own stream is dealt in the same way to its members, in pieces, so each source keeps its share,
to within three pieces, at any number of sources. The members' sizes are a table that is joined to the documents; the driver never sees them.

By default the weights are the sources' token counts, so every window has the
proportions of the whole corpus and all queues end together.

Defined results: a null text is empty and packs as its end token; a null source is a
source of its own; a target for a source that has no rows goes to the others; repeated rows are packed each; ties in the queue's order are broken
by the row's text hash and then in any order; an empty table gives no piece.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache, partial
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, table, text_buffers, written

WINDOW, LANE, LEAST_PIECE, END_ID = 4096, 256, 64, 2
#: Documents for each bucket of the queues, over all sources.
BUCKET_DOCS = 20_000
#: Bytes of a generation of a worker's cache of encoded words (a quarter of it for their pieces); an entry counts ENTRY bytes beside its word and ids.
CACHE_BYTES, ENTRY = 40 << 20, 140
#: Queues that the driver holds a number for.
QUEUES = 4096

# --- tokens -----------------------------------------------------------------------------

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"(?:[{_LATIN}]+|[!-&(-/:-@\[-`{{-~]+)+")
_PIECE = re.compile(rf"[{_LATIN}]+|[^{_LATIN}\s]+")
_ID = attrgetter("id")
_MARKS = re.compile(rb"[!-/:-@\[-`{-~][!-/:-@\[-`{-~]")
#: Bytes of plain words and of white space: ASCII letters and punctuation, and those of U+00C0 to U+00FF.
_PLAIN_BYTES = bytes([*range(9, 14), *range(32, 39), *range(40, 48), *range(58, 127), *range(128, 192), 0xC3])


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known(dict):
    """A cache in two generations of bounded bytes: what was not asked for since the last change of generation goes at the next."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.room, self.old = make, limit, limit, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self.room -= len(key) + len(got) + ENTRY
        if self.room < 0:
            self.old = dict(self)
            self.clear()
            self.room = self.limit
        self[key] = got
        return got


class WordEncoder:
    """Token ids of whole texts, word by word.

    The vocabulary drops white space, so a text's ids are those of its words on end. Words of Latin letters
    and ASCII punctuation (no apostrophe) skip the normaliser, which leaves them alone but for
    lower case: they are cut into runs of letters and of punctuation, each encoded by itself, and the
    library encodes all other words whole. Texts of plain words are put in lower case first, and where no two marks adjoin
    full stops and commas are parted from their words, so that fewer words are distinct. Each distinct one is encoded once; caches are
    bounded and hold no state that matters.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.merged = self.tokenizer.model.tokenize
        self.words, self.pieces = Known(self._word, CACHE_BYTES), Known(self._piece, CACHE_BYTES // 4)

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return array("H", map(_ID, self.merged(spelt))).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha():  # ASCII letters alone
            return array("H", map(_ID, self.merged(text.lower()))).tobytes()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self.pieces[p] for p in _PIECE.findall(text.lower())])
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids as unsigned 16-bit numbers in the machine's order."""
        if not text.translate(None, _PLAIN_BYTES) and not any(x in text for x in (b"\xc3\x97", b"\xc3\xb7", b"<|")):
            text = text.lower()
            if not _MARKS.search(text):
                text = text.replace(b",", b" , ").replace(b".", b" . ")
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, end = _encoder(path), np.array([end_id], np.uint16).tobytes()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            ids = [encoder.encode((t.as_py() or "").encode()) + end for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "n", "tie", "ids"])


# --- the round-robin --------------------------------------------------------------------


@dataclass(frozen=True)
class Mixture:
    """The queues' sizes in tokens and weights, and how the stream of their pieces is cut."""

    total: tuple[int, ...]
    weight: tuple[float, ...]
    window: int
    lane_windows: int
    piece: int

    @cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = np.array(self.total, np.int64)
        return total, np.array(self.weight, float), -(-total // self.piece)

    def due(self, time: float) -> np.ndarray:
        """Pieces of each queue that come at or before a time; its last piece may be a short one."""
        _, weight, most = self.arrays
        n = np.minimum((time * weight + 1) / 2, most).astype(np.int64)
        # what rounding did: the times of the pieces themselves decide
        n += (n < most) & ((2 * n + 1) / weight <= time)
        return n - ((n > 0) & ((2 * n - 1) / weight > time))

    def served(self, tokens: int) -> np.ndarray:
        """Tokens of each queue among the first `tokens` of the stream."""
        total, weight, _ = self.arrays
        if tokens >= total.sum():
            return total
        lo, hi = 0.0, float(((2 * total // self.piece + 3) / weight).max())
        while (mid := (lo + hi) / 2) not in (lo, hi):  # lo: at most that many tokens have come, hi: more
            lo, hi = (mid, hi) if np.minimum(self.due(mid) * self.piece, total).sum() <= tokens else (lo, mid)
        out, after = (np.minimum(self.due(x) * self.piece, total) for x in (lo, hi))
        room = tokens - int(out.sum())
        takes = np.diff(np.minimum(np.cumsum(after - out), room), prepend=0)  # pieces of one time, by the order of the queues
        return out + takes

    def place(self, queue: int, at: int) -> int:
        """Where in the stream a queue's token is."""
        j = at // self.piece
        time = (2 * j + 1) / np.float64(self.weight[queue])
        total = self.arrays[0]
        before, upto = (np.minimum(self.due(x) * self.piece, total) for x in (np.nextafter(time, 0), time))
        return int(upto[:queue].sum() + before[queue:].sum()) + at - j * self.piece

    @property
    def span(self) -> int:
        return self.window * self.lane_windows


@lru_cache(maxsize=256)
def _served(mix: Mixture, tokens: int) -> np.ndarray:
    return mix.served(tokens)


@lru_cache(maxsize=256)
def lane_plan(mix: Mixture, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slices of all queues in a lane, by queue and window: bounds of the queues' slices, where each begins in its queue, its window, its offset there."""
    before, after = _served(mix, lane * mix.span), _served(mix, (lane + 1) * mix.span)
    some = np.flatnonzero(after > before)
    first, last = before[some] // mix.piece, -(-after[some] // mix.piece)
    count = last - first
    queue = np.repeat(some, count)
    j = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = np.minimum((j + 1) * mix.piece, after[queue]) - np.maximum(j * mix.piece, before[queue])
    order = np.lexsort((queue, (2 * j + 1) / mix.arrays[1][queue]))
    queue, size = queue[order], size[order]
    end = np.cumsum(size)
    # tokens of each queue in each window; a piece may go over windows' ends
    edges = np.union1d(np.append(end - size, end[-1:]), np.arange(0, int(size.sum()), mix.window))
    of = np.searchsorted(end, edges[:-1], "right")
    codes, where = np.unique(edges[:-1] // mix.window * len(mix.total) + queue[of], return_inverse=True)
    tokens = np.bincount(where, np.diff(edges), len(codes)).astype(np.int64)
    window, queue = codes // len(mix.total), codes % len(mix.total)
    offset = np.cumsum(tokens) - tokens - window * mix.window
    by = np.lexsort((window, queue))
    window, queue, offset, tokens = window[by], queue[by], offset[by], tokens[by]
    bounds = np.searchsorted(queue, np.arange(len(mix.total) + 1))
    begin = np.cumsum(tokens) - tokens
    begin += before[queue] - begin[bounds[queue]] if len(begin) else 0
    return bounds, begin, lane * mix.lane_windows + window, offset


def slices(mix: Mixture, queue: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a queue's tokens from start to stop: where its slices begin (the first at or before start), their windows and offsets."""
    out = []
    for lane in range(mix.place(queue, start) // mix.span, mix.place(queue, stop - 1) // mix.span + 1):
        bounds, *columns = lane_plan(mix, lane)
        out.append([c[bounds[queue] : bounds[queue + 1]] for c in columns])
    begin, window, offset = (np.concatenate(c) for c in zip(*out, strict=True))
    lo, hi = int(np.searchsorted(begin, start, "right")) - 1, int(np.searchsorted(begin, stop))
    return begin[lo:hi], window[lo:hi], offset[lo:hi]


def member_slices(mix: Mixture, queue: int, inner: Mixture, member: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `slices`, of the tokens of a member of a group: its pieces in the group's stream, and what the queue of the group makes of these."""
    begin, window, offset = slices(inner, member, start, stop)
    low = np.maximum(begin, start)
    at = window * inner.window + offset + low - begin
    out = []
    for p, q, g in zip(low.tolist(), np.append(low[1:], stop).tolist(), at.tolist(), strict=True):
        first, of, place = slices(mix, queue, g, g + q - p)
        inside = np.maximum(first, g)
        out.append((p + inside - g, of, place + inside - first))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], mix: Mixture) -> Iterator[pa.RecordBatch]:
    """Pieces of documents; documents that follow on in one queue are cut at once."""
    for batch in batches:
        queue, n, place, member = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3, 5))
        totals = batch.column(6)
        data, _ = text_buffers(batch.column(4))
        ids = data.view(np.uint16)
        fresh = np.flatnonzero(np.concatenate([[True], (queue[1:] != queue[:-1]) | (member[1:] != member[:-1]) | (place[1:] != place[:-1] + n[:-1])]))
        at = np.concatenate([[0], np.cumsum(n)])
        docs, lengths, starts, windows, offsets = [], [], [], [], []
        for a, b in zip(fresh.tolist(), np.append(fresh[1:], len(n)).tolist(), strict=True):
            low, high = int(place[a]), int(place[b - 1] + n[b - 1])
            if totals[a].is_valid:
                own = tuple(totals[a].as_py())
                inner = Mixture(own, own, mix.piece, mix.span // mix.piece, mix.piece)
                begin, window, offset = member_slices(mix, int(queue[a]), inner, int(member[a]), low, high)
            else:
                begin, window, offset = slices(mix, int(queue[a]), low, high)
            edges = np.union1d(place[a:b], np.append(np.maximum(begin, low), high))
            doc = np.searchsorted(place[a:b], edges[:-1], "right") - 1
            part = np.searchsorted(begin, edges[:-1], "right") - 1
            docs.append(doc + a)
            lengths.append(np.diff(edges))
            starts.append(edges[:-1] - place[a + doc])
            windows.append(window[part])
            offsets.append(offset[part] + edges[:-1] - begin[part])
        if not docs:
            continue
        doc, length, start, window, offset = (np.concatenate(c) for c in (docs, lengths, starts, windows, offsets))
        bounds = np.concatenate([[0], np.cumsum(length)])
        wide = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(wide[p:q]) for p, q in zip((bounds[:-1] * 4).tolist(), (bounds[1:] * 4).tolist(), strict=True)]
        packed = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *map(pa.array, (start, length, np.array(crc, np.int64), n[doc], window, offset)), packed], schema=_PIECES)
        assert at[-1] == bounds[-1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, targets: dict | None = None, least_piece: int = LEAST_PIECE, lane_windows: int = LANE, queues: int = QUEUES) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    `targets` maps sources to shares of a window (scaled down if they add up to more than 1); the sources without one
    have what is left, by their token counts (if nothing is left, they come after all others). None: all by their token counts.
    """
    targets = dict(targets or {})
    if any(not w > 0 for w in targets.values()) or not 1 <= least_piece <= window:
        raise ValueError("targets are above 0, and least_piece is from 1 to the window")
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), "text")
    encoded = in_arrow(encoded, partial(_tokens, path=tokenizer, end_id=end_id), T.StructType([T.StructField("doc_id", T.LongType()), docs.schema["source"], T.StructField("n", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType())]))
    encoded = written(encoded, "tokens")
    name = F.col("source").cast("string")
    source = F.coalesce(F.concat(F.lit("source:"), name), F.lit("null"))
    many = encoded.select("source").distinct().count() > queues - len(targets)
    own = F.coalesce(name.isin([str(t) for t in targets if t is not None]), F.lit(None in targets))
    group = F.concat(F.lit("group:"), F.pmod(F.xxhash64(name), F.lit(max(1, queues - len(targets)))).cast("string"))
    keyed = encoded.withColumn("key", F.when(own, source).otherwise(group) if many else source).withColumn("of", source)
    sizes = keyed.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).orderBy("key").collect()  # at most `queues` rows
    shares = {"null" if k is None else f"source:{k}": w / max(1, sum(targets.values())) for k, w in targets.items()}
    own = [shares.get(r["key"]) for r in sizes]
    rest = max(1 - sum(shares.values()), 1e-9) / max(1, sum(r["n"] for r, w in zip(sizes, own, strict=True) if w is None))
    mix = Mixture(tuple(r["n"] for r in sizes), tuple(w or r["n"] * rest for r, w in zip(sizes, own, strict=True)), window, lane_windows, least_piece)
    buckets = max(64, math.ceil(sum(r["docs"] for r in sizes) / BUCKET_DOCS))
    numbers = docs.sparkSession.createDataFrame([(r["key"], i) for i, r in enumerate(sizes)], "key string, queue int")
    # copies under one id, and rows without one, are told apart by their text
    bucket = F.pmod(F.xxhash64("doc_id", "tie", F.lit(7)), F.lit(buckets))
    if many:
        members = written(keyed.groupBy("key", "of").agg(F.sum("n").alias("n")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("of", "n"))).alias("m")), "members")
        slots = members.select("key", F.posexplode("m").alias("member", "m")).select("key", "member", F.col("m.of").alias("of"))
        keyed = keyed.join(slots, ["key", "of"]).join(members.select("key", F.col("m.n").alias("totals")), "key")
    else:
        keyed = keyed.withColumns({"member": F.lit(0), "totals": F.lit(None).cast("array<long>")})
    keyed = keyed.join(F.broadcast(numbers), "key").select("doc_id", "queue", "n", "tie", "ids", "member", "totals", bucket.alias("bucket"))
    sums = keyed.groupBy("queue", "member", "bucket").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("queue", "member").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = written(sums.select(F.col("queue").alias("_q"), F.col("member").alias("_m"), F.col("bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("before")), "queues")
    order = Window.partitionBy("queue", "member", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0)))
    placed = placed.join(sums, (F.col("queue") == F.col("_q")) & (F.col("member") == F.col("_m")) & (F.col("bucket") == F.col("_b")))
    placed = placed.select("doc_id", "queue", "n", (F.col("before") + F.col("inside")).alias("place"), "ids", "member", "totals")
    return in_arrow(placed, partial(_cut, mix=mix), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def packed_mixture(spark, sf_dir: str) -> DataFrame:
    """Tokens of each source in each window, with targets unlike the sources' sizes: half for src1, a fifth for src2, a hundredth for src3."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), targets={"src1": 0.5, "src2": 0.2, "src3": 0.01}).select("doc_id", "sequence_id", "length")
    of = docs.select("doc_id", "source").distinct()
    return pieces.join(of, "doc_id").groupBy("sequence_id", "source").agg(F.sum("length").alias("n_tokens"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")
