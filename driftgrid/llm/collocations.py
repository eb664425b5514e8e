"""Operator 11, phrase collocation mining: contiguous patterns grown prefix by prefix.

Texts are lower-cased (A-Z), split at `.,;:!?` and line ends into pieces, and pieces at spaces and tabs into words; phrases never cross a
piece. Counts are by language. `mine` returns every phrase of one to `longest` words found `least` times, `collocations` scores the longer ones.

First the words are counted. Then every frequent word followed by another one sends its projection, the up to longest - 1 words
after it, to the part of its prefix: equal ones of about `send_words` words of text as one with a count, and all of a part in one row, so that
rows do not multiply with the parts. A part sorts its projections and grows each prefix to the right word by word:
an extension is a stretch of the pointers of the prefix, and is grown on if it is frequent.

Hot prefixes: a part should hold about `part_words` projections. Words with a quarter of that or more are no prefix of their own: each pair of such a word
and the next is one, and so are its first three words. A pair's count goes to the pair's part, one number for a row; its longer projections
go to the part of their first three words and are grown from there. So no part holds all projections of a hot word or of a hot pair.

Tasks know frequent and hot words by bit maps of hashes of `bits` bits (a size that does not grow). A word that shares its
bit with another only sends projections that are found rare, or is dealt more finely: counts are exact.

Score of a phrase counted a times, cut after k words into parts counted l and r: floor(2000000 a / (l + r)); the least over all cuts, the first of
equals. A phrase is dropped if a longer one that holds it is found at least 80 times for each 100 of its own (one word more decides, as counts only fall).

Defined results: a null text has no words; a null lang is `und`; repeated rows count each; a table without rows gives none; equal scores go by
count, then by the phrase's bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ARROW_BYTES, LOWER, blocks, dropped, in_arrow, mix, rows_of, runs_of, table, text_buffers, word_hashes, written

LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
PART_WORDS, SEND_WORDS, BITS = 2_000_000, 2_000_000, 25
_BLOCK = 1 << 15
_SPLIT = np.zeros(256, bool)
_SPLIT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _SPLIT.copy()
_GAP[[32, 9]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts, the row of each, and the piece of each."""
    data = LOWER[data]
    inside = ~_GAP[data]
    starts, ends = runs_of(inside, offsets)
    size = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(size), pa.py_buffer(data[inside]))
    row = rows_of(offsets, starts)
    split = np.cumsum(_SPLIT[data])
    piece = (split[starts] if len(starts) else np.zeros(0, np.int64)) + row
    return words, row, piece


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f): words of each batch; the null word stands for all."""
    for batch in batches:
        names, lang = _languages(batch.column(0))
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in blocks(offsets):
            words, row, _ = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            coded = words.dictionary_encode()
            of = lang[lo:hi][row]
            count = np.bincount(of * len(coded.dictionary) + coded.indices.to_numpy(), minlength=len(names) * len(coded.dictionary)).reshape(len(names), -1)
            for k, name in enumerate(names):
                some = np.flatnonzero(count[k])
                f = np.append(count[k][some], count[k].sum())
                found = pa.concat_arrays([coded.dictionary.take(pa.array(some)).cast(pa.string()), pa.array([None], pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(f), pa.string()), found, pa.array(f)], names=["lang", "word", "f"])


def _slots(lang: np.ndarray | np.uint64, words: pa.Array, bits: int) -> np.ndarray:
    data, offsets = text_buffers(words)
    return (mix(word_hashes(data, offsets[:-1], offsets[1:]) ^ lang) >> np.uint64(64 - bits)).astype(np.int64)


def _language_hash(names: list[str]) -> np.ndarray:
    data, offsets = text_buffers(pa.array(names, pa.string()))
    return mix(word_hashes(data, offsets[:-1], offsets[1:]) + np.uint64(1)) if len(data) else np.zeros(len(names), np.uint64)


def _blocks_of_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    marked = np.zeros(1 << bits, bool)
    for batch in batches:
        names, lang = _languages(batch.column(0))
        marked[_slots(_language_hash(names)[lang], batch.column(1), bits)] = True
    size = min(_BLOCK, len(marked))
    for k in np.flatnonzero(marked.reshape(-1, size).any(axis=1)).tolist():
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(marked[k * size : (k + 1) * size]).tobytes()])], names=["block", "bits"])


def _joined_bits(group: pa.Table) -> pa.Table:
    rows = [np.frombuffer(b, np.uint8) for b in group.column("bits").to_pylist()]
    return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()])})


def bit_map(words: DataFrame, bits: int) -> np.ndarray:
    """A bit map of the hashes of (lang, word), joined on the executors by blocks; its 2**bits bits come to the driver."""
    out = np.zeros((max(1, (1 << bits) // _BLOCK), min(_BLOCK, 1 << bits) // 8), np.uint8)
    found = in_arrow(words.select("lang", "word"), partial(_blocks_of_bits, bits=bits), "block long, bits binary")
    for row in found.groupBy("block").applyInArrow(_joined_bits, "block long, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _is_set(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


def _grouped(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of numbers under 2**32 as one, in order, with their counts."""
    wide = [c.astype(np.uint64) for c in columns]
    keys = [c if other is None else c << np.uint64(32) | other for c, other in zip_longest(wide[::2], wide[1::2])]
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for key in keys:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(fresh)
    weight = np.ones(len(order), np.int64) if counts is None else counts[order]
    return [c[order[at]] for c in columns], np.add.reduceat(weight, at) if len(at) else np.zeros(0, np.int64)


def _projections(lang: np.ndarray, ids: np.ndarray, joined: np.ndarray, names: list[str], words: pa.Array, parts: int, longest: int, frequent: np.ndarray, hot: np.ndarray, bits: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(language, words of a prefix, columns, counts, parts) of the projections; columns hold numbers of words from 1 on (0: none)."""
    tongue = _language_hash(names)
    for k in range(len(names)):
        slots = _slots(tongue[k], words, bits)
        known, busy = _is_set(frequent, slots), _is_set(hot, slots)
        # rare words and ends of pieces part the frequent ones
        at = np.flatnonzero((lang == k) & known[ids])
        if len(at) < 2:
            continue
        word, next_to = ids[at].astype(np.uint32) + np.uint32(1), np.concatenate([(at[1:] == at[:-1] + 1) & joined[at[:-1]], np.zeros(longest, bool)])
        word = np.concatenate([word, np.zeros(longest, np.uint32)])
        columns, on = [word[: len(at)]], np.ones(len(at), bool)
        for step in range(1, longest):
            on = on & next_to[step - 1 : step - 1 + len(at)]
            columns.append(np.where(on, word[step : step + len(at)], np.uint32(0)))
        some = columns[1] > 0
        columns, counts = _grouped([c[some] for c in columns])
        if not len(counts):
            continue
        hashes = np.concatenate([[np.uint64(0)], mix(slots.astype(np.uint64) + np.uint64(1))])
        to = lambda h: (mix(h) % np.uint64(parts)).astype(np.int64)
        hot_word = busy[columns[0].astype(np.int64) - 1]
        plain = [c[~hot_word] for c in columns]
        yield k, 1, plain, counts[~hot_word], to(hashes[plain[0]] * np.uint64(3) + tongue[k])
        if hot_word.any():
            pairs, n = _grouped([c[hot_word] for c in columns[:2]], counts[hot_word])
            yield k, 1, [*pairs, *[np.zeros(len(n), np.uint32)] * (longest - 2)], n, to(hashes[pairs[0]] * np.uint64(3) + hashes[pairs[1]] * np.uint64(5) + tongue[k])
            if longest > 2:
                deep = hot_word & (columns[2] > 0)
                own = [c[deep] for c in columns]
                yield k, 2, own, counts[deep], to(hashes[own[0]] * np.uint64(3) + hashes[own[1]] * np.uint64(5) + hashes[own[2]] * np.uint64(7) + tongue[k])


def _packed(names: list[str], words: pa.Array, found: list[tuple[int, int, list[np.ndarray], np.ndarray, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """(part, projections): for each part once the kinds of its projections (language, words of the prefix, number), its words, and the numbers of `longest` words with counts."""
    zip_up = zstandard.ZstdCompressor(level=3).compress
    kind = np.repeat(np.arange(len(found)), [len(x[3]) for x in found])
    part = np.concatenate([x[4] for x in found])
    rows = np.stack([np.concatenate([x[2][c] for x in found]) for c in range(len(found[0][2]))] + [np.concatenate([x[3] for x in found])]).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    part, kind, rows = part[order], kind[order], rows[:, order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    seen, number = np.zeros(len(words) + 1, bool), np.zeros(len(words) + 1, np.uint32)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = rows[:, a:b].copy()
        for c in own[:-1]:
            seen[c] = True
        seen[0] = False
        used = np.flatnonzero(seen)
        seen[used] = False
        number[used] = np.arange(1, len(used) + 1)
        for c in own[:-1]:
            c[:] = number[c]
        size = np.bincount(kind[a:b], minlength=len(found)).tolist()
        data, offsets = text_buffers(words.take(pa.array(used - 1)))
        head = json.dumps({"words": len(used), "bytes": len(data), "kinds": [[names[x[0]], x[1], n] for x, n in zip(found, size, strict=True) if n]}).encode()
        yield int(part[a]), zip_up(b"".join([len(head).to_bytes(8, "little"), head, np.diff(offsets).astype(np.uint32).tobytes(), data.tobytes(), own.tobytes()]))


def _projected(batches: Iterator[pa.RecordBatch], parts: int, longest: int, frequent: np.ndarray, hot: np.ndarray, bits: int, send_words: int = SEND_WORDS) -> Iterator[pa.RecordBatch]:
    """(part, projections): `_packed` for each `send_words` words of a task, so that few rows go to a part however many parts there are."""
    names: dict[str, int] = {}
    held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

    def sent() -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
        of = coded.indices.to_numpy()
        first = np.cumsum([0, *[len(x[0]) for x in held]])
        ids = np.concatenate([of[a + x[1]] for a, x in zip(first.tolist(), held, strict=False)])
        lang, joined = (np.concatenate([x[i] for x in held]) for i in (2, 3))
        held.clear()
        found = list(_projections(lang, ids, joined, list(names), coded.dictionary, parts, longest, frequent, hot, bits))
        to, blobs, size = [], [], 0
        for part, blob in _packed(list(names), coded.dictionary, found) if found else ():
            to.append(part)
            blobs.append(blob)
            size += len(blob)
            if size >= ARROW_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(blobs)], names=["part", "projections"])
                to, blobs, size = [], [], 0
        if to:
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(blobs)], names=["part", "projections"])

    waiting = 0
    for batch in batches:
        own, lang = _languages(batch.column(0))
        lang = np.array([names.setdefault(x, len(names)) for x in own], np.int32)[lang]
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in blocks(offsets):
            words, row, piece = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if not len(words):
                continue
            coded = words.dictionary_encode()
            held.append((coded.dictionary, coded.indices.to_numpy(), lang[lo:hi][row], np.append(piece[1:] == piece[:-1], False)))
            waiting += len(words)
            if waiting >= send_words:
                yield from sent()
                waiting = 0
    if held:
        yield from sent()


def _grow(columns: list[np.ndarray], counts: np.ndarray, least: int, known: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(pointers, words, counts) of the frequent phrases longer than the `known` words of a prefix: sorted projections, grown to the right a word at a time.

    A prefix is a stretch of pointers, and its extensions are the stretches in it; one that is found `least` times has a prefix found as often.
    """
    total = np.concatenate([[0], np.cumsum(counts)])
    change = np.zeros(len(counts), bool)
    change[:1] = True
    for depth, c in enumerate(columns):
        change[1:] |= c[1:] != c[:-1]
        if depth >= known:
            cuts = np.append(np.flatnonzero(change), len(counts))
            found = total[cuts[1:]] - total[cuts[:-1]]
            some = np.flatnonzero((c[cuts[:-1]] > 0) & (found >= least))
            yield cuts[some], depth + 1, found[some]


def _mined(group: pa.Table, longest: int, least: int) -> pa.Table:
    """Phrases of one part."""
    unzip = zstandard.ZstdDecompressor().decompress
    sent, heads = [], []
    for blob in group.column("projections"):
        raw = unzip(blob.as_py())
        at = 8 + int.from_bytes(raw[:8], "little")
        head = json.loads(raw[8:at])
        size = np.frombuffer(raw, np.uint32, head["words"], at)
        at += size.nbytes
        words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size, dtype=np.int64)])), pa.py_buffer(raw[at : at + head["bytes"]]))
        sent.append((words, np.frombuffer(raw[at + head["bytes"] :], np.uint32).reshape(longest + 1, -1)))
        heads.append(head["kinds"])
    coded = pa.concat_arrays([x[0] for x in sent]).dictionary_encode()
    number, first = coded.indices.to_numpy().astype(np.uint32) + np.uint32(1), 0
    tables: dict[tuple[str, int], list[np.ndarray]] = {}
    for (words, packed), kinds in zip(sent, heads, strict=True):
        own = np.concatenate([[np.uint32(0)], number[first : first + len(words)]])
        first, at = first + len(words), 0
        table_ = np.stack([*[own[c] for c in packed[:-1]], packed[-1]])
        for name, known, n in kinds:
            tables.setdefault((name, known), []).append(table_[:, at : at + n])
            at += n
    del sent
    text = np.array(["", *coded.dictionary.to_pylist()], object)
    out = []
    for name, known in sorted(tables):
        merged = np.concatenate(tables.pop((name, known)), axis=1)
        columns, counts = _grouped(list(merged[:-1]), merged[-1].astype(np.int64))
        for at, words, f in _grow(columns, counts, least, known):
            phrases = [" ".join(w) for w in zip(*(text[c[at]].tolist() for c in columns[:words]), strict=True)]
            out.append(pa.table({"lang": pa.array([name] * len(at), pa.string()), "phrase": pa.array(phrases, pa.string()), "words": pa.array(np.full(len(at), words, np.int32)), "f": pa.array(f, pa.int64())}))
    return pa.concat_tables(out).combine_chunks()


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, part_words: int = PART_WORDS, bits: int = BITS, send_words: int = SEND_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of one to `longest` words found `least` times; and (lang, n), all words of each language. Both lie in the shared folder."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counted = in_arrow(rows, _counted, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words = written(counted.filter(F.col("word").isNull() | (F.col("f") >= least)), "words")
    frequent = words.filter("word is not null")
    total = frequent.agg(F.sum("f")).first()[0] or 0
    parts = max(8, -(-total // part_words))
    known, hot = bit_map(frequent, bits), bit_map(frequent.filter(F.col("f") >= max(least, part_words // 4)), bits)
    spark = docs.sparkSession
    # two bit maps of 2**bits bits, whatever the number of words
    maps = spark.sparkContext.broadcast((known, hot))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _projected(batches, parts, longest, *maps.value, bits, send_words)

    def part(group: pa.Table) -> pa.Table:
        return _mined(group, longest, least)

    sent = in_arrow(rows, project, "part long, projections binary")
    grown = sent.groupBy("part").applyInArrow(part, "lang string, phrase string, words int, f long")
    phrases = written(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f").unionByName(grown), "phrases")
    totals = written(words.filter("word is null and f > 0").select("lang", F.col("f").alias("n")), "totals")
    dropped(words)
    return phrases, totals


def _part_of(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words or more that no longer one covers."""
    wide = "decimal(38,0)"
    longer = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part_of(F.col("w"), 1, F.col("k")).alias("left"), _part_of(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    count = lambda name, out: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(out))
    cuts = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    # l and r are each at least a, so the quotient is a million at most
    exact = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("_b"))
    inner = longer.filter("words > 2").select("lang", "a", F.explode(F.array(_part_of(F.col("w"), 1, F.col("words") - 1), _part_of(F.col("w"), 2, F.col("words") - 1))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("more"))
    rows = best.join(covered, ["lang", "phrase"], "left")
    rows = rows.filter(F.col("more").isNull() | (F.col("more").cast(wide) * 100 < F.col("a").cast(wide) * cover))
    return rows.select("lang", "phrase", "words", "a", "_b.l", "_b.r", "_b.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER, part_words: int = PART_WORDS, bits: int = BITS, send_words: int = SEND_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language."""
    phrases, totals = mine(docs, least, longest, part_words, bits, send_words)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = scored(phrases, cover).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM
        (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, generate_series(1, 4) s(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, k AS m, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.a, c.m, x.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
      FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c) AS x JOIN c USING (lang, phrase)
      JOIN f AS l ON l.lang = x.lang AND l.k = x.k AND l.phrase = array_to_string(x.w[1:x.k], ' ')
      JOIN f AS r ON r.lang = x.lang AND r.k = x.m - x.k AND r.phrase = array_to_string(x.w[x.k + 1:x.m], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:m], ' ')]) AS phrase, a FROM c WHERE m > 2
      UNION ALL SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' '), array_to_string(w[3:4], ' ')]) AS phrase, a FROM c WHERE m = 4),
kept AS (SELECT b.* FROM best AS b LEFT JOIN (SELECT lang, phrase, max(a) AS more FROM longer GROUP BY ALL) AS o USING (lang, phrase) WHERE o.more IS NULL OR 100::HUGEINT * o.more < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
