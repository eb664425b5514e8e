"""Operator 12, periodic runs: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of consecutive words with smallest period q, at least `times` periods and `least` words long, that no
neighbouring word extends with that period. `find_runs` reports the runs of each text, `collapse` also drops from each run all but
its first period.

A text is halved again and again. A run lies in one half or crosses the middle; for each period that may cross a
middle the Z values there (how far the words from the middle on, and those before it, agree with the words one period away) give the whole
run. The Z values of all middles of a level are found together: names of all stretches of 2**k words (equal names, equal words)
lengthen every match by halving steps. Intervals found at several middles or with several periods are kept once, with the smallest period.
Every word of a run with `times` periods occurs `times` times in it, so rarer words part a text before it is halved.

A text is one task's work, never split, and no text meets another: no shuffle.

Defined results: a null text has no words and no run, and collapses to an empty text; repeated rows are reported each; an empty table
gives an empty one; of runs with equal exponents the one that starts first, then the one with the smaller period is the greatest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, in_arrow, rows_of, table, text_buffers, word_hashes, words_of

TIMES, LEAST = 4, 6
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _stretches(keys: np.ndarray, row: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words in which each word occurs `times` times or more, of at least `least` words."""
    at, group = np.arange(len(keys)), row.astype(np.int64)
    while len(at):
        order = np.lexsort((keys[at], group))
        k, g = keys[at][order], group[order]
        fresh = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])]))
        count = np.diff(np.append(fresh, len(k)))
        keep = np.empty(len(at), bool)
        keep[order] = np.repeat(count >= times, count)
        whole = keep.all()
        at, group = at[keep], group[keep]
        group = np.cumsum(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])])[: len(at)])
        size = np.bincount(group, minlength=1)[group]
        keep = size >= least
        at, group = at[keep], group[keep]
        if whole and keep.all():
            break
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(group[1:] != group[:-1])
    return at[np.concatenate([[0], edge + 1])], at[np.append(edge, len(at) - 1)] + 1


def _names(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each k a name of the 2**k words from each place on; equal names stand for equal words."""
    out, width = [ids.astype(np.int32)], 1
    while 2 * width <= longest:
        last = out[-1]
        pair = last[:-width].astype(np.int64) * (int(last.max()) + 1) + last[width:]
        out.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return out


def _agree(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i and j on are equal (before i and j if back), `room` at most."""
    found = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width = 1 << k
        at = np.flatnonzero(found + width <= room)
        if not len(at):
            continue
        shift = -found[at] - width if back else found[at]
        same = names[k][i[at] + shift] == names[k][j[at] + shift]
        found[at[same]] += width
    return found


def _crossing(names: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, lows: np.ndarray, highs: np.ndarray, times: int, least: int) -> np.ndarray:
    """(start, end, period) of the runs that cross the middles of the nodes lo..hi; they reach no further than lows..highs."""
    mid, most = (lo + hi) // 2, (hi - lo) // times
    node = np.repeat(np.arange(len(lo)), most)
    p = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
    found = [np.zeros((3, 0), np.int64)]
    for before in (True, False):
        # before: the words from the middle on agree with those one period earlier, else the words up to it with those one period later
        i, j = (mid[node] - p, mid[node]) if before else (mid[node], mid[node] + p)
        able = (i >= lo[node]) & (j < hi[node])
        able[able] = names[0][i[able]] == names[0][j[able]] if before else names[0][i[able] - 1] == names[0][j[able] - 1]
        n, i, j, q = node[able], i[able], j[able], p[able]
        after, ahead = _agree(names, i, j, highs[n] - j, False), _agree(names, i, j, i - lows[n], True)
        enough = q + after + ahead >= np.maximum(least, times * q)
        found.append(np.stack([(i - ahead)[enough], (j + after)[enough], q[enough]]))
    return np.concatenate(found, axis=1)


def runs_in(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs of the stretches starts..ends of word ids, by start and period."""
    if not len(starts):
        return np.zeros((3, 0), np.int64)
    names = _names(ids, int((ends - starts).max()))
    lo, hi, lows, highs = starts, ends, starts, ends
    found = []
    while len(lo):
        found.append(_crossing(names, lo, hi, lows, highs, times, least))
        mid = (lo + hi) // 2
        lo, hi, lows, highs = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.tile(lows, 2), np.tile(highs, 2)
        large = hi - lo >= least
        lo, hi, lows, highs = lo[large], hi[large], lows[large], highs[large]
    s, e, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])[: len(s)]
    s, e, q = s[first], e[first], q[first]
    order = np.lexsort((q, s))
    return np.stack([s[order], e[order], q[order]])


def block_runs(data: np.ndarray, offsets: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends of some texts, the first word of each text, and the runs (start, end, period) by number of the word in the block."""
    starts, ends = words_of(data, offsets)
    row = rows_of(offsets, starts)
    first = np.searchsorted(row, np.arange(len(offsets)))
    lo, hi = _stretches(word_hashes(data, starts, ends), row, times, least)
    size = hi - lo
    begin = np.cumsum(size) - size
    at = np.repeat(lo - begin, size) + np.arange(size.sum())
    text, known = data.tobytes(), {}
    # hashes only part the texts: what is left is named by its bytes
    ids = np.array([known.setdefault(text[s:e], len(known)) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], np.int64)
    s, e, q = runs_in(ids, begin, begin + size, times, least)
    shift = (lo - begin)[np.searchsorted(begin, s, "right") - 1] if len(s) else s
    return starts, ends, first, np.stack([s + shift, e + shift, q])


def _reported(batches: Iterator[pa.RecordBatch], times: int, least: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        data, offsets = text_buffers(column)
        n_words, runs, kept = [], [], []
        for lo, hi in blocks(offsets):
            own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, first, (s, e, q) = block_runs(own, at, times, least)
            n_words.append(np.diff(first))
            of = np.searchsorted(first, s, "right") - 1
            bounds = np.searchsorted(of, np.arange(hi - lo + 1))
            values = pa.StructArray.from_arrays([pa.array(s - first[of]), pa.array(e - s), pa.array(q)], fields=list(_RUN))
            runs.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values))
            if texts:
                mark = np.zeros(len(starts) + 1, np.int64)
                np.add.at(mark, s + q, 1)
                np.add.at(mark, e, -1)
                stay = np.cumsum(mark[:-1]) == 0
                raw = own.tobytes()
                for k in range(hi - lo):
                    some = slice(first[k], first[k + 1])
                    words = raw[at[k] : at[k + 1]].split()
                    kept.append(b" ".join(words if stay[some].all() else [words[i] for i in np.flatnonzero(stay[some]).tolist()]))
        n = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        columns = [pa.array(n, pa.int64()), pa.concat_arrays(runs) if runs else pa.array([], pa.list_(_RUN))]
        names = ["n_words", "runs"]
        if texts:
            columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
            names.append("collapsed")
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])


def find_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST, texts: bool = False) -> DataFrame:
    """(row, n_words, runs) of each text: docs' row as a struct without its text, and the runs by start and period; with `texts`
    also collapsed, the text's words joined by one space without those that repeat a run's first period."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    fields = [rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", _RUNS), *([T.StructField("collapsed", T.StringType())] if texts else [])]
    return in_arrow(rows, partial(_reported, times=times, least=least, texts=texts), T.StructType(fields))


def greatest(runs: str = "runs"):
    """The run with the greatest length for its period; the one that starts first, then the one with the smaller period if several tie."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    none = F.lit(None).cast(_RUNS.elementType)
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | better(r, best), r).otherwise(best))


def _periodic(docs: DataFrame) -> DataFrame:
    """documents as the contract of the query alters them: the words of every tenth document (by crc32) repeat from some place on."""
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    hashed = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", hashed.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("w").cast("long"), "g": F.floor(F.col("h") / 10)})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    altered = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, altered).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")), texts=True).withColumn("best", greatest())
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )


#: Every period tried on every word: pairs of equal words a period apart, in stretches. The checksum is computed bit by bit.
ORACLE_SQL = r"""
WITH tab AS (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM generate_series(0, 255) s(b))),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT rid, doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1])), 4294967295) AS h FROM d, tab),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS c FROM h),
x AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(generate_series(0, n - 1), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // c) + 1] END) END AS w FROM g),
t AS (SELECT rid, n, i, w[i + 1] AS word FROM (SELECT rid, n, w, unnest(generate_series(0, n - 1)) AS i FROM x WHERE n > 0)),
m AS (SELECT p.rid, p.i, q.i - p.i AS q FROM t p JOIN t q ON p.rid = q.rid AND p.word = q.word AND q.i > p.i AND 4 * (q.i - p.i) <= p.n),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS part FROM m) GROUP BY rid, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) = 1),
said AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(generate_series(start + period, start + length - 1)) AS i FROM r),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, n AS n_words
FROM x LEFT JOIN said USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""
