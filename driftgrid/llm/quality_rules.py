"""Operator 1, quality rules: a bitmask ledger.

`ledger` evaluates every rule once for each document and stores the measurements
and one long of failure bits. A policy is a named, versioned mask of those bits;
`apply_policy` and `ablation` read the ledger alone and never the texts again.

Defined results: a null or empty text has no words, so it fails `few_words`; ties
and repeated rows are judged one by one; a table without rows gives none; further
columns of the input are left out unless listed in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, blocks, in_arrow, line_hashes, rows_of, runs_of, text_buffers, window_sums, word_hashes, words_of

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]

#: Rules in the order of their bits; each is true where a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 25 * n_words",
    "upper_case": "2 * n_upper > word_chars",
    "exclamation": "10 * n_bangs > n_words",
}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, list[str]] = {"base-1": ["few_words", "repeated_words"], "web-1": list(RULES)}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: list[str]) -> int:
    return sum(map(bit, rules))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: found more than once in its row; found earlier in its row."""
    order = np.argsort(keys + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), kind="stable")
    same = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, again


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The MEASURES of each text (one column each)."""
    n = len(offsets) - 1
    starts, ends = words_of(data, offsets)
    row = rows_of(offsets, starts)
    word_at = np.searchsorted(starts, offsets)
    out = np.zeros((len(MEASURES), n), np.int64)
    out[0] = np.diff(word_at)
    out[1] = _per_row(~IS_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    out[2] = _per_row(_SYMBOL[data], offsets)
    out[6] = _per_row(_UPPER[data], offsets)
    out[7] = _per_row(data == 33, offsets)
    # lines: spans between line feeds that hold a word
    lines, line_ends = runs_of(data != 10, offsets)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)
    if worded.any():
        lines, line_ends = lines[worded], line_ends[worded]
        of = rows_of(offsets, lines)
        # the hash must stop at the line's end: what follows it, up to the next line, is taken off
        clean = np.concatenate([[0], np.cumsum(line_ends - lines)])
        packed = np.repeat(lines - clean[:-1], line_ends - lines) + np.arange(clean[-1])
        _, again = _repeats(line_hashes(data[packed], clean[:-1], clean[1:]), of)
        out[3] = np.bincount(of[again], minlength=n)
        out[5] = np.bincount(of, minlength=n)
    if len(starts) >= 3:
        grams = window_sums(word_hashes(data, starts, ends), 3)
        inside = row[2:] == row[:-2]
        at = np.flatnonzero(inside)
        twice, _ = _repeats(grams[at], row[at])
        covered = np.zeros(len(starts), bool)
        for shift in range(3):
            covered[at[twice] + shift] = True
        out[4] = np.bincount(row[covered], minlength=n)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.num_columns - 1))
        found = [np.zeros((len(MEASURES), 0), np.int64)]
        for lo, hi in blocks(offsets):
            found.append(measure(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        columns = list(np.concatenate(found, axis=1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns)], names=[*batch.schema.names[:-1], *MEASURES])


def failure_bits() -> Column:
    """All rules as one long; an undefined rule counts as passed."""
    bits = [F.when(F.expr(rule), F.lit(bit(name))).otherwise(F.lit(0)) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the measurements and fail_bits, one row for each row of docs."""
    kept = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))
    schema = T.StructType([*kept.schema.fields[:-1], *[T.StructField(m, T.LongType()) for m in MEASURES]])
    measured = in_arrow(kept, _measured, schema)
    return measured.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, failure_bits().alias("fail_bits"))


def rejected_by(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def apply_policy(rows: DataFrame, policy: str, name: str = "kept") -> DataFrame:
    return rows.withColumn(name, ~rejected_by(policy))


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that stay without it.

    Rows are first counted by their failure bits: at most two to the number of rules
    of counts leave each task.
    """
    rules = POLICIES[policy]
    active = F.col("fail_bits").bitwiseAND(F.lit(mask(rules)))
    counts = rows.groupBy(active.alias("bits")).agg(F.count("*").alias("n"))
    per_rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit")) for r in rules]))
    hits = counts.select("bits", "n", per_rule.alias("r")).select("bits", "n", "r.*")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return hits.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("n_fail"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def rule_ablation(spark, sf_dir: str) -> DataFrame:
    """The ablation of the policy web-1 over all documents."""
    from .common import table

    return ablation(ledger(table(spark, sf_dir, "documents")), "web-1")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), "web-1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rejected_by("base-1").alias("base_failed"), "kept", "fail_bits")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) >= 2),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
l AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup, count(*) AS n_lines FROM l GROUP BY rid),
m AS (SELECT w.doc_id, len(words) AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        coalesce(u.n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(u.n_lines, 0) AS n_lines,
        len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_bangs
      FROM w LEFT JOIN u USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END
        + CASE WHEN 10 * n_bangs > n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

ABLATION_SQL = f"""
WITH r AS (SELECT fail_bits FROM ({ORACLE_SQL}) AS ledger), rules(rule, b) AS (VALUES {", ".join(f"('{r}', {bit(r)})" for r in POLICIES["web-1"])})
SELECT rule, count(*) FILTER (fail_bits & b <> 0) AS n_fail, count(*) FILTER (fail_bits = b) AS n_only, count(*) FILTER (fail_bits = b OR fail_bits = 0) AS n_kept_without
FROM rules CROSS JOIN r GROUP BY rule
"""
