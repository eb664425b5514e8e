"""Operator 6, token counts: offset-mapped attribution.

A document is rendered as one string, its fields on end with a separator between
them, and encoded once as a whole. Byte-level vocabularies lose nothing, so the
lengths of the ids, added up, are the byte span of every token, and counting the
bytes that begin a code point maps these to characters. The spans of the tokens are
then interval-joined to the spans of the sections: both are sorted and cover
the text, so two binary searches find the sections that a token touches.

A token that crosses a boundary is allocated by an explicit rule:
    start  to the section of its first byte
    most   to the section that holds most of its bytes, the first of these in a tie
    share  to each section by its share of the bytes
Under every rule the sections of a document add up to its tokens.

Sections: `field` gives one for each field, `line` splits the fields further after each
line feed. A separator belongs to the field before it.

Defined results: null fields are empty, an empty section has no tokens and is listed for
fields but not for lines (an empty text has no line); repeated rows are counted each;
an empty table gives an empty one; columns besides those named are not read, so their
names may clash with anything; a token that starts within a character begins at that
character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, table

RULES = ("start", "most", "share")
#: Rows that leave a task at once.
ROWS = 20_000


@lru_cache(maxsize=2)
def encoding(path: str, split: str):
    """The encoder of a byte-level vocabulary given as ranks, and the bytes of each id."""
    import tiktoken

    ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, open(path, "rb"))}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for word, rank in ranks.items():
        lengths[rank] = len(word)
    return tiktoken.Encoding("driftgrid", pat_str=split, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(token_at: np.ndarray, section_at: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and of these crossing ones; both arrays hold bounds from 0 on."""
    n = len(section_at) - 1
    if len(token_at) < 2 or n < 1:
        return np.zeros(max(n, 0)), np.zeros(max(n, 0), np.int64)
    starts, ends = token_at[:-1], token_at[1:]
    # empty sections share their bound with the next one; the last that begins there holds the byte
    first = np.searchsorted(section_at, starts, "right") - 1
    last = np.searchsorted(section_at, ends, "left") - 1
    crossing = last > first
    owner = first.copy()
    counts = np.zeros(n)
    for i in np.flatnonzero(crossing).tolist() if rule != "start" else ():
        touched = np.arange(first[i], last[i] + 1)
        held = np.minimum(section_at[touched + 1], ends[i]) - np.maximum(section_at[touched], starts[i])
        if rule == "most":
            owner[i] = touched[int(np.argmax(held))]
        else:
            counts[touched] += held / (ends[i] - starts[i])
    whole = ~crossing if rule == "share" else np.ones(len(owner), bool)
    counts += np.bincount(owner[whole], minlength=n)
    return counts, np.bincount(owner[crossing], minlength=n)


def sections_of(fields: list[bytes], separator: bytes, unit: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The rendered text, the bounds of its sections, and the field of each section."""
    parts = [f + (separator if i < len(fields) - 1 else b"") for i, f in enumerate(fields)]
    text = b"".join(parts)
    bounds = np.cumsum([0, *map(len, parts)])
    if unit == "field":
        return text, bounds, np.arange(len(parts))
    cuts = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    bounds = np.unique(np.concatenate([bounds, cuts]))
    field_of = np.searchsorted(np.cumsum(list(map(len, parts))), bounds[:-1], "right")
    return text, bounds, field_of


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str, split: str, separator: str, unit: str, rule: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder, lengths = encoding(vocabulary, split)
    gap = separator.encode()
    for batch in batches:
        held: list[list] = [[] for _ in schema]
        rows = 0
        ids = batch.column(0)
        for i, fields in enumerate(zip(*batch.columns[1:], strict=True)):
            text, bounds, field_of = sections_of([(f.as_py() or "").encode() for f in fields], gap, unit)
            if len(bounds) < 2:
                continue
            tokens = np.concatenate([[0], np.cumsum(lengths[encoder.encode_to_numpy(text.decode(), disallowed_special=())])])
            counts, crossing = allocate(tokens, bounds, rule)
            # code points before each bound
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[bounds]
            n = len(counts)
            for column, value in zip(held, (np.full(n, i), np.arange(n), field_of, chars[:-1], np.diff(chars), counts, crossing), strict=True):
                column.append(value)
            rows += n
            if rows >= ROWS:
                yield _rows(held, ids, schema)
                held, rows = [[] for _ in schema], 0
        if rows:
            yield _rows(held, ids, schema)


def _rows(held: list[list], ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    first, *rest = [np.concatenate(c) for c in held]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), *[pa.array(c, f.type) for c, f in zip(rest, list(schema)[1:], strict=True)]], names=schema.names)


def count_tokens(docs: DataFrame, vocabulary: str, split: str, fields: tuple[str, ...] = ("text",), separator: str = "\n", unit: str = "line", rule: str = "start") -> DataFrame:
    """(doc_id, section, field, first_char, n_chars, n_tokens, n_crossing): a row for each section of each document."""
    if rule not in RULES or unit not in ("field", "line"):
        raise ValueError(f"rule is one of {RULES}, unit is field or line")
    out = [("doc_id", pa.int64(), T.LongType()), ("section", pa.int64(), T.LongType()), ("field", pa.int32(), T.IntegerType()), ("first_char", pa.int64(), T.LongType()), ("n_chars", pa.int64(), T.LongType()), ("n_tokens", pa.float64(), T.DoubleType()), ("n_crossing", pa.int64(), T.LongType())]
    schema = T.StructType([T.StructField(name, kind) for name, _, kind in out])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    counted = partial(_counted, vocabulary=vocabulary, split=split, separator=separator, unit=unit, rule=rule, schema=pa.schema([(name, kind) for name, kind, _ in out]))
    return in_arrow(rows, counted, schema)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every whole text; a crossing token goes to the line that holds most of it."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="most")
    return found.withColumn("n_tokens", F.col("n_tokens").cast("long")).drop("field")
