"""Operator 7, license scans: fuzzy search for short notices.

A text is lower-cased over A-Z and reduced to its words `[0-9a-z and bytes from 0x80]+`,
joined by single spaces. A notice of n characters may be found with up to
n // ERROR_EVERY edits (k). By the pigeonhole principle, a notice cut into k + 1
seeds holds at least one of them unharmed wherever it stands with k edits, so one
exact multi-string search for all seeds gives every candidate place; there the regex
library's bounded-error matching looks for the best match and reports its span and edits.
Exact phrases are found by their words.

Characters are bytes of UTF-8 (a change of one accented letter may count as two edits).

Defined results: a null or empty text has no words, no places and score 0; repeated rows are
scanned each; of overlapping matches of several notices those with the fewest edits count, all of them in a tie; an empty
table gives an empty one; other columns are not read; windows never leave a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, blocks, in_arrow, rows_of, runs_of, table, text_buffers

#: Fixed phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Short notices, as words, and the labels that they add.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("is licensed under the gnu general public license version", "gpl"),
    ("under the terms of the gnu general public license as published by", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
]
#: One edit for so many characters of a notice.
ERROR_EVERY = 13

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())])
_MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("notice", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType())])
_ARROW_PLACE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_ARROW_MATCH = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))


def edits_of(notice: str) -> int:
    return max(1, len(notice) // ERROR_EVERY)


def seeds(notice: str) -> list[tuple[int, str]]:
    """The notice in edits + 1 pieces of about one length, each with its place."""
    n, parts = len(notice), edits_of(notice) + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pattern(notice: str):
    """Best match first, within the notice's edits."""
    import regex

    return regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits_of(notice)}}}")


@lru_cache(maxsize=1)
def _search() -> tuple:
    import re

    import ahocorasick

    found = ahocorasick.Automaton()
    by_seed: dict[str, list[tuple[int, int]]] = {}
    for k, (notice, _) in enumerate(NOTICES):
        for at, seed in seeds(notice):
            by_seed.setdefault(seed, []).append((k, at))
    for seed, where in by_seed.items():
        found.add_word(seed, (len(seed), where))
    found.make_automaton()
    exact = [(re.compile(rf"(?<![^ \n]){re.escape(phrase)}(?![^ \n])"), label) for phrase, label in PHRASES]
    return found, [pattern(n) for n, _ in NOTICES], exact


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as words joined by spaces, with a line feed after each text; the places of the words and of
    the texts in it; and each text's first word."""
    data = LOWER[data]
    inside = _WORD[data]
    starts, ends = runs_of(inside, offsets)
    row = rows_of(offsets, starts)
    n = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    length = ends - starts
    # a space follows each word but the last of a text, and a line feed follows each text
    last = np.zeros(len(starts), bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    before = np.concatenate([[0], np.cumsum(length + ~last)])[:-1] + row
    out = np.full(int(length.sum()) + int((~last).sum()) + n, 32, np.uint8)
    shift = np.repeat(before - np.concatenate([[0], np.cumsum(length)])[:-1], length)
    out[np.arange(int(length.sum())) + shift] = data[inside]
    size = np.bincount(row, length + ~last, minlength=n).astype(np.int64) + 1
    text_at = np.concatenate([[0], np.cumsum(size)])
    out[text_at[1:] - 1] = 10
    return out.tobytes().decode("latin-1"), before, text_at, first


def _every(searched, text: str, lo: int, hi: int, least: int) -> Iterator:
    """The best match of a stretch, then those of what is left before and after it: a search goes on after its best match, past worse ones before that."""
    rest = [(lo, hi)]
    while rest:
        a, b = rest.pop()
        m = searched.search(text, a, b) if b - a >= least else None
        if m:
            yield m
            rest += [(a, m.start()), (m.end(), b)]


def scan_block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[dict]], dict[int, list[dict]]]:
    """Words of each text; by row, the exact places and the fuzzy matches."""
    automaton, patterns, exact = _search()
    text, word_at, text_at, first = plain_words(data, offsets)
    places: dict[int, list[dict]] = {}
    for phrase, label in exact:
        for m in phrase.finditer(text):
            row = int(np.searchsorted(text_at, m.start(), "right")) - 1
            places.setdefault(row, []).append({"label": label, "start": int(np.searchsorted(word_at, m.start(), "right")) - 1 - int(first[row])})
    windows: dict[tuple[int, int], list[list[int]]] = {}
    for end, (size, where) in automaton.iter(text):
        row = int(np.searchsorted(text_at, end, "right")) - 1
        for k, at in where:
            edits, begin = edits_of(NOTICES[k][0]), end + 1 - size - at
            lo = max(int(text_at[row]), begin - 2 * edits)
            hi = min(int(text_at[row + 1]) - 1, begin + len(NOTICES[k][0]) + 2 * edits)
            held = windows.setdefault((row, k), [])
            if held and lo <= held[-1][1]:
                held[-1] = [min(lo, held[-1][0]), max(hi, held[-1][1])]
            else:
                held.append([lo, hi])
    matches: dict[int, list[dict]] = {}
    for (row, k), held in windows.items():
        notice, label = NOTICES[k]
        for lo, hi in held:
            for m in _every(patterns[k], text, lo, hi, len(notice) - edits_of(notice)):
                edits = sum(m.fuzzy_counts)
                a, b = (int(np.searchsorted(word_at, p, "right")) - 1 - int(first[row]) for p in (m.start(), max(m.start(), m.end() - 1)))
                matches.setdefault(row, []).append({"label": label, "notice": notice, "first_word": max(0, a), "last_word": b, "edits": edits, "score": 1 - edits / len(notice), "text": m.group().encode("latin-1").decode("utf-8", "replace")})
    return np.diff(first), places, {row: _closest(found) for row, found in matches.items()}


def _closest(found: list[dict]) -> list[dict]:
    """Without the matches that a match of another notice with fewer edits overlaps."""
    kept: list[dict] = []
    for m in sorted(found, key=lambda m: m["edits"]):
        if not any(k["edits"] < m["edits"] and k["first_word"] <= m["last_word"] and m["first_word"] <= k["last_word"] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m["first_word"], m["notice"]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in blocks(offsets):
            words, places, matches = scan_block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            rows = range(hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words, pa.int64()), pa.array([places.get(i, []) for i in rows], _ARROW_PLACE), pa.array([matches.get(i, []) for i in rows], _ARROW_MATCH)], names=["doc_id", "n_words", "places", "matches"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, matches) of each row of docs."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(_PLACE)), T.StructField("matches", T.ArrayType(_MATCH))])
    return in_arrow(docs.select("doc_id", "text"), _scanned, schema)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    found = scan(table(spark, sf_dir, "documents"))
    starts, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    best = F.array_max(F.transform("matches", lambda m: m["score"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
