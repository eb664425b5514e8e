"""Registered queries themselves, with their own parameters, against brute force on whole documents."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from driftgrid.llm import near_dedup, packing, suffix_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def test_packing_query(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.op2_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    for d, own in ids.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(own)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == -(-sum(map(len, ids.values())) // 4096)  # no padding but in the last


def test_near_dedup_query(spark, docs):
    sets = {}
    for d, text in docs.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[d] = {(a, b) for a, b in zip(w, w[1:], strict=False)} or ({tuple(w)} if w else set())
    least = {d: d for d in docs}

    def top(d):
        while least[d] != d:
            d = least[d]
        return d

    order = sorted(docs)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= 80 * (len(x) + len(y) - common):
                    p, q = sorted((top(a), top(b)))
                    least[q] = p
    want = {d: (len(sets[d]), top(d), top(d) == d) for d in docs}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op3_near_dedup(spark, SF).collect()}
    assert got == want and not all(kept for _, _, kept in want.values())


def test_suffix_dedup_query(spark, docs):
    seen, want = set(), {}
    for d in sorted(docs):
        text = docs[d].encode()
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 99):
            part = text[i : i + 100]
            if part in seen:
                gone[i : i + 100] = True
            seen.add(part)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        want[d] = (len(text), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op8_suffix_dedup(spark, SF).collect()}
    assert got == want and any(n for _, n, _, _ in want.values())


def test_packing_of_many_sources(spark):
    """Far more sources than queues: each keeps its share of every window, and every token is in one piece."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "some plain words of a text here "
    rows = [(i, f"s{i % 40}", text * (20 + i % 7)) for i in range(2000)] + [(None, None, text * 30)] * 50 + [(7, "s1", text * 9)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for targets, queues in (({}, 3), ({"s1": 0.25}, 6)):
        pieces = packing.pack(docs, path, least_piece=32, queues=queues, lane_windows=8, targets=targets).collect()
        of = {d: s for d, s, _ in rows}
        window, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
        spans = defaultdict(list)
        for r in pieces:
            window[r["sequence_id"]][of[r["doc_id"]]] += r["length"]
            total[of[r["doc_id"]]] += r["length"]
            spans[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in spans.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 4096
        everything = sum(total.values())
        assert everything == sum(r[0] for r in packing.pack(docs, path, queues=4096).select("length").collect()) and len(spans) == -(-everything // 4096)
        rest = {s: n for s, n in total.items() if s not in targets}
        share = {s: 4096 * (1 - sum(targets.values())) * n / sum(rest.values()) for s, n in rest.items()} | {s: 4096 * w for s, w in targets.items()}
        lasting = [w for w in window if not targets or window[w]["s1"] > 900]
        assert len(lasting) > 3
        for w in lasting[:-1] if targets else [w for w in window if w < len(spans) - 1]:
            assert all(abs(window[w][s] - share[s]) <= 2 * 32 + 32 for s in share), w
    ids = {}
    for r in pieces:
        if r["doc_id"] is not None and r["doc_id"] != 7:
            ids.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for own in ids.values():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length


def test_very_long_texts_of_the_others(spark):
    """A text of 20 MB in the operators that `test_very_long_texts` leaves out: 6, 10, 11, 12 and 13."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from driftgrid.llm import chat_format, collocations, periodic_runs, token_counts, toxicity

    rng = np.random.default_rng(31)
    vocabulary = [f"word{x:05d}" for x in range(40_000)]
    lines = [" ".join(vocabulary[i] for i in rng.integers(0, 40_000, 20)) + " same four words here." for _ in range(91_000)]
    text = "\n".join(lines)
    assert len(text) > 20_000_000
    docs = spark.createDataFrame([(1, text, "en"), (2, "short text", None)], "doc_id long, text string, lang string").repartition(2)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, path, pattern, rule="most").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.sum("n_tokens").alias("tokens")).collect()}
    assert got[1]["n"] == len(lines) and got[1]["chars"] == len(text) and got[1]["tokens"] > 20 * len(lines)
    found = {r["phrase"]: r for r in collocations.collocations(docs.select("lang", "text"), least=80_000).collect()}
    assert set(found) == {"same four words here"} and found["same four words here"]["a"] == len(lines) and found["same four words here"]["n"] == 24 * len(lines)
    scored = {r["row"]["doc_id"]: r for r in toxicity.score(docs, toxicity.SegmentModel()).collect()}
    assert scored[1]["n_tokens"] == 24 * len(lines)
    units = " ".join(f"unit{k:06d}" for k in range(7))
    runs = spark.createDataFrame([(1, " ".join([units] * 260_000)), (2, text)], "doc_id long, text string").repartition(2)
    assert sorted((r["row"]["doc_id"], [tuple(x) for x in r["runs"]], len(r["collapsed"].split())) for r in periodic_runs.find_runs(runs, texts=True).collect()) == [(1, [(0, 1_820_000, 7)], 7), (2, [], 24 * len(lines))]
    said = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "### " + text)], "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.format_chats(said.select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("content")))).first()
    assert back["loss_text"] == "### " + text and [t["text"] for t in back["turns"]] == [text, "### " + text]
