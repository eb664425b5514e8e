"""Hashes of files that no task reads whole, against hashlib."""

import gzip
import hashlib
import random

import pytest

from driftgrid.functions import digest
from driftgrid.sources import feeds


@pytest.mark.parametrize("plain", [False, True])
def test_digest(monkeypatch, plain):
    if plain:
        monkeypatch.setattr(digest, "_compress", lambda: digest.rounds)
    rnd = random.Random(1)
    for n in (0, 1, 55, 56, 63, 64, 65, 119, 120, 128, 1000):
        body, state, at = rnd.randbytes(n), digest.State(), 0
        while at < n:
            step = rnd.randint(0, 90)
            state, at = digest.update(state, body[at : at + step]), at + step
        assert digest.finish(state) == hashlib.sha256(body).hexdigest() and state.n == n


def test_raw_files(spark, tmp_path, monkeypatch):
    """Bytes of all kinds in splits of 70, by a reader that takes no file of over 100 whole; that stands for the 2 GB of a row."""
    rnd = random.Random(3)
    bodies = {f"r{i}": bytes(rnd.choice(b"\n\n\r\xef\xbb\xbf\x00ab\xff") for _ in range(rnd.randint(101, 400))) for i in range(4)}
    bodies |= {"mark": feeds.BOM + b"x" * 100 + b"\ny\n", "marks": feeds.BOM * 50, "newlines": b"\n" * 140, "one line": b"z" * 300, "open": b"ab\n" * 50 + b"c", "a[1] {b}*": b"one\ntwo\r\nthree\n" * 9}
    bodies |= {"packed.csv.gz": gzip.compress(rnd.randbytes(200)), "not packed.gz": b"text\n" * 30, "k=1": b"q\n" * 60, "whole": b"hi\n", "edge": b"e" * 100}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    asked, split_hashes = [], feeds._split_hashes
    monkeypatch.setattr(feeds, "_split_hashes", lambda s, path, before: asked.append(path.rsplit("/", 1)[1]) or split_hashes(s, path, before))
    names = ("spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(k, None) for k in names]
    spark.conf.set(names[0], "100")
    try:
        found = feeds.raw_files(spark, str(tmp_path), "f", whole=100, split=70).collect()
    finally:
        spark.conf.unset(names[0])
    assert {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["bytes"], r["source"]) for r in found} == {n: (hashlib.sha256(b).hexdigest(), len(b), "f") for n, b in bodies.items()}
    # a job for each split, but for names of packed files
    assert {n: asked.count(n) for n in bodies} == {n: 0 if len(b) <= 100 else 1 if n.endswith(".gz") else -(-len(b) // 70) for n, b in bodies.items()}
    assert [spark.conf.get(k, None) for k in names] == before
