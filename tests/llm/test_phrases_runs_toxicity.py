"""Operators 11 to 13 against brute force, on odd rows, and on held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftgrid.llm import collocations, periodic_runs, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, word string, f long, part int, runs string, score double, toxic int, n long"
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", None), (5, "Uno DOS, uno dos; uno\tdos uno dos tres", "es"), (6, "a b c a b c a b c a b c a b c", "en"),
    (6, "a b c a b c a b c a b c a b c", "en"), (None, "x x x x x x x x. x x", "en"), (None, None, None), (7, "wide 漢字 " * 30, "zh"), (8, "É é idiot " * 9, "fr"), (9, "y" * 5000, "en"), (10, "k l m n " * 3 + "k l m n o", "und"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, lang, "s", 1, "r", "w", 2, 3, "q", 0.5, 1, 4) for d, t, lang in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"], r["lang"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_phrases(rows, least, longest=4):
    count, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            count.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return {k: v for k, v in count.items() if v >= least}, n


def brute_collocations(rows, least, top):
    f, n = brute_phrases(rows, least)
    found = []
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        score, k = min(((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]])), k) for k in range(1, len(w)))
        longer = [g for (o, v), g in f.items() if o == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * g >= 80 * a for g in longer):
            found.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    found.sort()
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in found:
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_collocations(spark, odd, docs):
    rows = [(d, t, lang) for d, t, lang in ODD]
    for least, top, part_words, bits in ((2, 5, 4_000_000, 25), (2, 2000, 8, 4), (3, 3, 16, 16)):
        got = sorted(map(tuple, collocations.collocations(odd, least=least, top=top, part_words=part_words, bits=bits).collect()))
        assert got == brute_collocations(rows, least, top)
    phrases, totals = collocations.mine(odd, least=2, part_words=8, bits=4)
    f, n = brute_phrases(rows, 2)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in phrases.collect()} == f
    assert {r["lang"]: r["n"] for r in totals.collect()} == {k: v for k, v in n.items() if v}
    assert collocations.collocations(odd.limit(0)).count() == 0
    # a word that is most of all words is dealt over many parts
    busy = spark.createDataFrame([(i, " ".join("the" if j % 3 else f"w{(i * 7 + j) % 23}" for j in range(60)), "en") for i in range(40)], "doc_id long, text string, lang string")
    wanted = brute_collocations([tuple(r) for r in busy.collect()], 5, 2000)
    assert sorted(map(tuple, collocations.collocations(busy, least=5, part_words=100, bits=12).collect())) == wanted and wanted
    # the query itself, on whole documents
    assert sorted(map(tuple, collocations.op11_collocations(spark, SF).collect())) == brute_collocations(docs, 30, 2000)


def test_collocations_sent(spark, odd):
    """A part gets one row for `send_words` words, not one for each block, language and kind; and sends of a few words give the same."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 400)) for _ in range(64)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(texts[i : i + 2])], names=["lang", "text"]) for i in range(0, 64, 2)]
    every = np.full(1 << 9, 255, np.uint8)
    for hot in (every, np.zeros_like(every)):
        sent = pa.Table.from_batches(collocations._projected(iter(batches), 50, 4, every, hot, 12))
        assert sent.num_rows == len(set(sent.column("part").to_pylist())) <= 50
    wanted = brute_collocations([(d, t, lang) for d, t, lang in ODD], 2, 2000)
    for part_words, bits, send_words in ((8, 4, 1), (1000, 16, 7)):
        assert sorted(map(tuple, collocations.collocations(odd, least=2, part_words=part_words, bits=bits, send_words=send_words).collect())) == wanted


def brute_runs(w, times=4, least=6):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in out.items())


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(w)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[2] - r[0], r[1]), r[0], r[1]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    return doc_id, len(runs), *top, sha("".join(f"{s},{e - s},{q}\n" for s, q, e in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs(spark, odd, docs):
    rng = np.random.default_rng(5)
    made = []
    for i in range(300):
        w = ["abcd"[k] for k in rng.integers(0, rng.integers(1, 4), rng.integers(0, 30))]
        unit = ["abcde"[k] for k in rng.integers(0, 5, rng.integers(1, 7))]
        w += (unit * 12)[: rng.integers(0, 60)] + ["abcde"[k] for k in rng.integers(0, 5, rng.integers(0, 9))]
        made.append((i, " ".join(w * int(rng.integers(1, 4)))))
    rows = made + [(d, t) for d, t, _ in ODD] + [(1000, "p q r s t " * 40_000), (1001, ("plain words %d " * 60_000) % tuple(range(60_000)))]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("row", F.lit("x"))
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    got = [(r["row"]["doc_id"], sorted((x["start"], x["period"], x["start"] + x["length"]) for x in r["runs"]), r["collapsed"]) for r in periodic_runs.find_runs(table, texts=True).collect()]
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        runs = [(0, 5, 200_000)] if d == 1000 else [] if d == 1001 else brute_runs(w)
        gone = {i for s, q, e in runs for i in range(s + q, e)}
        want.append((d, runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic_runs.find_runs(odd.limit(0)).count() == 0
    three = periodic_runs.find_runs(spark.createDataFrame(made, "doc_id long, text string"), times=3, least=3).collect()
    assert all(sorted((x["start"], x["period"], x["start"] + x["length"]) for x in r["runs"]) == brute_runs(WORD.findall(made[r["row"]["doc_id"]][1]), 3, 3) for r in three)
    # the query itself, on whole documents and on odd ones
    sf = {d: tuple(r)[:8] for r in periodic_runs.op12_periodic_runs(spark, SF).collect() for d in [r["doc_id"]]}
    assert sf == {d: brute_row(d, t) for d, t, _ in docs}


def test_run_query_on_odd_rows(spark, odd, tmp_path):
    odd.withColumn("start", F.lit("c")).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    got = [tuple(r)[:8] for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted((brute_row(d, t) for d, t, _ in ODD), key=key)


def brute_segments(scores):
    """The greatest segment (the first and shortest of equals), then those of what lies before and after it."""
    best, n = (0.0, 0, 0), len(scores)
    for i in range(n):
        total = 0.0
        for j in range(i, n):
            total += scores[j]
            if total > best[0]:
                best = (total, i, j + 1)
    if not best[0]:
        return []
    return [*brute_segments(scores[: best[1]]), best, *[(v, s + best[2], e + best[2]) for v, s, e in brute_segments(scores[best[2] :])]]


def test_segments():
    rng = np.random.default_rng(3)
    for _ in range(400):
        scores = rng.choice([-4.0, -2.0, -1.0, 1.0, 2.0, 5.0], rng.integers(0, 30)) + rng.normal(0, 1e-3)
        got = toxicity.segments(scores)
        want = brute_segments(scores.tolist())
        assert [(s, e) for _, s, e in got] == [(s, e) for _, s, e in want] and np.allclose([x[0] for x in got], [x[0] for x in want])
    assert len(toxicity.segments(np.tile([1.0, -2.0], 300_000))) == 300_000
    assert len(toxicity.segments(np.tile([2.0, -1.0], 300_000))) == 1


def test_extreme_value_law():
    rng = np.random.default_rng(4)
    n = rng.integers(20, 2000, 20_000)
    best = (np.log(0.02 * n) - np.log(-np.log(rng.random(len(n))))) / 1.7
    slope, often = toxicity.fit_law(n, np.maximum(best, 0))
    assert abs(slope - 1.7) < 0.05 and abs(often - 0.02) < 0.002
    assert toxicity.fit_law(np.zeros(0), np.zeros(0))[1] > 0


def test_statistic_of_long_passages(spark):
    """Scores of which a double holds no chance, against sums of exact fractions; and a text of two passages of 600 words."""
    model = toxicity.SegmentModel(rate=0.1, slope=2.0, often=1 / 1024)

    def plain(n, scores):
        best = 0.0
        for r, value in enumerate(sorted(scores, reverse=True)[: toxicity.RANKS], 1):
            mean = Fraction(np.exp(-model.slope * value / 4)) ** 4 * Fraction(n, 1024)
            tail = sum(mean**k * Fraction(1, math.factorial(k)) for k in range(r, r + 20))
            chance = math.log(tail.numerator) - math.log(tail.denominator) - float(mean)
            best = max(best, -math.log(mean.numerator) + math.log(mean.denominator) if r == 1 else -chance - math.log(toxicity.RANKS) if mean < 1 else best)
        return best

    for n, scores in ((2048, [3.0, 2.5, 2.0, 1.0]), (2048, [60.0, 55.0, 40.0]), (2048, [400.0, 390.0, 380.0, 3.0]), (4096, [900.0, 700.0])):
        assert abs(model.statistic(n, scores) / plain(n, scores) - 1) < 1e-9
    rows = [(i, "plain words of text " * (1 + i % 9) + ("you idiota " if i % 4 == 0 else "")) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    passage = "idiota " * 600
    got = toxicity.score(spark.createDataFrame([(1, passage + "plain words " * 3000 + passage)], "doc_id long, text string"), model).first()
    assert [p["tokens"] for p in got["passages"]] == [600, 600] and got["score"] > 0.9


def test_tree_of_rates():
    """Rates of the tree against counting each document's tokens one by one."""
    texts = ["stupid stupido plain", "stupid plain words", "plain words here stu", "words stupidity plain", "here plain", "Stupid, here"]
    toxic = [1, 1, 0, 1, 0, 0]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    model = toxicity.SegmentModel(rate=0.5)
    import pyarrow as pa

    rows = pa.Table.from_batches(toxicity._counted([pa.RecordBatch.from_arrays([pa.array(toxic), pa.array(texts)], names=["toxic", "text"])])).to_pandas()
    toxicity._tree_odds(model, rows["level"].to_numpy(), rows["node"].to_numpy(np.int64).view(np.uint64), rows["above"].to_numpy(np.int64).view(np.uint64), rows["toxic"].to_numpy(), rows["total"].to_numpy(), 8.0)
    low, starts, ends = toxicity.tokens(data, offsets)
    tree, of = toxicity.chains(low, starts, ends)
    scores = model.token_scores(tree)[of] + model.drift
    found = {bytes(low[s:e]).decode(): v for s, e, v in zip(starts, ends, scores, strict=True)}
    of_doc = [set(re.findall("[a-z]+", t.lower())) for t in texts]
    for token, value in found.items():
        rate, last = 0.5, -1
        for k in [*toxicity.PREFIXES, None]:
            holds = [d for d, w in enumerate(of_doc) if any((x[:k] if k else x) == (token[:k] if k else token) for x in w)]
            if len(holds) != last:
                rate = (sum(toxic[d] for d in holds) + 8 * rate) / (len(holds) + 8)
            last = len(holds)
        assert abs(value - np.log(rate / (1 - rate))) < 1e-9, token


def test_toxicity(spark, odd):
    nothing = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd, nothing).collect()} == {0.0} and toxicity.score(odd.limit(0), nothing).count() == 0
    same = toxicity.learn(odd, spark.createDataFrame([(1, 0), (6, 0), (9, None), (None, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd, same).collect()} == {0.0}
    rows = [(i, ("plain words of text " * (1 + i % 9) + ("you idiota " if i % 4 == 0 else "") + f"tail{i} ")) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(5, None)], "doc_id long, toxic int")))
    extra = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "one more idiotic text " * 2 + "plain words " * 200_000)], "doc_id long, text string"))
    got = toxicity.score(docs.unionByName(extra), model).collect()
    assert len(got) == len(rows) + len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    for r in got[:2400]:
        assert (r["score"] >= 0.3) == (r["row"]["doc_id"] % 4 == 0)
        assert [p["text"] for p in r["passages"]] == (["idiota"] if r["row"]["doc_id"] % 4 == 0 else []) or r["row"]["doc_id"] % 4 == 0
        assert all(p["expected"] <= toxicity.EXPECTED for p in r["passages"])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op13_toxicity(spark, sf).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    caught = sum(r["predicted"] and r["toxic"] for r in held)
    assert caught >= 0.9 * sum(r["toxic"] for r in held) and caught >= 0.95 * sum(r["predicted"] for r in held)
