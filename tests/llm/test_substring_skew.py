"""Substring dedup where much of the input meets in one place."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clipstride.llm import substring_dedup


def test_a_common_line_does_not_fill_one_bucket(spark, monkeypatch):
    """Every document holds one ten-word line (its runs all small enough to be chosen) among text of its own."""
    monkeypatch.setattr(substring_dedup, "BUCKET", 20_000)
    draw = random.Random(4)
    text = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    run_hash = lambda ws: substring_dedup._mixed(substring_dedup._window_hashes(substring_dedup._word_hashes(pa.array(ws)), 4)).min()
    line = min((text(10) for _ in range(300)), key=run_hash)
    found = [[*text(60), *line, *text(60)] for _ in range(400)]
    found.append(found[7])
    rows = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(found)], "doc_id long, text string")
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    size = sum(len(" ".join(ws)) for ws in found)
    frequent = substring_dedup.frequent_runs(keyed, size, 35)
    batch = pa.record_batch({"key": pa.array(range(len(found)), pa.int64()), "text": pa.array([" ".join(ws) for ws in found])})

    def largest(frequent):
        sent = Counter()
        for out in substring_dedup._send(35, 500, frequent)([batch]):
            for bucket, block in zip(out.column("bucket").to_pylist(), out.column("block").to_pylist()):
                sent[bucket] += sum(map(len, substring_dedup._unpack(block)[3]))
        return max(sent.values())

    assert largest(substring_dedup.NONE) > 0.2 * size  # what one minimiser draws without the list
    assert len(frequent) >= 7 and largest(frequent) < 0.02 * size
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.digests(rows).collect()}
    assert removed == {i: 130 if i in (7, 400) else 0 for i in range(401)}


def test_frequent_runs_change_no_count():
    """Any list of frequent runs, even all of them, lets equal windows meet."""
    draw = random.Random(6)
    words = [draw.choice("abc") for _ in range(400)]
    hashes = substring_dedup._word_hashes(pa.array(words))
    every = np.unique(substring_dedup._mixed(substring_dedup._window_hashes(hashes, 4)))
    for window, frequent in ((8, every), (20, every), (20, every[::2])):
        text, start, number, least = substring_dedup.super_kmers(np.array([250, 150]), hashes, window, frequent)
        place = {}
        for t, s, n, m in zip(text, start, number, least):
            for k in range(s, s + n):
                at = k + 250 * t
                assert place.setdefault(tuple(words[at : at + window]), m) == m
        assert number.sum() == 400 - 2 * (window - 1)


def test_ranges_of_repeated_rows_are_sent_once(spark):
    """A row repeated n times has as many ranges as one, not n times as many in each of its n rows."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([(1, text)] * 200 + [(2, text)], "doc_id long, text string")
    for r in substring_dedup.covered(rows).select("__ranges").collect():
        assert sum(map(len, r["__ranges"])) <= 8 * 300
    assert rows.count() == substring_dedup.digests(rows).where("n_removed = 300").count()


def test_ranges_are_merged_by_key():
    draw = np.random.default_rng(3)
    key, low = draw.integers(-3, 3, 200), draw.integers(0, 300, 200).astype(np.int32)
    high = low + draw.integers(1, 9, 200).astype(np.int32)
    got = list(zip(*(x.tolist() for x in substring_dedup.merged(key, low, high))))
    cover = lambda ranges: {(k, p) for k, a, b in ranges for p in range(a, b)}
    assert cover(got) == cover(zip(key.tolist(), low.tolist(), high.tolist()))
    assert all(a[0] < b[0] or a[2] < b[1] for a, b in zip(got, got[1:]))
