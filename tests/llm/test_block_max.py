"""Ranked search against plain Python, with shards and blocks so small that bounds and rejections are used."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from clipstride.llm import block_max

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    count, total = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        asked, found = Counter(w for w in terms(text) if w in df), []
        for doc, c, n in held:
            score = sum(
                times * math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * (75 + 25 * n * count // total)))
                for w, times in asked.items() if c[w])
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def corpus(count=500):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["É", "ß9", "X"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randint(1, 40))) + draw.choice(["", "!", "\x00w1", "-É"])) for i in range(count)]
    docs += [(count + i, docs[7][1]) for i in range(30)] + [(9000, None), (9001, ""), (9002, " .,"), (None, docs[7][1]), docs[3], (9003, "w0 " * 400)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for i in range(25)]
    return docs, items + [(100, None), (101, ""), (102, "unknown"), (103, docs[7][1]), (103, docs[7][1]), (None, "w1 W1 w2")]


def searched(spark, docs, items, k):
    docs = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, term string").repartition(3)
    items = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in block_max.search(block_max.index(docs), items, k).collect()), key=str)


@pytest.mark.parametrize("k,queries", [(20, 256), (3, 4)])
def test_equals_brute_force(spark, monkeypatch, k, queries):
    monkeypatch.setattr(block_max, "QUERIES", queries)
    monkeypatch.setattr(block_max, "BLOCK", 8)
    monkeypatch.setattr(block_max, "SHARD_BYTES", 3000)
    docs, items = corpus()
    assert searched(spark, docs, items, k) == brute(docs, items, k)


def test_blocks_are_rejected_unopened(monkeypatch):
    """Lists of small bound are looked up only where a block may lift a candidate."""
    draw = np.random.default_rng(1)
    docs = 20_000
    m = np.full(docs, 100)

    def postings(places, tf, size=128):
        cuts = list(range(0, len(places), size))
        parts = [(places[c : c + size], tf[c : c + size]) for c in cuts]
        columns = [np.array(x) for x in zip(*((p[0], p[-1], len(p), t.max(), 100) for p, t in parts))]
        return block_max._List(*columns, [np.diff(p).astype(np.uint16).tobytes() for p, _ in parts], [t.astype(np.uint32).tobytes() for _, t in parts], m)

    rare = postings(np.sort(draw.choice(docs, 200, replace=False)), draw.integers(1, 40, 200))
    common = postings(np.arange(docs), np.where(np.arange(docs) < 2000, 9, 1))
    place, score = block_max.ranked([(9000, rare), (30, common)], docs, 5)
    full = np.zeros(docs, np.int64)
    for factor, x in ((9000, rare), (30, common)):
        at, add = x.all()
        full[at] += factor * add
    assert sorted(score)[-5:] == sorted(full)[-5:] and (full[place] == score).all()
    fresh = postings(np.arange(docs), np.where(np.arange(docs) < 2000, 9, 1))
    block_max.ranked([(9000, rare), (30, fresh)], docs, 5)
    assert 0 < len(fresh.open) < 20 < len(fresh.last)


def test_long_texts_and_numbers_beyond_64_bits():
    n = np.array([1, 10**9], np.int64)
    assert block_max.length_terms(n, 10**11, 10**13).tolist() == [75, 75 + 25 * 10**20 // 10**13]
    assert block_max.weight(3, 3) == math.floor(1000 * math.log(8 / 7))


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")], 5) == [] == searched(spark, [(1, "a")], [], 5)
