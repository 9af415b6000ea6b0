"""The pipeline's near-dedup stage against brute force on planted copies, by similarity band."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest

from clipstride.llm import near_dedup, tensored_minhash


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(count=240):
    """(text, copy with some words replaced) of 150 to 400 words, sharing a common line."""
    draw = random.Random(8)
    line = "all rights are reserved by the owners of this work"
    out = []
    for i in range(count):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(150, 400))]
        copy = list(words)
        for at in draw.sample(range(len(copy)), int(len(copy) * draw.choice([0.005, 0.01, 0.02, 0.03]))):
            copy[at] = f"x{draw.randrange(5000)}"
        out.append((f"{line} {' '.join(words)}", f"{line} {' '.join(copy)}"))
    return out


@pytest.mark.parametrize("large", [4096, 2])
def test_recall_by_similarity_band(spark, monkeypatch, large):
    monkeypatch.setattr(tensored_minhash, "LARGE", large)
    pairs = planted()
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    bands = defaultdict(lambda: [0, 0])
    for i, (a, b) in enumerate(pairs):
        near = similarity(a, b)
        assert 2 * i in kept
        band = bands[int(near * 20) if near >= 0.8 else 0]
        band[0] += 1
        band[1] += 2 * i + 1 not in kept
    assert bands.pop(0)[1] == 0  # nothing below 0.8 goes
    assert set(bands) >= {16, 17, 18, 19} and all(n >= 10 and n == gone for n, gone in bands.values()), dict(bands)


def test_chains_repeats_and_odd_texts(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    chain = []
    for _ in range(40):  # each near the one before, not the first
        chain.append(" ".join(words))
        for at in draw.sample(range(300), 4):
            words[at] = f"y{draw.randrange(10**6)}"
    assert similarity(chain[0], chain[-1]) < 0.5 and all(similarity(a, b) >= 0.8 for a, b in zip(chain, chain[1:]))
    rows = [(100 + i, t) for i, t in enumerate(chain)] + [(1, None), (2, ""), (3, "A b"), (4, "a  b"), (5, "b a"), (None, chain[3]), (None, "lone"), (3, "A b")]
    kept = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept) == [(0, "lone"), (1, ""), (3, "A b"), (5, "b a"), (100, "w0 w1")]
