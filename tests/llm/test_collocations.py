"""Phrases against a count in plain Python, with ids by rank, without, and in tiles of both kinds."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from clipstride.llm import collocations


def brute(rows, least, most, inside=50):
    f, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            words = phrase.split(" ")
            if len(words) == 1 or a < least:
                continue
            if len(words) == 2 and any(
                    n >= least and 100 * n >= inside * a and long.count(" ") == 2 and (long.startswith(phrase + " ") or long.endswith(" " + phrase))
                    for long, n in counts.items()):
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[" ".join(words[:k])], counts[" ".join(words[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, phrase.encode(), phrase, left, right))
        found.sort()
        out += [(lang, i + 1, p, -a, left, right, totals[lang], -s) for i, (s, a, _, p, left, right) in enumerate(found[:most])]
    return sorted(out)


def corpus():
    draw = random.Random(4)
    words = ["a", "b", "A", "c", "dé", "É", " x", "e", "of", "the"]
    rows = [(draw.choice(["en", "fr", None, ""]), " ".join(draw.choice(words) + draw.choice(["", "", "", ",", ".\n", "\t", "\r"]) for _ in range(draw.randint(0, 60))))
            for _ in range(120)]
    return rows + [("en", None), (None, ""), ("fr", " \t "), ("en", "of the end " * 300), rows[0], rows[0], ("x", "never again")]


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(i, lang, text, 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n long")
    return sorted(tuple(r) for r in collocations.collocations(docs.repartition(3), **options).collect())


@pytest.mark.parametrize("head", [1 << 19, 7, 0])
def test_equals_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(collocations, "HEAD", head)
    monkeypatch.setattr(collocations, "HEAD_PAIRS", 5)
    rows = corpus()
    assert mined(spark, rows, least=5, most=25) == brute(rows, 5, 25)
    if head == 7:
        assert mined(spark, rows) == brute(rows, 10, 2000)


def test_tiles_and_coordinates_agree(monkeypatch):
    monkeypatch.setattr(collocations, "CROWDED", 200)
    draw = np.random.default_rng(3)
    want, cells = Counter(), collocations._Cells()
    for _ in range(3):
        left, right = (np.minimum(draw.geometric(0.004, 5000), 1500).astype(np.int64) for _ in range(2))
        code = left << collocations.ID_BITS | right
        want.update(code.tolist())
        cells.add(np.where(left > 1400, -1, left), right, code, 2)
    assert len(cells.tiles) == 2
    got = Counter()
    for codes, n in cells.rows(None):
        got.update(dict(zip(codes.tolist(), n.tolist())))
    assert got == want


def test_quotients_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    schema = "lang string, n long"
    words = spark.createDataFrame([("en", "x", big + 1), ("en", "y", big + 3)], "lang string, word string, n long")
    phrases = spark.createDataFrame([("en", "x y", ["x", "y"], big)], "lang string, phrase string, parts array<string>, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda docs, least: (spark.createDataFrame([("en", 3 * big)], schema), words, phrases))
    (row,) = collocations.collocations(spark.range(0)).collect()
    assert row["score"] == 1_000_000 * big * big // ((big + 1) * (big + 3)) == 999_999


def test_empty_table(spark):
    assert mined(spark, []) == [] == mined(spark, [(None, None)])
