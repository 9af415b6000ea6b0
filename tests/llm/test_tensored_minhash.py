"""Links and components against brute force, and the bounds on what is compared."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clipstride.llm import tensored_minhash as tm


def brute(rows, size=4, least=80):
    """(n_shingles, component) by row."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holds[g].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in holds[g] if j > i).items():
            if 100 * n >= least * (len(s) + len(sets[j]) - n):
                parent[find(j)] = find(i)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(names.get(find(i), doc), doc)
    return sorted(((doc, len(s), names.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus():
    draw = random.Random(12)
    texts = []
    for i in range(60):  # copies by similarity from 0.7 to 1
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.randint(60, 300))]
        texts.append(words)
        for _ in range(draw.choice([1, 1, 2, 6])):
            copy = list(words)
            for at in draw.sample(range(len(copy)), int(len(copy) * draw.choice([0.0, 0.01, 0.03, 0.05]))):
                copy[at] = f"x{draw.randrange(4000)}"
            texts.append(copy)
    passage = [f"p{i}" for i in range(150)]
    texts += [passage + [f"q{draw.randrange(10**6)}" for _ in range(draw.randint(60, 200))] for _ in range(80)]  # a crowd, no copies
    words = [f"c{i}" for i in range(300)]
    for _ in range(25):  # a chain, each near the one before
        texts.append(list(words))
        for at in draw.sample(range(300), 5):
            words[at] = f"y{draw.randrange(10**6)}"
    rows = [(1000 + i, " ".join(t)) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    return rows + [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a  b"), (6, "b a"), (7, "a b c d"), (None, rows[3][1]), (None, "lone words of no id"), rows[0], rows[0]]


@pytest.mark.parametrize("large,hot", [(4096, 100_000), (3, 2)])
def test_equals_brute_force(spark, monkeypatch, large, hot):
    monkeypatch.setattr(tm, "LARGE", large)
    monkeypatch.setattr(tm, "HOT", hot)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, size int, key string").repartition(3)
    got = tm.near_copies(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_crowd_is_not_checked_pair_by_pair(spark):
    """Texts that share a long passage but are no copies: what goes to the exact check stays below the number of texts."""
    draw = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(150))
    given = {}
    for count in (100, 300):
        rows = [(i, f"{passage} " + " ".join(f"q{draw.randrange(10**6)}" for _ in range(150))) for i in range(count)]
        links = tm.Links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
        checked, given[count] = links.check, 0

        def count_checked(pairs, checked=checked, count=count):
            n = checked(pairs)
            given[count] += n
            return n

        links.check = count_checked
        links.gather()
        assert links.found.isEmpty()
    assert given[100] <= 100 and given[300] <= 300, given


def test_keys_meet_as_often_as_said():
    draw = np.random.default_rng(5)
    met = 0
    for _ in range(60):
        both = draw.integers(0, 1 << 63, 800, dtype=np.int64)
        own = draw.integers(0, 1 << 63, 200, dtype=np.int64)
        sets = [np.sort(np.concatenate([both, own[:100]])).view(np.uint64), np.sort(np.concatenate([both, own[100:]])).view(np.uint64)]
        keys, sketch = tm.signatures(np.concatenate(sets), np.array([0, 900, 1800]))
        same = keys[0] == keys[1]
        met += same[: tm.SIDE].any() and same[tm.SIDE :].any()
        assert abs((sketch[0] == sketch[1]).mean() - 0.8) < 0.2
        assert tm._partners(80, True).__name__ == "compare"
    assert met == 60


def test_sets_of_short_and_empty_texts():
    value, offsets = tm.shingle_sets(pa.array(["", "a b", "a b c d", "a b c d", "a a a a a a"]), 4)
    assert np.diff(offsets).tolist() == [0, 1, 1, 1, 1] and value[1] == value[2] != value[0]


def test_empty_table(spark):
    assert tm.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
