"""The operators against brute force, libraries and each other, on small tables with every odd row there is."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipstride.llm import (
    bpe,
    catalog,
    context_mixing,
    html_text,
    language_id,
    packing,
    quality_ranking,
    quality_rules,
    simhash,
    substring_dedup,
    topk_search,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, fp string, key string, bucket int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1, count=60):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefgéßñ") for _ in range(draw.randint(1, 7))) for _ in range(150)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    out = [None, "", "   \n\t", "one", "a b c", "Straße x  　y <|endoftext|> z", "x" * 5000, "no " * 4000, "a b c d e " * 30, passage, passage]
    for i in range(count):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(1, 120))]
        out.append(draw.choice([" ", "\n", ". "]).join(words) + (" " + passage if i % 7 == 0 else "") + (" ***" * 40 if i % 5 == 0 else ""))
    out += out[20:23]
    near = out[30].split(" ")
    return [*out, " ".join([*near, "tail"])]


@pytest.fixture(scope="module")
def docs(spark):
    found = texts()
    rows = [(i, t, ["en", "de", None][i % 3], "s", None, "x", "y", "z", "k", 1) for i, t in enumerate(found)]
    rows += [rows[12], (None, "no id here", "en", "s", 3, "", "", "", "", 0), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int("***" not in (t or "")), 0) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_words_are_split_on_ascii_space_only():
    import pyarrow as pa
    from clipstride.llm.words import chunks, words_of

    found = texts()
    words = words_of(pa.array([t or "" for t in found]))
    spelled = words.distinct.to_pylist()
    for i, t in enumerate(found):
        assert [spelled[c] for c in words.codes[words.offsets[i] : words.offsets[i + 1]]] == WORDS.findall(t or "")
    batch = pa.record_batch({"text": pa.array(found)})
    cut = list(chunks([batch], most=500))
    assert len(cut) > 5 and [t for b in cut for t in b.column("text").to_pylist()] == found


def test_quality_rules(spark, docs, plain):
    want = Counter()
    for i, t in plain:
        words = WORDS.findall(t)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + o for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for o in range(5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), base] += 1
    found = quality_rules.judged(docs)
    assert by_row(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert quality_rules.judged(empty(spark)).count() == 0
    kept = quality_rules.kept(docs)
    assert kept.columns == docs.columns and kept.count() == found.where("kept").count()


def test_ablations_follow_the_ledger(docs):
    rows = quality_rules.ledger(docs)
    bits = [r["fail_bits"] for r in rows.select("fail_bits").collect()]
    for r in quality_rules.ablations(rows).collect():
        policy, rule = quality_rules.mask(quality_rules.POLICIES[r["policy"]]), quality_rules.mask((r["rule"],))
        assert r["n_kept"] == sum(not b & policy for b in bits)
        assert r["n_kept_without"] == sum(not b & policy & ~rule for b in bits)
        assert r["n_only_this"] == sum(b & policy == rule for b in bits)


def brute_repeats(found, window):
    starts = Counter(tuple(w[k : k + window]) for w in found for k in range(len(w) - window + 1))
    out = []
    for w in found:
        gone = {k + o for k in range(len(w) - window + 1) if starts[tuple(w[k : k + window])] > 1 for o in range(window)}
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


@pytest.mark.parametrize("window", [4, 35])
def test_substring_dedup(spark, docs, plain, window):
    words = [WORDS.findall(t) for _, t in plain]
    want = Counter(
        (i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())
        for (i, _), w, k in zip(plain, words, brute_repeats(words, window)))
    assert by_row(substring_dedup.digests(docs, window), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    rest = substring_dedup.rewritten(docs, window)
    assert rest.columns == docs.columns
    assert Counter(tuple(WORDS.findall(r["text"] or "")) for r in rest.collect()) == Counter(map(tuple, brute_repeats(words, window)))
    assert substring_dedup.digests(empty(spark)).count() == 0


def test_equal_hashes_of_different_windows_are_told_apart():
    codes = np.array([1, 2, 3, 4, 1, 2], np.int32)
    found = substring_dedup.repeated(codes, np.zeros(6, np.uint64), np.array([0, 0, 1, 1, 2, 2]), np.array([1, 1, 1]), 2)
    assert found.tolist() == [True, False, False, False, True]


def brute_components(rows):
    fp = {f for _, f in rows}
    parent = {f: f for f in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fp:
        for b in fp:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in rows)


def test_fingerprints_and_components(spark, docs, plain):
    rows = []
    for i, t in plain:
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        rows.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    found = simhash.near_copies(docs)
    assert by_row(found, "doc_id", "fingerprint", "component_id") == brute_components(rows)
    assert simhash.near_copies(empty(spark)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for _, _, c in brute_components(rows)})


@pytest.mark.parametrize("hot", [False, True])
def test_links_of_planted_fingerprints(spark, monkeypatch, hot):
    if hot:  # salted anchors and walked groups
        monkeypatch.setattr(simhash, "HOMES", 3)
        monkeypatch.setattr(simhash, "PAIRS", 64)
    draw = random.Random(3)
    fps = []
    for _ in range(60):
        x = draw.getrandbits(64)
        for _ in range(6):
            fps.append(x)
            for b in draw.sample(range(64), draw.choice([1, 4, 5])):
                x ^= 1 << b
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    found = {r["fp"]: r["component_id"] for r in simhash.classes(rows).collect()}
    want = {int(f, 16): c for _, f, c in brute_components(list(enumerate(fps)))}
    assert {f & (1 << 64) - 1: c for f, c in found.items()} == want


def test_every_point_is_near_an_anchor():
    value = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 2000)
    place, anchor, home = simhash.anchors_of(value)
    assert home.sum() == len(simhash.BLOCKS) * len(value)
    for number, (low, width) in enumerate(simhash.BLOCKS):
        own = (anchor >> 22) == number
        block = (value.view(np.uint64) >> np.uint64(low)).astype(np.int64)[place[own]] & ((1 << width) - 1)
        far = np.bitwise_count(block ^ (anchor[own] & ((1 << 22) - 1)))
        assert far.max() == 2 and far[home[own]].max() == 1


def test_packing(spark, docs, plain):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 1])) for i, t in plain)
    rows = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), size=64).collect()
    sequences, texts_of = {}, []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
        if r["start"] == 0:
            texts_of.append((r["doc_id"], [], r["doc_tokens"]))
        assert texts_of[-1][0] == r["doc_id"] and r["start"] == len(texts_of[-1][1])  # order is kept
        texts_of[-1][1].extend(r["ids"])
    assert max(sequences.values()) <= 64
    assert all(len(ids) == n for _, ids, n in texts_of)
    assert Counter((i, tuple(ids)) for i, ids, _ in texts_of) == want
    assert packing.packed(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_cuts_are_cheapest():
    draw = np.random.default_rng(2)
    for _ in range(20):
        places = np.concatenate(([0], np.cumsum(draw.integers(1, 9, 25))))
        price = draw.choice([0, 4, 24], len(places))
        best = [0] + [10**9] * (len(places) - 1)
        for i in range(1, len(places)):
            for j in range(i):
                if (length := places[i] - places[j]) <= 20:
                    best[i] = min(best[i], best[j] + 20 - length + price[i])
        found = packing.cuts(places, price, 20)
        at = np.searchsorted(places, found)
        assert sum(20 - (b - a) for a, b in zip(found, found[1:])) + price[at[1:]].sum() == best[-1]


def test_bpe_is_the_librarys(spark, docs, plain):
    file = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    want = Counter()
    for i, t in plain:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert by_row(bpe.digests(docs, file), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert by_row(bpe.decoded(bpe.encoded(docs, file), file), "doc_id", "text") == Counter(plain)
    assert bpe.digests(empty(spark), file).count() == 0


def test_bpe_on_random_strings():
    file = public_tokenizers.path("byte_bpe_50k.json")
    own, tokenizer = bpe.ByteBPE(file), Tokenizer.from_file(file)
    draw = random.Random(5)
    letters = "aAbeéñzß  \n\t\r\x0b\x1c'''sstreve019²٣.,!?--\x85\xa0 　日本ा́😀<|>"
    for _ in range(3000):
        s = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        assert own.encode(s) == tokenizer.encode(s, add_special_tokens=False).ids
    with open(file) as f:
        assert own.decode(range(len(json.load(f)["model"]["vocab"])))


def test_language_model(spark, docs, plain):
    tokens = [(i, [*WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), ""]) for i, t in plain]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    found = context_mixing.scored(docs).withColumn("base", F.round("base_score", 6))
    assert by_row(found, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base") == want
    rows = found.where("n_tokens > 20").collect()
    assert all(r["score"] < 0 for r in rows)
    uniform = -np.log10(2) * 8  # of a byte
    assert sum(r["score"] for r in rows) > 0.5 * sum(uniform * 4 * r["n_tokens"] for r in rows)
    assert context_mixing.scored(empty(spark)).count() == 0


def test_bits_of_a_token_sum_to_one():
    """The probabilities of all next bytes add up to one whatever the tables hold."""
    draw = np.random.default_rng(4)
    table = draw.integers(0, 9, (context_mixing.SLOTS, 2)).astype(np.uint16)
    model = context_mixing.Predictor(context_mixing.start(), table)
    alone = model.log10_of([b""])[0]  # the close of an empty word
    bits = context_mixing.bits_of([b""])
    assert len(bits.bit) == 8 and -8 * 6 <= alone < 0


def test_language_id(spark, docs):
    found = {r["doc_id"]: r for r in language_id.predictions(docs).collect()}
    assert found[1]["lang_pred"] == "und" and found[1]["score"] == 0
    assert {r["lang_pred"] for r in found.values()} <= {"en", "de", "und"} and all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.predictions(empty(spark)).count() == 0
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    hits = catalog.QUERIES["op4_language_id"](spark, sf).where("held_out").join(truth, "doc_id")
    assert hits.where("lang = lang_pred").count() > 0.97 * hits.count()


def test_quality_ranking(spark, docs, labels):
    found = quality_ranking.predictions(docs, labels)
    assert found.count() == docs.count()
    assert found.where("score < 0 or score > 1 or predicted <> int(score >= 0.5)").isEmpty()
    none = quality_ranking.predictions(docs, labels.where("false"))
    assert none.where("score <> 0.5").isEmpty() and quality_ranking.predictions(empty(spark), labels).count() == 0
    sf = "/root/testdata/sf0.01"
    both = catalog.QUERIES["op9_quality_classifier"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert both.where("quality = predicted").count() > 0.95 * both.count()


def test_topk_is_exact(spark):
    draw = np.random.default_rng(6)
    rows = [(i, [float(x) for x in draw.normal(0, 0.3, 12)], 1) for i in range(300)]
    rows += [(300 + i, rows[5][1], 2) for i in range(30)]  # ties
    rows += [(400, None, 0), (401, [None] * 12, 0), (402, [float("nan")] * 12, 0), (403, [float("inf")] * 12, 0), (404, [0.5] * 3, 0), (None, rows[0][1], 0), (450, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    usable = topk_search.usable(table)
    ints = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v, _ in rows[:330]}
    found = topk_search.search(usable, usable.where("vec_id % 10 = 0")).collect()
    want = set()
    for q in [i for i in ints if i % 10 == 0]:
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert topk_search.search(usable.where("false"), usable.where("false")).count() == 0


def test_html_layout(spark):
    render = html_text.visible_text
    assert render("<p>a<p>b &amp; c<br>d") == "a\n\nb & c\nd"
    assert render("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>z") == "- x\n- y\n  1. 1\n  2. 2\n\nz"
    assert render("<table><tr><th>Name<th>Qty<tr><td>Figs<br>dry<td>12</table>") == "Name  Qty\nFigs  12\ndry"
    assert render("<head><title>t</title></head><div style='display: none'>n</div><p hidden>n</p><script>var a='</p>'</script>v<!-- c -->w") == "vw"
    assert render("<pre>a  b\n  c</pre>") == "a  b\n  c"
    assert render("") == "" and render("5 < 6 & 7") == "5 < 6 & 7" and render("<b><p>x</b>y</p>") == "xy"
    assert render("<div>" * 20_000 + "deep") == "deep"
    assert len(render("<p>word </p>" * 20_000).split()) == 20_000
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, "u", "<p>é", "t"), (2, "u", "<p>é", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extracted(pages).collect())) == [(1, None, None), (2, "é", 1), (2, "é", 1)]
