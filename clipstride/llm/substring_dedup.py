"""Remove passages that occur more than once, by super-k-mer partitioning.

A window is a run of consecutive words of one document. Its minimiser is the smallest hash among its runs of four
words, those that are frequent in the corpus left out, or of sixteen words where all of them are frequent, so equal
windows have equal minimisers and a common line does not draw the differing text around it into one bucket. Consecutive windows with the same minimiser (a super-k-mer) travel
together, as one packed string, to the bucket of that minimiser. Equal strings of one chunk of texts travel as one
string with its list of places; a chunk sends each bucket one compressed block. In a bucket equal strings are one
again; the windows of the distinct strings are sorted by hash, and windows of equal hash are compared word by word
with the first of them, so the count is exact whatever the hashes do. What goes back to a document are the ranges of
words that repeated windows cover.

Hot groups: thousands of copies, or one passage in many documents, are one string a bucket and four numbers a place.

Null text counts as empty. Texts shorter than a window lose nothing. Repeated rows repeat each other's windows, so
they lose the same words. Extra columns are carried along where rows are, and are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.llm.words import chunks, column_of, in_sample, words_of

WINDOW = 35
#: Words in the runs that minimisers are chosen from.
RUN = 4
#: Text bytes of a chunk that sends one block to each bucket; text bytes that one bucket's task should hold.
CHUNK, BUCKET = 8 << 20, 8 << 20
#: Words in the runs that stand in where all runs of a window are frequent; text bytes in which frequent runs are looked for.
#: Which runs count as frequent only says where windows meet, not which are counted.
LONG_RUN, LOOK = 16, 32 << 20
#: Text that travels per byte of input: a super-k-mer repeats a window less one word.
SPREAD = 3
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _word_hashes(distinct: pa.Array) -> np.ndarray:
    words = distinct.cast(pa.large_binary()).to_pylist()
    return np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in words]), ">u8").astype(np.uint64)


def _powers(count: int) -> np.ndarray:
    """ODD ** (0 ... count - 1), wrapping."""
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(count - 1, 0), ODD)]))[:count]


INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def _window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` words from each place on, by prefix sums that wrap."""
    count = len(hashes) - window + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(len(hashes)), dtype=np.uint64)])
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(count - 1, INVERSE)]))
    return (sums[window:] - sums[:-window]) * back


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


NONE, LAST = np.zeros(0, np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF)


def super_kmers(counts: np.ndarray, hashes: np.ndarray, window: int, frequent: np.ndarray = NONE) -> tuple[np.ndarray, ...]:
    """(text, first window's start in the text, number of windows, minimiser) of the runs of windows in a chunk.

    ``counts``: words of each text; ``hashes``: of all words, text by text; ``frequent``: sorted hashes of frequent runs.
    """
    starts = np.cumsum(counts) - counts
    some = np.flatnonzero(counts >= window)
    per = counts[some] - window + 1
    if not len(some):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    run = min(RUN, window)
    runs = _mixed(_window_hashes(hashes, run))
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)] == runs
        least = _smallest(np.where(often, LAST, runs), window - run + 1)
        longer = min(LONG_RUN, window)
        least = np.where(least == LAST, _smallest(_mixed(_window_hashes(hashes, longer)), window - longer + 1), least)
    else:
        least = _smallest(runs, window - run + 1)
    text = np.repeat(some, per)
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    least = least[starts[text] + within]
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
    return text[new], within[new], np.diff(np.append(new, len(text))), least[new]


def _pack(owners: np.ndarray, owner: np.ndarray, start: np.ndarray, string: np.ndarray, strings: list[bytes]) -> bytes:
    """Keys of texts; for each place its text, first window and string; the strings. Words hold no line ends."""
    head = np.array([len(owners), len(owner)], "<i8").tobytes() + owners.astype("<i8").tobytes()
    places = b"".join(x.astype("<i4").tobytes() for x in (owner, start, string))
    return zstandard.compress(head + places + b"\n".join(strings), 3)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(key, first window, string) of each place, and the strings."""
    data = zstandard.decompress(block)
    n_owners, n = (int(x) for x in np.frombuffer(data, "<i8", 2))
    at = 16 + 8 * n_owners
    owner, start, string = np.frombuffer(data, "<i4", 3 * n, at).reshape(3, n)
    return np.frombuffer(data, "<i8", n_owners, 16)[owner], start, string, data[at + 12 * n :].split(b"\n")


def _runs(window: int):
    run = min(RUN, window)

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of each chunk, and in how many places."""
        for batch in chunks(batches, most=CHUNK):
            words = words_of(column_of(batch))
            ends = np.repeat(words.offsets[1:], words.counts())
            found = _mixed(_window_hashes(_word_hashes(words.distinct)[words.codes], run))
            found, times = np.unique(found[np.arange(len(found)) + run <= ends[: len(found)]], return_counts=True)
            for at in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[at : at + 100_000].view(np.int64)), pa.array(times[at : at + 100_000])], names=["run", "n"])

    return runs


def frequent_runs(rows: DataFrame, size: int, window: int) -> np.ndarray:
    """Sorted hashes of runs whose super-k-mers may hold over half a bucket; ``rows``: key, text; ``size``: bytes of text."""
    share = min(1.0, LOOK / max(size, 1))
    # a super-k-mer has at most two windows less a run, of some six bytes a word
    most = max(2, share * BUCKET / 2 / (2 * window * 6))
    if size * SPREAD <= BUCKET:
        return NONE
    some = rows if share == 1.0 else rows.where(in_sample(F.col("key"), share))
    found = some.mapInArrow(_runs(window), "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return np.sort(np.array([r["run"] for r in found.select("run").collect()], np.int64).view(np.uint64))  # at most words / most


def _send(window: int, buckets: int, frequent: np.ndarray = NONE):
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns key (long) and text; one row (bucket, block) for each bucket that a chunk has windows for."""
        for batch in chunks(batches, most=CHUNK):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            words = words_of(column_of(batch))
            text, start, number, least = super_kmers(words.counts(), _word_hashes(words.distinct)[words.codes], window, frequent)
            if not len(text):
                continue
            spelled = words.distinct.cast(pa.large_binary()).take(pa.array(words.codes))
            lengths = pc.binary_length(spelled).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths + 1)
            packed = b" ".join(spelled.to_pylist())
            first = words.offsets[text] + start
            begins, stops = (ends[first] - lengths[first] - 1).tolist(), (ends[first + number + window - 2] - 1).tolist()
            bucket = (_mixed(least) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            out_bucket, out_block = [], []
            for part in np.split(order, cuts):
                seen: dict[bytes, int] = {}
                string = np.array([seen.setdefault(packed[begins[i] : stops[i]], len(seen)) for i in part], np.int32)
                owners, owner = np.unique(text[part], return_inverse=True)
                out_bucket.append(int(bucket[part[0]]))
                out_block.append(_pack(keys[owners], owner, start[part], string, list(seen)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_bucket, pa.int32()), pa.array(out_block, pa.large_binary()).cast(pa.binary())], names=["bucket", "block"])

    return send


def repeated(codes: np.ndarray, hashes: np.ndarray, string: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """Which windows (by start) occur twice or more; ``string``: of each word, ``weight``: places of each string."""
    count = len(codes) - window + 1
    out = np.zeros(max(count, 0), bool)
    if count <= 0:
        return out
    at = np.flatnonzero(string[:count] == string[window - 1 :])  # inside one string
    keys = _window_hashes(hashes, window)[at]
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    several = size[group] > 1
    out[at[~several & (weight[string[at]] > 1)]] = True
    at, group, new = at[several], group[several], new[several]
    first = at[np.flatnonzero(new)][np.cumsum(new) - 1] if len(at) else at
    same = np.ones(len(at), bool)
    for k in range(window):
        same &= codes[at + k] == codes[first + k]
    if same.all():
        out[at] = True
        return out
    clash = np.isin(group, np.unique(group[~same]))  # hashes agree, words do not: count these by their words
    out[at[~clash]] = True
    places: dict[bytes, list[int]] = {}
    for place in at[clash]:
        places.setdefault(codes[place : place + window].tobytes(), []).append(place)
    for found in places.values():
        if len(found) > 1 or weight[string[found[0]]] > 1:
            out[found] = True
    return out


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merged(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges in order, those of a key that are equal, overlap or touch as one: repeated rows send the same ones."""
    order = np.lexsort((low, key))
    key, low, high = key[order], low[order], high[order]
    if not len(key):
        return key, low, high
    first = np.concatenate(([True], key[1:] != key[:-1]))
    base = np.cumsum(first).astype(np.int64) << 32  # a key's ranges lie above those of the key before
    reach = np.maximum.accumulate(base + high)
    new = first | np.concatenate(([True], (base + low)[1:] > reach[:-1]))
    begin = np.flatnonzero(new)
    return key[begin], low[begin], (reach - base)[np.append(begin[1:], len(key)) - 1].astype(high.dtype)


def _count(window: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All blocks of a bucket are in this partition; one row (key, ranges) for each text that loses words."""
        seen: dict[bytes, int] = {}
        keys, starts, strings = [], [], []
        for batch in batches:
            for block in batch.column("block"):
                key, start, string, texts = _unpack(block.as_buffer().to_pybytes())
                number = np.array([seen.setdefault(t, len(seen)) for t in texts], np.int32)
                keys.append(key)
                starts.append(start.copy())
                strings.append(number[string])
        if not seen:
            return
        keys, starts, strings = map(np.concatenate, (keys, starts, strings))
        weight = np.bincount(strings)
        words = words_of(pa.array(list(seen), pa.large_binary()).cast(pa.large_string()))
        seen.clear()
        string = np.repeat(np.arange(len(weight), dtype=np.int32), words.counts())
        flags = repeated(words.codes, _word_hashes(words.distinct)[words.codes], string, weight, window)
        begin, end = _ranges(flags)
        # a range of starts stays inside one string: the last windows of a string start before its last words
        of = string[begin]
        begin, end = begin - words.offsets[of], end - words.offsets[of] + window - 1
        per = np.bincount(of, minlength=len(weight))
        ahead = np.cumsum(per) - per
        hit = np.flatnonzero(per[strings] > 0)
        times = per[strings[hit]]
        if not len(hit):
            return
        source = np.repeat(hit, times)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(ahead[strings[hit]], times)
        key, low, high = keys[source], starts[source] + begin[nth], starts[source] + end[nth]
        key, low, high = merged(key, low, high)
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        both = np.stack([low, high], axis=1).astype("<i4")
        for at in range(0, len(cuts), 10_000):
            some = cuts[at : at + 10_000]
            stop = np.append(cuts[at + 1 : at + 10_001], len(key))[: len(some)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[some]), pa.array([both[a:b].tobytes() for a, b in zip(some, stop)], pa.binary())], names=["key", "ranges"])

    return count


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``__ranges``: packed (first, past last) word ranges that repeated windows cover, or null."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    floor = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(floor, math.ceil(SPREAD * size / BUCKET))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    blocks = rows.mapInArrow(_send(window, buckets, frequent_runs(rows, size, window)), "bucket int, block binary")
    found = blocks.repartition(buckets, "bucket").mapInArrow(_count(window), "key long, ranges binary")
    found = found.groupBy("key").agg(F.collect_list("ranges").alias("__ranges"))
    docs = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    return docs.join(found.withColumnRenamed("key", "__found"), F.col("__key") == F.col("__found"), "left").drop("__key", "__found")


def _mask(count: int, ranges: list[bytes] | None) -> np.ndarray:
    """Which words stay."""
    edge = np.zeros(count + 1, np.int64)
    for block in ranges or ():
        pairs = np.frombuffer(block, "<i4").reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sizes, removed, hashes = [], [], []
            for text, ranges in zip(column_of(batch).to_pylist(), batch.column("__ranges").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                kept = words
                if ranges:
                    kept = [w for w, stays in zip(words, _mask(len(words), ranges).tolist()) if stays]
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
                hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return covered(docs.select("doc_id", "text"), window).mapInArrow(
        digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_words(text: str, ranges: list[bytes] | None) -> str:
    """The text without the covered words and the white space after each; unchanged if none is covered."""
    if not ranges:
        return text
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    keep = _mask(len(words), ranges).tolist()
    out, at = [], 0
    for word, stays in zip(words, keep):
        start = data.index(word, at)
        if stays or not out:  # white space before the first word stays
            out.append(data[at:start])
        if stays:
            out.append(word)
        at = start + len(word)
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def rewritten(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that repeated windows cover, in ``text``; other columns as they are."""
    names = docs.columns
    at = names.index("text")

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [t and without_words(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column("__ranges").to_pylist())]
            columns = [batch.column(n) for n in names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return covered(docs, window).mapInArrow(rewrite, docs.schema)
