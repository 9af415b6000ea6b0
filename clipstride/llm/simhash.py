"""SimHash fingerprints and their links by an anchor-point covering.

A fingerprint has 64 bits in three blocks of 22, 21 and 21. Two fingerprints with at most four differing bits differ in
at most one bit of some block. The anchors of a block are the words of a covering code of radius 1: a perfect Hamming
(15, 11) code on its low 15 bits beside all values of its other bits. Each fingerprint has a home anchor at distance 1
or less; it is sent to every anchor within radius plus threshold (2), 15 to 29 a block. Whatever differs from it in
one bit of the block is then sent to its home as well, so every link meets at an anchor. There only home rows are
compared with all rows.

Equal fingerprints travel as one. A group at an anchor is compared in blocks; a group of many near copies is walked
from fingerprint to fingerprint, each compared with those not reached yet, and gives a spanning forest, never all
pairs. Anchors that are home to very many fingerprints are salted: homes are dealt out, other rows go to every salt.

Null text counts as empty; a text without words has fingerprint zero and is linked like any other. Repeated rows get equal rows. A row whose
doc_id is null is linked too but never names a component, which is null if no row of it has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clipstride.llm.words import chunks, column_of
from clipstride.operators.store import written

#: (lowest bit, width) of the blocks; one more than the most differing bits a block may have is spread over them.
BLOCKS = ((42, 22), (21, 21), (0, 21))
MOST_BITS = 4
#: Low bits of a block under the Hamming code: bit i stands for syndrome i + 1.
HAMMING = 15
#: Homes at one anchor beyond which it is salted; rows a comparing task should hold; pairs compared at once.
HOMES, TASK_ROWS, PAIRS = 50_000, 3_000_000, 1 << 22


def fingerprint_bytes(text: str, words: int = 4) -> bytes:
    """Eight bytes, highest bit first: bit set in over half of the shingles' XXH64 (seed 42)."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return bytes(8)
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(islice(found, k, None) for k in range(words))))
    digests = b"".join([xxhash.xxh64_digest(s, 42) for s in shingles])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, words: int = 4, column: str = "fp") -> DataFrame:
    """``docs`` with its fingerprint as a long, in place of ``column``."""
    docs = docs.drop(column)
    schema = StructType([*docs.schema.fields, StructField(column, LongType())])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = b"".join([fingerprint_bytes(t, words) for t in column_of(batch).to_pylist()])
            value = np.frombuffer(found, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, column])

    return docs.mapInArrow(add, schema)


def _syndromes(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for i in range(HAMMING):
        out ^= np.where((values >> i) & 1, i + 1, 0)
    return out


def _flips(width: int) -> list[np.ndarray]:
    """By syndrome: what to flip to get to each anchor within distance 2 of a block, the nearest first."""
    tail = range(HAMMING, width)
    found: list[list[tuple[int, int]]] = [[] for _ in range(HAMMING + 1)]
    none, one = [0], [1 << i for i in tail]
    two = [(1 << i) | (1 << j) for i in tail for j in tail if i < j]
    heads = [(0, 0, 0)] + [(1, i + 1, 1 << i) for i in range(HAMMING)]
    heads += [(2, (i + 1) ^ (j + 1), (1 << i) | (1 << j)) for i in range(HAMMING) for j in range(i)]
    for far, syndrome, head in heads:
        found[syndrome] += [(far + more, head | rest) for more, rests in ((0, none), (1, one), (2, two)) if far + more <= 2 for rest in rests]
    return [np.array([flip for _, flip in sorted(x)], np.int64) for x in found]


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in fps, anchor, home) for every fingerprint and anchor within radius plus threshold, block by block."""
    places, anchors, homes = [], [], []
    for number, (low, width) in enumerate(BLOCKS):
        value = ((fps.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome = _syndromes(value)
        for s, flips in enumerate(_flips(width)):
            at = np.flatnonzero(syndrome == s)
            anchors.append(((value[at, None] ^ flips) | (number << 22)).ravel())
            places.append(np.repeat(at, len(flips)))
            homes.append(np.tile(np.arange(len(flips)) == 0, len(at)))
    return np.concatenate(places), np.concatenate(anchors), np.concatenate(homes)


def _at_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 20_000):
            part = np.ascontiguousarray(fps[at : at + 20_000])
            place, anchor, home = anchors_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[place]), pa.array(home)], names=["anchor", "fp", "home"])


def close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64)) <= most


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones connect: each node but the smallest of a component, and that one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        for end in (label[x], label[y], x, y):
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _walk(members: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of a large group: what has been reached is not compared again."""
    left, a, b = np.unique(members), [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = close(left, np.full(1, x), most)
            if near.any():
                found = left[near]
                left = left[~near]
                frontier.extend(found)
                a.append(found)
                b.append(np.full(len(found), x))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _compare(most: int):
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of an anchor are in this partition."""
        columns: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for into, name in zip(columns, ("key", "fp", "home")):
                into.append(batch.column(name).to_numpy(zero_copy_only=False))
        if not columns[0]:
            return
        key, fp, home = map(np.concatenate, columns)
        order = np.lexsort((~home, key))
        key, fp, home = key[order], fp[order], home[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        n_homes = np.add.reduceat(home.astype(np.int64), starts)
        a, b = [], []
        large = n_homes * sizes > PAIRS // 4
        for at, size in zip(starts[large], sizes[large]):
            x, y = _walk(fp[at : at + size], most)
            a.append(x)
            b.append(y)
        starts, sizes, n_homes = starts[~large], sizes[~large], n_homes[~large]
        some = n_homes > 0
        starts, sizes, n_homes = starts[some], sizes[some], n_homes[some]
        work = np.cumsum(sizes * n_homes)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS, side="right")))
            first = np.repeat(starts[at:to], n_homes[at:to])
            nth = np.arange(len(first)) - np.repeat(np.cumsum(n_homes[at:to]) - n_homes[at:to], n_homes[at:to])
            member = np.repeat(sizes[at:to], n_homes[at:to])
            left = np.repeat(first + nth, member)
            within = np.arange(len(left)) - np.repeat(np.cumsum(member) - member, member)
            right = np.repeat(first, member) + within
            x, y = fp[left], fp[right]
            found = close(x, y, most) & (x != y)
            x, y = forest(x[found], y[found])
            a.append(x)
            b.append(y)
            at = to
        x, y = forest(np.concatenate(a), np.concatenate(b)) if a else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return compare


def links(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect whatever links of at most ``most`` bits connect."""
    if most > MOST_BITS:
        raise ValueError(f"three blocks prove links of at most {MOST_BITS + 1} bits")
    spark = distinct.sparkSession
    count = distinct.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(45 * count / TASK_ROWS))
    rows = distinct.select("fp").mapInArrow(_at_anchors, "anchor long, fp long, home boolean")
    hot = written(rows.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOMES))
    if hot.isEmpty():
        rows = rows.select(F.col("anchor").alias("key"), "fp", "home")
    else:
        salts = F.ceil(F.coalesce("n", F.lit(1)) / HOMES).cast("int")
        own = F.pmod(F.xxhash64("fp"), salts)
        rows = rows.join(hot, "anchor", "left").select("*", salts.alias("salts"), own.alias("own"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(
            (F.col("anchor") + (F.col("salt").cast("long") * (1 << 24))).alias("key"), "fp",
            (F.col("home") & (F.col("own") == F.col("salt"))).alias("home"))
    return rows.repartition(parts, "key").mapInArrow(_compare(most), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge: roots by alternating large and small stars.

    Each round is written to the shared folder, which cuts the lineage; it ends when a round changes no edge.
    """
    state = None
    edges = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = written(small.union(low.select("hi", F.col("m").alias("lo"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 31))), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31)))).first()
        if now == state:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = now


def classes(rows: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(fp, root, component_id) of rows (doc_id, fp): the smallest doc_id reachable over links."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct, most))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_copies(docs: DataFrame, words: int = 4, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    rows = written(fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fp"))
    return rows.join(classes(rows, most), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of ``docs``, the first row of each root; ``rooted``: doc_id, root, and key (hash of doc_id and text) of each row."""
    key = F.xxhash64("doc_id", "text")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    kept = first.select(F.col("first.key").alias("__kept"), F.col("first.doc_id").alias("__id"))
    found = docs.withColumn("__key", key).join(kept, (F.col("__key") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return found.dropDuplicates(["__key"]).drop("__key")


def one_of_each(docs: DataFrame, words: int = 4, most: int = MOST_BITS) -> DataFrame:
    """The row with the smallest doc_id of each component; of rows that repeat it, one. A null id is the largest."""
    key = F.xxhash64("doc_id", "text")
    rows = written(fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fp", key.alias("key")))
    return first_rows(docs, rows.join(classes(rows, most), "fp"))
