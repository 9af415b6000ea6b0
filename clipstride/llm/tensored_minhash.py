"""Documents linked by the Jaccard similarity of their shingle sets: MinHash with tensored banding, every link checked.

Two small collections hold SIDE keys each, a key made of ROWS minhashes. Table (i, j) keys a set by key i of the first and
key j of the second collection, so 2 * SIDE * ROWS minhashes serve SIDE ** 2 tables of 2 * ROWS. A pair of similarity s
shares a table unless one collection has no key in common: 2 * (1 - s ** ROWS) ** SIDE = 2e-5 at 0.8, less above.

Equal sets travel as one node. Work that grows with pairs is kept off in three steps:

* stars: where nodes share a key of one collection, each is paired with the first of them. Pairs that recur in several
  keys are checked on their full sets, and what is linked is one group from then on. This alone settles groups of many copies.
* Keys whose nodes are all of one group are dropped; only nodes left with keys of both collections enter tables, and of
  these tables only those where groups meet.
* There nodes are compared by sketches (a byte of each minhash) where they lie; each sends its likeliest partner of
  another group to the check. Crowds that share a passage but are not near copies end at the sketch. A pair at 0.8 falls
  below its margin with probability 3e-5. A table of over LARGE nodes is dealt out by longer runs of the sketch first.
* Nodes that then still have a partner which the sketch cannot rule out meet once more by their rarest shingles: of two
  sets as alike as that, the smaller one's rarest ninth and the larger one's rarest fifth have a shingle in common, and no
  pair that lacks it is looked at. That rule is exact, and texts with many changes of their own have none to share.

Sets are of 64-bit hashes of shingles, told apart by two 64-bit hashes. Letters A-Z count as lower case. Fewer words than a
shingle has are one shingle; a text without words, or null, has an empty set and is linked with nothing. Repeated rows get
equal rows. A row whose doc_id is null is linked too but names no component (null if no row of it has an id). Other columns
are not read. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipstride.llm.simhash import components
from clipstride.llm.substring_dedup import _mixed, _window_hashes, _word_hashes
from clipstride.llm.words import chunks, column_of, words_of
from clipstride.operators.store import written

SIDE, ROWS = 16, 3
SIGNATURE = 2 * SIDE * ROWS
FACTORS = np.random.default_rng(23).integers(1, 1 << 32, (2, SIGNATURE), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
#: Keys that a star's pair has in common; 32 are shared with probability 0.51 each at 0.8.
RECURRING = 4
#: Standard errors of a sketch below the least similarity that are still checked.
MARGIN = 4.0
#: Nodes of a table that are compared in place; length and number of the runs that deal out larger ones (a pair at 0.8 has none in common: 7e-6).
LARGE, RUN, RUNS = 4096, 12, 168
RUN_PLACES = np.random.default_rng(29).permuted(np.tile(np.arange(SIGNATURE), (RUNS, 1)), axis=1)[:, :RUN]
#: Nodes with a key above which its star is salted; rows that a task should hold; nodes whose texts are fetched by a broadcast of their keys.
HOT, TASK_ROWS, FETCHED = 100_000, 3_000_000, 500_000
#: Bytes of text that a task works on at once.
TEXT_BYTES = 2 << 20


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, text by text, and where each text's begin (one more than texts)."""
    words = words_of(pc.ascii_lower(texts))
    hashes, counts = _word_hashes(words.distinct)[words.codes], words.counts()
    owners, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in range(1, size + 1):
        some = np.flatnonzero(counts >= size if n == size else counts == n)
        per = counts[some] - n + 1
        owner = np.repeat(some, per)
        within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        if len(owner):
            owners.append(owner)
            values.append(_mixed(_window_hashes(hashes, n)[words.offsets[owner] + within] + np.uint64(n)))
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.argsort(owner, kind="stable")
    owner, value = owner[order], value[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)])).tolist()
    for a, b in zip(cuts, cuts[1:]):
        value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.searchsorted(owner[fresh], np.arange(len(counts) + 1))


def identities(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; zero if it is empty."""
    some = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    for row, salt in zip(out, (0x243F6A8885A308D3, 0x13198A2E03707344)):
        if len(some):
            row[some] = _mixed(np.add.reduceat(_mixed(value + np.uint64(salt)), offsets[some]) + np.uint64(salt))
    return out[0].view(np.int64), out[1].view(np.int64)


def signatures(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sets x 2 SIDE keys, sets x SIGNATURE bytes of the sketch); zeros for an empty set."""
    some = np.flatnonzero(np.diff(offsets) > 0)
    lowest = np.zeros((len(offsets) - 1, SIGNATURE), np.uint32)
    if len(some):
        short = (value >> np.uint64(32)).astype(np.uint32) ^ value.astype(np.uint32)
        for k in range(SIGNATURE):
            mixed = short * FACTORS[0, k]
            mixed ^= mixed >> np.uint32(15)
            mixed *= FACTORS[1, k]
            lowest[some, k] = np.minimum.reduceat(mixed, offsets[some])
    keys = np.broadcast_to(np.arange(2 * SIDE, dtype=np.uint64), (len(lowest), 2 * SIDE))
    for k in range(ROWS):
        keys = _mixed(keys * np.uint64(0x9FB21C651E98DF25) + lowest[:, k::ROWS])
    return keys, (_mixed(lowest.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel().view(np.int64)))


def _signed(size: int):
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=TEXT_BYTES):
            value, offsets = shingle_sets(column_of(batch), size)
            one, two = identities(value, offsets)
            keys, sketch = signatures(value, offsets)
            blocks = pa.array([row.tobytes() for row in sketch], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(one), pa.array(two), pa.array(np.diff(offsets), pa.int64()), _lists(keys), blocks],
                names=["doc_id", "key", "one", "two", "size", "keys", "sketch"])

    return sign


def _sets(size: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sets of the wanted texts; a text that only shares the key of a wanted one is left out."""
        for batch in chunks(batches, most=TEXT_BYTES):
            value, offsets = shingle_sets(column_of(batch), size)
            one, two = identities(value, offsets)
            good = np.flatnonzero((one == batch.column("one").to_numpy()) & (two == batch.column("two").to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(good)), pa.array([value[offsets[i] : offsets[i + 1]].tobytes() for i in good], pa.binary())],
                names=["node", "members"])

    return pack


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, shingle) of sets."""
    for batch in batches:
        for node, block in zip(batch.column("node").to_pylist(), batch.column("members")):
            members = np.frombuffer(block.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), node)), pa.array(members)], names=["node", "shingle"])


def _alike(least: int):
    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                mask.append(100 * both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return check


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, size, first, first_size) of the nodes after a key's first; rows come sorted by key."""
    last = None  # key, node and size of the first row of the key that the batch before ended with
    for batch in batches:
        key, node, size = (batch.column(c).to_numpy() for c in ("key", "node", "size"))
        if not len(key):
            continue
        if last is not None:
            key, node, size = (np.concatenate(([x], y)) for x, y in zip(last, (key, node, size)))
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        first = np.repeat(starts, np.diff(np.append(starts, len(key))))
        last = key[starts[-1]], node[starts[-1]], size[starts[-1]]
        some = np.flatnonzero(first != np.arange(len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[some], node[some], size[some], node[first[some]], size[first[some]])],
                                         names=["key", "node", "size", "first", "first_size"])


def _partners(least: int, every: bool):
    """Pairs of different groups that a sketch does not rule out: of each node the likeliest, or all.

    Rows may say (``lead``) whether they meet larger sets too, or only smaller ones.
    """
    floor = math.ceil(SIGNATURE * (least / 100 - MARGIN * math.sqrt(least / 100 * (1 - least / 100) / SIGNATURE)))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a key are in this partition."""
        columns: list[list] = [[], [], [], [], [], []]
        for batch in batches:
            for into, name in zip(columns, ("key", "node", "root", "size", "lead")):
                into.append(batch.column(name).to_numpy(zero_copy_only=False))
            columns[5].append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SIGNATURE))
        if not columns[0]:
            return
        key, node, root, size, lead, sketch = map(np.concatenate, columns)
        order = np.lexsort((node, key))
        key, node, root, size, lead, sketch = (x[order] for x in (key, node, root, size, lead, sketch))
        best, partner = np.full(len(key), floor - 1), np.full(len(key), -1)
        at, far = np.arange(len(key) - 1), 1
        while len(at):
            at = at[at + far < len(key)]
            at = at[key[at] == key[at + far]]
            to = at + far
            can = (root[at] != root[to]) & (100 * np.minimum(size[at], size[to]) >= least * np.maximum(size[at], size[to]))
            can &= (lead[at] | (size[at] > size[to])) & (lead[to] | (size[to] > size[at]))
            left, right = at[can], to[can]
            same = np.concatenate([np.zeros(0, np.int64)] + [
                (sketch[left[i : i + 50_000]] == sketch[right[i : i + 50_000]]).sum(axis=1) for i in range(0, len(left), 50_000)])
            if every:
                some = np.flatnonzero(same >= floor)
                if len(some):
                    yield _pairs(node[left[some]], node[right[some]])
            else:
                for x, y in ((left, right), (right, left)):
                    more = same > best[x]
                    best[x[more]], partner[x[more]] = same[more], y[more]
            far += 1
        some = np.flatnonzero(partner >= 0)
        yield _pairs(node[some], node[partner[some]])

    return compare


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large tables under the keys of their sketch's runs."""
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, SIGNATURE).astype(np.uint64)
            key = part.column("key").to_numpy().view(np.uint64)[:, None] + np.arange(1, RUNS + 1, dtype=np.uint64)
            for k in range(RUN):
                key = _mixed(key * np.uint64(0x9FB21C651E98DF25) + sketch[:, RUN_PLACES[:, k]])
            of = pa.array(np.repeat(np.arange(len(part)), RUNS))
            rest = [part.column(c).take(of) for c in ("node", "root", "size")]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *rest], names=["key", "node", "root", "size"])


class Links:
    """What links nodes, gathered turn by turn."""

    def __init__(self, docs: DataFrame, size: int, least: int):
        self.spark, self.size, self.least = docs.sparkSession, size, least
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
        schema = f"doc_id {kind}, key long, one long, two long, size long, keys array<long>, sketch binary"
        signed = written(self.texts.mapInArrow(_signed(size), schema))
        self.rows = signed.select("doc_id", "key", "one", "two", "size")
        distinct = signed.groupBy("one", "two").agg(
            F.min("doc_id").alias("least_id"), F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("size", "keys", "sketch")])
        self.nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()))
        self.count = self.nodes.count()
        self.found = written(self.spark.createDataFrame([], "a long, b long"))
        self.roots = None

    def parts(self, rows: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, members) of some nodes, from their texts."""
        wanted = written(nodes.join(self.nodes.select("node", "key", "one", "two"), "node"))
        few = wanted.count() <= FETCHED  # 32 bytes each
        texts = self.texts.select("key", "text").join(F.broadcast(wanted) if few else wanted, "key")
        return texts.dropDuplicates(["node"]).mapInArrow(_sets(self.size), "node long, members binary")

    def check(self, pairs: DataFrame) -> int:
        """Add the pairs (a, b) that are alike on their full sets; how many were given."""
        pairs = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        given = pairs.count()
        if given:
            sets = written(self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
            both = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("right")), "b").join(
                sets.select(F.col("node").alias("a"), F.col("members").alias("left")), "a")
            alike = both.select("a", "b", "left", "right").mapInArrow(_alike(self.least), "a long, b long")
            self.found = written(self.found.union(alike))
            self.roots = components(self.found)
        return given

    def rooted(self, rows: DataFrame) -> DataFrame:
        """``rows`` (node, ...) with the group of each node."""
        if self.roots is None:
            return rows.withColumn("root", F.col("node"))
        known = self.roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        return rows.join(known, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("_r", "node")).drop("_n", "_r")

    def similar_sizes(self, a: str, b: str):
        return 100 * F.least(a, b) >= self.least * F.greatest(a, b)

    def meeting(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, root, ...) under keys of several groups, with their number ``n``."""
        keys = rows.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("n")).where("_lo <> _hi")
        return rows.join(keys.select("key", "n"), "key")

    def stars(self, keyed: DataFrame) -> None:
        """Check each node with the first one under its keys, where several keys name the same."""
        parts = self.parts(2 * SIDE * self.count)

        def pairs(rows: DataFrame) -> DataFrame:
            stars = rows.repartition(parts, "key").sortWithinPartitions("key", F.xxhash64("node")).mapInArrow(
                _stars, "key long, node long, size long, first long, first_size long")
            return stars.where(self.similar_sizes("size", "first_size")).select(F.col("first").alias("a"), F.col("node").alias("b"))

        found = pairs(keyed.select("key", "node", "size"))
        if not keyed.where(F.col("n") > HOT).isEmpty():  # salted keys first, then those that are first under one
            salted = keyed.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / HOT)))
            heads = salted.groupBy("key", "salt").agg(F.min(F.struct(F.xxhash64("node"), "node", "size")).alias("head")).select("key", "head.node", "head.size")
            found = pairs(salted.withColumn("key", F.xxhash64("key", "salt")).select("key", "node", "size")).union(pairs(heads))
        self.check(found.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= RECURRING).select("a", "b"))

    def tables(self, keyed: DataFrame) -> DataFrame:
        """Rows (key, node, root, size, n) of the tables where groups meet."""
        left = self.meeting(self.rooted(keyed.select("key", "node", "size", "side"))).select("node", "root", "size", "key", "side")
        sides = left.groupBy("node", "root", "size").agg(
            *[F.collect_set(F.when(F.col("side") == s, F.col("key"))).alias(f"keys_{s}") for s in (0, 1)])
        table = sides.select("node", "root", "size", F.explode("keys_0").alias("one"), "keys_1").select(
            "node", "root", "size", "one", F.explode("keys_1").alias("two"))
        return written(self.meeting(written(table.select(F.xxhash64("one", "two").alias("key"), "node", "root", "size"))))

    def partners(self, tables: DataFrame) -> DataFrame:
        """The likeliest pairs of different groups in tables (key, node, root, size, n) that the sketch does not rule out."""
        sketches = self.nodes.select("node", "sketch")
        rows = tables.where(F.col("n") <= LARGE).select("key", "node", "root", "size").join(sketches, "node")
        count, most = tables.agg(F.count("*"), F.max("n")).first()
        if (most or 0) > LARGE:
            large = tables.where(F.col("n") > LARGE).select("key", "node", "root", "size").join(sketches, "node")
            dealt = large.mapInArrow(_runs, "key long, node long, root long, size long")
            rows = rows.unionByName(self.meeting(written(dealt)).drop("n").join(sketches, "node"))
        return self.compared(rows.withColumn("lead", F.lit(True)), 16 * count, every=False)

    def compared(self, rows: DataFrame, weight: int, *, every: bool) -> DataFrame:
        rows = rows.select("key", "node", "root", "size", "lead", "sketch")
        return written(rows.repartition(self.parts(weight), "key").mapInArrow(_partners(self.least, every), "a long, b long").distinct())

    def rarest(self, pairs: DataFrame) -> DataFrame:
        """All pairs (a, b) of different groups, among the nodes in ``pairs``, whose rarest shingles meet."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = written(self.sets(nodes))
        listed = written(sets.mapInArrow(_listed, "node long, shingle long"))
        shared = listed.join(listed.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "shingle")
        own = Window.partitionBy("node")  # the shingles of one text
        placed = shared.join(self.nodes.select("node", "size"), "node").withColumn("nth", F.row_number().over(own.orderBy("df", "shingle"))).withColumn(
            "place", F.col("size") - F.count("*").over(own) + F.col("nth"))  # shingles that nobody shares come first
        fifth = F.col("size") - F.ceil(self.least * F.col("size") / 100) + 1
        ninth = F.col("size") - F.ceil(2 * self.least * F.col("size") / (100 + self.least)) + 1
        rows = placed.where(F.col("place") <= fifth).select(F.col("shingle").alias("key"), "node", "size", (F.col("place") <= ninth).alias("lead"))
        rows = written(self.meeting(self.rooted(rows)).drop("n"))
        return self.compared(rows.join(self.nodes.select("node", "sketch"), "node"), 16 * rows.count(), every=True)

    def gather(self) -> None:
        """All links, by stars and tables."""
        filled = self.nodes.where("size > 0")
        keyed = filled.select("node", "size", F.posexplode("keys").alias("side", "key")).withColumn("side", (F.col("side") >= SIDE).cast("int"))
        keyed = written(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
        self.stars(keyed)
        tables = self.tables(keyed)
        if self.check(self.partners(tables)):
            pairs = self.partners(written(self.meeting(self.rooted(tables.drop("root", "n"))).select("key", "node", "root", "size", "n")))
            if not pairs.isEmpty():
                self.check(self.rarest(pairs))

    def classes(self) -> DataFrame:
        """(one, two, root, component_id) of the distinct sets; each empty set's row stands for itself."""
        rooted = self.rooted(self.nodes.select("node", "one", "two", "least_id"))
        return rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("one", "two", "root", "component_id")


def near_copies(docs: DataFrame, words: int = 4, least: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (first of its component) of every document; ``least`` is in per cent."""
    links = Links(docs, words, least)
    links.gather()
    rows = links.rows.join(links.classes(), ["one", "two"])
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
