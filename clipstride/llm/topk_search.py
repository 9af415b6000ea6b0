"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are integers floor(256 x). The rows are cut into blocks. In a block the postings of a dimension are the rows in order of their
coarse component (LEVEL low bits dropped); rows of one coarse value are a segment. To a query each segment adds one
impact: the most that its rows can gain there over the dimension's least segment. Segments of all dimensions are
processed by falling impact into accumulators, which stay upper bounds once what is left is added. Processing stops
only on proof: with ``left`` the sum of each dimension's next impact and ``slack`` the most that coarsening adds, no row below (k-th
accumulator) - slack - left can be among the k best. The others are possible members and are scored exactly. However far
processing got, the result is the same.

Blocks of queries meet blocks of rows group by group; the k best of each pair of blocks are ranked again per query.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without vec_id. Only vectors
of a query's length are its candidates; all rows with the query's vec_id are its own. Repeated rows are candidates each. Ties go to the
smaller vec_id. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, LEVEL = 256, 4
ROWS, QUERIES = 16_384, 512
#: Segments are processed in so many parts, and the proof is tried after each.
PARTS = 8
BLOCK = "size int, kind int, ids binary, data binary"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and integer components of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _blocks(kind: int, most: int):
    """Rows of a partition as blocks of at most ``most`` vectors of one length."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(size: int) -> pa.RecordBatch:
            parts = held.pop(size)
            ids, data = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays([
                pa.array([size], pa.int32()), pa.array([kind], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                pa.array([data.astype("<i8").tobytes()], pa.binary())], names=["size", "kind", "ids", "data"])

        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                lists = part.column("v")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == size)
                    some = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), size)
                    if sum(len(i) for i, _ in held.get(size, ())) + len(own) > most:
                        yield block(size)
                    held.setdefault(size, []).append((part.column("vec_id").to_numpy(zero_copy_only=False)[own], some))
        for size in list(held):
            yield block(size)

    return blocks


class ImpactIndex:
    """Postings of a block: for each dimension its segments, by coarse component."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id
        self.ids, self.data = ids[order], data[order]
        coarse = self.data >> LEVEL
        self.places, dims, values, starts, ends = [], [], [], [], []
        at = 0
        for d in range(data.shape[1]):
            by = np.argsort(coarse[:, d], kind="stable")
            level = coarse[by, d]
            first = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1])))
            self.places.append(by)
            dims.append(np.full(len(first), d))
            values.append(level[first])
            starts.append(first + at)
            ends.append(np.append(first[1:], len(by)) + at)
            at += len(by)
        none = np.zeros(0, np.int64)
        self.places = np.concatenate([none, *self.places])
        self.dims, self.values, self.starts, self.ends = (np.concatenate([none, *x]) for x in (dims, values, starts, ends))

    def impacts(self, q: np.ndarray) -> np.ndarray:
        """The most that a row of each segment can gain, over the least of the dimension's segments."""
        w = q[self.dims]
        most = w * (self.values << LEVEL) + np.maximum(w, 0) * ((1 << LEVEL) - 1)
        least = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(least, self.dims, most)
        return most - least[self.dims]

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, best first."""
        other = self.ids != query_id
        k = min(k, int(other.sum()))
        if not k:
            return self.ids[:0], self.ids[:0]
        gain = self.impacts(q)
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 0]
        slack = int((np.abs(q) * ((1 << LEVEL) - 1)).sum())
        score = np.where(other, 0.0, -np.inf)
        bounds = np.linspace(0, len(order), PARTS + 1).astype(int)
        enough = max(8 * k, len(score) // 50)
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = order[a:b]
            length = self.ends[part] - self.starts[part]
            total = int(length.sum())
            begin = np.cumsum(length) - length
            at = np.arange(total) - np.repeat(begin - self.starts[part], length)
            score += np.bincount(self.places[at], weights=np.repeat(gain[part], length), minlength=len(score))
            rest = order[b:]
            first = np.unique(self.dims[rest], return_index=True)[1]  # each dimension's next impact
            left = gain[rest[first]].sum()
            least = np.partition(score, len(score) - k)[len(score) - k] - slack - left
            if np.count_nonzero(score >= least) <= enough:
                break
        possible = np.flatnonzero(score >= least) if len(order) else np.flatnonzero(other)
        exact = self.data[possible] @ q
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible[best]], exact[best]


def _search(k: int):
    names = ["query_id", "vec_id", "score"]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by kind: the group's blocks of rows, then blocks of queries one by one."""
        indexes: dict[tuple[int, int], list[ImpactIndex]] = {}
        for batch in batches:
            for group, size, kind, ids, data in zip(*(batch.column(n) for n in ("group", "size", "kind", "ids", "data"))):
                size, key = size.as_py(), (group.as_py(), size.as_py())
                ids = np.frombuffer(ids.as_buffer(), "<i8")
                data = np.frombuffer(data.as_buffer() or b"", "<i8").reshape(len(ids), size)
                if kind.as_py() == 0:
                    indexes.setdefault(key, []).append(ImpactIndex(ids.copy(), data.copy()))
                    continue
                for index in indexes.get(key, ()):
                    found = [(i, *index.search(int(i), q, k)) for i, q in zip(ids, data)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat([i for i, _, _ in found], [len(x) for _, x, _ in found])),
                        pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], names=names)

    return search


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each query; both sides as (vec_id, v)."""
    spark = rows.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / ROWS))
    index = rows.mapInArrow(_blocks(0, ROWS), BLOCK).withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    asked = queries.mapInArrow(_blocks(1, QUERIES), BLOCK).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = index.unionByName(asked).repartition(groups, "group").sortWithinPartitions("kind")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
