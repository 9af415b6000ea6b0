"""Ranked lexical search by Block-Max MaxScore over an inverted index dealt by documents.

``index`` cuts the documents into shards and writes for each shard the postings of its terms in blocks: gaps of places
and term frequencies in as few bytes as they need, beside the block's last place, its largest frequency and its shortest
document. ``search`` ranks documents for queries. A shard reads a query's lists by descending bound. As soon as the bounds
of the lists left add up to less than the k-th best sum so far, these lists are non-essential: they bring no new document,
only the candidates are looked up in them, and a candidate whose block cannot lift it to the k-th best goes before the
block is unpacked. The shards' heaps are merged in two steps. Nothing is dropped without proof: scores are whole numbers,
and what may tie with the k-th is kept.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lowered. Score: see ``weight``
and ``impact``. Null or empty texts, and items without terms, rank nothing but are no error. Repeated documents rank each,
repeated items once. Of equal scores the smallest doc_id comes first, nulls last. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipstride.llm.words import Words, chunks, column_of, words_of
from clipstride.operators.store import written

#: Bytes of text and documents of a shard (a place fits into two bytes), postings of a block, queries that a shard answers at once.
SHARD_BYTES, SHARD_DOCS, BLOCK, QUERIES = 24 << 20, 1 << 16, 128, 256
#: ASCII letters and digits stay, A-Z lowered; other ASCII parts terms.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> Words:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    body = (bytes(data[int(offsets[0]) : int(offsets[-1])]) if data is not None else b"").translate(BYTES)
    return words_of(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(body)]))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_terms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The part of the score that grows with a document's length."""
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:
        return np.array([75 + 25 * x * documents // terms for x in n.tolist()], np.int64)
    return 75 + 25 * n * documents // max(terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence in the query adds, before its weight: grows with ``tf``, falls with ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _packed(values: np.ndarray, counts: np.ndarray, small: np.ndarray, wide: int) -> pa.Array:
    """For each block its values in one byte each, or in ``wide`` bytes where it is not ``small``."""
    width = np.where(small, 1, wide)
    ends = np.concatenate(([0], np.cumsum(counts * width, dtype=np.int64)))
    first = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), counts)
    at = ends[of] + (np.arange(len(values)) - first[of]) * width[of]
    out = np.zeros(int(ends[-1]), np.uint8)
    out[at] = values & 255
    more = ~small[of]
    for k in range(1, wide):
        out[at[more] + k] = (values[more] >> (8 * k)) & 255
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())


def _unpacked(block: bytes, count: int, wide: type) -> np.ndarray:
    return np.frombuffer(block, np.uint8 if len(block) == count else wide).astype(np.int64)


def _index(kind: pa.DataType):
    """Rows of blocks; the row of a shard without a term holds its documents."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for whole in chunks(batches, most=SHARD_BYTES):
            for cut in range(0, len(whole), SHARD_DOCS):
                batch = whole.slice(cut, SHARD_DOCS)
                found, docs = terms_of(column_of(batch)), len(batch)
                n = found.counts()
                key, tf = np.unique(found.codes.astype(np.int64) * docs + np.repeat(np.arange(docs), n), return_counts=True)
                term, place = key // docs, key % docs
                fresh = np.concatenate(([True], term[1:] != term[:-1])) if len(term) else np.zeros(0, bool)
                starts = np.flatnonzero(fresh)
                within = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
                starts = np.flatnonzero(within % BLOCK == 0)
                counts = np.diff(np.append(starts, len(term)))
                yield _rows(kind, shard, ids=batch.column("doc_id"), lengths=n)
                for at in range(0, len(starts), 100_000):
                    some, size = starts[at : at + 100_000], counts[at : at + 100_000]
                    low, high = int(some[0]), int(some[-1] + size[-1])
                    begins = some - low
                    places, times = place[low:high], tf[low:high]
                    gap = np.diff(places, prepend=0)
                    gap[begins] = 0
                    inner = np.ones(high - low, bool)
                    inner[begins] = False
                    most = np.maximum.reduceat(times, begins)
                    yield _rows(
                        kind, shard, term=found.distinct.take(pa.array(term[some])).cast(pa.string()), first=places[begins], last=places[begins + size - 1],
                        count=size, most=most, least=np.minimum.reduceat(n[places], begins),
                        gaps=_packed(gap[inner], size - 1, np.maximum.reduceat(gap, begins) < 256, 2), tfs=_packed(times, size, most < 256, 4))
                shard += 1

    return build


BLOCKS = "shard long, term string, first int, last int, count int, most long, least long, gaps binary, tfs binary"


def _rows(kind: pa.DataType, shard: int, **columns) -> pa.RecordBatch:
    count = 1 if "ids" in columns else len(columns["term"])
    given = {"shard": pa.array(np.full(count, shard))}
    if "ids" in columns:
        ids, n = columns.pop("ids"), columns.pop("lengths")
        given["ids"] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        given["lengths"] = pa.array([n.astype("<i8").tobytes()])
        given["n_docs"], given["n_terms"] = pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])
    given |= {k: x if isinstance(x, pa.Array) else pa.array(x) for k, x in columns.items()}
    types = {"shard": pa.int64(), "term": pa.string(), "first": pa.int32(), "last": pa.int32(), "count": pa.int32(), "most": pa.int64(), "least": pa.int64(),
             "gaps": pa.binary(), "tfs": pa.binary(), "ids": pa.list_(kind), "lengths": pa.binary(), "n_docs": pa.int64(), "n_terms": pa.int64()}
    return pa.RecordBatch.from_arrays([given[k].cast(t) if k in given else pa.nulls(count, t) for k, t in types.items()], names=list(types))


def index(docs: DataFrame) -> DataFrame:
    """The written index of documents (doc_id, text): a row for each block, and one without a term for each shard."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = f"{BLOCKS}, ids array<{kind.simpleString()}>, lengths binary, n_docs long, n_terms long"
    return written(docs.select("doc_id", "text").mapInArrow(_index(to_arrow_type(kind)), schema))


def _query_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        found = terms_of(column_of(batch))
        size = max(len(found.distinct), 1)
        key, times = np.unique(np.repeat(np.arange(len(batch)), found.counts()) * size + found.codes, return_counts=True)
        row = pa.array(key // size)
        yield pa.RecordBatch.from_arrays(
            [batch.column("query").take(row), batch.column("item_id").take(row), found.distinct.take(pa.array(key % size)).cast(pa.string()), pa.array(times)],
            names=["query", "item_id", "term", "times"])


class _List:
    """Postings of a term in a shard; a block is unpacked when it is first needed."""

    def __init__(self, first, last, count, most, least, gaps, tfs, m):
        self.first, self.last, self.count, self.gaps, self.tfs, self.m = first, last, count, gaps, tfs, m
        self.bound = impact(most, least)  # ``least``: the length term of the shortest document
        self.top = int(self.bound.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, impacts)"""
        if i not in self.open:
            count = int(self.count[i])
            gap = _unpacked(self.gaps[i], count - 1, np.uint16) if count > 1 else np.zeros(0, np.int64)
            place = self.first[i] + np.concatenate(([0], np.cumsum(gap)))
            self.open[i] = place, impact(_unpacked(self.tfs[i], count, np.uint32), self.m[place])
        return self.open[i]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            self.whole = tuple(map(np.concatenate, zip(*(self.block(i) for i in range(len(self.last))))))
        return self.whole


def ranked(lists: list[tuple[int, _List]], docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of a superset of the ``k`` best of a shard, ties with the last included; lists: (factor, postings)."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: -x[0] * x[1].top)
    rest = np.cumsum([0] + [f * x.top for f, x in reversed(lists)])[::-1]  # most that lists from i on add
    score = np.zeros(docs, np.int64)

    def kth(some: np.ndarray) -> int:
        return int(np.partition(some, len(some) - k)[len(some) - k]) if len(some) >= k else 0

    at, floor = 0, 0
    while at < len(lists) and rest[at] >= floor:  # essential: may bring a document of its own
        place, add = lists[at][1].all()
        score[place] += lists[at][0] * add
        at += 1
        if at < len(lists):
            floor = kth(score)
    some = np.flatnonzero(score)
    while at < len(lists):
        factor, postings = lists[at]
        have = score[some]
        alive = have + rest[at] >= floor
        some, have = some[alive], have[alive]
        block = np.searchsorted(postings.last, some)
        held = block < len(postings.last)
        best = np.where(held, factor * postings.bound[np.minimum(block, len(postings.last) - 1)], 0)
        alive = have + best + rest[at + 1] >= floor
        some, block, held = some[alive], block[alive], held[alive]
        for i in np.unique(block[held]):
            here = some[block == i]
            place, add = postings.block(int(i))
            to = np.minimum(np.searchsorted(place, here), len(place) - 1)
            hit = place[to] == here
            score[here[hit]] += factor * add[to[hit]]
        at += 1
        floor = max(floor, kth(score[some]))
    total = score[some]
    best = (total >= max(kth(total), 1)) & (total > 0)
    return some[best], total[best]


def _answer(documents: int, terms: int, k: int, kind: pa.DataType, item: pa.DataType):
    def answer(blocks: pa.Table, shard: pa.Table) -> pa.Table:
        """``shard``: the documents of a shard beside the terms of some queries."""
        out = {"query": [], "item_id": [], "doc_id": [], "score": [], "shard": []}
        if shard.num_rows and blocks.num_rows:
            row = shard.slice(0, 1)
            ids = row.column("ids").chunk(0)[0].values
            m = length_terms(np.frombuffer(row.column("lengths")[0].as_py(), "<i8"), documents, terms)
            blocks = blocks.sort_by([("term", "ascending"), ("first", "ascending")]).combine_chunks()
            column = {c: blocks.column(c).to_numpy() for c in ("first", "last", "count", "most", "least")}
            least = length_terms(column["least"].astype(np.int64), documents, terms)
            gaps, tfs = blocks.column("gaps").to_pylist(), blocks.column("tfs").to_pylist()
            names = blocks.column("term").to_pylist()
            cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            lists = {
                names[a]: _List(*(column[c][a:b].astype(np.int64) for c in ("first", "last", "count", "most")), least[a:b], gaps[a:b], tfs[a:b], m)
                for a, b in zip(cuts, [*cuts[1:], len(names)])}
            for query in row.column("queries")[0].as_py():
                chosen = [(x["times"] * weight(documents, x["df"]), lists[x["term"]]) for x in query["terms"] if x["term"] in lists]
                place, score = ranked(chosen, len(m), k)
                if len(place) > k:
                    order = pc.sort_indices(
                        pa.table({"s": pa.array(score), "d": ids.take(pa.array(place))}), [("s", "descending"), ("d", "ascending")], null_placement="at_end")
                    place, score = place[order[:k].to_numpy()], score[order[:k].to_numpy()]
                out["query"] += [query["query"]] * len(place)
                out["item_id"] += [query["item_id"]] * len(place)
                out["doc_id"] += ids.take(pa.array(place)).to_pylist()
                out["score"] += score.tolist()
            out["shard"] = [row.column("shard")[0].as_py()] * len(out["score"])
        types = {"query": pa.int64(), "item_id": item, "doc_id": kind, "score": pa.int64(), "shard": pa.int64()}
        return pa.table({c: pa.array(x, types[c]) for c, x in out.items()})

    return answer


def search(found: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of an index for each item (item_id, text): item_id, rank, doc_id, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    item, kind = items.schema["item_id"].dataType, found.schema["ids"].dataType.elementType
    documents, terms = found.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = items.select(F.xxhash64("item_id", "text").alias("query"), "item_id", "text").dropDuplicates(["query"])
    asked = written(asked.mapInArrow(_query_terms, f"query long, item_id {item.simpleString()}, term string, times long"))
    packs = max(1, math.ceil(asked.agg(F.count_distinct("query")).first()[0] / QUERIES))
    asked = asked.withColumn("pack", F.pmod("query", F.lit(packs)).cast("int"))
    postings = found.where("term is not null").drop("ids", "lengths", "n_docs", "n_terms")
    holding = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("count").alias("df"))
    known = asked.join(holding, "term")
    queries = known.groupBy("pack", "query", "item_id").agg(F.collect_list(F.struct("term", "times", "df")).alias("terms"))
    queries = queries.groupBy("pack").agg(F.collect_list(F.struct("query", "item_id", "terms")).alias("queries"))
    shards = found.where("term is null").select(
        F.col("shard").alias("shard"), "ids", "lengths", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack")).join(
        queries.withColumnRenamed("pack", "of"), F.col("pack") == F.col("of")).drop("of")
    wanted = postings.join(known.select("term", "pack").distinct(), "term")
    answers = wanted.groupBy("shard", "pack").cogroup(shards.groupBy("shard", "pack")).applyInArrow(
        _answer(documents, terms, k, to_arrow_type(kind), to_arrow_type(item)),
        f"query long, item_id {item.simpleString()}, doc_id {kind.simpleString()}, score long, shard long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = answers.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")
