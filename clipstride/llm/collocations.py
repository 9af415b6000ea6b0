"""Phrases of two and three words that stick together, counted by direct-address tiling.

The most frequent words of all languages, HEAD at most, get ids by their rank. A pair of ids is a cell of a plane cut
into square tiles. Inside a task a tile that many pairs fall into is counted at its address (``numpy.bincount``), the
others as sorted coordinates; only cells that are not zero leave the task, dealt to buckets by their hash, where they are
added up, so that no tile is gathered anywhere. Pairs that are frequent are ranked again, and what follows them is counted as pairs of (pair,
word) by the same tiles.

What is rarer than ``least`` cannot be part of a candidate. Where more words than HEAD are frequent, phrases that hold
one of the rest are counted by their text. Bit tables of a fixed largest size tell tasks which of those words, and which
pairs, may be frequent; a wrong yes costs a row that is dropped later, there is no wrong no.

Letters A-Z count as lower case; pieces end at ``.,;:!?`` and the line ends 0A to 0D, words at spaces and tabs. Null text
counts as empty, a null lang as ``und``; a repeated row counts again; other columns are not read. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipstride.llm.substring_dedup import _mixed, _word_hashes
from clipstride.llm.words import chunks, column_of
from clipstride.operators.store import written

#: Words with an id by rank (three ids fit into a long), and frequent pairs with one.
HEAD, HEAD_PAIRS = 1 << 19, 1 << 16
#: Side of a tile; pairs of a chunk from which a tile is counted at its address; such tiles a task keeps; other cells it keeps.
TILE, CROWDED, TILES, CELLS = 512, 1 << 14, 24, 2_000_000
#: Bytes of text that a task works on at once, and distinct words that it gathers.
TEXT_BYTES, WORDS = 3 << 20, 400_000
#: Buckets of cells for each shuffle partition; a bucket is added up at once.
BUCKETS = 1
#: Bits of a table at most, a power of two, and bits of one of its segments.
TABLE_BITS, SEGMENT_BITS = 28, 17
#: Letters A-Z are lowered, tabs become spaces, ends of pieces line feeds.
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
ID_BITS = 20
END = b"\n"


def _pieces(texts: Iterable[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of some texts, and the code of each word; END stands between pieces and between texts."""
    joined = END.join(texts).translate(BYTES).replace(END, b" \n ")
    parts = pc.split_pattern(pa.array([joined], pa.large_binary()), " ").flatten()
    coded = pc.dictionary_encode(parts)
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(distinct, pa.scalar(b"", pa.large_binary())).as_py()
    return distinct, codes[codes != empty] if empty >= 0 else codes


def _by_lang(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(lang, distinct words, codes) chunk by chunk."""
    for batch in chunks(batches, most=TEXT_BYTES):
        langs = pc.dictionary_encode(pc.fill_null(batch.column("lang").cast(pa.string()), "und"))
        texts = column_of(batch).cast(pa.large_binary())
        of = langs.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, *_pieces(texts.take(pa.array(np.flatnonzero(of == i))).to_pylist())


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, n); the row without a word counts all of them."""
    kept: dict[str, dict[bytes, int]] = {}

    def rows(lang: str, counts: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n[at : at + 50_000])], names=["lang", "word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.string()), pa.array([int(n.sum())])], names=["lang", "word", "n"])

    for lang, distinct, codes in _by_lang(batches):
        into = kept.setdefault(lang, {})
        for word, n in zip(distinct.to_pylist(), np.bincount(codes, minlength=len(distinct)).tolist()):
            if n and word != END:
                into[word] = into.get(word, 0) + n
        if sum(map(len, kept.values())) > WORDS:
            for item in kept.items():
                yield from rows(*item)
            kept.clear()
    for item in kept.items():
        yield from rows(*item)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * np.uint64(0xD6E8FEB86659FD93) + _mixed(right))


def _lang_hashes(lang: str, distinct: pa.Array) -> np.ndarray:
    """Hashes of words of a language."""
    return _mixed(_word_hashes(distinct) + _word_hashes(pa.array([lang]))[0])


def _bit_table(rows: DataFrame, parts: list[str], count: int) -> tuple[int, bytes]:
    """(bits, table) of the words, or pairs of words, in the columns ``parts`` of ``rows`` (beside lang)."""
    bits = min(TABLE_BITS, max(SEGMENT_BITS, math.ceil(math.log2(max(16 * count, 1)))))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(len(batch), np.int64)
            langs = pc.dictionary_encode(batch.column("lang"))
            of = langs.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                some = np.flatnonzero(of == i)
                hashes = [_lang_hashes(lang, batch.column(p).take(pa.array(some))) for p in parts]
                found[some] = _places(reduce(_pair_hash, hashes), bits)
            yield pa.RecordBatch.from_arrays([pa.array(found >> SEGMENT_BITS), pa.array(found & ((1 << SEGMENT_BITS) - 1))], names=["segment", "bit"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, bit = (batch.column(c).to_numpy() for c in ("segment", "bit"))
            for s in np.unique(segment):
                segments.setdefault(int(s), np.zeros(1 << SEGMENT_BITS, bool))[bit[segment == s]] = True
        for s, flags in segments.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(flags).tobytes()])], names=["segment", "packed"])

    table = np.zeros((1 << bits) // 8, np.uint8)
    placed = rows.select("lang", *parts).mapInArrow(place, "segment long, bit long").distinct()
    for row in placed.repartition("segment").mapInArrow(pack, "segment long, packed binary").toLocalIterator():
        at = row["segment"] << (SEGMENT_BITS - 3)
        part = np.frombuffer(row["packed"], np.uint8)
        table[at : at + len(part)] |= part
    return bits, table.tobytes()


def _held(table: tuple[int, bytes], hashes: np.ndarray) -> np.ndarray:
    bits, packed = table
    at = _places(hashes, bits)
    return (np.frombuffer(packed, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


class _Cells:
    """Counts of one language: cells at their address, other cells as sorted coordinates."""

    def __init__(self):
        self.tiles: dict[tuple[int, int], np.ndarray] = {}
        self.codes, self.counts, self.size = [], [], 0

    def add(self, left: np.ndarray, right: np.ndarray, code: np.ndarray, room: int) -> None:
        """Count the pairs (left, right); a negative left has no rank and is counted by ``code``."""
        tile = np.where(left >= 0, (left // TILE) << ID_BITS | (right // TILE), -1)
        numbers, of, n = np.unique(tile, return_inverse=True, return_counts=True)
        known = np.array([(int(t) >> ID_BITS, int(t) & ((1 << ID_BITS) - 1)) in self.tiles for t in numbers], bool)
        dense = (numbers >= 0) & (known | ((n >= CROWDED) & (np.cumsum(n >= CROWDED) <= room)))
        for i in np.flatnonzero(dense):
            some, key = of == i, (int(numbers[i]) >> ID_BITS, int(numbers[i]) & ((1 << ID_BITS) - 1))
            address = (left[some] % TILE) * TILE + right[some] % TILE
            here = np.bincount(address, minlength=TILE * TILE)
            self.tiles[key] = self.tiles[key] + here if key in self.tiles else here
        codes, counts = np.unique(code[~dense[of]], return_counts=True)
        self.codes.append(codes)
        self.counts.append(counts)
        self.size += len(codes)

    def merge(self) -> None:
        if len(self.codes) > 1:
            codes, counts = np.concatenate(self.codes), np.concatenate(self.counts)
            self.codes.clear()
            self.counts.clear()
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order]
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))[: len(codes)]
            self.codes, self.counts = [codes[starts]], [np.add.reduceat(counts, starts)]
            self.size = len(starts)

    def rows(self, ranked: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(codes, counts); ``ranked`` gives the code of a left rank, if that is not itself."""
        for (i, j), cells in self.tiles.items():
            at = np.flatnonzero(cells)
            left = i * TILE + at // TILE
            yield (left if ranked is None else ranked[left]) << ID_BITS | (j * TILE + at % TILE), cells[at]
        self.merge()
        yield from zip(self.codes, self.counts)


def _added(least: int):
    """Rows (lang, code, phrase, n) of the cells that reach ``least``; rows of a bucket and language follow each other."""

    def total(lang: str, blocks: list[bytes]) -> pa.RecordBatch:
        parts = [np.frombuffer(b, np.int64).reshape(2, -1) for b in blocks]
        codes, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        codes, n = codes[starts], np.add.reduceat(n, starts)
        codes, n = codes[n >= least], n[n >= least]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.nulls(len(codes), pa.string()), pa.array(n)], names=["lang", "code", "phrase", "n"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for bucket, lang, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "cells"))):
                if now != (bucket, lang) and blocks:
                    yield total(now[1], blocks)
                    blocks = []
                now = bucket, lang
                blocks.append(block)
        if blocks:
            yield total(now[1], blocks)

    return add


def _count_phrases(words: int, heads: dict, more: tuple | None, pairs: tuple | None, ranks: dict, buckets: int):
    """Rows (bucket, lang, cells, phrase, n): phrases of head words as packed cells, others by their text."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, _Cells] = {}
        texts: dict[tuple[str, bytes], int] = {}
        values = {lang: pa.array(w, pa.large_binary()) for lang, w in heads.items()}
        none = np.zeros(0, np.int64)
        hot = {lang: (np.sort(codes), np.argsort(codes), codes) for lang, codes in ranks.items()}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in cells.items():
                for codes, n in c.rows(ranks.get(lang) if words == 3 else None):
                    bucket = (_mixed(codes.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    codes, n, bucket = codes[order], n[order], bucket[order]
                    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(codes)].tolist()
                    packed = [codes[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(codes)])]
                    for at in range(0, len(starts), 500):
                        part = pa.array(packed[at : at + 500], pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(bucket[starts[at : at + 500]]), pa.array([lang] * len(part)), part, pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.int64())],
                            names=["bucket", "lang", "cells", "phrase", "n"])
            items = list(texts.items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(part), pa.int32()), pa.array([k[0] for k, _ in part]), pa.nulls(len(part), pa.binary()),
                     pa.array([k[1] for k, _ in part], pa.binary()).cast(pa.string()), pa.array([n for _, n in part], pa.int64())],
                    names=["bucket", "lang", "cells", "phrase", "n"])
            cells.clear()
            texts.clear()

        for lang, distinct, codes in _by_lang(batches):
            found = pc.index_in(distinct, values[lang]) if lang in values else pa.nulls(len(distinct), pa.int32())
            ids = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = _lang_hashes(lang, distinct) if more or pairs else None
            if more:  # frequent words without a rank: HEAD and beyond, of this chunk
                rest = np.flatnonzero(_held(more, hashes) & (ids < 0))
                ids[rest] = HEAD + rest
            ids[pc.equal(distinct, pa.scalar(END, pa.large_binary())).to_numpy(zero_copy_only=False)] = -1
            word, count_ = ids[codes], len(codes) - words + 1
            good = reduce(np.logical_and, [word[k : count_ + k] >= 0 for k in range(words)]) if count_ > 0 else none
            at = np.flatnonzero(good)
            if words == 3 and len(at):
                first, second, third = (hashes[codes[at + k]] for k in range(3))
                at = at[_held(pairs, _pair_hash(first, second)) & _held(pairs, _pair_hash(second, third))]
            if not len(at):
                continue
            parts = [word[at + k] for k in range(words)]
            ranked = reduce(np.logical_and, [p < HEAD for p in parts])
            if not ranked.all():
                spelt = distinct.to_pylist()
                rows, n = np.unique(np.stack([codes[at[~ranked] + k] for k in range(words)]), axis=1, return_counts=True)
                for some, times in zip(rows.T.tolist(), n.tolist()):
                    key = lang, b" ".join([spelt[c] for c in some])
                    texts[key] = texts.get(key, 0) + times
                parts = [p[ranked] for p in parts]
            if len(parts[0]):
                code = reduce(lambda a, b: a << ID_BITS | b, parts)
                left = parts[0]
                if words == 3:  # the pair before the last word, by its own rank
                    left, (sorted_, order, _) = code >> ID_BITS, hot.get(lang, (none, none, none))
                    if len(sorted_):
                        place = np.minimum(np.searchsorted(sorted_, left), len(sorted_) - 1)
                        left = np.where(sorted_[place] == left, order[place], -1)
                    else:
                        left = np.full(len(code), -1)
                room = TILES - sum(len(c.tiles) for c in cells.values())
                cells.setdefault(lang, _Cells()).add(left, parts[-1], code, max(room, 0))
            if sum(c.size for c in cells.values()) > CELLS:
                for c in cells.values():
                    c.merge()
            if sum(c.size for c in cells.values()) > CELLS or len(texts) > WORDS:
                yield from out()
        yield from out()

    return count


def _heads(rows: DataFrame, value: str, most: int) -> dict[str, list]:
    """By lang the values of the ``most`` rows with the largest n, largest first; at most ``most`` in all."""
    found = rows.orderBy(F.desc("n"), "lang", value).limit(most).select("lang", value).toArrow()
    langs = found.column("lang").to_pylist()
    out: dict[str, list] = {}
    for lang, x in zip(langs, found.column(value).to_pylist()):
        out.setdefault(lang, []).append(x)
    return out


def phrase_counts(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals: lang, n), (words: lang, word, n) and (phrases: lang, phrase, parts, n) of whatever occurs ``least`` times."""
    texts = docs.select("lang", "text")
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = written(counted.where(F.col("word").isNull() | (F.col("n") >= least)))
    totals, words = counted.where("word is null").select("lang", "n"), counted.where("word is not null")
    frequent = words.count()
    heads = _heads(words, "word", HEAD)
    more = _bit_table(words, ["word"], frequent) if frequent > HEAD else None

    def by_text(found: DataFrame, size: int) -> DataFrame:
        """Phrases as texts; codes are read by the ranked words, HEAD rows at most."""
        mask = (1 << ID_BITS) - 1
        spelt = {lang: pa.array(w, pa.string()) for lang, w in heads.items()}

        def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = batch.column("lang").to_pylist()
                codes = batch.column("code")
                rows: list = batch.column("phrase").to_pylist()
                known = np.flatnonzero(pc.is_valid(codes).to_numpy(zero_copy_only=False))
                value = pc.fill_null(codes, 0).to_numpy(zero_copy_only=False)
                lang_of = np.array(langs, object)
                for lang in set(lang_of[known]):
                    some = known[lang_of[known] == lang]
                    parts = [spelt[lang].take(pa.array(value[some] >> (ID_BITS * k) & mask)).to_pylist() for k in reversed(range(size))]
                    for i, *texts_ in zip(some.tolist(), *parts):
                        rows[i] = " ".join(texts_)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang"), pa.array(rows, pa.string()), pa.array([r.split(" ") for r in rows], pa.list_(pa.string())), batch.column("n")],
                    names=["lang", "phrase", "parts", "n"])

        return found.select("lang", "code", "phrase", "n").mapInArrow(read, "lang string, phrase string, parts array<string>, n long")

    def counts(size: int, pairs: tuple | None, ranks: dict) -> DataFrame:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = texts.mapInArrow(
            _count_phrases(size, heads, more, pairs, ranks, BUCKETS * parts), "bucket int, lang string, cells binary, phrase string, n long")
        found = written(found) if more else found
        cells = found.where("cells is not null").select("bucket", "lang", "cells").repartition(parts, "bucket").sortWithinPartitions("bucket", "lang")
        out = cells.mapInArrow(_added(least), "lang string, code long, phrase string, n long")
        if more:
            spelt = found.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            out = out.unionByName(spelt.withColumn("code", F.lit(None).cast("long")))
        return written(out)

    two = counts(2, None, {})
    ranks = {lang: np.array(codes, np.int64) for lang, codes in _heads(two.where("code is not null"), "code", HEAD_PAIRS).items()}
    pairs = written(by_text(two, 2))
    table = _bit_table(pairs.select("lang", F.col("parts")[0].alias("left"), F.col("parts")[1].alias("right")), ["left", "right"], two.count())
    three = counts(3, table, ranks)
    return totals, words, written(pairs.union(by_text(three, 3)))


def _with_count(rows: DataFrame, counts: DataFrame, phrase: Column, name: str, hot: DataFrame) -> DataFrame:
    """Add the count of ``phrase``; ``hot``, a bounded part of ``counts``, is read first, so that no key of the join is hot."""
    few = hot.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("n").alias("_hot"))
    rows = rows.withColumn("_phrase", phrase)
    rows = rows.join(F.broadcast(few), (F.col("lang") == F.col("_l")) & (F.col("_phrase") == F.col("_p")), "left").drop("_l", "_p")
    rest = counts.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("n").alias("_n"))
    some = rows.where("_hot is null").join(rest, (F.col("lang") == F.col("_l")) & (F.col("_phrase") == F.col("_p"))).drop("_l", "_p")
    known = rows.where("_hot is not null").withColumn("_n", F.col("_hot"))
    return known.unionByName(some).withColumnRenamed("_n", name).drop("_phrase", "_hot")


#: Rows of counts that are broadcast: the most frequent ones.
HOT = 20_000


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, inside: int = 50) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate occurs ``least`` times. Its score is the least of floor(1000000 a a / (l r)) over its cuts. It is left out
    if a longer candidate holds it ``inside`` per cent as often.
    """
    totals, words, phrases = phrase_counts(docs, least)
    words = words.select("lang", F.col("word").alias("phrase"), "n")
    hot_words = written(words.orderBy(F.desc("n"), "lang", "phrase").limit(HOT))
    pairs = phrases.where(F.size("parts") == 2)
    hot_pairs = written(pairs.select("lang", "phrase", "n").orderBy(F.desc("n"), "lang", "phrase").limit(HOT))
    three = phrases.where(F.size("parts") == 3).withColumnRenamed("n", "a")
    head, tail = F.concat_ws(" ", F.col("parts")[0], F.col("parts")[1]), F.concat_ws(" ", F.col("parts")[1], F.col("parts")[2])
    held = three.select("lang", F.explode(F.array_distinct(F.array(head, tail))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    two = pairs.withColumnRenamed("n", "a").join(held, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a"))).drop("longest")

    def cut(rows: DataFrame, left: Column, right: Column, of_left: tuple, of_right: tuple, k: int) -> DataFrame:
        rows = _with_count(_with_count(rows, of_left[0], left, "l", of_left[1]), of_right[0], right, "r", of_right[1])
        a, lr = F.col("a").cast("decimal(18,0)"), F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")
        top = (a * a).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")  # 38 digits; ``div`` of decimals is exact
        return rows.withColumn("top", top).withColumn("under", lr).withColumn("score", F.expr("top div under")).withColumn("k", F.lit(k)).drop("top", "under")

    by_word, by_pair = (words, hot_words), (pairs.select("lang", "phrase", "n"), hot_pairs)
    first, second, third = (F.col("parts")[i] for i in range(3))
    one = cut(two, first, second, by_word, by_word, 1).drop("parts")
    cuts = cut(three, first, tail, by_word, by_pair, 1).unionByName(cut(three, head, third, by_pair, by_word, 2))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "cut.k")
    rows = one.unionByName(lowest).drop("k")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = some.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_at") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
