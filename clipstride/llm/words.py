"""Words ``[^\\x20\\x09-\\x0D]+`` of whole texts, read from Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text bytes that a task works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20


def in_sample(hashed: Column, share: float | Column) -> Column:
    """Whether a 64-bit hash falls into a share of all; 63 bits are compared, so no share is too small for large tables."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return (share >= 1) | (F.shiftrightunsigned(hashed, 1) < F.ceil(share * F.lit(2.0**63)))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds more than ``most`` bytes of ``column``, but for single longer rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def column_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column without nulls (a null counts as empty)."""
    return pc.fill_null(batch.column(name), "")


class Words(NamedTuple):
    """Distinct words, each word's place among them, and where each text's words begin (one more than texts)."""

    distinct: pa.Array
    codes: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def words_of(texts: pa.Array) -> Words:
    """Split on ASCII white space; other white space belongs to words."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = pc.dictionary_encode(lists.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)))
    distinct = coded.dictionary
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:  # beside leading and trailing space
        word = codes != empty
        offsets = np.concatenate(([0], np.cumsum(word, dtype=np.int64)))[offsets]
        codes = codes[word]
    return Words(distinct, codes, offsets)


class Memory(dict):
    """What a worker remembers of distinct words: at most twice ``most``, those last used in front of others."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, words: Iterable) -> list:
        """The words that are not remembered; afterwards all others are in the dictionary."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        out, older = [], self.older
        for word in words:
            if word not in self:
                if (found := older.get(word)) is not None:
                    self[word] = found
                else:
                    out.append(word)
        return out
