"""Pack documents into sequences of bounded length, in their order, by dynamic programming.

The ids of the documents of a chunk form one stream. Cut points are the ends of documents, the ends of sentences, and,
where neither comes for long, every few ids. A sequence from a to b costs its padding plus a penalty for what its end
cuts: nothing at the end of a document, little at the end of a sentence, more inside one. The cheapest way to b is

    f(b) = penalty(b) + min over a of f(a) + size - (b - a),   b - size <= a < b

whose minimum slides with b: a queue kept in increasing order of f(a) + a has it at its front. A sequence whose length is a power of two
needs no padding; those lengths are looked up beside the queue, at a fixed price that keeps sequences long.

A chunk is at most eight MB of text of one partition (or one longer text), so nothing is shuffled and a lost task
gives the same sequences again. Sequence ids are the partition's number and a counter.

Null and empty texts are one end id. Repeated rows are packed one by one; a null doc_id stays null. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from clipstride.llm.bpe import byte_letters
from clipstride.llm.words import chunks, column_of, words_of

SIZE = 2048
END = 1
#: Prices in ids of padding.
SENTENCE_CUT, INNER_CUT, SHORT_SEQUENCE = 4, 24, 24
#: Without the end of a sentence for so many ids, every so many ids may be cut.
LONG, STEP = 256, 16
#: Short lengths that need no padding and are considered.
SHORT = tuple(1 << k for k in range(6, 11))
#: Distinct parts of words after which a worker forgets their ids and begins anew.
REMEMBERED = 500_000
#: Words that normalising of these kinds only lower-cases, each character alone.
NORMALIZERS, PLAIN = ["NFC", "Replace", "Lowercase"], "^[!-~\u00a1-\u012f\u0131-\u017f]+$"


def _spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[starts[i] : starts[i] + lengths[i]]`` for every i, one after another."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return values[np.arange(total) - np.repeat(begin - starts, lengths)]


class WordIds:
    """Ids of words by a tokenizer that drops white space, so that a text's ids are its words' ids in a row.

    Most words hold only characters that normalising merely lower-cases. They are cut by the tokenizer's pattern for all words at
    once, and its model encodes distinct parts; each part ends in a token that only ends parts. The tokenizer itself takes all other words.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(file, encoding="utf-8") as stored:
            inner = json.load(stored)
        split = inner["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(f" |{split}")
        self.plain = PLAIN if [n["type"] for n in inner["normalizer"]["normalizers"]] == NORMALIZERS else "^$"
        self.special = "|".join(regex.escape(t["content"], special_only=True) for t in inner["added_tokens"]) or "^$"
        suffix = inner["model"]["end_of_word_suffix"]
        vocab = inner["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        inner |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "truncation": None, "padding": None}
        self.model = Tokenizer.from_str(json.dumps(inner))
        self.letters = {byte: letter for letter, byte in byte_letters().items() if byte != 32}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first, self.per = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Ids of parts that are not known, each without white space."""
        spelled = " ".join(parts).encode().decode("latin-1").translate(self.letters).split(" ")
        found = [self.flat]
        for at in range(0, len(spelled), 20_000):
            some = [" ".join(spelled[i : i + 500]) for i in range(at, min(at + 20_000, len(spelled)), 500)]
            found += [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(some, add_special_tokens=False)]
        self.flat = np.concatenate(found)
        past = np.flatnonzero(self.last[self.flat]) + 1
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        if len(past) != len(self.known):
            raise ValueError("the vocabulary's last tokens of parts also stand inside parts")
        self.per = np.diff(past, prepend=0)
        self.first = past - self.per

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many they are) of distinct words."""
        plain = pc.and_not(pc.match_substring_regex(words, self.plain), pc.match_substring_regex(words, self.special))
        easy = plain.to_numpy(zero_copy_only=False)
        first, per, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(0, np.uint32)
        if easy.any():
            cut = pa.array(self.parts.findall(" ".join(words.filter(plain).to_pylist()).lower() + " ")).dictionary_encode()
            names, codes = cut.dictionary.to_pylist(), cut.indices.to_numpy()
            if len(self.known) > REMEMBERED:
                self._forget()
            if new := [x for x in names if x not in self.known and x != " "]:
                self._learn(new)
            space = names.index(" ")
            at = np.fromiter((self.known.get(x, 0) for x in names), np.int64, len(names))
            begin, count = self.first[at], self.per[at]
            count[space] = 0
            lengths = count[codes]
            ids = _spread(self.flat, begin[codes], lengths)
            past = np.cumsum(lengths)[codes == space]
            per[easy] = np.diff(past, prepend=0)
            first[easy] = past - per[easy]
        hard = words.filter(pa.array(~easy)).to_pylist()
        found = [ids]
        for at in range(0, len(hard), 20_000):
            found += [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(hard[at : at + 20_000], add_special_tokens=False)]
        if hard:
            per[~easy] = [len(x) for x in found[1:]]
            first[~easy] = len(ids) + np.cumsum(per[~easy]) - per[~easy]
        return np.concatenate(found), first, per


def stream_of(texts: pa.Array, ids: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts with an end id each, where each text ends, where sentences end)."""
    words = words_of(texts)
    flat, first, per = ids.of(words.distinct)
    stops = pc.match_substring_regex(words.distinct, r"[.!?…]$").to_numpy(zero_copy_only=False)
    # an end word behind each text's words
    counts = words.counts()
    ends = np.cumsum(counts + 1) - 1
    code = np.full(len(words.codes) + len(counts), len(per))
    code[np.setdiff1d(np.arange(len(code)), ends, assume_unique=True)] = words.codes
    per, first, stops = np.append(per, 1), np.append(first, len(flat)), np.append(stops, False)
    lengths = per[code]
    past = np.cumsum(lengths)
    return _spread(np.append(flat, np.uint32(END)), first[code], lengths), past[ends], past[stops[code]]


def cut_points(past: np.ndarray, sentences: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(places, prices) where a sequence may end, from 0 to the end of the stream."""
    places = np.union1d(np.concatenate(([0], past)), sentences)
    gaps = np.diff(places)
    wide, step = np.flatnonzero(gaps > min(LONG, max(size // 4, 1))), min(STEP, max(size // 4, 1))
    more = [np.arange(places[i] + step, places[i + 1], step) for i in wide]
    inner = np.concatenate(more) if more else np.zeros(0, np.int64)
    places = np.union1d(places, inner)
    price = np.full(len(places), INNER_CUT)
    price[np.searchsorted(places, sentences)] = SENTENCE_CUT
    price[np.searchsorted(places, past)] = 0
    price[0] = 0
    return places, price


def cuts(places: np.ndarray, price: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Where the cheapest sequences begin and end."""
    count = len(places)
    known = np.full(int(places[-1]) + 1, -1, np.int64)
    known[places] = np.arange(count)
    to, by = [], []
    for length in SHORT:
        if length < size:
            reach = np.flatnonzero(places >= length)
            begin = known[places[reach] - length]
            to.append(reach[begin >= 0])
            by.append(begin[begin >= 0])
    to, by = np.concatenate([*to, [count]]), np.concatenate([*by, [0]])
    order = np.argsort(to, kind="stable")
    short_to, short_from, hit = to[order].astype(int).tolist(), by[order].astype(int).tolist(), 0
    at, cost = places.tolist(), price.tolist()
    best, back = [0] * count, [0] * count
    queue, key = deque([0]), [0] * count  # key: f(a) + a
    for i in range(1, count):
        b = at[i]
        while at[queue[0]] < b - size:
            queue.popleft()
        a = queue[0]
        least = key[a] + size - b
        while short_to[hit] == i:
            if (other := best[short_from[hit]] + SHORT_SEQUENCE) < least:
                least, a = other, short_from[hit]
            hit += 1
        best[i], back[i] = least + cost[i], a
        value = key[i] = best[i] + b
        while queue and key[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
    out = [count - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return places[out[::-1]]


def pieces(past: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, window, first, past last) of what each window holds of each text."""
    bounds = np.union1d(np.concatenate(([0], past)), windows)
    first, last = bounds[:-1], bounds[1:]
    return np.searchsorted(past, first, side="right"), np.searchsorted(windows, first, side="right") - 1, first, last


def packed(docs: DataFrame, file: str, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, number = WordIds(file), TaskContext.get().partitionId() << 32
        for batch in chunks(batches):
            stream, past, sentences = stream_of(column_of(batch), ids)
            windows = cuts(*cut_points(past, sentences, size), size)
            text, window, first, last = pieces(past, windows)
            begin = np.concatenate(([0], past[:-1]))
            data = stream.astype("<u4").tobytes()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist())]
            columns = [batch.column("doc_id").take(pa.array(text))] + [
                pa.array(np.asarray(x, np.int64)) for x in
                (first - begin[text], last - first, crc, (past - begin)[text], number + window, first - windows[window])]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, last[-1:]), pa.int32()), pa.array(stream.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*columns, lists], names=NAMES)
            number += len(windows) - 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        pack, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES[1:-1]) + ", ids array<int>")


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
