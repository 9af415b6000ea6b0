"""Byte-level BPE by speculation: propose, verify, and merge exactly only where the proposal fails.

A word (a piece of text that no merge crosses) is first cut greedily into the longest tokens. Merging would give the
same tokens if every token merges to itself and every adjacent pair is compatible: while the merges of both tokens are
undone from the last to the first, no pair that stood at their seam may have a merge that came earlier than the one
just undone. All distinct pairs of a batch are tested at once. Words with an incompatible pair are merged by rank, a merge
of each in every round over all of them.

A worker remembers its latest distinct words, so common words are done once. Nothing is shuffled.

Null text counts as empty: no ids, the hash of an empty string. Repeated rows give equal rows. The vocabulary's special token is one id where it is
spelled out in a text. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clipstride.llm.words import Memory, chunks, column_of

#: Distinct pieces a worker remembers.
REMEMBERED = 150_000
NEVER = 1 << 40

#: Fixed: what separates words for the pattern of the vocabulary.
ASCII_SPACE = "\\t-\\r "
OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A word with the space before it, or white space up to the last before a word, or that last one.
PIECES = re.compile(f" ?[^{ASCII_SPACE}]+|[{ASCII_SPACE}]+(?![^{ASCII_SPACE}])|[{ASCII_SPACE}]+")
#: Fixed: the vocabulary's pattern, for pieces of ASCII only.
ASCII_PARTS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{ASCII_SPACE}A-Za-z0-9]+|[{ASCII_SPACE}]+(?![^{ASCII_SPACE}])|[{ASCII_SPACE}]+")

#: The same for texts below LATIN_END without OTHER_SPACE: fixed letters (L) and numbers (N) of Unicode there.
LATIN_END = "\u0250"
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PARTS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{ASCII_SPACE}{LETTERS}{NUMBERS}]+|[{ASCII_SPACE}]+(?![^{ASCII_SPACE}])|[{ASCII_SPACE}]+")
#: Bytes of a prefix by which tokens are proposed; bytes of a word from which it is merged alone, by a heap.
PREFIX, LONG = 4, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary file of the tokenizers library, read as tables."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            stored = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = stored["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.spelled = [b""] * size
        for token, i in vocab.items():
            self.spelled[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.spelled[i] = token.encode()
        special = set(self.special.values())
        self.id_of = {self.spelled[i]: i for i in vocab.values() if i not in special}
        self.longest: dict[bytes, int] = {}
        for token in self.id_of:
            if len(token) >= PREFIX:
                self.longest[token[:PREFIX]] = max(self.longest.get(token[:PREFIX], PREFIX), len(token))
        self.text = [str(i).encode() for i in range(size)]
        self.of_byte = np.array([self.id_of[bytes([x])] for x in range(256)], np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in stored["model"]["merges"]):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.merges[x, y] = rank, made
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, x, y
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.made = np.array([m for _, m in self.merges.values()], np.int64)
        made = np.flatnonzero(self.rank >= 0)
        own = self.compatible(self.left[made], self.right[made], self.rank[made])
        self.whole = np.ones(size, bool)  # tokens that merging gives for their own bytes
        self.whole[made] = own
        while True:
            now = self.whole.copy()
            now[made] &= self.whole[self.left[made]] & self.whole[self.right[made]]
            if (now == self.whole).all():
                break
            self.whole = now
        self.known = Memory(REMEMBERED)  # piece: number of ids, ids as text, bytes they decode to
        self.words = Memory(REMEMBERED)  # word: ids

    @cached_property
    def splitter(self):
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=True)

    def merge_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a with b, NEVER if it is no merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether merging the bytes of each pair of tokens keeps the seam between them (up to rank ``before``)."""
        good = np.ones(len(a), bool)
        left = np.arange(len(a))
        limit = np.broadcast_to(np.asarray(before, np.int64), len(a))
        while len(left):
            bad = self.merge_ranks(a, b) < limit
            good[left[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            left, a, b, ra, rb = left[on], a[on], b[on], ra[on], rb[on]
            of_a = ra > rb  # formed later, so undone first; of two equal ones the right one is the later
            limit = np.where(of_a, ra, rb + 1)  # at equal rank the pair further left merges first
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return good

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest tokens."""
        out, at, size, longest, id_of = [], 0, len(word), self.longest, self.id_of
        while at < size:
            to = min(size, at + longest.get(word[at : at + PREFIX], PREFIX - 1))
            while (token := id_of.get(word[at:to])) is None:
                to -= 1
            out.append(token)
            at = to
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word, lowest rank first and from the left."""
        ids, merges = [self.id_of[bytes([x])] for x in word], self.merges
        after, before, heap = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := merges.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]], found[1]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words at once: in each round every word makes its next merge."""
        size = np.array([len(w) for w in words], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        last = np.ones(len(ids), bool)  # of its word
        last[:-1] = owner[1:] != owner[:-1]
        ranks = np.full(len(ids), NEVER)
        inner = np.flatnonzero(~last)
        ranks[inner] = self.merge_ranks(ids[inner], ids[inner + 1])
        out: list[list[int]] = [[] for _ in words]
        while len(ids):
            starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
            least = np.minimum.reduceat(ranks, starts)
            count = np.diff(np.append(starts, len(ids)))
            done = least == NEVER
            if done.any():
                ready = np.repeat(done, count)
                flat, at = ids[ready].tolist(), 0
                for word, n in zip(owner[starts[done]].tolist(), count[done].tolist()):
                    out[word] = flat[at : at + n]
                    at += n
                ids, owner, last, ranks = ids[~ready], owner[~ready], last[~ready], ranks[~ready]
                least, count = least[~done], count[~done]
                if not len(ids):
                    break
            hit = np.flatnonzero(ranks == np.repeat(least, count))
            hit = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))]  # the one furthest left
            ids[hit] = self.made[ranks[hit]]
            last[hit] = last[hit + 1]
            kept = np.ones(len(ids), bool)
            kept[hit + 1] = False
            place = hit - np.arange(len(hit))
            ids, owner, last, ranks = ids[kept], owner[kept], last[kept], ranks[kept]
            ranks[place] = NEVER
            left = place[(place > 0) & ~last[place - 1]] - 1
            again = np.concatenate([place[~last[place]], left])
            ranks[again] = self.merge_ranks(ids[again], ids[again + 1])
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that no merge crosses the ends of."""
        out = [self.proposed(w) for w in words]
        size = np.array([len(x) for x in out], np.int64)
        flat = np.array([i for x in out for i in x], np.int64)
        if not len(flat):
            return out
        owner = np.repeat(np.arange(len(out)), size)
        failed = [owner[~self.whole[flat]]]
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[seam] * self.size + flat[seam + 1], return_inverse=True)
        failed.append(owner[seam[~self.compatible(pairs // self.size, pairs % self.size)[which]]])
        failed = np.unique(np.concatenate(failed)).tolist()
        short = [i for i in failed if len(words[i]) < LONG]
        for i, ids in zip(short, self.merged_all([words[i] for i in short])):
            out[i] = ids
        for i in failed:
            if len(words[i]) >= LONG:
                out[i] = self.merged(words[i])
        return out

    def parts(self, piece: str) -> list[bytes]:
        """The words of a piece, as the vocabulary's pattern cuts it."""
        if max(piece) < LATIN_END and (piece.isalpha() or piece[0] == " " and piece[1:].isalpha()):
            return [piece.encode()]
        if piece.isascii():
            return [p.encode() for p in ASCII_PARTS.findall(piece)]
        return [piece[a:b].encode() for _, (a, b) in self.splitter.pre_tokenize_str(piece)]

    def pieces(self, text: str) -> list[str]:
        """Pieces that the pattern cuts alike alone and in the text, and special tokens."""
        if OTHER_SPACE.search(text):  # white space that joins with its neighbours: the pattern over the whole
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return (LATIN_PARTS if not text or max(text) < LATIN_END else PIECES).findall(text)

    def split(self, text: str) -> list[str]:
        if not any(t in text for t in self.special):
            return self.pieces(text)
        out = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text):
            out.extend([part] if part in self.special else self.pieces(part))
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode distinct pieces: number of ids, ids as text, bytes that the ids decode to."""
        new = self.known.missing(pieces)
        parts = [() if p in self.special else self.parts(p) for p in new]
        words = self.words.missing({w for x in parts for w in x})
        self.words.update(zip(words, self.encode_words(words)))
        for piece, own in zip(new, parts):
            ids = [i for w in own for i in self.words[w]] if own else [self.special[piece]]
            self.known[piece] = len(ids), b",".join([self.text[i] for i in ids]), self.decode_bytes(ids)

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        self.learn(dict.fromkeys(pieces))
        return [int(i) for p in pieces for i in self.known[p][1].split(b",") if i]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.spelled[i] for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _batched(file: str, make, names: list[str]):
    """For each batch: ``make`` of doc_ids and, for each text, its pieces' (count, ids, bytes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(file)
        for batch in chunks(batches, most=4 << 20):
            split = [bpe.split(t) for t in column_of(batch).to_pylist()]
            bpe.learn(set().union(*split))
            known = bpe.known
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *make([[known[p] for p in x] for x in split])], names=names)

    return run


def digests(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def make(texts):
        decoded = [b"".join([k[2] for k in x]) for x in texts]
        return [pa.array([sum(k[0] for k in x) for x in texts], pa.int64()),
                pa.array([sha(b",".join([k[1] for k in x])) for x in texts], pa.string()),
                pa.array([sha(d.decode("utf-8", "replace").encode()) for d in decoded], pa.string())]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _batched(file, make, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
        f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, file: str) -> DataFrame:
    """doc_id and ids of every document."""

    def make(texts):
        return [pa.array([[int(i) for k in x for i in k[1].split(b",")] for x in texts], pa.list_(pa.int32()))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_batched(file, make, ["doc_id", "ids"]), f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, file: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids count as none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(file)
        for batch in batches:
            texts = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
