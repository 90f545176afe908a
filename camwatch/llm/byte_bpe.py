"""Byte-level BPE by ranks: encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern. First tier: a minimal perfect
hash over the vocabulary tells for a whole batch of pre-tokens at once which of them are
tokens themselves. Second tier: the others are merged over a doubly linked list of their
bytes, with a heap that holds every mergeable pair by rank, then place; a pre-token of n
bytes takes n log n steps, whatever its length.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Pre-tokens and words that a task remembers in each of two generations, the length up to which it does, and texts encoded at once.
CACHE, SHORT, PART = 300_000, 48, 250
#: A space between two characters that aren't white space: a pre-token always begins there.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Spaces that are none of these.
ODD = re.compile(r"^ | $|\s | \s")
SPREAD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, no two keys in one slot.

    Keys are dealt to buckets of three on average. The buckets, largest first, get the
    least displacement that puts all their keys into free slots; a bucket of one key
    gets one of the slots that are left, by its number.
    """

    def __init__(self, keys: list[bytes], width: int = 3):
        self.n, self.buckets = len(keys), len(keys) // width + 1
        self.seed = 0
        while not self._build(keys):
            self.seed += 1

    def _hashes(self, keys: list[bytes]) -> np.ndarray:
        seed, of = self.seed, xxhash.xxh3_64_intdigest
        return np.fromiter((of(k, seed) for k in keys), np.uint64, len(keys))

    def _slots(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        x = hashes + displacement.astype(np.uint64) * SPREAD
        x = (x ^ (x >> np.uint64(32))) * MIX
        return ((x ^ (x >> np.uint64(32))) % np.uint64(max(self.n, 1))).astype(np.int64)

    def _build(self, keys: list[bytes]) -> bool:
        h = self._hashes(keys)
        if len(np.unique(h)) < self.n:
            return False
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.displacement = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[ends[b] - sizes[b] : ends[b]]
            if len(own) < 2:
                break
            for low in range(0, 1 << 22, 256):
                d = np.arange(low, low + 256)
                slots = np.sort(self._slots(h[own][:, None], d[None, :]), axis=0)
                good = (self.key_at[slots] < 0).all(axis=0) & (slots[1:] != slots[:-1]).all(axis=0)
                if good.any():
                    self.displacement[b] = d[good.argmax()]
                    self.key_at[self._slots(h[own], self.displacement[b : b + 1])] = own
                    break
            else:
                return False
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(self.key_at < 0)
        self.displacement[single] = -1 - free
        self.key_at[free] = order[ends[single] - 1]
        return True

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of the only key that each word can be; the caller compares."""
        if not self.n:
            return np.full(len(words), -1, np.int64)
        h = self._hashes(words)
        d = self.displacement[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.key_at[np.where(d < 0, -1 - d, self._slots(h, np.maximum(d, 0)))]


class Ranks:
    """A vocabulary of ranks, as the tiktoken format has it; the driver builds it once and sends it to the workers."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.tokens, self.ids = list(ranks), list(ranks.values())
        self.hash = PerfectHash(self.tokens)
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        # a pair may merge if what it makes is a token: its rank is that token's
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None:
                    self.pairs[left << 32 | right] = rank

    def plain(self) -> dict:
        """Only values that any worker can unpickle."""
        return vars(self) | {"hash": vars(self.hash)}

    @classmethod
    def of(cls, plain: dict) -> Ranks:
        made, made_hash = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        vars(made_hash).update(plain["hash"])
        vars(made).update(plain | {"hash": made_hash})
        return made

    @classmethod
    def read(cls, path: str) -> Ranks:
        lines = map(bytes.split, Path(path).read_bytes().splitlines())
        return cls({base64.b64decode(token): int(rank) for token, rank in filter(None, lines)})


class ByteBpe:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.text = dict(zip(ranks.ids, ranks.tokens, strict=True))
        self.pre: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # pre-tokens; those in use move to the newer one
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.merged = self.found = 0  # pre-tokens that each tier has answered

    def merge(self, data: bytes) -> list[int]:
        """Ids of a pre-token that is no token: of all pairs the one with the least rank merges first, of equal ones the first."""
        find, push, pop, n = self.ranks.pairs.get, heapq.heappush, heapq.heappop, len(data)
        ids = list(map(self.ranks.bytes.__getitem__, data))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = map(find, [a << 32 | b for a, b in itertools.pairwise(ids)])
        heap = [r << 32 | i for i, r in enumerate(first) if r is not None]
        heapq.heapify(heap)
        while heap:
            e = pop(heap)
            rank, i = e >> 32, e & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or find(ids[i] << 32 | ids[j]) != rank:
                continue  # an end of it has merged meanwhile
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := find(rank << 32 | ids[k])) is not None:
                    push(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := find(ids[h] << 32 | rank)) is not None:
                push(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _look_up(self, pre: set[str]) -> None:
        """Remember the ids of distinct pre-tokens: those in the vocabulary by the perfect hash, the others by merging."""
        new, old = self.pre
        rest = []
        for p in pre:
            if p not in new:
                if (x := old.get(p)) is None:
                    rest.append(p)
                else:
                    new[p] = x
        data, tokens, ids = [p.encode() for p in rest], self.ranks.tokens, self.ranks.ids
        for p, d, k in zip(rest, data, self.ranks.hash.find(data).tolist(), strict=True):
            if tokens[k] == d:
                self.found += 1
                new[p] = ids[k].to_bytes(4, "little")
            else:
                self.merged += 1
                new[p] = array("I", self.merge(d)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [x for low in range(0, len(texts), PART) for x in self._encode(texts[low : low + PART])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        # words with the space before them; the first of a text has none
        split = [CUT.split(t) if ODD.search(t) else t.split(" ") for t in texts]
        need: set[str] = set()
        for words in split:
            need.update(words[1:])
        new, old = self.words
        fresh = []
        for w in need:
            if w not in new:
                if (x := old.get(w)) is None:
                    fresh.append(w)
                else:
                    new[w] = x
        cut = [self.pieces(" " + w) for w in fresh]
        first = [self.pieces(words[0]) for words in split]
        pre = set(itertools.chain(*cut, *first))
        self._look_up(pre)
        ids = self.pre[0].__getitem__
        for w, parts in zip(fresh, cut, strict=True):
            new[w] = b"".join(map(ids, parts))
        get = new.__getitem__
        out = [b"".join(map(ids, head)) + b"".join(map(get, words[1:])) for head, words in zip(first, split, strict=True)]
        self.pre, self.words = (self._kept(*held, used) for held, used in ((self.pre, pre), (self.words, fresh)))
        return out

    @staticmethod
    def _kept(new: dict[str, bytes], old: dict[str, bytes], used: Iterable[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """The generations after a part: without long strings, and with an empty newer one where that is full."""
        for p in used:
            if len(p) > SHORT:
                new.pop(p, None)
        return ({}, new) if len(new) > CACHE else (new, old)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids; an id outside the vocabulary raises."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _mapped(rows: DataFrame, column: str, ranks_file: str, pattern: str, more: list[StructField], of) -> DataFrame:
    """``rows`` with the columns ``more``, made by ``of(codec, values)`` for PART rows at a time."""
    shared = rows.sparkSession.sparkContext.broadcast({"ranks": Ranks.read(ranks_file).plain()})  # as large as the vocabulary
    kept = rows.drop(*(f.name for f in more if f.name != column))
    at = kept.columns.index(column)
    names = [f.name for f in more]
    kinds = {BinaryType(): pa.binary(), LongType(): pa.int64()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # of the worker process: what a codec remembers serves its next tasks too
        if "codec" not in held:
            held["codec"] = ByteBpe(Ranks.of(held["ranks"]), pattern)
        codec = held["codec"]
        for batch in (b.slice(low, PART) for b in batches for low in range(0, b.num_rows, PART)):
            found = of(codec, batch.column(at).to_pylist())
            arrays = [pa.array(x, kinds[f.dataType]) for x, f in zip(found, more, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return kept.mapInArrow(work, StructType([*kept.schema.fields, *more]))


def encode_texts(documents: DataFrame, ranks_file: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The rows with n_tokens and token_ids: the ids of each whole text as little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded for itself, without special tokens; the
    pattern must begin a match at every space between two other characters that aren't
    white space, as byte-level patterns do. With ``decoded`` the bytes that the ids
    stand for come too (``decoded_bytes``). Null and empty texts have no ids. Columns
    of the input with a result's name are replaced, all others stay; repeated rows and
    rows with a null id are rows like others, ties do not occur; an empty table gives
    an empty one. The text column must not have a result's name.
    """
    more = [StructField("n_tokens", LongType()), StructField("token_ids", BinaryType()), *[StructField("decoded_bytes", BinaryType())] * decoded]

    def of(codec: ByteBpe, texts: list[str | None]) -> list[list]:
        ids = codec.encode([t or "" for t in texts])
        return [[len(x) // 4 for x in ids], ids, *[list(map(codec.decode, ids))] * decoded]

    return _mapped(documents, text_col, ranks_file, pattern, more, of)


def decode_ids(rows: DataFrame, ranks_file: str, ids_col: str = "token_ids") -> DataFrame:
    """The rows with decoded_bytes, the bytes of the ids in a binary column; null ids give null. An id outside the vocabulary fails the job."""
    of = lambda codec, ids: [[None if x is None else codec.decode(x) for x in ids]]
    return _mapped(rows, ids_col, ranks_file, "", [StructField("decoded_bytes", BinaryType())], of)
