"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Spaces become the marker U+2581 and a text gets one in front. No piece of the
vocabulary goes on after a marker that follows other characters, so the best path of
a text is the best paths of its marker-led chunks, one after the other; a task
remembers the chunks it has solved. A character that no piece covers becomes the
pieces of its bytes. Decoding joins the pieces, turns byte pieces into bytes and
markers into spaces, and takes the one in front away.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

MARK = "▁"
#: Words whose pieces a task remembers, and texts that it splits at once.
CACHE, PART = 400_000, 250
#: How much below the least score an uncovered character is, as in the public library.
UNKNOWN_BELOW = 10.0

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def zipf_score(rank: int) -> float:
    """Log score of the piece with that rank (from 0) in the order of the vocabulary.

    The public vocabulary orders its pieces but has no probabilities; a
    Zipf-Mandelbrot law over the ranks gives them. In steps of 1/256, so that sums
    are exact and the same in any order.
    """
    return -round(256 * (math.log(rank + 2.7) + 2.3)) / 256


@dataclass
class Vocabulary:
    """pieces: id, bytes and log score of what a path may use; byte_ids: the ids of the 256 byte pieces."""

    pieces: list[tuple[int, bytes, float]]
    byte_ids: list[int]
    size: int


def load_vocabulary(model_file: str) -> Vocabulary:
    """Pieces of a SentencePiece model; control, unknown and byte pieces take no part in paths."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    by_byte = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if m.is_byte(i)}
    return Vocabulary([(i, m.id_to_piece(i).encode(), zipf_score(r)) for r, i in enumerate(plain)], [by_byte[f"<0x{b:02X}>"] for b in range(256)], m.get_piece_size())


def build_trie(keys: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Double array (base, check, value) of the keys; value is the key's position or -1.

    From state s the byte b leads to ``t = base[s] + b + 1`` if ``check[t] == s``.
    """
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for k, key in enumerate(keys):
        node = 0
        for b in key:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
            node = children[node][b]
        ends[node] = k
    base, check, value = [0] * 512, [-1] * 512, [-1] * 512
    check[0] = 0
    place, first_free, hint = {0: 0}, 257, 257  # every byte can reach the places from 257 on
    queue = [0]
    for node in queue:
        state = place[node]
        value[state] = ends.get(node, -1)
        if not (kids := sorted(children[node])):
            continue
        while first_free < len(check) and check[first_free] >= 0:
            first_free += 1
        at = (first_free if len(kids) == 1 else max(hint, first_free)) - kids[0] - 1
        began = at
        while True:
            if (short := at + 258 - len(check)) > 0:
                grow = max(short, len(check) // 2)
                base += [0] * grow
                check += [-1] * grow
                value += [-1] * grow
            if all(check[at + b + 1] < 0 for b in kids):
                break
            at += 1
        if len(kids) > 1 and at - began > 32:  # crowded: later nodes look further on
            hint = at + kids[0] + 1
        base[state] = at
        for b in kids:
            check[at + b + 1] = state
            place[children[node][b]] = at + b + 1
            queue.append(children[node][b])
    return base, check, value


class Unigram:
    """Encoder and decoder; ``encode`` and ``decode`` work on the texts of one batch."""

    def __init__(self, vocabulary: Vocabulary, trie: tuple[list[int], list[int], list[int]] | None = None):
        self.pieces = vocabulary.pieces
        self.byte_ids = vocabulary.byte_ids
        self.base, self.check, self.value = trie or build_trie([p for _, p, _ in self.pieces])
        self.unknown = min((s for _, _, s in self.pieces), default=0.0) - UNKNOWN_BELOW
        mark = MARK.encode()
        # a chunk may be solved alone only if no piece has a marker behind another character
        self.separable = not any(mark in p.lstrip(mark) for _, p, _ in self.pieces if len(p.lstrip(mark)) and mark in p[1:])
        self.text = [b""] * vocabulary.size
        for i, p, _ in self.pieces:
            self.text[i] = p
        for b, i in enumerate(self.byte_ids):
            self.text[i] = bytes([b])
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # what the cache held before; words still in use move on

    def path(self, data: bytes) -> list[int]:
        """Ids of the best path over UTF-8 bytes; ties go to the path whose last piece begins first."""
        n, base, check, value, pieces = len(data), self.base, self.check, self.value, self.pieces
        limit = len(check)
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            here = best[i]
            lead = data[i]
            end = i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            state, single = 0, False
            for j in range(i, n):
                t = base[state] + data[j] + 1
                if t >= limit or check[t] != state:
                    break
                state = t
                if (v := value[t]) >= 0:
                    if j + 1 == end:
                        single = True
                    if (s := here + pieces[v][2]) > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (i, v)
            if not single and (s := here + self.unknown) > best[min(end, n)]:
                best[min(end, n)], back[min(end, n)] = s, (i, -1)
            i = end
        out: list[int] = []
        while n > 0:
            i, v = back[n]
            out += [pieces[v][0]] if v >= 0 else [self.byte_ids[b] for b in reversed(data[i:n])]
            n = i
        return out[::-1]

    def chunks(self, text: str) -> list[str]:
        if not self.separable:
            return [MARK + text.replace(" ", MARK)] if text else []
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")  # the marker in front is understood
        return _CHUNK.findall(MARK + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [x for lo in range(0, len(texts), PART) for x in self._encode(texts[lo : lo + PART])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        need: set[str] = set()
        need.update(*split)
        for c in need:
            if c not in self.cache and c in self.old:
                self.cache[c] = self.old[c]
            elif c not in self.cache:
                data = (c if c[0] == MARK else MARK + c).encode() if self.separable else c.encode()
                self.cache[c] = np.asarray(self.path(data), "<u4").tobytes()
        get = self.cache.__getitem__
        out = [b"".join(map(get, s)) for s in split]
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


#: Rows that a task encodes at once.
ROWS = 1000


def encode_decode(documents: DataFrame, model_file: str, text_col: str = "text", ids_out: bool = False, text_out: bool = False) -> DataFrame:
    """The rows of ``documents`` with n_pieces, n_byte_pieces, ids_crc32, decoded_chars, round_trip.

    Every text is encoded whole and decoded from its ids. ``round_trip`` is true if
    that gives the text again (a U+2581 in a text comes back as a space, as in the
    public library, and counts as one). ``ids_crc32`` is that of the ids as
    little-endian unsigned 32-bit integers; with ``ids_out`` the ids come too, so
    written (``piece_ids``), with ``text_out`` the decoded text (``decoded``). Null and empty texts have no pieces (crc 0) and round-trip. Columns of the input with
    a result's name are replaced; repeated rows and ties give the same path always.
    """
    spark = documents.sparkSession
    vocabulary = load_vocabulary(model_file)
    shared = spark.sparkContext.broadcast(((vocabulary.pieces, vocabulary.byte_ids, vocabulary.size), build_trie([p for _, p, _ in vocabulary.pieces])))  # as large as the vocabulary
    result = {"n_pieces": pa.int64(), "n_byte_pieces": pa.int64(), "ids_crc32": pa.int64(), "decoded_chars": pa.int64(), "round_trip": pa.bool_()}
    kept = documents.drop(*result, "piece_ids", "decoded")
    at = kept.columns.index(text_col)
    schema = StructType([*kept.schema.fields, *(StructField(k, BooleanType() if k == "round_trip" else LongType()) for k in result), *([StructField("piece_ids", BinaryType())] if ids_out else []), *([StructField("decoded", StringType())] if text_out else [])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trie = shared.value
        own = Vocabulary(*held)
        model = Unigram(own, trie)
        is_byte = np.zeros(own.size, bool)
        is_byte[own.byte_ids] = True
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids = model.encode(texts)
            back = [model.decode(x) for x in ids]
            found = {
                "n_pieces": [len(x) // 4 for x in ids],
                "n_byte_pieces": [int(is_byte[np.frombuffer(x, "<u4")].sum()) for x in ids],
                "ids_crc32": [zlib.crc32(x) for x in ids],
                "decoded_chars": [len(x) for x in back],
                "round_trip": [x == t.replace(MARK, " ") for x, t in zip(back, texts, strict=True)],
            }
            more = [pa.array(found[k], t) for k, t in result.items()] + [pa.array(ids, pa.binary())] * ids_out + [pa.array(back, pa.string())] * text_out
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *result, *["piece_ids"] * ids_out, *["decoded"] * text_out])

    return kept.mapInArrow(work, schema)


def decode_ids(rows: DataFrame, model_file: str, ids_col: str = "piece_ids") -> DataFrame:
    """``rows`` with ``decoded``: the text of the ids in a binary column, as ``encode_decode`` writes them.

    Null ids give null, none an empty text; an id outside the vocabulary stands for
    nothing. A column of the result's name is replaced; repeated rows stay.
    """
    spark = rows.sparkSession
    vocabulary = load_vocabulary(model_file)
    shared = spark.sparkContext.broadcast(((vocabulary.pieces, vocabulary.byte_ids, vocabulary.size), build_trie([p for _, p, _ in vocabulary.pieces])))  # as large as the vocabulary
    kept = rows.drop("decoded")
    at = kept.columns.index(ids_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trie = shared.value
        own = Vocabulary(*held)
        model = Unigram(own, trie)
        for batch in batches:
            found = [None if x is None else model.decode((a := np.frombuffer(x, "<u4"))[a < own.size].tobytes()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(work, StructType([*kept.schema.fields, StructField("decoded", StringType())]))
