"""Token-id files: independent zstandard frames, an id index and a trailing seek table.

Layout of a file: one frame for each document (little-endian ids, 16 bits wide if the
vocabulary allows, with the frame's own checksum); a skippable frame with the ids'
width and the documents' ids; a skippable frame with the seek table of the public
seekable format (compressed size, size and checksum of each frame; footer), so that
a reader fetches the tail and then only the frames it wants.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from camwatch.llm.common import table, temporary

#: Magic numbers of the zstandard formats. Fixed values.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Stands for a null document id in a file.
NO_ID = -(2**63)
#: Words whose ids a task remembers, new words that it encodes and bytes of text that it splits at once.
CACHE, PART, BYTES = 500_000, 1000, 8 << 20
#: What may follow letters as a piece of its own. No apostrophes: those begin pieces with letters.
PUNCTUATION = ",.!?:;*%$#&|)"
#: Stands for a space in a byte-level vocabulary. Fixed value.
SPACE = "\u0120"


class WordEncoder:
    """Ids of whole texts from a byte-level BPE of the tokenizers library.

    Its pre-tokenizer always begins a piece at a single space between two other
    characters, and behind letters that punctuation follows. So a text's ids are
    those of its words, each with the space before it, one after the other; words are
    encoded once by the library, many at a time, and remembered. Texts with other white space beside
    a space, or with the string of an added token, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[k for t, k in self.tokenizer.get_vocab().items() if t.startswith(SPACE)]] = True
        self.cache: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}  # what the cache held before; words still in use move on
        self.tails: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _together(self, words: list[str]) -> None:
        """Remember the words' ids behind a space, many encoded as one text: no token but a word's first begins with a space."""
        for lo in range(0, len(words), PART):
            part = words[lo : lo + PART]
            text = f" {' '.join(part)}"
            ids = np.asarray([] if any(a in text for a in self.added) else self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            starts = np.flatnonzero(self.spaced[ids]) * self.width
            if len(starts) == len(part):
                raw, bounds = ids.astype(self.kind).tobytes(), [*starts.tolist(), len(ids) * self.width]
                self.cache.update((w, raw[i:j]) for w, i, j in zip(part, bounds, bounds[1:], strict=False))
            else:
                self.cache.update((w, self._ids(f" {w}")) for w in part)

    def _learn(self, words: list[str]) -> None:
        """Remember the words' ids behind a space; None for those with white space at an end."""
        cache, old, alone, tailed = self.cache, self.old, {}, []
        for w in words:
            core = w.rstrip(PUNCTUATION)
            if not w or w != w.strip():
                cache[w] = None
            elif core == w or not core.isalpha():
                alone[w] = None
            else:
                tailed.append((w, core))
                if core not in cache:
                    if core in old:
                        cache[core] = old[core]
                    else:
                        alone[core] = None
        self._together(list(alone))
        for w, core in tailed:
            tail = w[len(core) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self._ids(tail)
            cache[w] = cache[core] + self.tails[tail]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        return [x for lo, hi in itertools.pairwise(cuts) if lo < hi for x in self._encode(texts[lo:hi])]

    def _encode(self, texts: pa.Array) -> list[bytes]:
        """The different words of all texts are looked up once; a text's ids are gathered from theirs by position."""
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        found = split.flatten().dictionary_encode()
        firsts = found.take(pa.array(at[:-1])).to_pylist()
        index, words = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        cache = self.cache
        if new := [w for w in words if w not in cache]:
            old = self.old
            cache.update((w, old[w]) for w in new if w in old)
            self._learn([w for w in new if w not in cache])
        known = list(map(cache.__getitem__, words))
        unknown = np.fromiter((x is None for x in known), bool, len(known))
        lengths = np.fromiter((len(x or b"") for x in known), np.int64, len(known)) // self.width
        ids, begins = np.frombuffer(b"".join(x or b"" for x in known), self.kind), np.cumsum(lengths) - lengths
        n, bad = lengths[index], unknown[index]
        n[at[:-1]], bad[at[:-1]] = 0, False  # a text's first word has no space before it
        ends = np.cumsum(n)
        gathered = ids[np.repeat(begins[index] - ends + n, n) + np.arange(n.sum())].tobytes()
        whole = np.add.reduceat(bad, at[:-1], dtype=np.int64) > 0
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        bounds, out = (ends[np.concatenate((at[:1], at[1:] - 1))] * self.width).tolist(), []
        for k, first in enumerate(firsts):
            if whole[k] or first != first.rstrip():
                out.append(self._ids(texts[k].as_py()))
            else:
                out.append((self._ids(first) if first else b"") + gathered[bounds[k] : bounds[k + 1]])
        if len(cache) > CACHE:
            self.old, self.cache = cache, {}
        return out


def write_frames(out, frames: Iterable[tuple[int, bytes, int, int]], width: int) -> tuple[int, int]:
    """Write (document id, frame, size, checksum) rows and the tail; returns documents and tokens."""
    ids, entries, tokens = [], [], 0
    for doc, frame, size, check in frames:
        out.write(frame)
        ids.append(doc)
        entries.append((len(frame), size, check))
        tokens += size // width
    index = struct.pack("<II", width, len(ids)) + np.asarray(ids, "<i8").tobytes()
    out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
    seek = np.asarray(entries, "<u4").tobytes() + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
    out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
    return len(ids), tokens


class FrameReader:
    """Random access to one file; ``source`` is seekable."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        tail = 12 * count + 9
        source.seek(size - tail - 8)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE_SEEK, tail):
            raise ValueError("damaged seek table")
        self.entries = np.frombuffer(source.read(tail - 9), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate(([0], np.cumsum(self.entries[:, 0], dtype=np.int64)))
        source.seek(int(self.offsets[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        self.width, n = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_INDEX or n != count:
            raise ValueError("damaged index")
        self.doc_ids = np.frombuffer(source.read(length - 8), "<i8")
        self.unpacker = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its frame is read. Raises on a wrong checksum."""
        self.source.seek(int(self.offsets[k]))
        raw = self.unpacker.decompress(self.source.read(int(self.entries[k, 0])), max_output_size=int(self.entries[k, 1]))
        if len(raw) != self.entries[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"checksum of frame {k}")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_tokens(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    bytes_per_file: int = 32 << 20,
) -> DataFrame:
    """Encode every text, append ``end_id``, write files in ascending id order; returns the manifest.

    The manifest (file_id, file, docs, tokens, base: ids in all files before) lists
    only what successful tasks wrote: each attempt writes under a name of its own.
    Texts are dealt by ranges of the ids, as many as make about ``bytes_per_file`` of
    text each; a task encodes and writes one range. Null texts are empty (only the
    end id), null ids come first, rows that repeat an id stay side by side in the order
    of their texts' hashes; other columns are ignored; an empty table gives no file.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    n = max(1, -(-(docs.agg(F.sum(F.octet_length("text") + 1).alias("b")).first()["b"] or 0) // bytes_per_file))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = WordEncoder(tokenizer), zstandard.ZstdCompressor(level=1, write_checksum=True)
        end = np.asarray([end_id], encoder.kind).tobytes()

        def frames(first: pa.RecordBatch) -> Iterator[tuple[int, bytes, int, int]]:
            for batch in itertools.chain([first], batches):
                ids = batch.column(0).fill_null(NO_ID).to_pylist()
                for doc, raw in zip(ids, encoder.encode(batch.column(1)), strict=True):
                    raw += end
                    yield doc, pack.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        file_id = first.column(2)[0].as_py()
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        name = f"tokens-{file_id:06d}-{uuid.uuid4().hex}.zst"
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            docs, tokens = write_frames(out, frames(first), encoder.width)
        yield pa.RecordBatch.from_pylist([{"file_id": file_id, "file": name, "docs": docs, "tokens": tokens}])

    order = ["doc_id", "hash"]
    dealt = docs.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = dealt.select("doc_id", "text", F.spark_partition_id().cast("long").alias("file_id"))
    files = table(ranged.mapInArrow(write, "file_id long, file string, docs long, tokens long"), "manifest")
    # one row for each file
    base = F.coalesce(F.sum("tokens").over(W.orderBy("file_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return table(files.withColumn("base", base), "manifest")


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                info = fs.get_file_info(f"{folder}/{row['file']}")
                with fs.open_input_file(info.path) as source:
                    reader = FrameReader(source, info.size)
                    counts, sums = [], []
                    for k in range(len(reader.doc_ids)):
                        ids = reader.ids(k)
                        counts.append(len(ids))
                        sums.append(zlib.crc32(ids.tobytes()))
                counts = np.asarray(counts, np.int64)
                doc_ids = reader.doc_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(row["base"] + np.cumsum(counts) - counts), pa.array(counts), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    dealt = manifest.select("file_id", "file", "base").repartition(max(1, min(manifest.count(), 4096)), "file_id")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the token files into the shared folder and read them back. ``scoped`` functions around it delete the files."""
    path = temporary(documents.sparkSession, "tokens")
    return read_tokens(write_tokens(documents, path, tokenizer, **options), path)
