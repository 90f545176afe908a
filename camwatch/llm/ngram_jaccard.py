"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word n-grams. Every n-gram flips one bit of a
sketch, so the Hamming distance of two sketches is at most the size of the sets'
symmetric difference. At a wanted Jaccard similarity that size has a bound d, which
depends on the sets' sizes: so the documents are put into bands of sizes, each band's
sketches are cut into more than d blocks, and two documents that are similar enough
agree in at least one of the blocks that are joined (pigeonhole). Blocks that agree make candidates, a small sketch
of the whole set drops those too far apart, and the sets themselves decide.

What is wanted are the classes of documents that links connect, not every link. Equal
sets are one class from the start. In each bucket documents are first compared with a
few leaders; the links found join most of a group of copies, and after that only
documents of different classes are compared. No pair that could link two classes is
left out, whatever its bucket's size; large buckets are cut into chunks, and all pairs
of chunks are compared.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from camwatch.llm.common import components, drop, scoped, table

#: Ratio of a band's largest and smallest sizes.
BAND = 1.5
#: Documents of a bucket that a task compares with each other.
CHUNK = 20_000
#: The documents, and then the keys, are shuffled in so many parts, one after the other: less lies on disk at once.
PARTS = 2
#: Parity bits that a pair is compared by before its sets are fetched.
WIDE = 4096
#: Bytes of text that a task turns into sets at once.
PART = 1_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams of words between white space, A-Z lower-cased.

    A text with fewer words than ``size`` has its whole sequence as one n-gram, one
    without words has none. All texts of a batch are hashed together: a word's hash
    is a difference of prefix sums of its bytes times powers of an odd number.
    """
    if not texts:
        return []
    raw = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    n = len(raw)
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _BASE))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _INVERSE))))
    words = mix((sums[ends] - sums[starts]) * back[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, bounds)
    first = np.concatenate(([0], last[:-1]))
    m = len(words) - size + 1
    grams = np.zeros(max(m, 0), np.uint64)
    for k in range(size):
        if m > 0:
            grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m]
    grams = mix(grams)
    out = []
    for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif hi > lo:
            whole = np.full(1, hi - lo, np.uint64)  # arrays wrap around
            for k in range(lo, hi):
                whole = (whole * np.uint64(0xD6E8FEB86659FD93)) ^ words[k : k + 1]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(grams: np.ndarray, bits: int = 512) -> bytes:
    """That many parity bits of the set; a power of two."""
    words = np.zeros(bits // 64, np.uint64)
    at = (grams >> np.uint64(20)) & np.uint64(bits - 1)
    np.bitwise_xor.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    return words.tobytes()


class Bands:
    """Which bands a set belongs to, and into how many blocks each cuts the sketches."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent = percent
        self.bounds = [1]
        while self.bounds[-1] < most:
            self.bounds.append(max(self.bounds[-1] + 1, ceil(self.bounds[-1] * BAND)))
        self.array = np.array(self.bounds)

    def difference(self, total):
        """The largest symmetric difference of two sets with that many members together, if they are similar enough."""
        return (100 - self.percent) * total // (100 + self.percent)

    def of(self, n: int) -> list[int]:
        """The set's own band, and the next if a partner may be in it."""
        own = int(np.searchsorted(self.array, n, "right")) - 1
        return [own] + [own + 1] * (100 * n >= self.percent * self.bounds[own + 1])

    def blocks(self, band: int) -> tuple[int, int]:
        """Blocks that a band's sketches are cut into, and how many of them are kept.

        Of ``d + 1 + e`` blocks at least ``1 + e`` agree; so under one order of all
        block values the first ``d + 1`` of each sketch have one in common (prefix
        filter). The order puts blocks with many n-grams first: the weakest ``e``,
        empty ones above all, aren't joined.
        """
        keep = self.difference(2 * (self.bounds[band + 1] - 1)) + 1
        return keep + keep // 2, keep

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """One key for each kept block of each band: the block's parity word and the XOR of its n-grams, hashed with band and place.

        The n-grams are sorted, and their high bits name the block, so blocks are runs.
        """
        out = []
        for band in self.of(len(grams)):
            p, keep = self.blocks(band)
            block = ((grams >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
            at = np.flatnonzero(np.diff(block, prepend=np.uint64(p)))
            words, sums, sizes = np.zeros(p, np.uint64), np.zeros(p, np.uint64), np.zeros(p, np.int64)
            words[block[at]] = np.bitwise_xor.reduceat(np.uint64(1) << (grams & np.uint64(63)), at)
            sums[block[at]] = np.bitwise_xor.reduceat(grams, at)
            sizes[block[at]] = np.diff(at, append=len(grams))
            key = mix(mix(mix(words) ^ sums) + np.arange(p, dtype=np.uint64) * _BASE + np.uint64(band << 48))
            out.append(key[np.lexsort((key, -sizes))[:keep]])
        return np.concatenate(out).view(np.int64)


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < PART):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def summaries(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint of the set), s and wide (sketches), keys. ``docs``: doc_id, text as binary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _parts(texts):
                sets = ngram_sets(texts[lo:hi], size)
                keys = [bands.keys(g) if len(g) else np.zeros(0, np.int64) for g in sets]
                cut = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array([len(g) for g in sets], pa.int64()),
                        pa.array([int(g.sum(dtype=np.uint64).view(np.int64)) for g in sets], pa.int64()), pa.array([int(mix(g ^ _BASE).sum(dtype=np.uint64).view(np.int64)) for g in sets], pa.int64()),
                        pa.array([sketch(g) for g in sets], pa.binary()), pa.array([sketch(g, WIDE) for g in sets], pa.binary()), pa.ListArray.from_arrays(cut, np.concatenate(keys)),
                    ],
                    names=["doc_id", "n", "f1", "f2", "s", "wide", "keys"],
                )

    return docs.mapInArrow(work, "doc_id long, n long, f1 long, f2 long, s binary, wide binary, keys array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of whole groups of sorted rows, many groups at once; a group never spans two results."""
    kept: list[np.ndarray] = []
    for batch in batches:
        new = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, 8) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
        if not len(cols[0]):
            continue
        same = np.ones(len(cols[0]), bool)
        for c in cols[:keys]:
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield [c[:cut] for c in cols]
        kept = [c[cut:] for c in cols]
    if kept and len(kept[0]):
        yield kept


def _runs(cols: list[np.ndarray], keys: int) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(len(cols[0]), bool)
    change[0] = True
    for c in cols[:keys]:
        change[1:] |= c[1:] != c[:-1]
    lo = np.flatnonzero(change)
    return lo, np.concatenate((lo[1:], [len(change)]))


def candidates(entries: DataFrame, percent: int, by_class: bool) -> DataFrame:
    """a, b, apart (bits): pairs to verify, from rows key, part, doc, side, c (class), n, s.

    With ``by_class`` all pairs of different classes, else each document with the
    first leader close to it. In the parts of a large bucket that compare two chunks,
    only pairs of different sides count.
    """
    bands = Bands(percent, 2)

    def near(i, others, n, s):
        apart = np.bitwise_count(s[others] ^ s[i]).sum(axis=1, dtype=np.int64)
        return (apart <= bands.difference(n[others] + n[i])) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])), apart

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches, 2):
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            far: list[np.ndarray] = []
            _, _, doc, side, cls, n, s = cols
            lo, hi = _runs(cols, 2)
            two = lo[hi - lo == 2]
            if len(two):  # most groups are pairs
                ok, apart = near(two, two + 1, n, s)
                ok &= doc[two] != doc[two + 1]
                if by_class:
                    ok &= (cls[two] != cls[two + 1]) & (side[two] <= side[two + 1])
                a.append(doc[two[ok]])
                b.append(doc[two[ok] + 1])
                far.append(apart[ok])
            for x, y in zip(lo[hi - lo > 2].tolist(), hi[hi - lo > 2].tolist(), strict=True):
                rest = np.arange(x, y)
                if by_class and (cls[x:y] == cls[x]).all():
                    continue
                crossing = by_class and side[x:y].any()
                while len(rest) > 1:
                    i, rest = rest[0], rest[1:]
                    ok, apart = near(i, rest, n, s)
                    hit = ok & (doc[rest] != doc[i])
                    if by_class:
                        hit &= cls[rest] != cls[i]
                        if crossing:
                            hit &= side[rest] != side[i]
                    to = rest[hit]
                    a.append(np.full(len(to), doc[i]))
                    b.append(doc[to])
                    far.append(apart[hit])
                    if not by_class:
                        rest = rest[~ok]
            if a:
                a_, b_ = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a_, b_)), pa.array(np.maximum(a_, b_)), pa.array(np.concatenate(far))], names=["a", "b", "apart"])

    dealt = entries.repartition("key", "part").sortWithinPartitions("key", "part", "side", "doc")
    return dealt.select("key", "part", "doc", "side", "c", "n", "s").mapInArrow(work, "a long, b long, apart long")


def close(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide sketches don't differ by more than their sets may."""
    bands = Bands(percent, 2)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
                ok = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= bands.difference(batch.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    left, right = points.select(F.col("doc").alias("a"), F.col("wide").alias("wa"), F.col("n").alias("na")), points.select(F.col("doc").alias("b"), F.col("wide").alias("wb"), F.col("n").alias("nb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb", (F.col("na") + F.col("nb")).alias("total")).mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough; only texts that occur in a pair are turned into sets again."""
    wanted = table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _parts(texts):
                found = ngram_sets(texts[lo:hi], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([g.tobytes() for g in found], pa.binary())], names=["doc_id", "grams"])

    held = table(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc_id long, grams binary"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = held.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), held.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(check, "a long, b long").distinct()


@scoped
def ngram_classes(documents: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: classes of documents that links connect.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their
    sets; ``component_id`` is the smallest id that links reach, the document's own
    included. Null or empty texts, and texts without words, have an empty set and no
    link. Texts of any length count whole. Rows that repeat an id are one document
    for the links (each keeps its own count); a row with a null id has no link and a
    null component. An empty table gives an empty result; other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    all_docs = table(summaries(docs, size, percent), "sets")
    linked = all_docs.filter("doc_id is not null and n > 0")
    # equal sets are one class; its smallest id stands for it
    rep = table(linked.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    points = linked.join(rep.withColumnRenamed("rep", "doc_id"), ["n", "f1", "f2", "doc_id"], "left_semi")
    points = points.select(F.col("doc_id").alias("doc"), "n", "s", "wide", "keys")
    points = functools.reduce(DataFrame.union, [table(points.filter(F.pmod("doc", F.lit(PARTS)) == part), "points") for part in range(PARTS)])
    rows = table(all_docs.select("doc_id", "n", "f1", "f2"), "rows")
    drop(all_docs)
    # only keys that documents share matter, and those are few; ``chunks`` cuts large buckets. One shuffle: counted where they are gathered
    exploded = points.select(F.explode("keys").alias("key"), "doc")
    shared = exploded.withColumn("m", F.count("*").over(W.partitionBy("key"))).filter("m > 1").select("key", "doc", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"))
    parts = [table(shared.filter(F.pmod("key", F.lit(PARTS)) == part), "buckets") for part in range(PARTS)]
    buckets = functools.reduce(DataFrame.union, parts)
    entries = buckets.join(points.select("doc", "n", "s"), "doc").withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.hash("doc"), "chunks")).otherwise(0))
    entries = table(entries.select("key", "chunks", F.col("chunk").cast("long").alias("chunk"), "doc", "n", "s"), "entries")
    for part in parts:
        drop(part)
    tries = candidates(entries.select("key", F.col("chunk").alias("part"), "doc", F.lit(0).alias("side"), F.col("doc").alias("c"), "n", "s"), percent, False)
    # each document is first tried with the closest leader only
    tries = table(tries.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b"), "tries")
    links = table(verified(tries, docs, size, percent), "links")
    known = components(links)
    label = F.coalesce("component", "doc").alias("c")
    classed = entries.join(known.withColumnRenamed("id", "doc"), "doc", "left")
    # every pair of chunks meets once: in part i * chunks + j with i <= j; in a mixed part the sides differ
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1))
    paired = classed.withColumn("other", other).select(
        "key", (F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")).alias("part"),
        "doc", F.when(F.col("chunk") > F.col("other"), 1).otherwise(0).alias("side"), label, "n", "s",
    )
    met = candidates(paired, percent, True).select("a", "b").distinct().join(tries, ["a", "b"], "left_anti")
    left = table(close(table(met, "met"), points, percent), "left")
    if left.limit(1).count():
        known = components(links.unionByName(verified(left, docs, size, percent)))
    by_rep = rep.join(known.withColumnRenamed("id", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    by_rep = table(by_rep, "by_rep")
    # documents whose id repeats with different sets belong to the class of either
    return rows.join(by_rep, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_first(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, of which each class of ``ngram_classes`` keeps the one with the smallest id. Null ids stay."""
    gone = table(ngram_classes(documents, size, percent).filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
