"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of all words have one global order, rarest first (by how many bigrams fall
into their hash bucket, then by bucket and gram). A word's *prefix* is its three first
bigrams in this order, with all that equal the third: one edit touches two at most. Its
*pivots* are two disjoint bigrams of the prefix, of all such pairs the rarest, chosen by
dynamic programming: one edit touches one at most. Of two words one edit apart take the
one whose prefix ends earlier in the order: a pivot of it stands untouched in the prefix
of the other. So pivots are joined with the prefixes of other words.

Position limits: the edit lies either behind the left pivot, then both words are equal
up to the end of that pivot; or in front of the right pivot, then both are equal from
there to their ends. So the left pivot asks with all that is left of it, the right one
with all that is right of it, for each of the three lengths that a neighbour can have.
Letters that occur an odd number of times differ in two bits at most. What is left is
verified by the edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from camwatch.llm.common import drop, table

#: Hash buckets of the bigrams' counts: the table of the order is this small, whatever the words.
BUCKETS = 1 << 16
#: Bigrams of a word that one edit can touch, and one more.
PREFIX = 3
#: Words that a task counts before it sends the counts on.
HELD = 400_000
#: More words of one key than this are cut into chunks.
CHUNK = 2000
#: Keeps letters (U+00C0 to U+00FF as they are) in Latin-1, lower-cases A-Z only, and makes all else spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def typed_words(doc_id: int | None, text: str, every: int) -> Iterable[tuple[bytes, int]]:
    """The words of a text in Latin-1 with their counts; every so many-th by its hash has lost a letter."""
    seen = Counter(text.encode("latin-1", "replace").translate(LETTERS).split())
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in seen.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % every == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        yield word, n


def count_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """word, n: the distinct words of at least ``shortest`` code points that occur ``least`` times or more in all texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased.
    Where ``every`` divides the crc32 of ``<id>:<word>``, the occurrence loses the code
    point at that number modulo the word's length. Null and empty texts have no words;
    a null id counts as an empty string; rows that repeat count again; no rows give no
    words; other columns are ignored.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            kept = [(w.decode("latin-1"), n) for w, n in held.items() if len(w) >= shortest]
            held.clear()
            for low in range(0, len(kept), 50_000):
                words, n = zip(*kept[low : low + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in typed_words(doc, text.as_py(), every):
                    held[word] += n
                if len(held) > HELD:
                    yield from out()
        yield from out()

    counted = rows.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def pivots(grams: list[tuple[int, int]], weights: list[int]) -> tuple[int, int]:
    """Places of the two disjoint bigrams of least total weight.

    ``grams`` are (place, index into weights) by place. Left to right: the cheapest
    single bigram that ends before a place is known, so each bigram needs one look at
    it; ties go to the earlier pair.
    """
    best, single, waiting = None, None, []
    for place, k in grams:
        while waiting and waiting[0][1] <= place - 2:
            one = waiting.pop(0)
            single = one if single is None or one[0] < single[0] else single
        if single is not None and (best is None or single[0] + weights[k] < best[0]):
            best = single[0] + weights[k], single[1], place
        waiting.append((weights[k], place))
    assert best is not None  # of three bigrams the first and the last are disjoint
    return best[1], best[2]


class Grams:
    """The order of all bigrams, from the counts of their hash buckets."""

    def __init__(self, counts: dict[int, int]):
        self.weight = np.zeros(BUCKETS, np.int64)
        self.weight[list(counts)] = list(counts.values())
        self.rank = np.empty(BUCKETS, np.int64)
        self.rank[np.lexsort((np.arange(BUCKETS), self.weight))] = np.arange(BUCKETS)
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, gram: str) -> tuple[int, int]:
        """Order and weight of a bigram."""
        if (x := self.known.get(gram)) is None:
            if len(self.known) > 1 << 18:
                self.known.clear()
            b = zlib.crc32(gram.encode()) & (BUCKETS - 1)
            x = self.known[gram] = int(self.rank[b]) << 42 | ord(gram[0]) << 21 | ord(gram[1]), int(self.weight[b])
        return x

    def signature(self, word: str) -> tuple[int, list[int], tuple[int, int]]:
        """The order of the prefix's last bigram, the places of the prefix's bigrams, and the places of the pivots."""
        order, weights = zip(*[self.of(word[i : i + 2]) for i in range(len(word) - 1)], strict=True)
        last = sorted(order)[PREFIX - 1]
        prefix = [i for i, x in enumerate(order) if x <= last]
        left, right = pivots([(i, i) for i in prefix], weights)
        return last, prefix, (left, right)


def parity(word: str) -> int:
    """A bit for each of 63 classes of letters, set if the word holds an odd number of them."""
    bits = 0
    for c in word:
        bits ^= 1 << ord(c) % 63
    return bits


SIGNED = "word string, n long, len int, bits long, last long, asks array<string>, holds array<string>"


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of words that differ by exactly one inserted, deleted or replaced code point.

    ``words`` has distinct words of four code points at least, and n. The pairs come from
    pivots joined with prefixes, then verified.
    """
    gram = F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))"))
    buckets = words.select(gram.alias("gram")).groupBy(F.crc32(F.col("gram").cast("binary")).bitwiseAND(BUCKETS - 1).alias("b")).count()
    order = words.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in buckets.collect()})  # at most BUCKETS rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(order.value)
        for batch in batches:
            found = batch.column(0).to_pylist()
            lasts, asks, holds = [], [], []
            for w in found:
                last, prefix, (left, right) = grams.signature(w)
                lasts.append(last)
                asks.append([f"<{w[: left + 2]}", f">{w[right:]}"])
                holds.append([x for i in prefix for x in (f"<{w[: i + 2]}", f">{w[i:]}")])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(len, found), pa.int32()), pa.array(map(parity, found), pa.int64()), pa.array(lasts, pa.int64()), pa.array(asks, strings), pa.array(holds, strings)],
                names=["word", "n", "len", "bits", "last", "asks", "holds"],
            )

    signed = table(words.select("word", "n").mapInArrow(sign, SIGNED), "signed")
    key = ["key", "len"]
    holds = signed.select(F.explode("holds").alias("key"), "len", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"), F.col("last").alias("b_last"))
    asks = signed.select(F.explode("asks").alias("key"), F.explode(F.sequence(F.col("len") - 1, F.col("len") + 1)).alias("len"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), F.col("last").alias("a_last"))
    # a key that many words hold is cut into chunks, and what asks for it asks each of them
    hot = holds.groupBy(*key).count().filter(F.col("count") > CHUNK).select(*key, F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    hot = table(hot, "hot_keys")
    one = F.coalesce("chunks", F.lit(1))
    holds = holds.join(hot, key, "left").withColumn("chunk", F.pmod(F.hash("b"), one)).drop("chunks")
    asks = asks.join(hot, key, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), one - 1))).drop("chunks")
    met = asks.join(holds, [*key, "chunk"]).filter("a_last <= b_last and bit_count(a_bits ^ b_bits) <= 2 and a <> b and levenshtein(a, b, 1) = 1")
    pairs = met.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p"))
    pairs = table(pairs.select("p.*").distinct(), "near")
    drop(hot)
    drop(signed)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word with a form, forms followed to the last, in logarithmically many rounds of jumping.

    A form's count is at least twice its word's, so that there are no circles.
    """
    now = table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = table(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now)
        if jumped.filter("moved").limit(1).count() == 0:
            return jumped.select("word", "root")
        now = jumped.select("word", "root")
        now.scratch_path = jumped.scratch_path


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word.

    ``words`` has word and n, a row a word; rows that repeat a word add up, and rows
    with a null word or one of fewer than four code points are left out (a shorter word
    has no two disjoint bigrams that one edit can't both touch); a null n counts as 0.
    Two words are near if they differ by exactly one inserted, deleted or replaced code
    point. A word's form is its near word of largest n (ties: the smallest by code
    points) if that n is at least ``ratio`` (over 1) times its own; root follows forms
    to the last. No words give no rows; other columns are ignored.
    """
    words = words.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
    words = table(words.filter(F.length("word") > PREFIX), "words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = F.col("n_near").isNotNull() & (-F.col("best.less") >= ratio * F.col("n")) & (-F.col("best.less") > F.col("n"))
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")
    )
    found = table(found, "forms")
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
