"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is its set of lower-cased words between spaces. The words are ordered by rarity:
by how often the corpus has words of their hash bucket, counted over all documents (a
fixed number of buckets, so the table of counts is small at any size), then by hash.
Two lines whose Jaccard similarity is high enough share a word among their rarest ones
(prefix filter). Of the words that they share the first one has all others behind it in
both lines: so where it stands and how long both are bounds what they share (positional
and length filters; lines meet by word and by size band, and a word stands in a band only
where the least line of that band leaves room for it). Parity bits of the sets (their
differing bits bound the words that only one has) drop most of the rest before any set
is fetched. What is left is verified on the whole sets. A line goes if an earlier line of the corpus (by document, then
place) has the same set or one similar enough.

Equal sets are one class, whose earliest line stands for it. Large groups of near copies
don't make all their pairs: where more than a few lines share a word and a band, they are
compared with the earliest of them only, and those that this leaves undecided with all
earlier ones. Of a line's candidates the earliest is verified first, the others only if
that one is not similar.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from camwatch.llm.common import drop, scoped, table

#: Hash buckets for the word counts.
BUCKETS = 1 << 17
#: A similarity of at least this many hundredths.
PERCENT = 80
#: Lines of more words than this are compared by 128 parity bits, others by 64: all words' bits, and those of half the words apart.
LONG = 64
#: The words are taken in so many parts, one after the other: less lies on disk at once.
PARTS = 2
#: Up to so many lines that share a word and a band are all compared with each other at once; of more, first each with the earliest.
FEW = 128
#: A place in a text: the line's number in the upper bits, below it 32 bits of the text's hash, which tell rows apart that repeat an id with other texts.
TEXT_BITS = (1 << 32) - 1


def rarity_table(texts: DataFrame) -> bytes:
    """A number up to 94 for each bucket, higher where the corpus has more such words: 4 steps for each doubling.

    Words are counted as they are written. The order only decides how much work is
    left out, never what is found, so that counts need no lower case.
    """
    words = texts.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(F.split("line", " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).alias("k")).agg(F.count("*").alias("n"))
    rows = counts.select("k", F.least(F.floor(F.log2(F.col("n") + 1) * 4), F.lit(93)).cast("int").alias("c")).collect()  # at most BUCKETS
    held = bytearray(BUCKETS)
    for r in rows:
        held[r["k"]] = 1 + r["c"]
    return bytes(held)


def words_of(line: Column) -> Column:
    """Lower-cased words between spaces."""
    return F.array_remove(F.split(F.lower(line), " "), "")


def rare_first(words: Column, rarity: bytes) -> Column:
    """The distinct words as longs, rarest first: the bucket's count class in the high bits, the word's hash below."""
    classes = F.split(F.lit(",".join(map(str, rarity))), ",").cast("array<bigint>")  # folded into a constant
    # never null, so that Spark sorts plain longs
    code = lambda x: F.shiftleft(F.coalesce(F.get(classes, x.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("long")), 55).bitwiseOR(F.shiftrightunsigned(x, 9))
    return F.sort_array(F.transform(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), code))


def text_bits(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(TEXT_BITS)


def line_table(texts: DataFrame, rarity: bytes, percent: int) -> DataFrame:
    """doc_id, place, key and key2 (hashes of the line's set), n (0 without words), p0 and p1 (parity bits), prefix.

    The prefix holds short hashes of the rarest words: that two of them are equal by
    chance makes a candidate more, no link.
    """
    # the hash and the lines in a step of their own: else each line carries its text and hashes all of it
    split = texts.select("doc_id", text_bits(F.col("text")).alias("bits"), F.split("text", "\n").alias("lines"))
    lines = split.select("doc_id", "bits", F.posexplode("lines").alias("line_no", "line"))
    place = F.shiftleft(F.col("line_no").cast("long"), 32).bitwiseOR(F.col("bits")).alias("place")
    # no filter on n before the table is written: it would be pushed below, and the words made twice
    codes = lines.select("doc_id", place, rare_first(words_of(F.col("line")), rarity).alias("codes")).withColumn("n", F.size("codes"))
    keep = F.col("n") - F.expr(f"cast(({percent} * n + 99) div 100 as int)") + 1
    every = F.expr("aggregate(codes, 0L, (s, x) -> s ^ shiftleft(1L, cast(x & 63 as int)))").alias("p0")
    half = F.expr(f"if(n > {LONG}, aggregate(codes, 0L, (s, x) -> s ^ shiftleft((x >> 6) & 1L, cast(x & 63 as int))), 0L)").alias("p1")
    return codes.select("doc_id", "place", F.xxhash64("codes").alias("key"), F.hash("codes").alias("key2"), "n", every, half, F.transform(F.slice("codes", F.lit(1), keep), lambda x: F.hash(x)).alias("prefix"))


def could_match(percent: int) -> str:
    """What holds for a pair of lines at the first word that they share: a is earlier; length filter; positional filter (all
    that they share stands from there on in both); and parity bits that differ are at most the words that only one has."""
    return (
        f"(a_doc < b_doc or (a_doc = b_doc and a_place < b_place)) and {percent} * a_n <= 100 * b_n and {percent} * b_n <= 100 * a_n "
        f"and {percent} * (a_n + b_n) <= {100 + percent} * least(a_n - a_i, b_n - b_i) "
        f"and {100 + percent} * if(least(a_n, b_n) > {LONG}, bit_count(a_p1 ^ b_p1) + bit_count(a_p0 ^ a_p1 ^ b_p0 ^ b_p1), bit_count(a_p0 ^ b_p0)) <= {100 - percent} * (a_n + b_n)"
    )


BITS = ["p0", "p1"]
#: What a pair is judged by, of each of its lines.
SIDE = ["doc", "place", "n", "i", *BITS]


def exploded(classes: DataFrame, percent: int) -> DataFrame:
    """A row for each word of the prefixes and each size band: key (word and band), doc, place, n, i (from 0), p0, p1.

    A band holds the sizes of one power of two. A line is put into the bands of all
    sizes from its own down to the least that a line similar to it can have. A word is
    left out of a band where even the least size in it, if similar, would share more
    words than stand from it on. Lines so short that only equal sets are similar have no rows.
    """
    band = lambda n: F.floor(F.log2(n)).cast("int")
    least = f"cast(({percent} * n + 99) div 100 as int)"
    cells = F.explode(F.sequence(band(F.expr(least)), band(F.col("n")))).alias("cell")
    at = classes.filter(f"100 * n >= {percent} * (n + 1)").select(cells, "doc", "place", "n", *BITS, "prefix")
    rows = at.select("cell", "doc", "place", "n", *BITS, F.posexplode("prefix").alias("i", "word"))
    rows = rows.filter(f"{100 + percent} * (n - i) >= {percent} * (n + greatest({least}, shiftleft(1, cell)))")
    return rows.select(F.shiftleft(F.col("word").cast("long"), 8).bitwiseOR(F.col("cell").cast("long")).alias("key"), *SIDE)


def first_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates of the rows that share a key: a_doc, a_place, b_doc, b_place, ok.

    Where more than FEW lines share a key, a is the earliest of them, and each other
    line has a row, with its own ``key``, b_n, b_i, b_p0 and b_p1 for the second round;
    ``ok`` says whether the pair is a candidate. Elsewhere these are null and all are ok.
    """
    rows = rows.repartition("key")  # one shuffle for both sides
    of_key = W.partitionBy("key")
    a = rows.withColumns({"m": F.count("*").over(of_key), "top": F.min("doc").over(of_key), "top_place": F.min_by("place", "doc").over(of_key)})
    a = a.filter(f"m > 1 and (m <= {FEW} or (doc = top and place = top_place))").select("key", (F.col("m") > FEW).alias("many"), *(F.col(c).alias(f"a_{c}") for c in SIDE))
    both = a.join(rows.select("key", *(F.col(c).alias(f"b_{c}") for c in SIDE)), "key").withColumn("ok", F.expr(could_match(percent)))
    both = both.filter("ok or (many and (a_doc <> b_doc or a_place <> b_place))")
    return both.select(*PAIR, "ok", *(F.when(F.col("many"), F.col(c)).alias(c) for c in ("key", *(f"b_{c}" for c in SIDE[2:])))).distinct()


PAIR = ["a_doc", "a_place", "b_doc", "b_place"]


def similar_pairs(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough; only lines that occur in a pair are split into words again."""
    ends = pairs.select(F.col("a_doc").alias("doc_id"), F.col("a_place").alias("place")).union(pairs.select("b_doc", "b_place")).distinct()
    # a document's lines that are asked for: at most its own lines
    wanted = table(ends.groupBy("doc_id").agg(F.collect_list("place").alias("wanted")), "wanted")
    asked = texts.join(wanted, "doc_id").select("doc_id", text_bits(F.col("text")).alias("bits"), F.split("text", "\n").alias("lines"), "wanted")
    lines = asked.select("doc_id", "bits", "lines", F.explode("wanted").alias("place")).filter(F.col("place").bitwiseAND(TEXT_BITS) == F.col("bits"))
    line = F.get("lines", F.shiftright("place", 32).cast("int"))
    sets = lines.select("doc_id", "place", F.array_distinct(F.transform(words_of(line), lambda w: F.xxhash64(w))).alias("codes")).groupBy("doc_id", "place").agg(F.first("codes").alias("codes"))
    sets = table(sets, "line_sets")
    left = sets.select(F.col("doc_id").alias("a_doc"), F.col("place").alias("a_place"), F.col("codes").alias("a_codes"))
    right = sets.select(F.col("doc_id").alias("b_doc"), F.col("place").alias("b_place"), F.col("codes").alias("b_codes"))
    both = pairs.join(left, PAIR[:2]).join(right, PAIR[2:]).withColumn("common", F.size(F.array_intersect("a_codes", "b_codes")))
    return both.filter(100 * F.col("common") >= percent * (F.size("a_codes") + F.size("b_codes") - F.col("common"))).select(*PAIR)


@scoped
def kept_lines(documents: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place of the lines that have words and stay."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    lines = table(line_table(texts, rarity_table(texts), percent), "lines")
    # equal sets are one class; its earliest line stands for it. Spark keeps one row of a class in each task before the shuffle
    first = F.row_number().over(W.partitionBy("key", "key2", "n").orderBy("doc_id", "place"))
    classes = lines.filter("n > 0").withColumn("r", first).filter("r = 1").select(F.col("doc_id").alias("doc"), "place", "n", *BITS, "prefix")
    classes = table(classes, "classes")
    drop(lines)
    rows = exploded(classes, percent)
    word = F.shiftright("key", 8)
    found = [table(first_candidates(rows.filter(F.pmod(word, F.lit(PARTS)) == part), percent), "found") for part in range(PARTS)]
    found = functools.reduce(DataFrame.union, found)
    # of each line's candidates the earliest first
    tries = table(found.filter("ok").select(*PAIR).distinct(), "tries")
    tried = table(tries.groupBy("b_doc", "b_place").agg(F.min("a_doc").alias("a_doc"), F.min_by("a_place", "a_doc").alias("a_place")).select(*PAIR), "tried")
    sure = table(similar_pairs(tried, texts, percent).select("b_doc", "b_place").distinct(), "sure")
    # then the lines that are still open: their other candidates, and where many lines share a key, all earlier ones of these
    crowd = found.filter("key is not null")
    side = lambda rows, s: rows.select("key", F.col("b_doc").alias(f"{s}_doc"), F.col("b_place").alias(f"{s}_place"), *(F.col(f"b_{c}").alias(f"{s}_{c}") for c in SIDE[2:]))
    still = crowd.join(sure, PAIR[2:], "left_anti")
    late = side(crowd, "a").join(side(still, "b"), "key").filter(could_match(percent)).select(*PAIR)
    late = tries.join(sure, PAIR[2:], "left_anti").select(*PAIR).union(late).distinct().join(tried, PAIR, "left_anti")
    late = similar_pairs(table(late, "late"), texts, percent).select("b_doc", "b_place").distinct()
    gone = sure.union(late).select(F.col("b_doc").alias("doc"), F.col("b_place").alias("place"))
    return classes.select("doc", "place").join(gone, ["doc", "place"], "left_anti").withColumnRenamed("doc", "doc_id")


def dedup_lines(documents: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with the repeated lines taken out of the text; ``n_lines`` and ``n_removed`` are added.

    Lines end with line feeds. Lines without words always stay, so empty lines keep
    paragraphs apart. Null texts, empty texts and rows with a null id stay as they
    are. Rows that repeat an id and a text lose the same lines; rows that repeat an id
    with other texts lose lines by their own texts, of lines at the same place the one
    with the smaller hash of its text counts as earlier. A text all of whose lines go
    becomes empty; its document stays. Empty tables give empty results. Columns of
    the added names are replaced; any other names may occur.
    """
    stay = kept_lines(documents, percent, id_col, text_col)
    kept = documents.drop("n_lines", "n_removed")
    names = [f"c{k}" for k in range(len(kept.columns))]  # names of ours, so that no column's name can clash
    row, text = kept.toDF(*names), names[kept.columns.index(text_col)]
    of = F.col(names[kept.columns.index(id_col)]).cast("long")
    stay = table(stay.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("place").alias("stay")), "stay")  # at most a document's lines
    rows = row.join(stay, of == F.col("id"), "left").withColumn("lines", F.split(text, "\n")).withColumn("bits", text_bits(F.col(text)))
    own = F.transform(F.filter("stay", lambda p: p.bitwiseAND(TEXT_BITS) == F.col("bits")), lambda p: F.shiftright(p, 32).cast("int"))
    none = F.array().cast("array<int>")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    worded = F.filter(every, lambda i: F.trim(F.get("lines", i)) != "")
    # lines with words that aren't among those that stay; rows with a null id or text keep all
    gone = F.when(of.isNull() | F.col(text).isNull(), none).otherwise(F.array_except(worded, F.coalesce(own, none)))
    rows = rows.withColumn("own", gone)
    rest = F.array_except(every, "own")
    new = F.when(F.size("own") == 0, F.col(text)).otherwise(F.array_join(F.transform(rest, lambda i: F.get("lines", i)), "\n"))
    removed = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("own")).cast("long")
    return rows.select(
        *((new if n == text else F.col(n)).alias(c) for n, c in zip(names, kept.columns, strict=True)),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("n_lines"), removed.alias("n_removed"),
    )
