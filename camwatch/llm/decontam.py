"""Benchmark decontamination: size-partitioned minimum-hash containment search, in DataFrame functions only.

Items are partitioned by the width of their shingles (five words, or all of a shorter
item's, so that it is found inside a long document) and by the power of two of their
number of shingles. A partition has one sketch size k: one more than the shingles that
its largest item may miss at the wanted containment. An item's sketch is its k smallest
shingle hashes, so a document that contains enough of the item shares at least one of
them, at any length of the document. The largest hash in a partition's sketches is its
bound: of a document's hashes only those that are within a bound of some partition of
their width are looked up. Candidates are verified by exact shingle containment.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camwatch.llm.common import ascii_lower, scoped, table

#: Words of a shingle.
WORDS = 5


def words_of(text: Column) -> Column:
    """Words between white space, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(words: Column, size: int) -> Column:
    """Distinct 64-bit hashes of ``size`` consecutive words; none with fewer words."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda i: F.xxhash64(*[F.get(words, (i + k - 1).cast("int")) for k in range(size)]))
    return F.when(F.size(words) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))


def exploded(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, bits, shingle. The words are a column of their own: a lambda would split the text anew for every shingle."""
    return rows.select("doc_id", F.xxhash64("text").alias("bits"), words_of(F.col("text")).alias("w")).select("doc_id", "bits", F.explode(shingles_of(F.col("w"), width)).alias("shingle"))


def item_sets(items: DataFrame, id_col: str, text_col: str, containment: float) -> DataFrame:
    """item_id, item (number of its text), width, part, n, need, k, s (its shingles). Items without words have no row."""
    base = items.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.col(text_col)).alias("w")).filter("size(w) > 0").distinct()
    width = F.least(F.size("w"), F.lit(WORDS))
    by_width = F.lit(None).cast("array<bigint>")
    for size in range(1, WORDS + 1):
        by_width = F.when(width == size, shingles_of(F.col("w"), size)).otherwise(by_width)
    sets = base.select("item_id", F.xxhash64("w").alias("item"), width.alias("width"), by_width.alias("s")).withColumn("n", F.size("s"))
    need = lambda n: F.ceil(n * F.lit(containment) - F.lit(1e-9)).cast("int")
    sets = sets.withColumns({"part": F.floor(F.log2("n")).cast("int"), "need": need(F.col("n"))})
    # the largest item of a partition sets its k; a smaller one has no more than its shingles
    largest = sets.groupBy("width", "part").agg(F.max(F.col("n") - F.col("need") + 1).alias("k"))
    return sets.join(F.broadcast(largest), ["width", "part"])  # a row for each width and power of two


@scoped
def contaminated(
    documents: DataFrame,
    items: DataFrame,
    containment: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found: documents that hold at least that share of an item's shingles.

    Shingles have five words, those of an item with fewer words all of its words.
    Items and documents without words match nothing. Rows that repeat an id with
    another text are looked at each by itself: of a document's rows and an item's the
    best pair counts (the largest share, then the larger item). Rows that repeat both
    count once. Documents with a null id match nothing; an item's id may be null. Empty
    tables give no rows. Any other columns are ignored.
    """
    sets = table(item_sets(items, item_id_col, item_text_col, containment), "items")
    sketches = sets.select("width", "part", "item", F.explode(F.slice(F.sort_array("s"), F.lit(1), F.col("k"))).alias("shingle"))
    probe = table(sketches.groupBy("width", "part", "shingle").agg(F.collect_set("item").alias("items")), "sketches")
    bounds = {r["width"]: r["bound"] for r in probe.groupBy("width").agg(F.max("shingle").alias("bound")).collect()}  # at most WORDS rows
    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    # candidates, without repeats; the sketches are small next to the documents, and Spark broadcasts them only if they are
    found = []
    for width, bound in sorted(bounds.items()):
        low = exploded(base, width).filter(F.col("shingle") <= F.lit(bound))
        found.append(low.join(probe.filter(F.col("width") == width), "shingle").select("doc_id", "bits", "width", F.explode("items").alias("item")))
    if not found:
        return documents.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_found")).limit(0)
    pairs = table(functools.reduce(DataFrame.union, found).distinct(), "candidates")
    # exact containment, for candidate documents: shingles that any item has, then counts by pair
    wanted = table(sets.select("item", "width", "n", "need", F.explode("s").alias("shingle")).distinct(), "item_shingles")
    docs = base.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    hits = functools.reduce(DataFrame.union, [exploded(docs, w).join(wanted.filter(F.col("width") == w), "shingle").select("doc_id", "bits", "item", "n", "need", "shingle") for w in sorted(bounds)])
    held = hits.groupBy("doc_id", "bits", "item", "n", "need").agg(F.count("*").alias("found")).filter("found >= need").join(pairs, ["doc_id", "bits", "item"], "left_semi")
    named = held.join(sets.select("item", "item_id").distinct(), "item")
    best = named.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("found") / F.col("n")).alias("share"), "n", "found")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n").cast("long").alias("n_shingles"), F.col("m.found").alias("n_found"))


def decontaminate(documents: DataFrame, items: DataFrame, containment: float = 0.8) -> DataFrame:
    """The documents, all columns, without those that ``contaminated`` finds. Rows with a null id stay."""
    found = table(contaminated(documents, items, containment).select("doc_id").distinct(), "contaminated")
    return documents.join(found, "doc_id", "left_anti").select(*documents.columns)
