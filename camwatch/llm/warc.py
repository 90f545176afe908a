"""WARC archives: writing with revisit records, and splittable reading.

Archives are uncompressed, so one file can be read by many tasks. A task cannot know
whether the magic it sees begins a record or lies in a payload. So tasks emit every
candidate with the offset of its successor (from its own Content-Length), and pointer
jumping from the start of each file keeps the candidates that the chain reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from camwatch.llm.common import drop, table

#: What every record begins with; the minor version follows. Fixed value.
MAGIC = "WARC/1."
END = "\r\n\r\n"


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """id, digest, url, payload, bytes, refers_to (null: response).

    What a row is depends on its id and its payload: rows that repeat an id with other
    payloads are told apart by the digest.

    Only ids and digests are shuffled; the payloads stay where they are read unless
    the revisits are too many to be broadcast.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))}
    )
    large = base.filter(F.col("bytes") >= least_bytes).select("id", "digest")
    first = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to")
    first = table(first, "originals")  # both sides of the join are then dealt anew, and skewed digests are split
    revisits = table(large.join(first, "digest").filter("id < refers_to").select("id", "digest", "refers_to").distinct(), "revisits")
    return base.join(revisits, ["id", "digest"], "left")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000) -> None:
    """Write one WARC/1.1 record for each row, a file for each partition.

    The payload is the UTF-8 text (null: empty). Of rows with equal payloads of at
    least ``least_bytes`` the one with the largest id is a response; the others are
    revisits without a block that name it. Rows that repeat the largest id with that
    payload are all responses; rows that repeat an id with other payloads are judged
    each by its own. A row with a null id is a response without a record id, and none
    refers to it. A null url leaves the header out; line ends in urls become spaces.
    An empty table gives no record; other columns are ignored.
    """
    rows = plan_records(pages, id_col, url_col, payload_col, least_bytes)
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit(f"{MAGIC}1"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
    )
    # the writer ends each record with END
    rows.select(F.concat(head, F.lit(END), F.when(revisit, "").otherwise(F.col("payload"))).alias("value")).write.option("lineSep", END).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics: file, size of the file, split, row, value."""
    return (
        spark.read.option("lineSep", MAGIC).text(path)
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"), "value",
        )
    )


def header(field: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{field}[ \t]*:[ \t]*(.*?)[ \t]*\r?$", 1)


def candidates(parts: DataFrame) -> DataFrame:
    """file, at (offset of the magic), next (where the record ends), end (where the segment ends) and the header's fields.

    Rows that cannot begin a record (no end of header, no length) have a null ``next``.
    Digest and size are those of the block, if the segment holds it whole. Only
    lengths, digests and headers leave the scan; offsets are sums of lengths: within
    a split by a window of bounded size, across splits by one row for each.
    """
    value = F.col("value")
    head = F.when(F.substring(value, 2, 2) == "\r\n", F.substring_index(F.substr(value, F.lit(4)), END, 1))
    rows = parts.withColumn("len", F.octet_length("value").cast("long")).withColumn("head", head)
    rows = rows.withColumn("head", F.when(F.octet_length("head") + 3 < F.col("len"), F.col("head")))
    rows = rows.withColumn("block", F.expr("try_cast(nullif(regexp_extract(head, '(?im)^content-length[ \\\\t]*:[ \\\\t]*([0-9]+)[ \\\\t]*\\\\r?$', 1), '') as bigint)"))
    skip = F.octet_length("head") + 3 + len(END)  # of the value, before the block
    whole = F.col("len") >= skip + F.col("block")
    rows = rows.select(
        "file", "size", "split", "row", "len",
        (F.lit(len(MAGIC)) + skip + F.col("block") + len(END)).cast("long").alias("span"),
        F.when(F.col("block").isNotNull() & whole, F.sha1(F.substr(value.cast("binary"), (skip + 1).cast("int"), F.col("block").cast("int")))).alias("block_digest"),
        F.col("block").alias("block_bytes"),
        header("WARC-Type").alias("type"), header("WARC-Record-ID").alias("record_id"), header("WARC-Target-URI").alias("url"),
        header("WARC-Payload-Digest").alias("payload_digest"), header("WARC-Refers-To").alias("refers_to"), header("X-Payload-Length").alias("payload_bytes"),
    )
    rows = table(rows, "segments")
    per_split = rows.groupBy("file", "split").agg(F.sum(F.col("len") + len(MAGIC)).alias("bytes"))
    before = per_split.select("file", "split", (F.sum("bytes").over(W.partitionBy("file").orderBy("split")) - F.col("bytes")).alias("before"))
    inside = F.sum(F.col("len") + len(MAGIC)).over(W.partitionBy("file", "split").orderBy("row"))
    out = rows.withColumn("end", inside).join(before, ["file", "split"]).withColumn("end", F.col("before") + F.col("end") - len(MAGIC))
    # a segment's magic stands before it; what is before the first magic of a file begins below 0
    return out.withColumn("at", F.col("end") - F.col("len") - len(MAGIC)).filter("at >= 0").withColumn("next", F.when(F.col("at") + F.col("span") <= F.col("size"), F.col("at") + F.col("span"))).drop("before", "split", "row", "len", "span")


def reachable(nodes: DataFrame) -> DataFrame:
    """file, at of the records that the chain from offset 0 of each file reaches.

    ``nodes``: file, at, next (null: none). With each round the known records double,
    and so does what one jump spans: as many rounds as the logarithm of the records
    of the longest file. Every round is written to the shared folder.
    """
    jump = table(nodes.select("file", "at", "next", (F.col("at") == 0).alias("reached")), "jump")
    while True:
        hit = jump.filter("reached and next is not null").select("file", F.col("next").alias("at"), F.lit(True).alias("hit"))
        onward = jump.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        new = jump.join(hit, ["file", "at"], "left").select("file", "at", "next", "reached", F.coalesce("reached", "hit").alias("was"), F.coalesce(F.col("reached") | F.col("hit"), F.col("reached")).alias("now"))
        new = new.join(onward, ["file", "next"], "left").select("file", "at", F.col("further").alias("next"), F.col("now").alias("reached"), (F.col("now") != F.col("reached")).alias("fresh"))
        new = table(new, "jump")
        found = new.filter("fresh").limit(1).count()
        drop(jump)
        jump = new.drop("fresh")
        jump.scratch_path = new.scratch_path
        if not found:
            return jump.filter("reached").select("file", "at")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, url, type, payload_digest, payload_bytes, refers_to, block_bytes, block_digest, file, offset.

    ``block_digest`` is the SHA-1 of the bytes read. A record whose block holds the
    magic itself is put together from its segments. Files are split among tasks; a
    file that doesn't begin with a record gives none, a record that the file cuts off
    ends its chain. Fields that a header lacks are empty. No files' records: empty.
    """
    parts = segments(spark, path)
    found = table(candidates(parts), "candidates")
    chain = reachable(found.filter("next is not null").select("file", "at", "next"))
    records = table(found.join(chain, ["file", "at"]), "records")
    broken = records.filter("block_digest is null")
    if broken.limit(1).count():
        whole = rejoined(parts, broken)
        records = records.join(whole, ["file", "at"], "left").withColumn("block_digest", F.coalesce("block_digest", "joined_digest"))
    return records.select("record_id", "url", "type", "payload_digest", F.expr("try_cast(payload_bytes as bigint)").alias("payload_bytes"), "refers_to", "block_bytes", "block_digest", "file", F.col("at").alias("offset"))


def rejoined(parts: DataFrame, broken: DataFrame) -> DataFrame:
    """file, at, joined_digest of records whose blocks hold the magic: their files are read again, and each such record's segments are put together."""
    files = broken.select("file").distinct()
    again = parts.join(files, "file", "left_semi").withColumn("len", F.octet_length("value").cast("long"))
    per_split = again.groupBy("file", "split").agg(F.sum(F.col("len") + len(MAGIC)).alias("bytes"))
    before = per_split.select("file", "split", (F.sum("bytes").over(W.partitionBy("file").orderBy("split")) - F.col("bytes")).alias("before"))
    inside = F.sum(F.col("len") + len(MAGIC)).over(W.partitionBy("file", "split").orderBy("row"))
    placed = again.withColumn("end", inside).join(before, ["file", "split"]).select("file", "value", (F.col("before") + F.col("end") - 2 * len(MAGIC) - F.col("len")).alias("pos"))
    owner = broken.select("file", "at", "next", "block_bytes")
    # records don't overlap: a segment has at most one owner; the coarse step of 1 MB keeps the join from meeting all of a file
    step = 1 << 20
    spans = owner.withColumn("cell", F.explode(F.sequence(F.expr(f"at div {step}"), F.expr(f"(next - 1) div {step}"))))
    mine = placed.withColumn("cell", F.expr(f"pos div {step}")).join(spans, ["file", "cell"]).filter("pos >= at and pos < next")
    joined = mine.groupBy("file", "at").agg(F.first("block_bytes").alias("n"), F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("binary").alias("b")))).alias("p"))
    magic = f"cast('{MAGIC}' as binary)"
    text = F.expr(f"aggregate(p, cast('' as binary), (s, x) -> concat(s, {magic}, x.b))")
    skip = F.expr("octet_length(substring_index(cast(b as string), '\\r\\n\\r\\n', 1)) + 4")
    return joined.withColumn("b", text).select("file", "at", F.sha1(F.substr("b", (skip + 1).cast("int"), F.col("n").cast("int"))).alias("joined_digest"))
