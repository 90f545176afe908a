"""A log of messages as a Spark data source, and the sink for what can't be parsed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MESSAGE = "type string, event_id string, site_id bigint, camera string, label string, ts timestamp, end_ts timestamp, text string"
#: Bytes of a log that one task reads at most, unless a line is longer.
CHUNK = 16 << 20


class Piece(InputPartition):
    """Bytes of one segment of one topic."""

    def __init__(self, topic: str, segment: str, low: int, high: int):
        super().__init__((topic, segment, low, high))
        self.topic, self.segment, self.low, self.high = topic, segment, low, high


class MessageLogReader(DataSourceStreamReader):
    """Offsets are the bytes of each segment that hold whole lines; a batch reads what lies between two of them."""

    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def _open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = self._open()
        found = {}
        for info in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.path[len(root.rstrip("/")) + 1 :]
            if info.type == pyarrow.fs.FileType.File and name.endswith(".log") and (end := self._whole(fs, info.path, info.size)):
                found[name] = end
        return dict(sorted(found.items()))

    @staticmethod
    def _whole(fs: pyarrow.fs.FileSystem, path: str, size: int) -> int:
        """Bytes up to the last line feed: a line that is still being written waits."""
        with fs.open_input_file(path) as source:
            high = size
            while high > 0:
                low = max(0, high - (64 << 10))
                source.seek(low)
                if (at := source.read(high - low).rfind(b"\n")) >= 0:
                    return low + at + 1
                high = low
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pieces = []
        for name, high in end.items():
            topic, _, segment = name.rpartition("/")
            for low in range(start.get(name, 0), high, self.chunk):
                pieces.append(Piece(topic, segment, low, min(low + self.chunk, high)))
        return pieces

    def read(self, partition: Piece) -> Iterator[tuple]:
        """Lines that begin in the piece; the last one may end behind it."""
        fs, root = self._open()
        p = partition
        with fs.open_input_file(f"{root}/{p.topic}/{p.segment}".replace("//", "/")) as source:
            at, rest = p.low, b""
            if at > 0:
                source.seek(at - 1)
                before = source.read(1)
                while before and not before.endswith(b"\n"):  # a line that began in the piece before
                    more = source.read(4096)
                    cut = more.find(b"\n")
                    at += cut + 1 if cut >= 0 else len(more)
                    before = b"\n" if cut >= 0 or not more else more
            source.seek(at)
            while at < p.high:
                block = source.read(1 << 20)
                if not block:
                    return
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if at >= p.high:
                        return
                    yield (p.topic, p.segment, at, line.decode("utf-8", "replace"))
                    at += len(line) + 1


class MessageLog(DataSource):
    """``spark.readStream.format("message_log").load(path)``: path/<topic>/<segment>.log, a message a line, appended to; topics may have slashes."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return "topic string, segment string, offset bigint, payload string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        path = self.options["path"]
        return MessageLogReader(path if ":" in path else f"file://{path}", int(self.options.get("chunk", CHUNK)))


def parsed(messages: DataFrame) -> DataFrame:
    """``body``: the payload's fields; null where it is no JSON object."""
    text = F.trim("payload")
    ok = F.try_parse_json(text).isNotNull() & text.startswith("{")
    return messages.withColumn("body", F.when(ok, F.from_json("payload", MESSAGE, {"mode": "PERMISSIVE"})))


def read_messages(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """A stream of messages: topic, payload, ``body`` (null where the payload can't be parsed), and what the format adds.

    ``fmt``: ``json``, files of rows with topic, payload, ingest_ts; ``log``, appended
    logs by topic (``MessageLog``; adds segment and offset, the byte where a message
    begins, so that a replay from a checkpoint reads each message once); ``kafka``,
    ``path`` being the bootstrap servers (needs Spark's connector on the class path; adds
    partition, offset and ingest_ts). Other options go to the source.
    """
    if fmt == "json":
        raw = spark.readStream.schema("topic string, payload string, ingest_ts timestamp").options(**options).json(path)
    elif fmt == "log":
        spark.dataSource.register(MessageLog)
        raw = spark.readStream.format("message_log").options(**options).load(path)
    elif fmt == "kafka":
        topics = {} if {"subscribe", "subscribePattern", "assign"} & set(options) else {"subscribePattern": ".*"}
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", path).options(**topics, **options).load()
        raw = raw.select("topic", F.col("value").cast("string").alias("payload"), "partition", "offset", F.col("timestamp").alias("ingest_ts"))
    else:
        raise ValueError(f"no such format: {fmt}")
    return parsed(raw)


def dead_letter_sink(messages: DataFrame, path: str, checkpoint: str):
    """Write messages with a body to ``path/rows`` and the others to ``path/dead``, a folder for each batch: one that is run again replaces its own."""

    def split(batch: DataFrame, n: int) -> None:
        kept = batch.persist()
        kept.filter("body is not null").write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        kept.filter("body is null").drop("body").write.mode("overwrite").parquet(f"{path}/dead/batch={n}")
        kept.unpersist()

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(split).trigger(availableNow=True).start()
