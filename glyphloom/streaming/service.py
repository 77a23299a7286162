"""A text service as a stream: each request is a row, the answer a column expression of it."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

Task = Callable[[Column], Column]

# Where requests come from by default, and how long one may be.
HOST, FIRST_PORT, REQUEST_BYTES = "localhost", 55000, 1024


def identity(value: Column) -> Column:
    return value


def answers(requests: DataFrame, task: Task = identity, most: int | None = None) -> DataFrame:
    """value, answer of requests (value), batch or stream; with `most`, only so many bytes of a longer request are read, up to its last whole character."""
    value = F.col("value")
    if most is not None:
        head = F.make_valid_utf8(F.substring(value.cast("binary"), 1, most).cast("string"))
        value = F.when(F.octet_length(value) <= most, value).otherwise(F.regexp_replace(head, "\uFFFD+$", ""))
    return requests.select(value.alias("value")).select("value", task(F.col("value")).alias("answer"))


def socket_requests(spark: SparkSession, port: int = FIRST_PORT, host: str = HOST) -> DataFrame:
    """A stream of the lines that a socket sends. It can't be replayed: a durable service reads files or a log."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of the text files that come into a folder."""
    return spark.readStream.text(folder)


def serve(requests: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, task: Task = identity, name: str = "answers", most: int | None = REQUEST_BYTES) -> StreamingQuery:
    """Answer requests batch by batch; sink gets each batch's answers and its number, by which it can drop a batch that comes again."""
    return answers(requests, task, most).writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def start_services(spark: SparkSession, sink: Callable[[DataFrame, int], None], checkpoint: str, task: Task = identity, first: int = FIRST_PORT, count: int = 5) -> list[StreamingQuery]:
    """serve() for `count` sockets from port `first` on; each query stops with .stop()."""
    return [serve(socket_requests(spark, first + i), sink, f"{checkpoint}/{first + i}", task, f"answers-{first + i}") for i in range(count)]


def ask(spark: SparkSession, message: str, task: Task = identity) -> str:
    """The answer to one request."""
    return answers(spark.createDataFrame([(message,)], "value string"), task, REQUEST_BYTES).first()["answer"]


class ServiceLog(StreamingQueryListener):
    """Writes each service's start, batches and end to a logger; add it with spark.streams.addListener()."""

    def __init__(self, logger: logging.Logger | None = None) -> None:
        self.log = logger or logging.getLogger("glyphloom.service")

    def onQueryStarted(self, event) -> None:
        self.log.info("%s started", event.name)

    def onQueryProgress(self, event) -> None:
        self.log.info("%s answered %s requests in batch %s", event.progress.name, event.progress.numInputRows, event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.log.info("%s ended%s", event.id, f": {event.exception}" if event.exception else "")
