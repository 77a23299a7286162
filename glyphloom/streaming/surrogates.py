"""Emoji's numbers, kept from batch to batch and from corpus to corpus: a table with a version for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glyphloom.functions import text as T
from glyphloom.operators import features
from glyphloom.storage import _path


class SurrogateTable:
    """emoji, surrogate in a folder; a batch's version holds all that came up to it. A batch that comes again is numbered on the version before it, so its numbers are the same."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        at, store = _path(self.spark, f"{self.folder}/version=*/_SUCCESS")
        return sorted(int(str(x.getPath().getParent().getName()).split("=")[1]) for x in store.globStatus(at) or [])

    def read(self, before: int | None = None) -> DataFrame:
        """The last version, or the last one before a batch; there are as many emoji as Unicode has at most."""
        found = [v for v in self.versions() if before is None or v < before]
        schema = "emoji string, surrogate string"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/version={found[-1]}") if found else self.spark.createDataFrame([], schema)

    def absorb(self, tok: DataFrame, version: int | None = None) -> DataFrame:
        """The table with the emoji of tok (doc_id, pos, token), written as the next version, or as `version`."""
        number = (max(self.versions(), default=-1) + 1) if version is None else version
        features.more_surrogates(self.read(number), tok.where(T.is_emoji(tok["token"]))).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/version={number}")
        return self.read(number + 1)


def numbered(tok: DataFrame, table: SurrogateTable, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A stream of tokens (doc_id, pos, token) with surrogates for its emoji; sink gets each batch and its number, by which it can drop one that comes again."""

    def one(batch: DataFrame, number: int) -> None:
        sink(features.with_surrogates(batch, table.absorb(batch, number)), number)

    return tok.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
