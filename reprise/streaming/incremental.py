"""Incremental matching: each micro-batch of files is upserted and only blocks it touches are compared again.

The original has no stream, only work lists by modification time and merges per phase; this is their counterpart
for files that keep arriving. It adds nothing to what a full run computes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import Deltas, last_per_key

#: Batches after which a table is written anew as one.
COMPACT = 32


class IncrementalMatcher:
    """Keeps files and accepted pairs as batches upon a base; ``lane`` gives the accepted pairs (a, b) of files.

    ``block`` names the files a batch can match: it gets the files that arrived and all files, and returns those to
    compare. A batch writes its own files and pairs alone; the tables are written whole once in ``COMPACT`` batches. A
    batch that is delivered again changes nothing: files are replaced by id, pairs by their ends.
    """

    def __init__(self, root: str, lane: Callable[[DataFrame], DataFrame], block: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        self.root, self.lane, self.block = root, lane, block

    def files(self, spark: SparkSession) -> DataFrame | None:
        """The files as they are now, with the ``batch`` they came in."""
        rows = Deltas(spark, f"{self.root}/files").read()
        return None if rows is None else last_per_key(rows, ["id"], F.col("batch").desc())

    def pairs(self, spark: SparkSession) -> DataFrame | None:
        """The accepted pairs: those judged since both their files last came, with their ``batch``."""
        rows, files = Deltas(spark, f"{self.root}/pairs").read(), self.files(spark)
        if rows is None:
            return None
        last = rows.groupBy("a", "b").agg(F.max("batch").alias("batch"))
        since = lambda end: files.select(F.col("id").alias(end), F.col("batch").alias(f"batch_{end}"))
        return last.join(since("a"), "a").join(since("b"), "b").filter("batch >= batch_a AND batch >= batch_b").select("a", "b", "batch")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files, pairs = Deltas(spark, f"{self.root}/files"), Deltas(spark, f"{self.root}/pairs")
        files.write(last_per_key(batch, ["id"], F.col("scan_time").desc_nulls_last()), number)
        arrived = spark.read.parquet(f"{files.root}/batches/{number}").drop("batch")
        touched = arrived.select("id")
        found = self.lane(self.block(arrived, self.files(spark).drop("batch"))).select("a", "b")
        ends = lambda end: found.join(touched.withColumnRenamed("id", end), end, "left_semi").select("a", "b")
        pairs.write(ends("a").unionByName(ends("b")).distinct(), number)
        if len(files.batches()) >= COMPACT:
            now = self.pairs(spark)
            pairs.compact(now)
            files.compact(self.files(spark))

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Runs on a streaming table of files; ``trigger`` as for ``DataStreamWriter.trigger``."""
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
