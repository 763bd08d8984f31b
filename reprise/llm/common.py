"""Helpers shared by the operators of this subpackage: reading, cutting lineage, shipping numpy code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import Table as Stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: the cluster's own measure of its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def latest(spark: SparkSession, sf_dir: str, name: str, key: str, at: str, *columns: str) -> DataFrame:
    """The given columns of the last delivery of each key; ties go to the larger values. Null keys stay out.

    Only keys that occur again are shuffled with their columns; the others stay where they were read. Where the scan
    has fewer parts than the session has shuffle partitions, rows are spread, as Python is to work on them.
    """
    rows = table(spark, sf_dir, name).filter(F.col(key).isNotNull())
    again = Stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)).df
    last = rows.join(again, key, "left_semi").groupBy(key).agg(F.max(F.struct(F.col(at), *[F.col(c) for c in columns])).alias("s")).select(key, *[f"s.{c}" for c in columns])
    out = rows.join(again, key, "left_anti").select(key, *columns).unionByName(last)
    return out.repartition(partitions(spark)) if rows.rdd.getNumPartitions() < partitions(spark) else out
