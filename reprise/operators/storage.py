"""Cutting lineage through tables in the shared folder, and versioned tables with atomic swaps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application within the one all executors share (``spark.checkpoint.dir``). ``clear`` removes it.

    Where that is unset, a folder of our own serves a session in one process; on a cluster, whose executors could not
    read each other's folders, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reprise-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found}/reprise-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables this application wrote to the shared folder; results not yet stored elsewhere are lost."""
    remove(spark, shared_dir(spark))


class Table:
    """A table written to the shared folder, so that its lineage ends there and lost executors cost nothing.

    ``df`` reads it; ``seen`` holds the values of the aggregate columns observed during the write; ``drop``
    removes the files once nothing reads them any more.
    """

    def __init__(self, df: DataFrame, *observed) -> None:
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
        watch = Observation() if observed else None
        (df.observe(watch, *observed) if watch else df).write.parquet(self.path)
        self.seen = watch.get if watch else {}
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.df.sparkSession, self.path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Table(df).df


class Versions:
    """A table kept as numbered Parquet folders; readers see the last complete version, writers add the next.

    A version counts once its ``_SUCCESS`` file is there, so a failed writer leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def read(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{number if number is not None else self.numbers()[-1]}")

    def write(self, df: DataFrame) -> int:
        """Writes the next version and makes it current."""
        number = (self.numbers() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v{number}")
        return number

    def probe(self, path: str) -> DataFrame:
        """The table in a folder of Parquet files, each of which must begin and end with the format's mark."""
        listed = [s for s in self._fs.listStatus(self._path(path)) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        files = self.spark.read.format("binaryFile").load([str(s.getPath()) for s in listed]) if listed else None
        good = files.select(F.length("content").alias("n"), F.expr("substring(content, 1, 4) = X'50415231' AND substring(content, -4, 4) = X'50415231'").alias("ok")) if listed else None
        if not listed or good.filter("NOT ok OR n < 12").limit(1).count():
            raise ValueError(f"{path} is no table to take over")
        return self.spark.read.parquet(path)

    def copy_from(self, source: DataFrame) -> int:
        """Takes over a whole table into an empty store; the copy is checked by its number of rows."""
        if self.numbers():
            raise FileExistsError(self.root)
        number = self.write(source)
        if self.read().count() != source.count():
            self._fs.delete(self._path(f"{self.root}/v{number}"), True)
            raise OSError("the copy is incomplete")
        return number

    def prune(self, keep: int = 2) -> None:
        for number in self.numbers()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/v{number}"), True)


class Deltas:
    """A table as a base and the batches since: a batch costs what it holds, not what the table holds.

    Rows have a ``batch`` column. A batch written again under its number replaces itself. ``compact`` writes a new base
    and drops the batches in it; a failure in between leaves rows twice, which readers settle by key and batch.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.base = spark, root, Versions(spark, f"{root}/base")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def batches(self) -> list[int]:
        fs, at = self.base._fs, f"{self.root}/batches"
        names = [s.getPath().getName() for s in fs.listStatus(self._path(at))] if fs.exists(self._path(at)) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._path(f"{at}/{n}/_SUCCESS")))

    def write(self, rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{self.root}/batches/{number}")

    def read(self) -> DataFrame | None:
        """All rows of the base and of the batches, None where there are none yet."""
        paths = [f"{self.root}/batches/{n}" for n in self.batches()]
        parts = ([self.base.read()] if self.base.numbers() else []) + ([self.spark.read.parquet(*paths)] if paths else [])
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None

    def compact(self, rows: DataFrame) -> None:
        """``rows`` (with their ``batch``) are the table: they become its base."""
        done = self.batches()
        self.base.write(rows)
        for n in done:
            remove(self.spark, f"{self.root}/batches/{n}")
        self.base.prune(1)


def last_per_key(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """Of each key the row that comes first in ``order``; further columns settle ties."""
    from pyspark.sql import Window

    rest = [F.col(f"`{c}`").desc_nulls_last() for c, kind in rows.dtypes if c not in keys and not kind.startswith(("map", "array"))]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def upsert(old: DataFrame, new: DataFrame, key: str, **fixed) -> DataFrame:
    """Rows of ``new`` replace the non-null values of rows of ``old`` with their key, others are added; ``fixed`` columns are set on both."""
    names = old.columns
    given = new.select(key, *[F.col(c).alias(f"__{c}") for c in new.columns if c != key]).withColumn("__new", F.lit(True))
    both = old.join(given, key, "full_outer")
    value = lambda c: F.when(F.col("__new"), F.lit(fixed[c])).otherwise(F.col(c)) if c in fixed else F.coalesce(F.col(f"__{c}"), F.col(c)) if f"__{c}" in given.columns else F.col(c)
    return both.select(*[F.col(key) if c == key else value(c).cast(old.schema[c].dataType).alias(c) for c in names])


def soft_delete(files: DataFrame, ids: DataFrame, deleted: bool = True) -> DataFrame:
    """Sets the flag of the given ids."""
    marked = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return files.join(marked, "id", "left").withColumn("deleted", F.when(F.col("__hit"), F.lit(deleted)).otherwise(F.col("deleted"))).drop("__hit")


def cascade_delete(tables: dict[str, DataFrame], seen_paths: DataFrame) -> dict[str, DataFrame]:
    """Removes live files whose path was not seen, and all that refers to them; their ``smart_keep_id`` becomes null."""
    files = tables["files"]
    gone = files.filter("NOT deleted").join(seen_paths.select("path").distinct(), "path", "left_anti").select(F.col("id").alias("file_id")).distinct()
    out = {"files": files.join(gone.withColumnRenamed("file_id", "id"), "id", "left_anti")}
    for name, rows in tables.items():
        if name != "files" and "file_id" in rows.columns:
            out[name] = rows.join(gone, "file_id", "left_anti")
    if "dup_groups" in tables:
        lost = gone.select(F.col("file_id").alias("smart_keep_id"), F.lit(True).alias("__lost"))
        out["dup_groups"] = tables["dup_groups"].join(lost, "smart_keep_id", "left").withColumn("smart_keep_id", F.when(F.col("__lost").isNull(), F.col("smart_keep_id"))).drop("__lost").select(tables["dup_groups"].columns)
    return out


def write_fields(files: DataFrame, history: DataFrame, edits: DataFrame, fields: list[str], now: int, keep_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Non-empty edits overwrite fields; the history keeps the first originals, counts writes and unites the fields changed.

    ``history`` and the result have file_id, original_tags, current_tags (maps), modified_fields, write_count,
    first_written_at, last_written_at, expires_at.
    """
    filled = lambda c, kind: F.when(F.col(c) > 0, F.col(c)) if kind in ("int", "bigint") else F.when(F.col(c) != "", F.col(c))
    kinds = dict(files.dtypes)
    new = edits.select(F.col("file_id").alias("id"), *[filled(f, kinds[f]).alias(f"__{f}") for f in fields])
    joined = files.join(new, "id", "left")
    written = joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in files.columns])
    as_map = lambda prefix: F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.coalesce(F.col(f"{prefix}{f}").cast("string"), F.lit("")) for f in fields]))
    changed = F.filter(F.array(*[F.when(F.col(f"__{f}").isNotNull() & ~F.col(f"__{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    now_map = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.coalesce(F.col(f"__{f}").cast("string"), F.col(f).cast("string"), F.lit("")) for f in fields]))
    hit = files.join(new, "id").select(F.col("id").alias("file_id"), as_map("").alias("o"), now_map.alias("c"), changed.alias("m")).filter(F.size("m") > 0)
    both = history.join(hit, "file_id", "full_outer")
    fresh = F.col("c").isNotNull()
    kept = both.select(
        "file_id", F.coalesce("original_tags", "o").alias("original_tags"), F.coalesce("c", "current_tags").alias("current_tags"),
        F.array_sort(F.array_union(F.coalesce("modified_fields", F.array().cast("array<string>")), F.coalesce("m", F.array().cast("array<string>")))).alias("modified_fields"),
        (F.coalesce("write_count", F.lit(0)) + fresh.cast("int")).cast("int").alias("write_count"),
        F.coalesce("first_written_at", F.lit(now)).alias("first_written_at"), F.when(fresh, now).otherwise(F.col("last_written_at")).alias("last_written_at"),
        F.when(fresh, now + keep_days * 86_400_000).otherwise(F.col("expires_at")).alias("expires_at"),
    )
    return written, kept


HISTORY = "file_id bigint, original_tags map<string,string>, current_tags map<string,string>, modified_fields array<string>, write_count int, first_written_at bigint, last_written_at bigint, expires_at bigint"


def revert(files: DataFrame, history: DataFrame, ids: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The originals come back, and their history goes."""
    back = history.join(ids.select("file_id").distinct(), "file_id", "left_semi").select(F.col("file_id").alias("id"), F.col("original_tags").alias("__o"))
    value = lambda f: F.when(F.col("__o").isNull(), F.col(f)).otherwise(F.nullif(F.col("__o")[f], F.lit("")).cast(files.schema[f].dataType))
    return files.join(back, "id", "left").select(*[value(c).alias(c) if c in fields else F.col(c) for c in files.columns]), history.join(ids.select("file_id"), "file_id", "left_anti")


def purge_expired(history: DataFrame, now: int) -> DataFrame:
    """U8: history that has not expired."""
    return history.filter((F.col("expires_at") > now) | F.col("expires_at").isNull())


def purge_trash(files: DataFrame, members: DataFrame, groups: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files marked deleted in the given groups go, unless another group holds them; groups of fewer than two go too."""
    chosen = members.join(resolved.select("group_id").distinct(), "group_id", "left_semi")
    doomed = chosen.join(files.filter("deleted").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    elsewhere = members.join(resolved.select("group_id").distinct(), "group_id", "left_anti").select("file_id").distinct()
    gone = doomed.select("file_id").distinct().join(elsewhere, "file_id", "left_anti")
    left = members.join(doomed, ["group_id", "file_id"], "left_anti")
    alive = left.groupBy("group_id").count().filter("count >= 2").select("group_id")
    return files.join(gone.withColumnRenamed("file_id", "id"), "id", "left_anti"), left.join(alive, "group_id", "left_semi"), groups.join(alive, "group_id", "left_semi")


def resolve(files: DataFrame, members: DataFrame, groups: DataFrame, kept: DataFrame, chosen: DataFrame | None = None, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pending groups (of ``chosen``, or all) are resolved and their members that are not kept marked deleted.

    ``kept`` has (group_id, file_id). A group all of whose members are kept has nothing to resolve and stays as it is.
    Returns files and groups.
    """
    pending = groups.filter(~F.coalesce("resolved", F.lit(False))).select("group_id")
    if chosen is not None:
        pending = pending.join(chosen.select("group_id").distinct(), "group_id", "left_semi")
    spare = members.join(pending, "group_id", "left_semi").join(kept.select("group_id", "file_id"), ["group_id", "file_id"], "left_anti")
    done = spare.select("group_id").distinct().withColumn("__done", F.lit(True))
    after = groups.join(done, "group_id", "left").withColumns({"resolved": F.coalesce("__done", "resolved"), "resolved_time": F.when(F.col("__done"), F.lit(now)).otherwise(F.col("resolved_time"))}).select(groups.columns)
    return soft_delete(files, spare.select(F.col("file_id").alias("id"))), after


def unresolve(files: DataFrame, members: DataFrame, groups: DataFrame, kept: DataFrame, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Resolved groups (of ``chosen``, or all) are pending again, and their members that are not kept live again."""
    back = groups.filter(F.coalesce("resolved", F.lit(False))).select("group_id")
    if chosen is not None:
        back = back.join(chosen.select("group_id").distinct(), "group_id", "left_semi")
    spare = members.join(back, "group_id", "left_semi").join(kept.select("group_id", "file_id"), ["group_id", "file_id"], "left_anti")
    marked = groups.join(back.withColumn("__back", F.lit(True)), "group_id", "left")
    after = marked.withColumns({"resolved": F.when(F.col("__back"), False).otherwise(F.col("resolved")), "resolved_time": F.when(F.col("__back").isNull(), F.col("resolved_time"))}).select(groups.columns)
    return soft_delete(files, spare.select(F.col("file_id").alias("id")), False), after


def listed_history(history: DataFrame, files: DataFrame) -> DataFrame:
    """The history with the present title, artist and album of its files (null for files that are gone), the last write first."""
    now = files.select(F.col("id").alias("file_id"), F.col("title").alias("cur_title"), F.col("artist").alias("cur_artist"), F.col("album").alias("cur_album"))
    return history.join(now, "file_id", "left").orderBy(F.desc_nulls_last("last_written_at"), "file_id")


def listed_snapshots(snapshots: DataFrame, files: DataFrame, file_id: int | None = None, limit: int = 100) -> DataFrame:
    """Snapshots of one file, or the last ``limit`` written ones of all files, with path, title and artist, newest first."""
    own = snapshots.filter(F.col("file_id") == file_id) if file_id is not None else snapshots.filter("status = 'written'")
    rows = own.join(files.select(F.col("id").alias("file_id"), "path", "title", "artist"), "file_id").orderBy(F.desc_nulls_last("snapshot_time"), "file_id")
    return rows if file_id is not None else rows.limit(limit)


def merge_snapshot(main: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the snapshot replace those of the main table with their keys; others of the main table stay."""
    return main.join(snapshot.select(*keys).distinct(), keys, "left_anti").unionByName(snapshot, allowMissingColumns=True)


def override(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (file_id, keep, reason, added_time) replace overrides; a null ``keep`` removes one."""
    return merge_snapshot(overrides, changes, ["file_id"]).filter("keep IS NOT NULL")
