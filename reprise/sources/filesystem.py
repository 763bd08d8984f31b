"""Listing folders of audio files, and reading what their tags say, distributed over the paths."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import completeness, format_of, release_type
from ..functions.text import basename
from . import tags

# Extensions of audio files.
EXTENSIONS = ("mp3", "flac", "wav", "m4a", "aac", "ogg", "opus", "wma", "aiff", "aif", "ape", "dsf", "dff", "alac")


def enumerate_files(spark: SparkSession, folders: list[str], exclude: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows (path, size, file_mtime, file_ctime, format) of the audio files below folders; links are not followed.

    The listing is Spark's own distributed one and no content is read. ``exclude`` are glob patterns of any part of a
    path, case ignored. Times are epoch milliseconds; the time of creation is that of the file system where there is one.
    """
    glob = "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper())) + "}"
    rows = None
    for folder in folders:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime")
        rows = found if rows is None else rows.unionByName(found)
    local = F.regexp_replace("path", r"^file:/*", "/")
    out = rows.select(local.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("file_mtime")).dropDuplicates(["path"])
    for pattern in exclude:
        expression = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c not in "/_ " else c for c in pattern)
        out = out.filter(~F.col("path").rlike(f"(?i)(^|/){expression}($|/)"))

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            born = []
            for path in batch.column("path").to_pylist():
                try:
                    stat = os.stat(path)
                    born.append(int(getattr(stat, "st_birthtime", stat.st_ctime) * 1000))
                except OSError:
                    born.append(None)
            yield batch.append_column("file_ctime", pa.array(born, pa.int64()))

    listed = out.mapInArrow(times, "path string, size bigint, file_mtime bigint, file_ctime bigint")
    return listed.withColumn("format", format_of(F.regexp_extract("path", r"\.([^.]*)$", 1)))


_META = pa.schema([("path", pa.string()), ("title", pa.string()), ("artist", pa.string()), ("album", pa.string()), ("genre", pa.string()), ("album_year", pa.int32()), ("track_number", pa.int32()), ("bitrate", pa.int32()), ("sample_rate", pa.int32()), ("bits_per_sample", pa.int32()), ("duration", pa.float64())])


def _metadata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            said = tags.read_tags(path)
            info = tags.stream_info(path)
            first = lambda *names: next((said[n] for n in names if said.get(n)), None)
            year, track = (tags.leading_int(first(*n)) for n in (("YEAR", "DATE", "ORIGINALDATE"), ("TRACKNUMBER", "TRACK")))
            rows.append((path, first("TITLE") or PurePath(path).stem, first("ARTIST", "ALBUMARTIST"), first("ALBUM"), first("GENRE"), year, track, *info))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_META), _META)], schema=_META)


def extract_metadata(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of ``files`` (path, ...) with what their tags and headers say, release type and completeness.

    Work is spread by path; a file that cannot be read gives its name as title and nulls.
    """
    ddl = "path string, title string, artist string, album string, genre string, album_year int, track_number int, bitrate int, sample_rate int, bits_per_sample int, duration double"
    paths = files.select("path")
    said = (paths.repartition(partitions, "path") if partitions else paths).mapInArrow(_metadata, ddl)
    kind = release_type(F.lit(None).cast("string"), F.col("album"))
    filled = completeness(*[F.col(c) for c in ("title", "artist", "album", "album_year", "track_number", "genre")])
    now = int(datetime.now(UTC).timestamp() * 1000)
    rest = files.drop(*[c for c in said.columns if c != "path"])
    return rest.join(said, "path").withColumn("release_type", kind).withColumn("meta_score", filled).withColumn("meta_extracted_at", F.lit(now).cast("bigint"))


def renamed(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files (id, path) whose base name is replaced by that of ``names`` (id, name); folder and extension stay."""
    folder, extension = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.regexp_extract("path", r"(\.[^./]*)?$", 1)
    new = F.concat(folder, F.col("__name"), extension)
    return files.join(names.select("id", F.col("name").alias("__name")), "id", "left").withColumn("path", F.when(F.col("__name") != "", new).otherwise(F.col("path"))).drop("__name")


__all__ = ["basename", "enumerate_files", "extract_metadata", "renamed"]
