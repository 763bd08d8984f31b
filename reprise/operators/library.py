"""Relations over the library: tables, filters, searches, listings, statistics, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quality import tier_rank
from ..functions.text import search_key
from .storage import last_per_key

# The columns by which the library may be sorted.
SORTABLE = ("title", "artist", "album", "album_year", "bitrate", "duration", "size")


class Library:
    """The tables of one input folder; repeated deliveries count once (files, groups, members, overrides, enrichment)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
        self.spark, self.read = spark, read

    def files(self, *columns: str, where: str | None = None) -> DataFrame:
        """Files by id; only the given columns are read. A repeated delivery is an unchanged row, so ``where`` may filter
        at the scan, before repeats are removed."""
        rows = self.read("files").filter(where) if where else self.read("files")
        return rows.select("id", *[c for c in columns if c != "id"]).dropDuplicates(["id"]) if columns else rows.dropDuplicates(["id"])

    def live_files(self, *columns: str) -> DataFrame:
        """Files that are not deleted, filtered at the scan."""
        return self.files(*columns, where="NOT deleted")

    def ids(self) -> DataFrame:
        """The ids of all files."""
        return self.read("files").select("id").distinct()

    def groups(self) -> DataFrame:
        return self.read("dup_groups").dropDuplicates(["group_id"])

    def members(self) -> DataFrame:
        """Members of known groups, without null ids, each once."""
        rows = self.read("group_tracks").filter("file_id IS NOT NULL").distinct()
        return rows.join(self.read("dup_groups").select("group_id").distinct(), "group_id", "left_semi")

    def overrides(self) -> DataFrame:
        return self.read("retention_list").dropDuplicates(["file_id"])

    def enrichment(self) -> DataFrame:
        """Per file and source the last scrape."""
        return last_per_key(self.read("scraped_meta"), ["file_id", "source"], F.col("scraped_at").desc_nulls_last())

    def catalogue(self) -> DataFrame:
        return self.read("catalogue").dropDuplicates(["rec_id"])


def live(files: DataFrame) -> DataFrame:
    """Files that are not deleted."""
    return files.filter(~F.col("deleted"))


def by_format(files: DataFrame, fmt: str) -> DataFrame:
    """Files of a format, whatever the case of the argument."""
    return files.filter(F.col("format") == fmt.upper())


def scraped(files: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Files for which a source knows a title."""
    return files.join(enrichment.filter("title <> ''").select(F.col("file_id").alias("id")), "id", "left_semi")


def in_group(files: DataFrame, members: DataFrame) -> DataFrame:
    """Files that are members of a group."""
    return files.join(members.select(F.col("file_id").alias("id")), "id", "left_semi")


def search(rows: DataFrame, text: str, columns: tuple[str, ...] = ("title", "artist", "album")) -> DataFrame:
    """Rows of which a column holds the text, but for accents, case and punctuation; an empty text holds everywhere."""
    wanted = search_key(F.lit(text))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(search_key(F.col(c)), wanted)
    return rows.filter((wanted == "") | hit)


def resolved(groups: DataFrame, flag: bool | None = None) -> DataFrame:
    """Resolved groups, unresolved ones, or all."""
    return groups if flag is None else groups.filter(F.coalesce("resolved", F.lit(False)) == flag)


def first_groups(ids: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """P10: for each id (column ``id``) its first group, unresolved before resolved, then by id; null without one."""
    rows = members.join(groups.select("group_id", F.coalesce("resolved", F.lit(False)).alias("resolved")), "group_id")
    first = rows.groupBy(F.col("file_id").alias("id")).agg(F.min(F.struct("resolved", "group_id")).alias("s"))
    return ids.join(first, "id", "left").select("id", F.col("s.group_id").alias("group_id"))


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key."""
    return rows.filter(F.col(key) == value)


def by_album(files: DataFrame, album: str) -> DataFrame:
    """Files of an album, whatever the case of ASCII letters."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return files.filter(fold(F.col("album")) == fold(F.lit(album)))


def with_override(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Files with ``in_retention_list``: whether an override keeps them."""
    rows = files.join(overrides.select(F.col("file_id").alias("id"), F.col("keep").alias("__keep")), "id", "left")
    return rows.withColumn("in_retention_list", F.coalesce("__keep", F.lit(False))).drop("__keep")


def needs_metadata(files: DataFrame, smart: bool = True) -> DataFrame:
    """Live files whose tags were never read, or were before the file changed."""
    return live(files).filter("meta_extracted_at IS NULL OR meta_extracted_at < file_mtime") if smart else live(files)


def needs_fingerprint(files: DataFrame, smart: bool = True) -> DataFrame:
    """Live files without a fingerprint, or with one older than the file."""
    return live(files).filter("fingerprint IS NULL OR fp_extracted_at IS NULL OR fp_extracted_at < file_mtime") if smart else live(files)


def needs_second_fingerprint(files: DataFrame, limit: int | None = 10_000) -> DataFrame:
    """Live files with a fingerprint but without the second one, and not on the first work list; ``limit`` is a batch's."""
    rows = live(files).filter("fingerprint IS NOT NULL AND (chromaprint IS NULL OR chromaprint_raw IS NULL)").filter("NOT (fp_extracted_at IS NULL OR coalesce(fp_extracted_at < file_mtime, false))")
    return rows.orderBy("id").limit(limit) if limit else rows


def needs_enrichment(files: DataFrame, enrichment: DataFrame, source: str, mode: str = "incremental") -> DataFrame:
    """Files a source should be asked for: 'force' all with a title (or second fingerprint), 'incremental' those
    never asked, 'retry' those asked without success, told by a missing row."""
    able = "title <> ''" if source == "musicbrainz" else "chromaprint IS NOT NULL"
    asked = "mb_checked_at" if source == "musicbrainz" else "acoustid_checked_at"
    rows = live(files).filter(able)
    if mode == "incremental":
        rows = rows.filter(f"{asked} IS NULL")
    if mode == "retry":
        rows = rows.join(enrichment.filter(F.col("source") == source).select(F.col("file_id").alias("id")), "id", "left_anti")
    return rows


def work_counts(files: DataFrame) -> DataFrame:
    """A5: how many live files each step of a run would work on, in one pass: rows (step, n)."""
    steps = {
        "metadata": "meta_extracted_at IS NULL OR meta_extracted_at < file_mtime", "fingerprint": "fingerprint IS NULL OR fp_extracted_at IS NULL OR fp_extracted_at < file_mtime",
        "second_fingerprint": "fingerprint IS NOT NULL AND (chromaprint IS NULL OR chromaprint_raw IS NULL)", "attribute_match": "title <> ''",
        "text_enrichment": "title <> '' AND mb_checked_at IS NULL", "fingerprint_enrichment": "chromaprint IS NOT NULL AND acoustid_checked_at IS NULL",
    }
    counted = live(files).agg(*[F.count_if(F.expr(e)).alias(n) for n, e in steps.items()])
    return counted.unpivot([], list(steps), "step", "n")


def order_by(column: str, descending: bool = False, fold: bool = False) -> list[Column]:
    """O1–O3: nulls last in either direction; ``fold`` ignores case; the id settles ties."""
    if column not in SORTABLE:
        raise ValueError(f"cannot sort by {column}")
    c = F.lower(column) if fold and column in ("title", "artist", "album") else F.col(column)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("id")]


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 100) -> DataFrame:
    """A page of an ordered listing, counted from 1."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def query(files: DataFrame, *, text: str = "", fmt: str = "", tier: str = "", order: list[Column] | None = None) -> DataFrame:
    """The library listing as one plan: format, search and tier filters, then the order. ``tier`` 'none' is a null tier; needs a column ``tier``."""
    rows = live(files)
    rows = by_format(rows, fmt) if fmt else rows
    rows = search(rows, text) if text else rows
    if tier:
        rows = rows.filter(F.col("tier").isNull()) if tier == "none" else rows.filter(F.col("tier") == tier)
    return rows.orderBy(*order) if order else rows


def by_tier(rows: DataFrame) -> list[Column]:
    """O3: green first, no tier last."""
    return [tier_rank(F.col("tier")), F.col("id")]


def position(files: DataFrame, file_id: int, column: str = "title", descending: bool = False) -> DataFrame:
    """The place, from 0, of a live file in an order, -1 where it is not live; counted, never sorted in one task."""
    rows = live(files).select("id", F.col(column).alias("v"))
    own = rows.filter(F.col("id") == file_id).select(F.col("v").alias("x")).limit(1)
    before = F.col("v") > F.col("x") if descending else F.col("v") < F.col("x")
    earlier = before | (F.col("v").eqNullSafe(F.col("x")) & (F.col("id") < file_id)) | (F.col("v").isNotNull() & F.col("x").isNull())
    counted = rows.crossJoin(F.broadcast(own)).agg(F.count_if(earlier).alias("n"), F.count(F.lit(1)).alias("rows"))  # one row on the right
    return counted.select(F.lit(file_id).cast("bigint").alias("id"), F.when(F.col("rows") > 0, F.col("n")).otherwise(-1).alias("position"))


def statistics(files: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """A1: counts over live files, and over groups and their members."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    own = live(files).agg(
        F.count(F.lit(1)).alias("n_files"), F.countDistinct(filled("album")).alias("n_albums"), F.countDistinct(filled("artist")).alias("n_artists"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count("meta_extracted_at").alias("n_with_meta"), F.count("fingerprint").alias("n_with_fp"),
    )
    spare = members.join(groups.select("group_id", "smart_keep_id"), "group_id").filter("file_id <> smart_keep_id").join(files.select(F.col("id").alias("file_id"), "size"), "file_id")
    dup = spare.agg(F.count(F.lit(1)).alias("n_dup_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("dup_bytes"))
    pending = groups.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(~F.coalesce("resolved", F.lit(False))).alias("n_pending"))
    return own.crossJoin(dup).crossJoin(pending)  # three single rows


def histogram(rows: DataFrame, column: str, name: str = "n", top: int | None = None, keep_null: bool = False) -> DataFrame:
    """A2: counts by value, most first, then by value; ``top`` is the length of the report."""
    counted = (rows if keep_null else rows.filter(F.col(column).isNotNull())).groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.col(column).asc_nulls_last())
    return counted.limit(top) if top else counted


def top_member(members: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    """Per group the columns of its member of the highest bitrate, the least id on a tie."""
    rows = members.join(files.select(F.col("id").alias("file_id"), F.coalesce("bitrate", F.lit(0)).alias("__rate"), *columns), "file_id")
    best = rows.groupBy("group_id").agg(F.max(F.struct("__rate", (-F.col("file_id")).alias("less"), *columns)).alias("s"))
    return best.select("group_id", (-F.col("s.less")).alias("file_id"), *[f"s.{c}" for c in columns])


def spare_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members other than the one to keep; groups without a choice give none, as nothing differs from null."""
    return members.join(groups.select("group_id", "smart_keep_id"), "group_id").filter("file_id <> smart_keep_id")


def coalesced(rows: DataFrame) -> DataFrame:
    """Of both sources' seven fields the second source's first, and which source there is."""
    names = ("title", "artist", "album", "album_year", "track_number", "genre", "duration")
    source = F.when(F.col("aid_title").isNotNull(), "acoustid").when(F.col("mb_title").isNotNull(), "musicbrainz")
    return rows.select("id", *[F.coalesce(f"aid_{n}", f"mb_{n}").alias(f"scrape_{n}") for n in names], source.alias("scrape_source"))
