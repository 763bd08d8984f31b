"""Groups of duplicates: construction, description, tags, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions.text import basename, normalize, round_half_up
from .graph import connected_components
from .storage import cut

# Tags that say how a group was found, those of fingerprints among them, and pairs that exclude one another.
METHOD_TAGS = ("meta_confirmed", "spectral_exact", "same_recording", "cp_exact", "cp_similar", "mb_confirmed", "acoustid_confirmed")
FINGERPRINT_TAGS = ("spectral_exact", "same_recording", "cp_exact", "cp_similar")
EXCLUSIVE_TAGS = (("format_same", "format_diff"), ("metadata_same", "metadata_diff"), ("duration_same", "duration_diff"), ("spectral_exact", "same_recording"), ("cp_exact", "cp_similar"))
# The order in which facets are listed.
TAG_ORDER = (*METHOD_TAGS, "fp_diff", "format_diff", "format_same", "filename_same", "metadata_same", "metadata_diff", "duration_same", "duration_diff", "release_year_diff", "release_type_diff", "meta_score_diff", "retention_tie")


def build(files: DataFrame, accepted: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows (group_id, file_id) of the components of accepted pairs (a, b) and of earlier groups' edges; the id is the least member's."""
    edges = accepted.select("a", "b") if existing is None else accepted.select("a", "b").unionByName(existing.select("a", "b"))
    found = connected_components(edges)
    return found.join(files.select("id"), "id", "left_semi").select(F.col("component").alias("group_id"), F.col("id").alias("file_id"))


def evidence(members: DataFrame, pairs: DataFrame, flags: list[str] = []) -> DataFrame:  # noqa: B006
    """Per group the best similarity of all its compared pairs, and whether any accepted pair carries each flag."""
    a = members.select(F.col("file_id").alias("a"), F.col("group_id").alias("ga"))
    b = members.select(F.col("file_id").alias("b"), F.col("group_id").alias("gb"))
    inside = pairs.join(a, "a").join(b, "b").filter("ga = gb")
    return inside.groupBy(F.col("ga").alias("group_id")).agg(F.max("sim").alias("max_sim"), *[F.bool_or(f).alias(f) for f in flags])


def percent(sim: Column) -> Column:
    """A similarity as whole percent, 0 for none."""
    return F.least(F.lit(100), F.coalesce(round_half_up(sim * 100), F.lit(0))).cast("int")


def representative(members: DataFrame, files: DataFrame) -> DataFrame:
    """Per group the file of the highest bitrate (the least id on a tie), its members, and the bytes of the others."""
    rows = members.join(files.select(F.col("id").alias("file_id"), F.coalesce("bitrate", F.lit(0)).alias("bitrate"), F.coalesce("size", F.lit(0)).alias("size")), "file_id")
    best = F.max(F.struct("bitrate", (-F.col("file_id")).alias("less"), "size")).alias("best")
    return rows.groupBy("group_id").agg(best, F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total")).select("group_id", (-F.col("best.less")).alias("keep_id"), "n_files", (F.col("total") - F.col("best.size")).alias("reclaimable"))


def equal_groups(files: DataFrame, key: Column) -> DataFrame:
    """J12, C5, C7 of equal keys alone: such groups are disjoint, so one aggregation by the key's digest forms and describes them."""
    rows = files.select(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2"), "id", F.coalesce("bitrate", F.lit(0)).alias("bitrate"), F.coalesce("size", F.lit(0)).alias("size"))
    best = F.max(F.struct("bitrate", (-F.col("id")).alias("less"), "size")).alias("best")
    found = rows.groupBy("k1", "k2").agg(F.min("id").alias("group_id"), best, F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total")).filter("n_files > 1")
    return found.select("group_id", (-F.col("best.less")).alias("keep_id"), "n_files", (F.col("total") - F.col("best.size")).alias("reclaimable"))


def confirmed_by_one_recording(members: DataFrame, enrichment: DataFrame, source: str = "musicbrainz") -> DataFrame:
    """C4: groups in which two or more members have a recording id and all have the same."""
    ids = enrichment.filter((F.col("source") == source) & (F.col("mb_recording_id") != "")).select("file_id", "mb_recording_id")
    counted = members.join(ids, "file_id").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("mb_recording_id").alias("lo"), F.max("mb_recording_id").alias("hi"))
    return counted.filter("n >= 2 AND lo = hi").select("group_id")


def described(members: DataFrame, files: DataFrame) -> DataFrame:
    """Members with what types and tags compare: a projection once, so the aggregates below read plain columns."""
    cols = files.select(
        F.col("id").alias("file_id"), F.coalesce("format", F.lit("")).alias("raw_format"), F.upper(F.coalesce("format", F.lit(""))).alias("format"), "path",
        normalize(F.col("title")).alias("title_key"), normalize(F.col("artist")).alias("artist_key"), normalize(F.col("album")).alias("album_key"),
        q.release_type(F.col("release_type"), F.col("album")).alias("kind"), F.when(F.col("album_year") > 0, F.col("album_year")).alias("year"),
        q.completeness(F.col("title"), F.col("artist"), F.col("album"), F.col("album_year"), F.col("track_number"), F.col("genre")).alias("filled"),
        F.when(round_half_up(F.col("duration")) > 0, round_half_up(F.col("duration"))).alias("seconds"), F.xxhash64("fingerprint").alias("fp"), F.col("fingerprint").isNotNull().alias("has_fp"),
    )
    name = F.trim(F.regexp_replace(F.lower(basename(F.col("path"))), r"\s+", " "))
    return members.join(cols, "file_id").withColumn("file_name", name)


def _same(name: str) -> Column:
    return F.min(name) == F.max(name)


def types(rows: DataFrame) -> DataFrame:
    """Per group whether its members differ by format, are single and album, or differ by name (``described`` rows)."""
    agg = rows.groupBy("group_id").agg(
        (~_same("raw_format")).alias("formats"), (_same("title_key") & (F.min("title_key") != "")).alias("title"), (_same("artist_key") & (F.min("artist_key") != "")).alias("artist"),
        F.bool_or(F.col("kind") == "single").alias("single"), F.bool_or(F.col("kind") == "album").alias("album"),
    )
    kind = F.when(F.col("formats") & F.col("title") & F.col("artist"), "format_diff").when(F.col("single") & F.col("album"), "single_vs_album").when(F.col("title"), "format_diff").otherwise("name_diff")
    return agg.select("group_id", kind.alias("type"))


def tags(rows: DataFrame, found: DataFrame | None = None, second_exact: float = 0.98) -> DataFrame:
    """The tags of each group of ``described`` rows. ``found`` adds how it was found: group_id and the booleans
    spectral_confirmed, meta_confirmed, mb_confirmed, acoustid_confirmed, cp_confirmed, and max_cp_sim."""
    meta = F.concat_ws("\x00", "title_key", "artist_key", "album_key")
    rows = rows.withColumn("meta", meta)
    agg = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), _same("format").alias("one_format"), (_same("file_name") & (F.min("file_name") != "")).alias("one_name"),
        _same("meta").alias("one_meta"), (F.max("meta") == "\x00\x00").alias("no_meta"), (F.min("year") < F.max("year")).alias("years"), (~_same("kind")).alias("kinds"), (~_same("filled")).alias("fills"),
        F.count("seconds").alias("n_seconds"), _same("seconds").alias("one_length"), (F.count_if("has_fp") >= 2).alias("fps"), (F.min(F.when(F.col("has_fp"), F.col("fp"))) == F.max(F.when(F.col("has_fp"), F.col("fp")))).alias("one_fp"),
    )
    names = ("spectral_confirmed", "meta_confirmed", "mb_confirmed", "acoustid_confirmed", "cp_confirmed")
    if found is not None:
        agg = agg.join(found, "group_id", "left")
    flag = lambda n: F.coalesce(F.col(n), F.lit(False)) if found is not None and n in found.columns else F.lit(False)
    cp = F.coalesce(F.col("max_cp_sim") >= second_exact, F.lit(False)) if found is not None and "max_cp_sim" in found.columns else F.lit(False)
    exact, two = F.coalesce(F.col("fps") & F.col("one_fp"), F.lit(False)), F.col("n") >= 2
    chosen = {
        "spectral_exact": exact, "same_recording": ~exact & flag(names[0]), "cp_exact": cp, "cp_similar": ~cp & flag(names[4]),
        "meta_confirmed": flag(names[1]), "acoustid_confirmed": flag(names[3]), "mb_confirmed": flag(names[2]),
        "format_diff": ~F.col("one_format"), "format_same": F.col("one_format") & two, "filename_same": two & F.col("one_name"),
        "metadata_same": two & ~F.col("no_meta") & F.col("one_meta"), "metadata_diff": two & ~F.col("no_meta") & ~F.col("one_meta"),
        "release_year_diff": F.coalesce(F.col("years"), F.lit(False)), "release_type_diff": F.col("kinds"), "meta_score_diff": F.col("fills"),
        "duration_same": (F.col("n_seconds") >= 2) & F.col("one_length"), "duration_diff": (F.col("n_seconds") >= 2) & ~F.col("one_length"),
    }
    return agg.select("group_id", F.array_compact(F.array(*[F.when(c, t) for t, c in chosen.items()])).alias("group_tags"))


def with_fp_diff(tags: Column) -> Column:
    """``fp_diff`` added where no fingerprint tag is; null stays null."""
    return F.when(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in FINGERPRINT_TAGS])), tags).when(tags.isNotNull(), F.array_append(tags, F.lit("fp_diff")))


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """Method tags of an earlier group join those of a new group with the very same members. Both: (group_id, file_id, group_tags)."""

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        # Order-free keys of the member sets: counts and two sums of hashes, never the lists themselves.
        h = F.xxhash64("file_id").cast("decimal(38,0)")
        return rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("k1"), F.sum(h).alias("k2"), F.bit_xor(F.xxhash64(F.lit(7), "file_id")).alias("k3"), F.first("group_tags").alias(name))

    kept = F.array_intersect(F.coalesce("old_tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in METHOD_TAGS]))
    before = keyed(old, "old_tags").drop("group_id").dropDuplicates(["k1", "k2", "k3"])
    return keyed(new, "tags").join(before, ["k1", "k2", "k3"], "left").select("group_id", F.array_union("tags", kept).alias("group_tags"))


def rename_tag(groups: DataFrame, old: str, new: str) -> DataFrame:
    """A retired tag under its new name."""
    return groups.withColumn("group_tags", F.transform("group_tags", lambda t: F.when(t == old, new).otherwise(t)))


def strip_lane(groups: DataFrame, lane: list[str]) -> DataFrame:
    """A lane's tags removed; groups left without any tag of a method go."""
    rest = groups.withColumn("group_tags", F.array_except(F.coalesce("group_tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in lane])))
    return rest.filter(F.arrays_overlap("group_tags", F.array(*[F.lit(t) for t in METHOD_TAGS])))


def clear_lane(groups: DataFrame, lane: list[str]) -> DataFrame:
    """Groups without any of a lane's tags."""
    return groups.filter(~F.coalesce(F.arrays_overlap("group_tags", F.array(*[F.lit(t) for t in lane])), F.lit(False)))


def listed(groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """The list of groups: size, savings, and the title, artist, album and paths of its files.

    What is saved is the size of all files but the one to keep, which is the stored choice or else the one of the
    highest bitrate. One aggregation per group; the paths are the feature's own result.
    """
    cols = files.select(F.col("id").alias("file_id"), "title", "artist", "album", "path", F.coalesce("bitrate", F.lit(0)).alias("bitrate"), F.coalesce("size", F.lit(0)).alias("size"))
    rows = members.join(cols, "file_id").join(groups.select("group_id", "smart_keep_id"), "group_id")
    top = F.max(F.struct("bitrate", (-F.col("file_id")).alias("less"), "title", "artist", "album", "size"))
    agg = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total"), top.alias("top"), F.sum(F.when(F.col("file_id") == F.col("smart_keep_id"), F.col("size"))).alias("kept"),
        F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths"),
    )
    named = agg.select("group_id", "n_files", (F.col("total") - F.coalesce("kept", "top.size")).alias("savings"), F.col("top.title").alias("keep_title"), F.col("top.artist").alias("keep_artist"), F.col("top.album").alias("keep_album"), "paths")
    return groups.select("group_id", "similarity", "type", "resolved", with_fp_diff(F.col("group_tags")).alias("group_tags")).join(named, "group_id").orderBy(F.desc("savings"), "group_id")


def having_all(groups: DataFrame, wanted: list[str]) -> DataFrame:
    """Groups that have all the wanted tags."""
    return groups.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]).cast("array<string>"), "group_tags")) == 0) if wanted else groups


def toggle_tag(selected: list[str], tag: str) -> list[str]:
    """A selection after one tag was switched; choosing one drops those it excludes."""
    if tag in selected:
        return [t for t in selected if t != tag]
    out = {o for pair in EXCLUSIVE_TAGS if tag in pair for o in pair} - {tag}
    return [t for t in selected if t not in out] + [tag]


def facets(groups: DataFrame) -> DataFrame:
    """Distinct tags with their numbers of groups, in the fixed order; unknown tags come last by name."""
    place = F.array_position(F.array(*[F.lit(t) for t in TAG_ORDER]), F.col("tag"))
    counted = groups.select("group_id", F.explode(F.array_distinct("group_tags")).alias("tag")).filter("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("n_groups"))
    return counted.withColumn("place", F.when(place > 0, place).otherwise(len(TAG_ORDER) + 1).cast("int")).orderBy("place", "tag")


def match(files: DataFrame, lanes: list[DataFrame], members: DataFrame | None = None) -> DataFrame:
    """Groups of all lanes' accepted pairs (a, b) and of earlier groups, written once before the components are searched."""
    from .matching import existing_edges

    edges = lanes[0].select("a", "b")
    for lane in lanes[1:]:
        edges = edges.unionByName(lane.select("a", "b"))
    return build(files, cut(edges.distinct()), existing_edges(members) if members is not None else None)
