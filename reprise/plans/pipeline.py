"""The matching pipeline: lanes of steps over a library, seeded with the groups of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import groups as gr
from ..operators import matching as ma
from ..operators.library import Library
from ..operators.storage import cut
from .config import Config

# The lanes in the order of their steps, and the method tags each may set.
LANES = ("basic", "fp", "scrape")
LANE_TAGS = {"basic": ("meta_confirmed",), "fp": ("spectral_exact", "same_recording", "cp_exact", "cp_similar"), "scrape": ("mb_confirmed", "acoustid_confirmed")}
_FLAGS = ("meta_confirmed", "spectral_confirmed", "cp_confirmed", "mb_confirmed", "acoustid_confirmed")


def evidence_pairs(files: DataFrame, enrichment: DataFrame, lanes: tuple[str, ...] = LANES, config: Config = Config()) -> DataFrame:  # noqa: B008
    """The compared pairs of all lanes: (a, b, sim, cp_sim, accepted and one flag for each kind of confirmation)."""
    none = F.lit(None).cast("double")

    def row(pairs: DataFrame, accepted, sim=none, cp=none, **flags) -> DataFrame:
        said = [flags.get(f, F.lit(False)).alias(f) for f in _FLAGS]
        return pairs.select("a", "b", sim.alias("sim"), cp.alias("cp_sim"), accepted.alias("accepted"), *said)

    parts = []
    if "basic" in lanes:
        parts.append(row(ma.attribute_lane(files, config), F.lit(True), meta_confirmed=F.lit(True)))
    if "fp" in lanes:
        parts.append(row(ma.fingerprint_lane(files, config), F.col("accepted"), F.col("sim"), spectral_confirmed=F.col("accepted")))
        parts.append(row(ma.second_lane(files, config), F.col("accepted"), none, F.col("sim"), cp_confirmed=F.col("accepted")))
    if "scrape" in lanes:
        parts.append(row(ma.enrichment_lane(files, enrichment, config), F.lit(True), mb_confirmed=F.col("mb_confirmed"), acoustid_confirmed=F.col("acoustid_confirmed")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run(library: Library, lanes: tuple[str, ...] = LANES, config: Config = Config(), seeded: bool = True) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Groups (group_id, similarity, type, group_tags, smart_keep_id, n_files, reclaimable) and members (group_id, file_id).

    ``seeded``: the groups of earlier runs link their members too, and their method tags are carried over where the
    members are the same. The id of a group is its least member, so it is stable from run to run.
    """
    files = cut(library.live_files("path", "title", "artist", "album", "genre", "album_year", "track_number", "release_type", "format", "bitrate", "duration", "size", "fingerprint", "fingerprint_method", "fingerprint_duration", "chromaprint_raw"))
    pairs = cut(evidence_pairs(files, library.enrichment(), lanes, config))
    old = library.members() if seeded else None
    members = cut(gr.build(files, pairs.filter("accepted"), ma.existing_edges(old) if seeded else None))
    a = members.select(F.col("file_id").alias("a"), "group_id")
    b = members.select(F.col("file_id").alias("b"), F.col("group_id").alias("other"))
    inside = pairs.join(a, "a").join(b, "b").filter("group_id = other")
    found = inside.groupBy("group_id").agg(F.max("sim").alias("max_sim"), F.max("cp_sim").alias("max_cp_sim"), *[F.bool_or(f).alias(f) for f in _FLAGS])
    described = gr.described(members, files)
    tagged = gr.tags(described, found, config.second_exact)
    if seeded:
        before = old.join(library.groups().select("group_id", "group_tags"), "group_id")
        tagged = gr.carry_over(members.join(tagged, "group_id"), before)
    groups = gr.types(described).join(tagged, "group_id").join(found.select("group_id", "max_sim"), "group_id", "left").join(gr.representative(members, files), "group_id")
    return groups.select("group_id", gr.percent(F.col("max_sim")).alias("similarity"), "type", "group_tags", F.col("keep_id").alias("smart_keep_id"), "n_files", "reclaimable"), members
