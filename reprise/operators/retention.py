"""Which member of a group to keep: dimension tags and the cascade of tiers with abstention, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions.text import narrow_key, normalize, round_half_up
from ..plans.config import Config

#: Seconds by which a duration may deviate from the group's reference and still be accurate.
ACCURATE = 3
SOURCES = {"mb": "musicbrainz", "aid": "acoustid"}


def enriched(files: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Files with the columns of both sources, ``mb_*`` and ``aid_*``; null where a source says nothing. ``enrichment`` has one row per file and source."""
    out = files
    for short, source in SOURCES.items():
        own = enrichment.filter(F.col("source") == source)
        out = out.join(own.select(F.col("file_id").alias("id"), *[F.col(c).alias(f"{short}_{c}") for c in own.columns if c not in ("file_id", "source")]), "id", "left")
    return out


def _agreements(exact_only: bool) -> Column:
    """How many of six fields agree with the verified source (the first, unless only the second is exact)."""
    aid = (F.coalesce("mb_match_basis", F.lit("")) != "exact") & (F.coalesce("aid_match_basis", F.lit("")) == "exact")
    said = lambda f: F.when(aid, F.col(f"aid_{f}")).otherwise(F.col(f"mb_{f}"))
    text = lambda f, key: (F.col(f) != "") & (said(f) != "") & (key(F.col(f)) == key(said(f)))
    number = lambda f: (F.col(f) != 0) & (said(f) != 0) & (F.col(f) == said(f))
    same = [text("title", narrow_key), text("artist", narrow_key), text("album", narrow_key), number("album_year"), number("track_number"), text("genre", normalize if exact_only else narrow_key)]
    n = sum((F.coalesce(s, F.lit(False)).cast("int") for s in same[1:]), F.coalesce(same[0], F.lit(False)).cast("int"))
    return F.when(verified(), n).otherwise(0) if exact_only else n


def verified() -> Column:
    return (F.coalesce("mb_match_basis", F.lit("")) == "exact") | (F.coalesce("aid_match_basis", F.lit("")) == "exact")


def annotated(members: DataFrame, rows: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Members (group_id, file_id) with the scores their tiers compare. ``rows`` come from ``enriched``."""
    f = F.col
    scored = rows.select(
        f("id").alias("file_id"), "format", "bitrate", "sample_rate", "duration", "album_year", "file_ctime",
        q.quality_score(f("format"), f("bitrate"), f("sample_rate"), f("bits_per_sample"), config.tier_order).alias("quality"),
        q.completeness(f("title"), f("artist"), f("album"), f("album_year"), f("track_number"), f("genre")).alias("filled"),
        q.release_type(f("release_type"), f("album")).alias("kind"), q.release_score(f("release_type"), f("album")).alias("kind_score"),
        verified().alias("verified"), _agreements(True).alias("agreed"), _agreements(False).alias("agreed_any"), F.nullif(f("mb_mb_recording_id"), F.lit("")).alias("recording"),
        F.when((f("mb_match_basis") == "exact") & (f("mb_duration") > 0), f("mb_duration")).alias("mb_seconds"), F.when((f("aid_match_basis") == "exact") & (f("aid_duration") > 0), f("aid_duration")).alias("aid_seconds"),
    )
    group = Window.partitionBy("group_id").orderBy(F.coalesce("bitrate", F.lit(0)).desc(), "file_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = members.join(scored, "file_id").withColumn("reference", F.coalesce(F.first("mb_seconds", True).over(group), F.first("aid_seconds", True).over(group)))
    out = out.withColumn("deviation", F.when(f("duration") > 0, F.abs(f("duration") - f("reference"))))
    return out.withColumn("accurate", f("deviation") <= ACCURATE).withColumn("n_members", F.count(F.lit(1)).over(Window.partitionBy("group_id")))


def dimension_tags(rows: DataFrame) -> DataFrame:
    """In which dimensions each member is best, each only where the group varies in it (``annotated`` rows)."""
    w, f = Window.partitionBy("group_id"), F.col
    ctime, year = F.coalesce("file_ctime", F.lit(0)), F.when(f("album_year") > 0, f("album_year"))
    varies = lambda c: F.min(c).over(w) < F.max(c).over(w)
    best = lambda c: c == F.max(c).over(w)
    known = F.when(f("duration") > 0, f("accurate"))
    tags = {
        "quality_best": varies(f("quality")) & best(f("quality")), "ctime_best": varies(ctime) & best(ctime) & (F.max(ctime).over(w) > 0),
        "scrape_best": (F.max("agreed").over(w) > 0) & f("verified") & best(f("agreed")), "album_best": varies(f("kind_score")) & best(f("kind_score")) & (F.max("kind_score").over(w) > 0),
        "release_best": varies(F.when(f("album_year") != 0, f("album_year"))) & (year == F.min(year).over(w)), "meta_best": varies(f("filled")) & best(f("filled")) & (F.max("filled").over(w) > 0),
        "duration_accurate": f("accurate") & ~F.coalesce(F.min(known).over(w), F.lit(True)),
    }
    listed = F.array_compact(F.array(*[F.when(c, t) for t, c in tags.items()]))
    return rows.withColumn("pick_tags", F.when(f("n_members") > 1, listed).otherwise(F.array().cast("array<string>")))


def _tiers() -> dict[str, tuple[Column, Column]]:
    """Per tier where it applies and what it scores."""
    f = F.col
    return {
        "scrape_best": (f("verified"), f("agreed")), "quality_best": (F.lit(True), f("quality")), "ctime_best": (F.coalesce(f("file_ctime") > 0, F.lit(False)), f("file_ctime")),
        "release_best": (F.coalesce(f("album_year") > 0, F.lit(False)), -f("album_year")), "album_best": (f("kind_score") > 0, f("kind_score")), "meta_best": (F.lit(True), f("filled")),
        "duration_accurate": (f("deviation").isNotNull(), -F.floor(f("deviation") / ACCURATE)),
    }


def cascade(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """A tier at a time, members to which it applies and that do not score best leave; members to which it does
    not apply stay; a tier in which all that it applies to tie changes nothing; one member left ends it.

    Adds ``alive`` and ``decided_by`` (null for a tie). All stages are windows over one partitioning by group.
    """
    w = Window.partitionBy("group_id")
    out = rows.withColumn("alive", F.lit(True)).withColumn("decided_by", F.lit(None).cast("string"))
    for name in order:
        applies, score = _tiers()[name]
        out = out.withColumn("__in", F.col("alive") & applies).withColumn("__score", F.when(F.col("__in"), score.cast("double")))
        gate = (F.min(F.when(F.col("__in"), F.col("recording"))).over(w) == F.max(F.when(F.col("__in"), F.col("recording"))).over(w)) if name == "scrape_best" else F.lit(True)
        out = out.withColumn("__open", F.coalesce(gate, F.lit(False)) & (F.count_if("alive").over(w) > 1) & F.coalesce(F.min("__score").over(w) < F.max("__score").over(w), F.lit(False)))
        out = out.withColumn("__stays", F.col("alive") & (~F.col("__open") | ~F.col("__in") | (F.col("__score") == F.max("__score").over(w))))
        won = F.col("__open") & (F.count_if("__stays").over(w) == 1)
        out = out.withColumn("decided_by", F.when(F.col("decided_by").isNull() & won, name).otherwise(F.col("decided_by"))).withColumn("alive", F.col("__stays"))
    return out.drop("__in", "__score", "__open", "__stays")


def winners(rows: DataFrame, overrides: DataFrame | None = None, config: Config = Config(), album_counts: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Members with ``keep`` and ``reason``. ``overrides`` has (file_id, keep): true keeps too, false excludes.

    ``album_counts`` (file_id, n) settles what the cascade left tied, where one member has most. A tie that stays
    keeps all survivors.
    """
    w = Window.partitionBy("group_id")
    out = cascade(rows, config.retention_order)
    if album_counts is not None:
        out = out.join(album_counts.select("file_id", F.col("n").alias("__n")), "file_id", "left")
        n = F.when(F.col("alive"), F.coalesce("__n", F.lit(0)))
        top = n == F.max(n).over(w)
        settled = (F.count_if("alive").over(w) > 1) & (F.max(n).over(w) > 0) & (F.count_if(F.coalesce(top, F.lit(False))).over(w) == 1)
        out = out.withColumn("__settled", settled).withColumn("__top", F.coalesce(top, F.lit(False)))
        out = out.withColumn("decided_by", F.when(F.col("__settled"), "local_album").otherwise(F.col("decided_by"))).withColumn("alive", F.col("alive") & (~F.col("__settled") | F.col("__top"))).drop("__n", "__settled", "__top")
    chosen = overrides.select("file_id", F.col("keep").alias("chosen")) if overrides is not None else None
    out = out.join(chosen, "file_id", "left") if chosen is not None else out.withColumn("chosen", F.lit(None).cast("boolean"))
    manual, excluded = F.coalesce("chosen", F.lit(False)), F.coalesce(~F.col("chosen"), F.lit(False))
    smart = F.when(F.col("n_members") == 1, "only_version").when(F.col("decided_by").isNotNull(), reason()).when(F.count_if("alive").over(w) > 1, "tie")
    why = F.when(excluded, None).when(F.col("alive") & manual, F.concat(F.coalesce(smart, F.lit("tie")), F.lit("+manual_keep"))).when(F.col("alive"), smart).when(manual, "manual_keep")
    return out.withColumn("keep", (F.col("alive") | manual) & ~excluded).withColumn("reason", why)


def reason() -> Column:
    """The deciding tier with the value that decided."""
    f = F.col
    value = {
        "scrape_best": F.concat(f("agreed").cast("string"), F.lit("/6")), "quality_best": F.concat_ws(" ", F.upper("format"), F.concat(F.coalesce("bitrate", F.lit(0)).cast("string"), F.lit("k"))),
        "ctime_best": F.date_format(F.timestamp_millis("file_ctime"), "yyyy-MM-dd"), "release_best": f("album_year").cast("string"), "album_best": f("kind"),
        "meta_best": F.concat(f("filled").cast("string"), F.lit("/6")), "duration_accurate": F.concat(round_half_up(f("duration")).cast("string"), F.lit("s")),
    }
    out = f("decided_by")
    for name, v in value.items():
        out = F.when(f("decided_by") == name, F.concat(F.lit(f"{name}: "), v)).otherwise(out)
    return out


def toggle_keeps(kept: DataFrame, wishes: DataFrame, now: int) -> DataFrame:
    """The overrides that make files kept or not as wished (file_id, keep): none where the cascade agrees, else one row
    (file_id, keep, reason, added_time). ``kept`` are rows of ``winners``; a file alive in any of its groups counts as kept there."""
    alive = kept.groupBy("file_id").agg(F.bool_or("alive").alias("alive"))
    wanted = wishes.select("file_id", "keep").distinct().join(alive, "file_id").filter("keep <> alive")
    return wanted.select("file_id", "keep", F.lit(None).cast("string").alias("reason"), F.lit(now).cast("bigint").alias("added_time"))


def comparison(rows: DataFrame) -> DataFrame:
    """Per member and dimension its value, and whether it is best among those that have one."""
    w, f = Window.partitionBy("group_id", "dimension"), F.col
    cells = F.array(*[F.struct(F.lit(k).alias("dimension"), F.when(a, s).cast("double").alias("score")) for k, (a, s) in _tiers().items()])
    long = rows.select("group_id", "file_id", F.explode(cells).alias("c")).select("group_id", "file_id", "c.dimension", "c.score")
    return long.withColumn("best", F.coalesce((f("score") == F.max("score").over(w)) & (F.min("score").over(w) < F.max("score").over(w)), F.lit(False)))
