"""Enrichment from an offline catalogue, and merging of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions.similarity import bigrams, dice, duration_score, script_agreement, script_of
from ..functions.text import album_key, fold_script, leading_int, normalize, round_half_up, wide_key
from .storage import cut

# Weights and bounds of release choice and candidate scores.
ALBUM_WEIGHT, SCRIPT_WEIGHT, TOP_FRACTION, LEAST_SCORE = 0.75, 0.25, 0.9, 0.4
FIELDS = ("title", "artist", "album", "album_year", "track_number", "genre", "duration")
#: Records of a title that meet in one task; titles of more are joined in so many parts.
COMMON = 1000


def search(files: DataFrame, catalogue: DataFrame, limit: int = 25, fold: dict[str, str] | None = None) -> DataFrame:
    """Offline text search: records of the same normalised title whose artist is not another one, best score first, at most ``limit`` a file.

    The limit is that of the search. Titles of very many records are joined in parts, by the same rule. Only ids and
    scores go through the search; what the records and files hold joins the hits afterwards, ``prepared`` for the
    choice of a release once a record.
    """
    recs = catalogue.filter("rec_id IS NOT NULL").dropDuplicates(["rec_id"])
    named = recs.select("rec_id", "score", normalize(F.col("title")).alias("key"), normalize(F.array_join("artists.name", ", ")).alias("rec_artist")).filter("key <> ''")
    parts = named.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / COMMON).alias("parts"))
    own = files.select("id", normalize(F.col("title")).alias("key"), normalize(F.col("artist")).alias("own_artist")).filter("key <> ''")
    side = named.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("rec_id"), F.col("parts"))).drop("parts")
    own = own.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    near = (F.col("own_artist") == "") | (F.col("rec_artist") == "") | F.contains("own_artist", "rec_artist") | F.contains("rec_artist", "own_artist")
    w = Window.partitionBy("id").orderBy(F.col("score").desc_nulls_last(), "rec_id")
    hits = own.join(side, ["key", "part"]).filter(near).select("id", "rec_id", "score").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
    full = recs.select("rec_id", F.col("title").alias("rec_title"), *[c for c in recs.columns if c not in ("rec_id", "title", "score")], *([prepared(F.col("releases"), fold).alias("prepared")] if "releases" in recs.columns else []))
    return hits.join(full, "rec_id").join(files.select("id", "title", "artist", "album", "duration", "track_number", album_bigrams(F.col("album"), fold).alias("album_grams")), "id")


def _grams(title: Column, fold: dict[str, str] | None) -> Column:
    """The folded key of an album title and its bigrams."""
    key = wide_key(fold_script(album_key(title), fold))
    return F.struct(key.alias("key"), bigrams(key).alias("grams"))


def album_bigrams(album: Column, fold: dict[str, str] | None = None) -> Column:
    """What release choice needs of a file's album, null without one."""
    return F.when(album != "", F.struct(_grams(album, fold).alias("key"), (script_of(album, fold) if fold else F.lit(None).cast("string")).alias("script")))


def prepared(releases: Column, fold: dict[str, str] | None = None) -> Column:
    """What release choice needs of each release, in its order: worked out once a record, not once a candidate."""
    year = lambda r: F.when(leading_int(r["date"]) > 0, leading_int(r["date"])).otherwise(9999)
    script = lambda r: script_of(r["title"], fold) if fold else F.lit(None).cast("string")
    return F.transform(releases, lambda r, i: F.struct(F.coalesce(r["status"] != "Official", F.lit(True)).alias("other"), year(r).alias("year"), i.alias("place"), _grams(r["title"], fold).alias("key"), script(r).alias("script"), r.alias("release")))


def choose_release(ready: Column, album: Column) -> Column:
    """The release that suits an album best (``prepared`` releases, ``album_bigrams``): of those near the best match the
    earliest official one; without an album the earliest official one. A struct (release, album_sim), null without releases."""
    has, own = album.isNotNull(), album["key"]

    def sim(r: Column) -> Column:
        k = r["key"]
        return F.when((k["key"] == "") | (own["key"] == ""), 0.0).when(k["key"] == own["key"], 1.0).otherwise(2 * F.size(F.array_intersect(k["grams"], own["grams"])) / (F.size(k["grams"]) + F.size(own["grams"])))

    scored = F.transform(ready, lambda r: F.struct(r["other"].alias("other"), r["year"].alias("year"), r["place"].alias("place"), F.when(has, sim(r)).otherwise(0.0).alias("sim"), script_agreement(album["script"], r["script"]).alias("script")))
    rate = lambda s: ALBUM_WEIGHT * s["sim"] + SCRIPT_WEIGHT * s["script"]
    top = F.array_max(F.transform(scored, rate))
    close = F.filter(scored, lambda s: ~has | (rate(s) >= F.greatest(F.lit(LEAST_SCORE), top * TOP_FRACTION)))
    pool = F.when(F.size(close) > 0, close).otherwise(F.transform(scored, lambda s: s.withField("sim", F.lit(0.0))))
    # Least: official before others, then the earliest, then the first.
    best = F.array_min(F.transform(pool, lambda s: F.struct(s["other"].alias("other"), s["year"].alias("year"), s["place"].alias("place"), s["sim"].alias("sim"))))
    return F.struct(F.get(ready, best["place"])["release"].alias("release"), F.coalesce(best["sim"], F.lit(0.0)).alias("album_sim"))


def pick_release(releases: Column, album: Column, fold: dict[str, str] | None = None) -> Column:
    """E1 over plain releases and an album title.

    ``fold`` has the simple characters of traditional ones; with it, an album in the same script as a release counts more (M16).
    """
    return choose_release(prepared(releases, fold), album_bigrams(album, fold))


def candidates(found: DataFrame) -> DataFrame:
    """Rows of ``search`` with the chosen release, the scores, whether the match is exact, and the formatted result."""
    seconds = F.coalesce(F.when(F.col("length_ms") > 0, F.col("length_ms") / 1000), F.when(F.col("duration_s") > 0, F.col("duration_s")))
    out = found.withColumn("picked", choose_release(F.col("prepared"), F.col("album_grams"))).withColumn("seconds", seconds)
    out = out.withColumn("album_sim", F.coalesce("picked.album_sim", F.lit(0.0))).withColumn("dur_score", duration_score(F.col("duration"), F.col("seconds")))
    bonus = F.when((F.col("track_number") > 0) & (F.col("picked.release.track_number") == F.col("track_number")), 0.15).otherwise(0.0)
    total = 0.3 * F.coalesce("score", F.lit(0)) / 100 + 0.5 * F.col("album_sim") + 0.2 * F.coalesce("dur_score", F.lit(0.0)) + bonus
    genre = F.array_max(F.transform("genres", lambda g, i: F.struct(F.coalesce(g["count"], F.lit(0)).alias("n"), (-i).alias("first"), g["name"].alias("name"))))["name"]
    out = out.withColumn("total", F.round(total, 6)).withColumn("basis", F.when((F.col("total") >= 0.55) & ((F.col("album_sim") >= 0.45) | (F.coalesce("dur_score", F.lit(0.0)) >= 0.6)), "exact").otherwise("fuzzy"))
    return out.select(
        F.col("id").alias("file_id"), "rec_id", F.col("picked.release.id").alias("release_id"), F.col("rec_title").alias("title"), F.array_join("artists.name", ", ").alias("artist"), F.nullif(album_key(F.col("picked.release.title")), F.lit("")).alias("album"),
        leading_int(F.col("picked.release.date")).alias("album_year"), F.coalesce("picked.release.track_number", F.lit(0)).alias("track_number"), genre.alias("genre"), round_half_up(F.col("seconds")).alias("duration"),
        F.coalesce("score", F.lit(0)).alias("score"), F.round("album_sim", 6).alias("album_sim"), "dur_score", "total", "basis",
        F.row_number().over(Window.partitionBy("id").orderBy(F.col("total").desc(), "rec_id")).alias("rank"),
        (F.col("album").isNotNull() & (F.col("album") != "")).alias("has_album"), (F.coalesce("duration", F.lit(0)) > 0).alias("has_duration"), F.col("album").alias("own_album"),
    )


def decide(ranked: DataFrame) -> DataFrame:
    """At most one match per file. A clear lead of a high score is accepted; otherwise the best candidate must be
    corroborated; with neither album nor duration a fair score is accepted as fuzzy."""
    w = Window.partitionBy("file_id").orderBy(F.col("score").desc(), "rec_id")
    by_score = ranked.withColumn("place", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    first = by_score.filter("place = 1").select("file_id", F.col("score").alias("top"), (F.coalesce(F.col("score") - F.col("second") < 15, F.lit(False))).alias("ambiguous"))
    clear = ~F.col("ambiguous") & (F.col("top") >= 80)
    rich = F.col("has_album") | F.col("has_duration")
    dur = F.coalesce("dur_score", F.lit(0.0))
    judged = by_score.join(first, "file_id")
    corroborated = (F.col("total") >= 0.55) & ((F.col("album_sim") >= 0.45) | (dur >= 0.6))
    basis = (
        F.when(clear & (F.col("place") == 1), F.when((F.col("has_album") & (F.col("album_sim") >= 0.6)) | ((dur >= 0.8) & (F.col("top") >= 90)), "exact").otherwise("fuzzy"))
        .when(~clear & rich & (F.col("rank") == 1) & corroborated, F.when(F.col("album_sim") >= 0.45, "exact").otherwise("fuzzy"))
        .when(~clear & ~rich & (F.col("place") == 1) & (F.col("top") >= 70), "fuzzy")
    )
    return judged.withColumn("match_basis", basis).filter("match_basis IS NOT NULL").drop("second", "ambiguous", "top", "basis")


def refined(matches: DataFrame, all_releases: DataFrame) -> DataFrame:
    """Exact matches with an album take the year, album and track of an earlier release of the same record. ``all_releases`` has (rec_id, releases)."""
    full = all_releases.select("rec_id", F.col("releases").alias("full")).dropDuplicates(["rec_id"])
    out = matches.join(full, "rec_id", "left").withColumn("early", pick_release(F.col("full"), F.col("own_album"))["release"]).withColumn("early_year", leading_int(F.col("early.date")))
    better = (F.col("match_basis") == "exact") & F.col("has_album") & (F.col("early_year") > 0) & ((F.col("album_year") == 0) | (F.col("early_year") < F.col("album_year")))
    pick = lambda new, old: F.when(F.coalesce(better, F.lit(False)), F.coalesce(new, F.col(old))).otherwise(F.col(old))
    values = {"release_id": pick(F.col("early.id"), "release_id"), "album": pick(F.nullif(F.col("early.title"), F.lit("")), "album"), "track_number": pick(F.nullif(F.col("early.track_number"), F.lit(0)), "track_number"), "album_year": pick(F.col("early_year"), "album_year")}
    return out.withColumns(values).drop("full", "early", "early_year")


def lookup(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Fingerprint lookup hits (file_id, rec_id, hit, rec_title, artists, releases) ranked per file: hits below
    0.7 and repeats of a record go; most exact fields first, then the score; exact where title, artist and album are."""
    own = files.select(F.col("id").alias("file_id"), "title", "artist", "album")
    once = hits.filter(F.col("hit") >= 0.7).groupBy("file_id", "rec_id").agg(F.max(F.struct("hit", "rec_title", "artists", "releases")).alias("s")).select("file_id", "rec_id", "s.*")
    rows = once.join(own, "file_id")
    same = lambda a, b: (dice(a, b) == 1).cast("int")
    album = F.exists("releases", lambda r: dice(album_key(F.col("album")), album_key(r["title"])) == 1).cast("int")
    fields = same(F.col("title"), F.col("rec_title")) + same(F.col("artist"), F.array_join("artists.name", ", ")) + F.coalesce(album, F.lit(0))
    w = Window.partitionBy("file_id").orderBy(F.desc("fields"), F.desc("hit"), "rec_id")
    return rows.withColumn("fields", fields).select("file_id", "rec_id", "hit", "fields", F.when(F.col("fields") == 3, "exact").otherwise("fuzzy").alias("basis"), F.row_number().over(w).alias("rank"))


def lookup_error(code: Column, message: Column, status: Column, n_results: Column) -> Column:
    """Why a lookup gave nothing, null where it gave something."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status == 429, "rate-limited").when((code == 4) | F.contains(text, F.lit("invalid api key")) | F.contains(text, F.lit("invalid client")), "invalid-key")
        .when(code.isNotNull(), F.concat(F.lit("api-error-"), code.cast("string"))).when(status.isNull(), "network-error").when(status >= 400, F.concat(F.lit("http-"), status.cast("string"))).when(F.coalesce(n_results, F.lit(0)) == 0, "no-results")
    )


#: Reasons that settle a lookup, and those that call for another try (by their beginnings).
SETTLED, TRANSIENT = ("no-results", "low-score", "no-recording", "no-duration"), ("rate-limited", "http-", "network-error")


def miss_histogram(lookups: DataFrame) -> DataFrame:
    """Lookups (code, message, status, n_results) by why they gave nothing: rows (reason, n, settled, transient)."""
    reason = lookup_error(F.col("code"), F.col("message"), F.col("status"), F.col("n_results"))
    counted = lookups.select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    transient = F.lit(False)
    for start in TRANSIENT:
        transient = transient | F.startswith("reason", F.lit(start))
    return counted.select("reason", "n", F.col("reason").isin(*SETTLED).alias("settled"), transient.alias("transient"))


def enrich(files: DataFrame, catalogue: DataFrame, fold: dict[str, str] | None = None, all_releases: DataFrame | None = None) -> DataFrame:
    """E15 without a network: search, score, decide and refine for all files in one plan.

    ``all_releases`` (rec_id, releases) has more releases than the catalogue's records; without it there is nothing to refine.
    """
    ranked = cut(candidates(search(files, catalogue, fold=fold)))
    return refined(decide(ranked), all_releases) if all_releases is not None else decide(ranked)


def _own() -> dict[str, Column]:
    return {n: F.col(n) for n in FIELDS}


def _said(prefix: str) -> dict[str, Column]:
    return {n: F.col(f"{prefix}_{n}") for n in (*FIELDS, "match_basis")}


def clean_genre(genre: Column) -> Column:
    """Null for a genre that is a number with decimals."""
    return F.when(~genre.rlike(r"^\d+\.\d+$"), genre)


def tiers(rows: DataFrame) -> DataFrame:
    """``enriched`` rows with the tier of either source and of both merged, and the merged values ``best_*``."""
    rows = rows.withColumn("mb_genre", clean_genre(F.col("mb_genre"))).withColumn("aid_genre", clean_genre(F.col("aid_genre")))
    out = rows.withColumn("mb_tier", q.status_tier(_own(), _said("mb"))).withColumn("aid_tier", q.status_tier(_own(), _said("aid")))
    there = lambda p: F.col(f"{p}_scraped_at").isNotNull()
    first = there("aid") & (~there("mb") | (q.tier_rank(F.col("aid_tier")) <= q.tier_rank(F.col("mb_tier"))))
    pv = lambda n: F.when(first, F.col(f"aid_{n}")).otherwise(F.col(f"mb_{n}"))
    sv = lambda n: F.when(first, F.col(f"mb_{n}")).otherwise(F.col(f"aid_{n}"))
    both = there("mb") & there("aid")

    def number(n: str) -> Column:
        a, b, own = F.nullif(pv(n), F.lit(0)), F.nullif(sv(n), F.lit(0)), F.nullif(F.col(n), F.lit(0))
        return F.when(both, F.when(a == own, a).when(b == own, b).otherwise(F.coalesce(a, b, F.lit(0)))).otherwise(pv(n))

    def text(n: str) -> Column:
        a, b, own = F.nullif(pv(n), F.lit("")), F.nullif(sv(n), F.lit("")), F.nullif(F.col(n), F.lit(""))
        return F.when(both, F.when(F.lower(a) == F.lower(own), a).when(F.lower(b) == F.lower(own), b).otherwise(F.coalesce(a, b))).otherwise(pv(n))

    values = {f"best_{n}": pv(n) for n in ("title", "artist", "album", "duration")} | {"best_album_year": number("album_year"), "best_track_number": number("track_number"), "best_genre": text("genre")}
    values["best_match_basis"] = F.when(both, F.when(pv("match_basis") == "exact", F.lit("exact")).otherwise(sv("match_basis"))).otherwise(pv("match_basis"))
    values["scrape_source"] = F.when(there("aid") | there("mb"), F.when(first, F.lit("acoustid")).otherwise(F.lit("musicbrainz"))).otherwise("none")
    out = out.withColumns(values)
    return out.withColumn("tier", q.status_tier(_own(), _said("best")))


def field_choices(rows: DataFrame) -> DataFrame:
    """Per file and field whether the sources match it, recommend a value, or must be judged; which source, and whether they conflict."""
    clean = lambda c: F.nullif(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("0"))
    cells = F.array(*[F.struct(F.lit(n).alias("field"), clean(n).alias("own"), clean(f"mb_{n}").alias("mb"), clean(f"aid_{n}").alias("aid")) for n in FIELDS if n != "duration"])
    long = rows.select(F.col("id").alias("file_id"), F.explode(cells).alias("c")).select("file_id", "c.*").filter("mb IS NOT NULL OR aid IS NOT NULL")
    keyed = long.withColumns({f"{c}_key": F.when(F.col(c).isNotNull(), q.wide_key(F.col(c))) for c in ("own", "mb", "aid")})
    is_mb, is_aid, conflict = (F.coalesce(e, F.lit(False)) for e in (F.col("own_key") == F.col("mb_key"), F.col("own_key") == F.col("aid_key"), F.col("mb_key") != F.col("aid_key")))
    state = F.when(is_mb | is_aid, "match").when(F.col("own").isNull() & ~conflict, "recommend").otherwise("judge")
    source = F.when(is_aid, "acoustid").when(is_mb, "musicbrainz").when(F.col("aid").isNotNull(), "acoustid").otherwise("musicbrainz")
    return keyed.select("file_id", "field", state.alias("state"), source.alias("source"), conflict.alias("conflict"))


def source_stats(rows: DataFrame) -> DataFrame:
    """Per file and source how many of seven fields it has and how many of them match (durations within 3 s)."""

    def one(p: str, source: str) -> Column:
        text = lambda n: F.coalesce(F.col(f"{p}_{n}") != "", F.lit(False))
        number = lambda n: F.coalesce(F.col(f"{p}_{n}") > 0, F.lit(False))
        has = [text(n) for n in ("title", "artist", "album", "genre")] + [number(n) for n in ("album_year", "track_number", "duration")]
        same = [text(n) & F.coalesce(q.wide_key(F.col(n)) == q.wide_key(F.col(f"{p}_{n}")), F.lit(False)) for n in ("title", "artist", "album", "genre")]
        same += [number(n) & F.coalesce(F.col(n) == F.col(f"{p}_{n}"), F.lit(False)) for n in ("album_year", "track_number")] + [number("duration") & F.coalesce(F.abs(F.col("duration") - F.col(f"{p}_duration")) <= 3, F.lit(False))]
        add = lambda cs: sum((c.cast("int") for c in cs[1:]), cs[0].cast("int"))
        return F.struct(F.lit(source).alias("source"), F.col(f"{p}_scraped_at").isNotNull().alias("there"), add(has).alias("n_has"), add(same).alias("n_match"))

    return rows.select(F.col("id").alias("file_id"), F.explode(F.array(one("mb", "musicbrainz"), one("aid", "acoustid"))).alias("s")).select("file_id", "s.*").filter("there").drop("there")


def cross_fill(members: DataFrame, files: DataFrame) -> DataFrame:
    """For each field a member lacks the value of the most related other member: rows (group_id, file_id, field, from_id, value).

    Related is twice the number of equal fields; the least id wins a tie. Each missing field meets only the
    distinct values of the group, so no member meets all others.
    """
    names = ("title", "artist", "album", "album_year", "track_number", "genre")
    text = lambda n: F.nullif(F.nullif(F.col(n).cast("string"), F.lit("")), F.lit("0")).alias(n)
    rows = members.join(files.select(F.col("id").alias("file_id"), *[text(n) for n in names]), "file_id")
    # Members that say the same are one giver: the least id.
    givers = rows.groupBy("group_id", *names).agg(F.min("file_id").alias("from_id")).select("group_id", "from_id", F.struct(*names).alias("g"))
    lacks = F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names])
    takers = rows.select("group_id", "file_id", F.struct(*names).alias("t"), F.explode(F.array_compact(lacks)).alias("field"))
    value = F.coalesce(*[F.when(F.col("field") == n, F.col(f"g.{n}")) for n in names])
    pairs = takers.join(givers, "group_id").withColumn("value", value).filter("value IS NOT NULL")
    affinity = sum((F.coalesce(F.col(f"t.{n}") == F.col(f"g.{n}"), F.lit(False)).cast("int") for n in names[1:]), F.coalesce(F.col("t.title") == F.col("g.title"), F.lit(False)).cast("int")) * 2
    best = pairs.withColumn("affinity", affinity).groupBy("group_id", "file_id", "field").agg(F.max(F.struct("affinity", (-F.col("from_id")).alias("less"), "value")).alias("b"))
    return best.select("group_id", "file_id", "field", (-F.col("b.less")).alias("from_id"), "b.value")
