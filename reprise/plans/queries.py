"""The registered queries of the library, and their SQL twins over the same tables."""

# ruff: noqa: E741
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import similarity as sim
from ..functions import text as t
from ..operators import enrichment as en
from ..operators import groups as gr
from ..operators import library as lib
from ..operators import matching as ma
from ..operators import retention as re_
from ..operators import storage as st
from ..operators.graph import connected_components
from ..sources.audio import sine_files
from . import pipeline, sql
from .config import Config
from .sql import with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: A fixed moment for queries about age: 2024-01-01 in epoch milliseconds.
NOW = 1_704_067_200_000
_YEAR = 365 * 86_400_000


def query(name: str, twin: str | None = None):
    def add(f: Callable[[lib.Library], DataFrame]) -> Callable[[lib.Library], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(lib.Library(spark, folder))
        if twin:
            ORACLES[name] = twin
        return f

    return add


# --- projections and filters ------------------------------------------------------------------------------------------


@query("live_filter", with_("f") + "SELECT id, title FROM f WHERE NOT deleted")
def live_filter(l):
    return lib.live(l.live_files("title", "deleted")).select("id", "title")


@query("format_filter", with_("f") + "SELECT id, format FROM f WHERE format = 'FLAC'")
def format_filter(l):
    return lib.by_format(l.files("format", where="format = 'FLAC'"), "flac")


@query("scraped_filter", with_("f e") + "SELECT id FROM f WHERE id IN (SELECT file_id FROM e WHERE title <> '')")
def scraped_filter(l):
    return lib.scraped(l.ids(), l.enrichment())


@query("semi_dup", with_("f m") + "SELECT id FROM f WHERE id IN (SELECT file_id FROM m)")
def semi_dup(l):
    return lib.in_group(l.ids(), l.members())


_MARKLESS = lambda x: rf"trim(regexp_replace(regexp_replace(lower(regexp_replace({sql.nfkd(f"coalesce({x}, '')")}, '\p{{M}}', '', 'g')), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("search_substring", with_("f nk") + "SELECT f.id, f.title FROM f, nk WHERE " + " OR ".join(f"contains({_MARKLESS('f.' + c)}, 'ladder')" for c in ("title", "artist", "album")))
def search_substring(l):
    return lib.search(l.files("title", "artist", "album"), "Läd-der").select("id", "title")


@query("resolved_filter", with_("g") + "SELECT group_id FROM g WHERE coalesce(resolved, false)")
def resolved_filter(l):
    return lib.resolved(l.groups(), True).select("group_id")


@query("tag_all_filter", with_("g") + "SELECT group_id FROM g WHERE list_has_all(group_tags, ['format_same', 'metadata_diff'])")
def tag_all_filter(l):
    return gr.having_all(l.groups(), ["format_same", "metadata_diff"]).select("group_id")


@query("in_groups_first", with_("f m g") + "SELECT f.id, (SELECT m.group_id FROM m JOIN g USING (group_id) WHERE m.file_id = f.id ORDER BY coalesce(g.resolved, false), m.group_id LIMIT 1) AS group_id FROM f")
def in_groups_first(l):
    return lib.first_groups(l.ids(), l.members(), l.groups())


@query("file_by_id", with_("f") + "SELECT id, path FROM f WHERE id = 9")
def file_by_id(l):
    return lib.by_id(l.files("path"), "id", 9)


@query("album_nocase", with_("f") + "SELECT id, album FROM f WHERE translate(album, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'migemifem sessions, vol. 4'")
def album_nocase(l):
    return lib.by_album(l.files("album"), "MIGEMIFEM Sessions, Vol. 4")


@query("fingerprint_admissible", with_("f") + "SELECT id FROM f WHERE fingerprint_method = 'metadata' OR len(list_filter(fingerprint, lambda x: x <> 0)) >= 0.1 * len(fingerprint)")
def fingerprint_admissible(l):
    return l.files("fingerprint", "fingerprint_method").filter(ma.admissible(F.col("fingerprint"), F.col("fingerprint_method"))).select("id")


@query("retention_flags", with_("f r") + "SELECT f.id, coalesce(r.keep, false) AS in_retention_list FROM f LEFT JOIN r ON r.file_id = f.id")
def retention_flags(l):
    return lib.with_override(l.ids(), l.overrides())


_SCRAPE = ", ".join(f"coalesce(aid.{c}, mb.{c}) AS scrape_{c}" for c in ("title", "artist", "album", "album_year", "track_number", "genre", "duration"))
_TWO = "FROM f LEFT JOIN e mb ON mb.file_id = f.id AND mb.source = 'musicbrainz' LEFT JOIN e aid ON aid.file_id = f.id AND aid.source = 'acoustid'"


@query("coalesce_sources", with_("f e") + f"SELECT f.id, {_SCRAPE}, CASE WHEN aid.title IS NOT NULL THEN 'acoustid' WHEN mb.title IS NOT NULL THEN 'musicbrainz' END AS scrape_source {_TWO}")
def coalesce_sources(l):
    return lib.coalesced(re_.enriched(l.ids(), l.enrichment()))


@query("genre_clean", with_("e") + r"SELECT file_id, source, CASE WHEN NOT regexp_full_match(genre, '\d+\.\d+') THEN genre END AS genre FROM e")
def genre_clean(l):
    return l.enrichment().select("file_id", "source", en.clean_genre(F.col("genre")).alias("genre"))


@query("needs_meta", with_("f") + f"SELECT id FROM f WHERE NOT deleted AND (meta_extracted_at IS NULL OR meta_extracted_at < file_mtime + {_YEAR})")
def needs_meta(l):
    """As if every file had changed a year later."""
    rows = l.files("deleted", "meta_extracted_at", "file_mtime")
    return lib.needs_metadata(rows.withColumn("file_mtime", F.col("file_mtime") + _YEAR)).select("id")


@query("needs_fp_union", with_("f", "a AS (SELECT id FROM f WHERE NOT deleted AND (fingerprint IS NULL OR fp_extracted_at IS NULL OR fp_extracted_at < file_mtime))") + "SELECT id FROM a UNION SELECT id FROM f WHERE NOT deleted AND fingerprint IS NOT NULL AND (chromaprint IS NULL OR chromaprint_raw IS NULL)")
def needs_fp_union(l):
    rows = l.files("deleted", "fingerprint", "fp_extracted_at", "file_mtime", "chromaprint", "chromaprint_raw")
    return lib.needs_fingerprint(rows).select("id").unionByName(lib.needs_second_fingerprint(rows, None).select("id")).distinct()


@query("needs_enrichment", with_("f e") + "SELECT id FROM f WHERE NOT deleted AND title <> '' AND id NOT IN (SELECT file_id FROM e WHERE source = 'musicbrainz')")
def needs_enrichment(l):
    return lib.needs_enrichment(l.files("deleted", "title", "mb_checked_at"), l.enrichment(), "musicbrainz", "retry").select("id")


@query("needs_enrichment_new", with_("f") + "SELECT id FROM f WHERE NOT deleted AND chromaprint IS NOT NULL AND acoustid_checked_at IS NULL")
def needs_enrichment_new(l):
    return lib.needs_enrichment(l.files("deleted", "chromaprint", "acoustid_checked_at"), l.enrichment(), "acoustid").select("id")


# --- joins ------------------------------------------------------------------------------------------------------------


@query("dual_left_join", with_("f e") + f"SELECT f.id, mb.title AS mb_title, mb.duration AS mb_duration, aid.title AS aid_title, aid.duration AS aid_duration {_TWO}")
def dual_left_join(l):
    return re_.enriched(l.ids(), l.enrichment().select("file_id", "source", "title", "duration"))


@query("theta_ne_null", with_("m g") + "SELECT m.group_id, m.file_id FROM m JOIN g USING (group_id) WHERE m.file_id <> g.smart_keep_id")
def theta_ne_null(l):
    return lib.spare_members(l.members(), l.groups()).select("group_id", "file_id")


@query("anti_missing", with_("f") + "SELECT id FROM f WHERE id NOT IN (SELECT file_id FROM scraped_meta WHERE file_id IS NOT NULL)")
def anti_missing(l):
    return l.ids().join(l.read("scraped_meta").select(F.col("file_id").alias("id")), "id", "left_anti")


@query("vanished", with_("f") + "SELECT id FROM f WHERE NOT deleted AND path NOT IN (SELECT path FROM f WHERE path LIKE '/srv/%')")
def vanished(l):
    rows = l.files("path", "deleted")
    gone = st.cascade_delete({"files": rows}, rows.filter(F.col("path").startswith("/srv/")))["files"]
    return rows.join(gone, "id", "left_anti").select("id")


@query("semi_backfill", with_("f") + "SELECT file_id, source FROM (SELECT DISTINCT file_id, source FROM scraped_meta) s WHERE file_id IN (SELECT id FROM f WHERE chromaprint IS NOT NULL)")
def semi_backfill(l):
    rows = l.files("chromaprint").filter("chromaprint IS NOT NULL").select(F.col("id").alias("file_id"))
    return l.read("scraped_meta").select("file_id", "source").distinct().join(rows, "file_id", "left_semi")


@query("topk_per_group", with_("f m") + "SELECT m.group_id, f.id AS file_id, f.title, f.artist, f.album FROM m JOIN f ON f.id = m.file_id QUALIFY row_number() OVER (PARTITION BY m.group_id ORDER BY coalesce(f.bitrate, 0) DESC, f.id) = 1")
def topk_per_group(l):
    return lib.top_member(l.members(), l.files("bitrate", "title", "artist", "album"), "title", "artist", "album")


@query("overrides_join", with_("f r") + "SELECT r.file_id, f.path, r.reason, r.added_time FROM r JOIN f ON f.id = r.file_id WHERE r.keep")
def overrides_join(l):
    return l.overrides().filter("keep").join(l.files("path").withColumnRenamed("id", "file_id"), "file_id").select("file_id", "path", "reason", "added_time").orderBy(F.desc("added_time"), "file_id")


_KEYS = """k AS (SELECT id, fingerprint AS w, len(fingerprint) AS n FROM f WHERE len(fingerprint) >= 6),
s AS (SELECT DISTINCT id, array_to_string(w[least(i * greatest(1, (n - 3) // 4), n - 3) + 1 : least(i * greatest(1, (n - 3) // 4), n - 3) + 3], ' ') AS key FROM k, range(5) r(i)
  UNION SELECT id, array_to_string(fingerprint, ' ') FROM f WHERE len(fingerprint) BETWEEN 1 AND 5)"""


@query("lsh_pairs", with_("f", _KEYS) + "SELECT DISTINCT x.id AS a, y.id AS b FROM s x JOIN s y ON x.key = y.key AND x.id < y.id")
def lsh_pairs(l):
    return ma.shared_key_pairs(l.files("fingerprint"), t.segment_keys(F.col("fingerprint")))


_SLIDE = """x AS (SELECT DISTINCT x.id AS a, y.id AS b FROM s x JOIN s y ON x.key = y.key AND x.id < y.id),
o AS (SELECT a, b, o, list_slice(p.fingerprint, greatest(0, o) + 1, len(p.fingerprint)) AS u, list_slice(q.fingerprint, greatest(0, -o) + 1, len(q.fingerprint)) AS v
  FROM x JOIN f p ON p.id = a JOIN f q ON q.id = b, range(-8, 9) r(o)),
l AS (SELECT a, b, o, u, v, least(len(u), len(v)) AS n FROM o WHERE least(len(u), len(v)) >= 20),
h AS (SELECT a, b, o, n, 32 * n - list_sum(list_transform(range(1, n + 1), lambda i: bit_count(xor(u[i], v[i])))) AS bits FROM l)"""


@query("sliding_hamming_pairs", with_("f", _KEYS + ",\n" + _SLIDE) + "SELECT x.a, x.b, round(coalesce(arg_max(bits / (32.0 * n), bits * 100 - o), 0), 6)::DOUBLE AS sim FROM x LEFT JOIN h USING (a, b) GROUP BY x.a, x.b")
def sliding_hamming_pairs(l):
    rows = l.files("fingerprint")
    pairs = ma._both(ma.shared_key_pairs(rows, t.segment_keys(F.col("fingerprint"))), rows, "fingerprint")
    return sim.score_pairs(pairs, "fingerprint_a", "fingerprint_b", "sim").withColumn("sim", F.round("sim", 6))


@query("band_pairs", with_("f", "k AS (SELECT id, floor(fingerprint_duration / 4 + 0.5)::INT AS o FROM f WHERE fingerprint_duration > 0 AND NOT isnan(fingerprint_duration))") + "SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.id < y.id AND abs(x.o - y.o) <= 2")
def band_pairs(l):
    return ma.band_pairs(l.files("fingerprint_duration"), F.col("fingerprint_duration"))


@query("recording_pairs", with_("f e", "i AS (SELECT DISTINCT file_id AS id, mb_recording_id AS k FROM e WHERE mb_recording_id <> '' AND file_id IN (SELECT id FROM f))") + "SELECT DISTINCT x.id AS a, y.id AS b FROM i x JOIN i y ON x.k = y.k AND x.id < y.id")
def recording_pairs(l):
    return ma.recording_pairs(l.ids(), l.enrichment()).select("a", "b")


@query("hamming_words", with_("f") + "SELECT id, coalesce(list_sum(list_transform(range(1, len(fingerprint)), lambda i: bit_count(xor(fingerprint[i], fingerprint[i + 1])))), 0)::BIGINT AS changed FROM f WHERE len(fingerprint) > 0")
def hamming_words(l):
    words = l.files("fingerprint").filter(F.size("fingerprint") > 0)
    steps = F.transform(F.slice("fingerprint", F.lit(2), F.greatest(F.size("fingerprint") - 1, F.lit(0))), lambda w, i: sim.hamming(w, F.get("fingerprint", i)))
    return words.select("id", F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("changed"))


# --- matching lanes -------------------------------------------------------------------------------------------------


@query("title_pairs", with_("f nk", sql.TITLES + f", k AS (SELECT ft.id, clean, duration, {sql.parts('artist')} AS p FROM ft, nk WHERE NOT deleted AND length(clean) >= 2 AND duration > 0)") + f"SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.clean = y.clean AND x.id < y.id AND abs(x.duration - y.duration) <= 5 WHERE {sql.share('x.p', 'y.p')} >= 0.5")
def title_pairs(l):
    return ma.attribute_lane(lib.live(l.live_files("title", "artist", "path", "duration", "deleted")))


@query("fingerprint_pairs")
def fingerprint_pairs(l):
    rows = lib.live(l.live_files("title", "artist", "path", "duration", "deleted", "fingerprint", "fingerprint_method", "fingerprint_duration"))
    return ma.fingerprint_lane(rows).select("a", "b", F.round("sim", 6).alias("sim"), "accepted", "exact")


@query("second_fp_pairs")
def second_fp_pairs(l):
    return ma.second_lane(lib.live(l.live_files("title", "artist", "path", "duration", "deleted", "chromaprint_raw"))).select("a", "b", F.round("sim", 6).alias("sim"), "accepted")


@query("plausible_pairs", with_("f e nk", sql.TITLES + """,
s AS (SELECT file_id, max(mb_recording_id) FILTER (source = 'musicbrainz') AS mb, max(mb_recording_id) FILTER (source = 'acoustid') AS aid FROM e WHERE mb_recording_id <> '' GROUP BY file_id),
k AS (SELECT id, title_key, artist_key, mb, aid FROM ft JOIN s ON s.file_id = ft.id WHERE NOT deleted),
i AS (SELECT id, mb AS rid FROM k WHERE mb IS NOT NULL UNION SELECT id, aid FROM k WHERE aid IS NOT NULL),
p AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b FROM i x JOIN i y ON x.rid = y.rid AND x.id < y.id)""") + f"SELECT p.a, p.b, coalesce(x.mb = y.mb, false) AS mb_confirmed, coalesce(x.aid = y.aid, false) OR coalesce(x.mb = y.aid, false) OR coalesce(x.aid = y.mb, false) AS acoustid_confirmed FROM p JOIN k x ON x.id = p.a JOIN k y ON y.id = p.b WHERE {sql.plausible('x.title_key', 'y.title_key', 'x.artist_key', 'y.artist_key')}")
def plausible_pairs(l):
    return ma.enrichment_lane(lib.live(l.live_files("title", "artist", "path", "deleted")), l.enrichment())


_DICE = f"""d AS (SELECT e.file_id, e.source, {sql.wide('f.title')} AS a, {sql.wide('e.title')} AS b FROM e JOIN f ON f.id = e.file_id),
b2 AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(a) - 1, 1) + 1), lambda i: substr(a, i, 2))) AS x, list_distinct(list_transform(range(1, greatest(length(b) - 1, 1) + 1), lambda i: substr(b, i, 2))) AS y FROM d)"""


@query("dice_pairs", with_("f e", _DICE) + "SELECT file_id, source, round(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 ELSE 2 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 6)::DOUBLE AS dice FROM b2")
def dice_pairs(l):
    rows = l.enrichment().select("file_id", "source", F.col("title").alias("said")).join(l.files("title").withColumnRenamed("id", "file_id"), "file_id")
    return rows.select("file_id", "source", F.round(sim.dice(F.col("title"), F.col("said")), 6).alias("dice"))


@query("artist_token_match", with_("f e nk", f"k AS (SELECT e.file_id, e.source, {sql.parts('f.artist')} AS a, {sql.parts('e.artist')} AS b FROM e JOIN f ON f.id = e.file_id, nk)") + f"SELECT file_id, source, {sql.share('a', 'b')} >= 0.5 AS matches FROM k")
def artist_token_match(l):
    # Tokens are made on either side of the join: no Python function may stand within an array expression.
    said = l.enrichment().select("file_id", "source", sim.artist_tokens(F.col("artist")).alias("b"))
    own = l.files("artist").select(F.col("id").alias("file_id"), sim.artist_tokens(F.col("artist")).alias("a"))
    return said.join(own, "file_id").select("file_id", "source", (sim.share_of_tokens(F.col("a"), F.col("b")) >= 0.5).alias("matches"))


@query("edit_similarity", with_("f e") + f"SELECT file_id, source, round({sql.likeness('f.title', 'e.title')}, 6)::DOUBLE AS sim FROM e JOIN f ON f.id = e.file_id")
def edit_similarity(l):
    """All titles, in characters. Null where a title is missing."""
    rows = l.enrichment().select("file_id", "source", F.col("title").alias("said")).join(l.files("title").withColumnRenamed("id", "file_id"), "file_id")
    return rows.select("file_id", "source", F.round(sim.edit_similarity(F.col("title"), F.col("said")), 6).alias("sim"))


@query("duration_scores", with_("f e") + "SELECT file_id, source, CASE WHEN f.duration > 0 AND e.duration > 0 THEN CASE WHEN abs(f.duration - e.duration) <= 3 THEN 1.0 WHEN abs(f.duration - e.duration) <= 8 THEN 0.6 WHEN abs(f.duration - e.duration) <= 20 THEN 0.2 ELSE 0.0 END END::DOUBLE AS score FROM e JOIN f ON f.id = e.file_id")
def duration_scores(l):
    rows = l.enrichment().select("file_id", "source", F.col("duration").alias("said")).join(l.files("duration").withColumnRenamed("id", "file_id"), "file_id")
    return rows.select("file_id", "source", sim.duration_score(F.col("duration"), F.col("said")).alias("score"))


_KINDS = """s AS (SELECT group_id, min(file_id) AS a FROM m GROUP BY group_id),
p AS (SELECT DISTINCT s.a, m.file_id AS b FROM s JOIN m USING (group_id) WHERE m.file_id <> s.a),
k AS (SELECT id, fingerprint AS w, coalesce(fingerprint_method = 'metadata', false) AS tagged, floor(coalesce(fingerprint_duration, 0) + 0.5)::BIGINT::VARCHAR AS d FROM f),
x AS (SELECT p.a, p.b, u.w AS uw, v.w AS vw, u.tagged AS ut, v.tagged AS vt, u.d AS ud, v.d AS vd FROM p JOIN k u ON u.id = p.a JOIN k v ON v.id = p.b),
o AS (SELECT a, b, o, list_slice(uw, greatest(0, o) + 1, len(uw)) AS i, list_slice(vw, greatest(0, -o) + 1, len(vw)) AS j FROM x, range(-8, 9) r(o) WHERE NOT ut AND NOT vt AND uw IS NOT NULL AND vw IS NOT NULL),
h AS (SELECT a, b, o, least(len(i), len(j)) AS n, 32 * least(len(i), len(j)) - list_sum(list_transform(range(1, least(len(i), len(j)) + 1), lambda q: bit_count(xor(i[q], j[q])))) AS bits FROM o WHERE least(len(i), len(j)) >= 20),
z AS (SELECT a, b, arg_max(bits / (32.0 * n), bits * 100 - o) AS sim FROM h GROUP BY a, b)"""


@query("fingerprint_kinds", with_("f m", _KINDS) + """SELECT x.a, x.b, round(CASE WHEN ut AND vt THEN CASE WHEN 1 - levenshtein(ud, vd) / greatest(length(ud), length(vd)) >= 0.75 THEN least(1 - levenshtein(ud, vd) / greatest(length(ud), length(vd)), 0.96) ELSE 0 END
WHEN ut OR vt OR uw IS NULL OR vw IS NULL THEN 0 WHEN uw = vw THEN 1 ELSE coalesce(z.sim, 0) END, 6)::DOUBLE AS sim FROM x LEFT JOIN z ON z.a = x.a AND z.b = x.b""")
def fingerprint_kinds(l):
    """M5-M7 over the members of groups and their least one: words with words, tags with tags, neither with the other kind."""
    rows = l.files("fingerprint", "fingerprint_method", "fingerprint_duration", "title")
    pairs = sim.score_pairs(ma._both(ma.existing_edges(l.members()), rows, "fingerprint", "fingerprint_method", "fingerprint_duration", "title").withColumns({"equal": F.coalesce(F.col("fingerprint_a") == F.col("fingerprint_b"), F.lit(False)), "lacks": F.col("fingerprint_a").isNull() | F.col("fingerprint_b").isNull()}), "fingerprint_a", "fingerprint_b", "spectral")
    tagged = sim.title_fingerprint_similarity(F.col("title_a"), F.col("title_b"), F.col("fingerprint_duration_a"), F.col("fingerprint_duration_b"), True)
    return pairs.select("a", "b", F.round(sim.fingerprint_similarity(F.col("fingerprint_method_a"), F.col("fingerprint_method_b"), F.col("equal"), F.when(F.col("lacks"), 0.0).otherwise(F.col("spectral")), tagged), 6).alias("sim")).distinct()


# --- groups -----------------------------------------------------------------------------------------------------------

_ROOTS = """j AS (SELECT DISTINCT x.file_id AS a, y.file_id AS b FROM m x JOIN m y ON x.group_id = y.group_id AND x.file_id <> y.file_id),
w AS (SELECT a AS id, a AS reach FROM j UNION SELECT j.b, w.reach FROM w JOIN j ON j.a = w.id)"""


@query("components", with_("m", _ROOTS, True) + "SELECT id, min(reach) AS component FROM w GROUP BY id")
def components(l):
    return connected_components(ma.existing_edges(l.members()))


_EXACT = "k AS (SELECT fingerprint, count(*) AS n, min(id) AS group_id, sum(coalesce(size, 0)) AS total, max(coalesce(bitrate, 0)) AS best FROM f WHERE NOT deleted AND len(fingerprint) > 0 GROUP BY fingerprint HAVING count(*) > 1)"


@query("exact_groups", with_("f", _EXACT) + "SELECT k.group_id, (SELECT f.id FROM f WHERE NOT f.deleted AND f.fingerprint = k.fingerprint ORDER BY coalesce(f.bitrate, 0) DESC, f.id LIMIT 1) AS keep_id, k.n AS n_files, (k.total - (SELECT coalesce(f.size, 0) FROM f WHERE NOT f.deleted AND f.fingerprint = k.fingerprint ORDER BY coalesce(f.bitrate, 0) DESC, f.id LIMIT 1))::BIGINT AS reclaimable FROM k")
def exact_groups(l):
    rows = l.files("fingerprint", "bitrate", "size", where="NOT deleted AND size(fingerprint) > 0")
    return gr.equal_groups(rows, F.col("fingerprint")).orderBy(F.desc("reclaimable"), "group_id")


@query("full_match")
def full_match(l):
    """All lanes together with the groups of earlier runs."""
    rows = st.cut(lib.live(l.live_files("title", "artist", "path", "duration", "deleted", "fingerprint", "fingerprint_method", "fingerprint_duration")))
    lanes = [ma.attribute_lane(rows), ma.fingerprint_lane(rows).filter("accepted"), ma.enrichment_lane(rows, l.enrichment())]
    return gr.match(rows, lanes, l.members())


@query("group_evidence")
def group_evidence(l):
    rows = st.cut(lib.live(l.live_files("title", "artist", "path", "duration", "deleted", "fingerprint", "fingerprint_method", "fingerprint_duration")))
    pairs = st.cut(ma.fingerprint_lane(rows))
    found = gr.evidence(gr.build(rows, pairs.filter("accepted")), pairs, ["exact", "accepted"])
    return found.select("group_id", gr.percent(F.col("max_sim")).alias("similarity"), "exact", "accepted")


@query("library_groups")
def library_groups(l):
    """The whole pipeline: all lanes, seeded with earlier groups, described and tagged."""
    return pipeline.run(l)[0].withColumn("group_tags", F.array_join("group_tags", ","))


@query("one_recording", with_("m e") + "SELECT m.group_id FROM m JOIN e ON e.file_id = m.file_id AND e.source = 'musicbrainz' AND e.mb_recording_id <> '' GROUP BY m.group_id HAVING count(*) >= 2 AND count(DISTINCT e.mb_recording_id) = 1")
def one_recording(l):
    return gr.confirmed_by_one_recording(l.members(), l.enrichment())


@query("group_list_savings", with_("f m g", "k AS (SELECT m.group_id, f.*, coalesce(f.size, 0) AS bytes, coalesce(f.bitrate, 0) AS rate FROM m JOIN f ON f.id = m.file_id)") + """SELECT g.group_id, g.similarity, g.type, g.resolved,
CASE WHEN list_has_any(g.group_tags, ['spectral_exact', 'same_recording', 'cp_exact', 'cp_similar']) THEN array_to_string(g.group_tags, ',') ELSE array_to_string(list_append(g.group_tags, CASE WHEN g.group_tags IS NOT NULL THEN 'fp_diff' END), ',') END AS group_tags,
count(*) AS n_files, (sum(bytes) - coalesce(sum(bytes) FILTER (k.id = g.smart_keep_id), first(bytes ORDER BY rate DESC, id)))::BIGINT AS savings,
first(title ORDER BY rate DESC, id) AS keep_title, first(artist ORDER BY rate DESC, id) AS keep_artist, first(album ORDER BY rate DESC, id) AS keep_album, string_agg(path, '|' ORDER BY path) AS paths
FROM k JOIN g USING (group_id) GROUP BY ALL""")
def group_list_savings(l):
    rows = gr.listed(l.groups(), l.members(), l.files("title", "artist", "album", "path", "bitrate", "size"))
    return rows.withColumn("group_tags", F.coalesce(F.array_join("group_tags", ","), F.lit(None)))


@query("facets", with_("g", "x AS (SELECT DISTINCT group_id, unnest(group_tags) AS tag FROM g)") + "SELECT tag, count(*) AS n_groups, coalesce(nullif(list_position([" + ", ".join(sql.quote(x) for x in gr.TAG_ORDER) + f"], tag), 0), {len(gr.TAG_ORDER) + 1})::INT AS place FROM x WHERE tag IS NOT NULL GROUP BY tag")
def facets(l):
    return gr.facets(l.groups())


_DESCRIBED = f"""d AS (SELECT m.group_id, f.id, coalesce(f.format, '') AS raw_format, upper(coalesce(f.format, '')) AS format, {sql.normalized('f.title')} AS title_key, {sql.normalized('f.artist')} AS artist_key, {sql.normalized('f.album')} AS album_key,
  {sql.kind('f.')} AS kind, CASE WHEN f.album_year > 0 THEN f.album_year END AS year, {sql.filled('f.')} AS filled, CASE WHEN floor(f.duration + 0.5) > 0 THEN floor(f.duration + 0.5) END AS seconds, md5(array_to_string(f.fingerprint, ' ')) AS fp,
  trim(regexp_replace(lower({sql.basename('f.path')}), '\\s+', ' ', 'g')) AS file_name FROM m JOIN f ON f.id = m.file_id, nk)"""


@query("group_types", with_("f m nk", _DESCRIBED + ", a AS (SELECT group_id, min(raw_format) <> max(raw_format) AS formats, min(title_key) = max(title_key) AND min(title_key) <> '' AS title, min(artist_key) = max(artist_key) AND min(artist_key) <> '' AS artist, bool_or(kind = 'single') AS single, bool_or(kind = 'album') AS album FROM d GROUP BY group_id)") + "SELECT group_id, CASE WHEN formats AND title AND artist THEN 'format_diff' WHEN single AND album THEN 'single_vs_album' WHEN title THEN 'format_diff' ELSE 'name_diff' END AS type FROM a")
def group_types(l):
    return gr.types(gr.described(l.members(), l.files()))


_SAME_OF = lambda c: f"min({c}) = max({c})"


@query("group_tags", with_("f m nk", _DESCRIBED + f""", x AS (SELECT *, concat_ws(chr(1), title_key, artist_key, album_key) AS meta FROM d),
a AS (SELECT group_id, count(*) AS n, {_SAME_OF('format')} AS one_format, {_SAME_OF('file_name')} AND min(file_name) <> '' AS one_name, {_SAME_OF('meta')} AS one_meta, max(meta) = chr(1) || chr(1) AS no_meta, min(year) < max(year) AS years,
  min(kind) <> max(kind) AS kinds, min(filled) <> max(filled) AS fills, count(seconds) AS n_seconds, {_SAME_OF('seconds')} AS one_length, count(fp) >= 2 AND {_SAME_OF('fp')} AS exact FROM x GROUP BY group_id)""") + """SELECT group_id, concat_ws(',', CASE WHEN exact THEN 'spectral_exact' END, CASE WHEN NOT one_format THEN 'format_diff' END, CASE WHEN one_format AND n >= 2 THEN 'format_same' END, CASE WHEN n >= 2 AND one_name THEN 'filename_same' END,
CASE WHEN n >= 2 AND NOT no_meta AND one_meta THEN 'metadata_same' END, CASE WHEN n >= 2 AND NOT no_meta AND NOT one_meta THEN 'metadata_diff' END, CASE WHEN years THEN 'release_year_diff' END, CASE WHEN kinds THEN 'release_type_diff' END, CASE WHEN fills THEN 'meta_score_diff' END,
CASE WHEN n_seconds >= 2 AND one_length THEN 'duration_same' END, CASE WHEN n_seconds >= 2 AND NOT one_length THEN 'duration_diff' END) AS group_tags FROM a""")
def group_tags(l):
    return gr.tags(gr.described(l.members(), l.files())).withColumn("group_tags", F.array_join("group_tags", ","))


@query("lane_stripped", with_("g", "x AS (SELECT group_id, list_filter(coalesce(group_tags, []), lambda x: NOT list_contains(['cp_exact', 'cp_similar'], x)) AS tags FROM g)") + "SELECT group_id, array_to_string(list_sort(list_distinct(tags)), ',') AS group_tags FROM x WHERE list_has_any(tags, ['meta_confirmed', 'spectral_exact', 'same_recording', 'cp_exact', 'cp_similar', 'mb_confirmed', 'acoustid_confirmed'])")
def lane_stripped(l):
    return gr.strip_lane(l.groups(), ["cp_exact", "cp_similar"]).select("group_id", F.array_join(F.array_sort("group_tags"), ",").alias("group_tags"))


@query("lane_cleared", with_("g") + "SELECT group_id FROM g WHERE NOT coalesce(list_has_any(group_tags, ['meta_confirmed']), false)")
def lane_cleared(l):
    return gr.clear_lane(l.groups(), ["meta_confirmed"]).select("group_id")


@query("tags_carried", with_("m g", "k AS (SELECT m.group_id, array_to_string(list_sort(list(m.file_id)), ',') AS members FROM m GROUP BY m.group_id)") + "SELECT k.group_id, array_to_string(list_sort(list_filter(list_distinct(coalesce(g.group_tags, [])), lambda x: list_contains(['meta_confirmed', 'spectral_exact', 'same_recording', 'cp_exact', 'cp_similar', 'mb_confirmed', 'acoustid_confirmed'], x))), ',') AS group_tags FROM k JOIN g USING (group_id) WHERE k.members IN (SELECT members FROM k GROUP BY members HAVING count(*) = 1)")
def tags_carried(l):
    old = l.members().join(l.groups().select("group_id", "group_tags"), "group_id")
    new = old.select("group_id", "file_id", F.array().cast("array<string>").alias("group_tags"))
    same = new.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("file_id").cast("decimal(38,0)")).alias("x"))
    once = same.join(same.groupBy("n", "x").count().filter("count = 1").select("n", "x"), ["n", "x"], "left_semi").select("group_id")
    return gr.carry_over(new, old).join(once, "group_id", "left_semi").select("group_id", F.array_join(F.array_sort(F.array_distinct("group_tags")), ",").alias("group_tags"))


# --- statistics and listings ------------------------------------------------------------------------------------------


@query("stats_global", with_("f m g", "s AS (SELECT m.file_id FROM m JOIN g USING (group_id) WHERE m.file_id <> g.smart_keep_id)") + """SELECT count(*) AS n_files, count(DISTINCT nullif(album, '')) AS n_albums, count(DISTINCT nullif(artist, '')) AS n_artists, sum(size)::BIGINT AS bytes, count(meta_extracted_at) AS n_with_meta, count(fingerprint) AS n_with_fp,
(SELECT count(*) FROM s JOIN f ON f.id = s.file_id) AS n_dup_files, (SELECT sum(f.size)::BIGINT FROM s JOIN f ON f.id = s.file_id) AS dup_bytes, (SELECT count(*) FROM g) AS n_groups, (SELECT count(*) FROM g WHERE NOT coalesce(resolved, false)) AS n_pending FROM f WHERE NOT deleted""")
def stats_global(l):
    return lib.statistics(l.files("album", "artist", "size", "meta_extracted_at", "fingerprint", "deleted"), l.groups(), l.members())


@query("format_histogram", with_("f") + "SELECT format, count(*) AS n FROM f WHERE format IS NOT NULL GROUP BY format")
def format_histogram(l):
    return lib.histogram(l.files("format"), "format")


@query("format_top", with_("f") + "SELECT format, count(*) AS n FROM f GROUP BY format ORDER BY n DESC, format NULLS LAST LIMIT 10")
def format_top(l):
    return lib.histogram(l.files("format"), "format", top=10, keep_null=True)


@query("library_stats", with_("f e m", "s AS (SELECT DISTINCT file_id FROM e WHERE title <> '')") + "SELECT count(*) AS n_files, count(DISTINCT album) AS n_albums, sum((has_lyrics)::INT)::BIGINT AS n_lyrics, count(s.file_id) AS n_scraped, (SELECT count(DISTINCT file_id) FROM m) AS n_grouped FROM f LEFT JOIN s ON s.file_id = f.id")
def library_stats(l):
    said = l.enrichment().filter("title <> ''").select(F.col("file_id").alias("id")).distinct().withColumn("said", F.lit(True))
    own = l.files("album", "has_lyrics").join(said, "id", "left").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("album").alias("n_albums"), F.sum(F.col("has_lyrics").cast("bigint")).alias("n_lyrics"), F.count("said").alias("n_scraped"))
    return own.crossJoin(l.members().agg(F.countDistinct("file_id").alias("n_grouped")))  # two single rows


@query("last_scan", with_("f") + "SELECT max(scan_time) AS last_scan FROM f")
def last_scan(l):
    return l.read("files").agg(F.max("scan_time").alias("last_scan"))


@query("work_counts", with_("f") + """SELECT 'second_fingerprint' AS step, count(*) AS n FROM f WHERE NOT deleted AND fingerprint IS NOT NULL AND (chromaprint IS NULL OR chromaprint_raw IS NULL)
UNION ALL SELECT 'metadata', count(*) FROM f WHERE NOT deleted AND (meta_extracted_at IS NULL OR meta_extracted_at < file_mtime) UNION ALL SELECT 'fingerprint', count(*) FROM f WHERE NOT deleted AND (fingerprint IS NULL OR fp_extracted_at IS NULL OR fp_extracted_at < file_mtime)
UNION ALL SELECT 'attribute_match', count(*) FROM f WHERE NOT deleted AND title <> '' UNION ALL SELECT 'text_enrichment', count(*) FROM f WHERE NOT deleted AND title <> '' AND mb_checked_at IS NULL UNION ALL SELECT 'fingerprint_enrichment', count(*) FROM f WHERE NOT deleted AND chromaprint IS NOT NULL AND acoustid_checked_at IS NULL""")
def work_counts(l):
    return lib.work_counts(l.live_files("title", "deleted", "fingerprint", "fp_extracted_at", "meta_extracted_at", "file_mtime", "chromaprint", "chromaprint_raw", "mb_checked_at", "acoustid_checked_at"))


@query("visible_savings", with_("f m g", "k AS (SELECT g.group_id, coalesce(g.resolved, false) AS resolved, sum(coalesce(f.size, 0)) - coalesce(sum(coalesce(f.size, 0)) FILTER (f.id = g.smart_keep_id), first(coalesce(f.size, 0) ORDER BY coalesce(f.bitrate, 0) DESC, f.id)) AS savings FROM m JOIN f ON f.id = m.file_id JOIN g USING (group_id) GROUP BY g.group_id, g.resolved)") + "SELECT resolved, count(*) AS n_groups, sum(savings)::BIGINT AS savings FROM k GROUP BY resolved")
def visible_savings(l):
    rows = gr.listed(l.groups(), l.members(), l.files("title", "artist", "album", "path", "bitrate", "size"))
    return rows.groupBy(F.coalesce("resolved", F.lit(False)).alias("resolved")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("savings").alias("savings"))


@query("page_nulls_last", with_("f") + "SELECT id, album_year FROM f WHERE NOT deleted ORDER BY album_year DESC NULLS LAST, id LIMIT 50 OFFSET 50")
def page_nulls_last(l):
    return lib.page(lib.live(l.live_files("album_year", "deleted")).select("id", "album_year"), lib.order_by("album_year", True), 2, 50)


@query("locate_row", with_("f", "k AS (SELECT id, row_number() OVER (ORDER BY title NULLS LAST, id) - 1 AS position FROM f WHERE NOT deleted)") + "SELECT 1959::BIGINT AS id, coalesce((SELECT position FROM k WHERE id = 1959), -1) AS position")
def locate_row(l):
    return lib.position(l.files("title", "deleted"), 1959)


# --- quality, release type, status ------------------------------------------------------------------------------------


@query("quality_score", with_("f") + f"SELECT id, {sql.tier()} AS tier, round({sql.score()}, 3)::DOUBLE AS score FROM f")
def quality_score(l):
    cols = [F.col(c) for c in ("format", "bitrate", "sample_rate", "bits_per_sample")]
    return l.files("format", "bitrate", "sample_rate", "bits_per_sample").select("id", q.quality_tier(*cols).alias("tier"), F.round(q.quality_score(*cols), 3).alias("score"))


@query("release_type", with_("f") + f"SELECT id, {sql.kind()} AS kind, {sql.kind_score()} AS score FROM f")
def release_type(l):
    return l.files("release_type", "album").select("id", q.release_type(F.col("release_type"), F.col("album")).alias("kind"), q.release_score(F.col("release_type"), F.col("album")).alias("score"))


@query("completeness", with_("f") + f"SELECT id, {sql.filled()} AS filled FROM f")
def completeness(l):
    names = ("title", "artist", "album", "album_year", "track_number", "genre")
    return l.files(*names).select("id", q.completeness(*[F.col(n) for n in names]).alias("filled"))


@query("status_tier", with_("f e", sql.BOTH) + f"SELECT id, {sql.status('', 'mb_')} AS mb_tier, {sql.status('', 'aid_')} AS aid_tier FROM x")
def status_tier(l):
    return en.tiers(re_.enriched(l.files(), l.enrichment())).select("id", "mb_tier", "aid_tier")


_FIRST = f"x2 AS (SELECT *, {sql.status('', 'mb_')} AS mb_tier, {sql.status('', 'aid_')} AS aid_tier, aid_scraped_at IS NOT NULL AS aid_there, mb_scraped_at IS NOT NULL AS mb_there FROM x),\nx3 AS (SELECT *, aid_there AND (NOT mb_there OR {sql.rank('aid_tier')} <= {sql.rank('mb_tier')}) AS first FROM x2)"
_PICK = lambda c, w: f"CASE WHEN {'first' if w else 'NOT first'} THEN aid_{c} ELSE mb_{c} END"
_NUM = lambda c: f"CASE WHEN aid_there AND mb_there THEN CASE WHEN nullif({_PICK(c, 1)}, 0) = nullif({c}, 0) THEN {_PICK(c, 1)} WHEN nullif({_PICK(c, 0)}, 0) = nullif({c}, 0) THEN {_PICK(c, 0)} ELSE coalesce(nullif({_PICK(c, 1)}, 0), nullif({_PICK(c, 0)}, 0), 0) END ELSE {_PICK(c, 1)} END"


@query("dual_merge", with_("f e", sql.BOTH + ",\n" + _FIRST) + f"SELECT id, {_PICK('title', 1)} AS title, {_NUM('album_year')} AS album_year, {_NUM('track_number')} AS track_number, CASE WHEN aid_there OR mb_there THEN CASE WHEN first THEN 'acoustid' ELSE 'musicbrainz' END ELSE 'none' END AS source FROM x3")
def dual_merge(l):
    rows = en.tiers(re_.enriched(l.files(), l.enrichment()))
    return rows.select("id", F.col("best_title").alias("title"), F.col("best_album_year").alias("album_year"), F.col("best_track_number").alias("track_number"), F.col("scrape_source").alias("source"))


@query("sort_rank", with_("f e", sql.BOTH) + f"SELECT id, {sql.status('', 'mb_')} AS tier FROM x WHERE NOT deleted ORDER BY {sql.rank(sql.status('', 'mb_'))}, id LIMIT 100")
def sort_rank(l):
    rows = en.tiers(re_.enriched(l.files(), l.enrichment())).withColumn("tier", F.col("mb_tier"))
    return lib.query(rows, order=lib.by_tier(rows)).select("id", "tier").limit(100)


@query("tier_filter", with_("f e", sql.BOTH) + f"SELECT id FROM x WHERE NOT deleted AND {sql.status('', 'mb_')} IS NULL")
def tier_filter(l):
    return lib.query(en.tiers(re_.enriched(l.files(), l.enrichment())).withColumn("tier", F.col("mb_tier")), tier="none").select("id")


# --- retention --------------------------------------------------------------------------------------------------------

_AID = "coalesce(mb_match_basis, '') <> 'exact' AND coalesce(aid_match_basis, '') = 'exact'"
_VERIFIED = "(coalesce(mb_match_basis, '') = 'exact' OR coalesce(aid_match_basis, '') = 'exact')"
_SAID = lambda c: f"CASE WHEN {_AID} THEN aid_{c} ELSE mb_{c} END"
_RAW_GENRE = "x AS (SELECT f.*, " + ", ".join(f"{p}.{c} AS {p}_{c}" for p in ("mb", "aid") for c in ("mb_recording_id", "title", "artist", "album", "album_year", "track_number", "genre", "duration", "match_basis", "scraped_at")) + f" {_TWO})"
_SAME = [f"coalesce({c} <> '' AND {_SAID(c)} <> '' AND {sql.narrow(c)} = {sql.narrow(_SAID(c))}, false)::INT" for c in ("title", "artist", "album")] + [f"coalesce({c} <> 0 AND {_SAID(c)} <> 0 AND {c} = {_SAID(c)}, false)::INT" for c in ("album_year", "track_number")] + [f"coalesce(genre <> '' AND {_SAID('genre')} <> '' AND {sql.normal('genre')} = {sql.normal(_SAID('genre'))}, false)::INT"]
_SCORED = f"""{_RAW_GENRE},
s AS (SELECT m.group_id, m.file_id, x.duration, x.album_year, x.file_ctime, x.bitrate, x.format, x.album, {sql.kind('x.')} AS kind, {sql.score('x.')} AS quality, {sql.filled('x.')} AS filled, {sql.kind_score('x.')} AS kind_score, {_VERIFIED} AS verified,
  CASE WHEN {_VERIFIED} THEN {' + '.join(_SAME)} ELSE 0 END AS agreed, nullif(x.mb_mb_recording_id, '') AS recording,
  CASE WHEN mb_match_basis = 'exact' AND mb_duration > 0 THEN mb_duration END AS mb_seconds, CASE WHEN aid_match_basis = 'exact' AND aid_duration > 0 THEN aid_duration END AS aid_seconds
  FROM m JOIN x ON x.id = m.file_id),
d AS (SELECT *, coalesce(first_value(mb_seconds IGNORE NULLS) OVER o, first_value(aid_seconds IGNORE NULLS) OVER o) AS reference, count(*) OVER (PARTITION BY group_id) AS n_members
  FROM s WINDOW o AS (PARTITION BY group_id ORDER BY coalesce(bitrate, 0) DESC, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t0 AS (SELECT *, CASE WHEN duration > 0 THEN abs(duration - reference) END AS deviation, true AS alive, NULL::VARCHAR AS decided_by FROM d)"""
_TIER_SQL = {
    "scrape_best": ("verified", "agreed"), "quality_best": ("true", "quality"), "ctime_best": ("coalesce(file_ctime > 0, false)", "file_ctime"), "release_best": ("coalesce(album_year > 0, false)", "-album_year"),
    "album_best": ("kind_score > 0", "kind_score"), "meta_best": ("true", "filled"), "duration_accurate": ("deviation IS NOT NULL", "0 - floor(deviation / 3)"),
}


def _cascade_sql() -> str:
    steps = []
    for n, name in enumerate(Config().retention_order):
        applies, score = _TIER_SQL[name]
        gate = "count(DISTINCT CASE WHEN ap THEN recording END) OVER (PARTITION BY group_id) = 1" if name == "scrape_best" else "true"
        steps.append(f"""a{n} AS (SELECT *, alive AND {applies} AS ap, CASE WHEN alive AND {applies} THEN ({score})::DOUBLE END AS sc FROM t{n}),
b{n} AS (SELECT *, coalesce({gate}, false) AND count(*) FILTER (alive) OVER p > 1 AND coalesce(min(sc) OVER p < max(sc) OVER p, false) AS op, max(sc) OVER p AS top FROM a{n} WINDOW p AS (PARTITION BY group_id)),
c{n} AS (SELECT *, alive AND (NOT op OR NOT ap OR sc = top) AS st FROM b{n}),
t{n + 1} AS (SELECT * EXCLUDE (ap, sc, op, top, st, alive, decided_by), st AS alive, CASE WHEN decided_by IS NULL AND op AND count(*) FILTER (st) OVER (PARTITION BY group_id) = 1 THEN '{name}' ELSE decided_by END AS decided_by FROM c{n})""")
    return ",\n".join(steps)


def _retained(l) -> DataFrame:
    return re_.annotated(l.members(), re_.enriched(l.files(), l.enrichment()))


@query("retention_cascade", with_("f e m", _SCORED + ",\n" + _cascade_sql()) + "SELECT group_id, file_id, alive, decided_by FROM t7")
def retention_cascade(l):
    return re_.cascade(_retained(l), Config().retention_order).select("group_id", "file_id", "alive", "decided_by")


@query("keep_set", with_("f e m r", _SCORED + ",\n" + _cascade_sql()) + "SELECT group_id, t7.file_id FROM t7 LEFT JOIN r ON r.file_id = t7.file_id WHERE (alive OR coalesce(r.keep, false)) AND coalesce(r.keep, true)")
def keep_set(l):
    return re_.winners(_retained(l), l.overrides()).filter("keep").select("group_id", "file_id")


_REASON = """CASE decided_by WHEN 'scrape_best' THEN 'scrape_best: ' || agreed || '/6' WHEN 'quality_best' THEN 'quality_best: ' || concat_ws(' ', upper(format), coalesce(bitrate, 0) || 'k') WHEN 'ctime_best' THEN 'ctime_best: ' || strftime(make_timestamp(file_ctime * 1000), '%Y-%m-%d')
WHEN 'release_best' THEN 'release_best: ' || album_year WHEN 'album_best' THEN 'album_best: ' || kind WHEN 'meta_best' THEN 'meta_best: ' || filled || '/6' WHEN 'duration_accurate' THEN 'duration_accurate: ' || floor(duration + 0.5)::BIGINT || 's' END"""
_WHY = f"""y AS (SELECT t7.*, coalesce(r.keep, false) AS manual, coalesce(NOT r.keep, false) AS excluded, CASE WHEN n_members = 1 THEN 'only_version' WHEN decided_by IS NOT NULL THEN {_REASON} WHEN count(*) FILTER (alive) OVER (PARTITION BY group_id) > 1 THEN 'tie' END AS smart FROM t7 LEFT JOIN r ON r.file_id = t7.file_id)"""


@query("keep_reasons", with_("f e m r", _SCORED + ",\n" + _cascade_sql() + ",\n" + _WHY) + "SELECT group_id, file_id, (alive OR manual) AND NOT excluded AS keep, CASE WHEN excluded THEN NULL WHEN alive AND manual THEN coalesce(smart, 'tie') || '+manual_keep' WHEN alive THEN smart WHEN manual THEN 'manual_keep' END AS reason FROM y")
def keep_reasons(l):
    return re_.winners(_retained(l), l.overrides()).select("group_id", "file_id", "keep", "reason")


@query("album_tie_break", with_("f e m", _SCORED + ",\n" + _cascade_sql() + """,
l AS (SELECT album, count(*) AS n FROM f WHERE NOT deleted AND album <> '' GROUP BY album),
u AS (SELECT t7.*, CASE WHEN alive THEN coalesce(l.n, 0) END AS n FROM t7 LEFT JOIN l USING (album)),
v AS (SELECT *, count(*) FILTER (alive) OVER w > 1 AND max(n) OVER w > 0 AS able, n = max(n) OVER w AS top FROM u WINDOW w AS (PARTITION BY group_id)),
z AS (SELECT *, able AND count(*) FILTER (top) OVER (PARTITION BY group_id) = 1 AS settled FROM v)""") + "SELECT group_id, file_id, alive AND (NOT settled OR coalesce(top, false)) AS keep, CASE WHEN settled THEN 'local_album' ELSE decided_by END AS decided_by FROM z")
def album_tie_break(l):
    """What the cascade leaves tied goes to the member of whose album the library has most files."""
    albums = lib.live(l.live_files("album", "deleted")).filter("album <> ''")
    counts = l.files("album").join(albums.groupBy("album").agg(F.count(F.lit(1)).alias("n")), "album").select(F.col("id").alias("file_id"), "n")
    return re_.winners(_retained(l), None, album_counts=counts).select("group_id", "file_id", "keep", "decided_by")


@query("keep_toggles", with_("f e m r", _SCORED + ",\n" + _cascade_sql() + ", k AS (SELECT file_id, bool_or(alive) AS alive FROM t7 GROUP BY file_id)") + f"SELECT k.file_id, r.keep, {NOW}::BIGINT AS added_time FROM k JOIN r ON r.file_id = k.file_id WHERE r.keep <> k.alive")
def keep_toggles(l):
    """The overrides still needed to follow the list of wishes."""
    return re_.toggle_keeps(re_.winners(_retained(l)), l.overrides(), NOW).select("file_id", "keep", "added_time")


_SPARE = "q AS (SELECT DISTINCT t7.file_id FROM t7 JOIN g USING (group_id) LEFT JOIN r ON r.file_id = t7.file_id WHERE {} coalesce(g.resolved, false) AND NOT ((alive OR coalesce(r.keep, false)) AND coalesce(r.keep, true)))"


@query("resolved_files", with_("f e m g r", _SCORED + ",\n" + _cascade_sql() + ",\n" + _SPARE.format("NOT")) + "SELECT id, deleted OR id IN (SELECT file_id FROM q) AS deleted FROM f")
def resolved_files(l):
    """All pending groups resolved."""
    kept = re_.winners(_retained(l), l.overrides()).filter("keep")
    return st.resolve(l.files("deleted"), l.members(), l.groups(), kept)[0].select("id", "deleted")


@query("resolved_groups", with_("f e m g r", _SCORED + ",\n" + _cascade_sql() + ",\nh AS (SELECT DISTINCT group_id FROM t7 LEFT JOIN r ON r.file_id = t7.file_id WHERE NOT ((alive OR coalesce(r.keep, false)) AND coalesce(r.keep, true)))") + f"SELECT group_id, CASE WHEN NOT coalesce(resolved, false) AND group_id IN (SELECT group_id FROM h) THEN true ELSE resolved END AS resolved, CASE WHEN NOT coalesce(resolved, false) AND group_id IN (SELECT group_id FROM h) THEN {NOW} ELSE resolved_time END AS resolved_time FROM g")
def resolved_groups(l):
    kept = re_.winners(_retained(l), l.overrides()).filter("keep")
    return st.resolve(l.files("deleted"), l.members(), l.groups(), kept, now=NOW)[1].select("group_id", "resolved", "resolved_time")


@query("unresolved_files", with_("f e m g r", _SCORED + ",\n" + _cascade_sql() + ",\n" + _SPARE.format("")) + "SELECT id, deleted AND id NOT IN (SELECT file_id FROM q) AS deleted FROM f")
def unresolved_files(l):
    """All resolved groups pending again."""
    kept = re_.winners(_retained(l), l.overrides()).filter("keep")
    return st.unresolve(l.files("deleted"), l.members(), l.groups(), kept)[0].select("id", "deleted")


@query("duration_reference", with_("f e m", _SCORED) + "SELECT group_id, file_id, reference, round(deviation, 4)::DOUBLE AS deviation, deviation <= 3 AS accurate FROM t0")
def duration_reference(l):
    return _retained(l).select("group_id", "file_id", "reference", F.round("deviation", 4).alias("deviation"), "accurate")


_CT, _YR = "coalesce(file_ctime, 0)", "CASE WHEN album_year > 0 THEN album_year END"
_BEST = f"""v AS (SELECT *, min(quality) OVER w < max(quality) OVER w AND quality = max(quality) OVER w AS q, min({_CT}) OVER w < max({_CT}) OVER w AND {_CT} = max({_CT}) OVER w AS c, max(agreed) OVER w > 0 AND verified AND agreed = max(agreed) OVER w AS s,
  min(kind_score) OVER w < max(kind_score) OVER w AND kind_score = max(kind_score) OVER w AS a, min(nullif(album_year, 0)) OVER w < max(nullif(album_year, 0)) OVER w AND {_YR} = min({_YR}) OVER w AS y, min(filled) OVER w < max(filled) OVER w AND filled = max(filled) OVER w AS e,
  deviation <= 3 AND NOT coalesce(bool_and(CASE WHEN duration > 0 THEN deviation <= 3 END) OVER w, true) AS d FROM t0 WINDOW w AS (PARTITION BY group_id))"""


@query("dimension_best", with_("f e m", _SCORED + ",\n" + _BEST) + "SELECT group_id, file_id, CASE WHEN n_members > 1 THEN concat_ws(',', CASE WHEN q THEN 'quality_best' END, CASE WHEN c THEN 'ctime_best' END, CASE WHEN s THEN 'scrape_best' END, CASE WHEN a THEN 'album_best' END, CASE WHEN y THEN 'release_best' END, CASE WHEN e THEN 'meta_best' END, CASE WHEN d THEN 'duration_accurate' END) ELSE '' END AS tags FROM v")
def dimension_best(l):
    return re_.dimension_tags(_retained(l)).select("group_id", "file_id", F.array_join("pick_tags", ",").alias("tags"))


_CELLS = "h AS (" + " UNION ALL ".join(f"SELECT group_id, file_id, '{k}' AS dimension, CASE WHEN {a} THEN ({v})::DOUBLE END AS score FROM t0" for k, (a, v) in _TIER_SQL.items()) + ")"


@query("comparison", with_("f e m", _SCORED + ",\n" + _CELLS) + "SELECT group_id, file_id, dimension, round(score, 4)::DOUBLE AS score, coalesce(score = max(score) OVER w AND min(score) OVER w < max(score) OVER w, false) AS best FROM h WINDOW w AS (PARTITION BY group_id, dimension)")
def comparison(l):
    return re_.comparison(_retained(l)).select("group_id", "file_id", "dimension", F.round("score", 4).alias("score"), "best")


# --- enrichment -------------------------------------------------------------------------------------------------------


@query("candidate_rank")
def candidate_rank(l):
    found = lib.live(l.live_files("title", "artist", "album", "duration", "track_number", "deleted"))
    return en.candidates(en.search(found, l.catalogue())).select("file_id", "rec_id", "rank", "total", "basis", "genre", "album_year")


@query("enrich_offline")
def enrich_offline(l):
    found = lib.live(l.live_files("title", "artist", "album", "duration", "track_number", "deleted"))
    return en.enrich(found, l.catalogue()).select("file_id", "rec_id", "title", "artist", "album", "album_year", "track_number", "genre", "duration", "match_basis")


@query("lookup_rank")
def lookup_rank(l):
    """The catalogue in the place of the fingerprint service: records within 2 s are hits of 0.9, within 5 s of 0.75."""
    rows = l.files("title", "artist", "album", "duration").filter("duration > 0")
    hits = en.search(rows.withColumn("track_number", F.lit(0)), l.catalogue())
    gap = F.abs(F.col("duration") - F.coalesce(F.col("length_ms") / 1000, "duration_s"))
    return en.lookup(rows, hits.select(F.col("id").alias("file_id"), "rec_id", F.when(gap <= 2, 0.9).when(gap <= 5, 0.75).otherwise(0.5).alias("hit"), "rec_title", "artists", "releases"))


@query("release_pick", with_("c", "u AS (SELECT rec_id, r.status IS DISTINCT FROM 'Official' AS other, coalesce(nullif(try_cast(regexp_extract(r.date, '^\\s*(\\d{1,9})', 1) AS INT), 0), 9999) AS y, r.i AS i, r.id AS release_id FROM (SELECT rec_id, unnest(list_transform(releases, lambda r, i: {'id': r.id, 'status': r.status, 'date': r.date, 'i': i})) AS r FROM c))") + "SELECT rec_id, release_id FROM u QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY other, y, i) = 1")
def release_pick(l):
    picked = en.pick_release(F.col("releases"), F.lit(None).cast("string"))["release"]["id"]
    return l.catalogue().filter(F.size("releases") > 0).select("rec_id", picked.alias("release_id"))


_CLEAN = lambda c: f"nullif(nullif({c}::VARCHAR, ''), '0')"
_KEY = lambda c: f"CASE WHEN {_CLEAN(c)} IS NOT NULL THEN {sql.wide(_CLEAN(c))} END"
_CHOICE = lambda c: f"SELECT id AS file_id, '{c}' AS field, {_CLEAN(c)} AS o, {_CLEAN('mb_' + c)} AS m, {_CLEAN('aid_' + c)} AS a, {_KEY(c)} AS ko, {_KEY('mb_' + c)} AS km, {_KEY('aid_' + c)} AS ka FROM x"


@query("field_choices", with_("f e", _RAW_GENRE + ",\nh AS (" + " UNION ALL ".join(_CHOICE(c) for c in ("title", "artist", "album", "album_year", "track_number", "genre")) + ")") + """SELECT file_id, field, CASE WHEN coalesce(ko = km, false) OR coalesce(ko = ka, false) THEN 'match' WHEN o IS NULL AND NOT coalesce(km <> ka, false) THEN 'recommend' ELSE 'judge' END AS state,
CASE WHEN coalesce(ko = ka, false) THEN 'acoustid' WHEN coalesce(ko = km, false) THEN 'musicbrainz' WHEN a IS NOT NULL THEN 'acoustid' WHEN m IS NOT NULL THEN 'musicbrainz' END AS source, coalesce(km <> ka, false) AS conflict FROM h WHERE m IS NOT NULL OR a IS NOT NULL""")
def field_choices(l):
    return en.field_choices(re_.enriched(l.files(), l.enrichment()))


@query("source_stats", with_("f e", _RAW_GENRE) + " UNION ALL ".join(
    f"SELECT id AS file_id, '{name}' AS source, " + " + ".join([f"coalesce({p}_{c} <> '', false)::INT" for c in ("title", "artist", "album", "genre")] + [f"coalesce({p}_{c} > 0, false)::INT" for c in ("album_year", "track_number", "duration")]) + " AS n_has, "
    + " + ".join([f"coalesce({p}_{c} <> '' AND {sql.wide(c)} = {sql.wide(p + '_' + c)} AND {c} IS NOT NULL, false)::INT" for c in ("title", "artist", "album", "genre")] + [f"coalesce({p}_{c} > 0 AND {c} = {p}_{c}, false)::INT" for c in ("album_year", "track_number")] + [f"coalesce({p}_duration > 0 AND abs(duration - {p}_duration) <= 3, false)::INT"]) + f" AS n_match FROM x WHERE {p}_scraped_at IS NOT NULL"
    for p, name in (("mb", "musicbrainz"), ("aid", "acoustid"))))
def source_stats(l):
    return en.source_stats(re_.enriched(l.files(), l.enrichment()))


_CF = ("title", "artist", "album", "album_year", "track_number", "genre")
_GIVE = "v AS (SELECT m.group_id, m.file_id, " + ", ".join(f"nullif(nullif({c}::VARCHAR, ''), '0') AS {c}" for c in _CF) + " FROM m JOIN f ON f.id = m.file_id)"
_AFF = " + ".join(f"coalesce(t.{c} = g.{c}, false)::INT" for c in _CF)


@query("cross_fill", with_("f m", _GIVE) + " UNION ALL ".join(f"(SELECT t.group_id, t.file_id, '{c}' AS field, g.file_id AS from_id, g.{c} AS value FROM v t JOIN v g ON g.group_id = t.group_id WHERE t.{c} IS NULL AND g.{c} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t.group_id, t.file_id ORDER BY {_AFF} DESC, g.file_id) = 1)" for c in _CF))
def cross_fill(l):
    return en.cross_fill(l.members(), l.files(*_CF))


@query("miss_reasons", "SELECT coalesce(match_basis, 'none') AS reason, count(*) AS n FROM (SELECT DISTINCT * FROM scraped_meta) GROUP BY 1")
def miss_reasons(l):
    rows = l.read("scraped_meta").distinct()
    return rows.groupBy(F.coalesce("match_basis", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("lookup_misses", with_("f e", "k AS (SELECT f.id, acoustid_checked_at, chromaprint, (SELECT count(*) FROM e WHERE e.file_id = f.id AND e.source = 'acoustid') AS n FROM f)") + "SELECT CASE WHEN acoustid_checked_at IS NULL THEN 'network-error' ELSE 'no-results' END AS reason, count(*) AS n, acoustid_checked_at IS NOT NULL AS settled, acoustid_checked_at IS NULL AS transient FROM k WHERE chromaprint IS NOT NULL AND (acoustid_checked_at IS NULL OR n = 0) GROUP BY ALL")
def lookup_misses(l):
    """Files with a second fingerprint as lookups: never answered where they were not checked, else with what the source knows."""
    hits = l.enrichment().filter("source = 'acoustid'").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_results"))
    asked = l.files("chromaprint", "acoustid_checked_at").filter("chromaprint IS NOT NULL").join(hits.withColumnRenamed("file_id", "id"), "id", "left")
    return en.miss_histogram(asked.select(F.lit(None).cast("int").alias("code"), F.lit(None).cast("string").alias("message"), F.when(F.col("acoustid_checked_at").isNotNull(), 200).alias("status"), F.coalesce("n_results", F.lit(0)).alias("n_results")))


# --- scalar functions --------------------------------------------------------------------------------------------------


@query("title_clean", with_("f nk") + f"SELECT f.id, {sql.cleaned('f.title')} AS clean FROM f, nk")
def title_clean(l):
    return l.files("title").select("id", t.clean_title(F.col("title")).alias("clean"))


@query("title_from_path", with_("f nk", sql.TITLES) + "SELECT id, clean AS title FROM ft")
def title_from_path(l):
    return l.files("title", "path").select("id", t.title_of(F.col("title"), F.col("path")).alias("title"))


@query("text_keys", with_("f") + f"SELECT id, {sql.narrow('title')} AS narrow, {sql.wide('title')} AS wide FROM f")
def text_keys(l):
    return l.files("title").select("id", t.narrow_key(F.col("title")).alias("narrow"), t.wide_key(F.col("title")).alias("wide"))


@query("path_parts", with_("f") + r"SELECT id, regexp_replace(regexp_extract(coalesce(path, ''), '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1') AS name, lower(regexp_extract(path, '\.([^.]*)$', 1)) AS ext FROM f")
def path_parts(l):
    return l.files("path").select("id", t.basename(F.col("path")).alias("name"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("ext"))


@query("display_values", with_("f") + r"SELECT id, (floor(floor(duration + 0.5) / 60)::BIGINT)::VARCHAR || ':' || lpad((floor(duration + 0.5)::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM f WHERE duration > 0")
def display_values(l):
    return l.files("duration").filter("duration > 0").select("id", t.clock(F.col("duration")).alias("clock"))


@query("album_years", with_("c", "u AS (SELECT rec_id, unnest(releases) AS r FROM c)") + r"SELECT rec_id, r.id AS release_id, trim(regexp_replace(coalesce(r.title, ''), '[\(\[]\d{4}[\)\]]\s*$', '')) AS album, coalesce(try_cast(regexp_extract(r.date, '^\s*(\d{1,9})', 1) AS INT), 0) AS year FROM u")
def album_years(l):
    rows = l.catalogue().select("rec_id", F.explode("releases").alias("r"))
    return rows.select("rec_id", F.col("r.id").alias("release_id"), t.album_key(F.col("r.title")).alias("album"), t.leading_int(F.col("r.date")).alias("year"))


# --- storage ------------------------------------------------------------------------------------------------------------


@query("upsert_last_wins", with_("e") + "SELECT file_id, source, title, scraped_at FROM e")
def upsert_last_wins(l):
    return l.enrichment().select("file_id", "source", "title", "scraped_at")


@query("upsert_files", with_("f", "n AS (SELECT id, title FROM f WHERE album_year > 2015)") + "SELECT f.id, CASE WHEN n.id IS NOT NULL THEN coalesce(n.title, f.title) ELSE f.title END AS title, CASE WHEN n.id IS NOT NULL THEN false ELSE f.deleted END AS deleted FROM f LEFT JOIN n ON n.id = f.id")
def upsert_files(l):
    old = l.files("title", "deleted", "album_year")
    return st.upsert(old.drop("album_year"), old.filter("album_year > 2015").select("id", "title"), "id", deleted=False)


@query("soft_delete", with_("f g") + "SELECT id, deleted OR id IN (SELECT smart_keep_id FROM g WHERE smart_keep_id IS NOT NULL) AS deleted FROM f")
def soft_delete(l):
    return st.soft_delete(l.files("deleted"), l.groups().filter("smart_keep_id IS NOT NULL").select(F.col("smart_keep_id").alias("id")))


@query("cascade_delete", with_("f m g", "k AS (SELECT id FROM f WHERE NOT deleted AND NOT starts_with(path, '/srv/'))") + "SELECT 'dup_groups' AS name, count(smart_keep_id) AS n FROM g WHERE smart_keep_id IS NULL OR smart_keep_id NOT IN (SELECT id FROM k) UNION ALL SELECT 'files', count(*) FROM f WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT 'group_tracks', count(*) FROM m WHERE file_id NOT IN (SELECT id FROM k)")
def cascade_delete(l):
    rows = l.files("path", "deleted")
    left = st.cascade_delete({"files": rows, "group_tracks": l.members(), "dup_groups": l.groups()}, rows.filter(F.col("path").startswith("/srv/")))
    count = lambda n, c: left[n].agg(F.count(c).alias("n")).select(F.lit(n).alias("name"), "n")
    return count("dup_groups", F.col("smart_keep_id")).unionByName(count("files", F.lit(1))).unionByName(count("group_tracks", F.lit(1)))


@query("ttl_purge", with_("r") + f"SELECT file_id FROM r WHERE added_time + {30 * 86_400_000} > {NOW} OR added_time IS NULL")
def ttl_purge(l):
    return st.purge_expired(l.overrides().withColumn("expires_at", F.col("added_time") + 30 * 86_400_000), NOW).select("file_id")


@query("snapshot_merge", with_("f", "s AS (SELECT id, concat('* ', title) AS title FROM f WHERE format = 'FLAC')") + "SELECT id, title FROM s UNION ALL SELECT id, title FROM f WHERE id NOT IN (SELECT id FROM s)")
def snapshot_merge(l):
    rows = l.files("title", "format")
    return st.merge_snapshot(rows.select("id", "title"), rows.filter("format = 'FLAC'").select("id", F.concat(F.lit("* "), F.coalesce("title", F.lit(""))).alias("title")), ["id"])


@query("trash_purge", with_("f m g", "x AS (SELECT group_id FROM g WHERE resolved), d AS (SELECT m.group_id, m.file_id FROM m JOIN f ON f.id = m.file_id WHERE f.deleted AND m.group_id IN (SELECT group_id FROM x)), k AS (SELECT DISTINCT file_id FROM d WHERE file_id NOT IN (SELECT file_id FROM m WHERE group_id NOT IN (SELECT group_id FROM x)))") + "SELECT id FROM f WHERE id NOT IN (SELECT file_id FROM k)")
def trash_purge(l):
    return st.purge_trash(l.files("deleted"), l.members(), l.groups(), lib.resolved(l.groups(), True))[0].select("id")


_EDITS = "w AS (SELECT file_id, album_year, genre FROM e WHERE source = 'musicbrainz')"


@query("write_fields", with_("f e", _EDITS) + "SELECT f.id, coalesce(CASE WHEN w.album_year > 0 THEN w.album_year END, f.album_year) AS album_year, coalesce(nullif(w.genre, ''), f.genre) AS genre FROM f LEFT JOIN w ON w.file_id = f.id")
def write_fields(l):
    edits = l.enrichment().filter("source = 'musicbrainz'").select("file_id", "album_year", "genre")
    empty = l.spark.createDataFrame([], st.HISTORY)
    return st.write_fields(l.files("album_year", "genre"), empty, edits, ["album_year", "genre"], NOW)[0]


@query("write_history", with_("f e", _EDITS) + "SELECT f.id AS file_id, concat_ws(',', CASE WHEN w.album_year > 0 AND w.album_year IS DISTINCT FROM f.album_year THEN 'album_year' END, CASE WHEN w.genre <> '' AND w.genre IS DISTINCT FROM f.genre THEN 'genre' END) AS fields, coalesce(f.genre, '') AS old_genre, 1 AS write_count FROM f JOIN w ON w.file_id = f.id WHERE (w.album_year > 0 AND w.album_year IS DISTINCT FROM f.album_year) OR (w.genre <> '' AND w.genre IS DISTINCT FROM f.genre)")
def write_history(l):
    edits = l.enrichment().filter("source = 'musicbrainz'").select("file_id", "album_year", "genre")
    history = st.write_fields(l.files("album_year", "genre"), l.spark.createDataFrame([], st.HISTORY), edits, ["album_year", "genre"], NOW)[1]
    return history.select("file_id", F.array_join("modified_fields", ",").alias("fields"), F.col("original_tags")["genre"].alias("old_genre"), "write_count")


@query("history_list", with_("f e", _EDITS) + f"SELECT f.id AS file_id, f.title AS cur_title, f.album AS cur_album, {NOW}::BIGINT AS last_written_at FROM f JOIN w ON w.file_id = f.id WHERE (w.album_year > 0 AND w.album_year IS DISTINCT FROM f.album_year) OR (w.genre <> '' AND w.genre IS DISTINCT FROM f.genre)")
def history_list(l):
    """What was written, with the files as they are."""
    edits = l.enrichment().filter("source = 'musicbrainz'").select("file_id", "album_year", "genre")
    history = st.write_fields(l.files("album_year", "genre"), l.spark.createDataFrame([], st.HISTORY), edits, ["album_year", "genre"], NOW)[1]
    return st.listed_history(history, l.files("title", "artist", "album")).select("file_id", "cur_title", "cur_album", F.col("last_written_at").cast("bigint").alias("last_written_at"))


@query("snapshot_list", with_("f e", "k AS (SELECT e.file_id, e.scraped_at, f.path, f.title FROM e JOIN f ON f.id = e.file_id WHERE e.match_basis = 'exact' AND e.source = 'acoustid')") + "SELECT file_id, scraped_at AS snapshot_time, path, title FROM k ORDER BY scraped_at DESC NULLS LAST, file_id LIMIT 100")
def snapshot_list(l):
    """The last hundred snapshots that were written, here the exact answers of a source."""
    taken = l.enrichment().filter("source = 'acoustid'").select("file_id", F.col("scraped_at").alias("snapshot_time"), F.when(F.col("match_basis") == "exact", "written").otherwise("pending").alias("status"))
    return st.listed_snapshots(taken, l.files("path", "title", "artist")).select("file_id", "snapshot_time", "path", "title")


@query("tag_renamed", with_("g") + "SELECT group_id, array_to_string(list_transform(group_tags, lambda x: CASE WHEN x = 'album_year_diff' THEN 'release_year_diff' ELSE x END), ',') AS group_tags FROM g")
def tag_renamed(l):
    return gr.rename_tag(l.groups(), "album_year_diff", "release_year_diff").select("group_id", F.array_join("group_tags", ",").alias("group_tags"))


@query("override_changes", with_("r") + "SELECT file_id, NOT keep AS keep FROM r WHERE keep UNION ALL SELECT file_id, keep FROM r WHERE NOT keep AND reason IS NOT NULL")
def override_changes(l):
    rows = l.overrides()
    flipped = rows.filter("keep").withColumn("keep", ~F.col("keep")).unionByName(rows.filter("NOT keep AND reason IS NULL").withColumn("keep", F.lit(None).cast("boolean")))
    return st.override(rows, flipped).select("file_id", "keep")


# --- sound --------------------------------------------------------------------------------------------------------------


@query("fingerprint_pcm")
def fingerprint_pcm(l):
    return sine_files(l.ids()).select("id", F.size("fingerprint").alias("n_words"), F.xxhash64("fingerprint").alias("hash"))
