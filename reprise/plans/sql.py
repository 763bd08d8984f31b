"""Common table expressions for the SQL twins of the queries (DuckDB dialect)."""

from __future__ import annotations

import unicodedata

from ..functions import quality as q
from ..functions.text import ARTIST_SEPARATOR, NARROW_MARKS, NOISE, SPACE, WIDE_MARKS

ENRICHMENT_ORDER = "scraped_at DESC NULLS LAST, " + ", ".join(f"{c} DESC NULLS LAST" for c in ("mb_recording_id", "mb_release_id", "title", "artist", "album", "genre", "album_year", "track_number", "duration", "confidence", "match_basis"))

def _decompositions() -> str:
    """What characters decompose into, from the standard library's tables; syllables of Hangul, of which none are in titles here, and compatibility ideographs stay."""
    listed = (chr(c) for c in range(0x80, 0x2F800) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4 and not 0xF900 <= c < 0xFB00)
    return ", ".join(f"{quote(c)}: {quote(d)}" for c in listed if (d := unicodedata.normalize("NFKD", c)) != c)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PARTS = {
    "nk": f"SELECT MAP {{{_decompositions()}}} AS nk",
    "f": "SELECT DISTINCT ON (id) * FROM files",
    "g": "SELECT DISTINCT ON (group_id) * FROM dup_groups",
    "m": "SELECT DISTINCT group_id, file_id FROM group_tracks WHERE file_id IS NOT NULL AND group_id IN (SELECT group_id FROM dup_groups)",
    "r": "SELECT DISTINCT ON (file_id) * FROM retention_list",
    "e": f"SELECT * FROM scraped_meta QUALIFY row_number() OVER (PARTITION BY file_id, source ORDER BY {ENRICHMENT_ORDER}) = 1",
    "c": "SELECT DISTINCT ON (rec_id) * FROM catalogue",
}


def with_(names: str, more: str = "", recursive: bool = False) -> str:
    """``WITH`` of the named parts, and further ones."""
    parts = [f"{n} AS ({PARTS[n]})" for n in names.split()] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def lowered(x: str) -> str:
    """Lower case where, as in Unicode, the dotted capital I gives two characters."""
    return f"lower(replace(coalesce({x}, ''), 'İ', 'i' || chr(775)))"


def narrow(x: str) -> str:
    return f"regexp_replace({lowered(x)}, {quote(NARROW_MARKS)}, '', 'g')"


def wide(x: str) -> str:
    return f"regexp_replace({lowered(x)}, {quote(WIDE_MARKS)}, '', 'g')"


def normal(x: str) -> str:
    """Normalised text, right for values without compatibility characters."""
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), '\s+', ' ', 'g'))"


def nfkd(x: str) -> str:
    """Compatibility decomposition; the part ``nk`` must be joined."""
    return f"CASE WHEN regexp_matches({x}, '[^\\x00-\\x7f]') THEN array_to_string(list_transform(string_split({x}, ''), lambda ch: coalesce(nk[ch], ch)), '') ELSE {x} END"


def _bare(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(regexp_replace({x}, '[\x{{0300}}-\x{{036f}}]', '', 'g')), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), '\s+', ' ', 'g'))"


def normalized(x: str) -> str:
    """Normalised text of any value; needs ``nk``."""
    return _bare(nfkd(f"coalesce({x}, '')"))


def parts(x: str) -> str:
    """The normalised artists of a credit; needs ``nk``."""
    marked = nfkd(f"regexp_replace(coalesce({x}, ''), {quote(ARTIST_SEPARATOR)}, chr(1), 'g')")
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda part: {_bare('part')}), lambda part: part <> '')"


def share(a: str, b: str) -> str:
    """Share of the tokens of list ``a`` that equal, hold or lie within one of ``b``."""
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: contains(x, y) OR contains(y, x))) > 0)) / greatest(len({a}), len({b})) ELSE 0 END"


def cleaned(x: str) -> str:
    """A title without brackets, guests and noise words; needs ``nk``."""
    out = f"regexp_replace(coalesce({x}, ''), '\\s*[\\(\\[][^\\)\\]]{{0,40}}[\\)\\]]\\s*', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)\\s*(feat\\.?|ft\\.?|with)\\s+.*', '', 'g')"
    return normalized(f"regexp_replace({out}, '(?i)\\s*({NOISE})\\s*', ' ', 'g')")


def basename(path: str) -> str:
    return rf"regexp_replace(regexp_extract(coalesce({path}, ''), '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')"


#: Files with the title of their tag or path, step by step; needs ``f`` and ``nk``.
TITLES = rf"""t1 AS (SELECT f.*, {basename('path')} AS file_name, trim(coalesce(title, '')) AS tag FROM f),
t2 AS (SELECT *, regexp_replace(file_name, '(?i)^(?:track\s*)?\d{{1,3}}[\s.\-_]+', '') AS no_number FROM t1),
t3 AS (SELECT *, trim(regexp_extract(no_number, '^(.+?)\s*[-–—]\s*(.+)$', 2)) AS inner_title FROM t2),
t4 AS (SELECT t3.*, length(tag) >= 2 AND {normalized('tag')} <> {normalized('file_name')} AS tagged FROM t3, nk),
ft AS (SELECT t4.*, {cleaned("CASE WHEN tagged THEN tag WHEN length(inner_title) >= 2 THEN inner_title ELSE no_number END")} AS clean, {cleaned('title')} AS title_key, {normalized('artist')} AS artist_key FROM t4, nk)"""


def edits(a: str, b: str) -> str:
    """Edits in characters: both texts spelled with one byte for each distinct character, as the engine counts bytes."""
    signs = f"list_distinct(string_split({a} || {b}, ''))"
    spelled = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda ch: chr((33 + list_position({signs}, ch))::INT)), '')"
    return f"levenshtein({spelled(a)}, {spelled(b)})"


def likeness(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1 WHEN {a} = '' OR {b} = '' THEN 0 ELSE 1 - {edits(a, b)} / greatest(length({a}), length({b})) END"


def plausible(ta: str, tb: str, aa: str, ab: str) -> str:
    return f"(({ta} <> '' AND {tb} <> '' AND {likeness(ta, tb)} >= 0.5) OR ({aa} <> '' AND {ab} <> '' AND {likeness(aa, ab)} >= 0.5))"


def tier(p: str = "") -> str:
    code, rate, bits = f"upper(coalesce({p}format, ''))", f"coalesce(nullif({p}sample_rate, 0), 44100)", f"coalesce(nullif({p}bits_per_sample, 0), 16)"
    kbit = f"coalesce({p}bitrate, 0)"
    return f"""CASE WHEN {code} IN ('FLAC', 'WAV', 'DSF', 'DFF') AND {rate} >= 88200 AND {bits} >= 24 THEN 'hi_res' WHEN {code} = 'AIFF' THEN 'aiff' WHEN {code} IN ('FLAC', 'WAV', 'DSF', 'DFF') THEN 'lossless'
WHEN {code} IN ('M4A', 'AAC') AND {kbit} >= 256 THEN 'aac_256' WHEN {code} = 'MP3' AND {kbit} >= 320 THEN 'mp3_320' WHEN {code} = 'MP3' AND {kbit} >= 256 THEN 'mp3_256' WHEN {code} = 'MP3' AND {kbit} >= 192 THEN 'mp3_192'
WHEN {code} IN ('OGG', 'OPUS', 'OGG VORBIS') THEN 'ogg' ELSE 'low' END"""


def score(p: str = "") -> str:
    order = "[" + ", ".join(quote(t) for t in q.TIERS) + "]"
    return f"(({len(q.TIERS)} + 1 - list_position({order}, {tier(p)})) * 100000 + coalesce({p}bitrate, 0)::BIGINT + coalesce(nullif({p}sample_rate, 0), 44100) / 1000 + coalesce(nullif({p}bits_per_sample, 0), 16))"


def filled(p: str = "") -> str:
    return "(" + " + ".join([f"coalesce({p}{c} <> '', false)::INT" for c in ("title", "artist", "album", "genre")] + [f"coalesce({p}{c} > 0, false)::INT" for c in ("album_year", "track_number")]) + ")"


def kind(p: str = "") -> str:
    has = lambda e: f"regexp_matches(coalesce({p}album, ''), {quote(e)})"
    return f"CASE WHEN {p}release_type <> '' AND {p}release_type <> 'unknown' THEN {p}release_type WHEN coalesce({p}album, '') = '' THEN 'unknown' WHEN {has(q.COMPILATION)} THEN 'compilation' WHEN {has(q.SINGLE)} THEN 'single' WHEN {has(q.SOUNDTRACK)} THEN 'soundtrack' ELSE 'album' END"


def kind_score(p: str = "") -> str:
    return f"CASE {kind(p)} " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in q.RELEASE_SCORES.items()) + " ELSE 0 END"


def status(own: str, said: str, genre: str | None = None) -> str:
    """The status tier of columns with the prefixes ``own`` and ``said``."""
    genre = genre or f"{said}genre"
    has = lambda x: f"coalesce({x} <> '', false)"
    agree = lambda n: f"(coalesce({own}{n}, '') = '' OR coalesce({said}{n}, '') = '' OR {wide(own + n)} = {wide(said + n)})"
    writable = f"((coalesce({said}album_year, 0) <> 0 AND coalesce({said}album_year, 0) <> coalesce({own}album_year, 0)) OR (coalesce({said}track_number, 0) <> 0 AND coalesce({own}track_number, 0) = 0) OR ({has(genre)} AND NOT {has(own + 'genre')}))"
    exact = " AND ".join([has(said + n) for n in ("title", "artist", "album")] + [f"coalesce({said}match_basis, '') = 'exact'"] + [agree(n) for n in ("title", "artist", "album")])
    album = f"({has(said + 'album')} AND (NOT {has(own + 'album')} OR NOT {agree('album')}))"
    some = " OR ".join(has(said + n) for n in ("title", "artist", "album"))
    return f"CASE WHEN {some} THEN CASE WHEN {exact} THEN CASE WHEN {writable} OR {album} THEN 'blue' ELSE 'green' END WHEN {writable} THEN 'yellow' ELSE 'red' END END"


def rank(x: str) -> str:
    return f"CASE {x} WHEN 'green' THEN 0 WHEN 'blue' THEN 1 WHEN 'yellow' THEN 2 WHEN 'red' THEN 3 ELSE 4 END"


#: Files with both sources' columns; a number with decimals is no genre.
BOTH = "x AS (SELECT f.*, " + ", ".join(f"{p}.{c} AS {p}_{c}" for p in ("mb", "aid") for c in ("mb_recording_id", "title", "artist", "album", "album_year", "track_number", "duration", "match_basis", "scraped_at")) + ", " + ", ".join(
    f"CASE WHEN NOT regexp_full_match({p}.genre, '\\d+\\.\\d+') THEN {p}.genre END AS {p}_genre" for p in ("mb", "aid")
) + " FROM f LEFT JOIN e mb ON mb.file_id = f.id AND mb.source = 'musicbrainz' LEFT JOIN e aid ON aid.file_id = f.id AND aid.source = 'acoustid')"

__all__ = ["BOTH", "PARTS", "SPACE", "filled", "kind", "kind_score", "narrow", "normal", "quote", "rank", "score", "status", "tier", "wide", "with_"]
