"""Quality, completeness, release type and enrichment status of a record, as column expressions over a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import wide_key

# Quality tiers from best to worst, and the scores of release types.
TIERS = ("hi_res", "lossless", "aiff", "aac_256", "mp3_320", "mp3_256", "mp3_192", "ogg", "low")
RELEASE_SCORES = {"album": 4, "soundtrack": 3, "compilation": 2, "single": 1, "unknown": 0}
# Words of album titles by release type.
COMPILATION = r"(?i)greatest hits|best of|collection|compilation|anthology|playlist|top \d+|essential|complete|the very best"
SINGLE = r"(?i)\b(single|ep)\b"
SOUNDTRACK = r"(?i)soundtrack|ost|score|motion picture"
# Format of a file name extension where it is not its upper case.
FORMATS = {"aif": "AIFF", "aac": "M4A"}


def format_of(extension: Column) -> Column:
    """The format code of a file name extension."""
    ext = F.lower(F.regexp_replace(extension, r"^\.", ""))
    out = F.upper(ext)
    for short, code in FORMATS.items():
        out = F.when(ext == short, code).otherwise(out)
    return out


def quality_tier(fmt: Column, bitrate: Column, rate: Column, bits: Column) -> Column:
    """The quality tier of an encoding; missing rates count as 44,100 Hz and 16 bits."""
    code, kbit = F.upper(F.coalesce(fmt, F.lit(""))), F.coalesce(bitrate, F.lit(0))
    lossless = code.isin("FLAC", "WAV", "DSF", "DFF")
    fine = (_or(rate, 44100) >= 88200) & (_or(bits, 16) >= 24)
    return (
        F.when(lossless & fine, "hi_res").when(code == "AIFF", "aiff").when(lossless, "lossless")
        .when(code.isin("M4A", "AAC") & (kbit >= 256), "aac_256")
        .when((code == "MP3") & (kbit >= 320), "mp3_320").when((code == "MP3") & (kbit >= 256), "mp3_256").when((code == "MP3") & (kbit >= 192), "mp3_192")
        .when(code.isin("OGG", "OPUS", "OGG VORBIS"), "ogg").otherwise("low")
    )


def _or(value: Column, default: int) -> Column:
    return F.when(value != 0, value).otherwise(default)


def quality_score(fmt: Column, bitrate: Column, rate: Column, bits: Column, order: tuple[str, ...] = TIERS) -> Column:
    """R2: tiers first, then bitrate, rate and bits; a tier that ``order`` lacks comes last."""
    place = F.array_position(F.array(*[F.lit(t) for t in order]), quality_tier(fmt, bitrate, rate, bits))
    index = F.when(place > 0, place - 1).otherwise(len(order))
    return (len(order) - index) * 100000 + F.coalesce(bitrate, F.lit(0)) + _or(rate, 44100) / 1000 + _or(bits, 16)


def completeness(title: Column, artist: Column, album: Column, year: Column, track: Column, genre: Column) -> Column:
    """How many of six fields are filled."""
    filled = [F.coalesce(c != "", F.lit(False)) for c in (title, artist, album, genre)] + [F.coalesce(c > 0, F.lit(False)) for c in (year, track)]
    return sum((f.cast("int") for f in filled[1:]), filled[0].cast("int"))


def release_type(kind: Column, album: Column) -> Column:
    """The stated release type, else one told by the album title."""
    title = F.coalesce(album, F.lit(""))
    told = F.when(title == "", "unknown").when(title.rlike(COMPILATION), "compilation").when(title.rlike(SINGLE), "single").when(title.rlike(SOUNDTRACK), "soundtrack").otherwise("album")
    return F.when((kind != "") & (kind != "unknown"), kind).otherwise(told)


def release_score(kind: Column, album: Column) -> Column:
    """The preference among release types."""
    own, out = release_type(kind, album), F.lit(0)
    for name, score in RELEASE_SCORES.items():
        out = F.when(own == name, score).otherwise(out)
    return out


def field_agrees(own: Column, said: Column) -> Column:
    """Whether two values are one but for case and marks; an empty side says nothing against."""
    return (F.coalesce(own, F.lit("")) == "") | (F.coalesce(said, F.lit("")) == "") | (wide_key(own) == wide_key(said))


def status_tier(own: dict[str, Column], said: dict[str, Column]) -> Column:
    """Green, blue, yellow, red, or null without any enrichment. Both dicts: title, artist, album, album_year, track_number, genre; ``said`` also match_basis."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    number = lambda c: F.coalesce(c, F.lit(0))
    writable = (
        ((number(said["album_year"]) != 0) & (number(said["album_year"]) != number(own["album_year"])))
        | ((number(said["track_number"]) != 0) & (number(own["track_number"]) == 0))
        | (has(said["genre"]) & ~has(own["genre"]))
    )
    exact = has(said["title"]) & has(said["artist"]) & has(said["album"]) & (F.coalesce(said["match_basis"], F.lit("")) == "exact")
    for name in ("title", "artist", "album"):
        exact = exact & field_agrees(own[name], said[name])
    album_too = has(said["album"]) & (~has(own["album"]) | ~field_agrees(own["album"], said["album"]))
    any_field = has(said["title"]) | has(said["artist"]) | has(said["album"])
    return F.when(any_field, F.when(exact, F.when(writable | album_too, "blue").otherwise("green")).otherwise(F.when(writable, "yellow").otherwise("red")))


def tier_rank(tier: Column) -> Column:
    """Green before blue, yellow, red and none."""
    return F.when(tier == "green", 0).when(tier == "blue", 1).when(tier == "yellow", 2).when(tier == "red", 3).otherwise(4)
