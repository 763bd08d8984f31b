"""Text functions as column expressions; only compatibility decomposition needs Python (no such built-in exists)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# White space as scripts of the web understand it, and the characters three comparisons ignore.
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WIDE_MARKS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}()（）\[\]【】「」『』·\-_,.!?！？、，。:：;；'\"]"
NARROW_MARKS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}()（）【】「」\-_,.]"
# Words that a title may carry without being another title.
NOISE = "official|mv|video|audio|lyric|live|remix"
# What separates the artists of a credit.
ARTIST_SEPARATOR = r"(?i)[;,/、，&×x]+|\s+(?:feat\.?|ft\.?|with)\s+"


@pandas_udf(StringType())
def _decompose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def nfkd(text: Column) -> Column:
    """Compatibility decomposition; ASCII text, the common case, stays in the JVM's hands unchanged."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), _decompose(text)).otherwise(text)


def _bare(decomposed: Column) -> Column:
    bare = F.lower(F.regexp_replace(decomposed, r"[\x{0300}-\x{036f}]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_]", " "), r"\s+", " "))


def normalize(text: Column) -> Column:
    """No accents, lower case, everything but letters, digits and underscores to single blanks; null gives ''."""
    return _bare(nfkd(F.coalesce(text, F.lit(""))))


def normalized_parts(text: Column, separator: str) -> Column:
    """The normalised parts of a text between separators, without empty ones: decomposed once, before it is split."""
    marked = nfkd(F.regexp_replace(F.coalesce(text, F.lit("")), separator, "\x01"))
    return F.filter(F.transform(F.split(marked, "\x01"), _bare), lambda x: x != "")


def clean_title(text: Column, compat: bool = True) -> Column:
    """A title without short brackets, guests and noise words. ``compat`` removes them inside words too."""
    edge = "" if compat else r"\b"
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*[\(\[][^\)\]]{0,40}[\)\]]\s*", " ")
    text = F.regexp_replace(text, rf"(?i)\s*{edge}(feat\.?|ft\.?|with)\s+.*", "")
    text = F.regexp_replace(text, rf"(?i)\s*{edge}({NOISE}){edge}\s*", " ")
    return normalize(text)


def basename(path: Column, extension: bool = False) -> Column:
    """The file name of a path, without its extension unless asked for."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)
    return name if extension else F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def title_of(title: Column, path: Column, compat: bool = True) -> Column:
    """The cleaned title tag if it says more than the file name, else the title within the file name."""
    name, tag = basename(path), F.trim(F.coalesce(title, F.lit("")))
    bare = F.regexp_replace(name, r"(?i)^(?:track\s*)?\d{1,3}[\s.\-_]+", "")
    right = F.trim(F.regexp_extract(bare, r"^(.+?)\s*[-–—]\s*(.+)$", 2))
    inner = F.when(F.length(right) >= 2, right).otherwise(bare)
    return F.when((F.length(tag) >= 2) & (normalize(tag) != normalize(name)), clean_title(tag, compat)).otherwise(clean_title(inner, compat))


def wide_key(text: Column) -> Column:
    """T4: lower case without a wide set of marks; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WIDE_MARKS, "")


def narrow_key(text: Column) -> Column:
    """T5: lower case without a narrow set of marks; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NARROW_MARKS, "")


def search_key(text: Column) -> Column:
    """No marks of any kind, lower case, punctuation deleted, blanks collapsed."""
    bare = F.lower(F.regexp_replace(nfkd(F.coalesce(text, F.lit(""))), r"\p{M}", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def fold_script(text: Column, table: dict[str, str] | None = None) -> Column:
    """Characters of one script variant for the other by a table the caller supplies; without one, unchanged."""
    return F.translate(text, "".join(table), "".join(table.values())) if table else text


def album_key(text: Column) -> Column:
    """An album title without a year in brackets at its end."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\(\[]\d{4}[\)\]]\s*$", ""))


def leading_int(text: Column) -> Column:
    """The integer a text begins with, 0 without one."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))


def file_name(track: Column, artist: Column, title: Column) -> Column:
    """``NN. artist - title`` with reserved characters replaced and parts of bounded length."""
    part = lambda c: F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]', "_")), 1, 120)
    number = F.when(track > 0, F.concat(F.lpad(track.cast("string"), 2, "0"), F.lit(". "))).otherwise("")
    who = F.when(part(artist) != "", F.concat(part(artist), F.lit(" - "))).otherwise("")
    return F.substring(F.concat(number, who, part(title)), 1, 200)


def clock(seconds: Column) -> Column:
    """Seconds as m:ss."""
    whole = round_half_up(seconds).cast("bigint")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def byte_size(n: Column) -> Column:
    """Bytes in the largest fitting unit with one decimal."""
    return F.when(n >= 1 << 30, F.concat(F.round(n / (1 << 30), 1).cast("string"), F.lit(" GB"))).when(n >= 1 << 20, F.concat(F.round(n / (1 << 20), 1).cast("string"), F.lit(" MB"))).when(n >= 1024, F.concat(F.round(n / 1024, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def round_half_up(x: Column) -> Column:
    """To the nearest integer, halves upward."""
    return F.floor(x + 0.5)


def segment_keys(words: Column, segments: int = 5, width: int = 3) -> Column:
    """Up to five keys of three successive words spread over a list; short lists give one key, none gives none."""
    n = F.size(words)
    step = F.greatest(F.lit(1), F.floor((n - width) / (segments - 1)).cast("int"))
    keys = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.array_join(F.slice(words, F.least(i * step, n - width) + 1, width), " ")))
    return F.when(n >= 6, keys).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def duration_bucket(seconds: Column, width: float = 4.0) -> Column:
    """The bucket of a duration; rows in buckets at most two apart are candidates."""
    return round_half_up(seconds / width).cast("int")


def split_set(text: Column) -> Column:
    """A comma-joined set as an array without blanks and empty members."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
