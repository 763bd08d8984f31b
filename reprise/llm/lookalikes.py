"""Visually identical text with different characters.

``canonical`` brings a text to the form a reader sees: stand-ins for ordinary characters are replaced,
everything else stays as it is. Unicode's normalization quick check, and the same kind of property for what it does not
know, worked out once per worker, tell which code points can change at all. Only the words around such code points are looked at,
with the boundary context that decides them (neighbouring letters, the scripts of the word and of the text), and
the canonical words are spliced into the unchanged rest.

Names rightly written in another script, composed accents, typographic quotes and dashes, and wide punctuation
within East Asian text are ordinary.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Letters of other scripts that look like a Latin letter, with that letter.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅԌԚԜӀ", "aeopcyxijshdqwlABEKMHOPCTYXIJSGQWI"))
GREEK = dict(zip("ονραυικτγϲχηΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ovpauiktycxnABEZHIKMNOPTYXC"))
ARMENIAN = dict(zip("սօհոցզյՕՏՍԼ", "uohngqjOSUL"))
OTHER_LATIN = dict(zip("ɑɡɩǀꞮ", "agilI"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎥ", "ABCDEGHJKLMPRSTVWZi"))
COPTIC = dict(zip("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABHIKMNOPCTYXopc"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
SYLLABICS = dict(zip("ᗩᗅᗷᑕᗪᗴᖴᕼᒍᒪᗰᑭᖇᔕᑌᐯᗯ᙭", "AABCDEFHJLMPRSUVWX"))
DESERET = dict(zip("𐐄𐐕𐐛𐐬𐐽𐑃", "OCLocl"))
# Ideographs that look like a Katakana letter.
KANJI_FOR_KANA = dict(zip("夕工力口二八卜千三又才一厶乂丿", "タエカロニハトチミヌオームメノ"))
# Marks that stand in for an ASCII one.
MARKS = dict(zip("ʼ′‵ʹˈ`‐‑‒−⁃˗﹣﹘․ꓸ∶꞉ː⁄∕ǃ", "''''''" + "-" * 8 + ".." + ":::" + "//" + "!"))
#: Characters that show as nothing, or as a blank, besides the categories Cf and Zs.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍"
BLANKS = "⠀ㅤﾠ\t\x0b\x0c\r\n  \x85"

_LETTERS = re.compile("[^\\W\\d_]+(?:[̀-゙゚ͯ]+[^\\W\\d_]*)*")
_ASCII = re.compile(r"[a-z]I|\bEI\b|[A-Za-z]I[a-z]|[A-Za-z]0|0[A-Za-z]|[A-Z]l|\bl[A-Zb-df-hkm-np-tv-z]|[a-z][1|][a-z]")
_CONTROLS = re.compile("[\t\x0b\x0c\r\n`]")
#: The same for a filter before any Python: a character outside ASCII, a control, or an ASCII stand-in.
CANDIDATE = r"[^ -~]|[a-z]I|\bEI\b|[A-Za-z]I[a-z]|[A-Za-z]0|0[A-Za-z]|[A-Z]l|\bl[A-Zb-df-hkm-np-tv-z]|[a-z][1|][a-z]|`"


@cache
def script(ch: str) -> str:
    """L, C, G, A, E, P, U, S, D for the scripts with look-alikes, K Katakana, H Hiragana, Z ideographs, '' for the rest."""
    if ch < "\x80":
        return "L" if ch.isalpha() else ""
    name = unicodedata.name(ch, "")
    for start, short in (("LATIN", "L"), ("CYRILLIC", "C"), ("GREEK", "G"), ("ARMENIAN", "A"), ("KATAKANA", "K"), ("HIRAGANA", "H"), ("CJK", "Z"), ("KANGXI", "Z"), ("IDEOGRAPHIC", "Z"), ("CHEROKEE", "E"), ("COPTIC", "P"), ("LISU", "U"), ("CANADIAN", "S"), ("DESERET", "D")):
        if name.startswith(start):
            return short
    return ""


_TO_LATIN = {"C": CYRILLIC, "G": GREEK, "A": ARMENIAN, "E": CHEROKEE, "P": COPTIC, "U": LISU, "S": SYLLABICS, "D": DESERET}
_ALIKE = {"L", *_TO_LATIN}
_LOOKALIKES = frozenset().union(*_TO_LATIN.values(), KANJI_FOR_KANA, KANJI_FOR_KANA.values())
_FROM_LATIN = {s: {v: k for k, v in reversed(m.items())} for s, m in _TO_LATIN.items()}


_DRAWN = re.compile(r"^(?:LATIN LETTER SMALL CAPITAL|(?:NEGATIVE|CROSSED NEGATIVE) (?:CIRCLED|SQUARED) LATIN CAPITAL LETTER) ([A-Z])$")


@cache
def _plain(ch: str) -> str | None:
    """What a code point becomes wherever it stands; None: context decides, or nothing happens."""
    cat = unicodedata.category(ch)
    if ch in INVISIBLE or cat == "Cf" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if ch in BLANKS or (cat == "Zs" and ch != " "):
        return " "
    if ch in MARKS:
        return MARKS[ch]
    if ch in OTHER_LATIN:
        return OTHER_LATIN[ch]
    name = unicodedata.name(ch, "")
    if cat[0] in "LS" and (m := _DRAWN.search(name)):  # small capitals, and letters in discs and squares without a decomposition
        return m[1].lower() if "SMALL CAPITAL" in name else m[1]
    folded = unicodedata.normalize("NFKC", ch)
    if unicodedata.decomposition(ch).startswith(("<circle>", "<square>")) and len(folded) == 1 and folded.isalpha() and folded.isascii() or "ᴬ" <= ch <= "ᵺ" and len(folded) == 1 and folded.isascii():
        return folded
    compatible = unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>", "<font>")) or "ﬀ" <= ch <= "ﬆ" or "⺀" <= ch <= "⿟" or "Ⅰ" <= ch <= "ⅿ"
    if folded != ch and (compatible or unicodedata.normalize("NFC", ch) != ch):
        return folded
    return None


@cache
def unstable(ch: str) -> bool:
    """The quick-check property: whether the code point can change, by itself or in some context."""
    if ch < "\x80":
        return ch in "\t\x0b\x0c\r\n`"
    return ch in _LOOKALIKES or unicodedata.combining(ch) > 0 or _plain(ch) is not None


def _kept(ch: str, before: str, after: str) -> bool:
    """Whether an invisible or wide character is at home between its neighbours."""
    pictured = bool(before) and unicodedata.category(before) in ("So", "Sk")
    if ch in "️︎" and (pictured or after == "⃣"):
        return True
    if ch == "‍" and (pictured or before == "️") and bool(after) and unicodedata.category(after) in ("So", "Sk"):
        return True
    if ch in "‌‍‎‏؜":
        return any(x and (unicodedata.bidirectional(x) in ("AL", "R") or "ऀ" <= x <= "෿") for x in (before, after))
    if "！" <= ch <= "～" and not unicodedata.normalize("NFKC", ch).isalnum():
        return any(x and script(x) in ("K", "H", "Z") for x in (before, after))
    return False


def _word(word: str, others: set[str]) -> str:
    """Letters of other scripts within a word, brought to the script of the word. ``others``: firm scripts of the text."""
    marks = [script(ch) for ch in word]
    own = set(marks) - {""}
    if len(own & _ALIKE) > 1:
        latin_of = lambda s: set(_FROM_LATIN[s]) if s in _FROM_LATIN else set()
        rest = own & _ALIKE - {"L"}

        def firm(s: str) -> int:
            if s == "L":
                able = set().union(*(latin_of(x) for x in rest))
                return sum(m == "L" and unicodedata.normalize("NFD", ch)[0] not in able for ch, m in zip(word, marks))
            return sum(m == s and ch not in _TO_LATIN[s] for ch, m in zip(word, marks))

        target = max(own & _ALIKE, key=lambda s: (firm(s) > 0, marks.count(s) if firm(s) else 0, s == "L", s))
        return "".join(_fold(ch, m, target) for ch, m in zip(word, marks))
    if len(own) == 1 and (s := next(iter(own))) in _TO_LATIN and s not in others and "L" in others and all(ch in _TO_LATIN[s] for ch in word):
        return "".join(_TO_LATIN[s][ch] for ch in word)
    if "K" in own and "Z" in own:
        kana = sum(m == "K" and ch not in KANJI_FOR_KANA.values() for ch, m in zip(word, marks))
        han = sum(m == "Z" and ch not in KANJI_FOR_KANA for ch, m in zip(word, marks))
        if kana and not han and "H" not in own:
            return "".join(KANJI_FOR_KANA.get(ch, ch) for ch in word)
        if han and not kana:
            back = {v: k for k, v in KANJI_FOR_KANA.items() if v != "ー"}
            return "".join(back.get(ch, ch) for ch in word)
    elif own == {"Z"} and "K" in others and "Z" not in others and all(ch in KANJI_FOR_KANA for ch in word):
        return "".join(KANJI_FOR_KANA[ch] for ch in word)
    return word


def _fold(ch: str, s: str, target: str) -> str:
    if s == target or s not in _ALIKE:
        return ch
    latin = ch if s == "L" else _TO_LATIN[s].get(ch)
    if latin is None:
        return ch
    return latin if target == "L" else _FROM_LATIN[target].get(latin, ch)


def _ascii(text: str) -> str:
    """Capital I, small l, 0, 1 and | that stand in for one another within a word."""

    def one(m: re.Match) -> str:
        word = m[0]
        letters = [ch for ch in word if ch.isalpha() and ch not in "Il"]
        upper, lower = sum(ch.isupper() for ch in letters), sum(ch.islower() for ch in letters)
        if not any(ch.isdigit() and ch != "0" for ch in word) and "0" in word and letters:
            word = ("O" if word[0] == "0" and text != text.lower() else word[0].replace("0", "o")) + re.sub("0", "O" if upper > lower else "o", word[1:])
        word = re.sub(r"(?<=[^\W\d_])[1|](?=[^\W\d_])", "l", word)
        if lower:
            if not re.match(r"Ma?cI", word):
                word = re.sub(r"(?<=[^\W\d_])I(?=[^\W\dI_])|(?<=[a-zà-öø-ÿɑɡа-яα-ω])I+(?!\w)|(?<=[^\W\d_A-Z])I", lambda x: "l" * len(x[0]), word)
            if re.match(r"l[b-df-hkm-np-tv-z]", word) and m.start() == 0 or re.match(r"l[b-df-hkm-np-tv-z]", word) and not text.islower():
                word = "I" + word[1:]
        elif upper > 1 and "l" in word:
            word = word.replace("l", "I")
        return word

    if any(ch.islower() for ch in text):
        text = re.sub(r"(?<!\w)EI(?!\w)", "El", text)
    return re.sub(r"[\w|]+", one, text)


def canonical(text: str) -> str:
    """The text with every stand-in replaced by the ordinary character a reader takes it for."""
    spots = [k for k, ch in enumerate(text) if unstable(ch)] if not text.isascii() or _CONTROLS.search(text) else []
    if spots:
        parts, at = [], 0
        for k in spots:  # segments that change by themselves
            ch = text[k]
            new = _plain(ch)
            if new is None or _kept(ch, text[k - 1] if k else "", text[k + 1] if k + 1 < len(text) else ""):
                continue
            parts += [text[at:k], new]
            at = k + 1
        text = "".join(parts) + text[at:]
        if not unicodedata.is_normalized("NFC", text):
            # A mark is composed with its base; boundaries are the starters on both sides.
            text = re.sub(".[̀-゙゚ͯ]+", lambda m: unicodedata.normalize("NFC", m[0]), text)
        if not _LOOKALIKES.isdisjoint(text):
            firm = {s for ch in text if (s := script(ch)) and (s == "L" or ch not in _TO_LATIN.get(s, ()) and ch not in KANJI_FOR_KANA)}
            text = _LETTERS.sub(lambda m: _word(m[0], firm), text)
    return _ascii(text) if _ASCII.search(text) else text


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, str] = {}
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            if text not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                seen[text] = canonical(text)
            out.append(seen[text])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "form"])


def stand_ins(texts: DataFrame) -> DataFrame:
    """Rows (file_id, field, text) whose text holds a stand-in, with their ``form``: the text brought to one form.

    Null texts and texts without a stand-in give no row; an empty table gives none; texts are read whole.
    """
    found = texts.filter(F.col("text").rlike(CANDIDATE)).mapInArrow(_canonical, "file_id bigint, field string, text string, form string")
    return found.filter("text <> form")


def fields(files: DataFrame, *names: str) -> DataFrame:
    """The text columns of ``files`` as rows (file_id, field, text), without nulls."""
    said = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names])
    return files.select(F.col("id").alias("file_id"), F.explode(said).alias("s")).select("file_id", "s.field", "s.text").filter("text IS NOT NULL")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import encodings

    files = table(spark, sf_dir, "files").select("id", "path", "title", "artist", "album")
    broken = encodings.Model.fit(files).flag(encodings.texts(files).filter(F.col("text").rlike(CANDIDATE)))
    flagged = stand_ins(fields(files, "title", "artist"))
    return flagged.distinct().join(broken.select("file_id", "field").distinct(), ["file_id", "field"], "left_anti")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: titles and artists that hold a stand-in for an ordinary character, unless they were misread (7)."""
    return _found(spark, sf_dir).select("file_id", "field").distinct()


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_forms: the values found, as stored and in their one form."""
    return _found(spark, sf_dir).select("file_id", "field", "text", "form").distinct()


QUERIES = {"p6_found": found, "p6_forms": forms}
ORACLES: dict = {}
