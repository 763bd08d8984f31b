"""Garbled text from wrong character encoding: expectation-maximization over latent encoding chains.

Every value has a latent chain: none, or one or more steps "the bytes are of this encoding but were read in
that one". The prior of a chain is pooled per source and field, the plausibility of what a chain restores comes
from a model of characters (transitions between classes of characters, and characters within their class). The
E-step weighs the chains of every distinct value that holds a character outside ASCII; the M-step re-estimates
the priors and the model from the restored texts, so that weak evidence of many records adds up and garbled
characters lose their own weight in the model. What is collected between rounds are these statistics alone:
their size is bounded by the characters of Unicode in use, the classes, and the chains of each source.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, partitions, table
from .lookalikes import canonical

#: Encodings of one byte a character, in which texts were read or written by mistake.
SINGLE = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8-r", "mac-roman", "mac-cyrillic", "iso8859-2", "iso8859-7")
#: Encodings of several bytes a character.
MULTI = ("gbk", "cp932", "big5", "euc_jp", "euc_kr")
#: What a step restores besides UTF-8, by what it was read in.
TEXT_OF_SINGLE = ("cp1252", "cp1250", "cp1251", "cp1253", "koi8-r", "cp866", "mac-roman", "mac-cyrillic", "cp437", "iso8859-7", "gbk", "cp932", "euc_jp", "big5", "euc_kr")
TEXT_OF_MULTI = ("cp1252", "cp1251", "cp1253", "gbk", "cp932", "euc_jp", "big5")

ROUNDS = 3
#: Texts a worker remembers in a round.
REMEMBERED = 20_000
#: Weight of the prior over all sources, in records, within the prior of a source.
POOLED = 200.0
#: First guess of the share of garbled values, and what one replaced character costs a value that is not garbled.
GARBLED, STAND_IN = 0.02, np.log(0.03)
#: A mean or single transition below these (logarithms) makes a text strange enough to try chains other than UTF-8.
STRANGE_MEAN, STRANGE_ONE = -2.6, -5.0

#: Posterior from which a value counts as garbled: a missed one is worse than a second look at a right one.
DECISION = 0.05

_KINDS = (
    "start", "space", "lower", "upper", "accented lower", "accented upper", "Greek lower", "Greek upper", "Cyrillic lower", "Cyrillic upper",
    "Hiragana", "Katakana", "ideograph", "Hangul", "other letter", "mark", "digit", "punctuation", "quote", "dash", "symbol", "currency", "box", "control", "private",
)
KIND = {k: i for i, k in enumerate(_KINDS)}


@cache
def kind(ch: str) -> int:
    """The class of a character."""
    cat, name = unicodedata.category(ch), unicodedata.name(ch, "")
    case = "lower" if cat == "Ll" else "upper"
    if ch == " ":
        found = "space"
    elif cat[0] == "L":
        if name.startswith("LATIN"):
            found = case if ch.isascii() else f"accented {case}"
        elif name.startswith(("GREEK", "CYRILLIC")):
            found = f"{name.split()[0].capitalize()} {case}"
        else:
            found = next((k for start, k in (("HIRAGANA", "Hiragana"), ("KATAKANA", "Katakana"), ("HALFWIDTH KATAKANA", "symbol"), ("CJK", "ideograph"), ("HANGUL", "Hangul")) if name.startswith(start)), "other letter")
    elif cat[0] == "M":
        found = "mark"
    elif cat == "Nd":
        found = "digit" if ch.isascii() else "symbol"
    elif cat == "Pd":
        found = "punctuation" if ch == "-" else "dash"
    elif cat in ("Pi", "Pf") or ch in "‚„":
        found = "quote"
    elif cat[0] == "P":
        found = "punctuation"
    elif cat == "Sc":
        found = "currency"
    elif "─" <= ch <= "▟":
        found = "box"
    elif cat == "Co" or ch == "�":
        found = "private"
    elif cat[0] == "C" or cat[0] == "Z":
        found = "control"
    else:
        found = "punctuation" if ch.isascii() else "symbol"
    return KIND[found]


@cache
def _read_as(name: str) -> tuple[dict[str, int], str]:
    """Byte of each character, and character of each byte, of a one-byte encoding; undefined bytes stand for themselves."""
    chars = "".join(bytes([b]).decode(name, "replace") for b in range(256))
    chars = "".join(chr(b) if c == "�" else c for b, c in enumerate(chars))
    return {c: b for b, c in enumerate(chars)}, chars


@cache
def _able(ch: str) -> frozenset[str]:
    """The one-byte encodings that have a character."""
    return frozenset(name for name in SINGLE if ch in _read_as(name)[0])


def _bytes(text: str, name: str) -> bytes | None:
    if name in SINGLE:
        of = _read_as(name)[0]
        return bytes([of[c] for c in text])
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        return None


def _text(raw: bytes, name: str) -> str | None:
    try:
        return raw.decode(name)
    except UnicodeDecodeError:
        return None


_LONE = re.compile(r"(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])")


def _steps(text: str, strange: bool) -> Iterator[tuple[str, str]]:
    """Chains of one step by which ``text`` may have come about, with what they restore."""
    able = frozenset.intersection(*map(_able, set(text)))
    lone = _LONE.search(text)
    for read in (*SINGLE, *MULTI):
        # No byte beyond ASCII stands alone in UTF-8.
        if read in SINGLE and (read not in able or lone and not strange) or (raw := _bytes(text, read)) is None:
            continue
        back = _text(raw, "utf-8")
        if back is not None and back != text:
            yield f"{read}<utf-8", back
        if strange:
            for written in TEXT_OF_SINGLE if read in SINGLE else TEXT_OF_MULTI:
                if written != read and (back := _text(raw, written)) not in (None, text):
                    yield f"{read}<{written}", back


#: Characters that no reading of right bytes leaves behind: replacement, C1 controls, vendor logos, boxes between letters.
_LOST = re.compile("[�\x80-\x84\x86-\x9f]|[^\\W\\d_][─-▟]|[─-▟][^\\W\\d_]")


_LOST_CHARS = re.compile("[�\x80-\x84\x86-\x9f─-▟]")
#: The chain of texts whose bytes were lost, and what each such character costs it, and costs right text.
LOST, LOST_CHAR, LOST_RIGHT = "lost", np.log(1e-4), np.log(1e-9)

#: Letters of another alphabet, or free accents, next to an ASCII letter.
_MIXED = re.compile("[A-Za-z][Ѐ-ӿͰ-Ͽ¨¯´¸ˆˇ˘-˝]|[Ѐ-ӿͰ-Ͽ¨¯´¸ˆˇ˘-˝][A-Za-z]")


class Model:
    """The fitted model: ``kinds`` (transition counts), ``chars`` (character counts), ``priors`` by source and field."""

    def __init__(self, kinds: np.ndarray, chars: dict[str, float], priors: dict[tuple[str, str], dict[str, float]]) -> None:
        self.kinds, self.chars, self.priors = kinds, chars, priors

    def __getstate__(self) -> dict:
        return {"kinds": self.kinds, "chars": self.chars, "priors": self.priors}

    @cached_property
    def _step(self) -> list:
        pairs = self.kinds.sum(0) + 0.1
        pairs /= pairs.sum(1, keepdims=True)
        smooth = self.kinds + 2.0 * pairs[None]  # a pair of classes seen rarely falls back on its last one
        return np.log(smooth / smooth.sum(2, keepdims=True)).tolist()

    @cached_property
    def _char(self) -> tuple[dict[str, float], list[float]]:
        total = np.ones(len(_KINDS))
        for ch, n in self.chars.items():
            total[kind(ch)] += n + 0.2
        return {ch: float(np.log((n + 0.2) / total[kind(ch)])) for ch, n in self.chars.items()}, [float(x) for x in np.log(0.2 / total)]

    def _score(self, text: str) -> tuple[float, float, float]:
        """Log-plausibility of a text; mean and least of its transitions next to characters outside ASCII."""
        known, rare = self._char
        first, before, whole, told, steps = 0, 0, 0.0, [], self._step
        for ch in text:
            now = kind(ch)
            step = steps[first][before][now]
            whole += step + known.get(ch, rare[now])
            if ch > "\x7f" or (told and before > KIND["upper"]):
                told.append(step)
            first, before = before, now
        whole += steps[first][before][0]
        return whole, (sum(told) / len(told) if told else 0.0), (min(told) if told else 0.0)

    @cached_property
    def _pool(self) -> dict[str, float]:
        pool: dict[str, float] = {}
        for chains in self.priors.values():
            for chain, n in chains.items():
                pool[chain] = pool.get(chain, 0.0) + n
        return pool

    @cache  # noqa: B019
    def _prior(self, source: str, field: str, chain: str) -> float:
        pool, own = self._pool, self.priors.get((source, field), {})
        seen = sum(pool.values())
        # A chain nobody saw yet shares what one round leaves for all of them.
        base = (pool.get(chain, 0.0) + (1.0 / 200)) / (seen + 2.0) if chain else max(pool.get("", 0.0), 1.0) / max(seen, 1.0)
        return float(np.log((own.get(chain, 0.0) + POOLED * base) / (sum(own.values()) + POOLED)))

    def weigh(self, source: str, field: str, text: str) -> list[tuple[str, str | None, float]]:
        """The chains of a value: (chain, restored text, posterior), the likeliest first; '' is no chain, ``LOST`` restores nothing."""
        found = [(chain, back, score + self._prior(source, field, chain)) for chain, back, score in self._ways(text)]
        top = max(s for _, _, s in found)
        weights = [np.exp(s - top) for _, _, s in found]
        total = sum(weights)
        return sorted(((c, t, float(w / total)) for (c, t, _), w in zip(found, weights)), key=lambda x: (-x[2], x[0]))

    def _ways(self, text: str) -> list[tuple[str, str | None, float]]:
        """The chains of a value with what they restore and its plausibility: the same for all sources."""
        known = self.__dict__.setdefault("_known", {})
        if text in known:
            return known[text]
        if len(known) >= REMEMBERED:
            known.clear()
        form = canonical(text)
        changed = sum((Counter(text) - Counter(form)).values()) if form != text else 0
        plain, mean, least = self._score(form)
        cost = STAND_IN * min(changed, 6)
        strange = mean < STRANGE_MEAN or least < STRANGE_ONE or bool(_LOST.search(text)) or changed > 0
        # That right text is UTF-8 by another reading is a rare accident.
        accident = np.log(GARBLED) if next(_steps(text, False), None) else 0.0
        gone = len(_LOST_CHARS.findall(form)) if _LOST.search(text) else 0
        found: list[tuple[str, str | None, float]] = [("", text, plain + cost + accident + gone * LOST_RIGHT)]
        if gone:  # what is left is right text, and bytes are gone
            found.append((LOST, None, self._score(_LOST_CHARS.sub("", form))[0] + gone * LOST_CHAR))
        todo = [("", text, 0)]
        seen = {text}
        while todo:
            chain, now, depth = todo.pop()
            for step, back in _steps(now, strange and not depth):
                if back in seen or "\x00" in back:
                    continue
                seen.add(back)
                name = f"{chain}+{step}" if chain else step
                found.append((name, back, self._score(back)[0]))
                if depth < 2 and step.endswith("<utf-8") and not back.isascii():
                    todo.append((name, back, depth + 1))
        known[text] = found
        return found

    def repair(self, source: str, field: str, text: str) -> tuple[bool, str | None, float]:
        """Whether a value is garbled, the restored text where that is possible, and the posterior of being garbled."""
        if text.isascii():
            return False, None, 0.0
        ways = self.weigh(source, field, text)
        garbled = 1 - sum(p for c, _, p in ways if not c)
        best = next(((c, t) for c, t, _ in ways if c), None)
        return (True, best[1], garbled) if garbled > DECISION and best else (False, None, garbled)

    @staticmethod
    def fit(files: DataFrame, reuse: bool = False) -> Model:
        """Expectation-maximization over all titles, artists and albums of ``files``.

        ``reuse`` takes the model an earlier call of the session fitted to the same values, if there is one. The
        registered queries do not: each does its whole work whenever it is run.
        """
        spark, values = files.sparkSession, texts(files)
        # The rounds are work for Python: spread over all partitions, not by bytes, and a text of many sources once.
        seen = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("source", "field", "text")).alias("x"))
        counted = Stored(values.filter("text <> ''").groupBy("source", "field", "text").count().drop("count").repartition(partitions(spark), "text"), *seen)
        known, same = spark.sparkContext.__dict__.setdefault("_reprise_models", {}), (counted.seen["n"], counted.seen["x"])
        if reuse and same in known:
            counted.drop()
            return known[same]
        model = None
        ddl = "what string, key string, n double"
        plain = counted.df.filter(~F.col("text").rlike(r"[^\x00-\x7f]")).mapInArrow(_plain_counts, ddl).groupBy("what", "key").agg(F.sum("n").alias("n")).collect()
        strange = counted.df.filter(F.col("text").rlike(r"[^\x00-\x7f]"))
        for _ in range(ROUNDS + 1):
            told = strange.mapInArrow(_expect(model), ddl).groupBy("what", "key").agg(F.sum("n").alias("n")).collect()
            model = _maximize([*plain, *told])
        counted.drop()
        known.clear()  # the last model alone is kept
        known[same] = model
        return model

    def flag(self, values: DataFrame) -> DataFrame:
        """Rows (file_id, field, text, repaired, posterior) of the garbled among (file_id, field, source, text)."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple, tuple] = {}
            for batch in batches:
                keep, repaired, sure = [], [], []
                for key in zip(*(batch.column(c).to_pylist() for c in ("source", "field", "text"))):
                    if key not in seen:
                        if len(seen) > 50_000:
                            seen.clear()
                        seen[key] = model.repair(*key)
                    bad, back, p = seen[key]
                    keep.append(bad)
                    if bad:
                        repaired.append(back)
                        sure.append(p)
                rest = batch.select(["file_id", "field", "text"]).filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(repaired, pa.string()), pa.array(sure, pa.float64())], ["file_id", "field", "text", "repaired", "posterior"])

        ddl = "file_id bigint, field string, text string, repaired string, posterior double"
        return values.filter(F.col("text").rlike(r"[^\x00-\x7f]")).select("file_id", "field", "source", "text").mapInArrow(run, ddl)


def source_of(path: Column) -> Column:
    """The source of a record: the first two parts of its path."""
    return F.coalesce(F.regexp_extract(path, r"^(/[^/]+/[^/]+)", 1), F.lit(""))


def texts(files: DataFrame) -> DataFrame:
    """Rows (file_id, field, source, text) of the titles, artists and albums, without nulls."""
    said = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in ("title", "artist", "album")])
    return files.select(F.col("id").alias("file_id"), source_of(F.col("path")).alias("source"), F.explode(said).alias("s")).select("file_id", "s.field", "source", "s.text").filter("text IS NOT NULL")


def _rows(counts: dict) -> Iterator[pa.RecordBatch]:
    steps = counts.pop("kinds")
    counts |= {("kinds", f"{a} {b} {c}"): steps[a, b, c] for a, b, c in zip(*np.nonzero(steps))}
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([float(counts[k]) for k in keys], pa.float64())], ["what", "key", "n"])


def _add(counts: dict, text: str, weight: float) -> None:
    first = before = 0
    for ch in (*text, None):
        now = kind(ch) if ch else 0
        steps = counts["kinds"]
        steps[first, before, now] += weight
        if ch:
            counts["char", ch] = counts.get(("char", ch), 0.0) + weight
        first, before = before, now


def _plain_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ASCII texts tell: they are what they are."""
    classes = np.array([kind(chr(c)) if c else 0 for c in range(128)])
    steps, chars = np.zeros((len(_KINDS),) * 3), np.zeros(128)
    counts: dict = {"kinds": steps}
    for batch in batches:
        # Two separators stand before each text, one of which also ends the text before it.
        codes = np.frombuffer(("\0\0" + "\0\0".join(batch.column("text").to_pylist()) + "\0").encode(), np.uint8)
        np.add.at(steps, (classes[codes[:-2]], classes[codes[1:-1]], classes[codes[2:]]), 1)
        chars += np.bincount(codes, minlength=128)[:128]
        for s, f in zip(batch.column("source").to_pylist(), batch.column("field").to_pylist()):
            key = ("chain", f"{s}\t{f}\t")
            counts[key] = counts.get(key, 0.0) + 1
    steps[:, 0, 0] = 0  # the step from the end of a text to the start of the next
    counts |= {("char", chr(c)): chars[c] for c in np.flatnonzero(chars) if c}
    yield from _rows(counts)


def _expect(model: Model | None):
    """The E-step over a part of the values; without a model a value stands for itself unless it is other UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {"kinds": np.zeros((len(_KINDS),) * 3)}
        for batch in batches:
            for source, field, text in zip(*(batch.column(c).to_pylist() for c in ("source", "field", "text"))):
                if model is None:
                    # Bytes that are UTF-8 by another reading, lost, or letters mixed within a word are hardly ever so by chance.
                    form = canonical(text)
                    sure = GARBLED if _LOST.search(text) or _MIXED.search(form) or next(_steps(text, False), None) else 1 - GARBLED
                    _add(counts, form, sure)
                    key = ("chain", f"{source}\t{field}\t")
                    counts[key] = counts.get(key, 0.0) + sure
                    if _LOST.search(text):
                        key = ("chain", f"{source}\t{field}\t{LOST}")
                        counts[key] = counts.get(key, 0.0) + (1 - sure) / 2
                    continue
                for chain, back, p in model.weigh(source, field, text):
                    if p > 0.001:
                        if chain != LOST and (chain or not _LOST.search(text)):
                            _add(counts, back if chain else canonical(text), p)
                        key = ("chain", f"{source}\t{field}\t{chain}")
                        counts[key] = counts.get(key, 0.0) + p
        yield from _rows(counts)

    return run


def _maximize(rows: list) -> Model:
    kinds, chars, priors = np.zeros((len(_KINDS),) * 3), {}, {}
    for what, key, n in rows:
        if what == "kinds":
            kinds[tuple(map(int, key.split()))] += n
        elif what == "char":
            chars[key] = chars.get(key, 0.0) + n
        else:
            source, field, chain = key.split("\t")
            of = priors.setdefault((source, field), {})
            of[chain] = of.get(chain, 0.0) + n
    return Model(kinds, chars, priors)


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").select("id", "path", "title", "artist", "album")
    return Model.fit(files).flag(texts(files))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_found: titles, artists and albums that are the result of reading bytes in the wrong encoding."""
    return _flagged(spark, sf_dir).select("file_id", "field").distinct()


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_repaired: the same, with the text as stored and restored (null where that is impossible)."""
    return _flagged(spark, sf_dir).select("file_id", "field", "text", "repaired").distinct()


QUERIES = {"p7_found": found, "p7_repaired": repaired}
ORACLES: dict = {}
