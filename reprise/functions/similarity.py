"""Similarity of texts, durations and fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ARTIST_SEPARATOR, fold_script, normalize, normalized_parts, wide_key

#: Offsets tried on either side, and the least overlap that counts.
OFFSETS, OVERLAP = 8, 20


def artist_tokens(artist: Column) -> Column:
    """The artists of a credit, each normalised; the class of separators holds the letter x on purpose."""
    return normalized_parts(artist, ARTIST_SEPARATOR)


def share_of_tokens(a: Column, b: Column) -> Column:
    """M1: share of the tokens of ``a`` that equal, hold or lie within one of ``b``, by the longer list. Asymmetric."""
    hit = F.filter(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(hit) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    """M4: 1 for equal texts, 0 if one is empty, else one less the edits by the longer length."""
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def plausible(title_a: Column, title_b: Column, artist_a: Column, artist_b: Column) -> Column:
    """M3: titles, or artists, both there and similar by half or more (arguments normalised)."""
    near = lambda a, b: (a != "") & (b != "") & (edit_similarity(a, b) >= 0.5)
    return near(title_a, title_b) | near(artist_a, artist_b)


def bigrams(key: Column) -> Column:
    """Distinct pairs of adjacent characters; a single character stands for itself."""
    n = F.length(key)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2))))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column, fold: dict[str, str] | None = None) -> Column:
    """Dice coefficient of the bigrams of two texts, after folding script variants."""
    a, b = wide_key(fold_script(a, fold)), wide_key(fold_script(b, fold))
    x, y = bigrams(a), bigrams(b)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def script_of(text: Column, fold: dict[str, str]) -> Column:
    """Which script variant a text is in, 'cn' (simple) or 'tw' (traditional); null where it has no character of ``fold``, or of both."""
    simple, traditional = (F.translate(text, "".join(m), "".join(m.values())) for m in (fold, {v: k for k, v in fold.items()}))
    return F.when((text == simple) & (text != traditional), "cn").when((text == traditional) & (text != simple), "tw")


def script_agreement(a: Column, b: Column) -> Column:
    """1 for the same variant, 0 for different ones, half where either is unknown."""
    return F.when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.0).otherwise(0.0)


def duration_score(a: Column, b: Column) -> Column:
    """Steps of agreement of two durations in seconds; null where one is missing."""
    gap = F.abs(a - b)
    return F.when((a > 0) & (b > 0), F.when(gap <= 3, 1.0).when(gap <= 8, 0.6).when(gap <= 20, 0.2).otherwise(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 32-bit words."""
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(0xFFFFFFFF)))


def sliding_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """M5, M8: share of equal bits at the offset with most equal bits (the first such), 0 without enough overlap."""
    best, result = -1, 0.0
    for offset in range(-OFFSETS, OFFSETS + 1):
        a, b = x[max(0, offset) :], y[max(0, -offset) :]
        n = min(len(a), len(b))
        if n >= OVERLAP:
            same = 32 * n - int(np.bitwise_count(a[:n] ^ b[:n]).sum())
            if same > best:
                best, result = same, same / (32 * n)
    return result


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all lists in a row, and where each list starts and how long it is (0 for null)."""
    words = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).astype(np.uint32)
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return words, np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes, sizes


def sliding_similarities(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """``sliding_similarity`` of two columns: pairs of equal lengths are compared together, an offset at a time."""
    (xw, xs, xn), (yw, ys, yn) = _lists(x), _lists(y)
    out = np.zeros(len(xn))
    shapes, of = np.unique(np.stack([xn, yn], axis=1), axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    for (p, q), rows in zip(shapes, np.split(order, np.flatnonzero(np.diff(of.ravel()[order])) + 1)):
        if min(p, q) < OVERLAP:
            continue
        left, right = xw[xs[rows][:, None] + np.arange(p)], yw[ys[rows][:, None] + np.arange(q)]
        best, result = np.full(len(rows), -1, np.int64), np.zeros(len(rows))
        for offset in range(-OFFSETS, OFFSETS + 1):
            a, b = left[:, max(0, offset) :], right[:, max(0, -offset) :]
            n = min(a.shape[1], b.shape[1])
            if n >= OVERLAP:
                same = 32 * n - np.bitwise_count(a[:, :n] ^ b[:, :n]).sum(1, dtype=np.int64)
                more = same > best
                best[more], result[more] = same[more], same[more] / (32 * n)
        out[rows] = result
    return out


#: Of the keys of half words one in so many, by its own value, is kept.
KEPT_KEYS = 4


def half_word_keys(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists in a row: (list, key) of a choice of all pairs of halves of two words that follow one another.

    Lists in which every word differs by one bit still share a half of each word, and so a key at every place: of 120
    words about 30 keys are chosen. Of each kind of pair the least key is chosen too, so that lists of few different
    words have keys. A key of two zero halves is 0, always chosen, and shared by all silent lists.
    """
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = of[1:] == of[:-1]
    where = of[:-1][inside]
    if not len(where):
        return where, np.zeros(0, np.int64)
    edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    counts = np.diff(np.concatenate((edges, [len(where)])))
    halves, found = [w.astype(np.uint64) for w in (words & np.uint32(0xFFFF), words >> np.uint32(16))], []
    for n, (a, b) in enumerate((a, b) for a in halves for b in halves):
        pair = a[:-1][inside] << np.uint64(16) | b[1:][inside]
        mixed = (pair | np.uint64(n) << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        kept = (pair == 0) | ((mixed >> np.uint64(40)) % np.uint64(KEPT_KEYS) == 0) | (mixed == np.repeat(np.minimum.reduceat(mixed, edges), counts))
        tagged = np.where(pair == 0, np.uint64(0), pair | np.uint64(n) << np.uint64(32))
        found.append((where[kept].astype(np.uint64) << np.uint64(34)) | tagged[kept])  # 34 bits a key: lists of a batch fit beside
    both = np.sort(np.concatenate(found))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return (both >> np.uint64(34)).astype(np.int64), (both & np.uint64((1 << 34) - 1)).astype(np.int64)


def with_half_word_keys(rows: DataFrame, words: str) -> DataFrame:
    """Rows (id, own, and a word list) to (id, own, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, _, sizes = _lists(batch.column(2))
            of, keys = half_word_keys(flat, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(keys)], ["id", "own", "key"])

    return rows.select("id", "own", words).mapInArrow(run, "id bigint, own int, key bigint")


def score_pairs(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds ``name``: the sliding similarity of the word lists in columns ``a`` and ``b`` (null lists score 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = sliding_similarities(batch.column(a), batch.column(b))
            rest = batch.select([c for c in batch.schema.names if c not in (a, b)])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sims, pa.float64())], [*rest.schema.names, name])

    kept = [f for f in pairs.schema if f.name not in (a, b)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pairs.mapInArrow(run, f"{ddl}, `{name}` double")


def title_fingerprint_similarity(title_a: Column, title_b: Column, seconds_a: Column, seconds_b: Column, compat: bool = False) -> Column:
    """M7: similarity of fingerprints made from tags: of the titles where durations agree within 8 s, at most 0.96.

    ``compat`` compares the written whole durations instead, as the original does by an oversight.
    """
    text = lambda s: F.floor(F.coalesce(s, F.lit(0.0)) + 0.5).cast("string")
    sim = edit_similarity(text(seconds_a), text(seconds_b)) if compat else edit_similarity(normalize(title_a), normalize(title_b))
    near = F.lit(True) if compat else F.abs(seconds_a - seconds_b) <= 8
    return F.when(near & (sim >= 0.75), F.least(sim, F.lit(0.96))).otherwise(0.0)


def fingerprint_similarity(method_a: Column, method_b: Column, equal: Column, spectral: Column, tagged: Column) -> Column:
    """M6: which similarity applies to two fingerprints, one of which may be made from tags (method 'metadata')."""
    a, b = (F.coalesce(m == "metadata", F.lit(False)) for m in (method_a, method_b))
    return F.when(a & b, tagged).when(a | b, 0.0).when(equal, 1.0).otherwise(spectral)
