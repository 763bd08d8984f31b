"""Evaluation texts leaking into training text, by an FM-index per training shard.

The words of a shard of documents become one sequence with a separator after each document; its suffix array
gives the Burrows-Wheeler transform, kept as a wavelet matrix. All phrases of ``SEED`` words of the test
passages are searched backward at once, each step being two vectorised ranks; occurrences are located by
walking to the next sampled suffix. Seeds grow into stretches in which single words may be changed, added or
left out with ten or more kept words between them; stretches of one document and item merge into spans.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import latest, table

#: Kept words a stretch needs, and kept words between two changes; the second is also the length of a seed,
#: as every stretch of 20 kept words has 10 in a row.
LEAST, SEED = 20, 10
#: Words of documents indexed together, and of items searched in one pass.
SHARD_WORDS, ITEM_WORDS = 400_000, 2_000_000
#: Of so many suffixes one is sampled.
SAMPLE = 8

_BREAKS = re.compile(r"<\s*/?\s*(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|pre)\b[^<>]*>", re.I)
_MARKS = re.compile("<!--.*?-->|</?[a-zA-Z][^<>]*>|\\[/?(?:b|i|u|s|quote|code|url|size|color)(?:=[^\\]]*)?\\]|\\*\\*|__|`|[­​-‏⁠-⁤﻿]", re.S | re.I)
_WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in one form: without markup, case, punctuation, blanks and invisible characters."""
    if not text:
        return []
    text = html.unescape(text) if "&" in text else text
    if "<" in text:
        text = _BREAKS.sub(" ", text)
    text = _MARKS.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORDS.findall(text.casefold())


class WaveletMatrix:
    """Ranks over a sequence of small integers, one bit plane a level."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.levels, self.ones, self.zeros = max(1, int(top).bit_length()), [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before each position."""
        start, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (value >> (self.levels - 1 - k)) & 1 == 1
            s, e = ones[start], ones[end]
            start = np.where(bit, zeros + s, start - s)
            end = np.where(bit, zeros + e, end - e)
        return end - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Unique separators end it after the longest repeated stretch."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Index of word sequences; ``find`` gives all occurrences of equally long phrases."""

    def __init__(self, docs: list[np.ndarray], words_in: int) -> None:
        """``docs`` hold numbers from 1 to ``words_in``."""
        sizes = np.array([len(d) + 1 for d in docs])
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        text = np.zeros(int(self.starts[-1]), np.int64)
        for d, at in zip(docs, self.starts):
            text[at : at + len(d)] = d
        ends = self.starts[1:] - 1
        unique = text + len(docs)
        unique[ends] = np.arange(len(docs))
        order = suffix_array(unique)
        self.text = text
        bwt = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=words_in + 1))))
        self.matrix, self.bwt = WaveletMatrix(bwt, words_in), bwt
        sampled = (order % SAMPLE == 0) | (bwt == 0)  # the starts of documents too: no walk leaves its document
        self.sampled, self.samples = sampled, np.full(len(order), -1, np.int64)
        self.samples[sampled] = order[sampled]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, position in the text) of each occurrence."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.text), np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[live, k]
            low[live] = self.before[word] + self.matrix.rank(word, low[live])
            high[live] = self.before[word] + self.matrix.rank(word, high[live])
            live = live[low[live] < high[live]]
        count = high[live] - low[live]
        which = np.repeat(live, count)
        row = np.repeat(low[live] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum())) if len(live) else np.zeros(0, np.int64)
        walked, open_ = np.zeros(len(row), np.int64), np.flatnonzero(~self.sampled[row]) if len(row) else np.zeros(0, np.int64)
        while len(open_):
            word = self.bwt[row[open_]]
            row[open_] = self.before[word] + self.matrix.rank(word, row[open_])
            walked[open_] += 1
            open_ = open_[~self.sampled[row[open_]]]
        return which, (self.samples[row] + walked if len(row) else row)


def _run(a: np.ndarray, i: int, b: np.ndarray, j: int, step: int) -> int:
    """Equal words from ``a[i]`` and ``b[j]`` on, forward or backward."""
    n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
        n, i, j = n + 1, i + step, j + step
    return n


def stretch(doc: np.ndarray, d: int, item: np.ndarray, i: int) -> tuple[int, int, int]:
    """The stretch around the seed at ``doc[d]`` and ``item[i]``: (kept words, first and last position in ``doc``)."""
    right, left = _run(doc, d, item, i, 1), _run(doc, d - 1, item, i - 1, -1)
    kept = right + left
    ends = []
    for step, x, y in ((1, d + right, i + right), (-1, d - 1 - left, i - 1 - left)):
        last = SEED
        while last >= SEED:
            tries = [(_run(doc, x + p * step, item, y + q * step, step), p, q) for p, q in ((1, 1), (1, 0), (0, 1))]
            last, p, q = max(tries, key=lambda t: (t[0], t[1] + t[2]))
            if last:
                kept += last
                x, y = x + (p + last) * step, y + (q + last) * step
        ends.append(x)
    return kept, ends[1] + 1, ends[0] - 1


class Items:
    """Test passages as words; ``phrases`` are their seeds, ``of`` says whose and where."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.ids = [r[0] for r in rows]
        self.words = [words(r[1]) for r in rows]

    def search(self, ids: list, texts: list[list[str]]) -> Iterator[tuple]:
        """(document, item, kept, first word, last word) of every stretch long enough, each once."""
        wanted = {w for p in self.words for w in p}
        number: dict[str, int] = {}
        # Words of no item are one number: they end every match, and the alphabet stays that of the items.
        for w in wanted:
            number[w] = len(number) + 2
        docs = [np.array([number.get(w, 1) for w in t], np.int64) for t in texts]
        items = [np.array([number[w] for w in p], np.int64) for p in self.words]
        index = FMIndex(docs, len(number) + 1)
        seeds = [(k, i) for k, p in enumerate(items) for i in range(len(p) - SEED + 1)]
        if not seeds:
            return
        phrases, inverse = np.unique(np.array([items[k][i : i + SEED] for k, i in seeds]), axis=0, return_inverse=True)
        of: dict[int, list[tuple[int, int]]] = {}
        for s, n in zip(seeds, inverse.ravel().tolist()):
            of.setdefault(n, []).append(s)
        which, at = index.find(phrases)
        doc = np.searchsorted(index.starts, at, side="right") - 1
        done: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        order = np.lexsort((at, doc))
        for n, d, p in zip(which[order].tolist(), doc[order].tolist(), (at - index.starts[doc])[order].tolist()):
            for k, i in of[n]:
                spans = done.setdefault((d, k), [])
                if any(a <= p <= b and diagonal == p - i for a, b, diagonal in spans):
                    continue
                kept, a, b = stretch(docs[d], p, items[k], i)
                spans.append((p, p + _run(docs[d], p, items[k], i, 1) - SEED, p - i))
                if kept >= LEAST:
                    yield ids[d], self.ids[k], kept, a, b


SPANS = "doc_id bigint, item_id bigint, kept bigint, first_word bigint, last_word bigint"


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Stretches of test passages in documents: rows (doc_id, item_id, kept, first_word, last_word).

    ``docs`` has (doc_id, text), ``items`` (item_id, passage). Positions count words from 0. Overlapping finds of
    one item in one document merge into one span. Null and empty texts and passages, and passages of fewer than
    ``LEAST`` words, hold nothing; documents are read whole. Items are searched in blocks of bounded size.
    """
    size = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("n")).first()["n"] // 5
    blocks = max(1, -(-size // ITEM_WORDS))
    found = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)  # bounded: one block
        part = _search(docs, Items([tuple(r) for r in own.select("item_id", "passage").filter("item_id IS NOT NULL").distinct().collect()]))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id", "last_word").agg(F.max("kept").alias("kept"), F.min("first_word").alias("first_word"))


def _search(docs: DataFrame, items: Items) -> DataFrame:
    names = ("doc_id", "item_id", "kept", "first_word", "last_word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            rows = list(zip(*items.search(ids, texts))) if ids else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows or [[]] * 5], list(names))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(text)
                if len(own) >= LEAST:
                    ids.append(key)
                    texts.append(own)
                    size += len(own)
                if size >= SHARD_WORDS:
                    yield close()
                    ids, texts, size = [], [], 0
        yield close()

    return docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, SPANS)


def _leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = latest(spark, sf_dir, "documents", "doc_id", "ingested_at", "text")
    return leaked(docs, table(spark, sf_dir, "eval_items").select("item_id", "passage"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_found: the documents that hold a stretch of an item's passage, with the item."""
    return _leaked(spark, sf_dir).select("doc_id", "item_id").distinct()


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_spans: the stretches to remove, by the positions of their first and last words."""
    return _leaked(spark, sf_dir).select("doc_id", "item_id", "kept", "first_word", "last_word")


QUERIES = {"p9_found": found, "p9_spans": spans}
ORACLES: dict = {}
