"""Encoding of the whole corpus with a public byte-level BPE tokenizer: speculate and verify.

Greedy longest match proposes the tokens of every new word of a batch. A token sequence is what the merges give
if and only if every two neighbours are: so all adjacent pairs of the batch are checked at once as packed
integers, each distinct pair being merged only the first time it is seen, and only words with a failing pair go
through exact merging.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import latest

#: Where the vocabulary files are; ``REPRISE_TOKENIZERS`` names another folder.
FOLDER = os.environ.get("REPRISE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits a text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words, and pairs of tokens, a worker remembers before it starts anew.
REMEMBERED = 400_000


class BytePairs:
    """A byte-level BPE vocabulary, ranks being ids."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.words: dict[str, list[int]] = {}
        self.pairs = np.zeros(0, np.int64)  # checked pairs, sorted
        self.valid = np.zeros(0, bool)
        self.split = regex.compile(PATTERN).findall

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place."""
        out, at, ranks = [], 0, self.ranks
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                token = ranks.get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost on a tie, in O(n log n)."""
        parts: list[bytes] = [word[k : k + 1] for k in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, k) for k in range(len(parts) - 1) if (r := self.ranks.get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            n = after[k] if parts[k] else len(parts)
            if n >= len(parts) or self.ranks.get(parts[k] + parts[n]) != rank:
                continue
            parts[k] += parts[n]
            parts[n] = b""
            after[k] = after[n]
            if after[k] < len(parts):
                before[after[k]] = k
                if (r := self.ranks.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := self.ranks.get(parts[before[k]] + parts[k])) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [self.ranks[p] for p in parts if p]

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stays as it is, by one search in the pairs checked so far."""
        at = np.searchsorted(self.pairs, pairs)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == pairs[known]
        if not known.all():
            new = np.unique(pairs[~known])
            fits = []
            for pair in new.tolist():
                a, b = pair >> 32, pair & 0xFFFFFFFF
                fits.append(self.merge(self.bytes[a] + self.bytes[b]) == [a, b])
            merged = np.concatenate([self.pairs, new])
            order = np.argsort(merged, kind="stable")
            self.pairs, self.valid = merged[order], np.concatenate([self.valid, np.array(fits, bool)])[order]
            at = np.searchsorted(self.pairs, pairs)
        return self.valid[at]

    def learn(self, words: set[str]) -> None:
        """Encodes words not seen yet."""
        names, guesses = [], []
        for word in words:
            raw = word.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.words[word] = [whole]
            else:
                names.append((word, raw))
                guesses.append(self.greedy(raw))
        if not names:
            return
        sizes = np.array([len(g) for g in guesses])
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(guesses)), sizes)
        inside = of[1:] == of[:-1]
        failing = np.zeros(len(guesses), bool)
        failing[of[:-1][inside][~self._compatible(((flat[:-1] << 32) | flat[1:])[inside])]] = True
        for (word, raw), guess, bad in zip(names, guesses, failing):
            self.words[word] = self.merge(raw) if bad else guess

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.pairs) > REMEMBERED:
            self.pairs, self.valid = self.pairs[:0], self.valid[:0]
        if new := set(chain.from_iterable(split)) - self.words.keys():
            self.learn(new)
        return [list(chain.from_iterable(map(self.words.__getitem__, words))) for words in split]


@cache
def tokenizer(path: str) -> BytePairs:
    return BytePairs(path)


def token_ids(texts: DataFrame, item: str, text: str, path: str) -> DataFrame:
    """Rows (item, ids) of all texts, without special tokens.

    An empty and a null text have the empty list; texts are encoded whole, whatever their length; each row of
    the input gives one row; an empty table gives none. The vocabulary is sent to the workers, wherever they run.
    """
    texts.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = tokenizer(SparkFiles.get(os.path.basename(path)))
        for batch in batches:
            ids = pairs.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [item, "ids"])

    kind = texts.schema[item].dataType.simpleString()
    return texts.select(item, text).mapInArrow(run, f"`{item}` {kind}, ids array<int>")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_ids: the ids of every document by byte_bpe_50k."""
    return token_ids(latest(spark, sf_dir, "documents", "doc_id", "ingested_at", "text"), "doc_id", "text", f"{FOLDER}/byte_bpe_50k.tiktoken")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_sizes: numbers of documents and tokens per source."""
    sources = latest(spark, sf_dir, "documents", "doc_id", "ingested_at", "source")
    counted = ids(spark, sf_dir).select("doc_id", F.size("ids").cast("bigint").alias("n"))
    return counted.join(sources, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))


QUERIES = {"p8_ids": ids, "p8_sizes": sizes}
ORACLES: dict = {}
