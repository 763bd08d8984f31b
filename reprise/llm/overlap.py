"""Near-duplicate records with small edits, by a blocked sparse matrix product.

The incidence matrix of documents by grams (here the 32-bit words of a fingerprint, and the pairs of halves of two words
in succession, which lists share even where no word is equal bit for bit) is multiplied with its own transpose in cells: the
lists of a range of durations with themselves, those up to ten seconds longer and those of unknown duration. Where these are
many, both sides are cut by hash and a cell holds a part of either. So each task sees all grams of its pairs: lists are sent
but no grams and no counts, which by chance alone grow with the square of the lists. Grams are sorted in slices, pairs below a
bound that follows from their sizes are discarded, and what is left is compared word by word. Exact copies are one class
from the start, so only classes are multiplied; a gram that many classes share is counted only for pairs that share
another one, or for lists it is enough for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, partitions, table

#: Two words correspond where at most so many of their 32 bits differ.
BITS = 4
#: Share of either list that must have a counterpart, and the shortest stretch whose inner order is kept.
SHARE, STRETCH = 0.75, 3
#: Durations, where both are known, differ by no more seconds.
SECONDS = 10.0
#: A list with a smaller share of non-zero words never counts.
NON_ZERO = 0.1
#: A pair must share a gram for every so many of the different words of the poorer list to be compared.
EXACT_ONE_IN = 60
#: Words of a cell, pairs of a cell that are counted at once, and words whose grams are sorted at once.
BLOCK, SLICE, SORTED = 60_000_000, 2_000_000, 1_000_000
#: Pairs of a cell that are held; where there are more, its lists are taken in several turns.
PAIRS = 7_000_000
#: Durations are counted by the second up to this one; a range of them spans as many as ``SECONDS`` can reach.
LONGEST, SPAN = 100_000, int(SECONDS) + 1
#: Word pairs of two lists that are compared at once.
CELLS = 4_000_000
#: A gram of more classes of a cell than this is counted last.
HOT = 512


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, seconds, h1, h2, fingerprint) to (..., words) with the words as bytes; almost silent lists leave here."""
    for batch in batches:
        lists = batch.column("fingerprint")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        flat = np.nan_to_num(flat).astype(np.int64).astype(np.uint32)
        sizes = np.diff(lists.offsets.to_numpy())
        starts = np.concatenate(([0], np.cumsum(sizes)))
        filled = np.concatenate(([0], np.cumsum(flat != 0)))
        keep = filled[starts[1:]] - filled[starts[:-1]] >= NON_ZERO * sizes
        words = pa.array([flat[a:b].tobytes() for a, b, k in zip(starts, starts[1:], keep) if k], pa.binary())
        rest = batch.drop_columns("fingerprint").filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*rest.columns, words], [*rest.schema.names, "words"])


def grams(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, document) of lists in a row, each once a document: their words, and the pairs of halves of neighbours;
    and how many different words each document has.

    Where every word of two lists differs by a bit, a half of each is equal still, and so is one of the four pairs of
    halves of any two neighbours. Two zero halves are no gram beside the zero word.
    """
    own = _distinct(doc.astype(np.uint64) << np.uint64(32) | words)
    distinct = np.bincount((own >> np.uint64(32)).astype(np.int64)).astype(np.int32)
    low, high = (x.astype(np.uint64) for x in (words & np.uint32(0xFFFF), words >> np.uint32(16)))
    inside = doc[1:] == doc[:-1]
    where = doc[:-1][inside].astype(np.uint64) << np.uint64(32)
    keys = [own]
    for n, (a, b) in enumerate((x, y) for x in (low, high) for y in (low, high)):
        pair = a[:-1][inside] << np.uint64(16) | b[1:][inside]
        mixed = (pair | np.uint64(n + 1) << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        keys.append((where | mixed >> np.uint64(28) & np.uint64(0xFFFFFFFF))[pair != 0])
    key = _distinct(np.concatenate(keys))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.int64), distinct


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting: for many distinct ones far quicker than by hashing."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


#: A list carries its size as steps of this ratio and its duration in tenths of a second: enough to leave out
#: most pairs at once; what is near the bounds is compared exactly later.
RATIO = 1.06


class Cells:
    """Which cells lists go to. ``ticks`` has the words of the lists of each whole second, ``unknown`` those of no known duration.

    Each range of at least ``SPAN`` seconds has ``low`` parts of its own lists and ``high`` parts of those it meets besides.
    Cells follow one another: each low part with each high part, then each two low parts. The last range is that of unknown durations.
    """

    def __init__(self, ticks: dict[int, int], unknown: int, parts: int) -> None:
        least = min(BLOCK // 3, -(-(sum(ticks.values()) + unknown) // parts))
        self.start, own, first = [], [], []
        for t in sorted(ticks):
            if not own or (t - self.start[-1] >= SPAN and own[-1] >= least):
                self.start.append(t)
                own.append(0)
                first.append(0)
            if t - self.start[-1] < SPAN:
                first[-1] += ticks[t]  # the range before meets no more than these
            own[-1] += ticks[t]
        meets = [n + unknown for n in (*first[1:], 0)] if own else []
        grids = [self._grid(n, m) for n, m in zip([*own, unknown], [*meets, 0])]
        self.low, self.high = (np.array([g[n] for g in grids], np.int64) for n in (0, 1))
        self.base = np.concatenate(([0], np.cumsum(self.low * self.high + self.low * (self.low - 1) // 2)))
        self.ends = np.array([*self.start[1:], LONGEST + 1], np.int64) if own else np.zeros(0, np.int64)
        self.start = np.array(self.start, np.int64)

    @staticmethod
    def _grid(own: int, meets: int) -> tuple[int, int]:
        """In how many parts either side is cut, so that the words sent are fewest."""
        best = None
        for low in range(1, 4 * own // BLOCK + 3):
            room = BLOCK - own // low
            high = -(-meets // room) if meets and room > 0 else 1
            if (room >= own // low or low == 1 and own <= BLOCK) and (room > 0 or not meets):
                cost = own * (high + low - 1) + meets * low
                best = min(best or (cost, low, high), (cost, low, high))
        return best[1:] if best else (4 * own // BLOCK + 3, 4 * meets // BLOCK + 3)

    def of(self, rep: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, side) of lists; sides are 0 (met by its own side too), 2 (not so) and 1, the other one."""
        unknown = np.isnan(seconds)
        tick = np.minimum(np.where(unknown, 0, seconds), LONGEST).astype(np.int64)
        last = len(self.low) - 1
        place = np.where(unknown, last, np.searchsorted(self.start, tick, "right") - 1)
        mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        rows, cells, sides = [], [], []

        def add(row: np.ndarray, cell: np.ndarray, side: np.ndarray) -> None:
            rows.append(row)
            cells.append(cell)
            sides.append(np.broadcast_to(side, len(row)))

        low, high, base = self.low[place], self.high[place], self.base[place]
        part = (mixed % low.astype(np.uint64)).astype(np.int64)
        for k in range(int(high.max(initial=0))):
            at = np.flatnonzero(high > k)
            add(at, base[at] + part[at] * high[at] + k, np.int32(2 * (k > 0)))
        for k in range(int(low.max(initial=0))):
            at = np.flatnonzero((low > k) & (part != k))
            i, j = np.minimum(part[at], k), np.maximum(part[at], k)
            add(at, base[at] + low[at] * high[at] + i * (2 * low[at] - i - 1) // 2 + j - i - 1, np.where(part[at] < k, 2, 1).astype(np.int32))
        before = np.flatnonzero(~unknown & (place > 0))
        before = before[tick[before] - self.start[place[before]] < SPAN]
        met = [(before, place[before] - 1), *((at, np.full(len(at), r)) for at in [np.flatnonzero(unknown)] for r in range(last))]
        for row, of in met:
            part = (mixed[row] % self.high[of].astype(np.uint64)).astype(np.int64)
            for k in range(int(self.low[of].max(initial=0))):
                at = self.low[of] > k
                add(row[at], self.base[of[at]] + k * self.high[of[at]] + part[at], np.int32(1))
        return tuple(np.concatenate(x) for x in (rows, cells, sides))


def _deal(cells: Cells):
    """Lists (rep, seconds, words) to each cell they go to, with how many grams a pair must share by the number of its different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("words").to_pylist()
            doc = np.repeat(np.arange(len(raw), dtype=np.uint64), [len(x) // 4 for x in raw])
            own = _distinct(doc << np.uint64(32) | np.frombuffer(b"".join(raw), np.uint32))
            distinct = np.bincount((own >> np.uint64(32)).astype(np.int64), minlength=len(raw))
            least = pa.array(np.minimum(255, -(-distinct // EXACT_ONE_IN)).astype(np.int32))
            rows, cell, side = cells.of(batch.column("rep").to_numpy(), batch.column("seconds").to_numpy(zero_copy_only=False).astype(np.float64))
            rest = pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("rep", "seconds", "words")), least], ["rep", "seconds", "words", "u"])
            for at in range(0, len(rows), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(cell[part].astype(np.int32)), pa.array(side[part]), *rest.take(pa.array(rows[part])).columns], ["cell", "side", *rest.schema.names])

    return run


def _fits(n: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs rough sizes and durations do not rule out."""
    n, s = n.astype(np.int32), s.astype(np.int32)
    known = (s[a] > 0) & (s[b] > 0)
    return (np.abs(n[a] - n[b]) <= np.ceil(-np.log(SHARE) / np.log(RATIO))) & ~(known & (np.abs(s[a] - s[b]) > 10 * SECONDS + 1))


def _pairs_of(grids: list[np.ndarray], n: np.ndarray, s: np.ndarray, kept=None) -> Iterator[np.ndarray]:
    """Keys ``low * width + high`` (places, not ids) of all allowed pairs within each row of document indexes, in slices."""
    width, keys, held = len(n), [], 0
    for grid in grids:
        left, right = np.triu_indices(grid.shape[1], 1)
        step = max(1, SLICE // 2 // max(1, len(left)))
        for at in range(0, len(grid), step):
            a, b = grid[at : at + step, left].ravel(), grid[at : at + step, right].ravel()
            a, b = np.minimum(a, b), np.maximum(a, b)
            ok = _fits(n, s, a, b) if kept is None else kept(a, b) & _fits(n, s, a, b)
            a, b = a[ok], b[ok]
            keys.append(a * width + b)
            held += len(a)
            if held >= SLICE:
                yield np.concatenate(keys)
                keys, held = [], 0
    if held:
        yield np.concatenate(keys)


class Lists:
    """The lists of a cell: words in a row, and of each list its id, side, size, duration and least number of common grams.

    ``place`` numbers them, those of the first side before the others.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        words, got = bytearray(), [[] for _ in range(5)]
        for batch in batches:
            raw = batch.column("words").to_pylist()
            words += b"".join(raw)
            got[0].append(np.array([len(x) // 4 for x in raw], np.int64))
            for to, name in zip(got[1:], ("rep", "side", "seconds", "u")):
                to.append(batch.column(name).to_numpy(zero_copy_only=False))
        sizes, ids, side, seconds, least = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got)
        self.words, self.edge = np.frombuffer(words, np.uint32), np.concatenate(([0], np.cumsum(sizes)))
        order = np.argsort(side == 1, kind="stable")
        self.first, self.alone = int((side != 1).sum()), not (side == 2).any()
        self.place = np.empty(len(order), np.uint64)
        self.place[order] = np.arange(len(order), dtype=np.uint64)
        self.row, self.ids, self.least, self.seconds = order, ids[order], least[order].astype(np.int64), seconds[order].astype(np.float64)
        tenths = np.nan_to_num(np.floor(self.seconds * 10), nan=-1.0)
        self.s = np.where((tenths < 0) | (tenths > 65_000), 0, tenths + 1).astype(np.uint16)
        self.n = np.minimum(255, np.log(np.maximum(1, sizes[order])) / np.log(RATIO)).astype(np.uint8)

    def list_of(self, place: int) -> np.ndarray:
        return self.words[self.edge[self.row[place]] : self.edge[self.row[place] + 1]]

    def shared(self) -> Iterator[np.ndarray]:
        """Sorted distinct ``gram << 32 | place`` of the grams that several lists share, in slices that hold all of a gram.

        The words are pairs of their own halves; each slice has the grams whose first half lies in a range.
        """
        halves = self.words.view(np.uint16)
        own = [halves[h::2] for h in (0, 1)]
        for one, first in enumerate(own):
            ends = np.cumsum(sum((np.bincount(first[x : x + SLICE], minlength=1 << 16) for x in range(0, len(first), SLICE)), np.zeros(1 << 16, np.int64)))
            at = until = 0
            while at < 1 << 16 and ends[-1]:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + SORTED, "right")))
                if to > until:  # positions of a wider range first, so that few ranges go over all words
                    until = max(to, int(np.searchsorted(ends, done + 8 * SORTED, "right")))
                    wide = np.concatenate([(np.flatnonzero(first[x : x + SLICE] - np.uint16(at) < until - at) + x).astype(np.uint32) for x in range(0, len(first), SLICE)])
                    values = first[wide]
                where = wide[values - np.uint16(at) < to - at].astype(np.int64)
                doc = np.searchsorted(self.edge, where, "right") - 1
                inside = where + 1 < self.edge[doc + 1]
                low = self.place[doc]
                x = first[where].astype(np.uint64) << np.uint64(48) | low
                if not one:
                    yield from self._runs(x | own[1][where].astype(np.uint64) << np.uint64(32), False)
                where, x, low = where[inside] + 1, x[inside], None
                for second in own:
                    yield from self._runs(x | second[where].astype(np.uint64) << np.uint64(32), True)
                at = to

    @staticmethod
    def _runs(key: np.ndarray, halves: bool) -> Iterator[np.ndarray]:
        if halves:
            key = key[key >> np.uint64(32) != 0]  # two zero halves are no gram beside the zero word
        key.sort()
        same = (key[1:] ^ key[:-1]) >> np.uint64(32) == 0
        some = np.concatenate((same, [False])) if len(key) else np.zeros(0, bool)
        some[1:] |= same
        key = key[some]
        if len(key):
            yield key[np.concatenate(([True], key[1:] != key[:-1]))]


def _sum(held: list[np.ndarray]) -> np.ndarray:
    """Keys ``pair << 8 | count``, each pair once; counts end at 255."""
    x = np.concatenate(held) if held else np.zeros(0, np.uint64)
    held.clear()
    if not len(x):
        return x
    x.sort()
    at = np.flatnonzero(np.concatenate(([True], x[1:] ^ x[:-1] > 255)))
    count = np.minimum(np.add.reduceat(x.astype(np.uint8), at, dtype=np.uint32), 255)
    x = x[at]
    x &= ~np.uint64(255)
    x |= count
    return x


def _counted(lists: Lists, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray] | int]:
    """Places (a, b), a < b, of pairs that share grams enough and whose first place lies in the range; and, first, where the range ended."""
    width, held, fresh, hot = len(lists.ids), [], 0, []
    if lists.alone:
        kept = lambda a, b: (a >= start) & (a < end)
    else:
        kept = lambda a, b: (a >= start) & (a < end) & (b >= lists.first)
    for key in lists.shared():
        local = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32), [True])))
        at, count = edge[:-1], np.diff(edge)
        some = (count > 1) & (local[at] < end)  # places are sorted within a gram
        at, count = at[some], count[some]
        hot += [local[x : x + c].astype(np.uint32) for x, c in zip(at[count > HOT], count[count > HOT])]
        grids = (local[at[count == c][:, None] + np.arange(c)] for c in np.unique(count[count <= HOT]))
        for keys in _pairs_of(grids, lists.n, lists.s, kept):
            pair, n = np.unique(keys, return_counts=True)
            held.append(pair.astype(np.uint64) << np.uint64(8) | np.minimum(n, 255).astype(np.uint64))
            fresh += len(pair)
            if fresh > PAIRS // 4:
                held, fresh = [_sum(held)], 0
                while len(held[0]) > PAIRS and end - start > 1:  # the later ones are left to another turn
                    owner = held[0] // np.uint64(width << 8)
                    end = max(start + 1, min(end - 1, int(owner[len(owner) // 2])))
                    held[0] = held[0][: np.searchsorted(owner, np.uint64(end))]
    yield end
    pairs = _sum(held)
    enough = np.zeros(width, bool)
    if hot:
        enough = np.bincount(np.concatenate(hot), minlength=width) >= lists.least
    rich = []
    for x in range(0, len(pairs), SLICE // 2):
        part = pairs[x : x + SLICE // 2]
        n, part = (part & np.uint64(255)).astype(np.int64), part >> np.uint64(8)
        a, b = (part // np.uint64(width)).astype(np.int64), (part % np.uint64(width)).astype(np.int64)
        counted = enough[a] | enough[b]
        if hot:
            rich.append((a[counted], b[counted], n[counted]))
            for own in hot:
                member = np.zeros(width, bool)
                member[own] = True
                n += member[a] & member[b]
        ok = (n >= np.minimum(lists.least[a], lists.least[b])) & ~counted
        yield a[ok], b[ok]
    del pairs
    # Lists with hot grams enough: all others are counted, list by list.
    of: dict[int, list[np.ndarray]] = {int(x): [] for x in np.flatnonzero(enough)}
    for own in hot:
        for x in own[enough[own]]:
            of[int(x)].append(own)
    ra, rb, rn = (np.concatenate(x) if rich else np.zeros(0, np.int64) for x in (zip(*rich) if rich else [()] * 3))
    by = [(np.argsort(x, kind="stable"), x) for x in (ra, rb)]
    for x, grams_of in of.items():
        total = np.zeros(width, np.int64)
        for own in grams_of:
            total[own] += 1
        for (order, key), other in zip(by, (rb, ra)):
            at = order[np.searchsorted(key, x, "left", sorter=order) : np.searchsorted(key, x, "right", sorter=order)]
            total[other[at]] += rn[at]
        y = np.flatnonzero((total >= np.minimum(lists.least, lists.least[x])) & (~enough | (np.arange(width) > x)))
        y = y[y != x]
        p, q = np.minimum(x, y), np.maximum(x, y)
        ok = kept(p, q) & _fits(lists.n, lists.s, p, q)
        yield p[ok], q[ok]


def _turns(lists: Lists, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    while start < end:
        found = _counted(lists, start, end)
        start = next(found)
        yield from found


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of a cell to the pairs of ids (a, b) whose lists cover each other well enough in stretches. Each task has one cell."""
    lists = Lists(batches)
    for a, b in _turns(lists, 0, lists.first):
        x, y = lists.seconds[a], lists.seconds[b]
        ok = (lists.ids[a] != lists.ids[b]) & ~(np.abs(x - y) > SECONDS + 1e-9)  # an id may come with several lists
        a, b = a[ok], b[ok]
        good = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = lists.list_of(i), lists.list_of(j)
            good[k] = np.array_equal(x, y) or covers(x, y)
        a, b = lists.ids[a[good]], lists.ids[b[good]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def covers(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether ``SHARE`` of either list lies in stretches of corresponding words, wherever they have moved.

    A stretch has ``STRETCH`` words, or as many as the shorter list has.
    """
    if min(len(x), len(y)) < SHARE * max(len(x), len(y)) or not len(x):
        return False
    run = min(STRETCH, len(x), len(y))
    if len(x) == len(y):  # most copies are aligned as they stand
        ok = np.bitwise_count(x ^ y) <= BITS
        if _spread(np.lib.stride_tricks.sliding_window_view(ok, run).all(1), run).mean() >= SHARE:
            return True
    left, right = np.zeros(len(x) - run + 1, bool), np.zeros(len(y) - run + 1, bool)
    step = max(run, CELLS // len(y))  # long lists are compared in bands of rows that overlap by a stretch
    for at in range(0, len(left), step):
        part = x[at : at + step + run - 1]
        ok = np.bitwise_count(part[:, None] ^ y[None, :]) <= BITS
        starts = ok[: len(part) - run + 1, : len(right)].copy()
        for k in range(1, run):
            starts &= ok[k : len(part) - run + 1 + k, k : len(right) + k]
        left[at : at + len(starts)] = starts.any(1)
        right |= starts.any(0)
    return bool(_spread(left, run).mean() >= SHARE and _spread(right, run).mean() >= SHARE)


def _spread(starts: np.ndarray, run: int) -> np.ndarray:
    held = np.zeros(len(starts) + run - 1, bool)
    for k in range(run):
        held[k : k + len(starts)] |= starts
    return held


class NearDuplicates:
    """Classes of exact copies and the links between their representatives.

    ``members`` has (id, rep, seconds): one row per record that takes part, ``rep`` being the smallest id with
    the same list and duration. ``links`` has (a, b), a < b, over representatives of different classes.
    Records whose list is null, empty or almost silent take no part; null or non-positive durations are
    unknown; repeated ids count once. An empty input gives two empty tables.
    """

    def __init__(self, records: DataFrame, item: str, words: str, seconds: str) -> None:
        spark = records.sparkSession
        known = F.when((F.col(seconds) > 0) & ~F.isnan(seconds), F.col(seconds).cast("double"))
        base = records.filter(F.col(item).isNotNull() & (F.size(words) > 0)).select(
            F.col(item).cast("bigint").alias("id"), known.alias("seconds"), F.xxhash64(words).alias("h1"), F.hash(F.reverse(words)).alias("h2"), F.col(words).cast("array<bigint>").alias("fingerprint")
        )
        packed = base.mapInArrow(_pack, "id bigint, seconds double, h1 bigint, h2 int, words binary")
        self._reps = Stored(packed.groupBy("h1", "h2", "seconds").agg(F.min("id").alias("rep"), F.first("words").alias("words")))
        reps = self._reps.df
        keys = reps.select("rep", F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("seconds").alias("k3"))
        own = base.select("id", "seconds", "h1", "h2").distinct()
        self.members = own.join(keys, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("seconds").eqNullSafe(F.col("k3"))).select("id", "rep", "seconds")
        tick = F.least(F.floor("seconds"), F.lit(LONGEST)).alias("tick")  # a row a second, whatever the size
        ticks = {r["tick"]: r["n"] for r in reps.groupBy(tick).agg(F.sum(F.length("words") / 4).cast("bigint").alias("n")).collect()}
        cells = Cells({t: n for t, n in ticks.items() if t is not None}, ticks.get(None, 0), partitions(spark))
        dealt = reps.select("rep", "seconds", "words").mapInArrow(_deal(cells), "cell int, side int, rep bigint, seconds double, words binary, u int")
        self.links = dealt.repartitionById(max(1, int(cells.base[-1])), F.col("cell")).mapInArrow(_multiply, "a bigint, b bigint").distinct()


def _library(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    files = table(spark, sf_dir, "files").filter("fingerprint_method = 'spectral'").select("id", "fingerprint", "fingerprint_duration")
    return NearDuplicates(files, "id", "fingerprint", "fingerprint_duration")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: all pairs of files whose spectral fingerprints are small edits of one another."""
    near = _library(spark, sf_dir)
    members = Stored(near.members).df.select("id", "rep")
    a, b = (members.select(F.col("rep").alias(k), F.col("id").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    between = near.links.join(a, "a").join(b, "b").select("x", "y")
    # Stored first, so that adaptive execution can split the copies of a hot class on both sides.
    many = Stored(members.join(members.groupBy("rep").count().filter("count > 1").select("rep"), "rep")).df
    within = many.withColumnRenamed("id", "x").join(many.withColumnRenamed("id", "y"), "rep").filter("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_classes: one row per file with its class of exact copies and the number of classes linked to it."""
    near = _library(spark, sf_dir)
    ends = near.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return near.members.join(ends, "rep", "left").select(F.col("id").alias("file_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p2_found": found, "p2_classes": classes}
ORACLES: dict = {}
