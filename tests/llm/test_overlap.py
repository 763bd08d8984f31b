import numpy as np
import pytest
from reprise.llm import overlap as O

SCHEMA = "id bigint, words array<bigint>, seconds double, rep string, part int"


def near(spark, rows):
    return O.NearDuplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), "id", "words", "seconds")


def pairs(spark, rows):
    n = near(spark, rows)
    rep = {r["id"]: r["rep"] for r in n.members.collect()}
    return rep, sorted((r["a"], r["b"]) for r in n.links.collect())


def brute(rows):
    """All pairs of lists by the definition, every row against every other."""
    out = []
    kept = {}
    for i, w, s in rows:
        if w and sum(x != 0 for x in w) >= 0.1 * len(w):
            kept[i] = (np.array(w, np.uint32), s)
    for a in sorted(kept):
        for b in sorted(kept):
            (x, s), (y, t) = kept[a], kept[b]
            if a < b and not (s and t and abs(s - t) > 10):
                ok = np.bitwise_count(x[:, None] ^ y[None, :]) <= 4
                if min(ok.any(1).mean(), ok.any(0).mean()) >= 0.75 and min(len(x), len(y)) >= 0.75 * max(len(x), len(y)):
                    out.append((a, b))
    return out


def edited(rng, words, flips=20, cut=4, move=True):
    words = list(words)
    for k in rng.choice(len(words), flips, replace=False):
        words[k] ^= 1 << int(rng.integers(32))
    words = words[cut:]
    return words[40:] + words[:40] if move else words


def sample(rng, n=40):
    rows = []
    for k in range(n):
        base = [int(x) for x in rng.integers(1, 1 << 32, 120)]
        rows += [(10 * k, base, 100.0), (10 * k + 1, edited(rng, base), 105.0), (10 * k + 2, edited(rng, base, move=False), None), (10 * k + 3, base, 130.0), (10 * k + 4, base[:60] + [int(x) for x in rng.integers(1, 1 << 32, 60)], 100.0)]
    return rows


def test_against_brute_force(spark):
    rows = sample(np.random.default_rng(5))
    rep, links = pairs(spark, rows)
    assert all(rep[i] == i for i in rep)  # all are different lists or durations
    assert links == brute(rows)


def test_hot_grams_are_multiplied_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [7] + [int(x) for x in rng.integers(1, 1 << 32, 39)], float(i % 50) + 1) for i in range(1400)]
    rows += [(5000 + i, w, s) for i, w, s in rows[:30]] + [(6000, edited(rng, rows[3][1], 3, 1, False), 4.0)]
    assert 1400 > O.HOT
    rep, links = pairs(spark, rows)
    assert all(rep[5000 + i] == i for i in range(30))
    assert links == [(3, 6000)]


def test_lists_without_an_equal_word_are_found(spark):
    """One flipped bit in each of 120 words, and about three in each: no word is shared, halves of neighbours are."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(20):
        base = [int(x) for x in rng.integers(1, 1 << 32, 120)]
        rows += [(10 * k, base, 100.0), (10 * k + 1, [w ^ 1 << int(rng.integers(32)) for w in base], 100.0), (10 * k + 2, [w ^ 1 << (k + 16 * (i % 2)) % 32 for i, w in enumerate(base)], 100.0)]
    rows += [(900, [0xC0FFEE11] * 120, 50.0), (901, [0xC0FFEE10] * 120, 50.0), (902, [0xC0FFEE11] * 95 + [int(x) for x in rng.integers(1, 1 << 32, 25)], 50.0)]  # few different words
    _, links = pairs(spark, rows)
    assert links == brute(rows) and len(links) >= 63


def test_two_flipped_bits_in_every_word(spark):
    """No gram of halves is left out: about 28 of each pair's are equal."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(60):
        base = [int(x) for x in rng.integers(1, 1 << 32, 120)]
        rows += [(10 * k, base, 100.0), (10 * k + 1, [w ^ sum(1 << int(b) for b in rng.choice(32, 2, replace=False)) for w in base], 100.0)]
    _, links = pairs(spark, rows)
    assert links == [(10 * k, 10 * k + 1) for k in range(60)]


def test_all_pairs_of_halves_are_grams():
    words = np.random.default_rng(12).integers(1, 1 << 32, 200, dtype=np.uint64).astype(np.uint32)
    gram, doc, distinct = O.grams(words, np.repeat([0, 1], 100))
    assert distinct.tolist() == [100, 100] and np.bincount(doc).tolist() == [100 + 4 * 99] * 2


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    rows = sample(np.random.default_rng(9), 12)
    want = pairs(spark, rows)
    monkeypatch.setattr(O, "BLOCK", 400)  # many blocks
    assert pairs(spark, rows) == want
    n, s = np.array([63, 63, 62, 60], np.uint8), np.array([11, 21, 31, 0], np.uint16)
    grids = lambda: iter([np.array([[0, 1, 2], [1, 2, 3]]), np.array([[0, 3]])])
    whole = np.sort(np.concatenate(list(O._pairs_of(grids(), n, s))))
    monkeypatch.setattr(O, "SLICE", 2)
    parts = list(O._pairs_of(grids(), n, s))
    assert len(parts) > 1 and np.sort(np.concatenate(parts)).tolist() == whole.tolist()


def test_rough_sizes_and_durations_rule_out_no_pair():
    """Whatever sizes and durations a pair may have, it is not left out before it is compared exactly."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 5000, 2000)
    other = np.ceil(sizes * O.SHARE).astype(int)
    rough = lambda x: np.minimum(255, np.log(x) / np.log(O.RATIO)).astype(np.uint8)
    seconds = rng.random(2000) * 7000
    tenths = lambda x: np.where(np.floor(x * 10) > 65_000, 0, np.floor(x * 10) + 1).astype(np.uint16)
    n, s = np.concatenate([rough(sizes), rough(other)]), np.concatenate([tenths(seconds), tenths(seconds + 10.0)])
    assert O._fits(n, s, np.arange(2000), np.arange(2000, 4000)).all()
    assert not O._fits(n, s, np.arange(2000), np.roll(np.arange(2000), 7)).all()


def test_odd_rows(spark):
    words = [int(x) for x in np.random.default_rng(7).integers(1, 1 << 32, 50)]
    rows = [(1, words, 10.0), (1, words, 10.0), (2, words, 10.0), (3, None, 1.0), (4, [], 1.0), (5, [0] * 99 + [1], 1.0), (None, words, 10.0), (6, [3], None), (7, [3], float("nan")), (8, words * 100, -1.0)]
    rep, links = pairs(spark, rows)
    assert rep == {1: 1, 2: 1, 6: 6, 7: 6, 8: 8} and links == []
    assert pairs(spark, []) == ({}, [])


def test_shuffled_words_are_no_copy():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 32, 100, dtype=np.uint64).astype(np.uint32)
    assert O.covers(x, x) and O.covers(x, np.concatenate([x[60:], x[:60]])) and not O.covers(x, rng.permutation(x)) and not O.covers(x[:70], x)


def test_long_lists_in_bands(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 32, 500, dtype=np.uint64).astype(np.uint32)
    cases = [(x, np.concatenate([x[300:], x[:300]])), (x, rng.permutation(x)), (x[:400], x), (x, np.concatenate([x[:200], x[260:]]))]
    whole = [O.covers(a, b) for a, b in cases]
    monkeypatch.setattr(O, "CELLS", 1500)
    assert [O.covers(a, b) for a, b in cases] == whole == [True, False, True, True]


@pytest.mark.parametrize("folder", ["small"])
def test_library_pairs(spark, request, folder):
    path = request.getfixturevalue(folder)
    files = spark.read.parquet(f"{path}/files.parquet").filter("fingerprint_method = 'spectral'").select("id", "fingerprint", "fingerprint_duration").distinct().collect()
    want = brute([(r["id"], r["fingerprint"], r["fingerprint_duration"]) for r in files])
    got = sorted(map(tuple, O.found(spark, path).collect()))
    assert got == want
    classes = O.classes(spark, path).collect()
    assert len(classes) == len({r["file_id"] for r in classes}) and sum(r["n_links"] for r in classes) > 0


def test_lists_are_dealt_to_cells_so_that_each_pair_meets_once(monkeypatch):
    """What is sent are lists, a few times each, and neither grams nor counts."""
    rng = np.random.default_rng(13)
    seconds = np.where(rng.random(300) < 0.1, np.nan, np.floor(rng.random(300) ** 2 * 900) / 10)
    rep, known = np.arange(300), ~np.isnan(seconds)
    ticks = {int(t): int((np.floor(seconds) == t).sum()) * 100 for t in np.unique(np.floor(seconds[known]))}
    for block, copies in ((100_000, 4), (6_000, 40), (1_000, 400)):
        monkeypatch.setattr(O, "BLOCK", block)
        cells = O.Cells(ticks, int((~known).sum()) * 100, 4)
        row, cell, side = cells.of(rep, seconds)
        assert cell.min() >= 0 and cell.max() < cells.base[-1] and len(row) < copies * 300
        met = {}
        for c in np.unique(cell):
            of = list(zip(row[cell == c], side[cell == c]))
            for k, (a, x) in enumerate(of):
                for b, y in of[:k]:
                    if {x, y} in ({0}, {0, 1}, {1, 2}):
                        met[frozenset((a, b))] = met.get(frozenset((a, b)), 0) + 1
        assert set(met.values()) == {1}
        for a in range(300):
            for b in range(a):
                if not abs(seconds[a] - seconds[b]) > O.SECONDS:
                    assert frozenset((a, b)) in met


def test_turns_and_hot_grams_change_nothing(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(14)
    raw = [(rng.integers(0, 6, 30) << 16 | rng.integers(0, 2000, 30)).astype(np.uint32) for _ in range(60)]
    columns = [pa.array(range(60)), pa.array([k % 3 == 0 for k in range(60)]).cast(pa.int32()), pa.array([None] * 60, pa.float64()), pa.array([w.tobytes() for w in raw], pa.binary()), pa.array([2] * 60, pa.int32())]
    batch = pa.RecordBatch.from_arrays(columns, ["rep", "side", "seconds", "words", "u"])

    def counted():
        lists = O.Lists(iter([batch.slice(0, 25), batch.slice(25)]))
        return sorted((int(x), int(y)) for a, b in O._turns(lists, 0, lists.first) for x, y in zip(a, b))

    want = counted()
    assert want and len(want) == len(set(want))
    for name, value in (("PAIRS", 40), ("SORTED", 50), ("SLICE", 60), ("HOT", 4)):
        monkeypatch.setattr(O, name, value)
        assert counted() == want
