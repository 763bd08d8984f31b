"""The queries without SQL, on the small tables, against every pair by hand."""

import re
import unicodedata
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from reprise import registry
from reprise.functions.similarity import sliding_similarity
from reprise.functions.text import NOISE, WIDE_MARKS


def normal(text):
    bare = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", text or "")).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^\w]", " ", bare)).strip(" ")


def clean(text):
    text = re.sub(r"\s*[\(\[][^\)\]]{0,40}[\)\]]\s*", " ", text or "")
    text = re.sub(r"(?i)\s*(feat\.?|ft\.?|with)\s+.*", "", text)
    return normal(re.sub(rf"(?i)\s*({NOISE})\s*", " ", text))


@cache
def alike(a, b):
    if not a or not b:
        return False
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
    return 1 - line[-1] / max(len(a), len(b)) >= 0.5


@pytest.fixture(scope="module")
def library(small):
    files = pd.read_parquet(f"{small}/files.parquet").drop_duplicates("id")
    return files[~files.deleted.astype(bool)].set_index("id")


@pytest.fixture(scope="module")
def rows_of_query(spark, small):
    return cache(lambda name: registry.QUERIES[name](spark, small).toPandas())


def agrees(files, column, seconds, got):
    """Every pair in one duration band that is similar by 0.9 or more is there, and all that is there is right."""
    lists = {i: np.array(w, np.int64).astype(np.uint32) for i, w in files[column].items() if w is not None and len(w) >= 20}
    bucket = np.floor(files[seconds].where(files[seconds] > 0) / 4 + 0.5)
    seen = {(r.a, r.b): r for r in got.itertuples()}
    wanted = 0
    for a, b in combinations(sorted(lists), 2):
        same, row = sliding_similarity(lists[a], lists[b]), seen.get((a, b))
        if row is None:
            assert same < 0.9 or not abs(bucket[a] - bucket[b]) <= 2
            continue
        x, y = files.loc[a], files.loc[b]
        wanted += same >= 0.9
        assert abs(row.sim - same) < 2e-6 or getattr(row, "exact", False) and row.sim == 1
        assert row.accepted == (same >= 0.97 or same >= 0.9 and (alike(clean(x.title), clean(y.title)) or alike(normal(x.artist), normal(y.artist))) or bool(getattr(row, "exact", False)))
    return wanted


def test_fingerprint_pairs(library, rows_of_query):
    files = library[(library.fingerprint_method != "metadata") & library.fingerprint.map(lambda w: w is not None and len(w) and (np.array(w) != 0).mean() >= 0.1)]
    got = rows_of_query("fingerprint_pairs")
    got = got[got.a.isin(files.index)]
    exact = {(a, b) for a, b in combinations(sorted(files.index), 2) if len(files.fingerprint[a]) == len(files.fingerprint[b]) and (files.fingerprint[a] == files.fingerprint[b]).all()}
    stars = {(r.a, r.b) for r in got.itertuples() if r.exact}
    assert stars <= exact and {b for _, b in stars} == {b for _, b in exact}
    assert agrees(files, "fingerprint", "fingerprint_duration", got) > 20


def test_second_fingerprint_pairs(library, rows_of_query):
    agrees(library, "chromaprint_raw", "duration", rows_of_query("second_fp_pairs"))


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


def test_full_match(spark, small, library, rows_of_query):
    edges = [(r.a, r.b) for n in ("title_pairs", "plausible_pairs") for r in rows_of_query(n).itertuples()] + [(r.a, r.b) for r in rows_of_query("fingerprint_pairs").itertuples() if r.accepted]
    known = set(pd.read_parquet(f"{small}/dup_groups.parquet").group_id)
    members = pd.read_parquet(f"{small}/group_tracks.parquet").dropna().astype("int64")
    for _, own in members[members.group_id.isin(known)].groupby("group_id"):
        ids = sorted(set(own.file_id))
        edges += [(ids[0], x) for x in ids[1:]]
    want = {(x, r) for x, r in roots(edges).items() if x in library.index}
    assert {(r.file_id, r.group_id) for r in rows_of_query("full_match").itertuples()} == want


def test_group_evidence(rows_of_query):
    pairs = rows_of_query("fingerprint_pairs")
    of = roots([(r.a, r.b) for r in pairs.itertuples() if r.accepted])
    want = {}
    for r in pairs.itertuples():
        if of.get(r.a, -1) == of.get(r.b, -2):
            top, exact = want.get(of[r.a], (0.0, False))
            want[of[r.a]] = (max(top, r.sim), exact or r.exact)
    got = {r.group_id: (r.similarity, r.exact, r.accepted) for r in rows_of_query("group_evidence").itertuples()}
    assert got == {g: (min(100, int(np.floor(s * 100 + 0.5))), e, True) for g, (s, e) in want.items()}


def test_library_groups(rows_of_query):
    """The pipeline's groups are those of all lanes with the groups of earlier runs."""
    edges = [(r.a, r.b) for r in rows_of_query("second_fp_pairs").itertuples() if r.accepted] + [(r.group_id, r.file_id) for r in rows_of_query("full_match").itertuples()]
    sizes = pd.Series(roots(edges)).value_counts()
    got = rows_of_query("library_groups").set_index("group_id")
    assert set(got.index) <= set(sizes.index) and (got.n_files <= sizes[got.index]).all() and got.similarity.between(0, 100).all()


def wide(text):
    return re.sub(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), WIDE_MARKS), "", (text or "").lower())


def dice(a, b):
    a, b = wide(a), wide(b)
    if not a or not b:
        return 0.0
    x, y = ({t[k : k + 2] for k in range(max(1, len(t) - 1))} for t in (a, b))
    return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y))


def key(title):
    return re.sub(r"[\(\[]\d{4}[\)\]]\s*$", "", title or "").strip(" ")


def year(date):
    found = re.match(r"\s*(\d{1,9})", date or "")
    return int(found[1]) if found and int(found[1]) else 9999


def test_candidates(small, library, rows_of_query):
    """Search, release choice and scores of all files and records, each against each."""
    records = pd.read_parquet(f"{small}/catalogue.parquet").drop_duplicates("rec_id")
    want = {}
    for r in records.itertuples():
        who, title = normal(", ".join(a["name"] for a in r.artists if a["name"]) if r.artists is not None else ""), normal(r.title)
        length = r.length_ms / 1000 if r.length_ms == r.length_ms and r.length_ms > 0 else r.duration_s if r.duration_s == r.duration_s and r.duration_s > 0 else None
        for f in library.itertuples():
            own = normal(f.artist)
            if not title or title != normal(f.title) or own and who and own not in who and who not in own:
                continue
            releases = list(r.releases) if r.releases is not None else []
            sims = [dice(key(x["title"]), key(f.album)) if f.album else 0.0 for x in releases]
            rates = [0.75 * s + 0.125 for s in sims]
            near = [k for k in range(len(releases)) if not f.album or rates[k] >= max(0.4, 0.9 * max(rates))]
            pool, sim = (near, True) if near else (range(len(releases)), False)
            best = min(pool, key=lambda k: (releases[k]["status"] != "Official", year(releases[k]["date"]), k), default=None)
            album = sims[best] if best is not None and sim and f.album else 0.0
            gap = abs(f.duration - length) if length and f.duration == f.duration and f.duration > 0 else None
            time = 0.0 if gap is None else 1.0 if gap <= 3 else 0.6 if gap <= 8 else 0.2 if gap <= 20 else 0.0
            bonus = 0.15 if best is not None and f.track_number == f.track_number and f.track_number > 0 and releases[best]["track_number"] == f.track_number else 0.0
            score = r.score if r.score == r.score else 0
            want[f.Index, r.rec_id] = round(0.3 * score / 100 + 0.5 * album + 0.2 * time + bonus, 6)
    got = rows_of_query("candidate_rank")
    assert {(r.file_id, r.rec_id): round(r.total, 5) for r in got.itertuples()} == {k: round(v, 5) for k, v in want.items()} and want
    for _, own in got.sort_values("rank").groupby("file_id"):
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and own.total.is_monotonic_decreasing


def test_enrichment(rows_of_query):
    found, candidates = rows_of_query("enrich_offline"), rows_of_query("candidate_rank")
    assert len(found) and found.file_id.is_unique and set(zip(found.file_id, found.rec_id)) <= set(zip(candidates.file_id, candidates.rec_id))
    assert set(found.match_basis) <= {"exact", "fuzzy"}


def test_lookups(rows_of_query):
    got = rows_of_query("lookup_rank")
    assert len(got) and set(got.hit) <= {0.9, 0.75} and got.fields.between(0, 3).all() and ((got.fields == 3) == (got.basis == "exact")).all()
    for _, own in got.sort_values("rank").groupby("file_id"):
        assert list(zip(-own.fields, -own.hit, own.rec_id)) == sorted(zip(-own.fields, -own.hit, own.rec_id))
