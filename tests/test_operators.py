import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from reprise import registry
from reprise.operators import enrichment as en
from reprise.operators import groups as gr
from reprise.operators import library as lib
from reprise.operators import matching as ma
from reprise.operators import retention as rt
from reprise.operators import storage as sto
from reprise.operators.graph import connected_components
from reprise.plans.config import Config, merged_order

FILE = "id bigint, path string, title string, artist string, album string, genre string, album_year int, track_number int, release_type string, format string, bitrate int, sample_rate int, bits_per_sample int, duration double, size bigint, file_ctime bigint, fingerprint array<bigint>, fingerprint_method string, fingerprint_duration double, chromaprint_raw array<bigint>, deleted boolean"
NAMES = [c.split()[0] for c in FILE.split(", ")]


def files(spark, *rows):
    base = dict.fromkeys(NAMES) | {"deleted": False, "format": "MP3", "bitrate": 128, "size": 100}
    return spark.createDataFrame([tuple((base | {"path": f"/m/{r['id']}.mp3"} | r)[n] for n in NAMES) for r in rows], FILE)


def pairs(df):
    return sorted((r["a"], r["b"]) for r in df.collect())


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
def test_components_of_any_graph(spark, edges):
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == components(edges)


def test_components_of_shapes(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3), (1, 2)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == components(edges)


def test_attribute_lane(spark):
    rows = files(
        spark, {"id": 1, "title": "Song", "artist": "A & B", "duration": 100.0}, {"id": 2, "title": "song!", "artist": "B", "duration": 105.0}, {"id": 3, "title": "Song", "artist": "A", "duration": 105.01}, {"id": 4, "title": "Song", "artist": "A", "duration": None},
        {"id": 5, "title": "Song", "artist": "Zed", "duration": 100.0}, {"id": 6, "title": "", "artist": "A", "duration": 100.0, "path": "/m/02 - A - Song.mp3"}, {"id": 7, "title": None, "artist": None, "path": None},
    )
    assert pairs(ma.attribute_lane(rows)) == [(1, 2), (1, 6)]  # 5.01 s apart is too much for the third
    assert pairs(ma.attribute_lane(rows.limit(0))) == []


def test_bands(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 111.0), (3, 108.0), (4, None), (5, 0.0)], "id bigint, d double")
    assert pairs(ma.band_pairs(df, F.col("d"))) == [(1, 3), (2, 3)]
    rng = random.Random(2)
    values = [(i, round(rng.uniform(1, 60), 1)) for i in range(120)]
    want = [(a, b) for a, x in values for b, y in values if a < b and abs(int(x / 4 + 0.5) - int(y / 4 + 0.5)) <= 2]
    df = spark.createDataFrame(values, "id bigint, d double")
    assert pairs(ma.band_pairs(df, F.col("d"))) == want == pairs(ma.band_pairs(df, F.col("d"), limit=600))


def test_bands_are_streamed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ma, "BLOCK", 7)
    rng = random.Random(4)
    values = [(i, 50.0 if i % 2 else round(rng.uniform(30, 70), 1)) for i in range(100)]
    want = [(a, b) for a, x in values for b, y in values if a < b and abs(int(x / 4 + 0.5) - int(y / 4 + 0.5)) <= 2]
    found = ma.band_pairs(spark.createDataFrame(values, "id bigint, d double"), F.col("d"))
    assert pairs(found) == want  # each once
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # the pairs themselves are not gathered again


def test_hot_bands_make_no_pairs(spark):
    df = spark.createDataFrame([(i, 50.0) for i in range(30)], "id bigint, d double")
    assert pairs(ma.band_pairs(df, F.col("d"), limit=20)) == [] and len(pairs(ma.band_pairs(df, F.col("d")))) == 435


def test_fingerprint_lane(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(32) for _ in range(120)]
    near = [w ^ 1 if k % 2 else w for k, w in enumerate(base)]
    rows = files(
        spark, {"id": 1, "fingerprint": base, "title": "One", "artist": "X", "fingerprint_duration": 100.0, "fingerprint_method": "spectral"}, {"id": 2, "fingerprint": base, "title": "Other", "artist": "Y", "fingerprint_duration": 300.0, "fingerprint_method": "spectral"},
        {"id": 3, "fingerprint": near[2:], "title": "One", "artist": "X", "fingerprint_duration": 101.0, "fingerprint_method": "spectral"}, {"id": 4, "fingerprint": [0] * 119 + [1], "fingerprint_duration": 100.0, "fingerprint_method": "spectral"}, {"id": 5},
    )
    got = {(r["a"], r["b"]): (r["sim"], r["accepted"], r["exact"]) for r in ma.fingerprint_lane(rows).collect()}
    assert got[1, 2] == (1.0, True, True) and got[1, 3][1] and 0.97 < got[1, 3][0] < 1 and all(4 not in p for p in got)
    members = gr.build(rows, ma.fingerprint_lane(rows).filter("accepted"))
    assert sorted(map(tuple, members.collect())) == [(1, 1), (1, 2), (1, 3)]
    found = gr.evidence(members, ma.fingerprint_lane(rows), ["exact"]).first()
    assert found["max_sim"] == 1.0 and found["exact"]


def test_lanes_compare_hot_durations(spark):
    rng = random.Random(5)
    base = [[rng.getrandbits(32) for _ in range(22)] for _ in range(602)]
    base[601] = [w ^ (k % 2) for k, w in enumerate(base[0])]  # no three words in a row in common
    rows = files(spark, *({"id": i, "fingerprint": x, "fingerprint_method": "spectral", "fingerprint_duration": 100.0, "chromaprint_raw": x, "duration": 100.0} for i, x in enumerate(base)))
    for lane in (ma.fingerprint_lane, ma.second_lane):
        found = lane(rows).select("a", "b", "accepted").toPandas()
        assert len(found) < 602 and found[found.accepted][["a", "b"]].values.tolist() == [[0, 601]]


def test_edit_similarity_of_all_titles(spark, tmp_path):
    titles = [("Läd", "Lad"), ("中文歌", "中文"), ("abc", "abd"), ("é", ""), ("日本", "日本"), ("x", None)]
    files(spark, *({"id": i, "title": a} for i, (a, _) in enumerate(titles))).write.parquet(str(tmp_path / "files.parquet"))
    said = [(i, "acoustid", b, 1) for i, (_, b) in enumerate(titles)]
    spark.createDataFrame(said, "file_id bigint, source string, title string, scraped_at bigint").write.parquet(str(tmp_path / "scraped_meta.parquet"))
    got = {r["file_id"]: r["sim"] for r in registry.QUERIES["edit_similarity"](spark, str(tmp_path)).collect()}

    def edits(a, b):
        return max(len(a), len(b)) if not a or not b else min(edits(a[1:], b) + 1, edits(a, b[1:]) + 1, edits(a[1:], b[1:]) + (a[0] != b[0]))

    assert got == {i: None if b is None else round(1 - edits(a, b) / max(len(a), len(b)), 6) for i, (a, b) in enumerate(titles)}


def test_enrichment_lane(spark):
    rows = files(spark, {"id": 1, "title": "One"}, {"id": 2, "title": "One"}, {"id": 3, "title": "Else"}, {"id": 4, "title": "One"})
    said = spark.createDataFrame([(1, "musicbrainz", "r", "exact"), (2, "acoustid", "r", "fuzzy"), (3, "musicbrainz", "r", "exact"), (4, "musicbrainz", "", "exact")], "file_id bigint, source string, mb_recording_id string, match_basis string")
    got = [tuple(r) for r in ma.enrichment_lane(rows, said).collect()]
    assert got == [(1, 2, False, True)]
    assert ma.enrichment_lane(rows, said, Config(exact_only=True)).collect() == []


def members(spark, *rows):
    return spark.createDataFrame(rows, "group_id bigint, file_id bigint")


def test_group_description(spark):
    rows = files(spark, {"id": 1, "title": "A", "artist": "B", "format": "MP3", "album_year": 1990, "duration": 10.4, "path": "/x/S.mp3"}, {"id": 2, "title": "a", "artist": "b", "format": "FLAC", "album_year": 1991, "duration": 10.0, "path": "/y/s.flac"}, {"id": 3})
    m = members(spark, (1, 1), (1, 2), (2, 3))
    desc = gr.described(m, rows)
    assert {r["group_id"]: r["type"] for r in gr.types(desc).collect()} == {1: "format_diff", 2: "name_diff"}
    got = {r["group_id"]: set(r["group_tags"]) for r in gr.tags(desc).collect()}
    assert got == {1: {"format_diff", "filename_same", "metadata_same", "release_year_diff", "duration_same"}, 2: set()}
    found = spark.createDataFrame([(1, True, 0.99)], "group_id bigint, meta_confirmed boolean, max_cp_sim double")
    assert {"meta_confirmed", "cp_exact"} <= {r["group_id"]: set(r["group_tags"]) for r in gr.tags(desc, found).collect()}[1]


def test_tags(spark):
    g = spark.createDataFrame([(1, ["cp_exact", "format_same"]), (2, ["format_same"]), (3, None), (4, ["cp_exact", "meta_confirmed"])], "group_id bigint, group_tags array<string>")
    assert sorted(r["group_id"] for r in gr.strip_lane(g, ["cp_exact"]).collect()) == [4]
    assert sorted(r["group_id"] for r in gr.clear_lane(g, ["cp_exact"]).collect()) == [2, 3]
    assert [r["v"] for r in g.orderBy("group_id").select(gr.with_fp_diff(F.col("group_tags")).alias("v")).collect()] == [["cp_exact", "format_same"], ["format_same", "fp_diff"], None, ["cp_exact", "meta_confirmed"]]
    assert gr.toggle_tag(["format_same", "x"], "format_diff") == ["x", "format_diff"] and gr.toggle_tag(["x"], "x") == []
    assert gr.having_all(g, []).count() == 4
    old = spark.createDataFrame([(9, 1, ["cp_exact", "format_same"]), (9, 2, ["cp_exact", "format_same"])], "group_id bigint, file_id bigint, group_tags array<string>")
    new = spark.createDataFrame([(1, 1, ["x"]), (1, 2, ["x"]), (5, 1, ["y"])], "group_id bigint, file_id bigint, group_tags array<string>")
    assert {r["group_id"]: r["group_tags"] for r in gr.carry_over(new, old).collect()} == {1: ["x", "cp_exact"], 5: ["y"]}


ENRICH = "file_id bigint, source string, mb_recording_id string, title string, artist string, album string, album_year int, track_number int, genre string, duration double, match_basis string, scraped_at bigint"


def retained(spark, rows, said=(), order=None, overrides=None):
    said = spark.createDataFrame([tuple((dict.fromkeys([c.split()[0] for c in ENRICH.split(", ")]) | {"scraped_at": 1} | s)[c.split()[0]] for c in ENRICH.split(", ")) for s in said], ENRICH)
    m = members(spark, *[(1, r["id"]) for r in rows])
    config = Config(retention_order=order) if order else Config()
    over = spark.createDataFrame(overrides, "file_id bigint, keep boolean") if overrides else None
    out = rt.winners(rt.annotated(m, rt.enriched(files(spark, *rows), said), config), over, config)
    return {r["file_id"]: (r["keep"], r["reason"]) for r in out.collect()}


def test_cascade(spark):
    best = {"format": "FLAC", "bitrate": 900}
    assert retained(spark, [{"id": 1, **best}, {"id": 2}]) == {1: (True, "quality_best: FLAC 900k"), 2: (False, None)}
    assert retained(spark, [{"id": 1}, {"id": 2}]) == {1: (True, "tie"), 2: (True, "tie")}
    assert retained(spark, [{"id": 1}]) == {1: (True, "only_version")}
    # A member to which the winning tier does not apply survives it.
    got = retained(spark, [{"id": 1, "file_ctime": 10}, {"id": 2, "file_ctime": 20}, {"id": 3}], order=("ctime_best",))
    assert {i for i, (k, _) in got.items() if k} == {2, 3}
    # A tier in which all tie changes nothing.
    got = retained(spark, [{"id": 1, "file_ctime": 10, "album_year": 1990}, {"id": 2, "file_ctime": 10, "album_year": 1980}], order=("ctime_best", "release_best"))
    assert got[2] == (True, "release_best: 1980") and not got[1][0]


def test_enrichment_gate_and_durations(spark):
    rows = [{"id": 1, "title": "T", "duration": 103.0}, {"id": 2, "title": "U", "duration": 103.01}]
    said = [{"file_id": 1, "source": "musicbrainz", "title": "T", "match_basis": "exact", "duration": 100.0, "mb_recording_id": "x"}, {"file_id": 2, "source": "musicbrainz", "title": "T", "match_basis": "exact", "mb_recording_id": "y"}]
    got = retained(spark, rows, said, order=("scrape_best",))
    assert all(k for k, _ in got.values())  # two recordings: the gate is shut
    said[1]["mb_recording_id"] = "x"
    assert retained(spark, rows, said, order=("scrape_best",))[1] == (True, "scrape_best: 1/6")
    m = members(spark, (1, 1), (1, 2))
    notes = rt.annotated(m, rt.enriched(files(spark, *rows), spark.createDataFrame([(1, "musicbrainz", "x", "T", None, None, None, None, None, 100.0, "exact", 1)], ENRICH)))
    assert {r["file_id"]: r["accurate"] for r in notes.collect()} == {1: True, 2: False}
    assert {r["file_id"]: r["pick_tags"] for r in rt.dimension_tags(notes).collect()}[1] == ["scrape_best", "duration_accurate"]


def test_overrides(spark):
    rows = [{"id": 1, "bitrate": 320}, {"id": 2}, {"id": 3}]
    got = retained(spark, rows, overrides=[(1, False), (2, True)])
    assert got == {1: (False, None), 2: (True, "manual_keep"), 3: (False, None)}
    assert merged_order(["meta_best"])[0] == "meta_best" and len(merged_order(None)) == 7 and merged_order(None) == Config().retention_order


RELEASE = "array<struct<id:string,title:string,status:string,date:string,track_number:int>>"


@pytest.mark.parametrize(
    "album, releases, want",
    [
        (None, [("a", "X", "Bootleg", "1980", 1), ("b", "Y", "Official", "1990", 1), ("c", "Y", "Official", None, 1)], "b"), ("Night Out", [("a", "Night Out (2010)", "Official", "2010", 1), ("b", "Night Out", "Official", "1999", 1), ("c", "Best of", "Official", "1970", 1)], "b"),
        ("Zzz", [("a", "Abc", "Official", "2010", 1), ("b", "Def", "Official", "2001", 1)], "b"), ("X", [], None), (None, None, None),
    ],
)
def test_pick_release(spark, album, releases, want):
    df = spark.createDataFrame([(album, releases)], f"album string, releases {RELEASE}")
    assert df.select(en.pick_release(F.col("releases"), F.col("album"))["release"]["id"].alias("v")).first()["v"] == want


def decided(spark, scores, **own):
    cols = "file_id bigint, rec_id string, score int, total double, album_sim double, dur_score double, rank int, has_album boolean, has_duration boolean, basis string"
    rows = [(1, f"r{k}", s, t, a, d, k + 1, own.get("album", False), own.get("duration", False), "x") for k, (s, t, a, d) in enumerate(scores)]
    return [(r["rec_id"], r["match_basis"]) for r in en.decide(spark.createDataFrame(rows, cols)).collect()]


def test_decide(spark):
    assert decided(spark, [(95, 0.9, 0.7, None), (80, 0.1, 0.0, None)], album=True) == [("r0", "exact")]
    assert decided(spark, [(95, 0.5, 0.0, None), (81, 0.4, 0.0, None)], album=True) == []
    assert decided(spark, [(95, 0.6, 0.5, None), (81, 0.4, 0.0, None)], album=True) == [("r0", "exact")]
    assert decided(spark, [(95, 0.6, 0.0, 1.0), (81, 0.4, 0.0, None)], duration=True) == [("r0", "fuzzy")]
    assert decided(spark, [(70, 0.2, 0.0, None)]) == [("r0", "fuzzy")] and decided(spark, [(69, 0.2, 0.0, None)]) == []


def test_hot_titles_are_searched_by_the_same_rule(spark, monkeypatch):
    monkeypatch.setattr(en, "COMMON", 2)
    cat = spark.createDataFrame([(f"r{k}", "Intro", 100 - k, [(a,)] if a else []) for k, a in enumerate(("Anna", "Bob", "", "Carl", "Dora"))], "rec_id string, title string, score int, artists array<struct<name:string>>")
    own = files(spark, {"id": 1, "title": "Intro"}, {"id": 2, "title": "Intro", "artist": "Anna feat. Carl"}, {"id": 3, "title": "intro", "artist": "Bob"})
    got = {}
    for r in en.search(own, cat).collect():
        got.setdefault(r["id"], set()).add(r["rec_id"])
    assert got == {1: {"r0", "r1", "r2", "r3", "r4"}, 2: {"r0", "r2", "r3"}, 3: {"r1", "r2"}}


def test_enrich_end_to_end(spark):
    own = files(spark, {"id": 1, "title": "Song One", "artist": "Band", "album": "Blue", "duration": 100.0, "track_number": 2}, {"id": 2, "title": None})
    cat = spark.createDataFrame([("r1", "song one!", 95, 100_400, None, [("Band",)], [("Rock", 1), ("Pop", 9)], [("a", "Blue", "Official", "2001-05", 2), ("b", "Blue", "Official", "1999", 2)]), ("r2", "Song One", 60, 300_000, None, [("Other",)], [], [])], f"rec_id string, title string, score int, length_ms bigint, duration_s double, artists array<struct<name:string>>, genres array<struct<name:string,count:int>>, releases {RELEASE}")
    got = en.enrich(own, cat).collect()
    assert [(r["file_id"], r["rec_id"], r["release_id"], r["album_year"], r["genre"], r["duration"], r["match_basis"]) for r in got] == [(1, "r1", "b", 1999, "Pop", 100, "exact")]


def test_lookup_errors(spark):
    df = spark.createDataFrame([(429, None, None, 0), (200, 4, "x", 0), (200, 3, "Invalid API key", 0), (200, 7, "x", 0), (None, None, None, 0), (503, None, None, 0), (200, None, None, 0), (200, None, None, 3)], "status int, code int, message string, n int")
    got = [r["v"] for r in df.select(en.lookup_error(F.col("code"), F.col("message"), F.col("status"), F.col("n")).alias("v")).collect()]
    assert got == ["rate-limited", "invalid-key", "invalid-key", "api-error-7", "network-error", "http-503", "no-results", None]


def test_listing(spark):
    rows = files(spark, {"id": 1, "title": "b", "album_year": 2000}, {"id": 2, "title": "A", "album_year": None}, {"id": 3, "title": None, "album_year": 1990}, {"id": 4, "title": "a", "deleted": True})
    order = lambda *a, **k: [r["id"] for r in lib.query(rows, order=lib.order_by(*a, **k)).collect()]
    assert order("album_year") == [3, 1, 2] and order("album_year", True) == [1, 3, 2]
    assert order("title") == [2, 1, 3] and order("title", fold=True) == [2, 1, 3]
    with pytest.raises(ValueError):
        lib.order_by("path")
    assert [r["id"] for r in lib.page(lib.live(rows), lib.order_by("title"), 2, 2).collect()] == [3]
    for f, want in ((1, 1), (2, 0), (3, 2), (4, -1)):
        got = lib.position(rows, f, "title").first()
        assert got["position"] == (want if f != 4 else -1)
    assert [r["id"] for r in lib.search(rows, "É!b", ("title",)).collect()] == [] and lib.search(rows, "!!").count() == 4


def test_theta_and_first_groups(spark):
    m = members(spark, (1, 10), (1, 11), (2, 10))
    g = spark.createDataFrame([(1, 10, True), (2, None, False)], "group_id bigint, smart_keep_id bigint, resolved boolean")
    assert [(r["group_id"], r["file_id"]) for r in lib.spare_members(m, g).collect()] == [(1, 11)]
    ids = spark.createDataFrame([(10,), (11,), (12,)], "id bigint")
    assert sorted(map(tuple, lib.first_groups(ids, m, g).collect())) == [(10, 2), (11, 1), (12, None)]


def test_storage(spark, tmp_path):
    store = sto.Versions(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    assert store.copy_from(one) == 1
    with pytest.raises(FileExistsError):
        store.copy_from(one)
    assert store.write(sto.merge_snapshot(store.read(), spark.createDataFrame([(2, "c"), (3, "d")], "id bigint, v string"), ["id"])) == 2
    assert sorted(map(tuple, store.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    store.prune(1)
    assert store.numbers() == [2]
    up = sto.upsert(one.withColumn("deleted", F.lit(True)), spark.createDataFrame([(2, None), (9, "z")], "id bigint, v string"), "id", deleted=False)
    assert sorted(map(tuple, up.collect())) == [(1, "a", True), (2, "b", False), (9, "z", False)]


def test_writes_and_reverts(spark):
    own = spark.createDataFrame([(1, "a", 1990), (2, "b", 0)], "id bigint, title string, album_year int")
    edits = lambda *rows: spark.createDataFrame(rows, "file_id bigint, title string, album_year int")
    none = spark.createDataFrame([], sto.HISTORY)
    files1, history1 = sto.write_fields(own, none, edits((1, "", 2000), (2, "b", 0)), ["title", "album_year"], 1000)
    assert sorted(map(tuple, files1.collect())) == [(1, "a", 2000), (2, "b", 0)]
    files2, history2 = sto.write_fields(files1, history1, edits((1, "c", 2001)), ["title", "album_year"], 2000)
    row = history2.collect()
    assert len(row) == 1 and row[0]["write_count"] == 2 and row[0]["modified_fields"] == ["album_year", "title"] and row[0]["original_tags"] == {"title": "a", "album_year": "1990"} and row[0]["first_written_at"] == 1000
    back, left = sto.revert(files2, history2, spark.createDataFrame([(1,)], "file_id bigint"), ["title", "album_year"])
    assert sorted(map(tuple, back.collect())) == [(1, "a", 1990), (2, "b", 0)] and left.count() == 0
    assert sto.purge_expired(history2, 2000 + 31 * 86_400_000).count() == 0


def test_trash_and_cascade(spark):
    own = spark.createDataFrame([(1, "/a", True), (2, "/b", False), (3, "/c", True), (4, "/d", False)], "id bigint, path string, deleted boolean")
    m = members(spark, (1, 1), (1, 2), (2, 3), (2, 4), (3, 3), (3, 2))
    g = spark.createDataFrame([(1, 2), (2, 4), (3, 2)], "group_id bigint, smart_keep_id bigint")
    done = spark.createDataFrame([(1,), (2,)], "group_id bigint")
    f, mm, gg = sto.purge_trash(own, m, g, done)
    assert sorted(r["id"] for r in f.collect()) == [2, 3, 4] and sorted(map(tuple, mm.collect())) == [(3, 2), (3, 3)] and [r["group_id"] for r in gg.collect()] == [3]
    out = sto.cascade_delete({"files": own, "group_tracks": m, "dup_groups": g}, spark.createDataFrame([("/d",)], "path string"))
    assert sorted(r["id"] for r in out["files"].collect()) == [1, 3, 4] and sorted(r["smart_keep_id"] or 0 for r in out["dup_groups"].collect()) == [0, 0, 4]


def test_config():
    c = Config(threshold=0.95, retention_order=("meta_best",))
    assert Config.from_json(c.to_json()) == c and Config.from_json("") == Config() and Config.from_json('{"unknown": 1}') == Config()


def test_a_hot_vertex_is_split(spark, split_plans):
    """Half of all edges at one vertex: adaptive execution splits their join."""
    hot = spark.range(1, 40_000).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    edges = hot.unionByName(spark.range(40_000, 120_000, 2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert split_plans(lambda: connected_components(edges).count()) > 0


def test_misses_are_counted_by_reason(spark):
    rows = [(None, None, 200, 3), (None, None, 200, 0), (None, None, 429, None), (None, None, 503, None), (None, None, None, None), (4, "x", 200, None), (7, "odd", 200, None), (None, None, 200, 0)]
    got = {r["reason"]: (r["n"], r["settled"], r["transient"]) for r in en.miss_histogram(spark.createDataFrame(rows, "code int, message string, status int, n_results int")).collect()}
    assert got == {"no-results": (2, True, False), "rate-limited": (1, False, True), "http-503": (1, False, True), "network-error": (1, False, True), "invalid-key": (1, False, False), "api-error-7": (1, False, False)}


def test_only_whole_tables_are_taken_over(spark, tmp_path):
    store, source = sto.Versions(spark, str(tmp_path / "store")), str(tmp_path / "old")
    spark.range(5).coalesce(1).write.parquet(source)
    assert store.copy_from(store.probe(source)) == 1 and store.read().count() == 5
    with pytest.raises(FileExistsError):
        store.copy_from(store.probe(source))
    (tmp_path / "old" / "part-x.parquet").write_bytes(b"PAR1 torn")
    for bad in (source, str(tmp_path)):
        with pytest.raises(ValueError):
            store.probe(bad)


def test_fingerprints_of_tags_meet_only_their_kind(spark):
    """M6, M7: tags with tags (equal whole durations, or with compat off like titles), never with words."""
    words = [0xC0FFEE11] * 40  # the same word throughout
    rows = files(
        spark, {"id": 1, "title": "Blue Moon Song", "artist": "A", "fingerprint_method": "metadata", "fingerprint_duration": 200.2}, {"id": 2, "title": "Blue Moon Song", "artist": "A", "fingerprint_method": "metadata", "fingerprint_duration": 199.9},
        {"id": 3, "title": "Blue Moon Sung", "artist": "A", "fingerprint_method": "metadata", "fingerprint_duration": 206.0}, {"id": 4, "title": "Blue Moon Song", "artist": "A", "fingerprint": words, "fingerprint_method": "spectral", "fingerprint_duration": 200.0},
        {"id": 5, "title": "Other", "artist": "B", "fingerprint": [w ^ 1 for w in words], "fingerprint_method": "spectral", "fingerprint_duration": 200.0}, {"id": 6, "title": "Unlike anything", "artist": "Zz", "fingerprint_method": "metadata", "fingerprint_duration": 200.0}, {"id": 7, "fingerprint_method": "metadata"}, {"id": 8},
    )
    got = lambda c: {(r["a"], r["b"]): (round(r["sim"], 2), r["accepted"]) for r in ma.fingerprint_lane(rows, c).collect()}
    assert got(Config()) == {(1, 2): (1.0, True), (4, 5): (0.97, False), (1, 6): (0.96, False), (2, 6): (0.96, False)}
    assert got(Config(compat=False)) == {(1, 2): (1.0, True), (1, 3): (0.93, True), (2, 3): (0.93, True), (4, 5): (0.97, False)}
