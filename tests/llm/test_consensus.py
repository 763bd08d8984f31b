import pytest
from pyspark.sql import functions as F
from reprise.llm import consensus as C

MEMBERS = "group_id bigint, file_id bigint, bitrate int, meta_score int, album_year int, release_type string, tokens string, g string"


def picked(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], MEMBERS)
    return {r["g"]: r["id"] for r in C.survivors(df, "group_id", "file_id", C.library_fields()).collect()}


def test_the_best_in_every_field_is_closest(spark):
    rows = [(1, 10, 320, 6, 1999, "album"), (1, 11, 192, 6, 0, None), (1, 12, 320000, 5, 1999, "unknown"), (2, 20, 0, None, 3000, "?"), (2, 21, 64, 0, 1950, " Single ")]
    assert picked(spark, rows) == {1: 10, 2: 21}


def test_ties_go_to_the_smaller_id_and_repeats_count_once(spark):
    rows = [(1, 9, 128, 3, 2000, "album"), (1, 3, 128, 3, 2000, "album"), (1, 9, 128, 3, 2000, "album")]
    assert picked(spark, rows) == {1: 3}


def test_nulls_and_empty_tables(spark):
    assert picked(spark, [(None, 1, 1, 1, 1999, "album"), (1, None, 1, 1, 1999, "album"), (1, 5, None, None, None, None)]) == {1: 5}
    assert picked(spark, []) == {}


def test_progressive_alignment_of_texts(spark):
    rows = [(1, 1, "the long road home"), (1, 2, "the long road home"), (1, 3, "long road home"), (1, 4, "the lang road home"), (1, 5, ""), (1, 6, None), (2, 7, "x " * 300)]
    df = spark.createDataFrame(rows, "g bigint, id bigint, title string")
    words = F.filter(F.split(F.coalesce("title", F.lit("")), " "), lambda w: w != "")
    field = C.Field("title", F.when(F.size(words) > 0, 1), words)
    got = {r["g"]: r["tokens"] for r in C.consensus(df, "g", [field]).collect()}
    assert got[1] == ["the", "long", "road", "home"]
    assert {r["g"]: r["id"] for r in C.survivors(df, "g", "id", [field]).collect()} == {1: 1, 2: 7}


def test_votes_of_all_trusts_add_up_and_weights_decide(spark):
    """Seven plain bitrates outvote one of more trust, six do not; votes of complete records outweigh more incomplete ones."""
    of = lambda n: [(1, k, 128, 3, 2000, "album") for k in range(n)] + [(1, 99, 320, 3, 2000, "album")]
    bitrate = lambda rows, fields=None: next(r["tokens"] for r in C.consensus(spark.createDataFrame([(*r, "", "") for r in rows], MEMBERS), "group_id", fields or C.library_fields()).collect() if r["field"] == "bitrate")
    assert bitrate(of(6)) == ["320"] and bitrate(of(7)) == ["128"]
    plain = C.library_fields()[0]
    assert bitrate(of(6), [C.Field("bitrate", plain.trust, plain.tokens, F.lit(1))]) == ["128"]
    years = [(1, 1, 0, 0, 1990, ""), (1, 2, 0, 0, 1990, ""), (1, 3, 0, 6, 1991, "")]
    got = C.consensus(spark.createDataFrame([(*r, "", "") for r in years], MEMBERS), "group_id", C.library_fields()).collect()
    assert next(r["tokens"] for r in got if r["field"] == "album_year") == ["1991"]


def test_weights_choose_the_survivor(spark):
    """Neither member beats the other: the one nearer to the voted values survives, and they depend on the weights."""
    rows = [(1, 1, 320, 1, 0, None)] + [(1, k, 160, 5, 0, None) for k in range(2, 12)]
    assert picked(spark, rows) == {1: 2}
    plain = C.library_fields()
    few = [C.Field(plain[0].name, plain[0].trust, plain[0].tokens, F.when(F.col("bitrate") > 300, 10_000).otherwise(1)), C.Field(plain[1].name, plain[1].trust, plain[1].tokens, F.when(F.col("meta_score") == 1, 10_000).otherwise(1))]
    df = spark.createDataFrame([(*r, "", "") for r in rows], MEMBERS)
    assert {r["g"]: r["id"] for r in C.survivors(df, "group_id", "file_id", few).collect()} == {1: 1}


def test_alignment_adds_up_votes():
    profile = C.align([{"a": 1}, {"b": 1}], [{"b": 2}])
    assert profile == [{"a": 1}, {"b": 3}] and C.elect(profile, 3) == ["b"]


def test_long_texts_align_alike(monkeypatch):
    words = [f"w{k}" for k in range(60)]
    other = words[:20] + ["new"] + words[20:40] + words[45:]
    whole = C.align([{w: 2} for w in words], [{w: 1} for w in other])
    monkeypatch.setattr(C, "CELLS", 1)
    assert C.align([{w: 2} for w in words], [{w: 1} for w in other]) == whole


@pytest.mark.parametrize("name", list(C.ORACLES))
def test_sql(spark, agree, small, name):
    agree(spark, C.QUERIES[name], C.ORACLES[name], small)
