import random

import pytest
from reprise.llm import encodings as E

WORDS = "Ein schöner Morgen|Où va la rivière|Canción para Lucía|Łódź nocą|Größe und Länge|Señor Muñoz|Déjà vu|Mañana en Málaga|Café Müller|Último día".split("|")
SCRIPTS = ["Лорюту Щапо", "Соме Нувезе", "Царя Щаме", "Μεφω Τεκαλυ", "Φωμεκα Ζογε", "木鳥かきち", "星夜いやし", "クタスモエズ"]
SCHEMA = "id bigint, path string, title string, artist string, album string, source string, text int"


def library(spark, extra):
    rng = random.Random(4)
    rows = [(i, f"/srv/{'ab'[i % 2]}/x", rng.choice(WORDS) + f" {i}", rng.choice(SCRIPTS + WORDS), rng.choice(["Live", None, "", "Plain title"]), "s", 1) for i in range(400)]
    rows += [(1000 + i, "/srv/a/x", t, None, "", "s", 1) for i, t in enumerate(extra)]
    return spark.createDataFrame(rows, SCHEMA)


def spoiled(text, written="utf-8", read="cp1252"):
    return text.encode(written).decode(read, "replace") if read != "cp1252" else "".join(E._read_as("cp1252")[1][b] for b in text.encode(written))


def test_garbled_texts_are_found_and_restored(spark):
    right = [f"{w} {i} nuit" for i, w in enumerate(WORDS)]
    bad = [spoiled(t) for t in right] + [spoiled("Соме Нувезе"), "Соме Нувезе".encode("koi8-r").decode("cp1251"), spoiled(spoiled("Déjà vu là")), "Bridge� of"]
    files = library(spark, bad)
    model = E.Model.fit(files)
    got = {r["text"]: r["repaired"] for r in model.flag(E.texts(files)).collect()}
    assert set(bad) <= set(got)
    assert sum(got[spoiled(t)] == t for t in right) >= 0.9 * len(right)
    assert got[bad[-1]] is None and got[bad[-3]] == "Соме Нувезе" and got[bad[-2]] == "Déjà vu là"
    assert len(set(got) - set(bad)) <= 2


def test_lost_bytes_are_weighed_like_any_evidence(spark):
    """Replacement characters make no rule of their own: their chain has a posterior, and a text that can be restored is."""
    files = library(spark, ["Bridge� of", "Gl�ck auf", "Gud├╢nam", "Straße ─ Nacht"])
    model = E.Model.fit(files)
    ways = {c: (t, p) for c, t, p in model.weigh("/srv/a", "title", "Bridge� of")}
    assert ways[E.LOST][0] is None and 0.5 < ways[E.LOST][1] < 1 and abs(sum(p for _, p in ways.values()) - 1) < 1e-9
    assert model.repair("/srv/a", "title", "Bridge� of")[:2] == (True, None)
    assert model.repair("/srv/a", "title", "Gud├╢nam")[:2] == (True, "Gudönam")
    sure = E.Model(model.kinds, model.chars, {("s", "title"): {"": 1e9}})
    assert sure.weigh("s", "title", "Bridge� of")[0][2] < 1


def test_fitted_once_a_session_if_wanted(spark):
    files = library(spark, ["x"])
    model = E.Model.fit(files)
    assert E.Model.fit(files.drop("text"), reuse=True) is model and E.Model.fit(files) is not model


def test_odd_inputs(spark):
    files = library(spark, ["\x85", "é" * 5000, "naïve", "Âme", "£9"])
    model = E.Model.fit(files)
    assert not {r["text"] for r in model.flag(E.texts(files)).collect()} & {"é" * 5000, "naïve", "£9"}
    empty = files.limit(0)
    assert E.Model.fit(empty).flag(E.texts(empty)).collect() == []
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None)], SCHEMA)
    assert E.Model.fit(nulls).flag(E.texts(nulls)).collect() == []


@pytest.mark.parametrize("name", E.SINGLE)
def test_one_byte_encodings_round_trip(name):
    of, chars = E._read_as(name)
    assert len(chars) == 256 and all(chars[of[c]] == c for c in chars)


def test_library(spark, small):
    found = {tuple(r) for r in E.found(spark, small).collect()}
    repaired = E.repaired(spark, small).collect()
    assert found and found == {(r["file_id"], r["field"]) for r in repaired}
