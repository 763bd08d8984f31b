import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from reprise.llm import lookalikes as L

PAIRS = [
    ("Тhеаtre Nо. 19", "Theatre No. 19"), ("Ｖａｒｉｏｕｓ Artists", "Various Artists"), ("Shallo​w", "Shallow"), ("No. 38", "No. 38"),
    ("über", "über"), ("CarouseI", "Carousel"), ("lnes Tibyrynd", "Ines Tibyrynd"), ("HEK0ROK0TH", "HEKOROKOTH"), ("0utrun the Theatre", "Outrun the Theatre"), ("⼼鸟梦", "心鸟梦"),
    ("ク夕スモ工ズ", "クタスモエズ"), ("Лочимe", "Лочиме"), ("Donʼt", "Don't"), ("ﬁre", "fire"), ("Wezosɑñd", "Wezosañd"), ("⁠", ""), ("ROKlNONU", "ROKINONU"), ("Count⠀theㅤCellar", "Count the Cellar"),
    ("Ꭺrtist", "Artist"), ("Ⲁrtist", "Artist"), ("ꓮrtist", "Artist"), ("ᗩrtist", "Artist"), ("ᴀʀᴛɪsᴛ", "artist"), ("Ⓐrtist", "Artist"), ("🄰rtist", "Artist"), ("🅰rtist", "Artist"), ("p𐐬wer", "power"), ("ᗩᗷᑕ of sound", "ABC of sound"),
]
SAME = ["Łódź do Vymihyra", "Người ở Vysarinask", "DJ Щанышохо Фери", "Μεφω Τεκαλυ", "木鳥かきち", "クタスモエズ", "don’t – stop…", "İçinde Şarkı", "McIntyre", "Vol. II", "100x", "", "Où va", "東京，夜", "❤️ Song", "Тесла", "Æon Ωmega", "ᐊᒪᐅᔭᖅ", "ᏣᎳᎩ", "E=mc²", "1ª Vez", "Ⲁⲛⲟⲕ"]


@pytest.mark.parametrize("odd, right", PAIRS)
def test_stand_ins_go(odd, right):
    assert L.canonical(odd) == right and L.canonical(right) == right


@pytest.mark.parametrize("text", SAME)
def test_ordinary_texts_stay(text):
    assert L.canonical(text) == text


@given(st.text(max_size=40))
def test_any_text_settles(text):
    once = L.canonical(text)
    assert L.canonical(L.canonical(once)) == L.canonical(once)


@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126), max_size=30))
def test_stable_parts_are_spliced_unchanged(text):
    calm = text.replace("I", "i").replace("l", "L").replace("0", "o").replace("1", "2").replace("|", "/").replace("`", "'")
    assert L.canonical(calm + "​") == L.canonical(calm)
    assert unicodedata.is_normalized("NFC", L.canonical(calm + "́"))


def test_rows(spark):
    rows = [(1, "title", "a​b", 5), (2, "title", "plain", 5), (3, "artist", None, 5), (4, "artist", "", 5), (5, "title", "x" * 100_000 + " ", 5), (1, "title", "a​b", 5)]
    df = spark.createDataFrame(rows, "file_id bigint, field string, text string, form int").drop("form")
    got = L.stand_ins(df).distinct().collect()
    assert sorted((r["file_id"], len(r["form"])) for r in got) == [(1, 2), (5, 100_001)]
    assert L.stand_ins(df.limit(0)).collect() == []


def test_library(spark, small):
    found = L.forms(spark, small).collect()
    assert found and all(r["text"] != r["form"] and L.canonical(r["text"]) == r["form"] for r in found)
    assert {(r["file_id"], r["field"]) for r in found} == {tuple(r) for r in L.found(spark, small).collect()}
