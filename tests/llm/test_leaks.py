import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from reprise.llm import leaks as K


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=20), min_size=1, max_size=6), st.lists(st.integers(1, 4), min_size=1, max_size=3))
def test_index_finds_every_occurrence(docs, phrase):
    index = K.FMIndex([np.array(d, np.int64) for d in docs], 5)
    which, at = index.find(np.array([phrase, [5] * len(phrase)]))
    want = [(d, p) for d, doc in enumerate(docs) for p in range(len(doc) - len(phrase) + 1) if doc[p : p + len(phrase)] == phrase]
    doc = np.searchsorted(index.starts, at, side="right") - 1
    assert sorted(zip(doc.tolist(), (at - index.starts[doc]).tolist())) == want and not which.any()


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (50, 2), (200, 3)):
        text = rng.integers(0, k, n)
        assert K.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def passage(rng, n=60):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    return sorted((r["doc_id"], r["item_id"], r["kept"]) for r in K.leaked(d, i).collect())


def test_changes_and_forms(spark):
    rng = random.Random(2)
    p = passage(rng)
    fill = " ".join(passage(rng, 30))
    t = " ".join
    swapped = [*p[:12], "other", *p[13:25], *p[26:40], "more", *p[40:52]]
    often = [w if k % 8 else "x" for k, w in enumerate(p)]
    docs = [
        (1, f"{fill} {t(p[:20])} {fill}"), (2, f"{fill} {t(p[:19])} {fill}"), (3, t(swapped)), (4, t(often)), (5, t(p[20:45]).upper().replace(" ", ",\n")),
        (6, "<p><b>" + "</b> <i>x</i>".join([t(p[:15]), ""]).replace("<i>x</i>", "") + t(p[15:30]) + "</p>"), (7, t(p[:5]) + " new " + t(p[5:20])), (8, t(reversed(p))), (9, None), (10, ""), (11, t(p[:10]) + " " + fill + " " + t(p[30:40])), (12, (fill + " ") * 400 + t(p)),
    ]
    got = leaks(spark, docs, [(1, t(p)), (1, t(p)), (2, "short one"), (3, None), (4, "")])
    assert got == [(1, 1, 20), (3, 1, 50), (5, 1, 25), (6, 1, 30), (7, 1, 20), (12, 1, 60)]


def test_empty_tables(spark):
    assert leaks(spark, [], [(1, " ".join(passage(random.Random(1))))]) == []
    assert leaks(spark, [(1, "a b c")], []) == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(passage(rng, 40))) for k in range(6)]
    docs = [(k, t) for k, t in items]
    whole = leaks(spark, docs, items)
    monkeypatch.setattr(K, "ITEM_WORDS", 60)
    assert leaks(spark, docs, items) == whole == [(k, k, 40) for k in range(6)]


def test_corpus_against_brute_force(spark, small):
    docs = {r["doc_id"]: K.words(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    items = {r["item_id"]: K.words(r["passage"]) for r in spark.read.parquet(f"{small}/eval_items.parquet").collect()}
    at = {}
    for i, p in items.items():
        for k in range(len(p) - 9):
            at.setdefault(tuple(p[k : k + 10]), []).append((i, k))
    want = {(d, i) for d, w in docs.items() for k in range(len(w) - 9) for i, j in at.get(tuple(w[k : k + 10]), ()) if K.stretch(np.array(w), k, np.array(items[i]), j)[0] >= 20}
    assert {tuple(r) for r in K.found(spark, small).collect()} == want
    assert all(r["first_word"] <= r["last_word"] for r in K.spans(spark, small).collect())
