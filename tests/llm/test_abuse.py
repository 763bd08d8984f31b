import random

import numpy as np
from reprise.llm import abuse as A

CALM = "the bass is warm|side two loses some steam|the scan found many copies|keep the flac and bin the other|the sleeve notes are printed in ink|damn this scanner drives me mad|the strings come from an ensemble|thanks that fixed it".split("|")
RUDE = "you are a worthless piece of shit|shut your stupid mouth you idiot|people like you should be whipped|go drown yourself you pathetic moron".split("|")


def corpus(n, rng, noise=0.05):
    out = []
    for _ in range(n):
        rude = rng.random() < 0.25
        parts = rng.choices(CALM, k=rng.randint(2, 6))
        if rude:
            parts.insert(rng.randrange(len(parts)), rng.choice(RUDE))
        out.append((". ".join(parts) + f" number {rng.randrange(999)}", float(rude != (rng.random() < noise)), rude))
    return out


def test_learns_from_noisy_ratings():
    rng = random.Random(1)
    net = A.train([(t, y) for t, y, _ in corpus(700, rng)])
    held = corpus(300, rng)
    scores = np.array([s.max() for s in net.score([A.words(t) for t, _, _ in held])])
    right = (scores >= net.threshold) == np.array([r for _, _, r in held])
    assert right.mean() > 0.95
    masked = [f"{CALM[0]} you are a w0rthless piece of sh1t {CALM[2]}", f"{CALM[3]} shut your stuuuupid mouth you id1ot {CALM[1]}"]
    assert all(s.max() >= net.threshold for s in net.score([A.words(t) for t in masked]))


def test_words_are_read_whole():
    assert A.words("Orchestraの新しい2004年") == ["orchestra", "の新", "新し", "しい", "い", "2004", "年"]
    assert A.words("sh!t f**k a!") == ["sh!t", "f**k", "a"]
    word = "".join(chr(97 + k * 7 % 26) + chr(97 + k * k % 26) for k in range(60))
    marked = f"^{word}$"
    assert set(A.grams(word)) == {A.zlib.crc32(marked[k : k + 3].encode()) % A.GRAMS for k in range(len(word))}


def test_gradients():
    rng = np.random.default_rng(0)
    net = A.Network({"aa": 1, "bb": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocab = A.Lexicon.of(["aa", "bb", "cc"], net.vocabulary)
    rows, mask = rng.integers(0, 3, (5, 4)), np.ones((5, 4), np.float32)
    mask[3:, 1] = 0
    wanted, weight, own = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 0.5]), np.ones(3, bool)
    loss = lambda: float((weight * np.logaddexp(0, np.where(wanted > 0, -1, 1) * net.forward(net.vectors(vocab, own), rows, mask))).sum() / weight.sum())
    found = net.gradients(vocab, rows, mask, wanted, weight, own)
    for name in ("fW", "fU", "bU", "bW", "fc", "A", "v", "o", "ob", "word", "gram"):
        flat, grad = net.p[name].reshape(-1), np.asarray(found[name]).reshape(-1)
        k = int(np.argmax(np.abs(grad)))
        old = flat[k]
        flat[k] = old + 1e-5
        up = loss()
        flat[k] = old - 1e-5
        down = loss()
        flat[k] = old
        assert abs((up - down) / 2e-5 - grad[k]) < 2e-3 * max(1, abs(grad[k])), name


def test_windows_cover_all_words():
    for n in range(0, 90):
        seen = {k for a, b in A.windows(n) for k in range(a, b)}
        assert seen == set(range(n))


def test_words():
    assert A.words(None) == A.words("") == A.words(" ...") == []
    assert A.plain(A.words("m0r0n")[0]) == "moron" and A.words("s c h l a m p e") == ["schlampe"]
    assert A.words("mоrоn") == ["moron"] and len(A.words("死ねよ")) == 3


def test_one_sided_or_no_ratings_flag_nothing(spark):
    for sample in ([], [("a b c", 0.0)] * 5, [("a b c", 1.0)] * 5):
        net = A.train(sample)
        assert net.threshold > 1
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "calm words " * 20_000, 1)], "doc_id bigint, text string, score int")
    got = {r["doc_id"]: r["score"] for r in A.scores(docs, A.train([])).collect()}
    assert got[1] == got[2] == 0.0 and 0 <= got[3] <= 1
    assert A.scores(docs.limit(0), A.train([])).collect() == []


def test_sample_is_bounded_and_fair(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(A, "LABELLED", 5)
    spark.createDataFrame([(i, f"text {i}", None, 1) for i in range(20)], "doc_id bigint, text string, ingested_at timestamp, share int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, r, i % 2, None) for i in range(20) for r in "ab"] + [(1, "c", None, None), (None, "a", 1, None)], "doc_id bigint, rater string, abusive int, text string").write.parquet(f"{tmp_path}/doc_labels.parquet")
    assert A.sample_of(spark, str(tmp_path)).count() == 5


def test_trained_once_a_session_if_wanted(spark):
    sample = spark.createDataFrame([(i, CALM[i % 8] + (RUDE[i % 4] if i % 5 == 0 else ""), float(i % 5 == 0)) for i in range(60)], "doc_id bigint, text string, share double")
    net = A.network_of(sample)
    assert 0 < net.threshold < 1 and A.network_of(sample, reuse=True) is net and A.network_of(sample) is not net
    assert A.network_of(sample.limit(0)).threshold > 1


def test_seeds_by_brute_force():
    rng = random.Random(3)
    texts = [[rng.randrange(6) for _ in range(rng.randrange(1, 40))] + ([7, 8, 9] if k % 3 == 0 else []) for k in range(40)]
    rated = np.array([k % 3 == 0 for k in range(40)])
    flat, doc = np.array([w for t in texts for w in t]), np.repeat(np.arange(40), [len(t) for t in texts])
    of, low, high = A._cuts([len(t) for t in texts])
    got = A.seeds(flat, doc, low, high, rated)
    telling, share = set(), rated.mean()
    for n in (1, 2, 3):
        for g in {tuple(t[a : a + n]) for t in texts for a in range(len(t) - n + 1)}:
            docs = [k for k, t in enumerate(texts) if any(tuple(t[a : a + n]) == g for a in range(len(t) - n + 1))]
            p = rated[docs].mean()
            if len(docs) >= 3 and p >= 0.75:
                apart = p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0)
                if len(docs) * apart > A.SEED_ODDS:
                    telling.add(g)
    want = [any(tuple(flat[a : a + n]) in telling for n in (1, 2, 3) for a in range(lo, hi - n + 1)) for lo, hi in zip(low, high)]
    assert got.any() and got.tolist() == want


def test_corpus(spark, small):
    rates = A.rates(spark, small).collect()
    scores = A.all_scores(spark, small).collect()
    assert sum(r["n_docs"] for r in rates) == len(scores) and all(0 <= r["score"] <= 1 for r in scores)
