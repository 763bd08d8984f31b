"""Abusive, hateful or sexual content: a bidirectional gated recurrent network with attention pooling.

The network reads windows of words; a word enters as its own vector plus the mean of the vectors of its letter
trigrams, so misspelt and masked words stay near the plain ones. It is trained in numpy on a bounded, documented
sample of rated documents (``LABELLED``). Ratings are of documents and partly wrong: the first round learns from
windows with phrases that stand in documents rated abusive far too often for chance, later rounds add the windows
of such documents that the network finds by itself, and trust what it is sure of in others less. All overlapping windows of all
documents are scored; a document's score is that of its highest window.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, latest, table
from .lookalikes import canonical

#: Rated documents the network is trained on at most; the sample is by hash of the id.
LABELLED = 5000
#: Rated documents of more characters are not trained on (they are scored like all others).
LONGEST = 50_000
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 16, 6
#: Sizes: word and trigram vectors, states, hash buckets of trigrams, least documents of a word of its own.
WIDTH, STATE, GRAMS, OWN = 24, 24, 1 << 14, 6
#: Rounds of relabelling, passes and rate of learning, windows of a step.
ROUNDS, PASSES, RATE, STEP = 3, 3, 0.01, 256
#: Windows of other documents drawn for a pass at least, decay of the weights, and the (natural) logarithm of the
#: odds against chance from which a phrase is telling.
NEGATIVES, DECAY, SEED_ODDS = 16_000, 0.004, 9.0
#: Share of the sample kept to choose the threshold.
HELD_OUT = 0.2

# Digits and signs that stand for letters within a word.
_LEET = str.maketrans("013457@$!€|", "oieastasiel")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿々]")
_LETTER = r"[^\W぀-ヿ㐀-鿿々]"  # a word ends where kana or kanji begin
_WORD = re.compile(rf"{_WIDE.pattern}|[^\W_](?:{_LETTER}|[*@$€]|[!|](?={_LETTER}|[*@$€|]))*|\*{{2,}}{_LETTER}*")
#: Words of more characters are not kept in memory.
KEPT = 64


def words(text: str | None) -> list[str]:
    """The words of a text for the network; East Asian text gives pairs of characters."""
    if not text:
        return []
    text = unicodedata.normalize("NFC", text if text.isascii() else canonical(text)).lower()
    text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    found = _WORD.findall(text)
    if _WIDE.search(text):
        found = [a + b if _WIDE.match(a) and _WIDE.match(b) else a for a, b in zip(found, [*found[1:], " "])]
    return found


@lru_cache(200_000)
def plain(word: str) -> str:
    """A word without the digits, signs and lengthenings that mask it."""
    if word.isdigit():
        return "0"
    if not word.isalpha() and any(ch.isalpha() for ch in word):
        word = word.translate(_LEET)
    return re.sub(r"(.)\1{2,}", r"\1", word)


def grams(word: str) -> tuple[int, ...]:
    """Buckets of all letter trigrams of a word; a masked letter is any letter."""
    return _grams(word) if len(word) <= KEPT else _grams.__wrapped__(word)


@lru_cache(200_000)
def _grams(word: str) -> tuple[int, ...]:
    marked = f"^{word}$"
    return tuple(sorted({zlib.crc32(marked[k : k + 3].encode()) % GRAMS for k in range(max(1, len(marked) - 2))}))


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover ``n`` words."""
    return [(k, min(n, k + WINDOW)) for k in range(0, max(1, n - WINDOW + STRIDE), STRIDE)] if n else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lexicon:
    """Distinct words as arrays: the ``numbers`` of their own vectors (0 for none) and the buckets of their trigrams."""

    def __init__(self, numbers: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.numbers, self.flat, self.sizes = numbers, flat, sizes
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)

    @staticmethod
    def of(words: list[str], vocabulary: dict[str, int]) -> Lexicon:
        found = [grams(w) for w in words]
        sizes = np.array([len(g) for g in found], np.int64)
        return Lexicon(np.array([vocabulary.get(w, 0) for w in words], np.int64), np.fromiter((x for g in found for x in g), np.int64, int(sizes.sum())), sizes)

    def take(self, which: np.ndarray) -> Lexicon:
        sizes = self.sizes[which]
        at = np.repeat(self.starts[which] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
        return Lexicon(self.numbers[which], self.flat[at], sizes)


def _added(rows: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """The sums of ``rows`` by the place ``to`` which each belongs."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    order = np.argsort(to, kind="stable")
    places = to[order]
    edges = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
    out[places[edges]] = np.add.reduceat(rows[order], edges)
    return out


class Network:
    """Parameters ``p`` (arrays by name), the vocabulary, and the decision threshold."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 0) -> None:
        rng, d, h = np.random.default_rng(seed), WIDTH, STATE
        draw = lambda *s: (rng.standard_normal(s) * (0.3 if len(s) == 2 and s[0] > 200 else 1 / np.sqrt(s[0]))).astype(np.float32)
        self.vocabulary, self.threshold = vocabulary, 0.5
        self.p = {"word": draw(len(vocabulary) + 1, d) * 0.3, "gram": draw(GRAMS, d)}
        for way in "fb":
            self.p |= {f"{way}W": draw(d, 3 * h), f"{way}U": draw(h, 3 * h), f"{way}c": np.zeros(3 * h, np.float32)}
        self.p |= {"A": draw(2 * h, h), "Ab": np.zeros(h, np.float32), "v": draw(h, 1)[:, 0], "o": draw(2 * h, 1)[:, 0], "ob": np.full(1, -1.0, np.float32)}

    def vectors(self, lexicon: Lexicon, own: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of distinct words; where ``own`` is false, by their letters alone."""
        numbers = lexicon.numbers if own is None else lexicon.numbers * own
        return self.p["word"][numbers] + np.add.reduceat(self.p["gram"][lexicon.flat], lexicon.starts) / lexicon.sizes[:, None].astype(np.float32)

    def _read(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States of one direction: ``x`` (time, rows, 3 * STATE) are the inputs' shares of the gates."""
        u, h = self.p[f"{way}U"], np.zeros((x.shape[1], STATE), np.float32)
        out = np.empty((*x.shape[:2], STATE), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g = h @ u
            gates = _sigmoid(x[t, :, : 2 * STATE] + g[:, : 2 * STATE])
            z, r = gates[:, :STATE], gates[:, STATE:]
            n = np.tanh(x[t, :, 2 * STATE :] + r * g[:, 2 * STATE :])
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * STATE :]))
            h = m * (n + z * (h - n)) + (1 - m) * h
            out[t] = h
        return out

    def forward(self, x: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: ``x`` vectors of distinct words, ``rows`` (time, windows) their numbers."""
        states = [self._read((x @ self.p[f"{w}W"] + self.p[f"{w}c"])[rows], mask, w, keep.setdefault(w, []) if keep is not None else None) for w in "fb"]
        s = np.concatenate(states, axis=2)
        a = np.tanh(s @ self.p["A"] + self.p["Ab"])
        e = np.where(mask > 0, a @ self.p["v"], -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[..., None] * s).sum(0)
        if keep is not None:
            keep |= {"s": s, "a": a, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["ob"]

    def gradients(self, lexicon: Lexicon, rows: np.ndarray, mask: np.ndarray, wanted: np.ndarray, weight: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
        x, keep, p = self.vectors(lexicon, own), {}, self.p
        logits = self.forward(x, rows, mask, keep)
        d = ((_sigmoid(logits) - wanted) * weight / weight.sum()).astype(np.float32)
        s, a, alpha, pooled = keep["s"], keep["a"], keep["alpha"], keep["pooled"]
        out = {"o": pooled.T @ d, "ob": d.sum(keepdims=True)}
        dp = d[:, None] * p["o"]
        ds = alpha[..., None] * dp
        da = (s * dp).sum(2)
        de = alpha * (da - (alpha * da).sum(0))
        out["v"] = np.einsum("tn,tnh->h", de, a)
        dt = de[..., None] * p["v"] * (1 - a * a)
        out["A"] = np.einsum("tni,tnj->ij", s, dt)
        out["Ab"] = dt.sum((0, 1))
        ds += dt @ p["A"].T
        dx, gates = np.zeros_like(x), []
        for k, way in enumerate("fb"):
            u, dh = p[f"{way}U"], np.zeros((rows.shape[1], STATE), np.float32)
            du, dgates = np.zeros_like(u), np.zeros((*rows.shape, 3 * STATE), np.float32)
            for t, h, z, r, n, gn in reversed(keep[way]):
                dh = dh + ds[t, :, k * STATE : (k + 1) * STATE]
                m = mask[t][:, None]
                dm = dh * m
                dn = dm * (1 - z) * (1 - n * n)
                dz = dm * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                du += h.T @ dg
                dh = dh * (1 - m) + dm * z + dg @ u.T
            gates.append(dgates.reshape(-1, 3 * STATE))
            out |= {f"{way}U": du, f"{way}c": gates[-1].sum(0)}
        per_word = _added(np.concatenate(gates, axis=1), rows.ravel(), len(x))
        for k, way in enumerate("fb"):
            own_share = per_word[:, 3 * STATE * k : 3 * STATE * (k + 1)]
            out[f"{way}W"] = x.T @ own_share
            dx += own_share @ p[f"{way}W"].T
        out["word"] = _added(dx, lexicon.numbers * own, len(p["word"]))
        out["word"][0] = 0
        out["gram"] = _added(np.repeat(dx / lexicon.sizes[:, None].astype(np.float32), lexicon.sizes, axis=0), lexicon.flat, GRAMS)
        return out

    def probabilities(self, x: np.ndarray, flat: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of windows of the words ``flat``, from ``low`` to before ``high``; ``x`` are the vectors of distinct words."""
        out = np.empty(len(low))
        for at in range(0, len(low), 4096):
            rows, mask = _grid(flat, low[at : at + 4096], high[at : at + 4096])
            out[at : at + 4096] = _sigmoid(self.forward(x, rows, mask))
        return out

    def score(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Probability of each window of each text."""
        vocab: dict[str, int] = {}
        flat = np.array([vocab.setdefault(plain(w), len(vocab)) for t in texts for w in t], np.int64)
        if not vocab:
            return [np.zeros(0) for _ in texts]
        of, low, high = _cuts([len(t) for t in texts])
        scores = self.probabilities(self.vectors(Lexicon.of(list(vocab), self.vocabulary)), flat, low, high)
        return [scores[lo:hi] for lo, hi in zip(np.searchsorted(of, np.arange(len(texts))), np.searchsorted(of, np.arange(len(texts)), side="right"))]


def _cuts(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of texts of these sizes that stand in a row: (text, first word, word after the last)."""
    starts = np.concatenate(([0], np.cumsum(sizes))).tolist()
    cuts = [(k, starts[k] + a, starts[k] + b) for k, n in enumerate(sizes) for a, b in windows(n)]
    return tuple(np.array(cuts, np.int64).reshape(-1, 3).T)


def _grid(flat: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, windows): the words of windows, and which places hold one."""
    at = low + np.arange(WINDOW)[:, None]
    mask = (at < high).astype(np.float32)
    return flat[np.minimum(at, len(flat) - 1)], mask


def train(sample: list[tuple[str, float]]) -> Network:
    """The network from (text, share of raters who found it abusive); no or one-sided ratings give one that flags nothing."""
    texts = [[plain(w) for w in words(t)] for t, _ in sample]
    rated = np.array([y for _, y in sample]) > 0.5 if sample else np.zeros(0, bool)
    seen = Counter(w for t in texts for w in set(t))
    net = Network({w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= OWN), 1)})
    if not rated.any() or rated.all():
        net.threshold = 2.0
        return net
    rng = np.random.default_rng(1)
    held = rng.random(len(texts)) < HELD_OUT
    place = {w: k for k, w in enumerate(sorted(seen))}
    lexicon = Lexicon.of(list(place), net.vocabulary)
    used = np.flatnonzero(~held)
    flat = np.array([place[w] for k in used for w in texts[k]], np.int64)
    of, low, high = _cuts([len(texts[k]) for k in used])
    if not len(of):
        net.threshold = 2.0
        return net
    marked = seeds(flat, np.repeat(np.arange(len(used)), [len(texts[k]) for k in used]), low, high, rated[used])
    rude = rated[used][of]
    wanted = (marked & rude).astype(np.float32)
    # Other windows of documents rated abusive are left open at first; wrong ratings of others are outvoted.
    weight = np.where(rude & ~marked, 0.0, 1.0).astype(np.float32)
    moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, hard = 0, np.zeros(len(of))
    mean, counted = {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for turn in range(ROUNDS):
        positive, negative = np.flatnonzero((wanted > 0) & (weight > 0)), np.flatnonzero((wanted == 0) & (weight > 0))
        if not len(positive) or not len(negative):
            break
        for lap in range(PASSES):
            # Abusive windows are few: others are drawn, those scored higher before more often.
            chance = (0.1 + hard[negative]) / (0.1 + hard[negative]).sum()
            drawn = rng.choice(negative, min(len(negative), max(NEGATIVES, 4 * len(positive))), replace=False, p=chance)
            order = rng.permutation(np.concatenate([positive, drawn]))
            for at in range(0, len(order), STEP):
                part = order[at : at + STEP]
                rows, mask = _grid(flat, low[part], high[part])
                vocab, inverse = np.unique(rows, return_inverse=True)
                # Words of their own are sometimes read by their letters alone, as new ones will be.
                found = net.gradients(lexicon.take(vocab), inverse.reshape(rows.shape), mask, wanted[part], weight[part], rng.random(len(vocab)) > 0.15)
                step += 1
                rate = RATE * min(1.0, step / 50) / (1 + turn)
                for name, g in found.items():
                    np.clip(g, -1, 1, out=g)
                    moment[name] += 0.1 * (g - moment[name])
                    square[name] += 0.001 * (g * g - square[name])
                    net.p[name] -= rate * ((moment[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8) + DECAY * net.p[name])
                if turn == ROUNDS - 1 and lap:
                    counted += 1
                    for name, v in net.p.items():
                        mean[name] += (v - mean[name]) / counted
        # The mean of the last passes' parameters varies less from sample to sample than the last ones.
        net.p = mean if counted else net.p
        hard = net.probabilities(net.vectors(lexicon), flat, low, high)
        agreed = rude & (marked | (hard > 0.8))
        wanted = agreed.astype(np.float32)
        # What the network doubts in documents rated abusive stays open; what it is sure of in others counts less.
        weight = np.where(rude, np.where(agreed | (hard < 0.05), 1.0, 0.0), np.where(hard > 0.98, 0.3, 1.0)).astype(np.float32)
    scores = np.array([s.max() if len(s) else 0.0 for s in net.score([t for t, h in zip(texts, held) if h])])
    net.threshold = _threshold(scores, rated[held])
    return net


def seeds(flat: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, rated: np.ndarray) -> np.ndarray:
    """Windows with a phrase of one to three words that stands in documents rated abusive far too often for chance."""
    share = rated[np.unique(doc)].mean()
    found, phrase = np.zeros(len(low), bool), np.zeros(len(flat), np.int64)
    for n in (1, 2, 3):
        # The phrases of n words are numbered by those of n - 1 and the next word.
        size = len(flat) - n + 1
        if size <= 0:
            break
        phrase = np.unique(phrase[:size] * (int(flat.max()) + 1) + flat[n - 1 :], return_inverse=True)[1]
        inside = np.flatnonzero(doc[:size] == doc[n - 1 :])
        pairs = np.unique(np.stack([phrase[inside], doc[inside]]), axis=1)
        docs, hits = np.bincount(pairs[0], minlength=int(phrase.max()) + 1), np.bincount(pairs[0], weights=rated[pairs[1]], minlength=int(phrase.max()) + 1)
        # The chance of so many or more among as many documents, by the Chernoff bound.
        p = hits / np.maximum(docs, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = p * np.log(p / share) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0.0)
        telling = (docs >= 3) & (p >= 0.75) & (p > share) & (docs * np.nan_to_num(apart) > SEED_ODDS)
        starts = np.zeros(len(flat) + 1, np.int64)
        starts[1:][inside] = telling[phrase[inside]]
        starts = np.cumsum(starts)
        last = np.maximum(high - n + 1, low)
        found |= starts[last] > starts[low]
    return found


def _threshold(scores: np.ndarray, rated: np.ndarray) -> float:
    """Where precision and recall balance best on documents kept out of training; the middle of ties."""
    tried = np.linspace(0.3, 0.9, 61)
    f = np.array([2 * (rated & (scores >= t)).sum() / max(1, rated.sum() + (scores >= t).sum()) for t in tried])
    best = tried[f >= f.max() - 1e-9]
    return float(best[len(best) // 2])


def sample_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ``LABELLED`` rated documents: rows (doc_id, text, share of raters who found them abusive); ties in rating stay out."""
    rated = table(spark, sf_dir, "doc_labels").select("doc_id", "rater", "abusive").filter("abusive IS NOT NULL AND doc_id IS NOT NULL").distinct()
    share = rated.groupBy("doc_id").agg(F.avg("abusive").alias("share")).filter("share <> 0.5")
    taken = F.broadcast(share.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))  # bounded: LABELLED rows
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "ingested_at").join(taken, "doc_id")
    last = docs.groupBy("doc_id").agg(F.max(F.struct("ingested_at", "text", "share")).alias("s")).select("doc_id", "s.text", "s.share")
    return last.filter((F.col("text") != "") & (F.length("text") <= LONGEST))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "share"))))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(text, share) for _, text, share in rows]))], pa.binary())], ["network"])


def network_of(sample: DataFrame, reuse: bool = False) -> Network:
    """The network trained on a bounded sample, by one task.

    ``reuse`` takes the network an earlier call of the session trained on the same sample, if there is one. The
    registered queries do not: each does its whole work whenever it is run.
    """
    spark = sample.sparkSession
    held = Stored(sample, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id", "text", "share")).alias("x"))
    key = (held.seen["n"], held.seen["x"])
    known = spark.sparkContext.__dict__.setdefault("_reprise_networks", {})
    if not reuse or key not in known:
        known.clear()  # the last network alone is kept
        if not key[0]:
            known[key] = train([])
        else:
            known[key] = pickle.loads(held.df.repartition(1).mapInArrow(_fit, "network binary").first()["network"])
    held.drop()
    return known[key]


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """Rows (doc_id, score) of all documents: the highest of their windows, 0 without any word (null or empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                top = [float(s.max()) if len(s) else 0.0 for s in net.score([words(t) for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(top, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Network]:
    net = network_of(sample_of(spark, sf_dir))
    return scores(latest(spark, sf_dir, "documents", "doc_id", "ingested_at", "text"), net), net


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_found: the documents that hold abusive, hateful or sexual content."""
    scored, net = _scored(spark, sf_dir)
    return scored.filter(F.col("score") >= net.threshold).select("doc_id")


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_scores: every document's score."""
    return _scored(spark, sf_dir)[0].select("doc_id", F.round("score", 4).alias("score"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_rates: per source the numbers of documents and of abusive ones, and the rate."""
    scored, net = _scored(spark, sf_dir)
    sources = latest(spark, sf_dir, "documents", "doc_id", "ingested_at", "source")
    counted = scored.join(sources, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("score") >= net.threshold).cast("bigint")).alias("n_abusive"))
    return counted.select("source", "n_docs", "n_abusive", F.round(F.col("n_abusive") / F.col("n_docs"), 6).alias("rate"))


QUERIES = {"p10_found": found, "p10_scores": all_scores, "p10_rates": rates}
ORACLES: dict = {}
