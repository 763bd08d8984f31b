"""Variant spellings of names typed by people.

Names become tokens in one form. A symmetric-delete index finds tokens within one edit: a token and all its
one-letter deletions are keys, and two tokens within one edit share a key. Tokens that few names hold index their
names alone; names that may consist of common tokens only have keys with all their other tokens, so no key gathers a
hot group.
Candidate pairs are aligned by an optimal assignment of tokens that permits typing errors, initials, short forms
and abbreviations; what remains unmatched decides. Matches are consolidated into clusters; a match by initials
counts only where all its partners are one cluster.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, table
from .components import connected_components
from .lookalikes import CANDIDATE, canonical

#: A token of more names than this is no key by itself.
RARE = 64
#: Common tokens shipped to the workers at most; beyond, all names are found by their whole form too.
SHIPPED = 50_000
#: Words of a name from which errors in two words are found by all the others alone, and beyond which by fifths of the words.
PAIRED, LONG = 6, 40
#: Names, and pairs of tokens, a worker remembers.
REMEMBERED = 200_000
#: Typing errors allowed in all, and the shortest tokens in which an insertion or a substitution may be one.
ERRORS, SHORTEST, SHORTEST_SWAP = 2, 4, 5

# Short forms of given names, with the name they stand for.
SHORT_FORMS = {
    "al": "albert alan alexander alfred", "alex": "alexander alexandra", "andy": "andrew", "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "bernie": "bernard",
    "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "will": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "albert robert",
    "charlie": "charles charlotte", "chuck": "charles", "chris": "christopher christine christina", "cathy": "catherine", "kathy": "katherine kathleen", "kate": "katherine kathleen", "katie": "katherine kathleen", "kat": "katherine", "kitty": "katherine",
    "dan": "daniel", "danny": "daniel", "dave": "david", "davy": "david", "deb": "deborah", "debbie": "deborah", "don": "donald", "ed": "edward edwin", "eddie": "edward edwin", "ned": "edward", "ted": "theodore edward", "teddy": "theodore edward", "theo": "theodore", "frank": "francis franklin francesca", "fran": "frances francesca", "frankie": "francesca francis", "fred": "frederick", "freddie": "frederick", "freddy": "frederick",
    "gabe": "gabriel", "greg": "gregory", "hank": "henry", "harry": "henry harold", "jack": "john", "johnny": "john", "jackie": "jacqueline", "jim": "james", "jimmy": "james", "jake": "jacob", "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "jeff": "jeffrey", "jerry": "gerald jerome", "joe": "joseph", "joey": "joseph", "jo": "joanna josephine", "jon": "jonathan", "ken": "kenneth",
    "larry": "lawrence", "laurie": "lawrence", "len": "leonard", "leo": "leonard leopold", "lou": "louis louise", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "marge": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael", "mikey": "michael", "nat": "nathaniel natalie", "nate": "nathan nathaniel", "nick": "nicholas", "nicky": "nicholas", "pat": "patricia patrick", "patty": "patricia", "patti": "patricia", "trish": "patricia", "tricia": "patricia", "pete": "peter", "phil": "philip",
    "ray": "raymond", "becky": "rebecca", "rich": "richard", "rick": "richard", "ricky": "richard", "dick": "richard", "ron": "ronald", "sam": "samuel samantha", "sammy": "samuel", "sandy": "alexander sandra", "steve": "stephen steven", "stu": "stuart", "sue": "susan", "susie": "susan", "suzie": "susan", "terry": "terence theresa", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "val": "valerie", "vic": "victor victoria", "vicky": "victoria", "tori": "victoria", "vince": "vincent", "walt": "walter", "zack": "zachary",
}
#: Words written short.
ABBREVIATIONS = {"orch": "orchestra", "orchester": "orchestra", "orchestre": "orchestra", "chmbr": "chamber", "sess": "sessions", "vol": "volume", "symph": "symphony", "phil": "philharmonic", "ens": "ensemble", "bros": "brothers", "pt": "part", "st": "saint", "mt": "mount", "ft": "featuring", "feat": "featuring", "vs": "versus", "dr": "doctor", "jr": "junior", "sr": "senior", "comp": "complete", "coll": "collection", "rec": "recordings", "orig": "original", "snd": "sound"}
#: What joins names, articles, and number words.
_WRITTEN_OUT = {w for full in SHORT_FORMS.values() for w in full.split()} | set(ABBREVIATIONS.values())
JOINS, ARTICLES = {"and", "n", "und", "et", "y", "with"}, {"the", "a", "an"}
NUMBERS = {w: str(n) for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
ROMAN = {w: str(n) for n, w in enumerate("i ii iii iv v vi vii viii ix x xi xii".split(), 1)}
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[&+/;]")


@lru_cache(REMEMBERED)
def tokens(name: str) -> tuple[str, ...]:
    """A name's tokens in one form: case, accents, joins, articles and numbers of volumes brought together."""
    text = unicodedata.normalize("NFKD", name.casefold().replace("’", "'"))
    text = "".join(ch for ch in text if not "̀" <= ch <= "ͯ").translate(_LETTERS)
    text = re.sub(r"(?<=\s)n'(?=\s)", "&", text)
    found = _TOKEN.findall(text)
    out: list[str] = []
    for k, t in enumerate(found):
        t = t.replace("'", "")
        if t in "&+/;" or t in JOINS:
            t = "&"
        elif t in ("volume", "vol") or t.startswith("vol") and t[3:].isdigit():
            out.append("volume")
            t = t[3:] if t[3:].isdigit() else ""
        elif out and out[-1] == "volume":
            t = NUMBERS.get(t) or ROMAN.get(t) or t
        if t and not (t in ARTICLES and len(found) > 1):
            out.append(t.lstrip("0") or "0" if t.isdigit() else t)
    return tuple(out)


def deletions(token: str) -> set[str]:
    """The token and what is left of it without any one letter."""
    return {token, *(token[:k] + token[k + 1 :] for k in range(len(token)))}


def _short(a: str, b: str) -> bool:
    """Whether ``a`` is ``b`` with letters left out: consonants alone, or all but one or two from the middle."""
    if len(b) < 6 or a[0] != b[0] or len(a) > len(b) - 2 or not a.isascii():
        return False
    rest = iter(b)
    if not all(ch in rest for ch in a):
        return False
    return not set(a) & set("aeiouy") or a[-1] == b[-1] and len(a) >= len(b) - 2 >= 5


@lru_cache(REMEMBERED)
def relation(a: str, b: str) -> str:
    """How two tokens may be one: 'same', 'typo', 'short', 'initial', or ''."""
    if a == b:
        return "same"
    if a.isdigit() or b.isdigit() or "&" in (a, b):
        return ""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return "initial" if a == b[0] and a.isalpha() and a.isascii() else ""
    if _short(a, b) or b in SHORT_FORMS.get(a, "").split() or set(SHORT_FORMS.get(a, "").split()) & set(SHORT_FORMS.get(b, "").split()) or ABBREVIATIONS.get(a) == b:
        return "short"
    if len(b) - len(a) == 1 and len(a) >= (SHORTEST - 1 if a.isascii() else 3) and a in deletions(b):
        return "typo"
    if len(a) == len(b):
        unlike = [k for k in range(len(a)) if a[k] != b[k]]
        if len(unlike) == 1 and len(a) >= SHORTEST_SWAP:
            return "typo"
        if len(unlike) == 2 and len(a) >= SHORTEST and unlike[1] == unlike[0] + 1 and a[unlike[0]] == b[unlike[1]] and a[unlike[1]] == b[unlike[0]]:
            return "typo"
    return ""


#: Unmatched tokens of either name up to which all assignments are tried, and what no relation costs beyond.
SMALL, MISSING = 8, 1_000_000
_COST = {"same": 0, "short": 1, "typo": 2, "initial": 3}


def assign(a: tuple[str, ...], b: tuple[str, ...], whole: bool = False) -> list[tuple[int, int, str]]:
    """The cheapest of the largest assignments of tokens to tokens: (place in a, place in b, relation).

    ``whole``: where a token of ``a`` has no partner at all, what equal tokens give is enough of an answer.
    """
    left, right = list(range(len(a))), list(range(len(b)))
    pairs = []
    for i in list(left):  # equal tokens in an optimal assignment can be taken first
        j = next((j for j in right if b[j] == a[i]), None)
        if j is not None:
            pairs.append((i, j, "same"))
            left.remove(i)
            right.remove(j)
    if not left or not right or whole and any(not any(relation(a[i], b[j]) for j in right) for i in left):
        return pairs
    if len(left) == 1:
        ways = [(_COST[how], (left[0], j, how)) for j in right if (how := relation(a[left[0]], b[j]))]
        return pairs + [min(ways)[1]] if ways else pairs
    if len(left) > SMALL or len(right) > SMALL:
        return pairs + _cheapest(a, b, left, right)

    @lru_cache(None)
    def best(k: int, used: int) -> tuple:
        if k == len(left):
            return (0, 0, ())
        options = [best(k + 1, used)]
        for n, j in enumerate(right):
            if not used >> n & 1 and (how := relation(a[left[k]], b[j])):
                matched, cost, way = best(k + 1, used | 1 << n)
                options.append((matched - 1, cost + _COST[how], ((left[k], j, how), *way)))
        return min(options)

    return pairs + list(best(0, 0)[2])


def _cheapest(a: tuple[str, ...], b: tuple[str, ...], left: list[int], right: list[int]) -> list[tuple[int, int, str]]:
    """The same for many tokens, in cubic time; none where a token of the shorter side has no partner, as no match is left."""
    turned = len(left) > len(right)
    rows, cols = (right, left) if turned else (left, right)
    how = lambda i, j: relation(a[j], b[i]) if turned else relation(a[i], b[j])
    costs = []
    for i in rows:
        line = [_COST.get(how(i, j), MISSING) for j in cols]
        if min(line) == MISSING:
            return []
        costs.append(line)
    # Shortest augmenting paths with prices of rows and columns.
    price_row, price_col, owner = [0] * (len(rows) + 1), [0] * (len(cols) + 1), [0] * (len(cols) + 1)
    for row in range(1, len(rows) + 1):
        owner[0], at = row, 0
        reach, done, back = [float("inf")] * (len(cols) + 1), [False] * (len(cols) + 1), [0] * (len(cols) + 1)
        while True:
            done[at], step, to = True, float("inf"), 0
            for j in range(1, len(cols) + 1):
                if not done[j]:
                    extra = costs[owner[at] - 1][j - 1] - price_row[owner[at]] - price_col[j]
                    if extra < reach[j]:
                        reach[j], back[j] = extra, at
                    if reach[j] < step:
                        step, to = reach[j], j
            for j in range(len(cols) + 1):
                if done[j]:
                    price_row[owner[j]] += step
                    price_col[j] -= step
                else:
                    reach[j] -= step
            at = to
            if not owner[at]:
                break
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    found = [(rows[owner[j] - 1], cols[j - 1]) for j in range(1, len(cols) + 1) if owner[j]]
    return [(j, i, how(i, j)) if turned else (i, j, how(i, j)) for i, j in found if how(i, j)]


def match(a: str, b: str, people: bool) -> str:
    """'strong', 'initial' (only by an initial), or '' for two names; ``people``: initials and left-out middle names."""
    x, y = tokens(a), tokens(b)
    if not x or not y:
        return ""
    if x == y:
        return "strong"
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 2:
        return ""
    pairs = assign(x, y, whole=True)
    if len(pairs) < len(x):
        return ""
    how = [h for _, _, h in pairs]
    whole = sum(h == "same" and x[i] != "&" and (not x[i].isdigit() or len(x) == 2) for i, _, h in pairs)
    if how.count("typo") > ERRORS or how.count("typo") == ERRORS and len(x) < 3 or not whole and (len(x) > 1 or len(x[0]) < 6):
        return ""
    extra = [t for j, t in enumerate(y) if j not in {j for _, j, _ in pairs}]
    numbered = any(t.isdigit() for t in (*x, *y))
    if extra == ["of"] and len(x) > 1 or extra == ["&"] and len(x) > 2:
        extra = []  # "orchestra of" a place and the place's orchestra
    if extra:
        # Given name and surname with a middle name left out, in either order.
        persons = people and len(x) == 2 and len(y) == 3 and not {"&", "of", "from", "for", "in"} & {*x, *y} and not numbered
        middle = persons and {j for _, j, _ in pairs} == {0, 2}
        if not middle:
            return ""
    if "initial" in how:
        if not people or "&" in y or numbered or not any(len(x[i]) > 3 for i, _, h in pairs if h != "initial"):
            return ""
        return "initial"
    return "strong"


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [list(tokens(n)) for n in batch.column("name").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], [*batch.schema.names, "tokens"])


def _rare_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, token) of rare tokens to the keys of the symmetric-delete index."""
    for batch in batches:
        ids, keys = [], []
        for i, t in zip(batch.column("id").to_pylist(), batch.column("token").to_pylist()):
            for d in deletions(t) if len(t) >= SHORTEST else {t}:
                ids.append(i)
                keys.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["id", "key"])


def _contexts(words: list[str], odd: list[int]) -> set[tuple[str, int]]:
    """(key, side) of a name's words. With an odd word, neither common nor near one, only keys in which it is the one that differs."""
    own = _initials(words, odd)
    for k, t in enumerate(words):
        if odd and odd != [k]:
            continue
        others = words[:k] + words[k + 1 :]
        # With all short words written out, and as they are.
        for rest in {tuple(sorted(others)), tuple(sorted(ABBREVIATIONS.get(r, r) for r in others))}:
            own |= {("\t".join((d, *rest)), 0) for d in (deletions(t) if not odd else {t})}
            own |= {("\t".join((full, *rest)), 0) for full in (*SHORT_FORMS.get(t, "").split(), *([ABBREVIATIONS[t]] if t in ABBREVIATIONS else ()))}
            if t.isascii() and len(t) > 1 and not t.isdigit():  # what _short permits
                beside = "\t".join(rest)
                if not set(t) & set("aeiouy"):
                    own.add((f"c\t\t\t{t[0]}\t{beside}", 2))
                if len(t) >= 5:
                    own.add((f"d\t\t\t{t[0]}{t[-1]}{len(t) + 2}\t{beside}", 2))
            if len(t) >= 6:
                own.add((f"c\t\t\t{t[0]}\t" + "\t".join(rest), 1))
            if len(t) >= 7:
                own.add((f"d\t\t\t{t[0]}{t[-1]}{len(t)}\t" + "\t".join(rest), 1))
        if not odd:
            if 2 < len(words) <= LONG:  # typing errors in two words
                for m in range(k + 1, len(words)):
                    rest = tuple(sorted(words[:k] + words[k + 1 : m] + words[m + 1 :]))
                    if len(words) < PAIRED:
                        own |= {("\t".join(("", *sorted((d, e)), *rest)), 0) for d in deletions(t) for e in deletions(words[m])}
                    else:
                        own.add(("\t".join(("2\t\t\t", *rest)), 0))
    if len(words) == 3 and odd in ([], [1]):  # a middle name left out
        own |= {(f"m\t\t\t{key}", 1) for x, y in ((0, 2), (2, 0)) for key in _left(words[x], words[y])}
    if len(words) == 2 and not odd:
        own |= {(f"m\t\t\t{key}", 2) for x, y in ((0, 1), (1, 0)) for key in _left(words[x], words[y])}
    return own


def _initials(words: list[str], odd: list[int]) -> set[tuple[str, int]]:
    """Each word with the initial of each other one (of each odd one, where there are any)."""
    return {(f"{t}\t\t{r[0]}", 2 if len(r) == 1 else 1) for k, t in enumerate(words) if k not in odd for m, r in enumerate(words) if m != k and (m in odd or not odd)}


def _left(t: str, rest: str) -> set[str]:
    """Keys of two words of which the first may have an error or be a short form."""
    return {f"{d}\t{rest}" for d in (*deletions(t), *SHORT_FORMS.get(t, "").split())}


def _short_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token) to (token, key, side): tokens of which one may be short for the other share a key, one on side 1, one on 2, or both on 0."""
    for batch in batches:
        out = []
        for t in batch.column("token").to_pylist():
            out += [(t, f"t{full}", 0) for full in (*SHORT_FORMS.get(t, "").split(), *([ABBREVIATIONS[t]] if t in ABBREVIATIONS else ()), t) if full != t or t in _WRITTEN_OUT]
            if t.isascii() and len(t) > 1 and not set(t) & set("aeiouy"):
                out.append((t, f"c{t[0]}", 2))
            if t.isascii() and len(t) >= 5:
                out.append((t, f"d{t[0]}{t[-1]}{len(t) + 2}", 2))
            if len(t) >= 6:
                out.append((t, f"c{t[0]}", 1))
            if len(t) >= 7:
                out.append((t, f"d{t[0]}{t[-1]}{len(t)}", 1))
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], kind) for n, kind in enumerate((pa.string(), pa.string(), pa.int32()))], ["token", "key", "side"])


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of which one is short for the other, to rows (token, edge) of both."""
    for batch in batches:
        found = [(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()) if relation(a, b) == "short"]
        yield pa.RecordBatch.from_arrays([pa.array([t for pair in found for t in pair], pa.string()), pa.array([f"{a}~{b}" for a, b in found for _ in "ab"], pa.string())], ["token", "edge"])


def _known(common: frozenset[str] | None):
    """Tells tokens that are common, one edit from a common one, or no key by themselves. ``common`` None: all."""
    near = None if common is None else {d for t in common for d in deletions(t)}
    return lambda t: common is None or t in common or len(t) < 2 or t.isdigit() or t in ABBREVIATIONS or not near.isdisjoint(deletions(t))


def _edge_keys(common: frozenset[str] | None):
    """(id, field, tokens, at, edges) to keys; ``edges``: the pairs of short and long form to which the words ``at`` belong."""
    known = _known(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, str, int]] = set()
            for i, field, found, at, edges in zip(*(batch.column(c).to_pylist() for c in ("id", "field", "tokens", "at", "edges"))):
                short: dict[str, list[str]] = {}
                for t, e in zip(at, edges):
                    short.setdefault(t, []).append(e)
                out |= {(i, key, side) for key, side in _edges(found, short, field == "artist", known)}
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], kind) for n, kind in enumerate((pa.int64(), pa.string(), pa.int32()))], ["id", "key", "side"])

    return run


def _edges(found: list[str], short: dict[str, list[str]], people: bool, known) -> set[tuple[str, int]]:
    """(key, side) of a name's words written short, with all its other words.

    A word that is not ``known`` is a key by itself, by which equal words and errors meet: here it is short or an initial.
    """
    words, of, own = [t for t in found if t not in ("&", "of")], "of" in found, set()
    odd = {t for t in words if not known(t)}
    lettered = people and "&" not in found and not any(t.isdigit() for t in found)  # else no initials, no middle names
    if not lettered and not odd <= short.keys():
        return own
    equal = [*((k, t) for k, t in enumerate(words) if t not in odd and not t.isdigit()), *([(-1, "of")] if of else [])]
    for f, t in enumerate(words):
        for edge in short.get(t, ()):
            for k, e in equal:
                if k == f:
                    continue
                if len(words) > PAIRED:
                    own.add((f"s\t\t\t{len(words)}\t{e}\t{edge}", 0))
                elif lettered:
                    own |= {(f"s\t\t\t{e}\t{edge}\ti\t{r[0]}", 2 if len(r) == 1 else 1) for g, r in enumerate(words) if g not in (f, k)}
                    if (len(words), f, k) in ((3, 0, 2), (3, 2, 0), (2, 0, 1), (2, 1, 0)):  # a middle name left out
                        own.add((f"sm\t\t\t{e}\t{edge}", 1 if len(words) == 3 else 2))
    if len(words) > PAIRED or len(words) < 3 and not of or not odd <= short.keys():
        return own
    places = [k for k, t in enumerate(words) if t in short]
    for n in (1, 2, 3):
        for at in combinations(places, n):
            ways = {tuple(sorted(way)) for way in product(*(short[words[k]] for k in at))}
            if n == 3:  # and more: the others may be short too
                own |= {("\t".join(("s3\t\t", e, *way)), 0) for k, e in equal if k not in at for way in ways}
            elif odd.isdisjoint(rest := [t for k, t in enumerate(words) if k not in at]):
                own |= {("\t".join(("s\t\t", *sorted((*way, *others)))), 0) for others in _mistyped(rest, of, len(words) < PAIRED) for way in ways}
    return own


def _mistyped(words: list[str], of: bool, close: bool) -> set[tuple[str, ...]]:
    """The words with two of them changed at most: by their deletions where ``close``, else left out. Beside an "of" none must be equal."""
    can = [k for k, t in enumerate(words) if len(t) > 2 and not t.isdigit()]
    equal = sum(not t.isdigit() for t in words) - (not of)
    if equal < 0:
        return set()
    out: set[tuple[str, ...]] = set()
    for at in combinations(can, min(ERRORS, len(can), equal) if close else min(ERRORS, len(can))):
        rest = [t for k, t in enumerate(words) if k not in at]
        out |= {(*rest, *way) for way in product(*(deletions(words[k]) for k in at))} if close else {tuple(rest)}
    return out


def _edged(heads: DataFrame, common: frozenset[str] | None) -> DataFrame:
    """Keys (id, key, side) of names that differ in a shortened word and in others: by the words of this table that are short for one another."""
    each = Stored(heads.select("id", F.explode(F.array_distinct("tokens")).alias("token")).filter("length(token) > 1 AND NOT token RLIKE '^[0-9]+$'")).df
    keys = Stored(each.select("token").distinct().mapInArrow(_short_keys, "token string, key string, side int")).df
    a, b = (keys.select("key", F.col("side").alias(f"side_{n}"), F.col("token").alias(n)) for n in "ab")
    pairs = a.join(b, "key").filter("side_a = 2 AND side_b = 1 OR side_a = 0 AND side_b = 0 AND a < b").select("a", "b").distinct()
    edges = pairs.mapInArrow(_shortened, "token string, edge string").distinct()
    held = each.join(edges, "token").groupBy("id").agg(F.collect_list(F.struct("token", "edge")).alias("e"))
    rows = heads.select("id", "field", "tokens").join(held, "id").select("id", "field", "tokens", F.col("e.token").alias("at"), F.col("e.edge").alias("edges"))
    return rows.mapInArrow(_edge_keys(common), "id bigint, key string, side int")


def _context_keys(common: frozenset[str] | None):
    """(id, tokens) of names all of whose tokens but one at most are common, one edit from a common one, or written
    short, to keys: each token, changed or left out, with all the others, and each token with their initials.
    ``common`` None: all names give such keys."""
    known = _known(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, found in zip(batch.column("id").to_pylist(), batch.column("tokens").to_pylist()):
                words = [t for t in found if t not in ("&", "of")]
                odd = [k for k, t in enumerate(words) if not known(t)]
                own = _contexts(words, odd) if len(odd) < 2 else _initials(words, odd)
                if len(words) > LONG:  # two changed words are in four of the fifths at most
                    fifths = [sorted(t for t in words if crc32(t.encode()) % 5 == n) for n in range(5)]
                    own |= {("\t".join((f"5\t\t\t{n}\t{len(words)}", *part)), 0) for n, part in enumerate(fifths)}
                if "of" in found and len(words) == 2 and not odd:  # errors in both words beside an "of"
                    own |= {("\t".join(("of\t\t", *sorted((d, e)))), 0) for d in deletions(words[0]) for e in deletions(words[1])}
                ids += [i] * len(own)
                keys += sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int32())], ["id", "key", "side"])

    return run


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        how = [match(a, b, f == "artist") for f, a, b in zip(*(batch.column(c).to_pylist() for c in ("field", "name_a", "name_b")))]
        yield batch.select(["a", "b"]).append_column("how", pa.array(how, pa.string())).filter(pa.array([bool(h) for h in how], pa.bool_()))


def _dedup(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(listed: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of names that may match, among (id, field, tokens)."""
    # Of names with the same tokens in the same order one is compared with others.
    heads = listed.filter(F.size("tokens") > 0).groupBy("field", "tokens").agg(F.min("id").alias("id"))
    each = heads.select("id", "field", F.explode(F.array_distinct("tokens")).alias("token")).filter("length(token) > 1 AND NOT token RLIKE '^[0-9]+$'")
    counted = each.join(each.groupBy("field", "token").agg(F.count(F.lit(1)).alias("n")), ["field", "token"])
    rare = counted.filter(F.col("n") <= RARE)
    listed_common = [r["token"] for r in counted.filter(F.col("n") > RARE).select("token").distinct().limit(SHIPPED + 1).collect()]
    common = frozenset(listed_common) if len(listed_common) <= SHIPPED else None  # bounded; beyond, another way
    by_token = rare.select("id", "token").mapInArrow(_rare_keys, "id bigint, key string").withColumn("side", F.lit(0))
    keys = by_token.unionByName(heads.select("id", "tokens").mapInArrow(_context_keys(common), "id bigint, key string, side int")).unionByName(_edged(heads, common))
    keyed = keys.join(listed.select("id", "field"), "id").distinct()
    shared = Stored(keyed.join(keyed.groupBy("field", "key").count().filter("count > 1").select("field", "key"), ["field", "key"])).df
    return _dedup(shared.alias("x").join(shared.alias("y"), ["field", "key"]).filter("x.id < y.id AND (x.side + y.side = 0 OR x.side <> y.side)").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))


def variants(names: DataFrame) -> DataFrame:
    """Clusters of spellings of one name: rows (field, name, cluster) for names with at least one other spelling.

    ``names`` has (field, name); null and empty names, and names without letters or digits, match nothing;
    repeated rows count once; names of different fields never match. An empty table gives none.
    """
    ddl = "field string, name string, id bigint, tokens array<string>"
    own = names.select("field", "name").filter("name <> ''").distinct().withColumn("id", F.xxhash64("field", "name"))
    listed = Stored(own.mapInArrow(_tokenized, ddl)).df
    # Equal tokens in another order or writing need no candidate search: a star from the least id.
    form = F.concat_ws("\t", F.array_sort("tokens"))
    alike = listed.filter(F.size("tokens") > 0).select("id", "field", form.alias("form"))
    least = alike.groupBy("field", "form").agg(F.min("id").alias("a"))
    stars = alike.join(least, ["field", "form"]).filter("a <> id").select("a", F.col("id").alias("b"), F.lit("strong").alias("how"))
    pairs = _candidates(listed)
    a = listed.select(F.col("id").alias("a"), "field", F.col("name").alias("name_a"))
    b = listed.select(F.col("id").alias("b"), F.col("name").alias("name_b"))
    judged = Stored(pairs.join(a, "a").join(b, "b").select("a", "b", "field", "name_a", "name_b").mapInArrow(_matched, "a bigint, b bigint, how string").unionByName(stars)).df
    strong = judged.filter("how = 'strong'").select("a", "b")
    roots = Stored(connected_components(strong)).df
    # A name known by an initial joins the one cluster it can mean, not several.
    root = lambda end: judged.filter("how = 'initial'").select("a", "b").join(roots.withColumnRenamed("id", end), end, "left")
    initial = root("a").select("a", "b", F.coalesce("root_id", "a").alias("ra")).join(roots.withColumnRenamed("id", "b"), "b", "left").select("ra", F.coalesce("root_id", "b").alias("rb")).filter("ra <> rb").distinct()
    lettered = _lettered(listed, roots)
    ends = initial.select(F.col("ra").alias("r"), F.col("rb").alias("o")).unionByName(initial.select(F.col("rb").alias("r"), F.col("ra").alias("o")))
    meant = ends.join(lettered, "r", "left_semi").join(lettered.withColumnRenamed("r", "o"), "o", "left_anti").groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o")).filter("n = 1").select(F.col("r").alias("a"), F.col("o").alias("b"))
    same = ends.join(lettered, "r", "left_semi").join(lettered.withColumnRenamed("r", "o"), "o", "left_semi").select(F.col("r").alias("a"), F.col("o").alias("b"))
    linked = connected_components(strong.unionByName(meant).unionByName(same))
    return linked.join(listed.select("id", "field", "name"), "id").select("field", "name", F.col("root_id").alias("cluster"))


def _lettered(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """Clusters all of whose spellings hold an initial."""
    short = F.exists("tokens", lambda t: (F.length(t) == 1) & t.rlike("^[a-z]$"))
    of = listed.join(roots, "id", "left").select(F.coalesce("root_id", "id").alias("r"), short.alias("short"))
    return of.groupBy("r").agg(F.min("short").alias("all")).filter("all").select("r")


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("name").to_pylist()
        odd = [f == "artist" and canonical(n) != n for f, n in zip(batch.column("field").to_pylist(), names)]
        yield batch.filter(pa.array([not x for x in odd], pa.bool_()))


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artists and albums as stored, without those that hold stand-ins (6) or were misread (7)."""
    from . import encodings

    files = table(spark, sf_dir, "files").select("id", "path", "title", "artist", "album")
    said = encodings.texts(files).filter("field <> 'title' AND text <> ''")
    names = said.groupBy("field", F.col("text").alias("name")).agg(F.min("source").alias("source"))
    broken = encodings.Model.fit(files).flag(names.select(F.lit(0).cast("bigint").alias("file_id"), "field", "source", F.col("name").alias("text"))).select("field", F.col("text").alias("name"))
    odd = F.col("name").rlike(CANDIDATE)
    plain = names.select("field", "name").filter(~odd).unionByName(names.select("field", "name").filter(odd).mapInArrow(_clean, "field string, name string"))
    return plain.join(broken.distinct(), ["field", "name"], "left_anti")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: pairs of different spellings of one act or album."""
    spelled = Stored(variants(_library(spark, sf_dir))).df
    a, b = (spelled.select("field", "cluster", F.col("name").alias(n)) for n in ("name_a", "name_b"))
    return a.join(b, ["field", "cluster"]).filter("name_a < name_b").select("field", "name_a", "name_b")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_clusters: every spelling with the least spelling of its cluster."""
    spelled = Stored(variants(_library(spark, sf_dir))).df
    return spelled.join(spelled.groupBy("field", "cluster").agg(F.min("name").alias("least_name")), ["field", "cluster"]).select("field", "name", "least_name")


QUERIES = {"p5_found": found, "p5_clusters": clusters}
ORACLES: dict = {}
