"""Best representative of each duplicate group, by token-level consensus.

The values of a group are aligned progressively, field by field: each distinct token sequence, the weightiest first,
is aligned to the profile of those before it; each column of the profile then votes. Every known value votes with its
weight: that of a graded field grows with the value's trust (a bitrate of 320 weighs more than one of 128, and less
than seven of them), that of others with how complete its record is. The consensus is the voted record; the survivor
is the existing member closest to it: it falls short of the voted values the least, then is trusted most, then
differs in the fewest tokens.

Distinct values are counted in Spark before any Python sees them, and each profile is built in ``SALTS`` parts
that are merged afterwards, so no task holds the rows of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, table

SALTS = 8
#: Cells of the alignment table up to which it is filled whole.
CELLS = 250_000
#: The power of its trust with which a value of a graded field votes.
SHARPNESS = 2


@dataclass(frozen=True)
class Field:
    """A voting field: ``trust`` is null or ≤ 0 where the value is unknown, ``tokens`` its array of tokens, ``weight`` the
    (whole) weight of its vote, by default its trust to the power of ``SHARPNESS``."""

    name: str
    trust: Column
    tokens: Column
    weight: Column | None = None

    def vote(self) -> Column:
        """The value as (trust, weight, tokens); an unknown one has trust and weight 0 and no tokens."""
        known = (self.trust > 0) & (F.size(self.tokens) > 0)
        trust = F.when(known, self.trust).otherwise(0).cast("bigint")
        weight = F.pow(self.trust.cast("double"), F.lit(SHARPNESS)) if self.weight is None else self.weight
        weight = F.when(known, F.greatest(F.coalesce(weight.cast("bigint"), F.lit(1)), F.lit(1).cast("bigint"))).otherwise(0).cast("bigint")
        return F.struct(trust.alias("trust"), weight.alias("weight"), F.when(known, self.tokens).otherwise(F.array().cast("array<string>")).alias("tokens"))


def align(profile: list[dict[str, int]], votes: list[dict[str, int]]) -> list[dict[str, int]]:
    """Two profiles (per column: token to votes) aligned to the largest number of agreeing votes, then added up."""
    n, m = len(profile), len(votes)
    if n == m == 1 or not n or not m:
        short = [{}] * max(n, m)
        pairs = list(zip(profile or short, votes or short))
    elif n * m > CELLS:  # long texts: the matching blocks of the most voted tokens
        first, second = ([min(c, key=lambda t: (-c[t], t)) if c else "" for c in side] for side in (profile, votes))
        pairs, i, j = [], 0, 0
        for block in SequenceMatcher(None, first, second, autojunk=False).get_matching_blocks():
            pairs += [(a, {}) for a in profile[i : block.a]] + [({}, b) for b in votes[j : block.b]]
            pairs += list(zip(profile[block.a : block.a + block.size], votes[block.b : block.b + block.size]))
            i, j = block.a + block.size, block.b + block.size
    else:
        gain = [[sum(min(a[t], b[t]) for t in a.keys() & b.keys()) for b in votes] for a in profile]
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + gain[i][j])
        i = j = 0
        pairs = []
        while i < n and j < m:
            if best[i][j] == best[i + 1][j + 1] + gain[i][j]:
                pairs.append((profile[i], votes[j]))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                pairs.append((profile[i], {}))
                i += 1
            else:
                pairs.append(({}, votes[j]))
                j += 1
        pairs += [(a, {}) for a in profile[i:]] + [({}, b) for b in votes[j:]]
    return [{t: a.get(t, 0) + b.get(t, 0) for t in a.keys() | b.keys()} for a, b in pairs]


def elect(profile: list[dict[str, int]], weight: int) -> list[str]:
    """Per column the token with most votes (the smallest on a tie), left out where most of the weight has none."""
    chosen = []
    for column in profile:
        token = min(column, key=lambda t: (-column[t], t))
        if 2 * sum(column.values()) >= weight:
            chosen.append(token)
    return chosen


#: ``trusts`` has the highest trust of a value that holds the token.
PARTIAL = pa.schema([("g", pa.int64()), ("field", pa.string()), ("weight", pa.int64()), ("profile", pa.list_(pa.map_(pa.string(), pa.int64()))), ("trusts", pa.map_(pa.string(), pa.int64()))])
_PARTIAL_DDL = "g bigint, field string, weight bigint, profile array<map<string,bigint>>, trusts map<string,bigint>"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, field, weight, profile, trusts) sorted by (g, field), the weightiest first, to one row each."""
    key, weight, profile, trusts, out = None, 0, [], {}, []

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PARTIAL)], schema=PARTIAL)

    for batch in batches:
        for g, field, w, votes, sure in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key != (g, field):
                if key:
                    out.append((*key, weight, [list(c.items()) for c in profile], list(trusts.items())))
                key, weight, profile, trusts = (g, field), 0, [], {}
            profile, weight = align(profile, [dict(c) for c in votes]), weight + w
            for t, n in sure:
                trusts[t] = max(n, trusts.get(t, 0))
        if len(out) >= 2000:
            yield closed()
            out = []
    if key:
        out.append((*key, weight, [list(c.items()) for c in profile], list(trusts.items())))
    if out:
        yield closed()


def _elected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _profiles(batches):
        g, field, weights, profiles, trusts = (batch.column(i) for i in range(5))
        tokens = [elect([dict(c) for c in p], w) for p, w in zip(profiles.to_pylist(), weights.to_pylist())]
        trust = [min((dict(sure)[t] for t in own), default=0) for own, sure in zip(tokens, trusts.to_pylist())]
        yield pa.RecordBatch.from_arrays([g, field, pa.array(trust, pa.int64()), pa.array(tokens, pa.list_(pa.string()))], ["g", "field", "trust", "tokens"])


def consensus(members: DataFrame, group: str, fields: list[Field]) -> DataFrame:
    """The voted value of every field of every group: rows ``(g, field, trust, tokens)``.

    Groups are those with a non-null ``group`` (bigint). Unknown values do not vote; a field nobody knows has
    trust 0 and no tokens. Equal values vote together; ties go to the smaller token. An empty table gives none.
    """
    said = F.array(*[F.struct(F.lit(f.name).alias("field"), f.vote().alias("v")) for f in fields])
    rows = members.filter(F.col(group).isNotNull()).select(F.col(group).cast("bigint").alias("g"), F.explode(said).alias("s")).select("g", "s.field", "s.v.*")
    counted = rows.groupBy("g", "field", "trust", "tokens").agg(F.sum("weight").alias("weight"))
    trusts = F.map_from_arrays(F.array_distinct("tokens"), F.transform(F.array_distinct("tokens"), lambda t: F.col("trust")))
    votes = counted.select("g", "field", "weight", F.transform("tokens", lambda t: F.create_map(t, F.col("weight"))).alias("profile"), trusts.alias("trusts"), F.pmod(F.hash("tokens"), F.lit(SALTS)).alias("salt"))
    order = ["g", "field", F.col("weight").desc(), F.col("profile").cast("string")]
    parts = votes.repartition("g", "field", "salt").sortWithinPartitions("salt", *order).drop("salt").mapInArrow(_profiles, _PARTIAL_DDL)
    return parts.repartition("g", "field").sortWithinPartitions(*order).mapInArrow(_elected, "g bigint, field string, trust bigint, tokens array<string>")


def survivors(members: DataFrame, group: str, item: str, fields: list[Field]) -> DataFrame:
    """The member closest to its group's consensus: rows ``(g, id, distance)``, one per group.

    A field's distance is the share by which the member's trust falls short of that of the voted value. Ties go to
    the larger sum of trust, then to the tokens more like the voted ones, then to the smaller id; a member that is
    worse than no other in any field therefore always survives, whatever the weights. Null groups and null ids take
    no part; repeated rows count once; other columns may have any name.
    """
    own = members.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).cast("bigint").alias("g"), F.col(item).alias("id"), *[f.vote().alias(f"f{i}") for i, f in enumerate(fields)]).distinct()
    plain = [Field(f.name, F.col(f"f{i}.trust"), F.col(f"f{i}.tokens"), F.col(f"f{i}.weight")) for i, f in enumerate(fields)]
    agreed = consensus(own, "g", plain).groupBy("g").agg(*[F.max(F.when(F.col("field") == f.name, F.struct("trust", "tokens"))).alias(f"c{i}") for i, f in enumerate(fields)])

    def short(i: int) -> Column:
        a, c = F.col(f"f{i}.trust"), F.col(f"c{i}.trust")
        return F.when(a < c, 1 - a / c).otherwise(0.0)

    def unlike(i: int) -> Column:
        a, c = F.col(f"f{i}.tokens"), F.col(f"c{i}.tokens")
        return 1 - F.coalesce(F.size(F.array_intersect(a, c)) / F.greatest(F.size(a), F.size(c), F.lit(1)), F.lit(0.0))

    add = lambda each: sum((each(i) for i in range(1, len(fields))), each(0)) if fields else F.lit(0.0)
    costs = own.join(agreed, "g").select("g", "id", add(short).alias("distance"), (-add(lambda i: F.col(f"f{i}.trust"))).alias("less"), add(unlike).alias("unlike"))
    picked = costs.groupBy("g").agg(F.min(F.struct("distance", "less", "unlike", "id")).alias("s"))
    return picked.select("g", "s.id", "s.distance")


#: The release types that count as known.
KNOWN_TYPES = ("album", "single", "compilation", "soundtrack")


def library_fields() -> list[Field]:
    """The four fields by which copies of a recording are judged, as columns of ``files``."""
    kbit = F.when(F.col("bitrate") > 20000, F.round(F.col("bitrate") / 1000)).otherwise(F.col("bitrate")).cast("bigint")
    kbit = F.when((kbit > 0) & (kbit <= 20000), kbit)
    score = F.when(F.col("meta_score").between(0, 6), F.col("meta_score") + 1)
    year = F.when(F.col("album_year").between(1900, 2026), F.col("album_year"))
    kind = F.lower(F.trim("release_type"))
    kind = F.when(kind.isin(*KNOWN_TYPES), kind)
    one = lambda c: F.array(c.cast("string"))
    complete = F.coalesce(score, F.lit(1))
    return [
        Field("bitrate", kbit, one(kbit)),
        Field("meta_score", score, one(score - 1)),
        Field("album_year", F.when(year.isNotNull(), 1), one(year), complete),
        Field("release_type", F.when(kind.isNotNull(), 1), one(kind), complete),
    ]


def _live(spark: SparkSession, sf_dir: str, fields: list[Field], *more: str) -> DataFrame:
    """Live members of known groups, each once, with the votes of their fields."""
    files = table(spark, sf_dir, "files").filter("NOT deleted").select(F.col("id").alias("file_id"), *[f.vote().alias(f.name) for f in fields], *more).dropDuplicates(["file_id"])
    groups = table(spark, sf_dir, "dup_groups").select("group_id").distinct()
    tracks = table(spark, sf_dir, "group_tracks").select("group_id", "file_id").filter("group_id IS NOT NULL AND file_id IS NOT NULL").distinct()
    return tracks.join(groups, "group_id", "left_semi").join(files, "file_id")


def _voted(fields: list[Field]) -> list[Field]:
    """The same fields as columns of ``_live``."""
    return [Field(f.name, F.col(f"{f.name}.trust"), F.col(f"{f.name}.tokens"), F.col(f"{f.name}.weight")) for f in fields]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: the member closest to its group's consensus, where it beats every other live member."""
    fields = library_fields()
    names = [f.name for f in fields]
    live = Stored(_live(spark, sf_dir, fields)).df
    picked = survivors(live, "group_id", "file_id", _voted(fields)).select(F.col("g").alias("group_id"), F.col("id").alias("file_id"))
    # The exact check of the pick: every other member is worse in some field and better in none.
    trust = live.select("group_id", "file_id", *[F.col(f"{x}.trust").alias(x) for x in names])
    chosen = picked.join(trust, ["group_id", "file_id"]).select("group_id", F.col("file_id").alias("pick"), *[F.col(x).alias(f"pick_{x}") for x in names])
    others = trust.join(chosen, "group_id").filter("file_id <> pick")
    beaten = F.expr(" AND ".join(f"pick_{x} >= {x}" for x in names)) & F.expr(" OR ".join(f"pick_{x} > {x}" for x in names))
    return others.groupBy("group_id").agg(F.min("pick").alias("file_id"), F.bool_and(beaten).alias("beaten")).filter("beaten").select("group_id", "file_id")


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_built: the record built from the voted values of each group with a live member."""
    fields = library_fields()
    agreed = consensus(_live(spark, sf_dir, fields), "group_id", _voted(fields))
    of = lambda name, kind: F.max(F.when(F.col("field") == name, F.get("tokens", F.lit(0)))).cast(kind).alias(name)
    return agreed.groupBy(F.col("g").alias("group_id")).agg(of("bitrate", "bigint"), of("meta_score", "bigint"), of("album_year", "bigint"), of("release_type", "string"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_titles: of each group with a live member the stored title closest to the title voted word by word, and whose it is."""
    words = F.filter(F.split(F.trim(F.coalesce("title", F.lit(""))), r"\s+"), lambda w: w != "")
    field = Field("words", F.when(F.size(words) > 0, 1), words, F.when(F.col("meta_score").between(0, 6), F.col("meta_score") + 1))
    live = Stored(_live(spark, sf_dir, [field], "title")).df
    picked = survivors(live, "group_id", "file_id", _voted([field]))
    return picked.join(live, (F.col("g") == F.col("group_id")) & (F.col("id") == F.col("file_id"))).select("group_id", "file_id", "title")


_JUDGED = """
WITH f AS (
  SELECT DISTINCT id AS file_id,
    CASE WHEN bitrate > 20000 THEN round(bitrate / 1000)::BIGINT ELSE bitrate END AS kbit,
    CASE WHEN meta_score BETWEEN 0 AND 6 THEN meta_score END AS score,
    CASE WHEN album_year BETWEEN 1900 AND 2026 THEN album_year END AS album_year,
    CASE WHEN lower(trim(release_type)) IN ('album', 'single', 'compilation', 'soundtrack') THEN lower(trim(release_type)) END AS kind
  FROM files WHERE NOT deleted),
v AS (
  SELECT DISTINCT t.group_id, t.file_id, CASE WHEN kbit > 0 AND kbit <= 20000 THEN kbit END AS bitrate, score, album_year, kind
  FROM group_tracks t JOIN f ON f.file_id = t.file_id WHERE t.group_id IN (SELECT group_id FROM dup_groups)),
m AS (SELECT *, coalesce(bitrate, 0) AS a, coalesce(score, -1) AS b, (album_year IS NOT NULL)::INT AS c, (kind IS NOT NULL)::INT AS d FROM v)
"""

_VOTED = lambda name, value, weight: f"{name} AS (SELECT group_id, first(x ORDER BY w DESC, x::VARCHAR) AS x FROM (SELECT group_id, {value} AS x, sum({weight}) AS w FROM m WHERE {value} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"

QUERIES = {"p1_found": found, "p1_built": built, "p1_titles": titles}
ORACLES = {
    "p1_found": _JUDGED
    + """SELECT x.group_id, x.file_id FROM m x JOIN m y ON x.group_id = y.group_id AND x.file_id <> y.file_id
GROUP BY x.group_id, x.file_id HAVING bool_and(x.a >= y.a AND x.b >= y.b AND x.c >= y.c AND x.d >= y.d AND (x.a > y.a OR x.b > y.b OR x.c > y.c OR x.d > y.d))""",
    "p1_built": _JUDGED
    + ", "
    + ", ".join([_VOTED("b1", "bitrate", "bitrate * bitrate"), _VOTED("s1", "score", "(score + 1) * (score + 1)"), _VOTED("y1", "album_year", "coalesce(score + 1, 1)"), _VOTED("k1", "kind", "coalesce(score + 1, 1)")])
    + """
SELECT m.group_id, any_value(b1.x)::BIGINT AS bitrate, any_value(s1.x)::BIGINT AS meta_score, any_value(y1.x)::BIGINT AS album_year, any_value(k1.x) AS release_type
FROM m LEFT JOIN b1 ON b1.group_id = m.group_id LEFT JOIN s1 ON s1.group_id = m.group_id LEFT JOIN y1 ON y1.group_id = m.group_id LEFT JOIN k1 ON k1.group_id = m.group_id GROUP BY m.group_id""",
}
