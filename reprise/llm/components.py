"""Consolidating pairwise matches into groups by hash-to-min.

Every vertex holds a cluster, kept as rows ``(v, u)`` and never as one list, so the cluster of a vertex that
is linked to a third of all others is spread over many tasks. In a round each vertex sends its cluster to the
cluster's minimum and that minimum to every member; when a round changes nothing, the minimum of a component
holds all of it and every other vertex holds the minimum alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of the undirected graph ``edges(a, b)``: one row ``(id, root_id)`` per linked vertex.

    ``root_id`` is the smallest id of the component. Edges with a null end, self loops and repeated edges link
    nothing new; a vertex without any other neighbour gives no row; no edges give an empty result. Further
    columns of ``edges`` are ignored, whatever their names.
    """
    pairs = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).filter("v IS NOT NULL AND u IS NOT NULL AND v <> u")
    both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
    seen = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x"))
    state = Stored(both.unionByName(both.select("v", F.col("v").alias("u"))).distinct(), *seen)
    while True:
        # Stored first: both sides of the join then stand right behind their shuffles, so that adaptive execution can
        # split the cluster of a hot vertex, which meets a single row.
        least = Stored(state.df.groupBy("v").agg(F.min("u").alias("m")))
        sent = state.df.join(least.df, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("s")
        )
        after = Stored(sent.select("s.v", "s.u").distinct(), *seen)
        least.drop()
        stable = (after.seen["n"], after.seen["x"]) == (state.seen["n"], state.seen["x"])
        state.drop()
        state = after
        if stable:
            return state.df.groupBy("v").agg(F.min("u").alias("root_id")).select(F.col("v").alias("id"), "root_id")


def group_links(members: DataFrame, group: str, item: str) -> DataFrame:
    """Links ``(a, b)`` from the smallest member of each group to its others: a star, not all pairs."""
    own = members.select(F.col(group).alias("g"), F.col(item).alias("b")).filter("g IS NOT NULL AND b IS NOT NULL").distinct()
    return own.join(own.groupBy("g").agg(F.min("b").alias("a")), "g").filter("a <> b").select("a", "b")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "group_tracks").select("group_id", "file_id")
    return tracks.join(table(spark, sf_dir, "dup_groups").select("group_id").distinct(), "group_id", "left_semi")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: every file linked to another, with the smallest id of all it is linked to."""
    linked = connected_components(group_links(_members(spark, sf_dir), "group_id", "file_id"))
    return linked.select(F.col("id").alias("file_id"), "root_id")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_merged: per merged group its numbers of files and of source groups, and the union of the tags."""
    members = _members(spark, sf_dir).filter("file_id IS NOT NULL AND group_id IS NOT NULL").distinct()
    roots = Stored(found(spark, sf_dir)).df
    of = members.join(roots, "file_id").select("root_id", "group_id", "file_id")
    tags = (
        of.select("root_id", "group_id").distinct()
        .join(table(spark, sf_dir, "dup_groups").select("group_id", F.explode("group_tags").alias("tag")).distinct(), "group_id")
        .filter("tag IS NOT NULL").select("root_id", "tag").distinct()
        .groupBy("root_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    )
    files = of.select("root_id", "file_id").distinct().groupBy("root_id").agg(F.count(F.lit(1)).alias("n_files"))
    groups = of.select("root_id", "group_id").distinct().groupBy("root_id").agg(F.count(F.lit(1)).alias("n_groups"))
    return files.join(groups, "root_id").join(tags, "root_id", "left").select("root_id", "n_files", "n_groups", F.coalesce("tags", F.lit("")).alias("tags"))


_LINKED = """
WITH RECURSIVE m AS (
  SELECT DISTINCT group_id, file_id FROM group_tracks
  WHERE file_id IS NOT NULL AND group_id IN (SELECT group_id FROM dup_groups)),
e AS (SELECT DISTINCT x.file_id AS a, y.file_id AS b FROM m x JOIN m y ON x.group_id = y.group_id AND x.file_id <> y.file_id),
r AS (SELECT a AS id, a AS reach FROM e UNION SELECT e.b, r.reach FROM r JOIN e ON e.a = r.id),
roots AS (SELECT id AS file_id, min(reach) AS root_id FROM r GROUP BY id)
"""

QUERIES = {"p4_found": found, "p4_merged": merged}
ORACLES = {
    "p4_found": _LINKED + "SELECT file_id, root_id FROM roots",
    "p4_merged": _LINKED
    + """, o AS (SELECT DISTINCT root_id, group_id, m.file_id FROM m JOIN roots ON roots.file_id = m.file_id),
t AS (SELECT root_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM
  (SELECT DISTINCT root_id, tag FROM o JOIN (SELECT DISTINCT group_id, unnest(group_tags) AS tag FROM dup_groups) g ON g.group_id = o.group_id
   WHERE tag IS NOT NULL) GROUP BY root_id)
SELECT o.root_id, count(DISTINCT o.file_id) AS n_files, count(DISTINCT o.group_id) AS n_groups, coalesce(any_value(t.tags), '') AS tags
FROM o LEFT JOIN t ON t.root_id = o.root_id GROUP BY o.root_id""",
}
