"""What changed between full snapshots (problem 2).

Each snapshot's keys fall into equal hash ranges, the leaves of a tree with a fixed fan-out. A node's digest is made
from its children's, a leaf's from the digests of its rows. Consecutive snapshots are compared from the root down;
only below nodes whose digests differ is the next level looked at, and rows are compared only in differing leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.session import materialize

FANOUT_BITS = 4


def row_digests(columns: list[str]) -> tuple[Column, Column]:
    """Two independent 64-bit digests of the content; null and empty are the same."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def latest_rows(df: DataFrame, snapshot: str, key: str, content: list[str], version: str) -> DataFrame:
    """One row per snapshot and key: (``snap``, ``key``, ``d1``, ``d2``) of the row loaded last.

    Among rows loaded at the same moment the one with the largest digest holds, so the result doesn't depend on
    order; a null load time is older than any other. Rows without a snapshot or key can't be followed and are left out.
    """
    d1, d2 = row_digests(content)
    rows = df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(F.col(snapshot).alias("snap"), F.col(key).alias("key"), F.struct(F.col(version).alias("v"), d1.alias("d1"), d2.alias("d2")).alias("row"))
    last = rows.groupBy("snap", "key").agg(F.max("row").alias("row"))
    return last.select("snap", "key", "row.d1", "row.d2")


def tree_levels(rows_in_snapshot: int, rows_per_leaf: int) -> int:
    """Levels below the root so that leaves hold about ``rows_per_leaf`` rows of a snapshot (at most 60 bits)."""
    return max(1, min(15, math.ceil(math.log2(max(2, rows_in_snapshot / rows_per_leaf)) / FANOUT_BITS)))


def _node(level: int) -> Column:
    """The number of the hash range of a key at a level."""
    return F.shiftrightunsigned(F.xxhash64("key"), 64 - FANOUT_BITS * level) if level else F.lit(0).cast("bigint")


def merkle_levels(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Digests (``ord``, ``node``, ``digest``) of each level, the root first."""
    mixed = F.xxhash64("key", "d1", "d2")
    leaf = rows.groupBy("ord", _node(levels).alias("node")).agg(F.bit_xor(mixed).alias("x"), F.sum(mixed.cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    # Leaves are written once, as every level above and every comparison reads them.
    out = [materialize(leaf.select("ord", "node", F.xxhash64("x", F.col("s").cast("string"), "n").alias("digest")), "leaves")]
    for _ in range(levels):
        below = out[0]
        up = below.groupBy("ord", F.shiftrightunsigned("node", FANOUT_BITS).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("children"))
        out.insert(0, up.select("ord", "node", F.xxhash64(F.to_json("children")).alias("digest")))
    return out


def _differing(level: DataFrame) -> DataFrame:
    """Nodes whose digest differs from the snapshot before; absent on one side counts as different."""
    both = level.select("ord", "node", F.col("digest").alias("now"), F.lit(None).cast("bigint").alias("before")).unionByName(level.select((F.col("ord") + 1).alias("ord"), "node", F.lit(None).cast("bigint").alias("now"), F.col("digest").alias("before")))
    return both.groupBy("ord", "node").agg(F.max("now").alias("now"), F.max("before").alias("before")).where("NOT (now <=> before)").select("ord", "node")


def snapshot_changes(df: DataFrame, snapshot: str, key: str, content: list[str], version: str, rows_per_leaf: int = 64) -> DataFrame:
    """(``snap``, ``key``, ``change_kind``): keys added, removed or changed against the snapshot before.

    The first snapshot gives no rows. An empty table gives no rows. Columns other than those named aren't read.
    """
    state = latest_rows(df, snapshot, key, content, version)
    dates = state.select("snap").distinct().withColumn("ord", F.row_number().over(Window.orderBy("snap")))
    rows = materialize(state.join(dates, "snap").select("ord", "snap", "key", "d1", "d2"), "snapshot-rows")
    sizes = rows.groupBy("ord").count().agg(F.max("count").alias("most"), F.max("ord").alias("last")).first()
    levels, last = tree_levels(sizes["most"] or 1, rows_per_leaf), sizes["last"] or 0
    tree = merkle_levels(rows, levels)
    frontier = _differing(tree[0])
    for level in tree[1:]:
        below = _differing(level).withColumn("parent", F.shiftrightunsigned("node", FANOUT_BITS))
        frontier = below.join(frontier.withColumnRenamed("node", "parent"), ["ord", "parent"], "left_semi").select("ord", "node")
    inside = F.col("ord").between(2, last)
    keyed = rows.withColumn("node", _node(levels))
    now = keyed.select("ord", "node", "key", F.struct("d1", "d2").alias("now"), F.lit(None).cast("struct<d1:bigint,d2:bigint>").alias("before"))
    before = keyed.select((F.col("ord") + 1).alias("ord"), "node", "key", F.lit(None).cast("struct<d1:bigint,d2:bigint>").alias("now"), F.struct("d1", "d2").alias("before"))
    meet = now.unionByName(before).where(inside).join(frontier.where(inside), ["ord", "node"], "left_semi")
    sides = meet.groupBy("ord", "key").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    changes = sides.select("ord", "key", kind.alias("change_kind")).where("change_kind IS NOT NULL")
    return changes.join(rows.select("ord", "snap").distinct(), "ord").select("snap", "key", "change_kind")
