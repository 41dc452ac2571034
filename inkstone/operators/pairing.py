"""Pairs within groups of any size, and the groups that links form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.session import materialize


def pairs_within(members: DataFrame, group: list[str], key: str, rows_per_salt: int = 2_000, differ: list[str] | None = None) -> DataFrame:
    """(``a``, ``b``, group columns) for every two members of a group with ``a < b``.

    Groups of one never meet the join. A group of n rows is cut into n / rows_per_salt slices on one side and copied
    that often on the other, so no task holds all its pairs. With ``differ`` only members that differ in one of
    these columns make a pair, and groups in which none differ are left out beforehand.
    """
    differ = differ or []
    stats = [F.count("*").alias("_n"), *[e for i, c in enumerate(differ) for e in (F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"))]]
    sizes = members.groupBy(*group).agg(*stats).where("_n > 1")
    if differ:
        sizes = sizes.where(" OR ".join(f"NOT (_lo{i} <=> _hi{i})" for i in range(len(differ))))
    sizes = sizes.select(*group, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts"))
    kept = members.select(*group, key, *differ).join(sizes, group)
    left = kept.withColumn("_salt", F.pmod(F.xxhash64(key), F.col("_salts")).cast("int")).alias("l")
    right = kept.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*group, "_salt")]
    on.append(F.col(f"l.{key}") < F.col(f"r.{key}"))
    if differ:
        unlike: Column = F.lit(False)
        for c in differ:
            unlike = unlike | (~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")))
        on.append(unlike)
    return left.join(right, on).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), *[F.col(f"l.{c}").alias(c) for c in group])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(``id``, ``component``) of every key in undirected links (``a``, ``b``); a component is named by its least key.

    Keys take the least label of their neighbours, then the label of their label, until nothing changes; each
    round is written to the shared folder. The number of rounds grows with the logarithm of the longest chain.
    """
    both = materialize(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        roots = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        step = materialize(step.join(roots, "component", "left").select("id", "old", F.least("component", F.coalesce("root", "component")).alias("component")), "labels")
        labels = step.select("id", "component")
        if step.where("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
