"""Incremental refresh: what a new chunk set changes, merged vectors, fingerprints of chunk sets."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T


def chunk_plan(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(``chunk_id``, ``action``): ``embed`` where no stored digest equals the new one, else ``reuse``; ``drop`` for ids
    that are gone. Takes (``chunk_id``, ``digest``) twice; a null stored digest equals nothing."""
    new = chunks.select("chunk_id", F.col("digest").alias("new"), F.lit(True).alias("here"))
    old = stored.select("chunk_id", F.col("digest").alias("old"), F.lit(True).alias("there"))
    action = F.when(F.col("here").isNull(), "drop").when(F.col("there").isNotNull() & (F.col("new") == F.col("old")), "reuse").otherwise("embed")
    return new.join(old, "chunk_id", "full").select("chunk_id", action.alias("action"))


def notice_plan(new: DataFrame, old: DataFrame) -> DataFrame:
    """(``notice_num``, ``action``): added, deleted, updated or same. Takes (``notice_num``, ``fingerprint``) twice."""
    n = new.select("notice_num", F.col("fingerprint").alias("new"), F.lit(True).alias("here"))
    o = old.select("notice_num", F.col("fingerprint").alias("old"), F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(F.col("new").eqNullSafe(F.col("old")), "same").otherwise("updated")
    return n.join(o, "notice_num", "full").select("notice_num", action.alias("action"))


def refuses_shrink(deleted: Column, before: Column) -> Column:
    """True for a plan that would delete more than 100 notices and more than a fifth of them."""
    return (deleted > 100) & (deleted * 5 > before)


def merge_vectors(plan: DataFrame, fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(``chunk_id``, ``embedding``) of every chunk that stays: the fresh vector where there is one, else the stored.

    A chunk with neither is an error raised when the result is used.
    """
    kept = plan.where("action <> 'drop'").select("chunk_id", "action")
    joined = kept.join(fresh.select("chunk_id", F.col("embedding").alias("f")), "chunk_id", "left").join(stored.select("chunk_id", F.col("embedding").alias("s")), "chunk_id", "left")
    vector = F.coalesce("f", F.when(F.col("action") == "reuse", F.col("s")))
    checked = F.when(vector.isNotNull(), vector).otherwise(F.raise_error(F.concat(F.lit("no vector for chunk "), F.col("chunk_id"))))
    return joined.select("chunk_id", checked.alias("embedding"))


#: Chunks a leaf of the hash tree holds at most, about; the tree grows a digit deeper where there are more.
CHUNKS_PER_LEAF = 1_024
LEAST_DIGITS = 3


def set_fingerprint(chunks: DataFrame, prefix: int | None = None) -> DataFrame:
    """One digest of all chunks' ids and composed texts, as a hash tree.

    A leaf holds the chunks whose id's SHA-256 starts with the same ``prefix`` hex digits; its digest is over its
    chunks' digests by id, a node's over those of its children, ``LEAST_DIGITS`` levels at a time up to the root. The
    number of digits follows the number of chunks unless given, so no list grows with the collection. Takes (``chunk_id``,
    ``subject``, ``text``); repeated rows count once. Equal sets have equal fingerprints.
    """
    rows = chunks.select("chunk_id", T.digest("chunk_id", "subject", "text").alias("digest"), F.sha2("chunk_id", 256).alias("place")).distinct()
    if prefix is None:
        prefix = max(LEAST_DIGITS, math.ceil(math.log(max(1, chunks.count()) / CHUNKS_PER_LEAF, 16)))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "digest"))), lambda r: r["digest"]), ""), 256).alias("digest")
    level = rows.groupBy(F.substring("place", 1, prefix).alias("node")).agg(joined("chunk_id"), F.count("*").alias("n"))
    for digits in range(prefix - LEAST_DIGITS, 0, -LEAST_DIGITS):
        level = level.groupBy(F.substring("node", 1, digits).alias("up")).agg(joined("node"), F.sum("n").alias("n")).withColumnRenamed("up", "node")
    return level.agg(joined("node").alias("fingerprint"), F.sum("n").alias("chunks"))


def exact_fingerprint(chunks: DataFrame) -> str:
    """SHA-256 over the bytes of all chunks, by id. They are hashed as they come in order, a partition at a time, so the
    driver holds one partition; ``set_fingerprint`` is the value to compare large sets by."""
    rows = chunks.select("chunk_id", F.concat("chunk_id", F.lit("\x00"), T.compose("subject", "text"), F.lit("\n")).alias("line")).distinct().orderBy("chunk_id", "line")
    total = hashlib.sha256()
    for row in rows.select("line").toLocalIterator():
        total.update(row["line"].encode())
    return total.hexdigest()
