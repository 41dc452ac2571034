"""Filling fixed-capacity containers with items (problem 8).

Hierarchical residual packing: each partition packs its items best-fit by falling size and emits the containers that
are nearly full, or that no container left anywhere could be added to. The others go on as items to a smaller number
of partitions, which do the same, until what is left fits one partition or nothing more can be joined.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import materialize

BIN = "shard int, bin string, used int, done boolean, members array<struct<item:string,room:int>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items of each container: largest first, each into the fullest container that still takes it.

    Containers are kept by the room left; a bit set of the rooms in use finds the smallest one that is large enough.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


def _round(step: int, capacity: int, floor: int):
    """Packs one partition's items; a container that reaches ``floor`` is done."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable").reset_index(drop=True)
        used, members = pdf["used"].tolist(), pdf["members"].tolist()
        shard, rows = int(pdf["shard"][0]), []
        for n, found in enumerate(best_fit(used, capacity)):
            fill = sum(used[i] for i in found)
            rows.append((shard, f"{step}-{shard}-{n}", fill, fill >= floor, [m for i in found for m in members[i]]))
        return pd.DataFrame(rows, columns=["shard", "bin", "used", "done", "members"])

    return one


def pack(items: DataFrame, capacity: int, full: float = 0.995, items_per_task: int = 25_000, fan_in: int = 8) -> DataFrame:
    """(``container_id``, ``item``, ``room``, ``fill``) of items (``item`` string, ``room`` int in 1..capacity).

    ``fill`` is the room used of the container. Items outside that range are an error, as they belong in no
    container. The result depends neither on the order of rows nor on the cluster; no task gets more than a bounded
    number of items, as the number of partitions of a round follows the number of items left alone.
    """
    total = items.count()
    if items.where((F.col("room") < 1) | (F.col("room") > capacity) | F.col("room").isNull()).count():
        raise ValueError(f"an item's room must lie in 1..{capacity}")
    shards = max(1, math.ceil(total / items_per_task))
    left = items.select(F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"), F.col("item").alias("bin"), F.col("room").alias("used"), F.array(F.struct(F.col("item"), F.col("room"))).alias("members"))
    done, step = [], 0
    while True:
        packed = materialize(left.groupBy("shard").applyInPandas(_round(step, capacity, math.floor(capacity * full)), BIN), f"packed-{step}")
        done.append(packed.where("done"))
        open_bins = packed.where("NOT done")
        rest = open_bins.agg(F.count("*").alias("n"), F.min("used").alias("least")).first()
        if shards == 1 or not rest["n"] or rest["least"] * 2 > capacity:
            done.append(open_bins)
            break
        # What can't take even the least container left is as full as it gets.
        done.append(open_bins.where(F.col("used") > capacity - rest["least"]))
        shards = max(math.ceil(rest["n"] / items_per_task), math.ceil(shards / fan_in)) if shards > fan_in else 1 if rest["n"] <= items_per_task else math.ceil(rest["n"] / items_per_task)
        left = open_bins.where(F.col("used") <= capacity - rest["least"]).select(F.pmod(F.xxhash64("bin"), F.lit(shards)).cast("int").alias("shard"), "bin", "used", "members")
        step += 1
        if step > 40:
            done.append(open_bins.where(F.col("used") <= capacity - rest["least"]))
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("bin").alias("container_id"), F.col("used").alias("fill"), F.inline("members")).select("container_id", "item", "room", "fill")
