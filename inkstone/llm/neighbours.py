"""Most similar vectors for every vector (problem 7).

Vectors are brought to unit length, where a larger cosine is a smaller Euclidean distance. A vantage-point tree over
a bounded sample cuts space into shards of nearly equal size; every vector belongs to one shard, and each shard has a
vantage-point tree of its own. A query first searches its own shard. The distance to its k-th best then decides by
the triangle inequality which other shards, and inside them which branches, may hold something nearer. The radius of
that test is multiplied by ``relax``: one is exact search, smaller prunes more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.session import hash_limit, materialize

LEAF = 256


@dataclass
class Node:
    """An inner node has a vantage point, a radius and two branches; a leaf has rows or the number of a shard."""

    vantage: np.ndarray | None = None
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None
    rows: np.ndarray | None = None
    shard: int = -1


def _distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points @ vantage)))


def _split(points: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
    """The vantage point, of eight tried, whose distances spread most; None where no point divides the rows."""
    tried = rng.choice(rows, min(8, len(rows)), replace=False)
    probe = points[rng.choice(rows, min(512, len(rows)), replace=False)]
    spread = [float(np.std(_distances(probe, points[t]))) for t in tried]
    vantage = points[tried[int(np.argmax(spread))]]
    d = _distances(points[rows], vantage)
    radius = float(np.median(d))
    inside = d <= radius
    return None if inside.all() else (vantage, radius, inside)


def build(points: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> Node:
    if len(rows) <= leaf or (cut := _split(points, rows, rng)) is None:
        return Node(rows=rows)
    vantage, radius, inside = cut
    return Node(vantage, radius, build(points, rows[inside], leaf, rng), build(points, rows[~inside], leaf, rng))


def routing_tree(sample: np.ndarray, depth: int, seed: int = 7) -> tuple[Node, int]:
    """A tree of at most ``2 ** depth`` shards from a sample, and their number."""
    rng, count = np.random.default_rng(seed), 0

    def grow(rows: np.ndarray, left: int) -> Node:
        nonlocal count
        if left and len(rows) > 4 and (cut := _split(sample, rows, rng)):
            return Node(cut[0], cut[1], grow(rows[cut[2]], left - 1), grow(rows[~cut[2]], left - 1))
        count += 1
        return Node(shard=count - 1)

    return grow(np.arange(len(sample)), depth), count


def route(node: Node, points: np.ndarray, reach: np.ndarray | None = None) -> list[tuple[np.ndarray, int]]:
    """(rows, shard): the shard of each point, or with ``reach`` every shard its ball of that radius may touch."""
    out, stack = [], [(node, np.arange(len(points)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node.vantage is None:
            out.append((rows, node.shard))
            continue
        d = _distances(points[rows], node.vantage)
        r = 0.0 if reach is None else reach[rows]
        stack.append((node.inside, rows[d - r <= node.radius]))
        stack.append((node.outside, rows[d + r > node.radius]))
    return out


class Search:
    """Best ``k`` of a shard for a batch of queries, in one walk of the tree."""

    def __init__(self, points: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray, relax: float, own: np.ndarray | None):
        self.points, self.queries, self.k, self.relax, self.own = points, queries, k, relax, own
        self.score = np.full((len(queries), k), -2.0, "f4")
        self.found = np.full((len(queries), k), -1, "i8")
        self.least = least.astype("f4")  # no result below this cosine is wanted

    def bound(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.least[rows], self.score[rows, -1])

    def leaf(self, node: Node, rows: np.ndarray) -> None:
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            s = self.queries[part] @ self.points[node.rows].T
            if self.own is not None:
                s[self.own[part][:, None] == node.rows[None, :]] = -2.0
            hit = s.max(axis=1) >= self.bound(part)
            if not hit.any():
                continue
            part, s = part[hit], s[hit]
            s[s < self.least[part][:, None]] = -2.0
            score = np.hstack([self.score[part], s])
            found = np.hstack([self.found[part], np.broadcast_to(node.rows, s.shape)])
            best = np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
            score = np.take_along_axis(score, best, 1)
            order = np.argsort(-score, axis=1, kind="stable")
            self.score[part] = np.take_along_axis(score, order, 1)
            self.found[part] = np.take_along_axis(np.take_along_axis(found, best, 1), order, 1)

    def walk(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.rows is not None:
            self.leaf(node, rows)
            return
        d = _distances(self.queries[rows], node.vantage)
        near = d <= node.radius
        self.walk(node.inside, rows[near])
        self.walk(node.outside, rows[~near])
        reach = self.relax * np.sqrt(np.maximum(0.0, 2.0 - 2.0 * self.bound(rows)))
        self.walk(node.outside, rows[near & (d + reach > node.radius)])
        self.walk(node.inside, rows[~near & (d - reach <= node.radius)])


def _nothing(*columns: str) -> pd.DataFrame:
    kinds = {"cosine": "f4", "reach": "f4", "shard": "i4"}
    return pd.DataFrame({c: pd.Series([], dtype=kinds.get(c, object)) for c in columns})


def _matrix(column: pd.Series, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "f4").reshape(-1, dimension)


def _unit_vectors(dimension: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = np.array(batch["v"].tolist(), "f8").reshape(-1, dimension)
            with np.errstate(all="ignore"):
                norm = np.linalg.norm(m, axis=1)
                m = (m / norm[:, None]).astype("f4")
            ok = np.isfinite(m).all(axis=1) & (norm > 0)
            yield pd.DataFrame({"id": batch["id"][ok], "vec": [x.tobytes() for x in m[ok]]})

    return f


def usable_vectors(df: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """(``id``, ``vec``): one unit vector of 32-bit floats per key.

    Null keys and vectors, wrong lengths, null elements, infinite values and all-zero vectors are left aside. Repeated
    rows count once; of several vectors of a key the least (element by element) holds.
    """
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull())).groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("v"))
    return rows.mapInPandas(_unit_vectors(dimension), f"id {dict(df.dtypes)[key]}, vec binary")


def _sliced(df: DataFrame, shard: str, counts: dict[int, int], name: str, spread: bool) -> DataFrame:
    """Adds the slice ``name`` of each row's shard, of which there are ``counts`` (1 where not given): one by the row's
    hash, or with ``spread`` all of them, a row each. Counts are broadcast: there are no more than shards, which
    ``max_sample`` bounds."""
    if max(counts.values(), default=1) == 1:
        return df.withColumn(name, F.lit(0))
    sizes = df.sparkSession.createDataFrame([(int(s), int(n)) for s, n in counts.items() if n > 1], f"{shard} int, _slices int")
    n = F.coalesce("_slices", F.lit(1))
    slices = F.explode(F.sequence(F.lit(0), n - 1)) if spread else F.pmod(F.xxhash64("id", F.lit(name)), n).cast("int")
    return df.join(F.broadcast(sizes), shard, "left").withColumn(name, slices).drop("_slices")


def nearest(vectors: DataFrame, dimension: int, k: int = 5, min_cosine: float = -1.0, relax: float = 1.0, queries: DataFrame | None = None, rows_per_shard: int | None = None, sample_per_shard: int = 64, max_sample: int = 200_000, queries_per_task: int = 60_000) -> DataFrame:
    """(``q``, ``n``, ``cosine``): up to ``k`` most similar other vectors of each, none under ``min_cosine``.

    Takes (``id``, ``vec``) and, where only some are asked for, the queries' ``id``. Equal cosines go by the smaller id.
    Keys with the very same vector are searched once and expanded; of such a group each member sees the others with
    the least ids. Shards hold a sixteenth of the vectors, but 12,000 to 50,000, unless ``rows_per_shard`` is given: a query
    reaches fewer of large ones, and inside them its tree prunes. The routing tree is made from ``sample_per_shard`` vectors per shard, at most ``max_sample`` in all.
    A shard of over four times ``rows_per_shard``, as there are where that bound holds or space can't be divided, is cut
    into slices with a tree each, all of which its queries search; queries of a shard come in slices of
    ``queries_per_task``. So a task's work is bounded at any size, and a shard is copied once a slice of its queries.
    """
    spark = vectors.sparkSession
    id_type = dict(vectors.dtypes)["id"]
    all_rows = materialize(vectors.select("id", "vec").withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}), "vectors")
    # Of keys with the same vector the least k + 1 are kept; each task cuts its own part of a group to that first.
    first = Window.partitionBy("h1", "h2").orderBy("id")
    listed = materialize(all_rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("id", F.when(F.col("r") == 1, F.col("vec")).alias("vec"), "h1", "h2", "r"), "same-vectors")
    unique = listed.where("r = 1").select("id", "vec")
    heads = listed.where("r = 1").select("h1", "h2", F.col("id").alias("rep"))
    listed_ids = listed.select("id", "h1", "h2").join(heads, ["h1", "h2"]).select("id", "rep")
    wanted = all_rows.select("id", "h1", "h2") if queries is None else all_rows.select("id", "h1", "h2").join(queries.select("id").distinct(), "id", "left_semi")
    membership = wanted.join(heads, ["h1", "h2"]).select("id", "rep")
    total = unique.count()
    rows_per_shard = rows_per_shard or min(50_000, max(12_000, total // 16))
    depth = max(0, min(math.ceil(math.log2(max(1, total / rows_per_shard))), math.floor(math.log2(max_sample / 8))))
    most = min(max_sample, sample_per_shard * 2**depth)
    share = min(1.0, 1.5 * most / max(1, total))
    h = F.xxhash64(F.lit(2), "vec")
    picked = unique.where(h <= hash_limit(share)).select("vec", h.alias("h")).orderBy("h").limit(most).collect() if total and depth else []
    sample = np.frombuffer(b"".join(bytes(r["vec"]) for r in picked), "f4").reshape(-1, dimension)
    tree, _ = routing_tree(sample, depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = _matrix(batch["vec"], dimension)
            shard = np.zeros(len(m), "i4")
            for rows, s in route(tree, m):
                shard[rows] = s
            yield batch.assign(shard=shard)

    placed = materialize(unique.mapInPandas(place, f"id {id_type}, vec binary, shard int"), "shards")
    asked = placed if queries is None else placed.join(membership.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    sizes = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    cuts = {s: math.ceil(n / (4 * rows_per_shard)) for s, n in sizes.items()}
    rounds = {s: math.ceil(n / max(queries_per_task, 4 * rows_per_shard)) for s, n in sizes.items()}
    at = ["shard", "part", "turn"]

    def results(ids: np.ndarray, names: np.ndarray, s: Search) -> pd.DataFrame:
        q, j = np.nonzero((s.found >= 0) & (s.score > -1.5))
        return pd.DataFrame({"q": ids[q], "n": names[s.found[q, j]], "cosine": s.score[q, j]})

    def own_shard(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right) or not len(left):
            return _nothing("q", "n", "cosine", "reach", "vec", "shard")
        points, ids = _matrix(left["vec"], dimension), left["id"].to_numpy()
        asked_ids = right["id"].to_numpy()
        position = pd.Series(np.arange(len(ids)), index=ids).reindex(asked_ids).to_numpy()
        inside = ~np.isnan(position)  # the others lie in another slice of the shard
        own = np.where(inside, position, -1).astype("i8")
        wanted = points[own] if inside.all() else _matrix(right["vec"], dimension)
        s = Search(points, wanted, k, np.full(len(own), min_cosine), relax, own)
        s.walk(build(points, np.arange(len(points)), LEAF, np.random.default_rng(11)), np.arange(len(own)))
        out = results(asked_ids, ids, s)
        reach = pd.DataFrame({"q": asked_ids, "n": asked_ids, "cosine": np.float32(2), "reach": s.bound(np.arange(len(own))), "vec": [x.tobytes() for x in wanted], "shard": right["shard"].to_numpy("i4")})
        return pd.concat([out.assign(reach=np.float32(np.nan), vec=None, shard=np.int32(-1)), reach], ignore_index=True)

    data = _sliced(_sliced(placed, "shard", cuts, "part", False), "shard", rounds, "turn", True)
    # Where shards aren't cut a query's vector is among the points; only its id is sent.
    plain = max(cuts.values(), default=1) == 1
    own = asked.select("id", F.lit(None).cast("binary").alias("vec") if plain else F.col("vec"), "shard")
    own = _sliced(_sliced(own, "shard", cuts, "part", True), "shard", rounds, "turn", False)
    own = own.select(*[F.col(c).alias(c) for c in ("id", "vec", *at)])  # columns of its own, though both sides are one table
    first_pass = materialize(data.groupBy(*at).cogroup(own.groupBy(*at)).applyInPandas(own_shard, f"q {id_type}, n {id_type}, cosine float, reach float, vec binary, shard int"), "own-shard")
    found = first_pass.where("cosine < 2").select("q", "n", "cosine")
    if len(sizes) > 1:
        todo = first_pass.where("cosine = 2").select(F.col("q").alias("id"), "vec", "shard", "reach")
        if not plain:
            todo = todo.groupBy("id").agg(F.first("vec").alias("vec"), F.first("shard").alias("shard"), F.max("reach").alias("reach"))

        def reached(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, int]]:
            m, own = _matrix(batch["vec"], dimension), batch["shard"].to_numpy()
            r = relax * np.sqrt(np.maximum(0.0, 2.0 - 2.0 * batch["reach"].to_numpy()))
            for rows, s in route(tree, m, r):
                yield rows[own[rows] != s], s

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals: dict[int, int] = {}
            for batch in batches:
                for rows, s in reached(batch):
                    totals[s] = totals.get(s, 0) + len(rows)
            yield pd.DataFrame({"shard": np.array(list(totals), "i4"), "n": np.array(list(totals.values()), "i8")})

        def reach_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for rows, s in reached(batch):
                    for a in range(0, len(rows), 5_000):
                        yield batch.iloc[rows[a : a + 5_000]].assign(shard=np.int32(s))[["id", "vec", "reach", "shard"]]

        def other_shard(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return _nothing("q", "n", "cosine")
            points = _matrix(left["vec"], dimension)
            s = Search(points, _matrix(right["vec"], dimension), k, right["reach"].to_numpy(), relax, None)
            s.walk(build(points, np.arange(len(points)), LEAF, np.random.default_rng(11)), np.arange(len(right)))
            return results(right["id"].to_numpy(), left["id"].to_numpy(), s)

        loads = {r["shard"]: r["n"] for r in todo.mapInPandas(count, "shard int, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        rounds = {s: math.ceil(n / queries_per_task) for s, n in loads.items() if n}
        routed = todo.mapInPandas(reach_out, f"id {id_type}, vec binary, reach float, shard int")
        routed = _sliced(_sliced(routed, "shard", cuts, "part", True), "shard", rounds, "turn", False)
        data = _sliced(_sliced(placed, "shard", cuts, "part", False), "shard", rounds, "turn", True)
        more = data.groupBy(*at).cogroup(routed.groupBy(*at)).applyInPandas(other_shard, f"q {id_type}, n {id_type}, cosine float")
        found = found.unionByName(more)
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "n")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select(F.col("q").alias("rep"), F.col("n").alias("other"), "cosine")
    groups = listed_ids.select(F.col("rep").alias("other"), F.col("id").alias("n"))
    same = listed_ids.select("rep", F.col("rep").alias("other"), F.lit(1.0).cast("float").alias("cosine")).distinct()
    wide = top.unionByName(same).join(groups, "other").select("rep", "n", "cosine")
    each = membership.join(wide, "rep").where("id <> n").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "n")))
    return each.where(F.col("r") <= k).select(F.col("id").alias("q"), "n", F.col("cosine").cast("double").alias("cosine"))
