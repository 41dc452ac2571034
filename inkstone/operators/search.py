"""Exact vector search, tiers and relevance evidence over sets of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 4_096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: str | Column) -> Column:
    """The vector at length one; the zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    n = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") / n)


def usable(v: str | Column) -> Column:
    """All elements finite and not all of them zero; false for null."""
    v = F.col(v) if isinstance(v, str) else v
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _blocks(df: DataFrame, key: str, vector: str, blocks: int, prefix: str) -> DataFrame:
    """Rows packed into numpy matrices, one row per block of about ``ROWS_PER_BLOCK``."""
    kind = dict(df.dtypes)[key]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["v"].tolist(), "f8")
        length = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(length > 0, length, 1.0)
        return pd.DataFrame({f"{prefix}block": [int(pdf["b"].iloc[0])], f"{prefix}ids": [pdf["id"].tolist()], f"{prefix}m": [m.tobytes()]})

    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    return rows.groupBy("b").applyInPandas(one, f"{prefix}block int, {prefix}ids array<{kind}>, {prefix}m binary")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "id", vector: str = "embedding", digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """(``query_id``, ``hit_id``, ``score``, ``rank``): the k best inner products of unit vectors, ties by id.

    Both sides are packed into blocks of a few thousand rows; every pair of blocks is one matrix product whose
    k best per query are kept, so what is shuffled between the two steps is k rows a query and block.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    nq, nv = (max(1, -(-df.count() // ROWS_PER_BLOCK)) for df in (queries, vectors))
    kinds = dict(queries.dtypes)[key], dict(vectors.dtypes)[key]
    q = _blocks(queries.where(usable(vector)), key, vector, nq, "q").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    v = _blocks(vectors.where(F.col(vector).isNotNull()), key, vector, nv, "v")

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a, b = (np.frombuffer(m, "f8").reshape(len(ids), -1) for m, ids in ((r.qm, r.qids), (r.vm, r.vids)))
                names = np.array(r.vids)
                order = np.argsort(names)
                s = np.round(a @ b[order].T, digits)
                names = names[order]
                if exclude_self:
                    s[np.array(r.qids)[:, None] == names[None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.array(r.qids), best.shape[1]), "hit_id": names[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

    found = q.join(v, F.col("at") == F.col("vblock")).select("qids", "qm", "vids", "vm").mapInPandas(product, f"query_id {kinds[0]}, hit_id {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "hit_id")
    return found.where("score > double('-Infinity')").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantizer(vectors: DataFrame, key: str = "id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """8-bit uniform quantisation: (``id``, ``codes``), and the range of each dimension (``pos``, ``low``, ``span``)."""
    long = vectors.select(F.posexplode(unit(vector)).alias("pos", "x"))
    ranges = long.groupBy("pos").agg(F.min("x").alias("low"), (F.max("x") - F.min("x")).alias("span"))
    by = sorted(ranges.collect(), key=lambda r: r["pos"])  # one row per dimension
    low, span = (F.array(*[F.lit(float(r[c])) for r in by]) for c in ("low", "span"))
    code = F.transform(F.arrays_zip(unit(vector).alias("x"), low.alias("low"), span.alias("span")), lambda z: F.when(z["span"] > 0, F.greatest(F.lit(0), F.least(F.lit(255), F.floor(255 * (z["x"] - z["low"]) / z["span"])))).otherwise(F.lit(0)).cast("int"))
    return vectors.select(F.col(key).alias("id"), code.alias("codes")), vectors.sparkSession.createDataFrame([(r["pos"], float(r["low"]), float(r["span"])) for r in by], "pos int, low double, span double")


def dequantize(coded: DataFrame, ranges: DataFrame) -> DataFrame:
    """(``id``, ``embedding``) at the middle of each code's range."""
    by = sorted(ranges.collect(), key=lambda r: r["pos"])
    low, span = (F.array(*[F.lit(float(r[c])) for r in by]) for c in ("low", "span"))
    return coded.select("id", F.transform(F.arrays_zip(F.col("codes").alias("c"), low.alias("low"), span.alias("span")), lambda z: (z["c"] + 0.5) / 255 * z["span"] + z["low"]).alias("embedding"))


def cosine_tier(score: Column, least: float = 0.25, clear: float = 0.45) -> Column:
    """``clear``, ``weak`` or null; not-a-number gives null."""
    return F.when(F.isnan(score), None).when(score >= clear, "clear").when(score >= least, "weak")


def classify(cosine: Column, z: Column, coverage: Column, least: float = 0.25, clear: float = 0.45) -> Column:
    """``strong``, ``weak`` or ``discard`` by score, score against the background, and share of the query's words.

    Fixed values: the calibrated cutoffs. A null or infinite z is no evidence.
    """
    finite = cosine.isNotNull() & ~F.isnan(cosine) & (F.abs(cosine) < float("inf"))
    has_z = z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))
    zz = F.when(has_z, z).otherwise(F.lit(-1e9))
    strong = (cosine >= max(clear, 0.51)) & (zz >= 5.0) & ((coverage >= 0.35) | ((cosine >= 0.55) & (zz >= 5.5)))
    weak = (cosine >= 0.49) & ((coverage >= 0.35) | ((cosine >= 0.51) & (zz >= 5.5)))
    return F.when(~finite | (cosine < least), "discard").when(strong, "strong").when(weak, "weak").otherwise("discard")


def idf(size: Column, df: Column) -> Column:
    """Weight of a word: at most 5; 3 for words the sample doesn't have."""
    return F.when(F.coalesce(df, F.lit(0)) > 0, F.least(F.lit(5.0), F.log1p((size - df + 0.5) / (df + 0.5)))).otherwise(F.lit(3.0))


def background_z(score: Column, mean: Column, deviation: Column, n: Column) -> Column:
    """Score in deviations from the mean of background scores; null for a background under 32 or without spread."""
    return F.when((n >= 32) & (deviation > 1e-6), (score - mean) / F.greatest(deviation, F.lit(0.03)))


def first_notices(hits: DataFrame, k: int) -> DataFrame:
    """Per query and tier the first k distinct notices by rank; weak ones that are strong already don't count."""
    best = hits.groupBy("query_id", "tier", "notice_num").agg(F.min("rank").alias("rank"))
    strong = best.where("tier = 'strong'").select("query_id", "notice_num")
    kept = best.where("tier = 'strong'").unionByName(best.where("tier = 'weak'").join(strong, ["query_id", "notice_num"], "left_anti").select(*best.columns))
    order = Window.partitionBy("query_id", "tier").orderBy("rank", "notice_num")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "tier", "place", "notice_num")


def widened_window(hits: DataFrame, strong: float, least: float, notices: int) -> DataFrame:
    """(``query_id``, ``window``): the prefix a caller ends with who asks for 3 times the notices wanted and doubles it
    until enough strong notices are there, the prefix isn't full of served hits, or the hits are used up.

    Every prefix is judged at once and the smallest that stops is taken, so there is no loop over queries.
    """
    per = Window.partitionBy("query_id")
    h = hits.withColumn("total", F.count("*").over(per))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: (F.lit(3 * notices) * F.pow(F.lit(2), i)).cast("int"))
    tried = h.select("*", F.explode(F.array_distinct(F.transform(sizes, lambda s: F.least(s, F.col("total").cast("int"))))).alias("window"))
    state = tried.where("rank <= window").groupBy("query_id", "total", "window").agg(F.countDistinct(F.when(F.col("score") >= strong, F.col("notice_num"))).alias("strong"), F.count_if(F.col("score") >= least).alias("served"))
    stops = (F.col("strong") >= notices) | (F.col("served") < F.col("window")) | (F.col("window") >= F.col("total"))
    return state.where(stops).groupBy("query_id").agg(F.min("window").alias("window"))


def replay_windows(hits: DataFrame, topics: DataFrame, policies: dict[str, tuple[float, float]], notices: int) -> DataFrame:
    """(``kind``, ``policy``, ``n``, ``blocked``, ``no_strong``, ``hits``) of policies (least, strong) over all hits (``fixed``)
    and over each policy's own prefix of them (``prefix``). A hit is a query whose topic is among its first ``notices``
    strong notices."""
    both = []
    for policy, (least, strong) in policies.items():
        cut = hits.join(widened_window(hits, strong, least, notices), "query_id").where("rank <= window").drop("window")
        for kind, part in (("fixed", hits), ("prefix", cut)):
            both.append(part.select(F.lit(kind).alias("kind"), F.lit(policy).alias("policy"), "query_id", "notice_num", "rank", (F.col("score") >= least).alias("served"), (F.col("score") >= strong).alias("strong")))
    rows = both[0]
    for more in both[1:]:
        rows = rows.unionByName(more)
    best = rows.groupBy("kind", "policy", "query_id", "notice_num").agg(F.min(F.when(F.col("strong"), F.col("rank"))).alias("first"), F.max("served").alias("served"))
    order = Window.partitionBy("kind", "policy", "query_id").orderBy(F.asc_nulls_last("first"), "notice_num")
    placed = best.withColumn("place", F.row_number().over(order)).join(topics, "query_id")
    hit = (F.col("notice_num") == F.col("topic")) & F.col("first").isNotNull() & (F.col("place") <= notices)
    per = placed.groupBy("kind", "policy", "query_id").agg(F.max("served").alias("served"), F.max(F.col("first").isNotNull()).alias("strong"), F.max(hit).alias("hit"))
    return per.groupBy("kind", "policy").agg(F.count("*").alias("n"), F.count_if(~F.col("served")).alias("blocked"), F.count_if(~F.col("strong")).alias("no_strong"), F.count_if("hit").alias("hits"))


def recover_weak(hits: DataFrame, least: float, anchor: float = 0.60, floor: float = 0.45) -> DataFrame:
    """Hits under the minimum that amend the law of a query's best clear hit and share words with the query.

    Takes (``query_id``, ``rank``, ``notice_num``, ``score``, ``tier``, ``law``, ``evidence``). One hit per notice that
    isn't served yet; nothing when ``least`` doesn't lie above the floor or the best clear hit is under the anchor.
    """
    if least <= floor:
        return hits.limit(0).select("query_id", "rank", "notice_num")
    clear = Window.partitionBy("query_id").orderBy("rank")
    lead = hits.where("tier = 'clear'").withColumn("r", F.row_number().over(clear)).where((F.col("r") == 1) & (F.col("score") >= anchor) & F.col("law").isNotNull()).select("query_id", "law")
    served = hits.where("tier IS NOT NULL").select("query_id", "notice_num").distinct()
    able = hits.where((F.col("score") >= floor) & (F.col("score") < least) & F.col("evidence")).join(lead, ["query_id", "law"], "left_semi").join(served, ["query_id", "notice_num"], "left_anti")
    once = Window.partitionBy("query_id", "notice_num").orderBy("rank")
    return able.withColumn("r", F.row_number().over(once)).where("r = 1").select("query_id", "rank", "notice_num")


def first_relevant(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """(``query_id``, ``rank``): the place of the first relevant notice among a query's distinct notices; null if none.

    Takes hits (``query_id``, ``notice_num``, ``rank``) and relevant (``query_id``, ``notice_num``).
    """
    best = hits.groupBy("query_id", "notice_num").agg(F.min("rank").alias("rank"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "notice_num")))
    found = placed.join(relevant, ["query_id", "notice_num"], "left_semi").groupBy("query_id").agg(F.min("place").alias("rank"))
    return relevant.select("query_id").distinct().join(found, "query_id", "left")


def rank_summary(ranks: DataFrame, by: str) -> DataFrame:
    """Recall at 1, 3 and 5 and mean reciprocal rank per group and over all (group null), a miss counting 0."""
    at = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in (1, 3, 5)]
    return ranks.rollup(by).agg(F.count("*").alias("n"), *at, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
