"""Mixing sources to target weights (problem 9).

The token budget is divided over the sources by their targets; a source that can't give its share even with all its
repeats gives what it has, and the others share the rest in proportion. Each source's records are put in a hashed
order; whole passes take every record, the last pass a prefix of that order whose tokens come nearest to the rest.

The records drawn are dealt to output shards by a multivariate-hypergeometric splitting tree: at each node the exact
counts of the sources are divided between the two halves of the shards, so every shard is a sample without
replacement of the whole mixture, of exactly its size. A shard's records of a source are a block of its permuted
order, disjoint from all others'; within a shard they are shuffled by hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.session import materialize


RECORDS_PER_SHARD = 500_000
#: Populations from which numpy draws hypergeometric numbers by itself.
NUMPY_LIMIT = 10**9
#: Records of a source that a running sum or rank is taken over in one task.
RECORDS_PER_BLOCK = 50_000


def allocate(capacity: dict[str, float], target: dict[str, float], budget: float) -> dict[str, float]:
    """Tokens of each source: in proportion to its target, at most its capacity, ``budget`` in all if it can be."""
    given: dict[str, float] = {}
    free = {s for s in target if target[s] > 0 and capacity.get(s, 0) > 0}
    left = min(budget, sum(capacity[s] for s in free))
    while free:
        weight = sum(target[s] for s in free)
        short = {s for s in free if capacity[s] <= left * target[s] / weight}
        if not short:
            given |= {s: left * target[s] / weight for s in free}
            break
        for s in short:
            given[s] = capacity[s]
            left -= capacity[s]
        free -= short
    return {s: given.get(s, 0.0) for s in target}


def split_quotas(counts: np.ndarray, shards: int, seed: int = 17) -> np.ndarray:
    """(shards, sources): how many records of each source every shard gets; rows are of equal size, give or take one."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(counts)), "i8")
    total = int(counts.sum())
    size = np.full(shards, total // shards, "i8")
    size[: total % shards] += 1
    stack = [(0, shards, counts.astype("i8"))]
    while stack:
        low, high, have = stack.pop()
        if high - low == 1:
            out[low] = have
            continue
        middle = (low + high) // 2
        left = _hypergeometric(rng, have, int(size[low:middle].sum()))
        stack += [(low, middle, left), (middle, high, have - left)]
    return out


def _hypergeometric(rng: np.random.Generator, have: np.ndarray, draws: int) -> np.ndarray:
    """One exact draw, source by source."""
    out, rest = np.zeros_like(have), int(have.sum())
    for i, n in enumerate(have.tolist()):
        rest -= n
        if draws and n:
            out[i] = rng.hypergeometric(n, rest, draws) if n + rest < NUMPY_LIMIT else _large_hypergeometric(rng, n, rest, draws)
            draws -= int(out[i])
    return out


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw of any size by inversion. Probabilities are built from their ratios, outwards from the mode;
    the window leaves out less than one uniform 64-bit number can tell (12 deviations to each side)."""
    total, mode = good + bad, (draws + 1) * (good + 1) // (good + bad + 2)
    deviation = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)))
    reach = math.ceil(12 * deviation) + 12
    low, high = max(0, draws - bad, mode - reach), min(good, draws, mode + reach)
    k = np.arange(low, high, dtype="f8")
    ratios = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    run = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(run, rng.random() * run[-1], side="right"))


def plain_source(column: str | Column) -> Column:
    """Sources in one spelling: trimmed, lower case; blank as null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.regexp_replace(c, r"^(?U)\s+|\s+$", "")), F.lit(""))


def _prefix(sized: DataFrame, rest: dict[str, float], blocks: int) -> DataFrame:
    """The records of the last pass: per source the prefix of the hashed order that comes nearest to ``rest`` tokens.

    Blocks of the order are summed first; a running sum of records is only taken within the one block per source in
    which the prefix ends.
    """
    block = F.shiftrightunsigned("h", 64 - blocks)
    rows = sized.withColumn("block", block)
    sums = rows.groupBy("source", "block").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.create_map(*[x for s, r in rest.items() for x in (F.lit(s), F.lit(float(r)))])
    at = sums.withColumn("before", before).withColumn("rest", wanted[F.col("source")])
    whole = at.where("before + t <= rest").select("source", "block")
    cut = at.where("before < rest AND before + t > rest").select("source", "block", "before", "rest")
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    partial = rows.join(cut, ["source", "block"]).withColumn("run", F.col("before") + run).where("run - rest <= rest - (run - tokens)").select("source", "id", "tokens", "h")
    return rows.join(whole, ["source", "block"], "left_semi").select("source", "id", "tokens", "h").unionByName(partial)


def mixture(sized: DataFrame, targets: list[tuple[str, float, int]], shards: int | None = None, budget: float | str | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Takes (``id``, ``source``, ``tokens``) with unique ids and sources spelt as in ``targets`` (source, share, most
    uses of a record). Records of sources without a target, and of null sources, have no part in the mixture; the
    report lists them with share 0. Result: (``shard``, ``position``, ``id``, ``source``, ``copy_no``, ``tokens``) and
    (``source``, ``target_share``, ``max_repeats``, ``available_tokens``, ``drawn_records``, ``drawn_tokens``,
    ``actual_share``, ``gap``). Without ``shards`` there are
    8, or as many as keep them under ``RECORDS_PER_SHARD``. ``budget`` defaults to the tokens of all records of the sources with a target;
    ``"exact"`` takes the most at which every source that has records can give its share.
    Null token counts are 0. Without records or targets both results hold no drawn record.
    """
    spark = sized.sparkSession
    targets = targets or [("", 0.0, 1)]
    names = [s for s, _, _ in targets]
    share, repeats = {s: w for s, w, _ in targets}, {s: max(1, int(r)) for s, _, r in targets}
    order = F.xxhash64(F.lit(seed), F.col("id"))
    rows = materialize(sized.select("id", "source", F.coalesce("tokens", F.lit(0)).alias("tokens")).withColumn("h", order), "sized")
    have = {r["source"]: (r["n"], r["t"] or 0) for r in rows.where(F.col("source").isin(names)).groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    total = {s: have.get(s, (0, 0))[1] for s in names}
    # Hash blocks of a source, as a power of two, from the largest source with all its copies.
    blocks = max(4, math.ceil(math.log2(max(1, *(have.get(s, (0, 0))[0] * repeats[s] for s in names)) / RECORDS_PER_BLOCK + 1)))
    if budget == "exact":
        budget = min((total[s] * repeats[s] / share[s] for s in names if total[s] and share[s] > 0), default=0.0)
        budget *= sum(share[s] for s in names if total[s])
    wanted = allocate({s: float(total[s] * repeats[s]) for s in names}, share, float(sum(total.values())) if budget is None else budget)
    passes = {s: int(wanted[s] // total[s]) if total[s] else 0 for s in names}
    rest = {s: wanted[s] - passes[s] * total[s] if passes[s] < repeats[s] else 0.0 for s in names}
    own = rows.where(F.col("source").isin(names))
    full = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(passes[s]))])
    copies = own.withColumn("p", full[F.col("source")]).where("p > 0").select("source", "id", "tokens", "h", F.explode(F.sequence(F.lit(1), F.col("p"))).alias("copy_no"))
    last = _prefix(own, rest, blocks).withColumn("copy_no", (full[F.col("source")] + 1).cast("int"))
    drawn = materialize(copies.unionByName(last).withColumn("place", F.xxhash64(F.lit(seed + 1), "id", "copy_no")), "drawn")
    counts = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.count("*").alias("n")).collect()}
    shards = shards or max(8, -(-sum(counts.values()) // RECORDS_PER_SHARD))
    quotas = split_quotas(np.array([counts.get(s, 0) for s in names], "i8"), shards, seed)
    ends = np.cumsum(quotas, axis=0)
    # A record's rank in its source's permuted order: the records of the blocks before, and its rank in its own block.
    placed = drawn.withColumn("block", F.shiftrightunsigned("place", 64 - blocks))
    sums = placed.groupBy("source", "block").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("source", "block").orderBy("place", "id", "copy_no")) - 1
    ranked = placed.withColumn("rank", rank).join(sums.withColumn("offset", offset).select("source", "block", "offset"), ["source", "block"]).withColumn("rank", F.col("rank") + F.col("offset"))
    limits = spark.createDataFrame([(s, [int(x) for x in ends[:, i]]) for i, s in enumerate(names)], "source string, ends array<bigint>")
    dealt = ranked.join(limits, "source").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    mixed = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "id", "copy_no"), "id", "copy_no")
    result = dealt.withColumn("position", F.row_number().over(mixed)).select("shard", "position", "id", "source", "copy_no", "tokens")
    aims = spark.createDataFrame([(s, float(share[s]), int(repeats[s])) for s in names], "source string, target_share double, max_repeats int")
    available = rows.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("available_tokens"))
    got = drawn.groupBy("source").agg(F.count("*").alias("drawn_records"), F.sum("tokens").cast("bigint").alias("drawn_tokens"))
    grand = max(1, drawn.agg(F.sum("tokens")).first()[0] or 0)
    report = available.join(aims, available["source"].eqNullSafe(aims["source"]), "full").select(F.coalesce(available["source"], aims["source"]).alias("source"), "target_share", "max_repeats", "available_tokens").join(got, "source", "left")
    report = report.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("available_tokens", "drawn_records", "drawn_tokens")])
    report = report.withColumn("actual_share", F.round(F.col("drawn_tokens") / grand, 6)).withColumn("gap", F.round(F.col("drawn_tokens") / grand - F.col("target_share"), 6))
    return result, report
