"""Near-duplicate records with small edits (problem 6).

Records are sets of words; two belong together when the share of common words reaches a threshold. PartEnum turns
the threshold on the share into one on the number of words that differ (for sets of a band of sizes), partitions the
word domain in two levels and enumerates subsets of the parts: two sets that differ in few enough words agree
completely on at least one subset, so they share that subset's signature.

A signature over parts that hold no or only common words brings together sets at random, in groups that grow with the
collection. Signatures are therefore joined if their words tell enough apart, and the pairs that meet only on the
others are found in an exact second way. Two similar sets that share a rare word share one among the first of their
words, rare words first (prefix filter). Two that share none must be similar by their common words alone: sets with
enough of these are compared in blocks, each two once, by the bits in which sketches of their common words differ, of
which there can't be more than words that differ. So no link is lost, whatever is taken for rare or telling.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.canon import canonical_column
from inkstone.operators.pairing import components, pairs_within
from inkstone.session import materialize, slots


def bands(similarity: float, largest: int = 1 << 24) -> list[tuple[int, int]]:
    """Neighbouring ranges of set sizes; similar sets lie in one range or in two that touch."""
    out = [(1, 1)]
    while out[-1][1] < largest:
        low = out[-1][1] + 1
        out.append((low, max(low, math.floor(low / similarity))))
    return out


class PartEnum:
    """Signatures of sets of 64-bit word hashes."""

    def __init__(self, similarity: float, spare: int = 2, second: int = 6, seed: int = 0x9E3779B97F4A7C15):
        self.similarity, self.spare, self.second, self.seed = similarity, spare, second, np.uint64(seed)
        self.bands = bands(similarity)
        kept = [[int(i not in gone) for i in range(second)] for gone in itertools.combinations(range(second), spare)]
        self.subsets = np.array(kept, np.uint64)
        self.salt = (np.arange(1, len(kept) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[None, :]

    def first(self, band: int) -> int:
        """First-level parts: at most ``spare`` differing words fall into one of them."""
        s = self.similarity
        differ = math.floor((1 - s) / (1 + s) * 2 * self.bands[band][1])
        return math.ceil((differ + 1) / (self.spare + 1))

    def signatures(self, words: np.ndarray, information: np.ndarray | None = None, least: float = 0.0) -> np.ndarray:
        """Distinct signatures of one set, for its own band of sizes and the next; with ``information`` (of each word)
        only those whose words add up to ``least``."""
        size = len(words)
        band = next(i for i, (a, b) in enumerate(self.bands) if a <= size <= b)
        mixed = (words ^ (words >> np.uint64(29))) * self.seed
        out = []
        for level in (band, band + 1):
            first = self.first(level)
            part = ((mixed >> np.uint64(20)) % np.uint64(first * self.second)).astype("i8")
            sums = np.zeros(first * self.second, np.uint64)
            np.add.at(sums, part, mixed)
            found = sums.reshape(first, self.second) @ self.subsets.T
            found = (found ^ self.salt) * np.uint64(0x165667B19E3779F9) + (np.arange(first, dtype=np.uint64)[:, None] * np.uint64(level * 2 + 1) + np.uint64(level << 32))
            if information is not None:
                told = np.bincount(part, information, first * self.second).reshape(first, self.second) @ self.subsets.T.astype("f8")
                found = found[told >= least]
            out.append(found.ravel())
        return np.unique(np.concatenate(out)).view(np.int64)


def word_sets(df: DataFrame, key: str, texts: list[str], least_words: int) -> DataFrame:
    """(``k``, ``words``, ``n``): sorted 64-bit hashes of the distinct words of the texts' consistent forms.

    Null texts count as empty; rows with a null key or with fewer than ``least_words`` words take no part; repeated
    rows count once. A key with several different texts is taken with the union of its words.
    """
    joined = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in texts])
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), joined.alias("t")).distinct()
    tokens = rows.select("k", F.filter(F.split(canonical_column("t"), r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") >= least_words)
    hashed = tokens.select("k", F.array_distinct(F.transform("w", lambda w: F.xxhash64(w))).alias("w"))
    one = hashed.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("words"))
    return one.select("k", "words", F.size("words").alias("n"))


#: 64-bit numbers of a sketch; those compared for every two sets, before the rest is for the pairs left.
SKETCH, FIRST = 8, 4


def sketch(words: np.ndarray) -> bytes:
    """A bit for each of 64 * ``SKETCH`` classes of words: whether the set has an odd number of them."""
    at = ((words.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(64 * SKETCH)
    return np.packbits((np.bincount(at.astype("i8"), minlength=64 * SKETCH) & 1).astype("u1")).tobytes()


def close_sketches(left: np.ndarray, right: np.ndarray, spare_left: np.ndarray, spare_right: np.ndarray, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in left and right whose sketches differ in no more bits than the two spare numbers add up to."""
    other = np.ascontiguousarray(right.T)
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        apart = np.zeros((len(part), len(right)), np.uint16)
        for w in range(FIRST):
            apart += np.bitwise_count(part[:, w, None] ^ other[w])
        i, j = np.nonzero(apart <= spare_left[at : at + rows, None] + spare_right)
        rest = np.bitwise_count(part[i, FIRST:] ^ right[j, FIRST:]).sum(axis=1, dtype="i8")
        kept = apart[i, j] + rest <= spare_left[at + i] + spare_right[j]
        yield at + i[kept], j[kept]


def _candidates(unique: DataFrame, similarity: float, rare: float, telling: float, rows_per_block: int) -> DataFrame:
    """(``a``, ``b``) of sets that share a telling signature or a rare word, or whose common words may be enough."""
    total = unique.count()
    counts = unique.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") > total * rare).toPandas().sort_values("w")
    known, weight = counts["w"].to_numpy("i8"), np.log(total / counts["df"].to_numpy("f8"))
    differ, least_told, enum = (1 - similarity) / (1 + similarity), math.log(max(1, total)) + telling, PartEnum(similarity)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, words in zip(batch["k"], batch["words"], strict=True):
                w = np.asarray(words, "i8")
                at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
                common = known[at] == w if len(known) else np.zeros(len(w), bool)
                told = np.full(len(w), -math.log(rare))  # at least
                told[common] = weight[at[common]]
                least, seldom = math.ceil(similarity * len(w) - 1e-9), w[~common]
                met = np.concatenate([enum.signatures(w.view(np.uint64), told, least_told), seldom[: len(w) - least + 1]])
                enough = len(w) - len(seldom) >= least
                out.append((k, len(w), met, sketch(w[common]) if enough else None, len(w) * differ - len(seldom)))
            yield pd.DataFrame(out, columns=["k", "n", "met", "sketch", "spare"])

    kind = dict(unique.dtypes)["k"]
    spread = unique.select("k", "words").repartition(4 * slots(unique.sparkSession), "k")
    parted = materialize(spread.mapInPandas(part, f"k {kind}, n int, met array<bigint>, sketch binary, spare double"), "parted")
    sharing = pairs_within(parted.select("k", F.explode("met").alias("w")), ["w"], "k").select("a", "b")

    ranges = bands(similarity)
    band = sum((F.when(F.col("n") > high, 1).otherwise(0) for _, high in ranges), F.lit(0)).cast("int")
    compared = parted.where("sketch IS NOT NULL").select("k", "n", "sketch", "spare", band.alias("band"))
    sizes = {r["band"]: -(-r["count"] // rows_per_block) for r in compared.groupBy("band").count().collect()}
    blocks = F.create_map(*[F.lit(x) for b in range(-1, len(ranges) + 1) for x in (b, sizes.get(b, 0))])
    each = compared.withColumn("block", F.pmod(F.xxhash64("k"), F.greatest(blocks[F.col("band")], F.lit(1))).cast("int"))
    others = lambda step: F.transform(F.filter(F.sequence(F.lit(-1), blocks[F.col("band") + step] - 1), lambda j: j >= 0), lambda j: F.struct((F.col("band") + step).cast("int").alias("band"), j.cast("int").alias("block")))
    met = each.withColumn("own", F.struct("band", "block")).withColumn("other", F.explode(F.concat(others(-1), others(0), others(1))))
    cells = met.select("k", "sketch", "spare", (F.col("own") <= F.col("other")).alias("first"), (F.col("own") == F.col("other")).alias("alone"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(-1, SKETCH)
        keys, spare, first, alone = rows["k"].to_numpy(), rows["spare"].to_numpy("f4") + np.float32(1e-3), rows["first"].to_numpy(bool), bool(rows["alone"].iloc[0])
        left, right = (np.arange(len(rows)),) * 2 if alone else (np.flatnonzero(first), np.flatnonzero(~first))
        found = [(i[i < j], j[i < j]) if alone else (i, j) for i, j in close_sketches(bits[left], bits[right], spare[left], spare[right])]
        i, j = (np.concatenate([f[x] for f in found]) if found else np.zeros(0, "i8") for x in (0, 1))
        return pd.DataFrame({"x": keys[left[i]], "y": keys[right[j]]})

    close = cells.groupBy("lo.band", "lo.block", F.col("hi.band").alias("band2"), F.col("hi.block").alias("block2")).applyInPandas(compare, f"x {kind}, y {kind}")
    return sharing.unionByName(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def similar_sets(sets: DataFrame, similarity: float = 0.8, telling: float = 6.0, rare: float = 1 / 2000, rows_per_block: int = 4_000) -> tuple[DataFrame, DataFrame]:
    """Links between representatives of equal sets, and membership.

    Takes (``k``, ``words``, ``n``). Result: (``a``, ``b``, ``similarity``) with ``a < b``, and (``k``, ``rep``) where
    ``rep`` is the least key with the same words. A word is common when more than ``rare`` of the sets have it; a
    signature is joined when its words carry ``telling`` nats more than the logarithm of the number of sets. The links
    are the same for any value of both. Only common words are sent to the workers, of which there are at most (mean set
    size) / ``rare``.
    """
    keyed = materialize(sets.select("k", "words", "n").withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(1), "words")}), "word-sets")
    reps = keyed.groupBy("h1", "h2").agg(F.min("k").alias("rep"), F.count("*").alias("copies"))
    members = keyed.select("k", "h1", "h2").join(reps, ["h1", "h2"]).select("k", "rep")
    unique = materialize(keyed.join(reps.select(F.col("rep").alias("k")), "k", "left_semi").select("k", "words", "n"), "unique-sets")
    candidates = _candidates(unique, similarity, rare, telling, rows_per_block).distinct()
    left = unique.select(F.col("k").alias("a"), F.col("words").alias("wa"), F.col("n").alias("na"))
    right = unique.select(F.col("k").alias("b"), F.col("words").alias("wb"), F.col("n").alias("nb"))
    sized = candidates.join(left, "a").join(right, "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    common = F.size(F.array_intersect("wa", "wb"))
    links = sized.withColumn("common", common).select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity"))
    return links.where(F.col("similarity") >= similarity), members


def similar_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(``a``, ``b``): every two keys of linked representatives, and every two keys with equal sets, ``a < b``."""
    left, right = members.select(F.col("rep").alias("a"), F.col("k").alias("ka")), members.select(F.col("rep").alias("b"), F.col("k").alias("kb"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return across.unionByName(pairs_within(members, ["rep"], "k").select("a", "b"))


def near_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(``k``, ``group_id``, ``links``): one row per record; ``links`` counts similar sets other than its own."""
    links = materialize(links.select("a", "b"), "near-links")
    found = components(links)
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("links"))
    rows = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").join(degree.withColumnRenamed("a", "rep"), "rep", "left")
    return rows.select("k", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
