"""Queries of the llm operators over the project's tables. Every query runs over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import abuse, canon, mixing, near, neighbours, oracles, overlap, packing, sentences, splitting, tokens
from inkstone.session import materialize, table

WHITE = r"[\n\t\x0B\f\r \x1C-\x1F\x85\p{Z}]"
Query = Callable[[SparkSession, str], DataFrame]


# Problem 1
def _pieces(spark: SparkSession, d: str) -> DataFrame:
    notices = splitting.split_oversized(table(spark, d, "notices_chunk_coverage"), "notice_num", "proposal_reason")
    chunks = splitting.split_oversized(table(spark, d, "chunks"), "chunk_id", "text", section="section")
    return notices.withColumn("origin", F.lit("notice")).unionByName(chunks.withColumn("origin", F.lit("chunk")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("origin", "item_id", "section").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("origin", "item_id", "section", "section_no", "piece_no", "start_char", "end_char", "overlap_chars", "text")


def p1_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Signs other than white space in the pieces of each oversized section, repeats aside, and whether all pieces fit."""
    t = _pieces(spark, d)
    signs = F.length(F.regexp_replace(F.substring(F.col("text"), F.col("overlap_chars") + 1, F.length("text")), WHITE + "+", ""))
    return t.groupBy("origin", "item_id", "section").agg(F.sum(signs).alias("signs"), (F.max(F.length("text")) <= 200).alias("fits"))


# Problem 3
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = canon.look_alikes(table(spark, d, "notices_capability_gate"), "notice_num", ["subject", "proposal_reason"])
    return pairs.select(F.col("a").alias("notice_num_a"), F.col("b").alias("notice_num_b"), "field_name")


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every notice with the consistent form of its two texts and a digest of it for comparisons."""
    t = table(spark, d, "notices_capability_gate").select("notice_num", "subject", "proposal_reason").distinct()
    t = canon.canonicalize(t, ["subject", "proposal_reason"])
    return t.select("notice_num", "subject_canonical", "proposal_reason_canonical", F.sha2(F.concat(F.coalesce("subject_canonical", F.lit("")), F.lit("\n"), F.coalesce("proposal_reason_canonical", F.lit(""))), 256).alias("look_digest"))


# Problem 4
def _boundary_model(spark: SparkSession, d: str) -> sentences.BoundaryModel:
    return sentences.fit_boundary_model([(table(spark, d, "notices_chunk_coverage"), "proposal_reason"), (table(spark, d, "chunks"), "text")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    model = _boundary_model(spark, d)
    notices = sentences.sentence_starts(table(spark, d, "notices_chunk_coverage"), "notice_num", "proposal_reason", model)
    return notices.unionByName(sentences.sentence_starts(table(spark, d, "chunks"), "chunk_id", "text", model))


def p4_sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with the sentence count delivered and the count found."""
    t = table(spark, d, "chunks").select("chunk_id", "text", "sentence_count")
    counts = sentences.sentence_counts(t, "chunk_id", "text", _boundary_model(spark, d))
    delivered = t.groupBy(F.col("chunk_id").alias("item_id")).agg(F.max("sentence_count").alias("delivered"))
    return counts.groupBy("item_id").agg(F.max("sentences").alias("sentences")).join(delivered, "item_id").select(F.col("item_id").alias("chunk_id"), "delivered", "sentences", F.coalesce(F.col("delivered") == F.col("sentences"), F.lit(False)).alias("was_right"))


# Problem 5
def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cols = [F.col("query_id").alias("q"), F.col("notice_num").alias("key"), F.col("query").alias("text")]
    ev = table(spark, d, "eval_queries").select(*cols, F.lit("eval_queries").alias("split")).unionByName(table(spark, d, "eval_holdout_queries").select(*cols, F.lit("eval_holdout_queries").alias("split")))
    return ev, table(spark, d, "train_queries").select(*cols, "source")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ev, tr = _splits(spark, d)
    return overlap.cross_split_overlaps(ev, tr).select(F.least("a", "b").alias("query_id_a"), F.greatest("a", "b").alias("query_id_b")).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps and distinct evaluation queries concerned, per split and training source."""
    ev, tr = _splits(spark, d)
    pairs = overlap.cross_split_overlaps(ev, tr)
    named = pairs.join(ev.select(F.col("q").alias("a"), "split").distinct(), "a").join(tr.select(F.col("q").alias("b"), "source").distinct(), "b")
    return named.groupBy("split", "source").agg(F.count("*").alias("pairs"), F.countDistinct("a").alias("eval_queries"), F.countDistinct("b").alias("train_queries"))


# Problem 6
def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sets = near.word_sets(table(spark, d, "notices_capability_gate"), "notice_num", ["subject", "proposal_reason"], 40)
    return near.similar_sets(sets, 0.6)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near.similar_pairs(*_near(spark, d)).select(F.col("a").alias("notice_num_a"), F.col("b").alias("notice_num_b")).distinct()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(*_near(spark, d)).withColumnRenamed("k", "notice_num")


# Problem 7
DIMENSION = 64


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = neighbours.usable_vectors(table(spark, d, "chunk_embeddings"), "chunk_id", "embedding", DIMENSION)
    near_ones = neighbours.nearest(vectors, DIMENSION, 5, min_cosine=0.9, relax=0.4)
    return near_ones.select(F.least("q", "n").alias("chunk_id_a"), F.greatest("q", "n").alias("chunk_id_b")).distinct()


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar chunks of each chunk whose notice number is divisible by 20, against all."""
    source = table(spark, d, "chunk_embeddings")
    vectors = neighbours.usable_vectors(source, "chunk_id", "embedding", DIMENSION)
    asked = source.where(F.split_part("chunk_id", F.lit("-"), F.lit(1)).try_cast("bigint") % 20 == 0).select(F.col("chunk_id").alias("id"))
    return neighbours.nearest(vectors, DIMENSION, 5, relax=0.4, queries=asked).select(F.col("q").alias("chunk_id"), F.col("n").alias("neighbour"), F.round("cosine", 5).alias("cosine"))


# Problem 8
CAPACITY = 2_048


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or part of a text over the capacity, with its container. A text without tokens takes room for one."""
    tokens.share(spark)
    docs = table(spark, d, "documents").select("doc_id", F.inline(tokens.text_parts("text", CAPACITY)))
    items = materialize(docs.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("part_no").cast("string")).alias("item"), F.greatest("tokens", F.lit(1)).alias("room"), "doc_id", "part_no", "start_char", "end_char", "tokens"), "items")
    packed = packing.pack(items.select("item", "room"), CAPACITY)
    return packed.join(items.drop("room"), "item").select("container_id", "doc_id", "part_no", "start_char", "end_char", "tokens", F.col("fill").alias("container_tokens"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, room used and the least number of containers the tokens could fit in."""
    t = p8_containers(spark, d).groupBy("container_id").agg(F.max("container_tokens").alias("fill"), F.count("*").alias("items"))
    return t.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("fill").alias("tokens"), F.ceil(F.sum("fill") / CAPACITY).alias("least_containers"), F.round(F.sum("fill") / (F.count("*") * CAPACITY), 6).alias("used_share"))


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document in its parts, whether these tile the text, and whether their containers hold."""
    t = p8_containers(spark, d).groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("chars"), F.max("end_char").alias("last"), F.count("*").alias("n"), F.countDistinct("part_no").alias("parts"), F.max("container_tokens").alias("fill"))
    return t.select("doc_id", "chars", ((F.col("last") == F.col("chars")) & (F.col("n") == F.col("parts"))).alias("whole"), (F.col("fill") <= CAPACITY).alias("fits"))


# Problem 9
def _mixture(spark: SparkSession, d: str, budget: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    tokens.share(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), mixing.plain_source("source").alias("source"), tokens.token_count("text").alias("tokens"))
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, d, "source_targets").collect()]
    return mixing.mixture(docs, targets, budget=budget)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p9_exact_mixture_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the largest mixture that meets every target exactly, as far as whole records allow."""
    return _mixture(spark, d, "exact")[1]


def p9_use(spark: SparkSession, d: str) -> DataFrame:
    """Records of each source with a target, and how many of them the mixture holds more often than it may."""
    docs = table(spark, d, "documents").select("doc_id", mixing.plain_source("source").alias("source"))
    used = _mixture(spark, d)[0].groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("times"))
    by = table(spark, d, "source_targets").join(docs.join(used, "doc_id", "left"), "source", "left").groupBy("source")
    return by.agg(F.count("doc_id").alias("records"), F.count_if(F.col("times") > F.col("max_repeats")).alias("used_too_often"))


# Problem 10
def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    model = abuse.fit(docs, table(spark, d, "review_labels"), "doc_id", "text", "abusive")
    return abuse.score(docs, "text", model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.round("score", 5).alias("score"), "flagged")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, flagged documents and their rate for every source in one spelling; the null source is its own."""
    by = _scored(spark, d).groupBy(mixing.plain_source("source").alias("source"))
    return by.agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("rate"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_tiles": p1_tiles,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p4_found": p4_found,
    "p4_sentence_counts": p4_sentence_counts,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p7_neighbours": p7_neighbours,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_cover": p8_cover,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_exact_mixture_shares": p9_exact_mixture_shares,
    "p9_use": p9_use,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

ORACLES: dict[str, str] = dict(oracles.ORACLES)
