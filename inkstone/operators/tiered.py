"""The whole path of a query: rewrite, embed, rank, look the chunks up, and grade each hit by its evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.config import KOREAN, DomainPack, Settings
from inkstone.functions import lexical
from inkstone.functions import text as T
from inkstone.operators import search
from inkstone.session import materialize

Embedder = Callable[[DataFrame], DataFrame]

#: Hits under this cosine can be no evidence of anything, whatever else speaks for them.
FLOOR = 0.49
#: Chunks whose vectors and words stand for the collection.
BACKGROUND = 512


def request_errors(queries: DataFrame, settings: Settings | None = None, k: int | str | Column | None = None) -> DataFrame:
    """(``query_id``, ``error``) of requests that are refused: ``blank``, ``too long`` or ``k`` out of bounds, in that order.

    Null queries are blank; without ``k`` the default holds.
    """
    s = settings or Settings()
    wanted = F.lit(s.default_k if k is None else k) if isinstance(k, int | None) else (F.col(k) if isinstance(k, str) else k)
    error = F.when(T.trim_blank(F.coalesce("query", F.lit(""))) == "", "blank").when(F.length("query") > s.query_max_chars, "too long").when(wanted.isNull() | ~wanted.between(1, s.max_k), "k")
    return queries.select("query_id", error.alias("error")).where("error IS NOT NULL")


def with_position(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Adds each row's place, from 0, in the order of ``key``.

    Rows are range-partitioned; places within a partition are shifted by the sizes of those before it, so no task
    sees more than its own range.
    """
    spread = materialize(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return spread.withColumn("_place", place).join(shifts, "_part").withColumn(name, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def gather(df: DataFrame, key: str, positions: DataFrame) -> DataFrame:
    """Rows of ``df`` at the given ``position``s of the order of ``key``; positions out of range give none."""
    return with_position(df, key).join(positions.select("position").distinct(), "position")


def background_sample(vectors: DataFrame, size: int = BACKGROUND) -> DataFrame:
    """The ``size`` vectors with the least hash of their id: the same for equal collections, in any order."""
    return vectors.orderBy(F.sha2("chunk_id", 256), "chunk_id").limit(size)


def _prepared(queries: DataFrame, embed: Embedder, pack: DomainPack) -> DataFrame:
    """(``query_id``, ``query``, ``embedding``) of queries that aren't blank; an unusable vector is an error when used."""
    q = queries.select("query_id", "query").distinct().withColumn("prepared", lexical.prepared_query("query", pack)).where("prepared <> ''")
    vectors = embed(q.select("query_id", "prepared")).select("query_id", "embedding")
    usable = F.when(search.usable("embedding"), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("no usable vector for query "), F.col("query_id").cast("string"))))
    return materialize(q.join(vectors, "query_id", "left").select("query_id", "query", usable.alias("embedding")), "queries")


def ranked_hits(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, embed: Embedder, k: int = 100, pack: DomainPack = KOREAN) -> tuple[DataFrame, DataFrame]:
    """The prepared queries, and (``query_id``, ``rank``, ``score``, chunk columns) of their ``k`` nearest chunks.

    ``chunks`` has one row a ``chunk_id``; a vector without its chunk gives no hit.
    """
    q = _prepared(queries, embed, pack)
    found = search.top_k(q.select(F.col("query_id").alias("id"), "embedding"), vectors.select(F.col("chunk_id").alias("id"), "embedding"), k)
    columns = ["chunk_id", "notice_num", "subject", "committee", "section", "text"]
    hits = found.withColumnRenamed("hit_id", "chunk_id").join(chunks.select(*columns), "chunk_id")
    return q, materialize(hits.select("query_id", "rank", "score", *columns), "hits")


def query_weights(queries: DataFrame, sample: DataFrame, pack: DomainPack = KOREAN) -> DataFrame:
    """(``query_id``, ``weights``) of each query's tokens, by how many chunks of the sample (``ct`` tokens) have them."""
    size = sample.count()
    df = sample.select(F.explode("ct").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    tokens = queries.select("query_id", F.posexplode(lexical.lexical_tokens("query", pack)).alias("at", "token"))
    weighed = tokens.join(df, "token", "left").withColumn("weight", search.idf(F.lit(size), F.col("df")))
    return weighed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "token", "weight"))).alias("weights"))


def coverage(weights: Column, tokens: Column) -> Column:
    """Share of a query's weights whose tokens a chunk has; 0 for a query without tokens."""
    add = lambda part: F.aggregate(part, F.lit(0.0), lambda s, w: s + w["weight"])
    return F.coalesce(add(F.filter(weights, lambda w: F.array_contains(tokens, w["token"]))) / F.nullif(add(weights), F.lit(0.0)), F.lit(0.0))


def search_tiered(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, embed: Embedder, k: int = 5, settings: Settings | None = None, pack: DomainPack = KOREAN, profile: bool = True) -> DataFrame:
    """(``query_id``, ``tier``, ``rank``, ``score``, ``z``, ``coverage``, ``candidates``, chunk columns) of every hit served.

    Takes queries (``query_id``, ``query``), chunks, vectors (``chunk_id``, ``embedding``) and ``embed``, which maps
    (``query_id``, ``prepared``) to (``query_id``, ``embedding``). With ``profile`` hits over the floor, counted in
    ``candidates``, are graded by score, score against a background sample and share of the query's words; without it by
    score alone, and weak hits that amend the law of a clear leader are recovered. The order of hits is never changed.
    Blank queries are served nothing.
    """
    s = settings or Settings()
    if k < 1:
        raise ValueError("k must be at least 1")
    q, hits = ranked_hits(queries, chunks, vectors, embed, k, pack)
    columns = ["chunk_id", "notice_num", "subject", "committee", "section", "text"]
    tokens = lexical.chunk_tokens("subject", "text", pack)
    if not profile:
        evidence = q.select("query_id", lexical.lexical_tokens("query", pack).alias("qt"))
        graded = hits.join(evidence, "query_id").withColumn("ct", tokens).withColumns({"tier": search.cosine_tier(F.col("score"), s.min_similarity, s.clear_similarity), "law": T.amended_law("subject"), "evidence": lexical.overlap_count("qt", "ct") > 0})
        again = search.recover_weak(graded, s.min_similarity).select("query_id", "rank", F.lit(True).alias("recovered"))
        served = graded.join(again, ["query_id", "rank"], "left").withColumn("tier", F.when(F.col("recovered"), "weak").otherwise(F.col("tier"))).where("tier IS NOT NULL")
        nothing = F.lit(None).cast("double")
        return served.select("query_id", "tier", "rank", "score", nothing.alias("z"), nothing.alias("coverage"), F.lit(None).cast("bigint").alias("candidates"), *columns)
    hits = hits.where(F.col("score") >= max(s.min_similarity, FLOOR))
    sample = materialize(background_sample(vectors).join(chunks.select("chunk_id", tokens.alias("ct")), "chunk_id"), "background")
    scores = search.top_k(q.select(F.col("query_id").alias("id"), "embedding"), sample.select(F.col("chunk_id").alias("id"), "embedding"), BACKGROUND)
    about = scores.groupBy("query_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"), F.count("*").alias("n"))
    graded = hits.join(about, "query_id", "left").join(query_weights(q, sample, pack), "query_id", "left").withColumn("ct", tokens)
    graded = graded.withColumns({"z": search.background_z(F.col("score"), F.col("mean"), F.col("deviation"), F.col("n")), "coverage": coverage(F.col("weights"), F.col("ct")), "candidates": F.count("*").over(Window.partitionBy("query_id"))})
    tier = search.classify(F.col("score"), F.col("z"), F.col("coverage"), s.min_similarity, s.clear_similarity)
    graded = graded.withColumn("tier", F.when(tier == "strong", "clear").when(tier == "weak", "weak")).where("tier IS NOT NULL")
    return graded.select("query_id", "tier", "rank", "score", "z", "coverage", "candidates", *columns)


def legacy_gate(hits: DataFrame, doubt: float = 0.6) -> DataFrame:
    """Hits (``query_id``, ``rank``, ``notice_num``, ``score``, ``tier``, ``evidence``) the word gate lets through.

    Only where a query's best score is under ``doubt`` must a notice have a hit with evidence in its tier to keep its
    hits there.
    """
    kept = F.max(F.col("evidence").cast("int")).over(Window.partitionBy("query_id", "tier", "notice_num")) == 1
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumns({"_kept": kept, "_top": top}).where((F.col("_top") >= doubt) | F.coalesce("_kept", F.lit(False))).drop("_kept", "_top")


def probe_report(hits: DataFrame) -> DataFrame:
    """Per query ``top1``, ``window``, ``clear``, ``weak``, ``kept_chunks``, ``kept_notices``, ``max_overlap`` of hits with
    ``score``, ``tier`` and ``overlap``."""
    kept = F.col("overlap") > 0
    return hits.groupBy("query_id").agg(F.max("score").alias("top1"), F.count("*").alias("window"), F.count_if(F.col("tier") == "clear").alias("clear"), F.count_if(F.col("tier") == "weak").alias("weak"), F.count_if(kept).alias("kept_chunks"), F.countDistinct(F.when(kept, F.col("notice_num"))).alias("kept_notices"), F.max("overlap").alias("max_overlap"))
