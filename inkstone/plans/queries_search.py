"""Queries over the whole search path, from the words of labelled queries to graded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.config import Settings
from inkstone.functions import lexical
from inkstone.operators import search, tiered
from inkstone.plans.chunk_sql import cleaned
from inkstone.plans.queries_text import FORMS, labelled_queries, token_sql
from inkstone.plans.registry import query
from inkstone.session import materialize, table

K = 50


def _collection(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks, each once, and the usable vectors of those that have one."""
    chunks = table(spark, d, "chunks").select("chunk_id", "notice_num", "subject", "committee", "section", "text").distinct()
    vectors = table(spark, d, "chunk_embeddings").where(search.usable("embedding") & (F.size("embedding") == 64)).groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))
    return chunks, vectors


def _stand_in(spark: SparkSession, d: str):
    """An embedder without a model: the vector of the first chunk of the query's notice, else one picked by its id."""
    q, vectors = labelled_queries(spark, d), materialize(_collection(spark, d)[1], "stand-in")
    n = vectors.count()
    placed = tiered.with_position(vectors, "chunk_id")
    first = placed.groupBy(F.split_part("chunk_id", F.lit("-"), F.lit(1)).cast("bigint").alias("notice_num")).agg(F.min("position").alias("own"))

    def embed(prepared: DataFrame) -> DataFrame:
        asked = prepared.select("query_id").join(q.groupBy("query_id").agg(F.min("notice_num").alias("notice_num")), "query_id").join(first, "notice_num", "left")
        return asked.withColumn("position", F.coalesce("own", F.col("query_id") % n)).join(placed, "position").select("query_id", "embedding")

    return embed


_UNIT = "list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))"
_FOUND = f"""
WITH {FORMS}, ch AS (SELECT DISTINCT chunk_id, notice_num, subject, committee, section, text FROM chunks),
ve AS (SELECT chunk_id, list_transform(min(embedding), lambda x: x::DOUBLE) AS e FROM chunk_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
vu AS (SELECT chunk_id, {_UNIT} AS e, row_number() OVER (ORDER BY chunk_id) - 1 AS position, count(*) OVER () AS n FROM ve),
qs AS (SELECT DISTINCT query_id, notice_num, query FROM eval_queries UNION SELECT DISTINCT query_id, notice_num, query FROM eval_holdout_queries),
fi AS (SELECT split_part(chunk_id, '-', 1)::BIGINT AS notice_num, min(position) AS own FROM vu GROUP BY 1),
qv AS (SELECT query_id, query, vu.e FROM qs LEFT JOIN fi USING (notice_num) JOIN vu ON vu.position = coalesce(fi.own, query_id % (SELECT any_value(n) FROM vu)) WHERE {cleaned("query")} <> ''),
hh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(list_inner_product(qv.e, vu.e), 6) AS score FROM qv, vu)) WHERE rank <= {K}),
ct AS (SELECT chunk_id, tokens AS ct FROM ({token_sql("(SELECT chunk_id, coalesce(subject, '') || chr(10) || coalesce(text, '') AS t FROM ch)", "chunk_id", "t")})),
qt AS (SELECT query_id, tokens AS qt FROM ({token_sql("qs", "query_id", "query")}))"""
_GRADED = _FOUND + f""",
bg AS (SELECT chunk_id, e FROM vu WHERE chunk_id IN (SELECT chunk_id FROM ch) ORDER BY sha256(chunk_id), chunk_id LIMIT {tiered.BACKGROUND}),
st AS (SELECT query_id, avg(s) AS mean, stddev_pop(s) AS deviation, count(*) AS n FROM (SELECT query_id, round(list_inner_product(qv.e, bg.e), 6) AS s FROM qv, bg) GROUP BY query_id),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(ct) AS token FROM ct JOIN bg USING (chunk_id)) GROUP BY token),
wt AS (SELECT query_id, list({{'token': token, 'weight': CASE WHEN df IS NULL THEN 3.0 ELSE least(5.0, ln(1 + ((SELECT count(*) FROM bg) - df + 0.5) / (df + 0.5))) END}}) AS w FROM (SELECT query_id, unnest(qt) AS token FROM qt) LEFT JOIN df USING (token) GROUP BY query_id),
gr AS (SELECT hh.query_id, rank, chunk_id, score, CASE WHEN n >= 32 AND deviation > 1e-6 THEN (score - mean) / greatest(deviation, 0.03) END AS z, coalesce(list_sum(list_transform(list_filter(w, lambda x: list_contains(coalesce(ct, []), x.token)), lambda x: x.weight)) / list_sum(list_transform(w, lambda x: x.weight)), 0) AS k, count(*) OVER (PARTITION BY hh.query_id) AS candidates FROM hh LEFT JOIN st USING (query_id) LEFT JOIN wt USING (query_id) LEFT JOIN ct USING (chunk_id) WHERE score >= 0.49),
ti AS (SELECT *, CASE WHEN score >= 0.51 AND z >= 5.0 AND (k >= 0.35 OR (score >= 0.55 AND z >= 5.5)) THEN 'clear' WHEN k >= 0.35 OR (score >= 0.51 AND z >= 5.5) THEN 'weak' END AS tier FROM gr)"""


@query("search_tiered", _GRADED + " SELECT query_id, tier, rank::INTEGER AS rank, chunk_id, notice_num, subject, section, score, round(z, 4) AS z, round(k, 6) AS coverage, candidates FROM ti JOIN ch USING (chunk_id) WHERE tier IS NOT NULL")
def search_tiered(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled query through the whole path; a stand-in for the model gives the vectors."""
    out = tiered.search_tiered(labelled_queries(spark, d), *_collection(spark, d), _stand_in(spark, d), K)
    return out.select("query_id", "tier", "rank", "chunk_id", "notice_num", "subject", "section", "score", F.round("z", 4).alias("z"), F.round("coverage", 6).alias("coverage"), "candidates")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Ranked chunks of every labelled query with the tier by score and the words shared."""
    q, hits = tiered.ranked_hits(labelled_queries(spark, d), *_collection(spark, d), _stand_in(spark, d), K)
    words = q.select("query_id", lexical.lexical_tokens("query").alias("qt"))
    both = hits.join(words, "query_id").withColumn("ct", lexical.chunk_tokens("subject", "text"))
    return both.withColumns({"overlap": lexical.overlap_count("qt", "ct").cast("bigint"), "tier": search.cosine_tier(F.col("score"))})


_SHARED = _FOUND + ", ov AS (SELECT hh.*, notice_num, len(list_filter(coalesce(qt, []), lambda a: len(list_filter(coalesce(ct, []), lambda b: contains(b, a) OR contains(a, b))) > 0)) AS overlap, CASE WHEN score >= 0.45 THEN 'clear' WHEN score >= 0.25 THEN 'weak' END AS tier FROM hh JOIN ch USING (chunk_id) LEFT JOIN qt USING (query_id) LEFT JOIN ct USING (chunk_id))"


@query("lexical_gate_legacy", _SHARED + ", g AS (SELECT *, max(overlap) OVER (PARTITION BY query_id, tier, notice_num) AS best, max(score) OVER (PARTITION BY query_id) AS top FROM ov WHERE tier IS NOT NULL) SELECT query_id, tier, chunk_id FROM g WHERE top >= 0.6 OR best > 0")
def lexical_gate_legacy(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).where("tier IS NOT NULL").withColumn("evidence", F.col("overlap") > 0)
    return tiered.legacy_gate(h).select("query_id", "tier", "chunk_id")


@query("probe_report", _SHARED + " SELECT query_id, max(score) AS top1, count(*) AS \"window\", count(*) FILTER (WHERE tier = 'clear') AS clear, count(*) FILTER (WHERE tier = 'weak') AS weak, count(*) FILTER (WHERE overlap > 0) AS kept_chunks, count(DISTINCT CASE WHEN overlap > 0 THEN notice_num END) AS kept_notices, max(overlap) AS max_overlap FROM ov GROUP BY query_id")
def probe_report(spark: SparkSession, d: str) -> DataFrame:
    return tiered.probe_report(_hits(spark, d))


@query("request_errors", "SELECT error, count(*) AS requests FROM (SELECT CASE WHEN trim(query) = '' THEN 'blank' WHEN length(query) > 40 THEN 'too long' WHEN query_id % 120 NOT BETWEEN 1 AND 100 THEN 'k' END AS error FROM train_queries) WHERE error IS NOT NULL GROUP BY error")
def request_errors(spark: SparkSession, d: str) -> DataFrame:
    """Requests refused at a limit of 40 characters, asking for as many hits as their id's rest by 120."""
    t = table(spark, d, "train_queries")
    return tiered.request_errors(t, Settings(query_max_chars=40), F.col("query_id") % 120).groupBy("error").agg(F.count("*").alias("requests"))


@query("vectors_by_position", "SELECT position::BIGINT AS position, chunk_id FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS position FROM (SELECT DISTINCT chunk_id FROM chunk_embeddings)) WHERE position IN (SELECT notice_num % 1000 FROM anchor_notices)")
def vectors_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Rows gathered by their place in the order of ids."""
    ids = table(spark, d, "chunk_embeddings").select("chunk_id").distinct()
    return tiered.gather(ids, "chunk_id", table(spark, d, "anchor_notices").select((F.col("notice_num") % 1000).alias("position"))).select("position", "chunk_id")


@query("idf_weights", f"WITH {FORMS}, ch AS (SELECT DISTINCT chunk_id, subject, text FROM chunks), t AS ({token_sql("(SELECT chunk_id, coalesce(subject, '') || chr(10) || coalesce(text, '') AS t FROM ch)", "chunk_id", "t")}), f AS (SELECT token, count(*) AS df FROM (SELECT unnest(tokens) AS token FROM t) GROUP BY token) SELECT token, round(least(5.0, ln(1 + (size - df + 0.5) / (df + 0.5))), 6) AS weight FROM f, (SELECT count(*) AS size FROM ch)")
def idf_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the words of all chunks."""
    c = table(spark, d, "chunks").select("chunk_id", "subject", "text").distinct()
    df = c.select(F.explode(lexical.chunk_tokens("subject", "text")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.select("token", F.round(search.idf(F.lit(c.count()), F.col("df")), 6).alias("weight"))


@query("query_coverage", _GRADED + " SELECT hh.query_id, chunk_id, round(coalesce(list_sum(list_transform(list_filter(w, lambda x: list_contains(coalesce(ct, []), x.token)), lambda x: x.weight)) / list_sum(list_transform(w, lambda x: x.weight)), 0), 6) AS coverage FROM hh JOIN ch USING (chunk_id) LEFT JOIN wt USING (query_id) LEFT JOIN ct USING (chunk_id)")
def query_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Weighted share of a query's words that each of its hits has, by the background sample's weights."""
    chunks, vectors = _collection(spark, d)
    q, hits = tiered.ranked_hits(labelled_queries(spark, d), chunks, vectors, _stand_in(spark, d), K)
    sample = tiered.background_sample(vectors).join(chunks.select("chunk_id", lexical.chunk_tokens("subject", "text").alias("ct")), "chunk_id")
    both = hits.join(tiered.query_weights(q, materialize(sample, "background")), "query_id", "left").withColumn("ct", lexical.chunk_tokens("subject", "text"))
    return both.select("query_id", "chunk_id", F.round(tiered.coverage(F.col("weights"), F.col("ct")), 6).alias("coverage"))
