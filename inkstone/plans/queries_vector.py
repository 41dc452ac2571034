"""Queries over vectors: normalisation, exact search, tiers, relevance, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import lexical, stats
from inkstone.operators import search
from inkstone.plans.registry import query
from inkstone.session import table

#: Unit vectors in doubles, as SQL; the query set is every id divisible by 20.
_V = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings)"
_HITS = f"{_V}, s AS (SELECT q.id AS query_id, v.id AS hit_id, v.label, round(list_inner_product(q.e, v.e), 6) AS score FROM v q, v WHERE q.id % 20 = 0 AND v.id <> q.id), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM s) WHERE rank <= 100)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return v.where("id % 20 = 0"), v


def _hits(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    """The 100 best hits of each query, with the hit's label."""
    q, v = _vectors(spark, d)
    return search.top_k(q, v, k, exclude_self=True).join(v.select(F.col("id").alias("hit_id"), "label"), "hit_id")


@query("vec_normalize_norms", "SELECT chunk_id, round(n, 5) AS norm, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS unit_norm FROM (SELECT DISTINCT chunk_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM chunk_embeddings WHERE embedding IS NOT NULL)")
def vec_normalize_norms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "chunk_embeddings").where("embedding IS NOT NULL").select("chunk_id", F.round(search.norm("embedding"), 5).alias("norm"), F.round(search.norm(search.unit("embedding")), 6).alias("unit_norm"))
    return e.distinct()


@query("vec_finite_guard", "SELECT count(*) FILTER (WHERE embedding IS NULL) AS nulls, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_length, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zeros, count(*) FILTER (WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0) AS usable FROM chunk_embeddings")
def vec_finite_guard(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "chunk_embeddings").agg(F.count_if(e.isNull()).alias("nulls"), F.count_if(F.size(e) != 64).alias("wrong_length"), F.count_if(e.isNotNull() & ~F.exists(e, lambda x: x != 0)).alias("zeros"), F.count_if(search.usable(e)).alias("usable"))


@query("vec_topk_single", f"WITH {_HITS} SELECT hit_id, score, rank FROM h WHERE query_id = 0 AND rank <= 10")
def vec_topk_single(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return search.top_k(q.where("id = 0"), v, 10, exclude_self=True).select("hit_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("vec_topk_batch", f"WITH {_HITS} SELECT query_id, hit_id, score, rank FROM h WHERE rank <= 10")
def vec_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return search.top_k(q, v, 10, exclude_self=True).select("query_id", "hit_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("rrf_two_rankings", f"WITH {_HITS} SELECT query_id, hit_id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT query_id, hit_id, rank AS r FROM h WHERE rank <= 20 UNION ALL SELECT query_id, hit_id, row_number() OVER (PARTITION BY query_id ORDER BY hit_id) FROM h WHERE rank <= 20) GROUP BY query_id, hit_id")
def rrf_two_rankings(spark: SparkSession, d: str) -> DataFrame:
    """The ranking by score fused with one by id."""
    from pyspark.sql import Window

    h = _hits(spark, d, 20).select("query_id", "hit_id", "rank")
    other = h.select("query_id", "hit_id", F.row_number().over(Window.partitionBy("query_id").orderBy("hit_id")).alias("rank"))
    return lexical.rank_fusion(h.unionByName(other), ["query_id", "hit_id"]).withColumn("score", F.round("score", 9))


_RANGE = f"{_V}, x AS (SELECT id, i - 1 AS pos, e[i] AS x FROM v, unnest(range(1, 65)) u(i)), r AS (SELECT pos, min(x) AS low, max(x) - min(x) AS span FROM x GROUP BY pos), c AS (SELECT id, pos, x, low, span, greatest(0, least(255, floor(255 * (x - low) / span))) AS code FROM x JOIN r USING (pos))"


@query("vec_sq8_ranges", f"WITH {_RANGE} SELECT pos::INTEGER AS pos, round(low, 6) AS low, round(span, 6) AS span FROM r")
def vec_sq8_ranges(spark: SparkSession, d: str) -> DataFrame:
    return search.quantizer(_vectors(spark, d)[1])[1].select("pos", F.round("low", 6).alias("low"), F.round("span", 6).alias("span"))


@query("vec_sq8_roundtrip", f"WITH {_RANGE} SELECT id, sum(code)::BIGINT AS code_sum, max(abs(x - ((code + 0.5) / 255 * span + low))) <= max(span) / 255 AS within_step FROM c GROUP BY id")
def vec_sq8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)[1]
    coded, ranges = search.quantizer(v)
    back = search.dequantize(coded, ranges).withColumnRenamed("embedding", "back")
    step = ranges.agg(F.max("span")).first()[0] / 255
    j = v.join(coded, "id").join(back, "id")
    off = F.array_max(F.zip_with(search.unit("embedding"), "back", lambda a, b: F.abs(a - b)))
    return j.select("id", F.aggregate("codes", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("code_sum"), (off <= step).alias("within_step"))


@query("vec_sq8_recall", f"WITH {_RANGE.split('WITH ')[-1]}, back AS (SELECT id, list((code + 0.5) / 255 * span + low ORDER BY pos) AS e FROM c GROUP BY id), w AS (SELECT q.id AS query_id, b.id AS hit_id, round(list_inner_product(q.e, b.e) / sqrt(list_inner_product(b.e, b.e)), 6) AS score FROM v q, back b WHERE q.id % 20 = 0 AND b.id <> q.id), x10 AS (SELECT query_id, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS r FROM w) WHERE r <= 10), f AS (SELECT query_id, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS r FROM (SELECT q.id AS query_id, b.id AS hit_id, round(list_inner_product(q.e, b.e), 6) AS score FROM v q, v b WHERE q.id % 20 = 0 AND b.id <> q.id)) WHERE r <= 10) SELECT count(*) AS hits, round(avg(CASE WHEN x10.hit_id IS NULL THEN 0.0 ELSE 1.0 END), 4) AS recall FROM f LEFT JOIN x10 USING (query_id, hit_id)")
def vec_sq8_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the flat search's ten best that the quantised search finds."""
    q, v = _vectors(spark, d)
    flat = search.top_k(q, v, 10, exclude_self=True).select("query_id", "hit_id")
    coded, ranges = search.quantizer(v)
    back = search.dequantize(coded, ranges)
    quick = search.top_k(q, back, 10, exclude_self=True).select("query_id", "hit_id", F.lit(1).alias("found"))
    return flat.join(quick, ["query_id", "hit_id"], "left").agg(F.count("*").alias("hits"), F.round(F.avg(F.coalesce("found", F.lit(0))), 4).alias("recall"))


_BG = f"WITH {_V}, b AS (SELECT * FROM v ORDER BY sha256(id::VARCHAR), id LIMIT 512), g AS (SELECT q.id AS query_id, avg(s) AS mean, stddev_pop(s) AS deviation, count(*) AS n FROM (SELECT q.id, round(list_inner_product(q.e, b.e), 6) AS s FROM v q, b WHERE q.id % 20 = 0) q GROUP BY q.id)"


def _background(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of each query's scores against a fixed sample of 512 vectors, chosen by hash of the id."""
    q, v = _vectors(spark, d)
    sample = v.orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(512)
    s = search.top_k(q, sample, 512)
    return s.groupBy("query_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"), F.count("*").alias("n"))


@query("vec_background_stats", _BG + " SELECT query_id, round(mean, 5) AS mean, round(deviation, 5) AS deviation, n FROM g")
def vec_background_stats(spark: SparkSession, d: str) -> DataFrame:
    return _background(spark, d).select("query_id", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"), "n")


@query("tiers_cosine", f"WITH {_HITS} SELECT query_id, count(*) FILTER (WHERE score >= 0.45) AS clear, count(*) FILTER (WHERE score >= 0.25 AND score < 0.45) AS weak, count(*) FILTER (WHERE score < 0.25) AS dropped FROM h GROUP BY query_id")
def tiers_cosine(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).withColumn("tier", search.cosine_tier(F.col("score")))
    return h.groupBy("query_id").agg(F.count_if(F.col("tier") == "clear").alias("clear"), F.count_if(F.col("tier") == "weak").alias("weak"), F.count_if(F.col("tier").isNull()).alias("dropped"))


_CLASS = "CASE WHEN score < 0.25 THEN 'discard' WHEN score >= 0.51 AND z >= 5.0 AND (k >= 0.35 OR (score >= 0.55 AND z >= 5.5)) THEN 'strong' WHEN score >= 0.49 AND (k >= 0.35 OR (score >= 0.51 AND z >= 5.5)) THEN 'weak' ELSE 'discard' END"
_CAL = f"WITH {_HITS}, b AS (SELECT * FROM v ORDER BY sha256(id::VARCHAR), id LIMIT 512), g AS (SELECT id AS query_id, avg(s) AS mean, stddev_pop(s) AS deviation FROM (SELECT q.id, round(list_inner_product(q.e, b.e), 6) AS s FROM v q, b WHERE q.id % 20 = 0) GROUP BY id), m AS (SELECT h.*, (score - mean) / greatest(deviation, 0.03) AS z, CASE WHEN h.label = q.label THEN 0.5 ELSE 0.0 END AS k FROM h JOIN g USING (query_id) JOIN v q ON q.id = h.query_id), t AS (SELECT *, {_CLASS} AS tier FROM m)"


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their tier by score, background and coverage (half where the labels agree, as vectors have no words)."""
    own = _vectors(spark, d)[0].select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    h = _hits(spark, d).join(_background(spark, d), "query_id").join(own, "query_id")
    z = search.background_z(F.col("score"), F.col("mean"), F.col("deviation"), F.col("n"))
    k = F.when(F.col("label") == F.col("own"), 0.5).otherwise(0.0)
    return h.withColumns({"z": z, "k": k}).withColumn("tier", search.classify(F.col("score"), F.col("z"), F.col("k")))


@query("tiers_calibrated", _CAL + " SELECT query_id, tier, count(*) AS hits FROM t GROUP BY query_id, tier")
def tiers_calibrated(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d).groupBy("query_id", "tier").agg(F.count("*").alias("hits"))


@query("tiers_ablation", _CAL + " SELECT query_id, count(*) FILTER (WHERE score >= 0.51) AS cosine_only_strong, count(*) FILTER (WHERE score >= 0.51 AND z >= 5.0) AS cosine_background_strong, count(*) FILTER (WHERE tier = 'strong') AS calibrated_strong FROM t GROUP BY query_id")
def tiers_ablation(spark: SparkSession, d: str) -> DataFrame:
    c = _calibrated(spark, d)
    return c.groupBy("query_id").agg(F.count_if(F.col("score") >= 0.51).alias("cosine_only_strong"), F.count_if((F.col("score") >= 0.51) & (F.col("z") >= 5.0)).alias("cosine_background_strong"), F.count_if(F.col("tier") == "strong").alias("calibrated_strong"))


@query("candidate_counts", f"WITH {_HITS} SELECT query_id, count(*) AS candidates FROM h WHERE score >= 0.49 GROUP BY query_id")
def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits over the absolute floor, which is applied before any evidence is looked at."""
    return _hits(spark, d).where("score >= 0.49").groupBy("query_id").agg(F.count("*").alias("candidates"))


@query("classify_golden", "SELECT * FROM (VALUES (1,'strong'),(2,'weak'),(3,'strong'),(4,'weak'),(5,'weak'),(6,'discard'),(7,'discard'),(8,'discard'),(9,'weak'),(10,'discard')) t(id, tier)")
def classify_golden(spark: SparkSession, d: str) -> DataFrame:
    nan = float("nan")
    rows = [(1, 0.51, 5.0, 0.35), (2, 0.51, 4.99, 0.35), (3, 0.55, 5.5, 0.0), (4, 0.54, 5.5, 0.0), (5, 0.49, None, 0.35), (6, 0.49, 9.0, 0.34), (7, nan, 9.0, 1.0), (8, 0.24, 9.0, 1.0), (9, 0.6, nan, 0.4), (10, 0.6, None, 0.1)]
    r = spark.createDataFrame(rows, "id int, s double, z double, k double")
    return r.select("id", search.classify(F.col("s"), F.col("z"), F.col("k")).alias("tier"))


_WEAK = [(1, 1, 10, 0.70, "clear", "도로교통법", True), (1, 2, 11, 0.58, None, "도로교통법", True), (1, 3, 12, 0.57, None, "도로교통법", False), (1, 4, 13, 0.56, None, "형법", True), (1, 5, 11, 0.50, None, "도로교통법", True), (1, 6, 14, 0.44, None, "도로교통법", True), (2, 1, 20, 0.59, "clear", "민법", True), (2, 2, 21, 0.50, None, "민법", True), (3, 1, 30, 0.65, "clear", None, True), (3, 2, 31, 0.50, None, None, True)]


@query("weak_recovery_golden", "SELECT * FROM (VALUES (1, 2, 11)) t(query_id, rank, notice_num)")
def weak_recovery_golden(spark: SparkSession, d: str) -> DataFrame:
    hits = spark.createDataFrame(_WEAK, "query_id int, rank int, notice_num int, score double, tier string, law string, evidence boolean")
    return search.recover_weak(hits, least=0.6)


_LAB = f"WITH {_HITS}, n AS (SELECT query_id, label AS notice_num, min(rank) AS rank, max(score) AS score FROM h GROUP BY query_id, label)"


@query("notice_rank_eval", _LAB + ", p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, notice_num) AS place FROM n) SELECT v.id AS query_id, p.place AS rank FROM v LEFT JOIN p ON p.query_id = v.id AND p.notice_num = v.label WHERE v.id % 20 = 0")
def notice_rank_eval(spark: SparkSession, d: str) -> DataFrame:
    """Place of the first hit group with the query's own label; labels stand in for notices."""
    q = _vectors(spark, d)[0].select(F.col("id").alias("query_id"), F.col("label").alias("notice_num"))
    return search.first_relevant(_hits(spark, d).withColumnRenamed("label", "notice_num"), q).select("query_id", F.col("rank").cast("bigint").alias("rank"))


@query("recall_mrr_by_kind", _LAB + ", p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, notice_num) AS place FROM n), r AS (SELECT v.label AS kind, p.place AS rank FROM v LEFT JOIN p ON p.query_id = v.id AND p.notice_num = v.label WHERE v.id % 20 = 0) SELECT kind, count(*) AS n, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS recall_1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) AS recall_3, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM r GROUP BY ROLLUP(kind)")
def recall_mrr_by_kind(spark: SparkSession, d: str) -> DataFrame:
    q = _vectors(spark, d)[0].select(F.col("id").alias("query_id"), F.col("label").alias("notice_num"))
    ranks = search.first_relevant(_hits(spark, d).withColumnRenamed("label", "notice_num"), q).join(q.withColumnRenamed("notice_num", "kind"), "query_id")
    return search.rank_summary(ranks, "kind").withColumn("mrr", F.round("mrr", 9))


@query("tier_notice_lists", f"WITH {_HITS}, t AS (SELECT query_id, label AS notice_num, rank, CASE WHEN score >= 0.45 THEN 'strong' WHEN score >= 0.25 THEN 'weak' END AS tier FROM h), b AS (SELECT query_id, tier, notice_num, min(rank) AS rank FROM t WHERE tier IS NOT NULL GROUP BY ALL), k AS (SELECT * FROM b WHERE tier = 'strong' OR NOT EXISTS (SELECT 1 FROM b s WHERE s.tier = 'strong' AND s.query_id = b.query_id AND s.notice_num = b.notice_num)) SELECT query_id, tier, place, notice_num FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY rank, notice_num)::INTEGER AS place FROM k) WHERE place <= 3")
def tier_notice_lists(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("score") >= 0.45, "strong").when(F.col("score") >= 0.25, "weak")
    return search.first_notices(_hits(spark, d).withColumnRenamed("label", "notice_num").withColumn("tier", tier).where("tier IS NOT NULL"), 3)


@query("prefix_widening", f"WITH {_HITS}, w AS (SELECT DISTINCT query_id, least(9 * (2 ** i)::INTEGER, c)::INTEGER AS win, c FROM (SELECT query_id, count(*) AS c FROM h GROUP BY query_id), unnest(range(0, 12)) u(i)), st AS (SELECT w.query_id, win, c, count(DISTINCT CASE WHEN score >= 0.45 THEN label END) AS strong, count(*) FILTER (WHERE score >= 0.25) AS served FROM w JOIN h ON h.query_id = w.query_id AND h.rank <= win GROUP BY ALL) SELECT query_id, min(win) AS \"window\" FROM st WHERE strong >= 3 OR served < win OR win >= c GROUP BY query_id")
def prefix_widening(spark: SparkSession, d: str) -> DataFrame:
    return search.widened_window(_hits(spark, d).withColumnRenamed("label", "notice_num"), 0.45, 0.25, 3)


_POLICIES = {"baseline": (0.25, 0.45), "minimum_only": (0.45, 0.45), "equal_049": (0.49, 0.49), "prior_cosine_only": (0.49, 0.51)}
_REPLAY = f"WITH {_HITS}, p AS (SELECT * FROM (VALUES ('baseline', 0.25, 0.45), ('minimum_only', 0.45, 0.45), ('equal_049', 0.49, 0.49), ('prior_cosine_only', 0.49, 0.51)) p(policy, least, strong)), o AS (SELECT policy, query_id, max(CASE WHEN score >= strong THEN 1 ELSE 0 END) AS served, max(CASE WHEN score >= strong AND h.label = q.label THEN 1 ELSE 0 END) AS hit, max(CASE WHEN score >= least THEN 0 ELSE 1 END) AS x, 1 - max(CASE WHEN score >= least THEN 1 ELSE 0 END) AS blocked, any_value(q.label) AS topic FROM h JOIN v q ON q.id = h.query_id, p GROUP BY policy, query_id)"


def _replay(spark: SparkSession, d: str) -> DataFrame:
    """One row per policy and query: whether anything was served strong, whether the own label was, whether nothing was."""
    own = _vectors(spark, d)[0].select(F.col("id").alias("query_id"), F.col("label").alias("topic"))
    policies = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(a).alias("least"), F.lit(b).alias("strong")) for p, (a, b) in _POLICIES.items()])
    h = _hits(spark, d).join(own, "query_id").select("*", F.inline(policies))
    strong = F.col("score") >= F.col("strong")
    return h.groupBy("policy", "query_id", "topic").agg(F.max(strong.cast("int")).alias("served"), F.max((strong & (F.col("label") == F.col("topic"))).cast("int")).alias("hit"), (1 - F.max((F.col("score") >= F.col("least")).cast("int"))).alias("blocked"))


@query("policy_replay_summary", _REPLAY + " SELECT policy, count(*) AS n, sum(served)::BIGINT AS served, sum(hit)::BIGINT AS hits, sum(blocked)::BIGINT AS blocked FROM o GROUP BY policy")
def policy_replay_summary(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).groupBy("policy").agg(F.count("*").alias("n"), *[F.sum(a).cast("bigint").alias(b) for a, b in (("served", "served"), ("hit", "hits"), ("blocked", "blocked"))])


_WINDOWS = f"WITH {_HITS}, p AS (SELECT * FROM (VALUES ('baseline', 0.25, 0.45), ('minimum_only', 0.45, 0.45), ('equal_049', 0.49, 0.49), ('prior_cosine_only', 0.49, 0.51)) p(policy, least, strong)), w AS (SELECT DISTINCT query_id, least(9 * (2 ** i)::INTEGER, c)::INTEGER AS win, c FROM (SELECT query_id, count(*) AS c FROM h GROUP BY query_id), unnest(range(0, 12)) u(i)), st AS (SELECT policy, w.query_id, win, c, count(DISTINCT CASE WHEN score >= strong THEN label END) AS found, count(*) FILTER (WHERE score >= least) AS served FROM w JOIN h ON h.query_id = w.query_id AND h.rank <= win, p GROUP BY ALL), pw AS (SELECT policy, query_id, min(win) AS win FROM st WHERE found >= 3 OR served < win OR win >= c GROUP BY ALL), r AS (SELECT 'fixed' AS kind, policy, least, strong, h.* FROM h, p UNION ALL SELECT 'prefix', policy, least, strong, h.* FROM h JOIN pw USING (query_id) JOIN p USING (policy) WHERE h.rank <= pw.win), nl AS (SELECT kind, policy, query_id, label, row_number() OVER (PARTITION BY kind, policy, query_id ORDER BY min(rank), label) AS place FROM r WHERE score >= strong GROUP BY kind, policy, query_id, label), o AS (SELECT kind, policy, query_id, max(CASE WHEN score >= least THEN 1 ELSE 0 END) AS served, max(CASE WHEN score >= strong THEN 1 ELSE 0 END) AS confident FROM r GROUP BY ALL)"


@query("policy_replay_windows", _WINDOWS + " SELECT kind, policy, count(*) AS n, sum(1 - served)::BIGINT AS blocked, sum(1 - confident)::BIGINT AS no_strong, count(x.query_id) AS hits FROM o LEFT JOIN (SELECT kind, policy, query_id FROM nl JOIN v ON v.id = nl.query_id AND v.label = nl.label WHERE place <= 3) x USING (kind, policy, query_id) GROUP BY kind, policy")
def policy_replay_windows(spark: SparkSession, d: str) -> DataFrame:
    """The policies over the fixed window of hits and over the prefix a caller would end with."""
    hits = _hits(spark, d).withColumnRenamed("label", "notice_num")
    own = _vectors(spark, d)[0].select(F.col("id").alias("query_id"), F.col("label").alias("topic"))
    return search.replay_windows(hits, own, _POLICIES, 3)


@query("wilson_ci", _REPLAY + ", c AS (SELECT policy, sum(hit)::DOUBLE AS k, count(*)::DOUBLE AS n FROM o GROUP BY policy) SELECT policy, round(greatest(0.0, (k/n + 1.959964*1.959964/(2*n)) / (1 + 1.959964*1.959964/n) - 1.959964*sqrt(k/n*(1-k/n)/n + 1.959964*1.959964/(4*n*n)) / (1 + 1.959964*1.959964/n)), 4) AS low, round(least(1.0, (k/n + 1.959964*1.959964/(2*n)) / (1 + 1.959964*1.959964/n) + 1.959964*sqrt(k/n*(1-k/n)/n + 1.959964*1.959964/(4*n*n)) / (1 + 1.959964*1.959964/n)), 4) AS high FROM c")
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return _replay(spark, d).groupBy("policy").agg(F.sum("hit").alias("k"), F.count("*").alias("n")).select("policy", low.alias("low"), high.alias("high"))


@query("mcnemar_exact", _REPLAY + ", j AS (SELECT a.policy, count(*) FILTER (WHERE a.hit > b.hit) AS improved, count(*) FILTER (WHERE a.hit < b.hit) AS regressed FROM o a JOIN o b ON b.policy = 'baseline' AND a.query_id = b.query_id WHERE a.policy <> 'baseline' GROUP BY a.policy), t AS (SELECT *, improved + regressed AS n, least(improved, regressed) AS m FROM j) SELECT policy, improved, regressed, round(least(1.0, 2 * list_sum(list_transform(range(0, m + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))), 9) AS p FROM t")
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    r = _replay(spark, d)
    base = r.where("policy = 'baseline'").select("query_id", F.col("hit").alias("before"))
    j = r.where("policy <> 'baseline'").join(base, "query_id").groupBy("policy").agg(F.count_if(F.col("hit") > F.col("before")).alias("improved"), F.count_if(F.col("hit") < F.col("before")).alias("regressed"))
    return j.withColumn("p", F.round(stats.mcnemar(F.col("improved"), F.col("regressed")), 9))


@query("mcnemar_golden", "SELECT * FROM (VALUES (0, 0, 1.0::DOUBLE), (3, 0, 0.25::DOUBLE), (5, 1, 0.21875::DOUBLE), (30, 0, 2 / 2.0 ** 30)) t(wins, losses, p)")
def mcnemar_golden(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame([(0, 0), (3, 0), (5, 1), (30, 0)], "wins int, losses int")
    return r.withColumn("p", stats.mcnemar(F.col("wins"), F.col("losses")))


@query("cluster_signflip", _REPLAY + ", d AS (SELECT a.policy, a.topic, sum(a.hit - b.hit)::BIGINT AS delta FROM o a JOIN o b ON b.policy = 'baseline' AND a.query_id = b.query_id WHERE a.policy <> 'baseline' GROUP BY a.policy, a.topic), g AS (SELECT policy, coalesce(list(delta) FILTER (WHERE delta <> 0), []) AS x FROM d GROUP BY policy) SELECT policy, avg(CASE WHEN abs(coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (pattern >> (i - 1)) % 2 = 1 THEN x[i] ELSE -x[i] END)), 0)) >= abs(coalesce(list_sum(x), 0)) THEN 1.0 ELSE 0.0 END) AS p FROM g, unnest(range(0, (2 ** len(x))::BIGINT)) u(pattern) GROUP BY policy")
def cluster_signflip(spark: SparkSession, d: str) -> DataFrame:
    """Sign-flip test of each policy against the baseline over the topics' differences."""
    r = _replay(spark, d)
    base = r.where("policy = 'baseline'").select("query_id", F.col("hit").alias("before"))
    by = r.where("policy <> 'baseline'").join(base, "query_id").groupBy("policy", "topic").agg(F.sum(F.col("hit") - F.col("before")).alias("delta"))
    return by.groupBy("policy").agg(F.collect_list("delta").alias("deltas")).select("policy", stats.sign_flip(F.col("deltas")).alias("p"))


@query("signflip_golden", "SELECT * FROM (VALUES ('none', 1.0::DOUBLE), ('two up', 0.5::DOUBLE), ('mixed', 1.0::DOUBLE), ('three up', 0.25::DOUBLE)) t(name, p)")
def signflip_golden(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame([("none", [0, 0]), ("two up", [1, 1]), ("mixed", [1, -1]), ("three up", [2, 1, 3])], "name string, deltas array<bigint>")
    return r.select("name", stats.sign_flip(F.col("deltas")).alias("p"))


@query("probe_summary_by_category", f"WITH {_HITS}, t AS (SELECT query_id, any_value(q.label) AS category, max(score) AS top1, count(*) FILTER (WHERE score >= 0.45) AS clear, count(DISTINCT CASE WHEN score >= 0.25 THEN h.label END) AS kept FROM h JOIN v q ON q.id = h.query_id GROUP BY query_id) SELECT category, count(*) AS n, count(*) FILTER (WHERE clear > 0) AS served, round(avg(top1), 4) AS mean_top1, round(avg(kept), 4) AS mean_kept FROM t GROUP BY category")
def probe_summary_by_category(spark: SparkSession, d: str) -> DataFrame:
    own = _vectors(spark, d)[0].select(F.col("id").alias("query_id"), F.col("label").alias("category"))
    t = _hits(spark, d).join(own, "query_id").groupBy("query_id", "category").agg(F.max("score").alias("top1"), F.count_if(F.col("score") >= 0.45).alias("clear"), F.countDistinct(F.when(F.col("score") >= 0.25, F.col("label"))).alias("kept"))
    return t.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("clear") > 0).alias("served"), F.round(F.avg("top1"), 4).alias("mean_top1"), F.round(F.avg("kept"), 4).alias("mean_kept"))


@query("search_responses", f"""WITH {_HITS} SELECT query_id, '{{"results":[' || string_agg('{{"rank":' || rank || ',"hit_id":' || hit_id || ',"score":' || score || CASE WHEN score >= 0.45 THEN ',"tier":"clear"' WHEN score >= 0.25 THEN ',"tier":"weak"' ELSE '' END || '}}', ',' ORDER BY rank) || ']}}' AS response FROM h WHERE rank <= 10 GROUP BY query_id""")
def search_responses(spark: SparkSession, d: str) -> DataFrame:
    """Each query's ten hits as one JSON response."""
    from inkstone.sources.io import to_response

    return to_response(_hits(spark, d, 10).withColumn("tier", search.cosine_tier(F.col("score"))).select("query_id", "rank", "hit_id", "score", "tier"))
