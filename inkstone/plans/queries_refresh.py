"""Queries over refresh plans, capabilities, case sets, metrics and streams."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.config import KOREAN
from inkstone.functions import embedding, text
from inkstone.functions.sql import register
from inkstone.operators import capability, chunking, incremental, metrics
from inkstone.plans import chunk_sql
from inkstone.plans.queries_text import CHUNKS, NOTED, NOTICES, SUMMARIES, notices, summaries
from inkstone.plans.registry import query
from inkstone.session import materialize, table
from inkstone.streaming.refresh import event_windows

_LAST = "SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY snapshot_date) AS snap, max(snap_no) OVER () AS snaps FROM (SELECT *, dense_rank() OVER (ORDER BY snapshot_date) AS snap_no, row_number() OVER (PARTITION BY snapshot_date, notice_num ORDER BY loaded_at DESC NULLS LAST) AS rn FROM gate_snapshots) WHERE rn = 1)"
_PAIR = f"WITH l AS ({_LAST}), f AS (SELECT snap_no, snaps, notice_num, sha256(coalesce(subject,'') || chr(0) || coalesce(committee,'') || chr(0) || coalesce(proposal_reason,'') || chr(0) || coalesce(ai_summary,'')) AS fp FROM l), n AS (SELECT notice_num, fp FROM f WHERE snap_no = snaps), o AS (SELECT notice_num, fp FROM f WHERE snap_no = 1), j AS (SELECT coalesce(n.notice_num, o.notice_num) AS notice_num, CASE WHEN o.notice_num IS NULL THEN 'added' WHEN n.notice_num IS NULL THEN 'deleted' WHEN n.fp = o.fp THEN 'same' ELSE 'updated' END AS action FROM n FULL JOIN o USING (notice_num))"


def _delivery(spark: SparkSession, d: str, last: bool) -> DataFrame:
    """The first or last delivery, one row per notice: the one loaded last."""
    g = table(spark, d, "gate_snapshots")
    when = g.agg((F.max if last else F.min)("snapshot_date")).first()[0]
    rows = g.where(F.col("snapshot_date") == F.lit(when))
    return rows.groupBy("notice_num").agg(F.max_by(F.struct("subject", "proposer_category", "committee", "proposal_reason", "ai_summary"), "loaded_at").alias("r")).select("notice_num", "r.*")


def _fingerprint(df: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("subject", "committee", "proposal_reason", "ai_summary")]
    return df.select("notice_num", F.sha2(F.concat_ws("\x00", *parts), 256).alias("fingerprint"))


def _notice_plan(spark: SparkSession, d: str) -> DataFrame:
    return incremental.notice_plan(_fingerprint(_delivery(spark, d, True)), _fingerprint(_delivery(spark, d, False)))


@query("update_plan_notices", _PAIR + " SELECT notice_num, action FROM j")
def update_plan_notices(spark: SparkSession, d: str) -> DataFrame:
    """What the last delivery changes against the first."""
    return _notice_plan(spark, d)


@query("shrink_guard", _PAIR + " SELECT count(*) FILTER (WHERE action = 'deleted') AS deleted, count(*) FILTER (WHERE action <> 'added') AS before, (count(*) FILTER (WHERE action = 'deleted')) > 100 AND 5 * (count(*) FILTER (WHERE action = 'deleted')) > (count(*) FILTER (WHERE action <> 'added')) AS refused FROM j")
def shrink_guard(spark: SparkSession, d: str) -> DataFrame:
    counted = _notice_plan(spark, d).agg(F.count_if(F.col("action") == "deleted").alias("deleted"), F.count_if(F.col("action") != "added").alias("before"))
    return counted.withColumn("refused", incremental.refuses_shrink(F.col("deleted"), F.col("before")))


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of the first and last delivery with digests, and the plan between them."""
    old, new = (chunking.chunk_notices(_delivery(spark, d, last)).withColumn("digest", text.digest("chunk_id", "subject", "text")) for last in (False, True))
    old, new = materialize(old, "old-chunks"), materialize(new, "new-chunks")
    return old, new, incremental.chunk_plan(new, old)


_OLD, _NEW = f"SELECT * FROM ({_LAST}) WHERE snap_no = 1", f"SELECT * FROM ({_LAST}) WHERE snap_no = snaps"
_TWO = f"WITH RECURSIVE {chunk_sql.chunks(_OLD, 'a_')}, {chunk_sql.chunks(_NEW, 'b_')}"


@query("update_plan_chunks", _TWO + " SELECT CASE WHEN b.chunk_id IS NULL THEN 'drop' WHEN a.digest = b.digest THEN 'reuse' ELSE 'embed' END AS action, count(*) AS chunks FROM b_chunks b FULL JOIN a_chunks a ON a.chunk_id = b.chunk_id GROUP BY action")
def update_plan_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks to embed, to reuse and to drop when the last delivery follows the first."""
    return _plan(spark, d)[2].groupBy("action").agg(F.count("*").alias("chunks"))


@query("stored_digest_plan", "WITH s AS (SELECT chunk_id, max(digest) AS digest FROM chunk_embeddings GROUP BY chunk_id), n AS (SELECT chunk_id, max(sha256(coalesce(text,''))) AS digest FROM chunks GROUP BY chunk_id) SELECT CASE WHEN n.chunk_id IS NULL THEN 'drop' WHEN n.digest = s.digest THEN 'reuse' ELSE 'embed' END AS action, count(*) AS chunks FROM n FULL JOIN s USING (chunk_id) GROUP BY action")
def stored_digest_plan(spark: SparkSession, d: str) -> DataFrame:
    """The delivered chunks against the digests stored with their vectors."""
    new = table(spark, d, "chunks").groupBy("chunk_id").agg(F.max(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    stored = table(spark, d, "chunk_embeddings").groupBy("chunk_id").agg(F.max("digest").alias("digest"))
    return incremental.chunk_plan(new, stored).groupBy("action").agg(F.count("*").alias("chunks"))


@query("merge_vectors", "WITH s AS (SELECT chunk_id, max(embedding) AS e FROM chunk_embeddings WHERE embedding IS NOT NULL GROUP BY chunk_id), n AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS r FROM s) SELECT chunk_id, CASE WHEN substr(sha256(chunk_id), 1, 1) < '4' THEN round(-s.e[1]::DOUBLE, 6) ELSE round(s.e[1]::DOUBLE, 6) END AS first FROM s")
def merge_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the vectors made anew (here: negated), the others taken from the store."""
    stored = table(spark, d, "chunk_embeddings").where("embedding IS NOT NULL").groupBy("chunk_id").agg(F.max("embedding").alias("embedding"))
    again = F.substring(F.sha2("chunk_id", 256), 1, 1) < "4"
    plan = stored.select("chunk_id", F.when(again, "embed").otherwise("reuse").alias("action"))
    fresh = stored.where(again).select("chunk_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    merged = incremental.merge_vectors(plan, fresh, stored)
    return merged.select("chunk_id", F.round(F.try_element_at("embedding", F.lit(1)).cast("double"), 6).alias("first"))


@query("incremental_equals_full", "WITH RECURSIVE " + chunk_sql.chunks(_NEW) + " SELECT count(*) AS chunks, 0::BIGINT AS differing FROM chunks")
def incremental_equals_full(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the last delivery, and those whose merged vector differs from one embedded from scratch: none."""
    embed = embedding.hashing_embedder(64)
    old, new, plan = _plan(spark, d)
    stored = embedding.embed_chunks(old, embed)
    fresh = embedding.embed_chunks(new.join(plan.where("action = 'embed'"), "chunk_id", "left_semi"), embed)
    full = embedding.embed_chunks(new, embed).withColumnRenamed("embedding", "whole")
    both = incremental.merge_vectors(plan, fresh, stored).join(full, "chunk_id", "full")
    return both.agg(F.count("*").alias("chunks"), F.count_if(~F.col("embedding").eqNullSafe(F.col("whole"))).alias("differing"))


#: CRC-32 by its table, over the bytes of every distinct run of three characters.
_CRC = f"""
WITH k AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
e AS (SELECT DISTINCT chunk_id, {chunk_sql.squashed("CASE WHEN s = '' OR starts_with(text, s) THEN text ELSE s || chr(10) || text END")} AS x FROM (SELECT chunk_id, text, {chunk_sql.trimmed("coalesce(subject, '')")} AS s FROM chunks)),
g AS (SELECT chunk_id, x, substr(x, i, 3) AS gram FROM e, unnest(range(1, length(x) - 1)) u(i)),
b AS (SELECT gram, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS b FROM (SELECT DISTINCT gram, hex(encode(gram)) AS h FROM g)),
c AS (SELECT gram, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) % 256) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 512 AS bucket FROM b, k)
"""


@query("hashing_embed_rows", _CRC + "SELECT e.chunk_id, count(DISTINCT bucket)::INTEGER AS used, CASE WHEN count(bucket) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM e LEFT JOIN g USING (chunk_id, x) LEFT JOIN c USING (gram) GROUP BY e.chunk_id, e.x")
def hashing_embed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Trigram vectors of the delivered chunks: elements used and length."""
    e = table(spark, d, "chunks").select("chunk_id", "subject", "text").distinct().select("chunk_id", embedding.hashing_embedder()(text.compose("subject", "text")).alias("v"))
    return e.select("chunk_id", F.size(F.filter("v", lambda x: x != 0)).alias("used"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4).alias("norm"))


def _noted(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).join(summaries(spark, d), "notice_num", "left").fillna("")


def _index(spark: SparkSession, d: str, derived: bool = True) -> DataFrame:
    n = _noted(spark, d)
    return capability.capability_index(n, chunking.chunk_notices(n, summaries=derived))


@query("capability_index", CHUNKS + ", " + chunk_sql.capabilities("f", NOTED) + " SELECT capability, count(*) AS notices FROM f GROUP BY capability")
def capability_index(spark: SparkSession, d: str) -> DataFrame:
    """Notices per capability of the chunks as they are cut now."""
    return capability.report(_index(spark, d))


@query("capability_indexed_all", f"SELECT count(*) AS notices FROM ({NOTICES})")
def capability_indexed_all(spark: SparkSession, d: str) -> DataFrame:
    """Every notice has at least one chunk."""
    return _index(spark, d).where("capability = 'indexed'").agg(F.count("*").alias("notices"))


@query("capability_derived", f"SELECT count(*) AS notices FROM ({SUMMARIES}) WHERE regexp_replace(ai_summary, '[\\s\\p{{Z}}]+', '', 'g') <> ''")
def capability_derived(spark: SparkSession, d: str) -> DataFrame:
    """Every notice with a summary has it among its chunks."""
    return _index(spark, d).where("capability = 'derived:ai_summary'").agg(F.count("*").alias("notices"))


_BARE = f"SELECT *, NULL::VARCHAR AS ai_summary FROM ({NOTICES})"
_BOTH = "WITH RECURSIVE " + ", ".join((chunk_sql.chunks(_BARE, "a_"), chunk_sql.chunks(NOTED, "b_"), chunk_sql.capabilities("f", NOTED, "a_"), chunk_sql.capabilities("g", NOTED, "b_")))


@query("derived_field_diff", _BOTH + " SELECT change, capability, count(*) AS pairs FROM (SELECT 'lost' AS change, * FROM (SELECT * FROM f EXCEPT SELECT * FROM g) UNION ALL SELECT 'gained', * FROM (SELECT * FROM g EXCEPT SELECT * FROM f)) GROUP BY change, capability")
def derived_field_diff(spark: SparkSession, d: str) -> DataFrame:
    """Capabilities that adding summaries costs, of which there must be none, and those it brings."""
    diff = capability.capability_diff(_index(spark, d, False), _index(spark, d))
    return diff.groupBy("change", "capability").agg(F.count("*").alias("pairs"))


_DELIVERED = "(SELECT DISTINCT notice_num, chunk_index, text, section FROM chunks_given)"


@query("capability_diff_delivered", "WITH RECURSIVE chunks_given AS (SELECT * FROM chunks), " + chunk_sql.chunks(NOTED, "a_") + ", " + chunk_sql.capabilities("f", NOTED, "a_") + ", " + chunk_sql.capabilities("g", NOTED, "a_", _DELIVERED) + ", k AS (SELECT notice_num FROM f INTERSECT SELECT notice_num FROM g) SELECT change, capability, count(*) AS notices FROM (SELECT 'lost' AS change, * FROM (SELECT * FROM f EXCEPT SELECT * FROM g) UNION ALL SELECT 'gained', * FROM (SELECT * FROM g EXCEPT SELECT * FROM f)) WHERE notice_num IN (SELECT notice_num FROM k) GROUP BY change, capability")
def capability_diff_delivered(spark: SparkSession, d: str) -> DataFrame:
    """What the delivered chunks lost and gained against those cut now, over the notices both have."""
    now = _index(spark, d)
    n = _noted(spark, d)
    c = table(spark, d, "chunks").join(n.select("notice_num"), "notice_num", "left_semi")
    delivered = capability.capability_index(n, c.select("notice_num", "chunk_index", "text", "section").distinct())
    return capability.capability_diff(now, delivered).groupBy("change", "capability").agg(F.count("*").alias("notices"))


_JUDGED = "WITH RECURSIVE chunks_given AS (SELECT * FROM chunks), " + chunk_sql.chunks(NOTED, "a_") + ", " + chunk_sql.capabilities("f", NOTED, "a_") + ", " + chunk_sql.capabilities("g", NOTED, "a_", _DELIVERED) + ", k AS (SELECT notice_num FROM f INTERSECT SELECT notice_num FROM g), j AS (SELECT (SELECT count(*) FROM (SELECT * FROM f WHERE notice_num IN (FROM k) EXCEPT SELECT * FROM g)) AS lost, (SELECT count(*) FROM (SELECT * FROM g WHERE notice_num IN (FROM k) EXCEPT SELECT * FROM f)) AS gained, (SELECT count(*) FROM (SELECT notice_num FROM f EXCEPT SELECT notice_num FROM g)) AS only_baseline, (SELECT count(*) FROM (SELECT notice_num FROM g EXCEPT SELECT notice_num FROM f)) AS only_candidate, (SELECT count(*) FROM (SELECT chunk_id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT chunk_id, count(*) n FROM chunks_given GROUP BY 1) a FULL JOIN (SELECT chunk_id, count(*) n FROM chunk_embeddings GROUP BY 1) b USING (chunk_id)) WHERE x <> y) AS mismatches)"


@query("capability_verdict", _JUDGED + " SELECT *, CASE WHEN mismatches > 0 THEN 2 WHEN lost > 0 THEN 1 ELSE 0 END AS exit_code FROM j")
def capability_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The release check of the delivered chunks and vectors against chunks cut now."""
    n, c = _noted(spark, d), table(spark, d, "chunks")
    delivered = capability.capability_index(n, c.select("notice_num", "chunk_index", "text", "section").distinct())
    return capability.verdict(_index(spark, d), delivered, capability.id_mismatches(c, table(spark, d, "chunk_embeddings"), "chunk_id"))


@query("artifact_integrity", "SELECT * FROM (SELECT chunk_id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM (SELECT chunk_id, count(*) n FROM chunks GROUP BY 1) a FULL JOIN (SELECT chunk_id, count(*) n FROM chunk_embeddings GROUP BY 1) b USING (chunk_id)) WHERE n_left <> n_right")
def artifact_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and vectors that don't match one to one."""
    return capability.id_mismatches(table(spark, d, "chunks"), table(spark, d, "chunk_embeddings"), "chunk_id")


@query("holdout_split_antijoin", "SELECT DISTINCT query_id FROM eval_holdout_queries h WHERE NOT EXISTS (SELECT 1 FROM eval_queries e WHERE e.notice_num = h.notice_num) AND NOT EXISTS (SELECT 1 FROM eval_queries e WHERE regexp_replace(trim(e.query), '\\s+', ' ', 'g') = regexp_replace(trim(h.query), '\\s+', ' ', 'g'))")
def holdout_split_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Holdout queries that share neither notice nor wording with the calibration queries."""
    plain = F.regexp_replace(F.trim("query"), r"\s+", " ")
    used = table(spark, d, "eval_queries")
    rest = table(spark, d, "eval_holdout_queries").withColumn("plain", plain).join(used.select("notice_num").distinct(), "notice_num", "left_anti")
    return rest.join(used.select(plain.alias("plain")).distinct(), "plain", "left_anti").select("query_id").distinct()


@query("case_set_union", "SELECT kind, count(*) AS cases, count(DISTINCT notice_num) AS notices FROM (SELECT DISTINCT query_id, notice_num, kind FROM eval_queries UNION ALL SELECT DISTINCT query_id, notice_num, kind FROM eval_holdout_queries) GROUP BY kind")
def case_set_union(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "eval_queries").unionByName(table(spark, d, "eval_holdout_queries"), allowMissingColumns=True)
    return both.select("query_id", "notice_num", "kind").distinct().groupBy("kind").agg(F.count("*").alias("cases"), F.countDistinct("notice_num").alias("notices"))


@query("latency_percentiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("timing_pairs", "WITH p AS (SELECT user_id, avg(value) FILTER (WHERE event_id % 2 = 0) AS a, avg(value) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY user_id) SELECT count(*) AS pairs, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(quantile_cont(a, 0.5), 6) AS p50_a, round(quantile_cont(b, 0.5), 6) AS p50_b, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END), 6) AS b_faster, round(avg(a - b), 6) AS mean_saved FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def timing_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two variants that take turns, paired by user: events of even and of odd number."""
    side = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    found = metrics.timing_pairs(table(spark, d, "events").groupBy("user_id").agg(side(0).alias("a"), side(1).alias("b")))
    return found.select("pairs", *[F.round(c, 6).alias(c) for c in found.columns if c != "pairs"])


@query("exact_fingerprint", "SELECT sha256(string_agg(line, '' ORDER BY chunk_id, line)) AS fingerprint FROM (SELECT DISTINCT chunk_id, chunk_id || chr(0) || CASE WHEN s = '' OR starts_with(text, s) THEN text ELSE s || chr(10) || text END || chr(10) AS line FROM (SELECT chunk_id, text, " + chunk_sql.trimmed("coalesce(subject, '')") + " AS s FROM chunks))")
def exact_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The one digest over the bytes of all chunks in order; the tree of ``set_fingerprint`` is the value that scales."""
    return spark.createDataFrame([(incremental.exact_fingerprint(table(spark, d, "chunks")),)], "fingerprint string")


@query("sql_surface", f"SELECT doc_id, sha256({chunk_sql.cleaned('text')}) AS cleaned, length({chunk_sql.squashed('text')})::INTEGER AS signs, len(list_distinct(regexp_extract_all(lower(text), '[0-9a-z가-힣]{{2,}}')))::INTEGER AS tokens FROM documents WHERE text IS NOT NULL")
def sql_surface(spark: SparkSession, d: str) -> DataFrame:
    """The functions called from SQL."""
    register(spark, dataclasses.replace(KOREAN, stop_tokens=()))
    return spark.sql("SELECT doc_id, sha2(clean_text(text), 256) AS cleaned, length(squash(text)) AS signs, size(content_tokens(text)) AS tokens FROM {docs} WHERE text IS NOT NULL", docs=table(spark, d, "documents"))


@query("committee_counts", f"SELECT regexp_replace(committee, '^\\s+|\\s+$', '', 'g') AS committee, proposer_category, count(*) AS notices FROM ({NOTICES}) GROUP BY ALL")
def committee_counts(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).groupBy(F.regexp_replace("committee", r"^\s+|\s+$", "").alias("committee"), "proposer_category").agg(F.count("*").alias("notices"))


@query("notice_set_operations", "WITH a AS (SELECT DISTINCT notice_num FROM chunks), b AS (SELECT DISTINCT notice_num FROM train_queries WHERE notice_num IS NOT NULL) SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_chunks, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_queries")
def notice_set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "chunks").select("notice_num").distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "train_queries").where("notice_num IS NOT NULL").select("notice_num").distinct().withColumn("b", F.lit(1))
    j = a.join(b, "notice_num", "full")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("only_chunks"), F.count_if(F.col("a").isNull()).alias("only_queries"))


@query("stream_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts per event type, run as a stream (beyond the reference, which has no event time)."""
    return event_windows(spark, d, "events").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
