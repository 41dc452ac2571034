"""The catalogue of core queries with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import snapshots
from inkstone.plans import queries_refresh, queries_search, queries_text, queries_vector  # noqa: F401
from inkstone.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from inkstone.session import table

CONTENT = ["subject", "proposer_category", "committee", "proposal_reason", "ai_summary"]

_CHANGES = """
WITH c AS (SELECT snapshot_date, notice_num, coalesce(subject,'') a, coalesce(proposer_category,'') b, coalesce(committee,'') c, coalesce(proposal_reason,'') d, coalesce(ai_summary,'') e, loaded_at FROM gate_snapshots),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, notice_num ORDER BY loaded_at DESC NULLS LAST) rn FROM c) WHERE rn = 1),
d AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) o FROM (SELECT DISTINCT snapshot_date FROM c)),
s AS (SELECT l.*, d.o FROM l JOIN d USING (snapshot_date)),
p AS (SELECT n.snapshot_date, s.notice_num, s.a, s.b, s.c, s.d, s.e FROM s JOIN d n ON n.o = s.o + 1),
j AS (SELECT coalesce(x.snapshot_date, p.snapshot_date) sd, coalesce(x.notice_num, p.notice_num) notice_num, CASE WHEN p.notice_num IS NULL THEN 'added' WHEN x.notice_num IS NULL THEN 'removed' WHEN (x.a,x.b,x.c,x.d,x.e) <> (p.a,p.b,p.c,p.d,p.e) THEN 'changed' END change_kind FROM (SELECT * FROM s WHERE o > 1) x FULL JOIN p ON x.snapshot_date = p.snapshot_date AND x.notice_num = p.notice_num)
"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    found = snapshots.snapshot_changes(table(spark, d, "gate_snapshots"), "snapshot_date", "notice_num", CONTENT, "loaded_at")
    return found.select(F.date_format("snap", "yyyy-MM-dd").alias("snapshot_date"), F.col("key").alias("notice_num"), "change_kind")


@query("p2_found", _CHANGES + "SELECT strftime(sd, '%Y-%m-%d') AS snapshot_date, notice_num, change_kind FROM j WHERE change_kind IS NOT NULL")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


@query("p2_change_counts", _CHANGES + "SELECT strftime(sd, '%Y-%m-%d') AS snapshot_date, change_kind, count(*) AS n FROM j WHERE change_kind IS NOT NULL GROUP BY ALL")
def p2_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).groupBy("snapshot_date", "change_kind").agg(F.count("*").alias("n"))
