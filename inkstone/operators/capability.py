"""What a chunk set can answer about its notices, and what one set lost or gained against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators.chunking import sections_of

#: Columns a notice may have: what names it, its learning text, and fields derived from it.
REGISTERED = {"notice_num", "subject", "proposer_category", "committee", "proposal_reason", "ai_summary"}
DERIVED = ("ai_summary",)


def unregistered(notices: DataFrame) -> set[str]:
    """Columns no check knows of."""
    return set(notices.columns) - REGISTERED


def capability_index(notices: DataFrame, chunks: DataFrame) -> DataFrame:
    """(``capability``, ``notice_num``): ``indexed``, ``title_text``, ``section:<label>``, ``derived:<field>``.

    A section counts if the notice has it and a chunk carries its label; a title or derived field if the chunks'
    texts hold it, white space aside. Notices without chunks have no capability.
    """
    texts = chunks.groupBy("notice_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "").alias("all"), F.collect_set("section").alias("carried"))
    derived = [c for c in DERIVED if c in notices.columns]
    n = notices.select("notice_num", T.squash("subject").alias("title"), F.array_distinct(F.transform(sections_of(T.clean_text("proposal_reason")), lambda s: s["section"])).alias("own"), *[T.squash(c).alias(f"d_{c}") for c in derived])
    j = n.join(texts.withColumn("all", T.squash("all")), "notice_num")
    holds = lambda c: (F.col(c) != "") & F.contains(F.col("all"), F.col(c))
    found = [F.array(F.lit("indexed")), F.when(holds("title"), F.array(F.lit("title_text"))).otherwise(F.array().cast("array<string>")), F.transform(F.array_intersect("own", "carried"), lambda s: F.concat(F.lit("section:"), s))]
    found += [F.when(holds(f"d_{c}"), F.array(F.lit(f"derived:{c}"))).otherwise(F.array().cast("array<string>")) for c in derived]
    return j.select(F.explode(F.concat(*found)).alias("capability"), "notice_num").distinct()


def capability_diff(baseline: DataFrame, candidate: DataFrame, common_only: bool = True) -> DataFrame:
    """(``change``, ``capability``, ``notice_num``): ``lost`` and ``gained`` by the candidate.

    With ``common_only`` just the notices both know are compared, so a grown collection isn't a gain.
    """
    if common_only:
        both = baseline.select("notice_num").intersect(candidate.select("notice_num"))
        baseline, candidate = (x.join(both, "notice_num", "left_semi") for x in (baseline, candidate))
    on = ["capability", "notice_num"]
    lost = baseline.join(candidate, on, "left_anti").select(F.lit("lost").alias("change"), *on)
    return lost.unionByName(candidate.join(baseline, on, "left_anti").select(F.lit("gained").alias("change"), *on))


def id_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, ``n_left``, ``n_right``) of ids that don't occur equally often on both sides."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    zero = F.lit(0).cast("bigint")
    return a.join(b, key, "full").select(key, F.coalesce("n_left", zero).alias("n_left"), F.coalesce("n_right", zero).alias("n_right")).where("n_left <> n_right")


def report(index: DataFrame) -> DataFrame:
    """Notices per capability, in the order indexed, title, sections, derived fields."""
    order = F.when(F.col("capability") == "indexed", 0).when(F.col("capability") == "title_text", 1).when(F.col("capability").startswith("section:"), 2).otherwise(3)
    return index.groupBy("capability").agg(F.count("*").alias("notices")).withColumn("place", order).orderBy("place", "capability").drop("place")


SCHEMA = "capability string, notice_num bigint"


def save_baseline(index: DataFrame, path: str) -> None:
    """A capability index as JSON lines, to compare later builds with."""
    index.select("capability", "notice_num").write.json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A saved index; lines of another schema, missing values and an empty file are errors."""
    df = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    bad = df.where("capability IS NULL OR notice_num IS NULL").count()
    if bad or df.isEmpty():
        raise ValueError(f"{path}: {bad} lines lack a value" if bad else f"{path}: empty")
    return df


def verdict(baseline: DataFrame, candidate: DataFrame, mismatches: DataFrame | None = None) -> DataFrame:
    """One row: pairs ``lost`` and ``gained`` over the notices both know, notices ``only_baseline`` and ``only_candidate``,
    ``mismatches`` of ids between artifacts, and the ``exit_code`` of a release check: 0 if nothing is lost and all ids
    match, 1 if something is lost, 2 if ids don't match."""
    diff = capability_diff(baseline, candidate).agg(F.count_if(F.col("change") == "lost").alias("lost"), F.count_if(F.col("change") == "gained").alias("gained"))
    sides = baseline.select("notice_num").distinct().withColumn("b", F.lit(1)).join(candidate.select("notice_num").distinct().withColumn("c", F.lit(1)), "notice_num", "full")
    known = sides.agg(F.count_if(F.col("c").isNull()).alias("only_baseline"), F.count_if(F.col("b").isNull()).alias("only_candidate"))
    odd = mismatches.agg(F.count("*").alias("mismatches")) if mismatches is not None else baseline.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("mismatches"))
    one = diff.crossJoin(known).crossJoin(odd)  # a row each
    return one.withColumn("exit_code", F.when(F.col("mismatches") > 0, 2).when(F.col("lost") > 0, 1).otherwise(0))


def print_report(index: DataFrame, judged: DataFrame) -> int:
    """Prints the notices per capability and the verdict, and returns the exit code; both tables are a few rows."""
    print(" ".join(f"{r['capability']}={r['notices']}" for r in report(index).collect()))
    row = judged.first()
    print(" ".join(f"{k}={v}" for k, v in row.asDict().items()))
    return int(row["exit_code"])
