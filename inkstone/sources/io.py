"""Readers and writers: notices and chunks as JSON lines, a relational database, matrix files, labelled query sets."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NOTICE = "notice_num bigint, subject string, proposer_category string, committee string, proposal_reason string, ai_summary string"
CHUNK = "chunk_id string, notice_num bigint, subject string, committee string, section string, chunk_index int, text string, char_count int, sentence_count int"


def canonical_notices(df: DataFrame) -> DataFrame:
    """The six columns of a notice; nulls and missing columns as empty strings."""
    return df.select(F.col("notice_num").cast("bigint").alias("notice_num"), *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in ("subject", "proposer_category", "committee", "proposal_reason", "ai_summary")])


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return canonical_notices(spark.read.schema(NOTICE).json(path))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines with nulls kept and text unescaped."""
    df.write.option("ignoreNullFields", "false").json(path)


def scan_notices(notices: DataFrame, summaries: DataFrame, where: str | None = None, limit: int | None = None, order: str = "notice_num DESC") -> DataFrame:
    """Notices with their summary, filtered, ordered and cut; filter and columns reach the source by pushdown."""
    joined = notices.join(summaries.select("notice_num", "ai_summary"), "notice_num", "left")
    joined = canonical_notices(joined.where(where) if where else joined).orderBy(F.expr(order.rsplit(" ", 1)[0]).desc() if order.upper().endswith(" DESC") else F.expr(order))
    return joined.limit(limit) if limit is not None else joined


def stratified_sample(notices: DataFrame, per_bucket: int) -> DataFrame:
    """The newest notices of each length class: 80-400, 401-1200 and over 1200 characters."""
    from pyspark.sql import Window

    n = F.length("proposal_reason")
    bucket = F.when(n.between(80, 400), "short").when(n.between(401, 1200), "medium").when(n > 1200, "long")
    newest = Window.partitionBy("length_bucket").orderBy(F.desc("notice_num"))
    ranked = notices.withColumn("length_bucket", bucket).where("length_bucket IS NOT NULL").withColumn("_r", F.row_number().over(newest))
    return ranked.where(F.col("_r") <= per_bucket).drop("_r")


def read_labelled(spark: SparkSession, path: str, required: list[str], schema: str) -> DataFrame:
    """A labelled query set; bad lines, missing required values and an empty set are errors."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    bad = df.where(" OR ".join(f"{c} IS NULL" for c in required)).count()
    if bad or df.isEmpty():
        raise ValueError(f"{path}: {bad} rows lack one of {required}" if bad else f"{path}: empty")
    return df


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")``: options ``path``, ``query``, and ``key`` with ``partitions`` for ranges of an
    integer column, which are read in parallel. The file is opened read-only."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.query, self.key = options["path"], options["query"], options.get("key")
        self.parts, self.columns = int(options.get("partitions", "1")), [f.name for f in schema.fields]

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        if not self.key or self.parts < 2:
            return [InputPartition(None)]
        with self._connect() as db:
            low, high = db.execute(f"SELECT min({self.key}), max({self.key}) FROM ({self.query})").fetchone()
        if low is None:
            return [InputPartition(None)]
        step = (high - low) // self.parts + 1
        return [InputPartition((a, a + step)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        sql, args = f"SELECT {names} FROM ({self.query})", ()
        if partition.value:
            sql, args = f"{sql} WHERE {self.key} >= ? AND {self.key} < ?", partition.value
        with self._connect() as db:
            yield from db.execute(sql, args)


INDEX_TYPES = ("flat", "sq8")


def write_matrix(df: DataFrame, path: str, model: str, index_type: str = "flat") -> None:
    """Vectors (``chunk_id``, ``embedding``, ``digest``) with a one-row table of what they were made by."""
    if index_type not in INDEX_TYPES:
        raise ValueError(f"{index_type} is no kind of index")
    df.write.parquet(f"{path}/vectors")
    first = df.select(F.size("embedding").alias("n")).first()
    df.sparkSession.createDataFrame([(model, first["n"] if first else 0, df.count(), index_type, "inner product")], "model string, dimension int, rows bigint, index_type string, metric string").write.parquet(f"{path}/meta")


def read_matrix(spark: SparkSession, path: str, model: str | None = None, dimension: int | None = None, index_type: str | None = None) -> DataFrame:
    """The vectors, after their meta row was checked: a model, dimension, row count, kind of index or metric that differs
    is an error."""
    meta, df = spark.read.parquet(f"{path}/meta").first(), spark.read.parquet(f"{path}/vectors")
    checks = (("model", meta["model"], model), ("dimension", meta["dimension"], dimension), ("rows", df.count(), meta["rows"]), ("index type", meta["index_type"], index_type), ("metric", meta["metric"], "inner product"))
    wrong = [f"{what} is {got}, not {want}" for what, got, want in checks if want is not None and got != want]
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(wrong))
    return df


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(``name``, ``bytes``, ``digest``): SHA-256 of every file of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def manifest_errors(found: DataFrame, manifest: DataFrame, exact: bool = True) -> DataFrame:
    """(``name``, ``error``): files that are ``missing`` or ``changed`` against a manifest (``name``, ``digest``) and, with
    ``exact``, ``unknown`` ones."""
    both = manifest.select("name", F.col("digest").alias("want"), F.lit(True).alias("listed")).join(found.select("name", F.col("digest").alias("have"), F.lit(True).alias("there")), "name", "full")
    error = F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "unknown" if exact else None).when(~F.col("want").eqNullSafe(F.col("have")), "changed")
    return both.select("name", error.alias("error")).where("error IS NOT NULL")


def to_response(hits: DataFrame) -> DataFrame:
    """(``query_id``, ``response``): each query's hits as one JSON text, by rank."""
    by = F.array_sort(F.collect_list(F.struct("rank", *[c for c in hits.columns if c not in ("query_id", "rank")])))
    return hits.groupBy("query_id").agg(F.to_json(F.struct(by.alias("results"))).alias("response"))


def report_json(df: DataFrame) -> str:
    """A small report as JSON, for a file or log."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], ensure_ascii=False, default=str)
