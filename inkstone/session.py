"""Session helpers shared by all operators: table access, run-scoped scratch space and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_inkstone_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="inkstone-code-")) / "inkstone.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._inkstone_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests, a laptop) a folder of this machine stands in;
    on a cluster an unset folder is an error, as executors would write to places the others can't read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = getattr(scratch_root, "local", None)
    if local is None:
        scratch_root.local = local = tempfile.mkdtemp(prefix="inkstone-")
        atexit.register(shutil.rmtree, local, True)
    return f"file://{local}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    written(spark, path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, path: str) -> None:
    """Notes a path to be deleted when the application ends, or by ``sweep``."""
    if not _WRITTEN:
        atexit.register(_sweep_at_exit)
    _WRITTEN.append((spark, path))


def sweep(spark: SparkSession | None = None) -> int:
    """Deletes what ``materialize`` wrote in this process, once no result that reads it is needed any more. It is called
    when the process ends; one that lasts calls it between its queries."""
    count = len(_WRITTEN)
    while _WRITTEN:
        session, name = _WRITTEN.pop()
        jvm = (spark or session)._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem((spark or session)._jsc.hadoopConfiguration()).delete(path, True)
    return count


def _sweep_at_exit() -> None:
    try:
        sweep()
    except Exception:  # the JVM is gone already
        _WRITTEN.clear()


def slots(spark: SparkSession) -> int:
    """Tasks that run at once; a hint for the number of partitions of CPU-bound work."""
    return max(2, spark.sparkContext.defaultParallelism)


def hash_limit(share: float) -> int:
    """The largest 64-bit hash of the lowest ``share`` of all hashes: ``hash <= hash_limit(share)`` keeps that share."""
    return min(2**63 - 1, -(2**63) + round(min(1.0, max(0.0, share)) * 2**64))
