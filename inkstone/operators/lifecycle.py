"""Generations of chunks and vectors: published by numbered pointers, checked when opened, refreshed under a lock."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators.incremental import chunk_plan, merge_vectors, set_fingerprint
from inkstone.session import materialize

METRIC = "inner product"
INDEX_TYPES = ("flat", "sq8")


class Conflict(RuntimeError):
    """Another publisher took the number this one was going to take."""


class Held(RuntimeError):
    """Another holder has the lock."""


class StateError(ValueError):
    """A stored generation doesn't fit what is asked of it; the message says how."""


@dataclass
class Generations:
    """Tables written to a folder of their own each time, made current by a small pointer file.

    Pointers are numbered and created only where none of that number exists, so of two publishers one fails; none is
    ever deleted or overwritten. The highest readable one is current: a publisher that dies while it writes leaves an
    unreadable pointer that nobody follows, and what was current stays so. Readers pin the pointer they opened.
    """

    spark: SparkSession
    root: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.root}/pointer-*.json")) or []
        return sorted((int(f.getPath().getName()[8:-5]) for f in found), reverse=True)

    def _create(self, name: str, content: dict) -> bool:
        """Writes a small file unless there is one of that name."""
        fs, path = self._fs()
        try:
            out = fs.create(path(f"{self.root}/{name}"), False)
        except Exception as error:  # the JVM's FileAlreadyExistsException, and what stores throw in its place
            if fs.exists(path(f"{self.root}/{name}")):
                return False
            raise error
        out.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
        out.close()
        return True

    def _load(self, name: str) -> dict | None:
        try:
            found = json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0])
        except Exception:  # gone, empty or half written
            return None
        return found if isinstance(found, dict) and "path" in found else None

    def current(self) -> dict | None:
        """The content of the highest readable pointer; None where there is none."""
        for number in self._numbers():
            if found := self._load(f"pointer-{number:010d}.json"):
                return found
        return None

    def publish(self, tables: dict[str, DataFrame], meta: dict, after: int | None = None) -> dict:
        """Writes the tables and then the pointer after number ``after`` (by default the highest); ``Conflict`` if another
        was published meanwhile."""
        number = (max(self._numbers(), default=0) if after is None else after) + 1
        name = f"g-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{table}")
        pointer = meta | {"generation": number, "path": f"{self.root}/{name}", "tables": sorted(tables)}
        if (after is not None and max(self._numbers(), default=0) > after) or not self._create(f"pointer-{number:010d}.json", pointer):
            raise Conflict(f"{self.root}: generation {number} was published by another")
        return pointer

    def read(self, table: str, pointer: dict | None = None) -> DataFrame:
        pointer = pointer or self.current()
        if pointer is None:
            raise LookupError(f"{self.root}: nothing is published")
        return self.spark.read.parquet(f"{pointer['path']}/{table}")

    @contextmanager
    def lock(self, seconds: float = 6 * 3600) -> Iterator[None]:
        """Holds the store's lock; ``Held`` if another does. A lock older than ``seconds`` was left by a dead holder and is
        moved aside; should two do so at once, ``publish`` still lets only one through."""
        fs, path = self._fs()
        mine = path(f"{self.root}/update.lock")
        content = {"path": self.root, "owner": uuid.uuid4().hex, "until": time.time() + seconds}
        if not self._create("update.lock", content):
            held = self._load("update.lock")
            until = held["until"] if held else fs.getFileStatus(mine).getModificationTime() / 1000 + seconds
            if until > time.time() or not fs.rename(mine, path(f"{self.root}/stale-{uuid.uuid4().hex}.lock")) or not self._create("update.lock", content):
                raise Held(f"{self.root} is being updated")
        try:
            yield
        finally:
            if (held := self._load("update.lock")) and held.get("owner") == content["owner"]:
                fs.delete(mine, False)


def describe(chunks: DataFrame, vectors: DataFrame, model: str, index_type: str = "flat") -> dict:
    """What a generation's pointer says of its tables, to be checked when they are opened."""
    first = vectors.select(F.size("embedding").alias("n")).first()
    return {"model": model, "dimension": first["n"] if first else 0, "rows": vectors.count(), "fingerprint": set_fingerprint(chunks).first()["fingerprint"], "index_type": index_type, "metric": METRIC}


def check_state(store: Generations, model: str, dimension: int | None = None, pointer: dict | None = None) -> dict:
    """The current generation's pointer, if its tables belong together and to the embedder; else ``StateError``.

    Checked are the kind of index and its metric, the number of vectors, their digests, the chunks' fingerprint, the
    model and the dimension.
    """
    now = pointer or store.current()
    if now is None:
        raise StateError(f"{store.root}: nothing is published")
    chunks, vectors = store.read("chunks", now), store.read("vectors", now)
    if now.get("metric") != METRIC or now.get("index_type") not in INDEX_TYPES:
        raise StateError(f"the index is {now.get('index_type')} by {now.get('metric')}, which is not served")
    counted = vectors.agg(F.count("*").alias("rows"), F.count("digest").alias("digests"), F.count_if(F.size("embedding") != now["dimension"]).alias("odd")).first()
    if counted["rows"] != now["rows"] or counted["odd"]:
        raise StateError(f"there are {counted['rows']} vectors, {counted['odd']} of another dimension, where {now['rows']} of {now['dimension']} were written")
    if counted["digests"] != counted["rows"]:
        raise StateError(f"{counted['digests']} digests for {counted['rows']} vectors")
    if set_fingerprint(chunks).first()["fingerprint"] != now["fingerprint"]:
        raise StateError("chunks and vectors are of different builds")
    if now["model"] != model:
        raise StateError(f"stored vectors are of {now['model']}, not {model}")
    if dimension is not None and now["rows"] and dimension != now["dimension"]:
        raise StateError(f"the embedder's dimension is {dimension}, the index's {now['dimension']}")
    return now


def in_step(store: Generations, pointer: dict | None = None) -> bool:
    """Whether chunks and vectors have the same ids; False where they can't be read."""
    try:
        now = pointer or store.current()
        a, b = (store.read(t, now).groupBy("chunk_id").agg(F.count("*").alias("n")) for t in ("chunks", "vectors"))
        return a.join(b, ["chunk_id", "n"], "left_anti").isEmpty() and b.join(a, ["chunk_id", "n"], "left_anti").isEmpty()
    except Exception:
        return False


def index_type(store: Generations) -> str:
    """The kind of the current index; ``flat`` where that can't be read."""
    return (store.current() or {}).get("index_type") or "flat"


def _compared(new: DataFrame, old: DataFrame, stored: DataFrame) -> tuple[DataFrame, dict]:
    """The plan of chunks against the digests their vectors were made from, counts of its actions, whether all rows are
    the same as before, and the numbers of notices before and gone. Rows are compared by two 64-bit digests of all their
    columns."""
    columns = [c for c in new.columns if c in old.columns]
    both = [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]
    sides = [df.select("chunk_id", "notice_num", F.struct(*both).alias("row")) for df in (new, old)]
    plan = materialize(chunk_plan(new.select("chunk_id", "digest"), stored.select("chunk_id", "digest")), "plan")
    n, o = (s.select("chunk_id", F.col("row").alias(c)) for s, c in zip(sides, ("n", "o"), strict=True))
    same = n.join(o, "chunk_id", "full").where("NOT (n <=> o)").isEmpty()
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    notices = sides[1].select("notice_num").distinct().join(sides[0].select("notice_num").distinct().withColumn("stays", F.lit(1)), "notice_num", "left").agg(F.count("*").alias("before"), F.count_if(F.col("stays").isNull()).alias("gone")).first()
    return plan, {"counts": counts, "same": same, "before": notices["before"], "gone": notices["gone"]}


def refresh(store: Generations, chunks: DataFrame, embed, model: str, allow_shrink: bool = False, may_embed: bool = True) -> dict:
    """One refresh: plan against the current generation, embed what changed, publish; a no-op publishes nothing.

    ``embed`` maps (``chunk_id``, ``subject``, ``text``) to (``chunk_id``, ``embedding``). The outcome is ``changed``,
    ``unchanged``, ``refused`` (over a fifth and over 100 of the notices would go) or, without ``may_embed``, ``needs
    vectors``.
    """
    now = store.current()
    new = materialize(chunks.withColumn("digest", T.digest("chunk_id", "subject", "text")), "new-chunks")
    if now is None:
        if not may_embed:
            return {"outcome": "needs vectors"}
        fresh = embed(new.select("chunk_id", "subject", "text"))
        plan = new.select("chunk_id", F.lit("embed").alias("action"))
        merged = merge_vectors(plan, fresh, fresh.limit(0))
        extra: dict = {"counts": {"embed": new.count()}}
    else:
        if now["model"] != model:
            raise StateError(f"stored vectors are of {now['model']}, not {model}")
        stored = store.read("vectors", now)
        old = store.read("chunks", now)
        plan, found = _compared(new, old, stored)
        extra = {"counts": found["counts"]}
        if found["same"] and not extra["counts"].get("embed") and not extra["counts"].get("drop"):
            return {"outcome": "unchanged"} | now
        if found["gone"] > 100 and found["gone"] * 5 > found["before"] and not allow_shrink:
            return {"outcome": "refused", "deleted": found["gone"], "before": found["before"]} | now
        if extra["counts"].get("embed") and not may_embed:
            return {"outcome": "needs vectors"} | extra | now
        todo = new.join(plan.where("action = 'embed'"), "chunk_id", "left_semi").select("chunk_id", "subject", "text")
        merged = merge_vectors(plan, embed(todo), stored) if extra["counts"].get("embed") else merge_vectors(plan, stored.limit(0), stored)
    vectors = materialize(merged.join(new.select("chunk_id", "digest"), "chunk_id"), "new-vectors")
    meta = describe(new, vectors, model, (now or {}).get("index_type", "flat"))
    return {"outcome": "changed"} | extra | store.publish({"chunks": new, "vectors": vectors}, meta, (now or {}).get("generation", 0))


def tick(store: Generations, load: Callable[[], DataFrame], embed, model: str, loaded: int | None = None, allow_shrink: bool = False) -> dict:
    """One scheduled cycle under the lock; it never raises. ``load`` gives the chunks of the source as it is now.

    The outcome is ``changed``, ``unchanged`` (nothing changed and ``loaded``, the generation in memory, is current),
    ``failed`` with its error (the old generation goes on serving) or ``skipped`` (another holds the lock).
    """
    began = time.time()
    try:
        with store.lock():
            found = refresh(store, load(), embed, model, allow_shrink)
            if found["outcome"] == "refused":
                found |= {"outcome": "failed", "error": f"refusing to delete {found['deleted']} of {found['before']} notices"}
            elif found["outcome"] == "unchanged" and loaded is not None and loaded != found["generation"]:
                found |= {"outcome": "changed"}  # memory is behind what is published
    except Held:
        found = {"outcome": "skipped"}
    except Exception as error:  # one bad cycle must not end the schedule
        found = {"outcome": "failed", "error": f"{type(error).__name__}: {error}"}
    return found | {"seconds": round(time.time() - began, 3)}


def boot_repair(store: Generations, load: Callable[[], DataFrame], model: str) -> bool:
    """Repairs a generation whose tables don't belong together, if that takes no new vector and no large deletion.

    Returns whether a generation was published. ``Held`` passes on.
    """
    with store.lock():
        return refresh(store, load(), None, model, may_embed=False)["outcome"] == "changed"


def open_generation(store: Generations, model: str, dimension: int, repair: Callable[[], bool] | None = None) -> dict:
    """The current generation after its checks. Where they fail, ``repair`` gets one try; without its help the error of
    the checks stands."""
    try:
        return check_state(store, model, dimension)
    except StateError:
        if repair is None or not repair():
            raise
    return check_state(store, model, dimension)
