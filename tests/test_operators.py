import random

import pytest
from pyspark.sql import functions as F

from inkstone.config import Settings, read_env_file
from inkstone.functions import embedding, lexical, stats
from inkstone.operators import capability, chunking, incremental, lifecycle, pairing, search, snapshots
from inkstone.sources import io


# Chunking
@pytest.mark.parametrize("limit,overlap,least", [(200, 50, 40), (100, 30, 40), (60, 10, 20)])
def test_packing_loses_nothing_and_keeps_its_bounds(limit, overlap, least):
    rng = random.Random(limit)
    for _ in range(200):
        pieces = ["가" * rng.randint(1, limit) for _ in range(rng.randint(1, 12))]
        out = chunking.pack([f"{i % 10}{p[1:]}" for i, p in enumerate(pieces)], limit, overlap, least)
        assert all(len(c) <= limit + least + 1 for c in out)
        joined = "\n".join(out)
        for i, p in enumerate(pieces):
            assert f"{i % 10}{p[1:]}" in joined
        assert all(len(c) >= least for c in out[1:])


def test_packing_repeats_the_end_of_the_chunk_before():
    assert chunking.pack(["aaaa", "bb", "cccc", "dd"], 8, 3, 1) == ["aaaa\nbb", "bb\ncccc", "dd"]
    assert chunking.pack(["a" * 10, "b"], 10, 3, 2) == ["a" * 10 + "\nb"]
    assert chunking.pack([], 10, 3, 2) == []


def test_units_cut_at_sentences_then_anywhere():
    assert list(chunking.units("가나. 다라. 마바사아자차카.", 7)) == ["가나. 다라.", "마바사아자차카", "."][:1] + ["마바사아자차카", "."]
    assert list(chunking.units("짧음.", 10)) == ["짧음."]


def test_chunks_of_odd_notices(spark):
    rows = [(1, "제목", None, "", None), (2, None, None, None, None), (3, "제목", "위원회", "주요내용", "요약"), (4, "제목", None, "주요내용 첫 말.\n제안이유\n둘째 말.", None)]
    df = spark.createDataFrame(rows, "notice_num bigint, subject string, committee string, proposal_reason string, ai_summary string").withColumn("chunk_id", F.lit("clash"))
    got = {(r["chunk_id"], r["section"], r["text"]) for r in chunking.chunk_notices(df).collect()}
    assert got == {("1-0000", "body", "제목"), ("2-0000", "body", ""), ("3-0000", "body", "제목"), ("3-0001", "AI 요약", "요약"), ("4-0000", "주요내용", "첫 말."), ("4-0001", "제안이유", "둘째 말.")}


# Snapshots
SNAP = "snapshot string, id bigint, a string, b string, v timestamp"


def test_snapshot_changes_of_every_kind(spark):
    rows = [("d1", 1, "x", None, "2020-01-01"), ("d1", 2, "y", "", "2020-01-01"), ("d1", 3, "z", "", "2020-01-01"), ("d1", 3, "z", "", "2020-01-01"), ("d1", None, "n", "", "2020-01-01")]
    rows += [("d2", 1, "x", "", "2020-01-02"), ("d2", 2, "old", "", "2020-01-02"), ("d2", 2, "new", "", "2020-01-09"), ("d2", 4, "w", "", None), ("d3", 4, "w", None, "2020-01-03"), ("d3", 1, "x", "", "2020-01-03"), ("d3", 2, "new", "", "2020-01-03")]
    df = spark.createDataFrame(rows, "snapshot string, id bigint, a string, b string, v string").withColumn("v", F.col("v").cast("timestamp")).withColumns({"ord": F.lit(1), "key": F.lit("k"), "digest": F.lit(0)})
    got = {tuple(r) for r in snapshots.snapshot_changes(df, "snapshot", "id", ["a", "b"], "v").collect()}
    assert got == {("d2", 2, "changed"), ("d2", 3, "removed"), ("d2", 4, "added")}


def test_snapshot_changes_of_empty_and_single(spark):
    assert snapshots.snapshot_changes(spark.createDataFrame([], SNAP), "snapshot", "id", ["a"], "v").count() == 0
    assert snapshots.snapshot_changes(spark.createDataFrame([("d", 1, "x", "y", None)], SNAP), "snapshot", "id", ["a"], "v").count() == 0


def test_snapshot_tree_equals_plain_comparison(spark):
    rng = random.Random(3)
    state, rows, want = {}, [], set()
    for day in range(4):
        new = dict(state)
        for k in range(3000):
            if rng.random() < 0.03:
                new[k] = rng.choice("abc")
            elif k in new and rng.random() < 0.01:
                del new[k]
        if day:
            want |= {(f"d{day}", k, "added") for k in new.keys() - state.keys()} | {(f"d{day}", k, "removed") for k in state.keys() - new.keys()} | {(f"d{day}", k, "changed") for k in new.keys() & state.keys() if new[k] != state[k]}
        rows += [(f"d{day}", k, a, "", None) for k, a in new.items()]
        state = new
    got = {tuple(r) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, SNAP), "snapshot", "id", ["a", "b"], "v", rows_per_leaf=8).collect()}
    assert got == want


# Pairs and components
def test_pairs_within_salted_groups(spark):
    rows = [("g", i) for i in range(30)] + [("h", 1), ("h", 2), ("one", 5)]
    m = spark.createDataFrame(rows, "g string, k int")
    got = {tuple(r) for r in pairing.pairs_within(m, ["g"], "k", rows_per_salt=7).select("a", "b", "g").collect()}
    assert got == {(a, b, "g") for a in range(30) for b in range(a + 1, 30)} | {(1, 2, "h")}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 110)] + [(7, 7)]
    got = dict(map(tuple, pairing.components(spark.createDataFrame(links, "a int, b int")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 110), 100)}
    assert pairing.components(spark.createDataFrame([], "a int, b int")).count() == 0


# Search and evaluation
def test_top_k_orders_ties_by_id(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, embedding array<double>")
    got = [tuple(r) for r in search.top_k(v.where("id = 1"), v, 3).orderBy("rank").select("hit_id", "score").collect()]
    assert got == [(1, 1.0), (2, 1.0), (3, 0.0)]
    with pytest.raises(ValueError):
        search.top_k(v, v, 0)


def test_mcnemar_beyond_twenty(spark):
    from math import comb

    rows = [(w, l) for w in (0, 3, 17, 40) for l in (0, 5, 30)]
    for r in spark.createDataFrame(rows, "w int, l int").withColumn("p", stats.mcnemar(F.col("w"), F.col("l"))).collect():
        n, m = r["w"] + r["l"], min(r["w"], r["l"])
        assert r["p"] == pytest.approx(min(1.0, 2 * sum(comb(n, i) for i in range(m + 1)) / 2**n))


def test_widening_equals_the_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for q in range(40):
        scores = sorted((rng.random() for _ in range(rng.randint(1, 60))), reverse=True)
        hits = [(q, i + 1, rng.randint(0, 8), s) for i, s in enumerate(scores)]
        rows += hits
        size = 6
        while True:
            size = min(size, len(hits))
            part = hits[:size]
            if len({h[2] for h in part if h[3] >= 0.6}) >= 2 or sum(h[3] >= 0.4 for h in part) < size or size >= len(hits):
                break
            size *= 2
        want[q] = size
    df = spark.createDataFrame(rows, "query_id int, rank int, notice_num int, score double")
    assert {r["query_id"]: r["window"] for r in search.widened_window(df, 0.6, 0.4, 2).collect()} == want


def test_fusion_refuses_a_rank_offset_under_one(spark):
    with pytest.raises(ValueError):
        lexical.rank_fusion(spark.createDataFrame([(1, 1)], "id int, rank int"), ["id"], 0)


# Refresh
def notices(spark, texts):
    return chunking.chunk_notices(spark.createDataFrame([(i, f"제목 {i}", t) for i, t in texts.items()], "notice_num bigint, subject string, proposal_reason string").withColumn("committee", F.lit("")))


def embedder(dimension):
    return lambda c: embedding.embed_chunks(c, embedding.hashing_embedder(dimension))


def test_refresh_equals_full_rebuild_and_noop_publishes_nothing(spark, tmp_path):
    embed, store = embedder(32), lifecycle.Generations(spark, f"file://{tmp_path}/store")
    assert store.current() is None and lifecycle.index_type(store) == "flat" and not lifecycle.in_step(store)
    first = {i: f"제안이유\n문장 {i} 임." for i in range(6)}
    assert lifecycle.refresh(store, notices(spark, first), embed, "m")["generation"] == 1
    assert lifecycle.refresh(store, notices(spark, first), embed, "m")["outcome"] == "unchanged"
    second = {**first, 2: "주요내용\n다른 문장임.", 9: "새 문장임."}
    del second[4]
    done = lifecycle.refresh(store, notices(spark, second), embed, "m")
    assert done["generation"] == 2 and done["counts"] == {"embed": 2, "reuse": 4, "drop": 1}
    key = lambda df: sorted((r["chunk_id"], tuple(r["embedding"])) for r in df.collect())
    assert key(store.read("vectors")) == key(embed(notices(spark, second)))
    assert lifecycle.check_state(store, "m", 32)["generation"] == 2 and lifecycle.in_step(store)
    renamed = notices(spark, second).withColumn("committee", F.lit("새 위원회"))
    assert lifecycle.refresh(store, renamed, embed, "m")["counts"] == {"reuse": 6}  # only what isn't embedded changed
    with pytest.raises(lifecycle.StateError):
        lifecycle.refresh(store, notices(spark, second), embed, "other")


def test_crashes_and_races_leave_a_current_generation(spark, tmp_path):
    embed, store = embedder(16), lifecycle.Generations(spark, f"file://{tmp_path}/store")
    lifecycle.refresh(store, notices(spark, {1: "말."}), embed, "m")
    (tmp_path / "store" / "pointer-0000000002.json").write_text('{"path": "x')  # a publisher died here
    assert store.current()["generation"] == 1
    with pytest.raises(lifecycle.Conflict):
        store.publish({"chunks": store.read("chunks")}, {}, after=1)
    assert store.publish({"chunks": store.read("chunks"), "vectors": store.read("vectors")}, {"model": "m"})["generation"] == 3
    with store.lock():
        assert lifecycle.tick(store, lambda: notices(spark, {1: "말."}), embed, "m")["outcome"] == "skipped"
        with pytest.raises(lifecycle.Held), store.lock():
            pass
    with store.lock(seconds=-1), store.lock():  # the first one's time is up
        pass


def test_cycles_report_and_never_raise(spark, tmp_path):
    embed, store = embedder(16), lifecycle.Generations(spark, f"file://{tmp_path}/store")
    load = lambda: notices(spark, {1: "말."})
    assert lifecycle.tick(store, load, embed, "m")["outcome"] == "changed"
    assert lifecycle.tick(store, load, embed, "m", loaded=1)["outcome"] == "unchanged"
    assert lifecycle.tick(store, load, embed, "m", loaded=0)["outcome"] == "changed"
    failed = lifecycle.tick(store, lambda: 1 / 0, embed, "m")
    assert failed["outcome"] == "failed" and "ZeroDivision" in failed["error"] and store.current()["generation"] == 1
    many = notices(spark, {i: "말." for i in range(150)})
    assert lifecycle.tick(store, lambda: many, embed, "m")["outcome"] == "changed"
    refused = lifecycle.tick(store, load, embed, "m")
    assert refused["outcome"] == "failed" and "149 of 150" in refused["error"] and store.current()["generation"] == 2
    assert lifecycle.tick(store, load, embed, "m", allow_shrink=True)["outcome"] == "changed"


def test_stored_state_is_checked_and_repaired(spark, tmp_path):
    embed, store = embedder(16), lifecycle.Generations(spark, f"file://{tmp_path}/store")
    load = lambda: notices(spark, {1: "말.", 2: "글임."})
    lifecycle.refresh(store, load(), embed, "m")
    chunks, vectors, good = store.read("chunks"), store.read("vectors"), {k: v for k, v in store.current().items() if k not in ("generation", "path", "tables")}
    for spoilt, meta, message in (({"vectors": vectors.limit(1)}, {}, "vectors"), ({"vectors": vectors.withColumn("digest", F.lit(None).cast("string"))}, {}, "digests"), ({"chunks": chunks.limit(1)}, {}, "different builds"), ({}, {"model": "n"}, "stored vectors"), ({}, {"metric": "l2"}, "not served"), ({}, {"dimension": 8}, "another dimension")):
        store.publish({"chunks": chunks, "vectors": vectors} | spoilt, good | meta)
        with pytest.raises(lifecycle.StateError, match=message):
            lifecycle.check_state(store, "m", 16)
    store.publish({"chunks": chunks, "vectors": vectors}, good)
    with pytest.raises(lifecycle.StateError, match="embedder's dimension"):
        lifecycle.check_state(store, "m", 32)
    store.publish({"chunks": chunks.limit(1), "vectors": vectors}, good)
    assert not lifecycle.in_step(store)
    repaired = lifecycle.open_generation(store, "m", 16, lambda: lifecycle.boot_repair(store, load, "m"))
    assert store.read("chunks", repaired).count() == 2 and lifecycle.in_step(store)
    assert not lifecycle.boot_repair(store, lambda: notices(spark, {1: "새 말.", 2: "글임."}), "m")  # it would take a vector


def test_fingerprints_of_any_depth_tell_sets_apart(spark):
    import hashlib

    c = spark.createDataFrame([(f"{i}-0000", "제목", f"말 {i}") for i in range(50)], "chunk_id string, subject string, text string")
    value = lambda df, **k: incremental.set_fingerprint(df, **k).first()["fingerprint"]
    for depth in (None, 3, 5, 7):
        assert value(c, prefix=depth) == value(c.orderBy(F.desc("text")).union(c.limit(1)), prefix=depth) != value(c.limit(49), prefix=depth)
    lines = sorted(f"{i}-0000\x00제목\n말 {i}\n" for i in range(50))
    assert incremental.exact_fingerprint(c) == hashlib.sha256("".join(lines).encode()).hexdigest()


def test_merge_fails_where_a_vector_is_missing(spark):
    plan = spark.createDataFrame([("a", "embed")], "chunk_id string, action string")
    none = spark.createDataFrame([], "chunk_id string, embedding array<double>")
    with pytest.raises(Exception, match="no vector for chunk a"):
        incremental.merge_vectors(plan, none, none).collect()


def test_capability_diff_catches_a_lost_summary(spark):
    n = spark.createDataFrame([(1, "제목", "제안이유\n말.", "요약")], "notice_num bigint, subject string, proposal_reason string, ai_summary string").withColumn("committee", F.lit(""))
    full, less = (capability.capability_index(n, chunking.chunk_notices(n, summaries=s)) for s in (True, False))
    assert {tuple(r) for r in capability.capability_diff(full, less).collect()} == {("lost", "derived:ai_summary", 1)}
    assert capability.unregistered(n.withColumn("extra", F.lit(1))) == {"extra"}


# Sources and settings
def test_sqlite_source_reads_ranges(spark, tmp_path):
    import sqlite3

    path = f"{tmp_path}/n.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, None if i == 3 else f"n{i}") for i in range(1, 51)])
    spark.dataSource.register(io.SqliteSource)
    df = spark.read.format("sqlite").options(path=path, query="SELECT id, name FROM t WHERE id > 2", key="id", partitions="4", schema="id bigint, name string").load()
    assert df.rdd.getNumPartitions() == 4 and df.count() == 48 and df.where("name IS NULL").count() == 1


def test_json_lines_round_trip(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"notice_num": 1, "subject": "가"}\n\n{"notice_num": 2, "ai_summary": "나"}\n', encoding="utf-8")
    n = io.read_notices(spark, f"{tmp_path}/n.jsonl")
    assert sorted((r["notice_num"], r["subject"], r["ai_summary"]) for r in n.collect()) == [(1, "가", ""), (2, "", "나")]
    io.write_lines(chunking.chunk_notices(n), f"{tmp_path}/c")
    assert io.read_chunks(spark, f"{tmp_path}/c").count() == 2
    with pytest.raises(ValueError):
        io.read_labelled(spark, f"{tmp_path}/n.jsonl", ["subject"], "notice_num bigint, subject string")


def test_matrix_files_check_their_meta(spark, tmp_path):
    io.write_matrix(spark.createDataFrame([("a", [1.0, 2.0], "d")], "chunk_id string, embedding array<double>, digest string"), f"{tmp_path}/m", "model")
    assert io.read_matrix(spark, f"{tmp_path}/m", "model", 2).count() == 1
    with pytest.raises(ValueError):
        io.read_matrix(spark, f"{tmp_path}/m", "other")


def test_files_are_checked_against_a_manifest(spark, tmp_path):
    import hashlib

    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    manifest = spark.createDataFrame([("a", digest("a")), ("b", digest("x")), ("d", digest("d"))], "name string, digest string")
    found = io.file_digests(spark, str(tmp_path))
    assert {tuple(r) for r in io.manifest_errors(found, manifest).collect()} == {("b", "changed"), ("c", "unknown"), ("d", "missing")}
    assert {r["name"] for r in io.manifest_errors(found, manifest, exact=False).collect()} == {"b", "d"}


def test_release_check(spark, tmp_path, capsys):
    index = spark.createDataFrame([("indexed", 1), ("title_text", 1), ("indexed", 2)], capability.SCHEMA)
    capability.save_baseline(index, f"{tmp_path}/b")
    before = capability.load_baseline(spark, f"{tmp_path}/b")
    less = index.where("capability = 'indexed'")
    assert capability.print_report(index, capability.verdict(before, index)) == 0 and "indexed=2 title_text=1" in capsys.readouterr().out
    assert capability.print_report(less, capability.verdict(before, less)) == 1
    assert capability.verdict(before, index, before.limit(1)).first()["exit_code"] == 2
    (tmp_path / "e").write_text('{"capability": "indexed"}\n')
    with pytest.raises(ValueError):
        capability.load_baseline(spark, f"{tmp_path}/e")


def test_query_vectors_are_kept(spark, tmp_path):
    asked = []

    def embed(q):
        asked.extend(r["prepared"] for r in q.collect())
        return q.select("query_id", F.array(F.length("prepared").cast("double"), F.lit(1.0)).alias("embedding"))

    store = lifecycle.Generations(spark, f"file://{tmp_path}/store")
    keep = embedding.cached(embed, store, 2)
    q = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "query_id int, prepared string")
    assert {tuple(r["embedding"]) for r in keep(q("a", "bb", "a")).collect()} == {(1.0, 1.0), (2.0, 1.0)} and sorted(asked) == ["a", "bb"]
    assert keep(q("bb", "ccc")).count() == 2 and sorted(asked) == ["a", "bb", "ccc"]
    assert {r["prepared"] for r in store.read("vectors").collect()} == {"bb", "ccc"}
    assert embedding.cached(embed, store, 0) is embed


def test_metrics_are_kept(spark, tmp_path):
    from inkstone.operators import metrics

    timings = metrics.Timings()
    with metrics.traced(spark, "abc-1") as tag, timings.span("search"):
        assert tag == "abc-1" and "abc-1" in spark.getTags()
    with metrics.traced(spark, "no good") as tag:
        assert tag is None
    for _ in range(2):
        metrics.append(timings.rows(spark, "r1"), f"{tmp_path}/m")
    assert not spark.getTags() and spark.read.parquet(f"{tmp_path}/m").where("span = 'search' AND duration_ms >= 0").count() == 2


def test_blank_and_unusable_queries(spark):
    from inkstone.operators import tiered

    chunks = spark.createDataFrame([("1-0000", 1, "도로교통법 일부개정법률안", None, "body", "신호 위반 처벌"), ("2-0000", 2, "도로교통법 일부개정법률안", None, "body", "신호 대기"), ("3-0000", 3, None, None, "body", "무관")], "chunk_id string, notice_num bigint, subject string, committee string, section string, text string")
    vectors = spark.createDataFrame([("1-0000", [1.0, 0.0]), ("2-0000", [0.5, 0.85]), ("3-0000", [-1.0, 0.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, "신호 위반"), (2, "  "), (3, None)], "query_id int, query string")
    embed = lambda p: p.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    got = {(r["query_id"], r["tier"], r["notice_num"]) for r in tiered.search_tiered(q, chunks, vectors, embed, profile=False).collect()}
    assert got == {(1, "clear", 1), (1, "clear", 2)}
    got = {(r["tier"], r["notice_num"]) for r in tiered.search_tiered(q, chunks, vectors, embed, profile=False, settings=Settings(min_similarity=0.6, clear_similarity=0.7)).collect()}
    assert got == {("clear", 1), ("weak", 2)}  # the same law, some words shared, under the minimum
    assert {(r["tier"], r["notice_num"], r["candidates"]) for r in tiered.search_tiered(q, chunks, vectors, embed).collect()} == {("weak", 1, 2)}  # too few of the words are in the other
    with pytest.raises(Exception, match="no usable vector for query 1"):
        tiered.search_tiered(q, chunks, vectors, lambda p: p.select("query_id", F.array(F.lit(0.0)).alias("embedding")), profile=False).collect()
    assert [r["error"] for r in tiered.request_errors(q).orderBy("query_id").collect()] == ["blank", "blank"]
    assert tiered.request_errors(q.where("query_id = 1"), k=101).first()["error"] == "k"


def test_settings_are_checked(tmp_path):
    assert Settings.from_env({"INKSTONE_MIN_SIMILARITY": "0.3"}).min_similarity == 0.3
    for bad in ({"INKSTONE_MIN_SIMILARITY": "0.9"}, {"INKSTONE_CHUNK_MAX_CHARS": "x"}, {"INKSTONE_DEFAULT_K": "0"}):
        with pytest.raises(ValueError):
            Settings.from_env(bad)
    (tmp_path / "e").write_text("export A='1'\n# c\nB=2\n")
    assert read_env_file(tmp_path / "e", {"B": "3"}) == {"A": "1", "B": "3"} and read_env_file("", {}) == {}


def test_files_that_arrive_are_merged(spark, tmp_path):
    from inkstone.streaming.refresh import refresh_from_files

    store = lifecycle.Generations(spark, f"file://{tmp_path}/store")

    def arrive(texts, gone=()):
        rows = notices(spark, texts)
        if gone:
            rows = rows.unionByName(spark.createDataFrame([(n,) for n in gone], "notice_num bigint"), allowMissingColumns=True)
        rows.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        refresh_from_files(spark, f"{tmp_path}/in", io.CHUNK, store, embedder(16), "m", f"{tmp_path}/checkpoint")
        return {(r["notice_num"], r["text"]) for r in store.read("chunks").collect()}

    assert arrive({1: "말.", 2: "글."}) == {(1, "말."), (2, "글.")}
    assert arrive({2: "다른 글.", 3: "셋."}) == {(1, "말."), (2, "다른 글."), (3, "셋.")}
    assert arrive({3: "셋."}, gone=[1]) == {(2, "다른 글."), (3, "셋.")}
    assert store.current()["generation"] == 3 and lifecycle.in_step(store)


def test_sweep_deletes_what_was_written(spark):
    from inkstone import session

    df = session.materialize(spark.range(5).toDF("id"))
    assert df.count() == 5 and session.sweep(spark) >= 1 and session.sweep(spark) == 0
    with pytest.raises(Exception, match="PATH|exist|FileNotFound|FAILED_READ"):
        spark.read.parquet(df.inputFiles()[0]).count()
