"""Problems 5, 6, 7, 8 and 9: overlaps, near-duplicates, neighbours, containers, mixtures."""

import itertools
import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import mixing, near, neighbours, overlap, packing, tokens


# Problem 5
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_banded_equals_full_programming():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        found, d = overlap.banded(a, b, 2), distance(a, b)
        assert (found is None) == (d > 2) and (found is None or len(found) == d)


SMALL = ("좀", "대해", "관련", "그냥", "혹시")
BASE = ["도시숲 교육기관의 시정권고 처리", "산사태 관리주체 조정절차 비용", "학교급식 심의위원회 지원 금액", "빈집 보호자 전담기구 시기", "LNG 운송인의 과징금 자격"]


def spoilt(rng, s):
    """A careless version of a query: at most two edits, one small word, words in any order, some written together."""
    parts = s.split(" ")
    if rng.random() < 0.5:
        rng.shuffle(parts)
    for _ in range(rng.choice([0, 0, 1, 2])):
        j = rng.randrange(len(parts))
        i = rng.randrange(len(parts[j]))
        parts[j] = parts[j][:i] + rng.choice(["", "갉"]) + parts[j][i + 1 :]
    if rng.random() < 0.3:
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(SMALL))
    s = rng.choice([" ", " ", "  "]).join(parts)
    if rng.random() < 0.2:
        i = rng.randrange(len(s) - 1)
        s = s[:i] + s[i:].replace(" ", "", 1)
    return rng.choice([s, s + "?", s.upper(), s.replace(" ", "　")])


def plainly_same(x, y):
    """Near-same by trying every order of one text's words against the other, with full programming."""
    a, b = (re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).lower()) for t in (x, y))
    for p, q in [(a, b), *((a[:i] + a[i + 1 :], b) for i, w in enumerate(a) if w in SMALL), *((a, b[:i] + b[i + 1 :]) for i, w in enumerate(b) if w in SMALL)]:
        whole = "".join(q)
        if abs(len("".join(p)) - len(whole)) <= 2 and any(distance("".join(o), whole) <= 2 for o in itertools.permutations(p)):
            return True
    return False


def test_spoilt_queries_meet_their_originals(spark):
    rng = random.Random(4)
    ev = [(i * 7, i % 3, BASE[i % 5]) for i in range(15)]
    tr = [(1 + i * 5, i % 3, spoilt(rng, BASE[i % 5])) for i in range(120)] + [(5000, 0, None), (None, 0, BASE[0]), (5001, None, BASE[0]), (5002, 0, ""), (5003, 0, "?!"), (5004, 0, BASE[0].replace("시정권고", "과징금신청"))]
    tr = [r for r in tr if r[0] is None or r[0] >= 5000 or r[0] % 7]
    schema = "q bigint, key bigint, text string"
    e, t = spark.createDataFrame([*ev, (900, 0, "?"), (901, 0, None)], schema).withColumn("segment", F.lit(0)), spark.createDataFrame([*tr, tr[0]], schema).withColumns({"w": F.lit(0), "part": F.lit(1)})
    want = {(a, b) for a, ka, x in ev for b, kb, y in tr if b is not None and kb == ka and y and plainly_same(x, y)}
    for sizes in ({}, {"rows_per_slice": 2, "rows_per_bucket": 5}):
        got = {tuple(r) for r in overlap.cross_split_overlaps(e, t, known_in=99, small=list(SMALL), **sizes).collect()}
        assert not got - want and len(got) > 0.98 * len(want) and len(want) > 80
    assert any(a > b for a, b in got) and any(a < b for a, b in got)
    assert overlap.cross_split_overlaps(e.limit(0), t).count() == 0 and overlap.cross_split_overlaps(e, t.limit(0)).count() == 0


def test_very_long_queries_meet_only_their_like(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("가나다라마바사") for _ in range(5)) for _ in range(4000))
    schema = "q bigint, key bigint, text string"
    e = spark.createDataFrame([(1, 1, long), (2, 2, "짧은 질의 하나 더")], schema)
    t = spark.createDataFrame([(3, 1, long[:5000] + "까" + long[5001:]), (4, 2, long), (5, 1, "짧은 질의 하나 더"), (6, 2, "하나 더 짧은 질의")], schema)
    assert {tuple(r) for r in overlap.cross_split_overlaps(e, t).collect()} == {(1, 3), (2, 6)}


def test_small_words_are_learned(spark):
    base = [(k, f"운송인 과징금 {w} 공고{k}".split()) for k in range(8) for w in ("조항", "시기")]
    ev = spark.createDataFrame(base, "key bigint, w array<string>")
    tr = spark.createDataFrame([(k, [*w[:2], "좀", *w[2:]]) for k, w in base[:6]] + [(k, [*w, "조합원"]) for k, w in base[:1]] + base, "key bigint, w array<string>")
    assert overlap.small_words(ev, tr) == ["좀"]


@pytest.mark.parametrize("a,b,same", [("임차인 의무보험 범위", "의무보험 범위 임차인", True), ("임차인 의무보험 범위", "임차인 좀 의무보험 범위!", True), ("가나다라 마바사", "가나다마 마바아", True), ("가나 다라 마바사", "마바사 다라 가낙", True), ("가나 다라 마바사", "마바사다라가나", True), ("가나 다", "가라 다", True), ("가나", "가라", False), ("가나다라 마바사", "가나아마 마바아", False), ("신청 자격 공고", "지원 금액 공고", False), ("", "", False), ("가", "나다라마", False)])
def test_near_same(a, b, same):
    assert (overlap.near_same(overlap.words(a), overlap.words(b), frozenset(SMALL)) is not None) == same


def test_another_known_word_is_another_question(spark):
    ev = [(i, i, f"운송인{'' if i else ''} 임차인 과징금 {w}") for i, w in enumerate(("조항", "시기", "범위", "금액"))]
    tr = [(100 + i, i, f"운송인 임대인 과징금 {w}") for i, w in enumerate(("조항", "시기", "범위", "금액"))]
    schema = "q bigint, key bigint, text string"
    assert overlap.cross_split_overlaps(spark.createDataFrame(ev, schema), spark.createDataFrame(tr, schema)).count() == 0


@pytest.mark.parametrize("size", [1, 10])
def test_repeated_typing_errors_stay_errors_in_large_tables(spark, size):
    texts = [("산사태 예외 관리주체 비용", "산사태 예 관리주체 비용" if i % 100 == 0 else "비용 산사태 예외 관리주체") for i in range(100 * size)]
    other = [("운송인 임차인 기준 공고", "운송인 임대인 기준 공고")] * 10 * size
    schema, n = "q bigint, key bigint, text string", len(texts)
    ev = spark.createDataFrame([(i, i, a) for i, (a, _) in enumerate(texts + other)], schema)
    tr = spark.createDataFrame([(100_000 + i, i, b) for i, (_, b) in enumerate(texts + other)], schema)
    assert {tuple(r) for r in overlap.cross_split_overlaps(ev, tr).collect()} == {(i, 100_000 + i) for i in range(n)}


# Problem 6
def test_partenum_is_lossless_and_groups_are_right(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(12):
        base = rng.sample(words, 60)
        for c in range(5):
            drop = rng.randint(0, 18)
            texts[g * 10 + c] = base[drop:] + rng.sample(words, rng.randint(0, 12))
    texts[500] = list(texts[0])
    rows = [(k, " ".join(v[:20]), " ".join(v[20:])) for k, v in texts.items()] + [(900, None, None), (901, "", "짧음"), (None, " ".join(texts[0]), "")]
    df = spark.createDataFrame([*rows, rows[0]], "id bigint, s string, t string").withColumns({"k": F.lit("x"), "sig": F.lit(1), "words": F.lit(2)})
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if len(set(texts[a]) & set(texts[b])) / len(set(texts[a]) | set(texts[b])) >= 0.6}
    enum = near.PartEnum(0.6)
    signed = {k: set(enum.signatures(np.array([hash(w) for w in sorted(set(v))], "i8").view(np.uint64)).tolist()) for k, v in texts.items()}
    assert all(signed[a] & signed[b] for a, b in want)
    for telling in (-1000.0, 3.0, 1000.0):
        links, members = near.similar_sets(near.word_sets(df, "id", ["s", "t"], 40), 0.6, telling=telling)
        assert {tuple(r) for r in near.similar_pairs(links, members).distinct().collect()} == want
    groups = {r["k"]: (r["group_id"], r["links"]) for r in near.near_groups(links, members).collect()}
    assert set(groups) == set(texts) and groups[500] == groups[0]
    assert all(groups[a][0] == groups[b][0] for a, b in want)
    links, members = near.similar_sets(near.word_sets(df.limit(0), "id", ["s", "t"], 40), 0.6)
    assert near.similar_pairs(links, members).count() == 0 and near.near_groups(links, members).count() == 0


def test_edited_copies_that_are_a_third_of_all_are_found(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = rng.sample(vocabulary, 100)
    texts = {i: base[:92] + rng.sample(vocabulary, 8) if i % 3 == 0 else rng.sample(vocabulary, 100) for i in range(240)}
    texts[1000], texts[1001] = base + rng.sample(vocabulary, 60), base[:80] + [f"r{i}" for i in range(25)]
    texts[1002] = texts[1001][:70] + texts[1001][80:]
    sets = near.word_sets(spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "id bigint, t string"), "id", ["t"], 40)
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if len(set(texts[a]) & set(texts[b])) / len(set(texts[a]) | set(texts[b])) >= 0.6}
    for options in ({}, {"rows_per_block": 30}, {"rare": 0.1}, {"rare": 1.0, "rows_per_block": 50}):
        links, _ = near.similar_sets(sets, 0.6, **options)
        assert {(r["a"], r["b"]) for r in links.collect()} == want
    assert len(want) > 3000


def test_bands_touch_where_sizes_are_similar():
    b = near.bands(0.6)
    at = lambda n: next(i for i, (x, y) in enumerate(b) if x <= n <= y)
    assert all(at(n) - at(m) <= 1 for n in range(1, 300) for m in range(-(-n * 6 // 10), n + 1))


# Problem 7
def _cloud(n, dimension, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dimension))
    return (centres[rng.integers(0, 20, n)] + 0.6 * rng.normal(size=(n, dimension))).astype("f4")


@pytest.mark.parametrize("relax,recall", [(1.0, 1.0), (0.4, 0.9)])
def test_neighbours_against_brute_force(spark, relax, recall):
    x = _cloud(900, 16, 1)
    x[1:8] = x[0]  # more equal vectors than are asked for
    rows = [(f"v{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)]
    odd = [("n1", None), ("n2", [0.0] * 16), ("n3", [1.0] * 3), ("n4", [float("nan")] * 16), ("n5", [None] + [1.0] * 15), (None, [1.0] * 16), rows[5]]
    df = spark.createDataFrame([*rows, *odd], "id string, e array<float>").withColumns({"vec": F.lit(1), "q": F.lit(2), "shard": F.lit(3)})
    vectors = neighbours.usable_vectors(df, "id", "e", 16)
    got = {}
    for r in neighbours.nearest(vectors, 16, 5, relax=relax, rows_per_shard=150).collect():
        got.setdefault(r["q"], []).append((-round(r["cosine"], 5), r["n"]))
    assert set(got) == {i for i, _ in rows} and all(len(v) == 5 for v in got.values())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((u @ u.T).astype("f8"), 5)
    np.fill_diagonal(s, -2)
    right = sum(sum(c <= -np.sort(s[i])[-5] + 2e-5 for c, _ in got[f"v{i:04d}"]) for i in range(900))
    assert right / 4500 >= recall - 1e-9
    assert sorted(n for _, n in got["v0000"]) == [f"v{i:04d}" for i in range(1, 6)]


def test_neighbours_over_a_least_cosine_and_of_few(spark):
    x = _cloud(300, 16, 2)
    x[1] = x[0] + 0.01
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, e array<float>")
    vectors = neighbours.usable_vectors(df, "id", "e", 16)
    near_ones = neighbours.nearest(vectors, 16, 5, min_cosine=0.99, rows_per_shard=64).collect()
    assert {(r["q"], r["n"]) for r in near_ones} == {(0, 1), (1, 0)}
    # Shards that can't be divided, and many queries of one shard: slices find the same.
    whole, cut = ({(r["q"], r["n"]) for r in neighbours.nearest(vectors, 16, 5, max_sample=n, rows_per_shard=m, queries_per_task=t).collect()} for n, m, t in ((200_000, 300, 20_000), (16, 16, 32)))
    assert whole == cut
    asked = neighbours.nearest(vectors, 16, 2, queries=df.where("id < 3").select("id"), rows_per_shard=64)
    assert sorted({r["q"] for r in asked.collect()}) == [0, 1, 2] and asked.count() == 6
    assert neighbours.nearest(vectors.limit(0), 16).count() == 0
    assert neighbours.nearest(vectors.where("id = 0"), 16).count() == 0


# Problem 8
def test_best_fit_takes_the_fullest_container():
    assert [sorted(b) for b in packing.best_fit([6, 5, 4, 3, 2], 10)] == [[0, 2], [1, 3, 4]]
    assert packing.best_fit([], 10) == []


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(3)
    sizes = [rng.randint(1, 700) for _ in range(3000)] + [2048] * 5 + [1500] * 20
    df = spark.createDataFrame([(f"i{i}", s) for i, s in enumerate(sizes)], "item string, room int").withColumns({"bin": F.lit(1), "shard": F.lit(2), "fill": F.lit(3)})
    out = packing.pack(df, 2048, items_per_task=400).collect()
    assert sorted(r["item"] for r in out) == sorted(f"i{i}" for i in range(len(sizes)))
    fill = {}
    for r in out:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["room"]
    assert all(f <= 2048 for f in fill.values()) and all(fill[r["container_id"]] == r["fill"] for r in out)
    assert len(fill) <= 1.03 * sum(sizes) / 2048 + 1
    assert packing.pack(df.limit(0), 2048).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df.withColumn("room", F.lit(3000)), 2048)


def test_packing_of_items_that_never_join(spark):
    df = spark.createDataFrame([(str(i), 1200) for i in range(500)], "item string, room int")
    assert packing.pack(df, 2048, items_per_task=50).select("container_id").distinct().count() == 500


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_parts_of_long_texts_tile_and_fit():
    rng = random.Random(6)
    for text in ("", "짧은 글임.", "어업인은 계획을 수립하도록 함. " * 200, "가" * 5000, "".join(rng.choice("가나 \n.é한😀") for _ in range(4000))):
        parts = tokens.parts(text, 128)
        assert "".join(text[a:b] for _, a, b, _ in parts) == text
        assert all(n <= 128 and n == tokens.count(text[a:b]) for _, a, b, n in parts)
    assert tokens.parts(None, 128) == [(0, 0, 0, 0)]


# Problem 9
def test_allocation_meets_reachable_targets():
    assert mixing.allocate({"a": 1000.0, "b": 1000.0}, {"a": 0.25, "b": 0.75}, 1000.0) == {"a": 250.0, "b": 750.0}
    got = mixing.allocate({"a": 100.0, "b": 1000.0, "c": 1000.0}, {"a": 0.5, "b": 0.25, "c": 0.25}, 1000.0)
    assert got == {"a": 100.0, "b": 450.0, "c": 450.0}
    assert mixing.allocate({}, {"a": 1.0}, 10.0) == {"a": 0.0}


def test_quotas_are_exact():
    counts = np.array([1000, 37, 0, 5])
    q = mixing.split_quotas(counts, 7)
    assert (q.sum(axis=0) == counts).all() and set(q.sum(axis=1)) <= {148, 149, 150} and (q >= 0).all()
    assert abs(q[:, 0] - 143).max() < 20
    big = mixing.split_quotas(np.array([5 * 10**9, 10**9]), 3)
    assert (big.sum(axis=0) == [5 * 10**9, 10**9]).all()


def test_large_draws_follow_the_same_law():
    rng = np.random.default_rng(5)
    for good, bad, draws in ((40, 60, 30), (5, 3, 6), (3, 100, 50), (1000, 1, 500)):
        mine = np.array([mixing._large_hypergeometric(rng, good, bad, draws) for _ in range(20_000)])
        theirs = rng.hypergeometric(good, bad, draws, 20_000)
        assert mine.min() >= max(0, draws - bad) and mine.max() <= min(good, draws)
        assert abs(np.bincount(mine, minlength=101) - np.bincount(theirs, minlength=101)).max() < 600
    n = [mixing._large_hypergeometric(rng, 3 * 10**9, 10**9, 10**9) for _ in range(40)]
    assert abs(np.mean(n) - 0.75 * 10**9) < 10_000 and 5_000 < np.std(n) < 20_000 and len(set(n)) > 35


def test_mixture_shares_repeats_and_shards(spark):
    rng = random.Random(8)
    rows = [(i, "big", rng.randint(1, 40)) for i in range(2000)] + [(5000 + i, "small", rng.randint(1, 40)) for i in range(50)] + [(9000, None, 5), (9001, "other", 5), (9002, "big", None)]
    df = spark.createDataFrame(rows, "id bigint, source string, tokens int").withColumns({"h": F.lit(1), "rest": F.lit(2), "block": F.lit(3), "shard": F.lit(4)})
    mixed, report = mixing.mixture(df, [("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], shards=5)
    out = mixed.collect()
    use = {}
    for r in out:
        use[r["id"]] = use.get(r["id"], 0) + 1
    assert all(n <= (3 if i in range(5000, 5050) else 1) for i, n in use.items()) and not {9000, 9001} & set(use)
    assert {use.get(5000 + i) for i in range(50)} == {3}  # its target is out of reach: every record, as often as it may
    assert len({(r["shard"], r["position"]) for r in out}) == len(out) == len({(r["id"], r["copy_no"]) for r in out})
    sizes = [sum(r["shard"] == s for r in out) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    shares = {r["source"]: r for r in report.collect()}
    assert shares["none"]["drawn_tokens"] == 0 and shares[None]["target_share"] == 0 and shares["small"]["drawn_records"] == 150
    _, exact = mixing.mixture(df, [("big", 0.5, 1), ("small", 0.5, 3)], budget="exact")
    assert all(abs(r["gap"]) < 0.01 for r in exact.collect() if r["target_share"])
    empty, report = mixing.mixture(df.limit(0), [("big", 1.0, 1)])
    assert empty.count() == 0 and report.count() == 1
    assert mixing.mixture(df, [])[0].count() == 0
