"""Problems 1, 3, 4 and 10: splitting, consistent form, sentences, abusive content."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.llm import abuse, canon, sentences, splitting

# Problem 1
MIXED = st.text(alphabet=st.sampled_from(list("가나다 .!?。ab12\n\r①-ㅇ、，́‍")), max_size=900)


@settings(max_examples=150, deadline=None)
@given(MIXED, st.integers(20, 200), st.integers(0, 15))
def test_pieces_tile_their_sections(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    for no, (label, start, end) in enumerate(splitting.sections(text)):
        own = [p for p in pieces if p["section_no"] == no]
        if len(text[start:end].strip()) <= limit:
            assert not own
            continue
        assert "".join(text[p["start_char"] : p["end_char"]] for p in own) == text[start:end]
        for p in own:
            assert len(p["text"]) <= limit and 0 <= p["overlap_chars"] <= overlap and p["section"] == label
            assert p["text"] == text[p["start_char"] - p["overlap_chars"] : p["end_char"]]


def test_pieces_end_at_sentences_and_repeat_some_text():
    text = "주요내용\n" + " ".join(f"제{i}조에 따라 어업인은 계획을 수립하고 공개하도록 함." for i in range(30))
    pieces = splitting.split_text(text)
    assert all(p["text"].rstrip().endswith(".") for p in pieces)
    assert all(p["overlap_chars"] > 0 for p in pieces[1:]) and {p["section"] for p in pieces} == {"주요내용"}


def test_very_long_texts_without_breaks_are_cut_hard():
    pieces = splitting.split_text("가" * 100_000)
    assert max(len(p["text"]) for p in pieces) <= 200 and sum(p["end_char"] - p["start_char"] for p in pieces) == 100_000


@pytest.mark.parametrize("line", ["제안이유", "◇ 제안이유 ◇", "[제안 이유]", "【제안이유】", "<제안이유>", "제안이유:", "1. 제안이유", "  □ 제안이유"])
def test_heading_lines_in_every_decoration(line):
    assert splitting.plain_label(line) == "제안이유"


@pytest.mark.parametrize("line", ["제안이유는 다음과 같음", "주요", "", None, "가"])
def test_other_lines_are_no_headings(line):
    assert splitting.plain_label(line) is None


def test_splitting_of_odd_rows(spark):
    long = "문장임. " * 60
    rows = [("a", long, "■ 주요내용"), ("a", long, "■ 주요내용"), ("b", None, None), ("c", "", "x"), (None, long, None), ("d", "짧음", "주요내용"), ("e", long, " 기타 "), ("f", " " * 400, None)]
    df = spark.createDataFrame(rows, "id string, t string, s string").withColumns({"item_id": F.lit(1), "section_no": F.lit("x"), "own": F.lit(0)})
    out = splitting.split_oversized(df, "id", "t", section="s")
    got = {tuple(r) for r in out.select("item_id", "section").distinct().collect()}
    assert got == {("a", "주요내용"), (None, "body"), ("e", "기타")}
    assert out.where("item_id = 'a' AND piece_no = 0").count() == 1
    assert splitting.split_oversized(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "id", "t", limit=10, overlap=10)


# Problem 3
@pytest.mark.parametrize(
    "a,b",
    [("ＡＩ", "AI"), ("A­I", "AI"), ("한​글", "한글"), (unicodedata.normalize("NFD", "각하"), "각하"), ("е́", "é"), ("｢가｣", "「가」"), ("가·나", "가ㆍ나"), ("가 나", "가 나"), ("가\r\n나", "가\n나"), ("가‐나", "가-나"), ("來", "來"), ("Α﻿", "A"), ("가  \n나 ", "가\n나")],
)
def test_looks_the_same(a, b):
    assert canon.canonical(a) == canon.canonical(b)


@pytest.mark.parametrize("a,b", [("⑫", "12"), ("가 나", "가나"), ("가\n나", "가 나"), ("²", "2"), ("가  나", "가 나"), ("ﬁ", "fi")])
def test_shows_something_else(a, b):
    assert canon.canonical(a) != canon.canonical(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_consistent_form_is_stable(text):
    once = canon.canonical(text)
    assert canon.canonical(once) == once


def test_conflicting_rules_are_refused():
    with pytest.raises(canon.MappingConflict):
        canon.Transducer([("one", {"a": "b"}), ("two", {"a": "c"})])
    with pytest.raises(canon.MappingConflict):
        canon.Transducer([("one", {"a": "b"}), ("two", {"b": "a"})])


def test_look_alikes_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["AI 가나", "ESG 다라", "같은 글", ""]
    spoil = [lambda s: s, lambda s: s.replace("A", "Ａ"), lambda s: s.replace(" ", " "), lambda s: unicodedata.normalize("NFD", s), lambda s: s + "​"]
    rows = [(i, rng.choice(spoil)(rng.choice(base)), None) for i in range(120)] + [(5000, None, "x"), (None, "AI 가나", "x"), (5001, "  ", "")]
    df = spark.createDataFrame([*rows, rows[0]], "k int, s string, r string").withColumns({"text": F.lit("t"), "canon": F.lit(1), "v1": F.lit(2)})
    got = {tuple(r) for r in canon.look_alikes(df, "k", ["s", "r"], rows_per_salt=9).collect()}
    want = {(a, b, "s") for a, x, _ in rows for b, y, _ in rows if a is not None and b is not None and a < b and x and y and canon.canonical(x).strip() and x != y and canon.canonical(x) == canon.canonical(y)}
    assert got == want and want
    assert canon.look_alikes(df.limit(0), "k", ["s"]).count() == 0
    assert canon.canonicalize(df.withColumn("s_canonical", F.lit(1)), ["s"]).where("k = 5000").first()["s_canonical"] is None


# Problem 4
TRAINING = ["제안이유\n어업인은 계획을 수립하도록 함.\n이에 따라 예산을 정하려는 것임.\n어업인은 “안내가 먼저다. 예산은 나중이다.”라고 밝혔음.\n현장의 부담이 커지고 있음.\n2016. 2. 20.부터 시행함.\n안전이 먼저임."] * 40 + ["费用由经营者承担。\n名单须公开。\n该条扩大适用范围。"] * 20 + ["The board met on Jan. 2027 and rose 3.5 points.\nThe rule applies e.g. to small boats.\nFees rose again."] * 20


@pytest.fixture(scope="module")
def model():
    return sentences.train(TRAINING)


@pytest.mark.parametrize(
    "text,count",
    [("계획을 수립하도록 함. 예산을 정하려는 것임.", 2), ("비율은 3.5퍼센트임. 커지고 있음.", 2), ("첫 줄\n둘째 줄", 2), ("费用由经营者承担。名单须公开。", 2), ("가. 예산을 정하려는 것임.", 1), ("(안 제2조. 가). 커지고 있음.", 2), ("", 0), (None, 0), ("  \n ", 0), ("“가다. 나다.”라고 함.", 1)],
)
def test_sentences(model, text, count):
    assert len(model.starts(text)) == count


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("가함음. 。!?\n\r“”(),ab1٣")), max_size=300))
def test_starts_are_visible_and_rise(text):
    starts = sentences.BoundaryModel({"b": 0.5}, "함음").starts(text)
    assert starts == sorted(set(starts)) and all(not text[s].isspace() for s in starts)


def test_model_learns_from_nothing_and_is_deterministic(model):
    assert sentences.train([]).starts("가. 나다라. 마바") != []
    assert sentences.train(TRAINING).weights == model.weights


def test_sentence_rows(spark, model):
    rows = [("a", "하나임. 둘임."), ("a", "하나임. 둘임."), ("b", None), ("c", ""), (None, "셋임.")]
    df = spark.createDataFrame(rows, "id string, t string").withColumns({"item_id": F.lit(1), "start_char": F.lit("s")})
    always = sentences.BoundaryModel({"b": 1.0})
    assert sorted((r[0] or "", r[1]) for r in sentences.sentence_starts(df, "id", "t", always).collect()) == [("", 0), ("a", 0), ("a", 5)]
    assert [r["sentence"] for r in sentences.sentences(df, "id", "t", always).where("item_id = 'a'").orderBy("sentence_no").collect()] == ["하나임.", "둘임."]
    assert {(r[0], r[1]) for r in sentences.sentence_counts(df, "id", "t", always).collect()} == {("a", 2), ("b", 0), ("c", 0), (None, 1)}
    assert sentences.sentence_starts(df.limit(0), "id", "t", always).count() == 0
    assert isinstance(sentences.fit_boundary_model([(df, "t"), (df.limit(0), "t")]), sentences.BoundaryModel)


# Problem 10
def _documents(n, seed):
    rng = random.Random(seed)
    calm = ["예산이 줄었다는데 괜찮을까요", "안내가 너무 느렸습니다", "단계별로 해야 한다고 봅니다", "쓰레기 처리 문제로 힘들어합니다", "residents reported a new plan"]
    rude = ["야 이 바보멍청아 뭘 하냐", "너 같은 건 사라져라", "you are a dumb idiot"]
    texts, labels = [], []
    for _ in range(n):
        parts, bad = [rng.choice(calm) for _ in range(rng.randint(1, 4))], rng.random() < 0.3
        if bad:
            s = rng.choice(rude)
            if rng.random() < 0.4:
                i = rng.randrange(1, len(s) - 1)
                s = s[:i] + rng.choice(["^", "~", " "]) + s[i:]
            parts.insert(rng.randrange(len(parts) + 1), s)
        texts.append(". ".join(parts))
        labels.append(int(bad))
    return texts, labels


def test_held_out_accuracy():
    model = abuse.train(*_documents(300, 1))
    texts, labels = _documents(200, 2)
    flagged = model.score(texts) > model.threshold
    assert sum(f == bool(y) for f, y in zip(flagged, labels, strict=True)) >= 190


def test_batches_and_single_texts_score_alike():
    model = abuse.train(*_documents(120, 3))
    texts = [*_documents(30, 4)[0], "", None, "!!!", "가", "가" * 5000]
    together = model.score(texts)
    assert [round(float(s), 4) for s in together] == [round(float(model.score([t])[0]), 4) for t in texts]
    assert together[30] == together[31] == together[32] == -1.0


def test_fit_leaves_out_split_votes_and_nulls(spark):
    texts, labels = _documents(80, 5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (None, "x")], "id bigint, t string").withColumns({"score": F.lit("s"), "h": F.lit(0)})
    votes = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, 1 - labels[0]), (900, 1), (None, 1), (3, None)], "id bigint, y int")
    model = abuse.fit(docs, votes, "id", "t", "y")
    out = abuse.score(docs, "t", model)
    assert out.count() == docs.count() and out.where("id = 900").first()["flagged"] is False
    assert sum(r["flagged"] == bool(labels[r["id"]]) for r in out.where("id < 80").collect()) >= 72
    nothing = abuse.fit(docs, votes.limit(0), "id", "t", "y")
    assert abuse.score(docs, "t", nothing).where("flagged").count() == 0
    assert abuse.score(docs.limit(0), "t", model).count() == 0


@pytest.mark.parametrize("line", ["─" * 40 + " 제안이유 " + "─" * 40, "주요내용" + " " * 60, "== 1. 제안이유 및 주요내용 ==" + "\t" * 50 + "\r\n"])
def test_long_decoration_does_not_hide_a_heading(line):
    assert splitting.plain_label(line) in splitting.LABELS
    assert [s[0] for s in splitting.sections("앞의 글임.\n" + line.rstrip("\r\n") + "\n뒤의 글임.")] == ["body", splitting.plain_label(line)]
    assert splitting.plain_label("이 법의 " + line.strip()) is None and splitting.plain_label("-" * 100_000 + "가") is None


def test_rare_final_letters_outside_the_sample_are_counted(spark):
    rows = [(f"{i}번째 위원회는 계획을 수립하도록 함.\n비율은 {i}.5퍼센트로 함.",) for i in range(400)] + [(f"{i}번째 바위가 골짜기로 굴러 쿵\n다음 줄의 내용임.",) for i in range(4)]
    df = spark.createDataFrame(rows, "t string")
    model = sentences.fit_boundary_model([(df, "t"), (df.limit(0), "t")], max_texts=20)
    assert model.finals == sentences.final_characters([t for t, in rows]) and "쿵" in model.finals
