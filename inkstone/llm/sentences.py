"""Sentence units across languages and scripts (problem 4).

Candidate boundaries are generated by rules that hold in every script (line breaks, marks with their closing
quotes, gaps that may hide an unmarked end) and each is classified by a maximum-entropy model over the
neighbouring tokens, case, length, digits and script. The model is trained on boundaries that are certain without
it: line ends on the one side; decimals, periods before lower case, quotations that run on and gaps inside lines
on the other. No labelled data are needed, and the corpus decides what ends a sentence in its languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from inkstone.session import hash_limit

MARKS = ".!?…。！？｡؟।"
CLOSERS = "”’\"')）]】」』》〉>"
PAIRS = {"“": "”", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", '"': '"'}
LINE = re.compile(r"[^\r\n\x0b\x0c\x85\u2028\u2029]+")
LIST_MARK = re.compile(r"\s*(?:[①-⑳㉑-㉟㊱-㊿]|\(?[0-9]{1,3}[.)]|\(?[가-힣][.)]|[ㅇㅁ○●■□▪◦•·※*-]|\(?[A-Za-z][.)]|[ivxIVX]{1,5}[.)])\s+")
_OPEN = re.compile("[" + re.escape("".join(PAIRS)) + "]")
_DATE_PART = re.compile(r"\d+\.$")
_LAST_BEFORE_GAP = re.compile(r"([가-힣฀-๿])[ \u00a0\u3000]+(?=\S)")
_LAST_BEFORE_MARK = re.compile(f"([가-힣฀-๿])(?:[{re.escape(MARKS)}]|$)", re.M)


def end_pattern(finals: str) -> re.Pattern[str]:
    """Marks with the closing signs after them, or a gap after a character that often ends sentences."""
    gap = rf"|(?<=[{re.escape(finals)}])[ \u00a0\u3000]+(?=\S)" if finals else ""
    return re.compile(rf"[{re.escape(MARKS)}]+[{re.escape(CLOSERS)}]*{gap}")


def _shape(token: str) -> str:
    """A token's kind: digits, dotted or plain Latin by case, Hangul, kana, ideographs, Thai, closing bracket, other."""
    if not token:
        return "-"
    c = token[-1]
    if token.isascii():
        if token.isdigit():
            return "d"
        if c.isdigit():
            return "xd"
        if c in CLOSERS:
            return ")"
        if "." in token:
            return "a."
        return ("A" if len(token) <= 2 else "AA") if token.isupper() else ("Aa" if token[0].isupper() else "a") + ("s" if len(token) <= 4 else "")
    o = ord(c)
    return "h" if 0xAC00 <= o <= 0xD7A3 else "k" if 0x3040 <= o <= 0x30FF else "c" if 0x4E00 <= o <= 0x9FFF else "t" if 0xE00 <= o <= 0xE7F else ")" if c in CLOSERS else "d" if c.isdigit() else "o"


def _opens(text: str) -> str:
    """The kind of what follows."""
    if not text:
        return "-"
    c = text[0]
    if c.isascii():
        return "d" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "(" if c in PAIRS else "o"
    o = ord(c)
    return "h" if 0xAC00 <= o <= 0xD7A3 else "k" if 0x3040 <= o <= 0x30FF else "c" if 0x4E00 <= o <= 0x9FFF else "t" if 0xE00 <= o <= 0xE7F else "(" if c in PAIRS else "o"


def _context(before: str, mark: str, closer: str, gap: bool, after: str) -> tuple:
    """What the model may look at; equal contexts get equal answers, so answers are kept."""
    tokens = before.rsplit(None, 2)
    token, previous = (tokens[-1], tokens[-2] if len(tokens) > 1 else "") if tokens else ("", "")
    kind = _shape(token)
    word = token.lower()[-8:] if kind[0] in "Aa" else ""
    dated = kind[-1] == "d" and bool(_DATE_PART.search(previous))
    return kind, token[-2:], word, dated, mark[:2], closer[:1], gap, _opens(after), after[:2], min(len(token), 4)


def _features(context: tuple) -> list[str]:
    kind, tail, word, dated, mark, closer, gap, opens, head, length = context
    m, c, g = mark or "_", closer or "_", "g" if gap else "j"
    out = ["b", f"m{m}", f"k{kind}", f"t{tail[-1:]}", f"t{tail}", f"o{opens}", f"h{head[:1]}", f"h{head}", f"mk{m}{kind}", f"mo{m}{opens}{g}", f"ko{kind}{opens}", f"c{c}{opens}{g}", f"mt{m}{tail}", f"l{length}{m}", f"ck{c}{m}{g}"]
    if word:
        out += [f"w{word}", f"wo{word}{opens}"]
    if dated:
        out += ["dated", f"dated{opens}"]
    return out


def _spans(line: str) -> list[tuple[int, int]]:
    """Outermost quoted or bracketed stretches that close within the line; end is after the closing sign."""
    out, at = [], 0
    while found := _OPEN.search(line, at):
        opening, i = found[0], found.end()
        closing, depth = PAIRS[opening], 1
        while depth:
            close = line.find(closing, i)
            if close < 0:
                break
            depth += (line.count(opening, i, close) if opening != closing else 0) - 1
            i = close + 1
        if depth:
            at = found.end()
        else:
            out.append((found.start(), i))
            at = i
    return out


def _candidates(ends: re.Pattern[str], line: str, body: int) -> Iterator[tuple[int, str, str, str]]:
    """(end, text before the mark, mark, closers) of every place in a line that may end a sentence."""
    spans = _spans(line) if _OPEN.search(line) else ()
    s = 0
    for found in ends.finditer(line, body):
        start, end = found.span()
        text = found[0]
        mark = text.rstrip(CLOSERS) if text[0] in MARKS else ""
        if spans:
            while s < len(spans) and spans[s][1] <= start:
                s += 1
            if s < len(spans) and spans[s][0] < start and (not mark or start + len(mark) != spans[s][1] - 1):
                continue  # inside brackets or quotes that go on
        if mark:
            yield end, line[max(0, start - 24) : start], mark, text[len(mark) :]
        else:
            yield start, line[max(0, start - 24) : start], "", ""


_WORD = re.compile(r"\w")

#: Answers by model and context, kept for the life of a Python worker.
_ANSWERS: dict[int, dict[tuple, bool]] = {}


@dataclass
class BoundaryModel:
    """Weights of the features of a candidate boundary, and the characters after which a gap may hide an end."""

    weights: dict[str, float]
    finals: str = ""

    def __post_init__(self) -> None:
        self.ends = end_pattern(self.finals)
        self.known = _ANSWERS.setdefault(hash((self.finals, *sorted(self.weights.items()))), {})

    def __getstate__(self) -> tuple:
        return self.weights, self.finals

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.finals = state
        self.__post_init__()

    def is_end(self, context: tuple) -> bool:
        known = self.known.get(context)
        if known is None:
            get = self.weights.get
            known = sum(get(f, 0.0) for f in _features(context)) > 0
            if len(self.known) < 500_000:
                self.known[context] = known
        return known

    def starts(self, text: str | None) -> list[int]:
        """Code-point positions of the first visible character of each sentence; none for null and blank texts."""
        out: list[int] = []
        for found in LINE.finditer(text or ""):
            line, base = found[0].rstrip(), found.start()
            start = len(line) - len(line.lstrip())
            if not line:
                continue
            out.append(base + start)
            listed = LIST_MARK.match(line)
            for end, before, mark, closer in _candidates(self.ends, line, listed.end() if listed else start):
                after = line[end : end + 12]
                rest = after.lstrip()
                if not rest:
                    continue
                gap = len(after) - len(rest)
                if self.is_end(_context(before, mark, closer, gap > 0, rest)) and _WORD.search(line, end):
                    out.append(base + end + gap)
        return out

    def split(self, text: str | None) -> list[str]:
        starts = self.starts(text)
        return [text[a:b].rstrip() for a, b in zip(starts, [*starts[1:], len(text or "")], strict=True)]


def count_finals(texts: Iterable[str]) -> tuple[Counter, Counter]:
    """How often each letter stands before a gap, and before a mark or line end."""
    gaps, ends = Counter(), Counter()
    for text in texts:
        gaps.update(_LAST_BEFORE_GAP.findall(text))
        ends.update(_LAST_BEFORE_MARK.findall(text))
    return gaps, ends


def choose_finals(gaps: Counter, ends: Counter, least: float = 0.2) -> str:
    """Letters that stand before a mark or line end at least ``least`` times as often as before a gap."""
    return "".join(sorted(c for c, n in ends.items() if n >= max(3, least * gaps[c]) or "\u0e00" <= c <= "\u0e7f"))


def final_characters(texts: list[str], least: float = 0.2) -> str:
    return choose_finals(*count_finals(texts), least)


def corpus_finals(frames: list[tuple[DataFrame, str]]) -> str:
    """``final_characters`` of all texts of the frames; a row a letter comes to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gaps, ends = Counter(), Counter()
        for batch in batches:
            for total, found in zip((gaps, ends), count_finals(batch["t"]), strict=True):
                total.update(found)
        yield pd.DataFrame([(c, gaps[c], ends[c]) for c in gaps | ends], columns=["c", "gaps", "ends"])

    gaps, ends = Counter(), Counter()
    for df, column in frames:
        counted = df.where(F.length(column) > 0).select(F.col(column).alias("t")).mapInPandas(count, "c string, gaps bigint, ends bigint")
        for r in counted.groupBy("c").agg(F.sum("gaps").alias("gaps"), F.sum("ends").alias("ends")).collect():
            gaps[r["c"]] += r["gaps"]
            ends[r["c"]] += r["ends"]
    return choose_finals(gaps, ends)


def training_examples(texts: list[str], ends: re.Pattern[str]) -> tuple[list[tuple], list[int], list[float]]:
    """Contexts of certain boundaries (1) and certain non-boundaries (0) with weights."""
    contexts, labels, weights = [], [], []

    def add(label: int, weight: float, *context: object) -> None:
        contexts.append(_context(*context))
        labels.append(label)
        weights.append(weight)

    for text in texts:
        lines = [x for x in (m[0].strip() for m in LINE.finditer(text or "")) if x]
        for line, following in zip(lines, [*lines[1:], None], strict=False):
            listed = LIST_MARK.match(line)
            for end, before, mark, closer in _candidates(ends, line, listed.end() if listed else 0):
                rest = line[end:].lstrip()
                gap = len(rest) < len(line) - end
                opens = _opens(rest)
                if not rest:
                    continue
                if not mark:
                    add(0, 1.0, before, "", "", True, rest)
                elif closer and not gap and opens in "hk":
                    add(0, 1.0, before, mark, closer, gap, rest)  # a quotation that runs on
                elif not closer and not gap and (opens in "da" or before[-1:].isdigit() or opens == "A" and before[-2:-1] in (" ", ".", "")):
                    add(0, 1.0, before, mark, closer, gap, rest)  # decimals and dotted letters
                elif gap and before[-1:].isascii() and before[-1:].isalnum() and (opens in "da" or before[-1:].isdigit() and _DATE_PART.search(before.rsplit(None, 1)[0])):
                    add(0, 1.0, before, mark, closer, gap, rest)  # abbreviations, numbered signs and dates
            if following is None or len(line) < 12:
                continue
            bare = line.rstrip(CLOSERS)
            core = bare.rstrip(MARKS)
            mark, closer = bare[len(core) :], line[len(bare) :]
            if not mark:
                core, closer = line, ""
            listed = LIST_MARK.match(following)
            after = following[listed.end() :] if listed else following
            add(1, 1.0, core[-24:], mark, closer, True, after)
            if mark:
                add(1, 0.5, core[-24:], mark, closer, False, after)
                add(1, 0.6, core[-24:], "", "", True, after)
    return contexts, labels, weights


def train(texts: list[str], rounds: int = 80, penalty: float = 1e-4, finals: str | None = None) -> BoundaryModel:
    """Maximum-entropy fit (full-batch, Adam) of the boundary features; deterministic for the same texts.

    ``finals`` are the texts' own unless given.
    """
    finals = final_characters(texts) if finals is None else finals
    contexts, labels, weights = training_examples(texts, end_pattern(finals))
    index: dict[str, int] = {}
    ids, sizes = [], []
    for context in contexts:
        row = [index.setdefault(f, len(index)) for f in _features(context)]
        ids += row
        sizes.append(len(row))
    if not ids or len(set(labels)) < 2:
        return BoundaryModel({"b": -1.0, "m.": 2.0, "m!": 2.0, "m?": 2.0, "m。": 2.0, "m！": 2.0, "m？": 2.0})
    flat, size = np.array(ids, "i4"), np.array(sizes)
    offsets = np.concatenate([[0], np.cumsum(size)[:-1]])
    y, w = np.array(labels, "f8"), np.array(weights)
    w = w / w.sum()
    beta, m, v = (np.zeros(len(index)) for _ in range(3))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.add.reduceat(beta[flat], offsets)))
        g = np.bincount(flat, weights=np.repeat((p - y) * w, size), minlength=len(index)) + penalty * beta / len(index)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        beta -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return BoundaryModel({f: round(float(beta[i]), 4) for f, i in index.items() if abs(beta[i]) > 1e-3}, finals)


def fit_boundary_model(frames: list[tuple[DataFrame, str]], max_texts: int = 1_000) -> BoundaryModel:
    """Fits on at most ``max_texts`` texts of each frame, taken in the order of a hash of the text.

    The characters that may end a sentence without a mark are counted over all texts.
    A hash range expected to hold twice that many is cut out first, so the driver is sent no more than it needs.
    """
    sample: list[str] = []
    for df, column in frames:
        usable = df.where(F.length(column) > 12).select(F.xxhash64(column).alias("h"), F.col(column).alias("t"))
        share = min(1.0, 2 * max_texts / max(1, usable.count()))
        rows = usable.where(F.col("h") <= hash_limit(share)).orderBy("h", "t").limit(max_texts)
        sample += [r["t"] for r in rows.collect()]
    return train(sample, finals=corpus_finals(frames))


def starts_udf(model: BoundaryModel):
    @F.pandas_udf(ArrayType(IntegerType()))
    def starts(texts: pd.Series) -> pd.Series:
        return texts.map(model.starts)

    return starts


def sentence_starts(df: DataFrame, key: str, text: str, model: BoundaryModel) -> DataFrame:
    """(``item_id``, ``start_char``) of every sentence. Null and blank texts have none; repeated rows count once."""
    found = df.where(F.length(text) > 0).select(F.col(key).cast("string").alias("item_id"), F.explode(starts_udf(model)(F.col(text))).alias("start_char"))
    return found.distinct()


def sentences(df: DataFrame, key: str, text: str, model: BoundaryModel) -> DataFrame:
    """(``item_id``, ``sentence_no``, ``start_char``, ``sentence``), cut in the JVM from the start positions."""
    t = df.where(F.length(text) > 0).select(F.col(key).cast("string").alias("item_id"), F.col(text).alias("t")).distinct()
    t = t.withColumn("s", starts_udf(model)(F.col("t")))
    ends = F.concat(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), F.array(F.length("t")))
    t = t.where(F.size("s") > 0).select("item_id", "t", F.posexplode(F.arrays_zip(F.col("s").alias("a"), ends.alias("b"))).alias("sentence_no", "p"))
    return t.select("item_id", "sentence_no", F.col("p.a").alias("start_char"), F.rtrim(F.substring(F.col("t"), F.col("p.a") + 1, F.col("p.b") - F.col("p.a"))).alias("sentence"))


def sentence_counts(df: DataFrame, key: str, text: str, model: BoundaryModel) -> DataFrame:
    """(``item_id``, ``sentences``) per distinct row; 0 for null and blank texts."""
    return df.select(F.col(key).cast("string").alias("item_id"), F.col(text).alias("t")).distinct().select("item_id", F.coalesce(F.size(starts_udf(model)(F.coalesce("t", F.lit("")))), F.lit(0)).alias("sentences"))
