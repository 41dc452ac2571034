"""Splitting oversized items at natural boundaries (problem 1).

A text is parsed into a tree: sections under heading lines, list items by the kind of their mark, lines, sentences,
words. Sibling subtrees are merged bottom-up as long as they fit the budget; only oversized nodes are opened. The
pieces' own stretches tile the section exactly, so nothing is lost; each later piece repeats the end of the one
before it, from a sentence or word start where there is one.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# The plain section labels of the data model and the label of text before the first heading.
LABELS = ("제안이유", "주요내용", "제안이유 및 주요내용", "기대효과", "참고사항")
NO_SECTION = "body"

_SQUASHED = {label.replace(" ", ""): label for label in LABELS}
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_DECORATION = re.compile(r"(?:[\W_]|\(?(?:\d{1,2}|[가-하]|[IVX]+)[.)](?=\W))*")
_SPACE = re.compile(r"\s+")
#: List marks from the outermost to the innermost kind.
_LEVELS = [re.compile(p) for p in (r"\s*[IVX]+\.\s", r"\s*\(?\d{1,3}\.\s", r"\s*[가-하]\.\s", r"\s*\(?\d{1,3}\)\s", r"\s*\(?[가-하]\)\s", r"\s*[①-⑳㉑-㉟㊱-㊿]", r"\s*[□■◦○●ㅇㅁ▪]\s", r"\s*[-*•·※]\s")]
_SENTENCE_END = re.compile(r"(?:[.!?…]+[”’\"')\]」』]*(?:\s+|(?=[가-힣])(?<=[음함임됨다요]\.))|[。！？]+[”’」』]*\s*)")
_NOT_END = re.compile(r"(?:\d|\b[A-Za-z]{1,6}|\.[A-Za-z])\.\s*$")
_WORD_END = re.compile(r"\s+|[、，,]\s*")

PIECE = StructType([StructField("section", StringType()), StructField("section_no", IntegerType()), StructField("piece_no", IntegerType()), StructField("start_char", IntegerType()), StructField("end_char", IntegerType()), StructField("overlap_chars", IntegerType()), StructField("text", StringType())])


@dataclass
class Node:
    start: int
    end: int
    level: int = -1
    children: list[Node] = field(default_factory=list)


def plain_label(line: str | None) -> str | None:
    """The plain label of a heading line or section column, whatever its decoration; None for other text."""
    if not line:
        return None
    start, end = _DECORATION.match(line).end(), len(line)
    while end > start and not line[end - 1].isalnum():
        end -= 1
    return _SQUASHED.get(_SPACE.sub("", line[start:end])) or _SQUASHED.get(_SPACE.sub("", line))


def sections(text: str) -> list[tuple[str, int, int]]:
    """(label, start, end) of each section's body; heading lines belong to none."""
    out, label, start, at = [], NO_SECTION, 0, 0
    while at < len(text):
        line = _LINE.match(text, at)
        if found := plain_label(line[0]):
            out.append((label, start, at))
            label, start = found, line.end()
        at = line.end()
    out.append((label, start, len(text)))
    return [s for s in out if text[s[1] : s[2]].strip()]


def _tile(ends: list[int], start: int, end: int) -> list[Node]:
    cuts = [start, *(e for e in ends if start < e < end), end]
    return [Node(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _sentences(text: str, start: int, end: int) -> list[Node]:
    ends = []
    for m in _SENTENCE_END.finditer(text, start, end):
        if not (text[m.start()] == "." and _NOT_END.search(text, max(start, m.start() - 8), m.start() + 1)):
            ends.append(m.end())
    return _tile(ends, start, end)


def _words(text: str, start: int, end: int) -> list[Node]:
    return _tile([m.end() for m in _WORD_END.finditer(text, start, end)], start, end)


def parse(text: str, start: int, end: int) -> Node:
    """The tree of a section: lines nested by list level, under the section."""
    root = Node(start, end)
    path, at = [root], start
    while at < end:
        stop = min(end, _LINE.match(text, at).end())
        while stop < end and not text[at:stop].strip():  # blank lines go with the line after them
            stop = min(end, _LINE.match(text, stop).end())
        head = text[at : min(stop, at + 16)]
        level = next((i for i, p in enumerate(_LEVELS) if p.match(head)), None)
        if level is not None:
            while len(path) > 1 and path[-1].level >= level:
                path.pop()
        parent = path[-1]
        if not parent.children and parent.level >= 0:  # the item's own line becomes its first child
            parent.children.append(Node(parent.start, parent.end))
        node = Node(at, stop, -1 if level is None else level)
        parent.children.append(node)
        for p in path:
            p.end = max(p.end, stop)
        if level is not None:
            path.append(node)
        at = stop
    return root


def _hard(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    out = []
    while end - start > limit:
        cut = start + limit
        while cut > start + limit // 2 and (unicodedata.combining(text[cut]) or text[cut] in "‍️" or text[cut - 1] == "‍"):
            cut -= 1
        out.append((start, cut))
        start = cut
    return [*out, (start, end)]


def pack(text: str, node: Node, limit: int, budget: int) -> list[tuple[int, int]]:
    """Stretches that tile the node, each at most ``limit`` long and, where merged, at most ``budget``."""
    if node.end - node.start <= budget:
        return [(node.start, node.end)]
    children = node.children
    if not children:
        children = _sentences(text, node.start, node.end)
        if len(children) == 1:
            if node.end - node.start <= limit:
                return [(node.start, node.end)]
            children = _words(text, node.start, node.end)
            if len(children) == 1:
                return _hard(text, node.start, node.end, budget)
    out: list[tuple[int, int]] = []
    current: tuple[int, int] | None = None
    for child in children:
        if child.end - child.start > budget:
            if current:
                out.append(current)
            out += pack(text, child, limit, budget)
            current = None
        elif current and child.end - current[0] <= budget:
            current = (current[0], child.end)
        else:
            if current:
                out.append(current)
            current = (child.start, child.end)
    return [*out, current] if current else out


def _overlap_start(text: str, start: int, end: int, room: int) -> int:
    """Where the repeated end of a piece begins: the earliest sentence start, else word start, within ``room``."""
    low = max(start, end - room)
    if low >= end or room <= 0:
        return end
    if low == start:
        return start
    for tile in (_sentences, _words):
        if starts := [n.start for n in tile(text, start, end) if low <= n.start < end]:
            return starts[0]
    return low


def split_span(text: str, start: int, end: int, limit: int = 200, overlap: int = 50) -> list[tuple[int, int, int]]:
    """(repeat_start, start, end) of each piece of a stretch; ``text[repeat_start:end]`` is at most ``limit`` long."""
    spans = pack(text, parse(text, start, end), limit, max(1, limit - overlap))
    out, before = [], None
    for a, b in spans:
        repeat = a if before is None else _overlap_start(text, before[0], a, min(overlap, limit - (b - a)))
        out.append((repeat, a, b))
        before = (a, b)
    return out


def split_text(text: str | None, limit: int = 200, overlap: int = 50, by_section: bool = True, label: str = NO_SECTION) -> list[dict]:
    """The pieces of each section longer than ``limit``, white space at its ends aside; none for null and short texts."""
    out: list[dict] = []
    if not text or len(text) <= limit:
        return out
    for no, (name, start, end) in enumerate(sections(text) if by_section else [(label, 0, len(text))]):
        if len(text[start:end].strip()) <= limit:
            continue
        for piece, (repeat, a, b) in enumerate(split_span(text, start, end, limit, overlap)):
            out.append({"section": name, "section_no": no, "piece_no": piece, "start_char": a, "end_char": b, "overlap_chars": a - repeat, "text": text[repeat:b]})
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 200, overlap: int = 50, section: str | None = None) -> DataFrame:
    """Pieces of every oversized section: ``item_id``, ``section``, ``section_no``, ``piece_no``, ``start_char``,
    ``end_char``, ``overlap_chars``, ``text``.

    Without ``section`` the texts are parsed for heading lines; with it each text is one section named by that
    column's plain label (its trimmed value where it is none of the labels, ``body`` where it is null). Null, empty
    and short texts give no rows, as they need no cut; rows that repeat key, section and text count once. Short
    texts never reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie in [0, limit)")
    cols: list[Column] = [F.col(key).cast("string").alias("item_id"), F.col(text).alias("t"), (F.col(section) if section else F.lit(None).cast("string")).alias("own")]
    long = df.where(F.length(text) > limit).select(*cols).distinct()

    @F.pandas_udf(ArrayType(PIECE))
    def pieces(texts: pd.Series, labels: pd.Series) -> pd.Series:
        if section is None:
            return texts.map(lambda t: split_text(t, limit, overlap))
        names = labels.map(lambda s: plain_label(s) or (s.strip() if isinstance(s, str) and s.strip() else NO_SECTION))
        return pd.Series([split_text(t, limit, overlap, False, n) for t, n in zip(texts, names, strict=True)])

    return long.select("item_id", F.inline(pieces("t", "own")))
