"""Section-aware chunks: one notice in, its chunks out.

Cleaning and section detection are Column expressions. Packing carries state from unit to unit, so it runs as an
Arrow-batched function per notice; notices never have to be brought together, so there is no shuffle.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from inkstone.config import Settings
from inkstone.functions import text as T

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SECTION = StructType([StructField("section", StringType()), StructField("lines", ArrayType(StringType()))])
BODY = StructType([StructField("section", StringType()), StructField("text", StringType())])


def labelled_lines(column: str | Column) -> Column:
    """array<struct(label, line)> of a cleaned text: a heading line has its label, and what follows it as line."""
    return F.transform(T.paragraphs(column), lambda p: F.struct(T.header_label(p).alias("label"), F.when(T.header_label(p) != "", T.header_tail(p)).otherwise(p).alias("line")))


def _grouped(lines: list) -> list[tuple[str, list[str]]]:
    """Sections from labelled lines, in one pass: a heading opens one; those without lines are dropped."""
    out: list[tuple[str, list[str]]] = [(T.NO_SECTION, [])]
    for item in lines:
        if item["label"]:
            out.append((item["label"], []))
        if item.get("kept", item["line"] != "") or not item["label"]:
            out[-1][1].append(item["line"])
    return [s for s in out if s[1]]


@F.pandas_udf(ArrayType(SECTION))
def _sections(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else _grouped(x))


def sections_of(column: str | Column) -> Column:
    """array<struct(section, lines)> of a cleaned text; text before the first heading is ``body``, repeated labels stay
    apart."""
    return _sections(labelled_lines(column))


def units(paragraph: str, limit: int) -> Iterator[str]:
    """A paragraph in stretches of at most ``limit`` characters: whole, else sentences joined while they fit, else cuts."""
    if len(paragraph) <= limit:
        yield paragraph
        return
    held: list[str] = []
    room = limit
    for sentence in filter(None, map(str.strip, _SENTENCE.split(paragraph))):
        need = len(sentence) + bool(held)
        if need > room and held:
            yield " ".join(held)
            held, room, need = [], limit, len(sentence)
        if need > limit:
            yield from (sentence[a : a + limit] for a in range(0, len(sentence), limit))
        else:
            held.append(sentence)
            room -= need
    if held:
        yield " ".join(held)


class Packer:
    """Joins units by line breaks up to a limit; each chunk opens with the last units of the one before it, as far as
    their characters stay within the overlap, and gives up the first of them where the next unit needs the room."""

    def __init__(self, limit: int, overlap: int, least: int):
        self.limit, self.overlap, self.least = limit, overlap, least
        self.window: deque[str] = deque()
        self.repeated = 0  # units at the window's start that the chunk before holds already
        self.length = 0  # of the window, joined
        self.out: list[str] = []

    def _drop_first(self) -> None:
        self.length -= len(self.window.popleft()) + bool(self.window)
        self.repeated -= 1

    def _close(self) -> None:
        own = list(self.window)[self.repeated :]
        if self.length < self.least and self.out:
            self.out[-1] += "\n" + "\n".join(own)  # too small to stand alone: only what is new joins its neighbour
        else:
            self.out.append("\n".join(self.window))

    def add(self, unit: str) -> None:
        if len(self.window) > self.repeated and self.length + 1 + len(unit) > self.limit:
            self._close()
            self.repeated = len(self.window)
            while sum(map(len, self.window)) > self.overlap:
                self._drop_first()
        while self.repeated and self.length + 1 + len(unit) > self.limit:
            self._drop_first()
        self.length += len(unit) + bool(self.window)
        self.window.append(unit)

    def finish(self) -> list[str]:
        if len(self.window) > self.repeated:
            self._close()
        return self.out


def pack(pieces: list[str], limit: int, overlap: int, least: int) -> list[str]:
    packer = Packer(limit, overlap, least)
    for piece in pieces:
        packer.add(piece)
    return packer.finish()


class PackLines:
    """Table function (``name``, ``lines``, limit, overlap, least) to (``name``, ``chunk_index``, ``text``): the lines of a
    text packed into chunks; null lines give none."""

    def eval(self, name: str, lines: str | None, limit: int, overlap: int, least: int):
        pieces = [u for line in (lines or "").split("\n") if line for u in units(line, limit)]
        for i, chunk in enumerate(pack(pieces, limit, overlap, least)):
            yield name, i, chunk


def _bodies(settings: Settings):
    @F.pandas_udf(ArrayType(BODY))
    def bodies(subjects: pd.Series, own: pd.Series, summaries: pd.Series, titles: pd.Series) -> pd.Series:
        out = []
        for subject, found, summary, title in zip(subjects, own, summaries, titles, strict=True):
            limit = max(settings.chunk_max_chars - (len(subject) + 1 if subject else 0), settings.chunk_min_chars)
            named = _grouped(found)
            if len(summary):
                named = [*(named or [(T.NO_SECTION, [title])]), (T.SUMMARY_SECTION, summary)]
            rows = []
            for label, lines in named:
                pieces = [u for line in lines if line for u in units(line, limit)]
                rows += [(label, chunk) for chunk in pack(pieces, limit, settings.chunk_overlap_chars, settings.chunk_min_chars)]
            out.append(rows)
        return pd.Series(out)

    return bodies


def chunk_notices(notices: DataFrame, settings: Settings | None = None, summaries: bool = True, compose: bool = True) -> DataFrame:
    """Chunks (``chunk_id``, ``notice_num``, ``subject``, ``committee``, ``section``, ``chunk_index``, ``text``,
    ``char_count``, ``sentence_count``) of notices.

    Nulls count as empty. A summary is a last section of its own; a notice without any section gets its title as
    body if it has a summary, and else one chunk of its title and cleaned lines. Notices repeated by number would give
    clashing ids: see ``duplicate_numbers``.
    """
    settings = settings or Settings()
    n = notices.select(F.col("notice_num").cast("bigint").alias("notice_num"), T.trim_blank(F.coalesce("subject", F.lit(""))).alias("subject"), T.trim_blank(F.coalesce("committee", F.lit(""))).alias("committee"), T.clean_text("proposal_reason", compose).alias("reason"), (T.clean_text("ai_summary", compose) if summaries and "ai_summary" in notices.columns else F.lit("")).alias("summary"))
    bare = lambda p: T.trim_blank(T.strip_glued(T.strip_mark(p)))
    own = F.transform(labelled_lines("reason"), lambda x: F.struct(x["label"].alias("label"), bare(x["line"]).alias("line"), (x["line"] != "").alias("kept")))
    n = n.withColumn("found", _bodies(settings)(F.col("subject"), own, F.transform(T.paragraphs("summary"), bare), bare(F.col("subject"))))
    plain = F.array_join(F.filter(F.transform(F.split("reason", "\n"), lambda p: T.strip_mark(T.trim_blank(p))), lambda p: p != ""), "\n")
    fallback = F.array(F.struct(F.lit(T.NO_SECTION).alias("section"), T.trim_blank(F.concat_ws("\n", "subject", plain)).alias("text")))
    c = n.select("notice_num", "subject", "committee", F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(fallback)).alias("chunk_index", "c"))
    return c.select(F.format_string("%d-%04d", "notice_num", "chunk_index").alias("chunk_id"), "notice_num", "subject", "committee", F.col("c.section").alias("section"), "chunk_index", F.col("c.text").alias("text"), F.length("c.text").alias("char_count"), F.size(T.split_sentences(F.col("c.text"))).alias("sentence_count"))


def duplicate_numbers(notices: DataFrame) -> DataFrame:
    """Notice numbers that more than one row has."""
    return notices.groupBy("notice_num").agg(F.count("*").alias("n")).where("n > 1")


def uncovered_paragraphs(notices: DataFrame, chunks: DataFrame) -> DataFrame:
    """(``notice_num``, ``paragraph``) of cleaned lines no chunk of their notice holds, white space aside."""
    lines = notices.select("notice_num", F.explode(T.paragraphs(T.clean_text("proposal_reason"))).alias("p")).withColumn("label", T.header_label("p"))
    body = lines.select("notice_num", T.squash(T.strip_glued(T.strip_mark(F.when(F.col("label") != "", T.header_tail("p")).otherwise(F.col("p"))))).alias("paragraph")).where("paragraph <> ''")
    texts = chunks.groupBy("notice_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "").alias("all"))
    return body.join(texts.select("notice_num", T.squash("all").alias("all")), "notice_num", "left").where(~F.coalesce(F.contains("all", "paragraph"), F.lit(False))).select("notice_num", "paragraph")
