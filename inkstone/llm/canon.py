"""Visually identical text in one consistent form (problem 3).

A transducer over grapheme clusters is compiled once from declared rules. Compilation expands every rule into
``input cluster -> output`` entries, rejects entries that disagree, closes chains (an output that is itself an
input) and builds one alternation in which the longest input wins. A text is then rewritten in a single
left-to-right pass; clusters without an entry are copied.

Kept apart: encircled digits, superscripts, ligatures and other signs that show something else. Joined: widths,
composed and decomposed letters, compatibility ideographs, kinds of space, middle dots, hyphens and letters whose
shape is borrowed from another script. Removed: characters that can't be seen.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkstone.operators.pairing import pairs_within

# Letters of other scripts that have the shape of a Latin letter.
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj")
CYRILLIC = ("АВЕЅІЈКМНОРСТУХԌԚԜасеіјорѕухһԁԛԝ", "ABESIJKMHOPCTYXGQWaceijopsyxhdqw")
ARMENIAN = ("ՕՍՏցհոսօ", "OUSghnuo")
# Signs that are all drawn as one dot at half height, or as one short stroke.
MIDDLE_DOTS = "\u00b7\u2027\u22c5\u30fb\uff65\u318d\u119e\u2219\u2022\u2e31\ua78f"
HYPHENS = "-\u2010\u2011\u2012\u2013\u2212\ufe63\uff0d\u2043\u02d7"
DOT, HYPHEN = "\u318d", "-"

JAMO_CLUSTER = "[\u1100-\u1112\u1161-\u1175\u11a8-\u11c2]"


class MappingConflict(ValueError):
    """Two rules give one input different outputs."""


@lru_cache(maxsize=1)
def invisible() -> frozenset[str]:
    """Characters without any ink or advance: format controls, variation selectors, fillers, other controls."""
    seen = {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"}
    seen |= {chr(c) for c in (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5)}
    seen |= {chr(c) for c in (*range(0x20), *range(0x7F, 0xA0)) if chr(c) not in "\t\n\r\x0b\x0c\x85"}
    return frozenset(seen)


def rules() -> list[tuple[str, dict[str, str]]]:
    """Named groups of single-character rules."""
    width = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFF01, 0xFFBF), *range(0xFFE0, 0xFFEF)) if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))}
    width = {k: v for k, v in width.items() if k not in MIDDLE_DOTS and k not in HYPHENS and v not in invisible()}
    spaces = {chr(c): " " for c in range(0x3001) if unicodedata.category(chr(c)) == "Zs" and c != 0x20} | {"\t": " "}
    breaks = dict.fromkeys(("\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029", "\r\n"), "\n")
    borrowed = {a: b for pair in (GREEK, CYRILLIC, ARMENIAN) for a, b in zip(*pair, strict=True)}
    unified = {chr(c): unicodedata.normalize("NFC", chr(c)) for c in (*range(0xF900, 0xFAFF), *range(0x2F800, 0x2FA1E), 0x2126, 0x212A, 0x212B, 0x1F71) if unicodedata.normalize("NFC", chr(c)) != chr(c)}
    return [
        ("width", width),
        ("space", spaces),
        ("break", breaks),
        ("dot", {c: DOT for c in MIDDLE_DOTS if c != DOT}),
        ("hyphen", {c: HYPHEN for c in HYPHENS if c != HYPHEN}),
        ("borrowed", borrowed),
        ("unified", unified),
        ("unseen", dict.fromkeys(invisible(), "")),
    ]


def _char_class(characters: Iterable[str]) -> str:
    """The inside of a bracket expression, with neighbours joined into ranges."""
    out, codes = [], sorted(map(ord, characters))
    start = last = None
    for code in [*codes, None]:
        if start is not None and code != last + 1:
            out.append(re.escape(chr(start)) + (f"-{re.escape(chr(last))}" if last > start else ""))
            start = None
        start, last = code if start is None else start, code
    return "".join(out)


class Transducer:
    """Compiled mapping of grapheme clusters."""

    def __init__(self, groups: list[tuple[str, dict[str, str]]] | None = None):
        self.table = self._join(rules() if groups is None else groups)
        single = _char_class(c for c in self.table if len(c) == 1)
        longer = "|".join(re.escape(c) for c in sorted((k for k in self.table if len(k) > 1), key=len, reverse=True))
        marks = r"\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\u3099\u309a\ufe20-\ufe2f"
        unseen = _char_class(invisible())
        # A cluster: jamo or any sign with the marks after it; unseen characters inside it don't break it.
        tail = f"(?:[{unseen}]*[{marks}])"
        jamo = f"{JAMO_CLUSTER}(?:[{unseen}]*{JAMO_CLUSTER})*"
        self._hit = re.compile("|".join(x for x in (jamo, longer, f"[^\\s{marks}]{tail}+", f"[{single}]") if x))
        self._unseen = re.compile(f"[{unseen}]+")
        self._any = re.compile(f"[{single}{marks}\u1100-\u11ff]")
        self._known: dict[str, str] = {}

    @staticmethod
    def _join(groups: list[tuple[str, dict[str, str]]]) -> dict[str, str]:
        table: dict[str, str] = {}
        for name, group in groups:
            for source, target in group.items():
                if table.setdefault(source, target) != target:
                    raise MappingConflict(f"{name}: {source!r} gives {target!r} and {table[source]!r}")
        for source in table:  # chains are followed to their end; a cycle is a conflict
            target, seen = table[source], {source}
            while True:
                step = "".join(table.get(c, c) for c in target)
                if step == target:
                    break
                if step in seen:
                    raise MappingConflict(f"{source!r} runs in a circle")
                seen.add(step)
                target = step
            table[source] = unicodedata.normalize("NFC", target)
        return table

    def _cluster(self, found: re.Match[str]) -> str:
        cluster = found[0]
        known = self._known.get(cluster)
        if known is None:
            if cluster in self.table:
                known = self.table[cluster]
            else:
                plain = "".join(self.table.get(c, c) for c in self._unseen.sub("", cluster))
                composed = unicodedata.normalize("NFC", plain)
                known = "".join(self.table.get(c, c) for c in composed)
            if len(self._known) < 100_000:
                self._known[cluster] = known
        return known

    def __call__(self, text: str) -> str:
        """The consistent form; a second application changes nothing."""
        return self._hit.sub(self._cluster, text) if self._any.search(text) else text


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


#: Gaps at the end of a line or text can't be seen.
_TRAILING = re.compile(r" +(?=\n|$)")


def canonical(text: str | None) -> str | None:
    """Null stays null, empty stays empty; white space that ends a line is dropped."""
    return None if text is None else _TRAILING.sub("", transducer()(text))


@F.pandas_udf(StringType())
def canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_column(column: str | Column) -> Column:
    return canonical_udf(F.col(column) if isinstance(column, str) else column)


def canonicalize(df: DataFrame, columns: list[str], suffix: str = "_canonical") -> DataFrame:
    """Adds the consistent form of each column. Extra columns stay; one that has a new column's name is replaced."""
    return df.withColumns({c + suffix: canonical_column(c) for c in columns})


def look_alikes(df: DataFrame, key: str, fields: list[str], rows_per_salt: int = 2_000) -> DataFrame:
    """Pairs of keys whose texts in a field look the same but aren't the same characters.

    Result: ``a``, ``b`` (``a < b``), ``field_name``. Rows with a null key, and blank texts, take no part; repeated
    rows count once; a key with several texts takes part with each. Texts are grouped by two 64-bit hashes of
    the consistent form, so only hashes and keys are shuffled. Classes with one spelling never meet in the join;
    large classes are cut into salted slices on one side and copied on the other.
    """
    long = df.select(F.col(key).alias("k"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x")).select("k", "x.*")
    long = long.where(F.col("k").isNotNull() & F.col("text").isNotNull()).withColumn("canon", canonical_column("text")).where(F.length(F.regexp_replace("canon", r"\s+", "")) > 0)
    hashed = long.select("k", "field_name", F.xxhash64("canon").alias("c1"), F.xxhash64(F.lit(1), "canon").alias("c2"), F.xxhash64("text").alias("v1"), F.xxhash64(F.lit(1), "text").alias("v2")).distinct()
    pairs = pairs_within(hashed, ["field_name", "c1", "c2"], "k", rows_per_salt, ["v1", "v2"])
    return pairs.select("a", "b", "field_name").distinct()
