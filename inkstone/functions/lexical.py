"""Query rewriting, content tokens, overlap and rank fusion."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from inkstone.config import KOREAN, DomainPack
from inkstone.functions import text as T

EXPANSION = StructType([StructField("text", StringType()), StructField("matched", ArrayType(StringType()))])


class AliasRewriter:
    """Replaces aliases that stand as words of their own, with or without a particle, by official names."""

    def __init__(self, pack: DomainPack = KOREAN):
        self.pack = pack
        self.names = {self._key(a): a for a in pack.aliases}
        bodies = [r"\s*".join(map(re.escape, a.split())) for a in sorted(pack.aliases, key=lambda a: (-len(a), a))]
        word = "[0-9A-Za-z가-힣]"
        ends = "|".join(map(re.escape, sorted(pack.particles, key=lambda p: -len(p)))) or "(?!)"
        self.pattern = re.compile(f"(?<!{word})({'|'.join(bodies) or '(?!)'})((?:{ends})?)(?!{word})", re.I)

    @staticmethod
    def _key(alias: str) -> str:
        return "".join(alias.split()).casefold()

    def __call__(self, query: str | None) -> tuple[str, list[str]]:
        """The rewritten text and the aliases found, each once."""
        query = query or ""
        text, fired, joined = "", {}, None  # joined: the alias that the text ends with, if nothing follows it
        at = 0
        for hit in self.pattern.finditer(query):
            alias, particle = self.names[self._key(hit[1])], hit[2]
            fired[alias] = None
            if self.pack.synonyms and alias == self.pack.synonyms[1]:
                particle = self.pack.agreement.get(particle, particle)
            between = query[at : hit.start()]
            twice = self.pack.synonyms and between.isspace() and {joined, alias} == set(self.pack.synonyms)
            text += particle if twice else between + self.pack.aliases[alias] + particle
            joined, at = (None if particle else alias), hit.end()
        return text + query[at:], list(fired)


def expand(column: str | Column, pack: DomainPack = KOREAN) -> Column:
    """struct(text, matched)."""
    rewrite = AliasRewriter(pack)

    @F.pandas_udf(EXPANSION)
    def expanded(queries: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rewrite(q) for q in queries], columns=["text", "matched"])

    return expanded(F.col(column) if isinstance(column, str) else column)


def content_tokens(column: str | Column, stop: Iterable[str] = KOREAN.stop_tokens) -> Column:
    """Distinct runs of two or more letters of the alphabet, Hangul or digits, in order of first occurrence."""
    c = F.col(column) if isinstance(column, str) else column
    lowered = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    found = F.regexp_extract_all(lowered, F.lit("([0-9a-z가-힣]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*stop)) if (stop := list(stop)) else found)


def lexical_tokens(column: str | Column, pack: DomainPack = KOREAN) -> Column:
    """Content tokens of a text that is cleaned first and has its aliases replaced then; null gives none."""
    return content_tokens(expand(T.clean_text(column), pack)["text"], pack.stop_tokens)


def prepared_query(column: str | Column, pack: DomainPack = KOREAN) -> Column:
    """What of a query is embedded: aliases are replaced first, the text is cleaned then."""
    return T.clean_text(expand(column, pack)["text"])


def chunk_tokens(subject: str | Column, text: str | Column, pack: DomainPack = KOREAN) -> Column:
    """Tokens of a chunk with its title."""
    s, t = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (subject, text))
    return lexical_tokens(F.concat(s, F.lit("\n"), t), pack)


def overlap_count(query: str | Column, document: str | Column) -> Column:
    """Query tokens that hold, or are held by, a document token."""
    q, d = (F.col(x) if isinstance(x, str) else x for x in (query, document))
    return F.size(shared_tokens(q, d))


def shared_tokens(query: Column, document: Column) -> Column:
    return F.filter(query, lambda a: F.exists(document, lambda b: F.contains(b, a) | F.contains(a, b)))


def rank_fusion(rankings: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists an item is on; takes (keys..., ``rank``)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return rankings.groupBy(*keys).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
