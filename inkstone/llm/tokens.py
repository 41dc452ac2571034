"""Sizes in tokens of a public tokenizer. The vocabulary file's path is a parameter; nothing is copied or trained."""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Where the vocabulary files lie; a rank file for many languages.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the public pattern that cuts text before the merges of such a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PART = StructType([StructField("part_no", IntegerType()), StructField("start_char", IntegerType()), StructField("end_char", IntegerType()), StructField("tokens", IntegerType())])


def share(spark: SparkSession, path: str = VOCABULARY) -> None:
    """Sends the vocabulary file to the executors, where it doesn't lie at ``path`` on each of them."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    at = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    with open(at, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def token_count(column: str | Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for null and empty ones."""

    @F.pandas_udf(IntegerType())
    def counted(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0)

    return counted(F.col(column) if isinstance(column, str) else column)


@lru_cache(maxsize=100_000)
def _piece_tokens(piece: str, path: str) -> int:
    return len(encoder(path).encode_ordinary(piece))


def _pieces(text: str, path: str, capacity: int) -> tuple[list[int], list[int]]:
    """Ends of the stretches that are tokenised each on its own, and the running sum of their tokens.

    A stretch over the capacity is cut where its tokens end; the tokens of a cut stretch are counted anew, as merges may
    fall otherwise.
    """
    ends, sums = [0], [0]
    for m in regex.finditer(PATTERN, text):
        at, end = m.span()
        while (n := _piece_tokens(text[at:end], path) if end - at < 64 else count(text[at:end], path)) > capacity:
            low, high = at + 1, end  # the longest start that fits, by halving; only for words over the capacity
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if count(text[at:middle], path) <= capacity else (low, middle)
            ends.append(low)
            sums.append(sums[-1] + count(text[at:low], path))
            at = low
        ends.append(end)
        sums.append(sums[-1] + n)
    return ends, sums


def parts(text: str | None, capacity: int, path: str = VOCABULARY) -> list[tuple[int, int, int, int]]:
    """(part_no, start, end, tokens): the whole text where it fits, else parts that tile it, cut at line ends, sentence
    ends or spaces where there are any, each at most ``capacity`` tokens on its own.

    The text is tokenised once: cuts fall between stretches that the tokenizer takes on their own, so the tokens of a
    part are a difference of sums.
    """
    total = count(text, path)
    if not text or total <= capacity:
        return [(0, 0, len(text or ""), total)]
    ends, sums = _pieces(text, path, capacity)
    out, i = [], 0
    while i < len(ends) - 1:
        j = bisect_right(sums, sums[i] + capacity) - 1
        if j < len(ends) - 1:
            tail = max(i + 1, j - max(1, (j - i) // 20))  # a natural break costs at most a twentieth
            near = range(j, tail - 1, -1)
            line = next((b for b in near if text[ends[b] - 1] == "\n"), None)
            space = next((b for b in near if text[ends[b] - 1] in ".!?。！？" or text[ends[b]].isspace() or text[ends[b] - 1].isspace()), None)
            j = line or space or j
        out.append((len(out), ends[i], ends[j], sums[j] - sums[i]))
        i = j
    return out


def text_parts(column: str | Column, capacity: int, path: str = VOCABULARY) -> Column:
    @F.pandas_udf(ArrayType(PART))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parts(t, capacity, path))

    return cut(F.col(column) if isinstance(column, str) else column)
