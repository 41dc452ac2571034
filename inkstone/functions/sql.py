"""The functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkstone.config import KOREAN, DomainPack
from inkstone.functions import text as T
from inkstone.functions.lexical import EXPANSION, AliasRewriter
from inkstone.operators.chunking import PackLines


def register(spark: SparkSession, pack: DomainPack = KOREAN) -> list[str]:
    """Registers ``nfc``, ``expand_query``, ``clean_text``, ``squash``, ``content_tokens`` and the table function
    ``pack_lines`` with a session, and returns their names."""
    rewrite = AliasRewriter(pack)

    @F.pandas_udf(EXPANSION)
    def expand_query(queries: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rewrite(q) for q in queries], columns=["text", "matched"])

    spark.udf.register("nfc", T.nfc)
    spark.udf.register("expand_query", expand_query)
    spark.udtf.register("pack_lines", F.udtf(PackLines, returnType="name string, chunk_index int, text string"))
    cleaned = "coalesce(nfc(t), '')"
    for pattern, by in T.CLEANING:
        cleaned = f"regexp_replace({cleaned}, r'{pattern}', '{by}')"
    stop = ", ".join(f"'{t}'" for t in pack.stop_tokens)
    bodies = {
        "clean_text": ("STRING", cleaned),
        "squash": ("STRING", r"regexp_replace(coalesce(t, ''), r'(?U)\s+', '')"),
        "content_tokens": ("ARRAY<STRING>", f"array_distinct(filter(regexp_extract_all(lower(coalesce(t, '')), r'([0-9a-z가-힣]{{2,}})', 1), x -> x NOT IN ({stop or chr(39) * 2})))"),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return ["nfc", "expand_query", "pack_lines", *bodies]
