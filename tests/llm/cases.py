"""Small frames with every awkward case, and plain-Python versions to compare with."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [
    None, "", "   \n\t", "one", "One TWO three", "tab\tand\r\nline \x0b feed", "é É ñ 日本語 テスト 。",
    "a b c d e f g h i j k l m n o p", "the mit license and the MIT License", "x" * 5000,
    "same line\nsame line\n\nsame line\nother", "a a a a a a a a a a", "zero \0 byte", LONG, LONG + " more",
    "it's <|endoftext|> don't <|startoftext|>x", "  two  spaces   three \n then", "### $$$ &&& |||",
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def rows() -> list[tuple]:
    out = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(TEXTS)]
    out.append((None, "no id but words enough to count", None, None, None))
    out.append((None, None, None, None, None))
    return out + [out[7], out[7], out[13]]         # repeated rows


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """With columns named like results, in other letter cases and with odd signs."""
    return df.selectExpr("*", *[f"'mine' AS `{n.upper()}`" for n in names], "1 AS `a.b`", "2 AS `c``d`")


def frame(df: DataFrame) -> pd.DataFrame:
    return df.toPandas()
