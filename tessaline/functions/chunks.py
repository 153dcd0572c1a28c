"""Chunks of texts by estimated size, and keywords."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Characters that an estimated token stands for.
CHARS = 4


def units(text: str, most: int) -> list[tuple[int, int]]:
    """(begin, end) of stretches of at most `most` characters: paragraphs, else sentences, else hard cuts. They cover the text."""
    out: list[tuple[int, int]] = []
    for m in re.finditer(r"(?s).+?(?:\n[ \t]*\n+|\Z)", text):
        if m.end() - m.start() <= most:
            out.append(m.span())
            continue
        for s in re.finditer(r"(?s).+?(?:[.!?。！？]\s+|\n+|\Z)", m.group()):
            at, end = m.start() + s.start(), m.start() + s.end()
            while at < end:
                out.append((at, min(at + most, end)))
                at += most
    return out


def chunk(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) in characters of chunks of at most `limit` estimated tokens; each but the first begins `overlap` tokens before the end of the one before."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    most, back = limit * CHARS, overlap * CHARS
    out: list[tuple[int, int]] = []
    begin = end = 0
    for _, b in units(text, most - back):
        if end > begin and b - begin > most:
            out.append((begin, end))
            begin = max(begin + 1, end - back)
        end = b
    if end > begin:
        out.append((begin, end))
    return out


def chunked(rows: DataFrame, key: str, column: str, limit: int, overlap: int) -> DataFrame:
    """(key, chunk, begin, piece); null and empty texts have no chunk."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, a, t[a:z]) for k, t in zip(b.key, b.text, strict=True) if t for i, (a, z) in enumerate(chunk(t, limit, overlap))]
            yield pd.DataFrame(out, columns=["key", "chunk", "begin", "piece"])

    small = rows.select(F.col(key).alias("key"), F.col(column).alias("text"))
    return small.mapInPandas(run, f"key {kind}, chunk int, begin int, piece string").withColumnRenamed("key", key)


def keywords(rows: DataFrame, key: str, column: str, n: int) -> DataFrame:
    """(key, word, weight, rank): count / (1 + log of the records that have it), more for words of the first half."""
    words = rows.select(key, F.posexplode(F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)).alias("at", "word"))
    per = words.groupBy(key, "word").agg(F.count("*").alias("tf"), F.min("at").alias("first"))
    df = per.groupBy("word").agg(F.count("*").alias("df"))
    weight = F.col("tf") / (1 + F.log(F.col("df").cast("double"))) / F.sqrt(1.0 + F.col("first"))
    ranked = per.join(df, "word").select(key, "word", F.round(weight, 6).alias("weight"))
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.col("weight").desc(), "word"))).where(F.col("rank") <= n)
