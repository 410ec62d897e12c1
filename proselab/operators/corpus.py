"""Corpus preparation: articles, chunks, pair grids, resume, holdout (S-07 to S-12, C-*, J-02, J-03, L-06, L-07, W-06)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselab.functions import text as tx
from proselab.sources import readers

Loader = Callable[[SparkSession], DataFrame]


def articles(lines: DataFrame, is_header: Column, by: str = "doc_id", at: str = "line_no", text: str = "text") -> DataFrame:
    """S-09, W-06: by, article, body: lines put together from one header to the next, without lines before the first."""
    numbered = lines.withColumn("article", F.sum(is_header.cast("int")).over(Window.partitionBy(by).orderBy(at)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, text))), lambda s: s[text]), " ")
    return numbered.where("article > 0").groupBy(by, "article").agg(body.alias("body"))


def registry(spark: SparkSession, loaders: dict[str, Loader], names: list[str]) -> DataFrame | None:
    """S-12, L-12: the named sources one after another with a column ``source``; unknown names are left out."""
    out = None
    for n in names:
        if n in loaders:
            one = loaders[n](spark).withColumn("source", F.lit(n))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def in_range(text: Column | str, low: int, high: int) -> Column:
    """P-01."""
    return tx.word_count(text).between(low, high)


def first_turns(conversations: DataFrame, low: int, high: int) -> DataFrame:
    """S-07, P-03: conv_id, human, answer: the first user and assistant turns, both within a range of words."""
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    out = conversations.groupBy("conv_id").agg(first("user").alias("human"), first("assistant").alias("answer"))
    return out.where(in_range("human", low, high) & in_range("answer", low, high))


def news_clean(text: Column | str) -> Column:
    """S-10: a leading agency mark and dateline go, white space becomes single spaces."""
    out = F.regexp_replace(tx.col(text), r"(?U)^\s*\(CNN\)\s*--\s*", "")
    out = F.regexp_replace(out, r"(?U)^\s*[A-Z][A-Za-z .,]{0,40}\([A-Za-z ]+\)\s*--?\s*", "")
    return tx.strip(F.regexp_replace(out, r"(?U)\s+", " "))


def short_news(text: Column | str) -> Column:
    """S-11: white space becomes single spaces."""
    return tx.strip(F.regexp_replace(tx.col(text), r"(?U)\s+", " "))


def minibatch(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """L-06, L-08: the first n rows in an order that a seed gives, with their place in it; Spark keeps n rows a task."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("place", place).orderBy("place", key).limit(n)


def pair_grid(docs: DataFrame, prompts: int) -> DataFrame:
    """J-02: every document with every prompt number."""
    return docs.withColumn("prompt_idx", F.explode(F.sequence(F.lit(0), F.lit(prompts - 1))))


def pending(jobs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """J-03, L-10: the jobs whose key is not done."""
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def holdout(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """L-06, L-07: ``df`` with held_out, drawn by a hash of the key, without an order over all rows."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.withColumn("held_out", h < int(share * 2**32))


def chunks(text: str, low: int, high: int) -> list[str]:
    """C-01: sentences gathered until the next would exceed ``high`` words, if ``low`` are there; a short tail goes."""
    out, held, n = [], [], 0
    for s in (x for x in map(str.strip, re.split(r'(?<=[.!?])\s+(?=[A-Z"])', text.strip())) if x):
        k = len(s.split())
        if held and n + k > high and n >= low:
            out.append(" ".join(held))
            held, n = [], 0
        held.append(s)
        n += k
    return out + [" ".join(held)] * (n >= low)


def chunked(df: DataFrame, low: int = 80, high: int = 160) -> DataFrame:
    """C-01: doc_id, chunk_no, chunk."""

    readers.few_rows(df.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks(t or "", low, high) for t in texts])

    return df.select("doc_id", F.posexplode(cut("text")).alias("chunk_no", "chunk"))
