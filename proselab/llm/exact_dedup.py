"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text is cut into chunks where its own content says so, so that an insertion moves only the cuts around it.
A ledger deduplicates the chunks to verified identifiers: a 64-bit fingerprint and a number that tells apart
contents, by SHA-256 digest and length, which share a fingerprint. Two texts are equal when their ordered
identifier lists, the recipes, are. Only digests and identifiers move; each text is read once, where it lies.

A null text counts as empty; the empty text is one empty chunk, so that all empty documents form a group.
Of a group the row with the largest doc_id stays; a null doc_id is smaller than any. Repeated rows are rows of
their own, and exactly one row of a group is kept, also where its doc_id is repeated. An empty table gives an
empty result. Only doc_id and text are read, so no other column can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselab.llm.common import documents, materialise

#: A chunk has MIN code points and ends with the next full stop, comma or line end that a letter of the first
#: third of the alphabet follows, or at MAX code points.
MIN, MAX = 1024, 8192
CHUNK = rf"(?s).{{{MIN},{MAX - 1}}}?[.,\n](?= ?[a-iA-I])|.{{1,{MAX}}}"


def chunked(df: DataFrame) -> DataFrame:
    """row, doc_id, sha (of the whole text), chunks: array of (fingerprint, digest, length) in order."""
    pieces = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)))
    return documents(df).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.sha2("text", 256).alias("sha"),
        F.transform(pieces, lambda c: F.struct(F.xxhash64(c).alias("fp"), F.unhex(F.sha2(c, 256)).alias("digest"), F.length(c).alias("n"))).alias("chunks"),
    )


def recipes(df: DataFrame) -> DataFrame:
    """row, doc_id, sha, recipe: the ordered identifiers of each text's chunks."""
    rows = materialise(chunked(df), "chunks")
    first = F.col("at") == 0
    pieces = rows.select("row", "doc_id", "sha", F.posexplode("chunks").alias("at", "c")).select(
        "row", "at", "c.fp", "c.digest", "c.n", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha")
    )
    ledger = pieces.groupBy("fp", "digest", "n").agg(F.count("*").alias("uses"))
    numbered = ledger.select("fp", "digest", "n", F.row_number().over(Window.partitionBy("fp").orderBy("digest", "n")).alias("k"))
    clashes = materialise(numbered.where("k > 1"), "clashes")
    named = pieces.join(clashes, ["fp", "digest", "n"], "left")
    part = F.struct(F.col("at"), F.col("fp"), F.coalesce("k", F.lit(1)).alias("k"))
    listed = named.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.sort_array(F.collect_list(part)).alias("parts"))
    return listed.select("row", "doc_id", "sha", F.transform("parts", lambda p: F.struct(p["fp"].alias("fp"), p["k"].alias("k"))).alias("recipe"))


def classes(df: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``df``."""
    rows = materialise(recipes(df), "recipes")
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("size"))
    several = materialise(groups.where("size > 1"), "groups")
    # read from a table, both sides are plain exchanges, which Spark splits where a recipe is in a large share of rows
    return rows.join(several, "recipe", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
