"""T-19: batches of texts of like length, padded to their longest, with masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselab.sources.readers import settled


def placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with place: its rows numbered from 0 in an order, by ranges of it; ties beyond ``order`` fall as they may.

    A range is a task; only the ranges' sizes meet, one row each.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settled(ranged.withColumn("_at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    ends = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<r:bigint,before:bigint>>").alias("out")), lambda a, x: F.struct(
        (a["total"] + x["_n"]).alias("total"), F.concat(a["out"], F.array(F.struct(x["_range"].alias("r"), a["total"].alias("before")))).alias("out")), lambda a: a["out"])
    starts = sizes.agg(F.array_sort(F.collect_list(F.struct("_range", "_n"))).alias("s")).select(F.inline(ends).alias("_range", "_before"))
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("_range", F.shiftright("_at", 33)).join(starts, "_range").withColumn("place", F.col("_before") + within).drop("_range", "_at", "_before")


def padded(df: DataFrame, tokens: str, size: int, *order: str, pad=0) -> DataFrame:
    """``df`` with batch, padded (the tokens, filled up to the batch's longest) and mask (1 for tokens, 0 for filling).

    Rows are batched in the order of their number of tokens, then ``order``, so that little is filled. A null array
    counts as empty. The last batch may be smaller.
    """
    held = df.withColumn(tokens, F.coalesce(F.col(tokens), F.array().cast(df.schema[tokens].dataType))).withColumn("_len", F.size(tokens))
    rows = placed(held, "_len", *order).withColumn("batch", F.floor(F.col("place") / size))
    # a batch's longest is its last: one row for each batch
    most = rows.groupBy("batch").agg(F.max("_len").alias("_most"))
    filled = rows.join(most, "batch")
    fill = lambda x: F.array_repeat(F.lit(x), F.col("_most") - F.col("_len"))
    kind = df.schema[tokens].dataType.simpleString()
    out = filled.withColumns({"padded": F.concat(F.col(tokens), fill(pad).cast(kind)), "mask": F.concat(F.array_repeat(F.lit(1), F.col("_len")), fill(0))})
    return out.select(*df.columns, "batch", "padded", "mask")
