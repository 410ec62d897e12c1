"""Facts as spans, and intervals that overlap none of others (X-01, X-02, J-05).

A span is half open: start is the first character, from 0, and stop the one behind the last. Of a text's matches
of all kinds a lower kind's is skipped where it overlaps a span that a higher kind has claimed; a match that was
skipped itself claims nothing. Texts are cut at their matches by built-in expressions, and the offsets are running
sums of the pieces' lengths; claims are settled by one sweep over a text's spans in order, kind after kind, on one
shuffle by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselab.functions import text as tx
from proselab.operators.facts import KINDS, _pattern
from proselab.sources.readers import settled


def overlap(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """X-02: whether two half-open intervals share a place; empty ones share none."""
    return (a_start < b_stop) & (b_start < a_stop) & (a_start < a_stop) & (b_start < b_stop)


def matched(df: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """row, pattern (its number), start, stop, found of every match of each pattern, and ``df``'s other columns.

    ``row`` numbers the rows of ``df``. Matches of one pattern never overlap; those of several may. A null text has none.
    """
    others = [c for c in df.columns if c != text]
    t = F.col(text)
    pieces = lambda p: F.arrays_zip(F.transform(F.split(t, p, -1), F.length).alias("gap"), F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("found"))
    each = F.array(*(F.struct(F.lit(k).alias("pattern"), F.filter(pieces(p), lambda x: x["found"].isNotNull()).alias("pieces")) for k, p in enumerate(patterns)))
    rows = df.withColumn("row", F.monotonically_increasing_id()).select("row", *others, F.explode(each).alias("e"))
    rows = rows.select("row", *others, "e.pattern", F.posexplode("e.pieces").alias("at", "x"))
    # what was found is no part of the places, so that it moves only where it is asked for
    rows = rows.select("row", *others, "pattern", "at", "x.gap", F.length("x.found").alias("size"), "x.found").repartition("row")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "pattern").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    stopped = rows.withColumn("stop", upto.cast("long"))
    return stopped.select("row", *others, "pattern", (F.col("stop") - F.col("size")).alias("start"), "stop", "found")


def settled_by_priority(spans: DataFrame, kinds: int, by: str = "row", kind: str = "pattern") -> DataFrame:
    """J-05: the spans that overlap no kept span of a lower kind number; those of kind 0 all stay.

    Kept spans of a row are disjoint, so the last one before a span and the first one after it tell all.
    """
    order = Window.partitionBy(by).orderBy("start", kind)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    out = spans.withColumn("_kept", F.col(kind) == 0)
    for k in range(1, kinds):
        last = F.max(F.when(F.col("_kept"), F.col("stop"))).over(before)
        following = F.min(F.when(F.col("_kept"), F.col("start"))).over(after)
        out = out.withColumns({"_last": last, "_next": following})
        free = (F.col(kind) == k) & (F.coalesce("_last", F.col("start")) <= F.col("start")) & (F.coalesce("_next", F.col("stop")) >= F.col("stop"))
        out = out.withColumn("_kept", F.col("_kept") | free).drop("_last", "_next")
    return out.where("_kept").drop("_kept")


def facts(df: DataFrame, text: str = "text") -> DataFrame:
    """X-01: row, kind, start, stop, value of every fact of each text, repeated ones too, and ``df``'s other columns.

    Values are normalised as in ``facts.extract`` (T-15), names stay as they are.
    """
    kept = settled_by_priority(matched(df, [_pattern(k) for k in KINDS], text), len(KINDS))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("pattern") + 1)
    value = F.when(F.col("pattern") == len(KINDS) - 1, F.col("found")).otherwise(tx.plain_number("found"))
    return kept.select("row", *(c for c in df.columns if c != text), name.alias("kind"), "start", "stop", value.alias("value"))


def outside(a: DataFrame, b: DataFrame, by: str, width: int = 1 << 16) -> DataFrame:
    """J-05: the rows of ``a`` (by, start, stop, ...) that overlap no row of ``b`` (by, start, stop).

    An interval anti-join in bins of ``width`` places: whatever overlaps shares a bin, and in a bin one sweep
    tells for each interval how far those before it reach and where the next one begins. A key's bins are dealt to many
    tasks. Empty intervals overlap nothing; a null key or bound matches nothing, so such rows of ``a`` stay.
    """
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))
    whole = F.col(by).isNotNull() & (F.col("start") < F.col("stop"))
    # written: both readings below must see the same numbers
    ours = settled(a.withColumn("_id", F.monotonically_increasing_id()))
    sides = [d.where(whole).select(F.col(by).alias("_by"), "start", "stop", i.alias("_id"), F.explode(bins).alias("_bin")) for d, i in ((ours, F.col("_id")), (b, F.lit(None).cast("long")))]
    order = Window.partitionBy("_by", "_bin").orderBy("start", F.col("_id").isNotNull())
    theirs = lambda c: F.when(F.col("_id").isNull(), F.col(c))
    reach = F.max(theirs("stop")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(theirs("start")).over(order.rowsBetween(1, Window.unboundedFollowing))
    swept = sides[0].unionAll(sides[1]).withColumns({"_reach": reach, "_next": following})
    hit = swept.where(F.col("_id").isNotNull() & ((F.col("_reach") > F.col("start")) | (F.col("_next") < F.col("stop")))).select("_id").distinct()
    return ours.join(hit, "_id", "left_anti").drop("_id")

