"""Request and training logs (W-01, W-02, W-08, W-09, A-18, A-19, A-22, A-25, ST-01 to ST-07).

Windows over the rows before one are dealt by key and by runs of the key's order, so that a log of few keys is not
a few tasks: rows are numbered by counts of hours, numbers are cut into runs, and each run gets the rows before it
that its first windows reach.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselab.functions import lexicon as lx


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, also of times without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


#: Rows of a run.
RUN = 50_000


def numbered(df: DataFrame, by: str, ts: str, order: list) -> DataFrame:
    """``df`` with place: a key's rows numbered from 0 in their order, which must begin with ``ts``. An hour is a task's share.

    Key and hour are one struct, which is never null itself, so that window and join share one exchange.
    """
    rows = df.withColumn("_hour", F.struct(F.col(by).alias("by"), F.date_trunc("hour", ts).alias("hour")))
    before = F.sum("_n").over(Window.partitionBy("_hour.by").orderBy("_hour.hour").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("_hour").agg(F.count("*").alias("_n")).select("_hour", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_hour").orderBy(*order))
    return rows.withColumn("_within", within).join(starts, "_hour").withColumn("place", F.col("_before") + F.col("_within") - 1).drop("_hour", "_within", "_before")


def over_last(df: DataFrame, by: str, ts: str, order: list, rows: int, columns, run: int = RUN) -> DataFrame:
    """``df`` with ``columns(window)``, columns over the last ``rows`` rows of a key up to and with each one."""
    run = max(run, rows)
    at = F.floor(F.col("place") / run)
    own = F.struct(at.alias("run"), F.lit(True).alias("own"))
    # the last rows of a run go to the next one as well, whose first windows reach them
    both = F.when(F.col("place") % run >= run - rows + 1, F.array(own, F.struct((at + 1).alias("run"), F.lit(False).alias("own")))).otherwise(F.array(own))
    dealt = numbered(df, by, ts, order).withColumn("_to", F.explode(both)).withColumns({"_run": F.col("_to.run"), "_own": F.col("_to.own")})
    window = Window.partitionBy(by, "_run").orderBy("place").rowsBetween(1 - rows, 0)
    return dealt.withColumns(columns(window)).where("_own").drop("_own", "_run", "_to", "place")


def trailing_mean(df: DataFrame, value: str, by: str, ts: str, order: list, rows: int = 30, run: int = RUN) -> DataFrame:
    """W-01, W-09: ``df`` with n and mean of the last ``rows`` values."""
    return over_last(df, by, ts, order, rows, lambda w: {"n": F.count("*").over(w), "mean": F.avg(value).over(w)}, run)


def gaps(df: DataFrame, by: str, ts: str, order: list, limit_s: float, run: int = RUN) -> DataFrame:
    """W-08, ST-06: ``df`` with gap_s since the row before and stalled where it exceeds the limit."""
    rows = over_last(df, by, ts, order, 2, lambda w: {"_first": F.first(ts).over(w), "_n": F.count("*").over(w)}, run)
    gap = F.when(F.col("_n") > 1, micros(F.col(ts)) / 1e6 - micros(F.col("_first")) / 1e6)
    return rows.withColumn("gap_s", gap).withColumn("stalled", F.coalesce(F.col("gap_s") > limit_s, F.lit(False))).drop("_first", "_n")


def ends(df: DataFrame, by: str, value: str, order: list, n: int = 5) -> DataFrame:
    """A-19: means of the first and the last n rows; Spark keeps n rows a key before they move."""

    def some(*keys):
        return df.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*keys))).where(F.col("_at") <= n)

    both = some(*order).select(by, F.lit("first").alias("_end"), value).unionByName(some(*(F.col(c).desc() for c in order)).select(by, F.lit("last").alias("_end"), value))
    return both.groupBy(by).agg(*(F.avg(F.when(F.col("_end") == e, F.col(value))).alias(e) for e in ("first", "last")))


def guarded(df: DataFrame, by: str, ts: str, idle_min: float, grace_min: float, cap_h: float, now) -> DataFrame:
    """ST-06, ST-07: by run its last step, and whether a guard ends it at ``now`` and why.

    A run is stalled when it had no step for ``idle_min`` minutes, counted from the end of its grace period at the
    earliest, and capped when it has lasted ``cap_h`` hours.
    """
    r = df.groupBy(by).agg(F.min(ts).alias("began"), F.max(ts).alias("last_step"), F.count("*").alias("steps"))
    at, begun = micros(now) / 1e6, micros(F.col("began")) / 1e6
    idle = (at - F.greatest(micros(F.col("last_step")) / 1e6, begun + grace_min * 60)) / 60
    why = F.when((at - begun) / 3600 >= cap_h, "cap").when(idle >= idle_min, "stall")
    return r.withColumn("idle_min", F.floor(F.greatest(idle, F.lit(0.0))).cast("long")).withColumn("ended", why)


def step_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """ST-05: the numbers of a training log's step lines; other lines go."""
    part = lambda k, kind: F.regexp_extract(line, lx.STEP_LINE, k).cast(kind)
    names = (("step", "long"), ("total", "long"), ("mean_reward", "double"), ("max_reward", "double"), ("p_ai", "double"), ("kl", "double"), ("loss", "double"), ("seconds", "double"))
    return lines.where(F.regexp_like(line, F.lit(lx.STEP_LINE))).withColumns({n: part(k + 1, t) for k, (n, t) in enumerate(names)})


def pace(df: DataFrame, by: str, ts: str) -> DataFrame:
    """W-02: by run its steps, lasted_s from the first to the last, and step_s, the mean time of a step; null with a single one."""
    r = df.groupBy(by).agg(F.count("*").alias("steps"), ((micros(F.max(ts)) - micros(F.min(ts))) / 1e6).alias("lasted_s"))
    return r.withColumn("step_s", F.col("lasted_s") / F.nullif(F.col("steps") - 1, F.lit(0)))


def remaining(steps: Column, step_s: str = "step_s") -> Column:
    """W-02: seconds that so many more steps take at the mean pace; null without one."""
    return F.col(step_s) * steps


def rental(seconds: Column, hourly: float) -> Column:
    """A-25: cost at a rate an hour."""
    return seconds / 3600 * hourly


#: A-22: judge and generation calls of each path, in dollars.
UNIT_COST = {"generation": 0.001, "judge": 0.003}


def path_cost(path: Column, attempts: Column, judge_calls: Column) -> Column:
    """A-22: rewriting pays both kinds of calls, detection one judge call, sampling its generations."""
    g, j = UNIT_COST["generation"], UNIT_COST["judge"]
    return F.when(path == "/humanize", attempts * g + judge_calls * j).when(path == "/detect", F.lit(j)).when(path == "/sample", attempts * g).otherwise(0.0)


def estimate(candidates: Column, rounds: Column) -> Column:
    """A-22, V-04: struct of expected (one round) and worst cost."""
    one = candidates * (UNIT_COST["generation"] + UNIT_COST["judge"])
    return F.struct(one.alias("expected"), (one * rounds).alias("worst"))


def client(forwarded: Column, peer: Column) -> Column:
    """ST-02."""
    return F.coalesce(F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), peer, F.lit("unknown"))


def telemetry(df: DataFrame) -> DataFrame:
    """ST-03, ST-04: rows (path, status, body) of logged paths with metrics of good JSON or an error."""
    logged = df.where(F.col("path").isin("/humanize", "/detect", "/sample"))
    body = F.from_json("body", "attempts int, judge_calls int, score double, p_ai double")
    ok, good = F.col("status") == 200, F.try_parse_json("body").isNotNull()
    error = F.when(~ok, F.concat(F.lit("http_"), F.col("status").cast("string"))).when(~good, "non-json-response")
    m = F.when(ok & good, body)
    return logged.withColumn("m", m).select("*", "m.attempts", "m.judge_calls", F.coalesce("m.score", "m.p_ai").alias("score"), error.alias("error")).drop("m", "body")


def allow(seen: deque, now: float, most: int, window: float) -> tuple[int, int, int]:
    """ST-01: status, remaining, retry_after of a call; ``seen`` holds the accepted calls and is updated."""
    while seen and seen[0] < now - window:
        seen.popleft()
    if len(seen) >= most:
        return 429, 0, max(1, int(window - (now - seen[0])))
    seen.append(now)
    return 200, most - len(seen), 0


def rate_limited(df: DataFrame, key: str, ts: str, ident: str, most: int, window: float) -> DataFrame:
    """ST-01: key, ident, status, remaining, retry_after of every call. A key's calls go in the order of time.

    The fold keeps at most ``most`` accepted calls; keys are read in sorted order from the shuffle, not gathered.
    """
    t = (micros(F.col(ts)) / 1e6).alias("t")
    rows = df.select(F.col(key).alias("key"), F.col(ident).alias("ident"), t).repartition("key").sortWithinPartitions("key", "t", "ident")

    def run(batches):
        last, seen = None, deque()
        for b in batches:
            out = []
            for k, i, now in zip(b["key"], b["ident"], b["t"]):
                if k != last:
                    last, seen = k, deque()
                out.append((k, i, *allow(seen, now, most, window)))
            yield pd.DataFrame(out, columns=["key", "ident", "status", "remaining", "retry_after"])

    return rows.mapInPandas(run, "key long, ident long, status int, remaining int, retry_after int")
