"""ST-06, ST-07 live: runs that end by a timer when no step comes or when they have lasted too long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from proselab.operators.logs import micros

ENDED = "run string, began double, last_step double, steps long, ended string, at double"


class Guard(StatefulProcessor):
    """One run's beginning, last step and number of steps; one timer, at the first moment at which a guard ends it."""

    def __init__(self, idle_min: float, grace_min: float, cap_h: float):
        self.idle, self.grace, self.cap = idle_min * 60, grace_min * 60, cap_h * 3600

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "began double, last_step double, steps long")

    def due(self, began: float, last: float) -> tuple[float, str]:
        """When the run ends and why; at the same moment the cap goes first, as in ``logs.guarded``."""
        stall, cap = max(last, began + self.grace) + self.idle, began + self.cap
        return (cap, "cap") if cap <= stall else (stall, "stall")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        began, last, steps = self.run.get() if self.run.exists() else (float("inf"), float("-inf"), 0)
        for b in rows:
            began, last, steps = min(began, float(b["t"].min())), max(last, float(b["t"].max())), steps + len(b)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.run.update((began, last, steps))
        self.handle.registerTimer(int(self.due(began, last)[0] * 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        began, last, steps = self.run.get()
        at, why = self.due(began, last)
        self.run.clear()
        yield pd.DataFrame({"run": [key[0]], "began": [began], "last_step": [last], "steps": [steps], "ended": [why], "at": [at]})

    def close(self) -> None:
        pass


def guarded(steps: DataFrame, by: str, ts: str, idle_min: float, grace_min: float, cap_h: float, late: str = "0 seconds") -> DataFrame:
    """Rows of ENDED, one for each run that stalled or reached its cap, as soon as the stream's time has come there.

    Time is that of the steps of all runs (a watermark of ``late``), so that a log is judged the same way when it
    is read again; a heartbeat row keeps it going where no run has a step. A run whose step comes after its
    end begins anew. Needs the state store of RocksDB.
    """
    timed = steps.withWatermark(ts, late).select(F.col(by).cast("string").alias("run"), F.col(ts), (micros(F.col(ts)) / 1e6).alias("t"))
    return timed.groupBy("run").transformWithStateInPandas(Guard(idle_min, grace_min, cap_h), ENDED, "Append", "EventTime")
