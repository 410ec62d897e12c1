"""Sinks that hold every row once, whatever is tried again, and polling until an artefact is there (S-14, S-17 to S-19, ST-08)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselab.sources.readers import settled, there


def lines(rows: DataFrame) -> DataFrame:
    """S-17: each row as one compact JSON line; null fields are left out."""
    return rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("value"))


def sent(rows: DataFrame, send: Callable[[str], None]) -> DataFrame:
    """value and error (null where the call went well) of each line handed to ``send``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = []
            for v in b["value"]:
                try:
                    send(v)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a receiver may fail in any way
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(error=pd.Series(errors, b.index, object))

    return rows.mapInPandas(run, "value string, error string")


def batch_writer(path: str, dead: str | None = None, send: Callable[[str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """S-14, S-17: what ``foreachBatch`` calls; every batch is a folder ``batch=<number>`` below ``path``.

    The folder's success mark is the ledger: a batch that has it is left alone when a restarted query hands it over
    again, and one that was cut off is written anew in the place of what it left, so that each row is there once.
    Lines that ``send`` refuses go to ``dead`` with their error and are not in ``path``. Without ``dead`` an error
    ends the query; with it a batch that cannot be written goes there whole, and the query runs on. ``send`` itself
    may be called again for a batch that was cut off.
    """

    def write(batch: DataFrame, number: int) -> None:
        at, spark = f"{path}/batch={number}", batch.sparkSession
        if there(spark, f"{at}/_SUCCESS"):
            return
        rows = lines(batch)
        try:
            tried = settled(sent(rows, send)) if send else rows.withColumn("error", F.lit(None).cast("string"))
            if dead and send:
                tried.where("error IS NOT NULL").write.mode("overwrite").json(f"{dead}/batch={number}")
            elif send and not tried.where("error IS NOT NULL").isEmpty():
                raise RuntimeError(tried.where("error IS NOT NULL").first()["error"])
            tried.where("error IS NULL").select("value").write.mode("overwrite").text(at)
        except Exception as e:
            if not dead:
                raise
            rows.withColumn("error", F.lit(f"{type(e).__name__}: {str(e)[:500]}")).write.mode("overwrite").json(f"{dead}/batch={number}")

    return write


def write_stream(stream: DataFrame, path: str, checkpoint: str, dead: str | None = None, send: Callable[[str], None] | None = None):
    """S-17, S-19: what has come so far, through ``batch_writer``; the checkpoint says where the next call goes on."""
    return stream.writeStream.foreachBatch(batch_writer(path, dead, send)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches below ``path``, with the number of their batch."""
    if not there(spark, path):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema("value string, batch int").text(path).select(F.from_json("value", schema).alias("v"), "batch").select("v.*", "batch")


def until_artefact(start: Callable[[], object], spark: SparkSession, artefact: str, wait_s: float = 1.0, most_s: float = float("inf")) -> bool:
    """ST-08: ``start()`` reads what has come, again and again, until the artefact was there before a pass began.

    So whatever lies beside the artefact is read as well. False where ``most_s`` seconds pass before that.
    """
    began = time.monotonic()
    while True:
        final = there(spark, artefact)
        start().awaitTermination()
        if final:
            return True
        if time.monotonic() - began >= most_s:
            return False
        time.sleep(wait_s)
