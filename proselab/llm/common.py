"""What the operators of this package share: shared storage, stable hashing, packing of arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselab.packing import U64, mix64, pack, planes, spread, unpack, unplanes  # noqa: F401

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, whose driver and executors are one machine, may do without and gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="proselab-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def workspace(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/proselab-{spark.sparkContext.applicationId}"


def configure(spark: SparkSession) -> None:
    """Arrow batches of at most 500 rows: texts are long, and a batch should fit a Python worker many times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage: a lost executor costs no recomputation of what lies above, and the sizes of the
    written files are known to the planner. Spark drops the write's own shuffle files when it ends.
    """
    spark = df.sparkSession
    path, schema = f"{workspace(spark)}/{tag}-{uuid.uuid4().hex}", df.schema
    before = spark.conf.get(CLEANUP, None)
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing unwritten reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, for when no result of the operators is needed any more."""
    _delete(spark, workspace(spark))


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column of the input can clash; a null text is empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: A table under so many bytes a core, in fewer files than cores, is dealt out to all cores before work on its texts.
SMALL = 8 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table in few files is few tasks; a large one is left as its scan splits it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores and 0 < len(df.inputFiles()) < cores else df


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(key, columns as lists) of each run of rows with equal whole-number ``keys``, across batches of sorted rows."""
    now, held = None, None
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(b)]
        columns = {c: b[c].tolist() for c in b.columns if c not in keys}
        for i, j in zip(cuts, cuts[1:]):
            key = tuple(k[i].tolist())
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, {c: [] for c in columns}
            for c, v in columns.items():
                held[c] += v[i:j]
    if now is not None:
        yield now, held


def parts_for(n_bytes: int, least: int = 256, each: int = 4 << 20) -> int:
    """Owners of an exchange: about one for every 4 MB of text, so that an owner's keys fit a worker at any size."""
    return max(least, -(-int(n_bytes) // each))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
