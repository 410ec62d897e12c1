"""Sources and sinks (S-*). Schemas are given, never inferred."""

from __future__ import annotations

import json
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselab.functions import lexicon as lx

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PAIR = "ai string, human string, source string, prompt_idx int, human_idx long"


def folder(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder in ``spark.checkpoint.dir``; only a local master may do without and gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="proselab-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once; shuffle files of the write end with it."""
    spark, path = df.sparkSession, folder(df.sparkSession, "settled")
    # without a default of ours, or the setting's own one is not told
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``settled`` that nothing unwritten reads any more."""
    for t in tables:
        where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_to)
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def few_rows(spark: SparkSession, most: int = 500) -> None:
    """Arrow functions over whole texts get at most so many rows at a time, so that a worker's memory does not grow with its partition."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > most:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most))


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def artefact(path: str, kind: str) -> str:
    """M-13: where what is derived from a file goes, as ``<stem>.scrub-eval.json`` or ``<stem>.holdout.json``."""
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}{name.rpartition('.')[0] or name}.{kind}.json"


def text_input(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """S-01: a whole file before a given text; an error without either."""
    if path:
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    if text is None:
        raise ValueError("neither a file nor a text")
    return spark.createDataFrame([(text,)], "text string")


def jsonl_sources(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """S-02, L-04: the source of each line that has one; with ``limit`` the first by a hash, so that they are always the same."""
    rows = spark.read.schema("source string").json(path).where("source is not null")
    return rows.orderBy(F.xxhash64("source"), "source").limit(limit) if limit is not None else rows


def pairs(spark: SparkSession, path: str, strict: bool = False, schema: str = PAIR) -> DataFrame:
    """S-03, S-04: JSON lines; bad lines are an error if ``strict`` and left out otherwise."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where((F.trim("value") != "") & F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("v")).select("v.*")


def eval_json(spark: SparkSession, path: str, arrays: str = "outputs array<string>, p_ai_ensemble array<double>, similarity array<double>, pattern array<double>") -> DataFrame:
    """S-05: run, prompt_idx and the zipped arrays of an evaluation file's base and trained parts."""
    names = [a.split()[0] for a in arrays.split(", ")]
    kind = "struct<" + ",".join(f"{a.split()[0]}:{a.split()[1]}" for a in arrays.split(", ")) + ">"
    rows = spark.read.schema(f"base {kind}, trained {kind}").option("multiLine", True).json(path)
    parts = [rows.select(F.lit(r).alias("run"), F.posexplode(F.arrays_zip(*(F.col(f"{r}.{n}").alias(n) for n in names))).alias("prompt_idx", "x")) for r in ("base", "trained")]
    return parts[0].unionByName(parts[1]).select("run", "prompt_idx", "x.*")


def variant_scores(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S-06: detector, variant, prompt_idx, p_ai of the files that exist and parse."""
    found = [p for p in paths if there(spark, p)]
    rows = spark.read.schema("per_detector_per_variant map<string,map<string,array<double>>>").option("multiLine", True).json(found) if found else spark.createDataFrame([], "per_detector_per_variant map<string,map<string,array<double>>>")
    d = rows.select(F.explode("per_detector_per_variant").alias("detector", "v"))
    return d.select("detector", F.explode("v").alias("variant", "p")).select("detector", "variant", F.posexplode("p").alias("prompt_idx", "p_ai"))


def labelled(df: DataFrame, label: str, value: int, n: int | None = None) -> DataFrame:
    """S-08, P-02: rows with a label, 0 where it is missing."""
    rows = df.where(F.coalesce(F.col(label), F.lit(0)) == value)
    return rows.limit(n) if n is not None else rows


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", drop: tuple = (), compression: str | None = None) -> None:
    """S-13 to S-15, S-18."""
    df.drop(*drop).write.mode(mode).json(path, compression=compression)


def write_report(summary: DataFrame, path: str) -> None:
    """S-16: a summary of one row as indented JSON, in the store that the path names."""
    spark = summary.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(json.dumps(summary.first().asDict(recursive=True), indent=2).encode())
    finally:
        stream.close()


def provided(df: DataFrame, call: Callable, text: str = "text", out: str = "output", retries: int = 2, n: int = 1, failed=None, kind: str = "string", wait: float = 0.0, prepare: Callable | None = None, at_once: int = 1) -> DataFrame:
    """S-20 to S-23, D-01, D-02, D-12, D-13, Q-01, Q-02, M-10, M-11: ``df`` with cand_idx and the answers of an external provider, n for each row.

    ``call(text, cand_idx)`` is told which of the n samples it makes, so that it can set a seed. It may give a list,
    as services with several choices do: then it is called again only for the samples that are still missing.
    A call that fails is tried again ``retries`` times, after 1.5 times ``wait`` seconds more each time; the answer
    is ``failed`` (a mark, or 0.5 for a neutral score) where all tries fail. ``kind`` is the type of an answer.
    ``prepare()`` runs once a task before its first call and gives what is passed on as ``call``'s third argument,
    for a client or a model. Up to ``at_once`` rows of a task are answered at the same time, by threads; each waits
    for its own retries alone, and answers keep the order of the rows.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", cand_idx int, `{out}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        first = threading.Lock()

        def one(t, k):
            with first:
                if prepare and not held:
                    held.append(prepare())
            for turn in range(retries + 1):
                try:
                    return call(t, k, *held)
                except Exception:  # noqa: BLE001  a provider may fail in any way
                    if turn < retries:
                        time.sleep(1.5 * wait * (turn + 1))
            return failed

        def samples(t):
            found: list = []
            while len(found) < n:
                got = one(t, len(found))
                found += got or [failed] if isinstance(got, list) else [got]
            return found[:n]

        with ThreadPoolExecutor(max(1, at_once)) as pool:
            for b in batches:
                yield from answered(b, pool.map(samples, b[text]) if at_once > 1 else map(samples, b[text]))

    def answered(b: pd.DataFrame, given: Iterable[list]) -> Iterator[pd.DataFrame]:
        answers = list(given)
        yield pd.concat([b.assign(**{"cand_idx": k, out: [a[k] for a in answers]}) for k in range(n)])

    return df.mapInPandas(run, schema)


def succeeded(df: DataFrame, out: str = "output", mark: str = lx.FAILED) -> DataFrame:
    """P-10: the rows whose answer is there and does not begin with the mark of a failure."""
    return df.where(F.col(out).isNotNull() & ~F.startswith(F.col(out), F.lit(mark)))


def routed(messages: DataFrame) -> DataFrame:
    """S-24: id, type, ok, error of JSON-lines messages; bad JSON and unknown types get an error."""
    m = F.from_json("value", "type string, id long, text string, n int")
    known = F.col("m.type").isin("detect", "humanize", "ping")
    error = F.when(F.try_parse_json("value").isNull(), "bad json").when(~F.coalesce(known, F.lit(False)), "unknown type")
    return messages.withColumn("m", m).select("m.id", "m.type", error.isNull().alias("ok"), error.alias("error"))
