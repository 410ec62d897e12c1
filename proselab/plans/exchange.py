"""Queries through sources, sinks, streams and providers: what was written is read again, and equals the SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.operators import jobs, selection
from proselab.plans.seeded import dealt
from proselab.sources import readers
from proselab.streaming import jobs as streams
from proselab.streaming import sinks

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def md5(c):
    return F.md5(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("binary"))


_MD5 = "md5(coalesce({}, ''))"


@query("jsonl_pairs", f"SELECT doc_id AS human_idx, CAST(doc_id % 5 AS INTEGER) AS prompt_idx, source, {_MD5.format(chr(39) + '> ' + chr(39) + ' || text')} AS ai, {_MD5.format('text')} AS human FROM documents")
def jsonl_pairs(spark, sf_dir):
    """S-03, S-13, S-15, S-18: pairs written as JSON lines without a column of their own, and read again strictly."""
    path = readers.folder(spark, "pairs")
    rows = documents(spark, sf_dir).select(F.concat(F.lit("> "), F.col("text")).alias("ai"), F.col("text").alias("human"), "source", (F.col("doc_id") % 5).cast("int").alias("prompt_idx"), F.col("doc_id").alias("human_idx"), "n_chars")
    readers.write_jsonl(rows, path, drop=("n_chars",))
    return readers.pairs(spark, path, strict=True).select("human_idx", "prompt_idx", "source", md5("ai").alias("ai"), md5("human").alias("human"))


@query("jsonl_tolerant", f"SELECT doc_id AS human_idx, {_MD5.format('text')} AS human FROM documents WHERE n_chars % 7 <> 0")
def jsonl_tolerant(spark, sf_dir):
    """S-04: lines that are cut off or empty are left out."""
    path = readers.folder(spark, "lines")
    line = F.to_json(F.struct(F.col("doc_id").alias("human_idx"), F.col("text").alias("human")))
    broken = F.when(F.col("n_chars") % 14 == 0, F.lit("  ")).when(F.col("n_chars") % 7 == 0, F.expr("substr(l, 1, length(l) - 1)")).otherwise(F.col("l"))
    documents(spark, sf_dir).withColumn("l", line).select(broken.alias("value")).write.text(path)
    return readers.pairs(spark, path).select("human_idx", md5("human").alias("human"))


@query("jsonl_source_counts", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND n_chars % 3 <> 0 GROUP BY source")
def jsonl_source_counts(spark, sf_dir):
    """S-02, L-04: the source of each line that has one."""
    path = readers.folder(spark, "sources")
    documents(spark, sf_dir).select("doc_id", F.when(F.col("n_chars") % 3 != 0, F.col("source")).alias("source")).write.json(path)
    return readers.jsonl_sources(spark, path).groupBy("source").agg(F.count("*").alias("n"))


@query("report_file", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(lang) AS last_lang FROM documents")
def report_file(spark, sf_dir):
    """S-01, S-16: a summary as indented JSON in one file, read again as a whole text."""
    path = readers.artefact(readers.folder(spark, "run") + ".json", "report")
    readers.write_report(documents(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("lang").alias("last_lang")), path)
    return readers.text_input(spark, path).select(F.from_json("text", "n long, chars long, last_lang string").alias("r")).select("r.*")


#: Prompts of an evaluation file.
_FILE = 50
_SLOT = f"doc_id // {_FILE} AS file, doc_id, row_number() OVER (PARTITION BY doc_id // {_FILE} ORDER BY doc_id) - 1 AS place, text, (coalesce(n_chars, 0) % 101) / 101.0 AS p"


def _files(spark, sf_dir, value, path):
    """One text for each run of _FILE documents, in files of their own, from arrays in the order of doc_id."""
    p = ((F.coalesce("n_chars", F.lit(0)) % 101) / 101.0).alias("p")
    rows = documents(spark, sf_dir).select(F.floor(F.col("doc_id") / _FILE).alias("file"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"), p).alias("x")).groupBy("file").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rows.select("file", value(F.col("x")).alias("value")).write.partitionBy("file").text(path)


@query(
    "evaluation_files",
    f"WITH s AS (SELECT {_SLOT} FROM documents) SELECT r AS run, CAST(place AS INTEGER) AS prompt_idx, count(*) AS files, round(sum(CASE WHEN r = 'base' THEN p ELSE p / 2 END), 6) AS total, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM s, (VALUES ('base'), ('trained')) AS v(r) GROUP BY ALL",
)
def evaluation_files(spark, sf_dir):
    """S-05: evaluation files of two runs, each with zipped arrays by prompt."""
    path = readers.folder(spark, "evaluations")
    part = lambda x, by: F.struct(F.transform(x, lambda e: e["text"]).alias("outputs"), F.transform(x, lambda e: e["p"] / by).alias("p_ai_ensemble"))
    _files(spark, sf_dir, lambda x: F.to_json(F.struct(part(x, 1).alias("base"), part(x, 2).alias("trained"))), path)
    e = readers.eval_json(spark, f"{path}/*", "outputs array<string>, p_ai_ensemble array<double>")
    return e.groupBy("run", "prompt_idx").agg(F.count("*").alias("files"), F.round(F.sum("p_ai_ensemble"), 6).alias("total"), F.sum(F.length("outputs")).alias("chars"))


@query(
    "variant_files",
    f"WITH s AS (SELECT {_SLOT} FROM documents) SELECT d AS detector, v AS variant, count(*) AS n, round(sum(p * w), 6) AS total FROM s, (VALUES ('a', 'base', 1), ('a', 'trained', 2), ('b', 'base', 3)) AS x(d, v, w) GROUP BY ALL",
)
def variant_files(spark, sf_dir):
    """S-06: scores by detector and variant of the files that are there."""
    path = readers.folder(spark, "variants")
    ps = lambda x, by: F.transform(x, lambda e: e["p"] * by)
    each = lambda x: F.create_map(F.lit("a"), F.create_map(F.lit("base"), ps(x, 1), F.lit("trained"), ps(x, 2)), F.lit("b"), F.create_map(F.lit("base"), ps(x, 3)))
    _files(spark, sf_dir, lambda x: F.to_json(F.struct(each(x).alias("per_detector_per_variant"))), path)
    rows = readers.variant_scores(spark, [path, f"{path}-missing"])
    return rows.groupBy("detector", "variant").agg(F.count("*").alias("n"), F.round(F.sum("p_ai"), 6).alias("total"))


@query("pairs_resumed", f"SELECT doc_id AS human_idx, CAST(p AS INTEGER) AS prompt_idx, {_MD5.format(chr(39) + '> ' + chr(39) + ' || text')} AS ai FROM documents, range(3) AS r(p) WHERE text IS NOT NULL")
def pairs_resumed(spark, sf_dir):
    """S-14, C-02: pairs appended by a run that ended early, then by one that goes on; none is made twice."""
    path = readers.folder(spark, "made")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    answered = lambda left: left.withColumn("ai", F.concat(F.lit("> "), F.col("human")))
    jobs.generate_pairs(docs.where("doc_id % 2 = 0"), 3, answered, path, "gzip")
    jobs.generate_pairs(docs, 3, answered, path, "gzip")
    return readers.pairs(spark, path).select("human_idx", "prompt_idx", md5("ai").alias("ai"))


@query("telemetry_sink", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def telemetry_sink(spark, sf_dir):
    """S-17, S-19, ST-08: events as a stream into compact lines, polled until the table is there, and once more."""
    path, at = readers.folder(spark, "telemetry"), f"{sf_dir}/events.parquet"
    events = spark.read.parquet(at)
    # a pattern, as a stream's own path must be a folder
    start = lambda: sinks.write_stream(streams.read(spark, f"{sf_dir}/events.parque[t]", events.schema), path, f"{path}-checkpoint", f"{path}-dead")
    sinks.until_artefact(start, spark, at)
    start().awaitTermination()
    return sinks.written(spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "routed_messages",
    """SELECT CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'detect' WHEN k = 2 THEN 'ping' ELSE 'other' END AS type, k IN (1, 2) AS ok, CASE WHEN k = 0 THEN 'bad json' WHEN k = 3 THEN 'unknown type' END AS error, count(*) AS n, CAST(sum(CASE WHEN k = 0 THEN NULL ELSE doc_id END) AS BIGINT) AS ids
FROM (SELECT doc_id, coalesce(n_chars, 0) % 4 AS k FROM documents) GROUP BY ALL""",
)
def routed_messages(spark, sf_dir):
    """S-24: messages by type, with an error for bad JSON and unknown types."""
    kind = F.element_at(F.array(*map(F.lit, ("", "detect", "ping", "other"))), (F.coalesce("n_chars", F.lit(0)) % 4 + 1).cast("int"))
    good = F.to_json(F.struct(kind.alias("type"), F.col("doc_id").alias("id"), "text"))
    lines = documents(spark, sf_dir).select(F.when(kind == "", F.lit("{type:")).otherwise(good).alias("value"))
    return readers.routed(lines).groupBy("type", "ok", "error").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(
    "provider_calls",
    f"SELECT doc_id, CAST(k AS INTEGER) AS cand_idx, CASE WHEN length(coalesce(text, '')) % 11 = 0 THEN '{lx.FAILED}' ELSE md5(k || ':' || coalesce(text, '')) END AS output FROM documents, range(2) AS r(k)",
)
def provider_calls(spark, sf_dir):
    """S-20 to S-23, Q-01, Q-02, M-10, M-11: two samples a text from a call that fails on some, eight at once."""

    def prepare():
        import hashlib

        return hashlib.md5

    def call(text, k, digest):
        if len(text) % 11 == 0:
            raise ConnectionError("no answer")
        return digest(f"{k}:{text}".encode()).hexdigest()

    docs = dealt(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return readers.provided(docs, call, n=2, retries=1, failed=lx.FAILED, prepare=prepare, at_once=8).select("doc_id", "cand_idx", "output")


@query(
    "refined_texts",
    f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, CASE WHEN length(t) - 200 < 1000 THEN 1 WHEN length(t) - 400 < 1000 THEN 2 ELSE 3 END AS passes FROM p)
SELECT doc_id, passes, {_MD5.format('substr(t, 1 + 200 * passes)')} AS text FROM n""",
)
def refined_texts(spark, sf_dir):
    """Q-07, Q-03: a step on what is not finished, at most three times; here it drops two hundred characters."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("passes"))
    step = lambda rows: rows.select("doc_id", F.expr("substr(text, 201)").alias("text"), (F.col("passes") + 1).alias("passes"))
    return selection.refine(docs, step, F.length("text") < 1000).select("doc_id", "passes", md5("text").alias("text"))
