"""The corpus of the text queries: every document with sentences of its own that set the signals off.

The prose of the tables holds none of the vocabulary that the signals look for. A document gets one of the
sentences below by its doc_id, up to three times over; Spark and SQL build the same texts from the same list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCES = (
    "Furthermore, the panel met twice. However, nobody kept minutes. Thus, the plan was lost. Moreover, it was late.",
    "You must file the form. We should wait, and they have to pay. Drivers need to slow down or ought to stop.",
    "We delve into a robust tapestry of pivotal ideas. It is a comprehensive framework, indeed a crucial paradigm.",
    "It is important to note that prices fell. When it comes to rent, a wide range of flats stood empty. Needless to say, few moved.",
    "The boat -- a small one — sank. The crew — all four — swam ashore. The cargo -- mostly salt -- was lost.",
    "She bought apples, pears, and plums. He sold nails, screws, or bolts. They like tea, milk, and sugar.",
    "It is cold and it is dark. They are late, we are tired, and you are not ready. I have time but do not care.",
    "It's late and they're gone. I can't stay, we've a train. Don't wait, it isn't far, that's all we'd need.",
    "The system works well. The rise of trams helped. The role of rails grew. The impact of tolls fell. The platform held.",
    "Not only cheap but also sturdy tools sold. Whether it's rain or snow they walk. From the old mill to the new bridge, they ran. It's not just about money.",
    "The red kite flew over the hill again. The red kite flew over the hill again. The red kite flew over the hill again.",
    'On March 5, 2021 Anna Berg paid $1,250.50 for 12 tickets, or 15% more than in 1998. "Keep it," said Tom. OpenMart sold 3,400 of them.',
    "Short. Very short. Tiny bits. A long sentence that goes on for quite a while without any stop, and then another clause follows it, but nobody minds because the reader is patient and the day is young.",
    "",
)


#: A table under so many bytes a core, in fewer files than cores, is dealt out to all cores before heavy text work.
SMALL = 8 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table in one file is often one task; a large one is left as its scan splits it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores and len(df.inputFiles()) < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, text."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"))
    n = len(SENTENCES)
    sentence = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.pmod("doc_id", F.lit(n)) + 1).cast("int"))
    times = (F.pmod(F.floor(F.col("doc_id") / n), F.lit(3)) + 1).cast("int")
    return docs.select("doc_id", "lang", "source", F.concat(F.coalesce("text", F.lit("")), F.repeat(F.concat(F.lit(" "), sentence), times)).alias("text"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: DuckDB: the same corpus, as a common table expression.
CORPUS_SQL = f"""corpus AS (
  SELECT doc_id, lang, source, coalesce(text, '') || repeat(' ' || ([{', '.join(map(quoted, SENTENCES))}])[doc_id % {len(SENTENCES)} + 1], CAST(doc_id // {len(SENTENCES)} % 3 + 1 AS BIGINT)) AS text
  FROM documents)"""


def perplexity_sql(fit: str, asked: str, out: str, folds: int = 5, share: float = 0.7, window: int = 64, stride: int = 32) -> str:
    """CTEs from tables (doc_id, text) to ``out`` (doc_id, tokens, perplexity, worst), token by token."""
    tokens = lambda t, name: f"""{out}_{name} AS MATERIALIZED (SELECT doc_id, fold, w, CASE WHEN i = 1 THEN '' ELSE l[i - 1] END AS h, i - 1 AS pos FROM (
  SELECT doc_id, fold, l, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) % {folds} AS fold, regexp_extract_all(lower(text), '[a-z][a-z''-]*') AS l FROM {t})))"""  # noqa: E731
    return f"""{tokens(fit, 'f')}, {tokens(asked, 'a')},
{out}_k AS (SELECT unnest(range({folds})) AS k),
{out}_b AS MATERIALIZED (SELECT k, h, w, count(*) AS c FROM {out}_k, {out}_f WHERE fold <> k GROUP BY ALL),
{out}_h AS MATERIALIZED (SELECT k, h, sum(c) AS c FROM {out}_b GROUP BY ALL), {out}_w AS MATERIALIZED (SELECT k, w, sum(c) AS c FROM {out}_b GROUP BY ALL),
{out}_t AS (SELECT k, sum(c) AS n, count(*) AS v FROM {out}_w GROUP BY k),
{out}_p AS (SELECT a.doc_id, a.pos, -ln(CASE WHEN h.c > 0 THEN {share} * coalesce(b.c, 0) / h.c + {1 - share} * one ELSE one END) AS nll FROM (
  SELECT a.*, (coalesce(x.c, 0) + 1) / CAST(t.n + t.v + 1 AS DOUBLE) AS one FROM {out}_a a LEFT JOIN {out}_w x ON x.k = a.fold AND x.w = a.w JOIN {out}_t t ON t.k = a.fold) a
  LEFT JOIN {out}_h h ON h.k = a.fold AND h.h = a.h LEFT JOIN {out}_b b ON b.k = a.fold AND b.h = a.h AND b.w = a.w),
{out}_s AS (SELECT doc_id, pos // {stride} AS block, count(*) AS n, sum(nll) AS nll FROM {out}_p GROUP BY ALL),
{out}_v AS (SELECT *, exp(sum(nll) OVER o / sum(n) OVER o) AS slid FROM {out}_s WINDOW o AS (PARTITION BY doc_id ORDER BY block ROWS {max(1, window // stride) - 1} PRECEDING)),
{out} AS (SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens, coalesce(exp(sum(nll) / sum(n)), 'nan'::DOUBLE) AS perplexity, coalesce(max(slid), 'nan'::DOUBLE) AS worst FROM {asked} d LEFT JOIN {out}_v USING (doc_id) GROUP BY d.doc_id)"""
