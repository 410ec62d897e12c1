"""Command line (V-07): ``python -m proselab.cli <command>``.

Texts come from a file before an argument before standard input (S-01). ``humanize`` and ``reject`` rewrite a text
under several seeds and choose by rejection; ``pipeline`` scrubs, varies and scores; ``eval`` summarises rewrites of
JSON lines with a field ``source``; ``prepare-data`` writes pairs of a word range. Serving over HTTP is not part of it.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselab import queries
from proselab.operators import corpus, fingerprint, jobs, registry, rewrite, selection
from proselab.sources import readers


def _text(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return readers.text_input(spark, a.file, a.text if a.text is not None or a.file else sys.stdin.read())


def _scored(df: DataFrame, text: str) -> DataFrame:
    return jobs.scores(df, text).withColumn("p_ai", jobs.p_ai())


def candidates(df: DataFrame, n: int) -> DataFrame:
    """doc_id, text, round, cand_idx, rewrite, p_ai, sim, overlap: rewrites of each text under n seeds."""
    def seeded(text, k):
        return rewrite.scrub(text or "", rewrite.ScrubConfig(seed=k))[0]

    cand = _scored(readers.provided(df, seeded, out="rewrite", n=n, failed=""), "rewrite")
    return cand.select("doc_id", "text", F.lit(0).alias("round"), "cand_idx", "rewrite", "p_ai", jobs.shared_words(F.col("rewrite"), F.col("text")).alias("sim"), F.lit(1.0).alias("overlap"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="proselab")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("patterns", "scrub", "detect", "pipeline", "humanize", "reject"):
        p = commands.add_parser(name)
        p.add_argument("text", nargs="?")
        p.add_argument("--file")
        if name in ("humanize", "reject"):
            p.add_argument("--candidates", type=int, default=8, choices=range(1, 17))
            p.add_argument("--threshold", type=float, default=0.2)
    e = commands.add_parser("eval", help="rewrite and summarise the sources of JSON lines")
    e.add_argument("sources")
    e.add_argument("--n", type=int)
    e.add_argument("--samples", help="folder for the rewrites as JSON lines")
    d = commands.add_parser("prepare-data", help="pairs whose texts have a range of words")
    d.add_argument("pairs")
    d.add_argument("out")
    d.add_argument("--low", type=int, default=50)
    d.add_argument("--high", type=int, default=400)
    run = commands.add_parser("run", help="a registered query")
    run.add_argument("query", choices=sorted(queries.QUERIES))
    run.add_argument("tables", help="folder of the parquet tables")
    run.add_argument("--out", help="folder for the result, else it is shown")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "patterns":
        out = fingerprint.explain(fingerprint.fingerprint(_text(spark, a))).select("report")
    elif a.command == "scrub":
        out = rewrite.scrubbed(_text(spark, a)).select("rewrite", "edits", "edits_by_kind")
    elif a.command == "detect":
        out = _scored(_text(spark, a), "text").select("p_ai", *(f"p_{n}" for n, _ in registry.DETECTORS))
    elif a.command == "pipeline":
        done = rewrite.postprocessed(rewrite.scrubbed(_text(spark, a)).select("text", "rewrite"), "rewrite")
        out = _scored(done, "bursty").select("bursty", "p_ai", F.col("p_pattern").alias("pattern"), jobs.shared_words(F.col("bursty"), F.col("text")).alias("similarity"))
    elif a.command in ("humanize", "reject"):
        text = _text(spark, a).withColumn("doc_id", F.lit(0).cast("long"))
        cand = readers.settled(candidates(text, a.candidates))
        chosen = selection.rejection(cand, text.select("doc_id"), a.threshold, a.threshold / 4)
        best = chosen.join(cand.select("doc_id", "round", "cand_idx", "rewrite"), ["doc_id", "round", "cand_idx"], "left")
        out = best.select("passed", "p_ai", F.coalesce("rewrite", F.lit("")).alias("rewrite"), "attempts")
    elif a.command == "eval":
        rows = readers.jsonl_sources(spark, a.sources, a.n).select(F.col("source").alias("text"))
        rows = readers.settled(jobs.evaluated(rows, lambda t: rewrite.contractions_native(rewrite.phrases_native(t))))
        if a.samples:
            readers.write_jsonl(rows.select(F.col("text").alias("source"), "rewrite", "p_ai", "similarity", "cv"), a.samples)
        out = jobs.summary(rows).select(jobs.summary_text().alias("summary"))
    elif a.command == "prepare-data":
        both = corpus.in_range("ai", a.low, a.high) & corpus.in_range("human", a.low, a.high)
        readers.write_jsonl(readers.pairs(spark, a.pairs).where(both), a.out)
        out = spark.read.json(a.out)
        return out
    else:
        out = queries.QUERIES[a.query](spark, a.tables)
        if a.out:
            out.write.parquet(a.out)
            return out
    out.show(truncate=False)
    return out


if __name__ == "__main__":
    main()
