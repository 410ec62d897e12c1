"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a text is a blob named by its SHA-256. The ledger holds the findings of each pair of blob and
rule version (a digest of the rules) that was ever scanned; a scan reads only the texts of unseen pairs, one document a blob, and the
findings join back to all documents (paths) that hold the blob.

A null text counts as empty and has no findings. Null and repeated doc_ids and repeated rows each get their
row. Spans count code points, end exclusive. Matches of a kind are leftmost and don't overlap; those too short
are dropped after matching, not skipped over. An empty table gives an empty result. Only doc_id and text are
read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselab.llm.common import documents, materialise


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: The group whose length counts, and the least length.
    group: int
    least: int


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # as a run is left only at its end, the least length can stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
RULES = BASE + MORE
#: Matches of a text are summed and listed in pieces of so many, so that lists are not copied once a match.
PIECE = 256


def version_of(rules) -> str:
    """The name of a set of rules in the ledger: other rules have another, so that their blobs count as unseen."""
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def _found(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end). Starts are the lengths of what stands between and in earlier matches."""
    pattern = F.lit(rule.pattern)
    empty = F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,end:int>>)")
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    own = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    each = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(own, F.length).alias("own"))
    number = F.ceil(F.size(each) / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(number - 1, F.lit(0))), lambda i: F.slice(each, i * PIECE + 1, PIECE))
    zero, none = F.lit(0), F.expr("cast(array() as array<int>)")
    lengths = F.transform(pieces, lambda p: F.aggregate(p, zero, lambda a, x: a + x["gap"] + x["len"]))
    # where each piece begins, and within it a left-to-right sum beside the spans found so far
    begins = F.aggregate(lengths, F.struct(zero.alias("at"), none.alias("all")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    def step(acc, x):
        a = acc["at"] + x["gap"]
        span = F.struct(a.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (a + x["len"]).alias("end"))
        return F.struct((a + x["len"]).alias("at"), F.when(x["own"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def spans(p):
        return F.aggregate(p["piece"], F.struct(p["begin"].alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])

    found = F.flatten(F.transform(F.arrays_zip(pieces.alias("piece"), begins.alias("begin")), spans))
    return F.when(F.regexp_like(text, pattern), found).otherwise(empty)


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, version, spans of each row (blob, text)."""
    found = [_found(F.col("text"), rule, k) for k, rule in enumerate(rules)]
    return blobs.select("blob", F.lit(version_of(rules)).alias("version"), F.array_sort(F.concat(*found)).alias("spans"))


def update_ledger(df: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): doc_id and blob of every row, and the ledger with the pairs that it lacked."""
    docs = documents(df).withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = materialise(docs.select("doc_id", "blob"), "paths")
    unseen = paths.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("reader"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("version") == version_of(rules)).select("blob"), "blob", "left_anti")
    unseen = materialise(unseen, "unseen").withColumnRenamed("blob", "_blob")
    wanted = (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("reader")) & (F.col("blob") == F.col("_blob"))
    texts = docs.join(unseen, wanted, "left_semi").select("blob", "text")
    new = materialise(scan(texts, rules), "findings")
    return paths, new if ledger is None else ledger.unionByName(new)


def findings(df: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """doc_id, blob, spans: array of (start, ord, kind, end) in order, for every row of ``df``."""
    paths, ledger = update_ledger(df, ledger, rules)
    # a blob read from a repeated row was scanned more than once, with the same findings
    hits = materialise(ledger.where((F.col("version") == version_of(rules)) & (F.size("spans") > 0)).groupBy("blob").agg(F.max("spans").alias("spans")), "hits")
    none = F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,end:int>>)")
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def report(df: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = findings(df, ledger)
    counts = [_number(r.kind).alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
