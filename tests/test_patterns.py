"""Short cuts of text expressions against the plain forms that they stand for."""

import re

import pytest
from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.functions import text as tx
from proselab.operators import fingerprint as fp
from proselab.operators import jobs
from proselab.operators import rewrite as rw

TEXTS = [
    None, "", "   x  \n", "a b", "In order to go, IN ORDER TO stay.", "beGIN ORDER TO x. a variety often", "It iſ not so. DO NOT. İt is. ItK is", "I have, we are; cannot", "the realm of the realm of",
    "muſt go. Haſ to. must. ıt's not juſt about x", "Drédo not. _do not 1do not ſdo not", "It'S, don't; can't", "not only a b but also c, a, b, and c. From the a to b, x", "a -- b — c --- d",
]


def rows(spark, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    return [tuple(r) for r in df.select(*columns).orderBy("i").collect()]


def one_by_one(rules, flags):
    t = F.col("text")
    for p, r in rules:
        t = F.regexp_replace(t, flags + p, r.replace("\\", "\\\\").replace("$", "\\$"))
    return t


@pytest.mark.parametrize("rules, flags", [([("\\Q" + a + "\\E", b) for a, b in lx.PHRASES], "(?i)"), (lx.PLAIN_CONTRACTIONS, "(?iU)"), ([("a+b", "x"), ("a", "bb"), ("bb\\b", "c"), ("ab", "d")], "(?i)")])
def test_chains_as_rule_after_rule(spark, rules, flags):
    assert all(a == b for a, b in rows(spark, rw.native_chain(F.col("text"), rules, flags), one_by_one(rules, flags)))


def test_either_reads_common_beginnings_once():
    found = tx.either(["do", "does", "\\Qdone.\\E", "a+"])
    assert found.count("d") == 1
    assert [m[0] for m in re.finditer(found, "do does done. aa donex")] == ["do", "does", "done.", "aa", "do"]


def test_strip_and_counts_as_by_patterns(spark):
    t = F.col("text")
    pairs = [(tx.strip(t), F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))]
    low = F.lower(t)
    for p, hints in [(lx.CONTRACTED, ["'"]), (lx.EXPANDED, []), (lx.MODALS, fp._MODAL), *((p, [h]) for p, h in zip(lx.ENUMERATIONS, fp._SHAPES))]:
        pairs.append((tx.matches(t, p, True, low, hints), F.regexp_count(t, F.lit("(?iuU)" + p))))
    for piece in ("--", "—", "a"):
        pairs.append((tx.count_of(t, piece), ((F.length(t) - F.length(F.replace(t, F.lit(piece), F.lit("")))) / len(piece)).cast("int")))
    for r in rows(spark, *(c for p in pairs for c in p)):
        assert r[::2] == r[1::2]


def test_variants_of_equal_text_are_scored_once(spark):
    df = spark.createDataFrame([(1, "In order to win it is late."), (2, "Plain words."), (3, "")], "doc_id int, text string")
    whole = jobs.scores(jobs.variants(df, rw.phrases_native, rw.contractions_native)).withColumn("p_ai", jobs.p_ai())
    columns = ("doc_id", "variant", "p_pattern", "p_reduced", "p_evenness", "p_ai")
    mine = jobs.variant_scores(df, rw.phrases_native, rw.contractions_native)
    assert sorted(map(tuple, mine.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    # one text each of the second and third row, four of the first
    assert "array_distinct" in mine._jdf.queryExecution().optimizedPlan().toString()
