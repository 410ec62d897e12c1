"""The cheap looks before the built-in rewrites against the searches that they spare (F11)."""

import re

import pytest
from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.functions import text as tx
from proselab.operators import native as nt
from proselab.operators import rewrite as rw

NEEDLES = {
    "hedges": [h.lower() for h in lx.HEDGES_DROPPED], "phrases": [a.lower() for a, _ in lx.PHRASES],
    "favourites": [rw._needle(p) for p, _ in lx.FAVOURITE_SWAPS], "contractions": [rw._needle(p) for p, _ in lx.CONTRACTIONS], "drops": list(lx.DROPPED_CONNECTORS + lx.DROPPED_CONCLUDERS),
}
ODD = [
    "", " ", "a", "a  b", " a b ", "a\n\nb c", "a \n b", "é é  é", "\x1ca \x1c b", "a\tb", "one two three", "x  y z",
    "plan planner planning plan", "Plan PLANS-x planner", "éclair éclairs", "planplan plan", "the a an apple", "a an apple an a", "A hour an uncle a honor an İx a ıx",
    "a well-a b", "aan apple", "an a", "AN apple a Apple", "ſa an b", "an ıx an ſx", "x. a\nb! c",
]


@pytest.mark.parametrize("name", sorted(NEEDLES))
def test_needles_are_found_by_both_looks(spark, name):
    needles = NEEDLES[name]
    texts = [f"so {n} so" for n in needles] + needles + [n[1:] for n in needles] + [n[:-1] for n in needles] + [n.replace(" ", "  ") for n in needles] + ["", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for look in (nt.has_word, nt.has_phrase):
        got = {r.t: r.x for r in df.select("t", look(F.col("t"), needles).alias("x")).collect()}
        assert got == {t: any(n in t for n in needles) for t in texts}


def test_favourites_are_looked_for_by_fewer_pieces():
    assert len(nt.groups(NEEDLES["favourites"])) < 0.75 * len(NEEDLES["favourites"])


def test_words_by_spaces(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, None]], "t string")
    for r in df.select("t", tx.words_by_spaces("t").alias("x"), tx.word_count("t").alias("y")).collect():
        assert r.x == r.y, r.t


def test_stems_articles_and_lines(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    t = F.col("t")
    rows = df.select("t", nt.collapse_stems(t).alias("s"), nt.right_articles(t)["text"].alias("a"), nt.lines(t)["lines"].alias("l"), nt.sentence_case(t).alias("c")).collect()
    for r in rows:
        assert (r.s.text, r.s.edits) == rw._STEM.subn(lambda m: m[0].split()[0], r.t), r.t
        assert r.a == rw._ARTICLE.sub(rw._article, r.t), r.t
        assert all(x.n == len(re.findall(r"[^\s]+", x.s)) for x in r.l if "\x1c" not in x.s), r.t
        assert r.c == rw.sentence_case(r.t), r.t
