"""The built-in rewrites against the plain ones, on texts of our own."""

import pytest
from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.operators import jobs
from proselab.operators import native as nt
from proselab.operators import rewrite as rw
from proselab.plans import services
from proselab.plans.seeded import SENTENCES

LONG = "The old mill by the river stood empty for many years after the flood took its wheel, and the owners moved to the town where work in the new plants was easy to find."
TEXTS = [
    "", "   \n ", "one", "é", None,
    "Furthermore, the shop closed. Moreover, it was sold. furthermore, nobody knew. In addition, In addition, it rained.",
    "However, it rained. However, we went. Thus, However, nobody came. Indeed, Thus, so. However,However,",
    "It should be noted that rents rose. IT SHOULD BE NOTED THAT  they fell. (in many cases) it is so. Certainly! yes",
    "They did it In Order To win. due to the fact that in the realm of the realm of it. moving forward, we go. a deep dive into it",
    "A Robust plan is a CRUCIAL step. HENCEFORTH, we delve into it. Henceforth we go. x therein. Whereby  Hitherto, no. cutting-edge CUTTING-EDGE",
    "It is not late. THEY ARE here. Cannot, i am, I AM, I have. DO NOT do not Do not",
    "It rose -- The crowd of people cheered — loudly. All -- of -- it --", "——", "-- a", "é—É une deux trois quatre—b ,—, c",
    "We saw red kites, black crows, or old gulls there. a-b, c-d, and e-f. one two three four five, six, and seven eight. - x, y, and été",
    LONG, LONG + " " + LONG.replace(", and", ", so") + " Ends", "word " * 40 + "end.", ", and " + "word " * 40,
    "It rained. We left! The road to the coast was long and very dull. Yes. No? \"Well.\" She went. A. B. C.", "One. Two.", "One. Two. Three.",
    " ".join(f"The {w} went to the far hill today, but the rest of them stayed at home." for w in ("dog", "cat", "cow", "hen", "fox")),
    " ".join(f"The {w} went to the far hill today; the rest of them which stayed slept, while we sat there in it." for w in ("dog", "cat", "cow", "hen", "fox")),
    "The planning planners plans plan Plan met on the roads and roadside roadsides. été étés. über übers übersee",
    "She has a idea and an hour, an unicorn and a apple. A honest An user a European An one-off ça l'a an é",
    'On May 3 "Thus, it is robust -- truly," she said, "and crucial." “It is not” ""  it is "" and "open',
    " ".join(f'Furthermore, it is not "late {k}, thus robust" here.' for k in range(700)),
    "a b. c d .  e", "x.  y\ty.\n\nz . , w.,v", *SENTENCES,
]
PLAIN = {
    "em_dash_thin": rw.thin_dashes, "tricolon_break": rw.break_lists, "sentence_split": lambda t: rw.split_long(t, 28),
    "sentence_merge": lambda t: rw.merge_short(t, 5), "variance_inject": lambda t: rw.vary_lengths(t, 0.35),
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string").repartition(4).cache()


def test_program(texts):
    got = {r.k: (r.rewrite, r.edits_by_kind, r.edits) for r in nt.scrubbed(texts).collect()}
    for k, t in enumerate(TEXTS):
        text, edits = rw.scrub(t or "")
        assert got[k] == (text, edits, sum(edits.values())), t


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_stage(texts, name):
    rows = texts.select("k", nt.stages()[name](F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in rows:
        assert (r.s.text, r.s.edits) == PLAIN[name](TEXTS[r.k] or ""), TEXTS[r.k]


def test_program_with_stages_off_and_another_seed(texts):
    for how in (rw.ScrubConfig(off=frozenset(rw.STAGES)), rw.ScrubConfig(off=frozenset({"sentence_split", "transition_drop"}), keep_case=False, seed=7, short_words=9)):
        got = {r.k: (r.rewrite, r.edits_by_kind) for r in nt.scrubbed(texts, how=how).collect()}
        assert got == {k: rw.scrub(t or "", how) for k, t in enumerate(TEXTS)}


def test_postprocessor(texts):
    got = {r.k: r.bursty for r in nt.postprocessed(texts).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k] == rw.burstiness(t or ""), t


def test_rules_in_one_arrow_function_are_the_native_ones(spark):
    """Phrases fold ASCII's cases alone, contractions Unicode's, also where signs change their number of letters in lower case; a null stays one."""
    texts = [a for a, _ in lx.PHRASES] + [f"{a.upper()} {a}x{a}" for a, _ in lx.PHRASES[::3]] + [p.replace(r"\b", "") for p, _ in lx.PLAIN_CONTRACTIONS]
    texts += ["\u0130t \u0130s it \u0131s \u0130t is not, THE REALM OF the realm of\u0130", "I\u017f not i\u017f not \u00e9is not is not\u0301 is not\u2003IS NOT", "That is not it is not what is it is", "in the realm of the realm of a wide range of \u212anow that i am I AM", "cannot CANNOT c\u00e1nnot can not", ""]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    t = F.col("text")
    got = df.select(rw.phrases(t), rw.phrases_native(t), rw.contractions(t), rw.contractions_native(t), rw.contractions(rw.phrases(t)), rw.contractions_native(rw.phrases_native(t))).collect()
    assert [r[0::2] for r in got] == [r[1::2] for r in got]
    assert sum(r[0] != x for r, x in zip(got, texts)) > 50 and sum(r[2] != x for r, x in zip(got, texts)) > 20


def test_evaluation_interprets_no_pattern(spark):
    """The jobs' rewrites, scores and spreads of sentences are counted in Arrow functions, not pattern by pattern in Spark."""
    out = jobs.evaluated(spark.createDataFrame([(1, "It is late. We are here.")], "doc_id long, text string"), services.rewrite)
    plan = out.drop("perplexity")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "rlike" not in plan.lower() and "split" not in plan
    assert out.first().rewrite == "it's late. we're here."
