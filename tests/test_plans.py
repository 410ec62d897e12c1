"""What the plans of heavy text queries compute, and how often."""

import pytest
from pyspark.sql import functions as F

from proselab import queries as library
from proselab.operators import alignment, frontier, jobs, perplexity
from proselab.plans import programs

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flags_are_not_computed_again_before_the_scan(spark):
    plan = optimized(library.QUERIES["flag_histogram"](spark, SF))
    below = plan[plan.index("Generate"):]
    assert not [line for line in below.splitlines() if "Filter" in line]


def test_candidates_do_not_move_to_their_strategies(spark):
    df = library.QUERIES["strategy_lookup"](spark, SF)
    assert "Inner, BuildRight" in df._jdf.queryExecution().executedPlan().toString()


def test_arrow_functions_get_few_texts_at_a_time(spark):
    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    for name in ("chunker", "scrub_full", "scrub_effect", "burstiness_full"):
        spark.conf.set(key, rows)
        library.QUERIES[name](spark, SF)
        assert int(spark.conf.get(key)) <= 500, name


def test_tokens_are_counted_within_their_text(spark):
    plan = library.QUERIES["unigram_perplexity"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert keys and not any("doc_id#" in k and "token#" in k for k in keys)


def test_a_text_is_lowered_once_for_all_its_facts(spark):
    plan = optimized(library.QUERIES["fact_overlap"](spark, SF))
    share = plan.splitlines()[0]
    assert share.count("(\\d),(\\d)") == 1


def test_words_are_aligned_where_their_row_is(spark):
    df = spark.range(3).select(F.lit("the old mill").alias("a"), F.lit("the mills").alias("b"))
    plan = alignment.aligned(df, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def _mills(spark):
    return spark.createDataFrame([(k, f"the old mill by the river {'of stone ' * k}") for k in range(9)], "doc_id long, text string")


@pytest.mark.parametrize("how", [(256, 1, 1), (4, 3, 2)])
def test_tokens_do_not_move_for_perplexity(spark, monkeypatch, how):
    plain = {r.doc_id: r.perplexity for r in perplexity.perplexity(_mills(spark), folds=3).collect()}
    monkeypatch.setattr(perplexity.blocks, "exchange", lambda *_, **__: perplexity.blocks.Exchange(*how))
    df = _mills(spark)
    made = perplexity.perplexity(df, folds=3)
    assert "before#" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.perplexity for r in made.collect()} == pytest.approx(plain)
    one = spark.createDataFrame([(5, "the old mill")], "doc_id long, text string")
    rows = df.union(one).repartition(4)
    assert perplexity.perplexity(rows, df, folds=3).where("doc_id = 5").count() == 2


def test_a_text_moves_once_for_all_its_prompts(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "doc_id long, text string")
    done = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 1), (None, 0)], "human_idx long, prompt_idx int")
    rows = jobs.pair_rows(docs, 3, lambda left: left.withColumn("ai", F.col("human")), done)
    plan = optimized(rows)
    assert plan.index("Generate explode") < plan.index("Join")
    assert {(r.human_idx, r.prompt_idx) for r in rows.collect()} == {(k, p) for k in range(6) for p in range(3)} - {(1, 0), (1, 1), (1, 2), (2, 1)}


def test_candidates_do_not_read_their_sentences_again(spark):
    docs = spark.createDataFrame([(1, ["The mill.", "It is old.", "It is red."])], "doc_id long, sents array<string>")
    docs = docs.withColumns({"tok": F.expr("array(array(1L, 2L), array(3L, 4L, 5L), array(3L, 4L, 6L))"), "counts": F.expr("array(2, 3, 3)"), "types": F.lit(6)})
    rows = frontier.thinned(docs, 2, 2, programs._shared, lambda left: programs.evenness(left("counts")))
    assert "regexp" not in optimized(rows)
    got = {r.cand_idx: (r.output, round(r.sim, 6), round(r.overlap, 6)) for r in rows.collect()}
    assert got == {0: ("It is old.", round(6 / 9, 6), round(1 / 3, 6)), 1: ("The mill. It is red.", round(10 / 11, 6), round(2 / 3, 6))}
