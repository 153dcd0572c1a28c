"""Few sets against many: by blocks the same pairs as by the join on rare words, and no row for each two sets with a word in common."""

import random

import pytest
from pyspark.sql import functions as F

from tessaline.operators import overlap
from tests.test_bm25 import crowded, leg_of, shuffled  # noqa: F401


def test_blocks_equal_the_join(spark, monkeypatch):
    r = random.Random(2)
    some = lambda n, p, c: spark.createDataFrame([(f"{p}{i}", sorted({f"w{r.randrange(15)}" for _ in range(r.randrange(8))})) for i in range(n)], f"{p} string, {c} array<string>")
    left, right = some(60, "l", "a"), some(150, "r", "b")
    pairs = lambda: {(x.l, x.r, round(x.score, 9)) for x in overlap.dice_pairs(left, right, "l", "r", 0.5).collect()}
    got = pairs()
    monkeypatch.setattr(overlap, "BLOCK_RIGHT", 20)
    monkeypatch.setattr(overlap, "BLOCK_LEFT", 7)
    assert pairs() == got
    monkeypatch.setattr(overlap, "MET_WHOLE", 0)
    assert pairs() == got and got


def test_pairs_with_a_common_word_are_not_shuffled(spark):
    left = spark.range(200).select(F.col("id").alias("l"), F.array(F.lit("all"), F.lit("every"), F.concat(F.lit("x"), "id"), F.concat(F.lit("z"), "id")).alias("a"))
    right = spark.range(2_000).select(F.col("id").alias("r"), F.array(F.lit("all"), F.lit("every"), F.concat(F.lit("y"), "id")).alias("b"))
    before = shuffled(spark)
    assert overlap.dice_pairs(left, right, "l", "r", 0.8).count() == 0
    assert shuffled(spark) - before < 20_000


def test_counts_are_those_of_the_pairs(spark, monkeypatch):
    r = random.Random(5)
    some = lambda n, p, c: spark.createDataFrame([(f"{p}{i}", sorted({f"w{r.randrange(15)}" for _ in range(r.randrange(8))})) for i in range(n)], f"{p} string, {c} array<string>")
    left, right = some(60, "l", "a"), some(150, "r", "b")
    want = {(x.l, x["count"]) for x in overlap.dice_pairs(left, right, "l", "r", 0.5).groupBy("l").count().collect()}
    counts = lambda: {(x.l, x.n) for x in overlap.dice_counts(left, right, "l", "r", 0.5).collect()}
    assert counts() == want and want
    monkeypatch.setattr(overlap, "BLOCK_RIGHT", 20)
    assert counts() == want
    monkeypatch.setattr(overlap, "MET_WHOLE", 0)
    assert counts() == want


@pytest.mark.parametrize("name", ["m07_funnel", "m09_ablation", "m01_hits_at", "w11_rank_of_gold"])
def test_judgements_of_what_was_found_shuffle_no_pairs(name, crowded, spark):
    assert leg_of(name, crowded, spark) < 100_000
