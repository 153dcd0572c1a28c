"""Pairs inside groups, in blocks."""

import itertools
import random

from tessaline.operators import overlap
from tessaline.plans import catalog


def test_groups_equal_a_plain_loop(spark, monkeypatch):
    """Also in blocks, for a key with two texts, and for two keys that meet in two groups."""
    r = random.Random(3)
    rows = [(f"k{i:03}", r.choice("xxxy"), sorted({f"w{r.randrange(12)}" for _ in range(r.randrange(1, 7))})) for i in range(120)]
    rows += [("k001", "x", ["w1", "w2"]), ("k001", "x", ["w1", "w3"]), ("k002", "y", ["w1", "w2"]), ("k003", "x", []), ("k001", "y", ["w1", "w2"]), ("k002", "x", ["w1", "w2"])]
    want = []
    for (a, g, s), (b, h, t) in itertools.product(rows, rows):
        if g == h and a < b and len({*s} & {*t}) >= 0.3 * len({*s} | {*t}) > 0:
            want.append((a, b, round(len({*s} & {*t}) / len({*s} | {*t}), 6)))
    df = spark.createDataFrame(rows, "k string, g string, t array<string>")
    for block in (1_024, 7):
        monkeypatch.setattr(overlap, "GROUP_BLOCK", block)
        got = [(x.a, x.b, round(x.score, 6)) for x in overlap.jaccard_in_groups(df, "k", "g", "t", 0.3).collect()]
        assert sorted(got) == sorted(want)


def test_words_of_an_episode_are_not_joined(spark, base):
    """One join by episode, none on (episode, word)."""
    df = catalog.registry().queries["j06_jaccard_in_episode"](spark, base)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "Generate explode(t" not in plan and plan.count("array_intersect") >= 1
