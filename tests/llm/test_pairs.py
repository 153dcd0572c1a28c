import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessaline.llm import pairs


def test_counts_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.choice(["hot", " Hot ", f"t{r.randint(0, 400)}", "", None]) for _ in range(r.choice([0, 1, 3, 40]))]) for i in range(500)] + [(600, None)]
    df = spark.createDataFrame(rows, "record bigint, items array<string>")
    sets = [sorted({x.strip().lower() for x in (v or []) if x and x.strip()}) for _, v in rows]
    one, two = Counter(x for s in sets for x in s), Counter(p for s in sets for p in combinations(s, 2))
    got = {(x.item_a, x.item_b): (x.a, x.b, x.k, x.n) for x in pairs.pair_counts(df, F.col("items"), 2).collect()}
    assert got == {p: (one[p[0]], one[p[1]], k, len(rows)) for p, k in two.items() if k >= 2}
    lifted = {(x.item_a, x.item_b) for x in pairs.above_chance(pairs.pair_counts(df, F.col("items"), 2), 3).collect()}
    assert lifted == {p for p, k in two.items() if k >= 2 and k * len(rows) >= 3 * one[p[0]] * one[p[1]]}


def test_empty(spark):
    assert pairs.pair_counts(spark.createDataFrame([], "items array<string>"), F.col("items"), 1).count() == 0


def test_large_vocabularies_and_small_memory(spark, monkeypatch):
    """Shuffled vocabulary, entries emitted early and items beyond the dense blocks give the same counts."""
    r = random.Random(2)
    rows = [([f"t{int(r.paretovariate(0.5)) % 3_000}" for _ in range(r.randint(0, 30))],) for _ in range(600)]
    df = spark.createDataFrame(rows, "items array<string>")
    want = Counter(p for (v,) in rows for p in combinations(sorted(set(v)), 2))
    for limit in (10, 100_000):
        monkeypatch.setattr(pairs, "BROADCAST_ITEMS", limit)
        assert {(x.item_a, x.item_b): x.k for x in pairs.pair_counts(df, F.col("items")).collect()} == dict(want)
    batches = [pd.DataFrame({"items": [np.array(sorted({int(r.paretovariate(0.5)) % 3_000 for _ in range(20)})) for _ in range(400)]}) for _ in range(3)]
    monkeypatch.setattr(pairs, "HELD", 1_000)
    total = Counter()
    for out in pairs.gram(iter(batches)):
        total.update({(int(i), int(j)): int(k) for i, j, k in out.itertuples(index=False)})
    assert total == Counter((int(a), int(b)) for x in batches for v in x["items"] for a, b in combinations(v, 2))


def test_many_items_cost_no_more_than_few():
    import time

    r = np.random.default_rng(3)
    spent = []
    for n in (1_000, 20_000):
        batch = pd.DataFrame({"items": [np.unique(r.integers(0, n, 12)) for _ in range(20_000)]})
        began = time.process_time()
        rows = sum(len(x) for x in pairs.gram(iter([batch])))
        spent.append(time.process_time() - began)
    assert rows > 1_000_000 and spent[1] < 6 * spent[0] + 1
