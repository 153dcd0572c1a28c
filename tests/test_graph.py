import random

from tessaline.operators import graph, linkage
from tessaline.plans import analytics


def test_components_equal_union_find(spark):
    r = random.Random(4)
    edges = [(f"n{r.randint(0, 150)}", f"n{r.randint(0, 150)}") for _ in range(120)] + [("hub", f"x{i}") for i in range(60)] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    parent: dict[str, str] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups: dict[str, list[str]] = {}
    for n in list(parent):
        groups.setdefault(find(n), []).append(n)
    want = {n: min(g) for g in groups.values() for n in g}
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {x.node: x.component for x in graph.components(df).collect()} == want


def test_reach_and_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(x.node, x.depth) for x in graph.reach(df, seeds, 1).collect()} == {("a", 0), ("b", 1)}
    assert {(x.node, x.depth) for x in graph.reach(df, seeds, 9).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert graph.reach(df.limit(0), seeds, 3).count() == 1


def test_ancestors_end_in_cycles(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("r", None)], "k string, p string")
    assert {(x.node, x.ancestor, x.steps) for x in graph.ancestors(df, "k", "p").collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2), ("x", "y", 1), ("y", "x", 1)}


def test_page_rank_keeps_mass_without_dead_ends(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 3.0), ("c", "a", 2.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 2.0)], "node string, mass double")
    rank = {x.node: x.score for x in graph.page_rank(df, seeds, rounds=6).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["a"] > rank["b"] > rank["c"]


def brute_rank(edges, seeds, rounds):
    """Power iteration over dicts, ended when the scores change by less than 1e-6 in all; dangling mass is dropped."""
    out: dict[str, float] = {}
    for a, _, w in edges:
        out[a] = out.get(a, 0) + w
    base = {n: m / sum(seeds.values()) for n, m in seeds.items()}
    rank = dict(base)
    for k in range(rounds):
        new = {n: 0.5 * m for n, m in base.items()}
        for a, b, w in edges:
            if a in rank:
                new[b] = new.get(b, 0) + 0.5 * rank[a] * w / out[a]
        change = sum(abs(s - rank.get(n, 0)) for n, s in new.items())
        rank = new
        if change < 1e-6:
            return rank, k + 1
    return rank, rounds


def test_page_rank_converges(spark):
    r = random.Random(9)
    edges = [(f"n{r.randint(0, 20)}", f"n{r.randint(0, 25)}", float(r.randint(1, 5))) for _ in range(70)] + [("n0", "n1", 1.0), ("n1", "n0", 2.0)]
    want, rounds = brute_rank(edges, {"n0": 1.0, "n3": 3.0}, 30)
    assert 10 < rounds < 30
    seeds = spark.createDataFrame([("n0", 1.0), ("n3", 3.0)], "node string, mass double")
    rank = graph.page_rank(spark.createDataFrame(edges, "src string, dst string, weight double"), seeds, rounds=30, tolerance=1e-6)
    got = {x.node: x.score for x in rank.collect()}
    assert set(got) == set(want)
    assert all(abs(got[n] - s) < 1e-12 for n, s in want.items())


def test_converged_rank_of_the_sales(spark, base):
    edges, seeds = analytics._sales_graph(spark, base)
    want, _ = brute_rank([tuple(x) for x in edges.select("src", "dst", "weight").collect()], {x.node: x.mass for x in seeds.collect()}, 30)
    got = {x.node: x.score for x in analytics.g16_converged_rank(spark, base).collect()}
    assert set(got) == set(want)
    assert all(abs(got[n] - s) < 2e-9 for n, s in want.items())


def test_linkage_separates_levels():
    patterns = [((3, 1), 40), ((2, 1), 15), ((0, 0), 900), ((0, 1), 200), ((1, 0), 60)]
    share, m, u = linkage.fit(patterns)
    assert 0 < share < 0.5
    assert m[0][3] / u[0][3] > 1 > m[0][0] / u[0][0]
