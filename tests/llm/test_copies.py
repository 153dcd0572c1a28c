import random

from tessaline.llm import copies

SAME = [
    ("A  b,\tC! 1.5 -3", "a b c 1.5 -3.", True), ("a b", "a​ b", True), ("1.5", "15", False), ("x -3", "x 3", False), ("1,5", "1.5", False), ("Straße", "STRASSE", True),
    ("SHO-12", "sho‐12", True), ('{"a": "1", "b": "X y"}', "b: x  y; a: 1", True), ("a=1 | b=2", "b: 2\na: 1", True), ("a=1 | b=2", "a=2 | b=1", False), ("a: 1\nb: 2", "a: 1\nb: 3", False), ("", " ...", True),
]


def test_canonical():
    for a, b, same in SAME:
        assert (copies.canonical(a) == copies.canonical(b)) is same, (a, b)


def test_objects_are_compared_whole():
    for a, b, same in [
        ('{"a":"x","ids":[1]}', '{"a":"x","ids":[2]}', False), ('{"a":"x","ids":[1,2]}', '{"ids": [1, 2], "a": "X"}', True), ('{"ids":[1,2]}', '{"ids":[12]}', False),
        ('{"a":{"b":1,"c":2}}', '{"a":{"c":2,"b":1}}', True), ('{"a":{"b":1}}', '{"a":{"b":2}}', False), ('{"a":1} and then', '{"a":1} or else', False), ('{"a":1.50,"b":null}', '{"b":null,"a":1.50}', True),
    ]:
        assert (copies.canonical(a) == copies.canonical(b)) is same, (a, b)


def test_runs_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(f"id{i:05}", "hot record" if i % 3 == 0 else f"text {r.randint(0, 200)}{r.choice(['', '.', ' !'])}") for i in range(3_000)]
    rows += [(None, "hot record"), ("zz", None), ("long", "x" * 200_000), ("long2", "X " * 100_000)]
    df = spark.createDataFrame(rows, "id string, content string").repartition(7).selectExpr("*", "1 as form", "'a' as first_id")
    groups: dict[str, list[str]] = {}
    for i, t in rows:
        if i is not None and t is not None:
            groups.setdefault(copies.canonical(t), []).append(i)
    want = {i: min(g) for g in groups.values() for i in g}
    assert {x.id: x.first_id for x in copies.runs(df, "id", "content").collect()} == want
    assert {x.first_id: x.copies for x in copies.copies(df, "id", "content").collect()} == {min(g): len(g) for g in groups.values()}


def test_empty(spark):
    assert copies.runs(spark.createDataFrame([], "id string, content string"), "id", "content").count() == 0
