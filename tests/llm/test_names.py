import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessaline.llm import names

NODES = [("u1", "Johannes Wynuric", "PERSON"), ("u2", "Octavio Yarnainelli", "PERSON"), ("u3", "Moraihoff Sensor Technologies Limited", "ORGANIZATION"), ("u4", "Ostreiwick Text and Speech University", "ORGANIZATION"), ("u5", "Olivia Yarnbrook", "PERSON"), ("u6", "Oscar Yarnbrook", "PERSON")]
CASES = {
    "Wynuric, Hans": "u1", "J. Wynuric": "u1", "johannes  wynurci": "u1", "Dr Johannes T. Wynuric's": "u1", "Oct. Yarnaine1li": "u2", "YARNAINELLI OCTAVIO": "u2", "Moraihoff Sensor Tech Ltd": "u3", "MSTL": "u3", "M.S.T.L.": "u3",
    "Sensor Technologies Limited, Moraihoff": "u3", "MoraihoffSensor Technologies Limited": "u3", "The Ostreiwick Text & Speech Univ.": "u4", "O. Yarnbrook": None, "Somebody Else": None, "": None, "  ": None, "Johannes Wynuric": None,
}


def osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.text("abc", min_size=1, max_size=9)), min_size=1, max_size=8))
def test_distances(pairs):
    got = names.distances([a for a, _ in pairs], [b for _, b in pairs], 2)
    assert got.tolist() == [min(3, osa(a, b)) for a, b in pairs]


def test_pigeonhole_misses_nothing():
    r = random.Random(6)
    for _ in range(400):
        form = "".join(r.choice("abcdef") for _ in range(r.randint(4, 24)))
        key = list(form)
        for _ in range(names.edits(len(form))):
            i = r.randrange(len(key) - 1)
            kind = r.randrange(4)
            if kind == 0:
                key[i], key[i + 1] = key[i + 1], key[i]
            elif kind == 1:
                del key[i]
            elif kind == 2:
                key.insert(i, r.choice("abcdef"))
            else:
                key[i] = r.choice("abcdef")
        if osa(form, "".join(key)) > names.edits(len(form)):
            continue
        index = {(len(form), i, t) for i, _, t in names.segments(form)}
        assert index & set(names.probes("".join(key), {len(form)})), (form, key)


def test_links(spark):
    entities = spark.createDataFrame(NODES, "uuid string, entity_name string, label string")
    mentions = spark.createDataFrame([(s,) for s in CASES] * 2 + [(None,)], "spelling string").selectExpr("*", "1 as uuid", "2 as key")
    got = {x.spelling: x.uuid for x in names.link(mentions, entities).collect()}
    assert got == {s: u for s, u in CASES.items() if u}
    assert names.link(mentions, entities.limit(0)).count() == 0
    assert names.link(mentions.limit(0), entities).count() == 0


def test_links_do_not_depend_on_other_entities_or_on_sizes(spark, base, monkeypatch):
    """More entities that resemble none, other partitions, and joins without broadcasts change no link."""
    mentions = spark.createDataFrame([(s,) for s in CASES], "spelling string")
    more = [(f"x{i}", f"Qzx{i:04}vbn Wkq{i * 7:05}ghj", "PERSON") for i in range(300)]
    want = {(s, u) for s, u in CASES.items() if u}
    wide = spark.createDataFrame(NODES + more, "uuid string, entity_name string, label string").repartition(5)
    assert {tuple(x) for x in names.link(mentions, wide).select("spelling", "uuid").collect()} == want
    monkeypatch.setattr(names, "BROADCAST_ROWS", 0)
    assert {tuple(x) for x in names.link(mentions.repartition(3), wide).select("spelling", "uuid").collect()} == want


def test_recall_by_length():
    """Random single slips are met by some probe at every length from WHOLE_EDIT on."""
    r = random.Random(4)
    for length in range(names.WHOLE_EDIT, 30):
        for _ in range(40):
            form = "".join(r.choice("abcdefghij") for _ in range(length))
            i = r.randrange(length - 1)
            key = r.choice([form[:i] + form[i + 1 :], form[:i] + r.choice("klm") + form[i:], form[:i] + "z" + form[i + 1 :], form[:i] + form[i + 1] + form[i] + form[i + 2 :]])
            assert {(length, i, t) for i, _, t in names.segments(form)} & set(names.probes(key, {length}))
