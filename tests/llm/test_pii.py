import itertools
import math
import random

import pandas as pd
import pytest

from tessaline.llm import pii, pii_examples


@pytest.fixture(scope="module")
def names(base):
    table = pd.read_parquet(f"{base}/graph_entities.parquet")
    return pii.Names.of([(n, k[0]) for n, k in zip(table.entity_name, table.labels, strict=True)])


@pytest.mark.parametrize("known", [0, 1, 2])
def test_held_out_accuracy(known):
    """Names that training hasn't met, known to nobody, by half, and all."""
    others = pii_examples.People(9)
    precision, recall = pii_examples.measure(pii_examples.examples(others, 600, 41), others.lexicons[known], pii.trained())
    assert precision >= 0.97 and recall >= 0.95


#: Sentences and names from outside the templates, the tables and the fit; the items in order.
OUTSIDE = {
    "Signed off by Robert Smith.": ["Robert Smith"], "Reviewed with John Smith on the call.": ["John Smith"], "Signed off by Maria Garcia.": ["Maria Garcia"], "Mr David Johnson called.": ["David Johnson"],
    "Contact Zhang Wei about it.": ["Zhang Wei"], "Call one two three four six eight nine one two three now.": ["one two three four six eight nine one two three"], "Please forward this to Hiroshi Tanaka today.": ["Hiroshi Tanaka"],
    "Ticket reassigned from Oleksandr Shevchenko to Ngozi Adeyemi.": ["Oleksandr Shevchenko", "Ngozi Adeyemi"], "Meeting with Dr. Siobhan O'Connor and J. K. Rowling.": ["Siobhan O'Connor", "J. K. Rowling"],
    "Thanks, Li Na": ["Li Na"], "Born in San Francisco, Peter Müller moved to New York.": ["Peter Müller"], "Invoice for Smith, John (415-867-5309).": ["Smith, John", "415-867-5309"], "Golden Gate Bridge is closed.": [],
    "Envoyer à C/ Mayor 12, Madrid": ["C/ Mayor 12, Madrid"], "United Nations Security Council": [], "Microsoft Azure and Google Cloud": [], "Happy New Year, Anna-Lena Schmidt!": ["Anna-Lena Schmidt"],
    "Prof. Ludmila Horáková wird am Montag sprechen.": ["Ludmila Horáková"], "Ring the desk on (212) 736-5000 after six.": ["(212) 736-5000"], "The invoice went to accounts@northwind-traders.com on Friday.": ["accounts@northwind-traders.com"],
    "Her social security number is 219-09-9999, please delete it.": ["219-09-9999"], "Deliver the parcel to 221B Baker Street, London": ["221B Baker Street, London"], "According to Kwame Mensah the pump failed.": ["Kwame Mensah"],
}


def test_names_and_numbers_from_outside():
    """Without any lexicon but general given names."""
    hit = found = want = 0
    for text, expected in OUTSIDE.items():
        got = [text[s.start : s.end] for s in pii.items(text, pii.Names(), pii.trained())]
        hit, found, want = hit + len(set(got) & set(expected)), found + len(got), want + len(expected)
    assert hit >= 0.9 * want and hit >= 0.9 * found


def test_joined_lexicon_gives_the_same(spark, base, names, monkeypatch):
    rows = spark.read.parquet(f"{base}/smoke_corpus.parquet")
    entities = spark.read.parquet(f"{base}/graph_entities.parquet").selectExpr("entity_name", "labels[0] as label")
    want = sorted(map(tuple, pii.found_items(rows, "id", "content", names).collect()))
    monkeypatch.setattr(pii, "CARRIED_WORDS", 10)
    joined = pii.lexicon(spark, entities)
    assert not isinstance(joined, pii.Names)
    assert sorted(map(tuple, pii.found_items(rows, "id", "content", joined).collect())) == want


def test_items_and_positions(names):
    text = "Reporter Dr. Octavio B. Yarnainelli (399.555.0138) left NI number QQ 54 66 01 A.\nLivrer au Flat 2, 192 Harrowgate Gardens, Dunmarrow ZX1 9QQ. mailto:a.b+c@hub.example.org"
    got = {(s.kind, text[s.start : s.end]) for s in pii.items(text, names, pii.trained())}
    assert got == {("person", "Octavio B. Yarnainelli"), ("phone", "399.555.0138"), ("id_number", "QQ 54 66 01 A"), ("address", "Flat 2, 192 Harrowgate Gardens, Dunmarrow ZX1 9QQ"), ("email", "a.b+c@hub.example.org")}


def test_look_alikes(names):
    for text in ("Remote is git@forge.example:fleet/maps-217.git as before.", "Prompt was root@rover-24:~$ and nothing else.", "Package toolkit@v2.0.10 pins it.", "Handle @Night_Shift_4 is a channel.", "Ticket 482-792-3307 covers it.", "Lane 14, dock 3 is blocked.", "Sector 9 Street View tiles."):
        assert pii.items(text, names, pii.trained()) == []


def test_best_equals_enumeration():
    r = random.Random(8)
    for _ in range(200):
        text = " " * 20
        found = [pii.Span(s, s + r.randint(1, 5), "person", ()) for s in (r.randint(0, 12) for _ in range(r.randint(0, 8)))]
        scores = [r.uniform(-1, 2) for _ in found]
        weights = {"person>person:space": r.uniform(-1, 1)}
        near = pii.neighbours(text, found, weights)
        free = lambda c: all(found[a].end <= found[b].start or found[b].end <= found[a].start for a, b in itertools.combinations(c, 2))

        def value(chosen):
            chosen = sorted(chosen, key=lambda i: found[i].start)
            return sum(scores[i] for i in chosen) + sum(weights.get(pii.transition(text, found[a], found[b]), 0.0) for a, b in zip(chosen, chosen[1:], strict=False))  # noqa: B023

        top = max(value(c) for n in range(len(found) + 1) for c in itertools.combinations(range(len(found)), n) if free(c))
        assert abs(value([next(i for i, f in enumerate(found) if f is x) for x in pii.best(found, scores, near)]) - top) < 1e-9


def test_marginals_are_probabilities():
    r = random.Random(3)
    for _ in range(60):
        found = sorted((pii.Span(s, s + r.randint(1, 4), "person", ()) for s in (r.randint(0, 10) for _ in range(r.randint(1, 6)))), key=lambda s: (s.end, s.start))
        scores = [r.uniform(-1, 1) for _ in found]
        links = {(j, k): r.uniform(-1, 1) for k in range(len(found)) for j in range(k) if found[j].end <= found[k].start <= found[j].end + 2}
        total, single = 0.0, [0.0] * len(found)
        for n in range(len(found) + 1):
            for c in itertools.combinations(range(len(found)), n):
                if all(found[a].end <= found[b].start for a, b in zip(c, c[1:], strict=False)):
                    p = math.exp(sum(scores[i] for i in c) + sum(links.get(x, 0.0) for x in zip(c, c[1:], strict=False)))
                    total += p
                    for i in c:
                        single[i] += p
        assert all(abs(a - b / total) < 1e-9 for a, b in zip(pii.marginals(found, scores, links)[0], single, strict=True))


def test_rows(spark, names):
    rows = [("a", "Call 020 7946 0113 now. Call 020 7946 0113."), ("b", None), ("c", ""), ("a", "Call 020 7946 0113 now. Call 020 7946 0113."), (None, "x"), ("d", "y " * 50_000 + "tel: 020 7946 0113")]
    df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "1 as items", "2 as text")
    got = {(x.row_id, x.kind, x.start_pos) for x in pii.found_items(df, "id", "content", names).collect()}
    assert got == {("a", "phone", 5), ("a", "phone", 29), ("d", "phone", 100_005)}
    out = {x.row_id: x.redacted for x in pii.annotate(df, "id", "content", names).collect()}
    assert out["a"] == "Call [PHONE] now. Call [PHONE]." and out["b"] is None and out["c"] == ""
