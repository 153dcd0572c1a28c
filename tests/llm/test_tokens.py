import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessaline.llm import packing, splitting, tokens


def corpus():
    r = random.Random(4)
    shared = ["".join(r.choice("abcde fgh ijk.\n 'llé中文🙂") for _ in range(n)) for n in (300, 2_000, 30_000)]
    texts = [None, "", " ", "<|endoftext|>", "a" * 20_000, "\r\n" * 500, "it's" * 3_000]
    for _ in range(60):
        texts.append("".join(r.choice([r.choice(shared), f" {r.random()} ", "\n\n  x", "word " * r.randint(0, 300)]) for _ in range(r.randint(1, 4))))
    return [*texts, *texts[-5:]]


def test_ids_agree_exactly(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as h").repartition(5)
    got = {x.doc_id: list(x.ids) for x in tokens.token_ids(df).collect()}
    assert got == {i: tokens.encode(t) if t else [] for i, t in rows}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_ids_agree_without_broadcasts_and_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BROADCAST_LISTS", 0)
    monkeypatch.setattr(tokens, "BROADCAST_CHUNKS", 0)
    texts = corpus()
    rows = [(i % 40 if i % 3 else None, t) for i, t in enumerate(texts)] + [(5, texts[20]), (5, texts[20])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((str(x.doc_id), list(x.ids)) for x in tokens.token_ids(df).collect())
    assert got == sorted((str(i), tokens.encode(t) if t else []) for i, t in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'sl\n\t.9é中 ", max_size=80), st.data())
def test_middle_is_exact_in_any_context(text, data):
    before, after = data.draw(st.text(alphabet="a '\n9", max_size=6)), data.draw(st.text(alphabet="a 's\n9", max_size=6))
    at = tokens.middle(text)
    if at:
        whole = before + text + after
        a, b = len(before) + at[0], len(before) + at[1]
        assert tokens.encode(whole) == tokens.encode(whole[:a]) + tokens.encode(text[at[0] : at[1]]) + tokens.encode(whole[b:])


def test_pieces_fit_overlap_and_rebuild():
    for text in corpus():
        for limit, overlap in ((64, 8), (256, 32)):
            if not text:
                continue
            ids, at = tokens.encode(text), 0
            out = splitting.split(text, limit, overlap)
            rebuilt = ""
            for k, (a, b, c, d, _) in enumerate(out):
                assert len(tokens.encode(text[c:d])) <= limit
                assert b - a <= limit + 3
                if k:
                    assert out[k - 1][1] - a >= min(overlap, out[k - 1][1] - out[k - 1][0] - 1) or out[k - 1][1] == a
                rebuilt += text[at:d]
                at = d
            assert rebuilt == text and out[-1][1] == len(ids)


def test_pieces_of_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 900)], "doc_id bigint, text string")
    rows = splitting.split_texts(df, "doc_id", "text", [("small", 256, 32)]).collect()
    assert [(r.doc_id, r.piece) for r in rows if r.doc_id < 3] == [(1, None), (2, "")]
    assert len([r for r in rows if r.doc_id == 3]) == -(-(len(tokens.encode("word " * 900)) - 32) // 224)


def test_packing(spark):
    r = random.Random(3)
    sizes = [(i, r.choice([0, None, 1, 40, 100, 101, 250, r.randint(1, 100)])) for i in range(2_000)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n int").selectExpr("*", "1 as container")
    rows = packing.pack(df, "doc_id", "n", [("box", 100)], group=500).collect()
    load: dict[str, int] = {}
    total: dict[int, int] = {}
    for x in rows:
        total[x.doc_id] = total.get(x.doc_id, 0) + x.piece_tokens
        if x.container is None:
            assert x.piece_tokens == 0
        else:
            load[x.container] = load.get(x.container, 0) + x.piece_tokens
    assert max(load.values()) <= 100
    assert total == {i: n or 0 for i, n in sizes}
    assert all(len([x for x in rows if x.doc_id == i]) == 1 for i, n in sizes if (n or 0) <= 100)
    # No worse than three percent beyond best fit decreasing over all items at once.
    gaps: list[int] = []
    for size in sorted((x.piece_tokens for x in rows if x.piece_tokens), reverse=True):
        fit = min((g for g in gaps if g >= size), default=None)
        if fit is None:
            gaps.append(100 - size)
        else:
            gaps[gaps.index(fit)] = fit - size
    assert len(load) <= 1.03 * len(gaps)
    assert packing.pack(df.limit(0), "doc_id", "n", [("box", 100)]).count() == 0


def test_sum_of_squares_picks_the_least_sum():
    import numpy as np

    r, capacity = np.random.default_rng(1), 30
    sizes = r.integers(1, 31, 200)
    place = packing.sum_of_squares(sizes, capacity)
    gaps: list[int] = []
    for k, s in enumerate(sizes):
        def value(g):
            n = np.bincount([x for x in g if 0 < x < capacity], minlength=capacity + 1)
            return int((n**2).sum())

        options = [value([*gaps[:i], gaps[i] - s, *gaps[i + 1 :]]) for i in range(len(gaps)) if gaps[i] >= s and gaps[i] > 0] + [value([*gaps, capacity - s])]
        if place[k] == len(gaps):
            gaps.append(capacity)
        gaps[place[k]] -= s
        assert gaps[place[k]] >= 0 and value(gaps) == min(options)


def test_a_limit_below_a_character_is_an_error():
    import pytest

    with pytest.raises(ValueError, match="whole character"):
        splitting.split("\U0001fae8" * 40, 1, 0)


def test_as_few_pieces_as_any_count_allows():
    """No smaller count can be placed: each one below the result fails by itself."""
    r = random.Random(11)
    for _ in range(20):
        text = " ".join(r.choice(["tide", "Boje.", "中文。", "x" * 30, "1234567", "\n\n"]) for _ in range(r.randint(100, 600)))
        ids = tokens.encode_array(text)
        out = splitting.split(text, 64, 8)
        chars, strong, certain = splitting.borders(text, ids, splitting.VOCABULARY)
        import numpy as np

        back = np.maximum.accumulate(np.where(chars >= 0, np.arange(len(ids) + 1), 0))
        for count in range(-(-(len(ids) - 8) // 56), len(out)):
            assert splitting._place(text, len(ids), 64, 8, count, chars, back, strong, certain, splitting.VOCABULARY) is None
