"""Splitting texts above a token limit at natural boundaries, into balanced pieces that overlap.

The smallest number of pieces that can hold the text with the given overlap is computed, equally long targets are placed, and each
target end moves to the strongest boundary near it (blank line, then line, sentence, clause, word, then any place). A piece's text
is tokenised again by itself; an end whose piece exceeds the limit gives way to the next best, and if no end is left one more piece is tried.
What can't be cut within the limit at all (a limit below the tokens of one character) is an error, never a longer piece.

Every piece but the first begins exactly `overlap` tokens of the document before the end of the one before, unless that token would
divide a character: then it begins at the nearest earlier token that doesn't (some tokens of scripts with
long encodings hold parts of characters). Each task handles its texts alone: there is no shuffle at all.

Defined results: null and empty texts, and those within the limit, are one piece (null text: no tokens, a null piece). An
overlap that isn't below the limit is an error. Line ends and repeated white space stay as they are: the pieces, without overlaps,
put together give the text again.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.spread import spread
from tessaline.llm.tokens import VOCABULARY, encode_array, encoding

#: Classes of characters that boundaries are made of.
_BLANK, _LINE, _STOP, _WIDE_STOP, _CLAUSE, _WIDE_CLAUSE, _CLOSER, _LIST = range(1, 9)
_CLASSES = np.zeros(0x10000, np.int8)
for _kind, _chars in (
    (_BLANK, "\t \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"),
    (_LINE, "\n\r\x0b\x0c\x85\u2028\u2029"),
    (_STOP, ".!?…"),
    (_WIDE_STOP, "。！？"),
    (_CLAUSE, ";:,"),
    (_WIDE_CLAUSE, "、，；："),
    (_CLOSER, "\"'”’)]」』）"),
    (_LIST, "#-*`|0123456789"),
):
    _CLASSES[[ord(c) for c in _chars]] = _kind
#: How far from its target an end may move, as a share of a piece's own (not overlapping) tokens.
REACH = 0.25


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8).astype(np.uint32) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def strengths(points: np.ndarray) -> np.ndarray:
    """The strength of ending a piece before each character: 6 after a blank line, 5 before a heading, list item, table row or
    fence, 4 after a line, 3 after a sentence, 2 after a clause, 1 after a word, 0 elsewhere."""
    kind = np.concatenate([np.zeros(3, np.int8), _CLASSES[np.minimum(points, 0xFFFF)], [0]])
    here, one, two, three = kind[3:], kind[2:-1], kind[1:-2], kind[:-3]
    space = (here == _BLANK) | (here == _LINE)
    out = ((one != _BLANK) & (one != _LINE) & space).astype(np.int8)
    out[((one == _CLAUSE) & space) | (one == _WIDE_CLAUSE)] = 2
    ends = (one == _STOP) | ((one == _CLOSER) & ((two == _STOP) | ((two == _CLOSER) & (three == _STOP))))
    out[(ends & space) | (one == _WIDE_STOP) | ((one == _CLOSER) & (two == _WIDE_STOP))] = 3
    pair = np.zeros(len(out), bool)
    pair[1:-1] = (points[:-1] == 13) & (points[1:] == 10)
    line = (one == _LINE) & ~pair
    out[line] = 4
    out[line & (here == _LIST)] = 5
    out[line & ((two == _LINE) & ~np.concatenate([[False], pair[:-1]]) | (three == _LINE) & (two != 0) & (two <= _LINE))] = 6
    return out


def starts_of(text: str, ids: np.ndarray, vocabulary: str) -> np.ndarray:
    """For each token border the character it lies before, or -1 inside a character."""
    lengths = token_lengths(vocabulary)[ids]
    at = np.concatenate([[0], np.cumsum(lengths)])
    if text.isascii():
        return at
    raw = np.frombuffer(text.encode(), np.uint8)
    begins = np.concatenate([raw & 0xC0 != 0x80, [True]])
    index = np.concatenate([[0], np.cumsum(begins)])[:-1] if len(raw) else np.zeros(1, int)
    char = np.where(begins, index, -1)
    return char[at]


_OTHER, _SPACE, _LETTER, _NUMBER, _MARK = range(5)


@lru_cache(maxsize=1)
def _sorts() -> np.ndarray:
    """What the tokenizer's pattern takes each character of the first plane for; apostrophes and later planes are left open."""
    table = np.zeros(0x10000, np.int8)
    for c in range(0xFFFF):
        category = unicodedata.category(chr(c))
        if chr(c).isspace():
            table[c] = _SPACE if c in (10, 32) else _OTHER
        elif category[0] in "LN":
            table[c] = _LETTER if category[0] == "L" else _NUMBER
        elif category[0] in "PS" and c != 39:
            table[c] = _MARK
    return table


def borders(text: str, ids: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token border its character and strength, -1 where it divides a character; and those that are certain borders of pre-tokens."""
    chars = starts_of(text, ids, vocabulary)
    points = code_points(text)
    kind = _sorts()[np.minimum(points, 0xFFFF)]
    before = np.concatenate([[_OTHER], kind[:-1]])
    ends = ((before == _LETTER) & (kind != _LETTER)) | ((before == _NUMBER) & (kind != _NUMBER))
    ends |= (before == _MARK) & ((kind == _LETTER) | (kind == _NUMBER) | (kind == _SPACE))
    sure = np.concatenate([ends, [False]])
    certain = np.flatnonzero((chars >= 0) & sure[np.maximum(chars, 0)])
    return chars, np.where(chars >= 0, strengths(points)[np.maximum(chars, 0)], -1), certain


def own_tokens(text: str, begin: int, end: int, chars: np.ndarray, certain: np.ndarray, vocabulary: str) -> int:
    """Tokens of the piece between two token borders when it is encoded by itself.

    Between places that part pre-tokens in any context its tokens are those of the document, so only the stretches before the first and
    after the last such place are encoded again.
    """
    a, b = np.searchsorted(certain, begin), np.searchsorted(certain, end, "right") - 1
    if b < a:
        return len(encode_array(text[chars[begin] : chars[end]], vocabulary))
    first, last = int(certain[a]), int(certain[b])
    edge = lambda x, y: len(encode_array(text[chars[x] : chars[y]], vocabulary)) if x < y else 0
    return edge(begin, first) + last - first + edge(last, end)


_LENGTHS: dict[str, np.ndarray] = {}


def token_lengths(vocabulary: str) -> np.ndarray:
    if vocabulary not in _LENGTHS:
        e = encoding(vocabulary)
        _LENGTHS[vocabulary] = np.array([len(e.decode_single_token_bytes(k)) for k in range(e.n_vocab)])
    return _LENGTHS[vocabulary]


def split(text: str, limit: int, overlap: int, vocabulary: str = VOCABULARY, ids: np.ndarray | None = None, known: tuple | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (first_token, end_token, first_char, end_char, strength of the end), in order."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    ids = encode_array(text, vocabulary) if ids is None else ids
    n = len(ids)
    if n <= limit:
        return [(0, n, 0, len(text), 7)]
    chars, strong, certain = known or borders(text, ids, vocabulary)
    whole = chars >= 0
    # The last border at or before each one that doesn't divide a character.
    back = np.maximum.accumulate(np.where(whole, np.arange(n + 1), 0))
    count = -(-(n - overlap) // (limit - overlap))
    while count <= n:
        pieces = _place(text, n, limit, overlap, count, chars, back, strong, certain, vocabulary)
        if pieces:
            return pieces
        count += 1
    return _place(text, n, limit, overlap, None, chars, back, strong, certain, vocabulary)


def _place(text, n, limit, overlap, count, chars, back, strong, certain, vocabulary):
    """Balanced ends for `count` pieces, or None; without a count each piece takes as much as it may."""
    pieces, begin, end = [], 0, 0

    def fits(stop) -> bool:
        return own_tokens(text, begin, int(stop), chars, certain, vocabulary) <= limit

    while end < n:
        left = None if count is None else count - len(pieces)
        if left is not None and left <= 0:
            return None
        most = min(n, begin + limit)
        if n - begin <= limit and (left is None or left == 1 or end == 0):
            target = stop = n
        else:
            target = most if left is None else min(most, end + round((n - end) / left))
            own = max(1, target - end)
            low, high = max(end + 1, begin + overlap + 1, target - int(own * REACH)), min(most, target + int(own * REACH), n)
            options = np.arange(low, high + 1)
            if left is not None:
                # What is left must fit into the pieces that are left.
                options = options[n - options <= (left - 1) * (limit - overlap)]
            options = options[strong[options] >= 0]
            if not len(options):
                options = np.arange(max(end + 1, begin + 1), most + 1)
                options = options[strong[options] >= 0]
                if not len(options):
                    if left is not None:
                        return None
                    raise ValueError(f"no piece of at most {limit} tokens ends with a whole character")
            exact = (back[np.maximum(options - overlap, 0)] == options - overlap).astype(int)
            order = np.lexsort((np.abs(options - target), -strong[options], -exact))
            stop = None
            for o in order:
                if fits(options[o]):
                    stop = int(options[o])
                    break
            if stop is None:
                if left is not None:
                    return None
                every = np.arange(max(end + 1, begin + 1), most + 1)[::-1]
                stop = next((int(o) for o in every if strong[o] >= 0 and fits(o)), None)
                if stop is None:
                    raise ValueError(f"no piece of at most {limit} tokens ends with a whole character")
        if stop == n and not fits(n):
            if left is not None:
                return None
            stop = next((int(o) for o in range(n - 1, max(end, begin), -1) if strong[o] >= 0 and fits(o)), None)
            if stop is None:
                raise ValueError(f"no piece of at most {limit} tokens ends with a whole character")
        pieces.append((begin, stop, int(chars[begin]), int(chars[stop]), 7 if stop == n else int(strong[stop])))
        end = stop
        begin = int(back[max(stop - overlap, begin + 1)]) if stop < n else n
        if stop < n and begin <= pieces[-1][0]:
            begin = stop
    return pieces


def split_texts(documents: DataFrame, id_col: str, text_col: str, budgets: list[tuple[str, int, int]], vocabulary: str = VOCABULARY) -> DataFrame:
    """(budget_name, id, piece_no, first_token, end_token, boundary, piece) for each budget (name, limit, overlap)."""
    kind = dict(documents.dtypes)[id_col]

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.id, batch.text, strict=True):
                ids = encode_array(text or "", vocabulary)
                known = borders(text, ids, vocabulary) if any(len(ids) > b[1] for b in budgets) else None
                for name, limit, overlap in budgets:
                    if text is None:
                        rows.append((name, i, 0, 0, 0, 7, None))
                        continue
                    for k, (a, b, c, d, strength) in enumerate(split(text, limit, overlap, vocabulary, ids, known)):
                        rows.append((name, i, k, a, b, strength, text[c:d]))
            yield pd.DataFrame(rows, columns=["budget_name", "id", "piece_no", "first_token", "end_token", "boundary", "piece"])

    schema = f"budget_name string, id {kind}, piece_no int, first_token int, end_token int, boundary int, piece string"
    small = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(small).mapInPandas(cut_up, schema).withColumnRenamed("id", id_col)
