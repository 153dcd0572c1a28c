"""Judgements on statements: usable, worth knowing, no entity, of which kind; what they extract.

Patterns that must give the same in Java's and other engines' regular expressions keep to what both share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A statement begins with a letter, has a verb-like length of words, and doesn't end as a question.
_WORDS, _MOST = 4, 60
_BEGINS = r"^[A-Za-z]"
#: What logs, paths, traces and boilerplate look like.
NOISE = r"(traceback|stack trace|^\s*[\[{<]|https?://|[a-z]+/[a-z]+/[a-z]+|^\d{4}-\d\d-\d\d|todo:|lorem ipsum)"
#: What identifiers, hashes, paths, versions and numbers look like.
STRUCTURE = r"^([0-9a-f]{7,40}|v?[0-9]+([.][0-9]+)+|[0-9][0-9.,:%-]*|[A-Za-z0-9_.-]*/[A-Za-z0-9_./-]*|[A-Za-z]+[_-][0-9]+|[^A-Za-z0-9]*)$"


def fact_shaped(text: Column) -> Column:
    words = F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))
    return words.between(_WORDS, _MOST) & text.rlike(_BEGINS) & ~text.rlike(r"\?\s*$")


FACT_SHAPED_SQL = rf"(len(string_split(trim(regexp_replace(content, '\s+', ' ', 'g'), ' '), ' ')) BETWEEN {_WORDS} AND {_MOST} AND regexp_matches(content, '{_BEGINS}') AND NOT regexp_matches(content, '\?\s*$'))"


def worthy(text: Column) -> Column:
    return fact_shaped(text) & ~F.lower(text).rlike(NOISE)


WORTHY_SQL = rf"({FACT_SHAPED_SQL} AND NOT regexp_matches(lower(content), '{NOISE}'))"


def structural(name: Column) -> Column:
    return name.rlike(STRUCTURE)


STRUCTURAL_SQL = f"regexp_matches(item, '{STRUCTURE}')"

# Kinds of facts by their words, first match wins.
FACT_WORDS = (
    ("preference", ("prefer", "like", "always", "never", "favorite")),
    ("capability", ("can ", "able to", "supports")),
    ("relationship", ("relates to", "depends on", "connects")),
    ("procedure", ("to ", "run ", "execute", "deploy")),
    ("definition", (" is ", " are ", "means")),
)


def fact_kind(text: Column) -> Column:
    low, out = F.lower(text), F.lit("pattern")
    for name, words in reversed(FACT_WORDS):
        met = F.lit(False)
        for w in words:
            met = met | low.contains(w)
        out = F.when(met, name).otherwise(out)
    return out
