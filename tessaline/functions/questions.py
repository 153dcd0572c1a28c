"""The analysis of questions: kinds, attributes, weights of words, negated forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KINDS = (
    ("time", r"^(when|what (date|day|time))\b"), ("person", r"^(who|whom|whose)\b"), ("place", r"^(where|which place)\b"), ("number", r"^(how many|how much)\b"), ("cause", r"^(why|how come)\b"),
    ("polar", r"^(is|are|was|were|do|does|did|can|could|has|have)\b"), ("open", r"\?"),
)


def kind(query: Column) -> Column:
    out = F.lit("statement")
    for name, pattern in reversed(_KINDS):
        out = F.when(F.lower(query).rlike(pattern), name).otherwise(out)
    return out


def attribute(query: Column) -> tuple[Column, Column]:
    """(entity, attribute) of "X's y"; empty where there is none."""
    pattern = r"\b([A-Z][a-z]+)'s ([a-z]+)"
    return F.regexp_extract(query, pattern, 1), F.regexp_extract(query, pattern, 2)


def weight(word: Column) -> Column:
    """Information of a word: 2.3 for names, 1.7 for modifiers by their endings, 1 for the rest."""
    return F.when(word.rlike("^[A-Z]"), 2.3).when(word.rlike("(ing|ed|ful|ous|ive|able|al|ic)$"), 1.7).otherwise(1.0)


def negated(question: Column) -> Column:
    """ "Did x happen?" as "did not x happen"."""
    return F.concat(F.lit("did not "), F.lower(F.regexp_replace(question, r"^Did |\?$", "")))


STOPS = ("the", "a", "an", "of", "to", "in", "on", "at", "for", "and", "or", "is", "are", "was", "were", "be", "by", "with", "from", "it", "this", "that", "not", "no", "do", "does", "did")
VERBS = ("hit", "took", "stayed", "moved", "keeps", "wants", "reports", "check", "restart", "run", "map", "log", "fail", "raise", "rank", "use", "ask", "find")


def part_of_speech(word: Column) -> Column:
    """By lists and endings: function, verb, adjective, number, else noun."""
    return (
        F.when(word.isin(*STOPS), "function").when(word.isin(*VERBS) | word.rlike("(ed|ing|ize|ise)$"), "verb").when(word.rlike("(ful|ous|ive|able|al|ic|less)$"), "adjective")
        .when(word.rlike("^[0-9]+$"), "number").otherwise("noun")
    )


#: Relations and the verbs that stand for them, first match wins.
RELATIONS = (
    ("causes", "because|caused|leads to|explains"), ("replaces", "replaced|instead of|moved to"), ("uses", "uses|used|keeps|relies on"), ("measures", "measured|observed|mapped|logged"), ("fixes", "fixed|repaired|tuned"),
)


def relation(sentence: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(RELATIONS):
        out = F.when(F.lower(sentence).rlike(pattern), name).otherwise(out)
    return out


#: What statements of each kind look like; the first group is what is stated.
EXTRACTORS = (
    ("procedure", "check ([^ ]+) first"), ("preference", "(?:wants to|prefers to|would rather) ([a-z ]+)"), ("pattern", "(Observed [0-9]+% more [a-z ]+ events)"), ("decision", "Decision: (.*)"),
)
