"""Sentences and their kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (kind, pattern, confidence), the first that matches wins; all without regard to case.
KINDS = (
    ("Decision", r"\b(decided|chose|chosen|went with|picked|selected|opted for|decision to)\b", 0.85),
    ("Learning", r"\b(learned|realized|understood|figured out|now I know|insight)\b", 0.85),
    ("Error", r"(error:|bug:|exception:|failed:|broke:|crash|traceback|stacktrace|\bfixed\b)", 0.85),
    ("Discovery", r"\b(discovered|found that|noticed|stumbled upon|turns out)\b", 0.8),
    ("Pattern", r"(pattern:|always|every time|whenever|consistently|tends to)\b", 0.75),
    ("Intention", r"\b(will|tomorrow|later|remind me|don't forget|need to remember|scheduled|need to fix)\b", 0.7),
    ("CodeEdit", r"\b(edited|changed|modified|updated|refactored|renamed|moved)\b.*\b(file|code|function|class|module)\b", 0.75),
    ("FileAccess", r"\b(opened|read|accessed|viewed|looked at)\b.*\b(file|document|page)\b", 0.7),
    ("Search", r"\b(searched|looked for|found|grep|rg|find)\b", 0.65),
    ("Command", r"\b(ran|executed|command:|terminal|shell|bash|npm|cargo|git)\b", 0.7),
    ("Task", r"\b(task:|todo:|need to|should|must|have to|working on)\b", 0.7),
    ("Context", r"(context:|background:|for reference|fyi|note:)\b", 0.7),
    ("Conversation", r"\b(said|told|asked|replied|mentioned|discussed|conversation)\b", 0.6),
)


def kind(text: Column) -> Column:
    out = F.lit("Observation")
    for name, pattern, _ in reversed(KINDS):
        out = F.when(text.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """The parts of a text that end in a point, an exclamation or a question mark before white space."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \n\r\t]+", "$1\u0001"), "\u0001")
