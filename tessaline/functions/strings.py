"""Strings: estimates, redaction by pattern, similarity, stems, kinds of files, names without legal forms."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What plain redaction looks for, in this order.
SECRETS = (
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("api_key", r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*['\"]?[\w-]{16,}['\"]?"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
)
# Phrases that say that a line of work branches off; one of the first or two of the others.
PIVOTS = ("pivot to", "change direction", "start fresh", "start over", "complete rewrite", "should rewrite", "need to rewrite", "scrap this", "scrap the", "different strategy", "new strategy", "abandon")
WEAK_PIVOTS = ("instead", "new approach", "rethink", "rewrite", "pivot")


def redacted(text: Column) -> Column:
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text


def pivots(text: Column) -> Column:
    low = F.lower(text)
    count = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    return (count(PIVOTS) >= 1) | (count(WEAK_PIVOTS) >= 2)


def without_legal_form(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"[ ,]+(limited|ltd|inc|incorporated|corp|corporation|company|co|gmbh|ag|plc|llc|sa|bv)[.]?$", ""))


# Extensions of kinds of files.
FILES = {
    "Rust": "rs", "TypeScript": "ts tsx", "JavaScript": "js jsx mjs cjs", "Python": "py pyi", "Go": "go", "Java": "java", "CSharp": "cs", "Cpp": "cpp cc cxx hpp hxx", "C": "c h", "Ruby": "rb", "Markdown": "md mdx", "Json": "json",
    "Yaml": "yaml yml", "Toml": "toml", "Html": "html htm", "Css": "css scss sass less", "Sql": "sql", "Shell": "sh bash zsh fish ps1",
}


def file_kind(extension: Column) -> Column:
    out = F.lit("Other")
    for kind, endings in FILES.items():
        out = F.when(F.lower(extension).isin(*endings.split()), kind).otherwise(out)
    return out


#: Bytes looked at to tell code, share of signs (in per cent) from which a text is code.
SAMPLE, SIGNS = 512, 8


def tokens_of(text: str | None) -> int:
    """By characters where most are encoded in three bytes, by bytes of code where signs are many, else a quarter of the bytes."""
    if not text:
        return 0
    raw = text.encode()
    head = raw[:SAMPLE]
    if any(b >= 0xC0 for b in head) and 2 * len(raw) > 5 * len(text):
        return (3 * len(text) + 1) // 2
    if 100 * sum(b in b"{}[]();=<>|&#@!~^\\\"'" for b in head) >= SIGNS * len(head):
        return len(raw) * 10 // 32
    return -(-len(raw) // 4)


def token_estimate(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def estimate(texts: pd.Series) -> pd.Series:
        return texts.map(tokens_of)

    return estimate(F.coalesce(text, F.lit("")))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    s = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return s + same * 0.1 * (1 - s) if s > 0.7 else s


def jaro_winkler(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler_of(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return similarity(a, b)


_FUNCTION = frozenset("a an and are as at be but by for from had has have he her his i if in is it its me my no not of on or our she so that the their them they this to was we were will with you your".split())
_V = "aeiouy"


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The English stem by the published Porter2 rules, without its short list of exceptions."""
    if len(word) <= 2:
        return word
    w = re.sub(f"(^|[{_V}])y", r"\1Y", word.lstrip("'"))

    def region(s: str, start: int = 0) -> int:
        m = re.search(f"[{_V}][^{_V}]", s[start:])
        return start + m.end() if m else len(s)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), region(w))
    r2 = region(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break

    def short(s: str) -> bool:
        return len(s) <= r1 and bool(re.search(f"(^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$", s))

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if end in ("eedly", "eed"):
                w = base + "ee" if len(base) >= r1 else w
            elif re.search(f"[{_V}]", base):
                w = base + "e" if base.endswith(("at", "bl", "iz")) else base[:-1] if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", base) else base + "e" if short(base) else base
            break
    if re.search(f"..?[^{_V}][yY]$", w) and len(w) > 2:
        w = w[:-1] + "i"
    for end, to in (
        ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"),
        ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
    ):
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= r1 and (end != "ogi" or base.endswith("l")) and (end != "li" or base[-1:] in "cdeghkmnrt"):
                w = base + to
            break
    for end, to in (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")):
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= (r2 if end == "ative" else r1):
                w = base + to
            break
    for end in ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"):
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= r2 and (end != "ion" or base[-1:] in "st"):
                w = base
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not re.search(f"(^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$", w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stems(text: Column) -> Column:
    """The distinct stems of a text, sorted."""
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({stem(w) for w in re.findall(r"[a-z0-9]{2,}", t.lower()) if w not in _FUNCTION}))

    return cut(F.coalesce(text, F.lit("")))
